"""Choice between recognition engines, page texts, batches and the result store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean_blocks(blocks: DataFrame, *keys: str) -> DataFrame:
    """Texts of an engine's blocks joined by spaces, with the mean confidence to four places."""
    texts = F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda b: b["text"])
    return blocks.groupBy(*keys).agg(
        F.trim(F.array_join(texts, " ")).alias("text"), F.round(F.avg("confidence"), 4).alias("confidence"), F.count("*").alias("blocks")
    )


def cascade(primary: Column, secondary: Column, fallback: Column, voting: bool = False) -> Column:
    """The first engine's text if any, else the second's; with ``voting`` a weak second yields to a longer third."""
    weak = F.when(F.length(fallback["text"]) > F.length(secondary["text"]), fallback).otherwise(secondary) if voting else secondary
    return F.when(primary["text"] != "", primary).when(secondary["confidence"] >= 0.3, secondary).otherwise(weak)


def page_text(elements: DataFrame, page: str = "page_id", position: str = "position", text: str = "text") -> DataFrame:
    """Texts that aren't blank, joined by line ends in reading order, with a preview of 500 characters."""
    read = F.regexp_replace(F.col(text), r"(?U)\s", "") != ""
    # nulls aren't collected, so pages without a text keep their row: one aggregation, no join
    found = F.sort_array(F.collect_list(F.when(read, F.struct(position, F.col(text).alias("t")))))
    texts = elements.groupBy(page).agg(F.array_join(F.transform(found, lambda x: x["t"]), "\n").alias("full_text"))
    return texts.withColumn("preview", F.substring("full_text", 1, 500))


ALLOWED = [".jpg", ".jpeg", ".png"]
MAX_BYTES = 50 * 1024 * 1024


def valid_upload(name: Column, size: Column) -> Column:
    """An allowed extension in any case, and at most 50 MB where the size is known."""
    ext = F.lower(F.regexp_extract(name, r"[^/](\.[^./]*)$", 1))
    return ext.isin(*ALLOWED) & (size.isNull() | (size <= MAX_BYTES))


def list_results(results: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of the store by falling id, with the number of all results; missing facts get their defaults."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit is 1 to 100, offset 0 or more")
    page = results.orderBy(F.desc("request_id")).offset(offset).limit(limit)
    total = results.agg(F.count("*").alias("total"))
    # one row, whatever the store's size
    return page.join(F.broadcast(total)).select(
        "request_id",
        F.coalesce("file", F.lit("unknown")).alias("file"),
        F.coalesce("record_type", F.lit("unknown")).alias("record_type"),
        F.coalesce("needs_review", F.lit(True)).alias("needs_review"),
        F.coalesce("time", F.lit(0.0)).alias("time"),
        "total",
    )


def get_result(results: DataFrame, request_id: str) -> DataFrame:
    return results.where(F.col("request_id") == request_id)


def delete_results(results: DataFrame, ids: DataFrame) -> DataFrame:
    """The store without the given ids."""
    return results.join(ids.select("request_id").distinct(), "request_id", "left_anti")


def batch_outcome(files: DataFrame, batch: str = "batch_id", max_files: int | None = 20) -> DataFrame:
    """What becomes of batches of files ``batch, ord, ok``.

    Files are taken in order up to the first failure; then all are rolled back,
    though the results still list the successes.  ``total`` counts what was
    tried.  Batches over ``max_files`` are refused.
    """
    w = Window.partitionBy(batch)
    first = F.min(F.when(~F.col("ok"), F.col("ord"))).over(w)
    tried = files.withColumn("bad", first).withColumn("n", F.count("*").over(w)).where(F.col("bad").isNull() | (F.col("ord") <= F.col("bad")))
    out = tried.groupBy(batch).agg(
        F.count("*").alias("total"),
        F.count_if("ok").alias("success"),
        F.count_if(~F.col("ok")).alias("failed"),
        (F.count_if(~F.col("ok")) > 0).alias("rollback"),
        F.max("n").alias("n"),
    )
    if max_files is not None:
        out = out.where(F.col("n") <= max_files)
    return out.drop("n")
