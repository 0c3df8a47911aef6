"""Training sets: pairs, splits, samples, crops, accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vestry.functions.text import strip


def pair(images: DataFrame, texts: DataFrame, max_samples: int | None = None) -> DataFrame:
    """Images with the text of the same stem; texts of fewer than two characters fall out."""
    t = texts.select("stem", strip(F.col("text")).alias("text")).where(F.length("text") >= 2)
    out = images.select("stem", "image_path").join(t, "stem")
    return out if max_samples is None else out.orderBy("image_path").limit(max_samples)


def _rank(df: DataFrame, key: str, salt: str) -> DataFrame:
    """Numbers rows in the order of a hash of their key, bucket by bucket instead of in one task."""
    h = F.md5(F.concat(F.lit(salt), F.col(key).cast("string")))
    rows = df.withColumn("__h", h).withColumn("__b", F.substring("__h", 1, 3))
    counts = rows.groupBy("__b").agg(F.count("*").alias("__n"))
    # at most 4,096 buckets, so this window and the broadcast are bounded
    before = counts.select("__b", (F.sum("__n").over(Window.orderBy("__b")) - F.col("__n")).alias("__before"))
    return rows.join(F.broadcast(before), "__b").withColumn(
        "rank", F.col("__before") + F.row_number().over(Window.partitionBy("__b").orderBy("__h", key))
    ).drop("__h", "__b", "__before")


def split(df: DataFrame, key: str, test: float = 0.1, val: float = 0.1, salt: str = "") -> DataFrame:
    """Adds ``split``: the first tenth in hash order is the test set, the next the validation set, the rest trains.

    The hash stands for the original's unseeded shuffle, so that the split can be repeated.
    """
    total = df.agg(F.count("*").alias("__total"))
    ranked = _rank(df, key, salt).join(F.broadcast(total))
    n_test, n_val = F.floor(F.col("__total") * test), F.floor(F.col("__total") * val)
    name = F.when(F.col("rank") <= n_test, "test").when(F.col("rank") <= n_test + n_val, "val").otherwise("train")
    return ranked.withColumn("split", name).drop("rank", "__total")


def sample(df: DataFrame, key: str, n: int, salt: str = "") -> DataFrame:
    """``n`` rows in hash order: a top-k, not a sort of all."""
    h = F.md5(F.concat(F.lit(salt), F.col(key).cast("string")))
    return df.withColumn("__h", h).orderBy("__h", key).limit(n).drop("__h")


def crops(elements: DataFrame, min_side: int = 10) -> DataFrame:
    """Handwritten cells and text blocks with both sides over ``min_side``; each keeps its page's text."""
    kind = ((F.col("type") == "data_cell") & (F.col("region_type") == "handwritten")) | (F.col("type") == "text_block")
    return elements.where(kind & (F.col("x2") - F.col("x1") > min_side) & (F.col("y2") - F.col("y1") > min_side))


def exact_match(pred: Column, truth: Column) -> Column:
    return F.avg((strip(pred) == strip(truth)).cast("int"))


def rewrite_path(path: Column, old: str, new: str) -> Column:
    return F.replace(path, F.lit(old), F.lit(new))
