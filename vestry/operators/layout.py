"""Page layout as relations: profiles, segments, cells, blocks, reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vestry import fixed


def profile_segments(profile: DataFrame, threshold: float, min_length: int, page: str = "page_id", i: str = "i", v: str = "v") -> DataFrame:
    """Maximal runs of values over the threshold, longer than ``min_length``: ``page, ord, start, end`` (half-open)."""
    above = profile.where(F.col(v) > threshold).select(page, F.col(i).alias("i"))
    runs = above.withColumn("island", F.col("i") - F.row_number().over(Window.partitionBy(page).orderBy("i")))
    out = (
        runs.groupBy(page, "island")
        .agg(F.min("i").cast("int").alias("start"), (F.max("i") + 1).cast("int").alias("end"))
        .where(F.col("end") - F.col("start") > min_length)
    )
    return out.select(page, (F.row_number().over(Window.partitionBy(page).orderBy("start")) - 1).alias("ord"), "start", "end")


def line_segments(profile: DataFrame, threshold: float, min_gap: int, size: int, page: str = "page_id", i: str = "i", v: str = "v") -> DataFrame:
    """Segments between the middles of lines, with one to the page's end.

    A line is a run longer than 2 that closes before the profile ends; a middle
    within ``min_gap`` of the one before makes no segment but moves the start.
    """
    last = profile.groupBy(page).agg((F.max(i) + 1).cast("int").alias("length"))
    lines = (
        profile_segments(profile, threshold, 2, page, i, v)
        .join(last, page)
        .where("end < length")
        .select(page, F.floor((F.col("start") + F.col("end")) / 2).cast("int").alias("pos"))
    )
    before = F.coalesce(F.lag("pos").over(Window.partitionBy(page).orderBy("pos")), F.lit(0))
    between = lines.select(page, before.alias("start"), F.col("pos").alias("end")).where(F.col("end") - F.col("start") > min_gap)
    tail = last.join(lines.groupBy(page).agg(F.max("pos").alias("p")), page, "left").select(
        page, F.coalesce("p", F.lit(0)).alias("start"), F.lit(size).alias("end")
    )
    out = between.unionByName(tail.where("start < end"))
    return out.select(page, (F.row_number().over(Window.partitionBy(page).orderBy("start")) - 1).alias("ord"), "start", "end")


def is_table_page(num_rows: Column, rows_height: Column, height: Column) -> Column:
    """At least two rows that cover a fifth of the page."""
    return (num_rows >= 2) & (F.when(height > 0, rows_height / height).otherwise(0.0) >= 0.2)


def table_confidence(rows: Column, cols: Column) -> Column:
    return (
        F.when((rows >= 5) & (cols >= 3), 0.9).when((rows >= 3) & (cols >= 2), 0.7).when((rows >= 2) & (cols >= 2), 0.5).otherwise(0.3)
    )


def cell_grid(rows: DataFrame, cols: DataFrame, page: str = "page_id") -> DataFrame:
    """Rows by columns of each page: ``page, row, col, x1, y1, x2, y2, is_header``; an equi-join on the page."""
    r = rows.select(page, F.col("ord").alias("row"), F.col("start").alias("y1"), F.col("end").alias("y2"))
    c = cols.select(page, F.col("ord").alias("col"), F.col("start").alias("x1"), F.col("end").alias("x2"))
    return (
        r.join(c, page)
        .where("y2 > y1 and x2 > x1")
        .withColumn("is_header", (F.col("row") == 0) | (F.col("col") == 0))
        .select(page, "row", "col", "x1", "y1", "x2", "y2", "is_header")
    )


def region_class(mean: Column, variance: Column, edges: Column) -> Column:
    """``empty``, ``handwritten`` or ``printed`` from pixel features; a null mean is a region without pixels."""
    return (
        F.when(mean.isNull() | (mean > 250), "empty")
        .when((variance > 300) & (edges > 0.08), "handwritten")
        .when(variance > 50, "printed")
        .otherwise("empty")
    )


def cell_confidence(mean: Column, kind: Column) -> Column:
    return F.when(mean > 250, 0.0).when(kind != "empty", 0.8).otherwise(0.3)


def record_blocks(rows: DataFrame, width: int, page: str = "page_id", change: int = 15) -> DataFrame:
    """A header row, then blocks of rows; a row whose height differs from the last by over ``change`` begins a block.

    Returns ``page, type, x1, y1, x2, y2, confidence, row_count``.
    """
    w = Window.partitionBy(page).orderBy("ord")
    height = F.col("end") - F.col("start")
    r = rows.withColumn("h", height).withColumn("before", F.lag("h").over(w)).withColumn("n", F.row_number().over(w))
    header = r.where("n = 1").select(
        page, F.lit("header_row").alias("type"), F.lit(0).alias("x1"), F.col("start").alias("y1"), F.lit(width).alias("x2"), F.col("end").alias("y2"), F.lit(0.9).alias("confidence"), F.lit(1).cast("long").alias("row_count")
    )
    breaks = F.when((F.col("before") > 0) & (F.abs(F.col("h") - F.col("before")) > change), 1).otherwise(0)
    block = r.where("n > 1").withColumn("block", F.sum(breaks).over(w))
    body = block.groupBy(page, "block").agg(F.min_by("start", "ord").alias("y1"), F.max_by("end", "ord").alias("y2"), F.count("*").alias("row_count"))
    return header.unionByName(
        body.select(page, F.lit("record_block").alias("type"), F.lit(0).alias("x1"), "y1", F.lit(width).alias("x2"), "y2", F.lit(0.8).alias("confidence"), "row_count")
    )


def block_record_type(header_density: Column) -> Column:
    return F.when(header_density > 0.05, "birth").otherwise("unknown")


def reading_order(elements: DataFrame, page: str = "page_id", ordinal: str = "ord") -> DataFrame:
    """Adds ``position``: top to bottom, left to right, ties in the order of detection."""
    w = Window.partitionBy(page).orderBy("y1", "x1", ordinal)
    return elements.withColumn("position", F.row_number().over(w) - 1)


def union_elements(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def layout_summary(elements: DataFrame, page: str = "page_id") -> DataFrame:
    """Counts by element type and by class of cell, and the kind of page."""
    def n(condition, name):
        return F.count_if(condition).alias(name)

    t, region = F.col("type"), F.col("region_type")
    cell = t == "data_cell"
    return elements.groupBy(page).agg(
        F.count("*").alias("num_elements"),
        n(t == "table", "tables"),
        n(cell, "cells"),
        n(t == "record_block", "record_blocks"),
        n(cell & (region == "handwritten"), "handwritten_cells"),
        n(cell & (region == "printed"), "printed_cells"),
        n(t == "text_block", "text_blocks"),
        n(t == "stamp", "stamps"),
        n(t == "marginal_note", "marginal_notes"),
        n(t == "page_number", "page_numbers"),
        n(t == "signature", "signatures"),
        F.when(F.count_if(t == "table") > 0, "table").otherwise("text").alias("page_type"),
    )


def region_of_element(kind: Column, region: Column) -> Column:
    """Which preprocessor an element's region asks for."""
    return (
        F.when((kind == "data_cell") & (region == "handwritten"), "handwritten")
        .when(kind == "data_cell", "data_cell")
        .when(kind.isin("text_block", "header_row"), "printed_text")
        .when(kind.isin("record_block", "data_row"), "table_cell")
        .otherwise("printed_text")
    )


def dispatch_region(region: Column) -> Column:
    """The preprocessor that serves a region type; unknown types are taken for print."""
    return (
        F.when(region.isin("header_row", "text_block"), "printed_text")
        .when(region == "record_block", "table_cell")
        .when(region.isin(*fixed.REGION_TYPES), region)
        .otherwise("printed_text")
    )


def readable(elements: DataFrame, width: int, height: int) -> DataFrame:
    """Elements whose text is read, clamped to the page; empty crops fall out."""
    x1, y1 = F.least(F.col("x1"), F.lit(width)), F.least(F.col("y1"), F.lit(height))
    x2, y2 = F.least(F.col("x2"), F.lit(width)), F.least(F.col("y2"), F.lit(height))
    return (
        elements.where(F.col("type").isin(*fixed.ELEMENT_TYPES_READ))
        .withColumns({"x1": x1, "y1": y1, "x2": x2, "y2": y2})
        .where("x2 > x1 and y2 > y1")
    )


def yolo_grid(boxes: DataFrame, width: int, page: str = "page_id", min_width: int = 20) -> tuple[DataFrame, DataFrame]:
    """Row and column segments from detected boxes ``page, ord, label, x1, y1, x2, y2``."""
    rows = boxes.where(F.col("label").isin("table", "record_block", "header_row", "data_row")).select(
        page, (F.row_number().over(Window.partitionBy(page).orderBy("y1", "ord")) - 1).alias("ord"), F.col("y1").alias("start"), F.col("y2").alias("end")
    )
    edges = boxes.where("label = 'data_cell'").select(page, F.explode(F.array("x1", "x2")).alias("x")).distinct()
    pairs = edges.select(page, F.col("x").alias("start"), F.lead("x").over(Window.partitionBy(page).orderBy("x")).alias("end"))
    cols = pairs.where(F.col("end") - F.col("start") > min_width)
    whole = boxes.select(page).distinct().join(cols.select(page).distinct(), page, "left_anti").select(page, F.lit(0).alias("start"), F.lit(width).alias("end"))
    cols = cols.unionByName(whole)
    cols = cols.select(page, (F.row_number().over(Window.partitionBy(page).orderBy("start")) - 1).alias("ord"), "start", "end")
    return rows, cols


# Filters on contours that a backend has found.


def text_block(area: Column, w: Column, h: Column) -> Column:
    aspect = F.when(h > 0, w / h).otherwise(0.0)
    return (area >= 500) & (aspect > 0.5) & (aspect < 10) & (h > 15)


def text_block_confidence(area: Column, page_area: Column) -> Column:
    return F.least(F.lit(0.8), area / page_area * 10)


def stamp(area: Column, perimeter: Column, w: Column, h: Column, page_area: Column) -> Column:
    round_ = circularity(area, perimeter)
    aspect = F.when(h > 0, w / h).otherwise(0.0)
    return (area >= 400) & (area <= page_area * 0.2) & ((round_ > 0.5) | ((aspect > 0.7) & (aspect < 1.3) & (w > 20)))


def circularity(area: Column, perimeter: Column) -> Column:
    return F.when(perimeter > 0, F.lit(4.0) * F.pi() * area / (perimeter * perimeter)).otherwise(0.0)


def stamp_confidence(area: Column, perimeter: Column) -> Column:
    return F.round(F.least(F.lit(0.9), circularity(area, perimeter) / 2 + 0.4), 2)


def page_number(density: Column, w: Column, h: Column) -> Column:
    return (density > 0.01) & (density < 0.1) & (w > 10) & (w < 100) & (h > 10) & (h < 50)


def signature(variance: Column, edges: Column, area: Column, w: Column, h: Column) -> Column:
    return (variance > 1000) & (edges > 0.15) & (w > 50) & (h > 15) & (area > 300)


def marginal_note(ink: Column, w: Column, h: Column, strict: bool = True) -> Column:
    """``ink`` is the share of dark pixels of the margin.

    The original divides that share by 255 before its test, which so never
    holds; ``strict=False`` tests the share itself.
    """
    density = ink / 255.0 if strict else ink
    return (density >= 0.05) & (h > 40) & (w > 20) & (h * w > 800)
