"""From page images to records: layout, reading, cleanup, extraction, resolution."""

from __future__ import annotations

import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vestry.config import DEFAULT
from vestry.fixed import ELEMENT_TYPES_READ
from vestry.functions import pagelayout
from vestry.functions import pixels as P
from vestry.operators import images as I
from vestry.operators import layout, ocr, reading, records, resolve
from vestry.operators.cleanup import clean


def text_to_records(df: DataFrame, text_col: str = "raw_text") -> DataFrame:
    """Cleaned, extracted and resolved records of a table of texts; no shuffle."""
    return resolve.resolve_records(records.extract_records(clean(df, text_col)))


def grid(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Row and column segments of pages, from long lines in the raw gray image.

    Too few runs of line rows mean that the lines themselves are thin: then
    the segments between the lines' middles count.
    """
    profiles = I.page_profiles(images)
    out = []
    for axis, threshold, least, enough in (("row", 0.08, 15, 3), ("col", 0.05, 30, 2)):
        p = profiles.where(F.col("axis") == axis).drop("axis")
        found = layout.profile_segments(p, threshold, least)
        full = found.groupBy("page_id").agg(F.count("*").alias("n")).where(F.col("n") >= enough).select("page_id")
        size = p.groupBy("page_id").agg((F.max("i") + 1).alias("size"))
        # a line is what fills over a quarter of its row or column
        between = layout.line_segments(p, 0.25, least, 1 << 30, v="share")
        between = between.join(size, "page_id").withColumn("end", F.least("end", "size")).where("start < end").drop("size")
        out.append(found.join(full, "page_id").unionByName(between.join(full, "page_id", "left_anti")))
    return out[0], out[1]


def elements(images: DataFrame, width: int = 1 << 20) -> DataFrame:
    """Cells, header rows and record blocks of the pages' grids in reading order."""
    rows, cols = grid(images)
    cells = layout.cell_grid(rows, cols).select(
        "page_id", F.lit("data_cell").alias("type"), "x1", "y1", "x2", "y2", (F.col("row") * 10_000 + F.col("col")).alias("ord")
    )
    blocks = layout.record_blocks(rows, width).select("page_id", "type", "x1", "y1", "x2", "y2", (F.lit(1 << 30) + F.col("y1")).alias("ord"))
    return layout.reading_order(layout.union_elements(cells, blocks))


def read_elements(images: DataFrame, found: DataFrame, engine: Callable, backends: dict | None = None) -> DataFrame:
    """Texts of the elements that are read: ``page_id, position, text, confidence``.

    Elements travel to their page's image as one array, so an image is decoded
    once.  ``engine`` takes a crop and returns text and confidence.
    """
    e = found.where(F.col("type").isin(*ELEMENT_TYPES_READ))
    region = F.col("region_type") if "region_type" in found.columns else F.lit(None).cast("string")
    box = F.struct("position", layout.region_of_element(F.col("type"), region).alias("region"), "x1", "y1", "x2", "y2")
    boxes = e.groupBy("page_id").agg(F.collect_list(box).alias("boxes"))
    pages = images.select(F.col("image.origin").alias("page_id"), "image").join(boxes, "page_id")

    def run(batches):
        for row in I.rows_of(batches):
            img, out = I.decode(row["image"]), []
            for b in row["boxes"] if img is not None else ():
                crop = img[b["y1"] : b["y2"], b["x1"] : b["x2"]]
                if crop.size:
                    text, confidence = engine(I.preprocess_region(crop, b["region"], backends))
                    out.append((row["page_id"], b["position"], text, confidence))
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.float64()))], names=["page_id", "position", "text", "confidence"]
            )

    return pages.mapInArrow(run, "page_id string, position int, text string, confidence double")


ELEMENT = (
    "struct<position:int,type:string,x1:int,y1:int,x2:int,y2:int,confidence:double,source:string,region_type:string,"
    "properties:map<string,string>,text:string,read_confidence:double>"
)
_METRICS = "struct<contrast:double,sharpness:double,entropy:double>"
PAGE = (
    f"path string, height int, width int, before {_METRICS}, after {_METRICS}, steps array<string>, page_type string, "
    f"elements array<{ELEMENT}>, seconds double"
)


def process_pages(
    images: DataFrame,
    engine: Callable | None = None,
    backends: dict | None = None,
    skip: tuple[str, ...] = (),
    scale_raw: bool = False,
    strict_notes: bool = True,
    voting: bool = False,
) -> DataFrame:
    """One row per page image: size, quality before and after stage one, kind of page, elements in reading order with texts.

    A page is decoded once and stays in its task: stage one, layout, crops,
    their preprocessing and reading; no pixel is shuffled.  ``engine`` takes a
    crop and returns text and confidence; without one the registered engines
    are tried in turn.  The grid comes from the raw page, which is scaled only
    if it is too large: a page that stage one makes larger or turns keeps the
    raw grid's coordinates, unless ``scale_raw`` brings the raw page to the same
    size.
    """
    plugged = dict(I.BACKENDS if backends is None else backends)
    read = engine or ocr.registered(plugged, voting)
    arrow = to_arrow_schema(T._parse_datatype_string(PAGE))

    def run(batches):
        for row in I.rows_of(batches):
            img = I.decode(row["image"])
            if img is None:
                continue
            began = time.perf_counter()
            done, steps = I.preprocess(img, skip=frozenset(skip), backends=plugged)
            raw = P.gray(img)
            h, w = raw.shape
            if scale_raw:
                raw = P.bilinear(raw, *done.shape[:2])
            elif max(h, w) > DEFAULT.max_side:
                raw = P.bilinear(raw, *P.target_size(h, w, 1))
            kind, found = pagelayout.analyze(done, raw, plugged.get("yolo"), strict_notes)
            elements = []
            for k, e in enumerate(found):
                x1, y1, x2, y2 = e.box
                text = confidence = None
                if e.type in ELEMENT_TYPES_READ and (crop := done[y1:y2, x1:x2]).size:
                    text, confidence = read(I.preprocess_region(crop, pagelayout.crop_kind(e), plugged))
                elements.append(
                    {"position": k, "type": e.type, "x1": x1, "y1": y1, "x2": x2, "y2": y2, "confidence": float(e.confidence), "source": e.source}
                    | {"region_type": e.region_type, "properties": list(e.properties.items()), "text": text, "read_confidence": confidence}
                )
            page = {"path": row["image"]["origin"], "height": h, "width": w, "before": P.quality(img), "after": P.quality(done), "steps": steps}
            page |= {"page_type": kind, "elements": elements, "seconds": round(time.perf_counter() - began, 2)}
            yield pa.RecordBatch.from_pylist([page], schema=arrow)

    return images.select("image").mapInArrow(run, PAGE)


def pages_to_records(images: DataFrame, engine: Callable | None = None, backends: dict | None = None, **parameters) -> DataFrame:
    """The whole way, without a shuffle: a record per page, with the facts that a result of a page has.

    ``request_id`` is made of the path, so a page that is done again has the same.
    """
    pages = process_pages(images, engine, backends, **parameters)
    texts = F.filter(F.transform("elements", lambda e: e["text"]), lambda t: t.isNotNull() & (F.regexp_replace(t, r"(?U)\s", "") != ""))
    facts = pages.select(
        F.substring(F.sha2("path", 256), 1, 16).alias("request_id"),
        F.element_at(F.split("path", "/"), -1).alias("file"),
        F.col("seconds").alias("time"),
        F.concat_ws("x", "width", "height").alias("image_size"),
        F.struct("before", "after", "steps").alias("quality_metrics"),
        "page_type",
        F.size("elements").alias("num_elements"),
        F.array_join(texts, "\n").alias("raw_text"),
    )
    return text_to_records(facts.withColumn("raw_text_preview", F.substring("raw_text", 1, 500)))


def page_elements(pages: DataFrame) -> DataFrame:
    """The elements of :func:`process_pages` as rows ``page_id, position, type, ...``."""
    return pages.select(F.col("path").alias("page_id"), F.inline("elements"))


def ink(crop) -> float:
    """Share of dark pixels, a stand-in for an engine's look at a crop."""
    return P.ink_share(P.gray(crop))
