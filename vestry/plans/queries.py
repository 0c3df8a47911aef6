"""Queries of the library over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vestry import fixed
from vestry.functions import dates as D
from vestry.functions import extract as X
from vestry.functions import pagelayout, pixels
from vestry.functions import text as T
from vestry.operators import assist, corpus, images, layout, reading, records, resolve
from vestry.operators.cleanup import clean
from vestry.plans import fixtures as fx
from vestry.plans import pages as plan

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.build(spark, sf_dir, fx.METRICAL_TEXT)


def cleaned(spark, sf_dir):
    return clean(texts(spark, sf_dir))


def extracted(spark, sf_dir):
    return records.extract_records(cleaned(spark, sf_dir))


def _values(fields: list[str]) -> list:
    return [F.col(f)["value"].alias(f) for f in fields]


def _steps(spark, sf_dir, n: int) -> DataFrame:
    df = texts(spark, sf_dir)
    for _, step in T.STEPS[:n]:
        df = df.withColumn("raw_text", step(F.col("raw_text")))
    return df.select("rec_id", F.col("raw_text").alias("text"))


@query
def extraction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = extracted(spark, sf_dir)
    return df.groupBy("record_type").agg(
        F.count("*").alias("n"),
        F.round(F.avg("average_confidence"), 6).alias("mean_confidence"),
        F.sum(F.col("source_length").cast("long")).alias("chars"),
        F.count_if("needs_review").alias("n_review"),
    )


@query
def merge_hyphens(spark, sf_dir):
    return _steps(spark, sf_dir, 1)


@query
def expand_abbrev(spark, sf_dir):
    return _steps(spark, sf_dir, 2)


@query
def fix_ocr(spark, sf_dir):
    return _steps(spark, sf_dir, 3)


@query
def spell_correct(spark, sf_dir):
    return _steps(spark, sf_dir, 4)


@query
def normalize_dates(spark, sf_dir):
    return _steps(spark, sf_dir, 5)


@query
def cleanup_pipeline(spark, sf_dir):
    df = cleaned(spark, sf_dir)
    return df.select("rec_id", "corrected_text", "original_text", F.array_join("corrections_applied", ",").alias("corrections"))


@query
def wrap_documents(spark, sf_dir):
    t = T.wrap_lines(F.col("text"))
    df = fx.table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    return df.select("doc_id", F.md5("t").alias("wrapped_md5"), (1 + F.length("t") - F.length(F.replace("t", F.lit("\n")))).alias("n_lines"))


@query
def type_scores(spark, sf_dir):
    t = F.col("corrected_text")
    return cleaned(spark, sf_dir).select("rec_id", *[X.type_score(t, k).cast("int").alias(k) for k in X.TYPES])


@query
def type_argmax(spark, sf_dir):
    return extracted(spark, sf_dir).select("rec_id", "record_type")


@query
def extract_date(spark, sf_dir):
    return texts(spark, sf_dir).select("rec_id", X.extract_date(F.col("raw_text")).alias("found"))


@query
def name_after(spark, sf_dir):
    t = F.col("raw_text")
    return texts(spark, sf_dir).select("rec_id", *[X.name_after(t, k).alias(n) for n, k in (("father", "отец"), ("loose", "от"), ("groom", "жених"))])


def _records(kind):
    def run(spark, sf_dir):
        names = [n for n, _, _ in X.FIELDS[kind]] + (["age"] if kind == "death" else [])
        df = extracted(spark, sf_dir).where(F.col("record_type") == kind)
        return df.select("rec_id", *_values(names), "average_confidence", "source_length", "method", "language", "needs_review")

    run.__name__ = f"{kind}_records"
    return query(run)


birth_records, death_records, marriage_records = map(_records, X.TYPES)


@query
def empty_input(spark, sf_dir):
    # a third of the texts lose all but their blanks, the others their letters
    t = F.when(F.col("rec_id") % 3 == 0, F.regexp_replace("raw_text", "[^ ]", "")).otherwise(F.regexp_replace("raw_text", "[А-Яа-яЁё]", ""))
    df = records.extract_records(texts(spark, sf_dir).select("rec_id", t.alias("corrected_text")))
    return df.groupBy("method", "record_type", "source_length").agg(F.count("*").alias("n"))


def _answers(df: DataFrame) -> DataFrame:
    """Made-up answers for a third of the records: names for what the rules left unknown."""
    def field(f):
        made = F.struct(F.concat(F.lit("ответ "), F.lit(f)).alias("value"), F.lit(0.9).alias("confidence"))
        unknown = F.struct(F.lit("Unknown").alias("value"), F.lit(0.0).alias("confidence"))
        return F.when(F.col(f).isNull(), None).when(F.col("rec_id") % 2 == 0, made).otherwise(unknown).alias(f)

    return df.where("rec_id % 3 = 0").select("rec_id", *[field(f) for f in X.ALL_FIELDS])


@query
def llm_gate(spark, sf_dir):
    return extracted(spark, sf_dir).select("rec_id", "average_confidence", records.llm_gate(F.col("average_confidence"), threshold=0.4).alias("asks"))


@query
def llm_merge(spark, sf_dir):
    df = extracted(spark, sf_dir)
    return records.merge_answers(df, _answers(df), "rec_id").select("rec_id", *_values(X.ALL_FIELDS), "method", "llm_used", "average_confidence")


@query
def llm_prefer(spark, sf_dir):
    df = extracted(spark, sf_dir)
    return records.prefer_answers(df, _answers(df), "rec_id").select("rec_id", *_values(X.ALL_FIELDS), "method")


@query
def llm_prompt(spark, sf_dir):
    return texts(spark, sf_dir).select("rec_id", F.md5(assist.prompt(F.col("raw_text"))).alias("prompt_md5"))


@query
def llm_salvage(spark, sf_dir):
    fields = assist.salvage_fields(F.col("response"))
    return fx.build(spark, sf_dir, fx.ANSWERS_RAW).select("rec_id", *[c.alias(k) for k, c in fields.items()])


@query
def llm_salvage_full(spark, sf_dir):
    df = assist.parse_answers(fx.build(spark, sf_dir, fx.ANSWERS_RAW), "rec_id", "response")
    return df.select("rec_id", "record_type", "average", "needs_review", *_values(assist.ANSWER_FIELDS))


@query
def name_resolution(spark, sf_dir):
    names = texts(spark, sf_dir).select("rec_id", X.name_after(F.col("raw_text"), "отец").alias("name"))
    r = resolve.resolve_name(F.col("name"))
    return names.withColumn("r", r).select(
        "rec_id", "name", "r.canonical", "r.first_name", "r.last_name", "r.confidence", F.array_join("r.variants", "|").alias("variants")
    )


@query
def feast_resolution(spark, sf_dir):
    return fx.build(spark, sf_dir, fx.FEASTS).select("rec_id", F.col("given"), D.calendar_date(F.col("txt"), F.col("given")).alias("r")).select(
        "rec_id", "r.original", "r.resolved", "r.is_approximate", "r.confidence"
    )


@query
def easter_by_year(spark, sf_dir):
    years = fx.table(spark, sf_dir, "orders").select((F.year("o_orderdate") - 120).alias("y")).distinct()
    return years.select("y", D.orthodox_easter(F.col("y")).alias("easter"))


@query
def age_compute(spark, sf_dir):
    a = D.compute_age(F.col("birth"), F.col("death"), F.col("reference"))
    return fx.build(spark, sf_dir, fx.AGES).select("rec_id", a.alias("a")).select("rec_id", "a.*")


@query
def age_validate(spark, sf_dir):
    v = D.validate_age(F.col("written"), F.col("birth"), F.col("death"))
    return fx.build(spark, sf_dir, fx.AGES).select("rec_id", v.alias("v")).select("rec_id", "v.*")


@query
def resolve_records(spark, sf_dir):
    df = resolve.resolve_records(extracted(spark, sf_dir))
    names = [F.col(f"{f}_resolved")["canonical"].alias(f) for f in fixed.NAME_FIELDS]
    return df.select("rec_id", *names, *[F.col(f"{f}_resolved")["resolved"].alias(f) for f in ("birth_date", "death_date", "marriage_date")])


@query
def people_exploded(spark, sf_dir):
    return resolve.explode_people(extracted(spark, sf_dir)).select("rec_id", "role", "name", "surname", "record_type")


@query
def family_groups(spark, sf_dir):
    groups = resolve.family_groups(resolve.explode_people(extracted(spark, sf_dir)))
    first = F.element_at("members", 1)
    return groups.select("surname", "size", "first_seen", first["name"].alias("first_name"), first["role"].alias("first_role"))


@query
def family_sizes(spark, sf_dir):
    return resolve.group_sizes(resolve.explode_people(extracted(spark, sf_dir)))


@query
def relationships(spark, sf_dir):
    return resolve.relationships(resolve.explode_people(extracted(spark, sf_dir))).drop("surname")


@query
def kinship(spark, sf_dir):
    return resolve.relationships(fx.build(spark, sf_dir, fx.KIN)).drop("surname")


@query
def family_members(spark, sf_dir):
    return resolve.resolve_batch(extracted(spark, sf_dir), expand=False)["family_members"]


@query
def kin_classes(spark, sf_dir):
    return resolve.kin_classes(fx.build(spark, sf_dir, fx.KIN))


def _segments(spark, sf_dir):
    return fx.build(spark, sf_dir, fx.ROWS), fx.build(spark, sf_dir, fx.COLUMNS)


@query
def profile_segments(spark, sf_dir):
    return layout.profile_segments(fx.build(spark, sf_dir, fx.PROFILE), 1.0, 1, v="n")


@query
def line_positions(spark, sf_dir):
    return layout.line_segments(fx.build(spark, sf_dir, fx.PROFILE), 1.0, 15, 1440, v="n")


def _page_facts(spark, sf_dir):
    rows, cols = _segments(spark, sf_dir)
    r = rows.groupBy("page_id").agg(F.count("*").alias("n_rows"), F.sum(F.col("end") - F.col("start")).alias("rows_height"))
    return r.join(cols.groupBy("page_id").agg(F.count("*").alias("n_cols")), "page_id")


@query
def table_page_test(spark, sf_dir):
    return _page_facts(spark, sf_dir).select("page_id", layout.is_table_page(F.col("n_rows"), F.col("rows_height"), F.lit(1000)).alias("is_table"))


@query
def table_confidence(spark, sf_dir):
    return _page_facts(spark, sf_dir).select("page_id", layout.table_confidence(F.col("n_rows"), F.col("n_cols")).alias("confidence"))


@query
def cell_grid(spark, sf_dir):
    return layout.cell_grid(*_segments(spark, sf_dir))


@query
def record_blocks(spark, sf_dir):
    return layout.record_blocks(_segments(spark, sf_dir)[0], 2400)


@query
def block_types(spark, sf_dir):
    e = fx.build(spark, sf_dir, fx.ELEMENTS)
    return e.select("page_id", "ord", layout.block_record_type(F.col("edges")).alias("record_type"))


@query
def reading_order(spark, sf_dir):
    return layout.reading_order(fx.build(spark, sf_dir, fx.ELEMENTS)).select("page_id", "ord", "position")


def _classed(spark, sf_dir):
    e = fx.build(spark, sf_dir, fx.ELEMENTS)
    return e.withColumn("region_type", layout.region_class(F.col("mean"), F.col("variance"), F.col("edges")))


@query
def region_class(spark, sf_dir):
    return _classed(spark, sf_dir).select("page_id", "ord", "region_type", layout.cell_confidence(F.col("mean"), F.col("region_type")).alias("confidence"))


@query
def layout_summary(spark, sf_dir):
    e = _classed(spark, sf_dir)
    return layout.layout_summary(layout.union_elements(e.where("type <> 'table'"), e.where("type = 'table'").drop("region_type")))


@query
def region_dispatch(spark, sf_dir):
    region = layout.region_of_element(F.col("type"), F.col("region_type"))
    return _classed(spark, sf_dir).select("page_id", "ord", region.alias("region"), layout.dispatch_region(F.col("type")).alias("by_type"))


@query
def readable_elements(spark, sf_dir):
    return layout.readable(fx.build(spark, sf_dir, fx.ELEMENTS), 1200, 1500).select("page_id", "ord", "type", "x1", "y1", "x2", "y2")


@query
def contour_filters(spark, sf_dir):
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    area, per, page = F.col("area"), F.col("perimeter"), F.lit(100000.0)
    return fx.build(spark, sf_dir, fx.ELEMENTS).select(
        "page_id",
        "ord",
        layout.text_block(area, w, h).alias("text_block"),
        layout.text_block_confidence(area, page).alias("text_confidence"),
        layout.stamp(area, per, w, h, page).alias("stamp"),
        layout.stamp_confidence(area, per).alias("stamp_confidence"),
        layout.page_number(F.col("edges"), w, h).alias("page_number"),
        layout.signature(F.col("variance") * 3, F.col("edges") * 2, area, w, h).alias("signature"),
        layout.marginal_note(F.col("edges"), w, h).alias("note"),
        layout.marginal_note(F.col("edges"), w, h, strict=False).alias("note_intended"),
    )


def _yolo(k, spark, sf_dir):
    return layout.yolo_grid(fx.build(spark, sf_dir, fx.BOXES), 800)[k]


@query
def yolo_rows(spark, sf_dir):
    return _yolo(0, spark, sf_dir)


@query
def yolo_columns(spark, sf_dir):
    return _yolo(1, spark, sf_dir)


def _read(spark, sf_dir):
    def engine(text, confidence, name):
        return F.struct(text.alias("text"), confidence.alias("confidence"), F.lit(name).alias("model_used"))

    df = fx.build(spark, sf_dir, fx.OCR)
    third = F.when(F.col("t3") != "", 0.5).otherwise(0.0)
    one, two, three = engine(F.col("t1"), F.lit(0.8), "trocr"), engine(F.col("t2"), F.col("c2"), "easyocr"), engine(F.col("t3"), third, "tesseract")
    return df.withColumn("r", reading.cascade(one, two, three)).withColumn("v", reading.cascade(one, two, three, voting=True))


@query
def ocr_cascade(spark, sf_dir):
    return _read(spark, sf_dir).select("page_id", "position", "r.text", "r.confidence", "r.model_used", F.col("v")["model_used"].alias("voted"))


@query
def ocr_blocks(spark, sf_dir):
    df = fx.build(spark, sf_dir, fx.OCR).select("page_id", F.col("position").alias("ord"), F.col("t2").alias("text"), F.col("c2").alias("confidence"))
    return reading.mean_blocks(df, "page_id")


@query
def page_text(spark, sf_dir):
    return reading.page_text(_read(spark, sf_dir).select("page_id", "position", "r.text"))


@query
def upload_filter(spark, sf_dir):
    df = fx.build(spark, sf_dir, fx.UPLOADS)
    return df.where(reading.valid_upload(F.col("name"), F.col("size")))


@query
def results_page(spark, sf_dir):
    return reading.list_results(fx.build(spark, sf_dir, fx.RESULTS), limit=50, offset=20)


@query
def result_get(spark, sf_dir):
    return reading.get_result(fx.build(spark, sf_dir, fx.RESULTS), "c4ca4238")


@query
def result_delete(spark, sf_dir):
    df = fx.build(spark, sf_dir, fx.RESULTS)
    return reading.delete_results(df, df.where("record_type = 'birth'"))


@query
def batch_rollback(spark, sf_dir):
    return reading.batch_outcome(fx.build(spark, sf_dir, fx.BATCHES))


def _pairs(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select(F.concat(F.lit("s"), F.col("doc_id")).alias("stem"), "text")
    imgs = fx.table(spark, sf_dir, "labels").select(
        F.concat(F.lit("s"), F.col("doc_id")).alias("stem"), F.concat(F.lit("data/images/s"), F.col("doc_id"), F.lit(".png")).alias("image_path")
    )
    return corpus.pair(imgs, docs)


@query
def pair_scan(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query
def split_dataset(spark, sf_dir):
    return corpus.split(fx.table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("doc_id", "split")


@query
def split_counts(spark, sf_dir):
    return split_dataset(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n"))


@query
def sample_limit(spark, sf_dir):
    return corpus.sample(fx.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100)


@query
def crop_filter(spark, sf_dir):
    return corpus.crops(_classed(spark, sf_dir)).select("page_id", "ord", "type", "x1", "y1", "x2", "y2")


@query
def exact_match(spark, sf_dir):
    df = fx.build(spark, sf_dir, fx.OCR)
    return df.agg(F.round(corpus.exact_match(F.col("t2"), F.col("t3")), 6).alias("accuracy"), F.count("*").alias("n"))


@query
def path_rewrite(spark, sf_dir):
    return _pairs(spark, sf_dir).select("stem", corpus.rewrite_path(F.col("image_path"), "data/images/", "/mnt/").alias("image_path"))


@query
def gray_world(spark, sf_dir):
    return images.pixel_gray_world(fx.build(spark, sf_dir, fx.PIXELS))


@query
def border_removal(spark, sf_dir):
    return images.pixel_border(fx.build(spark, sf_dir, fx.PIXELS), 25, 20, 3)


@query
def quality_metrics(spark, sf_dir):
    return images.pixel_quality(fx.build(spark, sf_dir, fx.PIXELS), 25, 20)


@query
def resize_dims(spark, sf_dir):
    df = fx.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 4000 + 100).alias("w"), (F.col("p_size") * 90 + 50).alias("h"))
    size = images.target_size(F.col("h"), F.col("w"))
    return df.select("p_partkey", size["width"].alias("new_w"), size["height"].alias("new_h"))


@query
def deskew_median(spark, sf_dir):
    lines = fx.build(spark, sf_dir, fx.ELEMENTS).select("page_id", (F.col("edges") * 100 - 5).alias("angle"), F.col("area").alias("length"), F.lit(3000).alias("side"))
    return images.page_skew(lines).select("page_id", F.round("angle", 6).alias("angle"), "rotate")


_IMAGE = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"


def _drawn(keys: DataFrame, key: str, draw) -> DataFrame:
    """One page image per key, as the ``image`` source gives them; ``draw`` makes a BGR array of a key."""
    import pyarrow as pa

    kind = pa.struct([("origin", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("nChannels", pa.int32()), ("mode", pa.int32()), ("data", pa.binary())])

    def run(batches):
        for b in batches:
            for k in b.column("k").to_pylist():
                img = draw(k)
                row = {"origin": f"page{k}", "height": img.shape[0], "width": img.shape[1], "nChannels": 3, "mode": 16, "data": img.tobytes()}
                yield pa.RecordBatch.from_pydict({"image": [row]}, schema=pa.schema([("image", kind)]))

    # a small table is one split, pages are much work
    dealt = keys.select(F.col(key).alias("k")).repartition(2 * keys.sparkSession.sparkContext.defaultParallelism)
    return dealt.mapInArrow(run, f"image {_IMAGE}")


def _noisy(k: int):
    """A small page of slanted waves and a ruled line, some larger than others."""
    import numpy as np

    h, w = (30, 40) if k % 3 else (66, 90)
    y, x = np.mgrid[:h, :w]
    img = np.stack([(x * 5 + y * c + k) % 256 for c in (3, 7, 11)], axis=-1).astype(np.uint8)
    img[h // 2 + (x[0] * (k % 4)) // w, x[0]] = 0
    return img


@query
def image_pipeline(spark, sf_dir):
    """All seven steps of stage one over real pixel arrays, one small page per supplier."""
    pages = _drawn(fx.table(spark, sf_dir, "supplier"), "s_suppkey", _noisy)
    done = images.preprocess_pages(pages, min_side=60, max_side=80, border=2)
    return done.select("path", "height", "width", "before.contrast", F.col("after")["contrast"].alias("contrast_after"), F.array_join("steps", ",").alias("steps"))


def _ruled(k: int):
    """A page with ruled lines whose places follow from its number, and a red stamp in its lower right."""
    import numpy as np

    img = np.full((320, 280, 3), 250, np.uint8)
    for y in (60 + k % 7, 130 + k % 11, 200 + k % 13):
        img[y : y + 4] = 0
    x = 100 + k % 17
    img[:, x : x + 4] = 0
    img[250:290, 200:240] = (30, 30, 200)
    return img


@query
def page_layout(spark, sf_dir):
    """Layout of drawn pages: the table, its cells and the stamp."""
    pages = _drawn(fx.table(spark, sf_dir, "supplier"), "s_suppkey", _ruled)
    skip = ("resize", "color_normalize", "illumination_normalize", "mild_denoise", "deskew_robust", "contrast", "border_removal")
    found = plan.page_elements(plan.process_pages(pages, lambda crop: ("", 0.0), {}, skip=skip))
    kept = found.where(F.col("type").isin("table", "data_cell", "stamp"))
    return kept.select("page_id", "type", "x1", "y1", "x2", "y2", F.col("properties")["row"].alias("row"), F.col("properties")["col"].alias("col"))


@query
def region_steps(spark, sf_dir):
    """Every region preprocessor over drawn crops: size, least, greatest and mean value of what comes out."""
    import pyarrow as pa

    kinds = sorted(images.REGION_STEPS)

    def run(batches):
        for row in images.rows_of(batches):
            img = images.decode(row["image"])
            for kind in kinds:
                out = images.preprocess_region(img, kind, {})
                facts = [row["image"]["origin"], kind, *out.shape[:2], int(out.min()), int(out.max()), round(float(out.mean()), 1)]
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in facts], names=["path", "region", "height", "width", "least", "most", "mean"])

    pages = _drawn(fx.table(spark, sf_dir, "supplier"), "s_suppkey", _noisy)
    return pages.mapInArrow(run, "path string, region string, height long, width long, least long, most long, mean double")


def _found_on(spark, sf_dir, draw, find) -> DataFrame:
    """What a detector finds on drawn pages, one page per supplier: ``page_id, type, x1, y1, x2, y2, note``."""
    import pyarrow as pa

    fields = pa.schema([("page_id", pa.string()), ("type", pa.string()), *[(c, pa.int32()) for c in ("x1", "y1", "x2", "y2")], ("note", pa.string())])

    def run(batches):
        for row in images.rows_of(batches):
            found = [(row["image"]["origin"], e.type, *e.box, note) for e, note in find(images.decode(row["image"]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*found)) or [()] * 7, fields)], schema=fields)

    pages = _drawn(fx.table(spark, sf_dir, "supplier"), "s_suppkey", draw)
    return pages.mapInArrow(run, "page_id string, type string, x1 int, y1 int, x2 int, y2 int, note string")


def _blank(h: int, w: int, boxes):
    """A white page with filled boxes ``x, y, w, h, color``."""
    import numpy as np

    img = np.full((h, w, 3), 255, np.uint8)
    for x, y, bw, bh, color in boxes:
        img[y : y + bh, x : x + bw] = color
    return img


@query
def text_blocks(spark, sf_dir):
    """Paragraphs on drawn pages without a table, with the area and shape of their outer contours."""
    def draw(k):
        return _blank(300, 400, [(40 + k % 9, 30, 120 + k % 13, 40, 60), (60, 120, 200, 60 + k % 7, 60), (30, 230, 250, 30, 60)])

    def find(img):
        return [(e, f"{e.properties['area']} {e.properties['aspect_ratio']}") for e in pagelayout.text_blocks(pixels.gray(img))]

    return _found_on(spark, sf_dir, draw, find)


@query
def page_marks(spark, sf_dir):
    """Page numbers, marginal notes and stamps on drawn pages."""
    def draw(k):
        boxes = [(300 + k % 50, 8 + k % 5, 30 + k % 20, 20, 0), (5, 200 + k % 30, 22, 60 + k % 40, 50)]
        size, blue = 40 + k % 15, 30 + k % 10
        return _blank(600, 800, [*boxes, (500 + k % 40, 300 + k % 30, size, size, (30, 30, 200)), (600, 450, blue, blue, (200, 40, 20))])

    def find(img):
        g = pixels.gray(img)
        marks = pagelayout.page_numbers(g) + pagelayout.marginal_notes(g, strict=False) + pagelayout.stamps(img)
        return [(e, e.properties.get("region") or e.properties.get("color")) for e in marks]

    return _found_on(spark, sf_dir, draw, find)


@query
def fallback_grid(spark, sf_dir):
    """Rows and columns of drawn pages that have lines of text but no ruled lines."""
    def draw(k):
        return _blank(320, 400, [(x, 20 + k % 8 + 40 * i, 1, 12, 0) for i in range(7) for x in range(30, 370, 3)])

    def find(img):
        grid = pagelayout.any_grid(pixels.gray(img))
        rows = [(pagelayout.Element("row", (0, a, 0, b), 1.0, ""), None) for a, b in grid.rows]
        return rows + [(pagelayout.Element("column", (a, 0, b, 0), 1.0, ""), None) for a, b in grid.cols]

    return _found_on(spark, sf_dir, draw, find)
