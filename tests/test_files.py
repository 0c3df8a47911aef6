"""Sources, sinks and the stream, over real files."""

import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from vestry.operators import corpus, images, layout, reading
from vestry.sources import files
from vestry.streaming import pages


def png(path, h, w, value=lambda x, y: (x * 3 % 256, y * 5 % 256, 7)):
    raw = b"".join(b"\0" + b"".join(bytes(value(x, y)) for x in range(w)) for y in range(h))

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("data")
    (d / "images").mkdir()
    (d / "texts").mkdir()
    for k in range(3):
        png(d / "images" / f"p{k}.png", 20, 30)
        (d / "texts" / f"p{k}.txt").write_text("текст " * k)
    (d / "images" / "bad.png").write_bytes(b"no image")
    return d


def test_images(spark, folder):
    df = files.images(spark, str(folder / "images"))
    assert df.count() == 3
    img = images.decode(df.first()["image"])
    assert img.shape == (20, 30, 3) and img[1, 2].tolist() == [7, 5, 6]  # blue, green, red
    out = images.preprocess_pages(df, skip=("resize",)).collect()
    steps = ["color_normalize", "illumination_normalize", "mild_denoise", "deskew_robust", "contrast(clip=2.0)", "border_removal(w=10)"]
    assert len(out) == 3 and out[0]["steps"] == steps
    plugged = images.preprocess_pages(df, backends={"denoise": lambda x: x[:, :25], "contrast": lambda x: x[:15]}, skip=("resize",)).first()
    assert (plugged["height"], plugged["width"]) == (15, 25)
    profiles = images.page_profiles(df)
    assert profiles.where("axis = 'row'").count() == 60
    assert layout.profile_segments(profiles.where("axis = 'row'"), 0.08, 15).count() >= 0


def test_uploads_are_filtered_in_the_scan(spark, folder):
    df = files.uploads(spark, str(folder / "images"))
    assert df.count() == 4
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length," in plan.partition("PushedFilters")[2] and "content" not in plan


def test_pairs_and_splits(spark, folder, tmp_path):
    pairs = corpus.pair(files.image_paths(spark, str(folder / "images")), files.texts(spark, str(folder / "texts")))
    assert {r["stem"] for r in pairs.collect()} == {"p1", "p2"}
    table = spark.range(100).withColumn("text", F.lit("x"))
    counts = {r["split"]: r["count"] for r in files.write_splits(corpus.split(table, "id"), str(tmp_path / "s")).collect()}
    assert counts == {"train": 80, "val": 10, "test": 10}
    assert files.jsonl(spark, str(tmp_path / "s/data"), "id long, text string").count() == 100


def test_results(spark, tmp_path):
    df = spark.createDataFrame([(f"{k:08x}", "f", "birth", True, 0.5) for k in range(30)], "request_id string, file string, record_type string, needs_review boolean, time double")
    files.write_results(df, str(tmp_path / "r"))
    store = files.read_results(spark, str(tmp_path / "r"))
    page = reading.list_results(store, 10, 5).collect()
    assert [r["request_id"] for r in page] == [f"{k:08x}" for k in range(24, 14, -1)] and page[0]["total"] == 30
    assert reading.delete_results(store, df.limit(3)).count() == 27
    with pytest.raises(ValueError):
        reading.list_results(store, 0)


def test_health(spark, tmp_path):
    rows = files.health(spark, {"a": str(tmp_path), "b": str(tmp_path / "none")}).collect()
    assert {r["status"] for r in rows} == {"degraded"} and [r["issue"] for r in rows] == [None, "b directory missing"]
    assert files.health(spark, {"a": str(tmp_path)}).first()["status"] == "healthy"


def test_result_files(spark, tmp_path):
    up, out = str(tmp_path / "up"), str(tmp_path / "out")
    rows = [(f"{k:04x}", f"page{k}.PNG" if k else "scan", bytes([k]) * 10, "birth", k / 2, True) for k in range(5)]
    df = spark.createDataFrame(rows, "request_id string, file string, content binary, record_type string, time double, needs_review boolean")
    assert [r["name"] for r in files.save_uploads(df, up).orderBy("name").collect()] == ["0000.jpg", "0001.PNG", "0002.PNG", "0003.PNG", "0004.PNG"]
    assert (tmp_path / "up/0002.PNG").read_bytes() == b"\2" * 10
    records = df.drop("content").withColumn("age", F.struct(F.lit(3).alias("age_years")))
    assert files.write_result_files(records, out, resolved=("age",)).count() == 5
    made = json.loads((tmp_path / "out/0003.json").read_text())
    assert made == {"request_id": "0003", "file": "page3.PNG", "processing_time_seconds": 1.5, "needs_review": True, "extracted_data": {"record_type": "birth"}, "resolved_data": {"age": {"age_years": 3}}}
    (tmp_path / "out/odd.json").write_text("no object")
    store = files.read_result_files(spark, out)
    listed = {r["request_id"]: r for r in reading.list_results(store).collect()}
    assert listed["0003"]["record_type"] == "birth" and listed["odd"]["record_type"] == "unknown" and listed["odd"]["total"] == 6
    ids = spark.createDataFrame([("0000",), ("0001",), ("none",)], "request_id string")
    assert {r["request_id"]: r["status"] for r in files.delete_result_files(ids, out, up).collect()} == {"0000": "deleted", "0001": "deleted", "none": "not found"}
    assert not (tmp_path / "up/0000.jpg").exists() and (tmp_path / "up/0002.PNG").exists() and len(list((tmp_path / "out").glob("*.json"))) == 4
    tries = spark.createDataFrame([(1, 0, True, "0002"), (1, 1, False, "none"), (2, 0, True, "0003")], "batch_id int, ord int, ok boolean, request_id string")
    files.roll_back(reading.batch_outcome(tries), tries, out, up).collect()
    assert not (tmp_path / "out/0002.json").exists() and (tmp_path / "out/0003.json").exists()
    with pytest.raises(Exception):
        files.write_files(spark.createDataFrame([("../x", b"")], "name string, content binary"), out).collect()


def test_image_sink(spark, folder, tmp_path):
    pages_ = images.preprocess_pages(files.images(spark, str(folder / "images")), skip=("resize", "mild_denoise"))
    named = pages_.withColumn("name", F.concat(files.stem(F.col("path")), F.lit(".png")))
    assert files.write_images(named, str(tmp_path / "png")).count() == 3
    back = {r["image"]["origin"].rsplit("/", 1)[-1]: images.decode(r["image"]) for r in files.images(spark, str(tmp_path / "png")).collect()}
    assert len(back) == 3
    for r in named.collect():
        assert (back[r["name"]].tobytes()) == bytes(r["data"])


def test_validation(spark):
    from vestry import schemas

    df = schemas.conform(spark.createDataFrame([(1, "birth"), (2, "feast")], "rec_id long, record_type string"))
    broken = df.withColumn("birth_date", F.struct(F.lit("x").alias("value"), F.lit(1.5).alias("confidence"))).withColumn("source_length", F.lit("many")).drop("language")
    good = {r["rec_id"]: r["problems"] for r in schemas.problems(df).collect()}
    assert good == {1: [], 2: ["record_type: unknown kind"]}
    bad = schemas.problems(broken).where("rec_id = 1").first()["problems"]
    assert sorted(p.split(":")[0] for p in bad) == ["birth_date", "language", "source_length"]


def test_providers(spark):
    from vestry.operators import assist

    answer = '{"record_type": "birth", "child_name": {"value": "Иван", "confidence": 0.9}}'
    df = spark.createDataFrame([(1, "текст"), (2, "")], "rec_id long, raw_text string")
    assist.register_provider("test", lambda p: answer)
    try:
        got = assist.extract_with_model(df, "rec_id", "raw_text", "test", "m").collect()
        assert [r["_extraction"].asDict() for r in got] == [{"method": "llm", "model": "m", "provider": "test", "source_length": n} for n in (5, 0)]
        assert got[0]["child_name"]["value"] == "Иван" and not got[0]["needs_review"]
        assist.register_provider("ollama", lambda p: 1 / 0)
        assert [(r["response"], r["provider"]) for r in assist.ask(df, "rec_id", "raw_text", "nobody").collect()] == [("", "ollama")] * 2
    finally:
        assist.PROVIDERS.clear()
    assert assist.provider_for("nobody")[0] == "ollama" and assist.provider_for("huggingface")[0] == "huggingface"


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, "12.III.1878 р. Иван"), (2, "1878-03-12 умер Яковъ"), (3, None)]
    spark.createDataFrame(rows, "rec_id long, raw_text string").write.parquet(str(tmp_path / "in"))
    pages.run_available(pages.stream_records(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c"))
    got = {r["rec_id"]: r["record_type"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: "birth", 2: "death", 3: "unknown"}


def test_pages_to_records(spark, tmp_path):
    from vestry import schemas
    from vestry.plans import pages as plan

    def lines(x, y):
        return (0, 0, 0) if y in range(60, 64) or y in range(140, 144) or y in range(220, 224) or x in range(100, 104) else (250, 250, 250)

    png(tmp_path / "t.png", 300, 260, lines)
    imgs = files.images(spark, str(tmp_path))
    rows, cols = plan.grid(imgs)
    assert [(r["start"], r["end"]) for r in rows.orderBy("start").collect()] == [(0, 62), (62, 142), (142, 222), (222, 300)]
    assert [(r["start"], r["end"]) for r in cols.orderBy("start").collect()] == [(0, 102), (102, 260)]
    kinds = [r["type"] for r in plan.elements(imgs).collect()]
    assert kinds.count("data_cell") == 8 and kinds.count("header_row") == 1
    read = plan.read_elements(imgs, plan.elements(imgs, 260), lambda crop: (str(crop.shape), 0.5), {})
    assert read.count() == len(kinds) and read.where("confidence <> 0.5").count() == 0
    quick = {"denoise": lambda x: x}
    pages_ = plan.process_pages(imgs, lambda crop: ("12.III.1878 р. Иван Петров ", 0.9), quick, skip=("resize", "deskew_robust"))
    page = pages_.first()
    assert page["page_type"] == "table" and page["steps"][0] == "color_normalize" and page["before"]["contrast"] > 0
    kinds = [e["type"] for e in page["elements"]]
    assert kinds.count("data_cell") == 8 and kinds.count("header_row") == 1 and kinds.count("table") == 1
    assert all((e["text"] is not None) == (e["type"] in ("data_cell", "header_row", "record_block")) for e in page["elements"])
    assert [e["position"] for e in page["elements"]] == list(range(len(kinds))) and plan.page_elements(pages_).count() == len(kinds)
    out = plan.pages_to_records(imgs, lambda crop: ("12.III.1878 р. Иван Петров ", 0.9), quick, skip=("resize", "deskew_robust"))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    facts = out.select("file", "image_size", "page_type", "num_elements", "quality_metrics.steps").first()
    assert facts[:4] == ("t.png", "260x300", "table", len(kinds)) and len(facts["steps"]) == 5
    r = out.withColumn("rec_id", F.lit(1)).first()
    assert r["record_type"] == "birth" and r["birth_date"]["value"] == "1878-03-12"
    assert schemas.conform(out.withColumn("rec_id", F.lit(1))).schema.simpleString() == schemas.RECORD.simpleString()
