"""Files in and out: page images, texts, training pairs, results."""

from __future__ import annotations

import posixpath
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vestry.config import DEFAULT


def stem(path) :
    """A file's name without folder and last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded pages (``image`` struct in BGR order) that could be read."""
    return spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path)


def uploads(spark: SparkSession, path: str, max_bytes: int = DEFAULT.max_file_bytes) -> DataFrame:
    """Names and sizes of valid files; contents aren't read, and the size is tested in the scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    allowed = F.lower(F.col("path")).rlike("(" + "|".join(e.replace(".", r"\.") for e in DEFAULT.extensions) + ")$")
    return files.where((F.col("length") <= max_bytes) & allowed)


def texts(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path)
    return df.select(stem(F.col("_metadata.file_path")).alias("stem"), F.col("value").alias("text"))


def image_paths(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    return df.where(F.col("path").rlike(r"\.(jpg|png)$")).select(stem(F.col("path")).alias("stem"), F.col("path").alias("image_path"))


def jsonl(spark: SparkSession, path: str, schema: str = "image_path string, text string, original_path string") -> DataFrame:
    """One object a line; blank lines are passed over."""
    return spark.read.schema(schema).json(path)


def write_splits(df: DataFrame, path: str) -> DataFrame:
    """JSON lines by split, and the counts that describe the set."""
    df.write.mode("overwrite").partitionBy("split").json(f"{path}/data")
    counts = df.groupBy("split").count()
    counts.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")
    return counts


def write_results(df: DataFrame, path: str, mode: str = "append") -> None:
    """The result store as a table: Parquet by record type."""
    df.write.mode(mode).partitionBy("record_type").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# Single files, written and deleted by the tasks that hold them.


def _file_system(folder: str):
    """The file system of a folder that all machines see, by its address, and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("/") else f"/{folder}")


def write_files(df: DataFrame, folder: str, name: str = "name", content: str = "content") -> DataFrame:
    """Writes one file per row; returns ``name, path, length`` of what was written.

    A file is written beside its place and then moved there, so a task that is
    tried again leaves the same files.  Names with a path are refused.  The
    files are written when the result is used, so use it once.
    """

    def run(batches):
        system, base = _file_system(folder)
        system.create_dir(base, recursive=True)
        for batch in batches:
            names, sizes = [], []
            for k in range(batch.num_rows):
                n, body = batch.column("name")[k].as_py(), batch.column("content")[k].as_py()
                if not n or posixpath.basename(n) != n:
                    raise ValueError(f"not a file's name: {n!r}")
                with system.open_output_stream(f"{base}/.{n}.part") as out:
                    out.write(body or b"")
                system.move(f"{base}/.{n}.part", f"{base}/{n}")
                names.append(n)
                sizes.append(len(body or b""))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([f"{folder.rstrip('/')}/{n}" for n in names], pa.string()), pa.array(sizes, pa.int64())],
                names=["name", "path", "length"],
            )

    rows = df.select(F.col(name).alias("name"), F.col(content).cast("binary").alias("content"))
    return rows.mapInArrow(run, "name string, path string, length long")


def delete_files(df: DataFrame, folder: str, name: str = "name") -> DataFrame:
    """Deletes the files named, ``name, deleted``; one that isn't there counts as not deleted."""

    def run(batches):
        system, base = _file_system(folder)
        for batch in batches:
            done = []
            for n in batch.column("name").to_pylist():
                try:
                    system.delete_file(f"{base}/{n}")
                    done.append(True)
                except FileNotFoundError:
                    done.append(False)
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(done, pa.bool_())], names=["name", "deleted"])

    return df.select(F.col(name).alias("name")).mapInArrow(run, "name string, deleted boolean")


def _extension(file):
    return F.coalesce(F.nullif(F.regexp_extract(file, r"[^/](\.[^./]*)$", 1), F.lit("")), F.lit(".jpg"))


def save_uploads(df: DataFrame, folder: str, request_id: str = "request_id", file: str = "file", content: str = "content") -> DataFrame:
    """Keeps uploaded bytes as ``<request id><extension>``; a name without an extension gets ``.jpg``."""
    return write_files(df.select(F.concat(F.col(request_id), _extension(F.col(file))).alias("name"), F.col(content).alias("content")), folder)


#: The envelope of a result: what it is called in the file, and the column that holds it.
ENVELOPE = {
    "request_id": "request_id", "file": "file", "processing_time_seconds": "time", "image_size": "image_size", "quality_metrics": "quality_metrics",
    "page_type": "page_type", "num_elements": "num_elements", "raw_text_preview": "raw_text_preview", "needs_review": "needs_review",
}


def envelopes(records: DataFrame, resolved: tuple[str, ...] = ()) -> DataFrame:
    """``request_id, json``: a result as one JSON object.

    The facts of the page stand at the top, the columns named by ``resolved``
    under ``resolved_data`` and all others under ``extracted_data``; facts that
    the table lacks are left out.
    """
    top = {k: c for k, c in ENVELOPE.items() if c in records.columns}
    rest = [c for c in records.columns if c not in top.values()]
    parts = [F.col(c).alias(k) for k, c in top.items()]
    parts.append(F.struct(*[F.col(c) for c in rest if c not in resolved]).alias("extracted_data"))
    if resolved:
        parts.append(F.struct(*resolved).alias("resolved_data"))
    return records.select("request_id", F.to_json(F.struct(*parts)).alias("json"))


def write_result_files(records: DataFrame, folder: str, resolved: tuple[str, ...] = ()) -> DataFrame:
    """One ``<request id>.json`` per record."""
    e = envelopes(records, resolved)
    return write_files(e.select(F.concat("request_id", F.lit(".json")).alias("name"), F.col("json").alias("content")), folder)


def read_result_files(spark: SparkSession, folder: str) -> DataFrame:
    """The results of a folder as :func:`vestry.operators.reading.list_results` takes them, with the whole object as ``json``.

    A file that isn't an object keeps its name as id and gets the defaults of a list.
    """
    df = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(folder)
    at = lambda p: F.get_json_object("value", p)
    return df.select(
        F.coalesce(at("$.request_id"), stem(F.col("_metadata.file_path"))).alias("request_id"),
        at("$.file").alias("file"),
        at("$.extracted_data.record_type").alias("record_type"),
        at("$.needs_review").cast("boolean").alias("needs_review"),
        at("$.processing_time_seconds").cast("double").alias("time"),
        F.col("value").alias("json"),
    )


def delete_result_files(ids: DataFrame, results: str, uploads: str | None = None, request_id: str = "request_id") -> DataFrame:
    """Deletes results and the uploads they were made of: ``request_id, status``, ``deleted`` or ``not found``.

    An upload is looked for only where the result is there.
    """
    one = ids.select(F.col(request_id).alias("request_id")).distinct()
    endings = list(DEFAULT.extensions)

    def run(batches):
        system, base = _file_system(results)
        for batch in batches:
            status = []
            for i in batch.column("request_id").to_pylist():
                if system.get_file_info(f"{base}/{i}.json").is_file:
                    if uploads:
                        store, folder = _file_system(uploads)
                        there = [p for e in endings if store.get_file_info(p := f"{folder}/{i}{e}").is_file]
                        for p in there[:1]:
                            store.delete_file(p)
                    system.delete_file(f"{base}/{i}.json")
                    status.append("deleted")
                else:
                    status.append("not found")
            yield pa.RecordBatch.from_arrays([batch.column("request_id"), pa.array(status, pa.string())], names=["request_id", "status"])

    return one.mapInArrow(run, "request_id string, status string")


def roll_back(outcome: DataFrame, files: DataFrame, results: str, uploads: str, batch: str = "batch_id") -> DataFrame:
    """Deletes what failed batches have written: all their results and uploads.

    ``outcome`` is that of :func:`vestry.operators.reading.batch_outcome`,
    ``files`` has ``request_id`` and the batch of each.
    """
    failed = outcome.where("rollback").select(batch)
    return delete_result_files(files.join(failed, batch, "left_semi"), results, uploads)


def png(img: np.ndarray) -> bytes:
    """An image (gray, or BGR) as a PNG file."""
    h, w = img.shape[:2]
    body = img if img.ndim == 2 else img[..., ::-1]
    raw = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(body).reshape(h, -1)], axis=1).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, 8, 0 if img.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def as_png(df: DataFrame, name: str = "name") -> DataFrame:
    """``name, content``: pixels (``height, width, nChannels, data``) as PNG files."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                h, w, c, data = (batch.column(x)[k].as_py() for x in ("height", "width", "nChannels", "data"))
                x = np.frombuffer(data, np.uint8).reshape(h, w, c)
                body = png(x[..., 0] if c == 1 else x[..., :3])
                yield pa.RecordBatch.from_arrays([batch.column("name").slice(k, 1), pa.array([body], pa.binary())], names=["name", "content"])

    return df.select(F.col(name).alias("name"), "height", "width", "nChannels", "data").mapInArrow(run, "name string, content binary")


def write_images(df: DataFrame, folder: str, name: str = "name") -> DataFrame:
    """One PNG per row of pixels, as :func:`vestry.operators.images.preprocess_pages` makes them."""
    return write_files(as_png(df, name), folder)


def health(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """Which folders exist and can be written to; ``healthy`` if all can.

    Whether a folder can be written to is what its file system says of this user.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    write = jvm.org.apache.hadoop.fs.permission.FsAction.WRITE
    rows = []
    for name, folder in folders.items():
        p = jvm.org.apache.hadoop.fs.Path(folder)
        system = p.getFileSystem(conf)
        present = system.exists(p)
        writable = present
        if present:
            try:
                system.access(p, write)
            except Exception:  # noqa: BLE001  refused
                writable = False
        issue = None if writable else f"{name} directory " + ("not writable" if present else "missing")
        rows.append((name, present, writable, issue))
    df = spark.createDataFrame(rows, "name string, present boolean, writable boolean, issue string")
    return df.withColumn("status", F.when(F.lit(all(r[2] for r in rows)), "healthy").otherwise("degraded"))
