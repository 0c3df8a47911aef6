"""Plumbing shared by the operators: written tables, row ids, text columns."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` is read from the session.  Where it is unset, a
    session on one machine (master ``local``) gets a temporary folder of its
    own; on a cluster, whose machines don't share such a folder, that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="vestry-shared-")
        atexit.register(shutil.rmtree, path, True)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_table(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/vestry-{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str = "table") -> DataFrame:
    """``df`` written once to the shared folder and read again.

    This cuts the lineage: a lost executor costs a reread of files, not a new
    run of what made them.
    """
    spark = df.sparkSession
    path = new_table(spark, kind)
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Folders of this process's written tables that nobody has dropped yet.
_made: list[str] = []


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_written(df: DataFrame) -> None:
    """Deletes the files behind a table made by :func:`written`."""
    for file in df.inputFiles()[:1]:
        folder = file.rsplit("/", 1)[0]
        if folder.rsplit("/", 1)[-1].startswith("vestry-"):
            _delete(df.sparkSession, folder)
            _made[:] = [p for p in _made if p.rsplit("/", 1)[-1] != folder.rsplit("/", 1)[-1]]


def settle(make, kind: str) -> DataFrame:
    """The table that ``make()`` returns, written; the tables written on the way to it are deleted."""
    before = len(_made)
    df = make()
    spark, path = df.sparkSession, new_table(df.sparkSession, kind)
    df.write.parquet(path)
    for folder in _made[before:]:
        _delete(spark, folder)
    _made[before:] = [path]
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes all tables that this process has written; results that read from them are no longer of use."""
    while _made:
        _delete(spark, _made.pop())


def crc32_of_id(col):
    """crc32 of the decimal text of an id; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def hash_share(share: float) -> int:
    """The signed 64-bit number below which about ``share`` of all hashes lie."""
    return min((1 << 63) - 1, int(-(1 << 63) + min(1.0, share) * (1 << 64)))
