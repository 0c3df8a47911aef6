"""Texts as a stream: cleanup and extraction are stateless, so any trigger gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vestry.operators.cleanup import clean
from vestry.operators.records import extract_records


def stream_records(spark: SparkSession, source: str, schema: str = "rec_id long, raw_text string") -> DataFrame:
    """A streaming table of records from a folder of Parquet files."""
    return extract_records(clean(spark.readStream.schema(schema).parquet(source)))


def run_available(df: DataFrame, sink: str, checkpoint: str) -> None:
    """Works off what is there into Parquet, exactly once, and ends."""
    query = df.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
