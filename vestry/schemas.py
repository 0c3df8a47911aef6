"""Schemas of records and of what is resolved from them.

Null means that a record of this type has no such field; ``Unknown`` means that
the field was looked for and not found.  Dates are strings and may be impossible.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vestry.functions.extract import ALL_FIELDS

#: Record types that a result may have.
KINDS = ("birth", "death", "marriage", "unknown")
PREDICTION = "struct<value:string,confidence:double>"
NAME = "struct<original:string,canonical:string,variants:array<string>,first_name:string,last_name:string,confidence:double>"
DATE = "struct<original:string,resolved:string,is_approximate:boolean,confidence:double>"
AGE = "struct<age_years:int,age_days:int,source:string,confidence:double,note:string>"
AGE_CHECK = "struct<is_consistent:boolean,computed_age:int,extracted_age:int,difference:int,confidence:double>"

RECORD = StructType.fromDDL(
    "rec_id long, record_type string, "
    + ", ".join(f"{f} {PREDICTION}" for f in [*ALL_FIELDS, "age"])
    + ", average_confidence double, source_length int, method string, language string, needs_review boolean"
)


def conform(df: DataFrame, schema: StructType = RECORD) -> DataFrame:
    """Exactly the schema's columns, cast; columns that lack are null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def problems(df: DataFrame, schema: StructType = RECORD) -> DataFrame:
    """``df`` with ``problems``: what a record breaks of its schema, none for a valid one.

    Columns that lack or can't be cast, a record type that isn't known, and
    confidences outside 0 to 1 are named.
    """
    found = [F.when(~F.coalesce(F.col("record_type").isin(*KINDS), F.lit(False)), F.lit("record_type: unknown kind"))]
    for f in schema:
        if f.name not in df.columns:
            found.append(F.lit(f"{f.name}: missing"))
            continue
        have = df.schema[f.name].dataType
        if have != f.dataType:
            lost = F.col(f.name).try_cast(f.dataType).isNull() if not isinstance(f.dataType, StructType) else F.lit(not isinstance(have, StructType))
            found.append(F.when(F.col(f.name).isNotNull() & lost, F.lit(f"{f.name}: not a {f.dataType.simpleString()}")))
        if isinstance(f.dataType, StructType) and isinstance(have, StructType) and "confidence" in have.names:
            found.append(F.when(~F.col(f.name)["confidence"].between(0, 1), F.lit(f"{f.name}: confidence outside 0 to 1")))
    return df.withColumn("problems", F.filter(F.array(*found), lambda p: p.isNotNull()))
