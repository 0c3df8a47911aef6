"""The cleanup of recognised text over a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vestry.functions import text as T


def clean(df: DataFrame, text_col: str = "raw_text", preserve_lines: bool = True, width: int = 80) -> DataFrame:
    """Adds ``corrected_text``, ``original_text`` and ``corrections_applied``.

    Each step is a column of its own, so no expression is repeated and the
    generated code stays small.  ``original_text`` equals the corrected text,
    as in the original behaviour; the input column stays in the table.
    """
    before, steps = F.col(text_col), []
    for k, (label, step) in enumerate(T.STEPS):
        name = f"__step{k}"
        df = df.withColumn(name, step(before))
        steps.append(F.when(F.col(name) != before, F.lit(label)))
        before = F.col(name)
    done = T.wrap_lines(before, width) if preserve_lines else before
    log = F.filter(F.array(*steps), lambda s: s.isNotNull())
    df = df.withColumns({"corrected_text": T.once(done), "corrections_applied": log})
    return df.withColumn("original_text", F.col("corrected_text")).drop(*[f"__step{k}" for k in range(len(T.STEPS))])
