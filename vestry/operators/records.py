"""Rule-based extraction of records, and their merge with answers of a language model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vestry.functions import extract as X
from vestry.functions.dates import UNKNOWN
from vestry.functions.text import once, strip

THRESHOLD = 0.7
REVIEW_BELOW = 0.5


def _prediction(value: Column, confidence: float) -> Column:
    known = value != UNKNOWN
    return F.struct(value.alias("value"), F.when(known, confidence).otherwise(0.0).alias("confidence"))


def average(*fields: str, extra: str | None = None) -> Column:
    """Unweighted mean of the confidences, added from left to right and rounded to two places.

    One reachable mean lies on a tie in decimal but below it in binary; it is
    given as the binary value rounds.
    """
    total = F.lit(0.0)
    for f in fields:
        total = total + F.col(f)["confidence"]
    mean = total / len(fields)
    if extra:
        mean = F.when(F.col(extra).isNull(), mean).otherwise((total + F.col(extra)["confidence"]) / (len(fields) + 1))
    return F.when(mean == 0.175, 0.17).otherwise(F.round(mean, 2))


def extract_records(df: DataFrame, text_col: str = "corrected_text") -> DataFrame:
    """Adds ``record_type``, the fields of all types and the extraction's facts.

    A field of another type is null; one looked for and not found is
    ``Unknown`` with confidence 0.  Blank texts give ``empty_input``.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    blank = strip(t) == ""
    df = df.withColumns({"__blank": once(blank)} | {f"{kind}_score": F.when(blank, 0).otherwise(X.type_score(t, kind)) for kind in X.TYPES})
    df = df.withColumn("record_type", once(X.best_type(*[F.col(f"{k}_score") for k in X.TYPES])))
    kind_of = {name: kind for kind, fields in X.FIELDS.items() for name, _, _ in fields}
    own = {name: F.col("record_type") == kind for name, kind in kind_of.items()}
    # each value is worked out once a row, whatever asks for it later; a record has one date, whatever its type
    finders = {name: f for fields in X.FIELDS.values() for name, f, _ in fields}
    names = {f"__{n}": once(F.when(own[n], f(t))) for n, f in finders.items() if f not in (None, X.extract_date)}
    df = df.withColumns(names | {"__date": once(F.when(F.col("record_type") != "unknown", X.extract_date(t))), "__age": once(F.when(own["death_date"], X.age(t)))})
    values = {n: F.lit(UNKNOWN) if f is None else F.col("__date") if f is X.extract_date else F.col(f"__{n}") for n, f in finders.items()}
    confidences = {n: c for fields in X.FIELDS.values() for n, _, c in fields}
    age = F.when(F.col("__age").isNotNull(), F.struct(F.col("__age").alias("value"), F.lit(0.7).alias("confidence")))
    df = df.withColumns({n: F.when(own[n], _prediction(v, confidences[n])) for n, v in values.items()} | {"age": age})
    of = {k: [n for n, _, _ in fields] for k, fields in X.FIELDS.items()}
    mean = (
        F.when(F.col("record_type") == "birth", average(*of["birth"]))
        .when(F.col("record_type") == "death", average(*of["death"], extra="age"))
        .when(F.col("record_type") == "marriage", average(*of["marriage"]))
        .otherwise(0.0)
    )
    facts = {
        "average_confidence": mean,
        "source_length": F.when(F.col("__blank"), 0).otherwise(F.length(t)),
        "method": F.when(F.col("__blank"), "empty_input").otherwise("rule_based"),
        "language": F.lit("ru"),
        # the rules mark every record for review, whatever the mean
        "needs_review": F.lit(True),
    }
    return df.withColumns(facts).drop("__blank", "__date", "__age", *names)


def llm_gate(confidence: Column, force: bool = False, threshold: float = THRESHOLD) -> Column:
    """Which records ask the language model."""
    return F.lit(True) if force else confidence < threshold


def _known(field: Column) -> Column:
    return F.coalesce(field["value"], F.lit(UNKNOWN)) != UNKNOWN


def merge_answers(records: DataFrame, answers: DataFrame, key: str, fields: list[str] = X.ALL_FIELDS) -> DataFrame:
    """Fills fields that the rules left unknown from the model's answers.

    A record with an answer becomes ``hybrid`` and ``llm_used`` even if nothing
    was filled; its mean isn't computed anew.
    """
    a = answers.select(F.col(key), F.lit(True).alias("__asked"), *[F.col(f).alias(f"__{f}") for f in fields])
    df = records.join(a, key, "left")
    for f in fields:
        own, new = F.col(f), F.col(f"__{f}")
        df = df.withColumn(f, F.when(own.isNotNull() & ~_known(own) & _known(new), new).otherwise(own))
    asked = F.coalesce("__asked", F.lit(False))
    return (
        df.withColumn("method", F.when(asked, "hybrid").otherwise(F.col("method")))
        .withColumn("llm_used", asked)
        .drop("__asked", *[f"__{f}" for f in fields])
    )


def prefer_answers(records: DataFrame, answers: DataFrame, key: str, force: bool = False, fields: list[str] = X.ALL_FIELDS) -> DataFrame:
    """The inner merge: where the gate opens, the answer counts, and rules fill what it left unknown (unless forced).

    Below the gate the record stays; without an answer the rules count.
    """
    a = answers.select(F.col(key), F.lit(True).alias("__asked"), *[F.col(f).alias(f"__{f}") for f in fields])
    df = records.join(a, key, "left")
    use = F.coalesce("__asked", F.lit(False)) & llm_gate(F.col("average_confidence"), force)
    for f in fields:
        own, new = F.col(f), F.col(f"__{f}")
        filled = new if force else F.when(new.isNotNull() & ~_known(new) & _known(own), own).otherwise(new)
        df = df.withColumn(f, F.when(use, filled).otherwise(own))
    return df.withColumn("method", F.when(use, "llm").otherwise(F.col("method"))).drop("__asked", *[f"__{f}" for f in fields])
