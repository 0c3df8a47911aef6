"""Dates of records, the church calendar and ages, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vestry import fixed
from vestry.functions.text import ROMAN_DATE, RU_DATE, let, literal_map, literals

UNKNOWN = "Unknown"
_OLD = [m for m in fixed.MONTHS_GENITIVE if m not in ("января", "мая")]
OLD_DATE = r"(\d{1,2})\s+(" + "|".join([*fixed.MONTHS_OLD, *_OLD]) + r")\s+(\d{4})"
NUMERIC_DATE = r"(\d{1,2})[./-](\d{1,2})[./-](\d{4})"
ISO_DATE = r"(\d{4})-(\d{2})-(\d{2})"
_I = "(?iu)(?U)"


def month_numbers() -> dict[str, int]:
    return {m: n for n, m in enumerate(fixed.MONTHS_GENITIVE, 1)} | fixed.MONTHS_OLD


def roman_numbers() -> dict[str, int]:
    return {r: n for n, r in enumerate(fixed.ROMAN_MONTHS, 1)}


def extract_date(t: Column) -> Column:
    """The first match of the first pattern that matches, as year-month-day; not checked against a calendar."""
    months, romans = literal_map(month_numbers()), literal_map(roman_numbers())

    def two(x):
        return F.lpad(x, 2, "0")

    def when(pattern, value):
        # parts are cut out of the match, which is short, and not out of the text
        part = lambda m: lambda k: F.regexp_extract(m, _I + pattern, k)
        return let(F.regexp_extract(t, _I + pattern, 0), lambda m: F.when(m != "", value(part(m))))

    def dated(month):
        return lambda part: F.concat_ws("-", part(3), two(month(part(2))), two(part(1)))

    named = dated(lambda m: F.element_at(months, F.lower(m)))
    return F.coalesce(
        when(RU_DATE, named),
        when(OLD_DATE, named),
        when(ROMAN_DATE, dated(lambda m: F.element_at(romans, F.upper(m)))),
        when(NUMERIC_DATE, dated(lambda m: m)),
        when(ISO_DATE, lambda part: part(0)),
        F.lit(UNKNOWN),
    )


def orthodox_easter(year: Column) -> Column:
    """Julian date of Easter as a string."""
    y = year.cast("int")
    d = (y % 19 * 19 + 15) % 30
    e = (y % 4 * 2 + y % 7 * 4 - d + 34) % 7
    k = d + e + 114
    return F.concat_ws("-", y.cast("string"), F.lpad(F.floor(k / 31).cast("string"), 2, "0"), F.lpad((k % 31 + 1).cast("string"), 2, "0"))


def calendar_date(t: Column, year: Column | None = None) -> Column:
    """A struct ``original, resolved, is_approximate, confidence`` for a text with a church calendar reference.

    The first reference of the calendar's order that the lower-case text holds
    decides.  All movable feasts give Easter itself, and their ``original`` is
    rewritten.  ``year`` (nullable) comes before a year in the text.
    """
    own = F.nullif(F.regexp_extract(t, r"(?U)\b(\d{4})\b", 1), F.lit(""))
    given = F.lit(None).cast("string") if year is None else F.when(year != 0, year.cast("string"))
    facts = F.struct(F.coalesce(given, own).alias("best"), own.alias("own"), calendar_entry(t).alias("entry"))

    def resolved(f):
        best, own, entry = f["best"], f["own"], f["entry"]
        movable, circa, none = entry == "movable", entry == "circa", entry.isNull()
        lacks = F.when(movable, best.isNull()).otherwise(own.isNull())
        easter = F.when(best.isNull(), "Пасха unknown").otherwise(orthodox_easter(best))
        about = F.when(own.isNull(), "circa").otherwise(F.concat(own, F.lit("-01-01")))
        fixed_day = F.concat(F.coalesce(best, F.lit("0000")), F.lit("-"), entry)
        sure = F.when(none, 1.0).when(movable, F.when(lacks, 0.3).otherwise(0.85)).when(circa, F.when(lacks, 0.2).otherwise(0.5)).otherwise(0.8)
        return F.struct(
            F.when(movable & ~lacks, F.concat(F.lit("Пасха "), best)).otherwise(t).alias("original"),
            F.when(none, t).when(movable, easter).when(circa, about).otherwise(fixed_day).alias("resolved"),
            F.coalesce(circa | (movable & lacks), F.lit(False)).alias("is_approximate"),
            sure.alias("confidence"),
        )

    return let(facts, resolved)


def calendar_entry(t: Column) -> Column:
    """What the first reference of the calendar's order that the lower-case text holds stands for; null if it holds none."""
    kinds = literals([kind for _, kind in fixed.CALENDAR])
    low = F.lower(t)
    held = F.transform(literals([r for r, _ in fixed.CALENDAR]), lambda r: F.contains(low, r))
    return F.get(kinds, F.nullif(F.array_position(held, True), F.lit(0)).cast("int") - 1)


def parse_date(x: Column) -> Column:
    """year-month-day, else a year alone as its first day, else null."""
    year = F.when(x.rlike(r"^\s*[+-]?\d{1,4}\s*$"), F.expr("0") + F.trim(x).try_cast("int"))
    return F.coalesce(
        F.when(x.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(x, "yyyy-M-d")),
        F.when(year.between(1, 9999), F.make_date(year, F.lit(1), F.lit(1))),
    )


def compute_age(birth: Column, death: Column, reference: Column | None = None) -> Column:
    """A struct ``age_years, age_days, source, confidence, note``; a year has 365 days."""
    none = F.lit(None).cast("string")
    reference = none if reference is None else reference
    b = parse_date(birth)
    to_death = F.when((death != "") & (death != UNKNOWN), F.datediff(parse_date(death), b))
    to_ref = F.when(reference != "", F.datediff(parse_date(reference), b))

    def out(days, source, confidence, note=none):
        years = F.floor(days / 365).cast("int")
        return F.struct(
            years.alias("age_years"), days.cast("int").alias("age_days"), source.alias("source"), F.lit(confidence).alias("confidence"), note.alias("note")
        )

    nothing = F.lit(None).cast("int")
    return (
        F.when(to_death > 0, out(to_death, F.lit("birth_death_difference"), 0.9))
        .when(to_ref > 0, out(to_ref, F.concat(F.lit("reference_date_"), reference), 0.7))
        .when((birth != UNKNOWN) & (F.length(birth) == 4), out(nothing, F.lit("birth_year_only"), 0.3, F.concat(F.lit("Родился "), birth)))
        .otherwise(out(nothing, F.lit("insufficient_data"), 0.0))
    )


def validate_age(extracted: Column, birth: Column, death: Column) -> Column:
    """A struct that tells whether a written age fits the dates; zero counts as missing."""
    computed = compute_age(birth, death)["age_years"]
    diff = F.abs(extracted - computed)
    both = (F.coalesce(extracted, F.lit(0)) != 0) & (F.coalesce(computed, F.lit(0)) != 0)
    return F.struct(
        F.coalesce(F.when(both, diff <= 2), F.lit(True)).alias("is_consistent"),
        computed.alias("computed_age"),
        extracted.alias("extracted_age"),
        F.when(both, diff).alias("difference"),
        F.when(both, F.when(diff <= 2, 0.85).otherwise(0.4)).otherwise(0.3).alias("confidence"),
    )
