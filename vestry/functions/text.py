"""Cleanup of recognised text, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from vestry import fixed

#: Java's classes cover all scripts only with this flag.
U = "(?U)"


def strip(t: Column) -> Column:
    return F.regexp_replace(t, U + r"^\s+|(?<!\s)\s+$", "")


def once(x: Column) -> Column:
    """The same value, worked out once a row.

    The optimizer copies an expression into every filter and projection above
    it that names the column; a long chain of regular expressions would then run
    many times.  It doesn't copy what depends on the partition.
    """
    return F.when(F.spark_partition_id() >= 0, x)


def tokens(t: Column) -> Column:
    """White-space separated words; a blank text gives an empty array."""
    return F.filter(F.split(strip(t), U + r"\s+"), lambda w: w != "")


def merge_hyphens(t: Column) -> Column:
    """Joins words cut at a line end, and those cut within a line if the first part has over two characters."""
    # a match begins at a word's start: said so, a very long word is tried once and not from each of its letters
    t = replace_where(t, "-", U + r"(?<!\w)(\w+)-\s*\n\s*(\w+)", "$1$2")
    # the first branch takes in what stays, so that it is passed over whole
    return replace_where(t, "-", U + r"(?<!\w)(?:(\w{1,2}-\s+\w+)|(\w{3,})-\s+(\w+))", "$1$2$3")


def replace_where(t: Column, holds: str, pattern: str, new: str) -> Column:
    """``regexp_replace`` of texts that hold what every match holds; the others aren't searched by the pattern."""
    return let(t, lambda x: F.when(F.contains(x, F.lit(holds)), F.regexp_replace(x, pattern, new)).otherwise(x))


def expand_abbreviations(t: Column) -> Column:
    for i, (short, full) in enumerate(fixed.ABBREVIATIONS):
        before_word = short == "у" and i > 2
        t = replace_where(t, f"{short}.", U + rf"\b{short}\." + (r"\b" if before_word else r"\s"), full + " ")
    return t


def fix_ocr(t: Column) -> Column:
    for wrong, right in fixed.OCR_REPAIRS:
        t = replace_where(t, max(re.split(r"\[.*?\]", wrong), key=len), wrong, right)
    t = F.translate(t, "".join(fixed.OLD_LETTERS), "".join(fixed.OLD_LETTERS.values()))
    t = replace_where(t, "ъ", U + r"(?<=\w)ъ\b", "")
    t = F.regexp_replace(t, U + r"(?<!\s)\s+\.", ".")
    t = F.regexp_replace(t, U + r"\.\s+\.", ".")
    return F.regexp_replace(t, U + r"\s{2,}", " ")


def literal_map(d: dict) -> Column:
    """A constant map of strings, from a single literal: a large one is quick to build and to analyse."""
    return F.str_to_map(F.lit("\x1e".join(f"{k}\x1f{v}" for k, v in d.items())), F.lit("\x1e"), F.lit("\x1f"))


def literals(values) -> Column:
    """A constant array of strings, from a single literal."""
    return F.split(F.lit("\x1e".join(values)), "\x1e", -1)


def let(x: Column, f) -> Column:
    """``f(x)`` with ``x`` worked out once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def correct_spelling(t: Column, keep_lead: bool = False) -> Column:
    """Dictionary correction word by word.

    The case of a word goes over to a lower-case correction.  As in the
    original behaviour, a word with punctuation before it loses that and
    repeats its last letters; ``keep_lead`` puts punctuation back where it was.
    """
    edges = "".join("\\" + c for c in fixed.WORD_EDGES)
    words = literal_map(fixed.SPELLING)

    def correct(w):
        clean = F.regexp_replace(w, f"^[{edges}]+|(?<![{edges}])[{edges}]+$", "")
        found = F.element_at(words, F.lower(clean))
        cased = (
            F.when(found.isNull(), clean)
            .when(found != F.lower(found), found)
            .when(clean == F.initcap(clean), F.initcap(found))
            .when(clean == F.upper(clean), F.upper(found))
            .otherwise(found)
        )
        if keep_lead:
            lead = F.regexp_extract(w, f"^[{edges}]*", 0)
            return F.concat(lead, cased, F.substr(w, F.length(lead) + F.length(clean) + 1))
        return F.concat(cased, F.substr(w, F.length(clean) + 1))

    return F.array_join(F.transform(tokens(t), correct), " ")


RU_DATE = r"(\d{1,2})\s+(" + "|".join(fixed.MONTHS_GENITIVE) + r")\s+(\d{4})(?:\s+года)?"
ROMAN_DATE = r"(\d{1,2})\s*[.\s]\s*(I{1,3}|IV|V|VI{0,3}|IX|X[I]?)\s*[.\s]\s*(\d{4})"


def normalize_dates(t: Column) -> Column:
    t = F.regexp_replace(t, "(?iu)" + U + RU_DATE, "$1 $2 $3")
    mark = "\x01"
    t = F.regexp_replace(t, U + ROMAN_DATE, f"$1.{mark}$2{mark}.$3")
    for n, roman in enumerate(fixed.ROMAN_MONTHS, 1):
        t = F.replace(t, F.lit(f"{mark}{roman}{mark}"), F.lit(f"{n:02d}"))
    return t


def squeeze(t: Column) -> Column:
    return strip(F.regexp_replace(t, U + r"\s+", " "))


def wrap_lines(t: Column, width: int = 80) -> Column:
    """Greedy wrapping; a paragraph's very first word counts one character more than a later line's first."""

    def wrap(line):
        start = F.struct(
            F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("size")
        )

        def add(acc, w):
            full = (acc["size"] + F.length(w) + 1 > width) & (acc["now"] != "")
            return F.struct(
                F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"),
                F.when(full | (acc["now"] == ""), w).otherwise(F.concat(acc["now"], F.lit(" "), w)).alias("now"),
                F.when(full, F.length(w)).otherwise(acc["size"] + F.length(w) + 1).alias("size"),
            )

        def end(acc):
            return F.when(acc["now"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"])))

        return F.when(F.length(line) <= width, F.array(line)).otherwise(F.aggregate(tokens(line), start, add, end))

    return F.array_join(F.flatten(F.transform(F.split(t, "\n", -1), wrap)), "\n")


#: Labels of the steps in their order.
STEPS = [
    ("hyphenated_words_merged", merge_hyphens),
    ("abbreviations_expanded", expand_abbreviations),
    ("common_ocr_fixes", fix_ocr),
    ("spelling_correction", correct_spelling),
    ("date_normalization", normalize_dates),
    ("whitespace_cleanup", squeeze),
]
