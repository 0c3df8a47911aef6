"""Record typing and field extraction, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vestry import fixed
from vestry.functions.dates import UNKNOWN, extract_date
from vestry.functions.text import U, let, literals, strip, tokens

TYPES = list(fixed.RECORD_KEYWORDS)


def type_score(t: Column, record_type: str) -> Column:
    """Sum of the weights of a type's keywords that the lower-case text holds."""
    low, total = F.lower(t), F.lit(0)
    for word, weight in fixed.RECORD_KEYWORDS[record_type]:
        total = total + F.when(F.contains(low, F.lit(word)), weight).otherwise(0)
    return total


def best_type(birth: Column, death: Column, marriage: Column) -> Column:
    """The type of the highest score, the first of equals; ``unknown`` if all are zero."""
    return (
        F.when(F.greatest(birth, death, marriage) <= 0, "unknown")
        .when((birth >= death) & (birth >= marriage), "birth")
        .when(death >= marriage, "death")
        .otherwise("marriage")
    )


def name_after(t: Column, keyword: Column | str) -> Column:
    """Up to three words after the keyword's first occurrence."""
    word = F.lit(keyword) if isinstance(keyword, str) else keyword
    return let(F.position(word, F.lower(t)), lambda at: F.when(at > 0, _leading(F.substr(t, at + F.length(word)))).otherwise(F.lit(UNKNOWN)))


def _leading(after: Column) -> Column:
    """The first three words of the letters that a text begins with."""
    words = tokens(F.regexp_extract(strip(after), U + r"^[А-Яа-яЁё\s\-]+", 0))
    return let(F.array_join(F.slice(words, 1, 3), " "), lambda n: F.when(n != "", n).otherwise(F.lit(UNKNOWN)))


#: Words that a name follows, by the field it is for, in the order in which they are tried. The last of
#: a parent's is loose: it counts only where its name isn't the rest of the word itself.
NAME_KEYWORDS = {
    "child_name": ("родился", "родилась", "сын", "дочь", "род"),
    "father_name": ("отец", "от"),
    "mother_name": ("мать", "мат"),
    "deceased_name": ("умер", "скончался"),
    "groom_name": ("жених", "венчался"),
    "bride_name": ("невеста", "венчалась"),
}


def names_after(t: Column, field: str) -> Column:
    """What follows each keyword of a field, loose ones tested, as an array; ``Unknown`` where nothing does."""

    def tested(word):
        found = name_after(t, word)
        if field == "father_name":
            return let(found, lambda n: F.when((word != "от") | ~F.startswith(F.lower(n), F.lit("ец")), n).otherwise(F.lit(UNKNOWN)))
        if field == "mother_name":
            return let(found, lambda n: F.when((word != "мат") | (F.length(n) >= 3), n).otherwise(F.lit(UNKNOWN)))
        return found

    return F.transform(literals(NAME_KEYWORDS[field]), tested)


def name_of(field: str):
    """The first known name of a field."""
    known = lambda names: F.coalesce(F.get(F.filter(names, lambda n: n != UNKNOWN), F.lit(0)), F.lit(UNKNOWN))
    return lambda t: known(names_after(t, field))


def age(t: Column) -> Column:
    """The number before the word for years, or null."""
    return F.nullif(F.regexp_extract(F.lower(t), U + r"(?<!\d)(\d+)\s+лет", 1), F.lit(""))


#: Fields of each record type in their order: name, value, confidence if found.
FIELDS = {
    "birth": [
        ("child_name", name_of("child_name"), 0.6),
        ("birth_date", extract_date, 0.8),
        ("baptism_date", None, 0.0),
        ("father_name", name_of("father_name"), 0.5),
        ("mother_name", name_of("mother_name"), 0.5),
    ],
    "death": [("deceased_name", name_of("deceased_name"), 0.6), ("death_date", extract_date, 0.8), ("burial_date", None, 0.0)],
    "marriage": [("groom_name", name_of("groom_name"), 0.6), ("bride_name", name_of("bride_name"), 0.6), ("marriage_date", extract_date, 0.8)],
}
ALL_FIELDS = [name for fields in FIELDS.values() for name, _, _ in fields]
