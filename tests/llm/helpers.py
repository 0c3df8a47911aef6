"""Small fixtures with the cases that every operator has to bear."""

LONG = " ".join(f"word{i % 977} and" for i in range(20_000))
SAME = "The same text stands here more than once, with a token = \"abcdefabcdefabcdef\" in it."
EDGE = [
    (1, None, "en"),
    (2, "", "en"),
    (3, " \n\t ", None),
    (4, "a", "fr"),
    (5, LONG, "en"),
    (6, SAME, "en"),
    (6, SAME, "en"),
    (7, SAME, "de"),
    (None, "A text without an id stands here.", "en"),
    (None, None, None),
    (8, "\x00\x01 ퟿ 漢字 ß\x85\xa0x", "xx"),
]


def edge(spark):
    """The cases, with further columns whose names operators use inside."""
    df = spark.createDataFrame([(*r, "src", len(r[1] or "")) for r in EDGE], "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("uid", "id", "fp", "h", "n", "key", "found", "shard", "score", "tokens", "rep", "x", "y", "held_out"):
        df = df.selectExpr("*", f"'clash' as {name}")
    return df


def by_id(df, key="doc_id"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], []).append(r)
    return out
