"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong spans stand alone: assignments of long values, access key ids, long
lower-case hexadecimal runs.  Weak candidates (account identifiers, random
looking keys, short assigned values, endpoints) say little alone; they are
reported only where complementary parts lie within a scope of ``scope`` code
points: an interval join on (document, scope bin).

Places of matches come from the lengths of what lies between them (the text
split at the pattern) and of the matches, summed in a window per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vestry.llm.common import written

#: Kinds in their order, with their patterns (Java and RE2 read them alike).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
IDENTIFIER = r"""(?i)(user(?:name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]+)"""
KEY = r"[A-Za-z0-9+/]{20,}"
ENDPOINT = r"""https?://[^\x20\x09-\x0D"'<>]+"""
KINDS = ("assign", "access", "hex", "identifier", "key", "endpoint")
STRONG = KINDS[:3]

SCOPE = 240


def _hits(text, kind: str, guard, pattern: str, ok, group: int = 0):
    """Array of ``kind, n, gap, len, ok`` of all matches in order; empty unless ``guard``."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.split(text, pattern, -1)
    made = F.zip_with(
        F.arrays_zip(whole.alias("w"), value.alias("v")),
        F.transform(F.slice(gaps, 1, F.size(whole)), F.length),
        lambda m, gap: F.struct(
            F.lit(kind).alias("kind"), gap.alias("gap"), F.length(m["w"]).alias("len"), ok(m["v"]).alias("ok")
        ),
    )
    made = F.transform(
        made, lambda m, i: F.struct(m["kind"].alias("kind"), i.alias("n"), m["gap"].alias("gap"), m["len"].alias("len"), m["ok"].alias("ok"))
    )
    return F.when(guard, made).otherwise(F.array().cast("array<struct<kind:string,n:int,gap:int,len:int,ok:boolean>>"))


def _scan(text):
    """All matches of all kinds in one array."""

    def long(least, most=None):
        return lambda v: F.length(v) >= least if most is None else F.length(v).between(least, most)

    random_looking = lambda v: (
        (F.length(v) >= 20) & v.rlike("[0-9]") & v.rlike("[A-Z]") & v.rlike("[a-z]")
    )
    has_assign = text.rlike("(?i)(?:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]")
    return F.concat(
        _hits(text, "assign", has_assign, ASSIGN, long(12), 2),
        _hits(text, "access", F.contains(text, F.lit("AKIA")), ACCESS, long(18)),
        _hits(text, "hex", text.rlike("[0-9a-f]{16}"), HEX, long(16)),
        _hits(text, "identifier", text.rlike("(?i)(?:user|name|login|account|id)[\"']?\\x20*[:=]"), IDENTIFIER, long(3), 2),
        _hits(text, "short", has_assign, ASSIGN, long(6, 11), 2),
        _hits(text, "key", text.rlike("[A-Za-z0-9+/]{20}"), KEY, random_looking),
        _hits(text, "endpoint", F.contains(text, F.lit("://")), ENDPOINT, long(1)),
    )


def _near(a: DataFrame, b: DataFrame, scope: int, width: int = SCOPE) -> DataFrame:
    """Rows of ``a`` with a row of ``b`` at most ``scope`` code points away, -1 for an overlap: an interval join by bins.

    The parts of a kind don't overlap, so a bin holds a bounded number of them.
    """
    wide = max(0, scope)
    bins_a = F.sequence(F.expr(f"start div {width}"), F.expr(f"end div {width}"))
    bins_b = F.sequence(F.expr(f"greatest(0, start - {wide}) div {width}"), F.expr(f"(end + {wide}) div {width}"))
    left = a.withColumn("bin", F.explode(bins_a)).alias("a")
    right = b.select("uid", F.col("start").alias("b_start"), F.col("end").alias("b_end"), F.explode(bins_b).alias("bin")).alias("b")
    near = (F.col("a.start") <= F.col("b_end") + scope) & (F.col("b_start") <= F.col("a.end") + scope)
    return left.join(right, (F.col("a.uid") == F.col("b.uid")) & (F.col("a.bin") == F.col("b.bin")) & near, "left_semi").drop("bin").distinct()


def _scanned(text):
    """The array of all matches of a text column."""
    return F.filter(_scan(F.coalesce(text, F.lit(""))), lambda m: m["kind"].isNotNull())


def _spans(scan: DataFrame, scope: int) -> DataFrame:
    """``uid, start, end, kind`` of all reported spans, from rows ``uid, hits``."""
    placed = Window.partitionBy("uid", "kind").orderBy("n")
    parts = (
        scan.where("size(hits) > 0")
        .select("uid", F.inline("hits"))
        .withColumn("end", F.sum(F.col("gap") + F.col("len")).over(placed).cast("int"))
        .where("ok")
        .select(
            "uid",
            F.when(F.col("kind") == "short", "key").otherwise(F.col("kind")).alias("kind"),
            (F.col("end") - F.col("len")).alias("start"),
            "end",
        )
        .distinct()
    )
    parts = written(parts, "parts")
    strong = parts.where(F.col("kind").isin(*STRONG))
    weak = parts.where(~F.col("kind").isin(*STRONG))
    weak = written(weak.join(_near(weak, strong, -1), ["uid", "kind", "start", "end"], "left_anti"), "weak")
    everything = strong.unionByName(weak)
    ids = everything.where(F.col("kind").isin("access", "identifier"))
    keys = everything.where(F.col("kind").isin("assign", "hex", "key"))
    ends = everything.where("kind = 'endpoint'")
    linked = (
        _near(weak.where("kind = 'identifier'"), keys, scope)
        .unionByName(_near(weak.where("kind = 'key'"), ids.unionByName(ends), scope))
        .unionByName(_near(_near(ends, ids, scope), keys, scope))
    )
    return strong.unionByName(linked).select("uid", "start", "end", "kind")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, text_hash, found``.

    ``found`` is an array of ``start, order, kind, end`` (code points, end
    exclusive) sorted by start, kind and end; ``text_hash`` is the xxhash64 of the
    text.  An identifier is reported near a secret, a key or short assigned
    value near an identifier or endpoint, an endpoint near both an identifier
    and a secret.  A weak span that overlaps a strong one is dropped.

    * null or empty text: nothing found;
    * very long texts and values: searched whole, values of any length; the spans
      of a text are joined bin by bin, in as many tasks as there are bins;
    * ties: spans with one start come in the order of ``KINDS``, each reported once;
    * repeated rows and ids, null ids: a row each, kept apart by a row number;
    * empty table: no rows; other columns are ignored, whatever their names.
    """
    scan = written(
        docs.select(
            F.monotonically_increasing_id().alias("uid"),
            F.col(id_col).alias("doc_id"),
            F.xxhash64(F.col(text_col)).alias("text_hash"),
            _scanned(F.col(text_col)).alias("hits"),
        ),
        "scan",
    )
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    found = (
        _spans(scan.select("uid", "hits"), scope)
        .groupBy("uid")
        .agg(F.sort_array(F.collect_list(F.struct("start", order.alias("order"), "kind", "end"))).alias("found"))
    )
    return (
        scan.select("uid", "doc_id", "text_hash")
        .join(found, "uid", "left")
        .select("doc_id", "text_hash", F.coalesce("found", F.array().cast(found.schema["found"].dataType)).alias("found"))
    )


def spans_text(found):
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts, the hash of the strong spans and all spans, of what :func:`find_secrets` returns."""
    def n(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("found", lambda s: s["kind"].isin(*STRONG))
    return found.select(
        "doc_id",
        *[n(k).alias(f"n_{k}") for k in STRONG],
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(F.col("found")).alias("spans"),
    )


#: Code points of the pieces that a text is cut into before masking.
_PIECE = 4096


def _masked(pieces, islands, mask: str):
    """A text, given in pieces, with ``mask`` in place of each of its ``islands`` (sorted, apart from each other).

    Only the pieces at the ends of what is kept are cut, so the work grows with
    the text and the number of islands, not with their product.
    """

    def part(a, b):
        i, j = F.floor(a / _PIECE).cast("int"), F.floor((b - 1) / _PIECE).cast("int")
        first, last = F.get(pieces, i), F.get(pieces, j)
        within = F.substr(first, a - i * _PIECE + 1, b - a)
        across = F.concat(
            F.substr(first, a - i * _PIECE + 1), F.array_join(F.slice(pieces, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substr(last, F.lit(1), b - j * _PIECE)
        )
        return F.when(b <= a, "").when(i == j, within).otherwise(across)

    before = lambda k: F.when(k > 0, F.get(islands, k - 1)["end"]).otherwise(F.lit(0))
    kept = F.transform(islands, lambda s, k: part(before(k), s["start"]))
    length = F.aggregate(pieces, F.lit(0), lambda n, p: n + F.length(p))
    return F.concat(F.array_join(F.transform(kept, lambda p: F.concat(p, F.lit(mask))), ""), part(F.element_at(islands, -1)["end"], length))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[secret]", scope: int = SCOPE) -> DataFrame:
    """``docs`` with every reported span replaced by ``mask``; spans that overlap or touch become one mask.

    The rows are written once with what the scan of their text hit.  Only rows
    with a hit meet their spans in a shuffle; all others go straight on.

    * null and empty texts, and texts without a find, stay as they are, as do
      null ids and all other columns, whatever their names;
    * repeated rows: a row each, masked alike;
    * very long texts: masked whole, in pieces, with any number of spans;
    * empty table: no rows.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    scan = written(docs.select(F.monotonically_increasing_id().alias("uid"), row.alias("row"), _scanned(F.col(f"`{text_col}`")).alias("hits")), "scan")
    by_start = Window.partitionBy("uid").orderBy("start", "end")
    reach = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    islands = (
        _spans(scan.select("uid", "hits"), scope)
        .withColumn("begins", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
        .withColumn("island", F.sum("begins").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("uid", "island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .groupBy("uid")
        .agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("islands"))
    )
    text = F.col("row")[text_col]
    hit = scan.where("size(hits) > 0").select("uid", "row").join(islands, "uid", "left")
    pieces = F.when(F.col("islands").isNotNull(), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0)))
    hit = hit.withColumn("pieces", pieces)
    masked = F.when(F.col("islands").isNull(), text).otherwise(_masked(F.col("pieces"), F.col("islands"), mask))
    changed = hit.select(*[(masked if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
    return scan.where("size(hits) = 0").select(*[F.col("row")[c].alias(c) for c in docs.columns]).unionByName(changed)
