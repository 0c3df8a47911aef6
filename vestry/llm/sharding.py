"""Sharding by vector bin packing over bytes, tokens and rows.

Every group of equal texts is placed where the dot product of its sizes with a
shard's residual capacity is highest, largest first:

1. heavy groups, those over ``1 / items`` of the total in some dimension (so at
   most ``3 * items``), by the driver; a group that alone exceeds a shard's fair
   share is cut into pieces by a hash of its rows;
2. all others by the tasks that hold them; a task deals out to its shards the
   share of the capacity left by the heavy ones that its own groups make up;
3. a reserve of about ``reserve`` light groups, kept back until then, by the
   driver, which knows every shard's true load by then, and swaps some of them
   to even out the bytes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vestry.llm.common import hash_share, written
from vestry.llm.tokenfiles import ByteLevelEncoder

_SIZES = ("b", "t", "r")


def place(weights: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Shard of each item; ``weights`` has a row per item, ``room`` one per shard, both a column per dimension.

    Weights and room are shares of the total, so each dimension counts alike.
    ``room`` is what is left, and is changed in place.  Items go by their
    largest share, ties by their order; equal products go to the lowest shard.
    """
    out = np.zeros(len(weights), dtype=np.int64)
    for i in np.argsort(-weights.max(1), kind="stable").tolist() if len(weights) else ():
        w = weights[i]
        out[i] = s = int((room @ w).argmax())
        room[s] -= w
    return out


def polish(weights: np.ndarray, where: np.ndarray, before: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Swaps items of equally many rows between the fullest and the emptiest shard while that evens out the bytes.

    ``before`` is what the shards hold in bytes besides these items.  Changes
    the first dimension's loads, leaves rows as they are, and stops when no swap
    helps.
    """
    where = where.copy()
    size, rows = weights[:, 0], weights[:, 2]
    load = before + np.bincount(where, size, len(before))
    for _ in range(rounds):
        hi, lo = int(np.argmax(load)), int(np.argmin(load))
        want = (load[hi] - load[lo]) / 2
        best, pair = want, None
        a_all, b_all = np.flatnonzero(where == hi), np.flatnonzero(where == lo)
        for r in np.intersect1d(rows[a_all], rows[b_all])[:32]:
            a, b = a_all[rows[a_all] == r], b_all[rows[b_all] == r]
            b = b[np.argsort(size[b], kind="stable")]
            at = np.clip(np.searchsorted(size[b], size[a] - want), 1, len(b)) - 1
            for k in (at, np.minimum(at + 1, len(b) - 1)):
                off = np.abs(size[a] - size[b[k]] - want)
                i = int(np.argmin(off))
                if off[i] < best * 0.999:
                    best, pair = off[i], (a[i], b[k[i]])
        if pair is None:
            break
        i, j = pair
        where[i], where[j] = lo, hi
        load[hi] -= size[i] - size[j]
        load[lo] += size[i] - size[j]
    return where


@lru_cache(maxsize=1)
def _encoder(file: str) -> ByteLevelEncoder:
    return ByteLevelEncoder(file)


def _measured(docs: DataFrame, id_col: str, text_col: str, tokenizer_file: str | None) -> DataFrame:
    """``uid, doc_id, size, tokens, text_crc32, h`` of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    facts = [
        F.monotonically_increasing_id().alias("uid"),
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col(text_col)).alias("h"),
    ]
    if tokenizer_file is None:
        return docs.select(*facts, (1 + F.size(F.split(text, "\\s+"))).cast("long").alias("tokens"))
    df = docs.select(*facts, text.alias("text"))
    kinds = dict(df.dtypes) | {"tokens": "long"}
    names = [c for c in kinds if c != "text"]

    def run(batches):
        enc = _encoder(tokenizer_file)
        for whole in batches:
            for lo in range(0, whole.num_rows, 128):
                batch = whole.slice(lo, 128)
                tokens = pa.array([1 + len(ids) // enc.width for ids in enc.encode(batch.column("text").to_pylist())], pa.int64())
                yield pa.RecordBatch.from_arrays([tokens if c == "tokens" else batch.column(c) for c in names], names=names)

    return df.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names))


def _place_light(shards: int, heavy: np.ndarray, total: np.ndarray, light: np.ndarray):
    """Places the groups of a task; ``heavy`` is what the shards hold already, ``light`` what all tasks are to place, as shares of ``total``."""

    def run(batches):
        room = np.zeros((shards, 3))
        for batch in batches:
            w = np.stack([np.asarray(batch.column(c), dtype=float) for c in _SIZES], axis=1) / total
            part = w.sum(0) / np.where(light > 0, light, 1)
            room += part * (1 / shards - heavy)  # of the capacity that the heavy groups leave, this batch's part
            at = place(w, room)
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(at, pa.int32())], names=["h", "shard"])

    return run


def shard(
    docs: DataFrame,
    shards: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    items: int = 8192,
    reserve: int = 4096,
    tokenizer_file: str | None = None,
) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for each row of ``docs``.

    ``size`` is the UTF-8 bytes of the text plus 1; shards have nearly equal
    sums of it, of tokens and of rows.  Tokens are the ids of ``tokenizer_file``
    and an end, or without a file words and an end.  ``slot`` numbers a shard's
    rows from 0 without gaps.

    * null text: size 1, checksum of the empty text, a group of its own; empty
      texts are a group;
    * very long texts: a group like any other; one of more than a shard's share
      can't be cut, and its shard is larger by the rest;
    * repeated rows, null ids: a row and a slot each; equal texts stay in one
      shard unless they exceed its fair share;
    * ties: groups of one weight go in the order of their hash or their file,
      equal products to the lowest shard;
    * fewer groups than shards leave shards empty; empty table: no rows;
    * other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    rows = written(_measured(docs, id_col, text_col, tokenizer_file), "sizes")
    groups = rows.groupBy("h").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("r"))
    groups = written(groups, "groups")
    found = groups.agg(*[F.sum(c).alias(c) for c in _SIZES], F.count("*").alias("n")).first()
    total = np.array([float(found[c] or 1) for c in _SIZES])
    share = F.greatest(*[F.col(c) / F.lit(x) for c, x in zip(_SIZES, total.tolist())])
    kept = F.xxhash64("h", F.lit(11)) <= hash_share(reserve / max(1, found["n"]))
    groups = groups.select("h", *_SIZES, share.alias("share"))
    weigh = lambda rs: np.array([[r[c] for c in _SIZES] for r in rs], dtype=float).reshape(-1, 3) / total

    # heavy groups, and pieces of those that no shard could hold: at most 64 * shards a dimension
    heavy = sorted(groups.where(share > 1 / items).collect(), key=lambda g: g["h"])
    pieces = {g["h"]: int(np.ceil(g["share"] * shards * 64)) for g in heavy if g["share"] > 1 / shards}
    keys = [(g["h"], 0) for g in heavy if g["h"] not in pieces]
    weights = weigh([g for g in heavy if g["h"] not in pieces])
    piece_of = F.pmod(F.xxhash64("uid"), F.col("pieces")).cast("int")
    if pieces:
        hot = spark.createDataFrame(list(pieces.items()), "h long, pieces int")
        parts = rows.join(F.broadcast(hot), "h").groupBy("h", piece_of.alias("piece"))
        parts = sorted(parts.agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("r")).collect())
        keys += [(g["h"], g["piece"]) for g in parts]
        weights = np.concatenate([weights, weigh(parts)])
    room = np.full((shards, 3), 1 / shards)
    at = place(weights, room)
    load = 1 / shards - room

    # all others, in the tasks that hold them
    light = groups.where(~(share > 1 / items) & ~kept).select("h", *_SIZES)
    sums = light.agg(*[F.sum(c).alias(c) for c in _SIZES]).first()
    sums = np.array([float(sums[c] or 0) for c in _SIZES])
    placed = written(light.mapInArrow(_place_light(shards, load, total, sums / total), "h long, shard int"), "light")
    by_shard = light.join(placed, "h").groupBy("shard").agg(*[F.sum(c).alias(c) for c in _SIZES]).collect()
    for r in by_shard:
        load[r["shard"]] += [r[c] / x for c, x in zip(_SIZES, total)]

    # the reserve, and the last bytes
    rest = sorted(groups.where(~(share > 1 / items) & kept).collect(), key=lambda g: g["h"])
    last = weigh(rest)
    before = load[:, 0] * total[0]
    rest_at = polish(last * total, place(last, 1 / shards - load), before)

    known = [(h, 1) for h, _ in keys if h not in pieces] + list(pieces.items()) + [(g["h"], 1) for g in rest]
    target = [(*k, int(s)) for k, s in zip(keys, at)] + [(g["h"], 0, int(s)) for g, s in zip(rest, rest_at)]
    # both tables are bounded by the parameters, whatever the corpus
    known = F.broadcast(spark.createDataFrame(known, "h long, pieces int"))
    target = F.broadcast(spark.createDataFrame(target, "h long, piece int, shard int"))
    named = ["uid", "doc_id", "size", "text_crc32", "shard"]
    by_driver = rows.join(known, "h").withColumn("piece", piece_of).join(target, ["h", "piece"]).select(*named)
    by_task = rows.join(known, "h", "left_anti").join(placed, "h").select(*named)
    subs = max(16, min(4096, -(-int(found["r"] or 0) // (shards * 250_000))))
    sub = F.pmod(F.xxhash64("uid", F.lit(5)), F.lit(subs)).cast("int").alias("sub")
    placed = written(by_driver.unionByName(by_task).select(*named, sub), "placed")
    counts = sorted(placed.groupBy("shard", "sub").count().collect())
    first, offsets = {}, []
    for s, sub, n in counts:
        offsets.append((s, sub, first.get(s, 0)))
        first[s] = first.get(s, 0) + n
    starts = spark.createDataFrame(offsets, "shard int, sub int, first long")
    number = F.row_number().over(Window.partitionBy("shard", "sub").orderBy("uid"))
    return (
        placed.withColumn("number", number)
        .join(F.broadcast(starts), ["shard", "sub"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("number") - 1).alias("slot"))
    )
