"""Benchmark decontamination by a Wu-Manber search over words.

The patterns are all windows of ``window`` words of the benchmark items (an
item of fewer words is one pattern).  The alphabet is the words: a block is a
pair of adjacent words, the shift table tells how far the search may jump when
a block ends at the current place, and where it says zero, a hash of the
suffix selects the few windows that are then compared directly.

Words are numbers here: the index of a piece of the benchmark is a dictionary
of its words and a few flat arrays (about 30 bytes a word), whatever the number
of windows.
"""

from __future__ import annotations

import hashlib
import pickle
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vestry.llm.common import written

#: A-Z to a-z, digits, a-z and everything beyond ASCII as they are, the rest to space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class WuManber:
    """Finds every occurrence of the patterns of an array of numbered words.

    Pattern ``k`` is the ``size[k]`` words from place ``start[k]`` of ``words``;
    ``m`` is the least size.  Both tables are arrays as long as a power of two:
    ``shift`` keeps the least shift of all blocks of a hash, ``first`` and
    ``entries`` the patterns of a suffix hash side by side.
    """

    def __init__(self, words: np.ndarray, start: np.ndarray, size: np.ndarray):
        self.m = m = int(size.min())
        self.block, self.suffix = min(2, m), min(4, m)
        self.default = m - self.block + 1
        self.mask = mask = (1 << max(8, int(4 * len(start)).bit_length())) - 1
        self.text, self.start, self.size = words.astype("<i4").tobytes(), start.tolist(), size.tolist()
        shift = np.full(mask + 1, min(255, self.default), np.uint8)
        for end in range(self.block, m + 1):  # later blocks have smaller shifts and overwrite those of the same hash
            shift[self._hash(words, start + end, self.block)] = min(255, m - end, self.default)
        self.shift = shift
        at = self._hash(words, start + m, self.suffix)
        self.entries = np.argsort(at, kind="stable").astype(np.int32)
        self.first = np.searchsorted(at[self.entries], np.arange(mask + 2)).astype(np.int32)

    def _hash(self, words: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the ``n`` words before each of ``ends``."""
        h = np.zeros(len(ends), np.uint32)
        for k in range(n, 0, -1):
            h = (h ^ words[ends - k].astype(np.uint32)) * np.uint32(2654435761)
            h ^= h >> np.uint32(15)
        return (h & np.uint32(self.mask)).astype(np.int64)

    def occurrences(self, words: np.ndarray):
        """``(start, end, pattern)`` by start; a word that no item holds is -1."""
        m, n = self.m, len(words)
        if n < m:
            return
        ends = np.arange(self.block, n + 1)
        blocks = self._hash(words, ends, self.block)
        known = words >= 0
        inside = known[1:] & known[:-1] if self.block == 2 else known
        # a block with a word of no item lets the search jump as far as it can
        jumps = np.where(inside, self.shift[blocks], min(255, self.default)).astype(np.uint8).tobytes()
        raw, text, first, entries, block = words.astype("<i4").tobytes(), self.text, self.first, self.entries, self.block
        at, tails = m, None
        while at <= n:
            if jump := jumps[at - block]:
                at += jump
                continue
            if tails is None:
                tails = self._hash(words, np.arange(m, n + 1), self.suffix).tolist()
            h, begin = tails[at - m], at - m
            for p in entries[first[h] : first[h + 1]].tolist():
                size, s = self.size[p], 4 * self.start[p]
                if raw[4 * begin : 4 * (begin + size)] == text[s : s + 4 * size]:
                    yield begin, begin + size, p
            at += 1


class Index:
    """The searchers of one piece of the benchmark, and whose windows they find."""

    def __init__(self, segments: list[tuple[bytes, bytes]], window: int):
        """``segments`` are pairs of an item's id as a string and folded words; equal words are indexed once."""
        owners: dict[bytes, list[bytes]] = {}
        for item, line in segments:
            if line:
                owners.setdefault(line, []).append(item)
        self.items = [sorted(set(x)) for x in owners.values()]
        self.number: dict[bytes, int] = {}
        lines = [np.array([self.number.setdefault(w, len(self.number)) for w in line.split(b" ")], np.int32) for line in owners]
        sizes = np.array([len(x) for x in lines], np.int64)
        self.words = np.concatenate(lines) if lines else np.zeros(0, np.int32)
        self.begin = np.cumsum(sizes) - sizes
        count = np.where(sizes >= window, sizes - window + 1, 0)
        whole = np.repeat(self.begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        short = np.flatnonzero(sizes < window)
        self.searchers = []  # each with its patterns' lines
        if len(whole):
            self.searchers.append(self._distinct(whole, np.repeat(np.arange(len(sizes)), count), window))
        if len(short):
            self.searchers.append((WuManber(self.words, self.begin[short], sizes[short]), np.arange(len(short) + 1), short))

    def _distinct(self, start: np.ndarray, line: np.ndarray, window: int):
        """A searcher in which equal windows are one pattern, and the lines of pattern k at ``lines[first[k]:first[k + 1]]``."""
        h = np.zeros(len(start), np.uint64)
        for k in range(window):
            h = (h ^ self.words[start + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        _, rep, group = np.unique(h, return_index=True, return_inverse=True)
        rep = rep[group]
        for k in range(window):  # a clash of hashes makes a pattern of its own
            differs = self.words[start + k] != self.words[start[rep] + k]
            rep[differs] = np.flatnonzero(differs)
        reps, group = np.unique(rep, return_inverse=True)
        pairs = np.unique(group.astype(np.int64) * len(self.items) + line)
        first = np.searchsorted(pairs, np.arange(len(reps) + 1) * len(self.items))
        return WuManber(self.words, start[reps], np.full(len(reps), window)), first, pairs % len(self.items)

    def hits(self, texts: list[list[bytes]]) -> list[tuple[list[list[int]], set[bytes]]]:
        """Per text, merged intervals of hit words and the items' ids.

        All texts are searched as one, with a word of no item between them.
        """
        sizes = np.array([len(w) + 1 for w in texts], np.int64)
        begin = np.cumsum(sizes) - sizes
        get = self.number.get
        coded = np.fromiter((get(w, -1) for words in texts for w in (*words, None)), np.int32, int(sizes.sum()))
        out: list = [([], set()) for _ in texts]
        spans: dict[int, set] = {}
        found: dict[int, list[set]] = {}
        for k, (searcher, _, _) in enumerate(self.searchers):
            for start, end, p in searcher.occurrences(coded):
                text = int(np.searchsorted(begin, start, side="right")) - 1
                lo = int(begin[text])
                spans.setdefault(text, set()).add((start - lo, end - lo))
                found.setdefault(text, [set() for _ in self.searchers])[k].add(p)
        for text, by_searcher in found.items():
            lines = [owners[first[p] : first[p + 1]] for (_, first, owners), ps in zip(self.searchers, by_searcher) for p in ps]
            out[text] = _merge(spans[text]), {item for k in np.unique(np.concatenate(lines)).tolist() for item in self.items[k]}
        return out


def _merge(spans) -> list[list[int]]:
    out: list[list[int]] = []
    for s in sorted(map(list, spans)):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(s[1], out[-1][1])
        else:
            out.append(s)
    return out


def _segments(benchmark: DataFrame, item_col: str, text_col: str, window: int, words: int) -> DataFrame:
    """Items in segments of at most ``words`` words that overlap by a window less one: ``item, line``."""

    def run(batches):
        for batch in _sliced(batches):
            items, lines = [], []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                w = words_of(text)
                for at in range(0, max(1, len(w) - window + 1), words - window + 1):
                    items.append(item.encode())
                    lines.append(b" ".join(w[at : at + words]))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.binary()), pa.array(lines, pa.binary())], names=["item", "line"])

    named = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item is not null and text is not null")
    return named.mapInArrow(run, "item binary, line binary").where("octet_length(line) > 0").distinct()


@lru_cache(maxsize=1)
def _index(shipped, window: int) -> Index:
    """One index a worker process: that of the piece it works on."""
    return Index(pickle.loads(shipped.value), window)


def _verdict_columns(n_words: list[int], spans: list, items: list, share: int) -> list[pa.Array]:
    n_hit = [sum(e - s for s, e in x) for x in spans]
    return [
        pa.array(n_words, pa.int64()),
        pa.array(n_hit, pa.int64()),
        pa.array([len(x) for x in items], pa.int64()),
        pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
        pa.array([h > 0 and share * h >= n for h, n in zip(n_hit, n_words)], pa.bool_()),
        pa.array(spans, pa.list_(pa.list_(pa.int32()))),
        pa.array(items, pa.list_(pa.string())),
    ]


_VERDICT = {
    "n_words": "long", "n_hit": "long", "n_items": "long", "items_sha256": "string", "contaminated": "boolean",
    "hit_spans": "array<array<int>>", "item_ids": "array<string>",
}


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    share: int = 20,
    piece_bytes: int = 8 << 20,
    segment_words: int = 1 << 16,
) -> DataFrame:
    """What of each document occurs in the benchmark.

    Returns, per row of ``docs``: ``doc_id, n_words, n_hit, n_items,
    items_sha256, contaminated, hit_spans, item_ids``; ``hit_spans`` are merged
    word intervals (end exclusive) and ``item_ids`` the items as sorted strings.
    A document is contaminated if at least one in ``share`` of its words is hit.

    * null or empty text, or one without words: 0 words, no hits;
    * very long texts: searched whole; very long items: cut into overlapping
      segments of ``segment_words`` words, so that no window is lost;
    * null or empty items, and items with a null id, match nothing;
    * ties: overlapping hits count a word once; equal texts of several items
      name them all; repeated items count once, repeated documents have a row each;
    * empty tables: no rows, or no hits; other columns are ignored.

    A benchmark of any size: it is dealt by hash into pieces of about
    ``piece_bytes``, of which one at a time is broadcast and searched for; the
    driver never holds more.  With one piece that is one narrow stage.  With
    more, each pass writes what it found, and the finds of a row are merged at
    the end.
    """
    if segment_words < 2 * window:
        raise ValueError("segment_words must be at least two windows")
    segments = written(_segments(benchmark, item_col, item_text_col, window, segment_words), "segments")
    total = segments.agg(F.sum(F.octet_length("item") + F.octet_length("line") + 16)).first()[0] or 0
    n = int(1 + total // piece_bytes)
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = df.schema["doc_id"].dataType.simpleString()
    if n == 1:
        shipped = _ship(segments)

        def run(batches):
            index = _index(shipped, window)
            for batch in _sliced(batches):
                words = [words_of(t) for t in batch.column("text").to_pylist()]
                found = index.hits(words)
                items = [sorted(i.decode() for i in x) for _, x in found]
                cols = _verdict_columns([len(w) for w in words], [x for x, _ in found], items, share)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", *_VERDICT])

        return df.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{k} {v}" for k, v in _VERDICT.items()))

    rows = written(df.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text"), "documents")
    finds = []
    for k in range(n):
        piece = segments.where(F.pmod(F.xxhash64("item", "line"), F.lit(n)) == k)
        shipped = _ship(piece)
        finds.append(written(rows.select("uid", "text").mapInArrow(_pass(shipped, window), "uid long, spans array<array<int>>, items array<string>"), "finds"))
        shipped.destroy()
    found = finds[0]
    for more in finds[1:]:
        found = found.unionByName(more)
    # a row's finds are at most one a piece
    found = found.groupBy("uid").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    counted = rows.mapInArrow(_count_words, f"uid long, doc_id {kind}, n_words long").join(found, "uid", "left").drop("uid")

    def merge(batches):
        for batch in batches:
            spans = [_merge(x or []) for x in batch.column("spans").to_pylist()]
            items = [sorted(x or []) for x in batch.column("items").to_pylist()]
            cols = _verdict_columns(batch.column("n_words").to_pylist(), spans, items, share)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", *_VERDICT])

    return counted.mapInArrow(merge, f"doc_id {kind}, " + ", ".join(f"{k} {v}" for k, v in _VERDICT.items()))


def _ship(piece: DataFrame):
    """One piece as a broadcast variable; its size is what the pieces are dealt by."""
    rows = [(bytes(r["item"]), bytes(r["line"])) for r in piece.collect()]
    return piece.sparkSession.sparkContext.broadcast(pickle.dumps(rows))


def _sliced(batches, rows: int = 256):
    for whole in batches:
        for lo in range(0, whole.num_rows, rows):
            yield whole.slice(lo, rows)


def _count_words(batches):
    for batch in batches:
        n = [len(words_of(t)) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("doc_id"), pa.array(n, pa.int64())], names=["uid", "doc_id", "n_words"])


def _pass(shipped, window: int):
    def run(batches):
        index = _index(shipped, window)
        for batch in _sliced(batches):
            uids, all_spans, all_items = [], [], []
            found = index.hits([words_of(t) for t in batch.column("text").to_pylist()])
            for uid, (spans, items) in zip(batch.column("uid").to_pylist(), found):
                if spans:
                    uids.append(uid)
                    all_spans.append(spans)
                    all_items.append(sorted(i.decode() for i in items))
            yield pa.RecordBatch.from_arrays(
                [pa.array(uids, pa.int64()), pa.array(all_spans, pa.list_(pa.list_(pa.int32()))), pa.array(all_items, pa.list_(pa.string()))],
                names=["uid", "spans", "items"],
            )

    return run
