"""Language identification by cross-parsing entropy.

A suffix automaton of each language's labelled text tells how far a new text
goes on like something in it.  Cutting the text into such longest matches gives
the number of phrases per symbol, an estimate of the cross entropy; the
language that needs fewest wins.

The automata of all languages are stepped together, in numpy, over many blocks
of text at once.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vestry.llm.common import crc32_of_id, hash_share

_POINTS = 0x110000


def fold(text: str) -> str:
    """Lower case; what isn't a letter becomes a space, runs of it one."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


class SuffixAutomaton:
    """Online construction; ``next[s]`` maps a symbol to a state, 0 is the root."""

    def __init__(self, symbols):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for c in symbols:
            cur = self._state(self.length[last] + 1, {})
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p < 0:
                self.link[cur] = 0
            else:
                q = self.next[p][c]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    clone = self._state(self.length[p] + 1, dict(self.next[q]))
                    self.link[clone] = self.link[q]
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def _state(self, length: int, following: dict) -> int:
        self.next.append(following)
        self.link.append(-1)
        self.length.append(length)
        return len(self.next) - 1


class CrossParser:
    """Counts the phrases of texts against each language's sample.

    ``samples`` maps a language to a folded text.  The alphabet is the letters of
    all samples and the space; any other letter is a symbol that no sample
    holds.  Steps by the ``size`` most frequent letters stand in a dense table,
    those by all others in a sorted list of edges.  Texts are parsed in blocks of ``block``
    symbols, each from the start of a phrase, so that long texts keep no task
    waiting.
    """

    def __init__(self, samples: dict[str, str], size: int = 120, block: int = 1024):
        self.languages = sorted(samples)
        self.block = block
        seen = Counter(c for t in samples.values() for c in t if c != " ")
        letters = [c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))]
        self.alphabet = len(letters) + 3
        self.symbols = min(size, len(letters)) + 3  # those of the dense table; 0: beyond the text, 1: space, 2: a letter no sample holds
        code = {c: k for k, c in enumerate(letters, 3)} | {" ": 1}
        table = np.zeros(_POINTS, np.int32)
        for start in range(0, _POINTS, 4096):
            if 0xD800 <= start < 0xE000:
                continue
            for point in range(start, start + 4096):
                if chr(point).isalpha():
                    table[point] = 2
        for c, k in code.items():
            table[ord(c)] = k
        # upper case as its lower case, where that is one character
        for c in letters:
            for up in {c.upper(), c.title()}:
                if len(up) == 1 and up.lower() == c:
                    table[ord(up)] = code[c]
        table[table == 0] = 1
        self.code = table
        rows, self.roots, self.sizes = [], [], []
        edges = []
        at = 0
        for lang in self.languages:
            automaton = SuffixAutomaton([code[c] for c in samples[lang] if c in code])
            t = np.full((len(automaton.next), self.symbols), -1, np.int32)
            for s, following in enumerate(automaton.next):
                for c, q in following.items():
                    if c < self.symbols:
                        t[s, c] = (at + q) * self.symbols
                    else:
                        edges.append(((at + s) * self.symbols * self.alphabet + c, (at + q) * self.symbols))
            rows.append(t)
            self.roots.append(at * self.symbols)
            self.sizes.append(len(samples[lang]))
            at += len(t)
        self.table = np.concatenate(rows).ravel() if rows else np.zeros(0, np.int32)
        edges.sort()
        self.edge = np.array([e for e, _ in edges], dtype=np.int64)
        self.edge_to = np.array([q for _, q in edges], dtype=np.int32)

    def _go(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Where states go on a symbol each, -1 where nowhere; a symbol counts for a whole column of states."""
        wide = np.flatnonzero(symbol >= self.symbols)
        if not len(wide):
            return self.table[state + symbol]
        to = self.table[state + np.where(symbol >= self.symbols, 2, symbol)]
        if len(self.edge):
            key = state[..., wide].astype(np.int64) * self.alphabet + symbol[wide]
            k = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            to[..., wide] = np.where(self.edge[k] == key, self.edge_to[k], -1)
        return to

    def encode(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        s = self.code[points]
        if not len(s):
            return s
        # one space for a run, none at the ends
        keep = s != 1
        keep[1:] |= (s[1:] == 1) & (s[:-1] != 1)
        s = s[keep]
        return s[: len(s) - (len(s) > 0 and s[-1] == 1)]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of each text, and its phrases against each language."""
        coded = [self.encode(t) for t in texts]
        sizes = np.array([len(c) for c in coded], dtype=np.int64)
        blocks = -(-sizes // self.block)
        n = int(blocks.sum())
        counts = np.zeros((len(texts), len(self.languages)), dtype=np.int64)
        if not n or not self.languages:
            return sizes, counts
        cells = np.zeros(n * self.block, np.int32)
        first = np.concatenate([[0], np.cumsum(blocks)])
        for c, b in zip(coded, first):
            cells[b * self.block : b * self.block + len(c)] = c
        cells = cells.reshape(n, self.block)
        full = np.full(n, self.block)
        full[(first[1:] - 1)[blocks > 0]] = (sizes - (blocks - 1) * self.block)[blocks > 0]
        order = np.argsort(-full, kind="stable")  # so that blocks that end drop off the back
        columns = np.ascontiguousarray(cells[order].T)
        full = full[order]
        alive = np.searchsorted(-full, -np.arange(self.block), side="left")
        roots = np.array(self.roots, np.int32)[:, None]
        state = np.repeat(roots, n, axis=1)
        count = np.zeros((len(roots), n), dtype=np.int32)
        for t in range(int(full[0])):
            k = int(alive[t])
            symbol = columns[t, :k]
            here = state[:, :k]
            to = self._go(here, symbol)
            begins = here == roots  # the first symbol, or the one after a symbol that the sample lacks
            miss = to < 0
            if miss.any():
                root = np.broadcast_to(roots, miss.shape)[miss]
                restart = self._go(root, np.broadcast_to(symbol, miss.shape)[miss])
                to[miss] = np.where(restart < 0, root, restart)
                begins |= miss
            count[:, :k] += begins
            state[:, :k] = to
        by_block = np.empty_like(count)
        by_block[:, order] = count
        owner = np.repeat(np.arange(len(texts)), blocks)
        for j in range(len(roots)):
            counts[:, j] = np.bincount(owner, by_block[j], len(texts)).astype(np.int64)
        return sizes, counts

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """A longest match in a sample of ``m`` symbols grows as log m, so phrases times log m compare unequal samples."""
        sizes, counts = self.phrases([t or "" for t in texts])
        logs = np.log2(np.array(self.sizes, dtype=np.float64) + 1)
        counts = counts * (logs / logs.max()) if len(logs) else counts
        names, scores = [], []
        for text, n, c in zip(texts, sizes.tolist(), counts):
            if not n or not len(c):
                names.append("und")
                scores.append(0.0)
                continue
            best = int(np.argmin(c))
            rest = np.delete(c, best)
            names.append(self.languages[best])
            scores.append(float(rest.min() / (rest.min() + c[best])) if len(rest) else 1.0)
        return names, scores


@lru_cache(maxsize=1)
def _parser(samples: tuple) -> CrossParser:
    """One parser a worker process."""
    return CrossParser(dict(samples))


def samples(docs: DataFrame, id_col: str, text_col: str, lang_col: str, learn_of: int, learn_not: int, chars: int) -> dict[str, str]:
    """``chars`` folded characters of labelled texts a language, or all there are.

    This is the one bounded sample of the method: distinct texts, those with
    the smallest hash first, each whole, until the language is full.
    """
    own = F.pmod(crc32_of_id(F.col(id_col)), F.lit(learn_of)) != learn_not
    labelled = docs.where(own & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col), F.lit(17)).alias("h")
    )
    # equal texts have one hash, so copies pass or fail together and count once
    distinct = labelled.groupBy("lang", "h").agg(F.max(F.length("text")).alias("size"))
    sizes = {r["lang"]: r["size"] for r in distinct.groupBy("lang").agg(F.sum("size").alias("size")).collect()}
    out: dict[str, str] = {}
    times = 4
    while sizes:  # more texts pass by their hash for the languages that aren't full
        below = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, hash_share(times * chars / max(1, n)))])
        some = labelled.where(F.col("h") <= F.element_at(below, F.col("lang"))).groupBy("lang", "h").agg(F.max("text").alias("text"))
        before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        # what stands after ``times`` the budget of raw characters is asked for only if folding leaves too little
        picked = some.withColumn("before", before).where(F.col("before") < times * chars).select("lang", "h", F.substring("text", 1, times * chars).alias("text")).collect()
        full = {}
        for r in sorted(picked, key=lambda r: (r["lang"], r["h"])):
            if len(full.get(r["lang"], "")) < chars and (piece := fold(r["text"])):
                full[r["lang"]] = (full.get(r["lang"], "") + piece + " ")[:chars]
        for lang, n in list(sizes.items()):
            if len(full.get(lang, "")) >= chars or times * chars >= n:
                if lang in full:
                    out[lang] = full[lang]
                del sizes[lang]
        times *= 8
    return out


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    held_out_of: int = 5,
    held_out: int = 0,
    sample_chars: int = 32_768,
) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row of ``docs``.

    Learns from labelled rows whose id's crc32 modulo ``held_out_of`` is not
    ``held_out``.  ``score`` is the share of the second-best language's phrases,
    weighted by the log of its sample's size, in those of the best two: 0.5 for a draw, towards 1 for a clear case.

    * null or empty text, or one without a letter: ``und``, score 0;
    * very long texts: parsed whole, in blocks of 1,024 symbols that each begin a
      phrase, so a text has at most one phrase more for each block;
    * ties go to the language that sorts first;
    * no labelled rows: ``und`` for all; one language: that, score 1;
    * null ids and repeated rows: a row each; empty table: no rows; other
      columns are ignored, whatever their names.
    """
    learned = samples(docs, id_col, text_col, lang_col, held_out_of, held_out, sample_chars)
    shipped = docs.sparkSession.sparkContext.broadcast(learned)
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches):
        parser = _parser(tuple(sorted(shipped.value.items())))
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                names, scores = parser.predict(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"]
                )

    held = F.pmod(crc32_of_id(F.col("doc_id")), F.lit(held_out_of)) == held_out
    return df.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double").select("doc_id", held.alias("held_out"), "lang_pred", "score")
