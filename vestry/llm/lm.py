"""Language-model scores of whole texts.

Two things are learned from the training documents: the counts of all words of
all of them, a distributed table that grows with the corpus; and a causal
self-attention model over subword units (:mod:`vestry.llm.attention`), started
in numpy on a bounded sample and then trained, partition by partition, on the
whole texts of all training rows.  A word's probability is a mixture of its
smoothed share and of the product of its units' probabilities; a word's last
unit is marked, so units spell each word in one way and the parts of the
mixture add up.

Counts of the most frequent words travel to the workers as a table of a fixed
size, those of very long words by their hash.  What is rarer in the training
texts meets its count in a shuffle join on the word's hash; words that occur
often all the same, in texts that aren't learned from, are few and are joined
from a broadcast table.
"""

from __future__ import annotations

import json
import pickle
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vestry.llm import attention
from vestry.llm.common import crc32_of_id, hash_share, written
from vestry.llm.tokenfiles import ByteLevelEncoder
from vestry.llm.words import Counts, KeyTable, Words, slices

#: The end of a text stands in the table of counts as the empty word.
END = b""
#: Bytes of a word from which on the shipped table keeps its hash instead.
LONG = 64
#: A word of more than one in so many of the occurrences that are to be joined is joined from a broadcast table.
HOT = 4096


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased; words are what ASCII white space separates."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_counts(docs: DataFrame, text_col: str = "text", at_once: int = 400_000) -> DataFrame:
    """``w binary, c long`` of every word of every row, one end for each row included."""

    def run(batches):
        counts, ends = Counts(), 0
        for batch in slices(batches):
            counts.add(Words(batch.column("text")))
            ends += batch.num_rows
            if counts.used > at_once:
                yield pa.RecordBatch.from_arrays(list(counts.take()), names=["w", "c"])
        yield pa.RecordBatch.from_arrays(list(counts.take()), names=["w", "c"])
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([ends], pa.int64())], names=["w", "c"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))


#: Bytes of words that the pieces' pattern surely cuts like the library: printable ASCII and letters up to U+023F.
_SURE = bytes([*range(33, 127), *range(0x80, 0xC0), *range(0xC3, 0xC9)])


#: The cut before merging of a byte-level vocabulary of this kind.
CUT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def by_rank(tokenizer_file: str, symbols: list[str]):
    """An encoder that merges by rank, for a vocabulary whose ids are in the order of its merges; None for others.

    It gives the same ids as the library in a third of the time.
    """
    import tiktoken

    with open(tokenizer_file, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocabulary = model["vocab"]
    merged = (vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in model["merges"])
    if any(a != b for a, b in zip(merged, range(256, 1 << 30))) or any(vocabulary.get(c, 256) > 255 for c in symbols):
        return None
    byte_of = {c: b for b, c in enumerate(symbols)}
    ranks = {bytes(byte_of[c] for c in token): n for token, n in vocabulary.items() if n < 256 + len(model["merges"])}
    return tiktoken.Encoding("units", pat_str=CUT, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _encoders(tokenizer_file: str):
    """The library's encoder and that by rank, once a process."""
    library = ByteLevelEncoder(tokenizer_file)
    return library, by_rank(tokenizer_file, library.symbols)


class Units:
    """Subword units of words: (token id, whether it ends the word).

    The vocabulary is closed: the most frequent units of the corpus's frequent
    words, and every byte, as an inner and as a last unit.
    """

    def __init__(self, tokenizer_file: str, chosen: list[int]):
        self.encoder, self.ranked = _encoders(tokenizer_file)
        if not self.encoder.cuts:
            raise ValueError("only a byte-level vocabulary is supported")
        self.number = {u: k for k, u in enumerate(chosen)}
        self.first_byte = len(chosen)
        self.end = len(chosen) + 512
        self.byte_of = {c: b for b, c in enumerate(self.encoder.symbols)}
        (self.gap,) = self.encoder.piece("\n")
        self.numbers = np.full(2 * self.encoder.library.get_vocab_size(), -1, np.int32)
        self.numbers[chosen] = np.arange(len(chosen))

    def raw(self, words: list[bytes], at_once: int = 1000) -> tuple[np.ndarray, np.ndarray]:
        """``2 * id + last`` of the tokens of all words, and how many each word has."""
        parts = [self._raw(words[k : k + at_once]) for k in range(0, len(words), at_once)] or [self._raw([])]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _raw(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Many words are encoded in one call, line ends between them: a line end
        between two characters that aren't blank is a token of its own."""
        lengths = np.zeros(len(words), np.int64)
        joined = b"\n".join(words)
        if all(words) and not joined.translate(None, _SURE + b"\n"):
            sure = range(len(words))
        else:
            sure = [k for k, w in enumerate(words) if w and not w.translate(None, _SURE)]
            joined = b"\n".join([words[k] for k in sure])
        found: dict[int, list[int]] = {}
        ids, owner = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if sure:
            text = joined.decode()
            ids = self.ranked.encode_to_numpy(text).astype(np.int64) if self.ranked else np.array(self.encoder.ids(text), np.int64)
            gaps = ids == self.gap
            owner = np.array(sure)[np.cumsum(gaps)[~gaps]]
            ids = ids[~gaps]
        odd = sorted(set(range(len(words))) - set(sure)) if len(sure) < len(words) else ()
        for k in odd:
            found[k] = self.encoder.ids(words[k].decode("utf-8", "replace"))
        if found:
            ids = np.concatenate([ids, np.array([i for x in found.values() for i in x], np.int64)])
            owner = np.concatenate([owner, np.repeat(list(found), [len(x) for x in found.values()])])
            order = np.argsort(owner, kind="stable")
            ids, owner = ids[order], owner[order]
        np.add.at(lengths, owner, 1)
        ids = 2 * ids
        if len(ids):
            ids[np.append(owner[1:] != owner[:-1], True)] += 1
        return ids, lengths

    def spelled(self, unit: int) -> list[int]:
        """A unit as its number, or as those of its bytes."""
        if (k := self.number.get(unit)) is not None:
            return [k]
        token = self.encoder.library.id_to_token(unit >> 1)
        numbers = [self.first_byte + 2 * self.byte_of[c] for c in token]
        numbers[-1] += unit & 1
        return numbers

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Unit numbers of all words, and how many each word has."""
        raw, lengths = self.raw(words)
        numbers = self.numbers[raw]
        lacking = np.flatnonzero(numbers < 0)
        if not len(lacking):
            return numbers, lengths
        spelled = [self.spelled(u) for u in raw[lacking].tolist()]
        more = np.array([len(x) for x in spelled])
        times = np.ones(len(raw), np.int64)
        times[lacking] = more
        out = np.repeat(numbers, times)
        out[out < 0] = [k for x in spelled for k in x]
        owner = np.repeat(np.arange(len(words)), lengths)
        return out, np.bincount(owner, times, len(words)).astype(np.int64)


@dataclass
class Model:
    """All that a worker needs; bounded by ``top``, ``units`` and the sizes of the attention model.

    The frequent words stand in arrays, number ``k`` of each for the k-th word;
    number 0 is a text's end.
    """

    tokenizer_file: str
    chosen: list[int]
    shape: attention.Shape
    parameters: dict
    keys: np.ndarray
    hashes: np.ndarray
    lengths: np.ndarray
    units: np.ndarray
    shares: np.ndarray  # log10, NaN for an end that was never seen
    long_shares: dict[int, float]  # by the word's hash
    least: int  # the smallest count among the frequent words
    mix: float


def _hashes(words: list[bytes]) -> np.ndarray:
    """Spark's ``xxhash64`` of the words."""
    import xxhash

    return np.array([xxhash.xxh64_intdigest(w, 42) for w in words], dtype=np.uint64).view(np.int64)


def _fitted(tokenizer_file: str, rows: list, texts: list[str], units: int, steps: int, total: float, mix: float) -> Model:
    """``rows`` are frequent words with their counts, long ones as hashes; ``total`` is what shares are taken of."""
    frequent = dict(rows)
    words = [w for w in frequent if w != END and isinstance(w, bytes)]
    counts = np.array([frequent[w] for w in words], np.int64)
    encoder = Units(tokenizer_file, [])
    raw, n = encoder.raw(words)
    found, of = np.unique(raw, return_inverse=True)
    seen = np.bincount(of, np.repeat(counts, n), len(found)).astype(np.int64)
    ranked = np.lexsort((found, -seen))[:units]
    encoder = Units(tokenizer_file, found[ranked].tolist())
    shape = attention.Shape(units=encoder.end + 2, head=min(128, encoder.end), cluster=128, hidden=32)
    prior = np.concatenate([seen[ranked], np.ones(512), [max(1, frequent.get(END, 1))]])
    numbers, sizes = [], []
    for t in texts:
        u, _ = encoder.of(words_of(t))
        numbers += [u, [encoder.end]]
        sizes.append(len(u) + 1)
    sample = np.concatenate(numbers) if numbers else np.zeros(0)
    parameters = attention.train(sample.astype(np.int32), np.array(sizes, np.int64), prior, shape, steps=steps)
    spelled, lengths = encoder.of(words)
    share = lambda c: np.log10((c + 0.1) / total)
    end_share = share(frequent[END]) if END in frequent else np.nan
    return Model(
        tokenizer_file, list(encoder.number), shape, parameters,
        Words.of(words).key if words else np.zeros(0, np.uint64), _hashes(words), lengths.astype(np.int32), spelled.astype(np.int32),
        np.concatenate([[end_share], share(counts)]), {h: float(share(c)) for h, c in frequent.items() if isinstance(h, int)},
        int(min(frequent.values(), default=0)), mix,
    )


def fit(
    train: DataFrame, counts: DataFrame, tokenizer_file: str, text_col: str, order, top: int, units: int, sample_rows: int, sample_chars: int, steps: int, mix: float
) -> tuple[Model, int, float, int]:
    """Learns the units and the frequent words, and gives the attention model its start.

    The start is made on a bounded sample: ``sample_rows`` pieces of
    ``sample_chars`` characters, those of the smallest hash of all pieces of all
    texts, wherever they stand.  :func:`refine` goes on from there over whole
    texts.  One task does it, so that a lost executor means a new attempt.
    Returns the model, the number of training tokens, what shares are taken of
    and the number of training texts.
    """
    banded = counts.withColumn("band", F.floor(F.log2("c") * 16))
    # bands of counts, some hundreds at most, tell how far down the frequent words reach, so that only they are sorted
    facts = banded.groupBy("band").agg(F.count("*").alias("words"), F.sum("c").alias("c"), F.sum(F.when(F.octet_length("w") == 0, F.col("c"))).alias("texts"))
    bands = sorted(facts.collect(), reverse=True)
    n, v, texts_seen = (sum(r[k] or 0 for r in bands) for k in ("c", "words", "texts"))
    total = n + 0.1 * (v + 1)
    lowest, left = 0, top
    for r in bands:
        lowest, left = r["band"], left - r["words"]
        if left <= 0:
            break
    long = F.octet_length("w") > LONG
    named = banded.where(F.col("band") >= lowest).select(F.when(long, F.unhex(F.lpad(F.hex(F.xxhash64("w")), 16, "0"))).otherwise(F.col("w")).alias("w"), "c", long.alias("hashed"))
    words = named.orderBy(F.desc("c"), "hashed", "w").limit(top).select("w", "c", "hashed", F.lit(None).cast("string").alias("text"))
    last = F.expr(f"cast(greatest(length(text) - 1, 0) div {sample_chars} as int)")
    whole = train.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), order.alias("h"))
    pieces = whole.agg(F.sum(last + 1)).first()[0] or 0
    below = hash_share((2 * sample_rows + 200) / max(1, pieces))  # else each partition would send as many
    picked = F.filter(F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(F.xxhash64("h", k).alias("h"), k.alias("k"))), lambda x: x["h"] <= below)
    texts = (
        whole.select("text", F.explode(picked).alias("p"))
        .select(F.substr("text", F.col("p.k") * sample_chars + 1, F.lit(sample_chars)).alias("text"), "p.h")
        .orderBy("h", "text")
        .limit(sample_rows)
        .select(F.lit(None).cast("binary").alias("w"), F.lit(None).cast("long").alias("c"), F.lit(False).alias("hashed"), "text")
    )

    def run(batches):
        rows, sample = [], []
        for batch in batches:
            for w, c, hashed, text in zip(*(batch.column(k).to_pylist() for k in ("w", "c", "hashed", "text"))):
                if text is None:
                    rows.append((int.from_bytes(w, "big", signed=True) if hashed else w, c))
                else:
                    sample.append(text)
        model = _fitted(tokenizer_file, rows, sample, units, steps, total, mix)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    got = words.union(texts).coalesce(1).mapInArrow(run, "model binary").first()
    return pickle.loads(bytes(got["model"])), n, total, texts_seen


class UnitTable:
    """Numbers words as they come and keeps their units in arrays; number 0 is a text's end."""

    def __init__(self, tokenizer_file: str, chosen: list[int], size: int = 500_000):
        self.units, self.size = Units(tokenizer_file, chosen), size
        self.flat = np.zeros(1 << 16, np.int32)
        self.start, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.used, self.count, self.table = 0, 0, KeyTable()
        self._put(np.array([self.units.end]), np.array([1]))
        self._base = self.used, self.count, self.table.copy()

    def keep(self) -> None:
        """What is there now stays when the table is full."""
        self._base = self.used, self.count, self.table.copy()

    def _grow(self, name: str, n: int) -> None:
        while len(getattr(self, name)) < n:
            old = getattr(self, name)
            setattr(self, name, np.concatenate([old, np.zeros_like(old)]))

    def _put(self, units: np.ndarray, lengths: np.ndarray) -> None:
        k, n = self.count, len(lengths)
        for name in ("start", "length"):
            self._grow(name, k + n)
        self._grow("flat", self.used + len(units))
        self.flat[self.used : self.used + len(units)] = units
        self.start[k : k + n] = self.used + np.cumsum(lengths) - lengths
        self.length[k : k + n] = lengths
        self.used += len(units)
        self.count += n

    def add(self, keys: np.ndarray, words: list[bytes]) -> None:
        """New and distinct words."""
        if words:
            self.table.add(keys, (self.count + np.arange(len(words))).astype(np.int32))
            self._put(*self.units.of(words))

    def numbered(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words of a column of texts, each text's end included, and how many each text has."""
        if self.count > self.size:
            self.used, self.count, table = self._base
            self.table = table.copy()
        words = Words(column)
        number = self.table.find(words.key)
        new = np.flatnonzero(number < 0)
        if len(new):
            keys, first = np.unique(words.key[new], return_index=True)
            self.add(keys, words.bytes(new[first]))
            number[new] = self.table.find(words.key[new])
        n = words.per_text + 1
        index = np.zeros(int(n.sum()), np.int64)
        index[np.arange(len(number)) + np.repeat(np.arange(len(n)), words.per_text)] = number
        return index, n

    def spelled(self, index: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Units of numbered words one after another, where each word's begin, and how many units each text has."""
        lengths = self.length[index].astype(np.int64)
        ends = np.cumsum(lengths)
        begin = ends - lengths
        units = self.flat[np.repeat(self.start[index] - begin, lengths) + np.arange(int(ends[-1]))]
        return units, begin, np.add.reduceat(lengths, np.cumsum(n_words) - n_words)


@lru_cache(maxsize=1)
def _unit_table(file: str, chosen: tuple[int, ...]) -> UnitTable:
    """One table a worker process, for all rounds of training."""
    return UnitTable(file, list(chosen))


def _summed(rows) -> tuple[list[np.ndarray] | None, int]:
    """Sum of parameters, each already times its weight, and of the weights."""
    total, weight = None, 0
    for blob, w in rows:
        arrays = pickle.loads(blob)
        total = arrays if total is None else [a + b for a, b in zip(total, arrays)]
        weight += w
    return total, weight


def refine(
    model: Model, train: DataFrame, text_col: str, order, texts_seen: int, share: float, least_rows: int, rounds: int = 4, rate: float = 1e-3
) -> tuple[Model, int]:
    """Goes on training on the whole texts of ``share`` of all rows, those of at least ``least_rows``.

    The rows are dealt into rounds by their hash.  In each, every partition
    makes one pass over its own texts from the parameters that all share, and
    the mean of what they reach, weighted by units, is where the next round
    begins.  So both the texts and the steps grow with the corpus.  Partial sums
    are made in the square root of so many tasks, and these alone reach the
    driver.  Returns the model and the number of units that it was trained on.
    """
    share = min(1.0, max(share, least_rows / max(1, texts_seen)))
    sample = train.select(F.col(text_col).alias("text"), order.alias("h")).where(F.col("h") <= hash_share(share))
    sample = sample.select("text", F.pmod(F.xxhash64("h"), F.lit(rounds)).cast("int").alias("turn"))
    if share < 1:  # a copy of all texts would cost more than to read them again in each round
        sample = written(sample, "sample")
    fields, done = "p binary, n long", 0

    def packed(total, weight):
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary()), pa.array([weight], pa.int64())], names=["p", "n"])

    def add(batches):
        total, weight = _summed((b, w) for batch in batches for b, w in zip(batch.column("p").to_pylist(), batch.column("n").to_pylist()))
        if weight:
            yield packed(total, weight)

    for turn in range(rounds):
        shipped = train.sparkSession.sparkContext.broadcast(
            (model.tokenizer_file, model.chosen, model.shape, model.parameters, rate * (1 - turn / rounds))
        )

        def run(batches, shipped=shipped):
            file, chosen, shape, start, lr = shipped.value
            adam, seen = None, 0
            for batch in slices(batches, 1 << 19):
                if adam is None:
                    table = _unit_table(file, tuple(chosen))
                    adam = attention.Adam({k: v.copy() for k, v in start.items()})
                units, _, lengths = table.spelled(*table.numbered(batch.column("text")))
                attention.train_once(adam, units, lengths, shape, lr)
                seen += len(units)
            if seen:
                yield packed([v.astype(np.float64) * seen for v in adam.p.values()], seen)

        reached = sample.where(F.col("turn") == turn).select("text").mapInArrow(run, fields)
        few = max(1, int(sample.rdd.getNumPartitions() ** 0.5))
        total, weight = _summed((bytes(r["p"]), r["n"]) for r in reached.repartition(few).mapInArrow(add, fields).collect())
        if weight:
            mean = {k: (a / weight).astype(np.float32) for k, a in zip(model.parameters, total)}
            if all(np.isfinite(a).all() for a in mean.values()):
                model.parameters = mean
                done += weight
        shipped.destroy()
    return model, done


def mixed(uni, att, mix: float):
    """log10 of the mixture of two log10 probabilities."""
    a, b = uni + np.log10(mix), att + np.log10(1 - mix)
    top = np.maximum(a, b)
    return top + np.log10(10 ** (a - top) + 10 ** (b - top))


class WordTable(UnitTable):
    """Also keeps words' shares and hashes; the frequent words stay when it is full."""

    def __init__(self, model: Model, size: int = 500_000):
        super().__init__(model.tokenizer_file, model.chosen, size)
        self.mix, self.long_shares = model.mix, model.long_shares
        self.score = attention.Scorer(model.parameters, model.shape)
        n = len(model.keys)
        self.table.add(model.keys, 1 + np.arange(n, dtype=np.int32))
        self._put(model.units, model.lengths)
        self.share, self.hash = np.full(n + 1, np.nan), np.zeros(n + 1, np.int64)
        self.share[:], self.hash[1:] = model.shares, model.hashes
        self.keep()

    def add(self, keys, words):
        """Words that come later than the frequent ones are rare and have no share, unless they are long."""
        k, n = self.count, len(words)
        super().add(keys, words)
        self._grow("share", k + n)
        self._grow("hash", k + n)
        self.share[k : k + n] = np.nan
        self.hash[k : k + n] = _hashes(words)
        for i in [i for i, w in enumerate(words) if len(w) > LONG] if self.long_shares else ():
            self.share[k + i] = self.long_shares.get(int(self.hash[k + i]), np.nan)

    def texts(self, column: pa.Array):
        """Per text: words with the end, those known to be frequent, base and score of these; and the rare rest."""
        index, n_words = self.numbered(column)
        units, begin, per_text = self.spelled(index, n_words)
        first = np.cumsum(n_words) - n_words
        att = np.add.reduceat(self.score(units, per_text), begin)
        share = self.share[index]
        rare = np.isnan(share)
        base = np.where(rare, 0, share)
        score = np.where(rare, 0, mixed(base, att, self.mix))
        return (
            n_words,
            np.add.reduceat((~rare).astype(np.int64), first),
            np.add.reduceat(base, first),
            np.add.reduceat(score, first),
            np.add.reduceat(rare.astype(np.int64), first),
            self.hash[index[rare]],
            att[rare],
        )


@lru_cache(maxsize=1)
def _table(shipped) -> WordTable:
    """One table a worker process, in place of that of training."""
    _unit_table.cache_clear()
    return WordTable(pickle.loads(shipped.value))


def score(
    docs: DataFrame,
    tokenizer_file: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    held_out_of: int = 10,
    held_out: int = 0,
    top: int = 200_000,
    units: int = 1536,
    sample_rows: int = 1500,
    sample_chars: int = 6000,
    steps: int = 500,
    mix: float = 0.5,
    train_share: float = 1.0,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row of ``docs``.

    Rows whose id's crc32 modulo ``held_out_of`` is not ``held_out`` are learned
    from: words of all of them, the attention model of the whole texts of
    ``train_share`` of them, which is all unless it is made smaller.  Scores are log10 probabilities of a text's words and its end.

    * null or empty text: only the end;
    * very long texts: learned from and scored whole, in chunks of windows that
      overlap; very long words: as many units as it takes;
    * repeated rows and null ids: a row each, all counted;
    * ties: words of one count are ranked by their bytes, units by their number;
    * nothing to learn from: every count is 0; the scores are what smoothing and
      an untrained model give;
    * empty table: no rows; other columns are ignored, whatever their names.
    """
    held = F.pmod(crc32_of_id(F.col(id_col)), F.lit(held_out_of)) == held_out
    train = docs.where(~held)
    counts = written(word_counts(train, text_col), "counts")
    order = F.xxhash64(F.col(id_col), F.col(text_col), F.lit(23))
    model, n_train, total, texts_seen = fit(train, counts, tokenizer_file, text_col, order, top, units, sample_rows, sample_chars, steps, mix)
    model, _ = refine(model, train, text_col, order, texts_seen, train_share, sample_rows)
    shipped = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    df = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches):
        table = _table(shipped)
        for batch in slices(batches, 1 << 19):
            n, known, base, logp, n_rare, hashes, att = table.texts(batch.column("text"))
            offsets = pa.array(np.concatenate([[0], np.cumsum(n_rare)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("uid"),
                    batch.column("doc_id"),
                    pa.array(n),
                    pa.array(known),
                    pa.array(base),
                    pa.array(logp),
                    pa.ListArray.from_arrays(offsets, pa.array(hashes)),
                    pa.ListArray.from_arrays(offsets, pa.array(att.astype(np.float32))),
                ],
                names=["uid", "doc_id", "n_tokens", "known", "base", "score", "h", "att"],
            )

    scored = df.mapInArrow(run, f"uid long, doc_id {kind}, n_tokens long, known long, base double, score double, h array<long>, att array<float>")
    scored = written(scored, "scored")
    rare = scored.select("uid", F.explode(F.arrays_zip("h", "att")).alias("r")).select("uid", "r.h", "r.att")
    # a superset of the words that are not in the shipped table; a word that often lacks there is joined from a broadcast
    known = counts.where((F.col("c") <= model.least) | (F.octet_length("w") > LONG)).select(F.xxhash64("w").alias("h"), "c")
    asked = scored.agg(F.sum(F.col("n_tokens") - F.col("known"))).first()[0] or 0
    often = written(rare.groupBy("h").agg(F.count("*").alias("times")).where(F.col("times") > max(64, asked / HOT)).select("h"), "often")
    if often.isEmpty():
        counted = rare.join(known, "h", "left")
    else:
        there = F.broadcast(written(often.join(known, "h", "left"), "often"))
        counted = rare.join(there, "h").unionByName(rare.join(there.select("h"), "h", "left_anti").join(known, "h", "left"))
    share = F.log10((F.coalesce("c", F.lit(0)) + 0.1) / F.lit(total))
    uni, att = share + float(np.log10(mix)), F.col("att").cast("double") + float(np.log10(1 - mix))
    best = F.greatest(uni, att)
    both = best + F.log10(F.pow(F.lit(10.0), uni - best) + F.pow(F.lit(10.0), att - best))
    more = counted.groupBy("uid").agg(F.sum(share).alias("base_more"), F.sum(both).alias("score_more"), F.count("c").alias("known_more"))
    zero = F.lit(0)
    return scored.join(more, "uid", "left").select(
        "doc_id",
        (F.pmod(crc32_of_id(F.col("doc_id")), F.lit(held_out_of)) == held_out).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("known_more", zero)).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_more", zero)).alias("base_score"),
        F.round(F.col("score") + F.coalesce("score_more", zero), 5).alias("score"),  # beyond that is rounding of 32-bit products
    )
