"""Token-id files: a concatenated id array with Elias-Fano document boundaries.

A file holds a run of documents in ascending id order.  The ends of the
documents within the array are a rising sequence; Elias-Fano keeps the low bits
of each packed side by side and the high parts in unary, about
``2 + log2(ids / documents)`` bits a document.  ``select(i)`` finds the i-th
one of the unary part from a sampled directory (32 bits for every 256
documents), so no table of 64-bit offsets exists on disk or in memory.

The bytes of a file are a binary column of a Parquet table in the shared
folder, so that any store that Spark reads and writes will do.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vestry.llm.common import new_table

MAGIC = b"VTOKENS1"
_HEAD = struct.Struct("<8sQQBBxxII")  # magic, documents, ids, bytes an id, low bits, bytes of the low and of the high part
_SAMPLE = 256
_POP = np.array([bin(b).count("1") for b in range(256)], dtype=np.int64)


class EliasFano:
    """A non-decreasing sequence of numbers from 0 up."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray | None = None):
        self.n, self.low_bits = n, low_bits
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        if samples is None:
            ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
            samples = ones[::_SAMPLE].astype(np.uint32)
        self.samples = samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        if not n:
            return cls(0, 0, b"", b"")
        low_bits = max(0, (int(v[-1]) // n).bit_length() - 1)
        bits = (v[:, None] >> np.arange(low_bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
        low = np.packbits(bits.ravel(), bitorder="little").tobytes()
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1, np.uint8)
        high[ones] = 1
        return cls(n, low_bits, low, np.packbits(high, bitorder="little").tobytes())

    def select(self, i: int) -> int:
        """Place of the i-th one of the high part."""
        at = int(self.samples[i // _SAMPLE])
        left = i % _SAMPLE  # ones to pass, from bit ``at`` on
        byte, bit = divmod(at, 8)
        first = int(self.high[byte]) >> bit << bit
        if (c := first.bit_count()) <= left:
            left -= c
            byte += 1
            while True:
                sums = np.cumsum(_POP[self.high[byte : byte + 64]])
                k = int(np.searchsorted(sums, left, side="right"))
                if k < len(sums):
                    left -= int(sums[k - 1]) if k else 0
                    byte += k
                    break
                left -= int(sums[-1])
                byte += 64
            first = int(self.high[byte])
        for _ in range(left):
            first &= first - 1
        return 8 * byte + (first & -first).bit_length() - 1

    def run(self, i: int, count: int) -> np.ndarray:
        """Numbers ``i`` to ``i + count - 1``: a select for the first, then the ones that follow it in the high part."""
        count = min(count, self.n - i)
        if count <= 0:
            return np.zeros(0, np.int64)
        at, last = self.select(i), self.select(i + count - 1)
        bits = np.unpackbits(self.high[at >> 3 : (last >> 3) + 1], bitorder="little")
        ones = np.flatnonzero(bits[at & 7 :])[:count] + at
        value = ones - np.arange(i, i + count) << self.low_bits
        if self.low_bits:
            lo = i * self.low_bits
            hi = lo + count * self.low_bits
            low = np.unpackbits(self.low[lo >> 3 : (hi + 7) >> 3], bitorder="little")[lo & 7 :][: hi - lo]
            value += low.reshape(count, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return value

    def __getitem__(self, i: int) -> int:
        value = self.select(i) - i << self.low_bits
        for k in range(self.low_bits):
            bit = i * self.low_bits + k
            value |= int(self.low[bit >> 3] >> (bit & 7) & 1) << k
        return value


def pack(documents: list[bytes], width: int = 2) -> bytes:
    """A file from the documents' ids, each little-endian of ``width`` bytes."""
    ends = np.cumsum([len(d) // width for d in documents]) if documents else np.zeros(0)
    ef = EliasFano.of(ends)
    low, high, samples = ef.low.tobytes(), ef.high.tobytes(), ef.samples.astype("<u4").tobytes()
    total = int(ends[-1]) if documents else 0
    head = _HEAD.pack(MAGIC, len(documents), total, width, ef.low_bits, len(low), len(high))
    return b"".join([head, low, high, samples, *documents])


class TokenFile:
    """Reads a file's bytes; ids are views, not copies."""

    def __init__(self, data: bytes):
        magic, n, total, width, low_bits, n_low, n_high = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = _HEAD.size
        low, high = data[at : at + n_low], data[at + n_low : at + n_low + n_high]
        at += n_low + n_high
        n_samples = -(-n // _SAMPLE)
        samples = np.frombuffer(data, "<u4", n_samples, at)
        self.ends = EliasFano(n, low_bits, low, high, samples)
        self.all_ids = np.frombuffer(data, f"<u{width}", total, at + 4 * n_samples)
        self.n, self.total = n, total

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends[i - 1] if i else 0), self.ends[i]

    def ids(self, i: int) -> np.ndarray:
        lo, hi = self.bounds(i)
        return self.all_ids[lo:hi]

    def runs(self, count: int = _SAMPLE):
        """Starts and ends of all documents, ``count`` of them at a time, by way of select."""
        before = 0
        for i in range(0, self.n, count):
            ends = self.ends.run(i, count)
            yield np.concatenate([[before], ends[:-1]]), ends
            before = int(ends[-1])


#: The pieces a byte-level vocabulary of this kind cuts a text into before merging, for
#: characters below U+0250; letters and numbers of that range are spelled out.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBER = "0-9²³¹¼½¾"
PIECES = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\s{_LETTER}{_NUMBER}]+|\s+(?!\S)|\s+"
)
#: Bytes of Latin-1 that are no controls; a text with other characters below U+0250 is searched, any beyond go to the library.
_PLAIN = bytes(b for b in range(256) if b not in range(9) and b not in range(14, 32) and b not in range(127, 160))
_STRANGE = re.compile("[\x00-\x08\x0e-\x1f\x7f-\x9f]|[^\x00-ɏ]")


def is_plain(text: str) -> bool:
    """Whether :data:`PIECES` cuts the text as the library does."""
    try:
        return not text.encode("latin-1").translate(None, _PLAIN)
    except UnicodeEncodeError:
        return not _STRANGE.search(text)


def byte_level(file: dict) -> bool:
    """Whether a tokenizer's file says what :data:`PIECES` is written for."""
    cut, model = file.get("pre_tokenizer") or {}, file.get("model") or {}
    plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    merges = model.get("type", "BPE") == "BPE" and not any(
        model.get(k) for k in ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")
    )
    added = all(not any(t.get(k) for k in ("lstrip", "rstrip", "single_word")) for t in file.get("added_tokens") or [])
    return plain and merges and added and file.get("normalizer") is None


def byte_symbols() -> list[str]:
    """How a byte-level vocabulary writes bytes: printable ones as themselves, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(rest)) for b in range(256)]


class ByteLevelEncoder(dict):
    """The library's ids, with a bounded memory of the pieces that its model has encoded before.

    A text is cut into the pieces that merges don't cross; the library's model
    encodes each new piece.  Texts that the cut isn't certain for go to the
    library whole: those with unusual characters, those that hold a special
    token's string (which the library makes that token), and every text if the
    file's normalizer, pre-tokenizer or model aren't those that the cut is
    written for (``cuts`` is then false).  The memory has two generations, so
    that frequent pieces stay when it is full.
    """

    def __init__(self, file: str, memo: int = 200_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(file)
        self.model = self.library.model
        with open(file, encoding="utf-8") as f:
            self.cuts = byte_level(json.load(f))
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.symbols = byte_symbols()
        self.size, self.old = memo, {}

    def piece(self, text: str) -> list[int]:
        symbols = self.symbols
        return [t.id for t in self.model.tokenize("".join([symbols[b] for b in text.encode()]))]

    def sure(self, text: str) -> bool:
        return self.cuts and is_plain(text) and not self.special.search(text)

    def ids(self, text: str) -> list[int]:
        if not self.sure(text):
            return self.library.encode(text, add_special_tokens=False).ids
        return [i for p in PIECES.findall(text) for i in self.piece(p)]

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = np.array(self.piece(piece), dtype=self.kind).tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian bytes."""
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()
        get = self.__getitem__
        return [
            b"".join(map(get, PIECES.findall(t))) if self.sure(t) else np.array(self.ids(t), dtype=self.kind).tobytes() for t in texts
        ]


@lru_cache(maxsize=1)
def _encoder(file: str, memo: int) -> ByteLevelEncoder:
    """One encoder a worker process; its memory outlives a task."""
    return ByteLevelEncoder(file, memo)


def write_files(
    docs: DataFrame,
    tokenizer_file: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    file_ids: int = 1 << 20,
    memo: int = 200_000,
) -> str:
    """Encodes all texts in ascending id order into files; returns the table's folder.

    The table has one row per file: ``part, seq, before`` (ids in the part's
    earlier files), ``n_ids, doc_ids, payload``.  A range partition is a part;
    equal ids are told apart by a hash of the text, so a frequent id spreads.
    """
    spark = docs.sparkSession
    path = new_table(spark, "tokens")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    df = df.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")

    def run(batches):
        enc = _encoder(tokenizer_file, memo)
        end = np.array([end_id], dtype=enc.kind).tobytes()
        part, seq, before, held, ids, size = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def file():
            cols = [pa.array([part]), pa.array([seq]), pa.array([before], pa.int64()), pa.array([size], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([pack(held, enc.width)], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["part", "seq", "before", "n_ids", "doc_ids", "payload"])

        for whole in batches:
            for lo in range(0, whole.num_rows, 128):
                batch = whole.slice(lo, 128)
                texts = [t or "" for t in batch.column("text").to_pylist()]
                for doc, raw in zip(batch.column("doc_id").to_pylist(), enc.encode(texts)):
                    held.append(raw + end)
                    ids.append(doc)
                    size += len(held[-1]) // enc.width
                    if size >= file_ids:
                        yield file()
                        seq, before, held, ids, size = seq + 1, before + size, [], [], 0
        if held:
            yield file()

    df.mapInArrow(run, "part long, seq long, before long, n_ids long, doc_ids array<long>, payload binary").write.parquet(path)
    return path


def read_boundaries(spark, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in a folder of files.

    One number per part comes to the driver: how many ids the part has.
    """
    files = spark.read.parquet(path)
    offsets, total = {}, 0
    for r in sorted(files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()):
        offsets[r["part"]] = total
        total += r["n"]
    shipped = spark.sparkContext.broadcast(offsets)

    def run(batches):
        for whole in batches:
            for k in range(whole.num_rows):
                batch = whole.slice(k, 1)
                f = TokenFile(batch.column("payload")[0].as_py())
                base = shipped.value[batch.column("part")[0].as_py()] + batch.column("before")[0].as_py()
                doc_ids, at = batch.column("doc_ids").flatten(), 0
                for starts, ends in f.runs(16 * _SAMPLE):
                    lo = int(starts[0])
                    wide = f.all_ids[lo : int(ends[-1])].astype("<u4")
                    crc = [zlib.crc32(wide[a:b]) for a, b in zip((starts - lo).tolist(), (ends - lo).tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [doc_ids.slice(at, len(ends)), pa.array(starts + base), pa.array(ends - starts), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    at += len(ends)

    return files.select("part", "before", "doc_ids", "payload").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def tokenize(docs: DataFrame, tokenizer_file: str, end_id: int, **parameters) -> DataFrame:
    """Writes the files and reads their boundaries and ids back.

    Ids are the library's for the text, ``add_special_tokens=False``: a special
    token's string in a text becomes that token.

    * null or empty text: only the end id; very long texts: encoded whole, in a
      file of their own if they have over ``file_ids`` ids;
    * null ids come first; ties: rows of one id are ordered by a hash of their text,
      rows that repeat both in any order (their ids are the same);
    * empty table: no files' rows, no rows; other columns are ignored.
    """
    return read_boundaries(docs.sparkSession, write_files(docs, tokenizer_file, end_id, **parameters))
