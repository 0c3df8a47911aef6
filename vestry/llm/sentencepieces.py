"""Exact merge-type SentencePiece encoding by backtracking, and decoding.

A merge-type (BPE) encoding is the one sequence of tokens in which every
adjacent pair, merged anew, yields that same pair.  So the encoder goes left to
right with the longest token of the vocabulary at each place (found for all
places at once by an Aho-Corasick automaton), checks it against the token
before it by re-merging the two, and on a clash tries the next shorter token or
steps back; a bitfield of places from which no way leads on keeps this linear.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"


class Memo(dict):
    """A bounded memory in two generations: what is asked again outlives a full one."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.old = size, {}

    def keep(self, key, value):
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class BacktrackingEncoder:
    """Encodes like the library does for a BPE model with byte fallback.

    ``memo`` bounds how many words and pairs are kept from text to text.
    """

    def __init__(self, model_file: str, memo: int = 300_000):
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        model = pb.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or norm.precompiled_charsmap or not norm.escape_whitespaces:
            raise ValueError("only a BPE model that leaves characters as they are is supported")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        self.squeeze = norm.remove_extra_whitespaces
        kinds = type(model.pieces[0])
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.text = [p.piece for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        if any(c not in self.ids for p in self.ids for c in p):
            raise ValueError("only a model whose every character is a piece is supported")
        self.score = {p: model.pieces[i].score for p, i in self.ids.items()}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.unk = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        #: whether every piece has its spaces at its start, so that words are independent
        self.by_word = not any(a != SPACE and b == SPACE for p in self.ids for a, b in zip(p, p[1:]))
        self.automaton = ahocorasick.Automaton()
        self.shorter = [-1] * len(self.text)  # the next shorter token with the same start
        for p, i in self.ids.items():
            self.automaton.add_word(p, (len(p) - 1, i))
            for k in range(len(p) - 1, 0, -1):
                if (j := self.ids.get(p[:k])) is not None:
                    self.shorter[i] = j
                    break
        self.automaton.make_automaton()
        self.size = [len(p) for p in self.text]
        self.pairs = Memo(2 * memo)
        self.words = Memo(memo)

    def merge(self, text: str) -> list[str]:
        """Plain merging of a short string: best score first, leftmost among equals."""
        sym = list(text)
        nxt = list(range(1, len(sym))) + [-1]
        prv = list(range(-1, len(sym) - 1))
        heap: list = []

        def push(i):
            j = nxt[i]
            if j >= 0 and (s := self.score.get(sym[i] + sym[j])) is not None:
                heapq.heappush(heap, (-s, i, sym[i] + sym[j], j))

        for i in range(len(sym) - 1):
            push(i)
        while heap:
            _, i, whole, j = heapq.heappop(heap)
            if not sym[i] or nxt[i] != j or sym[i] + sym[j] != whole:
                continue
            sym[i], sym[j] = whole, ""
            nxt[i] = nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
            if prv[i] >= 0:
                push(prv[i])
            push(i)
        return [s for s in sym if s]

    def compatible(self, a: int, b: int) -> bool:
        """Whether two tokens side by side, merged anew, stay as they are; ``a`` -1: nothing before."""
        key = a << 32 | b
        if (known := self.pairs.old.get(key)) is None:
            parts = [self.text[b]] if a < 0 else [self.text[a], self.text[b]]
            known = self.merge("".join(parts)) == parts
        return self.pairs.keep(key, known)

    def backtrack(self, text: str) -> list[int]:
        """Ids of a string of characters that all are pieces."""
        n = len(text)
        longest = [0] * n
        for end, (back, token) in self.automaton.iter(text):
            longest[end - back] = token  # ends only grow
        dead = bytearray(n + 1)  # places from which no way leads on
        known, size, shorter = self.pairs, self.size, self.shorter
        out: list[int] = []
        at, last, token = 0, -1, longest[0]
        while at < n:
            end = at + size[token]
            if not dead[end]:
                ok = known.get(last << 32 | token)
                if self.compatible(last, token) if ok is None else ok:
                    out.append(token)
                    at, last = end, token
                    if at < n:
                        token = longest[at]
                    continue
            token = shorter[token]
            while token < 0:  # nothing fits here: step back
                dead[at] = 1
                if not out:
                    raise AssertionError("a merge encoding always exists")
                last = out.pop()
                at -= size[last]
                token = shorter[last]
                last = out[-1] if out else -1
        return out

    def to_ids(self, text: str) -> list[int]:
        """Ids of any string; a character that is no piece merges with nothing and becomes bytes."""
        if not (strange := {c for c in set(text) if c not in self.ids}):
            return self.backtrack(text)
        out: list[int] = []
        run = 0
        for i, c in enumerate(text + "\0"):
            if i == len(text) or c in strange:
                if run < i:
                    out += self.backtrack(text[run:i])
                if i < len(text):
                    out += [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")] if self.bytes else [self.unk]
                run = i + 1
        return out

    def word(self, word: str) -> tuple[int, ...]:
        known = self.words.old.get(word) or tuple(self.to_ids(word))
        return self.words.keep(word, known) if len(word) <= 64 else known

    def encode(self, text: str) -> list[int]:
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return []
        text = self.prefix + text.replace(" ", SPACE)
        if not self.by_word:
            return self.to_ids(text)
        parts = text.split(SPACE)
        # a run of spaces goes to the word after it
        words, gap = [], 0
        if parts[0]:
            words.append(parts[0])
        gap = 1
        for p in parts[1:]:
            if p:
                words.append(SPACE * gap + p)
                gap = 1
            else:
                gap += 1
        if gap > 1:
            words.append(SPACE * (gap - 1))
        get, word = self.words.get, self.word
        return list(chain.from_iterable([get(w) or word(w) for w in words]))

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)


@lru_cache(maxsize=1)
def _encoder(model_file: str, memo: int) -> BacktrackingEncoder:
    """One encoder a worker process; its memories outlive a task."""
    return BacktrackingEncoder(model_file, memo)


def encode_decode(
    docs: DataFrame,
    model_file: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = True,
    memo: int = 300_000,
) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` per row of ``docs``, and
    with ``keep_ids`` also ``ids array<int>`` and ``decoded string``.

    No shuffle and no state between rows but bounded memories.

    * null or empty text: no ids, empty decoded text;
    * very long texts and words: encoded whole; a long word isn't kept in memory;
    * ties: of equal scores the leftmost merge comes first, as in the library;
    * repeated rows and null ids: a row each; empty table: no rows;
    * other columns are ignored, whatever their names.
    """
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = df.schema["doc_id"].dataType.simpleString()
    extra = ", ids array<int>, decoded string" if keep_ids else ""

    def run(batches):
        enc = _encoder(model_file, memo)
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                n, h, d, all_ids, all_text = [], [], [], [], []
                for text in batch.column("text").to_pylist():
                    ids = enc.encode(text or "")
                    back = enc.decode(ids) if ids else ""
                    n.append(len(ids))
                    h.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                    d.append(hashlib.sha256(back.encode()).hexdigest())
                    if keep_ids:
                        all_ids.append(ids)
                        all_text.append(back)
                cols = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(h, pa.string()), pa.array(d, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    cols += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_text, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return df.mapInArrow(run, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")
