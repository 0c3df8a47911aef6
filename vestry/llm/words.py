"""Words of many texts at once, as places in a buffer and 64-bit keys.

Words are what ASCII white space separates, A-Z lower-cased.  No Python object
is made of a word until somebody asks for its bytes.  A key is a polynomial of
the word's bytes modulo 2**64, mixed with its length; words of one key count as
one word, as words of one hash do in a join on hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

U64 = np.uint64
_BLOCK = 1 << 20
#: Words over so many bytes take their key from XXH64.
_LONG = 4096
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for every place in a block."""
    if not _POWERS:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(_BLOCK + _LONG + 1, base, U64)
            steps[0] = 1
            _POWERS.append(np.cumprod(steps, dtype=U64))
    return _POWERS[0], _POWERS[1]


class Words:
    """The words of an Arrow column of texts, in order; a null text has none."""

    def __init__(self, column: pa.Array):
        if column.null_count:
            column = column.fill_null("")
        width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
        _, offsets, data = column.buffers()
        n = len(column)
        at = np.frombuffer(offsets, width, n + 1, column.offset * np.dtype(width).itemsize).astype(np.int64) if n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
        self._scan(raw, at - at[0])

    @classmethod
    def of(cls, words: list[bytes]) -> Words:
        """Given words, none of them blank, as one text."""
        self = cls.__new__(cls)
        raw = np.frombuffer(b" ".join(words), np.uint8)
        self._scan(raw, np.array([0, len(raw)]))
        return self

    def _scan(self, raw: np.ndarray, at: np.ndarray) -> None:
        self.data = _LOWER[raw]
        word = ~_BLANK[raw]
        begin, last = word.copy(), word.copy()
        begin[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        edges = at[(at > 0) & (at < len(raw))]  # texts end words too
        begin[edges] = word[edges]
        last[edges - 1] = word[edges - 1]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(last) + 1
        #: How many words each text has.
        self.per_text = np.diff(np.searchsorted(self.start, at))
        self.key = self._keys()

    def _keys(self) -> np.ndarray:
        start, end = self.start, self.end
        key = np.empty(len(start), U64)
        powers, inverse = _powers()
        long = end - start > _LONG
        for lo in range(0, len(self.data), _BLOCK):
            a, b = np.searchsorted(start, (lo, lo + _BLOCK)).tolist()
            own = np.arange(a, b)[~long[a:b]]
            if not len(own):
                continue
            first, beyond = int(start[own[0]]), int(end[own[-1]])
            part = self.data[first:beyond].astype(U64)
            part += U64(1)
            part *= powers[: beyond - first]
            total = np.zeros(len(part) + 1, U64)
            np.cumsum(part, out=total[1:])
            s = start[own] - first
            key[own] = (total[end[own] - first] - total[s]) * inverse[s]
        key ^= (end - start).astype(U64) * U64(0xC2B2AE3D27D4EB4F)
        for shift in (32, 29):
            key ^= key >> U64(shift)
            key *= U64(0xD6E8FEB86659FD93)
        key ^= key >> U64(32)
        if long.any():
            import xxhash

            for k in np.flatnonzero(long).tolist():
                key[k] = xxhash.xxh64_intdigest(self.data[start[k] : end[k]].tobytes(), 7)
        key[key == 0] = 1
        return key

    def bytes(self, which: np.ndarray) -> list[bytes]:
        """The words at some places."""
        raw = self.data.tobytes() if len(which) > 1000 else None
        if raw is None:
            return [self.data[a:b].tobytes() for a, b in zip(self.start[which].tolist(), self.end[which].tolist())]
        return [raw[a:b] for a, b in zip(self.start[which].tolist(), self.end[which].tolist())]

    def arrow(self, which: np.ndarray) -> pa.Array:
        """The words at some places as an Arrow column, without Python objects."""
        size = self.end[which] - self.start[which]
        offsets = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.start[which] - offsets[:-1], size) + np.arange(int(offsets[-1]))
        return pa.Array.from_buffers(pa.binary(), len(which), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(self.data[at])])


class KeyTable:
    """Numbers of keys, by open addressing in two arrays; keys aren't zero."""

    def __init__(self, room: int = 1 << 16):
        self._empty(room)

    def _empty(self, room: int) -> None:
        self.keys, self.numbers = np.zeros(room, U64), np.zeros(room, np.int32)
        self.mask, self.used = U64(room - 1), 0

    def copy(self) -> KeyTable:
        new = KeyTable.__new__(KeyTable)
        new.keys, new.numbers, new.mask, new.used = self.keys.copy(), self.numbers.copy(), self.mask, self.used
        return new

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of keys, -1 for those that aren't there."""
        at = (keys & self.mask).astype(np.int64)
        got = self.keys[at]
        out = np.where(got == keys, self.numbers[at], np.int32(-1))
        left = np.flatnonzero((got != keys) & (got != 0))
        while len(left):
            at[left] = (at[left] + 1) & int(self.mask)
            got = self.keys[at[left]]
            hit = got == keys[left]
            out[left[hit]] = self.numbers[at[left[hit]]]
            left = left[~hit & (got != 0)]
        return out

    def add(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """New and distinct keys."""
        if 2 * (self.used + len(keys)) > len(self.keys):
            full = self.keys != 0
            old = self.keys[full], self.numbers[full]
            room = len(self.keys)
            while room < 4 * (self.used + len(keys)):
                room *= 2
            self._empty(room)
            self.add(*old)
        self.used += len(keys)
        at, left = (keys & self.mask).astype(np.int64), np.arange(len(keys))
        while len(left):
            free = self.keys[at[left]] == 0
            try_ = left[free]
            self.keys[at[try_]] = keys[try_]  # of several for one place the last stays
            put = self.keys[at[left]] == keys[left]
            self.numbers[at[left[put]]] = numbers[left[put]]
            left = left[~put]
            at[left] = (at[left] + 1) & int(self.mask)


class Counts:
    """Counts of words over many texts, for as many distinct ones as memory is given."""

    def __init__(self):
        self.table, self.counts, self.words = KeyTable(1 << 18), np.zeros(1 << 16, np.int64), []
        self.used = 0

    def add(self, words: Words) -> None:
        keys, first, times = np.unique(words.key, return_index=True, return_counts=True)
        number = self.table.find(keys)
        new = np.flatnonzero(number < 0)
        if len(new):
            number[new] = self.used + np.arange(len(new))
            self.table.add(keys[new], number[new])
            self.used += len(new)
            while len(self.counts) < self.used:
                self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
            self.words.append(words.arrow(first[new]))
        self.counts[number] += times

    def take(self) -> tuple[pa.Array, pa.Array]:
        """All words with their counts; what was counted is forgotten."""
        words = pa.concat_arrays(self.words) if self.words else pa.array([], pa.binary())
        out = words, pa.array(self.counts[: self.used].copy())
        self.table, self.words, self.used = KeyTable(1 << 18), [], 0
        self.counts[:] = 0
        return out


def slices(batches, most_bytes: int = 4 << 20, most_rows: int = 4096):
    """Arrow batches cut so that the texts of each are about ``most_bytes``, or one text."""
    for whole in batches:
        size = np.asarray(pa.compute.binary_length(whole.column("text")).fill_null(0), dtype=np.int64)
        total = np.cumsum(size)
        lo = 0
        while lo < whole.num_rows:
            before = int(total[lo - 1]) if lo else 0
            hi = max(lo + 1, min(lo + most_rows, int(np.searchsorted(total, before + most_bytes, side="right"))))
            yield whole.slice(lo, hi - lo)
            lo = hi
