"""A small causal self-attention model over subword units, in numpy.

One attention layer with learned places in the window, a small feed-forward
layer and an adaptive softmax: a head of frequent units and cluster symbols,
and a softmax within each cluster of rarer units.

A text is cut into chunks of ``stride`` units to score; each chunk's window also
holds the ``context`` units before it, so windows overlap, every unit is scored
once, and all chunks of a batch go through masked attention together.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

F32 = np.float32


@dataclass
class Shape:
    """Fixed sizes of the model; ``units`` counts the start symbol too."""

    units: int
    head: int
    cluster: int
    dim: int = 32
    hidden: int = 48
    stride: int = 16
    context: int = 16

    @property
    def clusters(self) -> int:
        return -(-max(0, self.units - 1 - self.head) // self.cluster)


def fresh(shape: Shape, counts: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    """Start values; output biases begin at the log shares of the units' counts."""
    rng = np.random.default_rng(seed)
    d, w = shape.dim, shape.stride + shape.context
    k, t = shape.clusters, shape.cluster
    normal = lambda *s, by=1.0: (rng.normal(size=s) * by).astype(F32)
    c = np.zeros(shape.head + k * t)
    c[: len(counts)] = counts
    tail = c[shape.head :].reshape(k, t)
    head = np.concatenate([c[: shape.head], tail.sum(1)])
    p = {
        "emb": normal(shape.units, d, by=0.3),
        "pos": normal(w, d, by=0.1),
        "wq": normal(d, d, by=d**-0.5),
        "wk": normal(d, d, by=d**-0.5),
        "wv": normal(d, d, by=0.5 * d**-0.5),
        "w1": normal(d, shape.hidden, by=d**-0.5),
        "b1": np.zeros(shape.hidden, F32),
        "w2": normal(shape.hidden, d, by=0.5 * shape.hidden**-0.5),
        "uh": normal(d, shape.head + k, by=0.1),
        "bh": np.log((head + 0.5) / (head.sum() + 1)).astype(F32),
        "ut": normal(k, d, t, by=0.1),
        "bt": np.log((tail + 0.5) / (tail.sum(1, keepdims=True) + 1)).astype(F32),
    }
    if shape.units - 1 - shape.head < k * t:  # places of the last cluster without a unit
        p["bt"].ravel()[shape.units - 1 - shape.head :] = -1e9
    return p


def windows(units: np.ndarray, lengths: np.ndarray, shape: Shape):
    """Inputs, place of the first target, and targets of all chunks of a batch of texts.

    ``units`` holds the texts one after another.  Input 0 is the start symbol,
    which a text's first target sees; what lies before it is masked.  Returns
    ``inputs (n, w), begin (n,), targets (n, stride)``; a target of -1 lies
    beyond its text.
    """
    s, c = shape.stride, shape.context
    chunks = -(-lengths // s)
    room = c + chunks * s
    offset = np.cumsum(room) - room
    first = np.cumsum(lengths) - lengths
    at = np.arange(len(units)) + np.repeat(offset + c - first, lengths)
    before, after = np.zeros(int(room.sum()) + 1, np.int32), np.full(int(room.sum()), -1, np.int32)
    after[at] = units
    before[at + 1] = units + 1
    before[offset + c] = 0
    begin = (np.arange(int(chunks.sum())) - np.repeat(np.cumsum(chunks) - chunks, chunks)) * s
    start = np.repeat(offset, chunks) + begin
    inputs = np.lib.stride_tricks.sliding_window_view(before, c + s)[start]
    targets = np.lib.stride_tricks.sliding_window_view(after, s)[start + c]
    return inputs, begin, targets


def _mask(shape: Shape) -> np.ndarray:
    """Query i, at place ``context + i``, sees the keys up to its own place."""
    return np.arange(shape.context + shape.stride)[None, :] <= shape.context + np.arange(shape.stride)[:, None]


def _seen(begin: np.ndarray, shape: Shape) -> np.ndarray:
    """Keys that don't lie before their text."""
    return np.arange(shape.context + shape.stride)[None, :] >= shape.context - begin[:, None]


def _times(a: np.ndarray, w: np.ndarray, out: np.ndarray, rows: int = 64) -> np.ndarray:
    """``a @ w`` a few rows at a time: the library takes small products without packing them."""
    cut = len(a) // rows * rows
    np.matmul(a[:cut].reshape(-1, rows, a.shape[1]), w, out=out[:cut].reshape(-1, rows, w.shape[1]))
    if cut < len(a):
        np.matmul(a[cut:], w, out=out[cut:])
    return out


def _crossed(a: np.ndarray, b: np.ndarray, rows: int = 64) -> np.ndarray:
    """``a.T @ b``, as :func:`_times`."""
    cut = len(a) // rows * rows
    total = np.matmul(a[:cut].reshape(-1, rows, a.shape[1]).transpose(0, 2, 1), b[:cut].reshape(-1, rows, b.shape[1])).sum(0)
    if cut < len(a):
        total += a[cut:].T @ b[cut:]
    return total


class Rooms:
    """Memory that is used again for every batch: new memory would cost more than what is worked out in it."""

    def __init__(self, dtype=F32):
        self.dtype, self.rooms = dtype, {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        if len(self.rooms.get(name, ())) < size:
            self.rooms[name] = np.empty(size, self.dtype)
        return self.rooms[name][:size].reshape(shape)


class Scorer:
    """Log probabilities (base 10) of units, from fitted parameters.

    With a single layer the products of queries, keys and values with an
    embedding depend on the unit and the place alone, so they are tables.
    """

    def __init__(self, p: dict[str, np.ndarray], shape: Shape):
        self.p, self.shape = p, shape
        c = shape.context
        scale = F32(shape.dim**-0.5)
        of = lambda x, w: np.ascontiguousarray(x if w is None else x @ w, F32)
        self.by_unit = [of(p["emb"], p["wk"]), of(p["emb"], p["wv"]), of(p["emb"], p["wq"] * scale), of(p["emb"], None)]
        self.by_place = [of(p["pos"], p["wk"]), of(p["pos"], p["wv"]), of(p["pos"][c:], p["wq"] * scale), of(p["pos"][c:], None)]
        self.causal = np.where(_mask(shape), F32(0), F32(-1e9))
        self.head_weight, self.tail_weight = np.exp(p["bh"]), np.exp(p["bt"])
        self.room = Rooms()

    def __call__(self, units: np.ndarray, lengths: np.ndarray, batch: int = 192, at_once: int = 24) -> np.ndarray:
        """Scores of all units; ``batch`` chunks go through attention together, small enough for the cache, and the
        rare units of ``at_once`` such batches through their clusters."""
        out = np.zeros(len(units))
        if not len(units):
            return out
        inputs, begin, targets = windows(units.astype(np.int32), lengths, self.shape)
        inside = targets >= 0
        got = np.empty(targets.shape, dtype=F32)
        for lo in range(0, len(inputs), batch * at_once):
            cut = slice(lo, lo + batch * at_once)
            with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                got[cut] = self._chunks(inputs[cut], begin[cut], targets[cut], inside[cut], batch)
                if not np.isfinite(got[cut]).all():
                    got[cut] = self._chunks(inputs[cut], begin[cut], targets[cut], inside[cut], batch, careful=True)
        return got[inside].astype(np.float64)

    def _chunks(self, inputs, begin, targets, inside, batch: int, careful: bool = False):
        parts = [
            self._head(inputs[lo : lo + batch], begin[lo : lo + batch], targets[lo : lo + batch], inside[lo : lo + batch], careful)
            for lo in range(0, len(inputs), batch)
        ]
        y = targets[inside]
        lp = np.concatenate([x for x, _ in parts])
        rare = np.flatnonzero(y >= self.shape.head)
        if len(rare):
            self._tail(lp, np.concatenate([x for _, x in parts]), y[rare] - self.shape.head, rare, careful)
        lp *= F32(1 / np.log(10))
        out = np.zeros(targets.shape, dtype=F32)
        out[inside] = lp
        return out

    def _hidden(self, inputs, begin, careful: bool):
        """What the layer makes of each place to score."""
        sh = self.shape
        n, w = inputs.shape
        own = inputs[:, sh.context :]
        k, v, q, x = (
            table.take(at, axis=0, out=self.room(name, *at.shape, sh.dim), mode="clip")
            for name, table, at in zip("kvqx", self.by_unit, (inputs, inputs, own, own))
        )
        for part, place in zip((k, v, q, x), self.by_place):
            part += place
        s = np.matmul(q, k.transpose(0, 2, 1), out=self.room("s", n, sh.stride, w))
        s += self.causal
        early = np.flatnonzero(begin < sh.context)  # only a text's first chunks look before its start
        if len(early):
            s[early] += np.where(_seen(begin[early], sh), F32(0), F32(-1e9))[:, None, :]
        if careful:
            s -= s.max(-1, keepdims=True)
        np.exp(s, out=s)
        h = np.matmul(s, v, out=q)
        h /= s.sum(-1, keepdims=True)
        h += x
        return h.reshape(-1, sh.dim)

    def _head(self, inputs, begin, targets, inside, careful: bool):
        """Log probabilities of frequent units and of rare ones' clusters, and the hidden values of the rare ones.

        ``careful``: no exponent of a number that could be too large; plain exponents do for trained models.
        """
        p, sh = self.p, self.shape
        h, y = self._hidden(inputs, begin, careful), targets.ravel()
        if not inside.all():
            seen = np.flatnonzero(inside.ravel())
            h, y = h[seen], y[seen]
        z = _times(h, p["w1"], self.room("z", len(h), p["w1"].shape[1]))
        z += p["b1"]
        np.maximum(z, 0, out=z)
        h += _times(z, p["w2"], self.room("x", len(h), sh.dim))
        logits = _times(h, p["uh"], self.room("logits", len(h), p["uh"].shape[1]))
        rare = y >= sh.head
        top = np.where(rare, sh.head + (y - sh.head) // sh.cluster, y)
        lp = logits[np.arange(len(y)), top]
        lp += p["bh"][top]
        lp -= self._log_total(logits, p["bh"], self.head_weight, careful)
        return lp, h[rare]

    def _tail(self, lp, h, rest, rare, careful: bool) -> None:
        """Adds the log probabilities of the rare units ``rest`` within their clusters to ``lp`` at ``rare``."""
        p, sh = self.p, self.shape
        k = rest // sh.cluster
        order = np.argsort(k, kind="stable")
        cuts = np.searchsorted(k[order], np.arange(sh.clusters + 1)).tolist()
        for c in range(sh.clusters):
            own = order[cuts[c] : cuts[c + 1]]
            if len(own):
                t = np.matmul(h[own], p["ut"][c], out=self.room("logits", len(own), sh.cluster))
                nth = rest[own] - c * sh.cluster
                right = t[np.arange(len(own)), nth] + p["bt"][c][nth]
                lp[rare[own]] += right - self._log_total(t, p["bt"][c], self.tail_weight[c], careful)

    @staticmethod
    def _log_total(logits: np.ndarray, bias: np.ndarray, weight: np.ndarray, careful: bool) -> np.ndarray:
        """Log of the sum of exponents of each row, which are overwritten; a bias is a factor of its exponent."""
        if not careful:
            return np.log(np.exp(logits, out=logits) @ weight)
        logits = logits + bias
        top = logits.max(-1, keepdims=True)
        return np.log(np.exp(logits - top).sum(-1)) + top[:, 0]


def _exponents(logits: np.ndarray, again, y: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Overwrites logits with their exponents; sums of rows, and the logs of the right answers' shares.

    ``again`` makes the logits anew where an exponent was too large, or all of a row were too small.
    """
    at = None if y is None else np.arange(len(y))
    right = None if y is None else logits[at, y]
    rows, one = logits.reshape(-1, logits.shape[-1]), np.ones(logits.shape[-1], logits.dtype)
    with np.errstate(over="ignore"):
        total = np.exp(rows, out=rows) @ one
    if not (total.min() > 1e-30 and total.max() < 1e30):
        again()
        logits -= logits.max(-1, keepdims=True)
        right = None if y is None else logits[at, y]
        total = np.exp(rows, out=rows) @ one
    return total, None if y is None else right - np.log(total)


def gradients(p: dict, shape: Shape, inputs, begin, targets, rooms: Rooms | None = None) -> tuple[float, dict]:
    """Summed loss (natural logs) and its gradients over one batch of chunks."""
    d, c = shape.dim, shape.context
    room = rooms or Rooms(p["emb"].dtype.type)
    flat = lambda x: x.reshape(-1, x.shape[-1])
    n, w, s = len(inputs), inputs.shape[1], targets.shape[1]
    x = p["emb"].take(inputs, axis=0, out=room("x", n, w, d), mode="clip")
    x += p["pos"]
    wkv, wq = np.concatenate([p["wk"], p["wv"]], axis=1), p["wq"] * room.dtype(d**-0.5)
    kv = _times(flat(x), wkv, room("kv", n * w, 2 * d)).reshape(n, w, 2 * d)
    k, v, xq = kv[..., :d], kv[..., d:], room("xq", n, s, d)
    xq[:] = x[:, c:]
    q = _times(flat(xq), wq, room("q", n * s, d)).reshape(n, s, d)
    a = room("a", n, s, w)
    early = np.flatnonzero(begin < c)
    unseen = np.where(_seen(begin[early], shape), 0, -1e9).astype(a.dtype)[:, None, :]
    causal = np.where(_mask(shape), 0, -1e9).astype(a.dtype)

    def attend():
        np.matmul(q, k.transpose(0, 2, 1), out=a)
        np.add(a, causal, out=a)
        a[early] += unseen

    attend()
    over = 1 / _exponents(a, attend)[0].reshape(n, s, 1)
    o = np.matmul(a, v, out=room("o", n, s, d))
    o *= over
    h = flat(np.add(xq, o, out=room("h", n, s, d)))
    z = _times(h, p["w1"], room("z", n * s, shape.hidden))
    z += p["b1"]
    np.maximum(z, 0, out=z)
    gf = _times(z, p["w2"], room("gf", n * s, d))
    gf += h
    y = targets.ravel()
    seen = y >= 0
    tail = y >= shape.head
    top = np.where(tail, shape.head + (y - shape.head) // shape.cluster, np.maximum(y, 0))
    logits, dgf = room("logits", n * s, p["uh"].shape[1]), room("dgf", n * s, d)

    def frequent():
        _times(gf, p["uh"], logits)
        np.add(logits, p["bh"], out=logits)

    frequent()
    total, right = _exponents(logits, frequent, top)
    loss = -float(right[seen].sum())
    logits[np.arange(len(y)), top] -= total  # the gradient by the logits, times the total
    share = (seen / total).astype(a.dtype)
    out = {"bh": share @ logits, "ut": np.zeros_like(p["ut"]), "bt": np.zeros_like(p["bt"])}
    out["uh"] = _crossed(np.multiply(gf, share[:, None], out=room("g", n * s, d)), logits)
    _times(logits, np.ascontiguousarray(p["uh"].T), dgf)
    dgf *= share[:, None]
    rare = np.flatnonzero(tail)
    rare = rare[np.argsort(top[rare].astype(np.uint16), kind="stable")]
    if len(rare):
        cuts = np.searchsorted(top[rare], shape.head + np.arange(shape.clusters + 1)).tolist()
        parts = [(j, slice(lo, hi)) for j, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if hi > lo]
        g = gf.take(rare, axis=0, out=room("rare", len(rare), d), mode="clip")
        logits = room("logits", len(rare), shape.cluster)

        def within():
            for j, own in parts:
                part = np.matmul(g[own], p["ut"][j], out=logits[own])
                part += p["bt"][j]

        within()
        nth = (y[rare] - shape.head) % shape.cluster
        total, right = _exponents(logits, within, nth)
        loss -= float(right.sum())
        logits[np.arange(len(rare)), nth] -= total
        share = 1 / total
        dg, backward = room("more", len(rare), d), np.ascontiguousarray(p["ut"].transpose(0, 2, 1))
        for j, own in parts:
            np.matmul(share[own], logits[own], out=out["bt"][j])
            np.matmul(logits[own], backward[j], out=dg[own])
        g *= share[:, None]
        for j, own in parts:
            np.matmul(g[own].T, logits[own], out=out["ut"][j])
        dg *= share[:, None]
        dgf[rare] += dg
    dz = _times(dgf, np.ascontiguousarray(p["w2"].T), room("dz", n * s, shape.hidden))
    dz *= z > 0
    one = np.ones(n * s, a.dtype)
    out["w2"], out["w1"], out["b1"] = _crossed(z, dgf), _crossed(h, dz), one @ dz
    dh = _times(dz, np.ascontiguousarray(p["w1"].T), room("dh", n * s, d))
    dh += dgf
    dh = dh.reshape(n, s, d)
    g = np.multiply(dh, over, out=room("g", n, s, d))
    da = np.matmul(g, v.transpose(0, 2, 1), out=room("da", n, s, w))
    da -= np.einsum("ijk,ijk->ij", g, o)[..., None]
    da *= a
    dkv = room("dkv", n, w, 2 * d)
    np.matmul(a.transpose(0, 2, 1), g, out=dkv[..., d:])
    np.matmul(da.transpose(0, 2, 1), q, out=dkv[..., :d])
    dq = flat(np.matmul(da, k, out=room("dq", n, s, d)))
    both = _crossed(flat(x), flat(dkv))
    out["wq"], out["wk"], out["wv"] = _crossed(flat(xq), dq) * room.dtype(d**-0.5), both[:, :d], both[:, d:]
    dx = _times(flat(dkv), np.ascontiguousarray(wkv.T), room("dx", n * w, d)).reshape(n, w, d)
    dh += _times(dq, np.ascontiguousarray(wq.T), room("o", n * s, d)).reshape(n, s, d)
    dx[:, c:] += dh
    out["pos"] = (one[:n] @ dx.reshape(n, w * d)).reshape(w, d)
    out["emb"] = np.zeros_like(p["emb"])
    ids = inputs.ravel().astype(np.uint16 if shape.units <= 1 << 16 else np.int64)
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    sums = flat(dx).take(order, axis=0, out=room("kv", n * w, d), mode="clip")
    if d % 2 == 0:  # two numbers at once
        sums = sums.view(np.result_type(sums.dtype, np.complex64))
    out["emb"][ids[first]] = np.add.reduceat(sums, first, axis=0).view(a.dtype)
    return loss, out


class Adam:
    """Steps on parameters in place."""

    def __init__(self, p: dict[str, np.ndarray]):
        if not all(v.flags.c_contiguous for v in p.values()):
            raise ValueError("steps need parameters in the order of C")
        self.p, self.t = p, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.s = {k: np.zeros_like(v) for k, v in p.items()}
        self.rooms = Rooms(p["emb"].dtype.type)

    def step(self, shape: Shape, inputs, begin, targets, rate: float) -> None:
        self.t += 1
        _, grad = gradients(self.p, shape, inputs, begin, targets, self.rooms)
        n = max(1, int((targets >= 0).sum()))
        lr = rate * min(1, self.t / 20)
        by, root = lr / (1 - 0.9**self.t), (1 - 0.99**self.t) ** -0.5
        for k, grad_of in grad.items():
            whole = [x.reshape(-1) for x in (grad_of, self.m[k], self.s[k], self.p[k])]
            for lo in range(0, len(whole[0]), 1 << 14):  # so much stays in the cache
                g, m, s, p = (x[lo : lo + (1 << 14)] for x in whole)
                g *= F32(0.1 / n)
                m *= F32(0.9)
                m += g
                s *= F32(0.99)
                g *= g  # 0.01 of the gradient's square
                s += g
                np.sqrt(s, out=g)
                g *= F32(root)
                g += F32(1e-8)
                np.divide(m, g, out=g)
                g *= F32(by)
                p -= g


def train(
    units: np.ndarray, lengths: np.ndarray, counts: np.ndarray, shape: Shape, steps: int = 400, batch: int = 256, rate: float = 4e-3, seed: int = 5
) -> dict[str, np.ndarray]:
    """Adam over random batches of chunks; the rate falls to zero."""
    p = fresh(shape, counts, seed)
    if not len(units):
        return p
    inputs, begin, targets = windows(units.astype(np.int32), lengths, shape)
    rng = np.random.default_rng(seed)
    adam = Adam(p)
    for t in range(1, steps + 1):
        pick = rng.integers(0, len(inputs), batch)
        adam.step(shape, inputs[pick], begin[pick], targets[pick], rate * (1 - t / (steps + 1)))
    return p


def train_once(adam: Adam, units: np.ndarray, lengths: np.ndarray, shape: Shape, rate: float, batch: int = 256, seed: int = 5) -> None:
    """One pass over all chunks of some texts, in random order: steps grow with the texts."""
    inputs, begin, targets = windows(units.astype(np.int32), lengths, shape)
    order = np.random.default_rng(seed).permutation(len(inputs))
    for lo in range(0, len(order), batch):
        pick = order[lo : lo + batch]
        adam.step(shape, inputs[pick], begin[pick], targets[pick], rate)
