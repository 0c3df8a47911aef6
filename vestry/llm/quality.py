"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

1. Each whole text becomes a few dozen statistics (shares of character classes,
   word and line shapes, repetition, compressibility).
2. The statistics of all documents are written once; means and deviations of
   the labelled ones come from one aggregate.
3. ``cos(Wx + b)`` approximates a Gaussian kernel.  Each partition sums its
   part of the normal equations; partial sums are summed again in a few tasks
   before the driver solves one small system, so what it gets has a fixed size.
4. Raw scores of the labelled rows, made by the models of the other folds, are
   counted in fixed bins; pooling adjacent violators over the bins gives an
   increasing map to probabilities.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from vestry.llm.common import crc32_of_id, written

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" \t",
    "line": b"\n\r",
    "stop": b".,;:?",
    "bang": b"!",
    "bar": b"|",
    "sign": b"#$%&*+<=>@^_~\\/{}[]()",
    "quote": b"\"'`-",
    "high": bytes(range(128, 256)),
}
_CLASS_OF = np.zeros((256, len(_CLASSES)))
for _k, _bytes in enumerate(_CLASSES.values()):
    _CLASS_OF[list(_bytes), _k] = 1

STATISTICS = (*_CLASSES, "log_bytes", "log_words", "word_len", "word_dev", "distinct_words", "distinct_lines", "log_line", "top_word", "packed", "caps_words", "first_caps", "ends_stop", "sign_words", "repeat_8", "entropy")


def statistics(text: str | None) -> list[float]:
    """The numbers that a text is judged by; an empty text has its own point."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(STATISTICS)
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = (counts @ _CLASS_OF / n).tolist()
    p = counts[counts > 0] / n
    words = raw.split()
    m = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    seen: dict = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    eights = {hash(tuple(words[i : i + 8])) for i in range(0, len(words) - 7, 4)} if len(words) > 8 else ()
    starts = max(1, len(range(0, len(words) - 7, 4)))
    return shares + [
        float(np.log1p(n)),
        float(np.log1p(m)),
        float(np.log1p(sizes.mean())),
        float(np.log1p(sizes.std())),
        len(seen) / m,
        len(set(lines)) / max(1, len(lines)),
        float(np.log1p(n / max(1, len(lines)))),
        max(seen.values(), default=0) / m,
        len(zlib.compress(raw, 1)) / n,
        sum(map(bytes.isupper, words)) / m,
        sum(map(bytes.istitle, words)) / m,
        sum(w.endswith((b".", b"?", b"!")) for w in words) / m,
        sum(w[-1:] in b"#$%&*!|" for w in words) / m,
        1 - len(eights) / starts if eights else 0.0,
        float(-(p * np.log2(p)).sum()),
    ]


def _features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            x = [statistics(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"]
            )

    return df.mapInArrow(run, f"doc_id {kind}, x array<double>")


def _rows_with_features(docs: DataFrame, text_col: str) -> DataFrame:
    """``row, x``: whole rows, whatever their columns, with what their text is judged by."""
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                row = whole.slice(lo, 1024).column("row")
                x = [statistics(t) for t in pa.compute.struct_field(row, text_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([row, pa.array(x, pa.list_(pa.float64()))], names=["row", "x"])

    schema = StructType(df.schema.fields + [StructField("x", ArrayType(DoubleType()))])
    return df.mapInArrow(run, schema)


@dataclass
class Model:
    """A fitted classifier; its size depends on the parameters alone."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    coef: np.ndarray | None = None
    edges: np.ndarray = field(default_factory=lambda: np.array([0.0]))
    values: np.ndarray = field(default_factory=lambda: np.array([0.5]))

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        np.clip(z, -6, 6, out=z)
        out = np.empty((len(z), self.w.shape[1] + z.shape[1] + 1))
        d = self.w.shape[1]
        out[:, :d] = np.cos(z @ self.w + self.b) * np.sqrt(2.0 / d)
        out[:, d:-1] = z / 10
        out[:, -1] = 1
        return out

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.coef

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.edges, self.values), 0, 1)


def _matrix(batch) -> np.ndarray:
    col = batch.column("x")
    return np.asarray(col.flatten()).reshape(batch.num_rows, -1)


def _summed(df: DataFrame, of_batch, size: int, parts: int = 4) -> np.ndarray:
    """Sum over all rows of the vectors that ``of_batch`` makes; at most ``parts`` vectors reach the driver."""

    def first(batches):
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += of_batch(b)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["v"])

    def again(batches):
        total = np.zeros(size)
        for b in batches:
            for v in b.column("v").to_pylist():
                total += np.frombuffer(v)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["v"])

    rows = df.mapInArrow(first, "v binary").repartition(parts).mapInArrow(again, "v binary").collect()
    return sum((np.frombuffer(r["v"]) for r in rows), np.zeros(size))


def isotonic(positive: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Increasing means of bins by pooling adjacent violators; empty bins have weight 0."""
    blocks: list[list[float]] = []
    for p, t in zip(positive, total):
        blocks.append([p, t, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p2, t2, n2 = blocks.pop()
            blocks[-1][0] += p2
            blocks[-1][1] += t2
            blocks[-1][2] += n2
    return np.concatenate([np.full(int(n), p / t if t else 0.5) for p, t, n in blocks])


def fit(labelled: DataFrame, features: int = 384, gamma: float = 0.02, ridge: float = 1e-3, folds: int = 3, bins: int = 2048, seed: int = 7) -> Model:
    """Learns from rows ``doc_id, x, y`` (y 0 or 1); without any, every score is 0.5."""
    k = len(STATISTICS)
    rng = np.random.default_rng(seed)
    w = rng.normal(0, np.sqrt(2 * gamma), (k, features))
    b = rng.uniform(0, 2 * np.pi, features)
    sums = _summed(labelled, lambda t: np.concatenate([[t.num_rows], (x := _matrix(t)).sum(0), (x * x).sum(0)]), 2 * k + 1)
    n = sums[0]
    mean = sums[1 : k + 1] / max(n, 1)
    scale = np.sqrt(np.maximum(sums[k + 1 :] / max(n, 1) - mean**2, 0)) + 1e-4
    model = Model(mean, scale, w, b)
    d = features + k + 1
    if not n:
        model.coef = np.zeros(d)
        return model

    def equations(t):
        x, y, f = model.expand(_matrix(t)), np.asarray(t.column("y"), float), np.asarray(t.column("fold"))
        out = np.zeros((folds, d + 1, d))
        for i in range(folds):
            own = f == i
            out[i, :d] = x[own].T @ x[own]
            out[i, d] = x[own].T @ y[own]
        return out.ravel()

    rows = labelled.withColumn("fold", F.pmod(F.xxhash64("x", F.lit(3)), F.lit(folds)).cast("int"))
    parts = _summed(rows, equations, folds * (d + 1) * d).reshape(folds, d + 1, d)

    def solve(s):
        a = s[:d] + ridge * max(1.0, s[d - 1, d - 1]) / 100 * np.eye(d)
        return np.linalg.lstsq(a, s[d], rcond=None)[0]

    model.coef = solve(parts.sum(0))
    others = np.stack([solve(parts.sum(0) - parts[i]) for i in range(folds)])
    lo, hi = -0.5, 1.5

    def histogram(t):
        raw = np.einsum("ij,ij->i", model.expand(_matrix(t)), others[np.asarray(t.column("fold"))])
        at = np.clip(((raw - lo) / (hi - lo) * bins).astype(int), 0, bins - 1)
        y = np.asarray(t.column("y"), float)
        return np.concatenate([np.bincount(at, y, bins), np.bincount(at, minlength=bins)])

    h = _summed(rows, histogram, 2 * bins).reshape(2, bins)
    full = np.flatnonzero(h[1])
    model.edges = lo + (full + 0.5) * (hi - lo) / bins
    model.values = isotonic(h[0][full], h[1][full])
    return model


def _learn(feats: DataFrame, labels: DataFrame, label_id_col: str, label_col: str, held_out_of: int, held_out: int, **parameters) -> Model:
    """Fits on the labelled ones of rows ``doc_id, x``."""
    held = F.pmod(crc32_of_id(F.col("doc_id")), F.lit(held_out_of)) == held_out
    known = (
        labels.select(F.col(label_id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y"))
        .where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held)
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    return fit(written(feats.join(known, "doc_id").select("doc_id", "x", "y"), "labelled"), **parameters)


def score(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id_col: str = "doc_id",
    label_col: str = "quality",
    held_out_of: int = 3,
    held_out: int = 1,
    **parameters,
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``.

    Labels are read only of ids whose crc32 modulo ``held_out_of`` is not
    ``held_out``; of those, all are used.  The score comes from the text alone.

    * null or empty text: a point of its own, scored like any other;
    * very long texts: their statistics are of the whole text;
    * ties: texts of equal statistics have one score, and 0.5 is accepted;
    * null ids: scored, never labelled; null labels and labels other than 0 and
      1: not used; several labels of one id: the largest;
    * repeated rows: a row each; no labels at all: every score is 0.5;
    * empty tables: no rows, or 0.5 without labels; other columns are
      ignored, whatever their names.
    """
    feats = written(_features(docs, id_col, text_col), "statistics")
    held = F.pmod(crc32_of_id(F.col("doc_id")), F.lit(held_out_of)) == held_out
    model = _learn(feats, labels, label_id_col, label_col, held_out_of, held_out, **parameters)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    kind = feats.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                s = shipped.value.score(_matrix(batch))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    return feats.mapInArrow(run, f"doc_id {kind}, score double").select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_good(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id_col: str = "doc_id",
    label_col: str = "quality",
    held_out_of: int = 3,
    held_out: int = 1,
    **parameters,
) -> DataFrame:
    """The rows of ``docs`` whose text the classifier accepts, with their columns.

    Rows are written once beside their statistics and filtered there, so no text
    is shuffled.

    * each row is judged by its own text: null and empty texts, very long ones,
      ties, repeated rows and null ids are scored as :func:`score` says;
    * no labels: every score is 0.5, so all rows stay; empty table: no rows;
    * all columns are kept as they are, whatever their names.
    """
    rows = written(_rows_with_features(docs, text_col), "rows")
    feats = rows.select(F.col("row")[id_col].alias("doc_id"), "x")
    shipped = docs.sparkSession.sparkContext.broadcast(_learn(feats, labels, label_id_col, label_col, held_out_of, held_out, **parameters))

    @F.pandas_udf("boolean")
    def accepted(x: pd.Series) -> pd.Series:
        return pd.Series(shipped.value.score(np.stack(x.to_numpy())) >= 0.5 if len(x) else [], dtype=bool)

    return rows.where(accepted("x")).select(*[F.col("row")[c].alias(c) for c in docs.columns])
