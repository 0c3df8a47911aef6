"""Embedding near-duplicates by random-hyperplane sign hashing.

Equal vectors fall together first.  In each of several tables a vector's key is
the signs of its products with a few seeded hyperplanes.  Vectors that share a
key meet in blocks, twice:

1. as ids with the signs of all tables packed into a few longs.  Two vectors at
   the threshold differ in about ``arccos(threshold) / pi`` of these signs; who
   has nobody in the block within that share and a wide margin drops out;
2. the others as whole vectors, compared by their exact cosine in double
   precision.

A pair counts in the first table in which it meets, so nobody needs a list of
all pairs: a block yields one count per vector and a spanning forest of its
links, from which distributed connected components follow.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vestry.llm.common import written
from vestry.llm.graph import connected_components, spanning_forest


def plan_tables(n: int, threshold: float, recall: float = 0.998, per_key: int = 64) -> tuple[int, int]:
    """Bits a key and number of tables for ``n`` vectors.

    Keys get longer with the corpus so that about ``per_key`` vectors share
    one; the tables are as many as find a pair at the threshold itself with
    probability ``recall`` (nearer pairs are found more surely).
    """
    bits = max(6, min(40, round(math.log2(max(n, 1) / per_key + 1))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def _planes(dim: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).normal(size=(dim, count))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def sign_radius(bits: int, threshold: float, miss: float = 1e-9) -> int:
    """So many of ``bits`` signs differ at most, but for a share ``miss`` of the pairs at the threshold (a binomial tail)."""
    p = math.acos(threshold) / math.pi
    term, sum_ = (1 - p) ** bits, 0.0
    for k in range(bits):
        sum_ += term
        if 1 - sum_ <= miss:
            return k
        term *= (bits - k) / (k + 1) * p / (1 - p)
    return bits


class Signer:
    """Signs and keys of vectors; the hyperplanes depend on the seed and the vectors' length alone."""

    def __init__(self, bits: int, tables: int, seed: int):
        self.bits, self.tables, self.seed = bits, tables, seed
        self.longs = -(-bits * tables // 64)
        self.planes: dict[int, np.ndarray] = {}
        self.weight = (1 << np.arange(bits)).astype(np.int64)

    def signs(self, x: np.ndarray) -> np.ndarray:
        dim = x.shape[1]
        if dim not in self.planes:
            self.planes[dim] = _planes(dim, self.bits * self.tables, self.seed)
        # row by row: a product of matrices may round a row otherwise in another batch
        return np.stack([row @ self.planes[dim] for row in x]) > 0 if len(x) else np.zeros((0, self.bits * self.tables), bool)

    def keys(self, signs: np.ndarray) -> np.ndarray:
        return signs.reshape(len(signs), self.tables, self.bits) @ self.weight

    def packed(self, signs: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(signs), 64 * self.longs), np.uint8)
        wide[:, : signs.shape[1]] = signs
        return np.packbits(wide, axis=1, bitorder="little").view("<i8")

    def unpacked(self, longs: np.ndarray) -> np.ndarray:
        return np.unpackbits(np.ascontiguousarray(longs, "<i8").view(np.uint8), axis=1, bitorder="little")[:, : self.bits * self.tables]


def _signed(signer: Signer):
    """The packed signs of each vector."""

    def run(batches):
        for batch in batches:
            vectors = batch.column("v")
            sizes = np.asarray(pa.compute.list_value_length(vectors))
            flat = np.asarray(vectors.flatten(), dtype=np.float64)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int)
            longs = np.zeros((batch.num_rows, signer.longs), np.int64)
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                longs[at] = signer.packed(signer.signs(flat[starts[at][:, None] + np.arange(dim)]))
            offsets = pa.array(np.arange(batch.num_rows + 1) * signer.longs, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), batch.column("n"), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(longs.ravel()))],
                names=["rep", "n", "dim", "signs"],
            )

    return run


#: What tells blocks apart, and how rows name their block and their part in it.
_BLOCK = ["table", "key", "dim", "i", "j"]


def _by_block(batches, columns: list[str], work):
    """Calls ``work(block, rows)`` for each run of rows of one block of more than one row; yields what it returns, batch by batch."""
    held, key = [], None
    for batch in batches:
        found = []
        for row in zip(*(batch.column(c).to_pylist() for c in [*_BLOCK, *columns])):
            if row[:5] != key:
                if len(held) > 1:
                    found.append(work(key, held))
                held, key = [], row[:5]
            held.append(row[5:])
        yield found
    yield [work(key, held)] if len(held) > 1 else []


def _sieve(signer: Signer, radius: int):
    """Rows ``rep, role`` of each block that have somebody within ``radius`` signs, whom they didn't meet in an earlier table."""

    def work(block, rows):
        role = np.array([r[1] for r in rows])
        longs = np.array([r[2] for r in rows], np.int64)
        bits = longs.view(np.uint64)
        nodes, asks = np.flatnonzero(role > 0), np.flatnonzero(role != 1)
        near = np.zeros((len(asks), len(nodes)), np.int64)
        for k in range(signer.longs):
            near += np.bitwise_count(bits[asks, k][:, None] ^ bits[nodes, k][None, :])
        near = near <= radius
        near[asks[:, None] == nodes[None, :]] = False
        keys = signer.keys(signer.unpacked(longs))[:, : block[0]]
        for t in range(block[0]):
            near &= keys[asks, t][:, None] != keys[nodes, t][None, :]
        stays = np.zeros(len(rows), bool)
        stays[asks] |= near.any(1)
        stays[nodes] |= near.any(0)
        return [(*block, rows[k][0], int(role[k])) for k in np.flatnonzero(stays)]

    def run(batches):
        for found in _by_block(batches, ["rep", "role", "signs"], work):
            out = list(zip(*(row for rows in found for row in rows))) or [()] * 7
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=[*_BLOCK, "rep", "role"])

    return run


def _compare(signer: Signer, threshold: float):
    """Counts and links of a block of asking rows against a block of nodes."""

    def work(block, rows):
        nodes = [r for r in rows if r[3]]
        asks = [r for r in rows if r[3] != 1]
        if not nodes or not asks:
            return [], []
        xa, xb = (np.array([r[2] for r in part], dtype=np.float64) for part in (asks, nodes))
        linked = _unit(xa) @ _unit(xb).T >= threshold
        ka, kb = signer.keys(signer.signs(xa)), signer.keys(signer.signs(xb))
        for t in range(block[0]):  # pairs that met in an earlier table were counted there
            linked &= ka[:, t][:, None] != kb[:, t][None, :]
        if nodes[0][3] == 2:  # a block against itself
            np.fill_diagonal(linked, False)
            both = linked
            linked = np.triu(linked)
            counts = [(nodes[i][0], c) for i, c in enumerate((both @ np.array([r[1] for r in nodes])).tolist()) if c]
        else:
            counts = [(asks[i][0], c) for i, c in enumerate((linked @ np.array([r[1] for r in nodes])).tolist()) if c]
            counts += [(nodes[i][0], c) for i, c in enumerate((linked.T @ np.array([r[1] for r in asks])).tolist()) if c]
        pairs = ((asks[i][0], nodes[j][0]) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(linked))))
        return counts, spanning_forest(pairs)

    def run(batches):
        for found in _by_block(batches, ["rep", "n", "v", "role"], work):
            counts = [x for c, _ in found for x in c]
            edges = [x for _, e in found for x in e]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([False] * len(counts) + [True] * len(edges), pa.bool_()),
                    pa.array([x[0] for x in counts] + [x[0] for x in edges], pa.int64()),
                    pa.array([int(x[1]) for x in counts] + [x[1] for x in edges], pa.int64()),
                ],
                names=["edge", "a", "b"],
            )

    return run


def _keys(signs, bits: int, tables: int):
    """The key of each table, cut out of the packed signs."""

    def key(t):
        lo, hi = divmod(t * bits, 64), divmod((t + 1) * bits - 1, 64)
        part = F.shiftrightunsigned(signs[lo[0]], lo[1])
        if hi[0] > lo[0]:
            part = part.bitwiseOR(F.shiftleft(signs[hi[0]], 64 - lo[1]))
        return part.bitwiseAND(F.lit((1 << bits) - 1))

    return F.array(*[key(t) for t in range(tables)])


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.95,
    recall: float = 0.998,
    block: int = 256,
    seed: int = 11,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors``.

    A key that more than ``block`` vectors share is cut into blocks that are
    compared pairwise in tasks of their own, so no key is too frequent.

    * null, empty or zero vectors, and those with null or non-finite
      components: 0 links, a component of their own;
    * equal vectors, also rows of one id, link with each other;
    * vectors of different lengths never link; long ones are compared whole;
    * ties: a cosine equal to the threshold in double precision links; a
      component is named by its smallest id;
    * null ids: their links count; they take the component of what they link
      with by equality, and only lone ones have a null component;
    * empty table: no rows; other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col)
    fine = (
        v.isNotNull()
        & (F.size(v) > 0)
        & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    clean = F.transform(v, lambda x: x + F.lit(0).cast(vectors.schema[vector_col].dataType.elementType))  # -0.0 as 0.0
    rows = written(
        vectors.select(
            F.col(id_col).cast("long").alias("vec_id"),
            F.when(fine, F.xxhash64(clean)).alias("h1"),
            F.when(fine, F.xxhash64(F.lit(3), clean)).alias("h2"),
            F.when(fine, clean).alias("v"),
        ),
        "vectors",
    )
    classes = written(
        rows.where("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v")),
        "classes",
    )
    bits, tables = plan_tables(classes.count(), threshold, recall)
    signer = Signer(bits, tables, seed)
    named = classes.where("rep is not null").select("rep", "n", "v")
    signed = written(named.mapInArrow(_signed(signer), "rep long, n long, dim int, signs array<long>"), "signs")
    entries = signed.select("rep", "dim", "signs", F.posexplode(_keys(F.col("signs"), bits, tables)).alias("table", "key"))
    at = ["table", "key", "dim"]
    # keys are counted without the signs
    sizes = entries.groupBy(*at).agg(F.count("*").alias("m")).where("m > 1").select(*at, F.ceil(F.col("m") / block).cast("int").alias("g"))
    s, g = F.col("s"), F.col("g")
    as_node = F.transform(F.sequence(s, g - 1), lambda j: F.struct(s.alias("i"), j.alias("j"), F.when(j == s, 2).otherwise(1).alias("role")))
    as_query = F.transform(
        F.filter(F.sequence(F.lit(0), s), lambda i: i < s), lambda i: F.struct(i.alias("i"), s.alias("j"), F.lit(0).alias("role"))
    )
    dealt = (
        entries.join(sizes, at)
        .withColumn("s", F.pmod(F.xxhash64("rep", F.lit(5)), g).cast("int"))
        .select(*at, "rep", "signs", F.explode(F.concat(as_node, as_query)).alias("p"))
        .select(*at, "p.i", "p.j", "p.role", "rep", "signs")
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    together = lambda df: df.repartition(parts, *_BLOCK).sortWithinPartitions(*_BLOCK)
    radius = sign_radius(bits * tables, threshold)
    left = together(dealt).mapInArrow(_sieve(signer, radius), "table int, key long, dim int, i int, j int, rep long, role int")
    left = written(left, "left")
    found = together(left.join(named, "rep")).mapInArrow(_compare(signer, threshold), "edge boolean, a long, b long")
    found = written(found, "links")
    counts = found.where("not edge").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("others"))
    comps = connected_components(found.where("edge"), "a", "b")
    facts = (
        classes.drop("v")
        .join(counts, "rep", "left")
        .join(comps, F.col("rep") == F.col("node"), "left")
        .where("n > 1 or others is not null")
        .select(
            "h1",
            "h2",
            (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    return (
        rows.select("vec_id", "h1", "h2")
        .join(facts, ["h1", "h2"], "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
