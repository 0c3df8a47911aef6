"""SimHash near-duplicates, searched with BK-trees.

Fingerprints are made in Arrow batches.  Equal fingerprints fall together
first.  By the pigeonhole principle two 64-bit values within ``radius`` bits
agree wholly in ``k`` of ``radius + k`` blocks, so every choice of ``k`` blocks
deals the distinct fingerprints into shards such that each pair within the
radius meets in at least one.  A shard's members hang in a BK-tree: a child's
key is its integer Hamming distance to the parent, and a search follows only
edges whose key is within the radius of the distance just measured.

A shard tree is shipped, by the shuffle, to the tasks that ask it: all trees
together grow with the corpus, so none of this is a broadcast variable.  No
tree has over ``max_nodes`` nodes; a shard with more is cut into several trees
and its members are sent as queries to each of them.  A dense shard, one of more
than ``dense`` trees, isn't searched at all while its members can be dealt anew
by one block more, which its pairs within the radius share as well.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vestry.llm.common import written
from vestry.llm.graph import connected_components, spanning_forest

_BYTE_BITS = np.array([[b >> k & 1 for k in range(8)] for b in range(256)], dtype=np.int64)


def fingerprint(text: str | None, words: int = 4) -> int:
    """SimHash of one text: the majority bits of the XXH64 (seed 42) of its shingles.

    A-Z are lower-cased; words are what ASCII white space separates.  Fewer
    than ``words`` words make one shingle, no word makes fingerprint zero.
    """
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    n = len(tokens)
    digest = xxhash.xxh64_intdigest
    if n <= words:
        hashes = [digest(line, 42)]
    else:
        size = np.fromiter(map(len, tokens), dtype=np.int64, count=n) + 1
        ends = np.cumsum(size)
        start = (ends - size)[: n - words + 1].tolist()
        stop = (ends - 1)[words - 1 :].tolist()
        hashes = [digest(line[i:j], 42) for i, j in zip(start, stop)]
    raw = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    out = 0
    for k in range(8):
        ones = np.bincount(raw[:, k], minlength=256) @ _BYTE_BITS
        for bit in np.flatnonzero(2 * ones > len(hashes)).tolist():
            out |= 1 << (8 * k + bit)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """One row ``id, fp`` (signed long) per row of ``docs``; a null text counts as empty."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t, words) for t in batch.column("text").to_pylist()]
            values = pa.array(np.array(fps, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), values], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, "id long, fp long"
    )


class BKTree:
    """Distinct 64-bit values under the Hamming distance."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        new = len(self.values)
        self.values.append(value)
        self.children.append({})
        at = 0
        while new:
            d = (self.values[at] ^ value).bit_count()
            nxt = self.children[at].setdefault(d, new)
            if nxt == new:
                break
            at = nxt
        return new

    def within(self, value: int, radius: int) -> list[int]:
        """Numbers of the nodes at most ``radius`` away."""
        found, stack = [], [0] if self.values else []
        values, children = self.values, self.children
        while stack:
            at = stack.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            lo, hi = d - radius, d + radius
            for key, child in children[at].items():
                if lo <= key <= hi:
                    stack.append(child)
        return found


#: Whole blocks in a shard key at most.
MOST_BLOCKS = 6


def blocks_for(n: int, radius: int, per_shard: int = 64) -> int:
    """How many whole blocks a shard key takes so that shards stay small for ``n`` values."""
    k = 1
    while k < MOST_BLOCKS and n / 2 ** (64 * k / (radius + k)) > per_shard:
        k += 1
    return k


def shard_masks(radius: int, k: int) -> list[int]:
    """Bit masks of every choice of ``k`` of ``radius + k`` blocks, as signed longs."""
    total = radius + k
    cuts = [round(64 * i / total) for i in range(total + 1)]
    blocks = [((1 << (hi - lo)) - 1) << lo for lo, hi in itertools.pairwise(cuts)]
    masks = [sum(c) for c in itertools.combinations(blocks, k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _search(radius: int):
    """Goes through rows sorted by shard; a shard's rows may span batches."""

    def links(rows):
        tree, reps, pairs = BKTree(), [], []
        for value, rep, role in rows:
            if role == 0:  # waits for the tree: roles come sorted, 0 last
                pairs += [(reps[i], rep) for i in tree.within(value, radius)]
            else:
                if role == 2:  # a whole shard: asks what is there, then joins it
                    pairs += [(reps[i], rep) for i in tree.within(value, radius)]
                tree.add(value)
                reps.append(rep)
        return spanning_forest(pairs)

    def run(batches):
        held, key = [], None
        for batch in batches:
            keys = list(zip(batch.column("key").to_pylist(), batch.column("i").to_pylist(), batch.column("j").to_pylist()))
            values = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64).tolist()
            found = []
            for k, row in zip(keys, zip(values, batch.column("rep").to_pylist(), batch.column("role").to_pylist())):
                if k != key:
                    if len(held) > 1:
                        found += links(held)
                    held, key = [], k
                held.append(row)
            yield _edges(found)
        if len(held) > 1:
            yield _edges(links(held))

    return run


def _edges(found):
    a = pa.array([x for x, _ in found], pa.int64())
    b = pa.array([y for _, y in found], pa.int64())
    return pa.RecordBatch.from_arrays([a, b], names=["src", "dst"])


def links(classes: DataFrame, radius: int = 4, max_nodes: int = 256, dense: int = 16) -> DataFrame:
    """Edges ``src, dst`` between the ``rep`` of fingerprints within ``radius`` bits.

    ``classes`` has one row ``fp, rep`` per distinct fingerprint.  Each task
    emits a spanning forest of the links of a tree, so that edges are enough
    for components and never grow with the square of a dense shard.
    """
    k, edges = blocks_for(classes.count(), radius), None
    while True:
        masks = shard_masks(radius, k)
        keys = F.transform(F.array(*[F.lit(m) for m in masks]), lambda m, i: F.xxhash64(i, F.col("fp").bitwiseAND(m)))
        entries = classes.select("fp", "rep", F.explode(keys).alias("key"))
        sizes = written(entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shards")
        fits = F.col("n") <= (max_nodes * dense if k < MOST_BLOCKS else 1 << 62)
        found = _searched(entries.join(sizes.where(fits), "key"), radius, max_nodes)
        edges = found if edges is None else edges.unionByName(found)
        if sizes.where(~fits).isEmpty():
            return edges
        classes = written(entries.join(sizes.where(~fits), "key", "left_semi").select("fp", "rep").distinct(), "dense")
        k += 1


def _searched(entries: DataFrame, radius: int, max_nodes: int) -> DataFrame:
    """The links within shards, from rows ``key, fp, rep, n`` (``n`` the shard's size)."""
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("g")).cast("int")
    # role 1: node of tree i, asked by the members of part j > i; role 0: asks; role 2: both, in its own part
    as_node = F.transform(F.sequence(F.col("s"), F.col("g") - 1), lambda j: F.struct(
        F.col("s").alias("i"), j.alias("j"), F.when(j == F.col("s"), 2).otherwise(1).alias("role")))
    as_query = F.transform(F.filter(F.sequence(F.lit(0), F.col("s")), lambda i: i < F.col("s")), lambda i: F.struct(
        i.alias("i"), F.col("s").alias("j"), F.lit(0).alias("role")))
    dealt = (
        entries.withColumn("g", F.ceil(F.col("n") / max_nodes).cast("int"))
        .withColumn("s", own)
        .select("key", "fp", "rep", F.explode(F.concat(as_node, as_query)).alias("p"))
        .select("key", "p.i", "p.j", "p.role", "fp", "rep")
    )
    n = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = dealt.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", F.desc("role"), "fp")
    return sorted_.mapInArrow(_search(radius), "src long, dst long")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 4,
    radius: int = 4,
    max_nodes: int = 256,
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs``.

    * null or empty text: fingerprint zero, linked like any other;
    * very long texts: all their shingles count;
    * ties: a bit set in just half of the hashes is 0; a component is named by
      its smallest id;
    * repeated rows and ids: a row each, with the same component;
    * null id: kept with the component of its fingerprint class, null if no
      other member has an id;
    * empty table: no rows; other columns of ``docs`` are ignored, whatever their names.
    """
    fps = written(fingerprints(docs, id_col, text_col, words), "fp")
    classes = written(fps.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "classes")
    comps = connected_components(links(classes.where("rep is not null").select("fp", "rep"), radius, max_nodes))
    # only classes of several rows or with links say more than a row's own id
    named = (
        classes.join(comps, classes["rep"] == comps["node"], "left")
        .where("n > 1 or component is not null")
        .select("fp", F.coalesce("component", "rep").alias("component"))
    )
    return fps.join(named, "fp", "left").select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.coalesce("component", "id").alias("component_id"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """``docs`` with one document, that of the smallest id, left of each group.

    * null and empty texts are one group; very long texts count whole;
    * rows that repeat another's id, whatever their text: one of them stays;
    * rows without an id stay, each of them;
    * ties can't be: a group's smallest id is one id; empty table: no rows;
    * all columns are kept as they are, whatever their names.
    """
    found = written(near_duplicates(docs, id_col, text_col, **parameters), "groups")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    kept = docs.join(gone, id_col, "left_anti").select(*docs.columns)
    repeated = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if repeated.isEmpty():
        return kept
    unnamed = kept.where(F.col(id_col).isNull())
    return kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionByName(unnamed)
