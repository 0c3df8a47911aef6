"""Distributed connected components by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vestry.llm.common import drop_written, written


#: Nodes with more than one in so many edges are hubs; there are at most twice as many.
HUBS = 4096
#: So many edges at most are finished by the driver: 2 MB of ids. Each step over them would be a dozen shuffles and
#: broadcasts, whose plans and code take the driver far more memory.
FEW = 1 << 17


def _fingerprint(edges: DataFrame) -> tuple:
    """Number of edges and a sum that tells their sets apart; hashes are cut short, so ids of any size can't overflow it."""
    part = [F.pmod(F.xxhash64("u", "v", F.lit(k)), F.lit(1 << 31)).cast("decimal(20,0)") for k in (0, 1)]
    return tuple(edges.agg(F.count("*"), F.sum(part[0]), F.sum(part[1])).first())


def _with_least(edges: DataFrame, key: str, other: str, total: int, least) -> DataFrame:
    """``edges`` with ``m``, the ``least`` of each ``key``.

    Minima are made with partial aggregation.  A hub's edges don't travel to
    its minimum: hubs, at most ``2 * HUBS`` by their definition, are broadcast.
    """
    low = edges.groupBy(key).agg(least.alias("m"), F.count("*").alias("d"))
    hub = F.col("d") > max(64, total / HUBS)
    hubs = F.broadcast(low.where(hub).select(key, "m"))
    rest = edges.join(hubs.select(key), key, "left_anti").join(low.where(~hub).select(key, "m"), key)
    return edges.join(hubs, key).select(key, other, "m").unionByName(rest.select(key, other, "m"))


def smallest_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges, and the smallest node that each can reach."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return nodes, nodes[label]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != (up := label[label])).any():
            label = up


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Smallest reachable node of each node that has an edge.

    ``edges`` has two long columns; direction, repeats and loops don't matter,
    and edges with a null end are ignored.  Returns ``node, component`` without
    nodes that have no edge to another node; an empty table gives an empty one.

    A step keeps connectivity and only re-hangs edges on smaller neighbours;
    after O(log^2 n) steps each component is a star around its smallest node.
    Hubs' edges stay where they are (:func:`_with_least`).  Every step is
    written to the shared folder, and the step before it deleted.  Up to ``FEW``
    edges are finished by the driver instead, whatever the size of what they come from.
    """
    a, b = F.col(src).cast("long"), F.col(dst).cast("long")
    e = written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), (a != b).alias("two"))
        .where("two and u is not null and v is not null")
        .select("u", "v")
        .distinct(),
        "edges",
    )
    state = _fingerprint(e)
    while state[0]:
        if state[0] <= FEW:
            few = e.toArrow()
            nodes, least = smallest_reachable(few.column("u").to_numpy(), few.column("v").to_numpy())
            drop_written(e)
            return e.sparkSession.createDataFrame(pa.table({"node": nodes, "component": least}))
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select("v", "u"))
        large = _with_least(both, "x", "y", 2 * state[0], F.least(F.min("y"), F.col("x"))).where("y > x")
        large = large.select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        small = (
            _with_least(large, "u", "v", state[0], F.min("v"))
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), "m"), F.struct("u", "m"))).alias("p"))
            .select("p.u", F.col("p.m").alias("v"))
            .where("u > v")
            .distinct()
        )
        new = written(small, "edges")
        drop_written(e)
        e, before = new, state
        state = _fingerprint(e)
        if state == before:
            break
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(e.select("v", "v").distinct())


def spanning_forest(pairs) -> list[tuple[int, int]]:
    """Edges, in the order given, that join two trees of what came before."""
    parent: dict = {}

    def root(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    out = []
    for a, b in pairs:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out
