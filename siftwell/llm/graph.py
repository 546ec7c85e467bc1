"""Connected components of a distributed edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import pinned

#: Edges that one task joins by itself.
LOCAL = 300_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges ``u, v`` to edges ``u, v`` from each node to the smallest that it reaches by them, LOCAL of them at a time."""
    parent: dict = {}
    kinds: list = []
    seen = 0

    def root(x):
        while (up := parent[x]) != x:
            parent[x] = x = parent[up]
        return x

    def out() -> pa.RecordBatch:
        below = [(x, root(x)) for x in parent]
        below = [(x, top) for x, top in below if x != top]
        return pa.RecordBatch.from_arrays([pa.array([e[i] for e in below], kinds[i]) for i in (0, 1)], names=["u", "v"])

    for batch in batches:
        kinds = [c.type for c in batch.columns]
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = root(a), root(b)
            if a < b:
                parent[b] = a
            elif b < a:
                parent[a] = b
        seen += batch.num_rows
        if seen >= LOCAL:
            yield out()
            parent, seen = {}, 0
    if parent:
        yield out()


def _joined_locally(edges: DataFrame, n: int) -> DataFrame:
    """``edges`` with those of some LOCAL together replaced by a forest; for few edges the stars of all components."""
    kind = dict(edges.dtypes)["u"]
    return edges.select("u", "v").coalesce(-(-n // LOCAL) or 1).mapInArrow(_forest, f"u {kind}, v {kind}")


def _lowest(edges: DataFrame) -> DataFrame:
    """``edges (u, v)`` with ``low``, the smallest v of each u; the smallest are found before they are joined."""
    low = edges.groupBy("u").agg(F.min("v").alias("low"))
    return edges.join(low, "u")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of an undirected edge table; the root is the component's smallest node.

    Union-find: tasks first join what their own edges connect. Up to LOCAL edges that is all; of more,
    alternating large-star and small-star steps hang nodes below the smallest node they can see, until
    only stars are left. Nothing is collected but two numbers a round. Self-loops, repeated edges and
    null ends are ignored; without edges the result is empty.
    """
    ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = pinned(ends.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")))
    n, state = now.count(), None
    while True:
        alone = n <= LOCAL
        now = pinned(_joined_locally(now, n).distinct() if not alone else _joined_locally(now, n))
        after = _state(now)
        if alone or after == state:
            break
        # large star: neighbours above u move below the smallest of u and its neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hung = _lowest(both).where("v > u").select(F.col("v").alias("u"), F.least("low", "u").alias("v")).distinct()
        # small star: u and its neighbours below it move below the smallest of them
        lower = _lowest(hung)
        moved = lower.where("v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        now = pinned(moved.unionByName(lower.select("u", F.col("low").alias("v"))).distinct())
        n, state = now.count(), _state(now)
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    """Edge count and an order-free digest of the edges."""
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]
