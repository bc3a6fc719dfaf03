"""Connected components of an edge table by union-find and star contraction.

Each task first joins its edges by union-find, some hundred thousand at a time, which leaves one edge per
node and keeps connectivity; large-star and small-star rounds then finish the components across tasks.
No group is ever gathered: a round is an aggregate (the least neighbour) and a join with it.

Defined results: an edge from a node to itself and a repeated edge change nothing; edges with a null end are
left out; a node without an edge to another is not in the result; no edges give an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import runtime

CHUNK = 200_000


class UnionFind:
    """Disjoint sets of integers; the root of a set is its least member."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.up.setdefault(min(a, b), min(a, b))

    def stars(self) -> tuple[list[int], list[int]]:
        """Edges from every member but the roots to its root."""
        nodes = [x for x in self.up if self.find(x) != x]
        return nodes, [self.find(x) for x in nodes]


def _contract(edges: DataFrame) -> DataFrame:
    def make():
        def each(batch):
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i in range(0, len(a), CHUNK):
                sets = UnionFind()
                for x, y in zip(a[i : i + CHUNK].tolist(), b[i : i + CHUNK].tolist(), strict=True):
                    sets.join(x, y)
                nodes, roots = sets.stars()
                if nodes:
                    yield [pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())]

        return each

    return runtime.map_arrow(edges, ["a", "b"], make, [("a", T.LongType()), ("b", T.LongType())], [])


def components(edges: DataFrame, scratch: runtime.Scratch) -> DataFrame:
    """(node, label) for every node of the edges (a, b); label is the least node of its component."""
    both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b and a is not null and b is not null")
    now = scratch.table(_contract(both).distinct(), "edges")  # a > b
    mark = _mark(now)
    while mark[0]:
        sym = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sym.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = sym.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.table(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))
        after = scratch.table(small.where("a <> b").distinct(), "edges")
        fresh = _mark(after)
        scratch.drop(now, large)
        now = after
        if fresh == mark:
            break
        mark = fresh
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(roots)


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free checksum, to tell when a round changes nothing."""
    r = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
    return (r[0], r[1])


