"""Connected components: union-find inside tasks, stars between them.

Every task first runs a union-find over its own edges and passes on a spanning
forest only. Rounds of large-star and small-star (Kiveris et al. 2014) then
join the forests: each round is two groupings and joins on the node, its
result is written to the shared folder, and the rounds stop when the edges no
longer change, after about the logarithm of the longest path.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labeltext.llm.staging import stage


class UnionFind:
    """Union-find over values that can be ordered; the root is the smallest member."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def find(self, x):
        root = x
        while (up := self.parent.get(root, root)) != root:
            root = up
        while (up := self.parent.get(x, x)) != root:
            self.parent[x] = root
            x = up
        return root

    def union(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets, kind = UnionFind(), None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            sets.union(a, b)
    if kind is not None:
        nodes = list(sets.parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([sets.find(x) for x in nodes], kind)], ["u", "v"])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.shiftright(F.xxhash64("v", "u"), 20))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v: both long or both binary, not null).

    ``component`` is the smallest node reachable. Repeated edges, edges in
    either direction and edges from a node to itself may occur; a node with
    only the latter is left out (it is its own component). No edges: no rows.
    """
    now = stage(edges.where("u <> v").mapInArrow(_forest, edges.select("u", "v").schema).where("u <> v").distinct(), "cc-forest")
    state = None
    while (seen := _state(now)) != state:
        state = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-large-min")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stage(large, "cc-large")  # every row points from the larger to the smaller node
        least = stage(large.groupBy("u").agg(F.min("v").alias("m")), "cc-small-min")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = stage(small.where("u <> v").distinct(), "cc-small")
    root = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return root.unionByName(root.select(F.col("component").alias("node"), "component").distinct())
