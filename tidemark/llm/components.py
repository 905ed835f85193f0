"""Connected components of an edge table, by union-find in two levels.

Each partition of edges is first joined by a local union-find, which leaves a
forest of stars. Then all nodes move to the least neighbour at once and the
graph is contracted to the nodes moved to, until no edge is left; the number of
rounds grows with the logarithm of the longest chain. Nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Nodes that one local union-find holds at a time.
LOCAL_NODES = 1_000_000


def local_stars(edges: DataFrame) -> DataFrame:
    """The edges (a, b) of each partition as (node, least node reached there)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while (up := parent.setdefault(root, root)) != root:
                root = up
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        def stars() -> pa.RecordBatch:
            rows = [(x, find(x)) for x in list(parent)]
            a, b = zip(*[r for r in rows if r[0] != r[1]], strict=True) if any(x != y for x, y in rows) else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = find(a), find(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            if len(parent) > LOCAL_NODES:
                yield stars()
                parent.clear()
        yield stars()

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a long, b long): the least node that it reaches.

    Rows with a null are no edges; loops and repeated edges change nothing; nodes
    of loops alone don't appear.
    """
    edges = materialize(local_stars(edges.filter("a is not null and b is not null and a <> b")), "components-edges")
    labels, n, nodes = None, edges.count(), 0
    while n:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moved = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")).toDF("node", "to"), "components-moves", 2 * n)
        if labels is None:
            labels, nodes = moved.toDF("node", "root"), 2 * n
        else:
            step = moved.toDF("root", "to")
            labels = labels.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
            labels = materialize(labels, "components-labels", nodes)
        a, b = moved.toDF("a", "a2"), moved.toDF("b", "b2")
        nearer = edges.join(a, "a").join(b, "b").select(F.col("a2").alias("a"), F.col("b2").alias("b"))
        edges = materialize(nearer.filter("a <> b").distinct(), "components-edges", n)
        n = edges.count()
    return edges.toDF("node", "root") if labels is None else labels
