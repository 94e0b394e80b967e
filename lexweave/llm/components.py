"""Connected components of an edge table.

Edges that fit one task's bound are contracted there.  More are contracted
share by share and then by alternating star steps, two group-minimum-and-join
steps a round, whose state is written to the shared folder; rounds grow with
the logarithm of the number of nodes.  No links, nodes or labels pass through
the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.runtime import arrow_map, stored, stored_map, written

#: Edges that a task contracts at once: 16 MB of node numbers.
TASK_EDGES = 1 << 20
_STAR = "node long, root long"


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, roots) of the edges: a root is its component's smallest node."""
    nodes, code = np.unique(np.concatenate((a, b)), return_inverse=True)
    left, right = code[: len(a)], code[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[left], root[right]
        apart = x != y
        if not apart.any():
            return nodes, nodes[root]
        left, right, x, y = left[apart], right[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:  # to the roots' roots
            up = root[root]
            if (up == root).all():
                break
            root = up


def _shares(limit: int, keep_roots: bool):
    """Contracts each ``limit`` edges of a partition to stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def star():
            a, b = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in (0, 1))
            nodes, roots = contracted(a, b)
            if not keep_roots:
                nodes, roots = nodes[nodes != roots], roots[nodes != roots]
            return pa.record_batch([pa.array(nodes), pa.array(roots)], names=["node", "root"])

        for batch in batches:
            held.append(batch)
            if not keep_roots and sum(x.num_rows for x in held) >= limit:
                yield star()
                held = []
        if held:
            yield star()

    return run


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to its smallest one."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Written, so that the join below can split a node with many neighbours.
    least = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = written(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    return down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60, task_edges: int = TASK_EDGES) -> DataFrame:
    """``edges(a long, b long)`` without nulls -> ``(node, root)``.

    ``root`` is the smallest id of the node's component.  Nodes without edges
    are not listed; self-loops and repeated edges are harmless; an empty edge
    table gives an empty result.
    """
    state = stored(edges.where("a <> b").select("a", "b"), "edges")
    before = None
    for _ in range(max_rounds):
        if state.rows <= task_edges:
            done = stored_map(state.frame.coalesce(1), _shares(task_edges, True), _STAR, "components")
            state.drop()
            return done.frame
        # A forest of stars is the fixed point: every node points at its root.
        stamp = (state.rows, state.frame.agg(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()[0])
        if stamp == before:
            break
        before = stamp
        shares = arrow_map(state.frame, _shares(task_edges, False), _STAR).toDF("a", "b")
        large = stored(_large_star(shares), "large-star")
        following = stored(_small_star(large.frame), "edges")
        state.drop()
        large.drop()
        state = following
    else:
        raise RuntimeError("components did not converge")
    current = state.frame
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
