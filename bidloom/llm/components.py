"""Connected components of an edge table by alternating star steps; new edges go on from the components known before.

Edge tables of at most ``LOCAL_EDGES`` rows, by their counted number, are settled by one task of that bounded size instead of rounds of
shuffles. The components are the same either way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from bidloom.llm.common import drop_tables, recorded, stored


LOCAL_EDGES = 1 << 18  # 4 MB of node pairs


def least_nodes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges and the least node of the component of each: roots hook to lesser ones, then paths are halved."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def _settled(edges: DataFrame) -> DataFrame:
    """(node, root) of an edge table of bounded size, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy() for c in batch.columns] for batch in batches if batch.num_rows]
        if held:
            nodes, roots = least_nodes(*(np.concatenate(c) for c in zip(*held)))
            low = nodes != roots
            yield pa.RecordBatch.from_arrays([pa.array(nodes[low]), pa.array(roots[low])], ["node", "root"])

    return stored(edges.coalesce(1).mapInArrow(run, "node bigint, root bigint"), "components")


def _written(edges: DataFrame, name: str, tasks: int | None) -> tuple[DataFrame, tuple, list[str]]:
    """The distinct edges, written; their number and checksum as counted while writing; their folder."""
    seen = Observation()
    checksum = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("checksum")
    with recorded() as folder:
        table = stored(edges.filter("u <> v").distinct().observe(seen, F.count("*").alias("n"), checksum), name, tasks)
    return table, (seen.get["n"], seen.get["checksum"]), folder


def connected(edges: DataFrame, local_edges: int = LOCAL_EDGES, tasks: int | None = None) -> DataFrame:
    """(node, root): every node of ``edges`` (a, b) but the roots, with the least node of its component.

    A large star links a node's greater neighbours to the least of all; a small star its lesser ones. Each step takes a minimum per node,
    combined before the shuffle, and joins it to the edges, where a node of many edges is for Spark's skew join to split. Steps end when
    the edges are stars and stay the same, after a logarithmic number of rounds; a round's table goes when the next one is written. At most
    ``tasks`` tasks write a table.
    """
    current, mark, folder = _written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges", tasks)
    if mark[0] <= local_edges:
        return _settled(current)
    while True:
        both = current.unionAll(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        before, mark_before, folder_before = current, mark, folder
        current, mark, folder = _written(hung, "stars", tasks)
        drop_tables(before.sparkSession, folder_before)
        if mark == mark_before:
            break
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))


def extended(roots: DataFrame, links: DataFrame, local_edges: int = LOCAL_EDGES, tasks: int | None = None) -> DataFrame:
    """(node, root) after ``links`` (a, b) join some of the components of ``roots``: only the roots at their ends are looked at."""
    end = lambda s: roots.select(F.col("node").alias(s), F.col("root").alias(f"root_{s}"))
    ends = links.select("a", "b").join(end("a"), "a", "left").join(end("b"), "b", "left")
    above = connected(ends.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")), local_edges, tasks)
    raised = roots.join(above.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    return stored(raised.select("node", F.coalesce("top", "root").alias("root")).unionAll(above), "roots", tasks)
