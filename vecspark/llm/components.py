"""Connected components by contraction, as Spark joins.

Each round every node moves to its neighbour (or itself) of least hashed
priority, which merges a constant share of the nodes in expectation; the
edges are relabelled and repeated ones dropped until none is left.  Hubs only
meet in partial minima and in joins that adaptive execution can split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import tidy, write_table

#: edges that one pass of the in-task contraction holds
LOCAL_EDGES = 1 << 20


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for every node that is not its component's least node."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[:len(a)], inv[len(a):]
    lab = np.arange(len(nodes))
    while True:
        m = np.minimum(lab[x], lab[y])
        new = lab.copy()
        np.minimum.at(new, lab[x], m)
        np.minimum.at(new, lab[y], m)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[lab]
        if np.array_equal(new, lab):
            break
        lab = new
    moved = np.flatnonzero(lab != np.arange(len(nodes)))
    return nodes[moved], nodes[lab[moved]]


def _contract(batches):
    held_a, held_b, held = [], [], 0

    def out():
        a, b = local_forest(np.concatenate(held_a), np.concatenate(held_b))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for rb in batches:
        held_a.append(rb.column(0).to_numpy())
        held_b.append(rb.column(1).to_numpy())
        held += rb.num_rows
        if held >= LOCAL_EDGES:
            yield out()
            held_a, held_b, held = [], [], 0
    if held:
        yield out()


def connected_components(spark: SparkSession, edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """(node, label) for each node of ``edges`` (two long columns, no nulls); label: the least node it reaches.

    An empty input gives an empty result; loops and repeated edges are allowed.
    ``tasks``: of each written table, at most (see ``write_table``).
    """
    a, b = edges.columns
    edges = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    edges = write_table(spark, edges.mapInArrow(tidy(_contract), "a long, b long").distinct(), "cc-edges", tasks)
    place = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = F.min(F.struct(F.xxhash64("b").alias("p"), F.col("b").alias("v")))
        own = F.struct(F.xxhash64("a").alias("p"), F.col("a").alias("v"))
        parent = write_table(spark, both.groupBy("a").agg(best.alias("m"))
                             .select(F.col("a").alias("node"), F.least(own, F.col("m"))["v"].alias("to")), "cc-parent", tasks)
        if place is None:
            place = parent
        else:
            moved = parent.select(F.col("node").alias("to"), F.col("to").alias("then"))
            place = write_table(spark, place.join(moved, "to", "left")
                                .select("node", F.coalesce("then", "to").alias("to")), "cc-place", tasks)
        pa_, pb_ = (parent.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}")) for c in ("a", "b"))
        edges = write_table(spark, edges.join(pa_, "a").join(pb_, "b").where("to_a != to_b")
                            .select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
                            .distinct(), "cc-edges", tasks)
    if place is None:
        return spark.createDataFrame([], "node long, label long")
    least = write_table(spark, place.groupBy("to").agg(F.min("node").alias("label")), "cc-least", tasks)
    return place.join(least, "to").select("node", "label")
