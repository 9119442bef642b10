"""Connected components of an edge table: distributed union-find.

An edge points from its larger end u to its smaller end v.  Each round deals every edge to
the tasks of both its ends; a task unites the ends it sees and answers with one edge
per node to the smallest node it is united with.  Chains halve in every round, and only
stars around the smallest nodes are stable, so the rounds end when the edges stay the same.

A hub (the smallest id of a huge component) would bring all its edges to one task.  So a
node's tasks are ``SALTS`` many: edges that lead down to it are dealt over them, edges that lead
on from it (few, after the first round one) go to all of them.  No neighbour list, component or
label table is collected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaria.llm.common import Forest, keep

SALTS = 6


def _unite(batches):
    """One task's edges; the task holds two integers per edge dealt to it."""
    parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    u, v = (np.concatenate(x) for x in zip(*parts))
    nodes, at = np.unique(np.r_[u, v], return_inverse=True)  # sorted: the smallest position is the smallest node
    forest = Forest(len(nodes))
    forest.add(at[:len(u)], at[len(u):])
    i, root = forest.stars()
    yield pa.RecordBatch.from_arrays([pa.array(nodes[i]), pa.array(nodes[root])], ["u", "v"])


def _round(edges: DataFrame) -> DataFrame:
    to = [F.struct(F.col("v").alias("k"), F.pmod(F.xxhash64("u"), F.lit(SALTS)).cast("int").alias("s"))]
    to += [F.struct(F.col("u").alias("k"), F.lit(s).alias("s")) for s in range(SALTS)]
    dealt = edges.select("u", "v", F.explode(F.array(*to)).alias("t")).repartition("t.k", "t.s")
    return dealt.select("u", "v").mapInArrow(_unite, "u long, v long").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(xxhash64(v, u) % 1000003)")).first())


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Self loops and repeated edges are harmless; an empty edge table gives an empty result.
    Ids must be integers; null ends are ignored.
    """
    e = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u <> v")
    e = keep(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(e)
    while state[0]:
        e = keep(_round(e))
        now = _state(e)
        if now == state:
            break
        state = now
    hubs = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(hubs)
