"""Token-budget batches: a greedy cut of an ordered table by a running budget.

Rows are taken in order; a batch takes rows while their summed cost stays within ``budget`` (a row that is
dearer is a batch of its own).  Where a batch begins depends on all rows before it, so a running sum
with resets is no window function.  It is a scan with jump pointers: a range partition of the order tells,
for every place where its first new batch may begin (at most a budget's worth of rows), how many
batches follow and what the last one holds; these small tables are folded in order, and every
partition then numbers its rows from the state it is entered in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def jumps(cost: np.ndarray, budget: int) -> tuple[np.ndarray, list[int], list[int]]:
    """(prefix sums, batches from row i on if one begins there, where the last of them begins)."""
    m = len(cost)
    prefix = np.concatenate(([0], np.cumsum(cost)))
    after = np.maximum(np.searchsorted(prefix, prefix[:-1] + budget, side="right") - 1, np.arange(1, m + 1)).tolist()
    many, last = [1] * m, list(range(m))
    for i in range(m - 1, -1, -1):
        if after[i] < m:
            many[i], last[i] = 1 + many[after[i]], last[after[i]]
    return prefix, many, last


def _summary(budget: int):
    def run(batches):
        cost, pid = [], None
        for b in batches:
            if b.num_rows:
                pid = b.column("_pid")[0].as_py()
                cost.append(b.column("_cost").to_numpy())
        if pid is None:
            return
        cost = np.concatenate(cost)
        prefix, many, last = jumps(cost, budget)
        m = len(cost)
        reach = int(np.searchsorted(prefix, budget, side="right"))  # a batch entered before is full by then
        at = np.flatnonzero(cost[:reach] > 0)
        at = at if len(at) and at[0] == 0 else np.r_[0, at].astype(np.int64)
        tail = [int(prefix[m] - prefix[last[i]]) for i in at]
        yield pa.RecordBatch.from_pydict({"pid": pa.array([pid] * len(at), pa.int32()), "at": pa.array(at), "upto": pa.array(prefix[at + 1]),
                                          "many": pa.array([many[i] for i in at], pa.int64()), "tail": pa.array(tail, pa.int64()),
                                          "total": pa.array([int(prefix[m])] * len(at), pa.int64())})

    return run


def _fold(budget: int):
    """Entering state of every partition: what the open batch holds (-1: none is open) and how many batches began."""
    def run(batches):
        held, began, out = -1, 0, []
        rows = [r for b in batches for r in b.to_pylist()]
        start = 0
        while start < len(rows):
            stop = start
            while stop < len(rows) and rows[stop]["pid"] == rows[start]["pid"]:
                stop += 1
            out.append({"pid": rows[start]["pid"], "held": held, "began": began})
            hit = next((r for r in rows[start:stop] if held < 0 or held + r["upto"] > budget), None)
            if hit is None:
                held += rows[start]["total"]
            else:
                held, began = hit["tail"], began + hit["many"]
            start = stop
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("pid", pa.int32()), ("held", pa.int64()), ("began", pa.int64())]))

    return run


def _number(budget: int, entered: dict[int, tuple[int, int]], names: list[str]):
    def run(batches):
        held = began = None
        for b in batches:
            if not b.num_rows:
                continue
            if held is None:
                held, began = entered[b.column("_pid")[0].as_py()]
            prefix = np.concatenate(([0], np.cumsum(b.column("_cost").to_numpy())))
            n, ids, i = b.num_rows, np.empty(b.num_rows, np.int64), 0
            while i < n:
                if held < 0 or held + prefix[i + 1] - prefix[i] > budget:
                    held, began = 0, began + 1
                    j = max(i + 1, int(np.searchsorted(prefix, prefix[i] + budget, side="right")) - 1)
                else:
                    j = int(np.searchsorted(prefix, prefix[i] + budget - held, side="right")) - 1
                ids[i:j] = began - 1
                held += int(prefix[j] - prefix[i])
                i = j
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(ids)], [*names, "batch_id"])

    return run


def budget_batches(df: DataFrame, cost: str, order: list, budget: int) -> DataFrame:
    """``df`` with ``batch_id`` (0, 1, 2, ... in ``order``, a total order); costs are whole numbers, 0 or more.

    A null cost counts as 0; an empty table gives an empty result.
    """
    names = df.columns
    tagged = df.select("*", F.greatest(F.coalesce(F.col(cost).cast("long"), F.lit(0)), F.lit(0)).alias("_cost"))
    tagged = tagged.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True)
    small = tagged.select("_pid", "_cost").mapInArrow(_summary(budget), "pid int, at long, upto long, many long, tail long, total long")
    states = small.repartition(1).sortWithinPartitions("pid", "at").mapInArrow(_fold(budget), "pid int, held long, began long").collect()
    entered = {r.pid: (r.held, r.began) for r in states}  # two numbers a partition
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", batch_id long"
    return tagged.mapInArrow(_number(budget, entered, names), kind)
