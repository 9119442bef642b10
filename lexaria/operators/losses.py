"""In-batch similarity losses (D6, D8, E23-E26) as block products.

A batch table is ``(batch_id, i, vec...)``.  The rows of a batch come to one task (a batch is
bounded by the batch size, a parameter), which multiplies its matrices in blocks of ``BLOCK`` rows
and keeps a running maximum and sum of exponentials per row.  What leaves the task of a loss is one
row per input row: log-probabilities, gradients.  D6 and D8 are the pairs of a batch themselves, batch
size times the rows; they leave the task a block at a time and are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaria.functions import vectors as Vx
from lexaria.functions.arrow import by_key, lists, matrix

BLOCK = 256


def unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows over their clamped length, lengths)."""
    n = np.sqrt((m * m).sum(1))
    return m / np.maximum(n, 1e-12)[:, None], n


def blocks(u: np.ndarray, v: np.ndarray, diagonal: bool) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Products ``u v^T`` block by block; without ``diagonal`` a row's own column is ``-inf``."""
    for a in range(0, len(u), BLOCK):
        for b in range(0, len(v), BLOCK):
            p = u[a:a + BLOCK] @ v[b:b + BLOCK].T
            if not diagonal and a == b:
                np.fill_diagonal(p, -np.inf)
            yield slice(a, a + len(p)), slice(b, b + p.shape[1]), p


class RunningLse:
    """Log of the sum of exponentials of every row, fed with blocks of its entries."""

    def __init__(self, n: int):
        self.top, self.sum = np.full(n, -np.inf), np.zeros(n)

    def add(self, rows: slice, x: np.ndarray) -> None:
        top = np.maximum(self.top[rows], x.max(1))
        base = np.where(np.isfinite(top), top, 0.0)
        self.sum[rows] = self.sum[rows] * np.exp(self.top[rows] - base) + np.exp(x - base[:, None]).sum(1)
        self.top[rows] = top

    def value(self) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return np.where(np.isfinite(self.top), self.top, 0.0) + np.log(self.sum)


def _per_batch(batch: DataFrame, cols: list[str], fn, schema: str) -> DataFrame:
    """``fn(matrices) -> columns`` for every batch; adds batch_id, i and n (rows of the batch)."""
    src = batch.select("batch_id", "i", *[Vx.as_double(c).alias(c) for c in cols])
    src = src.repartition("batch_id").sortWithinPartitions("batch_id", "i")
    kind = ", ".join(f"{c} {src.schema[c].dataType.simpleString()}" for c in ("batch_id", "i"))

    def run(batches):
        for t in by_key(batches, "batch_id"):
            out = fn(*[matrix(t.column(c)) for c in cols])
            t = t.combine_chunks()
            fixed = {"batch_id": t.column("batch_id").chunk(0), "i": t.column("i").chunk(0),
                     "n": pa.array(np.full(t.num_rows, t.num_rows, np.int64))}
            yield pa.RecordBatch.from_pydict(fixed | out)

    return src.mapInArrow(run, f"{kind}, n long, {schema}")


def _batch_pairs(batch: DataFrame, cols: list[str], sides: list[tuple[str, str, str]], diagonal: bool) -> DataFrame:
    """One row per pair (i, j) of a batch: the cosine of column ``a`` of row i and column ``b`` of row j for every (name, a, b)."""
    src = batch.select("batch_id", "i", *[Vx.as_double(c).alias(c) for c in cols])
    src = src.repartition("batch_id").sortWithinPartitions("batch_id", "i")
    kind, at = (src.schema[c].dataType.simpleString() for c in ("batch_id", "i"))

    def run(batches):
        for t in by_key(batches, "batch_id"):
            t = t.combine_chunks()
            batch_id, rows = t.column("batch_id").chunk(0), t.column("i").chunk(0)
            units, known = {}, {}
            for c in cols:
                col = t.column(c).combine_chunks()
                col = pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) else col
                known[c] = np.array([x.is_valid and x.values.null_count == 0 for x in col]) if col.null_count or col.flatten().null_count \
                    else np.ones(len(col), bool)
                units[c] = np.zeros((len(col), 0))
                if known[c].any():  # a vector that is null or has null components has no cosine
                    m = matrix(col.filter(pa.array(known[c])))
                    units[c] = np.zeros((len(col), m.shape[1]))
                    units[c][known[c]] = unit(m)[0]
            for parts in zip(*[blocks(units[a], units[b], True) for _, a, b in sides]):
                r, c, p = parts[0]
                x, y = (k.ravel() for k in np.mgrid[r, c])
                stay = np.arange(len(x)) if diagonal else np.flatnonzero(x != y)
                found = {name: pa.array(q.ravel()[stay], mask=~(known[a][x] & known[b][y])[stay])
                         for (name, a, b), (_, _, q) in zip(sides, parts)}
                yield pa.RecordBatch.from_pydict({"batch_id": batch_id.take(pa.array(x[stay])), "i": rows.take(pa.array(x[stay])),
                                                  "j": rows.take(pa.array(y[stay]))} | found)

    return src.mapInArrow(run, f"batch_id {kind}, i {at}, j {at}, " + ", ".join(f"{name} double" for name, _, _ in sides))


def in_batch_pairs(batch: DataFrame, cols: list[str]) -> DataFrame:
    """The cosine of every column for all pairs ``i <> j`` of a batch.  Output ``(batch_id, i, j, <col>...)``."""
    return _batch_pairs(batch, cols, [(c, c, c) for c in cols], False)


def bipartite_pairs(batch: DataFrame, src: str = "src", tgt: str = "tgt") -> DataFrame:
    """The cosine ``src_i . tgt_j`` for every i, j of a batch, the diagonal included.  Output ``(batch_id, i, j, sim)``."""
    return _batch_pairs(batch, [src, tgt], [("sim", src, tgt)], True)


def through_unit(d: np.ndarray, u: np.ndarray, length: np.ndarray) -> pa.Array:
    """Gradient wrt the raw vector from the one wrt its unit vector; null where the vector is zero."""
    g = d - u * (u * d).sum(1)[:, None]
    out = lists(g / np.where(length > 0, length, 1.0)[:, None])
    return pa.ListArray.from_arrays(out.offsets, out.values, mask=pa.array(length <= 0)) if (length <= 0).any() else out


def distillation_block(s: np.ndarray, t: np.ndarray, temperature: float, gradient: bool) -> dict[str, pa.Array]:
    """The columns of ``distillation_rows`` for the rows of one batch."""
    (u, length), (v, _), n = unit(s), unit(t), len(s)
    if n < 2:
        zero = pa.array(np.zeros(n))
        return {"q": zero, "ql": zero} | ({"ds": pa.nulls(n, pa.list_(pa.float64()))} if gradient else {})
    zs, zt = RunningLse(n), RunningLse(n)
    for (r, _, ps), (_, _, pt) in zip(blocks(u, u, False), blocks(v, v, False)):
        zs.add(r, ps / temperature)
        zt.add(r, pt / temperature)
    zs, zt, q, ql, du = zs.value(), zt.value(), np.zeros(n), np.zeros(n), np.zeros_like(u)
    for (r, c, ps), (_, _, pt) in zip(blocks(u, u, False), blocks(v, v, False)):
        log_p = ps / temperature - zs[r, None]
        big_q = np.exp(pt / temperature - zt[r, None])
        q[r] += big_q.sum(1)
        ql[r] -= np.where(big_q > 0, big_q * np.where(np.isfinite(log_p), log_p, 0.0), 0.0).sum(1)
        if gradient:
            g = (np.exp(log_p) - big_q) / (n * temperature)
            du[r] += g @ u[c]
            du[c] += g.T @ u[r]
    return {"q": pa.array(q), "ql": pa.array(ql)} | ({"ds": through_unit(du, u, length)} if gradient else {})


def distillation_rows(batch: DataFrame, temperature: float = 0.05, student: str = "student", teacher: str = "teacher",
                      gradient: bool = False) -> DataFrame:
    """Per row of a batch: ``q = Σ_j Q_ij`` and ``ql = -Σ_j Q_ij log P_ij`` over j <> i, and with ``gradient`` the
    vector ``ds`` of the batch loss ``Σ ql / n`` wrt the raw student vector.

    P and Q are the softmax of the students' and the teachers' cosines over ``temperature``.
    """
    return _per_batch(batch, [student, teacher], lambda s, t: distillation_block(s, t, temperature, gradient),
                      "q double, ql double" + ", ds array<double>" * gradient)


def distillation_of(rows: DataFrame, min_batch: int = 2) -> DataFrame:
    """``(batch_id, loss, n)`` from ``distillation_rows``; batches under ``min_batch`` rows are skipped."""
    per = rows.groupBy("batch_id").agg((F.sum("ql") / F.sum("q")).alias("loss"), F.max("n").alias("n"), F.sum("q").alias("_q"))
    return per.where((F.col("n") >= min_batch) & (F.col("_q") > 0)).drop("_q")


def distillation_loss(batch: DataFrame, temperature: float = 0.05, student: str = "student",
                      teacher: str = "teacher", min_batch: int = 2) -> DataFrame:
    """E23 per batch: ``-Σ_{i≠j} Q_ij log P_ij / Σ Q`` with row softmax at ``T``.  Output ``(batch_id, loss, n)``."""
    return distillation_of(distillation_rows(batch, temperature, student, teacher), min_batch)


def contrastive_block(s: np.ndarray, t: np.ndarray, temperature: float, gradient: bool) -> dict[str, pa.Array]:
    """The columns of ``contrastive_rows`` for the rows of one batch."""
    (u, nu), (v, nv), n = unit(s), unit(t), len(s)
    rows, cols = RunningLse(n), RunningLse(n)
    for r, c, p in blocks(u, v, True):
        rows.add(r, p / temperature)
        cols.add(c, p.T / temperature)
    zr, zc, own = rows.value(), cols.value(), (u * v).sum(1) / temperature
    out = {"row_logp": pa.array(own - zr), "col_logp": pa.array(own - zc)}
    if gradient:
        du, dv = np.zeros_like(u), np.zeros_like(v)
        for r, c, p in blocks(u, v, True):
            g = np.exp(p / temperature - zr[r, None]) + np.exp(p / temperature - zc[None, c])
            if r == c:
                np.fill_diagonal(g, g.diagonal() - 2)
            g /= n * temperature
            du[r] += g @ v[c]
            dv[c] += g.T @ u[r]
        out |= {"dsrc": through_unit(du, u, nu), "dtgt": through_unit(dv, v, nv)}
    return out


def contrastive_rows(batch: DataFrame, temperature: float = 0.05, src: str = "src", tgt: str = "tgt",
                     gradient: bool = False) -> DataFrame:
    """Per row of a batch the log-probability of its own pair in its row (``row_logp``) and column (``col_logp``) of
    the cosines over ``temperature``, and with ``gradient`` ``dsrc`` and ``dtgt`` wrt the raw vectors."""
    return _per_batch(batch, [src, tgt], lambda s, t: contrastive_block(s, t, temperature, gradient),
                      "row_logp double, col_logp double" + ", dsrc array<double>, dtgt array<double>" * gradient)


def contrastive_of(rows: DataFrame) -> DataFrame:
    """``(batch_id, loss, n)`` from ``contrastive_rows``."""
    return rows.groupBy("batch_id").agg((-F.avg("row_logp") - F.avg("col_logp")).alias("loss"), F.max("n").alias("n"))


def contrastive_loss(batch: DataFrame, temperature: float = 0.05, src: str = "src", tgt: str = "tgt") -> DataFrame:
    """E24 per batch: ``-mean_i log softmax_j(sim/T)[i,i]`` plus the same over columns."""
    return contrastive_of(contrastive_rows(batch, temperature, src, tgt))


def cosine_regression_loss(outputs: DataFrame, targets: DataFrame, params: DataFrame, key: str = "text_id",
                           l2: float = 1e-5) -> DataFrame:
    """``mean(1 - cos(out, target)) + l2 · mean(E²)`` over every parameter entry."""
    j = outputs.select(key, F.col("vec").alias("o")).join(targets.select(key, F.col("vec").alias("t")), key)
    cos = j.select((F.lit(1.0) - Vx.dot(Vx.l2_normalize_clamped("o"), Vx.l2_normalize_clamped("t"))).alias("d"))
    reg = params.select(F.explode("vec").alias("e")).agg(F.avg(F.col("e") * F.col("e")).alias("ms"))
    main = cos.agg(F.avg("d").alias("cos_loss"), F.count(F.lit(1)).cast("bigint").alias("n"))
    reg_value = reg.first()["ms"]  # one scalar
    return main.select("n", "cos_loss", (F.col("cos_loss") + F.lit(l2 * (reg_value or 0.0))).alias("loss"))


def epoch_loss(batch_losses: DataFrame, how: str = "mean") -> DataFrame:
    """Mean over batches (``/max(n,1)``) or, historically, the sum."""
    if how == "sum":
        return batch_losses.agg(F.coalesce(F.sum("loss"), F.lit(0.0)).alias("epoch_loss"))
    return batch_losses.agg(
        (F.coalesce(F.sum("loss"), F.lit(0.0)) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("epoch_loss")
    )
