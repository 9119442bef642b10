"""Embedding near-duplicates from randomised-rotation binary codes (operator 9).

Codes: a unit vector o is turned by random orthogonal rotations; per rotation its code is
the sign vector b (scaled by 1 / sqrt(d)) with the stored correction factor f = <b, o>.
For the turned partner q, <b, q> / f is an unbiased estimate of <o, q> whose error is
at most ``CONFIDENCE`` * sqrt((1 - f^2) / f^2 / (d - 1)) up to a tiny chance.  The average
over ``ESTIMATES`` rotations gives estimate and bound of a pair; q is stored in 4-bit steps,
whose rounding error is part of the bound.  Only pairs whose upper bound reaches
the threshold are recomputed exactly, in double precision.

Codes are computed once and stored.  Only they travel to the tables: a bucket's task names
the rows that have a pair to recompute there, and the vectors of those rows alone follow.

Candidates: rows meet in a table if ``bits`` code bits agree.  bits grows with the
logarithm of the row count (buckets hold a few unrelated rows at every size) and the
number of tables follows from the wanted recall at the threshold, since one sign bit
agrees with probability 1 - angle / pi.  A pair that meets in several tables is counted in
the first one only, so the link counts need no pair table.

Skew and scale: equal vectors are one row with a multiplicity; buckets above ``BLOCK``
rows are split into pairs of blocks; a task emits counts per row and a spanning forest,
never pairs.  The work inside a bucket of near copies is quadratic, in blocks, because
the contract asks for every vector's number of links.

Cases: vectors that are null, empty, zero, of another than the most frequent length, or
hold null or non-finite components, and rows with a null id, link with nothing and stay
with n_links 0 and their own id; equal vectors link with each other (their cosine is 1);
repeated ids are separate vectors; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaria.llm.common import Forest, keep, left_join_salted, pairs_in_groups, whole_groups
from lexaria.llm.components import connected_components
from lexaria.llm.vectors import matrix, packed, table_dimension, usable

BLOCK = 2048
BUCKET_ROWS = 8
RECALL = 0.998
CONFIDENCE = 5.0
ESTIMATES = 2


def rotations(dim: int, count: int, seed: int = 9) -> np.ndarray:
    """(count, dim, dim) random orthogonal matrices."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(count):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        out.append(q * np.sign(np.diag(r)))
    return np.stack(out)


def table_plan(rows: int, threshold: float) -> tuple[int, int]:
    """(bits per table, tables) for so many distinct vectors."""
    bits = max(4, math.ceil(math.log2(max(2, rows / BUCKET_ROWS))))
    agree = 1 - math.acos(threshold) / math.pi
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - agree ** bits))


def _keys(sign: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(rows, tables) bucket keys: consecutive runs of code bits."""
    per = sign.shape[1] // tables if sign.shape[1] >= bits * tables else bits
    weight = np.int64(1) << np.arange(bits, dtype=np.int64)
    return np.stack([sign[:, per * t:per * t + bits] @ weight for t in range(tables)], axis=1)


def encode(units: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sign bits of every rotation, packed code) of unit rows.

    A code holds the sign bits of all rotations, then for each of the first ``ESTIMATES`` the
    turned vector in 4-bit steps, then those rotations' step sizes and correction factors.
    """
    d = units.shape[1]
    turned = [units @ t for t in turn]
    sign = np.concatenate([x > 0 for x in turned], axis=1)
    parts, tail = [np.packbits(sign, axis=1)], []
    for x in turned[:ESTIMATES]:
        step = np.abs(x).max(1) / 7
        level = np.zeros((len(x), d + d % 2), np.uint8)
        level[:, :d] = np.rint(x / step[:, None]) + 8
        parts.append(level[:, ::2] << 4 | level[:, 1::2])
        tail.append(step)
    tail += [np.abs(x).sum(1) / math.sqrt(d) for x in turned[:ESTIMATES]]
    parts.append(np.stack(tail, axis=1).astype("<f4").view(np.uint8))
    return sign, np.concatenate(parts, axis=1)


def decode(code: np.ndarray, dim: int, n_turn: int):
    """(sign bits, estimates) of packed codes; an estimate is (turned, sign, factor, step)."""
    at, half = -(-n_turn * dim // 8), -(-dim // 2)
    sign = np.unpackbits(code[:, :at], axis=1, count=n_turn * dim)
    numbers = np.ascontiguousarray(code[:, at + ESTIMATES * half:]).view("<f4")
    found = []
    for r in range(ESTIMATES):
        step, factor = numbers[:, r], numbers[:, ESTIMATES + r]
        pair = code[:, at + r * half:at + (r + 1) * half]
        level = np.stack([pair >> 4, pair & 15], axis=2).reshape(len(code), -1)[:, :dim]
        turned = (level.astype(np.float32) - 8) * step[:, None]
        bits = sign[:, r * dim:(r + 1) * dim].astype(np.float32)
        found.append((turned, (2 * bits - 1) / np.float32(math.sqrt(dim)), factor, step))
    return sign, found


def upper_bounds(estimates, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Upper confidence bound of the inner products of rows i and j from their codes."""
    d = estimates[0][0].shape[1]
    est, var = np.zeros(len(i)), np.zeros(len(i))
    for turned, sign, factor, step in estimates:
        f = factor[i].astype(np.float64)
        est += np.einsum("ij,ij->i", sign[i], turned[j]) / f
        # the code's own error, and that of rounding the partner to its steps
        var += (np.maximum(0, 1 - f ** 2) / max(1, d - 1) + step[j].astype(np.float64) ** 2 / 12) / f ** 2
    n = len(estimates)
    return est / n + CONFIDENCE * np.sqrt(var) / n + 1e-5


def _hopeful(cols: dict, dim: int, n_turn: int, bits: int, tables: int, threshold: float):
    """Position pairs of whole buckets that may reach the threshold and meet in this table first."""
    code = matrix(cols["code"], -1)
    sign, estimates = decode(code, dim, n_turn)
    keys = _keys(sign, bits, tables)
    t, block, cross = cols["t"], cols["blk"], cols["a"] != cols["b"]
    for i, j in pairs_in_groups(cols["_group"]):
        live = ~cross[i] | (block[i] != block[j])
        i, j = i[live], j[live]
        for s in range(0, len(i), 65536):
            p, q = i[s:s + 65536], j[s:s + 65536]
            ok = upper_bounds(estimates, p, q) >= threshold
            p, q = p[ok], q[ok]
            # a pair counts in the first table it meets in
            ok = (keys[p] == keys[q]).argmax(axis=1) == t[p]
            yield p[ok], q[ok]


def _survivors(dim: int, threshold: float, n_turn: int, bits: int, tables: int):
    """Rows of a bucket that have a pair to recompute there; reads codes only."""
    names = ["t", "k", "a", "b", "blk", "g"]

    def run(batches):
        for cols in whole_groups(batches, ["t", "k", "a", "b"]):
            wanted = np.zeros(len(cols["g"]), bool)
            for p, q in _hopeful(cols, dim, n_turn, bits, tables, threshold):
                wanted[p] = True
                wanted[q] = True
            if wanted.any():
                yield pa.RecordBatch.from_arrays([pa.array(cols[c][wanted]) for c in names], names)

    return run


def _bucket_links(dim: int, threshold: float, n_turn: int, bits: int, tables: int):
    """Exact cosines of the surviving rows' hopeful pairs: links per row and a spanning forest."""
    def run(batches):
        for cols in whole_groups(batches, ["t", "k", "a", "b"]):
            raw = matrix(cols["vec"], dim).astype(np.float64)
            norm = np.sqrt((raw * raw).sum(1))
            n, ids = cols["n"], cols["g"]
            count = np.zeros(len(ids), np.int64)
            forest = Forest(len(ids))
            for p, q in _hopeful(cols, dim, n_turn, bits, tables, threshold):
                ok = (raw[p] * raw[q]).sum(1) / (norm[p] * norm[q]) >= threshold
                p, q = p[ok], q[ok]
                np.add.at(count, p, n[q])
                np.add.at(count, q, n[p])
                forest.add(p, q)
            got = np.flatnonzero(count)
            if len(got):
                root = forest.label[got]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[got]), pa.array(count[got]), pa.array(ids[root])], ["g", "links", "root"])

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                    threshold: float = 0.95, seed: int = 9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"))
    good = src.where(F.col("vec_id").isNotNull() & usable(F.col("vec")))
    dim = table_dimension(good, "vec")
    fits = F.col("vec_id").isNotNull() & usable(F.col("vec")) & (F.size("vec") == dim)

    # one row per distinct vector; its group id is assigned once, in the stored table
    flat = good.where(F.size("vec") == dim).groupBy("vec").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    flat = keep(flat.withColumn("g", F.monotonically_increasing_id()))
    rows = flat.count()
    bits, tables = table_plan(rows, threshold)
    n_turn = max(ESTIMATES, math.ceil(bits * tables / max(1, dim)))

    def code(batches):
        turn = rotations(dim, n_turn, seed)
        for b in batches:
            raw = matrix(b.column("vec"), dim)
            if len(raw):
                x = raw.astype(np.float64)
                x /= np.sqrt((x * x).sum(1))[:, None]
                sign, codes = encode(x, turn)
                k = _keys(sign, bits, tables)
                flat_k = pa.ListArray.from_arrays(pa.array(np.arange(len(k) + 1, dtype=np.int32) * tables), pa.array(k.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [b.column("g"), b.column("n"), packed(raw), packed(codes), flat_k], ["g", "n", "vec", "code", "ks"])

    if rows:
        shape = (dim, threshold, n_turn, bits, tables)
        bucket = ["t", "k", "a", "b"]
        coded = keep(flat.select("g", "n", "vec").mapInArrow(code, "g long, n long, vec binary, code binary, ks array<long>"))
        keyed = coded.select("g", F.posexplode("ks").alias("t", "k"))
        size = keyed.groupBy("t", "k").count().where("count > 1")
        size = size.select("t", "k", F.ceil(F.col("count") / F.lit(BLOCK)).cast("int").alias("parts"))
        keyed = keyed.join(size, ["t", "k"]).withColumn("blk", F.pmod(F.xxhash64("g"), F.col("parts")).cast("int"))
        keyed = keyed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        keyed = keyed.select("t", "k", F.least("blk", "o").alias("a"), F.greatest("blk", "o").alias("b"), "blk", "g")
        keyed = keyed.join(coded.select("g", "code"), "g")  # codes travel to shared buckets only
        keyed = keyed.repartition(*bucket).sortWithinPartitions(*bucket)
        alive = keep(keyed.mapInArrow(_survivors(*shape), "t int, k long, a int, b int, blk int, g long"))
        exact = alive.join(coded.select("g", "n", "vec", "code"), "g").repartition(*bucket).sortWithinPartitions(*bucket)
        found = keep(exact.mapInArrow(_bucket_links(*shape), "g long, links long, root long"))
        links = found.groupBy("g").agg(F.sum("links").alias("links"))
        comp = connected_components(found.select("g", "root"), "g", "root").withColumnRenamed("node", "g")
        per = flat.select("g", "n", "least", "vec").join(links, "g", "left").join(comp, "g", "left")
        per = per.withColumn("component", F.coalesce("component", "g"))
        per = keep(per.where("n > 1 or links is not null"))
        least = per.groupBy("component").agg(F.min("least").alias("component_id"))
        named = left_join_salted(per, least, "component", F.col("g"))
        named = keep(named.select("vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component_id"))
    else:
        named = keep(flat.select("vec", F.col("n").alias("links"), F.col("least").alias("component_id")))

    out = src.select("vec_id", F.when(fits, F.col("vec")).alias("vec"))
    out = left_join_salted(out, named, "vec", F.col("vec_id"), salts=4)
    comp = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"),
                      comp.eqNullSafe(F.col("vec_id")).alias("kept"))
