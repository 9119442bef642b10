"""Approximate nearest neighbours with an inverted multi-index (operator 2).

Index: the two halves of every vector are quantised separately (codebooks of ``words``
centroids each, k-means on a bounded sample of ``SAMPLE`` rows); every row is filed under
its pair of centroids, and all rows are indexed.

Search: a query walks the centroid pairs with a heap, from the pair of the smallest summed
squared distance of the halves upwards.  Per pair the index knows the number of entries and how far
entries scatter around the centroids, so the expected number of true neighbours in a pair
follows from a normal tail; the walk ends when at most ``MISS`` of the ``k`` wanted
neighbours are expected in the pairs not walked.  Clustered data end the walk early,
unstructured data late; recall is held, not the number of pairs.

Rerank: entries of the walked pairs are compared exactly, in double precision, in
blocks (entries of one first centroid, at most ``BLOCK``, against the queries that walk
it), and the best k per block meet in a final top k per query.

Scale: codebooks and pair statistics are bounded by ``words``; entries and queries meet by
an equi-join on the block, a hot pair of centroids is dealt over several blocks.

Cases: vectors that are null, empty, zero, of another than the most frequent length or
holding null or non-finite components, and rows with a null id, take no part; equal
scores rank by smaller id; repeated ids are separate candidates, and every row but the
query row itself is one; fewer candidates than k are all returned; an empty table
gives an empty result.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexaria.llm.common import keep
from lexaria.llm.vectors import matrix, packed, table_dimension, usable

SAMPLE = 20_000
BLOCK = 4096
MISS = 0.02
MAX_WORDS = 256


def codebook(x: np.ndarray, words: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Centroids of a bounded sample by Lloyd's rounds."""
    rng = np.random.default_rng(seed)
    if x.shape[1] == 0 or len(x) == 0:
        return np.zeros((1, x.shape[1]))
    c = x[rng.choice(len(x), min(words, len(x)), replace=False)].copy()
    for _ in range(rounds):
        a = nearest(x, c)
        n = np.bincount(a, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, a, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(1)


def tail(z: np.ndarray) -> np.ndarray:
    """Upper tail of the standard normal distribution (logistic-type fit, error below 2e-4)."""
    return 1 / (1 + np.exp(np.clip(0.07056 * z ** 3 + 1.5976 * z, -700, 700)))


def walk(q, left, right, count, spread, k: int, miss: float = MISS) -> list[tuple[int, int]]:
    """Centroid pairs for one query, nearest summed distance first, until at most miss * k
    of its k best entries are expected outside.

    count: entries per pair; spread: (mean squared scatter per dimension of the left
    words, of the right words).
    """
    h = left.shape[1]
    a, b = q[:h], q[h:]
    da, db = ((left - a) ** 2).sum(1), ((right - b) ** 2).sum(1)
    mean = (left @ a)[:, None] + (right @ b)[None, :]
    sd = np.sqrt(np.maximum((a @ a) * spread[0][:, None] + (b @ b) * spread[1][None, :], 1e-12))
    total = int(count.sum())
    if total <= k + 1:
        return [(int(i), int(j)) for i, j in zip(*np.nonzero(count))]
    lo, hi = float((mean - 8 * sd).min()), float((mean + 8 * sd).max())
    for _ in range(30):  # the score that k entries are expected to pass
        mid = (lo + hi) / 2
        if (count * tail((mid - mean) / sd)).sum() > k:
            lo = mid
        else:
            hi = mid
    expect = count * tail((lo - mean) / sd)
    want, got, held, out = (1 - miss) * expect.sum(), 0.0, 0, []
    ia, ib = np.argsort(da, kind="stable"), np.argsort(db, kind="stable")
    da, db = da[ia].tolist(), db[ib].tolist()
    expect, n = expect[np.ix_(ia, ib)].tolist(), count[np.ix_(ia, ib)].tolist()
    heap, reach = [(da[0] + db[0], 0, 0)], [0] * len(da)
    while heap and (got < want or held <= k):
        _, i, j = heapq.heappop(heap)
        # pairs of row i come in order of j; row i + 1 opens with its first pair
        if n[i][j]:
            out.append((int(ia[i]), int(ib[j])))
            got += expect[i][j]
            held += n[i][j]
        reach[i] = j + 1
        if j + 1 < len(db):
            heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(da):
            heapq.heappush(heap, (da[i + 1] + db[0], i + 1, 0))
    return out


def _best(scores: np.ndarray, k: int):
    """(row, column) of every score that may be among its row's best k, ties included."""
    if scores.shape[1] > k:
        cut = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        return np.nonzero(scores >= (cut - 1e-9)[:, None])
    return np.nonzero(np.isfinite(scores))


def _rank(q, e, score, ids, k):
    """Best k entries of every query: order by score, then smaller id."""
    order = np.lexsort((ids[e], -score, q))
    q, e, score = q[order], e[order], score[order]
    start = np.r_[0, np.flatnonzero(q[1:] != q[:-1]) + 1]
    place = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
    ok = place < k
    return q[ok], e[ok], score[ok]


def _search_blocks(dim: int, k: int):
    def run(_key, entries: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if entries.num_rows and queries.num_rows:
            order = np.argsort(entries.column("b").to_numpy(), kind="stable")
            b = entries.column("b").to_numpy()[order]
            ids, rows = entries.column("vec_id").to_numpy()[order], entries.column("r").to_numpy()[order]
            x = matrix(entries.column("vec"), dim).astype(np.float64)[order]
            for s in range(0, queries.num_rows, 512):
                part = queries.slice(s, 512)
                y = matrix(part.column("vec"), dim).astype(np.float64)
                own = part.column("r").to_numpy()
                score = np.full((len(y), len(x)), -np.inf)
                at = part.column("bs").combine_chunks()
                who = np.repeat(np.arange(len(y)), np.diff(at.offsets.to_numpy()))
                what = at.flatten().to_numpy()
                for w in np.unique(b):
                    m = who[what == w]
                    lo, hi = np.searchsorted(b, [w, w + 1])
                    if len(m):
                        score[m, lo:hi] = y[m] @ x[lo:hi].T
                score[own[:, None] == rows[None, :]] = -np.inf
                q, e = _best(score, k)
                ok = np.isfinite(score[q, e])
                q, e = q[ok], e[ok]
                exact = (y[q] * x[e]).sum(1)  # same summation order for every copy of a vector
                q, e, exact = _rank(q, e, exact, ids, k)
                out.append(pa.table({"query_id": part.column("vec_id").to_numpy()[q], "q": own[q],
                                     "vec_id": ids[e], "r": rows[e], "score": exact}))
        empty = pa.table({c: pa.array([], t) for c, t in (("query_id", pa.int64()), ("q", pa.int64()),
                          ("vec_id", pa.int64()), ("r", pa.int64()), ("score", pa.float64()))})
        return pa.concat_tables(out) if out else empty

    return run


def search(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
           seed: int = 2) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows found for every row where ``is_query`` holds."""
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"),
                         is_query.alias("is_q"))
    good = src.where(F.col("vec_id").isNotNull() & usable(F.col("vec")))
    dim = table_dimension(good, "vec")
    rows = keep(good.where(F.size("vec") == dim).withColumn("r", F.monotonically_increasing_id()))
    h = dim // 2
    share = SAMPLE / max(SAMPLE, rows.count())
    drawn = rows.where(F.pmod(F.xxhash64("vec", "vec_id"), F.lit(1 << 20)) < int(share * (1 << 20))).select("vec")
    sample = matrix(drawn.limit(2 * SAMPLE).toArrow().column("vec").combine_chunks(), dim or 1).astype(np.float64)
    words = int(min(MAX_WORDS, max(4, 2 ** round(math.log2(max(1, len(sample)) / 64) / 1.5)))) if len(sample) else 1
    left, right = codebook(sample[:, :h], words, seed), codebook(sample[:, h:], words, seed + 1)

    def file(batches):
        for batch in batches:
            x = matrix(batch.column("vec"), dim)
            if len(x):
                y = x.astype(np.float64)
                a, b = nearest(y[:, :h], left), nearest(y[:, h:], right)
                sa, sb = ((y[:, :h] - left[a]) ** 2).sum(1), ((y[:, h:] - right[b]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("r"), batch.column("is_q"), packed(x),
                     pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(sa), pa.array(sb)],
                    ["vec_id", "r", "is_q", "vec", "a", "b", "sa", "sb"])

    index = keep(rows.select("vec_id", "r", "is_q", "vec").mapInArrow(
        file, "vec_id long, r long, is_q boolean, vec binary, a int, b int, sa double, sb double"))
    # pair statistics: at most words * words rows
    stats = index.groupBy("a", "b").agg(F.count("*").alias("n"), F.sum("sa").alias("sa"), F.sum("sb").alias("sb")).toArrow()
    count = np.zeros((len(left), len(right)))
    sums = [np.zeros(len(left)), np.zeros(len(right))]
    if stats.num_rows:
        a, b, n = (stats.column(c).to_numpy() for c in ("a", "b", "n"))
        count[a, b] = n
        np.add.at(sums[0], a, stats.column("sa").to_numpy())
        np.add.at(sums[1], b, stats.column("sb").to_numpy())
    spread = (sums[0] / np.maximum(count.sum(1), 1) / max(1, h), sums[1] / np.maximum(count.sum(0), 1) / max(1, dim - h))
    parts = [max(1, math.ceil(c / BLOCK)) for c in count.sum(1)]

    def route(batches):
        for batch in batches:
            y = matrix(batch.column("vec"), dim).astype(np.float64)
            at, aa, bs = [], [], []
            for i in range(len(y)):
                cells: dict[int, list[int]] = {}
                for a, b in walk(y[i], left, right, count, spread, k):
                    cells.setdefault(a, []).append(b)
                for a, b in cells.items():
                    at.append(i), aa.append(a), bs.append(b)
            if at:
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(take), batch.column("r").take(take), batch.column("vec").take(take),
                     pa.array(aa, pa.int32()), pa.array(bs, pa.list_(pa.int32()))], ["vec_id", "r", "vec", "a", "bs"])

    n_parts = F.element_at(F.array(*[F.lit(p) for p in parts]), F.col("a") + 1)
    entries = index.select("vec_id", "r", "vec", "a", "b", F.pmod(F.xxhash64("r"), n_parts).cast("int").alias("part"))
    asked = index.where("is_q").select("vec_id", "r", "vec")
    spread_q = asked.repartition(asked.sparkSession.sparkContext.defaultParallelism, "r")
    asked = spread_q.mapInArrow(route, "vec_id long, r long, vec binary, a int, bs array<int>")
    # queries of a block come in lots, so no task holds all queries of a walked word
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), n_parts - 1)))
    found = entries.groupBy("a", "part").cogroup(asked.groupBy("a", "part")).applyInArrow(
        _search_blocks(dim, k), "query_id long, q long, vec_id long, r long, score double")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id", "r")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
