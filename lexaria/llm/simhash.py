"""SimHash near-duplicates with pigeonring candidate filtering (operator 8).

Fingerprint: words of the lower-cased (A-Z) text, shingles of ``shingle`` words
joined by one space with repeats, XXH64 (seed 42) of each; a bit is 1 where more
than half of the hashes have it.  Links: at most ``max_distance`` (k) differing bits.

Pigeonring: the 64 bits form a ring of k + 1 segments.  If two fingerprints
differ in at most k bits, some start segment has, for every l, at most l - 1
differences in its first l segments (budget l * k / (k + 1), rounded down).  So
the start segment is equal and the next one differs in at most one bit, hence
one of its halves is equal too.  Start segment plus that half is the bucket key
(24 of 64 bits at k = 3); inside a bucket the chain budgets are checked in turn
and only survivors get the full Hamming check.

Skew and scale: only distinct fingerprints enter buckets, so copies cost
nothing; a bucket above ``BLOCK`` fingerprints is split into pairs of blocks
that go to different tasks; a task emits a spanning forest of the links it finds
(at most one edge per row), never the pairs.

Cases: null text counts as empty; no words give fingerprint zero, which links
like any other; fewer words than a shingle give one shingle of all words; rows
with equal text, or repeated rows, share a fingerprint and so a component; a
null doc_id never names a component unless all ids in it are null; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaria.llm.common import Forest, keep, left_join_salted, of_texts, pairs_in_groups, whole_groups
from lexaria.llm.components import connected_components
from lexaria.llm.hashing import xxh64_slices

BLOCK = 4096
_SPREAD = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)


def _bit_counts(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(documents, 64) counts of set bits; hashes of document d are h[starts[d]:starts[d + 1]]."""
    lens = np.diff(np.r_[starts, len(h)])
    # byte lanes overflow above 255 addends, so a document is summed in runs of at most 255
    runs = (lens + 254) // 255
    first = np.repeat(starts, runs) + 255 * (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
    owner = np.repeat(np.arange(len(starts)), runs)
    by = h.view(np.uint8).reshape(-1, 8)
    out = np.zeros((len(starts), 64), np.int64)
    for b in range(8):
        lanes = np.add.reduceat(_SPREAD[by[:, b]], first)
        np.add.at(out[:, 8 * b:8 * b + 8], owner, lanes.view(np.uint8).reshape(-1, 8))
    return out


def fingerprints(texts: list[str | None], shingle: int = 3) -> np.ndarray:
    """Unsigned 64-bit SimHash of every text."""
    words = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    out = np.zeros(len(texts), np.uint64)
    counts = np.array([len(w) for w in words])
    docs = np.flatnonzero(counts)
    if not len(docs):
        return out
    data = b" ".join(b" ".join(words[d]) for d in docs)
    gap = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    begin, end = np.r_[0, gap + 1], np.r_[gap, len(data)]
    n = counts[docs]
    base = np.cumsum(n) - n
    per = np.maximum(n - shingle + 1, 1)
    starts = np.cumsum(per) - per
    first = np.repeat(base, per) + (np.arange(per.sum()) - np.repeat(starts, per))
    last = first + np.repeat(np.minimum(n, shingle), per) - 1
    h = xxh64_slices(data, begin[first], end[last])
    bits = 2 * _bit_counts(h, starts) > per[:, None]
    out[docs] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long, one row per input row."""
    return _marked(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "text", shingle)


def _marked(src: DataFrame, text: str, shingle: int) -> DataFrame:
    """``src`` with the fingerprint ``fp`` instead of its column ``text``."""
    mark = of_texts("long", lambda texts: fingerprints(texts, shingle).view(np.int64))
    return src.withColumn("fp", mark(F.col(text))).drop(text)


def segments(max_distance: int) -> list[int]:
    """Start bits of the ring's segments, and 64 as the end."""
    m = max_distance + 1
    return [64 * i // m for i in range(m)] + [64]


def _tables(max_distance: int) -> list[tuple[int, int]]:
    """(rotation, bucket mask) of every bucket table: start segment and one half of the next."""
    edge, m = segments(max_distance), max_distance + 1
    out = []
    for i in range(m):
        own = edge[i + 1] - edge[i]
        nxt = edge[(i + 1) % m + 1] - edge[(i + 1) % m]
        half = nxt // 2
        for lo, hi in ((0, half), (half, nxt)):
            out.append((edge[i], ((1 << own) - 1) | (((1 << hi) - (1 << lo)) << own)))
    return out


def _chain_masks(max_distance: int, start: int) -> list[int]:
    """Masks of the first 2, 3, ... segments of the ring, rotated so the start segment is lowest."""
    edge, m = segments(max_distance), max_distance + 1
    i, width, out = edge.index(start), 0, []
    for step in range(m):
        j = (i + step) % m
        width += edge[j + 1] - edge[j]
        out.append((1 << width) - 1)
    return out[1:]


def _links_in_buckets(max_distance: int):
    tables = _tables(max_distance)
    chains = [[np.uint64(x) for x in _chain_masks(max_distance, r)] for r, _ in tables]

    def run(batches):
        for cols in whole_groups(batches, ["t", "k", "a", "b"]):
            fp = cols["fp"].astype(np.int64).view(np.uint64)
            table, block, cross = cols["t"], cols["blk"], cols["a"] != cols["b"]
            forest = Forest(len(fp))
            for i, j in pairs_in_groups(cols["_group"]):
                live = ~cross[i] | (block[i] != block[j])
                i, j = i[live], j[live]
                for t in np.unique(table[i]):
                    own = table[i] == t
                    p, q = i[own], j[own]
                    r = np.uint64(tables[t][0])
                    x = fp[p] ^ fp[q]
                    x = (x >> r) | (x << np.uint64(64 - int(r))) if r else x
                    for budget, mask in enumerate(chains[t], start=1):
                        ok = np.bitwise_count(x & mask) <= budget
                        p, q, x = p[ok], q[ok], x[ok]
                    forest.add(p, q)
            i, root = forest.stars()
            if len(i):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fp[i].view(np.int64)), pa.array(fp[root].view(np.int64))], ["u", "v"])

    return run


def fingerprint_links(distinct: DataFrame, max_distance: int) -> DataFrame:
    """Spanning edges (u, v) of the link graph over the distinct fingerprints in column ``fp``."""
    tables = _tables(max_distance)
    arms = []
    for t, (r, mask) in enumerate(tables):
        fp = F.col("fp")
        turned = F.shiftrightunsigned(fp, r).bitwiseOR(F.shiftleft(fp, 64 - r)) if r else fp
        signed = mask - (1 << 64) if mask >> 63 else mask
        arms.append(F.struct(F.lit(t).alias("t"), turned.bitwiseAND(F.lit(signed).cast("long")).alias("k")))
    rows = distinct.select("fp", F.explode(F.array(*arms)).alias("e")).select("fp", "e.t", "e.k")
    size = rows.groupBy("t", "k").count().where("count > 1")
    size = size.select("t", "k", F.ceil(F.col("count") / F.lit(BLOCK)).cast("int").alias("g"))
    rows = rows.join(size, ["t", "k"]).withColumn("blk", F.pmod(F.xxhash64("fp"), F.col("g")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    rows = rows.select("t", "k", F.least("blk", "o").alias("a"), F.greatest("blk", "o").alias("b"), "blk", "fp")
    rows = rows.repartition("t", "k", "a", "b").sortWithinPartitions("t", "k", "a", "b")
    return rows.mapInArrow(_links_in_buckets(max_distance), "u long, v long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle: int = 3, max_distance: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    own = keep(with_fingerprint(docs, id_col, text_col, shingle))
    group = keep(own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    if max_distance > 0:
        linked = connected_components(fingerprint_links(group.select("fp"), max_distance))
        linked = linked.select(F.col("node").alias("fp"), "component")
        near = keep(group.join(linked, "fp"))
        least = near.groupBy("component").agg(F.min("least").alias("component_id"))
        named = left_join_salted(near.select("fp", "component"), least, "component", F.col("fp"))
        alone = group.where("n > 1").join(linked, "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
        named = named.select("fp", "component_id").unionByName(alone)
    else:
        named = group.where("n > 1").select("fp", F.col("least").alias("component_id"))
    named = named.withColumn("found", F.lit(True))
    out = left_join_salted(own, named, "fp", F.col("doc_id"))
    return out.select("doc_id", "fp", F.when(F.col("found"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def fingerprint_hex(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      shingle: int = 3, max_distance: int = 3) -> DataFrame:
    """``docs`` with one row of each component, in its own columns.

    A component is known by its smallest fingerprint, since ids may be null or repeat.  The row of
    the smallest id stays (null last); ties go to the smallest fingerprint, then text hash, and of
    rows equal in all three any one stays.
    """
    names = docs.columns
    key = [F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_hash")]
    own = keep(_marked(docs.select(*key, F.col(text_col).alias("_text")), "_text", shingle))
    rank = F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), "fp", F.col("_hash").alias("hash"))
    group = keep(own.groupBy("fp").agg(F.min(rank).alias("best")))
    component = F.col("fp")
    if max_distance > 0:
        linked = connected_components(fingerprint_links(group.select("fp"), max_distance))
        group = group.join(linked.withColumnRenamed("node", "fp"), "fp", "left")
        component = F.coalesce("component", "fp")
    best = group.groupBy(component.alias("component")).agg(F.min("best").alias("best"))
    # a null id joins as a number beside a flag
    stay = best.select(F.col("best.no_id").alias("_no_id"), F.coalesce("best.id", F.lit(0)).alias("_id"),
                       F.col("best.fp").alias("fp"), F.col("best.hash").alias("_hash"))
    rows = _marked(docs.select(F.struct(*names).alias("_doc"), *key, F.col(text_col).alias("_text")), "_text", shingle)
    rows = rows.select("_doc", F.col("_id").isNull().alias("_no_id"), F.coalesce("_id", F.lit(0)).alias("_id"), "fp", "_hash")
    # repeated rows collapse before the shuffle
    at = ["_no_id", "_id", "fp", "_hash"]
    rows = rows.dropDuplicates(at).join(stay, at, "left_semi")
    return rows.select(*[F.col("_doc")[c].alias(c) for c in names])
