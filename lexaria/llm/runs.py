"""Periodic run detection over words (operator 11).

A run is a stretch of consecutive words with smallest period q that no neighbouring word
extends; runs of at least ``min_length`` words and ``min_exponent`` periods are reported.

Method: the suffixes of a document are ranked by prefix doubling.  Suffix-array neighbours are
united by falling length of their common prefix (Kruskal), the smaller class into the larger
one; a class keeps its positions in order.  When positions i < j of the two classes become
neighbours, their common prefix is exactly the length l of this step.  If j - i <= l, the words
from i on repeat with period j - i up to j + l, and the period is smallest: a smaller one would
have put a position between them at a longer prefix.  The run begins at i unless the words before
i and j are equal (then a pair further left tells of it).  Every run with two periods is found so;
since a run of length L and period q has l = L - q, prefixes too short for any reported
run are not united.

Cases: null text has no words; a null id is kept as it is; very long texts are one document's
arrays in one task (some 200 bytes a word); equal rows get equal results; an empty
table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexaria.llm.common import WORD, text_slices

MIN_LENGTH = 6
MIN_EXPONENT = 4
_BLOCK = 1024


class Positions:
    """Integers in order, in blocks, so that a class of any size takes a new one quickly."""

    __slots__ = ("blocks", "heads", "size")

    def __init__(self, first: int):
        self.blocks, self.heads, self.size = [[first]], [first], 1

    def __iter__(self):
        for block in self.blocks:
            yield from block

    def add(self, x: int) -> tuple[int | None, int | None]:
        """Put x in; returns its neighbours."""
        at = max(bisect_right(self.heads, x) - 1, 0)
        block = self.blocks[at]
        k = bisect_left(block, x)
        before = block[k - 1] if k else (self.blocks[at - 1][-1] if at else None)
        after = block[k] if k < len(block) else (self.blocks[at + 1][0] if at + 1 < len(self.blocks) else None)
        block.insert(k, x)
        self.size += 1
        if k == 0:
            self.heads[at] = x
        if len(block) > 2 * _BLOCK:
            self.blocks.insert(at + 1, block[_BLOCK:])
            self.heads.insert(at + 1, block[_BLOCK])
            del block[_BLOCK:]
        return before, after


def kruskal_runs(pairs, ids, base: int, min_length: int, min_exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of a document's runs from neighbour pairs (i, j, l) by falling l.

    Positions count within ``ids``; the document begins at ``base``.
    """
    parent: dict[int, int] = {}
    classes: dict[int, Positions] = {}
    runs = []

    def find(i: int) -> int:
        if i not in parent:
            parent[i] = i
            classes[i] = Positions(i)
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def seed(i: int, j: int, l: int) -> None:
        q = j - i
        if q + l >= min_length and q + l >= min_exponent * q and (i == base or ids[i - 1] != ids[j - 1]):
            runs.append((i - base, q + l, q))

    for i, j, l in pairs:
        a, b = find(i), find(j)
        if classes[a].size < classes[b].size:
            a, b = b, a
        big, small = classes[a], classes.pop(b)
        parent[b] = a
        last = after = None  # the small class goes in by rising position; ``after`` waits for the next one
        for x in small:
            if after is not None and after < x:
                seed(last, after, l)
            before, after = big.add(x)
            if before is not None and before != last:
                seed(before, x, l)
            last = x
        if after is not None:
            seed(last, after, l)
    runs.sort(key=lambda r: (r[0], r[2]))
    return runs


def _shortest_prefix(min_length: int, min_exponent: int) -> int:
    return min(max(min_length - q, (min_exponent - 1) * q, q) for q in range(1, min_length + 1))


def neighbours(ids: np.ndarray, doc: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix-array neighbours (i, j, l) of equal document with common prefix l >= least.

    ``ids`` are the words of all documents one after the other, ``doc`` the document of each
    word, ``end`` its document's end.  Ranks double their depth in every round; only suffixes
    whose prefix is not yet unique in the document take part.
    """
    n = len(ids)
    key = doc * (int(ids.max()) + 1) + ids
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = np.r_[True, key[1:] != key[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    live = order[~(head & np.r_[head[1:], True])]
    depth, levels, near = 1, [], live
    while len(live):
        levels.append((depth, rank.astype(np.int32)))
        behind = live + depth
        second = np.where(behind < end[live], rank[np.minimum(behind, n - 1)], -1)
        by = np.lexsort((second, rank[live]))
        live, second = live[by], second[by]
        first = rank[live]
        group = np.r_[True, first[1:] != first[:-1]]
        head = group | np.r_[True, second[1:] != second[:-1]]
        at = np.arange(len(live))
        rank[live] = first + np.maximum.accumulate(np.where(head, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        live = live[~(head & np.r_[head[1:], True])]
        depth *= 2
        if depth <= least:
            near = live
    if not len(near):
        return near, near, near
    # all ranks are unique now; the suffixes that share a prefix of nearly ``least`` words, in order
    near = near[np.argsort(rank[near])]
    i, j = near[:-1], near[1:]
    beside = rank[j] == rank[i] + 1
    i, j = i[beside], j[beside]
    l = np.zeros(len(i), np.int64)
    stop = np.minimum(end[i], end[j])
    for depth, level in reversed(levels):
        a, b = i + l, j + l
        inside = np.maximum(a, b) + depth <= stop
        l += depth * (inside & (level[np.minimum(a, n - 1)] == level[np.minimum(b, n - 1)]))
    far = (l >= least) & (doc[i] == doc[j])
    return i[far], j[far], l[far]


class _Numbers(dict):
    def __missing__(self, word):
        self[word] = len(self)
        return self[word]


def _detect(min_length: int, min_exponent: int):
    least = _shortest_prefix(min_length, min_exponent)

    def run(batches):
        for part in text_slices(batches, "text"):
            words = [(t or "").encode().split() for t in part.column("text").to_pylist()]  # bytes: splits at 9..13 and 32
            size = np.array([len(w) for w in words], np.int64)
            stop = np.cumsum(size)
            number = _Numbers()
            ids = np.fromiter((number[w] for ws in words for w in ws), np.int64, int(stop[-1]))
            found: dict[int, list] = {}
            if len(ids):
                doc = np.repeat(np.arange(len(words)), size)
                i, j, l = neighbours(ids, doc, np.repeat(stop, size), least)
                own = doc[i]
                by = np.lexsort((i, -l, own))
                cut = np.flatnonzero(np.r_[True, np.diff(own[by]) > 0]) if len(by) else []
                for o in np.split(by, cut[1:]) if len(by) else []:
                    d = int(own[o[0]])
                    base = int(stop[d] - size[d])
                    pairs = zip((i[o] - base).tolist(), (j[o] - base).tolist(), l[o].tolist())
                    got = kruskal_runs(pairs, ids[base:stop[d]].tolist(), 0, min_length, min_exponent)
                    if got:
                        found[d] = got
            runs, texts = [], []
            for d, ws in enumerate(words):
                got = found.get(d, [])
                if got:
                    gone = np.zeros(len(ws) + 1, np.int64)
                    for s, n, q in got:
                        gone[s + q] += 1
                        gone[s + n] -= 1
                    ws = [w for w, g in zip(ws, np.cumsum(gone).tolist()) if not g]
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in got])
                texts.append(b" ".join(ws).decode())
            kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size), pa.array(runs, kind), pa.array(texts, pa.string())],
                                             ["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), collapsed, per row of ``docs``.

    ``collapsed`` holds the words that no run contains after its first period, joined by a space.
    ``min_exponent`` is at least 2.
    """
    if min_exponent < 2:
        raise ValueError("runs have at least two periods")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(_detect(min_length, min_exponent),
                          "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the contract: documents with crc32(id) % 10 = 0 end in a repeated stretch of their own words."""
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    g = F.floor(h / 10)

    def repeat(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        many = F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int"))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, 1, a), F.slice(F.flatten(many), 1, n - a)), " ")).otherwise("")

    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    new = F.transform(F.array(words), repeat)[0]  # binds the words once
    return docs.select("doc_id", F.when(h % 10 == 0, new).otherwise(F.col("text")).alias("text"))
