"""Suffix-array dedup of passages (operator 13).

A byte is removed if it is covered by a string of ``width`` bytes that also starts in a
document with a smaller id; strings are judged on the input.

The suffixes that are sorted are those at *anchors*: of the ``GRAM``-byte strings inside a
window of ``width`` bytes the one with the smallest hash (the leftmost, if equal) is the
window's anchor, so equal windows have equal anchors at equal places.  Consecutive
windows with one anchor travel together, as the bytes that they cover, with the suffix that
starts at the anchor.  Suffixes are range-partitioned by their leading ``GRAM`` bytes; the
splitters are quantiles of a sample (``PER_BUCKET`` leads a bucket, chosen by hash).  A bucket
sorts its suffixes by multikey quicksort, goes on with the windows of those leads that
are found in more than one document, and finds each window's smallest document.

A lead that equals a splitter may fill many buckets and is dealt over all of them.  Of each
of its windows a bucket decides all but the smallest document of its own; those are compared
across the boundaries: the smallest document of the window over all buckets is found by an
aggregate and joined to them.

Cases: null text has no bytes and nothing to remove; texts shorter than ``width`` stay whole;
a null id is larger than every id, and documents of equal or null id do not remove from
one another; repeated rows get equal results; texts of any length are read in chunks of
``CHUNK`` bytes; an empty table gives an empty result; other columns are not read.  Text
with a period shorter than an anchor has an anchor a period, so it travels several times.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaria.llm.common import left_join_salted, store, text_slices

WIDTH = 50
GRAM = 16
CHUNK = 1 << 21
BUCKET_BYTES = 32 << 20
PER_BUCKET = 64
LOT = 1 << 18
_TOP = (1 << 63) - 1
_BASE = 0x9E3779B97F4A7C15


def window_anchors(buf: np.ndarray, width: int) -> np.ndarray:
    """For every window of ``buf`` (at most CHUNK of them) the place of its anchor."""
    n, grams = len(buf), width - GRAM + 1
    with np.errstate(over="ignore"):
        h, size, power = buf.astype(np.uint64) + np.uint64(1), 1, _BASE
        while size < GRAM:  # GRAM is a power of two
            h = h[:-size] * np.uint64(power) + h[size:]
            size, power = 2 * size, power * power % (1 << 64)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    mask = np.uint64((CHUNK << 1) - 1)
    low = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while 2 * size <= grams:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    m = n - width + 1
    return (np.minimum(low[:m], low[grams - size:grams - size + m]) & mask).astype(np.int64)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, starts) of an Arrow string column without nulls; starts has one entry more."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[at[0]:at[-1]], at - at[0]


def _windows(batches, width: int, chunk: int):
    """Chunks as (buf, doc table, groups): a group is a run of windows with one anchor.

    Groups come as (first window, windows, anchor, row of the doc table, place in the document).
    """
    for part in text_slices(batches, "text", chunk):
        text = part.column("text").fill_null("")
        data, at = _bytes_of(text)
        size = np.diff(at)
        row = np.repeat(np.arange(len(size), dtype=np.int32), size)
        ids = np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in ("d", "x")], 1)
        for a in range(0, len(data) - width + 1, chunk):
            buf = data[a:a + chunk + width - 1]
            anchor = window_anchors(buf, width)
            own = row[a:a + len(anchor)]
            ok = np.arange(a, a + len(anchor)) + width <= at[own + 1]
            new = ok.copy()
            new[1:] &= (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1]) | ~ok[:-1]
            start = np.flatnonzero(new)
            if len(start):
                stop = np.flatnonzero(ok & ~np.r_[ok[1:] & ~new[1:], False]) + 1
                yield buf, ids, (start, stop - start, anchor[start], own[start], start + a - at[own[start]])


def leads_at(buf: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(buf[anchor[:, None] + np.arange(GRAM)]).view(f"S{GRAM}").ravel()


def _gather(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return buf[np.repeat(start - (ends - size), size) + np.arange(ends[-1])]


_FIELDS = (("count", np.uint8), ("place", np.uint8), ("row", np.uint32), ("pos", np.uint32))


def _pack(ids, buf, start, count, place, row, pos, width) -> bytes:
    used, row = np.unique(row, return_inverse=True)
    parts = [np.array([len(start), len(used)], np.int64), ids[used]]
    parts += [x.astype(kind) for x, (_, kind) in zip((count, place, row, pos), _FIELDS)]
    parts.append(_gather(buf, start, count + width - 1))
    raw = b"".join(p.tobytes() for p in parts)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    raw = pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"))
    n, docs = np.frombuffer(raw, np.int64, 2)
    at = 16
    ids = np.frombuffer(raw, np.int64, 2 * docs, at).reshape(-1, 2)
    at += ids.nbytes
    out = {}
    for name, kind in _FIELDS:
        out[name] = np.frombuffer(raw, kind, n, at)
        at += out[name].nbytes
    row = out.pop("row")
    return out | {"d": ids[row, 0], "x": ids[row, 1], "bytes": np.frombuffer(raw, np.uint8, -1, at)}


def _unpack_all(blobs: list[bytes]) -> dict[str, np.ndarray]:
    """The entries of all blobs; eight zeros follow the bytes.  ``blobs`` is emptied."""
    kept, parts = [], {}
    while blobs:
        got = _unpack(blobs.pop())
        kept.append(got.pop("bytes"))
        for name, col in got.items():
            parts.setdefault(name, []).append(col.copy())
    out = {name: np.concatenate(cols) for name, cols in parts.items()}
    flat = np.zeros(sum(map(len, kept)) + 8, np.uint8)
    end = len(flat) - 8
    while kept:  # from the last one on, so that each part is freed as it is copied
        part = kept.pop()
        flat[end - len(part):end] = part
        end -= len(part)
    return out | {"bytes": flat}


def _blobs(splitters: np.ndarray, width: int, chunk: int):
    def run(batches):
        for buf, ids, (start, count, anchor, row, pos) in _windows(batches, width, chunk):
            lead = leads_at(buf, anchor)
            low = np.searchsorted(splitters, lead, "left")
            room = np.searchsorted(splitters, lead, "right") - low
            wide = np.flatnonzero(room)  # the lead is a splitter: dealt over its buckets
            with np.errstate(over="ignore"):
                salt = (ids[row[wide], 0] * 31 + pos[wide] + ids[row[wide], 1]).astype(np.uint64) * np.uint64(_BASE) >> np.uint64(33)
            low[wide] += (salt % (room[wide] + 1).astype(np.uint64)).astype(np.int64)
            order = np.argsort(low, kind="stable")
            cut = np.flatnonzero(np.r_[True, np.diff(low[order]) > 0])
            blobs = [_pack(ids, buf, start[o], count[o], (anchor - start)[o], row[o], pos[o], width) for o in np.split(order, cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(low[order[cut]], pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    return run


def multikey_quicksort(head: np.ndarray, depths: int, char) -> tuple[np.ndarray, np.ndarray]:
    """Sort the strings of every segment at once; a segment begins where ``head`` is set.

    ``char(i, depth)`` gives the characters of strings i at their depths.  Every round splits each
    open segment in three by the character of its middle string; the middle part goes on to
    the next depth.  Returns the order and the starts of the groups of equal strings.
    """
    order, head = np.arange(len(head)), head.copy()
    open_ = np.flatnonzero(~(head & np.r_[head[1:], True]))
    depth = np.zeros(len(open_), np.int8)
    while len(open_):
        el, first = order[open_], head[open_]
        start = np.flatnonzero(first)
        seg = np.cumsum(first) - 1
        size = np.diff(np.r_[start, len(open_)])
        w = char(el, depth)
        pivot = w[start + size // 2][seg]
        less, same = w < pivot, w == pivot
        c0, c1 = np.cumsum(less), np.cumsum(same)
        b0, b1 = c0[start] - less[start], c1[start] - same[start]
        n0, n1 = np.add.reduceat(less, start, dtype=np.int64), np.add.reduceat(same, start, dtype=np.int64)
        r0, r1 = c0 - b0[seg], c1 - b1[seg]  # members so far of the two lower parts, this one included
        here = np.arange(len(open_)) - start[seg]
        rank = np.where(less, r0 - 1, np.where(same, n0[seg] + r1 - 1, (n0 + n1)[seg] + here - r0 - r1))
        to = start[seg] + rank
        order[open_[to]] = el
        moved = np.empty_like(depth)
        moved[to] = depth + same
        first[start + n0] = True
        upper = n0 + n1 < size
        first[(start + n0 + n1)[upper]] = True
        head[open_] = first
        go = ~(first & np.r_[first[1:], True]) & (moved < depths)
        open_, depth = open_[go], moved[go]
    return order, head


def _words(padded: np.ndarray) -> np.ndarray:
    """Eight bytes from every place on as one number, the first byte highest."""
    return np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,))


def _group_min(value: np.ndarray, head: np.ndarray) -> np.ndarray:
    return np.minimum.reduceat(value, np.flatnonzero(head))[np.cumsum(head) - 1]


def _decide(got: dict, splitters: np.ndarray, width: int):
    """Spans to remove of one bucket and the windows that the bucket alone can't decide."""
    count, place, d = got["count"].astype(np.int64), got["place"].astype(np.int64), got["d"]
    size = count + width - 1
    base = np.cumsum(size) - size
    words = _words(got["bytes"])
    lead = base + place
    # the first two bytes by a radix sort, the rest by multikey quicksort
    top = (words[lead] >> np.uint64(48)).astype(np.uint16)
    by_top = np.argsort(top, kind="stable")
    lead_t, top = lead[by_top], top[by_top]
    order, head = multikey_quicksort(np.r_[True, top[1:] != top[:-1]], GRAM // 8,
                                     lambda i, depth: words[lead_t[i] + 8 * depth.astype(np.int64)].astype(np.uint64))
    order = by_top[order]
    first = order[np.flatnonzero(head)]
    wide = np.isin(leads_at(got["bytes"], lead[first]), splitters)[np.cumsum(head) - 1]
    many = _group_min(d[order], head) < -_group_min(-d[order], head)
    taken = many | wide
    order, head, wide = order[taken], head[taken], wide[taken]
    if not len(order):
        return
    # whole groups of leads, LOT windows or a single group at a time
    begin = np.flatnonzero(head)
    total = np.cumsum(np.add.reduceat(count[order], begin))
    cuts = begin[np.r_[True, np.diff(total // LOT) > 0]]
    for a, b in zip(cuts, np.r_[cuts[1:], len(order)]):
        yield _decide_lot(got, words, base, order[a:b], np.cumsum(head[a:b]), wide[a:b], width)


def _decide_lot(got, words, base, entry, group, wide, width):
    count = got["count"].astype(np.int64)[entry]
    ends = np.cumsum(count)
    own = np.repeat(np.arange(len(entry)), count)  # windows, in the order of their entries
    j = np.arange(ends[-1]) - (ends - count)[own]
    start = base[entry][own] + j
    d = got["d"][entry][own]
    key = group[own] * 256 + got["place"].astype(np.int64)[entry][own] - j  # equal windows have their anchor at one place
    by_key = np.argsort(key, kind="stable")
    key, start_k = key[by_key], start[by_key]
    steps = np.array([*range(0, width - 8, 8), width - 8])
    order, head = multikey_quicksort(np.r_[True, key[1:] != key[:-1]], len(steps),
                                     lambda i, depth: words[start_k[i] + steps[depth]].astype(np.uint64))
    order = by_key[order]
    least = np.empty_like(d)
    least[order] = _group_min(d[order], head)
    gone = d > least
    x, pos = got["x"][entry][own], got["pos"].astype(np.int64)[entry][own] + j
    begins = gone & np.r_[True, ~gone[:-1] | (own[1:] != own[:-1])]
    stops = gone & np.r_[~gone[1:] | (own[1:] != own[:-1]), True]
    begins, stops = np.flatnonzero(begins), np.flatnonzero(stops)
    left = np.flatnonzero(wide[own] & ~gone)  # the bucket's smallest document; others may hold a smaller one
    text = np.ascontiguousarray(got["bytes"][start[left][:, None] + np.arange(width)])
    at = np.r_[begins, left]
    win = pa.array([None] * len(begins) + [r.tobytes() for r in text], pa.binary())
    stop = np.r_[pos[stops], pos[left]] + width
    return pa.RecordBatch.from_arrays([pa.array(d[at]), pa.array(x[at]), pa.array(pos[at]), pa.array(stop), win], ["d", "x", "a", "b", "win"])


def _bucket(splitters: np.ndarray, width: int):
    def decide(blobs):
        return _decide(_unpack_all(blobs), splitters, width)

    def run(batches):
        number, blobs = None, []
        for batch in batches:
            for b, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist()):
                if b != number and blobs:
                    yield from decide(blobs)
                    blobs = []
                number = b
                blobs.append(blob)
        if blobs:
            yield from decide(blobs)

    return run


def _splitters(src: DataFrame, buckets: int, total: int, width: int, chunk: int) -> np.ndarray:
    """Quantiles of about PER_BUCKET leads a bucket, from documents and anchors chosen by hash."""
    thin = 8
    share = min(1.0, buckets * PER_BUCKET * thin * 20 / max(total, 1))  # an anchor has about 17 bytes
    spot = F.pmod(F.xxhash64("d", "x", F.lit(7)), F.lit(1 << 30))

    def run(batches):
        for buf, ids, (_, _, anchor, row, pos) in _windows(batches, width, chunk):
            with np.errstate(over="ignore"):
                h = (ids[row, 0] * 1000003 + ids[row, 1] + pos).astype(np.uint64) * np.uint64(_BASE) >> np.uint64(40)
            pick = np.flatnonzero(h % np.uint64(thin) == 0) if share < 1 else np.arange(len(row))
            lead = leads_at(buf, anchor[pick])
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes().ljust(GRAM, b"\0") for r in lead], pa.binary())], ["lead"])

    got = src.where(spot < int(share * (1 << 30))).mapInArrow(run, "lead binary").toArrow().column("lead")
    lead = np.sort(np.array(got.to_pylist(), f"S{GRAM}"))
    return lead[np.arange(1, buckets) * len(lead) // buckets] if len(lead) else lead


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, chunk: int = CHUNK) -> DataFrame:
    """(d, x, a, b): bytes a to b of the document known by id and text hash are a repeat."""
    spark = docs.sparkSession
    src = _source(docs, id_col, text_col)
    total = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(4 * total / BUCKET_BYTES))
    splitters = _splitters(src, buckets, total, width, chunk)
    blobs = src.mapInArrow(_blobs(splitters, width, chunk), "bucket int, blob binary")
    blobs = blobs.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket")
    found = store(blobs.mapInArrow(_bucket(splitters, width), "d long, x long, a long, b long, win binary"), "repeats")
    # compare across the boundaries: leads that are splitters
    open_ = found.where("win is not null")
    least = open_.groupBy("win").agg(F.min("d").alias("least"), F.max("d").alias("most")).where("least < most").select("win", "least")
    late = left_join_salted(open_, least, "win", F.col("a")).where("d > least")
    return found.where("win is null").select("d", "x", "a", "b").unionByName(late.select("d", "x", "a", "b"))


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_TOP)).alias("d"), F.xxhash64(text_col).alias("x"),
                       F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def _merge(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut(batches):
    for part in text_slices(batches, "text"):
        n, spans, kept = [], [], []
        for text, cut in zip(part.column("text").to_pylist(), part.column("cut").to_pylist()):
            raw = (text or "").encode()
            gone = _merge((c["a"], c["b"]) for c in cut) if cut else []
            edge = [0, *(e for s in gone for e in s), len(raw)]
            n.append(len(raw))
            spans.append([{"start": a, "stop": b} for a, b in gone])
            kept.append(b"".join(raw[a:b] for a, b in zip(edge[::2], edge[1::2])) if gone else raw)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())],
                                         ["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, spans (start, stop: maximal removed runs of bytes), kept (the other bytes), per row of ``docs``."""
    cuts = repeated_spans(docs, id_col, text_col, width, chunk)
    cuts = cuts.groupBy("d", "x").agg(F.collect_set(F.struct("a", "b")).alias("cut"))
    wide = _source(docs, id_col, text_col).join(cuts, ["d", "x"], "left").select("doc_id", "text", "cut")
    return wide.mapInArrow(_cut, "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")
