"""Fuzzy line dedup by MinHash (operator 10).

A line is compared in normal form: lower case, runs of white space as one space.  Equal
normal forms are one *line*, known by its XXH3 hash.  Different lines link if the
Jaccard similarity of their sets of ``SHINGLE``-character shingles is at least
``THRESHOLD``; of every connected component one line occurrence stays, the first by
(doc_id, line number).

Signatures: ``PASSES`` independent one-permutation MinHashes of ``BINS`` bins, empty
bins filled from a hash-chosen filled one; a band joins ``ROWS`` of the values.  At similarity
0.8 a pair meets in one of the ``BANDS`` bands with probability 1 - (1 - 0.8^6)^20 = 0.998.
Buckets with the same lines are checked once.  Inside a bucket every pair is verified
exactly: the lines' shingle incidence matrix times its transpose gives all intersections.
In a bucket above ``BLOCK`` lines all of them meet ``PIVOTS`` lines first; those near one are
of its class.  Lines near none meet every line, in pairs of blocks; lines of a class meet the lines of
other classes that the triangle inequality of the Jaccard distance leaves as possible links.  Tasks
emit spanning forests of the links, never the pairs.

Texts are moved only for lines that share a bucket, and once each: the first occurrences
of the lines wanted are put into a Bloom filter of fixed size (``FILTER_BITS``), the corpus is
read once more, and lines that pass are joined exactly.

Cases: null text has no lines; blank lines are never duplicates and always stay; a line
shorter than a shingle is one shingle of its whole; rows of equal doc_id are one
document, so a line repeated by a repeated row at the same line number stays or goes with
it; a line of any length is laid out a chunk at a time; rows with a null doc_id are documents of their own and sort last (which of them keeps
an equal line at an equal line number is open); an empty table gives an empty result; other
columns pass through.  A document that loses all its lines is dropped, one without lines stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexaria.llm.common import Forest, keep, left_join_salted, pairs_in_groups, store, text_slices, whole_groups
from lexaria.llm.components import connected_components

SHINGLE = 5
THRESHOLD = 0.8
PASSES, BINS, BANDS, ROWS = 3, 40, 20, 6  # PASSES * BINS = BANDS * ROWS
BLOCK = 512
FILTER_BITS = 1 << 25
CHUNK = 32768
SIGNED = 4096
LOT = 1 << 18
FEW = 8
PIVOTS = 32
# d(x, p) + d(x, y) of near pairs (x, p) and (x, y) bounds d(y, p); the margin is for rounding
AROUND = 1 - 2 * (1 - THRESHOLD) - 1e-9
CELLS = 1 << 23
MINE, AROUND_IT, SAME = np.int32(0), np.int32(1), np.int32(2)
EMPTY = np.uint32(0xFFFFFFFF)
_MULT = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def normal(line: str) -> str:
    return " ".join(line.lower().split())


def normals(text: str) -> list[str]:
    """The normal forms of a text's lines."""
    return [" ".join(line.split()) for line in text.lower().split("\n")]


def line_ids(lines: list[str]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(x.encode("utf-8", "surrogatepass")) for x in lines), np.uint64, len(lines)).view(np.int64)


def line_id(line: str) -> int:
    return int(line_ids([line])[0])


def _picks(bins: int) -> np.ndarray:
    """(bins, attempts): the bin that an empty bin looks at in every attempt, chosen by hash of (bin, attempt) alone."""
    c, attempt = np.arange(bins), np.arange(1, 201)[:, None]
    return np.ascontiguousarray((((c * 2654435761 + attempt * 40503 + ((c + 7) * attempt) * 97) >> 3) % bins).T)


_PICKS = _picks(BINS)


def _fill_empty(sig: np.ndarray) -> np.ndarray:
    """Give every empty bin of ``sig`` (changed in place) the value of the first filled one it looks at."""
    bins = sig.shape[1]
    flat = sig.reshape(-1)
    filled = flat != EMPTY
    n = bins - np.count_nonzero(filled.reshape(-1, bins), axis=1)
    n[n == bins] = 0  # a line without any filled bin stays as it is
    row = np.repeat(np.arange(len(sig)) * bins, n)
    at = np.flatnonzero(~filled & np.repeat(n > 0, bins))
    for a, b in ((0, 1), (1, 2), (2, 3), (3, 4), (4, 16), (16, _PICKS.shape[1])):  # filled bins never change, so the order is free
        left = np.ones(len(at), bool)
        for s in range(0, len(at), CHUNK):
            to, base = at[s:s + CHUNK], row[s:s + CHUNK]
            look = base + _PICKS[to - base, a]
            ok = filled[look]
            if b - a > 1:
                every = base[:, None] + _PICKS[to - base, a:b]
                hit = filled[every]
                first = hit.argmax(axis=1)
                here = np.arange(len(to))
                look, ok = every[here, first], hit[here, first]
            flat[to[ok]] = flat[look[ok]]
            left[s:s + CHUNK] = ~ok
        at, row = at[left], row[left]
    if len(at):  # few filled bins: take the first filled one
        flat[at] = flat[row + filled.reshape(-1, bins).argmax(axis=1)[row // bins]]
    return sig


def _windows(begin: np.ndarray, end: np.ndarray, s: int, e: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Which of the places s..e-1 lie in [begin, end) of a line, and how many do for each line from the one returned on."""
    l0, l1 = np.searchsorted(begin, [s, e - 1], side="right") - 1
    a, b = np.maximum(begin[l0:l1 + 1], s) - s, np.minimum(end[l0:l1 + 1], e) - s
    n = np.maximum(b - a, 0)
    edge = np.zeros(e - s + 1, np.int8)
    edge[a[n > 0]], edge[b[n > 0]] = 1, -1
    return np.cumsum(edge[:-1], dtype=np.int8).view(bool), n, l0


def signatures(lines: list[str]) -> np.ndarray:
    """(lines, BANDS) unsigned 64-bit band hashes."""
    sig = np.full((len(lines), PASSES, BINS), EMPTY, np.uint32)
    flat = sig.reshape(-1)
    lens = np.array([len(x) for x in lines], np.int64)
    # lines are laid out with SHINGLE - 1 zeros behind each, so a short line is one shingle
    pad = "\0" * (SHINGLE - 1)
    cp = np.frombuffer((pad.join(lines) + pad).encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.cumsum(lens + SHINGLE - 1) - (lens + SHINGLE - 1)
    end = begin + np.maximum(lens - SHINGLE + 1, 1)
    with np.errstate(over="ignore"):
        for s in range(0, int(end[-1]), CHUNK):  # only a chunk of shingles is laid out, however long a line is
            e = min(s + CHUNK, int(end[-1]))
            inside, n, l0 = _windows(begin, end, s, e)
            own = np.repeat(np.arange(l0, l0 + len(n)) * (PASSES * BINS), n)
            c = cp[s:e + SHINGLE - 1].astype(np.uint64)
            h = c[:e - s].copy()
            for k in range(1, SHINGLE):
                h *= np.uint64(0x100000001B3)
                h += c[k:k + e - s]
            h = h[inside]
            for p in range(PASSES):
                x = h * _MULT[p]
                x ^= x >> np.uint64(29)
                x *= np.uint64(0xBF58476D1CE4E5B9)
                x ^= x >> np.uint64(32)
                b = ((x >> np.uint64(40)) * np.uint64(BINS)) >> np.uint64(24)
                b += np.uint64(p * BINS)
                np.minimum.at(flat, own + b.view(np.int64), x.astype(np.uint32))
        _fill_empty(sig.reshape(-1, BINS))
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _MULT[0], (len(lines), BANDS)).copy()
        for part in sig.reshape(len(lines), ROWS, BANDS).transpose(1, 0, 2):
            key ^= part
            key *= np.uint64(0x9FB21C651E98DF25)
            key ^= key >> np.uint64(31)
    return key


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def _occurrences(batches):
    for part in text_slices(batches, "text"):
        lines, no, n = [], [], []
        for text in part.column("text").to_pylist():
            before = len(lines)
            for k, x in enumerate(normals(text or "")):
                if x:
                    lines.append(x), no.append(k)
            n.append(len(lines) - before)
        at = pa.array(np.repeat(np.arange(part.num_rows), n))
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id").take(at), part.column("row").take(at), pa.array(no, pa.int32()), pa.array(line_ids(lines))],
            ["doc_id", "row", "line_no", "line"])


def _bands(batches):
    for part in text_slices(batches, "text"):
        lines = list({x: None for t in part.column("text").to_pylist() if t for x in normals(t) if x})
        for s in range(0, len(lines), SIGNED):
            some = lines[s:s + SIGNED]
            key = signatures(some).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(line_ids(some), BANDS))], ["k", "line"])


def _shared(batches):
    """Members (k, line) of buckets with at least two different lines, from rows sorted by k; some are told again."""
    key = first = None  # the open bucket is known by its first line only
    told = False
    for batch in batches:
        k, x = batch.column("k").to_numpy(), batch.column("line").to_numpy()
        if not len(k):
            continue
        new = np.r_[k[0] != key, k[1:] != k[:-1]]
        head = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
        p = np.where(head < 0, first if first is not None else 0, x[np.maximum(head, 0)])
        other = x != p
        out_k, out_x, out_p = k[other], x[other], p[other]
        # a bucket's first line is told once, with its first other line
        one = np.r_[True, out_k[1:] != out_k[:-1]] if len(out_k) else np.zeros(0, bool)
        if len(out_k) and told and out_k[0] == key:
            one[0] = False
        told = bool(len(out_k) and out_k[-1] == k[-1]) or (told and k[-1] == key)
        key, first = k[-1], p[-1]
        got_k, got_x = np.r_[out_k, out_k[one]], np.r_[out_x, out_p[one]]
        order = np.lexsort((got_x, got_k))
        got_k, got_x = got_k[order], got_x[order]
        fresh = np.r_[True, (got_k[1:] != got_k[:-1]) | (got_x[1:] != got_x[:-1])][:len(got_k)]
        yield pa.RecordBatch.from_arrays([pa.array(got_k[fresh]), pa.array(got_x[fresh])], ["k", "line"])


def _filter_positions(ids: np.ndarray) -> np.ndarray:
    u = ids.astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        return np.stack([((u * m) >> np.uint64(20)) & np.uint64(FILTER_BITS - 1) for m in _MULT]).astype(np.int64)


def _bloom(ids: DataFrame, column: str) -> bytes:
    """Bloom filter of fixed size over a column; tasks send set words, at most FILTER_BITS / 64 each."""
    def run(batches):
        words = np.zeros(FILTER_BITS >> 6, np.uint64)
        for b in batches:
            pos = _filter_positions(b.column(0).to_numpy()).ravel()
            np.bitwise_or.at(words, pos >> 6, np.uint64(1) << (pos & 63).astype(np.uint64))
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at].view(np.int64))], ["at", "w"])

    got = ids.select(column).mapInArrow(run, "at long, w long").groupBy("at").agg(F.expr("bit_or(w)").alias("w")).toArrow()
    words = np.zeros(FILTER_BITS >> 6, np.int64)
    words[got.column("at").to_numpy()] = got.column("w").to_numpy()
    return words.tobytes()


def _place_hash(line: np.ndarray, doc: np.ndarray, no: np.ndarray) -> np.ndarray:
    """One number for an occurrence; only the filter uses it."""
    with np.errstate(over="ignore"):
        h = line.astype(np.int64).view(np.uint64) ^ (doc.astype(np.int64).view(np.uint64) * _MULT[1])
        return ((h ^ (h >> np.uint64(31))) * _MULT[2] + no.astype(np.int64).view(np.uint64) * _MULT[0]).view(np.int64)


def _places(batches):
    for b in batches:
        doc, line = b.column("doc"), b.column("line").to_numpy()
        here = np.where(doc.is_null().to_numpy(zero_copy_only=False), line, 0)
        yield pa.RecordBatch.from_arrays([pa.array(_place_hash(here, doc.fill_null(-1).to_numpy(), b.column("no").to_numpy()))], ["h"])


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(line, x): the normal form of every wanted line, read at its first occurrence (line, doc, no).

    The filter holds places (doc, no), so only lines at a wanted place are put in normal form; rows without
    id share their places, so there the filter holds the line too.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_bloom(wanted.mapInArrow(_places, "h long"), "h"))

    def passing(line, doc, no):
        words = np.frombuffer(sent.value, np.uint64)
        pos = _filter_positions(_place_hash(line, doc, no))
        return np.flatnonzero(((words[pos >> 6] >> (pos & 63).astype(np.uint64)) & np.uint64(1)).all(axis=0))

    def run(batches):
        for part in text_slices(batches, "text"):
            raw = [(t or "").split("\n") for t in part.column("text").to_pylist()]
            n = np.array([len(r) for r in raw])
            at = np.repeat(np.arange(len(raw)), n)
            no = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            none = part.column("doc_id").is_null().to_numpy(zero_copy_only=False)[at]
            doc = part.column("doc_id").fill_null(-1).to_numpy()[at]
            hit = np.flatnonzero(~none)
            hit = hit[passing(np.zeros(len(hit), np.int64), doc[hit], no[hit])]
            hit = np.sort(np.r_[hit, np.flatnonzero(none)])
            lines = [normal(raw[i][k]) for i, k in zip(at[hit].tolist(), no[hit].tolist())]
            ids, none = line_ids(lines), none[hit]
            ok = ~none & np.array([x != "" for x in lines], bool)
            lone = np.flatnonzero(none)
            ok[lone[passing(ids[lone], doc[hit][lone], no[hit][lone])]] = True
            ok = np.flatnonzero(ok)
            yield pa.RecordBatch.from_arrays([pa.array(ids[ok]), pa.array([lines[i] for i in ok], pa.string())], ["line", "x"])

    passed = docs.mapInArrow(run, "line long, x string")
    return passed.join(wanted.select("line"), "line", "left_semi").groupBy("line").agg(F.first("x").alias("x"))


def _codes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(line, code) of all shingles by line: codes are integers that are equal just where shingles are."""
    pad = "\0" * (SHINGLE - 1)
    cp = np.frombuffer((pad.join(lines) + pad).encode("utf-32-le", "surrogatepass"), np.uint32)
    used = np.zeros(0x110000 if len(lines) else 1, bool)
    used[cp] = True
    n_chars = int(used.sum())
    char = (np.cumsum(used, dtype=np.int32) - 1)[cp]
    bits = max(1, (n_chars - 1).bit_length())
    code = char.astype(np.int64)
    for k in range(1, SHINGLE):
        if bits * (k + 1) > 62:  # too many characters to hold a shingle: renumber what is read so far
            code = np.unique(code, return_inverse=True)[1]
        code = code[:len(cp) - k] << bits | char[k:]
    size = np.array([len(x) for x in lines]) + SHINGLE - 1
    begin = np.cumsum(size) - size
    inside, n, _ = _windows(begin, begin + np.maximum(1, size - 2 * (SHINGLE - 1)), 0, len(code))
    return np.repeat(np.arange(len(lines)), n), code[inside]


def shingle_codes(lines: list[str]) -> list[np.ndarray]:
    """Sorted distinct shingles of every line, as integers that are equal just where shingles are."""
    row, code = _codes(lines)
    return [_sorted_set(c) for c in np.split(code, np.flatnonzero(np.diff(row)) + 1)]


def _line_sets(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``shingle_codes`` of all lines in one array, and where each line's begin (and the last ends)."""
    row, code = _codes(lines)
    if int(code.max()).bit_length() + len(lines).bit_length() > 62:
        code = np.unique(code, return_inverse=True)[1]
    bits = int(code.max()).bit_length()
    both = _sorted_set(row << bits | code)
    return both & ((1 << bits) - 1), np.searchsorted(both >> bits, np.arange(len(lines) + 1))


def _few_links(code: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the lines i[n] and j[n] have exact Jaccard similarity THRESHOLD or more, for all n at once."""
    size = np.diff(at)
    a, b = size[i], size[j]
    near = np.zeros(len(i), bool)
    live = np.flatnonzero(np.minimum(a, b) >= THRESHOLD * np.maximum(a, b))
    bits = int(code.max()).bit_length()
    total = np.cumsum(a[live] + b[live])
    for some in np.split(live, np.flatnonzero(np.diff(total // LOT)) + 1):
        of, n = np.r_[i[some], j[some]], np.r_[a[some], b[some]]
        place = np.arange(int(n.sum())) + np.repeat(at[of] - (np.cumsum(n) - n), n)
        both = np.sort(np.repeat(np.r_[:len(some), :len(some)], n) << bits | code[place])
        met = np.bincount(both[1:][both[1:] == both[:-1]] >> bits, minlength=len(some))
        near[some] = met / (a[some] + b[some] - met) >= THRESHOLD
    return near


def _sorted_set(code: np.ndarray) -> np.ndarray:
    code = np.sort(code)
    return code[np.r_[True, code[1:] != code[:-1]]]


def _shared_codes(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate((a, b))
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def near_pairs(codes: list[np.ndarray], first: int | None = None, least: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i < j) of exact Jaccard similarity ``least`` or more, with i among the ``first`` lines."""
    size = np.array([len(c) for c in codes])
    first = len(codes) if first is None else first
    if len(codes) <= 4:
        got = [(i, j) for i in range(first) for j in range(i + 1, len(codes))
               if min(size[i], size[j]) >= least * max(size[i], size[j])
               and (n := _shared_codes(codes[i], codes[j])) / (size[i] + size[j] - n) >= least]
        return tuple(np.array(got, np.int64).reshape(-1, 2).T)
    row = np.repeat(np.arange(len(codes)), size)
    _, col, n = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
    met = n[col] > 1  # shingles of a single line meet nothing
    row, col = row[met], (np.cumsum(n > 1) - 1)[col[met]]
    width, step = int((n > 1).sum()), max(1, CELLS // len(codes))
    if width > step:
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
    both = np.zeros((first, len(codes)))
    for a in range(0, width, step):  # long lines have many shingles: a slab of them at a time
        lo, hi = (0, len(col)) if width <= step else np.searchsorted(col, [a, a + step])
        x = np.zeros((len(codes), min(step, width - a)), np.float32)
        x[row[lo:hi], col[lo:hi] - a] = 1
        both += x[:first] @ x.T
    return np.nonzero(np.triu(both / (size[:first, None] + size[None, :] - both) >= least, 1))


def _lots(bounds: np.ndarray, texts: np.ndarray) -> list[np.ndarray]:
    """Bounds of whole groups, about LOT characters of text at a time."""
    size = np.array([len(x) for x in texts], np.int64)
    total = np.cumsum(np.add.reduceat(size, bounds[:-1]))
    cut = np.flatnonzero(np.diff(total // LOT) > 0) + 1
    return [bounds[a:b + 1] for a, b in zip(np.r_[0, cut], np.r_[cut, len(bounds) - 1])]


def _links(batches):
    """Spanning edges of the exact links in every bucket of one block; all buckets of a few lines are checked at once."""
    for cols in whole_groups(batches, ["k"]):
        group, texts = cols["_group"], cols["x"]
        bounds = np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(group)]
        us, vs = [], []
        for part in _lots(bounds, texts):
            base, n = part[0], np.diff(part)
            code, at = _line_sets(list(texts[base:part[-1]]))
            few = np.flatnonzero(np.repeat(n <= FEW, n))
            pairs = [(few[i], few[j]) for i, j in pairs_in_groups(group[base:part[-1]][few])]
            i, j = (np.concatenate(x) for x in zip(*pairs)) if pairs else (few[:0], few[:0])
            near = _few_links(code, at, i, j)
            found = [(i[near], j[near])]
            for s, e in zip((part[:-1] - base)[n > FEW], (part[1:] - base)[n > FEW]):
                i, j = near_pairs([code[at[x]:at[x + 1]] for x in range(s, e)])
                found.append((s + i, s + j))
            forest = Forest(part[-1] - base)
            forest.add(*(np.concatenate(x) for x in zip(*found)))
            i, root = forest.stars()
            us.append(cols["line"][base + i]), vs.append(cols["line"][base + root])
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])


def line_components(src: DataFrame, firsts: DataFrame) -> DataFrame:
    """(node, component) for every line that has a near, different line.

    ``src`` is (doc_id, text), ``firsts`` has the first occurrence of every line.
    """
    # one sort column of eight bytes: Spark sorts it without comparing rows
    rows = src.mapInArrow(_bands, "k long, line long").repartition("k").sortWithinPartitions("k")
    shared = keep(rows.mapInArrow(_shared, "k long, line long").distinct())
    size = shared.groupBy("k").agg(F.count("*").alias("n"), F.expr("bit_xor(line)").alias("x"),
                                   F.expr("sum(pmod(line, 1000003))").alias("s"))
    size = size.groupBy("n", "x", "s").agg(F.min("k").alias("k"))
    size = size.select("k", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("parts"))
    member = keep(shared.join(size, "k"))
    places = firsts.select("line", F.col("first.doc").alias("doc"), F.col("first.no").alias("no"))
    texts = store(_texts(src, keep(member.select("line").distinct().join(places, "line"))), "line-texts")
    small = member.where("parts = 1").join(texts, "line").select("k", "line", "x")
    small = small.repartition("k").sortWithinPartitions("k", "line").mapInArrow(_links, "u long, v long")
    big = member.where("parts > 1").withColumn("blk", F.pmod(F.xxhash64("line"), F.col("parts")).cast("int"))
    big = store(big.join(texts, "line").select("k", "parts", "blk", "line", "x"), "line-buckets")
    return connected_components(small if big.isEmpty() else small.unionByName(_big_links(big)))


def _groups(cols: dict, group: np.ndarray) -> list[tuple[int, int]]:
    bounds = np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(group)]
    return list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))


def _to_pivots(batches):
    """What a block's lines are to the pivots of their bucket, as rows (k, line, class, kind).

    MINE: the line's class, which is the first pivot that is near, else the line itself.  AROUND_IT: a pivot at
    similarity AROUND or more that is not the line's class.  SAME: two pivots linked by a near line or by each
    other; every pivot is told with itself.
    """
    for cols in whole_groups(batches, ["k", "blk"]):
        ks, lines, classes, kinds = [], [], [], []
        for s, e in _groups(cols, cols["_group"]):
            line, pivot = cols["line"][s:e], cols["pivot"][s:e].astype(bool)
            order = np.r_[np.flatnonzero(pivot), np.flatnonzero(~pivot)]
            line, p = line[order], int(pivot.sum())
            codes = shingle_codes([cols["x"][s + o] for o in order])
            i, j = near_pairs(codes, p)
            own = line.copy()
            by = np.lexsort((i, j))
            first = np.r_[True, np.diff(j[by]) > 0] if len(by) else np.zeros(0, bool)
            own[j[by][first]] = line[i[by][first]]
            forest = Forest(p)  # pivots that share a line
            lead = np.zeros(len(line), np.int64)
            lead[j[by][first]] = i[by][first]
            forest.add(i, np.where(j < p, j, lead[j]))
            a, root = forest.stars()
            at = np.arange(p, len(line))
            i, j = near_pairs(codes, p, AROUND)
            far = (j >= p) & (own[j] != line[i])
            i, j = i[far], j[far]
            here = len(at) + len(j) + len(a) + p
            ks.append(np.full(here, cols["k"][s]))
            lines += [line[at], line[j], line[a], line[:p]]
            classes += [own[at], line[i], line[root], line[:p]]
            kinds.append(np.repeat(np.array([MINE, AROUND_IT, SAME]), [len(at), len(j), len(a) + p]))
        if lines:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (ks, lines, classes, kinds)], ["k", "line", "class", "kind"])


def _pivot_classes(batches):
    """(k, class, whole) of every pivot: the smallest pivot it is linked to.  A bucket has PIVOTS pivots at most."""
    for cols in whole_groups(batches, ["k"]):
        ks, classes, wholes = [], [], []
        for s, e in _groups(cols, cols["_group"]):
            names, at = np.unique(np.r_[cols["line"][s:e], cols["class"][s:e]], return_inverse=True)
            forest = Forest(len(names))
            forest.add(at[:e - s], at[e - s:])
            ks.append(np.full(len(names), cols["k"][s])), classes.append(names), wholes.append(names[forest.label])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (ks, classes, wholes)], ["k", "class", "whole"])


def _rest_links(batches):
    """Links of a block of lines (``rest``) with a block of others, as edges between classes."""
    for cols in whole_groups(batches, ["k", "p", "a", "b"]):
        us, vs = [], []
        for s, e in _groups(cols, cols["_group"]):
            rest = cols["rest"][s:e].astype(bool)
            order = np.r_[np.flatnonzero(rest), np.flatnonzero(~rest)]
            i, j = near_pairs(shingle_codes([cols["x"][s + o] for o in order]), int(rest.sum()))
            names, own = np.unique(cols["class"][s:e][order], return_inverse=True)
            forest = Forest(len(names))
            forest.add(own[i], own[j])
            i, root = forest.stars()
            us.append(names[i]), vs.append(names[root])
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])


def _meetings(rest: DataFrame, every: DataFrame) -> DataFrame:
    """Links of every line of ``rest`` with every line of ``every`` of equal (k, p), in pairs of blocks."""
    keys = ["k", "p"]
    blocks = lambda t, name: t.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias(name))
    sizes = blocks(rest, "lots").join(blocks(every, "parts"), keys)
    deal = lambda seed, of: F.pmod(F.xxhash64("line", F.lit(seed)), F.col(of)).cast("int")
    copies = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    one = rest.join(sizes, keys).select(*keys, deal(1, "lots").alias("a"), copies("parts").alias("b"), "class", "x", F.lit(True).alias("rest"))
    two = every.join(sizes, keys).select(*keys, copies("lots").alias("a"), deal(2, "parts").alias("b"), "class", "x", F.lit(False).alias("rest"))
    both = one.unionByName(two).repartition(*keys, "a", "b").sortWithinPartitions(*keys, "a", "b")
    return both.mapInArrow(_rest_links, "u long, v long")


def _big_links(big: DataFrame) -> DataFrame:
    """Edges of buckets of several blocks, at most about one a line and bucket for any group of near copies.

    All lines meet PIVOTS lines of their bucket first.  A line near a pivot is of the pivot's class, and
    classes that share a line are one.  Lines near none (``rest``) meet every line.  Of two near lines of
    different classes, the second is at most twice a link's distance away from the first one's pivot, so
    the lines of a pivot's class meet those around the pivot that are of another class.
    """
    rank = F.row_number().over(Window.partitionBy("k").orderBy(F.xxhash64("line"), "line"))
    pivots = big.select("k", "parts", "line", rank.alias("r")).where(F.col("r") <= PIVOTS).drop("r", "parts")
    is_pivot = pivots.withColumn("pivot", F.lit(True))
    marked = big.join(is_pivot, ["k", "line"], "left").withColumn("pivot", F.coalesce("pivot", F.lit(False)))
    sent = marked.where("pivot").withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = marked.where("not pivot").unionByName(sent).select("k", "blk", "line", "x", "pivot")
    rows = rows.repartition("k", "blk").sortWithinPartitions("k", "blk")
    found = keep(rows.mapInArrow(_to_pivots, "k long, line long, class long, kind int"))
    of_line = found.where(F.col("kind") == int(MINE)).select("k", "line", "class")
    same = found.where(F.col("kind") == int(SAME)).select("k", "line", "class").distinct().repartition("k").sortWithinPartitions("k")
    whole = keep(same.mapInArrow(_pivot_classes, "k long, class long, whole long"))  # PIVOTS rows a bucket
    stars = of_line.select(F.col("line").alias("u"), F.col("class").alias("v")).unionByName(
        whole.select(F.col("class").alias("u"), F.col("whole").alias("v"))).where("u <> v")
    # one class for a line, or none (rest); pivots are of their own class
    named = of_line.where("line <> class").unionByName(whole.select("k", F.col("class").alias("line"), "class"))
    named = keep(named.join(whole, ["k", "class"]))
    rest = of_line.where("line = class").select("k", "line", "class")
    texts = big.select("k", "line", "x")
    zero = F.lit(0).cast("long").alias("p")
    lone = rest.join(texts, ["k", "line"]).select("k", zero, "line", "class", "x")
    every = texts.join(rest.select("k").distinct(), "k", "left_semi").join(named.select("k", "line", "whole"), ["k", "line"], "left")
    links = stars.unionByName(_meetings(lone, every.select("k", zero, "line", F.coalesce("whole", "line").alias("class"), "x")))
    around = found.where(F.col("kind") == int(AROUND_IT)).select("k", "line", F.col("class").alias("p"))
    around = around.join(named.select("k", "line", "whole"), ["k", "line"])  # rest has met every line
    around = around.join(whole.select("k", F.col("class").alias("p"), F.col("whole").alias("of")), ["k", "p"]).where("whole <> of")
    around = keep(around.select("k", "p", "line", F.col("whole").alias("class")))
    if around.isEmpty():
        return links
    inner = named.select("k", "line", F.col("class").alias("p"), F.col("whole").alias("class"))
    inner = inner.join(around.select("k", "p").distinct(), ["k", "p"], "left_semi")
    return links.unionByName(_meetings(inner.join(texts, ["k", "line"]), around.join(texts, ["k", "line"])))


def _decisions(src: DataFrame) -> DataFrame:
    """One row per non-blank line occurrence of (doc_id, text, row); ``row`` tells rows of null doc_id apart."""
    occ = src.mapInArrow(_occurrences, "doc_id long, row long, line_no int, line long")
    occ = store(occ, "line-occurrences")
    src = src.select("doc_id", "text")
    no_id = F.col("doc_id").isNull()
    order = F.struct(no_id.alias("no_id"), F.col("doc_id").alias("doc"), F.col("line_no").alias("no"), F.when(no_id, F.col("row")).alias("row"))
    per_line = keep(occ.groupBy("line").agg(F.min(order).alias("first"), F.count("*").alias("n")))
    comp = line_components(src, per_line).withColumnRenamed("node", "line")
    per_line = per_line.join(comp, "line", "left").where("n > 1 or component is not null")
    per_line = keep(per_line.withColumn("component", F.coalesce("component", "line")))
    # lines of different rows without id may meet at one line number: the smaller hash goes first
    order = F.struct("first.no_id", "first.doc", "first.no", F.when(F.col("first.no_id"), F.col("line")).alias("line"), "first.row")
    first = per_line.groupBy("component").agg(F.min(order).alias("first"))
    named = keep(left_join_salted(per_line.select("line", "component"), first, "component", F.col("line")))
    out = left_join_salted(occ, named, "line", F.struct("doc_id", "row", "line_no"))
    doc, no = F.col("first.doc"), F.col("first.no")
    same = F.col("doc_id").eqNullSafe(doc) & (F.col("line_no") == no) & (F.col("doc_id").isNotNull() | (F.col("row") == F.col("first.row")))
    return out.select(
        "row", "doc_id", "line_no", "line", F.coalesce("component", "line").alias("component"),
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(doc).alias("first_doc"),
        F.when(F.col("first").isNull(), F.col("line_no")).otherwise(no).alias("first_line"),
        (F.col("first").isNull() | same).alias("kept"))


def line_decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per non-blank line occurrence: doc_id, line_no, line, component, first_doc, first_line, kept.

    ``component`` is the smallest line hash of the component (the line's own if it has no
    near line); first_doc and first_line name the occurrence that stays.
    """
    # the numbers are read once, with the occurrences, which are stored
    row = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias("row")
    return _decisions(_source(docs, id_col, text_col).select("doc_id", "text", row)).drop("row")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines that do not stay, in its own columns."""
    names = docs.columns
    # rows are numbered in a stored table: ids may be null or repeat
    rows = store(docs.select(F.struct(*names).alias("_doc"), F.monotonically_increasing_id().alias("_row")), "line-rows")
    field = F.col("_doc").getField
    src = rows.select(field(id_col).cast("long").alias("doc_id"), field(text_col).alias("text"), F.col("_row").alias("row"))
    lost = _decisions(src).where("not kept").groupBy(F.col("row").alias("_row")).agg(F.collect_list("line_no").alias("_lost"))
    text_type = docs.schema[text_col].dataType
    bare = F.struct(*[(F.lit(None).cast(text_type) if c == text_col else field(c)).alias(c) for c in names])  # the text moves once
    wide = rows.select("_row", bare.alias("_doc"), field(text_col).alias("_text")).join(lost, "_row", "left")

    def run(batches):
        for part in text_slices(batches, "_text"):
            texts, stays = [], []
            for text, gone in zip(part.column("_text").to_pylist(), part.column("_lost").to_pylist()):
                stay = True
                if gone and text is not None:
                    gone = set(gone)
                    left = [raw for k, raw in enumerate(text.split("\n")) if k not in gone]
                    text, stay = "\n".join(left), any(map(normal, left))
                texts.append(text)
                stays.append(stay)
            yield pa.RecordBatch.from_arrays(
                [part.column("_doc"), pa.array(texts, pa.string()), pa.array(stays)], ["_doc", "_text", "_stays"])

    wide = wide.select("_doc", "_text", "_lost")
    kind = wide.schema["_doc"].dataType.simpleString()
    out = wide.mapInArrow(run, f"_doc {kind}, _text string, _stays boolean").where("_stays")
    return out.select(*[F.col("_text").alias(c) if c == text_col else F.col("_doc")[c].alias(c) for c in names])
