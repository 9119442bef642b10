"""Best-fit packing with large-item matching (operator 7).

A document is its token ids followed by the end id; one longer than the capacity is cut into
full pieces, the first piece being the shorter one.  Packing needs only how many pieces
have each length (at most ``capacity`` numbers), so it is planned exactly and globally:

1. lengths above a third of the capacity fit at most twice into a sequence: from the largest
   down, each is matched with the largest unmatched one that still fits;
2. smaller lengths, from the largest down, go to the tightest gap that holds them
   (best fit); where none does, new sequences open.

Equal sequences are planned as one group with a count, so the plan grows with the capacity
and not with the documents.  It says, per length, which sequence and place the 1st, 2nd, ...
piece of that length gets; pieces are numbered within their length by a distributed sort
over (length, hash bucket), so a length shared by a third of all pieces is no hot key.

Tokens: texts are cut before single spaces between visible characters, where the byte-level
pre-tokenizer always cuts too, and a task remembers the ids of segments (``MEMO`` at most).
A new segment is encoded by ``tiktoken`` over the vocabulary of the tokenizer file, which
gives the ids of the ``tokenizers`` library (tested against it) at a tenth of its time; a text
that holds a special token goes through ``tokenizers`` itself.

Cases: null text is empty: the end id alone, one piece; repeated rows are packed each; special token
text inside a document is encoded as the library does; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexaria.llm.common import store, text_slices

CAPACITY = 2048
MEMO = 300_000
ROWS_PER_BUCKET = 100_000
_CUT = re.compile(r"(?<=\S) (?=\S)")


def _byte_symbols() -> dict[str, int]:
    """Character of a byte-level vocabulary -> byte: printable Latin-1 stands for itself, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, tokenizer_json: str, pattern: str, end_id: int = 0):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(tokenizer_json)
        byte = _byte_symbols()
        self.special = [t["content"] for t in spec["added_tokens"]]
        ranks = {bytes(byte[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in self.special}
        self.fast = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.tok = Tokenizer.from_str(tokenizer_json)
        self.end = np.uint32(end_id).tobytes()
        self.memo = _Memo(self._segment)

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        for t in texts:
            yield self._ids(t or "") + self.end

    def _ids(self, text: str) -> bytes:
        if not text:
            return b""
        if any(x in text for x in self.special):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = _CUT.split(text)
        return b"".join(map(self.memo.__getitem__, [first, *(" " + x for x in rest)]))

    def _segment(self, text: str) -> bytes:
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()


class _Memo(dict):
    """Remembers the first ``MEMO`` segments, which hold nearly all frequent ones."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, text):
        got = self.make(text)
        if len(self) < MEMO and len(text) < 64:
            self[text] = got
        return got


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str,
           with_ids: bool, pattern: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if wanted, the ids as bytes."""
    with open(tokenizer, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        enc = Encoder(sent.value, pattern, end_id)
        for part in text_slices(batches, "text"):
            ids, no, start, length, crc, raw = [], [], [], [], [], []
            for doc, data in zip(part.column("doc_id").to_pylist(), enc.encode(part.column("text").to_pylist())):
                n = len(data) // 4
                first = n if n <= capacity else n % capacity or capacity
                cut = [0, *range(first, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cut, cut[1:])):
                    piece = data[4 * a:4 * b]
                    ids.append(doc), no.append(k), start.append(a), length.append(b - a), crc.append(zlib.crc32(piece))
                    if with_ids:
                        raw.append(piece)
            cols = [pa.array(ids, pa.int64()), pa.array(no, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(raw, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return src.mapInArrow(run, kind)


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Places (length, lo, hi, first sequence, offset) and the number of sequences.

    Pieces lo..hi-1 of a length (counted from 0) go to consecutive sequences from the first.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    used = dict.fromkeys(left, 0)
    places: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # free room -> [(first sequence, count)]
    rooms: list[int] = []  # the sorted rooms of gaps
    sequences = 0

    def put(n: int, count: int, first: int, offset: int) -> None:
        places.append((n, used[n], used[n] + count, first, offset))
        used[n] += count
        left[n] -= count

    def open_gap(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in gaps:
                gaps[room] = []
                insort(rooms, room)
            gaps[room].append((first, count))

    large = sorted(n for n in left if 3 * n > capacity)
    for x in reversed(large):
        while left[x]:
            y = next((y for y in reversed(large[:bisect_left(large, capacity - x + 1)]) if left[y] > (y == x)), None)
            count = left[x] if y is None else left[x] // 2 if x == y else min(left[x], left[y])
            put(x, count, sequences, 0)
            if y is not None:
                put(y, count, sequences, x)
            open_gap(capacity - x - (y or 0), sequences, count)
            sequences += count
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect_left(rooms, n)
            if at < len(rooms):
                room = rooms[at]
                first, count = gaps[room].pop()
                take = min(count, left[n])
                if take < count:
                    gaps[room].append((first + take, count - take))
                if not gaps[room]:
                    del gaps[room], rooms[at]
                put(n, take, first, capacity - room)
                open_gap(room - n, first, take)
            else:
                count = max(1, left[n] * n // capacity)
                open_gap(capacity, sequences, count)
                sequences += count
    return places, sequences


def pack(docs: DataFrame, tokenizer: str, pattern: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id",
         text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset [, ids].

    ``tokenizer``: path of a byte-level BPE in the JSON format of the ``tokenizers`` library;
    ``pattern``: its pre-tokenizer's pattern.
    """
    cut = store(pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids, pattern), "pieces")
    size = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    places, _ = plan(size, capacity)
    by_length: dict[int, list] = {}
    for n, lo, hi, first, offset in places:
        by_length.setdefault(n, []).append((lo, first, offset))
    table = {n: tuple(np.array(c, np.int64) for c in zip(*sorted(rows))) for n, rows in by_length.items()}
    sent = docs.sparkSession.sparkContext.broadcast(table)

    buckets = sum(size.values()) // ROWS_PER_BUCKET + 1
    key = ["doc_id", "piece", "start", "ids_crc32"]
    rows = cut.withColumn("_b", F.pmod(F.xxhash64(*key), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("length", "_b").agg(F.count("*").alias("n"))
    base = base.select("length", "_b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("length", "_b").orderBy(*key)) - 1)
    rows = rows.join(base, ["length", "_b"]).withColumn("_rank", F.col("_k") + F.col("base"))
    def places_of(length: pa.Array, rank: pa.Array) -> pa.Array:
        n, rank = length.to_numpy(), rank.to_numpy()
        seq, off = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        for x in np.unique(n):
            lo, first, offset = sent.value[int(x)]
            m = n == x
            at = np.searchsorted(lo, rank[m], side="right") - 1
            seq[m], off[m] = first[at] + rank[m] - lo[at], offset[at]
        return pa.StructArray.from_arrays([pa.array(seq), pa.array(off)], ["sequence_id", "offset"])

    # two numbers a piece go through Python, the ids don't
    place = F.arrow_udf(places_of, "struct<sequence_id:long,offset:long>")
    placed = rows.select(*cut.columns, place(F.col("length"), F.col("_rank")).alias("_place"))
    return placed.select(*cut.columns, "_place.sequence_id", "_place.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the sequences themselves, from ``pack(..., with_ids=True)``.

    ids are little-endian unsigned 32-bit integers; a sequence has at most the capacity of them.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("p"))
    return whole.select("sequence_id", "n_tokens", F.expr("aggregate(p, X'', (a, x) -> a || x.ids)").alias("ids"))
