"""Conversation structure repair (operator 12).

The rows of a conversation are edited at least cost so that their role initials read
``(s?(ua)+)?``: Keep 0, Rerole to user or assistant 1, Delete 2 (required for blank and duplicate
rows), Insert an empty user or assistant row 5; a truncated row that stays adds 5.  Of
the cheapest edits the one whose audit (edit initials in order) is least in ASCII wins.

Method: a node is (rows read, inserts so far, state of the pattern).  A path has one integer
as its weight: high digits are the cost, low digits, of a fixed width, the audit letters, the k-th
letter at the k-th place and zeros behind the last.  An edge adds its cost and its letter at the
place of its edit, so the ordinary minimum of integers decides costs and ties alike.  A path
that is dearer than another one to the same row and state is dropped, which bounds the
inserts: no cheapest path between two states has more than two.

A conversation may hold a third of all rows.  Rows are range-partitioned in their order;
every partition cuts its part of a conversation into segments of at most ``SEGMENT`` rows and
computes the segment's least integers between all pairs of states; they are joined in
order, one small row a segment.  Duplicates come from an aggregate by (conversation, role, text).
Only the final pass reads a conversation in one stream, row by row, since a hash
of the whole text has no parallel form; it holds one batch and the audit.

Cases: null role or text is one space; a null conversation is one of its own; null turns come
first; equal rows are copies of one another (all but the first are duplicates); rows of equal turn are
ordered by role and SHA-256 of the text; conversations without rows get zeros and empty
strings; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaria.llm.common import left_join_salted, store

KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
LETTERS = "DIKR"  # in ASCII order; digit = place + 1, 0 pads the end
D, I, K, R = range(1, 5)
BITS = 3
SPARE = 3  # digits for inserts
SEGMENT = 2048
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
START, SYSTEM, USER, ASSISTANT = range(4)  # what the repaired rows so far end in
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
ENDS = (START, ASSISTANT)
SPACE = "\t\n\x0b\x0c\r "


class Segment:
    """Least path integers from given states through rows that are fed one by one.

    ``paths`` maps (state before, state now, inserts) to an integer of ``places`` audit digits.
    """

    def __init__(self, places: int, states):
        self.places, self.rows = places, 0
        self.unit = 1 << BITS * places
        self.paths = {(s, s, 0): 0 for s in states}
        self._insert()

    def _edge(self, cost: int, letter: int, k: int) -> int:
        return cost * self.unit + (letter << BITS * (self.places - 1 - k))

    def _least(self, paths: dict) -> dict:
        best: dict = {}
        for (s, q, _), w in paths.items():
            c = w >> BITS * self.places
            if c < best.get((s, q), c + 1):
                best[s, q] = c
        return {k: w for k, w in paths.items() if w >> BITS * self.places == best[k[:2]]}

    def _insert(self) -> None:
        new = dict(self.paths)
        front = new
        while front:
            found = {}
            for (s, q, t), w in front.items():
                to = (s, STEP[q, NEXT[q]], t + 1)
                w += self._edge(INSERT, I, self.rows + t)
                if w < new.get(to, w + 1):
                    found[to] = w
            merged = self._least(new | found)
            front = {k: w for k, w in found.items() if k in merged}
            new = merged
        self.paths = new

    def feed(self, initial: str, fault: int) -> None:
        new: dict = {}

        def offer(key, w):
            if w < new.get(key, w + 1):
                new[key] = w

        stays, extra = fault not in (BLANK, DUPLICATE), CUT if fault == TRUNCATED else 0
        for (s, q, t), w in self.paths.items():
            k = self.rows + t
            offer((s, q, t), w + self._edge(DELETE, D, k))
            if stays:
                if (q, initial) in STEP:
                    offer((s, STEP[q, initial], t), w + self._edge(KEEP + extra, K, k))
                if initial != NEXT[q]:
                    offer((s, STEP[q, NEXT[q]], t), w + self._edge(REROLE + extra, R, k))
        self.rows += 1
        self.paths = self._least(new)
        self._insert()

    def close(self) -> dict:
        """(state before, state now, inserts) -> (cost, audit letters as a number of rows + inserts digits)."""
        return {(s, q, t): (w >> BITS * self.places, (w & self.unit - 1) >> BITS * (self.places - self.rows - t))
                for (s, q, t), w in self.paths.items()}


def join_paths(left: dict, rows: int, right: dict) -> dict:
    """Paths through a segment of ``rows`` rows behind ``left``: {(state, letters): (cost, digits)}, from START."""
    joined: dict = {}
    for (q, n), (c0, a) in left.items():
        for (s, to, t), (c1, b) in right.items():
            if s == q:
                size = rows + t
                got = (c0 + c1, a << BITS * size | b)
                if got < joined.get((to, n + size), (c0 + c1 + 1, 0)):
                    joined[to, n + size] = got
    least: dict = {}
    for (q, _), (c, _) in joined.items():
        least[q] = min(least.get(q, c), c)
    return {k: w for k, w in joined.items() if w[0] == least[k[0]]}


def answer(paths: dict) -> tuple[int, str]:
    """Cost and audit of the least path that ends well; audits of unequal length are padded with zeros."""
    places = max(n for _, n in paths)
    weight, n = min((c << BITS * places | a << BITS * (places - n), n) for (q, n), (c, a) in paths.items() if q in ENDS)
    digits = weight & (1 << BITS * places) - 1
    return weight >> BITS * places, "".join(LETTERS[(digits >> BITS * (places - 1 - k) & 7) - 1] for k in range(n))


def judged(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Distinct rows (conv, turn, role, text, m copies, key of the text) with the fault of the first copy."""
    one = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"),
                      F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    one = one.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("m"))
    key = F.unhex(F.sha2(F.to_json(F.struct("conv", "role", "text")), 256))
    one = store(one.withColumn("key", key), "turns")
    place = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    first = one.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    bare = F.rtrim("text", F.lit(SPACE))
    fault = (F.when(bare == "", BLANK).when(F.col("first") < place, DUPLICATE)
             .when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND))
    return left_join_salted(one, first, "key", F.col("turn")).select("conv", "turn", "role", "key", "m", fault.alias("fault"))


_STATS = ("n", "blank", "duplicate", "truncated", "illegal", "distinct")
_SEGMENTS = ("part int, seg int, " + ", ".join(f"{c} long" for c in _STATS)
             + ", low long, high long, head string, tail string, paths array<struct<s:int,q:int,t:int,cost:long,audit:binary>>")


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def copies(m: int, fault: int):
    """Faults of the m copies of a row."""
    yield fault
    for _ in range(m - 1):
        yield BLANK if fault == BLANK else DUPLICATE


def _flush(rows: list, places_all: bool) -> dict:
    states = range(4) if places_all else (START,)
    seg = Segment(len(rows) + SPARE, states)
    out = dict.fromkeys(_STATS, 0) | {"n": len(rows), "low": None, "high": None, "head": rows[0][1], "tail": rows[-1][1]}
    before = turn_before = None
    for turn, initial, fault in rows:
        seg.feed(initial, fault)
        if fault:
            out[("", "blank", "duplicate", "truncated")[fault]] += 1
        out["illegal"] += before is not None and not _legal(before, initial)
        if turn is not None:
            out["distinct"] += turn != turn_before
            out["low"] = turn if out["low"] is None else out["low"]
            out["high"] = turn_before = turn
        before = initial
    out["paths"] = [{"s": s, "q": q, "t": t, "cost": c, "audit": a.to_bytes((a.bit_length() + 7) // 8, "big")}
                    for (s, q, t), (c, a) in seg.close().items()]
    return out


def _segments(size: int, kind):
    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: list = []
        now, number, first = None, 0, True  # the conversation read, its next segment, whether it is the partition's first
        out: list = []

        def flush():
            nonlocal number
            out.append({"conv": now[0], "part": part, "seg": number} | _flush(held, number > 0 or first))
            number += 1
            held.clear()

        def batch():
            rb = pa.RecordBatch.from_pylist(out, schema=kind)
            out.clear()
            return rb

        for b in batches:
            for conv, turn, initial, m, fault in zip(*(b.column(c).to_pylist() for c in ("conv", "turn", "initial", "m", "fault"))):
                if now is None or now[0] != conv:
                    if held:
                        flush()
                    first, number, now = now is None, 0, (conv,)
                for f in copies(m, fault):
                    held.append((turn, initial, f))
                    if len(held) >= size:
                        flush()
            if len(out) > 2000:
                yield batch()
        if held:
            flush()
        if out:
            yield batch()

    return run


def _fold(kind):
    """Joins the segments of every conversation, which come in order; part -1 names a conversation."""
    def close(conv, paths, n):
        cost, audit = answer(paths)
        gaps = 0 if n["low"] is None else n["high"] - n["low"] + 1 - n["distinct"]
        return {"conv": conv, "gaps": gaps, "cost": cost, "audit": audit} | {c: n[c] for c in ("blank", "duplicate", "truncated", "illegal")}

    def run(batches):
        out, now = [], None
        for b in batches:
            for r in b.to_pylist():
                if now is None or now[0] != r["conv"]:
                    if now is not None:
                        out.append(close(*now))
                    now = (r["conv"], {(START, 0): (0, 0)}, dict.fromkeys(_STATS, 0) | {"low": None, "high": None, "tail": None})
                if r["part"] < 0:
                    continue
                conv, paths, n = now
                right = {(p["s"], p["q"], p["t"]): (p["cost"], int.from_bytes(p["audit"], "big")) for p in r["paths"]}
                n["illegal"] += n["tail"] is not None and not _legal(n["tail"], r["head"])
                if r["low"] is not None:
                    n["distinct"] -= n["high"] == r["low"]
                    n["low"], n["high"] = r["low"] if n["low"] is None else n["low"], r["high"]
                n["tail"] = r["tail"]
                for c in _STATS:
                    n[c] += r[c]
                now = (conv, join_paths(paths, r["n"], right), n)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=kind)
                out = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([close(*now)], schema=kind)

    return run


def _arrow(df_schema: str, conv_type: str) -> tuple[str, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = f"conv {conv_type}, {df_schema}"
    return ddl, to_arrow_schema(StructType.fromDDL(ddl))


def plan_repairs(rows: DataFrame, conversations: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn",
                 role: str = "role", text: str = "text", segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """(plan, judged rows).  The plan has a row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit.

    ``conversations`` may name further ones that have no rows left.
    """
    kind = rows.schema[conv].dataType.simpleString()
    found = store(judged(rows, conv, turn, role, text), "judged")
    slim = found.select("conv", "turn", "role", "key", "m", "fault", F.substring("role", 1, 1).alias("initial"))
    by = ("conv", "turn", "role", "key")
    slim = slim.repartitionByRange(*by).sortWithinPartitions(*by)
    ddl, schema = _arrow(_SEGMENTS, kind)
    segs = slim.select("conv", "turn", "initial", "m", "fault").mapInArrow(_segments(segment, schema), ddl)
    names = (rows if conversations is None else conversations).select(F.col(conv).alias("conv")).distinct()
    segs = segs.unionByName(names.withColumn("part", F.lit(-1)), allowMissingColumns=True)
    segs = segs.repartition("conv").sortWithinPartitions("conv", "part", "seg")
    ddl, schema = _arrow("gaps long, cost long, audit string, blank long, duplicate long, truncated long, illegal long", kind)
    return store(segs.mapInArrow(_fold(schema), ddl), "repair-plan"), found


class _Repair:
    """Applies one conversation's audit to its rows in order."""

    def __init__(self, conv, audit: str):
        self.conv, self.audit, self.at, self.state, self.pos = conv, audit, 0, START, 0

    def _put(self, edit: str, role: str, text: str, initial: str) -> dict:
        self.state = STEP[self.state, initial]
        self.pos += 1
        return {"conv": self.conv, "pos": self.pos - 1, "edit": edit, "role": role, "text": text}

    def inserts(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._put("I", {"u": "user", "a": "assistant"}[NEXT[self.state]], "", NEXT[self.state])

    def row(self, role: str, text: str):
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            yield self._put("K", role, text, role[:1])
        elif edit == "R":
            yield self._put("R", {"u": "user", "a": "assistant"}[NEXT[self.state]], text, NEXT[self.state])


def repaired_rows(rows: DataFrame, plan: DataFrame, found: DataFrame, conv: str = "conv_id", turn: str = "turn",
                  role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, edit, role, text): the repaired rows, in order inside their partition; conversations are not divided.

    A conversation without any has one row of null pos.
    """
    kind = rows.schema[conv].dataType.simpleString()
    one = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"),
                      F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    key = F.unhex(F.sha2(F.to_json(F.struct("conv", "role", "text")), 256))
    body = one.select("conv", F.lit(1).alias("ord"), "turn", "role", key.alias("key"), "text")
    head = plan.select("conv", F.lit(0).alias("ord"), F.col("audit").alias("text"))
    both = head.unionByName(body, allowMissingColumns=True)
    both = both.repartition("conv").sortWithinPartitions("conv", "ord", "turn", "role", "key")
    ddl, schema = _arrow("pos long, edit string, role string, text string", kind)

    def run(batches):
        now, out, empty = None, [], True

        def end():
            got = list(now.inserts())
            if empty and not got:
                return [{"conv": now.conv}]
            return got

        for b in batches:
            for name, ord_, r, t in zip(*(b.column(c).to_pylist() for c in ("conv", "ord", "role", "text"))):
                if ord_ == 0:
                    if now is not None:
                        out += end()
                    now, empty = _Repair(name, t), True
                else:
                    got = list(now.row(r, t))
                    empty = empty and not got
                    out += got
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if now is not None and (out := end()):
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return both.select("conv", "ord", "turn", "role", "key", "text").mapInArrow(run, ddl)


def hashes(repaired: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of ``repaired_rows``: lower-case hex of ``role:text`` lines joined by newlines."""
    kind = repaired.schema["conv"].dataType.simpleString()
    ddl, schema = _arrow("repaired_sha256 string", kind)

    def run(batches):
        now, h, done = None, None, []
        for b in batches:
            for name, pos, role, text in zip(*(b.column(c).to_pylist() for c in ("conv", "pos", "role", "text"))):
                if now is None or now[0] != name:
                    if now is not None:
                        done.append({"conv": now[0], "repaired_sha256": h.hexdigest()})
                    now, h = (name,), hashlib.sha256()
                if pos is not None:
                    h.update((("\n" if pos else "") + role + ":" + text).encode())
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
                done = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([{"conv": now[0], "repaired_sha256": h.hexdigest()}], schema=schema)

    return repaired.mapInArrow(run, ddl)


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage by crc32(conv_id:turn) % 20; nulls are one space."""
    name = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(":") for c in ("conv_id", ":", "turn")])
    h = F.crc32(F.encode(name, "UTF-8")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    text = F.when(h == 1, "").when(h == 2, F.translate(text, ".!?", "")).otherwise(text)
    out = rows.select("conv_id", "turn", F.when(h == 4, "user").otherwise(role).alias("role"), text.alias("text"), h.alias("_h"))
    twice = F.explode(F.when(F.col("_h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return out.where("_h <> 0").withColumn("_copy", twice).select("conv_id", "turn", "role", "text")
