"""Runs, conversation repair and passage dedup against brute force."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexaria.llm import queries, repair, runs, suffix_dedup


# ---- operator 11

def brute_runs(w, least=6, times=4):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            s, length = i, j - i + q
            prim = all(any(w[k] != w[k + p] for k in range(s, s + length - p)) for p in range(1, q))
            if prim and length >= max(least, times * q):
                out.append((s, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_brute_force(make_docs):
    rng = random.Random(5)
    fib = ["a", "ab"]
    while len(fib[-1]) < 90:
        fib.append(fib[-1] + fib[-2])
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(0, 60))) for _ in range(150)]
    texts += [" ".join(rng.choice("abc") for _ in range(40)) + " x y z" * rng.randrange(1, 9) + " x" for _ in range(40)]
    texts += [" ".join(fib[-1]), "a " * 3000, " ".join("ab" * 700 + "c" + "ab" * 700), None, "", "  \n\t", "one", "é é " * 9, "a\x0ba\x0ca\ra a\na"]
    rows = list(enumerate(texts)) + [(None, "q r q r q r q r"), (None, "q r q r q r q r"), (3, texts[3])]
    for times, least in ((4, 6), (2, 2)):
        got = runs.periodic_runs(make_docs(rows), min_length=least, min_exponent=times).collect()
        want = []
        for d, t in rows:
            w = [x.decode() for x in (t or "").encode().split()]
            if len(w) < 200:
                found = brute_runs(w, least, times)
                want.append((-1 if d is None else d, len(w), found, collapsed(w, found)))
        have = [(-1 if r.doc_id is None else r.doc_id, r.n_words, [(x.start, x.length, x.period) for x in r.runs], r.collapsed) for r in got]
        assert sorted(x for x in have if x[1] < 200) == sorted(want)
        long = {r.doc_id: r for r in got if r.n_words >= 200}
        assert [tuple(x) for x in long[rows[191][0]].runs] == [(0, 3000, 1)] and long[191].collapsed == "a"
        assert [tuple(x) for x in long[192].runs][0] == (0, 1400, 2)
    with pytest.raises(ValueError):
        runs.periodic_runs(make_docs(rows), min_exponent=1)


def test_runs_of_an_empty_table(make_docs, spark):
    assert runs.periodic_runs(make_docs([(1, "a")]).limit(0)).count() == 0


def test_positions_in_order():
    rng = random.Random(1)
    xs = rng.sample(range(100000), 9000)
    p, have = runs.Positions(xs[0]), [xs[0]]
    for x in xs[1:]:
        before, after = p.add(x)
        have.append(x)
        assert before == max((y for y in have if y < x), default=None) if x % 50 == 0 else True
        assert after == min((y for y in have if y > x), default=None) if x % 50 == 0 else True
    assert list(p) == sorted(xs)


def test_op11_query(spark, make_docs, prose, tmp_path):
    rows = [(d, t) for d, t in prose] + [(700 + i, " ".join(f"w{j}" for j in range(i * 7))) for i in range(40)]
    make_docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op11_lcp_runs"](spark, str(tmp_path)).collect()
    want, planted = [], 0
    for d, t in rows:
        w = [x.decode() for x in (t or "").encode().split()]
        n = len(w)
        if d is not None and n:
            h = zlib.crc32(str(d).encode())
            g = h // 10
            if h % 10 == 0:
                planted += 1
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = brute_runs(w) if n < 400 else [(0, n, 1)] if len(set(w)) == 1 else brute_runs(w)
        best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        s, length, q = best
        text = "".join(f"{a},{b},{c}\n" for a, b, c in found)
        want.append((-1 if d is None else d, len(found), s, length, q, None if q is None else 1000 * length // q,
                     hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(collapsed(w, found).encode()).hexdigest()))
    have = [(-1 if r[0] is None else r[0], *r[1:]) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str) and planted > 5 and any(x[1] for x in want)


# ---- operator 12

def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip("\t\n\x0b\x0c\r ")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute_repair(rows, most_inserts=2):
    """Least (cost, audit, repaired rows) by trying every edit list."""
    fault, best = faults(rows), None

    def ok(s):
        s = s[1:] if s[:1] == "s" and len(s) > 1 else s
        return s == "ua" * (len(s) // 2)

    choices = []
    for (role, text), f in zip(rows, fault):
        c = [("D", 2, None)]
        if f not in ("blank", "duplicate"):
            x = 5 * (f == "truncated")
            c += [("K", x, (role, text)), ("R", 1 + x, ("user", text)), ("R", 1 + x, ("assistant", text))]
        choices.append(c)
    for combo in itertools.product(*choices):
        for t in range(most_inserts + 1):
            for places in itertools.combinations_with_replacement(range(len(rows) + 1), t):
                for who in itertools.product(("user", "assistant"), repeat=t):
                    edits = []
                    for i in range(len(rows) + 1):
                        edits += [("I", 5, (w, "")) for p, w in zip(places, who) if p == i]
                        edits += [combo[i]] if i < len(rows) else []
                    if ok("".join(e[2][0][:1] for e in edits if e[2])):
                        got = (sum(e[1] for e in edits), "".join(e[0] for e in edits), [e[2] for e in edits if e[2]])
                        best = min(best or got, got)
    return best


def random_rows(rng, n):
    roles = ["user", "assistant", "system", "tool", "user", "assistant"]
    texts = ["Hi there.", "What now?", "cut off", " ", "Done! ", "Yes.", "", "so ", "Well.\n"]
    return [(rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def by_segments(rows, size):
    fault = [("", "blank", "duplicate", "truncated").index(f) for f in faults(rows)]
    paths = {(repair.START, 0): (0, 0)}
    for a in range(0, len(rows), size):
        seg = repair.Segment(len(rows[a:a + size]) + repair.SPARE, range(4) if a else (0,))
        for (role, _), f in zip(rows[a:a + size], fault[a:a + size]):
            seg.feed(role[:1], f)
        paths = repair.join_paths(paths, len(rows[a:a + size]), seg.close())
    return repair.answer(paths)


def test_repair_brute_force():
    rng = random.Random(8)
    for _ in range(120):
        rows = random_rows(rng, rng.randrange(0, 5))
        want = brute_repair(rows)[:2]
        for size in (1, 2, 100):
            assert by_segments(rows, size) == want, (rows, size)
    for n in (30, 301, 1500):  # segments don't change the answer
        rows = random_rows(rng, n)
        want = by_segments(rows, 10000)
        assert len({by_segments(rows, s) for s in (1, 7, 64)} | {want}) == 1


def test_inserts_where_deletion_costs_more(monkeypatch):
    monkeypatch.setattr(repair, "DELETE", 20)
    rows = [("assistant", "Yes."), ("assistant", "Done! ")]
    assert by_segments(rows, 100) == by_segments(rows, 1) == (1, "RK")
    assert by_segments([("user", "Hi there.")], 9) == (5, "KI")
    assert by_segments([("assistant", "Yes.")], 9) == (5, "IK")


def conversation(rows):
    fault, best = faults(rows), brute_repair(rows, 0)
    initials = [r[:1] for r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    text = "\n".join(f"{r}:{t}" for r, t in best[2])
    return [fault.count("blank"), fault.count("duplicate"), fault.count("truncated"), illegal, best[0], best[1],
            hashlib.sha256(text.encode()).hexdigest()]


def test_op12_query(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    table = []
    for c in [*range(60), None]:
        turns = rng.sample(range(9), rng.randrange(1, 6))
        table += [(c, t if rng.random() < 0.93 else None, *r, 5) for t, r in zip(sorted(turns), random_rows(rng, len(turns)))]
    table += [(3, 100, None, "Null role."), (3, 101, "user", None), (4, 100, "user", "Same."), (4, 100, "user", "Same.")]
    table = [(*r, 5)[:5] for r in table]
    path = f"{tmp_path}/conversations.parquet"
    spark.createDataFrame(table, "conv_id long, turn long, role string, text string, m int").repartition(3).write.parquet(path)

    def want():
        out = {}
        for c in {r[0] for r in table}:
            rows = []
            for _, t, role, text, _ in (r for r in table if r[0] == c):
                role, text = (" " if x is None else x for x in (role, text))
                h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
                if h == 0:
                    continue
                text = "" if h == 1 else text.translate({ord(x): None for x in ".!?"}) if h == 2 else text
                role = "user" if h == 4 else role
                key = hashlib.sha256((spark_json(c, role, text)).encode()).digest()
                rows += [((t is not None, t or 0), role, key, text)] * (2 if h == 3 else 1)
            rows.sort(key=lambda r: r[:3])
            turns = {t for (some, t), *_ in rows if some}
            gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
            out[c] = [gaps, *conversation([(r, x) for _, r, _, x in rows])]
        return out

    def spark_json(c, role, text):
        import json
        d = {"conv": c, "role": role, "text": text}
        return json.dumps({k: v for k, v in d.items() if v is not None}, separators=(",", ":"), ensure_ascii=False).replace("\u000b", "\\u000B")

    expected = want()
    for segment in (2048, 2):
        real = repair.plan_repairs
        monkeypatch.setattr(repair, "plan_repairs", lambda *a, **k: real(*a, **k, segment=segment))
        got = {r[0]: list(r[1:]) for r in queries.QUERIES["op12_conversation_repair"](spark, str(tmp_path)).collect()}
        monkeypatch.setattr(repair, "plan_repairs", real)
        assert got == expected
    assert len(expected) == 61


def test_repair_of_empty_and_long_tables(spark):
    ddl = "conv_id long, turn long, role string, text string"
    empty = spark.createDataFrame([], ddl)
    plan, found = repair.plan_repairs(empty)
    assert plan.count() == 0 and repair.hashes(repair.repaired_rows(empty, plan, found)).count() == 0
    hot = spark.range(30000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                    F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                                    F.concat(F.lit("Line "), (F.col("id") - F.col("id") % 50).cast("string"), F.lit(".")).alias("text"))
    plan, found = repair.plan_repairs(hot)
    row = plan.first()
    assert row.duplicate == 30000 - 2 * 600 and row.illegal == 0 and row.cost == 2 * row.duplicate
    assert row.audit == ("KK" + "D" * 48) * 600
    lines = repair.repaired_rows(hot, plan, found)
    assert lines.count() == 1200


# ---- operator 13

def brute_repeats(rows, width=50):
    first = {}
    for d, t in rows:
        raw, key = (t or "").encode(), (d is None, d or 0)
        for i in range(len(raw) - width + 1):
            s = raw[i:i + width]
            first[s] = min(first.get(s, key), key)
    out = []
    for d, t in rows:
        raw, key = (t or "").encode(), (d is None, d or 0)
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - width + 1):
            if first[raw[i:i + width]] < key:
                gone[i:i + width] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone[:-1]])
        out.append((-1 if d is None else d, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def repeats_rows(prose):
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(400))
    rows = list(prose)
    for i in range(60):
        a, n = rng.randrange(300), rng.randrange(45, 100)
        rows.append((600 + i, f"start {i} {rng.random()} " + passage[a:a + n] + f" end {rng.random()}" * rng.randrange(3)))
    rows += [(800 + i, "a" * (40 + 20 * i)) for i in range(6)]
    rows += [(810 + i, "xyz" * (30 + i) + str(i)) for i in range(5)]
    rows += [(820, passage[:50]), (821, passage[:49]), (822, passage[1:51]), (-5, passage[100:170]), (823, "nul\0\0\0\0" * 20), (824, "nul\0\0\0\0" * 21)]
    return rows


@pytest.mark.parametrize("chunk,per", [(1 << 21, 64), (4096, 4)])
def test_op13_query(spark, make_docs, prose, tmp_path, monkeypatch, chunk, per):
    real = suffix_dedup.remove_repeats
    monkeypatch.setattr(suffix_dedup, "remove_repeats", lambda docs: real(docs, chunk=chunk))
    monkeypatch.setattr(suffix_dedup, "PER_BUCKET", per)
    rows = repeats_rows(prose)
    make_docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op13_suffix_array"](spark, str(tmp_path)).collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == brute_repeats(rows)


def test_repeats_compared_across_boundaries(spark, make_docs, tmp_path):
    """One lead fills most buckets: every bucket holds copies, the smallest document is in one of them."""
    rng = random.Random(2)
    text = "".join(rng.choice("abcd") for _ in range(130))
    rows = [(i, text + str(i)) for i in range(300)] + [(1000, "none of it, but words that nobody else has written, not even here")]
    frame = make_docs(rows)
    found = suffix_dedup.repeated_spans(frame, width=50)
    assert found.where("d = 0").count() == 0
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op13_suffix_array"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == brute_repeats(rows)


def test_repeats_of_empty_table(make_docs):
    assert suffix_dedup.remove_repeats(make_docs([(1, "x")]).limit(0)).count() == 0


def test_multikey_quicksort():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, (500, 4)).astype(np.uint64)
    head = np.zeros(500, bool)
    head[[0, 10, 11, 200]] = True
    order, groups = suffix_dedup.multikey_quicksort(head, 4, lambda i, depth: words[i, depth])
    seg = np.cumsum(head) - 1
    want = sorted(range(500), key=lambda i: (seg[i], *words[i]))
    keys = [(seg[i], *words[i]) for i in order]
    assert keys == [(seg[i], *words[i]) for i in want]
    assert groups.tolist() == [k == 0 or keys[k] != keys[k - 1] for k in range(500)]
