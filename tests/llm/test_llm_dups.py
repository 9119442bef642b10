"""SimHash, fuzzy lines, components and embedding near-duplicates against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lexaria.llm import lines, simhash, vector_dups
from lexaria.llm.components import connected_components
from lexaria.llm.hashing import xxh64_slices


def fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def test_xxh64_slices():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(3000))
    s = np.array([rng.randrange(2500) for _ in range(2000)])
    e = s + np.array([rng.randrange(0, 100) for _ in range(2000)])
    assert [int(x) for x in xxh64_slices(data, s, e)] == [xxhash.xxh64_intdigest(data[a:b], 42) for a, b in zip(s, e)]


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(40)],
    [(5, i) for i in range(6, 300)] + [(1, 5)],
    [(-5, 3), (3, 9), (9, 9), (2, None), (3, -5)],
    [],
])
def test_components(spark, reach, edges):
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    want = reach(real, {x for e in real for x in e})
    got = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)


def test_simhash_components(make_docs, prose, reach):
    got = simhash.simhash_components(make_docs(prose)).collect()
    fps = [fingerprint(t) for _, t in prose]
    assert sorted((r["doc_id"] or -1, r["fp"] % (1 << 64)) for r in got) == sorted((d or -1, f) for (d, _), f in zip(prose, fps))
    distinct = sorted(set(fps))
    links = [(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1:] if bin(a ^ b).count("1") <= 3]
    assert links
    root = reach(links, distinct)
    least = {}
    for (d, _), f in zip(prose, fps):
        if d is not None:
            least[root[f]] = min(least.get(root[f], d), d)
    for r in got:
        assert r["component_id"] == least.get(root[r["fp"] % (1 << 64)])


def test_simhash_buckets_miss_no_link(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base:
        for n in (1, 2, 3, 4):
            x = b
            for i in rng.sample(range(64), n):
                x ^= 1 << i
            fps.add(x)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    for k in (1, 2, 3, 5):
        edges = simhash.fingerprint_links(spark.createDataFrame(signed, "fp long"), k)
        got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
        for a in fps:
            for b in fps:
                if a < b and bin(a ^ b).count("1") <= k:
                    sa, sb = ((v - (1 << 64) if v >> 63 else v) for v in (a, b))
                    assert got[sa] == got[sb]


def test_one_per_component_keeps_columns(make_docs, prose):
    docs = make_docs(prose)
    out = simhash.one_per_component(docs)
    assert out.columns == docs.columns
    found = simhash.simhash_components(docs).collect()
    rows = out.collect()
    assert len(rows) == len({r["component_id"] if r["component_id"] is not None else ("none", r["fp"]) for r in found})


def test_one_per_component_null_and_repeated_ids(make_docs, reach):
    """One row stays of every component, also where ids are null or name rows of several fingerprints."""
    rng = random.Random(6)
    base = [" ".join(f"w{rng.randrange(900)}" for _ in range(400)) for _ in range(3)]
    texts = [" ".join([*b.split()[:-1], f"end{i}"]) for b in base for i in range(12)]
    rows = [(None if n < 12 else 7 if n < 24 else n, t) for n, t in enumerate(texts)] + [(7, texts[12]), (7, base[0][:900]), (None, None), (None, "")]
    fps = [fingerprint(t) for _, t in rows]
    distinct = sorted(set(fps))
    root = reach([(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1:] if bin(a ^ b).count("1") <= 3], distinct)
    assert any(len({f for f in fps[s:s + 12] if root[f] == root[fps[s]]}) > 1 for s in (0, 12))
    best = {}
    for (d, _), f in zip(rows, fps):
        best[root[f]] = min(best.get(root[f], (True, 0)), (d is None, d or 0))
    got = simhash.one_per_component(make_docs(rows)).collect()
    assert sorted((root[fingerprint(r["text"])], (r["doc_id"] is None, r["doc_id"] or 0)) for r in got) == sorted(best.items())


def jaccard(a, b):
    n = lines.SHINGLE
    a, b = ({x[i:i + n] for i in range(max(1, len(x) - n + 1))} for x in (a, b))
    return len(a & b) / len(a | b)


def test_line_decisions(make_docs, prose, reach):
    got = lines.line_decisions(make_docs(prose)).collect()
    first = {}
    for d, t in prose:
        for k, raw in enumerate((t or "").split("\n")):
            x = lines.normal(raw)
            if x:
                key = (d is None, d or 0, k)
                first[x] = min(first.get(x, key), key)
    texts = sorted(first)
    links = [(a, b) for i, a in enumerate(texts) for b in texts[i + 1:] if jaccard(a, b) >= lines.THRESHOLD]
    assert links
    root = reach(links, texts)
    best = {}
    for x in texts:
        best[root[x]] = min(best.get(root[x], first[x]), first[x])
    want = {(d, k): (d is None, d or 0, k) == best[root[lines.normal(raw)]]
            for d, t in prose for k, raw in enumerate((t or "").split("\n")) if lines.normal(raw) and d is not None}
    assert {(r["doc_id"], r["line_no"]): r["kept"] for r in got if r["doc_id"] is not None} == want


def test_bands_find_near_lines():
    """Links at the threshold share a band as often as 20 bands of 6 values promise (99.77 %)."""
    assert lines.PASSES * lines.BINS == lines.BANDS * lines.ROWS
    assert (1 - lines.THRESHOLD ** lines.ROWS) ** lines.BANDS <= 0.0023
    rng = random.Random(11)
    pairs = []
    while len(pairs) < 20000:
        x = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=100))
        y = list(x)
        for i in rng.sample(range(100), 2):
            y[i] = "#"
        if jaccard(x, y := "".join(y)) >= lines.THRESHOLD:
            pairs.append((x, y))
    key = lines.signatures([x for pair in pairs for x in pair])
    missed = int((~(key[::2] == key[1::2]).any(axis=1)).sum())
    assert missed <= 18  # 13 with 20 bands of 6, 24 with 14 bands of 5


def test_near_pairs_exact():
    rng = random.Random(3)
    base = "".join(rng.choice("abcdef é日") for _ in range(80))
    texts = [base] + [base[:i] + rng.choice("xyz") + base[i + rng.randrange(6):] for i in range(0, 70, 4)] + ["ab", "abc", "x"]
    many = texts + [chr(0x3000 + i) * 7 for i in range(9000)]  # alphabet too large for packed shingles
    for t in (texts[:3], texts, many[:40]):
        i, j = lines.near_pairs(lines.shingle_codes(t))
        want = {(a, b) for a in range(len(t)) for b in range(a + 1, len(t)) if jaccard(t[a], t[b]) >= lines.THRESHOLD}
        assert set(zip(i.tolist(), j.tolist())) == want
    assert [len(c) for c in lines.shingle_codes(many)] == [len({x[i:i + 5] for i in range(max(1, len(x) - 4))}) for x in many]


def test_dedup_lines_text(make_docs):
    docs = make_docs([(1, "alpha beta gamma delta\nonly here one"), (2, "Alpha  beta gamma delta"), (3, "new\n\nalpha beta gamma delta"),
                      (4, None), (5, ""), (6, "\n"), (None, "alpha beta gamma delta\nlast of all")])
    out = lines.dedup_lines(docs)
    assert out.columns == docs.columns
    assert sorted(((r["doc_id"] or 99), r["text"]) for r in out.collect() if r["text"] is not None) == [
        (1, "alpha beta gamma delta\nonly here one"), (3, "new\n"), (5, ""), (6, "\n"), (99, "last of all")]


def test_dedup_lines_null_and_repeated_ids(make_docs):
    """Every row without id is a document of its own; a null text beside rows that lose lines is no obstacle."""
    a, b, near = "the same line in many rows", "a second shared line of text", "a second shared line of text!"
    rows = [(1, a), (None, a), (None, None), (None, a), (None, f"{a}\n{b}"), (None, f"own words\n{b}"), (None, f"other things\n{near}"),
            (2, f"{a}\nkept two"), (2, None), (2, f"{a}\nkept three"), (3, b[:9]), (3, b[:9])]
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in lines.dedup_lines(make_docs(rows)).collect())
    kept = [t for d, t in got if not d]
    assert [t for t in got if t[0]] == [(1, a), (2, ""), (2, "kept three"), (2, "kept two"), (3, b[:9]), (3, b[:9])]
    assert "" in kept and not any(a in t for t in kept)
    assert sum(x in (b, near) for t in kept for x in t.split("\n")) == 1
    assert sum("own words" in t for t in kept) == sum("other things" in t for t in kept) == 1
    many = lines.line_decisions(make_docs([(None, a)] * 50)).collect()
    assert len(many) == 50 and sum(r["kept"] for r in many) == 1


def vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((60, 16))
    rows = [(i, base[i].astype("f4").tolist()) for i in range(60)]
    near = [(100 + i, (base[i % 5] + 0.15 * rng.standard_normal(16)).astype("f4").tolist()) for i in range(80)]
    odd = [(300, None), (301, []), (302, [0.0] * 16), (303, [1.0] * 5), (304, [float("nan")] * 16), (305, [float("inf")] + [1.0] * 15),
           (306, [None] + [1.0] * 15), (None, rows[0][1]), (307, rows[1][1]), (308, rows[1][1]), (1, rows[1][1])]
    data = rows + near + odd
    return data, spark.createDataFrame([(a, b, 3, "x") for a, b in data], "vec_id long, embedding array<float>, label int, links string")


def test_embedding_near_duplicates(spark, reach):
    data, df = vectors(spark)
    got = vector_dups.near_duplicates(df).collect()
    assert len(got) == len(data)
    good = [(i, a, np.array(b)) for i, (a, b) in enumerate(data)
            if a is not None and b and len(b) == 16 and None not in b and np.isfinite(b).all() and np.any(b)]
    links = {}
    pairs = []
    for x, (i, _, u) in enumerate(good):
        for j, _, v in good[x + 1:]:
            if u @ v / np.sqrt(u @ u) / np.sqrt(v @ v) >= 0.95:
                links[i] = links.get(i, 0) + 1
                links[j] = links.get(j, 0) + 1
                pairs.append((i, j))
    root = reach(pairs, range(len(data)))
    ids = {}
    for i, (a, _) in enumerate(data):
        if a is not None:
            ids[root[i]] = min(ids.get(root[i], a), a)
    want = sorted((a or -1, links.get(i, 0), ids.get(root[i], -1)) for i, (a, _) in enumerate(data))
    assert sorted((r["vec_id"] or -1, r["n_links"], -1 if r["component_id"] is None else r["component_id"]) for r in got) == \
        [(a, n, c if c != -1 else -1) for a, n, c in want]
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)


def test_upper_bounds_hold():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 64))
    x[200:] = x[:200] + 0.2 * rng.standard_normal((200, 64))
    x /= np.sqrt((x * x).sum(1))[:, None]
    codes = vector_dups.decode(vector_dups.encode(x, vector_dups.rotations(64, 2))[1], 64, 2)[1]
    i, j = np.arange(200), np.arange(200, 400)
    exact = (x[i] * x[j]).sum(1)
    bound = vector_dups.upper_bounds(codes, i, j)
    assert (bound >= exact).all() and (vector_dups.upper_bounds(codes, i, (j + 7) % 200) < 0.95).mean() > 0.9


def test_few_rows_are_recomputed():
    """A bucket's codes name the rows of near pairs and next to no others."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    x = rng.standard_normal((1000, 64))
    x[500] = x[0] * 3
    x /= np.sqrt((x * x).sum(1))[:, None]
    turn = vector_dups.rotations(64, 2)
    code = vector_dups.encode(x, turn)[1]
    assert code.shape[1] == 16 + 2 * 32 + 4 * 4  # against 256 bytes of floats
    n = np.arange(1000)
    cols = {"t": n * 0, "k": n * 0, "a": n * 0, "b": n * 0, "blk": n * 0, "g": n, "code": vector_dups.packed(code)}
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in cols.values()], list(cols))
    got = {g for b in vector_dups._survivors(64, 0.95, 2, 8, 10)([batch]) for g in b.column("g").to_pylist()}
    assert {0, 500} <= got and len(got) < 50


def test_empty_tables(make_docs, spark):
    assert simhash.simhash_components(make_docs([])).count() == 0
    assert lines.line_decisions(make_docs([])).count() == 0
    assert vector_dups.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def similarity(a, b):
    x, y = ({t[i:i + lines.SHINGLE] for i in range(max(1, len(t) - lines.SHINGLE + 1))} for t in (a, b))
    return len(x & y) / len(x | y)


def test_big_buckets(spark, reach, monkeypatch):
    """Near copies of a few lines and lines of no cluster in one bucket: exact components, a linear number of edges."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    texts = []
    for size in (220, 60, 25, 9, 2):
        base = [word() for _ in range(20)]
        for _ in range(size):
            w = list(base)
            w[rng.randrange(20)] = word()
            texts.append(" ".join(w))
    texts += [" ".join(word() for _ in range(20)) for _ in range(20)]
    chain = [word() for _ in range(20)]  # each near the one before, far from the first
    for _ in range(15):
        chain = chain[1:] + [word()]
        texts.append(" ".join(chain))
    rows = [(1, 8, i % 8, 1000 + i, t) for i, t in enumerate(texts)]
    links = [(1000 + i, 1000 + j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if similarity(texts[i], texts[j]) >= 0.8]
    want = reach(links, range(1000, 1000 + len(texts)))
    for pivots in (1, 32):
        monkeypatch.setattr(lines, "PIVOTS", pivots)
        edges = lines._big_links(spark.createDataFrame(rows, "k long, parts int, blk int, line long, x string").repartition(3)).collect()
        got = reach([(r.u, r.v) for r in edges], range(1000, 1000 + len(texts)))
        assert got == want
        assert pivots == 1 or len(edges) < 5 * len(texts)


def test_big_bucket_links_between_classes(spark, reach, monkeypatch):
    """Lines near different pivots link, though no line is near both pivots."""
    from pyspark.sql import functions as F

    rng = random.Random(16)
    ids = spark.range(1000, 1040).orderBy(F.xxhash64("id"), "id").toPandas()["id"].tolist()  # pivots come first
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(2000))
    for starts in ([0, 33, 11, 22], [0, 33, 11, 22, 900, 911, 922, 933, *rng.sample(range(1200, 1800), 30)]):
        texts = {ids[n]: long[s:s + 104] for n, s in enumerate(starts)}  # a shift by 11 has similarity 89 / 111
        rows = [(1, 3, n % 3, i, t) for n, (i, t) in enumerate(texts.items())]
        links = [(i, j) for i in texts for j in texts if i < j and similarity(texts[i], texts[j]) >= 0.8]
        big = spark.createDataFrame(rows, "k long, parts int, blk int, line long, x string").repartition(3)
        for pivots in (2, 5):
            monkeypatch.setattr(lines, "PIVOTS", pivots)
            assert reach([(r.u, r.v) for r in lines._big_links(big).collect()], texts) == reach(links, texts)


def test_edges_of_near_copies_are_linear(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    base, counts = [word() for _ in range(24)], []
    for n in (1000, 2000):
        texts = []
        for _ in range(n):
            w = list(base)
            w[rng.randrange(24)] = word()
            texts.append(" ".join(w))
        rows = [(1, -(-n // lines.BLOCK), i % -(-n // lines.BLOCK), i, t) for i, t in enumerate(texts)]
        big = spark.createDataFrame(rows, "k long, parts int, blk int, line long, x string").repartition(4)
        counts.append(lines._big_links(big).count())
    assert counts[1] < 2.3 * counts[0]


def test_very_long_lines():
    rng = random.Random(14)
    long = "".join(rng.choice("abcdefgh ") for _ in range(400_000))
    near = long[:200_000] + "x" * 50 + long[200_050:]
    texts = ["one", long, near, "two", long[:5], "some other line"]
    sig = lines.signatures(texts)
    alone = np.concatenate([lines.signatures([t]) for t in texts])
    assert (sig == alone).all()
    assert (sig[1] == sig[2]).any()
    i, j = lines.near_pairs(lines.shingle_codes(texts * 2))
    whole = set(zip(i.tolist(), j.tolist()))
    assert {(1, 2), (1, 7), (1, 8), (0, 6)} <= whole and (0, 1) not in whole


def test_slabs_of_shingles(monkeypatch):
    rng = random.Random(15)
    texts = ["".join(rng.choice("ab") for _ in range(30)) for _ in range(60)] + ["abc" * 50] * 3
    want = [x.tolist() for x in lines.near_pairs(lines.shingle_codes(texts))]
    monkeypatch.setattr(lines, "CELLS", 100)
    assert [x.tolist() for x in lines.near_pairs(lines.shingle_codes(texts))] == want
    i, j = lines.near_pairs(lines.shingle_codes(texts), 7)
    assert [(a, b) for a, b in zip(i, j)] == [(a, b) for a, b in zip(*want) if a < 7]


def test_line_signing_and_links_work_in_bounded_lots():
    """Many short lines are signed a lot at a time, and buckets of any size give the links of a plain check."""
    short = [f"{k:x}" for k in range(16, 16 + 3 * lines.SIGNED)]
    got = list(lines._bands([pa.RecordBatch.from_pydict({"text": ["\n".join(short)]})]))
    assert max(b.num_rows for b in got) <= lines.SIGNED * lines.BANDS
    assert sum(b.num_rows for b in got) == len(short) * lines.BANDS
    assert np.array_equal(got[1].column("k").to_numpy().reshape(-1, lines.BANDS)[:9],
                          lines.signatures(short[lines.SIGNED:lines.SIGNED + 9]).view(np.int64))
    rng, rows, want = np.random.default_rng(3), [], set()
    for bucket in range(60):
        base = rng.integers(97, 105, 60)
        texts = {"".join(map(chr, np.where(rng.random(60) < 0.03, 122, base))) for _ in range([2, 3, 8, 9, 30][bucket % 5])}
        texts |= {"é", "\U0001f600" * 3 + str(bucket)}
        rows += sorted((bucket, lines.line_id(x), x) for x in texts)
        sets = {lines.line_id(x): {x[k:k + 5] for k in range(max(1, len(x) - 4))} for x in texts}
        root = {x: x for x in sets}
        for a, s in sets.items():
            for b, t in sets.items():
                if len(s & t) / len(s | t) >= lines.THRESHOLD and root[a] != root[b]:
                    old, new = root[a], root[b]
                    root = {x: new if r == old else r for x, r in root.items()}
        want |= {frozenset((bucket, x) for x in root if root[x] == r) for r in set(root.values())}
    k, line, x = zip(*rows)
    batch = pa.RecordBatch.from_pydict({"k": list(k), "line": list(line), "x": list(x)})
    root = {(b, v): (b, v) for b, v, _ in rows}
    own = {v: (b, v) for b, v, x in rows if x != "é"}
    for out in lines._links([batch.slice(0, 100), batch.slice(100)]):
        for u, v in zip(out.column("u").to_pylist(), out.column("v").to_pylist()):
            old, new = root[own[u]], root[own[v]]
            root = {y: new if r == old else r for y, r in root.items()}
    assert {frozenset(y for y in root if root[y] == r) for r in set(root.values())} == want


def test_bucket_members_from_rows_sorted_by_key_alone():
    k = np.array([1, 1, 2, 2, 2, 3, 3, 3, 3, 4], np.int64)
    x = np.array([5, 5, 9, 7, 9, 8, 6, 8, 6, 1], np.int64)
    for cut in range(11):
        parts = [pa.RecordBatch.from_pydict({"k": k[a:b], "line": x[a:b]}) for a, b in ((0, cut), (cut, 10))]
        got = [(a, b) for out in lines._shared(parts) for a, b in zip(out.column("k").to_pylist(), out.column("line").to_pylist())]
        assert set(got) == {(2, 9), (2, 7), (3, 8), (3, 6)}
