"""Mixing, packing, classifier, language model, URL filter, surrogates and search on small fixtures."""

import re
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lexaria.llm import ann, hmm, mixing, packing, quality, surrogates, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def size(text):
    return len(WORD.findall(text or ""))


# ---- mixing -------------------------------------------------------------------------------------

def water_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        level = (total - sum(fixed.values())) / max(1e-12, sum(w[s] for s in free)) if free else 0
        over = [s for s in free if w[s] * level > cap * sizes[s]]
        if not over:
            return {**{s: w[s] * level for s in free}, **fixed}
        fixed |= {s: cap * sizes[s] for s in over}


def mix_rows():
    rows = [(i, "w " * (1 + i * 7 % 40), f"s{i % 4}") for i in range(400)]
    return rows + [(900, None, "s1"), (901, "", None), (902, "a b c", None), (902, "a b c", None), (None, "x y", "s2"), (903, "", "zero"),
                   (904, "w " * 5000, "s0"), (905, "\u00a0 \u2003 x", "s3")]


def test_mix_targets_and_copies(make_docs):
    rows = mix_rows()
    docs = make_docs(rows)
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (str(r["doc_id"]), r["text"] or "", r["source"] or "", r["mix"]["copies"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    want = water_targets(sizes)
    taken, largest = Counter(), Counter()
    for r in got:
        m = r["mix"]
        assert m["size"] == size(r["text"]) and m["source_size"] == sizes[r["source"]] and 0 <= m["copies"] <= 3
        assert m["target"] == pytest.approx(want[r["source"]])
        assert m["copies"] in (math.floor(m["target"] / max(1, m["source_size"])), math.floor(m["target"] / max(1, m["source_size"])) + 1)
        taken[r["source"]] += m["copies"] * m["size"]
    for s in sizes:
        assert taken[s] <= want[s] + 1e-6
    assert sum(taken.values()) > 0.97 * sum(want.values())
    assert len({r["mix"]["copies"] for r in got if r["doc_id"] == 902}) == 1


def test_mixed_documents(make_docs):
    docs = make_docs(mix_rows())
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r["mix"]["copies"] for r in mixing.mix(docs).collect())
    assert mixing.mixed_documents(make_docs([])).count() == 0


def test_pareto_sample_prefers_likely(make_docs):
    """Over many seeds a document is taken about as often as its inclusion probability says."""
    docs = make_docs([(i, "w " * (15 if i % 2 else 63), "a") for i in range(200)] + [(999, "w " * 20000, "b")])
    taken = Counter()
    for seed in range(4):
        for r in mixing.mix_digest(docs, seed=seed, weights=(1, 9)).collect():
            if r["doc_id"] != 999:
                taken[r["size"]] += r["copies"]
    # the bit length of the size is the weight: 6 against 4
    assert 1.2 < taken[63] / taken[15] < 1.9


# ---- packing ------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


def test_encoder_matches_library(tokenizer):
    path, lib = tokenizer
    rng = np.random.default_rng(0)
    parts = ["a", "Bc", " ", "  ", "\n", "\t", "\xa0", "é", "1", "22", "!", "'s", "'ll", "<|endoftext|>", "日本", "\x1c", "\u2003", "_", ".", "🙂"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 25))) for _ in range(3000)] + ["", "x" * 5000]
    with open(path, encoding="utf-8") as f:
        enc = packing.Encoder(f.read(), public_tokenizers.PATTERN)
    for t, got in zip(texts, enc.encode(texts)):
        assert np.frombuffer(got, "<u4")[:-1].tolist() == lib.encode(t, add_special_tokens=False).ids, t


def test_plan_is_valid_and_tight():
    rng = np.random.default_rng(1)
    for cap in (10, 64, 2048):
        for _ in range(40):
            h = Counter(int(max(1, cap * rng.random() ** rng.choice([1, 3]))) for _ in range(rng.integers(1, 200)))
            places, n = packing.plan(h, cap)
            seen, bins = Counter(), {}
            for x, lo, hi, first, offset in places:
                assert lo == seen[x]
                seen[x] = hi
                for k in range(hi - lo):
                    bins.setdefault(first + k, []).append((offset, x))
            assert seen == h and len(bins) == n
            for b in bins.values():
                at = 0
                for offset, x in sorted(b):
                    assert offset == at
                    at += x
                assert at <= cap
                assert sum(3 * x > cap for _, x in b) <= 2
            free = sorted((x for x, c in h.items() for _ in range(c)), reverse=True)
            rooms = []  # plain best-fit decreasing
            for x in free:
                fit = [r for r in rooms if r >= x]
                if fit:
                    rooms.remove(min(fit))
                rooms.append((min(fit) if fit else cap) - x)
            assert n <= len(rooms) + 1


def test_pack(make_docs, tokenizer):
    path, lib = tokenizer
    rng = np.random.default_rng(2)
    words = ["the", "thorough", "of", "zxqv", "été", "3.14", "\n"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 60)))) for i in range(60)]
    rows += [(70, None), (71, ""), (72, " ".join(rng.choice(words, 900))), (5, rows[5][1]), (None, "no id"), (73, "<|endoftext|> x")]
    docs = make_docs(rows)
    got = packing.pack(docs, path, public_tokenizers.PATTERN, capacity=64, with_ids=True).collect()
    ids = Counter()
    for d, t in rows:
        full = lib.encode(t or "", add_special_tokens=False).ids + [0]
        n = len(full)
        first = n if n <= 64 else n % 64 or 64
        for k, (a, b) in enumerate(zip([0, *range(first, n, 64)], range(first, n + 1, 64))):
            ids[(d, k, a, b - a, zlib.crc32(np.array(full[a:b], "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == ids
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in by.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 64
    assert len(by) <= math.ceil(sum(r["length"] for r in got) / 64) + 2
    seq = packing.sequences(packing.pack(docs, path, public_tokenizers.PATTERN, capacity=64, with_ids=True))
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in seq.collect())
    assert packing.pack(make_docs([]), path, public_tokenizers.PATTERN).count() == 0


# ---- classifier ---------------------------------------------------------------------------------

def test_quality(spark, make_docs):
    rng = np.random.default_rng(3)
    good = ["kalo mira tuvel", "sona rekti molo", "vela tumi kara"]
    rows = [(i, " ".join(rng.choice(good, 30)) if i % 4 else " | ".join(["BUY!!"] * 30)) for i in range(400)]
    odd = [(900, None), (901, ""), (902, "ab"), (None, "kalo mira"), (5, rows[5][1])]
    docs = make_docs(rows + odd)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(400)] + [(None, 1, 0), (3, None, 0), (7, 1, 0), (7, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    out = quality.classify(docs, labels)
    assert out.columns == [*docs.columns, "quality"]
    got = out.collect()
    assert len(got) == len(rows) + len(odd)
    for r in got:
        q = r["quality"]
        assert 0 <= q["score"] <= 1 and q["predicted"] == int(q["score"] >= 0.3)
        assert q["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if r["doc_id"] is not None and r["doc_id"] < 400:
            assert q["predicted"] == int(r["doc_id"] % 4 > 0)
    assert quality.classify(make_docs([]), labels).count() == 0
    none = quality.classify(docs, labels.where("false")).collect()
    assert {r["quality"]["score"] for r in none} == {0.5}


def test_quality_counts_whole_texts():
    texts = ["", "a", "ab", "abc", "abcabc", "é日本", None, "x" * 50]
    got = quality.counts(texts)
    for t, row in zip(texts, got):
        raw = (t or "").encode()
        assert row.sum() == max(0, len(raw) - 2)
    alone = np.concatenate([quality.counts([t]) for t in texts])
    assert (alone == got).all()


# ---- language model -----------------------------------------------------------------------------

def brute_forward(m, seq):
    a, total = m.first * m.emit[seq[0]], 0.0
    for o in seq[1:]:
        c = a.sum()
        total += math.log(c)
        a = (a / c) @ m.move * m.emit[o]
    return total + math.log(a.sum())


def random_model(states=3, seed=0):
    rng = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    return hmm.Hmm(norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((hmm.CLASSES, states)), 0))


def test_forward_is_exact(monkeypatch):
    monkeypatch.setattr(hmm, "LONG", 64)
    m, rng = random_model(), np.random.default_rng(1)
    seqs = [rng.integers(0, 50, n).astype(np.uint16) for n in (1, 2, 17, 64, 65, 300, 9000)]
    assert hmm.log_likelihood(m, seqs) == pytest.approx([brute_forward(m, s) for s in seqs], rel=1e-9)


def test_expected_counts():
    """Posterior counts by enumeration of all state paths."""
    import itertools

    m, seq = random_model(2), np.array([3, 1, 3, 2], np.uint16)
    out = hmm.Expected(2)
    hmm._expect_all(m, [seq[:2], seq], out)
    first, move, emit, log = np.zeros(2), np.zeros((2, 2)), np.zeros((hmm.CLASSES, 2)), 0.0
    for s in (seq, seq[:2]):
        paths = list(itertools.product(range(2), repeat=len(s)))
        p = np.array([m.first[z[0]] * np.prod([m.move[a, b] for a, b in zip(z, z[1:])]) * np.prod([m.emit[o, k] for o, k in zip(s, z)]) for z in paths])
        log += math.log(p.sum())
        for z, w in zip(paths, p / p.sum()):
            first[z[0]] += w
            for a, b in zip(z, z[1:]):
                move[a, b] += w
            for o, k in zip(s, z):
                emit[o, k] += w
    for a, b in ((first, out.first), (move, out.move), (emit, out.emit), (log, out.log)):
        assert a == pytest.approx(b)


def brute_counts(m, seq):
    """Forward-backward over one whole text, token by token."""
    n, s = len(seq), len(m.first)
    alpha, beta = np.zeros((n, s)), np.ones((n, s))
    for t in range(n):
        alpha[t] = (m.first if t == 0 else alpha[t - 1] @ m.move) * m.emit[seq[t]]
        alpha[t] /= alpha[t].sum()
    for t in range(n - 2, -1, -1):
        beta[t] = m.move @ (m.emit[seq[t + 1]] * beta[t + 1])
        beta[t] /= beta[t].sum()
    gamma = alpha * beta
    gamma /= gamma.sum(1, keepdims=True)
    move, emit = np.zeros((s, s)), np.zeros((hmm.CLASSES, s))
    for t in range(n):
        emit[seq[t]] += gamma[t]
        if t + 1 < n:
            x = alpha[t][:, None] * m.move * (m.emit[seq[t + 1]] * beta[t + 1])
            move += x / x.sum()
    return gamma[0], move, emit


@pytest.mark.parametrize("long,part,at_once", [(8_192, 256, 512), (64, 16, 2), (64, 16, 512), (1, 1, 3)])
def test_expected_counts_of_whole_texts(monkeypatch, long, part, at_once):
    """Counts do not depend on where texts are cut, nor on how many parts are worked at once."""
    for name, value in (("LONG", long), ("PART", part), ("PARTS_AT_ONCE", at_once)):
        monkeypatch.setattr(hmm, name, value)
    m, rng = random_model(3), np.random.default_rng(4)
    seqs = [rng.integers(0, 40, n).astype(np.uint16) for n in (1000, 1, 64, 65, 2, 333, 64)]
    out = hmm.Expected(3)
    hmm._expect_all(m, seqs, out)
    want = [brute_counts(m, q) for q in seqs]
    for got, parts in zip((out.first, out.move, out.emit), zip(*want)):
        assert got == pytest.approx(sum(parts), rel=1e-9, abs=1e-12)
    assert out.log == pytest.approx(sum(brute_forward(m, q) for q in seqs), rel=1e-12)
    assert out.emit.sum() == pytest.approx(sum(map(len, seqs)))


def test_language_model(make_docs):
    rng = np.random.default_rng(5)
    langs = [["ka", "lo", "mi", "Re"], ["zu", "xe", "wo", "va"]]
    rows = [(i, " ".join(rng.choice(langs[i % 2], 40))) for i in range(200)]
    rows += [(900, None), (901, ""), (902, "never seen words"), (None, "ka lo"), (5, rows[5][1])]
    got = hmm.score(make_docs(rows), states=2).collect()
    assert len(got) == len(rows)
    tok = lambda t: [*(t or "").encode().lower().split(), None]
    fold = lambda d: d is None or zlib.crc32(str(d).encode()) % 10 == 0
    c = Counter(w for d, t in rows if not fold(d) for w in tok(t))
    n, v = sum(c.values()), len(c)
    want = sorted((d or -1, fold(d), len(tok(t)), sum(c[w] > 0 for w in tok(t)),
                   round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tok(t)), 6)) for d, t in rows)
    assert sorted((r["doc_id"] or -1, r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n}
    held = [r for r in got if r["held_out"] and r["n_tokens"] > 10]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 5 * len(held)
    assert hmm.score(make_docs([])).count() == 0


def test_model_is_a_distribution(make_docs):
    """Probabilities of all one-word texts plus the rest's share stay below one."""
    rows = [(i, "aa bb cc") for i in range(1, 40)]
    got = {r["doc_id"]: r["score"] for r in hmm.score(make_docs(rows + [(1000, "aa"), (1001, "bb"), (1002, "qq"), (1003, "")]), states=2).collect()}
    assert sum(10 ** got[d] for d in (1000, 1001, 1002, 1003)) < 1


# ---- URL filter ---------------------------------------------------------------------------------

def test_url_rules_and_list(spark):
    pages = [(1, "HTTP://www.A.Example.NET/en/x?y#z"), (2, "https://b.net"), (3, "https://b.net/"), (4, "x://shop.example.com/de/1"),
             (5, "x://fr.org/fr/1"), (6, "x://m.bad.example.com/q.html"), (7, "x://bad.example.com/q/?a=1"), (8, "x://notnet/"), (9, None),
             (10, "no scheme"), (11, "x://bad.example.com/other"), (11, "x://bad.example.com/other"), (12, "x://www.bad.example.com:80/q"),
             (13, "x://user@bad.example.com/q#f"), (14, "a://b://net/"), (15, "x://Ünet/"), (16, "x://h\nost/p\nq")]
    df = spark.createDataFrame([(a, b, "x", "y") for a, b in pages], "page_id long, url string, host string, block string")
    listed = spark.createDataFrame([("http://bad.example.com/q",), (None,), ("junk",)], "url string")
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df, listed, rules).collect())
    assert got == [
        (1, "www.a.example.net", "/en/x", "example.net/en/", "allow"), (2, "b.net", "", None, "allow"), (3, "b.net", "/", "net/", "block"),
        (4, "shop.example.com", "/de/1", "example.com/de/", "block"), (5, "fr.org", "/fr/1", "org/fr/", "allow"),
        (6, "m.bad.example.com", "/q.html", None, "block"), (7, "bad.example.com", "/q/", None, "block"), (8, "notnet", "/", None, "allow"),
        (9, "", "", None, "allow"), (10, "", "", None, "allow"), (11, "bad.example.com", "/other", None, "allow"),
        (11, "bad.example.com", "/other", None, "allow"), (12, "www.bad.example.com:80", "/q", None, "block"),
        (13, "user@bad.example.com", "/q", None, "block"), (14, "b:", "//net/", None, "allow"), (15, "Ünet", "/", None, "allow"),
        (16, "h\nost", "/p\nq", None, "allow")]
    assert urls.judge(df.where("false"), listed, rules).count() == 0
    assert urls.judge(df, listed.where("false"), rules).where("listed").count() == 0


def test_bloom_has_no_false_negative_and_join_removes_false_positives(spark, monkeypatch):
    monkeypatch.setattr(urls, "MAX_BLOCKS", 2)  # a saturated filter passes nearly everything
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.concat(F.lit("x://h/"), F.col("id").cast("string")).alias("url"))
    got = urls.judge(pages, pages.where("page_id % 3 = 0").select("url"), [])
    assert {r["page_id"] for r in got.where("verdict = 'block'").collect()} == set(range(0, 400, 3))


# ---- surrogates ---------------------------------------------------------------------------------

def test_surrogates(make_docs):
    rows = [
        (1, "Mail Foo.Bar@Mail.example.com or FOO.BAR@MAIL.EXAMPLE.COM, call +1 (017) 555-7713."),
        (2, "Card 4111 1111 1111 1111 and 4111111111111111; host 10.20.30.40, id 123-45-6789"),
        (3, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x'), (4, "Mr. John Smith met Mrs. Mary Smith-Jones. Mr. Smith left."),
        (5, "г-н Иванов и г-жа Петрова"), (6, "nothing here, version 1.2.3"), (7, None), (8, ""), (None, "foo.bar@mail.example.com"),
        (9, "foo.bar@mail.example.com"), (9, "foo.bar@mail.example.com"), (10, "a@b.co c@b.co"), (11, "Κυρία Παππά, Dr. HOUSE"),
        (12, "DE89 3704 0044 0532 0130 00 is an IBAN"),
    ]
    docs = make_docs(rows)
    out = surrogates.replace_entities(docs, "key")
    assert out.columns == [*docs.columns, "entity_types"]
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append(r)
    one = lambda i: got[i][0]["text"]
    assert got[7][0]["text"] is None and one(8) == "" and one(6) == rows[5][1] and got[6][0]["entity_types"] == []
    a, b = re.findall(r"\S+@[\w.]+\w", one(1))
    assert a.lower() == b.lower() and a != "Foo.Bar@Mail.example.com" and re.fullmatch(r"[A-Z][a-z]{2}\.[A-Z][a-z]{2}@[A-Z][a-z]{3}\.[a-z]{7}\.com", a)
    assert b == b.upper() and one(9) == a.lower() == one(None) and got[9][0]["text"] == got[9][1]["text"] and len(got[9]) == 2
    assert re.search(r"call \+1 \(\d{3}\) \d{3}-\d{4}\.$", one(1)) and "555-7713" not in one(1)
    c1, c2 = re.search(r"Card ([\d ]{19}) and (\d{16});", one(2)).groups()
    assert c1.replace(" ", "") == c2 != "4111111111111111"
    assert sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(c2)) % 10 == 0
    ip = re.search(r"host ([\d.]+),", one(2))[1]
    assert ip != "10.20.30.40" and all(0 <= int(x) <= 255 for x in ip.split(".")) and len(ip.split(".")) == 4
    assert re.fullmatch(r'token = "[0-9a-f]{40}" x', one(3)) and "04dbebab" not in one(3)
    m = re.fullmatch(r"Mr\. (\S+) (\S+) met Mrs\. (\S+) (\S+)\. Mr\. (\S+) left\.", one(4))
    assert m and m[2] == m[5] and m[1] in surrogates.GIVEN["latin"]["m"] and m[3].split("-")[0] in surrogates.GIVEN["latin"]["f"]
    assert re.fullmatch(r"г-н [А-Я][а-я]+ и г-жа [А-Я][а-я]+а", one(5)) and "Иванов" not in one(5)
    assert len(set(one(10).split())) == 2 and re.fullmatch(r"[a-z]@[a-z]\.co [a-z]@[a-z]\.co", one(10))
    assert re.fullmatch(r"Κυρία [\u0370-\u03ff]+, Dr\. [A-Z]+", one(11))
    assert re.match(r"DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d is", one(12)) and "3704" not in one(12)[:12]
    assert surrogates.replace_entities(make_docs([]), "key").count() == 0


def test_surrogates_whole_names(make_docs):
    """No word of a name is left, whatever its form, and titles of one person agree."""
    rows = [(1, "Mr. John Michael Smith left."), (2, "Ms. Anna-Maria Schmidt and Mrs. Mary Smith-Jones met."), (3, "Mr. McDonald saw Dr. O'Brien's car."),
            (4, "Mr. J. Smith, Dr. Smith, Mr. J.R. Smith and Mr. Smith."), (5, "Dr. John Smith and Prof. Dr. Schmidt"), (6, "Mr. Ludwig van Beethoven Jr. came"),
            (7, "Ms. Kim Lee-O’Hara-MACDONALD"), (8, "г-н Иванов, г-жа Иванова"), (9, "Mr. Smith Mrs. Mary Jones"), (10, "Herr Dr. Jean-Paul DeVito.")]
    got = {r["doc_id"]: r["text"] for r in surrogates.replace_entities(make_docs(rows), "key").collect()}
    for word in ("John Michael Smith Anna Maria Schmidt Mary Jones McDonald O'Brien Brien Ludwig Beethoven Kim Lee Hara MACDONALD "
                 "Иванов Jean Paul DeVito").split():
        assert not any(re.search(rf"(?<!\w){word}(?!\w)", t) for t in got.values()), word
    given, family = re.fullmatch(r"Mr\. (\w+) \w+ (\w+) left\.", got[1]).groups()
    assert given in surrogates.GIVEN["latin"]["m"]
    schmidt = re.fullmatch(rf"Ms\. \w+-\w+ (\w+) and Mrs\. \w+ {family}-\w+ met\.", got[2])[1]
    assert re.fullmatch(r"Mr\. \w+ saw Dr\. \w+'s car\.", got[3])
    assert re.fullmatch(rf"Mr\. [A-IK-Z]\. {family}, Dr\. {family}, Mr\. [A-IK-Z]\.[A-QS-Z]\. {family} and Mr\. {family}\.", got[4])
    assert got[5] == f"Dr. {given} {family} and Prof. Dr. {schmidt}"
    assert re.fullmatch(r"Mr\. \w+ van \w+ Jr\. came", got[6]) and re.fullmatch(r"Ms\. \w+ \w+-\w+-[A-Z]+", got[7])
    assert re.fullmatch(r"г-н (\w+), г-жа \1а", got[8]) and re.fullmatch(rf"Mr\. {family} Mrs\. \w+ \w+", got[9])
    assert re.fullmatch(r"Herr Dr\. \w+-\w+ \w+\.", got[10])


def test_surrogates_stay_distinct(spark):
    """Far more names than the lists hold: collisions are redrawn until all differ."""
    names = [(f"n{i}",) for i in range(300)]
    table = spark.createDataFrame(names, "canon string").select(F.lit("family/m/latin").alias("type"), "canon")
    got = surrogates.registry(table, "key").collect()
    assert len({r["surrogate"].lower() for r in got}) == len(got) == 300


# ---- search -------------------------------------------------------------------------------------

def test_search_recall_and_order(spark):
    rng = np.random.default_rng(7)
    centre = rng.standard_normal((20, 16))
    x = (centre[rng.integers(0, 20, 1500)] + 0.4 * rng.standard_normal((1500, 16))).astype("f4")
    x[1400:] = x[0]  # copies: ties
    odd = [(5000, None), (5020, [0.0] * 16), (5040, [1.0]), (5060, [float("nan")] * 16), (None, x[1].tolist()), (5080, [None] * 16)]
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)] + [(a, b, 1) for a, b in odd], "vec_id long, embedding array<float>, r int")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, k=20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    y = x.astype(np.float64)
    hit = 0
    assert set(got) == set(range(0, 1500, 20))
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21))
        s = y @ y[q]
        s[q] = -np.inf
        assert [(-sc, v) for _, v, sc in rows] == sorted((-sc, v) for _, v, sc in rows)
        assert np.allclose([sc for *_, sc in rows], s[[v for _, v, _ in rows]], atol=1e-12, rtol=0)
        hit += len({v for _, v, _ in rows} & set(np.lexsort((np.arange(1500), -s))[:20].tolist()))
    assert hit / (20 * len(got)) >= 0.9
    few = {}
    for r in ann.search(df.where("vec_id < 6"), F.col("vec_id") == 0, k=20).collect():
        few[r["rank"]] = r["vec_id"]
    assert len(few) == 5
    assert ann.search(df.where("false"), F.col("vec_id") == 0).count() == 0


def test_walk_takes_pairs_in_order():
    rng = np.random.default_rng(8)
    left, right = rng.standard_normal((6, 4)), rng.standard_normal((5, 4))
    count = rng.integers(0, 9, (6, 5)).astype(float)
    q = rng.standard_normal(8)
    got = ann.walk(q, left, right, count, (np.full(6, 0.1), np.full(5, 0.1)), k=3, miss=0.0)
    d = ((left - q[:4]) ** 2).sum(1)[:, None] + ((right - q[4:]) ** 2).sum(1)[None, :]
    order = [d[p] for p in got]
    assert order == sorted(order) and all(count[p] > 0 for p in got)


def test_surrogates_of_long_runs_and_initials(make_docs):
    import string

    run = " ".join(["Anna", "Berta-Carla", "J.", "O'Brien"] * 5000)
    people = [f"Mr. {c}. Smith" for c in string.ascii_uppercase]
    rows = [(1, f"Dr. {run} left."), (2, "; ".join(people)), (3, "Mr. John Smith met Mr. J. Smith and Ms. Jane Smith."),
            (4, "x@" + "a." * 3000 + "com and Mr. " + "van " * 5000 + "Dam"), (5, "Mr. John Michael Adams3 and Mr. Anna-Maria7 end"),
            (6, "Mr. " + "A-" * 3000 + "B"), (7, "Mr. " + "D'A" * 3000)]
    got = {r.doc_id: r.text for r in surrogates.replace_entities(make_docs(rows), secret="k").collect()}
    words = got[1].removeprefix("Dr. ").removesuffix(" left.").split(" ")
    assert len(words) == 20000 and words[0] == words[4] and words[0] != "Anna" and words[2][1] == "." and words[2] != "J."
    assert words[1].count("-") == 1 and words[1] != "Berta-Carla"
    told = got[2].split("; ")
    assert len(set(told)) == 26 and not set(told) & set(people) and len({t.split(" ")[2] for t in told}) == 1
    assert {t.split(" ")[1] for t in told} == {f"{c}." for c in string.ascii_uppercase}
    john, j, jane = re.findall(r"M[rs]s?\. (\S+) (\S+?)(?=[ .])", got[3])
    assert j[0][0] != "J" and john[0] != jane[0] and john[1] == j[1] == jane[1] != "Smith"
    assert "Dam" not in got[4] and "Adams3" in got[5] and "John" not in got[5] and "Michael" not in got[5]


def test_first_letters_form_one_cycle():
    for script, table in surrogates.letters("some key").items():
        at, seen = next(iter(table)), []
        while at not in seen:
            seen.append(at)
            at = table[at]
        assert sorted(seen) == sorted(surrogates.ALPHABET[script])
