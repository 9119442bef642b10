"""I/O round trips and error contracts, samplers, early stopping, losses, senses."""

import math
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexaria.operators import losses as L
from lexaria.operators import sampling as S
from lexaria.operators import senses as SN
from lexaria.session import stage_path
from lexaria.sinks import vectors as SK
from lexaria.sources import corpus as C
from lexaria.sources import vectors as SV

VECS = [("alpha", [0.1, -0.25, 0.5]), ("beta", [1.0, 2.0, -3.0]), ("gamma", [0.0, 0.0, 0.125])]


def _path(spark, name):
    return stage_path(spark, f"test-{name}-{uuid.uuid4().hex[:8]}")


def _vecs(spark):
    return spark.createDataFrame(VECS, "word string, vec array<double>")


def _as_dict(df):
    return {r.word: list(r.vec) for r in df.collect()}


def test_word2vec_text_roundtrip_and_header(spark):
    p = SK.write_word2vec_text(_vecs(spark), _path(spark, "w2v"))
    assert spark.read.text(p + "/part-00000*").first().value == "3 3"
    back = _as_dict(SV.read_word2vec_text(spark, p))
    for w, v in VECS:
        assert np.allclose(back[w], v, atol=1e-6)


def test_glove_binary_columnar_roundtrips(spark):
    for writer, reader in [(SK.write_glove_text, SV.read_glove_text),
                           (lambda df, p: SK.write_word2vec_binary(df, p, shards=2), SV.read_word2vec_binary),
                           (SK.write_columnar, lambda s, p: s.read.parquet(p))]:
        p = writer(_vecs(spark), _path(spark, "fmt"))
        back = _as_dict(reader(spark, p))
        assert set(back) == {w for w, _ in VECS}
        for w, v in VECS:
            assert np.allclose(back[w], v, atol=1e-6)


def test_binary_shards_are_self_contained(spark):
    p = SK.write_word2vec_binary(_vecs(spark), _path(spark, "shards"), shards=3)
    files = spark.read.format("binaryFile").load(p).collect()
    total = 0
    for f in files:
        header = bytes(f.content).split(b"\n", 1)[0].split()
        assert int(header[1]) == 3
        total += int(header[0])
    assert total == 3


def test_lenient_reader(spark):
    p = _path(spark, "len")
    spark.createDataFrame([("2 3",), ("one 1.0 2.0 3.0",), ("skip 5",), ("two 4 5 6  ",)], "value string").coalesce(
        1).write.text(p)
    back = _as_dict(SV.read_lenient(spark, p))
    assert set(back) == {"one", "two"}
    empty = _path(spark, "empty")
    spark.createDataFrame([("3 3",)], "value string").write.text(empty)
    with pytest.raises(ValueError):
        SV.read_lenient(spark, empty)
    ragged = _path(spark, "ragged")
    spark.createDataFrame([("a 1 2 3",), ("b 1 2 3 4",)], "value string").coalesce(1).write.text(ragged)
    with pytest.raises(ValueError):
        SV.read_lenient(spark, ragged, historical=True)


def test_export_unknown_format(spark):
    with pytest.raises(ValueError):
        SK.export_embeddings(_vecs(spark), _path(spark, "x"), "v", ["xml"])


def test_feature_batches(spark):
    rows = [(i, f"text {i}", [float(i), 1.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "row_no long, text string, vec array<double>")
    p = SK.write_feature_batches(df, _path(spark, "feat"), 10)
    back = SV.read_features(spark, p).collect()
    assert len(back) == 30 and sorted({r.batch_id for r in back}) == [0, 1, 2]
    assert [r.row_no for r in back] == list(range(30))


def test_resume_drops_last_line(spark):
    p = _path(spark, "counts")
    spark.createDataFrame([("a 3",), ("b 4",), ("c 1",)], "value string").coalesce(1).write.text(p)
    assert sorted(r.word for r in SV.resume_words(SV.read_count_lines(spark, p)).collect()) == ["a", "b"]


def test_stage_resume(spark):
    p = _path(spark, "stage")
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)

    assert SK.run_stage(spark, p, build).count() == 5
    assert SK.run_stage(spark, p, build).count() == 5
    assert len(calls) == 1


def test_corpus_errors_and_caps(spark):
    docs = spark.createDataFrame([(1, "Ein langer Satz hier. Noch ein langer Satz.", "de")],
                                 "doc_id long, text string, lang string")
    assert C.monolingual_corpus(docs, "de", max_sentences=1).count() == 1
    with pytest.raises(ValueError):
        C.monolingual_corpus(docs, "xx")
    left = spark.createDataFrame([(0, "a"), (1, "b")], "line_no long, line string")
    right = spark.createDataFrame([(0, "x")], "line_no long, line string")
    with pytest.raises(ValueError):
        C.zip_aligned(left, right)
    pages = spark.createDataFrame([(0, "  short  "), (1, "x" * 3000)], "page_id long, text string")
    w = C.web_texts(pages).collect()
    assert len(w) == 1 and len(w[0].text) == 3000  # whole unless a cut is asked for
    assert len(C.web_texts(pages, max_chars=2000).first().text) == 2000


def _word2sent(spark):
    rows = []
    for w in ("hello", "world", "test"):
        for k in range(5):
            rows.append((w, k + 1, "hello world" if k == 0 else f"{w} sentence {k}"))
    return spark.createDataFrame(rows, "word string, rn long, sentence string")


def test_training_split(spark):
    sp = S.training_split(_word2sent(spark), 3, 0.8, 42)
    tr = sp.where(F.col("split") == "train")
    va = sp.where(F.col("split") == "val")
    assert tr.count() > va.count() > 0
    assert S.overlap(tr, va).count() == 0


def test_contrastive_pairs(spark):
    pairs = S.contrastive_pairs(_word2sent(spark), 50, 42).collect()
    assert len(pairs) == 50 and all(p.s1 is not None and p.s2 is not None for p in pairs)
    single = spark.createDataFrame([("w", 1, "only one")], "word string, rn long, sentence string")
    assert S.contrastive_pairs(single, 10).count() == 0


def test_epoch_batches_keep_tail_of_two(spark):
    items = spark.range(0, 258).select(F.col("id").cast("string").alias("k"))
    b = S.epoch_batches(items, "k", 128)
    assert b.count() == 258 and b.select("batch_id").distinct().count() == 3
    items = spark.range(0, 257).select(F.col("id").cast("string").alias("k"))
    assert S.epoch_batches(items, "k", 128).count() == 256


def test_early_stopping_strict(spark):
    hist = spark.createDataFrame([(0, 1.0), (1, 0.9), (2, 0.9), (3, 0.95), (4, 0.8), (5, 0.85), (6, 0.85)],
                                 "epoch int, val_loss double")
    out = S.early_stopping(hist, patience=2).orderBy("epoch").collect()
    assert [r.is_best for r in out] == [True, True, False, False, True, False, False]
    assert [r.epoch for r in out if r.stop] == [3]


def test_distillation_loss_finite_with_masked_diagonal(spark):
    rng = np.random.default_rng(0)
    rows = [(0, i, rng.normal(size=4).tolist(), rng.normal(size=4).tolist()) for i in range(4)]
    b = spark.createDataFrame(rows, "batch_id long, i long, student array<double>, teacher array<double>")
    loss = L.distillation_loss(b).first().loss
    assert math.isfinite(loss)
    single = spark.createDataFrame(rows[:1], "batch_id long, i long, student array<double>, teacher array<double>")
    assert L.distillation_loss(single).count() == 0


def test_senses_keep_the_best_run(spark, monkeypatch):
    """Labels are those of the best of ten Lloyd runs from the drawn starts, never worse than the
    farthest-first start alone and the optimum over all partitions where the groups lie apart."""
    import itertools

    rng = np.random.default_rng(0)
    words = {f"w{i}": rng.normal(size=(9, 2)) for i in range(6)}
    words["far"] = np.array([[0, 0], [0, 1], [0, 2], [10, 0], [10, 1], [10, 2], [5, 40], [5, 0], [5, 1.0]])
    words["apart"] = np.repeat([[0, 0], [50, 0], [0, 50.0]], 3, axis=0) + rng.normal(size=(9, 2))
    words["same"] = np.ones((9, 2))
    rows = [(w, i, [float(a) for a in v]) for w, x in words.items() for i, v in enumerate(x)]
    ctx = spark.createDataFrame(rows, "word string, ctx long, vec array<double>")

    def inertia(x, lab):
        return sum(((x[lab == j] - x[lab == j].mean(0)) ** 2).sum() for j in set(lab))

    def lloyd(x, c):
        c = np.array(c)
        for _ in range(SN.ROUNDS):
            lab = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
            c = np.stack([x[lab == j].mean(0) if (lab == j).any() else c[j] for j in range(len(c))])
        lab = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
        return inertia(x, lab)

    def run():
        got = {}
        for r in SN.sense_labels(ctx, n_senses=3, min_contexts=3).collect():
            got.setdefault(r.word, {})[r.ctx] = r.sense_id
        return {w: inertia(words[w], np.array([lab[i] for i in range(9)])) for w, lab in got.items()}

    wanted = ctx.select("word").distinct().withColumn("k", F.lit(3))
    starts = {r.word: r.runs for r in SN._starts(ctx, wanted).collect()}
    assert all(len(runs) == 10 and all(len(c) == 3 for c in runs) for runs in starts.values())
    two = {r.word: r.runs for r in SN._starts(ctx, wanted.withColumn("k", F.lit(2))).collect()}
    assert two == {w: [c[:2] for c in runs] for w, runs in starts.items()}
    ten = run()
    assert ten == pytest.approx({w: min(lloyd(words[w], c) for c in runs) for w, runs in starts.items()}, abs=1e-9)
    monkeypatch.setattr(SN, "RUNS", 1)
    one = run()
    assert one == pytest.approx({w: lloyd(words[w], runs[0]) for w, runs in starts.items()}, abs=1e-9)
    assert all(ten[w] <= one[w] + 1e-9 for w in words) and any(ten[w] < one[w] - 1e-6 for w in words)
    parts = [np.array((0, *p)) for p in itertools.product(range(3), repeat=8)]
    best = {w: min(inertia(x, p) for p in parts) for w, x in words.items()}
    assert all(ten[w] >= best[w] - 1e-9 for w in words)
    assert all(ten[w] == pytest.approx(best[w], abs=1e-9) for w in ("far", "apart", "same"))


def test_senses(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(20, 4)) * 0.05 + np.array([5, 0, 0, 0])
    b = rng.normal(size=(20, 4)) * 0.05 + np.array([0, 5, 0, 0])
    rows = [("w", i, v.tolist()) for i, v in enumerate(np.vstack([a, b]))] + [("z", 0, [1.0, 0.0, 0.0, 0.0])]
    ctx = spark.createDataFrame(rows, "word string, ctx long, vec array<double>")
    senses = SN.multi_sense(ctx, n_senses=2, min_contexts=5).collect()
    sizes = sorted(r.n_ctx for r in senses if r.word == "w")
    assert sizes == [20, 20] and [r.n_ctx for r in senses if r.word == "z"] == [1]
    best = {r.word: r.best_k for r in SN.optimal_senses(ctx, 5, 5).collect()}
    assert best == {"w": 2, "z": 1}


def test_hash_top_k_is_exact(spark):
    from lexaria.functions.text import hash_key

    df = spark.range(0, 5000).select(F.col("id"), hash_key(F.lit(7), F.col("id")).alias("h"))
    want = [r.id for r in df.orderBy("h", "id").limit(100).collect()]
    got = [r.id for r in S.hash_top_k(df, "h", 100, ["id"]).collect()]
    assert got == want
    assert [r.id for r in S.hash_top_k(df, "h", 6000, ["id"]).collect()] == [r.id for r in df.orderBy("h", "id").collect()]


def test_silhouette_by_blocks(spark, monkeypatch):
    """Blocks of any size give the Euclidean silhouette of all pairs; equal contexts and lone ones included."""
    rng = np.random.default_rng(4)
    words = {"big": rng.normal(size=(90, 5)), "same": np.ones((6, 5)), "lone": rng.normal(size=(4, 5)), "one": rng.normal(size=(3, 5))}
    label = {"big": lambda i: i % 3, "same": lambda i: i % 2, "lone": lambda i: int(i == 0), "one": lambda i: 0}
    rows = [(w, i, v.tolist(), label[w](i)) for w, m in words.items() for i, v in enumerate(m)]
    ctx = spark.createDataFrame(rows, "word string, ctx long, vec array<double>, sense_id long")

    def brute(m, lab):
        if len(set(lab)) < 2:
            return -1.0
        d, out = np.sqrt(((m[:, None] - m[None]) ** 2).sum(-1)), []
        for i in range(len(m)):
            mean = {x: d[i, lab == x].sum() / ((lab == x).sum() - (x == lab[i]) or np.inf) for x in set(lab)}
            a, b = mean[lab[i]], min(v for x, v in mean.items() if x != lab[i])
            out.append(0.0 if (lab == lab[i]).sum() == 1 or max(a, b) == 0 else (b - a) / max(a, b))
        return float(np.mean(out))

    want = {w: brute(m, np.array([label[w](i) for i in range(len(m))])) for w, m in words.items()}
    for block in (1024, 16):
        monkeypatch.setattr(SN, "SIL_BLOCK", block)
        got = {r.word: r.silhouette for r in SN.silhouette_scores(ctx).collect()}
        assert got.keys() == want.keys() and all(abs(got[w] - want[w]) < 1e-9 for w in want)


def test_average_rank_with_one_value(spark):
    """One value held by most rows of one group: ranks equal the definition, whatever the partitions."""
    from lexaria.functions.ordering import average_rank

    rows = [("g", i, 1.0 if i % 10 else float(i)) for i in range(2000)] + [("h", i, float(i // 2)) for i in range(7)]
    df = spark.createDataFrame(rows, "grp string, id long, v double")
    got = {(r.grp, r.id): r.rank for r in average_rank(df, "v", ["grp"], ["id"], "rank").collect()}
    for g in ("g", "h"):
        v = {i: x for a, i, x in rows if a == g}
        for i, x in v.items():
            less = sum(y < x for y in v.values())
            assert got[g, i] == less + (sum(y == x for y in v.values()) + 1) / 2
    assert len(got) == len(rows)


def test_lines_of_files_are_numbered_without_moving_them(spark, tmp_path, monkeypatch):
    """the number is the place in the files' order, blank and repeated lines included."""
    from lexaria.sources import corpus as C

    def moved(*_):
        raise AssertionError("lines were sorted again")

    monkeypatch.setattr(C, "with_global_index", moved)
    want = []
    for part, n in enumerate([40, 0, 7, 3000]):
        lines = [f"{part}-{i}" if i % 5 else "" for i in range(n)]
        (tmp_path / f"part-{part:05d}.txt").write_text("".join(f"{x}\n" for x in lines))
        want += lines
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    try:
        got = C.indexed_text_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["line_no"], r["line"]) for r in got) == list(enumerate(want))
    empty = tmp_path / "none"
    empty.mkdir()
    (empty / "part-0.txt").write_text("")
    assert C.indexed_text_lines(spark, str(empty)).count() == 0


def test_silhouettes_of_all_counts_share_their_distances(spark, monkeypatch):
    """Every sense count is scored from one pass over the distances, with the scores of a pass of its own."""
    rng = np.random.default_rng(6)
    rows = [(w, i, (rng.normal(size=3) + 9 * np.eye(3)[i % 3]).tolist(), i % 3, None if w == "b" else i % 2) for w in "ab" for i in range(24)]
    ctx = spark.createDataFrame(rows, "word string, ctx long, vec array<double>, l3 long, l2 long")
    got = {(r.word, r.t): r.silhouette for r in SN._silhouettes(ctx.select("word", "ctx", "vec", F.array("l2", "l3").alias("ls"))).collect()}
    own = {(r.word, 1): r.silhouette for r in SN.silhouette_scores(ctx, "l3").collect()}
    own[("a", 0)] = SN.silhouette_scores(ctx.where("word = 'a'"), "l2").first().silhouette
    assert got == pytest.approx(own, abs=1e-9)
    x = np.vstack([rng.normal(size=(9, 3)) + 1e3, np.full((2, 3), 1e3)])
    want = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(SN._distances(x, x) - want).max() < 1e-9
    passes, scores = [], SN._silhouettes
    monkeypatch.setattr(SN, "_silhouettes", lambda c: (passes.append(1), scores(c))[1])
    assert SN.optimal_senses(ctx.select("word", "ctx", "vec"), 4, 4).count() == 2 and len(passes) == 1
