"""Training: gradients by finite differences, Adam step, init, driver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexaria.train import model as M

WORDS = {"hello": [1.0, 0.2, 0.0], "world": [0.1, 1.0, 0.3], "test": [0.0, 0.4, 1.0],
         "the": [0.5, 0.5, 0.1], "quick": [0.3, 0.3, 0.4]}
TEXTS = ["hello world", "the quick test", "hello the hello", "world test quick", "quick quick world"]
TEACH = np.array([[1, 0, 0, 0.2], [0, 1, 0.1, 0], [0.5, 0.5, 0, 0], [0, 0.2, 1, 0], [0.1, 0.1, 0.1, 1.0]])


def _loss(emb, T=0.05):
    """Independent NumPy E23 for one batch with sum-encoded students."""
    s = np.array([sum(emb[w] for w in t.split()) for t in TEXTS])
    u = s / np.linalg.norm(s, axis=1, keepdims=True)
    t = TEACH / np.linalg.norm(TEACH, axis=1, keepdims=True)
    B = len(TEXTS)
    ls, lt = u @ u.T / T, t @ t.T / T
    np.fill_diagonal(ls, -np.inf)
    np.fill_diagonal(lt, -np.inf)
    logp = ls - np.log(np.exp(ls - ls.max(1, keepdims=True)).sum(1, keepdims=True)) - ls.max(1, keepdims=True)
    q = np.exp(lt - lt.max(1, keepdims=True))
    q = q / q.sum(1, keepdims=True)
    mask = ~np.eye(B, dtype=bool)
    return -(q[mask] * logp[mask]).sum() / q.sum()


def _frames(spark):
    params = M.init_params(spark.createDataFrame([(w, v) for w, v in WORDS.items()], "word string, vec array<double>"))
    batch = spark.createDataFrame([(0, i, t) for i, t in enumerate(TEXTS)], "batch_id long, i long, text string")
    teacher = spark.createDataFrame([(0, i, [float(x) for x in v]) for i, v in enumerate(TEACH)],
                                    "batch_id long, i long, tvec array<double>")
    return params, batch, teacher


def test_distillation_gradient_matches_finite_differences(spark):
    params, batch, teacher = _frames(spark)
    grad, losses = M.distillation_gradient(batch, params, teacher, 0.05, bound=10, dim=3)
    g = {r["word"]: np.array(r["g"]) for r in grad.collect()}
    emb = {w: np.array(v) for w, v in WORDS.items()}
    assert losses.first()["loss"] == pytest.approx(_loss(emb), rel=1e-9)
    h = 1e-6
    for w in WORDS:
        for k in range(3):
            up = {x: v.copy() for x, v in emb.items()}
            dn = {x: v.copy() for x, v in emb.items()}
            up[w][k] += h
            dn[w][k] -= h
            fd = (_loss(up) - _loss(dn)) / (2 * h)
            assert g[w][k] == pytest.approx(fd, abs=1e-6)


def test_adam_step_moves_against_gradient(spark):
    params, batch, teacher = _frames(spark)
    grad, _ = M.distillation_gradient(batch, params, teacher, 0.05, bound=10, dim=3)
    new = {r["word"]: r for r in M.adam_step(params, grad, 1, lr=1e-2, clip=5.0).collect()}
    g = {r["word"]: np.array(r["g"]) for r in grad.collect()}
    for w, v in WORDS.items():
        delta = np.array(new[w]["vec"]) - np.array(v)
        # first Adam step: update = -lr * sign(g) (up to eps)
        assert np.allclose(delta, -1e-2 * np.sign(g[w]), atol=1e-6)


def test_init_params_zero_moments(spark):
    params, _, _ = _frames(spark)
    rows = params.collect()
    assert len(rows) == 5
    assert all(sum(r["m"]) == 0 and sum(r["v"]) == 0 for r in rows)


def test_contrastive_gradient_finite_differences(spark):
    params, _, _ = _frames(spark)
    src = TEXTS
    tgt = ["world test", "hello quick", "the world", "test the", "hello hello quick"]
    batch = spark.createDataFrame([(0, i, a, b) for i, (a, b) in enumerate(zip(src, tgt))],
                                  "batch_id long, i long, src string, tgt string")
    grad, losses = M.contrastive_gradient(batch, params, 0.05, bound=10, dim=3)
    emb = {w: np.array(v) for w, v in WORDS.items()}

    def loss(e, T=0.05):
        u = np.array([sum(e[w] for w in t.split()) for t in src])
        v = np.array([sum(e[w] for w in t.split()) for t in tgt])
        u = u / np.linalg.norm(u, axis=1, keepdims=True)
        v = v / np.linalg.norm(v, axis=1, keepdims=True)
        s = u @ v.T / T

        def ce(m):
            lse = np.log(np.exp(m - m.max(1, keepdims=True)).sum(1)) + m.max(1)
            return -(np.diag(m) - lse).mean()

        return ce(s) + ce(s.T)

    assert losses.first()["loss"] == pytest.approx(loss(emb), rel=1e-9)
    g = {r["word"]: np.array(r["g"]) for r in grad.collect()}
    h = 1e-6
    for w in WORDS:
        for k in range(3):
            up = {x: v.copy() for x, v in emb.items()}
            dn = {x: v.copy() for x, v in emb.items()}
            up[w][k] += h
            dn[w][k] -= h
            assert g[w][k] == pytest.approx((loss(up) - loss(dn)) / (2 * h), abs=1e-5)


def test_regression_gradient_finite_differences(spark):
    W = np.array([[0.5, -0.2, 0.1], [0.3, 0.8, -0.4]])
    texts_l = ["hello world", "the quick test", "hello hello quick", "world test"]
    targets = np.array([[1.0, 0.2], [0.1, 1.0], [0.7, -0.3], [-0.2, 0.9]])
    params = M.init_params(spark.createDataFrame([(w, v) for w, v in WORDS.items()], "word string, vec array<double>"))
    texts = spark.createDataFrame(list(enumerate(texts_l)), "text_id long, text string")
    tg = spark.createDataFrame([(i, t.tolist()) for i, t in enumerate(targets)], "text_id long, tvec array<double>")
    grad, dW, loss = M.regression_gradient(texts, params, tg, W, l2=1e-5, bound=10, dim=3)

    def f(emb, w):
        cs = []
        for t, tv in zip(texts_l, targets):
            m = np.mean([emb[x] for x in t.split()], axis=0)
            o = w @ m
            cs.append(o @ tv / (np.linalg.norm(o) * np.linalg.norm(tv)))
        e = np.array(list(emb.values()))
        return np.mean(1 - np.array(cs)) + 1e-5 * np.mean(e ** 2)

    emb = {w: np.array(v) for w, v in WORDS.items()}
    assert loss == pytest.approx(f(emb, W), rel=1e-9)
    g = {r["word"]: np.array(r["g"]) for r in grad.collect()}
    h = 1e-6
    for w in WORDS:
        for k in range(3):
            up = {x: v.copy() for x, v in emb.items()}
            dn = {x: v.copy() for x, v in emb.items()}
            up[w][k] += h
            dn[w][k] -= h
            assert g[w][k] == pytest.approx((f(up, W) - f(dn, W)) / (2 * h), abs=1e-6)
    for a in range(2):
        for b in range(3):
            up, dn = W.copy(), W.copy()
            up[a, b] += h
            dn[a, b] -= h
            assert dW[a, b] == pytest.approx((f(emb, up) - f(emb, dn)) / (2 * h), abs=1e-6)


def test_regression_driver_lowers_the_loss(spark):
    from lexaria.session import stage_path
    from lexaria.train import driver as D

    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(8)]
    params = M.init_params(spark.createDataFrame([(w, rng.normal(size=4).tolist()) for w in words], "word string, vec array<double>"))
    texts = spark.createDataFrame([(i, " ".join(rng.choice(words, 5))) for i in range(24)], "text_id long, text string")
    targets = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(24)], "text_id long, tvec array<double>")
    w = rng.normal(size=(3, 4))
    out = stage_path(spark, f"reg-{rng.integers(1 << 40)}-{np.random.default_rng().integers(1 << 40)}")
    cfg = D.TrainConfig(epochs=2, steps_per_pass=2, learning_rate=0.05)
    res, best_w = D.train_regression(spark, params, texts, targets, w, out, cfg)
    losses = [h["train_loss"] for h in res.history]
    assert losses[1] < losses[0] and not np.allclose(best_w, w)
    again, _ = D.train_regression(spark, params, texts, targets, w, out, cfg)  # resumes: both passes are done
    assert [h["train_loss"] for h in again.history] == pytest.approx(losses)


def test_cosine_rate_and_adamw():
    from lexaria.train import driver as D

    assert D.cosine_rate(2.0, 0, 10) == 2.0 and D.cosine_rate(2.0, 5, 10) == pytest.approx(1.0)
    w, m, v = D.adamw_matrix(np.ones((1, 1)), np.zeros((1, 1)), np.zeros((1, 1)), np.full((1, 1), 3.0), 1, 0.1, 0.01)
    assert w[0, 0] == pytest.approx(1 * (1 - 0.001) - 0.1, abs=1e-6) and m[0, 0] == pytest.approx(0.3)


def test_gradients_come_stored_and_count_repeated_rows(spark):
    """the gradient is one stored row per word, not a plan over a vector per token."""
    params, batch, teacher = _frames(spark)
    both = batch.select("batch_id", "i", F.col("text").alias("src"), F.reverse("text").alias("tgt"))
    grads = [M.distillation_gradient(batch, params, teacher, 0.05, dim=3)[0], M.contrastive_gradient(both, params, 0.05, dim=3)[0],
             M.regression_gradient(batch.select(F.col("i").alias("text_id"), "text"), params,
                                   teacher.select(F.col("i").alias("text_id"), F.slice("tvec", 1, 2).alias("tvec")), np.eye(2, 3), dim=3)[0]]
    for grad in grads:
        plan = grad._jdf.queryExecution().toString()
        assert "regexp_extract_all" not in plan and "Broadcast" not in plan
    # a word of two rows is their sum, and its tokens count once for every exact and lowercase row
    doubled = M.init_params(params.select("word", "vec").unionByName(params.select("word", "vec")))
    halved = doubled.withColumn("vec", F.transform("vec", lambda x: x / 8))
    once, twice = ({r["word"]: np.array(r["g"]) for r in M.distillation_gradient(batch, p, teacher, 0.05, dim=3)[0].collect()}
                   for p in (params, halved))
    for w in WORDS:  # the same sums; a token counts four times
        assert np.allclose(twice[w], 4 * once[w], atol=1e-9)


def test_rows_of_a_lot_hold_no_null_lists(spark):
    """a null list is gone over again by Arrow's writer for every row behind it."""
    from lexaria.operators import encode as EN

    lots = spark.createDataFrame([(1, [(7, None)], [2], [0, 1], ["a", "b"])],
                                 EN.LOT_ROW.format(key="struct<text_id: long, tvec: array<double>>"))
    found = spark.createDataFrame([(1, at, [float(at)]) for at in range(2)], "lot long, at int, vec array<double>")
    rows = EN.with_vectors(lots, found).collect()
    assert [r["at"] for r in rows] == [None, 0, 1] and rows[0]["ids"] == [0, 1] and rows[0]["keys"][0]["text_id"] == 7
    assert all(r[c] == [] for r in rows[1:] for c in ("keys", "sizes", "ids"))


def test_texts_are_cut_as_the_patterns_cut_them(spark, monkeypatch):
    """the table of characters gives the tokens of ``word_tokens`` and ``drop_punct``, slice by slice."""
    import pyarrow as pa

    from lexaria.functions import text as T
    from lexaria.functions import tokens as TK

    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rng = np.random.default_rng(0)
    texts = ["", None, " ", "a", "a.b", "«x»!", "über—naïve …", "日本、語。x", "😀a😀", "x" * 50, "b\u0000c\u0085d e f", "-- ,", "a'b“c”"]
    texts += ["a" + c + "b" + c + c for c in every[:0x3100]]  # every character of the first blocks inside and behind words
    texts += ["a".join(every[k:k + 512]) for k in range(0, len(every), 512)]
    texts += ["".join(rng.choice(every[:0x3100], 30)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    want = dict(df.select("i", T.drop_punct(T.word_tokens(F.col("t")))).collect())
    chars = TK.table(TK.char_runs(spark))
    for size in (1 << 22, 100):
        monkeypatch.setattr(TK, "SLICE_BYTES", size)
        got, upto = [], 0
        for a, b, tokens, sizes, _ in TK.cut_texts(pa.array(texts), chars):
            assert a == upto and len(sizes) == b - a
            upto, ends = b, np.r_[0, np.cumsum(sizes)]
            got += [tokens[x:y].to_pylist() for x, y in zip(ends[:-1], ends[1:])]
        assert upto == len(texts)
        assert [want[i] or [] for i in range(len(texts))] == got
