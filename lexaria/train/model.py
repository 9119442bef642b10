"""Synchronous large-batch training as DataFrame jobs (K1-K7).

The reference trains one small batch at a time on one device.  Here every
in-batch block (``batch_id``) of a pass is processed in parallel, block
gradients are averaged, and one optimiser step is taken per pass.  Losses per
block are exactly E23/E24/E25; the optimiser path differs (documented).

The model is a parameter table ``(word, vec, m, v)``; gradients are grouped
vector sums keyed by word.  Only scalars (loss, global gradient norm) reach the
driver; every pass is written to the shared checkpoint folder, which cuts the
lineage and lets a run resume.

A pass packs whole blocks into lots of about ``encode.LOT_TOKENS`` tokens and sends every lot the
vectors of its words once.  Sentence sums, the block's loss and the gradient of the words are then
computed where the lot lies: what is shuffled is text, lots, and two vectors for a word of a
lot, never a vector of a token or of a sentence, and no vector table is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaria.functions import tokens as TK
from lexaria.functions import vectors as Vx
from lexaria.functions.arrow import lists, matrix
from lexaria.operators import encode as EN
from lexaria.operators import losses as L


# --------------------------------------------------------------------------- K1

def init_params(word_vectors: DataFrame) -> DataFrame:
    """K1: parameter table from word vectors with zero Adam moments."""
    z = F.transform(F.col("vec"), lambda _: F.lit(0.0))
    return word_vectors.select("word", F.col("vec").cast("array<double>").alias("vec"), z.alias("m"), z.alias("v"))


def vectors_of(params: DataFrame) -> DataFrame:
    """F16: the table's vectors (vocabulary-aligned output)."""
    return params.select("word", "vec")


# --------------------------------------------------------------------------- shared pieces

def _lots(rows: DataFrame, by: str, key: list[str], texts: list[str]) -> DataFrame:
    """Lots of whole groups ``by``, in the order of ``key``; ``cut`` is where a row's second text begins."""
    placed = rows.select(*key, *texts).repartition(by).sortWithinPartitions(*[k for k in key if k != "tvec"])
    runs, n = TK.char_runs(rows.sparkSession), len(texts)

    def told(batches):
        chars = TK.table(runs)
        for b in batches:
            # the texts of a row one behind the other
            each = pa.concat_arrays([b.column(t) for t in texts]).take(pa.array(np.arange(n * b.num_rows).reshape(n, -1).T.ravel()))
            for x, y, tokens, sizes, _ in TK.cut_texts(each, chars, n):
                keys = b.slice(x // n, (y - x) // n)
                own = pa.StructArray.from_arrays([*(keys.column(k) for k in key), pa.array(sizes[::n], pa.int32())], [*key, "cut"])
                toks = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)][::n], pa.int32()), tokens)
                yield pa.RecordBatch.from_arrays([own, toks], ["key", "toks"])

    def pack(batches):
        return EN.pack_groups(by)(told(batches))

    kind = "struct<" + ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in placed.select(*key).schema) + ", cut: int>"
    return placed.mapInArrow(pack, EN.LOT_ROW.format(key=kind)).checkpoint(eager=True)


def _lot_vectors(lots: DataFrame, table: DataFrame) -> DataFrame:
    """Lots with the vectors of their words: a token is resolved to a parameter row (exact word, else
    lowercase); unknown words drop out.  ``table`` is ``(word, vec)``.

    Rows of ``table`` that share a word all count: ``vec`` is their sum, and a token counts ``times`` once
    for every exact and every lowercase row it meets.
    """
    copies = table.groupBy("word").agg(F.count(F.lit(1)).alias("c"))
    words = lots.select(F.explode("words").alias("form")).distinct()
    exact = copies.select(F.col("word").alias("_e"), F.col("c").alias("_ce"))
    lower = copies.select(F.col("word").alias("_l"), F.col("c").alias("_cl"))
    met = words.join(exact, F.col("form") == F.col("_e"), "left").join(lower, F.lower("form") == F.col("_l"), "left")
    times = F.when(F.col("_e").isNull(), F.col("_cl")).otherwise(F.col("_ce") * F.coalesce("_cl", F.lit(1)))
    met = met.select("form", F.coalesce("_e", "_l").alias("word"), times.cast("double").alias("times")).where(F.col("word").isNotNull())
    asked = lots.select("lot", F.posexplode("words").alias("at", "form"))
    # a word of several rows comes as several rows, which the lot adds up
    return EN.with_vectors(lots, asked.join(met.join(table.select("word", "vec"), "word"), "form").select("lot", "at", "word", "times", "vec"))


class _Lot:
    """A lot in memory: keys, tokens, and the words' vectors, names and times."""

    def __init__(self, head, rest, dim: int):
        self.keys, sizes, ids = (head.column(c).chunk(0).flatten() for c in ("keys", "sizes", "ids"))
        self.sizes, self.ids = sizes.to_numpy().astype(np.int64), ids.to_numpy()
        n_words = int(self.ids.max()) + 1 if len(self.ids) else 0
        self.vecs, self.times, self.names = np.zeros((n_words, dim)), np.zeros(n_words), np.full(n_words, None, object)
        for rows in rest:
            at = rows.column("at").to_numpy(zero_copy_only=False).astype(np.int64)
            np.add.at(self.vecs, at, matrix(rows.column("vec")))
            self.times[at] = rows.column("times").to_numpy(zero_copy_only=False)
            self.names[at] = rows.column("word").to_numpy(zero_copy_only=False)

    def field(self, name: str) -> np.ndarray:
        return self.keys.field(name).to_numpy(zero_copy_only=False)

    def groups(self, *names: str) -> np.ndarray:
        """Where rows of another group begin."""
        cols = [self.field(n) for n in names]
        return np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in cols], axis=0)]) if len(self.keys) else np.zeros(0, int)

    def sums(self, sizes: np.ndarray) -> np.ndarray:
        """``Σ tf e`` of every piece of the token row."""
        return EN.sentence_sums(self.ids, sizes, self.vecs * self.times[:, None])

    def spread(self, sizes: np.ndarray, d: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words, vectors): ``Σ tf d`` over the pieces with ``known`` that hold the word."""
        piece = np.repeat(np.arange(len(sizes)), sizes)
        use = np.flatnonzero(known[piece] & (self.times[self.ids] > 0))
        use = use[np.argsort(self.ids[use], kind="stable")]
        out, seen = np.zeros((len(self.times), d.shape[1])), np.zeros(len(self.times), bool)
        for s in range(0, len(use), EN.BLOCK_TOKENS):
            part = use[s:s + EN.BLOCK_TOKENS]
            w = self.ids[part]
            edge = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            out[w[edge]] += np.add.reduceat(d[piece[part]], edge, axis=0)
            seen[w[edge]] = True
        at = np.flatnonzero(seen)
        return at, out[at] * self.times[at, None]


_PARTIAL = "word string, g array<double>, block long, n long, a double, b double"


def _out(words, g, block, n, a, b) -> pa.RecordBatch:
    """Word rows followed by block rows, in the columns of ``_PARTIAL``."""
    w, k = len(words), len(block)
    vecs = lists(np.asarray(g, np.float64)) if w else pa.array([], pa.list_(pa.float64()))
    both = lambda x, kind: pa.concat_arrays([pa.nulls(w, kind), pa.array(x, kind)])
    return pa.RecordBatch.from_arrays(
        [pa.concat_arrays([pa.array(words, pa.string()), pa.nulls(k, pa.string())]), pa.concat_arrays([vecs, pa.nulls(k, vecs.type)]),
         both(block, pa.int64()), both(n, pa.int64()), both(a, pa.float64()), both(b, pa.float64())],
        ["word", "g", "block", "n", "a", "b"])


def _add_words(batches):
    """One row per word from rows sorted by it; block rows pass."""
    name, total = None, None
    for batch in batches:
        is_word = batch.column("word").is_valid()
        yield batch.filter(pc.invert(is_word))
        batch = batch.filter(is_word)
        if not batch.num_rows:
            continue
        w = batch.column("word").to_numpy(zero_copy_only=False)
        edge = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        names, g = list(w[edge]), np.add.reduceat(matrix(batch.column("g")), edge, axis=0)
        if name is not None and names[0] == name:
            g[0] += total
        elif name is not None:
            yield _out([name], total[None], [], [], [], [])
        if len(names) > 1:
            yield _out(names[:-1], g[:-1], [], [], [], [])
        name, total = names[-1], g[-1].copy()
    if name is not None:
        yield _out([name], total[None], [], [], [], [])


def _added(partials: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(words with their summed vectors, block rows) of a pass, stored once."""
    got = partials.repartition("word", "block").sortWithinPartitions("word").mapInArrow(_add_words, _PARTIAL).checkpoint(eager=True)
    return got.where(F.col("word").isNotNull()).select("word", "g"), got.where(F.col("word").isNull()).drop("word", "g")


def _dim(params: DataFrame, dim: int | None) -> int:
    return dim or int(params.select(F.max(F.size("vec"))).first()[0])


# --------------------------------------------------------------------------- K2 distillation gradient

def _distillation_pass(batch: DataFrame, params: DataFrame, temperature: float, dim: int, gradient: bool) -> DataFrame:
    """Rows of ``_PARTIAL``: ``a`` is ``Σ ql`` and ``b`` is ``Σ q`` of a block.

    Rows that share ``(batch_id, i)`` are one student of all their texts; it meets each of their teachers, for
    the gradient once for every such row.
    """
    def run(batches):
        for head, rest in EN.each_lot(batches):
            lot = _Lot(head, rest, dim)
            s, t = lot.sums(lot.sizes), matrix(lot.keys.field("tvec"))
            at, blocks = lot.groups("batch_id", "i"), lot.groups("batch_id")
            size = np.diff(np.r_[at, len(s)])
            s = np.add.reduceat(s, at, axis=0)
            repeats = size * size if gradient else size
            who = np.repeat(np.arange(len(at)), repeats)  # the student of every row of a block
            turn = np.arange(len(who)) - np.repeat(np.cumsum(repeats) - repeats, repeats)
            teacher = at[who] + turn % size[who]
            d, known = np.zeros_like(s), np.zeros(len(s), bool)
            q, ql, n, ids = [], [], [], lot.field("batch_id")[blocks]
            edges = np.searchsorted(who, np.searchsorted(at, np.r_[blocks, len(lot.keys)]))
            for x, y in zip(edges[:-1], edges[1:]):
                got = L.distillation_block(s[who[x:y]], t[teacher[x:y]], temperature, gradient)
                q.append(got["q"].to_numpy().sum())
                ql.append(got["ql"].to_numpy().sum())
                n.append(y - x)
                if gradient:
                    has = np.asarray(got["ds"].is_valid())
                    if has.any():
                        np.add.at(d, who[x:y][has], matrix(got["ds"].filter(pa.array(has))))
                        known[who[x:y][has]] = True
            words, g = np.zeros(0, int), np.zeros((0, dim))
            if gradient:
                own = np.repeat(np.arange(len(at)), size)
                words, g = lot.spread(lot.sizes, d[own], known[own])
            yield _out(lot.names[words], g, ids, n, ql, q)

    rows = _lots(batch.withColumn("tvec", Vx.as_double("tvec")), "batch_id", ["batch_id", "i", "tvec"], ["text"])
    return _lot_vectors(rows, params.select("word", Vx.as_double("vec").alias("vec"))).mapInArrow(run, _PARTIAL)


def _distillation_losses(blocks: DataFrame) -> DataFrame:
    return L.distillation_of(blocks.select(F.col("block").alias("batch_id"), F.col("a").alias("ql"), F.col("b").alias("q"), "n"))


def distillation_losses(batch: DataFrame, params: DataFrame, temperature: float = 0.05, dim: int | None = None) -> DataFrame:
    """E23 of every block ``(batch_id, i, text, tvec)`` with the students encoded by ``params``."""
    return _distillation_losses(_distillation_pass(batch, params, temperature, _dim(params, dim), False))


def distillation_gradient(batch: DataFrame, params: DataFrame, teacher: DataFrame | None = None, temperature: float = 0.05,
                          bound: int | None = None, dim: int | None = None) -> tuple[DataFrame, DataFrame]:
    """K2: per-pass gradient wrt the word vectors of the block-averaged E23 loss.

    ``batch``: ``(batch_id, i, text)`` with ``tvec``, or ``teacher``: ``(batch_id, i, tvec)``.  Returns ``(grad (word, g),
    losses (batch_id, loss, n))``; ``bound`` (the vocabulary's size) is not needed, as nothing is broadcast.

    ``G = (P - Q)/(B T)`` (zero diagonal), ``du = (G + Gᵀ) u``,
    ``ds = (du - u <u, du>) / ||s||``, ``de_w = Σ_i tf_iw ds_i``; the pass gradient
    is the mean over blocks.
    """
    if teacher is not None:
        batch = batch.join(teacher.select("batch_id", "i", "tvec"), ["batch_id", "i"])
    grad, blocks = _added(_distillation_pass(batch, params, temperature, _dim(params, dim), True))
    n_blocks = blocks.count()  # one scalar
    return grad.withColumn("g", Vx.scale("g", 1.0 / max(n_blocks, 1))), _distillation_losses(blocks)


# --------------------------------------------------------------------------- K3 contrastive gradient

def _contrastive_pass(batch: DataFrame, params: DataFrame, temperature: float, dim: int, gradient: bool) -> DataFrame:
    """Rows of ``_PARTIAL``: ``a`` and ``b`` are the mean log-probabilities of a block's rows and columns."""
    def run(batches):
        for head, rest in EN.each_lot(batches):
            lot = _Lot(head, rest, dim)
            cut = lot.field("cut").astype(np.int64)
            sizes = np.column_stack([cut, lot.sizes - cut]).ravel()  # both texts of every row in turn
            both = lot.sums(sizes)
            at, blocks = lot.groups("batch_id", "i"), lot.groups("batch_id")
            own = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(lot.keys)]))
            s, t = (np.add.reduceat(both[k::2], at, axis=0)[own] for k in (0, 1))
            d, known = np.zeros_like(both), np.zeros(len(both), bool)
            a, b, n, ids = [], [], [], lot.field("batch_id")[blocks]
            for x, y in zip(blocks, np.r_[blocks[1:], len(lot.keys)]):
                got = L.contrastive_block(s[x:y], t[x:y], temperature, gradient)
                a.append(got["row_logp"].to_numpy().mean())
                b.append(got["col_logp"].to_numpy().mean())
                n.append(y - x)
                for k, name in enumerate(("dsrc", "dtgt") if gradient else ()):
                    has = np.flatnonzero(np.asarray(got[name].is_valid()))
                    d[2 * (x + has) + k] = matrix(got[name].drop_null()) if len(has) else 0.0
                    known[2 * (x + has) + k] = True
            words, g = np.zeros(0, int), np.zeros((0, dim))
            if gradient:
                for k in (0, 1):  # rows of one (batch_id, i) share their words
                    d[k::2] = np.add.reduceat(d[k::2], at, axis=0)[own]
                words, g = lot.spread(sizes, d, known)
            yield _out(lot.names[words], g, ids, n, a, b)

    rows = _lots(batch, "batch_id", ["batch_id", "i"], ["src", "tgt"])
    return _lot_vectors(rows, params.select("word", Vx.as_double("vec").alias("vec"))).mapInArrow(run, _PARTIAL)


def _contrastive_losses(blocks: DataFrame) -> DataFrame:
    return L.contrastive_of(blocks.select(F.col("block").alias("batch_id"), F.col("a").alias("row_logp"), F.col("b").alias("col_logp"), "n"))


def contrastive_losses(batch: DataFrame, params: DataFrame, temperature: float = 0.05, dim: int | None = None) -> DataFrame:
    """E24 of every block ``(batch_id, i, src, tgt)`` with both sides encoded by ``params``."""
    return _contrastive_losses(_contrastive_pass(batch, params, temperature, _dim(params, dim), False))


def contrastive_gradient(batch: DataFrame, params: DataFrame, temperature: float = 0.05,
                         bound: int | None = None, dim: int | None = None) -> tuple[DataFrame, DataFrame]:
    """K3: gradient of the symmetric contrastive loss (E24) for aligned ``(src, tgt)`` rows.

    ``G = ((softmax_row - I) + (softmax_col - I)) / (B T)``, ``du = G v``,
    ``dv = Gᵀ u``; each side projected through its normalisation and spread to
    its words by term frequency.
    """
    grad, blocks = _added(_contrastive_pass(batch, params, temperature, _dim(params, dim), True))
    n_blocks = blocks.count()  # one scalar
    return grad.withColumn("g", Vx.scale("g", 1.0 / max(n_blocks, 1))), _contrastive_losses(blocks)


# --------------------------------------------------------------------------- K4 cosine regression

def regression_gradient(texts: DataFrame, params: DataFrame, targets: DataFrame, weight: np.ndarray,
                        l2: float = 1e-5, bound: int | None = None, dim: int | None = None):
    """K4: gradient of ``mean(1 - cos(W m_i, t_i)) + l2 · mean(E²)`` (E25) wrt the
    token table and the projection ``W`` (k x d, a bounded parameter).

    ``texts``: ``(text_id, text)``; ``targets``: ``(text_id, tvec)``; ``m_i`` is the
    mean of the text's token vectors.  Returns ``(grad (word, g), dW (k x d), loss)``.

    ``W m_i`` is the mean of the words' projections and ``dL/de_w = Wᵀ G_w`` with ``G_w = Σ_i (tf_iw / n_i) dL/do_i``, so
    lots are sent vectors of k numbers and return such; ``dW = Σ_w G_w e_wᵀ``.
    """
    k, d = weight.shape
    n = texts.count()  # one scalar: N in the mean

    def projected(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("word"), lists(matrix(b.column("vec")) @ weight.T)], ["word", "vec"])

    def run(batches):
        for head, rest in EN.each_lot(batches):
            lot = _Lot(head, rest, k)
            at = lot.groups("text_id")
            own = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(lot.keys)]))
            s = np.add.reduceat(lot.sums(lot.sizes), at, axis=0)
            count = np.bincount(np.repeat(own, lot.sizes), lot.times[lot.ids], len(at))
            tvec = lot.keys.field("tvec")
            goal = np.flatnonzero(np.asarray(tvec.is_valid()))
            goal = goal[count[own[goal]] > 0]
            if not len(goal):
                continue
            who = own[goal]
            o = s[who] / count[who, None]
            length = np.maximum(np.sqrt((o * o).sum(1)), 1e-12)[:, None]
            oh, th = o / length, L.unit(matrix(tvec.take(pa.array(goal))))[0]
            c = (oh * th).sum(1)
            go = np.zeros((len(at), k))
            np.add.at(go, who, -(th - c[:, None] * oh) / (n * length))  # dL/do_i = -(1/N) (t̂ - c ô) / ||o||
            known = np.zeros(len(at), bool)
            known[who] = True
            words, g = lot.spread(lot.sizes, (go / np.maximum(count, 1.0)[:, None])[own], known[own])
            yield _out(lot.names[words], g, [head.column("lot")[0].as_py()], [len(goal)], [(1 - c).sum()], [0.0])

    rows = texts.select("text_id", F.lit(None).cast("array<double>").alias("tvec"), "text").unionByName(
        targets.select("text_id", Vx.as_double("tvec").alias("tvec"), F.lit(None).cast("string").alias("text")))
    table = params.select("word", Vx.as_double("vec").alias("vec"))
    lots = _lots(rows.where(F.col("text_id").isNotNull()), "text_id", ["text_id", "tvec"], ["text"])
    partials = _lot_vectors(lots, table.mapInArrow(projected, "word string, vec array<double>")).mapInArrow(run, _PARTIAL)
    by_word, parts = _added(partials)
    n_entries = params.select(F.sum(F.size("vec"))).first()[0]  # one scalar
    decay = 2.0 * l2 / float(n_entries)

    def through(batches):
        for b in batches:
            vec, has = matrix(b.column("vec")), b.column("g").value_lengths().to_numpy() > 0
            g = vec * decay
            if has.any():
                g[has] += matrix(b.column("g").filter(pa.array(has))) @ weight
            yield pa.RecordBatch.from_arrays([b.column("word"), lists(g)], ["word", "g"])

    def outer(batches):
        total = np.zeros((k, d))
        for b in batches:
            total += matrix(b.column("g")).T @ matrix(b.column("vec"))
        yield pa.RecordBatch.from_arrays([lists(total.reshape(1, -1))], ["f"])

    # an empty list, not null, where a word has no gradient (see ``EN.with_vectors``)
    told = table.join(by_word, "word", "left").withColumn("g", F.coalesce("g", F.array().cast("array<double>")))
    grad = told.mapInArrow(through, "word string, g array<double>")
    # dW as one flattened k*d vector per task, summed
    dw = table.join(by_word, "word").select("g", "vec").mapInArrow(outer, "f array<double>")
    dw_sum = dw.select(Summarizer.sum(array_to_vector("f")).alias("t")).first()["t"]  # k*d numbers
    dW = np.asarray(dw_sum.toArray()).reshape(k, d) if dw_sum is not None else np.zeros((k, d))
    ms = params.select(F.explode("vec").alias("e")).agg(F.avg(F.col("e") * F.col("e"))).first()[0]
    loss = parts.agg(F.sum("a") / F.sum("n")).first()[0] + l2 * (ms or 0.0)
    return grad, dW, loss


# --------------------------------------------------------------------------- K5 clip + Adam

def global_norm(grad: DataFrame) -> float:
    """Global L2 norm of a gradient table (one scalar)."""
    v = grad.agg(F.sum(Vx.sq_norm("g")).alias("s")).first()["s"]
    return float(np.sqrt(v or 0.0))


def adam_step(params: DataFrame, grad: DataFrame, step: int, lr: float = 1e-4, clip: float | None = 5.0,
              beta1: float = 0.9, beta2: float = 0.999, eps: float = 1e-8, weight_decay: float = 0.0) -> DataFrame:
    """K5: clip by global norm (``max_norm / (norm + 1e-6)`` when above), then one
    Adam (``weight_decay`` > 0: AdamW) step on every row — rows without a gradient
    see a zero gradient, as a dense embedding does."""
    scale = 1.0
    if clip is not None:
        n = global_norm(grad)
        if n > clip:
            scale = clip / (n + 1e-6)
    j = params.join(grad, "word", "left")
    g = F.coalesce(F.col("g"), F.transform("vec", lambda _: F.lit(0.0)))
    g = F.transform(g, lambda x: x * F.lit(scale))
    j = j.withColumn("_g", g)
    if weight_decay:
        j = j.withColumn("vec", F.transform("vec", lambda x: x * F.lit(1.0 - lr * weight_decay)))
    m = F.zip_with("m", "_g", lambda a, b: F.lit(beta1) * a + F.lit(1 - beta1) * b)
    v = F.zip_with("v", "_g", lambda a, b: F.lit(beta2) * a + F.lit(1 - beta2) * b * b)
    j = j.withColumn("m", m).withColumn("v", v)
    c1, c2 = 1 - beta1 ** step, 1 - beta2 ** step
    upd = F.zip_with("m", "v", lambda a, b: F.lit(lr) * (a / F.lit(c1)) / (F.sqrt(b / F.lit(c2)) + F.lit(eps)))
    j = j.withColumn("vec", F.zip_with("vec", upd, lambda x, u: x - u))
    return j.select("word", "vec", "m", "v")
