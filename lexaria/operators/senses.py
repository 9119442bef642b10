"""Word-sense induction (E27) and sense-count selection.

K-means runs for all words and ``RUNS`` starts at once, as Lloyd rounds over DataFrames: the state
is a table of ``RUNS`` times ``k`` centres per word, every round assigns contexts to the
nearest centre of every run and averages by ``(word, run, sense)``.  Contexts are dealt once to blocks of about
``BLOCK`` inside their word, stored, and a round multiplies a block at a time, so it shuffles a sum per block and
centre.  The run of lowest inertia is kept.  No word's contexts are ever gathered in one task, and all contexts of a word
take part.

Starts are deterministic.  Run 0: the context farthest from the word's mean, then repeatedly the
context farthest from the centres so far (ties: smaller ``ctx``).  The other runs draw a first context
at random, then contexts with odds by their squared distance to the centres so far; a draw is the
greatest of distance over an exponential number hashed from ``ctx``, so it is one aggregate per
word and no draw depends on the partitions.  The silhouette is exact, with Euclidean distances summed
by pairs of blocks inside a word, once for all sense counts; its time stays quadratic in a word's contexts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexaria.functions.arrow import lists, matrix

ROUNDS = 20
RUNS = 10
BLOCK = 1024


def _sq_distance(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def _mean(df: DataFrame, keys: list[str], vec: str = "vec", name: str = "c") -> DataFrame:
    got = df.groupBy(*keys).agg(Summarizer.mean(array_to_vector(F.col(vec))).alias("_m"), F.count(F.lit(1)).alias("n"))
    return got.select(*keys, vector_to_array("_m").alias(name), "n")


def _nearest(centres, vec: str = "vec") -> Column:
    """Squared distance ``d`` to the nearest centre and its position ``i`` (ties: the first)."""
    return F.array_min(F.transform(centres, lambda c, i: F.struct(_sq_distance(c, F.col(vec)).alias("d"), i.alias("i"))))


def _draw_key(run: int, step: int) -> Column:
    """What a run's next centre has most of: distance, in random runs over an exponential number."""
    d = F.col("d")[run]
    if run == 0:
        return d
    u = (F.pmod(F.xxhash64("ctx", F.lit(run), F.lit(step)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return d / -F.log(u)


def _blocks(contexts: DataFrame) -> DataFrame:
    """``(word, ctxs, vs)``: the contexts of every word in blocks of about ``BLOCK``, stored once for all rounds."""
    parts = contexts.groupBy("word").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    dealt = contexts.join(parts, "word").withColumn("blk", F.pmod(F.xxhash64("ctx"), F.col("parts")).cast("int"))
    held = dealt.groupBy("word", "blk").agg(F.sort_array(F.collect_list(F.struct("ctx", "vec"))).alias("xs"))  # about BLOCK
    field = lambda c: F.transform("xs", lambda x: x[c])
    return held.select("word", field("ctx").alias("ctxs"), field("vec").alias("vs")).checkpoint()


def _sq_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """(centres, rows of x) squared distances, summed in the order of the dimensions as ``_sq_distance`` does."""
    d = np.zeros((len(centres), len(x)))
    for i, col in enumerate(np.ascontiguousarray(x.T)):
        e = col - centres[:, i, None]
        d += e * e
    return d


def _far(batches):
    """(word, ctx, vec, d): squared distances to the nearest centre of every run; a run without centres draws evenly."""
    for batch in batches:
        for r in range(batch.num_rows):
            ctx, vs = (batch.column(c).slice(r, 1).flatten() for c in ("ctxs", "vs"))
            x = matrix(vs)
            d = [_sq_distances(x, np.array(cs, np.float64)).min(0) if cs else np.ones(len(x)) for cs in batch.column("runs")[r].as_py()]
            word = pa.array([batch.column("word")[r].as_py()] * len(x), pa.string())
            yield pa.RecordBatch.from_arrays([word, ctx, vs, lists(np.column_stack(d))], ["word", "ctx", "vec", "d"])


def _starts(contexts: DataFrame, wanted: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """(word, k, runs): starting centres of every run; ``wanted`` is (word, k), with any number of ``k`` a word."""
    blocks = _blocks(contexts) if blocks is None else blocks
    kind = f"word string, ctx {contexts.schema['ctx'].dataType.simpleString()}, vec array<double>, d array<double>"
    tops = wanted.groupBy("word").agg(F.max("k").alias("top"))
    none = F.array().cast("array<array<double>>")
    state = tops.join(_mean(contexts, ["word"]), "word").select(
        "word", "top", F.array(F.array("c"), *[none] * (RUNS - 1)).alias("runs")).checkpoint()
    for step in range(tops.agg(F.max("top")).first()[0] or 0):
        far = blocks.join(state.where(F.col("top") > step).select("word", "runs"), "word").mapInArrow(_far, kind)
        pick = far.groupBy("word").agg(*[
            F.max_by("vec", F.struct(_draw_key(r, step), -F.col("ctx"))).alias(f"v{r}") for r in range(RUNS)])
        old = [none if r == 0 and step == 0 else F.col("runs")[r] for r in range(RUNS)]
        more = F.array(*[F.concat(old[r], F.array(f"v{r}")) for r in range(RUNS)])
        state = state.join(pick, "word", "left").select(
            "word", "top", F.when(F.col("v0").isNull(), F.col("runs")).otherwise(more).alias("runs"))
        state = state.checkpoint()
    # the first k of a longer start are a start for k
    return wanted.join(state.select("word", "runs"), "word").select(
        "word", "k", F.transform("runs", lambda cs: F.slice(cs, 1, F.col("k"))).alias("runs"))


def _assigned(batches):
    """Of every block and ``k``: word, k, vectors, and (runs, k, contexts) squared distances."""
    for batch in batches:
        for r in range(batch.num_rows):
            x = matrix(batch.column("vs").slice(r, 1).flatten())
            for state in batch.column("ss")[r].as_py():
                centres = np.array(state["runs"], np.float64)
                d = _sq_distances(x, centres.reshape(-1, centres.shape[-1]))
                yield batch.column("word")[r], state["k"], x, d.reshape(*centres.shape[:2], len(x))


def _block_sums(batches):
    """(word, k, at, s, n): sums and numbers of the contexts nearest to every centre (ties: the first)."""
    for word, k, x, d in _assigned(batches):
        at = (d.argmin(1) + k * np.arange(len(d))[:, None]).ravel()
        own = np.zeros((d.shape[0] * k, len(x)))
        own[at, np.tile(np.arange(len(x)), len(d))] = 1.0
        n = own.sum(1).astype(np.int64)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([word.as_py()] * len(some), pa.string()), pa.array(np.full(len(some), k, np.int32)),
                                          pa.array(some.astype(np.int32)), lists(own[some] @ x), pa.array(n[some])], ["word", "k", "at", "s", "n"])


def _block_inertia(batches):
    """(word, k, sums): the squared distances to the nearest centre, summed by run."""
    for word, k, _, d in _assigned(batches):
        yield pa.RecordBatch.from_arrays([pa.array([word.as_py()], pa.string()), pa.array([k], pa.int32()),
                                          lists(d.min(1).sum(1)[None])], ["word", "k", "sums"])


def _with_state(blocks: DataFrame, state: DataFrame) -> DataFrame:
    return blocks.join(state.groupBy("word").agg(F.collect_list(F.struct("k", "runs")).alias("ss")), "word")  # an entry per k


def _lloyd(blocks: DataFrame, state: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(word, k, runs) after Lloyd rounds; a centre without contexts stays where it is."""
    for _ in range(rounds):
        sums = _with_state(blocks, state).mapInArrow(_block_sums, "word string, k int, at int, s array<double>, n long")
        new = sums.groupBy("word", "k", "at").agg(Summarizer.sum(array_to_vector(F.col("s"))).alias("s"), F.sum("n").alias("n"))
        new = new.select("word", "k", "at", F.transform(vector_to_array("s"), lambda x: x / F.col("n")).alias("c"))
        new = new.groupBy("word", "k").agg(F.map_from_entries(F.collect_list(F.struct("at", "c"))).alias("m"))
        moved_to = F.transform("runs", lambda cs, r: F.transform(
            cs, lambda c, i: F.coalesce(F.try_element_at("m", r * F.col("k") + i), c)))
        nxt = state.join(new, ["word", "k"]).select("word", "k", "runs", moved_to.alias("nx")).checkpoint()
        steps = F.flatten(F.zip_with("runs", "nx", lambda a, b: F.zip_with(a, b, _sq_distance)))
        done = nxt.where(F.exists(steps, lambda d: d > 1e-18)).isEmpty()
        state = nxt.select("word", "k", F.col("nx").alias("runs"))
        if done:
            break
    return state


def _best_run(blocks: DataFrame, state: DataFrame) -> DataFrame:
    """(word, k, cs, inertia): the run of lowest inertia; runs equal to nine digits: the first."""
    d = _with_state(blocks, state).mapInArrow(_block_inertia, "word string, k int, sums array<double>")
    sums = d.groupBy("word", "k").agg(F.array(*[F.sum(F.col("sums")[r]) for r in range(RUNS)]).alias("sums"))
    low = F.array_min("sums") * (1 + 1e-9) + 1e-12
    best = F.array_position(F.transform("sums", lambda x: x <= low), F.lit(True)).cast("int")
    return state.join(sums, ["word", "k"]).select(
        "word", "k", F.element_at("runs", best).alias("cs"), F.element_at("sums", best).alias("inertia"))


def _labels(contexts: DataFrame, wanted: DataFrame) -> DataFrame:
    blocks = _blocks(contexts)
    state = _best_run(blocks, _lloyd(blocks, _starts(contexts, wanted, blocks)))
    return contexts.join(state, "word").select("word", "k", "ctx", "vec", _nearest("cs")["i"].cast("bigint").alias("sense_id"))


def sense_labels(contexts: DataFrame, n_senses: int = 3, min_contexts: int = 5) -> DataFrame:
    """E27 labels: ``(word, ctx, sense_id)`` with ``k = max(1, min(n_senses, n // min_contexts))``."""
    c = contexts.select("word", "ctx", "vec")
    k = F.greatest(F.lit(1), F.least(F.lit(n_senses), F.floor(F.count(F.lit(1)) / min_contexts))).cast("int")
    return _labels(c, c.groupBy("word").agg(k.alias("k"))).select("word", "ctx", "sense_id")


def multi_sense(contexts: DataFrame, n_senses: int = 3, min_contexts: int = 5) -> DataFrame:
    """``(word, sense_id, vec, n_ctx)`` — centroid and size of every induced sense."""
    labels = sense_labels(contexts, n_senses, min_contexts)
    joined = contexts.select("word", "ctx", "vec").join(labels, ["word", "ctx"])
    got = _mean(joined, ["word", "sense_id"])
    return got.select("word", "sense_id", F.col("c").alias("vec"), F.col("n").cast("bigint").alias("n_ctx"))


SIL_BLOCK = 16384
NEAR = 1e-5


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances by one matrix product; pairs so near that it would cancel, by their differences."""
    size = (x * x).sum(1)[:, None] + (y * y).sum(1)
    d = size - 2 * (x @ y.T)
    i, j = np.nonzero(d <= NEAR * size)
    for s in range(0, len(i), 1 << 15):
        e = x[i[s:s + (1 << 15)]] - y[j[s:s + (1 << 15)]]
        d[i[s:s + (1 << 15)], j[s:s + (1 << 15)]] = (e * e).sum(1)
    return np.sqrt(d, out=d)


def _distance_sums(key, table):
    """Per context of a pair of blocks, the Euclidean distances to the other block's contexts, summed by label of every labelling."""
    table = table.combine_chunks()
    x = matrix(table.column("vec"))
    x = x - x.mean(0)
    ctx, blk = (table.column(c).to_numpy() for c in ("ctx", "blk"))
    ls = table.column("ls").chunk(0)
    ls = ls.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), -1)  # no label: nan
    sets, labels, members = [], [], []
    for t in range(ls.shape[1]):
        names = np.unique(ls[:, t][~np.isnan(ls[:, t])])
        sets.append(np.full(len(names), t, np.int32)), labels.append(names.astype(np.int64))
        members.append(ls[:, t, None] == names)
    sets, labels, member = np.concatenate(sets), np.concatenate(labels), np.concatenate(members, axis=1).astype(np.float64)
    sums = np.zeros(member.shape)
    a = np.flatnonzero(blk == key[1].as_py())
    b = a if key[1] == key[2] else np.flatnonzero(blk == key[2].as_py())
    step = max(1, 2_000_000 // max(1, len(b)))
    for s in range(0, len(a), step):
        d = _distances(x[a[s:s + step]], x[b])
        sums[a[s:s + step]] += d @ member[b]
        if a is not b:
            sums[b] += d.T @ member[a[s:s + step]]
    i, j = np.nonzero(sums)
    return pa.table({"word": pa.array([key[0].as_py()] * len(i), pa.string()), "ctx": ctx[i], "t": sets[j], "o": labels[j], "s": sums[i, j]})


def silhouette_scores(contexts: DataFrame, label: str = "sense_id") -> DataFrame:
    """E28 given labels: ``(word, silhouette)`` — mean Euclidean silhouette of each word's
    contexts, -1 when fewer than two labels occur; a context alone in its cluster scores 0.
    """
    x = contexts.select("word", "ctx", "vec", F.array(F.col(label).cast("bigint")).alias("ls"))
    return _silhouettes(x).select("word", "silhouette")


def _silhouettes(contexts: DataFrame) -> DataFrame:
    """``(word, t, silhouette)`` for every labelling ``t`` of a word: ``ls[t]`` is a context's label, null where
    the word has no labelling ``t``.

    Distances are summed by pairs of blocks inside a word: contexts fall into blocks of about
    ``SIL_BLOCK`` by hash, a group holds one pair of blocks whatever the word's size, and a
    context leaves it with one sum per label, never with its pairs.  ``ctx`` is unique in a word.
    """
    x = contexts.select("word", F.col("ctx").cast("long").alias("ctx"), "vec", "ls")
    told = x.select("word", "ctx", F.posexplode("ls").alias("t", "l")).where("l is not null")
    sizes = told.groupBy("word", "t", "l").agg(F.count(F.lit(1)).alias("n"))
    # a word's labellings have all its contexts each
    tables = sizes.groupBy("word", "t").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    parts = tables.where("k > 1").groupBy("word").agg(F.ceil(F.max("n") / SIL_BLOCK).cast("int").alias("parts"))
    y = x.join(parts, "word").withColumn("blk", F.pmod(F.xxhash64("ctx"), F.col("parts")).cast("int"))
    y = y.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    y = y.select("word", F.least("blk", "with").alias("a"), F.greatest("blk", "with").alias("b"), "blk", "ctx", "vec", "ls")
    sums = y.groupBy("word", "a", "b").applyInArrow(_distance_sums, "word string, ctx long, t int, o long, s double")
    sums = sums.groupBy("word", "ctx", "t", "o").agg(F.sum("s").alias("s"))
    # every (context, label of its word), so that a sum of 0 counts as a distance of 0
    labels = sizes.groupBy("word", "t").agg(F.collect_list(F.struct("l", "n")).alias("es"))  # one entry per sense
    each = told.join(labels, ["word", "t"]).select("word", "ctx", "t", "l", F.explode("es").alias("e"))
    each = each.select("word", "ctx", "t", "l", F.col("e.l").alias("o"), F.col("e.n").alias("n")).join(sums, ["word", "ctx", "t", "o"], "left")
    own, s = F.col("l") == F.col("o"), F.coalesce("s", F.lit(0.0))
    per = each.groupBy("word", "ctx", "t").agg(
        F.max(F.when(own & (F.col("n") > 1), s / (F.col("n") - 1))).alias("a"), F.min(F.when(~own, s / F.col("n"))).alias("b"),
        F.count(F.lit(1)).alias("k"))
    top = F.greatest("a", "b")
    score = F.when(F.col("a").isNull() | (top <= 0), 0.0).otherwise((F.col("b") - F.col("a")) / top)
    return per.groupBy("word", "t").agg(F.when(F.max("k") < 2, -1.0).otherwise(F.avg(score)).alias("silhouette"))


def optimal_senses(contexts: DataFrame, max_senses: int = 5, min_contexts: int = 5) -> DataFrame:
    """``(word, best_k, best_score)`` — silhouette over k = 2..min(max, n // min);
    k with a cluster under ``min_contexts`` is skipped; strict improvement from -1;
    default 1."""
    c = contexts.select("word", "ctx", "vec")
    words = c.groupBy("word").agg(F.least(F.lit(max_senses), F.floor(F.count(F.lit(1)) / min_contexts)).cast("int").alias("top"))
    words = words.checkpoint()
    wanted = words.where("top >= 2").select("word", F.explode(F.sequence(F.lit(2), F.col("top"))).alias("k"))
    every = _labels(c.join(wanted.select("word").distinct(), "word", "left_semi"), wanted).checkpoint()
    sizes = every.groupBy("word", "k", "sense_id").agg(F.count(F.lit(1)).alias("n")).groupBy("word", "k").agg(
        F.min("n").alias("least"), F.count(F.lit(1)).alias("found"))
    ok = sizes.where((F.col("least") >= min_contexts) & (F.col("found") == F.col("k"))).select("word", "k")
    # the labels of a context for all counts in one row, so distances are summed once; equal rows stay as many
    counts = range(2, max_senses + 1)
    of = lambda k, c: F.when(F.col("k") == k, c)
    ls = every.join(ok, ["word", "k"], "left_semi").groupBy("word", "ctx", "vec").agg(
        F.array(*[F.max(of(k, F.col("sense_id"))) for k in counts]).alias("ls"),
        F.array_max(F.array(*[F.count(of(k, F.lit(1))) for k in counts])).alias("copies"))
    ls = ls.select("word", "ctx", "vec", "ls", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    tried = _silhouettes(ls).select("word", (F.col("t") + 2).alias("k"), "silhouette")
    best = tried.where(F.col("silhouette") > -1).groupBy("word").agg(
        F.max_by(F.struct("k", "silhouette"), F.struct("silhouette", -F.col("k"))).alias("b"))
    return words.select("word").join(best, "word", "left").select(
        "word", F.coalesce("b.k", F.lit(1)).cast("bigint").alias("best_k"), F.coalesce("b.silhouette", F.lit(-1.0)).alias("best_score"))
