"""Samplers, splits and set operations.

The reference draws with an unseeded/global NumPy RNG, so exact rows are not
reproducible there.  Contract here: every random choice is an order by
``md5(seed | key ...)``, which is deterministic and independent of the
partitioning.  Per-word choices are bounded by the context cap ``n`` of the
index, so per-word windows never see more than ``n`` rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexaria.functions.ordering import indexed_with_count
from lexaria.functions.text import hash_key
from lexaria.sources.corpus import first_in_order


def hash_top_k(df: DataFrame, h: str, k: int, tiebreak: list[str]) -> DataFrame:
    """The ``k`` rows with the smallest md5 hex ``h`` (ties by ``tiebreak``), exact.

    The rows are counted by the first 16 bits of ``h`` (at most 65,536 counts, whatever the
    input).  The prefixes up to the one in which the count reaches ``k`` are a down-set of
    the order that holds the answer; only its rows are put in order, over all partitions.
    """
    if k <= 0:
        return df.limit(0)
    prefix = F.substring(F.col(h), 1, 4)
    counts = df.groupBy(prefix.alias("p")).agg(F.count(F.lit(1)).alias("c"))
    run = counts.select("p", F.sum("c").over(Window.orderBy("p")).alias("run"))
    last = run.where(F.col("run") >= k).agg(F.min("p")).first()[0]  # one scalar
    down = df if last is None else df.where(prefix <= F.lit(last))
    return first_in_order(down, [h, *tiebreak], k)


def _per_word_sample(ctx: DataFrame, n: int, min_count: int, seed: int) -> DataFrame:
    """Rows ``(word, rn, sentence, pick)`` for words with >= min_count sentences,
    ``pick`` = 1..n in hash order (without replacement)."""
    w_all = Window.partitionBy("word")
    w_ord = Window.partitionBy("word").orderBy("_h")
    return (
        ctx.select("word", "rn", "sentence", hash_key(F.lit(seed), F.col("word"), F.col("rn")).alias("_h"))
        .withColumn("_cnt", F.count(F.lit(1)).over(w_all))
        .where(F.col("_cnt") >= min_count)
        .withColumn("pick", F.row_number().over(w_ord))
        .where(F.col("pick") <= n)
        .drop("_cnt", "_h")
    )


def training_split(ctx: DataFrame, n_per_word: int = 3, train_ratio: float = 0.8, seed: int = 42) -> DataFrame:
    """G3 + H2: sample n sentences per word (words with >= n), distinct, shuffle,
    split at ``floor(N * ratio)``.  Output ``(sentence, split, idx)``."""
    picked = _per_word_sample(ctx, n_per_word, n_per_word, seed).select("sentence").distinct()
    shuffled = picked.withColumn("_h", hash_key(F.lit(seed), F.col("sentence")))
    indexed, n = indexed_with_count(shuffled, ["_h", "sentence"], "idx")
    cut = int(n * train_ratio)
    return indexed.select(
        "sentence", F.when(F.col("idx") < cut, "train").otherwise("val").alias("split"), "idx"
    )


def historical_split(ctx: DataFrame, seed: int = 42, max_dev: int = 10000) -> DataFrame:
    """G4 + H3: words with >= 5 sentences; 2 -> train, 1 -> dev; dev minus train;
    at most ``max_dev`` dev sentences (in hash order).  Output ``(sentence, split)``."""
    picked = _per_word_sample(ctx, 3, 5, seed)
    train = picked.where(F.col("pick") <= 2).select("sentence").distinct()
    dev = picked.where(F.col("pick") == 3).select("sentence").distinct().join(train, "sentence", "left_anti")
    dev = hash_top_k(dev.withColumn("_h", hash_key(F.lit(seed), F.lit("dev"), F.col("sentence"))), "_h",
                     max_dev, ["sentence"]).drop("_h")
    return train.withColumn("split", F.lit("train")).unionByName(dev.withColumn("split", F.lit("dev")))


def contrastive_pairs(ctx: DataFrame, n_pairs: int = 10000, seed: int = 42) -> DataFrame:
    """``n_pairs`` draws; each draws a word (with >= 2 sentences) and two of its
    different sentences.  Repeats across draws allowed.  No eligible word -> empty
    (the reference loops forever).  Output ``(draw, word, s1, s2)``."""
    spark = ctx.sparkSession
    eligible = ctx.groupBy("word").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") >= 2).select("word")
    eligible, n_words = indexed_with_count(eligible, ["word"], "widx")
    if n_words == 0:
        return spark.createDataFrame([], "draw bigint, word string, s1 string, s2 string")
    draws = spark.range(n_pairs).select(
        F.col("id").alias("draw"),
        F.pmod(F.conv(F.substring(hash_key(F.lit(seed), F.col("id")), 1, 15), 16, 10).cast("bigint"),
               F.lit(n_words)).alias("widx"),
    )
    chosen = draws.join(eligible, "widx").join(ctx.select("word", "rn", "sentence"), "word")
    w = Window.partitionBy("draw").orderBy("_h", "rn")
    top2 = (
        chosen.withColumn("_h", hash_key(F.lit(seed), F.col("draw"), F.col("rn")))
        .withColumn("k", F.row_number().over(w))
        .where(F.col("k") <= 2)
    )
    return top2.groupBy("draw", "word").agg(
        F.min_by("sentence", "k").alias("s1"), F.max_by("sentence", "k").alias("s2")
    )


def one_per_word(ctx: DataFrame, min_count: int = 3, max_total: int = 100000, seed: int = 42) -> DataFrame:
    """One random sentence per word with >= min_count, at most ``max_total``
    (words taken in index order)."""
    picked = _per_word_sample(ctx, 1, min_count, seed)
    first_pos = ctx.groupBy("word").agg(F.min(F.struct("doc_id", "line_no", "sent_no")).alias("_p"))
    return first_in_order(picked.join(first_pos, "word"), ["_p", "word"], max_total).select("word", "sentence")


def language_sample(ctx: DataFrame, target_lang: str, per_word: int = 5, min_count: int = 10,
                    max_total: int = 100000, seed: int = 42) -> DataFrame:
    """G7 + C15: up to ``per_word`` target-language sentences per word with >= min_count
    sentences, at most ``max_total``.  ``ctx`` carries a ``lang`` column."""
    w_all = Window.partitionBy("word")
    elig = ctx.withColumn("_cnt", F.count(F.lit(1)).over(w_all)).where(F.col("_cnt") >= min_count)
    hits = elig.where(F.col("lang") == target_lang)
    w = Window.partitionBy("word").orderBy(hash_key(F.lit(seed), F.col("word"), F.col("rn")), "rn")
    kept = hits.withColumn("k", F.row_number().over(w)).where(F.col("k") <= per_word)
    first_pos = ctx.groupBy("word").agg(F.min(F.struct("doc_id", "line_no", "sent_no")).alias("_p"))
    return first_in_order(kept.join(first_pos, "word"), ["_p", "word", "k"], max_total).select("word", "sentence")


def language_share(ctx: DataFrame, target_lang: str, min_count: int = 10) -> DataFrame:
    """G7 report: share of target-language sentences among eligible words' sentences."""
    w_all = Window.partitionBy("word")
    elig = ctx.withColumn("_cnt", F.count(F.lit(1)).over(w_all)).where(F.col("_cnt") >= min_count)
    return elig.agg(
        F.count(F.lit(1)).cast("bigint").alias("n_total"),
        F.count_if(F.col("lang") == target_lang).cast("bigint").alias("n_target"),
        F.try_divide(F.count_if(F.col("lang") == target_lang), F.count(F.lit(1))).alias("share"),
    )


def shuffled_sample(ctx: DataFrame, n: int = 10000, seed: int = 42) -> DataFrame:
    """All contexts in hash order, first ``n`` (duplicates kept); exact top-k
    over the down-set of hash prefixes (see ``hash_top_k``)."""
    hashed = ctx.withColumn("_h", hash_key(F.lit(seed), F.col("word"), F.col("rn")))
    return hash_top_k(hashed, "_h", n, ["word", "rn"]).select("word", "rn", "sentence")


def head_contexts(ctx: DataFrame, vocab: DataFrame, n_words: int = 1000, per_word: int = 5,
                  max_total: int = 5000) -> DataFrame:
    """First ``n_words`` words x first ``per_word`` contexts, first ``max_total``."""
    j = ctx.where(F.col("rn") <= per_word).join(vocab.where(F.col("word_idx") < n_words).select("word", "word_idx"),
                                               "word")
    return j.orderBy("word_idx", "rn").limit(max_total).select("word", "word_idx", "rn", "sentence")


def epoch_batches(items: DataFrame, key: str, batch_size: int = 128, epoch: int = 0, seed: int = 42) -> DataFrame:
    """Hash shuffle per (seed, epoch), global index, ``batch_id = idx // bs``;
    a tail batch is kept only with >= 2 rows.  Adds ``idx, batch_id, i`` (position in batch)."""
    h = items.withColumn("_h", hash_key(F.lit(seed), F.lit(epoch), F.col(key)))
    idx, n = indexed_with_count(h, ["_h", key], "idx")
    idx = idx.drop("_h")
    tail_start = (n // batch_size) * batch_size
    keep_tail = (n - tail_start) >= 2
    out = idx.withColumn("batch_id", F.floor(F.col("idx") / batch_size).cast("bigint")).withColumn(
        "i", (F.col("idx") % batch_size).cast("bigint")
    )
    if not keep_tail:
        out = out.where(F.col("idx") < tail_start)
    return out


def hold_out_last(pairs: DataFrame, n_val: int = 10000, key: str = "pair_id") -> DataFrame:
    """The last ``n_val`` aligned pairs (by position) are validation."""
    indexed, n = indexed_with_count(pairs, [key], "_pos")
    return indexed.withColumn("split", F.when(F.col("_pos") >= n - n_val, "val").otherwise("train")).drop("_pos")


def first_n(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """Corpus cap ``[:n]`` in position order."""
    return first_in_order(df, order, n) if n > 0 else df.limit(0)


def early_stopping(history: DataFrame, patience: int = 5) -> DataFrame:
    """Per epoch ``is_best`` (strict improvement over all earlier epochs),
    ``since_best`` and ``stop`` (first epoch with >= patience epochs since the best).

    ``history`` is ``(epoch, val_loss)`` — one row per epoch, a tiny table.
    """
    w_prev = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    h = history.withColumn("_best_before", F.min("val_loss").over(w_prev)).withColumn(
        "is_best", F.col("_best_before").isNull() | (F.col("val_loss") < F.col("_best_before"))
    )
    w_cum = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("_last_best", F.max(F.when(F.col("is_best"), F.col("epoch"))).over(w_cum))
    h = h.withColumn("since_best", (F.col("epoch") - F.col("_last_best")).cast("bigint"))
    first_stop = F.min(F.when(F.col("since_best") >= patience, F.col("epoch"))).over(
        Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    h = h.withColumn("_stop_epoch", first_stop)
    return h.select(
        "epoch", "val_loss", "is_best", "since_best",
        (F.col("epoch") == F.col("_stop_epoch")).alias("stop"),
        (F.col("_stop_epoch").isNull() | (F.col("epoch") <= F.col("_stop_epoch"))).alias("ran"),
    )


def overlap(a: DataFrame, b: DataFrame, col: str = "sentence") -> DataFrame:
    """H5: rows common to both (must be empty for a train/val split)."""
    return a.select(col).intersect(b.select(col))


def difference(a: DataFrame, b: DataFrame, col: str = "sentence") -> DataFrame:
    """H3: ``a`` minus ``b`` (distinct)."""
    return a.select(col).distinct().join(b.select(col), col, "left_anti")


def distinct_sentences(df: DataFrame, col: str = "sentence") -> DataFrame:
    """H2."""
    return df.dropDuplicates([col])
