"""Sub-word pieces and word positions (C9-C17, J1 pieces surface).

Pieces are an *injected* Column function (the model tokenizer of the
reference is not built); the default ``chunk_pieces`` is a deterministic
sentencepiece-like splitter: ``▁`` + first 3 characters, then 3-character
chunks, and a lone ``▁`` before words that start with a digit.
Position search is a higher-order-function expression per row; pieces and positions
are each a one-row ``explode``, which keeps the optimizer from copying their expressions into
the filters and lambdas above (a lambda would cut the sentence anew for every position).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexaria.functions import text as T

MARK = "▁"


def chunk_pieces(word: Column, size: int = 3) -> Column:
    """Sub-word pieces of one word (the J1 default)."""
    chunks = F.regexp_extract_all(word, F.lit(f".{{1,{size}}}"), 0)
    marked = F.transform(chunks, lambda p, i: F.when(i == 0, F.concat(F.lit(MARK), p)).otherwise(p))
    return F.when(word.rlike("^[0-9]"), F.concat(F.array(F.lit(MARK)), chunks)).otherwise(marked)


def sentence_pieces(sentence: Column, pieces=chunk_pieces) -> Column:
    """Pieces of a text: the pieces of each pre-tokenised word, concatenated."""
    return F.flatten(F.transform(T.word_tokens(sentence), lambda w: pieces(w)))


def drop_lone_marker(pieces: Column) -> Column:
    """Drop a lone leading ``▁`` piece."""
    return F.when((F.size(pieces) > 0) & (F.element_at(pieces, 1) == MARK),
                  F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))).otherwise(pieces)


def word_pieces(word: Column, pieces=chunk_pieces, add_space: bool = True) -> Column:
    """``tokenize_word``: pieces of ``' ' + word`` (here: of the word) minus a lone ``▁``."""
    return drop_lone_marker(pieces(word))


def first_position(tokens: Column, wp: Column, start: Column | int = 0) -> Column:
    """First 0-based ``i >= start`` with ``tokens[i : i+m] == wp``; null if none
    (or if ``wp`` is empty).  The ``i >= start`` guard matters because
    ``sequence`` counts down when the word is longer than the rest."""
    start = F.lit(start) if isinstance(start, int) else start
    n, m = F.size(tokens), F.size(wp)
    # the first piece is compared alone: a slice is cut only where it fits
    same = lambda i: (F.get(tokens, i) == F.get(wp, F.lit(0))) & (F.slice(tokens, i + 1, m) == wp)
    cand = F.filter(F.sequence(start, n - m), lambda i: (i >= start) & same(i))
    return F.when(m > 0, F.try_element_at(cand, F.lit(1)))


def first_position_subword(tokens: Column, word: Column, m: Column, start: Column | int = 0) -> Column:
    """C16 sub-word mode: first ``i`` (loop bound still uses the word's piece
    count ``m``) whose token, markers and spaces removed, equals the word."""
    start = F.lit(start) if isinstance(start, int) else start
    n = F.size(tokens)
    cand = F.filter(F.sequence(start, n - m),
                    lambda i: (i >= start) & (F.trim(T.strip_markers(F.element_at(tokens, i + 1))) == word))
    return F.when(m > 0, F.try_element_at(cand, F.lit(1)))


def positions(start_col: Column, m: Column) -> Column:
    """All matched positions ``[i, i+m)`` from the first position."""
    return F.when(start_col.isNotNull(), F.sequence(start_col, start_col + m - 1))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns computed once a row, however often they are used above."""
    one = df.select(*df.columns, F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("_once"))
    return one.select(*df.columns, *[F.col("_once")[k].alias(k) for k in columns])


def find_positions(contexts: DataFrame, max_len: int = 500, strict: bool = False, pieces=chunk_pieces,
                   prompt: str | None = None, subword_mode: bool = False,
                   n_contexts: int | None = None, cap: str = "before") -> DataFrame:
    """C9 + C16 + C17 over a context table ``(word, rn, sentence)``.

    The sentence (prompt-prefixed when given: ``prompt + ' ' + s``, search from the
    prompt's piece count) is split into pieces; sentences longer than ``max_len``
    pieces are skipped (``strict``: ``>= max_len`` as in the historical job); only
    found rows are kept.  ``n_contexts`` keeps that many contexts of a word by ``rn``,
    counted ``before`` or ``after`` the search.  Output adds ``start, n_pieces, pos``.
    """
    if cap not in ("before", "after"):
        raise ValueError(f"cap must be before or after: {cap}")
    if n_contexts and cap == "before":
        contexts = contexts.where(F.col("rn") <= n_contexts)
    text = F.concat(F.lit(prompt + " "), F.col("sentence")) if prompt else F.col("sentence")
    offset = F.size(sentence_pieces(F.lit(prompt), pieces)) if prompt else F.lit(0)
    x = _once(contexts, _t=sentence_pieces(text, pieces), _w=word_pieces(F.col("word"), pieces), _off=offset)
    too_long = F.size("_t") >= max_len if strict else F.size("_t") > max_len
    x = x.where(~too_long)
    if subword_mode:
        x = _once(x, start=first_position_subword(F.col("_t"), F.col("word"), F.size("_w"), F.col("_off")))
        x = x.withColumn("n_pieces", F.lit(1))
    else:
        x = _once(x, start=first_position(F.col("_t"), F.col("_w"), F.col("_off"))).withColumn("n_pieces", F.size("_w"))
    x = x.where(F.col("start").isNotNull())
    if n_contexts and cap == "after":
        nth = F.row_number().over(Window.partitionBy("word").orderBy("rn"))
        x = x.withColumn("_nth", nth).where(F.col("_nth") <= n_contexts).drop("_nth")
    return x.withColumn("pos", positions(F.col("start"), F.col("n_pieces"))).drop("_t", "_w", "_off")


def language_tokens(df: DataFrame, text: str = "sentence", lang: str = "lang", pieces=chunk_pieces) -> DataFrame:
    """C14: ja/zh texts use sub-word pieces without ``▁``, others the word
    pre-tokenizer; an unknown or missing language counts as ``en``."""
    lg = F.coalesce(F.col(lang), F.lit("en"))
    sub = F.filter(F.transform(sentence_pieces(F.col(text), pieces), lambda p: F.replace(p, F.lit(MARK), F.lit(""))),
                   lambda p: p != "")
    return df.withColumn("tokens", F.when(lg.isin("ja", "zh"), sub).otherwise(T.word_tokens(F.col(text))))


def vocabulary_is_lowercase(vocab: DataFrame) -> bool:
    """Every vocabulary word equals its lowercase (one scalar)."""
    v = vocab.agg(F.bool_and(F.col("word") == F.lower("word")).alias("b")).first()["b"]
    return bool(v) if v is not None else True
