"""Vocabulary operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaria.functions import text as T
from lexaria.functions import tokens as TK
from lexaria.functions.ordering import with_global_index

POS = ["doc_id", "line_no", "sent_no"]


def tokens(sents: DataFrame, lowercase: bool = True, punct="P1", tokenizer=None) -> DataFrame:
    """C3 + C4 + C5: ``(doc_id, line_no, sent_no, tok_pos, word)``.

    ``tokenizer`` (J1) maps a string Column to an ``array<string>`` Column;
    the default is the whitespace/punctuation pre-tokenizer expression.
    """
    tok = tokenizer or T.word_tokens
    s = F.lower("sentence") if lowercase else F.col("sentence")
    exploded = sents.select(*POS, F.posexplode(tok(s)).alias("tok_pos", "word"))
    return exploded.select(*POS, F.col("tok_pos").cast("bigint").alias("tok_pos"), "word").where(
        ~T.is_punct(F.col("word"), punct)
    )


# First-occurrence position packed into one decimal(38,0) so the count and the
# min run in a hash aggregate (a struct min forces a sort-based aggregate):
# doc_id * 10^18 + line_no * 10^12 + sent_no * 10^6 + tok_pos.
# Bounds: fewer than 10^6 lines per document, sentences per line and tokens per
# sentence; beyond them the query stops instead of ordering words wrongly.
_E6, _E12, _E18 = 10**6, 10**12, 10**18


def position_key() -> F.Column:
    bound = F.greatest("line_no", "sent_no", "tok_pos") < _E6
    inner = F.when(bound, F.col("line_no") * _E12 + F.col("sent_no") * _E6 + F.col("tok_pos")).otherwise(
        F.raise_error(F.lit("more than 10^6 lines, sentences or tokens in one unit")).cast("bigint"))
    return (F.col("doc_id").cast("decimal(38,0)") * F.lit(_E18).cast("decimal(38,0)")
            + inner.cast("decimal(38,0)")).cast("decimal(38,0)")


def decode_position(key: str = "first_key") -> F.Column:
    doc = F.expr(f"{key} div {_E18}")
    inner = (F.col(key) - doc.cast("decimal(38,0)") * F.lit(_E18).cast("decimal(38,0)")).cast("bigint")
    return F.struct(
        doc.cast("bigint").alias("doc_id"),
        F.call_function("div", inner, F.lit(_E12)).cast("bigint").alias("line_no"),
        (F.call_function("div", inner, F.lit(_E6)) % _E6).cast("bigint").alias("sent_no"),
        (inner % _E6).cast("bigint").alias("tok_pos"),
    )


def word_counts(toks: DataFrame) -> DataFrame:
    """``(word, freq, first_key, first)`` — count and first occurrence (corpus order).

    One hash aggregate with a map-side partial: a hot word is pre-counted in
    every task before the shuffle, so no task receives its raw tokens.
    """
    return _summed(toks, F.count(F.lit(1)))


def _summed(toks: DataFrame, freq: F.Column) -> DataFrame:
    agg = toks.groupBy("word").agg(freq.cast("bigint").alias("freq"), F.min(position_key()).alias("first_key"))
    return agg.withColumn("first", decode_position("first_key"))


COUNT_BYTES = 1 << 23


def sentence_word_counts(sents: DataFrame) -> DataFrame:
    """E3 over sentences: the rows of ``word_counts(tokens(sents))``.

    Sentences are cut (C3 + C4 + C5) and their words counted some megabytes of text at a time where they lie, so no row
    is made for a token; the aggregate gets a word of such a piece once, with its count and first position there.
    """
    runs = TK.char_runs(sents.sparkSession)

    def run(batches):
        chars, held, size = TK.table(runs), [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= COUNT_BYTES:
                yield _piece_counts(held, chars)
                held, size = [], 0
        if held:
            yield _piece_counts(held, chars)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sents.select(*POS).schema)
    rows = sents.select(*POS, F.lower("sentence").alias("sentence")).mapInArrow(run, f"{kinds}, tok_pos long, word string, n long")
    return _summed(rows, F.sum("n"))


def _piece_counts(held: list[pa.RecordBatch], chars: np.ndarray) -> pa.RecordBatch:
    """A row for every word of the sentences: where it stands first, and how often it occurs."""
    t = pa.Table.from_batches(held).combine_chunks()
    none = pa.array([], pa.string())
    cut = [x[2:] for c in t.column("sentence").chunks for x in TK.cut_texts(c, chars)]
    tokens = pa.concat_arrays([none, *(x[0] for x in cut)]).dictionary_encode()
    sizes, places = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in cut)]) for k in (1, 2))
    ids, row = tokens.indices.to_numpy(), np.repeat(np.arange(t.num_rows), sizes)
    line, sent = (t.column(c).to_numpy() for c in POS[1:])
    if len(row) and max(line[row].max(), sent[row].max(), places.max()) >= _E6:
        raise ValueError("more than 10^6 lines, sentences or tokens in one unit")
    # sentences in corpus order, those of no document last
    doc = t.column("doc_id")
    order = np.lexsort((sent, line, doc.fill_null(0).to_numpy(), doc.is_null().to_numpy()))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    if (rank[1:] < rank[:-1]).any():
        by = np.argsort(rank[row], kind="stable")
        ids, row, places = ids[by], row[by], places[by]
    first = np.zeros(len(tokens.dictionary), np.int64)
    first[ids[::-1]] = np.arange(len(ids))[::-1]  # the last to be written is the first in order
    at = t.select(POS).take(pa.array(row[first]))
    return pa.RecordBatch.from_arrays([*(at.column(c).combine_chunks() for c in POS), pa.array(places[first]), tokens.dictionary,
                                       pa.array(np.bincount(ids, minlength=len(first)))], [*POS, "tok_pos", "word", "n"])


def filter_vocabulary(
    counts: DataFrame, min_freq: int = 10, min_len: int = 3, max_size: int | None = None
) -> DataFrame:
    """C7 + E4 + G2: ``(word, freq, word_idx)`` in order freq desc, first occurrence.

    The ranking is a distributed range sort plus per-partition offsets, so the
    top-k cut never merges all partitions' candidates in one task.
    """
    kept = counts.where(
        (F.col("freq") >= min_freq) & (F.length("word") >= min_len) & T.valid_word(F.col("word"))
    )
    ranked = with_global_index(
        kept.select("word", "freq", "first_key"), [F.col("freq").desc(), F.col("first_key")], name="word_idx"
    )
    if max_size:
        ranked = ranked.where(F.col("word_idx") < max_size)
    return ranked.select("word", "freq", "word_idx")


def token_frequencies(token_ids: DataFrame, col: str = "tokens") -> DataFrame:
    """Frequency of every token id over a column of token-id arrays."""
    return token_ids.select(F.explode(col).alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).cast("bigint").alias("n")
    )


def word_at(vocab: DataFrame, indexes: DataFrame) -> DataFrame:
    """The words at the given ``word_idx`` values (absent ones are left out)."""
    return indexes.select("word_idx").join(vocab.select("word_idx", "word"), "word_idx")


def index_of(vocab: DataFrame, words: DataFrame) -> DataFrame:
    """The indexes of the given ``word`` values (absent ones are left out)."""
    return words.select("word").join(vocab.select("word", "word_idx"), "word")


def union_vocabularies(*vocabs: DataFrame) -> DataFrame:
    """H1: distinct union of several vocabularies' words."""
    out = vocabs[0].select("word")
    for v in vocabs[1:]:
        out = out.unionByName(v.select("word"))
    return out.distinct()
