"""Word-vector lookup and sentence encoding.

Plan of an encode, in two phases.  Sentences are packed into lots of about ``LOT_TOKENS`` tokens where
they lie: a lot is one row with its keys, its distinct words and the numbers of its words,
written to the shared checkpoint folder.  First the distinct words of all lots are resolved, each
once (one join on the candidates of a word: itself, its lower case, its piece prefixes), and
the lots' words join what was found.  Then every lot meets its vectors and multiplies
sentence-by-word counts with them in blocks.  What is shuffled is a word of a lot or a lot, never a
token, a vector of a lot travels once, and the plan is the same for any size of the vector table:
vectors are joined by sorting, never collected by the driver for a broadcast, so repeated encodes (the
micro-batches of a stream) cost the driver nothing.  A pair of sentences shares a lot, which multiplies them
where they meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexaria.functions import text as T
from lexaria.functions import vectors as Vx
from lexaria.functions.arrow import lists

LOT_TOKENS = 1 << 20
BLOCK_TOKENS = 1 << 14
OUT_SENTENCES = 1 << 14


def _prefixes(pieces: Column) -> Column:
    """The words that the proper prefixes of the pieces spell, the longest first, markers removed."""
    n = F.size(pieces) - 1
    spell = lambda k: T.strip_markers(F.array_join(F.slice(pieces, 1, n - k), ""))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), spell)).otherwise(F.array().cast("array<string>"))


def _with_lower(words: Column) -> Column:
    return F.flatten(F.transform(words, lambda w: F.array(w, F.lower(w))))


def candidates(word: Column, pieces=None) -> Column:
    """What a word is looked up as, in order: itself, its lower case, then the same for its piece prefixes."""
    own = F.array(word)
    return F.array_distinct(_with_lower(own if pieces is None else F.concat(own, _prefixes(pieces(word)))))


def resolve(asked: DataFrame, word_vectors: DataFrame, by: list[str], cands: str = "cands") -> DataFrame:
    """``by`` and the vector of the first candidate that has one; rows without any are left out."""
    one = asked.select(*by, F.posexplode(cands).alias("_rank", "_key"))
    hits = one.join(word_vectors.select(F.col("word").alias("_key"), "vec").hint("merge"), "_key")
    return hits.groupBy(*by).agg(F.min_by("vec", "_rank").alias("vec"))


def lookup(words: DataFrame, word_vectors: DataFrame, word_col: str = "word") -> DataFrame:
    """Exact word, else its lowercase; adds ``vec`` (null when both miss).

    Distinct words are resolved once, so the vectors meet every word once.
    """
    one = words.select(F.col(word_col).alias("_word")).where("_word is not null").distinct()
    found = resolve(one.withColumn("cands", candidates(F.col("_word"))), word_vectors, ["_word"])
    return words.join(found, F.col(word_col) == F.col("_word"), "left").drop("_word")


def subword_lookup(oov: DataFrame, word_vectors: DataFrame, pieces_col: str = "pieces") -> DataFrame:
    """Longest proper prefix of the sub-word pieces found (exact, else lowercase).

    Input ``(word, pieces array<string>)`` — distinct OOV words only; prefixes
    of 1..n-1 pieces (never the full list; needs more than one piece), markers
    ``##`` and ``▁`` removed.  Output ``(word, vec)`` for words with a hit.
    """
    return resolve(oov.select("word", _with_lower(_prefixes(F.col(pieces_col))).alias("cands")), word_vectors, ["word"])


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


LOT_ROW = "lot long, keys array<{key}>, sizes array<int>, ids array<int>, words array<string>"


def _lot(held, number: int) -> pa.RecordBatch:
    """One row: the keys of the sentences held, their sizes, and their words as numbers into the distinct words."""
    t = pa.Table.from_batches(held).combine_chunks()
    toks = t.column("toks").chunk(0).fill_null([])
    words = toks.flatten().dictionary_encode()
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    sizes = toks.value_lengths().cast(pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), one(t.column("key").chunk(0)), one(sizes), one(words.indices),
                                       one(words.dictionary)], ["lot", "keys", "sizes", "ids", "words"])


def _pack(batches):
    """One row per lot; the lot's number is made of the partition and a count."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 33
    held, tokens = [], 0
    for batch in batches:
        size = np.asarray(batch.column("toks").value_lengths().fill_null(0)) + 1
        ends, start = np.cumsum(size), 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + LOT_TOKENS - tokens, side="right")))
            held.append(batch.slice(start, stop - start))
            tokens += int(ends[stop - 1] - base)
            start = stop
            if tokens >= LOT_TOKENS:
                yield _lot(held, number)
                held, tokens, number = [], 0, number + 1
    if held:
        yield _lot(held, number)


def pack_groups(by: str):
    """``_pack`` for rows sorted by the key's field ``by``: a lot ends only where that field changes."""
    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        held, tokens, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = np.r_[0, np.cumsum(np.asarray(batch.column("toks").value_lengths().fill_null(0)) + 1)]
            group = batch.column("key").field(by).to_numpy(zero_copy_only=False)
            edges = [*np.flatnonzero(np.r_[last is None or group[0] != last, group[1:] != group[:-1]]), batch.num_rows]
            start = 0
            for a in edges:
                if tokens + ends[a] - ends[start] >= LOT_TOKENS and (a < batch.num_rows):
                    if a > start:
                        held.append(batch.slice(start, a - start))
                    yield _lot(held, number)
                    held, tokens, number, start = [], 0, number + 1, a
            if batch.num_rows > start:
                held.append(batch.slice(start))
                tokens += int(ends[-1] - ends[start])
            last = group[-1]
        if held:
            yield _lot(held, number)

    return run


def with_vectors(lots: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of a lot together, the lot itself first, then what was found for its words (``lot, at, ...``).

    The lists of the other rows are empty, not null: Arrow's writer goes back over a run of null lists for every
    row it adds, which takes the square of a batch.
    """
    heads = lots.select("lot", "keys", "sizes", "ids")
    none = [F.array().cast(heads.schema[c].dataType).alias(c) for c in ("keys", "sizes", "ids")]
    both = heads.unionByName(found.select("*", *none), allowMissingColumns=True)
    return both.repartition("lot").sortWithinPartitions(F.col("lot"), F.col("at").asc_nulls_first())


def each_lot(batches):
    """(the lot's row, its other rows as batches) from rows of ``with_vectors``."""
    head, rest = None, []
    for batch in batches:
        is_head = batch.column("at").is_null().to_numpy(zero_copy_only=False)
        edge = [*np.flatnonzero(is_head), batch.num_rows]
        for a, b in zip([0, *edge[:-1]], edge):
            if b <= a and not (a < batch.num_rows and is_head[a]):
                continue
            rows = batch.slice(a, b - a)
            if is_head[a]:
                if head is not None:
                    yield head, rest
                head, rest = pa.Table.from_batches([rows.slice(0, 1)]), []
                rows = rows.slice(1)
            if rows.num_rows:
                rest.append(rows)
    if head is not None:
        yield head, rest


def sentence_sums(ids: np.ndarray, sizes: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Sum of the rows ``m[ids]`` of every sentence, about BLOCK_TOKENS tokens at a time."""
    out = np.zeros((len(sizes), m.shape[1]))
    full = np.flatnonzero(sizes)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(full):
        base = ends[full[start]] - sizes[full[start]]
        stop = max(start + 1, int(np.searchsorted(ends[full], base + BLOCK_TOKENS, side="right")))
        rows = full[start:stop]
        at = ends[rows] - sizes[rows] - base
        out[rows] = np.add.reduceat(m[ids[base:ends[rows[-1]]]], at, axis=0)
        start = stop
    return out


def _lot_parts(head, rest, dim: int, per: int = 1):
    """Keys, sizes, ids and the words' vectors of a lot (a last column tells the known words), some keys of ``per`` sentences at a time."""
    keys, sizes, ids = (head.column(c).chunk(0).flatten() for c in ("keys", "sizes", "ids"))
    sizes, ids = sizes.to_numpy().astype(np.int64), ids.to_numpy()
    n_words = int(ids.max()) + 1 if len(ids) else 0
    m = np.zeros((n_words, dim + 1))
    for rows in rest:
        at = rows.column("at").to_numpy(zero_copy_only=False).astype(np.int64)
        m[at, :dim], m[at, dim] = rows.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), 1.0
    ends, step = np.r_[0, np.cumsum(sizes)], max(1, OUT_SENTENCES // per)
    for a in range(0, len(keys), step):
        b = min(a + step, len(keys))
        yield keys.slice(a, b - a), sizes[a:b], ids[ends[a]:ends[b]], m


def _vectors(ids, sizes, m, reduce: str, normalize: bool):
    """The sentences' vectors and how many of their tokens are known."""
    sums = sentence_sums(ids, sizes, m)
    vec, n = sums[:, :-1], sums[:, -1]
    if reduce == "mean":
        vec = vec / np.maximum(n, 1.0)[:, None]
    if normalize:
        vec = vec / (np.sqrt((vec * vec).sum(1)) + 1e-8)[:, None]
    return vec, n


def _encode_lots(dim: int, reduce: str, normalize: bool):
    def run(batches):
        for head, rest in each_lot(batches):
            for keys, sizes, ids, m in _lot_parts(head, rest, dim):
                vec, n = _vectors(ids, sizes, m, reduce, normalize)
                yield pa.RecordBatch.from_arrays([keys, lists(vec), pa.array(n)], ["key", "vec", "_n"])

    return run


def _multiply_lots(dim: int, reduce: str, normalize: bool):
    """Per pair the dot product of its two sentences and how many of them have a known word; the vector of a lone one."""
    def run(batches):
        for head, rest in each_lot(batches):
            for keys, sizes, ids, m in _lot_parts(head, rest, dim, 2):
                first = keys.field("_first").to_numpy(zero_copy_only=False)
                vec, n = _vectors(ids, np.column_stack([first, sizes - first]).ravel(), m, reduce, normalize)
                known = (n > 0).reshape(-1, 2)
                both = vec.reshape(-1, 2, dim)
                lone = known.sum(1) == 1
                some = lists(both[lone][known[lone]])
                place = np.where(lone, np.cumsum(lone) - 1, -1)
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.einsum("ij,ij->i", both[:, 0], both[:, 1])), pa.array(known.sum(1)),
                                                  some.take(pa.array(place, mask=~lone))], ["key", "sim", "_n", "vec"])

    return run


def _dim(word_vectors: DataFrame, dim: int | None) -> int:
    return int(word_vectors.select(F.max(F.size("vec"))).first()[0] or 0) if dim is None else dim


def _tokens(text: str, punct, tokenizer) -> Column:
    return T.drop_punct((tokenizer or T.word_tokens)(F.col(text)), punct)


def _lots_with_vectors(src: DataFrame, word_vectors: DataFrame, pieces) -> tuple[str, DataFrame]:
    """The type of ``key`` and the lots of ``(key, toks)`` with the vectors of their words."""
    kind = src.schema["key"].dataType.simpleString()
    lots = src.mapInArrow(_pack, LOT_ROW.format(key=kind)).checkpoint(eager=True)  # numbers are fixed from here on
    words = lots.select(F.explode("words").alias("word")).distinct()
    known = resolve(words.withColumn("cands", candidates(F.col("word"), pieces)),
                    word_vectors.select("word", Vx.as_double("vec").alias("vec")), ["word"])
    asked = lots.select("lot", F.posexplode("words").alias("at", "word"))
    return kind, with_vectors(lots, asked.join(known.hint("merge"), "word").select("lot", "at", "vec"))


def encode(sents: DataFrame, word_vectors: DataFrame, key="sent_id", text: str = "text",
           dim: int | None = None, normalize: bool = True, reduce: str = "mean",
           on_empty: str = "zero", punct="P1", tokenizer=None, pieces=None) -> DataFrame:
    """E13 (mean, zero vector when no word hits), E14 (``reduce='sum'``),
    E15 (``on_empty='drop'``; raises when nothing is left).

    ``key`` is one column or a list; every input row gives one row.  ``pieces`` (J1) maps a word
    Column to its sub-word pieces and enables D2 for words missing both exact and lowercase lookups.
    """
    keys = _keys(key)
    dim = _dim(word_vectors, dim)
    src = sents.select(F.struct(*keys).alias("key"), _tokens(text, punct, tokenizer).alias("toks"))
    kind, both = _lots_with_vectors(src, word_vectors, pieces)
    out = both.mapInArrow(_encode_lots(dim, reduce, normalize), f"key {kind}, vec array<double>, _n double")
    if on_empty == "drop":
        out = out.where(F.col("_n") > 0)
    return out.select(*[F.col("key")[k].alias(k) for k in keys], "vec")


def encode_nonempty(sents: DataFrame, word_vectors: DataFrame, **kw) -> DataFrame:
    """E15 with its error: no sentence has a known word -> ValueError."""
    out = encode(sents, word_vectors, on_empty="drop", **kw)
    if out.limit(1).count() == 0:
        raise ValueError("no sentence could be encoded")
    return out


def pair_similarity(pairs: DataFrame, word_vectors: DataFrame, dim: int | None = None,
                    normalize: bool = True, key="pair_id", **kw) -> DataFrame:
    """Encode both sides of every pair and take the dot product.

    ``pairs`` is ``(key..., a, b)``; output ``(key..., sim)``; ``key`` (one column or a
    list) names a pair.  The tokens of both sides lie in one row of a lot, so what is shuffled
    behind the lots is a number a pair, not its vectors.
    """
    return _pair_similarity(pairs, word_vectors, _dim(word_vectors, dim), _keys(key), normalize, **kw)


def _pair_similarity(pairs, word_vectors, dim, ids, normalize, reduce: str = "mean", punct="P1", tokenizer=None, pieces=None):
    side = lambda c: F.coalesce(_tokens(c, punct, tokenizer), F.array().cast("array<string>"))
    cut = pairs.select(*ids, side("a").alias("_a"), side("b").alias("_b"))
    src = cut.select(F.struct(*ids, F.size("_a").alias("_first")).alias("key"), F.concat("_a", "_b").alias("toks"))
    kind, both = _lots_with_vectors(src, word_vectors, pieces)
    got = both.mapInArrow(_multiply_lots(dim, reduce, normalize), f"key {kind}, sim double, _n long, vec array<double>")
    # rows that share a key are one pair: it is scored if just two of their sides have a known word
    got = got.groupBy(*[F.col("key")[c].alias(c) for c in ids]).agg(
        F.sum("_n").alias("_n"), F.max(F.when(F.col("_n") == 2, F.col("sim"))).alias("_s"), F.collect_list("vec").alias("_vs"))
    lone = F.when(F.size("_vs") == 2, Vx.dot(F.col("_vs")[0], F.col("_vs")[1]))
    sim = F.when(F.col("_n") == 2, F.coalesce("_s", lone)).otherwise(F.lit(0.0))
    return pairs.select(*ids).join(got.select(*ids, sim.alias("sim")), ids, "left").select(
        *ids, F.coalesce("sim", F.lit(0.0)).alias("sim"))


def project(sent_vecs: DataFrame, weight_rows: list[list[float]], vec: str = "vec") -> DataFrame:
    """F15 tail: linear layer ``W x`` (``W`` is k x d, a bounded parameter) then L2 clamp-normalise."""
    w = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in weight_rows])
    return sent_vecs.withColumn(vec, Vx.l2_normalize_clamped(Vx.matvec(w, vec)))
