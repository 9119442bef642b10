"""Hidden Markov language model (operator 3).

Tokens: words of the lower-cased (A-Z) text and one end token.  Counts c of every training
word, their total N and number V come from all training documents.

Model: latent states emit classes of words.  The end token and the ``OWN`` most frequent
words are classes of their own; the others fall into ``SUFFIX`` classes by their last three
bytes, and inside a class a word has probability (c + 0.1) / (sum of c + 0.1 (words + 1)), one share
of 0.1 being left for unseen words.  So the log probability of a text is the HMM's
log probability of its class sequence (scaled forward recursion over the whole text) plus a
sum over words.

Training: Baum-Welch.  Every pass runs forward-backward over whole training documents, tasks send
their expected counts per class, Spark sums them, and the driver normalises ``STATES`` x classes
numbers.  A text above ``LONG`` tokens is cut into parts that are worked side by side; transfer
matrices of the parts carry the forward and backward messages over the cuts, so its counts are
those of the whole text.  The start comes from a bounded sample (``SAMPLE_DOCS`` documents):
clusters of documents, then a few local passes.

Scale: the counts of the ``FREQUENT`` most frequent words are broadcast (a fixed number);
other words meet their counts by a shuffled join of (document, word, times) rows.
The class sequences are written once, two bytes a token, and read by every pass.

Cases: null text is empty: the end token alone; a document with null id is held out (never
trained on); repeated rows are trained on and scored each; without any training document
every class has its smoothed share (base and score stay finite); an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaria.llm.common import held_out, store, text_slices

FREQUENT = 131_072
OWN = 16_384
SUFFIX = 2_048
CLASSES = 1 + OWN + SUFFIX
STATES = 8
LONG = 8_192
PART = 256
PARTS_AT_ONCE = 512
LOT = 300_000
SAMPLE_DOCS = 400
SAMPLE_TOKENS = 300_000
LOCAL_PASSES = 6
PASSES = 3
BACKOFF = 500.0
FLUSH = 400_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def suffix_class(word: bytes) -> int:
    return 1 + OWN + zlib.crc32(word[-3:]) % SUFFIX


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, class, n) over the training documents."""
    def run(batches):
        seen: Counter = Counter()

        def rows():
            words = list(seen)
            out = pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array([suffix_class(w) for w in words], pa.int32()),
                 pa.array(seen.values(), pa.int64())], ["word", "class", "n"])
            seen.clear()
            return out

        for part in text_slices(batches, "text"):
            for t in part.column("text").to_pylist():
                seen.update(words_of(t))
            if len(seen) > FLUSH:
                yield rows()
        yield rows()

    parts = docs.where("not held_out").select("text").mapInArrow(run, "word binary, class int, n long")
    return parts.groupBy("word", "class").agg(F.sum("n").alias("n"))


class Lexicon:
    """The frequent words with their counts, and the totals; a fixed number of entries."""

    def __init__(self, words, n, classes, total, distinct, n_docs, class_words, class_total):
        self.total, self.distinct = total + n_docs, distinct + (n_docs > 0)
        self.z = self.total + 0.1 * (self.distinct + 1)
        own = min(OWN, len(words))
        np.subtract.at(class_words, classes[:own], 1)
        np.subtract.at(class_total, classes[:own], n[:own])
        mass = np.zeros(CLASSES)
        mass[0] = n_docs + 0.1
        mass[1:own + 1] = n[:own] + 0.1
        room = class_total + 0.1 * (class_words + 1)
        mass[1 + OWN:] = room[1 + OWN:]
        self.share = mass / mass.sum()
        self.log_room = np.log10(np.maximum(room, 0.1))
        self.index = {w: i for i, w in enumerate(words)}
        self.cls = np.where(np.arange(len(words)) < own, np.arange(1, len(words) + 1), classes).astype(np.uint16)
        self.base = np.log10((n + 0.1) / self.z)
        self.inner = np.where(np.arange(len(words)) < own, 0.0, np.log10(n + 0.1) - self.log_room[classes])
        self.end_base = float(np.log10((n_docs + 0.1) / self.z))
        self.end_known = int(n_docs > 0)


def lexicon(counts: DataFrame, n_docs: int) -> Lexicon:
    total = counts.groupBy("class").agg(F.count("*").alias("v"), F.sum("n").alias("n")).toArrow()  # at most SUFFIX rows
    c, v, n = (total.column(k).to_numpy() for k in ("class", "v", "n"))
    class_words, class_total = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    class_words[c], class_total[c] = v, n
    top = counts.orderBy(F.desc("n"), "word").limit(FREQUENT).toArrow()
    return Lexicon(top.column("word").to_pylist(), top.column("n").to_numpy().astype(np.int64),
                   top.column("class").to_numpy().astype(np.int64), int(n.sum()), int(v.sum()), n_docs, class_words, class_total)


def encoded(docs: DataFrame, sent) -> DataFrame:
    """Class sequence of every document, what the frequent words add up to, and the other words."""
    def run(batches):
        lex: Lexicon = sent.value
        get = lex.index.get
        for part in text_slices(batches, "text"):
            seqs, n_tokens, known, base, inner, rare = [], [], [], [], [], []
            for t in part.column("text").to_pylist():
                words = words_of(t)
                at = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
                seq = np.zeros(len(words) + 1, np.uint16)
                seen = at >= 0
                hit = at[seen]
                if len(hit):
                    seq[:-1][seen] = lex.cls[hit]
                other: Counter = Counter()
                for i in np.flatnonzero(~seen):
                    seq[i] = suffix_class(words[i])
                    other[words[i]] += 1
                seqs.append(seq.tobytes())
                n_tokens.append(len(seq))
                known.append(len(hit) + lex.end_known)
                base.append(float(lex.base[hit].sum()) + lex.end_base)
                inner.append(float(lex.inner[hit].sum()))
                rare.append([{"word": w, "times": k, "room": float(lex.log_room[suffix_class(w)])} for w, k in other.items()])
            kind = pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int32()), ("room", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), part.column("doc_id"), part.column("held_out"), pa.array(n_tokens, pa.int64()),
                 pa.array(known, pa.int64()), pa.array(base), pa.array(inner), pa.array(seqs, pa.binary()), pa.array(rare, kind)],
                ["row", "doc_id", "held_out", "n_tokens", "known", "base", "inner", "seq", "rare"])

    return docs.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, "
                                "inner double, seq binary, rare array<struct<word:binary,times:int,room:double>>")


class Hmm:
    """Parameters: first-state shares, transitions, emissions."""

    def __init__(self, first, move, emit):
        self.first, self.move, self.emit = first, move, emit  # emit: (classes, states)


class Expected:
    """Expected counts of one or many texts."""

    def __init__(self, states: int):
        self.first, self.move = np.zeros(states), np.zeros((states, states))
        self.emit = np.zeros((CLASSES, states))
        self.log = 0.0

    def model(self, share: np.ndarray) -> Hmm:
        norm = lambda x: (x + 0.1) / (x + 0.1).sum(-1, keepdims=True)
        emit = (self.emit + BACKOFF * share[:, None]) / (self.emit.sum(0) + BACKOFF)
        return Hmm(norm(self.first), norm(self.move), emit)


def _by_length(seqs: list[np.ndarray]):
    """Sequences from the longest down, laid out step by step: step t is ``flat[at[t]:at[t + 1]]``."""
    order = np.argsort([-len(s) for s in seqs], kind="stable")
    size = np.array([len(seqs[i]) for i in order])
    at = np.concatenate([[0], np.cumsum(np.searchsorted(-size, -np.arange(size[0]), side="left"))])
    flat = np.empty(at[-1], np.int32)
    for k, i in enumerate(order):
        flat[at[:size[k]] + k] = seqs[i]
    return order, size, flat, at


def expect(model: Hmm, seqs: list[np.ndarray], begin: np.ndarray, end: np.ndarray, out: Expected) -> np.ndarray:
    """Add the expected emissions and inner transitions of sequences; their first-state shares are returned.

    ``begin``: state shares before the first token; ``end``: what follows the last token, by its
    state, up to a factor (ones where the text ends).
    """
    order, size, flat, at = _by_length(seqs)
    rows, s = len(seqs), len(model.first)
    alpha, scale = np.empty((len(flat), s)), np.empty(len(flat))
    a = begin[order]
    for t in range(len(at) - 1):
        lo, hi = at[t], at[t + 1]
        a = (a if t == 0 else a[:hi - lo] @ model.move) * model.emit[flat[lo:hi]]
        c = a.sum(1)
        a /= c[:, None]
        alpha[lo:hi], scale[lo:hi] = a, c
    out.log += float(np.log(scale).sum())
    beta = end[order]
    beta = beta / (alpha[at[size - 1] + np.arange(rows)] * beta).sum(1, keepdims=True)
    move, back = np.zeros((s, s)), np.ascontiguousarray(model.move.T)
    for t in range(len(at) - 2, -1, -1):
        lo, hi = at[t], at[t + 1]
        if t + 2 < len(at):
            n = at[t + 2] - hi
            ahead = model.emit[flat[hi:hi + n]] * beta[:n] / scale[hi:hi + n, None]
            move += alpha[lo:lo + n].T @ ahead
            beta[:n] = ahead @ back
        alpha[lo:hi] *= beta[:hi - lo]  # from here on the state shares given the whole text
    out.move += move * model.move
    for i in range(s):
        out.emit[:, i] += np.bincount(flat, alpha[:, i], minlength=CLASSES)
    first = np.empty((rows, s))
    first[order] = alpha[:rows]
    return first


def _advance(model: Hmm, begin: np.ndarray, flat: np.ndarray, at: np.ndarray):
    """Scaled forward recursion of rows from the longest down: final shares and log scales."""
    final, log = begin.copy(), np.zeros(len(begin))
    a = begin
    for t in range(len(at) - 1):
        k = at[t + 1] - at[t]
        if k < len(a):
            final[k:len(a)] = a[k:]
            a = a[:k]
        a = (a if t == 0 else a @ model.move) * model.emit[flat[at[t]:at[t + 1]]]
        c = a.sum(1)
        a = a / c[:, None]
        log[:k] += np.log(c)
    final[:len(a)] = a
    return final, log


def _cut(seq: np.ndarray) -> list[np.ndarray]:
    return [seq[a:a + PART] for a in range(0, len(seq), PART)]


def transfers(model: Hmm, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of every part, the recursion from every single state: final shares (parts, states, states) and log scales."""
    s = len(model.first)
    finals, logs = [], []
    for a in range(0, len(parts), PARTS_AT_ONCE):
        some = parts[a:a + PARTS_AT_ONCE]
        order, _, flat, at = _by_length([p for p in some for _ in range(s)])
        final, log = _advance(model, np.tile(np.eye(s), (len(some), 1))[order], flat, at)
        back = np.argsort(order)
        finals.append(final[back].reshape(len(some), s, s))
        logs.append(log[back].reshape(len(some), s))
    return np.concatenate(finals), np.concatenate(logs)


def _forward(model: Hmm, final: np.ndarray, log: np.ndarray):
    """State shares before the first and after the last token of the parts of one text, and its log probability."""
    begin, last, total = np.empty_like(log), np.empty_like(log), 0.0
    state = model.first
    for w in range(len(log)):
        top = log[w].max()
        v = (state * np.exp(log[w] - top)) @ final[w]
        begin[w], last[w] = state, v / v.sum()
        total += top + np.log(v.sum())
        state = last[w] @ model.move
    return begin, last, total


def _expect_long(model: Hmm, seq: np.ndarray, out: Expected) -> None:
    """Expected counts of one long text, its parts side by side between exact messages."""
    parts = _cut(seq)
    final, log = transfers(model, parts)
    begin, last, _ = _forward(model, final, log)
    end, ahead = np.ones_like(log), np.empty_like(log)  # behind the last token; from the first token on
    for w in range(len(parts) - 1, -1, -1):
        r = np.exp(log[w] - log[w].max()) * (final[w] @ end[w])
        ahead[w] = r / r.sum()
        if w:
            end[w - 1] = model.move @ ahead[w]
    over = last[:-1, :, None] * model.move * ahead[1:, None, :]  # transitions over the cuts
    out.move += (over / over.sum((1, 2), keepdims=True)).sum(0)
    for a in range(0, len(parts), PARTS_AT_ONCE):
        b = a + PARTS_AT_ONCE
        first = expect(model, parts[a:b], begin[a:b], end[a:b], out)
        if a == 0:
            out.first += first[0]


def _expect_all(model: Hmm, seqs: list[np.ndarray], out: Expected) -> None:
    short = sorted((q for q in seqs if len(q) <= LONG), key=len)  # texts of like length share their steps
    size = np.cumsum([len(q) for q in short])
    a = 0
    while a < len(short):
        b = max(a + 1, int(np.searchsorted(size, size[a] - len(short[a]) + LOT, side="right")))
        begin = np.tile(model.first, (b - a, 1))
        out.first += expect(model, short[a:b], begin, np.ones_like(begin), out).sum(0)
        a = b
    for q in seqs:
        if len(q) > LONG:
            _expect_long(model, q, out)


def log_likelihood(model: Hmm, seqs: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of every class sequence, exact.

    A sequence above ``LONG`` tokens is cut into parts whose transfer matrices (the
    recursion from every single state) are computed side by side and then multiplied.
    """
    out = np.zeros(len(seqs))
    short = [i for i, q in enumerate(seqs) if len(q) <= LONG]
    if short:
        order, _, flat, at = _by_length([seqs[i] for i in short])
        _, log = _advance(model, np.tile(model.first, (len(short), 1)), flat, at)
        out[np.array(short)[order]] = log
    for i, q in enumerate(seqs):
        if len(q) > LONG:
            out[i] = _forward(model, *transfers(model, _cut(q)))[2]
    return out


def start(seqs: list[np.ndarray], share: np.ndarray, states: int, seed: int = 3) -> Hmm:
    """From a bounded sample: documents clustered by their classes, then local passes."""
    rng = np.random.default_rng(seed)
    out = Expected(states)
    if seqs:
        x = np.stack([np.bincount(q, minlength=CLASSES) for q in seqs]).astype(np.float32)
        y = np.sqrt(x) / np.sqrt(np.maximum(x.sum(1), 1))[:, None]
        c = y[[int(rng.integers(len(y)))]]
        while len(c) < states:  # far apart first centres
            c = np.vstack([c, y[[int((y @ c.T).max(1).argmin())]]])
        for _ in range(8):
            a = (y @ c.T).argmax(1)
            c = np.stack([y[a == k].mean(0) if (a == k).any() else c[k] for k in range(states)])
            c /= np.maximum(np.sqrt((c * c).sum(1)), 1e-9)[:, None]
        for k in range(states):
            out.emit[:, k] = x[a == k].sum(0)
    out.emit += 1e-3 * rng.random(out.emit.shape)
    out.move = np.eye(states) * 20 + 1
    model = out.model(share)
    for _ in range(LOCAL_PASSES if seqs else 0):
        out = Expected(states)
        _expect_all(model, seqs, out)
        model = out.model(share)
    return model


def _sequences(batches, tokens: int = 500_000):
    """Decoded class sequences in lots of bounded length."""
    for batch in batches:
        lot, size = [], 0
        for i, raw in enumerate(batch.column("seq").to_pylist()):
            lot.append(np.frombuffer(raw, np.uint16))
            size += len(lot[-1])
            if size >= tokens:
                yield batch.slice(i + 1 - len(lot), len(lot)), lot
                lot, size = [], 0
        if lot:
            yield batch.slice(batch.num_rows - len(lot), len(lot)), lot


def one_pass(train: DataFrame, model: Hmm, share: np.ndarray) -> tuple[Hmm, float]:
    """One Baum-Welch pass over all training documents; also the log probability before it."""
    sent = train.sparkSession.sparkContext.broadcast(model)
    s = len(model.first)

    def run(batches):
        got = Expected(s)
        for _, seqs in _sequences(batches, 4_000_000):
            _expect_all(sent.value, seqs, got)
        rows = [got.emit, got.move, got.first[None], np.full((1, s), got.log / s)]
        kind = np.repeat(np.arange(4), [len(r) for r in rows])
        at = np.concatenate([np.arange(len(r)) for r in rows])
        val = np.concatenate(rows)
        some = val.any(axis=1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(kind[some].astype(np.int32)), pa.array(at[some].astype(np.int32))] + [pa.array(val[some, i]) for i in range(s)],
            ["kind", "at"] + [f"v{i}" for i in range(s)])

    schema = "kind int, at int, " + ", ".join(f"v{i} double" for i in range(s))
    sums = train.select("seq").mapInArrow(run, schema).groupBy("kind", "at").agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(s)])
    got = sums.toArrow()  # classes + states + 2 rows
    out = Expected(s)
    kind, at = got.column("kind").to_numpy(), got.column("at").to_numpy()
    val = np.stack([got.column(f"v{i}").to_numpy() for i in range(s)], axis=1)
    out.emit[at[kind == 0]] = val[kind == 0]
    out.move[at[kind == 1]] = val[kind == 1]
    out.first += val[kind == 2].sum(0)
    sent.unpersist()
    return out.model(share), float(val[kind == 3].sum())


def score(docs: DataFrame, folds: int = 10, states: int = STATES, passes: int = PASSES, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) per document."""
    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                      held_out(F.col(id_col), folds).alias("held_out"), F.col(text_col).alias("text"))
    counts = store(word_counts(src), "hmm-counts")
    lex = lexicon(counts, src.where("not held_out").count())
    rows = store(encoded(src, docs.sparkSession.sparkContext.broadcast(lex)), "hmm-encoded")

    train = rows.where("not held_out")
    drawn = train.select("seq", F.xxhash64("seq", "doc_id").alias("h"), "n_tokens").where(f"n_tokens <= {LONG}")
    drawn = drawn.orderBy("h").limit(SAMPLE_DOCS).select("seq").toArrow().column("seq").to_pylist()
    sample, size = [], 0
    for raw in drawn:
        size += len(raw) // 2
        if size > SAMPLE_TOKENS:
            break
        sample.append(np.frombuffer(raw, np.uint16))
    model = start(sample, lex.share, states)
    for _ in range(passes):
        model, _ = one_pass(train, model, lex.share)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part, seqs in _sequences(batches):
            got = log_likelihood(sent.value, seqs) / np.log(10)
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in ("row", "doc_id", "held_out", "n_tokens", "known", "base")]
                + [pa.array(got + part.column("inner").to_numpy())],
                ["row", "doc_id", "held_out", "n_tokens", "known", "base", "score"])

    own = rows.select("row", "doc_id", "held_out", "n_tokens", "known", "base", "inner", "seq").mapInArrow(
        run, "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double")
    rare = rows.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times", "r.room")
    rare = rare.join(counts.select("word", "n"), "word", "left").withColumn("c", F.coalesce("n", F.lit(0)) + F.lit(0.1))
    rare = rare.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more"),
        F.sum(F.col("times") * F.log10(F.col("c") / F.lit(float(lex.z)))).alias("rare_base"),
        F.sum(F.col("times") * (F.log10("c") - F.col("room"))).alias("rare_inner"))
    zero = F.lit(0)
    return own.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", zero)).cast("long").alias("n_known"),
        F.lit(int(lex.total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("rare_inner", zero)).alias("score"))
