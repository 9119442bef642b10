"""Quality classifier by nearest-neighbour voting in a latent-semantic space (operator 5).

Features: hashed byte trigrams of the whole text (``FEATURES`` buckets), log term
frequency times inverse document frequency, and four shares of the text's shape (words
that repeat the word before, capitals, punctuation, digits); document frequencies come
from all documents.
Latent space: truncated SVD (``DIM`` directions) of a bounded sample of at most
``SAMPLE`` labelled training documents, drawn by hash of the text.  The sample's latent
vectors are broadcast (``SAMPLE * DIM`` floats at most), and every document is compared
with all of them by exact cosine in blocks; the ``NEIGHBOURS`` nearest vote with their
labels, weighted by similarity.

Only text is ever an input of a score: not the id, language or source, nor the labels of
held-out documents.

Cases: null text counts as empty; a text shorter than a trigram, or without any trigram the
sample knows, gets the share of label 1 in the sample; so does every text if there are
no labels (then 0.5); a document labelled more than once votes with the mean of its labels,
null labels and ids are ignored; repeated rows are scored one by one; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaria.llm.common import held_out, keep, of_texts, text_slices

FEATURES = 4096
DIM = 32
SAMPLE = 4096
NEIGHBOURS = 9
POWER = 8.0
THRESHOLD = 0.3
_LONG = 1 << 22


def _grams(u8: np.ndarray) -> np.ndarray:
    x = u8.astype(np.uint32)
    h = (x[:-2] * np.uint32(0x01000193) + x[1:-1]) * np.uint32(0x01000193) + x[2:]
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(20)).astype(np.int64) & (FEATURES - 1)


def counts(texts: list[str | None]) -> np.ndarray:
    """(texts, FEATURES) trigram counts of whole texts."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    small, owner = [], []
    with np.errstate(over="ignore"):
        for i, t in enumerate(texts):
            raw = (t or "").encode("utf-8", "surrogatepass")
            if len(raw) > _LONG:
                for s in range(0, len(raw) - 2, _LONG):
                    out[i] += np.bincount(_grams(np.frombuffer(raw[s:s + _LONG + 2], np.uint8)), minlength=FEATURES)
            elif len(raw) > 2:
                small.append(raw)
                owner.append(i)
        if small:
            size = np.array([len(r) for r in small])
            h = _grams(np.frombuffer(b"".join(small), np.uint8))
            row = np.repeat(np.arange(len(small)), size)[:len(h)]
            last = np.cumsum(size)
            ok = np.ones(len(h), bool)  # no trigram runs over the end of its text
            for back in (1, 2):
                at = last - back
                ok[at[at < len(h)]] = False
            got = np.bincount(row[ok] * FEATURES + h[ok], minlength=len(small) * FEATURES)
            out[owner] = got.reshape(len(small), FEATURES)
    return out


_KIND = np.zeros((256, 3), np.float64)  # capitals, punctuation, digits
_KIND[65:91, 0] = 1
_KIND[[b for b in range(33, 127) if not chr(b).isalnum()], 1] = 1
_KIND[48:58, 2] = 1
SHAPE = 4
SHAPE_WEIGHT = 1.5


def shape(texts: list[str | None]) -> np.ndarray:
    """(texts, SHAPE) shares in 0..1 of the whole text."""
    out = np.zeros((len(texts), SHAPE))
    for i, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass")
        same = words = 0
        for s in range(0, len(raw), _LONG):
            w = raw[s:s + _LONG].split()
            same += sum(map(bytes.__eq__, w, w[1:]))
            words += len(w)
            out[i, 1:] += np.bincount(np.frombuffer(raw[s:s + _LONG], np.uint8), minlength=256) @ _KIND
        if words:
            out[i, 0] = same / words
            out[i, 1:] /= len(raw)
    return out


def _rows(batches, column: str, rows: int = 128):
    for part in text_slices(batches, column, 250_000):
        for s in range(0, part.num_rows, rows):
            yield part.slice(s, rows)


def document_frequency(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """Documents per feature, and all documents; one row per feature and task is moved."""
    def run(batches):
        total, n = np.zeros(FEATURES, np.int64), 0
        for part in _rows(batches, "text"):
            total += (counts(part.column("text").to_pylist()) > 0).sum(0)
            n += part.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(FEATURES + 1)), pa.array(np.r_[total, n])], ["f", "n"])

    got = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(FEATURES + 1, np.int64)
    out[got.column("f").to_numpy()] = got.column("n").to_numpy()
    return out[:-1], int(out[-1])


def weighted(tf: np.ndarray, shares: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """(texts, FEATURES + SHAPE): unit tf-idf vectors followed by the weighted shape shares."""
    x = np.log1p(tf) * idf
    norm = np.sqrt((x * x).sum(1))
    return np.hstack([x / np.maximum(norm, 1e-12)[:, None], (SHAPE_WEIGHT * np.sqrt(shares)).astype(np.float32)])


def latent_basis(x: np.ndarray, dim: int, seed: int = 5) -> np.ndarray:
    """(features, dim) right singular directions by randomised subspace iteration."""
    rng = np.random.default_rng(seed)
    k = min(dim + 10, *x.shape)
    q = np.linalg.qr(x.T @ rng.standard_normal((len(x), k)).astype(x.dtype))[0]
    for _ in range(3):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    u, s, vt = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ vt.T)[:, :dim].astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1))
    return np.where(norm[:, None] > 1e-9, x / np.maximum(norm, 1e-12)[:, None], 0)


class Model:
    """What the tasks need: idf, latent basis, labelled latent vectors, labels, prior."""

    def __init__(self, tf, shares, labels, df, n_docs, dim=DIM):
        self.idf = np.log((n_docs + 1) / (df + 1)).astype(np.float32) + np.float32(1)
        self.labels = np.asarray(labels, np.float32)
        self.prior = float(self.labels.mean()) if len(tf) else 0.5
        self.basis = None
        if len(tf):
            x = weighted(tf, shares, self.idf)
            self.basis = latent_basis(x, dim)
            self.points = _unit(x @ self.basis).astype(np.float32)

    def scores(self, texts) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if self.basis is None:
            return out
        y = _unit(weighted(counts(texts), shape(texts), self.idf) @ self.basis)
        sim = y @ self.points.T  # exact cosines of the block with every labelled vector
        k = min(NEIGHBOURS, sim.shape[1])
        top = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(sim, top, 1), 0).astype(np.float64) ** POWER
        known = w.sum(1) > 0
        out[known] = (w * self.labels[top]).sum(1)[known] / w.sum(1)[known]
        return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, train, id_col="doc_id", text_col="text", label_col="quality",
        sample: int = SAMPLE) -> Model:
    df, n = document_frequency(docs, text_col)
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    marks = marks.groupBy(F.col(id_col).alias("_id")).agg(F.avg(label_col).alias("_label"))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    texts = texts.where(train(F.col("_id")) & F.col("_text").isNotNull())
    texts = texts.withColumn("_h", F.xxhash64("_text", F.lit("sample")))
    # ids and hashes decide the sample; only its texts (at most ``sample``, broadcast by that bound) are read again
    drawn = texts.select("_id", "_h").distinct().join(marks, "_id").orderBy("_h", "_id").limit(sample)
    picked = texts.join(F.broadcast(keep(drawn)), ["_id", "_h"])

    def run(batches):
        for part in _rows(batches, "_text"):
            t = part.column("_text").to_pylist()
            tf, shares = counts(t), shape(t)
            at = [np.flatnonzero(row) for row in tf]
            yield pa.RecordBatch.from_arrays(
                [part.column("_id"), part.column("_h"), part.column("_label"), pa.array([a.astype("<u2").tobytes() for a in at], pa.binary()),
                 pa.array([row[a].astype("<f4").tobytes() for row, a in zip(tf, at)], pa.binary()),
                 pa.array([r.astype("<f8").tobytes() for r in shares], pa.binary())], ["_id", "_h", "_label", "at", "tf", "shares"])

    kind = picked.schema["_id"].dataType.simpleString()
    got = picked.select("_id", "_h", "_label", "_text").mapInArrow(
        run, f"_id {kind}, _h long, _label double, at binary, tf binary, shares binary")
    got = got.dropDuplicates(["_id", "_h"]).orderBy("_h", "_id").toArrow()  # repeated rows count once
    tf, shares = np.zeros((got.num_rows, FEATURES), np.float32), np.zeros((got.num_rows, SHAPE))
    for i, (at, n_at, share) in enumerate(zip(*(got.column(c).to_pylist() for c in ("at", "tf", "shares")))):
        tf[i, np.frombuffer(at, "<u2")] = np.frombuffer(n_at, "<f4")
        shares[i] = np.frombuffer(share, "<f8")
    return Model(tf, shares, got.column("_label").to_pylist(), df, n)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = THRESHOLD,
             id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", out: str = "quality") -> DataFrame:
    """``docs`` with a struct column ``out``: held_out, score, predicted."""
    model = fit(docs, labels, lambda c: ~held_out(c, folds), id_col, text_col, label_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c != out]
    score = of_texts("double", lambda texts: sent.value.scores(texts), 250_000, rows=128)
    voted = docs.select(F.struct(*names).alias("_doc"), score(F.col(text_col)).alias("_score"))
    cols = [F.col("_doc")[c].alias(c) for c in names]
    verdict = F.struct(held_out(F.col("_doc")[id_col], folds).alias("held_out"), F.col("_score").alias("score"),
                       F.when(F.col("_score") >= threshold, 1).otherwise(0).alias("predicted"))
    return voted.select(*cols, verdict.alias(out))
