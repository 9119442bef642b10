"""Language detection and learned sentence boundaries on small inputs."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexaria.operators import language as LG

SF = "/root/testdata/sf0.001"


def test_detection_by_brute_force(spark):
    train = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, "the end", "en"), (4, None, "en"), (5, "", "de")]
    tests = [(10, "the dog the dog"), (11, "die katze!"), (12, "und"), (13, "zzz")]
    docs = spark.createDataFrame([(i, t) for i, t, _ in train] + tests, "doc_id long, text string")
    langs = spark.createDataFrame([(i, lang) for i, _, lang in train], "doc_id long, lang string")
    words = LG.document_words(docs)
    got = {r.doc_id: r for r in LG.detect(words, LG.gram_model(words, langs)).collect()}
    grams = lambda t: [f" {w} "[i:i + 3] for w in (t or "").replace("!", " !").split() for i in range(len(w))]
    seen = {lang: Counter(g for _, t, x in train if x == lang for g in grams(t)) for lang in ("en", "de")}
    types = set().union(*seen.values())
    for i, t in tests[:3]:
        want = {lang: sum(math.log((c[g] + 0.5) / (sum(c.values()) + 0.5 * len(types))) for g in grams(t) if g in types) for lang, c in seen.items()}
        best = max(want, key=want.get)
        assert got[i].predicted == best and abs(got[i].score - want[best]) < 1e-9
    assert 13 not in got and 4 not in got  # nothing known to go by


def test_detection_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    words = LG.document_words(docs)
    got = LG.detect(words, LG.gram_model(words, docs.where(~held).select("doc_id", "lang"))).join(docs.where(held).select("doc_id", "lang"), "doc_id")
    right, n = got.agg(F.avg((F.col("lang") == F.col("predicted")).cast("int")), F.count("*")).first()
    assert n > 20 and right > 0.9


def test_abbreviations_join_sentences(spark):
    text = ["Prof. Abel came. He met prof. Bell today. Then they left.", "It was late. Prof. Cole slept. All was well."] * 4
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "doc_id long, text string")
    table = LG.abbreviations(docs)
    found = {r.word for r in table.where("abbreviation").collect()}
    assert "prof" in found and "left" not in found or found == {"prof"}
    lines = docs.select("doc_id", F.lit(0).cast("long").alias("line_no"), F.col("text").alias("line"))
    given = spark.createDataFrame([("prof", True), ("late", False)], "word string, abbreviation boolean")
    got = LG.sentences_by_abbreviation(lines, given).where("doc_id < 2").orderBy("doc_id", "sent_no").collect()
    assert [r.sentence for r in got] == ["Prof. Abel came.", "He met prof. Bell today.", "Then they left.", "It was late.", "Prof. Cole slept.", "All was well."]
    assert LG.abbreviations(docs.limit(0)).count() == 0


def test_texts_are_scored_in_lots_as_by_words(spark):
    """no row per word of a document is shuffled; repeated and null ids and empty texts as before."""
    docs = spark.createDataFrame([(1, "the cat sat the"), (1, "on the mat"), (2, "der hund lag"), (3, "das haus"), (4, "xqzj"), (5, None),
                                  (6, ""), (None, "the dog")], "doc_id long, text string")
    langs = spark.createDataFrame([(1, "en"), (1, "en"), (2, "de"), (3, "de")], "doc_id long, lang string")
    words = LG.document_words(docs)
    old_model, model = LG.gram_model(words, langs), LG.gram_model_of(LG.language_words(docs, langs))
    got, want = ({(r.gram, r.lang): r.logp for r in m.collect()} for m in (model, old_model))
    assert got == pytest.approx(want)
    old, new = ({r.doc_id: tuple(r)[1:] for r in d.collect()} for d in (LG.detect(words, model), LG.detect_texts(docs, model)))
    assert old.keys() == new.keys()
    for k, (lang, score, margin) in old.items():
        assert new[k][0] == lang and new[k][1:] == pytest.approx((score, margin))
