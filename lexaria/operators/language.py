"""Language detection and sentence boundaries learned from the corpus.

Both are counts and lookups: a table of parameters is learned by aggregates over all training
rows and applied by joins; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexaria.functions import text as T
from lexaria.operators import encode as EN

SMOOTH = 0.5


def word_grams(word: Column, size: int = 3) -> Column:
    """Character n-grams of a word with a space on both sides."""
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - (size - 1), F.lit(1))), lambda i: F.substring(padded, i, F.lit(size)))


def document_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, word, n): the distinct lower-case words of every document."""
    return docs.select("doc_id", F.explode(T.word_tokens(F.lower(F.col(text_col)))).alias("word")).groupBy("doc_id", "word").agg(
        F.count("*").alias("n"))


def language_words(docs: DataFrame, langs: DataFrame, text_col: str = "text") -> DataFrame:
    """(lang, word, n): the lower-case words of the training documents ``langs`` (doc_id, lang), counted where the texts lie."""
    told = docs.select("doc_id", text_col).join(langs, "doc_id")
    return told.select("lang", F.explode(T.word_tokens(F.lower(F.col(text_col)))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))


def gram_model(words: DataFrame, langs: DataFrame) -> DataFrame:
    """(gram, lang, logp) for every n-gram and language seen in training, smoothed.

    ``words`` is (doc_id, word, n), ``langs`` (doc_id, lang) names the training documents.  Words are
    summed by language before they are cut, so the corpus is cut into grams once per distinct word.
    """
    return gram_model_of(words.join(langs, "doc_id").groupBy("lang", "word").agg(F.sum("n").alias("n")))


def gram_model_of(by_word: DataFrame) -> DataFrame:
    """``gram_model`` from (lang, word, n)."""
    seen = by_word.select("lang", "n", F.explode(word_grams(F.col("word"))).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("c"))
    seen = seen.checkpoint(eager=True)  # bounded by the n-grams; read for their number, the totals and the model
    total = seen.groupBy("lang").agg(F.sum("c").alias("total"))
    grams = seen.select("gram").distinct()
    size = total.select("lang", (F.col("total") + F.lit(SMOOTH * grams.count())).alias("size"))  # one number
    every = grams.withColumn("lang", F.explode(F.lit([r.lang for r in total.select("lang").orderBy("lang").collect()]).cast("array<string>")))
    every = every.join(seen, ["gram", "lang"], "left").join(size, "lang")
    return every.select("gram", "lang", F.log((F.coalesce("c", F.lit(0)) + F.lit(SMOOTH)) / F.col("size")).alias("logp"))


def _word_scores(types: DataFrame, model: DataFrame) -> DataFrame:
    """(word, ls): the summed log-likelihoods of a word's n-grams, one entry a language."""
    score = types.select("word", F.explode(word_grams(F.col("word"))).alias("gram")).join(model, "gram").groupBy("word", "lang").agg(
        F.sum("logp").alias("s"))
    return score.groupBy("word").agg(F.collect_list(F.struct("lang", "s")).alias("ls"))


def _verdict(got: DataFrame) -> DataFrame:
    """(doc_id, predicted, score, margin) from (doc_id, b): structs (s, lang), the best first."""
    return got.select("doc_id", F.col("b")[0]["lang"].alias("predicted"), F.col("b")[0]["s"].alias("score"),
                      (F.col("b")[0]["s"] - F.try_element_at("b", F.lit(2))["s"]).alias("margin"))


def detect(words: DataFrame, model: DataFrame) -> DataFrame:
    """(doc_id, predicted, score, margin): the language of the largest summed log-likelihood of the document's n-grams.

    Grams that training has not seen count for no language; ties go to the language that sorts last.
    """
    per_word = _word_scores(words.select("word").distinct(), model)
    by_lang = words.join(per_word, "word").select("doc_id", "n", F.explode("ls").alias("l")).groupBy("doc_id", F.col("l.lang").alias("lang")).agg(
        F.sum(F.col("n") * F.col("l.s")).alias("s"))
    best = F.reverse(F.array_sort(F.collect_list(F.struct("s", "lang"))))
    return _verdict(by_lang.groupBy("doc_id").agg(best.alias("b")))


def detect_texts(docs: DataFrame, model: DataFrame, text_col: str = "text") -> DataFrame:
    """``detect`` for (doc_id, text), in the encoder's lots: a word's scores by language are its vector, a lot is sent
    the vectors of its distinct words, and no row per word of a document is shuffled."""
    langs = [r.lang for r in model.select("lang").distinct().orderBy("lang").collect()]  # one entry a language
    if not langs:
        return detect(document_words(docs, text_col), model)
    src = docs.select(F.struct("doc_id").alias("key"), T.word_tokens(F.lower(F.col(text_col))).alias("toks"))
    kind = src.schema["key"].dataType.simpleString()
    lots = src.mapInArrow(EN._pack, EN.LOT_ROW.format(key=kind)).checkpoint(eager=True)
    scores = _word_scores(lots.select(F.explode("words").alias("word")).distinct(), model)
    # the model has every language for every gram
    scores = scores.select("word", F.transform(F.array_sort("ls"), lambda x: x["s"]).alias("vec"))
    found = lots.select("lot", F.posexplode("words").alias("at", "word")).join(scores, "word").select("lot", "at", "vec")
    sums = EN.with_vectors(lots, found).mapInArrow(EN._encode_lots(len(langs), "sum", False), f"key {kind}, vec array<double>, _n double")
    sums = sums.where(F.col("_n") > 0).groupBy(F.col("key.doc_id").alias("doc_id")).agg(*[F.sum(F.col("vec")[i]).alias(f"s{i}") for i in range(len(langs))])
    each = F.array(*[F.struct(F.col(f"s{i}").alias("s"), F.lit(lang).alias("lang")) for i, lang in enumerate(langs)])
    return _verdict(sums.select("doc_id", F.reverse(F.array_sort(each)).alias("b")))


def abbreviations(docs: DataFrame, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(word, n, n_dot, ratio, score, abbreviation) of every word type that occurs with a full stop.

    ``ratio`` is the likelihood ratio of "the stop belongs to the word" (0.99) against "stops fall on words
    at their average rate"; the score weighs it down for long words and for occurrences without a stop.
    """
    tokens = docs.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(r"\p{L}+\.?"), F.lit(0))).alias("t"))
    tokens = tokens.select(F.lower(F.rtrim("t", F.lit("."))).alias("word"), F.col("t").endswith(".").cast("long").alias("dot"))
    types = tokens.groupBy("word").agg(F.count("*").alias("n"), F.sum("dot").alias("n_dot"))
    rate = types.agg(F.sum("n_dot") / F.sum("n")).first()[0]  # one number
    x = types.where("n_dot > 0").withColumn("p", F.lit(rate).cast("double")).where("p < 1")
    plain = F.col("n") - F.col("n_dot")
    by_rate = F.col("n_dot") * F.log("p") + plain * F.log(1 - F.col("p"))
    own = F.col("n_dot") * F.log(F.lit(0.99)) + plain * F.log(F.lit(0.01))
    x = x.withColumn("ratio", -2 * (by_rate - own))
    size = F.length("word")
    x = x.withColumn("score", F.col("ratio") * F.exp(-size) * F.pow(size.cast("double"), -plain.cast("double")))
    return x.select("word", "n", "n_dot", "ratio", "score", (F.col("score") >= threshold).alias("abbreviation"))


def sentences_by_abbreviation(lines: DataFrame, table: DataFrame) -> DataFrame:
    """(doc_id, line_no, sent_no, sentence): the regex splitter's pieces, joined again where the stop is an abbreviation's."""
    piece = lines.select("doc_id", "line_no", F.posexplode(T.split_sentences(F.col("line"))).alias("k", "piece"))
    piece = piece.withColumn("word", F.lower(F.regexp_extract("piece", r"(\p{L}+)\.$", 1)))
    short = table.where("abbreviation").select("word", F.lit(1).alias("open"))
    piece = piece.join(short, "word", "left")
    before = Window.partitionBy("doc_id", "line_no").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)  # one line of text
    number = F.coalesce(F.sum(F.when(F.col("open").isNull(), 1).otherwise(0)).over(before), F.lit(0))
    whole = piece.withColumn("sent_no", number).groupBy("doc_id", "line_no", "sent_no").agg(
        F.array_sort(F.collect_list(F.struct("k", "piece"))).alias("ps"))
    return whole.select("doc_id", "line_no", F.col("sent_no").cast("bigint").alias("sent_no"),
                        F.array_join(F.transform("ps", lambda p: p["piece"]), " ").alias("sentence"))
