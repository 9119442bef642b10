"""Mixing sources to target weights by Pareto order sampling (operator 1, native).

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and share
all words of the corpus; a target stops at ``max_copies`` times its source and the
excess is reshared by weight (water-filling, solved in one pass over the sources).

Copies: with target = whole * source_size + rest, every document gets ``whole``
certain copies; the rest is a Pareto sample without replacement.  Within a source a
document's inclusion probability is p = min(1, c * w), w being the bit length of its
size, with c solved so that the expected words equal the rest.  Documents are ranked by
their random odds over their inclusion odds, q = [u / (1 - u)] / [p / (1 - p)]; u is a
keyed hash of id and text, so reruns agree.  The sample's fixed size is in words:
documents enter in rank order as long as they fit.

Scale: the rank order is never materialised.  q is mapped to bins of about ``BIN``
documents; bins below the one where the running word count passes the rest enter
whole, and only that one bin per source is ordered and filled document by document.
A source with a third of all rows is therefore only ever seen as partial sums.

Cases: null text has size 0 and takes nothing; null sources form the last source; a
source without words has target 0; repeated rows (same id and text) are taken or left
together; a null id is a value like any other; an empty table gives an empty result;
other columns pass through, and the result struct replaces a column of its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexaria.llm.common import WORD, store

BIN = 1000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _level(df: DataFrame, part: list[str], order: list, total: str, cap: str, weight: str) -> DataFrame:
    """Add ``level`` c per part so that sum(min(cap, c * weight)) = total.

    ``order`` must sort by cap / weight: entries are full up to the first whose cap
    lies above the level that the entries before it leave (later entries leave less).
    """
    w = Window.partitionBy(*part)
    before = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_c0", F.coalesce(F.sum(cap).over(before), F.lit(0)))
    df = df.withColumn("_w0", F.coalesce(F.sum(weight).over(before), F.lit(0)))
    df = df.withColumn("_w", F.sum(weight).over(w))
    df = df.withColumn("_l", F.expr(f"(`{total}` - _c0) / nullif(_w - _w0, 0)"))
    df = df.withColumn("_full", F.expr(f"`{cap}` <= _l * `{weight}`"))
    df = df.withColumn("level", F.max(F.expr("if(_full, null, _l)")).over(w))
    return df.drop("_c0", "_w0", "_w", "_l")


def targets(sources: DataFrame, weights=(5, 2, 1), max_copies: int = 3) -> DataFrame:
    """Targets of a table (skey, n, source_size) with one row per source."""
    order = Window.partitionBy(F.lit(0)).orderBy("skey")
    s = sources.withColumn("weight", F.element_at(
        F.array(*[F.lit(int(x)) for x in weights]),
        ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * max_copies).withColumn("one", F.lit(0))
    s = s.withColumn("total", F.sum("source_size").over(Window.partitionBy("one")))  # one row per source
    s = _level(s, ["one"], [F.expr("cap / weight"), "skey"], "total", "cap", "weight")
    s = s.withColumn("target", F.when(F.col("_full"), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight")))
    s = s.withColumn("whole", F.coalesce(F.floor(F.expr("target / nullif(source_size, 0)")), F.lit(0)).cast("int"))
    s = s.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    return s.select("skey", "n", "source_size", "target", "whole", "rest")


def measured(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: int) -> DataFrame:
    """Add _mx: id, source key, size, weight class and the document's uniform number."""
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("-")),
                      F.coalesce(F.md5(F.col(text_col)), F.lit("-")))
    u = (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    size = word_count(F.col(text_col))
    # 's' sorts before 't': null sources come last
    skey = F.when(F.col(source_col).isNull(), F.lit("t")).otherwise(F.concat(F.lit("s"), F.col(source_col)))
    return docs.withColumn("_mx", F.struct(
        F.col(id_col).alias("id"), skey.alias("skey"), size.alias("size"),
        F.length(F.bin(size)).alias("w"), u.alias("u")))


def _ranked(base: DataFrame, classes: DataFrame) -> DataFrame:
    """Add rank statistic q and bin to rows holding skey, w, u."""
    r = base.join(classes, ["skey", "w"], "left")
    r = r.withColumn("q", F.expr("u * (1 - p) / ((1 - u) * nullif(p, 0))"))
    r = r.withColumn("_v", F.expr("q * odds / (1 + q * odds)"))
    r = r.withColumn("bin", F.least(F.col("bins") - 1, F.floor(F.col("_v") * F.col("bins"))).cast("long"))
    return r.drop("_v")


class Mix:
    """Decisions of one mix: three small tables, computed from (id, skey, size, w, u)."""

    def __init__(self, base: DataFrame, weights=(5, 2, 1), max_copies: int = 3):
        parts = base.groupBy("skey", "w").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
        parts = store(parts, "mix-parts")
        sources = parts.groupBy("skey").agg(F.sum("n").alias("n"), F.sum("words").alias("source_size"))
        self.sources = store(targets(sources, weights, max_copies), "mix-sources")
        c = parts.select("skey", "w", "words").join(self.sources, "skey")
        c = c.withColumn("cw", F.col("w") * F.col("words"))
        c = _level(c, ["skey"], [F.col("w").desc()], "rest", "words", "cw")
        p = F.expr("case when rest <= 0 or words = 0 then 0 when _full then 1 else least(1, level * w) end").cast("double")
        c = c.withColumn("p", p).withColumn("odds", F.expr("rest / nullif(source_size - rest, 0)"))
        c = c.withColumn("bins", F.ceil(F.col("n") / F.lit(BIN)).cast("long"))
        self.classes = store(c.select("skey", "w", "p", "odds", "bins", "source_size", "target", "whole", "rest"), "mix-classes")

        drawn = _ranked(base.where("size > 0"), self.classes).where("p > 0")
        sums = drawn.groupBy("skey", "bin").agg(F.sum("size").alias("words"))
        upto = Window.partitionBy("skey").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.sum("words").over(upto)).join(self.sources.select("skey", "rest"), "skey")
        edge = sums.where("upto > rest").groupBy("skey").agg(
            F.min(F.struct("bin", "upto", "words", "rest")).alias("e"))
        edge = edge.select("skey", F.col("e.bin").alias("edge"), F.expr("e.rest - (e.upto - e.words)").alias("room"))
        self.edge = store(edge, "mix-edge")

        units = drawn.join(self.edge, "skey").where("bin = edge").groupBy("skey", "q", "u", "id", "room").agg(
            F.sum("size").alias("words"))
        lists = units.groupBy("skey", "room").agg(F.sort_array(F.collect_list(F.struct("q", "u", "id", "words"))).alias("x"))
        fold = """aggregate(x, struct(room as room, cast(array() as array<boolean>) as took),
            (a, d) -> if(d.words <= a.room,
                         struct(a.room - d.words as room, array_append(a.took, true) as took),
                         struct(a.room as room, array_append(a.took, false) as took)),
            a -> a.took)"""
        took = lists.select("skey", F.explode(F.arrays_zip(F.col("x"), F.expr(fold).alias("t"))).alias("z"))
        took = took.select("skey", F.col("z.x.u").alias("u"), F.col("z.x.id").alias("id"), F.col("z.t").alias("took"))
        self.took = store(took, "mix-took")

    def apply(self, rows: DataFrame) -> DataFrame:
        """Add source_size, target, copies to rows holding id, skey, size, w, u."""
        r = _ranked(rows, self.classes).join(self.edge, "skey", "left")
        r = r.withColumn("_edge", F.expr("if(bin = edge and size > 0, skey, null)"))
        t = self.took.select(F.col("skey").alias("_skey"), F.col("u").alias("_u"), F.col("id").alias("_id"), "took")
        same = (F.col("_edge") == F.col("_skey")) & (F.col("u") == F.col("_u")) & F.col("id").eqNullSafe(F.col("_id"))
        r = r.join(t, same, "left")
        extra = F.expr("case when rest <= 0 or p = 0 then 0 when edge is null or bin < edge then 1 "
                       "when bin = edge and took then 1 else 0 end")
        return r.withColumn("copies", (F.col("whole") + extra).cast("int"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        weights=(5, 2, 1), max_copies: int = 3, seed: int = 1, out: str = "mix") -> DataFrame:
    """``docs`` with a struct column ``out``: size, source_size, target, copies."""
    rows = measured(docs, id_col, source_col, text_col, seed)
    made = Mix(store(rows.select("_mx.*"), "mix-base"), weights, max_copies)
    names = [c for c in docs.columns if c != out]
    got = made.apply(rows.select(F.struct(*names).alias("_doc"), "_mx.*"))
    return got.select(*[F.col("_doc")[c].alias(c) for c in names],
                      F.struct("size", "source_size", "target", "copies").alias(out))


def mix_digest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
               weights=(5, 2, 1), max_copies: int = 3, seed: int = 1) -> DataFrame:
    """(doc_id, size, source_size, target, copies) per row: the mix without the texts, one pass over them."""
    base = store(measured(docs, id_col, source_col, text_col, seed).select("_mx.*"), "mix-base")
    got = Mix(base, weights, max_copies).apply(base)
    return got.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "copies")


def mixed_documents(docs: DataFrame, **kw) -> DataFrame:
    """The mix itself: every document as many times as it was taken, in its own columns."""
    got = mix(docs, out="_mix", **kw).where("_mix.copies > 0")
    return got.withColumn("_copy", F.explode(F.expr("sequence(1, _mix.copies)"))).select(*docs.columns)
