"""opN_<name> queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaria.llm import ann, hmm, lines, mixing, packing, quality, repair, runs, simhash, suffix_dedup, surrogates, urls, vector_dups
from lexaria.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return put


@query("op2_inverted_multi_index")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query("op3_hidden_markov")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(read_table(spark, sf_dir, "documents"), folds=10)


@query("op4_surrogates")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace_entities(docs, secret="corpus-key-1")


@query("op5_neighbour_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    got = quality.classify(docs, read_table(spark, sf_dir, "labels"))
    return got.select("doc_id", "quality.held_out", "quality.score", "quality.predicted")


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
SPAM_HOST_WORDS = "casino|bets|pills"

OP6_SQL = r"""
with h as (
  select page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') path from pages),
c as (select *, nullif(regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '^(?:www|m)[.]', ''), '')
         || regexp_replace(regexp_replace(path, '[.]html?$', ''), '/+$', '') canon,
    case when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
         when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
         when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
         when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end rule from h),
l as (select distinct canon from c where regexp_matches(host, '(^|[.-])(casino|bets|pills)([.-]|$)') and canon is not null)
select page_id, host, path, rule,
  case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
       when l.canon is not null then 'block' else 'allow' end verdict,
  rule is null and l.canon is not null listed
from c left join l using (canon)
"""


@query("op6_blocked_bloom_urls", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, urls.spam_listed(pages, SPAM_HOST_WORDS), URL_RULES)


def packed_documents(docs: DataFrame, with_ids: bool = False) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(docs, path, public_tokenizers.PATTERN, capacity=2048, end_id=0, with_ids=with_ids)


@query("op7_large_item_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(read_table(spark, sf_dir, "documents"))


@query("op8_simhash_pigeonring")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(read_table(spark, sf_dir, "documents"), shingle=3, max_distance=3)
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


OP1_SQL = """
with recursive base as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint size,
         case when source is null then 't' else 's' || source end skey,
         ((('0x' || substr(md5('1|' || coalesce(doc_id::varchar, '-') || '|' || coalesce(md5(text), '-')), 1, 13))::bigint) + 0.5::double)
           / 4503599627370496.0::double u
  from documents),
docs as (select *, len(bin(size))::bigint w from base),
s0 as (select skey, count(*) n, sum(size)::bigint source_size from docs group by skey),
s1 as (select *, [5, 2, 1][((row_number() over (order by skey) - 1) % 3 + 1)::int] weight, 3 * source_size cap,
         (sum(source_size) over ())::bigint total from s0),
s2 as (select *, coalesce(sum(cap) over (order by cap::double / weight, skey rows between unbounded preceding and 1 preceding), 0)::bigint c0,
         coalesce(sum(weight) over (order by cap::double / weight, skey rows between unbounded preceding and 1 preceding), 0)::bigint w0,
         (sum(weight) over ())::bigint ws from s1),
s3 as (select *, (total - c0)::double / nullif(ws - w0, 0) lvl from s2),
s4 as (select *, cap <= lvl * weight is_full from s3),
s5 as (select *, max(case when is_full then null else lvl end) over () level from s4),
s6 as (select skey, n, source_size, case when is_full then cap::double else level * weight end target from s5),
s7 as (select *, coalesce(floor(target / nullif(source_size, 0)), 0)::bigint whole from s6),
src as (select *, target - whole * source_size rest from s7),
c0 as (select skey, w, sum(size)::bigint words from docs group by skey, w),
c1 as (select c0.*, w * words cw, n, source_size, target, whole, rest from c0 join src using (skey)),
c2 as (select *, coalesce(sum(words) over (partition by skey order by w desc rows between unbounded preceding and 1 preceding), 0)::bigint b0,
         coalesce(sum(cw) over (partition by skey order by w desc rows between unbounded preceding and 1 preceding), 0)::bigint w0,
         (sum(cw) over (partition by skey))::bigint ws from c1),
c3 as (select *, (rest - b0) / nullif(ws - w0, 0) lvl from c2),
c4 as (select *, words <= lvl * cw is_full from c3),
c5 as (select *, max(case when is_full then null else lvl end) over (partition by skey) level from c4),
cls as (select skey, w, source_size, target, whole, rest, ceil(n::double / 1000)::bigint bins, rest / nullif(source_size - rest, 0) odds,
          case when rest <= 0 or words = 0 then 0::double when is_full then 1::double else least(1::double, level * w) end p from c5),
r0 as (select docs.doc_id, docs.skey, docs.size, docs.u, source_size, target, whole, rest, bins, odds, p,
         u * (1 - p) / ((1 - u) * nullif(p, 0)) q from docs join cls on docs.skey = cls.skey and docs.w = cls.w),
r1 as (select *, least(bins - 1, floor(q * odds / (1 + q * odds) * bins))::bigint bin from r0),
drawn as (select * from r1 where size > 0 and p > 0),
sums as (select skey, bin, sum(size)::bigint words, any_value(rest) rest from drawn group by skey, bin),
run as (select *, sum(words) over (partition by skey order by bin) upto from sums),
edge as (select skey, min(bin) edge, min(rest - (upto - words)) room from run where upto > rest group by skey),
edge1 as (select e.skey, e.edge, r.rest - (r.upto - r.words) room from edge e join run r on r.skey = e.skey and r.bin = e.edge),
units as (select d.skey, q, u, doc_id, room, sum(size)::bigint words,
            row_number() over (partition by d.skey order by q, u, doc_id) k
          from drawn d join edge1 e on d.skey = e.skey and d.bin = e.edge group by d.skey, q, u, doc_id, room),
fill as (
  select skey, k, u, doc_id, words <= room took, case when words <= room then room - words else room end room from units where k = 1
  union all
  select n.skey, n.k, n.u, n.doc_id, n.words <= f.room, case when n.words <= f.room then f.room - n.words else f.room end
  from fill f join units n on n.skey = f.skey and n.k = f.k + 1)
select r1.doc_id, r1.size, r1.source_size, r1.target,
  r1.size * (r1.whole + case when r1.rest <= 0 or r1.p = 0 then 0 when e.edge is null or r1.bin < e.edge then 1
                             when r1.bin = e.edge and f.took then 1 else 0 end) taken
from r1 left join edge1 e on e.skey = r1.skey
left join fill f on f.skey = r1.skey and f.u = r1.u and f.doc_id is not distinct from r1.doc_id
"""


@query("op1_pareto_mix", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    got = mixing.mix_digest(docs)
    return got.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op9_rotation_codes")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dups.near_duplicates(read_table(spark, sf_dir, "embeddings"), threshold=0.95)


@query("op10_fuzzy_lines")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lines.line_decisions(read_table(spark, sf_dir, "documents"))
    return got.withColumnRenamed("line", "line_id").withColumnRenamed("component", "component_id")


@query("op11_lcp_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runs.planted(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    got = runs.periodic_runs(docs)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    got = got.withColumn("_best", longest)
    return got.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.start")).alias("start"),
        F.col("_best.length").alias("length"), (-F.col("_best.period")).alias("period"),
        F.expr("(1000 * _best.length) div (-_best.period)").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op12_conversation_repair")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hurt = repair.damaged(rows)
    plan, found = repair.plan_repairs(hurt, rows)
    sha = repair.hashes(repair.repaired_rows(hurt, plan, found)).withColumnRenamed("conv", "_conv")
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    return plan.join(sha, plan.conv.eqNullSafe(sha._conv)).select(plan.conv.alias("conv_id"), *names, "repaired_sha256")


@query("op13_suffix_array")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.stop - s.start)
    return got.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))
