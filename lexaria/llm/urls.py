"""URL filter: rules by host and path, then a blocked Bloom filter and an exact join (operator 6, native).

Listed URLs are compared in canonical form: scheme, user, port, leading ``www.`` or ``m.``,
query, fragment, a trailing ``.html`` and trailing slashes are dropped and the host is
lower-cased.  The Bloom filter is a table of 64-bit blocks; a URL's hash names one block and
``PROBES`` bits in it.  The number of blocks follows the list (16 bits a URL) up to
``MAX_BLOCKS``, so the broadcast table is bounded; a longer list only lets more false
positives through.  Pages whose bits are all set go to an exact equi-join with the list,
which removes false positives; the others never take part in a shuffle.

A page's verdict is that of the longest fitting rule, else ``block`` if its canonical URL
is listed, else ``allow``.

Cases: a null url, or one without ``://``, has empty host and path, fits no rule and is
never listed; repeated rows are judged each; null list entries are ignored; rules of equal
length are tried in code point order of their text; an empty table or list is
no error; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexaria.llm.common import keep

PROBES = 6
MAX_BLOCKS = 1 << 20
BITS_PER_URL = 16

# (host, path, verdict)
Rule = tuple[str, str, str]


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end; path: from there up to ``?``, ``#`` or the end."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return ascii_lower(part(1)), part(2)


def canonical(host: Column, path: Column) -> Column:
    """Null for an empty host."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")
    bare = F.regexp_replace(bare, r"^(?:www|m)\.", "")
    end = F.regexp_replace(F.regexp_replace(path, r"\.html?$", ""), r"/+$", "")
    return F.when(bare != "", F.concat(bare, end))


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, or null."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        hit = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _bits(url: Column) -> Column:
    """PROBES bits of a 64-bit word, from a second hash of the URL."""
    h = F.xxhash64(url, F.lit("bits"))
    out = F.lit(0).cast("long")
    for k in range(PROBES):
        at = F.shiftright(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), at))
    return out


def listed_blocks(listed: DataFrame) -> tuple[DataFrame, int]:
    """Blocked Bloom filter (block, word) of the column ``url``, and its number of blocks."""
    n = max(1, listed.count())
    blocks = min(MAX_BLOCKS, 1 << max(0, (n * BITS_PER_URL // 64 - 1).bit_length()))
    made = listed.select(_block(F.col("url"), blocks).alias("block"), _bits(F.col("url")).alias("bits"))
    made = made.groupBy("block").agg(F.expr("bit_or(bits)").alias("word"))
    return made, blocks


def judge(pages: DataFrame, listed: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url",
          list_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, listed for every page."""
    host, path = host_and_path(F.col(list_col))
    known = listed.select(canonical(host, path).alias("url")).where("url is not null").distinct()
    known = keep(known)
    words, blocks = listed_blocks(known)
    host, path = host_and_path(F.col(url_col))
    src = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    src = src.withColumn("_url", canonical(F.col("host"), F.col("path")))
    src = src.withColumn("_rule", longest_rule(F.col("host"), F.col("path"), rules))
    src = src.withColumn("block", _block(F.col("_url"), blocks)).withColumn("_bits", _bits(F.col("_url")))
    # at most MAX_BLOCKS rows of 16 bytes
    probed = src.join(F.broadcast(words), "block", "left")
    maybe = F.coalesce(F.col("_rule").isNull() & F.col("_url").isNotNull()
                       & (F.col("word").bitwiseAND(F.col("_bits")) == F.col("_bits")), F.lit(False))
    names = ["page_id", "host", "path", "_rule"]
    passed = probed.where(~maybe).select(*names, F.lit(False).alias("listed"))
    checked = probed.where(maybe).join(known.select(F.col("url").alias("_url"), F.lit(True).alias("hit")), "_url", "left")
    checked = checked.select(*names, F.coalesce("hit", F.lit(False)).alias("listed"))
    verdict = F.coalesce("_rule.verdict", F.when(F.col("listed"), "block").otherwise("allow"))
    return passed.unionByName(checked).select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "listed")


def spam_listed(pages: DataFrame, words: str, url_col: str = "url") -> DataFrame:
    """A blocklist derived from the pages: the urls whose host holds one of the listed words as a label part."""
    host, _ = host_and_path(F.col(url_col))
    return pages.where(host.rlike(rf"(^|[.-])({words})([.-]|$)")).select(F.col(url_col).alias("url"))
