"""Text contract as Spark Column expressions (JVM-side, codegen friendly).

The same regular expressions are used by the DuckDB oracle, so they are kept
to the subset both Java regex and RE2 accept (no look-behind in the oracle).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Punctuation sets that must equal the reference's.
# ASCII punctuation (Python string.punctuation) plus eleven CJK marks.
# ASCII punctuation plus nine typographic marks (historical monolingual job).
# Union of P1 and P2 (historical bilingual job and examples).
# ---------------------------------------------------------------------------
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CJK_MARKS = ["。", "、", "？", "！", "「", "」", "（", "）", "：", "・", "，"]
TYPOGRAPHIC_MARKS = ["¡", "○", "¦", "–", "—", "”", "…", "’", "“"]

P1 = list(ASCII_PUNCTUATION) + CJK_MARKS
P2 = list(ASCII_PUNCTUATION) + TYPOGRAPHIC_MARKS
P3 = list(ASCII_PUNCTUATION) + TYPOGRAPHIC_MARKS + CJK_MARKS

PUNCT_SETS = {"P1": P1, "P2": P2, "P3": P3}

# Whitespace as Python's str.isspace() sees it (used by strip and the sentence split).
PY_SPACE = r"\t\n\x0B\f\r\x1C-\x1F \x{85}\p{Z}"
# Whitespace as the word pre-tokenizer sees it (Unicode White_Space).
TOKEN_SPACE = r"\t\n\x0B\f\r \x{85}\p{Z}"
# Characters the word pre-tokenizer treats as punctuation: Unicode P* plus the
# ASCII symbols it also splits off.
TOKEN_PUNCT = r"\p{P}$+<=>^`|~"
# One punctuation character, or a run of characters that are neither space nor punctuation.
TOKEN_PATTERN = f"[{TOKEN_PUNCT}]|[^{TOKEN_SPACE}{TOKEN_PUNCT}]+"
STRIP_PATTERN = f"^[{PY_SPACE}]+|[{PY_SPACE}]+$"
# Sentence boundary: whitespace run after . ! or ?
SENTENCE_SPLIT = f"(?<=[.!?])[{PY_SPACE}]+"


def strip(c: Column) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(c, STRIP_PATTERN, "")


def split_lines(c: Column) -> Column:
    return F.split(c, "\n")


def split_sentences(c: Column) -> Column:
    """Regex sentence splitter on an already stripped line.

    The split consumes the whole whitespace run after ``[.!?]`` and the line
    has no outer whitespace, so every piece is already stripped.
    """
    return F.split(c, SENTENCE_SPLIT)


def has_text(c: Column) -> Column:
    """``strip(c) != ''`` without computing the strip (one cheap regex find)."""
    return c.rlike(f"[^{PY_SPACE}]")


def word_tokens(c: Column) -> Column:
    """Word pre-tokenisation: whitespace split, each punctuation char its own token."""
    return F.regexp_extract_all(c, F.lit(TOKEN_PATTERN), 0)


def punct_set(name_or_list) -> list[str]:
    if isinstance(name_or_list, str):
        return PUNCT_SETS[name_or_list]
    return list(name_or_list)


def is_punct(c: Column, punct="P1") -> Column:
    return c.isin(*punct_set(punct))


def drop_punct(tokens: Column, punct="P1") -> Column:
    """Array filter removing punctuation tokens."""
    marks = F.array(*[F.lit(p) for p in punct_set(punct)])
    return F.filter(tokens, lambda t: ~F.array_contains(marks, t))


def valid_word(c: Column) -> Column:
    """At least one letter, not punctuation, not starting with ``#``, ``@`` or ``http``."""
    return (
        c.rlike(r"\p{L}")
        & ~is_punct(c, "P1")
        & ~c.startswith("#")
        & ~c.startswith("@")
        & ~c.startswith("http")
    )


def hash_key(*cols) -> Column:
    """Deterministic, partition-independent order key: md5 over '|'-joined strings."""
    parts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    return F.md5(F.concat_ws("|", *parts))


def hash_gold(*cols) -> Column:
    """A pseudo gold score in [0,1] from the first 16 bits of an md5."""
    return F.conv(F.substring(hash_key(*cols), 1, 4), 16, 10).cast("double") / F.lit(65535.0)


def strip_markers(c: Column) -> Column:
    """Remove sub-word markers ``##`` and ``▁``."""
    return F.replace(F.replace(c, F.lit("##"), F.lit("")), F.lit("▁"), F.lit(""))


def output_key(c: Column) -> Column:
    """Historical output key: strip leading spaces, inner spaces become ``▁``."""
    return F.replace(F.ltrim(c), F.lit(" "), F.lit("▁"))
