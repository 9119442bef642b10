"""The word pre-tokenizer over Arrow text columns, many texts at a time.

``text.word_tokens`` and ``text.drop_punct`` cut a text in the JVM token by token; here the bytes of a batch are
classed by a table and cut together.  The table is what the same patterns answer for every character, asked of
Spark once a session, so both give the same tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexaria.functions import text as T

WORD, SPACE, MARK, DROPPED = range(4)
SLICE_BYTES = 1 << 22
_BLOCK, _SURROGATES, _END = 1 << 11, 0xD800, 0x110000

_RUNS: list = []


def char_runs(spark: SparkSession) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of characters of one class begin, and their classes; punctuation of P1 is ``DROPPED``."""
    if not _RUNS:
        rows = [(a, "".join(map(chr, range(a, a + _BLOCK)))) for a in range(0, _END, _BLOCK) if a != _SURROGATES]
        told = F.regexp_replace(F.regexp_replace("s", f"[{T.TOKEN_PUNCT}]", "!"), f"[{T.TOKEN_SPACE}]", " ")
        kinds = np.full(_END, WORD, np.uint8)
        for a, s in spark.createDataFrame(rows, "a int, s string").select("a", told).collect():
            kinds[a:a + _BLOCK] = [MARK if c == "!" else SPACE if c == " " else WORD for c in s]
        marks = [ord(c) for c in T.P1]
        assert (kinds[marks] == MARK).all()  # each is a token of its own, never part of a word
        kinds[marks] = DROPPED
        at = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1]])
        _RUNS.append((at, kinds[at]))
    return _RUNS[0]


def table(runs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The class of every code point."""
    return np.repeat(runs[1], np.diff(np.r_[runs[0], _END]))


def _kinds(data: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """The class of every byte: that of its character."""
    kind = np.r_[chars[:128], np.full(128, WORD, np.uint8)][data]
    at = np.flatnonzero(data >= 0xC0)
    if len(at):
        lead, behind = data[at].astype(np.int32), np.r_[data, np.zeros(3, np.uint8)].astype(np.int32) & 0x3F
        wide = 2 + (lead >= 0xE0) + (lead >= 0xF0)
        a, b, c = (behind[at + k] for k in (1, 2, 3))
        code = np.select([wide == 2, wide == 3], [(lead & 0x1F) << 6 | a, (lead & 0x0F) << 12 | a << 6 | b],
                         (lead & 0x07) << 18 | a << 12 | b << 6 | c)
        own = chars[code]
        for k in range(4):
            has = wide > k
            kind[at[has] + k] = own[has]
    return kind


def _cut(data: np.ndarray, ends: np.ndarray, chars: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The tokens of texts that lie one behind the other up to ``ends``, how many each text has, and their places among
    all tokens of their text, dropped ones too."""
    kind = _kinds(data, chars)
    word = kind == WORD
    goes_on = np.r_[False, word[:-1]]
    begins = np.r_[0, ends[:-1]]
    goes_on[begins[begins < len(data)]] = False
    start = np.where(word, ~goes_on[:len(data)], (kind >= MARK) & (data & 0xC0 != 0x80))
    keep = word | (kind == MARK)  # the bytes of the tokens, and no others
    kept = data[keep]
    offsets = np.r_[np.flatnonzero(start[keep]), len(kept)].astype(np.int32)
    tokens = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(kept))
    at = np.flatnonzero(start)
    bounds, held = np.searchsorted(at, np.r_[0, ends]), keep[at]
    places = np.arange(len(at)) - np.repeat(bounds[:-1], np.diff(bounds))
    return tokens, np.diff(np.r_[0, np.cumsum(held)][bounds]), places[held]


def cut_texts(texts: pa.Array, chars: np.ndarray, step: int = 1) -> Iterator[tuple[int, int, pa.Array, np.ndarray, np.ndarray]]:
    """(first text, end, and ``_cut`` of them) of some texts at a time, a multiple of ``step``; a null text has no tokens."""
    texts = texts.fill_null("")
    try:
        texts.validate(full=True)
    except pa.ArrowInvalid:  # bytes that are no text: as the JVM reads them
        texts = pa.array([x.decode("utf-8", "replace") for x in texts.cast(pa.binary()).to_pylist()], pa.string())
    n = len(texts)
    if not n:
        return
    _, where, bytes_ = texts.buffers()
    ends = np.frombuffer(where, np.int32)[texts.offset:texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bytes_, np.uint8) if bytes_ is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(ends, ends[a] + SLICE_BYTES, side="right")) - 1
        b = min(n, max(a + step, a + (b - a) // step * step))
        yield a, b, *_cut(data[ends[a]:ends[b]], ends[a + 1:b + 1] - ends[a], chars)
        a = b
