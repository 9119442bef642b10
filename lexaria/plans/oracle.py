"""DuckDB oracle: the derived relations of ``fixtures`` written as SQL CTEs.

Independent re-statement of the same semantics in plain SQL (no look-behind:
the sentence split inserts a separator after ``[.!?]`` + whitespace instead).
"""

from __future__ import annotations

from lexaria.functions import text as T


def _sql_list(items) -> str:
    return ", ".join("'" + p.replace("'", "''") + "'" for p in items)


P1_SQL = _sql_list(T.P1)
P2_SQL = _sql_list(T.P2)
P3_SQL = _sql_list(T.P3)
STRIP = T.STRIP_PATTERN
TOK = T.TOKEN_PATTERN
WS = T.PY_SPACE


def strip(x: str) -> str:
    return f"regexp_replace({x}, '{STRIP}', '', 'g')"


def gold(*exprs: str) -> str:
    """Same pseudo gold as ``text.hash_gold``: first 16 bits of md5 of '|'-joined casts."""
    joined = "concat_ws('|', " + ", ".join(f"CAST({e} AS VARCHAR)" for e in exprs) + ")"
    return f"(CAST(('0x' || substr(md5({joined}), 1, 4)) AS INTEGER) / 65535.0)"


def dot(a: str, b: str) -> str:
    return f"list_reduce(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]), lambda x, y: x + y, 0.0)"


def norm(a: str) -> str:
    return f"sqrt(list_reduce(list_transform({a}, lambda x: x * x), lambda x, y: x + y, 0.0))"


def r6(x: str, d: int = 6) -> str:
    return f"(round(CAST({x} AS DOUBLE), {d}) + 0.0)"


CTES: dict[str, tuple[list[str], str]] = {
    "lines": ([], f"""
SELECT doc_id, CAST(i - 1 AS BIGINT) AS line_no, {strip('raw')} AS line
FROM (SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS raw
      FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))
WHERE {strip('raw')} <> ''"""),
    "sentences": (["lines"], f"""
SELECT doc_id, line_no, CAST(j - 1 AS BIGINT) AS sent_no, {strip('piece')} AS sentence
FROM (SELECT doc_id, line_no, generate_subscripts(ps, 1) AS j, unnest(ps) AS piece
      FROM (SELECT doc_id, line_no,
                   string_split(regexp_replace(line, '([.!?])[{WS}]+', '\\1' || chr(1), 'g'), chr(1)) AS ps
            FROM lines))
WHERE length({strip('piece')}) > 10"""),
    "tokens": (["sentences"], f"""
SELECT doc_id, line_no, sent_no, CAST(k - 1 AS BIGINT) AS tok_pos, word
FROM (SELECT doc_id, line_no, sent_no, generate_subscripts(ts, 1) AS k, unnest(ts) AS word
      FROM (SELECT doc_id, line_no, sent_no, regexp_extract_all(lower(sentence), '{TOK}') AS ts FROM sentences))
WHERE word NOT IN ({P1_SQL})"""),
    "counts": (["tokens"], """
SELECT word, CAST(count(*) AS BIGINT) AS freq,
       min((doc_id, line_no, sent_no, tok_pos)) AS first
FROM tokens GROUP BY word"""),
    "vocab_all": (["counts"], f"""
SELECT word, freq,
       CAST(row_number() OVER (ORDER BY freq DESC, first) - 1 AS BIGINT) AS word_idx
FROM counts
WHERE freq >= 10 AND length(word) >= 3 AND regexp_matches(word, '\\p{{L}}')
  AND word NOT IN ({P1_SQL}) AND NOT starts_with(word, '#') AND NOT starts_with(word, '@')
  AND NOT starts_with(word, 'http')"""),
    "vocab": (["vocab_all"], """
SELECT * FROM vocab_all"""),
    "emb": ([], """
SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings"""),
    "word2vec": (["vocab", "emb"], """
SELECT v.word, e.vec FROM vocab v JOIN emb e ON v.word_idx % (SELECT count(*) FROM embeddings) = e.vec_id"""),
    "conv_pairs": ([], f"""
SELECT lpad(CAST(u.conv_id AS VARCHAR), 19, '0') || '-' || lpad(CAST(u.turn AS VARCHAR), 19, '0') AS pair_id, u.text AS a, n.text AS b,
       {gold('u.conv_id', 'u.turn')} AS gold
FROM conversations u JOIN conversations n ON n.conv_id = u.conv_id AND n.turn = u.turn + 1
WHERE u.role = 'user'"""),
    "word_pairs": (["vocab"], f"""
SELECT a.word_idx AS pair_id, a.word AS a,
       CASE WHEN {gold('a.word_idx', "'oov'")} < 0.2 THEN b.word || 'zzq' ELSE b.word END AS b,
       {gold('a.word_idx')} AS gold
FROM vocab a JOIN vocab b ON b.word_idx = a.word_idx + 1"""),
    "contexts": (["emb"], """
SELECT 'w' || CAST(label AS VARCHAR) AS word, vec_id AS ctx, vec FROM emb"""),
}


def with_ctes(needed: list[str], body: str) -> str:
    """Assemble ``WITH`` for the CTEs ``needed`` (and their dependencies), then ``body``."""
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        deps, _ = CTES[n]
        for d in deps:
            visit(d)
        order.append(n)

    for n in needed:
        visit(n)
    if not order:
        return body.strip()
    parts = [f"{n} AS ({CTES[n][1].strip()})" for n in order]
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()


def add_cte(name: str, deps: list[str], sql: str) -> None:
    CTES[name] = (deps, sql)
