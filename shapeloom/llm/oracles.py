"""DuckDB SQL of the operators that SQL can express, built from the operators' own parameters."""

from __future__ import annotations

from shapeloom.llm import chat, quality, secrets

_WORD = "[^ \\t-\\r]"


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def quality_sql() -> str:
    q = quality
    words = "len(regexp_extract_all({}, " + lit(_WORD + "+") + "))"
    n = words.format("l")
    ok = " AND ".join(
        [
            f"(regexp_matches(l, {lit(q.ENDS)}) OR ({n} >= {q.LONG_LINE} AND regexp_matches(l, {lit(q.INSIDE)})))",
            f"len(regexp_extract_all(l, {lit(q.MARKS)})) <= {q.MAX_MARKS} * {n}",
            f"len(regexp_extract_all(l, {lit(q.SEPARATORS)})) <= {q.MAX_SEPARATORS} * {n}",
            f"NOT (regexp_matches(l, {lit(q.PHRASES)}) AND {n} <= {q.PHRASE_WORDS})",
        ]
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {lit(_WORD + "+")}) AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, {lit(_WORD)})) AS lines FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + {q.WINDOW - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {q.WINDOW - 2})) AS i FROM d WHERE len(w) >= {q.WINDOW})),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {q.WINDOW})) AS p FROM twice) GROUP BY doc_id),
good AS (SELECT doc_id, sum({n}) AS n FROM (SELECT doc_id, unnest(lines) AS l FROM d) WHERE {ok} GROUP BY doc_id),
r AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(hit.n, 0)::BIGINT AS n_repeat_words, coalesce(good.n, 0) AS kept_words
    FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN good ON good.doc_id = d.doc_id),
f AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND kept_words >= {1 - q.MAX_LOST} * n_words AS kept FROM f"""


def secrets_sql() -> str:
    parts = []
    for k, r in enumerate(secrets.RULES):
        p = lit(secrets._quick(r))  # runs of hex digits are maximal: their least length can stand in the pattern
        parts.append(
            f"""SELECT doc_id, {k} AS kind_no, {lit(r.kind)} AS kind, start, start + n AS stop FROM (
    SELECT doc_id, n, counted, sum(gap + n) OVER (PARTITION BY doc_id ORDER BY i) - n AS start FROM (
      SELECT doc_id, i, length(gaps[i]) AS gap, length(found[i]) AS n, length(sized[i]) AS counted FROM (
        SELECT doc_id, unnest(range(1, len(found) + 1)) AS i, string_split_regex(t, {p}) AS gaps, found, regexp_extract_all(t, {p}, {r.group}) AS sized FROM (
          SELECT doc_id, t, regexp_extract_all(t, {p}) AS found FROM d) WHERE len(found) > 0))) WHERE counted >= {r.least}"""
        )
    count = ", ".join(f"count(*) FILTER (kind = {lit(r.kind)}) AS n_{r.kind}" for r in secrets.BASE_RULES)
    shown = "kind || ':' || start || ':' || stop"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(parts)})
SELECT d.doc_id, {count}, sha256(coalesce(string_agg({shown}, ',' ORDER BY start, kind_no) FILTER (kind_no < {len(secrets.BASE_RULES)}), '')) AS base_sha256,
  coalesce(string_agg({shown}, ',' ORDER BY start, kind_no), '') AS spans FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id"""


def chat_sql(probe: str) -> str:
    esc = lambda c: f"length(regexp_replace({c}, {lit(chat._ESCAPE)}, {lit(chr(92) + '1' + chr(92) * 3 + '2' + chr(92) + '3')}, 'g'))"
    order = "ORDER BY turn, role, text"
    head = len(chat.OPEN + chat.ROLE + chat.CLOSE)
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', {lit(probe)} UNION ALL SELECT -1, 1, 'assistant', {lit(probe)}),
x AS (SELECT *, lag(role) OVER (PARTITION BY conv_id {order}) AS prev FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' {order}) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({esc("text")} + CASE WHEN prev IS NULL OR prev <> role THEN {head} + {esc("role")} ELSE {len(chat.NEXT)} END)::BIGINT AS formatted_chars
FROM x GROUP BY conv_id"""
