"""DuckDB SQL of the queries that SQL can express (plain restatements)."""

from . import licenses

ORACLE: dict[str, str] = {}

ORACLE["op1_warc"] = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

# Marks of eight characters each: turn, text, part, end.
ORACLE["op3_chat_formatting"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, length(replace(replace(role, '\', '\\'), '<|', '<\|')) AS role_chars,
         length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS text_chars,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS prev
  FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), ''
                    ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
                  FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(text_chars + CASE WHEN prev IS NOT DISTINCT FROM role THEN 8 ELSE 24 + role_chars END)::BIGINT
    AS formatted_chars
FROM e GROUP BY conv_id
"""

ORACLE["op6_quality_rules"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT r, doc_id, text,
    list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d),
windows AS (
  SELECT r, i, array_to_string(words[i:i+7], ' ') AS k
  FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM windows) WHERE n > 1),
reach AS (
  SELECT r, least(8, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 8)) AS n FROM again),
rep AS (SELECT r, sum(n)::BIGINT AS n FROM reach GROUP BY r),
m AS (
  SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT
      AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words
  FROM w LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 5 * n_symbols > n_words
       OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 25 * n_words) AS kept
FROM m
"""


def _folded(word: str) -> str:
    """``word`` with ASCII letters in either case."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join(map(_folded, ("password", "passwd", "secret", "token", "api_?key")))
_SECRETS = (  # kind, expression, group that counts, least characters
    ("assign", r"""(?:%s)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""" % _KEYWORDS, 1, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 0),
    ("private_key", "-----BEGIN (?:[A-Z]+ )?PRIVATE KEY(?: BLOCK)?-----"
     r"(?:[^-]*(?:-{1,4}[^-]+)*-{5,}END (?:[A-Z]+ )?PRIVATE KEY(?: BLOCK)?-----|"
     r"(?:(?:\s*[A-Za-z-]+: [^\n]*\n)*(?:[^A-Za-z0-9+/=]{0,12}[A-Za-z0-9+/]{16,}={0,2})+"
     r"(?:\r?\n[^A-Za-z0-9+/=\n]{0,12}[A-Za-z0-9+/]{1,15}={0,2})?)?)", 0, 0),
    ("github_pat", "github_pat_[A-Za-z0-9_]{22,}", 0, 0),
    ("aws_secret", r"""(?:%s)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9/+]{40}""" % _folded("aws_?secret_?access_?key"), 0, 0),
    ("stripe", "[rs]k_(?:live|test)_[A-Za-z0-9]{16,}", 0, 0),
    ("google", "AIza[A-Za-z0-9_-]{35}", 0, 0),
    ("npm", "npm_[A-Za-z0-9]{36}", 0, 0),
    ("url_password", r"://[^\s/:@]{1,100}:[^\s/@]{1,100}@", 0, 0),
)
_FOUND = " UNION ALL ".join(
    f"""SELECT r, {k} AS kind, '{name}' AS name, {least} AS least, regexp_extract_all(t, '{p}') AS m,
  regexp_extract_all(t, '{p}', {group}) AS v, string_split_regex(t, '{p}') AS b FROM d"""
    for k, (name, p, group, least) in enumerate(_SECRETS))
ORACLE["op4_secrets"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({_FOUND}),
u AS (SELECT r, kind, name, least, m, v, b, unnest(range(1, len(m) + 1)) AS i FROM f),
s AS (
  SELECT r, kind, name, length(m[i]) AS n,
    (list_sum(list_transform(b[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))))
      ::BIGINT AS e
  FROM u WHERE length(v[i]) >= least),
j AS (
  SELECT r, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access,
    count(*) FILTER (WHERE kind = 2) AS n_hex,
    string_agg(name || ':' || (e - n) || ':' || e, ',' ORDER BY e - n, kind) FILTER (WHERE kind < 3) AS base,
    string_agg(name || ':' || (e - n) || ':' || e, ',' ORDER BY e - n, kind) AS spans
  FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN j USING (r)
"""


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_KNOWN = "MAP {" + ", ".join(f"{_text(licenses.normal(s))}: {_text(i)}" for s, i in licenses.SENTENCES.items()) + "}"
_RULES = "|".join(licenses.marked(ids) for _, ids in licenses.RULES)
_NAMES = "MAP {" + ", ".join(f"{_text(licenses.marked(ids))}: {_text(n)}" for n, ids in licenses.RULES) + "}"
ORACLE["op10_licenses"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lower(coalesce(text, '')) AS t FROM documents),
s AS (
  SELECT r, i, x, trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g')) AS n
  FROM (SELECT r, unnest(b) AS x, generate_subscripts(b, 1) AS i
        FROM (SELECT r, string_split_regex(t, '[.!?;]+\s+|\n[ \t\r]*\n') AS b FROM d))),
k AS (
  SELECT r, i, x, coalesce(({_KNOWN})[n],
    CASE WHEN regexp_matches(n, '^copyright (c )?[0-9]{{4}}') THEN 'copyright' END) AS id FROM s),
l AS (
  SELECT r, i, j, trim(regexp_replace(y, '[^a-z0-9]+', ' ', 'g')) AS n
  FROM (SELECT r, i, unnest(b) AS y, generate_subscripts(b, 1) AS j
        FROM (SELECT r, i, string_split(x, chr(10)) AS b FROM k WHERE id IS NULL AND contains(x, chr(10))))),
ids AS (
  SELECT r, i, 0 AS j, id FROM k WHERE id IS NOT NULL
  UNION ALL
  SELECT r, i, j, coalesce(({_KNOWN})[n],
    CASE WHEN regexp_matches(n, '^copyright (c )?[0-9]{{4}}') THEN 'copyright' END) FROM l),
g AS (
  SELECT r, string_agg(id, ',' ORDER BY i, j) AS ids,
    coalesce(string_agg('<' || id || '>', '' ORDER BY i, j)
      FILTER (WHERE id NOT IN ('copyright', 'all-rights')), '') AS q,
    bool_or(id IN ('copyright', 'all-rights')) AS notice
  FROM ids WHERE id IS NOT NULL GROUP BY r),
m AS (
  SELECT r, ids, q, notice, list_transform(regexp_extract_all(q, '{_RULES}'), lambda x: ({_NAMES})[x]) AS found FROM g)
SELECT doc_id, coalesce(ids, '') AS sentence_ids,
  coalesce(array_to_string(list_filter(found, lambda x, i: list_position(found, x) = i), ','), '') AS licenses,
  coalesce(regexp_replace(regexp_replace(regexp_replace(q, '{_RULES}', '', 'g'), '^<|>$', '', 'g'), '><', ',', 'g'),
    '') AS unmatched,
  coalesce(notice, false) AS has_notice
FROM d LEFT JOIN m USING (r)
"""

ORACLE["op11_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
  sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""

ORACLE["op13_ranked_search"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
q AS (
  SELECT DISTINCT i, item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM (SELECT row_number() OVER () AS i, * FROM benchmark)),
tot AS (SELECT count(*) FILTER (WHERE len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d),
p AS (
  SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(terms) AS t FROM d)
  WHERE t IN (SELECT t FROM q) GROUP BY r, t),
w AS (
  SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM p, tot GROUP BY t, n_docs),
s AS (
  SELECT q.i, item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(terms) * n_docs) // n_terms))))
    ::BIGINT AS score
  FROM q JOIN p USING (t) JOIN w USING (t) JOIN d USING (r), tot GROUP BY q.i, item_id, r),
o AS (
  SELECT item_id, doc_id, score,
    row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank
  FROM s JOIN d USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10
"""
