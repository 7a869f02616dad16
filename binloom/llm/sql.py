"""DuckDB SQL of the corpus queries that SQL can express."""

from .decontaminate import Seeds
from .quality_rules import RULES, STOP_WORDS

_WS = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP4 = f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, {_WS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), common AS (
  SELECT k, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT a.doc_id, a.pos, a.line, (c.k IS NOT NULL AND a.doc_id <> c.last_doc) AS lost FROM keyed a LEFT JOIN common c USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_CHECKS = " AND ".join(
    f"{r.metric} {op} {side}" for r in RULES for op, side in ((">=", r.low), ("<=", r.high)) if side is not None
)

OP5 = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), words AS (
  SELECT doc_id, generate_subscripts(w, 1) AS pos, unnest(w) AS word FROM d
), stats AS (
  SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars,
         count(*) FILTER (WHERE lower(word) IN ({', '.join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))})) AS n_stop
  FROM words GROUP BY doc_id
), windows AS (
  SELECT doc_id, pos, struct_pack(a := word, b := lead(word, 1) OVER s, c := lead(word, 2) OVER s, d := lead(word, 3) OVER s, e := lead(word, 4) OVER s) AS g,
         lead(pos, 4) OVER s AS last FROM words WINDOW s AS (PARTITION BY doc_id ORDER BY pos)
), twins AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows WHERE last IS NOT NULL) WHERE n > 1
), repeats AS (
  SELECT doc_id, sum(least(5, coalesce(nxt - pos, 5))) AS n FROM (SELECT doc_id, pos, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM twins) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (
    SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE trim(line, {_WS}) <> '' GROUP BY doc_id
), m AS (
  SELECT d.doc_id, coalesce(s.n_words, 0)::BIGINT AS n_words, coalesce(s.word_chars, 0)::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(l.dup, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         coalesce(s.word_chars / nullif(s.n_words, 0)::DOUBLE, 0) AS mean_word_chars,
         coalesce((length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g'))) / nullif(s.n_words, 0)::DOUBLE, 0) AS symbol_ratio,
         coalesce(s.n_stop / nullif(s.n_words, 0)::DOUBLE, 0) AS stop_ratio,
         coalesce(l.dup / nullif(l.n, 0)::DOUBLE, 0) AS dup_line_ratio,
         coalesce(r.n / nullif(s.n_words, 0)::DOUBLE, 0) AS repeat_word_ratio
  FROM d LEFT JOIN stats s USING (doc_id) LEFT JOIN repeats r USING (doc_id) LEFT JOIN lines l USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       (NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND {_CHECKS}) AS kept
FROM m
"""

_SEEDS = Seeds()


def _mask_rows(table: str, key: str) -> str:
    """Seeds as strings: one SELECT for each mask."""
    def one(mask: str) -> str:
        at = [i for i, bit in enumerate(mask) if bit == "1"]
        word = " || ' ' || ".join(f"w[p + {i}]" for i in at)
        return f"SELECT {key}, '{mask}' AS mask, p, {word} AS seed FROM (SELECT {key}, w, unnest(range(1, len(w) - {len(mask) - 2})) AS p FROM {table} WHERE len(w) >= {len(mask)})"

    return " UNION ALL ".join(one(m) for m in _SEEDS.masks)


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM benchmark),
ds AS ({_mask_rows("d", "doc_id")}),
bl AS (SELECT * FROM b WHERE len(w) >= {_SEEDS.min_words}),
bs AS ({_mask_rows("bl", "item_id")}),
short AS (SELECT item_id, w, len(w) AS n FROM b WHERE len(w) BETWEEN 1 AND {_SEEDS.min_words - 1}),
runs AS (SELECT doc_id, n, p, w[p : p + n - 1] AS w FROM (
  SELECT doc_id, d.w, n, unnest(range(1, len(d.w) - n + 2)) AS p FROM d JOIN (SELECT DISTINCT n FROM short) ON len(d.w) >= n)),
hits AS (SELECT DISTINCT doc_id, item_id, ds.p - bs.p AS g FROM ds JOIN bs USING (mask, seed)
  UNION SELECT doc_id, item_id, p - 1 FROM runs JOIN short USING (n, w)),
same AS (
  SELECT doc_id, item_id, g, CASE WHEN len(b.w) < {_SEEDS.min_words} THEN 1.0 ELSE {_SEEDS.min_match} END AS low, least(len(b.w), {_SEEDS.window}) AS span,
         list_transform(range(1, len(b.w) + 1), lambda q: CASE WHEN q + g >= 1 AND d.w[q + g] = b.w[q] THEN 1 ELSE 0 END) AS m
  FROM hits JOIN d USING (doc_id) JOIN b USING (item_id)
), shares AS (
  SELECT doc_id, item_id, max(list_max(list_transform(range(1, len(m) - span + 2), lambda q: list_sum(m[q : q + span - 1]))) / span::DOUBLE) AS share
       , any_value(low) AS low
  FROM same GROUP BY doc_id, item_id
), found AS (SELECT doc_id, count(*) AS n_items, max(share) AS best_share FROM shares WHERE share >= low GROUP BY doc_id)
SELECT doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, coalesce(best_share, 0.0) AS best_share
FROM documents LEFT JOIN found USING (doc_id)
"""


def _terms(key: str, table: str) -> str:
    """A row for each term of each text."""
    return f"SELECT {key}, unnest(regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM {table} WHERE {key} IS NOT NULL"


OP13 = f"""
WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM ({_terms("doc_id", "documents")}) GROUP BY ALL),
q AS (SELECT item_id, term, count(*) AS times FROM ({_terms("item_id", "benchmark")}) GROUP BY ALL),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM n),
w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM q) GROUP BY term), s
), scores AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN n USING (doc_id), s GROUP BY item_id, doc_id
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 20
"""

ORACLE = {"op4_line_dedup": OP4, "op5_quality_rules": OP5, "op6_decontamination": OP6, "op13_ranked_search": OP13}
