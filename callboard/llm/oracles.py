"""DuckDB SQL for the operators that SQL can express over whole tables."""

from __future__ import annotations

from callboard.llm.quality import BOILERPLATE, LEAST_WORDS, LOSS, REPEATED_PERCENT, SENTENCE_WORDS, SEPARATOR_EVERY, SEPARATOR_WORDS, SEPARATORS, SYMBOL_SHARE, SYMBOLS

OP9 = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(concat_ws(':', 'mix-1', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(md5(text), ''))) AS key
  FROM documents
), by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, source_size * 2.0::DOUBLE AS cap,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM by_source
), levelled AS (
  SELECT *, cap / weight AS ratio,
    ((SELECT sum(source_size) FROM by_source) * 1.5::DOUBLE
      - (sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) - cap))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), common AS (
  SELECT level FROM levelled WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1
), targets AS (
  SELECT source, source_size, least(cap, coalesce((SELECT level FROM common) * weight, cap)) AS target FROM levelled
), before AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, size ROWS UNBOUNDED PRECEDING) - size AS ahead FROM sized
)
SELECT b.doc_id, b.size, t.source_size, t.target,
  CAST(CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END * b.size
    + greatest(0, least(b.size, floor(t.target) - CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END * t.source_size - b.ahead)) AS BIGINT) AS taken
FROM before b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source
"""

OP8 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS win, i
  FROM (SELECT item_id, w, least(len(w), 13) AS size, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT rid, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)
), found AS (
  SELECT DISTINCT rid, dw.i, dw.size, item_id, bw.i AS j FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size
), hit AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM found) GROUP BY rid
), items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY rid
), runs AS (
  SELECT rid, item_id, any_value(size) AS size, count(*) AS n
  FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, item_id, i - j ORDER BY i) AS run FROM found) GROUP BY rid, item_id, i - j, run
), longest AS (
  SELECT rid, max(n - 1 + size) AS longest_match FROM runs GROUP BY rid
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
  CAST(coalesce(longest_match, 0) AS INTEGER) AS longest_match
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid) LEFT JOIN longest USING (rid)
"""

_PHRASES = "|".join(BOILERPLATE)
_SIGNS = ", ".join(f"'{w.decode()}'" for w in SEPARATOR_WORDS)
OP4 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), lines AS (
  SELECT rid, l, regexp_extract_all(l, '[^\x20\x09-\x0D]+') AS lw FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d)
), measured AS (
  SELECT rid, l, len(lw) AS n, coalesce(list_sum(list_transform(lw, lambda x: length(x))), 0) AS chars, len(list_filter(lw, lambda x: x IN ({_SIGNS}))) AS signs,
    len(regexp_extract_all(l, '[#*$%&|<>]')) AS symbols, regexp_matches(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_PHRASES}') AS phrase,
    regexp_matches(lw[-1], '[.!?"'':;)\]}}…”’»。！？]$') OR len(list_filter(lw, lambda x: regexp_matches(x, '[.!?]$'))) * {SENTENCE_WORDS} >= len(lw) AS closed
  FROM lines WHERE len(lw) > 0
), judged AS (
  SELECT rid, count(*) - count(DISTINCT l) AS n_dup_lines, count(*) FILTER (failed) AS n_failed_lines, coalesce(sum(chars) FILTER (failed), 0) AS lost_chars
  FROM (SELECT *, (signs >= {SEPARATORS} AND signs * {SEPARATOR_EVERY} >= n) OR (symbols >= {SYMBOLS} AND symbols >= CAST({SYMBOL_SHARE} AS DOUBLE) * chars) OR phrase OR NOT closed AS failed FROM measured) GROUP BY rid
), windows AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), repeated AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY rid, win) AS c FROM windows) WHERE c > 1) GROUP BY rid
), counted AS (
  SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(lost_chars, 0) AS BIGINT) AS lost_chars, coalesce(n_failed_lines, 0) AS n_failed_lines
  FROM d LEFT JOIN judged USING (rid) LEFT JOIN repeated USING (rid)
)
SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEATED_PERCENT} * n_words AS base_failed,
  NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEATED_PERCENT} * n_words) AND lost_chars <= CAST({LOSS} AS DOUBLE) * word_chars AS kept
FROM counted
"""

OP13 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), lines AS (
  SELECT rid, doc_id, i, lines[i] AS line, translate(trim(lines[i], E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT rid, doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT rid, doc_id, string_split(t, chr(10)) AS lines FROM d))
), often AS (
  SELECT key, max(doc_id) AS top FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT coalesce(doc_id, -rid)) >= 5
), judged AS (
  SELECT rid, i, line, o.top IS NOT NULL AND l.doc_id IS DISTINCT FROM o.top AS goes FROM lines l LEFT JOIN often o ON l.key = o.key
)
SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM d JOIN (
  SELECT rid, count(*) AS n_lines, count(*) FILTER (goes) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT goes), '')) AS kept_sha256 FROM judged GROUP BY rid
) USING (rid)
"""

OP12 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT row_number() OVER () AS bid, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark
), asked AS (
  SELECT bid, term, count(*) AS times FROM (SELECT bid, unnest(w) AS term FROM b) GROUP BY bid, term
), n AS (
  SELECT count(*) FILTER (len(w) > 0) AS n_all, CAST(sum(len(w)) AS BIGINT) AS l_all FROM d
), posting AS (
  SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY rid, term
), weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_all + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS wt FROM posting, n GROUP BY term, n_all
), scored AS (
  SELECT bid, rid, CAST(sum(times * wt * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * len(d.w) * n_all) // l_all)))) AS BIGINT) AS score
  FROM asked JOIN posting USING (term) JOIN weight USING (term) JOIN d USING (rid), n GROUP BY bid, rid
), ranked AS (
  SELECT bid, doc_id, score, row_number() OVER (PARTITION BY bid ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored JOIN d USING (rid) WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked JOIN b USING (bid) WHERE rank <= 10
"""


def _op11(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Plain k-means, round after round, with every part against every entry."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
  SELECT rid, p, min(struct_pack(d := d, e := e)) AS got FROM (
    SELECT x.rid, x.p, c.e, CAST(list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i]))) AS BIGINT) AS d FROM parts x JOIN c{k} c ON x.p = c.p
  ) GROUP BY rid, p
)""")
        if k < rounds:
            steps.append(f"""c{k + 1} AS MATERIALIZED (
  SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN (
    SELECT p, e, list(mean ORDER BY i) AS v FROM (
      SELECT p, e, i, CAST(floor(sum(y)::DOUBLE / count(*)) AS BIGINT) AS mean FROM (SELECT x.p, a.got.e AS e, unnest(range(1, len(x.v) + 1)) AS i, unnest(x.v) AS y FROM parts x JOIN a{k} a ON x.rid = a.rid AND x.p = a.p) GROUP BY p, e, i
    ) GROUP BY p, e
  ) m ON c.p = m.p AND c.e = m.e
)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS rid, vec_id, label, v FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
), parts AS MATERIALIZED (
  SELECT rid, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS v FROM kept, (SELECT unnest(range({parts})) AS p)
), c0 AS (
  SELECT p, rid - 1 AS e, v FROM parts WHERE rid <= {entries}
), {", ".join(steps)}, book AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds}
), coded AS (
  SELECT rid, string_agg(printf('%02x', got.e), '' ORDER BY p) AS code, CAST(sum(got.d) AS BIGINT) AS error FROM a{rounds} GROUP BY rid
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (rid), book
"""


ORACLE_SQL: dict[str, str] = {"op4_quality_rules": OP4, "op8_decontamination": OP8, "op9_mixing": OP9, "op11_vector_codes": _op11(), "op12_lexical_search": OP12, "op13_line_dedup": OP13}
