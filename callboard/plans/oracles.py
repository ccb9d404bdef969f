"""DuckDB SQL for the queries that SQL can express, under the same names."""

from __future__ import annotations

PROGRAMS = """programs AS (
  SELECT *, CASE WHEN value_kind IN ('exact', 'minimum', 'maximum') THEN money END AS funding,
    CASE WHEN value_kind = 'exact' THEN money END AS exact_amount, CASE WHEN value_kind = 'minimum' THEN money END AS min_amount,
    CASE WHEN value_kind = 'maximum' THEN money END AS max_amount
  FROM (SELECT o_orderkey AS program_id, n_name AS source_key, CASE WHEN o_orderstatus = 'P' THEN 'hidden' ELSE 'published' END AS publication_status,
      o_orderstatus AS source_status, o_orderdate AS published_at, CAST(o_orderdate AS DATE) AS deadline_on,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'exact' WHEN '2-HIGH' THEN 'minimum' WHEN '3-MEDIUM' THEN 'maximum' WHEN '4-NOT SPECIFIED' THEN 'not_stated' WHEN '5-LOW' THEN 'unknown' END AS value_kind,
      CAST(o_totalprice AS DECIMAL(14,2)) AS money, 'Call ' || o_orderkey AS title, c_mktsegment AS support_type, CAST(year(o_orderdate) AS INTEGER) AS launch_year
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
)"""
THEMES = "themes AS (SELECT DISTINCT l_orderkey AS program_id, p_type AS slug FROM lineitem JOIN part ON l_partkey = p_partkey)"
GEOGRAPHIES = """geographies AS (SELECT DISTINCT l_orderkey AS program_id, r_name AS slug FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
LINKS = "links AS (SELECT l_suppkey AS src, p_brand AS dst, l_orderkey AS program_id FROM lineitem JOIN part ON l_partkey = p_partkey)"
MEMBERS = """members AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS week_start, user_id AS entity, CAST(floor(max(value) / 50) AS INTEGER) AS level, CAST(count(*) AS INTEGER) AS entries, list_sort(list(DISTINCT event_type)) AS kinds
  FROM events GROUP BY ALL),
links AS (SELECT week_start, lag(week_start) OVER (ORDER BY week_start) AS previous_week FROM (SELECT DISTINCT week_start FROM members)),
pairs AS (SELECT coalesce(n.week_start, b.week_start) AS week_start, coalesce(n.entity, b.entity) AS entity, n.entity IS NOT NULL AS in_now, b.entity IS NOT NULL AS in_before,
    n.level, b.level AS level_before, n.entries, b.entries AS entries_before, n.kinds, b.kinds AS kinds_before
  FROM members n FULL JOIN (SELECT links.week_start, m.entity, m.level, m.entries, m.kinds FROM members m JOIN links ON links.previous_week = m.week_start) b ON n.week_start = b.week_start AND n.entity = b.entity)"""
YEARS = """history AS (SELECT program_id, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(l_extendedprice AS DECIMAL(14,2)) AS funding FROM programs JOIN lineitem ON l_orderkey = program_id),
points AS (SELECT year, count(DISTINCT program_id) AS active, CAST(sum(funding) AS DOUBLE) AS total FROM history GROUP BY year),
years AS (SELECT coalesce(l.year, p.year) AS year, coalesce(launched, 0) AS launched, coalesce(active, 0) AS active, coalesce(total, 0) AS total
  FROM (SELECT launch_year AS year, count(*) AS launched FROM programs GROUP BY 1) l FULL JOIN points p ON l.year = p.year)"""
URL = r"regexp_replace(regexp_replace(lower(regexp_extract(url, '^(https?://[^/?#]*)', 1)) || regexp_extract(url, '^https?://[^/?#]*([^#]*)', 1), '^(https?://[^/?#]*)$', '\1/'), '^(https?://[^/?#]*)\?', '\1/?')"


def using(*tables: str) -> str:
    return "WITH RECURSIVE " + ", ".join(tables) + " "


def quartile(value: str, p: float, digits: int | None = 2) -> str:
    """Linear interpolation; digits: rounded half-even, after binary noise is rounded away."""
    q = f"quantile_cont(CAST({value} AS DOUBLE), {p})"
    if digits is None:
        return q
    return f"CAST(round_even(CAST(round({q}, 6) AS DECIMAL(20,6)), {digits}) AS DOUBLE)"


ORACLE_SQL: dict[str, str] = {
    "baseline_source_share": using(PROGRAMS) + f"""
SELECT n_name AS source_key, coalesce(c.n, 0) AS n, round(coalesce(c.n, 0) / CAST((SELECT count(*) FROM programs) AS DOUBLE), 12) AS share, n_numeric, q25, median, q75
FROM nation LEFT JOIN (SELECT source_key, count(DISTINCT program_id) AS n, count(funding) AS n_numeric, {quartile('funding', 0.25)} AS q25, {quartile('funding', 0.5)} AS median, {quartile('funding', 0.75)} AS q75
  FROM programs GROUP BY 1) c ON n_name = source_key""",
    "catalog_page_published": using(PROGRAMS) + "SELECT program_id, source_key, source_status, deadline_on, value_kind FROM programs WHERE publication_status = 'published' ORDER BY deadline_on DESC NULLS LAST, program_id LIMIT 50 OFFSET 100",
    "catalog_filter_groups": using(PROGRAMS, THEMES) + """SELECT program_id, source_key, source_status, deadline_on FROM programs p WHERE publication_status = 'published'
  AND source_key IN ('FRANCE', 'CHINA', 'NATION_1', 'NATION_2', 'NATION_3') AND source_status IN ('F', 'O') AND deadline_on BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'
  AND EXISTS (SELECT 1 FROM themes t WHERE t.program_id = p.program_id AND slug IN ('ECONOMY', 'SMALL'))""",
    "catalog_total": using(PROGRAMS, GEOGRAPHIES) + """SELECT count(*) AS total FROM programs p WHERE publication_status = 'published' AND value_kind IN ('exact', 'unknown') AND contains(lower(title), 'call 1')
  AND EXISTS (SELECT 1 FROM geographies g WHERE g.program_id = p.program_id AND slug IN ('ASIA', 'EUROPE'))""",
    "catalog_unknown_status": using(PROGRAMS) + """SELECT program_id, coalesce(s, 'unknown') AS source_status FROM programs LEFT JOIN (SELECT l_orderkey, max(l_linestatus) AS s FROM lineitem GROUP BY 1) ON l_orderkey = program_id
  WHERE coalesce(s, 'unknown') IN ('unknown', 'F')""",
    "catalog_facets": using(PROGRAMS, "p AS (SELECT * FROM programs WHERE publication_status = 'published')") + """
SELECT 'source_key' AS facet, source_key AS value, count(*) AS programs FROM p GROUP BY ALL UNION ALL SELECT 'value_kind', value_kind, count(*) FROM p GROUP BY ALL
UNION ALL SELECT 'support_type', support_type, count(*) FROM p GROUP BY ALL
UNION ALL SELECT 'deadline_from', CAST(min(deadline_on) AS VARCHAR), count(deadline_on) FROM p UNION ALL SELECT 'deadline_to', CAST(max(deadline_on) AS VARCHAR), count(deadline_on) FROM p""",
    "source_counts": using(PROGRAMS) + "SELECT n_name AS source_key, (SELECT count(*) FROM programs WHERE source_key = n_name AND publication_status = 'published') AS programs FROM nation",
    "nearest_deadlines": using(PROGRAMS) + "SELECT program_id, deadline_on FROM programs WHERE deadline_on >= DATE '1998-06-01' ORDER BY deadline_on, program_id LIMIT 5",
    "taxonomy_canonical": """WITH t AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'manual-' ELSE 'part-' END || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS slug, lower(trim(p_name)) AS name_key FROM part)
SELECT slug, name_key, first_value(slug) OVER (PARTITION BY name_key ORDER BY starts_with(slug, 'manual-'), slug) AS canonical_slug FROM t""",
    "in_given_order": using(PROGRAMS) + "SELECT program_id, position, source_key FROM (SELECT l_orderkey, min(l_linenumber + 10 * l_partkey) AS position FROM lineitem GROUP BY 1) JOIN programs ON l_orderkey = program_id",
    "program_details": using(PROGRAMS) + """SELECT program_id, source_key, coalesce(lines, '') AS lines FROM programs
  LEFT JOIN (SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS lines FROM lineitem GROUP BY 1) ON l_orderkey = program_id""",
    "baseline_funding_states": using(PROGRAMS) + """SELECT coalesce(value_kind, 'missing_record') AS state, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM programs) AS DOUBLE), 12) AS share,
  coalesce(value_kind, '-') IN ('exact', 'minimum', 'maximum', 'range') AS is_numeric, value_kind IS NOT NULL AS has_record FROM programs GROUP BY value_kind""",
    "baseline_funding_quantiles": using(PROGRAMS) + f"""SELECT 'USD' AS currency_code, value_kind, CASE value_kind WHEN 'exact' THEN 'exact' WHEN 'minimum' THEN 'min' ELSE 'max' END AS measure, count(*) AS n,
  {quartile('funding', 0.25)} AS q25, {quartile('funding', 0.5)} AS median, {quartile('funding', 0.75)} AS q75 FROM programs WHERE funding IS NOT NULL GROUP BY ALL""",
    "baseline_deadline_days": using(PROGRAMS, "d AS (SELECT *, CASE WHEN deadline_on >= DATE '1998-06-01' THEN date_diff('day', DATE '1998-06-01', deadline_on) END AS days FROM programs)") + f"""
SELECT count(*) AS total, count(deadline_on) AS present, count(days) AS upcoming, count(*) FILTER (deadline_on < DATE '1998-06-01') AS overdue, round(count(deadline_on) / CAST(count(*) AS DOUBLE), 12) AS presence_share,
  round(count(days) / CAST(count(*) AS DOUBLE), 12) AS upcoming_share, {quartile('days', 0.25, None)} AS days_q25, {quartile('days', 0.5, None)} AS days_median, {quartile('days', 0.75, None)} AS days_q75 FROM d""",
    "quality_ratios": using(PROGRAMS, """c AS (SELECT event_type = 'signup' AS canonical, value < 40 AS pending, user_id % 7 = 0 AS conflict FROM events WHERE event_type IN ('signup', 'purchase'))""", """
  r AS (SELECT 'freshness' AS metric_key, count(*) FILTER (published_at >= TIMESTAMP '1998-06-01' - INTERVAL 365 DAY AND published_at <= TIMESTAMP '1998-06-01') AS numerator, count(*) AS denominator FROM programs
  UNION ALL SELECT 'completeness', count(*) FILTER (source_status <> 'P' AND value_kind IS NOT NULL), count(*) FROM programs
  UNION ALL SELECT 'conflict', count(*) FILTER (canonical AND pending AND conflict), count(*) FILTER (canonical AND pending) FROM c
  UNION ALL SELECT 'source_coverage', (SELECT count(DISTINCT user_id) FROM events WHERE user_id IN (SELECT c_custkey FROM customer) AND event_type NOT IN ('error', 'view')
    AND ts BETWEEN TIMESTAMP '1998-06-01' - INTERVAL 365 DAY AND TIMESTAMP '1998-06-01'), (SELECT count(*) FROM customer)
  UNION ALL SELECT 'review_status', count(*) FILTER (pending), count(*) FROM c)""") + "SELECT *, round(CASE WHEN denominator <> 0 THEN numerator / CAST(denominator AS DOUBLE) END, 12) AS value FROM r",
    "execution_coverage": """SELECT c_custkey AS source_key, coalesce(n, 0) AS executions, coalesce(ok, 0) AS covered
FROM customer LEFT JOIN (SELECT user_id, count(*) AS n, CAST(max(CASE WHEN event_type NOT IN ('error', 'view') THEN 1 ELSE 0 END) AS INTEGER) AS ok FROM events GROUP BY 1) ON user_id = c_custkey""",
    "snapshot_exclusions": using(PROGRAMS) + """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN publication_status <> 'published' THEN 'not_published' WHEN published_at > TIMESTAMP '2000-01-01' THEN 'published_after_as_of'
  WHEN published_at + INTERVAL 30 DAY > TIMESTAMP '2000-01-01' THEN 'updated_after_as_of' WHEN support_type = 'MACHINERY' THEN 'source_not_active'
  WHEN published_at + INTERVAL 90 DAY > TIMESTAMP '2000-01-01' THEN 'observed_after_as_of' END AS reason FROM programs) WHERE reason IS NOT NULL GROUP BY 1""",
    "regional_coverage": using(PROGRAMS, THEMES) + """SELECT total, labelled, total - labelled AS unlabelled, assignments, categories, round(labelled / CAST(total AS DOUBLE), 12) AS labelled_share
  FROM (SELECT count(*) AS total FROM programs), (SELECT count(DISTINCT program_id) AS labelled, count(*) AS assignments, count(DISTINCT slug) AS categories FROM themes)""",
    "regional_category": using(PROGRAMS, GEOGRAPHIES) + """SELECT slug, count(DISTINCT program_id) AS n, round(count(DISTINCT program_id) / CAST((SELECT count(*) FROM programs) AS DOUBLE), 12) AS share_of_all,
  round(count(DISTINCT program_id) / CAST((SELECT count(DISTINCT program_id) FROM geographies) AS DOUBLE), 12) AS share_of_labelled, CASE WHEN count(DISTINCT program_id) < 5 THEN 'small_sample' ELSE 'ok' END AS sample FROM geographies GROUP BY 1""",
    "regional_by_source": using(PROGRAMS, THEMES) + "SELECT slug, source_key, count(DISTINCT program_id) AS n FROM themes JOIN programs USING (program_id) GROUP BY ALL",
    "regional_leave_one_out": using(PROGRAMS, GEOGRAPHIES, "per AS (SELECT slug, source_key, count(DISTINCT program_id) AS n FROM geographies JOIN programs USING (program_id) GROUP BY ALL)") + """
SELECT slug, source_key, n_all - coalesce(n, 0) AS n_without, total - size AS total_without, round((n_all - coalesce(n, 0)) / CAST(total - size AS DOUBLE), 12) AS share_without
FROM (SELECT slug, CAST(sum(n) AS BIGINT) AS n_all FROM per GROUP BY 1) CROSS JOIN (SELECT source_key, count(*) AS size FROM programs GROUP BY 1) CROSS JOIN (SELECT count(*) AS total FROM programs) LEFT JOIN per USING (slug, source_key)""",
    "network_edges": using(LINKS) + "SELECT src, dst, count(DISTINCT program_id) AS weight FROM links GROUP BY ALL",
    "network_node_metrics": using(LINKS, "e AS (SELECT src, dst, count(DISTINCT program_id) AS w FROM links GROUP BY ALL)", """n AS (
  SELECT 'source' AS side, CAST(s_suppkey AS VARCHAR) AS node, count(w) AS degree, CAST(coalesce(sum(w), 0) AS BIGINT) AS strength FROM supplier LEFT JOIN e ON src = s_suppkey GROUP BY s_suppkey
  UNION ALL SELECT 'target', dst, count(*), CAST(sum(w) AS BIGINT) FROM e GROUP BY dst)""") + """SELECT side, node, degree, strength, round(degree / CAST(nullif((SELECT count(*) FROM n m WHERE m.side <> n.side), 0) AS DOUBLE), 12) AS centrality FROM n""",
    "network_density": using(LINKS) + """SELECT edges, sources, targets, round(edges / CAST(sources * targets AS DOUBLE), 12) AS density, sources < 3 OR targets < 5 AS small_graph
  FROM (SELECT count(DISTINCT (src, dst)) AS edges, count(DISTINCT dst) AS targets FROM links), (SELECT count(*) AS sources FROM supplier)""",
    "network_components": """WITH n AS (SELECT 's:' || c_custkey AS node, 's:' || c_custkey AS component FROM customer UNION ALL SELECT 't:' || o_orderkey, 's:' || o_custkey FROM orders)
SELECT node, component, dense_rank() OVER (ORDER BY component) AS number FROM n""",
    "weekly_latest": """WITH w AS (SELECT event_type, user_id, CAST(date_trunc('week', ts) AS DATE) AS week_start, event_id, ts FROM events)
SELECT event_type, user_id, week_start, arg_max(event_id, (ts, event_id)) AS snapshot_id, count(*) - 1 AS omitted FROM w GROUP BY ALL""",
    "weekly_calendar": """WITH weeks AS (SELECT CAST(unnest(generate_series(date_trunc('week', min(ts)), date_trunc('week', max(ts)), INTERVAL 7 DAY)) AS DATE) AS week_start FROM events),
s AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS week_start, arg_max(event_id, (ts, event_id)) AS snapshot_id FROM events GROUP BY 1),
e AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS week_start, max(ts) AS as_of FROM events GROUP BY 1), f AS (SELECT min(ts) AS a, max(ts) AS b FROM events),
l AS (SELECT s.*, as_of, lag(week_start) OVER (ORDER BY week_start) AS previous_week, lag(as_of) OVER (ORDER BY week_start) AS previous_as_of FROM s JOIN e USING (week_start))
SELECT week_start, snapshot_id, previous_week, CASE WHEN snapshot_id IS NULL THEN 'no_snapshot' WHEN previous_week IS NULL THEN 'no_prior_snapshot' ELSE 'computed' END AS status,
  CASE WHEN previous_week IS NOT NULL THEN greatest(0, date_diff('day', previous_week, week_start) // 7 - 1) END AS gap_weeks,
  week_start < CAST(a AS DATE) OR week_start + 6 > CAST(b AS DATE) AS partial, round(epoch(as_of) - epoch(previous_as_of), 3) AS interval_seconds, CASE WHEN previous_week IS NOT NULL AND date_diff('day', previous_week, week_start) > 7 THEN 'snapshot_gap_no_interpolation' END AS warning
FROM weeks LEFT JOIN l USING (week_start) CROSS JOIN f""",
    "weekly_intake_removed": using(MEMBERS) + """SELECT l.week_start, l.previous_week, count(*) FILTER (in_now) AS stock, CASE WHEN l.previous_week IS NOT NULL THEN count(*) FILTER (in_now AND NOT in_before) END AS newly_observed,
  CASE WHEN l.previous_week IS NOT NULL THEN count(*) FILTER (NOT in_now AND in_before) END AS removed, CASE WHEN l.previous_week IS NOT NULL THEN count(*) END AS sample_size
  FROM links l JOIN pairs p ON p.week_start = l.week_start GROUP BY 1, 2""",
    "weekly_membership_changes": using(MEMBERS) + """SELECT week_start, count(*) AS compared, count(*) FILTER (level IS DISTINCT FROM level_before) AS level_changes, count(*) FILTER (entries IS DISTINCT FROM entries_before) AS entries_changes, count(*) FILTER (kinds IS DISTINCT FROM kinds_before) AS kinds_changes,
  count(*) FILTER (level IS DISTINCT FROM level_before OR entries IS DISTINCT FROM entries_before OR kinds IS DISTINCT FROM kinds_before) AS any_change FROM pairs WHERE in_now AND in_before GROUP BY 1""",
    "weekly_transitions": using(MEMBERS) + "SELECT week_start, level_before AS before, level AS now, count(*) AS n FROM pairs WHERE in_now AND in_before AND level IS DISTINCT FROM level_before GROUP BY ALL",
    "weekly_category_points": using(MEMBERS, "m AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS week_start, user_id AS entity, event_type AS category FROM events)") + """
SELECT week_start, category, coalesce(n, 0) AS n, round(coalesce(n, 0) / CAST(stock AS DOUBLE), 12) AS share FROM (SELECT week_start FROM links) CROSS JOIN (SELECT DISTINCT category FROM m)
LEFT JOIN (SELECT week_start, category, count(DISTINCT entity) AS n FROM m GROUP BY ALL) USING (week_start, category) LEFT JOIN (SELECT week_start, count(DISTINCT entity) AS stock FROM m GROUP BY 1) USING (week_start)""",
    "snapshot_compare": """WITH s AS (SELECT event_type AS series, CAST(date_trunc('week', ts) AS DATE) AS week, count(DISTINCT user_id) AS programs FROM events GROUP BY ALL),
v AS (SELECT *, CASE WHEN month(week) = 1 THEN CASE WHEN day(week) > 20 THEN 'v3' ELSE 'v2' END ELSE 'v1' END AS version FROM s),
l AS (SELECT *, lag(week) OVER w AS previous, lag(programs) OVER w AS before, lag(version) OVER w AS old FROM v WINDOW w AS (PARTITION BY series ORDER BY week))
SELECT series, series || '/' || week AS snapshot_id, series || '/' || previous AS previous_id, CASE WHEN version <> old THEN 'calculation_version' ELSE '' END AS reasons,
  CASE WHEN version = old THEN programs - before END AS difference FROM l WHERE previous IS NOT NULL""",
    "bi_filter": using(PROGRAMS, THEMES, GEOGRAPHIES) + """SELECT program_id, launch_year, deadline_on FROM programs p WHERE launch_year IN (1997, 1998) AND funding BETWEEN 50000 AND 400000
  AND deadline_on <= DATE '1998-06-01' AND deadline_on + 200 >= DATE '1998-06-01' AND program_id IN (SELECT program_id FROM themes WHERE slug = 'ECONOMY') AND program_id IN (SELECT program_id FROM geographies WHERE slug = 'ASIA')""",
    "bi_money_summary": using(PROGRAMS) + f"""SELECT CAST(sum(funding) AS DOUBLE) AS total, round(CAST(sum(funding) AS DOUBLE) / count(funding), 6) AS mean, {quartile('funding', 0.5, None)} AS median, CAST(max(funding) AS DOUBLE) AS largest,
  count(funding) AS known, count(*) - count(funding) AS unknown FROM programs""",
    "bi_finance_by_region": using(PROGRAMS, GEOGRAPHIES) + """SELECT slug AS value, count(*) AS programs, count(funding) AS known, CAST(coalesce(sum(funding), 0) AS DOUBLE) AS total,
  round(CAST(coalesce(sum(funding), 0) AS DOUBLE) / CAST((SELECT sum(funding) FROM programs) AS DOUBLE), 9) AS share FROM programs JOIN geographies USING (program_id) GROUP BY 1""",
    "bi_finance_by_type": using(PROGRAMS) + """SELECT support_type AS value, count(*) AS programs, count(funding) AS known, CAST(coalesce(sum(funding), 0) AS DOUBLE) AS total,
  round(CAST(coalesce(sum(funding), 0) AS DOUBLE) / CAST((SELECT sum(funding) FROM programs) AS DOUBLE), 9) AS share FROM programs GROUP BY 1""",
    "bi_region_score": using(PROGRAMS, GEOGRAPHIES, """s AS (SELECT slug AS region, count(DISTINCT program_id) AS programs, count(*) FILTER (source_status = 'O') AS active, count(*) FILTER (support_type = 'AUTOMOBILE') AS level_automobile, count(*) FILTER (support_type = 'MACHINERY') AS level_machinery, CAST(coalesce(sum(funding), 0) AS DOUBLE) AS total,
  CAST(2 * count(DISTINCT program_id) + floor(CAST(coalesce(sum(funding), 0) AS DOUBLE) / 1000000 + 0.5) AS BIGINT) AS score FROM programs JOIN geographies USING (program_id) GROUP BY 1)""")
    + "SELECT *, row_number() OVER (ORDER BY score DESC, region) <= 2 AS is_top, row_number() OVER (ORDER BY score, region) <= 2 AS is_bottom FROM s",
    "bi_topic_strength": using(PROGRAMS, THEMES, GEOGRAPHIES) + """SELECT topic, programs, coalesce(regions, 0) AS regions, total, CASE WHEN programs >= 5 OR total >= 10000000 THEN 'strong' WHEN programs >= 3 OR total >= 2000000 THEN 'moderate' ELSE 'weak' END AS strength
  FROM (SELECT slug AS topic, count(*) AS programs, CAST(coalesce(sum(funding), 0) AS DOUBLE) AS total FROM themes JOIN programs USING (program_id) GROUP BY 1)
  LEFT JOIN (SELECT t.slug AS topic, count(DISTINCT g.slug) AS regions FROM themes t JOIN programs USING (program_id) JOIN geographies g USING (program_id) GROUP BY 1) USING (topic)""",
    "bi_topic_region": using(PROGRAMS, THEMES, GEOGRAPHIES) + "SELECT t.slug AS topic, g.slug AS region, count(*) AS programs, CAST(coalesce(sum(funding), 0) AS DOUBLE) AS total FROM programs JOIN themes t USING (program_id) JOIN geographies g USING (program_id) GROUP BY ALL",
    "bi_support_gaps": using(PROGRAMS, THEMES, GEOGRAPHIES, """g AS (SELECT * FROM (SELECT 'region' AS kind, slug AS name, count(*) AS programs, CAST(coalesce(sum(funding), 0) AS DOUBLE) AS total FROM programs JOIN geographies USING (program_id) GROUP BY 2 ORDER BY 3, 4, 2 LIMIT 5)
  UNION ALL SELECT * FROM (SELECT 'topic', slug, count(*), CAST(coalesce(sum(funding), 0) AS DOUBLE) FROM programs JOIN themes USING (program_id) GROUP BY 2 ORDER BY 3, 4, 2 LIMIT 5)
  UNION ALL SELECT * FROM (SELECT 'pair', t.slug || ' / ' || g.slug, count(*), CAST(coalesce(sum(funding), 0) AS DOUBLE) FROM programs JOIN themes t USING (program_id) JOIN geographies g USING (program_id) GROUP BY 2 ORDER BY 3, 4, 2 LIMIT 8))""")
    + "SELECT *, CASE WHEN programs <= 1 AND total < 1000000 THEN 'high' WHEN programs <= 2 AND total < 3000000 THEN 'medium' ELSE 'low' END AS severity FROM g",
    "bi_source_rankings": using(PROGRAMS, """r AS (SELECT n_name AS source_id, count(program_id) AS programs, count(*) FILTER (source_status = 'O') AS active, CAST(coalesce(sum(funding), 0) AS DOUBLE) AS total,
  round(CAST(sum(funding) AS DOUBLE) / count(funding), 6) AS average, round(avg(CASE WHEN program_id IS NULL THEN NULL WHEN value_kind = 'unknown' THEN 50 ELSE 100 END), 6) AS quality FROM nation LEFT JOIN programs ON source_key = n_name GROUP BY 1)""") + """
SELECT *, row_number() OVER (ORDER BY programs DESC NULLS LAST, source_id) AS by_programs, row_number() OVER (ORDER BY total DESC NULLS LAST, source_id) AS by_total,
  row_number() OVER (ORDER BY average DESC NULLS LAST, source_id) AS by_average, row_number() OVER (ORDER BY quality DESC NULLS LAST, source_id) AS by_quality FROM r""",
    "bi_data_quality": """WITH d AS (SELECT lang, quality IS NULL AS a, n_chars < 400 AS b, coalesce(quality = 0, false) AS c, coalesce(toxic = 1, false) AS e FROM documents LEFT JOIN labels USING (doc_id))
SELECT lang, count(*) AS records, round(avg(floor((4 - a::INT - b::INT - c::INT - e::INT) / 4 * 100 + 0.5)), 6) AS completeness, round(avg(a::INT), 9) AS without_label, round(avg(b::INT), 9) AS without_long_text,
  round(avg(c::INT), 9) AS without_good, round(avg(e::INT), 9) AS without_clean FROM d GROUP BY 1""",
    "bi_month_seasonality": using(PROGRAMS, "m AS (SELECT CAST(month AS INTEGER) AS month, (SELECT count(*) FROM programs WHERE month(deadline_on) = month) AS n FROM range(1, 13) t(month))")
    + "SELECT month, n, n > 0 AND row_number() OVER (ORDER BY n DESC, month) <= 3 AS is_peak FROM m",
    "bi_year_roll": using(PROGRAMS, YEARS) + "SELECT * FROM years",
    "bi_forecast": using(PROGRAMS, YEARS, """g AS (SELECT *, CASE WHEN lag(total) OVER w > 0 THEN (total - lag(total) OVER w) / lag(total) OVER w END AS mg, CASE WHEN lag(active) OVER w > 0 THEN (active - lag(active) OVER w) / CAST(lag(active) OVER w AS DOUBLE) END AS pg
  FROM years WINDOW w AS (ORDER BY year))""", """a AS (SELECT max(year) AS latest, arg_max(total, year) AS total, arg_max(active, year) AS active, coalesce(avg(CASE WHEN mg IS NOT NULL THEN greatest(-0.5, least(0.75, mg)) END), 0) AS mg, coalesce(avg(CASE WHEN pg IS NOT NULL THEN greatest(-0.5, least(0.75, pg)) END), 0) AS pg, count(*) AS years FROM g)""")
    + "SELECT CAST(latest + 1 AS INTEGER) AS year, round(mg, 9) AS money_growth, round(pg, 9) AS program_growth, CAST(greatest(0, floor(total * (1 + mg) + 0.5)) AS BIGINT) AS total, CAST(greatest(0, floor(active * (1 + pg) + 0.5)) AS BIGINT) AS active, years FROM a",
    "bi_growing_topics": using(PROGRAMS, THEMES) + """SELECT *, now - before AS gain FROM (SELECT slug AS topic, count(*) FILTER (launch_year = 2000) AS now, count(*) FILTER (launch_year = 1999) AS before FROM programs JOIN themes USING (program_id) GROUP BY 1)
  WHERE now > before ORDER BY gain DESC, topic LIMIT 5""",
    "display_status": using(PROGRAMS, "w AS (SELECT l_orderkey, min(CAST(l_shipdate AS DATE)) AS a, max(CAST(l_shipdate AS DATE)) AS b FROM lineitem GROUP BY 1)") + """SELECT program_id, CASE WHEN source_status = 'P' THEN 'upcoming'
  WHEN a <= DATE '1998-06-01' AND b >= DATE '1998-06-01' THEN 'open' WHEN a > DATE '1998-06-01' THEN 'upcoming' WHEN b <= DATE '1998-06-01' - 30 THEN 'completed' WHEN b < DATE '1998-06-01' THEN 'closed' ELSE 'unknown' END AS status
  FROM programs LEFT JOIN w ON l_orderkey = program_id""",
    "duplicate_in_package": """SELECT doc_id, md5(text) AS key, n_chars >= 30 AS is_valid, n_chars >= 30 AND row_number() OVER (PARTITION BY md5(text), n_chars >= 30 ORDER BY doc_id) > 1 AS is_duplicate FROM documents""",
    "import_outcomes": """WITH h AS (SELECT source, md5(text) AS k, arg_max(md5(concat_ws('|', lang, n_chars + doc_id % 4)), doc_id) AS known FROM documents WHERE doc_id % 2 = 0 GROUP BY ALL),
r AS (SELECT doc_id, source, md5(text) AS k, n_chars >= 100 AS ok, md5(concat_ws('|', lang, n_chars)) AS body, row_number() OVER (PARTITION BY source, md5(text), n_chars >= 100 ORDER BY doc_id) AS turn FROM documents WHERE doc_id % 2 = 1)
SELECT doc_id, CASE WHEN NOT ok THEN 'error' WHEN turn > 1 THEN 'skipped_duplicate' WHEN known IS NULL THEN 'new' WHEN known = body THEN 'unchanged' ELSE 'updated' END AS outcome FROM r LEFT JOIN h USING (source, k)""",
    "url_normalize": f"SELECT page_id, {URL} AS normalized FROM pages",
    "url_dedup": rf"""WITH n AS (SELECT page_id, {URL} AS u FROM pages), p AS (SELECT page_id, regexp_extract(u, '^(https?://[^/?]*)', 1) AS head, regexp_replace(regexp_extract(u, '^https?://[^/?]*([^?]*)', 1), '/+', '/', 'g') AS path,
  list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|fbclid|gclid|yclid|mc_cid|mc_eid)(=|$)'))) AS q FROM n)
SELECT head || CASE WHEN path = '/' THEN path ELSE regexp_replace(path, '/$', '') END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS key, count(*) AS pages, min(page_id) AS first_page FROM p GROUP BY 1""",
    "url_route": rf"""WITH u AS (SELECT DISTINCT {URL} AS url FROM pages), a AS (SELECT {URL} AS url FROM pages), g AS (SELECT regexp_extract(url, '^(https?://[^/]*)', 1) AS o, regexp_extract(url, '^https?://[^/]*/([^/?]*)', 1) AS l, count(*) AS n FROM a GROUP BY ALL),
r AS (SELECT o || '/' || l AS key, o || '/' || l || '/' AS prefix FROM g WHERE l <> 'de' UNION SELECT o, o || '/' FROM g WHERE l = 'en' AND n > 1),
h AS (SELECT url, count(DISTINCT key) AS matched, min(key) AS target FROM u JOIN r ON starts_with(url, prefix) GROUP BY 1)
SELECT url, coalesce(matched, 0) AS matched, CASE WHEN matched = 1 THEN 'source' WHEN matched > 1 THEN 'ambiguous' ELSE 'manual' END AS route, CASE WHEN matched = 1 THEN target END AS target FROM u LEFT JOIN h USING (url)""",
    "text_normalize_dedup": r"""SELECT md5(nullif(trim(regexp_replace(replace(lower(text), 'ё', 'е'), '[^\p{L}\p{N}_]+', ' ', 'g')), '')) AS key, count(*) AS documents, min(doc_id) AS first_document FROM documents GROUP BY 1""",
    "token_search": "SELECT p_partkey, p_name FROM part WHERE list_has_all(string_split(p_name, ' '), ['ring', 'small'])",
    "token_relevance": """WITH s AS (SELECT p_partkey, p_name, string_split(p_name, ' ') AS a, [lower(p_type)] AS b, regexp_split_to_array(lower(p_brand), '[^a-z0-9]+') AS c FROM part),
h AS (SELECT p_partkey, p_name, len(list_intersect(['small', 'ring'], a)) AS x, len(list_intersect(['small', 'ring'], b)) AS y, len(list_intersect(['small', 'ring'], c)) AS z FROM s)
SELECT * FROM (SELECT p_partkey, p_name, CAST((CASE WHEN p_name = 'small ring' THEN 100 ELSE 0 END) + (x = 2)::INT * 50 + x * 10 + (y = 2)::INT * 24 + y * 6 + (z = 2)::INT * 16 + z * 4 AS INTEGER) AS score FROM h) WHERE score > 0""",
    "trigram_search": """WITH w AS (SELECT p_partkey, p_name, unnest(string_split(p_name, ' ')) AS word FROM part), q AS (SELECT unnest(['smal', 'widgets']) AS term),
g AS (SELECT p_partkey, p_name, term, list_distinct(list_transform(range(1, len(word) + 2), lambda k: substr('  ' || word || ' ', k, 3))) AS a, list_distinct(list_transform(range(1, len(term) + 2), lambda k: substr('  ' || term || ' ', k, 3))) AS b FROM w, q),
s AS (SELECT p_partkey, p_name, term, max(len(list_intersect(a, b)) / CAST(len(a) + len(b) - len(list_intersect(a, b)) AS DOUBLE)) AS s FROM g GROUP BY ALL)
SELECT p_partkey, p_name, round(min(s), 9) AS score FROM s GROUP BY ALL HAVING min(s) >= 0.55""",
    "theme_tag": r"""SELECT doc_id, tag FROM documents, (VALUES ('and', '\band\b'), ('license', 'licen[cs]e|copyright'), ('mail', '[a-z0-9._]+@[a-z0-9.]+'), ('numbers', '[0-9]{4}')) r(tag, pattern) WHERE regexp_matches(lower(text), pattern)""",
    "money_parse": "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS DOUBLE) AS amount, 'maximum' AS kind FROM orders",
    "json_props": "SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1",
    "fingerprint": "SELECT o_orderkey, sha256(to_json({'o_custkey': o_custkey, 'o_orderkey': o_orderkey, 'o_orderpriority': o_orderpriority, 'o_orderstatus': o_orderstatus})::VARCHAR) AS fingerprint FROM orders",
    "state_transitions": "WITH l AS (SELECT lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, role AS state FROM conversations) SELECT before, state, count(*) AS n FROM l WHERE before IS NOT NULL GROUP BY ALL",
    "state_violations": """WITH l AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT * FROM l WHERE before IS NOT NULL AND before <> role AND (before, role) NOT IN (('system', 'user'), ('user', 'assistant'))""",
    "current_state": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS entries FROM events GROUP BY 1",
    "prev_record": "SELECT event_id, lag(event_id) OVER w AS previous_event_id, lag(value) OVER w AS previous_value FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)",
    "unresolved_issues": "SELECT o_orderkey AS issue_id, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag <> 'N')",
    "journal_prune": "SELECT event_id, user_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-11' AND TIMESTAMP '2024-01-25'",
    "cursor_skip": "SELECT user_id AS source_id, event_id AS message_id FROM events LEFT JOIN (SELECT user_id, max(event_id) AS m FROM events WHERE event_type = 'signup' GROUP BY 1) USING (user_id) WHERE event_id > coalesce(m, -1)",
    "first_last_seen": "SELECT user_id, min(ts) AS first_seen_at, max(ts) AS last_seen_at, count(*) AS seen_count, max(ts) + INTERVAL 30 DAY AS expires_at FROM events GROUP BY 1",
    "weekly_windows": "SELECT CAST(date_trunc('week', ts) AS DATE) AS week_start, event_type AS source_id, count(*) AS messages, max(ts) AS last_at FROM events GROUP BY ALL",
    "retry_backoff": """WITH a AS (SELECT event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'error')
SELECT event_id, greatest(least(2 * pow(5.0, n - 1), 60), least(value, 60)) AS wait FROM a""",
    "entity_matches": r"""WITH d AS (SELECT doc_id AS id, source, array_to_string(string_split(text, ' ')[1:3], ' ') AS ext, md5(text) AS url,
  nullif(trim(regexp_replace(lower(string_split(text, '.')[1]), '[^\p{L}\p{N}_]+', ' ', 'g')), '') AS title, lang, n_chars % 365 AS deadline FROM documents),
c AS (SELECT * FROM d WHERE id % 20 = 0), m AS (SELECT c.id AS c, d.id AS t, 0 AS r FROM c JOIN d ON c.source = d.source AND c.ext = d.ext AND c.id <> d.id
  UNION ALL SELECT c.id, d.id, 1 FROM c JOIN d ON c.source = d.source AND c.url = d.url AND c.id <> d.id UNION ALL SELECT c.id, d.id, 2 FROM c JOIN d ON c.source <> d.source AND c.url = d.url
  UNION ALL SELECT c.id, d.id, 3 FROM c JOIN d ON c.title = d.title AND c.lang = d.lang AND c.deadline = d.deadline AND c.id <> d.id),
b AS (SELECT c, t, min(r) AS r FROM m GROUP BY ALL)
SELECT b.c AS candidate_id, b.t AS target_id, CAST(r AS INTEGER) AS level_rank, ['exact_external_id', 'exact_url', 'exact_origin_url', 'normalized_fields'][r + 1] AS level,
  concat_ws(',', CASE WHEN x.title <> y.title THEN 'title_key' END, CASE WHEN x.lang <> y.lang THEN 'organizer_key' END, CASE WHEN x.deadline <> y.deadline THEN 'deadline_on' END) AS conflicts
FROM b JOIN d x ON x.id = b.c JOIN d y ON y.id = b.t""",
    "client_sort": using(PROGRAMS, "r AS (SELECT program_id, CAST(CASE WHEN deadline_on >= DATE '1998-06-01' THEN date_diff('day', DATE '1998-06-01', deadline_on) ELSE 10000 + date_diff('day', deadline_on, DATE '1998-06-01') END AS DOUBLE) AS rank FROM programs)")
    + "SELECT * FROM r",
    "region_options": using(GEOGRAPHIES) + "SELECT DISTINCT slug AS option FROM geographies WHERE slug <> 'AFRICA'",
    "publication_groups": "SELECT doc_id AS publication_id, CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY md5(text)) END AS group_id FROM documents",
    "publication_folding": """WITH u AS (SELECT o_custkey AS g, 'u' || o_orderkey % 4 AS u, min((o_orderdate, o_orderkey)) AS seen FROM orders GROUP BY ALL)
SELECT o_custkey AS group_id, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS title, arg_max(o_totalprice, (o_orderdate, o_orderkey)) FILTER (o_orderstatus <> 'P' AND o_orderkey % 3 > 0) AS funding,
  (SELECT string_agg(u, ',' ORDER BY seen) FROM u WHERE g = o_custkey) AS urls, CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS end_on, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'completed' ELSE 'open' END AS evidence, count(*) AS publications
FROM orders GROUP BY o_custkey""",
    "link_inventory": """WITH l AS (SELECT o_custkey AS key, CASE WHEN o_orderstatus = 'F' THEN 'https://a/' ELSE 'http://a/' END || o_orderkey % 10 AS url, o_orderpriority AS context FROM orders)
SELECT key, arg_max(url, (starts_with(url, 'https'), -length(url), url)) AS url, array_to_string(list_sort(list(DISTINCT context)), '|') AS contexts, count(*) AS mentions FROM l GROUP BY 1""",
    "resource_propagation": """WITH r AS (SELECT l_returnflag, bool_or(l_quantity > 45) OVER (PARTITION BY l_orderkey, l_returnflag) AS x FROM lineitem) SELECT l_returnflag AS group_key, x AS is_result, count(*) AS resources FROM r GROUP BY ALL""",
    "application_windows": """WITH r AS (SELECT DISTINCT l_orderkey AS id, CAST(l_shipdate AS DATE) AS a, CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) AS b FROM lineitem),
m AS (SELECT *, coalesce(a <= lag(b) OVER (PARTITION BY id ORDER BY b, a), false) AS o FROM r), g AS (SELECT id, arg_max(a, b) AS a, max(b) AS b, count(*) AS n, bool_or(o) AND count(*) > 1 AS clash FROM m GROUP BY 1)
SELECT id AS record_id, CAST(CASE WHEN NOT clash THEN a END AS VARCHAR) AS start_on, CAST(CASE WHEN NOT clash THEN b END AS VARCHAR) AS end_on, CASE WHEN n = 1 THEN 'single' WHEN clash THEN 'conflict' ELSE 'multiple_cycles' END AS outcome FROM g""",
    "artifact_status": """WITH r AS (SELECT l_linestatus, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_linestatus = 'O' THEN 'part-' ELSE 'missing-' END || l_partkey) AS n FROM lineitem)
SELECT CASE WHEN l_linestatus = 'O' THEN 'captured' WHEN n <= 2 THEN 'deferred' ELSE 'reference_only' END AS status, count(*) AS links FROM r GROUP BY 1""",
    "schedule_due": "SELECT event_id, event_type FROM events WHERE (minute(ts) % 10 = 0 OR minute(ts) = 7) AND hour(ts) BETWEEN 6 AND 18 AND dayofweek(ts) BETWEEN 1 AND 5",
    "funding_labels": using(PROGRAMS) + r"""SELECT program_id, CASE value_kind WHEN 'unknown' THEN 'unknown' WHEN 'not_stated' THEN 'not stated' ELSE CASE value_kind WHEN 'minimum' THEN 'from ' WHEN 'maximum' THEN 'up to ' ELSE '' END
  || regexp_replace(replace(format('{:,.2f}', CAST(funding AS DOUBLE)), ',', ' '), '\.00$', '') || ' USD' END AS label FROM programs""",
    "baseline_metrics": using(PROGRAMS, "t AS (SELECT count(*) AS n, count(value_kind) AS records, count(funding) AS numeric FROM programs)", """
  s AS (SELECT n_name AS k, count(program_id) AS n FROM nation LEFT JOIN programs ON source_key = n_name GROUP BY 1)""", f"""
  f AS (SELECT 'funding.quantile.USD.' || value_kind || '.' || CASE value_kind WHEN 'exact' THEN 'exact' WHEN 'minimum' THEN 'min' ELSE 'max' END AS k, count(*) AS n,
    {quartile('funding', 0.25)} AS a, {quartile('funding', 0.5)} AS b, {quartile('funding', 0.75)} AS c FROM programs WHERE funding IS NOT NULL GROUP BY value_kind)""", f"""
  d AS (SELECT count(*) AS total, count(*) FILTER (deadline_on >= DATE '1998-06-01') AS up, count(*) FILTER (deadline_on < DATE '1998-06-01') AS late, count(deadline_on) AS present,
    {quartile("CASE WHEN deadline_on >= DATE '1998-06-01' THEN date_diff('day', DATE '1998-06-01', deadline_on) END", 0.25, None)} AS a, {quartile("CASE WHEN deadline_on >= DATE '1998-06-01' THEN date_diff('day', DATE '1998-06-01', deadline_on) END", 0.5, None)} AS b,
    {quartile("CASE WHEN deadline_on >= DATE '1998-06-01' THEN date_diff('day', DATE '1998-06-01', deadline_on) END", 0.75, None)} AS c FROM programs)""", """
  x AS (SELECT n_name AS k, count(event_id) AS n, coalesce(max(CASE WHEN event_type NOT IN ('error', 'view') THEN 1 ELSE 0 END), 0) AS ok FROM nation LEFT JOIN events ON n_name = 'NATION_' || user_id % 20 GROUP BY 1)""", """
  m AS (SELECT 'opportunities.count' AS metric_key, CAST(n AS DOUBLE) AS v, NULL AS numerator, NULL AS denominator, n AS sample_size FROM t
  UNION ALL SELECT 'funding.record_share', records / CAST(n AS DOUBLE), records, n, n FROM t UNION ALL SELECT 'funding.numeric_share', numeric / CAST(n AS DOUBLE), numeric, n, n FROM t
  UNION ALL SELECT 'opportunities.source.' || k || '.count', s.n, NULL, NULL, t.n FROM s, t UNION ALL SELECT 'opportunities.source.' || k || '.share', s.n / CAST(t.n AS DOUBLE), s.n, t.n, t.n FROM s, t
  UNION ALL SELECT k || '.Q25', a, NULL, NULL, n FROM f UNION ALL SELECT k || '.median', b, NULL, NULL, n FROM f UNION ALL SELECT k || '.Q75', c, NULL, NULL, n FROM f
  UNION ALL SELECT 'deadlines.presence_share', present / CAST(total AS DOUBLE), present, total, total FROM d UNION ALL SELECT 'deadlines.upcoming_share', up / CAST(total AS DOUBLE), up, total, total FROM d
  UNION ALL SELECT 'deadlines.overdue_count', late, NULL, NULL, total FROM d
  UNION ALL SELECT 'deadlines.days.Q25', a, NULL, NULL, up FROM d UNION ALL SELECT 'deadlines.days.median', b, NULL, NULL, up FROM d UNION ALL SELECT 'deadlines.days.Q75', c, NULL, NULL, up FROM d
  UNION ALL SELECT 'source.execution_coverage.' || k, ok, NULL, NULL, n FROM x)""")
    + "SELECT metric_key, round(v, 9) AS value_num, CAST(numerator AS BIGINT) AS numerator, CAST(denominator AS BIGINT) AS denominator, CAST(sample_size AS BIGINT) AS sample_size, CASE WHEN v IS NULL THEN 'not_computed' ELSE 'computed' END AS status FROM m",
    "chart_series": using(PROGRAMS) + "SELECT n_name AS label, CAST(count(program_id) AS DOUBLE) AS value FROM nation LEFT JOIN programs ON source_key = n_name GROUP BY 1",
}

#: Dates are given as text, as the queries give them.
DATES = {
    "deadline_on": ("catalog_page_published", "catalog_filter_groups", "nearest_deadlines", "bi_filter"),
    "week_start": ("weekly_latest", "weekly_calendar", "weekly_intake_removed", "weekly_membership_changes", "weekly_transitions", "weekly_category_points", "weekly_windows"),
    "previous_week": ("weekly_calendar", "weekly_intake_removed"),
}
for _column, _names in DATES.items():
    for _name in _names:
        ORACLE_SQL[_name] = f"SELECT * REPLACE (CAST({_column} AS VARCHAR) AS {_column}) FROM ({ORACLE_SQL[_name]})"
