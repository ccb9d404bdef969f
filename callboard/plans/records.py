"""Queries on searches, journals, reviews, drafts and texts, each next to the SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callboard.functions import labels, normalize, parse, textsearch
from callboard.operators import bi, catalog, drafts, metrics, moderation, network, publications, resolve, review, snapshots, temporal
from callboard.plans.bindings import Tables
from callboard.plans.oracles import GEOGRAPHIES, ORACLE_SQL, PROGRAMS, using
from callboard.plans.queries import TODAY, query
from callboard.sources import export, packages
from callboard.streaming import feed


def asked(sql: str) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Registers a query and its SQL."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        ORACLE_SQL[f.__name__] = sql
        return query(f)

    return register


def fuzzy_sql(*terms: str) -> str:
    """fz(id, fuzzy): the least of the terms' best trigram similarities to a word of part names."""
    grams = "list_distinct(list_transform(range(1, len({0}) + 2), lambda k: substr('  ' || {0} || ' ', k, 3)))"
    return f"""fz AS (SELECT p_partkey AS id, round(min(s), 9) AS fuzzy FROM (SELECT p_partkey, term, max(len(list_intersect(a, b)) / CAST(len(a) + len(b) - len(list_intersect(a, b)) AS DOUBLE)) AS s
  FROM (SELECT p_partkey, term, {grams.format('word')} AS a, {grams.format('term')} AS b FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part), (SELECT unnest({list(terms)}) AS term)) GROUP BY ALL) GROUP BY 1)"""


def _titles(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("program_id"), F.col("p_name").alias("title"), F.lit("published").alias("publication_status"), F.col("p_size").alias("published_at"))


def _searched(t: Tables, text: str) -> DataFrame:
    return catalog.Catalog(_titles(t)).searched(text).select("program_id", "by_stems", F.round("rank", 9).alias("rank"), F.round("fuzzy", 9).alias("fuzzy"))


@asked(f"WITH {fuzzy_sql('ring', 'small', 'gear', 'blue')} SELECT p_partkey AS program_id, true AS by_stems, round(0.1 / 1.1::DOUBLE, 9) AS rank, fuzzy FROM part JOIN fz ON id = p_partkey WHERE p_name IN ('small ring', 'hot gear')")
def catalog_search(t: Tables) -> DataFrame:
    return _searched(t, 'ring  small or "hot gear" -blue')


@asked(f"WITH {fuzzy_sql('smal', 'rings')} SELECT p_partkey AS program_id, false AS by_stems, 0.0::DOUBLE AS rank, fuzzy FROM part JOIN fz ON id = p_partkey WHERE fuzzy >= 0.55")
def catalog_search_similar(t: Tables) -> DataFrame:
    return _searched(t, "smal rings")


@asked("SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'ring')")
def morphology_search(t: Tables) -> DataFrame:
    return t.part.where(textsearch.morphology_match(F.col("p_name"), "RING")).select("p_partkey")


@asked(using(PROGRAMS) + """SELECT program_id, source_key FROM programs p WHERE publication_status = 'published' AND program_id IN
  (SELECT l_orderkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_name IN ('NATION_2', 'NATION_7') OR n_nationkey = 3)""")  # fmt: skip
def catalog_districts(t: Tables) -> DataFrame:
    links = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    links = links.select(F.col("l_orderkey").alias("program_id"), F.concat(F.lit("n-"), "n_nationkey").alias("slug"), F.col("n_name").alias("name")).distinct()
    q = catalog.CatalogQuery(geographies=("east", "n-3"), districts=(("east", ("Nation_2", "NATION_7")), ("west", ("NATION_1",))))
    return catalog.Catalog(t.programs(), geographies=links).filtered(q).select("program_id", "source_key")


@asked("SELECT s_suppkey AS source_id FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_acctbal >= 0 AND r_name = 'ASIA' AND n_nationkey % 2 = 0 AND s_suppkey % 3 = 1")
def sources_filter(t: Tables) -> DataFrame:
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.select(
        F.col("s_suppkey").alias("source_id"), F.when(F.col("s_acctbal") >= 0, "fund").otherwise("agency").alias("type"), F.col("r_name").alias("region"),
        F.when(F.col("n_nationkey") % 2 == 0, "federal").otherwise("regional").alias("coverage_level"), F.array(F.concat(F.lit("topic-"), F.col("s_suppkey") % 3)).alias("topics"),
    )
    return catalog.sources_filtered(rows, kind="fund", region="ASIA", level="federal", topic="topic-1").select("source_id")


@asked("SELECT n_name AS name FROM nation WHERE contains(lower(n_name), 'tion_1')")
def sources_named(t: Tables) -> DataFrame:
    return catalog.sources_named(t.nation.select(F.col("n_name").alias("name")), " tion_1 ")


@asked("SELECT o_orderkey AS program_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def without_deadline(t: Tables) -> DataFrame:
    late = t.lineitem.groupBy(F.col("l_orderkey").alias("program_id")).agg(F.max(F.when(F.col("l_returnflag") == "R", F.col("l_shipdate").cast("date"))).alias("deadline_on"))
    return catalog.without_deadline(t.orders.select(F.col("o_orderkey").alias("program_id")).join(late, "program_id", "left")).select("program_id")


@asked(using(PROGRAMS, GEOGRAPHIES) + """SELECT program_id, coalesce(g, CASE WHEN source_status = 'O' THEN 'country' ELSE '' END) AS geographies FROM programs
  LEFT JOIN (SELECT program_id, string_agg(slug, ',' ORDER BY slug) AS g FROM geographies WHERE slug IN ('ASIA', 'EUROPE') GROUP BY 1) USING (program_id)""")  # fmt: skip
def program_scope(t: Tables) -> DataFrame:
    links = t.geographies().where(F.col("slug").isin("ASIA", "EUROPE"))
    got = catalog.with_scope(t.programs(), links, F.col("source_status") == "O", "country")
    return got.select("program_id", F.array_join("geographies", ",").alias("geographies"))


DAYS = "CASE WHEN deadline_on IS NOT NULL THEN date_diff('day', DATE '1998-06-01', deadline_on) END"


@asked(using(PROGRAMS) + f"""SELECT count(*) AS all_programs, count(deadline_on) AS with_deadline, count(*) - count(deadline_on) AS without, count(*) FILTER ({DAYS} BETWEEN 0 AND 30) AS next30, count(*) FILTER ({DAYS} BETWEEN 0 AND 90) AS next90
  FROM (SELECT * REPLACE (CASE WHEN program_id % 5 > 0 THEN deadline_on END AS deadline_on) FROM programs)""")  # fmt: skip
def deadline_buckets(t: Tables) -> DataFrame:
    rows = t.programs().select(F.when(F.col("program_id") % 5 > 0, F.col("deadline_on")).alias("deadline"))
    names = (("all", "all_programs"), ("with", "with_deadline"), ("without", "without"), ("next30", "next30"), ("next90", "next90"))
    return rows.agg(*(F.count_if(F.lit(True) if (test := bi.deadline_test(choice, F.lit(TODAY))) is None else test).alias(name) for choice, name in names))


# Journals and queues


@asked("SELECT l_orderkey * 10 + l_linenumber AS issue_id, l_orderkey AS record_id, o_custkey AS capture_id, c_nationkey AS run_id, n_regionkey AS source_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
def provenance(t: Tables) -> DataFrame:
    issues = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("issue_id"), F.col("l_orderkey").alias("record_id"))
    records, captures = t.orders.select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("capture_id")), t.customer.select(F.col("c_custkey").alias("capture_id"), F.col("c_nationkey").alias("run_id"))
    return moderation.provenance(issues, records, captures, t.nation.select(F.col("n_nationkey").alias("run_id"), F.col("n_regionkey").alias("source_id")), t.region.select(F.col("r_regionkey").alias("source_id")))


@asked("""SELECT c_custkey AS run_id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS captures, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS records,
  (SELECT count(*) FROM events WHERE user_id = c_custkey) AS issues, (SELECT count(*) FROM events WHERE user_id = c_custkey AND event_type = 'error') AS errors FROM customer""")  # fmt: skip
def run_counts(t: Tables) -> DataFrame:
    orders, events = t.orders.withColumn("run_id", F.col("o_custkey")), t.events.withColumn("run_id", F.col("user_id"))
    return moderation.with_counts(t.customer.select(F.col("c_custkey").alias("run_id")), "run_id", captures=orders, records=orders.where("o_orderstatus = 'F'"), issues=events, errors=events.where("event_type = 'error'"))


@asked("SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 50")
def journal(t: Tables) -> DataFrame:
    return moderation.journal(t.events.withColumn("source_id", F.col("event_type")), "ts", "event_id", 50, "error").select("event_id", "user_id")


@asked("""SELECT event_id, CASE WHEN event_type = 'view' THEN 'url' WHEN event_type = 'error' THEN 'other' ELSE 'message' END AS subject_type, CASE WHEN event_type = 'view' THEN s_name WHEN event_type <> 'error' THEN c_name END AS reference
  FROM events LEFT JOIN customer ON c_custkey = user_id LEFT JOIN supplier ON s_suppkey = user_id""")  # fmt: skip
def case_subjects(t: Tables) -> DataFrame:
    cases = t.events.select("event_id", F.when(F.col("event_type") == "view", "url").when(F.col("event_type") == "error", "other").otherwise("message").alias("subject_type"), F.col("user_id").alias("subject_id"))
    return moderation.subjects(cases, message=t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("reference")), url=t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("reference"))).select("event_id", "subject_type", "reference")


@asked("""SELECT event_id, CASE WHEN value < 50 THEN 'staged' ELSE 'program' END AS target_kind, CASE WHEN value < 50 THEN o_orderpriority ELSE p_name END AS title, CASE WHEN value < 50 THEN o_orderstatus ELSE p_type END AS state
  FROM events LEFT JOIN orders ON o_orderkey = user_id LEFT JOIN part ON p_partkey = user_id""")  # fmt: skip
def match_target_states(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.when(F.col("value") < 50, "staged").otherwise("program").alias("target_kind"), F.col("user_id").alias("target_id"))
    staged = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("state"))
    return moderation.match_targets(rows, staged, t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("state"))).drop("target_id")


@asked("""WITH d AS (SELECT *, row_number() OVER (PARTITION BY md5(text), n_chars >= 100 ORDER BY doc_id) > 1 AND n_chars >= 100 AS twin FROM documents LEFT JOIN labels USING (doc_id))
SELECT lang, discovered, extracted, valid, repeated, round(valid / CAST(greatest(discovered, valid) AS DOUBLE), 9) AS completeness, round(valid / CAST(extracted AS DOUBLE), 9) AS validity, round(repeated / CAST(extracted AS DOUBLE), 9) AS duplicate_rate, round(dated / CAST(discovered AS DOUBLE), 9) AS freshness
FROM (SELECT lang, count(*) AS discovered, count(*) AS extracted, count(*) FILTER (n_chars >= 100) AS valid, count(*) FILTER (twin) AS repeated, count(quality) AS dated FROM d GROUP BY 1)""")  # fmt: skip
def run_quality(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "lang", F.md5("text").alias("key"), (F.col("n_chars") >= 100).alias("is_valid"))
    resources = t.documents.join(t.labels, "doc_id", "left").select("lang", F.col("quality").alias("last_modified_at"))
    got = moderation.run_quality(resources, resolve.duplicate_rows(rows, "key", "doc_id"), "lang").drop("newest_at")
    return got.select("lang", "discovered", "extracted", "valid", "repeated", *(F.round(c, 9).alias(c) for c in ("completeness", "validity", "duplicate_rate", "freshness")))


@asked("SELECT l_returnflag AS source_id, l_linestatus AS field, count(*) AS errors FROM lineitem WHERE l_tax >= 0.04 AND l_quantity > 5 GROUP BY ALL")
def field_errors(t: Tables) -> DataFrame:
    issues = t.lineitem.select(F.col("l_returnflag").alias("source_id"), F.when(F.col("l_quantity") > 5, F.col("l_linestatus")).alias("field"), F.when(F.col("l_tax") >= 0.04, "error").otherwise("warning").alias("severity"))
    return moderation.field_errors(issues, "source_id")


@asked("""SELECT (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') AS canonical, (SELECT count(*) FROM events WHERE event_type IN ('view', 'click')) AS discovery,
  (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') + (SELECT count(*) FROM events WHERE event_type IN ('view', 'click')) AS total""")  # fmt: skip
def queue_sizes(t: Tables) -> DataFrame:
    canonical = t.orders.select(F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "P", "needs_clarification").otherwise("resolved").alias("status"))
    return moderation.queue_sizes(canonical, t.events.select(F.when(F.col("event_type") == "view", "open").when(F.col("event_type") == "click", "needs_clarification").otherwise("resolved").alias("status")))


@asked("SELECT event_id AS case_id, CASE WHEN event_type = 'view' THEN 'open' ELSE 'needs_clarification' END AS status FROM events WHERE event_type IN ('view', 'click') ORDER BY ts, event_id LIMIT 100")
def case_queue(t: Tables) -> DataFrame:
    cases = t.events.select(F.col("event_id").alias("case_id"), F.col("ts").alias("opened_at"), F.when(F.col("event_type") == "view", "open").when(F.col("event_type") == "click", "needs_clarification").otherwise("resolved").alias("status"))
    return review.queue(cases, 100).select("case_id", "status")


@asked("SELECT CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'unknown' END AS data_class, count(*) AS snapshots FROM events GROUP BY 1")
def snapshot_classes(t: Tables) -> DataFrame:
    return snapshots.class_counts(t.events, ("view", "click"), "event_type")


@asked("""SELECT DISTINCT 'https://s/' || s_suppkey AS canonical_url, CASE WHEN s_suppkey % 5 = 0 OR s_suppkey % 7 = 1 OR s_suppkey % 7 = 2 OR s_suppkey % 7 = 3 THEN 'excluded' WHEN s_suppkey % 2 = 0 THEN 'program' ELSE 'active' END AS bucket,
  CASE WHEN s_suppkey % 5 = 0 THEN 'unregistered' WHEN s_suppkey % 7 = 1 THEN 'fixture' WHEN s_suppkey % 7 = 2 THEN 'inactive' WHEN s_suppkey % 7 = 3 THEN 'protocol_excluded' END AS reason FROM supplier""")  # fmt: skip
def source_scope(t: Tables) -> DataFrame:
    key, url = F.col("s_suppkey"), F.concat(F.lit("https://s/"), "s_suppkey").alias("canonical_url")
    registry = t.supplier.where(key % 5 > 0).select(url, F.when(key % 7 == 1, "fixture").otherwise("html").alias("access_method"), F.when(key % 7 == 2, "paused").otherwise("active").alias("status"), (key % 7 == 3).alias("protocol_excluded"), (key % 2 == 0).alias("holds_programs"))
    return snapshots.source_scope(t.supplier.select(url), registry)


# Reviews


@asked("SELECT user_id, event_id, row_number() OVER w AS revision_number, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AS is_latest FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def revisions(t: Tables) -> DataFrame:
    return review.numbered_revisions(t.events.select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"]).drop("ts")


ACTIONS = "e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, {} AS action FROM events)"
MOVES = "CASE {} WHEN 'draft/publish' THEN 'published' WHEN 'published/archive' THEN 'archived' WHEN 'archived/republish' THEN 'published' END"


@asked(f"""WITH RECURSIVE {ACTIONS.format("CASE event_type WHEN 'signup' THEN 'publish' WHEN 'error' THEN 'archive' ELSE 'republish' END")},
s(user_id, event_id, n, state, allowed) AS (SELECT user_id, CAST(NULL AS BIGINT), CAST(0 AS BIGINT), 'draft', false FROM events GROUP BY 1
  UNION ALL SELECT e.user_id, e.event_id, e.n, coalesce({MOVES.format("state || '/' || action")}, state), {MOVES.format("state || '/' || action")} IS NOT NULL FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
SELECT user_id, event_id, state, allowed FROM s WHERE n > 0""")  # fmt: skip
def program_actions(t: Tables) -> DataFrame:
    log = t.events.select("user_id", "event_id", "ts", F.when(F.col("event_type") == "signup", "publish").when(F.col("event_type") == "error", "archive").otherwise("republish").alias("action"))
    return review.acted(log, "user_id", ["ts", "event_id"], "action", review.PROGRAM_ACTIONS, "draft").select("user_id", "event_id", "state", "allowed")


@asked("""WITH c AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'click' THEN 'clarify' WHEN 'purchase' THEN 'link' WHEN 'error' THEN 'reject' ELSE 'view' END AS a FROM events),
f AS (SELECT user_id, min((ts, event_id)) FILTER (a IN ('link', 'reject')) AS ended, arg_min(a, (ts, event_id)) FILTER (a IN ('link', 'reject')) AS how, min((ts, event_id)) FILTER (a = 'clarify') AS asked FROM c GROUP BY 1)
SELECT user_id, event_id, CASE WHEN ended <= (ts, event_id) THEN how || CASE how WHEN 'link' THEN 'ed' ELSE 'ed' END WHEN asked <= (ts, event_id) THEN 'needs_clarification' ELSE 'open' END AS state FROM c JOIN f USING (user_id)""")  # fmt: skip
def discovery_actions(t: Tables) -> DataFrame:
    log = t.events.select("user_id", "event_id", "ts", F.when(F.col("event_type") == "click", "clarify").when(F.col("event_type") == "purchase", "link").when(F.col("event_type") == "error", "reject").otherwise("view").alias("action"))
    return review.acted(log, "user_id", ["ts", "event_id"], "action", review.DISCOVERY_ACTIONS, "open").select("user_id", "event_id", "state")


@asked("""SELECT o_orderkey AS id, unnest(list_filter([CASE WHEN o_orderkey % 2 = 0 THEN 'a.x' END, CASE WHEN o_orderkey % 3 = 0 THEN 'a.y.z' END, CASE WHEN o_orderkey % 5 = 0 THEN 'b' END], lambda x: x IS NOT NULL)) AS path FROM orders""")
def changed_paths(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")

    def version(x, z, b) -> DataFrame:
        return t.orders.select(key.alias("id"), F.to_json(F.struct(F.struct(x.alias("x"), F.struct(z.alias("z")).alias("y")).alias("a"), b.alias("b"), F.array(F.lit(1), F.lit(2)).alias("l"))).alias("record"))

    return review.changed_paths(version(F.lit(1), F.lit("q"), F.lit(None).cast("int")), version(F.when(key % 2 == 0, 2).otherwise(1), F.when(key % 3 == 0, "r").otherwise("q"), F.when(key % 5 == 0, 7)), "id", depth=3)


MESSAGE = "CASE WHEN value < 20 THEN 'HTTP 503 timeout' WHEN value < 40 THEN 'HTTP 404 connection reset' WHEN value < 80 THEN 'Name or service not known' ELSE 'bad title' END"


@asked(f"""WITH i AS (SELECT user_id, CASE WHEN event_type IN ('view', 'click') THEN 'fetch_error' WHEN event_type = 'error' THEN 'parse_error' ELSE 'database_unavailable' END AS code, {MESSAGE} AS m, value > 97 OR value < 3 AS bad FROM events),
p AS (SELECT *, code = 'database_unavailable' OR (code = 'fetch_error' AND m IN ('HTTP 503 timeout', 'Name or service not known')) AS passing FROM i)
SELECT user_id, CASE WHEN count(*) FILTER (bad) = 0 THEN 'success' WHEN count(*) FILTER (bad) = count(*) FILTER (bad AND passing) THEN 'transient' ELSE 'permanent' END AS retry_class FROM p GROUP BY 1""")  # fmt: skip
def retry_class(t: Tables) -> DataFrame:
    v = F.col("value")
    message = F.when(v < 20, "HTTP 503 timeout").when(v < 40, "HTTP 404 connection reset").when(v < 80, "Name or service not known").otherwise("bad title")
    code = F.when(F.col("event_type").isin("view", "click"), "fetch_error").when(F.col("event_type") == "error", "parse_error").otherwise("database_unavailable")
    return review.retry_class(t.events.select("user_id", code.alias("code"), message.alias("message"), F.when((v > 97) | (v < 3), "error").otherwise("info").alias("severity")), "user_id")


@asked("""SELECT event_id, CASE WHEN c_custkey IS NULL OR user_id % 3 = 0 THEN 'run' WHEN user_id % 3 = 1 THEN 'replay' ELSE 'conflict' END AS outcome FROM events LEFT JOIN customer ON c_custkey = user_id""")
def idempotent_requests(t: Tables) -> DataFrame:
    requests = t.events.select("event_id", F.lit("x").alias("actor"), F.col("user_id").alias("idempotency_key"), F.lit("f").alias("fingerprint"))
    known = t.customer.where("c_custkey % 3 > 0").select(F.lit("x").alias("actor"), F.col("c_custkey").alias("idempotency_key"), F.when(F.col("c_custkey") % 3 == 1, "f").otherwise("g").alias("fingerprint"))
    return review.replayed(requests, known).select("event_id", "outcome")


@asked("""SELECT o_orderkey AS case_id, coalesce(string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_shipdate, l_linenumber), '') AS actions FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def case_details(t: Tables) -> DataFrame:
    actions = t.lineitem.select(F.col("l_orderkey").alias("case_id"), F.col("l_shipdate").alias("at"), F.col("l_linenumber").alias("action"))
    got = review.case_details(t.orders.select(F.col("o_orderkey").alias("case_id")), actions=actions)
    return got.select("case_id", F.array_join(F.transform("actions", lambda x: x["action"].cast("string")), ",").alias("actions"))


KEYED = r"""d AS (SELECT doc_id AS id, source, array_to_string(string_split(text, ' ')[1:3], ' ') AS ext, md5(text) AS url, lang,
  nullif(trim(regexp_replace(lower(string_split(text, '.')[1]), '[^\p{L}\p{N}_]+', ' ', 'g')), '') AS title, n_chars % 365 AS deadline FROM documents)"""


@asked(f"""WITH {KEYED}, w AS (SELECT id, count(*) OVER a - 1 AS n0, min(id) OVER a AS l0, count(*) OVER b - 1 AS n1, min(id) OVER b AS l1, count(*) OVER c - count(*) OVER b AS n2, min(id) OVER c AS l2,
  CASE WHEN title IS NULL THEN 0 ELSE count(*) OVER e - 1 END AS n3, min(id) OVER e AS l3 FROM d WINDOW a AS (PARTITION BY source, ext), b AS (PARTITION BY source, url), c AS (PARTITION BY url), e AS (PARTITION BY title, lang, deadline))
SELECT id, CAST(CASE WHEN n0 > 0 THEN 0 WHEN n1 > 0 THEN 1 WHEN n2 > 0 THEN 2 ELSE 3 END AS INTEGER) AS level_rank,
  CASE WHEN n0 > 0 THEN 'exact_external_id' WHEN n1 > 0 THEN 'exact_url' WHEN n2 > 0 THEN 'exact_origin_url' ELSE 'normalized_fields' END AS level,
  CASE WHEN n0 > 0 THEN n0 WHEN n1 > 0 THEN n1 WHEN n2 > 0 THEN n2 ELSE n3 END AS links, CASE WHEN n0 > 0 THEN l0 WHEN n1 > 0 THEN l1 WHEN n2 > 0 THEN l2 ELSE l3 END AS representative FROM w WHERE n0 + n1 + n2 + n3 > 0""")  # fmt: skip
def entity_match_classes(t: Tables) -> DataFrame:
    return resolve.match_classes(_entities(t))


def _entities(t: Tables) -> DataFrame:
    return t.documents.select(
        F.col("doc_id").alias("id"), F.col("source").alias("source_id"), F.substring_index("text", " ", 3).alias("external_id"), F.md5("text").alias("url"), F.array(F.md5("text")).alias("origin_urls"),
        normalize.normalized_ascii(F.substring_index("text", ".", 1)).alias("title_key"), F.col("lang").alias("organizer_key"), F.date_add(F.lit(date(2020, 1, 1)), (F.col("n_chars") % 365).cast("int")).alias("deadline_on"),
    )


@asked("SELECT CASE WHEN doc_id % 2 = 0 THEN 'staged' ELSE 'program' END AS target_kind, count(*) AS records, count(CASE WHEN doc_id % 2 = 0 THEN 1 END) AS with_external_id FROM documents WHERE text IS NOT NULL GROUP BY 1")
def target_union(t: Tables) -> DataFrame:
    rows = _entities(t)
    got = resolve.targets(rows.where("id % 2 = 0"), rows.where("id % 2 = 1").drop("external_id"))
    return got.groupBy("target_kind").agg(F.count(F.lit(1)).alias("records"), F.count("external_id").alias("with_external_id"))


@asked("""WITH o AS (SELECT o_orderkey AS id, o_orderkey % 11 = 0 AS e, o_orderkey % 13 = 0 AS w, n, best, clash, ok FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, min(l_linenumber % 4) AS best, count(*) FILTER (l_tax > 0.06) AS clash,
  bool_and(l_linenumber % 4 < 2 AND l_returnflag = 'N' AND l_tax <= 0.06) AS ok, count(*) FILTER (l_linenumber % 4 = 2) AS crossed FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
x AS (SELECT l_orderkey AS id, count(*) FILTER (l_linenumber % 4 = 2) AS crossed FROM lineitem GROUP BY 1), m AS (SELECT o.*, coalesce(n, 0) = 1 AND coalesce(ok, false) AND NOT e AND NOT w AS merge FROM o)
SELECT id, coalesce(n, 0) AS observations, merge AS auto_merge, concat_ws(',', CASE WHEN e THEN 'quality_error' WHEN w THEN 'quality_warning' END,
  CASE WHEN merge THEN 'duplicate' WHEN best < 2 AND clash > 0 THEN 'exact_identity_conflict' WHEN crossed > 0 THEN 'cross_source_match' WHEN best = 3 THEN 'possible_duplicate' WHEN best < 2 THEN 'exact_review' ELSE 'ready' END,
  CASE WHEN n > 1 THEN 'multiple_candidates' END) AS reason_codes FROM m LEFT JOIN x USING (id)""")  # fmt: skip
def match_decisions(t: Tables) -> DataFrame:
    candidates = t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 11 == 0).alias("has_error"), (F.col("o_orderkey") % 13 == 0).alias("has_warning"))
    observed = t.lineitem.select(
        F.col("l_orderkey").alias("candidate_id"), (F.col("l_linenumber") % 4).alias("level_rank"), F.when(F.col("l_returnflag") == "N", "staged").otherwise("program").alias("target_kind"),
        F.when(F.col("l_tax") > 0.06, F.array(F.lit("title_key"))).otherwise(F.array().cast("array<string>")).alias("conflicts"), F.lit(True).alias("target_clean"), F.lit(True).alias("runs_completed"),
    )
    return resolve.decisions(candidates, observed).withColumn("reason_codes", F.array_join("reason_codes", ","))


# Drafts


def _candidates(t: Tables) -> DataFrame:
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date").cast("string")
    term = lambda slug, name: F.struct(F.lit(slug).alias("slug"), F.lit(name).alias("name"))
    record = F.struct(
        F.when(k % 10 > 0, F.concat(F.lit("«Call "), k, F.lit(" open»"))).alias("title"), F.when(k % 7 > 0, F.concat(F.lit("HTTPS://Example.org/calls/"), k)).alias("record_url"), F.when(F.col("o_orderstatus") == "F", day).alias("deadline_on"),
        F.struct(F.lit("exact").alias("value_kind"), F.lit("USD").alias("currency_code"), F.col("o_totalprice").cast("decimal(14,2)").cast("string").alias("exact_amount")).alias("funding"),
        F.struct(
            F.when(k % 3 == 0, "По всей России").alias("summary"), F.struct(F.concat(F.lit("https://example.org/apply/"), k).alias("url"), day.alias("end_on")).alias("application"),
            F.array(term("science", "Science"), term("science", "Science")).alias("themes"), F.when(k % 2 == 0, F.array(term("north", "North"))).alias("geographies"),
            F.array(F.struct(F.lit("Приём заявок").alias("label"), day.alias("start_on")), F.struct(F.lit("Итоги").alias("label"), F.lit("?").alias("start_on"))).alias("timeline"),
            F.array(F.struct(F.lit("Rules").alias("title"), F.lit("https://example.org/rules.pdf").alias("url")), F.struct(F.lit("mail me@example.org").alias("title"), F.lit("https://example.org/x").alias("url"))).alias("resources"),
            F.array(F.struct(F.lit("About").alias("heading"), F.lit("Text").alias("content")), F.struct(F.lit("Menu").alias("heading"), F.lit("Text").alias("content"))).alias("sections"),
        ).alias("payload"),
    )
    return t.orders.select(k.alias("candidate_id"), F.col("o_custkey").alias("source_id"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("completed").alias("run_status"), F.to_json(record).alias("record"))


GOOD = "g AS (SELECT *, CASE WHEN o_orderstatus = 'P' THEN 'run_not_completed' WHEN o_orderkey % 10 = 0 THEN 'no_title' WHEN o_orderkey % 7 = 0 THEN 'no_url' END AS problem FROM orders)"


@asked(f"""WITH {GOOD} SELECT o_orderkey AS candidate_id, o_custkey AS source_id, 'https://example.org/calls/' || o_orderkey AS source_url, 'Call ' || o_orderkey || ' open' AS title, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS deadline_on,
  CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS DOUBLE) AS exact_amount, o_orderkey % 3 = 0 AS country_wide FROM g WHERE problem IS NULL""")  # fmt: skip
def draft_programs(t: Tables) -> DataFrame:
    got = drafts.build(_candidates(t))["programs"]
    return got.select("candidate_id", "source_id", "source_url", "title", "deadline_on", F.col("exact_amount").cast("double").alias("exact_amount"), "country_wide")


@asked(f"""WITH {GOOD} SELECT o_orderkey AS candidate_id, 'themes' AS dimension, 'science' AS slug FROM g WHERE problem IS NULL UNION ALL SELECT o_orderkey, 'geographies', 'north' FROM g WHERE problem IS NULL AND o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey, 'geographies', 'russia' FROM g WHERE problem IS NULL AND o_orderkey % 2 = 1 AND o_orderkey % 3 = 0""")  # fmt: skip
def draft_taxonomy(t: Tables) -> DataFrame:
    return drafts.build(_candidates(t))["taxonomy"].select("candidate_id", "dimension", "slug")


@asked(f"""WITH {GOOD} SELECT o_orderkey AS candidate_id, 'https://example.org/rules.pdf' AS url, 'document' AS kind FROM g WHERE problem IS NULL UNION ALL SELECT o_orderkey, 'https://example.org/apply/' || o_orderkey, 'page' FROM g WHERE problem IS NULL""")
def draft_resources(t: Tables) -> DataFrame:
    return drafts.build(_candidates(t))["resources"].select("candidate_id", "url", "kind")


@asked(f"""WITH {GOOD} SELECT o_orderkey AS candidate_id, problem, CASE WHEN problem IS NULL THEN 'Call ' || o_orderkey || ' open' END AS title, CASE WHEN problem IS NULL THEN 2 ELSE 0 END AS timeline, CASE WHEN problem IS NULL THEN 2 ELSE 0 END AS resources,
  CASE WHEN problem IS NULL THEN 1 ELSE 0 END AS sections, CASE WHEN problem IS NULL THEN CASE WHEN o_orderkey % 2 = 0 THEN 'north' WHEN o_orderkey % 3 = 0 THEN 'russia' ELSE '' END ELSE '' END AS geographies FROM g""")  # fmt: skip
def draft_preview(t: Tables) -> DataFrame:
    return drafts.preview(_candidates(t)).select("candidate_id", "problem", "title", "timeline", "resources", "sections", F.coalesce(F.array_join("geographies", ","), F.lit("")).alias("geographies"))


# Texts


@asked("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'unknown' WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN 'unknown' WHEN o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT' THEN 'not_stated' ELSE 'exact' END AS kind,
  CASE WHEN o_orderstatus = 'O' AND o_orderpriority <> '1-URGENT' THEN CAST(o_orderkey + 1000 AS DOUBLE) WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN CAST(o_orderkey + 9000000 AS DOUBLE) END AS amount,
  CASE WHEN o_orderstatus = 'P' THEN 'total_grant_fund_conflict' WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN 'total_grant_fund_breakdown_required' ELSE 'ok' END AS outcome FROM orders""")  # fmt: skip
def total_fund(t: Tables) -> DataFrame:
    a, b = ((F.col("o_orderkey") + n).cast("string") for n in (1000, 9_000_000))
    status = F.col("o_orderstatus")
    text = F.when(status == "O", F.concat(F.lit("Грантовый фонд конкурса "), a, F.lit(" руб. Размер гранта "), b, F.lit(" руб."))).when(status == "F", F.concat(F.lit("Размер гранта "), b, F.lit(" рублей.")))
    text = text.otherwise(F.concat(F.lit("Общий грантовый фонд "), a, F.lit(" руб. Грантовый фонд финала "), b, F.lit(" руб.")))
    got = parse.total_fund(F.array(F.struct(F.when(F.col("o_orderpriority") == "1-URGENT", "Бюджет конкурса").otherwise("О конкурсе").alias("heading"), text.alias("text"))))
    return t.orders.select("o_orderkey", got.alias("f")).select("o_orderkey", "f.kind", F.col("f.amount").cast("double").alias("amount"), "f.outcome")


TIMELINE = (
    ("Оценка заявок", "evaluation"), ("Заключение договоров с победителями", "contracting"), ("Объявление результатов приёма заявок", "results"), ("Начало реализации", "implementation"), ("Начало выплат", "implementation"),
    ("Начало приёма заявок", "application_open"), ("Завершение подачи заявок", "application_close"), ("Приём заявок", "application"), ("Встреча", "other"),
)


@asked("SELECT o_orderkey, CASE o_orderkey % 9 " + " ".join(f"WHEN {k} THEN '{kind}'" for k, (_, kind) in enumerate(TIMELINE)) + " END AS kind FROM orders")
def timeline_kinds(t: Tables) -> DataFrame:
    label = F.element_at(F.array(*(F.lit(x) for x, _ in TIMELINE)), (F.col("o_orderkey") % 9 + 1).cast("int"))
    return t.orders.select("o_orderkey", parse.timeline_kind(label).alias("kind"))


DAY = "CAST(CAST(o_orderdate AS DATE) {} AS VARCHAR)"


@asked(f"""SELECT o_orderkey, 'Приём заявок' AS label, 'application' AS kind, {DAY.format('')} AS start_on, {DAY.format('+ 30')} AS end_on FROM orders
UNION ALL SELECT o_orderkey, 'Экспертиза', 'evaluation', NULL, {DAY.format('+ 40')} FROM orders UNION ALL SELECT o_orderkey, '2 этап — Подведение итогов', 'results', NULL, {DAY.format('+ 50')} FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey, 'Подведение итогов', 'results', NULL, {DAY.format('+ 50')} FROM orders WHERE o_orderkey % 2 = 1""")  # fmt: skip
def schedule_events(t: Tables) -> DataFrame:
    months = F.array(*map(F.lit, parse.MONTHS))

    def told(days: int):
        d = F.date_add(F.col("o_orderdate").cast("date"), days)
        return F.concat_ws(" ", F.dayofmonth(d), F.element_at(months, F.month(d)), F.year(d))

    last = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("2 этап Подведение итогов "), told(50))).otherwise(F.concat(F.lit("Подведение итогов: "), told(50), F.lit(" года")))
    text = F.concat(F.lit("График.  Приём заявок: с "), told(0), F.lit(" по "), told(30), F.lit("; Экспертиза до "), told(40), F.lit(" приём заявок: с "), told(0), F.lit(" по "), told(30), F.lit("; Оценка без даты; "), last)
    # Reading a text is long, its row is short: rows are dealt out, so that a file of few row groups keeps all cores busy.
    orders = t.orders.select("o_orderkey", "o_orderdate").repartition(4 * t.spark.sparkContext.defaultParallelism)
    texts = orders.select("o_orderkey", text.alias("text"))
    return texts.select("o_orderkey", F.explode(parse.schedule_events(F.col("text"), F.lit(1990))).alias("e")).select("o_orderkey", "e.label", "e.kind", "e.start_on", "e.end_on")


#: A title, a text and the class they make, each branch and its near misses.
PUBLICATION_CASES = (
    ("Подведены итоги конкурса", "текст", "result"), ("Итоги по конкурсу «Старт»", "", "result"), ("Итоги недели", "список победителей конкурса", "ignore"),
    ("Завершился формальный этап", "заявки конкурса", "milestone"), ("Рассмотрение заявлений граждан", "заявления", "milestone"), ("Этап экспертизы", "новости", "ignore"),
    ("Продлён приём: срок продлен", "", "extension"), ("Конкурс продолжается", "итоги недели", "ignore"), ("Внесены изменения", "в положение", "amendment"), ("Изменения в расписании", "автобус", "ignore"),
    ("Запуск нового большого конкурса", "", "launch"), ("Открыт приём", "", "launch"), ("Запуск. Новый конкурс", "прием заявок", "opportunity"), ("Конкурс", "подать заявку; вебинар", "ignore"),
    ("Премия года", "Можно прислать письмо", "ignore"), ("Премия года", "Заявки можно подать", "opportunity"), ("Новости", "приём заявок", "ignore"), ("Конференция победителей", "", "ignore"),
)


@asked(f"""WITH c AS (SELECT * FROM (VALUES {", ".join(f"({k}, '{kind}')" for k, (*_, kind) in enumerate(PUBLICATION_CASES))}) AS v(n, kind)) SELECT o_orderkey, kind,
  CASE WHEN kind = 'result' THEN 'completed' WHEN CAST(o_orderdate AS DATE) + 60 < DATE '1998-06-01' THEN 'completed' WHEN CAST(o_orderdate AS DATE) > DATE '1998-06-01' THEN 'upcoming' ELSE 'open' END AS status
  FROM orders JOIN c ON n = o_orderkey % {len(PUBLICATION_CASES)}""")
def publication_classes(t: Tables) -> DataFrame:
    n, day = (F.col("o_orderkey") % len(PUBLICATION_CASES) + 1).cast("int"), F.col("o_orderdate").cast("date")
    title, text = (F.element_at(F.array(*(F.lit(c[k]) for c in PUBLICATION_CASES)), n) for k in (0, 1))
    rows = t.orders.select("o_orderkey", day.alias("day"), parse.publication_class(title, text).alias("kind"))
    return rows.select("o_orderkey", "kind", publications.lifecycle(F.when(F.col("kind") == "result", "completed").otherwise("open"), F.col("day"), F.date_add("day", 60), F.lit(TODAY)).alias("status"))


@asked("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS VARCHAR) || '.5' ELSE CAST(p_partkey AS VARCHAR) END AS plain, CASE WHEN p_partkey % 3 = 0 THEN 'https://a.example/x' WHEN p_partkey % 3 = 1 THEN 'ID ' || p_partkey END AS external_id FROM part")
def plain_values(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    number = F.when(k % 2 == 0, F.concat(k.cast("string"), F.lit(".500"))).otherwise(F.concat(k.cast("string"), F.lit(".00")))
    ident = F.when(k % 3 == 0, "HTTPS://A.example//x/?utm_source=1").when(k % 3 == 1, F.concat(F.lit(" ID "), k, F.lit(" "))).otherwise("  ")
    return t.part.select("p_partkey", normalize.plain_decimal(number).alias("plain"), normalize.external_id(ident).alias("external_id"))


SIGNED = "CASE WHEN value_kind NOT IN ('unknown', 'not_stated') THEN value_kind || '|' || coalesce(CAST(exact_amount AS VARCHAR), '-') END"


@asked(using(PROGRAMS, f"y AS (SELECT launch_year AS y, o_custkey AS c, arg_max({SIGNED}, (published_at, program_id)) AS s, arg_max((1, {SIGNED}), (published_at, program_id)) AS b FROM programs JOIN orders ON o_orderkey = program_id GROUP BY ALL)")
    + "SELECT a.y AS week_start, count(*) AS compared, count(*) FILTER (a.b[2] IS DISTINCT FROM z.b[2]) AS signature_changes, count(*) FILTER (a.b[2] IS DISTINCT FROM z.b[2]) AS any_change FROM y a JOIN y z ON a.c = z.c AND a.y = z.y + 1 GROUP BY 1")
def funding_changes(t: Tables) -> DataFrame:
    rows = t.programs().join(t.orders.select(F.col("o_orderkey").alias("program_id"), "o_custkey"), "program_id").withColumn("signature", normalize.funding_signature("exact_amount"))
    latest = rows.groupBy(F.col("launch_year").alias("week_start"), F.col("o_custkey").alias("entity")).agg(F.max_by(F.struct("signature"), F.struct("published_at", "program_id")).alias("s"))
    links = rows.select(F.col("launch_year").alias("week_start"), (F.col("launch_year") - 1).alias("previous_week")).distinct()
    return temporal.attribute_changes(temporal.paired(latest.select("week_start", "entity", "s.signature"), links, ["signature"]), ["signature"])


@asked("""WITH RECURSIVE e AS (SELECT DISTINCT CAST(date_trunc('week', ts) AS DATE) AS w, user_id AS u, event_type AS k FROM events), p AS (SELECT DISTINCT a.w, a.k AS x, b.k AS y FROM e a JOIN e b USING (w, u)),
c(w, x, y) AS (SELECT * FROM p UNION SELECT c.w, c.x, p.y FROM c JOIN p ON p.w = c.w AND p.x = c.y), h AS (SELECT w, count(DISTINCT m) AS n FROM (SELECT w, x, min(y) AS m FROM c GROUP BY ALL) GROUP BY 1)
SELECT CAST(e.w AS VARCHAR) AS week_start, count(DISTINCT u) + count(DISTINCT k) AS nodes, count(*) AS edges, round(count(*) / CAST(count(DISTINCT u) * count(DISTINCT k) AS DOUBLE), 9) AS density, any_value(n) AS components,
  count(DISTINCT u) < 3 OR count(DISTINCT k) < 5 AS small_graph FROM e JOIN h ON h.w = e.w GROUP BY e.w""")  # fmt: skip
def weekly_network(t: Tables) -> DataFrame:
    links = t.events.select(temporal.week_start(F.col("ts")).alias("week_start"), F.col("user_id").alias("src"), F.col("event_type").alias("dst"))
    return network.summaries(links, "week_start").withColumn("density", F.round("density", 9))


@asked("SELECT o_custkey AS source_url, CAST(o_orderkey AS VARCHAR) AS record_key, 'https://x/' || o_orderkey AS record_url, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS deadline_on FROM orders WHERE o_orderstatus <> 'P'")
def competition_list(t: Tables) -> DataFrame:
    item = F.struct(
        F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderstatus") != "P", "A call").alias("title"), F.concat(F.lit("/"), "o_orderkey").alias("url"), F.col("o_orderdate").cast("date").cast("string").alias("end_on"), F.lit("a@b.c").alias("contact")
    )
    bodies = t.orders.groupBy(F.col("o_custkey").alias("source_url")).agg(F.to_json(F.collect_list(item)).alias("body"))
    return packages.competitions(bodies, "https://x/")[0].select("source_url", "record_key", "record_url", "deadline_on")


# Publications and exports


@asked("""SELECT o_orderkey AS url_key, CASE WHEN o_orderkey % 3 = 0 THEN 'b' ELSE 'a' END AS end_on, CASE WHEN o_orderkey % 3 = 0 THEN 'deadline_differs' END AS warning, o_orderkey % 3 < 2 AS in_portal FROM orders
UNION ALL SELECT -p_partkey - 1, 'c', 'portal_only', true FROM part""")  # fmt: skip
def portal_enrichment(t: Tables) -> DataFrame:
    records = t.orders.select(F.col("o_orderkey").alias("url_key"), F.lit("t").alias("title"), F.lit("a").alias("end_on"))
    portal = t.orders.where("o_orderkey % 3 < 2").select(F.col("o_orderkey").alias("url_key"), F.lit("p").alias("title"), F.when(F.col("o_orderkey") % 3 == 0, "b").otherwise("a").alias("end_on"))
    portal = portal.unionByName(t.part.select((-F.col("p_partkey") - 1).alias("url_key"), F.lit("p").alias("title"), F.lit("c").alias("end_on")))
    return publications.enriched(records, portal).drop("title")


@asked("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN CAST(CAST(l_shipdate AS DATE) AS VARCHAR) WHEN l_quantity > 25 THEN CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS day, CASE WHEN l_linenumber > 1 AND l_quantity <= 25 THEN 'dates_differ' END AS warning FROM lineitem")
def reconciled_dates(t: Tables) -> DataFrame:
    day = F.col("l_shipdate").cast("date")
    top, stages = F.when(F.col("l_linenumber") > 1, day), F.when((F.col("l_quantity") > 25) | (F.col("l_linenumber") == 1), day).otherwise(F.date_add(day, 1))
    got, warning = publications.reconciled(top, stages)
    return t.lineitem.select("l_orderkey", "l_linenumber", got.alias("day"), warning.alias("warning"))


@asked(using(GEOGRAPHIES) + "SELECT program_id, CASE slug WHEN 'ASIA' THEN 'district' WHEN 'EUROPE' THEN 'district' WHEN 'AFRICA' THEN 'country' ELSE 'other' END AS kind, string_agg(CASE slug WHEN 'ASIA' THEN 'Asia' WHEN 'EUROPE' THEN 'Europe' WHEN 'AFRICA' THEN 'Africa' ELSE slug END, ',' ORDER BY CASE slug WHEN 'ASIA' THEN 'Asia' WHEN 'EUROPE' THEN 'Europe' WHEN 'AFRICA' THEN 'Africa' ELSE slug END) AS names FROM geographies GROUP BY ALL")
def geography_groups(t: Tables) -> DataFrame:
    name = F.when(F.col("r_name") == "ASIA", "Asia").when(F.col("r_name") == "EUROPE", "Europe").when(F.col("r_name") == "AFRICA", "Africa")
    aliases = t.region.where(name.isNotNull()).select(F.col("r_name").alias("slug"), name.alias("name"), F.when(name == "Africa", "country").otherwise("district").alias("kind"), F.lit(1).alias("position"))
    return publications.grouped_geographies(t.geographies(), aliases).withColumn("names", F.array_join("names", ","))


@asked("SELECT event_id AS snapshot_id, concat_ws(',', CASE WHEN event_type <> 'view' THEN 'data_class_differs' END, CASE WHEN user_id % 2 = 1 THEN 'calculation_version_differs' END) AS reasons, event_type = 'view' AND user_id % 2 = 0 AS is_compatible, CASE WHEN event_type <> 'view' THEN 'not_real' WHEN user_id % 2 = 1 THEN 'incompatible' WHEN value < 50 THEN 'fingerprint_differs' END AS refused FROM events")
def snapshot_gate(t: Tables) -> DataFrame:
    rows = t.events.select(
        F.col("event_id").alias("snapshot_id"), F.when(F.col("event_type") == "view", "real").otherwise("test").alias("data_class"), F.when(F.col("user_id") % 2 == 0, "v3").otherwise("v2").alias("calculation_version"),
        F.lit("f").alias("input_fingerprint"), F.when(F.col("value") < 50, "g").otherwise("f").alias("stored_fingerprint"),
    )
    got = metrics.compatibility(rows, {"data_class": "real", "calculation_version": "v3"})
    refused = export.reproducible(got).withColumnRenamed("reason", "refused")
    return got.join(refused, "snapshot_id", "left").select("snapshot_id", F.array_join("reasons", ",").alias("reasons"), "is_compatible", "refused")


@asked("SELECT CAST(p_partkey AS VARCHAR) AS metric_key FROM part WHERE p_size % 3 > 0 AND p_partkey % 2 = 0 UNION ALL SELECT 'stored-' || p_partkey FROM part WHERE p_size % 5 = 0 UNION ALL SELECT 'moved-' || p_partkey FROM part WHERE p_size % 7 = 0")
def metric_gate(t: Tables) -> DataFrame:
    rows = t.part.select(F.col("p_partkey").cast("string").alias("metric_key"), F.when(F.col("p_size") % 3 > 0, "sum").alias("formula"), F.when(F.col("p_partkey") % 2 == 0, "pcs").alias("unit"), *(F.lit("x").alias(c) for c in ("snapshot_id", "missing_rule", "limitation")))
    kept = export.documented(rows).select("metric_key")
    stored = t.part.select(F.concat(F.lit("stored-"), "p_partkey").alias("metric_key"), F.lit(1.0).alias("value_num")).unionByName(t.part.select(F.concat(F.lit("moved-"), "p_partkey").alias("metric_key"), F.lit(1.0).alias("value_num")))
    again = t.part.where("p_size % 5 > 0").select(F.concat(F.lit("stored-"), "p_partkey").alias("metric_key"), F.lit(1.0).alias("value_num")).unionByName(t.part.select(F.concat(F.lit("moved-"), "p_partkey").alias("metric_key"), F.when(F.col("p_size") % 7 == 0, 2.0).otherwise(1.0).alias("value_num")))
    return kept.unionByName(metrics.inconsistent(stored, again).select("metric_key"))


@asked(using(PROGRAMS) + "SELECT program_id, CASE WHEN program_id % 3 = 0 THEN 'invitation_only' WHEN program_id % 3 = 1 THEN 'open' ELSE 'unknown' END AS access_mode, program_id % 2 = 0 AS country_wide, 'Name ' || CASE WHEN program_id % 2 = 0 THEN 'A' ELSE 'B' END AS title FROM programs")
def text_labels(t: Tables) -> DataFrame:
    k = F.col("program_id")
    text = F.concat_ws(" ", F.when(k % 3 == 0, "Участие по приглашению").when(k % 3 == 1, "Открыт для всех").otherwise("Заявки"), F.when(k % 2 == 0, "по всей России").otherwise("в области"))
    title = F.concat(F.lit("«Name "), F.when(k % 2 == 0, "A 2024 год").otherwise("B"), F.lit("»"))
    return t.programs().select("program_id", labels.access_mode(text).alias("access_mode"), labels.country_scope(text).alias("country_wide"), labels.clean_title(title).alias("title"))


# SQL of queries that stand in ``queries``

LANES = " || '|' || ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 15 * k}, 15) AS BIGINT)) % 2305843009213693951 AS VARCHAR)" for k in range(3))
ORACLE_SQL["roster_fingerprint"] = using(PROGRAMS) + f"""SELECT CAST(launch_year AS VARCHAR) AS snapshot_id, count(*) AS programs, sha256(count(*) || '|' || {LANES}) AS fingerprint FROM
  (SELECT launch_year, sha256(to_json({{'deadline_on': CAST(deadline_on AS VARCHAR), 'program_id': program_id, 'source_key': source_key, 'value_kind': value_kind}})::VARCHAR) AS h FROM programs) GROUP BY launch_year"""
ORACLE_SQL["length_prefixed_fingerprint"] = "SELECT page_id, sha256(from_hex(format('{:016x}', strlen(url))) || encode(url) || from_hex(format('{:016x}', strlen(html))) || encode(html)) AS fingerprint FROM pages"
ORACLE_SQL["public_content"] = r"""SELECT lang, coalesce(regexp_matches(text, '(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}|(\+7|8)[\s(-]*\d{3}[\s)-]*\d{3}[\s-]*\d{2}[\s-]*\d{2}'), false) AS has_contact, 'page' AS kind, count(*) AS documents FROM documents GROUP BY ALL"""
ORACLE_SQL["insights"] = using(PROGRAMS, GEOGRAPHIES, "themes AS (SELECT DISTINCT l_orderkey AS program_id, p_type AS slug FROM lineitem JOIN part ON l_partkey = p_partkey)") + """SELECT * FROM (SELECT slug || ' leads the regions with ' || count(*) || ' programs.' AS sentence FROM programs JOIN geographies USING (program_id) GROUP BY slug ORDER BY count(*) DESC, slug LIMIT 1)
UNION ALL SELECT * FROM (SELECT slug || ' is the widest topic with ' || count(*) || ' programs.' FROM programs JOIN themes USING (program_id) GROUP BY slug ORDER BY count(*) DESC, slug LIMIT 1)
UNION ALL SELECT * FROM (SELECT n_name || ' publishes most: ' || count(program_id) || ' programs.' FROM nation LEFT JOIN programs ON source_key = n_name GROUP BY n_name ORDER BY count(program_id) DESC, n_name LIMIT 1)"""


@asked(using(PROGRAMS) + """SELECT o_orderkey AS program_id, CAST(l_suppkey AS VARCHAR) || '/' || o_orderkey AS source_url, s_name AS source_name, CASE WHEN o_orderkey % 2 = 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS deadline_on, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS amount
FROM orders JOIN (SELECT l_orderkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey""")  # fmt: skip
def program_summary(t: Tables) -> DataFrame:
    links = t.lineitem.select(F.col("l_orderkey").alias("program_id"), F.col("l_suppkey").alias("source_id")).distinct().withColumn("source_url", F.concat_ws("/", "source_id", "program_id"))
    primary = links.groupBy("program_id").agg(F.min("source_id").alias("primary_source_id"))
    orders = t.orders.select(F.col("o_orderkey").alias("program_id"), F.col("o_orderdate").cast("date").alias("deadline_on"), F.col("o_totalprice").alias("amount"))
    got = catalog.summary(
        orders.select("program_id").join(primary, "program_id"), links, t.supplier.select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("name")),
        deadlines=orders.where("program_id % 2 = 0").select("program_id", "deadline_on"), funding=orders.where("program_id % 3 = 0").select("program_id", "amount"),
    )
    return got.select("program_id", "source_url", "source_name", "deadline_on", "amount")


@asked("""SELECT l_orderkey AS program_id, CASE l_suppkey % 5 WHEN 0 THEN 'volga' WHEN 1 THEN 'volga' WHEN 2 THEN 'far-eastern' ELSE 'city-' || l_suppkey END AS slug,
  CASE l_suppkey % 5 WHEN 0 THEN 'Приволжский' WHEN 1 THEN 'Приволжский' WHEN 2 THEN 'Дальневосточный' ELSE 'City' END AS name FROM lineitem GROUP BY ALL""")  # fmt: skip
def geography_aliases(t: Tables) -> DataFrame:
    k = F.col("l_suppkey") % 5
    slug = F.when(k == 0, "x").when(k == 1, "Privolzhsky-federal-district").when(k == 2, "dfo").otherwise(F.concat(F.lit("city-"), "l_suppkey"))
    name = F.when(k == 0, "приволжский  федеральный округ").when(k == 1, "Округ").when(k == 2, "Дальне-восточный").otherwise("City")
    aliases = t.spark.createDataFrame(
        [("Приволжский федеральный округ", "volga", "Приволжский"), ("privolzhsky", "volga", "Приволжский"), ("дальне восточный", "far-eastern", "Дальневосточный")], "alias string, slug string, name string"
    )
    return catalog.canonical_geographies(t.lineitem.select(F.col("l_orderkey").alias("program_id"), slug.alias("slug"), name.alias("name")), aliases)


@asked("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Call ' || o_orderkey WHEN 1 THEN 'грант ' || o_orderkey WHEN 2 THEN '«Call ' || o_orderkey || '»' ELSE 'Call' END AS title, day(o_orderdate) || ' ' || ['января', 'февраля', 'марта', 'апреля', 'мая', 'июня', 'июля', 'августа', 'сентября', 'октября', 'ноября', 'декабря'][month(o_orderdate)] || ' ' || year(o_orderdate) AS day FROM orders")
def publication_titles(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    title = F.when(k % 4 == 0, F.concat(F.lit("Запуск  конкурса Call "), k, F.lit("."))).when(k % 4 == 1, F.concat(F.lit("Открыт приём заявок на грант "), k)).when(k % 4 == 2, F.concat(F.lit("Продление программы «Call "), k, F.lit("»"))).otherwise(" - Call")
    return t.orders.select("o_orderkey", labels.bare_title(title).alias("title"), labels.date_label(F.col("o_orderdate").cast("date")).alias("day"))


@asked("SELECT event_id, row_number() OVER w AS sight, row_number() OVER w = 1 AS is_first FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)")
def message_sights(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("user_id").alias("source_id"), F.col("event_type").alias("message_id"), F.col("ts").alias("observed_at"), "event_id")
    return feed.observations(rows).select("event_id", "sight", "is_first")


@asked("""WITH d AS (SELECT event_id, user_id, event_type AS f, CAST(floor(value) AS INTEGER) % 4 AS m FROM events), x AS (SELECT *, min(event_id) FILTER (m > 0) OVER (PARTITION BY user_id, f) AS first FROM d)
SELECT event_id, CASE WHEN m = 0 THEN 'empty' WHEN (f = 'view' AND c_custkey IS NOT NULL) OR event_id > first THEN 'skipped' ELSE 'run' END AS outcome FROM x LEFT JOIN customer ON c_custkey = user_id""")  # fmt: skip
def deliveries(t: Tables) -> DataFrame:
    batch = t.events.select("event_id", F.col("user_id").alias("source_id"), F.col("event_type").alias("fingerprint"), (F.floor("value").cast("int") % 4).alias("messages"), F.col("event_id").alias("at"))
    known = t.customer.select(F.col("c_custkey").alias("source_id"), F.lit("view").alias("fingerprint"))
    return feed.delivered(batch, known).select("event_id", "outcome")


@asked("""WITH c AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'click' THEN 'clarify' WHEN 'purchase' THEN 'accept' WHEN 'error' THEN 'reject' WHEN 'signup' THEN 'merge' ELSE 'view' END AS a FROM events),
f AS (SELECT user_id, min((ts, event_id)) FILTER (a IN ('accept', 'reject', 'merge')) AS ended, arg_min(a, (ts, event_id)) FILTER (a IN ('accept', 'reject', 'merge')) AS how, min((ts, event_id)) FILTER (a = 'clarify') AS asked FROM c GROUP BY 1)
SELECT user_id, event_id, CASE WHEN ended <= (ts, event_id) THEN CASE how WHEN 'merge' THEN 'merged' ELSE how || 'ed' END WHEN asked <= (ts, event_id) THEN 'needs_clarification' ELSE 'open' END AS state FROM c JOIN f USING (user_id)""")  # fmt: skip
def case_actions(t: Tables) -> DataFrame:
    e = F.col("event_type")
    log = t.events.select("user_id", "event_id", "ts", F.when(e == "click", "clarify").when(e == "purchase", "accept").when(e == "error", "reject").when(e == "signup", "merge").otherwise("view").alias("action"))
    return review.acted(log, "user_id", ["ts", "event_id"], "action", review.CASE_ACTIONS, "open").select("user_id", "event_id", "state")


@asked("SELECT o_orderkey AS case_id, coalesce(r, o_orderstatus) AS record, coalesce(n, 0) AS revisions FROM orders LEFT JOIN (SELECT l_orderkey, arg_max(f, l_linenumber) AS r, max(l_linenumber) AS n FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS f FROM lineitem GROUP BY ALL) GROUP BY 1) ON l_orderkey = o_orderkey")
def effective_records(t: Tables) -> DataFrame:
    revisions_ = t.lineitem.groupBy(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("revision_number")).agg(F.min("l_returnflag").alias("record"))
    return review.effective(t.orders.select(F.col("o_orderkey").alias("case_id"), F.col("o_orderstatus").alias("record")), revisions_)


@asked("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'removed' ELSE 'changed' END AS problem FROM orders WHERE o_orderstatus = 'P' OR o_orderkey % 10 = 0")
def overwritten_rows(t: Tables) -> DataFrame:
    before = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    after = t.orders.where("o_orderstatus <> 'P'").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 10 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"))
    return review.overwritten(before, after, "o_orderkey")


@asked("""WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'manual-' ELSE 'part-' END || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS slug, lower(trim(p_name)) AS k FROM part),
c AS (SELECT p_partkey, first_value(slug) OVER (PARTITION BY k ORDER BY starts_with(slug, 'manual-'), slug) AS canonical FROM t) SELECT DISTINCT l_orderkey AS program_id, canonical AS slug FROM lineitem JOIN c ON p_partkey = l_partkey""")  # fmt: skip
def taxonomy_relinked(t: Tables) -> DataFrame:
    slug = lambda c: F.concat(F.when(F.col(c) % 3 == 0, "manual-").otherwise("part-"), F.lpad(F.col(c).cast("string"), 9, "0"))
    canonical = catalog.canonical_taxonomy(t.part.select(slug("p_partkey").alias("slug"), F.col("p_name").alias("name")))
    return catalog.relinked(t.lineitem.select(F.col("l_orderkey").alias("program_id"), slug("l_partkey").alias("slug")), canonical)


@asked("SELECT p_partkey, 'manual-' || substr(sha256('theme' || chr(0) || lower(p_name)), 1, 16) AS slug FROM part")
def manual_slugs(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", normalize.manual_slug("theme", F.upper("p_name")).alias("slug"))


#: kind, title, section, category, url, whether its group has winners; the kind to show and whether it is public.
RESOURCE_CASES = (
    ("result", "  ", "Материалы", None, "https://a.example/1", False, "result", False),
    ("reference", "Подробнее", "Материалы", None, "https://a.example/1", False, "reference", False),
    ("reference", "Подробнее о конкурсе", "Материалы", None, "https://a.example/1", False, "reference", True),
    ("program_document", "Политика конфиденциальности", "Материалы", None, "https://a.example/1", False, "program_document", False),
    ("program_document", "Канал фонда", "Материалы", None, "https://www.vk.com/x", False, "reference", True),
    ("program_document", "Канал фонда", "Материалы", "documents", "https://m.vk.com/x", True, "reference", False),
    ("detail", "Канал фонда", None, "official_channels", "https://t.me/x", False, "reference", True),
    ("detail", "Страница", "Материалы", None, "https://notvk.com/x", False, "detail", False),
    ("application", "Подать заявку", None, None, "https://a.example/1", True, "application", True),
    ("application", "Подать заявку", "Материалы", "application", "https://a.example/1", False, "application", False),
    ("reference", "Список лауреатов", "Материалы", "documents", "https://a.example/1", False, "result", True),
    ("result", "Итоги года", "Материалы", None, "https://a.example/1", False, "result", False),
    ("result", "Итоги  отбора", None, "text", "https://a.example/1", False, "result", True),
    ("reference", "Файл", "Результаты конкурса", None, "https://a.example/1", False, "result", True),
    ("reference", "Файл", "Материалы", None, "https://a.example/itogi/2025", False, "reference", True),
    ("result", "Файл", "Материалы", None, "https://a.example/konkursy/itogi-2025?x=laureat", False, "result", True),
    ("result", "Файл", "Материалы", None, "https://a.example/%D0%BF%D0%BE%D0%B1%D0%B5%D0%B4%D0%B8%D1%82%D0%B5%D0%BB%D0%B8", False, "result", True),
    ("program_document", "Положение", "Материалы", "Documents", "https://a.example/1", False, "program_document", True),
    ("program_document", "Положение", "Материалы", "text", "https://a.example/1", False, "program_document", False),
    ("video", "Ролик", "Материалы", "documents", "https://a.example/1", False, "video", False),
    ("program_document", "Положение", "Похожие материалы", None, "https://a.example/1", False, "program_document", False),
    ("program_document", "Положение", " ", None, None, False, "program_document", False),
)


def _value(x: object) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else f"'{x}'"


@asked(f"""SELECT o_orderkey, kind, is_public FROM orders JOIN (VALUES {", ".join(f"({k}, {_value(c[6])}, {_value(c[7])})" for k, c in enumerate(RESOURCE_CASES))}) AS v(n, kind, is_public) ON n = o_orderkey % {len(RESOURCE_CASES)}""")
def public_resources(t: Tables) -> DataFrame:
    n = (F.col("o_orderkey") % len(RESOURCE_CASES) + 1).cast("int")
    kind, title, section, category, url, won = (F.element_at(F.array(*(F.lit(c[k]).cast("boolean" if k == 5 else "string") for c in RESOURCE_CASES)), n).alias(name) for k, name in enumerate(("kind", "title", "section", "category", "url", "won")))
    rows = t.orders.select("o_orderkey", kind, title, section, category, url, won)
    given = {c: F.col(c) for c in ("kind", "title", "section", "url", "won")}
    return rows.select("o_orderkey", labels.public_kind(*given.values()).alias("kind"), labels.is_public_resource(given["kind"], given["title"], given["section"], F.col("category"), given["url"], given["won"]).alias("is_public"))
