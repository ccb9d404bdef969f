"""One query for every family of operators, over whole driver tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callboard.functions import labels, normalize, parse, schedule, textsearch
from callboard.operators import baseline, bi, catalog, metrics, network, publications, regional, resolve, review, snapshots, temporal
from callboard.plans.bindings import Tables
from callboard.sources import pages
from callboard.streaming import feed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TODAY, AS_OF = date(1998, 6, 1), datetime(2024, 1, 25)


def query(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    """Registers a query.  Dates leave as text, which every client shows alike."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = f(Tables(spark, sf_dir))
        days = {n: F.col(n).cast("string") for n, kind in df.dtypes if kind == "date"}
        return df.withColumns(days) if days else df

    QUERIES[f.__name__] = run
    return f


@query
def baseline_source_share(t: Tables) -> DataFrame:
    """The flagship: programs of every source, their share, and quartiles of their money."""
    return baseline.source_summary(t.sources(), t.programs()).withColumn("share", F.round("share", 12)).orderBy("source_key")


@query
def catalog_page_published(t: Tables) -> DataFrame:
    q = catalog.CatalogQuery(sort="deadline_on", page=3, page_size=50)
    return catalog.Catalog(t.programs()).page(q).select("program_id", "source_key", "source_status", "deadline_on", "value_kind")


@query
def catalog_filter_groups(t: Tables) -> DataFrame:
    q = catalog.CatalogQuery(sources=("FRANCE", "CHINA", "NATION_1", "NATION_2", "NATION_3"), statuses=("F", "O"), themes=("ECONOMY", "SMALL"), deadline_from=date(1996, 1, 1), deadline_to=date(1999, 12, 31))
    return catalog.Catalog(t.programs(), themes=t.themes()).filtered(q).select("program_id", "source_key", "source_status", "deadline_on")


@query
def catalog_total(t: Tables) -> DataFrame:
    return catalog.Catalog(t.programs(), geographies=t.geographies()).total(catalog.CatalogQuery(value_kinds=("exact", "unknown"), geographies=("ASIA", "EUROPE"), search="  call   1"))


@query
def catalog_unknown_status(t: Tables) -> DataFrame:
    details = t.lineitem.groupBy(F.col("l_orderkey").alias("program_id")).agg(F.max("l_linestatus").alias("source_status"))
    return catalog.with_unknown_status(t.programs().drop("source_status"), details, ("unknown", "F")).select("program_id", "source_status")


@query
def catalog_facets(t: Tables) -> DataFrame:
    return catalog.facets(t.programs().where("publication_status = 'published'"), ("source_key", "value_kind", "support_type"))


@query
def source_counts(t: Tables) -> DataFrame:
    return catalog.source_counts(t.sources(), t.programs().where("publication_status = 'published'")).orderBy(F.desc("programs"), "source_key")


@query
def nearest_deadlines(t: Tables) -> DataFrame:
    return catalog.nearest_deadlines(t.programs(), F.lit(TODAY), 5).select("program_id", "deadline_on")


@query
def taxonomy_canonical(t: Tables) -> DataFrame:
    terms = t.part.select(F.concat(F.when(F.col("p_partkey") % 3 == 0, "manual-").otherwise("part-"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("slug"), F.col("p_name").alias("name"))
    return catalog.canonical_taxonomy(terms)


@query
def in_given_order(t: Tables) -> DataFrame:
    ids = t.lineitem.select(F.col("l_orderkey").alias("program_id"), (F.col("l_linenumber") + 10 * F.col("l_partkey")).alias("position"))
    return catalog.in_given_order(ids, t.programs()).select("program_id", "position", "source_key")


@query
def program_details(t: Tables) -> DataFrame:
    lines = t.lineitem.select(F.col("l_orderkey").alias("program_id"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("part"))
    got = catalog.program_details(t.programs().select("program_id", "source_key"), lines=lines)
    return got.select("program_id", "source_key", F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x["position"], x["part"])), ",").alias("lines"))


@query
def baseline_funding_states(t: Tables) -> DataFrame:
    return baseline.funding_states(t.programs()).withColumn("share", F.round("share", 12))


@query
def baseline_funding_quantiles(t: Tables) -> DataFrame:
    return baseline.quartiles(baseline.funding_measures(t.programs()), ["currency_code", "value_kind", "measure"], "amount")


@query
def baseline_deadline_days(t: Tables) -> DataFrame:
    return baseline.deadline_metrics(t.programs(), F.lit(TODAY)).withColumn("presence_share", F.round("presence_share", 12)).withColumn("upcoming_share", F.round("upcoming_share", 12))


@query
def baseline_bootstrap(t: Tables) -> DataFrame:
    rows = baseline.funding_measures(t.programs()).join(t.programs().select("program_id", "source_key"), "program_id")
    metric = F.concat_ws(".", F.lit("funding.quantile"), "source_key", "currency_code", "value_kind", "measure")
    return baseline.bootstrap_intervals(rows.withColumn("metric", metric), "metric", "amount", "program_id", "driver-tables|1")


@query
def quality_ratios(t: Tables) -> DataFrame:
    programs = t.programs().select("program_id", F.lit(True).alias("title_present"), (F.col("source_status") != "P").alias("source_url_present"), F.col("published_at").alias("observed_at"), "deadline_on", "value_kind")
    cases = t.events.where("event_type in ('signup', 'purchase')").select(
        F.when(F.col("event_type") == "signup", "canonical").otherwise("discovery").alias("case_type"), F.when(F.col("value") < 10, "open").when(F.col("value") < 40, "needs_clarification").otherwise("resolved").alias("status"), (F.col("user_id") % 7 == 0).alias("has_explicit_conflict")
    )
    runs = t.events.select(F.col("user_id").cast("string").alias("source_key"), F.when(F.col("event_type") == "error", "failed").otherwise("succeeded").alias("status"), (F.col("event_type") == "view").alias("dry_run"), F.col("ts").alias("finished_at"))
    sources = t.customer.select(F.col("c_custkey").cast("string").alias("source_key"))
    return baseline.quality_ratios(programs, cases, runs, sources, F.lit(datetime(1998, 6, 1)), 365).withColumn("value", F.round("value", 12))


@query
def execution_coverage(t: Tables) -> DataFrame:
    runs = t.events.select(F.col("user_id").alias("source_key"), F.when(F.col("event_type") == "error", "failed").otherwise("succeeded").alias("status"), (F.col("event_type") == "view").alias("dry_run"))
    return baseline.execution_coverage(t.customer.select(F.col("c_custkey").alias("source_key")), runs)


@query
def snapshot_exclusions(t: Tables) -> DataFrame:
    day = F.col("published_at")
    rows = t.programs().select("publication_status", "published_at", (day + F.expr("interval 30 days")).alias("updated_at"), F.when(F.col("support_type") == "MACHINERY", "excluded").otherwise("active").alias("source_bucket"), (day + F.expr("interval 90 days")).alias("observed_at"))
    return snapshots.exclusions(snapshots.eligibility(rows, F.lit(datetime(2000, 1, 1))))


@query
def roster_fingerprint(t: Tables) -> DataFrame:
    return snapshots.roster_fingerprint(t.programs().withColumn("snapshot_id", F.col("launch_year").cast("string")), "snapshot_id", ["program_id", "source_key", "value_kind", "deadline_on"])


@query
def regional_coverage(t: Tables) -> DataFrame:
    return regional.coverage(t.programs(), t.themes())


@query
def regional_category(t: Tables) -> DataFrame:
    return regional.incidence(t.programs(), t.geographies())


@query
def regional_by_source(t: Tables) -> DataFrame:
    return regional.by_source(t.programs(), t.themes())


@query
def regional_leave_one_out(t: Tables) -> DataFrame:
    return regional.leave_one_out(t.programs(), t.geographies())


def _network(t: Tables) -> tuple[DataFrame, DataFrame]:
    return network.edges(t.brand_links()), t.supplier.select(F.col("s_suppkey").alias("src"))


@query
def network_edges(t: Tables) -> DataFrame:
    return _network(t)[0]


@query
def network_node_metrics(t: Tables) -> DataFrame:
    return network.node_metrics(*_network(t)).withColumn("centrality", F.round("centrality", 12))


@query
def network_density(t: Tables) -> DataFrame:
    return network.density(*_network(t)).withColumn("density", F.round("density", 12))


@query
def network_components(t: Tables) -> DataFrame:
    """The program graph: customers as sources, linked to each of their orders."""
    links = t.orders.select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), F.col("o_orderkey").alias("program_id"))
    return network.components(network.edges(links), t.customer.select(F.col("c_custkey").alias("src")))


def _weeks(t: Tables) -> DataFrame:
    return temporal.calendar(t.events.agg(F.min("ts").alias("first"), F.max("ts").alias("last")))


def _links(t: Tables) -> DataFrame:
    return t.members().select("week_start").distinct().withColumn("previous_week", F.lag("week_start").over(Window.orderBy("week_start")))


@query
def weekly_latest(t: Tables) -> DataFrame:
    snaps = t.events.select(F.col("event_id").alias("snapshot_id"), F.col("ts").alias("as_of"), "event_type", "user_id")
    return temporal.weekly_latest(snaps, ["event_type", "user_id"]).select("event_type", "user_id", "week_start", "snapshot_id", "omitted")


@query
def weekly_calendar(t: Tables) -> DataFrame:
    snaps = t.events.select(F.col("event_id").alias("snapshot_id"), F.col("ts").alias("as_of"))
    edges = t.events.agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    got = temporal.intervals(temporal.series(_weeks(t), temporal.weekly_latest(snaps, []), []), edges)
    return got.select("week_start", "snapshot_id", "previous_week", "status", "gap_weeks", "partial", "interval_seconds", "warning")


@query
def weekly_intake_removed(t: Tables) -> DataFrame:
    return temporal.changes(temporal.paired(t.members(), _links(t), []), _links(t))


@query
def weekly_membership_changes(t: Tables) -> DataFrame:
    return temporal.attribute_changes(temporal.paired(t.members(), _links(t), ["level", "entries", "kinds"]), ["level", "entries", "kinds"])


@query
def weekly_transitions(t: Tables) -> DataFrame:
    return temporal.state_transitions(temporal.paired(t.members(), _links(t), ["level"]), "level")


@query
def weekly_category_points(t: Tables) -> DataFrame:
    rows = t.events.select(temporal.week_start(F.col("ts")).alias("week_start"), F.col("user_id").alias("entity"), F.col("event_type").alias("category"))
    return temporal.category_points(rows, _links(t))


@query
def snapshot_compare(t: Tables) -> DataFrame:
    week = temporal.week_start(F.col("ts"))
    rows = t.events.groupBy("event_type", week.alias("week")).agg(F.count_distinct("user_id").alias("programs"))
    rows = rows.select(
        F.col("event_type").alias("series"), F.concat_ws("/", "event_type", "week").alias("snapshot_id"), F.col("week").alias("as_of"), "programs", F.lit("all").alias("source_scope"),
        F.when(F.month("week") == 1, F.when(F.dayofmonth("week") > 20, "v3").otherwise("v2")).otherwise("v1").alias("calculation_version"), F.lit(30).alias("freshness_window_days"), F.lit("r").alias("registry_fingerprint"), F.lit("real").alias("data_class"),
    )
    got = baseline.compare_counts(rows)
    return got.withColumn("reasons", F.array_join("reasons", ","))


@query
def bi_filter(t: Tables) -> DataFrame:
    rows = t.bi_programs().withColumns(
        {
            "coverage_level": F.lit("federal"), "audience": F.array(F.lit("all")), "status": F.col("source_status"), "funding_amount": F.col("exact_amount"), "funding_min": F.col("min_amount"), "funding_max": F.col("max_amount"),
            "active_from": F.col("deadline_on"), "active_to": F.date_add("deadline_on", 200), "history": F.array(F.struct((F.col("launch_year") + 1).alias("year"))),
        }
    )
    f = bi.BiFilter(region="ASIA", topic="ECONOMY", year=1998, amount_from=50_000, amount_to=400_000, period="activeNow")
    return bi.filtered(rows, f, F.lit(TODAY)).select("program_id", "launch_year", "deadline_on")


@query
def bi_money_summary(t: Tables) -> DataFrame:
    return bi.money_summary(t.programs())


@query
def bi_finance_by_region(t: Tables) -> DataFrame:
    return bi.money_distribution(t.bi_programs(), F.explode("regions"))


@query
def bi_finance_by_type(t: Tables) -> DataFrame:
    return bi.money_distribution(t.programs(), F.col("support_type"))


@query
def bi_region_score(t: Tables) -> DataFrame:
    return bi.region_scores(t.bi_programs().withColumn("coverage_level", F.col("support_type")), 2, ("AUTOMOBILE", "MACHINERY"))


@query
def bi_topic_strength(t: Tables) -> DataFrame:
    return bi.topic_strength(t.bi_programs())


@query
def bi_topic_region(t: Tables) -> DataFrame:
    return bi.topic_regions(t.bi_programs())


@query
def bi_support_gaps(t: Tables) -> DataFrame:
    return bi.support_gaps(t.bi_programs())


@query
def bi_source_rankings(t: Tables) -> DataFrame:
    rows = t.bi_programs().withColumn("quality_score", F.when(F.col("value_kind") == "unknown", 50).otherwise(100))
    return bi.source_rankings(t.sources().select(F.col("source_key").alias("source_id")), rows)


@query
def bi_data_quality(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id", "left")
    missing = [("label", F.col("quality").isNull()), ("long_text", F.col("n_chars") < 400), ("good", F.coalesce(F.col("quality") == 0, F.lit(False))), ("clean", F.coalesce(F.col("toxic") == 1, F.lit(False)))]
    fields, score, level = bi.completeness(missing)
    marked = rows.select("lang", fields.alias("missing"), score.alias("score"), level.alias("level"))
    return bi.data_quality(marked, "lang", [n for n, _ in missing])


@query
def bi_month_seasonality(t: Tables) -> DataFrame:
    return bi.month_seasonality(t.programs().withColumn("deadline", F.col("deadline_on")))


def _years(t: Tables) -> DataFrame:
    history = t.lineitem.groupBy(F.col("l_orderkey").alias("program_id")).agg(F.collect_list(F.struct(F.year("l_shipdate").alias("year"), F.col("l_extendedprice").cast("decimal(14,2)").alias("funding"))).alias("history"))
    return bi.year_roll(t.programs().join(history, "program_id", "left"))


@query
def bi_year_roll(t: Tables) -> DataFrame:
    return _years(t)


@query
def bi_forecast(t: Tables) -> DataFrame:
    return bi.forecast(_years(t))


@query
def bi_growing_topics(t: Tables) -> DataFrame:
    return bi.growing_topics(t.bi_programs(), year=2000)


@query
def display_status(t: Tables) -> DataFrame:
    window = t.lineitem.groupBy(F.col("l_orderkey").alias("program_id")).agg(F.min("l_shipdate").cast("date").alias("open_from"), F.max("l_shipdate").cast("date").alias("open_to"), F.max("l_shipdate").cast("date").alias("latest_known"))
    rows = t.programs().select("program_id", F.when(F.col("source_status") == "P", "upcoming").alias("source_status")).join(window, "program_id", "left")
    return rows.select("program_id", bi.display_status(F.lit(TODAY)).alias("status"))


@query
def duplicate_in_package(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.md5("text").alias("key"), (F.col("n_chars") >= 30).alias("is_valid"))
    return resolve.duplicate_rows(rows, "key", "doc_id")


@query
def import_outcomes(t: Tables) -> DataFrame:
    rows = t.documents.where("doc_id % 2 = 1").select("source", F.md5("text").alias("record_key"), F.col("doc_id"), (F.col("n_chars") >= 100).alias("is_valid"), F.md5(F.concat_ws("|", "lang", "n_chars")).alias("body_hash"))
    rows = resolve.duplicate_rows(rows.withColumn("key", F.concat_ws("|", "source", "record_key")), "key", "doc_id").withColumnRenamed("source", "source_id")
    history = t.documents.where("doc_id % 2 = 0").select(F.col("source").alias("source_id"), F.md5("text").alias("record_key"), F.col("doc_id").alias("staged_at"), F.md5(F.concat_ws("|", "lang", F.col("n_chars") + F.col("doc_id") % 4)).alias("body_hash"))
    return resolve.import_outcomes(rows, history).select("doc_id", "outcome")


@query
def entity_matches(t: Tables) -> DataFrame:
    rows = t.documents.select(
        F.col("doc_id").alias("id"), F.col("source").alias("source_id"), F.substring_index("text", " ", 3).alias("external_id"), F.md5("text").alias("url"), F.array(F.md5("text")).alias("origin_urls"),
        normalize.normalized_ascii(F.substring_index("text", ".", 1)).alias("title_key"), F.col("lang").alias("organizer_key"), F.date_add(F.lit(date(2020, 1, 1)), (F.col("n_chars") % 365).cast("int")).alias("deadline_on"),
    )
    return resolve.matches(rows.where("id % 20 = 0"), rows).withColumn("conflicts", F.array_join("conflicts", ","))


@query
def url_normalize(t: Tables) -> DataFrame:
    return t.pages.select("page_id", normalize.normalized_url(F.col("url")).alias("normalized"))


@query
def url_dedup(t: Tables) -> DataFrame:
    return t.pages.select(normalize.dedup_url(F.col("url")).alias("key"), "page_id").groupBy("key").agg(F.count(F.lit(1)).alias("pages"), F.min("page_id").alias("first_page"))


@query
def url_route(t: Tables) -> DataFrame:
    urls = t.pages.select(normalize.normalized_url(F.col("url")).alias("url"))
    origin = F.regexp_extract("url", "^(https?://[^/]*)", 1)
    language = F.regexp_extract("url", "^https?://[^/]*/([^/?]*)", 1)
    rules = urls.groupBy(origin.alias("origin"), language.alias("language")).agg(F.count(F.lit(1)).alias("n"))
    narrow = rules.where("language <> 'de'").select(F.concat_ws("/", "origin", "language").alias("source_key"), "origin", F.concat(F.lit("/"), "language", F.lit("/")).alias("prefix"))
    wide = rules.where("language = 'en' and n > 1").select(F.col("origin").alias("source_key"), "origin", F.lit("/").alias("prefix")).distinct()
    return resolve.route(urls, narrow.unionByName(wide))


@query
def text_normalize_dedup(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(normalize.normalized_ascii(F.col("text"))).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first_document"))


@query
def text_normalize_unicode(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.length(normalize.normalized_text(F.col("text"))).alias("folded_chars"))


@query
def token_search(t: Tables) -> DataFrame:
    return t.part.where(textsearch.has_all(F.col("p_name"), "RING, small")).select("p_partkey", "p_name")


@query
def token_relevance(t: Tables) -> DataFrame:
    score = textsearch.relevance([F.col("p_name"), F.col("p_type"), F.col("p_brand")], "small ring")
    return t.part.select("p_partkey", "p_name", score.alias("score")).where("score > 0")


@query
def trigram_search(t: Tables) -> DataFrame:
    score, matches = textsearch.fuzzy(F.col("p_name"), "smal widgets")
    return t.part.where(matches).select("p_partkey", "p_name", F.round(score, 9).alias("score"))


@query
def theme_tag(t: Tables) -> DataFrame:
    return parse.tagged(t.documents, {"and": r"\band\b", "license": "licen[cs]e|copyright", "mail": "[a-z0-9._]+@[a-z0-9.]+", "numbers": "[0-9]{4}"})


@query
def money_parse(t: Tables) -> DataFrame:
    text = F.concat(F.lit("Грант до "), F.format_number(F.col("o_totalprice").cast("decimal(14,2)"), 2), F.lit(" руб."))
    text = F.regexp_replace(text, ",", " ")
    return t.orders.select("o_orderkey", F.element_at(parse.amounts(text), 1).cast("double").alias("amount"), parse.funding_kind(text).alias("kind"))


@query
def html_title_links(t: Tables) -> DataFrame:
    return pages.parsed(t.pages).select("page_id", "title", F.size("headings").alias("headings"), F.size("links").alias("links"), F.length("text").alias("chars"))


@query
def page_link_counts(t: Tables) -> DataFrame:
    return pages.page_links(pages.parsed(t.pages, ("page_id",))).groupBy("href").agg(F.count(F.lit(1)).alias("pages"))


@query
def json_props(t: Tables) -> DataFrame:
    return t.events.select(F.variant_get(F.parse_json("props"), "$.k", "int").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query
def fingerprint(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", normalize.fingerprint("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").alias("fingerprint"))


@query
def length_prefixed_fingerprint(t: Tables) -> DataFrame:
    return t.pages.select("page_id", normalize.prefixed_fingerprint(F.col("url"), F.col("html")).alias("fingerprint"))


@query
def state_transitions(t: Tables) -> DataFrame:
    return review.move_counts(t.conversations.select("conv_id", "turn", "role"), "conv_id", "turn", "role").withColumnRenamed("role", "state")


@query
def state_violations(t: Tables) -> DataFrame:
    allowed = {("system", "user"), ("user", "assistant")}
    return review.violations(t.conversations.select("conv_id", "turn", "role"), "conv_id", "turn", "role", allowed)


@query
def current_state(t: Tables) -> DataFrame:
    return review.current(t.events.select("user_id", "event_id", "ts", "event_type"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", "entries")


@query
def prev_record(t: Tables) -> DataFrame:
    return review.previous_record(t.events.select("event_id", "user_id", "event_type", "ts", "value"), ["user_id", "event_type"], ["ts", "event_id"], ["event_id", "value"]).select("event_id", "previous_event_id", "previous_value")


@query
def unresolved_issues(t: Tables) -> DataFrame:
    issues = t.orders.select(F.col("o_orderkey").alias("issue_id"), "o_orderstatus")
    return review.open_issues(issues, t.lineitem.where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("issue_id")))


@query
def journal_prune(t: Tables) -> DataFrame:
    return feed.unexpired(t.events, "ts", F.lit(AS_OF), 14).select("event_id", "user_id")


@query
def cursor_skip(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("user_id").alias("source_id"), F.col("event_id").alias("message_id"))
    cursors = t.events.where("event_type = 'signup'").groupBy(F.col("user_id").alias("source_id")).agg(F.max("event_id").alias("high_water"))
    return feed.after_cursor(rows, cursors)


@query
def first_last_seen(t: Tables) -> DataFrame:
    return feed.seen_state(t.events, "user_id", "ts", 30)


@query
def weekly_windows(t: Tables) -> DataFrame:
    return feed.weekly(t.events.select(F.col("event_type").alias("source_id"), F.col("ts").alias("published_at")))


@query
def retry_backoff(t: Tables) -> DataFrame:
    attempts = t.events.where("event_type = 'error'").withColumn("attempt", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return attempts.select("event_id", review.backoff_seconds(F.col("attempt").cast("double"), retry_after=F.col("value")).alias("wait"))


@query
def client_sort(t: Tables) -> DataFrame:
    rows = catalog.client_sorted(t.programs(), "deadline", F.lit(TODAY))
    return rows.select("program_id", catalog.deadline_rank(F.col("deadline_on"), F.lit(TODAY)).alias("rank"))


@query
def region_options(t: Tables) -> DataFrame:
    return catalog.options(t.bi_programs(), "regions", ("AFRICA",))


@query
def publication_groups(t: Tables) -> DataFrame:
    rows = t.documents.select(F.col("doc_id").alias("publication_id"), F.md5("text").alias("key"))
    heads = rows.where("key is not null").groupBy("key").agg(F.min("publication_id").alias("src"))
    links = rows.join(heads, "key").where("src <> publication_id").select("src", F.col("publication_id").alias("dst"))
    return publications.groups(rows, links)


@query
def publication_folding(t: Tables) -> DataFrame:
    rows = t.orders.select(
        F.col("o_custkey").alias("group_id"), F.col("o_orderkey").alias("publication_id"), F.col("o_orderdate").alias("published_at"), F.when(F.col("o_orderstatus") == "P", "result").otherwise("launch").alias("kind"), F.col("o_orderpriority").alias("title"),
        F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice")).alias("funding"), F.array(F.concat(F.lit("u"), F.col("o_orderkey") % 4)).alias("urls"), F.col("o_orderdate").cast("date").alias("end_on"),
    )
    return publications.folded(rows).withColumn("urls", F.array_join("urls", ","))


@query
def link_inventory(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_custkey").alias("key"), F.concat(F.when(F.col("o_orderstatus") == "F", "https://a/").otherwise("http://a/"), F.col("o_orderkey") % 10).alias("url"), F.col("o_orderpriority").alias("context"))
    return publications.link_inventory(rows).withColumn("contexts", F.array_join("contexts", "|"))


@query
def resource_propagation(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_orderkey").alias("program_id"), F.col("l_returnflag").alias("group_key"), "l_linenumber", (F.col("l_quantity") > 45).alias("leads_to_winners"))
    return publications.propagated(rows).groupBy("group_key", "is_result").agg(F.count(F.lit(1)).alias("resources"))


@query
def application_windows(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_orderkey").alias("record_id"), F.lit("application").alias("kind"), F.col("l_shipdate").cast("date").alias("start_on"), F.date_add(F.col("l_shipdate").cast("date"), F.col("l_quantity").cast("int")).alias("end_on"))
    return publications.application_window(rows)


@query
def artifact_status(t: Tables) -> DataFrame:
    url = F.concat(F.when(F.col("l_linestatus") == "O", "part-").otherwise("missing-"), "l_partkey")
    parents = t.lineitem.groupBy(F.col("l_orderkey").alias("record_id")).agg(F.array_sort(F.collect_list(url)).alias("artifact_urls"))
    files = t.part.select(F.concat(F.lit("part-"), "p_partkey").alias("url"), F.md5("p_name").alias("sha256"))
    return publications.attached(parents, files, 2).groupBy("status").agg(F.count(F.lit(1)).alias("links"))


@query
def schedule_due(t: Tables) -> DataFrame:
    return t.events.where(schedule.due("*/10,7/5 6-18 1-31 * 1-5", F.col("ts"))).select("event_id", "event_type")


@query
def public_content(t: Tables) -> DataFrame:
    got = t.documents.select(labels.has_contact(F.col("text")).alias("has_contact"), labels.resource_kind(F.col("source"), F.col("source")).alias("kind"), "lang")
    return got.groupBy("lang", "has_contact", "kind").agg(F.count(F.lit(1)).alias("documents"))


@query
def funding_labels(t: Tables) -> DataFrame:
    return t.programs().select("program_id", labels.funding_label().alias("label"))


def _metrics(t: Tables) -> DataFrame:
    runs = t.events.select(F.concat(F.lit("NATION_"), F.col("user_id") % 20).alias("source_key"), F.when(F.col("event_type") == "error", "failed").otherwise("succeeded").alias("status"), (F.col("event_type") == "view").alias("dry_run"))
    return metrics.baseline_metrics(t.programs(), t.sources(), runs, F.lit(TODAY))


@query
def baseline_metrics(t: Tables) -> DataFrame:
    return _metrics(t).withColumn("value_num", F.round("value_num", 9))


@query
def chart_series(t: Tables) -> DataFrame:
    return metrics.chart_series(_metrics(t), "opportunities.source.", ".count")


@query
def insights(t: Tables) -> DataFrame:
    facts = bi.coverage(t.bi_programs()).select("kind", "name", F.col("programs").alias("value"))
    regions, topics = (facts.where(F.col("kind") == kind).drop("kind") for kind in ("region", "topic"))
    return metrics.insights(regions, topics, catalog.source_counts(t.sources(), t.programs()).select(F.col("source_key").alias("name"), F.col("programs").alias("value")))
