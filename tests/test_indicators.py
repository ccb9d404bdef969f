"""The control cases with results worked out by hand."""

from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from callboard import schemas
from callboard.operators import baseline, bi, catalog, metrics, network, regional, snapshots, temporal

AS_OF = datetime(2026, 9, 1, 12)


@pytest.fixture(scope="module")
def roster(spark):
    rows = [
        ("p1", "A", date(2026, 9, 11), datetime(2026, 8, 31), "exact", 100, None, None),
        ("p2", "A", date(2026, 9, 21), datetime(2026, 8, 30), "minimum", None, 200, None),
        ("p3", "B", date(2026, 10, 1), datetime(2026, 8, 29), "maximum", None, None, 500),
        ("p4", "B", date(2026, 8, 27), datetime(2026, 8, 28), "range", None, 100, 300),
        ("p5", "A", None, datetime(2026, 7, 20), "unknown", None, None, None),
        ("p6", "B", None, datetime(2026, 7, 19), "not_stated", None, None, None),
        ("p7", "A", date(2026, 9, 1), datetime(2026, 7, 18), None, None, None, None),
    ]
    money = lambda x: None if x is None else Decimal(x)
    rows = [("s", p, s, AS_OF, AS_OF, seen, d, k, "USD" if x or y or z else None, money(x), money(y), money(z)) for p, s, d, seen, k, x, y, z in rows]
    return spark.createDataFrame(rows, schemas.PROGRAMS).withColumn("title_present", F.lit(True)).withColumn("source_url_present", F.lit(True))


def test_funding_union(spark, roster):
    assert schemas.violations(roster).count() == 0
    bad = [("exact", None, 1, None, None), ("range", "USD", None, 5, 2), ("unknown", "USD", None, None, None), ("exact", "usd", 1, None, None), ("minimum", "USD", 1, 2, None), ("gift", "USD", 1, None, None), ("exact", "USD", 0, None, None)]
    rows = [("s", str(k), "A", AS_OF, AS_OF, AS_OF, None, kind, code, *(None if x is None else Decimal(x) for x in amounts)) for k, (kind, code, *amounts) in enumerate(bad)]
    got = {r.program_id: r.rule for r in schemas.violations(spark.createDataFrame(rows, schemas.PROGRAMS)).collect()}
    assert got == {"0": "currency", "1": "range_order", "2": "amount_or_currency_without_number", "3": "currency", "4": "amounts", "5": "unknown_kind", "6": "amounts"}


def test_baseline_control(spark, roster):
    sources = spark.createDataFrame([("A",), ("B",), ("C",)], "source_key string")
    shares = {r.source_key: (r.n, r.share) for r in baseline.source_shares(sources, roster).collect()}
    assert shares == {"A": (4, 4 / 7), "B": (3, 3 / 7), "C": (0, 0.0)}
    states = baseline.funding_states(roster)
    assert states.where("has_record").agg(F.sum("share")).first()[0] == pytest.approx(6 / 7)
    assert states.where("is_numeric").agg(F.sum("share")).first()[0] == pytest.approx(4 / 7)
    d = baseline.deadline_metrics(roster, F.lit(date(2026, 9, 1))).first()
    assert (d.presence_share, d.upcoming_share, d.overdue) == (5 / 7, 4 / 7, 1)
    assert (d.days_q25, d.days_median, d.days_q75) == (7.5, 15.0, 22.5)
    measures = {(r.value_kind, r.measure): r.amount for r in baseline.funding_measures(roster).collect()}
    assert measures[("range", "min")] == 100 and measures[("range", "max")] == 300 and len(measures) == 5


def test_quality_control(spark, roster):
    cases = spark.createDataFrame([("canonical", "open", True), ("canonical", "needs_clarification", False)], "case_type string, status string, has_explicit_conflict boolean")
    runs = spark.createDataFrame([("A", "succeeded", False, AS_OF), ("B", "failed", False, AS_OF), ("feed", "succeeded", False, AS_OF)], "source_key string, status string, dry_run boolean, finished_at timestamp")
    sources = spark.createDataFrame([("A",), ("B",), ("feed",)], "source_key string")
    got = {r.metric_key: r.value for r in baseline.quality_ratios(roster, cases, runs, sources, F.lit(AS_OF), 30).collect()}
    assert got == {"freshness": 4 / 7, "completeness": 4 / 7, "conflict": 0.5, "source_coverage": 2 / 3, "review_status": 1.0}
    empty = {r.metric_key: r.value for r in baseline.quality_ratios(roster.limit(0), cases.limit(0), runs, sources.limit(0), F.lit(AS_OF), 30).collect()}
    assert set(empty.values()) == {None}


def test_coverage_leaves_the_join_to_spark(spark):
    roster = spark.createDataFrame([], "title_present boolean, source_url_present boolean, observed_at timestamp, deadline_on date, value_kind string")
    cases = spark.createDataFrame([], "status string, case_type string, has_explicit_conflict boolean")
    runs = spark.createDataFrame([("A", "succeeded", False, AS_OF)], "source_key string, status string, dry_run boolean, finished_at timestamp")
    got = baseline.quality_ratios(roster, cases, runs, runs.select("source_key"), F.lit(AS_OF), 30)
    assert "strategy=broadcast" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_amount_quartiles_and_interval(spark):
    rows = spark.createDataFrame([("m", k, Decimal(100 * k)) for k in range(1, 13)] + [("few", k, Decimal(5)) for k in range(9)], "metric string, program_id int, amount decimal(14,2)")
    q = baseline.quartiles(rows.where("metric = 'm'"), ["metric"], "amount").first()
    assert (q.q25, q.median, q.q75) == (375.0, 650.0, 925.0)
    one, two = (sorted(map(tuple, baseline.bootstrap_intervals(x, "metric", "amount", "program_id", "f|v").collect()), key=str) for x in (rows, rows.repartition(5)))
    assert one == two
    got = {r[0]: r for r in one}
    assert got["few"][5] == "too_few" and got["m.median"][3] < 650 < got["m.median"][4]


def test_large_metrics_have_intervals(spark, monkeypatch):
    import hashlib
    import random

    import numpy as np

    monkeypatch.setattr(baseline, "LEAST_OF_BLOCK", 3)
    monkeypatch.setattr(baseline, "BLOCK_DRAWS", 100_000)
    n, times = 20_010, 17
    rows = spark.range(n).selectExpr("'m' AS metric", "id AS program_id", "CAST(id * id % 9973 AS decimal(14,2)) AS amount")
    got = {r.metric_key: r for r in baseline.bootstrap_intervals(rows, "metric", "amount", "program_id", "f|v", resamples=times).collect()}
    values = np.array([float(k * k % 9973) for k in range(n)])
    for p, name in ((0.25, "Q25"), (0.5, "median"), (0.75, "Q75")):
        rng = random.Random(int(hashlib.sha256(f"f|v|m.{name}".encode()).hexdigest(), 16))
        estimates = [np.quantile(values[[rng.randrange(n) for _ in range(n)]], p) for _ in range(times)]
        r = got[f"m.{name}"]
        assert (r.n, r.estimate, r.low, r.high, r.status) == (n, np.quantile(values, p), *np.quantile(estimates, [0.025, 0.975]), "computed")


def test_draws_follow_the_generator():
    import random

    rng = random.Random(12345678901234567890)
    expected = [rng.randrange(13) for _ in range(5000)]
    assert [x for part in baseline.mersenne_draws(12345678901234567890, 13, 5000) for x in part.tolist()] == expected


def test_calendar_refuses_longer_series(spark):
    first = date(2010, 1, 4)
    edges = lambda weeks: spark.createDataFrame([(first, first + timedelta(weeks=weeks - 1))], "first date, last date")
    assert temporal.calendar(edges(520)).distinct().count() == 520
    with pytest.raises(Exception, match="cannot exceed 520 weeks"):
        temporal.calendar(edges(521)).collect()


def test_regional_control(spark):
    programs = spark.createDataFrame([(f"p{k}", "A" if k <= 4 else "B") for k in range(1, 9)], "program_id string, source_key string")
    geo = {"siberia": "1235", "central": "46", "russia": "257", "wide": "13457"}
    links = spark.createDataFrame([(f"p{k}", s) for s, ks in geo.items() for k in ks], "program_id string, slug string")
    cover = regional.coverage(programs, links).first()
    assert (cover.labelled, cover.unlabelled, cover.assignments) == (7, 1, 14)
    got = {r.slug: r for r in regional.incidence(programs, links).collect()}
    assert got["siberia"].share_of_all == 0.5 and got["siberia"].share_of_labelled == 0.571428571429
    assert got["siberia"].sample == "small_sample" and got["wide"].sample == "ok"
    themes = spark.createDataFrame([(f"p{k}", s) for s, ks in {"ai": "1246", "climate": "357"}.items() for k in ks], "program_id string, slug string")
    loo = {(r.slug, r.source_key): r.share_without for r in regional.leave_one_out(programs, themes).collect()}
    assert loo[("climate", "A")] == 0.5 and loo[("ai", "A")] == 0.25


def test_network(spark):
    links = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3), ("b", "x", 4)], "src string, dst string, program_id int")
    sources = spark.createDataFrame([("a",), ("b",), ("c",)], "src string")
    edge = network.edges(links)
    d = network.density(edge, sources).first()
    assert (d.edges, d.density, d.small_graph) == (3, 0.5, True)
    nodes = {(r.side, r.node): (r.degree, r.strength, r.centrality) for r in network.node_metrics(edge, sources).collect()}
    assert nodes[("source", "b")] == (1, 2, 0.5) and nodes[("source", "c")] == (0, 0, 0.0) and nodes[("target", "x")] == (2, 3, 2 / 3)
    comps = {r.node: r.number for r in network.components(edge, sources).collect()}
    assert comps["s:a"] == comps["s:b"] == comps["t:y"] == 1 and comps["s:c"] == 2
    assert network.density(edge.limit(0), sources.limit(0)).first().density is None


def test_long_chain_components(spark):
    from callboard.operators.graph import connected_components

    chain = spark.range(0, 300).selectExpr("id AS src", "id + 1 AS dst").orderBy(F.rand(3)).unionByName(spark.createDataFrame([(900, 900), (None, 5)], "src long, dst long"))
    got = {r.node: r.component for r in connected_components(chain).collect()}
    assert got == {k: 0 for k in range(301)} | {900: 900}


def test_weekly_control(spark):
    snaps = spark.createDataFrame([("s1", datetime(2026, 9, 1, 12)), ("s2", datetime(2026, 9, 8, 12)), ("s3", datetime(2026, 9, 29, 12)), ("s0", datetime(2026, 9, 1, 9))], "snapshot_id string, as_of timestamp")
    weeks = temporal.calendar(spark.createDataFrame([(datetime(2026, 9, 1), datetime(2026, 10, 1))], "first timestamp, last timestamp"))
    latest = temporal.weekly_latest(snaps, [])
    rows = sorted(temporal.series(weeks, latest, []).collect(), key=lambda r: r.week_start)
    assert [(str(r.week_start), r.status, r.gap_weeks) for r in rows] == [
        ("2026-08-31", "no_prior_snapshot", None), ("2026-09-07", "computed", 0), ("2026-09-14", "no_snapshot", None), ("2026-09-21", "no_snapshot", None), ("2026-09-28", "computed", 2)
    ]
    assert {r.snapshot_id: r.omitted for r in latest.collect()} == {"s1": 1, "s2": 0, "s3": 0}
    links = latest.select("week_start").withColumn("previous_week", F.lag("week_start").over(__import__("pyspark").sql.Window.orderBy("week_start")))
    members = spark.createDataFrame(
        [(date(2026, 8, 31), "a", "x"), (date(2026, 8, 31), "b", "x"), (date(2026, 9, 7), "a", "x"), (date(2026, 9, 7), "b", "x"), (date(2026, 9, 7), "c", None), (date(2026, 9, 28), "b", "y"), (date(2026, 9, 28), "c", None), (date(2026, 9, 28), "d", "x")],
        "week_start date, entity string, state string",
    )
    pairs = temporal.paired(members, links, ["state"])
    got = {str(r.week_start): (r.stock, r.newly_observed, r.removed) for r in temporal.changes(pairs, links).collect()}
    assert got == {"2026-08-31": (2, None, None), "2026-09-07": (3, 1, 0), "2026-09-28": (3, 1, 1)}
    changed = {str(r.week_start): r.state_changes for r in temporal.attribute_changes(pairs, ["state"]).collect()}
    assert changed == {"2026-09-07": 0, "2026-09-28": 1}
    assert [tuple(r)[1:] for r in temporal.state_transitions(pairs, "state").collect()] == [("x", "y", 1)]
    points = {(str(r.week_start), r.category): r.n for r in temporal.category_points(members.withColumnRenamed("state", "category").where("category is not null"), links).collect()}
    assert points[("2026-08-31", "y")] == 0 and points[("2026-09-28", "y")] == 1


def test_bi_edges(spark):
    empty = spark.createDataFrame([], "program_id int, regions array<string>, topics array<string>, funding decimal(14,2), is_active boolean, source_id string, quality_score int, launch_year int, history array<struct<year:int,funding:double>>, deadline date")
    assert bi.money_summary(empty).first().known == 0
    assert bi.support_gaps(empty).count() == 0
    assert bi.month_seasonality(empty).where("n = 0 and not is_peak").count() == 12
    assert bi.confidence(empty, bi.year_roll(empty)).first().level == "low"
    years = spark.createDataFrame([(2020, 1, 4, 100.0), (2021, 1, 8, 0.0), (2022, 1, 2, 50.0)], "year int, launched int, active int, total double")
    f = bi.forecast(years).first()
    assert (f.money_growth, f.program_growth, f.total, f.active) == (-0.5, 0.125, 25, 2)
    rows = spark.createDataFrame([(x,) for x in (-0.5, 0.5, 1.5, -1.5)], "x double")
    assert [r[0] for r in rows.select(bi.half_up(F.col("x"))).collect()] == [0, 1, 2, -1]
    ranges = spark.createDataFrame([(1, None, 100.0, 200.0), (2, 150.0, None, None), (3, None, None, None), (4, None, 500.0, None)], "id int, funding_amount double, funding_min double, funding_max double")
    pick = lambda lo, hi: [r.id for r in ranges.where(bi.amount_test(lo, hi)).collect()]
    assert pick(120, 160) == [1, 2] and pick(300, None) == [4] and pick(200, 100) == []
    today = F.lit(date(2026, 7, 1))
    cases = spark.createDataFrame([("completed", None, None, None), (None, date(2026, 6, 1), None, None), (None, date(2026, 8, 1), None, None), (None, date(2026, 5, 1), date(2026, 6, 20), date(2026, 6, 20)), (None, None, date(2026, 5, 1), date(2026, 5, 2)), (None, None, None, None)], "source_status string, open_from date, open_to date, latest_known date")
    assert [r[0] for r in cases.select(bi.display_status(today)).collect()] == ["completed", "open", "upcoming", "closed", "completed", "unknown"]


def test_catalog_rules():
    with pytest.raises(ValueError):
        catalog.CatalogQuery(deadline_from=date(2026, 2, 1), deadline_to=date(2026, 1, 1))
    with pytest.raises(ValueError):
        catalog.CatalogQuery(page_size=101)
    with pytest.raises(ValueError):
        catalog.normalized_query("  ")
    assert catalog.like_pattern("50%_x") == "%50\\%\\_x%"


def test_snapshot_writes_once(spark, roster, tmp_path):
    path = str(tmp_path / "snapshots")
    frozen = snapshots.roster_fingerprint(roster, "snapshot_id", ["program_id", "source_key", "deadline_on"])
    again = snapshots.roster_fingerprint(roster.repartition(4), "snapshot_id", ["deadline_on", "source_key", "program_id"])
    assert frozen.first().fingerprint == again.first().fingerprint
    assert snapshots.append_once(frozen, path).count() == 1
    assert snapshots.append_once(again, path).count() == 0
    assert spark.read.parquet(path).count() == 1
    assert snapshots.snapshot_uuid("a") == snapshots.snapshot_uuid("a") != snapshots.snapshot_uuid("b")


def test_metrics(spark, roster):
    sources = spark.createDataFrame([("A",), ("B",)], "source_key string")
    runs = spark.createDataFrame([("A", "succeeded", False), ("B", "failed", False)], "source_key string, status string, dry_run boolean")
    got = metrics.baseline_metrics(roster, sources, runs, F.lit(date(2026, 9, 1))).checkpoint()
    values = {r.metric_key: r.value_num for r in got.collect()}
    assert values["funding.record_share"] == 6 / 7 and values["opportunities.count"] == 7 and values["deadlines.days.median"] == 15
    assert values["source.execution_coverage.A"] == 1 and values["source.execution_coverage.B"] == 0 and values["funding.quantile.USD.range.max.Q25"] == 300
    assert metrics.inconsistent(got, got).count() == 0
    changed = got.withColumn("value_num", F.when(F.col("metric_key") == "opportunities.count", 8.0).otherwise(F.col("value_num"))).where("metric_key <> 'funding.numeric_share'")
    assert {r.metric_key for r in metrics.inconsistent(got, changed).collect()} == {"opportunities.count", "funding.numeric_share"}
    empty = {r.metric_key: (r.value_num, r.status) for r in metrics.baseline_metrics(roster.limit(0), sources, runs, F.lit(date(2026, 9, 1))).collect()}
    assert empty["funding.record_share"] == (None, "not_computed") and empty["opportunities.source.A.count"] == (0.0, "computed")
    snaps = spark.createDataFrame([("s1", "v3", "all"), ("s2", "v2", None)], "snapshot_id string, calculation_version string, source_scope string")
    rows = {r.snapshot_id: (r.reasons, r.has_network) for r in metrics.compatibility(snaps, {"calculation_version": "v3", "source_scope": "all"}).collect()}
    assert rows == {"s1": ([], True), "s2": (["calculation_version_differs", "source_scope_differs"], False)}


def test_year_roll_keeps_no_programs(spark):
    """Programs of a year are counted without holding their ids: a program's years are told apart in its row."""
    from callboard.operators import bi

    rows = spark.sql("SELECT 1 AS program_id, 2000 AS launch_year, array(named_struct('year', 2000, 'funding', 1.50BD), named_struct('year', 2000, 'funding', NULL), named_struct('year', 2001, 'funding', 2.00BD)) AS history UNION ALL SELECT 2, 2001, NULL UNION ALL SELECT 3, NULL, array(named_struct('year', 2000, 'funding', 4.00BD))")
    got = bi.year_roll(rows)
    assert sorted(map(tuple, got.collect())) == [(2000, 1, 2, 5.5), (2001, 1, 1, 2.0)]
    assert "count(distinct" not in got._jdf.queryExecution().optimizedPlan().toString()
