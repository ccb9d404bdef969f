"""Steps that must not gather more in a task as the input grows."""

import json
import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from callboard.functions import parse
from callboard.operators import baseline, catalog, drafts, resolve
from callboard.plans import records  # noqa: F401  registers queries of its own
from callboard.plans.queries import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_links_are_not_shuffled_by_their_names(spark):
    districts = spark.createDataFrame([("Приволжский округ", "volga", "Приволжский"), ("volga", "volga", "Приволжский")], "alias string, slug string, name string")
    links = spark.range(400).selectExpr("id AS program_id", "if(id % 4 = 0, 'volga-federal-district', 'city') AS slug", "CASE id % 4 WHEN 0 THEN 'x' WHEN 1 THEN 'приволжский  ОКРУГ' WHEN 2 THEN 'City' END AS name")
    got = catalog.canonical_geographies(links, districts)
    assert "SortMergeJoin" not in plan(got) and "ShuffledHashJoin" not in plan(got)
    rows = {r.program_id: (r.slug, r.name) for r in got.collect()}
    assert len(rows) == 400 and [rows[k] for k in range(4)] == [("volga", "Приволжский")] * 2 + [("city", "City"), ("city", None)]


def best_match(c, t):
    """The level and conflicts of two records by comparing them, or None."""
    same = lambda f: c[f] is not None and c[f] == t[f]
    across = c["source_id"] is not None and t["source_id"] is not None and c["source_id"] != t["source_id"]
    urls = [{u for u in (*(x["origin_urls"] or ()), x["url"]) if u is not None} for x in (c, t)]
    told = {u for x in (c, t) for u in x["origin_urls"] or ()}
    levels = (same("source_id") and same("external_id"), same("source_id") and same("url"), across and bool(urls[0] & urls[1] & told), all(map(same, resolve.FIELDS)))
    conflicts = [f for f in resolve.FIELDS if None not in (c[f], t[f]) and c[f] != t[f]]
    return next(((rank, conflicts) for rank, holds in enumerate(levels) if holds), None)


def test_pairs_are_told_once_and_not_gathered(spark, monkeypatch):
    monkeypatch.setattr(resolve, "CANDIDATES_OF_PART", 3)
    rng = random.Random(5)
    one = lambda *xs: rng.choice([*xs, None])
    schema = "id int, source_id string, external_id string, url string, origin_urls array<string>, title_key string, organizer_key string, deadline_on date"
    some = lambda: (one("a", "b"), one("1", "2", "3", "4"), one("u", "v", "w"), one([], ["u"], ["v", "u", None, "u"], ["w", "x"]), one("t", "s"), one("o"), one(date(2024, 1, 1), date(2024, 1, 2)))
    rows = [(k, *some()) for k in range(120)]
    records = spark.createDataFrame(rows, schema)
    got = resolve.matches(records.where("id % 3 = 0"), records)
    assert "key=[c_id" not in plan(got) and "keys=[c_id" not in plan(got)
    pairs = [((r.candidate_id, r.target_id), (r.level_rank, r.conflicts)) for r in got.collect()]
    dicts = [dict(zip(records.columns, r, strict=True)) for r in rows]
    expected = {(c["id"], t["id"]): best_match(c, t) for c in dicts for t in dicts if c["id"] % 3 == 0 and c["id"] != t["id"]}
    assert len(pairs) == len(dict(pairs)) and dict(pairs) == {k: v for k, v in expected.items() if v is not None}
    assert {rank for _, (rank, _) in pairs} == {0, 1, 2, 3}


@pytest.mark.parametrize("n", (10, 11, 700, 40_000))
@pytest.mark.parametrize("deviations", (6.0, 0.01))
def test_resampled_quantiles_are_those_of_whole_resamples(monkeypatch, n, deviations):
    monkeypatch.setattr(baseline, "DEVIATIONS", deviations)
    times, values = 12, np.random.default_rng(n).integers(0, n // 3, n) / 7.0
    drawn = np.concatenate(list(baseline.mersenne_draws(77, n, n * times))).reshape(times, n)
    for p in baseline.QUARTILES:
        got = baseline.resampled_quantiles(lambda: baseline.twister(77), values, p, times)
        assert got.tolist() == np.quantile(values[drawn], p, axis=1).tolist()


def test_preview_reads_a_record_once_and_tells_what_build_holds(spark):
    url = "https://example.org/"
    records = (
        {"title": "One", "record_url": url, "payload": {"themes": [{"slug": "b"}, None, {"slug": "a", "name": "A"}, {"slug": "a", "name": "B"}, {"name": "x"}]}},
        {"title": "Two", "record_url": url, "payload": {"summary": "По всей России", "application": {"url": "HTTPS://example.org"}, "resources": [{"title": "Rules", "url": url}, {"title": "Menu", "url": url + "m"}, None, {"url": url + "n"}]}},
        {"title": "Three", "record_url": url, "payload": {"geographies": [{"slug": "north"}], "timeline": [None, {"label": "x"}], "sections": [{"content": "Text"}, {"heading": "Menu", "content": "Text"}, {"heading": "x", "content": " "}, None, {"content": "a@b.org"}]}},
        {"title": "Four", "record_url": url},
        {"title": " ", "record_url": url, "payload": {"timeline": [{"label": "x"}]}},
    )
    rows = [(k, "completed", json.dumps(r, ensure_ascii=False)) for k, r in enumerate(records)] + [(8, "completed", "no record"), (9, "failed", json.dumps(records[0]))]
    candidates = spark.createDataFrame(rows, "candidate_id int, run_status string, record string").selectExpr("candidate_id", "7 AS source_id", "run_status", "record")
    got = drafts.preview(candidates)
    assert plan(got).count("from_json") == 1 and "Join" not in plan(got)
    seen = {r.candidate_id: r for r in got.collect()}
    assert {k: r.problem for k, r in seen.items()} == {0: None, 1: None, 2: None, 3: None, 4: "no_title", 8: "no_title", 9: "run_not_completed"}
    assert {k: (r.themes, r.geographies, r.timeline, r.resources, r.sections) for k, r in seen.items() if r.problem is None} == {
        0: (["a", "b"], [], 0, 0, 0), 1: ([], ["russia"], 0, 2, 0), 2: ([], ["north"], 2, 0, 1), 3: (None, None, 0, 0, 0),
    }
    tables = {name: [r.asDict() for r in df.collect()] for name, df in drafts.build(candidates).items()}
    for program in tables["programs"]:
        assert {c: seen[program["candidate_id"]][c] for c in program if c != "source_id"} == {c: v for c, v in program.items() if c != "source_id"}
    for name in ("timeline", "resources", "sections"):
        assert {k: r[name] for k, r in seen.items()} == {k: sum(x["candidate_id"] == k for x in tables[name]) for k in seen}
    assert sorted((x["candidate_id"], x["dimension"], x["slug"], x["name"]) for x in tables["taxonomy"]) == [
        (0, "themes", "a", "A"), (0, "themes", "a", "B"), (0, "themes", "b", "b"), (1, "geographies", "russia", "Россия"), (2, "geographies", "north", "north"),
    ]


def test_schedules_compile_no_pattern_for_each_row(spark, sf, monkeypatch):
    """split() compiles a pattern of several characters whenever it is called; a text is built once, before it is read."""
    patterns, split = [], F.split
    monkeypatch.setattr(F, "split", lambda text, pattern, *limit: patterns.append(pattern) or split(text, pattern, *limit))
    read = parse.schedule_events(F.col("t"), F.lit(2020))
    assert patterns and all(len(p) == 1 for p in patterns)
    steps = plan(QUERIES["schedule_events"](spark, sf))
    (generate,) = [x for x in steps.splitlines() if "Generate explode" in x]
    assert "o_orderdate" not in generate and "RoundRobinPartitioning" in steps

    texts = {
        "2 этап ----- Приём 5 мая 2024; Экспертиза: 6-8 мая 2024": [("Приём", None, "2024-05-05", "Приём 5 мая 2024"), ("Экспертиза", "2024-05-06", "2024-05-08", "Экспертиза: 6-8 мая 2024")],
        "(ПРИЁМ: с 1 по 3 МАЯ; iv волна: Оценка до 7 июня 2023 ;\u2028 приём с 1 мая 2023 по 3 мая;": [
            ("ПРИЁМ", "2020-05-01", "2020-05-03", "ПРИЁМ: с 1 по 3 МАЯ"), ("iv волна — Оценка", None, "2023-06-07", "iv волна: Оценка до 7 июня 2023 ;\u2028"), ("iv волна — приём", "2023-05-01", "2023-05-03", "приём с 1 мая 2023 по 3 мая"),
        ],
        "Приём: 1 мая; приём: 1 мая; Оценка 31 июня": [("Приём", None, "2020-05-01", "Приём: 1 мая"), ("Оценка", None, "None", "Оценка 31 июня")],
    }
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", read.alias("e")).collect()
    assert {r.t: [(e.label, e.start_on and str(e.start_on), str(e.end_on), e.evidence) for e in r.e] for r in rows} == texts
