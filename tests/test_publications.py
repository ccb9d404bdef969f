from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from callboard.functions import labels, schedule
from callboard.operators import publications


def test_groups_and_folding(spark):
    pubs = spark.createDataFrame([("p1",), ("p2",), ("p3",), ("p4",)], "publication_id string")
    links = spark.createDataFrame([("p2", "p3"), ("p3", "p4")], "src string, dst string")
    assert {r.publication_id: r.group_id for r in publications.groups(pubs, links).collect()} == {"p1": "p1", "p2": "p2", "p3": "p2", "p4": "p2"}
    rows = spark.createDataFrame(
        [("g", "b", datetime(2026, 2, 1), "launch", "Second", 20, ["u2", "u1"], date(2026, 3, 1)), ("g", "a", datetime(2026, 1, 1), "opportunity", "First", 10, ["u1"], None), ("g", "c", datetime(2026, 4, 1), "result", "Third", 99, ["u3"], None)],
        "group_id string, publication_id string, published_at timestamp, kind string, title string, funding int, urls array<string>, end_on date",
    )
    r = publications.folded(rows.orderBy(F.rand(1))).first()
    assert (r.title, r.funding, r.urls, r.evidence, r.end_on) == ("First", 20, ["u1", "u2", "u3"], "completed", date(2026, 3, 1))


def test_inventories(spark):
    records = spark.createDataFrame([("k1", "A", date(2026, 1, 1)), ("k2", "B", None)], "url_key string, title string, end_on date")
    portal = spark.createDataFrame([("k1", "A", date(2026, 1, 5)), ("k9", "Z", None)], records.schema)
    got = {r.url_key: (r.end_on, r.warning) for r in publications.enriched(records, portal).collect()}
    assert got == {"k1": (date(2026, 1, 5), "deadline_differs"), "k2": (None, None), "k9": (None, "portal_only")}
    files = spark.createDataFrame([("u1", "h")], "url string, sha256 string")
    parents = spark.createDataFrame([(1, ["u1", "u2", "u3"])], "record_id int, artifact_urls array<string>")
    assert {r.url: r.status for r in publications.attached(parents, files, 2).collect()} == {"u1": "captured", "u2": "deferred", "u3": "reference_only"}
    links = spark.createDataFrame([("k", "http://a/", "x"), ("k", "https://a/", "y"), ("k", "https://a/", "x")], "key string, url string, context string")
    r = publications.link_inventory(links).first()
    assert (r.url, r.contexts, r.mentions) == ("https://a/", ["x", "y"], 3)


def test_windows(spark):
    d = date
    events = spark.createDataFrame(
        [(1, "application", d(2026, 1, 1), d(2026, 2, 1)), (1, "application", d(2026, 1, 1), d(2026, 2, 1)), (2, "application", d(2026, 1, 1), d(2026, 2, 1)), (2, "application", d(2026, 3, 1), d(2026, 4, 1)),
         (3, "application", d(2026, 1, 1), d(2026, 2, 1)), (3, "application", d(2026, 1, 15), d(2026, 3, 1)), (4, "review", d(2026, 1, 1), d(2026, 2, 1))],
        "record_id int, kind string, start_on date, end_on date",
    )
    got = {r.record_id: (r.end_on, r.outcome) for r in publications.application_window(events).collect()}
    assert got == {1: (d(2026, 2, 1), "single"), 2: (d(2026, 4, 1), "multiple_cycles"), 3: (None, "conflict")}
    rows = spark.createDataFrame([(1, "g", True), (1, "g", False), (1, "h", False)], "program_id int, group_key string, leads_to_winners boolean")
    assert sorted((r.group_key, r.is_result) for r in publications.propagated(rows).collect()) == [("g", True), ("g", True), ("h", False)]
    geo = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "program_id int, slug string")
    alias = spark.createDataFrame([("a", "Old", "subject", 1), ("a", "New", "district", 2), ("b", "Land", "country", 1)], "slug string, name string, kind string, position int")
    assert {r.kind: r.names for r in publications.grouped_geographies(geo, alias).collect()} == {"district": ["New"], "country": ["Land"], "other": ["c"]}


def test_schedule(spark):
    times = spark.createDataFrame([(datetime(2026, 3, 2, 6, 30),), (datetime(2026, 3, 1, 6, 30),), (datetime(2026, 3, 3, 6, 31),)], "at timestamp")  # Monday, Sunday, Tuesday
    hits = lambda e: [r[0] for r in times.select(schedule.due(e, F.col("at"))).collect()]
    assert hits("30 6 * * 1-5") == [True, False, False]
    assert hits("*/15 6 1 * 2") == [False, True, False]
    assert hits("30-31 * * 3 0,7") == [False, True, False]
    for bad in ("* * * *", "60 * * * *", "5-1 * * * *", "*/0 * * * *"):
        with pytest.raises(ValueError):
            schedule.due(bad, F.col("at"))


def test_labels(spark):
    rows = spark.createDataFrame([("«Мой  конкурс»",), ("Грант «А» и «Б»",), ("Премия 2026 год",), ("Отбор (2025/26)",)], "t string")
    assert [r[0] for r in rows.select(labels.clean_title(F.col("t"))).collect()] == ["Мой конкурс", "Грант «А» и «Б»", "Премия", "Отбор"]
    texts = spark.createDataFrame([("пишите a.b@c.ru",), ("+7 (912) 345-67-89",), ("Победители 2026",)], "t string")
    assert [r[0] for r in texts.select(labels.has_contact(F.col("t"))).collect()] == [True, True, False]
    assert [r[0] for r in texts.select(labels.resource_kind(F.col("t"), F.lit("https://x/a.pdf?v=1"))).collect()] == ["document", "document", "winners"]
    money = spark.createDataFrame([("range", "RUB", None, Decimal("1000"), Decimal("2500000.50")), ("not_stated", None, None, None, None), (None, None, None, None, None)], "value_kind string, currency_code string, exact_amount decimal(14,2), min_amount decimal(14,2), max_amount decimal(14,2)")
    assert [r[0] for r in money.select(labels.funding_label()).collect()] == ["1 000 RUB – 2 500 000.50 RUB", "not stated", "no record"]


def test_identities_kept_apart(spark):
    """A publication that links to two identities joins neither; one that links to another identity joins both."""
    rows = [(1, "a", "launch"), (2, "b", "launch"), (3, "c", "launch"), (4, None, "result"), (5, None, "result"), (6, "a", "launch"), (7, "d", "launch"), (8, None, "launch"), (9, "e", "ignore")]
    links = [(4, 1), (5, 1), (5, 2), (6, 3), (7, 1), (7, 2), (8, 99), (9, 2)]
    df = spark.createDataFrame(rows, "publication_id long, identity string, kind string")
    got = {r.publication_id: (r.group_id, tuple(r.warnings)) for r in publications.identity_groups(df, spark.createDataFrame(links, "publication_id long, target_id long")).collect()}
    ambiguous, override, missing = "related_publication_ambiguous", "related_publication_identity_override", "publication_identity_missing"
    assert got == {
        1: ("a", ()), 2: ("b", ()), 3: ("a", ()), 4: ("a", ()), 5: (None, (ambiguous, missing)), 6: ("a", (override,)), 7: ("d", (ambiguous,)), 8: (None, (missing,)), 9: (None, (override,)),
    }


def test_names_matched(spark):
    portal = spark.createDataFrame([(1, "Старт-1 2026"), (2, "Старт-Мед-1"), (3, "УМНИК (очередь 2)"), (4, "Развитие"), (5, "Развитие 2025"), (6, "Никто"), (7, None), (8, "2026")], "portal_id int, name string")
    groups = spark.createDataFrame([(10, "«Старт 1»"), (10, "Start one"), (20, "Старт-Медизделия-1"), (30, "УМНИК, очередь № 1"), (31, "УМНИК очередь 2"), (40, "развитие"), (50, "2026")], "group_id int, name string")
    got = {(r.portal_id, r.group_id): r.outcome for r in publications.matched_names(portal, groups).collect()}
    assert got == {(1, 10): "matched", (2, 20): "matched", (3, 31): "matched", (4, 40): "ambiguous", (5, 40): "ambiguous"}


def test_names_against_all_pairs(spark):
    import random

    rng = random.Random(3)
    words = [f"w{k}" for k in range(14)]
    sides = [[(k, " ".join(rng.sample(words, rng.randrange(1, 6)))) for k in range(60)] for _ in range(2)]
    portal, groups = (spark.createDataFrame(s, f"{key} int, name string") for s, key in zip(sides, ("portal_id", "group_id"), strict=True))
    for least in (0.5, 0.75):
        alike = {(p, g): len(a & b) / len(a | b) for p, x in sides[0] for g, y in sides[1] for a, b in [(set(x.split()), set(y.split()))] if len(a & b) / len(a | b) >= least}
        p_best, g_best = ({k: max(s for pair, s in alike.items() if pair[side] == k) for k in {pair[side] for pair in alike}} for side in (0, 1))
        expected = {}
        for (p, g), s in alike.items():
            if s == p_best[p] == g_best[g]:
                ties = sum(x == s and a == p for (a, _), x in alike.items()), sum(x == s and b == g for (_, b), x in alike.items())
                expected[p, g] = "matched" if ties == (1, 1) else "ambiguous"
        assert {(r.portal_id, r.group_id): r.outcome for r in publications.matched_names(portal, groups, least).collect()} == expected


def test_names_send_nothing_to_the_driver(spark):
    """Names grow with both sides, so no join of theirs may be a broadcast."""
    portal, groups = (spark.range(40).selectExpr(f"id AS {key}", "concat('start n', id div 2, ' k', id) AS name") for key in ("portal_id", "group_id"))
    tables = "spark.sql.maxBroadcastTableSize"
    spark.conf.set(tables, "1b")
    try:
        assert publications.matched_names(portal, groups, 0.75).count() == 40
    finally:
        spark.conf.unset(tables)
