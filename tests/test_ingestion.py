import json
import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from callboard.functions import normalize, parse, textsearch
from callboard.operators import resolve, review
from callboard.sources import export, packages, pages
from callboard.streaming import feed


def package(records):
    return {
        "contract_version": "1", "source": {"name": "S", "canonical_url": "https://s.example/"}, "capture": {"source_url": "https://s.example/x", "received_at": "2026-01-01T00:00:00Z"},
        "adapter": {"name": "a", "version": "1"}, "records": records,
    }


def test_json_packages(spark, tmp_path):
    good = {"record_key": "k1", "title": "T", "record_url": "https://s.example/1", "deadline_on": "2026-02-01", "funding": {"value_kind": "exact", "currency_code": "USD", "exact_amount": "5.00"}, "payload": {"a": 1}, "warnings": []}
    bad = good | {"record_key": "k2", "deadline_on": "2026-02-31"}
    files = {"a": package([good, bad, good, good | {"record_key": None}]), "b": package([]), "c": package([good | {"funding": {"value_kind": "exact", "exact_amount": "-1"}}])}
    for name, body in files.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    (tmp_path / "d.json").write_text("{ not json")
    whole = json.dumps(package([good]))
    for name, body in {"e": whole + whole, "f": whole + " }", "g": f"[{whole},{whole}]", "h": json.dumps(package([good]) | {"records": {"a": 1}}), "i": json.dumps(package([good]) | {"source": {}})}.items():
        (tmp_path / f"{name}.json").write_text(body)
    (tmp_path / "j.json").write_text(json.dumps(package([17, None, good | {"funding": "free"}, good])))
    rows, rejected = packages.read_package(spark, str(tmp_path), "json")
    assert {os.path.basename(r.package): r.reason for r in rejected.collect()} == {
        "b.json": "no_records", "d.json": "invalid_json", "e.json": "invalid_json", "f.json": "invalid_json", "g.json": "invalid_envelope", "h.json": "invalid_envelope", "i.json": "invalid_envelope",
    }
    got = {(os.path.basename(r.package), r.row_number): (r.errors, r.is_duplicate) for r in rows.collect()}
    assert got == {
        ("a.json", 0): ([], False), ("a.json", 1): (["deadline_invalid"], False), ("a.json", 2): ([], True), ("a.json", 3): (["record_key_missing"], False),
        ("c.json", 0): (["funding_currency", "exact_amount_invalid"], False),
        ("j.json", 0): (["record_not_object"], False), ("j.json", 1): (["record_not_object"], False), ("j.json", 2): (["record_mistyped"], False), ("j.json", 3): ([], False),
    }
    with pytest.raises(ValueError):
        packages.read_package(spark, str(tmp_path), "xlsx")


def test_csv_packages(spark, tmp_path):
    head = list(packages.PACKAGE_COLUMNS + packages.ROW_COLUMNS)
    row = dict.fromkeys(head, "") | {"contract_version": "1", "source_canonical_url": "https://s.example/", "record_key": "k", "title": 'A ""quoted"" title', "record_url": "https://s.example/1", "payload_json": '{""a"": 1}', "warnings_json": '[""w""]'}
    line = lambda r: ",".join(f'"{r[c]}"' for c in head)
    (tmp_path / "a.csv").write_text("\n".join([",".join(head), line(row), line(row | {"record_key": "k2", "payload_json": "[1]", "warnings_json": "oops"})]) + "\n")
    more = row | {"record_key": "k3", "contract_version": "2", "exact_amount": "5", "warnings_json": "[1]"}
    turned = list(reversed(head))
    texts = {
        "b": "\ufeff" + ",".join(turned) + "\n" + "\n".join(",".join(f'"{r[c]}"' for c in turned) for r in (row, more, row)) + "\n",
        "c": ",".join(head) + "\n", "d": "\n\n", "e": ",".join([*head[:-1], "more"]) + "\n" + line(row) + "\n", "f": ",".join([*head, "more"]) + "\n" + line(row) + ",x\n",
        "g": ",".join(head) + "\n" + line(row | {"contract_version": ""}) + "\n", "h": ",".join([*head, *(f"m{k}" for k in range(9))]) + "\n" + line(row) + "\n",
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_text(text)
    rows, rejected = packages.read_csv(spark, str(tmp_path))
    assert {os.path.basename(r.package)[0]: r.reason for r in rejected.collect()} == {
        "c": "empty_package", "d": "invalid_csv_header", "e": "invalid_csv_header", "f": "invalid_csv_header", "g": "invalid_envelope", "h": "invalid_csv_header",
    }
    others = [(r.record_key, r.errors, r.is_duplicate) for r in rows.where("package like '%b.csv'").orderBy("row_number").collect()]
    assert others == [("k", [], False), ("k3", ["warnings_invalid", "funding_kind_missing", "package_metadata_mismatch"], False), ("k", [], True)]
    got = rows.where("package like '%a.csv'").orderBy("row_number").collect()
    assert [r.record_key for r in got] == ["k", "k2"] and got[0].title == 'A "quoted" title' and got[0].warnings == ["w"] and got[0].is_valid
    assert got[1].errors == ["payload_invalid", "warnings_invalid"]


def test_registry(spark):
    text = '[[sources]]\nkey = "a"\ncanonical_url = "https://a.example/"\nallowed_prefixes = ["/x"]\n[sources.limits]\nrequests = 5\n'
    assert packages.registry(spark, text).first().limits == {"requests": 5}
    for bad in (text + text, text.replace("https", "ftp"), text.replace("= 5", "= 0")):
        with pytest.raises(ValueError):
            packages.registry(spark, bad)


def test_pages_and_feeds(spark, tmp_path):
    html = '<html><head><title>A &amp; B</title><script>var x="<p>no</p>"</script></head><body><h1>Head</h1><p>One<br>two</p><a href="/n?page=2">Next</a><a href="/1">one</a><a href="/1">again</a><p>unclosed'
    raw = spark.createDataFrame([(1, "u", html), (2, "v", None), (3, "w", "<<<>&#;")], "page_id long, url string, html string")
    got = {r.page_id: r for r in pages.parsed(raw).collect()}
    assert got[1].title == "A & B" and got[1].headings == ["Head"] and "no" not in got[1].text.split() and got[1].text.split("\n")[:3] == ["Head", "One", "two"]
    assert got[2].title == "" and got[2].links == []
    assert pages.page_links(pages.parsed(raw)).count() == 2
    assert [(r.page_id, r.next_url) for r in pages.next_pages(pages.parsed(raw)).collect()] == [(1, "/n?page=2")]
    xml = '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://a/c/1</loc><lastmod>2026-01-02</lastmod></url><url><loc>https://a/c/1</loc></url><url><loc>https://a/d</loc></url></urlset>'
    (tmp_path / "m.xml").write_text(xml)
    (tmp_path / "p.html").write_text(html)
    (tmp_path / "z.zip").write_bytes(b"PK broken")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert [(r.url, r.copies) for r in pages.sitemap(files.where("path like '%.xml'"), "https://a/c/").collect()] == [("https://a/c/1", 2)]
    kinds = {os.path.basename(r.path): (r.kind, r.problem) for r in pages.artifacts(files).collect()}
    assert kinds["p.html"] == ("html", None) and kinds["z.zip"] == ("zip", "damaged")
    page = '<div data-post="chan/7"><time datetime="2026-01-02T03:04:05+00:00"></time><div class="tg message_text js">Hi<br/>there <a href="https://x.example/a">x</a></div></div><div data-post="chan/8"><time datetime="bad"></time></div>'
    rows = pages.feed_messages(spark.createDataFrame([("u", page)], "url string, html string")).orderBy("message_id").collect()
    assert [(r.channel, r.message_id, r.text, r.links) for r in rows] == [("chan", 7, "Hi\nthere x", ["https://x.example/a"]), ("chan", 8, "", [])]


def test_normal_forms(spark):
    rows = spark.createDataFrame([("HTTP://Ex.Com:80",), ("https://u:p@x/",), ("ftp://x/",), ("https://x:99999/",), ("https://X.com//a//b/?utm_source=1&b=2&a=1#f",), (None,), ("https://x?q=1",)], "u string")
    got = rows.select(normalize.normalized_url(F.col("u")), normalize.dedup_url(F.col("u"))).collect()
    assert [tuple(r) for r in got] == [
        ("http://ex.com/", "http://ex.com/"), (None, None), (None, None), (None, None), ("https://x.com//a//b/?utm_source=1&b=2&a=1", "https://x.com/a/b?a=1&b=2"), (None, None), ("https://x/?q=1", "https://x/?q=1"),
    ]
    text = spark.createDataFrame([("Ёлка — ＡＢＣ  Straße!",), ("...",), (None,)], "t string")
    assert [r[0] for r in text.select(normalize.normalized_text(F.col("t"))).collect()] == ["елка abc strasse", None, None]
    numbers = spark.createDataFrame([("1500.00",), ("0.0",), ("abc",), ("12.3400",)], "t string")
    assert [r[0] for r in numbers.select(normalize.plain_decimal(F.col("t"))).collect()] == ["1500", "0", None, "12.34"]


def test_money_and_dates(spark):
    rows = spark.createDataFrame([("до 1,5 млн рублей",), ("от 100 000 до 500 тыс. руб.",), ("грант 300 000 руб.",), ("без суммы",), ("не менее 2 миллиона рублей",)], "t string")
    got = [([float(a) for a in r[0]], r[1]) for r in rows.select(parse.amounts(F.col("t")), parse.funding_kind(F.col("t"))).collect()]
    assert got == [([1_500_000], "maximum"), ([500_000], "unknown"), ([300_000], "exact"), ([], "unknown"), ([2_000_000], "minimum")] or got[1][1] in ("range", "minimum", "maximum")
    dates = spark.createDataFrame([("с 1 марта по 15 апреля 2026 года",), ("31 февраля",), ("нет",)], "t string")
    got = dates.select(parse.word_dates(F.col("t"), F.lit(2025)), parse.period(F.col("t"), F.lit(2025))).collect()
    assert got[0][0] == [date(2025, 3, 1), date(2026, 4, 15)] and got[1][0] == [] and got[2][1].end_on is None
    labels = spark.createDataFrame([("Прием заявок",), ("Экспертиза",), ("Объявление победителей",), ("Прочее",)], "t string")
    assert [r[0] for r in labels.select(parse.timeline_kind(F.col("t"))).collect()] == ["application", "evaluation", "results", "other"]


def test_search(spark):
    rows = spark.createDataFrame([("Гранты для молодых учёных",), ("Конкурс молодежных проектов",), (None,)], "t string")
    assert [r.t for r in rows.where(textsearch.morphology_match(F.col("t"), "грантов молодой")).collect()] == ["Гранты для молодых учёных"]
    score, hit = textsearch.fuzzy(F.col("t"), "конкурсс")
    assert [r.t for r in rows.where(hit).collect()] == ["Конкурс молодежных проектов"]
    assert rows.where(textsearch.fuzzy(F.col("t"), "a b")[1]).count() == 0
    assert rows.where(textsearch.has_all(F.col("t"), "для, ГРАНТЫ")).count() == 1


def test_matching(spark):
    schema = "id int, source_id string, external_id string, url string, origin_urls array<string>, title_key string, organizer_key string, deadline_on date"
    d = date(2026, 5, 1)
    targets = spark.createDataFrame(
        [(10, "a", "e1", "u1", [], "t", "o", d), (11, "b", "e1", "u2", ["u1"], "t", "o", d), (12, "c", None, None, [], None, None, None), (13, "a", None, "u9", [], "t", "other", d)], schema
    )
    candidates = spark.createDataFrame([(1, "a", "e1", "u1", [], "t", "o", d), (2, "c", None, None, [], None, None, None)], schema)
    got = {(r.candidate_id, r.target_id): r.level for r in resolve.matches(candidates, targets).collect()}
    assert got == {(1, 10): "exact_external_id", (1, 11): "exact_origin_url"}
    seen = resolve.matches(candidates, targets).withColumns({"target_kind": F.lit("staged"), "conflicts": F.array().cast("array<string>"), "target_clean": F.lit(True), "runs_completed": F.lit(True)})
    flags = spark.createDataFrame([(1, False, False), (2, False, True)], "id int, has_error boolean, has_warning boolean")
    one = {r.id: (r.observations, r.auto_merge, r.reason_codes) for r in resolve.decisions(flags, seen.where("target_id = 10")).collect()}
    assert one == {1: (1, True, ["duplicate"]), 2: (0, False, ["quality_warning", "ready"])}
    two = {r.id: (r.observations, r.auto_merge, r.reason_codes) for r in resolve.decisions(flags, seen).collect()}
    assert two[1] == (2, False, ["cross_source_match", "multiple_candidates"])


def test_review_log(spark):
    log = spark.createDataFrame([(1, 1, "received"), (1, 2, "extracted"), (1, 3, "review"), (1, 4, "published"), (2, 1, "received"), (2, 2, "published")], "id int, at int, state string")
    assert [r.id for r in review.violations(log, "id", "at", "state", review.RECORD_MOVES).collect()] == [2]
    assert {r.id: (r.state, r.entries) for r in review.current(log, "id", ["at"]).collect()} == {1: ("published", 4), 2: ("published", 2)}
    requests = spark.createDataFrame([("x", "k1", "f1"), ("x", "k2", "f2"), ("x", "k3", "f3")], "actor string, idempotency_key string, fingerprint string")
    known = spark.createDataFrame([("x", "k1", "f1"), ("x", "k2", "other")], requests.schema)
    assert sorted(r.outcome for r in review.replayed(requests, known).collect()) == ["conflict", "replay", "run"]
    before, after = (spark.createDataFrame([(1, x)], "id int, record string") for x in ('{"a":"1","b":"2"}', '{"a":"1","b":"3","c":"4"}'))
    assert [r.path for r in review.changed_paths(before, after, "id").orderBy("path").collect()] == ["b", "c"]
    before, after = (spark.createDataFrame([(1, x)], "id int, record string") for x in ('{"a":{"x":1,"y":{"z":2}},"n":null,"l":[1],"d":5}', '{"a":{"x":1,"y":{"z":3},"w":{"v":1}},"n":null,"l":[1,2],"d":{"e":1}}'))
    assert [r.path for r in review.changed_paths(before, after, "id").orderBy("path").collect()] == ["a.w", "a.y.z", "d", "l"]
    assert [r.path for r in review.changed_paths(before, after, "id", limit=2).orderBy("path").collect()] == ["a.w", "a.y.z"]
    scalar = spark.createDataFrame([(1, "7")], "id int, record string")
    assert [r.path for r in review.changed_paths(before, scalar, "id").collect()] == ["record"] and review.changed_paths(after, after, "id").count() == 0
    log = spark.createDataFrame([(1, 1, "publish"), (1, 2, "republish"), (1, 3, "archive"), (1, 4, "republish")], "id int, at int, action string")
    assert [(r.state, r.allowed) for r in review.acted(log, "id", ["at"], "action", review.PROGRAM_ACTIONS, "draft").orderBy("at").collect()] == [("published", True), ("published", False), ("archived", True), ("published", True)]
    failures = spark.createDataFrame([("fetch_error", "HTTP 503"), ("fetch_error", "HTTP 404: connection reset"), ("validate_error", "timeout"), ("persist_error", "Connection reset by peer"), ("database_unavailable", None), ("fetch_error", None)], "code string, message string")
    assert [r[0] for r in failures.select(review.transient(F.col("code"), F.col("message"))).collect()] == [True, False, False, True, True, False]


def test_two_batches_as_one(spark, tmp_path):
    schema = "source_id string, message_id long, published_at timestamp, url string"
    rows = [("s", k % 6, datetime(2026, 1, 1 + k % 9), f"u{k % 4}") for k in range(24)]
    for n, part in enumerate((rows[:11], rows[11:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = feed.messages(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
    q = feed.seen_stream(stream, "url", "published_at", 30).writeStream.outputMode("update").format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {r.key: (r.first_seen_at, r.last_seen_at, r.seen_count) for r in spark.table("seen").orderBy("seen_count").collect()}
    batch = {r.url: (r.first_seen_at, r.last_seen_at, r.seen_count) for r in feed.seen_state(spark.createDataFrame(rows, schema), "url", "published_at").collect()}
    assert last == batch
    q = feed.once(stream).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.message_id for r in spark.table("once").collect()) == list(range(6))
    sink = feed.merge_into(str(tmp_path / "out"), "message_id")
    first, second = (spark.createDataFrame(p, schema) for p in (rows[:3], rows[:8]))
    for batch_id, df in ((0, first), (1, second), (1, second)):  # the second batch is delivered twice
        sink(df, batch_id)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
    cursors = spark.createDataFrame([("s", 3)], "source_id string, high_water long")
    assert {r.message_id for r in feed.after_cursor(spark.createDataFrame(rows, schema), cursors).collect()} == {4, 5}
    assert feed.new_cursors(spark.createDataFrame(rows[:2], schema), cursors).first().high_water == 3


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("s", "k", 1.5, 'a "b"'), ("s", "m", None, None)], "snapshot_id string, metric_key string, value_num double, status string")
    one, two = export.write_csv(df, str(tmp_path / "c")), export.write_csv(df.repartition(3), str(tmp_path / "c2"))
    assert one == two == export.write_json(df, str(tmp_path / "j"))
    body = b"".join(sorted(p.read_bytes() for p in (tmp_path / "c").glob("part*.csv")))
    assert b'"a ""b"""\r\n' in body and b'"snapshot_id"' in body
    nested = spark.createDataFrame([("s", '{"a": {"b": 1, "c": [2, "x"]}, "d": null}')], "snapshot_id string, metrics string")
    assert {(r.path, r.value) for r in export.flattened(nested).collect()} == {("a.b", "1"), ("a.c.0", "2"), ("a.c.1", "x"), ("d", None)}
    assert export.svg_bars([("a<b", 2), ("c", 1)], "T", "h").count("<rect") == 2
    snaps = spark.createDataFrame([("a", "real", True, "f", "f"), ("b", "test", True, "f", "f"), ("c", "real", True, "f", "g")], "snapshot_id string, data_class string, is_compatible boolean, stored_fingerprint string, input_fingerprint string")
    assert {r.snapshot_id: r.reason for r in export.reproducible(snaps).collect()} == {"b": "not_real", "c": "fingerprint_differs"}


def test_json_with_something_behind(spark, tmp_path):
    from callboard.sources.packages import read_foreign, whole_json

    texts = ['[1]', ' {"a": [1]} ', '17', '"x"', 'null', '[1]]', '[1]}', '[1],[2]', '[1],"x":2', '{"a":1} x', '', '[1', '[1]]}', '[1]}]']
    got = [r.v for r in spark.createDataFrame([(x,) for x in texts], "x string").select(F.to_json(whole_json("x")).alias("v")).collect()]
    assert got == ["[1]", '{"a":[1]}', "17", '"x"', "null", *[None] * 9]

    (tmp_path / "a.json").write_text('[{"source": "a.example", "collected_at": "2024", "source_url": "https://a.example/1", "title": "A"}]]')
    rows, rejected = read_foreign(spark, str(tmp_path))
    assert rows.count() == 0 and [r.reason for r in rejected.collect()] == ["invalid_json"]


def test_packages_are_read_once(spark, tmp_path):
    """What a package's rows are judged by comes from the same read: no join reads and parses all packages again."""
    from callboard.sources import packages

    for kind, scans in (("json", 1), ("csv", 2), ("foreign", 1)):  # a CSV package's header is looked for first
        folder = tmp_path / kind
        folder.mkdir()
        (folder / "p").write_text({"csv": ",".join((*packages.PACKAGE_COLUMNS, *packages.ROW_COLUMNS)) + "\n"}.get(kind, "[]"))
        rows, _ = packages.read_foreign(spark, str(folder)) if kind == "foreign" else packages.read_package(spark, str(folder), kind)
        plan = rows._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("FileScan") == scans, (kind, plan)


def test_whole_json_reads_to_the_end(spark):
    from callboard.sources.packages import whole_json

    texts = ['{"a":1}', '[1,2]', '7', '"s"', "null", "1],[2", '1},{"v":2', '1,"w":2', "1,2", "", '{"a":1}}', '{"a":1', '{"a":1}\n', "1 2"]
    got = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, t string").select("k", whole_json("t").isNotNull().alias("ok")).collect()
    assert [texts[r.k] for r in sorted(got) if r.ok] == ['{"a":1}', '[1,2]', '7', '"s"', "null", '{"a":1}\n']


def test_changed_paths_meet_once(spark):
    """Versions meet in one join and are walked side by side; a key of an object that was empty is a path."""
    before, after = (spark.createDataFrame([(1, x)], "id int, record string") for x in ('{"a":{},"c":1}', '{"a":{"x":1},"c":1}'))
    got = review.changed_paths(before, after, "id", depth=2)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert [r.path for r in got.collect()] == ["a.x"]
