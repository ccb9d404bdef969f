"""Queries that SQL cannot express, against plain versions written another way."""

import html
import re
import unicodedata
import uuid
from collections import Counter

from pyspark.sql import functions as F

from callboard.functions import labels, normalize, parse
from callboard.operators import review, snapshots
from callboard.plans.queries import QUERIES
from callboard.sources import packages

NAMES = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)[^>]*>", re.I | re.S)


def visible(page):
    """A page without comments and without what its scripts and styles hold."""
    page = re.sub(r"<!--.*?-->", "", page, flags=re.S)
    return re.sub(r"<(script|style|noscript|template)\b.*?</\1\s*>", "", page, flags=re.I | re.S)


def links(page):
    return [html.unescape(m.strip("\"'")).strip() for m in NAMES.findall(visible(page)) if m.strip("\"'")]


def test_unicode_normal_form(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["text_normalize_unicode"](spark, sf).collect():
        plain = unicodedata.normalize("NFKC", texts[r.doc_id]).casefold().replace("ё", "е")
        plain = " ".join(re.sub(r"[\W]+", " ", "".join(c if unicodedata.category(c)[0] in "LN" or c == "_" else " " for c in plain)).split())
        assert r.folded_chars == (len(plain) or None), r.doc_id


def test_page_titles_and_links(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["html_title_links"](spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        found = re.search(r"<title[^>]*>(.*?)</title>", visible(pages[r.page_id]), re.I | re.S)
        assert r.title == " ".join(html.unescape(found[1]).split()) if found else r.title == ""
        assert r.links == len(links(pages[r.page_id])), r.page_id


def test_page_link_counts(spark, sf):
    counts = Counter(h for r in spark.read.parquet(f"{sf}/pages.parquet").collect() for h in set(links(r.html)))
    assert {r.href: r.pages for r in QUERIES["page_link_counts"](spark, sf).collect()} == counts


def test_ids(spark):
    df = spark.createDataFrame([("a",), ("é 漢",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(normalize.uuid5(F.col("t"))).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, t)) for t in ("a", "é 漢", "")] + [None]
    assert got[0] == snapshots.snapshot_uuid("a")


def test_archive_takes_a_capture_once(spark, tmp_path):
    captures = spark.createDataFrame([(bytearray(b"x"),), (bytearray(b"x"),), (bytearray(b"y"),)], "content binary")
    path = str(tmp_path / "archive")
    assert packages.archive(captures, path).count() == 2 and packages.archive(captures, path).count() == 0
    assert spark.read.parquet(path).count() == 2


def test_schedules_and_funds(spark):
    rows = [
        ("Сроки. 1 этап: приём заявок до 5 мая 2026; 2 этап: Экспертиза с 1 июня по 10 июня 2026. Реализация проектов", "Общий фонд", "Всего 3 млн руб."),
        (None, None, None), ("Приём заявок", "О конкурсе", "Грант 5 руб. Грантовый фонд 7 руб. Грантовый фонд 7 руб."),
    ]
    df = spark.createDataFrame(rows, "t string, h string, f string")
    got = df.select(parse.schedule_events(F.col("t"), F.lit(2020)).alias("e"), parse.total_fund(F.array(F.struct(F.col("h").alias("heading"), F.col("f").alias("text")))).alias("f")).collect()
    assert [(e.kind, str(e.start_on), str(e.end_on)) for e in got[0].e] == [("application", "None", "2026-05-05"), ("evaluation", "2026-06-01", "2026-06-10")]
    assert got[1].e == [] and got[2].e == []
    assert [(r.f.kind, r.f.amount and int(r.f.amount), r.f.outcome) for r in got] == [("exact", 3_000_000, "ok"), ("not_stated", None, "ok"), ("exact", 7, "ok")]


def test_labels(spark):
    df = spark.createDataFrame([("«A»",), ("открыта программа на  «A» — ",), (None,)], "t string")
    assert [r[0] for r in df.select(labels.bare_title(F.col("t"))).collect()] == ["«A»", "«A»", None]


def test_append_only(spark):
    before = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id int, x string")
    after = spark.createDataFrame([(1, "a"), (3, "d"), (4, "e")], before.schema)
    assert {(r.id, r.problem) for r in review.overwritten(before, after, "id").collect()} == {(2, "removed"), (3, "changed")}


def test_foreign_packages(spark, tmp_path):
    import json

    records = [
        {"source": "fund.example", "collected_at": "2026-01-02", "title": "A", "source_url": " https://fund.example/a ", "application_end_date": "2026-02-01", "max_support_rub": 500000.5, "grant_fund_rub": 9, "summary": "", "status": "open", "contacts": "me@x.y", "full_text": "t", "goals": [], "parse_warnings": [" w ", "", 5]},
        {"title": "B", "source_url": "https://fund.example/a"}, "no object", {"title": "C"},
    ]
    (tmp_path / "a.json").write_text(json.dumps(records))
    (tmp_path / "b.json").write_text("{")
    (tmp_path / "c.json").write_text("[]")
    (tmp_path / "d.json").write_text(json.dumps([{"title": "x"}]))
    rows, rejected = packages.read_foreign(spark, str(tmp_path))
    got = {r.row_number: r for r in rows.collect()}
    assert set(got) == {0, 1, 2, 3} and got[0].is_valid and got[0].source_url == "https://fund.example"
    assert json.loads(got[0].payload) == {"status": "open", "application_end_date": "2026-02-01", "grant_fund_rub": 9, "max_support_rub": 500000.5}
    assert got[0].funding.max_amount == "500000.50" and got[0].funding.value_kind == "maximum" and got[0].warnings[0] == "w" and len(got[0].warnings) >= 2
    assert got[1].is_duplicate and not got[2].is_valid and "record_url_missing" in got[3].errors
    assert {r.package.rsplit("/")[-1]: r.reason for r in rejected.collect()} == {"b.json": "invalid_json", "c.json": "no_records", "d.json": "missing_metadata"}


def test_cycles_and_bad_dates(spark):
    text = "2 цикл: Приём заявок до 5 мая 2024; Экспертиза с 1 июня по 10 июня 2024; Подведение итогов 45 мая 2024; III цикл Приём заявок до 7 июля 2024; Реализация"
    (row,) = spark.createDataFrame([(text,)], "t string").select(parse.schedule_events(F.col("t"), F.lit(2020)).alias("e")).collect()
    assert [(e.label, str(e.end_on), e.date_error) for e in row.e] == [
        ("2 цикл — Приём заявок", "2024-05-05", False), ("2 цикл — Экспертиза", "2024-06-10", False), ("2 цикл — Подведение итогов", "None", True), ("III цикл — Приём заявок", "2024-07-07", False),
    ]


def test_public_sections_and_results(spark):
    cases = [
        ("results", "Победители конкурса", "текст", True), ("results", "Объявление победителей", "текст", False), ("results", "Итоги года", "текст", False), ("results", "Итоги программы", "текст", True),
        ("criteria", "Поделиться ссылкой", "текст", False), ("criteria", "Положение.PDF", "текст", False), ("criteria", "Критерии", "файл pdf", False), ("criteria", "Критерии", "файл pdfs", True),
        ("criteria", " ", "текст", False), ("criteria", "Критерии", None, False), ("contacts", "Критерии", "текст", False), (None, "Критерии", "текст", False),
    ]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, category string, heading string, content string, shown boolean")
    got = df.select("k", "shown", labels.is_public_section(F.col("category"), F.col("heading"), F.col("content")).alias("got")).collect()
    assert [r.k for r in got if r.shown != r.got] == []
    groups = spark.createDataFrame([("II  цикл",), ("2024 – 2025",), ("2024/2025 годы",), ("цикл",), (None,)], "t string").select(labels.winner_group(F.col("t"))).collect()
    assert [r[0] for r in groups] == ["ii цикл", "2024 – 2025", None, None, None]


def test_access_and_scope(spark):
    cases = [
        ("Участие по приглашению фонда", "invitation_only", False), ("Открыт для всех, по всей  России", "open", True), ("любой организации", "open", False), ("Открыто", "unknown", False),
        ("российских НКО", "unknown", True), ("Российской Федерации", "unknown", True), ("российский рубль", "unknown", False), ("во всех регионах России", "unknown", True), (None, "unknown", False),
    ]
    df = spark.createDataFrame(cases, "t string, mode string, wide boolean")
    assert [r.t for r in df.where((labels.access_mode(F.col("t")) != F.col("mode")) | (labels.country_scope(F.col("t")) != F.col("wide"))).collect()] == []


def test_titles(spark):
    cases = {"Запуск конкурса «Старт»": "«Старт»", "Продление программы на Развитие —": "Развитие", "Конкурс «A»": "Конкурс «A»", "Открыт приём заявок на «A»": "«A»", "Запуск открытия": "открытия"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.x for r in df.select("t", labels.bare_title(F.col("t")).alias("x")).collect()} == cases


def test_actions_of_one_busy_key(spark):
    import random

    rng = random.Random(8)
    rows = [(k, i, rng.choice(["publish", "archive", "republish", "view"])) for k, n in ((1, 1500), (2, 3), (None, 700)) for i in range(n)]
    got = {(r.k, r.i): (r.state, r.allowed) for r in review.acted(spark.createDataFrame(rows, "k int, i int, a string"), "k", ["i"], "a", review.PROGRAM_ACTIONS, "draft").collect()}
    state = {}
    for k, i, a in rows:
        now = state.get(k, "draft")
        new = review.PROGRAM_ACTIONS.get((now, a))
        state[k] = new or now
        assert got[k, i] == (state[k], new is not None), (k, i)
    assert len(got) == len(rows)


def test_guarded_append(spark, tmp_path):
    import pytest

    path = str(tmp_path / "log")
    spark.createDataFrame([(1, "a"), (2, None)], "id int, x string").write.parquet(path)
    review.guarded_append(spark.createDataFrame([(2, None), (3, "c"), (3, "c")], "id int, x string"), path, "id")
    with pytest.raises(ValueError, match=r"would change: \['1'\]"):
        review.guarded_append(spark.createDataFrame([(1, "b"), (4, "d")], "id int, x string"), path, "id")
    assert sorted((r.id, r.x) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, None), (3, "c")]


def test_names_in_a_languages_order(spark):
    from callboard.operators import bi

    names = ["яблоко", "Ёж", "ель", "Жук", "еж", "ЁЛКА", "апельсин"]
    got = [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(*bi.by_name("n")).collect()]
    assert got == ["апельсин", "еж", "Ёж", "ЁЛКА", "ель", "Жук", "яблоко"]


def test_amounts_and_dates_are_read_once(spark):
    """An expression that is used several times is bound, not written out at each use."""
    fund = str(parse.total_fund(F.array(F.struct(F.lit("h").alias("heading"), F.col("t").alias("text")))))
    assert fund.count("regexp_extract_all") == 3
    assert str(parse.period(F.col("t"), F.lit(2020))).count("regexp_replace") == 1
