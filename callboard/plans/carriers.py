"""Queries that put the driver's rows into the formats that sources deliver (packages, sitemaps, feeds, archives, exports) and read
them back, each next to the SQL of the rows that must come out.

Carriers are files in the shared folder, of at most a thousand rows each; faults are planted by keys, so every rule meets rows.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callboard.operators import baseline, snapshots
from callboard.plans.bindings import Tables
from callboard.plans.records import asked
from callboard.sources import export, folders, packages, pages

BLOCK = 1000

# Import packages

#: Columns of a record, as SQL that Spark and DuckDB read alike ({k} is the order's key).
FIELDS = {
    "record_key": "CASE WHEN {k} % 17 > 0 THEN CAST(o_custkey AS VARCHAR(20)) END",
    "title": "CASE WHEN {k} % 23 = 0 THEN repeat('long.', 120) WHEN {k} % 37 = 0 THEN concat('Call, \"', {k}, '\"') WHEN o_orderstatus <> 'P' OR o_custkey % 5 > 0 THEN concat('Call ', {k}) END",
    "record_url": "concat(CASE WHEN o_orderpriority = '5-LOW' AND {k} % 3 = 0 THEN 'ftp' ELSE 'HTTPS' END, '://calls.example/', {k})",
    "deadline_on": "CASE WHEN {k} % 13 = 0 THEN '1997-02-30' WHEN {k} % 7 > 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) END",
    "value_kind": "CASE o_orderpriority WHEN '1-URGENT' THEN 'exact' WHEN '2-HIGH' THEN 'minimum' WHEN '3-MEDIUM' THEN 'maximum' WHEN '4-NOT SPECIFIED' THEN 'not_stated' ELSE 'gift' END",
    "currency_code": "CASE WHEN o_custkey % 11 = 0 THEN 'usd' WHEN o_custkey % 11 < 10 THEN 'USD' END",
    "amount": "CASE {k} % 19 WHEN 0 THEN '-5' WHEN 1 THEN 'much' ELSE CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS VARCHAR(20)) END",
    "payload": "CASE {k} % 29 WHEN 0 THEN '[1]' WHEN 1 THEN '{{\"k\":' ELSE '{{\"k\":1,\"s\":\"a,b\"}}' END",
    "warning": "CASE WHEN {k} % 31 = 0 THEN ' ' WHEN {k} % 2 = 1 THEN 'w' END",
}
AMOUNTS = {"exact_amount": "exact", "min_amount": "minimum", "max_amount": "maximum"}
FIELDS_SQL = ", ".join(f"{e.format(k='o_orderkey')} AS {n}" for n, e in FIELDS.items())


def _errors_sql(currency: str, warnings: str, **more: str) -> str:
    numeric = "value_kind IN ('exact', 'minimum', 'maximum')"
    tests = {
        **more,
        "record_key_missing": "record_key IS NULL",
        "title_missing": "title IS NULL",
        "title_too_long": "length(title) > 500",
        "record_url_not_http": "record_url LIKE 'ftp%'",
        "deadline_invalid": "deadline_on = '1997-02-30'",
        "funding_kind_unknown": "value_kind = 'gift'",
        "funding_currency": f"{numeric} AND {currency}",
        "payload_invalid": "payload = '[1]' OR payload = '{\"k\":'",
        "warnings_invalid": warnings,
        **{f"{c}_invalid": f"value_kind = '{kind}' AND amount IN ('-5', 'much')" for c, kind in AMOUNTS.items()},
    }
    cases = ", ".join(f"CASE WHEN {test} THEN '{code}' END" for code, test in tests.items())
    return f"array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), ',')"


def _finished_sql(rejected: str, errors: str, carried: str, fields: str = "*") -> str:
    """Rows of accepted packages with their errors and duplicates, and the rejected packages."""
    return f"""WITH f AS (SELECT o_orderkey // {BLOCK} AS package, o_orderkey, {FIELDS_SQL} FROM orders),
told AS (SELECT package, {rejected} AS reason FROM (SELECT DISTINCT package FROM f)),
marked AS (SELECT f.*, {errors} AS errors FROM (SELECT {fields} FROM f) f JOIN told USING (package) WHERE reason IS NULL),
placed AS (SELECT *, min(CASE WHEN errors = '' THEN o_orderkey END) OVER (PARTITION BY package, record_key) AS first FROM marked)
SELECT package, {carried}, record_key, errors, errors = '' AND o_orderkey > first AS is_duplicate FROM placed
UNION ALL SELECT package, {", ".join("NULL" for _ in carried.split(","))}, NULL, reason, false FROM told WHERE reason IS NOT NULL"""


def _records(t: Tables) -> DataFrame:
    fields = (F.expr(e.format(k="o_orderkey")).alias(n) for n, e in FIELDS.items())
    return t.orders.select(F.floor(F.col("o_orderkey") / BLOCK).alias("pkg"), "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", *fields)


def _amounts() -> list[Column]:
    return [F.when(F.col("value_kind") == kind, F.col("amount")).alias(c) for c, kind in AMOUNTS.items()]


def _written(texts: DataFrame, t: Tables, name: str) -> str:
    """Writes (pkg, text) as one file per package."""
    path = folders.fresh(t.spark, name)
    texts.select("pkg", "text").write.partitionBy("pkg").text(path)
    return path


def _number(column: str = "package") -> Column:
    return F.regexp_extract(column, r"pkg=(\d+)", 1).cast("long").alias("package")


def _told(rows: DataFrame, rejected: DataFrame, *carried: str) -> DataFrame:
    errors = F.array_join("errors", ",").alias("errors")
    got = rows.select(_number(), *carried, F.nullif(F.trim("record_key"), F.lit("")).alias("record_key"), errors, "is_duplicate")
    told = rejected.select(_number(), F.col("reason").alias("errors"), F.lit(False).alias("is_duplicate"))
    return got.unionByName(told, allowMissingColumns=True)


#: Bare numbers among the records, and funding that is no object.
BARE, FREE = "o_orderkey % 43 = 0", "o_orderkey % 47 = 0"


@asked(_finished_sql(
    "CASE package % 7 WHEN 2 THEN 'invalid_json' WHEN 3 THEN 'invalid_json' WHEN 4 THEN 'invalid_envelope' WHEN 5 THEN 'no_records' WHEN 6 THEN 'invalid_envelope' END",
    f"CASE WHEN {BARE} THEN 'record_not_object' ELSE " + _errors_sql("currency_code IS DISTINCT FROM 'USD'", "warning = ' '", record_mistyped=FREE) + " END",
    "title, deadline_on",
    "* REPLACE (" + ", ".join(f"CASE WHEN NOT {BARE} THEN {c} END AS {c}" for c in ("record_key", "title", "deadline_on")) + f", CASE WHEN NOT {FREE} THEN value_kind END AS value_kind)",
))
def package_rows_json(t: Tables) -> DataFrame:
    """Packages as JSON: some cut short or with something behind them, some lists, some without records or their source's address."""
    funding = F.struct("value_kind", "currency_code", *_amounts())
    record = F.to_json(F.struct(
        "record_key", "title", "record_url", "deadline_on", funding.alias("funding"), "payload",
        F.when(F.col("warning").isNotNull(), F.array("warning")).alias("warnings"),
    ))
    free = F.regexp_replace(record, r'"funding":\{[^}]*\}', '"funding":"free"')
    item = F.when(F.expr(BARE), "17").when(F.expr(FREE), free).otherwise(record)
    grouped = _records(t).groupBy("pkg").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", item.alias("item")))).alias("items"))
    kind = F.col("pkg") % 7
    source = F.when(kind == 6, '"source":{"name":"Calls"}').otherwise('"source":{"name":"Calls","canonical_url":"https://calls.example/"}')
    records = F.when(kind == 5, "").otherwise(F.array_join(F.transform("items", lambda x: x["item"]), ",\n"))
    body = F.concat(F.lit('{"contract_version":"1",'), source, F.lit(',"adapter":{"name":"calls","version":"1"},"records":['), records, F.lit("]}"))
    text = (
        F.when(kind == 2, F.concat("body", F.lit("\n}"))).when(kind == 3, F.expr("left(body, char_length(body) - 1)"))
        .when(kind == 4, F.concat(F.lit("["), "body", F.lit("]"))).otherwise(F.col("body"))
    )
    path = _written(grouped.withColumn("body", body).withColumn("text", text), t, "packages-json")
    rows, rejected = packages.read_package(t.spark, path, "json")
    return _told(rows, rejected, "title", "deadline_on")


ODD = f"o_orderkey % {BLOCK} = {BLOCK // 2}"


@asked(_finished_sql(
    "CASE WHEN package % 5 = 4 THEN 'invalid_csv_header' END",
    f"concat_ws(',', nullif({_errors_sql('currency_code IS NULL', "warning = ' ' OR o_orderkey % 31 IN (2, 3)")}, ''), "
    f"CASE WHEN o_orderkey % 53 = 0 AND currency_code IS NOT NULL THEN 'funding_kind_missing' END, CASE WHEN package % 5 = 2 AND ({ODD}) <> (head % {BLOCK} = {BLOCK // 2}) THEN 'package_metadata_mismatch' END)",
    "record_url, title",
    "* REPLACE (CASE WHEN o_orderkey % 53 > 0 THEN value_kind END AS value_kind), min(o_orderkey) OVER (PARTITION BY package) AS head",
))
def package_rows_csv(t: Tables) -> DataFrame:
    """Packages as CSV, some with their columns in another order or an unknown one; in some, one row says something else about the
    package than the first."""
    odd, kind = F.expr(ODD), F.col("pkg") % 5
    head = {
        "contract_version": F.lit("1"), "source_name": F.lit('Calls, "all"'), "source_canonical_url": F.lit("https://calls.example/"), "capture_source_url": F.lit("https://calls.example/list"),
        "received_at": F.lit("2024-01-01T00:00:00Z"), "external_content_uri": F.lit(None).cast("string"), "content_format": F.lit("csv"),
        "adapter_name": F.lit("calls"), "adapter_version": F.when(odd & (kind == 2), "2").otherwise("1"),
    }
    warnings = F.when(F.col("o_orderkey") % 31 == 2, "oops").when(F.col("o_orderkey") % 31 == 3, "[1]").when(F.col("warning").isNotNull(), F.to_json(F.array("warning")))
    body = {
        "record_key": F.col("record_key"), "title": F.col("title"), "record_url": F.col("record_url"), "deadline_on": F.col("deadline_on"), "funding_value_kind": F.col("value_kind"),
        "currency_code": F.col("currency_code"), **{c: a for c, a in zip(AMOUNTS, _amounts(), strict=True)}, "payload_json": F.col("payload"), "warnings_json": warnings,
    }
    known = (*packages.PACKAGE_COLUMNS, *packages.ROW_COLUMNS)
    records = _records(t).withColumn("value_kind", F.when(F.col("o_orderkey") % 53 > 0, F.col("value_kind")))
    lines = records.select("pkg", F.col("o_orderkey").alias("place"), F.array(*({**head, **body}[c] for c in known)).alias("cells"))
    names = [F.when((F.col("pkg") % 5 == 4) & F.lit(c == "title"), "name").otherwise(c) for c in known]
    lines = lines.unionByName(records.select("pkg").distinct().select("pkg", F.lit(-1).cast("long").alias("place"), F.array(*names).alias("cells")))
    cells = F.when(kind == 3, F.reverse("cells")).otherwise(F.col("cells"))
    path = folders.fresh(t.spark, "packages-csv")
    # One file per package, the header first and the rows in the order of their keys.
    placed = lines.withColumn("cells", cells).repartition("pkg").sortWithinPartitions("pkg", "place")
    placed.select("pkg", *(F.col("cells")[k].alias(f"c{k}") for k in range(len(known)))).write.partitionBy("pkg").csv(path, quote='"', escape='"')
    rows, rejected = packages.read_package(t.spark, path, "csv")
    return _told(rows, rejected, "record_url", "title")


@asked(f"""WITH f AS (SELECT o_orderkey // {BLOCK} AS package, o_orderkey % {BLOCK} AS row_number, *, o_orderkey % 41 > 0 AS is_object FROM orders),
told AS (SELECT package, CASE WHEN package % 7 = 3 THEN 'invalid_json' WHEN package % 7 IN (4, 5) OR NOT any_value_object THEN 'no_records' WHEN package % 7 = 6 THEN 'missing_metadata' END AS reason
  FROM (SELECT package, bool_or(is_object) AS any_value_object FROM f GROUP BY package))
SELECT package, row_number() OVER (PARTITION BY package ORDER BY o_orderkey) - 1 AS row_number, CASE WHEN is_object THEN 'https://calls.example/' || o_orderkey ELSE 'missing-source-url' END AS record_key,
  CASE WHEN is_object AND o_orderkey % 3 > 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS most,
  CASE WHEN is_object THEN '{{"status":"' || o_orderstatus || '"' || CASE WHEN o_custkey % 2 = 0 THEN ',"grant_fund_rub":' || (o_custkey + 1) ELSE '' END || ',"max_support_rub":' ||
    CASE WHEN o_orderkey % 3 > 0 THEN regexp_replace(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), '\\.?0+$', '') ELSE '0' END || '}}' ELSE '17' END AS payload,
  CASE WHEN is_object THEN (o_custkey % 2 = 0)::INTEGER + (o_orderkey % 10 = 0)::INTEGER ELSE 0 END AS warnings,
  CASE WHEN NOT is_object THEN 'title_missing,record_url_missing,payload_invalid' WHEN o_orderkey % 6 = 1 THEN 'title_missing' ELSE '' END AS errors FROM f JOIN told USING (package) WHERE reason IS NULL
UNION ALL SELECT package, NULL, NULL, NULL, NULL, NULL, reason FROM told WHERE reason IS NOT NULL""")
def foreign_rows(t: Tables) -> DataFrame:
    """A foreign parser's arrays: contacts and full texts in them do not come out, and items that are no objects are bad rows."""
    k = F.col("o_orderkey")
    item = F.to_json(F.struct(
        F.lit("calls.example").alias("source"), F.when(F.col("pkg") % 7 != 6, F.lit("2024-01-01")).alias("collected_at"), F.concat(F.lit("https://calls.example/"), k).alias("source_url"),
        F.when(k % 6 != 1, F.concat(F.lit("Call "), k)).alias("title"), F.col("o_orderstatus").alias("status"), F.lit("").alias("summary"), F.array().cast("array<string>").alias("sections"),
        F.when(k % 3 > 0, F.col("o_totalprice").cast("decimal(18,2)")).otherwise(F.lit(0)).alias("max_support_rub"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey") + 1).alias("grant_fund_rub"),
        F.lit("+7 000").alias("phone"), F.concat(F.lit("All of "), k).alias("full_text"), F.when(k % 10 == 0, F.array(F.lit(" unsure "), F.lit(" "))).alias("parse_warnings"),
    ))
    texts = F.array_sort(F.collect_list(F.struct(k, F.when(k % 41 > 0, item).otherwise("17").alias("item"))))
    listed = F.concat(F.lit("["), F.array_join(F.transform("items", lambda x: x["item"]), ",\n"), F.lit("]"))
    kind = F.col("pkg") % 7
    text = F.when(kind == 3, F.concat(listed, F.lit("]"))).when(kind == 4, F.lit('{"items": 1}')).when(kind == 5, F.lit("[]")).otherwise(listed)
    path = _written(_records(t).groupBy("pkg").agg(texts.alias("items")).withColumn("text", text), t, "foreign")
    rows, rejected = packages.read_foreign(t.spark, path)
    got = rows.select(
        _number(), F.col("row_number").cast("long").alias("row_number"), "record_key", F.col("funding.max_amount").alias("most"), "payload",
        F.size("warnings").alias("warnings"), F.array_join("errors", ",").alias("errors"),
    )
    return got.unionByName(rejected.select(_number(), F.col("reason").alias("errors")), allowMissingColumns=True)


# Sitemaps, feeds and files


@asked("""SELECT trim(url) AS url, CAST(max(DATE '2024-01-01' + CAST(page_id % 28 AS INTEGER)) AS VARCHAR) AS lastmod, count(*) + count(*) FILTER (page_id % 9 = 0) AS copies
FROM pages WHERE starts_with(trim(url), 'https://') GROUP BY 1""")
def sitemap_urls(t: Tables) -> DataFrame:
    """Pages' addresses in sitemaps of up to a thousand entries, every ninth named twice; those under another scheme are left out."""
    url = F.col("url")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        url = F.replace(url, F.lit(sign), F.lit(name))
    lastmod = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 28).cast("int")).cast("string")
    entry = F.concat(F.lit("<url><loc> "), url, F.lit(" </loc><lastmod>"), lastmod, F.lit("</lastmod></url>"))
    entry = F.when(F.col("page_id") % 9 == 0, F.concat(entry, entry)).otherwise(entry)
    grouped = t.pages.where("url is not null").groupBy(F.floor(F.col("page_id") / BLOCK).alias("file")).agg(F.array_join(F.collect_list(entry), "\n").alias("body"))
    head = '<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
    files = grouped.select(F.concat(F.lit(head), "body", F.lit("</urlset>")).cast("binary").alias("content"))
    return pages.sitemap(files, "https://").select("url", F.col("lastmod").cast("date").cast("string").alias("lastmod"), "copies")


@asked("""SELECT 'u' || user_id AS channel, event_id AS message_id, CASE WHEN event_type <> 'error' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS published_at,
  event_type || ' ' || event_id || chr(10) || 'see here or there' AS text, 'https://x.example/' || user_id || ',https://y.example/' || event_id AS links FROM events""")
def feed_posts(t: Tables) -> DataFrame:
    """Events as posts on pages of fifty."""
    user, post = F.col("user_id"), F.col("event_id")
    time = F.when(F.col("event_type") != "error", F.concat(F.lit('<time datetime="'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('"></time>'))).otherwise("<time></time>")
    block = F.concat(
        F.lit('<div class="message" data-post="u'), user, F.lit("/"), post, F.lit('">'), time, F.lit('<div class="post message_text rich" dir="auto">'),
        F.col("event_type"), F.lit(" <b>"), post, F.lit('</b><br/>see <a href="https://x.example/'), user, F.lit('">here</a> or <a href="https://y.example/'), post,
        F.lit('">there</a><a href="https://x.example/'), user, F.lit('"></a></div></div>'),
    )
    grouped = t.events.groupBy(F.floor(post / 50).alias("page")).agg(F.array_join(F.array_sort(F.collect_list(block)), "\n").alias("body"))
    html = grouped.select(F.concat(F.lit("https://feed.example/?page="), "page").alias("url"), F.concat(F.lit("<html><body>"), "body", F.lit("</body></html>")).alias("html"))
    got = pages.feed_messages(html)
    return got.select("channel", "message_id", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"), "text", F.array_join("links", ",").alias("links"))


def _carried(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts as the bytes of captured files: pages, documents of an office suite, and two kinds that cannot be read."""
    from html import escape

    def of(kind: int, text: str) -> bytes:
        if kind == 0:
            return f"<html><head><title>T</title></head><body><p>{escape(text)}</p><script>var a;</script></body></html>".encode()
        if kind in (1, 2):
            return (b"%PDF", b"PK")[kind - 1] + text.encode()
        body = io.BytesIO()
        with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("[Content_Types].xml", "<Types/>")
            z.writestr("word/document.xml", "<w:p>" + text.translate({ord(c): None for c in "<>"}) + "</w:p>")
        return body.getvalue()

    for pdf in parts:
        content = [of(k % 4, x or "") for k, x in zip(pdf["doc_id"], pdf["text"], strict=True)]
        yield pd.DataFrame({"path": pdf["doc_id"].astype(str), "length": [len(c) for c in content], "content": content})


#: Python's white space, as a class of DuckDB's expressions.
SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@asked(f"""WITH d AS (SELECT doc_id, doc_id % 4 AS k, coalesce(text, '') AS text FROM documents),
x AS (SELECT doc_id, k, trim(regexp_replace(CASE k WHEN 0 THEN 'T ' || text WHEN 3 THEN regexp_replace(text, '[<>]', '', 'g') ELSE '' END, '{SPACE}', ' ', 'g')) AS plain FROM d)
SELECT CAST(doc_id AS VARCHAR) AS path, CASE k WHEN 0 THEN 'html' WHEN 1 THEN 'pdf' WHEN 2 THEN 'zip' ELSE 'office' END AS kind, CASE k WHEN 0 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS n_entries,
  CASE WHEN k IN (0, 3) AND plain <> '' THEN md5(left(plain, 4000)) END AS excerpt_md5, CASE k WHEN 2 THEN 'damaged' END AS problem FROM x""")
def artifact_kinds(t: Tables) -> DataFrame:
    files = t.documents.select("doc_id", "text").mapInPandas(_carried, "path string, length long, content binary")
    return pages.artifacts(files).select("path", "kind", "n_entries", F.md5("excerpt").alias("excerpt_md5"), "problem")


# Stores that take each thing once


@asked("""SELECT sha256(html) AS sha256, octet_length(encode(any_value(html))) AS n_bytes, CASE WHEN bool_or(page_id % 3 > 0) THEN 1 ELSE 2 END AS delivery FROM pages WHERE html IS NOT NULL GROUP BY 1""")
def capture_archive(t: Tables) -> DataFrame:
    """Two thirds of the pages are archived, then all: each body is taken once."""
    path = folders.fresh(t.spark, "archive")
    captures = t.pages.where("html is not null").select("page_id", F.col("html").cast("binary").alias("content"))
    first = packages.archive(captures.where("page_id % 3 > 0").select("content"), path).withColumn("delivery", F.lit(1))
    return first.unionByName(packages.archive(captures.select("content"), path).withColumn("delivery", F.lit(2)))


@asked("""WITH m AS (SELECT DISTINCT CAST(date_trunc('week', ts) AS DATE) AS week_start, user_id FROM events)
SELECT CAST(week_start AS VARCHAR) AS week_start, count(*) AS programs, CASE WHEN day(week_start) % 2 = 0 THEN 1 ELSE 2 END AS delivery FROM m GROUP BY week_start""")
def persisted_snapshots(t: Tables) -> DataFrame:
    """Weekly rosters: those of even days are persisted, then all again, their rows in another order."""
    path = folders.fresh(t.spark, "snapshots")
    members = t.members()

    def delivered(rows: DataFrame, n: int) -> DataFrame:
        printed = snapshots.roster_fingerprint(rows, "week_start", ["week_start", "entity", "level", "entries"])
        return snapshots.append_once(printed, path).select(F.col("week_start").cast("date").cast("string").alias("week_start"), "programs", F.lit(n).alias("delivery"))

    first = delivered(members.where(F.dayofmonth("week_start") % 2 == 0), 1)
    return first.unionByName(delivered(members.repartition("entity"), 2))


_CELLS = {"value": "n", "unit": "'orders'", "period": "y", "formula": "'count(\"\"o_orderkey\"\"), by year'"}


@asked(f"""WITH m AS (SELECT 'orders.' || o_orderpriority || '.' || year(o_orderdate) AS metric_key, CAST(count(*) AS VARCHAR) AS n, CAST(year(o_orderdate) AS VARCHAR) AS y FROM orders GROUP BY o_orderpriority, year(o_orderdate))
SELECT '{",".join(f'"{c}"' for c in export.CSV_COLUMNS)}' AS line UNION ALL
SELECT concat_ws(',', {", ".join(f"'\"' || {_CELLS.get(c, 'metric_key' if c == 'metric_key' else chr(39) * 2)} || '\"'" for c in export.CSV_COLUMNS)}) FROM m""")
def export_lines(t: Tables) -> DataFrame:
    """Lines of an export as CSV: every cell quoted, those without a value too, and lines that end in CRLF."""
    year = F.year("o_orderdate")
    counts = t.orders.groupBy("o_orderpriority", year.alias("period")).agg(F.count(F.lit(1)).alias("value"))
    metrics = counts.select(F.concat_ws(".", F.lit("orders"), "o_orderpriority", "period").alias("metric_key"), "value", "period")
    path = folders.fresh(t.spark, "export")
    export.write_csv(export.metric_rows(metrics, {"unit": "orders", "formula": 'count("o_orderkey"), by year'}), path)
    # Each file of the export opens with the header.
    return t.spark.read.text(path, lineSep="\r\n").select(F.col("value").alias("line")).distinct()


@asked("SELECT l_orderkey AS program_id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def repeated_programs(t: Tables) -> DataFrame:
    return baseline.repeated_programs(t.lineitem.select(F.col("l_orderkey").alias("program_id")))
