"""Import packages in JSON and CSV, kept row by row: a bad envelope rejects a package, a bad row
stays as an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FUNDING = "struct<value_kind:string,currency_code:string,exact_amount:string,min_amount:string,max_amount:string>"
RECORD = f"struct<record_key:string,title:string,record_url:string,deadline_on:string,funding:{FUNDING},payload:string,warnings:array<string>>"
ADAPTER = "struct<name:string,version:string>"
#: The columns of a CSV package; the first nine describe the package.
PACKAGE_COLUMNS = (
    "contract_version", "source_name", "source_canonical_url", "capture_source_url", "received_at", "external_content_uri", "content_format", "adapter_name", "adapter_version",
)
ROW_COLUMNS = (
    "record_key", "title", "record_url", "deadline_on", "funding_value_kind", "currency_code", "exact_amount", "min_amount", "max_amount", "payload_json", "warnings_json",
)
LIMITS = {"record_key": 512, "title": 500, "record_url": 2048}


def whole_json(text: Column | str) -> Column:
    """A text as a variant; null unless all of it is one JSON value.  The built-in parsers leave unread what follows the
    first value, so the text is read inside an array and inside an object: what closes one of them early breaks the other.
    Only one of the two is built."""
    text = F.col(text) if isinstance(text, str) else text
    beside = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1, F.try_variant_get(beside, "$.v", "variant"))


def is_object(v: Column | str) -> Column:
    """Whether a variant is an object; unlike its schema, this does not walk what the object holds."""
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def bound(df: DataFrame, **columns: Column) -> DataFrame:
    """With columns that are worked out once a row.  They go through a generator, so that no later projection or filter
    puts their expression (a parse, say) in the place of each use of theirs."""
    return df.select("*", F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("_bound")).select(*(c for c in df.columns if c not in columns), *(F.col(f"_bound.{n}") for n in columns))


def row_errors() -> Column:
    """Why a row (record_key, title, record_url, deadline_on, funding) is bad: an array of codes."""
    tests = [(f"{c}_missing", F.coalesce(F.trim(c), F.lit("")) == "") for c in ("record_key", "title", "record_url")]
    tests += [(f"{c}_too_long", F.char_length(c) > n) for c, n in LIMITS.items()]
    tests += [
        ("record_url_not_http", F.col("record_url").isNotNull() & ~F.lower("record_url").rlike("^https?://")),
        ("deadline_invalid", F.col("deadline_on").isNotNull() & F.col("deadline_on").try_cast("date").isNull()),
        ("funding_kind_unknown", F.col("funding.value_kind").isNotNull() & ~F.col("funding.value_kind").isin("exact", "minimum", "maximum", "range", "unknown", "not_stated")),
        ("funding_currency", F.col("funding.value_kind").isin("exact", "minimum", "maximum", "range") & ~F.coalesce(F.col("funding.currency_code").rlike("^[A-Z]{3}$"), F.lit(False))),
    ]
    tests += [
        ("payload_invalid", F.col("payload").isNotNull() & ~is_object(whole_json("payload"))),
        ("warnings_invalid", F.exists(F.coalesce("warnings", F.array(F.lit("-"))), lambda w: F.coalesce(F.trim(w), F.lit("")) == "")),
    ]
    for c in ("exact_amount", "min_amount", "max_amount"):
        tests.append((f"{c}_invalid", F.col(f"funding.{c}").isNotNull() & F.coalesce(F.col(f"funding.{c}").try_cast("decimal(14,2)") <= 0, F.lit(True))))
    return F.array_compact(F.array(*(F.when(test, F.lit(code)) for code, test in tests)))


def _finished(rows: DataFrame) -> DataFrame:
    """With ``errors``, ``is_valid`` and ``is_duplicate``; what a reader could not read as a record (``malformed``) or
    found wrong itself (``issues``) stays as a bad row."""
    errors = row_errors()
    if "malformed" in rows.columns:
        alone = F.array("malformed")
        errors = F.when(F.col("malformed") == "record_not_object", alone).when(F.col("malformed").isNotNull(), F.concat(alone, errors)).otherwise(errors)
    if "issues" in rows.columns:
        errors = F.concat(errors, "issues")
    marked = bound(rows, errors=errors).withColumn("is_valid", F.size("errors") == 0).drop("malformed", "issues")
    # One task has read the whole package, so its rows of one key may meet in one; a join would read all packages again.
    first = F.min(F.when(F.col("is_valid"), F.col("row_number"))).over(Window.partitionBy("package", "record_key"))
    return marked.withColumn("is_duplicate", F.coalesce(F.col("is_valid") & (F.col("row_number") > first), F.lit(False)))


def read_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected packages) of JSON packages, one per file, each one JSON object and nothing behind it.

    A record that is no object, or has a field of a wrong kind, is a bad row of its package.
    """
    raw = bound(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("package"), "value"), v=whole_json("value")).drop("value")
    text = lambda p: F.nullif(F.trim(F.try_variant_get("v", p, "string")), F.lit(""))
    raw = bound(raw, records=F.try_variant_get("v", "$.records", "variant"))
    raw = bound(raw, n_records=F.size(F.try_variant_get("records", "$", "array<variant>")))
    reason = (
        F.when(F.col("v").isNull(), "invalid_json")
        .when(~is_object("v"), "invalid_envelope")
        .when(F.col("records").isNull() | F.is_variant_null("records") | (F.col("n_records") == 0), "no_records")
        .when(F.col("n_records").isNull() | text("$.source.canonical_url").isNull() | text("$.contract_version").isNull(), "invalid_envelope")
    )
    told = bound(raw, reason=reason)
    good = told.where("reason is null").select("package", text("$.source.canonical_url").alias("source_url"), F.try_variant_get("v", "$.adapter", ADAPTER).alias("adapter"), "records")
    items = good.lateralJoin(spark.tvf.variant_explode(F.col("records").outer())).select("package", "source_url", "adapter", F.col("pos").alias("row_number"), F.col("value").alias("x"))
    options = {"columnNameOfCorruptRecord": "_unread"}
    items = bound(items, x=F.to_json("x"))
    rows = bound(items, r=F.when(F.col("x").startswith("{"), F.from_json("x", RECORD[:-1] + ",_unread:string>", options)))
    malformed = F.when(F.col("r").isNull(), "record_not_object").when(F.col("r._unread").isNotNull(), "record_mistyped")
    rows = rows.select("package", "source_url", "adapter", "row_number", "r.*", malformed.alias("malformed")).drop("_unread")
    return _finished(rows), told.where("reason is not null").select("package", "reason")


def read_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected packages) of CSV packages, their columns in any order.

    A package is rejected if its header lacks a column or has another one, if it has no rows, or if its first row
    names no source or version; a file of no bytes is not seen.  A row that describes the package unlike the first one is a bad row.
    """
    known = (*PACKAGE_COLUMNS, *ROW_COLUMNS)
    # A few cells more than there are columns: a header that fills them holds a column that is not known.
    cells = [f"c{k}" for k in range(len(known) + 4)]
    read = spark.read.schema(", ".join(f"{c} string" for c in cells))
    raw = read.csv(path, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    # A file of many lines is read by one task, so numbers follow its rows.
    raw = raw.select(F.col("_metadata.file_path").alias("package"), F.monotonically_increasing_id().alias("row_number"), F.array(*cells).alias("cells"))
    top = raw.withColumn("nth", F.row_number().over(Window.partitionBy("package").orderBy("row_number"))).where("nth <= 2")
    nth = lambda n: F.when(F.col("nth") == n, F.col("cells"))
    heads = top.groupBy("package").agg(F.min("row_number").alias("head"), F.max(nth(1)).alias("names"), F.max(nth(2)).alias("second"), F.count(F.lit(1)).alias("lines"))
    names = F.array_compact(F.transform("names", lambda c: F.translate(c, "\ufeff", "")))
    heads = heads.withColumn("names", names).withColumn("is_known", F.array_sort("names") == F.array(*map(F.lit, sorted(known))))
    # Where each column is: found once a package, not in every row.
    heads = bound(heads, places=F.array(*(F.array_position("names", c).cast("int") for c in known)))
    cell = lambda cells, c: F.get(cells, F.get("places", F.lit(known.index(c))) - 1).alias(c)
    told = heads.withColumn("first", F.when(F.col("is_known"), F.struct(*(cell(F.col("second"), c) for c in PACKAGE_COLUMNS))))
    unnamed = F.col("first.source_canonical_url").isNull() | F.col("first.contract_version").isNull()
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("package"))
    reason = F.when(~F.coalesce("is_known", F.lit(False)), "invalid_csv_header").when(F.col("lines") < 2, "empty_package").when(unnamed, "invalid_envelope")
    rejected = files.join(told, "package", "left").select("package", reason.alias("reason")).where("reason is not null")

    # Not by broadcast: there is a head for every package.
    good = told.where(F.col("is_known") & (F.col("lines") > 1) & ~unnamed).select("package", "head", "places", "first")
    rows = raw.join(good.hint("merge"), "package").where(F.col("row_number") > F.col("head"))
    rows = bound(rows, row=F.struct(*(cell(F.col("cells"), c) for c in known))).select("package", "row_number", "first", "row.*")
    differs = F.exists(F.array(*(~F.col(c).eqNullSafe(F.col(f"first.{c}")) for c in PACKAGE_COLUMNS)), lambda x: x)
    stated = F.coalesce("currency_code", "exact_amount", "min_amount", "max_amount").isNotNull()
    issues = F.array_compact(F.array(
        F.when(F.col("funding_value_kind").isNull() & stated, F.lit("funding_kind_missing")), F.when(differs, F.lit("package_metadata_mismatch")),
    ))
    funding = F.when(F.col("funding_value_kind").isNotNull(), F.struct(F.col("funding_value_kind").alias("value_kind"), F.upper("currency_code").alias("currency_code"), "exact_amount", "min_amount", "max_amount"))
    rows = bound(rows, listed=whole_json("warnings_json"))
    listed = F.col("listed")
    texts = F.when((F.schema_of_variant(listed) == "ARRAY<STRING>") | (F.to_json(listed) == "[]"), F.try_variant_get(listed, "$", "array<string>"))
    rows = rows.select(
        "package", F.col("first.source_canonical_url").alias("source_url"), F.struct(F.col("first.adapter_name").alias("name"), F.col("first.adapter_version").alias("version")).alias("adapter"), "row_number",
        "record_key", "title", "record_url", "deadline_on", funding.alias("funding"), F.col("payload_json").alias("payload"),
        # Text that is no list of texts becomes a list of one blank, which the checks reject.
        F.when(F.col("warnings_json").isNotNull(), F.coalesce(texts, F.array(F.lit("")))).alias("warnings"), issues.alias("issues"),
    )
    return _finished(rows), rejected


def read_package(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, DataFrame]:
    readers = {"json": read_json, "csv": read_csv}
    if kind not in readers:
        raise ValueError(f"no reader for {kind!r}; there are {sorted(readers)}")
    return readers[kind](spark, path)


#: The fields of a foreign parser's records that may go into a payload; contacts and full text are not among them.
FOREIGN_PAYLOAD = (
    "status", "publication_date", "application_start_date", "application_end_date", "organizer", "summary", "goals", "tasks", "target_audience", "requirements",
    "nominations", "project_directions", "procedure", "grant_fund_rub", "max_support_rub", "funding_text", "application_url", "result_urls", "document_urls", "sections",
)


def read_foreign(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected files) of a foreign parser's output, one JSON array a file, as package rows.

    The first record that is an object names the source and when it was collected.  A record's url is
    its key; its largest support is a maximum in roubles, while a total fund stays in the payload
    with a warning.  A record that is no object is a bad row.
    """
    files = bound(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("package"), "value"), v=whole_json("value")).drop("value")
    text = lambda field, x="x": F.nullif(F.trim(F.try_variant_get(x, f"$.{field}", "string")), F.lit(""))
    files = bound(files, first=F.get(F.filter(F.try_variant_get("v", "$", "array<variant>"), is_object), F.lit(0)))
    reason = F.when(F.col("v").isNull(), "invalid_json").when(F.col("first").isNull(), "no_records").when(text("source", "first").isNull() | text("collected_at", "first").isNull(), "missing_metadata")
    told = bound(files, reason=reason)
    good = told.where("reason is null").select("package", F.concat(F.lit("https://"), text("source", "first")).alias("source_url"), "v")
    good = good.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("package", "source_url", F.col("pos").alias("row_number"), F.col("value").alias("x"))
    good = bound(good, is_object=is_object("x"))

    def kept(field: str) -> Column:
        value = F.try_variant_get("x", f"$.{field}", "variant")
        plain = F.to_json(value)
        return F.when(value.isNotNull() & ~plain.isin("null", '""', "[]", "{}"), value)

    most, fund = (F.try_variant_get("x", f"$.{f}", "decimal(18,2)") for f in ("max_support_rub", "grant_fund_rub"))
    none = F.lit(None).cast("string")
    funding = F.when(most > 0, F.struct(F.lit("maximum").alias("value_kind"), F.lit("RUB").alias("currency_code"), none.alias("exact_amount"), none.alias("min_amount"), most.cast("string").alias("max_amount")))
    warned = F.filter(F.transform(F.coalesce(F.try_variant_get("x", "$.parse_warnings", "array<string>"), F.array().cast("array<string>")), lambda w: F.trim(w)), lambda w: w != "")
    warnings = F.concat(warned, F.when(fund > 0, F.array(F.lit("grant_fund_rub is the whole fund, not a program's funding"))).otherwise(F.array().cast("array<string>")))
    rows = good.select(
        "package", "source_url", F.struct(F.lit("foreign-json").alias("name"), F.lit("1").alias("version")).alias("adapter"), "row_number", F.coalesce(text("source_url"), F.lit("missing-source-url")).alias("record_key"),
        F.try_variant_get("x", "$.title", "string").alias("title"), text("source_url").alias("record_url"), text("application_end_date").alias("deadline_on"), funding.alias("funding"),
        F.when(F.col("is_object"), F.to_json(F.struct(*(kept(f).alias(f) for f in FOREIGN_PAYLOAD)))).otherwise(F.to_json("x")).alias("payload"), warnings.alias("warnings"),
    )
    return _finished(rows), told.select("package", "reason").where("reason is not null")


def allowed_fields(raw: DataFrame, fields: dict[str, str]) -> DataFrame:
    """A projection to an allow-list (name -> expression); all else, contacts included, is dropped."""
    return raw.select(*(F.expr(e).alias(n) for n, e in fields.items()))


def registry(spark: SparkSession, text: str) -> DataFrame:
    """The source registry from TOML: one row per source, checked."""
    import tomllib

    rows = []
    for s in tomllib.loads(text).get("sources", []):
        limits = s.get("limits", {})
        if not s.get("key") or not str(s.get("canonical_url", "")).startswith(("http://", "https://")):
            raise ValueError(f"a source needs a key and an http(s) canonical_url: {s}")
        if any(int(v) <= 0 for v in limits.values()):
            raise ValueError(f"limits of {s['key']} must be positive")
        rows.append((s["key"], s["canonical_url"], s.get("access_method", "html"), s.get("status", "active"), s.get("schedule"), list(s.get("allowed_prefixes", [])), {k: int(v) for k, v in limits.items()}))
    if len({r[0] for r in rows}) < len(rows):
        raise ValueError("source keys must be distinct")
    return spark.createDataFrame(rows, "source_key string, canonical_url string, access_method string, status string, schedule string, allowed_prefixes array<string>, limits map<string,int>")


def archive(captures: DataFrame, path: str) -> DataFrame:
    """Writes raw captures that the archive lacks, once per SHA-256, in folders of its first two
    digits; returns what was new.  One writer at a time."""
    from callboard.operators.snapshots import append_once

    keyed = captures.withColumn("sha256", F.sha2("content", 256)).withColumn("head", F.substring("sha256", 1, 2))
    return append_once(keyed, path, "sha256", ("head",)).select("sha256", F.octet_length("content").alias("n_bytes"))


COMPETITIONS = "array<struct<id: string, title: string, status: string, url: string, end_on: string>>"


def competitions(responses: DataFrame, base_url: str, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(records, errors) of a public list as JSON: one record per entry with an id and a title, urls
    made absolute; bodies that are no list, and entries without either, are errors."""
    rows = responses.select("source_url", F.from_json(body, COMPETITIONS).alias("items"))
    entries = rows.where("items is not null").select("source_url", F.posexplode("items").alias("position", "x")).select("source_url", "position", "x.*")
    good = (F.coalesce(F.trim("id"), F.lit("")) != "") & (F.coalesce(F.trim("title"), F.lit("")) != "")
    url = F.when(F.col("url").rlike("^https?://"), F.col("url")).when(F.col("url").startswith("/"), F.concat(F.lit(base_url.rstrip("/")), F.col("url")))
    records = entries.where(good).select("source_url", "position", F.trim("id").alias("record_key"), F.trim("title").alias("title"), "status", url.alias("record_url"), F.col("end_on").try_cast("date").alias("deadline_on"))
    errors = rows.where("items is null").select("source_url", F.lit(None).cast("int").alias("position"), F.lit("not_a_list").alias("reason"))
    return records, errors.unionByName(entries.where(~good).select("source_url", "position", F.lit("no_id_or_title").alias("reason")))
