"""Table functions, dictionaries, pagers, streams with offsets and state, JSON trees and JDBC."""

import json
import random
import re
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from callboard.functions import dictionary, jsontree
from callboard.operators import pager
from callboard.plans.texts import QUERY  # noqa: F401
from callboard.sources import jdbc, tables
from callboard.streaming import source, urlstate

PAGE = """<html><head><title>T</title></head><body><p>lead <a href=/x>x</a></p><h1>One &amp; all</h1>text<h3>Deep</h3><p>a<b>b</b></p>
<ul><li><a href=" /1 ">first</a></li><li><a href="/2">second <i>b</i></a></li></ul><h2>Two</h2><script>no</script>
<dl><dt>Label:</dt><dd>value <b>v</b></dd><dt>No</dt></dl><table><tr><th>Sum</th><td>5</td></tr><tr><td>alone</td></tr></table></body></html>"""


def test_dialects(spark):
    tables.register(spark)
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id int, html string")
    df.createOrReplaceTempView("captured")
    got = [tuple(r)[1:] for r in tables.rows(df, "sections").orderBy("page_id", "position").collect()]
    assert got == [(0, 0, "", "", "lead x", 1), (1, 1, "", "One & all", "text", 0), (2, 3, "One & all", "Deep", "ab first second b", 2), (3, 2, "One & all", "Two", "Label: value v No Sum 5 alone", 0)]
    got = [tuple(r) for r in spark.sql("SELECT r.* FROM captured c, LATERAL page_rows(c.html, 'cards') r ORDER BY position").collect()]
    assert got == [(0, "/1", "first", "Deep"), (1, "/2", "second b", "Deep")]
    assert [tuple(r)[1:] for r in tables.rows(df, "fields").orderBy("position").collect()] == [(0, "Label", "value v", "Two"), (1, "Sum", "5", "Two")]
    with pytest.raises(Exception, match="dialect must be one of"):
        tables.rows(df, "other").count()


def test_sections_and_cards_of_whole_pages(spark, sf):
    """Against patterns over the same pages without comments and scripts."""
    pages = {r.page_id: re.sub(r"<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>", "", r.html, flags=re.S | re.I) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = tables.rows(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "sections").collect()
    heads = Counter(r.page_id for r in rows if r.depth > 0)
    links = Counter()
    for r in rows:
        links[r.page_id] += r.links
    for k, page in pages.items():
        assert heads[k] == len(re.findall(r"<h[1-6]\b", page, re.I)), k
        assert links[k] == sum(m.strip("\"'") != "" for m in re.findall(r"<a\b[^>]*?\bhref\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)[^>]*>", page, re.I | re.S)), k


def test_list_entries(spark):
    rows = [("l", 2, 0, "/b"), ("l", 1, 1, "/b"), ("l", 1, 0, "/a"), ("l", 2, 1, "/c"), ("l", 3, 0, None), ("m", 1, 0, "/a")]
    got = tables.listed(spark.createDataFrame(rows, "list string, page int, position int, href string")).orderBy("list", "place").collect()
    assert [tuple(r) for r in got] == [("l", 0, 1, "/a", 1), ("l", 1, 1, "/b", 2), ("l", 2, 2, "/c", 1), ("m", 0, 1, "/a", 1)]


NAMES = [("Северная Осетия", "north-ossetia"), ("Осетия", "ossetia"), ("северная", "north"), ("ямал", "yamal"), ("Ямал", "yanao"), ("Ханты-Мансийский округ", "hmao"), ("округ", "district"), ("!!", "none"), (None, "none")]


def brute_mentions(text, only_longest):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    found = []
    for name in {" ".join(re.findall(r"[^\W_]+", (n or "").lower())) for n, _ in NAMES} - {""}:
        n = name.split()
        found += [(k, len(n), name) for k in range(len(words) - len(n) + 1) if words[k : k + len(n)] == n]
    if only_longest:
        out, free = [], 0
        for k, n, name in sorted(found, key=lambda x: (x[0], -x[1])):
            if k >= free:
                out.append((k, n, name))
                free = k + n
        found = out
    return sorted((k, n, tag) for k, n, name in found for given, tag in NAMES if given and " ".join(re.findall(r"[^\W_]+", given.lower())) == name)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
@pytest.mark.parametrize("only_longest", [True, False])
def test_dictionary_against_rules(spark, block_bytes, only_longest):
    rng = random.Random(1)
    parts = ["Северная", "Осетия", "северная осетия", "ЯМАЛ", "ямальский", "ханты мансийский", "округ", "и", "-", "Ханты-Мансийский  округ"]
    texts = [None, "", "..."] + [" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = dictionary.mentions(df, spark.createDataFrame(NAMES, "name string, tag string"), "k", "t", only_longest, block_bytes).collect()
    for k, text in enumerate(texts):
        assert sorted((r.place, r.words, r.tag) for r in got if r.k == k) == brute_mentions(text, only_longest), text


def test_pager(spark):
    step = {"a": "b", "b": "c", "c": "d", "d": "b", "e": "e", "f": "gone", "g": None, "x": "y", "y": "x", **{f"n{k}": f"n{k + 1}" for k in range(40)}, "n40": None}
    pages = spark.createDataFrame(list(step.items()), "url string, next_url string")
    starts = spark.createDataFrame([(s,) for s in ("a", "e", "f", "g", "n0", "absent", "a")], "start string")
    reached = pager.walked(pages, starts)
    got = {(r.start, r.page): r.place for r in reached.collect()}
    assert got == {("a", "a"): 0, ("a", "b"): 1, ("a", "c"): 2, ("a", "d"): 3, ("e", "e"): 0, ("f", "f"): 0, ("g", "g"): 0, **{("n0", f"n{k}"): k for k in range(41)}}
    assert {tuple(r) for r in pager.lists(pages, reached).collect()} == {("a", 4, "d", 3, "loop"), ("e", 1, "e", 1, "loop"), ("f", 1, "f", 0, "next_page_missing"), ("g", 1, "g", 0, None), ("n0", 41, "n40", 0, None)}
    assert {r.url for r in pager.unreached(pages, reached).collect()} == {"x", "y"}


def _messages(folder, name, ids):
    folder.mkdir(parents=True, exist_ok=True)
    lines = [json.dumps({"message_id": i, "published_at": "2026-01-02T03:04:05", "text": f"m{i}"}) for i in ids]
    (folder / f"{ids[0]}-{ids[-1]}.jsonl").write_text("\n".join(lines) + "\n")


def test_messages_once_across_restarts(spark, tmp_path):
    spark.dataSource.register(source.Messages)
    feed, out, check = tmp_path / "feed", str(tmp_path / "out"), str(tmp_path / "check")
    _messages(feed / "one", "one", [1, 2, 5])
    _messages(feed / "two", "two", [10, 11])

    def run(at, out=out):
        rows = spark.readStream.format("captured_messages").option("path", str(feed)).option("per_batch", 10).load()
        query = rows.writeStream.format("parquet").option("checkpointLocation", at).option("path", out).trigger(availableNow=True).start()
        query.awaitTermination()
        source.finished(query, str(feed))

    run(check)
    assert json.loads((feed / source.CURSORS).read_text()) == {"one": 5, "two": 11}
    _messages(feed / "one", "one", [6, 9])
    _messages(feed / "three", "three", [1])
    run(check)  # the query's own offsets
    _messages(feed / "two", "two", [20, 30])
    run(str(tmp_path / "other"), str(tmp_path / "more"))  # a new query goes on from the cursors
    got = sorted((r.source_id, r.message_id) for r in spark.read.parquet(out, str(tmp_path / "more")).collect())
    assert got == [("one", 1), ("one", 2), ("one", 5), ("one", 6), ("one", 9), ("three", 1), ("two", 10), ("two", 11), ("two", 20), ("two", 30)]
    assert json.loads((feed / source.CURSORS).read_text()) == {"one": 9, "two": 30, "three": 1}


def test_url_states(spark, tmp_path):
    day = lambda d: datetime(2026, 1, 1) + timedelta(days=d)
    batches = [
        [("/a", day(0), "r1"), ("/b", day(1), None), ("/a", day(2), None), (None, day(2), "x")],
        [("/a", day(1), "r0"), ("/c", day(20), "c"), ("/b", day(2), "rb")],  # late, yet within the delay
        [("/d", day(60), "d"), ("/c", day(25), "c2")],
        [("/a", day(61), "back"), ("/e", day(62), None)],
    ]
    schema, feed = "url string, at timestamp, route string", tmp_path / "feed"
    key = "spark.sql.streaming.stateStore.providerClass"
    with pytest.raises(ValueError, match="providerClass"):
        urlstate.url_states(spark.createDataFrame([], schema))
    spark.conf.set(key, urlstate.PROVIDER)
    try:
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(feed / f"{k}"))
            stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(feed))
            states = urlstate.url_states(stream, 30, "40 days")
            states.writeStream.foreachBatch(lambda df, n: df.withColumn("n", F.lit(n)).write.mode("append").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "check")).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(key)
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("n", "is_expired").collect()
    last = {}
    for r in rows:
        if not r.is_expired:
            last[r.url] = (r.first_seen_at, r.last_seen_at, r.seen_count, r.route, r.expires_at)
    batch = urlstate.batch_states(spark.createDataFrame([r for b in batches for r in b], schema), 30)
    expected = {r.url: (r.first_seen_at, r.last_seen_at, r.seen_count, r.route, r.expires_at) for r in batch.collect()}
    assert set(last) == {"/a", "/b", "/c", "/d", "/e"} and {u: last[u] for u in "/b /c /d /e".split()} == {u: expected[u] for u in "/b /c /d /e".split()}
    assert expected["/a"] == (day(61), day(61), 1, "back", day(91)) and expected["/b"][3] == "rb"


def test_json_trees(spark):
    deep = "[" * 200 + "1" + "]" * 200
    rows = [(0, '{"b": [1, {"z": null, "a": "é\\u0041"}], "a": {}}'), (1, '{"a": {}, "b": [1, {"a": "éA", "z": null}]}'), (2, "{"), (3, None), (4, deep), (5, "[" * 100_000), (6, "NaN"), (7, '"x"'), (8, '{"x.y": true, "": 1.50}')]
    df = spark.createDataFrame(rows, "k int, j string")
    forms = {r.k: r.c for r in df.select("k", jsontree.canonical("j").alias("c")).collect()}
    assert forms[0] == forms[1] == '{"a":{},"b":[1,{"a":"éA","z":null}]}' and forms[4] == deep and forms[7] == '"x"' and [forms[k] for k in (2, 3, 5, 6)] == [None] * 4
    assert df.where("k < 2").select(jsontree.fingerprint(F.col("j"))).distinct().count() == 1
    got = [tuple(r) for r in jsontree.leaves(df, "k", "j").collect()]
    assert [r[1:3] for r in got if r[0] == 0] == [("b.0", "1"), ("b.1.z", None), ("b.1.a", "éA"), ("a", "{}")]
    assert [r[1:] for r in got if r[0] == 4] == [(".".join("0" * 200), "1", None)]
    assert {r[0]: r[3] for r in got if r[3]} == {2: "invalid_json", 3: "missing", 5: "too_deep", 6: "invalid_json"}
    assert [r[1:3] for r in got if r[0] == 8] == [("x.y", "true"), ("", "1.5")]


def test_jdbc_round_trip(spark, sf, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db"
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(14,2)").alias("o_totalprice"))
    jdbc._run(spark, f"{url};create=true", "CREATE TABLE orders (o_orderkey BIGINT PRIMARY KEY, o_orderstatus VARCHAR(4), o_totalprice DECIMAL(14,2))")
    for _ in range(2):  # the second write changes nothing
        jdbc.write(orders, url, "orders", ("o_orderkey",))
    jdbc.write(orders.where("o_orderkey < 100").withColumn("o_orderstatus", F.lit("X")), url, "orders", ("o_orderkey",))
    back = jdbc.read(spark, url, "orders", "O_ORDERKEY", 4)
    assert back.rdd.getNumPartitions() == 4
    cheap = back.where("O_TOTALPRICE < 5000 AND O_ORDERSTATUS <> 'X'").select("O_ORDERKEY")
    plan = cheap._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(O_TOTALPRICE), *IsNotNull(O_ORDERSTATUS), *LessThan(O_TOTALPRICE" in plan and "ReadSchema: struct<O_ORDERKEY:bigint>" in plan
    expected = orders.withColumn("o_orderstatus", F.when(F.col("o_orderkey") < 100, "X").otherwise(F.col("o_orderstatus")))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, expected.collect()))
    assert jdbc.read(spark, url, "(SELECT * FROM orders WHERE o_orderkey < 0) AS few", "O_ORDERKEY").count() == 0
