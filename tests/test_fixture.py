import json

from callboard.operators import catalog
from callboard.sources import fixture


def test_dry_run(spark, tmp_path):
    record = {"record_key": "a", "title": "A", "record_url": "https://fund.example/a"}
    package = {
        "contract_version": "1", "source": {"name": "F", "canonical_url": "https://fund.example"}, "capture": {"source_url": "https://fund.example/v1.json"}, "adapter": {"name": "x", "version": "1"},
        "records": [record, record, {"title": "no key"}],
    }
    (tmp_path / "good.json").write_text(json.dumps(package))
    (tmp_path / "bad.json").write_text("{")
    runs = []
    for _ in range(2):
        rows, report = fixture.dry_run(spark, str(tmp_path), "fund", ("https://fund.example/calls/",))
        runs.append((sorted(map(str, rows.collect())), sorted(map(str, report.collect()))))
    assert runs[0] == runs[1]
    got = {r.package.rsplit("/")[-1]: r for r in report.collect()}
    good, bad = got["good.json"], got["bad.json"]
    assert (good.resource_key, good.url, good.status, good.records, good.duplicates) == ("fund:fixture-v1", "https://fund.example/calls/v1.json", "completed", 3, 1) and good.errors >= 1
    assert (bad.status, bad.reason, bad.records) == ("failed", "invalid_json", 0) and len(bad.sha256) == 64


def test_seed(spark):
    t = fixture.seed(spark)
    assert {n: sorted(map(str, df.collect())) for n, df in t.items()} == {n: sorted(map(str, df.collect())) for n, df in fixture.seed(spark).items()}
    cat = catalog.Catalog(t["programs"], t["themes"], t["geographies"])
    q = catalog.CatalogQuery(themes=("science",), geographies=("north", "east"))
    expected = {k for k in range(48) if k % 12 != 11 and k % 5 != 4 and k % 3 in (0, 2) and (k % 3 == 0 or (k + 1) % 2 == 0)}
    assert {r.program_id for r in cat.filtered(q).collect()} == expected
    assert {r.source_key: r.programs for r in catalog.source_counts(t["sources"], t["programs"]).collect()}["source-5"] == 0
    assert {r.value_kind for r in t["programs"].select("value_kind").distinct().collect()} == {"exact", "minimum", "maximum", "range", "unknown", "not_stated"}


def test_places_in_texts(spark):
    districts = spark.createDataFrame([("СЗФО", "north-west", "Северо-Западный округ"), ("запад", "west", "Запад"), ("ямал", "yamal", "Ямал"), ("Ямало-Ненецкий", "yamal", "Ямал")], "alias string, slug string, name string")
    texts = spark.createDataFrame([(1, "В северо-западный  округ и на ЯМАЛ"), (2, "Ямало-Ненецкий, ямальский"), (3, "запада"), (4, None), (5, "Запад; СЗФО")], "id int, t string")
    got = {(r.id, r.slug, r.name) for r in catalog.tagged_geographies(texts, districts, "id", "t").collect()}
    assert got == {(1, "north-west", "Северо-Западный округ"), (1, "yamal", "Ямал"), (2, "yamal", "Ямал"), (5, "west", "Запад"), (5, "north-west", "Северо-Западный округ")}
