import random

from pyspark.sql import functions as F

from callboard.operators import ordered


def plain(rows):
    """(id, nth, total, previous id) by a walk over sorted rows; nulls first."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    out = []
    for members in groups.values():
        members.sort(key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        out += [(r[0], k + 1, len(members), members[k - 1][0] if k else None) for k, r in enumerate(members)]
    return sorted(out)


def test_hot_keys_and_nulls(spark):
    draw = random.Random(7)
    keys = [None, "hot", "hot", "hot", "a", "b"]
    rows = [(k, draw.choice(keys), draw.choice([None, *range(50)])) for k in range(3000)] + [(3000, "one", 5)]
    df = spark.createDataFrame(rows, "id long, key string, at int").repartition(5)
    got = ordered.placed(df, ["key"], ["at", "id"], ("id",))
    assert got.columns == ["id", "key", "at", "nth", "total", "previous"]
    assert sorted((r.id, r.nth, r.total, r.previous.id if r.previous else None) for r in got.collect()) == plain(rows)


def test_a_key_spans_partitions(spark):
    df = spark.range(0, 4000, 1, 4).select(F.lit(1).alias("key"), "id")
    got = ordered.placed(df, ["key"], ["id"], ("id",))
    wrong = got.where((F.col("nth") != F.col("id") + 1) | (F.col("total") != 4000) | ~F.col("previous.id").eqNullSafe(F.when(F.col("id") > 0, F.col("id") - 1)))
    assert got.count() == 4000 and wrong.count() == 0


def test_repeated_rows_empty_tables_and_names(spark):
    rows = spark.createDataFrame([("k", 1, "x")] * 40 + [("k", 2, "y")], "key string, at int, total string")
    got = ordered.placed(rows, ["key"], ["at"], ("at",)).collect()
    assert sorted(r.nth for r in got) == list(range(1, 42)) and {r.total for r in got} == {41}
    assert [r.previous.at for r in got if r.at == 2] == [1]
    assert ordered.placed(rows.limit(0), ["key"], ["at"]).count() == 0


def test_actions_of_a_large_key(spark, monkeypatch):
    from callboard.operators import review

    monkeypatch.setattr(review, "STRETCH", 4)
    draw = random.Random(3)
    rows = [(k, draw.choice(["hot", "hot", None, "a"]), draw.choice(["publish", "archive", "republish"])) for k in range(900)]
    expected, states = {}, {}
    for k, key, action in rows:
        new = review.PROGRAM_ACTIONS.get((states.get(key, "draft"), action))
        states[key] = new or states.get(key, "draft")
        expected[k] = (new is not None, states[key])
    df = spark.createDataFrame(rows, "id long, key string, action string").repartition(3)
    got = review.acted(df, "key", ["id"], "action", review.PROGRAM_ACTIONS, "draft").collect()
    assert {r.id: (r.allowed, r.state) for r in got} == expected and len(got) == 900
