import numpy as np
import pytest

from callboard.operators.quantiles import quantiles


@pytest.mark.parametrize("buckets", [1, 3, 4096])
def test_same_as_numpy(spark, buckets):
    rng = np.random.default_rng(7)
    groups = {"a": rng.lognormal(3, 2, 500).round(2), "b": np.array([5.0]), "c": np.repeat([1.0, 2.0], [99, 1]), None: np.array([3.0, 3.0, 9.0]), "d": np.array([-4.0, 0.0])}
    rows = [(k, float(v)) for k, values in groups.items() for v in values] + [("a", None), ("empty", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: (r.n, r.q) for r in quantiles(df, ["k"], "v", (0.0, 0.25, 0.5, 0.75, 1.0), buckets).collect()}
    assert set(got) == set(groups)
    for k, values in groups.items():
        assert got[k][0] == len(values) and np.allclose(got[k][1], np.quantile(values, [0, 0.25, 0.5, 0.75, 1]))
    whole = quantiles(df, [], "v", (0.5,), buckets).collect()
    assert len(whole) == 1 and np.isclose(whole[0].q[0], np.median(np.concatenate(list(groups.values()))))
    assert quantiles(df.where("v is null"), [], "v", (0.5,), buckets).count() == 0
