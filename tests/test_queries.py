import oracle
import pytest

from callboard.plans import carriers, records, texts  # noqa: F401
from callboard.plans.oracles import ORACLE_SQL
from callboard.plans.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, sf, name):
    assert oracle.same(spark, name, QUERIES[name], ORACLE_SQL[name], sf) >= (1 if name != "state_violations" else 0)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 25
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
