import pytest
from oracle import same

from cubelume.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_against_sql(spark, sf_dir, name):
    same(catalog.QUERIES[name](spark, sf_dir), catalog.ORACLE[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_has_rows_and_reruns_agree(spark, sf_dir, name):
    f = catalog.QUERIES[name]
    first = sorted(map(str, f(spark, sf_dir).collect()))
    assert first == sorted(map(str, f(spark, sf_dir).collect()))
    assert first or name == "q_similar_pairs"


def test_entry(spark, sf_dir):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
