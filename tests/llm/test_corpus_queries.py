import pytest
from oracle import same

from cubelume.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_against_sql(spark, sf_dir, name):
    same(registry.QUERIES[name](spark, sf_dir), registry.ORACLE[name], sf_dir)
