"""Every query that SQL can say, against DuckDB; the others must run."""

import oracle
import pytest

from tallyrec.plans import registry

SF = "/root/testdata/sf0.01"
QUERIES = registry.load()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, con, name):
    assert oracle.differences(QUERIES[name](spark, SF), registry.ORACLES[name], con) == ""


@pytest.mark.parametrize("name", ["g13_indexed_products", "g13_similar_products", "g15_content_for_users", "g15_indexed_for_users", "g20_indexed_for_users", "g21_indexed_similar", "g20_als_for_users", "i7_pointwise", "i8_listwise", "i9_pairwise", "j5_diversify", "l1_paired_bootstrap", "l4_mean_bootstrap"])
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
