import os
import re

import pytest

from seedloom.plans import catalog, inputs, records, tensors  # noqa: F401
from tests.oracle import connect, same


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(name, spark, small, con):
    assert name in catalog.ORACLES
    same(catalog.QUERIES[name](spark, small), con, catalog.ORACLES[name])


#: Queries over small tables, or whose results tie when rounded, that are compared at a larger size too.
LARGER = ("add_row_id", "default_ids", "log_transform_score", "pool_tokens", "prediction_rows", "pruned_trees", "target_scaler", "unrooted_edges", "best_match_listing", "annotation_counts")


@pytest.mark.parametrize("name", LARGER)
def test_query_equals_its_sql_at_a_larger_size(name, spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("the middle test tables are absent")
    same(catalog.QUERIES[name](spark, folder), connect(folder), catalog.ORACLES[name])


def test_text_queries_are_registered_where_their_modules_are():
    import __spark_entry__ as entry

    here = os.path.dirname(os.path.abspath(entry.__file__))
    if os.path.isdir(os.path.join(here, "seedloom", "llm")):
        names = {n.split("_")[0] for n in entry.queries() if re.match("op[0-9]+_", n)}
        assert names == {f"op{n}" for n in range(1, 14)} and "pipeline" in entry.queries()


def test_entry(spark, small):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())


def test_positions_are_exchanged_once_a_side(spark, small):
    plan = catalog.QUERIES["feature_dataset"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    full = catalog.QUERIES["feature_dataset"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert full.count("hashpartitioning(row_id") <= 2
