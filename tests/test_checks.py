"""Every query with a SQL check gives the check's rows; the plans stay on the JVM."""

import pytest

from compare import difference, duck
from entitynet.plans.checks_sql import CHECKS
from entitynet.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_matches_sql(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert difference(got, con.execute(CHECKS[name]).df()) is None


LAZY = ["group_flow_kpis", "ownership_report", "node_table", "edges_multilayer", "worker_table", "group_modes",
        "extreme_regions", "ami_sweep", "kde", "histogram"]


@pytest.mark.parametrize("name", LAZY)
def test_plan_has_no_python_and_no_product(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for operator in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "MapInPandas"):
        assert operator not in plan


def test_scan_is_pruned_and_filtered(spark):
    plan = QUERIES["family_layer"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "c_acctbal" not in plan
    plan = QUERIES["edges_multilayer"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "l_shipdate" in plan and "SortAggregate" not in plan


def test_registered_search_is_whole(spark):
    """Generations of 15 trials a parameter until the scores meet, then the polish, and one best trial for the final run."""
    log = QUERIES["weight_search"](spark, SF).collect()
    sizes = {}
    for r in log:
        sizes.setdefault(r["phase"], {}).setdefault(r["generation"], []).append(r["ami"])
    assert set(sizes) == {"start", "evolve", "polish"} and len(sizes["evolve"]) > 1
    assert {len(x) for phase in ("start", "evolve") for x in sizes[phase].values()} == {60}
