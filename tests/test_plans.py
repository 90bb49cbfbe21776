"""Plan-shape guards for the draw-level pipelines (scale properties, not values)."""

import pytest

from cohortcast.plans.registry import all_queries

from .conftest import SF_SMALL


def _plan(spark, name):
    df = all_queries()[name].build(spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


def _subtrees(plan: str, marker: str):
    lines = plan.splitlines()
    for k, line in enumerate(lines):
        if marker in line:
            indent = len(line) - len(line.lstrip(" :|+-"))
            body = []
            for nxt in lines[k + 1:]:
                if len(nxt) - len(nxt.lstrip(" :|+-")) <= indent:
                    break
                body.append(nxt)
            yield "\n".join(body)


@pytest.mark.parametrize("name", ["loglik_variable", "predictive_sampled"])
def test_no_shuffle_of_draw_rows(spark, name):
    plan = _plan(spark, name)
    # the only exchanges are the draw-key repartitions; every per-draw aggregation,
    # join and grouped-map reuses the (Country, Sim) partitioning
    assert "ENSURE_REQUIREMENTS" not in plan
    assert "REPARTITION_BY_NUM" in plan


@pytest.mark.parametrize("name", ["loglik_variable", "log_score", "predictive_table", "looic_grid"])
def test_exploded_side_is_never_broadcast(spark, name):
    plan = _plan(spark, name)
    for body in _subtrees(plan, "BroadcastExchange"):
        assert "Generate explode" not in body, body
