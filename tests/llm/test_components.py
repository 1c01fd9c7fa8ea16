"""Rounds of connected components end with whole results or with an error."""

import random

import pytest

from granary.llm import shared
from granary.llm.shared import components


def test_components_raise_when_unfinished(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(12)], "a long, b long")
    assert {(r.v, r.root) for r in components(edges).collect()} == {(k, 0) for k in range(13)}
    with pytest.raises(RuntimeError):
        components(edges, most_rounds=2)


def test_blocks_of_edges_are_contracted_without_rounds(spark, monkeypatch):
    r = random.Random(5)
    edges = [(a, a + r.randint(1, 9)) for a in r.sample(range(4000), 1500)] + [(7, 7), (0, 3999)]
    plain = {(x.v, x.root) for x in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for block in (1, 300):  # too many edges are left for one block: rounds follow
        assert {(x.v, x.root) for x in shared.components(spark.createDataFrame(edges, "a long, b long"), block=block).collect()} == plain
    monkeypatch.setattr(shared, "_with_least", None)
    assert {(x.v, x.root) for x in shared.components(spark.createDataFrame(edges, "a long, b long"), block=2000).collect()} == plain
    assert shared.components(spark.createDataFrame([], "a long, b long"), block=2000).count() == 0


def test_contraction_shares_no_stage_with_the_step_before(spark, monkeypatch):
    """Two Python steps in one stage take twice the Python workers, whose memory an executor keeps."""
    plans, write = [], shared.written
    monkeypatch.setattr(shared, "written", lambda df: plans.append(python_steps(df)) or write(df))
    edges = spark.range(600).selectExpr("id AS a", "id + 1 AS b").mapInArrow(lambda batches: batches, "a long, b long")
    for block in (100, 5000):
        plans.clear()
        assert {r.root for r in components(edges, block=block).collect()} == {0}
        assert max(plans) == 1


def python_steps(df):
    """The most Python steps that one stage of the plan has."""

    def walk(node, above):
        name = node.nodeName()
        here = 0 if "Exchange" in name else above + (name == "MapInArrow")
        below = node.children()
        return max([here, *(walk(below.apply(k), here) for k in range(below.size()))])

    plan = df._jdf.queryExecution().executedPlan()
    return walk(plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan, 0)
