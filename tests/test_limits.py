"""Loops over levels and rounds end with whole results or with an error."""

import random

import pytest

from granary.operators import content
from pyspark.sql import functions as F

from granary.operators import content, tree
from granary.plans import catalogue


def test_paths_raise_when_deeper_than_the_limit(spark):
    edges = spark.createDataFrame([(k, k + 1, f"n{k + 1}") for k in range(4)], "parent long, child long, name string")
    root = spark.range(1).select("id")
    assert {r.node: r.path for r in tree.paths(edges, root, most=4).collect()}[4] == "/n1/n2/n3/n4"
    with pytest.raises(RuntimeError):
        tree.paths(edges, root, most=3)


def test_turns_stay_in_their_conversation(spark, tmp_path):
    rows = [(1, 0, "a"), (1, 1, "b"), (1, 1001, "c"), (2, 0, "d")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {tuple(r) for r in catalogue.QUERIES["path_of"](spark, str(tmp_path)).collect()}
    assert got == {(1, 0, ""), (1, 1, "/b"), (2, 0, "")}


def test_a_verification_goes_on_without_one_task_of_all_rows(spark):
    keys = [None, *range(400)]
    objects = spark.createDataFrame([(k, str(k)) for k in random.Random(3).sample(keys, len(keys))], "id int, name string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for skip in (0, 1, 150, 400, 401, 900):
            got = content.verify_in_order(objects, skip)
            assert [(r.id, r.name) for r in got.collect()] == [(k, str(k)) for k in keys[skip:]]
        parts = content.verify_in_order(objects, 10).groupBy(F.spark_partition_id()).count().collect()
        assert len(parts) > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
