"""The dealt join gives the rows of an ordinary one and no place all rows of a frequent key."""

import pytest
from pyspark.sql import functions as F

from labelpool.operators.extract import either_key_join, either_key_join_dealt
from labelpool.plans.lookup import salted_join


@pytest.fixture(scope="module")
def sides(spark):
    # Key 1 holds half of all rows; key 90 stands on one side only, NULL on both.
    facts = spark.range(4000).select(
        "id", F.expr("CASE WHEN id % 2 = 0 THEN 1 WHEN id % 97 = 0 THEN NULL ELSE id % 50 END").alias("k")
    )
    dim = spark.createDataFrame([(1, "a"), (1, "b"), (90, "c"), (None, "d")] + [(i, "e") for i in range(2, 40)], "k bigint, v string")
    return facts, dim


def rows_of(df):
    return sorted(map(tuple, df.select("id", "k", "v").collect()))


@pytest.mark.parametrize("part_rows", [1, 100, 10**6])
def test_dealt_join_is_the_ordinary_one(sides, part_rows):
    facts, dim = sides
    want = rows_of(facts.join(dim, "k"))
    assert len(want) > 4000 and rows_of(salted_join(facts, dim, "k", "id", part_rows)) == want


def test_a_frequent_key_is_spread_over_tasks(spark, sides):
    facts, dim = sides
    old = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for c, v in zip(old, ("-1", "false")):
        spark.conf.set(c, v)
    try:
        placed = salted_join(facts, dim, "k", "id", 50).where("k = 1").groupBy(F.spark_partition_id()).count()
        counts = [r["count"] for r in placed.collect()]
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert sum(counts) > 4000 and len(counts) >= 6 and max(counts) < sum(counts) / 2


def test_either_key_dealt_has_the_multiplicity_of_or(spark, sides):
    _, dim = sides
    left = spark.range(500).select("id", (F.col("id") % 3).alias("a"), F.when(F.col("id") % 5 > 0, F.lit(1).cast("bigint")).alias("b"))
    want = rows_of(either_key_join(left, dim, "a", "b", "k"))
    assert rows_of(either_key_join_dealt(left, dim, "a", "b", "k", "id", 20)) == want


def test_empty_sides(sides):
    facts, dim = sides
    assert salted_join(facts.limit(0), dim, "k", "id").count() == 0
    assert salted_join(facts, dim.limit(0), "k", "id").count() == 0
