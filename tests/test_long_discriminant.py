"""The long discriminant gives the margins of the dense one."""

import pytest
from pyspark.sql import functions as F

from labelpool.operators.features import feature_index, to_arrays
from labelpool.operators.long_model import LongDiscriminant
from labelpool.operators.moments import Discriminant


@pytest.fixture(scope="module")
def matrix(spark):
    rows = [(i, f"f{j}", float((i * 7 + j * 3) % 5 + 1)) for i in range(40) for j in range(12) if (i * j + i // 3) % 3 == 0]
    labels = spark.createDataFrame([(i, (i // 2) % 2, i % 4) for i in range(36)], "id long, y int, fold int")
    return spark.createDataFrame(rows, "id long, feature string, value double"), labels


def test_long_discriminant_is_the_dense_one(spark, matrix):
    features, labels = matrix
    ids = spark.range(42)
    truth = labels.select("id", "y")
    dense = to_arrays(features, feature_index(features), ids)
    want = Discriminant().fit(dense.join(truth, "id")).transform(dense)
    got = LongDiscriminant(features).fit(truth).transform(ids)
    assert got.columns == ["id", "margin", "prob"]
    for a, b in zip(want.orderBy("id").collect(), got.orderBy("id").collect(), strict=True):
        assert b["margin"] == pytest.approx(a["margin"]) and b["prob"] == pytest.approx(a["prob"])
    one = LongDiscriminant(features).fit(truth.where("y = 1")).transform(ids).first()
    assert one["margin"] is None and one["prob"] is None
    with pytest.raises(ValueError, match="classes 0 and 1"):
        LongDiscriminant(features).fit(truth.withColumn("y", F.lit(2)))
