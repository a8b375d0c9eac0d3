"""Features of any number: counts stay in place, frequent keys are not moved, folds copy no rows."""

import math

import pytest
from pyspark.sql import functions as F

from labelpool.operators import features, select
from labelpool.operators.features import TfIdf, union_features
from labelpool.plans import lookup
from labelpool.plans.lookup import split_lookup


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def matrix(spark):
    rows = [(i, f"f{j}", float((i * 7 + j * 3) % 5 + 1)) for i in range(40) for j in range(12) if (i * j + i // 3) % 3 == 0]
    labels = spark.createDataFrame([(i, (i // 2) % 2, i % 4) for i in range(36)], "id long, y int, fold int")
    return spark.createDataFrame(rows, "id long, feature string, value double"), labels


@pytest.mark.parametrize("binary", [False, True])
def test_counts_of_repeated_and_missing_ids(spark, binary):
    docs = spark.createDataFrame(
        [(1, "b a b"), (2, "a"), (2, "a c"), (None, "a"), (None, "a"), (3, None), (4, "!"), (5, "c a")],
        "id long, text string",
    )
    got = {(r["id"], r["feature"]): r["tf"] for r in TfIdf(binary=binary, pattern="[a-z]").term_counts(docs).collect()}
    more = 1.0 if binary else 2.0
    assert got == {
        (1, "a"): 1, (1, "b"): more, (2, "a"): more, (2, "c"): 1, (None, "a"): more, (5, "a"): 1, (5, "c"): 1
    }
    plain = TfIdf(binary=binary).term_counts(docs.where("id IN (1, 5)"))
    assert "Exchange" not in plan_of(plain) and plain.count() == 0  # one-letter words are no tokens


@pytest.mark.parametrize("max_hot", [0, 1, 2, 100])
@pytest.mark.parametrize("part_rows", [3, 1_000_000])
def test_split_lookup_is_the_join(spark, monkeypatch, max_hot, part_rows):
    monkeypatch.setattr(lookup, "MAX_HOT", max_hot)
    facts = spark.range(200).select("id", F.expr("CASE WHEN id % 9 = 0 THEN NULL WHEN id % 2 = 0 THEN 'x' ELSE 'k' || id % 7 END").alias("k"))
    dim = facts.where("k <> 'k3'").groupBy("k").agg(F.count("*").alias("n"))
    assert rows_of(split_lookup(facts, dim, "k", F.col("n"), "id", part_rows)) == rows_of(facts.join(dim, "k").select("id", "k", "n"))


def test_frequent_keys_stay_in_place(spark):
    facts = spark.range(1000).select("id", F.concat(F.lit("k"), F.col("id") % 5).alias("k"))
    dim = facts.groupBy("k").agg(F.count("*").alias("n")).localCheckpoint()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange hashpartitioning" not in plan_of(split_lookup(facts, dim, "k", F.col("n"), "id"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_combined_within_fold_writes_no_row_for_each_fold(matrix, monkeypatch):
    features, labels = matrix
    text, record = features.where("feature < 'f5'"), features.where("feature >= 'f3'")
    parts = {
        "0": select.select_features(text, labels, 60, within_fold=True),
        "1": select.select_features(record, labels, 70, within_fold=True),
    }
    want = select.select_features(union_features(parts, prefix=True), labels, 65, within_fold=True)
    want = rows_of(want.withColumn("feature", F.expr("substring(feature, 3)")).select("fold", "id", "feature", "value"))
    written = []
    plain = select.materialise
    monkeypatch.setattr(select, "materialise", lambda df, name="table": (written.append(df.columns), plain(df, name))[1])
    got = select.combined_features(
        text, record, labels, text_percent=60, record_percent=70, final_percent=65, within_fold=True
    )
    assert rows_of(got.select("fold", "id", "feature", "value")) == want and want
    assert not any("value" in columns for columns in written)


def weights_of(spark, docs, **options):
    spec = TfIdf(pattern="[a-z]+", min_length=1, **options)
    return spec.fit(docs).transform(docs)


@pytest.mark.parametrize("max_hot", [0, 2, 100_000])
@pytest.mark.parametrize("max_ids", [1, 4_000_000])
def test_weights_with_and_without_a_window(spark, monkeypatch, max_hot, max_ids):
    """Terms of one document are not looked up; documents without an id are one document."""
    docs = spark.createDataFrame(
        [(1, "b a b once"), (2, "a a c"), (None, "a only"), (None, "b"), (3, None), (4, "!"), (5, "c a last")],
        "id long, text string",
    )
    monkeypatch.setattr(lookup, "MAX_HOT", max_hot)
    monkeypatch.setattr(features, "MAX_IDS", max_ids)
    got = {(r["id"], r["feature"]): r["value"] for r in weights_of(spark, docs).collect()}
    counts = {1: {"b": 2, "a": 1, "once": 1}, 2: {"a": 2, "c": 1}, None: {"a": 1, "only": 1, "b": 1},
              5: {"c": 1, "a": 1, "last": 1}}
    want = {}
    for i, terms in counts.items():
        w = {t: n * (math.log(8 / (1 + sum(t in c for c in counts.values()))) + 1) for t, n in terms.items()}
        length = math.sqrt(sum(v * v for v in w.values()))
        want |= {(i, t): pytest.approx(v / length) for t, v in w.items()}
    assert got == want


def test_only_documents_without_an_id_are_gathered(spark):
    docs = spark.range(300).select("id", F.concat_ws(" ", F.lit("aa bb"), F.concat(F.lit("w"), F.col("id") % 7)).alias("text"))
    plan = plan_of(weights_of(spark, docs))
    assert plan.count("REPARTITION_BY_COL") == 1 and "isnull(id" in plan


def test_keys_the_lookup_lacks_stay(spark, monkeypatch):
    facts = spark.range(30).select("id", F.concat(F.lit("k"), F.col("id") % 6).alias("k"))
    dim = facts.where("k <> 'k3'").groupBy("k").agg(F.count("*").alias("n"))
    for max_hot in (0, 2, 100):
        monkeypatch.setattr(lookup, "MAX_HOT", max_hot)
        got = split_lookup(facts, dim, "k", F.col("n"), "id", absent={"n": F.lit(-1).cast("bigint")})
        assert rows_of(got) == rows_of(facts.withColumn("n", F.when(F.col("k") == "k3", -1).otherwise(5)))
