import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from labelpool.functions.text import collapse_blanks, ngrams, tokens
from labelpool.operators.features import (
    TfIdf,
    family_filter,
    feature_index,
    one_hot,
    to_vectors,
    union_features,
)
from labelpool.operators.select import (
    anova_scores,
    chi2_p_value,
    chi2_scores,
    combined_features,
    erfc,
    f_p_value,
    f_tail,
    select_features,
    top_percentile,
)
from labelpool.plans import lookup
from labelpool.plans.lookup import skew_lookup

LONG = "id long, feature string, value double"


@pytest.fixture(scope="module")
def small(spark):
    x = [[1, 0], [2, 1], [0, 3], [1, 4]]
    rows = [(i, f"f{j}", float(v)) for i, r in enumerate(x) for j, v in enumerate(r) if v]
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "id long, y int")
    return spark.createDataFrame(rows, LONG), labels


def by_feature(df, column="score"):
    return {r["feature"]: r[column] for r in df.collect()}


def test_tokens_follow_unicode(spark):
    df = spark.createDataFrame([("IL-6 inhibits naïve a x1 β-cell -ve",)], "t string")
    got = df.select(tokens(F.col("t")).alias("w")).first()["w"]
    assert got == ["il-6", "inhibits", "naïve", "x1", "β-cell", "ve"]


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>")
    got = [r["g"] for r in df.select(ngrams(F.col("w"), 1, 3).alias("g")).collect()]
    assert got == [["a", "b", "c", "a b", "b c", "a b c"], ["a"], []]
    with pytest.raises(ValueError):
        ngrams(F.col("w"), 2, 1)


def test_collapse_blanks(spark):
    df = spark.createDataFrame([("  a \t b\n\nc ",)], "t string")
    assert df.select(collapse_blanks(F.col("t")).alias("c")).first()["c"] == "a b c"


def test_tfidf_golden(spark):
    docs = spark.createDataFrame(
        [(0, "zinc inhibits il-6"), (1, "zinc stimulates zinc"), (2, "il-6 stimulates growth"), (3, "a")],
        "id long, text string",
    )
    model = TfIdf().fit(docs.where("id < 3"))
    idf = by_feature(model.idf, "idf")
    assert idf["growth"] == idf["inhibits"] == pytest.approx(1.693147, abs=1e-6)
    assert idf["il-6"] == idf["stimulates"] == idf["zinc"] == pytest.approx(1.287682, abs=1e-6)
    got = {(r["id"], r["feature"]): r["value"] for r in model.transform(docs).collect()}
    assert got == pytest.approx(
        {
            (0, "il-6"): 0.517856, (0, "inhibits"): 0.680919, (0, "zinc"): 0.517856,
            (1, "stimulates"): 0.447214, (1, "zinc"): 0.894427,
            (2, "growth"): 0.680919, (2, "il-6"): 0.517856, (2, "stimulates"): 0.517856,
        },
        abs=1e-6,
    )
    assert [r["feature"] for r in model.vocabulary.collect()] == sorted(idf)


def test_stop_words_go_before_ngrams_and_counts_can_be_binary(spark):
    docs = spark.createDataFrame([(0, "the zinc of the il-6 zinc")], "id long, text string")
    spec = TfIdf(["the", "of"], 1, 2, binary=True)
    got = {r["feature"]: r["tf"] for r in spec.term_counts(docs).collect()}
    assert got == {"zinc": 1.0, "il-6": 1.0, "zinc il-6": 1.0, "il-6 zinc": 1.0}


@pytest.mark.parametrize("max_hot", [100_000, 2])
def test_skew_lookup_is_the_same_with_hot_and_cold_keys(spark, monkeypatch, max_hot):
    """Also where so few keys may be broadcast that the others are dealt out by salts."""
    monkeypatch.setattr(lookup, "MAX_HOT", max_hot)
    facts = spark.range(1000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("k")
    )
    dim = facts.groupBy("k").agg(F.count("*").alias("n")).where("k <> '5'").withColumn("v", F.length("k"))
    plain = facts.join(dim, "k").select("id", "k", "n", "v")
    for limit in (0, 200, 10_000):
        got = skew_lookup(facts, dim, "k", F.col("n"), "id", limit).select("id", "k", "n", "v")
        assert got.exceptAll(plain).count() == 0 and plain.exceptAll(got).count() == 0


def test_one_hot_and_families(spark):
    df = spark.createDataFrame(
        [(1, "C1", "C2", "INHIBITS", 3, 0.5), (2, None, "C1", "STIMULATES", 4, None)],
        "id long, SUBJECT_CUI string, OBJECT_CUI string, PREDICATE string, SUBJECT_DIST int, SUBJECT_NOVELTY double",
    )
    long = one_hot(df, ["SUBJECT_CUI", "OBJECT_CUI", "PREDICATE"], ["SUBJECT_DIST", "SUBJECT_NOVELTY"])
    got = {(r["id"], r["feature"], r["value"]) for r in long.collect()}
    assert got == {
        (1, "SUBJECT_CUI=C1", 1.0), (1, "OBJECT_CUI=C2", 1.0), (1, "PREDICATE=INHIBITS", 1.0),
        (1, "SUBJECT_DIST", 3.0), (1, "SUBJECT_NOVELTY", 0.5),
        (2, "OBJECT_CUI=C1", 1.0), (2, "PREDICATE=STIMULATES", 1.0), (2, "SUBJECT_DIST", 4.0),
    }
    assert {r["feature"] for r in family_filter(long, ["cui"]).collect()} == {
        "SUBJECT_CUI=C1", "OBJECT_CUI=C2", "OBJECT_CUI=C1"
    }
    assert family_filter(long, ["dist", "novelty"]).count() == 3
    assert family_filter(long, ["all"]).count() == 8
    for bad in (["cui3"], []):
        with pytest.raises(ValueError):
            family_filter(long, bad)


def test_chi2_and_anova_golden(spark, small):
    features, labels = small
    assert by_feature(chi2_scores(features, labels)) == pytest.approx({"f0": 1.0, "f1": 4.5})
    assert by_feature(anova_scores(features, labels)) == pytest.approx({"f0": 2.0, "f1": 18.0})
    p = chi2_scores(features, labels).select("feature", chi2_p_value(F.col("score")).alias("p"))
    assert by_feature(p, "p") == pytest.approx({"f0": 0.317311, "f1": 0.033895}, abs=1e-6)


def test_constant_feature_has_no_f(spark, small):
    _, labels = small
    constant = spark.createDataFrame([(i, "c", 2.0) for i in range(4)], LONG)
    assert by_feature(anova_scores(constant, labels)) == {"c": None}
    split = spark.createDataFrame([(i, "s", 1.0) for i in (2, 3)], LONG)
    assert by_feature(anova_scores(split, labels)) == {"s": float("inf")}


@pytest.mark.parametrize(
    "f,n,expected",
    # two-sided Student's t tables: t^2, degrees of freedom + 2
    [(12.706205**2, 3, 0.05), (2.228139**2, 12, 0.05), (2.131450**2, 17, 0.05), (3.2905267**2, 10**7, 0.001)],
)
def test_f_tail(spark, f, n, expected):
    df = spark.createDataFrame([(f,), (None,)], "f double")
    got = [r["p"] for r in df.select(f_p_value(F.col("f"), n).alias("p")).collect()]
    assert got[0] == pytest.approx(expected, rel=1e-4) and (got[1] is None or np.isnan(got[1]))


@pytest.mark.parametrize(
    "f,dof,expected",
    [(100, 397, 3.8e-21), (200, 397, 4.6e-37), (400, 397, 4.7e-62), (3.8419, 20_000, 0.0500), (1, 1, 0.5)],
)
def test_far_f_tail(f, dof, expected):
    """One formula for all sizes; no cancellation for strong features."""
    assert f_tail(np.array([float(f)]), dof)[0] == pytest.approx(expected, rel=2e-2)


def test_tails_against_integration():
    for dof in (3, 40, 397, 20_000):
        t = np.linspace(0, 1, 2_000_001)[1:]
        # Student's t density over [sqrt(f), infinity), with t = sqrt(f) / u.
        for f in (0.3, 4.0, 30.0):
            u = t
            x = np.sqrt(f) / u
            log_c = math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2) - 0.5 * math.log(dof * math.pi)
            density = np.exp(log_c - (dof + 1) / 2 * np.log1p(x * x / dof)) * np.sqrt(f) / u**2
            want = 2 * float(np.sum((density[1:] + density[:-1]) / 2) * (t[1] - t[0]))
            assert f_tail(np.array([f]), dof)[0] == pytest.approx(want, rel=1e-6)
    z = np.linspace(0, 9, 500)
    assert erfc(z) == pytest.approx(np.array([math.erfc(v) for v in z]), rel=1e-12)


def reference_rule(scores, percent):
    """The percentile rule, written out over a list in feature order."""
    cut = np.percentile(scores, 100 - percent)
    keep = scores > cut
    ties = np.where(scores == cut)[0]
    keep[ties[: max(0, int(len(scores) * percent / 100) - keep.sum())]] = True
    return keep


@pytest.mark.parametrize("percent", [1, 10, 42, 50, 66, 99])
@pytest.mark.parametrize("kind", ["distinct", "ties", "flat"])
def test_percentile_rule(spark, percent, kind):
    rng = np.random.default_rng(5)
    scores = {
        "distinct": rng.random(64), "ties": rng.integers(0, 4, 64).astype(float), "flat": np.ones(64)
    }[kind].round(6)
    names = sorted(f"f{i}" for i in range(64))
    df = spark.createDataFrame(pd.DataFrame({"feature": names, "score": scores}))
    got = {r["feature"] for r in top_percentile(df, percent).collect()}
    assert got == {n for n, k in zip(names, reference_rule(scores, percent)) if k}
    if kind == "distinct" and percent == 42:
        assert len(got) == 27


def test_percentile_ends(spark, small):
    features, labels = small
    scores = chi2_scores(features, labels)
    assert top_percentile(scores, 100).count() == 2 and top_percentile(scores, 0).count() == 0
    with pytest.raises(ValueError):
        top_percentile(scores, 101)
    with pytest.raises(ValueError):
        select_features(features, labels, 10, "nope")


def test_select_within_training_rows_only(spark, small):
    features, labels = small
    kept = select_features(features, labels.where("id <> 3"), 50)
    assert {r["feature"] for r in kept.collect()} == {"f1"} and kept.where("id = 3").count() == 1


def test_union_and_combined(spark, small):
    features, labels = small
    both = union_features({"a": features, "b": features}, prefix=True)
    assert both.select("feature").distinct().count() == 4
    out = combined_features(features, features, labels, ["all"], 50, 50, 50, prefix=True)
    assert {r["feature"] for r in out.collect()} == {"text:f1"}


def test_vectors(spark, small):
    features, _ = small
    index = feature_index(features)
    got = {r["id"]: r["features"].toArray().tolist() for r in to_vectors(features, index).collect()}
    assert got == {0: [1.0, 0.0], 1: [2.0, 1.0], 2: [0.0, 3.0], 3: [1.0, 4.0]}
    assert [r['idx'] for r in index.orderBy('feature').collect()] == list(range(index.count()))
