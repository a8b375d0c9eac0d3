"""Queries on text features: TF-IDF, feature scores, selection, combined features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelpool.operators import models
from labelpool.operators.features import (
    TfIdf,
    family_filter,
    feature_index,
    one_hot,
    to_vectors,
    union_features,
)
from labelpool.operators.long_model import LongDiscriminant, fold_model_auc
from labelpool.operators.long_svm import cross_validate_hinge
from labelpool.operators.pool import next_batch
from labelpool.operators.select import (
    anova_scores,
    chi2_p_value,
    chi2_scores,
    combined_features,
    f_p_value,
    fold_scores,
    fold_selection,
    number_features,
    rank_features,
    select_features,
    top_percentile,
)
from labelpool.operators.splits import stratified_folds
from labelpool.operators.strategies import get_strategy
from labelpool.queries.pool import rounded
from labelpool.session import materialise, new_table_dir
from labelpool.sources import readers, writers

# A short list, passed to both engines. The pattern is one on which both regex engines agree;
# the library's own default pattern has unit tests.
STOP_WORDS = "a an and are as at be by for from in is it of on or that the this to was with".split()
PATTERN = r"[\p{L}\p{N}_-]+"
PATTERNS = {"source": r"source=.*", "lang": r"lang=.*", "size": r"n_chars"}


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select(
        F.col("doc_id").alias("id"), "text", "lang", "source", "n_chars"
    )


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/labels.parquet").select(
        F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("y")
    )


def weights(spark: SparkSession, sf: str, low: int = 1, high: int = 1, binary: bool = False):
    docs = documents(spark, sf)
    spec = TfIdf(STOP_WORDS, low, high, binary, PATTERN, min_length=2)
    return spec.fit(docs).transform(docs)


def labeled_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of the labeled documents; document frequencies are those of all documents."""
    docs = documents(spark, sf)
    return TfIdf(STOP_WORDS, pattern=PATTERN, min_length=2).fit(docs).transform(docs, labels(spark, sf))


def folded_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Ten stratified folds of the labeled documents, written once: they are joined several times."""
    return materialise(stratified_folds(labels(spark, sf), 10, 1), "folded-labels")


def records(spark: SparkSession, sf: str) -> DataFrame:
    return one_hot(documents(spark, sf), ["lang", "source"], ["n_chars"])


def stored_weights(spark: SparkSession, sf: str) -> DataFrame:
    return materialise(weights(spark, sf), "tfidf")


def tfidf(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(weights(spark, sf), "value")


def tfidf_bigrams(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(weights(spark, sf, 1, 2, True), "value")


def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return TfIdf(STOP_WORDS, pattern=PATTERN, min_length=2).fit(documents(spark, sf)).vocabulary


def scores(scorer):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        parts = {"t": labeled_weights(spark, sf), "r": records(spark, sf)}
        out = scorer(union_features(parts), labels(spark, sf))
        return rounded(out, "score", digits=5)

    return run


def top_features(spark: SparkSession, sf: str) -> DataFrame:
    found = materialise(anova_scores(labeled_weights(spark, sf), labels(spark, sf)), "scores")
    return top_percentile(found, 12).select("feature")


def selected(scorer: str, percent: float):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = select_features(stored_weights(spark, sf), labels(spark, sf), percent, scorer)
        return rounded(out, "value")

    return run


def selected_names(scorer: str, percent: float):
    """Per kept feature its rows, sum and sum of squares in the matrix that is left."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return feature_totals(select_features(stored_weights(spark, sf), labels(spark, sf), percent, scorer))

    return run


def feature_totals(matrix: DataFrame, *by: str) -> DataFrame:
    v = F.col("value")
    sums = matrix.groupBy(*by, "feature").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(v).alias("total"), F.sum(v * v).alias("squares")
    )
    return rounded(sums, "total", "squares")


def fold_features(spark: SparkSession, sf: str) -> DataFrame:
    """What each of ten folds selects from its training side, by chi-square."""
    kept = fold_selection(labeled_weights(spark, sf), folded_labels(spark, sf), 12)
    return rounded(kept.select("fold", "feature", "rows", "score"), "score", digits=5)


def combined_within_fold(spark: SparkSession, sf: str) -> DataFrame:
    out = combined_features(
        stored_weights(spark, sf),
        records(spark, sf),
        folded_labels(spark, sf),
        families=["source"],
        text_percent=12,
        record_percent=50,
        final_percent=65,
        patterns=PATTERNS,
        within_fold=True,
    )
    return feature_totals(out, "fold").drop("squares")


def leak_free_auc(spark: SparkSession, sf: str) -> DataFrame:
    """Cross-validation of the discriminant on selected terms: chosen on each training side, and,
    for comparison, chosen on all labeled rows, which lets held-out rows speak for themselves."""
    features, truth = materialise(labeled_weights(spark, sf), "tfidf"), folded_labels(spark, sf)
    scored = materialise(fold_scores(features, truth), "fold-scores")
    own = fold_model_auc(features, truth, top_percentile(scored, 12, "fold"))
    everywhere = materialise(chi2_scores(features, truth), "scores")
    leaky = scored.join(top_percentile(everywhere, 12).select("feature"), "feature", "left_semi")
    other = fold_model_auc(features, truth, leaky).select(
        "fold", F.col("features").alias("leaky_features"), F.col("auc").alias("leaky_auc")
    )
    return rounded(own.join(other, "fold"), "auc", "leaky_auc")


def ranked(spark: SparkSession, sf: str) -> DataFrame:
    """Best ten percent of all terms with chi-square and its p-value, best first."""
    found = materialise(chi2_scores(labeled_weights(spark, sf), labels(spark, sf)), "scores")
    best = rank_features(top_percentile(found, 10))
    return best.select("feature", "score", chi2_p_value(F.col("score")).alias("p"))


def feature_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Ranks of the best ten percent of all terms, and whether the written file gives their scores
    back to its six digits."""
    found = materialise(chi2_scores(labeled_weights(spark, sf), labels(spark, sf)), "scores")
    best = materialise(number_features(top_percentile(found, 10)), "best")
    path = new_table_dir(spark, "ranked")
    writers.write_ranked_features(
        rank_features(best).withColumn("p", chi2_p_value(F.col("score"))), path
    )
    parts = F.split("value", " :: ")
    back = readers.read_lines(spark, path).select(parts[0].alias("feature"), parts[1].cast("double").alias("_back"))
    same = F.abs(F.col("_back") - F.col("score")) <= 1e-5 * F.col("score")
    return rounded(
        best.join(back, "feature").select("feature", "rank", "score", same.alias("written")), "score", digits=5
    )


def ranked_anova(spark: SparkSession, sf: str) -> DataFrame:
    truth = labels(spark, sf)
    found = materialise(anova_scores(labeled_weights(spark, sf), truth), "scores")
    best = rank_features(top_percentile(found, 10))
    return best.select("feature", "score", f_p_value(F.col("score"), truth.count()).alias("p"))


def matrix_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Record features of the labeled documents, written as a wide matrix and read again."""
    truth = labels(spark, sf).select("id", "y")
    path = new_table_dir(spark, "matrix")
    writers.write_feature_matrix(records(spark, sf).join(truth.select("id"), "id"), truth, path)
    features, back = readers.read_feature_matrix(spark, path, id_col="id")
    return features.join(back, "id").select("id", "feature", "value", "y")


def delimited_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The labels as a bar-separated file with a header, read again."""
    path = new_table_dir(spark, "delimited")
    labels(spark, sf).select("id", "y").write.csv(path, sep="|", header=True)
    return readers.read_delimited(spark, path, "id bigint, y int", sep="|")


def combined(spark: SparkSession, sf: str) -> DataFrame:
    out = combined_features(
        stored_weights(spark, sf),
        records(spark, sf),
        labels(spark, sf),
        families=["source"],
        text_percent=12,
        record_percent=50,
        final_percent=65,
        patterns=PATTERNS,
    )
    return rounded(out, "value")


def combined_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Per feature its rows, sum and sum of squares in the combined matrix."""
    out = combined_features(
        stored_weights(spark, sf), records(spark, sf), labels(spark, sf), families=["source"],
        text_percent=12, record_percent=50, final_percent=65, patterns=PATTERNS, prefix=True,
    )
    return feature_totals(out)


def document_one_hot(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf)


def families(spark: SparkSession, sf: str) -> DataFrame:
    return family_filter(
        records(spark, sf), ["lang", "size"], PATTERNS
    )


def matrix_with_label(spark: SparkSession, sf: str) -> DataFrame:
    both = union_features({"text": labeled_weights(spark, sf), "record": records(spark, sf)}, prefix=True)
    return rounded(both.join(labels(spark, sf), "id"), "value")


def text_model_cv(spark: SparkSession, sf: str) -> DataFrame:
    """AUC over ten folds of a linear classifier on selected text features."""
    truth = labels(spark, sf)
    features = materialise(labeled_weights(spark, sf), "tfidf")
    kept = materialise(select_features(features, truth, 12), "kept")
    rows = to_vectors(kept.join(truth.select("id"), "id"), feature_index(kept))
    folded = stratified_folds(rows.join(truth, "id"), 10, 1).select("features", "y", "fold")
    mean, spread = cross_validate_hinge(models.hinge(), folded, 10)
    return spark.createDataFrame([(mean, spread)], "auc double, spread double")


def text_pool_pick(spark: SparkSession, sf: str) -> DataFrame:
    """The whole way from raw text to the next ten documents to label: TF-IDF, the best percent of
    the terms by F, a model on the labeled documents, entropy on all others."""
    truth = labels(spark, sf)
    kept = materialise(select_features(stored_weights(spark, sf), truth, 1, "anova"), "kept")
    docs = documents(spark, sf).select("id")
    labeled = docs.join(truth, "id")
    unlabeled = docs.join(truth, "id", "left_anti")
    batch = next_batch(unlabeled, labeled, get_strategy("entropy"), 10, LongDiscriminant(kept))
    return batch.select("id", F.col("draw").cast("int").alias("draw"))


# ---- SQL --------------------------------------------------------------------------------------

STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)


def tfidf_sql(bigrams: bool = False, binary: bool = False) -> str:
    terms = "SELECT id, w AS feature FROM kept"
    if bigrams:
        terms += (
            " UNION ALL SELECT id, w || ' ' || nxt FROM (SELECT id, w,"
            " lead(w) OVER (PARTITION BY id ORDER BY pos) AS nxt FROM kept) WHERE nxt IS NOT NULL"
        )
    tf = "1.0::DOUBLE" if binary else "CAST(count(*) AS DOUBLE)"
    return f"""
words AS (
  SELECT id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS pos
  FROM (SELECT doc_id AS id, regexp_extract_all(lower(text), '{PATTERN}') AS w FROM documents)),
kept AS (SELECT * FROM words WHERE length(w) >= 2 AND w NOT IN ({STOP_SQL})),
tf AS (SELECT id, feature, {tf} AS tf FROM ({terms}) GROUP BY id, feature),
idf AS (
  SELECT feature, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf
  FROM tf GROUP BY feature),
w AS (SELECT id, feature, tf * idf AS w FROM tf JOIN idf USING (feature)),
tfidf AS MATERIALIZED (SELECT id, feature, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS value FROM w)"""


RECORDS_SQL = """
records AS (
  SELECT doc_id AS id, 'lang=' || lang AS feature, 1.0::DOUBLE AS value FROM documents UNION ALL
  SELECT doc_id, 'source=' || source, 1.0::DOUBLE FROM documents UNION ALL
  SELECT doc_id, 'n_chars', CAST(n_chars AS DOUBLE) FROM documents),
lab AS MATERIALIZED (SELECT doc_id AS id, CAST(quality AS INTEGER) AS y FROM labels),
size AS (SELECT count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1 FROM lab)"""


def sums_sql(rows: str, out: str) -> str:
    return f"""
{out} AS MATERIALIZED (
  SELECT feature, count(*) AS rows, coalesce(sum(value) FILTER (y = 0), 0) AS s0,
    coalesce(sum(value) FILTER (y = 1), 0) AS s1, sum(value * value) AS ss
  FROM {rows} JOIN lab USING (id) GROUP BY feature)"""


E0, E1 = "((s0 + s1) * n0 / (n0 + n1))", "((s0 + s1) * n1 / (n0 + n1))"
CHI2 = f"(s0 - {E0}) * (s0 - {E0}) / {E0} + (s1 - {E1}) * (s1 - {E1}) / {E1}"


def chi2_sql(rows: str, out: str) -> str:
    return (
        sums_sql(rows, f"{out}_s")
        + f""",
{out} AS (SELECT feature, rows, {CHI2} AS score FROM {out}_s, size)"""
    )


def anova_sql(rows: str, out: str) -> str:
    by_class = "(s0 * s0 / n0 + s1 * s1 / n1)"
    between = f"({by_class} - (s0 + s1) * (s0 + s1) / (n0 + n1))"
    within = f"(ss - {by_class})"
    return (
        sums_sql(rows, f"{out}_s")
        + f""",
{out} AS (SELECT feature, rows, CASE WHEN {within} > ss * 1e-14 THEN {between} / ({within} / (n0 + n1 - 2)) END
  AS score FROM {out}_s, size)"""
    )


def top_sql(scored: str, percent: float, out: str) -> str:
    """The percentile rule: above the cut, then ties in name order up to floor(n * p / 100)."""
    return f"""
{out}_r AS (SELECT feature, coalesce(round(score, 9), -1.7e308) AS r FROM {scored}),
{out}_cut AS (SELECT quantile_cont(r, {(100 - percent) / 100}) AS cut, count(*) AS n FROM {out}_r),
{out}_t AS (
  SELECT feature, r, cut, row_number() OVER (ORDER BY r DESC, feature) AS rn,
    CAST(floor(n * {percent} / 100) AS BIGINT) AS room FROM {out}_r, {out}_cut),
{out} AS MATERIALIZED (SELECT feature FROM {out}_t WHERE r > cut OR (r = cut AND rn <= room))"""


WITH = "WITH" + tfidf_sql() + "," + RECORDS_SQL
ALL = ", allf AS (SELECT * FROM tfidf UNION ALL SELECT * FROM records),"

COMBINED_SQL = (
    WITH
    + ","
    + chi2_sql("tfidf", "c1")
    + ","
    + top_sql("c1", 12, "k1")
    + ", fam AS MATERIALIZED (SELECT * FROM records WHERE regexp_matches(feature, 'source=.*')),"
    + chi2_sql("fam", "c2")
    + ","
    + top_sql("c2", 50, "k2")
    + """, both_f AS MATERIALIZED (SELECT id, '0:' || feature AS feature, value FROM tfidf SEMI JOIN k1 USING (feature)
  UNION ALL SELECT id, '1:' || feature, value FROM fam SEMI JOIN k2 USING (feature)),"""
    + chi2_sql("both_f", "c3")
    + ","
    + top_sql("c3", 65, "k3")
    + " SELECT id, feature[3:] AS feature, round(value, 6) AS value FROM both_f SEMI JOIN k3 USING (feature)"
)


def selected_sql(scorer, percent: float) -> str:
    return (
        WITH
        + ","
        + scorer("tfidf", "c")
        + ","
        + top_sql("c", percent, "k")
        + " SELECT id, feature, round(value, 6) AS value FROM tfidf SEMI JOIN k USING (feature)"
    )


FOLDS_SQL = """,
labf AS MATERIALIZED (
  SELECT id, y, CAST((row_number() OVER (ORDER BY y, md5('1:' || id), id) - 1) % 10 AS INTEGER) AS home
  FROM lab WHERE y IS NOT NULL),
t AS (SELECT CAST(t AS INTEGER) AS fold FROM range(10) r(t)),
sizes AS MATERIALIZED (
  SELECT fold, count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1
  FROM labf JOIN t ON home <> fold GROUP BY fold)"""


def fold_chi2_sql(rows: str, out: str, own: bool = False) -> str:
    """Sums of every training side, written out fold by fold; ``own`` rows have a fold."""
    on = f"{rows}.fold = t.fold" if own else "true"
    return f""",
{out}_s AS MATERIALIZED (
  SELECT t.fold, feature, count(*) AS rows, coalesce(sum(value) FILTER (y = 0), 0) AS s0,
    coalesce(sum(value) FILTER (y = 1), 0) AS s1, sum(value * value) AS ss
  FROM {rows} JOIN labf USING (id) JOIN t ON home <> t.fold AND {on} GROUP BY t.fold, feature),
{out} AS MATERIALIZED (SELECT *, {CHI2} AS score FROM {out}_s JOIN sizes USING (fold))"""


def fold_top_sql(scored: str, percent: float, out: str) -> str:
    return f""",
{out}_r AS (SELECT fold, feature, coalesce(round(score, 9), -1.7e308) AS r FROM {scored}),
{out}_cut AS (
  SELECT fold, quantile_cont(r, {(100 - percent) / 100}) AS cut, count(*) AS n FROM {out}_r GROUP BY fold),
{out}_t AS (
  SELECT fold, feature, r, cut, row_number() OVER (PARTITION BY fold ORDER BY r DESC, feature) AS rn,
    CAST(floor(n * {percent} / 100) AS BIGINT) AS room FROM {out}_r JOIN {out}_cut USING (fold)),
{out} AS MATERIALIZED (SELECT fold, feature FROM {out}_t WHERE r > cut OR (r = cut AND rn <= room))"""


def fold_auc_sql(kept: str, sums: str, out: str) -> str:
    """AUC of the discriminant over the kept features, by all pairs of one positive and one negative."""
    mean = "s0 / n0", "s1 / n1"
    var = f"((ss - s0 * {mean[0]} - s1 * {mean[1]}) / (n0 + n1 - 2))"
    return f""",
{out}_w AS MATERIALIZED (
  SELECT fold, feature, n0, n1, CASE WHEN {var} > 1e-300 THEN ({mean[1]} - {mean[0]}) / {var} ELSE 0 END AS w,
    ({mean[0]} + {mean[1]}) / 2 AS mid FROM {sums} JOIN {kept} USING (fold, feature)),
{out}_b AS (SELECT fold, ln(max(n1) / max(n0)) - sum(w * mid) AS b, count(*) AS features FROM {out}_w GROUP BY fold),
{out}_d AS (
  SELECT id, sum(value * w) AS dot FROM tfidf JOIN labf USING (id) JOIN {out}_w w
    ON w.feature = tfidf.feature AND w.fold = home GROUP BY id),
{out}_m AS (
  SELECT home AS fold, y, round(coalesce(dot, 0) + b, 9) AS m FROM labf LEFT JOIN {out}_d USING (id)
  JOIN {out}_b ON {out}_b.fold = home),
{out} AS (
  SELECT p.fold, avg(CASE WHEN p.m > q.m THEN 1 WHEN p.m = q.m THEN 0.5 ELSE 0 END::DOUBLE) AS auc
  FROM {out}_m p JOIN {out}_m q ON p.fold = q.fold WHERE p.y = 1 AND q.y = 0 GROUP BY p.fold)"""


FOLD_COMBINED_SQL = (
    WITH
    + FOLDS_SQL
    + fold_chi2_sql("tfidf", "c1")
    + fold_top_sql("c1", 12, "k1")
    + ", fam AS MATERIALIZED (SELECT * FROM records WHERE regexp_matches(feature, 'source=.*'))"
    + fold_chi2_sql("fam", "c2")
    + fold_top_sql("c2", 50, "k2")
    + """, both_f AS MATERIALIZED (SELECT fold, id, '0:' || feature AS feature, value FROM tfidf JOIN k1 USING (feature)
  UNION ALL SELECT fold, id, '1:' || feature, value FROM fam JOIN k2 USING (feature))"""
    + fold_chi2_sql("both_f", "c3", own=True)
    + fold_top_sql("c3", 65, "k3")
    + """ SELECT fold, feature[3:] AS feature, count(*) AS rows, round(sum(value), 6) AS total
FROM both_f JOIN k3 USING (fold, feature) GROUP BY fold, feature"""
)

LEAK_SQL = (
    WITH
    + FOLDS_SQL
    + fold_chi2_sql("tfidf", "c")
    + fold_top_sql("c", 12, "k")
    + fold_auc_sql("k", "c", "a")
    + ","
    + chi2_sql("tfidf", "e")
    + ","
    + top_sql("e", 12, "g")
    + ", h AS (SELECT fold, feature FROM g, t)"
    + fold_auc_sql("h", "c", "z")
    + """ SELECT a.fold, a_b.features, round(a.auc, 6) AS auc, z_b.features AS leaky_features,
  round(z.auc, 6) AS leaky_auc FROM a JOIN a_b USING (fold) JOIN z USING (fold) JOIN z_b USING (fold)"""
)

TOTALS_SQL = "count(*) AS rows, round(sum(value), 6) AS total, round(sum(value * value), 6) AS squares"
COMBINED_TOTALS_SQL = COMBINED_SQL[: COMBINED_SQL.rindex(" SELECT")] + f"""
SELECT CASE feature[1] WHEN '0' THEN 'text:' ELSE 'record:' END || feature[3:] AS feature, {TOTALS_SQL}
FROM both_f WHERE feature IN (SELECT feature FROM k3) GROUP BY feature"""


def selected_totals_sql(scorer, percent: float) -> str:
    return (
        WITH + "," + scorer("tfidf", "c") + "," + top_sql("c", percent, "k")
        + f" SELECT feature, {TOTALS_SQL} FROM tfidf WHERE feature IN (SELECT feature FROM k) GROUP BY feature"
    )


PICK_SQL = (
    WITH
    + ","
    + anova_sql("tfidf", "c")
    + ","
    + top_sql("c", 1, "k")
    + """,
f AS (SELECT * FROM tfidf SEMI JOIN k USING (feature)),
m AS (
  SELECT feature, coalesce(sum(value) FILTER (y = 0), 0) AS s10, coalesce(sum(value) FILTER (y = 1), 0) AS s11,
    sum(value * value) AS s2 FROM f JOIN lab USING (id) GROUP BY feature),
x AS (
  SELECT feature, s10 / n0 AS m0, s11 / n1 AS m1,
    (s2 - s10 * s10 / n0 - s11 * s11 / n1) / (n0 + n1 - 2) AS var FROM m, size),
wts AS (SELECT feature, CASE WHEN var > 1e-300 THEN (m1 - m0) / var ELSE 0 END AS w, (m0 + m1) / 2 AS mid FROM x),
b AS (SELECT ln(max(n1) / max(n0)) - (SELECT sum(w * mid) FROM wts) AS b FROM size),
dots AS (SELECT id, sum(value * w) AS dot FROM f JOIN wts USING (feature) GROUP BY id),
p AS (
  SELECT doc_id AS id, 1 / (1 + exp(-(coalesce(dot, 0) + b))) AS p1
  FROM documents LEFT JOIN dots ON id = doc_id, b WHERE doc_id NOT IN (SELECT id FROM lab)),
e AS (SELECT id, round(-(CASE WHEN p1 > 0 THEN p1 * log2(p1) ELSE 0 END
  + CASE WHEN p1 < 1 THEN (1 - p1) * log2(1 - p1) ELSE 0 END), 9) AS e FROM p)
SELECT id, CAST(row_number() OVER (ORDER BY e DESC, id) - 1 AS INTEGER) AS draw
FROM e ORDER BY e DESC, id LIMIT 10"""
)

QUERIES = {
    "text_pool_pick": (text_pool_pick, PICK_SQL),
    "tfidf": (tfidf, "WITH" + tfidf_sql() + " SELECT id, feature, round(value, 6) AS value FROM tfidf"),
    "tfidf_bigrams_binary": (
        tfidf_bigrams,
        "WITH" + tfidf_sql(True, True) + " SELECT id, feature, round(value, 6) AS value FROM tfidf",
    ),
    "vocabulary": (vocabulary, "WITH" + tfidf_sql() + " SELECT feature FROM idf"),
    "chi2_scores": (
        scores(chi2_scores),
        WITH + ALL + chi2_sql("allf", "c") + " SELECT feature, rows, round(score, 5) AS score FROM c",
    ),
    "anova_f": (
        scores(anova_scores),
        WITH + ALL + anova_sql("allf", "c") + " SELECT feature, rows, round(score, 5) AS score FROM c",
    ),
    "top_percentile_features": (
        top_features,
        WITH + "," + anova_sql("tfidf", "c") + "," + top_sql("c", 12, "k") + " SELECT feature FROM k",
    ),
    "select_anova": (selected("anova", 42), selected_sql(anova_sql, 42)),
    "select_chi2": (selected("chi2", 12), selected_sql(chi2_sql, 12)),
    "selected_features_anova": (selected_names("anova", 42), selected_totals_sql(anova_sql, 42)),
    "selected_features_chi2": (selected_names("chi2", 12), selected_totals_sql(chi2_sql, 12)),
    "combined_feature_sums": (combined_sums, COMBINED_TOTALS_SQL),
    "fold_features": (
        fold_features,
        WITH + FOLDS_SQL + fold_chi2_sql("tfidf", "c") + fold_top_sql("c", 12, "k")
        + " SELECT fold, feature, rows, round(score, 5) AS score FROM c JOIN k USING (fold, feature)",
    ),
    "combined_within_fold": (combined_within_fold, FOLD_COMBINED_SQL),
    "leak_free_auc": (leak_free_auc, LEAK_SQL),
    "ranked_features": (ranked, None),
    "ranked_features_anova": (ranked_anova, None),
    "feature_ranking": (
        feature_ranking,
        WITH + "," + chi2_sql("tfidf", "c") + "," + top_sql("c", 10, "k")
        + " SELECT feature, row_number() OVER (ORDER BY round(score, 9) DESC, feature) AS rank,"
        + " round(score, 5) AS score, true AS written FROM c WHERE feature IN (SELECT feature FROM k)",
    ),
    "combined_features": (combined, COMBINED_SQL),
    "matrix_round_trip": (
        matrix_round_trip,
        "WITH" + RECORDS_SQL + " SELECT id, feature, value, y FROM records JOIN lab USING (id) WHERE value <> 0",
    ),
    "delimited_round_trip": (
        delimited_round_trip, "SELECT doc_id AS id, CAST(quality AS INTEGER) AS y FROM labels"
    ),
    "onehot_documents": (document_one_hot, "WITH" + RECORDS_SQL + " SELECT id, feature, value FROM records"),
    "family_filter": (
        families,
        "WITH"
        + RECORDS_SQL
        + " SELECT id, feature, value FROM records WHERE regexp_matches(feature, 'lang=.*')"
        + " OR regexp_matches(feature, 'n_chars')",
    ),
    "matrix_with_label": (
        matrix_with_label,
        WITH
        + """, m AS (SELECT id, 'text:' || feature AS feature, value FROM tfidf UNION ALL
  SELECT id, 'record:' || feature, value FROM records)
SELECT id, feature, round(value, 6) AS value, y FROM m JOIN lab USING (id)""",
    ),
    "text_model_cv": (text_model_cv, None),
}
