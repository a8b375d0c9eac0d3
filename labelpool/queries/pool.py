"""Queries on vector pools: splits, scores, distances, neighbours, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelpool.functions.vectors import DISTANCES, distance
from labelpool.operators import evaluate, models
from labelpool.operators.certificate import WIDTHS, hinge_certificates, hinge_weights
from labelpool.operators.moments import Discriminant
from labelpool.operators.neighbours import knn_join, lds_prune, local_density_scores
from labelpool.operators.newton import PlattNewton, margin_rows, newton_fits, platt_grid
from labelpool.operators.pool import next_batch, take_rows
from labelpool.operators.spaces import centre, space
from labelpool.operators.splits import assign_roles, split_test, split_u_l, stratified_folds
from labelpool.operators.strategies import (
    Combined,
    Entropy,
    PoolState,
    QueryStrategy,
    get_strategy,
    select_batch,
)
from labelpool.plans.pivots import nearest
from labelpool.session import materialise

DIGITS = 6


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(
        F.col("vec_id").alias("id"),
        F.col("embedding").cast("array<double>").alias("x"),
        (F.col("label") % 2).cast("int").alias("y"),
    )


def roles(spark: SparkSession, sf: str) -> DataFrame:
    return assign_roles(vectors(spark, sf), 0.2, 0.9, seed=1)


def part(df: DataFrame, role: str) -> DataFrame:
    return df.where(F.col("role") == role).drop("role")


def state_of(spark: SparkSession, sf: str, model: bool) -> PoolState:
    rows = roles(spark, sf)
    u, labeled = part(rows, "U"), part(rows, "L")
    return PoolState(Discriminant().fit(labeled).transform(u) if model else u, labeled)


def rounded(df: DataFrame, *columns: str, digits: int = DIGITS) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ---- SQL pieces -------------------------------------------------------------------------------

POOL_SQL = """
base AS (
  SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, CAST(label % 2 AS INTEGER) AS y
  FROM embeddings),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY md5('1:' || id), id) AS rn, count(*) OVER () AS n
  FROM base),
pool AS (
  SELECT id, x, y, CASE
    WHEN rn <= ceil(0.2::DOUBLE * n) THEN 'T'
    WHEN rn <= ceil(0.2::DOUBLE * n) + ceil(0.9::DOUBLE * (n - ceil(0.2::DOUBLE * n))) THEN 'U'
    ELSE 'L' END AS role
  FROM numbered)"""


def model_sql(rows: str, out: str, by: tuple[str, ...] = ()) -> str:
    """CTEs that fit the closed-form model on ``rows`` (by, x, y) into ``out`` (by, w, b)."""
    g = "".join(f"{c}, " for c in by)
    group = f"GROUP BY {', '.join(by)}" if by else ""
    return f"""
{out}_d AS (
  SELECT {g}y, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS v FROM {rows}),
{out}_c AS (
  SELECT {g}y, i, count(*) AS n, sum(v) AS s1, sum(v * v) AS s2 FROM {out}_d GROUP BY {g}y, i),
{out}_w AS (
  SELECT {g}i,
    max(n) FILTER (y = 0) AS n0, max(s1) FILTER (y = 0) AS s10, max(s2) FILTER (y = 0) AS s20,
    max(n) FILTER (y = 1) AS n1, max(s1) FILTER (y = 1) AS s11, max(s2) FILTER (y = 1) AS s21
  FROM {out}_c GROUP BY {g}i),
{out}_x AS (
  SELECT *, (s11 / n1 - s10 / n0)
    / ((s20 - s10 * s10 / n0 + s21 - s11 * s11 / n1) / (n0 + n1 - 2)) AS wi,
    (s11 / n1 + s10 / n0) / 2 AS mid
  FROM {out}_w),
{out} AS (
  SELECT {g}list(wi ORDER BY i) AS w, ln(max(n1) / max(n0)) - sum(wi * mid) AS b,
    max(n0) + max(n1) AS labeled
  FROM {out}_x {group})"""


SCORED_SQL = (
    "WITH"
    + POOL_SQL
    + ", labeled AS (SELECT * FROM pool WHERE role = 'L'),"
    + model_sql("labeled", "model")
    + """,
margins AS (
  SELECT id, x, y, role, list_dot_product(x, w) + b AS margin FROM pool, model),
scored AS (SELECT *, 1 / (1 + exp(-margin)) AS p1 FROM margins),
u AS (SELECT * FROM scored WHERE role = 'U'),
l AS (SELECT count(*) AS n, avg(y) AS share FROM labeled),
entropies AS (
  SELECT id, -(CASE WHEN p1 > 0 THEN p1 * log2(p1) ELSE 0 END
             + CASE WHEN p1 < 1 THEN (1 - p1) * log2(1 - p1) ELSE 0 END) AS score FROM u)"""
)

PAIRS_SQL = """
WITH{pool},
u AS (SELECT id, x FROM pool WHERE role = 'U'),
l AS (SELECT id, x FROM pool WHERE role = 'L')""".replace("{pool}", POOL_SQL)

MINMAX_SQL = "SELECT u.id, min(list_distance(u.x, l.x)) AS score FROM u, pool l WHERE l.role = 'L' GROUP BY u.id"

NORM_SQL = """
lim AS (SELECT min(score) AS lo, max(score) AS hi FROM {rows}),
{out} AS (SELECT id, CASE WHEN hi > lo THEN (score - lo) / (hi - lo)
  WHEN lo < 1 THEN score ELSE 1 / lo END AS score FROM {rows}, lim)"""


def norm_sql(rows: str, out: str) -> str:
    return NORM_SQL.replace("lim", f"{out}_lim").format(rows=rows, out=out)


def final(score: str, source: str) -> str:
    return f" SELECT id, round({score}, {DIGITS}) AS score FROM {source}"


def bias_sql(q: str, boundary: str) -> str:
    return f"CASE WHEN {q} < {boundary} THEN {q} / {boundary} ELSE (1 - {q}) / {boundary} END"


# ---- strategies -------------------------------------------------------------------------------


def score_query(make) -> object:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        strategy: QueryStrategy = make()
        return rounded(strategy.score(state_of(spark, sf, strategy.needs_model)), "score")

    return run


def pick_query(make, k: int = 10) -> object:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = roles(spark, sf)
        strategy: QueryStrategy = make()
        batch = next_batch(part(rows, "U"), part(rows, "L"), strategy, k, Discriminant())
        return batch.select("id", F.col("draw").cast("int").alias("draw"))

    return run


def pick_sql(score_sql: str, direction: str, k: int = 10) -> str:
    return f"""
SELECT id, CAST(row_number() OVER (ORDER BY key {direction}, id) - 1 AS INTEGER) AS draw
FROM (SELECT id, round(score, 9) AS key FROM ({score_sql}))
ORDER BY key {direction}, id LIMIT {k}"""


def model_change(spark: SparkSession, sf: str) -> DataFrame:
    """Two rounds: pick the five most uncertain rows, label them, score the rest."""
    rows = roles(spark, sf)
    u, labeled = part(rows, "U"), part(rows, "L")
    strategy = Entropy(model_change=True)
    first = PoolState(Discriminant().fit(labeled).transform(u), labeled)
    previous = strategy.score(first)
    chosen = select_batch(previous, 5).select("id")
    labeled2 = labeled.unionByName(u.join(chosen, "id", "left_semi"))
    u2 = u.join(chosen, "id", "left_anti")
    second = PoolState(
        Discriminant().fit(labeled2).transform(u2), labeled2, previous=previous
    )
    return rounded(strategy.score(second), "score")


MODEL_CHANGE_SQL = (
    SCORED_SQL
    + """,
chosen AS (SELECT id FROM entropies ORDER BY round(score, 9) DESC, id LIMIT 5),
labeled2 AS (SELECT id, x, y FROM labeled UNION ALL
  SELECT id, x, y FROM u WHERE id IN (SELECT id FROM chosen)),"""
    + model_sql("labeled2", "model2")
    + """,
u2 AS (
  SELECT id, 1 / (1 + exp(-(list_dot_product(x, w) + model2.b))) AS p FROM u, model2
  WHERE id NOT IN (SELECT id FROM chosen)),
raw2 AS (
  SELECT id, -(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END
             + CASE WHEN p < 1 THEN (1 - p) * log2(1 - p) ELSE 0 END) AS score FROM u2)
SELECT raw2.id, round(raw2.score - e.score / (SELECT count(*) FROM labeled2), 6) AS score
FROM raw2 JOIN entropies e USING (id)"""
)

DENSITY_SQL = """
SELECT a.id, sum(1 / (1 + list_distance(a.x, b.x))) / count(*) AS score
FROM u a JOIN u b ON a.id <> b.id GROUP BY a.id"""

D2C_SQL = """,
c AS (SELECT list(m ORDER BY i) AS c FROM (
  SELECT i, avg(v) AS m FROM (
    SELECT unnest(range(1, len(x) + 1)) AS i, unnest(x) AS v FROM l) GROUP BY i))
SELECT id, 1 / (1 + list_distance(x, c)) AS score FROM u, c"""


def wrap(prefix: str, body: str, score: str = "score") -> str:
    """Round the score of ``body``, keeping the CTEs of ``prefix``."""
    return f"{prefix}, result AS ({body}) SELECT id, round({score}, {DIGITS}) AS score FROM result"


def d2c_rounded() -> str:
    head, tail = D2C_SQL.rsplit("\nSELECT", 1)
    return PAIRS_SQL + head + f", result AS (SELECT{tail}) SELECT id, round(score, 6) AS score FROM result"


# Standardised Euclidean distance: the variances come from the two sides, one stacked on the other.
SCALED = """,
sides AS ({sides}),
factors AS (SELECT list(f ORDER BY i) AS f FROM (
  SELECT i, 1 / sqrt(var_samp(v)) AS f FROM (
    SELECT unnest(range(1, len(x) + 1)) AS i, unnest(x) AS v FROM sides) GROUP BY i)),
su AS (SELECT id, list_transform(range(1, len(x) + 1), lambda i: x[i] * f[i]) AS x FROM u, factors)"""
MIDDLE_SQL = D2C_SQL.rsplit("\nSELECT", 1)[0]
D2C_SCALED_SQL = (
    PAIRS_SQL + MIDDLE_SQL + SCALED.format(sides="SELECT x FROM u UNION ALL SELECT c FROM c") + """,
result AS (SELECT id, 1 / (1 + list_distance(x, (
  SELECT list_transform(range(1, len(c) + 1), lambda i: c[i] * f[i]) FROM c, factors))) AS score FROM su)
SELECT id, round(score, 6) AS score FROM result"""
)
DENSITY_SCALED_SQL = wrap(
    PAIRS_SQL + SCALED.format(sides="SELECT x FROM u UNION ALL SELECT x FROM u"),
    DENSITY_SQL.replace("FROM u a JOIN u b", "FROM su a JOIN su b"),
)


COMBINED_HEAD = (
    SCORED_SQL + f", mm AS ({MINMAX_SQL}), {norm_sql('entropies', 'ne')}, {norm_sql('mm', 'nm')}"
)


def combined_sql(beta: str) -> str:
    return (
        COMBINED_HEAD
        + f" SELECT ne.id, round(ne.score * pow(nm.score, {beta}), 6) AS score"
        + " FROM ne JOIN nm USING (id)"
    )


# ---- distances --------------------------------------------------------------------------------

BOOLEAN = (
    "dice rogerstanimoto sokalmichener russellrao sokalsneath yule kulczynski1 kulsinski jaccard"
    " hamming matching"
).split()


def to_centre(metric: str) -> object:
    """Distance of every vector to the mean labeled vector; signs for set-like metrics, absolute
    values where a distribution is needed."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = roles(spark, sf)
        if metric in ("seuclidean", "mahalanobis"):
            frame = space(metric, rows)
            plain = frame.metric
            labeled = frame.apply(part(rows, "L"))
            every = frame.apply(rows)
        else:
            plain, labeled, every = metric, part(rows, "L"), rows
        middle = centre(labeled).scalar()
        a, c = F.col("x"), F.col("c")
        if metric in BOOLEAN:
            a, c = (F.transform(v, lambda e: (e > 0).cast("double")) for v in (a, c))
        elif metric == "jensenshannon":
            a, c = (F.transform(v, F.abs) for v in (a, c))
        d = distance(plain, a, c)
        return rounded(every.withColumn("c", middle).select("id", d.alias("d")), "d")

    return run


TT, TF, FT, FF = (
    f"CAST(sum(CASE WHEN a {x} 0 AND b {y} 0 THEN 1 ELSE 0 END) AS DOUBLE)"
    for x, y in ((">", ">"), (">", "<="), ("<=", ">"), ("<=", "<="))
)
DISTANCE_SQL = {
    "euclidean": "sqrt(sum((a - b) * (a - b)))",
    "sqeuclidean": "sum((a - b) * (a - b))",
    "cityblock": "sum(abs(a - b))",
    "chebyshev": "max(abs(a - b))",
    "minkowski": "pow(sum(pow(abs(a - b), 2)), 0.5)",
    "canberra": "sum(CASE WHEN abs(a) + abs(b) = 0 THEN 0 ELSE abs(a - b) / (abs(a) + abs(b)) END)",
    "braycurtis": "sum(abs(a - b)) / sum(abs(a + b))",
    "cosine": "1 - sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b)))",
    "correlation": "1 - corr(a, b)",
    "hamming": f"({TF} + {FT}) / count(*)",
    "matching": f"({TF} + {FT}) / count(*)",
    "jaccard": f"({TF} + {FT}) / ({TT} + {TF} + {FT})",
    "dice": f"({TF} + {FT}) / (2 * {TT} + {TF} + {FT})",
    "rogerstanimoto": f"2 * ({TF} + {FT}) / ({TT} + {FF} + 2 * ({TF} + {FT}))",
    "sokalmichener": f"2 * ({TF} + {FT}) / ({TT} + {FF} + 2 * ({TF} + {FT}))",
    "russellrao": f"(count(*) - {TT}) / count(*)",
    "sokalsneath": f"2 * ({TF} + {FT}) / ({TT} + 2 * ({TF} + {FT}))",
    "yule": f"CASE WHEN {TF} * {FT} = 0 THEN 0.0::DOUBLE ELSE 2 * {TF} * {FT} / ({TT} * {FF} + {TF} * {FT}) END",
    "kulczynski1": f"{TT} / ({TF} + {FT})",
    "kulsinski": f"({TF} + {FT} - {TT} + count(*)) / ({TF} + {FT} + count(*))",
    "seuclidean": "sqrt(sum((a - b) * (a - b) / var))",
    "jensenshannon": None,
}

DIMS_SQL = (
    "WITH"
    + POOL_SQL
    + """,
xs AS (SELECT id, role, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS a FROM pool),
c AS (SELECT i, avg(a) AS b FROM xs WHERE role = 'L' GROUP BY i),
v AS (SELECT i, var_samp(a) AS var FROM xs GROUP BY i),
d AS (SELECT id, i, a, b, var FROM xs JOIN c USING (i) JOIN v USING (i))"""
)

JS_SQL = (
    DIMS_SQL
    + """,
s AS (SELECT id, sum(abs(a)) AS sa, sum(abs(b)) AS sb FROM d GROUP BY id),
pq AS (SELECT id, abs(a) / sa AS p, abs(b) / sb AS q FROM d JOIN s USING (id)),
t AS (SELECT id, CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END
             + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END AS t FROM pq)
SELECT id, round(sqrt(greatest(sum(t), 0) / 2), 6) AS d FROM t GROUP BY id"""
)


def distance_sql(metric: str) -> str | None:
    if metric == "jensenshannon":
        return JS_SQL
    if metric not in DISTANCE_SQL:
        return None
    return DIMS_SQL + f" SELECT id, round({DISTANCE_SQL[metric]}, 6) AS d FROM d GROUP BY id"


# ---- the rest ---------------------------------------------------------------------------------


def scored_test(spark: SparkSession, sf: str) -> DataFrame:
    rows = roles(spark, sf)
    model = Discriminant().fit(part(rows, "L"))
    return model.transform(part(rows, "T")).withColumn("p1", F.get("prob", F.lit(1)))


def auc_exact(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluate.auc(scored_test(spark, sf), "p1"), "auc")


def auc_by_label_group(spark: SparkSession, sf: str) -> DataFrame:
    """AUC of all rows not in L, per id parity: grouped, with a coarse score that ties often."""
    rows = roles(spark, sf)
    model = Discriminant().fit(part(rows, "L"))
    scored = model.transform(rows.where("role <> 'L'")).select(
        (F.col("id") % 2).cast("int").alias("g"),
        F.round(F.get("prob", F.lit(1)), 1).alias("score"),
        "y",
    )
    return rounded(evaluate.auc(scored, by=["g"]), "auc")


AUC_SQL = """
r AS (SELECT *, rank() OVER ({by} ORDER BY s) + (count(*) OVER ({by_s} s) - 1) / 2 AS rk FROM t)
SELECT {g}CAST(sum(y) AS BIGINT) AS n_pos, CAST(count(*) - sum(y) AS BIGINT) AS n_neg,
  round((sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS auc
FROM r {group}"""


def auc_sql(by: str = "") -> str:
    return AUC_SQL.format(
        by=f"PARTITION BY {by}" if by else "",
        by_s=f"PARTITION BY {by + ', ' if by else ''}",
        g=f"{by}, " if by else "",
        group=f"GROUP BY {by}" if by else "",
    )


def reliability(spark: SparkSession, sf: str) -> DataFrame:
    rows = roles(spark, sf)
    scored = Discriminant().fit(part(rows, "L")).transform(part(rows, "U"))
    curve = evaluate.reliability_curve(scored.withColumn("p1", F.get("prob", F.lit(1))), "p1")
    return rounded(curve, "lo", "hi", "mean_score", "positive_rate")


def calibration(spark: SparkSession, sf: str) -> DataFrame:
    rows = roles(spark, sf)
    scored = Discriminant().fit(part(rows, "L")).transform(part(rows, "U"))
    curves = evaluate.calibration_comparison(
        scored.withColumn("p1", F.get("prob", F.lit(1))),
        {"margin": ("margin", True), "probability": ("p1", False)},
    )
    return rounded(curves, "lo", "hi", "mean_score", "positive_rate")


BINS_SQL = """
SELECT CAST(i + 1 AS INTEGER) AS bin, round(i / 10, 6) AS lo, round((i + 1) / 10, 6) AS hi,
  count(s) AS n, round(avg(s), 6) AS mean_score, round(avg(y) FILTER (s IS NOT NULL), 6) AS positive_rate{extra}
FROM range(10) b(i) LEFT JOIN {rows} ON s > i / 10 AND s <= (i + 1) / 10 GROUP BY i"""

CALIBRATION_SQL = (
    SCORED_SQL
    + ", p AS (SELECT p1 AS s, y FROM u), m AS (SELECT (margin - (SELECT min(margin) FROM u))"
    + " / ((SELECT max(margin) FROM u) - (SELECT min(margin) FROM u)) AS s, y FROM u)"
    + BINS_SQL.format(rows="p", extra=", 'probability' AS method")
    + " UNION ALL "
    + BINS_SQL.format(rows="m", extra=", 'margin' AS method")
)


def accuracy(spark: SparkSession, sf: str) -> DataFrame:
    predicted = (F.col("margin") > 0).cast("int")
    return rounded(evaluate.accuracy(scored_test(spark, sf), predicted), "accuracy")


def knn(spark: SparkSession, sf: str) -> DataFrame:
    """Ten nearest neighbours of every vector; equal distances go by id."""
    near = knn_join(vectors(spark, sf), 10)
    return near.select("id", F.col("rank").cast("int").alias("rank"), "nbr", F.round("d", 6).alias("d"))


KNN_SQL = """
base AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
near AS (
  SELECT a.id, b.id AS nbr, list_distance(a.x, b.x) AS d,
    row_number() OVER (PARTITION BY a.id ORDER BY round(list_distance(a.x, b.x), 12), b.id) AS rank
  FROM base a JOIN base b ON a.id <> b.id
  QUALIFY rank <= {k})"""

LDS_SQL = (
    "WITH"
    + KNN_SQL.format(k=10)
    + """,
shared AS (
  SELECT a.id, count(c.nbr) / 10 AS lds
  FROM near a JOIN near b ON b.id = a.id LEFT JOIN near c ON c.id = a.nbr AND c.nbr = b.nbr
  GROUP BY a.id)"""
)


def lds_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(local_density_scores(knn_join(vectors(spark, sf), 10)), "lds")


def lds(spark: SparkSession, sf: str) -> DataFrame:
    return lds_prune(vectors(spark, sf), 10, 0.5, "euclidean").select("id")


def centroid(spark: SparkSession, sf: str) -> DataFrame:
    labeled = part(roles(spark, sf), "L")
    return rounded(
        centre(labeled).select(F.posexplode("c").alias("i", "mean")), "mean"
    )


def pool_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return (
        roles(spark, sf)
        .groupBy("role")
        .agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("positive_share"))
    )


def normalised(spark: SparkSession, sf: str) -> DataFrame:
    state = state_of(spark, sf, True)
    return rounded(evaluate.min_max(get_strategy("entropy").score(state)), "score")


def u_l(spark: SparkSession, sf: str) -> DataFrame:
    return split_u_l(vectors(spark, sf), 0.9, 0).select("id", "role")


def test_split(spark: SparkSession, sf: str) -> DataFrame:
    return split_test(vectors(spark, sf), 0.25, 5).select("id", "is_test")


def folds(spark: SparkSession, sf: str) -> DataFrame:
    return stratified_folds(vectors(spark, sf), 10, 1).select("id", "y", "fold")


def taken(spark: SparkSession, sf: str) -> DataFrame:
    return take_rows(vectors(spark, sf), [0, 2, 7]).select("id", "y")


def knn_pruned(spark: SparkSession, sf: str) -> DataFrame:
    """The same neighbours, found with blocks left out by bounds."""
    rows = materialise(vectors(spark, sf).select("id", "x"), "pool")
    return rounded(nearest(rows, rows, "euclidean", 10, block_bytes=16 << 10), "d")


def mahalanobis_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Distances to the mean over three columns and a fourth that is a sum of them."""
    x = F.col("x")
    few = F.array(x[0], 1000 * x[1], x[2], x[0] + 1000 * x[1] - x[2])
    rows = materialise(vectors(spark, sf).select("id", few.alias("x")), "columns")
    frame = space("mahalanobis", rows)
    middle = centre(frame.apply(rows)).scalar()
    d = distance(frame.metric, F.col("_c"), F.col("x"))
    return rounded(frame.apply(rows).withColumn("_c", middle).select("id", d.alias("d")), "d")


# The inverse of a covariance of three columns, written out.
MAHALANOBIS_SQL = f"""WITH v AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS a, 1000 * embedding[2]::DOUBLE AS b,
  embedding[3]::DOUBLE AS c FROM embeddings),
m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, var_samp(a) AS aa, var_samp(b) AS bb, var_samp(c) AS cc,
  covar_samp(a, b) AS ab, covar_samp(a, c) AS ac, covar_samp(b, c) AS bc FROM v),
g AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM m),
x AS (SELECT id, a - ma AS a, b - mb AS b, c - mc AS c, g.* EXCLUDE (ma, mb, mc) FROM v, g)
SELECT id, round(sqrt((a * a * (bb * cc - bc * bc) + b * b * (aa * cc - ac * ac) + c * c * (aa * bb - ab * ab)
  + 2 * a * b * (ac * bc - ab * cc) + 2 * a * c * (ab * bc - ac * bb) + 2 * b * c * (ab * ac - aa * bc)) / det), {DIGITS}) AS d
FROM x"""


def nearest_labeled(spark: SparkSession, sf: str) -> DataFrame:
    """The three nearest labeled rows of every unlabeled one."""
    rows = materialise(roles(spark, sf), "roles")
    out = nearest(part(rows, "U"), part(rows, "L"), "cityblock", 3, block_bytes=8 << 10)
    return rounded(out, "d")


def ml_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = roles(spark, sf)
    return part(rows, "U").select("id", "x", "y"), part(rows, "T").select("id", "x", "y")


def svm_margins(spark: SparkSession, sf: str) -> DataFrame:
    train, test = ml_rows(spark, sf)
    return models.LinearModel(models.hinge()).fit(train).transform(test).select("id", "y", "margin")


def certified(spark: SparkSession, found: list) -> DataFrame:
    rows = [(c.alpha, c.objective, c.dual, c.gap, c.subgradient, *more) for c, *more in found]
    kinds = "alpha double, objective double, dual double, gap double, subgradient double"
    if len(rows[0]) > 5:
        kinds += ", w array<double>, b double"
    return rounded(spark.createDataFrame(rows, kinds), "objective", "dual", "gap", "subgradient")


def svm_certificate(spark: SparkSession, sf: str) -> DataFrame:
    """Hinge models of the usual and a stronger penalty: weights and how far each is from the best."""
    train = materialise(ml_rows(spark, sf)[0], "train")
    found = []
    for alpha in (1e-4, 0.1):
        w, b = hinge_weights(models.LinearModel(models.hinge(alpha)).fit(train))
        found.append((hinge_certificates(train, w, b, [alpha])[0], w, b))
    return certified(spark, found)


def closed_form_certificate(spark: SparkSession, sf: str) -> DataFrame:
    """How far the closed-form weights are from the best hinge model, for several penalties."""
    train, _ = ml_rows(spark, sf)
    model = Discriminant().fit(train)
    return certified(
        spark, [(c,) for c in hinge_certificates(train, model.w, model.b, models.ALPHA_GRID)]
    )


def log_loss_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    train, test = ml_rows(spark, sf)
    out = models.LinearModel(models.log_loss()).fit(train).transform(test)
    return out.select("id", "y", "margin", F.get("prob", F.lit(1)).alias("p1"))


def platt_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    train, test = ml_rows(spark, sf)
    out = models.PlattScaled(models.hinge()).fit(train).transform(test)
    return out.select("id", "y", "margin", F.get("prob", F.lit(1)).alias("p1"))


def platt_newton(spark: SparkSession, sf: str) -> DataFrame:
    """Test rows scored by the discriminant and calibrated by Newton steps."""
    train, test = ml_rows(spark, sf)
    out = PlattNewton().fit(train).transform(test)
    return rounded(out.select("id", "y", "margin", F.get("prob", F.lit(1)).alias("p1")), "margin", "p1")


def log_loss_newton(spark: SparkSession, sf: str) -> DataFrame:
    """Log-loss models on one margin for several penalties: weight, intercept and loss."""
    train, _ = ml_rows(spark, sf)
    rows = materialise(margin_rows(Discriminant().fit(train), train), "margins")
    fits = newton_fits(rows, {a: a for a in models.ALPHA_GRID})
    found = [(a, f.w[0], f.b, f.loss) for a, f in fits.items()]
    return rounded(
        spark.createDataFrame(found, "alpha double, w double, b double, loss double"), "w", "b", "loss"
    )


def c_grid_platt(spark: SparkSession, sf: str) -> DataFrame:
    """Calibrations of one model over the grid of C."""
    train, _ = ml_rows(spark, sf)
    fits = platt_grid(Discriminant().fit(train), train, models.C_GRID)
    found = [(c, f.w[0], f.b, f.loss) for c, f in fits.items()]
    return rounded(
        spark.createDataFrame(found, "c double, w double, b double, loss double"), "w", "b", "loss"
    )


def cv_platt(spark: SparkSession, sf: str) -> DataFrame:
    """Cross-validation of the calibrated model over five folds."""
    rows = stratified_folds(vectors(spark, sf), 5, 1)
    return rounded(models.cross_validate_model(PlattNewton, rows, range(5)), "auc", "log_loss")


def calibration_platt(spark: SparkSession, sf: str) -> DataFrame:
    """Reliability of the test rows' probabilities as they come and after Platt scaling."""
    train, test = ml_rows(spark, sf)
    model = PlattNewton().fit(train)
    both = model.base.transform(test).select("id", "y", F.get("prob", F.lit(1)).alias("raw")).join(
        model.transform(test).select("id", F.get("prob", F.lit(1)).alias("platt")), "id"
    )
    curves = evaluate.calibration_comparison(both, {"raw": ("raw", False), "platt": ("platt", False)})
    return rounded(curves, "lo", "hi", "mean_score", "positive_rate")


def certificate_sql() -> str:
    """The bound row by row and dimension by dimension."""
    return (
        "WITH"
        + POOL_SQL
        + ", train AS (SELECT id, x, y FROM pool WHERE role = 'U'),"
        + model_sql("train", "model")
        + f""",
margins AS (SELECT id, x, y, 2 * y - 1 AS s, (2 * y - 1) * (list_dot_product(x, w) + b) AS m FROM train, model),
alphas AS (SELECT unnest({list(models.ALPHA_GRID)})::DOUBLE AS alpha),
widths AS (SELECT unnest({list(WIDTHS)})::DOUBLE AS width),
weights AS (
  SELECT *, CASE WHEN width > 0 THEN greatest(0, least(1, 0.5 + (1 - m) / width))
    WHEN m < 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS a
  FROM margins, widths),
totals AS (SELECT width, y, sum(a) AS t FROM weights GROUP BY width, y),
evened AS (SELECT width, y, CASE WHEN t > 0 THEN min(t) OVER (PARTITION BY width) / t ELSE 0 END AS f FROM totals),
cells AS (
  SELECT width, s * a AS plain, s * a * f AS even, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS v
  FROM weights JOIN evened USING (width, y)),
sums AS (SELECT width, i, sum(plain * v) AS p, sum(even * v) AS e FROM cells GROUP BY width, i),
size AS (SELECT count(*) AS n, avg(greatest(0, 1 - m)) AS loss FROM margins),
norms AS (SELECT width, sum((e / n) ** 2) AS vv FROM sums, size GROUP BY width),
means AS (SELECT width, sum(a * f) / max(n) AS mean FROM weights JOIN evened USING (width, y), size GROUP BY width),
scales AS (
  SELECT alpha, mean, vv / alpha AS curve, CASE WHEN vv / alpha <= mean THEN 1 ELSE mean / (vv / alpha) END AS t
  FROM means JOIN norms USING (width), alphas),
duals AS (SELECT alpha, greatest(0, max(t * mean - t * t * curve / 2)) AS dual FROM scales GROUP BY alpha),
wi AS (SELECT unnest(range(1, len(w) + 1)) AS i, unnest(w) AS wv FROM model),
steps AS (SELECT sum(s * a) AS net FROM weights WHERE width = 0),
slopes AS (
  SELECT alpha, sqrt(sum((alpha * wv - p / n) ** 2) + max((net / n) ** 2)) AS subgradient, sum(wv * wv) AS ww
  FROM sums JOIN wi USING (i), size, steps, alphas WHERE width = 0 GROUP BY alpha)
SELECT alpha, round(loss + alpha / 2 * ww, 6) AS objective, round(dual, 6) AS dual,
  round(loss + alpha / 2 * ww - dual, 6) AS gap, round(subgradient, 6) AS subgradient
FROM slopes JOIN duals USING (alpha), size"""
    )


NEWTON_STEPS = 25


def newton_sql(rows: str, penalties: str, out: str) -> str:
    """CTEs of plain Newton steps from zero on ``rows (model, m, y)`` with ``penalties (model, alpha)``."""
    p = "(1 / (1 + exp(-(w * m + b))))"
    return f"""
{out}_steps AS (
  SELECT model, alpha, 0 AS i, 0.0::DOUBLE AS w, 0.0::DOUBLE AS b FROM {penalties}
  UNION ALL
  SELECT model, alpha, i + 1, w - (gw * hbb - gb * hwb) / (hww * hbb - hwb * hwb),
    b - (gb * hww - gw * hwb) / (hww * hbb - hwb * hwb)
  FROM (
    SELECT model, alpha, i, w, b, avg(m * ({p} - y)) + alpha * w AS gw, avg({p} - y) AS gb,
      avg(m * m * {p} * (1 - {p})) + alpha AS hww, avg(m * {p} * (1 - {p})) AS hwb, avg({p} * (1 - {p})) AS hbb
    FROM {out}_steps JOIN {rows} USING (model) WHERE i < {NEWTON_STEPS} GROUP BY model, alpha, i, w, b)),
{out} AS MATERIALIZED (SELECT model, alpha, w, b FROM {out}_steps WHERE i = {NEWTON_STEPS})"""


# The closed-form model trained on U, as ``ml_rows`` has it, and its margins on U and T.
ML_SQL = (
    "WITH RECURSIVE" + POOL_SQL + ", u AS (SELECT * FROM pool WHERE role = 'U')," + model_sql("u", "model")
    + """,
margins AS MATERIALIZED (SELECT id, y, role, list_dot_product(x, w) + b AS m FROM pool, model)"""
)
NEWTON_LOSS = """avg(ln(1 + exp(-abs(w * m + b))) + greatest(w * m + b, 0) - y * (w * m + b))
    + any_value(alpha) * any_value(w) * any_value(w) / 2"""


def penalties_sql(name: str, values, alpha: str) -> str:
    """Several models on the same rows."""
    rows = ", ".join(f"({v!r}::DOUBLE)" for v in values)
    return f""",
pen AS (SELECT {name} AS model, {alpha} AS alpha FROM (VALUES {rows}) t({name}), (SELECT count(*) AS n FROM u)),
rows_m AS MATERIALIZED (SELECT model, m, y FROM margins, pen WHERE role = 'U'),
{newton_sql("rows_m", "pen", "fits")}
SELECT model AS {name}, round(any_value(w), 6) AS w, round(any_value(b), 6) AS b, round({NEWTON_LOSS}, 6) AS loss
FROM fits JOIN rows_m USING (model) GROUP BY model"""


PLATT_SQL = (
    ML_SQL
    + """,
pen AS (SELECT 0 AS model, 1 / count(*)::DOUBLE AS alpha FROM u),
rows_m AS (SELECT 0 AS model, m, y FROM margins WHERE role = 'U'),"""
    + newton_sql("rows_m", "pen", "fit")
    + """,
t AS (SELECT id, y, m, 1 / (1 + exp(-m)) AS raw, 1 / (1 + exp(-(w * m + b))) AS platt FROM margins, fit WHERE role = 'T')"""
)

CV_PLATT_SQL = f"""WITH RECURSIVE
base AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, CAST(label % 2 AS INTEGER) AS y FROM embeddings),
folded AS MATERIALIZED (SELECT *, CAST((row_number() OVER (ORDER BY y, md5('1:' || id), id) - 1) % 5 AS INTEGER) AS home
  FROM base),
tr AS MATERIALIZED (SELECT CAST(f AS INTEGER) AS fold, id, x, y FROM folded, range(5) t(f) WHERE home <> f),
{model_sql("tr", "mo", ("fold",))},
rows_m AS MATERIALIZED (SELECT fold AS model, list_dot_product(x, w) + b AS m, y FROM tr JOIN mo USING (fold)),
pen AS (SELECT model, 1 / count(*)::DOUBLE AS alpha FROM rows_m GROUP BY model),
{newton_sql("rows_m", "pen", "fits")},
t AS (
  SELECT home AS fold, y, 1 / (1 + exp(-(f.w * (list_dot_product(x, mo.w) + mo.b) + f.b))) AS s
  FROM folded JOIN mo ON mo.fold = home JOIN fits f ON f.model = home),
c AS (SELECT *, greatest(least(s, 1 - 1e-15), 1e-15) AS p FROM t),
loss AS (SELECT fold, avg(-CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END) AS log_loss FROM c GROUP BY fold),
area AS (
  SELECT a.fold, avg(CASE WHEN a.s > z.s THEN 1 WHEN a.s = z.s THEN 0.5 ELSE 0 END::DOUBLE) AS auc
  FROM t a JOIN t z ON a.fold = z.fold AND a.y = 1 AND z.y = 0 GROUP BY a.fold)
SELECT fold, round(auc, 6) AS auc, round(log_loss, 6) AS log_loss FROM area JOIN loss USING (fold)"""


def cv_auc(spark: SparkSession, sf: str) -> DataFrame:
    rows = models.with_vector(stratified_folds(vectors(spark, sf), 10, 1)).select("y", "fold", "features")
    mean, spread = models.cross_validate(models.hinge(), rows, 10)
    return spark.createDataFrame([(mean, spread)], "auc double, spread double")


def grid(spark: SparkSession, sf: str) -> DataFrame:
    rows = models.with_vector(stratified_folds(vectors(spark, sf), 5, 1)).select("y", "fold", "features")
    _, results = models.grid_search(models.hinge(), "regParam", models.ALPHA_GRID, rows, 5)
    return spark.createDataFrame(results, "alpha double, auc double")


QUERIES = {
    "split_u_l": (
        u_l,
        """
        SELECT vec_id AS id, CASE WHEN row_number() OVER (ORDER BY md5('0:' || vec_id), vec_id)
          <= ceil(0.9::DOUBLE * count(*) OVER ()) THEN 'U' ELSE 'L' END AS role FROM embeddings""",
    ),
    "split_test": (
        test_split,
        """
        SELECT vec_id AS id, row_number() OVER (ORDER BY md5('5:' || vec_id), vec_id)
          <= ceil(0.25::DOUBLE * count(*) OVER ()) AS is_test FROM embeddings""",
    ),
    "stratified_folds": (
        folds,
        """
        SELECT id, y, CAST((row_number() OVER (ORDER BY y, md5('1:' || id), id) - 1) % 10 AS INTEGER)
          AS fold FROM (SELECT vec_id AS id, CAST(label % 2 AS INTEGER) AS y FROM embeddings)""",
    ),
    "take_rows": (
        taken,
        "SELECT vec_id AS id, CAST(label % 2 AS INTEGER) AS y FROM embeddings WHERE vec_id IN (0, 2, 7)",
    ),
    "pool_sizes": (
        pool_sizes,
        f"WITH{POOL_SQL} SELECT role, count(*) AS n, round(avg(y), 6) AS positive_share FROM pool GROUP BY role",
    ),
    "centroid": (
        centroid,
        f"WITH{POOL_SQL} SELECT CAST(i - 1 AS INTEGER) AS i, round(avg(v), 6) AS mean FROM (SELECT "
        "unnest(range(1, len(x) + 1)) AS i, unnest(x) AS v FROM pool WHERE role = 'L') GROUP BY i",
    ),
    "score_random": (
        score_query(lambda: get_strategy("random")),
        f"WITH{POOL_SQL} SELECT id, CAST(count(*) OVER () AS DOUBLE) AS score FROM pool WHERE role = 'U'",
    ),
    "score_simple_margin": (
        score_query(lambda: get_strategy("simple_margin")),
        SCORED_SQL + final("abs(margin)", "u"),
    ),
    "score_margin": (
        score_query(lambda: get_strategy("margin")),
        SCORED_SQL + final("abs(2 * p1 - 1)", "u"),
    ),
    "score_entropy": (score_query(lambda: get_strategy("entropy")), SCORED_SQL + final("score", "entropies")),
    "score_least_confidence": (
        score_query(lambda: get_strategy("least_confidence")),
        SCORED_SQL + final("1 - greatest(p1, 1 - p1)", "u"),
    ),
    "score_lcb": (
        score_query(lambda: get_strategy("lcb")),
        SCORED_SQL + final(bias_sql("greatest(p1, 1 - p1)", "((0.5 + 1 - share) / 2)"), "u, l"),
    ),
    "score_lcb2": (
        score_query(lambda: get_strategy("lcb2")),
        SCORED_SQL
        + ", w AS (SELECT n / (SELECT count(*) FROM u) AS w, share FROM l)"
        + final(bias_sql("p1", "((1 - w) * (1 - share) + 0.5 * w)"), "u, w"),
    ),
    "score_d2c": (score_query(lambda: get_strategy("d2c")), d2c_rounded()),
    "score_minmax": (
        score_query(lambda: get_strategy("minmax")),
        wrap("WITH" + POOL_SQL + ", u AS (SELECT * FROM pool WHERE role = 'U')", MINMAX_SQL),
    ),
    "score_d2c_seuclidean": (
        score_query(lambda: get_strategy("d2c", metric="seuclidean")), D2C_SCALED_SQL
    ),
    "score_density_seuclidean": (
        score_query(lambda: get_strategy("density", metric="seuclidean")), DENSITY_SCALED_SQL
    ),
    "score_density": (score_query(lambda: get_strategy("density")), wrap(PAIRS_SQL, DENSITY_SQL)),
    "score_minmax_cosine": (
        score_query(lambda: get_strategy("minmax", metric="cosine")),
        wrap(
            "WITH" + POOL_SQL + ", u AS (SELECT * FROM pool WHERE role = 'U')",
            MINMAX_SQL.replace("list_distance", "list_cosine_distance"),
        ),
    ),
    "score_density_cosine": (
        score_query(lambda: get_strategy("density", metric="cosine")),
        wrap(PAIRS_SQL, DENSITY_SQL.replace("list_distance", "list_cosine_distance")),
    ),
    "score_combined": (
        score_query(lambda: Combined(get_strategy("entropy"), get_strategy("minmax"))),
        combined_sql("1"),
    ),
    "score_combined_dynamic": (
        score_query(lambda: Combined(get_strategy("entropy"), get_strategy("minmax"), beta="dynamic")),
        combined_sql("(2 * (SELECT count(*) FROM u) / (SELECT n FROM l))"),
    ),
    "score_model_change": (model_change, MODEL_CHANGE_SQL),
    "score_normalised": (normalised, SCORED_SQL + ", " + norm_sql("entropies", "ne") + final("score", "ne")),
    "pick_random": (
        pick_query(lambda: get_strategy("random", seed=420)),
        f"WITH{POOL_SQL} SELECT id, CAST(row_number() OVER (ORDER BY md5('420:' || id), id) - 1 AS INTEGER)"
        " AS draw FROM pool WHERE role = 'U' ORDER BY md5('420:' || id), id LIMIT 10",
    ),
    "pick_entropy": (
        pick_query(lambda: get_strategy("entropy")),
        SCORED_SQL + pick_sql("SELECT * FROM entropies", "DESC"),
    ),
    "pick_simple_margin": (
        pick_query(lambda: get_strategy("simple_margin")),
        SCORED_SQL + pick_sql("SELECT id, abs(margin) AS score FROM u", "ASC"),
    ),
    "pick_minmax": (
        pick_query(lambda: get_strategy("minmax")),
        "WITH" + POOL_SQL + ", u AS (SELECT * FROM pool WHERE role = 'U')" + pick_sql(MINMAX_SQL, "DESC"),
    ),
    "pick_density": (pick_query(lambda: get_strategy("density")), PAIRS_SQL + pick_sql(DENSITY_SQL, "ASC")),
    "auc_exact": (
        auc_exact,
        SCORED_SQL + ", t AS (SELECT p1 AS s, y FROM scored WHERE role = 'T')," + auc_sql(),
    ),
    "auc_grouped_ties": (
        auc_by_label_group,
        SCORED_SQL
        + ", t AS (SELECT CAST(id % 2 AS INTEGER) AS g, round(p1, 1) AS s, y FROM scored WHERE role <> 'L'),"
        + auc_sql("g"),
    ),
    "accuracy": (
        accuracy,
        SCORED_SQL
        + " SELECT round(avg(CASE WHEN (margin > 0) = (y = 1) THEN 1 ELSE 0 END), 6) AS accuracy"
        + " FROM scored WHERE role = 'T'",
    ),
    "reliability_curve": (
        reliability,
        SCORED_SQL + ", p AS (SELECT p1 AS s, y FROM u)" + BINS_SQL.format(rows="p", extra=""),
    ),
    "calibration_comparison": (calibration, CALIBRATION_SQL),
    "knn_join": (
        knn,
        "WITH" + KNN_SQL.format(k=10) + " SELECT id, CAST(rank AS INTEGER) AS rank, nbr, round(d, 6) AS d FROM near",
    ),
    "knn_pruned": (
        knn_pruned,
        "WITH" + KNN_SQL.format(k=10) + " SELECT id, CAST(rank AS INTEGER) AS rank, nbr, round(d, 6) AS d FROM near",
    ),
    "mahalanobis_columns": (mahalanobis_columns, MAHALANOBIS_SQL),
    "nearest_labeled": (
        nearest_labeled,
        PAIRS_SQL
        + """, p AS (
  SELECT u.id, l.id AS nbr, list_sum(list_transform(list_zip(u.x, l.x), lambda z: abs(z[1] - z[2]))) AS d FROM u, l),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(d, 12), nbr) AS rank FROM p)
SELECT id, CAST(rank AS INTEGER) AS rank, nbr, round(d, 6) AS d FROM r WHERE rank <= 3""",
    ),
    "lds_scores": (lds_scores, LDS_SQL + " SELECT id, round(lds, 6) AS lds FROM shared"),
    "lds_prune": (lds, LDS_SQL + " SELECT id FROM shared WHERE lds >= 0.5"),
    "svm_margins": (svm_margins, None),
    # The best hinge model is iterative; the unit tests check bound and weights by brute force.
    "svm_certificate": (svm_certificate, None),
    "closed_form_certificate": (closed_form_certificate, certificate_sql()),
    "log_loss_probabilities": (log_loss_probabilities, None),
    "platt_probabilities": (platt_probabilities, None),
    "platt_newton": (
        platt_newton, PLATT_SQL + " SELECT id, y, round(m, 6) AS margin, round(platt, 6) AS p1 FROM t"
    ),
    "log_loss_newton": (log_loss_newton, ML_SQL + penalties_sql("alpha", models.ALPHA_GRID, "alpha")),
    "c_grid_platt": (c_grid_platt, ML_SQL + penalties_sql("c", models.C_GRID, "1 / (c * n)")),
    "cv_platt": (cv_platt, CV_PLATT_SQL),
    "calibration_platt": (
        calibration_platt,
        PLATT_SQL
        + ", r AS (SELECT raw AS s, y FROM t), k AS (SELECT platt AS s, y FROM t)"
        + BINS_SQL.format(rows="r", extra=", 'raw' AS method")
        + " UNION ALL "
        + BINS_SQL.format(rows="k", extra=", 'platt' AS method"),
    ),
    "cv_auc": (cv_auc, None),
    "grid_search": (grid, None),
}
for _metric in [*DISTANCES, "seuclidean", "mahalanobis"]:
    QUERIES[f"dist_{_metric}"] = (to_centre(_metric), distance_sql(_metric))
