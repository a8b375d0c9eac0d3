"""Queries on acquisition rounds and learning curves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelpool.operators import evaluate
from labelpool.operators.moments import Discriminant
from labelpool.operators.pool import move_to_labeled, next_batch
from labelpool.operators.rounds import ActiveLearner, experiment, fold_rounds
from labelpool.operators.splits import split_test, stratified_folds, test_rows, training_rows
from labelpool.operators.strategies import KCenter, get_strategy
from labelpool.queries.pool import POOL_SQL, SCORED_SQL, auc_sql, model_sql, part, roles, rounded, vectors
from labelpool.session import materialise, new_table_dir
from labelpool.sources.readers import read_results
from labelpool.sources.writers import write_choices, write_curves

FOLDS, ROUNDS, BATCH = 3, 3, 5
ITEM_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
STRATEGIES = ("entropy", "margin", "random")


def folded(spark: SparkSession, sf: str) -> DataFrame:
    return stratified_folds(vectors(spark, sf), FOLDS, 1)


def curves(spark: SparkSession, sf: str, strategies=STRATEGIES) -> DataFrame:
    """Curves of several strategies, kept as one small written table."""
    rows = materialise(folded(spark, sf), "folds")
    parts = [
        fold_rounds(rows, s, FOLDS, ROUNDS, BATCH)[0].withColumn("strategy", F.lit(s))
        for s in strategies
    ]
    return materialise(reduce(lambda a, b: a.unionByName(b), parts), "curves")


def learning_curve(spark: SparkSession, sf: str) -> DataFrame:
    out, _ = fold_rounds(folded(spark, sf), "entropy", FOLDS, ROUNDS, BATCH)
    return rounded(out.select("fold", "draw", F.col("labeled").cast("long").alias("labeled"), "auc"), "auc")


def acquire_rounds(spark: SparkSession, sf: str) -> DataFrame:
    _, choices = fold_rounds(folded(spark, sf), "entropy", FOLDS, ROUNDS, BATCH)
    return choices.select("fold", F.col("draw").cast("int").alias("draw"), "id", "y")


def acquire_rounds_large(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of 5,000 order lines a fold, which no task orders as a whole. Items of one order
    line are one row with the largest of their values."""
    items = (
        spark.read.parquet(f"{sf}/lineitem.parquet")
        .groupBy((F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("id"))
        .agg(
            F.array(*[F.max(F.col(c).cast("double")) for c in ITEM_COLUMNS]).alias("x"),
            F.max((F.col("l_returnflag") == "R").cast("int")).alias("y"),
        )
    )
    _, choices = fold_rounds(stratified_folds(items, FOLDS, 1), "entropy", FOLDS, 2, 5000)
    return choices.select("fold", F.col("draw").cast("int").alias("draw"), "id", "y")


def choices_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The choice order as it is stored by strategy and iteration, read again."""
    _, choices = fold_rounds(folded(spark, sf), "entropy", FOLDS, ROUNDS, BATCH)
    path = new_table_dir(spark, "choices")
    tagged = choices.select(
        F.lit("entropy").alias("strategy"), F.lit(1).alias("iteration"), "fold",
        F.col("draw").cast("int").alias("draw"), "id", "y",
    )
    write_choices(tagged, path)
    schema = "strategy string, iteration int, fold int, draw int, id long, y int"
    return read_results(spark, path, [1], schema=schema).select("strategy", "iteration", "fold", "draw", "id", "y")


def mean_curve(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluate.mean_curve(curves(spark, sf)), "auc")


def first_reach(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.first_reach(evaluate.mean_curve(curves(spark, sf)), 0.5)


def alc(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluate.normalised_alc(evaluate.mean_curve(curves(spark, sf))), "alc")


def merged_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of two seeds, stored by iteration and read back: mean per draw over iterations."""
    path = new_table_dir(spark, "results")
    for iteration in (1, 2):
        rows = stratified_folds(vectors(spark, sf), FOLDS, iteration)
        out, _ = fold_rounds(rows, "entropy", FOLDS, 2, BATCH, seed=iteration)
        write_curves(
            out.select(
                F.lit("entropy").alias("strategy"),
                F.lit(iteration).alias("iteration"),
                F.col("fold").cast("int").alias("fold"),
                F.col("draw").cast("int").alias("draw"),
                "auc",
            ),
            path,
        )
    stored = read_results(spark, path, [1, 2])
    per_run = evaluate.mean_curve(stored, ["strategy", "iteration"])
    return rounded(evaluate.mean_curve(per_run, ["strategy"], "iteration"), "auc")


def fold_auc(spark: SparkSession, sf: str) -> DataFrame:
    """AUC of the closed-form model per fold, its mean and twice its deviation."""
    rows = materialise(folded(spark, sf), "folds")
    out, _ = fold_rounds(rows, "random", FOLDS, 1, BATCH)
    return rounded(evaluate.fold_summary(out), "auc", "spread")


def loop_choices(spark: SparkSession, sf: str) -> DataFrame:
    """The general loop, one strategy on a held-out quarter: choices in order."""
    rows = materialise(split_test(vectors(spark, sf), 0.25, 5), "split")
    learner = ActiveLearner(get_strategy("entropy"), u_share=0.9, seed=3, batch_size=4)
    run = learner.run(rows.where(~F.col("is_test")), rows.where("is_test"), ndraws=8)
    return run.choices


def pair_loop(strategy: str):
    """The general loop with a strategy over pairs, whose statistics are kept up from round to
    round: three batches of four, computed anew after the second."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = materialise(split_test(vectors(spark, sf), 0.25, 5), "split")
        learner = ActiveLearner(get_strategy(strategy), u_share=0.9, seed=3, batch_size=4, refresh=2)
        return learner.run(rows.where(~F.col("is_test")), rows.where("is_test"), ndraws=12).choices

    return run


def pick_kcenter(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty rows, each the farthest from L and from those picked before it."""
    rows = roles(spark, sf)
    out = next_batch(part(rows, "U"), part(rows, "L"), KCenter(), 20)
    return rounded(out.select("id", F.col("draw").cast("int").alias("draw"), "score"), "score")


def experiment_curves(spark: SparkSession, sf: str) -> DataFrame:
    """Distance strategies by the general loop over all three folds."""
    rows = materialise(folded(spark, sf), "folds")
    learners = {
        "d2c": ActiveLearner(get_strategy("d2c"), batch_size=5),
        "minmax": ActiveLearner(get_strategy("minmax"), batch_size=5),
    }
    out, _ = experiment(rows, learners, [0, 1, 2], ndraws=10)
    return rounded(out, "auc")


def partial_fit(spark: SparkSession, sf: str) -> DataFrame:
    """A model fitted on L and updated with the test rows equals one fitted on both."""
    rows = roles(spark, sf)
    model = Discriminant().fit(part(rows, "L")).partial_fit(part(rows, "T"))
    scored = model.transform(part(rows, "U")).select("id", "margin")
    return rounded(scored, "margin")


def moved(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of both pools after moving the rows with ids below a bound found in the pool."""
    rows = roles(spark, sf)
    u, labeled = part(rows, "U"), part(rows, "L")
    u2, labeled2 = move_to_labeled(u, labeled, u.where("id % 3 = 0").select("id"))
    both = u2.select(F.lit("U").alias("role"), "id").unionByName(
        labeled2.select(F.lit("L").alias("role"), "id")
    )
    return both


def fold_sides(spark: SparkSession, sf: str) -> DataFrame:
    """Training and test side of every fold."""
    rows = folded(spark, sf)
    sides = [
        part_.agg(F.count("*").alias("n"), F.sum(F.col("y").cast("long")).alias("pos")).select(
            F.lit(f).alias("fold"), F.lit(side).alias("side"), "n", "pos"
        )
        for f in range(FOLDS)
        for side, part_ in (("train", training_rows(rows, f)), ("test", test_rows(rows, f)))
    ]
    return reduce(lambda a, b: a.unionByName(b), sides)


# ---- SQL --------------------------------------------------------------------------------------

BASE_SQL = """
base AS (
  SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, CAST(label % 2 AS INTEGER) AS y
  FROM embeddings)"""


def folded_sql(seed: int, out: str = "folded") -> str:
    return f"""
{out} AS (
  SELECT id, x, y,
    CAST((row_number() OVER (ORDER BY y, md5('{seed}:' || id), id) - 1) % {FOLDS} AS INTEGER) AS home
  FROM base)"""


ENTROPY = (
    "-(CASE WHEN p1 > 0 THEN p1 * log2(p1) ELSE 0 END"
    " + CASE WHEN p1 < 1 THEN (1 - p1) * log2(1 - p1) ELSE 0 END)"
)
ORDERS = {
    "entropy": f"round({ENTROPY}, 9) DESC, id",
    "margin": "round(abs(2 * p1 - 1), 9), id",
    "random": "md5('{seed}:' || id), id",
}


def rounds_sql(strategy: str, rounds: int, seed: int = 0, folded_name: str = "folded", p: str = "", batch: int = BATCH) -> str:
    """CTEs of the unrolled rounds; ends in {p}curve and {p}choices."""
    order = ORDERS[strategy].format(seed=seed)
    out = f"""
{p}split AS (
  SELECT fold, id, x, y, row_number() OVER (PARTITION BY fold ORDER BY md5('{seed}-' || fold || ':' || id))
    <= ceil(0.9::DOUBLE * count(*) OVER (PARTITION BY fold)) AS in_u
  FROM (SELECT CAST(f AS INTEGER) AS fold, id, x, y FROM {folded_name}, range({FOLDS}) t(f) WHERE home <> f)),
{p}l0 AS (SELECT fold, id, x, y FROM {p}split WHERE NOT in_u),
{p}u0 AS (SELECT fold, id, x, y FROM {p}split WHERE in_u)"""
    for r in range(rounds):
        out += ", " + model_sql(f"{p}l{r}", f"{p}m{r}", ("fold",))
        out += f""",
{p}s{r} AS (
  SELECT u.*, 1 / (1 + exp(-(list_dot_product(u.x, m.w) + m.b))) AS p1
  FROM {p}u{r} u JOIN {p}m{r} m USING (fold)),
{p}b{r} AS (
  SELECT *, row_number() OVER (PARTITION BY fold ORDER BY {order}) AS rn FROM {p}s{r}
  QUALIFY rn <= {batch}),
{p}l{r + 1} AS (SELECT fold, id, x, y FROM {p}l{r} UNION ALL SELECT fold, id, x, y FROM {p}b{r}),
{p}u{r + 1} AS (SELECT u.* FROM {p}u{r} u ANTI JOIN {p}b{r} b ON u.fold = b.fold AND u.id = b.id)"""
    models = " UNION ALL ".join(
        f"SELECT CAST({r} AS INTEGER) AS draw, fold, w, b, labeled FROM {p}m{r}" for r in range(rounds)
    )
    picks = " UNION ALL ".join(
        f"SELECT fold, CAST({r * batch} + rn - 1 AS INTEGER) AS draw, id, y FROM {p}b{r}" for r in range(rounds)
    )
    return (
        out
        + f""",
{p}models AS ({models}),
{p}t AS (
  SELECT fold, draw, labeled, y, 1 / (1 + exp(-(list_dot_product(x, w) + b))) AS s
  FROM {folded_name} f JOIN {p}models m ON f.home = m.fold),
{p}r AS (
  SELECT *, rank() OVER (PARTITION BY fold, draw ORDER BY s)
    + (count(*) OVER (PARTITION BY fold, draw, s) - 1) / 2 AS rk FROM {p}t),
{p}curve AS (
  SELECT fold, draw, CAST(max(labeled) AS BIGINT) AS labeled,
    (sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS auc
  FROM {p}r GROUP BY fold, draw),
{p}choices AS ({picks})"""
    )


ONE_SQL = f"WITH{BASE_SQL},{folded_sql(1)}," + rounds_sql("entropy", ROUNDS)
ALL_SQL = (
    f"WITH{BASE_SQL},{folded_sql(1)},"
    + ", ".join(rounds_sql(s, ROUNDS, p=f"{s}_") for s in STRATEGIES)
    + ", per_fold AS ("
    + " UNION ALL ".join(f"SELECT '{s}' AS strategy, * FROM {s}_curve" for s in STRATEGIES)
    + "), mean_curve AS (SELECT strategy, draw, avg(auc) AS auc FROM per_fold GROUP BY strategy, draw)"
)
MERGED_SQL = (
    f"WITH{BASE_SQL},"
    + ", ".join(
        folded_sql(i, f"folded{i}") + "," + rounds_sql("entropy", 2, i, f"folded{i}", f"i{i}_")
        for i in (1, 2)
    )
    + ", runs AS (SELECT 1 AS iteration, * FROM i1_curve UNION ALL SELECT 2, * FROM i2_curve),"
    " means AS (SELECT iteration, draw, avg(auc) AS auc FROM runs GROUP BY iteration, draw)"
    " SELECT 'entropy' AS strategy, draw, round(avg(auc), 6) AS auc FROM means GROUP BY draw"
)


LOOP_SQL = f"""WITH{BASE_SQL},
q AS (SELECT *, row_number() OVER (ORDER BY md5('5:' || id), id) <= ceil(0.25::DOUBLE * count(*) OVER ()) AS t FROM base),
s AS (SELECT id, x, y, row_number() OVER (ORDER BY md5('3:' || id), id) <= ceil(0.9::DOUBLE * count(*) OVER ()) AS in_u
  FROM q WHERE NOT t),
l0 AS (SELECT id, x, y FROM s WHERE NOT in_u), u0 AS (SELECT id, x, y FROM s WHERE in_u)"""


def pair_loop_sql(score: str, other: str, order: str) -> str:
    """Three rounds of four rows; every round compares all pairs again."""
    out = LOOP_SQL
    for r in range(3):
        out += f""",
p{r} AS (SELECT u.id, u.y, {score} AS score FROM u{r} u, {other}{r} o WHERE u.id <> o.id GROUP BY u.id, u.y),
b{r} AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) {order}, id) AS rn FROM p{r} QUALIFY rn <= 4),
l{r + 1} AS MATERIALIZED (SELECT * FROM l{r} UNION ALL SELECT * FROM u{r} WHERE id IN (SELECT id FROM b{r})),
u{r + 1} AS MATERIALIZED (SELECT * FROM u{r} WHERE id NOT IN (SELECT id FROM b{r}))"""
    picks = (f"SELECT CAST({4 * r - 1} + rn AS INTEGER) AS draw, id, y FROM b{r}" for r in range(3))
    return out + " " + " UNION ALL ".join(picks)


def kcenter_sql(k: int) -> str:
    """Farthest first, one pick after the other."""
    out = f"""WITH{POOL_SQL},
d0 AS (SELECT u.id, u.x, min(list_distance(u.x, l.x)) AS d FROM pool u, pool l
  WHERE u.role = 'U' AND l.role = 'L' GROUP BY u.id, u.x)"""
    for r in range(k):
        out += f""",
c{r} AS MATERIALIZED (SELECT id, x, d FROM d{r} ORDER BY round(d, 9) DESC, id LIMIT 1),
d{r + 1} AS MATERIALIZED (SELECT t.id, t.x, least(t.d, list_distance(t.x, c.x)) AS d FROM d{r} t, c{r} c WHERE t.id <> c.id)"""
    picks = (f"SELECT id, CAST({r} AS INTEGER) AS draw, round(d, 6) AS score FROM c{r}" for r in range(k))
    return out + " " + " UNION ALL ".join(picks)


def loop_sql() -> str:
    """Two rounds of four rows on three quarters of the data."""
    out = LOOP_SQL
    for r in range(2):
        out += ", " + model_sql(f"l{r}", f"m{r}")
        out += f""",
p{r} AS (SELECT u.*, 1 / (1 + exp(-(list_dot_product(u.x, m.w) + m.b))) AS p1 FROM u{r} u, m{r} m),
b{r} AS (SELECT *, row_number() OVER (ORDER BY {ORDERS['entropy']}) AS rn FROM p{r} QUALIFY rn <= 4),
l{r + 1} AS (SELECT id, x, y FROM l{r} UNION ALL SELECT id, x, y FROM b{r}),
u{r + 1} AS (SELECT u.* FROM u{r} u ANTI JOIN b{r} b ON u.id = b.id)"""
    return out + (
        " SELECT CAST(rn - 1 AS INTEGER) AS draw, id, y FROM b0 UNION ALL"
        " SELECT CAST(rn + 3 AS INTEGER) AS draw, id, y FROM b1"
    )


PARTIAL_SQL = (
    SCORED_SQL
    + ", more AS (SELECT id, x, y FROM pool WHERE role IN ('L', 'T')),"
    + model_sql("more", "model2")
    + " SELECT id, round(list_dot_product(x, w) + model2.b, 6) AS margin FROM u, model2"
)

QUERIES = {
    "acquire_rounds": (acquire_rounds, ONE_SQL + " SELECT fold, draw, id, y FROM choices"),
    "acquire_rounds_large": (
        acquire_rounds_large,
        "WITH base AS (SELECT l_orderkey * 8 + l_linenumber AS id, ["
        + ", ".join(f"max({c}::DOUBLE)" for c in ITEM_COLUMNS)
        + "] AS x, max(CAST(l_returnflag = 'R' AS INTEGER)) AS y FROM lineitem GROUP BY id),"
        + folded_sql(1)
        + ","
        + rounds_sql("entropy", 2, batch=5000)
        + " SELECT fold, draw, id, y FROM choices",
    ),
    "choices_round_trip": (
        choices_round_trip,
        ONE_SQL + " SELECT 'entropy' AS strategy, CAST(1 AS INTEGER) AS iteration, fold, draw, id, y FROM choices",
    ),
    "learning_curve": (
        learning_curve,
        ONE_SQL + " SELECT fold, draw, labeled, round(auc, 6) AS auc FROM curve",
    ),
    "mean_curve": (mean_curve, ALL_SQL + " SELECT strategy, draw, round(auc, 6) AS auc FROM mean_curve"),
    "first_reach": (
        first_reach,
        ALL_SQL + " SELECT strategy, min(draw) FILTER (auc >= 0.5) AS first_draw FROM mean_curve GROUP BY strategy",
    ),
    "alc_normalised": (
        alc,
        ALL_SQL
        + """, steps AS (
  SELECT strategy, (auc + lag(auc) OVER (PARTITION BY strategy ORDER BY draw)) / 2 AS area FROM mean_curve)
SELECT strategy, round((sum(area) - 0.5 * count(area)) / (0.5 * count(area)), 6) AS alc
FROM steps GROUP BY strategy""",
    ),
    "merge_runs": (merged_runs, MERGED_SQL),
    "fold_auc_summary": (
        fold_auc,
        f"WITH{BASE_SQL},{folded_sql(1)},"
        + rounds_sql("random", 1)
        + " SELECT round(avg(auc), 6) AS auc, round(2 * stddev_pop(auc), 6) AS spread FROM curve",
    ),
    "fold_sides": (
        fold_sides,
        f"""WITH{BASE_SQL},{folded_sql(1)}
SELECT CAST(f AS INTEGER) AS fold, CASE WHEN home = f THEN 'test' ELSE 'train' END AS side,
  count(*) AS n, CAST(sum(y) AS BIGINT) AS pos
FROM folded, range({FOLDS}) t(f) GROUP BY ALL""",
    ),
    "loop_choices": (loop_choices, loop_sql()),
    "loop_choices_minmax": (pair_loop("minmax"), pair_loop_sql("min(list_distance(u.x, o.x))", "l", "DESC")),
    "loop_choices_density": (
        pair_loop("density"), pair_loop_sql("avg(1 / (1 + list_distance(u.x, o.x)))", "u", "ASC")
    ),
    "pick_kcenter": (pick_kcenter, kcenter_sql(20)),
    "partial_fit": (partial_fit, PARTIAL_SQL),
    "move_to_labeled": (
        moved,
        SCORED_SQL
        + " SELECT CASE WHEN role = 'L' OR id % 3 = 0 THEN 'L' ELSE 'U' END AS role, id"
        + " FROM pool WHERE role <> 'T'",
    ),
    "experiment_curves": (experiment_curves, None),
}
