"""Relational queries: extraction, profiles, annotation."""

from __future__ import annotations

from pyspark.errors import AnalysisException, PySparkException, PySparkRuntimeError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelpool.functions.text import find, tokens
from labelpool.functions.vectors import distance, guarded
from labelpool.operators import annotate, extract
from labelpool.operators.features import novelty_sum, offset_gap, one_hot, pair_text
from labelpool.operators.splits import binarise, binarise_sorted, stratified_folds
from labelpool.queries.pool import rounded
from labelpool.session import materialise, new_table_dir
from labelpool.sources.readers import read_lines
from labelpool.sources.writers import append_annotations, write_new, write_once
from labelpool.streaming.answers import ArrivalRates, LatestFit


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def source_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The star schema in the shape of the five extraction tables.

    Line items are sentence predications, orders with their customer's nation are predications,
    parts are sentences, suppliers are concepts by nation, and nations outside region 4 hold
    their semantic types.
    """
    items = table(spark, sf, "lineitem")
    orders = table(spark, sf, "orders")
    customers = table(spark, sf, "customer")
    return {
        "sentence_predication": items.select(
            F.col("l_orderkey").alias("PREDICATION_ID"),
            F.col("l_partkey").alias("SENTENCE_ID"),
            F.col("l_returnflag").alias("INDICATOR_TYPE"),
            F.concat(F.lit("S"), "l_suppkey").alias("SUBJECT_TEXT"),
            F.col("l_quantity").cast("int").alias("SUBJECT_SCORE"),
            F.col("l_linenumber").alias("SUBJECT_DIST"),
            F.lit(7).alias("SUBJECT_MAXDIST"),
            F.concat(F.lit("P"), "l_partkey").alias("OBJECT_TEXT"),
            F.round(F.col("l_discount") * 100).cast("int").alias("OBJECT_SCORE"),
            F.round(F.col("l_tax") * 100).cast("int").alias("OBJECT_DIST"),
            F.lit(10).alias("OBJECT_MAXDIST"),
        ),
        "predication": orders.join(customers, orders.o_custkey == customers.c_custkey).select(
            F.col("o_orderkey").alias("PID"),
            F.concat(F.lit("PM"), "o_orderkey").alias("PMID"),
            F.col("o_orderpriority").alias("predicate"),
            F.col("o_orderstatus").alias("s_type"),
            F.col("c_nationkey").cast("string").alias("s_cui"),
            F.col("c_mktsegment").alias("o_type"),
            (F.col("o_orderkey") % 25).cast("string").alias("o_cui"),
        ),
        "sentence": table(spark, sf, "part").select(
            F.col("p_partkey").alias("SENTENCE_ID"),
            F.col("p_name").alias("SENTENCE"),
            F.col("p_type").alias("TYPE"),
        ),
        "concept": table(spark, sf, "supplier").select(
            F.col("s_suppkey").alias("CONCEPT_ID"), F.col("s_nationkey").cast("string").alias("CUI")
        ),
        "concept_semtype": table(spark, sf, "supplier")
        .join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .where("n_regionkey <> 4")
        .select(F.col("s_suppkey").alias("CONCEPT_ID"), "n_name"),
    }


def extract_predications(spark: SparkSession, sf: str, limit: int = 1_000_000) -> DataFrame:
    return extract.extract_predications(
        **source_tables(spark, sf),
        subject_types=["F", "P"],
        object_types=["BUILDING", "MACHINERY"],
        predicates=["1-URGENT", "2-HIGH", "5-LOW"],
        limit=limit,
    )


def extract_first_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The same extraction with a limit that cuts at every size."""
    return extract_predications(spark, sf, limit=2_000)


EXTRACT_SQL = """
WITH sp AS (
  SELECT l_orderkey AS PREDICATION_ID, l_partkey AS SENTENCE_ID, l_returnflag AS INDICATOR_TYPE,
    'S' || l_suppkey AS SUBJECT_TEXT, CAST(l_quantity AS INTEGER) AS SUBJECT_SCORE,
    l_linenumber AS SUBJECT_DIST, 7 AS SUBJECT_MAXDIST, 'P' || l_partkey AS OBJECT_TEXT,
    CAST(round(l_discount * 100) AS INTEGER) AS OBJECT_SCORE,
    CAST(round(l_tax * 100) AS INTEGER) AS OBJECT_DIST, 10 AS OBJECT_MAXDIST FROM lineitem),
p AS (
  SELECT o_orderkey AS PID, 'PM' || o_orderkey AS PMID, o_orderpriority AS predicate,
    o_orderstatus AS s_type, CAST(c_nationkey AS VARCHAR) AS s_cui, c_mktsegment AS o_type,
    CAST(o_orderkey % 25 AS VARCHAR) AS o_cui
  FROM orders JOIN customer ON o_custkey = c_custkey),
s AS (SELECT p_partkey AS SENTENCE_ID, p_name AS SENTENCE, p_type AS TYPE FROM part),
c AS (SELECT s_suppkey AS CONCEPT_ID, CAST(s_nationkey AS VARCHAR) AS CUI FROM supplier),
cs AS (SELECT s_suppkey AS CONCEPT_ID FROM supplier JOIN nation ON s_nationkey = n_nationkey
  WHERE n_regionkey <> 4)
SELECT PMID, predicate, INDICATOR_TYPE, SUBJECT_TEXT, s_type, SUBJECT_SCORE, SUBJECT_DIST,
  SUBJECT_MAXDIST, s_cui, OBJECT_TEXT, o_type, OBJECT_SCORE, OBJECT_DIST, OBJECT_MAXDIST, o_cui,
  SENTENCE, TYPE
FROM sp JOIN p ON PREDICATION_ID = PID JOIN s USING (SENTENCE_ID)
  JOIN (SELECT CUI FROM c JOIN cs USING (CONCEPT_ID)) k ON k.CUI = s_cui OR k.CUI = o_cui
WHERE s_type IN ('F', 'P') AND o_type IN ('BUILDING', 'MACHINERY')
  AND predicate IN ('1-URGENT', '2-HIGH', '5-LOW')
ORDER BY PMID, predicate, SUBJECT_TEXT, OBJECT_TEXT, SENTENCE, INDICATOR_TYPE, s_type, SUBJECT_SCORE,
  SUBJECT_DIST, SUBJECT_MAXDIST, s_cui, o_type, OBJECT_SCORE, OBJECT_DIST, OBJECT_MAXDIST, o_cui, TYPE
LIMIT 1000000"""


def disjunctive_join_dealt(spark: SparkSession, sf: str) -> DataFrame:
    """Quantity of items per order priority, the order being the item's own or the one numbered
    like its part; a third of the items name order 1 instead of the latter."""
    items = table(spark, sf, "lineitem").select(
        "l_orderkey",
        F.when(F.col("l_partkey") % 3 == 0, F.lit(1).cast("bigint")).otherwise(F.col("l_partkey")).alias("other"),
        "l_quantity",
        F.concat_ws(":", "l_orderkey", "l_linenumber").alias("row"),
    )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    both = extract.either_key_join_dealt(
        items, orders, "l_orderkey", "other", "o_orderkey", "row", part_rows=5_000
    )
    return both.groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("quantity")
    )


def disjunctive_join(spark: SparkSession, sf: str) -> DataFrame:
    """Revenue per nation that is the customer's or the supplier's."""
    rows = (
        table(spark, sf, "lineitem")
        .join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select("c_nationkey", "s_nationkey", "l_quantity")
    )
    nations = table(spark, sf, "nation").select("n_nationkey", "n_name")
    both = extract.either_key_join(rows, nations, "c_nationkey", "s_nationkey", "n_nationkey")
    return both.groupBy("n_name").agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("quantity")
    )


def pair_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with the nations of customer and (by order number) of a second party."""
    return (
        table(spark, sf, "orders")
        .join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").alias("id"),
            "o_orderpriority",
            "o_orderstatus",
            "o_totalprice",
            F.col("c_nationkey").alias("subject"),
            (F.col("o_orderkey") % 25).cast("int").alias("object"),
        )
    )


PAIR_SQL = """
WITH rows AS (
  SELECT o_orderkey AS id, o_orderpriority, o_orderstatus, o_totalprice, c_nationkey AS subject,
    CAST(o_orderkey % 25 AS INTEGER) AS object
  FROM orders JOIN customer ON o_custkey = c_custkey),
members AS (SELECT n_nationkey AS value FROM nation WHERE n_regionkey IN (1, 2))"""


def members(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").where("n_regionkey IN (1, 2)").select(
        F.col("n_nationkey").alias("value")
    )


def membership_counts(spark: SparkSession, sf: str) -> DataFrame:
    return extract.membership_counts(
        pair_rows(spark, sf), "o_orderpriority", "subject", "object", members(spark, sf)
    )


def distinct_union(spark: SparkSession, sf: str) -> DataFrame:
    return extract.distinct_in_columns(pair_rows(spark, sf), ["subject", "object"])


def distinct_counts(spark: SparkSession, sf: str) -> DataFrame:
    return extract.distinct_counts(pair_rows(spark, sf), ["subject", "object"], members(spark, sf))


def line_list_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The member list written as text lines and read back, as a list file would be."""
    path = new_table_dir(spark, "list")
    members(spark, sf).select(F.concat(F.lit("  "), "value", F.lit(" ")).alias("value")).write.text(path)
    listed = read_lines(spark, path)
    rows = pair_rows(spark, sf).select(
        F.col("subject").cast("string").alias("subject"), F.col("object").cast("string").alias("object")
    )
    return extract.distinct_counts(rows, ["subject", "object"], listed)


def group_profile(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    out = extract.group_profile(rows, "source", F.col("quality") == 1)
    return rounded(out, "pct_positive", "pct_negative")


def crosstab(spark: SparkSession, sf: str) -> DataFrame:
    return extract.crosstab(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


def event_crosstab(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").withColumn("kind", F.col("event_type"))
    return extract.crosstab(events, "user_id", "kind", ["click", "view", "purchase"])


def one_hot_orders(spark: SparkSession, sf: str) -> DataFrame:
    return one_hot(
        table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], ["o_totalprice"], "o_orderkey"
    )


def derived_features(spark: SparkSession, sf: str) -> DataFrame:
    """Pair text, offset gap and sum of two columns, one-hot where they are categories."""
    rows = pair_rows(spark, sf).select(
        "id",
        pair_text("subject", "object").alias("PAIR"),
        offset_gap("subject", "object").cast("string").alias("GAP"),
        novelty_sum("subject", "object").alias("SUM"),
    )
    return one_hot(rows, ["PAIR", "GAP"], ["SUM"])


def fold_profile(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y"),
        "o_orderpriority",
    )
    flags = {
        "urgent": F.col("o_orderpriority") == "1-URGENT",
        "high": F.col("o_orderpriority") == "2-HIGH",
        "low": F.col("o_orderpriority") == "5-LOW",
    }
    return rounded(extract.fold_profile(stratified_folds(rows, 5, 1), flags), "pct_positive")


def binarised(spark: SparkSession, sf: str) -> DataFrame:
    """Line status as 0/1 by sorted class order, counted per flag."""
    rows = binarise_sorted(table(spark, sf, "lineitem"), "l_linestatus")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(F.col("y").cast("long")).alias("ones"), F.count("*").alias("n")
    )


def schema_version(spark: SparkSession, sf: str) -> DataFrame:
    """Old column names, renamed, counted by predicate."""
    old = source_tables(spark, sf)["predication"]
    return extract.rename_schema_version(old).groupBy("SUBJECT_SEMTYPE", "PREDICATE").agg(
        F.count("*").alias("n")
    )


def annotation_queue(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    done = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return annotate.annotation_queue(rows, done)


def spans(spark: SparkSession, sf: str) -> DataFrame:
    """Where the first and the last word of the turn before stand in each conversation turn."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    before = turns.select(
        "conv_id",
        (F.col("turn") + 1).alias("turn"),
        F.split(F.trim("text"), r"\s+").alias("words"),
    )
    rows = turns.join(before, ["conv_id", "turn"], "left").select(
        "conv_id",
        "turn",
        F.col("text").alias("SENTENCE"),
        F.get("words", F.lit(0)).alias("SUBJECT_TEXT"),
        F.get("words", F.size("words") - 1).alias("OBJECT_TEXT"),
    )
    return annotate.with_spans(rows).select(
        "conv_id", "turn", "subject", "object", "subject_start", "object_start", "status",
        F.md5("before").alias("before"), "first_span", F.md5("between").alias("between"),
        "second_span", F.md5("after").alias("after"),
    )


SPANS_SQL = r"""
WITH turns AS (SELECT conv_id, turn, text, regexp_split_to_array(trim(text), '\s+') AS words FROM conversations),
r AS (
  SELECT t.conv_id, t.turn, trim(regexp_replace(t.text, '\s+', ' ', 'g')) AS sentence,
    trim(regexp_replace(b.words[1], '\s+', ' ', 'g')) AS subject,
    trim(regexp_replace(b.words[-1], '\s+', ' ', 'g')) AS object
  FROM turns t LEFT JOIN turns b ON b.conv_id = t.conv_id AND b.turn + 1 = t.turn),
f AS (SELECT *, instr(sentence, subject) - 1 AS ss, instr(sentence, object) - 1 AS os FROM r),
g AS (SELECT *, CASE WHEN subject IS NULL THEN 'bad_subject' WHEN object IS NULL THEN 'bad_object'
    WHEN ss < 0 THEN 'subject_not_found' WHEN os < 0 THEN 'object_not_found' ELSE 'ok' END AS status,
    CASE WHEN ss < os THEN ss ELSE os END AS a1,
    CASE WHEN ss < os THEN ss + length(subject) ELSE os + length(object) END AS e1,
    CASE WHEN ss < os THEN os ELSE ss END AS a2,
    CASE WHEN ss < os THEN os + length(object) ELSE ss + length(subject) END AS e2 FROM f)
SELECT conv_id, turn, subject, object, CAST(ss AS INTEGER) AS subject_start,
  CAST(os AS INTEGER) AS object_start, status,
  CASE WHEN status = 'ok' THEN md5(sentence[1:a1]) END AS before,
  CASE WHEN status = 'ok' THEN sentence[a1 + 1:e1] END AS first_span,
  CASE WHEN status = 'ok' THEN md5(sentence[e1 + 1:a2]) END AS between,
  CASE WHEN status = 'ok' THEN sentence[a2 + 1:e2] END AS second_span,
  CASE WHEN status = 'ok' THEN md5(sentence[e2 + 1:]) END AS after
FROM g"""


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Two rounds of answers per label row: first y/n by quality, then some changed or skipped."""
    rows = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    first = rows.select(
        "id",
        F.when(F.col("quality") == 1, "y").otherwise("n").alias("label"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("annotated_at"),
    )
    second = rows.where("toxic = 1 OR id % 7 = 0").select(
        "id",
        F.when(F.col("id") % 7 == 0, "s").otherwise("N").alias("label"),
        F.lit("2024-01-02 00:00:00").cast("timestamp").alias("annotated_at"),
    )
    path = new_table_dir(spark, "annotations")
    append_annotations(first, path)
    append_annotations(second, path)
    return spark.read.schema("id long, label string, annotated_at timestamp").parquet(path)


def annotation_merge(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source")
    return annotate.attach_labels(docs, answers(spark, sf))


def latest_labels(spark: SparkSession, sf: str) -> DataFrame:
    return annotate.latest_labels(answers(spark, sf)).select("id", "label")


ANSWERS_SQL = """
WITH a AS (
  SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'y' ELSE 'n' END AS label, 1 AS round FROM labels
  UNION ALL SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 's' ELSE 'N' END, 2 FROM labels
  WHERE toxic = 1 OR doc_id % 7 = 0),
latest AS (SELECT id, arg_max(label, round) AS label FROM a GROUP BY id)"""


def label_texts(spark: SparkSession, sf: str) -> DataFrame:
    """y / n texts to 0/1, and the position of a word in every document."""
    docs = table(spark, sf, "documents").join(answers(spark, sf).where("annotated_at < '2024-01-02'")
                                              .withColumnRenamed("id", "doc_id"), "doc_id")
    return docs.select(
        F.col("doc_id").alias("id"),
        binarise(F.col("label")).alias("y"),
        find(F.col("text"), F.lit("the")).alias("at"),
    )


def create_once(spark: SparkSession, sf: str) -> DataFrame:
    """Results are written once: a second write is refused, and a split that is there is read."""
    rows = table(spark, sf, "labels").select("doc_id", "quality")
    refused, path = False, new_table_dir(spark, "results")
    write_new(rows.where("quality = 1"), path)
    try:
        write_new(rows, path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        refused = True
    first = write_once(rows, new_table_dir(spark, "split")).count()
    kept = write_once(rows, path)
    return kept.agg(F.count(F.lit(1)).alias("kept")).select(
        "kept", F.lit(first).alias("first"), F.lit(refused).alias("refused")
    )


def finite_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine distances to the first component's axis; rows set to zero have none, and fail a job
    that is guarded."""
    x = F.col("embedding").cast("array<double>")
    axis = F.transform(x, lambda v, i: F.when(i == 0, 1.0).otherwise(0.0))
    zeroed = F.transform(x, lambda v: F.when(F.col("vec_id") % 50 == 0, 0.0).otherwise(v))
    rows = table(spark, sf, "embeddings").select(zeroed.alias("x"), axis.alias("axis"))
    d = distance("cosine", F.col("x"), F.col("axis"))
    undefined = d.isNull() | F.isnan(d)
    failed = False
    try:
        rows.agg(F.sum(guarded(d, "the axis"))).collect()
    except (PySparkException, PySparkRuntimeError) as error:
        if "undefined distance in the axis" not in str(error):
            raise
        failed = True
    clean = rows.where(~undefined).agg(F.count(guarded(d, "the axis")).alias("defined"))
    return clean.select(
        "defined", F.lit(rows.where(undefined).count()).alias("undefined"), F.lit(failed).alias("failed")
    )


def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The library's own tokens of part names, which are ASCII, so that all engines agree on them."""
    text = F.concat_ws("-", "p_name", "p_brand")
    words = table(spark, sf, "part").select(F.explode(tokens(text)).alias("token"))
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def arrivals(spark: SparkSession, sf: str, lag: str, schema: list[str]) -> DataFrame:
    """``events`` as a stream of three files in order of arrival, ``lag`` after the event.

    Every fifth event is delayed by the lag, and every seventh arrives a second time, delayed.
    """
    events = table(spark, sf, "events").withColumns(
        {
            "answer_id": F.col("event_id"),
            "id": F.col("user_id"),
            "at": F.col("ts").cast("timestamp"),
            "kind": F.col("event_type"),
            "y": F.when(F.col("event_type") == "error", None).otherwise(
                (F.col("event_type") == "click").cast("int")
            ),
            "x": F.array("value", F.length("props").cast("double")),
        }
    )
    delayed = F.col("at") + F.expr(f"INTERVAL {lag}")
    once = events.withColumn("seen", F.when(F.col("event_id") % 5 == 0, delayed).otherwise(F.col("at")))
    twice = events.where("event_id % 7 = 0").withColumn("seen", delayed)
    sent = materialise(once.unionByName(twice).select("seen", *schema), "arrivals")
    lo, hi = sent.agg(F.min(F.unix_timestamp("seen")), F.max(F.unix_timestamp("seen"))).first()
    third = F.floor((F.unix_timestamp("seen") - F.lit(lo or 0)) * 3 / F.lit((hi or 0) - (lo or 0) + 1))
    sent = sent.withColumn("part", F.coalesce(third, F.lit(2)))
    folder = new_table_dir(spark, "feed")
    for part in range(3):
        sent.where(F.col("part") == part).select(*schema).coalesce(4).write.mode("append").parquet(folder)
    kinds = sent.select(*schema).schema
    return spark.readStream.schema(kinds).option("maxFilesPerTrigger", 4).parquet(folder)


def ended(query) -> None:
    query.awaitTermination()


def stream_arrival_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Events by day and type, late and repeated ones counted once."""
    rates = ArrivalRates(new_table_dir(spark, "rates"), "1 day", "3 hours")
    stream = arrivals(spark, sf, "2 HOURS", ["answer_id", "at", "kind"])
    ended(rates.start(stream, new_table_dir(spark, "stream"), available_now=True))
    return rates.counts(spark).select(
        F.date_format("start", "yyyy-MM-dd").alias("day"), F.col("kind").alias("event_type"), "n"
    )


def stream_latest_model(spark: SparkSession, sf: str) -> DataFrame:
    """Sums of the model over every user's latest answer; errors withdraw the user's label."""
    fit = LatestFit(new_table_dir(spark, "moments"))
    stream = arrivals(spark, sf, "30 DAYS", ["answer_id", "id", "at", "y", "x"])
    ended(fit.start(stream, new_table_dir(spark, "stream"), available_now=True))
    sums = fit.model(spark).sums
    rows = [
        (y, int(sums.n[y]), i, float(sums.s1[y][i]), float(sums.s2[y][i]))
        for y in (0, 1) if sums.n[y] for i in range(2)
    ]
    out = spark.createDataFrame(rows, "y int, n bigint, i int, s1 double, s2 double")
    return rounded(out, "s1", "s2", digits=4)


STREAM_LATEST_SQL = """
WITH held AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
labels AS (
  SELECT (event_type = 'click')::INTEGER AS y, [value, length(props)::DOUBLE] AS x
  FROM held WHERE r = 1 AND event_type <> 'error'),
cells AS (SELECT y, unnest([0, 1]) AS i, unnest(x) AS v FROM labels)
SELECT y, count(*) AS n, i, round(sum(v), 4) AS s1, round(sum(v * v), 4) AS s2 FROM cells GROUP BY y, i"""


QUERIES = {
    "stream_arrival_rates": (
        stream_arrival_rates,
        "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events"
        " WHERE ts IS NOT NULL GROUP BY ALL",
    ),
    "stream_latest_model": (stream_latest_model, STREAM_LATEST_SQL),
    "create_once": (
        create_once,
        "SELECT count(*) FILTER (quality = 1) AS kept, count(*)::INTEGER AS first, true AS refused FROM labels",
    ),
    "finite_guard": (
        finite_guard,
        "SELECT count(*) FILTER (vec_id % 50 <> 0) AS defined, (count(*) FILTER (vec_id % 50 = 0))::INTEGER AS undefined,"
        " true AS failed FROM embeddings",
    ),
    "token_counts": (
        token_counts,
        r"""SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(
  lower(p_name || '-' || p_brand), '\b[\w-][\w-]+\b')) AS token FROM part) GROUP BY token""",
    ),
    "extract_predications": (extract_predications, EXTRACT_SQL),
    "extract_first_rows": (extract_first_rows, EXTRACT_SQL.replace("LIMIT 1000000", "LIMIT 2000")),
    "disjunctive_join_dealt": (
        disjunctive_join_dealt,
        """
        WITH items AS (
          SELECT l_orderkey, CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE l_partkey END AS other, l_quantity
          FROM lineitem),
        found AS (
          SELECT l_quantity, o_orderpriority FROM items JOIN orders ON o_orderkey = l_orderkey
          UNION ALL
          SELECT l_quantity, o_orderpriority FROM items JOIN orders ON o_orderkey = other
          WHERE other IS DISTINCT FROM l_orderkey)
        SELECT o_orderpriority, count(*) AS n, sum(l_quantity) AS quantity FROM found GROUP BY o_orderpriority""",
    ),
    "disjunctive_join": (
        disjunctive_join,
        """
        SELECT n_name, count(*) AS n, sum(l_quantity) AS quantity
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
          JOIN supplier ON l_suppkey = s_suppkey
          JOIN nation ON n_nationkey = c_nationkey OR n_nationkey = s_nationkey
        GROUP BY n_name""",
    ),
    "membership_counts": (
        membership_counts,
        PAIR_SQL
        + """,
f AS (SELECT *, subject IN (SELECT value FROM members) AS s, object IN (SELECT value FROM members) AS o FROM rows)
SELECT o_orderpriority, count(*) FILTER (s) AS subj, count(*) FILTER (o) AS obj,
  count(*) FILTER (s OR o) AS any, count(*) FILTER (s AND o) AS all FROM f GROUP BY o_orderpriority""",
    ),
    "distinct_union": (
        distinct_union,
        PAIR_SQL + " SELECT subject AS value FROM rows UNION SELECT object FROM rows",
    ),
    "distinct_counts": (
        distinct_counts,
        PAIR_SQL
        + " SELECT count(*) AS n_values, count(*) FILTER (value IN (SELECT value FROM members)) AS n_members"
        + " FROM (SELECT subject AS value FROM rows UNION SELECT object FROM rows)",
    ),
    "line_list_counts": (
        line_list_counts,
        PAIR_SQL
        + " SELECT count(*) AS n_values, count(*) FILTER (value IN (SELECT value FROM members)) AS n_members"
        + " FROM (SELECT subject AS value FROM rows UNION SELECT object FROM rows)",
    ),
    "group_profile": (
        group_profile,
        """
        SELECT source, count(*) AS n, round(100 * avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0 END), 6) AS pct_positive,
          round(100 - 100 * avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0 END), 6) AS pct_negative
        FROM documents JOIN labels USING (doc_id) GROUP BY source ORDER BY n DESC, source""",
    ),
    "indicator_crosstab": (
        crosstab,
        """
        SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F,
          count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P
        FROM orders GROUP BY o_orderpriority""",
    ),
    "event_crosstab": (
        event_crosstab,
        """
        SELECT user_id, count(*) FILTER (event_type = 'click') AS click,
          count(*) FILTER (event_type = 'view') AS view,
          count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY user_id""",
    ),
    "onehot_long": (
        one_hot_orders,
        """
        SELECT o_orderkey AS id, 'o_orderstatus=' || o_orderstatus AS feature, 1.0::DOUBLE AS value FROM orders
        UNION ALL SELECT o_orderkey, 'o_orderpriority=' || o_orderpriority, 1.0::DOUBLE FROM orders
        UNION ALL SELECT o_orderkey, 'o_totalprice', o_totalprice FROM orders""",
    ),
    "derived_features": (
        derived_features,
        PAIR_SQL
        + """
SELECT id, 'PAIR=' || subject || '_' || object AS feature, 1.0::DOUBLE AS value FROM rows
UNION ALL SELECT id, 'GAP=' || abs(subject - object), 1.0::DOUBLE FROM rows
UNION ALL SELECT id, 'SUM', CAST(subject + object AS DOUBLE) FROM rows""",
    ),
    "fold_profile": (
        fold_profile,
        """
        WITH r AS (SELECT o_orderkey AS id, CAST(o_orderstatus = 'F' AS INTEGER) AS y, o_orderpriority AS p FROM orders),
        f AS (SELECT *, CAST((row_number() OVER (ORDER BY y, md5('1:' || id), id) - 1) % 5 AS INTEGER) AS own FROM r)
        SELECT CAST(k AS INTEGER) AS fold, count(*) AS n, round(100.0 * sum(y) / count(*), 6) AS pct_positive,
          count(*) FILTER (p = '1-URGENT') AS urgent, count(*) FILTER (p = '2-HIGH') AS high,
          count(*) FILTER (p = '5-LOW') AS low
        FROM f, range(5) t(k) WHERE own <> k GROUP BY k""",
    ),
    "binarise_labels": (
        binarised,
        """
        SELECT l_returnflag, l_linestatus, CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS ones,
          count(*) AS n FROM lineitem GROUP BY ALL""",
    ),
    "schema_version": (
        schema_version,
        """
        SELECT o_orderstatus AS SUBJECT_SEMTYPE, o_orderpriority AS PREDICATE, count(*) AS n
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""",
    ),
    "annotation_queue": (
        annotation_queue,
        "SELECT doc_id AS id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    ),
    "annotation_spans": (spans, SPANS_SQL),
    "annotation_merge": (
        annotation_merge,
        ANSWERS_SQL
        + " SELECT doc_id AS id, source, CASE WHEN lower(label) = 'y' THEN 1 ELSE 0 END AS y"
        + " FROM documents JOIN latest ON doc_id = id WHERE lower(label) IN ('y', 'n')",
    ),
    "annotation_latest": (latest_labels, ANSWERS_SQL + " SELECT id, label FROM latest"),
    "label_texts": (
        label_texts,
        "SELECT doc_id AS id, CAST(quality AS INTEGER) AS y, CAST(instr(text, 'the') - 1 AS INTEGER) AS at"
        " FROM documents JOIN labels USING (doc_id)",
    ),
}
