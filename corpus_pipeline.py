"""The corpus pipeline: five stages from raw documents to packed bins.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes a stage's result
as Parquet to the shared folder and reads it again for the next one. All stages but the last return
the columns of ``documents``, so what a stage decides is which rows go on. Rows with a NULL id
are judged like others, and a verdict holds for the id and the text together, so rows that merely
share an id are told apart. Extra columns of any name pass through unchanged. Both deduplications keep one of the rows that agree in id and text.
The operators say what else is defined.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelpool.llm import language_id, quality_lm
from labelpool.llm.best_fit_packing import pack
from labelpool.llm.exact_dedup import exact_dedup
from labelpool.llm.near_dedup import near_dedup
from labelpool.llm.spread import with_ids, without_ids
from labelpool.session import materialise

#: A document goes if its language knows less than this part of what it usually knows of a text,
#: or holds less than this many times an even share of the evidence.
KNOWN, EVEN = 0.5, 1.1


def _key(text_sha: Column, *more: Column) -> Column:
    """What a verdict goes by: the id, which may be NULL, the text's SHA-256, and ``more``."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (F.col("doc_id"), *more)]
    return F.concat_ws(":", parts[0], text_sha, *parts[1:])


def _sha() -> Column:
    """A NULL text counts as empty, as it does in the operators."""
    return F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)


def _judged(verdict: DataFrame) -> DataFrame:
    """``(_key, any, rows)`` of ``verdict (_key, kept)``: rows of one key are judged together."""
    return verdict.groupBy("_key").agg(F.max("kept").alias("any"), F.count(F.lit(1)).alias("rows"))


def _only(docs: DataFrame, judged: DataFrame, key: Column, single: bool = False) -> DataFrame:
    """Rows of ``docs`` that ``judged (_key, any, rows)`` keeps, with the columns of ``docs``.

    ``key`` makes ``_key`` from a row of ``docs``. With ``single`` only one row of each key stays,
    the smallest by all columns.
    """
    judged = materialise(judged.withColumnRenamed("_key", "_id"), "judged")
    # A row travels as one struct, so its columns may have any names.
    keyed = docs.select(F.struct("*").alias("_row"), key.alias("_key"))
    left = without_ids(keyed, judged.where("NOT any").select("_id"), "_key")
    again = judged.where("any AND rows > 1").select("_id")
    if single and not again.isEmpty():
        # A partial minimum before the shuffle makes a row that stands very often cheap.
        one = with_ids(left, again, "_key").groupBy("_key").agg(F.min("_row").alias("_row"))
        left = without_ids(left, again, "_key").select("_row").union(one.select("_row"))
    return left.select("_row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go, those with a NULL text among them.

    A language knows nearly all windows of its own texts and few of random letters or of a language
    nobody taught. What it usually knows is the median over all rows that bear its name and are
    recognised as it. A text without a window of letters gives no evidence and goes.
    """
    named = docs.select("doc_id", "text", "lang")
    model = language_id.train(named)
    # Only keys travel with the verdict, so long texts are not sent back from the scan.
    key = _key(_sha())
    keyed = named.withColumn("_key", key)
    found = materialise(
        language_id.identify(keyed, model, ["_key", "lang"], evidence=True), "languages"
    )
    own = found.where("lang = lang_pred").select("lang", F.col("known").alias("log_perplexity"))
    usual = quality_lm.thresholds(own, "lang", 0.5)
    # One row for each language.
    found = found.join(F.broadcast(usual), F.col("lang_pred") == F.col("language"), "left")
    least = KNOWN * F.coalesce(F.col("limit"), F.lit(1.0))
    even = min(1.0, EVEN / max(1, len(model.languages)))
    sure = (F.col("lang_pred") != "und") & (F.col("known") >= least) & (F.col("score") >= even)
    return _only(
        docs, _judged(found.select("_key", F.coalesce(sure, F.lit(False)).alias("kept"))), key
    )


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less like the trusted ones of their language than almost all of those go."""
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    key = _key(_sha(), F.col("lang"))
    named = docs.select("doc_id", "text", "lang", key.alias("_key"))
    found = quality_lm.classify(named, trusted, keep=("_key",))
    return _only(docs, _judged(found.select("_key", "kept")), key)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document with the largest id stays."""
    found = exact_dedup(docs.select("doc_id", "text")).select(_key(F.col("text_sha256")).alias("_key"), "kept")
    return _only(docs, _judged(found), _key(_sha()), single=True)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest id stays.

    The operator compares documents by id; here a hash of id and text is its id, so rows without an
    id or with a shared one are documents of their own. NULL ids come last. (Among 10^8 rows any
    two have the same hash with a chance of 3e-4; they would count as one document.)
    """
    key = F.xxhash64(_key(_sha()))
    keyed = docs.select("doc_id", "text", key.alias("_key"))
    found = materialise(near_dedup(keyed, "_key").select("_key", "component_id"), "components")
    ids = keyed.select("_key", "doc_id").distinct()
    first = (
        found.distinct()
        .join(ids, "_key")
        .groupBy("component_id")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "_key")).alias("first"))
        .select("first._key", F.lit(True).alias("first"))
    )
    times = found.groupBy("_key").agg(F.count(F.lit(1)).alias("rows"))
    judged = times.join(first, "_key", "left").select(
        "_key", F.coalesce("first", F.lit(False)).alias("any"), "rows"
    )
    return _only(docs, judged, key, single=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in bins."""
    return pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("quality_classifier", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("packing", packing),
]

#: No SQL expresses the language model, the n-gram model or best fit.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
