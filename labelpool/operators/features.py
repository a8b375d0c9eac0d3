"""Features in long form ``(id, feature, value)``: one-hot records, TF-IDF, families, vectors."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelpool.functions.text import TOKEN_PATTERN, counted, key_value, ngrams, tokens, without
from labelpool.plans.cuts import numbered
from labelpool.plans.lookup import skew_lookup, split_lookup
from labelpool.session import materialise, new_table_dir

# Documents whose lengths are broadcast at most, two numbers each.
MAX_IDS = 4_000_000


def one_hot(
    df: DataFrame, strings: Sequence[str] = (), numbers: Sequence[str] = (), id_col: str = "id"
) -> DataFrame:
    """Text columns become ``COL=value`` with value 1, numeric columns keep name and value.

    NULLs give no row. One scan, no shuffle, and no column per distinct value.
    """
    entries = [
        F.struct(key_value(c, F.col(c)).alias("feature"), F.lit(1.0).alias("value"))
        for c in strings
    ] + [
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
        for c in numbers
    ]
    if not entries:
        raise ValueError("name at least one column")
    return (
        df.select(F.col(id_col).alias("id"), F.inline(F.array(*entries)))
        .where(F.col("feature").isNotNull() & F.col("value").isNotNull())
    )


def pair_text(a: str, b: str) -> Column:
    """Both texts as one value, for a pair feature."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    return F.when(both, F.concat_ws("_", a, b))


def offset_gap(a: str, b: str) -> Column:
    return F.abs(F.col(a) - F.col(b))


def novelty_sum(a: str, b: str) -> Column:
    return F.col(a) + F.col(b)


# Which feature names belong to which family (searched anywhere in the name).
FAMILIES: dict[str, str] = {
    "cui": r"(SU|O)BJECT_CUI=.*",
    "dist": r"(SU|O)BJECT_DIST",
    "pred": r"PREDICATE=.*",
    "ind": r"INDICATOR_TYPE=.*",
    "novelty": r"(SU|O)BJECT_NOVELTY",
}


def family_filter(
    features: DataFrame, families: Sequence[str], patterns: dict[str, str] | None = None
) -> DataFrame:
    """Features of the named families; ``all`` keeps everything. A feature appears once even if
    two families match it."""
    patterns = FAMILIES if patterns is None else patterns
    if "all" in families:
        return features
    unknown = [f for f in families if f not in patterns]
    if unknown or not families:
        raise ValueError(f"unknown feature families {unknown}; known: {sorted(patterns)}")
    hits = [F.col("feature").rlike(patterns[f]) for f in families]
    return features.where(reduce(lambda a, b: a | b, hits))


class TfIdfModel:
    """Inverse document frequencies as a table; ``transform`` gives L2-normalised weights."""

    def __init__(
        self, spec: "TfIdf", idf: DataFrame, docs: DataFrame | None = None,
        counts: DataFrame | None = None,
    ):
        self.spec, self.idf, self.docs, self.counts = spec, idf, docs, counts

    @property
    def vocabulary(self) -> DataFrame:
        return self.idf.select("feature").orderBy("feature")

    def transform(self, docs: DataFrame, ids: DataFrame | None = None) -> DataFrame:
        """``(id, feature, value)``; with ``ids`` for those of the documents only."""
        counts = self.counts
        if docs is not self.docs:
            counts = materialise(self.spec.term_counts(docs), "term-counts")
        if ids is not None:
            counts = counts.join(ids.select("id"), "id", "left_semi")
        n, known, lone = docs.count(), self.idf, None
        if docs is self.docs:
            # Every term is known, so one that is not looked up stands in one document only.
            known, lone = known.where("df > 1"), {"idf": F.ln((1 + F.lit(n)) / (1 + F.lit(1))) + 1}
        found = split_lookup(counts, known.select("feature", "df", "idf"), "feature", F.col("df"), "id", absent=lone)
        found = found.select("id", "feature", "tf", "idf")
        if n > MAX_IDS:
            return self._by_window(found)
        # Only a length for each document travels; the rows of its terms stay where they are, and
        # both readings of the rare terms share one exchange.
        named = found.where(F.col("id").isNotNull())
        w = F.col("tf") * F.col("idf")
        lengths = named.groupBy("id").agg(F.sqrt(F.sum(w * w)).alias("length"))
        near = named.join(F.broadcast(lengths), "id").select("id", "feature", (w / F.col("length")).alias("value"))
        return near.unionByName(self._by_window(found.where(F.col("id").isNull())))

    @staticmethod
    def _by_window(found: DataFrame) -> DataFrame:
        """Every document's terms in one place, for documents too many to broadcast their lengths."""
        # Counts and idf travel, not the weights: they repeat and so take little room.
        weighed = found.repartition("id").withColumn("w", F.col("tf") * F.col("idf"))
        length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
        return weighed.select("id", "feature", (F.col("w") / length).alias("value"))


class TfIdf:
    """TF-IDF over whole texts: raw counts (or 0/1), idf = ln((1+N)/(1+df)) + 1, L2 norm.

    Tokens are made and counted where the text is read; only texts of ids that stand more than once
    are counted together by an exchange. The counts are written once and serve both the document
    frequencies and the weights of the fitted documents. The vocabulary is a written table, so Spark knows its size
    and broadcasts it only when it is small.
    """

    def __init__(
        self,
        stop_words: Sequence[str] = (),
        low: int = 1,
        high: int = 1,
        binary: bool = False,
        pattern: str = TOKEN_PATTERN,
        min_length: int = 1,
        id_col: str = "id",
        text_col: str = "text",
    ):
        self.stop_words, self.low, self.high, self.binary = stop_words, low, high, binary
        self.pattern, self.min_length = pattern, min_length
        self.id_col, self.text_col = id_col, text_col

    def term_counts(self, docs: DataFrame) -> DataFrame:
        rows = docs.select(F.col(self.id_col).alias("id"), F.col(self.text_col).alias("text"))
        # eqNullSafe: texts without an id are one document.
        repeated = rows.groupBy("id").count().where("count > 1").select(F.col("id").alias("_id"))
        repeated = materialise(repeated, "repeated-ids")
        if repeated.isEmpty():
            return self._row_counts(rows)
        same = F.col("id").eqNullSafe(F.col("_id"))
        together = self._row_counts(rows.join(repeated, same, "left_semi")).groupBy("id", "feature")
        tf = F.lit(1.0) if self.binary else F.sum("tf")
        return self._row_counts(rows.join(repeated, same, "left_anti")).unionByName(
            together.agg(tf.alias("tf"))
        )

    def _row_counts(self, rows: DataFrame) -> DataFrame:
        """Counts of every row by itself; nothing is exchanged."""
        words = without(
            tokens(F.col("text"), self.pattern, self.min_length), list(self.stop_words)
        )
        grams = ngrams(F.col("words"), self.low, self.high)
        found = F.array_distinct(grams) if self.binary else F.array_sort(grams)
        # explode_outer: for explode, Spark would add a "has any token" filter at the scan and so
        # find the tokens several times over.
        terms = rows.select("id", words.alias("words")).select("id", found.alias("terms"))
        if self.binary:
            out = terms.select("id", F.explode_outer("terms").alias("feature"), F.lit(1.0).alias("tf"))
        else:
            out = terms.select("id", F.inline_outer(counted(F.col("terms"))))
        return out.where(F.col("feature").isNotNull())

    def fit(self, docs: DataFrame) -> TfIdfModel:
        n = docs.agg(F.count("*").alias("n")).scalar()
        counts = materialise(self.term_counts(docs), "term-counts")
        idf = (
            counts
            .groupBy("feature")
            .agg(F.count("*").alias("df"))
            .withColumn("idf", F.ln((1 + n) / (1 + F.col("df"))) + 1)
        )
        return TfIdfModel(self, materialise(idf, "idf"), docs, counts)


def union_features(parts: dict[str, DataFrame], prefix: bool = False) -> DataFrame:
    """Several feature sets of the same rows side by side; ``prefix`` keeps equal names apart.

    Where all of them have a ``fold``, it stays."""
    columns = ["id", "feature", "value"]
    if all("fold" in df.columns for df in parts.values()):
        columns = ["fold", *columns]
    named = [
        df.withColumn("feature", F.concat(F.lit(f"{name}:"), "feature")) if prefix else df
        for name, df in parts.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), [d.select(*columns) for d in named])


def feature_index(features: DataFrame) -> DataFrame:
    """``(feature, rows, idx)`` in feature order, numbered by ranges of the features."""
    names = features.groupBy("feature").agg(F.count("*").alias("rows"))
    return numbered(names, ["feature"], "idx").withColumn("idx", F.col("idx").cast("int"))


def to_vectors(
    features: DataFrame, index: DataFrame, ids: DataFrame | None = None
) -> DataFrame:
    """``(id, features)`` with sparse vectors for Spark ML; unknown features are left out.

    With ``ids`` the result has exactly those rows, an empty vector where nothing is stored. The
    vectors are put together by Spark itself: a Spark ML vector is stored as a struct.
    """
    index = materialise(index, "index")
    size = index.agg(F.coalesce(F.max("idx") + 1, F.lit(0))).first()[0]
    rows = (
        skew_lookup(features, index, "feature", F.col("rows"), "id")
        .groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct("idx", "value"))).alias("e"))
    )
    if ids is not None:
        rows = ids.select("id").join(rows, "id", "left").withColumn(
            "e", F.coalesce("e", F.array().cast("array<struct<idx:int,value:double>>"))
        )
    stored = rows.select(
        "id",
        F.struct(
            F.lit(0).cast("tinyint").alias("type"),
            F.lit(size).cast("int").alias("size"),
            F.col("e.idx").alias("indices"),
            F.col("e.value").cast("array<double>").alias("values"),
        ).alias("features"),
    )
    # Written and read back under the vector's schema, which only changes how a row is seen.
    path = new_table_dir(features.sparkSession, "vectors")
    stored.write.parquet(path)
    seen = T.StructType([features.schema["id"], T.StructField("features", VectorUDT())])
    return features.sparkSession.read.schema(seen).parquet(path)


def to_arrays(features: DataFrame, index: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``(id, x)`` with dense arrays, the form query strategies work on. For selected features:
    a row holds one number per feature."""
    vectors = to_vectors(features, index, ids)
    return vectors.select("id", vector_to_array("features").alias("x"))
