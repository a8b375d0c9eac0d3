"""Extraction, profiles, annotation, readers and writers, streaming."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from labelpool.operators import annotate, extract
from labelpool.operators.moments import Discriminant
from labelpool.session import new_table_dir
from labelpool.sources import readers, writers
from labelpool.streaming.labels import StreamingFit, score_stream


@pytest.fixture()
def path(spark):
    return new_table_dir(spark, "test")


def test_either_key_join_has_the_multiplicity_of_or(spark):
    left = spark.createDataFrame(
        [(1, "a", "b"), (2, "a", "a"), (3, None, "c"), (4, "d", "e")], "id int, s string, o string"
    )
    right = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "k string, v int")
    got = sorted((r["id"], r["v"]) for r in extract.either_key_join(left, right, "s", "o", "k").collect())
    assert got == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (3, 4)]
    plan = extract.either_key_join(left, right, "s", "o", "k")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_extraction(spark):
    sp = spark.createDataFrame(
        [(1, 10, "VERB"), (2, 10, "NOM"), (3, 11, "VERB"), (9, 10, "VERB")],
        "PREDICATION_ID long, SENTENCE_ID long, INDICATOR_TYPE string",
    )
    for name in ("SUBJECT_TEXT", "OBJECT_TEXT"):
        sp = sp.withColumn(name, F.lit("t"))
    for name in ("SUBJECT_SCORE", "SUBJECT_DIST", "SUBJECT_MAXDIST", "OBJECT_SCORE", "OBJECT_DIST", "OBJECT_MAXDIST"):
        sp = sp.withColumn(name, F.lit(1))
    pred = spark.createDataFrame(
        [
            (1, "p1", "INHIBITS", "gngm", "C1", "aapp", "C2"),
            (2, "p2", "TREATS", "gngm", "C1", "aapp", "C2"),
            (3, "p3", "STIMULATES", "gngm", "C3", "xxxx", "C1"),
        ],
        "PID long, PMID string, predicate string, s_type string, s_cui string, o_type string, o_cui string",
    )
    sentence = spark.createDataFrame([(10, "s", "ti"), (11, "s", "ab")], "SENTENCE_ID long, SENTENCE string, TYPE string")
    concept = spark.createDataFrame([(1, "C1"), (2, "C2"), (3, "C9")], "CONCEPT_ID long, CUI string")
    semtype = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x")], "CONCEPT_ID long, SEMTYPE string")
    out = extract.extract_predications(sp, pred, sentence, concept, semtype)
    assert tuple(out.columns) == extract.EXTRACTED
    assert [r["PMID"] for r in out.collect()] == ["p1"] * 3  # C1 twice, C2 once
    assert len(extract.SEMANTIC_TYPES) == 12 and len(extract.PREDICATES) == 3
    renamed = extract.rename_schema_version(pred)
    assert {"SUBJECT_SEMTYPE", "OBJECT_SEMTYPE", "PREDICATE"} <= set(renamed.columns)


def test_profiles(spark):
    df = spark.createDataFrame(
        [("I", "a", "b", "y"), ("I", "c", "a", "n"), ("S", "c", "d", "y")],
        "p string, s string, o string, l string",
    )
    members = spark.createDataFrame([("a",), ("b",), ("z",)], "value string")
    assert extract.distinct_counts(df, ["s", "o"], members).first().asDict() == {"n_values": 4, "n_members": 2}
    got = {r["p"]: tuple(r)[1:] for r in extract.membership_counts(df, "p", "s", "o", members).collect()}
    assert got == {"I": (1, 2, 2, 1), "S": (0, 0, 0, 0)}
    prof = extract.group_profile(df, "p", F.col("l") == "y").collect()
    assert [tuple(r) for r in prof] == [("I", 2, 50.0, 50.0), ("S", 1, 100.0, 0.0)]
    tab = {r["l"]: (r["I"], r["S"]) for r in extract.crosstab(df, "l", "p", ["I", "S"]).collect()}
    assert tab == {"y": (1, 1), "n": (1, 0)}


def test_spans(spark):
    rows = [
        (1, "The  zinc\ninhibits il-6 .", "zinc", "il-6"),
        (2, "il-6 is inhibited by zinc", " zinc ", "il-6"),
        (3, "nothing here", "zinc", "here"),
        (4, "zinc here", "zinc", "il-6"),
        (5, "zinc here", None, "here"),
        (6, "zinc here", "zinc", None),
    ]
    df = spark.createDataFrame(rows, "id int, SENTENCE string, SUBJECT_TEXT string, OBJECT_TEXT string")
    got = {r["id"]: r for r in annotate.with_spans(df).collect()}
    parts = ("before", "first_span", "between", "second_span", "after")
    assert [got[1][p] for p in parts] == ["The ", "zinc", " inhibits ", "il-6", " ."]
    assert [got[2][p] for p in parts] == ["", "il-6", " is inhibited by ", "zinc", ""]
    assert [got[i]["status"] for i in range(1, 7)] == [
        "ok", "ok", "subject_not_found", "object_not_found", "bad_subject", "bad_object"
    ]
    assert got[3]["before"] is None
    line = annotate.with_spans(df.where("id = 1")).select(
        annotate.summary_line(*[F.lit(v) for v in ("gngm", "INHIBITS", "VERB", "aapp")]).alias("l")
    )
    assert line.first()["l"] == "zinc (gngm) ** INHIBITS (VERB) ** il-6 (aapp)"


def test_annotation_round_trip(spark, path):
    def answer(rows):
        df = spark.createDataFrame(rows, "id long, label string, day int")
        return df.withColumn("annotated_at", F.make_timestamp(F.lit(2024), F.lit(1), "day", F.lit(0), F.lit(0), F.lit(0)))

    writers.append_annotations(answer([(1, "y", 1), (2, "n", 1), (3, "s", 1)]), path)
    writers.append_annotations(answer([(2, "Y", 2), (1, "s", 2)]), path)
    stored = spark.read.parquet(path)
    assert {(r["id"], r["y"]) for r in annotate.training_labels(stored).collect()} == {(2, 1)}
    rows = spark.range(1, 6).toDF("id")
    assert sorted(r["id"] for r in annotate.annotation_queue(rows, stored).collect()) == [4, 5]
    assert annotate.attach_labels(rows, stored).count() == 1


def test_feature_matrix_round_trip(spark, path):
    features = spark.createDataFrame(
        [(1, "A=x", 1.0), (1, "n", 2.5), (2, "A=y", 1.0), (3, "n", -1.0)], "id long, feature string, value double"
    )
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 0)], "id long, y int")
    writers.write_feature_matrix(features, labels, path)
    assert readers.header_of(spark, path) == ["id", "A=x", "A=y", "n", "T/F"]
    back, y = readers.read_feature_matrix(spark, path, id_col="id")
    assert back.exceptAll(features).count() == 0 and features.exceptAll(back).count() == 0
    assert y.exceptAll(labels).count() == 0 and y.count() == 4
    numbered, _ = readers.read_feature_matrix(spark, path)
    assert numbered.count() == 4 + 4  # the id column is then a feature
    with pytest.raises(ValueError):
        readers.read_feature_matrix(spark, path, label="nope")


def test_feature_matrix_edges(spark, path):
    schema = "id long, feature string, value double"
    labels = spark.createDataFrame([(1, 0), (2, None), (2, 1), (None, 1)], "id long, y int")
    features = spark.createDataFrame(
        [(1, "b", 2.0), (1, "b", 3.0), (1, "b", None), (2, 'a,"', None), (9, "c", 4.0), (None, "b", 5.0), (1, None, 6.0)],
        schema,
    )
    writers.write_feature_matrix(features, labels, path + "/some")
    files = {r["value"] for r in spark.read.text(path + "/some").collect()}
    assert files == {
        'id,"a,\\"",b,c,T/F', "1,0.0,3.0,0.0,0", "2,,0.0,0.0,", "2,,0.0,0.0,1", ",0.0,0.0,0.0,1"
    }
    writers.write_feature_matrix(features.limit(0), labels.limit(0), path + "/none")
    assert readers.header_of(spark, path + "/none") == ["id", "T/F"]
    assert readers.read_feature_matrix(spark, path + "/none", id_col="id")[1].count() == 0


def test_feature_matrix_of_many_features(spark, path):
    # Each row has few of many features; one feature is in all rows.
    features = spark.range(400).selectExpr(
        "id", "explode(array('all', concat('f', id * 37 % 3000), concat('g', id))) AS feature", "id + 1.5D AS value"
    )
    labels = spark.range(400).selectExpr("id", "cast(id % 2 AS int) AS y")
    writers.write_feature_matrix(features, labels, path)
    names = [r["feature"] for r in features.select("feature").distinct().orderBy("feature").collect()]
    assert readers.header_of(spark, path) == ["id", *names, "T/F"]
    want = {}
    for r in features.collect():
        want.setdefault(r["id"], {})[r["feature"]] = r["value"]
    lines = [r["value"] for r in spark.read.text(path).collect() if not r["value"].startswith("id,")]
    assert len(lines) == 400
    for line in lines:
        key, *cells, y = line.split(",")
        got = {n: float(c) for n, c in zip(names, cells, strict=True) if float(c)}
        assert got == want[int(key)] and int(y) == int(key) % 2


def test_matrix_with_text_labels_and_bad_cells(spark, path):
    def wrote(name, *lines):
        spark.createDataFrame([(x,) for x in lines], "v string").coalesce(1).write.text(f"{path}/{name}")
        return f"{path}/{name}"

    text = wrote("text", "a,b,T/F", "1,0,y", "0,2,n", "3,4, y")
    features, y = readers.read_feature_matrix(spark, text)
    assert [r["y"] for r in y.orderBy("id").collect()] == [1, 0, 1]
    assert [(r["feature"], r["value"]) for r in features.orderBy("id", "feature").collect()] == [
        ("a", 1.0), ("b", 2.0), ("a", 3.0), ("b", 4.0)
    ]
    assert set(features.join(y, "id").select("id").distinct().collect()) == set(y.select("id").collect())
    with pytest.raises(Exception, match="(?i)malformed|more than two"):
        readers.read_feature_matrix(spark, wrote("three", "a,T/F", "1,x", "2,y", "3,z"))[1].collect()
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_feature_matrix(spark, wrote("bad", "a,T/F", "bad,0", "2,1"))[0].collect()
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_delimited(spark, wrote("tsv", "id\tw", "x\ty"), "id long, w string").collect()


def test_delimited_and_line_files(spark, path):
    spark.createDataFrame([("id\tw",), ("1\ta b",), ("2\tc",)], "v string").coalesce(1).write.text(path + "/tsv")
    got = readers.read_delimited(spark, path + "/tsv", "id long, w string")
    assert sorted((r["id"], r["w"]) for r in got.collect()) == [(1, "a b"), (2, "c")]
    spark.createDataFrame([(" C1 ",), ("C2",)], "v string").write.text(path + "/lines")
    assert sorted(r["value"] for r in readers.read_lines(spark, path + "/lines").collect()) == ["C1", "C2"]


def test_results_by_run(spark, path):
    curves = spark.createDataFrame(
        [("a", i, f, d, 0.5) for i in (1, 2) for f in (0, 1) for d in (0, 1)], readers.RESULT_CURVES
    )
    writers.write_curves(curves, path)
    assert readers.read_results(spark, path, [1, 2]).count() == 8
    with pytest.raises(FileNotFoundError, match="3"):
        readers.read_results(spark, path, [1, 2, 3])
    assert readers.read_results(spark, path, [1, 3], ignore_missing=True).count() == 4
    choices = spark.createDataFrame([("a", 1, 0, 0, 7, 1)], readers.RESULT_CHOICES)
    writers.write_choices(choices, path + "-choices")
    assert readers.read_results(spark, path + "-choices", schema=readers.RESULT_CHOICES).first()["id"] == 7


def test_write_modes(spark, path):
    df = spark.range(3)
    writers.write_new(df, path)
    with pytest.raises(AnalysisException):
        writers.write_new(df, path)
    assert writers.write_once(spark.range(9), path).count() == 3


def test_ranked_feature_lines(spark, path):
    ranked = spark.createDataFrame([("b", 4.5, 0.033895), ("a", 1.0, 0.317311)], "feature string, score double, p double")
    writers.write_ranked_features(ranked.coalesce(1), path)
    lines = [r["value"] for r in spark.read.text(path).collect()]
    assert [line.split(" :: ")[0] for line in lines] == ["b", "a"]
    assert float(lines[0].split(" :: ")[1]) == 4.5


def test_catalog_tables(spark):
    spark.range(2).createOrReplaceTempView("concept_table")
    assert readers.read_tables(spark, ["concept_table"])["concept_table"].count() == 2


def test_streamed_labels_and_scores(spark, path):
    rows = spark.range(400).select(
        "id",
        F.array(F.sin("id") + F.col("id") % 2, F.cos("id")).alias("x"),
        (F.col("id") % 2).cast("int").alias("y"),
    )
    rows.repartition(4).write.parquet(path + "/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path + "/in")
    fit = StreamingFit(path + "/moments")
    fit.start(stream, path + "/cp", available_now=True).awaitTermination()
    model, whole = fit.model(spark), Discriminant().fit(rows)
    assert model.b == pytest.approx(whole.b) and model.w == pytest.approx(whole.w)
    fit._add(rows.limit(0), 99)
    batch0 = spark.read.parquet(path + "/in")
    assert batch0.count() == 400
    query = (
        score_stream(stream, model)
        .select("id", "margin")
        .writeStream.format("parquet")
        .option("path", path + "/out")
        .option("checkpointLocation", path + "/cp2")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    out = spark.read.parquet(path + "/out").withColumnRenamed("margin", "m")
    both = out.join(whole.transform(rows), "id")
    assert both.count() == 400 and both.where("abs(m - margin) > 1e-9").count() == 0
