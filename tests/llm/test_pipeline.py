"""What the stages of the pipeline decide takes effect, for every row."""

import random

from pyspark.sql import functions as F

import corpus_pipeline

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF = "/root/testdata/sf0.001"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, l, "s", 0) for i, t, l in rows], DOC)


def kept(stage, spark, docs):
    return sorted(((r.doc_id, r.text) for r in stage(spark, docs, SF).collect()), key=str)


def test_language_stage_rejects_what_no_language_knows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(5)
    gibberish = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz     ", k=n)) for n in (60, 600, 6000)]
    unseen = [
        "W Szczebrzeszynie chrząszcz brzmi w trzcinie i Szczebrzeszyn z tego słynie, a każdy wie o tym",
        "Jag vill gärna äta frukost med mina vänner innan vi går till skogen och plockar bär",
        "今日は天気がとてもいいですね",
    ]
    planted = [(9000 + i, t, None) for i, t in enumerate(gibberish + unseen)]
    planted += [(9100, gibberish[1] + "x", "en"), (9101, "A.", "en")]
    full = docs.select("doc_id", "text", "lang", "source", "n_chars").union(docs_of(spark, planted))
    ids = {r.doc_id for r in corpus_pipeline.language(spark, full, SF).select("doc_id").collect()}
    assert not ids & {i for i, _, _ in planted}
    assert ids == {r.doc_id for r in docs.where("text <> ''").select("doc_id").collect()}


def test_language_stage_with_one_language(spark):
    text = "the quick brown fox jumps over the lazy dog and then the other dog sleeps "
    rows = [(i, text * (1 + i % 3), "en") for i in range(8)]
    out = kept(corpus_pipeline.language, spark, docs_of(spark, rows + [(50, "zzkq xwvj pfft grmbl qqx", None)]))
    assert [i for i, _ in out] == list(range(8))


def long_text(rng, n=80):
    return " ".join("w%d" % rng.randrange(400) for _ in range(n))


def test_exact_stage_judges_rows_not_ids(spark):
    rng = random.Random(1)
    x, y, z, only = (long_text(rng) for _ in range(4))
    rows = [(1, x, "en"), (1, y, "en"), (2, x, "en"), (3, z, "en"), (3, z, "en"), (3, z, "de"), (None, x, None)]
    rows += [(None, only, "en")] * 4 + [(None, None, "en"), (None, "", "en"), (7, None, "en")]
    out = kept(corpus_pipeline.exact, spark, docs_of(spark, rows))
    assert out == sorted([(1, y), (2, x), (3, z), (None, only), (7, None)], key=str)


def test_near_stage_judges_rows_not_ids(spark):
    rng = random.Random(2)
    x, y, z, only = (long_text(rng) for _ in range(4))
    rows = [(5, x, "en"), (4, x + " end", "en"), (None, x + " tail", "en"), (4, y, "en"), (9, z, "en"), (9, z, "en")]
    rows += [(None, only, "en"), (None, only + " more", "en"), (6, y + " more", "en")]
    out = kept(corpus_pipeline.near, spark, docs_of(spark, rows))
    assert [r for r in out if r[0] is not None] == sorted([(4, x + " end"), (4, y), (9, z)], key=str)
    assert len([t for i, t in out if i is None]) == 1 and {t[: len(only)] for i, t in out if i is None} == {only}


def test_language_and_quality_stages_judge_rows_without_an_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    first = docs.where("text <> ''").orderBy("doc_id").first()
    rng = random.Random(8)
    noise = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz     ", k=400)) for _ in range(2)]
    odd = [(None, noise[0], first.lang), (first.doc_id, noise[1], first.lang), (None, first.text, first.lang)]
    full = docs.union(docs_of(spark, odd))
    out = kept(corpus_pipeline.language, spark, full)
    assert (None, odd[0][1]) not in out and (first.doc_id, odd[1][1]) not in out
    assert (None, first.text) in out and (first.doc_id, first.text) in out
    out = kept(corpus_pipeline.quality, spark, full)
    assert (None, odd[0][1]) not in out and (first.doc_id, odd[1][1]) not in out


def test_extra_columns_of_any_name_pass_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = ["_key", "_id", "_word", "_bits", "_maybe", "_text", "_row", "_h", "_salt", "any", "rows", "id", "key", "kept",
             "known", "lang_pred", "score", "n", "language", "limit", "a.b"]
    wide = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:4]:
        plain, out = stage(spark, docs, SF), stage(spark, wide, SF)
        assert out.columns == wide.columns, name
        got = {r["doc_id"]: r for r in out.collect()}
        assert sorted(got) == sorted(r.doc_id for r in plain.collect()), name
        assert all(r[n] == f"{n}{i}" for i, r in got.items() for n in names), name
    packed = corpus_pipeline.packing(spark, wide, SF)
    assert sorted(map(tuple, packed.collect())) == sorted(map(tuple, corpus_pipeline.packing(spark, docs, SF).collect()))
