"""Operators on single texts: languages, toxicity, quality, tokens, licenses."""

import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from labelpool.llm import bytescan, language_id, license_scan, quality_lm, toxicity
from labelpool.llm.sentencepiece_bpe import Encoder, decode_ids, digest_documents, encode_documents

MODEL = public_tokenizers.path("piece_bpe_32k.model")
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, row int"


def docs_of(spark, rows):
    """Documents with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, l, "s", 0, 0.5, 7) for i, t, l in rows], DOC)


EN = "the quick brown fox jumps over the lazy dog and then the other dog sleeps "
DE = "der schnelle braune fuchs springt über den faulen hund und schläft danach ein "


# --- byte scans -----------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_words_like_a_regular_expression(seed, monkeypatch):
    monkeypatch.setattr(bytescan, "WINDOW", 37)
    rng = random.Random(seed)
    texts = ["".join(rng.choice("aBcZé 9.\t\n你") for _ in range(rng.randrange(0, 200))) for _ in range(40)]
    texts += ["", "x" * 500, " ", "A" * 100 + " b"]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = bytescan.per_doc(np.array([len(r) for r in raw]))
    for blank, pattern in (
        (bytescan.BLANKS, rb"[^\x20\x09-\x0D]+"),
        (license_scan.OTHER, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"),
    ):
        h, lo, hi, doc = bytescan.words(data, offsets, blank)
        got = [(int(d), bytes(data[a:b]).lower()) for a, b, d in zip(lo, hi, doc)]
        assert got == [(d, w) for d, r in enumerate(raw) for w in re.findall(pattern, r.lower())]
        names = {}
        for (_, w), x in zip(got, h.tolist()):
            assert names.setdefault(w, x) == x
        assert len(set(names.values())) == len(names)


# --- language identification ----------------------------------------------------------------


def test_language_edges(spark):
    rows = [(i, EN * 2, "en") for i in range(6)] + [(10 + i, DE * 2, "de") for i in range(6)]
    model = language_id.train(docs_of(spark, rows + [(90, None, "en"), (91, EN, None)]))
    assert model.languages == ["de", "en"]
    odd = docs_of(spark, [
        (1, None, "x"), (2, "", "x"), (3, "123 !?", "x"), (4, EN, None), (5, DE.upper(), None),
        (5, DE.upper(), None), (6, "你", None), (7, (EN * 12_000), None), (None, DE, None),
    ])
    got = sorted(
        ((r.doc_id, r.lang_pred) for r in language_id.identify(odd, model, ["doc_id"]).collect()),
        key=str,
    )
    assert got == sorted([
        (1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "de"), (5, "de"),
        (6, model.languages[int(np.argmax(model.prior))]), (7, "en"), (None, "de"),
    ], key=str)


def test_language_of_nothing(spark):
    empty = docs_of(spark, [])
    model = language_id.train(empty)
    assert language_id.identify(empty, model, ["doc_id"]).count() == 0
    assert language_id.identify(docs_of(spark, [(1, EN, None)]), model, ["doc_id"]).first()[1:] == ("und", 0.0)


def test_language_filters_hold_every_window(spark):
    """No false negatives: the counts are at least those of plain sets."""
    rows = [(i, EN, "en") for i in range(4)] + [(9 + i, DE, "de") for i in range(4)]
    model = language_id.train(docs_of(spark, rows))
    found, total, _ = language_id.popcounts([EN, DE], 2, model)
    assert found[0, model.languages.index("en")] == total[0] > 20
    assert found[1, model.languages.index("de")] == total[1]


# --- toxicity -------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_is_edit_distance():
    terms = [("idiot", False), ("worthless", False), ("scum", False), ("achlich", True), ("loser", False)]
    lexicon = toxicity.Lexicon(terms)
    rng = random.Random(2)
    words = [t for t, _ in terms] + ["achlichkeit", "achlic", "xdiot", "iidiot", "scums", "losr", "looser", ""]
    for _ in range(4000):
        w = list(rng.choice(terms)[0])
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(0, len(w) + 1)
            w[at : at + rng.randrange(0, 2)] = rng.choice(["", "x", "i", "o"])
        words.append("".join(w))
    for w in words:
        want = []
        for i, (t, begins) in enumerate(terms):
            if begins:
                want += [(0, i, True)] if w.startswith(t) else []
                continue
            # The first letter has to be right, so the rest is compared.
            e = distance(w[1:], t[1:]) if w[:1] == t[0] else 99
            want += [(e, i, False)] if e <= toxicity.allowed(t, False) else []
        assert lexicon.match(w) == min(want, default=None), w


def swap_distance(a, b):
    """Edit distance in which two neighbouring letters that changed places are one error."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            e = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                e = min(e, rows[-2][j - 2] + 1)
            row.append(e)
        rows.append(row)
    return rows[-1][-1]


def test_loose_automaton_counts_changed_places():
    terms = [("idiot", False), ("worthless", False), ("scum", False), ("achlich", True), ("los", True), ("loser", False)]
    lexicon = toxicity.Lexicon(terms, loose=True)
    rng = random.Random(5)
    words = [t for t, _ in terms] + ["achlcihkeit", "cahlich", "diiot", "csum", "", "a", "wrothlses"]
    for _ in range(4000):
        w = list(rng.choice(terms)[0])
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(0, len(w) + 1)
            if rng.random() < 0.5:
                w[at : at + 2] = w[at : at + 2][::-1]
            else:
                w[at : at + rng.randrange(0, 2)] = rng.choice(["", "x", "i", "o"])
        words.append("".join(w))
    for w in words:
        want = []
        for i, (t, begins) in enumerate(terms):
            heads = [w[:k] for k in range(len(w) + 1)] if begins else [w]
            e = min(swap_distance(h, t) for h in heads)
            want += [(e, i, begins)] if e <= toxicity.allowed_loosely(t, begins) else []
        assert lexicon.match(w) == min(want, default=None), w


def test_ordinary_words_are_no_misspellings(spark):
    rows = [(EN + "moron", 1, i % 2) for i in range(20)]
    rows += [(EN + "a baron at boron", 0, i % 2) for i in range(60)]
    frame = spark.createDataFrame(rows, "text string, y int, fold int")
    sizes = {(f, y): sum(r[1:] == (y, f) for r in rows) for f in (0, 1) for y in (0, 1)}
    terms = [("moron", False)]
    own = toxicity.own_words(toxicity.count_terms(frame), sizes, (0, 1), terms)
    assert own == {"boron"}
    finder = toxicity.Finder(terms, own)
    assert not any(finder.features("boron"))
    assert finder.features("mroon") == finder.features("morn") and any(finder.features("morn"))
    assert toxicity.own_words(toxicity.count_terms(frame), sizes, (0, 1), []) == frozenset()


def test_misspelled_toxic_texts_are_predicted(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    model = toxicity.train(docs, labels.where(~held))
    # No find, however spelled, makes a text less toxic; only quoted ones may.
    assert all(w >= 0 for n, w in zip(toxicity.FEATURES, model.weights) if n != "quoted")
    finder, plain = toxicity.Finder(model.terms, model.own), toxicity.Lexicon(model.terms)

    def predicted(text):
        return float(model.bias + sum(a * b for a, b in zip(finder.features(text), model.weights))) >= 0

    def swapped(w, at):
        return w[:at] + w[at : at + 2][::-1] + w[at + 2 :]

    edits = {
        "replaced": lambda w, at: w[:at] + ("x" if w[at] != "x" else "y") + w[at + 1 :],
        "left out": lambda w, at: w[:at] + w[at + 1 :],
        "swapped": swapped,
    }
    toxic = labels.where(held & (F.col("toxic") == 1)).select("doc_id").join(docs, "doc_id")
    texts = [t for t in (r.text.lower() for r in toxic.select("text").collect()) if predicted(t)]
    assert len(texts) >= 5
    for name, edit in edits.items():
        rng = random.Random(3)

        def wrong(m):
            w = m.group()
            hit = plain.match(w)
            if hit is None or hit[0]:
                return w
            return edit(w, rng.randrange(min(len(w), len(model.terms[hit[1]][0]))))

        changed = [toxicity._WORD.sub(wrong, t) for t in texts]
        assert sum(map(predicted, changed)) >= 0.8 * len(texts), name


def test_misspelled_words_under_a_beginning_are_found(spark):
    rows = [(EN + w, 1, i % 2) for w in ("idiot", "idiots", "idiotic") for i in range(8)]
    rows += [(EN + "quiet day", 0, i % 2) for i in range(60)]
    frame = spark.createDataFrame(rows, "text string, y int, fold int")
    sizes = {(f, y): sum(r[1:] == (y, f) for r in rows) for f in (0, 1) for y in (0, 1)}
    terms = toxicity.learn_terms(toxicity.count_terms(frame), sizes, (0, 1))
    assert any(begins and "idiot".startswith(t) for t, begins in terms)
    lexicon = toxicity.Lexicon(terms)
    assert lexicon.match("idiotism")[0] == 0 and lexicon.match("idiot")[2]
    for word in ("ixiot", "ideot", "iidiot"):
        assert lexicon.match(word) is not None, word


def test_context_tells_quotation_from_abuse():
    finder = toxicity.Finder([("idiot", False)])
    exact, quoted = toxicity.FEATURES.index("exact"), toxicity.FEATURES.index("quoted")
    aimed = toxicity.FEATURES.index("aimed")
    plain = finder.features("you are an idiot and more")
    assert plain[exact] > 0 and plain[aimed] > 0 and plain[quoted] == 0
    for text in ('they shouted "what an idiot" there', "> idiot\nno", "the paper said idiot once"):
        assert finder.features(text)[exact] == 0 < finder.features(text)[quoted], text
    assert finder.features(None) == finder.features("") == [0.0] * len(toxicity.FEATURES)


def test_toxicity_edges(spark):
    bad = "this is a clown and a moron "
    rows = [(i, EN + (bad if i % 3 == 0 else "quiet day ") * 2, "en") for i in range(120)]
    docs = docs_of(spark, rows + [(500, None, None), (501, "", None), (501, "", None), (None, bad, None)])
    labels = spark.createDataFrame(
        [(i, int(i % 3 == 0), 9) for i in range(120)] + [(500, 1, 9), (3, None, 9), (None, 1, 9), (4, 7, 9)],
        "doc_id bigint, toxic int, y int",
    )
    model = toxicity.train(docs, labels)
    out = toxicity.score(docs, model, ["doc_id"]).collect()
    assert len(out) == docs.count()
    assert all(0 <= r.score <= 1 for r in out)
    assert all(r.predicted == int(r.doc_id % 3 == 0) for r in out if r.doc_id is not None and r.doc_id < 120)
    assert [r.predicted for r in out if r.doc_id in (500, 501)] == [0, 0, 0]
    one = toxicity.train(docs, labels.where("toxic = 1"))
    assert {round(r.score, 6) for r in toxicity.score(docs, one, ["doc_id"]).collect()} == {1.0}
    none = toxicity.train(docs.limit(0), labels.limit(0))
    assert toxicity.score(docs.limit(0), none, ["doc_id"]).count() == 0


# --- quality --------------------------------------------------------------------------------


def test_kneser_ney_sums_to_one(spark):
    """The probabilities of all characters after a seen context add up to one."""
    rows = docs_of(spark, [(i, "abracadabra abba cab %d" % (i % 3), "en") for i in range(9)])
    model = quality_lm.train(rows, rows)
    t = quality_lm.tables(model, 0)
    size = int(model.code.max()) + 1
    for context in ("abra", "cab ", "zzzz", " abb"):
        c = model.code[[ord(x) for x in context]].astype(np.int64)
        base = 0
        for x in c.tolist():
            base = (base << quality_lm.BITS) | x
        g = (base << quality_lm.BITS) | np.arange(size)
        assert np.exp(quality_lm.log_probabilities(g, t, model.floor)).sum() == pytest.approx(1, abs=1e-6)


def test_quality_edges(spark):
    good = [(i, EN * (1 + i % 4) + str(i), "en") for i in range(60)]
    odd = [(100, None, "en"), (101, "", None), (102, "ab", "en"), (103, "#§%&/()=?*+" * 30, "en"),
           (104, EN * 3000, "en"), (None, EN, "en"), (105, "#§%&" * 30, "xx"), (1, good[1][1], "en")]
    docs = docs_of(spark, good + odd)
    trusted = spark.createDataFrame([(i, 1) for i in range(60)] + [(None, 1), (7, 1)], "doc_id bigint, lang int")
    out = quality_lm.classify(docs, trusted).collect()
    assert len(out) == len(good) + len(odd)
    dropped = [r.doc_id for r in out if not r.kept]
    # 105 is of a language without trusted texts.
    assert dropped == [103]
    small = {(r.doc_id, r.n_scored): r.perplexity for r in quality_lm.classify(docs, trusted, shard=50).collect()}
    for r in out:
        assert small[r.doc_id, r.n_scored] == pytest.approx(r.perplexity)
    assert quality_lm.classify(docs, trusted.limit(0)).where("NOT kept").count() == 0
    assert quality_lm.classify(docs.limit(0), trusted).count() == 0


def test_thresholds_are_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    x = rng.random(1000)
    df = spark.createDataFrame([("en", float(v)) for v in x], "lang string, log_perplexity double")
    limit = quality_lm.thresholds(df, "lang", 0.9).first()["limit"]
    assert np.sort(x)[899] <= limit <= np.sort(x)[899] + 1e-4


# --- SentencePiece --------------------------------------------------------------------------


def test_pieces_like_the_library():
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    with open(MODEL, "rb") as f:
        encoder = Encoder(f.read())
    rng = random.Random(4)
    parts = [" ", "  ", "a", "b", "the", "ing", "tion", "\n", "\t", "é", "ß", "你", "😀", "\x00", "▁", "1", ",",
             ".", "...", "word,", "end.", "==", "<s>", "<0x0A>", "aaaa", "​", "\r\n", "//", "�"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 50))) for _ in range(4000)]
    texts += ["", " ", "a" * 3000, "ab" * 1000, " " * 300, "aab" * 500, "你好" * 300]
    for text in texts:
        ids = library.encode(text)
        assert encoder.encode(text) == ids, text
        assert decode_ids(ids, encoder.v) == library.decode(ids), text
    for _ in range(2000):
        ids = [rng.randrange(0, 300 if rng.random() < 0.5 else 32000) for _ in range(rng.randrange(0, 12))]
        assert decode_ids(ids, encoder.v) == library.decode(ids), ids


def test_encoded_documents(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {1: None, 2: "", 3: EN, 4: DE + "\n\n" + DE, 5: "x" * 5000}
    docs = docs_of(spark, [(i, t, None) for i, t in texts.items()] + [(3, EN, None)])
    out = encode_documents(docs, MODEL, ["doc_id"]).collect()
    assert len(out) == 6
    for r in out:
        ids = library.encode(texts[r.doc_id] or "")
        assert r.ids == ids and r.decoded == library.decode(ids)
    assert digest_documents(docs.limit(0), MODEL, ["doc_id"]).count() == 0


# --- licenses -------------------------------------------------------------------------------


def places(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = [
        (k, label) for p, label in license_scan.PHRASES.items() for k in range(len(w))
        if w[k : k + len(p.split())] == p.split()
    ]
    starts = [k for k, _ in found]
    return (len(w), len(found), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({label for _, label in found})))


def test_license_places(spark):
    rng = random.Random(8)
    parts = ["GNU General Public License", "gnu", "general public license", "Apache License, Version 2.0", "cc",
             "by", "CC BY-NC 4.0", "MIT License", "mit-license", "license", "the", "über", "Licensed under the",
             "All rights reserved.", "version 3", "\n", "é"]
    texts = {i: " ".join(rng.choice(parts) for _ in range(rng.randrange(0, 30))) for i in range(400)}
    texts |= {900: None, 901: "", 902: "mit mit license license", 903: "x " * 90_000 + "apache license"}
    out = license_scan.scan_licenses(docs_of(spark, [(i, t, None) for i, t in texts.items()]), ["doc_id"]).collect()
    assert len(out) == len(texts)
    for r in out:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == places(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


def test_license_labels_of_its_own(spark):
    texts = {
        1: "This work is licensed under the GNU General Public License, version 3.",
        2: "Licensed under the Apache License, Version 2.0.",
        3: "Licensed under CC BY-NC 4.0.",
        4: "public license version 3 apache rights",
    }
    out = {
        r.doc_id: r.labels
        for r in license_scan.scan_licenses(docs_of(spark, [(i, t, "") for i, t in texts.items()]), ["doc_id"]).collect()
    }
    assert out == {1: "gpl,gpl-3.0", 2: "apache,apache-2.0", 3: "cc-by,cc-by-nc-4.0", 4: ""}
    assert license_scan.scan_licenses(docs_of(spark, []), ["doc_id"]).count() == 0


def test_letters_of_the_last_planes_are_letters(spark):
    """A text of letters beyond the second plane has a language."""
    docs = spark.createDataFrame(
        [(i, "the quick brown fox " * 5, "en") for i in range(9)] + [(50, chr(0x30000) * 8, "en"), (51, chr(0x31350), "en")],
        "doc_id long, text string, lang string",
    )
    model = language_id.train(docs)
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs, model, ["doc_id"]).collect()}
    assert got[50] == got[51] == "en"
