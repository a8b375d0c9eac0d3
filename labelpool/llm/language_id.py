"""Language identification with bit-sliced Bloom filters of character n-grams.

Training counts the four-letter windows of each language, keeps a window for every language where
it is about as frequent as anywhere, and sets the windows' bits in one Bloom filter for each
language. The filters share their hash functions and lie beside each other: a position holds one
bit for each language, so the AND over a window's positions is the set of all languages that
contain it. Per text, the bits are counted by language, and a count is corrected for the share of
false positives that the language's own filter has at its measured fill. The largest corrected
count decides.

The counts are sums of per-batch counts, so a language that holds most rows costs no more per task
than others. The filter has a fixed number of positions, whatever the corpus.

Defined cases: ``und`` with score 0 if the text is NULL or has no letter, or nothing was learned.
A text whose windows no language contains, or that is too short for one, gets the language with
most training windows and that language's share as its score. Ties go to the smaller name. Long
texts are read whole, in pieces. Rows of training data without a text or a language are ignored;
repeated rows count each time; every input row gives one output row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelpool.llm.bytescan import mix
from labelpool.llm.codepoints import Counts, pieces, tables, texts_of
from labelpool.session import materialise

SIZE = 4
#: A window belongs to a language in which its rate is at least this part of its highest rate.
SHARE = 0.25
#: Windows seen less often in a language are left out.
LEAST = 3
#: Positions of the filter (a power of two) and positions set for each window.
POSITIONS, HASHES = 1 << 22, 3


@dataclass
class Filters:
    """``slices[i][p]``: bits of languages 64 * i and on at position p."""

    languages: list[str]
    prior: np.ndarray
    slices: list[np.ndarray]
    false_rate: np.ndarray


def windows(points: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, owner)`` of all windows of SIZE folded characters; runs of non-letters are one."""
    folded, _ = tables()
    points = folded[np.minimum(points, len(folded) - 1)]
    blank = points == 32
    stay = np.ones(len(points), bool)
    stay[1:] = ~(blank[1:] & blank[:-1] & (owner[1:] == owner[:-1]))
    points, owner = points[stay].astype(np.uint64), owner[stay]
    n = len(points) - SIZE + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    packed = np.zeros(n, np.uint64)
    for k in range(SIZE):
        packed = packed * np.uint64(0x100000001B3) + points[k : k + n]
    inside = owner[:n] == owner[SIZE - 1 :]
    return mix(packed[inside]), owner[:n][inside]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column(1).to_pylist()
        names = sorted(set(langs))
        code = np.array([names.index(x) for x in langs], np.int64)
        held = [Counts() for _ in names]
        for points, owner in pieces(texts_of(batch.column(0)), SIZE - 1):
            grams, owner = windows(points, owner)
            which = code[owner]
            for k in np.unique(which).tolist():
                held[k].add(grams[which == k])
        for k, counts in enumerate(held):
            if not counts.parts:
                continue
            grams, n = counts.all()
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[k]] * len(grams)), pa.array(grams.view(np.int64)), pa.array(n)],
                ["lang", "gram", "n"],
            )


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Filters from the rows of ``docs`` that have a text and a language."""
    rows = docs.select(
        F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    ).dropna()
    counts = materialise(
        rows.mapInArrow(_counts, "lang string, gram bigint, n bigint")
        .groupBy("gram", "lang")
        .agg(F.sum("n").alias("n")),
        "gram-counts",
    )
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        return Filters([], np.zeros(0), [], np.zeros(0))
    total = np.array([totals[x] for x in languages], float)
    known = F.create_map(*[F.lit(y) for i, x in enumerate(languages) for y in (x, i)])
    sums = F.create_map(*[F.lit(y) for x in languages for y in (x, float(totals[x]))])
    rated = counts.where(F.col("n") >= LEAST).select(
        "gram", known[F.col("lang")].alias("code"), (F.col("n") / sums[F.col("lang")]).alias("rate")
    )
    by_gram = rated.groupBy("gram").agg(
        F.max("rate").alias("top"), F.collect_list(F.struct("code", "rate")).alias("all")
    )
    slices = []
    for at in range(0, len(languages), 64):
        bits = F.aggregate(
            F.filter("all", lambda s: (s["rate"] >= F.col("top") * SHARE)
                     & s["code"].between(at, at + 63)),
            F.lit(0).cast("bigint"),
            lambda acc, s: acc.bitwiseOR(
                F.call_function("shiftleft", F.lit(1).cast("bigint"), s["code"] - at)
            ),
        )
        set_bits = (
            by_gram.select("gram", bits.alias("bits"))
            .where("bits <> 0")
            .select(
                F.explode(F.array(*[_position(F.col("gram"), k) for k in range(HASHES)])).alias("p"),
                "bits",
            )
            .groupBy("p")
            .agg(F.bit_or("bits").alias("bits"))
        )
        # At most POSITIONS rows of two numbers.
        table = set_bits.toArrow()
        width = min(64, len(languages) - at)
        kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64)
                    if np.dtype(t).itemsize * 8 >= width)
        held = np.zeros(POSITIONS, kind)
        held[table["p"].to_numpy()] = table["bits"].to_numpy().view(np.uint64).astype(kind)
        slices.append(held)
    fill = np.array(
        [np.mean((slices[i // 64] >> slices[i // 64].dtype.type(i % 64)) & 1) for i in range(len(languages))]
    )
    return Filters(languages, total / total.sum(), slices, fill**HASHES)


def _position(gram, k: int):
    """The k-th position of a window: other bits of its hash for each k."""
    return F.shiftrightunsigned(gram, 21 * k).bitwiseAND(POSITIONS - 1).cast("int")


def _places(grams: np.ndarray) -> list[np.ndarray]:
    return [
        ((grams >> np.uint64(21 * k)) & np.uint64(POSITIONS - 1)).astype(np.int64)
        for k in range(HASHES)
    ]


def popcounts(texts: Iterable[str | None], n: int, model: Filters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(counts[text, language], windows[text], has a letter[text])`` of n texts."""
    found = np.zeros((n, len(model.languages)))
    total = np.zeros(n)
    letters = np.zeros(n, bool)
    _, letter = tables()
    for points, owner in pieces(texts, SIZE - 1):
        letters[owner[letter[np.minimum(points, len(letter) - 1)]]] = True
        grams, owner = windows(points, owner)
        total += np.bincount(owner, minlength=n)
        places = _places(grams)
        for at, held in enumerate(model.slices):
            hit = held[places[0]]
            for p in places[1:]:
                hit &= held[p]
            for i in range(min(64, len(model.languages) - 64 * at)):
                has = (hit >> hit.dtype.type(i)) & hit.dtype.type(1)
                found[:, 64 * at + i] += np.bincount(owner, has, n)
    return found, total, letters


def decide(found, total, letters, model: Filters) -> tuple[list[str], np.ndarray]:
    """Language and score of each text from its counts."""
    if not model.languages:
        return ["und"] * len(total), np.zeros(len(total))
    f = model.false_rate
    true = np.maximum(0.0, (found - total[:, None] * f) / np.maximum(1 - f, 1e-9))
    best = np.argmax(true, axis=1)
    top, all_ = true[np.arange(len(best)), best], true.sum(axis=1)
    usual = int(np.argmax(model.prior))
    none = all_ <= 0
    best[none] = usual
    score = np.where(none, model.prior[usual], top / np.where(none, 1, all_))
    names = [model.languages[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist())]
    return names, np.where(letters, score, 0.0)


def known(found, total, model: Filters) -> np.ndarray:
    """The part of each text's windows that its best language knows; NaN if it has no window."""
    f = model.false_rate
    true = np.maximum(0.0, (found - total[:, None] * f) / np.maximum(1 - f, 1e-9))
    top = true.max(axis=1, initial=0.0)
    return np.where(total > 0, np.minimum(1.0, top / np.maximum(total, 1)), np.nan)


def identify(
    docs: DataFrame, model: Filters, keep: list[str], text_col: str = "text", evidence: bool = False
) -> DataFrame:
    """``keep``, ``lang_pred`` and ``score`` for every row of ``docs``.

    With ``evidence`` also ``known``, the part of the text's windows that its language knows, which
    is NULL for a text without a window.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    frame = docs.select(*keep, F.col(text_col).alias("_text"))
    added = ["lang_pred", "score", *(["known"] if evidence else [])]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(len(keep)))
            found, total, letters = popcounts(texts, batch.num_rows, shared.value)
            names, score = decide(found, total, letters, shared.value)
            made = [pa.array(names, pa.string()), pa.array(score)]
            if evidence:
                made.append(pa.array(known(found, total, shared.value), from_pandas=True))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], [*keep, *added])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    more = ", known double" if evidence else ""
    return frame.mapInArrow(scan, f"{schema}, lang_pred string, score double{more}")
