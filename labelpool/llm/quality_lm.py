"""Quality by the perplexity of an interpolated modified Kneser-Ney n-gram model.

The model reads characters; white space counts as one blank, and characters beyond the ALPHABET
most frequent ones of all texts as one other character. Twelve bits a character make an
n-gram of ORDER characters one 64-bit number, whose context and suffix are shifts and masks, so
all counts are ordinary grouped tables:

* the highest order has counts, a lower order the number of different characters seen before it;
* three discounts for each order come from the counts of counts 1 to 4;
* joins on context and suffix give the probability of each n-gram and the weight of each context.

Scoring needs, at every character, the longest known n-gram that ends there and the weights of the
longer contexts that had no such n-gram. All of these contain the two characters before the one
scored, so the model is split into shards by those two, each of at most SHARD entries, beside the
table of the two lowest orders. Every shard scores its own characters of each text in one scan,
and a text's sums over shards give its perplexity. Shards are the only thing broadcast.

A text is kept if its perplexity is at most the threshold of its language: the QUANTILE of
the perplexities of trusted texts that were held out of training. The quantile is exact to 1e-4 of
the logarithm, by counting. Training, counts and thresholds read all trusted rows.

Defined cases: a text that is NULL or shorter than ORDER - 1 characters has no perplexity and is
kept; so is a text with fewer than EVIDENCE scored characters, and any text if nothing is trusted, or of a language without held-out trusted texts. A NULL
language is a language of its own. Rows with a NULL id are kept without being trusted. Repeated
rows each count and each give a row. Long texts are read whole, in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelpool.llm.codepoints import Counts, pieces, texts_of
from labelpool.llm.spread import with_ids
from labelpool.session import materialise

ORDER, BITS = 5, 12
ALPHABET = (1 << BITS) - 2
BLANK_CODE, OTHER_CODE = 1, 0
SHARD = 3_000_000
#: Trusted rows in this part of HELD are held out of training, for the thresholds.
HELD = 5
QUANTILE = 0.998
#: A text with fewer scored characters tells too little to be rejected.
EVIDENCE = 20
_BLANKS = [c for c in range(0x3001) if chr(c).isspace()]


def mask(n: int) -> int:
    return (1 << (BITS * n)) - 1


def codes_of(alphabet: list[int]) -> np.ndarray:
    """The code of every code point."""
    out = np.full(0x110000, OTHER_CODE, np.int16)
    out[alphabet] = np.arange(2, len(alphabet) + 2)
    out[_BLANKS] = BLANK_CODE
    return out


def grams(points: np.ndarray, owner: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(n-gram, owner)`` of every window of ORDER characters."""
    c = code[points].astype(np.int64)
    stay = np.ones(len(c), bool)
    stay[1:] = ~((c[1:] == BLANK_CODE) & (c[:-1] == BLANK_CODE) & (owner[1:] == owner[:-1]))
    c, owner = c[stay], owner[stay]
    n = len(c) - ORDER + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = np.zeros(n, np.int64)
    for k in range(ORDER):
        g = (g << BITS) | c[k : k + n]
    inside = owner[:n] == owner[ORDER - 1 :]
    return g[inside], owner[:n][inside]


def _character_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(0x110000, np.int64)
    for batch in batches:
        for points, _ in pieces(texts_of(batch.column(0)), 0):
            seen += np.bincount(points, minlength=len(seen))
    seen[_BLANKS] = 0
    some = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], ["point", "n"])


def _count_grams(code: np.ndarray):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = Counts()
            for points, owner in pieces(texts_of(batch.column(0)), ORDER - 1):
                counts.add(grams(points, owner, code)[0])
            if not counts.parts:
                continue
            g, n = counts.all()
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n)], ["g", "c"])

    return scan


def discounts(counts: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of n-grams seen 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = (max(x, 0) for x in counts)
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d1 = 1 - 2 * y * n2 / n1
    d2 = 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return tuple(float(min(max(d, 0.05), top)) for d, top in ((d1, 0.95), (d2, 1.95), (d3, 2.95)))


@dataclass
class Tables:
    """``key (order, n-gram)`` to log probability, ``key (order, context)`` to log weight."""

    keys: np.ndarray
    logp: np.ndarray
    back_keys: np.ndarray
    back: np.ndarray


@dataclass
class Model:
    code: np.ndarray
    entries: DataFrame
    shards: int
    floor: float


def _tag(order: int, g: Column) -> Column:
    return g.bitwiseOR(F.lit(order << (BITS * ORDER)))


def train(
    docs: DataFrame, trusted: DataFrame, text_col: str = "text", shard: int = SHARD
) -> Model | None:
    """The model of the texts of ``trusted``, None if they hold no window; letters from ``docs``."""
    rows = trusted.select(F.col(text_col).alias("text")).dropna()
    top = (
        docs.select(F.col(text_col).alias("text")).dropna().mapInArrow(_character_counts, "point bigint, n bigint")
        .groupBy("point")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "point")
        .limit(ALPHABET)
        .collect()
    )
    alphabet = [r["point"] for r in top]
    code = codes_of(alphabet)
    size = len(alphabet) + 2
    levels: dict[int, DataFrame] = {}
    levels[ORDER] = materialise(
        rows.mapInArrow(_count_grams(code), "g bigint, c bigint").groupBy("g").agg(F.sum("c").alias("c")),
        f"grams-{ORDER}",
    )
    if levels[ORDER].isEmpty():
        return None
    for n in range(ORDER - 1, 0, -1):
        levels[n] = materialise(
            levels[n + 1].groupBy(F.col("g").bitwiseAND(mask(n)).alias("g")).agg(F.count(F.lit(1)).alias("c")),
            f"grams-{n}",
        )
    lower: DataFrame | None = None
    entries: list[DataFrame] = []
    floor = 0.0
    for n in range(1, ORDER + 1):
        few = levels[n].where("c <= 4").groupBy("c").count().collect()
        by = {r["c"]: r["count"] for r in few}
        d1, d2, d3 = discounts([by.get(i, 0) for i in (1, 2, 3, 4)])
        off = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        table = levels[n].select(
            "g", "c", F.shiftright("g", BITS).alias("ctx"), off.alias("off"),
            F.col("g").bitwiseAND(mask(n - 1)).alias("suffix"),
        )
        context = table.groupBy("ctx").agg(
            F.sum("c").alias("total"), (F.sum("off") / F.sum("c")).alias("weight")
        )
        if n == 1:
            row = context.first()
            floor = row["weight"] / size
            made = table.select("g", "ctx", ((F.col("c") - F.col("off")) / float(row["total"]) + floor).alias("p"))
        else:
            made = table.join(context, "ctx").join(
                lower.select(F.col("g").alias("suffix"), F.col("p").alias("less")), "suffix"
            ).select(
                "g", "ctx",
                ((F.col("c") - F.col("off")) / F.col("total") + F.col("weight") * F.col("less")).alias("p"),
            )
        lower = materialise(made, f"probabilities-{n}")
        # The two characters before the one scored, where an entry has them.
        pair = lambda c, n=n: F.lit(-1) if n < 3 else c.bitwiseAND(mask(2))
        entries.append(lower.select(
            _tag(n, F.col("g")).alias("key"), F.log("p").alias("value"), F.lit(False).alias("back"),
            pair(F.col("ctx")).cast("bigint").alias("pair"),
        ))
        if n > 1:
            entries.append(context.select(
                _tag(n, F.col("ctx")).alias("key"), F.log("weight").alias("value"), F.lit(True).alias("back"),
                pair(F.col("ctx")).cast("bigint").alias("pair"),
            ))
    every = entries[0]
    for e in entries[1:]:
        every = every.union(e)
    every = materialise(every, "model")
    shards = max(1, -(-every.where("pair >= 0").count() // shard))
    return Model(code, every, shards, float(np.log(floor)))


def tables(model: Model, shard: int) -> Tables:
    """One shard of the model, with the two lowest orders; of bounded size."""
    own = (F.col("pair") < 0) | (_shard_of(F.col("pair"), model.shards) == shard)
    rows = model.entries.where(own).select("key", "value", "back").toArrow()
    key, value = rows["key"].to_numpy(), rows["value"].to_numpy()
    back = rows["back"].to_numpy()
    sides = []
    for side in (~back, back):
        order = np.argsort(key[side])
        sides += [key[side][order], value[side][order]]
    return Tables(*sides)


def _shard_of(pair, shards: int):
    """A shard of a pair of codes, the same in a column and in an array."""
    return (pair * 40503 % 65521) % shards


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[at] == wanted
    return hit, np.where(hit, values[at], 0.0)


def log_probabilities(g: np.ndarray, t: Tables, floor: float) -> np.ndarray:
    """The log probability of the last character of each n-gram after the others."""
    out = np.zeros(len(g))
    todo = np.arange(len(g))
    for n in range(ORDER, 0, -1):
        tag = n << (BITS * ORDER)
        hit, value = _find(t.keys, t.logp, (g[todo] & mask(n)) | tag)
        out[todo[hit]] += value[hit]
        todo = todo[~hit]
        if not len(todo):
            return out
        if n > 1:
            _, weight = _find(t.back_keys, t.back, ((g[todo] >> BITS) & mask(n - 1)) | tag)
            out[todo] += weight
    out[todo] += floor
    return out


def _score_shard(docs: DataFrame, model: Model, shard: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((model.code, tables(model, shard), model.floor))
    shards = model.shards

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, t, floor = shared.value
        for batch in batches:
            n = batch.num_rows
            total, count = np.zeros(n), np.zeros(n, np.int64)
            for points, owner in pieces(texts_of(batch.column(1)), ORDER - 1):
                g, owner = grams(points, owner, code)
                if shards > 1:
                    own = _shard_of((g >> BITS) & mask(2), shards) == shard
                    g, owner = g[own], owner[own]
                distinct, inverse = np.unique(g, return_inverse=True)
                total += np.bincount(owner, log_probabilities(distinct, t, floor)[inverse], n)
                count += np.bincount(owner, minlength=n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total), pa.array(count)], ["row", "total", "count"]
            )

    return docs.select("row", "text").mapInArrow(
        scan, f"row {docs.schema['row'].dataType.simpleString()}, total double, count bigint"
    )


def score(docs: DataFrame, model: Model | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep``, ``n_scored`` and ``log_perplexity`` of every row."""
    # Rows that agree in everything kept and in their text are told apart by their number only.
    frame = docs.select(
        F.struct(*keep, F.xxhash64(text_col).alias("_text")).alias("row"), F.col(text_col).alias("text")
    )
    if model is None:
        return frame.select(*[f"row.{c}" for c in keep], F.lit(0).cast("bigint").alias("n_scored"),
                            F.lit(None).cast("double").alias("log_perplexity"))
    sums = _score_shard(frame, model, 0)
    for s in range(1, model.shards):
        sums = sums.union(_score_shard(frame, model, s))
    if model.shards > 1:
        copies = F.count(F.lit(1)) / model.shards
        sums = (
            sums.groupBy("row")
            .agg((F.sum("total") / copies).alias("total"),
                 (F.sum("count") / copies).cast("bigint").alias("count"), copies.cast("int").alias("copies"))
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        )
    return sums.select(
        *[f"row.{c}" for c in keep], F.col("count").alias("n_scored"),
        F.when(F.col("count") > 0, -F.col("total") / F.col("count")).alias("log_perplexity"),
    )


def thresholds(scored: DataFrame, lang_col: str, quantile: float) -> DataFrame:
    """``(language, limit)``: the quantile of ``log_perplexity``, upwards to 1e-4, by counting."""
    counted = (
        scored.where("log_perplexity IS NOT NULL")
        .groupBy(F.col(lang_col).alias("language"), F.ceil(F.col("log_perplexity") * 10_000).alias("step"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # At most a few hundred thousand steps for each language, however many texts.
    upto = Window.partitionBy("language").orderBy("step")
    total = Window.partitionBy("language")
    return (
        counted.withColumn("upto", F.sum("n").over(upto))
        .withColumn("total", F.sum("n").over(total))
        .where(F.col("upto") >= F.col("total") * quantile)
        .groupBy("language")
        .agg((F.min("step") / 10_000).alias("limit"))
    )


def classify(
    docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    lang_col: str = "lang", quantile: float = QUANTILE, shard: int = SHARD,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``(id_col, lang_col, n_scored, perplexity, threshold, kept)`` for every row of ``docs``.

    The columns ``keep`` of ``docs`` follow. ``trusted`` holds the ids of trusted rows in its column ``id_col``.
    """
    ids = trusted.select(F.col(id_col).alias("_id")).where("_id IS NOT NULL").distinct()
    held = F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(HELD)) == 0
    slim = docs.select(id_col, text_col)
    model = train(slim, with_ids(slim, ids.where(~held), id_col), text_col, shard)
    scored = materialise(score(docs, model, [id_col, lang_col, *keep], text_col), "perplexities")
    limits = thresholds(
        scored.join(ids.where(held), F.col(id_col) == F.col("_id"), "left_semi"), lang_col, quantile
    )
    return scored.join(F.broadcast(limits), F.col(lang_col).eqNullSafe(F.col("language")), "left").select(
        id_col,
        lang_col,
        "n_scored",
        F.exp("log_perplexity").alias("perplexity"),
        F.exp("limit").alias("threshold"),
        F.coalesce(
            (F.col("log_perplexity") <= F.col("limit")) | (F.col("n_scored") < EVIDENCE), F.lit(True)
        ).alias("kept"),
        *keep,
    )
