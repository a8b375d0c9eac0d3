"""Toxicity scores: Levenshtein automata on a lexicon trie, and the context of every find.

*Lexicon.* Terms are learned from labelled texts: whole words, and word beginnings (for languages
that build long words), whose share among toxic texts is far above that among clean ones.

*Matching.* The terms form a trie. The automaton of all words within a term's edit distance is
intersected with the trie and made deterministic as texts are read: a state is the set of
(trie node, errors) pairs that are still alive, so a word is matched against the whole lexicon in
one walk, and most words die within a few letters. The finder's automaton also takes two letters
that changed places for one error, and allows errors in first letters and in beginnings of five
letters and more. A word that clean labelled texts hold is a word of its own and no misspelling.

*Context.* A find is *quoted* if it stands between quotation marks, in a quoted line, or beside a
word of reporting; it is *aimed* if a second person stands within the window. Finds are counted
by kind, quoted ones apart, and a logistic model over these counts gives the score. It is fitted on
every labelled text twice, as written and with one error in each find (drawn by a hash of text and
word), and no count but that of quoted finds can lower a score.

The lexicon and the model are fitted on at most SAMPLE labelled rows, those with the smallest hash
of their id; every row is then scored in one scan without a shuffle. Lexicon size and sample are
documented bounds of the classifier. The language, source and id of a row are never read.

Defined cases: a NULL or empty text has no finds and gets the model's score for that. If the
labelled rows hold one class only, or are none, all scores are the share of toxic rows (0 if
there are none). Rows with a NULL label or text, or of a class other than 0 and 1, are not learned
from. Repeated rows each give a row; long texts are read whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelpool.session import materialise

#: Labelled rows to fit on, terms of the lexicon, candidates among which they are chosen.
SAMPLE, TERMS, CANDIDATES = 20_000, 400, 20_000
#: Lengths of word beginnings that can be terms.
SHORTEST, LONGEST = 3, 10
#: A term's share among toxic texts is at least so many times that among clean ones.
ODDS, LEAST = 12.0, 3
WINDOW = 6
#: Words a finder remembers, and states of its automaton, before it starts anew.
CACHE, STATES = 500_000, 100_000
_WORD = re.compile(r"\w+")
#: Fixed word lists: second persons and words of reporting, in four languages.
YOU = set("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi vous ton votre"
          " tú ti usted vosotros vuestro".split())
REPORT = set("said says say wrote writes quote quoted called sagte schrieb zitat dit écrit cité"
             " dijo escribió cita".split())
MARKS = '"“”„«»‘’'
FEATURES = ("exact", "begin", "fuzzy", "quoted", "aimed", "kinds", "density")


@dataclass
class Lexicon:
    """A trie of terms with the lazily determinised automaton of their neighbourhoods.

    ``loose`` takes ``allowed_loosely`` for ``allowed``, first letters may be wrong, and two
    neighbouring letters that changed places are one error.
    """

    terms: list[tuple[str, bool]]
    states: list[tuple] = field(default_factory=list)
    loose: bool = False

    def __post_init__(self):
        allow = allowed_loosely if self.loose else allowed
        #: node -> {letter: node}; for each node the largest budget below, and its term.
        self.child: list[dict[str, int]] = [{}]
        self.budget, self.whole, self.begin = [0], [-1], [-1]
        for i, (term, is_begin) in enumerate(self.terms):
            at = 0
            for c in term:
                if c not in self.child[at]:
                    self.child[at][c] = len(self.child)
                    self.child.append({})
                    self.budget.append(0)
                    self.whole.append(-1)
                    self.begin.append(-1)
                self.budget[at] = max(self.budget[at], allow(term, is_begin))
                at = self.child[at][c]
            self.budget[at] = max(self.budget[at], allow(term, is_begin))
            (self.begin if is_begin else self.whole)[at] = i
        self.limits = [allow(*t) for t in self.terms]
        #: From these nodes on, a node waits for the one letter that ends a change of places.
        self.waiting = len(self.child)
        self.swaps: dict[tuple[int, str], list[int]] = {}
        for node in range(self.waiting if self.loose else 0):
            for a, mid in self.child[node].items():
                for c, end in self.child[mid].items():
                    if a != c and self.budget[end]:
                        self.swaps.setdefault((node, c), []).append(len(self.child))
                        self.child.append({a: end})
                        self.budget.append(self.budget[end])
                        self.whole.append(-1)
                        self.begin.append(-1)
        self.number: dict[frozenset, int] = {}
        self.step: list[dict[str, int]] = []
        self.found: list[tuple[int, int, bool] | None] = []
        self.sets: list[frozenset] = []
        self.start = self._state({(0, 0)}, None)

    def _state(self, alive: set, begun) -> int:
        """The number of the state that holds ``alive`` and everything reached by left-out letters."""
        todo = list(alive)
        while todo:
            node, e = todo.pop()
            if node >= self.waiting:
                continue
            for nxt in self.child[node].values():
                if e < self.budget[nxt] and (node or self.loose) and (nxt, e + 1) not in alive:
                    alive.add((nxt, e + 1))
                    todo.append((nxt, e + 1))
        best: dict[int, int] = {}
        for node, e in alive:
            best[node] = min(e, best.get(node, e))
        key = frozenset(best.items()) | (frozenset([(-1, begun)]) if begun is not None else frozenset())
        if key in self.number:
            return self.number[key]
        hits = []
        for node, e in best.items():
            for table, is_begin in ((self.whole, False), (self.begin, True)):
                t = table[node]
                if t >= 0 and e <= self.limits[t]:
                    hits.append((e, t, is_begin))
        opened = min([h for h in hits if h[2]], default=None)
        if begun is not None and (opened is None or begun < opened):
            opened = begun
        if opened is not None:
            hits.append(opened)
        i = self.number[key] = len(self.step)
        self.step.append({})
        self.sets.append(frozenset(best.items()))
        self.found.append(min(hits, default=None))
        self.states.append((opened,))
        return i

    def _go(self, state: int, c: str) -> int:
        alive = set()
        for node, e in self.sets[state]:
            for letter, nxt in self.child[node].items():
                if letter == c:
                    alive.add((nxt, e))
                elif e < self.budget[nxt] and (node or self.loose) and node < self.waiting:
                    alive.add((nxt, e + 1))
            if e < self.budget[node] and (node or self.loose) and node < self.waiting:
                alive.add((node, e + 1))
            for nxt in self.swaps.get((node, c), ()):
                if e < self.budget[nxt]:
                    alive.add((nxt, e + 1))
        begun = self.states[state][0]
        nxt = self._state(alive, begun) if alive or begun is not None else -1
        self.step[state][c] = nxt
        return nxt

    def match(self, word: str) -> tuple[int, int, bool] | None:
        """``(errors, term, is a beginning)`` of the closest term, or None."""
        state = self.start
        for c in word:
            nxt = self.step[state].get(c)
            if nxt is None:
                nxt = self._go(state, c)
            if nxt < 0:
                return None
            state = nxt
        return self.found[state]


def allowed(term: str, is_begin: bool) -> int:
    """Errors allowed in a term: the first letter must be right, short terms must be exact."""
    if is_begin:
        return 0
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


def allowed_loosely(term: str, is_begin: bool) -> int:
    """Errors allowed in a term, first letters and beginnings of five letters and more included."""
    if is_begin:
        return 0 if len(term) < 5 else 1
    return 0 if len(term) < 4 else 1 if len(term) < 9 else 2


def misspelled(word: str, size: int, seed: int) -> str:
    """``word`` with one error in its first ``size`` letters: replaced, left out or changed places."""
    h = zlib.crc32(f"{seed}:{word}".encode())
    kind, at = h % 3, h // 3 % size
    if kind == 1:
        return word[:at] + word[at + 1 :]
    if kind == 2 and at + 1 < len(word) and word[at] != word[at + 1]:
        return word[:at] + word[at + 1] + word[at] + word[at + 2 :]
    letter = "abcdefghijklmnopqrstuvwxyz"[h // 4096 % 26]
    return word[:at] + (letter if letter != word[at] else "x" if letter != "x" else "y") + word[at + 1 :]


@dataclass
class Model:
    """Terms, weights, and the words near a term that are words of their own."""

    terms: list[tuple[str, bool]]
    weights: np.ndarray
    bias: float
    own: frozenset[str] = frozenset()


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[tuple[str, bool], list[int]] = {}
        for text, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own: set[tuple[str, bool]] = set()
            for w in set(_WORD.findall(text.lower())):
                own.add((w, False))
                own.update((w[:k], True) for k in range(SHORTEST, min(LONGEST, len(w)) + 1))
            for t in own:
                counts.setdefault(t, [0] * 4)[cell] += 1
        keys = list(counts)
        table = np.array([counts[k] for k in keys], np.int64).reshape(len(keys), 4)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in keys], pa.string()),
                pa.array([k[1] for k in keys], pa.bool_()),
                *(pa.array(table[:, c]) for c in range(4)),
            ],
            ["term", "begins", "c0", "c1", "c2", "c3"],
        )


def count_terms(rows: DataFrame) -> DataFrame:
    """Texts with each term by cell, which is 2 * fold + class, from ``rows (text, y, fold)``."""
    return materialise(
        rows.select("text", (2 * F.col("fold") + F.col("y")).cast("int").alias("cell"))
        .mapInArrow(
            _term_counts,
            "term string, begins boolean, c0 bigint, c1 bigint, c2 bigint, c3 bigint",
        )
        .groupBy("term", "begins")
        .agg(*[F.sum(f"c{c}").alias(f"c{c}") for c in range(4)]),
        "term-counts",
    )


def learn_terms(counts: DataFrame, sizes: dict, folds: tuple[int, ...]) -> list[tuple[str, bool]]:
    """Terms that the texts of these folds teach, the most telling first."""
    p, n = (sum(sizes.get((f, y), 0) for f in folds) for y in (1, 0))
    if not p or not n:
        return []
    counts = counts.select(
        "term",
        "begins",
        sum(F.col(f"c{2 * f}") for f in folds).alias("clean"),
        sum(F.col(f"c{2 * f + 1}") for f in folds).alias("toxic"),
    )
    a, b = F.col("toxic"), F.col("clean")
    ratio = ((a + 0.5) / (p + 1)) / ((b + 0.5) / (n + 1))
    # Log likelihood gained by telling the classes apart.
    gain = a * F.log(ratio) - (a + b - F.lit((p + n) / n) * b)
    strong = (
        counts.where((a >= LEAST) & (ratio >= ODDS))
        .withColumn("gain", F.round(gain, 6))
        .orderBy(F.desc("gain"), "begins", F.desc(F.length("term")), "term")
        .limit(CANDIDATES)
        .select("term", "begins")
        .collect()
    )
    chosen: list[tuple[str, bool]] = []
    begins: set[str] = set()
    # Whole words under a beginning add nothing but their misspellings; they come last, so that a
    # word without errors is still a find of the beginning, and take no term's place.
    for term, is_begin in strong:
        if any(term[:k] in begins for k in range(SHORTEST, len(term) + 1)):
            continue
        if is_begin and any(t.startswith(term) and not other for t, other in chosen):
            # The word itself tells as much; its beginning would only add other words.
            continue
        chosen.append((term, is_begin))
        if is_begin:
            begins.add(term)
        if len(chosen) == TERMS:
            break
    under = [
        (term, False) for term, is_begin in strong
        if not is_begin and (term, False) not in chosen and allowed_loosely(term, False)
        and any(term[:k] in begins for k in range(SHORTEST, len(term) + 1))
    ]
    return chosen + under


def own_words(counts: DataFrame, sizes: dict, folds: tuple[int, ...], terms) -> frozenset[str]:
    """Words within the errors of a term that clean texts of these folds hold.

    They are words of the labelled sample, whose rows are bounded, and only those near a term.
    """
    p, n = (sum(sizes.get((f, y), 0) for f in folds) for y in (1, 0))
    clean = sum(F.col(f"c{2 * f}") for f in folds)
    toxic = sum(F.col(f"c{2 * f + 1}") for f in folds)
    shared = counts.sparkSession.sparkContext.broadcast(terms)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(list(shared.value), loose=True)
        for batch in batches:
            words = batch.column(0).to_pylist()
            keep = [w for w in words if (lexicon.match(w) or (0,))[0]]
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.string())], ["term"])

    rows = counts.where(
        ~F.col("begins") & (clean >= 1) & ((toxic + 0.5) / (p + 1) < ODDS * (clean + 0.5) / (n + 1))
    )
    found = rows.select("term").mapInArrow(near, "term string") if terms else rows.limit(0)
    return frozenset(r["term"] for r in found.select("term").collect())


def _spans(text: str) -> list[tuple[int, int]]:
    """Stretches between quotation marks on one line, and lines that begin with '>'."""
    out = [(m.start(), m.end()) for m in re.finditer(rf"[{MARKS}][^{MARKS}\n]{{1,2000}}[{MARKS}]", text)]
    return out + [(m.start(), m.end()) for m in re.finditer(r"(?m)^[ \t]*>.*$", text)]


class Finder:
    """Finds of one lexicon in texts; words already met are kept, up to a fixed number."""

    def __init__(self, terms: list[tuple[str, bool]], own: frozenset[str] = frozenset()):
        self.lexicon = Lexicon(list(terms), loose=True)
        self.own = own
        self.known: dict[str, tuple[int, int, bool] | None] = {}

    def _look_up(self, words: list[str]) -> None:
        if len(self.known) > CACHE:
            self.known.clear()
        if len(self.lexicon.step) > STATES:
            self.lexicon = Lexicon(self.lexicon.terms, loose=True)
        for w in set(words):
            if w not in self.known:
                hit = self.lexicon.match(w)
                self.known[w] = None if hit and hit[0] and w in self.own else hit

    def features(self, text: str | None, errors: bool = False) -> list[float]:
        """Counts of the finds; with ``errors``, as if every find were misspelled once."""
        low = (text or "").lower()
        words = _WORD.findall(low)
        known = self.known
        self._look_up(words)
        if errors:
            seed = zlib.crc32(low.encode("utf-8", "surrogatepass"))
            size = {w: len(self.lexicon.terms[known[w][1]][0]) for w in set(words) if known[w]}
            words = [misspelled(w, min(size[w], len(w)), seed) if w in size else w for w in words]
            self._look_up(words)
        hits = [i for i, w in enumerate(words) if known[w] is not None]
        if not hits:
            return [0.0] * len(FEATURES)
        quoted_spans = _spans(low)
        starts = [m.start() for m in _WORD.finditer(low)] if quoted_spans else []
        n: Counter = Counter()
        terms = set()
        for i in hits:
            wrong, term, is_begin = known[words[i]]
            near = words[max(0, i - WINDOW) : i + WINDOW + 1]
            quoted = any(a <= starts[i] < b for a, b in quoted_spans) if starts else False
            if quoted or not REPORT.isdisjoint(near):
                n["quoted"] += 1
                continue
            n["fuzzy" if wrong else "begin" if is_begin else "exact"] += 1
            n["aimed"] += not YOU.isdisjoint(near)
            terms.add((term, words[i]))
        finds = n["exact"] + n["begin"] + n["fuzzy"]
        return [
            *(np.log1p(n[k]) for k in ("exact", "begin", "fuzzy", "quoted", "aimed")),
            np.log1p(len(terms)),
            100.0 * finds / (len(words) + 50.0),
        ]


def _feature_scan(docs: DataFrame, terms, own, keep: list[str], text_col: str, model: Model | None):
    """``keep`` and the score of every row; without a model the features, as written and misspelled."""
    shared = docs.sparkSession.sparkContext.broadcast((terms, own, model))
    names = ["score"] if model else list(FEATURES)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, own, model = shared.value
        finder = Finder(terms, own)
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            rows = [finder.features(t) for t in texts]
            if not model:
                rows += [finder.features(t, errors=True) for t in texts]
                batch = pa.concat_batches([batch, batch])
            x = np.array(rows, float).reshape(len(rows), len(FEATURES))
            if model:
                # Equal rows must give equal scores whatever the batch: sum in a fixed order.
                z = np.full(len(x), model.bias)
                for k in range(x.shape[1]):
                    z = z + x[:, k] * model.weights[k]
                x = (1 / (1 + np.exp(-np.clip(z, -40, 40))))[:, None]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], *(pa.array(x[:, k]) for k in range(x.shape[1]))],
                [*keep, *names],
            )

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema += "".join(f", {c} double" for c in names)
    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(scan, schema)


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", sample: int = SAMPLE,
) -> Model:
    """A model from ``docs`` and ``labels (id_col, label_col)``, on at most ``sample`` labels."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Matrices

    order = F.xxhash64(F.col(id_col).cast("string"))
    taken = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(label_col).cast("int").alias("y"))
        .withColumn("_h", F.xxhash64(F.col("_id").cast("string")))
        .orderBy("_h", "_id")
        .limit(sample)
    )
    rows = materialise(
        docs.select(id_col, F.col(text_col).alias("text"))
        .where("text IS NOT NULL")
        # At most `sample` ids and labels.
        .join(F.broadcast(taken), F.col(id_col) == F.col("_id"))
        .select("text", "y", F.pmod(order, F.lit(2)).alias("fold")),
        "labelled",
    )
    cells = rows.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n")).collect()
    sizes = {(r["fold"], r["y"]): r["n"] for r in cells}
    counts = count_terms(rows)
    terms = learn_terms(counts, sizes, (0, 1))
    # Weights are fitted on finds of terms that the other half of the rows taught.
    taught = {f: learn_terms(counts, sizes, (1 - f,)) for f in (0, 1)}
    parts = [
        _feature_scan(
            rows.where(F.col("fold") == f), taught[f], own_words(counts, sizes, (1 - f,), taught[f]),
            ["y"], "text", None,
        )
        for f in (0, 1)
    ]
    made = materialise(parts[0].union(parts[1]), "features")
    share = made.agg(F.avg("y")).first()[0] or 0.0
    if not terms or share in (0.0, 1.0):
        share = min(max(share, 1e-9), 1 - 1e-9)
        return Model(terms, np.zeros(len(FEATURES)), float(np.log(share / (1 - share))))
    # Finite, as an infinite bound times the deviation of a constant count is no number.
    least = [-1e3 if name == "quoted" else 0.0 for name in FEATURES]
    fitted = LogisticRegression(
        featuresCol="x", labelCol="y", regParam=1e-3, standardization=True,
        lowerBoundsOnCoefficients=Matrices.dense(1, len(least), least),
    ).fit(made.select(array_to_vector(F.array(*FEATURES)).alias("x"), F.col("y").cast("double")))
    return Model(
        terms, np.array(fitted.coefficients.toArray()), float(fitted.intercept),
        own_words(counts, sizes, (0, 1), terms),
    )


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep``, ``score`` and ``predicted`` for every row of ``docs``."""
    out = _feature_scan(docs, model.terms, model.own, keep, text_col, model)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
