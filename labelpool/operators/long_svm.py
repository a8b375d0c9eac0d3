"""Cross-validation of the hinge classifier over many features; no weight or gradient reaches the driver.

The steps are those of Spark ML's ``LinearSVC`` (scaled and centred features, OWL-QN with a history
of ten and a backtracking search), so margins agree but for the order of summation. There every
evaluation sends a gradient of all features to the driver. Here the weights, gradients and
history of all folds lie in blocks of features, beside the values of these features; a
step exchanges sums of margins by row and one bit a row, and the driver sees dot products only.

A task holds up to three numbers a fold for the features of its block, and besides that passes over
records of bounded size: tiles of values, each of one block of features and one block of rows, and
strips of the state.
"""

from __future__ import annotations

import gc
import os
import pickle
import tempfile
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import groupby

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.accumulators import AccumulatorParam
from pyspark.ml.classification import LinearSVC
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.linalg import SparseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelpool.session import materialise, shared_dir

MEMORY = 10
# Features in a block and in a strip of its state, rows in a block of rows, at most. Java keeps the last
# hundred records of a stream that it reads or writes, so that strips and pieces of tiles are short.
BLOCK_FEATURES, STRIP, BLOCK_ROWS = 1 << 18, 1 << 8, 1 << 16
# Values in a tile, in a record of one, and in a piece that one task adds to it, on average.
TILE_VALUES, RECORD_VALUES, PIECE_VALUES = 1 << 19, 1 << 15, 1 << 12
# Numbers that come together for a block of rows, and in one record on the way there.
ROW_NUMBERS, RECORD = 1 << 22, 1 << 12
# Steps after which the state is written to the shared folder, which cuts its lineage.
WRITE_EVERY = 8
# Tiles and state are passed over record by record; no executor needs to hold them in memory.
KEPT = StorageLevel.DISK_ONLY


def cross_validate_hinge(estimator: LinearSVC, rows: DataFrame, k: int) -> tuple[float, float]:
    """Mean AUC over the folds in column ``fold`` and twice its population deviation, as
    ``models.cross_validate`` gives them; ``rows`` is ``(features, y, fold)`` with sparse vectors."""
    scored = materialise(fold_margins(estimator, rows, k), "fold-margins")
    evaluator = BinaryClassificationEvaluator(
        rawPredictionCol="margin", labelCol="y", metricName="areaUnderROC", numBins=0
    )
    found = [evaluator.evaluate(scored.where(F.col("fold") == fold)) for fold in range(k)]
    return float(np.mean(found)), float(2 * np.std(found))


def fold_margins(estimator: LinearSVC, rows: DataFrame, k: int) -> DataFrame:
    """``(fold, y, margin)``: every row under the model that its fold was held out of."""
    spark = rows.sparkSession
    rows = materialise(rows.select("features", F.col("y").cast("double"), F.col("fold").cast("int")), "cv")
    sizes = _training_sizes(rows, k)
    blocks = _Blocks(rows, sizes, estimator.getRegParam())
    searches = [_Search(estimator.getMaxIter(), estimator.getTol()) for _ in range(k)]
    while any(s.alpha is not None for s in searches):
        found = blocks.evaluate([s.order() for s in searches])
        for fold, search in enumerate(searches):
            if search.alpha is not None:
                search.told(found[fold])
    return spark.createDataFrame(
        blocks.held_out([s.order() for s in searches]), "fold int, y double, margin double"
    )


def _training_sizes(rows: DataFrame, k: int) -> np.ndarray:
    """Rows on the training side of each fold."""
    found = {(r["fold"], r["y"]): r["count"] for r in rows.groupBy("fold", "y").count().collect()}
    for fold, y in found:
        if fold is None or not 0 <= fold < k:
            raise ValueError(f"folds must lie in 0..{k - 1}, not {fold!r}")
        if y not in (0.0, 1.0):
            raise ValueError(f"labels must be 0 or 1, not {y!r}")
    own = np.array([sum(found.get((fold, y), 0) for y in (0.0, 1.0)) for fold in range(k)])
    for fold in range(k):
        if not own[fold]:
            raise ValueError(f"the validation data at fold {fold} is empty")
        if own[fold] == own.sum():
            raise ValueError(f"the training data at fold {fold} is empty")
    return own.sum() - own


# ---- On the driver: one search a fold, in dot products ----------------------------------------


class _Search:
    """The search for one fold's weights. It asks for one evaluation at a time, of a step of length
    ``alpha`` along the direction; ``alpha`` is None when it has ended."""

    def __init__(self, steps: int, tol: float):
        self.steps, self.tol = steps, tol
        self.iter, self.failed, self.seen = 0, False, [np.inf]
        self.value: float | None = None
        self.alpha: float | None = 0.0
        self.accept, self.turn = "", None
        self._forget()

    def _forget(self) -> None:
        self.sy = self.yy = np.zeros((0, 0))
        self.sg = self.yg = np.zeros(0)

    def order(self) -> dict:
        """What the blocks do next: take the last trial, turn, step."""
        out = {"alpha": self.alpha, "accept": self.accept, "turn": self.turn}
        self.accept, self.turn = "", None
        return out

    def told(self, found: dict) -> None:
        if self.value is None:
            self.value = self.start = found["value"]
            self.accept, self.gg = "start", found["gg"]
            if not self._ended():
                self._turn()
            return
        if self.slope is None:
            self.slope = found["slope0"]
            # Spark judges the first length by the value before the step, so it is cut unasked.
            if not self._cut_unasked():
                self.alpha, self.tries, self.unasked = self.length, 0, True
                return
        value = self.value if self.unasked else found["value"]
        self.unasked = False
        if value > self.value + self.alpha * self.slope * 1e-4:
            self._try(self.alpha * self._shrink(), found)
        elif found["slope"] < 0.9 * self.slope:
            self._try(self.alpha * 2.1, found)
        elif found["slope"] > -0.9 * self.slope:
            self._try(self.alpha * self._shrink(), found)
        else:
            self._step(found)

    def _shrink(self) -> float:
        return 0.5 if self.iter else 0.1

    def _cut_unasked(self) -> bool:
        return self.value > self.value + self.length * self.slope * 1e-4

    def _try(self, alpha: float, found: dict) -> None:
        if not 1e-10 <= alpha <= 1e10:
            self._fail()
        elif self.tries >= 19:
            self._step(found)
        else:
            self.alpha, self.tries = alpha, self.tries + 1

    def _fail(self) -> None:
        """Begin again without a history; the second time in a row, end where it stands."""
        if self.failed:
            self.alpha = None
            return
        self.failed = True
        self._forget()
        self._turn()

    def _step(self, found: dict) -> None:
        """Take the trial. The newest of the history comes first."""
        self.value, self.gg, self.failed = found["value"], found["gg"], False
        self.seen = [*self.seen, self.value][-20:]
        self.accept = "step"
        s_y, y_s, y_y, g_s, g_y = found["dots"]
        m = min(len(self.sg) + 1, MEMORY)
        sy, yy = np.empty((m, m)), np.empty((m, m))
        sy[1:, 1:], yy[1:, 1:] = self.sy[: m - 1, : m - 1], self.yy[: m - 1, : m - 1]
        sy[:, 0], sy[0], yy[0], yy[:, 0] = y_s[:m], s_y[:m], y_y[:m], y_y[:m]
        self.sy, self.yy, self.sg, self.yg = sy, yy, g_s[:m], g_y[:m]
        self.iter += 1
        if not self._ended():
            self._turn()

    def _ended(self) -> bool:
        flat = len(self.seen) >= 2 and abs(self.value - max(self.seen)) <= self.tol * abs(self.start)
        still = np.sqrt(self.gg) <= max(self.tol * self.value, 1e-8)
        if self.iter >= self.steps or flat or still:
            self.alpha = None
        return self.alpha is None

    def _turn(self) -> None:
        """The two loops of L-BFGS, in dot products."""
        m, scale = len(self.sg), 1.0
        first, second = np.zeros(m), np.zeros(m)
        with np.errstate(all="ignore"):
            if m:
                scale = self.sy[0, 0] / self.yy[0, 0]
            for i in range(m):
                first[i] = (self.sg[i] - first[:i] @ self.sy[i, :i]) / self.sy[i, i]
            for i in reversed(range(m)):
                inner = scale * (self.yg[i] - first @ self.yy[i]) + second[i + 1 :] @ self.sy[i + 1 :, i]
                second[i] = first[i] - inner / self.sy[i, i]
        if m and (self.sy[0, 0] < 0 or np.isnan(scale) or np.isnan(first).any()):
            self._fail()
            return
        self.turn = (first, scale, second)
        self.slope, self.unasked = None, False
        self.length = 1.0 if self.iter else 0.5 / np.sqrt(self.gg)
        self.alpha, self.tries = self.length * self._shrink(), 1


# ---- In tasks ---------------------------------------------------------------------------------


class _Blocks:
    """Blocks of features with their values in tiles and the state of all folds in strips; blocks of
    rows with labels."""

    def __init__(self, rows: DataFrame, sizes: np.ndarray, penalty: float):
        self.sc = sc = rows.sparkSession.sparkContext
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(shared_dir(rows.sparkSession))
        numbered = rows.rdd.zipWithIndex()
        n, total, d = numbered.mapPartitions(_count).reduce(lambda a, b: (a[0] + b[0], a[1] + b[1], max(a[2], b[2])))
        cores = max(sc.defaultParallelism, 1)
        self.parts = parts = cores * max(-(-d // (cores * BLOCK_FEATURES)), 1)
        # Block 0 holds the intercept and is never left out.
        self.used = min(parts, max(d, 1))
        size = min(
            BLOCK_ROWS, -(-n // cores), ROW_NUMBERS // (parts * len(sizes)), TILE_VALUES * parts * n // max(total, 1)
        )
        self.size = size = max(size, 1)
        self.row_parts = -(-n // size)
        truth = numbered.mapPartitions(lambda part: _truths(part, size)).partitionBy(self.row_parts)
        self.truth = truth.mapPartitions(_row_block, preservesPartitioning=True).persist(KEPT)
        pieces = numbered.mapPartitions(lambda part: _split(part, parts, size)).partitionBy(parts)
        self.tiles = pieces.mapPartitions(_tiles, preservesPartitioning=True).persist(KEPT)
        none = sc.parallelize([(k, ("none", None)) for k in range(self.used)], 1)
        self.state = _beside(parts, none, self.tiles).mapPartitions(
            lambda part: _start(part, sizes, d, parts), preservesPartitioning=True
        ).persist(KEPT)
        self.d, self.sizes, self.penalty, self.rounds, self.written = d, sizes, penalty, 0, None

    def _margins(self, orders: list[dict]) -> RDD:
        """``(kind, value)`` for each block of rows: its labels, then the parts of its margins."""
        d, parts, size, row_parts = self.d, self.parts, self.size, self.row_parts
        sums = _beside(parts, self.state, self.tiles).mapPartitions(
            lambda part: _partial_margins(part, orders, d, parts, row_parts)
        )
        return _beside(row_parts, self.truth, sums)

    def evaluate(self, orders: list[dict]) -> dict[int, dict]:
        """Per fold with an ``alpha`` the value, slope and dot products of its trial."""
        d, parts, sizes, penalty = self.d, self.parts, self.sizes, self.penalty
        hits = self._margins(orders).mapPartitions(lambda part: _hits(part, orders, parts))
        # Told by the tasks that make the state, so that nobody reads it for a few sums.
        sums = self.sc.accumulator({}, _ByBlock())
        state = _beside(parts, hits, self.tiles, self.state).mapPartitions(
            lambda part: _trial(part, orders, sizes, penalty, d, parts, sums), preservesPartitioning=True
        ).persist(KEPT)
        self.rounds += 1
        write = self.rounds % WRITE_EVERY == 0
        if write:
            state.checkpoint()
        # Counted where it is kept; no Python worker reads it.
        state._jrdd.count()
        made, sums.value = sums.value, {}
        if len(made) != self.used:
            raise RuntimeError(f"{len(made)} blocks of {self.used} told their sums")
        self.state.unpersist()
        self.state = state
        if write:
            self._forget(state.getCheckpointFile())
        out = {}
        for fold, order in enumerate(orders):
            if order["alpha"] is not None:
                own = [made[k][fold] for k in sorted(made)]
                out[fold] = {name: sum(f[name] for f in own) for name in own[0]}
        return out

    def _forget(self, written: str) -> None:
        """Let go of the state written before and of the shuffle files of the steps since."""
        if self.written is not None:
            path = self.sc._jvm.org.apache.hadoop.fs.Path(self.written)
            path.getFileSystem(self.sc._jsc.hadoopConfiguration()).delete(path, True)
        self.written = written
        # Spark deletes shuffle files when the driver collects what refers to them.
        gc.collect()
        self.sc._jvm.System.gc()

    def held_out(self, orders: list[dict]) -> RDD:
        """``(fold, y, margin)`` at the weights themselves."""
        orders = [order | {"alpha": 0.0, "turn": None, "stay": True} for order in orders]
        return self._margins(orders).mapPartitions(_own_margins)


class _ByBlock(AccumulatorParam):
    """Values by block; a block that is made again says the same again."""

    def zero(self, value: dict) -> dict:
        return {}

    def addInPlace(self, one: dict, other: dict) -> dict:
        return one | other


def _beside(parts: int, *sides: RDD) -> RDD:
    """The pairs ``(key, (kind, value))`` of every key, side after side; what is dealt already stays."""
    dealt = [side.partitionBy(parts) for side in sides]
    for side in dealt:
        # Batches of any size are read alike; else one more Python worker a task would write them anew.
        side._jrdd_deserializer = side.ctx.serializer
    out = reduce(RDD.union, dealt)
    if out.partitioner != dealt[0].partitioner:
        raise RuntimeError("the sides are dealt in different ways")
    return out


def _entries(vector) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values other than zero."""
    if isinstance(vector, SparseVector):
        if (np.diff(vector.indices) <= 0).any():
            raise ValueError("a row names a feature twice")
        used = vector.values != 0
        return vector.indices[used], vector.values[used]
    used = np.flatnonzero(vector.toArray())
    return used, vector.toArray()[used]


def _count(part: Iterable) -> Iterator[tuple[int, int, int]]:
    rows = values = top = 0
    for row, _ in part:
        idx = _entries(row["features"])[0]
        rows, values = rows + 1, values + len(idx)
        if len(idx):
            top = max(top, int(idx[-1]) + 1)
    yield rows, values, top


def _truths(part: Iterable, size: int) -> Iterator[tuple[int, tuple]]:
    """Labels and folds of runs of rows, dealt to the blocks of their rows."""
    held: list = []
    for row, i in part:
        if held and (i // size != held[0][0] // size or len(held) >= RECORD):
            yield _run(held, size)
            held = []
        held.append((i, row["y"], row["fold"]))
    if held:
        yield _run(held, size)


def _run(held: list, size: int) -> tuple[int, tuple]:
    first = held[0][0]
    return first // size, (first, np.array([h[1] for h in held]), np.array([h[2] for h in held], "int32"))


def _row_block(part: Iterable) -> Iterator[tuple[int, tuple]]:
    """Labels and folds in row order."""
    runs = sorted(part, key=lambda p: p[1][0])
    if runs:
        yield runs[0][0], ("truth", tuple(np.concatenate([run[i] for _, run in runs]) for i in (1, 2)))


def _split(part: Iterable, parts: int, size: int) -> Iterator[tuple[int, tuple]]:
    """The values of some rows of one block, dealt to the blocks of their features."""
    held, values = [], 0
    for row, i in part:
        if held and (i // size != held[0][0] // size or values >= PIECE_VALUES * parts):
            yield from _pieces(held, parts, size)
            held, values = [], 0
        found = _entries(row["features"])
        held.append((i, *found, row["y"], row["fold"]))
        values += len(found[0])
    if held:
        yield from _pieces(held, parts, size)


def _pieces(held: list, parts: int, size: int) -> Iterator[tuple[int, tuple]]:
    idx, value = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
    at = np.repeat(np.arange(len(held)), [len(h[1]) for h in held])
    row = np.array([h[0] % size for h in held], "int32")
    sign, fold = np.array([2 * h[3] - 1 for h in held], "int8"), np.array([h[4] for h in held], "int32")
    order = np.argsort(idx % parts, kind="stable")
    ends = np.cumsum(np.bincount(idx % parts, minlength=parts))
    for k in np.unique(idx % parts).tolist():
        here = order[ends[k - 1] if k else 0 : ends[k]]
        rows, lengths = np.unique(at[here], return_counts=True)
        piece = row[rows], lengths, sign[rows], fold[rows], (idx[here] // parts).astype("int32"), value[here]
        yield k, (held[0][0] // size, piece)


def _tiles(part: Iterable) -> Iterator[tuple[int, tuple]]:
    """The values of a block of features in tiles, one for each block of rows, and these in records, all in row
    order. Pieces come as they come; they wait in a file."""
    places: dict[int, list[tuple[int, int]]] = {}
    k = None
    with tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None) as file:
        for k, (r, piece) in part:
            places.setdefault(r, []).append((int(piece[0][0]), file.tell()))
            pickle.dump(piece, file, protocol=5)
        for r in sorted(places):
            held: list = []
            for _, place in sorted(places[r]):
                if sum(len(piece[-1]) for piece in held) >= RECORD_VALUES:
                    yield k, ("tile", (r, _joined(held)))
                    held = []
                file.seek(place)
                held.append(pickle.load(file))
            yield k, ("tile", (r, _joined(held)))


def _joined(pieces: list) -> tuple:
    return tuple(np.concatenate(x) for x in zip(*pieces, strict=True))


def _whole_tiles(part: Iterable) -> Iterator[tuple[int, tuple]]:
    """The records of a tile as one, with names; all others as they are."""
    for (k, kind, r), records in groupby(part, lambda p: (p[0], p[1][0], p[1][0] == "tile" and p[1][1][0])):
        if kind == "tile":
            names = "row", "lengths", "sign", "fold", "col", "value"
            tile = dict(zip(names, _joined([held[1] for _, (_, held) in records]), strict=True))
            yield k, (kind, tile | {"r": r, "col": tile["col"].astype(np.intp)})
        else:
            for record in records:
                yield record


def _width(k: int, d: int, parts: int) -> int:
    """Features of a block."""
    return len(range(k, d, parts))


def _start(part: Iterable, sizes: np.ndarray, d: int, parts: int) -> Iterator[tuple[int, tuple]]:
    """The first state, in strips: per fold the scale and scaled mean of each feature among its training
    rows, and no weights yet. The last strip of block 0 has the intercept as its last weight."""
    folds, k, moments = len(sizes), None, None
    for k, (kind, tile) in _whole_tiles(part):
        if moments is None:
            width = _width(k, d, parts)
            moments = np.zeros((3, folds, width))
        if kind == "tile":
            _add_moments(moments.reshape(3, -1), tile, width)
    if moments is None:
        return
    for lo in range(0, max(width, 1), STRIP):
        scale, mean = _scales(moments[:, :, lo : lo + STRIP], sizes)
        extra = int(k == 0 and lo + STRIP >= width)
        zero = np.zeros(scale.shape[1] + extra)
        first = {"x": zero, "g": zero, "s": [], "y": [], "dir": zero, "xt": zero, "gt": zero}
        yield k, ("state", {"lo": lo, "extra": extra, "scale": scale, "mean": mean, "folds": [first] * folds})


def _add_moments(moments: np.ndarray, tile: dict, width: int) -> None:
    """Add a tile to the counts, means and squared deviations of each fold's own rows."""
    cell = np.repeat(tile["fold"].astype(np.intp) * width, tile["lengths"]) + tile["col"]
    cells, at = np.unique(cell, return_inverse=True)
    count = np.bincount(at)
    mean = np.bincount(at, tile["value"]) / count
    spread = np.bincount(at, (tile["value"] - mean[at]) ** 2)
    before, middle, so_far = moments[:, cells]
    both, gap = before + count, mean - middle
    moments[0, cells] = both
    moments[1, cells] = middle + gap * count / both
    moments[2, cells] = so_far + spread + gap**2 * before * count / both


def _scales(moments: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scale, mean = np.zeros(moments.shape[1:]), np.zeros(moments.shape[1:])
    for f, total in enumerate(sizes):
        counts, means, spreads = np.delete(moments, f, axis=1)
        count = counts.sum(axis=0)
        middle = (counts * means).sum(axis=0) / np.maximum(count, 1)
        spread = (spreads + counts * (means - middle) ** 2).sum(axis=0)
        # Rounding must not give a feature that never varies a scale.
        spread[spread <= count * (1e-14 * middle) ** 2] = 0.0
        square = spread + middle**2 * count * np.maximum(total - count, 0) / total
        deviation = np.sqrt(square / (total - 1)) if total > 1 else np.zeros(len(count))
        scale[f] = np.divide(1.0, deviation, out=np.zeros(len(count)), where=deviation != 0)
        mean[f] = middle * count / total * scale[f]
    return scale, mean


def _moved(state: dict, order: dict) -> dict:
    """The state of a fold after its order, with the next trial ``xt``; of a fold that has ended, its weights."""
    x, g, s, y, direction = (state[name] for name in ("x", "g", "s", "y", "dir"))
    if order["accept"]:
        if order["accept"] == "step":
            s, y = [state["xt"] - x, *s][:MEMORY], [state["gt"] - g, *y][:MEMORY]
        x, g = state["xt"], state["gt"]
    if order["alpha"] is None:
        return {"x": x, "g": None, "s": [], "y": [], "dir": None, "xt": None, "gt": None}
    if order["turn"] is not None:
        first, scale, second = order["turn"]
        s, y = s[: len(first)], y[: len(first)]
        direction = g.copy()
        for a, v in zip(first, y, strict=True):
            direction -= a * v
        direction *= scale
        for a, v in zip(second[::-1], s[::-1], strict=True):
            direction += a * v
        direction = -direction
        # OWL-QN: no weight moves up its slope, and none changes its sign in one step.
        direction[direction * g >= 0] = 0.0
    trial = x
    if order["alpha"] is not None and not order.get("stay"):
        trial = x + direction * order["alpha"]
        trial[np.sign(trial) != np.where(x != 0, np.sign(x), np.sign(-g))] = 0.0
    return {"x": x, "g": g, "s": s, "y": y, "dir": direction, "xt": trial, "gt": state["gt"]}


def _at_work(orders: list[dict]) -> list[int]:
    return [f for f, order in enumerate(orders) if order["alpha"] is not None]


def _partial_margins(part: Iterable, orders: list[dict], d: int, parts: int, row_parts: int) -> Iterator[tuple]:
    """What a block's features add to the margins of every row block, for each fold at work. The
    state comes first."""
    at_work, k, weights = _at_work(orders), None, None
    step = max(RECORD // max(len(at_work), 1), 1)
    for k, (kind, held) in _whole_tiles(part):
        if weights is None:
            weights, shift = np.zeros((len(at_work), _width(k, d, parts))), np.zeros(len(at_work))
        if kind == "state":
            here = slice(held["lo"], held["lo"] + held["scale"].shape[1])
            for a, f in enumerate(at_work):
                trial = _moved(held["folds"][f], orders[f])["xt"]
                if held["extra"]:
                    shift[a], trial = shift[a] + trial[-1], trial[:-1]
                weights[a, here] = trial * held["scale"][f]
                shift[a] -= trial @ held["mean"][f]
            continue
        starts = np.cumsum(held["lengths"]) - held["lengths"]
        col = held["col"]
        margins, terms = np.empty((len(at_work), len(starts))), np.empty(len(col))
        for own, out in zip(weights, margins, strict=True):
            # Indices are in range; clip spares their check.
            np.take(own, col, mode="clip", out=terms)
            np.add.reduceat(np.multiply(terms, held["value"], out=terms), starts, out=out)
        for lo in range(0, len(starts), step):
            here = slice(lo, lo + step)
            yield held["r"], ("part", (k, lo, held["row"][here], np.ascontiguousarray(margins[:, here])))
    if weights is not None:
        for r in range(row_parts):
            yield r, ("shift", (k, shift))


def _whole(part: Iterable) -> tuple | None:
    """Of a block of rows the number, labels, folds, and margins by fold and row. The labels come
    first; the parts are added in the order of the blocks."""
    r, truth, parts, shifts = None, None, [], []
    for r, (kind, held) in part:
        if kind == "truth":
            truth = held
        else:
            (parts if kind == "part" else shifts).append(held)
    if truth is None:
        return None
    margins = sum(shift for _, shift in sorted(shifts, key=lambda s: s[0]))[:, None] * np.ones(len(truth[0]))
    for _, _, row, found in sorted(parts, key=lambda p: p[:2]):
        margins[:, row] += found
    return r, *truth, margins


def _hits(part: Iterable, orders: list[dict], blocks: int) -> Iterator[tuple]:
    """Which training rows have a loss, one bit each, with the sums of losses and of their signs."""
    whole = _whole(part)
    if whole is None:
        return
    r, y, own, margins = whole
    sign = 2 * y - 1
    loss = 1 - sign * margins
    hit = (loss > 0) & (own != np.array(_at_work(orders))[:, None])
    sums = np.where(hit, loss, 0.0).sum(axis=1), np.where(hit, -sign, 0.0).sum(axis=1)
    bits = np.packbits(hit, axis=1)
    for k in range(blocks):
        yield k, ("hits", (r, bits, *sums))


def _trial(
    part: Iterable, orders: list[dict], sizes: np.ndarray, penalty: float, d: int, parts: int, sums
) -> Iterator[tuple[int, tuple]]:
    """The state with the gradient of each trial, strip by strip; ``sums`` gets what the block adds to the
    sums over features. The hits come first, then the tiles, then the state."""
    at_work, hits, found, gradients = _at_work(orders), {}, {}, None
    k = None
    for k, (kind, held) in _whole_tiles(part):
        if kind == "hits":
            hits[held[0]] = held[1:]
            continue
        if gradients is None:
            gradients = np.zeros((len(at_work), _width(k, d, parts)))
            losses, signs = (sum(hits[r][i] for r in sorted(hits)) for i in (1, 2))
        if kind == "tile":
            bits = np.unpackbits(hits[held["r"]][0], axis=1)
            for a, hit in enumerate(bits):
                terms = np.repeat(-1.0 * held["sign"] * hit[held["row"]], held["lengths"])
                terms *= held["value"]
                gradients[a] += np.bincount(held["col"], terms, gradients.shape[1])
            continue
        folds, lo, hi = [], held["lo"], held["lo"] + held["scale"].shape[1]
        for f, (state, order) in enumerate(zip(held["folds"], orders, strict=True)):
            now = _moved(state, order)
            if order["alpha"] is not None:
                a, trial, scale = at_work.index(f), now["xt"], held["scale"][f]
                gradient = np.zeros(len(trial))
                gradient[: hi - lo] = gradients[a, lo:hi] * scale - held["mean"][f] * signs[a]
                weight = np.zeros(len(trial))
                weight[: hi - lo] = scale**2
                if held["extra"]:
                    gradient[-1] = signs[a]
                now["gt"] = gradient = gradient / sizes[f] + penalty * trial * weight
                # The losses go with the intercept.
                loss = losses[a] / sizes[f] if held["extra"] else 0.0
                own = _found(now, gradient, loss, penalty * weight)
                found[f] = {name: own[name] + found[f][name] for name in own} if f in found else own
            folds.append(now)
        yield k, ("state", held | {"folds": folds})
    if gradients is not None:
        sums.add({k: found})


def _found(now: dict, gradient: np.ndarray, loss: float, penalty: np.ndarray) -> dict:
    ds, dy = now["xt"] - now["x"], gradient - now["g"]
    s, y = [ds, *now["s"]][:MEMORY], [dy, *now["y"]][:MEMORY]
    pairs = ((ds, y), (dy, s), (dy, y), (gradient, s), (gradient, y))
    return {
        "value": loss + 0.5 * (penalty * now["xt"] ** 2).sum(),
        "slope": gradient @ now["dir"],
        "slope0": now["g"] @ now["dir"],
        "gg": gradient @ gradient,
        "dots": np.array([[a @ b for b in others] for a, others in pairs]),
    }


def _own_margins(part: Iterable) -> Iterator[tuple[int, float, float]]:
    whole = _whole(part)
    if whole is not None:
        _, y, own, margins = whole
        yield from zip(own.tolist(), y.tolist(), margins[own, np.arange(len(own))].tolist(), strict=True)
