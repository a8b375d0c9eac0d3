"""Streams of revised, late and repeated answers equal the batch result over all of them."""

import datetime as dt
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelpool.operators.moments import Sums, class_moments
from labelpool.streaming.answers import ArrivalRates, LatestFit

SCHEMA = "answer_id bigint, id bigint, at timestamp, y int, x array<double>"
START = dt.datetime(2024, 1, 1)


def feed(spark, folder, parts, schema):
    """One file for each part, in this order."""
    for rows in parts:
        time.sleep(0.05)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(query):
    query.awaitTermination()
    assert query.exception() is None
    return query


def answers(seed):
    """Many answers to few ids, half of them to id 0; some withdrawn, repeated, late or broken."""
    rng = random.Random(seed)
    rows = []
    for a in range(300):
        i = 0 if a % 2 else rng.randrange(12)
        y = None if rng.random() < 0.15 else rng.randrange(2)
        rows.append((a, i, START + dt.timedelta(minutes=rng.randrange(60)), y, [float(i), rng.gauss(0, 1)]))
    rows += rng.sample(rows, 60)
    rng.shuffle(rows)
    rows += [(900, None, START, 1, [9.0, 9.0]), (901, 3, None, 1, [9.0, 9.0]), (902, 3, START, 1, None)]
    rows += [(None, 3, START + dt.timedelta(days=9), 1, [9.0, 9.0])]
    return rows


def latest(rows):
    held = {}
    for a, i, at, y, x in rows:
        if None in (a, i, at) or (y is not None and x is None):
            continue
        if i not in held or (at, a) > held[i][0]:
            held[i] = ((at, a), y, x)
    return {i: (y, x) for i, (_, y, x) in held.items() if y is not None}


@pytest.mark.parametrize("seed", [1, 2])
def test_latest_answers_make_the_model(spark, tmp_path, seed):
    rows = answers(seed)
    stream = feed(spark, f"{tmp_path}/in", [rows[:150], rows[150:200], rows[200:]], SCHEMA)
    fit = LatestFit(f"{tmp_path}/moments")
    run(fit.start(stream, f"{tmp_path}/check", available_now=True))
    got = fit.model(spark).sums
    held = latest(rows)
    batch = spark.createDataFrame([(y, x) for y, x in held.values()], "y int, x array<double>")
    want = Sums.of(class_moments(batch).collect())
    assert got.n == want.n and sum(got.n) == len(held)
    for a, b in zip(got.s1 + got.s2, want.s1 + want.s2):
        assert np.allclose(a, b, atol=1e-9)


def test_a_restart_goes_on_from_its_state(spark, tmp_path):
    first = [(1, 1, START, 1, [1.0]), (2, 2, START, 0, [2.0])]
    fit = LatestFit(f"{tmp_path}/moments")
    run(fit.start(feed(spark, f"{tmp_path}/in", [first], SCHEMA), f"{tmp_path}/check", True))
    assert fit.model(spark).sums.n == [1, 1]
    # A revision, an older answer that comes later, a repeated one, and a withdrawal.
    later = [(3, 1, START + dt.timedelta(1), 0, [5.0]), (4, 2, START - dt.timedelta(1), 1, [7.0])]
    run(fit.start(feed(spark, f"{tmp_path}/in", [later, first], SCHEMA), f"{tmp_path}/check", True))
    sums = fit.model(spark).sums
    assert sums.n == [2, 0] and sums.s1[0].tolist() == [7.0] and sums.s2[0].tolist() == [29.0]
    gone = [(5, 2, START + dt.timedelta(2), None, None)]
    run(fit.start(feed(spark, f"{tmp_path}/in", [gone], SCHEMA), f"{tmp_path}/check", True))
    sums = fit.model(spark).sums
    assert sums.n == [1, 0] and sums.s1[0].tolist() == [5.0]
    # Equal times go to the larger answer_id.
    tie = [(6, 2, START + dt.timedelta(2), 1, [3.0])]
    run(fit.start(feed(spark, f"{tmp_path}/in", [tie], SCHEMA), f"{tmp_path}/check", True))
    assert fit.model(spark).sums.n == [1, 1]


RATES = "answer_id bigint, at timestamp, kind string"


def test_rates_count_late_and_repeated_rows_once(spark, tmp_path):
    at = lambda minutes: START + dt.timedelta(minutes=minutes)
    parts = [
        [(1, at(5), "a"), (2, at(50), "b"), (3, at(70), "a"), (3, at(70), "a")],
        # Late within bounds, repeated in another micro-batch, no kind, no time.
        [(4, at(10), "a"), (1, at(5), "a"), (5, at(125), None), (6, None, "a")],
        [(7, at(3), "b"), (4, at(10), "a"), (8, at(200), "a")],
        # The watermark is at 200 - 180 = 20 minutes: the window of minute 4 (0-60) is still open.
        [(9, at(4), "b")],
        [(10, at(600), "a")],
        # Now it is at 420 minutes, and holds for late rows from the micro-batch after the next.
        [(11, at(30), "c")],
        [(12, at(30), "d")],
    ]
    rates = ArrivalRates(f"{tmp_path}/counts", "1 hour", "3 hours")
    stream = feed(spark, f"{tmp_path}/in", parts, RATES)
    run(rates.start(stream, f"{tmp_path}/check", available_now=True))
    got = {
        (int(r.hour), r.kind): r.n
        for r in rates.counts(spark).withColumn(
            "hour", (F.unix_timestamp("start") - F.lit(int(START.replace(tzinfo=dt.timezone.utc).timestamp()))) / 3600
        ).collect()
    }
    got.pop((0, "c"), None)
    assert got == {(0, "a"): 2, (0, "b"): 3, (1, "a"): 1, (2, None): 1, (3, "a"): 1, (10, "a"): 1}


def test_empty_streams(spark, tmp_path):
    rates = ArrivalRates(f"{tmp_path}/counts")
    run(rates.start(feed(spark, f"{tmp_path}/in", [[]], RATES), f"{tmp_path}/check", True))
    fit = LatestFit(f"{tmp_path}/moments")
    broken = [(None, None, None, 1, [1.0])]
    run(fit.start(feed(spark, f"{tmp_path}/in2", [broken], SCHEMA), f"{tmp_path}/check2", True))
    assert fit.model(spark).sums.n == [0, 0]
    assert rates.counts(spark).count() == 0
