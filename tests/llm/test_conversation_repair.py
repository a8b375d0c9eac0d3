"""Repair of role sequences against a search over all edits, and its SQL on awkward rows."""

import heapq
import random
import re

import duckdb
import pytest
from oracle import compare

from labelpool.llm import conversation_repair as cr
from labelpool.llm.queries import REPAIR_SQL

SCHEMA = "conv_id bigint, turn bigint, role string, text string, key string, audit int"


def cheapest(rows):
    """The least (cost, audit) by trying all edits in the order of (cost, audit)."""
    heap = [(0, "", 0, "")]
    seen = set()
    while heap:
        cost, audit, at, out = heapq.heappop(heap)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", out):
            return cost, audit
        if (audit, out) in seen or not re.fullmatch("s?(ua)*u?", out):
            continue
        seen.add((audit, out))
        for x in "ua":
            heapq.heappush(heap, (cost + 3, audit + "I", at, out + x))
        if at == len(rows):
            continue
        initial, must_go, truncated = rows[at]
        heapq.heappush(heap, (cost + 4, audit + "D", at + 1, out))
        if not must_go:
            more = cost + 3 * truncated
            if initial:
                heapq.heappush(heap, (more, audit + "K", at + 1, out + initial))
            for x in "ua":
                heapq.heappush(heap, (more + 3, audit + "R", at + 1, out + x))


def some_rows(rng, n):
    return [(rng.choice(["s", "u", "u", "a", "a", "x", ""]), rng.random() < 0.2, rng.random() < 0.3) for _ in range(n)]


def test_states_of_the_grammar():
    parser = cr.Parser()
    assert len(parser.stacks()) == 8
    assert parser.accepts(parser.bottom)

    def after(text):
        node = parser.bottom
        for x in text:
            node = node and parser.shift(node, x)
        return node

    for text in ("ua", "sua", "uaua", "suauaua"):
        assert parser.accepts(after(text)), text
    for text in ("s", "u", "uau", "su"):
        assert not parser.accepts(after(text)), text
    for text in ("a", "ss", "uu", "uas", "usa"):
        assert after(text) is None, text


@pytest.mark.parametrize("seed", range(3))
def test_cheapest_repair(seed):
    rng = random.Random(seed)
    for n in [0, 1, 2, 3, 4] * 5:
        rows = some_rows(rng, n)
        assert cr.repair(rows) == cheapest(rows), rows


def test_fragments_give_the_whole():
    """A conversation cut anywhere, each fragment parsed from every stack, gives the same."""
    rng = random.Random(11)
    for _ in range(60):
        marks = [(rng.choice(["system", "user", "assistant", "tool", ""]), rng.random() < 0.2,
                  rng.random() < 0.2, rng.random() < 0.3, rng.choice([1, 1, 1, 3])) for _ in range(14)]
        turns = sorted((rng.choice([None, rng.randrange(20)]) for _ in marks), key=lambda t: (t is not None, t or 0))

        def cut(at):
            out, parser = [], cr.Parser()
            for k, (a, z) in enumerate(zip([0, *at], [*at, len(marks)])):
                f = cr.Fragment(parser, "1", k, parser.stacks() if k else [parser.bottom], k > 0)
                for (role, blank, dup, trunc, n), turn in list(zip(marks, turns))[a:z]:
                    f.read(turn, role, blank, dup, trunc, n)
                out.append(f.row(closes=True))
            return cr.joined(out)

        whole = cut([])
        assert cut(sorted(rng.sample(range(1, 14), 3))) == whole
        assert cut(list(range(1, 14))) == whole
        single = [(r[:1], b or d, t and not (b or d)) for r, b, d, t, _ in marks]
        if all(n == 1 for *_, n in marks):
            assert (whole["cost"], whole["audit"]) == cr.repair(single)


def test_repeated_rows_at_once():
    """Repetitions of a row read at once are as good as one by one."""
    rng = random.Random(5)
    for _ in range(12):
        rows = some_rows(rng, 3)
        copies = [rng.choice([1, 1, 3]) for _ in rows]
        parser = cr.Parser()
        tops = cr.Tops(parser, parser.bottom)
        for (x, gone, trunc), n in zip(rows, copies):
            tops.read(x, gone, trunc and not gone, n)
        flat = []
        for (x, gone, trunc), n in zip(rows, copies):
            flat += [(x, gone, trunc and not gone)] + [(x, True, False)] * (n - 1)
        assert tops.best() == cheapest(flat)


def awkward(rng, n):
    texts = ["", " ", None, "Hi.", "Hi.", "What? ", "no end", "a\nb!\n", "…", "\x0b", "Ünï.", "x" * 40]
    roles = ["user", "assistant", "system", "tool", None, "", "user", "assistant", "u", "ünknown"]
    rows = []
    for _ in range(n):
        rows.append((rng.choice([None, *range(25)]), rng.choice([None, *range(9)]), rng.choice(roles),
                     rng.choice(texts), "k", 1))
    return rows + rows[: n // 8]


def against_sql(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    con = duckdb.connect()
    con.register("given", frame.toArrow())
    con.execute("CREATE VIEW conversations AS SELECT conv_id, turn, role, text FROM given")
    return compare(None, con, None, lambda *_: cr.repair_conversations(frame), REPAIR_SQL)[0]


def test_awkward_rows_agree_with_sql(spark):
    problem = against_sql(spark, awkward(random.Random(1), 400))
    assert problem is None, problem


def test_one_conversation_over_many_partitions(spark):
    rng = random.Random(2)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["A.", "b", "C%d!" % t]), "k", 1)
            for t in range(150)]
    rows += [(2, 0, "user", "A.", "k", 1), (3, None, "user", "same", "k", 1)] + [(1, 5, "user", "again.", "k", 1)] * 40
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        problem = against_sql(spark, rows)
        assert problem is None, problem
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_empty_table_and_dropped_conversation(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert cr.repair_conversations(frame).collect() == []
    import zlib

    turn = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    (row,) = cr.repair_conversations(spark.createDataFrame([(7, turn, "user", "Hi.", "k", 1)], SCHEMA)).collect()
    import hashlib

    assert tuple(row) == (7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_long_text(spark):
    text = "word " * 200_000 + "end."
    rows = [(1, t, "user" if t % 2 else "assistant", text + str(t % 3) + ".", "k", 1) for t in range(6)]
    problem = against_sql(spark, rows)
    assert problem is None, problem
