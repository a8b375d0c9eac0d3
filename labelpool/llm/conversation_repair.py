"""Conversations damaged in known ways, and repaired by a generalised LR parse of their roles.

*Grammar.* The initials of the roles have to form ``(s?(ua)+)?``: nothing, or an optional system
turn and pairs of user and assistant. ``LR`` builds the LR(0) tables of such a grammar; a state in
which only a reduction is possible reduces at once, so equal stacks meet as early as they can.

*Repair.* All edits of a row are tried on a graph-structured stack: keep it (0), give it the role
user or assistant (3), delete it (4; blank and repeated rows must be), and, anywhere, insert an empty
turn of user or assistant (3). A truncated row that is not deleted costs 3 more. Tops of equal state
are one top with a link for each stack below it; links to equal stacks are merged, the smaller
(cost, audit) stays. Two edits of equal cost that have read the same rows never are one the
beginning of the other (the longer one would hold another insertion), so the smaller beginning stays
the smaller whole, and merging is exact.

*On Spark.* Only roles, digests and marks of the rows meet in order, not their texts. Rows are
counted by (conversation, turn, role, text) first, so a row that stands very often is one row. They
are range-partitioned by conversation and turn, so a very long conversation lies in many partitions;
each parses its fragment from every stack that may lie before it, and the few fragments that touch
the edge of a partition are put together by conversation. Texts move once, to be hashed in order with
the edits found: SHA-256 of one conversation is one stream, and a task holds one row of it.

Defined cases: NULL conv_id, turn, role and text are one space where they are read as text (a NULL
text is blank, a NULL role fits no place); NULL conv_ids are one conversation, and NULL turns come
first. An empty role has no initial, so it fits no place either. Rows of one turn come by role, then
by the SHA-256 of their text. A conversation whose rows are all dropped has zeros, an empty audit and
the hash of nothing. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelpool.llm.spread import join_by_part
from labelpool.session import materialise

#: Names of the roles by initial that an edit may give.
NAMES = {"u": "user", "a": "assistant"}
GRAMMAR = (("C", ""), ("C", "P"), ("C", "sP"), ("P", "Pua"), ("P", "ua"))
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3

Value = tuple[int, str]


class LR:
    """LR(0) states of a grammar given as (left side, right side), one letter a symbol."""

    def __init__(self, rules=GRAMMAR):
        self.rules = rules
        self.heads = {left for left, _ in rules}
        self.states: list[frozenset] = []
        #: (state, symbol) -> state
        self.goto: dict[tuple[int, str], int] = {}
        #: state -> the rule it reduces by at once, or rules that only the end allows
        self.at_once: dict[int, int] = {}
        self.at_end: dict[int, list[int]] = {}
        start = self._closure({(r, 0) for r, (left, _) in enumerate(rules) if left == rules[0][0]})
        self.states.append(start)
        for state in self.states:
            me = self.states.index(state)
            for symbol in sorted({self._next(i) for i in state} - {""}):
                to = self._closure({(r, at + 1) for r, at in state if self._next((r, at)) == symbol})
                if to not in self.states:
                    self.states.append(to)
                self.goto[me, symbol] = self.states.index(to)
            done = [r for r, at in state if at == len(rules[r][1])]
            if done and len(state) == 1 and rules[done[0]][0] != rules[0][0]:
                self.at_once[me] = done[0]
            elif done:
                self.at_end[me] = done

    def _next(self, item: tuple[int, int]) -> str:
        right = self.rules[item[0]][1]
        return right[item[1]] if item[1] < len(right) else ""

    def _closure(self, items: set) -> frozenset:
        todo = list(items)
        while todo:
            symbol = self._next(todo.pop())
            for r, (left, _) in enumerate(self.rules):
                if left == symbol and (r, 0) not in items:
                    items.add((r, 0))
                    todo.append((r, 0))
        return frozenset(items)


class Node:
    """A stack: its top state and the stack below, shared by all stacks that grow from it."""

    __slots__ = ("state", "below", "name", "after")

    def __init__(self, state: int, below: Node | None):
        self.state, self.below = state, below
        self.name: tuple[int, ...] = (*(below.name if below else ()), state)
        #: symbol -> the stack after it, or None
        self.after: dict[str, Node | None] = {}


class Parser:
    """Stacks of one grammar; equal ones are one node."""

    def __init__(self, lr: LR | None = None):
        self.lr = lr or LR()
        self.nodes: dict[tuple[int, ...], Node] = {}
        self.bottom = self._node(0, None)

    def _node(self, state: int, below: Node | None) -> Node:
        made = Node(state, below)
        return self.nodes.setdefault(made.name, made)

    def named(self, name: Iterable[int]) -> Node:
        node = None
        for state in name:
            node = self._node(state, node)
        return node

    def shift(self, node: Node, symbol: str) -> Node | None:
        """The stack after reading a symbol and all reductions that follow, None if it fits not."""
        if symbol not in node.after:
            state = self.lr.goto.get((node.state, symbol)) if symbol else None
            after = None if state is None else self._node(state, node)
            while after is not None and after.state in self.lr.at_once:
                left, right = self.lr.rules[self.lr.at_once[after.state]]
                for _ in right:
                    after = after.below
                after = self._node(self.lr.goto[after.state, left], after)
            node.after[symbol] = after
        return node.after[symbol]

    def accepts(self, node: Node) -> bool:
        """Whether the input may end here: reductions at the end lead to the start symbol alone."""
        for rule in self.lr.at_end.get(node.state, ()):
            left, right = self.lr.rules[rule]
            below = node
            for _ in right:
                below = below.below
            if left == self.lr.rules[0][0] and below is self.bottom:
                return True
        return False

    def stacks(self) -> list[Node]:
        """Every stack that may lie between two rows."""
        found, todo = {self.bottom.name: self.bottom}, [self.bottom]
        while todo:
            node = todo.pop()
            for symbol in "sua":
                after = self.shift(node, symbol)
                if after is not None and after.name not in found:
                    found[after.name] = after
                    todo.append(after)
        return list(found.values())


class Tops:
    """The tops of the graph-structured stack: state -> {stack: smallest (cost, audit)}."""

    def __init__(self, parser: Parser, start: Node):
        self.parser = parser
        self.links: dict[int, dict[Node, Value]] = {start.state: {start: (0, "")}}

    @staticmethod
    def _merge(links: dict[int, dict[Node, Value]], node: Node, value: Value) -> bool:
        below = links.setdefault(node.state, {})
        if node not in below or value < below[node]:
            below[node] = value
            return True
        return False

    def insert(self) -> None:
        """Every useful insertion before the next row or the end."""
        todo = [(n, v) for links in self.links.values() for n, v in links.items()]
        while todo:
            node, (cost, audit) = todo.pop()
            if self.links[node.state][node] != (cost, audit):
                continue
            for symbol in NAMES:
                after = self.parser.shift(node, symbol)
                value = (cost + INSERT, audit + "I")
                if after is not None and self._merge(self.links, after, value):
                    todo.append((after, value))

    def read(self, initial: str, must_go: bool, truncated: bool, copies: int = 1) -> None:
        """A row and ``copies - 1`` repetitions of it, which must go."""
        self.insert()
        links: dict[int, dict[Node, Value]] = {}
        rest = (copies - 1) * DELETE, "D" * (copies - 1)
        for tops in self.links.values():
            for node, (cost, audit) in tops.items():
                self._merge(links, node, (cost + DELETE + rest[0], audit + "D" + rest[1]))
                if must_go:
                    continue
                cost += rest[0] + (TRUNCATED if truncated else 0)
                kept = self.parser.shift(node, initial)
                if kept is not None:
                    self._merge(links, kept, (cost, audit + "K" + rest[1]))
                for symbol in NAMES:
                    given = self.parser.shift(node, symbol)
                    if given is not None:
                        self._merge(links, given, (cost + REROLE, audit + "R" + rest[1]))
        self.links = links

    def values(self) -> dict[Node, Value]:
        return {n: v for links in self.links.values() for n, v in links.items()}

    def best(self) -> Value:
        """The smallest (cost, audit) at the end of the input."""
        self.insert()
        return min(v for n, v in self.values().items() if self.parser.accepts(n))


def repair(rows: list[tuple[str, bool, bool]]) -> Value:
    """(cost, audit) of rows (initial, must go, truncated)."""
    parser = Parser()
    tops = Tops(parser, parser.bottom)
    for row in rows:
        tops.read(*row)
    return tops.best()


# --- damage ---------------------------------------------------------------------------------


def _spaced(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(" "))


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """``(conv, turn, role, text)`` after the damage that crc32(conv:turn) % 20 says."""
    code = F.pmod(F.crc32(F.concat(_spaced(F.col(conv)), F.lit(":"), _spaced(F.col(turn)))), F.lit(20))
    role, text = _spaced(F.col("role")), _spaced(F.col("text"))
    return (
        rows.select(
            F.col(conv).alias("conv"),
            F.col(turn).cast("bigint").alias("turn"),
            F.when(code == 4, F.lit("user")).otherwise(role).alias("role"),
            F.when(code == 1, F.lit("")).when(code == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
            code.alias("code"),
        )
        .where("code <> 0")
        .withColumn("copy", F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .drop("copy", "code")
    )


# Not blank, tab, line feed, vertical tab, form feed or carriage return.
_SOLID = "[^\\x20\\x09-\\x0D]"


def _marked(rows: DataFrame) -> DataFrame:
    """``(key, turn, role, digest, blank, cut, n)``: equal rows once, without their texts.

    ``key`` is the conversation's id as text behind a mark that tells NULL from all others.
    """
    return (
        _keyed(rows)
        .select(
            "key", "turn", "role", _digest().alias("digest"),
            (~F.col("text").rlike(_SOLID)).alias("blank"),
            (F.col("text").rlike(_SOLID) & ~F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*\\z")).alias("cut"),
        )
        .groupBy("key", "turn", "role", "digest", "blank", "cut")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _keyed(rows: DataFrame) -> DataFrame:
    key = F.when(F.col("conv").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("conv").cast("string")))
    return rows.withColumn("key", key)


def _digest() -> Column:
    return F.sha2(F.col("text"), 256)


# --- fragments ------------------------------------------------------------------------------

COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
FRAGMENT = (
    "key string, part int, whole boolean, blank bigint, duplicate bigint, truncated bigint,"
    " illegal bigint, turns bigint, low bigint, high bigint, first string, last string,"
    " first_turn bigint, last_turn bigint, paths array<struct<start:array<int>,stop:array<int>,cost:bigint,audit:string>>"
)
NAMES_OF = [c.split()[0] for c in FRAGMENT.split(", ")]
_PATHS = pa.list_(pa.struct([("start", pa.list_(pa.int32())), ("stop", pa.list_(pa.int32())),
                             ("cost", pa.int64()), ("audit", pa.string())]))
_ARROW = pa.schema(
    [("key", pa.string()), ("part", pa.int32()), ("whole", pa.bool_())]
    + [(c, pa.int64()) for c in (*COUNTS, "low", "high")]
    + [("first", pa.string()), ("last", pa.string()), ("first_turn", pa.int64()),
       ("last_turn", pa.int64()), ("paths", _PATHS)]
)
LEGAL = ("su", "ua", "au")


class Fragment:
    """Consecutive rows of one conversation inside one partition."""

    def __init__(self, parser: Parser, key: str, part: int, starts: list[Node], opens: bool):
        self.key, self.part, self.opens = key, part, opens
        self.tops = [(s, Tops(parser, s)) for s in starts]
        self.n = dict.fromkeys(COUNTS, 0)
        self.low = self.high = self.first = self.last = None
        self.first_turn = self.last_turn = None

    def read(self, turn, role, blank, duplicate, cut, copies) -> None:
        initial = role[:1]
        kind = "blank" if blank else "duplicate" if duplicate else "truncated" if cut else None
        if kind:
            self.n[kind] += 1
        # Repetitions of a row are blank as it is, or repeat it.
        self.n["blank" if blank else "duplicate"] += copies - 1
        if self.first is None:
            self.first, self.first_turn = initial, turn
        elif self.last + initial not in LEGAL:
            self.n["illegal"] += 1
        # No row may follow itself: no legal pair has two equal initials.
        self.n["illegal"] += copies - 1
        if turn is not None:
            self.n["turns"] += self.last_turn != turn
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.last, self.last_turn = initial, turn
        for _, tops in self.tops:
            tops.read(initial, kind in ("blank", "duplicate"), kind == "truncated", copies)

    def row(self, closes: bool) -> dict:
        paths = [
            {"start": list(s.name), "stop": list(n.name), "cost": c, "audit": a}
            for s, tops in self.tops
            for n, (c, a) in tops.values().items()
        ]
        return self.n | {
            "key": self.key, "part": self.part, "whole": not (self.opens or closes),
            "low": self.low, "high": self.high, "first": self.first, "last": self.last,
            "first_turn": self.first_turn, "last_turn": self.last_turn, "paths": paths,
        }


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments of a sorted partition. The first may go on from the partition before."""
    from pyspark import TaskContext

    part, parser = TaskContext.get().partitionId(), Parser()
    every = parser.stacks()
    now, done = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for key, turn, role, blank, duplicate, cut, copies in zip(*columns):
            if now is None or now.key != key:
                if now is not None:
                    done.append(now.row(closes=False))
                now = Fragment(parser, key, part, every if now is None else [parser.bottom], now is None)
            now.read(turn, role, blank, duplicate, cut, copies)
        if done:
            yield pa.RecordBatch.from_pylist(done, _ARROW)
            done = []
    if now is not None:
        yield pa.RecordBatch.from_pylist([now.row(closes=True)], _ARROW)


def joined(fragments: list[dict]) -> dict:
    """The result of one conversation from its fragments, in order."""
    parser = Parser()
    total = dict.fromkeys(COUNTS, 0)
    reached: dict[Node, Value] = {parser.bottom: (0, "")}
    low = high = before = None
    for f in fragments:
        for c in COUNTS:
            total[c] += f[c]
        if before is not None:
            total["illegal"] += before["last"] + f["first"] not in LEGAL
            total["turns"] -= f["first_turn"] is not None and f["first_turn"] == before["last_turn"]
        if f["low"] is not None:
            low, high = (f["low"] if low is None else low), f["high"]
        after: dict[Node, Value] = {}
        for path in f["paths"]:
            came = reached.get(parser.named(path["start"]))
            if came is not None:
                node, value = parser.named(path["stop"]), (came[0] + path["cost"], came[1] + path["audit"])
                after[node] = min(after.get(node, value), value)
        reached, before = after, f
    tops = Tops(parser, parser.bottom)
    tops.links = {}
    for node, value in reached.items():
        Tops._merge(tops.links, node, value)
    cost, audit = tops.best()
    gaps = 0 if low is None else high - low + 1 - total.pop("turns")
    total.pop("turns", None)
    return total | {"key": fragments[0]["key"], "gaps": gaps, "cost": cost, "audit": audit}


RESULT = (
    "key string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint,"
    " cost bigint, audit string"
)
_RESULT = pa.schema(
    [("key", pa.string())]
    + [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    + [("audit", pa.string())]
)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_pylist([joined([f]) for f in batch.to_pylist()], _RESULT)


def _finish_group(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda f: f["part"])
    return pa.Table.from_pylist([joined(rows)], _RESULT)


def faults_and_edits(rows: DataFrame) -> DataFrame:
    """``(key, gaps, blank, duplicate, truncated, illegal, cost, audit)`` of damaged rows."""
    marked = materialise(_marked(rows), "turns")
    again = ["key", "role", "digest"]
    # The first turn of each text; a NULL turn is before all others.
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = marked.groupBy(*again).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("times"))
    first = first.where("times > 1").drop("times")
    light = join_by_part(marked, first, again, "turn").withColumn(
        "duplicate", F.coalesce(order > F.col("first"), F.lit(False))
    )
    sort = ["key", F.asc_nulls_first("turn"), "role", "digest"]
    fragments = materialise(
        light.repartitionByRange(*sort)
        .sortWithinPartitions(*sort)
        .select("key", "turn", "role", "blank", "duplicate", "cut", "n")
        .mapInArrow(_parse, FRAGMENT),
        "fragments",
    )
    inside = fragments.where("whole").mapInArrow(_finish, RESULT)
    edges = fragments.where("NOT whole").groupBy("key").applyInArrow(_finish_group, RESULT)
    return inside.union(edges)


# --- the repaired texts ---------------------------------------------------------------------


def repaired(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) of what the edits leave; rows are asked for one by one."""
    made, offset = 0, 0
    for edit in audit:
        role, text = next(rows) if edit != "I" else ("", "")
        if edit == "D":
            continue
        if edit == "K" and made == 0 and role[:1] == "s":
            offset = 1
        if edit != "K":
            role = NAMES["ua"[(made - offset) % 2]]
        made += 1
        yield role, text


def _hash_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(key, sha)`` from rows sorted by key, each key led by its audit."""

    def rows():
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield from zip(*(c.to_pylist() for c in batch.slice(at, 256).columns))

    stream = rows()
    ahead = next(stream, None)
    keys, hashes = [], []
    while ahead is not None:
        key, _, audit, _ = ahead
        digest, between = hashlib.sha256(), b""

        def own():
            for _, _, role, text in stream:
                yield role, text

        for role, text in repaired(audit, own()):
            digest.update(between + role.encode() + b":" + text.encode())
            between = b"\n"
        keys.append(key)
        hashes.append(digest.hexdigest())
        ahead = next(stream, None)
        if len(keys) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(hashes)], ["key", "sha"])
            keys, hashes = [], []
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(hashes, pa.string())], ["key", "sha"])


def repaired_hashes(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``(key, sha)``: SHA-256 of the repaired conversation."""
    texts = _keyed(rows).select("key", F.lit(1).alias("kind"), "turn", "role", "text")
    audits = found.select(
        "key", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"),
        F.col("audit").alias("role"), F.lit("").alias("text"),
    )
    return (
        audits.union(texts)
        .withColumn("digest", F.when(F.col("kind") == 1, _digest()))
        .repartition("key")
        .sortWithinPartitions("key", "kind", F.asc_nulls_first("turn"), "role", "digest")
        .select("key", "kind", "role", "text")
        .mapInArrow(_hash_stream, "key string, sha string")
    )


def repair_conversations(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn") -> DataFrame:
    """One row for each conversation: its faults after the damage, the cheapest repair, its hash."""
    rows = damage(conversations, conv_id, turn)
    found = materialise(faults_and_edits(rows), "repairs")
    ids = conversations.select(F.col(conv_id).alias("conv")).distinct()
    zeros = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
             for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return (
        _keyed(ids)
        .join(found, "key", "left")
        .join(repaired_hashes(rows, found), "key", "left")
        .select(
            F.col("conv").alias(conv_id), *zeros,
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
        )
    )
