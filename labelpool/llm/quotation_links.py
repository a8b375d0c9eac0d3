"""Quotation linking: from messages that quote each other to reply-ordered conversations.

*Parsing.* A line's level is the number of ``>`` it begins with (blanks between them do not
matter); level 0 is what the message itself says. A line of attribution ("... wrote:") right before
a quotation belongs to it.

*Linking.* Every line of level 1 and more is a quoted passage; it is normalised (lower case, white
space collapsed) and hashed. Its original is the message of the same conversation that first said
such a line itself. Quoted passages are joined to originals by conversation and hash, and count if
the original comes earlier. A message replies to the original of most of its least nested linked
passages; among equals to the latest.

*Ordering.* The thread of a message is where its replies lead back to, found by doubling the
pointers, so a chain of n replies takes log n rounds. In reply order, threads follow each other by
their first message, and inside a thread messages follow by turn, so a reply stands after what it
answers. Positions come from a range partition and the counts of its ranges.

No step gathers a conversation in one task: first messages are minima, combined before the
shuffle, the rows of a frequent line are dealt out, and chat records hold at most RECORD messages.

Defined cases: NULL text has no lines and an empty clean text. A NULL conversation or turn has no
links; NULLs sort first. Rows of equal conversation and turn are one node and share its links, but
have positions of their own, by role and text. A message that quotes nothing known starts a
thread. Blank quoted lines are no passages. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelpool.llm.spread import join_by_part
from labelpool.session import materialise

RECORD = 64
_QUOTE = re.compile(r"((?:[ \t]*>)*)[ \t]?(.*)", re.S)
_ATTRIBUTION = re.compile(r"\b(wrote|writes|schrieb|écrit|escribió)\b[^:]*:\s*$", re.I)


def parse(text: str | None) -> tuple[str, list[str], list[tuple[int, str]]]:
    """``(clean text, own lines, quoted (level, line))``; lines of the latter two are normalised."""
    kept: list[str] = []
    own: list[str] = []
    quoted: list[tuple[int, str]] = []
    for line in (text or "").split("\n"):
        marks, body = _QUOTE.match(line).groups()
        level = marks.count(">")
        flat = " ".join(body.lower().split())
        if level:
            if kept and _ATTRIBUTION.search(kept[-1]):
                kept.pop()
                if own:
                    own.pop()
            if flat:
                quoted.append((level, flat))
            continue
        kept.append(line)
        if flat:
            own.append(flat)
    return "\n".join(kept).strip("\n"), own, quoted


def _hash(line: str) -> int:
    return int.from_bytes(blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _parse_scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        clean, own, levels, hashes = [], [], [], []
        for text in batch.column(3).to_pylist():
            kept, said, quoted = parse(text)
            clean.append(kept)
            own.append([_hash(x) for x in said])
            levels.append([level for level, _ in quoted])
            hashes.append([_hash(x) for _, x in quoted])
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns[:3],
                pa.array(clean, pa.string()),
                pa.array(own, pa.list_(pa.int64())),
                pa.array(levels, pa.list_(pa.int32())),
                pa.array(hashes, pa.list_(pa.int64())),
            ],
            ["conv", "turn", "role", "clean", "own", "levels", "quoted"],
        )


def _threads(replies: DataFrame) -> DataFrame:
    """``(conv, turn, root)`` of the nodes that reply to something, by doubling pointers."""
    now = materialise(replies.select("conv", "turn", F.col("reply_to").alias("root")), "pointers")
    while True:
        up = now.select("conv", F.col("turn").alias("root"), F.col("root").alias("next"))
        nxt = materialise(
            join_by_part(now, up, ["conv", "root"], "turn")
            .select("conv", "turn", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
            "pointers",
        )
        if nxt.where("moved").isEmpty():
            return nxt.drop("moved")
        now = nxt.drop("moved")


def link_quotations(
    messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row for each message: ``(conv_col, turn_col, role_col, reply_to, thread, position,
    n_quoted, n_linked, max_level, clean_text)``."""
    frame = messages.select(
        F.col(conv_col).cast("bigint").alias("conv"), F.col(turn_col).cast("bigint").alias("turn"),
        F.col(role_col).cast("string").alias("role"), F.col(text_col).alias("text"),
    )
    parsed = materialise(
        frame.mapInArrow(
            _parse_scan,
            "conv bigint, turn bigint, role string, clean string, own array<bigint>,"
            " levels array<int>, quoted array<bigint>",
        ),
        "parsed",
    )
    node = parsed.where("conv IS NOT NULL AND turn IS NOT NULL")
    passages = node.select(
        "conv", "turn", F.explode(F.arrays_zip("levels", "quoted")).alias("q")
    ).select("conv", "turn", F.col("q.levels").alias("level"), F.col("q.quoted").alias("h"))
    said = node.select("conv", "turn", F.explode(F.array_distinct("own")).alias("h"))
    wanted = passages.select("conv", "h").distinct()
    first = join_by_part(said, wanted.withColumn("asked", F.lit(True)), ["conv", "h"], "turn").where(
        "asked"
    ).groupBy("conv", "h").agg(F.min("turn").alias("origin"))
    found = (
        join_by_part(passages, first, ["conv", "h"], "turn")
        .where("origin < turn")
        .groupBy("conv", "turn", "level", "origin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    links = materialise(
        found.groupBy("conv", "turn").agg(
            F.max(F.struct((-F.col("level")).alias("a"), F.col("n").alias("b"), F.col("origin").alias("c")))
            .getField("c").alias("reply_to"),
            F.sum("n").alias("n_linked"),
        ),
        "replies",
    )
    known = links.join(_threads(links), ["conv", "turn"])
    rows = (
        parsed.join(known, ["conv", "turn"], "left")
        .select(
            "conv", "turn", "role", "reply_to",
            F.coalesce("root", "turn").alias("thread"),
            F.size("quoted").cast("bigint").alias("n_quoted"),
            F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"),
            F.coalesce(F.array_max("levels"), F.lit(0)).alias("max_level"),
            F.col("clean").alias("clean_text"),
        )
    )
    return _positions(rows).select(
        F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col),
        "reply_to", "thread", "position", "n_quoted", "n_linked", "max_level", "clean_text",
    )


def _positions(rows: DataFrame) -> DataFrame:
    """``rows`` with ``position``, from 0, in reply order inside each conversation."""
    keys = ["conv", "thread", "turn", "role", "clean_text"]
    names = rows.columns
    by = [*keys[:4], F.xxhash64("clean_text")]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, at = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            out = []
            for conv in batch.column(0).to_pylist():
                at = at + 1 if conv == last else 0
                last = conv
                out.append(at)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([part] * len(out), pa.int32()), pa.array(out, pa.int64())],
                [*names, "part", "at"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    ranged = materialise(
        rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(number, f"{schema}, part int, at bigint"),
        "reply-order",
    )
    # One row for each conversation in each range; a conversation spans as many as there are ranges.
    sizes = ranged.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col("conv").alias("_conv"), F.col("part").alias("_part"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"),
    )
    return ranged.join(
        offsets, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part"))
    ).withColumn("position", F.col("at") + F.col("offset"))


def chat_records(linked: DataFrame, conv_col: str = "conv_id", role_col: str = "role") -> DataFrame:
    """``(conv_col, record, n_messages, chat)``: reply-ordered turns without quotations, in records
    of at most RECORD messages, one ``role: text`` paragraph each."""
    line = F.concat_ws(": ", F.coalesce(F.col(role_col), F.lit("")), F.col("clean_text"))
    return (
        linked.withColumn("record", F.floor(F.col("position") / RECORD))
        .groupBy(conv_col, "record")
        .agg(
            F.count(F.lit(1)).alias("n_messages"),
            F.sort_array(F.collect_list(F.struct("position", line.alias("line")))).alias("lines"),
        )
        .select(conv_col, "record", "n_messages", F.array_join(F.col("lines.line"), "\n\n").alias("chat"))
    )
