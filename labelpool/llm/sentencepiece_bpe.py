"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

The vocabulary is read from the model file; the merging is done here. A text becomes one word for
each blank (with the blanks before it), since no piece of such a model reaches over the end of a
word. The words of a batch that were not met before are put into one flat array of symbols.
Every round finds, by segmented minimum, the best pair of each word, merges it, and compacts the
array; a word leaves when it has no pair left. All places of a word's best pair are merged in one
round, from the left, if no piece that contains the merged one ranks before it; otherwise only the
leftmost is, which is what a queue of pairs would do.

Work is per row, so there is no shuffle and no key that could be hot. Memory is bounded by a batch
and a cache of words that is emptied at a fixed size. A long text is handled like any other: its
words are merged together, rounds depend on the longest word.

Defined cases: NULL text counts as empty: no ids, empty decoded text. Repeated rows each give a
row. Characters without a piece become their UTF-8 bytes. Decoding drops the one blank that
encoding puts in front, joins byte pieces, and replaces bytes that are no UTF-8 by U+FFFD.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
#: Words kept by a worker process.
CACHE = 300_000
#: Symbols merged together in one go.
FLAT = 1 << 18
NONE = np.int64(1) << np.int64(60)


class Vocabulary:
    """Pieces, ranks and pairs of one model file."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_of = {i: int(self.pieces[i][3:5], 16) for i in range(n) if sp.is_byte(i)}
        self.id_of_byte = {b: i for i, b in self.byte_of.items()}
        self.unknown = sp.unk_id()
        self.control = {i for i in range(n) if sp.is_control(i)}
        special = self.control | {self.unknown} | set(self.byte_of)
        normal = {self.pieces[i]: i for i in range(n) if i not in special and not sp.is_unused(i)}
        self.normal = normal
        # Symbols are piece ids; characters without a piece get numbers after the pieces, since
        # two of them may still form a piece.
        self.symbol = dict(normal)
        score = {i: sp.get_score(i) for i in normal.values()}
        order = sorted(normal.values(), key=lambda i: (-score[i], i))
        rank, last = {}, None
        for i in order:
            if score[i] != last:
                last, at = score[i], len(rank)
            rank[i] = at
        pairs = {}
        for text, i in normal.items():
            for k in range(1, len(text)):
                a, b = self._part(text[:k]), self._part(text[k:])
                if a is not None and b is not None:
                    pairs[a, b] = i
        self.width = len(self.symbol) + n + 2
        keys = np.array([a * self.width + b for a, b in pairs], np.int64)
        made = np.array(list(pairs.values()), np.int64)
        by = np.argsort(keys)
        self.keys, self.made = keys[by], made[by]
        self.rank = np.full(n, NONE)
        for i, r in rank.items():
            self.rank[i] = r
        self.word = re.compile(self._cuts())
        self.code = np.full(0x110000, self.width - 1, np.int32)
        for text, i in self.symbol.items():
            if len(text) == 1:
                self.code[ord(text)] = i
        # A piece is safe if no better-ranked pair can begin or end with it.
        self.safe = np.ones(n, bool)
        for (a, b), i in pairs.items():
            for side in (a, b):
                if side < n and self.rank[i] <= self.rank[side]:
                    self.safe[side] = False

    def _cuts(self) -> str:
        """A pattern of the stretches that no piece reaches across.

        Besides the blanks, a text may be cut between two characters that stand beside each other
        in no piece. That is used for a line feed and for a comma or full stop after a letter,
        where the vocabulary allows it; it makes words repeat more often.
        """
        beside = {(a, b) for text in self.normal for a, b in zip(text, text[1:])}
        ends = [m for m in ",." if not any(b == m and a.isalpha() for a, b in beside)]
        line = "" if any("\n" in pair for pair in beside) else "\n"
        some = f"[^{BLANK}{line}{''.join(ends)}]"
        parts = [rf"{BLANK}*[^{BLANK}{line}]+", rf"{BLANK}+"]
        if ends:
            parts.insert(0, rf"{BLANK}*{some}*[^\W\d_{BLANK}](?=[{''.join(ends)}])")
        if line:
            parts.append(line)
        return "|".join(parts)

    def _part(self, text: str) -> int | None:
        if text not in self.symbol and len(text) == 1:
            self.symbol[text] = len(self.pieces) + len(self.symbol)
        return self.symbol.get(text)

    def ids_of_symbol(self, symbol: int, char: str) -> list[int]:
        if 0 <= symbol < len(self.pieces):
            return [symbol]
        if len(self.id_of_byte) == 256:
            return [self.id_of_byte[b] for b in char.encode("utf-8", "surrogatepass")]
        return [self.unknown]


@lru_cache(maxsize=4)
def vocabulary(model: bytes) -> Vocabulary:
    return Vocabulary(model)


def merge_words(words: list[str], v: Vocabulary) -> list[list[int]]:
    """The ids of each word."""
    out: list[list[int]] = []
    at = 0
    while at < len(words):
        stop, size = at, 0
        while stop < len(words) and (size == 0 or size + len(words[stop]) <= FLAT):
            size += len(words[stop])
            stop += 1
        out += _merge(words[at:stop], v)
        at = stop
    return out


def _merge(words: list[str], v: Vocabulary) -> list[list[int]]:
    chars = "".join(words)
    lengths = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer(chars.encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = v.code[points].astype(np.int64)
    place = np.arange(len(chars))
    word = np.repeat(np.arange(len(words)), lengths)
    n_pieces = len(v.pieces)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(symbols):
        # The piece that each symbol and its right neighbour form, if any.
        pair = symbols[:-1] * v.width + symbols[1:]
        found = np.minimum(np.searchsorted(v.keys, pair), len(v.keys) - 1)
        fits = (v.keys[found] == pair) & (word[1:] == word[:-1])
        rank = np.full(len(symbols), NONE)
        piece = np.zeros(len(symbols), np.int64)
        piece[:-1][fits] = v.made[found[fits]]
        rank[:-1][fits] = v.rank[piece[:-1][fits]]
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        sizes = np.diff(np.r_[first, len(word)])
        best = np.minimum.reduceat(rank, first)
        over = np.repeat(best == NONE, sizes)
        if over.any():
            done.append((word[over], place[over], symbols[over]))
        best = np.repeat(best, sizes)
        here = (rank == best) & ~over
        # The leftmost best pair names the piece; equal ranks of other pieces wait their turn.
        spot = np.flatnonzero(here)
        owner = word[spot]
        lead = np.r_[True, owner[1:] != owner[:-1]] if len(spot) else np.zeros(0, bool)
        leader = np.maximum.accumulate(np.where(lead, np.arange(len(spot)), 0))
        wanted = piece[spot[leader]] if len(spot) else spot
        chosen = lead | (v.safe[wanted] & (piece[spot] == wanted))
        # Places beside each other overlap: in a run, every second one is merged.
        spot = spot[chosen]
        fresh = np.r_[True, spot[1:] != spot[:-1] + 1] if len(spot) else np.zeros(0, bool)
        run = np.maximum.accumulate(np.where(fresh, np.arange(len(spot)), 0))
        spot = spot[(np.arange(len(spot)) - run) % 2 == 0]
        symbols = symbols.copy()
        symbols[spot] = piece[spot]
        stay = ~over
        stay[spot + 1] = False
        symbols, place, word = symbols[stay], place[stay], word[stay]
    w, p, s = (np.concatenate(x) for x in zip(*done)) if done else [np.zeros(0, np.int64)] * 3
    order = np.argsort(p, kind="stable")
    w, p, s = w[order], p[order], s[order]
    strange = np.flatnonzero(s >= n_pieces)
    bounds = np.searchsorted(w, np.arange(len(words) + 1)).tolist()
    flat = s.tolist()
    out = [flat[a:b] for a, b in zip(bounds, bounds[1:])]
    for i in np.unique(w[strange]).tolist():
        spots = p[bounds[i] : bounds[i + 1]].tolist()
        out[i] = [x for y, at in zip(out[i], spots) for x in v.ids_of_symbol(y, chars[at])]
    return out


def decode_ids(ids: list[int], v: Vocabulary) -> str:
    """The text that a list of ids stands for."""
    return _decode_parts(ids, v, lead=True)


def _decode_parts(ids: list[int], v: Vocabulary, lead: bool) -> str:
    out: list[str] = []
    raw = bytearray()
    for i in ids:
        if i in v.byte_of:
            raw.append(v.byte_of[i])
            lead = False
            continue
        if raw:
            out.append(_from_bytes(raw))
            raw = bytearray()
        if i in v.control:
            continue
        if i == v.unknown:
            out.append(" ⁇ ")
            lead = False
            continue
        piece = v.pieces[i]
        if lead and piece.startswith(BLANK):
            piece = piece[1:]
        lead = False
        out.append(piece.replace(BLANK, " "))
    if raw:
        out.append(_from_bytes(raw))
    return "".join(out)


def _from_bytes(raw: bytearray) -> str:
    """Each byte that begins no valid character becomes one U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        lead = raw[at]
        size = 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4
        try:
            out.append(bytes(raw[at : at + size]).decode("utf-8"))
            at += size
        except UnicodeDecodeError:
            out.append("�")
            at += 1
    return "".join(out)


class Encoder:
    """Encodes whole texts, keeping the ids of words already met."""

    def __init__(self, model: bytes):
        self.v = vocabulary(model)
        pieces = [p.replace(BLANK, " ") for p in self.v.pieces]
        plain = set(self.v.normal.values())
        #: What an id decodes to by itself, where that does not depend on its neighbours.
        self.text = [p if i in plain else None for i, p in enumerate(pieces)]
        #: word -> (ids, ids as text, decoded text)
        self.known: dict[str, tuple[list[int], str, str]] = {}

    def words(self, text: str) -> list[str]:
        return self.v.word.findall(BLANK + text.replace(" ", BLANK)) if text else []

    def learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > CACHE:
            self.known = {}
        fresh = [w for w in words if w not in self.known]
        for w, ids in zip(fresh, merge_words(fresh, self.v)):
            parts = [self.text[i] for i in ids]
            decoded = _decode_parts(ids, self.v, lead=False) if None in parts else "".join(parts)
            self.known[w] = (ids, ",".join(map(str, ids)), decoded)

    def encode(self, text: str | None) -> list[int]:
        split = self.words(text or "")
        self.learn(set(split))
        return [i for w in split for i in self.known[w][0]]


def encode_documents(
    docs: DataFrame, model_path: str, keep: list[str], text_col: str = "text"
) -> DataFrame:
    """``keep``, ``ids array<int>`` and ``decoded string`` for every row of ``docs``."""
    return _scan(docs, model_path, keep, text_col, digest=False)


def digest_documents(
    docs: DataFrame, model_path: str, keep: list[str], text_col: str = "text"
) -> DataFrame:
    """``keep``, ``n_tokens``, and SHA-256 of the comma-joined ids and of the decoded text."""
    return _scan(docs, model_path, keep, text_col, digest=True)


@lru_cache(maxsize=2)
def encoder_of(model: bytes) -> Encoder:
    """One encoder for each worker process, so words stay known from task to task."""
    return Encoder(model)


def _scan(docs, model_path, keep, text_col, digest):
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        encoder = encoder_of(model.value)
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            rows = []
            at = 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (size == 0 or size < FLAT):
                    size += len(texts[stop] or "")
                    stop += 1
                split = [encoder.words(t or "") for t in texts[at:stop]]
                encoder.learn(set().union(*split))
                known = encoder.known
                for own in split:
                    parts = [known[w] for w in own]
                    # The blank that encoding puts in front is not part of the text.
                    decoded = "".join([p[2] for p in parts])[1:]
                    if digest:
                        joined = ",".join([p[1] for p in parts])
                        rows.append(
                            (
                                joined.count(",") + 1 if joined else 0,
                                sha256(joined.encode()).hexdigest(),
                                sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest(),
                            )
                        )
                    else:
                        rows.append(([i for p in parts for i in p[0]], decoded))
                at = stop
            names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["ids", "decoded"]
            kinds = [pa.int64(), pa.string(), pa.string()] if digest else [pa.list_(pa.int32()), pa.string()]
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], *(pa.array(c, k) for c, k in zip(columns, kinds))],
                [*keep, *names],
            )

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema += (
        ", n_tokens bigint, ids_sha256 string, decoded_sha256 string"
        if digest
        else ", ids array<int>, decoded string"
    )
    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(scan, schema)
