"""Text expressions: tokens, n-grams, key=value names, span lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a token is two or more word characters or hyphens, starting and ending at a word
# boundary. `(?U)` makes Java's \w and \b follow Unicode.
TOKEN_PATTERN = r"(?U)\b[\w-][\w-]+\b"


def tokens(text: Column, pattern: str = TOKEN_PATTERN, min_length: int = 1) -> Column:
    """Lower-cased tokens of the whole text, in order."""
    found = F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))
    if min_length > 1:
        found = F.filter(found, lambda t: F.length(t) >= min_length)
    return found


def without(words: Column, stop_words: Sequence[str]) -> Column:
    """The words that are not in the list, order kept."""
    if not stop_words:
        return words
    stop = list(stop_words)
    return F.filter(words, lambda t: ~t.isin(stop))


def ngrams(words: Column, low: int = 1, high: int = 1) -> Column:
    """All runs of ``low`` to ``high`` neighbouring words, joined by a blank."""
    if not 1 <= low <= high:
        raise ValueError("need 1 <= low <= high")
    parts = [words if n == 1 else _runs(words, n) for n in range(low, high + 1)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def _runs(words: Column, n: int) -> Column:
    starts = F.when(
        F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))
    ).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def counted(terms: Column) -> Column:
    """``array<struct<feature, tf>>``: every distinct term of a sorted array and how often it stands."""
    n = F.size(terms)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(places, lambda i: (i == 0) | (F.get(terms, i) != F.get(terms, i - 1)))
    ends = F.concat(F.slice(starts, 2, F.greatest(n, F.lit(1))), F.array(n))
    return F.zip_with(
        starts, ends, lambda a, b: F.struct(F.get(terms, a).alias("feature"), (b - a).cast("double").alias("tf"))
    )


def key_value(name: str, value: Column) -> Column:
    """``NAME=value``; NULL stays NULL."""
    return F.when(value.isNotNull(), F.concat_ws("=", F.lit(name), value.cast("string")))


def collapse_blanks(text: Column) -> Column:
    """Every run of blanks becomes one; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def find(text: Column, part: Column) -> Column:
    """Zero-based position of the first match, -1 where there is none."""
    return F.instr(text, part) - 1
