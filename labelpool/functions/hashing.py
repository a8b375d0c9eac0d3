"""Repeatable pseudo-random order: the md5 text of ``seed:id``.

It does not depend on how rows are partitioned and any SQL engine can repeat it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_order(id_col: str | Column, seed: int | str | Column) -> Column:
    """A uniformly spread 32-digit hex text; equal ids and seeds give equal texts."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    seed_col = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", seed_col.cast("string"), col.cast("string")))
