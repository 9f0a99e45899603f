"""Bounded samples for fitting models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def bounded_sample(rows: DataFrame, size: int, of: int, key: str = "doc_id") -> list[Row]:
    """About ``size`` of the ``of`` rows, never more than twice as many: those whose key's hash falls below a threshold.

    Tasks send only rows of the sample, however many tasks there are. The
    same rows give the same sample, in whatever order they come.
    """
    bits = 1 << 30
    below = bits if of <= size else max(1, round(bits * size / of))
    return sorted(rows.where(F.pmod(F.xxhash64(key), F.lit(bits)) < below).limit(2 * size).collect(), key=lambda r: r[key])
