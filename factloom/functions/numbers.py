"""Numeric and hashing expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(value: Column, digits: int = 4) -> Column:
    """floor(x * 10^d + 0.5) / 10^d, the same on every engine."""
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def sha256_hex(value: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(value, 256))


def ceil_div(value: Column, by: int) -> Column:
    return F.ceil(value / F.lit(float(by))).cast("long")
