"""Column expressions over raw bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cut_bytes(data: Column | str, start: Column | int, size: Column | int) -> Column:
    """``size`` bytes from zero-based ``start``."""
    start = start if isinstance(start, Column) else F.lit(start)
    size = size if isinstance(size, Column) else F.lit(size)
    return F.substring(_col(data), (start + 1).cast("int"), size.cast("int"))


def unsigned(data: Column | str, start: Column | int, size: int = 1) -> Column:
    """Big-endian unsigned integer of ``size`` bytes; null past the end."""
    part = cut_bytes(data, start, size)
    return F.when(
        F.length(part) == size, F.conv(F.hex(part), 16, 10).cast("long")
    )


def zeros(size: Column | int) -> Column:
    size = size if isinstance(size, Column) else F.lit(size)
    return F.unhex(F.repeat(F.lit("00"), size.cast("int")))


def blank(data: Column | str, start: Column | int, size: Column | int) -> Column:
    """``data`` with ``size`` bytes from ``start`` set to zero."""
    start = start if isinstance(start, Column) else F.lit(start)
    size = size if isinstance(size, Column) else F.lit(size)
    size = size.cast("int")
    filled = F.overlay(_col(data), zeros(size), (start + 1).cast("int"), size)
    return F.when(size > 0, filled).otherwise(_col(data))
