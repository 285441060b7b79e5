"""The dialect's scalar functions as Columns (JVM-side, inside code generation)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim(x: Column, side: str = "BOTH", char: str = " ") -> Column:
    return {"BOTH": F.btrim, "LEADING": F.ltrim, "TRAILING": F.rtrim}[side](x, F.lit(char))


def position(needle: Column, hay: Column, compat: bool = False) -> Column:
    """1-based place of ``needle``, 0 if absent; a null needle gives null, or 0
    with ``compat`` where the hay is not null."""
    p = F.position(needle, hay)
    return F.when(needle.isNull() & hay.isNotNull(), F.lit(0)).otherwise(p) if compat else p


def substring(x: Column, start: int | Column, length: int | Column | None = None) -> Column:
    start = start if isinstance(start, Column) else F.lit(start)
    return F.substr(x, start) if length is None else F.substr(x, start, length if isinstance(length, Column) else F.lit(length))


def char_pad(x: Column, n: int) -> Column:
    """The value of CHAR(n): cut or blank-padded."""
    return F.rpad(x.cast("string"), n, " ")


def nullif(a: Column, b: Column) -> Column:
    return F.nullif(a, b)


def coalesce(*xs: Column) -> Column:
    return F.coalesce(*xs)


def row_compare(op: str, a: Sequence[Column], b: Sequence[Column], compat: bool = False) -> Column:
    """Comparison of row values under three-valued logic: equality item by
    item, order by the first items that differ."""
    equal = reduce(lambda x, y: x & y, [x == y for x, y in zip(a, b, strict=True)])
    test = {"=": lambda x, y: x == y, "<>": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}
    if op == "=":
        return equal
    if compat:
        return reduce(lambda x, y: x & y, [test[op](x, y) for x, y in zip(a, b)])
    if op == "<>":
        return ~equal
    out = test[op](a[-1], b[-1])
    for x, y in list(zip(a, b))[-2::-1]:
        out = test[op[0]](x, y) | ((x == y) & out)
    return out


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Whether two periods share a moment; ends may come in either order."""
    s, e, t, f = F.least(a0, a1), F.greatest(a0, a1), F.least(b0, b1), F.greatest(b0, b1)
    return ((s > t) & (s < f)) | ((t > s) & (t < e)) | (s == t)
