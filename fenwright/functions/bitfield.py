"""Integers of any width inside a byte string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def _kind(kind: str) -> tuple[bool, int]:
    signed, width = kind[0] == "i", int(kind[1:])
    if kind[0] not in "iu" or not 1 <= width <= (64 if signed else 63):
        raise ValueError(kind)
    return signed, width


def _read(data: bytes, signed: bool, width: int, offset: int) -> int:
    need = (offset + width + 7) // 8
    bits = int.from_bytes(data[:need].ljust(need, b"\0"), "big") >> need * 8 - offset - width & (1 << width) - 1
    return bits - (1 << width) if signed and bits >> width - 1 else bits


def _write(data: bytes, width: int, offset: int, value: int) -> bytes:
    need = max(len(data), (offset + width + 7) // 8)
    shift = need * 8 - offset - width
    whole = int.from_bytes(data.ljust(need, b"\0"), "big")
    mask = ((1 << width) - 1) << shift
    return (whole & ~mask | (value & (1 << width) - 1) << shift).to_bytes(need, "big")


def _fit(value: int, signed: bool, width: int, overflow: str) -> int | None:
    low, high = (-(1 << width - 1), (1 << width - 1) - 1) if signed else (0, (1 << width) - 1)
    if low <= value <= high:
        return value
    if overflow == "FAIL":
        return None
    if overflow == "SAT":
        return low if value < low else high
    value &= (1 << width) - 1
    return value - (1 << width) if signed and value >> width - 1 else value


def get(c, kind: str, offset: int) -> Column:
    """The integer of a kind such as u8 or i5 at a bit offset; beyond the end zeros are read."""
    signed, width = _kind(kind)
    return F.udf(lambda x: None if x is None else _read(bytes(x), signed, width, offset), "bigint", useArrow=True)(col(c).cast("binary"))


def increment(c, kind: str, offset: int, by: int, overflow: str = "WRAP") -> Column:
    """(value, data): the integer increased under WRAP, SAT or FAIL (null and unchanged), and the string that holds it."""
    signed, width = _kind(kind)

    def run(x):
        data = bytes(x or b"")
        new = _fit(_read(data, signed, width, offset) + by, signed, width, overflow)
        return {"value": new, "data": data if new is None else _write(data, width, offset, new)}

    return F.udf(run, "value bigint, data binary", useArrow=True)(col(c).cast("binary"))


def put(c, kind: str, offset: int, value: int) -> Column:
    """(value, data): the integer that was there, and the string with the new one."""
    signed, width = _kind(kind)

    def run(x):
        data = bytes(x or b"")
        return {"value": _read(data, signed, width, offset), "data": _write(data, width, offset, value)}

    return F.udf(run, "value bigint, data binary", useArrow=True)(col(c).cast("binary"))
