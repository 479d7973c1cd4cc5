"""Posting codecs as column expressions: VarByte (seven bits a byte, low ones first) and Raw32."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CODECS = ("varbyte", "raw32")


def checked_codec(codec: str) -> str:
    if codec not in CODECS:
        raise ValueError(f"codec must be one of {', '.join(CODECS)}")
    return codec


def varbyte_length(v: Column) -> Column:
    return reduce(lambda total, bits: total + (v >= F.lit(1 << bits)).cast("int"), (7, 14, 21, 28), F.lit(1))


def encoded_length(v: Column, codec: str) -> Column:
    return varbyte_length(v) if checked_codec(codec) == "varbyte" else F.lit(4)


def _shifted(v: Column, bits: int) -> Column:
    return F.shiftright(v, bits) if bits >= 0 else F.shiftleft(v, -bits)


def _sum(parts: list[Column]) -> Column:
    return reduce(Column.__add__, parts)


def _swapped(v: Column) -> Column:
    """A number of 32 bits with its bytes turned round."""
    return _sum([_shifted(_shifted(v, 8 * i).bitwiseAND(F.lit(255)), 8 * i - 24) for i in range(4)])


def encode(v: Column, codec: str = "varbyte") -> Column:
    """A number from 0 to 2**32 - 1 as BINARY."""
    v = v.cast("long")
    if checked_codec(codec) == "raw32":
        return F.unhex(F.lpad(F.hex(_swapped(v)), 8, "0"))
    # the bytes as digits of one number, all but the last with the bit that says that more follow
    size = varbyte_length(v)
    whole = F.lit(None)
    for n in range(1, 6):
        digits = _sum([_shifted(_shifted(v, 7 * i).bitwiseAND(F.lit(127)) + F.lit(128 if i < n - 1 else 0).cast("long"), -8 * (n - 1 - i)) for i in range(n)])
        whole = F.when(size == n, F.lpad(F.hex(digits), 2 * n, "0")).otherwise(whole)
    return F.unhex(whole)


def decode(data: Column, codec: str = "varbyte") -> Column:
    """The number that ``data`` encodes; an error for what was cut short, goes on or exceeds 35 bits."""
    raw = checked_codec(codec) == "raw32"
    most = 4 if raw else 5
    # one number of all digits, zeros after the last
    number = F.conv(F.rpad(F.hex(data), 2 * most, "0"), 16, 10).cast("long")
    size = F.octet_length(data)
    if raw:
        return F.when(size == 4, F.lit(0).cast("long")).otherwise(F.raise_error(F.lit("four bytes expected")).cast("long")) + _swapped(number)
    more = number.bitwiseAND(F.lit(0x8080808080))
    expected = F.element_at(F.array(*[F.lit(sum(0x80 << 8 * (4 - i) for i in range(n - 1))).cast("long") for n in range(1, 6)]), F.least(F.greatest(size, F.lit(1)), F.lit(5)))
    whole = (size > 0) & (size <= 5) & (more == expected)
    value = _sum([_shifted(_shifted(number, 32 - 8 * i).bitwiseAND(F.lit(127)), -7 * i) for i in range(5)])
    return F.when(whole, F.lit(0).cast("long")).otherwise(F.raise_error(F.lit("not one VarByte number")).cast("long")) + value
