"""Variable-byte numbers: base 128, most significant group first, the high bit marks the last byte.

Tables are stored as Parquet; this is for reading or writing lists in that format only.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType


def encode(number: int) -> bytes:
    if number < 0:
        raise ValueError("numbers must not be negative")
    groups = [number % 128 | 0x80]
    while number := number // 128:
        groups.append(number % 128)
    return bytes(reversed(groups))


def decode(data: bytes) -> list[int]:
    """All numbers of ``data``; a number without its last byte is an error."""
    out, value, open_ = [], 0, False
    for byte in data:
        value, open_ = value * 128 + (byte & 0x7F), not byte & 0x80
        if not open_:
            out.append(value)
            value = 0
    if open_:
        raise ValueError("the last number is cut off")
    return out


def encode_gaps(ascending: list[int]) -> bytes:
    """An ascending list as the gaps between its numbers."""
    return b"".join(encode(b - a) for a, b in zip([0, *ascending], ascending))


def decode_gaps(data: bytes) -> list[int]:
    out, at = [], 0
    for gap in decode(data):
        out.append(at := at + gap)
    return out


@F.pandas_udf(BinaryType())
def encoded_gaps(lists: pd.Series) -> pd.Series:
    """:func:`encode_gaps` of a column of ascending lists; null stays null."""
    return lists.map(lambda x: encode_gaps([int(i) for i in x]), na_action="ignore")


@F.pandas_udf(ArrayType(IntegerType()))
def decoded_gaps(data: pd.Series) -> pd.Series:
    """The inverse of :func:`encoded_gaps`."""
    return data.map(decode_gaps, na_action="ignore")
