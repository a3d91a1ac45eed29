"""Fingerprints as hexadecimal text and back, inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode(words: Column, count: int) -> Column:
    """``count`` 32-bit words as lower-case hex, eight digits each; NULL where the number of words differs."""
    parts = [F.lower(F.lpad(F.hex(words[k]), 8, "0")) for k in range(count)]
    return F.when(F.size(words) == count, F.concat(*parts))


def decode(text: Column, count: int) -> Column:
    """The words again; NULL unless the text is exactly that many hex digits."""
    parts = [F.conv(F.substring(text, 8 * k + 1, 8), 16, 10).cast("long") for k in range(count)]
    return F.when(text.rlike(f"^[0-9a-fA-F]{{{8 * count}}}$"), F.array(*parts))
