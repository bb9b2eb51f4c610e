"""Expressions of strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bytes_number(text: Column, modulus: int) -> Column:
    """The number that the text's UTF-8 bytes write in base 256, modulo ``modulus`` (below 2**54); an empty text is 0, null stays null.

    The whole number would outgrow any column, so bytes are folded in one by one.
    """
    digits = F.hex(F.encode(text, "utf-8"))
    at = F.filter(F.sequence(F.lit(0), F.octet_length(text)), lambda i: i > 0)
    digit = lambda i: F.conv(F.substring(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("long")
    return F.aggregate(at, F.lit(0).cast("long"), lambda n, i: F.pmod(n * 256 + digit(i), F.lit(modulus).cast("long")))
