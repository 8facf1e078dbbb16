"""Variable-byte numbers: seven bits a byte, low ones first, the last byte marked by its high bit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vb_size(n: Column) -> Column:
    """Bytes of a number of 0 or more."""
    size = F.lit(1)
    for bits in (7, 14, 21, 28, 35, 42, 49, 56):
        size = size + (n >= F.lit(1 << bits)).cast("int")
    return size.cast("bigint")


def vb_hex(n: Column) -> Column:
    """The bytes of a number in hexadecimal digits."""
    last = vb_size(n).cast("int") - 1

    def byte(i: Column) -> Column:
        seven = F.call_function("shiftright", n.cast("bigint"), i * 7).bitwiseAND(F.lit(127))
        return F.lpad(F.hex(seven + F.when(i == last, 128).otherwise(0)), 2, "0")

    return F.array_join(F.transform(F.sequence(F.lit(0), last), byte), "")


def vb_numbers(digits: Column) -> Column:
    """The numbers that some bytes, in hexadecimal digits, encode."""
    n_bytes = (F.length(digits) / 2).cast("int")
    bytes_ = F.transform(F.sequence(F.lit(1), n_bytes), lambda i: F.conv(F.substr(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("bigint"))
    start = F.struct(F.array().cast("array<bigint>").alias("done"), F.lit(0).cast("bigint").alias("part"), F.lit(0).alias("shift"))

    def step(acc: Column, b: Column) -> Column:
        part = acc["part"] + F.call_function("shiftleft", b.bitwiseAND(F.lit(127)), acc["shift"])
        ended = b >= 128
        return F.struct(
            F.when(ended, F.array_append(acc["done"], part)).otherwise(acc["done"]).alias("done"),
            F.when(ended, F.lit(0).cast("bigint")).otherwise(part).alias("part"),
            F.when(ended, F.lit(0)).otherwise(acc["shift"] + 7).alias("shift"),
        )

    return F.when(F.length(digits) == 0, F.array().cast("array<bigint>")).otherwise(F.aggregate(bytes_, start, step)["done"])
