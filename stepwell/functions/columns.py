"""Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOTS, SLOT_BITS = 256, 7


def slot(size: Column) -> Column:
    """Histogram slot of a chunk size."""
    return F.least(F.shiftright(size, SLOT_BITS), F.lit(SLOTS - 1)).cast("int")


def slot_middle(s: Column) -> Column:
    return (s * (1 << SLOT_BITS) + (1 << SLOT_BITS - 1)).cast("long")


def nine_digits(ns: Column) -> Column:
    """Nanoseconds with leading zeros; longer numbers stay whole."""
    text = ns.cast("string")
    return F.when(F.length(text) < 9, F.lpad(text, 9, "0")).otherwise(text)


def seconds(begin_ns: Column, end_ns: Column) -> Column:
    return (end_ns - begin_ns) / F.lit(1e9)


def swap_bytes(x: Column) -> Column:
    """The four bytes of a number below 2^32 in reverse order."""
    byte = lambda k: F.shiftright(x, 8 * k).bitwiseAND(F.lit(255))
    return F.shiftleft(byte(0), 24).bitwiseOR(F.shiftleft(byte(1), 16)).bitwiseOR(F.shiftleft(byte(2), 8)).bitwiseOR(byte(3)).cast("long")


def bucket(hash_: Column, buckets: int) -> Column:
    """The bucket of a non-negative hash."""
    return (hash_ % buckets).cast("long")
