"""Sequential passes over arrays as column expressions, in time that grows with the array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items of a block in ``scan``.
BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, whatever lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(items: Column, carry: Column, step: Callable[[Column, Column], tuple[Column, Column]], made: str) -> Column:
    """What ``step`` makes of a carried value and each item in turn; it gives the next carry and a ``made``.

    An array that grows by one is copied each time, so items are taken in blocks.
    """

    def inner(a: Column, x: Column) -> Column:
        after, one = step(a.carry, x)
        return F.struct(after.alias("carry"), F.concat(a.out, F.array(one)).alias("out"))

    def outer(a: Column, block: Column) -> Column:
        done = F.aggregate(block, F.struct(a.carry.alias("carry"), F.array().cast(f"array<{made}>").alias("out")), inner)
        return let(done, lambda d: F.struct(d.carry.alias("carry"), F.concat(a.out, F.array(d.out)).alias("out")))

    def whole(xs: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(xs) - 1), F.lit(BLOCK))
        blocks = F.transform(at, lambda i: F.slice(xs, i + 1, F.lit(BLOCK)))
        start = F.struct(carry.alias("carry"), F.array().cast(f"array<array<{made}>>").alias("out"))
        return F.flatten(F.aggregate(blocks, start, outer, lambda a: a.out))

    return let(items, whole)
