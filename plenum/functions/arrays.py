"""Array expressions whose work grows with the array's length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sums_before(values: Column, block: int = BLOCK) -> Column:
    """For each number of an array, the sum of those before it.

    An array can only be built by copying it, so sums are taken in blocks: over blocks, and within each.
    """

    def of(p: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(p) - 1) / block).cast("int"))
        part = lambda k: F.slice(p, k * block + 1, block)

        def running(numbers: Column, first: Column) -> Column:
            start = F.struct(first.cast("long").alias("at"), F.array().cast("array<long>").alias("out"))
            return F.aggregate(numbers, start, lambda a, v: F.struct((a["at"] + v).cast("long").alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]

        totals = F.transform(blocks, lambda k: F.aggregate(part(k), F.lit(0).cast("long"), lambda a, v: a + v))
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("k"), running(totals, F.lit(0)).alias("at")), lambda x: running(part(x["k"]), x["at"])))

    return let(values, lambda p: F.when(F.size(p) > 0, of(p)).otherwise(F.array().cast("array<long>")))
