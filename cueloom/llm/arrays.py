"""Running sums inside arrays, by SQL functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, even where it stands inside a lambda."""
    return F.transform(F.array(value), use)[0]


def running_starts(lengths: Column) -> Column:
    """array<int>: the sum of the lengths before each element of an array<int>.

    Sums run within pieces of about the square root of the size and over the
    pieces' totals, so that a long array isn't copied once for each element.
    """
    none = F.array().cast("array<int>")

    def sums(values: Column) -> Column:
        step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(values, F.struct(F.lit(0).alias("at"), none.alias("out")), step)

    def in_pieces(given: Column) -> Column:
        size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(given))).cast("int"))
        first = F.when(F.size(given) > 0, F.sequence(F.lit(1), F.size(given), size)).otherwise(none)
        pieces = F.transform(first, lambda i: sums(F.slice(given, i, size)))
        return let(pieces, lambda parts: F.flatten(F.zip_with(parts, sums(F.transform(parts, lambda p: p["at"]))["out"], lambda p, b: F.transform(p["out"], lambda x: x + b))))

    return let(lengths, in_pieces)
