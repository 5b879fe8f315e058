"""Column expressions that several native operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as the word rules mean it: space and the control characters 9 to 13.
SPACES = r"[\x20\x09-\x0D]+"
NOT_SPACES = r"[^\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def once(df: DataFrame) -> DataFrame:
    """``df`` so that filters above stay above: its expressions are not repeated in a filter below them.

    A column that is not deterministic, here the row's place, holds a filter back that uses it
    (``_place >= 0``); unused it may be pruned.
    """
    return df.withColumn("_place", F.monotonically_increasing_id())


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def total(numbers: Column, kind: str = "bigint") -> Column:
    return F.aggregate(numbers, F.lit(0).cast(kind), lambda a, x: a + x)


def running(numbers: Column, start: Column | int = 0) -> Column:
    """For each number the sum of those before it, from ``start``; meant for short arrays."""
    zero = F.struct(F.lit(start).cast("bigint").alias("at") if isinstance(start, int) else start.cast("bigint").alias("at"), F.expr("cast(array() as array<bigint>)").alias("out"))
    return F.aggregate(numbers, zero, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])


def sums_before(numbers: Column, block: int = 512) -> Column:
    """As ``running``, for arrays of any length: block by block."""

    def cut(whole: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / block)), lambda b: F.slice(whole, (b * block + 1).cast("int"), F.lit(block)))
        return let(blocks, lambda parts: let(running(F.transform(parts, lambda p: total(p))), lambda bases: F.flatten(F.zip_with(parts, bases, lambda p, b: running(p, b)))))

    return let(numbers, lambda whole: F.when(F.size(whole) > 0, cut(whole)).otherwise(F.expr("cast(array() as array<bigint>)")))
