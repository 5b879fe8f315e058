"""Equi joins that split hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 500_000
#: Most keys that are split, which bounds the list that every task gets.
MOST_HOT = 50_000
SAMPLE = 0.01


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is shuffled and sorted, never collected for a broadcast.

    Spark takes an exploded row for one row and a list for one value, so tables of shapes, buckets
    or cells look a hundred times smaller to it than they are, and pass the driver whole.
    """
    return df.hint("merge")


def hot_keys(sampled: DataFrame, keys: list[str], fraction: float = SAMPLE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys that hold more than ``hot_rows`` rows by a sample's counts, with ``_fan`` salts each.

    A key the sample misjudges costs time, never a result. Of very many hot keys
    the ``MOST_HOT`` hottest are listed; adaptive execution splits the others.
    """
    rows = F.col("count") / fraction
    return (
        sampled.groupBy(*keys)
        .count()
        .where(rows > hot_rows)
        .orderBy(F.desc("count"), *keys)
        .limit(MOST_HOT)
        .select(*keys, F.ceil(rows / hot_rows).cast("int").alias("_fan"))
    )


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    spread: list[str],
    how: str = "inner",
    hot: DataFrame | None = None,
    fraction: float = SAMPLE,
    hot_rows: int = HOT_ROWS,
    sorted_merge: bool = False,
    keep_salt: bool = False,
    condition: Column | None = None,
) -> DataFrame:
    """Join on ``keys`` with every hot key of ``left`` split over several tasks.

    A hot key gets one salt per ``hot_rows`` of its rows in ``left``, chosen by
    the hash of the ``spread`` columns, which should tell its rows apart.
    Matching rows of ``right`` are repeated once per salt, so the result is
    that of the plain join. Rows of other keys are left alone. ``how`` may be
    inner, left, left_semi or left_anti. ``sorted_merge`` keeps the right side from
    being broadcast, see ``shuffled``. ``keep_salt`` leaves the salt in ``_salt``: rows of one key
    and salt are in one partition, so groups within them need no other shuffle. ``condition`` is
    tested where two rows meet, so outer joins can have one too.
    """
    if hot is None:
        hot = hot_keys(left.sample(fraction, seed=7), keys, fraction, hot_rows)
    hot = F.broadcast(hot.limit(MOST_HOT))
    salt = F.pmod(F.xxhash64(*spread), F.col("_fan"))
    salted_left = (
        left.join(hot, keys, "left")
        .withColumn("_salt", F.coalesce(salt, F.lit(0).cast("bigint")))
        .drop("_fan")
    )
    salts = F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("_fan") - 1, F.lit(0)).cast("bigint"))
    salted_right = right.join(hot, keys, "left").withColumn("_salt", F.explode(salts)).drop("_fan")
    salted_right = shuffled(salted_right) if sorted_merge else salted_right
    keys = [*keys, "_salt"]
    if condition is None:
        joined = salted_left.join(salted_right, keys, how)
    else:
        renamed = salted_right.withColumnsRenamed({k: f"_r{k}" for k in keys})
        same = [F.col(k) == F.col(f"_r{k}") for k in keys]
        joined = salted_left.join(renamed, [*same, condition], how).drop(*[f"_r{k}" for k in keys])
    return joined if keep_salt else joined.drop("_salt")
