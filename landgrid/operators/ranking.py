"""Exact ranks, percentiles and row numbers that never sort one big group in one task.

Ranks and percentiles only need counts per distinct value. The distinct values
of a group are cut into ordered bands of about equal size, at approximate
quantiles of the group itself, so values that lie close together spread as well
as others do. A band is sorted on its own, and a group of any size only
contributes one small row per band to the step that adds the bands up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landgrid.session import cut_lineage

#: Bands of a group, and how exactly their borders are placed; neither changes a result.
BANDS, ACCURACY = 256, 2_000


def with_bands(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds ``_band``, which never falls when the value rises, to the distinct values of each group.

    A group's borders are one row. Without keys they are a literal; with keys they
    are joined, by a broadcast only when the written table is small.
    """
    shares = [k / BANDS for k in range(1, BANDS)]
    edges = counts.groupBy(*keys).agg(F.percentile_approx(value, shares, ACCURACY).alias("_edges"))
    if keys:
        # A missing key is a group of its own.
        edges = cut_lineage(edges.select(*[F.col(k).alias(f"_e_{k}") for k in keys], F.array_distinct("_edges").alias("_edges")))
        same = [F.col(k).eqNullSafe(F.col(f"_e_{k}")) for k in keys]
        joined = counts.join(edges, same, "left").drop(*[f"_e_{k}" for k in keys])
    else:
        row = edges.first()["_edges"] or []
        known = F.array(*[F.lit(float(e)) for e in sorted(set(row))]) if row else F.expr("cast(array() as array<double>)")
        joined = counts.withColumn("_edges", known)
    return joined.withColumn("_band", F.size(F.filter("_edges", lambda e: e < F.col(value)))).drop("_edges")


def _banded(df: DataFrame, keys: list[str], value: str):
    """Counts per distinct value, and per band the rows before it and in its group."""
    number = F.col(value).cast("double")
    counts = (
        df.where(number.isNotNull() & ~F.isnan(number))
        .groupBy(*keys, number.alias(value))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    # The borders, the bands and the values in them all start from the counts.
    counts = cut_lineage(with_bands(cut_lineage(counts), keys, value))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = group.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    bands = (
        counts.groupBy(*keys, "_band")
        .agg(F.sum("_n").alias("_in_band"))
        .withColumn("_before", F.coalesce(F.sum("_in_band").over(before), F.lit(0)))
        .withColumn("_total", F.sum("_in_band").over(group))
    )
    return counts, bands


def cumulative_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per group and distinct value: ``n_below``, ``n_equal`` and ``n_total``."""
    counts, bands = _banded(df, keys, value)
    within = (
        Window.partitionBy(*keys, "_band").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        counts.withColumn("_lower", F.coalesce(F.sum("_n").over(within), F.lit(0)))
        .join(bands, [*keys, "_band"])
        .select(
            *keys,
            value,
            (F.col("_before") + F.col("_lower")).alias("n_below"),
            F.col("_n").alias("n_equal"),
            F.col("_total").alias("n_total"),
        )
    )


def grouped_percentiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Linearly interpolated percentiles, one column per entry of ``probs``.

    Only the bands that hold a wanted position are sorted.
    """
    counts, bands = _banded(df, keys, value)
    wanted = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                (F.lit(float(p)) * (F.col("_total") - 1)).alias("position"),
            )
            for name, p in probs.items()
        ]
    )
    ends = (
        bands.withColumn("_w", F.explode(wanted))
        .select(
            *keys, "_band", "_before", "_in_band",
            F.col("_w.name").alias("_name"), F.col("_w.position").alias("_position"),
        )
        .withColumn("_rank", F.explode(F.array(F.floor("_position"), F.ceil("_position"))))
        .where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_in_band")))
    )
    within = Window.partitionBy(*keys, "_band").orderBy(value)
    run = counts.join(ends.select(*keys, "_band").distinct(), [*keys, "_band"], "left_semi")
    run = run.withColumn("_upto", F.sum("_n").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    hits = (
        run.join(ends, [*keys, "_band"])
        .where(
            (F.col("_rank") < F.col("_before") + F.col("_upto"))
            & (F.col("_rank") >= F.col("_before") + F.col("_upto") - F.col("_n"))
        )
        .select(*keys, "_name", "_position", "_rank", F.col(value).alias("_v"))
    )
    low = F.max(F.when(F.col("_rank") == F.floor("_position"), F.col("_v")))
    high = F.max(F.when(F.col("_rank") == F.ceil("_position"), F.col("_v")))
    share = F.max(F.col("_position") - F.floor("_position"))
    long = hits.groupBy(*keys, "_name").agg((low + (high - low) * share).alias("_p"))
    picks = [F.max(F.when(F.col("_name") == name, F.col("_p"))).alias(name) for name in probs]
    return long.groupBy(*keys).agg(*picks)


def rank_in_group(
    df: DataFrame, keys: list[str], value: str, higher_is_better: Column | bool = True
) -> DataFrame:
    """Adds ``national_rank``, ``national_pct`` and ``n_ranked`` per group.

    Rank counts the better values plus one. The percentile is the share of the
    other values that are worse, times one hundred, so the best unit has 100;
    a group of one has 0. Rows without a value keep NULL in both.
    """
    better = F.lit(higher_is_better) if isinstance(higher_is_better, bool) else higher_is_better
    counts = cumulative_counts(df, keys, value).drop("n_total").withColumnRenamed(value, "_value")
    totals = df.groupBy(*keys).agg(F.count(value).alias("n_ranked"))
    joined = (
        df.withColumn("_value", F.col(value).cast("double"))
        .join(counts, [*keys, "_value"], "left")
        .join(totals, keys, "left")
    )
    above = F.col("n_ranked") - F.col("n_below") - F.col("n_equal")
    rank = F.when(better, above).otherwise(F.col("n_below")) + 1
    worse = F.when(better, F.col("n_below")).otherwise(above)
    pct = F.when(F.col("n_ranked") > 1, worse / (F.col("n_ranked") - 1) * 100).otherwise(F.lit(0.0))
    return (
        joined.withColumn("national_rank", rank)
        .withColumn("national_pct", F.round(F.when(F.col("n_below").isNotNull(), pct), 2))
        .drop("_value", "n_below", "n_equal")
    )


def midrank_percentile(
    df: DataFrame, value: str, reference: DataFrame, reference_value: str, invert: bool = False
) -> DataFrame:
    """Adds ``percentile_score``: position of a value in a reference distribution.

    ``(below + equal / 2) / n * 100`` with two decimals. Values that are not in
    the reference take their place between its values by the same count.
    """
    ref = reference.select(F.col(reference_value).cast("double").alias("_v"), F.lit(1).alias("_ref"))
    asked = df.select(F.col(value).cast("double").alias("_v")).distinct().withColumn("_ref", F.lit(0))
    both = ref.unionByName(asked).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    # Reference rows count one, asked values count nothing.
    counts = cut_lineage(both.groupBy("_v").agg(F.sum("_ref").alias("_n")))
    counts = with_bands(counts, [], "_v")
    everything = Window.partitionBy(F.lit(0))
    before = everything.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    bands = (
        counts.groupBy("_band")
        .agg(F.sum("_n").alias("_in_band"))
        .withColumn("_before", F.coalesce(F.sum("_in_band").over(before), F.lit(0)))
        .withColumn("_total", F.sum("_in_band").over(everything))
    )
    within = Window.partitionBy("_band").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    share = (F.col("_before") + F.col("_lower") + F.col("_n") / 2) / F.col("_total") * 100
    score = F.when(F.col("_total") > 0, 100 - share if invert else share)
    places = (
        counts.withColumn("_lower", F.coalesce(F.sum("_n").over(within), F.lit(0)))
        .join(bands, "_band")
        .select("_v", F.round(score, 2).alias("percentile_score"))
    )
    return df.withColumn("_v", F.col(value).cast("double")).join(places, "_v", "left").drop("_v")


def number_rows(
    df: DataFrame, order: list[Column], name: str = "row_number", within: list[str] | None = None
) -> DataFrame:
    """Adds a row number starting at one, over all rows or within groups.

    Rows are range-partitioned and sorted once and written to the checkpoint
    folder with their place inside the partition; the counts of the partitions
    before it, one row per partition, complete the number. A group may span any
    number of partitions: its numbers are the global ones less its first.
    """
    keys = within or []
    full_order = [*[F.col(k) for k in keys], *order]
    placed = cut_lineage(
        df.repartitionByRange(*full_order)
        .sortWithinPartitions(*full_order)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    part = F.shiftright(F.col("_place"), 33)
    sizes = placed.groupBy(part.alias("_part")).count()
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    # One row per partition, so the broadcast is bounded by the partition count.
    numbered = (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + inside + 1)
        .drop("_part", "_place", "_offset")
    )
    if not keys:
        return numbered
    first = numbered.groupBy(*keys).agg((F.min(name) - 1).alias("_first"))
    return numbered.join(first, keys).withColumn(name, F.col(name) - F.col("_first")).drop("_first")
