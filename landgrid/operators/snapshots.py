"""Dated cuts: which one is active, how they are published, how fresh they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landgrid.functions.dates import freshness_state

READABLE = ["published", "superseded"]


def active_rows(facts: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Fact rows of the active cuts; the cut table is small and stays one row per cut, so the facts are not moved."""
    return facts.join(F.broadcast(snapshots.where("is_active").select("snapshot_id")), "snapshot_id", "left_semi")


def rows_at(facts: DataFrame, snapshots: DataFrame, cut_date: Column, per: str = "dataset_id") -> DataFrame:
    """Fact rows of the latest readable cut of each dataset up to a date."""
    past = snapshots.where(F.col("status").isin(READABLE) & (F.col("cut_date") <= cut_date))
    latest = latest_cut(past, per).select("snapshot_id")
    return facts.join(latest, "snapshot_id", "left_semi")


def latest_cut(snapshots: DataFrame, per: str = "dataset_id") -> DataFrame:
    """The newest cut of each dataset; a tie goes to the higher id."""
    row = F.struct(*[F.col(c) for c in snapshots.columns])
    newest = F.max_by(row, F.struct("cut_date", "snapshot_id"))
    return snapshots.groupBy(per).agg(newest.alias("_row")).select("_row.*")


def latest_cut_per_dataset(datasets: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Every dataset with its newest cut, also those without any."""
    return datasets.join(latest_cut(snapshots), "dataset_id", "left")


def last_two_cuts(snapshots: DataFrame) -> DataFrame:
    """``from_id`` and ``to_id`` of the two newest cuts of each dataset."""
    cut = F.dense_rank().over(Window.partitionBy("dataset_id").orderBy(F.col("cut_date").desc()))
    ranked = snapshots.withColumn("_cut", cut).where("_cut <= 2")
    pick = lambda n: F.max(F.when(F.col("_cut") == n, F.col("snapshot_id")))
    return ranked.groupBy("dataset_id").agg(pick(2).alias("from_id"), pick(1).alias("to_id"))


def row_count_delta(snapshots: DataFrame, limit_pct: float = 10.0) -> DataFrame:
    """Change of the row count against the cut before, and whether it is within the limit."""
    before = F.lag("row_count").over(Window.partitionBy("dataset_id").orderBy("cut_date", "snapshot_id"))
    pct = F.round((F.col("row_count") - F.col("previous")) / F.col("previous") * 100, 4)
    return (
        snapshots.withColumn("previous", before)
        .withColumn("delta_pct", F.when(F.col("previous") > 0, pct))
        .withColumn("passed", F.coalesce(F.abs("delta_pct") <= limit_pct, F.lit(True)))
    )


def merge_snapshots(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert keyed by dataset and cut date; a NULL in the new row keeps the old value."""
    keys = ["dataset_id", "cut_date"]
    o = old.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in old.columns if c not in keys])
    merged = [
        F.coalesce(F.col(c), F.col(f"_old_{c}")).alias(c) if c in new.columns else F.col(f"_old_{c}").alias(c)
        for c in old.columns
        if c not in keys
    ]
    return new.join(o, keys, "full_outer").select(*keys, *merged)


def upsert_datasets(old: DataFrame, new: DataFrame) -> DataFrame:
    """Catalogue after new rows replace old ones of the same id."""
    return old.join(new, "dataset_id", "left_anti").unionByName(new)


def publish(snapshots: DataFrame, validations: DataFrame, candidates: DataFrame) -> DataFrame:
    """Cut table after publishing candidate ids.

    A candidate with a failed validation of severity error is refused, and so
    is a synthetic one while its dataset has a real published cut. Where
    several candidates of a dataset pass, the newest wins; other active cuts of
    that dataset are superseded. Adds ``publish_result`` for candidates.
    """
    failed = validations.where("severity = 'error' and not passed").select("snapshot_id").distinct()
    real = (
        snapshots.where("status = 'published' and not is_synthetic")
        .select("dataset_id").distinct().withColumn("_real", F.lit(True))
    )
    state = (
        snapshots.join(candidates.select("snapshot_id").distinct().withColumn("_asked", F.lit(True)), "snapshot_id", "left")
        .join(failed.withColumn("_failed", F.lit(True)), "snapshot_id", "left")
        .join(real, "dataset_id", "left")
    )
    result = (
        F.when(F.col("_asked").isNull(), None)
        .when(F.col("_failed"), "failed_validation")
        .when(F.col("is_synthetic") & F.coalesce(F.col("_real"), F.lit(False)), "synthetic_over_real")
        .otherwise("accepted")
    )
    state = state.withColumn("publish_result", result)
    winner = (
        state.where("publish_result = 'accepted'")
        .groupBy("dataset_id")
        .agg(F.max_by("snapshot_id", F.struct("cut_date", "snapshot_id")).alias("_winner"))
    )
    state = state.join(winner, "dataset_id", "left")
    wins = F.coalesce(F.col("snapshot_id") == F.col("_winner"), F.lit(False))
    beaten = F.col("_winner").isNotNull() & ~wins & F.col("is_active")
    return (
        state.withColumn("status", F.when(wins, "published").when(beaten, "superseded").otherwise(F.col("status")))
        .withColumn("is_active", F.when(wins, True).when(F.col("_winner").isNotNull(), False).otherwise(F.col("is_active")))
        .drop("_asked", "_failed", "_real", "_winner")
    )


def freshness(datasets: DataFrame, snapshots: DataFrame, today: Column) -> DataFrame:
    """Age and state of the active cut of every dataset that is no demo."""
    active = latest_cut(snapshots.where("is_active")).select("dataset_id", "cut_date", "row_count")
    real = datasets.where(~F.col("dataset_id").startswith("demo-"))
    age = F.datediff(today, F.col("cut_date"))
    return (
        real.join(active, "dataset_id", "left")
        .withColumn("age_days", age)
        .withColumn("state", freshness_state(F.col("age_days"), F.col("frequency")))
    )


def covered_synthetic(parcels: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Active synthetic cuts whose municipalities all have real active parcels."""
    kind = snapshots.where("is_active").select("snapshot_id", "is_synthetic")
    pairs = parcels.select("snapshot_id", "muni_code").distinct().join(kind, "snapshot_id")
    real = pairs.where("not is_synthetic").select("muni_code").distinct()
    synthetic = pairs.where("is_synthetic")
    bare = synthetic.join(real, "muni_code", "left_anti").select("snapshot_id")
    return synthetic.select("snapshot_id").distinct().join(bare, "snapshot_id", "left_anti")


def cut_dates(snapshots: DataFrame) -> DataFrame:
    """Distinct dates of readable cuts with the cut that is shown: real before synthetic, then newest."""
    preferred = F.max_by("snapshot_id", F.struct(~F.col("is_synthetic"), F.col("snapshot_id")))
    return (
        snapshots.where(F.col("status").isin(READABLE))
        .groupBy("cut_date")
        .agg(preferred.alias("snapshot_id"))
    )


def lineage_map(snapshots: DataFrame) -> DataFrame:
    """One row with the map of dataset to active cut; one entry per dataset."""
    active = latest_cut(snapshots.where("is_active"))
    entries = F.sort_array(F.collect_list(F.struct("dataset_id", "snapshot_id")))
    return active.agg(F.map_from_entries(entries).alias("source_snapshots"))


def sources_of(rows: DataFrame, datasets: DataFrame, snapshots: DataFrame, lineage: str = "source_snapshots") -> DataFrame:
    """Distinct datasets and cuts behind rows that carry a lineage map."""
    used = rows.select(F.explode(F.col(lineage)).alias("dataset_id", "snapshot_id")).distinct()
    cuts = snapshots.select("snapshot_id", "cut_date", "is_synthetic")
    return used.join(datasets, "dataset_id", "left").join(cuts, "snapshot_id", "left")
