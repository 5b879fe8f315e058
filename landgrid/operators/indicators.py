"""Municipality indicators: load from wide sheets, rank, and show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landgrid.functions.catalogue import EDUCATION_MEASURES
from landgrid.functions.normalize import lookup
from landgrid.functions.text import measure_from_text
from landgrid.operators.ranking import rank_in_group


def load_education(sheet: DataFrame, municipalities: DataFrame, code: str = "muni", period: str = "anio") -> DataFrame:
    """Long indicator rows of a wide sheet; unknown municipalities and empty values are dropped."""
    present = [m for m in EDUCATION_MEASURES if m[0] in sheet.columns]
    entries = [
        F.struct(
            F.lit(ind).alias("indicator"), F.lit(unit).alias("unit"),
            measure_from_text(F.col(col).cast("string")).alias("value"),
        )
        for col, ind, unit, _ in present
    ]
    long = (
        sheet.where(F.col(period).isNotNull())
        .select(
            F.lpad(F.col(code), 5, "0").alias("muni_code"),
            F.col(period).cast("string").alias("period"),
            F.explode(F.array(*entries)).alias("e"),
        )
        .select("muni_code", "period", "e.*")
        .where("value is not null")
    )
    known = long.join(municipalities.select("muni_code"), "muni_code", "left_semi")
    # One value per municipality, indicator and period, whatever the order of the rows.
    return known.groupBy("muni_code", "indicator", "period", "unit").agg(F.max("value").alias("value"))


def higher_is_better(indicator: Column) -> Column:
    """Direction of a known indicator; NULL where ranking makes no sense."""
    return lookup(indicator, {ind: better for _, ind, _, better in EDUCATION_MEASURES if better is not None})


def ranked(indicators: DataFrame) -> DataFrame:
    """Rank and percentile among the municipalities of the same indicator and period."""
    better = F.coalesce(higher_is_better(F.col("indicator")), F.lit(True))
    return rank_in_group(indicators, ["indicator", "period"], "value", better)


def top_ranked(indicators: DataFrame, limit: int, ascending: bool = False) -> DataFrame:
    order = F.col("value").asc_nulls_last() if ascending else F.col("value").desc_nulls_last()
    return indicators.orderBy(order, "muni_code", "indicator", "period").limit(limit)


def indicator_cards(ranked_rows: DataFrame) -> DataFrame:
    """Latest value, rank and count, and the ascending series of each municipality's indicator.

    A series has one point per period.
    """
    latest = F.max_by(
        F.struct("value", "national_rank", "national_pct", "n_ranked", "period"),
        F.when(F.col("value").isNotNull(), F.col("period")),
    )
    series = F.sort_array(F.collect_list(F.struct("period", "value")))
    return (
        ranked_rows.groupBy("muni_code", "indicator")
        .agg(latest.alias("latest"), series.alias("series"))
        .select("muni_code", "indicator", "latest.*", "series")
    )
