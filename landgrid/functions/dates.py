"""Cut dates, freshness and billing periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Days after which a dataset of a frequency should be looked at again.
REVIEW_DAYS = {
    "diaria": 7,
    "daily": 7,
    "semanal": 10,
    "mensual": 35,
    "monthly": 35,
    "trimestral": 100,
    "anual": 400,
    "yearly": 400,
    "annual": 400,
    "decenal": 3700,
    "eventual": 90,
    "desconocida": 90,
}
REVIEW_DAYS_OTHER = 90
LATE_FACTOR = 1.5


def cut_date(day: Column, frequency: Column) -> Column:
    """First day of the publication period ``day`` falls in; the day itself without a period."""
    half = F.make_date(F.year(day), F.when(F.month(day) <= 6, 1).otherwise(7), F.lit(1))
    return (
        F.when(frequency == "mensual", F.trunc(day, "month"))
        .when(frequency == "trimestral", F.trunc(day, "quarter"))
        .when(frequency == "semestral", half)
        .when(frequency.isin("anual", "decenal"), F.trunc(day, "year"))
        .otherwise(F.to_date(day))
    )


def review_days(frequency: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in REVIEW_DAYS.items() for v in pair])
    return F.coalesce(F.try_element_at(table, frequency), F.lit(REVIEW_DAYS_OTHER))


def freshness_state(age_days: Column, frequency: Column) -> Column:
    """al-dia, revisar past the review days, vencido past one and a half times them."""
    limit = review_days(frequency)
    return (
        F.when(age_days.isNull(), "sin-corte")
        .when(age_days > F.round(limit * LATE_FACTOR), "vencido")
        .when(age_days > limit, "revisar")
        .otherwise("al-dia")
    )


def billing_period(ts: Column) -> Column:
    """Year and month in a fixed offset of five hours behind UTC."""
    return F.date_format(ts - F.expr("INTERVAL 5 HOURS"), "yyyy-MM")
