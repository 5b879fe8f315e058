"""Usage events, quotas and the credit ledger, in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landgrid.functions.dates import billing_period

# Entry kinds of the ledger and the column each is reported in.
ENTRY_KINDS = {
    "plan_grant": "granted", "purchase": "purchased", "adjustment": "adjusted",
    "refund": "refunded", "debit": "debited", "expiry": "expired",
}


def balances(ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Balance, sum per kind of entry and number of entries."""
    per_kind = [
        F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("amount"))), F.lit(0)).alias(name)
        for kind, name in ENTRY_KINDS.items()
    ]
    return ledger.groupBy(*keys).agg(F.sum("amount").alias("balance"), *per_kind, F.count(F.lit(1)).alias("entry_count"))


def period_balances(ledger: DataFrame) -> DataFrame:
    return balances(ledger.withColumn("period", billing_period(F.col("ts"))), ["owner_id", "period"])


def append_entries(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """Ledger with the new entries whose id it does not hold; copies among the new ones count once."""
    unseen = new.join(ledger.select("entry_id"), "entry_id", "left_anti")
    row = F.struct(*[F.col(c) for c in ledger.columns])
    once = unseen.groupBy("entry_id").agg(F.min(row).alias("r")).select("r.*")
    return ledger.unionByName(once)


def available(balance: Column, reserved: Column) -> Column:
    return balance - reserved


def quota_usage(events: DataFrame, limits: DataFrame, period: str = "day") -> DataFrame:
    """Use per organisation, metric and day or month, and whether it passes the limit.

    ``limits`` has ``metric, quota``.
    """
    start = F.to_date(F.date_trunc(period, F.col("ts")))
    used = events.groupBy("org_id", "metric", start.alias("period")).agg(F.sum("amount").alias("used"))
    return used.join(limits, "metric", "left").withColumn(
        "over_limit", F.coalesce(F.col("used") > F.col("quota"), F.lit(False))
    )


def charge_once(charges: DataFrame, key: str = "event_id") -> DataFrame:
    """Charges without repeated keys; of several, the earliest stays."""
    row = F.struct("ts", *[F.col(c) for c in charges.columns if c not in ("ts", key)])
    return charges.groupBy(key).agg(F.min(row).alias("r")).select(key, "r.*")


def active_users(events: DataFrame, until: Column, days: int = 30) -> DataFrame:
    """Distinct users and calls of the last days; users are made distinct before they are counted."""
    start = until - F.expr(f"INTERVAL {days} DAYS")
    recent = events.where((F.col("ts") > start) & (F.col("ts") <= until))
    per_user = recent.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return per_user.agg(F.count(F.lit(1)).alias("active_users"), F.sum("n").alias("calls"))


def business_metrics(events: DataFrame, prices: DataFrame) -> DataFrame:
    """Users, payers, conversion, monthly revenue and reports per active user; one row.

    ``prices`` has ``metric, price``: what one event of a kind brings in.
    """
    priced = events.join(prices, "metric", "left")
    per_user = priced.groupBy("user_id").agg(
        F.count_if(F.col("metric") == "purchase").alias("purchases"),
        F.count_if(F.col("metric") == "view").alias("reports"),
        F.sum(F.coalesce("price", F.lit(0.0))).alias("revenue"),
    )
    return per_user.agg(
        F.count(F.lit(1)).alias("users"),
        F.count_if(F.col("purchases") > 0).alias("paying"),
        F.sum("revenue").alias("revenue"),
        F.sum("reports").alias("reports"),
    ).select(
        "users", "paying", F.round("revenue", 2).alias("revenue"),
        F.round(F.col("paying") / F.col("users") * 100, 4).alias("conversion_pct"),
        F.round(F.col("reports") / F.col("users"), 4).alias("reports_per_user"),
    )
