"""Dated lists of hosts, applied to captures as they stood when each was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landgrid.llm.shared import written
from landgrid.operators.skew import salted_join

#: Seconds of a time bucket that captures and intervals meet in.
BUCKET = 14 * 86_400


def host_of(url: Column) -> Column:
    """Lower-case host of a url, without user, port and closing dot; null for none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    host = F.regexp_replace(host, r"\.+$", "")
    return F.when(host != "", host)


def parents_of(host: Column) -> Column:
    """The host and all domains above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def _seconds(df: DataFrame, column: str) -> Column:
    return F.col(f"`{column}`").cast("bigint")


def validity_intervals(entries: DataFrame, pattern_col: str = "pattern", category_col: str = "category", action_col: str = "action", at_col: str = "at") -> DataFrame:
    """(pattern, category, valid_from, valid_to) from dated additions and removals.

    An addition holds from its time until the next entry of its pattern and category, exclusive;
    without one it has no end (null). Of entries at one time a removal comes last. Entries with
    a null in any of the four columns, repeated entries and intervals without length are dropped.
    Times are seconds, or timestamps, which become seconds.
    """
    dated = entries.select(F.lower(F.col(f"`{pattern_col}`")).alias("pattern"), F.col(f"`{category_col}`").alias("category"), F.lower(F.col(f"`{action_col}`")).alias("action"), _seconds(entries, at_col).alias("valid_from"))
    dated = dated.dropna().distinct()
    later = F.lead("valid_from").over(Window.partitionBy("pattern", "category").orderBy("valid_from", "action"))
    ended = dated.withColumn("valid_to", later).where("action = 'add' and (valid_to is null or valid_to > valid_from)")
    return ended.select("pattern", "category", "valid_from", "valid_to")


def listed(captures: DataFrame, entries: DataFrame, url_col: str = "url", at_col: str = "fetched_at", keep: list[str] | None = None, bucket: int = BUCKET) -> DataFrame:
    """``keep`` (all columns by default) and ``_listed``: what the lists said of each capture when it was fetched.

    ``_listed`` has host, n_active (entries of the host or a domain above it that were active at
    the fetch time), and of the most specific one, the latest among equals and then the least
    category, its pattern, category and valid_from. Captures and intervals meet on domain and
    time bucket, hot domains salted, so an interval is repeated once per bucket that it spans
    between the first and the last fetch; then the times are compared.

    Captures without a url, host or time have no active entry. Repeated rows stay, each with
    the same answer. Other columns pass unchanged, but one named ``_listed`` is left out. Empty
    tables give empty results or no entries.
    """
    own = [c for c in keep or captures.columns if c != "_listed"]
    rows = captures.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(own)], host_of(F.col(f"`{url_col}`")).alias("host"), _seconds(captures, at_col).alias("at"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows)
    first, last = rows.agg(F.min("at"), F.max("at")).first()
    domains = rows.where("host is not null and at is not null").select("row", "at", F.floor(F.col("at") / bucket).alias("bucket"), F.explode(parents_of(F.col("host"))).alias("pattern"))
    spans = validity_intervals(entries).where((F.col("valid_from") <= F.lit(last)) & (F.coalesce("valid_to", F.lit(last) + 1) > F.lit(first)))
    begin, end = F.greatest("valid_from", F.lit(first)), F.least(F.coalesce(F.col("valid_to") - 1, F.lit(last)), F.lit(last))
    spans = spans.withColumn("bucket", F.explode(F.sequence(F.floor(begin / bucket), F.floor(end / bucket))))
    met = salted_join(domains, written(spans), ["pattern", "bucket"], spread=["row"]).where("valid_from <= at and (valid_to is null or at < valid_to)")
    order = F.struct((-F.length("pattern")).alias("a"), (-F.col("valid_from")).alias("b"), F.col("category").alias("c"))
    best = met.groupBy("row").agg(F.count("*").alias("n"), F.min_by(F.struct("pattern", "category", "valid_from"), order).alias("best"))
    out = rows.join(written(best.withColumnRenamed("row", "_row")), F.col("row") == F.col("_row"), "left")
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(own)], F.struct("host", F.coalesce("n", F.lit(0)).alias("n_active"), "best.pattern", "best.category", "best.valid_from").alias("_listed"))
