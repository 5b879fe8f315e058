"""Daily use and active users as tables that a stream adds to, exact however late an event is.

Every batch writes what it adds to its own folder, so a replayed batch counts once and
nothing is dropped behind a watermark. Folders up to some batch can be merged into a base;
a reader takes the newest base and the batches after it.

    path/parts/batch=N   what batch N adds
    path/base/batch=N    everything up to batch N, merged
    path/clock/batch=N   the latest event time up to batch N
    path/news/batch=N    days that batch N closed or corrected
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

DAY = ["org_id", "metric", "period"]
USER_DAY = ["period", "user_id"]


def _finished(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches whose folder was written to its end, in order."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return []
    names = [status.getPath().getName() for status in files.listStatus(place)]
    whole = [n for n in names if n.startswith("batch=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
    return sorted(int(n.split("=")[1]) for n in whole)


def _drop(spark: SparkSession, folder: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of all other columns per key, in their own types."""
    return parts.groupBy(*keys).agg(*[F.sum(c).cast(kind).alias(c) for c, kind in parts.dtypes if c not in keys])


def read_parts(spark: SparkSession, path: str, until: int | None = None) -> DataFrame:
    """The newest base and the batches after it, not merged; up to batch ``until`` if it is given."""
    wanted = lambda numbers: [n for n in numbers if until is None or n <= until]
    base = wanted(_finished(spark, f"{path}/base"))[-1:]
    later = [n for n in wanted(_finished(spark, f"{path}/parts")) if not base or n > base[0]]
    folders = [f"{path}/base/batch={n}" for n in base] + [f"{path}/parts/batch={n}" for n in later]
    if not folders:
        raise ValueError(f"no batch was added to {path} yet")
    return spark.read.parquet(*folders)


def compact(spark: SparkSession, path: str, keys: list[str]) -> None:
    """Merge all finished batches into a new base.

    What the base before it had replaced goes now, so a reader that began before this merge
    still finds its folders. A batch that is replayed later is under the base and not read.
    """
    bases, parts = _finished(spark, f"{path}/base"), _finished(spark, f"{path}/parts")
    if not parts or bases and parts[-1] <= bases[-1]:
        return
    merged(read_parts(spark, path, parts[-1]), keys).write.mode("overwrite").parquet(f"{path}/base/batch={parts[-1]}")
    for n in bases[:-1]:
        _drop(spark, f"{path}/base/batch={n}")
    for n in parts:
        if bases and n <= bases[-1]:
            _drop(spark, f"{path}/parts/batch={n}")


def _closes(period: Column, delay_days: int) -> Column:
    """When a day closes: so many days after its end."""
    return F.date_add(period, 1 + delay_days).cast("timestamp")


def _clock(spark: SparkSession, path: str, before: int | None = None):
    """The latest event time of all batches, or of those before one; None without any."""
    numbers = [n for n in _finished(spark, f"{path}/clock") if before is None or n < before]
    return spark.read.parquet(f"{path}/clock/batch={numbers[-1]}").first()[0] if numbers else None


def add_days(events: DataFrame, path: str, checkpoint: str, delay_days: int = 1, trigger: dict | None = None) -> StreamingQuery:
    """Adds the use per organisation, metric and day of every batch of ``org_id, metric, ts, amount``.

    A day closes when the latest event time of all batches is ``delay_days`` past its end. Each
    batch tells in ``news`` which days it closed and which closed ones it corrected, with their
    sums after it. Events after the close count, in ``late_used`` too. Rows without a time
    belong to no day and are left out.
    """
    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = F.lit(_clock(spark, path, number)).cast("timestamp")
        day = F.to_date("ts").alias("period")
        late = F.coalesce(_closes(F.to_date("ts"), delay_days) <= before, F.lit(False))
        part = batch.where("ts is not null").groupBy("org_id", "metric", day).agg(
            F.sum("amount").alias("used"), F.count(F.lit(1)).alias("events"),
            F.coalesce(F.sum(F.when(late, F.col("amount"))), F.lit(0)).alias("late_used"), F.count_if(late).alias("late_events"),
        )
        part.write.mode("overwrite").parquet(f"{path}/parts/batch={number}")
        batch.agg(F.greatest(F.max("ts"), before).alias("latest")).coalesce(1).write.mode("overwrite").parquet(f"{path}/clock/batch={number}")
        now = F.lit(_clock(spark, path, number + 1)).cast("timestamp")
        closes = _closes(F.col("period"), delay_days)
        own = spark.read.parquet(f"{path}/parts/batch={number}").where("late_events > 0").select(*[F.col(k).alias(f"_{k}") for k in DAY])
        # A batch that is replayed after a merge is under the base, which has its sums already.
        bases = _finished(spark, f"{path}/base")
        sums = merged(read_parts(spark, path, max(number, *bases[-1:]) if bases else number), DAY)
        closed = sums.where((closes <= now) & F.coalesce(closes > before, F.lit(True))).withColumn("kind", F.lit("closed"))
        same = F.lit(True)
        for k in DAY:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        corrected = sums.join(own, same, "left_semi").withColumn("kind", F.lit("corrected"))
        closed.unionByName(corrected).write.mode("overwrite").parquet(f"{path}/news/batch={number}")

    return (
        events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def read_days(spark: SparkSession, path: str, delay_days: int = 1) -> DataFrame:
    """Every day so far, the open ones included: sums, what came late, and whether it is closed."""
    now = F.lit(_clock(spark, path)).cast("timestamp")
    return merged(read_parts(spark, path), DAY).withColumn("closed", F.coalesce(_closes(F.col("period"), delay_days) <= now, F.lit(False)))


def read_news(spark: SparkSession, path: str) -> DataFrame:
    """What the batches closed and corrected, with the number of the batch."""
    return spark.read.parquet(f"{path}/news")


def add_actives(events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Adds the calls per day and user of every batch; sets of days merge, so any run of days counts exactly."""
    def add(batch: DataFrame, number: int) -> None:
        calls = batch.where("ts is not null").groupBy(F.to_date("ts").alias("period"), "user_id").agg(F.count(F.lit(1)).alias("calls"))
        calls.write.mode("overwrite").parquet(f"{path}/parts/batch={number}")

    return (
        events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def read_actives(spark: SparkSession, path: str, days: int = 30) -> DataFrame:
    """Distinct users and calls per run of days, counted from 1970-01-01; users are made distinct before they are counted."""
    start = F.expr(f"date_add(date'1970-01-01', cast(floor(datediff(period, date'1970-01-01') / {days}) as int) * {days})")
    per_user = read_parts(spark, path).groupBy(start.alias("period"), "user_id").agg(F.sum("calls").alias("calls"))
    return per_user.groupBy("period").agg(F.count("user_id").alias("active_users"), F.sum("calls").alias("calls"))
