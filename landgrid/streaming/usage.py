"""Usage events, charges and changes as streams.

Events later than the watermark (one day unless told otherwise) are dropped;
the batch operators in ``operators.usage`` give the figures to reconcile with.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from landgrid.operators.changes import evaluate_alerts

WATERMARK = "1 day"


def daily_usage(events: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Use per organisation, metric and day."""
    return (
        events.withWatermark("ts", watermark)
        .groupBy("org_id", "metric", F.window("ts", "1 day").alias("w"))
        .agg(F.sum("amount").alias("used"))
        .select("org_id", "metric", F.to_date("w.start").alias("period"), "used")
    )


def over_limit(usage: DataFrame, limits: DataFrame) -> DataFrame:
    """Days over their limit; ``limits`` is a static table of ``metric, quota``."""
    return usage.join(limits, "metric").where(F.col("used") > F.col("quota"))


def charge_once(charges: DataFrame, key: str = "event_id", watermark: str = WATERMARK) -> DataFrame:
    """Charges without the keys already seen within the watermark."""
    return charges.withWatermark("ts", watermark).dropDuplicatesWithinWatermark([key])


def active_users(events: DataFrame, watermark: str = WATERMARK, days: int = 30) -> DataFrame:
    """Approximate distinct users and calls per window of days."""
    return (
        events.withWatermark("ts", watermark)
        .groupBy(F.window("ts", f"{days} days").alias("w"))
        .agg(F.approx_count_distinct("user_id").alias("active_users"), F.count(F.lit(1)).alias("calls"))
        .select(F.to_date("w.start").alias("period"), "active_users", "calls")
    )


def monthly_usage(events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Adds every batch's use per month to a table partitioned by batch.

    A replayed batch overwrites its own partition, so nothing counts twice;
    ``read_monthly_usage`` adds the partitions up.
    """
    def add(batch: DataFrame, number: int) -> None:
        month = F.date_format("ts", "yyyy-MM")
        used = batch.groupBy("org_id", "metric", month.alias("period")).agg(F.sum("amount").alias("used"))
        used.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def read_monthly_usage(stored: DataFrame) -> DataFrame:
    return stored.groupBy("org_id", "metric", "period").agg(F.sum("used").alias("used"))


def watch_changes(changes: DataFrame, alerts: DataFrame, deliver: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Evaluates the alerts on changes on every batch of new change rows and hands over what fired.

    A batch counts its own rows, so an alert whose changes come in several batches fires in
    each with that batch's number; the sum over batches is the count.
    """
    def evaluate(batch: DataFrame, number: int) -> None:
        deliver(evaluate_alerts(alerts, batch), number)

    return (
        changes.writeStream.foreachBatch(evaluate).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def watch_cuts(cuts: DataFrame, alerts: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Adds the new_cut alerts of every new cut to a table, each alert and cut once.

    ``cuts`` streams ``dataset_id, cut_date``. A cut that comes again, in the same or a later
    batch, fires nothing; a replayed batch overwrites its own partition. ``read_sent_cuts``
    reads the table.
    """
    wanted = alerts.where("kind = 'new_cut'").select("alert_id", "dataset_id")

    def send(batch: DataFrame, number: int) -> None:
        fired = batch.select("dataset_id", "cut_date").distinct().join(wanted, "dataset_id").select("alert_id", "dataset_id", "cut_date")
        before = read_sent_cuts(batch.sparkSession, path, fired.schema).where(F.col("batch") < number)
        fired.join(before, ["alert_id", "dataset_id", "cut_date"], "left_anti").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        cuts.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def read_sent_cuts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The alerts sent so far with their batch; none while the table does not exist."""
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(path)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything available and write it as files."""
    query = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
