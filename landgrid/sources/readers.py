"""Landed files into DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landgrid.functions import geo
from landgrid.session import cut_lineage

FEATURES = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"


def read_records(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Landed JSON rows, one object per line or one array per file."""
    reader = spark.read.option("multiLine", "false")
    return (reader.schema(schema) if schema else reader).json(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Features of landed collections as ``properties, geometry_type, coordinates``.

    Coordinates stay JSON text until ``polygon_from`` or ``point_from`` reads them.
    """
    files = spark.read.schema(FEATURES).option("multiLine", "true").json(path)
    return files.select(F.explode("features").alias("f")).select(
        F.col("f.properties").alias("properties"),
        F.col("f.geometry.type").alias("geometry_type"),
        F.col("f.geometry.coordinates").alias("coordinates"),
    )


def _points(rings: Column) -> Column:
    return F.transform(rings, lambda ring: F.transform(ring, lambda p: geo.point(p[0], p[1])))


def polygon_from(kind: Column, coordinates: Column) -> Column:
    """Cleaned rings of a polygon or of all parts of a multipolygon."""
    single = F.from_json(coordinates, "array<array<array<double>>>")
    many = F.from_json(coordinates, "array<array<array<array<double>>>>")
    parts = F.transform(many, lambda rings: geo.clean_polygon(_points(rings)))
    return F.when(kind == "Polygon", geo.clean_polygon(_points(single))).when(
        kind == "MultiPolygon", F.flatten(F.filter(parts, lambda p: p.isNotNull()))
    )


def point_from(kind: Column, coordinates: Column) -> Column:
    pair = F.from_json(coordinates, "array<double>")
    return F.when(kind == "Point", geo.point(pair[0], pair[1]))


def read_extract(spark: SparkSession, path: str, kind: str, schema: T.StructType | str | None = None, separator: str = ",") -> DataFrame:
    """A columnar or delimited extract."""
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "csv":
        reader = spark.read.option("header", "true").option("sep", separator)
        return (reader.schema(schema) if schema else reader).csv(path)
    raise ValueError(f"unknown extract kind {kind}")


def group_rings(rings: DataFrame, keys: list[str]) -> DataFrame:
    """Rings given without order, each with ``shell_no``: the shell it belongs to.

    Clockwise rings are shells, as the source format has it; a hole belongs to
    the smallest shell that holds its first point, and a hole without a shell
    becomes one. ``rings`` has ``ring_no`` and ``ring``.

    Holes meet shells in square buckets about as wide as the shell, by boxes alone; what is
    left is settled by the shell's edges at the height of the hole's point. So rows grow with
    rings and points, not with holes times shells or holes times points, and no ring is copied.
    """
    sized = rings.withColumn("_a", geo.ring_signed_area(F.col("ring"))).where(F.col("_a") != 0)
    rises = F.transform(_ring_edges(F.col("ring")), lambda e: F.abs(e["y2"] - e["y1"]))
    slim = cut_lineage(sized.select(
        *keys, "ring_no", "_a", F.col("ring")[0].alias("_p"), geo.box(F.array("ring")).alias("_box"),
        (F.aggregate(rises, F.lit(0.0), lambda total, v: total + v) / F.size("ring")).alias("_step"),
    ))
    pairs = cut_lineage(_ring_pairs(slim, keys))
    of_shell = [*keys, "shell_no"]
    shells = sized.withColumnRenamed("ring_no", "shell_no").join(pairs.select(*of_shell).distinct(), of_shell, "left_semi")
    low = slim.where("_a < 0").select(*keys, F.col("ring_no").alias("shell_no"), F.col("_box.ymin").alias("_low"), "_step")
    edges = shells.select(*of_shell, F.explode(_ring_edges(F.col("ring"))).alias("_e")).join(low, of_shell)
    strips = F.sequence(_strip(F.least("_e.y1", "_e.y2")), _strip(F.greatest("_e.y1", "_e.y2")))
    edges = edges.select(*of_shell, "_e", F.explode(strips).alias("_strip"))
    crossed = pairs.join(edges, [*of_shell, "_strip"]).where(
        "(_e.y1 > _p.y) <> (_e.y2 > _p.y) and _p.x < (_e.x2 - _e.x1) * (_p.y - _e.y1) / (_e.y2 - _e.y1) + _e.x1"
    )
    held = crossed.groupBy(*keys, "ring_no", "shell_no").agg(F.count(F.lit(1)).alias("_n"), F.first("_size").alias("_size")).where("_n % 2 = 1")
    owner = held.groupBy(*keys, "ring_no").agg(F.min_by("shell_no", F.struct("_size", "shell_no")).alias("shell_no"))
    placed = sized.join(owner, [*keys, "ring_no"], "left")
    return placed.select(
        *keys, "ring_no", F.coalesce("shell_no", "ring_no").alias("shell_no"),
        F.coalesce(F.col("_a") > 0, F.lit(False)).__and__(F.col("shell_no").isNotNull()).alias("is_hole"), "ring",
    )


def _ring_edges(ring: Column) -> Column:
    """Edges of a closed ring that are not level."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    edge = lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"))
    return F.filter(F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), edge), lambda e: e["y1"] != e["y2"])


def _strip(y: Column) -> Column:
    """Which of the shell's strips, each as high as its edges are on average, holds a height."""
    return F.floor((y - F.col("_low")) / F.col("_step"))


def _ring_pairs(slim: DataFrame, keys: list[str]) -> DataFrame:
    """(hole, shell) of one feature where the larger shell's box holds the hole's first point, each pair once."""
    extent = F.greatest(F.col("_box.xmax") - F.col("_box.xmin"), F.col("_box.ymax") - F.col("_box.ymin"))
    side = F.pow(F.lit(2.0), F.col("_level"))
    run = lambda axis: F.sequence(F.floor(F.col(f"_box.{axis}min") / side), F.floor(F.col(f"_box.{axis}max") / side))
    # A bucket is at least as wide as the box, so a shell lies in four of them at most.
    shells = slim.where("_a < 0").select(
        *keys, F.col("ring_no").alias("shell_no"), F.abs("_a").alias("_size"), "_box", "_step", F.ceil(F.log2(extent)).cast("int").alias("_level")
    )
    levels = shells.groupBy(*keys).agg(F.collect_set("_level").alias("_levels"))  # powers of two: a few dozen
    shells = shells.withColumn("_ix", F.explode(run("x"))).withColumn("_iy", F.explode(run("y")))
    holes = slim.where("_a > 0").select(*keys, "ring_no", "_a", "_p").join(levels, keys).withColumn("_level", F.explode("_levels"))
    holes = holes.select(*keys, "ring_no", "_a", "_p", "_level", F.floor(F.col("_p.x") / side).alias("_ix"), F.floor(F.col("_p.y") / side).alias("_iy"))
    held = holes.join(shells, [*keys, "_level", "_ix", "_iy"]).where(
        F.col("_p.x").between(F.col("_box.xmin"), F.col("_box.xmax")) & F.col("_p.y").between(F.col("_box.ymin"), F.col("_box.ymax"))
        & (F.col("_a") < F.col("_size"))
    )
    return held.select(*keys, "ring_no", "shell_no", "_p", "_size", F.floor((F.col("_p.y") - F.col("_box.ymin")) / F.col("_step")).alias("_strip"))


def column_catalogue(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Fields of a payload map with the type their values fit, fill and approximate variety."""
    values = df.select(F.explode(payload).alias("field", "value"))
    v = F.col("value")
    fits = (
        F.when(v.isNull() | (F.trim(v) == ""), None)
        .when(v.try_cast("bigint").isNotNull(), "integer")
        .when(v.try_cast("double").isNotNull(), "number")
        .when(F.lower(v).isin("true", "false"), "boolean")
        .when(F.try_to_timestamp(v).isNotNull(), "timestamp")
        .otherwise("text")
    )
    grouped = values.withColumn("fit", fits).groupBy("field").agg(
        F.count(F.lit(1)).alias("n"), F.count("fit").alias("filled"), F.sort_array(F.collect_set("fit")).alias("fits"),
        F.approx_count_distinct("value").alias("about_distinct"),
    )
    has = lambda *names: F.size(F.array_except("fits", F.array(*[F.lit(n) for n in names]))) == 0
    kind = (
        F.when(F.size("fits") == 0, "unknown").when(has("integer"), "integer").when(has("integer", "number"), "number")
        .when(has("boolean"), "boolean").when(has("timestamp"), "timestamp").otherwise("text")
    )
    return grouped.select("field", "n", "filled", kind.alias("type"), "about_distinct")
