"""Exports and staged tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landgrid.functions.geo import parts
from pyspark.sql import types as T

MISSING = "NO_DISPONIBLE"


def stage(df: DataFrame, path: str) -> None:
    """Write rows partitioned by cut; cuts in ``df`` replace their old rows, others stay."""
    df.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("snapshot_id").parquet(path)


def export_rows(df: DataFrame) -> DataFrame:
    """All columns as text with the missing mark for NULL; nested values as JSON."""
    def text(f: T.StructField) -> Column:
        nested = isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
        value = F.to_json(f.name) if nested else F.col(f.name).cast("string")
        return F.coalesce(value, F.lit(MISSING)).alias(f.name)

    return df.select(*[text(f) for f in df.schema.fields])


def csv_lines(df: DataFrame) -> DataFrame:
    """One text line per row: semicolons, quotes where needed."""
    quoted = [
        F.when(F.col(c).rlike('[;"\\r\\n]'), F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c))
        for c in df.columns
    ]
    return export_rows(df).select(F.concat_ws(";", *quoted).alias("value"))


def write_csv(df: DataFrame, path: str, notes: list[str] | None = None) -> None:
    """Delimited files with a byte-order mark, notes, a header and CRLF line ends.

    Every part file is complete on its own: mark, notes and header lead each.
    """
    head = "﻿" + "".join(f"# {n}\r\n" for n in notes or []) + ";".join(df.columns)
    lines = csv_lines(df)

    def with_head(batches):
        first = True
        for batch in batches:
            if first and len(batch):
                batch = batch.copy()
                batch.iloc[0, 0] = head + "\r\n" + batch.iloc[0, 0]
                first = False
            yield batch

    lines.mapInPandas(with_head, "value string").write.mode("overwrite").option("lineSep", "\r\n").text(path)


def feature_lines(df: DataFrame, rings: str, columns: list[str], sources: list[str]) -> DataFrame:
    """One GeoJSON feature per row with the listed properties and the sources; shapes are clean polygons of any number of parts."""
    shape = F.transform(parts(F.col(rings)), lambda part: F.transform(part, lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"]))))
    geometry = F.when(F.col(rings).isNotNull(), F.struct(F.lit("MultiPolygon").alias("type"), shape.alias("coordinates")))
    feature = F.struct(
        F.lit("Feature").alias("type"), geometry.alias("geometry"),
        F.struct(*[F.col(c) for c in columns]).alias("properties"),
        F.array(*[F.lit(s) for s in sources]).alias("sources"),
    )
    return df.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def write_features(df: DataFrame, path: str, rings: str, columns: list[str], sources: list[str]) -> None:
    """Line-delimited features."""
    feature_lines(df, rings, columns, sources).write.mode("overwrite").text(path)


def split_by_license(df: DataFrame, own: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """The columns of our own and the share-alike rest, both with the key that joins them."""
    rest = [c for c in df.columns if c not in own and c != key]
    return df.select(key, *[c for c in own if c != key]), df.select(key, *rest)


def license_groups(tables: DataFrame, datasets: DataFrame) -> DataFrame:
    """A table is share-alike as soon as one of its sources is.

    ``tables`` has ``table_name, dataset_id``.
    """
    joined = tables.join(datasets.select("dataset_id", "share_alike"), "dataset_id", "left")
    return joined.groupBy("table_name").agg(F.coalesce(F.bool_or("share_alike"), F.lit(False)).alias("share_alike"))
