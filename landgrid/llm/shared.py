"""Helpers of several operators: shared tables, safe column names, Arrow schemas."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landgrid.session import cut_lineage, ensure_checkpoint_dir


def shared_path(spark: SparkSession, what: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder; its rows survive lost executors."""
    return cut_lineage(df)


def named(df: DataFrame, **columns: str) -> DataFrame:
    """Only the given columns under new names, so that no other column can clash."""
    return df.select(*[df[source].alias(target) for target, source in columns.items()])


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def text_key(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def numbered(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with its columns under numbers (n0, n1, ...), so that none can clash, and their names."""
    return docs.select(*[F.col(f"`{c}`").alias(f"n{k}") for k, c in enumerate(docs.columns)]), docs.columns


def renamed(rows: DataFrame, names: list[str]) -> DataFrame:
    """The columns of ``numbered`` under their names again."""
    return rows.select(*[F.col(f"n{k}").alias(c) for k, c in enumerate(names)])
