"""Drop, redact and report personal data in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landgrid.functions import pii

# Layers where a name column holds place names, and audit columns.
PLACE_NAME_COLUMNS = [("R_VEREDA", "NOMBRE"), ("U_BARRIO", "NOMBRE"), ("U_PERIMETRO", "CODIGO_NOMBRE")]
AUDIT_COLUMNS = ["usuario_log"]


def classify_names(names: DataFrame, column: str = "name") -> DataFrame:
    """Rule and nearness of every column name of a table of names."""
    return names.withColumn("rule", pii.name_rule(F.col(column))).withColumn(
        "adjacent", pii.is_adjacent(F.col(column))
    )


def personal_columns(df: DataFrame) -> dict[str, str]:
    """Personal columns of a DataFrame and the rule of each; reads the schema only."""
    return {name: rule for name in df.columns if (rule := pii.name_rule_of(name)) is not None}


def sanitize(df: DataFrame, text_columns: list[str] | None = None) -> DataFrame:
    """Without personal columns, and with personal values replaced by a mark."""
    kept = df.drop(*personal_columns(df))
    wanted = text_columns or [f.name for f in kept.schema.fields if isinstance(f.dataType, T.StringType)]
    out = {}
    for name in wanted:
        if name in kept.columns:
            rule = pii.value_rule(F.col(name), F.lit(name))
            out[name] = F.coalesce(pii.redacted(rule), F.col(name))
    return kept.withColumns(out)


def discard_log(df: DataFrame, layer: str) -> DataFrame:
    """One row per dropped or redacted column with the rows concerned, in one pass."""
    dropped = personal_columns(df)
    texts = [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in dropped
    ]
    entries = [
        F.struct(F.lit(c).alias("column"), F.lit(rule).alias("rule"), F.lit("dropped").alias("action"))
        for c, rule in dropped.items()
    ] + [
        F.struct(
            F.lit(c).alias("column"), pii.value_rule(F.col(c), F.lit(c)).alias("rule"),
            F.lit("redacted").alias("action"),
        )
        for c in texts
    ]
    return (
        df.select(F.explode(F.array(*entries)).alias("e"))
        .select(F.lit(layer).alias("layer"), "e.*")
        .where("rule is not null")
        .groupBy("layer", "column", "rule", "action")
        .agg(F.count(F.lit(1)).alias("occurrences"))
    )


def discard_rollup(log: DataFrame, limit: int | None = None) -> DataFrame:
    """Discards by layer, column, rule and action, most frequent first; all of them, or the first ``limit``."""
    out = (
        log.groupBy("layer", "column", "rule", "action")
        .agg(F.sum("occurrences").alias("occurrences"), F.max("detected_at").alias("last_seen"))
        .orderBy(F.col("occurrences").desc(), "layer", "column", "rule", "action")
    )
    return out if limit is None else out.limit(limit)


def redact_rows(df: DataFrame, when_column: str, columns: list[str], values: list[str] | None = None, pattern: str | None = None) -> DataFrame:
    """Empty some columns in the rows where another column has a value or matches a pattern."""
    decider = F.col(when_column)
    hit = F.lit(False)
    if values:
        hit = hit | decider.isin(values)
    if pattern:
        hit = hit | decider.rlike(pattern)
    hit = F.coalesce(hit, F.lit(False))
    return df.withColumns({c: F.when(~hit, F.col(c)) for c in columns})


def scan_values(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Rows whose text holds personal data, with the rule."""
    rule = pii.value_rule(F.col(text))
    return df.select(*keys, rule.alias("rule")).where("rule is not null")


def text_lines(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per non-empty line of a text."""
    return df.select(*keys, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line")).where(F.trim("line") != "")


def key_census(df: DataFrame, json_column: str) -> DataFrame:
    """How often each key of a JSON object column occurs."""
    keys = F.explode(F.json_object_keys(F.col(json_column)))
    return df.select(keys.alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def leaked_keys(df: DataFrame, json_column: str) -> DataFrame:
    """Keys of a JSON column that carry a personal name."""
    return key_census(df, json_column).withColumn("rule", pii.name_rule(F.col("key"))).where("rule is not null")


def sample_values(df: DataFrame, column: str, limit: int = 200) -> DataFrame:
    """The first distinct values of a column; a sampling operator, so the limit is its point."""
    return df.select(F.col(column).alias("value")).where("value is not null").distinct().orderBy("value").limit(limit)


def sweep(layers: dict[str, DataFrame]) -> DataFrame:
    """Findings by column name and by content over staged layers.

    Every value of the text columns is scanned. Kinds: offending, exempt (a
    place name), audit, and content. One row per layer, column, kind and rule.
    """
    spark = next(iter(layers.values())).sparkSession
    names = [(layer, c) for layer, df in layers.items() for c in df.columns]
    exempt = F.lit(False)
    for layer, column in PLACE_NAME_COLUMNS:
        exempt = exempt | ((F.col("layer") == layer) & (F.upper("column") == column))
    audit = pii.category_key(F.col("column")).isin(AUDIT_COLUMNS)
    kind = F.when(exempt, "exempt").when(audit, "audit").otherwise("offending")
    by_name = (
        spark.createDataFrame(names, "layer string, column string")
        .withColumn("rule", pii.name_rule(F.col("column")))
        .where("rule is not null")
        .select("layer", "column", kind.alias("kind"), "rule", F.lit(0).cast("bigint").alias("values"))
    )
    out = by_name
    for layer, df in layers.items():
        texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
        if not texts:
            continue
        entries = [
            F.struct(F.lit(c).alias("column"), pii.value_rule(F.col(c), F.lit(c)).alias("rule")) for c in texts
        ]
        hits = (
            df.select(F.explode(F.array(*entries)).alias("e"))
            .where("e.rule is not null")
            .groupBy(F.col("e.column").alias("column"), F.col("e.rule").alias("rule"))
            .agg(F.count(F.lit(1)).alias("values"))
            .select(F.lit(layer).alias("layer"), "column", F.lit("content").alias("kind"), "rule", "values")
        )
        out = out.unionByName(hits)
    return out
