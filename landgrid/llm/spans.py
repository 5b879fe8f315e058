"""Digest columns of spans, as the queries return them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest_columns(spans: Column, kinds: list[str]) -> list[Column]:
    """A count for each base kind, the hash of the base spans, and all spans."""

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter(spans, lambda s: s["kind"].isin(kinds))
    counts = [count(k) for k in kinds]
    return [*counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans")]
