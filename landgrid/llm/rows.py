"""Passing whole rows through an Arrow function that adds columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def with_arrow(docs: DataFrame, column: str, add: Callable[[], Callable[[pa.Array], list[pa.Array]]], fields: str) -> DataFrame:
    """``docs`` with the ``fields`` (DDL) that ``add()`` makes of each batch of ``column``, as one struct ``_found``.

    The own columns travel under numbers, so that no name can clash; a column of ``docs``
    named ``_found`` is left out. ``add`` is called once a task.
    """
    own = [c for c in docs.columns if c != "_found"]
    at = own.index(column)
    new = T.StructType.fromDDL(fields) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(fields)
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(own)])
    names = [f"f{k}" for k in range(len(new))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = add()
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, *made(batch.column(at))], names=[*batch.schema.names, *names])

    out = plain.mapInArrow(run, T.StructType([*plain.schema.fields, *[T.StructField(n, f.dataType) for n, f in zip(names, new, strict=True)]]))
    found = F.struct(*[F.col(n).alias(f.name) for n, f in zip(names, new, strict=True)])
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(own)], found.alias("_found"))
