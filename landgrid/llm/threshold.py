"""Exact nearest vectors by inner product, with the threshold algorithm over sorted lists of every dimension."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landgrid.llm.shared import written

SCALE = 256
#: Numbers of the vectors that one task sorts into lists, and queries that it reads them for.
SHARD_NUMBERS, BLOCK_QUERIES = 1 << 20, 1 << 10
#: Part of a list that is read first; each further step doubles what has been read.
_FIRST = 64
_LONG = 1 << 63


class Lists:
    """Vectors with, for each dimension, their order by that component."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.vectors, self.ids, self.rows = vectors[order], ids[order], rows[order]
        self.order = np.argsort(self.vectors, axis=0, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(self.vectors, self.order, axis=0)
        self.most = max((abs(int(x)) for x in (vectors.max(), vectors.min())), default=0) if vectors.size else 0
        self.copies: dict[type, np.ndarray] = {}

    def _as(self, kind: type) -> np.ndarray:
        if kind not in self.copies:
            self.copies[kind] = self.vectors.astype(kind)
        return self.copies[kind]

    def best(self, query: np.ndarray, row: int, k: int) -> tuple[list[tuple[int, int]], int]:
        """(id, score) of the ``k`` best vectors but the one of ``row``, ties to the smaller id; and how deep the lists were read.

        Lists of positive weights are read from their end, those of negative ones from their
        beginning. No vector that was not met can score more than the weighted sum of the next
        entries; reading stops once that is below the k-th score.
        """
        n, d = self.vectors.shape
        most = self.most * (max(abs(int(query.max())), abs(int(query.min()))) if d else 0) * d
        kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object  # sums that the type holds exactly
        vectors, weights = self._as(kind), query.astype(kind)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        unmet = self.rows != row
        wide = object if kind is object else np.int64
        places, scores, read = np.zeros(0, np.int64), np.zeros(0, wide), 0
        while True:
            depth = min(n, 2 * read or max(k, n // _FIRST))
            new = np.zeros(n, bool)
            new[self.order[n - depth : n - read, up]] = True
            new[self.order[read:depth, down]] = True
            if depth == n:
                new[:] = True  # also what no list of a weight tells apart
            new &= unmet
            unmet &= ~new
            fresh = np.flatnonzero(new)
            found = (vectors @ weights)[fresh] if 2 * len(fresh) > n and kind is not object else vectors[fresh] @ weights
            places, scores = np.concatenate([places, fresh]), np.concatenate([scores, found.astype(wide)])
            order = np.lexsort((places, -scores)) if kind is not object else np.array(sorted(range(len(scores)), key=lambda j: (-scores[j], places[j])), np.int64)
            places, scores, read = places[order[:k]], scores[order[:k]], depth
            if read == n or not unmet.any():
                break
            bound = int(self.values[n - read - 1, up].astype(wide) @ query[up].astype(wide)) + int(self.values[read, down].astype(wide) @ query[down].astype(wide))
            if len(scores) == k and int(scores[-1]) > bound:
                break
        return [(int(self.ids[p]), int(s)) for p, s in zip(places, scores, strict=True)], read


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows, -1)


def exact_top_k(table: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: int = SCALE,
                shard_numbers: int = SHARD_NUMBERS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, ``id_col``, score): the ``k`` rows of largest inner product for every row for which ``queries`` holds.

    Components become floor(``scale`` * x). Every other row of the table with a vector of the
    same length is a candidate, ties go to the smaller id. Candidates are dealt into shards
    of about ``shard_numbers`` numbers and queries into blocks of about ``block_queries``; a
    task sorts one shard into a list per dimension and runs the threshold algorithm for the
    queries of one block, which come as a stream. The best ``k`` of each shard are ranked again
    for every query, so results are those of comparing with all rows.

    Null vectors, vectors with null or non-finite components, and rows without an id take no
    part. Repeated rows are candidates and queries each. Vectors without components and zero
    vectors score 0. Scores beyond 64 bits are cut to the largest or least long. An empty
    table gives an empty result; other columns are ignored.
    """
    value = table[vector_col]
    sound = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(value, lambda x: F.floor(x.cast("double") * scale))
    chosen = table.where(value.isNotNull() & sound & table[id_col].isNotNull()).select(
        F.monotonically_increasing_id().alias("row"), table[id_col].cast("bigint").alias("id"), whole.alias("v"), F.coalesce(queries, F.lit(False)).alias("asked")
    )
    chosen = written(chosen)
    numbers, rows, asked = chosen.agg(F.sum(F.size("v")), F.count("*"), F.count_if("asked")).first()
    shards, blocks = max(1, math.ceil((numbers or 0) / shard_numbers)), max(1, math.ceil(asked / block_queries))

    def dealt(count: int, seed: int) -> Column:
        return F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(count)).cast("int")

    def each(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    fields = ["row", "id", "v"]
    candidates = chosen.select(F.size("v").alias("size"), dealt(shards, 1).alias("shard"), each(blocks).alias("block"), F.lit(0).alias("role"), *fields)
    askers = chosen.where("asked").select(F.size("v").alias("size"), each(shards).alias("shard"), dealt(blocks, 2).alias("block"), F.lit(1).alias("role"), *fields)
    groups = candidates.unionByName(askers).repartition("size", "shard", "block").sortWithinPartitions("size", "shard", "block", "role")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, lists = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in range(4)], axis=1)
            borders = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]]) if len(keys) else [0]
            out: list[tuple[int, int, int, int]] = []
            for a, b in zip(borders[:-1], borders[1:], strict=True):
                part, key = batch.slice(a, b - a), tuple(keys[a, :3].tolist())
                if key != group:
                    group, held, lists = key, [], None
                own = _matrix(part.column(6), b - a), part.column(5).to_numpy(), part.column(4).to_numpy()
                if keys[a, 3] == 0:
                    held.append(own)
                    continue
                if lists is None and held:
                    lists, held = Lists(*[np.concatenate(x) for x in zip(*held, strict=True)]), []
                if lists is not None:
                    for query, name, row in zip(*own, strict=True):
                        out += [(int(row), int(name), i, max(-_LONG, min(_LONG - 1, s))) for i, s in lists.best(query, int(row), k)[0]]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(4)], names=["row", "query_id", "id", "score"])

    found = groups.mapInArrow(search, "row bigint, query_id bigint, id bigint, score bigint")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
