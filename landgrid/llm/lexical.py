"""Ranked lexical search over an index whose strata are documents of one length normaliser."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landgrid.llm import words
from landgrid.llm.shared import written

#: Share of the length in the normaliser, in hundredths.
LENGTH_SHARE = 75
#: Terms of items that are searched in one pass; more items are searched in further passes.
ITEM_TERMS = 1_000_000
#: Postings whose strata are held at once by a task; more come in the next turn.
POSTINGS = 2_000_000
_EXACT = 1 << 53


def _member(data: np.ndarray) -> np.ndarray:
    return words.ALNUM[data]


def _term_counts(texts: pa.Array, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms with repeats of each text; then text, term and occurrences of each pair, in order.

    A term is a 64-bit hash or, with ``known`` (sorted hashes), its place there; others are left out.
    """
    n = np.zeros(len(texts), np.int64)
    rows, terms, times = [], [], []
    for first, data, offsets in words.pieces(texts, _member):
        hashes, _, _, at = words.word_hashes(data, offsets, words.ALNUM)
        counts = np.diff(at)
        n[first : first + len(counts)] += counts
        row = np.repeat(np.arange(first, first + len(counts)), counts)
        if known is not None:
            place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            hit = known[place] == hashes
            row, hashes = row[hit], place[hit].astype(np.uint64)
        order = np.lexsort((hashes, row))
        row, hashes = row[order], hashes[order]
        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])])) if len(row) else np.zeros(0, np.int64)
        rows.append(row[new])
        terms.append(hashes[new])
        times.append(np.diff(np.append(new, len(row))))
    if not rows:
        return n, np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    row, term, time = np.concatenate(rows), np.concatenate(terms), np.concatenate(times)
    if (row[1:] < row[:-1]).any() or ((row[1:] == row[:-1]) & (term[1:] <= term[:-1])).any():  # a text came in pieces
        order = np.lexsort((term, row))
        row, term, time = row[order], term[order], time[order]
        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (term[1:] != term[:-1])]))
        row, term, time = row[new], term[new], np.add.reduceat(time, new)
    return n, row, term, time


def _lists(row: np.ndarray, values: np.ndarray, rows: int, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)), pa.array(values, kind))


def _item_terms(items: DataFrame) -> DataFrame:
    """(item, id, terms, times) of every row of (id, text) with a term: its number, and its distinct terms as hashes."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, row, term, times = _term_counts(batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), _lists(row, term.view(np.int64), batch.num_rows, pa.int64()), _lists(row, times, batch.num_rows, pa.int64())],
                names=["item", "id", "terms", "times"],
            )

    kind = items.schema["id"].dataType.simpleString()
    numbered = items.select(F.monotonically_increasing_id().alias("item"), "id", "text")
    return written(numbered.mapInArrow(split, f"item bigint, id {kind}, terms array<bigint>, times array<bigint>").where("size(terms) > 0"))


def _documents(source: DataFrame, known) -> DataFrame:
    """(row, id, n, terms, tfs) of every row of (id, text) with a term; of the terms only those of the items, as their places."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = known.value
        for batch in batches:
            n, row, term, times = _term_counts(batch.column(1), terms)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), _lists(row, term, batch.num_rows, pa.int32()), _lists(row, times, batch.num_rows, pa.int64())],
                names=["id", "n", "terms", "tfs"],
            )

    kind = source.schema["id"].dataType.simpleString()
    counted = source.mapInArrow(count, f"id {kind}, n bigint, terms array<int>, tfs array<bigint>").where("n > 0")
    return written(counted.select(F.monotonically_increasing_id().alias("row"), "*"))


class Stratum:
    """Documents of one normaliser, sorted by id, with their postings by term and, for each term, by occurrences."""

    def __init__(self, m: int, terms: np.ndarray, tfs: np.ndarray, sizes: np.ndarray, ids: pa.Array):
        self.ids = ids
        doc = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((tfs, terms))
        terms, tfs, self.doc = terms[order], tfs[order], doc[order]
        # What one occurrence count adds is the same for all documents here: it is computed once.
        counts, place = np.unique(tfs, return_inverse=True)
        self.impact = (1_000_000_000 * counts // (1000 * counts + 8 * m))[place]
        self.terms, self.at = np.unique(terms, return_index=True)
        self.at = np.append(self.at, len(terms))
        self.best = self.impact[self.at[1:] - 1] if len(self.terms) else self.impact

    def places(self, terms: np.ndarray) -> np.ndarray:
        """Where each term stands in this stratum, -1 if nowhere."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        place = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[place] == terms, place, -1)

    def scores(self, places: np.ndarray, weights: np.ndarray, bound: int) -> np.ndarray:
        """The score of every document for the terms at ``places``."""
        parts = [slice(self.at[p], self.at[p + 1]) for p in places]
        doc = np.concatenate([self.doc[p] for p in parts])
        adds = np.concatenate([self.impact[p] * w for p, w in zip(parts, weights, strict=True)])
        if bound < _EXACT:
            return np.bincount(doc, adds, len(self.ids)).astype(np.int64)
        total = np.zeros(len(self.ids), np.int64)
        np.add.at(total, doc, adds)
        return total


class Search:
    """The best ``k`` documents so far of every item of a pass."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int):
        self.starts, self.terms, self.weights, self.k = starts, terms, weights, k
        self.best: list[list[tuple[int, bool, object]]] = [[] for _ in starts[:-1]]
        self.visits = 0

    def visit(self, strata: list[Stratum]) -> None:
        """Every item goes to the strata in the order of their bounds, until none can change its best documents."""
        places = [s.places(self.terms) for s in strata]
        adds = [self.weights * np.where(p >= 0, s.best[p] if len(s.best) else 0, 0) for s, p in zip(strata, places, strict=True)]
        bounds = np.array([np.add.reduceat(a, self.starts[:-1]) for a in adds]).reshape(len(strata), -1)
        for item in range(len(self.best)):
            mine = slice(self.starts[item], self.starts[item + 1])
            for at in np.argsort(-bounds[:, item], kind="stable"):
                bound, best = int(bounds[at, item]), self.best[item]
                if bound <= 0 or (len(best) == self.k and bound < -best[-1][0]):
                    break
                own, stratum = places[at][mine], strata[at]
                scores = stratum.scores(own[own >= 0], self.weights[mine][own >= 0], bound)
                self.visits += 1
                few = np.flatnonzero(scores >= max(1, -best[-1][0] if len(best) == self.k else 1))
                if len(few) > self.k:  # documents are in the order of their ids, so equal scores stay in it
                    least = np.partition(scores[few], -self.k)[-self.k]
                    few = few[scores[few] >= least]
                few = few[np.argsort(-scores[few], kind="stable")][: self.k]
                found = zip((-scores[few]).tolist(), stratum.ids.take(pa.array(few)).to_pylist(), strict=True)
                self.best[item] = sorted([*best, *((s, i is None, i) for s, i in found)], key=lambda x: (x[0], x[1], x[2] if x[2] is not None else 0))[: self.k]


def _best_of_partition(batches: Iterator[pa.RecordBatch], search: Search, postings: int) -> None:
    """Cuts rows sorted by (m, id) into strata and visits them, a bounded number of postings at a time."""
    held: list[pa.RecordBatch] = []
    size = 0

    def visit() -> None:
        table = pa.Table.from_batches(held).combine_chunks()
        m = table.column("m").to_numpy()
        lists = table.column("terms").combine_chunks(), table.column("tfs").combine_chunks()
        lists = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in lists]
        terms, tfs = (x.flatten().to_numpy() for x in lists)
        sizes = np.diff(lists[0].offsets.to_numpy())
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = table.column("id").combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        borders = np.concatenate([[0], np.flatnonzero(m[1:] != m[:-1]) + 1, [len(m)]])
        search.visit([
            Stratum(int(m[a]), terms[ends[a] : ends[b]], tfs[ends[a] : ends[b]], sizes[a:b], ids[a:b])
            for a, b in zip(borders[:-1], borders[1:], strict=True)
        ])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += len(batch.column("terms").flatten())
        if size >= postings:
            visit()
            held, size = [], 0
    if held:
        visit()


def ranked(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
           k: int = 10, item_terms: int = ITEM_TERMS, postings: int = POSTINGS) -> DataFrame:
    """(``item_col``, rank, ``id_col``, score): the ``k`` best documents with a score above 0 of every item, by all of its terms.

    A term is a run of digits, letters a-z (A-Z become those) and code points beyond ASCII.
    With N documents that have a term, L terms in all of them, n in a document, and df
    documents with a given term, the term weighs w = floor(1000 ln((2N + 2) / (2df + 1))), a
    document's normaliser is m = 100 - 75 + (75nN div L), and tf occurrences add
    w (10^9 tf div (1000 tf + 8m)), for each time the item has the term.

    Documents are range-partitioned by m and a row number, so that a normaliser which many
    documents have is spread over tasks. A task holds the strata of a bounded number of
    postings, each with impacts computed once per occurrence count; an item visits them in the
    order of their bounds and stops when none can reach its ``k`` best. Items are searched in
    passes of about ``item_terms`` terms, which is what the driver and a broadcast hold. Terms
    are compared by 64-bit hashes.

    Equal scores rank by ascending id, null ids last. Null texts and texts without terms count
    nowhere and rank nowhere; items without terms have no rows. Repeated documents count and
    rank each; repeated items are ranked each. Very long texts are read in pieces. Empty tables
    give an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    source = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).where("text is not null")
    wanted = _item_terms(items.select(items[item_col].alias("id"), items[item_text_col].cast("string").alias("text")))
    passes = max(1, math.ceil((wanted.agg(F.sum(F.size("terms"))).first()[0] or 0) / item_terms))
    out = None
    for number in range(passes):
        own = wanted.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == number).select("item", "terms", "times").collect()  # about item_terms terms
        found = _one_pass(spark, source, own, k, postings)
        out = found if out is None else out.unionByName(found)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    best = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(wanted.select("item", F.col("id").alias("item_id")), "item").select(
        F.col("item_id").alias(item_col), "rank", F.col("id").alias(id_col), "score"
    )


def _one_pass(spark, source: DataFrame, own: list, k: int, postings: int) -> DataFrame:
    """(item, id, score): the best documents of each item in each task."""
    kind = source.schema["id"].dataType.simpleString()
    hashes = [np.array(row["terms"], np.int64).view(np.uint64) for row in own]
    known = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
    if not len(known):
        return spark.createDataFrame([], f"item bigint, id {kind}, score bigint")
    counted = _documents(source, spark.sparkContext.broadcast(known))  # 8 bytes a term
    total, length = counted.agg(F.count("*"), F.sum("n")).first()
    if not total:
        return spark.createDataFrame([], f"item bigint, id {kind}, score bigint")
    df = np.zeros(len(known), np.int64)
    for row in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row per term of the items
        df[row["term"]] = row["count"]
    w = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    starts = np.concatenate([[0], np.cumsum([len(h) for h in hashes])])
    terms = np.searchsorted(known, np.concatenate(hashes))
    weights = w[terms] * np.concatenate([np.array(row["times"], np.int64) for row in own])
    plan = spark.sparkContext.broadcast((np.array([row["item"] for row in own], np.int64), starts, terms, weights))  # 16 bytes a term

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, *entries = plan.value
        search = Search(*entries, k)
        _best_of_partition(batches, search, postings)
        rows = [(int(names[at]), i, -s) for at, found in enumerate(search.best) for s, _, i in found]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], id_type), pa.array([r[2] for r in rows], pa.int64())], names=["item", "id", "score"]
        )

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(source.schema["id"].dataType)
    normaliser = F.expr(f"{100 - LENGTH_SHARE} + (cast(n as decimal(19,0)) * cast({LENGTH_SHARE * total} as decimal(19,0))) div {length}")
    index = counted.where("size(terms) > 0").select("row", "id", normaliser.alias("m"), "terms", "tfs")
    index = index.repartitionByRange("m", "row").sortWithinPartitions("m", F.asc_nulls_last("id")).select("id", "m", "terms", "tfs")
    return index.mapInArrow(best, f"item bigint, id {kind}, score bigint")
