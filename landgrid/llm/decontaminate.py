"""Benchmark passages in documents: a prefix-filtered join with exact windows."""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landgrid.llm import words
from landgrid.llm.jaccard_join import RANK_BITS, bit_places, key_filter, rank_table
from landgrid.llm.rows import with_arrow
from landgrid.llm.shared import numbered, renamed, written
from landgrid.operators.skew import salted_join

WINDOW = 10
#: Words of the shingles that windows and documents are first joined on.
GRAM = 3
#: Most benchmark windows that are broadcast, about 150 bytes each; the prefixes of more are a table to join.
BROADCAST_WINDOWS = 500_000
_FIELDS = "n_words bigint, n_hit bigint, items array<string>"


def _words(data: np.ndarray, offsets: np.ndarray):
    hashes, _, _, at = words.word_hashes(data, offsets, words.ALNUM, words.LOWERED)
    return hashes, at


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, hash, length, grams) of each window; an item of fewer words is one window, without words none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, out = batch.column(0).to_pylist(), []
            for first, last, data, offsets in words.chunks(batch.column(1)):
                hashes, at = _words(data, offsets)
                for row in range(last - first):
                    own = hashes[at[row] : at[row + 1]]
                    size = min(window, len(own))
                    if not size:
                        continue
                    small = min(GRAM, size)
                    grams = words.windows(own, small).view(np.int64)
                    for k, h in enumerate(words.windows(own, size).view(np.int64)):
                        out.append((names[first + row], int(h), size, grams[k : k + size - small + 1].tolist()))
            yield pa.RecordBatch.from_pydict(
                {"item": pa.array([o[0] for o in out], pa.string()), "hash": pa.array([o[1] for o in out], pa.int64()),
                 "length": pa.array([o[2] for o in out], pa.int32()), "grams": pa.array([o[3] for o in out], pa.list_(pa.int64()))}
            )

    items = benchmark.select(F.coalesce(benchmark[id_col].cast("string"), F.lit("")).alias("item"), benchmark[text_col].cast("string").alias("text"))
    return items.mapInArrow(cut, "item string, hash bigint, length int, grams array<bigint>")


class Member:
    """Places of hashes in a sorted array of distinct ones, behind a table of bits."""

    def __init__(self, known: np.ndarray):
        self.known = known
        self.bits = max(16, min(24, int(len(known)).bit_length() + 6))
        self.table = np.zeros(1 << self.bits, bool)
        self.table[known >> np.uint64(64 - self.bits)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which hashes are known, their places)."""
        maybe = np.flatnonzero(self.table[hashes >> np.uint64(64 - self.bits)])
        if not len(maybe):
            return maybe, maybe
        place = np.minimum(np.searchsorted(self.known, hashes[maybe]), len(self.known) - 1)
        same = self.known[place] == hashes[maybe]
        return maybe[same], place[same]


class Windows:
    """Distinct windows with their items and shingles, as arrays."""

    def __init__(self, rows: list):
        self.names = sorted({r["item"] for r in rows})
        code = {n: k for k, n in enumerate(self.names)}
        by: dict[tuple[int, int], list] = {}
        for r in rows:
            by.setdefault((r["length"], r["hash"]), [r["grams"], set()])[1].add(code[r["item"]])
        keys = list(by)
        self.length = np.array([k[0] for k in keys], np.int64)
        self.hash = np.array([k[1] for k in keys], np.int64).view(np.uint64)
        self.items = [sorted(by[k][1]) for k in keys]
        self.grams = [by[k][0] for k in keys]
        self.sizes = sorted({min(GRAM, int(n)) for n in self.length})
        #: Distinct shingles by their number of words.
        self.known = {s: np.unique(np.array([g for n, gs in zip(self.length, self.grams, strict=True) if min(GRAM, n) == s for g in gs], np.int64).view(np.uint64)) for s in self.sizes}

    def take_rarest(self, counts: dict[int, np.ndarray]) -> None:
        """Keep, for each window, only its shingle that documents have least often: the prefix that a whole window must touch."""
        self.prefix = {}
        for s in self.sizes:
            picked = []
            for w, (n, gs) in enumerate(zip(self.length.tolist(), self.grams, strict=True)):
                if min(GRAM, n) == s:
                    own = np.array(gs, np.int64).view(np.uint64)
                    place = np.searchsorted(self.known[s], own)
                    best = min(range(len(own)), key=lambda k: (int(counts[s][place[k]]), int(own[k])))
                    picked.append((int(own[best]), w, best))
            picked.sort()
            grams = np.array([p[0] for p in picked], np.uint64)
            known, begins = np.unique(grams, return_index=True)
            self.prefix[s] = (known, np.append(begins, len(grams)), np.array([p[1] for p in picked], np.int64), np.array([p[2] for p in picked], np.int64))
        self.grams = self.known = None


def _gram_counts(texts: DataFrame, shared, sizes: list[int], lengths: dict[int, int]) -> dict[int, np.ndarray]:
    """How often the documents have each shingle of the windows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {s: (Member(k), np.zeros(len(k), np.int64)) for s, k in shared.value.known.items()}
        for batch in batches:
            for _, _, data, offsets in words.chunks(batch.column(0)):
                hashes, _ = _words(data, offsets)
                for s, (member, sums) in found.items():
                    _, place = member.find(words.windows(hashes, s))
                    if len(place):
                        sums += np.bincount(place, minlength=len(sums))
        for s, (_, sums) in found.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_pydict({"size": pa.array(np.full(len(at), s), pa.int32()), "place": pa.array(at, pa.int64()), "n": pa.array(sums[at], pa.int64())})

    out = {s: np.zeros(lengths[s], np.int64) for s in sizes}
    sums = texts.mapInArrow(count, "size int, place bigint, n bigint").groupBy("size", "place").agg(F.sum("n").alias("n"))
    for row in sums.toLocalIterator():  # as many rows as the broadcast windows have shingles
        out[row["size"]][row["place"]] = row["n"]
    return out


def _measure(found: SimpleNamespace, column: pa.Array, members: dict) -> list[pa.Array]:
    n_words, n_hit, items = [], [], []
    for first, last, data, offsets in words.chunks(column):
        hashes, at = _words(data, offsets)
        starts, ends, which = [], [], []
        for s, (_, begins, windows, places) in found.prefix.items():
            pos, place = members[s].find(words.windows(hashes, s))
            if not len(pos):
                continue
            many = begins[place + 1] - begins[place]
            flat = np.repeat(begins[place] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            window = windows[flat]
            start = np.repeat(pos, many) - places[flat]
            length = found.length[window]
            row = np.searchsorted(at, np.repeat(pos, many), side="right") - 1
            fits = (start >= at[row]) & (start + length <= at[row + 1])  # the window lies within its text
            start, length, window = start[fits], length[fits], window[fits]
            for size in np.unique(length):
                own = np.flatnonzero(length == size)
                total, factor = np.zeros(len(own), np.uint64), 1
                for k in range(int(size)):
                    factor = factor * words._BASE & ((1 << 64) - 1)
                    total += hashes[start[own] + k] * np.uint64(factor)
                same = words.mix(total + np.uint64(size)) == found.hash[window[own]]
                own = own[same]
                starts.append(start[own])
                ends.append(start[own] + length[own])
                which.append(window[own])
        covered = np.zeros(len(hashes) + 1, np.int64)
        rows: dict[int, set] = {}
        if starts:
            begin, end, window = np.concatenate(starts), np.concatenate(ends), np.concatenate(which)
            np.add.at(covered, begin, 1)
            np.add.at(covered, end, -1)
            pairs = np.unique(np.stack([np.searchsorted(at, begin, side="right") - 1, window]), axis=1)
            for row, w in pairs.T.tolist():
                rows.setdefault(row, set()).update(found.items[w])
        hit = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) > 0)])
        n_words.append(at[1:] - at[:-1])
        n_hit.append(hit[at[1:]] - hit[at[:-1]])
        items += [[found.names[k] for k in sorted(rows[r])] if r in rows else [] for r in range(last - first)]
    return [pa.array(np.concatenate(n_words), pa.int64()), pa.array(np.concatenate(n_hit), pa.int64()), pa.array(items, pa.list_(pa.string()))]


def _by_broadcast(docs: DataFrame, text_col: str, found: Windows) -> DataFrame:
    context = docs.sparkSession.sparkContext
    if not found.names:
        none = F.struct(F.lit(0).cast("bigint").alias("n_hit"), F.expr("cast(array() as array<string>)").alias("items"))
        counted = with_arrow(docs, text_col, lambda: _count_words, "n_words bigint")
        return counted.withColumn("_found", F.struct("_found.n_words", none["n_hit"].alias("n_hit"), none["items"].alias("items")))
    lengths = {s: len(k) for s, k in found.known.items()}
    texts = docs.select(docs[text_col].cast("string").alias("text"))
    found.take_rarest(_gram_counts(texts, context.broadcast(SimpleNamespace(known=found.known)), found.sizes, lengths))
    shared = context.broadcast(SimpleNamespace(**vars(found)))  # plain values, which any worker can read

    def add():
        own = shared.value
        members = {s: Member(p[0]) for s, p in own.prefix.items()}
        return lambda column: _measure(own, column, members)

    return with_arrow(docs, text_col, add, _FIELDS)


def _count_words(column: pa.Array) -> list[pa.Array]:
    return [pa.array(np.concatenate([np.diff(_words(data, offsets)[1]) for _, _, data, offsets in words.chunks(column)]), pa.int64())]


def _prefixes(windows: DataFrame, ranks) -> DataFrame:
    """(item, hash, length, gram, place): each window with its rarest shingle and where that stands."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = ranks.value
        for batch in batches:
            lengths, grams, places = batch.column(2).to_pylist(), [], []
            for length, own in zip(lengths, batch.column(3).to_pylist(), strict=True):
                own = np.array(own, np.int64).view(np.uint64)
                counts = tables[min(GRAM, length)][(own >> np.uint64(64 - RANK_BITS)).astype(np.int64)]
                best = int(np.lexsort((own, counts))[0])
                grams.append(int(own[best].view(np.int64)))
                places.append(best)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(grams, pa.int64()), pa.array(places, pa.int32())], names=["item", "hash", "length", "gram", "place"])

    return windows.mapInArrow(pick, "item string, hash bigint, length int, gram bigint, place int")


def _spots(texts: DataFrame, passing, sizes: list[int], longest: int) -> DataFrame:
    """Places of (row, text) whose shingle may be a prefix, with the words that a window around it can have."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = passing.value
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for first, _, data, offsets in words.chunks(batch.column(1)):
                hashes, at = _words(data, offsets)
                for size in sizes:
                    grams = words.windows(hashes, size)
                    pos = np.flatnonzero(np.logical_and.reduce([known[byte] & bit != 0 for byte, bit in bit_places(grams)]))
                    row = np.searchsorted(at, pos, side="right") - 1
                    fits = pos + size <= at[row + 1]
                    pos, row = pos[fits], row[fits]
                    low, high = np.maximum(at[row], pos - longest + size), np.minimum(at[row + 1], pos + longest)
                    begins = np.concatenate([[0], np.cumsum(high - low)])
                    flat = np.repeat(low - begins[:-1], high - low) + np.arange(begins[-1])
                    near = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(hashes[flat].view(np.int64)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rows[first + row]), pa.array(grams[pos].view(np.int64)), pa.array(pos - at[row]), pa.array(at[row + 1] - pos), near, pa.array((pos - low).astype(np.int32))],
                        names=["row", "gram", "before", "after", "near", "lead"],
                    )

    return texts.mapInArrow(find, "row bigint, gram bigint, before bigint, after bigint, near array<bigint>, lead int")


def _verified(met: DataFrame) -> DataFrame:
    """(row, start, length, hash) of the met windows all of whose words agree."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, start, length, hashed, first = (batch.column(k).to_numpy() for k in range(5))
            near = batch.column(5)
            values, begins = near.values.to_numpy().view(np.uint64), near.offsets.to_numpy()[:-1] + first
            same = np.zeros(len(row), bool)
            for size in np.unique(length):
                own = np.flatnonzero(length == size)
                total, factor = np.zeros(len(own), np.uint64), 1
                for k in range(int(size)):
                    factor = factor * words._BASE & ((1 << 64) - 1)
                    total += values[begins[own] + k] * np.uint64(factor)
                same[own] = words.mix(total + np.uint64(size)) == hashed[own].view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(row[same]), pa.array(start[same]), pa.array(length[same]), pa.array(hashed[same])], names=["row", "start", "length", "hash"])

    columns = met.select("row", (F.col("before") - F.col("place")).alias("start"), "length", "hash", (F.col("lead") - F.col("place")).alias("first"), "near")
    return columns.mapInArrow(compare, "row bigint, start bigint, length int, hash bigint")


def _by_join(docs: DataFrame, text_col: str, windows: DataFrame) -> DataFrame:
    """The same search for any number of windows: prefixes are a table that the documents' shingles join.

    Only tables of fixed size are broadcast: how often shingles are, and a filter of the prefixes,
    which leaves few other shingles of the documents to shuffle. Those carry the words around them,
    so the texts stay where they are.
    """
    context = docs.sparkSession.sparkContext
    lengths = [r[0] for r in windows.select("length").distinct().collect()]  # 1 to the window's length
    sizes = sorted({min(GRAM, n) for n in lengths})
    plain, names = numbered(docs)
    text = f"n{names.index(text_col)}"
    texts = plain.select(F.col(text).cast("string").alias("text"))
    prefixes = written(_prefixes(windows, context.broadcast({s: rank_table(texts, s, member=words.ALNUM) for s in sizes})))
    prefix = written(prefixes.select("hash", "length", "gram", "place").distinct())
    passing = context.broadcast(key_filter(prefix.select("gram")))
    kept = written(with_arrow(plain, text, lambda: _count_words, "n_words bigint").withColumn("row", F.monotonically_increasing_id()))
    spots = written(_spots(kept.select("row", F.col(text).cast("string")), passing, sizes, max(lengths, default=1)))
    met = salted_join(spots, prefix, ["gram"], spread=["row", "before"]).where("before >= place and after >= length - place")
    hits = written(_verified(met))
    seen = hits.select("row", "hash", "length").distinct()
    items = salted_join(seen, prefixes.select("item", "hash", "length").distinct(), ["hash", "length"], spread=["row"])
    items = items.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    so_far = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select("row", "start", (F.col("start") + F.col("length")).alias("end")).distinct()
    spans = spans.withColumn("from", F.greatest("start", F.coalesce(F.max("end").over(so_far), F.lit(0))))
    covered = spans.groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.col("from"))).alias("n_hit"))
    out = kept.join(items.join(covered, "row"), "row", "left")
    found = F.struct("_found.n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))
    return out.select(*[F.col(f"n{k}").alias(c) for k, c in enumerate(names) if c != "_found"], found.alias("_found"))


def marked(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
           window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """``docs`` with a struct ``_found``: n_words, n_hit (words inside a benchmark window) and items (sorted ids as text).

    Texts are lower-cased in A-Z; words are runs of digits, letters and characters beyond
    ASCII. A window is ``window`` words of an item, or a whole shorter one. The shingles of a
    window are ordered by how rare they are in all documents; documents meet it by its rarest
    shingle only, the place must leave room for the whole window, and then all its words are
    compared. Up to ``broadcast_windows`` windows are broadcast and each document is finished
    where it is read; beyond that the same steps run as joins of tables, with the same result.

    Null and empty texts have no words and no hits; an item without words has no window; a null
    item id counts as an empty text. Repeated documents are marked alike, repeated items count
    once. Empty tables give empty results or no hits. Other columns stay untouched.
    """
    windows = written(item_windows(benchmark, item_col, item_text_col, window))
    if windows.count() > broadcast_windows:
        return _by_join(docs, text_col, windows)
    return _by_broadcast(docs, text_col, Windows(windows.collect()))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any benchmark window, with all their columns unchanged; odd rows as in ``marked``."""
    plain, names = numbered(docs)
    options["text_col"] = f"n{names.index(options.get('text_col', 'text'))}"
    return renamed(marked(plain, benchmark, **options).where("_found.n_hit = 0"), names)
