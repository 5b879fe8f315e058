"""Self join of documents by the Jaccard similarity of their word shingles, through tries."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landgrid.llm import words
from landgrid.llm.components import components
from landgrid.llm.shared import numbered, renamed, shared_path, text_key, written
from landgrid.session import scratch

#: Entries of the table that ranks shingles by rarity: 2 to this power, four bytes each.
RANK_BITS = 21
#: Rare shingles that two sets must share to be compared; each costs every set one more entry.
SHARED = 3
_BLOCK = 1 << 12
#: Bits of the filter that picks out the documents to compare: 2 to this power.
FILTER_BITS = 26
#: Most sets and shingles of one trie.
TRIE_SETS, TRIE_SHINGLES = 256, 1_000_000
_RUN = 64


def _texts(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _gathered(rows: DataFrame, size: int, kind: type, fill, combine) -> np.ndarray:
    """An array of fixed ``size`` that every task fills for its rows, put together by ``combine``.

    Tasks send packed blocks of what they touched; blocks are put together in a stream, so
    neither a task nor the driver ever holds more than one such array.
    """
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size, kind)
        for batch in batches:
            fill(table, batch)
        blocks = [k for k in range(0, size, _BLOCK) if table[k : k + _BLOCK].any()]
        yield pa.RecordBatch.from_pydict(
            {"block": pa.array([k // _BLOCK for k in blocks], pa.int32()), "packed": pa.array([zlib.compress(table[k : k + _BLOCK].tobytes(), 1) for k in blocks], pa.binary())}
        )

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(zlib.decompress(packed), kind)
                sums[block] = combine(sums[block], own) if block in sums else own
        yield pa.RecordBatch.from_pydict(
            {"block": pa.array(list(sums), pa.int32()), "packed": pa.array([zlib.compress(v.tobytes(), 1) for v in sums.values()], pa.binary())}
        )

    schema = "block int, packed binary"
    table = np.zeros(size, kind)
    for row in rows.mapInArrow(part, schema).repartition("block").mapInArrow(whole, schema).collect():  # ``size`` numbers, whatever the input
        table[row["block"] * _BLOCK : (row["block"] + 1) * _BLOCK] = np.frombuffer(zlib.decompress(bytes(row["packed"])), kind)
    return table


def _added(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.minimum(x.astype(np.uint64) + y, 0xFFFFFFFF).astype(np.uint32)


def rank_table(docs: DataFrame, size: int, bits: int = RANK_BITS, member: np.ndarray = words.NOT_SPACE) -> np.ndarray:
    """How many shingles of all documents fall into each of 2**bits cells.

    The order (cell count, hash) is one and the same for all sets whatever the counts are,
    which is all that the join needs to be exact; good counts only make it faster.
    """
    def fill(table: np.ndarray, batch: pa.RecordBatch) -> None:
        for _, _, data, offsets in words.chunks(_texts(batch)):
            hashes, _, _, _ = words.word_hashes(data, offsets, member)
            np.add.at(table, (words.windows(hashes, size) >> np.uint64(64 - bits)).astype(np.int64), 1)

    return _gathered(docs.select("text"), 1 << bits, np.uint32, fill, _added)


def bit_places(keys: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Byte and bit of each key in the filter, twice."""
    out = []
    for shift in (0, 32):
        place = (keys >> np.uint64(shift)) & np.uint64((1 << FILTER_BITS) - 1)
        out.append(((place >> np.uint64(3)).astype(np.int64), np.left_shift(1, (place & np.uint64(7)).astype(np.uint8)).astype(np.uint8)))
    return out


def key_filter(keys: DataFrame) -> np.ndarray:
    """Bits that are set for every key (one bigint column); few others pass while the keys are fewer than the bits."""

    def fill(table: np.ndarray, batch: pa.RecordBatch) -> None:
        for byte, bit in bit_places(batch.column(0).to_numpy().view(np.uint64)):
            np.bitwise_or.at(table, byte, bit)

    return _gathered(keys, 1 << (FILTER_BITS - 3), np.uint8, fill, np.bitwise_or)


def _in_filter(spark: SparkSession, bits: np.ndarray):
    """Column function: whether a key may be one of those that the filter was made of."""
    passing = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def maybe(keys: pd.Series) -> pd.Series:
        known = passing.value
        places = bit_places(keys.to_numpy().view(np.uint64))
        return pd.Series(np.logical_and.reduce([known[byte] & bit != 0 for byte, bit in places]))

    return maybe


def _ordered(found: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """Distinct shingles, the rarest first."""
    found = np.unique(found)
    return found[np.argsort(table[(found >> np.uint64(64 - bits)).astype(np.int64)], kind="stable")]


def _need(a, b, share: tuple[int, int]):
    """Least intersection of linked sets of a and b elements."""
    top, whole = share
    return -(-top * (a + b) // (whole + top))


def _keys(docs: DataFrame, size: int, share: tuple[int, int], ranks, bits: int) -> DataFrame:
    """Per document: set size, 128 bits that stand for the set, and its rarest shingles that a linked set must touch."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks.value
        for batch in batches:
            sizes, marks, rare = [], [], []
            for found in words.shingles(_texts(batch), size):
                found = _ordered(found, table, bits)
                n = len(found)
                sizes.append(n)
                marks.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if n else None)
                rare.append(found[: n - (-(-share[0] * n // share[1])) + SHARED].view(np.int64) if n else found.view(np.int64))
            ends = np.concatenate([[0], np.cumsum([len(r) for r in rare])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rare) if rare else np.zeros(0, np.int64)))],
                names=["id", "n", "mark", "rare"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInArrow(prefixes, f"id {kind}, n bigint, mark binary, rare array<bigint>")


class Trie:
    """Ordered sets with shared beginnings; a node keeps a run of shingles and the sizes below it."""

    __slots__ = ("run", "next", "ends", "least", "most", "left")

    def __init__(self, run: np.ndarray):
        self.run, self.next, self.ends = run, {}, []
        self.least, self.most, self.left = None, 0, 0

    def add(self, member: np.ndarray, name) -> None:
        node, at, n = self, 0, len(member)
        node._count(n, n)
        while True:
            at += len(node.run)
            if at == n:
                node.ends.append((name, n))
                return
            child = node.next.get(int(member[at]))
            if child is None:
                child = node.next[int(member[at])] = Trie(member[at:])
                child._count(n, n - at)
                child.ends.append((name, n))
                return
            most = min(len(child.run), n - at)
            differ = np.flatnonzero(child.run[:most] != member[at : at + most])
            same = int(differ[0]) if len(differ) else most
            if same < len(child.run):
                upper = Trie(child.run[:same])
                upper.least, upper.most, upper.left = child.least, child.most, child.left
                child.left -= same
                child.run = child.run[same:]
                upper.next[int(child.run[0])] = child
                node.next[int(member[at])] = child = upper
            child._count(n, n - at)
            node = child

    def _count(self, n: int, left: int) -> None:
        self.least = n if self.least is None else min(self.least, n)
        self.most, self.left = max(self.most, n), max(self.left, left)

    def search(self, query: np.ndarray, share: tuple[int, int]) -> Iterator[tuple[object, int, int]]:
        """(name, size, intersection) of the members that link with ``query``, a sorted array.

        The overlap of a shared beginning is counted once. A branch is left as soon as its
        overlap and the most that can follow are under what its smallest set needs.
        """
        size = len(query)
        stack = [(child, 0) for child in self.next.values()]
        while stack:
            node, overlap = stack.pop()
            need = _need(size, max(node.least, -(-share[0] * size // share[1])), share)
            left, alive = node.left, overlap + min(node.left, size - overlap) >= need
            for at in range(0, len(node.run), _RUN):
                if not alive:
                    break
                part = node.run[at : at + _RUN]
                place = np.minimum(np.searchsorted(query, part), size - 1)
                overlap += int(np.count_nonzero(query[place] == part))
                left -= len(part)
                alive = overlap + left >= need
            if not alive:
                continue
            for name, n in node.ends:
                if overlap >= _need(size, n, share):
                    yield name, n, overlap
            stack.extend((child, overlap) for child in node.next.values())


def _links(pairs: DataFrame, texts: DataFrame, size: int, share: tuple[int, int], ranks, bits: int) -> DataFrame:
    """Those of the pairs (a, b, n_b) of sets that link, as (u, v).

    The partners of one set are cut into salted groups of bounded size; a group builds a trie
    of its partners and searches it with the set's own shingles.
    """
    loads = written(pairs.groupBy("a").agg(
        F.greatest(F.ceil(F.count("*") / TRIE_SETS), F.ceil(F.sum("n_b") / TRIE_SHINGLES)).cast("int").alias("salts")
    ))
    partners = pairs.join(loads, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.col("b").alias("set"))
    owners = loads.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("a").alias("set"))
    rows = written(partners.unionByName(owners)).join(texts, "set").withColumn("role", (F.col("a") != F.col("set")).cast("int"))
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "role").select("a", "salt", "set", "text")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, group, own, trie = ranks.value, None, None, None

        def found() -> list[tuple[int, int]]:
            return [(group[0], name) for name, _, _ in trie.search(own, share)] if trie is not None and own is not None else []

        def batch_of(out: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"u": pa.array([x[0] for x in out], pa.int64()), "v": pa.array([x[1] for x in out], pa.int64())})

        for batch in batches:
            out = []
            sets, salts, names = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for key, name, shingle in zip(zip(sets, salts, strict=True), names, words.shingles(_texts(batch), size), strict=True):
                if key != group:
                    out += found()
                    group, own, trie = key, None, Trie(np.zeros(0, np.uint64))
                if name == key[0]:
                    own = np.unique(shingle)
                else:
                    trie.add(_ordered(shingle, table, bits)[::-1], name)
            yield batch_of(out)
        yield batch_of(found())

    return rows.mapInArrow(match, "u bigint, v bigint")


def _shared(x: str, y: str, share: tuple[int, int]) -> str:
    """SQL: the rare shingles that linked sets of x and y elements have in common at least."""
    top, whole = share
    return f"least({SHARED}, ceil({top} * ({x} + {y}) / {whole + top}D))"


def _fits(x: str, y: str, share: tuple[int, int]) -> str:
    """SQL: the sizes allow a link, and so do the places of a shingle that is among the first ``SHARED`` common ones.

    Before it lie fewer than ``SHARED`` common shingles, and no more than either set has there.
    """
    top, whole = share
    return (
        f"{whole} * {x}.n >= {top} * {y}.n and {whole} * {y}.n >= {top} * {x}.n and "
        f"least({SHARED - 1}, {x}.pos, {y}.pos) + least({x}.n - {x}.pos, {y}.n - {y}.pos) >= ceil({top} * ({x}.n + {y}.n) / {whole + top}D)"
    )


def _links_at_all(share: tuple[int, int]) -> str:
    """SQL: a set of n elements may link with another one, at best with one that has a single element more."""
    top, whole = share
    return f"n * {whole - top} >= {top}"


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3,
                       share: tuple[int, int] = (90, 100), rank_bits: int = RANK_BITS) -> DataFrame:
    """Components of documents whose shingle sets link: ``share[1]`` * intersection >= ``share[0]`` * union.

    Returns ``id_col``, ``n_shingles`` and ``component_id`` for every row, the least id that
    links reach. Documents with equal sets are one class, found by a grouping that is
    pre-aggregated, so copies are never paired. Classes meet by the rarest shingles that a
    linked pair must share; each is first compared with the one pivot of its meeting places
    that it shares most with. What that joins needs no further pairs: only classes of different
    components that share enough rare shingles, at places that leave room for a link, are
    compared, those outside a shingle's largest component with the rest. The result is that of
    comparing all pairs. Comparisons run in tries of bounded size.

    Null or empty texts and texts without words have no shingle and are their own component.
    Repeated rows stay, each with the same answer; rows with a null id take part and get the
    least known id of their component, or null. Other columns are ignored. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    source = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    path = shared_path(spark, "components")
    with scratch(spark):  # the tables in between go when the answer is written
        _components(source, size, share, rank_bits).write.parquet(path)
    answer = spark.read.parquet(path)
    return answer.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _components(source: DataFrame, size: int, share: tuple[int, int], rank_bits: int) -> DataFrame:
    """(id, n, component_id) of every row of (id, text)."""
    spark = source.sparkSession
    table = rank_table(source, size, rank_bits)
    ranks = spark.sparkContext.broadcast(table)  # 4 * 2**rank_bits bytes
    # Rare shingles are most of the data: only those of the classes are stored, for one more reading of the texts.
    found = _keys(source, size, share, ranks, rank_bits)
    keys = written(found.select("id", "n", "mark"))
    classes = written(
        found.where("n > 0").groupBy("mark").agg(F.min("id").alias("id"), F.max("n").cast("int").alias("n"), F.first("rare").alias("rare"))
        .withColumn("set", F.monotonically_increasing_id())
    )
    places = classes.where(_links_at_all(share)).select(F.posexplode("rare").alias("pos", "token"), "set", "n")
    # The pivot of a shingle is a set that has few rarer ones, so the plainest of near copies.
    tokens = written(places.groupBy("token").agg(F.count("*").alias("sets"), F.min(F.struct("pos", "set")).alias("p")).where("sets > 1").select("token", F.col("p.set").alias("pivot")))
    met = written(places.join(tokens, "token"))

    # One pivot a set: that with which it shares most. What this leaves apart is compared below.
    first = (
        met.where("set <> pivot").groupBy("set", "pivot").agg(F.count("*").alias("shared"), F.max("n").alias("n"))
        .where(f"shared >= {_shared('n', f'n * {share[0]} / {share[1]}D', share)}")
        .groupBy("set").agg(F.max_by("pivot", F.struct("shared", -F.col("pivot"))).alias("a"), F.max("n").alias("n_b"))
        .select("a", F.col("set").alias("b"), "n_b")
    )
    first = written(first)
    links = _links(first, _own_texts(source, classes, first, size, ranks, rank_bits), size, share, ranks, rank_bits)
    label = components(written(links))

    # Planned together with what follows, so that the links' shuffle serves both.
    held = met.select("token", "set", "n", "pos").join(label, met["set"] == label["node"], "left").select("token", "set", "n", "pos", F.coalesce("label", "set").alias("label"))
    mixed = (
        held.groupBy("token", "label").agg(F.count("*").alias("sets"))
        .groupBy("token").agg(F.count("*").alias("labels"), F.max_by("label", F.struct("sets", "label")).alias("main")).where("labels > 1").select("token", "main")
    )
    rest = written(held.join(mixed, "token"))
    x, y = rest.where("label <> main").alias("x"), rest.alias("y")
    second = (
        x.join(y, F.expr(f"x.token = y.token and x.label <> y.label and (y.label = y.main or x.set < y.set) and {_fits('x', 'y', share)}"))
        .groupBy(F.greatest("x.set", "y.set").alias("a"), F.least("x.set", "y.set").alias("b"))
        .agg(F.count("*").alias("shared"), F.max(F.when(F.col("x.set") > F.col("y.set"), F.col("x.n")).otherwise(F.col("y.n"))).alias("n_a"),
             F.max(F.when(F.col("x.set") < F.col("y.set"), F.col("x.n")).otherwise(F.col("y.n"))).alias("n_b"))
        .where(f"shared >= {_shared('n_a', 'n_b', share)}")
    )
    tried = first.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    second = written(second.join(tried, ["a", "b"], "left_anti").select("a", "b", "n_b"))
    if second.take(1):
        more = _links(second, _own_texts(source, classes, second, size, ranks, rank_bits), size, share, ranks, rank_bits)
        label = components(label.select(F.col("node").alias("u"), F.col("label").alias("v")).unionByName(more))

    known = classes.select("mark", "id", "set").join(label, classes["set"] == label["node"], "left").select("mark", "id", F.coalesce("label", "set").alias("label"))
    known = written(known)
    heads = written(known.groupBy("label").agg(F.min("id").alias("component_id")))
    of_mark = written(known.join(heads, "label").select("mark", "component_id"))
    return (
        keys.select("id", "n", "mark").join(of_mark, "mark", "left")
        .select("id", "n", F.when(F.col("mark").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component: that with the least id, of equal ids the one whose text has the least MD5.

    Every row is a document of its own, whatever its id: rows that share an id but not the text
    are compared like others, and so are rows without an id, which come after all ids. Rows that
    agree in id and text are one document, kept as one of them by a hash of all columns. Null and
    empty texts have no shingles and are linked with nothing; very long ones are read whole.
    Columns pass unchanged, under any names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    plain, names = numbered(docs)
    id_at, text_at = (f"n{names.index(c)}" for c in (id_col, text_col))
    of_row = F.struct(F.col(id_at).isNull().alias("none"), F.col(id_at).alias("id"), text_key(F.col(text_at).cast("string")).alias("key"))
    keyed = plain.withColumn("_one", of_row)
    found = jaccard_components(keyed, "_one", text_at, **options)
    rows = found.groupBy("_one").agg(F.count("*").alias("rows"), F.min("component_id").alias("component_id"))
    doubt = written(rows.where("rows > 1 or _one <> component_id").select("_one", F.expr("_one <> component_id").alias("out")))
    doubtful = _in_filter(spark, key_filter(doubt.select(F.xxhash64("_one").alias("key"))))
    # Rows outside the filter are the only ones of their component or stand for it; they stay without a shuffle of their texts.
    marked = keyed.withColumn("_doubt", doubtful(F.xxhash64("_one")))
    own = marked.where("_doubt").join(doubt.where("out").select("_one"), "_one", "left_anti")
    hashed = F.xxhash64(*[c for c, kind in plain.dtypes if "map<" not in kind and "variant" not in kind])
    one = own.groupBy("_one").agg(F.min_by(F.struct(*plain.columns), hashed).alias("_row")).select("_row.*")
    one = marked.where("not _doubt").select(*plain.columns).unionByName(one)
    return renamed(one, names)


def _own_texts(source: DataFrame, classes: DataFrame, pairs: DataFrame, size: int, ranks, bits: int) -> DataFrame:
    """(set, text) of every set of the pairs, one row each.

    A filter of fixed size over the ids' hashes tells, where documents are read, which ones may
    be needed, so that only their texts are shuffled. An id may be null or name several texts;
    what counts is that the text's own set has the class's mark.
    """
    needed = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct()
    needed = written(classes.select("set", "mark", F.xxhash64("id").alias("key")).join(needed, F.col("set") == F.col("a"), "left_semi"))
    passing = source.sparkSession.sparkContext.broadcast(key_filter(needed.select("key")))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = ranks.value, passing.value
        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            maybe = np.logical_and.reduce([known[byte] & bit != 0 for byte, bit in bit_places(keys)])
            texts = batch.column(1).filter(pa.array(maybe))
            marks = [hashlib.blake2b(_ordered(s, table, bits).tobytes(), digest_size=16).digest() for s in words.shingles(texts, size)]
            yield pa.RecordBatch.from_arrays([pa.array(marks, pa.binary()), texts.cast(pa.string())], names=["mark", "text"])

    found = source.select(F.xxhash64("id").alias("key"), "text").mapInArrow(own, "mark binary, text string")
    return written(found.join(needed.select("set", "mark"), "mark").select("set", "text").dropDuplicates(["set"]))
