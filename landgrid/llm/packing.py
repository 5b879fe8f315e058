"""Packing documents into token sequences along a space-filling curve."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landgrid.llm import words
from landgrid.llm.rows import with_arrow
from landgrid.llm.shared import written

LENGTH = 2048
#: Directions that document vectors are projected on, and bits of each in the curve's key.
DIMS, BITS = 4, 12
#: Distinct pieces of text whose token ids a worker keeps, at most 50 bytes each.
KEPT_PIECES = 1_200_000
_SLOTS = 1 << 22

#: Byte classes: 0 white space, 1 letters of ASCII and Latin-1, 2 digits, 3 other ASCII, 4 all else.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[48:58] = 2
_CLASS[128:] = 4
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Tokens:
    """Token ids of texts, found per piece and remembered.

    The tokenizer lower-cases and never joins letters, digits and marks over their borders,
    nor anything over white space, so a text's ids are those of its pieces. Pieces end at white
    space and where letters, digits and marks meet; an apostrophe stays with what follows, and
    characters beyond Latin-1 with both neighbours. A piece of letters is one word to the
    tokenizer's model; all others go through the whole tokenizer. Texts that spell a special
    token are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        spelled = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {ord(c): spelled.pre_tokenize_str(c)[0][0] for c in map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)])}
        self._forget()

    def _forget(self) -> None:
        """An open table: hash, and where the ids of the piece begin and end."""
        self.slots, self.place = np.zeros(_SLOTS, np.uint64), np.zeros(_SLOTS, np.int32)
        self.ids, self.used = np.zeros(1 << 16, self.kind), 0
        self.begins, self.count = np.zeros(1 << 14, np.int64), 0

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of known pieces, -1 for the others."""
        out = np.full(len(hashes), -1, np.int64)
        left, slot = np.arange(len(hashes)), (hashes & np.uint64(_SLOTS - 1)).astype(np.int64)
        while len(left):
            there = self.slots[slot]
            same = there == hashes[left]
            out[left[same]] = self.place[slot[same]]
            on = ~same & (there != 0)
            left, slot = left[on], (slot[on] + 1) & (_SLOTS - 1)
        return out

    def _learn(self, hashes: np.ndarray, texts: list[tuple[str, bool]]) -> None:
        found: list[list[int]] = []
        for text, plain in texts:
            if plain:
                found.append([t.id for t in self.model.tokenize(text.translate(self.letters))])
            else:
                found.append(self.tokenizer.encode(text, add_special_tokens=False).ids)
        many = np.array([len(f) for f in found], np.int64)
        ids = np.array([i for f in found for i in f], self.kind)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.count + len(found) + 1 > len(self.begins):
            self.begins = np.concatenate([self.begins, np.zeros_like(self.begins)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.begins[self.count + 1 : self.count + 1 + len(found)] = self.used + np.cumsum(many)
        left, slot = np.arange(len(hashes)), (hashes & np.uint64(_SLOTS - 1)).astype(np.int64)
        while len(left):
            free = self.slots[slot] == 0
            self.slots[slot[free]] = hashes[left[free]]
            mine = free & (self.slots[slot] == hashes[left])
            self.place[slot[mine]] = self.count + left[mine]
            left, slot = left[~mine], (slot[~mine] + 1) & (_SLOTS - 1)
        self.used += len(ids)
        self.count += len(found)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the id offsets of the texts."""
        raw = data.tobytes()
        if any(s.encode() in raw for s in self.special):
            return self._whole(raw, offsets)
        kind = _CLASS[data]
        data = _LOWER[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        letter = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        kind[letter] = kind[letter + 1] = 1
        high = letter[(data[letter + 1] >= 0x80) & (data[letter + 1] <= 0x9E)]
        data[high + 1] += 0x20
        begins = np.empty(len(data), bool)
        if len(data):
            before, after = kind[:-1], kind[1:]
            begins[0] = True
            begins[1:] = (before == 0) | ((before != after) & (before != 4) & (after != 4) & (data[:-1] != 39))
            begins[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(begins & (kind != 0))
        if not len(starts):
            return np.zeros(0, self.kind), np.zeros(len(offsets), np.int64)
        # A piece ends where the next piece or white space begins.
        edges = np.append(np.flatnonzero(begins | (kind == 0)), len(data))
        stops = edges[np.searchsorted(edges, starts, side="right")]
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(words.EXACT[data] * words._power(words._BASE, len(data)), out=total[1:])
        hashes = (total[stops] - total[starts]) * words._power(words._BACK, len(data))[starts]
        hashes = words.mix(hashes + (stops - starts).astype(np.uint64) * words._STEP) | np.uint64(1)
        index = self._find(hashes)
        missing = np.flatnonzero(index < 0)
        if len(missing):
            new, first = np.unique(hashes[missing], return_index=True)
            first = missing[first]
            if len(new) > _SLOTS // 2:  # one text beyond the table
                return self._whole(data.tobytes(), offsets)
            if self.count + len(new) > KEPT_PIECES:
                self._forget()
                new, first = np.unique(hashes, return_index=True)
                missing = np.arange(len(hashes))
            raw = data.tobytes()
            begin, end = starts[first].tolist(), stops[first].tolist()
            self._learn(new, [(raw[b:e].decode("utf-8", "replace"), self._letters(kind, b, e)) for b, e in zip(begin, end, strict=True)])
            index[missing] = self._find(hashes[missing])
        begin = self.begins[index]
        many = self.begins[index + 1] - begin
        ends = np.cumsum(many)
        ids = self.ids[np.repeat(begin - (ends - many), many) + np.arange(ends[-1])]
        return ids, np.concatenate([[0], ends])[np.searchsorted(starts, offsets)]

    @staticmethod
    def _letters(kind: np.ndarray, begin: int, end: int) -> bool:
        return kind[begin] == 1 and kind[end - 1] == 1 and bool((kind[begin:end] == 1).all())

    def _whole(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.tokenizer.encode(raw[a:b].decode("utf-8", "replace"), add_special_tokens=False).ids for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return np.array([i for p in parts for i in p], self.kind), np.cumsum([0, *map(len, parts)])


_tokens: dict[str, Tokens] = {}


def _hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of whole-numbered points, one row each (Skilling's transform)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(set_, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def curve_keys(data: np.ndarray, offsets: np.ndarray, dims: int = DIMS, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of texts: each word's hash gives a sign on every axis, a text is the mean of its words."""
    hashes, _, _, at = words.word_hashes(data, offsets, words.ALNUM, words.LOWERED)
    points = np.zeros((len(offsets) - 1, dims), np.int64)
    many = np.maximum(at[1:] - at[:-1], 1)
    for d in range(dims):
        signs = ((hashes >> np.uint64(7 + 11 * d)) & np.uint64(1)).astype(np.int64) * 2 - 1
        total = np.concatenate([[0], np.cumsum(signs)])
        mean = (total[at[1:]] - total[at[:-1]]) / many
        points[:, d] = np.clip((np.tanh(3 * mean) + 1) / 2 * (1 << bits), 0, (1 << bits) - 1)
    return _hilbert(points, bits)


def _tokenized(docs: DataFrame, text_col: str, path: str, end_id: int, dims: int, bits: int) -> DataFrame:
    def add():
        if path not in _tokens:
            _tokens[path] = Tokens(path)
        tokens = _tokens[path]

        def made(column: pa.Array) -> list[pa.Array]:
            keys, counts, ids = [], [], []
            for first, last, data, offsets in words.chunks(column):
                found, at = tokens.encode(data, offsets)
                keys.append(curve_keys(data, offsets, dims, bits))
                counts.append(np.diff(at) + 1)
                ids += [np.append(found[at[r] : at[r + 1]], found.dtype.type(end_id)).tobytes() for r in range(last - first)]
            return [pa.array(np.concatenate(keys), pa.int64()), pa.array(np.concatenate(counts), pa.int64()), pa.array(ids, pa.binary())]

        return made

    return with_arrow(docs, text_col, add, "key bigint, n bigint, ids binary")


def _placed(rows: DataFrame) -> DataFrame:
    """(row, begin): ids of all rows before it in the order of (key, row), over all partitions."""
    ranged = rows.repartitionByRange("key", "row").sortWithinPartitions("key", "row").select("row", "n", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            ends = before + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ends - n, pa.int64()), batch.column(1)], names=["row", "part", "before", "n"])
            before = int(ends[-1]) if len(ends) else before

    local = written(ranged.mapInArrow(run, "row bigint, part int, before bigint, n bigint"))
    sums = sorted(local.groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("n")).collect())  # a row per partition
    begins, total = [], 0
    for part, n in sums:
        begins.append((part, total))
        total += n
    frame = local.sparkSession.createDataFrame(begins, "part int, base bigint")
    return local.join(F.broadcast(frame), "part").select("row", (F.col("before") + F.col("base")).alias("begin"))


def packed(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
           end_id: int = 1, with_ids: bool = True, dims: int = DIMS, bits: int = BITS) -> DataFrame:
    """Pieces of documents in sequences of ``length`` token ids, neighbours on a Hilbert curve together.

    The hashed word vector of a document is projected to ``dims`` directions; documents are
    range-sorted by their place on the Hilbert curve through that space, laid end to end, and
    the line is cut every ``length`` ids. Only the very last sequence can be short, so less
    than one sequence of padding is needed in all. Each document ends with ``end_id``.

    Returns a row per piece: ``id_col``, start (ids of the document before it), length,
    ids_crc32 (of little-endian 32-bit ids), doc_tokens, sequence_id, offset, and with
    ``with_ids`` the ids. Null and empty texts are their end id alone. Equal documents are
    neighbours; repeated rows are packed each on its own, null ids too. Other columns are
    ignored. An empty table gives an empty result.
    """
    source = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    table = _tokenized(source, "text", tokenizer_path, end_id, dims, bits)
    table = written(table.select("id", "_found.*", F.monotonically_increasing_id().alias("row")))
    placed = _placed(table.select("row", "key", "n"))
    kind = table.schema["id"].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source_at, start, size, crc, total, sequence, offset, ids = [], [], [], [], [], [], [], []
            for k, (n, raw, begin) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                own = np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32).astype("<u4")
                at = 0
                while at < n:
                    place = begin + at
                    many = min(n - at, length - place % length)
                    part = own[at : at + many]
                    source_at.append(k), start.append(at), size.append(many), crc.append(zlib.crc32(part.tobytes()))
                    total.append(n), sequence.append(place // length), offset.append(place % length)
                    if with_ids:
                        ids.append(part.astype(np.int32))
                    at += many
            columns = [batch.column(0).take(pa.array(source_at, pa.int64())), *[pa.array(x, pa.int64()) for x in (start, size, crc, total, sequence, offset)]]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = [T.StructField("id", kind), *[T.StructField(x, T.LongType()) for x in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    out = table.select("id", "n", "ids", "row").join(placed, "row").select("id", "n", "ids", "begin").mapInArrow(cut, T.StructType(fields))
    return out.withColumnRenamed("id", id_col)
