"""Words that are one edit apart, found through neighbourhoods over a reduced alphabet, and the forms they follow."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landgrid.llm.shared import written
from landgrid.llm.words import mix, pieces

#: One in so many words of a text loses a letter before it is counted; None counts words as they are.
DROPPED = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: Symbols of the reduced alphabet: more make neighbourhoods larger and candidates fewer, with the same result.
SYMBOLS = 8
#: Code points up to which words get neighbourhoods, whose size grows with the square of the length.
LONG = 40
#: Reduced words whose neighbourhoods are made together.
_ROWS = 1 << 12
_C3 = 0xC3
#: Powers that tell the places of symbols apart.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = 0xD6E8FEB86659FD93

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _crc_steps() -> np.ndarray:
    """What a byte does to a CRC-32 in its reflected form."""
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = np.where(steps & 1, (steps >> 1) ^ np.uint32(0xEDB88320), steps >> 1)
    return steps


_STEPS = _crc_steps()


def _inside(data: np.ndarray) -> np.ndarray:
    """Bytes of letters: a-z, A-Z and the code points U+00C0 to U+00FF, which are C3 and one more byte."""
    lead = data == _C3
    inside = _LETTER[data] | lead
    inside[1:] |= lead[:-1]
    return inside


def _checksums(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each run, continued from ``before``; byte by byte over all runs that are long enough."""
    order = np.argsort(-sizes, kind="stable")
    state, at, size = before[order] ^ np.uint32(0xFFFFFFFF), starts[order], sizes[order]
    long = int(np.searchsorted(-size, -64, side="left"))  # runs of more than 64 bytes come first
    for k in range(int(size[long]) if long < len(size) else 0):
        some = slice(long, int(np.searchsorted(-size, -k, side="left")))
        state[some] = _STEPS[(state[some] ^ flat[at[some] + k]) & 0xFF] ^ (state[some] >> np.uint32(8))
    out = np.empty(len(sizes), np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    for k in order[:long]:
        out[k] = zlib.crc32(flat[starts[k] : starts[k] + sizes[k]].tobytes(), int(before[k]))
    return out


def _strings(flat: np.ndarray, sizes: np.ndarray, keep: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(sizes[keep])]).astype(np.int64)
    data = np.ascontiguousarray(flat[np.repeat(keep, sizes)])
    return pa.LargeStringArray.from_buffers(int(keep.sum()), pa.py_buffer(ends), pa.py_buffer(data))


def _words(ids: list[str | None], texts: pa.Array, dropped: int | None, least: int) -> Iterator[pa.Array]:
    """The words of a batch of texts, as arrays of strings."""
    for first, data, offsets in pieces(texts, _inside):
        if not len(data):
            continue
        inside = _inside(data)
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        borders = offsets[1:-1][offsets[1:-1] < len(data)]
        begins[borders] = inside[borders]
        ends[borders[borders > 0] - 1] = inside[borders[borders > 0] - 1]
        starts = np.flatnonzero(begins)
        if not len(starts):
            continue
        sizes = np.flatnonzero(ends) + 1 - starts
        flat = _LOWER[data[inside]]
        at = np.cumsum(sizes) - sizes
        points = sizes - np.add.reduceat((flat == _C3).astype(np.int64), at)
        hit = np.zeros(len(sizes), bool)
        if dropped:
            rows = np.searchsorted(offsets, starts, side="right") - 1
            heads = np.array([zlib.crc32(f"{'' if ids[first + k] is None else ids[first + k]}:".encode()) for k in range(len(offsets) - 1)], np.uint32)
            sums = _checksums(flat, at, sizes, heads[rows])
            hit = sums % np.uint32(dropped) == 0
            shorter = []
            for k in np.flatnonzero(hit & (points > least)):
                word, place = flat[at[k] : at[k] + sizes[k]].tobytes().decode(), int(sums[k]) % int(points[k])
                shorter.append(word[:place] + word[place + 1 :])
            yield pa.array(shorter, pa.large_string())
        yield _strings(flat, sizes, ~hit & (points >= least))


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dropped: int | None = DROPPED,
               least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of at least ``least_length`` code points that occur ``least_count`` times in all texts.

    A word is a run of a-z, A-Z and U+00C0 to U+00FF, with A-Z in lower case. Where the CRC-32
    of ``<id>:<word>`` is a multiple of ``dropped``, the word loses the code point at that
    number modulo its length. Texts are read whole, a very long one in pieces; words are counted
    per batch before they are shuffled. A null text has no words, a null id counts as empty,
    repeated rows count again, and other columns are ignored.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_words(batch.column(0).to_pylist(), batch.column(1), dropped, least_length))
            if found:
                counts = pc.value_counts(pa.chunked_array(found))
                yield pa.RecordBatch.from_arrays([counts.field(0).cast(pa.string()), counts.field(1)], names=["word", "n"])

    source = docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].cast("string").alias("text")).where("text is not null")
    return source.mapInArrow(counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _reduced(word: Column, symbols: int) -> Column:
    """The word over the reduced alphabet: each code point is hashed to one of a few symbols."""
    names = F.array(*[F.lit(chr(97 + k)) for k in range(symbols)])
    symbol = F.transform(F.split(word, ""), lambda c: F.element_at(names, (F.crc32(c.cast("binary")) % symbols + 1).cast("int")))
    return F.when(word == "", "").otherwise(F.array_join(symbol, ""))


def _codes(raw: np.ndarray, size: int) -> np.ndarray:
    return mix(raw + np.uint64(size * _STEP % (1 << 64)))


def _neighbourhood(symbols: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of reduced words of one length (a row of symbols 1 to ``count`` each), and of all words that one edit makes of them.

    A code is a 64-bit hash of a sum over symbols times powers, so that each edit changes the
    sum by what stands before, at and behind its place. The word itself is among its neighbours.
    """
    rows, size = symbols.shape
    powers = _BASE ** np.arange(size + 1, dtype=np.uint64)
    terms = symbols * powers[:size]
    before = np.zeros((rows, size + 1), np.uint64)
    np.cumsum(terms, axis=1, out=before[:, 1:])
    whole = before[:, -1:]
    named = np.arange(1, count + 1, dtype=np.uint64)
    deleted = before[:, :-1] + (whole - before[:, 1:]) * _BACK
    replaced = (whole - terms)[:, :, None] + powers[:size, None] * named
    inserted = (before + (whole - before) * _BASE)[:, :, None] + powers[:, None] * named
    near = np.concatenate([_codes(deleted, size - 1), _codes(replaced, size).reshape(rows, -1), _codes(inserted, size + 1).reshape(rows, -1)], axis=1)
    return _codes(whole[:, 0], size), near


def _by_length(reduced: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and symbols (1, 2, ...) of reduced words, some words of one length at a time."""
    column = reduced.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    sizes = np.diff(offsets)
    for size in np.unique(sizes):
        same = np.flatnonzero(sizes == size)
        for first in range(0, len(same), _ROWS):
            some = same[first : first + _ROWS]
            yield some, (data[offsets[some][:, None] + np.arange(size)] - np.uint8(96)).astype(np.uint64)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n, reduced) with the code of the reduced word."""
    for batch in batches:
        codes = np.zeros(batch.num_rows, np.uint64)
        for some, symbols in _by_length(batch.column(2)):
            codes[some] = _neighbourhood(symbols, 0)[0]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes.view(np.int64))], names=[*batch.schema.names, "code"])


def _met(count: int):
    """For reduced words: (code, code of a word of the neighbourhood that is not smaller), each once."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, symbols in _by_length(batch.column(0)):
                own, near = _neighbourhood(symbols, count)
                near = np.sort(near, axis=1)
                new = near >= own[:, None]
                new[:, 1:] &= near[:, 1:] != near[:, :-1]
                x, y = np.repeat(own, new.sum(axis=1)), near[new]
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["x", "y"])

    return meet


def _halves(word: Column) -> Column:
    """Keys of a long word, for each length that a near word may have: the first or the last half of the shorter one.

    A single edit leaves one of the two halves alone.
    """
    size = F.length(word)
    lengths = F.array(F.struct((size - 1).alias("a"), size.alias("b")), F.struct(size.alias("a"), size.alias("b")), F.struct(size.alias("a"), (size + 1).alias("b")))

    def keys(pair: Column) -> Column:
        half = F.floor(pair["a"] / 2).cast("int")
        return F.array(*[F.struct(pair["a"].alias("a"), pair["b"].alias("b"), F.lit(side).alias("side"), F.md5(part.cast("binary")).alias("part"))
                         for side, part in ((0, F.substr(word, F.lit(1), half)), (1, F.substr(word, size - half + 1, half)))])

    return F.flatten(F.transform(lengths, keys))


def near_words(words: DataFrame, symbols: int = SYMBOLS, long: int = LONG) -> DataFrame:
    """(a, n_a, b, n_b), a < b: the pairs of distinct words of (word, n) that one edit tells apart.

    The distinct reduced words get their full one-edit neighbourhoods, which are joined with
    the reduced vocabulary; only words of reduced words that meet are compared as they are.
    Words of more than ``long`` code points, whose neighbourhoods would be large, meet by an
    equal half instead, with the same result. A null word is near to none; an empty table has
    no pairs.
    """
    words = words.select("word", "n").where("word is not null")
    short = words.where(F.length("word") <= long).withColumn("reduced", _reduced(F.col("word"), symbols))
    short = written(short.mapInArrow(_coded, "word string, n bigint, reduced string, code bigint"))
    met = short.select("reduced").distinct().mapInArrow(_met(symbols), "x bigint, y bigint")
    met = met.join(short.select(F.col("code").alias("y")).distinct(), "y", "left_semi")
    a = short.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("code").alias("x"))
    b = short.select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("code").alias("y"))
    one_edit = F.expr("abs(length(a) - length(b)) <= 1 and levenshtein(a, b, 1) = 1")
    pairs = a.join(met, "x").join(b, "y").where(F.expr("x <> y or a < b") & one_edit).select("a", "n_a", "b", "n_b")

    # A word as long as the border may have a near word beyond it.
    halves = words.where(F.length("word") >= long).withColumn("key", F.explode(_halves(F.col("word"))))
    a = halves.select(F.col("word").alias("a"), F.col("n").alias("n_a"), "key")
    b = halves.select(F.col("word").alias("b"), F.col("n").alias("n_b"), "key")
    beyond = a.join(b, "key").where(F.expr(f"a < b and greatest(length(a), length(b)) > {long}") & one_edit).select("a", "n_a", "b", "n_b").distinct()
    ordered = F.col("a") < F.col("b")
    return pairs.unionByName(beyond).select(
        F.least("a", "b").alias("a"), F.when(ordered, F.col("n_a")).otherwise(F.col("n_b")).alias("n_a"),
        F.greatest("a", "b").alias("b"), F.when(ordered, F.col("n_b")).otherwise(F.col("n_a")).alias("n_b"),
    )


def spelling_variants(words: DataFrame, times: int = 2, **options) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of (word, n), whose words are distinct.

    ``form`` is the near word of largest n (of equal ones the first by code points) if that n
    is at least ``times`` (2 or more) the word's own, else null; ``root`` is where forms lead.
    Each step to a form multiplies n, so the longest chain is logarithmic in the largest n, and
    so many rounds of pointer jumping, logarithmic again, reach every root.
    """
    words = written(words.select("word", "n"))
    pairs = near_words(words, **options)
    sides = F.array(F.struct(F.col("a").alias("word"), F.struct((-F.col("n_b")).alias("k"), F.col("b").alias("w")).alias("other")),
                    F.struct(F.col("b").alias("word"), F.struct((-F.col("n_a")).alias("k"), F.col("a").alias("w")).alias("other")))
    near = pairs.select(F.explode(sides).alias("s")).select("s.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min("other").alias("best"))
    followed = -F.col("best.k") >= times * F.col("n")
    formed = written(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(followed, F.col("best.w")).alias("form"), F.when(followed, -F.col("best.k")).alias("form_n"),
    ))
    ups = formed.where("form is not null").select("word", F.col("form").alias("up"))
    most = words.agg(F.max("n"), F.min("n")).first()
    depth = math.log(max(most[0] / max(most[1], 1), 1), times) if most[0] else 0
    for _ in range(math.ceil(math.log2(depth)) if depth > 1 else 0):
        onward = ups.select(F.col("word").alias("up"), F.col("up").alias("next"))
        ups = written(ups.join(onward, "up", "left").select("word", F.coalesce("next", "up").alias("up")))
    return formed.join(ups, "word", "left").select("word", "form", F.coalesce("up", "word").alias("root"), "n", "n_near", "form_n")
