"""Toxic spans and document scores from a linear-chain conditional random field."""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landgrid.llm import words
from landgrid.llm.decontaminate import Member
from landgrid.llm.rows import with_arrow
from landgrid.llm.shared import written

#: The field is fitted on at most so many labelled rows, and on at most so many of their words.
TRAIN_ROWS, TRAIN_WORDS = 20_000, 400_000
#: Part of these words that one text may bring to the fit, and the least number of words that it may.
TEXT_PART, TEXT_WORDS = 200, 50
#: A word is labelled toxic if so many distinct texts, mostly toxic ones, have it.
LEAST_TEXTS, LEAST_ODDS = 5, 2.5
#: Most words with weights of their own; all others share one.
VOCABULARY = 30_000
_BLOCK = 64
_FIELDS = "score double, n_words bigint, spans array<struct<start:bigint,end:bigint,marginal:double>>"


def _words(data: np.ndarray, offsets: np.ndarray):
    """Runs of letters."""
    return words.word_hashes(data, offsets, words.LETTERS, words.LOWERED)


# Forward and backward passes over many texts laid end to end. Positions are cut into blocks;
# a step handles one position of all blocks. A text's first step has two equal rows, so
# nothing passes from one text to the next.
def _steps(emit: np.ndarray, first: np.ndarray, move: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The 2 x 2 matrix of each position, as four rows: 00, 01, 10, 11."""
    out = np.empty((4, len(emit)))
    weight = np.exp(np.stack([np.minimum(-emit, 0), np.minimum(emit, 0)]))
    for i in range(2):
        for j in range(2):
            out[2 * i + j] = np.where(first, np.exp(begin[j]), np.exp(move[i, j])) * weight[j]
    return out


def _forward(steps: np.ndarray) -> np.ndarray:
    """Normalised forward vectors of all positions."""
    n = steps.shape[1]
    rows = -(-n // _BLOCK)
    padded = np.zeros((4, rows * _BLOCK))
    padded[:, :n] = steps
    padded[[0, 3], n:] = 1
    a, b, c, d = padded.reshape(4, rows, _BLOCK).transpose(0, 2, 1)
    p, q, r, s = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)
    for k in range(_BLOCK):
        p, q, r, s = p * a[k] + q * c[k], p * b[k] + q * d[k], r * a[k] + s * c[k], r * b[k] + s * d[k]
        scale = p + q + r + s
        p, q, r, s = p / scale, q / scale, r / scale, s / scale
    x, y = np.empty(rows), np.empty(rows)
    u, v = 0.5, 0.5
    for k, (e, f, g, h) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist(), strict=True)):
        x[k], y[k] = u, v
        u, v = u * e + v * g, u * f + v * h
        u, v = u / (u + v), v / (u + v)
    out = np.empty((2, _BLOCK, rows))
    for k in range(_BLOCK):
        x, y = x * a[k] + y * c[k], x * b[k] + y * d[k]
        total = x + y
        x, y = x / total, y / total
        out[0, k], out[1, k] = x, y
    return out.transpose(0, 2, 1).reshape(2, -1)[:, :n]


def marginals(emit: np.ndarray, first: np.ndarray, move: np.ndarray, begin: np.ndarray, pairs: bool = False):
    """Probability of the toxic state at every position; with ``pairs`` the expected moves and starts too.

    ``emit`` is the toxic state's score over the other's, ``first`` marks where texts begin.
    """
    if not len(emit):
        return (np.zeros(0), np.zeros((2, 2)), np.zeros(2)) if pairs else np.zeros(0)
    steps = _steps(emit, first, move, begin)
    ahead = _forward(steps)
    # Backwards the same runs on the transposed steps in reverse; the last position sees (1, 1).
    turned = np.empty_like(steps)
    turned[:, 0] = 1
    turned[:, 1:] = steps[[0, 2, 1, 3], 1:][:, ::-1]
    back = _forward(turned)[:, ::-1]
    both = ahead * back
    chance = both[1] / both.sum(axis=0)
    if not pairs:
        return chance
    inner = np.flatnonzero(~first)
    joint = np.stack([ahead[i, inner - 1] * steps[2 * i + j, inner] * back[j, inner] for i in range(2) for j in range(2)])
    moves = (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)
    starts = np.array([(1 - chance[first]).sum(), chance[first].sum()])
    return chance, moves, starts


def fit_field(index: np.ndarray, first: np.ndarray, tags: np.ndarray, size: int, rounds: int = 60, rate: float = 0.3, shrink: float = 0.02):
    """Weights of words, of moves and of starts that make the tags likely (Adam on the penalised likelihood).

    ``index`` is the vocabulary entry of each position, 0 for all unknown words.
    """
    weight, move, begin = np.zeros(size), np.zeros((2, 2)), np.zeros(2)
    share = (tags.sum() + 0.5) / (len(tags) + 1)
    bias = np.array([np.log(share / (1 - share))])
    inner = np.flatnonzero(~first)
    seen = np.bincount(2 * tags[inner - 1] + tags[inner], minlength=4).reshape(2, 2)
    began = np.bincount(tags[first], minlength=2)
    parts = [weight, move, begin, bias]
    mean, power = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for step in range(1, rounds + 1):
        chance, moves, starts = marginals(bias[0] + weight[index], first, move, begin, pairs=True)
        error = chance - tags
        slopes = [
            np.bincount(index, weights=error, minlength=size) + shrink * weight, moves - seen + shrink * move,
            starts - began + shrink * begin, np.array([error.sum()]),
        ]
        for k, (p, g) in enumerate(zip(parts, slopes, strict=True)):
            mean[k] = 0.8 * mean[k] + 0.2 * g
            power[k] = 0.95 * power[k] + 0.05 * g * g
            p -= rate * (mean[k] / (1 - 0.8**step)) / (np.sqrt(power[k] / (1 - 0.95**step)) + 1e-8)
    return bias[0] + weight, move, begin


def fit_logistic(x: np.ndarray, y: np.ndarray, shrink: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights and intercept, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    out, own = np.zeros(x.shape[1]), np.full(x.shape[1], shrink)
    own[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ out, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(own)
        out = out - np.linalg.solve(curve, x.T @ (p - y) + own * out)
    return out


def _evidence(chance: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per text: its strongest marginal, and the logarithm of the expected number of toxic words."""
    n = len(at) - 1
    out = np.zeros((n, 2))
    some = np.flatnonzero(at[1:] > at[:-1])
    if len(some):
        out[some, 0] = np.maximum.reduceat(chance, at[some])
        out[some, 1] = np.log1p(np.add.reduceat(chance, at[some]))
    return out


def _chances(model: SimpleNamespace, member: Member, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    index = np.zeros(len(hashes), np.int64)
    pos, place = member.find(hashes)
    index[pos] = place + 1
    first = np.zeros(len(hashes), bool)
    first[at[:-1][at[:-1] < len(hashes)]] = True
    return marginals(model.weight[index], first, model.move, model.begin)


def _window(index: np.ndarray, tags: np.ndarray, many: int) -> slice:
    """At most ``many`` words of a text, with its first toxic token in their middle if there is one."""
    middle = int(np.argmax(tags)) if tags.any() else 0
    begin = max(0, min(middle - many // 2, len(index) - many))
    return slice(begin, begin + many)


def _sample(train: DataFrame, member: Member, bad: np.ndarray, train_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word number, first-of-a-text flag and tag of the words that the field learns from.

    Half of the words come from toxic texts that hold a toxic token, the rest from clean ones,
    each in the order of a hash of the text; a longer text brings a window around its first
    toxic token. At least one text of a class is taken, if there is one with words.
    """
    many = max(TEXT_WORDS, train_words // TEXT_PART)
    index, first, tags = [np.zeros(0, np.int64)], [np.zeros(0, bool)], [np.zeros(0, np.int64)]
    for label, budget in ((1, train_words // 2), (0, train_words - train_words // 2)):
        taken = 0
        for row in train.where(F.col("label") == label).orderBy(F.xxhash64("copy"), "copy").select("text").toLocalIterator():
            for _, _, data, offsets in words.chunks(pa.array([row["text"]], pa.large_string())):
                hashes, _, _, _ = _words(data, offsets)
                own = np.zeros(len(hashes), np.int64)
                pos, place = member.find(hashes)
                own[pos] = place + 1
                toxic = (bad[own] & bool(label)).astype(np.int64)
                if len(own) and (toxic.any() or not label):
                    part = _window(own, toxic, many)
                    index.append(own[part])
                    first.append(np.arange(len(index[-1])) == 0)
                    tags.append(toxic[part])
                    taken += len(index[-1])
            if taken >= budget:
                break
    return np.concatenate(index), np.concatenate(first), np.concatenate(tags)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        train_rows: int = TRAIN_ROWS, train_words: int = TRAIN_WORDS, vocabulary: int = VOCABULARY) -> SimpleNamespace:
    """A model from the labelled documents.

    At most ``train_rows`` labelled ids, the first by a hash of the id, are used; equal texts
    count once, as toxic if any copy is. Words that mostly toxic texts have are the toxic
    tokens of those texts, all others are not. The ``vocabulary`` words that most of the texts
    have, toxic tokens first, get weights of their own, all others share one. The field learns
    words and moves from about ``train_words`` words, half of them of toxic texts, at most one
    part in ``TEXT_PART`` (50 words at least) of a text; a toxic token that is not among them
    starts with the mean weight of those that are. Document scores are calibrated on the whole
    texts of all training rows.

    Null labels and null ids are left out; null and empty texts have no words. Without rows of
    both classes, or without a word that tells them apart, every text gets the same score.
    Smaller bounds cost accuracy, not rows.
    """
    picked = labels.select(labels[id_col].alias("id"), (labels[label_col] > 0).cast("int").alias("label")).where("label is not null and id is not null")
    picked = picked.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(train_rows)
    source = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    train = source.join(F.broadcast(picked), "id")  # at most train_rows pairs of numbers
    train = written(train.groupBy(F.md5(F.col("text").cast("binary")).alias("copy")).agg(F.first("text").alias("text"), F.max("label").alias("label")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy()
            for first, last, data, offsets in words.chunks(batch.column(0)):
                hashes, _, _, at = _words(data, offsets)
                row = np.repeat(np.arange(last - first), np.diff(at))
                pairs = np.unique(np.stack([row.astype(np.uint64), hashes]), axis=1) if len(hashes) else np.zeros((2, 0), np.uint64)
                yield pa.RecordBatch.from_pydict({"word": pa.array(pairs[1].view(np.int64)), "label": pa.array(label[first:last][pairs[0].astype(np.int64)], pa.int32())})

    totals = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    none = SimpleNamespace(known=np.zeros(0, np.uint64), weight=np.full(1, -8.0), move=np.zeros((2, 2)), begin=np.zeros(2))
    share = (toxic + 0.5) / (toxic + clean + 1) if toxic + clean else 0.0
    none.line = np.array([0.0, 0.0, np.log(max(share, 1e-6) / max(1 - share, 1e-6))])
    if not toxic or not clean:
        return none
    counts = train.select("text", "label").mapInArrow(cut, "word bigint, label int").groupBy("word").agg(
        F.sum("label").alias("t"), F.count("*").alias("n")).where(F.col("n") >= LEAST_TEXTS)
    odds = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("n") - F.col("t") + 0.5) / (clean + 1.0))
    known = counts.withColumn("odds", odds).orderBy(F.desc(((F.col("t") >= LEAST_TEXTS) & (odds >= LEAST_ODDS)).cast("int")), F.desc("n"), "word").limit(vocabulary).collect()
    known = sorted((np.uint64(r["word"] & ((1 << 64) - 1)), r["t"] >= LEAST_TEXTS and r["odds"] >= LEAST_ODDS) for r in known)
    names = np.array([k for k, _ in known], np.uint64)
    bad = np.array([False, *[b for _, b in known]])
    if not bad.any():
        return none
    index, first, tags = _sample(train, Member(names), bad, train_words)
    if not tags.any() or tags.all():
        return none
    weight, move, begin = fit_field(index, first, tags, len(bad))
    unseen = bad.copy()
    unseen[index] = False
    weight[unseen] = weight[np.unique(index[tags == 1])].mean()
    none.known, none.weight, none.move, none.begin = names, weight, move, begin

    context = docs.sparkSession.sparkContext
    shared = context.broadcast(none)

    def look():
        model = shared.value
        member = Member(model.known)

        def made(column: pa.Array) -> list[pa.Array]:
            found = []
            for _, _, data, offsets in words.chunks(column):
                hashes, _, _, at = _words(data, offsets)
                found.append(_evidence(_chances(model, member, hashes, at), at))
            found = np.concatenate(found)
            return [pa.array(found[:, 0]), pa.array(found[:, 1])]

        return made

    seen = with_arrow(train.select("text", "label"), "text", look, "most double, many double").select("_found.*", "label").toPandas()
    none.line = fit_logistic(seen[["most", "many"]].to_numpy(), seen["label"].to_numpy())
    return none


def scored(docs: DataFrame, model: SimpleNamespace, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct ``_found``: score (0 to 1), n_words, and the toxic words' spans.

    Forward-backward marginals of every word of the whole text give the strongest word and the
    expected number of toxic words, and those the score. Spans are code points, end exclusive,
    of words with a marginal of one half or more. Null and empty texts have no words and get
    the score of no evidence. Each row stands for itself; other columns stay untouched, and an
    empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def add():
        own = shared.value
        member = Member(own.known)

        def made(column: pa.Array) -> list[pa.Array]:
            scores, counts, spans = [], [], []
            for first, last, data, offsets in words.chunks(column):
                hashes, starts, stops, at = _words(data, offsets)
                chance = _chances(own, member, hashes, at)
                line = _evidence(chance, at) @ own.line[:2] + own.line[2]
                scores.append(1 / (1 + np.exp(-np.clip(line, -30, 30))))
                counts.append(np.diff(at))
                rows: list[list] = [[] for _ in range(last - first)]
                hits = np.flatnonzero(chance >= 0.5)
                if len(hits):
                    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    row = np.searchsorted(at, hits, side="right") - 1
                    base = points[offsets[row]]
                    for r, b, e, c in zip(row.tolist(), (points[starts[hits]] - base).tolist(), (points[stops[hits]] - base).tolist(), chance[hits].tolist(), strict=True):
                        rows[r].append({"start": b, "end": e, "marginal": c})
                spans += rows
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))
            return [pa.array(np.concatenate(scores)), pa.array(np.concatenate(counts), pa.int64()), pa.array(spans, kind)]

        return made

    return with_arrow(docs, text_col, add, _FIELDS)
