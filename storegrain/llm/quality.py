"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Labels give a grade: 0 toxic, 1 of low quality, 2 good. A text becomes the set of its hashed features: its words, and
coarse shares that describe its form (repeated words, signs, digits ...), hashed by name and level like words. All grades share the
weights: P(grade <= j) = sigmoid(threshold_j - score), with ordered thresholds. The expected grade and the tail
probability P(grade >= 2) are returned; a text is selected if that tail is ``TAIL`` or more.

The model is fitted on at most ``SAMPLE`` labelled rows (those with the least hash of their id); it is ``2 ** BITS`` weights, so a
broadcast of 1 MB whatever the corpus is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storegrain.llm.common import ALNUM, LOWER, SPACED, mix, slices, text_bytes, with_columns, word_hashes, words
from storegrain.session import ship

SAMPLE, BITS, TAIL = 12_000, 18, 0.5
#: A feature gets a weight if it occurs in this share of the sampled rows and in four of them at least.
LEAST_SHARE, LEAST_ROWS = 0.002, 4
STEPS, RATE, DECAY = 200, 0.1, 1e-4
LEVELS = 12
GRADES = 3


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and features, each pair once, sorted by text."""
    data, offsets = text_bytes(column)
    low, texts = LOWER[data], len(offsets) - 1
    hashes, first = word_hashes(low, offsets, ALNUM)
    owner = np.repeat(np.arange(texts), np.diff(first))
    pairs = np.unique(owner << BITS | (hashes >> np.uint64(64 - BITS)).astype(np.int64))
    distinct = np.bincount(pairs >> BITS, minlength=texts)

    begin, end, start = words(low, offsets, SPACED)
    word, _ = word_hashes(low, offsets, SPACED)
    count = np.maximum(np.diff(start), 1)
    repeated = np.zeros(len(word), np.int64)
    repeated[1:] = word[1:] == word[:-1]
    inner = np.concatenate([[0], np.cumsum(ALNUM[low])])
    no_letters = (inner[end] - inner[begin]) == 0
    odd_end = ~ALNUM[low[end - 1]] & ~np.isin(low[end - 1], np.frombuffer(b".,", np.uint8)) & ~no_letters
    lengths = np.maximum(np.diff(offsets), 1)
    shares = {
        "repeated": _per_text(repeated, start) / count, "signs": _per_text(no_letters, start) / count,
        "odd ends": _per_text(odd_end, start) / count, "distinct": distinct / np.maximum(np.diff(first), 1),
        "upper": _per_text((data >= 65) & (data <= 90), offsets) / lengths,
        "digits": _per_text((data >= 48) & (data <= 57), offsets) / lengths,
        "lines": _per_text(data == 10, offsets) * 20 / lengths,
    }
    size = np.minimum(np.log2(count).astype(np.int64), 15)
    found = [pairs]
    for number, (name, share) in enumerate(shares.items()):
        level = np.minimum(np.ceil(share * LEVELS), LEVELS).astype(np.int64)
        for least in range(LEVELS + 1):  # a text has the features of all levels up to its own
            text = np.flatnonzero(level >= least)
            code = (number + 1 << 32) + least + (100 * size[text] if name == "distinct" else 0 * text)
            hashed = mix(code.astype(np.uint64)) >> np.uint64(64 - BITS)
            found.append(text << BITS | hashed.astype(np.int64))
    pairs = np.unique(np.concatenate(found))
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, ... in columns."""
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def fit(rows: list[np.ndarray], grades: np.ndarray) -> Model:
    """Least penalised loss by Adam steps over all rows; with fewer than two grades every text keeps the prior."""
    size, n = 1 << BITS, len(rows)
    counts = np.bincount(grades, minlength=GRADES) + 0.5
    cut = np.cumsum(counts)[:-1] / counts.sum()
    thresholds = np.log(cut / (1 - cut))
    if not n or len(np.unique(grades)) < 2:
        return Model(np.zeros(size, np.float32), thresholds)
    index = np.concatenate(rows).astype(np.int64)
    start = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    known = np.flatnonzero(np.bincount(index, minlength=size) >= max(LEAST_ROWS, LEAST_SHARE * n))
    place = np.full(size, len(known), np.int64)  # rare features share a weight that stays 0
    place[known] = np.arange(len(known))
    index, owner = place[index], np.repeat(np.arange(n), np.diff(start))
    kept = index < len(known)
    index, owner = index[kept], owner[kept]
    value = np.concatenate([np.zeros(len(known)), [thresholds[0]], np.log(np.diff(thresholds))])
    first, second = np.zeros_like(value), np.zeros_like(value)
    for step in range(1, STEPS + 1):
        weights, base = value[: len(known)], value[len(known):]
        cuts = base[0] + np.concatenate([[0], np.cumsum(np.exp(base[1:]))])
        score = np.bincount(owner, weights[index], minlength=n)
        edges = np.concatenate([np.zeros((n, 1)), _sigmoid(cuts[None, :] - score[:, None]), np.ones((n, 1))], axis=1)
        slope = edges * (1 - edges)
        upper, lower = np.take_along_axis(edges, grades[:, None] + 1, 1)[:, 0], np.take_along_axis(edges, grades[:, None], 1)[:, 0]
        s_upper, s_lower = (np.take_along_axis(slope, grades[:, None] + k, 1)[:, 0] for k in (1, 0))
        chance = np.maximum(upper - lower, 1e-12)
        by_score = (s_upper - s_lower) / chance
        by_cut = np.array([((np.where(grades == j, -s_upper, 0) + np.where(grades == j + 1, s_lower, 0)) / chance).sum()
                           for j in range(GRADES - 1)])
        tails = np.cumsum(by_cut[::-1])[::-1]
        gradient = np.concatenate([np.bincount(index, by_score[owner], minlength=len(known)) / n + DECAY * weights,
                                   [tails[0] / n], np.exp(base[1:]) * tails[1:] / n])
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        value = value - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    base, weights = value[len(known):], np.zeros(size, np.float32)
    weights[known] = value[: len(known)]
    return Model(weights, base[0] + np.concatenate([[0], np.cumsum(np.exp(base[1:]))]))


def graded(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id, grade`` of the labelled ids: the least grade where an id repeats; rows that say nothing are left out."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select(F.col(id_col).alias("id"), grade.alias("grade")).dropna().groupBy("id").agg(F.min("grade").alias("grade"))


def train(docs: DataFrame, grades: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Fit on the ``sample`` graded ids with the least hash; only their ids are broadcast and only their features collected."""
    ship(docs.sparkSession)
    chosen = grades.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")

    def run(batches):
        for part in slices(batches, 2):
            owner, index = features(part.column(2))
            edges = np.searchsorted(owner, np.arange(len(part) + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(edges, index.astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], ["id", "grade", "index"])

    kind = rows.schema["id"].dataType.simpleString()
    found = rows.select("id", "grade", "text").mapInArrow(run, f"id {kind}, grade int, index array<int>").toArrow().sort_by("id")
    lists = found.column("index").combine_chunks()
    flat, edges = np.asarray(lists.flatten()), np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))]) if len(lists) else [0]
    return fit([flat[edges[i]: edges[i + 1]] for i in range(len(lists))], np.asarray(found.column("grade"), dtype=np.int64))


SCORES = "expected_grade double, tail_probability double, grade int, selected boolean"


def judge(docs: DataFrame, model: Model, text_col: str = "text", tail: float = TAIL) -> DataFrame:
    """``docs`` with ``expected_grade`` (0 to 2), ``tail_probability`` of the best grade, the likeliest ``grade`` and ``selected``.

    Null and empty texts are judged by their form alone. Columns with these names are replaced, others stay; rows are judged one by
    one, repeated ones alike; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        known = shared.value

        def step(column):
            owner, index = features(column)
            score = np.bincount(owner, known.weights[index], minlength=len(column))
            tails = known.tails(score)
            each = np.diff(np.concatenate([np.zeros((len(column), 1)), 1 - tails, np.ones((len(column), 1))], axis=1), axis=1)
            return [pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), pa.array(each.argmax(axis=1), pa.int32()),
                    pa.array(tails[:, -1] >= tail)]
        return step

    return with_columns(docs, text_col, SCORES, work)
