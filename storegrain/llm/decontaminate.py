"""Benchmark decontamination: an FM-index of each training shard, searched backwards for all test phrases.

A shard is the documents of one slice of a task. Its words become numbers: the place in the sorted vocabulary of the phrases, or
"other". A stretch of other words cannot be part of a match, so only stretches between them, as long as the shortest phrase at
least, enter the shard's text, each ended by a separator. That text is sorted (suffix array by doubling), its
last column goes into a wavelet matrix, and each phrase is found from its last word to its first by two ranks for
each word, all phrases at once. Occurrences are located by walking to the next sampled suffix position. Their word spans are merged in
each document.

The phrases are broadcast in blocks of at most ``PHRASE_BYTES`` of benchmark text; more blocks mean more passes over the documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storegrain.llm.common import ALNUM, LOWER, slices, text_bytes, word_hashes
from storegrain.session import ship, stage

WINDOW, SAMPLE = 13, 8
PHRASE_BYTES = 16 << 20
SHARD_BYTES = 1 << 20


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Order of the suffixes: ranks by one symbol, then by 2, 4, 8 ... until all differ."""
    n, step = len(codes), 1
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    while True:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        sorted_keys = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(sorted_keys[1:] != sorted_keys[:-1])])
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


class Wavelet:
    """Ranks in a sequence of small numbers: one bit of all numbers for each level, stably divided."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels = []
        for bit in range(bits - 1, -1, -1):
            ones = (values >> bit) & 1
            before = np.concatenate([[0], np.cumsum(ones)]).astype(np.int32)
            zeros = len(values) - int(before[-1])
            self.levels.append((bit, before, zeros))
            values = np.concatenate([values[ones == 0], values[ones == 1]])

    def rank(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each ``value`` occurs before each place ``at``."""
        start = np.zeros_like(at)
        for bit, before, zeros in self.levels:
            one = (value >> bit) & 1 == 1
            a, b = before[at], before[start]
            at = np.where(one, zeros + a, at - a)
            start = np.where(one, zeros + b, start - b)
        return at - start

    def access(self, at: np.ndarray) -> np.ndarray:
        value = np.zeros_like(at)
        for bit, before, zeros in self.levels:
            one = before[at + 1] - before[at]
            value |= one.astype(at.dtype) << bit
            at = np.where(one == 1, zeros + before[at], at - before[at])
        return value


class FMIndex:
    """Backward search over a sequence of numbers; 0 is the separator and the end."""

    def __init__(self, codes: np.ndarray, sigma: int):
        self.n = len(codes)
        # separators are all different (the later the larger), so that no comparison runs over one
        order = suffix_array(np.where(codes == 0, np.cumsum(codes == 0) - self.n, codes))
        last = codes[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=sigma))])
        self.tree = Wavelet(last, max(1, int(sigma - 1).bit_length()))
        self.sampled = order % SAMPLE == 0
        self.samples = order[self.sampled]
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        # rows before which a separator stands go to that separator's row by a table
        rows = np.flatnonzero(last == 0)
        inverse = np.empty(self.n, np.int64)
        inverse[order] = np.arange(self.n)
        self.jump = np.full(self.n, -1, np.int64)
        self.jump[rows] = inverse[order[rows] - 1]

    def find(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows ``[lo, hi)`` of the suffixes that begin with each phrase (row of numbers, filled up with 0)."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for back in range(phrases.shape[1]):
            live = np.flatnonzero((back < lengths) & (lo < hi))
            if not len(live):
                break
            c = phrases[live, lengths[live] - 1 - back]
            lo[live] = self.first[c] + self.tree.rank(c, lo[live])
            hi[live] = self.first[c] + self.tree.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of suffixes: step to the suffix before until a sampled one is met."""
        out, steps, live = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        rows = rows.copy()
        while len(live):
            done = self.sampled[rows[live]]
            hit = live[done]
            out[hit] = self.samples[self.sample_rank[rows[hit]]] + steps[hit]
            live = live[~done]
            if len(live):
                at = rows[live]
                c = self.tree.access(at)
                rows[live] = np.where(c == 0, self.jump[at], self.first[c] + self.tree.rank(c, at))
                steps[live] += 1
        return out


class Phrases:
    """Distinct windows of the benchmark items as numbers of their words."""

    def __init__(self, items: list[tuple], window: int):
        ids, texts = [str(i[0]) for i in items], pa.array([i[1] for i in items], pa.string())
        data, offsets = text_bytes(texts)
        hashes, first = word_hashes(LOWER[data], offsets, ALNUM)
        self.vocabulary = np.unique(hashes)
        codes = np.searchsorted(self.vocabulary, hashes) + 1
        windows: dict[tuple, set] = {}
        for i, item in enumerate(ids):
            words = codes[first[i]: first[i + 1]].tolist()
            for k in range(max(1, len(words) - window + 1) if words else 0):
                windows.setdefault(tuple(words[k: k + window]), set()).add(item)
        self.items = list(windows.values())
        self.lengths = np.array([len(w) for w in windows], np.int64)
        self.codes = np.zeros((len(windows), window), np.int64)
        for row, w in zip(self.codes, windows):
            row[: len(w)] = w
        # a table of the lowest hash bits sorts out most foreign words before the search
        self.mask = np.uint64((1 << max(16, int(len(self.vocabulary)).bit_length() + 4)) - 1)
        self.maybe = np.zeros(int(self.mask) + 1, bool)
        self.maybe[(self.vocabulary & self.mask).astype(np.int64)] = True

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word from 1 on, 0 for others."""
        out = np.zeros(len(hashes), np.int64)
        at = np.flatnonzero(self.maybe[(hashes & self.mask).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.vocabulary, hashes[at]), len(self.vocabulary) - 1)
        known = self.vocabulary[place] == hashes[at]
        out[at[known]] = place[known] + 1
        return out


def hits_in_shard(phrases: Phrases, column: pa.Array):
    """For each text: number of words, merged hit spans in words, and the items that occur."""
    data, offsets = text_bytes(column)
    hashes, first = word_hashes(LOWER[data], offsets, ALNUM)
    n, texts = len(hashes), len(offsets) - 1
    spans, items = [[] for _ in range(texts)], [set() for _ in range(texts)]
    if n and len(phrases.lengths):
        codes = phrases.numbers(hashes)
        known = codes > 0
        begins = known.copy()
        begins[1:] &= ~known[:-1]
        begins[first[:-1][first[:-1] < n]] = known[first[:-1][first[:-1] < n]]
        starts = np.flatnonzero(begins)
        stops = known.copy()
        stops[:-1] &= ~known[1:]
        edge = first[1:][first[1:] > 0] - 1
        stops[edge] = known[edge]
        ends = np.flatnonzero(stops) + 1
        long = ends - starts >= phrases.lengths.min()
        starts, ends = starts[long], ends[long]
        if len(starts):
            sizes = ends - starts + 1  # each stretch and its separator
            where = np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            closing = np.cumsum(sizes) - 1
            text = codes[np.minimum(where, n - 1)]
            text[closing] = 0
            index = FMIndex(text, len(phrases.vocabulary) + 1)
            lo, hi = index.find(phrases.codes, phrases.lengths)
            counts = hi - lo
            found = np.repeat(np.arange(len(counts)), counts)
            rows = np.repeat(lo, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            begin = where[index.locate(rows)]
            owner = np.searchsorted(first, begin, "right") - 1
            for k in np.lexsort((phrases.lengths[found], begin)):
                d, a = int(owner[k]), int(begin[k] - first[owner[k]])
                b = a + int(phrases.lengths[found[k]])
                items[d] |= phrases.items[found[k]]
                if spans[d] and a <= spans[d][-1][1]:
                    spans[d][-1][1] = max(spans[d][-1][1], b)
                else:
                    spans[d].append([a, b])
    return np.diff(first), spans, items


NEW = "n_words long, hit_spans array<array<long>>, items array<string>"


def _one_block(docs: DataFrame, text_col: str, phrases, names: list[str]) -> DataFrame:
    at = docs.columns.index(text_col)

    def run(batches):
        known = phrases.value
        for part in slices(batches, at, SHARD_BYTES):
            n, spans, items = hits_in_shard(known, part.column(at))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                 pa.array([sorted(x) for x in items], pa.list_(pa.string()))], names)

    return docs.mapInArrow(run, T.StructType([*docs.schema, *T._parse_datatype_string(NEW)]))


def find_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                   window: int = WINDOW, phrase_bytes: int = PHRASE_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (merged, ``[start, end)`` in words) and ``items`` (ids as strings, sorted).

    Words are runs of ASCII letters and digits and of all other characters, A-Z in lower case. A phrase is ``window`` consecutive
    words of an item; an item of fewer words is one phrase. Document words inside an occurrence of a phrase are hit; a phrase that
    several items have counts for all of them.

    Null and empty texts have no words and no hits; items without words (or a null id) say nothing, repeated items count once.
    Columns ``n_words``, ``hit_spans`` and ``items`` of ``docs`` are replaced, others stay. Rows are judged one by one.
    If the benchmark has more than ``phrase_bytes`` of text, it is searched for in blocks and the spans are merged.
    """
    ship(docs.sparkSession)
    spark, new = docs.sparkSession, [f.name for f in T._parse_datatype_string(NEW)]
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in new))
    columns = docs.columns
    kept = benchmark.select(F.col(item_col).cast("string").alias("id"), F.col(item_text).alias("text")).dropna().distinct()
    total = kept.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // phrase_bytes) or 1
    block = F.pmod(F.xxhash64("id", "text"), F.lit(blocks))
    out = None
    for b in range(blocks):
        phrases = spark.sparkContext.broadcast(Phrases(sorted(map(tuple, kept.where(block == b).collect())), window))
        if out is None:
            out = _one_block(docs, text_col, phrases, [*columns, *new])
            continue
        before = [F.col(c).alias(f"__{c}") for c in new[1:]]
        out = _one_block(stage(out, "benchmark-block").select(*columns, *before), text_col, phrases,
                         [*columns, *(f"__{c}" for c in new[1:]), *new])
        both = F.array_sort(F.concat("__hit_spans", "hit_spans"))
        merged = F.aggregate(both, F.array().cast("array<array<bigint>>"), lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)[1] >= s[0]),
            F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
                     F.array(F.array(F.element_at(done, -1)[0], F.greatest(F.element_at(done, -1)[1], s[1]))))
        ).otherwise(F.concat(done, F.array(s))))
        out = out.select(*columns, "n_words", merged.alias("hit_spans"), F.array_sort(F.array_union("__items", "items")).alias("items"))
    return out


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, the hash of the items and the rule for contamination, from the columns of ``find_benchmark``."""
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select(id_col, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated(hit).alias("contaminated"))


def contaminated(hit=None):
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0]) if hit is None else hit
    return (hit > 0) & (20 * hit >= F.col("n_words"))

