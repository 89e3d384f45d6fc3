"""Repeated passages: hash-compared suffix sort of anchored suffixes.

A suffix array of every byte of 100 TB would have to be shuffled whole. Only suffixes that start at *anchors* are sorted here:
of all ``KEY``-byte strings that a window of ``length`` bytes holds, the one with the least hash (leftmost if there are
several). Two equal windows choose the same anchor, so every repeated window shows up as two anchors with equal keys.

1. One pass writes the anchors of all texts: key (hash of the ``KEY`` bytes), and a hash of the context (all bytes of the windows
   that can have this anchor). About one anchor for 170 bytes.
2. Anchors whose key occurs once are done. Where a whole context occurs at two places, all of it is repeated.
3. For the other keys one member of each context goes to the task of its key with its bytes. There the suffixes right of the
   anchors and the reversed prefixes left of them are sorted: prefix polynomial hashes and binary search give the common
   extension of two of them, so a comparison takes a logarithmic number of steps; equal hashes are confirmed on the bytes. Python's
   ``sorted`` is the mergesort. From the two orders each member's widest repeated stretch follows by joining
   neighbours in falling order of their common extension to the right and asking for the nearest neighbour to the left, the smaller
   list into the larger one; pairs of members are never listed.
4. A key with more than ``GROUP_LIMIT`` different contexts is not gathered in one task: the hashes of all its windows are counted
   as rows instead (exact as well, more rows).
5. Stretches are merged for each text, and the remaining bytes are hashed.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left, insort
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storegrain.llm.common import mix, prefix_hash, slices, span_hash, text_bytes
from storegrain.session import ship, stage

KEY = 64
STEP = 16
GROUP_LIMIT = 100_000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` neighbours: running minima from both sides of blocks of that width."""
    n = len(values)
    padded = np.full(-(-n // width) * width, 2**64 - 1, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1: n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int):
    """Text number, place in the text, key and context hash of the anchors of all texts."""
    n, width, empty = len(data), length - KEY + 1, np.zeros(0, np.int64)
    if n < length:
        return empty, empty, empty, empty
    prefix = prefix_hash(data)
    at = np.arange(n - KEY + 1)
    keys = span_hash(prefix, at, at + KEY)
    # the upper 36 bits decide, the place in the slice breaks ties, the leftmost first
    bits = np.uint64(max(28, int(n).bit_length()))
    least = window_minima((keys >> bits << bits) | at.astype(np.uint64), width)
    chosen = (least & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    inside = np.zeros(len(chosen) + 1, np.int64)  # windows that start in one text and end in it
    sizes = np.diff(offsets)
    whole = np.flatnonzero(sizes >= length)
    np.add.at(inside, offsets[whole], 1)
    np.add.at(inside, np.minimum(offsets[whole] + sizes[whole] - length + 1, len(chosen)), -1)
    places = np.unique(chosen[np.cumsum(inside[:-1]) > 0])
    text = np.searchsorted(offsets, places, "right") - 1
    lo = np.maximum(offsets[text], places - width + 1)
    hi = np.minimum(offsets[text + 1], places + length)
    context = span_hash(prefix_hash(data, 1), lo, hi, 1)
    return text, places - offsets[text], keys[places].view(np.int64), context.view(np.int64)


class Suffixes:
    """Texts of one key with prefix hashes at every ``STEP`` bytes: common extensions and order."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.hashes = [array("Q", prefix_hash(np.frombuffer(t, np.uint8))[::STEP].tobytes()) for t in texts]

    def common(self, i: int, j: int) -> int:
        """How many first bytes two texts share: binary search on the hashes, confirmed and finished on the bytes."""
        x, y, a, b = self.hashes[i], self.hashes[j], self.texts[i], self.texts[j]
        lo, hi = 0, min(len(x), len(y)) - 1
        while lo < hi:
            middle = (lo + hi + 1) // 2
            if x[middle] == y[middle]:
                lo = middle
            else:
                hi = middle - 1
        k = lo * STEP
        if a[:k] != b[:k]:  # two strings with one hash
            k = 0
        end = min(len(a), len(b))
        while k < end and a[k] == b[k]:
            k += 1
        return k

    def compare(self, i: int, j: int) -> int:
        k, a, b = self.common(i, j), self.texts[i], self.texts[j]
        return (a[k] - b[k]) if k < len(a) and k < len(b) else len(a) - len(b)

    def order(self) -> list[int]:
        return sorted(range(len(self.texts)), key=cmp_to_key(self.compare))


def widest(lefts: list[bytes], rights: list[bytes], length: int) -> list[tuple[int, int]]:
    """For each member how far left and right of its anchor it is repeated by stretches of ``length`` bytes or more.

    ``lefts`` are the bytes before the anchors, the nearest first. (0, 0): nothing is repeated.
    """
    n, after, before = len(rights), Suffixes(rights), Suffixes(lefts)
    best = [(0, 0)] * n

    def meet(i: int, j: int, right: int) -> None:
        left = before.common(i, j)
        if left + right >= length:
            for k in (i, j):
                best[k] = max(best[k][0], left), max(best[k][1], right)

    if n == 2:
        meet(0, 1, after.common(0, 1))
        return best
    order, turned = after.order(), before.order()
    rank = [0] * n
    for place, i in enumerate(turned):
        rank[i] = place
    home, group = list(range(n)), {i: [rank[i]] for i in range(n)}
    steps = sorted(((after.common(i, j), i, j) for i, j in zip(order, order[1:])), reverse=True)

    def find(i: int) -> int:
        while home[i] != i:
            home[i] = home[home[i]]
            i = home[i]
        return i

    for right, i, j in steps:
        small, large = sorted((find(i), find(j)), key=lambda k: len(group[k]))
        there = group[large]
        new = group.pop(small)
        for r in new:
            k = bisect_left(there, r)
            for other in there[max(0, k - 1): k + 1]:
                meet(turned[r], turned[other], right)
        for r in new:
            insort(there, r)
        home[small] = large
    return best


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for part in slices(batches, 1):
            data, offsets = text_bytes(part.column(1))
            text, place, key, context = anchors(data, offsets, length)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(text)), pa.array(place), pa.array(key), pa.array(context)],
                ["tid", "place", "key", "context"])

    return docs.select("tid", "text").mapInArrow(run, "tid binary, place long, key long, context long")


def _contexts(found: DataFrame, length: int) -> DataFrame:
    """``tid, text, wanted (array of place, key)`` to ``key, tid, place, before, after``."""
    def run(batches):
        for part in slices(batches, 1):
            out = [[], [], [], [], []]
            for tid, text, wanted in zip(*(c.to_pylist() for c in part.columns)):
                data = text.encode()
                for w in wanted:
                    p = w["place"]
                    for column, value in zip(out, (w["key"], tid, p, data[max(0, p - length + KEY): p][::-1], data[p: p + length])):
                        column.append(value)
            types = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["key", "tid", "place", "before", "after"])

    return found.select("tid", "text", "wanted").mapInArrow(run, "key long, tid binary, place long, before binary, after binary")


def _sorted_groups(contexts: DataFrame, length: int) -> DataFrame:
    """Repeated stretches of the members of each key."""
    def run(batches):
        def solve(group: dict):
            members = list(group.items())
            spans = widest([v[0] for _, v in members], [v[1] for _, v in members], length) if len(members) > 1 else []
            found = [(tid, place - left, place + right) for ((tid, place), _), (left, right) in zip(members, spans) if left + right]
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.int64()),
                                               pa.array([f[2] for f in found], pa.int64())], ["tid", "lo", "hi"])

        now, group = None, {}
        for part in batches:
            for key, tid, place, before, after in zip(*(c.to_pylist() for c in part.columns)):
                if key != now:
                    if len(group) > 1:
                        yield solve(group)
                    now, group = key, {}
                group[tid, place] = before, after
        yield solve(group)

    return contexts.repartition("key").sortWithinPartitions("key").mapInArrow(run, "tid binary, lo long, hi long")


def _counted_windows(contexts: DataFrame, length: int) -> DataFrame:
    """The same for keys with too many contexts for one task: every window is a row, equal windows are counted."""
    def run(batches):
        for part in batches:
            for key, tid, place, before, after in zip(*(c.to_pylist() for c in part.columns)):
                data = np.frombuffer(before[::-1] + after, np.uint8)
                starts = np.arange(max(0, len(data) - length + 1))
                one, two = (span_hash(prefix_hash(data, w), starts, starts + length, w).view(np.int64) for w in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array([tid] * len(starts), pa.binary()), pa.array(starts + place - len(before)),
                                                  pa.array(one), pa.array(two)], ["tid", "lo", "one", "two"])

    windows = stage(contexts.mapInArrow(run, "tid binary, lo long, one long, two long"), "windows")
    place = F.xxhash64("tid", "lo")
    twice = windows.groupBy("one", "two").agg(F.min(place).alias("x"), F.max(place).alias("y")).where("x != y").select("one", "two")
    return windows.join(twice, ["one", "two"]).select("tid", "lo", (F.col("lo") + length).alias("hi"))


def _remaining(found: DataFrame) -> DataFrame:
    """``tid, text, spans`` to ``tid, n_removed, n_spans, kept_sha256, spans``."""
    def run(batches):
        for part in slices(batches, 1):
            rows = []
            for tid, text, spans in zip(*(c.to_pylist() for c in part.columns)):
                data, kept, end, merged = text.encode(), hashlib.sha256(), 0, []
                for lo, hi in sorted((s["lo"], min(s["hi"], len(data))) for s in spans):
                    if merged and lo <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], hi)
                    else:
                        merged.append([lo, hi])
                for lo, hi in merged:
                    kept.update(data[end:lo])
                    end = hi
                kept.update(data[end:])
                rows.append((tid, sum(hi - lo for lo, hi in merged), len(merged), kept.hexdigest(), merged))
            types = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))]
            names = ["tid", "n_removed", "n_spans", "kept_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return found.select("tid", "text", "spans").mapInArrow(
        run, "tid binary, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400,
                      group_limit: int = GROUP_LIMIT) -> DataFrame:
    """``id_col, n_bytes, n_removed, n_spans, kept_sha256, spans``, one row for each row of ``docs``.

    A byte of a text (UTF-8) is removed if a string of ``length`` bytes that covers it also starts anywhere else, in the same
    text or another one; occurrences may overlap and all of them are removed. ``spans`` are the maximal removed stretches
    ``[start, end)`` in bytes, ``kept_sha256`` is the hash of the remaining bytes.

    A null or empty text has no bytes. Texts shorter than ``length`` keep all bytes, repeated or not; a longer text that
    two rows have is removed whole (also if the rows have one id or a null id). Other columns are not looked at. Without rows the
    result is empty. ``length`` must be larger than the 64 bytes of a key.
    """
    if length <= KEY:
        raise ValueError(f"length must be over {KEY}")
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("sha"))
    source = source.withColumn("tid", F.substring("sha", 1, 16))
    rows = stage(source.select("id", "sha", "tid", F.octet_length("text").cast("long").alias("n_bytes")), "rows")
    known = stage(rows.where(F.col("n_bytes") >= length).groupBy("tid").agg(
        F.count("*").alias("copies"), F.min("id").alias("first_id")), "texts")

    everywhere = stage(_anchor_rows(source.where(F.octet_length("text") >= length), length), "anchors")
    twice = everywhere.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    shared = stage(everywhere.join(twice, "key", "left_semi"), "shared-anchors")
    start = F.greatest(F.lit(0), F.col("place") - (length - KEY))
    where = F.struct("tid", start.alias("lo"), "place")
    contexts = stage(shared.groupBy("key", "context").agg(F.min(where).alias("a"), F.max(where).alias("b")).select(
        "key", "context", "a.tid", "a.place",
        ((F.col("a.tid") != F.col("b.tid")) | (F.col("a.lo") != F.col("b.lo"))).alias("many")), "contexts")
    whole = shared.join(contexts.where("many").select("key", "context"), ["key", "context"]).select(
        "tid", start.alias("lo"), (F.col("place") + length).alias("hi"))

    groups = contexts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    wanted = contexts.join(groups, "key").groupBy("tid").agg(F.collect_list(F.struct("place", "key", "n")).alias("wanted"))
    wanted = wanted.join(known, "tid").select("tid", "first_id", "wanted")
    found = source.join(wanted, "tid").where(F.col("id").eqNullSafe(F.col("first_id")))
    members = stage(_contexts(found, length), "members")
    hot = groups.where(F.col("n") > group_limit).select("key")
    if hot.isEmpty():
        stretches = _sorted_groups(members, length)
    else:
        stretches = _sorted_groups(members.join(hot, "key", "left_anti"), length).union(
            _counted_windows(members.join(hot, "key", "left_semi"), length))
    spans = whole.union(stretches).groupBy("tid").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))

    single = spans.join(known.where("copies = 1").select("tid"), "tid")
    partly = _remaining(source.join(single, "tid"))
    copied = known.where("copies > 1").select("tid", F.lit(True).alias("copied"))
    out = rows.join(copied, "tid", "left").join(partly, "tid", "left")
    gone = F.col("copied").isNotNull()
    return out.select(
        F.col("id").alias(id_col), "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, EMPTY_SHA).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
        F.when(gone, F.array(F.array(F.lit(0).cast("long"), F.col("n_bytes")))).otherwise(
            F.coalesce("spans", F.array().cast("array<array<long>>"))).alias("spans"))
