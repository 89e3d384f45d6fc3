"""Near duplicates: hash minima in bands, signature check, confirmation on full sets, connected components.

1. Every text becomes the set of its word shingles (64-bit hashes). Documents with the same set are one class, so
   groups of copies cost one row from here on.
2. ``BANDS * ROWS`` universal hashes give the minima; ``ROWS`` minima make the key of a band. At a likeness of 0.8 a pair
   shares no band with a chance of 1e-7, at 0.85 of 7e-11.
3. In each bucket the class that sits in the largest buckets is the centre. Other members are held against it (a star, as many
   pairs as members). What is already connected then needs no further test; only members of one bucket that are still in
   different components are paired with each other. Buckets of more than ``REFINE_ABOVE`` classes are first divided by each other
   band: a pair that the star leaves apart and that shares no small bucket needs two shared bands. At a likeness of 0.8 it has
   less with a chance of 2.6e-6, at 0.85 of 2.1e-9.
4. A pair goes on if one bit of each of its minima (200 of them) agrees often enough, six deviations below what is
   expected at the threshold, and if the parities of its sets over ``PARITIES`` cells differ in no more cells than the sets may
   differ in elements (they never do). It counts if the full sets agree, in whole numbers.
5. Links are joined to components by alternating large-star and small-star.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storegrain.llm.common import LOWER, SPACED, mix, slices, text_bytes, word_hashes
from storegrain.llm.components import connected_components
from storegrain.session import ship, stage

BANDS, ROWS = 40, 5
#: Half the bands: of two bands one is at most so many behind the other, around the end, so each two of them are a turn.
REFINE_ABOVE, REFINE_BY = 64, BANDS // 2
WORDS_IN_PART = 50
PARITIES = 1024
#: The multipliers and offsets of the universal hashes come from a seeded generator.
SEED = 20240229


def _universal() -> tuple[np.ndarray, np.ndarray]:
    draws = np.random.default_rng(SEED).integers(0, 2**63, (2, BANDS * ROWS), dtype=np.uint64)
    return draws[0] * np.uint64(2) + np.uint64(1), draws[1]


def shingle_sets(column: pa.Array, k: int):
    """For each text the sorted distinct 64-bit hashes of its ``k``-word shingles; of all words if there are fewer."""
    data, offsets = text_bytes(column)
    hashes, first = word_hashes(LOWER[data], offsets, SPACED)
    factors = np.array([pow(0x9FB21C651E98DF25, j + 1, 2**64) for j in range(k)], np.uint64)
    grams = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
    for j in range(k):
        grams += hashes[j: j + len(grams)] * factors[j]
    mix(grams)
    for i in range(len(offsets) - 1):
        lo, hi = int(first[i]), int(first[i + 1])
        if hi - lo >= k:
            yield np.unique(grams[lo: hi - k + 1])
        elif hi > lo:
            short = (hashes[lo:hi] * factors[: hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo)
            yield mix(np.array([short], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def minima(grams: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 2048) -> np.ndarray:
    """Least value of each universal hash (upper 32 bits) over a set."""
    out = np.full(len(a), 2**64 - 1, np.uint64)
    for lo in range(0, len(grams), step):
        np.minimum(out, (a[:, None] * grams[None, lo: lo + step] + b[:, None]).min(axis=1), out=out)
    return out >> np.uint64(32)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def profiles(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """``id, text_hash, n, set_1, set_2, bands, bits``: size, identity and signature of each row's shingle set."""
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    id_type = source.schema["id"].dataType

    def run(batches):
        a, b = _universal()
        parts = np.arange(BANDS * ROWS).reshape(4, -1) % WORDS_IN_PART
        factors = np.array([pow(0xA0761D6478BD642F, j + 1, 2**64) for j in range(ROWS)], np.uint64)
        for part in slices(batches, 2):
            rows = len(part)
            n, ones, twos = np.zeros(rows, np.int64), np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
            bands, bits = np.zeros((rows, BANDS), np.uint64), np.zeros((rows, 4 + PARITIES // 64), np.uint64)
            for i, grams in enumerate(shingle_sets(part.column(2), k)):
                n[i] = len(grams)
                if len(grams):
                    least = minima(grams, a, b)
                    ones[i], twos[i] = grams.sum(dtype=np.uint64), mix(grams ^ np.uint64(SEED)).sum(dtype=np.uint64)
                    bands[i] = mix((least.reshape(BANDS, ROWS) * factors).sum(axis=1, dtype=np.uint64)
                                   + np.arange(BANDS, dtype=np.uint64))
                    odd = mix(least * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(1)
                    bits[i, :4] = (odd.reshape(4, -1) << parts.astype(np.uint64)).sum(axis=1, dtype=np.uint64)
                    cells = np.bincount((grams % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
                    bits[i, 4:] = np.packbits(cells.astype(np.uint8)).view(np.uint64)
            lists = [pa.ListArray.from_arrays(np.arange(rows + 1, dtype=np.int32) * x.shape[1], _signed(x).ravel())
                     for x in (bands, bits)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(n), pa.array(_signed(ones)), pa.array(_signed(twos)), *lists],
                ["id", "text_hash", "n", "set_1", "set_2", "bands", "bits"])

    return source.mapInArrow(run, f"id {id_type.simpleString()}, text_hash long, n long, set_1 long, set_2 long, "
                                  "bands array<long>, bits array<long>")


def _may_link(percent: int):
    """Size ratio, agreement of the signature bits and differing parities of ``l`` and ``r``."""
    share = (1 - percent / 100) / 2
    limit = math.ceil(BANDS * ROWS * share + 6 * math.sqrt(BANDS * ROWS * share * (1 - share)))

    def differ(lo: int, hi: int):
        return reduce(lambda x, y: x + y, [F.bit_count(F.col("l.bits")[i].bitwiseXOR(F.col("r.bits")[i])) for i in range(lo, hi)])

    sizes = F.least("l.n", "r.n") * 100 >= F.greatest("l.n", "r.n") * percent
    # 100 * shared >= percent * united, written with the number of elements that differ
    parity = differ(4, 4 + PARITIES // 64) * (100 + percent) <= (F.col("l.n") + F.col("r.n")) * (100 - percent)
    return sizes & (differ(0, 4) <= limit) & parity


def confirm(pairs: DataFrame, docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """The pairs ``u, v`` of classes whose full sets have ``100 * shared >= percent * united``."""
    pairs = stage(pairs, "candidate-pairs")
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(classes, "node").select("node", "id", "text_hash")
    texts = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    found = texts.join(wanted, F.col("id").eqNullSafe(F.col("doc")) & (F.col("text_hash") == F.col("hash")))

    def to_sets(batches):
        for part in slices(batches, 1):
            sets = [s.tobytes() for s in shingle_sets(part.column(1), k)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["node", "grams"])

    sets = stage(found.select("node", "text").mapInArrow(to_sets, "node long, grams binary").dropDuplicates(["node"]), "sets")

    def agree(batches):
        for part in batches:
            left, right, keep = part.column(2), part.column(3), []
            for i in range(len(part)):
                x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (left, right))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    one, two = (sets.select(F.col("node").alias(x), F.col("grams").alias(f"grams_{x}")) for x in "uv")
    both = pairs.join(two, "v").join(one, "u").select("u", "v", "grams_u", "grams_v")
    return stage(both.mapInArrow(agree, "u long, v long"), "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``id_col, n_shingles, component_id, kept``, one row for each row of ``docs``.

    Words are runs without white space, A-Z in lower case; two texts are linked if the Jaccard likeness of their sets of
    ``k``-word shingles is ``percent`` or more. ``component_id`` is the smallest id that links lead to; the row with that id is kept.

    A text with fewer than ``k`` words is one shingle; a null, empty or blank text has none, is linked with nothing and is its own
    component. Rows with the same text are linked. Repeated ids stay repeated and all rows of the smallest id are kept. A null id is
    no smallest id where there is another; a group of null ids only has a null component and is kept.
    Other columns are not looked at. Without rows the result is empty.
    """
    ship(docs.sparkSession)
    rows = stage(profiles(docs, id_col, text_col, k).withColumn("row", F.monotonically_increasing_id()), "profiles")
    full = rows.where("n > 0")
    key = ["n", "set_1", "set_2"]
    classes = stage(full.groupBy(*key).agg(
        F.min(F.struct("row", "id", "text_hash", "bands", "bits")).alias("first"), F.min("id").alias("least_id"))
        .select(F.col("first.row").alias("node"), *key, "first.id", "first.text_hash", "first.bands", "first.bits", "least_id"), "classes")
    members = classes.select("node", F.posexplode("bands").alias("band", "key"))
    buckets = stage(members.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    placed = stage(members.join(buckets, ["band", "key"]), "placed")
    weight = placed.groupBy("node").agg(F.sum("size").alias("weight"))
    light = classes.select("node", "n", "bits")
    weighted = stage(placed.select("band", "key", "node", "size").join(weight, "node").join(light, "node"), "weighted")
    centres = weighted.groupBy("band", "key").agg(F.max(F.struct("weight", -F.col("node"), "n", "bits")).alias("c")).select(
        "band", "key", (-F.col("c.col2")).alias("node"), "c.n", "c.bits")
    ends = F.least("l.node", "r.node").alias("u"), F.greatest("l.node", "r.node").alias("v")
    same = (F.col("l.band") == F.col("r.band")) & (F.col("l.key") == F.col("r.key"))
    star = weighted.alias("l").join(centres.alias("r"), same & (F.col("l.node") != F.col("r.node")) & _may_link(percent)).select(*ends).distinct()
    links = confirm(star, docs, classes, id_col, text_col, k, percent)
    parts = stage(connected_components(links), "parts")

    apart = weighted.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component", "weight")
    mixed = apart.groupBy("band", "key").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x < y").select("band", "key")
    apart = apart.join(mixed, ["band", "key"])
    finer = F.transform(F.sequence(F.lit(1), F.lit(REFINE_BY)), lambda j: F.struct(
        j.alias("turn"), F.element_at("bands", ((F.col("band") + j) % BANDS + 1).cast("int")).alias("more")))
    small = apart.where(F.col("size") <= REFINE_ABOVE).select("*", F.lit(0).alias("turn"), F.lit(0).cast("long").alias("more"))
    large = apart.where(F.col("size") > REFINE_ABOVE).join(classes.select("node", "bands"), "node").select(
        *apart.columns, F.explode(finer).alias("f")).select(*apart.columns, "f.turn", "f.more")
    rest = stage(small.unionByName(large), "rest")
    there = same & (F.col("l.turn") == F.col("r.turn")) & (F.col("l.more") == F.col("r.more"))
    cross = rest.alias("l").join(rest.alias("r"), there & (F.col("l.node") < F.col("r.node")) & (F.col("l.part") != F.col("r.part"))
                                 & _may_link(percent)).select(*ends).distinct().join(star, ["u", "v"], "left_anti")
    more = confirm(cross, docs, classes, id_col, text_col, k, percent)
    final = connected_components(links.union(more))

    named = classes.join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_set = named.join(least, "component").select(*key, "component_id")
    out = rows.select("id", *key).join(by_set, key, "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("id").eqNullSafe(component).alias("kept"))
