"""Shards by a hierarchical weighted hash tree: region, rack, shard.

At each level every child draws a hash of the key and its own place; the draw is stretched by the child's weight (-log u / w) and
the least one wins. A child's weight is the sum of what is below it. If the weight of a subtree changes, keys move only into it
or out of it: the draws of all others stay. A new shard is put into a region of its own, so that it alone takes keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storegrain.session import stage

#: Rows of one numbering block; a block is one sort in one task.
BLOCK_ROWS = 200_000


@dataclass(frozen=True)
class Tree:
    """Weights of shards by region and rack, as nested tuples; shards are numbered from 0 in this order."""

    regions: tuple[tuple[tuple[float, ...], ...], ...]

    @property
    def shards(self) -> int:
        return sum(len(rack) for region in self.regions for rack in region)

    def grown(self, weight: float = 1.0) -> Tree:
        """The tree with one more shard, in a region of its own."""
        return Tree((*self.regions, ((weight,),)))


#: Shards 0 to 23: three regions of two racks of four shards of equal weight.
DEFAULT = Tree((((1.0,) * 4,) * 2,) * 3)


def _draw(key: Column, level: str, place: list, weight: Column) -> Column:
    """-log(u) / weight, u in (0, 1] from 53 bits of a hash; infinite without weight."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(level), *place), 11)
    return F.when(weight > 0, -F.log((bits + 1).cast("double") / F.lit(float(2**53))) / weight)


def _choose(key: Column, level: str, path: list, weights: Column, most: int) -> Column:
    """Number of the child with the least draw; ``weights`` is an array of at most ``most`` weights."""
    draws = [F.struct(F.coalesce(_draw(key, level, [*path, F.lit(i)], F.get(weights, F.lit(i))), F.lit(float("inf"))).alias("draw"),
                      F.lit(i).alias("child")) for i in range(most)]
    return F.least(*draws)["child"] if most > 1 else F.lit(0)


def _arrays(values) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def with_shard(df: DataFrame, key: Column, tree: Tree, name: str) -> DataFrame:
    """``df`` with the shard of each row: three draws, no shuffle; equal keys have equal shards, nulls too."""
    total = lambda region: sum(sum(rack) for rack in region)
    region, rack, leaf = f"__{name}_region", f"__{name}_rack", f"__{name}_leaf"
    df = df.withColumn(region, _choose(key, "region", [], _arrays(total(r) for r in tree.regions), len(tree.regions)))
    racks = F.array(*(_arrays(sum(k) for k in r) for r in tree.regions))
    df = df.withColumn(rack, _choose(key, "rack", [F.col(region)], F.get(racks, F.col(region)), max(len(r) for r in tree.regions)))
    leaves = F.array(*(F.array(*(_arrays(k) for k in r)) for r in tree.regions))
    df = df.withColumn(leaf, _choose(key, "shard", [F.col(region), F.col(rack)], F.get(F.get(leaves, F.col(region)), F.col(rack)),
                                     max(len(k) for r in tree.regions for k in r)))
    starts, at = [], 0
    for r in tree.regions:
        starts.append([])
        for k in r:
            starts[-1].append(at)
            at += len(k)
    first = F.array(*(F.array(*(F.lit(s) for s in r)) for r in starts))
    shard = F.get(F.get(first, F.col(region)), F.col(rack)) + F.col(leaf)
    return df.withColumn(name, shard.cast("int")).drop(region, rack, leaf)


def numbered(df: DataFrame, group: str, row: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with ``slot``: 0, 1, 2 ... in each group, without a gap.

    Rows are numbered in blocks by a hash of ``row`` (distinct numbers), so that a large group is many small sorts; a count for each
    block is added up, and those are few.
    """
    blocks = max(1, -(-df.count() // block_rows))
    df = df.withColumn("__block", F.pmod(F.xxhash64(row), F.lit(blocks)))
    counts = df.groupBy(group, "__block").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col(group).alias("__group"), F.col("__block").alias("__at"), before.alias("__before"))
    place = F.row_number().over(Window.partitionBy(group, "__block").orderBy(row)) - 1
    out = df.withColumn("__place", place).join(offsets, (F.col(group) == F.col("__group")) & (F.col("__block") == F.col("__at")))
    return out.withColumn("slot", (F.col("__before") + F.col("__place")).cast("long")).drop(
        "__block", "__place", "__group", "__at", "__before")


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tree: Tree = DEFAULT,
                    grown: Tree | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``id_col, size, text_crc32, law, shard, slot, grown_shard``, one row for each row of ``docs``.

    The shard depends on the id and the tree only (law ``key``); ``grown_shard`` is the shard in the tree with one more.
    ``size``: bytes of the text plus 8; ``slot``: gapless from 0 in each shard. A null id is an id like any other, so such rows share a
    shard; rows with one id do too. A null text is an empty one. Other columns are not looked at; no rows, no result.
    """
    grown = grown or tree.grown()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"),
                       F.crc32(text).cast("long").alias("text_crc32"))
    rows = with_shard(with_shard(rows, F.col("id"), tree, "shard"), F.col("id"), grown, "grown_shard")
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "sharded")
    return numbered(rows, "shard", "row", block_rows).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
