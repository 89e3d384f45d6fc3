"""Prefix trie of conversations: sorted sequences, common prefixes of neighbours, union-find in falling depth.

1. A turn becomes a 16-byte key of its role and text and its number of text bytes. Turns are numbered by a sort over all partitions,
   so no conversation has to fit into a task, and put into blocks of ``BLOCK`` turns. A block knows a hash of all turns before it
   (``before``); blocks with the same hash hang below one node. Equal blocks are one row with a count from here on.
2. The blocks are sorted by ``before`` and their keys. Each partition links neighbours by the length of their common prefix and joins
   them by union-find, the longest first: every union of two components makes a branching node, the stretch above a component gives the nodes
   with one child.
3. Only nodes on the path to the first or the last sequence of a partition can go on in a neighbour. They are contracted to one row
   each (members and sums of the finished subtrees below them), merged over the boundaries by their path, and their totals are summed
   up to their ancestors. There are at most two paths for each partition.
4. Deeper blocks come first: what hangs below a full block goes to its last node. A block whose turns before it are those of a single
   conversation needs none of this: its nodes are a chain.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from storegrain.session import ship, stage

BLOCK = 32
PIECE = 1 << 16
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def turn_keys(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, key, size``: the turns of each conversation from 0, with a hash of role and text and the text's bytes.

    The order is by turn (nulls first), of one turn by the hash. A null role or text is empty. Rows with a null ``conv_id`` belong to no
    conversation and have no place here. The numbers come from a sort over all partitions: only the first conversation of a partition can have begun
    in one before, so what is added to it is known from one count for each partition.
    """
    ship(conversations.sparkSession)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), key.alias("key"), F.octet_length(text).cast("long").alias("size"))
    rows = rows.where("conv_id is not null").withColumn("spread", F.xxhash64(F.monotonically_increasing_id()))
    order = ["conv_id", F.asc_nulls_first("turn"), "key", "spread"]

    def run(batches):
        part, head, now, count = TaskContext.get().partitionId(), None, None, 0
        for batch in batches:
            places, first = [], []
            for conv in batch.column(0).to_pylist():
                if conv != now:
                    head, now, count = (conv if head is None else head), conv, 0
                places.append(count)
                first.append(conv == head)
                count += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64()), pa.array(first, pa.bool_()), pa.array([part] * len(places), pa.int64())],
                                             ["conv_id", "key", "size", "place", "first", "part"])

    local = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "key", "size").mapInArrow(
        run, "conv_id long, key binary, size long, place long, first boolean, part long"), "turn-keys")
    heads = local.where("first").select("conv_id").distinct()  # one row for each partition at most
    counts = local.join(F.broadcast(heads), "conv_id", "left_semi").groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    added = counts.select("conv_id", "part", F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("added"))
    return local.join(F.broadcast(added.where("added > 0")), ["conv_id", "part"], "left").select(
        "conv_id", (F.col("place") + F.coalesce("added", F.lit(0))).alias("pos"), "key", "size")


def _chained(blocks: DataFrame) -> DataFrame:
    """``conv_id, block, before, sid``: hashes of all turns before a block and of those up to its end, for conversations of several blocks."""
    def run(batches):
        now, before = None, b""
        for part in batches:
            out = [[], []]
            for conv, own in zip(part.column(0).to_pylist(), part.column(2).to_pylist()):
                if conv != now:
                    now, before = conv, b""
                out[0].append(before)
                before = hashlib.sha256(before + own).digest()
                out[1].append(before)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, pa.binary()) for c in out)], ["conv_id", "block", "before", "sid"])

    return blocks.select("conv_id", "block", "own").repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(
        run, "conv_id long, block long, before binary, sid binary")


def joined_hashes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, joined_sha``: SHA-256 of the ascending ``conv_id`` of each group in decimal, joined by commas.

    The ids are sorted over all partitions and joined to pieces there; one task then reads the pieces of a group in order.
    """
    ddl = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    types = [to_arrow_type(rows.schema[k].dataType) for k in keys]

    def pieces(batches):
        number, no, now, ids, size, out = TaskContext.get().partitionId() << 32, 0, None, [], 0, []

        def close():
            nonlocal no, ids, size
            out.append((*now, number + no, ",".join(ids)))
            no, ids, size = no + 1, [], 0

        def batch():
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate([*types, pa.int64(), pa.string()])], [*keys, "no", "piece"])
            out.clear()
            return made

        for part in batches:
            for *key, conv in zip(*(c.to_pylist() for c in part.columns)):
                if ids and (key != now or size >= PIECE):
                    close()
                now = key
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            yield batch()
        if ids:
            close()
            yield batch()

    def hashes(batches):
        now, state = None, None
        for part in batches:
            out = []
            for *key, _, piece in zip(*(c.to_pylist() for c in part.columns)):
                if key != now:
                    if now is not None:
                        out.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate([*types, pa.string()])], [*keys, "joined_sha"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*now, state.hexdigest()), [*types, pa.string()])], [*keys, "joined_sha"])

    parts = rows.select(*keys, "conv_id").repartitionByRange(*keys, "conv_id").sortWithinPartitions(*keys, "conv_id").mapInArrow(
        pieces, f"{ddl}, no long, piece string")
    return parts.repartition(*keys).sortWithinPartitions(*keys, "no").mapInArrow(hashes, f"{ddl}, joined_sha string")


NODE, UNDER_OPEN, OPEN, ROOT = range(4)
FOREST = ("kind int, before binary, path array<binary>, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
          "saved long, size long, ends string")


class Component:
    """Sequences that are joined: the node at ``depth`` above them, without what is counted for that node itself."""

    __slots__ = ("row", "depth", "n", "low", "kids", "leaves", "saved", "ends", "open", "waiting")

    def __init__(self, row, keys, n, low, ends, kids, leaves, saved, is_open):
        self.row, self.depth, self.n, self.low, self.ends = row, len(keys), n, low, ends
        self.kids, self.leaves, self.saved, self.open, self.waiting = kids, leaves, saved, is_open, []


def common(a: list, b: list) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def forest(before: bytes, rows: list[tuple], left_open: bool, right_open: bool, out: list) -> None:
    """Nodes of the sorted sequences of one group (keys, sizes, n, low, ends, children, leaves and saved bytes below): appended to ``out``.

    Nodes that lead to an open end of the group are given as parts (``OPEN``), finished nodes below them name the parent's path.
    """
    last = len(rows) - 1
    parts = [Component(i, r[0], r[2], r[3], r[4], r[5], r[6], r[7], left_open and i == 0 or right_open and i == last) for i, r in enumerate(rows)]
    home = list(range(len(rows)))

    def find(i: int) -> int:
        while home[i] != i:
            home[i] = home[home[i]]
            i = home[i]
        return i

    def settle(c: Component) -> tuple | None:
        """Give out the node at the component's depth; its row if it waits for its parent."""
        keys, sizes = rows[c.row][:2]
        size = sizes[c.depth - 1] if c.depth else 0
        if c.open:
            path = keys[: c.depth]
            out.append((OPEN, before, path, c.depth, c.low, None, c.n, c.kids, c.leaves if c.kids else 0, c.saved, size, c.ends))
            out.extend((UNDER_OPEN, before, path, *w[3:]) for w in c.waiting)
            return None
        leaves, saved = c.leaves if c.kids else 1, c.saved + (c.n - 1) * size
        out.extend((*w[:5], c.low, *w[6:]) for w in c.waiting)
        return NODE, before, None, c.depth, c.low, None, c.n, c.kids, leaves, saved, size, c.ends

    def climb(c: Component, depth: int) -> None:
        while c.depth > depth:
            node = settle(c)
            c.depth, c.ends = c.depth - 1, None
            c.kids, c.leaves, c.saved, c.waiting = (0, 0, 0, []) if node is None else (1, node[8], node[9], [node])

    edges = sorted(((common(rows[i][0], rows[i + 1][0]), i) for i in range(last)), key=lambda e: -e[0])
    for depth, i in edges:
        a, b = find(i), find(i + 1)
        x, y = parts[a], parts[b]
        climb(x, depth)
        climb(y, depth)
        if len(x.waiting) < len(y.waiting):
            a, b, x, y = b, a, y, x
        home[b] = a
        x.n, x.low, x.ends = x.n + y.n, min(x.low, y.low), x.ends or y.ends
        x.kids, x.leaves, x.saved, x.open = x.kids + y.kids, x.leaves + y.leaves, x.saved + y.saved, x.open or y.open
        x.waiting += y.waiting
        parts[b] = None
    top = parts[find(0)]
    climb(top, 0)
    root = settle(top)
    if root is not None:
        out.append((ROOT, *root[1:]))


def _forests(sequences: DataFrame) -> DataFrame:
    types = [pa.int32(), pa.binary(), pa.list_(pa.binary()), *([pa.int64()] * 8), pa.string()]
    names = [f.split()[0] for f in FOREST.split(", ")]

    def run(batches):
        def made(out):
            for lo in range(0, len(out), 4096):
                some = out[lo: lo + 4096]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in some], t) for i, t in enumerate(types)], names)

        now, group, first = None, [], True
        for batch in batches:
            for before, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if before != now and group:
                    out = []
                    forest(now, group, first, False, out)
                    yield from made(out)
                    group, first = [], False
                now = before
                group.append(tuple(row))
        if group:
            out = []
            forest(now, group, first, True, out)
            yield from made(out)

    order = ["before", "keys"]
    return sequences.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "before", "keys", "sizes", "n", "low", "ends", "kids", "leaves", "saved").mapInArrow(run, FOREST)


RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _level(sequences: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of the blocks of one level and the roots of their groups (``before, kids, leaves, saved, ends``)."""
    found = stage(_forests(sequences), "forest")
    opened = stage(found.where(F.col("kind") == OPEN).groupBy("before", "path").agg(
        F.sum("n_convs").alias("n"), F.min("conv_id").alias("low"), F.sum("n_children").alias("kids"), F.sum("n_leaves").alias("leaves"),
        F.sum("saved").alias("saved"), F.max("size").alias("size"), F.max("ends").alias("ends")), "open-nodes")
    above = F.expr("slice(path, 1, size(path) - 1)")
    inner = opened.where("size(path) > 0").select("before", above.alias("path"), F.lit(1).alias("one"))
    whole = opened.join(inner.groupBy("before", "path").agg(F.count("*").alias("more")), ["before", "path"], "left")
    whole = whole.withColumn("kids", F.col("kids") + F.coalesce("more", F.lit(0)))
    gives = whole.select("before", F.explode(F.transform(F.sequence(F.lit(0), F.size("path")), lambda i: F.slice("path", 1, i))).alias("path"),
                         (F.col("leaves") + F.when(F.col("kids") == 0, 1).otherwise(0)).alias("leaves"),
                         (F.col("saved") + (F.col("n") - 1) * F.col("size")).alias("saved"))
    totals = gives.groupBy("before", "path").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    closed = whole.drop("leaves", "saved").join(totals, ["before", "path"])
    parents = opened.select("before", "path", F.col("low").alias("parent_conv_id"))
    depth = F.lit(BLOCK * block)
    paths = closed.where("size(path) > 0").select("*", above.alias("up")).join(
        parents.select(F.col("before").alias("b"), F.col("path").alias("p"), "parent_conv_id"), (F.col("before") == F.col("b")) & (F.col("up") == F.col("p")))
    open_nodes = paths.select(F.col("low").alias("conv_id"), (F.size("path") + depth).cast("long").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"),
                              F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))
    plain = ["conv_id", (F.col("depth") + depth).alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
             F.col("ends").alias("ends_sha256")]
    under = found.where(F.col("kind") == UNDER_OPEN).drop("parent_conv_id").join(F.broadcast(parents), ["before", "path"])  # two paths of BLOCK nodes a partition at most
    nodes = found.where(F.col("kind") == NODE).select(*plain).unionByName(under.select(*plain)).unionByName(open_nodes)
    roots = closed.where("size(path) = 0").select("before", "kids", "leaves", "saved", "ends", "low", "n").unionByName(
        found.where(F.col("kind") == ROOT).select("before", F.col("n_children").alias("kids"), F.col("n_leaves").alias("leaves"), "saved", "ends",
                                                  F.col("conv_id").alias("low"), F.col("n_convs").alias("n")))
    return nodes, roots


def trie_nodes(turns: DataFrame, members: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of ``turns`` (``conv_id, pos, key, size``, see ``turn_keys``).

    A node of depth d is a distinct sequence of first d turns; its members are the conversations that start with it. One row a node:
    ``conv_id`` (its smallest member), ``depth``, ``parent_conv_id`` (null at the root), ``n_convs`` (members), ``n_children``, ``n_leaves``
    (childless nodes in its subtree, itself included), ``saved_tokens`` (summed over its subtree: (members - 1) times the size of the last turn),
    ``ends_sha256`` (of the ascending ids, comma-joined, of members that end there).

    ``members`` are all conversations (``conv_id``, distinct), also those without turns, which end at the root. Without members there is
    no node. Null ids are no members. Turns are equal if their 16-byte keys are.
    """
    ship(turns.sparkSession)
    lengths = members.where("conv_id is not null").join(turns.groupBy("conv_id").agg((F.max("pos") + 1).alias("n")), "conv_id", "left").select(
        "conv_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    lengths = stage(lengths, "lengths")
    empty = F.array().cast("array<struct<pos:long,key:binary,size:long>>")
    blocks = turns.groupBy("conv_id", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "key", "size"))).alias("t"))
    blocks = blocks.unionByName(lengths.where(F.col("n") % BLOCK == 0).select("conv_id", F.floor(F.col("n") / BLOCK).alias("block"), empty.alias("t")))
    own = F.unhex(F.sha2(F.array_join(F.transform("t.key", F.hex), ""), 256))
    blocks = stage(blocks.join(lengths, "conv_id").select("conv_id", "block", F.col("t.key").alias("keys"), F.col("t.size").alias("sizes"), own.alias("own"),
                                                          (F.col("n") < BLOCK * (F.col("block") + 1)).alias("last"), "n"), "blocks")
    long_ones = F.col("n") >= BLOCK
    chain = _chained(blocks.where(long_ones))
    nothing = F.lit(b"")
    whole = stage(blocks.where(~long_ones).select("*", nothing.alias("before"), F.lit(None).cast("binary").alias("sid")).unionByName(
        blocks.where(long_ones).join(chain, ["conv_id", "block"])), "chained-blocks")
    groups = stage(whole.where("block > 0").groupBy("block", "before").agg(F.count("*").alias("group_size"), F.min("conv_id").alias("only")), "groups")

    # chains below a prefix that one conversation has
    deep = whole.where("block > 0").join(groups.where("group_size = 1").select("block", "before"), ["block", "before"])
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    at_end = F.col("depth") == F.col("n")
    alone = deep.select("conv_id", "n", F.explode(F.transform("keys", lambda k, i: (F.col("block") * BLOCK + i + 1).cast("long"))).alias("depth"))
    nodes = alone.select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"), F.when(at_end, none).otherwise(one).alias("n_children"),
                         one.alias("n_leaves"), none.alias("saved_tokens"), F.when(at_end, F.sha2(F.col("conv_id").cast("string"), 256)).alias("ends_sha256"))
    single = deep.select("before", F.when(F.size("keys") > 0, one).otherwise(none).alias("kids"), one.alias("leaves"), none.alias("saved"),
                         F.when(F.size("keys") == 0, F.sha2(F.col("conv_id").cast("string"), 256)).alias("ends"), "block")

    same = whole.where("block = 0").unionByName(whole.where("block > 0").join(groups.where("group_size > 1").select("block", "before"), ["block", "before"]).select(whole.columns))
    counted = same.groupBy("block", "before", "own").agg(
        F.first("keys").alias("keys"), F.first("sizes").alias("sizes"), F.first("sid").alias("sid"), F.count("*").alias("n"), F.min("conv_id").alias("low"),
        F.count(F.when(F.col("last"), 1)).alias("n_end"), F.min(F.when(F.col("last"), F.col("conv_id"))).alias("ending"))
    counted = stage(counted, "sequences")
    many = counted.where("n_end > 1").select("block", "before", "own")
    hashes = joined_hashes(same.where("last").join(many, ["block", "before", "own"], "left_semi"), ["block", "before", "own"])
    counted = stage(counted.join(hashes, ["block", "before", "own"], "left").withColumn(
        "ends", F.coalesce("joined_sha", F.when(F.col("n_end") == 1, F.sha2(F.col("ending").cast("string"), 256)))), "ended-sequences")

    deepest = groups.where("group_size > 1").agg(F.max("block")).first()[0] or 0
    singles = stage(single, "single-groups") if deepest or not groups.isEmpty() else None
    below = None
    for block in range(deepest, -1, -1):
        level = counted.where(F.col("block") == block).select("before", "keys", "sizes", "n", "low", F.col("ends").alias("own_ends"), "sid")
        if singles is not None:
            known = singles.where(F.col("block") == block + 1).drop("block")
            known = known.unionByName(below.select(*known.columns)) if below is not None else known
            level = level.join(known.withColumnRenamed("before", "sid"), "sid", "left")
        else:
            level = level.withColumns({"kids": none, "leaves": none, "saved": none, "ends": F.lit(None).cast("string")})
        filled = {c: F.coalesce(c, none) for c in ("kids", "leaves", "saved")} | {"ends": F.coalesce("own_ends", "ends")}
        more, below = _level(level.withColumns(filled), block)
        nodes = nodes.unionByName(more)
        below = stage(below, "roots") if block else below
    root = below.where("before = x''").select(
        F.col("low").alias("conv_id"), none.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"),
        F.greatest("leaves", F.lit(1)).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))
    out = nodes.unionByName(root)
    return out.select(*RESULT[:-1], F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of ``conversations`` (``conv_id, turn, role, text``) as they are; see ``turn_keys`` for order and nulls, ``trie_nodes`` for the result."""
    turns = turn_keys(conversations)
    return trie_nodes(turns, conversations.select(F.col("conv_id").cast("long")).where("conv_id is not null").distinct())


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and members of the query's rebuilt conversations: the first h turns of conversation c - c % 5, then the own ones after the first h."""
    lengths = stage(turns.groupBy("conv_id").agg((F.max("pos") + 1).alias("n")), "own-lengths")
    ids = lengths.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("source"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).alias("h"))
    ids = ids.join(lengths.select(F.col("conv_id").alias("source"), F.col("n").alias("there")), "source", "left")
    ids = stage(ids.withColumn("taken", F.least("h", F.coalesce("there", F.lit(0)))), "rebuilt-ids")
    head = ids.join(turns.where("pos < 9").withColumnRenamed("conv_id", "source"), "source").where("pos < h").select("conv_id", "pos", "key", "size")
    tail = turns.join(ids.select("conv_id", "h", "taken"), "conv_id").where("pos >= h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "key", "size")
    return head.unionByName(tail), ids.select("conv_id")
