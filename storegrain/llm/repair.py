"""Conversation structure repair: the cheapest edits that give a conversation a legal order of roles, by a run-length DP.

1. Rows are sorted over all partitions by conversation and turn and cut into *chunks* of bounded size, so a conversation of any length
   is shared by many tasks. One that begins and ends inside a chunk is *alone* and is solved where it stands.
2. A row becomes a symbol: first letter of its role and what its fault asks for. A symbol is a 4x4 min-plus matrix over the role
   states (nothing yet, system, user, assistant). Equal neighbours are a run; a run of k rows is passed with the cached binary
   powers of its matrix.
3. For conversations of several chunks, only the matrices go on: a scan from the end gives the costs behind each chunk, one from the
   start the state before it. Both hold one vector or state at a time.
4. With these a chunk is unrolled on its own: at each place the first of D, I, K, R (the ASCII order) that lies on a cheapest path.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storegrain.session import ship, stage

CHUNK_ROWS, CHUNK_BYTES = 1024, 1 << 20
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
NEVER = 1 << 60
SPACE = " \t\n\v\f\r"
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3

#: States: 0 nothing yet, 1 system, 2 user, 3 assistant. The state behind an inserted or given role, and roles that may follow.
FOLLOWS = {0: 2, 1: 2, 2: 3, 3: 2}
NAMES = {2: "user", 3: "assistant"}
LETTERS = {"s": 0, "u": 1, "a": 2}
KEPT = {(0, 0): 1, **{(s, 1): 2 for s in (0, 1, 3)}, (2, 2): 3}
#: What each state still costs at the end of a conversation: inserts up to an assistant, nothing for an empty one.
AT_END = (0, 2 * INSERT, INSERT, 0)


def _product(a: tuple, b: tuple) -> tuple:
    return tuple(tuple(min(NEVER, *(x + b[k][j] for k, x in enumerate(row))) for j in range(4)) for row in a)


def _before(a: tuple, after: tuple) -> tuple:
    """Costs before a stretch with the matrix ``a`` if those behind it are ``after``."""
    return tuple(min(NEVER, *(x + y for x, y in zip(row, after))) for row in a)


@lru_cache(maxsize=None)
def power(symbol: int, bit: int) -> tuple:
    """Matrix of ``2**bit`` rows of a symbol, inserts before each row included."""
    if bit:
        half = power(symbol, bit - 1)
        return _product(half, half)
    letter, fault = divmod(symbol, 4)
    row = [[NEVER] * 4 for _ in range(4)]
    for state in range(4):
        row[state][state] = DELETE
        if fault not in (BLANK, DUPLICATE):
            extra = CUT_OFF * (fault == TRUNCATED)
            given = FOLLOWS[state]
            row[state][given] = min(row[state][given], REROLE + extra)
            kept = KEPT.get((state, letter))
            if kept is not None:
                row[state][kept] = min(row[state][kept], KEEP + extra)
    inserts = tuple(tuple(min((k * INSERT for k in range(3) if _inserted(i, k) == j), default=NEVER) for j in range(4)) for i in range(4))
    return _product(inserts, tuple(map(tuple, row)))


def _inserted(state: int, count: int) -> int:
    for _ in range(count):
        state = FOLLOWS[state]
    return state


def _run_before(symbol: int, size: int, after: tuple) -> tuple:
    for bit in range(size.bit_length()):
        if size >> bit & 1:
            after = _before(power(symbol, bit), after)
    return after


def _run_matrix(symbol: int, size: int) -> tuple:
    out = None
    for bit in range(size.bit_length()):
        if size >> bit & 1:
            out = power(symbol, bit) if out is None else _product(out, power(symbol, bit))
    return out


def runs(symbols: list[int]) -> list[tuple[int, int]]:
    return [(s, len(list(g))) for s, g in groupby(symbols)]


IDENTITY = tuple(tuple(0 if i == j else NEVER for j in range(4)) for i in range(4))


def matrix(symbols: list[int]) -> tuple:
    out = IDENTITY
    for symbol, size in runs(symbols):
        out = _product(out, _run_matrix(symbol, size))
    return out


@lru_cache(maxsize=50_000)
def _unroll_run(symbol: int, size: int, state: int, after: tuple) -> tuple[str, int]:
    """Edits of a run from a state, and the state behind it; ``after``: costs behind the run."""
    costs = [after]
    for _ in range(size):
        costs.append(_before(power(symbol, 0), costs[-1]))
    letter, fault = divmod(symbol, 4)
    extra, out = CUT_OFF * (fault == TRUNCATED), []
    for left in range(size, 0, -1):
        here, behind = costs[left], costs[left - 1]
        while True:
            if here[state] == DELETE + behind[state]:
                out.append("D")
            elif here[state] == INSERT + here[FOLLOWS[state]]:
                out.append("I")
                state = FOLLOWS[state]
                continue
            elif (state, letter) in KEPT and here[state] == KEEP + extra + behind[KEPT[state, letter]]:
                out.append("K")
                state = KEPT[state, letter]
            else:
                out.append("R")
                state = FOLLOWS[state]
            break
    return "".join(out), state


def unroll(symbols: list[int], state: int, after: tuple) -> tuple[str, int]:
    """The cheapest edits of a chunk, of equal ones the ASCII-least, and the state behind it."""
    pieces = runs(symbols)
    ends = [after]
    for symbol, size in reversed(pieces):
        ends.append(_run_before(symbol, size, ends[-1]))
    out = []
    for (symbol, size), end in zip(pieces, ends[-2::-1]):
        least = min(end)
        edits, state = _unroll_run(symbol, size, state, tuple(min(NEVER, x - least) if x < NEVER else NEVER for x in end))
        out.append(edits)
    return "".join(out), state


def faults(roles: list[str], texts: list[str], firsts: set[int] | None) -> list[int]:
    """First fault of each row (0: none). ``firsts``: rows whose role and text occur first there; None: judged on these rows alone."""
    out, seen = [], set()
    for i, row in enumerate(zip(roles, texts)):
        repeated = row in seen if firsts is None else i not in firsts
        seen.add(row) if firsts is None else None
        end = row[1].rstrip(SPACE)
        out.append(BLANK if not end else DUPLICATE if repeated else TRUNCATED if end[-1] not in ".!?" else 0)
    return out


def symbols_of(roles: list[str], found: list[int]) -> list[int]:
    return [4 * LETTERS.get(r[:1], 3) + f for r, f in zip(roles, found)]


CHUNK = "conv_id long, chunk long, alone boolean, turns array<long>, roles array<string>, texts array<string>"
EDIT = pa.struct([("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
SOLVED = ("conv_id long, chunk long, alone boolean, blank long, duplicate long, truncated long, illegal long, cost long, "
          "first_role string, last_role string, min_turn long, max_turn long, n_turns long, "
          "edits array<struct<edit:string,turn:long,role:string,text:string>>")


def _batch(rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(fields)], [n for n, _ in fields])


def chunks(rows: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``conv_id, chunk, alone, turns, roles, texts``: the rows in order, conversations cut where they are long or a partition ends.

    ``chunk`` rises in the order of the rows. Equal rows are spread by a number of their own, so that not even they must meet.
    """
    fields = [("conv_id", pa.int64()), ("chunk", pa.int64()), ("alone", pa.bool_()), ("turns", pa.list_(pa.int64())),
              ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]

    def run(batches):
        number, no, size, now, done = TaskContext.get().partitionId() << 32, 0, 0, None, []
        first, whole = True, True  # first conversation of the partition; the chunk holds its conversation from the start

        def close(ends: bool):
            nonlocal now, no, size
            done.append((now[0], number + no, ends and whole and not first, *now[1:]))
            no, size, now = no + 1, 0, None

        for part in batches:
            for conv, turn, role, text in zip(*(c.to_pylist() for c in part.columns)):
                if now is not None and now[0] != conv:
                    close(True)
                    first, whole = False, True
                elif now is not None and (len(now[1]) >= chunk_rows or size >= chunk_bytes):
                    close(False)
                    whole = False
                if now is None:
                    now = (conv, [], [], [])
                for column, value in zip(now[1:], (turn, role, text)):
                    column.append(value)
                size += len(text) + len(role)
                if len(done) >= 64:
                    yield _batch(done, fields)
                    done.clear()
        if now is not None:
            close(False)
        yield _batch(done, fields)

    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", F.sha2("text", 256), "spread"]
    rows = rows.withColumn("spread", F.xxhash64(F.monotonically_increasing_id()))
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return sorted_rows.select("conv_id", "turn", "role", "text").mapInArrow(run, CHUNK)


def _solved(chunk_rows: DataFrame) -> DataFrame:
    """Edits and counts of chunks. Those that are not alone have ``firsts``, ``state`` before them and costs ``after`` them."""
    fields = [("conv_id", pa.int64()), ("chunk", pa.int64()), ("alone", pa.bool_()), *((n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal", "cost")),
              ("first_role", pa.string()), ("last_role", pa.string()), *((n, pa.int64()) for n in ("min_turn", "max_turn", "n_turns")), ("edits", pa.list_(EDIT))]

    def solve(conv, chunk, alone, turns, roles, texts, firsts, state, after):
        found = faults(roles, texts, None if alone else set(firsts))
        audit, end = unroll(symbols_of(roles, found), 0 if alone else state, AT_END if alone else tuple(after[:4]))
        if alone or after[4]:  # the last chunk: up to an assistant
            while AT_END[end]:
                audit, end = audit + "I", FOLLOWS[end]
        edits, at, state, cost = [], 0, 0 if alone else state, 0
        for edit in audit:
            if edit == "I":
                state, cost = FOLLOWS[state], cost + INSERT
                edits.append({"edit": edit, "turn": None, "role": NAMES[state], "text": ""})
                continue
            role = roles[at]
            if edit == "D":
                cost += DELETE
            else:
                cost += CUT_OFF * (found[at] == TRUNCATED) + REROLE * (edit == "R")
                state = FOLLOWS[state] if edit == "R" else KEPT[state, LETTERS[role[0]]]
                role = NAMES[state] if edit == "R" else role
            edits.append({"edit": edit, "turn": turns[at], "role": role, "text": texts[at]})
            at += 1
        letters = [r[:1] for r in roles]
        known = [t for t in turns if t is not None]
        return (conv, chunk, alone, *(found.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)),
                sum(x + y not in ("su", "ua", "au") for x, y in zip(letters, letters[1:])), cost, letters[0], letters[-1],
                min(known, default=None), max(known, default=None), len(set(known)), edits)

    def run(batches):
        for part in batches:
            for lo in range(0, len(part), 64):
                yield _batch([solve(*row) for row in zip(*(c.to_pylist() for c in part.slice(lo, 64).columns))], fields)

    return chunk_rows.select("conv_id", "chunk", "alone", "turns", "roles", "texts", "firsts", "state", "after").mapInArrow(run, SOLVED)


def _scan(df: DataFrame, descending: bool, start, step, name: str, kind: str) -> DataFrame:
    """``chunk`` and what a scan over the chunks of each conversation has met before each: one value is held at a time."""
    value_type = pa.list_(pa.int64()) if kind.startswith("array") else pa.int64()

    def run(batches):
        now, value = (), start
        for part in batches:
            out = []
            for conv, chunk, way in zip(*(c.to_pylist() for c in part.columns)):
                if now != (conv,):
                    now, value = (conv,), start
                out.append((chunk, value))
                value = step(value, way)
            yield _batch(out, [("chunk", pa.int64()), (name, value_type)])

    order = F.desc("chunk") if descending else F.asc("chunk")
    return df.repartition("conv_id").sortWithinPartitions("conv_id", order).mapInArrow(run, f"chunk long, {name} {kind}")


def _ways(chunk_rows: DataFrame, columns: list[str], work) -> DataFrame:
    """``conv_id, chunk, way``: a list of numbers of each chunk, worked out from its symbols and further columns."""
    def run(batches):
        for part in batches:
            for lo in range(0, len(part), 64):
                conv, chunk, roles, texts, firsts, *rest = (c.to_pylist() for c in part.slice(lo, 64).columns)
                out = [work(symbols_of(r, faults(r, t, set(f))), *more) for r, t, f, *more in zip(roles, texts, firsts, *rest)]
                yield _batch(list(zip(conv, chunk, out)), [("conv_id", pa.int64()), ("chunk", pa.int64()), ("way", pa.list_(pa.int64()))])

    return chunk_rows.select("conv_id", "chunk", "roles", "texts", "firsts", *columns).mapInArrow(run, "conv_id long, chunk long, way array<long>")


def repair(conversations: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Edits of ``conversations`` (``conv_id, turn, role, text``), one row for each chunk of a conversation, ``chunk`` in order.

    A conversation is read by turn (nulls first), rows of one turn by role, then the SHA-256 of the text. A row's first fault counts: *blank* (white
    space only), *duplicate* (role and text seen earlier in the conversation), *truncated* (the last character that is no white space is
    none of ``.!?``). Keep costs 0, Rerole to user or assistant 3, Delete 4 (required for blank and duplicate rows), Insert of an empty
    user or assistant row 3, a truncated row that stays 3 more. The first letters of the repaired roles are ``(s?(ua)+)?``; of the cheapest
    edits those whose letters K, R, D, I are ASCII-least are taken. ``edits`` holds them: edit, turn, role (the new one), text.

    A null role or text is one space; rows with a null ``conv_id`` are one conversation. Equal rows are duplicates of each other. Other
    columns are not looked at. Without rows the result is empty. No task needs more than a chunk (1,024 rows or 1 MB, but one row at least) at a time.
    """
    ship(conversations.sparkSession)
    space = F.lit(" ")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), space).alias("role"),
                                F.coalesce(F.col("text").cast("string"), space).alias("text"))
    cut = stage(chunks(rows, chunk_rows, chunk_bytes), "chunks")
    nothing = F.lit(None)
    alone = cut.where("alone").withColumns({"firsts": nothing.cast("array<long>"), "state": nothing.cast("long"), "after": nothing.cast("array<long>")})
    rest = cut.where(~F.col("alone"))
    light = rest.select("conv_id", "chunk", F.posexplode(F.arrays_zip("roles", "texts")).alias("i", "row")).select(
        "conv_id", "row.roles", F.sha2("row.texts", 256).alias("sha"), F.struct("chunk", F.col("i").cast("long").alias("i")).alias("place"))
    earliest = light.groupBy("conv_id", "roles", "sha").agg(F.min("place").alias("place"))
    firsts = earliest.groupBy("place.chunk").agg(F.collect_list("place.i").alias("firsts"))
    marked = stage(rest.join(firsts, "chunk", "left").withColumn("firsts", F.coalesce("firsts", F.array().cast("array<long>"))), "marked-chunks")
    through = _ways(marked, [], lambda symbols: [x for row in matrix(symbols) for x in row])
    after = stage(_scan(through, True, [*AT_END, 1], lambda value, way: [*_before(tuple(zip(*[iter(way)] * 4)), tuple(value[:4])), 0], "after", "array<long>"), "costs")
    exits = _ways(marked.join(after, "chunk"), ["after"], lambda symbols, end: [unroll(symbols, s, tuple(end[:4]))[1] for s in range(4)])
    before = _scan(exits, False, 0, lambda state, way: way[state], "state", "long")
    return _solved(alone).unionByName(_solved(marked.join(after, "chunk").join(before, "chunk")))


def repaired_turns(solved: DataFrame) -> DataFrame:
    """``conv_id, chunk, place, edit, turn, role, text``: one row for each edit, in the order of chunk and place."""
    return solved.select("conv_id", "chunk", F.posexplode("edits").alias("place", "e")).select("conv_id", "chunk", "place", "e.*")


DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _folded(parts: DataFrame) -> DataFrame:
    """Digests of conversations of several chunks; the hash reads them in order, a chunk at a time."""
    fields = [("conv_id", pa.int64()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
              ("audit", pa.string()), ("repaired_sha256", pa.string())]

    def run(batches):
        now = None

        def result():
            gaps = 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["turns"]
            return now["conv"], gaps, *now["counts"], "".join(now["audit"]), now["hash"].hexdigest()

        for part in batches:
            out = []
            for r in part.to_pylist():
                if now is None or now["conv"] != r["conv_id"]:
                    if now is not None:
                        out.append(result())
                    now = {"conv": r["conv_id"], "counts": [0] * 5, "audit": [], "hash": hashlib.sha256(), "low": None, "high": None, "turns": 0,
                           "any": False, "role": None}
                illegal = r["illegal"] + (now["role"] is not None and now["role"] + r["first_role"] not in ("su", "ua", "au"))
                now["counts"] = [a + b for a, b in zip(now["counts"], (r["blank"], r["duplicate"], r["truncated"], illegal, r["cost"]))]
                now["role"] = r["last_role"]
                if r["min_turn"] is not None:
                    now["turns"] += r["n_turns"] - (now["high"] == r["min_turn"])
                    now["low"], now["high"] = r["min_turn"] if now["low"] is None else now["low"], r["max_turn"]
                for e in r["edits"]:
                    now["audit"].append(e["edit"])
                    if e["edit"] != "D":
                        now["hash"].update(("\n" * now["any"] + f"{e['role']}:{e['text']}").encode())
                        now["any"] = True
            yield _batch(out, fields)
        if now is not None:
            yield _batch([result()], fields)

    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(run, DIGEST)


def digests(solved: DataFrame, conv_ids: DataFrame) -> DataFrame:
    """One row for each of ``conv_ids``: counts of gaps and faults, cost, the edits' letters and the hash of the repaired ``role:text`` lines."""
    solved = stage(solved, "edits")
    kept = F.filter("edits", lambda e: e["edit"] != "D")
    alone = solved.where("alone").select(
        "conv_id", F.coalesce(F.col("max_turn") - F.col("min_turn") + 1 - F.col("n_turns"), F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal",
        "cost", F.array_join(F.transform("edits", lambda e: e["edit"]), "").alias("audit"),
        F.sha2(F.array_join(F.transform(kept, lambda e: F.concat(e["role"], F.lit(":"), e["text"])), "\n"), 256).alias("repaired_sha256"))
    known = alone.unionByName(_folded(solved.where(~F.col("alone"))))
    ids = conv_ids.select(F.col("conv_id").cast("long").alias("id")).distinct()
    out = ids.join(known, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The damage of the query, by ``crc32(conv_id:turn) % 20``: 0 drops a row, 1 empties its text, 2 takes its ``.!?``, 3 doubles it, 4 makes it the
    user's. Nulls are one space."""
    def spaced(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    text, role = spaced("text"), spaced("role")
    rows = conversations.withColumn("kind", kind).where("kind != 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(role).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")
