"""Conversation repair against a plain search over all edits, and odd rows."""

import hashlib
import random
import zlib
from heapq import heappop, heappush

import pytest

from storegrain.llm import repair
from storegrain.llm.queries import QUERIES

WHITE = " \t\n\v\f\r"


def plain_faults(rows):
    seen, out = [], []
    for role, text in rows:
        end = text.strip(WHITE)
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.append((role, text))
    return out


def plain_edits(rows, found):
    """Shortest path over (rows read, last letter), by cost, then letters; returns cost, letters, repaired rows."""
    agenda, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, at, last, out = heappop(agenda)
        if at == len(rows) and last in ("", "a"):
            return cost, audit, out
        if (at, last) in done:
            continue
        done.add((at, last))
        grow = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        name = {"u": "user", "a": "assistant"}

        def push(more, letter, to, new, row):
            heappush(agenda, (cost + more, audit + letter, to, new, (*out, row) if row else out))

        for x in grow.replace("s", ""):
            push(3, "I", at, x, (name[x], ""))
        if at < len(rows):
            role, text = rows[at]
            push(4, "D", at + 1, last, None)
            if found[at] not in ("blank", "duplicate"):
                extra = 3 * (found[at] == "truncated")
                if role[:1] and role[0] in grow:
                    push(extra, "K", at + 1, role[0], (role, text))
                for x in grow.replace("s", ""):
                    push(3 + extra, "R", at + 1, x, (name[x], text))


def plain_digest(conv, turns):
    """``turns``: (turn, role, text) in order, nulls replaced."""
    rows = [t[1:] for t in turns]
    found = plain_faults(rows)
    cost, audit, out = plain_edits(rows, found)
    known = [t[0] for t in turns if t[0] is not None]
    letters = [r[0][:1] for r in rows]
    return (conv, max(known) - min(known) + 1 - len(set(known)) if known else 0, *(found.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(x + y not in ("su", "ua", "au") for x, y in zip(letters, letters[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def in_order(rows):
    return sorted(rows, key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(t[2].encode()).hexdigest()))


def plain(conversations):
    """Digests of (conv_id, turn, role, text) rows, undamaged."""
    groups = {}
    for conv, turn, role, text in conversations:
        groups.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    return {c: plain_digest(c, in_order(rows)) for c, rows in groups.items()}


def plain_damage(conversations):
    out = []
    for conv, turn, role, text in conversations:
        conv_text, turn_text, role, text = (" " if x is None else str(x) for x in (conv, turn, role, text))
        kind = zlib.crc32(f"{conv_text}:{turn_text}".encode()) % 20
        if kind:
            text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def test_op11(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()]
    expected = plain(plain_damage(rows))
    empty = hashlib.sha256(b"").hexdigest()
    expected |= {c: (c, 0, 0, 0, 0, 0, 0, "", empty) for c in {r[0] for r in rows} - set(expected)}
    found = [tuple(r) for r in QUERIES["op11_conversation_repair"](spark, folder).collect()]
    assert sorted(found) == sorted(expected.values())


def drawn(draw, sizes):
    texts = ["a.", "b!", "c", "d?", "", " \t", "e. "]
    rows = []
    for conv, size in enumerate(sizes):
        for i in range(size):
            turn = draw.choice([i, i, i, draw.randint(0, 9), None])
            rows.append((conv, turn, draw.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "u2"]),
                         draw.choice([*texts, *(f"{i}{t}" for t in texts[:4]), f"{i}x.", f"{i}y.", None])))
    return rows


@pytest.mark.parametrize("chunk_rows", [1, 3, 1024])
def test_brute_force(spark, chunk_rows):
    draw = random.Random(chunk_rows)
    rows = drawn(draw, [draw.randint(1, 9) for _ in range(150)] + [60, 200])
    rows += [(200 + draw.randrange(3), i, draw.choice(["user"] * 8 + ["assistant"]), f"{i}.") for i in range(300)]  # long runs
    rows += [(None, 1, "user", "a."), (None, 2, None, None)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    found = repair.digests(repair.repair(docs, chunk_rows=chunk_rows), docs.select("conv_id"))
    assert {r.conv_id: tuple(r) for r in found.collect()} == plain(rows) and found.count() == len(plain(rows))


def test_powers_are_repeated_products():
    for symbol in range(16):
        one = repair.power(symbol, 0)
        after = many = (0, 6, 3, 0)
        for size in range(1, 40):
            after = repair._before(one, after)
            assert repair._run_before(symbol, size, many) == after
            assert repair._before(repair._run_matrix(symbol, size), many) == after


def test_long_conversation_of_equal_rows(spark):
    docs = spark.range(5000).selectExpr("cast(7 as long) conv_id", "id turn", "'user' role", "concat('x', id % 3, '.') text", "'z' chunk", "1 alone", "2 edits")
    row, = repair.digests(repair.repair(docs, chunk_rows=100), docs.select("conv_id")).collect()
    texts = ["x0.", "x1.", "x2."]
    assert (row.duplicate, row.illegal, row.gaps) == (4997, 4999, 0)
    assert tuple(row) == plain_digest(7, [(i, "user", texts[i % 3]) for i in range(5000)])


def test_odd_tables(spark):
    schema = "conv_id long, turn long, role string, text string, chunk string, edits int"
    none = spark.createDataFrame([], schema)
    assert repair.digests(repair.repair(none), none.select("conv_id")).collect() == []
    docs = spark.createDataFrame([(1, None, None, None, "c", 3), (2, None, "user", "é" * 200_000 + ".", "c", 3), (2, None, "user", "é" * 200_000 + ".", "c", 3)], schema)
    solved = repair.repair(docs, chunk_bytes=1000)
    turns = sorted((r.conv_id, r.edit, r.role) for r in repair.repaired_turns(solved).collect())
    assert turns == [(1, "D", " "), (2, "D", "user"), (2, "I", "assistant"), (2, "K", "user")]
