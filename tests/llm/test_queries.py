"""Queries with SQL against DuckDB; the others against brute force on whole small tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from storegrain.catalog import Query
from storegrain.catalog.compare import connect, difference
from storegrain.llm import pieces, token_files
from storegrain.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def texts(spark, folder):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, folder, name):
    assert difference(spark, connect(folder), folder, Query(QUERIES[name], SQL[name])) is None


def repeated(texts: dict, length: int) -> list[tuple]:
    raw = {i: t.encode() for i, t in texts.items()}
    counts = Counter(x[i:i + length] for x in raw.values() for i in range(len(x) - length + 1))
    out = []
    for doc, x in raw.items():
        edges = np.zeros(len(x) + 1, int)
        for i in range(len(x) - length + 1):
            if counts[x[i:i + length]] > 1:
                edges[i] += 1
                edges[i + length] -= 1
        gone = np.cumsum(edges)[:-1] > 0
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(x) else 0
        kept = bytes(np.frombuffer(x, np.uint8)[~gone])
        out.append((doc, len(x), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_op1(spark, folder, texts):
    assert sorted(map(tuple, QUERIES["op1_suffix_array_dedup"](spark, folder).collect())) == repeated(texts, 400)


def test_op3(spark, folder, texts):
    known = pieces.vocabulary(pieces.default_model())
    rows = QUERIES["op3_sentencepiece"](spark, folder).collect()
    assert len(rows) == len(texts) and all(r.round_trip for r in rows)
    for r in rows[:40]:
        assert r.n_pieces == len(r.piece_ids) and r.scores == sorted(r.scores, reverse=True)
        assert known.decode(r.piece_ids) == texts[r.doc_id]


BREAKS = "\\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3001-\u9fff"
RUNS = re.compile(f"[{UNSPACED}]|[^{UNSPACED}{BREAKS}]+")


def plain_fingerprint(text: str) -> list[tuple]:
    """Place and hash of each gram that is the rightmost least of some window."""
    tokens = []
    for run in RUNS.findall(text):
        tokens += [run] if len(run) <= 16 else [run[i:i + 17] for i in range(len(run) - 16)]
    numbers = [xxhash.xxh64(t.encode(), seed=42).intdigest() % 2**31 for t in tokens]
    grams = [numbers[i:i + 3] for i in range(max(len(numbers) - 2, 1))] if numbers else []
    values = [sum(x * 1_000_003 ** (len(g) - 1 - j) for j, x in enumerate(g)) % (2**31 - 1) for g in grams]
    chosen = set()
    for lo in range(max(len(values) - 5, 1) if values else 0):
        chosen.add(min(range(lo, min(lo + 6, len(values))), key=lambda i: (values[i], -i)))
    return [(i, values[i]) for i in sorted(chosen)]


def plain_likeness(one: list, two: list) -> float:
    x, y = {h for _, h in one}, {h for _, h in two}
    return len(x & y) / len(x | y) if x | y else 1.0


def test_op5(spark, folder, texts):
    order = sorted(texts, reverse=True)
    after = {d: texts[order[(i + 1) % len(order)]] for i, d in enumerate(order)}
    rows = QUERIES["op5_document_fingerprints"](spark, folder).collect()
    assert len(rows) == len(texts)
    prints = {}
    for r in rows:
        text = texts[r.doc_id]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[r.doc_id][:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        own, other, moved = plain_fingerprint(text), plain_fingerprint(edited), plain_fingerprint(after[r.doc_id])
        assert r.fingerprint == " ".join(f"{i}:{h:x}" for i, h in own) and r.edited_fingerprint == " ".join(f"{i}:{h:x}" for i, h in other)
        assert r.near_edited == plain_likeness(own, other) and r.near_next == plain_likeness(own, moved)
    long = [r for r in rows if r.n_chars > 300]
    assert sum(r.near_edited > r.near_next for r in long) > 0.97 * len(long)


ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base_spans(text: str) -> list[tuple]:
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def test_op9(spark, folder, texts):
    kinds = ["assign", "access", "hex"]
    for r in QUERIES["op9_secret_scans"](spark, folder).collect():
        spans = base_spans(texts[r.doc_id])
        joined = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in spans) for k in range(3))
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))


def test_op8(spark, folder, texts):
    known = token_files.encoder(*token_files.default_tokenizer())
    rows = QUERIES["op8_token_counts"](spark, folder).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(known.encode_ordinary(t)) for i, t in texts.items()}


def test_op10(spark, folder, texts):
    rows = QUERIES["op10_sharding"](spark, folder).collect()
    slots: dict = {}
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw)) and 0 <= r.shard < 24
        assert r.grown_shard in (r.shard, 24)
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == len(texts) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert 0 < sum(r.grown_shard == 24 for r in rows) < len(rows) / 8


def test_op4_held_out(spark):
    from storegrain.llm import quality

    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    grades = quality.graded(spark.read.parquet(f"{folder}/labels.parquet"))
    model = quality.train(docs, grades.where("id % 2 = 0"))
    rows = quality.judge(docs.join(grades.where("id % 2 = 1").withColumnRenamed("grade", "truth"), docs.doc_id == grades.id), model).select("selected", "truth").collect()
    share = {g: np.mean([r[0] for r in rows if r[1] == g]) for g in range(3)}
    assert share[2] > 0.97 and share[0] < 0.25 and share[1] < 0.4
