"""Personal data against plain regular expressions, checksums by definition, and odd rows."""

import hashlib
import random
import re
import time

import pytest

from storegrain.llm import pii
from storegrain.llm.queries import QUERIES

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain_spans(text: str) -> list[tuple]:
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = "".join(c for c in m[0] if c in "0123456789")
            if (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))
                    or kind == "card" and 16 <= len(digits) <= 19 and plain_luhn(digits) or kind == "phone" and 8 <= len(digits) <= 15):
                out.append((kind, m.start(), m.end()))
    return out


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def test_op12(spark, folder):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op12_pii"](spark, folder).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        spans = plain_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(joined(spans).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in spans) for k in PATTERNS)
        assert set(joined(spans).split(",")) - {""} <= set(r.spans.split(","))
    assert any(r.n_email for r in rows) and any(r.n_card for r in rows) and any(r.n_phone for r in rows)


def test_base_spans_by_brute_force():
    draw, letters = random.Random(3), "ab@@..-+ ()0123456789é_\n"
    for _ in range(6000):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 60)))
        assert [(pii.KINDS[k], s, e) for k, s, e, _, base in pii.find(text) if base] == plain_spans(text), text
    for _ in range(3000):
        number = "".join(draw.choice("0123456789") for _ in range(draw.randint(1, 20)))
        assert pii.luhn(number) == plain_luhn(number)


def plain_mod97(account: str) -> bool:
    rest = 0
    for c in account[4:] + account[:4]:
        rest = (rest * (10 if c.isdigit() else 100) + int(c, 36)) % 97
    return rest == 1


def test_accounts():
    good = "DE89370400440532013000"
    assert pii.mod97(good) and plain_mod97(good)
    draw = random.Random(1)
    for _ in range(500):
        i = draw.randrange(4, len(good))
        other = good[:i] + draw.choice("0123456789AZ") + good[i + 1:]
        assert pii.mod97(other) == plain_mod97(other)
    found = [(pii.KINDS[k], s, e) for k, s, e, *_ in pii.find("IBAN DE89 3704 0044 0532 0130 00, not DE88 3704 0044 0532 0130 00")]
    assert found == [("iban", 5, 32)]


def kinds(text):
    return [pii.KINDS[k] for k, *_ in pii.find(text)]


@pytest.mark.parametrize("text, expected", [
    ("call +1 (988) 555-2485 4041894974608795 now", ["card", "phone"]),  # the base patterns lose both
    ("4041894974608795 42.144.35.254", ["ip", "card"]),
    ("social security 123-45-6789", ["ssn"]), ("part no 123-45-6789", []), ("a 123-45-6789 b", []),
    ("phone (555) 123-4567", ["phone"]), ("sku (555) 123-4567", []), ("version 1.2.3.4", ["ip"]), ("1.2.3.400", []),
    ("amex card 378282246310005", ["card"]), ("378282246310005", []), ("12345678 99999999", []),
])
def test_context_and_neighbours(text, expected):
    assert kinds(text) == expected


def test_scores():
    plain, near, against = (pii.find(t)[0][3] for t in ("x 1.2.3.4", "server 1.2.3.4", "version 1.2.3.4"))
    assert against < plain < near <= 1


def test_very_long_runs():
    began = time.time()
    for text in ("a" * 1_000_000, "1" * 1_000_000, "a@" * 300_000, "1." * 400_000, "+1" * 300_000, "1 " * 400_000, "A1" * 300_000, "." * 500_000):
        pii.find(text)
    assert time.time() - began < 30


def test_odd_rows(spark):
    schema = "doc_id long, text string, pii_spans string, cut long, row string, base_sha256 string"
    rows = [(1, "a@b.c é 1.2.3.4", "x", 1, "r", "s"), (1, "a@b.c é 1.2.3.4", "x", 1, "r", "s"), (None, None, None, None, None, None), (3, "", "y", 2, "q", "t")]
    docs = spark.createDataFrame(rows, schema)
    found = pii.find_personal_data(docs)
    assert sorted(found.columns) == sorted(docs.columns)
    assert sorted([(s.kind, s.start, s.end) for s in r.pii_spans] for r in found.collect()) == [[], [], *[[("email", 0, 5), ("ip", 8, 15)]] * 2]
    masked = pii.mask(docs)
    assert masked.dtypes == docs.dtypes
    assert sorted(map(tuple, masked.collect()), key=repr) == sorted([(1, "[private] é [private]", *r[2:]) if r[1] else r for r in rows], key=repr)
    none = spark.createDataFrame([], schema)
    assert pii.mask(none).collect() == [] and pii.digests(pii.find_personal_data(none)).collect() == []
