"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust their score.

Each kind has a proposer that reads a text once (linear, also on very long runs without a space), a validator (Luhn for cards, mod-97 for
account numbers, the range of address parts, the number of digits) and a prior score. Words within ``NEAR`` characters raise the score
if they speak for the kind and lower it if they speak for something else. Proposals of the four base kinds are kept whatever
their score if they are valid; every other proposal needs ``LEAST``. The further proposals find what the base patterns swallow
(a card number behind a phone number, say) and kinds that only checksum or context can tell from other numbers.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storegrain.llm.common import packed, with_columns
from storegrain.llm.spans import cut_spans

#: Characters on either side of a span in which words count, what one such kind of word adds or takes, and the least score.
NEAR, FOR, AGAINST, LEAST = 48, 0.35, 0.35, 0.5
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")


def luhn(digits: str) -> bool:
    """Every second digit from the right doubled, of two-digit results the digit sum: the total ends in 0."""
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def mod97(account: str) -> bool:
    """The account number with its first four characters last and letters as 10 to 35 leaves 1 when divided by 97."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, from every ``@`` outwards."""
    end, at = 0, text.find("@")
    while at >= 0:
        start, domain = at, DOMAIN.match(text, at + 1)
        while start > end and text[start - 1] in LOCAL_PART:
            start -= 1
        if domain and start < at:
            end = domain.end()
            yield start, end
        else:
            end = at + 1
        at = text.find("@", end)


def _matches(pattern: str) -> Callable[[str], Iterator[tuple[int, int]]]:
    known = re.compile(pattern)
    return lambda text: (m.span() for m in known.finditer(text))


@dataclass(frozen=True)
class Proposer:
    kind: str
    find: Callable[[str], Iterator[tuple[int, int]]]
    valid: Callable[[str], bool]
    score: float
    base: bool = False


# A match of the contract's patterns that starts inside a run of digits could as well start with the run: so they start there and
# give nothing back, which keeps them linear.
PROPOSERS = (
    Proposer("email", emails, lambda s: True, 0.9, True),
    Proposer("ip", _matches(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"), lambda s: all(len(p.lstrip("0")) < 4 and int(p[-3:]) < 256 for p in s.split(".")),
             0.6, True),
    Proposer("card", _matches("[0-9](?:[ -]?[0-9])++"), lambda s: 16 <= len(d := _digits(s)) <= 19 and luhn(d), 0.7, True),
    Proposer("phone", _matches(r"\+[0-9][ ().0-9-]+[0-9]"), lambda s: 8 <= len(_digits(s)) <= 15, 0.6, True),
    # whole groups of digits that the patterns above join to their neighbours
    Proposer("card", _matches(r"(?<![0-9.])[3-6](?:[0-9]{15}|[0-9]{3}(?:(?: [0-9]{4}){3}|(?:-[0-9]{4}){3}))(?![0-9])"),
             lambda s: luhn(_digits(s)), 0.6),
    Proposer("card", _matches(r"(?<![0-9.])(?:3[47][0-9]{13}|3[068][0-9]{12}|[3-6][0-9]{16,18})(?![0-9])"), lambda s: luhn(_digits(s)), 0.3),
    Proposer("phone", _matches(r"\+[0-9]{1,3}[ .-]\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{4}(?![0-9])"), lambda s: True, 0.55),
    Proposer("phone", _matches(r"(?<![0-9(+])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])"), lambda s: True, 0.3),
    Proposer("iban", _matches(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"),
             lambda s: 15 <= len(a := s.replace(" ", "")) <= 34 and mod97(a), 0.85),
    Proposer("ssn", _matches(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"), lambda s: True, 0.3),
)

WORDS_FOR = {
    "email": "mail email e-mail contact kontakt correo courriel write", "ip": "ip address server host login client adresse",
    "card": "card visa mastercard amex credit debit karte carte tarjeta pay payment",
    "phone": "phone tel telephone call mobile cell fax telefon anruf téléphone teléfono móvil",
    "iban": "iban account bank konto compte cuenta", "ssn": "ssn social security taxpayer",
}
WORDS_AGAINST = {
    "ip": "version release build section chapter", "card": "isbn order invoice serial tracking id sku", "phone": "isbn order invoice serial sku",
    "ssn": "isbn order invoice serial part sku", "iban": "serial sku", "email": "",
}


def _any_word(words: str) -> re.Pattern | None:
    return re.compile(rf"(?i)\b(?:{'|'.join(map(re.escape, words.split()))})\b") if words else None


NEARBY = {k: (_any_word(WORDS_FOR[k]), _any_word(WORDS_AGAINST[k])) for k in KINDS}


def scored(text: str, kind: str, start: int, end: int, score: float) -> float:
    """The score with the words on both sides."""
    around = f"{text[max(0, start - NEAR): start]}\n{text[end: end + NEAR]}"
    speaks_for, against = NEARBY[kind]
    score += FOR * bool(speaks_for and speaks_for.search(around)) - AGAINST * bool(against and against.search(around))
    return round(min(1.0, max(0.0, score)), 3)


def find(text: str) -> list[tuple[int, int, int, float, bool]]:
    """``number of the kind, start, end, score, base`` of all kept spans, by kind and start. Spans of a kind do not overlap."""
    out: list = []
    taken: dict[str, list] = {}
    for p in PROPOSERS:
        own = taken.setdefault(p.kind, [])
        for start, end in p.find(text):
            if not p.valid(text[start:end]):
                continue
            at = bisect_right(own, (start, end))
            if not p.base and (at and own[at - 1][1] > start or at < len(own) and own[at][0] < end):
                continue
            score = scored(text, p.kind, start, end, p.score)
            if p.base or score >= LEAST:
                own.insert(at, (start, end))
                out.append((KINDS.index(p.kind), start, end, score, p.base))
    return sorted(out)


SPANS = "pii_spans array<struct<kind:string,start:long,end:long,score:double,base:boolean>>"


def find_personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``pii_spans``: kind, start and end (exclusive) in code points, score and whether a base pattern found it.

    Spans come by kind (email, ip, card, phone, iban, ssn), then start; those of one kind do not overlap, those of different kinds may.
    A null or empty text has no spans. A column ``pii_spans`` is replaced, all others stay. Rows are judged one by one: repeated rows
    get the same spans, an empty table stays empty. Of a very long text all is read, in time proportional to its length.
    """
    def work():
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))

        def step(column):
            return [pa.array([[{"kind": KINDS[k], "start": s, "end": e, "score": score, "base": base} for k, s, e, score, base in find(text or "")]
                              for text in column.to_pylist()], kind)]
        return step

    return with_columns(docs, text_col, SPANS, work)


def mask(docs: DataFrame, text_col: str = "text", mark: str = "[private]") -> DataFrame:
    """``docs`` with each stretch that spans cover replaced by ``mark``; null texts stay null, all other columns stay."""
    found = find_personal_data(packed(docs, text_col))
    return cut_spans(found, docs.columns, text_col, "pii_spans", mark)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, hash of the base spans and all spans as text, from ``pii_spans``."""
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("pii_spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(id_col, *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined("pii_spans").alias("spans"))
