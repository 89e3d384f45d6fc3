"""Secret scan: all rules in one deterministic automaton, one pass over the bytes.

Each rule is a head, a body and a least length of the body. The reversed rules are joined to one automaton that reads a
text backwards once; it marks the bytes at which a match of a rule starts. From the leftmost mark an automaton of
the head and one of the body read the match itself, as far as it goes; the next match of that rule starts behind it.
Too short matches are dropped after that. The compiled arrays are small (a few hundred states) and go to the tasks with the function.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate, compress, islice
from operator import getitem, itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storegrain.llm.automata import Graph, deterministic, linked
from storegrain.llm.common import packed, with_columns
from storegrain.llm.spans import cut_spans

#: Bytes whose states are held at a time.
BLOCK = 1 << 18


@dataclass(frozen=True)
class Rule:
    name: str
    head: str
    body: str
    least: int


def _any_case(words: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


#: Patterns and least lengths of the base rules: fixed values.
BASE = (
    Rule("assign", _any_case("(password|passwd|secret|token|api_?key)") + r"""["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]+", 6),
    Rule("access", "", "AKIA[A-Z0-9]+", 20),
    Rule("hex", "", "[0-9a-f]{24,}", 24),
)
#: Public formats of further credentials.
MORE = (
    Rule("github", "", "gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", "", "xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("jwt", "", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("pem", "", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
    Rule("bearer", "[Bb]earer ", "[A-Za-z0-9._~+/=-]+", 20),
)
RULES = BASE + MORE


def _anchored(pattern: str) -> list:
    graph = Graph()
    start = graph.node()
    return linked(*deterministic(graph, start, {graph.add(pattern, start): 1}))


def compile_rules(rules: tuple[Rule, ...] = RULES):
    """The backward automaton of all rules, and head and body automata of each (numbers, not linked)."""
    graph = Graph(reverse=True)
    start = graph.node()
    graph.steps[start].append((frozenset(range(256)), start))
    accepts = {graph.add(r.head + r.body, start): 1 << i for i, r in enumerate(rules)}
    return deterministic(graph, start, accepts)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...], compiled):
        self.rules = rules
        self.start = linked(*compiled)[0]
        self.parts = [(_anchored(r.head)[0], _anchored(r.body)[0]) for r in rules]

    def starts(self, data: bytes) -> list[tuple[int, int]]:
        """Bytes at which a match may start, from the left, with the mask of the rules: the one pass."""
        row, out = self.start, []
        for hi in range(len(data), 0, -BLOCK):  # the state goes from block to block
            block = data[max(0, hi - BLOCK): hi]
            rows = list(accumulate(reversed(block), getitem, initial=row))
            row = rows[-1]
            out += [(hi - i, rows[i][256]) for i in compress(range(1, len(rows)), map(itemgetter(256), islice(rows, 1, None)))]
        return out[::-1]

    @staticmethod
    def _longest(row: list, data: bytes, at: int) -> int:
        end = at if row[256] else -1
        for i in range(at, len(data)):
            row = row[data[i]]
            if row[256]:
                end = i + 1
            elif not any(x is not row for x in row[:256]):  # a state without a way out
                break
        return end

    def find(self, data: bytes) -> list[tuple[int, int, int]]:
        """``start, rule number, end`` of all kept matches, in bytes, sorted."""
        out, behind = [], [0] * len(self.rules)
        for at, mask in self.starts(data):
            for i, rule in enumerate(self.rules):
                if mask >> i & 1 and at >= behind[i]:
                    body = self._longest(self.parts[i][0], data, at)
                    end = self._longest(self.parts[i][1], data, body) if body >= 0 else -1
                    if end >= 0:
                        behind[i] = end
                        if end - body >= rule.least:
                            out.append((at, i, end))
        return sorted(out)


def _in_code_points(data: bytes, spans):
    """Byte offsets to code points; ``data`` is valid UTF-8."""
    if data.isascii():
        return spans
    edges, at, count, last = sorted({x for s, _, e in spans for x in (s, e)}), {}, 0, 0
    for x in edges:
        count += sum(b & 0xC0 != 0x80 for b in data[last:x])
        at[x], last = count, x
    return [(at[s], i, at[e]) for s, i, e in spans]


SPANS = "secret_spans array<struct<kind:string,start:long,end:long>>"


def find_secrets(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``secret_spans``: kind, start and end (exclusive) in code points, by start, then by the order of the rules.

    Matches of one rule do not overlap and are taken from the left; matches of different rules may. A null or empty text has no
    spans. All other columns stay as they are, except that a column ``secret_spans`` is replaced. Rows are judged one by one, so
    repeated rows get the same spans and an empty table stays empty.
    """
    compiled = compile_rules(rules)

    def work():
        scanner = Scanner(rules, compiled)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

        def step(column):
            found = []
            for text in column.to_pylist():
                data = (text or "").encode()
                spans = scanner.find(data)
                found.append([{"kind": rules[i].name, "start": s, "end": e} for s, i, e in _in_code_points(data, spans)] if spans else [])
            return [pa.array(found, kind)]
        return step

    return with_columns(docs, text_col, SPANS, work)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every stretch that spans cover replaced by ``mark``; null texts stay null, all other columns stay."""
    found = find_secrets(packed(docs, text_col), "text", rules)
    return cut_spans(found, docs.columns, text_col, "secret_spans", mark)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, hash of the base spans and all spans as text, from ``secret_spans``."""
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    names = [r.name for r in BASE]
    base = F.filter("secret_spans", lambda s: s["kind"].isin(names))
    count = lambda name: F.size(F.filter("secret_spans", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    return found.select(id_col, *(count(n) for n in names), F.sha2(joined(base), 256).alias("base_sha256"), joined("secret_spans").alias("spans"))
