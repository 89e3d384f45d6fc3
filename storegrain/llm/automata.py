"""Regular expressions to one deterministic automaton: subset construction, minimisation, transition arrays."""

from __future__ import annotations

from re import _constants as C
from re import _parser

ALL = frozenset(range(256))
CATEGORIES = {
    C.CATEGORY_DIGIT: frozenset(b"0123456789"), C.CATEGORY_SPACE: frozenset(b" \t\n\r\f\v"),
    C.CATEGORY_WORD: frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"),
}


class Graph:
    """A nondeterministic automaton over bytes; ``reverse`` reads the expressions from their ends."""

    def __init__(self, reverse: bool = False):
        self.reverse, self.steps, self.free = reverse, [], []

    def node(self) -> int:
        self.steps.append([])
        self.free.append([])
        return len(self.steps) - 1

    def add(self, pattern: str, start: int) -> int:
        """Append an expression behind ``start`` and return its last node."""
        return self._sequence(_parser.parse(pattern.encode()), start)

    def _sequence(self, items, at: int) -> int:
        for kind, value in reversed(list(items)) if self.reverse else items:
            at = self._item(kind, value, at)
        return at

    def _bytes(self, at: int, chosen: frozenset) -> int:
        end = self.node()
        self.steps[at].append((chosen, end))
        return end

    def _item(self, kind, value, at: int) -> int:
        if kind is C.LITERAL:
            return self._bytes(at, frozenset([value]))
        if kind is C.NOT_LITERAL:
            return self._bytes(at, ALL - {value})
        if kind is C.ANY:
            return self._bytes(at, ALL - {10})
        if kind is C.IN:
            chosen, negated = frozenset(), False
            for what, x in value:
                negated |= what is C.NEGATE
                if what is C.LITERAL:
                    chosen |= {x}
                elif what is C.RANGE:
                    chosen |= frozenset(range(x[0], x[1] + 1))
                elif what is C.CATEGORY:
                    chosen |= CATEGORIES[x]
            return self._bytes(at, ALL - chosen if negated else chosen)
        if kind is C.SUBPATTERN:
            return self._sequence(value[3], at)
        if kind is C.BRANCH:
            end = self.node()
            for branch in value[1]:
                self.free[self._sequence(branch, at)].append(end)
            return end
        if kind is C.MAX_REPEAT:
            least, most, items = value
            for _ in range(least):
                at = self._sequence(items, at)
            if most is C.MAXREPEAT:
                loop, end = self.node(), self.node()
                self.free[at] += [loop, end]
                self.free[self._sequence(items, loop)] += [loop, end]
                return end
            end = self.node()
            for _ in range(most - least):
                self.free[at].append(end)
                at = self._sequence(items, at)
            self.free[at].append(end)
            return end
        raise ValueError(f"no automaton for {kind}")

    def closure(self, nodes) -> frozenset:
        seen, todo = set(nodes), list(nodes)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


def deterministic(graph: Graph, start: int, accepts: dict[int, int]) -> tuple[list[list[int]], list[int]]:
    """Transitions (256 for each state, state 0 first) and accept masks of the smallest automaton.

    ``accepts`` gives the mask of a node of the graph; the mask of a state joins those of its nodes.
    """
    marks = [[] for _ in range(256)]
    for number, (chosen, _) in enumerate(step for steps in graph.steps for step in steps):
        for b in chosen:
            marks[b].append(number)
    alike = {}
    kinds = [alike.setdefault(tuple(m), len(alike)) for m in marks]  # bytes that no rule tells apart
    sample = {k: b for b, k in reversed(list(enumerate(kinds)))}
    first = graph.closure([start])
    states, moves, todo = {first: 0}, [], [first]
    while todo:
        now = todo.pop(0)
        row = []
        for k in range(len(sample)):
            to = graph.closure({end for n in now for chosen, end in graph.steps[n] if sample[k] in chosen})
            if to not in states:
                states[to] = len(states)
                todo.append(to)
            row.append(states[to])
        moves.append(row)
    masks = [0] * len(states)
    for nodes, i in states.items():
        for n in nodes:
            masks[i] |= accepts.get(n, 0)
    block, size = masks, len(set(masks))
    while True:  # states stay together as long as their moves lead to the same blocks
        names: dict = {}
        block = [names.setdefault((block[i], *(block[x] for x in moves[i])), len(names)) for i in range(len(moves))]
        if len(names) == size:
            break
        size = len(names)
    rows, found = [None] * size, [0] * size
    for i, b in enumerate(block):
        rows[b], found[b] = [block[moves[i][k]] for k in kinds], masks[i]
    return rows, found


def linked(rows: list[list[int]], masks: list[int]) -> list[list]:
    """Rows that hold the next row instead of its number, and the accept mask as entry 256."""
    out = [[] for _ in rows]
    for row, to, mask in zip(out, rows, masks):
        row += [out[x] for x in to] + [mask]
    return out
