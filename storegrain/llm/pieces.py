"""SentencePiece encoding and decoding: n-best segmentation by a backward A* search over the piece lattice.

The pieces and scores come from a model file of the sentencepiece library (its path is a parameter). A text is cut where no
piece of the vocabulary can span two characters (letters of one script and signs are in different groups, say). In every unit a
forward Viterbi pass over its lattice gives the best score up to each place, and an A* search from the end to the start, with
these scores as exact heuristics, meets the n best segmentations in falling order of their scores. The n best of a text are put together
from those of its units; they can differ from its best only in the n - 1 units that lose least by their second.
The pieces that end at each place come from one automaton of all pieces. Units repeat, so a worker keeps those it has solved, up to
``KEPT_BYTES`` twice, but none longer than ``KEPT_LENGTH``.
"""

from __future__ import annotations

import heapq
import re
from array import array
from bisect import insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storegrain.llm.common import with_columns
from storegrain.session import ship

SPACE = "▁"
#: Stands for a "▁" of the text itself; it cannot occur in valid UTF-8.
OWN = "\ud800"
KEPT_BYTES, KEPT_LENGTH = 64 << 20, 200
#: Marks for units met once; they decide what is kept once the store has been full, never a result.
MARKS = 1 << 20
#: About what the keys, tuples and numbers of a kept unit take besides its characters and ids.
ENTRY_BYTES = 420
#: What an unknown character costs below the least score of a piece, as in the library's lattice.
UNKNOWN = 10.0
N_BEST = 3
NOTHING = -float("inf")


def joined_characters(pieces) -> list[list[str]]:
    """Groups of characters, the largest first: two that are neighbours in a piece are in one group; no piece spans two groups."""
    home: dict[str, str] = {}

    def find(c: str) -> str:
        while home.setdefault(c, c) != c:
            c = home[c]
        return c

    for piece in pieces:
        text = piece.lstrip(SPACE)
        for c in text if len(piece) > 1 else "":
            home[find(c)] = find(text[0])
    groups: dict[str, list[str]] = {}
    for c in sorted(home):
        groups.setdefault(find(c), []).append(c)
    return sorted(groups.values(), key=lambda g: (-len(g), g))


class Vocabulary:
    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.ids, self.scores, self.bytes, out = {}, {}, [0] * 256, []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
                out.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                out.append(b"")
            else:
                self.ids[piece], self.scores[piece] = i, model.get_score(i)
                out.append(piece.replace(SPACE, " ").encode())
        self.decoded = out
        self.longest = max(map(len, self.ids))
        self.unknown = min(s for s in self.scores.values() if s > -1e8) - UNKNOWN
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            self.units = re.compile(r"(?s).+")  # a piece runs over the start of a word: nothing can be cut
        else:
            runs = "|".join(f"[{''.join(map(re.escape, group))}]+" for group in joined_characters(self.ids))
            self.units = re.compile(rf"(?s){SPACE}*(?:{runs})|{SPACE}+|." if runs else rf"(?s){SPACE}+|.")
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in self.scores.items():
            self.automaton.add_word(piece, (len(piece), score, self.piece_ids(piece)))
        self.automaton.make_automaton()
        self.alone = frozenset(p for p in self.ids if len(p) == 1)
        self.solved: dict = {}
        self.older: dict = {}
        self.kept_for = self.kept_bytes = 0
        self.met, self.limit = bytearray(MARKS), KEPT_BYTES

    def piece_ids(self, piece: str) -> bytes:
        """The id of a piece, or those of the bytes of a character that is none; four bytes each."""
        known = self.ids.get(piece)
        return array("i", [known] if known is not None else [self.bytes[b] for b in (SPACE if piece == OWN else piece).encode()]).tobytes()

    def viterbi(self, unit: str) -> tuple[float, list[float], list[list[tuple]]]:
        """Best score of a unit, the best score up to each place in it, and the pieces that end there: length, score, ids."""
        size = len(unit)
        best, edges = [0.0] + [NOTHING] * size, [[] for _ in range(size + 1)]
        if self.alone.issuperset(unit):
            for hi, piece in self.automaton.iter(unit):  # ends rise, so what lies before is final
                hi += 1
                edges[hi].append(piece)
                score = piece[1] + best[hi - piece[0]]
                if score > best[hi]:
                    best[hi] = score
            return best[size], best, edges
        for at, piece in self.automaton.iter(unit):
            edges[at + 1].append(piece)
        for hi, c in enumerate(unit, 1):
            if c not in self.alone:  # a character that is no piece
                edges[hi].append((1, self.unknown, self.piece_ids(c)))
            best[hi] = max([best[hi - length] + score for length, score, _ in edges[hi]])
        return best[size], best, edges

    def n_best(self, unit: str, n: int) -> list[tuple[float, bytes]]:
        """The ``n`` best segmentations of a unit (score, ids as bytes), best first; equal ones in a fixed order.

        A* from the end to the start: what is behind plus the best score up to a place is the exact total, so the states come in the
        order of what they lead to. The best way on is followed at once if nothing on the agenda is better. As every state leads to a
        segmentation with just its total, the state followed and those on the agenda need be no more than are still wanted.
        """
        _, best, edges = self.viterbi(unit)
        found, turn = [], 0
        agenda = [(-best[-1], 0, 0.0, len(unit), None)]
        while agenda and len(found) < n:
            room = n - len(found) - 1
            total, _, behind, end, path = agenda.pop(0)
            worst = agenda[-1][0] if agenda and len(agenda) == room else -NOTHING
            while end:
                ways = edges[end]
                if len(ways) == 1:
                    (length, score, ids), = ways
                    end, behind, path = end - length, score + behind, (ids, path)
                    continue
                if not room:  # the last that is wanted: nothing needs an agenda
                    most = NOTHING
                    for way in reversed(ways):
                        after = way[1] + behind
                        length = way[0]
                        if best[end - length] + after >= most:
                            most, to, back, ids = best[end - length] + after, end - length, after, way[2]
                    total, end, behind, path = -most, to, back, (ids, path)
                    continue
                on = None
                for length, score, ids in reversed(ways):
                    turn -= 1  # of equal sums the latest first, which goes straight to the start with the longest pieces
                    after, lo = score + behind, end - length
                    key = -(best[lo] + after)
                    if on is None:
                        on = (key, turn, after, lo, (ids, path))
                        continue
                    if key > worst and key > on[0]:
                        continue
                    state = (key, turn, after, lo, (ids, path))
                    if state < on:
                        state, on = on, state
                    if state[0] <= worst:
                        insort(agenda, state)
                        if len(agenda) >= room:
                            del agenda[room:]
                            worst = agenda[-1][0]
                if agenda and agenda[0] < on:
                    insort(agenda, on)
                    on = agenda.pop(0)
                    if len(agenda) == room:
                        worst = agenda[-1][0]
                total, _, behind, end, path = on
            parts = []
            while path:
                ids, path = path
                parts.append(ids)
            found.append((-total, b"".join(parts)))
        return found

    def unit(self, unit: str, n: int) -> tuple:
        """Score and ids of the best segmentation of a unit, then what each further one of the ``n`` best loses and its ids (as bytes).

        Kept for the next time; units that are not met again go when the store is full, and from then on only those met twice are kept. If
        there is no second, its loss is infinite.
        """
        known = self.older.get(unit)
        wanted = len(unit) <= KEPT_LENGTH
        if known is None:
            if self.older and wanted:
                mark = hash(unit) % MARKS
                wanted, self.met[mark] = self.met[mark], 1
            (best, ids), *others = self.n_best(unit, n)
            known = [best, ids]
            for score, ids in others:
                known += best - score, ids
            known = (*known, -NOTHING) if not others else tuple(known)
        if wanted:
            if self.kept_bytes >= self.limit:
                self.older, self.solved, self.kept_bytes, self.met = self.solved, {}, 0, bytearray(MARKS)
            self.solved[unit] = known
            self.kept_bytes += ENTRY_BYTES + len(unit) + len(known) // 2 * len(known[1])
        return known

    def encode(self, text: str, n: int) -> tuple[bytes, list[tuple[float, bytes]]]:
        """Ids of the best segmentation as bytes, and score and ids of each of the ``n`` best, best first."""
        if n != self.kept_for:
            self.solved, self.older, self.kept_for, self.kept_bytes = {}, {}, n, 0
        # the library puts a space before a text
        units = self.units.findall(SPACE + text.replace(SPACE, OWN).replace(" ", SPACE)) if text else []
        solved = [self.solved.get(u) or self.unit(u, n) for u in units]
        top, ids = sum([s[0] for s in solved]), [s[1] for s in solved]
        ranked = [(0.0, {})]
        losses, least = [s[2] for s in solved], []
        while len(least) < n - 1 and (loss := min(losses, default=-NOTHING)) < -NOTHING:
            least.append(losses.index(loss))
            losses[least[-1]] = -NOTHING
        for i in least:
            options = [(0.0, {}), *((loss, {i: raw}) for loss, raw in zip(solved[i][2::2], solved[i][3::2]))]
            ranked = heapq.nsmallest(n, [(loss + more, changed | change) for loss, changed in ranked for more, change in options],
                                     key=lambda x: x[0])
        out = []
        for loss, changed in ranked:
            parts = ids.copy() if changed else ids
            for i, raw in changed.items():
                parts[i] = raw
            out.append((top - loss, b"".join(parts)))
        return out[0][1], out

    def decode(self, ids) -> str:
        """The text of a list of ids; the space that ``encode`` puts first goes. Unknown and control ids are nothing."""
        raw = b"".join(map(self.decoded.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def vocabulary(model_file: str) -> Vocabulary:
    return Vocabulary(model_file)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


ENCODED = "n_pieces long, piece_ids array<int>, scores array<double>, other_ids array<array<int>>"


def _id_lists(raw: list[bytes | None]) -> pa.ListArray:
    """Lists of ids from their bytes."""
    edges = np.cumsum([0, *(len(x or b"") // 4 for x in raw)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), np.frombuffer(b"".join(x or b"" for x in raw), np.int32),
                                    mask=pa.array([x is None for x in raw], pa.bool_()))


def encode_texts(docs: DataFrame, model_file: str, text_col: str = "text", n_best: int = N_BEST, round_trip: bool = False,
                 kept_bytes: int = KEPT_BYTES) -> DataFrame:
    """``docs`` with ``piece_ids`` of the best segmentation, their number, the ``n_best`` best ``scores``, best first, and ``other_ids``: the
    ids of the segmentations of the second and further scores.

    A character that is no piece is written as its bytes. A null text has null ids, an empty one no ids; both have the number 0, no score but
    that of nothing (0) and no other ids. Columns with these names are replaced, others stay; rows are worked on one by one; an empty table
    stays empty. Fewer scores than ``n_best`` mean that there are no more segmentations. With ``round_trip`` there is a column of that name as
    well: whether decoding the best ids gives the text back (null ids: a null text). ``kept_bytes`` bounds what a Python worker keeps of solved units
    (twice): more memory saves time and changes no result.
    """
    def work():
        known = vocabulary(model_file)
        known.limit = kept_bytes

        def step(column):
            ids, scores, others, same = [], [], [], []
            for text in column.to_pylist():
                raw, ranked = known.encode(text or "", n_best)
                if round_trip:
                    same.append(text is None or known.decode(np.frombuffer(raw, np.int32).tolist()) == text)
                ids.append(raw if text is not None else None)
                scores.append([s for s, _ in ranked])
                others.append([x for _, x in ranked[1:]])
            lists = _id_lists(ids)
            rest = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, others)]).astype(np.int32)),
                                            _id_lists([x for row in others for x in row]))
            sizes = np.diff(np.asarray(lists.offsets))
            return [pa.array(sizes, pa.int64()), lists, pa.array(scores, pa.list_(pa.float64())), rest, *([pa.array(same, pa.bool_())] if round_trip else [])]
        return step

    return with_columns(docs, text_col, ENCODED + ", round_trip boolean" * round_trip, work)


def decode_ids(docs: DataFrame, model_file: str, ids_col: str = "piece_ids", name: str = "decoded") -> DataFrame:
    """``docs`` with the text of a column of ids; null ids give a null text, no ids an empty one; other columns stay."""
    ship(docs.sparkSession)
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != name))
    at, names = docs.columns.index(ids_col), [*docs.columns, name]

    def run(batches):
        known = vocabulary(model_file)
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                column = part.column(at)
                texts = [None if not x.is_valid else known.decode(np.asarray(x.values).tolist()) for x in column]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names)

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField(name, T.StringType())]))
