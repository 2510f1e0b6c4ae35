"""SentencePiece encoding and decoding as a max-plus scan.

An encoding is the best path through the lattice of a text's pieces. For a unigram model a path's value is the
sum of its pieces' scores. For a BPE model - the public model is one - every piece weighs 0 and a pair of
neighbours weighs 0 if merging their concatenation gives exactly these two, else minus infinity. A sequence is
the BPE encoding of its text if and only if all its neighbours are such pairs: merges never cross a final
boundary, so a pair of an encoding merges alike on its own; and the first merge to cross a boundary between two
pieces would have been the first to do so in their concatenation. So exactly one path is finite, and the same
max-plus algebra gives the library's own ids.

Giant texts are cut into parts at fixed places, in one walk over the text, and the parts are spread over the
cluster. What a part needs from its left is only which piece ends at or crosses the cut. A part's transfer matrix
gives, for each such state at its left cut and each at its right cut, the best value between. Matrices combine
associatively: FAN neighbours at a time, a level of the tree for each round, so no task holds more than FAN of
them, however long the text. The same tree is then walked down, which fixes the state at every cut, and each part
is traced back on its own. Inside a part, pre-tokens that no piece can cross are solved once and remembered; many
of them are solved together, a place at a time, as arrays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Generations, crc32, crc32_combine, map_batches, slices, texts_of, written
from .pieces import BPE, BYTE, NORMAL, SPACE, UNUSED, USER_DEFINED, load_proto, pretokens

#: Characters above which a text is cut, and characters of a part.
GIANT, PART = 65_536, 16_384
#: Matrices that one step of the tree combines.
FAN = 64
NONE = float("-inf")
#: Pre-tokens longer than this are solved on their own and not remembered.
MEMORABLE = 64
#: Remembered pre-tokens, and characters of texts and pre-tokens that are encoded together.
REMEMBERED, AT_ONCE, TOGETHER = 250_000, 2_000_000, 100_000
#: Places for remembered pairs of neighbours, a power of two.
PAIRS = 1 << 21
#: Unknown characters are numbered from here in arrays, after all pieces; NOTHING stands before a text.
UNKNOWN_FROM, NOTHING, WIDE = 1 << 24, 1 << 25, 1 << 26

_SYNC = re.compile(r"(?<=[^ ])(?= )|(?=\n)|(?<=\n)")


def _synced(s: str, i: int) -> bool:
    """No piece crosses place i."""
    return s[i] == "\n" or s[i - 1] == "\n" or (s[i] == " " and s[i - 1] != " ")


def _place(pair: np.ndarray) -> np.ndarray:
    """A pair's place in the table of pairs: the upper bits of a product."""
    return ((pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - PAIRS.bit_length())).astype(np.int64)


@lru_cache(maxsize=1)
def _pair_table(model: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A model's remembered pairs of neighbours and whether they fit, which a worker keeps between its tasks."""
    return np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)


def surfaces(proto) -> list[bytes]:
    """What each piece decodes to."""
    out = []
    for p in proto.pieces:
        out.append(bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.replace(SPACE, " ").encode() if p.type in (NORMAL, USER_DEFINED, UNUSED) else b"")
    return out


def decoder(model: str | None = None):
    """The function from ids (little-endian 32-bit integers) to UTF-8, which needs no lattice."""
    surface = surfaces(load_proto(model))
    return lambda ids: b"".join([surface[i] for i in np.frombuffer(ids, "<u4").tolist()])


class Lattice:
    """A model's pieces with the space sign written as a space."""

    def __init__(self, model: str | None = None, proto=None):
        public = proto is None
        proto = proto or load_proto(model)
        self.bpe = proto.trainer_spec.model_type == BPE
        self.score: dict[str, float] = {}
        self.packed: dict[str, bytes] = {}
        self.surface = surfaces(proto)
        pack = lambda i: np.array([i], "<u4").tobytes()
        self.byte_ids: dict[int, bytes] = {}
        self.unknown = pack(0)
        for i, p in enumerate(proto.pieces):
            if p.type == BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = pack(i)
            elif p.type in (NORMAL, USER_DEFINED, UNUSED):
                text = p.piece.replace(SPACE, " ")
                self.score[text], self.packed[text] = p.score, pack(i)
            elif p.type == 2:
                self.unknown = pack(i)
        self.longest = max(map(len, self.score))
        # An unknown character costs more than the worst piece, as the library has it.
        self.worst = min(self.score.values(), default=0.0) - 10.0
        self.pairs = Generations(self._pair, 20_000)
        self.alone = Generations(lambda t: self.merged(t) == [t], 20_000)
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        # The pieces' character tree, as a dictionary and as arrays: node << 21 | character -> child, and the piece
        # that ends at each node.
        self.names = {int.from_bytes(i, "little"): t for t, i in self.packed.items()}
        self.step: dict[int, int] = {}
        ends = [-1]
        for i, t in self.names.items():
            node = 0
            for c in t:
                node = self.step.setdefault(node << 21 | ord(c), len(ends))
                if node == len(ends):
                    ends.append(-1)
            ends[node] = i
        self.ends = np.array(ends, np.int64)
        self.end_of = [self.names.get(i) for i in ends]
        keys = np.fromiter(self.step, np.int64, len(self.step))
        order = np.argsort(keys)
        self.steps, self.children = keys[order], np.fromiter(self.step.values(), np.int64, len(self.step))[order]
        self.weight = np.zeros(max(self.names, default=0) + 1)
        for i, t in self.names.items():
            self.weight[i] = self.score[t]
        self.pair_key, self.pair_fits = _pair_table(model) if public else (np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool))

    def merged(self, text: str) -> list[str]:
        """BPE of a short text by merging the best neighbours, the leftmost of equals, until none is a piece."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _pair(self, pair: tuple[str, str]) -> bool:
        return self.merged(pair[0] + pair[1]) == [*pair]

    def _fits(self, before: str | None, piece: str) -> bool:
        if not self.bpe:
            return True
        return self.alone[piece] if before is None else self.pairs[before, piece]

    def run(self, s: str, begin: int, before: str | None, stop: int) -> dict[int, tuple[int, float]]:
        """Best paths from ``begin``, after the piece ``before``: place -> (start of the last piece, value).

        Pieces start before ``stop`` and may end beyond it. With one start, one last piece a place is enough: the
        best for a unigram model, the only possible one for BPE.
        """
        score, step, ends, bpe, fits = self.score, self.step, self.end_of, self.bpe, self._fits
        nodes: dict[int, tuple[int, float]] = {begin: (-1, 0.0)}
        last: dict[int, str | None] = {begin: before}
        n = len(s)
        for q in range(begin, stop):
            node = nodes.get(q)
            if node is None:
                continue
            value, prev, p = node[1], last[q], q
            at = step.get(ord(s[q]))
            if at is None or ends[at] is None:  # a character that is no piece stands for itself
                v = value if bpe else value + self.worst
                old = nodes.get(q + 1)
                if (old is None or v > old[1]) and fits(prev, s[q]):
                    nodes[q + 1], last[q + 1] = (q, v), s[q]
            while at is not None:
                p += 1
                t = ends[at]
                if t is not None:
                    v = value if bpe else value + score[t]
                    old = nodes.get(p)
                    if (old is None or v > old[1]) and fits(prev, t):
                        nodes[p], last[p] = (q, v), t
                if p == n:
                    break
                at = step.get(at << 21 | ord(s[p]))
        return nodes

    def ids(self, pieces: list[str]) -> bytes:
        out = []
        for t in pieces:
            got = self.packed.get(t)
            if got is None:
                got = b"".join(self.byte_ids[b] for b in t.encode()) if self.byte_ids else self.unknown
            out.append(got)
        return b"".join(out)

    def trace(self, s: str, nodes: dict[int, tuple[int, float]], begin: int, end: int) -> list[str]:
        out = []
        while end > begin:
            q = nodes[end][0]
            out.append(s[q:end])
            end = q
        return out[::-1]

    def _name(self, i: int) -> str | None:
        return None if i == NOTHING else chr(i - UNKNOWN_FROM) if i >= UNKNOWN_FROM else self.names[i]

    def _fit_all(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """``_fits`` for arrays of numbered pieces, by a table of the pairs seen last."""
        key = before * WIDE + piece
        place = _place(key)
        out, known = self.pair_fits[place], self.pair_key[place] == key
        if not known.all():
            new, at = np.unique(key[~known], return_inverse=True)
            found = np.array([self._fits(self._name(k // WIDE), self._name(k % WIDE)) for k in new.tolist()], bool)
            out[~known] = found[at]
            # Of pairs with one place the last stays, in both tables.
            self.pair_key[_place(new)], self.pair_fits[_place(new)] = new, found
        return out

    def solve(self, units: Sequence[str]) -> list[tuple[bytes, float]]:
        """Ids and value of each non-empty unit's best path: the scan of ``run``, for all units at once."""
        if not units:
            return []
        size = np.array([len(u) for u in units], np.int64)
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        owner = np.repeat(np.arange(len(units)), size)
        stop = np.cumsum(size)
        rel = np.arange(len(chars)) - (stop - size)[owner]
        # Every piece at every place: (start, end, piece).
        at, node, found = np.arange(len(chars)), np.zeros(len(chars), np.int64), []
        for d in range(1, self.longest + 1):
            inside = at + d <= stop[owner[at]]
            at, node = at[inside], node[inside]
            if not len(at):
                break
            key = node << 21 | chars[at + d - 1]
            i = np.minimum(np.searchsorted(self.steps, key), len(self.steps) - 1)
            ok = self.steps[i] == key
            node = np.where(ok, self.children[i], 0)
            piece = np.where(ok, self.ends[node], -1)
            if d == 1:
                odd = piece < 0
                found.append((at[odd], at[odd] + 1, UNKNOWN_FROM + chars[at[odd]]))
            found.append((at[piece >= 0], at[piece >= 0] + d, piece[piece >= 0]))
            at, node = at[ok], node[ok]
        start, end, piece = (np.concatenate([f[k] for f in found]) for k in range(3))
        order = np.argsort(rel[start], kind="stable")
        start, end, piece = start[order], end[order], piece[order]
        edges = np.searchsorted(rel[start], np.arange(int(size.max(initial=0)) + 1))
        weight = np.zeros(len(piece)) if self.bpe else np.where(piece >= UNKNOWN_FROM, self.worst, self.weight[np.where(piece >= UNKNOWN_FROM, 0, piece)])
        # A unit of n characters has n + 1 places.
        end, start = end + owner[start], start + owner[start]
        first, final = (stop - size) + np.arange(len(units)), stop + np.arange(len(units))
        places = len(chars) + len(units)
        value, last, prev = np.full(places, NONE), np.full(places, NOTHING), np.full(places, -1)
        value[first] = 0.0
        for q in range(len(edges) - 1):
            s, e, p = start[edges[q] : edges[q + 1]], end[edges[q] : edges[q + 1]], piece[edges[q] : edges[q + 1]]
            v = value[s] + weight[edges[q] : edges[q + 1]]
            use = np.nonzero(v > value[e])[0]
            if self.bpe and len(use):
                use = use[self._fit_all(last[s[use]], p[use])]
            value[e[use]], last[e[use]], prev[e[use]] = v[use], p[use], s[use]
        taken, here = np.full(places, -1), final
        while len(here):
            back = prev[here]
            taken[back] = last[here]
            here = back[prev[back] >= 0]
        token = taken >= 0
        ids = taken[token]
        counts = np.add.reduceat(token.astype(np.int64), first)
        packed, bounds = ids.astype("<u4").tobytes(), np.append(0, np.cumsum(counts)).tolist()
        out = [(packed[4 * x : 4 * y], v) for x, y, v in zip(bounds, bounds[1:], value[final].tolist(), strict=False)]
        for u in np.unique(np.searchsorted(np.cumsum(counts), np.nonzero(ids >= UNKNOWN_FROM)[0], side="right")).tolist():
            out[u] = (self.ids([self._name(i) for i in ids[bounds[u] : bounds[u + 1]].tolist()]), out[u][1])
        return out

    def alone_ids(self, unit: str) -> bytes:
        """Ids of one unit of any length, in one scan."""
        return self.ids(self.trace(unit, self.run(unit, 0, None, len(unit)), 0, len(unit)))

    def learn(self, units: set[str]) -> None:
        """Puts the units no longer than MEMORABLE into the memo; what was not used for long leaves it."""
        memo = self.memo
        new = [u for u in units if u not in memo and len(u) <= MEMORABLE]
        if len(memo) + len(new) > REMEMBERED:
            self.old, self.memo = memo, {}
            memo, new = self.memo, [u for u in units if len(u) <= MEMORABLE]
        fresh = []
        for u in new:
            got = self.old.get(u)
            if got is None:
                fresh.append(u)
            else:
                memo[u] = got
        fresh.sort(key=len)  # units of like length are solved together
        i = 0
        while i < len(fresh):
            j = i + max(1, TOGETHER // len(fresh[min(len(fresh) - 1, i + TOGETHER // MEMORABLE)]))
            memo.update(zip(fresh[i:j], [ids for ids, _ in self.solve(fresh[i:j])], strict=True))
            i = j

    def joined(self, units: list[str]) -> bytes:
        """Ids of learned units, and of long ones, one after the other."""
        memo = self.memo
        try:
            return b"".join([memo[u] for u in units])
        except KeyError:
            return b"".join([memo[u] if len(u) <= MEMORABLE else self.alone_ids(u) for u in units])

    def encode_all(self, texts: Sequence[str | None]) -> list[bytes]:
        """Ids of texts as little-endian 32-bit integers."""
        out: list[bytes] = []
        held: list[list[str]] = []
        total = 0
        for i, text in enumerate(texts):
            held.append(pretokens(text) if text else [])
            total += len(text) if text else 0
            if total >= AT_ONCE or i + 1 == len(texts):
                self.learn(set().union(*held))
                out += [self.joined(units) for units in held]
                held, total = [], 0
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def decode_bytes(self, ids: bytes) -> bytes:
        surface = self.surface
        return b"".join([surface[i] for i in np.frombuffer(ids, "<u4").tolist()])

    def decode(self, ids: bytes) -> str:
        """The text of ids, without the space that encoding added."""
        return self.decode_bytes(ids).decode("utf-8", "replace").removeprefix(" ")

    # A part: s has up to ``longest`` characters of context on both sides of s[lo:hi].

    def states(self, s: str, cut: int, first: bool) -> list[tuple[int, int]]:
        """Pieces that end at or cross a cut, as (start, end) relative to it; (0, 0) at the text's start."""
        if first:
            return [(0, 0)]
        out = []
        for q in range(max(0, cut - self.longest), cut):
            for p in range(cut, min(len(s), q + self.longest) + 1):
                if p > q and (s[q:p] in self.score or p == q + 1):
                    out.append((q - cut, p - cut))
        return out

    def _ends(self, s: str, lo: int, hi: int) -> tuple[int, int] | None:
        """The first place of s[lo:hi] that no piece crosses, and the last before hi; None if there is none."""
        if lo == 0:
            first = 0
        else:
            m = _SYNC.search(s, lo)
            if not m or m.start() >= hi:
                return None
            first = m.start()
        last = hi - 1
        while last > first and not _synced(s, last):
            last -= 1
        return first, last

    def transfer(self, s: str, lo: int, hi: int, first: bool, final: bool) -> tuple[list, list, np.ndarray]:
        """States at both cuts and the max-plus matrix between them."""
        entries, ends = self.states(s, lo, first), self._ends(s, lo, hi)
        exits: dict[tuple[int, int], int] = {}
        rows: list[dict] = []
        if ends:
            head, tail = ends
            # Whole pre-tokens always have a path, of value 0 for BPE.
            middle = 0.0 if self.bpe else sum(v for _, v in self.solve(_split(s[head:tail])))
            out = self._exits(self.run(s, tail, None, hi), hi, final)
            for q, p in entries:
                end = lo + p
                if end > head:
                    rows.append({})
                    continue
                got = self.run(s, end, s[lo + q : end] or None, head).get(head) if end < head else (0, 0.0)
                rows.append({k: got[1] + middle + v for k, v in out.items()} if got else {})
        else:
            for q, p in entries:
                end = lo + p
                if end >= hi:  # the piece crosses the whole part
                    rows.append({(lo + q - hi, end - hi): 0.0} if not final or end == hi else {})
                else:
                    rows.append(self._exits(self.run(s, end, s[lo + q : end] or None, hi), hi, final))
        for row in rows:
            for k in row:
                exits.setdefault(k, len(exits))
        matrix = np.full((len(entries), len(exits)), NONE)
        for i, row in enumerate(rows):
            for k, v in row.items():
                matrix[i, exits[k]] = v
        return entries, list(exits), matrix

    @staticmethod
    def _exits(nodes: dict, hi: int, final: bool) -> dict[tuple[int, int], float]:
        return {(q - hi, p - hi): v for p, (q, v) in nodes.items() if p >= hi and q >= 0 and (p == hi or not final)}

    def part(self, s: str, lo: int, hi: int, entry: tuple[int, int], exit_: tuple[int, int]) -> bytes:
        """Ids of the pieces that start in s[lo:hi] on the best path between two states."""
        begin, end, ends = lo + entry[1], hi + exit_[1], self._ends(s, lo, hi)
        if begin >= hi:
            return b""
        before = s[lo + entry[0] : begin] or None
        if not ends:
            return self.ids(self.trace(s, self.run(s, begin, before, hi), begin, end))
        head, tail = ends
        out = self.ids(self.trace(s, self.run(s, begin, before, head), begin, head)) if begin < head else b""
        units = _split(s[head:tail])
        self.learn(set(units))
        middle = self.joined(units)
        return out + middle + self.ids(self.trace(s, self.run(s, tail, None, hi), tail, end))


def _split(s: str) -> list[str]:
    """Pre-tokens of a stretch between two places that no piece crosses."""
    return re.findall(r" *[^ \n]+| +|\n", s)


Matrix = tuple[list, list, np.ndarray]


def combine(a: Matrix, b: Matrix) -> Matrix:
    """The max-plus product: states at a's left cut to states at b's right cut. Associative."""
    at = {k: i for i, k in enumerate(b[0])}
    right = np.stack([b[2][at[k]] if k in at else np.full(len(b[1]), NONE) for k in a[1]]) if a[1] else np.zeros((0, len(b[1])))
    value = (a[2][:, :, None] + right[None]).max(axis=1, initial=NONE)
    return a[0], b[1], value


State = tuple[int, int]


def product(parts: Sequence[Matrix]) -> Matrix:
    """The product of neighbours, by halves."""
    while len(parts) > 1:
        parts = [combine(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def best_span(whole: Matrix) -> tuple[State, State]:
    """The states at both ends of the best path through a matrix."""
    i, j = np.unravel_index(np.argmax(whole[2]), whole[2].shape)
    return whole[0][i], whole[1][j]


def cut_states(parts: list[Matrix], span: tuple[State, State] | None = None) -> list[State]:
    """The states of the best path at every cut, both ends included; ``span`` fixes the ends."""
    levels = [parts]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([combine(below[i], below[i + 1]) if i + 1 < len(below) else below[i] for i in range(0, len(below), 2)])
    spans = [span or best_span(levels[-1][0])]
    for below in levels[-2::-1]:
        finer = []
        for k, (left, right) in enumerate(spans):
            if 2 * k + 1 >= len(below):
                finer.append((left, right))
                continue
            a, b = below[2 * k], below[2 * k + 1]
            at, x, y = {s: n for n, s in enumerate(b[0])}, a[0].index(left), b[1].index(right)
            middle = max((s for s in a[1] if s in at), key=lambda s: a[2][x, a[1].index(s)] + b[2][at[s], y])
            finer += [(left, middle), (middle, right)]
        spans = finer
    return [spans[0][0], *(s[1] for s in spans)]


def encode_short(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids) of a (doc_id, text) table, each text in one part."""

    def make():
        own = Lattice(model)
        return lambda b: {"doc_id": b.column(0), "ids": own.encode_all(b.column(1).to_pylist())}

    return map_batches(docs, make, "doc_id long, ids binary")


#: What is known of a giant text: a number of its own, and lengths and CRCs of the text and of what decoding must give.
_FACTS = "row long, doc_id long, n_bytes long, w_bytes long, w_crc long"


def giant_parts(docs: DataFrame, size: int = PART, context: int = 16) -> DataFrame:
    """Every text of a (doc_id, text) table cut into parts with their context, in one walk over it.

    One row for each part: _FACTS, part, parts, and s, whose own characters are s[lo:hi].
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    shape = f"{_FACTS}, part int, parts int, lo int, hi int, s string"
    schema = to_arrow_schema(StructType.fromDDL(shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for i in range(batch.num_rows):
                doc_id, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                whole = " " + text.replace(SPACE, " ")
                want = whole.encode()
                facts = (row, doc_id, len(text.encode()), len(want), crc32(want))
                del want, text
                parts = -(-len(whole) // size)
                for first in range(0, parts, 64):
                    rows = []
                    for k in range(first, min(parts, first + 64)):
                        lo, own = min(k * size, context), min(size, len(whole) - k * size)
                        rows.append((*facts, k, parts, lo, lo + own, whole[k * size - lo : k * size + own + context]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                row += 1

    return docs.mapInArrow(run, shape)


_MATRIX = "row long, node int, entries array<int>, exits array<int>, value array<double>"
_SPAN = "row long, node int, e0 int, e1 int, x0 int, x1 int"


def _matrices(frame) -> list[Matrix]:
    pairs = lambda x: list(zip(x[::2].tolist(), x[1::2].tolist(), strict=True))
    return [(pairs(e), pairs(x), np.array(v).reshape(len(e) // 2, -1)) for e, x, v in zip(frame["entries"], frame["exits"], frame["value"], strict=True)]


def _flat(m: Matrix) -> dict:
    return {"entries": [v for s in m[0] for v in s], "exits": [v for s in m[1] for v in s], "value": m[2].ravel().tolist()}


def part_states(matrices: DataFrame, most: int, fan: int = FAN) -> DataFrame:
    """(row, node, e0, e1, x0, x1): the states at both cuts of every part, from all rows' matrices.

    ``most`` is the largest number of parts of a row. Each round up or down the tree is one shuffle of matrices
    by (row, group), some kilobytes each, FAN to a group.
    """
    import pandas as pd

    def up(key, frame):
        whole = product(_matrices(frame.sort_values("node")))
        return pd.DataFrame([{"row": key[0], "node": key[1]} | _flat(whole)])

    def down(key, frame):
        frame = frame.sort_values("node")
        span = None
        if "e0" in frame.columns:
            e0, e1, x0, x1 = (int(frame[c].iloc[0]) for c in ("e0", "e1", "x0", "x1"))
            span = (e0, e1), (x0, x1)
        states = cut_states(_matrices(frame), span)
        out = frame[["row", "node"]].copy()
        for i, names in enumerate((("e0", "e1"), ("x0", "x1"))):
            for j, name in enumerate(names):
                out[name] = [s[j] for s in (states[1:] if i else states[:-1])]
        return out

    group = F.floor(F.col("node") / fan).cast("int").alias("group")
    levels = [matrices]
    while most > fan:
        most = -(-most // fan)
        levels.append(written(levels[-1].groupBy("row", group).applyInPandas(up, _MATRIX)))
    spans = levels[-1].groupBy("row", group).applyInPandas(down, _SPAN)
    for level in levels[-2::-1]:
        ends = spans.withColumnRenamed("node", "group")
        spans = level.withColumn("group", group).join(ends, ["row", "group"]).groupBy("row", "group").applyInPandas(down, _SPAN)
    return spans


def encode_giant(docs: DataFrame, model: str | None = None, size: int = PART, fan: int = FAN) -> DataFrame:
    """(_FACTS, part, parts, ids) of every part of every text of a (doc_id, text) table."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Written, since rows are numbered by their task and all scans of the parts must agree.
    parts = written(giant_parts(docs, size, max(map(len, (p.piece for p in load_proto(model).pieces if p.type in (NORMAL, USER_DEFINED, UNUSED))))).repartition(tasks, "row", "part"))
    most = parts.agg(F.max("parts")).first()[0] or 0

    def transfers():
        own = Lattice(model)

        def each(b: pa.RecordBatch) -> dict:
            got = [_flat(own.transfer(r["s"], r["lo"], r["hi"], r["part"] == 0, r["part"] + 1 == r["parts"])) for r in b.to_pylist()]
            return {"row": b.column("row"), "node": b.column("part")} | {k: [g[k] for g in got] for k in ("entries", "exits", "value")}

        return each

    matrices = written(map_batches(parts, transfers, _MATRIX))
    states = part_states(matrices, most, fan).withColumnRenamed("node", "part")
    names = [x.split()[0] for x in _FACTS.split(", ")] + ["part", "parts"]

    def back():
        own = Lattice(model)

        def each(b: pa.RecordBatch) -> dict:
            ids = [own.part(r["s"], r["lo"], r["hi"], (r["e0"], r["e1"]), (r["x0"], r["x1"])) for r in b.to_pylist()]
            return {n: b.column(n) for n in names} | {"ids": ids}

        return each

    return map_batches(parts.join(states, ["row", "part"]), back, f"{_FACTS}, part int, parts int, ids binary")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, giant: int = GIANT, size: int = PART, fan: int = FAN) -> DataFrame:
    """doc_id, part, parts, ids (little-endian 32-bit integers): one row for each part of each row's text.

    The ids are the library's, without begin or end. Null and empty texts have one part without ids. Repeated
    rows and null ids stay; other columns are ignored; an empty table gives an empty result.
    """
    rows = texts_of(docs, id_col, text_col)
    long = F.coalesce(F.char_length("text") > giant, F.lit(False))
    short = encode_short(rows.filter(~long), model).select("doc_id", F.lit(0).alias("part"), F.lit(1).alias("parts"), "ids")
    return short.unionByName(encode_giant(rows.filter(long), model, size, fan).select("doc_id", "part", "parts", "ids"))


def decode(encoded: DataFrame, column: str = "ids", model: str | None = None) -> DataFrame:
    """``encoded`` with ``bytes``, the UTF-8 of the ids' text (the added space included in a first part)."""
    from .common import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    at, out = encoded.columns.index(column), StructType([*encoded.schema.fields, *StructType.fromDDL("bytes binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back, schema = decoder(model), to_arrow_schema(out)
        for b in slices(batches):
            new = pa.array([None if x is None else back(x) for x in b.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, new], schema=schema)

    return encoded.mapInArrow(run, out)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, giant: int = GIANT, size: int = PART, fan: int = FAN) -> DataFrame:
    """doc_id, n_bytes, n_tokens, ids_crc32, parts, same: digests of every row's ids, and whether they decode to its text.

    Texts are compared by length and CRC-32, U+2581 counting as a space. Giant texts' parts are digested where
    they are and only the digests are gathered: some bytes for each part.
    """
    import pandas as pd

    rows = texts_of(docs, id_col, text_col)
    n_chars = F.coalesce(F.char_length("text"), F.lit(0))

    def short_make():
        own = Lattice(model)

        def each(b: pa.RecordBatch) -> dict:
            texts = b.column("text").to_pylist()
            ids = own.encode_all(texts)
            # What decoding must give: the added space and the text; nothing for an empty text.
            want = [(" " + t.replace(SPACE, " ")).encode() if t else b"" for t in texts]
            back = [own.decode_bytes(i) for i in ids]
            return {
                "doc_id": b.column("doc_id"), "n_bytes": [len(t.encode()) if t else 0 for t in texts], "n_tokens": [len(i) // 4 for i in ids], "ids_crc32": [crc32(i) for i in ids],
                "same": [len(x) == len(y) and crc32(x) == crc32(y) for x, y in zip(want, back, strict=True)],
            }

        return each

    short = map_batches(rows.filter(n_chars <= giant), short_make, "doc_id long, n_bytes long, n_tokens long, ids_crc32 long, same boolean")
    names = [x.split()[0] for x in _FACTS.split(", ")] + ["part"]

    def digest():
        back = decoder(model)

        def each(b: pa.RecordBatch) -> dict:
            ids = b.column("ids").to_pylist()
            texts = [back(i) for i in ids]
            return {n: b.column(n) for n in names} | {"n_tokens": [len(i) // 4 for i in ids], "ids_crc32": [crc32(i) for i in ids], "d_bytes": [len(t) for t in texts], "d_crc": [crc32(t) for t in texts]}

        return each

    pieces = map_batches(encode_giant(rows.filter(n_chars > giant), model, size, fan), digest, f"{_FACTS}, part int, n_tokens long, ids_crc32 long, d_bytes long, d_crc long")

    def fold(frame):
        frame = frame.sort_values("part")
        crc = d_crc = 0
        for n, c, m, d in zip(frame["n_tokens"], frame["ids_crc32"], frame["d_bytes"], frame["d_crc"], strict=True):
            crc, d_crc = crc32_combine(crc, c, 4 * n), crc32_combine(d_crc, d, m)
        one = frame.iloc[:1]
        same = frame["d_bytes"].sum() == one["w_bytes"].iloc[0] and d_crc == one["w_crc"].iloc[0]
        return pd.DataFrame({"doc_id": one["doc_id"].astype("Int64"), "n_bytes": one["n_bytes"], "n_tokens": frame["n_tokens"].sum(), "ids_crc32": crc, "parts": len(frame), "same": same})

    whole = pieces.groupBy("row").applyInPandas(fold, "doc_id long, n_bytes long, n_tokens long, ids_crc32 long, parts int, same boolean")
    out = short.withColumn("parts", F.lit(1)).unionByName(whole)
    return out.select("doc_id", "n_bytes", "n_tokens", "ids_crc32", "parts", "same")
