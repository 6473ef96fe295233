"""Sampled SentencePiece segmentations without replacement, and decoding.

A text's lattice has a node before each character and an edge for each vocabulary piece; a path's weight is the sum of its
pieces' scores times ALPHA, which defines a distribution over segmentations. Perturbing every path's log-probability with
Gumbel noise and taking the greatest k draws k different segmentations without replacement. The search is A* from the top
down: the maximum of the perturbed values below a node has a Gumbel distribution located at the node's log-mass, so
children are drawn given their parent's maximum, and the frontier's best node is always expanded first.

All texts of a batch are searched side by side. No piece crosses the start of a unit (a run of space marks and what follows
it), so a node's best path is found unit by unit at once. Which edge of a node has the greatest value is a draw by the edges'
probabilities, whatever that value is, so a path takes one draw a node. The values of the siblings that it passed are drawn
from the start of the path on, a few nodes at a time: the greatest value of all siblings behind them is one draw by their joint
mass, and they are looked at only if it can be among those wanted. Noise is a hash of the row's seed, the expansion, the place
in the text and the piece's length, so it doesn't depend on the batch."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import concat_ranges, mix, powers, slices, starts_of, utf8
from .tokens import vocabulary_path

#: Segmentations of each text, the scale of piece scores, the base of the seeds.
SAMPLES, ALPHA, SEED = 2, 0.002, 17
SPACE = "▁"
SCHEMA = "sample int, ids array<int>, pieces array<string>, log_p double, inclusion double"
#: Bytes of text whose lattices are laid together, and of text that is searched at once; a longer text stands alone.
LAID_BYTES, PART_BYTES = 1 << 20, 256 << 10
_U = np.uint64


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _hashes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums from which the hash of any run of characters follows, and the factors that shift it to the start."""
    up, down = powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, _U)
    np.cumsum(mix(codes.astype(_U) + _U(1)) * up[: len(codes)], out=total[1:])
    return total, down


def _name(total: np.ndarray, down: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` characters from each place on."""
    return (total.take(at + size) - total.take(at)) * down.take(at) + _U(size)


def _whole(codes: np.ndarray) -> np.ndarray:
    """``_name`` of every row of a matrix of characters."""
    size = codes.shape[1]
    return (mix(codes.astype(_U) + _U(1)) * powers(size + 1)[0][:size]).sum(1, dtype=_U) + _U(size)


def _firsts(key: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))


#: What a unit of the place in a seed's sequence adds to its hash.
_STEP = _U(0x9E3779B97F4A7C15)
#: What the draw for all siblings from a place on adds to the place's key; the draws of single ones add their length's part.
_BEHIND = _U(63 * int(_STEP) % (1 << 64))
#: Nodes whose siblings are drawn at first, and the joint mass of siblings below which it isn't exact enough to draw by.
NODES, LEAST_MASS = 16, 2.0**-20
#: Characters of the prefix that tells how long a piece may be.
_PREFIX = 4


class Edges:
    """Lattices laid end to end: edges of node i are those from ptr[i] to ptr[i + 1]; cond is an edge's log-probability given
    its start, upto the sum of the probabilities up to it (of a node's last edge: infinite), length its characters, piece its id
    (-1: a character without a piece)."""

    def __init__(self, ptr: np.ndarray, length: np.ndarray, cond: np.ndarray, piece: np.ndarray):
        self.ptr, self.length, self.cond, self.piece = ptr, length, cond, piece
        self.upto = np.exp(cond)
        degree = np.diff(ptr)
        at = ptr[:-1][degree > 1]
        degree = degree[degree > 1]
        for i in range(1, int(degree.max(initial=1))):  # node by node, so that sums don't depend on other nodes
            self.upto[at + i] += self.upto[at + i - 1]
            at, degree = at[degree > i + 1], degree[degree > i + 1]
        self.upto[ptr[1:] - 1] = np.inf


class Lattice:
    """Pieces of a vocabulary, and the lattices that they span."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.lib.get_piece_size()
        usable = [i for i in range(n) if not (self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_byte(i) or self.lib.is_unused(i))]
        self.score = {self.lib.id_to_piece(i): alpha * self.lib.get_score(i) for i in usable}
        self.id = {self.lib.id_to_piece(i): i for i in usable}
        self.bytes = np.array([self.lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.longest = max(map(len, self.score), default=1)
        self.least = min(self.score.values(), default=0.0) - 1.0  # of a character without a piece, spelt in bytes
        self.cut = re.compile(f"(?<=[^{SPACE}])(?={SPACE})")
        if any(self.cut.search(p) for p in self.score):
            raise ValueError("a piece of the vocabulary has a space mark behind another character")
        # sorted hashes of all pieces, each with its id, score, length, first and last character; runs of hashes by their top bits
        names = sorted(self.score, key=lambda p: (len(p), p))
        self.sizes = sorted({len(p) for p in names})
        codes = [_codes(p) for p in names]
        key = np.concatenate([np.zeros(0, _U), *(_whole(np.stack([c for c in codes if len(c) == size])) for size in self.sizes)])
        by = np.argsort(key)
        self.key = np.append(key[by], np.full(4, ~_U(0)))
        columns = ([self.id[p] for p in names], [self.score[p] for p in names], [len(c) for c in codes], [c[0] for c in codes], [c[-1] for c in codes])
        self.columns = [np.append(np.array(c)[by], np.zeros(4, np.array(c).dtype)) for c in columns]
        self.slot = np.searchsorted(self.key, np.arange(1 << 20, dtype=_U) << _U(44)).astype(np.int32)
        self.some = np.zeros(1 << 20, bool)
        self.some[(self.key[:-4] >> _U(44)).astype(np.int64)] = True
        self.reach = np.zeros(1 << 20, np.int32)  # by the hash of the first characters, the length of the longest piece
        long = [c for c in codes if len(c) >= _PREFIX]
        if long:
            heads = (_whole(np.stack([c[:_PREFIX] for c in long])) >> _U(44)).astype(np.int64)
            np.maximum.at(self.reach, heads, [len(c) for c in long])
        self.deepest = int(np.bincount((self.key[:-4] >> _U(44)).astype(np.int64)).max(initial=1))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are those of pieces, and the places of these among the pieces' own."""
        top = (h >> _U(44)).astype(np.int32)
        at = np.flatnonzero(self.some.take(top))
        k, h = self.slot.take(top.take(at)), h.take(at)
        for _ in range(self.deepest - 1):
            k += self.key.take(k) < h
        ok = np.flatnonzero(self.key.take(k) == h)
        return at.take(ok), k.take(ok)

    def units(self, text: str) -> list[str]:
        """The text with spaces marked, cut before each run of marks; no piece has a mark behind another character."""
        marked = (SPACE + text.replace(" ", SPACE)) if text else ""
        return [u for u in self.cut.split(marked) if u]

    def unit(self, text: str) -> list[list[tuple[float, int]]]:
        """For each start, (log-probability given the start, end) of each edge that can begin there, likeliest first."""
        e = self.edges(_codes(text), np.array([0, len(text)]))
        return [sorted(((float(e.cond[k]), i + int(e.length[k])) for k in range(e.ptr[i], e.ptr[i + 1])), reverse=True) for i in range(len(text))]

    def edges(self, codes: np.ndarray, offs: np.ndarray) -> Edges:
        """The lattices of units laid end to end."""
        n = len(codes)
        left = np.repeat(offs[1:], np.diff(offs)) - np.arange(n)  # characters from here to the end of the unit
        sums = _hashes(codes)
        start, length, piece, score = [], [], [], []
        single = np.zeros(n, bool)
        at = np.arange(n, dtype=np.int32)
        reach = None
        for size in self.sizes:
            at = at[left[at] >= size] if reach is None else at
            if size >= _PREFIX:
                if reach is None:
                    reach = np.minimum(self.reach[(_name(*sums, at, _PREFIX) >> _U(44)).astype(np.int32)], left[at])
                on = np.flatnonzero(reach >= size)
                at, reach = at[on], reach[on]
            hit, k = self.find(_name(*sums, at, size))
            ids, scores, _, first, last = self.columns
            begin = at.take(hit)
            ok = (first.take(k) == codes.take(begin)) & (last.take(k) == codes.take(begin + size - 1))
            if not ok.all():
                begin, k = begin[ok], k[ok]
            if size == 1:
                single[begin] = True
            start.append(begin), length.append(np.full(len(begin), size, np.int32)), piece.append(ids.take(k)), score.append(scores.take(k))
        bare = np.flatnonzero(~single)
        start.append(bare), length.append(np.ones(len(bare), np.int32)), piece.append(np.full(len(bare), -1)), score.append(np.full(len(bare), self.least))
        start, length, piece, score = map(np.concatenate, (start, length, piece, score))
        # masses from the ends of units backwards, all units side by side
        order = np.argsort(start, kind="stable")  # of sorted runs, one for each length
        deep = left.take(start.take(order))
        by = order[np.argsort(deep.astype(np.uint16) if deep.max(initial=0) < 1 << 16 else deep, kind="stable")]
        s, end, x = start.take(by), (start + length).take(by), score.take(by)
        mass, below_mass = np.zeros(n + 1), np.zeros(n + 1)  # the second is zero where a unit ends, so where the next begins
        within = np.ones(n + 1)
        within[offs] = 0.0
        cuts = np.append(_firsts(left[s]), len(s))
        for a, b in zip(cuts, cuts[1:], strict=False):
            below = x[a:b] + below_mass.take(end[a:b])
            at = _firsts(s[a:b])
            top = np.maximum.reduceat(below, at)
            size = np.diff(np.append(at, b - a))
            node = s[a:b][at]
            mass[node] = top + np.log(np.add.reduceat(np.exp(below - np.repeat(top, size)), at))
            below_mass[node] = mass[node] * within[node]
        cond = score + below_mass.take(start + length) - mass.take(start)
        cond = np.round(cond * 2.0**32) * 2.0**-32  # so that sums are exact, whatever else is in the batch
        ptr = np.concatenate(([0], np.cumsum(np.bincount(start, minlength=n)))).astype(np.int32)
        return Edges(ptr, length.take(order), cond.take(order), piece.take(order).astype(np.int32))

    def sample(self, text: str, k: int, rng: np.random.Generator, whole: bool = True) -> list[tuple[float, float, list[str]]]:
        """(perturbed log-probability, log-probability, pieces) of up to k + 1 different paths, greatest first; without
        ``whole`` the last one, from which only the perturbed value is wanted, isn't followed and has no pieces."""
        found = Search(Laid(self, [text]), 0, 1, np.array([rng.integers(1 << 63)], _U), k + 1 if whole else k)
        marked, out = "".join(self.units(text)), []
        for s in range(len(found.value)):
            if found.value[s][0] > -np.inf:
                at = np.flatnonzero(found.taken[s] >= 0)
                out.append((float(found.value[s][0]), float(found.log_p[s][0]), [marked[a:b] for a, b in zip(at, np.append(at[1:], len(marked)), strict=True)]))
        return out if whole or found.bar[0] == -np.inf else [*out, (float(found.bar[0]), 0.0, [])]


class Laid:
    """Lattices of the different units of many texts, and each character's node in them.

    codes are the texts' characters end to end, row the text of each, offs where texts begin; begin and end bound the units,
    unit is the unit of each character."""

    def __init__(self, lattice: Lattice, texts: Sequence[str]):
        codes = [_codes((SPACE + t.replace(" ", SPACE)) if t else "") for t in texts]
        self.offs = starts_of(np.array([len(c) for c in codes], np.int64)).astype(np.int64)
        self.codes = np.concatenate([np.zeros(0, np.uint32), *codes])
        mark = self.codes == ord(SPACE)
        opens = mark & ~np.concatenate(([False], mark[:-1]))
        opens[self.offs[:-1][np.diff(self.offs) > 0]] = True
        begin = np.flatnonzero(opens)
        size = np.diff(np.append(begin, len(self.codes)))
        total, down = _hashes(self.codes)
        name = (total[begin + size] - total[begin]) * down[begin] + size.astype(_U)
        _, first, kind = np.unique(name, return_index=True, return_inverse=True)
        inside = np.arange(len(self.codes)) - np.repeat(begin, size)
        if (self.codes != self.codes[np.repeat(begin[first][kind], size) + inside]).any():  # two units of one hash
            first, kind = np.arange(len(begin)), np.arange(len(begin))
        offs = starts_of(size[first])
        self.edges = lattice.edges(self.codes[concat_ranges(begin[first], size[first])], offs)
        self.node = (np.repeat(offs[:-1][kind], size) + inside).astype(np.int32)
        self.begin, self.end = begin, begin + size
        self.unit = np.repeat(np.arange(len(begin)), size)


def _exponential(key: np.ndarray) -> np.ndarray:
    """A standard exponential draw for each key; minus its log is a Gumbel draw."""
    u = (mix(key) >> _U(11)).astype(float)
    u += 0.5
    u *= 2.0**-53
    np.log(u, out=u)
    return np.negative(u, out=u)


def _gumbel(key: np.ndarray) -> np.ndarray:
    """A standard Gumbel draw for each key."""
    return -np.log(_exponential(key))


class Search:
    """Gumbel top-k over many lattices at once.

    value[s] and log_p[s] are the s-th sample's perturbed and plain log-probability by text (-inf: it has no more), taken[s]
    the edge that it takes at each character (-1: none starts there), bar the perturbed value of the sample after the last.

    The frontier of a text holds no more nodes than paths are still wanted: each opened node gives a path, so others are
    never opened. A node is a place in the text, the log-probability up to there, and the sample it leaves at some place."""

    def __init__(self, laid: Laid, lo: int, hi: int, seeds: np.ndarray, k: int):
        """Search the texts from ``lo`` to ``hi`` of those that were laid; places count from the first of them."""
        a, b = laid.offs[lo], laid.offs[hi]
        u, v = np.searchsorted(laid.begin, (a, b))
        self.offs, self.codes, self.node, self.edges = laid.offs[lo : hi + 1] - a, laid.codes[a:b], laid.node[a:b], laid.edges
        self.begin, self.end, self.unit = laid.begin[u:v] - a, laid.end[u:v] - a, laid.unit[a:b] - u
        n, rows = len(self.codes), hi - lo
        self.row = np.repeat(np.arange(rows), np.diff(self.offs))
        self.seed = mix(seeds)
        self.key = self.seed[self.row] + ((np.arange(n) - self.offs[self.row]) * 64).astype(_U) * _STEP
        self.opens = np.zeros(n, bool)
        self.opens[self.begin] = True
        self.value, self.log_p, self.taken = [], [], []
        value, at, log_p = (np.full((rows, 1), x) for x in (-np.inf, 0, 0.0))
        value[:, 0] = _gumbel(self.seed)  # the greatest value of a whole text is a Gumbel draw
        at[:, 0] = self.offs[:-1]
        leaves, over, edge = (np.zeros((rows, 1), np.int64) for _ in range(3))
        for s in range(k):
            live = value[:, 0] > -np.inf
            if not live.any():
                break
            g, begin, base = value[:, 0], np.where(live, at[:, 0], self.offs[1:]), log_p[:, 0]
            taken = np.full(n, -1)
            if s:
                old = np.stack(self.taken)[leaves[self.row, 0], np.arange(n)] if s > 1 else self.taken[0]
                keep = np.arange(n) < over[self.row, 0]
                taken[keep & live[self.row]] = old[keep & live[self.row]]
                some = np.flatnonzero(live)
                taken[over[some, 0]] = edge[some, 0]
            total, new = self._follow(s, g, begin, base, taken, k - s)
            self.value.append(np.where(live, g, -np.inf)), self.log_p.append(total), self.taken.append(taken)
            lower, start, e, before = new
            new_at = start + self.edges.length[e]
            columns = [(value[:, 1:], lower), (at[:, 1:], new_at), (log_p[:, 1:], before + self.edges.cond[e]), (leaves[:, 1:], np.full(e.shape, s)), (over[:, 1:], start), (edge[:, 1:], e)]
            value, at, log_p, leaves, over, edge = (np.concatenate(c, axis=1) for c in columns)
            by = np.argsort(-value, axis=1, kind="stable")[:, : max(1, k - s)]
            value, at, log_p, leaves, over, edge = (np.take_along_axis(c, by, 1) for c in (value, at, log_p, leaves, over, edge))
        self.bar = value[:, 0] if k else np.full(rows, -np.inf)

    def _follow(self, turn: int, g: np.ndarray, begin: np.ndarray, base: np.ndarray, taken: np.ndarray, room: int):
        """Follow each text's best path from ``begin`` on, unit by unit side by side, writing its edges to ``taken``.

        Gives each text's log-probability, and of its passed siblings the ``room`` best as (value, place, edge,
        log-probability before it), matrices of a row for each text."""
        e = self.edges
        # one cursor for each unit behind the start of its text's part, and one where a text starts within a unit
        mine = self.begin >= begin[self.row[self.begin]] if len(self.begin) else np.zeros(0, bool)
        inner = begin[begin < self.offs[1:]]
        inner = inner[~self.opens[inner]]
        at = np.concatenate((self.begin[mine], inner))
        stop = np.concatenate((self.end[mine], self.end[self.unit[inner]]))
        turned = _U(((turn + 1) << 52) * int(_STEP) % (1 << 64))
        while len(at):
            chosen = e.ptr.take(self.node.take(at))
            u = (mix(self.key.take(at) + turned) >> _U(11)) * 2.0**-53
            on = np.flatnonzero(e.upto.take(chosen) <= u)
            next_edge, least = chosen.take(on), u.take(on)
            while len(on):
                next_edge += 1
                more = e.upto.take(next_edge) <= least
                chosen[on] = next_edge
                on, next_edge, least = on[more], next_edge[more], least[more]
            taken[at] = chosen
            at = at + e.length.take(chosen)
            on = np.flatnonzero(at < stop)
            at, stop = at.take(on), stop.take(on)
        fresh = np.flatnonzero((taken >= 0) & (np.arange(len(taken)) >= begin[self.row])) if len(taken) else np.zeros(0, np.int64)
        step = np.zeros(len(taken) + 1)
        step[fresh] = e.cond.take(taken.take(fresh))
        run = np.concatenate(([0.0], np.cumsum(step)))  # sums up to a place, of the parts that were followed
        shift = base - run[self.offs[:-1]]
        total = shift + run[self.offs[1:]]
        return total, self._siblings(g, fresh, run, shift, total, taken, turned, room)

    def _siblings(self, g: np.ndarray, fresh: np.ndarray, run: np.ndarray, shift: np.ndarray, total: np.ndarray, taken: np.ndarray, turned: np.uint64, room: int):
        """The ``room`` best siblings of each path over the nodes ``fresh``.

        A sibling's value is g - log(1 + exp(v)), given that the greatest of all is g; exp(v - g) is an exponential draw by the
        sibling's probability. The least draw of all siblings behind a node is one by their joint mass; when these are opened,
        one of them has it and the others exceed it by fresh draws. Where the joint mass is too small to be exact they are
        opened at once."""
        e, rows = self.edges, len(g)
        row, pos = np.arange(rows), np.searchsorted(fresh, self.offs[:-1])
        stop = np.searchsorted(fresh, self.offs[1:])
        least, known = np.full(rows, -np.inf), np.zeros(rows, bool)  # log of the least draw, or of what all exceed
        found = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        nodes = NODES
        live = pos < stop
        while live.any():
            row, pos, stop, least, known = (x[live] for x in (row, pos, stop, least, known))
            size = np.minimum(nodes, stop - pos)
            nodes *= 2
            place = fresh[concat_ranges(pos, size)]
            begin = shift[row] + run[fresh[pos]]
            degree = e.ptr[self.node[place] + 1] - e.ptr[self.node[place]]
            edge = concat_ranges(e.ptr[self.node[place]], degree)
            at, of = np.repeat(place, degree), np.repeat(np.repeat(np.arange(len(row)), size), degree)
            passed = np.flatnonzero(edge != taken[at])
            edge, at, of = edge[passed], at[passed], of[passed]
            before = shift[row[of]] + run[at]
            drawn = np.log(_exponential(self.key[at] + turned + e.length[edge].astype(_U) * _STEP)) - e.cond[edge] - before + begin[of]
            # all that is behind these nodes
            pos = pos + size
            live = pos < stop
            next_at = fresh[np.minimum(pos, len(fresh) - 1)]
            after = shift[row] + run[next_at]
            with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
                mass = -np.expm1(total[row] - after)
                exact = live & (mass >= LEAST_MASS)
                behind = np.where(exact, np.log(_exponential(self.key[next_at] + turned + _BEHIND)) - np.log(mass) - after + begin, np.inf)
                first = behind.copy()
                np.minimum.at(first, of, drawn)
                past = lambda x, i: np.logaddexp(np.where(known[i], first[i] + np.log(np.expm1(x - first[i])), x), least[i])
                drawn, behind = past(drawn, of), np.where(exact, past(behind, np.arange(len(row))), np.inf)
            v = g[row[of]] - begin[of] + drawn
            found = [np.concatenate(x) for x in zip(found, (row[of], v, at, edge, before), strict=True)]
            by = np.lexsort((found[1], found[0]))
            rank = np.arange(len(by)) - np.searchsorted(found[0][by], found[0][by])
            found = [x[by[rank < room]] for x in found]
            bar = np.full(rows, np.inf)
            full = rank[rank < room] == room - 1
            bar[found[0][full]] = found[1][full]
            live &= ~exact | (g[row] - begin + behind < bar[row])
            least, known = np.where(exact, behind, least) + after - begin, exact
        out = [np.full((rows, room), x) for x in (-np.inf, 0, 0, 0.0)]
        owner, v, place, edge, before = found
        if len(owner):
            rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
            lower = g[owner] - np.maximum(v, 0.0) - np.log1p(np.exp(-np.abs(v)))
            for column, values in zip(out, (lower, place, edge, before), strict=True):
                column[owner, rank] = values
        return out


_lattices: dict[tuple[str, float], Lattice] = {}


def lattice(path: str, alpha: float) -> Lattice:
    if (path, alpha) not in _lattices:
        _lattices[path, alpha] = Lattice(path, alpha)
    return _lattices[path, alpha]


def _utf8_sizes(codes: np.ndarray) -> np.ndarray:
    return 1 + (codes >= 0x80) + (codes >= 0x800).astype(np.int64) + (codes >= 0x10000)


def spelt(lat: Lattice, codes: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of pieces end to end and how many each has: one, or the bytes of a character (``codes``) without a piece."""
    size = np.where(piece >= 0, 1, _utf8_sizes(codes))
    ids = np.zeros(size.sum(), np.int32)
    at = starts_of(size)[:-1]
    ids[at[piece >= 0]] = piece[piece >= 0]
    bare = np.flatnonzero(piece < 0)
    c, n, at = codes[bare].astype(np.int64), size[bare], at[bare]
    for i in range(int(n.max(initial=0))):
        on = n > i
        bits = c[on] >> 6 * (n[on] - 1 - i)
        lead = np.choose(n[on] - 1, (0, 0xC0, 0xE0, 0xF0))
        ids[at[on] + i] = lat.bytes[np.where(i == 0, lead | bits, 0x80 | (bits & 0x3F))]
    return ids, size


def sampled_pieces(rows: DataFrame, keys: list[str], text_col: str = "text", samples: int = SAMPLES, alpha: float = ALPHA, vocabulary: str | None = None, pieces: bool = True, exact: bool = False) -> DataFrame:
    """keys, sample (from 0, greatest perturbed value first), ids, pieces, log_p, inclusion: for each row, ``samples``
    different segmentations of its whole text, or all if it has fewer.

    inclusion is the chance that a segmentation is among the samples, given the perturbed value of the next one (1 if there
    is none). The seed is a hash of the key, so results do not depend on partitions; rows of equal keys and texts get equal
    samples. Null or empty text has one empty segmentation. Null keys count as a value of their own. Without ``pieces`` their texts are
    left out; with ``exact`` a column of that name tells whether decoding the ids gives the row's text. No shuffle."""
    vocabulary = vocabulary or vocabulary_path("piece_bpe_32k.model")
    n_keys = len(keys)
    result = [x for x in SCHEMA.split(", ") if pieces or not x.startswith("pieces ")]
    result += ["exact boolean"] if exact else []
    names_out = [x.split()[0] for x in result]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(vocabulary, alpha)
        spell = Spelling(lat.lib) if exact else None
        for b in batches:
            offs = utf8(b.column(n_keys))[1]
            for first, last in slices(offs, LAID_BYTES):
                laid = Laid(lat, b.column(n_keys).slice(first, last - first).fill_null("").to_pylist())
                found = []
                for lo, hi in slices(offs[first : last + 1], PART_BYTES):
                    for at in range(lo, hi, 4000):
                        found += drawn(lat, spell, laid, at, b.slice(first + at, min(hi - at, 4000)))
                yield from pa.Table.from_batches(found).combine_chunks().to_batches()  # many small batches cost both sides

    def drawn(lat: Lattice, spell: Spelling | None, laid: Laid, at: int, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names = zip(*(part.column(i).to_pylist() for i in range(n_keys)), strict=True)
        seeds = [int.from_bytes(hashlib.blake2b(repr((SEED, *key)).encode(), digest_size=8).digest()) for key in names]
        found = Search(laid, at, at + len(part), np.array(seeds, _U), samples)
        width = starts_of(_utf8_sizes(found.codes)) if pieces else None
        raw = pa.py_buffer(found.codes.tobytes().decode("utf-32-le").encode()) if pieces else None
        given = utf8(part.column(n_keys)) if spell else None
        for s, (value, log_p, taken) in enumerate(zip(found.value, found.log_p, found.taken, strict=True)):
            at = np.flatnonzero(taken >= 0)
            piece = found.edges.piece[taken[at]]
            ids, size = spelt(lat, found.codes[at], piece)
            cuts = np.searchsorted(at, found.offs)
            lists = pa.ListArray.from_arrays(pa.array(starts_of(size)[cuts].astype(np.int32)), pa.array(ids))
            texts = []
            if pieces:
                ends = np.append(width[at], width[-1]).astype(np.int32)
                texts = [pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), raw))]
            with np.errstate(over="ignore"):
                included = np.where(found.bar > -np.inf, -np.expm1(-np.exp(np.minimum(log_p - np.where(found.bar > -np.inf, found.bar, 0.0), 50.0))), 1.0)
            live = pa.array(value > -np.inf)
            columns = [pa.array(np.full(len(value), s, np.int32)), lists, *texts, pa.array(log_p), pa.array(included)]
            if spell:
                read, stops = spell.read(ids, starts_of(size)[cuts])
                same = np.diff(stops) == np.diff(given[1])
                if same.all():
                    wrong = np.searchsorted(given[1], np.flatnonzero(read != given[0]), "right") - 1
                    same[wrong] = False
                else:
                    same = np.array([x and read[stops[i] : stops[i + 1]].tobytes() == given[0][given[1][i] : given[1][i + 1]].tobytes() for i, x in enumerate(same)])
                columns.append(pa.array(same))
            out = pa.RecordBatch.from_arrays([*(part.column(i) for i in range(n_keys)), *columns], [*keys, *names_out])
            yield out.filter(live)

    chosen = rows.select(*keys, F.col(text_col).cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(run, f"{schema}, {', '.join(result)}")


class Spelling:
    """The bytes that ids stand for."""

    def __init__(self, lib) -> None:
        names = [lib.id_to_piece(i) for i in range(lib.get_piece_size())]
        spell = [bytes([int(p[3:5], 16)]) if lib.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        self.marked = np.array([p.startswith(SPACE) for p in names])
        self.letters = np.frombuffer(b"".join(spell), np.uint8)
        self.size = np.array([len(x) for x in spell], np.int32)
        self.begin = starts_of(self.size)[:-1].astype(np.int32)

    def read(self, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows end to end, and where each ends; the mark that begins a row's first piece is dropped."""
        first = offs[:-1][np.diff(offs) > 0]
        first = first[self.marked[ids[first]]]
        a, n = self.begin[ids], self.size[ids]
        a[first] += 1
        n[first] -= 1
        return self.letters[concat_ranges(a, n)], starts_of(n)[offs].astype(np.int64)


def decoded(rows: DataFrame, ids_col: str = "ids", text_col: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """rows with the text that its ids spell: pieces joined, bytes put together, marks turned into spaces, the first one
    dropped; a column of the result's name is replaced. Any sample of a text gives the text back, but for marks that it
    held itself. Null ids give a null text, bytes that are no text become replacement marks."""
    vocabulary = vocabulary or vocabulary_path("piece_bpe_32k.model")
    rows = rows.drop(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell = Spelling(lattice(vocabulary, ALPHA).lib)
        for whole in batches:
            at = whole.schema.get_field_index(ids_col)
            per = whole.column(at).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            for lo, hi in slices(starts_of(per), PART_BYTES):
                b = whole.slice(lo, hi - lo)
                raw, ends = spell.read(b.column(at).flatten().to_numpy(zero_copy_only=False), starts_of(per[lo:hi]))
                text = pa.LargeStringArray.from_buffers(hi - lo, pa.py_buffer(ends), pa.py_buffer(raw))
                try:
                    text.validate(full=True)
                except pa.ArrowInvalid:
                    text = pa.array([raw[x:y].tobytes().decode(errors="replace") for x, y in zip(ends, ends[1:], strict=False)], pa.large_string())
                text = pc.if_else(b.column(at).is_valid(), text, pa.scalar(None, pa.large_string())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*b.columns, text], [*b.schema.names, text_col])

    return rows.mapInArrow(run, rows.select("*", F.lit("").cast("string").alias(text_col)).schema)
