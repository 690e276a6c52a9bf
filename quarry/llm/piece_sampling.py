r"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

The lattice of a text has an edge for each vocabulary piece that matches at a position, and byte pieces for a character
without one. The vocabulary file holds merge ranks, so a piece's log-probability is Zipf's law on its rank. A perturbed
A-star search draws the k segmentations with the largest Gumbel-perturbed log-probabilities: the best hypothesis keeps its
parent's perturbed value and goes left to right by exact suffix sums; each step leaves its other edges on the agenda with a
Gumbel value truncated at the parent's, and the next segmentation starts from the best of these. Results are distinct. The value left on top
of the agenda is the threshold for inclusion scores: a segmentation of log-probability f is in the sample with probability
1 - exp(-exp(f - threshold)). All random numbers are hashes of the row's key, the sample and the position.

Pieces never cross a space, so the lattice is a chain of word lattices, which are built once for each different word.

Defined cases: a null text is empty; an empty text has one segmentation, of no pieces; a text with fewer than k
segmentations gives all of them; equal rows give equal samples; U+2581 in a text is spelt in byte pieces, so decoding
is exact for every text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.arrow import edges
from quarry.llm import blocks as B

MARK, HELD = "▁", "\ud800"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
MOST_NOISE = 37.0  # a Gumbel value made from 53 random bits is not larger
_models: dict = {}


class Lattices:
    """Word lattices of a vocabulary: for each node its edges, ascending by length, with conditional probabilities."""

    def __init__(self, model: str, most_nodes: int = 4_000_000) -> None:
        import public_tokenizers
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
        self.most_nodes = most_nodes
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        usable = [i for i in range(len(pieces)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        self.byte_id = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        rank = {i: k for k, i in enumerate(sorted(usable, key=lambda i: (-sp.get_score(i), i)))}
        weight = -np.log(np.arange(len(usable) + 1) + 2.7)
        weight -= np.log(np.exp(weight[:-1]).sum() + 256 * np.exp(weight[-1]))
        self.byte_weight = float(weight[-1])
        self.longest = max(len(pieces[i]) for i in usable)
        self.weight = np.full(len(pieces), -np.inf)
        self.weight[usable] = weight[[rank[i] for i in usable]]
        # Three hash tables (the second and third for collisions) of all beginnings of pieces: -1 empty, -2 only the beginning of a piece, else the piece.
        self.tables = [(np.zeros(1 << 21, np.uint64), np.full(1 << 21, -1, np.int32)) for _ in range(3)]
        starts = {pieces[i][:n]: -2 for i in usable for n in range(1, len(pieces[i]))} | {pieces[i]: i for i in usable}
        left = sorted(starts)
        for n in range(1, self.longest + 1):
            some = [x for x in left if len(x) == n]
            points = np.frombuffer("".join(some).encode("utf-32-le"), "<u4").reshape(-1, n).astype(np.uint64)
            for x, row in zip(some, B.mix(points + np.uint64(77)), strict=True):
                h = B.run_hashes(row, n)[0]
                for k, (keys, ids) in enumerate(self.tables):
                    slot = int(h >> np.uint64(43 - 21 * k) & np.uint64((1 << 21) - 1))
                    if ids[slot] == -1:
                        keys[slot], ids[slot] = h, starts[x]
                        break
                else:
                    raise ValueError("the piece tables are full")
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.hits = np.zeros(0, np.int64)
        self.start, self.size, self.total = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.first = np.zeros(1, np.int64)
        self.step, self.piece, self.cum, self.prob = np.zeros(0, np.uint8), np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(0)
        self.n_nodes = self.n_edges = 0

    def grow(self, name: str, at: int, new: np.ndarray) -> None:
        """Writes new values at a place of an array with room to spare."""
        old = getattr(self, name)
        if at + len(new) > len(old):
            old = np.concatenate([old[:at], np.zeros(max(at, 2 * len(new)), old.dtype)])
            setattr(self, name, old)
        old[at : at + len(new)] = new

    def words(self, chunks: list[str]) -> np.ndarray:
        """The numbers of the words, which are written without the mark before them; new ones are added."""
        known = np.fromiter(map(self.number.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(known < 0)
        if not len(missing):
            self.hits += np.bincount(known, minlength=len(self.hits))
            return known
        new = {chunks[i] for i in missing.tolist()}
        if self.n_nodes + sum(map(len, new)) + len(new) > self.most_nodes:
            self.forget()
            known = np.fromiter(map(self.number.get, chunks, repeat(-1)), np.int64, len(chunks))
            missing = np.flatnonzero(known < 0)
            new = {chunks[i] for i in missing.tolist()}
        new = sorted(new, key=len)
        long = next((i for i, w in enumerate(new) if len(w) > 64), len(new))
        for some in (new[:long], new[long:]):
            if some:
                self._add(some)
        known[missing] = [self.number[chunks[i]] for i in missing.tolist()]
        self.hits = np.r_[self.hits, np.zeros(len(self.number) - len(self.hits), np.int64)]
        self.hits += np.bincount(known, minlength=len(self.hits))
        return known

    def forget(self) -> None:
        """Keeps the words met most often, in half of the room. What is drawn does not depend on what is kept."""
        order = np.argsort(-self.hits, kind="stable")
        order = order[self.hits[order] > 1]
        keep = np.sort(order[np.cumsum(self.size[order]) <= self.most_nodes // 2])
        size, start = self.size[keep], self.start[keep]
        node = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        count = self.first[node + 1] - self.first[node]
        edge = np.repeat(self.first[node] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        names = np.array(list(self.number), dtype=object)[keep].tolist()
        self.number = dict(zip(names, range(len(names)), strict=True))
        self.hits, self.total, self.size, self.start = self.hits[keep] // 2, self.total[keep], size, np.cumsum(size) - size
        self.first = np.r_[0, np.cumsum(count)]
        self.step, self.piece, self.cum, self.prob = (x[edge] for x in (self.step, self.piece, self.cum, self.prob))
        self.n_nodes, self.n_edges = len(node), len(edge)

    def _add(self, words: list[str]) -> None:
        points = np.frombuffer((MARK + MARK.join(words)).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        end = np.cumsum(size)
        begin, nodes = end - size, len(points)
        room = np.repeat(end, size) - np.arange(nodes)
        found = np.full((nodes, self.longest), -1, np.int32)
        mixed = B.mix(points.astype(np.uint64) + np.uint64(77))
        live = np.arange(nodes)
        sums, inverse = B.run_sums(mixed)
        for n in range(1, self.longest + 1):
            live = live[room[live] >= n]
            with np.errstate(over="ignore"):
                h = B.mix((sums[live + n] - sums[live]) * inverse[live])
            got = np.full(len(live), -1, np.int32)
            rest = np.arange(len(live))
            for k, (keys, ids) in enumerate(self.tables):
                slot = (h[rest] >> np.uint64(43 - 21 * k) & np.uint64((1 << 21) - 1)).astype(np.int64)
                hit = keys[slot] == h[rest]
                got[rest[hit]] = ids[slot[hit]]
                rest = rest[~hit]
            found[live[got >= 0], n - 1] = got[got >= 0]
            live = live[got != -1]
        bare = np.flatnonzero(found[:, 0] < 0)
        real = np.where(points[bare] == ord(HELD), ord(MARK), points[bare])
        found[bare, 0] = -2 - real
        widest = int(np.flatnonzero((found != -1).any(0))[-1]) + 1
        found = found[:, :widest]
        edge = found != -1
        node_of, step = np.nonzero(edge)
        piece = found[edge]
        w = self.weight[np.maximum(piece, 0)]
        w[piece < -1] = self.byte_weight * self.bytes_of(-2 - piece[piece < -1])
        count = edge.sum(1)
        first = np.cumsum(count) - count
        to = node_of + step + 1
        to = np.where(to == np.repeat(end, size)[node_of], nodes, to)
        # Suffix sums, all words at once, by distance from the word's end; each character is scaled so that short words stay in range.
        short = size[-1] <= 65
        scale = 3.0 * (step + 1) if short else 0.0
        v = np.exp(w + scale) if short else w
        beta = np.full(nodes + 1, 1.0 if short else 0.0)
        for r in range(1, int(size[-1]) + 1):
            node = end[np.searchsorted(size, r) :] - r
            k = count[node]
            e = np.repeat(first[node] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
            if short:
                beta[node] = np.add.reduceat(v[e] * beta[to[e]], np.cumsum(k) - k)
            else:
                beta[node] = np.logaddexp.reduceat(v[e] + beta[to[e]], np.cumsum(k) - k)
        prob = v * beta[to] / beta[node_of] if short else np.exp(v + beta[to] - beta[node_of])
        sums = np.log(beta[begin]) - 3.0 * size if short else beta[begin]
        cum = np.cumsum(prob)
        cum -= np.repeat(cum[first] - prob[first], count)
        cum /= np.repeat(cum[first + count - 1], count)
        n = len(self.number)
        self.number.update(zip(words, range(n, n + len(words)), strict=True))
        for name, new in (("start", begin + self.n_nodes), ("size", size), ("total", sums)):
            self.grow(name, n, new)
        self.grow("first", self.n_nodes + 1, self.n_edges + np.cumsum(count))
        for name, new in (("step", step + 1), ("piece", piece), ("cum", cum), ("prob", prob)):
            self.grow(name, self.n_edges, new)
        self.n_nodes, self.n_edges = self.n_nodes + nodes, self.n_edges + len(piece)

    @staticmethod
    def bytes_of(points: np.ndarray) -> np.ndarray:
        return 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)

    def walk(self, node: np.ndarray, end: np.ndarray, key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draws a path from each node to its end: (edges in order, edges of each). key and place seed the draws."""
        # Equal words are walked side by side, so that their lattices are read together.
        order = np.argsort(node)
        node = node[order]
        end, key, ahead, drawn = end[order], key[order], place[order] - node, []
        count = np.zeros(len(order), np.int64)
        while len(node):
            going = np.flatnonzero(node < end)
            if len(going) < len(node):
                order, node, end, key, ahead = order[going], node[going], end[going], key[going], ahead[going]
            u = uniform(key, ahead + node)
            # The longest edge is mostly the likeliest, so the first edge whose sum exceeds u is looked for from there.
            first, e = self.first[node], self.first[node + 1] - 1
            go = np.flatnonzero(~(self.cum[e - 1] <= u) & (e > first))
            while len(go):
                e[go] -= 1
                go = go[~(self.cum[e[go] - 1] <= u[go]) & (e[go] > first[go])]
            drawn.append((order, e))
            count[order] += 1
            node = node + self.step[e]
        first = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int64)
        for k, (who, e) in enumerate(drawn):
            out[first[who] + k] = e
        return out, count

    def ids(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vocabulary ids of pieces, how many ids each takes)."""
        bare = np.flatnonzero(p < -1)
        count = np.ones(len(p), np.int64)
        count[bare] = self.bytes_of(-2 - p[bare])
        out, at = np.repeat(p, count), (np.cumsum(count) - count)[bare]
        for x in np.unique(p[bare]).tolist():
            here = at[p[bare] == x]
            for k, byte in enumerate(chr(-2 - x).encode()):
                out[here + k] = self.byte_id[byte]
        return out, count


def uniform(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """In (0, 1), from 53 bits of a hash."""
    with np.errstate(over="ignore"):
        h = B.mix(key + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    h >>= np.uint64(11)
    u = h.astype(np.float64)
    u += 0.5
    u *= 2.0**-53
    return u


def lattices(model: str = "piece_bpe_32k.model") -> Lattices:
    if model not in _models:
        _models[model] = Lattices(model)
    return _models[model]


def mix_one(h: int) -> int:
    """The same mixing as of arrays, on one number."""
    full = (1 << 64) - 1
    h &= full
    h = (h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 & full
    h = (h ^ (h >> 32)) * 0x94D049BB133111EB & full
    return h ^ (h >> 29)


def uniform_one(key: int, place: int) -> float:
    """The same draw as of arrays, as one number."""
    return (float(mix_one(key + place * 0x9E3779B97F4A7C15) >> 11) + 0.5) * 2.0**-53


class Search:
    """The agenda of one text: other edges than those taken, by perturbed value."""

    def __init__(self, lat: Lattices, key: int, k: int) -> None:
        self.lat, self.key, self.k = lat, int(key), k
        self.agenda: list[tuple] = []
        self.paths: list[np.ndarray] = []
        self.values: list[float] = []

    def salt(self, sample: int, use: int) -> int:
        """Another key for each use of each sample."""
        return mix_one(self.key + (sample * 8 + use + 1) * 0xD1B54A32D192ED03)

    def add(self, value: float, path: np.ndarray) -> int:
        self.paths.append(path)
        self.values.append(value)
        return max(self.k - len(self.paths) + 1, 1)

    def enter(self, entries: list[tuple], left: int) -> None:
        self.agenda = sorted(self.agenda + entries, reverse=True)[:left]

    def settled(self, phi: float, left: int) -> bool:
        """Whether no edge after one reached with log-probability phi can still enter the agenda."""
        return len(self.agenda) == left and phi + MOST_NOISE < self.agenda[-1][0]

    def branch(self) -> tuple[int, int, int, float, float] | None:
        """Takes the best entry: (parent, edge number, the edge taken instead, log-probability before it, value)."""
        if not self.agenda:
            return None
        value, parent, at, phi, shut = self.agenda.pop(0)
        sample = len(self.paths)
        lo = int(np.searchsorted(self.lat.first[: self.lat.n_nodes + 1], shut[0], side="right")) - 1
        begin, end = int(self.lat.first[lo]), int(self.lat.first[lo + 1])
        options = [(e, p) for e, p in zip(range(begin, end), self.lat.prob[begin:end].tolist(), strict=True) if e not in shut and p > 0]
        salt = self.salt(sample, 2)
        u, noise = uniform_one(salt, 0), uniform_one(salt, 1)
        whole = sum(p for _, p in options)
        u, new, rest = u * whole, options[-1][0], whole - options[-1][1]
        for e, p in options:
            if u < p:
                new, rest = e, whole - p
                break
            u -= p
        if len(options) > 1 and rest > 0:
            g = phi + math.log(rest) - math.log(-math.log(noise))
            self.agenda.append((float(-np.logaddexp(-g, -value)), parent, at, phi, (*shut, new)))
            self.agenda.sort(reverse=True)
        return parent, at, new, phi, value


def add_paths(lat: Lattices, found: list[tuple[Search, float, np.ndarray, int, float]], widths: tuple[int, int] = (48, 512)) -> None:
    """Takes finished segmentations in: (search, value, path, first new edge, log-probability before it).

    Edges are looked at in windows. After the first window an agenda is mostly full, and an edge enters only if its noise lifts it over
    the agenda's last value; that is ruled out for nearly all edges by 1 - u > mass / exp(last), without a logarithm.
    """
    open_ = [(s, s.add(value, path), len(s.paths) - 1, value, path, begin, phi) for s, value, path, begin, phi in found]
    open_ = [x for x in open_ if x[5] < len(x[4])]
    width = widths[0]
    while open_:
        size = np.array([min(width, len(path) - begin) for _, _, _, _, path, begin, _ in open_])
        shown = np.arange(width) < size[:, None]
        p = np.ones(shown.shape)
        p[shown] = np.minimum(lat.prob[np.concatenate([path[begin : begin + width] for _, _, _, _, path, begin, _ in open_])], 1.0)
        phi0, value, begin = (np.array([x[k] for x in open_]) for k in (6, 3, 5))
        last = np.array([s.agenda[-1][0] if len(s.agenda) == left else -np.inf for s, left, *_ in open_])
        salt = np.array([s.salt(sample, 1) for s, _, sample, *_ in open_], np.uint64)[:, None]
        u = uniform(salt, begin[:, None] + np.arange(width))
        after = np.cumprod(p, 1)
        # Far below the numbers' range products say nothing; there every edge is looked at by logarithms.
        with np.errstate(over="ignore", divide="ignore"):
            limit = np.where(last - phi0 < -300, 0.0, np.exp(np.minimum(last - phi0, 700.0)))
            ends = phi0 + (np.log(after[:, -1]) if (after[:, -1] > 1e-280).all() else np.log(p).sum(1))
        mass = 1 - p
        mass[:, 1:] *= after[:, :-1]
        row, col = np.nonzero((mass >= (1 - u) * limit[:, None]) & (p < 1))
        before = np.zeros(len(row))
        inside = col > 0
        prior = after[row[inside], col[inside] - 1]
        if (prior > 1e-280).all():
            before[inside] = np.log(prior)
        else:
            with np.errstate(divide="ignore"):
                before[inside] = np.cumsum(np.log(p), 1)[row[inside], col[inside] - 1]
        before += phi0[row]
        g = -np.logaddexp(-(before + np.log1p(-p[row, col]) - np.log(-np.log(u[row, col]))), -value[row])
        cut = np.searchsorted(row, np.arange(len(open_) + 1)).tolist()
        again = []
        for i, (s, left, sample, v, path, at, _) in enumerate(open_):
            if cut[i] < cut[i + 1]:
                part = slice(cut[i], cut[i + 1])
                best = np.argpartition(-g[part], left - 1)[:left] + cut[i] if cut[i + 1] - cut[i] > left else range(cut[i], cut[i + 1])
                s.enter([(float(g[j]), sample, at + int(col[j]), float(before[j]), (int(path[at + col[j]]),)) for j in best], left)
            if at + width < len(path) and not s.settled(float(ends[i]), left):
                again.append((s, left, sample, v, path, at + width, float(ends[i])))
        open_, width = again, widths[1]


def sample_texts(texts: list[str | None], keys: np.ndarray, k: int, lat: Lattices) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text its samples: (ids, log-probability, perturbed value, log inclusion probability)."""
    chunks, count = [], []
    for t in texts:
        if not t:
            c = []
        elif "  " in t or MARK in t or t[0] == " " or t[-1] == " ":
            c = [x[1:] for x in CHUNK.findall(MARK + t.replace(MARK, HELD).replace(" ", MARK))]
        else:
            c = t.split(" ")
        chunks += c
        count.append(len(c))
    word = lat.words(chunks)
    start, size = lat.start[word], lat.size[word]
    count = np.array(count, np.int64)
    last = np.cumsum(count)
    text_of = np.repeat(np.arange(len(texts)), count)
    place = np.cumsum(size) - size  # unique in the batch; made relative to the text below
    begin = np.r_[place, size.sum()][last - count]
    place = place - begin[text_of]
    every = [Search(lat, key, k) for key in keys.tolist()]
    nothing = np.zeros(0, np.int64)
    salts = np.array([s.salt(0, 0) for s in every], np.uint64)
    edges, n = lat.walk(start, start + size, salts[text_of], place)
    upto = np.r_[0, np.cumsum(n)]
    tops = -np.log(-np.log(uniform(np.array([s.salt(0, 3) for s in every], np.uint64), np.zeros(1)))) if every else nothing
    add_paths(lat, [(s, float(tops[i]), edges[upto[last[i] - count[i]] : upto[last[i]]] if count[i] else nothing, 0, 0.0) for i, s in enumerate(every)])
    for j in range(1, k):
        todo = [(i, b) for i, s in enumerate(every) if len(s.paths) == j and (b := s.branch())]
        if not todo:
            break
        # What is left of the branching word, then all later words of that text, drawn for all texts at once.
        heads, node, stop, whose, places, lengths = [], [], [], [], [], []
        for i, (parent, at, new, _, _) in todo:
            path = every[i].paths[parent]
            first = int(last[i] - count[i])
            done = int(lat.step[path[:at]].sum()) + int(lat.step[new])
            w = first + int(np.searchsorted(place[first : last[i]], done, side="right")) - 1
            inside = done - int(place[w])
            later = slice(w + 1, last[i])
            heads.append(np.r_[path[:at], new])
            if inside < size[w]:
                node.append([start[w] + inside])
                stop.append([start[w] + size[w]])
                places.append([done])
            node.append(start[later])
            stop.append(start[later] + size[later])
            places.append(place[later])
            lengths.append((inside < size[w]) + int(last[i]) - w - 1)
            whose.append(every[i].salt(j, 0))
        edges, n = lat.walk(*(np.concatenate(x).astype(np.int64) for x in (node, stop)), np.repeat(np.array(whose, np.uint64), lengths), np.concatenate(places).astype(np.int64))
        upto = np.r_[0, np.cumsum(n)]
        at_word, found = 0, []
        for (i, (_, at, new, phi, value)), head, m in zip(todo, heads, lengths, strict=True):
            found.append((every[i], value, np.concatenate([head, edges[upto[at_word] : upto[at_word + m]]]), at + 1, phi + math.log(max(float(lat.prob[new]), 1e-300))))
            at_word += m
        add_paths(lat, found)
    mass = np.bincount(text_of, lat.total[word], minlength=len(texts))
    paths = [p for s in every for p in s.paths]
    owner = np.repeat(np.arange(len(paths)), [len(p) for p in paths])
    piece = lat.piece[np.concatenate(paths)] if paths else nothing
    weight = lat.weight[np.maximum(piece, 0)]
    weight[piece < 0] = lat.byte_weight * lat.bytes_of(-2 - piece[piece < 0])
    sums = np.bincount(owner, weight, minlength=len(paths)).tolist()
    ids, size = lat.ids(piece)
    upto = np.r_[0, np.cumsum(np.bincount(owner, size, minlength=len(paths)).astype(np.int64))].tolist()
    out, at = [], 0
    for i, s in enumerate(every):
        limit = s.agenda[0][0] if s.agenda else -np.inf
        rows = []
        for value in s.values:
            f = sums[at] - float(mass[i])
            near = f - limit
            rows.append((ids[upto[at] : upto[at + 1]], f, value, 0.0 if limit == -np.inf else near if near < -30 else math.log(-math.expm1(-math.exp(min(near, 700.0))))))
            at += 1
        out.append(rows)
    return out


def encode(docs: DataFrame, k: int = 3, seed: int = 5, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, batch_bytes: int = 1 << 19, digest: bool = False) -> DataFrame:
    """id, sample (from 0), n_pieces, ids_crc32, log_prob, perturbed, log_inclusion and, if asked for, ids and decoded_sha256.

    digest: decodes every segmentation in the same task and adds the digest of the decoded text.
    """
    extra = [("ids", "array<int>")] * keep_ids + [("decoded_sha256", "string")] * digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattices(model)
        for b in batches:
            keys = b.column("key").to_numpy().view(np.uint64)
            for at, end in edges(b.column("text"), batch_bytes):
                got = sample_texts(b.column("text").slice(at, end - at).to_pylist(), keys[at:end], k, lat)
                rows = [(i, j, len(x[0]), zlib.crc32(x[0].astype("<u4").tobytes()), *x[1:]) for i, r in enumerate(got) for j, x in enumerate(r)]
                cols = [np.array(c) for c in zip(*rows, strict=True)]
                arrays = [b.column("id").slice(at, end - at).take(pa.array(cols[0])), pa.array(cols[1].astype("i4")), pa.array(cols[2].astype("i4")), pa.array(cols[3].astype("i8")), *(pa.array(c.astype("f8")) for c in cols[4:])]
                each = [x[0] for r in got for x in r]
                ids, upto = np.concatenate(each).astype("i4"), np.r_[0, np.cumsum([len(x) for x in each])].astype("i4")
                if keep_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(upto), pa.array(ids)))
                if digest:
                    arrays.append(pa.array([hashlib.sha256(x).hexdigest() for x in spell(ids, upto, model)]))
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "sample", "n_pieces", "ids_crc32", "log_prob", "perturbed", "log_inclusion", *(n for n, _ in extra)])

    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    d = d.withColumn("key", F.xxhash64(F.lit(seed), "id"))
    return d.mapInArrow(B.frugal(run), "id long, sample int, n_pieces int, ids_crc32 long, log_prob double, perturbed double, log_inclusion double" + "".join(f", {n} {kind}" for n, kind in extra))


def spellings(model: str) -> pa.Array:
    """The bytes of each vocabulary id, with a space for the mark; control ids spell nothing."""
    if ("spellings", model) not in _models:
        import public_tokenizers
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
        spelt = [b"" if sp.is_control(i) else sp.decode([i]).encode() if sp.is_unknown(i) else sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(sp.get_piece_size())]
        for byte in range(256):
            spelt[sp.piece_to_id(f"<0x{byte:02X}>")] = bytes([byte])
        _models["spellings", model] = pa.array(spelt, pa.binary())
    return _models["spellings", model]


def spell(ids: np.ndarray, upto: np.ndarray, model: str) -> Iterator[memoryview]:
    """The text of each run of ids between the places upto, as UTF-8 without the space that encoding puts first."""
    spelt = spellings(model).take(pa.array(ids, pa.int32()))
    at = np.frombuffer(spelt.buffers()[1], "i4", len(spelt) + 1)[upto].tolist()
    whole = memoryview(spelt.buffers()[2] or b"")
    for begin, end in zip(at, at[1:], strict=False):
        yield whole[begin + (begin < end and whole[begin] == 32) : end]


def decode(encoded: DataFrame, model: str = "piece_bpe_32k.model", ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded``, the text that the ids spell."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        each = [np.zeros(0, "i4") if x is None else np.asarray(x, "i4") for x in ids]
        spelt = spell(np.concatenate([np.zeros(0, "i4"), *each]), np.r_[0, np.cumsum([len(x) for x in each], dtype=np.int64)], model)
        return pd.Series([None if x is None else str(t, "utf-8", "replace") for x, t in zip(ids, spelt, strict=True)], dtype=object)

    return encoded.withColumn("decoded", text(F.col(ids_col)))
