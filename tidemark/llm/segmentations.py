"""SentencePiece encoding and decoding with sampled segmentations: Gumbel top-k without replacement.

A text's segmentations are the paths of a lattice whose edges are the vocabulary's pieces. Each path's
log-probability is perturbed by Gumbel noise; the paths with the k largest values are k distinct samples
in order. They are found by A-star search from the top down: a node is a prefix and stands for all paths
through it, its value is the largest of theirs. The value of the whole lattice is drawn first; at each
step one child inherits its parent's value and the others are drawn below it, so values are exact upper
bounds and the best open node always comes next. Only the k best open nodes can matter, so no more are
kept. An inclusion score is the probability that a segmentation exceeds the (k+1)-th value.

A piece holds no word start after its first sign, so the lattice is a chain of word lattices; each kind
of word is built once in a task, all new ones of a batch together over their bytes, and all words of a batch
walk their lattices together, step by step. Noise is a hash of the row's key, the sample and the place, so a
rerun gives the same rows. Weights follow the vocabulary's ranks (Zipf and Mandelbrot); text outside the
vocabulary goes by byte pieces.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text
from .tokens import blocks, buffers, span_hashes

MODEL, SAMPLES, EXPONENT, SHIFT, HELD = "/opt/tokenizers/piece_bpe_32k.model", 2, 1.0, 50.0, 50_000
#: Bytes of text that are walked together, one text at least.
MARK, SLOTS, FEW, PART = "▁", 20, 24, 1 << 18
#: Noise of a child, -log(-log u), for u from 2^-54 to HIGHEST; how many steps of a text are looked at to bound the rest.
HIGHEST, HEAD = 1 - 2.0**-53, 64
LEAST, MOST = -math.log(54 * math.log(2)), -math.log(-math.log(HIGHEST))
_BASE, _TURN = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_PARTS = [np.uint64(k) for k in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def _grown(h: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """Hashes of byte strings with one more byte."""
    return h * _BASE + byte + np.uint64(1)


def _slot(h: np.ndarray) -> np.ndarray:
    return ((h * _TURN) >> np.uint64(64 - SLOTS)).astype(np.int64)


class Vocabulary:
    """Pieces and their log-probabilities, read from a SentencePiece model file (on the driver). As bytes, the
    mark is the blank it stands for."""

    def __init__(self, model: str = MODEL):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=model)
        self.pieces, self.bytes, self.raw = {}, np.zeros(256, np.int32), [b""] * p.get_piece_size()
        for i in range(p.get_piece_size()):
            if p.is_byte(i):
                b = int(p.id_to_piece(i)[3:5], 16)
                self.bytes[b], self.raw[i] = i, bytes([b])
            elif not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i)):
                # a mark inside a piece (runs of blanks) would join words
                if MARK not in p.id_to_piece(i)[1:]:
                    self.pieces[p.id_to_piece(i)] = i
                self.raw[i] = p.id_to_piece(i).replace(MARK, " ").encode()
        order = {i: r for r, i in enumerate(sorted(self.pieces.values(), key=lambda i: (-p.get_score(i), i)))}
        weight = lambda r: -EXPONENT * np.log(r + SHIFT)
        total = np.log(np.exp(weight(np.arange(len(order) + 256.0))).sum())
        self.log_p = {i: float(weight(r) - total) for i, r in order.items()}
        self.byte_p = float(weight(len(order) + 255.0) - total)
        # pieces by hash: a first look at a few bits tells pieces (1) and beginnings of pieces (2), a second one
        # which piece it is, mostly
        forms = [self.raw[i] for i in self.pieces.values()]
        self.longest = max(map(len, forms))
        self.signs, self.guess = np.zeros(1 << SLOTS, np.uint8), np.zeros(1 << SLOTS, np.int32)
        h, whole = np.zeros(len(forms), np.uint64), np.zeros(len(forms), np.uint64)
        sizes = np.array([len(f) for f in forms])
        for n in range(self.longest):
            on = sizes > n
            h[on] = _grown(h[on], np.array([f[n] for f in forms if len(f) > n], np.uint64))
            self.signs[_slot(h[on])] |= 2
            whole[sizes == n + 1] = h[sizes == n + 1]
        self.signs[_slot(whole)] |= 1
        by = np.argsort(whole)
        self.guess[_slot(whole[by])] = np.arange(len(by))
        self.hashes, self.ids = whole[by], np.array(list(self.pieces.values()), np.int32)[by]
        self.weights = np.array([self.log_p[int(i)] for i in self.ids])
        self.texts = pa.array(self.raw, pa.large_binary())

    def decode(self, ids: list[int]) -> str:
        """The text of a segmentation; the inverse of encoding, but for the blank that encoding puts first."""
        return b"".join([self.raw[i] for i in ids]).decode("utf-8", "replace").removeprefix(" ")


def joined(v: Vocabulary, lists: pa.ListArray) -> pa.Array:
    """The texts of lists of pieces, all together; null for null."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    bounds = lists.offsets.to_numpy().astype(np.int64)
    # pieces one after another, as taken, are the texts one after another
    taken = v.texts.take(lists.values.slice(bounds[0], bounds[-1] - bounds[0]))
    _, where, held = taken.buffers()
    stops = np.frombuffer(where, np.int64)[: len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
    data = np.frombuffer(held, np.uint8)[: stops[-1]] if stops[-1] else np.zeros(0, np.uint8)
    ends = stops[bounds - bounds[0]]
    # the blank that encoding puts first goes
    full = np.flatnonzero(ends[1:] > ends[:-1])
    first = ends[full][data[ends[full]] == 32]
    gone = np.zeros(len(data) + 1, np.int64)
    gone[first + 1] = 1
    ends = ends - np.cumsum(gone)[ends]
    data = np.delete(data, first)
    valid = pa.array(lists.is_valid().to_numpy(zero_copy_only=False)).buffers()[1] if lists.null_count else None
    texts = pa.Array.from_buffers(pa.large_string(), len(lists), [valid, pa.py_buffer(ends), pa.py_buffer(data.tobytes())])
    try:
        texts.validate(full=True)
    except pa.ArrowInvalid:  # byte pieces in an order that spells no text
        return pa.array([None if p is None else v.decode(p) for p in lists.to_pylist()], pa.string())
    return texts.cast(pa.string())


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, each with a blank before it, the bounds of their words, which begin at blanks, and
    how many each text has."""
    data, offsets = buffers(texts)
    n = len(offsets) - 1
    out = np.full(len(data) + n, 32, np.uint8)
    at = np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))
    out[at] = data
    starts = np.flatnonzero(out == 32)
    bounds = offsets + np.arange(n + 1)
    return out, starts, np.append(starts[1:], len(out)), np.diff(np.searchsorted(starts, bounds))


class _Row:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.held, self.n = np.zeros(1024, kind), 0

    def add(self, part: np.ndarray) -> None:
        if self.n + len(part) > len(self.held):
            more = np.zeros(max(2 * len(self.held), self.n + len(part)), self.held.dtype)
            more[: self.n] = self.held[: self.n]
            self.held = more
        self.held[self.n : self.n + len(part)] = part
        self.n += len(part)

    @property
    def all(self) -> np.ndarray:
        return self.held[: self.n]


class Lattices:
    """Word lattices of a task as flat arrays. A state is a byte of a word; its edges lie together. gain: the
    log-probability of an edge given its state; gains sum to the path's. low: the gains before it in its state,
    summed. Words are told apart by 64-bit hashes."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.known, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._piece, self._next, self._gain, self._low, self._first = _Row(np.int32), _Row(np.int64), _Row(float), _Row(float), _Row(np.int64)
        self._roots, self._masses = _Row(np.int64), _Row(float)
        self.codes: dict[int, int] = {}
        self.spelled: list[np.ndarray] = []
        self._view()

    def _view(self) -> None:
        self.piece, self.next, self.gain, self.low = self._piece.all, self._next.all, self._gain.all, self._low.all
        self.first = np.append(self._first.all, self._piece.n)
        self.roots, self.masses = self._roots.all, self._masses.all

    def kinds(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The numbers of the words' kinds; lattices of new kinds are built."""
        coded = pa.array(span_hashes(data, starts, ends)).dictionary_encode()
        found, back = coded.dictionary.to_numpy(), coded.indices.to_numpy().astype(np.int64)
        at = np.minimum(np.searchsorted(self.known, found), max(len(self.known) - 1, 0))
        old = self.known[at] == found if len(self.known) else np.zeros(len(found), bool)
        numbers = np.empty(len(found), np.int64)
        numbers[old] = self.numbers[at[old]]
        if not old.all():
            one = np.empty(len(found), np.int64)
            one[back[::-1]] = np.arange(len(back))[::-1]  # where each kind is first
            new = np.flatnonzero(~old)
            new = new[np.argsort(found[new])]
            numbers[new] = np.arange(len(new)) + self._roots.n
            self._build(data, starts[one[new]], ends[one[new]])
            place = np.searchsorted(self.known, found[new])
            self.known, self.numbers = np.insert(self.known, place, found[new]), np.insert(self.numbers, place, numbers[new])
            self._view()
        return numbers[back]

    def _build(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        v, sizes = self.v, ends - starts
        stops = np.cumsum(sizes)
        buf = _at(data, _ranges(starts, sizes)).astype(np.uint64)
        end = np.repeat(stops, sizes)
        lead = np.flatnonzero((buf & np.uint64(0xC0)) != 0x80)
        sign = np.append(lead[1:], len(buf)) - lead
        # grow all beginnings at once; what is no beginning of a piece drops out
        at, h, n = lead, np.zeros(len(lead), np.uint64), 0
        src, size, which = [], [], []
        while len(at) and n < v.longest:
            if n:
                inside = at + n < _at(end, at)
                at, h = np.compress(inside, at), np.compress(inside, h)
            h = _grown(h, _at(buf, at + n))
            n += 1
            slot = _slot(h)
            kind = _at(v.signs, slot)
            hit = np.flatnonzero(kind & 1)
            if len(hit):
                p, own = _at(v.guess, _at(slot, hit)), _at(h, hit)
                right = _at(v.hashes, p) == own
                odd = np.flatnonzero(~right)
                if len(odd):
                    p[odd] = np.minimum(np.searchsorted(v.hashes, own[odd]), len(v.hashes) - 1)
                    right[odd] = v.hashes[p[odd]] == own[odd]
                src.append(np.compress(right, _at(at, hit))), which.append(np.compress(right, p)), size.append(n)
            on = kind > 1
            at, h = np.compress(on, at), np.compress(on, h)
        # a sign that is no piece is spelled in bytes
        length, alone = np.zeros(len(buf), np.int64), np.zeros(len(buf), bool)
        length[lead] = sign
        for s, n in zip(src, size, strict=True):
            alone[np.compress(_at(length, s) == n, s)] = True
        bare = np.compress(~_at(alone, lead), lead)
        # edges are put where their state's are, one of each length after another
        rounds = [*((s, n, _at(v.ids, w), _at(v.weights, w)) for s, n, w in zip(src, size, which, strict=True)), (bare, length[bare], self._spell(buf, bare, length[bare]), v.byte_p * length[bare])]
        many = np.bincount(np.concatenate([r[0] for r in rounds]), minlength=len(buf))
        first = np.cumsum(many) - many
        total, free = int(many.sum()), first.copy()
        src, goal, piece, log_p = np.empty(total, np.int64), np.empty(total, np.int64), np.empty(total, np.int32), np.empty(total)
        for s, n, i, w in rounds:
            place = _at(free, s)
            free[s] = place + 1
            src[place], goal[place], piece[place], log_p[place] = s, s + n, i, w
        last = goal == _at(end, src)
        # masses from the ends of the words backward, all words together; far from the ends only a few very long
        # words are left: there, state by state is quicker
        mass = np.zeros(len(buf) + 1)
        by_size = np.sort(sizes)
        reach = int(by_size[-FEW]) if len(by_size) >= FEW else 0
        stop = stops[np.argsort(-sizes, kind="stable")]
        counts = len(sizes) - np.searchsorted(by_size, np.arange(1, reach + 1))
        for d, n in enumerate(counts.tolist(), 1):
            s = stop[:n] - d
            s = np.compress(_at(many, s) > 0, s)
            if not len(s):
                continue
            size = _at(many, s)
            e = _ranges(_at(first, s), size)
            x = _at(log_p, e) + np.where(_at(last, e), 0.0, _at(mass, _at(goal, e)))
            heads = np.cumsum(size) - size
            top = np.maximum.reduceat(x, heads)
            mass[s] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, size)), heads))
        if reach < by_size[-1]:
            far = np.flatnonzero(end[src] - src > reach)
            far = far[np.argsort((end[src[far]] - src[far]) * (len(buf) + 1) + src[far], kind="stable")]
            self._far(mass, *(x[far].tolist() for x in (src, goal, log_p, last)))
        gain = log_p + np.where(last, 0.0, _at(mass, goal)) - _at(mass, src)
        run = np.append(0.0, np.cumsum(np.exp(gain)))
        low = run[:-1] - _at(run, _at(first, src))
        states, edges = self._first.n, self._piece.n
        self._roots.add(stops - sizes + states), self._masses.add(mass[stops - sizes])
        self._first.add(first + edges), self._piece.add(piece), self._next.add(np.where(last, -1, goal + states)), self._gain.add(gain), self._low.add(low)

    @staticmethod
    def _far(mass: np.ndarray, src: list, goal: list, log_p: list, last: list) -> None:
        """Masses of states in order, one by one."""
        held: list[float] = []
        for k, (s, g, p, end) in enumerate(zip(src, goal, log_p, last, strict=True)):
            held.append(p if end else p + float(mass[g]))
            if k + 1 == len(src) or src[k + 1] != s:
                top = max(held)
                mass[s] = top + math.log(sum([math.exp(x - top) for x in held]))
                held = []

    def _spell(self, buf: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Marks, below zero, of signs outside the vocabulary."""
        code = np.zeros(len(at), np.int64)
        for n in range(int(size.max()) if len(size) else 0):
            on = size > n
            code[on] = code[on] * 256 + buf[at[on] + n].astype(np.int64)
        found, back = np.unique(code, return_inverse=True)
        for c in found.tolist():
            if c not in self.codes:
                self.codes[c] = -1 - len(self.spelled)
                self.spelled.append(self.v.bytes[list(c.to_bytes(max(1, (c.bit_length() + 7) // 8), "big"))])
        return np.array([self.codes[c] for c in found.tolist()], np.int32)[back] if len(at) else np.zeros(0, np.int32)

    def pieces(self, edges: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers of runs of edges, and where each run ends; a sign outside the vocabulary is its bytes."""
        out = self.piece[edges]
        odd = np.flatnonzero(out < 0)
        if not len(odd):
            return out, ends
        many = np.ones(len(out), np.int64)
        many[odd] = [len(self.spelled[-1 - m]) for m in out[odd].tolist()]
        stops = np.cumsum(many)
        whole = np.repeat(out, many)
        for k, m in zip(odd.tolist(), out[odd].tolist(), strict=True):
            whole[stops[k] - many[k] : stops[k]] = self.spelled[-1 - m]
        return whole, np.append(0, stops)[ends]


def address(seed: np.ndarray, *parts) -> np.ndarray:
    """A number for a seed and up to four places, before it is scrambled."""
    h, fixed = seed * _TURN, 0
    for k, p in zip(_PARTS, parts, strict=False):
        if isinstance(p, int):
            fixed += (p + 1) * int(k)
        else:
            h += p.astype(np.uint64) * k
    h += np.uint64(fixed % (1 << 64))
    return h


def uniform(h: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from addresses, which are used up."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    h >>= np.uint64(11)
    return (h + 0.5) * 2.0**-53


def _at(x: np.ndarray, i: np.ndarray) -> np.ndarray:
    """x[i] for places that are there, the quicker way."""
    return x.take(i, mode="clip")


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each range, one after another."""
    ends = np.cumsum(size)
    return np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def sample(lattices: Lattices, kinds: np.ndarray, counts: np.ndarray, seeds: np.ndarray, k: int = SAMPLES) -> list[list[dict]]:
    """Of each text (so many kinds of words, in order), up to k segmentations: edges, log_p, value, inclusion."""
    many = len(counts)
    starts = np.append(0, np.cumsum(counts))
    run = np.append(0.0, np.cumsum(lattices.masses[kinds]))
    log_z = run[starts[1:]] - run[starts[:-1]]
    value = log_z - np.log(-np.log(uniform(address(seeds, 0))))
    # an open node: value, the edges up to it, the word it stands in, the state after it, its relative log-probability
    opened: list[list[tuple]] = [[(value[d], np.zeros(0, np.int64), 0, None, 0.0)] for d in range(many)]
    done: list[list[dict]] = [[] for _ in range(many)]
    for turn in range(k):
        live = [d for d in range(many) if opened[d] and counts[d]]
        if not live:
            break
        nodes = [opened[d].pop(max(range(len(opened[d])), key=lambda i, d=d: (opened[d][i][0], -i))) for d in live]
        # every word from the node's on walks its lattice; the node's own word goes on from its state
        ids, words = np.array(live), np.array([n[2] for n in nodes])
        rest = counts[ids] - words
        docs, places = np.repeat(np.arange(len(live)), rest), _ranges(words, rest)
        state = _at(lattices.roots, _at(kinds, _at(starts[ids], docs) + places))
        heads = np.cumsum(rest) - rest
        for x, n in enumerate(nodes):
            if n[3] is not None and rest[x]:
                state[heads[x]] = n[3]
        drawn = address(_at(seeds[ids], docs), turn + 1, places)
        walked, step, at = [], 0, np.arange(len(docs))
        where = state
        while len(at):
            a = _at(lattices.first, where)
            size = _at(lattices.first, where + 1) - a
            u = uniform(_at(drawn, at) + np.uint64((step + 1) * int(_PARTS[2]) % (1 << 64)))
            # the last edge whose lower end is at most u
            under = _at(lattices.low, _ranges(a, size)) <= np.repeat(u, size)
            taken = a + np.maximum(np.add.reduceat(under, np.cumsum(size) - size, dtype=np.int64), 1) - 1
            walked.append((at, taken, where))
            where = _at(lattices.next, taken)
            on = where >= 0
            at, where, step = np.compress(on, at), np.compress(on, where), step + 1
        # steps of a word stand together in the order they were taken
        taken = np.bincount(np.concatenate([w[0] for w in walked]), minlength=len(docs)) if walked else np.zeros(len(docs), np.int64)
        begin = np.cumsum(taken) - taken
        item, order = np.repeat(np.arange(len(docs)), taken), _ranges(np.zeros(len(docs), np.int64), taken)
        edge, held = np.empty(len(item), np.int64), np.empty(len(item), np.int64)
        for n, (at, taken, where) in enumerate(walked):
            place = _at(begin, at) + n
            edge[place], held[place] = taken, where
        doc, gain = _at(docs, item), _at(lattices.gain, edge)
        ends = np.searchsorted(doc, np.arange(len(live) + 1))
        run = np.append(0.0, np.cumsum(gain))
        before = run[:-1] + _at(np.array([n[4] for n in nodes]) - run[ends[:-1]], doc)
        # the children not taken: their values fall below the node's, and the more noise they draw the higher. Noise is
        # within LEAST and MOST, so a child so far below others that it can't be among the wanted is not drawn
        base = before + _at(log_z[ids], doc)
        wide = np.ones(len(edge), bool)
        head = np.flatnonzero(_at(ends, doc) + HEAD > np.arange(len(edge))) if len(edge) > HEAD * len(live) // 2 else np.zeros(0, np.int64)
        if len(head):
            a, size = _at(lattices.first, _at(held, head)), _at(lattices.first, _at(held, head) + 1)
            size = size - a
            flat, owner = _ranges(a, size), np.repeat(head, size)
            other = flat != _at(edge, owner)
            phi = np.where(other, _at(base, owner) + _at(lattices.gain, flat), -np.inf)
            of, bar = _at(doc, owner), np.full(len(live), -np.inf)
            by = np.lexsort((-phi, of))
            first = np.searchsorted(of[by], np.arange(len(live)))
            for x, d in enumerate(live):
                n = first[x] + k - len(done[d]) - 1
                if n < len(by) and of[by[n]] == x:
                    bar[x] = phi[by[n]]
            wide = base >= _at(bar, doc) - (MOST - LEAST) - 1e-6
        near = np.flatnonzero(wide)
        a = _at(lattices.first, _at(held, near))
        size = _at(lattices.first, _at(held, near) + 1) - a
        flat, owner = _ranges(a, size), np.repeat(near, size)
        sibling = flat - np.repeat(a, size)
        other = flat != _at(edge, owner)
        flat, owner, sibling = np.compress(other, flat), np.compress(other, owner), np.compress(other, sibling)
        of = _at(doc, owner)
        phi = _at(base, owner) + _at(lattices.gain, flat)
        h = _at(_at(drawn, item) + order.astype(np.uint64) * _PARTS[2] + np.uint64(int(_PARTS[3]) * 7 % (1 << 64)), owner)
        h += sibling.astype(np.uint64) * _PARTS[3]
        child = phi - np.logaddexp(phi - _at(np.array([n[0] for n in nodes]), of), np.log(-np.log(np.minimum(uniform(h), HIGHEST))))
        owns = np.searchsorted(of, np.arange(len(live) + 1))
        for x, (d, node) in enumerate(zip(live, nodes, strict=True)):
            a, b = ends[x], ends[x + 1]
            done[d].append({"edges": np.concatenate([node[1], edge[a:b]]), "log_p": float(log_z[d] + node[4] + run[b] - run[a]), "value": float(node[0])})
            i, j = owns[x], owns[x + 1]
            wanted = k + 1 - len(done[d])
            best = i + (np.argpartition(-child[i:j], wanted)[: wanted + 1] if j - i > wanted + 1 else np.arange(j - i))
            for c in best[np.lexsort((best, -child[best]))][:wanted].tolist():
                o, after = owner[c], int(lattices.next[flat[c]])
                word = int(places[item[o]])
                opened[d].append((float(child[c]), np.concatenate([node[1], edge[a:o], flat[c : c + 1]]), word if after >= 0 else word + 1, after if after >= 0 else None, float(before[o] + lattices.gain[flat[c]])))
            opened[d] = sorted(opened[d], key=lambda n: -n[0])[:wanted]
    for d, found in enumerate(done):
        bar = max((n[0] for n in opened[d]), default=-np.inf)
        for f in found:
            f["inclusion"] = float(-np.expm1(-np.exp(min(f["log_p"] - bar, 50.0))))
    return done


def sampled_segmentations(docs: DataFrame, keys: tuple[str, ...], text: str = "text", samples: int = SAMPLES, model: str = MODEL) -> DataFrame:
    """Rows of keys, sample (from 1), pieces (numbers), log_prob, value (perturbed), inclusion.

    Each text has `samples` rows, or as many as it has segmentations. Null texts are empty; the empty
    text has one segmentation, the lone mark's. Rows with equal keys and texts get equal samples. Runs of
    blanks are single marks one after another. Other columns, clashing names too, are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(model))
    rows = docs.select(*keys, F.xxhash64(*keys).alias("__seed"), whole_text(text).alias("__text"))
    schema = rows.select(*keys, F.lit(0).alias("sample"), F.array(F.lit(0)).alias("pieces"), *(F.lit(0.0).alias(c) for c in ("log_prob", "value", "inclusion"))).schema

    def encode(batches):
        lattices = Lattices(shared.value)
        for whole in batches:
            for i, j in blocks(buffers(whole.column("__text"))[1], PART):
                batch = whole.slice(i, j - i)
                if len(lattices.known) > HELD:
                    lattices = Lattices(shared.value)
                data, starts, ends, counts = split_words(batch.column("__text"))
                found = sample(lattices, lattices.kinds(data, starts, ends), counts, batch.column("__seed").to_numpy().view(np.uint64), samples)
                at = np.repeat(np.arange(len(found)), [len(f) for f in found])
                flat = [s for f in found for s in f]
                ids, stops = lattices.pieces(np.concatenate([s["edges"] for s in flat]), np.cumsum([len(s["edges"]) for s in flat]))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).take(pa.array(at)) for c in keys),
                        pa.array([n + 1 for f in found for n in range(len(f))], pa.int32()),
                        pa.ListArray.from_arrays(pa.array(np.append(0, stops).astype(np.int32)), pa.array(ids.astype(np.int32))),
                        *(pa.array([s[c] for s in flat], pa.float64()) for c in ("log_p", "value", "inclusion")),
                    ],
                    [*keys, "sample", "pieces", "log_prob", "value", "inclusion"],
                )

    return rows.mapInArrow(encode, schema)


def decoded(encoded: DataFrame, pieces: str = "pieces", text: str = "text", model: str = MODEL) -> DataFrame:
    """The rows with the text of their pieces in a new column; null pieces make a null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(model))
    schema = encoded.drop(text).withColumn(text, F.lit(None).cast("string")).schema
    kept = [c for c in encoded.columns if c != text]

    def decode(batches):
        for whole in batches:
            bounds = whole.column(pieces).offsets.to_numpy().astype(np.int64)
            for i, j in blocks(bounds - bounds[0], PART // 4):
                batch = whole.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), joined(shared.value, batch.column(pieces))], [*kept, text])

    return encoded.mapInArrow(decode, schema)
