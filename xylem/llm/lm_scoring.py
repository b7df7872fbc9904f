"""Language-model scores by online logistic context mixing.

A text is read as its words in lower case with a space after each and an end
mark last. Each byte is a path of binary decisions down a Huffman tree. For
every context the counts of each decision in all training texts predict it:
the last 1, 2, 3 and 4 bytes of the word and the whole word so far; across words
the last 3 and 5 bytes of the text, and for a word's first byte or the end the whole
word before; all hashed. The predictions' logits are weighed by a set of weights that a gate picks by
how much the highest orders have seen. Weights learn online from every decision of the training texts, each predicted
without its own count: every chunk of texts takes gradient steps over its own,
with its own counts, and the chunks' weights are averaged. Within a text learning goes on: a second layer has a factor for
each of four groups of predictors, and after every ``STEP`` bytes it takes a gradient step over their decisions.
Nothing but what came before predicts, so the score, the even mean of the text's probability with the second layer
and without, is the logarithm of a true probability: over all texts it
sums to one at most. Where all contexts are the same, logits are computed once a chunk.

The base is a unigram model with one added to every count. Words and contexts
are counted exactly: every chunk sends its distinct (context, byte) pairs and
words by range of hash, and gets the totals at its own back. No table is of fixed size and
nothing that grows is gathered.
"""

from __future__ import annotations

import ctypes
import heapq
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import islice, zip_longest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import give_back, lean, read_table, remainder, written
from .words import Hasher, mix

#: Bytes of context of each predictor; the last reads the whole word so far.
ORDERS = (1, 2, 3, 4, 0)
#: Bytes of context of the predictors that look across words, where that is more than the word so far. One more reads the word before.
ACROSS = (3, 5)
LONGEST, PREDICTORS = max(ACROSS), len(ORDERS) + len(ACROSS) + 1
#: The predictors' groups that have a factor each within a text.
GROUP = np.array([0, 0, 1, 1, 2, 3, 3, 3])
SPACE, END = 0x20, 0x0A
#: Bytes of text in a chunk; a longer text has one of its own.
CHUNK = 8 << 20
#: Eight states of each of the two orders that gate: steps of how much they have seen, and whether both turns; and the steps of the longest that looks across.
GATES = 256
GATING, STEPS = (2, 4), (1, 3, 16)
#: A pair's number: a hash of its context above three bits of its order and the byte's rank.
LOW = 11
#: Keeps the orders' contexts apart.
SALT = 0x5851F42D4C957F2D
#: Bytes between two steps of learning within a text, and the length of the first; texts that take steps together.
STEP, STEP_RATE, TOGETHER = 64, 0.05, 256
#: Levels of an edge whose decisions lie together, as most edges have about as many.
HEAD = 4
#: What a group's logit is kept in, to 2 bytes.
UNIT = np.float32(2.0**-10)
#: Decisions between two steps of learning, and the length of the first steps.
BLOCK, RATE = 1 << 15, 0.05
#: Neighbouring edges that stay together when edges are shuffled for learning.
RUN = 64
#: Pairs that meet in one range of hashes.
RANGE_PAIRS = 4_000_000
#: Pairs whose codes are packed or unpacked in one go, of several chunks or ranges.
PACKED = 1 << 18


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key's group, numbered as they first appear, and where that is."""
    back = pa.Array.from_buffers(pa.uint64(), len(keys), [None, pa.py_buffer(keys)]).dictionary_encode().indices.to_numpy()
    return back, np.flatnonzero(np.diff(np.maximum.accumulate(back), prepend=np.int32(-1)))


def ordered(keys: np.ndarray, width: int) -> np.ndarray:
    """An order of the pairs' numbers, by what is below and above their 16 lowest bits; faster than an order at once."""
    low = max(1, len(keys) - 1).bit_length()
    if width + LOW - 16 + low > 64:
        return np.argsort(keys)
    bits = (keys >> np.uint64(64 - width) << np.uint64(LOW)) | (keys & np.uint64((1 << LOW) - 1))
    at = np.argsort(bits.astype(np.uint16), kind="stable")
    bits >>= np.uint64(16)
    both = bits.take(at) << np.uint64(low) | np.arange(len(keys), dtype=np.uint64)
    both.sort()
    return at.take((both & np.uint64((1 << low) - 1)).astype(np.int64))


def keep_freed() -> None:
    """Until ``let_go``, arrays of under 8 MB and some memory beyond stay with the process, where the C library can: arrays that come and go cost no new pages each time."""
    library = ctypes.CDLL(None)
    if hasattr(library, "mallopt"):
        library.mallopt(-1, 1 << 25)  # M_TRIM_THRESHOLD
        library.mallopt(-3, 1 << 23)  # M_MMAP_THRESHOLD


def let_go() -> None:
    library = ctypes.CDLL(None)
    if hasattr(library, "mallopt"):
        library.mallopt(-1, 1 << 17)
    give_back()


class Tree:
    """Huffman tree over bytes: every byte's nodes and turns, level by level."""

    def __init__(self, frequency: np.ndarray) -> None:
        heap = [(int(f) + 1, b, b) for b, f in enumerate(frequency)]
        heapq.heapify(heap)
        node, children = 256, {}
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            children[node] = (a[2], b[2])
            heapq.heappush(heap, (a[0] + b[0], node, node))
            node += 1
        path: dict[int, list] = {}  # bytes under a node follow each other
        stack = [(heap[0][2], [])]
        while stack:
            n, way = stack.pop()
            if n < 256:
                path[n] = way
            else:
                stack += [(c, [*way, (n - 256, turn)]) for turn, c in enumerate(children[n])]
        self.depth = np.array([len(path[b]) for b in range(256)], np.uint8)
        self.turn = np.zeros((self.depth.max(), 256), bool)
        self.node = np.zeros(self.turn.shape, np.int16)
        self.byte = np.array(list(path), np.uint8)
        self.rank = np.argsort(self.byte).astype(np.uint64)
        for b, way in path.items():
            for level, (n, turn) in enumerate(way):
                self.node[level, b], self.turn[level, b] = n, turn

    def depth_of(self, keys: np.ndarray) -> np.ndarray:
        return self.depth[self.byte[(keys & np.uint64(0xFF)).astype(np.uint8)]]


def numbered(context: np.ndarray, order: int, rank: np.ndarray, width: int) -> np.ndarray:
    """The pairs' numbers, with ``width`` bits of hash at the top."""
    h = mix(context ^ np.uint64(SALT * (2 * order + 1) & 0xFFFFFFFFFFFFFFFF))
    return ((h >> np.uint64(64 - width)) << np.uint64(64 - width)) | np.uint64(order << 8) | rank


def prefixes(buf: np.ndarray, at: np.ndarray, into: np.ndarray, hasher: Hasher) -> np.ndarray:
    """A 64-bit hash of the ``into`` bytes before each of the positions ``at``."""
    if len(buf) >= len(hasher.power):
        hasher.grow(len(buf))
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * hasher.power[: len(buf)], out=sums[1:])
    return (sums.take(at) - sums.take(at - into)) * hasher.inverse.take(at - into)


class Spelling:
    """A chunk's distinct words, in order, spelt out: the edges (word so far, byte) of their trie, and each order's pairs."""

    def __init__(self, spelt: bytes, tree: Tree, hasher: Hasher, width: int = 64 - LOW) -> None:
        buf = np.frombuffer(spelt, np.uint8)  # every word with a space behind it, then an end mark
        self.ends = np.append(np.flatnonzero(buf == SPACE), len(buf) - 1)
        begins = np.concatenate(([0], self.ends[:-1] + 1))
        times = self.ends - begins + 1
        into = np.arange(len(buf)) - np.repeat(begins, times)
        before = np.repeat(np.concatenate(([0], begins[:-1])), times) + into  # the same place in the word before
        same = buf[before] == buf  # words end in a space, so a word's own end differs from what a shorter one has behind it
        same[: times[0]] = False
        differs = np.where(same, len(buf), into)
        new = into >= np.repeat(np.minimum.reduceat(differs, begins), times)
        first = np.flatnonzero(new)
        # a place that is not new has the edge of the last new one as far into its word
        by_depth = np.argsort(into.astype(np.uint16) if times.max() <= 1 << 16 else into, kind="stable")
        shift = into[by_depth] * np.int64(len(first) + 1)
        latest = np.maximum.accumulate(np.where(new, np.cumsum(new), 0)[by_depth] + shift) - shift - 1
        self.edge = np.empty(len(buf), np.int32)
        self.edge[by_depth] = latest
        into, self.byte = into[first], buf[first]
        self.into = into
        rank = tree.rank[self.byte]
        near, done, each = np.zeros(len(first), np.uint64), 0, []
        for order, size in enumerate(ORDERS[:-1]):
            for i in range(done + 1, size + 1):
                near |= np.where(into >= i, buf[np.maximum(first - i, 0)], 0).astype(np.uint64) << np.uint64(8 * (i - 1))
            done = size
            plain = (near << np.uint64(8)) | rank
            back, one = grouped(plain)
            plain = plain.take(one)
            each.append((numbered(plain >> np.uint64(8), order, plain & np.uint64(0xFF), width), back))
        each.append((numbered(prefixes(buf, first, into, hasher), len(ORDERS) - 1, rank, width), None))
        keys = np.concatenate([k for k, _ in each])
        order = ordered(keys, width)
        keys, place = keys.take(order), np.empty(len(keys), np.int32)
        new = np.append(True, keys[1:] != keys[:-1])  # hashes may meet
        self.keys, place[order] = keys[new], np.cumsum(new, dtype=np.int32) - 1
        each_place = np.split(place, np.cumsum([len(k) for k, _ in each])[:-1])
        self.places = [p if back is None else p.take(back) for p, (_, back) in zip(each_place, each, strict=True)]

    def depth(self, tree: Tree) -> np.ndarray:
        return tree.depth[self.byte]

    def edge_counts(self, words: np.ndarray) -> np.ndarray:
        """How often each edge is passed, from how often each word occurs; the last is the end mark."""
        return np.bincount(self.edge, weights=np.repeat(words, np.diff(self.ends, prepend=-1)), minlength=len(self.byte)).astype(np.int64)

    def pair_counts(self, words: np.ndarray) -> np.ndarray:
        passed, out = self.edge_counts(words), np.zeros(len(self.keys), np.int64)
        for place in self.places:
            out += np.bincount(place, weights=passed, minlength=len(out)).astype(np.int64)
        return out


class Reading:
    """A chunk's texts read across words: edges are all that contexts and byte tell apart.

    The trie's edges come first, of which those ``LONGEST`` or more bytes into a word are passed; nearer its begin
    every place has an edge by the bytes before it, and the first byte of a word by the whole word before.
    """

    def __init__(self, spelling: Spelling, spelt: bytes, token: np.ndarray, size: np.ndarray, tree: Tree, hasher: Hasher, width: int = 64 - LOW) -> None:
        buf = np.frombuffer(spelt, np.uint8)
        begins = np.concatenate(([0], spelling.ends[:-1] + 1))
        length, mark = np.diff(spelling.ends, prepend=-1), len(begins) - 1
        self.spelling, self.last = spelling, np.cumsum(size + 1) - 1  # end marks
        self.token = np.full(len(token) + len(size), mark, np.int64)
        real = np.ones(len(self.token), bool)
        real[self.last] = False
        self.token[real] = token
        heads = self.last - size
        mask = np.uint64((1 << 8 * LONGEST) - 1)
        long = np.minimum(length, LONGEST).astype(np.uint8).take(self.token)
        own, shift = np.zeros(len(begins), np.uint64), long.astype(np.uint64) * np.uint64(8)
        for i in range(LONGEST):
            own |= np.where(length > i, buf[np.maximum(spelling.ends - i, 0)], 0).astype(np.uint64) << np.uint64(8 * i)

        def before(x: np.ndarray) -> np.ndarray:
            x = np.concatenate((x[:1], x[:-1]))
            x[heads] = 0
            return x

        read = own = own.take(self.token)
        for _ in range(LONGEST // 2):  # a word and its space are two bytes at least
            read = own | (before(read) << shift & mask)
        read = before(read)
        word = before(word_keys(spelt, hasher).take(self.token))
        prefix, self.near, n = np.zeros(len(begins), np.uint64), [], len(spelling.byte)
        byte, trie, each = [spelling.byte], [np.arange(n)], [[] for _ in range(PREDICTORS - len(ORDERS))]
        for i in range(LONGEST):
            letter = buf[np.minimum(begins + i, len(buf) - 1)]
            prefix = prefix << np.uint64(8) | letter
            at = np.flatnonzero(long > i) if i else np.arange(len(self.token))
            key = (read.take(at) << np.uint64(8 * i + 8) | prefix.take(self.token.take(at))) & np.uint64((1 << 8 * LONGEST + 8) - 1)
            back, one = grouped(key if i else mix(word) ^ key)
            self.near.append((at.astype(np.int32) if len(self.token) < 1 << 31 else at, back + np.int32(n)))
            key, one = key[one], at[one]
            byte.append((key & np.uint64(0xFF)).astype(np.uint8))
            trie.append(spelling.edge[begins[self.token[one]] + i])
            rank = tree.rank[byte[-1]]
            for k, bytes_ in enumerate(ACROSS):
                if i < bytes_:
                    each[k].append((n, numbered(key >> np.uint64(8) & np.uint64((1 << 8 * bytes_) - 1), len(ORDERS) + k, rank, width)))
            if not i:
                each[-1].append((n, numbered(word[one], PREDICTORS - 1, rank, width)))
            n += len(key)
        self.byte, self.trie = np.concatenate(byte), np.concatenate(trie)
        keys = np.concatenate([x for k in each for _, x in k])
        order = ordered(keys, width)
        keys, place = keys.take(order), np.empty(len(keys), np.int32)
        new = np.append(True, keys[1:] != keys[:-1])
        self.keys, place[order] = keys[new], np.cumsum(new, dtype=np.int32) - 1
        # where a predictor has no context of its own, the cell behind all pairs' counts
        self.places, done = [p.take(self.trie) for p in spelling.places], 0
        for parts in each:
            out = np.full(n, len(self.keys), np.int32)
            for lo, x in parts:
                out[lo : lo + len(x)] = place[done : done + len(x)]
                done += len(x)
            self.places.append(out + np.int32(len(spelling.keys)))

    def depth(self, tree: Tree) -> np.ndarray:
        out = tree.depth[self.byte]
        out[: len(self.spelling.byte)][self.spelling.into < LONGEST] = 0
        return out

    def edge_counts(self, words: np.ndarray, teach: np.ndarray) -> np.ndarray:
        """How often texts that teach pass each edge; ``words``: how often each word occurs in them."""
        out, teach = np.zeros(len(self.byte), np.int64), np.repeat(teach, np.diff(self.last, prepend=-1))
        deep = self.spelling.into >= LONGEST
        out[: len(deep)][deep] = self.spelling.edge_counts(words)[deep]
        for at, edge in self.near:
            out += np.bincount(edge[teach[at]], minlength=len(out))
        return out

    def pair_counts(self, passed: np.ndarray) -> np.ndarray:
        """How often each pair that looks across occurs."""
        out = np.zeros(len(self.keys) + 1, np.int64)
        for place in self.places[len(ORDERS) :]:
            out += np.bincount(place - len(self.spelling.keys), weights=passed, minlength=len(out)).astype(np.int64)
        return out[:-1]

    def levels(self, within: Iterator[np.ndarray], across: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
        """Level by level the codes of the spelling's pairs, of those that look across, and of no pair."""
        ended = [np.zeros(n, np.uint16) for n in (len(self.spelling.keys), len(self.keys), 1)]
        for a, b in zip_longest(within, across):
            yield np.concatenate([ended[0] if a is None else a, ended[1] if b is None else b, ended[2]])

    def codes(self, within: list[np.ndarray], across: list[np.ndarray]) -> list[np.ndarray]:
        return list(self.levels(within, across))

    def stream(self) -> tuple[np.ndarray, np.ndarray]:
        """The edges passed by all texts, and where each text ends."""
        begins, length = np.concatenate(([0], self.spelling.ends[:-1] + 1)), np.diff(self.spelling.ends, prepend=-1)
        ends = np.cumsum(length.take(self.token))
        out = np.empty(ends[-1] if len(ends) else 0, np.int32)
        for lo in range(0, len(ends), BLOCK):
            t, e = self.token[lo : lo + BLOCK], ends[lo : lo + BLOCK]
            n = length.take(t)
            out[e[0] - n[0] : e[-1]] = self.spelling.edge.take(np.arange(e[0] - n[0], e[-1]) + np.repeat(begins.take(t) - (e - n), n))
        starts = np.concatenate(([0], ends[:-1]))
        for i, (at, edge) in enumerate(self.near):
            out[starts.take(at) + i] = edge
        return out, ends[self.last]


class Onward:
    """What an iterator gives, by number; only the last is kept."""

    def __init__(self, items: Iterator[np.ndarray]) -> None:
        self.items, self.at = enumerate(items), (-1, None)

    def __getitem__(self, i: int) -> np.ndarray:
        while self.at[0] < i:
            self.at = None  # goes before the next is made
            self.at = next(self.items)
        return self.at[1]


_FEW = np.arange(1 << 12)
_FEW = np.where(_FEW <= 32, _FEW, np.rint(32 + 8 * np.log2(np.maximum(_FEW, 32) / 32))).astype(np.uint8)


def coded(n: np.ndarray) -> np.ndarray:
    """Counts in a byte: exact to 32, then eight steps a doubling."""
    out = _FEW[np.minimum(n, len(_FEW) - 1)]
    many = np.flatnonzero(n >= len(_FEW))
    out[many] = np.minimum(np.rint(32 + 8 * np.log2(n[many] / 32)), 255)
    return out


#: What the codes stand for.
_COUNT = np.where(np.arange(256) <= 32, np.arange(256), 32 * 2.0 ** ((np.arange(256) - 32) / 8))
def state(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How much a context has seen, in four steps, and whether both turns."""
    return (np.searchsorted(STEPS, own + other, "right") * 2 + (np.minimum(own, other) > 0)).astype(np.uint8)


def tables(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logits and states by both counts' codes, the own turn's above the other's."""
    return np.log((own[:, None] + 0.4) / (_COUNT[None, :] + 0.4)).astype(np.float32).ravel(), state(own[:, None], _COUNT[None, :]).ravel()


#: With every count, and with the own turn's less one.
_WHOLE, _LESS = tables(_COUNT), tables(np.maximum(_COUNT - 1, 0))


def both(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    return coded(own).astype(np.uint16) << np.uint16(8) | coded(other)


def node_counts(keys: np.ndarray, totals: np.ndarray, tree: Tree) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Level by level: which of the pairs (ascending, each once, all of a context's) share a node with others, and its counts of the pair's own turn and of the other.

    Of a pair that is alone under its node all passages take its own turn, from there down.
    """
    at, context, byte = np.arange(len(keys)), keys >> np.uint64(8), tree.byte[(keys & np.uint64(0xFF)).astype(np.uint8)]
    group = np.concatenate(([0], np.cumsum(context[1:] != context[:-1]))) if len(keys) else at
    for level in range(int(tree.depth.max())):
        first = np.ones(len(at), bool)
        first[1:] = group[1:] != group[:-1]
        begin = np.flatnonzero(first)
        alone = np.diff(np.append(begin, len(at))) == 1
        keep = ~np.repeat(alone, np.diff(np.append(begin, len(at))))
        at, group = at[keep], group[keep]
        if not len(at):
            return
        turn, n = tree.turn[level][byte[at]], totals[at]
        first = first[keep]
        begin, of = np.flatnonzero(first), np.cumsum(first) - 1
        whole, ones = np.add.reduceat(n, begin)[of], np.add.reduceat(np.where(turn, n, 0), begin)[of]
        own = np.where(turn, ones, whole - ones)
        yield at, own, whole - own
        group = of * 2 + turn


class Mixer:
    """Weights, by gate and predictor."""

    def __init__(self, weights: np.ndarray | None = None) -> None:
        self.weights = np.full((GATES, PREDICTORS), 0.3, np.float32) if weights is None else weights.astype(np.float32)

    @staticmethod
    def lookup(codes: np.ndarray, table: tuple[np.ndarray, np.ndarray], edges: int) -> Callable[[np.ndarray, bool], tuple[np.ndarray, np.ndarray | None]]:
        """Reads logits, and states where asked, at places of ``codes``; all at once where ``edges`` outnumber them."""
        if PREDICTORS * edges > 2 * len(codes):
            logit, seen = table[0].take(codes), table[1].take(codes)
            return lambda at, gates: (logit.take(at), seen.take(at) if gates else None)

        def one(at: np.ndarray, gates: bool) -> tuple[np.ndarray, np.ndarray | None]:
            code = codes.take(at)  # take is faster than an index
            return table[0].take(code), table[1].take(code) if gates else None

        return one

    @staticmethod
    def inputs(places: Iterable[np.ndarray], look: Callable[[np.ndarray, bool], tuple[np.ndarray, np.ndarray | None]]) -> tuple[list[np.ndarray], np.ndarray]:
        """Logits of each predictor for the edges' own turns, and gates."""
        x, gate = [], 0
        for k, place in enumerate(places):
            row, seen = look(place, k in GATING or k == PREDICTORS - 2)
            x.append(row)
            if k in GATING:
                gate = gate * np.uint8(8) + seen
            if k == PREDICTORS - 2:
                gate = gate + np.uint8(64) * (seen >> np.uint8(1))
        return x, gate.astype(np.intp)

    @staticmethod
    def parts(depth: np.ndarray) -> Iterator[tuple[int, slice]]:
        """Levels, and slices of the edges that decide there; ``depth`` falls."""
        for level in range(int(depth.max(initial=0))):
            n = int(np.searchsorted(-depth.astype(np.int16), -level))
            for lo in range(0, n, BLOCK):
                yield level, slice(lo, min(lo + BLOCK, n))

    def learn(self, spelling: Spelling | Reading, codes: list[np.ndarray] | Onward, passed: np.ndarray, tree: Tree) -> np.ndarray:
        """Online steps over all decisions of the edges passed; returns how much each gate met."""
        met, square = np.zeros(GATES), np.full(self.weights.shape, 1e-3)
        order = np.flatnonzero(passed)
        runs = np.random.default_rng(1).permutation(-(-len(order) // RUN))[:, None] * RUN + np.arange(RUN)
        order = order[runs[runs < len(order)]]  # blocks alike
        depth, w = tree.depth[spelling.byte[order]], self.weights.astype(np.float64)
        blocks = ((look, at[lo : lo + BLOCK]) for level in range(int(depth.max(initial=0))) for at in [order[depth > level]] for look in [self.lookup(codes[level], _LESS, len(at))] for lo in range(0, len(at), BLOCK))
        for look, part in blocks:
            x, cell = self.inputs((place.take(part) for place in spelling.places), look)
            n = passed.take(part).astype(np.float32)
            z = sum(row * v.take(cell) for v, row in zip(w.T.astype(np.float32, order="C"), x, strict=False))
            err = n * cost(z)[1]  # all logits are of the turn taken
            mass = np.bincount(cell, weights=n, minlength=GATES)
            step = np.stack([np.bincount(cell, weights=err * row, minlength=GATES) for row in x], 1) / np.maximum(mass, 1)[:, None]
            share = (mass / mass.sum())[:, None]
            square += share * step * step
            w += RATE * np.sqrt(share / square) * step
            met += mass
        self.weights = w.astype(np.float32)
        return met

    def weighed(self, spelling: Spelling | Reading, codes: list[np.ndarray] | Onward, tree: Tree) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Level by level edges that decide there, and their groups' weighed logits (edge, group), of the turn taken."""
        depth = spelling.depth(tree)
        order = np.argsort(np.uint8(255) - depth, kind="stable").astype(np.int32)
        weights, last = self.weights.T.copy(), -1
        depth = depth.take(order)
        for level, part in self.parts(depth):
            if level > last:
                look, last = None, level
                look = self.lookup(codes[level], _WHOLE, int(np.searchsorted(-depth.astype(np.int16), -level)))
            edges = order[part]
            x, gate = self.inputs((place.take(edges) for place in spelling.places), look)
            rows = np.zeros((GROUP[-1] + 1, len(gate)), np.float32)
            for w, row, group in zip(weights, x, GROUP, strict=False):
                row *= w.take(gate)
                rows[group] += row
            yield level, edges, rows.T

    def costs(self, spelling: Spelling | Reading, codes: list[np.ndarray], tree: Tree) -> np.ndarray:
        """(1, edge): minus the natural logarithm of each edge's probability, before a text's own learning."""
        out = np.zeros((1, len(spelling.byte)), np.float32)
        for _, edges, rows in self.weighed(spelling, codes, tree):
            out[0, edges] += cost(rows.sum(1))[0]
        return out

    def text_costs(self, reading: Reading, codes: list[np.ndarray] | Onward, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
        """Minus the natural logarithm of each text's probability, with the second layer and without."""
        depth = np.append(reading.depth(tree), np.uint8(0))  # an edge without decisions fills up
        beyond = np.concatenate(([0], np.cumsum(np.maximum(depth, HEAD) - np.uint8(HEAD), dtype=np.int64)))
        beyond = beyond.astype(np.int32) if beyond[-1] < 1 << 31 else beyond
        # four shorts a decision: those of an edge's first levels together, others behind each other
        head, rest, plain = np.zeros((len(depth), HEAD), np.uint64), np.empty(beyond[-1], np.uint64), np.zeros(len(depth), np.float32)
        for level, edges, rows in self.weighed(reading, codes, tree):
            rows = rows.T  # a group's logits lie together
            plain[edges] += cost(rows.sum(0))[0]
            np.clip(rows, -31, 31, out=rows)
            rows /= UNIT
            short = np.ascontiguousarray(np.rint(rows, out=rows).astype(np.int16).T).view(np.uint64).ravel()
            if level < HEAD:
                head[edges, level] = short
            else:
                rest[beyond.take(edges) + (level - HEAD)] = short
        edges = rows = short = codes = None
        let_go()
        keep_freed()
        edges, ends = reading.stream()
        size = np.diff(ends, prepend=0)
        longest_first = np.argsort(-size, kind="stable")
        out = np.zeros(len(size))
        for lo in range(0, len(size), TOGETHER):
            texts = longest_first[lo : lo + TOGETHER]
            out[texts] = self.refined(edges, ends[texts] - size[texts], size[texts], depth, head, rest, beyond)
        del head, rest
        even = np.zeros(len(size))
        for lo in range(0, len(size), TOGETHER):
            begin = ends[lo : lo + TOGETHER] - size[lo : lo + TOGETHER]
            even[lo : lo + TOGETHER] = np.add.reduceat(plain.take(edges[begin[0] : ends[lo : lo + TOGETHER][-1]]), begin - begin[0], dtype=np.float64)
        return out, even

    @staticmethod
    def refined(edges: np.ndarray, begin: np.ndarray, size: np.ndarray, depth: np.ndarray, head: np.ndarray, rest: np.ndarray, beyond: np.ndarray) -> np.ndarray:
        """Texts, the longest first, take their steps together: costs with the factors learnt so far.

        A block's decisions at the first levels are a matrix a text, with logits of zero, which teach nothing, where an edge has fewer.
        """
        factors, square, out = np.ones((len(size), GROUP[-1] + 1), np.float32), np.ones((len(size), GROUP[-1] + 1), np.float32), np.zeros(len(size))
        within, even = np.arange(STEP), float(cost(np.zeros(STEP, np.float32))[0][0])
        for lo in range(0, int(size[0]), STEP):
            m = int(np.searchsorted(-size, -lo))
            at = begin[:m, None] + (lo + within)
            ended = int(np.searchsorted(-size, -(lo + STEP), "right"))  # texts from there on end within the block
            at[ended:] = np.minimum(at[ended:], len(edges) - 1)
            passed = edges.take(at)
            passed[ended:][within >= (size[ended:m] - lo)[:, None]] = len(depth) - 1
            f, deep = factors[:m] * UNIT, depth.take(passed)
            x = head.take(passed.ravel(), axis=0).view(np.int16).reshape(m, STEP * HEAD, -1).astype(np.float32)
            much, err = cost(np.matmul(x, f[:, :, None])[:, :, 0])
            out[:m] += much.sum(1, dtype=np.float64) - even * (STEP * HEAD - np.minimum(deep, HEAD).sum(1, dtype=np.int64))
            step = np.matmul(err[:, None, :], x)[:, 0]
            deeper = np.flatnonzero(deep > HEAD)
            if len(deeper):
                more, start = deep.ravel().take(deeper) - np.uint8(HEAD), beyond.take(passed.ravel().take(deeper))
                end = np.cumsum(more, dtype=beyond.dtype)
                text = np.repeat(deeper // STEP, more)
                x = rest.take(np.arange(end[-1]) + np.repeat(start - (end - more), more)).view(np.int16).reshape(len(text), -1).astype(np.float32)
                much, err = cost(np.einsum("nk,nk->n", x, f.take(text, axis=0)))
                out[:m] += np.bincount(text, weights=much, minlength=m)
                x *= err[:, None]
                step += np.stack([np.bincount(text, weights=row, minlength=m) for row in x.T], 1)
            step *= UNIT
            square[:m] += step * step
            factors[:m] += STEP_RATE * step / np.sqrt(square[:m])
        return out


def cost(logit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minus the natural logarithm of a turn's probability, and the other turn's probability."""
    odds = np.negative(logit)
    np.exp(np.clip(odds, -30, 30, out=odds), out=odds)
    whole = 1 + odds
    odds /= whole
    return np.log(whole, out=whole), odds


def squeezed(x: np.ndarray, tool: zstandard.ZstdCompressor) -> bytes:
    """Whole numbers by planes of bytes, so that high bytes compress."""
    return tool.compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def opened(raw: bytes, dtype, tool: zstandard.ZstdDecompressor) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(tool.decompress(raw), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def squeezed_keys(keys: np.ndarray, tool: zstandard.ZstdCompressor) -> bytes:
    return squeezed(np.diff(keys, prepend=np.uint64(0)), tool)


def opened_keys(raw: bytes, tool: zstandard.ZstdDecompressor) -> np.ndarray:
    return np.cumsum(opened(raw, np.uint64, tool), dtype=np.uint64)


def joined(parts: list[bytes]) -> bytes:
    """The lengths of all parts, which are a fixed number, and the parts."""
    return np.array([len(x) for x in parts], np.uint32).tobytes() + b"".join(parts)


def parted(raw: bytes, n: int) -> Iterator[bytes]:
    cut = 4 * n + np.concatenate(([0], np.cumsum(np.frombuffer(raw[: 4 * n], np.uint32), dtype=np.int64)))
    return (raw[a:b] for a, b in zip(cut.tolist(), cut[1:].tolist(), strict=False))


def squeezed_pairs(keys: np.ndarray, width: int, tool: zstandard.ZstdCompressor) -> bytes:
    """Pairs' numbers, ascending: each context once, with its order, then which pairs begin one, and the bytes' ranks."""
    context = (keys >> np.uint64(64 - width) << np.uint64(3)) | (keys >> np.uint64(8) & np.uint64(7))
    new = np.ones(len(keys), bool)
    new[1:] = context[1:] != context[:-1]
    return joined([squeezed_keys(context[new], tool), tool.compress(np.packbits(new).tobytes()), tool.compress(keys.astype(np.uint8).tobytes())])


def opened_pairs(raw: bytes, width: int, tool: zstandard.ZstdDecompressor) -> np.ndarray:
    context, new, rank = parted(raw, 3)
    context, rank = opened_keys(context, tool), np.frombuffer(tool.decompress(rank), np.uint8)
    new = np.unpackbits(np.frombuffer(tool.decompress(new), np.uint8), count=len(rank))
    context = (context >> np.uint64(3) << np.uint64(64 - width)) | ((context & np.uint64(7)) << np.uint64(8))
    return context[np.cumsum(new, dtype=np.int64) - 1] | rank


def vocabularies(docs: DataFrame, keep: list[str], learns, text_col: str) -> DataFrame:
    """Chunks of documents as words: (chunk, spelt, times, frequency, tokens, sizes, teach, rest).

    ``spelt`` are the distinct words in order, ``times`` how often each, and
    then the end mark, occurs in texts that teach; ``tokens`` the words of all texts by number, ``sizes`` how
    many each text has, ``teach`` whether it teaches. ``frequency`` counts the bytes of what teaches.
    """
    names = [f"k{i}" for i in range(len(keep))]
    d = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.coalesce(learns, F.lit(False)).alias("learns"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rest = d.select(*names).schema
    schema = T.StructType([*T._parse_datatype_string("chunk string, spelt binary, times binary, frequency array<long>, tokens binary, sizes binary, teach binary").fields, T.StructField("rest", T.ArrayType(rest))])

    def row(texts: list[pa.Array], teach: list[pa.Array], kept: list[pa.Array], tool: zstandard.ZstdCompressor) -> pa.RecordBatch:
        words = pc.ascii_split_whitespace(pc.ascii_lower(pa.concat_arrays(texts)))  # lower-cases A-Z, parts at ASCII white space
        real = pc.not_equal(words.values, "")
        ends = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False))))[words.offsets.to_numpy()]
        found = words.values.filter(real).dictionary_encode()
        order = pc.sort_indices(found.dictionary)
        place = np.empty(len(order), np.uint32)
        place[order.to_numpy()] = np.arange(len(order), dtype=np.uint32)
        token, n = place[found.indices.to_numpy()], np.diff(ends)
        teach = np.concatenate([t.to_numpy(zero_copy_only=False) for t in teach]).astype(bool)
        times = np.append(np.bincount(token[np.repeat(teach, n)], minlength=len(place)), teach.sum()).astype(np.uint64)
        spelt = b"".join([w + b" " for w in found.dictionary.take(order).cast(pa.binary()).to_pylist()]) + bytes([END])
        buf = np.frombuffer(spelt, np.uint8)
        close = np.append(np.flatnonzero(buf == SPACE), len(buf) - 1)
        frequency = np.bincount(buf, weights=np.repeat(times, np.diff(close, prepend=-1)), minlength=256).astype(np.int64)
        struct_ = pa.concat_arrays(kept)
        lists = pa.ListArray.from_arrays(pa.array([0, len(struct_)], pa.int32()), struct_)
        blobs, last = (tool.compress(spelt), squeezed(times, tool)), (squeezed(token, tool), n.astype(np.int64).tobytes(), np.packbits(teach).tobytes())
        return pa.RecordBatch.from_arrays(
            [pa.array([uuid.uuid4().hex]), *(pa.array([b], pa.binary()) for b in blobs), pa.array([frequency], pa.list_(pa.int64())), *(pa.array([b], pa.binary()) for b in last), lists], schema.fieldNames())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=3)
        held: tuple[list, list, list] = ([], [], [])
        size = 0
        for batch in batches:
            text = batch.column(len(names) + 1)
            columns = text, batch.column(len(names)), pa.StructArray.from_arrays(batch.columns[: len(names)], names=names)
            at = 0
            for i, n in enumerate(pc.binary_length(text).to_pylist()):
                if size and size + n > CHUNK:
                    for h, c in zip(held, columns, strict=True):
                        h.append(c.slice(at, i - at))
                    yield row(*held, tool)
                    held, size, at = ([], [], []), 0, i
                    give_back()
                size += n
            for h, c in zip(held, columns, strict=True):
                h.append(c.slice(at))
        if sum(map(len, held[0])):
            yield row(*held, tool)
        give_back()

    return d.mapInArrow(lean(pack), schema)


def by_range(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    cut = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    return ((r, a, b) for r, (a, b) in enumerate(zip(cut.tolist(), cut[1:].tolist(), strict=False)) if b > a)


def word_keys(spelt: bytes, hasher: Hasher) -> np.ndarray:
    """64-bit hashes of the words, and last the end mark's."""
    buf = np.frombuffer(spelt, np.uint8)
    ends = np.append(np.flatnonzero(buf == SPACE), len(buf))
    return hasher.hashes(buf, np.concatenate(([0], ends[:-1] + 1)), ends)[0]


def totals(chunks: DataFrame, tree: Tree, bits: int, width: int) -> DataFrame:
    """(chunk, found, words, tokens) from what all chunks sent to one range of hashes, which also sums a slice of what they learnt.

    ``found``: the totals of the chunk's own words there; for its own pairs, within words and across, level by level
    the codes of how often their turn was taken and the other. Under an empty chunk's name the range's
    distinct words and its tokens.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, opener, hasher = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor(), Hasher()
        for batch in batches:
            for chunk, spelt, times, *read in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keep_freed()
                spelt, times = opener.decompress(spelt), opened(times, np.uint64, opener)
                reading, teach = reading_of(spelt, *read, tree, hasher, width, opener)
                passed = reading.edge_counts(times, teach)
                pairs = reading.keys, reading.pair_counts(passed)
                within = reading.spelling.keys, reading.spelling.pair_counts(times)
                learnt = np.array_split(learned(reading, within, passed, pairs, tree).ravel(), 1 << bits)
                sets = [(keys, n.astype(np.uint64)) for keys, n in (within, pairs)]
                del reading, passed, within, pairs
                words = word_keys(spelt, hasher)
                order = np.argsort(words)
                words, times = words[order], times[order]
                sets = [(keys, n, {r: (a, b) for r, a, b in by_range(keys, bits)}) for keys, n in ((words, times), *sets)]
                rows = []
                for r in range(1 << bits):
                    cuts = [(keys, n, slice(*at.get(r, (0, 0)))) for keys, n, at in sets]
                    (own, _, c), *_ = cuts
                    names = squeezed_keys(own[c], tool), *(squeezed_pairs(keys[c], width, tool) for keys, _, c in cuts[1:])
                    rows.append((r, *(x for name, (_, n, c) in zip(names, cuts, strict=True) for x in (name, squeezed(n[c], tool))), learnt[r].tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in rows], pa.int32()), pa.array([chunk] * len(rows), pa.string()), *(pa.array([x[i] for x in rows], pa.binary()) for i in range(1, 8))],
                    ["r", "chunk", "words", "times", "keys", "counts", "across", "passed", "learnt"])
                del sets, words, times, rows
                let_go()

    def summed(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        sizes, key = [len(k) for k in keys], np.concatenate(keys)
        back, one = grouped(key)
        key = key.take(one)
        order, place = np.argsort(key), np.empty(len(key), np.int32)
        place[order] = np.arange(len(key), dtype=np.int32)
        key, back = key.take(order), place.take(back)
        total = np.bincount(back, weights=np.concatenate(n), minlength=len(key)).astype(np.int64)
        return key, total, np.split(back, np.cumsum(sizes)[:-1])

    def meet(table: pa.Table) -> pa.Table:
        opener, tool = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
        column = lambda c, f, *a: [f(x, *a, opener) for x in table[c].to_pylist()]
        _, times, own = summed(column("words", opened_keys), column("times", opened, np.uint64))
        found = [[squeezed(times[word].astype(np.uint64), tool) for word in own]]
        for keys, counts in (("keys", "counts"), ("across", "passed")):
            key, total, places = summed(column(keys, opened_pairs, width), column(counts, opened, np.uint64))
            levels = codes_of(key, total, tree)
            found.append([])
            for group in together([len(at) for at in places]):
                at, of = np.concatenate(places[group]), np.repeat(np.arange(len(places[group])), [len(x) for x in places[group]])
                found[-1] += packed_codes([level.take(at) for level in levels], of, len(places[group]), key.take(at), tree, tool)
            del levels, places, key, total
        learnt = np.sum([np.frombuffer(x, np.float64) for x in table["learnt"].to_pylist()], axis=0).tobytes()
        found.append([learnt] * len(own))
        r = table["r"][0].as_py()
        out = pa.table({
            "chunk": pa.array([*table["chunk"].to_pylist(), ""]), "r": pa.array([r] * (len(own) + 1), pa.int32()), **{k: pa.array([*x, None], pa.binary()) for k, x in zip(("times", "codes", "across", "learnt"), found, strict=True)},
            "words": pa.array([None] * len(own) + [int((times > 0).sum())], pa.int64()), "tokens": pa.array([None] * len(own) + [int(times.sum())], pa.int64())})
        del own, found
        give_back()
        return out

    sent = chunks.select("chunk", "spelt", "times", "tokens", "sizes", "teach").mapInArrow(lean(send), "r int, chunk string, words binary, times binary, keys binary, counts binary, across binary, passed binary, learnt binary")
    met = sent.groupBy("r").applyInArrow(meet, "chunk string, r int, times binary, codes binary, across binary, learnt binary, words long, tokens long")
    return met.groupBy("chunk").agg(F.collect_list(F.struct("r", "times", "codes", "across", "learnt")).alias("found"), F.sum("words").alias("words"), F.sum("tokens").alias("n"))


def reading_of(spelt: bytes, tokens: bytes, sizes: bytes, teach: bytes, tree: Tree, hasher: Hasher, width: int, tool: zstandard.ZstdDecompressor) -> tuple[Reading, np.ndarray]:
    size = np.frombuffer(sizes, np.int64)
    reading = Reading(Spelling(spelt, tree, hasher, width), spelt, opened(tokens, np.uint32, tool), size, tree, hasher, width)
    return reading, np.unpackbits(np.frombuffer(teach, np.uint8), count=len(size)).astype(bool)


def read_codes(keys: np.ndarray, found: list[dict], bits: int, tree: Tree, tool: zstandard.ZstdDecompressor, kind: str = "codes") -> list[np.ndarray]:
    """Level by level the codes (own turn's above the other's) at the nodes of a chunk's pairs."""
    return list(read_levels(keys, found, bits, tree, tool, kind))


def read_levels(keys: np.ndarray, found: list[dict], bits: int, tree: Tree, tool: zstandard.ZstdDecompressor, kind: str) -> Iterator[np.ndarray]:
    of, at = {f["r"]: f[kind] for f in found}, list(by_range(keys, bits))
    groups = [at[g] for g in together([b - a for _, a, b in at])]
    parts = [keys[g[0][1] : g[-1][2]] for g in groups]
    levels = (unpacked_codes([of[r] for r, _, _ in g], np.repeat(np.arange(len(g)), [b - a for _, a, b in g]), part, tree, tool) for g, part in zip(groups, parts, strict=True))
    for each in zip_longest(*levels):
        yield np.concatenate([np.zeros(len(part), np.uint16) if x is None else x for x, part in zip(each, parts, strict=True)])


def nodes(keys: np.ndarray, tree: Tree, of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Level by level which pairs (ascending, in each part that ``of`` names) decide there, the first of them under the same node, and whether they take its turn."""
    context, byte = keys >> np.uint64(8), tree.byte.take(keys.astype(np.uint8))
    context = np.cumsum((context != np.roll(context, 1)) | (of != np.roll(of, 1)), dtype=np.int32)
    at, depth = np.arange(len(keys), dtype=np.int32), tree.depth.take(byte)
    for level in range(int(depth.max(initial=0))):
        deep = depth > level  # bytes under a node follow each other
        at, context, byte, depth = at[deep], context[deep], byte[deep], depth[deep]
        node, turn = tree.node[level].take(byte), tree.turn[level].take(byte)
        new = np.ones(len(at), bool)
        new[1:] = (context[1:] != context[:-1]) | (node[1:] != node[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        yield at, at.take(first), turn == turn.take(first)


#: Codes travel by kind, each compressed apart: the other turn's by the code above, what the own turn's is off by whether little or much is left for it, and both at the root by order.
_KIND = np.searchsorted((0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 31, *range(47, 256, 16)), np.arange(256)).astype(np.uint8)
_LEFT = int(_KIND.max()) + 1
_ROOT = _LEFT + 3
KINDS = _ROOT + 16
#: The own turn's code that the codes above and of the other turn leave, the one above at the top.
_REST = coded(np.maximum(np.rint(_COUNT[:, None] - _COUNT[None, :]), 0).astype(np.int64).ravel())


def left(above: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which code and kind the own turn's likely has."""
    return _REST[above.astype(np.uint16) << np.uint16(8) | other], np.searchsorted((4, 12), above.astype(np.int16) - other, "right").astype(np.uint8) + np.uint8(_LEFT)


def packed_codes(levels: list[np.ndarray], of: np.ndarray, n: int, keys: np.ndarray, tree: Tree, tool: zstandard.ZstdCompressor) -> list[bytes]:
    """Level by level the codes once a node: the other turn's where the level above leaves any, the own where it doesn't follow. ``of``: which of ``n`` chunks has the pair; each is packed apart."""
    sent_codes, kinds, above = [np.zeros(0, np.uint8)], [np.zeros(0, np.uint16)], None
    of = (of * KINDS).astype(np.uint16 if n * KINDS <= 1 << 16 else np.uint32)
    for (at, first, _), codes in zip(nodes(keys, tree, of), levels, strict=False):
        own, other, sent = (codes >> np.uint16(8)).astype(np.uint8), codes.astype(np.uint8), at[at == first]
        if above is None:
            order = of.take(sent) + (order_of(keys.take(sent)) + np.uint8(_ROOT))
            sent_codes += [other.take(sent), own.take(sent)]
            kinds += [order, order + np.uint8(8)]
        else:
            sent = sent[above.take(sent) > 0]
            a, b = above.take(sent), other.take(sent)
            many = np.flatnonzero(a > 31)
            rest, kind = left(a.take(many), b.take(many))
            sent_codes += [b, own.take(sent.take(many)) - rest]
            kinds += [of.take(sent) + _KIND.take(a), of.take(sent.take(many)) + kind]
        above = own
    sent_codes, kinds = np.concatenate(sent_codes), np.concatenate(kinds)
    parts = np.split(sent_codes.take(np.argsort(kinds, kind="stable")), np.cumsum(np.bincount(kinds, minlength=n * KINDS))[:-1])
    parts = [tool.compress(x.tobytes()) if len(x) else b"" for x in parts]
    return [joined(parts[i * KINDS : (i + 1) * KINDS]) for i in range(n)]


def unpacked_codes(raws: list[bytes], of: np.ndarray, keys: np.ndarray, tree: Tree, tool: zstandard.ZstdDecompressor) -> Iterator[np.ndarray]:
    """Level by level the codes of pairs (ascending) that are packed in several ranges; ``of``: in which."""
    parts = [np.frombuffer(tool.decompress(x) if x else b"", np.uint8) for raw in raws for x in parted(raw, KINDS)]
    codes, next_ = np.concatenate([np.zeros(0, np.uint8), *parts]), np.cumsum([0, *map(len, parts[:-1])])[: len(parts)]
    of = (of * KINDS).astype(np.uint16 if len(parts) <= 1 << 16 else np.uint32)

    def read(kind: np.ndarray, at: np.ndarray) -> np.ndarray:
        kind = of.take(at) + kind
        by_kind, n, out = np.argsort(kind, kind="stable"), np.bincount(kind, minlength=len(next_)), np.empty(len(kind), np.uint8)
        out[by_kind] = codes.take(np.arange(len(kind)) + np.repeat(next_ - (np.cumsum(n) - n), n))
        next_[:] += n
        return out

    above = None
    for at, first, same in nodes(keys, tree, of):
        own, other, sent = np.zeros(len(keys), np.uint8), np.zeros(len(keys), np.uint8), at[at == first]
        if above is None:
            order = order_of(keys[sent]) + np.uint8(_ROOT)
            other[sent], own[sent] = read(order, sent), read(order + np.uint8(8), sent)
        else:
            sent = sent[above.take(sent) > 0]
            a = above.take(sent)
            b = read(_KIND.take(a), sent)
            c = a - b  # counts below 32 are their own codes, and 32 may be 33
            many = np.flatnonzero(a > 31)
            rest, kind = left(a[many], b[many])
            c[many] = rest + read(kind, sent.take(many))
            other[sent], own[sent] = b, c
        x, y = own.take(first), other.take(first)
        own[at], other[at] = np.where(same, x, y), np.where(same, y, x)
        yield own.astype(np.uint16) << np.uint16(8) | other
        above = own


def together(sizes: list[int]) -> Iterator[slice]:
    """Slices of about ``PACKED`` pairs, one item at least."""
    lo = n = 0
    for i, size in enumerate(sizes):
        if i > lo and n + size > PACKED:
            yield slice(lo, i)
            lo, n = i, 0
        n += size
    if lo < len(sizes):
        yield slice(lo, len(sizes))


def order_of(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(8) & np.uint64(7)).astype(np.uint8)


def read_times(words: np.ndarray, found: list[dict], bits: int, tool: zstandard.ZstdDecompressor) -> np.ndarray:
    order = np.argsort(words)
    out, of = np.zeros(len(words), np.int64), {f["r"]: f["times"] for f in found}
    for r, a, b in by_range(words[order], bits):
        out[order[a:b]] = opened(of[r], np.uint64, tool)
    return out


def own_counts(spelling: Spelling, times: np.ndarray, tree: Tree) -> list[np.ndarray]:
    """Level by level the codes at the nodes of a chunk's pairs, of the chunk's own texts alone."""
    return codes_of(spelling.keys, spelling.pair_counts(times), tree)


def codes_of(keys: np.ndarray, totals: np.ndarray, tree: Tree) -> list[np.ndarray]:
    return list(levels_of(keys, totals, tree))


def levels_of(keys: np.ndarray, totals: np.ndarray, tree: Tree) -> Iterator[np.ndarray]:
    alone, found = both(totals, np.zeros_like(totals)), node_counts(keys, totals, tree)
    for _ in range(int(tree.depth_of(keys).max(initial=0))):
        out = alone
        for at, own, other in islice(found, 1):
            out = alone.copy()
            out[at] = both(own, other)
        yield out


def learned(reading: Reading, within: tuple[np.ndarray, np.ndarray], passed: np.ndarray, across: tuple[np.ndarray, np.ndarray], tree: Tree) -> np.ndarray:
    """What a chunk learns online from its own counts: weights times how many decisions their gate met, and that number, by gate."""
    mixer = Mixer()
    met = mixer.learn(reading, Onward(reading.levels(levels_of(*within, tree), levels_of(*across, tree))), passed, tree)
    return np.column_stack([mixer.weights * met[:, None], met])


def mean_weights(found: list[dict], bits: int) -> np.ndarray:
    """Weights: the mean of what every chunk learnt, by how many decisions each gate met there."""
    out = Mixer().weights
    cells = np.concatenate([np.frombuffer(f["learnt"], np.float64) for f in sorted(found, key=lambda f: f["r"])]).reshape(GATES, -1)
    taught = cells[:, -1] > 0
    out[taught] = cells[taught, :-1] / cells[taught, -1:]
    return out


def scores(docs: DataFrame, learns, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of each row.

    ``learns``: a Boolean column; only its rows teach either model. Null texts
    are empty: one end token. Texts of any length are read whole; a word is of any length.
    Repeated rows each count and each get a row, and equal texts equal scores within one run. If
    nothing teaches, counts are 0 and the mixture is even. Empty tables give empty results.
    Bits per byte are of the words with a space after each, and the end mark.
    """
    chunks = written(vocabularies(docs, keep, learns, text_col), "lm-chunks")
    rows = chunks.select(F.posexplode("frequency")).groupBy("pos").agg(F.sum("col").alias("sum")).collect()  # 256
    tree = Tree(np.array([r["sum"] for r in sorted(rows)]) if rows else np.zeros(256, np.int64))
    bits, width = ranges(chunks)
    names = [f"k{i}" for i in range(len(keep))]
    rest = chunks.schema["rest"].dataType.elementType
    pa_rest = to_arrow_schema(rest)
    schema = T.StructType([*rest.fields, *T._parse_datatype_string("n_tokens long, n_known long, counts double, score double, bits_per_byte double, words long, tokens long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener, hasher = zstandard.ZstdDecompressor(), Hasher()
        for batch in batches:
            for i, (spelt, found, tokens, sizes, teach, words, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 3, 4, 6, 7)), strict=True)):
                if spelt is None:  # not a chunk, but the totals of all
                    yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in pa_rest), *(pa.nulls(1, pa.int64() if j in (0, 1) else pa.float64()) for j in range(5)), pa.array([words]), pa.array([n])], schema.fieldNames())
                    continue
                keep_freed()
                spelt = opener.decompress(spelt)
                reading, _ = reading_of(spelt, tokens, sizes, teach, tree, hasher, width, opener)
                codes = Onward(reading.levels(*(read_levels(x.keys, found, bits, tree, opener, kind) for x, kind in ((reading.spelling, "codes"), (reading, "across")))))
                logs = -np.stack(Mixer(mean_weights(found, bits)).text_costs(reading, codes, tree))
                length = np.diff(reading.spelling.ends, prepend=-1)
                del reading, codes
                c = read_times(word_keys(spelt, hasher), found, bits, opener)
                token, size = opened(tokens, np.uint32, opener), np.frombuffer(sizes, np.int64)
                m = len(size)
                doc = np.repeat(np.arange(m), size)
                of_text = lambda x: np.bincount(doc, weights=x[token], minlength=m) + x[-1]
                most = logs.max(0)
                log = most + np.log(np.exp(logs - most).mean(0))
                base, seen = of_text(np.log10(c + 1.0)), of_text((c > 0).astype(float)).astype(np.int64)
                per_byte = -log / np.log(2) / of_text(length.astype(float))
                fields = batch.column(5)[i].values
                yield pa.RecordBatch.from_arrays([*(fields.field(j) for j in range(len(names))), pa.array(size + 1), pa.array(seen), pa.array(base), pa.array(log / np.log(10)), pa.array(per_byte), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], schema.fieldNames())
                del token, doc, logs, c
                let_go()

    known = totals(chunks, tree, bits, width).join(chunks, "chunk", "left")
    done = written(known.select("spelt", "found", "tokens", "sizes", "teach", "rest", "words", "n").mapInArrow(lean(run), schema), "lm-scores")
    v, n = done.where("words IS NOT NULL").agg(F.sum("words"), F.sum("tokens")).first()
    v, n = v or 0, n or 0
    base = (F.col("counts") - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))).alias("base_score")
    return done.where("words IS NULL").select(*[F.col(a).alias(b) for a, b in zip(names, keep, strict=True)], "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), base, "score", "bits_per_byte")


def ranges(chunks: DataFrame) -> tuple[int, int]:
    """Bits that name a range of hashes, so that one holds about ``RANGE_PAIRS`` pairs whatever the input, and of a context's hash, 12 more than tell all pairs apart."""
    pairs = chunks.agg(F.sum(3 * F.octet_length("spelt") + F.octet_length("tokens"))).first()[0] or 0  # a compressed byte stands for about three within words, or one across at most
    bits = max(4, int(np.ceil(np.log2(max(1, pairs / RANGE_PAIRS)))))
    return bits, min(64 - LOW, max(24, int(pairs).bit_length() + 12))


def op6(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").withColumn("held_out", remainder("doc_id", 7) == 2)
    return scores(docs, ~F.col("held_out"), ["doc_id", "held_out"])
