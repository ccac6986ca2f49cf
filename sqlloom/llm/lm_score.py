"""Language-model scores by online logistic context mixing.

A text is coded as its tokens: its words (A-Z lower-cased), then one end. Frequent tokens, as many as ``VOCABULARY``,
and one escape are the leaves of a Huffman tree of the training tokens, so a token is a path of bits, few for
frequent ones; a token after an escape has its share of the counts of all others. Each bit is predicted by several models,
each from counts of zeros and ones under a hash of its context and the tree's node: no context, the word before,
the two words before, and this text so far. The last one learns along the text: it counts what stands before the
bit in it. A gate, how often the contexts of one and two
words were seen and the depth in the tree, chooses the weights that combine the models' logits. A text starts from learned weights,
and after each of its blocks its own copy of them takes a gradient step. The sum of the bits' log probabilities
is the text's score; bits per byte follow from it.

The counts are over all training texts. Tables have a number of slots in proportion to the training tokens; up to ``SLOTS`` of them
all executors hold. Beyond, no table is made: texts go through in chunks, a chunk asks for the counts of its different (context,
token), and contexts are dealt to shards, as many as the training tokens ask for. A shard adds up what all chunks counted of its
contexts, exactly, and answers each chunk with the counts along the tokens' paths; then the chunk is scored. Each task counts about
``TASK_BYTES`` of text, so tasks do not grow with the input. The starting weights are learned
online in the same pass, over all of each training text: texts are predicted by what the task has counted so far, then learned, then
counted. The tasks' weights are put together by their curvature.

The base score is that of a unigram model with add-one smoothing, over the words and one end a text. Its
counts are over all training texts too; frequent words' counts are sent to executors, and all others are joined
by a shuffle.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlloom.llm import textkit as tk
from sqlloom.llm.staging import batches_of, drop, in_arrow, release, stage

#: Remainder of crc32(doc_id) modulo 7 that is held out.
FOLDS, HELD_OUT = 7, 2
#: Leaves of the tree besides the end and the escape, and the next frequent words whose counts executors hold (16 bytes each).
VOCABULARY, HELD_WORDS = 1 << 13, 1 << 17
#: Different words that a task adds up before it passes their counts on.
KEPT = 1 << 20
#: Slots of a table at least, and at most where executors hold them (powers of two), training tokens for each, and slots that travel as one row.
LEAST_SLOTS, SLOTS, TOKENS_PER_SLOT, ROW = 1 << 16, 1 << 22, 2, 1 << 14
#: Beyond SLOTS: slots of the tables that a task learns its own part of the texts with (at most), training tokens of a shard, bytes of text of a chunk and of a row of it, and parts that chunks are scored in.
LEARN_SLOTS, SHARD_TOKENS, CHUNK_BYTES, TEXT_BYTES, PARTS = 1 << 22, 1 << 21, 8 << 20, 1 << 20, 2
#: Bits of a context's hash that its chunk and shard know it by.
CONTEXT_BITS = 44
#: Bytes of stored text that one counting or learning task reads, about.
TASK_BYTES = 64 << 20
#: Bits of a text after which its weights are refined: the first block, doubled up to the last; and the curvature that holds them back.
FIRST_BLOCK, LAST_BLOCK, HOLD = 128, 4096, 100
#: Texts, and rows of tables, that a Python worker is handed at once.
BATCH_ROWS = 1_000
_TABLES, _MODELS, _DEPTHS, _SEEN = 2, 4, 4, 4
_GATES = _SEEN * _SEEN * _DEPTHS
#: Bytes of text predicted at once and counted at once, and rows multiplied at once.
_BATCH_BYTES, _COUNT_BYTES, PRODUCT = 1 << 17, 1 << 20, 4096
_END = np.uint64(0x5851F42D4C957F2D)


def fold(doc_id: int | None) -> int:
    """crc32 of the id as decimal text, modulo FOLDS; a null id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


class Tree:
    """The Huffman tree of the tokens: leaves are frequent words (sorted hashes), then the end and the escape."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, ends: int, others: int):
        self.words = words
        heap = [(int(n) + 1, s, s) for s, n in enumerate([*counts, ends, others])]
        leaves = len(heap)
        heapq.heapify(heap)
        children: list[tuple[int, int]] = []
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), leaves + len(children)))
            children.append((a[2], b[2]))
        above = np.full(leaves + len(children), -1)
        bit = np.zeros(leaves + len(children), np.uint8)
        for i, pair in enumerate(children):
            for side, child in enumerate(pair):
                above[child], bit[child] = leaves + i, side
        nodes, bits, depths, length, root = [], [], [], [], len(above) - 1
        lines, places, codes = [], [], []
        for leaf in range(leaves):
            path, at = [], leaf
            while at != root:
                path.append((above[at] - leaves, bit[at]))
                at = above[at]
            path.reverse()
            nodes += [n for n, _ in path]
            bits += [b for _, b in path]
            depths += [min(i // 3, _DEPTHS - 1) for i in range(len(path))]
            for i in range(0, len(path), 3):  # up to seven nodes share a line: 1, 2 and 3 below it, 4 to 7 below these
                place = 1
                for _, b in path[i : i + 3]:
                    lines.append(path[i][0])
                    places.append(place)
                    place = 2 * place + b
            length.append(len(path))
            codes.append(sum(int(b) << (63 - i) for i, (_, b) in enumerate(path)))  # a path of over 64 bits takes 2^44 tokens
        # The leaves from left to right: those below a node are neighbours.
        self.code = np.array(codes, np.uint64)
        self.leaf_at = np.argsort(self.code)
        self.position = np.argsort(self.leaf_at).astype(np.uint64)
        self.width = np.uint64((leaves - 1).bit_length())
        self.length = np.array(length)
        self.start = (np.cumsum(self.length) - self.length).astype(np.int32)
        nodes, bits = np.array(nodes, np.uint32), np.array(bits, np.uint8)
        self.places = nodes << np.uint32(3) | np.array(depths, np.uint32) << np.uint32(1) | bits  # node, class of depth and bit in one number
        # A node's slot is one of the eight of its line, so a path touches a third as many places of a table.
        self.mixed = (tk.mix(np.array(lines, np.uint64) + np.uint64(1)) >> np.uint64(16)).astype(np.uint32) & ~np.uint32(7) | np.array(places, np.uint32)
        # Zeros and ones at each inner node, over all training tokens.
        n = np.zeros((2, len(children)))
        np.add.at(n, (bits, nodes), np.repeat(np.r_[counts, ends, others], self.length).astype(np.float64))
        self.logits = np.clip(np.log(n[1] + 0.5) - np.log(n[0] + 0.5), -12, 12).astype(np.float32)[nodes]

    def leaves(self, keys: np.ndarray) -> np.ndarray:
        """The leaf of each (context, token); see ``Tokens.keys``."""
        return self.leaf_at[(keys & ((np.uint64(1) << self.width) - np.uint64(1))).astype(np.int64)]

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """The leaf of each word."""
        if not len(self.words):
            return np.full(len(hashes), 1)
        i = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[i] == hashes, i, len(self.words) + 1)


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All numbers of ranges, one range after the other."""
    out = np.repeat((start - (np.cumsum(length) - length)).astype(np.int32), length)
    out += np.arange(len(out), dtype=np.int32)
    return out


class Tokens:
    """The tokens of some texts: symbol, text, and contexts of one and two words; the bits of all their paths in order."""

    def __init__(self, tree: Tree, words: tk.Words, walk: bool = True):
        n = words.n_docs
        self.counts = words.counts + 1
        ends = np.cumsum(self.counts) - 1
        hashes = np.zeros(len(words) + n, np.uint64)
        self.inner = inner = np.ones(len(hashes), bool)
        inner[ends] = False
        hashes[inner], hashes[ends] = words.hash, _END
        self.symbol = np.full(len(hashes), len(tree.words))
        self.symbol[inner] = tree.symbols(tk.signed(words.hash))
        self.first = np.r_[0, ends + 1]
        place = np.arange(len(hashes)) - np.repeat(self.first[:-1], self.counts)
        one, two = np.zeros(len(hashes), np.uint64), np.zeros(len(hashes), np.uint64)
        one[1:], two[2:] = hashes[:-1], hashes[:-2]
        one[place < 1] = 0
        two[place < 2] = 0
        self.contexts = [tk.mix(one ^ np.uint64(0x1111)), tk.mix(tk.mix(one + np.uint64(7)) ^ two)]
        if walk:
            mixed = self.walk(tree)
            length = tree.length[self.symbol]
            self.slots = [np.repeat((c >> np.uint64(32)).astype(np.uint32) & ~np.uint32(7), length) ^ mixed for c in self.contexts]

    def walk(self, tree: Tree) -> np.ndarray:
        """Find the bits of all paths; returns their nodes' shares of slots."""
        length = tree.length[self.symbol]
        path = _ranges(tree.start[self.symbol], length)
        place, self.logits, mixed = (np.take(t, path) for t in (tree.places, tree.logits, tree.mixed))
        self.node, self.depth, self.bits = place >> np.uint32(3), (place >> np.uint32(1)).astype(np.uint8) & np.uint8(3), (place & np.uint32(1)).astype(np.uint8)
        self.edges = np.r_[0, np.cumsum(length)][self.first]  # where texts' bits begin
        return mixed

    def keys(self, tree: Tree) -> np.ndarray:
        """(context, token) of each token in one number: first all contexts of one word, then all of two. Tokens of a context are in the tree's order."""
        place = tree.position[self.symbol]
        return np.concatenate([(c >> np.uint64(64 - CONTEXT_BITS)) << tree.width | place for c in self.contexts])

    def before(self) -> tuple[np.ndarray, np.ndarray]:
        """Zeros and ones of the same text and node that stand before each bit."""
        n = len(self.bits)
        shift = np.uint64(max(1, n - 1).bit_length())
        text = np.repeat(np.arange(len(self.edges) - 1, dtype=np.uint64) << np.uint64(18), np.diff(self.edges))
        order = (text | self.node) << shift
        order |= np.arange(n, dtype=np.uint64)
        order.sort()
        keys, order = order >> shift, (order & np.uint64((1 << int(shift)) - 1)).astype(np.int64)
        bits = self.bits[order].astype(np.int32)
        new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        ones = np.cumsum(bits, dtype=np.int32) - bits
        run = np.diff(np.r_[new, n])
        ones -= np.repeat(ones[new], run)
        out = np.empty((2, n), np.int32)
        out[1, order] = ones
        out[0, order] = np.arange(n, dtype=np.int32) - np.repeat(new.astype(np.int32), run) - ones
        return out[0], out[1]


def _logit(zeros: np.ndarray, ones: np.ndarray, more: float) -> np.ndarray:
    return np.log((ones + np.float32(more)) / (zeros + np.float32(more)))


def _classes(times: np.ndarray) -> np.ndarray:
    """How often a context was seen, in classes: never, once, two or three times, more."""
    return (times > 0).view(np.uint8) + (times > 1) + (times > 3)


class Counts:
    """Tables of zeros and ones by slot, as one task counts them."""

    def __init__(self, slots: int):
        self.tables = [np.zeros((slots, 2), np.int32) for _ in range(_TABLES)]

    def look_up(self, m: int, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pair = np.take(self.tables[m].view(np.int64).reshape(-1), slots & np.uint32(len(self.tables[m]) - 1)).view(np.int32)
        zeros, ones = np.ascontiguousarray(pair[::2]), np.ascontiguousarray(pair[1::2])
        return _logit(zeros, ones, 0.3).astype(np.float32, copy=False), _classes(zeros + ones)

    def add(self, tokens: Tokens) -> None:
        for t, s in zip(self.tables, tokens.slots):
            np.add.at(t.reshape(-1), 2 * (s & np.uint32(len(t) - 1)).astype(np.int64) + tokens.bits, np.int32(1))


def inputs(tokens: Tokens, tables: Counts | Model) -> tuple[np.ndarray, np.ndarray]:
    """Each bit's logits by model with a constant, and its gate."""
    x = np.empty((len(tokens.bits), _MODELS + 1), np.float32)
    x[:, 0], x[:, _MODELS] = tokens.logits, 0.3
    gate = tokens.depth.copy()
    for m, slots in enumerate(tokens.slots):
        x[:, 1 + m], seen = tables.look_up(m, slots)
        gate += np.uint8(_DEPTHS * _SEEN**m) * seen
    x[:, 1 + _TABLES] = _logit(*tokens.before(), 0.4)
    return x, gate


def _packed(logits: np.ndarray, seen: np.ndarray) -> np.ndarray:
    return (np.rint(np.clip(logits, -15, 15) * np.float32(512)).astype(np.int16) << 2) | seen


def _unpacked(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (packed >> 2) * np.float32(1 / 512), (packed & 3).astype(np.uint8)


class Model:
    """The tree, the models' logits (in steps of 1/512) and classes by slot in 16 bits, and the weights by gate."""

    def __init__(self, tree: Tree, tables: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray):
        self.tree, self.weights = tree, weights
        self.tables = [_packed(logits, seen) for logits, seen in tables]

    def look_up(self, m: int, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _unpacked(np.take(self.tables[m], slots & np.uint32(len(self.tables[m]) - 1)))

    def scores(self, words: tk.Words | Tokens) -> np.ndarray:
        """log10 probability of each text's tokens, escapes' tokens not told apart."""
        tokens = words if isinstance(words, Tokens) else Tokens(self.tree, words)
        z = mixed(self.weights, *inputs(tokens, self), tokens.bits, tokens.edges)
        np.negative(z, out=z, where=tokens.bits == 1)
        cost = np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))
        return -np.add.reduceat(cost.astype(np.float64), tokens.edges[:-1]) / np.log(10)


class Answered(Model):
    """A model of one chunk: what shards answered, along the paths of the chunk's different keys; tokens' slots are places in it."""

    def __init__(self, tree: Tree, answers: np.ndarray, weights: np.ndarray):
        self.tree, self.answers, self.weights = tree, answers, weights

    def look_up(self, m: int, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _unpacked(np.take(self.answers, slots))


def shared_bits(tree: Tree, keys: np.ndarray) -> np.ndarray:
    """How many bits each path shares with that of the key before; -1 if that is of another context. ``keys``: sorted and different."""
    code = tree.code[tree.leaves(keys)]
    apart = code[1:] ^ code[:-1]
    high = np.frexp((apart >> np.uint64(32)).astype(np.float64))[1]
    low = np.frexp((apart & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    same = (keys[1:] ^ keys[:-1]) >> tree.width == 0
    return np.r_[-1, np.where(same, 64 - np.where(high > 0, 32 + high, low), -1)][: len(keys)]


def _together(shared: np.ndarray, length: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(depth, keys, where runs begin among them, lengths of runs) of keys that are at one node of one context with others."""
    on, depth = np.arange(len(shared)), 0
    while True:
        # Such keys are neighbours: those between that end above the node are at none here.
        on = on[length[on] > depth]
        new = np.flatnonzero(shared[on] < depth)
        run = np.diff(np.r_[new, len(on)])
        on, run = on[np.repeat(run > 1, run)], run[run > 1]
        if not len(on):
            return
        yield depth, on, np.cumsum(run) - run, run
        depth += 1


def path_counts(tree: Tree, keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones of the key's context at each node of the key's path, keys' paths one after the other, in single precision.

    ``keys``: sorted and different, all those of their contexts; ``n``: how often each was counted. Sums are exact before they are rounded.
    """
    leaf = tree.leaves(keys)
    code, length = tree.code[leaf], tree.length[leaf]
    start = np.cumsum(length) - length
    zeros = np.repeat(n.astype(np.float32), length)
    ones = zeros * (tree.places[_ranges(tree.start[leaf], length)] & np.uint32(1)).astype(np.uint8)
    zeros -= ones
    for depth, on, new, run in _together(shared_bits(tree, keys), length):
        times, at = n[on], start[on] + depth
        one = np.add.reduceat(times * ((code[on] >> np.uint64(63 - depth)) & np.uint64(1)).astype(np.int64), new)
        ones[at] = np.repeat(one, run)
        zeros[at] = np.repeat(np.add.reduceat(times, new) - one, run)
    return zeros, ones


def _fresh(tree: Tree, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shared bits, lengths, nodes that are not on the path of the key before, which of the fresh nodes' bits are ones) of a chunk's keys.

    Only these nodes' logits are sent, and turned round where the bit is 0: then most are alike, and compress well.
    """
    leaf = tree.leaves(keys)
    shared, length = shared_bits(tree, keys), tree.length[leaf]
    fresh = length - shared - 1
    return shared, length, fresh, (tree.places[_ranges(tree.start[leaf] + shared + 1, fresh)] & np.uint32(1)).astype(bool)


def _turned(packed: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Packed logits, those of zeros turned round."""
    return np.where(ones, packed, -(packed >> 2) << 2 | packed & 3)


def _blocks(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bits' order by the number of their block in their text, where each number's bits begin, and each text's blocks."""
    size = np.diff(edges)
    steps = [FIRST_BLOCK]
    while steps[-1] < LAST_BLOCK:
        steps.append(2 * steps[-1])
    begins = np.r_[0, steps, np.arange(2 * LAST_BLOCK, size.max(initial=0), LAST_BLOCK)]  # of each block in its text
    texts = np.searchsorted(begins, size)
    block = np.concatenate([np.arange(n) for n in texts])
    begin = begins[block] + np.repeat(edges[:-1], texts)
    length = np.r_[begin[1:], edges[-1]] - begin
    by = np.argsort(block, kind="stable")
    length = length[by]
    order = np.arange(edges[-1]) + np.repeat(begin[by] - (np.cumsum(length) - length), length)
    ends = np.cumsum(np.bincount(block[by], length)).astype(np.int64)
    return order, np.r_[0, ends], texts


def mixed(weights: np.ndarray, x: np.ndarray, gate: np.ndarray, bits: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Each bit's logit. A text starts from ``weights``; after each of its blocks, its own copy takes a gradient step a gate."""
    order, begins, texts = _blocks(edges)
    rank = np.argsort(np.argsort(-texts, kind="stable"))  # texts with more blocks first, so those that go on are a prefix
    key = (np.repeat(rank, np.diff(edges)) * _GATES + gate)[order]
    x, y, w = np.take(x, order, axis=0), np.take(bits, order), np.tile(weights, (len(texts), 1))
    z = np.empty(len(order), np.float32)
    for r, (low, high) in enumerate(zip(begins, begins[1:])):
        k, xs = key[low:high], x[low:high]
        z[low:high] = np.einsum("ij,ij->i", np.take(w, k, axis=0), xs)
        if not (size := int((texts > r + 1).sum()) * _GATES):
            continue
        p, now = z[low:high], y[low:high]
        if size < len(w):
            on = np.flatnonzero(k < size)
            k, xs, p, now = np.take(k, on), np.take(xs, on, axis=0), np.take(p, on), np.take(now, on)
        p = 1 / (1 + np.exp(-np.clip(p, -30, 30)))
        miss = now - p
        curve = np.bincount(k, p * (1 - p) * np.einsum("ij,ij->i", xs, xs), size) + HOLD
        for m in range(_MODELS + 1):
            w[:size, m] += np.bincount(k, miss * xs[:, m], size) / curve
    out = np.empty_like(z)
    out[order] = z
    return out


def start_weights() -> np.ndarray:
    """Equal weights of each gate, and no constant."""
    return np.repeat(np.r_[np.full(_MODELS, 1 / _MODELS), 0.0][None], _GATES, 0).astype(np.float32)


class Learner:
    """Weights by gate, taught by online Newton steps, some texts at a time; texts are predicted before they're learned and counted."""

    def __init__(self):
        self.weights = start_weights().astype(np.float64)
        self.curve = np.repeat(np.eye(_MODELS + 1)[None] * 20, _GATES, 0)

    def learn(self, x: np.ndarray, gate: np.ndarray, bits: np.ndarray) -> None:
        order = np.argsort(gate, kind="stable")
        x, y, ends = np.take(x, order, axis=0), np.take(bits, order), np.r_[0, np.cumsum(np.bincount(gate, minlength=_GATES))]
        for j in np.flatnonzero(np.diff(ends)):
            xs = x[ends[j] : ends[j + 1]]
            p = 1 / (1 + np.exp(-np.clip(np.einsum("ij,j->i", xs, self.weights[j].astype(np.float32)), -30, 30)))
            sides = np.empty((len(xs), _MODELS + 2), np.float32)
            np.multiply(xs, (p * (1 - p))[:, None], out=sides[:, :-1])
            np.subtract(y[ends[j] : ends[j + 1]], p, out=sides[:, -1])
            # Larger products would be dealt to a library's threads, which gain nothing on ones this narrow and wait busily.
            sums = sum(xs[i : i + PRODUCT].T @ sides[i : i + PRODUCT] for i in range(0, len(xs), PRODUCT))
            self.curve[j] += sums[:, :-1]
            self.weights[j] += np.linalg.solve(self.curve[j], sums[:, -1])


def together(learners: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """One set of weights from the tasks' weights and curvatures, each weighing as it is sure."""
    if not learners:
        return start_weights()
    total = sum(c for _, c in learners)
    return np.linalg.solve(total, sum(c @ w[:, :, None] for w, c in learners))[:, :, 0].astype(np.float32)


def _training(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tk.Words]:
    """The words of the training texts, all of each."""
    for batch in batches:
        train = pa.array([fold(d) != HELD_OUT for d in batch.column("doc_id").to_pylist()], pa.bool_())
        for _, data, offsets in tk.slices(batch.filter(train), limit=limit):
            yield tk.Words(data, offsets, lower=True)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of the training texts, added up as far as KEPT different words go; ends are the word 0."""
    schema = pa.schema([("word", pa.int64()), ("n", pa.int64())])
    hashes, n, ends = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0

    def counted() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.r_[tk.signed(hashes), 0]), pa.array(np.r_[n, ends].astype(np.int64))], schema=schema)

    for words in _training(batches, _COUNT_BYTES):
        new, times = np.unique(words.hash, return_counts=True)
        both, times = np.concatenate([hashes, new]), np.concatenate([n, times])
        order = np.argsort(both)
        both, times = both[order], times[order]
        first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else np.zeros(0, np.int64)
        hashes, n, ends = both[first], np.add.reduceat(times, first) if len(first) else times, ends + words.n_docs
        if len(hashes) > KEPT:
            yield counted()
            hashes, n, ends = hashes[:0], n[:0], 0
    yield counted()


def _count_and_learn(held, slots: int):
    """(row, counts) of a task's tables, and under row -1 its weights and their curvature."""
    schema = pa.schema([("row", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, learner = Counts(slots), Learner()
        for words in _training(batches, _BATCH_BYTES):
            tokens = Tokens(held.value, words)
            learner.learn(*inputs(tokens, counts), tokens.bits)
            counts.add(tokens)
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([learner.weights.tobytes() + learner.curve.tobytes()], pa.binary())], schema=schema)
        row = min(ROW, 2 * slots)
        for m, t in enumerate(counts.tables):
            for i, part in enumerate(t.reshape(-1, row)):
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([m * (2 * slots // row) + i], pa.int32()), pa.array([part.tobytes()], pa.binary())], schema=schema)

    return run


def _add_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the counts of each row number, in 64 bits: the slots' logits, in half precision, and classes."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for row, raw in zip(batch.column("row").to_pylist(), batch.column("counts")):
            part = np.frombuffer(raw.as_buffer(), np.int32)
            sums[row] = sums[row] + part if row in sums else part.astype(np.int64)
    for row, n in sorted(sums.items()):
        zeros, ones = n.reshape(-1, 2).T
        out = _logit(zeros, ones, 0.3).astype(np.float16).tobytes() + _classes(zeros + ones).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([out], pa.binary())], ["row", "slots"])


def _slots(tokens: int, most: int) -> int:
    slots = LEAST_SLOTS
    while slots < most and slots * TOKENS_PER_SLOT < tokens:
        slots *= 2
    return slots


def _bytes(docs: DataFrame) -> int:
    return docs.select(F.octet_length("text").alias("n")).agg(F.sum("n")).first()[0] or 0


def _learned(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A task's weights and their curvature."""
    n, numbers = _MODELS + 1, np.frombuffer(raw)
    return numbers[: _GATES * n].reshape(_GATES, n), numbers[_GATES * n :].reshape(_GATES, n, n)


def _learn(docs: DataFrame, tree: Tree, tokens: int) -> Model:
    """Count the contexts of all training texts and learn the weights on all of them, in one pass."""
    context = docs.sparkSession.sparkContext
    slots = _slots(tokens, SLOTS)
    tasks = max(context.defaultParallelism, -(-_bytes(docs) // TASK_BYTES))
    counted = stage(docs.coalesce(tasks).transform(in_arrow, _count_and_learn(context.broadcast(tree), slots), "row int, counts binary"), "tables")
    row = min(ROW, 2 * slots)
    tables = [(np.zeros(slots, np.float32), np.zeros(slots, np.uint8)) for _ in range(_TABLES)]
    added = counted.where("row >= 0").repartition(max(8, _TABLES * 2 * slots // row // 16), "row").transform(in_arrow, _add_slots, "row int, slots binary")
    for r in stage(added, "slots").toLocalIterator():  # _TABLES x SLOTS numbers of three bytes
        (m, i), n = divmod(r["row"], 2 * slots // row), row // 2
        tables[m][0][i * n : (i + 1) * n] = np.frombuffer(r["slots"], np.float16, n)
        tables[m][1][i * n : (i + 1) * n] = np.frombuffer(r["slots"], np.uint8, n, 2 * n)
    learned = [_learned(r["counts"]) for r in counted.where("row < 0").collect()]  # 15 kB a task
    drop(counted)
    return Model(tree, tables, together(learned))


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, known_log double, after_log double, escapes long, rare array<long>, score double"


def _scored(rows: pa.RecordBatch, words: tk.Words, tokens: Tokens, model: Model, logs: np.ndarray, more: np.ndarray, more_logs: np.ndarray) -> pa.RecordBatch:
    """Per text its score without what follows escapes; logs of the counts of all held words and of those that are no leaves; and the others."""
    names = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("known_log", pa.float64())]
    schema = pa.schema([*names, ("after_log", pa.float64()), ("escapes", pa.int64()), ("rare", pa.list_(pa.int64())), ("score", pa.float64())])
    n = words.n_docs
    symbol = tokens.symbol[tokens.inner]
    leaf = symbol < len(model.tree.words)
    doc, other = words.doc[~leaf], tk.signed(words.hash[~leaf])
    at = np.minimum(np.searchsorted(more, other), max(0, len(more) - 1))
    hit = more[at] == other if len(more) else np.zeros(len(other), bool)
    known = np.bincount(words.doc[leaf], minlength=n) + np.bincount(doc[hit], minlength=n)
    after = np.bincount(doc[hit], more_logs[at[hit]], n)
    ends = np.searchsorted(doc[~hit], np.arange(n + 1)).astype(np.int32)
    ids = rows.column("doc_id").to_pylist()
    return pa.RecordBatch.from_arrays([
        pa.array(ids, pa.int64()), pa.array([fold(d) == HELD_OUT for d in ids], pa.bool_()), pa.array(words.counts.astype(np.int64) + 1),
        pa.array(known.astype(np.int64)), pa.array(np.bincount(words.doc[leaf], logs[symbol[leaf]], n) + after), pa.array(after, pa.float64()),
        pa.array(np.bincount(doc, minlength=n).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(other[~hit])), pa.array(model.scores(tokens)),
    ], schema=schema)


def _score(held):
    """The rows of ``_scored``, by tables that executors hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, *logs = held.value
        for batch in batches:
            for rows, data, offsets in tk.slices(batch, limit=_BATCH_BYTES):
                words = tk.Words(data, offsets, lower=True)
                yield _scored(rows, words, Tokens(model.tree, words), model, *logs)

    return run


#: Rows between chunks and shards: of a chunk's text (shard -1), of a task's weights (-2), else what a chunk asks a shard or is answered.
_MAIL = pa.schema([("place", pa.int32()), ("chunk", pa.int64()), ("shard", pa.int32()), ("part", pa.int32()), ("size", pa.int64()), ("body", pa.binary())])
_MAIL_SQL = "place int, chunk long, shard int, part int, size long, body binary"


def _mail(place: int, chunk: int, shard: int, part: int, raw) -> pa.RecordBatch:
    row = (place, chunk, shard, part, len(raw), pa.Codec("zstd", compression_level=1 if shard >= 0 else 6).compress(raw, asbytes=True))
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _MAIL)], schema=_MAIL)


def _planes(numbers: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second ones and so on, which compresses better."""
    return numbers.view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes()


def _numbers(raw, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def _added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, sorted, and the sums of their numbers."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[first], np.add.reduceat(n, first, dtype=n.dtype) if len(first) else n


def _learn_and_ask(held, slots: int, bits: int):
    """The texts by chunk, what each asks of each of 2 ** ``bits`` shards (its keys and how often it counts them), and the task's weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, counts, learner = held.value, Counts(slots), Learner()
        task, number = TaskContext.get().partitionId(), 0  # a task that runs again gives the same chunks
        edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(CONTEXT_BITS + int(tree.width) - bits)
        keys, times, size = [], [], 0

        def add() -> None:
            """Add up what there is so far, which keeps memory small."""
            new = _added(np.concatenate(keys), np.concatenate(times))
            keys[:], times[:] = [new[0]], [new[1]]

        def asked() -> Iterator[pa.RecordBatch]:
            add()
            all_keys, all_times = keys.pop(), times.pop()
            at = np.r_[0, np.searchsorted(all_keys, edges), len(all_keys)]
            for shard in np.flatnonzero(np.diff(at)).tolist():
                k, t = all_keys[at[shard] : at[shard + 1]], all_times[at[shard] : at[shard + 1]]
                yield _mail(shard, chunk, shard, 0, _planes(np.diff(k, prepend=np.uint64(0))) + _planes(t))

        chunk = task << 32
        for batch in batches:
            train = pa.array([fold(d) != HELD_OUT for d in batch.column("doc_id").to_pylist()], pa.bool_())
            for learns, mine in ((True, batch.filter(train)), (False, batch.filter(pa.compute.invert(train)))):
                for rows, _, _ in tk.slices(mine, limit=TEXT_BYTES):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, rows.schema) as out:
                        out.write_batch(rows)
                    yield _mail(chunk % (1 << bits), chunk, -1, size, sink.getvalue())
                    for _, data, offsets in tk.slices(rows, limit=_BATCH_BYTES):
                        tokens = Tokens(tree, tk.Words(data, offsets, lower=True), walk=learns)
                        if learns:
                            learner.learn(*inputs(tokens, counts), tokens.bits)
                            counts.add(tokens)
                        k, t = np.unique(tokens.keys(tree), return_counts=True)
                        keys.append(k)
                        times.append(t.astype(np.uint32) if learns else np.zeros(len(t), np.uint32))
                        size += len(data)
                        if len(keys) > 16:
                            add()
                    if size >= CHUNK_BYTES:
                        yield from asked()
                        size, number = 0, number + 1
                        chunk = task << 32 | number
        if keys:
            yield from asked()
        yield _mail(task % (1 << bits), task, -2, 0, learner.weights.tobytes() + learner.curve.tobytes())

    return run


def _answer(held):
    """Rows come sorted by shard. Add up what all chunks counted and answer each along the paths of its keys; other rows pass."""

    def answers(asked: list[tuple[int, int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        tree = held.value
        keys, n = _added(np.concatenate([k for _, _, k, _ in asked]), np.concatenate([t for _, _, _, t in asked]).astype(np.int64))
        zeros, ones = path_counts(tree, keys, n)
        packed = np.empty(len(zeros), np.int16)
        for i in range(0, len(zeros), 1 << 20):
            z, o = zeros[i : i + (1 << 20)], ones[i : i + (1 << 20)]
            packed[i : i + (1 << 20)] = _packed(_logit(z, o, 0.3), _classes(z + o))
        del zeros, ones
        length = tree.length[tree.leaves(keys)]
        start = np.cumsum(length) - length
        for chunk, shard, k, _ in asked:
            shared, _, fresh, ones = _fresh(tree, k)
            yield _mail(0, chunk, shard, 0, _planes(_turned(packed[_ranges(start[np.searchsorted(keys, k)] + shared + 1, fresh)], ones)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked = None, []
        for batch in batches:
            shards = batch.column("shard")
            yield batch.filter(pa.compute.less(shards, 0))
            for i, (chunk, shard, size) in enumerate(zip(batch.column("chunk").to_pylist(), shards.to_pylist(), batch.column("size").to_pylist())):
                if shard < 0:
                    continue
                if shard != now and asked:
                    yield from answers(asked)
                    asked = []
                now, raw = shard, pa.decompress(batch.column("body")[i].as_buffer(), size, "zstd")
                asked.append((chunk, shard, np.cumsum(_numbers(raw[: size // 12 * 8], np.uint64), dtype=np.uint64), _numbers(raw[size // 12 * 8 :], np.uint32)))
        if asked:
            yield from answers(asked)

    return run


def _score_chunks(held):
    """Rows come sorted by chunk, a chunk's texts first, then its answers by shard: the rows of ``_score``."""

    def scored(texts: list[pa.RecordBatch], answers: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        (tree, weights), *logs = held.value
        parts = []
        for text in texts:
            for rows, data, offsets in tk.slices(text, limit=_BATCH_BYTES):
                words = tk.Words(data, offsets, lower=True)
                parts.append((rows, words, Tokens(tree, words, walk=False)))
        keys, back = np.unique(np.concatenate([tokens.keys(tree) for _, _, tokens in parts]), return_inverse=True)
        shared, length, fresh, ones = _fresh(tree, keys)
        answer = np.concatenate(answers)
        if len(ones) != len(answer):
            raise ValueError("a chunk lacks answers")
        answer, start, first = _turned(answer, ones), np.cumsum(length) - length, np.cumsum(fresh) - fresh - shared - 1
        model, low = Answered(tree, np.take(answer, _ranges(first, length), mode="clip"), weights), 0  # the others' nodes follow
        for depth, on, new, run in _together(shared, length):
            model.answers[start[on] + depth] = np.repeat(answer[first[on[new]] + depth], run)
        for rows, words, tokens in parts:
            tokens.walk(tree)
            n = len(tokens.symbol)
            tokens.slots = [_ranges(start[at], length[at]) for at in (back[low : low + n], back[low + n : low + 2 * n])]
            low += 2 * n
            yield _scored(rows, words, tokens, model, *logs)
            del tokens.node, tokens.depth, tokens.bits, tokens.logits, tokens.slots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, texts, answers = None, [], []
        for batch in batches:
            for i, (chunk, shard, size) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("chunk", "shard", "size")))):
                if chunk != now and texts:
                    yield from scored(texts, answers)
                    texts, answers = [], []
                now, raw = chunk, pa.decompress(batch.column("body")[i].as_buffer(), size, "zstd")
                if shard < 0:
                    texts += list(pa.ipc.open_stream(raw))
                else:
                    answers.append(_numbers(raw, np.int16))
        if texts:
            yield from scored(texts, answers)

    return run


def _ask_and_score(docs: DataFrame, tree: Tree, tokens: int, *logs: np.ndarray) -> DataFrame:
    """The rows of ``_score`` where tables are too large for executors to hold: contexts are counted and looked up in shards."""
    context, size = docs.sparkSession.sparkContext, _bytes(docs)
    bits = max(0, -(-_TABLES * tokens // SHARD_TOKENS) - 1).bit_length()
    tasks = max(context.defaultParallelism, -(-size // TASK_BYTES))
    asked = docs.coalesce(tasks).transform(in_arrow, _learn_and_ask(shared := context.broadcast(tree), _slots(tokens, LEARN_SLOTS), bits), _MAIL_SQL)
    dealt = asked.repartitionById(1 << bits, F.col("place")).sortWithinPartitions("shard", "chunk")
    mail = stage(dealt.transform(in_arrow, _answer(shared), _MAIL_SQL), "mail")
    del asked, dealt
    weights = together([_learned(pa.decompress(r["body"], r["size"], "zstd", asbytes=True)) for r in mail.where("shard = -2").collect()])  # 15 kB a task
    scores, rows = _score_chunks(context.broadcast(((tree, weights), *logs))), []
    for part in range(PARTS):
        release(docs.sparkSession, 1)  # the files of the questions, or of the part before, go before a part is dealt
        chunks = mail.where("shard > -2").where(F.pmod(F.xxhash64("chunk"), F.lit(PARTS)) == part).repartition(tasks + size // CHUNK_BYTES // PARTS, "chunk")
        rows.append(stage(chunks.sortWithinPartitions("chunk", "shard", "part").transform(in_arrow, scores, _SCORES), "scores"))
        del chunks
    drop(mail)
    return reduce(DataFrame.union, rows)


def lm_scores(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null text counts as empty: its one token is the end. A row with a null id is scored and learned from
    like the others; rows repeated under one id give one row each, and count as often in learning. Without
    training texts all counts are 0 and the models know nothing.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with batches_of(docs.sparkSession, BATCH_ROWS):
        return _lm_scores(docs)


def _frequent(counts: DataFrame) -> pd.DataFrame:
    """The words of the most frequent classes, each within 5 % of a count, that are at most VOCABULARY + HELD_WORDS together.

    Classes are taken whole: a top-k would have each partition send so many words to the driver.
    """
    level = F.floor(F.log2("n") * 16)
    words = counts.where("word <> 0")
    room, least = VOCABULARY + HELD_WORDS, 16 * 64
    for r in sorted(words.groupBy(level.alias("level")).count().collect(), reverse=True):  # at most 1,024 classes
        room -= r["count"]
        if room < 0:
            break
        least = r["level"]
    return words.where(level >= least).toPandas()


def _lm_scores(docs: DataFrame) -> DataFrame:
    counts = stage(docs.transform(in_arrow, _count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0"), "counts")
    totals = counts.agg(F.count("*").alias("distinct"), F.sum("n").alias("all"), F.sum(F.expr("if(word = 0, n, 0)")).alias("ends")).first()
    distinct, all_tokens, ends = totals["distinct"], totals["all"] or 0, totals["ends"] or 0
    frequent = _frequent(counts).sort_values(["n", "word"], ascending=[False, True])
    leaves, more = (part.sort_values("word") for part in (frequent[:VOCABULARY], frequent[VOCABULARY:]))
    held_words, held_counts = leaves["word"].to_numpy(np.int64), leaves["n"].to_numpy(np.int64)
    others = all_tokens - ends - int(held_counts.sum())
    tree = Tree(held_words, held_counts, ends, others)
    held = (np.log10(held_counts + 1.0), more["word"].to_numpy(np.int64), np.log10(more["n"].to_numpy(np.int64) + 1.0))
    if all_tokens > SLOTS * TOKENS_PER_SLOT:
        rows = _ask_and_score(docs, tree, all_tokens, *held)
    else:
        held = docs.sparkSession.sparkContext.broadcast((_learn(docs, tree, all_tokens), *held))
        rows = stage(docs.transform(in_arrow, _score(held), _SCORES), "scores")
    total = float(np.log10(all_tokens + distinct + 1))
    rare = rows.select(F.xxhash64("doc_id", "score", "n_tokens", "known_log").alias("row"), F.explode("rare").alias("word"))
    # No word is frequent here, so none is a hot key.
    rare = rare.join(counts, "word")
    # Copies of a row (same id and text) are one key here, so their sums are divided by their number.
    sums = rare.groupBy("row").agg(F.count("*").alias("rare_known"), F.sum(F.log10(F.col("n") + 1.0)).alias("rare_log"))
    keyed = rows.withColumn("row", F.xxhash64("doc_id", "score", "n_tokens", "known_log")).drop("rare")
    copies = keyed.groupBy("row").agg(F.count("*").alias("copies")).where("copies > 1")
    out = keyed.join(sums, "row", "left").join(copies, "row", "left").na.fill(0, ["rare_known"]).na.fill(0.0, ["rare_log"])
    share = F.coalesce("copies", F.lit(1))
    known = F.col("n_known") + F.expr("rare_known div coalesce(copies, 1)")
    rare_log = F.col("rare_log") / share
    base = F.col("known_log") + rare_log + F.lit(float(np.log10(ends + 1))) - F.col("n_tokens") * F.lit(total)
    # A token after an escape: add-one smoothing among the words that are no leaves, with one share for all unseen.
    after = F.col("after_log") + rare_log - F.col("escapes") * F.lit(float(np.log10(others + max(0, distinct - len(held_words) - (ends > 0)) + 1)))
    return out.select(
        "doc_id", "held_out", "n_tokens", (known + F.lit(1 if ends else 0)).cast("long").alias("n_known"), F.lit(all_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + after).alias("score")
    )
