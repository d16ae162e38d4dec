"""Operator 9: language-model scores by online logistic context mixing.

A text is its words in ASCII lower case and an end mark. Words with codes are the leaves of a binary tree, ordered by
their endings, whose halves weigh about the same; any other word is the tree's escape, then its bytes and a space, which have
a tree of their own. All bits of a leaf are predicted, each by three hashed contexts that have counted zeros and ones.

words   the word before; the last two of the commonest words, which tell language and style; the two words before
bytes   the last two and the last four bytes; the whole word so far

The contexts' stretched probabilities are added with weights that a gate chooses by how often each context was seen; a
refiner corrects the sums by how often such sums came true. Seven of eight training texts are counted first; the eighth,
chosen by its hash, shows how their contexts do together, from which the driver fits weights and refiner, and is counted
then. Within a text the weights move online: after each FIRST words by the slopes of the text so far.

Lines that other training texts hold too are recalled: a line's probability is mixed from the mixer's and the line's share of
all training lines, a text's own lines left out.

All that is learned comes from sums of whole numbers, so results don't depend on how rows are dealt. Words and lines are
counted in a distributed table that grows with the corpus and is joined; only words with 2**-19 of all tokens, at most
2**19, and tables of fixed size are sent to the workers.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, read_table, sliced, small_batches

END = b"\n"
FOLDS, HELD_OUT = 5, 1
#: One training text, or word without a code, in so many shows how contexts do together.
TUNES = 8
#: A word has a code with at least this share of all tokens, and this many of them.
FREQUENT, LEAST = 2**-19, 3
#: So many of the commonest words count as a text's last common words.
COMMON = 128
#: Words of a text after which its weights move.
FIRST = 16
#: Lines with fewer bytes are not recalled.
MIN_LINE = 32
#: Bytes of texts, symbols, and bits, taken at a time.
BATCH_BYTES, BATCH_SYMBOLS, BATCH_BITS = 1 << 21, 32_768, 32_768
#: A context is the surer the more of these numbers of times it was seen.
SURE = (0.5, 4, 60)
K, LEVELS = 3, len(SURE) + 1
SETS = LEVELS**K
#: Stretched probabilities are told apart in STRETCHED parts of STEP; a state is one of them and how sure its context is.
STRETCHED, STEP = 32, 0.58
STATES = STRETCHED * LEVELS
#: Flips a state to that of the opposite bit.
FLIP = np.uint8((STRETCHED - 1) * LEVELS)
#: Bits of a triple's number to the right of each state's part.
SHIFTS = [(STATES.bit_length() - 1) * (K - 1 - j) + LEVELS.bit_length() - 1 for j in range(K)]
#: Parts of sums that the refiner tells apart.
BUCKETS = 49
#: Bits of a symbol at most: more than a symbol of a 2**-19th, or of one in 2**38 bytes, has, so contexts predict them all.
WORD_DEPTH, BYTE_DEPTH = 24, 40
#: Levels of a tree whose nodes have their places beside each other.
STOREY = 5
#: Contexts, as powers of two, that the tables of the two nets tell apart: a storey of a symbol's bits is one.
WORD_TABLES, BYTE_TABLES = (15, 13, 14), (12, 15, 16)
#: Cells of partial tables that travel together; partial tables added at a time.
BLOCK, FAN = 4096, 32
#: Added to curvatures; bits after which a text's own slopes weigh as much as one.
RIDGE, OWN_RIDGE = 10.0, 40.0
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def line_key(line: bytes) -> bytes:
    """Where a line stands among the words: after a space, which no word holds."""
    return b" " + hashlib.md5(line, usedforsecurity=False).digest()


class Text:
    """A text's words with its end mark, and its lines with words: how many, and the line if it can be recalled.

    A line ends at a line's end or after a full stop before a space. The end mark is a line of its own.
    """

    __slots__ = ("lines", "n_bytes", "sizes", "words")

    def __init__(self, text: str | None):
        raw = (text or "").encode("utf-8", "replace")
        self.n_bytes, self.words, self.sizes, self.lines = len(raw), [], [], []
        for line in raw.replace(b". ", b".\n").split(b"\n"):
            own = line.lower().split()  # at just the space and the controls 9 to 13
            if own:
                self.words += own
                self.sizes.append(len(own))
                self.lines.append(line if len(line) >= MIN_LINE else None)
        self.words.append(END)
        self.sizes.append(1)
        self.lines.append(None)


class Texts:
    """Texts of an Arrow array, as Text has them, in bulk.

    words: of all texts one after the other, with end marks; n_words: of each text, its end mark included; sizes: of all
    lines; line_text, line_at, lines: of the lines that can be recalled, their text's place, their place among sizes, and themselves.
    """

    __slots__ = ("line_at", "line_text", "lines", "n_bytes", "n_words", "sizes", "words")

    def __init__(self, column: pa.Array):
        raw = column.cast(pa.binary())
        self.n_bytes = pc.binary_length(raw).to_numpy(zero_copy_only=False)
        parts = pc.split_pattern(pc.replace_substring(raw, b". ", b".\n"), b"\n")
        lines, of = parts.flatten(), pc.list_parent_indices(parts).to_numpy()
        # Each text's end mark comes after its last line; as a line of its own it is the newline, which splits off no word.
        ends = np.searchsorted(of, np.arange(len(raw)), side="right")
        split = pc.ascii_split_whitespace(pc.ascii_lower(lines.view(pa.string())))
        words = split.flatten()
        full = pc.binary_length(words).to_numpy() > 0
        line = pc.list_parent_indices(split).to_numpy()[full]
        words = words.view(pa.binary()).filter(pa.array(full))
        count = np.bincount(line, minlength=len(lines))
        before = np.concatenate([[0], np.cumsum(count)])
        self.n_words = np.diff(before.take(ends), prepend=0) + 1
        # The words, and last the mark, taken in the order of the texts.
        last = np.cumsum(self.n_words) - 1
        order = np.full(len(words) + len(raw), len(words), np.int64)
        inside = np.ones(len(order), bool)
        inside[last] = False
        order[inside] = np.arange(len(words))
        self.words = pa.concat_arrays([words, pa.array([END], pa.binary())]).take(pa.array(order))
        kept = count > 0
        at = np.flatnonzero(kept)
        self.sizes = np.insert(count[kept], np.concatenate([[0], np.cumsum(kept)]).take(ends), 1)
        long = np.flatnonzero(pc.binary_length(lines).to_numpy()[at] >= MIN_LINE)
        self.line_text = of[at[long]]
        self.line_at = long + self.line_text
        self.lines = lines.take(pa.array(at[long])).to_pylist()


def mixed(x: np.ndarray) -> np.ndarray:
    """32 bits that depend on all bits of x."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


class Code:
    """Symbols as leaves of a binary tree in their order. Each node's halves weigh about the same; in each storey nodes are numbered from 1, those below node k 2k and 2k + 1."""

    def __init__(self, counts: np.ndarray, depth: int):
        n, upto = len(counts), np.concatenate([[0], np.cumsum(counts)])
        bits, self.size, self.rest, self.depth = np.zeros((n, depth), np.uint8), np.zeros(n, np.int64), np.zeros(n), depth
        open_ = [(0, n, 0)]
        while open_:
            a, b, level = open_.pop()
            if b - a == 1 or level == depth:
                self.size[a:b] = level
                # What the bits leave open.
                self.rest[a:b] = np.log10(counts[a:b] / (upto[b] - upto[a]))
                continue
            half = (upto[a] + upto[b]) / 2
            cut = min(max(int(np.searchsorted(upto[a : b + 1], half)) + a, a + 1), b - 1)
            if cut - 1 > a and half - upto[cut - 1] < upto[cut] - half:
                cut -= 1
            bits[cut:b, level] = 1
            open_ += [(a, cut, level + 1), (cut, b, level + 1)]
        node, stem = np.ones((n, depth), np.uint8), np.zeros((n, -(-depth // STOREY)), np.uint32)
        for level in range(1, depth):
            below = node[:, level - 1] * 2 + bits[:, level - 1]
            new = level % STOREY == 0
            if new:
                stem[:, level // STOREY] = mixed(stem[:, level // STOREY - 1] + below.astype(np.uint32))
            node[:, level] = 1 if new else below
        # By level, and by storey, so that what is read together lies together.
        self.step, self.stem = np.ascontiguousarray((node * 2 + bits).T), np.ascontiguousarray(stem.T)

    def expand(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of symbols one after the other: each bit's symbol's place, its node in its storey, what tells the storey, and itself; the first bit of each symbol."""
        size = self.size.take(symbols)
        first = np.cumsum(size) - size
        of = np.repeat(np.arange(len(symbols)), size)
        level = np.arange(len(of)) - first.take(of)
        step = self.step[level, symbols.take(of)]
        return of, step >> 1, self.stem[level // STOREY, symbols.take(of)], step & 1, first


def state_of(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The states, for a one, of contexts with so many zeros and ones."""
    sure = np.zeros(len(zeros), np.uint8)
    for least in SURE:
        sure += zeros + ones > least
    x = np.log((ones + np.float32(0.4)) / (zeros + np.float32(0.4))) / np.float32(STEP) + np.float32(STRETCHED / 2)
    return np.floor(x).clip(0, STRETCHED - 1).astype(np.uint8) * np.uint8(LEVELS) + sure


def odds_of(total: np.ndarray) -> np.ndarray:
    """One by the probabilities that have been stretched to total."""
    return 1 + np.exp(-total)


def log10_of(total: np.ndarray) -> np.ndarray:
    """log10 of the probabilities that have been stretched to total."""
    return -np.log10(odds_of(total))


class Net:
    """Three predictors over the bits of a code, mixed.

    states: of all places of all contexts; mixture: the stretched probability of each triple of states, by weights (SETS, K) and refiner.
    """

    def __init__(self, code: Code, tables: tuple[int, ...], counts: np.ndarray | None = None, mixture: np.ndarray | None = None):
        self.code, self.tables, self.mixture = code, tables, mixture
        self.starts = [int(x) for x in np.concatenate([[0], np.cumsum([1 << b + STOREY for b in tables])])]
        self.states = None if counts is None else np.concatenate([state_of(*counts[i : i + BLOCK * 64].reshape(-1, 2).T.astype(np.float32)) for i in range(0, len(counts), BLOCK * 64)])
        self.stretched = self.stretch(np.arange(STATES)).astype(np.float32)

    def bits(self, symbols: np.ndarray, contexts: np.ndarray):
        """Of symbols, some at a time, level by level: their slice, the places in it of those that have a bit there, the bits, the level, and the places in the table of each predictor.

        Symbols with more bits come first, so at each level there are the first ones of the level before.
        """
        for i in range(0, len(symbols), BATCH_SYMBOLS):
            own = slice(i, i + BATCH_SYMBOLS)
            size = self.code.size.take(symbols[own])
            of = np.argsort((self.code.depth - size).astype(np.uint8), kind="stable")
            chosen, met = symbols[own].take(of), contexts[:, own].take(of, axis=1)
            for level, n in enumerate((len(of) - np.cumsum(np.bincount(size)))[:-1].tolist()):
                if level % STOREY == 0:
                    stem = self.code.stem[level // STOREY].take(chosen[:n])
                    hashes = [((met[j, :n] ^ stem) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - b) for j, b in enumerate(self.tables)]
                    rows = [h.astype(np.int64) * (1 << STOREY) + start for h, start in zip(hashes, self.starts, strict=False)]
                step = self.code.step[level].take(chosen[:n])
                node = (step >> 1).astype(np.int64)
                yield own, of[:n], step & 1, level, [r[:n] + node for r in rows]

    def count(self, sums: np.ndarray, symbols: np.ndarray, contexts: np.ndarray, weight: np.ndarray | None = None) -> None:
        """Adds the zeros and ones of symbols, weight times each, to sums (all places * 2)."""
        for own, of, bit, _, places in self.bits(symbols, contexts):
            times = np.int32(1) if weight is None else weight[own].take(of)
            for at in places:
                np.add.at(sums, at * 2 + bit, times)

    def meet(self, sums: np.ndarray, symbols: np.ndarray, contexts: np.ndarray, weight: np.ndarray | None = None) -> None:
        """Adds the triples of states that the bits of symbols meet to sums (STATES ** K)."""
        for own, of, bit, _, places in self.bits(symbols, contexts):
            np.add.at(sums, self.met(bit, places)[1], np.int32(1) if weight is None else weight[own].take(of))

    def met(self, bit: np.ndarray, places: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """The states of the bits as they are, and the number of their triple."""
        flip, states = (bit ^ 1) * FLIP, [self.states.take(at) for at in places]
        cell = np.zeros(len(bit), np.int32)
        for own in states:
            own ^= flip
            cell *= STATES
            cell += own
        return states, cell

    @staticmethod
    def stretch(states: np.ndarray) -> np.ndarray:
        return (states // LEVELS + 0.5 - STRETCHED / 2) * STEP

    def scores(self, symbols: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """log10 of each symbol's probability, what its bits leave open included."""
        odds, order = np.ones(len(symbols)), np.empty(len(symbols), np.int64)
        for own, of, bit, level, places in self.bits(symbols, contexts):
            if level == 0:
                order[own] = of + own.start
            odds[own.start : own.start + len(of)] *= odds_of(self.mixture.take(self.met(bit, places)[1]))
        out = self.code.rest.take(symbols)
        out[order] -= np.log10(odds)
        return out

    def online_scores(self, symbols: np.ndarray, contexts: np.ndarray, text: np.ndarray, place: np.ndarray) -> np.ndarray:
        """As scores, with weights that move in each text (its number, text; place: the symbol's place in it)."""
        out = self.code.rest.take(symbols)
        if not len(symbols):
            return out
        block = place // FIRST
        order = np.argsort(block.astype(np.uint16) if block.max() < 1 << 16 else block, kind="stable")
        symbols, text, block = symbols.take(order), text.take(order), block.take(order)
        size = self.code.size.take(symbols)
        first = np.cumsum(size) - size
        n = int(size.sum())
        cells = np.empty(n, np.int32)
        for own, of, bit, level, places in self.bits(symbols, contexts.take(order, axis=1)):
            cells[first[own].take(of) + level] = self.met(bit, places)[1]
        # A run is a text's symbols in a block. Runs of a block, or of a part of it, are told together: no text has two of them.
        new_block = np.concatenate([[True], block[1:] != block[:-1]])
        runs = np.flatnonzero(new_block | np.concatenate([[True], text[1:] != text[:-1]]))
        number, begin = text.take(runs), first.take(runs)
        bits = np.diff(begin, append=n)
        parts = np.flatnonzero(new_block.take(runs) | (np.diff(begin // BATCH_BITS, prepend=0) > 0)).tolist()
        slope, seen = np.zeros((K, int(text.max()) + 1)), np.zeros(int(text.max()) + 1)
        odds = np.empty(n, np.float32)
        for a, b in zip(parts, [*parts[1:], len(runs)], strict=True):
            own, long, start = number[a:b], bits[a:b], begin[a]
            here = slice(start, begin[b - 1] + long[-1])
            cell = cells[here]
            total, x = self.mixture.take(cell), []
            for shift in SHIFTS:
                x.append((cell >> shift & STRETCHED - 1).astype(np.float32))
                x[-1] -= np.float32((STRETCHED - 1) / 2)
                x[-1] *= np.float32(STEP)
            move = (slope.take(own, axis=1) / (seen.take(own) + OWN_RIDGE)).clip(-0.3, 0.3).astype(np.float32)
            for j in range(K):
                total += x[j] * np.repeat(move[j], long)
            odds[here] = odds_of(total)
            miss = 1 - 1 / odds[here]
            for j in range(K):
                slope[j, own] += np.add.reduceat(miss * x[j], begin[a:b] - start)
            seen[own] += long
        out[order] -= np.log10(np.multiply.reduceat(odds, first, dtype=np.float64))
        return out


def fitted(sums: np.ndarray) -> np.ndarray:
    """The stretched probability of each triple of states, from how often triples came with the bit as it was: gated weights by Newton steps, then the refiner."""
    digits = lambda cells: [(cells // STATES ** (K - 1 - j)) % STATES for j in range(K)]
    chosen_of = lambda parts: (parts[0] % LEVELS * LEVELS + parts[1] % LEVELS) * LEVELS + parts[2] % LEVELS
    cells = np.flatnonzero(sums)
    n, parts = sums[cells].astype(np.float64), digits(cells)
    x, chosen = Net.stretch(np.stack(parts)), chosen_of(parts)
    # To begin with, the contexts that were seen often lead.
    sure = np.stack(np.meshgrid(*[np.arange(LEVELS)] * K, indexing="ij"), axis=-1).reshape(SETS, K)
    first = (sure + 0.1) / (sure + 0.1).sum(axis=1, keepdims=True)
    w = first.copy()
    for _ in range(12):
        miss = 1 / (1 + np.exp((x * w[chosen].T).sum(axis=0).clip(-30, 30)))
        slope = np.stack([np.bincount(chosen, n * miss * x[j], SETS) for j in range(K)], axis=1) - RIDGE * (w - first)
        bend = n * miss * (1 - miss)
        curve = np.stack([np.stack([np.bincount(chosen, bend * x[i] * x[j], SETS) for i in range(K)], axis=1) for j in range(K)], axis=1)
        w += np.linalg.solve(curve + np.eye(K) * RIDGE, slope[..., None])[..., 0].clip(-0.5, 0.5)
    out, hits = np.empty(STATES**K, np.float32), np.zeros(SETS * BUCKETS)
    bucket = lambda chosen, t: chosen * BUCKETS + np.rint(t * 2).astype(np.int64) + BUCKETS // 2

    def mixtures():
        """The cells, some at a time: their slice, sets, and sums of stretched probabilities."""
        for first in range(0, STATES**K, 1 << 16):
            parts = digits(np.arange(first, first + (1 << 16)))
            chosen = chosen_of(parts)
            yield slice(first, first + (1 << 16)), chosen, (Net.stretch(np.stack(parts)) * w[chosen].T).sum(axis=0).clip(-12, 12)

    for own, chosen, total in mixtures():
        hits += np.bincount(bucket(chosen, total), sums[own], SETS * BUCKETS)
    for own, chosen, total in mixtures():
        seen, other = hits[bucket(chosen, total)], hits[bucket(chosen, -total)]
        p = 1 / (1 + np.exp(-total))
        p = 0.5 * p + 0.5 * (seen + 20 * p) / (seen + other + 20)
        out[own] = np.log(p / (1 - p))
    return out


class Vocabulary:
    """The words with codes, by their endings; 0 is the escape. counts: of all tokens, the escape's first."""

    def __init__(self, counts: dict[bytes, int], escapes: int):
        words = sorted(counts, key=lambda w: w[::-1])
        self.words, self.number = pa.array(words, pa.binary()), {w: i for i, w in enumerate(words, 1)}
        self.counts = np.array([escapes, *(counts[w] for w in words)], np.int64)
        self.code = Code(np.maximum(self.counts, 1), WORD_DEPTH)
        self.common = np.zeros(len(words) + 2, bool)
        self.common[np.lexsort((np.arange(len(words)), -self.counts[1:]))[:COMMON] + 1] = True
        self.common[-1] = True  # the start mark

    def symbols(self, texts: list[Text]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Of texts one after the other: the symbols, their contexts (K, symbols), their texts' numbers and places, and the words."""
        flat = [w for t in texts for w in t.words]
        ids = np.fromiter(map(self.number.get, flat, repeat(0)), np.int64, len(flat))
        return *self.placed(ids, np.array([len(t.words) for t in texts], np.int64)), flat

    def symbols_of(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As symbols, without the words."""
        ids = pc.index_in(texts.words, value_set=self.words).fill_null(-1).to_numpy().astype(np.int64) + 1
        return self.placed(ids, texts.n_words)

    def placed(self, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The symbols of texts of such sizes, their contexts (K, symbols), their texts' numbers and places."""
        start, text = len(self.counts), np.repeat(np.arange(len(size)), size)
        inside = np.arange(len(ids)) + text + 1
        row = np.full(len(ids) + len(size), start, np.int64)  # a start mark before each text
        row[inside] = ids
        at = np.arange(len(row))
        last = np.maximum.accumulate(np.where(self.common.take(row), at, 0))
        before, common = row.take(inside - 1), last.take(inside - 1)
        two = np.where(before == start, start, row.take(np.maximum(inside - 2, 0)))
        older = np.where(row.take(common) == start, common, last.take(np.maximum(common - 1, 0)))
        u = lambda x: x.astype(np.uint32)
        pair = lambda a, b, salt: mixed(u(a) * np.uint32(0x9E3779B1) + u(b) * np.uint32(0x85EBCA77) + np.uint32(salt))
        contexts = np.stack([mixed(u(before) + np.uint32(7)), pair(row.take(common), row.take(older), 1), pair(before, two, 2)])
        return ids, contexts, text, np.arange(len(ids)) - (np.cumsum(size) - size).take(text)


def byte_code(counts: dict[bytes, int]) -> Code:
    """A code of bytes by how often they stand in the words with codes; every byte has one."""
    seen = np.ones(256, np.int64)
    seen[32] += sum(counts.values())
    for w, n in counts.items():
        for b in w:
            seen[b] += n
    return Code(seen, BYTE_DEPTH)


def spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words as they are spelled: their bytes, the contexts (K, bytes), the first byte of each."""
    size = np.array([len(w) + 1 for w in words], np.int64)
    first = np.cumsum(size) - size
    b = np.frombuffer(b" ".join([*words, b""]), np.uint8)
    at = (np.arange(len(b)) - np.repeat(first, size)).astype(np.uint32)
    before = [np.where(at >= k, np.concatenate([np.zeros(k, np.uint8), b])[: len(b)], 0).astype(np.uint32) for k in range(1, 5)]
    sums = np.concatenate([np.zeros(1, np.uint32), np.cumsum(mixed(b.astype(np.uint32) + np.uint32(257) * at + np.uint32(1)), dtype=np.uint32)])
    two = before[0] | before[1] << np.uint32(8)
    four = two | before[2] << np.uint32(16) | before[3] << np.uint32(24)
    contexts = [mixed(two + np.uint32(3)), mixed(four ^ np.uint32(0x3C6EF372)), mixed(sums[:-1] - np.repeat(sums[first], size) + at)]
    return b.astype(np.int64), np.stack(contexts), first


def batches_of(words: list[bytes]) -> Iterator[list[bytes]]:
    """Words, with about BATCH_SYMBOLS bytes at a time."""
    start = size = 0
    for i, w in enumerate(words):
        size += len(w) + 1
        if size >= BATCH_SYMBOLS:
            yield words[start : i + 1]
            start, size = i + 1, 0
    if start < len(words):
        yield words[start:]


def text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices with about BATCH_BYTES bytes of text at a time."""
    for batch in sliced(batches):
        size = np.cumsum(pc.binary_length(batch.column("text")).to_numpy())
        cuts = [0, *(np.flatnonzero(np.diff(size // BATCH_BYTES)) + 1).tolist(), len(size)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def word_table(docs: DataFrame) -> DataFrame:
    """word, n of all words of docs (text), and of the lines that can be recalled, which stand among the words by their line_key. End marks aren't in it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            texts = Texts(batch.column("text"))
            words, n = texts.words.value_counts().flatten()
            lines = Counter(texts.lines)
            if len(words):
                yield pa.RecordBatch.from_arrays([words, n], ["word", "n"]).filter(pc.not_equal(words, pa.scalar(END, pa.binary())))
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array(map(line_key, lines), pa.binary()), pa.array(lines.values(), pa.int64())], ["word", "n"])

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


PARTIAL = "part int, block int, sums binary"


def blocks_of(sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The blocks of a partial table (int32) that are not all zero."""
    part = TaskContext.get().partitionId()
    for i in range(0, len(sums), BLOCK):
        own = sums[i : i + BLOCK]
        if own.any():
            own = np.concatenate([own, np.zeros(BLOCK - len(own), np.int32)])
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([i // BLOCK], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["part", "block", "sums"])


def _cells(x: pa.Scalar) -> np.ndarray:
    """A block: of int32 as a task counts it, of int64 once blocks were added."""
    data = x.as_buffer()
    return np.frombuffer(data, np.int64 if len(data) == 8 * BLOCK else np.int32)


def added(parts: DataFrame, length: int) -> np.ndarray:
    """The sums of partial tables (part, block, sums): FAN at a time are added, at last on the driver, where a table of fixed size comes."""

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for x in rows.column("sums"):
            total += _cells(x)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    n = parts.rdd.getNumPartitions()
    while n > 1:
        parts = parts.withColumn("part", (F.col("part") / FAN).cast("int")).groupBy("part", "block").applyInArrow(add, PARTIAL)
        n = -(-n // FAN)
    out = np.zeros((-(-length // BLOCK), BLOCK), np.int64)
    got = parts.toArrow()
    for k, x in zip(got.column("block").to_pylist(), got.column("sums"), strict=True):
        out[k] += _cells(x)
    return out.reshape(-1)[:length]


def trained(rows: DataFrame, net: Net, symbols) -> Net:
    """net with the counts of all of rows (tune, and what symbols reads); rows with tune are met by the counts of the others before they are counted.

    symbols: gives (symbols, contexts, weight) of Arrow batches.
    """
    context, places = rows.sparkSession.sparkContext, net.starts[-1] * 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(places, np.int32)  # a task has fewer symbols
        for x in symbols(batches):
            net.count(sums, *x)
        yield from blocks_of(sums)

    counts = added(rows.filter("NOT tune").mapInArrow(count, PARTIAL), places)
    shared = context.broadcast(Net(net.code, net.tables, counts))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(places + STATES**K, np.int32)
        for x in symbols(batches):
            shared.value.count(sums[:places], *x)
            shared.value.meet(sums[places:], *x)
        yield from blocks_of(sums)

    more = added(rows.filter("tune").mapInArrow(meet, PARTIAL), places + STATES**K)
    shared.unpersist()
    counts += more[:places]
    return Net(net.code, net.tables, counts, fitted(more[places:]))


def word_symbols(vocabulary: Vocabulary, batches: Iterator[pa.RecordBatch]):
    for batch in text_batches(batches):
        symbols, contexts, *_ = vocabulary.symbols_of(Texts(batch.column("text")))
        yield symbols, contexts, None


def byte_symbols(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        start, n = 0, batch.column("n").to_numpy()
        for words in batches_of(batch.column("word").to_pylist()):
            symbols, contexts, first = spelled(words)
            yield symbols, contexts, np.repeat(n[start : start + len(words)], np.diff(first, append=len(symbols))).astype(np.int32)
            start += len(words)


class Speller:
    """log10 of words' probabilities after an escape; as many as CACHED are kept."""

    CACHED = 300_000

    def __init__(self, net: Net):
        self.net, self.known = net, {}

    def __getstate__(self):
        return {"net": self.net, "known": {}}

    def scores(self, words: list[bytes]) -> np.ndarray:
        new = [w for w in set(words) if w not in self.known]
        if len(self.known) + len(new) > self.CACHED:
            self.known, new = {}, list(set(words))
        for part in batches_of(new):
            symbols, contexts, first = spelled(part)
            self.known.update(zip(part, np.add.reduceat(self.net.scores(symbols, contexts), first).tolist(), strict=True))
        return np.fromiter(map(self.known.__getitem__, words), np.float64, len(words))


class Scorer:
    """All that scores texts: vocabulary, both nets, and log10 of the shares of words with codes (0 for the escape)."""

    def __init__(self, vocabulary: Vocabulary, net: Net, speller: Speller, whole: float):
        self.vocabulary, self.net, self.speller = vocabulary, net, speller
        self.base = np.log10((vocabulary.counts + 0.5) / whole)
        self.base[0] = 0.0  # other words are added when they are joined

    def rows(self, texts: Texts) -> tuple[np.ndarray, list, np.ndarray, list[bytes]]:
        """Of texts: (log10 of lines that aren't recalled, base, known, n_tokens, n_bytes) of each; (text, line, times, log10 of all times) of other lines; the texts of words without codes, and those words."""
        symbols, contexts, text, place = self.vocabulary.symbols_of(texts)
        logs = self.net.online_scores(symbols, contexts, text, place)
        rare = np.flatnonzero(symbols == 0)
        words = texts.words.take(pa.array(rare)).to_pylist()
        logs[rare] += self.speller.scores(words)
        sums = np.add.reduceat(logs, np.cumsum(texts.sizes) - texts.sizes)
        first = np.cumsum(texts.n_words) - texts.n_words
        told, seen = sums.take(texts.line_at), {}
        for of, line, total in zip(texts.line_text.tolist(), texts.lines, told.tolist(), strict=True):
            times, so_far = seen.get((of, line), (0, 0.0))
            seen[of, line] = times + 1, so_far + total
        sums[texts.line_at] = 0
        rest = np.bincount(np.repeat(np.arange(len(first)), np.diff(np.searchsorted(np.cumsum(texts.sizes), np.cumsum(texts.n_words)) + 1, prepend=0)), sums, len(first))
        own = np.stack([rest, np.add.reduceat(self.base.take(symbols), first), np.add.reduceat((symbols > 0).astype(np.int64), first), texts.n_words, texts.n_bytes], axis=1)
        return own, [(of, line, times, total) for (of, line), (times, total) in seen.items()], text.take(rare), words


def lm_scores(docs: DataFrame) -> DataFrame:
    """The columns of SCHEMA for every row of docs (doc_id, text).

    held_out: crc32 of the doc_id as text leaves 1 by 5; such rows don't train. A null doc_id counts as empty text, so it
    trains; a null text counts as an empty one, which is its end mark alone. base_score comes from word counts, score
    from the model, both as log10 of the text's probability; bits_per_byte is the model's code length of the words by
    the text's bytes (of an empty text, by one); case and the kinds of white space aren't coded. Rows equal in doc_id and
    text train as often as they occur and get equal scores. Other columns are ignored. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    small_batches(spark)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    held = lambda: F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT
    training = keyed.filter(~held())
    table = checkpointed(word_table(training))
    word = table.withColumn("is_line", F.substring("word", 1, 1) == F.lit(b" "))
    total = lambda where: F.coalesce(F.sum(F.when(where, F.col("n"))), F.lit(0))
    sizes = word.agg(
        total(~F.col("is_line")).alias("words"), F.count_if(~F.col("is_line")).alias("kinds"),
        total(F.col("is_line")).alias("lines"), total(F.col("is_line") & (F.col("n") > 1)).alias("again"),
    ).first()
    ends = training.count()
    tokens, kinds = sizes["words"] + ends, sizes["kinds"] + (ends > 0)
    whole, least = tokens + 0.5 * (kinds + 1), max(LEAST, math.ceil(tokens * FREQUENT))
    coded = word.filter(~F.col("is_line") & (F.col("n") >= least)).select("word", "n").toArrow()
    counts = dict(zip(coded.column("word").to_pylist(), coded.column("n").to_pylist(), strict=True)) | {END: ends}
    vocabulary = Vocabulary(counts, tokens - sum(counts.values()))
    tuned = training.select("text", (F.pmod(F.xxhash64("text"), F.lit(TUNES)) == 0).alias("tune"))
    net = trained(tuned, Net(vocabulary.code, WORD_TABLES), lambda batches: word_symbols(vocabulary, batches))
    rare = word.filter(~F.col("is_line") & (F.col("n") < least)).select("word", "n", (F.pmod(F.xxhash64("word"), F.lit(TUNES)) == 0).alias("tune"))
    speller = trained(rare, Net(byte_code(counts), BYTE_TABLES), byte_symbols)
    shared = spark.sparkContext.broadcast(Scorer(vocabulary, net, Speller(speller), whole))
    names = ["doc_id", "th", "key", "times", "own"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value
        for batch in text_batches(batches):
            own, lines, of_word, words = scorer.rows(Texts(batch.column("text")))
            # A text's own row has a key that meets no other.
            keys = [b"  %d %d" % (th, -1 if i is None else i) for th, i in zip(batch.column("th").to_pylist(), batch.column("doc_id").to_pylist(), strict=True)]
            keys += [line_key(r[1]) for r in lines]
            keys += words
            at = pa.array(np.concatenate([np.arange(len(own)), np.array([r[0] for r in lines], np.int64), of_word]))
            times = pa.array(np.concatenate([np.ones(len(own), np.int32), np.array([r[2] for r in lines], np.int32), np.ones(len(words), np.int32)]))
            upto = np.concatenate([np.arange(len(own) + 1) * own.shape[1], own.size + 1 + np.arange(len(lines))]).astype(np.int32)
            measures = pa.ListArray.from_arrays(pa.array(upto), pa.array(np.concatenate([own.reshape(-1), np.array([r[3] for r in lines])])))
            made = pa.concat_arrays([measures, pa.nulls(len(words), measures.type)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in names[:2]), pa.array(keys, pa.binary()), times, made], names)

    rows = keyed.withColumn("th", F.xxhash64("text")).mapInArrow(of, "doc_id long, th long, key binary, times int, own array<double>")
    joined = rows.join(table.withColumnRenamed("word", "key"), "key", "left")
    n, k, own = F.coalesce("n", F.lit(0)), F.col("times"), lambda i: F.get("own", F.lit(i))
    is_word, is_text = F.col("own").isNull(), F.size("own") > 1
    # So often other training texts hold the line.
    others = n - F.when(held(), 0).otherwise(k)
    share = min(0.99, max(0.01, sizes["again"] / max(1, sizes["lines"])))
    alone = own(0) / k + F.lit(math.log10(1 - share))
    recall = F.log10(F.lit(share) * others / F.lit(float(max(1, sizes["lines"]))))  # null without others
    most = F.greatest(alone, recall)
    both = F.when(others > 0, most + F.log10(F.pow(F.lit(10.0), alone - most) + F.pow(F.lit(10.0), recall - most))).otherwise(alone)
    sums = joined.groupBy("doc_id", "th").agg(
        F.sum(F.when(is_text, own(0)).when(~is_word, k * both)).alias("score"),
        F.sum(F.when(is_text, own(1)).when(is_word, k * F.log10((n + 0.5) / F.lit(float(whole))))).alias("base"),
        F.sum(F.when(is_text, own(2)).when(is_word & (n > 0), k)).alias("known"),
        F.sum(F.when(is_text, own(3))).alias("n_tokens"), F.sum(F.when(is_text, own(4))).alias("n_bytes"), F.count_if(is_text).alias("copies"),
    )
    each = lambda c: F.col(c) / F.col("copies")  # noqa: E731  rows equal in doc_id and text have been added up
    out = sums.select(
        "doc_id", held().alias("held_out"), F.round(each("n_tokens")).cast("long").alias("n_tokens"), F.round(each("known")).cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        each("base").alias("base_score"), each("score").alias("score"), (-each("score") * F.lit(math.log2(10)) / F.greatest(each("n_bytes"), F.lit(1.0))).alias("bits_per_byte"), "copies",
    )
    return out.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("again", "copies")


def op9_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    return lm_scores(read_table(spark, sf_dir, "documents"))
