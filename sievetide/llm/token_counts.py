"""Operator 1: token counts by a compiled finite-state tokenizer.

The vocabulary of a word BPE (a .json file of the tokenizers library) is compiled into a deterministic transducer over
the bytes of a word. A state holds, for every position at which a vocabulary entry may still be growing, the entry's
node in the vocabulary trie, the token that ends at that position and its token count relative to the count so far.
Each transition is annotated with the number of tokens by which it changes the count; the last byte of a word is a
letter of its own, as in the vocabulary, and its transition gives the count that ends the word. States are made
when they are first reached and kept in a bounded table.

That one entry at most fits each position rests on a property of BPE: a sequence of tokens is the encoding of its
text exactly if each two neighbours are the encoding of theirs.

A text is cut into chunks. White space leads the pre-tokenizer to one state from any other, so the state map of a chunk
is its text up to the first white space, the count between, and its text from the last: maps compose in any
bracketing, here as a balanced tree.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import read_table, sliced, small_batches

#: Tables are emptied when they have so many entries, to be filled again by what is met.
MAX_STATES = 100_000
MAX_WORDS = 300_000
MAX_PAIRS = 400_000
CHUNK_CHARS = 1 << 16
MAX_TOKENS = 2048
#: Apostrophe endings that the pre-tokenizer keeps together; fixed values of the vocabulary's pattern.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Controls that Python, but not Unicode's property White_Space, counts as white space.
HELD_BACK = re.compile("[\x1c-\x1f]")
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 as it is, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class CountingTransducer:
    """Counts the tokens of words. end: the mark of a token that ends a word."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        letters = byte_letters()
        self.letter = {b: letters[b] for b in letters}
        self.tokens = list(model["vocab"])
        self.child: list[dict[str, int]] = [{}]
        self.inner, self.final = [-1], [-1]
        for i, token in enumerate(self.tokens):
            ends = token.endswith(self.end) and token != self.end
            node = 0
            for c in token[: -len(self.end)] if ends else token:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.inner.append(-1)
                    self.final.append(-1)
                node = self.child[node][c]
            (self.final if ends else self.inner)[node] = i
        number = {t: i for i, t in enumerate(self.tokens)}
        self.made, self.parts, self.joined = [-1] * len(self.tokens), {}, {}
        for (x, y), rank in self.rank.items():
            a, b, c = number[x], number[y], number[x + y]
            self.made[c], self.parts[c], self.joined[a, b] = rank, (a, b), rank
        self.own: dict[int, bool] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.kinds: dict[str, str] = {}
        self.words: dict[str, int] = {}
        self.empty()

    def empty(self) -> None:
        self.states: list[tuple] = [((0, -1, 0),)]
        self.number = {self.states[0]: 0}
        self.moves: dict[tuple[int, str], tuple[int, int]] = {}
        self.ends: dict[tuple[int, str], int] = {}

    def symbols(self, token: int) -> list[str]:
        """The letters of a token, before any merge."""
        t = self.tokens[token]
        if t.endswith(self.end) and t != self.end:
            t = t[: -len(self.end)]
            return [*t[:-1], t[-1] + self.end]
        return list(t)

    def merged(self, parts: list[str]) -> list[str]:
        """parts after all merges, lowest rank first, leftmost first of equal ones."""
        while len(parts) > 1:
            rank, i = min((self.rank.get(pair, 1 << 60), i) for i, pair in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def whole(self, token: int) -> bool:
        """Whether a token is the encoding of its own text."""
        if token not in self.own:
            self.own[token] = self.merged(self.symbols(token)) == [self.tokens[token]]
        return self.own[token]

    def fit(self, left: int, right: int) -> bool:
        """Whether the two tokens, in this order, are the encoding of their text; left -1: none.

        Undoes merges from the latest on: the pair fails if, at some moment of the merging, the parts that then
        touch have a merge of their own that comes before what they were really merged into.
        """
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) >= MAX_PAIRS:
                self.fits.clear()
            known = self.fits[left, right] = self.whole(right) and (left < 0 or self.apart(left, right))
        return known

    def apart(self, a: int, b: int) -> bool:
        made, parts = self.made, self.parts
        into_a, into_b = 1 << 60, 1 << 60  # ranks of the merges that took in a (as right part) and b (as left part)
        rank_a, rank_b = made[a], made[b]
        while True:
            joint = self.joined.get((a, b))
            # Equal pairs merge from the left: a merge of the same rank goes first if it takes in a, not if it takes in b.
            if joint is not None and joint < into_a and joint <= into_b:
                return False
            if rank_a < 0 and rank_b < 0:
                return True
            if rank_a > rank_b:
                into_a, a = rank_a, parts[a][1]
                rank_a = made[a]
            else:
                into_b, b = rank_b, parts[b][0]
                rank_b = made[b]

    def move(self, state: int, c: str) -> tuple[int, int]:
        """The next state and the change of the count, at a byte that doesn't end the word."""
        grown, token, count = [], -1, 0
        for node, last, behind in self.states[state]:
            node = self.child[node].get(c)
            if node is not None:
                if token < 0 and (t := self.inner[node]) >= 0 and self.fit(last, t):
                    token, count = t, behind + 1
                if self.child[node]:
                    grown.append((node, last, behind))
        new = (*((node, last, behind - count) for node, last, behind in grown), (0, token, 0))
        n = self.number.get(new)
        if n is None:
            n = self.number[new] = len(self.states)
            self.states.append(new)
        self.moves[state, c] = n, count
        return n, count

    def finish(self, state: int, c: str) -> int:
        """The change of the count at the word's last byte."""
        for node, last, behind in self.states[state]:
            node = self.child[node].get(c)
            if node is not None and (t := self.final[node]) >= 0 and self.fit(last, t):
                self.ends[state, c] = behind + 1
                return behind + 1
        raise ValueError(f"no token ends a word with {c!r}")

    def word(self, piece: str) -> int:
        """The tokens of one word of the pre-tokenizer."""
        state, count, letter = 0, 0, self.letter
        code = piece.encode("utf-8", "replace")
        for b in code[:-1]:
            c = letter[b]
            state, more = self.moves.get((state, c)) or self.move(state, c)
            count += more
        c = letter[code[-1]]
        return count + (self.ends.get((state, c)) or self.finish(state, c))

    def kind(self, c: str) -> str:
        """L letter, N number, A apostrophe, P any other."""
        k = self.kinds.get(c)
        if k is None:
            k = self.kinds[c] = "A" if c == "'" else {"L": "L", "N": "N"}.get(unicodedata.category(c)[0], "P")
        return k

    def pieces(self, run: str) -> Iterator[str]:
        """The words of a run without white space: an apostrophe ending, letters, one number, or others."""
        kind, i, n = self.kind, 0, len(run)
        while i < n:
            k, j = kind(run[i]), i + 1
            if k == "A" and (e := next((e for e in ENDINGS if run.startswith(e, j)), "")):
                j += len(e)
            elif k == "L":
                while j < n and kind(run[j]) == "L":
                    j += 1
            elif k != "N":
                while j < n and kind(run[j]) in "AP":
                    j += 1
            yield run[i:j]
            i = j

    def run(self, run: str) -> int:
        """The tokens of a run without white space."""
        count = self.words.get(run)
        if count is None:
            if len(self.states) > MAX_STATES:
                self.empty()
            if len(self.words) > MAX_WORDS:
                self.words.clear()
            count = sum(map(self.word, self.pieces(run)))
            if len(run) <= 64:
                self.words[run] = count
        return count

    def chunk_map(self, chunk: str) -> tuple[str, int, str] | str:
        """The chunk's text to the first white space, the count between, its text after the last; the chunk itself if it has none."""
        runs = chunk.split()
        if not runs:
            return ("", 0, "")
        first, last = "" if chunk[0].isspace() else runs[0], "" if chunk[-1].isspace() else runs[-1]
        if len(runs) == 1 and first and last:
            return chunk
        inner = runs[bool(first) : len(runs) - bool(last)]
        known = self.words.get
        return first, sum(c if (c := known(r)) is not None else self.run(r) for r in inner), last

    def compose(self, a: tuple[str, int, str] | str, b: tuple[str, int, str] | str) -> tuple[str, int, str] | str:
        if isinstance(a, str):
            return a + b if isinstance(b, str) else (a + b[0], b[1], b[2])
        if isinstance(b, str):
            return a[0], a[1], a[2] + b
        return a[0], a[1] + (self.run(a[2] + b[0]) if a[2] or b[0] else 0) + b[1], b[2]

    def plain(self, text: str) -> int:
        """The tokens of a text without special strings."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # the vocabulary's lower case looks at each letter alone
                text = text.replace("Σ", "σ")
        text = text.lower()
        if HELD_BACK.search(text):  # white space to Python, not to the pre-tokenizer
            return sum(self.run(r) for r in SPACE.split(text) if r)
        maps = [self.chunk_map(text[i : i + CHUNK_CHARS]) for i in range(0, len(text), CHUNK_CHARS)]
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        if not maps:
            return 0
        whole = maps[0]
        return self.run(whole) if isinstance(whole, str) else sum(self.run(x) for x in (whole[0], whole[2]) if x) + whole[1]

    def count(self, text: str) -> int:
        """The tokens of a whole text; a special string in it is one token."""
        if "<" not in text:
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


_compiled: dict[str, CountingTransducer] = {}


def transducer(path: str) -> CountingTransducer:
    """One for each worker and file."""
    if path not in _compiled:
        _compiled[path] = CountingTransducer(path)
    return _compiled[path]


def count_tokens(docs: DataFrame, path: str, max_tokens: int = MAX_TOKENS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of docs (doc_id, text), and the columns to keep.

    path: the vocabulary's file, at the same place on every machine. A null text counts as an empty one: no bytes,
    no tokens. A null doc_id stays null; repeated rows give repeated rows; other columns are left out; an empty table
    gives an empty one. No text is cut: a worker holds one Arrow batch and bounded tables.
    """
    small_batches(docs.sparkSession)
    names = ["doc_id", *[c for c in keep if c != "doc_id"]]
    new = ["n_bytes", "n_tokens", "over_limit"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("counted"), *names[1:])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in sliced(batches):
            texts = [x or "" for x in batch.column("counted").to_pylist()]
            tokens = [machine.count(x) for x in texts]
            columns = pa.array([len(x.encode("utf-8")) for x in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > max_tokens for n in tokens], pa.bool_())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *columns], [*names, *new])

    kinds = dict(f.split(" ") for f in SCHEMA.split(", "))
    schema = StructType([rows.schema[c] for c in names])
    for c in new:
        schema = schema.add(c, kinds[c])
    return rows.mapInArrow(of, schema)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents by the word BPE."""
    import public_tokenizers

    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
