"""Operator 6: quality rules with language-specific perplexity bands.

The n-gram model is a modified Kneser-Ney model of order 4 over characters (UTF-16 units, in lower case, with all digits
as one and tabs as spaces), one for each value of lang. Spark counts the 4-grams of all texts, and
from them in how many contexts each shorter n-gram stands, and joins probabilities and back-off weights from the shortest
n-grams up; none is left out. With at most AT_HAND n-grams and contexts the model is two sorted arrays of 64-bit hashes, which
workers search and whose late answers they keep. With more, workers hold the most frequent 4-grams, and each text gets
its other ones' log probabilities by joins with the tables, the same numbers as from the arrays.

Perplexity is that of words: a text's mean over its words, each with the white space behind it. So neither marks that repeat
beside words nor marks between them average out. A language's band lies about the median of its texts' means, each text
counted once however many copies it has, in units of their median absolute deviation: junk moves it little as long as
it is under half of the texts.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import WORD, checkpointed, read_table, sliced, small_batches

ORDER, BITS = 4, 16
#: An n-gram is kept with at least this share of the counts of its order and language: all are.
KEPT = 0
#: As many n-grams and contexts are sent to the workers (12 bytes each); others are joined.
AT_HAND = 4_000_000
#: Characters whose grams are counted at a time; slots, as a power of two, for answers that a worker keeps.
HELD, SLOTS = 4_000_000, 18
#: A text of n words is rejected if its mean log2 probability a word is further from its language's centre than a
#: spreads of texts + b / sqrt(n) standard deviations of single words. Below lie texts of another kind than the
#: language's (foreign, encoded, decorated with marks); above, texts that say little (filled up, lists).
BELOW, ABOVE = (3.0, 3.0), (3.0, 3.0)
#: Parts of a bit in which means and deviations of texts are counted; a spread is this share of the deviation at least.
MEAN_PARTS, DEVIATION_PARTS, LEAST_SPREAD = 64, 16, 0.01
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = re.compile(r"[#*$%&|<>]")
WORDS = re.compile(WORD)
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, perplexity double, kept boolean"
START = "\n" * (ORDER - 1)


def _plain() -> np.ndarray:
    """What each UTF-16 unit counts as."""
    out = np.arange(1 << BITS, dtype=np.uint64)
    for i in range(1 << BITS):
        c = chr(i)
        low = c.lower()
        if "\t" <= c <= "\r" and c != "\n":
            out[i] = 32
        elif unicodedata.category(c) == "Nd":
            out[i] = 48
        elif len(low) == 1:
            out[i] = ord(low)
    return out


_table: list[np.ndarray] = []


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The 4-grams of texts one after the other, as 64 bits each, and how many each text has; three line ends stand before a text."""
    if not _table:
        _table.append(_plain())
    raw = [(START + t).encode("utf-16-le", "surrogatepass") for t in texts]
    size = np.array([len(r) // 2 for r in raw], np.int64)
    s = _table[0].take(np.frombuffer(b"".join(raw), np.uint16))
    g = (s[:-3] << np.uint64(48)) | (s[1:-2] << np.uint64(32)) | (s[2:-1] << np.uint64(16)) | s[3:]
    inside = np.ones(len(g), bool)
    for i in range(ORDER - 1):  # what begins in one text and ends in the next
        inside[np.cumsum(size)[:-1] - 1 - i] = False
    return g[inside], size - (ORDER - 1)


def _summed(g: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Grams with their counts added up."""
    keys, at = np.unique(np.concatenate(g), return_inverse=True)
    return keys, np.bincount(at, np.concatenate(n)).astype(np.int64)


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, k, gram, c: the 4-grams of all texts of docs (text, lang) with how often they occur, and the shorter n-grams with how many characters stand before them."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[str | None, list[str]] = {}
        sums: dict[str | None, tuple[list, list]] = {}
        held = kept = 0

        def count() -> None:
            nonlocal held, kept
            for lang, own in texts.items():
                keys, n = np.unique(grams(own)[0], return_counts=True)
                into = sums.setdefault(lang, ([], []))
                into[0].append(keys)
                into[1].append(n)
                kept += len(keys)
            texts.clear()
            held = 0

        def counted() -> Iterator[pa.RecordBatch]:
            nonlocal kept
            for lang, own in sums.items():
                keys, n = _summed(*own)
                for i in range(0, len(keys), 50_000):
                    m = n[i : i + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(m), pa.string()), pa.array(keys[i : i + 50_000].view(np.int64)), pa.array(m)], ["lang", "gram", "n"])
            sums.clear()
            kept = 0

        for batch in sliced(batches):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                if text:
                    texts.setdefault(lang, []).append(text)
                    held += len(text)
                    if held >= HELD:
                        count()
                        if kept >= 2 * HELD:
                            yield from counted()
        count()
        yield from counted()

    rows = docs.select("text", "lang").mapInArrow(of, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("c"))
    rows = checkpointed(rows.select("lang", F.lit(ORDER).alias("k"), "gram", "c"))
    out, longer = rows, rows
    for k in range(ORDER - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << BITS * k) - 1))
        longer = longer.groupBy("lang", suffix.alias("gram")).agg(F.count("*").alias("c")).select("lang", F.lit(k).alias("k"), "gram", "c")
        out = out.unionAll(longer)
    return out


def gram_hash(lang_no: np.ndarray, k: int, gram: np.ndarray) -> np.ndarray:
    """64-bit hashes of n-grams of order k."""
    x = gram ^ ((lang_no.astype(np.uint64) * np.uint64(8) + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """What is taken off counts of one, two, and three or more, from how many n-grams have counts of one to four."""
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    return [y, min(2.0, max(0.0, 2 - 3 * y * n3 / n2)) if n2 and n3 else y, min(3.0, max(0.0, 3 - 4 * y * n4 / n3)) if n3 and n4 else y]


class Sorted:
    """Sorted 64-bit keys with a number each."""

    def __init__(self, keys: list[np.ndarray], values: list[np.ndarray]):
        keys, values = np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0), *values])
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order].astype(np.float32)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether keys are there, and their numbers."""
        if not len(self.keys):
            return np.zeros(len(h), bool), np.zeros(len(h), np.float32)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return self.keys[at] == h, self.values[at]


class KneserNey:
    """Sorted n-grams with log2 probabilities, sorted contexts with log2 back-off weights; the number of each language, its characters, and its band.

    tables: none if the arrays hold all; else all n-grams and contexts as DataFrames, and the arrays hold frequent 4-grams only.
    """

    def __init__(self, langs: list[str | None], symbols: list[int]):
        self.number, self.symbols = {lang: i for i, lang in enumerate(langs)}, np.array(symbols, np.float64)
        self.grams, self.contexts = Sorted([], []), Sorted([], [])
        #: By language number: the centre, the spread of texts and the deviation of single words.
        self.bands: dict[int, tuple[float, float, float]] = {}
        self.tables: tuple[DataFrame, DataFrame] | None = None
        self.whole = True
        self._keys = self._values = None

    def __getstate__(self):
        return {**self.__dict__, "tables": None, "_keys": None, "_values": None}

    def looked_up(self, lang_no: np.ndarray, gram: np.ndarray, order: int = ORDER) -> np.ndarray:
        """log2 of the probability of the last character of n-grams, with back-off."""
        out, weight, open_ = np.zeros(len(gram)), np.zeros(len(gram)), np.arange(len(gram))
        for k in range(order, 0, -1):
            g, lang = gram[open_] & np.uint64((1 << BITS * k) - 1), lang_no[open_]
            there, log = self.grams.find(gram_hash(lang, k, g))
            out[open_[there]] = weight[open_[there]] + log[there]
            open_, g, lang = open_[~there], g[~there], lang[~there]
            known, back = self.contexts.find(gram_hash(lang, k, g >> np.uint64(BITS)))
            weight[open_] += np.where(known, back, 0)
        out[open_] = weight[open_] - np.log2(self.symbols[lang_no[open_]])
        return out

    def logs(self, lang_no: np.ndarray, gram: np.ndarray) -> np.ndarray:
        """looked_up, with answers kept: a question has one slot, where the last answer stays."""
        if self._keys is None:
            self._keys, self._values = np.zeros(1 << SLOTS, np.uint64), np.zeros(1 << SLOTS, np.float32)
        h = gram_hash(lang_no, ORDER, gram)
        slot = (h >> np.uint64(64 - SLOTS)).astype(np.int64)
        out = self._values.take(slot)
        new = np.flatnonzero(self._keys.take(slot) != h)
        if len(new):
            keys, first, at = np.unique(h[new], return_index=True, return_inverse=True)
            found = self.looked_up(lang_no[new[first]], gram[new[first]]).astype(np.float32)
            self._keys[slot[new[first]]], self._values[slot[new[first]]] = keys, found
            out[new] = found[at]
        return out

    def joined(self, lang_no: np.ndarray, gram: np.ndarray, answers: Sorted) -> np.ndarray:
        """As logs, of 4-grams at hand or in answers."""
        h = gram_hash(lang_no, ORDER, gram)
        there, out = self.grams.find(h)
        found, late = answers.find(h[~there])
        if not found.all():
            raise ValueError("n-grams without an answer")
        out[~there] = late
        return out

    def absent(self, texts: list[str], lang_no: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The 4-grams of texts that the arrays don't have, each once a text: the text's place and the gram."""
        g, n = grams(texts)
        text = np.repeat(np.arange(len(texts)), n)
        out = np.flatnonzero(~self.grams.find(gram_hash(np.array(lang_no).take(text), ORDER, g))[0])
        out = out[np.lexsort((g[out], text[out]))]
        g, text = g[out], text[out]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (text[1:] != text[:-1])
        return text[new], g[new]

    def scores(self, texts: list[str], lang_no: list[int], answers: Sorted | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of texts: the mean of their words' log2 probabilities, its standard deviation, and how many words (white space before the first is one); an empty text has none.

        answers: of the 4-grams that are absent, by their gram_hash.
        """
        mean, deviation, words = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        own = [i for i, t in enumerate(texts) if t]
        if own:
            g, n = grams([texts[i] for i in own])
            lang = np.repeat(np.array([lang_no[i] for i in own]), n)
            x = (self.logs(lang, g) if answers is None else self.joined(lang, g, answers)).astype(np.float64)
            space = lambda unit: (unit == np.uint64(32)) | (unit == np.uint64(10))
            begins = ~space(g & np.uint64(0xFFFF)) & space(g >> np.uint64(BITS) & np.uint64(0xFFFF))
            text = np.cumsum(n) - n
            begins[text] = True
            at = np.flatnonzero(begins)
            word = np.add.reduceat(x, at)
            first = np.searchsorted(at, text)
            k = np.diff(first, append=len(at))
            m = np.add.reduceat(word, first) / k
            mean[own], words[own] = m, k
            deviation[own] = np.sqrt(np.maximum(0.0, np.add.reduceat(np.square(word), first) / k - m**2))
        return mean, deviation, words


def _median(x: np.ndarray, n: np.ndarray) -> float:
    """The least of the values x, n times each, that half of them do not exceed."""
    order = np.argsort(x, kind="stable")
    upto = np.cumsum(n[order])
    return float(x[order][np.searchsorted(upto, upto[-1] / 2)])


def bands(docs: DataFrame, model: KneserNey) -> dict[int, tuple[float, float, float]]:
    """Each language's centre, spread of texts and deviation of words, by texts of MIN_WORDS words or more, copies counted once.

    Texts are counted in cells of both measures, of which a language has a bounded number; only those come to the driver.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kn = shared.value
        for batch in sliced(batches):
            answers = answers_of(batch)
            pairs = [(t, kn.number[lang]) for t, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True) if t and lang in kn.number and len(WORDS.findall(t)) >= MIN_WORDS]
            texts, lang_no = [t for t, _ in pairs], [n for _, n in pairs]
            mean, deviation, _ = kn.scores(texts, lang_no, answers)
            h = [xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts]
            columns = pa.array(lang_no, pa.int32()), pa.array(h, pa.binary()), pa.array(np.rint(mean * MEAN_PARTS).astype(np.int32)), pa.array(np.rint(deviation * DEVIATION_PARTS).astype(np.int32))
            yield pa.RecordBatch.from_arrays(list(columns), ["lang_no", "h", "mean", "deviation"])

    cells = answered(docs.select("text", "lang"), model, shared).mapInArrow(of, "lang_no int, h binary, mean int, deviation int").distinct().groupBy("lang_no", "mean", "deviation").agg(F.count("*").alias("n")).toArrow()
    lang_no, mean, deviation, n = (cells.column(c).to_numpy() for c in ("lang_no", "mean", "deviation", "n"))
    out = {}
    for lang in np.unique(lang_no).tolist():
        own = lang_no == lang
        x, w = mean[own] / MEAN_PARTS, n[own]
        centre, single = _median(x, w), max(1e-3, _median(deviation[own] / DEVIATION_PARTS, w))
        out[lang] = centre, max(1.4826 * _median(np.abs(x - centre), w), LEAST_SPREAD * single), single
    return out


def probabilities(counts: DataFrame, off: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All n-grams (lang_no, k, gram, c, log) and contexts (lang_no, k, context, log): log2 of probabilities and back-off weights.

    counts: lang_no, k, gram, c. off: lang_no, k, d1, d2, d3, symbols: what is taken off counts, and one more than the characters.
    """
    known = counts.join(F.broadcast(off), ["lang_no", "k"]).withColumn("context", F.shiftrightunsigned("gram", BITS))
    known = known.withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
    sums = known.groupBy("lang_no", "k", "context").agg(F.sum("c").alias("total"), F.sum("d").alias("taken"))
    contexts = checkpointed(sums.select("lang_no", "k", "context", "total", F.greatest(F.col("taken") / F.col("total"), F.lit(1e-12)).alias("rest")))
    known = known.join(contexts, ["lang_no", "k", "context"])
    own, made, below = (F.col("c") - F.col("d")) / F.col("total"), [], None
    for k in range(1, ORDER + 1):
        at = known.filter(F.col("k") == k)
        if below is None:
            at = at.withColumn("p", own + F.col("rest") / F.col("symbols"))
        else:
            at = at.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << BITS * (k - 1)) - 1)))
            at = at.join(below, ["lang_no", "suffix"]).withColumn("p", own + F.col("rest") * F.col("shorter"))
        at = checkpointed(at.select("lang_no", "k", "gram", "c", "p"))
        made.append(at.select("lang_no", "k", "gram", "c", F.log2(F.greatest("p", F.lit(1e-30))).alias("log")))
        below = at.select("lang_no", F.col("gram").alias("suffix"), F.col("p").alias("shorter"))
    grams_ = made[0].unionAll(made[1]).unionAll(made[2]).unionAll(made[3])
    return grams_, contexts.select("lang_no", "k", "context", F.log2("rest").alias("log"))


def _sorted(rows: DataFrame, gram: str) -> Sorted:
    """rows (lang_no, k, gram, log) as an array on the driver."""
    got = rows.select("lang_no", "k", gram, F.col("log").cast("float")).toArrow()
    lang_no, k, g, log = (got.column(i).to_numpy() for i in range(4))
    parts = [k == order for order in range(1, ORDER + 1)]
    return Sorted([gram_hash(lang_no[own], i, g[own].view(np.uint64)) for i, own in enumerate(parts, 1)], [log[own] for own in parts])


def answers_of(batch: pa.RecordBatch) -> Sorted | None:
    """What answered has joined to a batch's texts."""
    if "qa_hash" not in batch.schema.names:
        return None
    column = lambda c: batch.column(batch.schema.get_field_index(c)).flatten().to_numpy(zero_copy_only=False)
    keys, first = np.unique(column("qa_hash").view(np.uint64), return_index=True)
    return Sorted([keys], [column("qa_log")[first]])


def answered(docs: DataFrame, model: KneserNey, shared) -> DataFrame:
    """docs (text, lang and others) as they are if model, shared as a broadcast, is whole; else with qa_hash and qa_log: hashes and log2 probabilities of the 4-grams of the text that the model hasn't at hand.

    Texts meet their answers by a hash; texts that share one get each other's answers too, which does no harm.
    """
    if model.whole:
        return docs
    docs = docs.toDF(*[c if c in ("text", "lang") else f"own_{i}" for i, c in enumerate(docs.columns)])  # no name that is given here
    key = F.xxhash64("text", "lang")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kn = shared.value
        for batch in sliced(batches):
            rows = [(t, kn.number[lang], i) for i, (t, lang) in enumerate(zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True)) if t and lang in kn.number]
            if rows:
                texts, lang_no, at = zip(*rows, strict=True)
                text, g = kn.absent(list(texts), list(lang_no))
                own = np.array(lang_no).take(text)
                columns = batch.column("qa_key").take(pa.array(np.array(at).take(text))), pa.array(own.astype(np.int32)), pa.array(g.view(np.int64)), pa.array(gram_hash(own, ORDER, g).view(np.int64))
                yield pa.RecordBatch.from_arrays(list(columns), ["qa_key", "lang_no", "gram", "h"])

    absent = checkpointed(docs.select("text", "lang", key.alias("qa_key")).mapInArrow(of, "qa_key long, lang_no int, gram long, h long").distinct())
    all_grams, contexts = model.tables
    asked = absent.select("lang_no", "gram", "h").distinct()
    log, weight = F.lit(None).cast("double"), F.lit(0.0)
    for k in range(ORDER, 0, -1):
        suffix = F.col("gram") if k == ORDER else F.col("gram").bitwiseAND(F.lit((1 << BITS * k) - 1))
        asked = asked.withColumns({f"g{k}": suffix, f"c{k}": F.shiftrightunsigned(suffix, BITS)})
        asked = asked.join(all_grams.filter(F.col("k") == k).select("lang_no", F.col("gram").alias(f"g{k}"), F.col("log").alias(f"p{k}")), ["lang_no", f"g{k}"], "left")
        asked = asked.join(contexts.filter(F.col("k") == k).select("lang_no", F.col("context").alias(f"c{k}"), F.col("log").alias(f"w{k}")), ["lang_no", f"c{k}"], "left")
        log = F.coalesce(log, weight + F.col(f"p{k}"))
        weight = weight + F.coalesce(f"w{k}", F.lit(0.0))
    symbols = F.element_at(F.array(*[F.lit(float(x)) for x in model.symbols]), F.col("lang_no") + 1)
    found = asked.select("h", F.coalesce(log, weight - F.log2(symbols)).alias("log"))
    answers = absent.join(found, "h").groupBy("qa_key").agg(F.collect_list(F.struct("h", "log")).alias("qa"))
    return docs.withColumn("qa_key", key).join(answers, "qa_key", "left").withColumns({"qa_hash": F.col("qa.h"), "qa_log": F.col("qa.log")}).drop("qa_key", "qa")


def train(docs: DataFrame) -> KneserNey:
    """The model of all texts of docs, with bands. At most AT_HAND n-grams and contexts come to the driver, whatever the corpus; the model has the others in tables."""
    counts = checkpointed(count_grams(docs))
    stats = counts.groupBy("lang", "k").agg(F.count("*").alias("kinds"), *[F.count_if(F.col("c") == i).alias(f"n{i}") for i in range(1, 5)]).collect()
    langs = sorted({r.lang for r in stats}, key=lambda x: (x is not None, x or ""))
    number = {lang: i for i, lang in enumerate(langs)}
    model = KneserNey(langs, [next((r.kinds for r in stats if r.k == 1 and r.lang == lang), 0) + 1 for lang in langs])
    rows = [(r.lang, number[r.lang], r.k, *discounts(r.n1, r.n2, r.n3, r.n4), float(model.symbols[number[r.lang]])) for r in stats]
    # A row for each language and order.
    off = docs.sparkSession.createDataFrame(rows, "of_lang string, lang_no int, k int, d1 double, d2 double, d3 double, symbols double")
    numbers = off.select("of_lang", "lang_no").distinct()
    counts = counts.join(F.broadcast(numbers), F.col("lang").eqNullSafe(F.col("of_lang"))).select("lang_no", "k", "gram", "c")
    all_grams, contexts = probabilities(counts, off.drop("of_lang"))
    model.whole = sum(r.kinds for r in stats) + contexts.count() <= AT_HAND
    if model.whole:
        model.grams, model.contexts = _sorted(all_grams, "gram"), _sorted(contexts, "context")
    else:
        model.tables = all_grams, contexts
        longest = all_grams.filter(F.col("k") == ORDER)
        least, most = 1, AT_HAND
        # The least power of two that few enough counts reach.
        for r in longest.groupBy(F.floor(F.log2("c")).alias("power")).agg(F.count("*").alias("n")).orderBy(F.desc("power")).collect():
            most -= r.n
            if most < 0:
                least = 2 ** (r.power + 1)
                break
        model.grams = _sorted(longest.filter(F.col("c") >= least), "gram")
    model.bands = bands(docs, model)
    return model


def base_measures(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = WORDS.findall(text)
    n = len(words)
    lines: set[str] = set()
    dup = 0
    if "\n" in text:
        for line in text.split("\n"):
            if line in lines:
                dup += 1
            elif WORDS.search(line):
                lines.add(line)
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            times = Counter(windows)
            end = 0  # words before this one are counted
            for i, w in enumerate(windows):
                if times[w] > 1:
                    repeated += i + 3 - max(i, end)
                    end = i + 3
    return n, sum(map(len, words)), len(SYMBOLS.findall(text)), dup, repeated


def judge(docs: DataFrame, model: KneserNey | None = None, below: tuple[float, float] = BELOW, above: tuple[float, float] = ABOVE) -> DataFrame:
    """docs with the columns of SCHEMA; columns of docs with the same names, in whatever case, are replaced.

    A text fails the base rules with fewer than MIN_WORDS words, or if over half of its words stand in windows of three
    words that the text holds twice. It is kept if it passes them and its mean log2 probability lies in its
    language's band. Null texts count as empty ones: no words, so they fail. Each value of lang, null too, has a
    model and a band of its own; a language that the model has no text of is not judged by it, and its perplexity is null.
    Repeated rows get equal verdicts; an empty table gives an empty one. Whole texts are read, row by row.
    model: one that was trained before; by default all of docs trains it.
    """
    small_batches(docs.sparkSession)
    model = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = [f.split(" ")[0] for f in SCHEMA.split(", ")]
    rest = docs.select(*[c for c in docs.columns if c.lower() not in new])
    names, n_own = [*rest.columns, *new], len(rest.columns)
    text_at, lang_at = rest.columns.index("text"), rest.columns.index("lang")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kn = shared.value
        for batch in sliced(batches):
            texts, numbers = [t or "" for t in batch.column(text_at).to_pylist()], [kn.number.get(x) for x in batch.column(lang_at).to_pylist()]
            means, _, sizes = kn.scores([t if no is not None else "" for t, no in zip(texts, numbers, strict=True)], [no or 0 for no in numbers], answers_of(batch))
            rows = []
            for text, no, mean, size in zip(texts, numbers, means.tolist(), sizes.tolist(), strict=True):
                n, *measures, repeated = base_measures(text)
                failed = n < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * n
                inside = no not in kn.bands
                if not inside:
                    centre, spread, single = kn.bands[no]
                    off, single = mean - centre, single / max(1, size) ** 0.5
                    inside = -below[0] * spread - below[1] * single <= off <= above[0] * spread + above[1] * single
                rows.append((n, *measures, repeated, failed, None if no is None else 2.0**-mean, bool(inside and not failed)))
            columns = zip(*rows, strict=True) if rows else [()] * len(new)
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_own], *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names)

    fields = StructType(rest.schema.fields.copy())
    for f in SCHEMA.split(", "):
        fields = fields.add(*f.split(" "))
    return answered(rest, model, shared).mapInArrow(of, fields)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of all documents."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return judge(docs).drop("text", "lang")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs: texts that are null, empty or shorter than MIN_WORDS words go, repeated rows stay or go together."""
    own = [c if c in ("text", "lang") else f"qk_{i}" for i, c in enumerate(docs.columns)]  # no name that judge gives
    return judge(docs.toDF(*own)).filter("kept").select(*own).toDF(*docs.columns)
