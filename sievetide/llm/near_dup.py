"""Operator 7: near-duplicate classes by BagMinHash over multisets of five-word shingles.

Each shingle carries Poisson processes over the discretised axis of its weight, one for each dyadic interval: [0, 1),
[1, 2), [2, 4), [4, 8) and so on, with a rate equal to the interval's length. A point falls on one of SIZE registers and
on one step of its interval; it counts if the step lies below the shingle's weight. A register keeps the least
point, so two multisets agree in a register with a probability of exactly their weighted Jaccard similarity.
Points of a process come in ascending order and end when they exceed all registers of the text.

Registers form bands; texts that share a band meet in a bucket. Every member is verified against one member of the
bucket, in large buckets against three. The texts in buckets that then still hold several components go through an exact join: two of them can be similar enough only if they share one of
their rarest shingles, a fifth of each text's. So common passages bring no pairs, and of the pairs of one component
none is looked at again. Verification counts the shared shingles of whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, checkpointed, fenced, key_text, read_table, sliced, small_batches

WORDS = re.compile(WORD)
SHINGLE = 5
SIMILARITY = 0.8
#: A pair at the limit of 0.8 shares none of 32 bands of 6 registers with a probability of 6e-5, one at 0.9 of 4e-11.
BANDS, ROWS = 32, 6
SIZE = BANDS * ROWS
#: Shingles hashed at a time, points drawn at a time, words kept with their hashes.
BLOCK, DRAWS, MEMO = 100_000, 150_000, 50_000
#: Members that the others of a bucket are held against, all of them in buckets of at least CROWD.
PIVOTS, CROWD = 3, 8
#: Cells of the table that orders shingles by how many texts have them.
CELLS = 1 << 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of the SplitMix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Memo(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        return h


_memo = _Memo()


def shingle_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each shingle; a text of fewer words is one shingle, also if it has none."""
    words = np.array([_memo[w] for w in WORDS.findall(text)], np.uint64)
    n = max(1, len(words) - SHINGLE + 1)
    out = np.full(n, np.uint64(min(len(words), SHINGLE)), np.uint64)
    for j in range(min(SHINGLE, len(words))):
        out = (out + words[j : j + n]) * (GOLDEN + np.uint64(2 * j * 0x51ED27))
    return mixed(out)


def signatures(texts: list[np.ndarray]) -> np.ndarray:
    """BagMinHash registers (texts, SIZE) of multisets, given as shingle hashes with repeats."""
    d = len(texts)
    h = np.full(d * SIZE, np.inf)
    doc = np.repeat(np.arange(d), [len(t) for t in texts])
    element = np.concatenate(texts) if texts else np.zeros(0, np.uint64)
    order = np.lexsort((element, doc))
    doc, element = doc[order], element[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (element[1:] != element[:-1])])) if len(doc) else np.zeros(0, np.int64)
    weight = np.diff(np.concatenate([first, [len(doc)]]))
    doc, element = doc[first], element[first]
    parts = []
    k = 0
    while True:  # interval k: from 2**(k-1), or 0, up to 2**k
        low = 0 if k == 0 else 1 << (k - 1)
        at = np.flatnonzero(weight > low)
        if not len(at):
            break
        parts.append((doc[at], mixed(element[at] + np.uint64(int(GOLDEN) * (k + 1) & (1 << 64) - 1)), np.full(len(at), max(1, low), np.float64), weight[at] - low))
        k += 1
    doc, seed, rate, room = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 4
    x, drawn = np.zeros(len(doc)), 0
    while len(doc):
        c = max(1, min(64, DRAWS // len(doc)))
        i = np.arange(drawn + 1, drawn + c + 1, dtype=np.uint64) * GOLDEN
        a = mixed(seed[:, None] + i)
        b = mixed(a ^ GOLDEN)
        points = -np.log(((a >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate[:, None]
        # Summed one after the other from the first point on, so that c, and with it the other texts, plays no part.
        points[:, 0] += x
        np.cumsum(points, axis=1, out=points)
        register = ((b >> np.uint64(32)) * np.uint64(SIZE) >> np.uint64(32)).astype(np.int64)
        step = (b & np.uint64(0xFFFFFFFF)).astype(np.int64) & (rate.astype(np.int64) - 1)[:, None]
        counts = step < room[:, None]
        np.minimum.at(h, ((doc * SIZE)[:, None] + register)[counts], points[counts])
        x, drawn = points[:, -1], drawn + c
        own, back = np.unique(doc, return_inverse=True)
        alive = x < h.reshape(d, SIZE)[own].max(axis=1)[back]
        doc, seed, rate, room, x = doc[alive], seed[alive], rate[alive], room[alive], x[alive]
    return h.reshape(d, SIZE)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each band, different from band to band: (texts, BANDS)."""
    bits = registers.view(np.uint64).reshape(len(registers), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * GOLDEN, bits.shape[:2])
    for j in range(ROWS):
        out = mixed(out ^ bits[:, :, j]) + GOLDEN
    return out.view(np.int64)


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, node, size, bands of docs (doc_id, node, text); size is the number of shingles."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column("text").to_pylist()
            start = 0
            while start < len(texts):
                block, total = [], 0
                while start + len(block) < len(texts) and (not block or total < BLOCK):
                    block.append(shingle_hashes(texts[start + len(block)] or ""))
                    total += len(block[-1])
                keys = band_keys(signatures(block))
                part = batch.slice(start, len(block))
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("node"), pa.array([len(b) for b in block], pa.int64()), bands], ["doc_id", "node", "size", "bands"])
                start += len(block)

    return docs.mapInArrow(of, "doc_id long, node binary, size long, bands array<long>")


def overlap(a: str, b: str, memo: dict[str, Counter] | None = None) -> float:
    """Jaccard similarity of the multisets of shingles themselves."""

    def bag(text: str) -> Counter:
        if memo is not None and text in memo:
            return memo[text]
        w = WORDS.findall(text)
        out = Counter(zip(*(w[j:] for j in range(SHINGLE)), strict=False)) if len(w) >= SHINGLE else Counter([tuple(w)])
        if memo is not None:
            if len(memo) >= 2:
                memo.pop(next(iter(memo)))
            memo[text] = out
        return out

    x, y = bag(a), bag(b)
    if len(x) > len(y):
        x, y = y, x
    shared = sum(min(n, y[k]) for k, n in x.items() if k in y)
    return shared / (sum(x.values()) + sum(y.values()) - shared)


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts (node, text; one row a node) are similar enough, written to the checkpoint folder."""
    needed = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    texts = checkpointed(texts.join(needed, "node", "left_semi"))
    joined = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, Counter] = {}
        for batch in sliced(batches):
            hit = [overlap(x, y, memo) >= similarity for x, y in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True)]
            out = batch.select(["a", "b"])
            yield out.filter(pa.array(hit, pa.bool_()))

    return checkpointed(joined.mapInArrow(of, "a binary, b binary"))


def elements(text: str) -> np.ndarray:
    """The shingles of a text as a set: a shingle's second, third ... time is an element of its own."""
    h = np.sort(shingle_hashes(text))
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    time = np.arange(len(h)) - np.repeat(start, np.diff(np.concatenate([start, [len(h)]])))
    return mixed(h + time.astype(np.uint64) * GOLDEN)


def _sharing(nodes: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes (node, size, label) with different labels that can be similar enough: by prefix filtering.

    Elements are ordered by the number of texts in their cell of a table, then by hash; any order that is the same for all
    texts would do. Of a text with n elements the first n - ceil(similarity * n) + 1 are its prefix; two similar
    texts share an element of their prefixes. From the first one that they share on, both must have as many elements as
    such a pair has in common. What one text alone has is left out.
    """
    own = checkpointed(texts.join(nodes, "node"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(CELLS, np.int64)
        for batch in sliced(batches):
            for text in batch.column("text").to_pylist():
                np.add.at(sums, (elements(text) >> np.uint64(44)).astype(np.int64), np.int64(1))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["cell", "n"])

    cells = own.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(CELLS, np.int64)
    table[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    shared = nodes.sparkSession.sparkContext.broadcast(table)

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            at, out, places = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                e = elements(text)
                times = shared.value[(e >> np.uint64(44)).astype(np.int64)]
                first = np.lexsort((e, times))[: len(e) - int(np.ceil(similarity * len(e) - 1e-9)) + 1]
                place = np.flatnonzero(times[first] > 1)
                first = first[place]
                places.append(place)
                at.append(np.full(len(first), i))
                out.append(e[first])
            picked = pa.array(np.concatenate(at) if at else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(picked) for c in ("node", "size", "label")), pa.array((np.concatenate(out) if out else np.zeros(0, np.uint64)).view(np.int64)), pa.array(np.concatenate(places) if places else np.zeros(0, np.int64))], ["node", "size", "label", "element", "place"])

    rows = checkpointed(own.select("node", "size", "label", "text").mapInArrow(prefix, "node binary, size long, label binary, element long, place long"))
    mixed_ = rows.groupBy("element").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x != y").select("element")
    rows = rows.join(mixed_, "element", "left_semi")
    other = rows.select("element", *[F.col(c).alias(f"{c}_b") for c in ("node", "size", "label", "place")])
    common = F.lit(similarity / (1 + similarity)) * (F.col("size") + F.col("size_b")) - F.lit(1e-6)
    left = F.least(F.col("size") - F.col("place"), F.col("size_b") - F.col("place_b"))
    met = (rows["element"] == other["element"]) & (F.col("label") < F.col("label_b")) & (left >= common)
    return checkpointed(rows.join(other, met).select(F.col("node").alias("a"), F.col("node_b").alias("b")).distinct())


def components(edges: DataFrame) -> DataFrame:
    """node, label: each node of edges (a, b) with the least node of its component.

    Alternating stars: every node ties its larger neighbours, then its smaller ones, to the least of all, until nothing
    changes: O(log n) rounds, each of them written to the checkpoint folder.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    state = None
    while True:
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # The least ones are dealt once more, so that the joins read plain shuffles, of which Spark can split a hub's neighbours.
        dealt = lambda least: least.repartition(F.xxhash64("a"))
        least = dealt(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = dealt(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = checkpointed(small.filter("a != b").distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
        state = now


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, node (MD5 of the text) and label (a node) for every row of docs (doc_id, text).

    Rows with one label are one class: their texts are linked by pairs of at least the similarity. Null texts count as
    empty ones; texts without words are one class; a text of fewer than five words is one shingle. Equal texts
    share a node whatever their doc_ids, null ones included. Other columns are ignored; an empty table gives an
    empty one. The bands can miss a pair at the very limit with a probability of 6e-5; see BANDS.
    """
    small_batches(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumn("node", F.unhex(F.md5("text")))
    signed = checkpointed(_signed(keyed))
    nodes = signed.groupBy("node").agg(F.first("size").alias("size"), F.first("bands").alias("bands"))
    banded = nodes.select("node", "size", F.explode("bands").alias("band"))
    # The members that others are held against: the least in each of several orders, which buckets share.
    least = [F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("h"), "node", "size")).alias(f"p{k}") for k in range(PIVOTS)]
    buckets = banded.groupBy("band").agg(F.count("*").alias("n"), *least).filter("n > 1")
    met = checkpointed(banded.join(buckets, "band"))
    near = lambda x, y: F.least(x, y) >= F.lit(similarity) * F.greatest(x, y)
    # The one pass that moves texts of the whole table; later ones move those of buckets with several members.
    # Copies are combined before the shuffle.
    texts = keyed.groupBy("node").agg(F.first("text").alias("text"))
    texts = checkpointed(texts.join(met.select("node").distinct(), "node", "left_semi"))

    def against(k: int) -> DataFrame:
        b, size = F.col(f"p{k}.node"), F.col(f"p{k}.size")
        own = (F.col("node") != b) & near(F.col("size"), size)
        # A small bucket has one such member; whatever that leaves apart is joined below.
        return met.filter(own if k == 0 else own & (F.col("n") >= CROWD)).select(F.greatest("node", b).alias("a"), F.least("node", b).alias("b"))

    pairs = reduce(DataFrame.unionAll, map(against, range(PIVOTS))).distinct()
    links = _verified(checkpointed(pairs), texts, similarity)
    labels = components(links)
    # Buckets whose members are not of one component yet: what those members don't link may be linked otherwise.
    members = met.select("band", "node", "size").join(labels, "node", "left").select("band", "node", "size", F.coalesce("label", "node").alias("label"))
    split = members.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x != y").select("band")
    rest = members.join(split, "band", "left_semi").select("node", "size", "label").distinct()
    more = _verified(_sharing(checkpointed(rest), texts, similarity), texts, similarity)
    rows = signed.select("doc_id", "node").join(labels, "node", "left").select("doc_id", "node", F.coalesce("label", "node").alias("label"))
    if more.isEmpty():
        return rows
    # What was found last ties whole components: they are the nodes of a second, smaller graph.
    for c in ("a", "b"):
        more = more.join(labels.toDF(c, "own"), c, "left").withColumn(c, F.coalesce("own", c)).drop("own")
    top = components(checkpointed(more.filter("a != b").distinct())).toDF("label", "top")
    return rows.join(top, "label", "left").select("doc_id", "node", F.coalesce("top", "label").alias("label"))


def op7_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's class: the least doc_id in it, and how many documents it has."""
    rows = checkpointed(near_duplicates(read_table(spark, sf_dir, "documents")))
    # Written, so that the join reads plain shuffles on both sides, of which Spark can split the rows of a large class.
    classes = checkpointed(rows.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")))
    return rows.join(classes, "label").select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class: that with the least doc_id (nulls last), then the least MD5; of repeated rows one."""
    rows = near_duplicates(docs, similarity)
    chosen = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("k"))
    place = key_text(F.col("k.doc_id"), F.lower(F.hex("k.node")))
    own, name = fenced(docs)
    keyed = own.withColumn("place", key_text(F.col(name["doc_id"]), F.md5(F.coalesce(F.col(name["text"]), F.lit("")))))
    kept = keyed.join(checkpointed(chosen.select(place.alias("place"))), "place", "left_semi")
    kept = kept.withColumn("row", F.row_number().over(W.partitionBy("place").orderBy(F.lit(0)))).filter("row = 1")
    return kept.select(*[F.col(name[c]).alias(c) for c in docs.columns])
