"""Problem 6: near-duplicate texts by improved consistent weighted sampling.

A text is its bag of words (runs of letters and digits, case aside); as texts count as
similar in whatever order their sentences come, a shingle is one word here.  Words are
weighted by TF-IDF, the IDF scaled to 1 ... ``HEAVIEST``: were rare words heavier, two texts that
share 85 % of their words, but not the rare ones, would have next to no weight in common.
So a pair at ``THRESHOLD`` has a weighted Jaccard similarity of at least
0.85 / (0.85 + 0.3 * HEAVIEST) = 0.730, at which the bands find it with 0.990.  ``SAMPLES`` consistent samples of the weighted bag are drawn (two texts
agree in one with the probability of their weighted Jaccard similarity) and banded by
``ROWS``; texts that share a band are candidates, but for those whose parity sketches differ in
more bits than the bags of a similar pair can differ in words (this loses none).  Each
candidate pair is verified by the weighted Jaccard similarity of its whole TF-IDF bags: a pair
below the least one that a pair at ``THRESHOLD`` can have is rejected.  Of the rest the share
of common words in the longer text is taken, which TESTDATA.md asks for.

Document frequencies are counted over all texts.  Those of words in fewer than ``RARE`` of
the texts are not shipped to the workers: they get the weight of that share, so the table of
weights has at most (words a text) / RARE entries.  Where texts are so long that these are
more than ``TABLE``, the share is raised until they fit; as all weights lie in 1 ...
``HEAVIEST``, what a pair at the threshold has in common, and by that the chance to find it,
stays the same.  As rare words all weigh the same, their random variables come from a pool
of ``POOL`` rows by the word's hash; the samples themselves name the word, so words of one
pool row are not confused.

Hot groups: texts with the same bag are one class, so copies cost one representative, not
pairs; members come back by a join when pairs are asked for.  Bands that very many classes
share are found on a sample of the classes and split into blocks, each of which meets the
whole band in a task of its own; the pairs stream through the join.  The sample decides only
where the work is done.  Nothing is capped.

Null texts and texts without words give no row.  Ties and repeated rows fall into one class.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CACHE, Counts, bounded_rows, map_rows, shared_checkpoint, table

THRESHOLD = 0.85
ROWS, BANDS = 5, 20
SAMPLES = ROWS * BANDS
RARE = 1e-3
HEAVIEST = 1.05
SKETCH = 128
POOL = 4096
TABLE = 2_000_000
#: Classes of a block of a hot band; one class in SAMPLED is looked at to find such bands.
BLOCK, SAMPLED = 4096, 64
#: An occurrence is a 32-bit hash whose last LEVEL_BITS hold the word's weight in steps.
LEVEL_BITS = 4
LEVELS = (1 << LEVEL_BITS) - 1
WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def document_frequencies(texts: DataFrame) -> DataFrame:
    """(word, n): texts that hold a word, added up in the tasks first; the word '' counts the texts."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def make() -> Callable:
        counts = Counts()

        def rows() -> dict[str, list]:
            items = counts.drain()
            return {"word": [w for w, _ in items], "n": [n for _, n in items]}

        def one(c: dict[str, list]) -> dict[str, list] | None:
            if not c:
                return rows()
            for t in c["text"]:
                found = set(words(t))
                if found:
                    found.add("")
                counts.add(found)
            return rows() if counts.full else None

        return one

    return map_rows(texts.select("text"), make, schema, "word string, n bigint", after=lambda one: one({})).groupBy("word").agg(F.sum("n").alias("n"))


class Sampler:
    """Consistent samples of weighted bags."""

    def __init__(self, weights: dict[str, float], rare: float, samples: int = SAMPLES) -> None:
        self.weights, self.rare, self.samples = weights, rare, samples
        step = lambda w: round((w - 1) / (HEAVIEST - 1) * LEVELS)
        self.level = {w: step(x) for w, x in weights.items()}
        self.rare_level = step(rare)
        self.rank = np.empty((POOL + 1024, samples), np.float32)  # -ln a: the largest is drawn
        self.step = np.empty((POOL + 1024, samples), np.int16)  # t of each sample
        for k in range(POOL):
            self._fill(k, k, math.log(rare))
        self.used = POOL
        self.common: dict[tuple[str, int], int] = {}
        self.hash: dict[str, int] = {}
        self.salt = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xC4CEB9FE1A85EC53)
        self.mix = np.array([[pow(0x9E3779B97F4A7C15, j + 1, 1 << 64)] for j in range(ROWS)], np.uint64)

    def _fill(self, k: int, seed: int, log_weight: float) -> None:
        u = np.random.Generator(np.random.Philox(key=seed)).random((5, self.samples))
        r = -np.log(u[0] * u[1] + 1e-300)  # Gamma(2, 1)
        log_c = np.log(-np.log(u[2] * u[3] + 1e-300))
        t = np.floor(log_weight / r + u[4])
        self.rank[k] = -(log_c - r * (t - u[4]) - r)
        self.step[k] = np.clip(t, -32768, 32767)

    def word_hash(self, word: str) -> int:
        got = self.hash.get(word)
        if got is None:
            if len(self.hash) > CACHE:
                self.hash.clear()
            got = self.hash[word] = xxhash.xxh64_intdigest(word, 7)
        return got

    def row(self, word: str, n: int, h: int) -> int:
        """Row of the tables for a word that occurs n times; rare words that occur once share the pool."""
        if n == 1 and word not in self.weights:
            return h % POOL
        got = self.common.get((word, n))
        if got is None:
            if self.used >= len(self.rank):
                if self.used > 40_000:
                    self.common.clear()
                    self.used = POOL
                else:
                    self.rank = np.concatenate([self.rank, np.empty_like(self.rank)])
                    self.step = np.concatenate([self.step, np.empty_like(self.step)])
            got = self.common[(word, n)] = self.used
            self.used += 1
            self._fill(got, h, math.log(self.weights.get(word, self.rare) * n))
        return got

    def bag(self, found: list[str]) -> tuple[dict[str, int], list[int], list[int]]:
        """Counts, the hashes of the distinct words, and every (word, occurrence) as a hash with the word's weight."""
        bag: dict[str, int] = {}
        for w in found:
            bag[w] = bag.get(w, 0) + 1
        hashes = [self.word_hash(w) for w in bag]
        levels = [self.level.get(w, self.rare_level) for w in bag]
        occurrences = [((h >> 32) & ~LEVELS | x) - (1 << 31) for h, x in zip(hashes, levels, strict=True)]
        if len(found) > len(bag):
            for (_, n), h, x in zip(bag.items(), hashes, levels, strict=True):
                for k in range(1, n):
                    occurrences.append(((h * (2 * k + 1) >> 32) & 0xFFFFFFFF & ~LEVELS | x) - (1 << 31))
        return bag, hashes, occurrences

    def bands(self, bag: dict[str, int], hashes: list[int]) -> list[int]:
        """One 64-bit key a band."""
        # In the order of hashes: words of one pool row tie, and the same one must win in any order of sentences.
        named = np.array(hashes, np.uint64)
        order = named.argsort()
        named = named[order]
        rows = np.array([self.row(w, n, h) for (w, n), h in zip(bag.items(), hashes, strict=True)])[order]
        best = self.rank[rows].argmax(0)
        t = self.step[rows[best], np.arange(self.samples)].astype(np.uint64)
        keys = (named[best] + t * np.uint64(0xD6E8FEB86659FD93)).reshape(BANDS, ROWS)
        keys ^= keys >> np.uint64(31)
        h = (keys.T * self.mix).sum(0, dtype=np.uint64) + self.salt
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(32))).view(np.int64).tolist()


def sketch(occurrences: list[int]) -> tuple[int, int]:
    """Parities of the number of words in ``SKETCH`` buckets: a word more or less changes one bit, so bags differ in at least as many words as sketches in bits."""
    parity = np.bincount((np.array(occurrences) >> LEVEL_BITS) & (SKETCH - 1), minlength=SKETCH) & 1
    return tuple(np.packbits(parity.astype(np.uint8)).view(np.int64).tolist())


def bag_key(found: list[str]) -> int:
    return struct.unpack("<q", hashlib.blake2b("\x00".join(sorted(found)).encode(), digest_size=8).digest())[0]


def signatures(texts: DataFrame, weights: dict[str, float], rare: float) -> DataFrame:
    """(bag, chunk_id, size, words, bands, s0, s1) of each text: its class, number of words, occurrence hashes, band keys and sketch.

    The words, bands and sketch of a class that the same task has met before are left out (null).
    """
    shared = texts.sparkSession.sparkContext.broadcast((weights, rare))
    schema = pa.schema([("bag", pa.int64()), ("chunk_id", pa.string()), ("size", pa.int32()), ("words", pa.list_(pa.int32())), ("bands", pa.list_(pa.int64())), ("s0", pa.int64()), ("s1", pa.int64())])

    def make() -> Callable:
        sampler = Sampler(*shared.value)
        met: set[int] = set()

        def one(c: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {n: [] for n in schema.names}
            for i, t in zip(c["chunk_id"], c["text"], strict=True):
                found = words(t)
                if not found:
                    continue
                key = bag_key(found)
                out["bag"].append(key)
                out["chunk_id"].append(i)
                out["size"].append(len(found))
                if key in met:
                    out["words"].append(None)
                    out["bands"].append(None)
                    out["s0"].append(None)
                    out["s1"].append(None)
                    continue
                if len(met) > CACHE:
                    met.clear()
                met.add(key)
                bag, hashes, occurrences = sampler.bag(found)
                out["words"].append(occurrences)
                out["bands"].append(sampler.bands(bag, hashes))
                s0, s1 = sketch(occurrences)
                out["s0"].append(s0)
                out["s1"].append(s1)
            return out

        return one

    return map_rows(texts.select("chunk_id", "text"), make, schema, "bag bigint, chunk_id string, size int, words array<int>, bands array<bigint>, s0 bigint, s1 bigint")


def weight(occurrences: Column) -> Column:
    """The weight of a bag (an array of occurrences)."""
    levels = F.aggregate(occurrences, F.lit(0), lambda total, x: total + x.bitwiseAND(F.lit(LEVELS)))
    return F.size(occurrences) + levels * F.lit((HEAVIEST - 1) / LEVELS)


def banded(reps: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """((band, bag, size, s0, s1), (band, block, own, bag, size, s0, s1)): the classes of the bands, and apart from them those of hot bands, if there are any.

    A class of a hot band comes once a block of it, ``own`` in the block that it belongs to.
    """
    keys = reps.select(F.explode("bands").alias("band"), "bag", "size", "s0", "s1")
    hot = shared_checkpoint(
        reps.filter(F.pmod("bag", F.lit(SAMPLED)) == 0).select(F.explode("bands").alias("band")).groupBy("band").agg((F.count(F.lit(1)) * SAMPLED).alias("n"))
        .filter(F.col("n") > BLOCK).select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    )
    # The keys are shuffled once: hot bands are counted, and joined by a broadcast unless they are too many for it.
    found = hot.count()
    if not found:
        return keys, None
    held = F.broadcast(hot) if found <= TABLE else hot
    split = keys.join(held, "band").withColumn("mine", F.pmod(F.xxhash64("bag"), F.col("blocks")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return keys.join(held, "band", "left_anti"), split.select("band", "block", (F.col("block") == F.col("mine")).alias("own"), "bag", "size", "s0", "s1")


def candidates(keys: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """(a, b): classes that share a band (and block) and could be similar.  One exchange serves the distinct and both sides of the join."""
    once = keys.repartition(*by).dropDuplicates([*by, "bag"])
    a, b = (once.filter("own") if "own" in keys.columns else once).alias("a"), once.alias("b")
    close = (F.col("a.bag") < F.col("b.bag")) & (F.least("a.size", "b.size") >= F.lit(threshold) * F.greatest("a.size", "b.size"))
    bits = F.bit_count(F.col("a.s0").bitwiseXOR(F.col("b.s0"))) + F.bit_count(F.col("a.s1").bitwiseXOR(F.col("b.s1")))
    close &= bits <= F.col("a.size") + F.col("b.size") - F.lit(2 * threshold) * F.greatest("a.size", "b.size") + F.lit(1e-6)
    on = F.lit(True)
    for c in by:
        on = on & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    return a.join(b, on).filter(close).select(F.col("a.bag").alias("a"), F.col("b.bag").alias("b"))


def similar_classes(signed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, similarity, jaccard): pairs of classes with enough weight in common whose share of common words in the longer text is at least ``threshold``.

    Class members have the same bag and bands, so one of them stands for all.
    """
    reps = signed.filter("bands IS NOT NULL")
    cold, hot = banded(reps)
    pairs = candidates(cold, ["band"], threshold)
    if hot is not None:
        pairs = pairs.unionByName(candidates(hot, ["band", "block"], threshold))
    pairs = pairs.distinct()
    bags = reps.select("bag", "size", "words").repartition("bag").dropDuplicates(["bag"])
    left = bags.select(F.col("bag").alias("a"), F.col("size").alias("n_a"), F.col("words").alias("w_a"))
    right = bags.select(F.col("bag").alias("b"), F.col("size").alias("n_b"), F.col("words").alias("w_b"))
    least = threshold / (threshold + 2 * (1 - threshold) * HEAVIEST)  # that a pair at the threshold can have
    shared = weight(F.col("both"))
    jaccard = shared / (weight(F.col("w_a")) + weight(F.col("w_b")) - shared)
    return (
        pairs.join(left, "a").join(right, "b").withColumn("both", F.array_intersect("w_a", "w_b"))
        .select("a", "b", (F.size("both") / F.greatest("n_a", "n_b")).alias("similarity"), jaccard.alias("jaccard"))
        .filter(F.col("jaccard") >= least - 1e-9).filter(F.col("similarity") >= threshold)
    )


def sign(texts: DataFrame) -> DataFrame:
    """Signatures of all texts with IDF weights counted over all of them, written to the shared checkpoint."""
    frequencies = shared_checkpoint(document_frequencies(texts).filter("n > 1"))
    total = frequencies.filter("word = ''").select("n").first()
    n = total["n"] if total else 1
    floor = max(2, math.ceil(n * RARE))
    known = frequencies.filter("word <> ''")
    while known.filter(F.col("n") >= floor).count() > TABLE:  # texts of very many different words
        floor *= 2
    common = bounded_rows(known.filter(F.col("n") >= floor), TABLE)
    weigh = lambda df: 1 + (HEAVIEST - 1) * math.log(n / df) / math.log(n / floor) if n > floor else 1.0
    return shared_checkpoint(signatures(texts, {r["word"]: weigh(r["n"]) for r in common}, weigh(floor)))


def similar_pairs(texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(chunk_id_a, chunk_id_b): all pairs of different ids with similar texts, the smaller id first."""
    signed = sign(texts)
    members = signed.select("bag", "chunk_id").distinct()
    linked = similar_classes(signed, threshold).select("a", "b")
    across = linked.join(members.select(F.col("bag").alias("a"), F.col("chunk_id").alias("x")), "a").join(members.select(F.col("bag").alias("b"), F.col("chunk_id").alias("y")), "b").select("x", "y")
    within = members.alias("m").join(members.alias("n"), (F.col("m.bag") == F.col("n.bag")) & (F.col("m.chunk_id") < F.col("n.chunk_id"))).select(F.col("m.chunk_id").alias("x"), F.col("n.chunk_id").alias("y"))
    return across.unionByName(within).filter("x != y").select(F.least("x", "y").alias("chunk_id_a"), F.greatest("x", "y").alias("chunk_id_b")).distinct()


def groups(texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(chunk_id, class_id, group_id, links, members): one row for each id and class; groups are the connected classes.

    ``links``: similar classes; ``members``: ids of the class.  Labels spread to neighbours and
    neighbours' labels until none changes; every round is checkpointed, only whether a label
    changed reaches the driver.  A label only ever falls, so the rounds end.
    """
    signed = sign(texts)
    members = signed.select("bag", "chunk_id").distinct()
    edges = shared_checkpoint(similar_classes(signed, threshold).select("a", "b"))
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy("a").agg(F.count(F.lit(1)).alias("links"))
    labels = both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node"))
    changed = True
    while changed:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("low"))
        step = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("low", "label")).alias("label"))
        hop = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = shared_checkpoint(step.join(hop, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        labels = step.select("node", "label")
        changed = not step.filter("old <> label").isEmpty()
    sizes = members.groupBy("bag").agg(F.count(F.lit(1)).alias("members"))
    classes = sizes.join(labels.withColumnRenamed("node", "bag"), "bag", "left").join(degree.withColumnRenamed("a", "bag"), "bag", "left")
    return members.join(classes, "bag").select(
        "chunk_id", F.col("bag").alias("class_id"), F.coalesce("label", "bag").alias("group_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"), "members"
    )


def chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "rag_chunks").select("chunk_id", F.col("raw_text").alias("text")).filter("text IS NOT NULL")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks whose texts have 85 % of their words in common."""
    return similar_pairs(chunk_texts(spark, sf_dir))


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk with its class of equal bags, its group and its number of links."""
    return groups(chunk_texts(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p6_found": p6_found, "p6_groups": p6_groups}
ORACLE: dict[str, str] = {}
