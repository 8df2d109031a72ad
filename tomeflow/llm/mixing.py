"""Problem 8: mixing sources to target weights.

Documents are counted and weighed (tokens of a public tokenizer) by cell: source, language
and subject.  Iterative proportional fitting rakes the cells' token weights to the sources'
target shares and to the corpus's own language and subject marginals, while no cell exceeds
the repeats its source allows.  The size of the mix is the largest at which every source that
has documents reaches its share within its repeats.

Every document of a cell gets the whole part of the calibrated expectation as copies; the
rest of the cell's target is filled by documents in the order of a hash until it is reached.
Which ones these are is read off running sums of tokens, taken in buckets of the hash and
joined by the buckets' totals, so that no source is brought into one task.  What rounding
left over in the cells is made up for by other documents of the source and language in a second
round, and by others of the source in a third.

Every subject is raked, however many there are, and in one way at any size.  The cells stay in
the tasks, sorted by subject: given a multiplier of each source and language, a subject's own
multiplier follows from its cells, so the driver holds sums of sources and languages only
(sources of ``mix_targets``, a small table, checked; the seven languages and one for all else).
The sums are added up in whole numbers, so they are the same however the cells are divided.

Null, empty and blank texts have no tokens worth mixing and are left out, as are sources
without a target; a target source without documents is reported with share 0 and its share
falls to the others in proportion.  Repeated texts are separate documents.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_rows, shared_checkpoint, table
from .encode import tokens
from .language import LANGS

#: Cells a task holds at a time, most rounds of raking, most rows of the targets, documents of a bucket of the hash.
CELLS, ROUNDS, TARGETS, BUCKET = 200_000, 200, 10_000, 50_000
#: Rounds end when no sum moves by more than this share of the mix; parts of a token in sums.
STEADY, PARTS = 1e-7, 2**30


def weighed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, subject, tokens) of the documents of target sources that have a text."""
    targets = spark.createDataFrame([(r["source"],) for r in bounded_rows(table(spark, sf_dir, "mix_targets").select("source"), TARGETS)], "source string")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "subject", "text").filter(F.col("text").rlike(r"\S"))
    sized = tokens(docs.join(F.broadcast(targets), "source", "left_semi")).drop("text")
    lang = F.when(F.lower("lang").isin(*LANGS), F.lower("lang")).otherwise("other")
    return sized.withColumn("lang", lang).withColumn("subject", F.coalesce(F.trim("subject"), F.lit("")))


@dataclass
class Goals:
    """What the cells are raked to; a pair is a source and a language, numbered in order."""

    pairs: list[tuple[str, str]]
    source: np.ndarray  # of each pair
    lang: np.ndarray
    cap: np.ndarray  # most uses of a document of each pair
    full: np.ndarray  # pairs of sources that reach their share only if all is used up
    want: np.ndarray  # tokens of each source
    by_lang: np.ndarray
    total: float
    ratio: float  # tokens of the mix to those of the corpus


def aims(sources: list[str], totals: dict[tuple[str, str], float], shares: dict[str, float], repeats: dict[str, int]) -> Goals:
    """Goals from the tokens of each source and language."""
    place = lambda names: {x: i for i, x in enumerate(names)}
    pairs, langs = sorted(totals), sorted({p[1] for p in totals})
    by_name, by_lang = place(sources), place(langs)
    s, a = np.array([by_name[p[0]] for p in pairs]), np.array([by_lang[p[1]] for p in pairs])
    size = np.array([totals[p] for p in pairs], float)
    share = np.array([shares[x] for x in sources])
    share = share / share.sum()
    cap = np.array([repeats[x] for x in sources], float)
    most = np.bincount(s, size, len(sources)) * cap
    total = float(np.min(np.where(share > 0, most / np.maximum(share, 1e-12), np.inf)))
    want, ratio = share * total, total / float(size.sum())
    return Goals(pairs, s, a, cap[s], (want >= most * (1 - 1e-12))[s], want, np.bincount(a, size, len(langs)) * ratio, total, ratio)


def used(goals: Goals, by_pair: np.ndarray, last: np.ndarray, j: np.ndarray, k: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Expected uses of a document of the cells (subject ``j``, pair ``k``, tokens ``t``) of whole subjects.

    A use is the pair's multiplier by the subject's, within the cap.  The subject's is the one
    at which its cells add up to its goal, sought from below by Newton's method on a sum that
    is piecewise linear; where what must be used up exceeds the goal, little is left of the rest.
    ``last`` then brings the sources to their shares.
    """
    n = int(j[-1]) + 1 if len(j) else 0
    cap, full, m = goals.cap[k], goals.full[k], by_pair[k]
    goal, at = np.bincount(j, t, n) * goals.ratio, full
    b = np.zeros(n)
    while True:
        held, free = np.bincount(j, np.where(at, t * cap, 0), n), np.bincount(j, np.where(at, 0, t * m), n)
        higher = np.where(free > 0, np.maximum(b, np.maximum(goal - held, 1e-6 * goal) / np.where(free > 0, free, 1)), np.inf)
        at = full | (m * higher[j] >= cap)
        if np.array_equal(b, higher):
            return np.where(full, cap, np.minimum(cap, last[k] * np.minimum(cap, m * b[j])))
        b = higher


def added(goals: Goals, k: np.ndarray, t: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Rows of whole numbers by pair: tokens at the cap; tokens below it, and their parts."""
    n, at, w = len(goals.pairs), u >= goals.cap[k], t * u
    whole = np.floor(w)
    rows = np.where(at, np.rint(w), 0), np.where(at, 0, whole), np.where(at, 0, np.ceil((w - whole) * PARTS))  # what is in use is never 0
    return np.array([np.bincount(k, x, n) for x in rows]).astype(np.int64)


def steered(goals: Goals, sums: Callable[[np.ndarray, np.ndarray], np.ndarray], rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The two multipliers of each pair that ``used`` takes; ``sums`` gives the rows of ``added`` over all cells for them.

    Sources, languages and, in ``sums``, subjects are raked in turn, the latter two softly; the
    sources come last, so their shares hold.
    """
    s, a, n_s, n_a = goals.source, goals.lang, len(goals.want), len(goals.by_lang)
    one = np.ones(len(goals.pairs))
    m, before = one.copy(), None

    def factor(goal: np.ndarray, held: np.ndarray, free: np.ndarray) -> np.ndarray:
        some = np.maximum(free, 1e-300)
        return np.where(free > 0, np.where(goal > held, (goal - held) / some, goal / np.maximum(held + free, 1e-300)), 1.0)

    for _ in range(rounds):
        held, free = split_sums(sums(m, one))
        if before is not None and np.abs(held + free - before).sum() <= STEADY * goals.total:
            break
        before = held + free
        f = np.clip(factor(goals.want, np.bincount(s, held, n_s), np.bincount(s, free, n_s)), 1e-3, 1e3)[s]
        held, free = np.where(goals.full, held, held * np.minimum(f, 1)), free * f
        g = np.clip(factor(goals.by_lang, np.bincount(a, held, n_a), np.bincount(a, free, n_a)), 1e-3, 1e3)[a]
        m = np.where(goals.full, 1.0, m * f * g)
        m = np.clip(m / np.exp(np.log(m).mean()), 1e-100, 1e100)
    last = np.ones(n_s)
    for _ in range(60):
        held, free = (np.bincount(s, x, n_s) for x in split_sums(sums(m, last[s])))
        if np.all(np.abs(goals.want - held - free) < 1e-6 * np.maximum(goals.want, 1)):
            break
        last = last * factor(goals.want, held, free)
    return m, last[s]


def split_sums(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return rows[0].astype(float), rows[1] + rows[2] / PARTS


def rake(sources: list[str], cells: list[tuple[str, str, str, float]], shares: dict[str, float], repeats: dict[str, int], rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """(expected uses of a document of each cell, tokens of the mix) of cells at hand."""
    totals: dict[tuple[str, str], float] = {}
    for source, lang, _, t in cells:
        totals[source, lang] = totals.get((source, lang), 0.0) + t
    goals = aims(sources, totals, shares, repeats)
    place = {p: i for i, p in enumerate(goals.pairs)}
    subjects = {x: i for i, x in enumerate(sorted({c[2] for c in cells}))}
    k, j, t = np.array([place[c[0], c[1]] for c in cells]), np.array([subjects[c[2]] for c in cells]), np.array([c[3] for c in cells], float)
    order = np.lexsort((k, j))
    j, k, t = j[order], k[order], t[order]
    m, last = steered(goals, lambda m, last: added(goals, k, t, used(goals, m, last, j, k, t)), rounds)
    uses = np.empty(len(cells))
    uses[order] = used(goals, m, last, j, k, t)
    return uses, goals.total


def subjects_of(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows sorted by subject, in tables of whole subjects: ``most`` rows, or what one subject has."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < most:
            continue
        rows = pa.Table.from_batches(held)
        names = rows.column("subject")
        # The last subject may go on in the next batch.
        begin = n - int(pc.sum(pc.equal(names, names[n - 1])).as_py())
        if begin:
            yield rows.slice(0, begin)
        held = rows.slice(begin).combine_chunks().to_batches()
        n -= begin
    if n:
        yield pa.Table.from_batches(held)


def columns_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(subject's number, pair, tokens) of the rows of ``subjects_of``."""
    names = rows.column("subject").combine_chunks()
    new = np.concatenate([[0], pc.not_equal(names.slice(1), names.slice(0, len(names) - 1)).to_numpy(zero_copy_only=False).astype(np.int64)])
    return np.cumsum(new), rows.column("pair").to_numpy().astype(np.int64), rows.column("t").to_numpy().astype(float)


def raked(goals: Goals, cells: DataFrame) -> DataFrame:
    """``cells`` (subject, pair, t: sorted by the first two, a subject in one partition) with ``base`` and ``goal``.

    These are the copies of every document, and the tokens of documents with one copy more.
    """
    most, size = CELLS, len(goals.pairs)

    def sums(m: np.ndarray, last: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = np.zeros((3, size), np.int64)
            for part in subjects_of(batches, most):
                j, k, t = columns_of(part)
                rows += added(goals, k, t, used(goals, m, last, j, k, t))
            some = np.flatnonzero(rows.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some, *rows[:, some])], names=["pair", "held", "free", "parts"])

        got = cells.mapInArrow(run, "pair bigint, held bigint, free bigint, parts bigint")
        out = np.zeros((3, size), np.int64)
        for r in got.groupBy("pair").agg(*(F.sum(x).alias(x) for x in ("held", "free", "parts"))).collect():  # one row a pair
            out[:, r["pair"]] = r["held"], r["free"], r["parts"]
        return out

    m, last = steered(goals, sums)

    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in subjects_of(batches, most):
            j, k, t = columns_of(part)
            u = used(goals, m, last, j, k, t)
            whole = np.floor(u + 1e-9)
            goal = np.where(u - whole > 1e-9, np.round((u - whole) * t, 6), 0.0)
            made = part.select(["subject", "pair"]).append_column("base", pa.array(whole.astype(np.int32))).append_column("goal", pa.array(goal))
            yield from made.to_batches()

    return cells.mapInArrow(planned, "subject string, pair int, base int, goal double")


def filled(docs: DataFrame, goals: DataFrame, key: str) -> DataFrame:
    """``docs`` (key, tokens, bucket, pick, ...) with ``taken``: true while the key's running tokens, in hash order, stay within its goal.

    The document at the border is taken if that comes nearer to the goal.
    """
    within = Window.partitionBy(key, "bucket").orderBy("pick", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = docs.groupBy(key, "bucket").agg(F.sum("tokens").alias("t")).withColumn("offset", F.coalesce(F.sum("t").over(before), F.lit(0)))
    # One row a bucket, with its goal; Spark broadcasts it or not by its size.
    placed = docs.withColumn("run", F.sum("tokens").over(within)).join(totals.select(key, "bucket", "offset").join(goals, key), [key, "bucket"])
    return placed.withColumn("taken", F.col("run") + F.col("offset") - F.col("tokens") / 2 <= F.col("goal")).drop("run", "offset", "goal")


def made_up(first: DataFrame, due: dict, key: str, ddl: str) -> DataFrame:
    """``first`` with what its keys' taken tokens lack to ``due`` added to, or taken off, the documents that can still change."""
    first = shared_checkpoint(first)
    got = {r[key]: r["t"] for r in first.filter("taken").groupBy(key).agg(F.sum("tokens").alias("t")).collect()}
    gaps = first.sparkSession.createDataFrame([(x, float(t - got.get(x, 0))) for x, t in due.items()], f"{key} {ddl}, left double")
    marked = first.join(F.broadcast(gaps), key)  # one row a source and language at most, whose number is checked
    open_ = F.when(F.col("left") > 0, ~F.col("taken") & (F.col("base") < F.col("most"))).otherwise(F.col("taken"))
    changed = filled(marked.filter(open_).withColumnRenamed("taken", "was"), gaps.select(key, F.abs("left").alias("goal")), key)
    changed = changed.withColumn("taken", F.col("was") != F.col("taken")).drop("was")
    return marked.filter(~open_).unionByName(changed).drop("left")


def mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list, DataFrame]:
    """((doc_id, source, tokens, copies), rows of the targets, the same rows as a table)."""
    targets = bounded_rows(table(spark, sf_dir, "mix_targets"), TARGETS)
    docs = weighed(spark, sf_dir)
    docs = shared_checkpoint(docs)
    # Targets were bounded, languages are eight.
    rows = docs.groupBy("source", "lang").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()
    shares = {r["source"]: r["target_share"] or 0.0 for r in targets}
    repeats = {r["source"]: r["max_repeats"] or 0 for r in targets}
    totals = {(r["source"], r["lang"]): float(r["t"]) for r in rows if shares.get(r["source"], 0) > 0 and repeats[r["source"]] > 0 and r["t"] > 0}
    if not totals:
        return docs.select("doc_id", "source", "tokens", F.lit(0).alias("copies")).limit(0), targets, docs
    goals = aims(sorted({p[0] for p in totals}), totals, shares, repeats)
    pairs = spark.createDataFrame([(*p, k) for k, p in enumerate(goals.pairs)], "source string, lang string, pair int")
    docs = docs.join(F.broadcast(pairs), ["source", "lang"])
    cells = docs.groupBy("subject", "pair").agg(F.sum("tokens").alias("t")).filter("t > 0").repartition("subject").sortWithinPartitions("subject", "pair")
    plan = shared_checkpoint(raked(goals, shared_checkpoint(cells)).withColumn("cell", F.monotonically_increasing_id()))
    # Buckets by the number of documents, so that no source is sorted in one task whatever its size.
    by_source: dict[str, int] = {}
    for r in rows:
        by_source[r["source"]] = by_source.get(r["source"], 0) + r["n"]
    bits = max(1, math.ceil(math.log2(max(1, max(by_source.values()) / BUCKET))))
    pick = F.xxhash64("doc_id")
    placed = (
        docs.join(plan.drop("goal"), ["subject", "pair"])
        .withColumn("bucket", F.shiftrightunsigned(pick, 64 - bits)).withColumn("pick", F.shiftrightunsigned(F.shiftleft(pick, bits), bits))
    )
    # Cells may be smaller than a document, so what rounding left is made up for by source and language, and then by source.
    first = filled(placed, plan.select("cell", "goal"), "cell").join(F.broadcast(spark.createDataFrame(list(repeats.items()), "source string, most int")), "source")
    # Added up as decimals, so that the order does not matter.
    due = plan.groupBy("pair").agg(F.sum(F.col("goal").cast("decimal(28,6)")).alias("t")).collect()
    by_pair, by_name = {r["pair"]: r["t"] for r in due}, {}
    for k, t in by_pair.items():
        by_name[goals.pairs[k][0]] = by_name.get(goals.pairs[k][0], 0) + t
    final = made_up(made_up(first, by_pair, "pair", "int"), by_name, "source", "string")
    out = final.select("doc_id", "source", "tokens", (F.col("base") + F.col("taken").cast("int")).alias("copies")).filter("copies > 0")
    return out, targets, docs


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, tokens, copies): the documents of the mix and how often each is used."""
    return mixed(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target and the actual share of each source, its documents, copies and most repeats."""
    mix, _, _ = mixed(spark, sf_dir)
    by = mix.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("copies").alias("copies"), F.max("copies").alias("most_repeats"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    one = Window.partitionBy(F.lit(1))  # over the rows of mix_targets only
    zero = F.lit(0)
    return (
        table(spark, sf_dir, "mix_targets").join(by, "source", "left").withColumn("all_tokens", F.sum("tokens").over(one))
        .select("source", "target_share", "max_repeats", F.coalesce("docs", zero).alias("docs"), F.coalesce("copies", zero).alias("copies"), F.coalesce("most_repeats", zero).alias("most_repeats"), F.coalesce("tokens", zero).alias("tokens"), F.round(F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)), 9).alias("actual_share"))
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p8_mix": p8_mix, "p8_shares": p8_shares}
ORACLE: dict[str, str] = {}
