"""Search: dense and keyword channels, their merge, scores, and what is returned.

A candidate is a row (query_id, id, ...); ties are broken by id everywhere, as Spark's sorts
are not stable.  Corpora are never collected; query sets are taken in blocks of a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import core_tokens
from ..session import written

K1, B = 1.2, 0.75
QUERY_BLOCK = 2048


def top_k(df: DataFrame, k: int, *order: Column, by: str = "query_id") -> DataFrame:
    """The first k rows of each query, with their rank.  Spark cuts every partition to k before it shuffles."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k)


def candidate_width(k: int, multiplier: int = 6, least: int = 100) -> int:
    return max(k * max(multiplier, 8), k, least)


def matches(filters: dict[str, object], columns: dict[str, Column]) -> Column:
    """Do all filters hold, values compared as texts?  A filter that is None is none; a missing value reads 'None'."""
    out = F.lit(True)
    for name, value in filters.items():
        if value is not None:
            held = columns.get(name, F.lit(None))
            as_text = F.initcap(held.cast("string")) if isinstance(value, bool) else held.cast("string")
            out = out & (F.coalesce(as_text, F.lit("None")) == F.lit(str(value)))
    return out


def matches_typed(filters: dict[str, object], columns: dict[str, Column]) -> Column:
    """Do all filters hold, values compared in their own type?  A missing value matches nothing."""
    out = F.lit(True)
    for name, value in filters.items():
        if value is not None:
            out = out & F.coalesce(columns[name] == F.lit(value), F.lit(False)) if name in columns else F.lit(False)
    return out


def isolated(queries: DataFrame) -> DataFrame:
    """Queries that name the file they are asked of; retrieval never goes beyond it.  Others are an error, not a search of everything."""
    if "book" not in queries.columns:
        raise ValueError("file_reference_id is required for retrieval isolation")
    return queries.filter(F.col("book").isNotNull() & (F.trim("book") != ""))


def scoped(queries: DataFrame, chunks: DataFrame, fields: tuple[str, ...] = ("chapter", "lesson")) -> DataFrame:
    """(query_id, id): for each query the chunks of its book in the chapter and lesson that it names; a null names none."""
    on = F.col("q.book") == F.col("c.book")
    for f in fields:
        on = on & (F.col(f"q.{f}").isNull() | (F.coalesce(F.col(f"c.{f}"), F.lit("None")) == F.col(f"q.{f}")))
    return isolated(queries).alias("q").join(chunks.alias("c"), on).select("q.query_id", "c.id")


def knn(queries: DataFrame, corpus: DataFrame, k: int, same: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, id, distance): the k nearest by cosine distance, exact.

    ``queries`` (query_id, vector, *same) is taken in blocks of ``QUERY_BLOCK`` rows, one after
    the other: a block is a broadcast of a proven size, its result is written before the next
    is read.  Every task keeps k candidates a query, so the shuffle holds k rows a query and
    task.  ``same``: columns on which a query's and a row's values must agree; a row is compared
    with the queries of its own values only.
    """
    ids = queries.select("query_id", "vector", *same).filter("vector IS NOT NULL")
    rows_ = corpus.filter("vector IS NOT NULL")
    n = ids.count()
    best = lambda df: top_k(df, k, F.col("distance"), F.col("id"))
    if n <= QUERY_BLOCK:
        return best(_knn_block(ids.collect(), rows_, k, same))
    out, blocks = None, 2 * -(-n // QUERY_BLOCK)
    numbered = ids.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    for i in range(blocks):
        held = numbered.filter(F.col("block") == i).drop("block").collect()
        if held:
            part = written(best(_knn_block(held, rows_, k, same)))
            out = part if out is None else out.unionByName(part)
    return out


def _knn_block(rows: list, corpus: DataFrame, k: int, same: tuple[str, ...]) -> DataFrame:
    spark = corpus.sparkSession
    by: dict[tuple, list] = {}
    for r in rows:
        by.setdefault(tuple(r[c] for c in same), []).append(r)
    packed = {}
    for key, held in by.items():
        m = np.array([r["vector"] for r in held], np.float64)
        packed[key] = (np.array([r["query_id"] for r in held], np.int64), m, np.linalg.norm(m, axis=1))
    shared = spark.sparkContext.broadcast(packed)
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}  # of a query: distances and ids of the task's nearest so far
        for batch in batches:
            row_ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = list(zip(*(batch.column(2 + j).to_pylist() for j in range(len(same))), strict=True)) if same else [()] * len(row_ids)
            groups: dict[tuple, list[int]] = {}
            for at, key in enumerate(keys):
                if key in shared.value:
                    groups.setdefault(key, []).append(at)
            for key, at in groups.items():
                ids, m, norm = shared.value[key]
                v = np.array(batch.column(1).take(pa.array(at)).to_pylist(), np.float64)
                d = 1 - m @ v.T / np.maximum(np.outer(norm, np.linalg.norm(v, axis=1)), 1e-8)
                own = row_ids[at]
                for q, dist in zip(ids.tolist(), d, strict=True):
                    near = np.flatnonzero(dist <= np.partition(dist, k - 1)[k - 1] + 1e-12) if len(dist) > k else np.arange(len(dist))
                    best.setdefault(q, []).append((dist[near], own[near]))
                    if len(best[q]) > 16:
                        best[q] = [_nearest(best[q], k)]
        out = [(q, *_nearest(parts, k)) for q, parts in best.items()]
        for i in range(0, len(out), 4096):
            part = out[i : i + 4096]
            yield pa.RecordBatch.from_pydict({"query_id": np.concatenate([np.full(len(x[1]), x[0]) for x in part]), "id": np.concatenate([x[2] for x in part]), "distance": np.concatenate([x[1] for x in part])}, schema=schema)

    return corpus.select("id", "vector", *same).mapInArrow(run, "query_id bigint, id bigint, distance double")


def _nearest(parts: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray]:
    d, i = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.lexsort((i, np.round(d, 12)))[:k]
    return d[order], i[order]


def bm25(queries: DataFrame, corpus: DataFrame, k: int, by: tuple[str, ...] = ("book",)) -> DataFrame:
    """(query_id, id, score, rank): Okapi scores from postings; a query's repeated terms count repeatedly.

    ``queries`` (query_id, tokens, *by), ``corpus`` (id, tokens, *by): counts of texts and terms
    and the mean length are those within the columns ``by``, as are the postings; so a query is
    compared with the texts of its file only.  The texts are tokenized once: what is asked of is
    written (id, dl, the terms) and read for the lengths and the postings.  Terms that no query
    of the file has are dropped before the postings are counted.
    """
    keys = list(by)
    asked = written(queries.select("query_id", "tokens", *keys))
    wanted = asked.select("query_id", *keys, F.explode("tokens").alias("term")).groupBy("query_id", *keys, "term").agg(F.count(F.lit(1)).alias("qtf"))
    within = corpus.join(asked.select(*keys).distinct(), keys, "left_semi") if keys else corpus
    sizes = written(within.select("id", *keys, "tokens")).withColumn("dl", F.size("tokens"))
    stats = sizes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    terms = wanted.select(*keys, "term").distinct()
    postings = sizes.select("id", *keys, "dl", F.explode("tokens").alias("term")).join(terms, [*keys, "term"], "left_semi").groupBy(*keys, "term", "id", "dl").agg(F.count(F.lit(1)).alias("tf"))
    df = postings.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("df"))
    weighted = (df.join(stats, keys) if keys else df.crossJoin(F.broadcast(stats))).withColumn("idf", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / F.greatest(F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.greatest(F.col("avgdl"), F.lit(1.0))), F.lit(1e-9))
    scored = postings.join(weighted, [*keys, "term"]).join(wanted, [*keys, "term"]).groupBy("query_id", "id").agg(F.sum(part).alias("score")).filter("score > 0")
    return top_k(scored.withColumn("score", F.round("score", 6)), k, F.desc("score"), F.col("id"))


def question_channel(found: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, id, distance): hits of the question index (query_id, id, distance) as the chunks (question id, chunk_id) that the questions are of, the nearest question of each."""
    return found.join(questions.select(F.col("id"), F.col("chunk_id")), "id").groupBy("query_id", F.col("chunk_id").alias("id")).agg(F.min("distance").alias("distance"))


def merge_channels(dense: DataFrame, questions: DataFrame, keywords: DataFrame) -> DataFrame:
    """(query_id, id, distance, question_distance, keyword_score, question_match, keyword_match): one row a candidate.

    Channels (query_id, id, distance[, score]) come in the order dense, question, keyword; the
    first that has a candidate gives its distance, flags are or-ed, question distances take the
    least and keyword scores the largest.
    """
    none = F.lit(None).cast("double")
    one = dense.select("query_id", "id", F.lit(0).alias("channel"), "distance", none.alias("question_distance"), none.alias("keyword_score"))
    two = questions.select("query_id", "id", F.lit(1).alias("channel"), "distance", F.col("distance").alias("question_distance"), none.alias("keyword_score"))
    three = keywords.select("query_id", "id", F.lit(2).alias("channel"), (1 / (1 + F.col("score"))).alias("distance"), none.alias("question_distance"), F.col("score").alias("keyword_score"))
    return (
        one.unionByName(two).unionByName(three).groupBy("query_id", "id")
        .agg(F.min_by("distance", "channel").alias("distance"), F.min("question_distance").alias("question_distance"), F.max("keyword_score").alias("keyword_score"), F.max(F.col("channel") == 1).alias("question_match"), F.max(F.col("channel") == 2).alias("keyword_match"), F.min("channel").alias("channel"))
    )


def linear_score(query: Column, doc: Column, heading: Column, kind: Column, distance: Column, keyword: Column, keyword_score: Column) -> Column:
    """Weighted sum of dense similarity, lexical overlap, full containment, heading overlap and content type, at most 1."""
    n = F.greatest(F.size(query), F.lit(1))
    overlap = F.when(F.size(query) == 0, 0.5).otherwise(F.size(F.array_intersect(query, doc)) / n)
    h_overlap = F.when(F.size(query) == 0, 0.0).otherwise(F.size(F.array_intersect(query, heading)) / n)
    exact = F.when((F.size(query) > 0) & (F.size(F.array_except(query, doc)) == 0), 1.0).otherwise(0.0)
    ctype = F.when(kind.isin("definition", "paragraph", "example", "table"), 1.0).otherwise(0.8)
    lexical = F.greatest(F.least(F.lit(1.0), F.coalesce(keyword_score, F.lit(0.0)) / 15), overlap)
    matched = F.coalesce(keyword, F.lit(False))
    base = F.when(distance.isNotNull() & ~matched, F.greatest(F.lit(0.0), 1 - distance)).otherwise(0.5)
    dense = F.when(matched & (distance < 0.3), F.greatest(base, F.lit(0.75))).otherwise(base)
    return F.least(F.lit(1.0), 0.50 * dense + 0.35 * lexical + 0.10 * exact + 0.05 * h_overlap + 0.05 * ctype)


def calibrated(score: Column, reranker: Column, overlap: Column) -> tuple[Column, Column]:
    """(reranker score, retrieval confidence) after calibration; a missing reranker score passes the score through."""
    raw = F.coalesce(reranker, score)
    eff = F.greatest(raw, 0.5 * raw + 0.5 * score)
    lift = lambda x: F.least(F.lit(1.0), (x - 0.35) / 0.40)
    confidence = F.when(eff >= 0.35, F.least(F.lit(0.98), 0.80 + 0.18 * lift(eff) + 0.06 * overlap)).otherwise(1.5 * eff)
    adjusted = F.when(eff >= 0.35, F.least(F.lit(0.98), F.greatest(F.lit(0.72), 0.74 + 0.24 * lift(raw)))).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)))
    return adjusted, F.least(F.lit(0.98), F.greatest(F.lit(0.05), confidence))


def first_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def first_per_parent(ranked: DataFrame, k: int) -> DataFrame:
    """The best child of each parent in rank order, k a query (query_id, id, parent_id, rank)."""
    best = first_per(ranked, ["query_id", "parent_id"], F.col("rank"))
    return top_k(best.drop("rank"), k, F.col("best_rank")) if "best_rank" in best.columns else top_k(best.withColumnRenamed("rank", "child_rank"), k, F.col("child_rank"))


def expand_parents(ranked: DataFrame, parents: DataFrame) -> DataFrame:
    """Left join with (parent_id, parent_text): a missing parent leaves the child's own text."""
    return ranked.join(parents, "parent_id", "left").withColumn("context_expanded", F.col("parent_text").isNotNull()).withColumn("context", F.coalesce("parent_text", "text"))


def evidence_block(rank: Column, source: Column, page: Column, heading: Column, text: Column) -> Column:
    """One block of the context; what is not known reads 'unknown', a value that is null 'None'."""
    known = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return F.concat(F.lit("[Evidence "), rank.cast("string"), F.lit("]\nSource: "), known(source), F.lit("\nPage: "), known(page), F.lit("\nSection: "), known(heading), F.lit("\nText: "), F.coalesce(text, F.lit("")))


def context_budget(results: DataFrame, limit: int = 6000, tail: int = 250) -> DataFrame:
    """(query_id, rank, used_chars): blocks in rank order until the first overflow, of which a part is kept if more than ``tail`` is left.

    ``results`` (query_id, rank, text): the text is that of the whole block.
    """
    w = Window.partitionBy("query_id").orderBy("rank")
    size = F.length("text")
    until = w.rowsBetween(Window.unboundedPreceding, -1)
    spent = results.withColumn("before", F.coalesce(F.sum(size).over(until), F.lit(0)))
    left = F.lit(limit) - F.col("before")
    used = F.when(size <= left, size).when(left > tail, left).otherwise(0)
    overflow = F.max((size > left).cast("int")).over(until)
    flagged = spent.withColumn("used_chars", used).withColumn("over", F.coalesce(overflow, F.lit(0)))
    return flagged.filter("over = 0 AND used_chars > 0").select("query_id", "rank", "used_chars")


def build_context(results: DataFrame, limit: int = 6000, tail: int = 250) -> DataFrame:
    """(query_id, context): the blocks of results (query_id, rank, text) within the budget, in order."""
    kept = context_budget(results, limit, tail).join(results, ["query_id", "rank"]).withColumn("block", F.col("text").substr(F.lit(1), F.col("used_chars").cast("int")))
    return kept.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n\n").alias("context"))


def retrieve(queries: DataFrame, chunks: DataFrame, parents: DataFrame, channels: tuple[DataFrame, DataFrame, DataFrame], k: int = 5, reranked: DataFrame | None = None, candidates: int = 25) -> DataFrame:
    """(query_id, rank, id, parent_id, score, reranker, confidence, lexical_overlap, heading_overlap, channels, context_expanded, context, ...): from candidates to context.

    ``queries`` (query_id, tokens), ``chunks`` (id, book, page, text, heading, content_type,
    parent_id), ``parents`` (parent_id, parent_text), ``channels``: dense, question and keyword
    candidates, already within each query's file.  ``reranked`` (query_id, id, reranker) are
    scores of a model for the candidates; without them, and where one is missing, the linear
    score stands for it.  Candidates of one file, page and beginning count once, the first by
    channel and place in it.
    """
    merged = merge_channels(*channels)
    rows = merged.join(chunks, "id").join(queries.select("query_id", F.array_distinct("tokens").alias("qt")), "query_id")
    first = (F.coalesce("keyword_score", F.lit(0.0)) * -1).alias("weaker")
    beginning = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("book", "page")] + [F.substring(F.coalesce("text", F.lit("")), 1, 60)]
    once = first_per(rows.withColumn("weaker", first).withColumn("beginning", F.concat_ws(":", *beginning)), ["query_id", "beginning"], F.col("channel"), F.coalesce("distance", F.lit(0.0)), F.col("weaker"), F.col("id"))
    once = once.withColumn("dt", core_tokens(F.col("text"))).withColumn("ht", core_tokens(F.col("heading")))
    score = linear_score(F.col("qt"), F.col("dt"), F.col("ht"), F.col("content_type"), F.col("distance"), F.col("keyword_match"), F.col("keyword_score"))
    share = lambda c, none: F.when(F.size("qt") == 0, none).otherwise(F.size(F.array_intersect("qt", c)) / F.greatest(F.size("qt"), F.lit(1)))
    scored = once.withColumn("score", F.round(score, 6)).withColumn("lexical_overlap", share("dt", 0.5)).withColumn("heading_overlap", share("ht", 0.0))
    selected = top_k(scored, max(3 * k, candidates), F.desc("score"), F.col("channel"), F.col("id")).drop("rank", "qt", "dt", "ht")
    model = selected.withColumn("model", F.lit(None).cast("double")) if reranked is None else selected.join(reranked.select("query_id", "id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "reranker")).alias("model")), ["query_id", "id"], "left")
    rerank, confidence = calibrated(F.col("score"), F.col("model"), F.col("lexical_overlap"))
    final = model.withColumn("reranker", F.round(rerank, 6)).withColumn("confidence", F.round(confidence, 6))
    ranked = top_k(final, 3 * k, F.desc("reranker"), F.desc("confidence"), F.desc("score"), F.col("id"))
    best = first_per_parent(ranked.withColumn("parent_id", F.coalesce("parent_id", F.col("id").cast("string"))), k)
    names = F.array_compact(F.array(F.when(~F.col("keyword_match") & ~F.col("question_match") | (F.col("channel") == 0), F.lit("dense")), F.when(F.col("question_match"), F.lit("question")), F.when(F.col("keyword_match"), F.lit("keyword"))))
    return expand_parents(best.withColumn("channels", names), parents)


def top_confidence(results: DataFrame) -> DataFrame:
    """(query_id, top): the confidence of each query's first result."""
    return results.filter("rank = 1").select("query_id", F.col("confidence").alias("top"))


def better_of(first: DataFrame, second: DataFrame, bar: float) -> DataFrame:
    """The results of ``second`` for queries whose first results are missing or below ``bar`` and less confident than those, else of ``first``.

    With 0.25: a chapter's or lesson's results that the whole file may replace; with 0.62: those
    of the bare question that the question with its context may replace.
    """
    a, b = top_confidence(first).withColumnRenamed("top", "a"), top_confidence(second).withColumnRenamed("top", "b")
    chosen = b.join(a, "query_id", "left").filter(F.coalesce("a", F.lit(0.0)) < F.least(F.lit(bar), F.col("b"))).select("query_id")
    return first.join(chosen, "query_id", "left_anti").unionByName(second.join(chosen, "query_id", "left_semi"), allowMissingColumns=True)
