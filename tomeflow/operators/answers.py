"""Answers from evidence: what a model returned, what stands in for it, and what is told of both.

A provider is a function from (question, context, history) to a raw answer; ``generated`` tries
providers in order, one call a row, and falls back to the best evidence itself.  All but that
call are Column expressions or run over Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import core_tokens, repair_ocr

# States of an answer, and the texts that stand for a missing one.
ANSWERED, INSUFFICIENT, FAILED = "answered", "insufficient_evidence", "grounding_failed"
NOT_ENOUGH = "المعلومات المسترجعة من المحتوى غير كافية للإجابة على السؤال بشكل موثوق."
NOT_FOUND = "لا تتوفر في الأدلة المسترجعة معلومات كافية للإجابة على هذا السؤال بشكل موثوق."
FROM_LESSON = "بناءً على الجزء المسترجع من الدرس:\n\n"
# Marks of citations.
CITATION = re.compile(r"【[^】]{0,80}】|\[(?:evidence|source)\s*\d+[^\]]{0,40}\]|\((?:evidence|source)\s*\d+[^)]{0,40}\)", re.I)
# Leftovers of figures that are no heading.
FIGURE = r"^(?:مثلث|دائرة|مربع|مستطيل|[▲▼◄►•▪=><~]+|\s*=\s*[\d.]+\s*[a-zA-Z\d^]+)\s*$"
#: Scores below which nothing is generated, and from which evidence counts as grounding.
LEAST, GROUNDED = 0.15, 0.30


def without_citations(text: str | None) -> str:
    t = re.sub(r"[ \t]+(?=[.,؛،])", "", CITATION.sub("", text or ""))
    return re.sub(r"[ \t]{2,}", " ", t).strip()


def structured(raw: str | None) -> tuple[str, str] | None:
    """(answer, status) of a JSON answer, fenced or not; None for anything else."""
    m = re.fullmatch(r"```(?:json)?\s*(.*?)\s*```", (raw or "").strip(), re.S)
    try:
        obj = json.loads(m[1].strip() if m else (raw or "").strip())
    except ValueError:
        return None
    if not isinstance(obj, dict) or "answer" not in obj:
        return None
    said = str(obj["answer"]).strip()
    status = str(obj.get("status", "")).strip().lower()
    if status not in (ANSWERED, INSUFFICIENT):
        status = ANSWERED if said else INSUFFICIENT
    return without_citations(said), status


def extractive(query: Column, evidence: Column, reranker: Column) -> tuple[Column, Column]:
    """(answer, status) from the first evidence alone; refused where it has no word of the question and a low score."""
    blank = ~F.coalesce(evidence, F.lit("")).rlike(r"(?U)\S")
    q = core_tokens(query)
    apart = (F.coalesce(query, F.lit("")) != "") & (F.size(q) > 0) & ~F.arrays_overlap(q, core_tokens(evidence)) & (F.coalesce(reranker, F.lit(0.0)) < 0.40)
    text = F.concat(F.lit(FROM_LESSON), F.regexp_replace(evidence, r"(?U)^\s+|\s+$", ""))
    return F.when(blank, NOT_ENOUGH).when(apart, NOT_FOUND).otherwise(text), F.when(blank | apart, INSUFFICIENT).otherwise(ANSWERED)


Provider = Callable[[str, str, list], str]


def generated(asked: DataFrame, providers: tuple[Provider, ...] = (), turns: int = 6) -> DataFrame:
    """``asked`` (query_id, query, context, evidence, reranker[, history]) with answer, status and self_reported.

    Providers are tried in order; the first that returns text counts.  Where none is given or
    none answers, the answer is extractive.
    """
    text, status = extractive(F.col("query"), F.col("evidence"), F.col("reranker"))
    plain = asked.withColumn("fallback", text).withColumn("fallback_status", status)
    if not providers:
        return plain.withColumnRenamed("fallback", "answer").withColumnRenamed("fallback_status", "status").withColumn("self_reported", F.lit(False))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields)

    def one(row: dict) -> tuple[str, str, bool]:
        for ask in providers:
            try:
                raw = ask(row["query"] or "", row["context"] or "", (row.get("history") or [])[-turns:])
            except Exception:  # the next provider is asked
                continue
            found = structured(raw)
            if found:
                return (*found, True)
            said = without_citations(raw)
            return said, ANSWERED if said else INSUFFICIENT, False
        return row["fallback"], row["fallback_status"], False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [one(r) for r in batch.to_pylist()]
            kept = batch.drop_columns(["fallback", "fallback_status"])
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array([g[k] for g in got]) for k in range(3))], names=[*kept.schema.names, "answer", "status", "self_reported"])

    return plain.mapInArrow(run, f"{fields}, answer string, status string, self_reported boolean")


def passes(reranker: Column, confidence: Column, bar: float) -> Column:
    return F.coalesce((reranker >= bar) & (confidence >= bar), F.lit(False))


def grounding(status: Column, self_reported: Column, reranker: Column, confidence: Column) -> tuple[Column, Column]:
    """(answer_status, grounded): what the model says of itself counts; else its scores tell.  A null status is an answer that was not generated."""
    good = passes(reranker, confidence, GROUNDED)
    said = F.coalesce(self_reported, F.lit(False))
    state = F.when(status.isNull(), INSUFFICIENT).when(said | (status == INSUFFICIENT), status).otherwise(F.when(good, ANSWERED).otherwise(FAILED))
    return state, F.coalesce(F.when(said, status == ANSWERED).otherwise(good & (status == ANSWERED)), F.lit(False))


def clean_source(c: Column) -> Column:
    """A heading as it is shown: font leftovers repaired, single spaces; null for blanks and leftovers of figures."""
    t = F.trim(F.regexp_replace(repair_ocr(c), r"(?U)\s+", " "))
    return F.when((t != "") & ~t.rlike(FIGURE), t)


def source_list(results: DataFrame) -> DataFrame:
    """(query_id, sources): the results of each query in order, as they are shown; at most as many as were retrieved."""
    path = F.array_compact(F.transform("heading_path", clean_source))
    shown = F.struct(
        "rank", "id", "page", "source", *(clean_source(F.col(c)).alias(c) for c in ("heading", "chapter", "lesson")), F.when(F.size(path) > 0, path).alias("heading_path"), "content_type", "parent_id", "score", "confidence", "reranker", "channels", "context_expanded"
    )
    return results.groupBy("query_id").agg(F.array_sort(F.collect_list(shown)).alias("sources"))


def retrieval_summary(results: DataFrame) -> DataFrame:
    """One row a query: what its first result scored in each channel, how many were returned, and of how many the context was expanded."""
    near = lambda c: F.coalesce(F.greatest(F.lit(0.0), 1 - F.col(c)), F.lit(0.0))
    first = results.filter("rank = 1").select("query_id", F.col("score").alias("top_score"), near("distance").alias("semantic_score"), F.coalesce("keyword_score", F.lit(0.0)).alias("keyword_score"), near("question_distance").alias("question_score"), F.col("reranker").alias("reranker_score"), F.col("confidence").alias("retrieval_confidence"))
    count = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("candidate_count"), F.sum(F.col("context_expanded").cast("bigint")).alias("expanded"), F.sum((~F.col("context_expanded")).cast("bigint")).alias("missed"))
    return first.join(count, "query_id")
