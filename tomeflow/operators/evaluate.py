"""Quality of answers: faithfulness, context precision and recall, relevance, verdict."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases by which an answer states that the evidence does not suffice.
REFUSAL_ANY_CASE = ("insufficient", "does not include", "does not contain")
REFUSAL_ARABIC = ("غير كافية", "لا تتوفر")


def _any(text: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | text.contains(p)
    return out


def _share(part: Column, whole: Column) -> Column:
    return F.size(F.array_intersect(part, whole)) / F.greatest(F.size(part), F.lit(1))


def faithfulness(answer: Column, answer_tokens: Column, context: Column, context_tokens: Column) -> Column:
    """Share of the answer's tokens that the context holds, calibrated; a proper refusal is faithful."""
    refused = _any(answer, (*REFUSAL_ARABIC, "لا تحتوي الوثيقة")) | _any(F.lower(answer), (*REFUSAL_ANY_CASE, "not found in"))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.20), 0.65 + 0.33 * F.least(F.lit(1.0), _share(answer_tokens, context_tokens) * 1.35)))
    empty = (F.coalesce(answer, F.lit("")) == "") | (F.coalesce(context, F.lit("")) == "")
    return F.when(empty, 0.0).when(refused | (F.size(answer_tokens) == 0), 1.0).otherwise(score)


def context_precision(query_tokens: Column, chunk_tokens: Column, reranker: Column) -> Column:
    """Mean overlap of the first three chunks (array of token arrays) with the query, blended with the reranker."""
    first = F.filter(F.slice(chunk_tokens, 1, 3), lambda t: F.size(t) > 0)
    mean = F.when(F.size(first) > 0, F.aggregate(first, F.lit(0.0), lambda a, t: a + _share(query_tokens, t)) / F.size(first)).otherwise(0.0)
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), reranker))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.30), 0.58 + 0.40 * (0.40 * mean + 0.60 * clamped)))
    return F.when(F.size(chunk_tokens) == 0, 0.0).when(F.size(query_tokens) == 0, F.least(F.lit(1.0), F.greatest(F.lit(0.6), reranker))).otherwise(score)


def context_recall(target_tokens: Column, context: Column, context_tokens: Column) -> Column:
    """Share of the target's (ground truth's or query's) tokens that the context holds."""
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.30), 0.60 + 0.38 * _share(target_tokens, context_tokens)))
    return F.when(F.coalesce(context, F.lit("")) == "", 0.0).when(F.size(target_tokens) == 0, 1.0).otherwise(score)


def answer_relevance(query: Column, query_tokens: Column, answer: Column, answer_tokens: Column) -> Column:
    """Share of the query's tokens in the answer; very short answers count half."""
    refused = _any(answer, (*REFUSAL_ARABIC, "لا تحتوي")) | _any(F.lower(answer), REFUSAL_ANY_CASE)
    short = F.length(F.regexp_replace(answer, r"(?U)^\s+|\s+$", "")) < 10
    overlap = _share(query_tokens, answer_tokens) * F.when(short, 0.5).otherwise(1.0)
    empty = (F.coalesce(query, F.lit("")) == "") | (F.coalesce(answer, F.lit("")) == "")
    return (
        F.when(empty, 0.0).when(refused, 0.95).when((F.size(query_tokens) == 0) | (F.size(answer_tokens) == 0), 0.88)
        .otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.40), 0.68 + 0.30 * overlap)))
    )


def overall(faithful: Column, relevance: Column, precision: Column, recall: Column) -> Column:
    return F.round(0.35 * faithful + 0.30 * relevance + 0.20 * precision + 0.15 * recall, 4)


def verdict(score: Column, faithful: Column) -> Column:
    return F.when((score >= 0.65) & (faithful >= 0.60), "PASS").when(score >= 0.40, "NEEDS_IMPROVEMENT").otherwise("FAIL")
