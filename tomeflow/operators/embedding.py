"""Vectors of texts: a pluggable encoder, and one that needs no model.

An encoder takes a list of texts and returns one vector each; it is called once an Arrow
batch.  ``hash_vectors`` gives every text a fixed pseudo-random unit vector, so equal texts
meet and others do not: it stands in where no model is installed, and makes runs repeatable.

Null texts get a null vector; empty ones are encoded like any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 384
Encoder = Callable[[list[str]], np.ndarray]


def hash_vectors(texts: list[str], dim: int = DIM) -> np.ndarray:
    """Unit vectors seeded by the texts' hashes."""
    out = np.empty((len(texts), dim), np.float32)
    for k, t in enumerate(texts):
        seed = int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "little")
        out[k] = np.random.default_rng(seed).normal(size=dim).astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def ordered_unit(rows: list[dict], expected: int) -> np.ndarray:
    """Vectors of a remote answer (index, embedding), in the order asked and of unit length; anything else is an error."""
    if len(rows) != expected:
        raise ValueError(f"{len(rows)} vectors for {expected} texts")
    try:
        m = np.asarray([r["embedding"] for r in sorted(rows, key=lambda r: int(r["index"]))], np.float32)
    except (KeyError, TypeError, ValueError) as e:
        raise ValueError("no valid vectors") from e
    if m.ndim != 2 or not m.shape[1]:
        raise ValueError("empty vectors")
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def ordered_scores(rows: list[dict], count: int) -> list[float | None]:
    """Scores of a remote reranker (index, relevance_score) by candidate, within 0 ... 1; None where it gave none."""
    out: list[float | None] = [None] * count
    for r in rows:
        out[int(r["index"])] = min(1.0, max(0.0, float(r["relevance_score"])))
    return out


def encode(df: DataFrame, text: str, encoder: Encoder = hash_vectors, vector: str = "vector") -> DataFrame:
    """``df`` with the vectors of a text column; a column of that name is replaced."""
    kept = df.drop(vector)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            at = [i for i, t in enumerate(texts) if t is not None]
            found = np.asarray(encoder([texts[i] for i in at]), np.float32) if at else np.empty((0, 0), np.float32)
            rows: list = [None] * len(texts)
            for i, v in zip(at, found, strict=True):
                rows[i] = v
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.float32()))], names=[*batch.schema.names, vector])

    return kept.mapInArrow(run, f"{fields}, `{vector}` array<float>")


def rerank(candidates: DataFrame, scorer: Callable[[list[tuple[str, str]]], list[float]]) -> DataFrame:
    """(query_id, id, reranker, error): a model's scores for candidates (query_id, id, query, text); if it fails, the score is null and the error is given.

    The scorer is called once a batch with (query, text) pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.to_pydict()
            try:
                scores, error = [min(1.0, max(0.0, float(x))) for x in scorer([(q or "", t or "") for q, t in zip(c["query"], c["text"], strict=True)])], None
                if len(scores) != batch.num_rows:
                    raise ValueError("a score for each pair was expected")
            except Exception as e:  # a failing model must not fail the retrieval
                scores, error = [None] * batch.num_rows, f"{type(e).__name__}: {e}"[:300]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([error] * batch.num_rows, pa.string())], names=["query_id", "id", "reranker", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema.fields}
    return candidates.select("query_id", "id", "query", "text").mapInArrow(run, f"query_id {kinds['query_id']}, id {kinds['id']}, reranker double, error string")


def cosine(a: Column, b: Column) -> Column:
    """Of two array columns, in the JVM."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(1e-8))


# An inverted file: cells around centroids, for corpora that no query can scan -------------


def centroids(sample: DataFrame, cells: int, most: int = 20_000, rounds: int = 12) -> np.ndarray:
    """Unit centroids of spherical k-means, fitted on at most ``most`` rows (id, vector) picked by a hash of the id."""
    n = sample.count()
    share = int(min(1.0, most / max(n, 1)) * 1_000_003)
    rows = sample.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) <= share).select("id", "vector").orderBy("id").limit(most).collect()
    m = np.array([r["vector"] for r in rows], np.float64)
    if not len(m):
        return np.empty((0, 0))
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    c = m[np.random.default_rng(7).permutation(len(m))[: min(cells, len(m))]]
    for _ in range(rounds):
        own = (m @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, own, m)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), c)
    return c


def nearest_cells(df: DataFrame, centers: np.ndarray, probes: int = 1) -> DataFrame:
    """``df`` (with a vector) once for each of its ``probes`` nearest cells, in the column ``cell``: the index of every row, or the cells that a query looks into."""
    shared = df.sparkSession.sparkContext.broadcast(centers)  # cells x dimensions, a parameter
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.compute.is_valid(batch.column(batch.schema.get_field_index("vector"))))
            if not batch.num_rows or not len(shared.value):
                continue
            v = np.array(batch.column(batch.schema.get_field_index("vector")).to_pylist(), np.float64)
            near = np.argsort(-(v @ shared.value.T), axis=1, kind="stable")[:, :probes]
            at = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns), pa.array(near.ravel().astype(np.int32))], names=[*batch.schema.names, "cell"])

    return df.mapInArrow(run, f"{fields}, cell int")


def knn_indexed(queries: DataFrame, indexed: DataFrame, centers: np.ndarray, k: int, probes: int) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest among the rows of the ``probes`` cells nearest to each query.

    A join by cell: only those cells' rows are compared.  All rows are in the index, so with as
    many probes as cells the result is exact.
    """
    from .search import top_k

    asked = nearest_cells(queries.select("query_id", F.col("vector")), centers, probes).withColumnRenamed("vector", "asked")
    pairs = asked.join(indexed.select("id", "vector", "cell"), "cell").select("query_id", "id", (1 - cosine(F.col("asked"), F.col("vector"))).alias("distance"))
    return top_k(pairs, k, F.round("distance", 12), F.col("id"))
