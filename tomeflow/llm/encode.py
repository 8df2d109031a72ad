"""Problem 7: encoding a corpus with a public byte-pair tokenizer.

A pre-token is encoded over a segment tree: leaf ``i`` holds the rank of the pair that
starts at part ``i``, every inner node the lower of its children (the left one on a tie),
so the root is the leftmost lowest-rank merge.  A merge changes at most three leaves, each
in logarithmic time; it ends when the root holds no rank.  A pre-token of n bytes thus
takes O(n log n), however long it is.

Null, empty: an empty list of ids.  Blank texts are encoded as they are.  Extra columns
pass through ``encode`` untouched, whatever they are called.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CACHE, table, tokenizers_dir

# Fixed value: the published split pattern of the byte_bpe_50k tokenizer.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

NONE = 1 << 62


def merge_ranks(piece: bytes, rank: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token by merges from a segment tree over the pairs' ranks."""
    n = len(piece)
    if n < 2:
        return [rank[piece]] if n else []
    width = 1
    while width < n - 1:
        width *= 2
    after = list(range(1, n + 1))  # after[i]: start of the part that follows the part at i
    before = list(range(-1, n - 1))
    tree = [NONE] * (2 * width)
    # A node's key is rank * n + position: the least key is the lowest rank, leftmost.
    for i in range(n - 1):
        r = rank.get(piece[i : i + 2])
        if r is not None:
            tree[width + i] = r * n + i
    for k in range(width - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(i: int, key: int) -> None:
        k = width + i
        tree[k] = key
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            low = a if a < b else b
            if tree[k] == low:
                return
            tree[k] = low
            k >>= 1

    def pair(i: int) -> int:
        j = after[i]
        if j >= n:
            return NONE
        r = rank.get(piece[i : after[j]])
        return NONE if r is None else r * n + i

    while tree[1] != NONE:
        i = tree[1] % n
        j = after[i]
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        if j < n - 1:
            put(j, NONE)
        if i < n - 1:
            put(i, pair(i))
        if before[i] >= 0:
            put(before[i], pair(before[i]))
    ids, i = [], 0
    while i < n:
        ids.append(rank[piece[i : after[i]]])
        i = after[i]
    return ids


class Encoder:
    """A byte-pair tokenizer read from a rank file (one base64 token and its rank a line)."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.split = regex.compile(SPLIT)
        self.known: dict[str, list[int]] = {}

    def __call__(self, text: str | None) -> list[int]:
        if not text:
            return []
        ids: list[int] = []
        known = self.known
        for word in self.split.findall(text):
            got = known.get(word)
            if got is None:
                got = merge_ranks(word.encode("utf-8", "surrogatepass"), self.rank)
                if len(word) <= 64:
                    if len(known) >= CACHE:
                        known.clear()
                    known[word] = got
            ids += got
        return ids


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def vocabulary(tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> str:
    return str(Path(tokenizers_dir(folder)) / f"{tokenizer}.tiktoken")


def encode(df: DataFrame, text: str = "text", ids: str = "ids", tokenizer: str = "byte_bpe_50k", folder: str | None = None, count_only: bool = False) -> DataFrame:
    """``df`` with a column ``ids`` (array of int), or the number of ids if ``count_only``.

    The texts go through Arrow batches once, without a shuffle.  A column of ``df`` that is
    already called ``ids`` is replaced.
    """
    path = vocabulary(tokenizer, folder)
    kept = [f for f in df.schema.fields if f.name != ids]
    out = T.StructType([*kept, T.StructField(ids, T.IntegerType() if count_only else T.ArrayType(T.IntegerType(), False))])
    kind = pa.int32() if count_only else pa.list_(pa.field("element", pa.int32(), nullable=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            made = pa.array([len(enc(x)) for x in texts] if count_only else [enc(x) for x in texts], kind)
            keep = [i for i, n in enumerate(batch.schema.names) if n != ids]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), made], names=[*(batch.schema.names[i] for i in keep), ids])

    return df.mapInArrow(run, out)


def decode(ids: list[int], path: str) -> str:
    """The text of ids, for round trips."""
    back = {i: t for t, i in encoder(path).rank.items()}
    return b"".join(back[i] for i in ids).decode("utf-8", "replace")


def tokens(df: DataFrame, text: str = "text", out: str = "tokens") -> DataFrame:
    """``df`` with its texts' sizes in tokens."""
    return encode(df, text, out, count_only=True)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ids) of every document, in the tokenizer byte_bpe_50k."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs).select("doc_id", "ids")


def p7_source_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, characters and tokens of each source."""
    docs = table(spark, sf_dir, "documents").select("source", "text")
    size: Column = F.length("text")
    return (
        tokens(docs)
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(size), F.lit(0)).alias("chars"), F.sum("tokens").alias("tokens"))
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p7_ids": p7_ids, "p7_source_tokens": p7_source_tokens}
ORACLE: dict[str, str] = {}
