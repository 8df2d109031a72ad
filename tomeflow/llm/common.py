"""Shared plumbing of the llm operators: tables, shared checkpoints, bounded tables for workers."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage of ``df`` in the folder of ``spark.checkpoint.dir``.

    The cluster names a folder that all executors share.  Only a session whose executors are
    this very process (master ``local``) gets a temporary one if none is named; any other
    without the setting is refused, as its executors would write where no other can read.
    """
    spark = df.sparkSession
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        configured = spark.conf.get("spark.checkpoint.dir", "")
        if not configured and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(configured or tempfile.mkdtemp(prefix="tomeflow-checkpoint-"))
    return df.checkpoint(eager=True)


def map_rows(
    df: DataFrame,
    make: Callable[[], Callable[[dict[str, list]], dict[str, list]]],
    schema: pa.Schema | str,
    ddl: str,
    after: Callable[[Any], dict[str, list] | None] | None = None,
) -> DataFrame:
    """Arrow batches through a Python function: ``make`` is called once a task.

    The function gets the columns of a batch as Python lists and returns the columns of the
    result.  ``after`` (if given) is called with the same function at the end of the task
    and may return a last batch, which is how partial aggregates are emitted.
    """
    target = schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            columns = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            out = one(columns)
            if out is not None and len(next(iter(out.values()), ())):
                yield pa.RecordBatch.from_pydict(out, schema=target)
        if after is not None:
            out = after(one)
            if out is not None and len(next(iter(out.values()), ())):
                yield pa.RecordBatch.from_pydict(out, schema=target)

    return df.mapInArrow(run, ddl)


class Counts:
    """Partial counts of a task that are handed on before they outgrow ``flush`` keys."""

    def __init__(self, flush: int = 400_000) -> None:
        self.n: dict[Any, int] = {}
        self.flush = flush

    def add(self, keys: Any) -> None:
        n = self.n
        for k in keys:
            n[k] = n.get(k, 0) + 1

    @property
    def full(self) -> bool:
        return len(self.n) > self.flush

    def drain(self) -> list[tuple[Any, int]]:
        items = list(self.n.items())
        self.n = {}
        return items


def bounded_rows(df: DataFrame, bound: int) -> list:
    """The rows of a table that is to have at most ``bound`` rows; the bound is checked, not assumed."""
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"a table of at most {bound} rows was expected")
    return rows


#: Python caches of one worker are emptied beyond this many keys.
CACHE = 200_000


def ordinal_lines(text: str) -> list[str]:
    return re.split(r"\r\n|\n|\r", text)


def tokenizers_dir(path: str | None = None) -> str:
    """Folder of the public tokenizer vocabularies: argument, then TOKENIZERS_DIR, then /opt/tokenizers."""
    return path or os.environ.get("TOKENIZERS_DIR") or "/opt/tokenizers"
