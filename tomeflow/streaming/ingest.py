"""Incremental ingestion and sessions as streams.

The store is a folder of Parquet tables, each written one folder a batch: ``chunks``,
``parents``, ``questions``, ``registry``, ``forgotten``, ``status`` and ``errors``.  A batch that
is run again after a failure writes the same folders again, so nothing is doubled; readers take
the newest row of a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import detect_language
from ..operators import bookmeta
from ..operators.catalog import coverage, filled, latest_per_key, questions, totals
from ..operators.chunking import chunk, placed
from ..sources.loaders import documents

FILES = "path string, modificationTime timestamp, length bigint, content binary"
NEWEST = "batch"


def table(spark: SparkSession, store: str, name: str, before: int | None = None) -> DataFrame | None:
    """A table of the store, all batches (or those before one); None if nothing has been written."""
    try:
        df = spark.read.option("mergeSchema", "true").parquet(f"{store}/{name}")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    return df if before is None else df.filter(F.col(NEWEST) != before)


def registry(spark: SparkSession, store: str, before: int | None = None) -> DataFrame | None:
    """The newest record of each content that has not been forgotten since."""
    df = table(spark, store, "registry", before)
    if df is None:
        return None
    newest = latest_per_key(df.withColumn("at", F.col(NEWEST)), "content_hash", F.col("at")).drop("at")
    gone = table(spark, store, "forgotten", before)
    if gone is None:
        return newest
    last = gone.groupBy("content_hash").agg(F.max(NEWEST).alias("gone"))
    return newest.join(last, "content_hash", "left").filter(F.col("gone").isNull() | (F.col("gone") <= F.col(NEWEST))).drop("gone")


def forget(spark: SparkSession, store: str, content_hashes: DataFrame, number: int) -> None:
    """Takes contents (content_hash) out of the registry: their next upload is ingested again."""
    content_hashes.select("content_hash").distinct().write.mode("overwrite").parquet(f"{store}/forgotten/batch={number}")


def stale(spark: SparkSession, store: str, before: int | None = None) -> DataFrame | None:
    """Records of the registry of which no chunk is stored (any more)."""
    known, chunks = registry(spark, store, before), table(spark, store, "chunks", before)
    if known is None or chunks is None:
        return known
    return known.join(chunks.select(F.col("file_reference_id")).distinct(), "file_reference_id", "left_anti")


def take_batch(spark: SparkSession, files: DataFrame, store: str, number: int, force: bool = False) -> None:
    """One batch of files (as ``binaryFile`` gives them) into the store.

    A content that the registry has, and of which chunks are stored, is skipped unless
    ``force``; if its chunks are gone it is ingested again under its former reference.  Every
    file gets a row of ``status``: completed, duplicate_skipped or failed with its error.
    """
    docs = documents(files).persist()
    name = F.element_at(F.split("source", "/"), -1)
    first = docs.groupBy("source").agg(F.first("content_hash").alias("content_hash"), F.max("error").alias("error"), F.first(name).alias("file_name"))
    known = None if force else registry(spark, store, number)
    # Of copies within the batch the first by path is ingested.
    one = first.filter("error IS NULL").groupBy("content_hash").agg(F.min("source").alias("source"))
    reference = F.concat(F.lit("file_"), F.substring("content_hash", 1, 24))
    if known is None:
        fresh = one.withColumn("file_reference_id", reference)
    else:
        old = known.select("content_hash", F.col("file_reference_id").alias("former"))
        gone = stale(spark, store, number).select("content_hash", F.lit(True).alias("gone"))
        joined = one.join(old, "content_hash", "left").join(gone, "content_hash", "left")
        fresh = joined.filter(F.col("former").isNull() | F.col("gone")).select("content_hash", "source", F.coalesce("former", reference).alias("file_reference_id"))
    fresh = fresh.persist()
    rows = docs.filter("text IS NOT NULL").join(fresh, ["content_hash", "source"]).withColumn("file_name", name)
    as_pages = rows.select(F.col("file_reference_id").alias("book"), F.col("doc_idx").alias("at"), F.lit(0).alias("copy"), "text")
    names = rows.filter("doc_idx = 0").select(F.col("file_reference_id").alias("book"), "file_name", F.element_at("metadata", F.lit("language")).alias("language"))
    books = bookmeta.book_metadata(as_pages, names).persist()
    pages = rows.select(F.concat_ws("#", "file_reference_id", F.col("doc_idx").cast("string")).alias("doc_id"), "text", F.col("file_reference_id").alias("book"), F.col("doc_idx").alias("at"), F.lit(0).alias("copy"))
    made = chunk(placed(pages)).withColumn("file_reference_id", F.regexp_extract("doc_id", r"^(.*)#\d+$", 1)).join(
        books.select(F.col("book").alias("file_reference_id"), "curriculum_id", F.col("subject").alias("book_subject"), F.col("grade").alias("book_grade"), "term", "document_title"), "file_reference_id", "left"
    )
    made = made.withColumn("subject", F.coalesce("subject", "book_subject")).withColumn("grade", F.coalesce("grade", "book_grade")).drop("book_subject", "book_grade").withColumn("version", F.lit("v1")).withColumn("language", detect_language(F.col("raw_text")))
    made.drop("parent_text", "parent_content_type").write.mode("overwrite").parquet(f"{store}/chunks/batch={number}")
    parents = made.groupBy("parent_chunk_id").agg(F.first("parent_text").alias("parent_text"), F.first("file_reference_id").alias("file_reference_id"), F.first("heading").alias("heading"), F.first("heading_path").alias("heading_path"), F.first("parent_content_type").alias("content_type"))
    parents.write.mode("overwrite").parquet(f"{store}/parents/batch={number}")
    written = spark.read.parquet(f"{store}/chunks/batch={number}")
    asked = questions(written.select(F.col("chunk_id").alias("id"), F.col("raw_text").alias("text"), "heading"))
    asked = asked.join(written.select(F.col("chunk_id").alias("id"), "file_reference_id", "parent_chunk_id"), "id").select(F.concat_ws("::", F.lit("q"), "id", F.col("no").cast("string")).alias("question_id"), "question", F.col("id").alias("chunk_id"), "parent_chunk_id", "file_reference_id")
    asked.write.mode("overwrite").parquet(f"{store}/questions/batch={number}")
    counts = written.groupBy("file_reference_id").agg(F.count(F.lit(1)).alias("chunks_created"))
    asks = spark.read.parquet(f"{store}/questions/batch={number}").groupBy("file_reference_id").agg(F.count(F.lit(1)).alias("indexed_question_count"))
    record = fresh.join(first.select("source", "file_name"), "source").join(books.withColumnRenamed("book", "file_reference_id").drop("sources", "confidence"), "file_reference_id", "left").join(counts, "file_reference_id", "left").join(asks, "file_reference_id", "left")
    record.na.fill(0, ["chunks_created", "indexed_question_count"]).write.mode("overwrite").parquet(f"{store}/registry/batch={number}")
    state = F.when(F.col("error").isNotNull(), "failed").when(F.col("taken"), "completed").otherwise("duplicate_skipped")
    status = first.join(fresh.select("source", F.lit(True).alias("taken")), "source", "left").select("source", "file_name", "content_hash", state.alias("status"), "error")
    status.write.mode("overwrite").parquet(f"{store}/status/batch={number}")
    docs.filter("error IS NOT NULL").select("source", "content_hash", "error").write.mode("overwrite").parquet(f"{store}/errors/batch={number}")
    for df in (docs, fresh, books):
        df.unpersist()


def ingest_new_files(spark: SparkSession, inbox: str, store: str, checkpoint: str, force: bool = False) -> None:
    """Takes the files that have come into ``inbox`` since the last call, whatever their number, and returns."""
    stream = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(inbox)
    q = stream.writeStream.foreachBatch(lambda batch, number: take_batch(spark, batch, store, number, force)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def ingest(spark: SparkSession, path: str, store: str, number: int, force: bool = False) -> DataFrame:
    """One batch without a stream: all files under ``path``; returns its summary."""
    take_batch(spark, spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), store, number, force)
    return summary(spark, store, number)


def summary(spark: SparkSession, store: str, number: int) -> DataFrame:
    """One row of a batch: files, chunks, questions, chunks by language, per cent of chunks with a subject, grade, heading and path."""
    part = lambda name: spark.read.parquet(f"{store}/{name}/batch={number}")
    chunks = part("chunks")
    langs = chunks.groupBy("language").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("language", "n")))).alias("language_counts"))
    share = coverage(chunks, {x: filled(F.col(x)) for x in ("subject", "grade", "heading")} | {"heading_path": F.coalesce(F.size("heading_path") > 0, F.lit(False))})
    return totals(part("status").filter("status = 'completed'"), chunks, part("questions")).crossJoin(langs).crossJoin(share)  # one row each


def jobs(spark: SparkSession, store: str) -> DataFrame | None:
    """The newest status of every file."""
    df = table(spark, store, "status")
    return None if df is None else latest_per_key(df.withColumn("at", F.col(NEWEST)), "source", F.col("at")).drop("at")


def session_stream(turns: DataFrame, ttl: str = "3600 seconds", late: str = "1 hour") -> DataFrame:
    """(session_id, started, ended, turns) of a stream of turns (session_id, ts): idle longer than ``ttl`` ends a session."""
    return (
        turns.withWatermark("ts", late).groupBy("session_id", F.session_window("ts", ttl).alias("w")).agg(F.count(F.lit(1)).alias("turns"))
        .select("session_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "turns")
    )
