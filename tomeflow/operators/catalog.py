"""Catalogue and state: counts, coverage, discovery, registry, conversations, sessions, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filled(c: Column) -> Column:
    return c.isNotNull() & (F.trim(c) != "")


def coverage(df: DataFrame, fields: dict[str, Column], by: str | None = None) -> DataFrame:
    """Share of rows in per cent, two places, that have each field; 0.0 where there are no rows."""
    aggs = [F.coalesce(F.round(F.avg(F.when(c, 100.0).otherwise(0.0)), 2), F.lit(0.0)).alias(n) for n, c in fields.items()]
    return (df.groupBy(by) if by else df.groupBy()).agg(*aggs)


def subjects(df: DataFrame) -> DataFrame:
    """(subject, grades): subjects with their sorted distinct grades; a subject without grades stays."""
    grade = F.when(filled(F.col("grade")), F.trim("grade"))
    pairs = df.filter(filled(F.col("subject"))).select(F.trim("subject").alias("subject"), grade.alias("grade")).distinct()
    return pairs.groupBy("subject").agg(F.array_sort(F.collect_set("grade")).alias("grades"))


def structure(df: DataFrame, *by: str) -> DataFrame:
    """(*by, chapter, chapter_no, lessons): chapters in the order of their first page, lessons in theirs.

    ``df`` (*by, chapter, lesson, page, pos): rows without a page come last, ``pos`` breaks ties.
    """
    at = F.struct(F.coalesce("page", F.lit(2**31 - 1)).alias("page"), F.col("pos"))
    rows = df.filter(filled(F.col("chapter"))).select(*by, F.trim("chapter").alias("chapter"), F.when(filled(F.col("lesson")), F.trim("lesson")).alias("lesson"), at.alias("at"))
    each = rows.groupBy(*by, "chapter", "lesson").agg(F.min("at").alias("at"))
    whole = each.groupBy(*by, "chapter").agg(
        F.min("at").alias("at"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("lesson").isNotNull(), F.struct("at", "lesson")))), lambda x: x["lesson"]).alias("lessons"),
    )
    return whole.withColumn("chapter_no", F.row_number().over(Window.partitionBy(*by).orderBy("at"))).drop("at")


def latest_per_key(df: DataFrame, key: str, *newest_first: Column) -> DataFrame:
    """Keyed upsert: of the rows of a key the newest stays.  ``max_by`` combines in the tasks, so hot keys shuffle once a task."""
    order = F.struct(*newest_first)
    return df.groupBy(key).agg(F.max_by(F.struct(*(c for c in df.columns if c != key)), order).alias("row")).select(key, "row.*")


def new_files(incoming: DataFrame, registry: DataFrame, key: str = "content_hash") -> DataFrame:
    return incoming.join(registry.select(key).distinct(), key, "left_anti")


def stale_entries(registry: DataFrame, chunks: DataFrame, key: str = "file_reference_id") -> DataFrame:
    """Registry rows of which no chunk is indexed."""
    return registry.join(chunks.select(key).distinct(), key, "left_anti")


def conversation_summary(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """(session_id, turn_count, last_query, updated_at): turns recorded twice count once, the last recording holds."""
    once = latest_per_key(turns.withColumn("k", F.struct("session_id", "turn")), "k", F.col("recorded_at"), F.col("turn_key"))
    per = once.groupBy("session_id").agg(F.count(F.lit(1)).alias("turn_count"), F.max_by("query", F.struct("turn", "turn_key")).alias("last_query"))
    return sessions.select("session_id", "created_at", "updated_at", "file_name").join(per, "session_id", "left").withColumn("turn_count", F.coalesce("turn_count", F.lit(0)))


def last_turns(turns: DataFrame, n: int = 6) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy(F.desc("turn"), F.desc("turn_key"))
    return turns.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= n)


# Words that show that a question goes on from the one before, and the words before the lesson's place.
CUES = "هو|هي|هما|هم|عليه|عليها|عنه|عنها|بينهما|منهما|به|بها|طب|طيب|ليه|ازاي|مثال|وضح|فسر|قارن|اكتر|it|its|this|that|them|they|why|more|example"
LESSON_HINT = "سياق الدرس: "


def follow_up(turns: DataFrame, most_words: int = 4, cut: int = 300) -> DataFrame:
    """(turn_key, expanded, is_follow_up): a short question, or one with a cue, is followed by the previous question and answer.

    ``turns`` (turn_key, session_id, turn, query, answer[, chapter, lesson, section]): the place
    in the lesson, where given, comes last.  Lines that repeat one before and blank ones are left out.
    """
    w = Window.partitionBy("session_id").orderBy("turn", "turn_key")
    query = F.coalesce("query", F.lit(""))
    words = F.size(F.filter(F.split(query, r"\s+"), lambda x: x != ""))
    goes_on = (words <= most_words) | query.rlike(rf"(?i)(?:^|\s)(?:{CUES})(?:$|\s)")
    place = [F.when(F.col(c) != "", F.col(c)) for c in ("chapter", "lesson", "section") if c in turns.columns]
    hint = F.when(F.coalesce(*place).isNotNull(), F.concat(F.lit(LESSON_HINT), F.concat_ws(" - ", *place))) if place else F.lit(None).cast("string")
    marked = turns.withColumn("hint", hint).withColumn("prev", F.lag(F.struct("query", "answer")).over(w)).withColumn("is_follow_up", goes_on & F.col("prev").isNotNull())
    before = F.when(F.col("is_follow_up"), F.array("prev.query", F.substring("prev.answer", 1, cut))).otherwise(F.array().cast("array<string>"))
    lines = F.array_distinct(F.filter(F.concat(F.array(F.trim(query)), before, F.array("hint")), lambda x: x.isNotNull() & (x != "")))
    return marked.select("turn_key", F.array_join(lines, "\n").alias("expanded"), "is_follow_up")


def session_state(sessions: DataFrame, turns: DataFrame, most_turns: int = 6) -> DataFrame:
    """(session_id, file_reference_id, curriculum_id, version, turns): what a session knows, its last turns (user, assistant) in order."""
    last = last_turns(turns, most_turns).groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "turn_key", F.col("query").alias("user"), F.col("answer").alias("assistant")))), lambda x: F.struct(x["user"].alias("user"), x["assistant"].alias("assistant"))).alias("turns"))
    return sessions.select("session_id", "file_reference_id", "curriculum_id", "version").join(last, "session_id", "left")


def bound_elsewhere(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """Requests (session_id, file_reference_id, ...) for a session that is bound to another file."""
    known = sessions.select("session_id", F.col("file_reference_id").alias("bound"))
    return requests.join(known, "session_id").filter(F.col("file_reference_id").isNotNull() & (F.col("bound") != F.col("file_reference_id"))).drop("bound")


def resolved_requests(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """Requests with the file of their session where they name none; those that name another, or none at all, are left out."""
    known = sessions.select("session_id", F.col("file_reference_id").alias("bound"))
    joined = requests.join(known, "session_id", "left").filter(F.col("file_reference_id").isNull() | F.col("bound").isNull() | (F.col("bound") == F.col("file_reference_id")))
    return joined.withColumn("file_reference_id", F.coalesce("file_reference_id", "bound")).drop("bound").filter("file_reference_id IS NOT NULL")


def swept(sessions: DataFrame, seen: str, now: Column, ttl: int = 3600, most: int = 1000) -> DataFrame:
    """The sessions that stay: seen within ``ttl`` seconds, the ``most`` last seen of them.  Every task hands on at most ``most``."""
    alive = sessions.filter(F.unix_micros(now) - F.unix_micros(F.col(seen).cast("timestamp")) <= ttl * 1_000_000)
    return alive.orderBy(F.desc(seen), F.desc("session_id")).limit(most)


def append_turns(turns: DataFrame, new: DataFrame) -> DataFrame:
    """``turns`` and the new ones (session_id, ts, ...), numbered on from the last turn of their session in the order of time."""
    last = turns.groupBy("session_id").agg(F.max("turn").alias("last"))
    w = Window.partitionBy("session_id").orderBy("ts", "turn_key")
    numbered = new.drop("turn").join(last, "session_id", "left").withColumn("turn", (F.coalesce("last", F.lit(0)) + F.row_number().over(w)).cast("int")).drop("last")
    return turns.unionByName(numbered, allowMissingColumns=True)


def turn_numbers(turns: DataFrame) -> DataFrame:
    """(turn_key, turn_no): the place of each turn in its session, from 1."""
    return turns.select("turn_key", F.row_number().over(Window.partitionBy("session_id").orderBy("turn", "turn_key")).alias("turn_no"))


def conversation(sessions: DataFrame, turns: DataFrame, session_id: str) -> DataFrame:
    """One conversation with its turns in order; no row for one that is not known."""
    kept = [c for c in turns.columns if c != "session_id"]
    own = latest_per_key(turns.filter(F.col("session_id") == session_id).withColumn("k", F.col("turn")), "k", F.col("recorded_at"), F.col("turn_key")).drop("k")
    rows = own.groupBy().agg(F.array_sort(F.collect_list(F.struct("turn", *(c for c in kept if c != "turn")))).alias("turns"))
    return sessions.filter(F.col("session_id") == session_id).crossJoin(F.broadcast(rows))  # one row on either side


def record_of(files: DataFrame, registry: DataFrame) -> DataFrame:
    """``files`` (file_reference_id, ...) with the name and curriculum of their record, or nulls; the reference id stands for a missing name."""
    one = latest_per_key(registry.select("file_reference_id", "file_name", "curriculum_id", "registered_at"), "file_reference_id", F.col("registered_at"), F.col("file_name")).drop("registered_at")
    return files.join(one, "file_reference_id", "left").withColumn("file_name", F.coalesce("file_name", "file_reference_id"))


def totals(files: DataFrame, chunks: DataFrame, questions_: DataFrame) -> DataFrame:
    """(files, chunks, questions): how many of each there are."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n(files, "files").crossJoin(n(chunks, "chunks")).crossJoin(n(questions_, "questions"))  # one row each


def valid_chunks(chunks: DataFrame, least: int = 20) -> DataFrame:
    """Chunks (raw_text, normalized_text) with single spaces; those of fewer than ``least`` characters are left out, a missing normalized text is the raw one."""
    single = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    text = chunks.withColumn("raw_text", single(F.col("raw_text")))
    normal = F.coalesce(F.when(F.col("normalized_text") != "", F.col("normalized_text")), F.col("raw_text")) if "normalized_text" in chunks.columns else F.col("raw_text")
    return text.withColumn("normalized_text", single(normal)).filter(F.length("raw_text") >= least)


def previous(df: DataFrame, by: str, at: str, key: str, width: int = 200) -> DataFrame:
    """``df`` with ``previous``: the value of ``at`` in the row before, in the order of (at, key) within ``by``; null in the first row.

    ``at`` is a number.  The rows are taken in ranges of ``width``, so that a ``by`` with very many
    rows is spread over tasks; a range's first row looks at the last one of the ranges before,
    of which one row each is left.
    """
    ranged = df.withColumn("range", F.floor(F.col(at) / width))
    last = ranged.groupBy(by, "range").agg(F.max(at).alias("last"))
    w = Window.partitionBy(by).orderBy("range")
    border = last.select(by, "range", F.lag("last").over(w).alias("border"))
    inner = F.lag(at).over(Window.partitionBy(by, "range").orderBy(at, key))
    joined = ranged.withColumn("inner", inner).join(border.withColumnRenamed(by, "by_").withColumnRenamed("range", "range_"), F.col(by).eqNullSafe(F.col("by_")) & (F.col("range") == F.col("range_")), "left")
    return joined.withColumn("previous", F.coalesce("inner", "border")).drop("range", "range_", "by_", "inner", "border")


def seen_before(df: DataFrame, by: str, order: list[Column], hit: Column) -> DataFrame:
    """``df`` with ``seen``: has a row with ``hit`` come at or before this one?  The first hit of each ``by`` is found by an aggregate that combines in the tasks; nothing is sorted."""
    place = F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order)))
    first = df.filter(hit).groupBy(F.col(by).alias("by_")).agg(F.min(place).alias("first"))
    return df.withColumn("place", place).join(first, F.col(by).eqNullSafe(F.col("by_")), "left").withColumn("seen", F.coalesce(F.col("place") >= F.col("first"), F.lit(False))).drop("by_", "first", "place")


def sessions_by_gap(events: DataFrame, key: str, ts: str, ttl: int = 3600) -> DataFrame:
    """(key, session_no, started, ended, events): a gap of more than ``ttl`` seconds ends a session."""
    w = Window.partitionBy(key).orderBy(ts)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(F.col(ts)).over(w).cast("timestamp")) > ttl * 1_000_000
    numbered = events.withColumn("session_no", F.sum(F.coalesce(gap, F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(key, "session_no").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count(F.lit(1)).alias("events"))


def questions(df: DataFrame, limit: int = 6) -> DataFrame:
    """(id, no, question): hypothetical questions of each chunk (id, text, heading), from bold terms, heading and definitions."""
    strip = lambda c: F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")), r"^[ .:\-–—#]+", ""), r"[ .:\-–—#]+$", "")
    terms = F.slice(F.array_distinct(F.filter(F.transform(F.regexp_extract_all("text", F.lit(r"\*\*([^*]{2,100})\*\*"), 1), strip), lambda t: t != "")), 1, 4)
    head = strip(F.col("heading"))
    about = F.flatten(F.transform(terms, lambda t: F.array(F.concat(F.lit("ما هو "), t, F.lit("؟")), F.concat(F.lit("ما المقصود بـ "), t, F.lit("؟")))))
    by_heading = F.when(head != "", F.array(F.concat(F.lit("ما الذي يشرحه "), head, F.lit("؟")))).otherwise(F.array().cast("array<string>"))
    defines = F.col("text").rlike(r".{20}(?:هو|هي|تعني|يعني|يسمى|:)")
    by_definition = F.when(defines, F.array(F.concat(F.lit("ما المقصود بـ "), F.when(head != "", head).otherwise("هذا المفهوم"), F.lit("؟")))).otherwise(F.array().cast("array<string>"))
    every = F.slice(F.array_distinct(F.concat(about, by_heading, by_definition)), 1, limit)
    return df.select("id", F.posexplode(every).alias("no", "question"))
