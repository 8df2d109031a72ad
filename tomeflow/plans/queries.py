"""Queries over the test tables, one or more for each operator, with the same results in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers as A
from ..operators import bookmeta as M
from ..operators import catalog as C
from ..operators import embedding as V
from ..operators import evaluate as E
from ..operators import search as S
from ..operators import structure as P
from ..operators import toc as TOC
from ..operators.chunking import chunk, placed
from ..session import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function as the query of its name, with its SQL."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LANG_SQL = """CASE WHEN {c} IS NULL THEN 'unknown' WHEN a > 0 AND l > 0 THEN CASE WHEN a >= 3 * l THEN 'ar' ELSE 'mixed' END WHEN a > 0 THEN 'ar' WHEN l > 0 THEN 'en' ELSE 'unknown' END"""
_COUNTS_SQL = r"len(regexp_extract_all({c}, '[\x{600}-\x{6ff}]')) AS a, len(regexp_extract_all({c}, '[A-Za-z]')) AS l"


@query(f"SELECT language, count(*) AS n FROM (SELECT {_LANG_SQL.format(c='text')} AS language FROM (SELECT text, {_COUNTS_SQL.replace('{c}', 'text')} FROM documents)) GROUP BY 1")
def language_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents by the script-based language of their text."""
    return t(spark, d, "documents").select(T.detect_language(F.col("text")).alias("language")).groupBy("language").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT round(avg(CASE WHEN trim(metadata.subject) <> '' THEN 100.0 ELSE 0.0 END), 2) AS subject, round(avg(CASE WHEN trim(metadata.grade) <> '' THEN 100.0 ELSE 0.0 END), 2) AS grade,
round(avg(CASE WHEN trim(metadata.heading) <> '' THEN 100.0 ELSE 0.0 END), 2) AS heading, round(avg(CASE WHEN len(metadata.heading_path) > 0 THEN 100.0 ELSE 0.0 END), 2) AS heading_path FROM rag_chunks""")
def metadata_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per cent of chunks with a subject, grade, heading and heading path."""
    m = t(spark, d, "rag_chunks").select("metadata.*")
    return C.coverage(m, {x: C.filled(F.col(x)) for x in ("subject", "grade", "heading")} | {"heading_path": F.coalesce(F.size("heading_path") > 0, F.lit(False))})


_TYPE_SQL = " ".join(f"WHEN regexp_matches(x, '(?i){p}') THEN '{k}'" for k, p in T.TYPE_WORDS.items())


@query(rf"SELECT CASE {_TYPE_SQL} WHEN regexp_matches(x, '\|.*\|') THEN 'table' ELSE 'paragraph' END AS content_type, count(*) AS n FROM (SELECT regexp_replace(coalesce(text, ''), '\s+', ' ', 'g') AS x FROM documents) GROUP BY 1")
def content_type_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents by content type."""
    return t(spark, d, "documents").select(T.content_type(F.col("text")).alias("content_type")).groupBy("content_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The first document of every distinct text."""
    return t(spark, d, "documents").filter("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query("SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY metadata.file_reference_id, coalesce(CAST(metadata.page AS VARCHAR), ''), left(raw_text, 60) ORDER BY row_id) AS rn FROM rag_chunks) WHERE rn = 1")
def candidate_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The first chunk of every file, page and beginning."""
    rows = t(spark, d, "rag_chunks").select("row_id", F.col("metadata.file_reference_id").alias("f"), F.coalesce(F.col("metadata.page").cast("string"), F.lit("")).alias("p"), F.substring("raw_text", 1, 60).alias("b"))
    return rows.groupBy("f", "p", "b").agg(F.min("row_id").alias("row_id")).select("row_id")


def latest_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The chunk table after all ingests: (id, book, page, text, heading, content_type, parent_id, source, chapter, lesson, heading_path), id the row of the last ingest."""
    c = t(spark, d, "rag_chunks").select("chunk_id", "row_id", "ingested_at", F.col("raw_text").alias("text"), F.col("parent_chunk_id").alias("parent_id"), "metadata")
    last = C.latest_per_key(c, "chunk_id", F.col("ingested_at"), F.col("row_id"))
    m = lambda n: F.col(f"metadata.{n}").alias(n)
    return last.select(F.col("row_id").alias("id"), F.col("metadata.file_reference_id").alias("book"), m("page"), "text", m("heading"), m("content_type"), "parent_id", m("source"), m("chapter"), m("lesson"), m("heading_path"), "chunk_id")


def corpus_tokens(chunks: DataFrame) -> DataFrame:
    """(id, book, tokens) of the chunks, the heading three times before the text."""
    h = F.coalesce(F.col("heading"), F.lit(""))
    return chunks.select("id", "book", T.lex_tokens(F.concat(h, F.lit(" "), h, F.lit(" "), h, F.lit(" "), F.coalesce("text", F.lit("")))).alias("tokens"))


def asking_turns(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, book, query, session_id): every turn whose key is divisible by 50 asks the file of its session."""
    files = t(spark, d, "sessions").select("session_id", F.col("file_reference_id").alias("book"))
    return S.isolated(t(spark, d, "turns").filter("turn_key % 50 = 0").select(F.col("turn_key").alias("query_id"), "query", "session_id").join(files, "session_id"))


def query_tokens(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, book, tokens) of the asking turns."""
    return asking_turns(spark, d).select("query_id", "book", T.lex_tokens(F.col("query")).alias("tokens"))


_LAST_SQL = "l AS (SELECT * FROM (SELECT row_id AS id, metadata.file_reference_id AS book, metadata.page AS page, raw_text AS text, metadata.heading AS heading, metadata.content_type AS kind, parent_chunk_id AS parent_id, metadata.source AS source, chunk_id, row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC, row_id DESC) AS newest FROM rag_chunks) WHERE newest = 1)"
_HEAD_SQL = "coalesce(heading, '') || ' ' || coalesce(heading, '') || ' ' || coalesce(heading, '') || ' ' || coalesce(text, '')"
_BM25_SQL = f"""WITH {_LAST_SQL},
a AS (SELECT turn_key AS query_id, query, file_reference_id AS book FROM turns JOIN sessions USING (session_id) WHERE turn_key % 50 = 0 AND trim(file_reference_id) <> ''),
c AS (SELECT id, book, {T.sql_tokens('x')} AS tokens FROM (SELECT id, book, {_HEAD_SQL} AS x FROM l WHERE book IN (SELECT book FROM a))),
q AS (SELECT query_id, book, {T.sql_tokens('query')} AS tokens FROM a),
s AS (SELECT book, count(*) AS n, avg(len(tokens)) AS avgdl FROM c GROUP BY 1),
w AS (SELECT query_id, book, term, count(*) AS qtf FROM (SELECT query_id, book, unnest(tokens) AS term FROM q) GROUP BY 1, 2, 3),
p AS (SELECT book, term, id, dl, count(*) AS tf FROM (SELECT id, book, len(tokens) AS dl, unnest(tokens) AS term FROM c) WHERE (book, term) IN (SELECT (book, term) FROM w) GROUP BY 1, 2, 3, 4),
f AS (SELECT book, term, count(*) AS df FROM p GROUP BY 1, 2),
x AS (SELECT query_id, id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / greatest(tf + 1.2 * (0.25 + 0.75 * dl / greatest(avgdl, 1)), 1e-9)), 6) AS score FROM p JOIN f USING (book, term) JOIN s USING (book) JOIN w USING (book, term) GROUP BY 1, 2),
r AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM x WHERE score > 0)"""


@query(_BM25_SQL + " SELECT query_id, id, score, rank FROM r WHERE rank <= 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten best chunks of its file for every asking turn, by keywords."""
    return S.bm25(query_tokens(spark, d), corpus_tokens(latest_chunks(spark, d)), 10)


_KNN_SQL = "SELECT q.vec_id AS query_id, c.vec_id AS id, round(1 - list_dot_product(q.v, c.v) / greatest(sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v)), 1e-8), 6) + 0.0 AS distance FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) c JOIN (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 50 = 0) q ON {on}"
_KNN_TOP = "SELECT query_id, id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM ({x})) WHERE rank <= 10"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _knn(spark: SparkSession, d: str, same: tuple[str, ...]) -> DataFrame:
    v = _vectors(spark, d)
    found = S.knn(v.filter("id % 50 = 0").withColumnRenamed("id", "query_id"), v, 10, same)
    return found.select("query_id", "id", (F.round("distance", 6) + 0.0).alias("distance"), "rank")


@query(_KNN_TOP.format(x=_KNN_SQL.format(on="true")))
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors of every fiftieth one."""
    return _knn(spark, d, ())


@query(_KNN_TOP.format(x=_KNN_SQL.format(on="q.label = c.label")))
def knn_by_label(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors with the same label."""
    return _knn(spark, d, ("label",))


@query("SELECT subject, list_sort(list(DISTINCT grade) FILTER (WHERE grade IS NOT NULL)) AS grades FROM (SELECT trim(subject) AS subject, CASE WHEN trim(grade) <> '' THEN trim(grade) END AS grade FROM books WHERE trim(subject) <> '') GROUP BY 1".replace("list_sort(", "coalesce(list_sort(").replace("IS NOT NULL))", "IS NOT NULL)), [])"))
def subject_tree(spark: SparkSession, d: str) -> DataFrame:
    """Subjects with their grades."""
    return C.subjects(t(spark, d, "books"))


@query("SELECT DISTINCT trim(grade) AS grade FROM books WHERE trim(grade) <> ''")
def grades(spark: SparkSession, d: str) -> DataFrame:
    """All grades."""
    return t(spark, d, "books").filter(C.filled(F.col("grade"))).select(F.trim("grade").alias("grade")).distinct()


@query("""WITH r AS (SELECT metadata.file_reference_id AS book, trim(metadata.chapter) AS chapter, CASE WHEN trim(metadata.lesson) <> '' THEN trim(metadata.lesson) END AS lesson, coalesce(metadata.page, 2147483647) AS page, row_id AS pos FROM rag_chunks WHERE trim(metadata.chapter) <> ''),
e AS (SELECT book, chapter, lesson, min({'page': page, 'pos': pos}) AS loc FROM r GROUP BY 1, 2, 3),
c AS (SELECT book, chapter, min(loc) AS loc, coalesce(list(lesson ORDER BY loc) FILTER (WHERE lesson IS NOT NULL), []) AS lessons FROM e GROUP BY 1, 2)
SELECT book, chapter, CAST(row_number() OVER (PARTITION BY book ORDER BY loc) AS INTEGER) AS chapter_no, lessons FROM c""")
def structure_tree(spark: SparkSession, d: str) -> DataFrame:
    """Chapters and lessons of every book in page order."""
    m = t(spark, d, "rag_chunks").select(F.col("metadata.file_reference_id").alias("book"), "metadata.chapter", "metadata.lesson", "metadata.page", F.col("row_id").alias("pos"))
    return C.structure(m, "book").select("book", "chapter", "chapter_no", "lessons")


@query("SELECT chunk_id, row_id, language FROM (SELECT chunk_id, row_id, metadata.language AS language, row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC, row_id DESC) AS rn FROM rag_chunks) WHERE rn = 1")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """The chunk table after all ingests: the last row of each chunk id."""
    rows = t(spark, d, "rag_chunks").select("chunk_id", "row_id", F.col("metadata.language").alias("language"), "ingested_at")
    return C.latest_per_key(rows, "chunk_id", F.col("ingested_at"), F.col("row_id")).select("chunk_id", "row_id", "language")


@query("SELECT file_reference_id, content_hash FROM books WHERE content_hash NOT IN (SELECT content_hash FROM books WHERE registered_at < TIMESTAMP '2024-10-01')")
def new_file_scan(spark: SparkSession, d: str) -> DataFrame:
    """Files whose content was not registered before October 2024."""
    b = t(spark, d, "books")
    return C.new_files(b, b.filter("registered_at < TIMESTAMP '2024-10-01'")).select("file_reference_id", "content_hash")


@query("SELECT file_reference_id FROM books WHERE file_reference_id NOT IN (SELECT metadata.file_reference_id FROM rag_chunks WHERE metadata.file_reference_id IS NOT NULL AND metadata.content_type = 'table')")
def stale_registry(spark: SparkSession, d: str) -> DataFrame:
    """Registered files of which no chunk of a table is indexed."""
    chunks = t(spark, d, "rag_chunks").filter("metadata.content_type = 'table'")
    return C.stale_entries(t(spark, d, "books"), chunks.select(F.col("metadata.file_reference_id").alias("file_reference_id"))).select("file_reference_id")


@query("SELECT content_hash, file_reference_id, file_name, registered_at FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY registered_at DESC, file_reference_id DESC) AS rn FROM books) WHERE rn = 1")
def library(spark: SparkSession, d: str) -> DataFrame:
    """The registry, the newest record of each content."""
    b = t(spark, d, "books").select("content_hash", "file_reference_id", "file_name", "registered_at")
    return C.latest_per_key(b.withColumn("ref", F.col("file_reference_id")), "content_hash", F.col("registered_at"), F.col("ref")).drop("ref")


@query("""WITH o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, turn ORDER BY recorded_at DESC NULLS LAST, turn_key DESC) AS rn FROM turns) WHERE rn = 1),
p AS (SELECT session_id, count(*) AS turn_count, arg_max(query, {'t': turn, 'k': turn_key}) AS last_query FROM o GROUP BY 1)
SELECT s.session_id, created_at, updated_at, file_name, coalesce(turn_count, 0) AS turn_count, last_query FROM sessions s LEFT JOIN p USING (session_id)""")
def conversation_summary(spark: SparkSession, d: str) -> DataFrame:
    """Sessions with their number of turns and last question."""
    return C.conversation_summary(t(spark, d, "sessions"), t(spark, d, "turns")).select("session_id", "created_at", "updated_at", "file_name", "turn_count", "last_query")


@query("SELECT session_id, turn, turn_key, CAST(back AS INTEGER) AS back FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC, turn_key DESC) AS back FROM turns) WHERE back <= 6")
def last_turns(spark: SparkSession, d: str) -> DataFrame:
    """The last six turns of each session."""
    return C.last_turns(t(spark, d, "turns")).select("session_id", "turn", "turn_key", "back")


# Written out from the public behaviour, not from the operator's constants.
_CUES_SQL = "هو|هي|هما|هم|عليه|عليها|عنه|عنها|بينهما|منهما|به|بها|طب|طيب|ليه|ازاي|مثال|وضح|فسر|قارن|اكتر|it|its|this|that|them|they|why|more|example"


@query(rf"""WITH x AS (SELECT turn_key, trim(coalesce(query, '')) AS q, lag(query) OVER w AS pq, left(lag(answer) OVER w, 300) AS pa, row_number() OVER w > 1 AS later,
len(list_filter(regexp_split_to_array(coalesce(query, ''), '\s+'), lambda v: v <> '')) <= 4 OR regexp_matches(coalesce(query, ''), '(?i)(?:^|\s)(?:{_CUES_SQL})(?:$|\s)') AS goes_on FROM turns WINDOW w AS (PARTITION BY session_id ORDER BY turn, turn_key)),
y AS (SELECT *, goes_on AND later AS is_follow_up FROM x)
SELECT turn_key, is_follow_up, CASE WHEN is_follow_up THEN array_to_string(list_filter([q, CASE WHEN pq IS DISTINCT FROM q THEN pq END, CASE WHEN pa IS DISTINCT FROM q AND pa IS DISTINCT FROM pq THEN pa END], lambda v: v IS NOT NULL AND v <> ''), chr(10)) ELSE q END AS expanded FROM y""")
def followup_query(spark: SparkSession, d: str) -> DataFrame:
    """Questions with the context of the turn before where they go on from it."""
    return C.follow_up(t(spark, d, "turns").select("turn_key", "session_id", "turn", "query", "answer"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 3600000000 THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT user_id, ts, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM g)
SELECT user_id, session_no, min(ts) AS started, max(ts) AS ended, count(*) AS events FROM n GROUP BY 1, 2""")
def sessions_ttl(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of users, ended by an hour without an event."""
    return C.sessions_by_gap(t(spark, d, "events"), "user_id", "ts")


@query(r"""WITH c AS (SELECT row_id AS id, raw_text AS text, regexp_replace(regexp_replace(trim(regexp_replace(coalesce(metadata.heading, ''), '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')), '^[ .:\-–—#]+', ''), '[ .:\-–—#]+$', '') AS head FROM rag_chunks),
m AS (SELECT *, list_filter(list_transform(regexp_extract_all(text, '\*\*([^*]{2,100})\*\*', 1), lambda x: regexp_replace(regexp_replace(trim(regexp_replace(x, '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')), '^[ .:\-–—#]+', ''), '[ .:\-–—#]+$', '')), lambda x: x <> '') AS terms FROM c),
u AS (SELECT *, (list_filter(terms, lambda x, i: list_position(terms, x) = i))[:4] AS ts FROM m),
a AS (SELECT id, list_concat(list_concat(coalesce(flatten(list_transform(ts, lambda x: ['ما هو ' || x || '؟', 'ما المقصود بـ ' || x || '؟'])), []), CASE WHEN head <> '' THEN ['ما الذي يشرحه ' || head || '؟'] ELSE [] END),
CASE WHEN regexp_matches(text, '.{20,180}?(?:هو|هي|تعني|يعني|يسمى|:)') THEN ['ما المقصود بـ ' || CASE WHEN head <> '' THEN head ELSE 'هذا المفهوم' END || '؟'] ELSE [] END) AS qs FROM u),
b AS (SELECT id, (list_filter(qs, lambda x, i: list_position(qs, x) = i))[:6] AS qs FROM a)
SELECT id, CAST(unnest(range(len(qs))) AS INTEGER) AS no, unnest(qs) AS question FROM b""")
def question_index(spark: SparkSession, d: str) -> DataFrame:
    """Hypothetical questions of the chunks."""
    return C.questions(t(spark, d, "rag_chunks").select(F.col("row_id").alias("id"), F.col("raw_text").alias("text"), F.col("metadata.heading").alias("heading")))


def _evaluated(spark: SparkSession, d: str) -> DataFrame:
    """Turns scored against their sources' texts, in the order of the sources."""
    turns = t(spark, d, "turns").select("turn_key", "query", "answer", "sources", F.coalesce("retrieval.top_score", F.lit(0.0)).alias("rerank"))
    texts = t(spark, d, "rag_chunks").groupBy("chunk_id").agg(F.max_by("raw_text", "row_id").alias("raw_text"))
    each = turns.select("turn_key", F.posexplode("sources").alias("pos", "s")).select("turn_key", "pos", F.col("s.chunk_id").alias("chunk_id"))
    context = each.join(texts, "chunk_id").filter(F.trim("raw_text") != "").groupBy("turn_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "raw_text"))), lambda x: x["raw_text"]).alias("chunks"))
    empty = F.array().cast("array<string>")
    rows = turns.join(context, "turn_key", "left").withColumn("chunks", F.coalesce("chunks", empty)).withColumn("context", F.array_join("chunks", "\n\n"))
    for name in ("query", "answer", "context"):
        rows = rows.withColumn(name[0] + "t", T.core_tokens(F.col(name), None))
    rows = rows.withColumn("cts", F.transform("chunks", lambda x: T.core_tokens(x, None)))
    f = E.faithfulness(F.col("answer"), F.col("at"), F.col("context"), F.col("ct"))
    p = E.context_precision(F.col("qt"), F.col("cts"), F.col("rerank"))
    r = E.context_recall(F.col("qt"), F.col("context"), F.col("ct"))
    a = E.answer_relevance(F.col("query"), F.col("qt"), F.col("answer"), F.col("at"))
    return rows.select("turn_key", f.alias("faithfulness"), p.alias("precision"), r.alias("recall"), a.alias("relevance"))


_REFUSED = "contains(answer, 'غير كافية') OR contains(answer, 'لا تتوفر') OR contains(answer, '{ar}') OR contains(lower(answer), 'insufficient') OR contains(lower(answer), 'does not include') OR contains(lower(answer), 'does not contain')"
_EVAL_SQL = f"""WITH {_LAST_SQL.replace('ORDER BY ingested_at DESC, row_id DESC', 'ORDER BY row_id DESC')},
e AS (SELECT turn_key, unnest(sources) AS s, generate_subscripts(sources, 1) AS pos FROM turns),
c AS (SELECT turn_key, list(text ORDER BY pos) AS chunks FROM e JOIN l ON s.chunk_id = l.chunk_id WHERE trim(text) <> '' GROUP BY 1),
turned AS (SELECT t.turn_key, query, answer, coalesce(retrieval.top_score, 0) AS rr, coalesce(chunks, []) AS chunks, array_to_string(coalesce(chunks, []), chr(10) || chr(10)) AS context FROM turns t LEFT JOIN c ON t.turn_key = c.turn_key),
k AS (SELECT *, list_distinct({T.sql_tokens('query')}) AS q, list_distinct({T.sql_tokens('answer')}) AS a, list_distinct({T.sql_tokens('context')}) AS x, list_filter(list_transform(chunks[:3], lambda y: list_distinct({T.sql_tokens('y')})), lambda y: len(y) > 0) AS ys FROM turned),
m AS (SELECT turn_key,
CASE WHEN coalesce(answer, '') = '' OR coalesce(context, '') = '' THEN 0.0 WHEN {_REFUSED.format(ar='لا تحتوي الوثيقة')} OR contains(lower(answer), 'not found in') OR len(a) = 0 THEN 1.0 ELSE least(1.0, greatest(0.2, 0.65 + 0.33 * least(1.0, len(list_intersect(a, x)) / greatest(len(a), 1) * 1.35))) END AS faithfulness,
CASE WHEN len(chunks) = 0 THEN 0.0 WHEN len(q) = 0 THEN least(1.0, greatest(0.6, rr)) ELSE least(1.0, greatest(0.3, 0.58 + 0.4 * (0.4 * coalesce(list_avg(list_transform(ys, lambda y: len(list_intersect(q, y)) / greatest(len(q), 1))), 0) + 0.6 * least(1.0, greatest(0.0, rr))))) END AS precision,
CASE WHEN coalesce(context, '') = '' THEN 0.0 WHEN len(q) = 0 THEN 1.0 ELSE least(1.0, greatest(0.3, 0.6 + 0.38 * len(list_intersect(q, x)) / greatest(len(q), 1))) END AS recall,
CASE WHEN coalesce(query, '') = '' OR coalesce(answer, '') = '' THEN 0.0 WHEN {_REFUSED.format(ar='لا تحتوي')} THEN 0.95 WHEN len(q) = 0 OR len(a) = 0 THEN 0.88 ELSE least(1.0, greatest(0.4, 0.68 + 0.3 * len(list_intersect(q, a)) / greatest(len(q), 1) * CASE WHEN length(trim(answer, ' ' || chr(9) || chr(10) || chr(13))) < 10 THEN 0.5 ELSE 1 END)) END AS relevance FROM k),
o AS (SELECT *, round(0.35 * faithfulness + 0.30 * relevance + 0.20 * precision + 0.15 * recall, 4) AS overall FROM m),
v AS (SELECT turn_key, round(faithfulness, 4) AS faithfulness, round(precision, 4) AS precision, round(recall, 4) AS recall, round(relevance, 4) AS relevance, overall, CASE WHEN overall >= 0.65 AND faithfulness >= 0.6 THEN 'PASS' WHEN overall >= 0.4 THEN 'NEEDS_IMPROVEMENT' ELSE 'FAIL' END AS verdict FROM o)"""


@query(_EVAL_SQL + " SELECT * FROM v")
def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The four metrics, the overall score and the verdict of every turn."""
    m = _evaluated(spark, d)
    total = E.overall(F.col("faithfulness"), F.col("relevance"), F.col("precision"), F.col("recall"))
    return m.withColumn("overall", total).withColumn("verdict", E.verdict(F.col("overall"), F.col("faithfulness"))).select("turn_key", *(F.round(c, 4).alias(c) for c in ("faithfulness", "precision", "recall", "relevance")), "overall", "verdict")


@query(_EVAL_SQL + " SELECT verdict, count(*) AS n FROM v GROUP BY 1")
def eval_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Turns by verdict."""
    return eval_metrics(spark, d).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_LAST_SQL}, e AS (SELECT turn_key AS query_id, unnest(sources) AS s, generate_subscripts(sources, 1) AS rank FROM turns),
r AS (SELECT query_id, rank, length('[Evidence ' || rank || ']' || chr(10) || 'Source: ' || coalesce(source, 'None') || chr(10) || 'Page: ' || coalesce(CAST(page AS VARCHAR), 'None') || chr(10) || 'Section: ' || coalesce(heading, 'None') || chr(10) || 'Text: ' || coalesce(text, '')) AS n FROM e JOIN l ON s.chunk_id = l.chunk_id),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r),
u AS (SELECT *, CASE WHEN n <= 6000 - before THEN n WHEN 6000 - before > 250 THEN 6000 - before ELSE 0 END AS used, coalesce(max(CASE WHEN n > 6000 - before THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM b)
SELECT query_id, CAST(rank AS BIGINT) AS rank, CAST(used AS BIGINT) AS used_chars FROM u WHERE over = 0 AND used > 0""")
def context_budget(spark: SparkSession, d: str) -> DataFrame:
    """The sources of every turn that fit a context of 6,000 characters, whole evidence blocks counted."""
    each = t(spark, d, "turns").select(F.col("turn_key").alias("query_id"), F.posexplode("sources").alias("pos", "s")).select("query_id", (F.col("pos") + 1).cast("bigint").alias("rank"), F.col("s.chunk_id").alias("chunk_id"))
    rows = each.join(latest_chunks(spark, d), "chunk_id")
    block = S.evidence_block(F.col("rank"), F.col("source"), F.col("page"), F.col("heading"), F.col("text"))
    return S.context_budget(rows.select("query_id", "rank", block.alias("text"))).withColumn("used_chars", F.col("used_chars").cast("bigint"))


def _parents(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "text_chunks").filter("parent_text IS NOT NULL").groupBy(F.col("parent_chunk_id").alias("parent_id")).agg(F.max_by("parent_text", "row_id").alias("parent_text"))


_SHOWN = ("query_id", "rank", "id", "parent_id", "score", "reranker", "confidence", "context_expanded")
_OVERLAP_SQL = "CASE WHEN len(qt) = 0 THEN {none} ELSE len(list_intersect(qt, {of})) / greatest(len(qt), 1) END"
_RETRIEVE_SQL = f"""{_BM25_SQL},
k AS (SELECT r.query_id, r.id, r.score AS kw, 1 / (1 + r.score) AS distance, l.book, page, text, heading, kind, parent_id, list_distinct(q.tokens) AS qt FROM r JOIN l USING (id) JOIN q USING (query_id) WHERE rank <= 100),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, coalesce(book, ''), coalesce(CAST(page AS VARCHAR), ''), left(coalesce(text, ''), 60) ORDER BY distance, -kw, id) AS one FROM k) WHERE one = 1),
g AS (SELECT *, {T.sql_tokens('text')} AS dt, {T.sql_tokens('heading')} AS ht FROM o),
v AS (SELECT *, {_OVERLAP_SQL.format(none='0.5', of='dt')} AS lex, {_OVERLAP_SQL.format(none='0.0', of='ht')} AS head FROM g),
z AS (SELECT *, round(least(1.0, 0.50 * CASE WHEN distance < 0.3 THEN 0.75 ELSE 0.5 END + 0.35 * greatest(least(1.0, kw / 15), lex) + 0.10 * CASE WHEN len(qt) > 0 AND len(list_intersect(qt, dt)) = len(qt) THEN 1 ELSE 0 END + 0.05 * head + 0.05 * CASE WHEN kind IN ('definition', 'paragraph', 'example', 'table') THEN 1.0 ELSE 0.8 END), 6) AS score FROM v),
h AS (SELECT *, least(0.98, greatest(0.05, CASE WHEN score >= 0.35 THEN least(0.98, 0.80 + 0.18 * least(1.0, (score - 0.35) / 0.40) + 0.06 * lex) ELSE 1.5 * score END)) AS conf,
CASE WHEN score >= 0.35 THEN least(0.98, greatest(0.72, 0.74 + 0.24 * least(1.0, (score - 0.35) / 0.40))) ELSE least(1.0, greatest(0.0, score)) END AS rer FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS cand FROM z) WHERE cand <= 25),
i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rer, 6) DESC, round(conf, 6) DESC, score DESC, id) AS place FROM h),
j AS (SELECT *, coalesce(parent_id, CAST(id AS VARCHAR)) AS pid, row_number() OVER (PARTITION BY query_id, coalesce(parent_id, CAST(id AS VARCHAR)) ORDER BY place) AS of_parent FROM i WHERE place <= 15),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS final FROM j WHERE of_parent = 1),
t AS (SELECT parent_chunk_id AS pid, arg_max(parent_text, row_id) AS parent_text FROM text_chunks WHERE parent_text IS NOT NULL GROUP BY 1)
SELECT query_id, final AS rank, id, n.pid AS parent_id, score, round(rer, 6) AS reranker, round(conf, 6) AS confidence, parent_text IS NOT NULL AS context_expanded, CAST(length(coalesce(parent_text, text)) AS INTEGER) AS context_chars FROM n LEFT JOIN t USING (pid) WHERE final <= 5"""


def _by_keywords(spark: SparkSession, d: str, asked: DataFrame, k: int = 5) -> DataFrame:
    chunks = latest_chunks(spark, d)
    q = asked.select("query_id", "book", T.lex_tokens(F.col("query")).alias("tokens"))
    none = spark.createDataFrame([], "query_id bigint, id bigint, distance double")
    return S.retrieve(q, chunks, _parents(spark, d), (none, none, S.bm25(q, corpus_tokens(chunks), S.candidate_width(k))), k)


@query(_RETRIEVE_SQL)
def retrieve(spark: SparkSession, d: str) -> DataFrame:
    """End to end within each turn's file: keyword candidates, one a beginning, linear score, calibration, one child a parent, parent context, five a query."""
    return _by_keywords(spark, d, asking_turns(spark, d)).select(*_SHOWN, F.length("context").alias("context_chars"))


def _vectors_of(df: DataFrame, text: str) -> DataFrame:
    return V.encode(df, text).drop(text)


@query()
def retrieve_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """The same from three channels: vectors of the chunks, of their hypothetical questions, and keywords (the tables hold no vectors, so texts are hashed)."""
    chunks, asked = written(latest_chunks(spark, d)), asking_turns(spark, d)
    width = S.candidate_width(5)
    q = asked.select("query_id", "book", T.lex_tokens(F.col("query")).alias("tokens"))
    books = asked.select("book").distinct()
    within = chunks.join(books, "book", "left_semi")
    qv = _vectors_of(asked.select("query_id", "book", "query"), "query")
    dense = S.knn(qv, _vectors_of(within.select("id", "book", "text"), "text"), width, ("book",))
    questions = C.questions(within.select("id", "text", "heading")).withColumn("qid", F.xxhash64("id", "no")).join(within.select("id", "book"), "id")
    near = S.knn(qv, _vectors_of(questions.select(F.col("qid").alias("id"), "book", "question"), "question"), width, ("book",))
    by_question = S.question_channel(near, questions.select(F.col("qid").alias("id"), F.col("id").alias("chunk_id")))
    found = S.retrieve(q, chunks, _parents(spark, d), (dense, by_question, S.bm25(q, corpus_tokens(chunks), width)), 5)
    return found.select(*_SHOWN, "channels", F.length("context").alias("context_chars"))


@query()
def respond(spark: SparkSession, d: str) -> DataFrame:
    """Answers to the asking turns: bare question or question with its context, whichever is surer; gate, extractive answer, grounding, summary."""
    asked = asking_turns(spark, d)
    turns = t(spark, d, "turns").join(asked.select("session_id").distinct(), "session_id", "left_semi").select("turn_key", "session_id", "turn", "query", "answer")
    expanded = C.follow_up(turns).select(F.col("turn_key").alias("query_id"), F.col("expanded").alias("query"))
    plain = written(_by_keywords(spark, d, asked))
    contextual = written(_by_keywords(spark, d, asked.drop("query").join(expanded, "query_id")))
    results = written(S.better_of(plain, contextual, 0.62))
    block = S.evidence_block(F.col("rank"), F.col("source"), F.col("page"), F.col("heading"), F.col("context"))
    context = S.build_context(results.select("query_id", "rank", block.alias("text")))
    first = results.filter("rank = 1").select("query_id", F.col("context").alias("evidence"), "reranker", "confidence")
    open_ = A.generated(asked.select("query_id", "query").join(first, "query_id").join(context, "query_id"))
    passed = A.passes(F.col("reranker"), F.col("confidence"), A.LEAST)
    state, grounded = A.grounding(F.when(passed, F.col("status")), F.col("self_reported"), F.col("reranker"), F.col("confidence"))
    answer = F.when(passed, F.col("answer")).otherwise(A.NOT_ENOUGH)
    said = open_.select("query_id", answer.alias("answer"), state.alias("answer_status"), grounded.alias("grounded"), F.length("context").alias("context_chars"))
    return said.join(A.retrieval_summary(results), "query_id").join(A.source_list(results).select("query_id", F.size("sources").alias("sources")), "query_id").withColumn("answer_chars", F.length("answer")).drop("answer")


@query("SELECT file_reference_id, pos, title, page FROM (SELECT *, row_number() OVER (PARTITION BY file_reference_id, pos ORDER BY page NULLS LAST, title) AS rn FROM toc_entries) WHERE rn = 1")
def toc_entries_once(spark: SparkSession, d: str) -> DataFrame:
    """The table of contents of every book, one entry a position."""
    return S.first_per(t(spark, d, "toc_entries"), ["file_reference_id", "pos"], F.col("page").asc_nulls_last(), F.col("title")).select("file_reference_id", "pos", "title", "page")


@query("SELECT file_reference_id, pos, title, max(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file_reference_id ORDER BY pos, coalesce(page, 0), coalesce(level, 0) ROWS UNBOUNDED PRECEDING) = 1 AS after_unit FROM toc_entries")
def toc_after_unit(spark: SparkSession, d: str) -> DataFrame:
    """Whether a unit has been seen before each entry."""
    order = [F.col("pos"), F.coalesce("page", F.lit(0)), F.coalesce("level", F.lit(0))]
    return C.seen_before(t(spark, d, "toc_entries"), "file_reference_id", order, F.col("level") == 1).select("file_reference_id", "pos", "title", F.col("seen").alias("after_unit"))


@query("SELECT row_id, page - lag(page) OVER (PARTITION BY file_reference_id ORDER BY page, row_id) AS page_gap FROM loaded_pages WHERE page IS NOT NULL")
def page_gaps(spark: SparkSession, d: str) -> DataFrame:
    """The step from the page before in each book."""
    rows = C.previous(t(spark, d, "loaded_pages").filter("page IS NOT NULL").select("row_id", "page", "file_reference_id"), "file_reference_id", "page", "row_id")
    return rows.select("row_id", (F.col("page") - F.col("previous")).alias("page_gap"))


_WHITE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query(f"SELECT row_id, sha256(x) AS text_hash FROM (SELECT row_id, trim(regexp_replace(raw_text, '{_WHITE}', ' ', 'g')) AS x FROM text_chunks) WHERE length(x) >= 20")
def valid_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks long enough to be indexed, with single spaces."""
    return C.valid_chunks(t(spark, d, "text_chunks").select("row_id", "raw_text")).select("row_id", F.sha2("raw_text", 256).alias("text_hash"))


@query("SELECT metadata.language AS language, count(*) AS n, count(DISTINCT chunk_id) AS chunks FROM rag_chunks WHERE coalesce(metadata.subject, 'None') = 'None' AND metadata.content_type = 'paragraph' GROUP BY 1")
def filtered_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by language under filters that are compared as texts: a missing subject reads 'None'."""
    rows = t(spark, d, "rag_chunks").select("chunk_id", "metadata.*")
    kept = rows.filter(S.matches({"subject": "None", "content_type": "paragraph", "grade": None}, {c: F.col(c) for c in rows.columns}))
    return kept.groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("chunk_id").alias("chunks"))


@query(f"WITH {_LAST_SQL}, x AS (SELECT q.id AS query_id, c.id FROM (SELECT * FROM l WHERE id % 50 = 0) q JOIN (SELECT l.id, book, metadata.chapter AS chapter, metadata.lesson AS lesson FROM l JOIN rag_chunks ON l.id = row_id) c ON q.book = c.book JOIN rag_chunks r ON q.id = r.row_id WHERE trim(q.book) <> '' AND (r.metadata.chapter IS NULL OR coalesce(c.chapter, 'None') = r.metadata.chapter) AND (r.metadata.lesson IS NULL OR coalesce(c.lesson, 'None') = r.metadata.lesson)) SELECT query_id, count(*) AS within FROM x GROUP BY 1")
def scoped_chunks(spark: SparkSession, d: str) -> DataFrame:
    """How many chunks of its file are in the chapter and lesson of every fiftieth chunk."""
    c = latest_chunks(spark, d).select("id", "book", "chapter", "lesson")
    return S.scoped(c.filter("id % 50 = 0").withColumnRenamed("id", "query_id"), c).groupBy("query_id").agg(F.count(F.lit(1)).alias("within"))


@query("SELECT (SELECT count(*) FROM books) AS files, (SELECT count(DISTINCT chunk_id) FROM rag_chunks) AS chunks, (SELECT count(*) FROM text_chunks) AS questions")
def ingest_totals(spark: SparkSession, d: str) -> DataFrame:
    """Files, chunks and child texts in all."""
    return C.totals(t(spark, d, "books"), t(spark, d, "rag_chunks").select("chunk_id").distinct(), t(spark, d, "text_chunks"))


@query("SELECT turn_key, CAST(row_number() OVER (PARTITION BY session_id ORDER BY turn, turn_key) AS INTEGER) AS turn_no FROM turns")
def turn_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The place of every turn in its session."""
    return C.turn_numbers(t(spark, d, "turns"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC, turn_key DESC) AS back FROM turns), h AS (SELECT session_id, list(query ORDER BY turn, turn_key) AS asked FROM r WHERE back <= 6 GROUP BY 1) SELECT s.session_id, file_reference_id, coalesce(len(asked), -1) AS turns, CASE WHEN asked IS NULL THEN NULL ELSE sha256(array_to_string(list_transform(asked, lambda x: coalesce(x, '')), '|')) END AS history FROM sessions s LEFT JOIN h ON s.session_id = h.session_id")
def session_histories(spark: SparkSession, d: str) -> DataFrame:
    """Every session with a hash of the last six questions that its answers may look back to."""
    s = C.session_state(t(spark, d, "sessions"), t(spark, d, "turns"))
    asked = F.array_join(F.transform("turns", lambda x: F.coalesce(x["user"], F.lit(""))), "|")
    return s.select("session_id", "file_reference_id", F.coalesce(F.size("turns"), F.lit(-1)).cast("bigint").alias("turns"), F.when(F.col("turns").isNotNull(), F.sha2(asked, 256)).alias("history"))


@query("SELECT session_id FROM (SELECT session_id, row_number() OVER (ORDER BY coalesce(updated_at, created_at) DESC, session_id DESC) AS n FROM sessions WHERE coalesce(updated_at, created_at) >= (SELECT max(coalesce(updated_at, created_at)) FROM sessions) - INTERVAL 30 DAY) WHERE n <= 1000")
def sessions_kept(spark: SparkSession, d: str) -> DataFrame:
    """The sessions that a sweep leaves: seen in the last thirty days, at most a thousand."""
    s = t(spark, d, "sessions").withColumn("seen", F.coalesce("updated_at", "created_at"))
    now = s.agg(F.max("seen").alias("now"))
    return C.swept(s.crossJoin(F.broadcast(now)), "seen", F.col("now").cast("timestamp"), 30 * 86_400).select("session_id")  # one row of now


@query("""WITH b AS (SELECT * FROM (SELECT file_reference_id, file_name, curriculum_id, row_number() OVER (PARTITION BY file_reference_id ORDER BY registered_at DESC, file_name DESC) AS n FROM books) WHERE n = 1)
SELECT s.session_id, s.file_reference_id, coalesce(b.file_name, s.file_reference_id) AS file_name, b.curriculum_id FROM sessions s LEFT JOIN b ON s.file_reference_id = b.file_reference_id""")
def session_files(spark: SparkSession, d: str) -> DataFrame:
    """Every session with the name and curriculum of its file's record."""
    return C.record_of(t(spark, d, "sessions").select("session_id", "file_reference_id"), t(spark, d, "books")).select("session_id", "file_reference_id", "file_name", "curriculum_id")


_TOC_LINE = "{title} .......... {page}"


@query(r"""WITH e AS (SELECT file_reference_id AS book, pos, min(title) AS title, min(page) AS page FROM toc_entries WHERE page IS NOT NULL AND page BETWEEN 0 AND 9999 GROUP BY 1, 2),
x AS (SELECT book, pos, trim(regexp_replace(regexp_replace(title || ' .......... ' || page, '[.…_\-·•]{2,}', ' ', 'g'), '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'), ' .') AS s FROM e),
y AS (SELECT book, pos, trim(regexp_extract(s, '^(.+?) (\d{1,4})$', 1), ' .-') AS title, CAST(regexp_extract(s, '^(.+?) (\d{1,4})$', 2) AS INTEGER) AS page FROM x),
z AS (SELECT *, CASE WHEN regexp_matches(title, '(?i)(?:^|[^\p{L}\p{N}_])(?:unit|module|chapter)(?:$|[^\p{L}\p{N}_])|الوحدة|المحور') OR regexp_matches(replace(title, 'الفصل الدراسي', ''), 'الفصل') THEN 1 WHEN regexp_matches(title, '(?i)(?:^|[^\p{L}\p{N}_])(?:lesson|lecture)(?:$|[^\p{L}\p{N}_])|الدرس|المحاضرة') THEN 2 END AS own, row_number() OVER w AS entry_no FROM y WINDOW w AS (PARTITION BY book ORDER BY pos))
SELECT book, CAST(entry_no AS INTEGER) AS entry_no, title, CAST(coalesce(own, CASE WHEN max(CASE WHEN own = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY book ORDER BY entry_no) = 1 THEN 2 END) AS INTEGER) AS level, page FROM z""")
def toc_parse(spark: SparkSession, d: str) -> DataFrame:
    """Tables of contents printed with leaders, then read again: titles, levels and pages."""
    e = t(spark, d, "toc_entries").filter("page BETWEEN 0 AND 9999").groupBy(F.col("file_reference_id").alias("book"), F.col("pos").alias("at")).agg(F.min("title").alias("title"), F.min("page").alias("page"))
    return TOC.toc_entries(e.select("book", "at", F.concat("title", F.lit(" .......... "), F.col("page").cast("string")).alias("text")))


@query()
def toc_match(spark: SparkSession, d: str) -> DataFrame:
    """Every heading of the chunks with the entry of its book's table of contents that it is nearest to."""
    h = t(spark, d, "rag_chunks").select(F.col("metadata.file_reference_id").alias("book"), F.col("metadata.heading").alias("heading"))
    return TOC.toc_match(h, t(spark, d, "toc_entries").withColumnRenamed("file_reference_id", "book"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "loaded_pages").select(F.col("row_id").cast("string").alias("doc_id"), "text", F.col("file_reference_id").alias("book"), F.col("doc_idx").alias("at"), F.col("row_id").alias("copy"))


@query()
def structure_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of all pages that name a place, with the place after them."""
    return P.structure_lines(placed(_pages(spark, d)))


@query()
def book_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Title, subject, grade and term of every book from its first pages and its file name."""
    names = t(spark, d, "books").select(F.col("file_reference_id").alias("book"), "file_name", "language")
    return M.book_metadata(_pages(spark, d), names).select("book", "document_title", "subject", "grade", "term", "language", "text_quality_warning", "curriculum_id")


@query()
def knn_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the inverted file (32 cells, 20 of them looked into; these vectors hardly cluster) against the exact ten nearest of every fiftieth vector."""
    v = _vectors(spark, d).select("id", "vector")
    q = v.filter("id % 50 = 0").withColumnRenamed("id", "query_id")
    centers = V.centroids(v, 32)
    found = V.knn_indexed(q, V.nearest_cells(v, centers), centers, 10, 20).select("query_id", "id")
    exact = S.knn(q, v, 10).select("query_id", "id")
    hits = exact.join(found.withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return hits.agg(F.count(F.lit(1)).alias("exact"), F.round(F.avg(F.coalesce("hit", F.lit(0)).cast("double")), 6).alias("recall"))


@query("SELECT answer_status, grounded, count(*) AS n, round(avg(retrieval.top_score), 6) AS avg_top, sum(CASE WHEN retrieval.top_score >= 0.15 AND retrieval.retrieval_confidence >= 0.15 THEN 1 ELSE 0 END)::BIGINT AS passed_gate FROM turns GROUP BY 1, 2")
def answer_gates(spark: SparkSession, d: str) -> DataFrame:
    """Turns by status, and how many pass the gate before generation."""
    passed = F.coalesce((F.col("retrieval.top_score") >= 0.15) & (F.col("retrieval.retrieval_confidence") >= 0.15), F.lit(False))
    return t(spark, d, "turns").groupBy("answer_status", "grounded").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("retrieval.top_score"), 6).alias("avg_top"), F.sum(passed.cast("bigint")).alias("passed_gate"))


@query()
def chunk_pages(spark: SparkSession, d: str) -> DataFrame:
    """Parent and child chunks of all loaded pages."""
    return chunk(placed(_pages(spark, d)))


@query()
def normalized_pages(spark: SparkSession, d: str) -> DataFrame:
    """The normalized text of every page."""
    return t(spark, d, "loaded_pages").select("row_id", T.normalize_text("text").alias("text"))
