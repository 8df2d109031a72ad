"""Tables of contents: where they stand, what their lines say, and headings matched with them.

The lines are read with Column expressions, so parsing, levels and comparable forms stay in the
JVM; ``toc_pages`` finds the pages by windows over a book's first pages.  Titles are compared
by ``similarity`` in Arrow batches, candidates joined by book; equal pairs are decided by the join.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# Titles of a table of contents, words of its two levels, runs that lead to a page.
TITLES = r"(?:table\s+of\s+contents|contents|(?:ال)?فهرس(?:\s+المحتويات)?|(?:ال)?محتويات)\s*"
UNIT_WORDS = r"\b(?:unit|module|chapter)\b|الوحدة|الفصل(?!\s+الدراسي)|المحور"
LESSON_WORDS = r"\b(?:lesson|lecture)\b|الدرس|المحاضرة"
LEADERS = r"[.…_\-·•]{2,}"
# Marks that spelling may leave out, letters that are written for each other.
DIACRITICS = r"[ً-ْٰـ]"
ONE_LETTER = str.maketrans("أإآىة", "ااايه")
#: Least similarity of a heading and its entry; pages looked at for the title; lines of a table.
LEAST, FIRST_LINES, MOST_LINES = 0.72, 5, 400

_TITLE, _LEADER = re.compile(TITLES, re.I), re.compile(LEADERS)
_PAGE_LAST, _PAGE_FIRST = re.compile(r"(.+?)\s+(\d{1,4})"), re.compile(r"(\d{1,4})\s+(.+)")


def comparable(text: str | None) -> str:
    """NFKC, without diacritics and punctuation, letters unified, case folded, single spaces."""
    v = re.sub(DIACRITICS, "", unicodedata.normalize("NFKC", text or "")).translate(ONE_LETTER)
    return " ".join(re.sub(r"[^\w؀-ۿ ]+", " ", v).split()).casefold()


def similarity_of(a: str, b: str) -> float:
    """Of two comparable titles: 1 if equal, 0.92 if one holds the other, else the ratio of their sorted words."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    if min(len(a), len(b)) >= 4 and (a in b or b in a):
        return 0.92
    return SequenceMatcher(None, *(" ".join(sorted(x.split())) for x in (a, b))).ratio()


def similarity(a: str | None, b: str | None) -> float:
    return similarity_of(comparable(a), comparable(b))


def is_title(line: str | None) -> bool:
    return bool(_TITLE.fullmatch((line or "").strip(" \t|-#:")))


def entry_of(line: str | None) -> tuple[str, int] | None:
    """(title, page) of a line of a table of contents; the page stands last or first."""
    s = re.sub(r"\s+", " ", _LEADER.sub(" ", (line or "").strip())).strip(" .")
    last, first = _PAGE_LAST.fullmatch(s), _PAGE_FIRST.fullmatch(s)
    for title, page in ((last[1], last[2]) if last else ("", 0), (first[2], first[1]) if first else ("", 0)):
        if title.strip(" .-"):
            return title.strip(" .-"), int(page)
    return None


def word_level(title: str) -> int | None:
    return 1 if re.search(UNIT_WORDS, title, re.I) else 2 if re.search(LESSON_WORDS, title, re.I) else None


@dataclass(frozen=True)
class Entry:
    title: str
    level: int | None
    page: int | None

    @property
    def key(self) -> str:
        return comparable(self.title)


def entries_of(text: str | None) -> list[Entry]:
    """Entries in order; after the first unit what has no word of its own is a lesson."""
    out: list[Entry] = []
    for found in filter(None, map(entry_of, (text or "").splitlines()[:MOST_LINES])):
        level = word_level(found[0])
        below = any(e.level == 1 for e in out)
        out.append(Entry(found[0], level or (2 if below else None), found[1]))
    return out


def section_of(pages: list[str | None]) -> str | None:
    """The text of the pages that hold the table of contents, or None."""
    filled = [[x for x in (p or "").splitlines() if x.strip()] for p in pages]
    start = next((k for k, lines in enumerate(filled) if any(map(is_title, lines[:FIRST_LINES]))), None)
    if start is None:
        return None
    end = start + 1
    while end < len(pages) and filled[end] and sum(entry_of(x) is not None for x in filled[end]) >= max(2, len(filled[end]) // 2):
        end += 1
    return "\n".join(p or "" for p in pages[start:end])


class Contents:
    """A book's table of contents, for matching headings; it settles what the text leaves open."""

    def __init__(self, entries: list[Entry]) -> None:
        self.entries = entries
        self.keys = [e.key for e in entries]

    @staticmethod
    def of(pages: list[str | None]) -> "Contents | None":
        entries = entries_of(section_of(pages))
        return Contents(entries) if entries else None

    @staticmethod
    def of_text(text: str | None) -> "Contents | None":
        """From one text, whose pages are what blank lines part."""
        return Contents.of(re.split(r"\n\s*\n(?=\S)", text or ""))

    def match(self, title: str | None, least: float = LEAST) -> tuple[Entry, float] | None:
        """The best entry of at least ``least``; the first of equals."""
        key = comparable(title)
        scored = [(similarity_of(key, k), -n) for n, k in enumerate(self.keys)]
        score, n = max(scored, default=(0.0, 0))
        return (self.entries[-n], score) if score >= least and score > 0 else None

    def level_of(self, title: str | None, least: float = LEAST) -> int | None:
        found = self.match(title, least)
        return found[0].level if found else None

    def rows(self) -> list[dict]:
        return [{"title": e.title, "level": e.level, "page": e.page} for e in self.entries]


# The same over tables ------------------------------------------------------------------


@F.pandas_udf(StringType())
def comparable_text(texts: pd.Series) -> pd.Series:
    return texts.map(comparable)


@F.pandas_udf(DoubleType())
def similarity_score(a: pd.Series, b: pd.Series) -> pd.Series:
    """Of comparable titles."""
    return pd.Series([similarity_of(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


def entry_columns(line: Column) -> tuple[Column, Column]:
    """(title, page) of a line; null where it is no entry."""
    s = F.regexp_replace(F.regexp_replace(line, LEADERS, " "), r"(?U)\s+", " ")
    s = F.regexp_replace(s, r"^[ .]+|[ .]+$", "")
    bare = lambda c: F.regexp_replace(c, r"^[ .\-]+|[ .\-]+$", "")
    last, first = bare(F.regexp_extract(s, r"^(.+?) (\d{1,4})$", 1)), bare(F.regexp_extract(s, r"^(\d{1,4}) (.+)$", 2))
    title = F.when(last != "", last).when(first != "", first)
    page = F.when(last != "", F.regexp_extract(s, r"^(.+?) (\d{1,4})$", 2)).when(first != "", F.regexp_extract(s, r"^(\d{1,4}) (.+)$", 1))
    return title, page.cast("int")


def toc_pages(pages: DataFrame) -> DataFrame:
    """(book, at, text) of the pages (book, at, text) that hold a table of contents: the first with its title and those after that go on.

    ``at`` orders a book's pages; of copies of a page the first text counts.  The first page
    with a title is found by an aggregate; only the number of entries and of lines of each page
    is brought together by book, not its text.
    """
    once = pages.filter("book IS NOT NULL AND at IS NOT NULL").groupBy("book", "at").agg(F.min("text").alias("text"))
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), r"\r\n|\n|\r"), lambda x: x.rlike(r"\S"))
    counted = once.withColumn("lines", lines).select(
        "book", "at", "text",
        F.exists(F.slice("lines", 1, FIRST_LINES), lambda x: F.regexp_replace(x, r"^[ \t|\-#:]+|[ \t|\-#:]+$", "").rlike(f"(?i)^{TITLES}$")).alias("titled"),
        F.size(F.filter("lines", lambda x: entry_columns(x)[0].isNotNull())).alias("hits"), F.size("lines").alias("n"),
    )
    start = counted.filter("titled").groupBy("book").agg(F.min("at").alias("start"))
    later = counted.join(start, "book").filter(F.col("at") >= F.col("start"))
    goes_on = (F.col("at") == F.col("start")) | ((F.col("n") > 0) & (F.col("hits") >= F.greatest(F.lit(2), F.floor(F.col("n") / 2))))
    end = later.filter(~goes_on).groupBy("book").agg(F.min("at").alias("end"))
    return later.join(end, "book", "left").filter(F.col("end").isNull() | (F.col("at") < F.col("end"))).select("book", "at", "text")


def toc_entries(pages: DataFrame) -> DataFrame:
    """(book, entry_no, title, level, page) of the entries on pages (book, at, text) of tables of contents."""
    each = pages.select("book", "at", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("line_no", "line"))
    title, page = entry_columns(F.col("line"))
    found = each.withColumn("title", title).withColumn("page", page).filter("title IS NOT NULL")
    # A book's table of contents has as many rows as it has headings, so a window by book stays small.
    w = Window.partitionBy("book").orderBy("at", "line_no")
    own = F.when(F.col("title").rlike(f"(?iU){UNIT_WORDS}"), 1).when(F.col("title").rlike(f"(?iU){LESSON_WORDS}"), 2)
    numbered = found.withColumn("own", own).withColumn("entry_no", F.row_number().over(w)).withColumn("below", F.max((F.col("own") == 1).cast("int")).over(w))
    return numbered.select("book", "entry_no", "title", F.coalesce("own", F.when(F.col("below") == 1, 2)).cast("int").alias("level"), "page")


def toc_match(headings: DataFrame, entries: DataFrame, least: float = LEAST) -> DataFrame:
    """(book, heading, title, level, page, score): the best entry of its book for each distinct heading (book, heading).

    Headings equal to an entry in comparable form are settled by an equi-join; only the rest are
    compared with the entries of their book.  The entries of one book come salted, so that a
    book with very many headings is spread over tasks.
    """
    h = headings.filter(F.col("heading").rlike(r"\S")).select("book", "heading").distinct().withColumn("key", comparable_text("heading")).filter("key <> ''")
    e = entries.groupBy("book", "title").agg(F.min(F.struct("pos", "level", "page")).alias("e")).select("book", "title", F.col("e.pos").alias("pos"), F.col("e.level").alias("level"), F.col("e.page").alias("page"))
    e = e.withColumn("entry_key", comparable_text("title")).filter("entry_key <> ''")
    salted = h.withColumn("salt", F.pmod(F.xxhash64("heading"), F.lit(16)).cast("int"))
    exact = h.alias("h").join(e.alias("e"), (F.col("h.book") == F.col("e.book")) & (F.col("key") == F.col("entry_key"))).select("h.book", "heading", "pos", "title", "level", "page", F.lit(1.0).alias("score"))
    rest = salted.join(exact.select("book", "heading").distinct(), ["book", "heading"], "left_anti")
    pairs = rest.join(e.withColumn("salt", F.explode(F.array(*map(F.lit, range(16))))), ["book", "salt"]).select("book", "heading", "pos", "title", "level", "page", similarity_score("key", "entry_key").alias("score"))
    every = exact.unionByName(pairs.filter(F.col("score") >= least))
    best = every.groupBy("book", "heading").agg(F.max_by(F.struct("title", "level", "page", "score"), F.struct("score", (-F.col("pos")).alias("before"))).alias("m"))
    return best.select("book", "heading", "m.title", "m.level", "m.page", F.round("m.score", 6).alias("score"))
