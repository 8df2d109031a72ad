"""Pages that another parser has taken apart: rows of lines, or of a page's text.

No PDF library is needed here: ``lines`` (book, page, text, font_size, bold, y0, x0, width) are
what such a library gives, ``parsed`` pages (book, page, text, markdown) what a cloud parser
returns.  Both come out as the pages (book, at, text, ...) that the chunker takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import detect_language, strip_control_chars

#: Lines from which a page can have columns, least gap of them as a share of the width, least font size of a heading as a multiple of the median.
COLUMN_LINES, COLUMN_GAP, HEADING_SIZE = 6, 0.08, 1.18


def upper_median(values: Column) -> Column:
    """The middle of the sorted values above 0, the upper one of two; 0 if there are none."""
    sizes = F.array_sort(F.filter(values, lambda x: x > 0))
    return F.when(F.size(sizes) > 0, F.element_at(sizes, (F.floor(F.size(sizes) / 2) + 1).cast("int"))).otherwise(F.lit(0.0))


def reading_order(lines: DataFrame) -> DataFrame:
    """``lines`` with ``line_no``: two columns one after the other where a wide gap parts enough lines, else from top to bottom.

    All by windows over a page, which has a bounded number of lines.
    """
    page = Window.partitionBy("book", "page")
    by_x = page.orderBy("x0", "y0", "text")
    gaps = lines.withColumn("gap", F.col("x0") - F.lag("x0").over(by_x)).withColumn("n", F.count(F.lit(1)).over(page))
    # The first of the widest gaps; it lies halfway between the two positions.
    at = F.struct(F.coalesce("gap", F.lit(-1.0)).alias("gap"), (-F.col("x0")).alias("first"))
    widest = gaps.withColumn("widest", F.max(at).over(page)).withColumn("split", -F.col("widest.first") - F.col("widest.gap") / 2)
    side = widest.withColumn("right", F.col("x0") >= F.col("split")).withColumn("on_right", F.sum((F.col("x0") >= F.col("split")).cast("int")).over(page))
    least = F.greatest(F.lit(3), F.floor(F.col("n") / COLUMN_LINES))
    columns = (F.col("n") >= COLUMN_LINES) & (F.col("width") > 0) & (F.col("widest.gap") > 0) & (F.col("widest.gap") >= F.col("width") * COLUMN_GAP) & (F.col("on_right") >= least) & (F.col("n") - F.col("on_right") >= least)
    order = page.orderBy(F.when(columns, F.col("right")).otherwise(F.lit(False)), F.round("y0", 1), F.round("x0", 1), "text")
    return side.withColumn("line_no", F.row_number().over(order)).drop("gap", "n", "widest", "split", "right", "on_right")


def page_texts(lines: DataFrame, parser: str = "boxes") -> DataFrame:
    """(book, at, text, median_size, styled, parser, language): pages of ``lines`` in reading order; ``styled``: lines in bold or large type.  Blank lines are left out."""
    kept = lines.withColumn("text", F.trim(strip_control_chars(F.col("text")))).filter("text <> ''")
    rows = reading_order(kept).groupBy("book", "page").agg(F.array_sort(F.collect_list(F.struct("line_no", "text", "bold", "font_size"))).alias("ls"))
    median = upper_median(F.transform("ls", lambda x: x["font_size"]))
    sized = rows.withColumn("median_size", median)
    styled = F.filter("ls", lambda x: x["bold"] | ((F.col("median_size") > 0) & (x["font_size"] >= F.col("median_size") * HEADING_SIZE)))
    out = sized.select("book", F.col("page").alias("at"), F.array_join(F.transform("ls", lambda x: x["text"]), "\n").alias("text"), "median_size", F.transform(styled, lambda x: x["text"]).alias("styled"))
    return out.withColumn("parser", F.lit(parser)).withColumn("language", detect_language(F.col("text")))


def cover_text(lines: DataFrame, most: int = 8) -> DataFrame:
    """(book, text): the first pages of each book in reading order, for its metadata only; books without a line give no row."""
    first = lines.withColumn("nth", F.dense_rank().over(Window.partitionBy("book").orderBy("page"))).filter(F.col("nth") <= most)
    pages = page_texts(first)
    whole = pages.groupBy("book").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return whole.filter(F.col("text").rlike(r"\S"))


def parsed_pages(parsed: DataFrame, parser: str = "cloud") -> DataFrame:
    """(book, at, text, parser, language) of pages (book, page, text, markdown, idx) from another parser: its text, else its Markdown; blank pages are left out, pages without a number count by their place."""
    text = F.trim(F.coalesce(F.when(F.col("text") != "", F.col("text")), F.col("markdown"), F.lit("")))
    out = parsed.select("book", F.coalesce(F.col("page").cast("int"), F.col("idx").cast("int")).alias("at"), text.alias("text")).filter(F.col("text").rlike(r"\S"))
    return out.withColumn("parser", F.lit(parser)).withColumn("language", detect_language(F.col("text")))


def preferred_pages(cloud: DataFrame, local: DataFrame) -> DataFrame:
    """The cloud parser's pages of the books that it has any of, the local ones of the others."""
    return cloud.unionByName(local.join(cloud.select("book").distinct(), "book", "left_anti"), allowMissingColumns=True)
