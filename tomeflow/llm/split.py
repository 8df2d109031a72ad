"""Problem 5: splitting oversized texts at natural boundaries.

Natural boundaries are line breaks and the white space after . ! ? and their Arabic
counterparts.  Around every boundary the words of the sentences before it are compared
with those after it (cosine of two sliding blocks); a boundary is the deeper a valley, the
more similar the neighbouring ones are than itself.  Within each window of the size limit
the cut falls on the deepest valley of its second half, else on the last boundary of the
first half, else the cut is forced: before a word if there is white space, else between
characters.  The next piece starts ``overlap`` characters before the cut.

Null texts and texts within the limit give no row; blank texts count like any others.
Repeated rows give repeated pieces.  Text lengths are in Unicode characters.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, table

LIMITS = {"raw_text": 650, "parent_text": 1600}
OVERLAP = 80
BLOCK = 2

BOUNDARY = re.compile(r"(?:(?<=[.!?؟؛])\s+)|(?:[ \t]*[\r\n]\s*)")
WORD = re.compile(r"[^\W\d_]+")


def stretches(text: str) -> list[tuple[int, int]]:
    """Start and end of each stretch between two neighbouring boundaries."""
    out, at = [], 0
    for m in BOUNDARY.finditer(text):
        if m.start() > at:
            out.append((at, m.start()))
        at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


def cosine(a: Counter, b: Counter) -> float:
    if len(b) < len(a):
        a, b = b, a
    dot = sum(n * b[w] for w, n in a.items() if w in b)
    if not dot:
        return 0.0
    return dot / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))


def depths(text: str, parts: list[tuple[int, int]], block: int = BLOCK) -> list[float]:
    """Depth of the cohesion valley at the boundary after each part but the last.

    Blocks slide: their word counts are updated by the parts that enter and leave.
    """
    bags = [Counter(w.lower() for w in WORD.findall(text, a, b)) for a, b in parts]
    n = len(parts)
    if n < 2:
        return []
    left, right = Counter(), Counter()
    for k in range(1, min(n, block) + 1):
        if k - 1 < n:
            right.update(bags[k - 1])
    sims = []
    for i in range(n - 1):
        left.update(bags[i])
        if i >= block:
            left.subtract(bags[i - block])
            left += Counter()
        right.subtract(bags[i])
        right += Counter()
        if i + block < n:
            right.update(bags[i + block])
        sims.append(cosine(left, right))
    up, down = [0.0] * (n - 1), [0.0] * (n - 1)
    for i, s in enumerate(sims):  # the peak reached by climbing from the valley, to either side
        up[i] = max(s, up[i - 1]) if i and sims[i - 1] >= s else s
    for i in range(n - 2, -1, -1):
        s = sims[i]
        down[i] = max(s, down[i + 1]) if i < n - 2 and sims[i + 1] >= s else s
    return [up[i] + down[i] - 2 * s for i, s in enumerate(sims)]


def forced_cut(text: str, low: int, high: int) -> int:
    """A cut in (low, high]: after the last white space of the second half, else at high but not inside a letter and its marks."""
    for i in range(high, (low + high) // 2, -1):
        if text[i - 1].isspace():
            return i
    i = high
    while i > low + 1 and i < len(text) and (text[i] in "\u200d\u200c\ufe0f" or unicodedata.combining(text[i])):
        i -= 1
    return i


def pieces(text: str, limit: int, overlap: int = OVERLAP) -> tuple[str, list[tuple[int, int, str]]]:
    """('forced' or 'natural', [(start, end, how it ends)]) of a text longer than ``limit``."""
    if overlap >= limit:
        raise ValueError("the overlap must be smaller than the limit")
    parts = stretches(text)
    kind = "forced" if any(b - a > limit for a, b in parts) else "natural"
    deep = depths(text, parts)
    ends = [parts[i + 1][0] for i in range(len(parts) - 1)]  # a cut after a boundary's white space
    out: list[tuple[int, int, str]] = []
    start, k, cut = 0, 0, 0
    while len(text) - start > limit:
        while k < len(ends) and ends[k] <= cut:
            k += 1
        best, j = -1, k
        while j < len(ends) and ends[j] <= start + limit:
            if ends[j] > max(cut, start + limit // 2):
                if best < 0 or ends[best] <= start + limit // 2 or (deep[j], ends[j]) > (deep[best], ends[best]):
                    best = j
            else:
                best = j
            j += 1
        if best >= 0 and ends[best] - overlap > start:
            cut, how = ends[best], "valley"
        else:
            cut, how = forced_cut(text, max(cut, start + overlap), start + limit), "forced"
        out.append((start, cut, how))
        start = cut - overlap
    out.append((start, len(text), "end"))
    return kind, out


def split_oversized(df: DataFrame, key: str, fields: dict[str, int], overlap: int = OVERLAP) -> DataFrame:
    """(key, field, cut, piece_no, start, end, ends_at, piece) of every value over its limit.

    Values within the limit are dropped by the JVM before anything reaches Python.
    """
    values = None
    for field, limit in fields.items():
        one = df.select(F.col(key).cast("bigint").alias("row_id"), F.lit(field).alias("field"), F.col(field).alias("value")).filter(F.length("value") > limit)
        values = one if values is None else values.unionByName(one)
    schema = pa.schema([("row_id", pa.int64()), ("field", pa.string()), ("cut", pa.string()), ("piece_no", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("ends_at", pa.string()), ("piece", pa.string())])

    def make() -> Callable:
        def one(c: dict[str, list]) -> dict[str, list]:
            rows = []
            for i, f, v in zip(c["row_id"], c["field"], c["value"], strict=True):
                kind, cuts = pieces(v, fields[f], overlap)
                rows += [(i, f, kind, n, a, b, how, v[a:b]) for n, (a, b, how) in enumerate(cuts, 1)]
            return {n: [r[k] for r in rows] for k, n in enumerate(schema.names)}

        return one

    return map_rows(values, make, schema, "row_id bigint, field string, cut string, piece_no int, start int, end int, ends_at string, piece string")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of the oversized texts of text_chunks."""
    return split_oversized(table(spark, sf_dir, "text_chunks"), "row_id", LIMITS)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each oversized value: was a forced cut needed (a stretch longer than the limit)?"""
    return p5_pieces(spark, sf_dir).filter("piece_no = 1").select("row_id", "field", "cut")


_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STRETCH = (
    "list_max(list_transform(string_split(regexp_replace(regexp_replace({c}, '([.!?؟؛])" + _SPACE + "+', '\\1' || chr(1), 'g'), "
    "'[ \t]*[\\r\\n]" + _SPACE + "*', chr(1), 'g'), chr(1)), lambda x: length(x)))"
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p5_found": p5_found, "p5_pieces": p5_pieces}
ORACLE: dict[str, str] = {
    "p5_found": " UNION ALL ".join(
        f"SELECT row_id, '{f}' AS field, CASE WHEN {_STRETCH.replace('{c}', f)} > {n} THEN 'forced' ELSE 'natural' END AS cut FROM text_chunks WHERE length({f}) > {n}"
        for f, n in LIMITS.items()
    )
}
