"""Problem 1: noise in text from scanned pages, found and repaired.

Words are grouped by a confusable-glyph skeleton (0 as o, 1 as l, rn as m, a bar as lam ...).
A word was misread if a far more frequent form has its skeleton and the words beside it
support that form; words that hold a sign inside, and long ones, need no support beyond the
skeleton.  Two words that ran together are told by the pair of words that they make, one that
was split by the word that its parts make; either must be far more frequent than the odd one.
Words broken over a line end are put together first, so that their parts are not taken for
misread words.

Forms and pairs of words are counted over all distinct texts of both tables, so that copies of
one bad page do not make its words known.  All of them count, at any size: the counts are
joined by a shuffle to the words in question.  Only to spare most words that join, the forms
with at least ``SHARE`` of all words (so never more than 1 / SHARE of them) that have no
twin in their skeleton are known to the workers as words beyond doubt.

Lines outside of the running text are compared with digits masked: a line is a running title
if its masked form recurs on several pages of its book or is built from the book's title or
subject; page numbers are read off such lines or stand alone.  A line of more than ``TITLE``
characters is running text.  The texts are put together again line by line with SQL windows:
broken words joined, running titles and page numbers left out, lines of a paragraph joined by
spaces; list items, headings and columns of numbers keep their lines.

Null and blank texts give no row.  Repeated rows give repeated results, but count as one
page for recurrence.  Books without a registry row are judged by recurrence alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Counts, bounded_rows, map_rows, ordinal_lines, shared_checkpoint, table
from .lookalikes import PLAIN, TASHKEEL, fold

#: Share of all words that a form beyond doubt has.
SHARE = 4e-6
#: Counts from which a form, a pair of words and a compound are known.
LEAST, LEAST_PAIR, LEAST_COMPOUND = 6, 3, 2
#: A known form so many times rarer than its twin is no word of its own; a rare one needs a twin, pair or whole so many times more frequent.
RATIO, RARER = 40, 4
#: Parts of a split word may be so many times more frequent than the whole.
PARTS = 20
#: Most characters of a line that could be a running title.
TITLE = 150

# Glyphs that scans confuse; the first of each is what the skeleton holds.
GLYPHS = {"o": "0", "i": "!", "l": "1", "s": "5$", "g": "9", "b": "6", "a": "@", "t": "f+", "c": "eéèêë¢€", "ل": "|", "ي": "þى", "م": "¤", "ن": "ñ", "ر": "ß", "ت": "Ë", "ب": "ٮ", "ق": "Ø", "ع": "Ð", "ج": "ïخحچ", "ف": "ڡ", "ه": "§", "ص": "ض", "ط": "ظ"}
ONE_LETTER = set("aàeoyó")
PAIRS = {"rn": "m", "ii": "u", "vv": "w", "cl": "d", "li": "h"}
ARABIC_MARKS = "|¤§ßþñËØÐï"
HYPHEN_MARKS = "-¬–=‐­~"

_AT_END = re.compile(rf"[{re.escape(HYPHEN_MARKS)}][ \t]*[\r\n]")
_CLASS = {ord(x): k for k, xs in GLYPHS.items() for x in xs}
# Words are compared in one spelling of Arabic and Persian letters.
_ONE = {ord(c): None for c in TASHKEEL} | {ord("ی"): "ي", ord("ک"): "ك"}
_IN_ARABIC = re.compile("[؀-ۿ]")
_BASE = r"A-Za-zÀ-ÖØ-öø-ÿŒœŠšŸ"
_ARABIC = "ء-يٮ-ۓ"
TOKEN = re.compile(rf"[{_BASE}0-9{_ARABIC}‌](?:[{_BASE}0-9{_ARABIC}‌@!|¤§$]*[{_BASE}0-9{_ARABIC}@])?")
_ARABIC_ODD = re.compile(rf"[ء-ي][{re.escape(ARABIC_MARKS)}]|[{re.escape(ARABIC_MARKS)}][ء-ي]|[ٮڡ]")
_LATIN_ODD = re.compile(rf"[{_BASE}][@!0-9$][{_BASE}]|[a-zà-öø-ÿ][@0-9]|[@!][a-zà-öø-ÿ]")
_GLUED = re.compile(r"[a-zà-öø-ÿ][A-ZÀ-ÖØ-Þ]")
_BROKEN = re.compile(rf"([{_BASE}@!0-9{_ARABIC}|¤§\u200c]+)([{re.escape(HYPHEN_MARKS)}])[ \t]*(?:\r\n|\n|\r)[ \t]*([{_BASE}@!0-9{_ARABIC}|¤§]+)")
_COMPOUND = re.compile(rf"[{_BASE}]+(?:-[{_BASE}]+)+")


def prepare(text: str) -> str:
    """The text as its words are compared: plain characters, without tashkeel, Persian letters as Arabic ones."""
    if not PLAIN.fullmatch(text):
        text = fold(text)
    return text.translate(_ONE) if not text.isascii() and _IN_ARABIC.search(text) else text


def skeleton(word: str, merge: bool = True) -> str:
    """The word with every confusable glyph by its class."""
    w = word.lower()
    if merge:
        for pair, one in PAIRS.items():
            if pair in w:
                w = w.replace(pair, one)
    return w.translate(_CLASS)


def broken_words(text: str) -> list[tuple[str, str, str]]:
    """(first part, mark, second part) of the words that a mark could break over a line end."""
    out = []
    for m in _BROKEN.finditer(text):
        a, mark, b = m.groups()
        letters = (a[-1].isalpha() or a[-1] in "@!|¤§") and (b[0].isalpha() or b[0] in "@!|¤§")
        title = b[0].isupper() and not a[-1].isupper() and mark in "-–="  # a dash before the next line
        if letters and not title or b[0].isupper() and a.isupper():
            out.append((a, mark, b))
    return out


def whole_words(text: str) -> tuple[str, list[tuple[str, str, str]]]:
    """(the prepared text with its broken words put together, those words)."""
    if not _AT_END.search(text):
        return prepare(text), []
    text = prepare(text.replace("\xad", "¬"))  # a soft hyphen at a line end is a mark, not nothing
    found = broken_words(text)
    return (_BROKEN.sub(r"\1\3", text) if found else text), found


def word_stats(texts: DataFrame) -> DataFrame:
    """(key, n): words 'w', pairs of words 'p' and compounds 'h' of all texts in lower case, counted in the tasks first."""
    schema = pa.schema([("key", pa.string()), ("n", pa.int64())])

    def make() -> Callable:
        words, pairs = Counts(), Counts(500_000)

        def rows() -> dict[str, list]:
            w, p = words.drain(), pairs.drain()
            return {"key": [k for k, _ in w] + [f"p{a} {b}" for (a, b), _ in p], "n": [n for _, n in w] + [n for _, n in p]}

        def one(c: dict[str, list]) -> dict[str, list] | None:
            if not c:
                return rows()
            count = words.n
            for text in c["text"]:
                body = whole_words(text)[0].lower()
                found = TOKEN.findall(body)
                for w in found:
                    k = "w" + w
                    count[k] = count.get(k, 0) + 1
                pairs.add(zip(found, found[1:]))
                if "-" in body:
                    words.add("h" + x for x in _COMPOUND.findall(body))
            return rows() if words.full or pairs.full else None

        return one

    counted = map_rows(texts.select("text"), make, schema, "key string, n bigint", after=lambda one: one({}))
    return counted.groupBy("key").agg(F.sum("n").alias("n"))


def spoilt(w: str) -> bool:
    """Does the word hold a sign or digit where words have letters?"""
    if _ARABIC_ODD.search(w):
        return True
    return bool(_LATIN_ODD.search(w)) and any(c.isalpha() for c in w) and not re.fullmatch(r"[A-Z0-9]+|[0-9]+[a-z]{1,3}|[a-z][0-9]+", w)


def skeletons(w: str) -> set[str]:
    return {skeleton(w), skeleton(w, False)}


def sure_forms(stats: DataFrame, share: float = SHARE) -> frozenset[str]:
    """Forms with at least ``share`` of all words but those that a form of their skeleton outnumbers ``RATIO`` times: at most 1 / share."""
    words = stats.filter(F.col("key").startswith("w"))
    total = words.agg(F.sum("n").alias("t")).first()["t"] or 0
    floor = max(LEAST, int(total * share) + 1)
    rows = bounded_rows(words.filter(F.col("n") >= floor), int(1 / share) + 1)
    counts = {r["key"][1:]: r["n"] for r in rows}
    best: dict[str, int] = {}
    for w, n in counts.items():
        if len(w) > 2 and not spoilt(w):
            for sk in skeletons(w):
                best[sk] = max(best.get(sk, 0), n)
    return frozenset(w for w, n in counts.items() if len(w) < 3 or not spoilt(w) and max(best.get(sk, 0) for sk in skeletons(w)) < RATIO * n)


def twin_limit(w: str, n: int) -> int:
    """How often a form must occur to be what a word that occurs n times was misread from."""
    return max(2, n) if spoilt(w) else RATIO * n if n >= LEAST else max(LEAST, RARER * n)


def splits(w: str) -> list[tuple[str, str]]:
    """Where two words could have run together."""
    least = 3 if w[0] >= "\u0600" else 2
    return [(w[:k], w[k:]) for k in range(1, len(w)) if (k >= least or w[:k] in ONE_LETTER) and (len(w) - k >= least or w[k:] in ONE_LETTER)]


def word_verdicts(words: DataFrame, stats: DataFrame) -> DataFrame:
    """(word, meant, apart): of each word (in lower case) the more frequent forms of its skeleton, the most frequent first, and the two words that ran together in it.

    Words of which neither is found give no row.
    """
    ask = pa.schema([("word", pa.string()), ("key", pa.string())])
    fact = pa.schema([("key", pa.string()), ("form", pa.string()), ("n", pa.int64())])

    def asks() -> Callable:
        def one(c: dict[str, list]) -> dict[str, list]:
            rows = [(w, k) for w in c["word"] for k in ("w" + w, *("s" + sk for sk in sorted(skeletons(w)) if len(w) > 2), *(f"p{a} {b}" for a, b in splits(w)))]
            return {"word": [r[0] for r in rows], "key": [r[1] for r in rows]}

        return one

    def twins() -> Callable:
        def one(c: dict[str, list]) -> dict[str, list]:
            rows = [("s" + sk, k[1:], n) for k, n in zip(c["key"], c["n"], strict=True) if len(k) > 3 and not spoilt(k[1:]) for sk in sorted(skeletons(k[1:]))]
            return {"key": [r[0] for r in rows], "form": [r[1] for r in rows], "n": [r[2] for r in rows]}

        return one

    def judge() -> Callable:
        def one(c: dict[str, list]) -> dict[str, list]:
            rows = []
            for w, facts in zip(c["word"], c["facts"], strict=True):
                n = max([f["n"] for f in facts if f["key"][0] == "w"], default=1)
                least = twin_limit(w, n)
                near = {f["form"]: f["n"] for f in facts if f["key"][0] == "s" and f["form"] != w and f["n"] >= least}
                pair = max(((f["n"], f["key"][1:]) for f in facts if f["key"][0] == "p" and f["n"] >= max(LEAST_PAIR, RARER * n)), default=(0, None))[1]
                if near or pair:
                    rows.append((w, sorted(near, key=lambda f: (-near[f], f)), pair))
            return {"word": [r[0] for r in rows], "meant": [r[1] for r in rows], "apart": [r[2] for r in rows]}

        return one

    wanted = map_rows(words.select("word"), asks, ask, "word string, key string")
    own = stats.filter(~F.col("key").startswith("h")).select("key", F.substring("key", 2, 2**31 - 1).alias("form"), "n")
    by_skeleton = map_rows(stats.filter(F.col("key").startswith("w")), twins, fact, "key string, form string, n bigint")
    facts = wanted.join(own.unionByName(by_skeleton), "key").groupBy("word").agg(F.collect_list(F.struct("key", "form", "n")).alias("facts"))
    schema = pa.schema([("word", pa.string()), ("meant", pa.list_(pa.string())), ("apart", pa.string())])
    return map_rows(facts, judge, schema, "word string, meant array<string>, apart string")


def with_counts(rows: DataFrame, by: list[str], keys: dict[str, Column], stats: DataFrame) -> DataFrame:
    """``by`` and the count of each key (0 if it never occurs), for distinct ``by``."""
    each = F.array(*(F.struct(F.lit(name).alias("name"), key.alias("key")) for name, key in keys.items()))
    asked = rows.select(*by, F.inline(each)).join(stats, "key", "left")
    return asked.groupBy(*by).agg(*(F.coalesce(F.max(F.when(F.col("name") == name, F.col("n"))), F.lit(0)).alias(name) for name in keys))


def misread(odd: DataFrame, stats: DataFrame) -> DataFrame:
    """(src, row_id, wrong, right) of the words (src, row_id, before, word, after) that are spoilt."""
    low = odd.withColumn("low", F.lower("word")).withColumn("before", F.lower("before")).withColumn("after", F.lower("after"))
    row, join = ["src", "row_id"], lambda *c: F.concat(*(F.lit(x) if isinstance(x, str) and len(x) < 2 else F.col(x) for x in c))
    verdicts = shared_checkpoint(word_verdicts(low.select(F.col("low").alias("word")).distinct(), stats)).withColumnRenamed("word", "low")
    # Misread for another form: supported by a neighbour, or of itself.
    cases = low.join(verdicts, "low")
    sign = F.col("low").rlike(_LATIN_ODD.pattern) | F.col("low").rlike(_ARABIC_ODD.pattern)
    free = sign | (F.length("low") > 7) & (F.length(F.get("meant", F.lit(0))) > 7)
    alone = cases.filter((F.size("meant") > 0) & free).select(*row, F.col("word").alias("wrong"), F.get("meant", F.lit(0)).alias("right"))
    each = cases.filter(~free).select(*row, "word", "before", "after", F.posexplode("meant").alias("at", "form"))
    beside = each.select(*row, "word", "at", "form", F.explode(F.array(join("p", "before", " ", "form"), join("p", "form", " ", "after"))).alias("key")).join(stats.filter(F.col("n") >= LEAST_PAIR), "key")
    supported = beside.groupBy(*row, F.col("word").alias("wrong")).agg(F.min_by("form", "at").alias("right"))
    apart = cases.filter("apart IS NOT NULL").select(*row, F.col("word").alias("wrong"), F.col("apart").alias("right"))
    # One word split in two: neither part is far more frequent than the whole, the parts hardly ever stand side by side.
    parts = low.select(*row, F.inline(F.array(F.struct(F.col("before").alias("a"), F.col("low").alias("b")), F.struct(F.col("low").alias("a"), F.col("after").alias("b"))))).filter("a <> '' AND b <> '' AND length(a) + length(b) > 3")
    wholes = parts.withColumn("key", F.concat(F.lit("w"), "a", "b")).join(stats.filter((F.col("n") >= LEAST) & F.col("key").startswith("w")), "key").select(*row, "a", "b", F.col("n").alias("whole")).distinct()
    split = with_counts(wholes, [*row, "a", "b", "whole"], {"n_a": F.concat(F.lit("w"), "a"), "n_b": F.concat(F.lit("w"), "b"), "n_pair": F.concat(F.lit("p"), "a", F.lit(" "), "b")}, stats)
    split = split.filter((F.col("n_pair") * RARER <= F.col("whole")) & (F.greatest("n_a", "n_b") < PARTS * F.col("whole")))
    return alone.unionByName(supported).unionByName(apart).unionByName(split.select(*row, F.concat_ws(" ", "a", "b").alias("wrong"), F.concat("a", "b").alias("right"))).distinct()


def compounds(breaks: DataFrame, stats: DataFrame) -> DataFrame:
    """(src, row_id, a, b, natural) of words (src, row_id, a, mark, b) at line ends: natural ones are written with their hyphen anyway."""
    a, b = F.lower("a"), F.lower("b")
    by = ["src", "row_id", "a", "mark", "b"]
    n = with_counts(breaks, by, {"whole": F.concat(F.lit("w"), a, b), "compound": F.concat(F.lit("h"), a, F.lit("-"), b), "n_a": F.concat(F.lit("w"), a), "n_b": F.concat(F.lit("w"), b)}, stats)
    known = (F.col("n_a") >= LEAST) & (F.col("n_b") >= LEAST) & (F.length("b") < 4) & (F.length("a") > 2)
    natural = F.col("mark").isin("-", "‐") & (F.col("whole") < LEAST) & ((F.col("compound") >= LEAST_COMPOUND) | known)
    return n.select(*by, natural.alias("natural"))


# Lines outside of the running text ---------------------------------------------------

# The word for a page in the languages of the texts.
_PAGE = r"(?:page|seite|página|pagina|صفحة|صفحه)"
_ANY = r"(?:\d{1,4}|[ivxlcdm]{1,8}|[٠-٩]{1,4}|[۰-۹]{1,4})"
_NUMBER = re.compile(rf"([-–—.\[(]\s*)?({_PAGE}\s*)?({_ANY})(\s*/\s*[\d٠-٩۰-۹]+)?\s*([-–—.\])])?", re.I)
_BESIDE = rf"(?:[-–—.\[(] ?{_ANY} ?[-–—.\])]|(?:{_PAGE}\s*)?{_ANY}(?:\s*/\s*[\d٠-٩۰-۹]+)?)"
_LEADS = re.compile(rf"({_BESIDE})(?:\t\s*|\s{{2,}}(?:[–—|]\s+)?|\s+[–—|]\s+)(.*\S)", re.I)
_TRAILS = re.compile(rf"(\S.*?)(?:\s*\t\s*|(?:\s+[–—|])?\s{{2,}}|\s+[–—|]\s+)({_BESIDE})", re.I)
_FORMULA = re.compile(r"[=√≈×÷]")
_DIGITS = re.compile(r"[\d٠-٩۰-۹]+")
_END = ".!?؟؛:;,،"
_NUMERIC = re.compile(r"[\s\d٠-٩۰-۹.,|%+−-]+")


def page_number(part: str) -> tuple[bool, bool, str] | None:
    """(has a word or decoration, is Roman, digits) if the part is a page number."""
    m = _NUMBER.fullmatch(part)
    if not m:
        return None
    opened, word, number, total, closed = m.groups()
    roman = number[0].isalpha()
    if opened and not closed or closed and not opened:
        return None
    return bool(opened or word or total), roman, number


def masked(line: str) -> str:
    """A line with digits masked, in lower case, spaces made one."""
    return re.sub(r"\s+", " ", _DIGITS.sub("#", line)).strip(" \t–—|…").lower()


def outer_lines(text: str) -> list[tuple[int, str, str, bool, bool, bool]]:
    """Lines that could stand outside of the running text:
    (line number, masked title, number, number is decorated, line stands out, ends in …).
    """
    lines = ordinal_lines(text)
    full = [i for i, x in enumerate(lines) if x.strip()]
    if not full:
        return []
    widest = max(len(lines[i]) for i in full)
    out = []
    for k, i in enumerate(full):
        raw = lines[i].rstrip("\r")
        s = raw.strip()
        if len(s) > TITLE:
            continue
        edge = k == 0 or k == len(full) - 1
        above = lines[full[k - 1]].strip() if k else ""
        below = lines[full[k + 1]].strip() if k + 1 < len(full) else ""
        alone = (i == 0 or not lines[i - 1].strip()) and (i == len(lines) - 1 or not lines[i + 1].strip())
        number = page_number(s)
        if number:
            decorated, roman, digits = number
            if any(x and _NUMERIC.fullmatch(x) for x in (above, below)) and not decorated:
                continue  # a column of numbers
            if roman and not (edge or alone or raw[:2] == "  "):
                continue
            out.append((i, "", digits, decorated or roman or raw[:2] == "  ", edge or alone, False))
            continue
        found = None
        for m, at in ((_TRAILS.fullmatch(s), 2), (_LEADS.fullmatch(s), 1)):
            if m and any(c.isalpha() for c in m[3 - at]) and not _NUMERIC.fullmatch(re.split(r"\s\|\s", m[3 - at])[-1]):
                found = page_number(m[at])
                if found:
                    s = m[3 - at]
                    break
        cut = len(s) < 70 and s.endswith("…") and not s[:-1].endswith((" ", "."))
        if not any(c.isalpha() for c in s) or s[-1] in _END or _FORMULA.search(s):
            continue
        marked = cut or bool(re.search(r" [–—|·] |, [^\W\d_]+$|\d$", s)) and not _NUMERIC.search(re.split(r"\s\|\s", s)[-1][:1] or "x")
        short = len(raw) < 0.75 * widest or len(full) == 1
        if found or marked or (short or alone) and len(s) < 100:
            out.append((i, masked(s), found[2] if found else "", bool(found and (found[0] or found[1])), edge or alone, cut))
    return out


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, row_id, book, place, page, text) of loaded_pages and rag_chunks, blank texts left out."""
    pages = table(spark, sf_dir, "loaded_pages").select(
        F.lit("loaded_pages").alias("src"), "row_id", F.col("file_reference_id").alias("book"), F.concat(F.lit("p"), F.col("doc_idx").cast("string")).alias("place"), F.col("page").cast("string").alias("page"), "text"
    )
    chunks = table(spark, sf_dir, "rag_chunks").select(
        F.lit("rag_chunks").alias("src"), "row_id", F.col("metadata.file_reference_id").alias("book"), F.concat(F.lit("c"), F.col("chunk_id")).alias("place"), F.col("metadata.page").cast("string").alias("page"), F.col("raw_text").alias("text")
    )
    return pages.unionByName(chunks).filter(F.col("text").rlike(r"\S"))


def learn(texts: DataFrame) -> DataFrame:
    """Counts of all forms, pairs and compounds that occur more than once, written to the shared checkpoint."""
    return shared_checkpoint(word_stats(texts.select("text").distinct()).filter("n > 1"))


def inspect(texts: DataFrame, sure: frozenset[str]) -> DataFrame:
    """(src, row_id, kind, book, place, page, line, a, b, c, decorated, apart, cut): what is to be judged of each text.

    'word': a word b that is not beyond doubt, between a and c; 'break': parts a and c of a word, broken by b;
    'line': a line that could stand outside of the running text, with its masked title a and number b.
    """
    shared = texts.sparkSession.sparkContext.broadcast(sure)
    schema = pa.schema(
        [("src", pa.string()), ("row_id", pa.int64()), ("kind", pa.string()), ("book", pa.string()), ("place", pa.string()), ("page", pa.string()), ("line", pa.int32()),
         ("a", pa.string()), ("b", pa.string()), ("c", pa.string()), ("decorated", pa.bool_()), ("apart", pa.bool_()), ("cut", pa.bool_())]
    )

    def make() -> Callable:
        known = shared.value

        def one(c: dict[str, list]) -> dict[str, list]:
            rows = []
            for src, i, book, place, page, text in zip(c["src"], c["row_id"], c["book"], c["place"], c["page"], c["text"], strict=True):
                body, breaks = whole_words(text)
                for a, mark, b in dict.fromkeys(breaks):
                    rows.append((src, i, "break", None, None, None, None, a, mark, b, None, None, None))
                found = TOKEN.findall(body)
                # Words of a clean page are known as they stand, but for first words of sentences and names.
                odd = [k for k, w in enumerate(found) if w not in known and w.lower() not in known and len(w) > 1 and not w.isdigit()]
                for a, w, b in dict.fromkeys((found[k - 1] if k else "", found[k], found[k + 1] if k + 1 < len(found) else "") for k in odd):
                    rows.append((src, i, "word", None, None, None, None, a, w, b, None, None, None))
                for line, title, number, decorated, apart, cut in outer_lines(text):
                    rows.append((src, i, "line", book, place, page, line, title, number, None, decorated, apart, cut))
            return {n: [r[k] for r in rows] for k, n in enumerate(schema.names)}

        return one

    return map_rows(texts, make, schema, "src string, row_id bigint, kind string, book string, place string, page string, line int, a string, b string, c string, decorated boolean, apart boolean, cut boolean")


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, book_title, book_subject): one row a book, masked like the lines."""
    mask = lambda c: F.lower(F.regexp_replace(c, r"[\d٠-٩۰-۹]+", "#"))
    subject = F.coalesce(F.col("subject"), F.regexp_extract("title", r"^(.*?)(?: [–—] .*| \d+)$", 1))
    return (
        table(spark, sf_dir, "books")
        .groupBy(F.col("file_reference_id").alias("book"))
        .agg(F.max(mask(F.col("title"))).alias("book_title"), F.max(F.when(F.length(F.trim(subject)) > 0, mask(subject))).alias("book_subject"))
    )


def judged_lines(lines: DataFrame, books: DataFrame) -> DataFrame:
    """``lines`` with ``header`` and ``pageno``: recurrence of masked titles in the book, its title and subject."""
    titled = lines.filter("title <> ''")
    often = titled.groupBy("book", "title").agg(F.countDistinct("place").alias("places"))
    t, s, full = F.col("title"), F.col("book_subject"), F.col("book_title")
    rest = t.substr(F.length(s) + 1, F.lit(200))
    by_subject = F.coalesce((t.startswith(s) & rest.rlike(r"^( ?#)?\s*($|[–—·,|…])")) | t.contains(F.concat(F.lit("| "), s)), F.lit(False))
    by_title = F.coalesce(t.startswith(full) | (F.col("cut") & full.startswith(t) & (F.length(t) > 3)), F.lit(False))
    name = t.rlike(r"^[^|]{4,} \| [^\s|\d#]+$") | t.rlike(r"^[^\s|\d#]+ \| [^|]{4,}$")
    recurs = (F.col("places") > 1) & (F.col("apart") | F.col("cut")) & t.rlike(r" [–—|·] |, \S+$|#$") & ~t.rlike(r"^(#[.#]*|\S+ #:)")
    header = by_subject | by_title | name | recurs | (F.col("cut") & F.col("apart")) | ((F.col("number") != "") & F.col("decorated"))
    judged = titled.join(often, ["book", "title"], "left").join(books, "book", "left").withColumn("header", F.coalesce(header, F.lit(False))).drop("places", "book_title", "book_subject")
    judged = judged.withColumn("pageno", F.col("header") & (F.col("number") != ""))
    digits = F.translate("number", "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")
    alone = lines.filter("title = ''").withColumn("header", F.lit(False)).withColumn("pageno", F.col("decorated") | F.col("apart") & (F.col("page").isNull() | (digits == F.col("page"))) | (digits == F.col("page")))
    return judged.unionByName(alone.withColumn("pageno", F.coalesce("pageno", F.lit(False))))


def parts_of(inspected: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The words, breaks and lines of ``inspect``."""
    words = inspected.filter("kind = 'word'").select("src", "row_id", F.col("a").alias("before"), F.col("b").alias("word"), F.col("c").alias("after"))
    breaks = inspected.filter("kind = 'break'").select("src", "row_id", "a", F.col("b").alias("mark"), F.col("c").alias("b"))
    lines = inspected.filter("kind = 'line'").select("src", "row_id", "book", "place", "page", "line", F.col("a").alias("title"), F.col("b").alias("number"), "decorated", "apart", "cut")
    return words, breaks, lines


def noise(inspected: DataFrame, stats: DataFrame, books: DataFrame) -> DataFrame:
    """(src, row_id, noise): the kinds of noise of each text."""
    words, breaks, lines = parts_of(inspected)
    of = lambda df, kind: df.select("src", "row_id", F.lit(kind).alias("noise"))
    outer = judged_lines(lines, books).filter("header OR pageno")
    outer = outer.select("src", "row_id", F.explode(F.filter(F.array(F.when(F.col("header"), F.lit("header")), F.when(F.col("pageno"), F.lit("pageno"))), lambda x: x.isNotNull())).alias("noise"))
    return of(misread(words, stats), "misread").unionByName(of(compounds(breaks, stats).filter("NOT natural"), "hyphen")).unionByName(outer).distinct()


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of noise of every page and chunk."""
    texts = sources(spark, sf_dir)
    stats = learn(texts)
    return noise(shared_checkpoint(inspect(texts, sure_forms(stats))), stats, registry(spark, sf_dir))


_KEEPS_LINE = re.compile(r"(?:[-*•–·▪◦]|\(?\d{1,3}[.)]|\(?[a-zA-Zأ-ي][.)])\s+\S|#{1,6}\s|\d+(?:\.\d+)+\s|[|]")


def stands_alone(line: str) -> bool:
    """Does a line keep its own line: a list's item, a numbered heading, a row of a table or of numbers?"""
    return bool(_KEEPS_LINE.match(line) or line.count("|") > 1 or _NUMERIC.fullmatch(line) or "\t" in line)


def mended(line: str, repairs: dict[str, str]) -> str:
    """A line with its spoilt words by what was meant, in the case they had; words are compared as they were judged."""
    if not repairs:
        return line

    def one(m: re.Match) -> str:
        right = repairs.get(prepare(m[0]).lower())
        return m[0] if right is None else right.upper() if m[0].isupper() and len(m[0]) > 1 else right[:1].upper() + right[1:] if m[0][:1].isupper() else right

    line = TOKEN.sub(one, line)
    for wrong, right in repairs.items():
        if " " in wrong:
            a, b = wrong.split(" ", 1)
            line = re.sub(rf"(?<!\w){re.escape(a)}\s+{re.escape(b)}(?!\w)", lambda m, right=right: right[:1].upper() + right[1:] if m[0][:1].isupper() else right, line, flags=re.I)
    return line


def repaired(texts: DataFrame, stats: DataFrame, books: DataFrame) -> DataFrame:
    """(src, row_id, text): the texts with noise as continuous paragraphs.

    Words are repaired text by text; lines are put together by windows over (src, row_id):
    ``lead`` tells whether a word goes on in the next line and where a paragraph ends.  A
    natural compound keeps its hyphen.
    """
    inspected = shared_checkpoint(inspect(texts, sure_forms(stats)))
    words, breaks, lines = parts_of(inspected)
    row = ["src", "row_id"]
    dropped = judged_lines(lines, books).filter("header OR pageno").select(*row, "line").distinct()
    split = compounds(breaks, stats)
    per = lambda df, name, *c: df.groupBy(*row).agg(F.sort_array(F.collect_set(F.struct(*c))).alias(name))
    wrong = per(misread(words, stats).withColumn("wrong", F.lower("wrong")), "repairs", "wrong", "right")
    kept = per(split.filter("natural").select(*row, F.lower(F.concat("a", F.lit("-"))).alias("x"), F.lower("b").alias("y")), "hyphens", "x", "y")
    noisy = wrong.select(*row).unionByName(split.filter("NOT natural").select(*row)).unionByName(dropped.select(*row)).distinct()
    schema = pa.schema([("src", pa.string()), ("row_id", pa.int64()), ("line", pa.int32()), ("part", pa.string()), ("alone", pa.bool_()), ("long", pa.bool_()), ("hyphened", pa.bool_())])

    def make() -> Callable:
        def one(c: dict[str, list]) -> dict[str, list]:
            rows = []
            for src, i, text, repairs, hyphens in zip(c["src"], c["row_id"], c["text"], c["repairs"], c["hyphens"], strict=True):
                found = {r["wrong"]: r["right"] for r in repairs or ()}
                ends = {(h["x"], h["y"]) for h in hyphens or ()}
                parts = [x.strip() for x in ordinal_lines(text)]
                widest = max(map(len, parts))
                for line, part in enumerate(parts):
                    after = parts[line + 1] if line + 1 < len(parts) else ""
                    last, first = part.rsplit(None, 1)[-1:] or [""], after.split(None, 1)[:1] or [""]
                    rows.append((src, i, line, mended(part, found), stands_alone(part), 5 * len(part) > 3 * widest, any(last[0].lower().endswith(x) and first[0].lower().startswith(y) for x, y in ends)))
            return {n: [r[k] for r in rows] for k, n in enumerate(schema.names)}

        return one

    whole_texts = texts.select(*row, "text").join(noisy, row).join(wrong, row, "left").join(kept, row, "left")
    lines = map_rows(whole_texts, make, schema, "src string, row_id bigint, line int, part string, alone boolean, long boolean, hyphened boolean")
    left = lines.join(dropped, [*row, "line"], "left_anti")
    w = Window.partitionBy(*row).orderBy("line")
    part, after = F.col("part"), F.col("after")
    # A word goes on in the next line; else lines of a paragraph are joined, but for short ones that end a sentence or stand alone.
    goes_on = F.coalesce(part.rlike(rf"[\p{{L}}@!|¤§][{re.escape(HYPHEN_MARKS)}]$") & after.rlike(r"^[\p{L}@!|¤§]"), F.lit(False))
    ends = (part == "") | (F.coalesce(after, F.lit("")) == "") | F.col("alone") | F.coalesce(F.col("next_alone"), F.lit(False)) | (~F.col("long") & part.rlike(r"[.!?؟:]$"))
    piece = F.when(goes_on & F.col("hyphened"), part).when(goes_on, part.substr(F.lit(1), F.length("part") - 1)).when(ends, F.concat(part, F.lit("\n"))).otherwise(F.concat(part, F.lit(" ")))
    glued = left.withColumn("after", F.lead("part").over(w)).withColumn("next_alone", F.lead("alone").over(w)).withColumn("piece", piece)
    out = glued.groupBy(*row).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "piece"))), lambda x: x["piece"]), "").alias("text"))
    return out.withColumn("text", F.regexp_replace(F.regexp_replace("text", r"\n\s*\n+", "\n\n"), r"^\s+|\s+$", ""))


def p1_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every noisy page and chunk as continuous paragraphs."""
    texts = sources(spark, sf_dir)
    return repaired(texts, learn(texts), registry(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p1_text": p1_text}
ORACLE: dict[str, str] = {}
