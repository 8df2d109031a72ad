"""Problem 3: one consistent form for texts that look the same.

Words that hold a look-alike, an ignorable or a compatibility character are run through a
weighted edit automaton over a trie of the corpus's clean words: following a character that
looks like the trie's edge costs nothing, nor does skipping an ignorable character, every
other edit would cost one and is not taken.  Of the words reached at no cost the most
frequent becomes the canonical spelling; tokens that reach none are normalized by table.

Words that reach each other at no cost have one skeleton (ignorables dropped, every
character by its look-alike class), so the vocabulary and the odd tokens are partitioned by
a hash of the skeleton and sorted by it, and a task holds the trie of one skeleton at a time:
no vocabulary is collected or broadcast.  Word counts are taken over all rows and pre-aggregated in the
tasks before they are shuffled.

Null values give no row; empty and blank ones only if they hold a space or an invisible
character that is odd.  Repeated rows give repeated results; ties between equally frequent
spellings go to the smaller in code point order.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CACHE, Counts, map_rows, shared_checkpoint, table
from .lookalikes import CYRILLIC, GREEK, HYPHENS, IGNORABLE, KEEP, OTHER_LATIN, PLAIN, SPACES, TASHKEEL, TO_ARABIC, TO_LATIN, TO_PERSIAN, plain_forms

FIELDS = ("raw_text", "heading", "chapter")

_EITHER = re.compile(f"[{''.join(TO_ARABIC | TO_PERSIAN)}]")
TOKEN = re.compile(r"[^\W_]+(?:[^\W_]|[" + re.escape(IGNORABLE + TASHKEEL) + r"̀-ٓͯ-ٕ])*")
_WORDLY = re.compile(r"[^\s\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e،؛؟«»“”„–—…|¡¿]+")

#: Look-alike class of a character: what a skeleton holds in its place.
CLASS = {ord(a): b for a, b in (TO_LATIN | TO_ARABIC).items()} | {ord("ى"): "ي"} | {ord(c): None for c in IGNORABLE + TASHKEEL}


def odd(value: str) -> bool:
    """Could this value hold an odd character?  Of plain characters only the letters that Persian and Arabic spell differently could be."""
    return not PLAIN.fullmatch(value) or bool(_EITHER.search(value))


def skeleton(token: str) -> str:
    """One form for all tokens that reach each other at no cost."""
    t = unicodedata.normalize("NFKC", "".join(c if c in KEEP else unicodedata.normalize("NFKC", c) for c in token)) if not token.isascii() else token
    return t.translate(CLASS).lower()


# Evidence for a language: letters that only it has count double, those that fonts confuse once.
_AR = re.compile(r"[ةأإؤى]|^[وفبلك]?ال|^لل")
_FA = re.compile(r"[پچژگ]|[ء-ۓ]\u200c[ء-ۓ]")
_AR_WEAK, _FA_WEAK = re.compile(r"[يك]"), re.compile(r"[یک]")
# Function words that only one of the two languages has.
_AR_WORDS = {"في", "من", "على", "أن", "إلى", "هل", "ما", "لا", "عن", "ثم", "قبل", "مع", "هو", "كما"}
_FA_WORDS = {"از", "در", "به", "را", "با", "است", "این", "که", "چرا", "آن", "برای", "هم"}
_SEGMENT = re.compile(r"\n|[\"“”„«»]|\r")


def arabic_or_persian(words: list[str]) -> str:
    """Whose words most of these are: 'ar', 'fa' or '' (no evidence, or as much for both)."""
    a = sum(2 * (w in _AR_WORDS or bool(_AR.search(w))) + bool(_AR_WEAK.search(w)) for w in words)
    p = sum(2 * (w in _FA_WORDS or bool(_FA.search(w))) + bool(_FA_WEAK.search(w)) for w in words)
    return "ar" if a > p else "fa" if p > a else ""


def strange(token: str, kind: str) -> bool:
    """Does the token hold a character that is not the usual one here?  ``kind``: the language of Arabic script around it."""
    if token.isascii():
        return False
    latin = foreign = False
    for i, ch in enumerate(token):
        if ch < "\x80":
            latin = latin or ch.isalpha()
            continue
        if ch in KEEP:
            continue
        if ch in IGNORABLE:
            if ch == "‌" and 0 < i < len(token) - 1 and "ء" <= token[i - 1] <= "ۓ" and "ء" <= token[i + 1] <= "ۓ" and kind != "ar":
                continue
            return True
        if ch in CYRILLIC or ch in GREEK or ch in OTHER_LATIN:
            foreign = True
        elif "À" <= ch <= "ÿ":
            latin = True
        elif kind == "ar" and ch in TO_ARABIC or kind == "fa" and ch in TO_PERSIAN:
            return True
        elif unicodedata.normalize("NFKC", ch) != ch or unicodedata.category(ch) in ("Cn", "Co"):
            return True
    if foreign and (latin or all(c in TO_LATIN for c in token) and (len(token) > 1 or token in CYRILLIC)):
        return True
    return len(unicodedata.normalize("NFC", token)) < len(token)


def by_table(token: str, kind: str) -> str:
    """The token without a vocabulary: plain forms, composed, look-alikes by the table of its script."""
    t = plain_forms(token)
    if kind == "ar":
        t = t.replace("‌", "")
    t = t.translate({ord(c): None for c in IGNORABLE if c != "‌"})
    if kind:
        t = t.translate({ord(a): b for a, b in (TO_ARABIC if kind == "ar" else TO_PERSIAN).items()})
    if not any("\u0621" <= c <= "\u06d3" for c in t):
        t = t.translate({ord(a): b for a, b in TO_LATIN.items()})
    return unicodedata.normalize("NFC", t)


def tokens_of(text: str) -> Iterator[tuple[str, str]]:
    """(token, language of Arabic script around it) of a text; lines and quoted phrases stand alone."""
    for part in _SEGMENT.split(text):
        words = _WORDLY.findall(part)
        if not words:
            continue
        kind = arabic_or_persian(words) if any("؀" <= c <= "ۿ" or c >= "ﭐ" for c in part) else ""
        for w in words:
            yield w, kind


def strange_tokens(text: str) -> list[tuple[str, str]]:
    """The tokens that need a canonical form; odd spaces, hyphens and invisible characters outside of words are tokens of their own."""
    out = [(w, kind) for w, kind in tokens_of(text) if strange(w, kind)]
    out += [(c, "") for c in set(text) if c in SPACES or c in HYPHENS or c in IGNORABLE and c != "‌"]
    return out


class Trie:
    """Clean words with their counts; edges are characters."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, n: int) -> None:
        node = self.root
        for ch in word:
            node = node.setdefault(ch, {})
        node[""] = node.get("", 0) + n

    def reach(self, token: str) -> list[tuple[int, str]]:
        """(count, word) of every word that the automaton reaches at cost zero.

        A state is a trie node and the spelling so far.  A character of the token follows the
        edges of its look-alike class, ignorable ones stay; on the trie's side ignorable
        edges (tashkeel, joiners) are followed for nothing.
        """
        states = self._skip([(self.root, "")])
        for ch in unicodedata.normalize("NFKC", token):
            c = ch.translate(CLASS)
            if not c:
                continue
            step = [(child, word + edge) for node, word in states for edge, child in node.items() if edge and same(edge, c)]
            states = self._skip(step)
            if not states:
                return []
        return [(node[""], word) for node, word in states if "" in node]

    @staticmethod
    def _skip(states: list[tuple[dict, str]]) -> list[tuple[dict, str]]:
        out = list(states)
        for node, word in out:
            out += [(child, word + edge) for edge, child in node.items() if edge and edge.translate(CLASS) == ""]
        return out


_same: dict[tuple[str, str], bool] = {}


def same(edge: str, c: str) -> bool:
    """Do an edge and a character's class look alike?"""
    got = _same.get((edge, c))
    if got is None:
        got = _same[(edge, c)] = edge.translate(CLASS) == c
    return got


def canonical_of(token: str, kind: str, trie: Trie) -> tuple[str, str]:
    """(canonical spelling, 'vocabulary' or 'table')."""
    reached = [(n, w) for n, w in trie.reach(token) if not strange(w, kind)]
    fits = [x for x in reached if x[1][:1].isupper() == by_table(token, kind)[:1].isupper()] or reached
    if fits:
        n, word = max(fits, key=lambda x: (x[0], [-ord(c) for c in x[1]]))
        return word, "vocabulary"
    return by_table(token, kind), "table"


def census(values: DataFrame) -> DataFrame:
    """One pass over all values (row_id, field, value): clean words and odd tokens with their counts, added up in the tasks, and the odd tokens of each value.

    (skeleton, form, kind, n, row_id, field): ``kind`` is null for clean words, ``row_id`` is null for counts.
    """
    schema = pa.schema([("skeleton", pa.string()), ("form", pa.string()), ("kind", pa.string()), ("n", pa.int64()), ("row_id", pa.int64()), ("field", pa.string())])

    def rows(items: list, hits: list) -> dict[str, list]:
        forms = [k if isinstance(k, str) else k[0] for k, _ in items]
        return {
            "skeleton": [skeleton(f) for f in forms] + [None] * len(hits),
            "form": forms + [h[2] for h in hits],
            "kind": [None if isinstance(k, str) else k[1] for k, _ in items] + [h[3] for h in hits],
            "n": [n for _, n in items] + [0] * len(hits),
            "row_id": [None] * len(items) + [h[0] for h in hits],
            "field": [None] * len(items) + [h[1] for h in hits],
        }

    def make() -> Callable:
        counts = Counts()
        known: set[tuple[str, str]] = set()

        def one(c: dict[str, list]) -> dict[str, list] | None:
            if not c:
                return rows(counts.drain(), [])
            hits: list[tuple] = []
            for i, f, value in zip(c["row_id"], c["field"], c["value"], strict=True):
                if odd(value):
                    found = set(strange_tokens(value))
                    hits += [(i, f, w, k) for w, k in found]
                    counts.add(x for x in found if x not in known)
                    known.update(found)
                    if len(known) > CACHE:
                        known.clear()
                    counts.add(w for w, k in tokens_of(value) if not strange(w, k))
                else:
                    counts.add(_WORDLY.findall(value))
            return rows(counts.drain() if counts.full else [], hits) if hits or counts.full else None

        return one

    return map_rows(values, make, schema, "skeleton string, form string, kind string, n bigint, row_id bigint, field string", after=lambda one: one({}))


def canonical_forms(counted: DataFrame) -> DataFrame:
    """(form, kind, canonical, origin) of every distinct odd token of a census."""
    total = counted.filter("row_id IS NULL").groupBy("skeleton", "form", "kind").agg(F.sum("n").alias("n"))
    # A word seen once could itself be a slip, so it is no canonical spelling; odd tokens stay in any case.
    useful = total.filter("kind IS NOT NULL OR n > 1")
    # Clean words come before the odd ones of their skeleton, so the trie is whole when those are run through it.
    parts = useful.repartition(F.col("skeleton")).sortWithinPartitions("skeleton", F.col("kind").isNotNull(), "form")
    schema = pa.schema([("form", pa.string()), ("kind", pa.string()), ("canonical", pa.string()), ("origin", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, trie = None, Trie()
        for batch in batches:
            got = []
            for sk, form, kind, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sk != current:
                    current, trie = sk, Trie()
                if kind is None:
                    trie.add(form, n)
                else:
                    got.append((form, kind, *canonical_of(form, kind, trie)))
            yield pa.RecordBatch.from_pydict({name: [r[j] for r in got] for j, name in enumerate(schema.names)}, schema=schema)

    return parts.select("skeleton", "form", "kind", "n").mapInArrow(run, "form string, kind string, canonical string, origin string")


def field_values(df: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """(row_id, field, value) of the given fields, nulls left out."""
    each = F.array(*(F.struct(F.lit(n).alias("field"), c.cast("string").alias("value")) for n, c in fields.items()))
    return df.select(F.col(key).cast("bigint").alias("row_id"), F.inline(each)).filter("value IS NOT NULL")


def inconsistent(values: DataFrame) -> DataFrame:
    """(row_id, field, form, canonical, origin): every odd token with its canonical spelling.

    The census is written once to the shared checkpoint; both its halves are read from there.
    """
    counted = shared_checkpoint(census(values))
    tokens = counted.filter("row_id IS NOT NULL").select("row_id", "field", "form", "kind")
    return tokens.join(canonical_forms(counted), ["form", "kind"]).filter("canonical <> form").select("row_id", "field", "form", "canonical", "origin")


def consistent_text(text: str | None, forms: dict[str, str] | None) -> str | None:
    """A text with the canonical spellings of its odd tokens, and the table for all else.  Only whole tokens are replaced."""
    if text is None:
        return None
    known = forms or {}
    return plain_forms(_WORDLY.sub(lambda m: known.get(m[0], m[0]), text))


def chunk_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "rag_chunks")
    return field_values(df, "row_id", {"raw_text": F.col("raw_text"), "heading": F.col("metadata.heading"), "chapter": F.col("metadata.chapter")})


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of rag_chunks that hold characters other than the usual ones."""
    return inconsistent(chunk_values(spark, sf_dir)).select("row_id", "field").distinct()


def p3_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value that changes, in its consistent form."""
    values = chunk_values(spark, sf_dir)
    forms = inconsistent(values).groupBy("row_id", "field").agg(F.sort_array(F.collect_set(F.struct("form", "canonical"))).alias("forms"))
    schema = pa.schema([("row_id", pa.int64()), ("field", pa.string()), ("value", pa.string())])

    def make() -> Callable:
        def one(c: dict[str, list]) -> dict[str, list]:
            return {"row_id": c["row_id"], "field": c["field"], "value": [consistent_text(v, {x["form"]: x["canonical"] for x in f}) for v, f in zip(c["value"], c["forms"], strict=True)]}

        return one

    return map_rows(values.join(forms, ["row_id", "field"]), make, schema, "row_id bigint, field string, value string")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p3_found": p3_found, "p3_text": p3_text}
ORACLE: dict[str, str] = {}
