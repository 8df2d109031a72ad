"""The place in a document: what a line says of it, and the state that lines leave behind.

A line is read once into a ``Sign`` (a label, a unit, a number alone, a heading, or nothing);
``State.after`` folds signs one after the other.  A book's own table of contents (``Contents``
of :mod:`.toc`) may settle what the line leaves open: the level of a numbered heading, and
titles without any mark.  ``structure_lines`` gives one row a line that changes the place.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import TYPE_CHECKING, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

if TYPE_CHECKING:
    from .toc import Contents

LONGEST = 180

# Labels that name a level of the hierarchy.
LABELS = {
    "subject": ("subject", "discipline", "course", "المادة", "مادة"),
    "grade": ("grade", "class", "level", "year", "الصف", "صف", "المرحلة", "المستوى"),
    "chapter": ("chapter", "unit", "module", "الفصل", "الوحدة", "الوحدة الدراسية", "المحور"),
    "lesson": ("lesson", "lecture", "lesson title", "الدرس", "المحاضرة"),
    "section": ("section", "part", "subsection", "القسم", "الجزء", "الفرع"),
    "topic": ("topic", "theme", "الموضوع", "المبحث"),
}
# Levels of the hierarchy by depth, placeholders that mean nothing, marks around a value.
DEPTHS = ("chapter", "lesson", "section", "topic")
PLACEHOLDERS = frozenset({"", "null", "none", "n/a", "na", "string"})
AROUND = " \t:;-–—|[](){}"
# Letters that number sub-headings.
ORDINAL_LETTERS = "أبتثجحخدذرزسشصضطظعغ"
# The numbers of units in words.
UNIT_NUMBERS = {
    **{w: i for i, w in enumerate("first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth".split(), 1)},
    **{w: i for i, w in enumerate("one two three four five six seven eight nine ten eleven twelve".split(), 1)},
    **{w: i for i, w in enumerate(("الأولى", "الثانية", "الثالثة", "الرابعة", "الخامسة", "السادسة", "السابعة", "الثامنة", "التاسعة", "العاشرة", "الحادية عشرة", "الثانية عشرة"), 1)},
}

_LABEL = {f: re.compile(rf"(?:{'|'.join(map(re.escape, ls))})\s*[:=–—-]\s*(.+)", re.I) for f, ls in LABELS.items()}
_UNIT_WORDS = "|".join(sorted(map(re.escape, UNIT_NUMBERS), key=len, reverse=True))
_UNIT = re.compile(rf"(?:الوحدة(?:\s+الدراسية)?|unit)\s+(?:({_UNIT_WORDS})|(?:رقم\s+|no\.?\s*)?(\d{{1,2}}))\s*(?:[:–—-]\s*(.+))?", re.I)
_MARKDOWN = re.compile(r"(#{1,6})\s+(\S.*)")
_NUMBERED = re.compile(r"(\d+(?:[.-]\d+){0,5})[.):-]?\s+(.{2,170})")
_LETTERED = re.compile(rf"[{ORDINAL_LETTERS}][.):-]\s+(.{{2,80}})")
_ANCHOR = re.compile(r"\d+(?:[.-]\d+){1,5}")
_YEAR = re.compile(r"(?:19|20)\d\d")


def clean(value: str | None) -> str | None:
    """Without enclosing marks and double spaces; None for a placeholder or if nothing is left."""
    v = (value or "").strip()
    if v.casefold() in PLACEHOLDERS:
        return None
    return re.sub(r"\s+", " ", v.strip(AROUND)) or None


def split_path(value: str | list[str] | None) -> list[str]:
    """A heading path, stored as a list or joined by ' > ', as a list without blank parts."""
    parts = value.split(" > ") if isinstance(value, str) else value or []
    return [p for p in (str(x).strip() for x in parts) if p]


def label_of(line: str) -> tuple[str, str | None] | None:
    """(field, value) of a line such as 'Chapter: Motion'."""
    s = clean(line) or ""
    hits = ((name, m) for name, pattern in _LABEL.items() if (m := pattern.fullmatch(s)))
    return next(((name, clean(m[1])) for name, m in hits), None)


def unit_of(line: str) -> tuple[str, str] | None:
    """(title, chapter) of a line such as 'Unit 3: Motion'; the chapter has one name in all languages."""
    s = clean(line) or ""
    m = _UNIT.fullmatch(s)
    return (clean(m[3]) or s, f"Chapter {UNIT_NUMBERS[m[1].lower()] if m[1] else int(m[2])}") if m else None


def depth(number: str) -> int:
    return 1 + number.count(".") + number.count("-")


def anchor_of(line: str) -> int | None:
    """Level of a number such as 1-4 alone on its line, whose title is the next line."""
    s = clean(line) or ""
    return depth(s) if len(s) <= 20 and _ANCHOR.fullmatch(s) else None


def is_prose(title: str) -> bool:
    """Does a numbered line ask, exclaim, define or tell something, as headings do not?"""
    return title[-1] in "?؟!" or title[-1] == "." and len(title) > 50 or ":" in title or "：" in title or bool(_YEAR.fullmatch(title))


def markdown_heading(line: str) -> tuple[int, str] | None:
    m = _MARKDOWN.fullmatch(line.strip())
    title = clean(m[2]) if m else None
    return (len(m[1]), title) if title else None


def numbered_heading(line: str, longest: int = LONGEST) -> tuple[int, str] | None:
    """(depth of the number, title without it)."""
    s = clean(line) or ""
    m = _NUMBERED.fullmatch(s) if len(s) <= longest and s.count(" ") <= 28 and not line.strip().startswith("(") else None
    title = clean(m[2]) if m else None
    return (depth(m[1]), title) if title and not is_prose(title) else None


def lettered_heading(line: str, longest: int = 90) -> tuple[int, str] | None:
    """Short titles after an ordinal letter; their level tells nothing of the hierarchy."""
    s = clean(line) or ""
    m = _LETTERED.fullmatch(s) if len(s) <= longest and s.count(" ") <= 12 else None
    title = clean(m[1]) if m else None
    return (2, title) if title and title[-1] not in "?؟!." else None


def heading_of(line: str, longest: int = LONGEST) -> tuple[int, str, bool] | None:
    """(level, title, does the level tell the place in the hierarchy)."""
    for found, tells in ((markdown_heading(line), True), (numbered_heading(line, longest), True), (lettered_heading(line), False)):
        if found:
            return (*found, tells)
    return None


class Sign(NamedTuple):
    """What one line says: kind is label, unit, anchor, heading or '' (text)."""

    kind: str
    text: str | None = None  # the cleaned line
    name: str | None = None  # field of a label, chapter of a unit
    title: str | None = None
    level: int | None = None
    tells: bool = False


def sign_of(line: str, longest: int = LONGEST) -> Sign:
    """The one reading of a line that its neighbours do not change."""
    text = clean(line)
    level = anchor_of(line)
    if level is not None:
        return Sign("anchor", text, level=level)
    unit = unit_of(line)
    if unit:
        named = label_of(line)
        return Sign("unit", text, unit[1], unit[0], 1, named is not None)
    named = label_of(line)
    if named and named[1]:
        return Sign("label", text, *named)
    found = heading_of(line, longest)
    if found:
        return Sign("heading", text, named[0] if named else None, found[1], found[0], found[2])
    return Sign("", text, named[0] if named else None)


@dataclass
class State:
    """What is known of the place in the document."""

    heading: str | None = None
    level: int | None = None
    path: tuple[str, ...] = ()
    fields: dict[str, str] = field(default_factory=dict)
    explicit: frozenset[str] = frozenset()  # fields that a label has named; nothing else changes them
    pending: int | None = None  # level of a number whose title is the next line

    def headed(self, level: int, title: str, name: str | None = None, value: str | None = None) -> "State":
        """Under a heading; ``name`` is set to ``value`` unless a label has named it."""
        fields = self.fields | ({name: value or title} if name and name not in self.explicit else {})
        return State(title, level, (*self.path[: level - 1], title), fields, self.explicit)

    def after(self, sign: Sign, contents: "Contents | None" = None) -> tuple["State", bool]:
        """(state after a line, did the line change it)."""
        here = replace(self, pending=None)
        by_depth = lambda level: DEPTHS[level - 1] if level <= len(DEPTHS) else None
        named = sign.name is not None and sign.kind in ("label", "", "heading") or sign.kind == "unit" and sign.tells
        if self.pending is not None and sign.text and not named and sign.kind != "anchor":
            new = here.headed(self.pending, sign.text, by_depth(self.pending))
            return new, new.heading != self.heading
        if sign.kind == "anchor":
            return replace(here, pending=sign.level), False
        if sign.kind == "unit":
            new = replace(here, path=()).headed(1, sign.title, "chapter", sign.name)
            return new, new.heading != self.heading or new.fields.get("chapter") != self.fields.get("chapter")
        if sign.kind == "label":
            fields = self.fields | {sign.name: sign.title}
            changed = self.fields.get(sign.name) != sign.title
            if sign.name not in DEPTHS:
                return replace(here, fields=fields), changed
            level = DEPTHS.index(sign.name) + 1
            return replace(here, fields=fields, explicit=self.explicit | {sign.name}).headed(level, sign.title), changed
        if sign.kind == "heading":
            level = sign.level
            if contents is not None and level in (1, 2):
                level = contents.level_of(sign.title) or level
            new = here.headed(level, sign.title, by_depth(level) if sign.tells else None)
            return new, new.heading != self.heading
        entry = contents.match(sign.text, 0.82) if contents is not None and sign.text and len(sign.text) <= 140 else None
        if entry is None or entry[0].level not in (1, 2):
            return here, False
        new = here.headed(entry[0].level, sign.text, by_depth(entry[0].level))
        return new, new.heading != self.heading or new.path != self.path

    def take(self, line: str, contents: "Contents | None" = None, longest: int = LONGEST) -> tuple["State", bool]:
        return self.after(sign_of(line, longest), contents)

    def metadata(self) -> dict:
        """The public fields, every level of the hierarchy present."""
        return {n: self.fields.get(n) for n in LABELS} | {"heading": self.heading, "heading_level": self.level, "heading_path": list(self.path) or None}

    def dumps(self) -> str:
        return json.dumps([self.heading, self.level, self.path, self.fields, sorted(self.explicit), self.pending], ensure_ascii=False)

    @staticmethod
    def loads(dumped: str | None) -> "State":
        if not dumped:
            return State()
        heading, level, path, fields, explicit, pending = json.loads(dumped)
        return State(heading, level, tuple(path), fields, frozenset(explicit), pending)


def seeded(metadata: dict | None) -> State:
    """The state that a document's metadata gives; placeholders count as nothing."""
    m = metadata or {}
    held = {n: v for n in LABELS if (v := clean_value(m.get(n))) is not None}
    return State(clean_value(m.get("heading")), m.get("heading_level"), tuple(split_path(m.get("heading_path"))), held)


def clean_value(value: object) -> object:
    """A value of metadata, trimmed; placeholders become None, other types stay."""
    if not isinstance(value, str):
        return value
    return None if value.strip().casefold() in PLACEHOLDERS else value.strip()


def hierarchy(text: str | None, seed: dict | None = None, contents: "Contents | None" = None) -> dict:
    """The fields at the end of a text: label fields, heading, its level and path."""
    state = seeded(seed)
    for line in (text or "").splitlines():
        if line.strip():
            state, _ = state.take(re.sub(r"\s+", " ", line.strip()), contents)
    return state.metadata()


# How file names state a language or a grade.
_NAME_LANGUAGE = re.compile(r"(?:^|[_\- ])(?:lang|language|lng)[_\- ]?(ar|ara|arabic|en|eng|english)(?:$|[_\- ])", re.I)
_NAME_GRADE = re.compile(r"(?:^|[_\- ])(?:grade|class|level|year)[_\- ]?([^_\-]+?)(?=$|[_\- ])", re.I)


def stem_of(name: str) -> str:
    """A file name without folders and suffix."""
    return re.sub(r"\.[A-Za-z0-9]+$", "", re.split(r"[/\\]", name)[-1])


def name_metadata(name: str) -> dict[str, str]:
    """Language and grade, where a file name states them."""
    stem = stem_of(name).strip()
    lang, grade = _NAME_LANGUAGE.search(stem), _NAME_GRADE.search(stem)
    out = {"language": lang[1][:2].lower() if lang else None, "grade": clean(grade[1]) if grade else None}
    return {k: v for k, v in out.items() if v}


SCHEMA = "doc_id string, line_no int, kind string, title string, level int, heading string, heading_path array<string>, chapter string, lesson string, opens boolean"


def structure_lines(pages: DataFrame) -> DataFrame:
    """One row for each line of pages (doc_id, text[, state]) that says or changes something of the place, with the place after it.

    Null and blank texts give no row; repeated pages give repeated rows.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = pa.schema([(n, pa.int32() if n in ("line_no", "level") else pa.list_(pa.string()) if n == "heading_path" else pa.bool_() if n == "opens" else pa.string()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, before in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                state = State.loads(before)
                for n, line in enumerate((text or "").splitlines(), 1):
                    if not line.strip():
                        continue
                    sign = sign_of(line.strip())
                    was = state
                    state, opens = state.after(sign)
                    if sign.kind or was.pending is not None:
                        rows.append((doc, n, sign.kind or "title", sign.title or sign.text, sign.level, state.heading, list(state.path), state.fields.get("chapter"), state.fields.get("lesson"), opens))
            if rows:
                yield pa.RecordBatch.from_pydict({n: [r[k] for r in rows] for k, n in enumerate(names)}, schema=kinds)

    from pyspark.sql import functions as F

    state = F.col("state") if "state" in pages.columns else F.lit(None).cast("string")
    return pages.select("doc_id", "text", state.alias("state")).mapInArrow(run, SCHEMA)
