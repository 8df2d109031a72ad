"""Column functions over text: language, clean-up, tokens, content type.

All of them stay in the JVM but ``normalize_text``, for which Spark has no Unicode
normalization.  Nulls give null, or an empty array of tokens.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Glyphs that Arabic fonts leave behind in extracted text, and what they stand for.
OCR_ONE_TO_ONE = {"à": "ت", "Ê": "ت", "É": "ح", "Ü": "ل", "ì": "ا", "î": "ى", "Ö": "ض", "¯": "ج", "Ì": "ي", "ø": "ة", "ù": "ت", "ð": "ن", "þ": "خ", "ä": "ش", "ß": "ر", "û": "ت"}
OCR_TO_TWO = {"·": "لا", "¡": "في"}
# Characters that separate tokens.
PUNCTUATION = r"[؟،؛\x{64b}-\x{65f}\x{670}?.,!;:()\[\]{}\"'/\\«»\-_~+=*#@%$^&|<>`]"
# Words that carry no content, Arabic, Egyptian Arabic and English.
STOPWORDS = (
    "من في على عن إلى الى مع بين حتى منذ هو هي هم هن هما انا نحن انت انتم انتن هذا هذه هذان هاتان هؤلاء ذلك تلك اولئك الذي التي الذين اللاتي اللواتي اللائي "
    "ما ماذا هل كيف لماذا أين اين متى كم اي أية اية اشرح وضح عرف تعريف اذكر قارن تكلم تفصيل بالتفصيل عايز اعرف اديني ايه ليه ازاي فين مين بتاع بتاعة "
    "و أو او ثم ف بل لكن أن إن ان انها انه انهم كان كانت يكون تكون تم تمت يتم تعتبر يعتبر يعد تعد قد لقد كل جميع بعض غير سوف سيتم وفي وما وكيف ولماذا عنها لها منها فيه فيها به بها لكل عند عندما "
    "the a an and or but in on at to for of with by from is are was were be been being have has had do does did what which who whom whose where when why how explain describe define definition detail details detailed "
    "tell give please about example examples can could would should this that these those it its they them their we us our you your"
).split()
# Attached Arabic prefixes and suffixes, English suffixes.
PREFIX = "وال|فال|بال|كال|لل|ال|و|ف"
SUFFIX = "ات|ون|ين|ان|ها|هم|هن|نا|كم|تم|تك|يه|ية|ه|ي"
EN_SUFFIX = "'s|s|es|ed|ing"
# Word stems that tell a chunk's type.
TYPE_WORDS = {
    "exercise": "اختر|أجب|أكمل|املأ|تمرين|تحدى معلوماتك|جرب بنفسك|exercise|question|fill in|choose|answer",
    "example": "مثال|example",
    "definition": "تعريف|definition|يعرف|تعني|يسمى",
}
PLACEHOLDERS = ("", "null", "none", "n/a", "na", "string")
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{200e}\x{200f}\x{202a}-\x{202c}\x{2066}\x{2067}\x{2069}\x{feff}]"


def strip_control_chars(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, "")


def clean_optional(c: Column) -> Column:
    """Trimmed; placeholders become null."""
    t = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.when(~F.lower(t).isin(*PLACEHOLDERS), t)


def detect_language(c: Column) -> Column:
    """ar, en, mixed or unknown, by the letters of either script."""
    arabic, latin = F.regexp_count(c, F.lit(r"[\x{600}-\x{6ff}]")), F.regexp_count(c, F.lit("[A-Za-z]"))
    return (
        F.when(c.isNull(), F.lit("unknown"))
        .when((arabic > 0) & (latin > 0), F.when(arabic >= 3 * latin, "ar").otherwise("mixed"))
        .when(arabic > 0, "ar").when(latin > 0, "en").otherwise("unknown")
    )


def repair_ocr(c: Column) -> Column:
    """Font leftovers by the letters they stand for, and two broken words."""
    t = F.translate(c, "".join(OCR_ONE_TO_ONE), "".join(OCR_ONE_TO_ONE.values()))
    for glyph, letters in OCR_TO_TWO.items():
        t = F.replace(t, F.lit(glyph), F.lit(letters))
    t = F.regexp_replace(t, r"(?U)\bاوج([ةه])\b", "موج$1")
    return F.regexp_replace(t, r"(?U)\bال[تt]دد\b", "التردد")


def stem(token: Column) -> Column:
    """One token by its stem: alef, ya and ta unified, attached prefix and suffix off."""
    t = F.translate(token, "إأآٱىةـ", "اااايه")
    t = F.regexp_replace(t, f"^(?:{PREFIX})(.{{2,}})$", "$1")
    t = F.regexp_replace(t, rf"^(.*?[\x{{600}}-\x{{6ff}}]{{3}})(?:{SUFFIX})$", "$1")
    return F.regexp_replace(t, f"^(.*?[a-z]{{3}})(?:{EN_SUFFIX})$", "$1")


def repaired(c: Column, ocr_repair: bool | None) -> Column:
    """The text as it is tokenized; None: repaired where it has Arabic letters, as the font leftovers are letters of German, French ... elsewhere."""
    if ocr_repair is None:
        return F.when(c.rlike(r"[\x{600}-\x{6ff}]"), repair_ocr(c)).otherwise(c)
    return repair_ocr(c) if ocr_repair else c


def lex_tokens(c: Column, ocr_repair: bool | None = None) -> Column:
    """Stemmed content tokens in order, repetitions kept."""
    t = F.lower(F.regexp_replace(repaired(F.coalesce(c, F.lit("")), ocr_repair), PUNCTUATION, " "))
    raw = F.regexp_extract_all(t, F.lit(r"([a-z0-9]+|[\x{600}-\x{6ff}]+)"), 1)
    content = F.filter(raw, lambda r: ~r.isin(*STOPWORDS))  # a set that is hashed once
    return F.filter(F.transform(content, stem), lambda x: (F.length(x) > 1) & ~x.isin(*STOPWORDS))


def core_tokens(c: Column, ocr_repair: bool | None = None) -> Column:
    """The distinct stemmed content tokens."""
    return F.array_distinct(lex_tokens(c, ocr_repair))


def content_type(text: Column, heading: Column | None = None) -> Column:
    """section, exercise, example, definition, table or paragraph; the first that fits."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    out = F.when(t.rlike("(?iu)" + TYPE_WORDS["exercise"]), "exercise").when(t.rlike("(?iu)" + TYPE_WORDS["example"]), "example").when(t.rlike("(?iu)" + TYPE_WORDS["definition"]), "definition").when(t.rlike(r"\|.*\|"), "table").otherwise("paragraph")
    return out if heading is None else F.when(heading.isNotNull() & (F.trim(heading) != "") & (t == F.trim(heading)), "section").otherwise(out)


def normalized(text: str | None) -> str:
    """NFKC; control and direction marks as spaces; lines that go on are joined; blanks collapsed."""
    t = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f‎‏‪-‬⁦⁧⁩﻿]", " ", unicodedata.normalize("NFKC", text or ""))
    t = re.sub(r"(?<=[A-Za-z0-9؀-ۿ])\s*\n\s*(?=[A-Za-z0-9؀-ۿ])", " ", t)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", t)).strip()


@F.pandas_udf(StringType())
def normalize_text(texts: pd.Series) -> pd.Series:
    return texts.map(normalized)


# The same tokens in DuckDB's SQL, for the oracles -----------------------------------------


def sql_tokens(column: str) -> str:
    """DuckDB expression of ``lex_tokens``, repaired where there are Arabic letters."""
    t = f"translate(coalesce({column}, ''), '{''.join(OCR_ONE_TO_ONE)}', '{''.join(OCR_ONE_TO_ONE.values())}')"
    for glyph, letters in OCR_TO_TWO.items():
        t = f"replace({t}, '{glyph}', '{letters}')"
    word = r"(^|[^\p{L}\p{M}\p{N}_])"
    after = r"($|[^\p{L}\p{M}\p{N}_])"
    t = f"regexp_replace({t}, '{word}اوج([ةه]){after}', '\\1موج\\2\\3', 'g')"
    t = f"regexp_replace({t}, '{word}ال[تt]دد{after}', '\\1التردد\\2', 'g')"
    marks = r"[؟،؛\x{64B}-\x{65F}\x{670}?.,!;:()\[\]{}\"''/\\«»\-_~+=*#@%$^&|<>`]"
    t = f"CASE WHEN regexp_matches({column}, '[\\x{{600}}-\\x{{6ff}}]') THEN {t} ELSE coalesce({column}, '') END"
    raw = f"regexp_extract_all(lower(regexp_replace({t}, '{marks}', ' ', 'g')), '[a-z0-9]+|[\\x{{600}}-\\x{{6ff}}]+')"
    s = "replace(translate(r, 'إأآٱىة', 'اااايه'), 'ـ', '')"
    s = f"regexp_replace({s}, '^(?:{PREFIX})(.{{2,}})$', '\\1')"
    s = f"regexp_replace({s}, '^(.*?[\\x{{600}}-\\x{{6ff}}]{{3}})(?:{SUFFIX})$', '\\1')"
    s = f"regexp_replace({s}, '^(.*?[a-z]{{3}})(?:{EN_SUFFIX.replace(chr(39), chr(39) * 2)})$', '\\1')"
    stops = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"
    pairs = f"list_transform({raw}, lambda r: {{'raw': r, 'stem': {s}}})"
    return f"list_transform(list_filter({pairs}, lambda p: length(p.stem) > 1 AND NOT list_contains({stops}, p.stem) AND NOT list_contains({stops}, p.raw)), lambda p: p.stem)"
