"""Problem 4: defective prompt and response pairs.

``other_language``: the language posteriors of prompt and response from a naive Bayes model
over character n-grams are compared; a pair is defective if they hardly agree and the prompt
does not ask for the response's language.  ``truncated``: the likelihood that a text ends
after its last words (backing off to the last word, then to the last characters), from
counts over all prompts and responses, together with the likelihood that a text of its shape
(a short answer, a list, running text) ends without a stop.  Only what breaks off by itself
(an open bracket, a dangling sign, a bare list mark) needs no likelihood.
``empty``, ``refusal`` and ``copy`` are read off the response after labels, markup and
courtesies are taken away.

Contexts are counted over all rows, whatever their number, and the counts are joined to the
undecided responses; they are neither cut off at a share nor shipped to the workers.

Null responses are 'empty'; a null prompt gives neither 'copy' nor 'other_language'.  Rows
recorded twice are judged twice.  One row for each defect; a sound pair gives none.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CACHE, Counts, map_rows, table
from .language import LANGS, SEED, labelled_sample, wordy
from .lookalikes import bare

#: Labelled rows that the language model is trained on (a bounded sample), and its n-grams.
SAMPLE, ORDER = 3000, 3
#: A pair is in two languages if their posteriors agree by less than this.
AGREE = 0.05
#: Times that a context must have been met to be relied on; log-odds below which a text was cut,
#: and the weight of what its shape says.
MET, CUT, SHAPE = 15, -5.8, 2.2

WORD = re.compile(r"[^\W_]+(?:['’‌][^\W_]+)*")
LETTERS = re.compile(r"[^\W\d_]+")


class CharBayes:
    """Naive Bayes over the character n-grams (1 to ORDER) of words."""

    def __init__(self, texts: list[tuple[str, str]]) -> None:
        counts = [Counter() for _ in LANGS]
        for lang, text in texts:
            k = LANGS.index(lang)
            for w in LETTERS.findall(bare(text)):
                counts[k].update(self.grams(w))
        keys = {g for c in counts for g, n in c.items() if n > 1}
        self.at = {g: i for i, g in enumerate(sorted(keys))}
        table_ = np.full((len(keys), len(LANGS)), 0.5)
        for k, c in enumerate(counts):
            for g, n in c.items():
                if g in self.at:
                    table_[self.at[g], k] += n
        total = table_.sum(0)
        self.log = np.log(table_ / total)
        self.unseen = np.log(0.5 / total)
        self.word: dict[str, int] = {}
        self.rows = np.zeros((1024, len(LANGS)))

    @staticmethod
    def grams(word: str) -> list[str]:
        w = f" {word} "
        return [w[i : i + n] for n in range(1, ORDER + 1) for i in range(len(w) - n + 1)]

    def row(self, word: str) -> int:
        """Row of a word's summed log-likelihoods, kept a worker."""
        got = self.word.get(word)
        if got is None:
            if len(self.word) >= CACHE:
                self.word.clear()
            got = len(self.word)
            if got >= len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[got] = sum((self.log[self.at[g]] if g in self.at else self.unseen for g in self.grams(word)), np.zeros(len(LANGS)))
            self.word[word] = got
        return got

    def scores(self, words: list[str]) -> np.ndarray:
        if len(self.word) + len(words) >= CACHE:
            self.word.clear()
        at = [self.row(w) for w in words]  # may enlarge the table
        return self.rows[at].sum(0)

    def posterior(self, words: list[str]) -> np.ndarray:
        s = self.scores(words)
        p = np.exp((s - s.max()) / 2)  # n-grams overlap, so they are worth less than independent ones
        return p / p.sum()


# Fixed values -------------------------------------------------------------------------

NOTHING = set("null none nil nan n/a na undefined empty void - – — ... … ? . * # tbd todo".split())
ANSWER_LABEL = r"(?:answer|response|reply|ans|antwort|réponse|reponse|respuesta|resposta|الجواب|الإجابة|جواب|إجابة|پاسخ)"
QUESTION_LABEL = r"(?:question|the question(?: is| was)?|query|q|frage|die frage(?: lautet| ist)?|la question(?: est)?|pregunta|la pregunta(?: es)?|pergunta|a pergunta(?: é)?|السؤال(?: هو)?|سؤال|پرسش)"

# What only opens or closes a response.
OPENERS = [
    r"(?:i'?m|i am|we are) (?:very |so |really )?sorry(?: about that)?", r"sorry", r"i apologi[sz]e", r"apologies", r"unfortunately", r"regrettably", r"thank you for (?:asking|your question)", r"thanks for (?:asking|your question)",
    r"as an? [\w ]{2,40}", r"that is a good question", r"good question", r"hello", r"hi", r"to be honest",
    r"es tut mir (?:sehr )?leid", r"tut mir leid", r"leider(?: gilt)?", r"entschuldigung", r"danke für die frage", r"danke für deine frage", r"als [\w ]{3,40}",
    r"désolée?", r"je suis désolée?", r"malheureusement", r"merci pour (?:la|votre|ta) question", r"en tant qu[e'’] ?[\w ]{3,40}", r"pardon",
    r"lo siento(?: mucho)?", r"lamentablemente", r"por desgracia", r"desafortunadamente", r"gracias por (?:la|tu|su) pregunta", r"perdón", r"como [\w ]{3,40}",
    r"lamento", r"infelizmente", r"obrigad[oa] pela pergunta", r"desculpe",
    r"عذر[اً]+", r"آسف", r"للأسف(?: الشديد)?", r"شكر[اً]+ (?:لسؤالك|على سؤالك|على السؤال)", r"بصفتي [\w ]{3,40}", r"متأسفانه", r"ببخشید",
]
CLOSERS = [
    r"try (?:another|a different) question", r"(?:please )?ask (?:your|the|a) teacher", r"you (?:may|can|could) look it up in (?:the|your) book", r"please (?:try|ask|look|consult|check|rephrase)\b.*", r"is there anything else.*", r"let me know.*",
    r"bitte frage? .*", r"versuche? (?:es mit )?eine[r]? anderen? frage.*", r"du kannst (?:es )?im buch nachschlagen", r"(?:schau|sieh|schlag) .*", r"frage? (?:bitte )?(?:deine|die|einen|eine) .*", r"stell(?:e)? (?:bitte )?eine andere frage",
    r"(?:essayez|demandez|posez|consultez|veuillez|regardez|cherchez|essaie|demande)\b.*", r"vous pouvez .*",
    r"(?:pregunta|pregúntale|prueba|intenta|consulta|puedes|pruebe|haz|busca)\b.*", r"(?:pergunte|tente|consulte|experimente)\b.*",
    r"(?:يرجى|جر[بّ]+|حاول|اسأل|يمكنك|راجع|ارجع|جرب)\s?.*", r"لطفا .*",
]
REFUSALS = [
    # English
    r"i (?:am|'m) (?:not able|unable) to .*", r"i (?:cannot|can't|can not|could not|couldn't|won't|will not) (?:help|answer|assist|respond|give|provide|tell|say|find|discuss|comment)\b.*", r"i would rather not .*", r"i(?: really)? (?:do not|don't) know.*",
    r"i (?:do not|don't) have (?:any |enough |sufficient )?(?:information|evidence|data|an answer|knowledge).*", r"i have (?:no|not enough|insufficient) (?:information|evidence|idea|data|answer).*", r"it is not possible for me to .*", r"(?:this|that|it) (?:lies|is|falls) (?:outside|beyond) .*",
    r"(?:none|neither) of the (?:passages|pages|sources|texts|excerpts) .*", r"the (?:pages|passages|sources|texts|documents|excerpts|context|evidence|material)\b.* (?:do|does|did) not (?:contain|cover|mention|say|include|answer|provide)\b.*",
    r"the (?:evidence|text|context|passages|pages|sources|material)\b.* (?:says?|tells?|contains?|has|have|holds?) nothing .*", r".*\bi hold no (?:view|opinion)\b.*", r"i (?:have found|found|find) (?:no|nothing)\b.*", r"(?:there is|there was) (?:no|not enough|insufficient) (?:evidence|information|answer)\b.*",
    r"no (?:answer|evidence|information)\b.* (?:found|available|given).*", r"i must decline.*", r"i prefer not to .*", r"i am not allowed .*", r"nothing (?:in|on) (?:the|these) (?:pages|passages|evidence|sources)\b.*",
    r"let(?: us|'s) (?:talk|speak) about (?:something|anything) .*", r"(?:talking|speaking) about .* is not .*",
    # German
    r"(?:reden|sprechen) wir (?:lieber )?(?:über|von) etwas anderem?s?\b.*", r"lass(?:t|en)? (?:uns|sie uns) .*", r"ich (?:kann|konnte|darf|möchte|will|werde) .*\b(?:nicht|kein\w*|nichts)\b.*", r"(?:das|dies) weiß ich (?:leider )?nicht.*", r"ich weiß (?:es|das)? ?(?:leider )?nicht.*", r"ich habe (?:dazu|darüber|hierzu|leider)? ?(?:dazu )?(?:keine?|nicht genug|nichts)\b.*", r"(?:dabei|damit|hier|hierbei) kann ich .*nicht .*", r"(?:das|dies)\b.* (?:liegt|ist) außerhalb .*",
    r"(?:die|der|das|in den|in dem|im|keine?[rs]?) .*(?:seiten|texte?|quellen|stellen|abschnitte?|belege?|beleg|auszüge|auszügen|passagen|kontext|vorliegende\w*)\b.*\b(?:nicht|keine?|nichts)\b.*", r"dazu (?:habe|kann|darf|liegt|liegen|steht|gibt|sagt|sagen|finde) .*(?:nicht|kein|nichts).*", r"es ist mir nicht möglich.*", r"mir (?:liegen|liegt|fehlen|ist) .*", r"als .* habe ich keine .*", r"keine? der (?:seiten|stellen|texte|quellen|passagen|abschnitte)\b.*", r"darauf .*\b(?:nicht|keine?)\b.*", r"zu .{3,60} (?:habe ich|kann ich|liegt|liegen|gibt es|sagt|steht) .*(?:nicht|kein|nichts).*",
    # French
    r"je ne (?:peux|puis|sais|suis|souhaite|trouve|dispose|connais|veux)\b.*", r"je n['’](?:ai|arrive|y)\b.*", r"il (?:m['’]est|ne m['’]est pas|n['’]est pas) (?:impossible|possible)\b.*", r"(?:cela|ceci|ce sujet|ce point|cette question)\b.* (?:sort|dépasse|est hors|se situe)\b.*", r"aucun(?:e)? (?:des? )?(?:passages?|pages?|extraits?|sources?|textes?|réponse|information|preuve|élément)\b.*", r"(?:les|le|la) (?:pages?|passages?|textes?|extraits?|sources?|éléments?|preuves?|documents?|contexte)\b.* ne (?:contien|di|mentionn|cit|parl|donn|couvr|permet|trait|répond|précis)\w*\b.*", r"je préfère ne pas .*", r"on ne trouve .*",
    r"parlons\b.* autre\b.*",
    # Spanish
    r"hablemos\b.* (?:otr[ao]|algo)\b.*", r"no (?:puedo|lo sé|sé|me es posible|tengo|estoy|encuentro|encontré|he encontrado|dispongo|conozco|soy capaz|hay (?:información|evidencia|respuesta|pruebas))\b.*", r"no lo sé.*", r"(?:esto|eso|este tema|esta pregunta|esta cuestión)\b.* (?:está|queda|cae|sale) (?:fuera|más allá)\b.*", r"ningun[oa] de (?:los|las) (?:pasajes|páginas|textos|fuentes|fragmentos)\b.*", r"(?:las?|los?|el) (?:páginas?|pasajes?|textos?|fuentes?|fragmentos?|pruebas?|evidencias?|contexto|documentos?)\b.* no (?:conti|dic|mencion|cubr|respond|hab|trat|incluy|aport)\w*\b.*", r"(?:me resulta|me es) imposible .*", r"prefiero no .*",
    # Portuguese
    r"não (?:posso|sei|me é possível|tenho|consigo|encontrei|disponho)\b.*", r"nenhum[a]? d[oa]s .*", r"(?:isto|isso|este assunto)\b.* (?:está|fica) fora .*",
    # Arabic
    r"لا (?:أعرف|أعلم|أستطيع|يمكنني|أملك|أدري|أقدر|أجد|توجد معلومات|تتوفر)\b.*", r"ليس (?:لدي|لديّ|عندي|بإمكاني|من الممكن لي|بوسعي)\b.*", r"لم (?:أجد|أعثر|أتمكن|أستطع)\b.*", r"(?:هذا|هذه) (?:الموضوع|السؤال|الأمر|المسألة)\b.* (?:خارج|يتجاوز)\b.*", r"(?:النص|النصوص|الصفحات|المقاطع|الأدلة|المصادر|السياق|الدليل)\b.* (?:لا|لم) (?:يذكر|تذكر|تحتوي|يحتوي|تتضمن|يتضمن|تجيب|يجيب|تغطي|يغطي|يقول|تقول|يتناول|تتناول)\b.*", r"لا (?:يذكر|تذكر|يحتوي|تحتوي|يتضمن|تتضمن|يوجد|توجد) (?:النص|النصوص|الصفحات|المقاطع|الأدلة|المصادر|السياق|في النص|في الصفحات|معلومات|دليل|إجابة)\b.*", r"(?:يتعذر|لا يمكن) (?:علي|عليّ|لي)\b.*", r"أفضل (?:عدم|ألا)\b.*", r"أعتذر.*", r"لا رأي لي\b.*", r"ليست لدي\b.*",
    r"(?:لنتحدث|دعنا نتحدث|فلنتحدث|لنتكلم)\b.*",
    # Persian
    r"نمی‌?(?:دانم|توانم)\b.*", r"پاسخی .*", r".*اطلاعاتی ندارم.*",
]
# The languages as prompts name them, by the beginning of the word.
NAMED = {
    "ar": ("arabic", "arabisch", "arabe", "árabe", "العربية", "بالعربية"), "de": ("german", "deutsch", "allemand", "alemán", "alemao", "alemão", "الألمانية", "بالألمانية"), "en": ("english", "englisch", "anglais", "inglés", "inglês", "الإنجليزية", "بالإنجليزية", "الانجليزية"),
    "es": ("spanish", "spanisch", "espagnol", "español", "espanhol", "castellano", "الإسبانية", "بالإسبانية", "الاسبانية"), "fa": ("persian", "farsi", "persisch", "persan", "persa", "الفارسية", "بالفارسية"), "fr": ("french", "französisch", "français", "francés", "francês", "الفرنسية", "بالفرنسية"),
    "pt": ("portuguese", "portugiesisch", "portugais", "portugués", "português", "البرتغالية", "بالبرتغالية"),
}
ASKS = re.compile(r"translat|\banswer\b|\breply\b|\brespond|\bwrite\b|\bsay\b|\bexpress|übersetz|antwort|schreib|\bsag|tradui|répond|répons|écri|\bdis\b|\bdites\b|traduc|traduz|respond|contest|escrib|\bdi\b|ترجم|أجب|اكتب|قل|الترجمة|جواب|\bin\b|\bauf\b|\ben\b|\bem\b|باللغة|ب(?:ال)", re.I)


def _union(patterns: list[str]) -> re.Pattern:
    return re.compile("|".join(f"(?:{p})" for p in patterns), re.I | re.S)


_ROLE = [p for p in OPENERS if r"[\w ]" in p]  # "as a study assistant": ends at a comma
_PLAIN = [p for p in OPENERS if p not in _ROLE]
_BUT = r"(?:(?:but|aber|mais|pero|mas|لكن|ولكن)\b\s*)?"
_OPEN = re.compile(rf"\s*(?:(?:{'|'.join(_ROLE)})\s*[,،:–—]\s*|(?:{'|'.join(_PLAIN)})(?:\s*[,،.!:;–—-]\s*|\s+|$)){_BUT}", re.I)
_CLOSE, _REFUSE = _union(CLOSERS), _union(REFUSALS)
_SENTENCE = re.compile(r"(?<=[.!?؟؛])\s+|\n+")
_FENCE = re.compile(r"```\w*|</?[A-Za-z][^<>]*>|&nbsp;|[*_`#>|]")


# The defects --------------------------------------------------------------------------


def is_empty(answer: str | None) -> bool:
    """Nothing that could be an answer."""
    if answer is None:
        return True
    text = re.sub(r"[​-‏⁠﻿­]", "", answer).strip()
    core = re.sub(r"^```\w*\s*|\s*```$", "", text).strip()
    if core[:1] in "{[" and core:
        try:
            return not any(filled(v) for v in leaves(json.loads(core)))
        except ValueError:
            pass
    core = _FENCE.sub(" ", text).strip()
    if core.lower().strip(" .\"'") in NOTHING or not any(c.isalnum() or c in "√≈∞" for c in core):
        return True
    return bool(re.fullmatch(rf"\W*{ANSWER_LABEL}\s*\W*(?:(?:null|none|nil|n/a)\W*)?", core, re.I))


def leaves(x: object, key: str = "") -> list[object]:
    if isinstance(x, dict):
        return [v for k, y in x.items() for v in leaves(y, str(k))]
    if isinstance(x, list):
        return [v for y in x for v in leaves(y, key)]
    return [] if key.lower() in {"status", "answer_status", "type", "id", "grounded", "score", "confidence", "language", "lang"} else [x]


def filled(v: object) -> bool:
    return v is not None and v != "" and not (isinstance(v, str) and is_empty(v))


def plain_words(text: str) -> list[str]:
    return [w for w in WORD.findall(bare(text))]


def is_copy(query: str | None, answer: str) -> bool:
    """Nothing but the question, apart from case, spacing, punctuation, a label or repetition."""
    q = plain_words(query or "")
    if not q or not set(q).issubset(plain_words(answer)):
        return False
    for text in (answer, re.sub(rf"^\W*(?:{QUESTION_LABEL}|{ANSWER_LABEL}|[^\s:]+(?: [^\s:]+){{0,3}})\s*[:：]", "", answer, flags=re.I)):
        a = plain_words(text)
        if a and len(a) % len(q) == 0 and a == q * (len(a) // len(q)):
            return True
    a = plain_words(answer)  # labels between repetitions
    rest = [w for part in re.split(rf"(?:^|(?<=[\s.?!؟]))(?:{QUESTION_LABEL}|{ANSWER_LABEL})\s*[:：]", answer, flags=re.I) for w in plain_words(part)]
    return bool(rest) and len(rest) < len(a) and len(rest) % len(q) == 0 and rest == q * (len(rest) // len(q))


def is_refusal(answer: str) -> bool:
    """It only declines: every sentence does, but for courtesies before and advice after."""
    text = re.sub(r"\s+", " ", _FENCE.sub(" ", answer.replace("’", "'"))).strip()
    text = re.sub(rf"^\W*{ANSWER_LABEL}\s*[:：]\s*", "", text, flags=re.I)
    refused = False
    for sentence in _SENTENCE.split(text):
        s = sentence.strip()
        while s:
            m = _OPEN.match(s)
            if not m or m.end() == 0:
                break
            s = s[m.end() :].strip()
        s = s.rstrip(" .!؛")
        if not s:
            continue
        if _REFUSE.fullmatch(s):
            if re.search(r"\b(?:but|however|aber|mais|pero|لكن|ولكن)\b.{25,}", s, re.I):
                return False
            refused = True
        elif not (refused and _CLOSE.fullmatch(s)):
            return False
    return refused


def asked_languages(query: str) -> set[str]:
    """Languages that the prompt asks the response to be in.

    A long prompt is read whole: what asks and the language's name stand in one sentence or two
    in a row, or both at its ends.
    """
    parts = [query]
    if len(query) >= 400:
        s = _SENTENCE.split(query)
        parts = [query[:200] + " " + query[-200:], *(f"{a} {b}" for a, b in zip(s, [*s[1:], ""]))]
    found = {w.lower() for part in parts if ASKS.search(part) for w in LETTERS.findall(part)}
    return {lang for lang, names in NAMED.items() if any(w.startswith(n) for w in found for n in names)}


def other_language(query: str | None, answer: str, model: CharBayes) -> bool:
    """Posteriors of prompt and response hardly agree, and the response's language was not asked for."""
    if not query or not answer:
        return False
    q_words, a_words = LETTERS.findall(bare(query)), LETTERS.findall(bare(answer))
    if not wordy(query, q_words) or not wordy(answer, a_words):
        return False
    p, a = model.posterior(q_words), model.posterior(a_words)
    if float(p @ a) >= AGREE or a.max() < 0.8:
        return False
    return LANGS[int(a.argmax())] not in asked_languages(query)


_STOP = re.compile(r"[.!?؟。][\"'”“»)\]*_`]*$")
_MARKER = re.compile(r"(?:[-*•–]|\(?\d{1,2}[.)]|\(?[a-z][.)])")
_ITEM = re.compile(r"^\s*(?:[-*•–]|\(?\d{1,2}[.)-]|\(?[a-z][.)])\s+\S")


def last_contexts(text: str) -> list[str]:
    """What the end of a text is judged by, the most telling first: the last two words, the last one, its last four characters (the blank before a short one counts)."""
    found = plain_words(text[-120:])
    if not found:
        return []
    return [*([f"2 {' '.join(found[-2:])}"] if len(found) > 1 else []), f"1 {found[-1]}", f"c {(' ' + found[-1])[-4:]}"]


def shape(text: str) -> str:
    """What kind of text it is: a list's item, a few words, a sentence or more."""
    last = text.split("\n")[-1].strip()
    if _ITEM.match(last):
        first = LETTERS.findall(re.sub(r"^\s*(?:[-*•–]|\(?\d{1,2}[.)-])\s+", "", last))
        return "item" if len(first) < 8 else "sentence"
    return "item" if unmarked_list(text) else "short" if len(plain_words(text)) <= 6 and "\n" not in text else "sentence"


_CLOSES = set(".!?؟؛:,،")
_STEP = re.compile(rf"({WORD.pattern})([^\w]*)")


def contexts(text: str) -> list[tuple[str, bool]]:
    """(context, does a text or clause end after it) of every word; the very end counts only if a stop marks it."""
    out = []
    for line in bare(text).split("\n"):
        spans = _STEP.findall(line)
        last = len(spans) - 1
        before = ""
        for i, (w, tail) in enumerate(spans):
            end = tail not in ("", " ") and not _CLOSES.isdisjoint(tail)
            if end or i < last:
                out.append((f"1 {w}", end))
                out.append((f"c {(' ' + w)[-4:]}", end))
                if before:
                    out.append((f"2 {before} {w}", end))
            before = w
    return out


def unmarked_list(text: str) -> bool:
    """Three lines or more of up to seven words without a stop, but for one that introduces them."""
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    if lines and lines[0].endswith((":", "：")):
        lines = lines[1:]
    return len(lines) > 2 and all(len(plain_words(x)) < 8 and x[-1] not in _CLOSES for x in lines)


def is_truncated(answer: str) -> bool | None:
    """Does it break off inside a sentence, word, bracket or list?  None: the likelihood of an end after its last words tells."""
    text = answer.rstrip()
    text = re.sub(r"[​-‏⁠﻿]+$", "", text).rstrip()
    if not text:
        return False
    if text.count("```") % 2 or text[:1] in "{[" and text[-1:] not in "}]":
        return True
    last = text.split("\n")[-1].strip()
    if text.endswith(("…", "...")):
        return len(plain_words(text)) > 1
    if _MARKER.fullmatch(last) and "\n" in text:
        return True
    if text.count("(") > text.count(")") or text.count("[") > text.count("]") or text.count("«") > text.count("»"):
        return True
    if _STOP.search(text):
        return bool(re.search(r"(?:^|\s)\d{1,2}[.)]$", text) and "\n" in text and not re.search(r"\d{1,2}[.)]\s*$", text.split("\n")[0]))
    if text[-1] in ",;:،؛=+×÷/−–—-&(" or re.search(r"\s[+*<>]$", text):
        return True
    if not wordy(last, LETTERS.findall(bare(last))):
        return False  # a number, a formula or a symbol
    if "|" in last or last.endswith((")", "]", "}", ">", "`", "%", "°")):
        return False
    return None


def end_counts(pairs: DataFrame) -> DataFrame:
    """(context, ended, went_on) over all prompts and responses, added up in the tasks first.

    The context 's' and a shape counts texts of that shape: ended without a stop, and with one.
    """
    schema = pa.schema([("context", pa.string()), ("ended", pa.int64()), ("went_on", pa.int64())])

    def make() -> Callable:
        counts = Counts()

        def rows() -> dict[str, list]:
            items = counts.drain()
            return {"context": [k[0] for k, _ in items], "ended": [n if k[1] else 0 for k, n in items], "went_on": [0 if k[1] else n for k, n in items]}

        def one(c: dict[str, list]) -> dict[str, list] | None:
            if not c:
                return rows()
            for q, a in zip(c["query"], c["answer"], strict=True):
                for t in (q, a):
                    if t:
                        counts.add(contexts(t))
                        whole = t.rstrip()
                        if whole:
                            counts.add([(f"s {shape(whole)}", not _STOP.search(whole))])
            return rows() if counts.full else None

        return one

    counted = map_rows(pairs.select("query", "answer"), make, schema, "context string, ended bigint, went_on bigint", after=lambda one: one({}))
    return counted.groupBy("context").agg(F.sum("ended").alias("ended"), F.sum("went_on").alias("went_on"))


def defects(pairs: DataFrame, labelled: DataFrame | None = None, key: str = "turn_key") -> DataFrame:
    """(key, defect) of every pair (key, query, answer).  ``labelled``: (doc_id, text, lang) to train the languages on, besides the seed."""
    from .common import shared_checkpoint

    spark = pairs.sparkSession
    texts = list(SEED.items()) + (labelled_sample(labelled, "doc_id", "text", "lang", SAMPLE) if labelled is not None else [])
    shared = spark.sparkContext.broadcast(CharBayes(texts))
    schema = pa.schema([(key, pa.int64()), ("defect", pa.string()), ("contexts", pa.list_(pa.string()))])

    def make() -> Callable:
        model = shared.value

        def one(c: dict[str, list]) -> dict[str, list]:
            ids, kinds, asked = [], [], []
            for i, q, a in zip(c[key], c["query"], c["answer"], strict=True):
                found, undecided = pair_defects(q, a, model)
                for kind in found:
                    ids.append(i)
                    kinds.append(kind)
                    asked.append(None)
                if undecided:
                    ids.append(i)
                    kinds.append("truncated")
                    asked.append(undecided)
            return {key: ids, "defect": kinds, "contexts": asked}

        return one

    judged = shared_checkpoint(map_rows(pairs.select(key, "query", "answer"), make, schema, f"{key} bigint, defect string, contexts array<string>"))
    undecided = judged.filter("contexts IS NOT NULL").withColumn("row", F.monotonically_increasing_id())
    counted = end_counts(pairs).filter(F.col("ended") + F.col("went_on") >= MET)
    log_odds = F.log((F.col("ended") + 0.2) / (F.col("went_on") + 0.2))
    stopless = F.log((F.col("ended") + 0.2) / (F.col("ended") + F.col("went_on") + 0.4))
    met = undecided.select("row", key, F.posexplode("contexts").alias("at", "context")).join(counted, "context", "left").groupBy("row", key).agg(
        F.min(F.when((F.col("at") > 0) & F.col("ended").isNotNull(), F.struct("at", log_odds.alias("odds")))).alias("words"),
        F.max(F.when(F.col("at") == 0, stopless)).alias("shape"),
    )
    score = F.coalesce(F.col("words.odds"), F.lit(-9.0)) + SHAPE * F.coalesce("shape", F.lit(0.0))
    return judged.filter("contexts IS NULL").select(key, "defect").unionByName(met.filter(score < CUT).select(key, F.lit("truncated").alias("defect")))


def pair_defects(query: str | None, answer: str | None, model: CharBayes) -> tuple[list[str], list[str]]:
    """The defects of one pair, and the contexts (the shape first) that decide whether it was truncated, if nothing else does."""
    if is_empty(answer):
        return ["empty"], []
    out, undecided = [], []
    copy = is_copy(query, answer)
    refusal = not copy and is_refusal(answer)
    if copy:
        out.append("copy")
    if refusal:
        out.append("refusal")
    if not copy and not refusal:
        cut = is_truncated(answer)
        if cut:
            out.append("truncated")
        elif cut is None:
            text = answer.rstrip()
            undecided = [f"s {shape(text)}", *last_contexts(text)]
    if not copy and other_language(query, answer, model):
        out.append("other_language")
    return out, undecided


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective turns, one row for each defect."""
    turns = table(spark, sf_dir, "turns").select("turn_key", "query", "answer")
    return defects(turns, table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p4_found": p4_found}
ORACLE: dict[str, str] = {}
