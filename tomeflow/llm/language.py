"""Problem 2: languages of texts and of the segments of mixed texts, by hyperdimensional profiles.

Every letter has a random vector of +1 and -1 (seeded by the letter, so it is the same on
every machine).  An n-gram's vector binds its letters' vectors, each permuted by its
place: rho(rho(a) * b) * c.  A language's prototype bundles (adds) the vectors of the n-grams
of its training texts.  A segment is compared with a prototype by cosine.  As a bundle is a
sum, the dot product of a segment is the sum of those of its n-grams, and each n-gram's
products with the prototypes are computed once a worker; nothing is approximated by that.

Training: a few seed sentences a language and a sample of labelled rows, the first
``SAMPLE`` in the order of a hash of the key; rows whose own profile contradicts the label
leave the second bundling.  Everything else covers all rows.

Null and blank texts have no language (no row, ``text_languages`` gives null); a text
without words (formulas, numbers) is 'unknown'.  Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, ordinal_lines, table
from .lookalikes import bare

LANGS = ("ar", "de", "en", "es", "fa", "fr", "pt")
#: Languages are told apart within their script; the prototypes of a script are centred.
SCRIPTS = {"arabic": (0, 4), "latin": (1, 2, 3, 5, 6)}
DIM = 8192
SAMPLE = 4000
#: A line leaves the text's main language if its cosine margin times the root of its n-grams exceeds this.
SWITCH = 0.6
WORD = re.compile(r"[^\W\d_]+")
UNIT = re.compile(r"[^\W\d_]+|[¿¡]")  # what n-grams are made of

# Training seed: general sentences of each language, written for this purpose.
SEED = {
    "en": "The water of the river flows to the sea, and the people who live there use it every day. What is the difference between these two things? This was not known before, but it has been shown that they were the same. We have to find out how it works and why it would be so. In the first part of the book you can see which of them is larger. It took a long time until the answer could be given by those who were asked.",
    "de": "Das Wasser des Flusses fließt in das Meer, und die Menschen, die dort leben, nutzen es jeden Tag. Was ist der Unterschied zwischen diesen beiden Dingen? Das war vorher nicht bekannt, aber man hat gezeigt, dass sie gleich waren. Wir müssen herausfinden, wie es geht und warum es so sein könnte. Im ersten Teil des Buches sieht man, welches von ihnen größer ist. Es dauerte lange, bis eine Antwort von denen kam, die gefragt wurden.",
    "fr": "L'eau de la rivière coule vers la mer, et les gens qui vivent là l'utilisent chaque jour. Quelle est la différence entre ces deux choses ? Ce n'était pas connu avant, mais on a montré qu'elles étaient les mêmes. Nous devons trouver comment cela marche et pourquoi il en serait ainsi. Dans la première partie du livre, on voit laquelle est plus grande. Il a fallu longtemps avant que la réponse soit donnée par ceux qui étaient interrogés.",
    "es": "El agua del río corre hacia el mar, y la gente que vive allí la usa todos los días. ¿Cuál es la diferencia entre estas dos cosas? Esto no se sabía antes, pero se ha demostrado que eran las mismas. Tenemos que averiguar cómo funciona y por qué sería así. En la primera parte del libro se ve cuál de ellas es más grande. Pasó mucho tiempo hasta que se pudo dar la respuesta a los que preguntaron.",
    "pt": "A água do rio corre para o mar, e as pessoas que vivem ali usam-na todos os dias. Qual é a diferença entre estas duas coisas? Isto não se sabia antes, mas foi mostrado que eram as mesmas. Temos de descobrir como funciona e por que razão seria assim. Na primeira parte do livro vê-se qual delas é maior. Passou muito tempo até que a resposta pudesse ser dada aos que perguntaram; não há outra explicação para as condições.",
    "ar": "تجري مياه النهر إلى البحر، ويستعملها الناس الذين يعيشون هناك كل يوم. ما الفرق بين هذين الشيئين؟ لم يكن ذلك معروفًا من قبل، ولكن ثبت أنهما كانا متشابهين. علينا أن نعرف كيف يعمل هذا ولماذا يكون كذلك. في الجزء الأول من الكتاب يمكن أن نرى أيهما أكبر. مضى وقت طويل قبل أن يجيب الذين سئلوا عن هذه المسألة.",
    "fa": "آب رودخانه به سوی دریا می‌رود و مردمی که در آنجا زندگی می‌کنند هر روز از آن استفاده می‌کنند. تفاوت این دو چیز چیست؟ این پیش از این دانسته نبود، اما نشان داده شد که آنها یکسان بودند. باید پیدا کنیم که چگونه کار می‌کند و چرا چنین می‌شود. در بخش نخست کتاب می‌توان دید که کدام یک بزرگ‌تر است. زمان زیادی گذشت تا پاسخ داده شود.",
}

# How labels name languages; the first of each row is the code.
NAMES = {
    "ar": "ar ara arab arabic arabe arabisch عربي العربية عربى",
    "de": "de deu ger german deutsch alemán allemand",
    "en": "en eng english englisch anglais inglés",
    "es": "es spa spanish español espanol castellano espagnol spanisch",
    "fa": "fa fas per pes prs persian farsi فارسی فارسي",
    "fr": "fr fra fre french français francais französisch",
    "pt": "pt por portuguese português portugues portugiesisch",
    "unknown": "unknown und undetermined zxx",
}
NAMED = {n: code for code, names in NAMES.items() for n in names.split()}
# Names of functions and units that are no words of a language.
SYMBOLS = set("sin cos tan cot log ln exp lim max min mod mm cm km ms kg mg ml kw hz khz mol pa kpa ev kj nm".split())


def label_language(label: str | None) -> str | None:
    """The language a label names, None for a label that is missing or a word for nothing, '?' for anything else."""
    t = (label or "").strip().lower()
    if not t or t in {"n/a", "na", "none", "null", "nil", "nan", "-", "--", "?", "missing", "empty", "undefined", "not available", "tbd"}:
        return None
    if t in NAMED:
        return NAMED[t]
    base = re.split(r"[-_@. (]", t, maxsplit=1)[0]
    return NAMED.get(base, "?")


ROMAN = re.compile(r"[ivxlcdm]+", re.I)


def wordy(line: str, words: list[str]) -> bool:
    """Has the line words, rather than symbols, numbers, units, abbreviations and Roman numerals only?"""
    real = [w for w in words if (len(w) > 2 or len(w) == 2 and w >= "\u0600") and w not in SYMBOLS]
    if not real or len(real) > 3:
        return bool(real)
    short = {w.lower() for w in WORD.findall(line) if len(w) < 6 and (w.isupper() and w.isascii() or ROMAN.fullmatch(w))}
    return any(w not in short for w in real)


_letter: dict[str, np.ndarray] = {}


def letter(ch: str, dim: int = DIM) -> np.ndarray:
    v = _letter.get(ch)
    if v is None:
        seed = int.from_bytes(hashlib.sha256(f"letter {ch}".encode()).digest()[:8], "little")
        v = _letter[ch] = np.random.Generator(np.random.PCG64(seed)).integers(0, 2, dim, dtype=np.int8) * 2 - 1
    return v


def bind(gram: str, dim: int = DIM) -> np.ndarray:
    """rho(rho(a) * b) * c ...: the permutation is a rotation."""
    v = letter(gram[0], dim)
    for ch in gram[1:]:
        v = np.roll(v, 1) * letter(ch, dim)
    return v


def grams(word: str) -> list[str]:
    w = f" {word} "
    out = [w[i : i + 3] for i in range(len(w) - 2)]
    if len(w) > 4:
        out += [w[i : i + 4] for i in range(len(w) - 3)]
    else:
        out.append(w)
    return out


def train(texts: list[tuple[str, str]], rounds: int = 2) -> np.ndarray:
    """Prototypes (languages x dimensions, unit length) from (language, text)."""
    prototypes = np.zeros((len(LANGS), DIM))
    counted = []
    for lang, text in texts:
        n: dict[str, int] = {}
        for w in UNIT.findall(bare(text)):
            for g in grams(w):
                n[g] = n.get(g, 0) + 1
        counted.append((LANGS.index(lang), n))
    seen: dict[str, int] = {}
    for _, n in counted:
        for g in n:
            seen[g] = seen.get(g, 0) + 1
    names = sorted(g for g, c in seen.items() if c > 1 or len(seen) < 5000)  # what one text alone has is mostly names
    at = {g: i for i, g in enumerate(names)}
    weight = np.zeros((len(LANGS), len(names)))
    for k, n in counted:
        for g, c in n.items():
            if g in at:
                weight[k, at[g]] += c
    for r in range(rounds):
        prototypes[:] = 0
        scaled = weight / np.maximum(weight.sum(1, keepdims=True), 1)
        scaled = np.sqrt(scaled)  # frequent n-grams do not drown the others
        for i in range(0, len(names), 512):
            block = np.stack([bind(g) for g in names[i : i + 512]]).astype(np.float64)
            prototypes += scaled[:, i : i + 512] @ block
        for members in SCRIPTS.values():  # what all languages of a script share tells nothing
            prototypes[list(members)] -= prototypes[list(members)].mean(0)
        prototypes /= np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12)
        if r + 1 < rounds:
            product = np.empty((len(names), len(LANGS)))
            for i in range(0, len(names), 512):
                product[i : i + 512] = np.stack([bind(g) for g in names[i : i + 512]]) @ prototypes.T
            weight[:] = 0
            for k, n in counted:
                known = [(at[g], c) for g, c in n.items() if g in at]
                idx = [i for i, _ in known]
                c = np.array([c for _, c in known], float)
                if idx and int((c @ product[idx]).argmax()) == k:
                    np.add.at(weight[k], idx, c)
    return prototypes


class Profiles:
    """Cosines of texts with the prototypes; the products of n-grams and words are kept a worker."""

    def __init__(self, prototypes: np.ndarray) -> None:
        self.prototypes = prototypes.astype(np.float32)
        self.gram: dict[str, np.ndarray] = {}
        self.word: dict[str, tuple[tuple[float, ...], int]] = {}

    def of_word(self, w: str) -> tuple[tuple[float, ...], int]:
        got = self.word.get(w)
        if got is None:
            total = np.zeros(len(LANGS), np.float32)
            gs = grams(w)
            for g in gs:
                p = self.gram.get(g)
                if p is None:
                    if len(self.gram) > 200_000:
                        self.gram.clear()
                    p = self.gram[g] = self.prototypes @ bind(g).astype(np.float32)
                total += p
            if len(self.word) > 200_000:
                self.word.clear()
            got = self.word[w] = (tuple(float(x) for x in total), len(gs))
        return got

    def of_words(self, words: list[str]) -> tuple[list[float], int]:
        """Dot products with the prototypes and the number of n-grams."""
        sums, n = [0.0] * len(LANGS), 0
        for w in words:
            t, k = self.of_word(w)
            n += k
            for i, x in enumerate(t):
                sums[i] += x
        return sums, n


def script(words: list[str]) -> tuple[int, ...]:
    """The languages of the script that most letters are of."""
    arabic = sum(len(w) for w in words if "\u0600" <= w[0] <= "\u06ff")
    return SCRIPTS["arabic" if 2 * arabic > sum(map(len, words)) else "latin"]


def confidence(sums: list[float], among: tuple[int, ...]) -> float:
    """Of the best language against the second of its script, from their cosines times the root of the number of n-grams."""
    best, second = sorted((sums[i] for i in among), reverse=True)[:2]
    return 1 / (1 + math.exp(-3 * (best - second) / math.sqrt(DIM)))


def languages(text: str, profiles: Profiles) -> tuple[str, float, list[tuple[str, float]]]:
    """(language or 'mixed' or 'unknown', confidence, [(language, confidence) of each non-blank line])."""
    found: list[tuple[list[float], tuple[int, ...]] | None] = []
    total, weight = [0.0] * len(LANGS), {k: 0 for k in SCRIPTS.values()}
    for line in ordinal_lines(text):
        if not line.strip():
            continue
        words = UNIT.findall(bare(line))
        if not wordy(line, words):
            found.append(None)
            continue
        words = [w for w in words if w not in SYMBOLS]
        sums, n = profiles.of_words(words)
        among = script(words)
        found.append((sums, among))
        weight[among] += n
        for i in among:
            total[i] += sums[i]
    if not any(weight.values()):
        return "unknown", 1.0, [("unknown", 1.0)] * len(found)
    widest = max(weight, key=weight.__getitem__)
    main = max(widest, key=total.__getitem__)
    picks: list[int | None] = []
    for f in found:
        if f is None:
            picks.append(None)
            continue
        sums, among = f
        best = max(among, key=sums.__getitem__)
        # The margin is that of the cosines times the root of the number of n-grams.
        stays = main in among and (sums[best] - sums[main]) / math.sqrt(DIM) < SWITCH
        picks.append(main if stays else best)
    kinds = {p for p in picks if p is not None}
    if len(kinds) == 1:
        only = kinds.pop()
        return LANGS[only], confidence(total, widest), [("unknown", 1.0) if f is None else (LANGS[only], confidence(*f)) for f in found]
    segments = []
    last = next(p for p in picks if p is not None)
    for p, f in zip(picks, found, strict=True):
        last = last if p is None else p  # a line of symbols goes with the one before
        segments.append((LANGS[last], confidence(*f) if f else 0.5))
    return "mixed", min(c for _, c in segments), segments


def labelled_sample(df: DataFrame, key: str, text: str, label: str, size: int = SAMPLE) -> list[tuple[str, str]]:
    """(language, text) of about ``size`` labelled rows: those whose key's hash is below the sampled share.

    The rows are counted first, so that the tasks hand the driver only what is kept.
    """
    labelled = df.filter(F.col(label).isNotNull() & (F.length(F.trim(label)) > 0))
    n = labelled.count()
    share = min(1.0, size / max(n, 1))
    rows = (
        labelled.filter(F.col(text).isNotNull() & (F.abs(F.xxhash64(key) % F.lit(1_000_003)) < F.lit(int(share * 1_000_003) + 1)))
        .select(F.xxhash64(key).alias("h"), F.col(label).alias("label"), F.col(text).alias("t"))
        .orderBy("h", "t")
        .limit(2 * size)
        .collect()
    )
    return [(lang, r["t"]) for r in rows if (lang := label_language(r["label"])) in LANGS]


def fit(df: DataFrame | None, key: str = "row_id", text: str = "text", label: str = "label", size: int = SAMPLE) -> np.ndarray:
    """Prototypes from the seed sentences and a bounded sample of labelled rows."""
    texts = list(SEED.items())
    if df is not None:
        texts += labelled_sample(df, key, text, label, size)
    return train(texts)


SEGMENT = "struct<seg_no: bigint, lang: string, confidence: double>"


def text_languages(df: DataFrame, prototypes: np.ndarray, key: str = "row_id", text: str = "text", label: str = "label") -> DataFrame:
    """(key, label, label_lang, lang, confidence, segments) of every row with a text that is not blank."""
    sc = df.sparkSession.sparkContext
    shared = sc.broadcast(prototypes)  # 7 x DIM, whatever the data
    schema = pa.schema(
        [("row_id", pa.int64()), ("label", pa.string()), ("label_lang", pa.string()), ("lang", pa.string()), ("confidence", pa.float64()),
         ("segments", pa.list_(pa.struct([("seg_no", pa.int64()), ("lang", pa.string()), ("confidence", pa.float64())])))]
    )

    def make() -> Callable:
        profiles = Profiles(shared.value)

        def one(c: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {n: [] for n in schema.names}
            for i, t, lab in zip(c["row_id"], c["text"], c["label"], strict=True):
                lang, conf, segments = languages(t, profiles)
                out["row_id"].append(i)
                out["label"].append(lab)
                out["label_lang"].append(label_language(lab))
                out["lang"].append(lang)
                out["confidence"].append(conf)
                out["segments"].append([{"seg_no": k, "lang": x, "confidence": y} for k, (x, y) in enumerate(segments, 1)] if lang == "mixed" else None)
            return out

        return one

    rows = df.select(F.col(key).alias("row_id"), F.col(text).alias("text"), F.col(label).alias("label")).filter(F.col("text").rlike(r"\S"))
    return map_rows(rows, make, schema, f"row_id bigint, label string, label_lang string, lang string, confidence double, segments array<{SEGMENT}>")


def wrong_labels(found: DataFrame) -> DataFrame:
    """(row_id, seg_no, lang, confidence): missing and wrong labels with seg_no 0, and every segment of mixed texts."""
    single = found.filter((F.col("lang") != "mixed") & ~F.col("lang").eqNullSafe(F.col("label_lang"))).select("row_id", F.lit(0).cast("bigint").alias("seg_no"), "lang", "confidence")
    mixed = found.filter("lang = 'mixed'").select("row_id", F.inline("segments"))
    return single.unionByName(mixed)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "rag_chunks").select("row_id", F.col("raw_text").alias("text"), F.col("metadata.language").alias("label"))


def p2_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every chunk and of every segment of a mixed one."""
    rows = chunks(spark, sf_dir)
    return text_languages(rows, fit(rows))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with a missing or wrong label, and the segments of mixed chunks."""
    rows = chunks(spark, sf_dir)
    found = text_languages(rows, fit(rows))
    # One pass over the operator's rows: both kinds of case come out of one generator.
    cases = F.when(F.col("lang") == "mixed", F.expr("transform(segments, s -> struct(s.seg_no as seg_no, s.lang as lang))")).when(
        ~F.col("lang").eqNullSafe(F.col("label_lang")), F.array(F.struct(F.lit(0).cast("bigint").alias("seg_no"), F.col("lang").alias("lang")))
    )
    return found.select("row_id", cases.alias("cases")).filter("cases IS NOT NULL").select("row_id", F.inline("cases"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p2_found": p2_found, "p2_languages": p2_languages}
ORACLE: dict[str, str] = {}
