"""Problem 9: abusive, hateful and sexual content.

A linear classifier per category (logistic loss) over what a sentence says: which classes of
words it holds (insults, threats, dehumanising words, sexual words, persons spoken to, groups,
words of lessons ...), which two of them stand together in it, and its words themselves, as far
as the labelled sentences of ``offence_examples`` have them.  It is trained on those sentences
and a bounded sample of corpus sentences as ordinary text.  It is counterfactually regularised:
in every labelled sentence that names a group, the group is swapped for others (neutral ones
included) and the squared change of the score is penalised, so that the mention of a group
alone carries no weight.  Disguised words (spaced, starred, with digits or signs for letters,
stretched) are first brought back to the word of the lexicon that they stand for.

A document's score in a category is its highest sentence score; sentences without a word of
the classes ``TELLING`` score 0.  Null, empty and blank texts score 0.  Repeated texts score
alike.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CACHE, map_rows, table
from .lookalikes import bare
from .offence_examples import BENIGN, GROUPS, INSULTS, LEXICON, NEUTRAL_GROUPS, OFFENSIVE

CATEGORIES = ("abusive", "hateful", "sexual")
#: Corpus documents taken as ordinary text (a bounded sample), most characters of each that are trained
#: on, weight of the counterfactual penalty and of the ridge, steps of gradient descent, score of a case.
SAMPLE, CHARACTERS, LAMBDA, RIDGE, STEPS, CASE = 500, 4000, 4.0, 1e-3, 300, 0.5
#: Log-odds from which a corpus sentence may be an offence itself and is no example of ordinary text.
SURE = 2.0
#: Words of a window of a long sentence.
WINDOW = 24
#: Classes of which a sentence must hold a word to be scored.
TELLING = ("insult", "vulgar", "hush", "harm", "vermin", "crime", "expel", "deny", "cleaner", "sex", "body")

_SENTENCE = re.compile(r"(?<=[.!?؟؛])\s+|[\n\r\t]+")
_SPACED = re.compile(r"(?<![\w'’])(?:[^\W\d_] ){3,}[^\W_](?![\w'’])")
_TOKEN = re.compile(r"[^\s,;:!?؟،؛\"“”„«»()\[\]{}…]+")
_SIGNS = str.maketrans({"@": "a", "$": "s", "€": "e", "£": "l"})
_VOWELS = re.compile(r"[aeiouyäöüáéíóúàèùâêîôûïëãõ0134@*]")
_STRETCH = re.compile(r"([^\W\d_])\1{2,}")


def frame(word: str) -> str:
    """What a disguise leaves: consonants in order, repetitions made one."""
    w = _VOWELS.sub("", word.translate(_SIGNS).replace("5", "s").replace("7", "t"))
    return re.sub(r"(.)\1+", r"\1", w)


class Words:
    """Sentence to words, disguised ones by the vocabulary."""

    def __init__(self, vocabulary: set[str]) -> None:
        self.vocabulary = vocabulary
        self.frames: dict[str, list[str]] = {}
        self.ends: dict[tuple[str, str, int], list[str]] = {}
        for w in sorted(vocabulary):
            self.frames.setdefault(frame(w), []).append(w)
            self.ends.setdefault((w[0], w[-1], len(w)), []).append(w)
        self.kept: dict[str, str] = {}

    def __call__(self, sentence: str) -> list[str]:
        s = bare(sentence)
        if " " in s:
            s = _SPACED.sub(lambda m: m[0].replace(" ", ""), s)
        out = []
        for t in _TOKEN.findall(s):
            w = self.kept.get(t)
            if w is None:
                if len(self.kept) > CACHE:
                    self.kept.clear()
                w = self.kept[t] = self.word(t)
            if w:
                out += w.split(" ")
        return out

    def word(self, token: str) -> str:
        t = token.strip(".-–—_*'’`~|")
        if token.count("*") > 1 and len(t) > 1 and "*" in t:
            got = self.ends.get((t[0], t[-1], len(t)), [])
            return got[0] if got else t
        if not any(c.isalpha() for c in t):
            return "" if not t.strip("@$*0123456789.") or t[:1].isdigit() else self.disguised(t)
        if t.isalpha():
            u = _STRETCH.sub(r"\1", t)
            if u != t:
                two = _STRETCH.sub(r"\1\1", t)
                return two if two in self.vocabulary else u
            return t
        plain = re.sub(r"(?<=[^\W\d_])[.\-_*·](?=[^\W\d_])", "", t)
        if plain.isalpha() and plain in self.vocabulary:
            return plain
        if re.search(r"[@$0-9*]", t):
            return self.disguised(plain)
        return " ".join(x for x in re.split(r"[^\w@$*]+", t) if x)

    def disguised(self, t: str) -> str:
        got = [w for w in self.frames.get(frame(t), ()) if abs(len(w) - len(t)) < 2]
        return got[0] if got else t


_CLASSES = tuple(LEXICON)
_TELLING = sum(1 << _CLASSES.index(c) for c in TELLING)
_PREFIXES = re.compile("^(?:و|ف)?(?:بال|كال|لل|ال|ب|ل)?")


class Lexicon:
    """The classes of a word, as a set of bits."""

    def __init__(self) -> None:
        self.exact: dict[str, int] = {}
        self.starts: dict[str, int] = {}
        for k, entries in enumerate(LEXICON.values()):
            for e in entries.split():
                at, word = (self.starts, bare(e[:-1])) if e.endswith("*") else (self.exact, bare(e))
                at[word] = at.get(word, 0) | 1 << k
        self.least = min(map(len, self.starts))

    def words(self) -> set[str]:
        telling = {w for d in (self.exact, self.starts) for w, bits in d.items() if bits & _TELLING}
        return {w for w in telling if len(w) > 2}

    def of(self, w: str) -> int:
        bits = self.exact.get(w, 0)
        for n in range(self.least, len(w) + 1):
            bits |= self.starts.get(w[:n], 0)
        if not bits and "\u0600" <= w[:1] <= "\u06ff":
            rest = w[_PREFIXES.match(w).end() :]
            bits = self.exact.get(rest, 0) | self.exact.get("ال" + rest, 0) if len(rest) > 2 else 0
        return bits


def features(words: list[str], classes: list[int]) -> list[str]:
    """The words, the classes and the pairs of classes of a run of words."""
    held = 0
    for bits in classes:
        held |= bits
    names = [c for k, c in enumerate(_CLASSES) if held >> k & 1]
    return [*dict.fromkeys(words), *(f"#{c}" for c in names), *(f"#{a}&{b}" for a, b in itertools.combinations(names, 2))]


Templates = dict[str, dict[str, tuple[str, ...]]]


def filled(lang: str, s: str) -> list[str]:
    """A labelled sentence with its slots filled in turn."""
    if "{G}" in s:
        return [s.replace("{G}", g) for g in GROUPS[lang]]
    return [s.replace("{I}", i) for i in INSULTS[lang]] if "{I}" in s else [s] * 4


def examples(offensive: Templates = OFFENSIVE, benign: dict[str, tuple[str, ...]] = BENIGN) -> tuple[list[tuple[str, int]], list[tuple[str, str]]]:
    """((sentence, category or -1)), and pairs of sentences that differ in the group they name."""
    labelled: list[tuple[str, int]] = []
    pairs: list[tuple[str, str]] = []

    def swaps(lang: str, s: str, of: list[str]) -> None:
        neutral = [s.replace("{G}", g) for g in NEUTRAL_GROUPS[lang]]
        pairs.extend([*zip(of, of[1:]), *zip(of, itertools.cycle(neutral))])

    for lang, by in offensive.items():
        for k, category in enumerate(CATEGORIES):
            for s in by.get(category, ()):
                labelled += [(x, k) for x in filled(lang, s)]
                if "{G}" in s:
                    swaps(lang, s, filled(lang, s))
    for lang, sentences in benign.items():
        for s in sentences:
            labelled += [(x, -1) for x in filled(lang, s)]
            if "{G}" in s:
                swaps(lang, s, filled(lang, s))
        for g in (*GROUPS[lang], *NEUTRAL_GROUPS[lang]):
            labelled.append((g, -1))
    return labelled, pairs


class Classifier:
    """Weights by feature; picklable, a few thousand entries."""

    def __init__(self, weights: dict[str, tuple[float, ...]], bias: tuple[float, ...]) -> None:
        self.weights, self.bias = weights, bias
        self._setup()

    def _setup(self) -> None:
        self.lexicon = Lexicon()
        self.words = Words(self.lexicon.words())
        self.classes: dict[str, int] = {}
        self.known = {w for w in self.weights if w[0] != "#"}

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "bias": self.bias}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._setup()

    def bits(self, words: list[str]) -> list[int]:
        out = []
        for w in words:
            got = self.classes.get(w)
            if got is None:
                if len(self.classes) > CACHE:
                    self.classes.clear()
                got = self.classes[w] = self.lexicon.of(w)
            out.append(got)
        return out

    def of(self, found: list[str], classes: list[int]) -> tuple[float, ...]:
        total = list(self.bias)
        get = self.weights.get
        for f in features([w for w in found if w in self.known], classes):
            w = get(f)
            if w:
                for k, x in enumerate(w):
                    total[k] += x
        return tuple(1 / (1 + math.exp(-max(-50.0, min(50.0, x)))) for x in total)

    def sentence(self, s: str) -> tuple[float, ...]:
        found = self.words(s)
        classes = self.bits(found)
        if not any(bits & _TELLING for bits in classes):
            return (0.0,) * len(self.bias)
        if len(found) <= WINDOW:
            return self.of(found, classes)
        best = (0.0,) * len(self.bias)  # a long run of words: what stands near each other
        for i in range(0, len(found) - WINDOW // 2, WINDOW // 2):
            if any(bits & _TELLING for bits in classes[i : i + WINDOW]):
                best = tuple(map(max, best, self.of(found[i : i + WINDOW], classes[i : i + WINDOW])))
        return best

    def text(self, text: str | None) -> tuple[float, ...]:
        best = (0.0,) * len(self.bias)
        for s in _SENTENCE.split(text or ""):
            if s and not s.isspace():
                best = tuple(map(max, best, self.sentence(s)))
        return best


def train(ordinary: list[str] = (), penalty: float = LAMBDA, offensive: Templates = OFFENSIVE, benign: dict[str, tuple[str, ...]] = BENIGN) -> Classifier:
    """Gradient descent on the logistic loss with ridge and counterfactual penalty; deterministic."""
    labelled, pairs = examples(offensive, benign)
    lexicon = Lexicon()
    words = Words(lexicon.words())

    def of(s: str) -> list[str]:
        found = words(s)
        return features(found, [lexicon.of(w) for w in found])

    rows = [(of(s), k) for s, k in labelled]
    told = [f for f in map(of, ordinary) if any(x[1:] in TELLING for x in f if x[0] == "#")]
    # Corpus sentences could be offences themselves: those that a first model without them takes for one are left out.
    if told:
        first = train((), penalty, offensive, benign)
        score = lambda f: max(b + sum(first.weights[x][k] for x in f if x in first.weights) for k, b in enumerate(first.bias))
        told = [f for f in told if score(f) < SURE]
    rows += [(f, -1) for f in told]
    seen: dict[str, int] = {}
    for f, k in rows:
        for x in f:
            seen[x] = seen.get(x, 0) + 1
    # Words of the labelled sentences of two templates or more; a single one would be learnt by heart.
    spread: dict[str, set[int]] = {}
    for n, (s, _) in enumerate((s, k) for by in offensive.values() for k, ss in by.items() for s in ss):
        for x in of(s.replace("{G}", "").replace("{I}", "")):
            spread.setdefault(x, set()).add(n)
    at = {x: i for i, x in enumerate(sorted(x for x, n in seen.items() if x[0] == "#" or n > 3 and len(spread.get(x, ())) > 1))}

    def sparse(fs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        r = [(i, at[x]) for i, f in enumerate(fs) for x in f if x in at]
        return np.array([a for a, _ in r], int), np.array([b for _, b in r], int)

    i, j = sparse([f for f, _ in rows])
    pi, pj = sparse([of(a) for a, _ in pairs])
    qi, qj = sparse([of(b) for _, b in pairs])
    y = np.array([[k == c for c in range(len(CATEGORIES))] for _, k in rows], float)
    positive = max(y.sum(), 1)
    weight = np.where(y.sum(1, keepdims=True) > 0, 1.0, positive / max(len(rows) - positive, 1))
    n, d, m = len(rows), len(at), max(len(pairs), 1)
    w, b = np.zeros((d, len(CATEGORIES))), np.full(len(CATEGORIES), -2.0)
    speed_w, speed_b = np.zeros_like(w), np.zeros_like(b)

    def dot(ii: np.ndarray, jj: np.ndarray, count: int) -> np.ndarray:
        out = np.zeros((count, w.shape[1]))
        np.add.at(out, ii, w[jj])
        return out

    for _ in range(STEPS):
        z = dot(i, j, n) * 0.5 + b
        g = weight * (1 / (1 + np.exp(-z)) - y) / n * 40
        gw = np.zeros_like(w)
        np.add.at(gw, j, g[i] * 0.5)
        change = dot(pi, pj, len(pairs)) - dot(qi, qj, len(pairs))  # the score must not change with the group
        np.add.at(gw, pj, penalty * change[pi] / m)
        np.add.at(gw, qj, -penalty * change[qi] / m)
        gw += RIDGE * w
        speed_w, speed_b = 0.9 * speed_w - 0.05 * gw, 0.9 * speed_b - 0.05 * g.sum(0)
        w += speed_w
        b += speed_b
    keep = np.abs(w).max(1) > 1e-2 if d else []
    return Classifier({x: tuple(float(v) * 0.5 for v in w[k]) for x, k in at.items() if keep[k]}, tuple(float(v) for v in b))


def held_out(folds: int = 5, ordinary: list[str] = ()) -> tuple[float, float]:
    """(recall, precision) of categories on sentences whose templates the model has not seen, over ``folds`` parts of the templates."""
    right = told = true = 0
    for part in range(folds):
        chosen = lambda ss, inside: tuple(s for n, s in enumerate(ss) if (n % folds == part) == inside)
        split = lambda inside: ({x: {c: chosen(ss, inside) for c, ss in by.items()} for x, by in OFFENSIVE.items()}, {x: chosen(ss, inside) for x, ss in BENIGN.items()})
        model = train(ordinary, LAMBDA, *split(False))
        for s, k in examples(*split(True))[0]:
            found = [c for c, x in enumerate(model.text(s)) if x >= CASE]
            right, told, true = right + (k in found), told + len(found), true + (k >= 0)
    return right / max(true, 1), right / max(told, 1)


def ordinary_sentences(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SAMPLE) -> list[str]:
    """Sentences of about ``size`` documents, picked by a hash of the key: training data, the first ``CHARACTERS`` of each."""
    n = docs.count()
    share = min(1.0, size / max(n, 1))
    rows = docs.filter(F.col(text).isNotNull() & (F.abs(F.xxhash64(key) % F.lit(1_000_003)) < F.lit(int(share * 1_000_003) + 1))).select(F.xxhash64(key).alias("h"), F.substring(text, 1, CHARACTERS).alias("t")).orderBy("h", "t").limit(2 * size).collect()
    return [s for r in rows for s in _SENTENCE.split(r["t"]) if len(s) > 8]


def scores(docs: DataFrame, model: Classifier, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, abusive, hateful, sexual): the highest sentence scores of every document, all texts whole."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([(key, pa.int64()), *((c, pa.float64()) for c in CATEGORIES)])

    def make() -> Callable:
        known = shared.value

        def one(c: dict[str, list]) -> dict[str, list]:
            got = [known.text(t) for t in c["text"]]
            return {key: c[key]} | {name: [g[k] for g in got] for k, name in enumerate(CATEGORIES)}

        return one

    return map_rows(docs.select(key, F.col(text).alias("text")), make, schema, f"{key} bigint, " + ", ".join(f"{c} double" for c in CATEGORIES))


def rates(docs: DataFrame, model: Classifier, text: str = "text", source: str = "source") -> DataFrame:
    """(source, docs, abusive, hateful, sexual, rate): documents, cases and the share of documents with a case of each source.

    Counts are added up in the tasks, so one row a source and task is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ("docs", *CATEGORIES, "cases")
    schema = pa.schema([("source", pa.string()), *((n, pa.int64()) for n in names)])

    def make() -> Callable:
        known, counts = shared.value, {}

        def one(c: dict[str, list]) -> dict[str, list] | None:
            if not c:
                return {"source": list(counts), **{n: [v[k] for v in counts.values()] for k, n in enumerate(names)}}
            for src, t in zip(c["source"], c["text"], strict=True):
                hit = [x >= CASE for x in known.text(t)]
                row = counts.setdefault(src, [0] * len(names))
                for k, x in enumerate((True, *hit, any(hit))):
                    row[k] += x
            return None

        return one

    part = map_rows(docs.select(F.col(source).alias("source"), F.col(text).alias("text")), make, schema, "source string, " + ", ".join(f"{n} bigint" for n in names), after=lambda one: one({}))
    total = part.groupBy("source").agg(*(F.sum(n).alias(n) for n in names))
    return total.select("source", "docs", *CATEGORIES, F.round(F.col("cases") / F.col("docs"), 6).alias("rate"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scores(docs, train(ordinary_sentences(docs)))


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of every document."""
    return scored(spark, sf_dir)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each category of which a document has a case."""
    each = F.array(*(F.struct(F.lit(c).alias("category"), F.col(c).alias("score")) for c in CATEGORIES))
    return scored(spark, sf_dir).select("doc_id", F.inline(F.filter(each, lambda x: x["score"] >= CASE))).select("doc_id", "category")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, cases and rates of each source."""
    docs = documents(spark, sf_dir)
    return rates(docs, train(ordinary_sentences(docs)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates}
ORACLE: dict[str, str] = {}
