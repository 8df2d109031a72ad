import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tomeflow.llm import canonical, encode, language, mixing, near_duplicates, offence, pairs, scan_noise, split
from tomeflow.llm.lookalikes import fold


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


# 7 ------------------------------------------------------------------------------------


def brute_bpe(piece, rank):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        best = min(((rank.get(parts[i] + parts[i + 1], math.inf), i) for i in range(len(parts) - 1)), default=(math.inf, 0))
        if best[0] == math.inf:
            return [rank[p] for p in parts]
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_segment_tree_against_brute_force():
    rank = encode.encoder(encode.vocabulary()).rank
    rng = random.Random(3)
    for _ in range(300):
        piece = bytes(rng.choice(b"aabeinrst \xc3\xa9\xd8") for _ in range(rng.randint(0, 40)))
        assert encode.merge_ranks(piece, rank) == (brute_bpe(piece, rank) if piece else [])


def test_encoding_matches_the_public_library_and_decodes(spark):
    tiktoken = pytest.importorskip("tiktoken")
    path = encode.vocabulary()
    lib = tiktoken.Encoding("own", pat_str=encode.SPLIT, mergeable_ranks=encode.encoder(path).rank, special_tokens={})
    texts = ["", None, " \n\t", "It's 12 o'clock, naïve 😀 مرحبا", "x" * 3000, "<|endoftext|>"]
    got = {r["doc_id"]: r["ids"] for r in encode.encode(frame(spark, list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (lib.encode_ordinary(t) if t else [])
        assert encode.decode(got[i], path) == (t or "")
    clash = frame(spark, [(1, "a", "old")], "doc_id bigint, text string, ids string")
    assert encode.encode(clash).first()["ids"] == lib.encode_ordinary("a")
    assert encode.encode(clash.limit(0)).count() == 0


# 5 ------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(5))
def test_pieces(seed):
    rng = random.Random(seed)
    text = " ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(1, 9))) + rng.choice(["", "", ".", "?", ".\n"]) for _ in range(400))
    kind, cuts = split.pieces(text, 300, 40)
    assert all(b - a <= 300 for a, b, _ in cuts) and cuts[0][0] == 0 and cuts[-1][1] == len(text)
    assert all(x[1] - y[0] == 40 for x, y in zip(cuts, cuts[1:]))
    assert kind == "natural" and all(how != "forced" for *_, how in cuts[:-1])


def test_split_cases(spark):
    rows = [(1, None), (2, ""), (3, "a" * 650), (4, "a" * 651), (4, "a" * 651), (5, ("Word. " * 200))]
    out = split.split_oversized(frame(spark, rows, "row_id bigint, raw_text string"), "row_id", {"raw_text": 650}).filter("piece_no = 1")
    assert sorted((r["row_id"], r["cut"]) for r in out.collect()) == [(4, "forced"), (4, "forced"), (5, "natural")]
    with pytest.raises(ValueError):
        split.pieces("a" * 100, 50, 50)


# 2 ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def profiles():
    return language.Profiles(language.fit(None))


@pytest.mark.parametrize("text,lang", [("Warum ist das Wasser in dem Fluss so kalt?", "de"), ("Why is the water in the river so cold?", "en"), ("Por que razão a água do rio não está fria?", "pt"), ("¿Por qué está tan fría el agua del río?", "es"), ("لماذا كانت مياه النهر باردة؟", "ar"), ("چرا آب رودخانه سرد است؟", "fa"), ("Pourquoi l'eau de la rivière est-elle froide ?", "fr"), ("R = U / I = 3 Ω\nsin α = 2", "unknown")])
def test_language(profiles, text, lang):
    assert language.languages(text, profiles)[0] == lang


def test_mixed_and_labels(spark, profiles):
    lang, _, segments = language.languages("The people of the village were there.\n\nDas ist nicht die gleiche Antwort wie vorher.", profiles)
    assert lang == "mixed" and [s[0] for s in segments] == ["en", "de"]
    assert [language.label_language(x) for x in ("en-GB", "ENG", "English", " ", None, "n/a", "mixed", "unknown")] == ["en", "en", "en", None, None, None, "?", "unknown"]
    rows = frame(spark, [(1, "This is the water of the river.", "en"), (2, "This is the water of the river.", None), (3, None, "en"), (4, " ", "en"), (5, "1 + 1 = 2", "unknown")], "row_id bigint, text string, label string")
    found = language.text_languages(rows, language.fit(None))
    assert found.count() == 3
    assert [(r["row_id"], r["seg_no"], r["lang"]) for r in language.wrong_labels(found).collect()] == [(2, 0, "en")]


# 3 ------------------------------------------------------------------------------------


def test_canonical_forms(spark):
    clean = [(i, "raw_text", "The tax register shows the river", ) for i in range(3)]
    odd = [(10, "raw_text", "The tаx register"), (11, "heading", "Ｔｈｅ river"), (12, "heading", "ri​ver of x² and α"), (13, "raw_text", "The river"), (14, "raw_text", "rivér"), (15, "chapter", "الشمعة المشتعلة في الکتاب"), (16, "raw_text", ""), (17, "raw_text", "x" * 50_000), (18, "raw_text", "می‌رود از شهر به خانه گرم پدر")]
    values = frame(spark, clean + odd, "row_id bigint, field string, value string")
    out = {(r["row_id"], r["form"]): (r["canonical"], r["origin"]) for r in canonical.inconsistent(values).collect()}
    assert {k[0] for k in out} == {10, 11, 12, 13, 14, 15}
    assert out[(10, "tаx")] == ("tax", "vocabulary") and out[(11, "Ｔｈｅ")] == ("The", "vocabulary") and out[(15, "الکتاب")] == ("الكتاب", "table")
    assert canonical.inconsistent(values.limit(0)).count() == 0
    assert fold("Соmрrеndrе ﬁn") == "Comprendre fin"


def test_arabic_with_all_its_letters_persian(spark):
    rows = [(1, "heading", "4.2 کیف نفهم المصدر المکتوب"), (2, "heading", "4.2 كيف نفهم المصدر المكتوب"), (3, "chapter", "پدر از خانه به شهر مي رود"), (4, "chapter", "پدر از خانه به شهر می رود")]
    got = {r["row_id"] for r in canonical.inconsistent(frame(spark, rows, "row_id bigint, field string, value string")).collect()}
    assert got == {1, 3}


# 1 ------------------------------------------------------------------------------------


def noise_of(spark, texts, words, pairs=(), compounds=()):
    """Repairs and hyphens of texts, given the counts of words, pairs and compounds."""
    stats = frame(spark, [("w" + w, n) for w, n in words.items()] + [("p" + p, n) for p, n in dict(pairs).items()] + [("h" + h, 50) for h in compounds], "key string, n bigint")
    rows = frame(spark, [("s", i, "b", str(i), None, t) for i, t in enumerate(texts)], "src string, row_id bigint, book string, place string, page string, text string")
    words_, breaks, _ = scan_noise.parts_of(scan_noise.inspect(rows, scan_noise.sure_forms(stats)))
    found = {i: {} for i in range(len(texts))}
    for r in scan_noise.misread(words_, stats).collect():
        found[r["row_id"]][r["wrong"]] = r["right"]
    return found, {r["row_id"] for r in scan_noise.compounds(breaks, stats).filter("NOT natural").collect()}


def test_scan_noise_words(spark):
    words = {w: 100 for w in "the surface tension changes whether a map is drawn modern burning".split()} | {"surface": 200}
    pairs_ = dict.fromkeys(["the surface", "surface tension", "a map", "tension changes", "is drawn"], 40)
    texts = ["the surfacc tension", "the 5urface tension", "amap is drawn", "ten sion changes", "the surface tension changes", "", "Quivinpar is drawn", "the ten-\nsion", "obse¬\nrve", "the end -\nthe map", "vê-\nse", "the Surfacc tension and\r\nten-\r\nsion"]
    wrong, broken = noise_of(spark, texts, words, pairs_, ["vê-se"])
    assert wrong[0] == {"surfacc": "surface"} and wrong[1] == {"5urface": "surface"} and wrong[2] == {"amap": "a map"} and wrong[3] == {"ten sion": "tension"}
    assert not wrong[4] and not wrong[5] and not wrong[6] and not wrong[7] and wrong[11] == {"Surfacc": "surface"}
    assert broken == {7, 8, 11}
    assert scan_noise.mended("The Surfacc ten sion", wrong[0] | wrong[3]) == "The Surface tension" and scan_noise.mended("", {}) == ""


def test_frequent_misreadings_are_no_words(spark):
    words = {"before": 9856, "bef0re": 42, "bcfore": 37, "compare": 4000, "cornpare": 16, "values": 4600, "v@lues": 17, "class": 4221, "dass": 1469, "que": 9191, "qué": 1386, "الهواء": 3025, "ا|هواء": 20, "co2": 50}
    stats = frame(spark, [("w" + w, n) for w, n in words.items()], "key string, n bigint")
    assert set(words) - scan_noise.sure_forms(stats) == {"bef0re", "bcfore", "cornpare", "v@lues", "ا|هواء", "co2"}
    wrong, _ = noise_of(spark, ["values bcfore", "compare v@lues", "compare values before of CO2", "the b3fore"], words, {"values before": 30})
    assert wrong == {0: {"bcfore": "before"}, 1: {"v@lues": "values"}, 2: {}, 3: {}}
    hot = [(f"the page of {w} was scanned twice",) for w in ["harbour"] * 3] + [("harhour again",)] * 500
    stats = {r["key"]: r["n"] for r in scan_noise.word_stats(frame(spark, hot, "text string").distinct()).collect()}
    assert stats["wharhour"] == 1
    assert "harhour" not in scan_noise.sure_forms(scan_noise.learn(frame(spark, hot, "text string")))


def test_rare_words_are_known_at_any_size(spark):
    """A right word far below the share, and a misreading as far below it, are told apart by their own counts."""
    words = {"the": 50_000_000, "stream": 900, "strearn": 2, "zorvan": 8}
    wrong, _ = noise_of(spark, ["the strearn", "the zorvan", "the stream"], words, {"the stream": 500, "the zorvan": 8})
    assert wrong == {0: {"strearn": "stream"}, 1: {}, 2: {}}


def test_outer_lines():
    got = {x[1]: x for x in scan_noise.outer_lines("— 8 —    Physics — Telva\n\nThe wire is long and thin and\nleads to the other side.\n[9]")}
    assert got["physics — telva"][2] == "8" and got[""][2] == "9"
    assert [x[:3] for x in scan_noise.outer_lines("Physics 12, Telva\r\rThe wire is long and thin and\rleads to the other side of it.\r- 7 -")] == [(0, "physics #, telva", ""), (4, "", "7")]
    assert scan_noise.outer_lines("") == [] and not [x for x in scan_noise.outer_lines("a word\n12\n13\n14\nmore words.") if not x[1]]


def test_scan_noise_tables(spark, tmp_path):
    t = "datetime string"
    pages = [(i, "b", i, f"Physics {i}\n\nThe long wire leads to the other\nside of the ri-\nver.\n{i}" if i < 4 else None, i) for i in range(1, 6)]
    frame(spark, [(*p[:4], p[4]) for p in pages], "row_id bigint, file_reference_id string, doc_idx int, text string, page int").write.parquet(f"{tmp_path}/loaded_pages.parquet")
    frame(spark, [], "row_id bigint, chunk_id string, raw_text string, metadata struct<file_reference_id:string,page:int>").write.parquet(f"{tmp_path}/rag_chunks.parquet")
    frame(spark, [("b", "Physics 3", "Physics")], "file_reference_id string, title string, subject string").write.parquet(f"{tmp_path}/books.parquet")
    found = Counter((r["row_id"], r["noise"]) for r in scan_noise.p1_found(spark, str(tmp_path)).collect())
    assert {k for k in found if k[1] != "misread"} == {(i, n) for i in (1, 2, 3) for n in ("hyphen", "header", "pageno")} and t
    text = {r["row_id"]: r["text"] for r in scan_noise.p1_text(spark, str(tmp_path)).collect()}
    assert text[1] == "The long wire leads to the other side of the river."


def test_reflow_keeps_lists_headings_and_columns(spark):
    text = "1.6 The trade route\nThe long wire leads to the ot-\nher side of the\nriver.\n- first thing\n- second thing\n12\n13\n- 4 -"
    rows = frame(spark, [("s", 1, "b", "1", "4", text)], "src string, row_id bigint, book string, place string, page string, text string")
    stats = frame(spark, [("wother", 10)], "key string, n bigint")
    books = frame(spark, [], "book string, book_title string, book_subject string")
    assert scan_noise.repaired(rows, stats, books).first()["text"] == "1.6 The trade route\nThe long wire leads to the other side of the river.\n- first thing\n- second thing\n12\n13"


# 4 ------------------------------------------------------------------------------------


#: How often texts of the corpus end after these, and go on.
COUNTS = {"2 glass lens": (20, 5), "1 lens": (20, 5), "2 the glass": (0, 90), "1 the": (0, 90), "1 glass": (0, 60), "s short": (80, 20), "s item": (90, 10), "s sentence": (3, 97)}


@pytest.fixture(scope="module")
def judge(spark):
    import math

    model = pairs.CharBayes(list(language.SEED.items()))

    def one(q, a):
        found, contexts = pairs.pair_defects(q, a, model)
        if contexts:  # what the query does by joins
            odds = next((math.log((COUNTS[c][0] + 0.2) / (COUNTS[c][1] + 0.2)) for c in contexts[1:] if c in COUNTS), -9.0)
            ended, stopped = COUNTS[contexts[0]]
            if odds + pairs.SHAPE * math.log((ended + 0.2) / (ended + stopped + 0.4)) < pairs.CUT:
                found = found + ["truncated"]
        return found

    return one


def test_truncation_is_decided_by_the_counts_of_all_pairs(spark):
    rows = [(i, "What is it?", "It is the glass lens.") for i in range(80)] + [(100 + i, "What is it?", "the glass lens") for i in range(20)] + [(200, "What is it?", "the glass"), (201, "What is it?", "It is the glass lens. It is the"), (202, None, None), (203, "q", "")]
    got = {(r["turn_key"], r["defect"]) for r in pairs.defects(frame(spark, rows, "turn_key bigint, query string, answer string")).collect()}
    assert got == {(200, "truncated"), (201, "truncated"), (202, "empty"), (203, "empty")}
    assert pairs.defects(frame(spark, [], "turn_key bigint, query string, answer string")).count() == 0


@pytest.mark.parametrize(
    "answer,defects",
    [(None, ["empty"]), (" \n", ["empty"]), ("-", ["empty"]), ("```json\n{}\n```", ["empty"]), ('{"status": "answered", "answer": ""}', ["empty"]), ("N/A", ["empty"]), ("Answer:", ["empty"]), ("0", []), ("the glass lens", []), ("the glass", ["truncated"]),
     ("It is in the water. It is the (", ["truncated"]), ("It was there…", ["truncated"]), ("1. the glass lens\n2.", ["truncated"]), ("1. the glass lens\n2. the glass lens", []), ("What is in the water?", ["copy"]), ("Question: WHAT is in the water", ["copy"]),
     ("What is in the water? The people found that it was the lens.", []), ("I'm sorry, but I cannot help with this question. Please ask your teacher.", ["refusal"]), ("Unfortunately the pages found do not contain an answer.", ["refusal"]), ("Das Wasser des Flusses fließt in das Meer.", ["other_language"])],
)
def test_pair_defects(judge, answer, defects):
    assert judge("What is in the water?", answer) == defects


def test_unmarked_lists_need_no_stop(judge):
    assert judge("What is in the water?", "These were found in it:\nthe river stone\nthe old boat\nthe glass lens") == []
    assert judge("What is in the water?", "These were found in it:\nthe river stone\nthe old boat\nthe glass") == ["truncated"]
    assert judge("What is in the water?", "It was found in the water that there is a stone, a boat and the glass lens") == ["truncated"]


def test_pairs_in_another_language_that_was_asked_for(judge):
    assert judge("Translate into German: The water of the river flows.", "Das Wasser des Flusses fließt in das Meer.") == []
    assert judge(None, "The water of the river flows.") == []
    filler = "The water of the river flows to the sea. " * 12
    assert judge(f"{filler}Please translate the whole text into German. {filler}", "Das Wasser des Flusses fließt in das Meer.") == []
    assert judge(f"{filler}The German engineer had a bridge. {filler}", "Das Wasser des Flusses fließt in das Meer.") == ["other_language"]


# 6 ------------------------------------------------------------------------------------


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(40)] for _ in range(25)]
    rows = []
    for i, b in enumerate(base):
        for j in range(4):
            w = list(b)
            for _ in range(rng.randint(0, 8)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rng.shuffle(w)
            rows.append((f"c{i}_{j}", " ".join(w)))
    rows += [("same1", "a b c d"), ("same2", "d c b A"), ("same1", "a b c d"), ("null", None), ("empty", ""), ("marks", "...")]
    bags = {i: Counter(re.findall(r"[^\W_]+", t.lower())) for i, t in rows if t}
    truth = {(a, b) for a in bags for b in bags if a < b and bags[a] and bags[b] and sum((bags[a] & bags[b]).values()) >= 0.85 * max(sum(bags[a].values()), sum(bags[b].values()))}
    df = frame(spark, rows, "chunk_id string, text string").filter("text IS NOT NULL")
    got = {(r["chunk_id_a"], r["chunk_id_b"]) for r in near_duplicates.similar_pairs(df).collect()}
    assert not got - truth and len(got) >= 0.95 * len(truth) and ("same1", "same2") in got
    assert near_duplicates.similar_pairs(df.limit(0)).count() == 0
    by = {r["chunk_id"]: r["group_id"] for r in near_duplicates.groups(df).collect()}
    assert by["same1"] == by["same2"] and all(by[a] == by[b] for a, b in got)


def test_near_duplicates_whose_rare_words_differ(spark):
    """15 % of the words changed, the changed ones rare: the lowest weighted Jaccard that a pair at 0.85 can have."""
    rng = random.Random(8)
    pairs_, rows = set(), []
    for i in range(120):
        common = rng.sample([f"c{k}" for k in range(200)], 34)
        for side in "ab":
            w = common + [f"{side}{i}x{k}" for k in range(6)]
            rng.shuffle(w)
            rows.append((f"p{i}{side}", " ".join(w)))
        pairs_.add((f"p{i}a", f"p{i}b"))
    got = {(r["chunk_id_a"], r["chunk_id_b"]) for r in near_duplicates.similar_pairs(frame(spark, rows, "chunk_id string, text string")).collect()}
    assert not got - pairs_ and len(got) >= 0.97 * len(pairs_)
    signed = near_duplicates.sign(frame(spark, rows, "chunk_id string, text string"))
    found = near_duplicates.similar_classes(signed).collect()
    assert all(0.729 < r["jaccard"] < 1 and r["similarity"] >= 0.85 for r in found) and len(found) >= 0.97 * len(pairs_)
    lowest = 0.85 / (0.85 + 0.3 * near_duplicates.HEAVIEST)
    assert 1 - (1 - lowest**near_duplicates.ROWS) ** near_duplicates.BANDS >= 0.99


def test_hot_bands_are_split_without_loss(spark, monkeypatch):
    """Very many classes of one band: every pair is found, in blocks."""
    base = [f"w{k}" for k in range(60)]
    rows = [(f"c{i}", " ".join([*base, f"x{i}"])) for i in range(60)]
    monkeypatch.setattr(near_duplicates, "BLOCK", 8)
    monkeypatch.setattr(near_duplicates, "SAMPLED", 1)
    df = frame(spark, rows, "chunk_id string, text string")
    assert near_duplicates.banded(near_duplicates.sign(df).filter("bands IS NOT NULL"))[1].filter("block > 0").count() > 0
    assert near_duplicates.similar_pairs(df).count() == 60 * 59 // 2
    group = near_duplicates.groups(frame(spark, [*rows, ("copy", rows[0][1])], "chunk_id string, text string")).collect()
    assert len({r["group_id"] for r in group}) == 1 and {r["members"] for r in group} == {1, 2} and all(r["links"] == 59 for r in group)


def test_long_texts_raise_the_share_of_shipped_weights(spark, monkeypatch):
    rows = [(f"c{i}", " ".join(f"w{(i * 7 + k) % 50}" for k in range(30))) for i in range(20)] + [("d", " ".join(f"w{k % 50}" for k in range(30)))]
    df = frame(spark, rows, "chunk_id string, text string")
    whole = {tuple(r) for r in near_duplicates.similar_pairs(df).collect()}
    monkeypatch.setattr(near_duplicates, "TABLE", 3)
    assert {tuple(r) for r in near_duplicates.similar_pairs(df).collect()} == whole


# 8 ------------------------------------------------------------------------------------


def test_rake():
    cells = [("a", "en", "x", 100.0), ("a", "fr", "x", 50.0), ("b", "en", "y", 1000.0)]
    uses, total = mixing.rake(["a", "b"], cells, {"a": 0.5, "b": 0.5}, {"a": 2, "b": 1})
    assert total == pytest.approx(600) and uses[:2].max() <= 2 + 1e-9
    assert uses[0] * 100 + uses[1] * 50 == pytest.approx(300) and uses[2] * 1000 == pytest.approx(300)


def test_mix(spark, tmp_path):
    docs = [(i, f"word {i} " * (5 + i % 7), "big" if i % 3 else "small", "en" if i % 2 else "fr", "s") for i in range(300)] + [(900, None, "big", None, None), (901, "", "big", "en", "s"), (902, "free", "untargeted", "en", "s")]
    frame(spark, docs, "doc_id bigint, text string, source string, lang string, subject string").write.parquet(f"{tmp_path}/documents.parquet")
    frame(spark, [("big", 0.3, 1), ("small", 0.6, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int").write.parquet(f"{tmp_path}/mix_targets.parquet")
    shares = {r["source"]: r for r in mixing.p8_shares(spark, str(tmp_path)).collect()}
    assert shares["none"]["actual_share"] == 0 and shares["big"]["most_repeats"] <= 1 and shares["small"]["most_repeats"] <= 3
    assert shares["small"]["actual_share"] == pytest.approx(2 / 3, abs=0.01)


def test_mix_of_many_subjects_keeps_its_marginals(spark, tmp_path, monkeypatch):
    docs = [(i, f"word {i} " * 5, "big" if i % 2 else "small", ("en", "fr", "de")[i % 3], f"s{i % 90}") for i in range(2700)]
    frame(spark, docs, "doc_id bigint, text string, source string, lang string, subject string").write.parquet(f"{tmp_path}/documents.parquet")
    frame(spark, [("big", 0.5, 1), ("small", 0.5, 1)], "source string, target_share double, max_repeats int").write.parquet(f"{tmp_path}/mix_targets.parquet")
    monkeypatch.setattr(mixing, "BUCKET", 100)
    mix = mixing.p8_mix(spark, str(tmp_path))
    share = {r["source"]: r["t"] for r in mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("t")).collect()}
    assert share["big"] / sum(share.values()) == pytest.approx(0.5, abs=0.005)
    monkeypatch.setattr(mixing, "CELLS", 60)
    assert mixing.p8_mix(spark, str(tmp_path)).count() > 2000


def test_mix_does_not_depend_on_how_the_cells_are_held(spark, tmp_path, monkeypatch):
    """Every subject is raked, whatever the size a task or the driver is thought to hold."""
    docs = [(i, f"word {i} " * (3 + i % 5), ("big", "mid", "small")[i % 3 if i % 7 else 0], ("en", "fr", "de")[i // 3 % 3], f"s{i * i % 83}") for i in range(2400)]
    frame(spark, docs, "doc_id bigint, text string, source string, lang string, subject string").write.parquet(f"{tmp_path}/documents.parquet")
    frame(spark, [("big", 0.3, 1), ("mid", 0.3, 1), ("small", 0.4, 2)], "source string, target_share double, max_repeats int").write.parquet(f"{tmp_path}/mix_targets.parquet")
    whole = {tuple(r) for r in mixing.p8_mix(spark, str(tmp_path)).collect()}
    by_id = {d[0]: d for d in docs}
    have, got, size = Counter(), Counter(), {r[0]: r[1] for r in encode.tokens(spark.read.parquet(f"{tmp_path}/documents.parquet")).select("doc_id", "tokens").collect()}
    for i, n in size.items():
        have[by_id[i][4]] += n / sum(size.values())
    total = sum(t * c for _, _, t, c in whole)
    for i, _, t, c in whole:
        got[by_id[i][4]] += t * c / total
    assert sum(abs(have[x] - got[x]) for x in have) < 0.12  # a document is about a tenth of a subject
    batch, shuffle = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions"
    before = {x: spark.conf.get(x) for x in (batch, shuffle)}
    try:
        for cells, rows, parts, bucket in ((60, "10000", "4", 50_000), (1, "7", "3", 40)):
            monkeypatch.setattr(mixing, "CELLS", cells)
            monkeypatch.setattr(mixing, "BUCKET", bucket)
            spark.conf.set(batch, rows)
            spark.conf.set(shuffle, parts)
            assert {tuple(r) for r in mixing.p8_mix(spark, str(tmp_path)).collect()} == whole
    finally:
        for x, v in before.items():
            spark.conf.set(x, v)


def test_rake_where_goals_conflict():
    """A subject of one source alone, more than its share: sources hold, nothing exceeds its repeats, the order of cells is no matter."""
    cells = [("a", "en", "x", 700.0), ("a", "en", "y", 300.0), ("b", "fr", "y", 100.0), ("b", "fr", "z", 900.0), ("c", "en", "z", 50.0)]
    shares, repeats = {"a": 0.4, "b": 0.5, "c": 0.1}, {"a": 1, "b": 4, "c": 3}
    uses, total = mixing.rake(["a", "b", "c"], cells, shares, repeats)
    assert total == pytest.approx(1500) and all(0 <= u <= repeats[c[0]] + 1e-9 for u, c in zip(uses, cells, strict=True))
    for source in shares:
        assert sum(u * c[3] for u, c in zip(uses, cells, strict=True) if c[0] == source) == pytest.approx(shares[source] * total)
    assert list(mixing.rake(["a", "b", "c"], cells[::-1], shares, repeats)[0]) == list(uses[::-1])
    # All of b is of a subject of which a alone, used up, has more than its goal.
    uses, total = mixing.rake(["a", "b", "c"], [("a", "en", "x", 1000.0), ("b", "fr", "x", 1000.0), ("c", "fr", "y", 8000.0)], {"a": 0.5, "b": 0.1, "c": 0.4}, {"a": 1, "b": 1, "c": 1})
    assert total == pytest.approx(2000) and list(uses) == pytest.approx([1, 0.2, 0.1])


def test_checkpoints_need_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from tomeflow.llm import common

    empty = SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isEmpty=lambda: True))
    session = SimpleNamespace(sparkContext=SimpleNamespace(_jsc=SimpleNamespace(sc=lambda: empty), master="spark://host:7077"), conf=SimpleNamespace(get=lambda *_: ""))
    with pytest.raises(RuntimeError):
        common.shared_checkpoint(SimpleNamespace(sparkSession=session))


# 9 ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def filter_model():
    return offence.train(["The river delta follows the mountain pass in most laboratories.", "Two groups repeated the work and found the same."] * 20)


def category(model, text):
    scores = model.text(text)
    return {c for c, s in zip(offence.CATEGORIES, scores, strict=True) if s >= offence.CASE}


@pytest.mark.parametrize("text,found", [("You are an idiot and everybody laughs at you.", {"abusive"}), ("Farmers are vermin and should be driven out of the country.", {"hateful"}), ("Watch naked girls on our porn site.", {"sexual"}), ("Shut your mouth, you m*ron.", {"abusive"}), ("Sexual reproduction in plants needs pollen.", set()), ("It was stupid of me to forget the unit.", set()), ("The migrants and the old may vote.", set()), ("", set()), (None, set()), ("x " * 5000, set())])
def test_offence(filter_model, text, found):
    assert category(filter_model, text) == found


def test_offences_of_templates_that_were_held_out():
    recall, precision = offence.held_out()
    assert recall > 0.7 and precision > 0.85


def test_training_sentences_are_not_those_of_the_corpus(sf):
    """No labelled sentence, whatever fills its slots, is a sentence of the documents."""
    import pyarrow.parquet as pq

    text = "\n".join(t for t in pq.read_table(f"{sf}/documents.parquet", columns=["text"])["text"].to_pylist() if t)
    for by in offence.OFFENSIVE.values():
        for ss in by.values():
            for s in ss:
                assert not re.search(r".{1,40}".join(re.escape(x) for x in re.split(r"\{[GI]\}", s)), text), s


def test_swapped_groups_change_no_score(filter_model):
    for frame_ in ("The text tells how {} lived near the river.", "{} are vermin and should be driven out.", "The old law hated {}, and the lesson explains why that was unjust."):
        scores = [filter_model.text(frame_.format(g)) for g in ("women", "migrants", "the disabled", "bakers", "my neighbours")]
        assert all(max(x) - min(x) < 0.2 for x in zip(*scores))


def test_scores_of_tables(spark):
    docs = frame(spark, [(1, "You filthy idiot!"), (2, None)], "doc_id bigint, text string")
    rows = {r["doc_id"]: r["abusive"] for r in offence.scores(docs, offence.train()).collect()}
    by = {r["source"]: r for r in offence.rates(frame(spark, [(1, "You filthy idiot!", "a"), (2, None, "a"), (3, "Fine.", None)], "doc_id bigint, text string, source string"), offence.train()).collect()}
    assert by["a"]["docs"] == 2 and by["a"]["abusive"] == 1 and by["a"]["rate"] == 0.5 and by[None]["rate"] == 0
    assert rows[1] > offence.CASE and rows[2] == 0.0 and offence.scores(docs.limit(0), offence.train()).count() == 0


def test_queries_have_names_and_columns(spark, sf):
    from tomeflow.llm.registry import oracle_sql, queries

    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 9)} | {"p7_ids", "p8_shares"} <= set(queries()) and set(oracle_sql()) <= set(queries())
    assert queries()["p5_found"](spark, sf).columns == ["row_id", "field", "cut"] and F
