import io
import json
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from tomeflow.functions import text as T
from tomeflow.operators import answers, bookmeta, catalog, embedding, search, toc
from tomeflow.operators.chunking import chunk, legacy_chunk, merged, placed, sentences
from tomeflow.operators.structure import State, anchor_of, clean, heading_of, hierarchy, label_of, lettered_heading, name_metadata, numbered_heading, split_path, structure_lines, unit_of
from tomeflow.plans import registry
from tomeflow.sources import loaders
from tomeflow.sources import pages as boxes
from tomeflow.sources.loaders import flat, html_lines, json_docs, load, parse
from tomeflow.streaming import ingest as ingestion
from tomeflow.streaming.ingest import ingest_new_files


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("text,lang", [("hello", "en"), ("مرحبا بالعالم", "ar"), ("مرحبا hello world", "mixed"), ("12", "unknown"), (None, "unknown"), ("", "unknown")])
def test_detect_language(spark, text, lang):
    assert one(spark, T.detect_language, text) == lang


@pytest.mark.parametrize("token,stem", [("networks", "network"), ("learning", "learn"), ("المعلومات", "معلوم"), ("classes", "class"), ("as", "as")])
def test_stem(spark, token, stem):
    assert one(spark, T.stem, token) == stem


def test_tokens_with_and_without_repair(spark):
    df = spark.createDataFrame([("الßمل",), ("Gäßchen",)], "x string")
    on, off = [[r[0] for r in df.select(T.lex_tokens(F.col("x"), repair)).collect()] for repair in (True, False)]
    whole = spark.createDataFrame([("الرمل",)], "x string").select(T.lex_tokens(F.col("x"), False)).first()[0]
    assert on[0] == whole and len(whole) == 1 and off[0] != whole
    assert off[1] == ["chen"] and on[1] != off[1]  # why the repair is not for Latin texts
    by_row = [r[0] for r in df.select(T.lex_tokens(F.col("x"))).collect()]
    assert by_row == [on[0], off[1]]


def test_tokens_of_nothing(spark):
    assert one(spark, T.core_tokens, None) == []
    assert one(spark, T.core_tokens, "") == []
    assert one(spark, lambda c: T.lex_tokens(c, False), "The network, the networks!") == ["network", "network"]


@pytest.mark.parametrize("text,kind", [("أجب عن السؤال", "exercise"), ("مثال: كذا", "example"), ("تعريف القوة", "definition"), ("نص عادي", "paragraph"), ("a | b | c", "table"), (None, "paragraph")])
def test_content_type(spark, text, kind):
    assert one(spark, T.content_type, text) == kind


def test_normalized():
    assert T.normalized("ﬁne.\n\n\n\nx ‎ y") == "fine.\n\nx y"
    assert T.normalized(None) == ""


def test_headings():
    assert heading_of("## 1.2 Motion") == (2, "1.2 Motion", True)
    assert numbered_heading("1.2.3 Classification") == (3, "Classification") and heading_of("1-1 Forces") == (2, "Forces", True)
    assert lettered_heading("أ. البيانات والمعلومات") == (2, "البيانات والمعلومات") and heading_of("أ. البيانات والمعلومات")[2] is False
    for line in ("(1) an item", "2026 - 2025", "2 Is this a heading?", "1) term: what it means", "12", "", "3 " + "x" * 200, "1 A sentence that goes on for more than fifty characters ends so."):
        assert numbered_heading(line) is None
    assert label_of("Chapter: Motion") == ("chapter", "Motion") and label_of("plain line") is None and label_of("الوحدة الدراسية: الحركة") == ("chapter", "الحركة")
    assert clean(" none ") is None and clean("[ a  b ]:") == "a b" and split_path("a > b > ") == ["a", "b"] and split_path(None) == []
    assert name_metadata("x/Physics_lang_ar_grade_10.pdf") == {"language": "ar", "grade": "10"} and name_metadata("Physics.pdf") == {}


def test_hierarchy():
    h = hierarchy("Chapter: Modern Physics\nالوحدة الثانية: شيء آخر")
    assert h["chapter"] == "Modern Physics" and h["heading"] == "شيء آخر" and h["heading_path"] == ["شيء آخر"]
    h = hierarchy("1. Machine Learning\n1.1 Supervised Learning\n1.1.1 Classification")
    assert (h["chapter"], h["lesson"], h["section"], h["topic"]) == ("Machine Learning", "Supervised Learning", "Classification", None)
    assert hierarchy("Unit One: Forces")["chapter"] == "Chapter 1" and hierarchy("الوحدة الأولى\nنص")["heading"] == "الوحدة الأولى"
    h = hierarchy("Chapter: Motion\n1 Another chapter\n1-4\nThe lesson's title")
    assert h["chapter"] == "Motion" and h["lesson"] == "The lesson's title" and h["heading_path"] == ["Another chapter", "The lesson's title"]
    assert hierarchy("أ. البيانات والمعلومات", {"lesson": "x", "grade": "N/A"})["lesson"] == "x" and hierarchy(None)["heading"] is None
    contents = toc.Contents.of(["Table of Contents\nUnit 1: Biology Basics .......... 3\nPhotosynthesis .......... 4\n"])
    h = hierarchy("1 Photosynthesis\nsome body text", contents=contents)
    assert (h["heading"], h["lesson"], h["chapter"]) == ("Photosynthesis", "Photosynthesis", None)
    contents = toc.Contents.of(["الفهرس\nالوحدة الأولى .......... 7\nما هي المعلومات ؟ .......... 7\n"])
    assert hierarchy("الوحدة الأولى\nما هي المعلومات ؟\nنص عادي", contents=contents)["lesson"] == "ما هي المعلومات ؟"
    assert hierarchy("Chapter: Unit One", contents=toc.Contents.of(["Contents\nUnit Two .... 10"]))["chapter"] == "Unit One"


def test_tables_of_contents(spark):
    page = "الفهرس\nمقدمة ..... 3\nالوحدة الأولى .......... 7\nما هي المعلومات ؟ ...... 7\nالوحدة الثانية ........ 16\n"
    assert [(e.title, e.level, e.page) for e in toc.entries_of(page)] == [("مقدمة", None, 3), ("الوحدة الأولى", 1, 7), ("ما هي المعلومات ؟", 2, 7), ("الوحدة الثانية", 1, 16)]
    assert toc.entry_of("7    الوحدة الأولى") == ("الوحدة الأولى", 7) and toc.entry_of("نص عادي") is None and toc.entry_of("") is None
    assert toc.is_title("Table of Contents") and toc.is_title(" | الفهرس:") and not toc.is_title("الوحدة الأولى")
    assert toc.section_of(["غلاف", page, "Title 1 2\nMore 3", "body text"]) == page + "\nTitle 1 2\nMore 3" and toc.section_of(["x", None]) is None
    assert toc.similarity("الوحدة الأولى", "الوحدة  الاولى") > 0.85 and toc.similarity("Unit One: Information", "Information - Unit One") > 0.7 and toc.similarity("الوحدة الأولى", "الوحدة الثانية") < 0.85
    index = toc.Contents.of([page])
    assert index.match("الوحدة الاولى")[0].title == "الوحدة الأولى" and index.level_of("عنوان غير موجود في الفهرس") is None and toc.Contents.of(["a", "b"]) is None
    pages = spark.createDataFrame([("b", 0, "غلاف"), ("b", 1, page), ("b", 2, "Title 1 2\nMore 3"), ("b", 3, "body text"), ("b", 4, "Late 5\nLater 6"), ("c", 0, None), (None, 0, page)], "book string, at int, text string")
    found = toc.toc_pages(pages)
    assert sorted(r["at"] for r in found.collect()) == [1, 2]
    rows = [(r["title"], r["level"], r["page"]) for r in toc.toc_entries(found).orderBy("entry_no").collect()]
    assert rows[:4] == [(e.title, e.level, e.page) for e in toc.entries_of(page)] and rows[4:] == [("Title 1", 2, 2), ("More", 2, 3)]
    entries = spark.createDataFrame([("b", 0, "الوحدة الأولى", 1, 7), ("b", 1, "ما هي المعلومات ؟", 2, 7), ("b", 1, "ما هي المعلومات ؟", 2, 7), ("c", 0, "Motion", 1, 1), ("c", 1, None, 1, 1)], "book string, pos int, title string, level int, page int")
    heads = spark.createDataFrame([("b", "الوحدة الاولى"), ("b", "ما هى المعلومات"), ("b", "شيء"), ("c", "MOTION"), ("d", "Motion"), ("b", None)], "book string, heading string")
    got = {(r["book"], r["heading"]): (r["title"], r["level"], r["score"]) for r in toc.toc_match(heads, entries).collect()}
    assert got == {("b", "الوحدة الاولى"): ("الوحدة الأولى", 1, 1.0), ("b", "ما هى المعلومات"): ("ما هي المعلومات ؟", 2, 0.92), ("c", "MOTION"): ("Motion", 1, 1.0)}


@pytest.mark.parametrize(
    "text,name,want",
    [("Physics Textbook\nSubject: Physics\nGrade: 12\nTerm: 1\n", "book.pdf", {"subject": "Physics", "grade": "12", "term": "1"}), ("# البرمجة والذكاء الاصطناعي مقدمة في تكنولوجيا المعلومات والاتصالات للصف الأول الثانوي 2025 - 2026 Image", "ICT_Ar_Sec1_T1.pdf", {"document_title": "البرمجة والذكاء الاصطناعي", "subject": "تكنولوجيا المعلومات والاتصالات", "grade": "الأول", "term": "1"}),
     ("Introduction to Information and Communication Technology For First Year of Secondary School", "i.pdf", {"subject": "Information and Communication Technology", "grade": "First"}), ("Student Book\nComputer Science - Grade 7\nUnit 1", "cs.pdf", {"subject": "Computer Science"}), ("Introduction to Chemistry for Secondary First\nFirst Term\nUnit 1", "c.pdf", {"term": "First", "grade": "First"}),
     ("الفصل الأول: مقدمة في البرمجة", "book.pdf", {"term": None}), ("مقدمة في تكنولوجيا المعلومات واالتصاالت للصف األول الثانوي", "ICT_Ar_Sec1_T1.pdf", {"grade": "الأول", "text_quality_warning": "arabic_font_ligature_corruption"}), ("random parser noise", "ICT_Ar_Sec1_T1.pdf", {"subject": "ICT", "term": "1", "grade": None}), ("random parser noise", "Math_Extra_Ar_Sec1_T1.pdf", {"subject": None}), (None, "my_book.pdf", {"document_title": "my book", "language": "en"})],
)
def test_metadata_of_books(text, name, want):
    got = bookmeta.metadata_of(text, name, None if text is None else "x")
    assert {k: got[k] for k in want if k != "language" or text} == {k: v for k, v in want.items() if k != "language" or text}


def test_letterheads_overrides_and_models():
    m = bookmeta.metadata_of("MINISTRY OF EDUCATION AND TECHNICAL EDUCATION\nGPS للطبع والنشر والتوزيع\nIntroduction to Mathematics for Grade 10\nAll rights reserved\n", "math.pdf")
    assert m["subject"] == "Mathematics" and m["document_title"] == "math" and m["sources"]["language"] == "document_text"
    m = bookmeta.metadata_of("a. b.", "x.pdf", overrides={"grade": 9, "subject": "none"}, fallback=lambda _: {"subject": "Optics", "evidence": {"subject": "optics lab"}})
    assert (m["grade"], m["subject"], m["sources"]["subject"], m["confidence"]["grade"]) == ("9", "x", "filename", 0.98)
    assert bookmeta.identity_of(m, " own ") == "own" and bookmeta.identity_of(m, None, "f") == bookmeta.identity_of({}, "", "f") != bookmeta.identity_of(m)


def test_structure_lines(spark):
    pages = spark.createDataFrame([("1", "Unit 2: Waves\nplain text\n1.2 Light\n2.3\nShade"), ("2", None), ("3", "")], "doc_id string, text string")
    rows = structure_lines(pages).orderBy("line_no").collect()
    assert [(r["line_no"], r["kind"], r["title"], r["heading"]) for r in rows] == [(1, "unit", "Waves", "Waves"), (3, "heading", "Light", "Light"), (4, "anchor", "2.3", "Light"), (5, "title", "Shade", "Shade")]


def test_sentences_and_merge():
    text = "One two three. " * 40
    parts = sentences(text, 100, 20)
    assert all(len(p) <= 100 for p in parts) and " ".join(parts).split() == text.split()
    assert [len(p) for p in sentences("x" * 250, 100, 20)] == [100, 100, 90]
    assert merged(["a" * 50, "b", "c" * 50], 10) == ["a" * 50 + "\nb", "c" * 50]


def test_chunk(spark):
    df = spark.createDataFrame([("d", "Chapter: Motion\n# Speed\nSpeed tells how far a thing goes in a time.\n\n# Force\nA force changes the motion of a thing."), ("e", None), ("f", " ")], "doc_id string, text string")
    rows = chunk(df).orderBy("idx").collect()
    assert [r["heading"] for r in rows] == ["Speed", "Force"] and {r["doc_id"] for r in rows} == {"d"}
    assert rows[0]["chapter"] == "Motion" and rows[0]["heading_path"] == ["Speed"] and rows[0]["parent_content_type"] == "paragraph"
    assert legacy_chunk(df).count() == 2
    assert chunk(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chunk(df, child_size=50, overlap=50)


def test_chunks_keep_the_place_of_the_pages_before(spark):
    pages = [
        ("1", "Unit 3: Motion\n# Speed\nSpeed tells how far a thing goes in a time.", "b", 0, 1), ("2", "This page goes on about how far things go.", "b", 1, 2), ("3", "## Force\nA force changes the motion of a thing.", "b", 2, 3),
        ("4", "## Force\nA force changes the motion of a thing.", "b", 2, 4), ("5", None, "b", 3, 5), ("6", "The force goes on on this page, too.\n1-4", "b", 4, 6), ("7", "Light and shade\nLight falls on a wall of the house.", "b", 5, 7),
        ("8", "This page follows the title of a lesson.", "b", 6, 8), ("9", "This page is of another book, without a place.", "c", 0, 9), ("10", "This page is of no book at all.", None, 0, 10),
    ]
    df = spark.createDataFrame(pages, "doc_id string, text string, book string, at int, copy bigint")
    got = {r["doc_id"]: r for r in chunk(placed(df)).collect()}
    assert got["2"]["heading"] == "Speed" and got["2"]["heading_path"] == ["Speed"] and got["2"]["chapter"] == "Speed"
    assert got["3"]["heading_path"] == got["4"]["heading_path"] == got["6"]["heading_path"][:2] == ["Speed", "Force"] and got["6"]["lesson"] == "Force"
    assert got["8"]["heading_path"] == ["Speed", "Light and shade"] and got["8"]["lesson"] == "Light and shade"
    assert got["9"]["heading"] is None and got["10"]["heading"] is None and len(got) == 9
    assert unit_of("الوحدة الدراسية الثانية عشرة") == ("الوحدة الدراسية الثانية عشرة", "Chapter 12") and unit_of("Unit One") == ("Unit One", "Chapter 1") and unit_of("Unitary 3") is None
    assert anchor_of("1-4") == 2 and anchor_of("48") is None
    assert State().take("Unit 3: Motion") == (State("Motion", 1, ("Motion",), {"chapter": "Chapter 3"}), True)


def docx(paragraphs):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' for style, t in paragraphs)
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return data.getvalue()


def test_loaders(spark, tmp_path):
    (tmp_path / "a_grade_7.txt").write_text("plain text\n1. Motion", "utf-8")
    (tmp_path / "b.html").write_text("<h1>T</h1><script>x</script><ul><li>one<li>two</ul><p>end</p>", "utf-8")
    (tmp_path / "c.json").write_text(json.dumps({"unit": [{"text": "first", "Subject": "Physics"}, {"body": "second", "content": "third", "text": {"a": 1}}]}), "utf-8")
    (tmp_path / "d.jsonl").write_text('{"text": "x"}\n\n{"text": "y"}\n', "utf-8")
    (tmp_path / "e.csv").write_text("a,b\n1,2\n", "utf-8")
    (tmp_path / "f.pdf").write_bytes(b"%PDF")
    (tmp_path / "g.exe").write_bytes(b"no")
    (tmp_path / "h.docx").write_bytes(docx([("Heading1", "Head"), ("Normal", "Body"), ("Heading2", "Sub")]))
    every = load(spark, str(tmp_path)).collect()
    rows = {(r["source"].rsplit("/", 1)[1], r["doc_idx"]): r for r in every}
    assert [r["source"] for r in every] == sorted(r["source"] for r in every)
    a = rows[("a_grade_7.txt", 0)]
    assert a["text"] == "plain text\n1. Motion" and a["metadata"] == {"source": "a_grade_7.txt", "source_type": "txt", "grade": "7", "chapter": "Motion", "heading": "Motion", "heading_level": "1", "heading_path": "Motion"}
    assert rows[("b.html", 0)]["text"] == "T\none\ntwo\nend" and rows[("b.html", 0)]["metadata"]["heading"] == "T"
    assert rows[("c.json", 0)]["text"] == "unit\nItem 1\nfirst" and rows[("c.json", 0)]["metadata"]["subject"] == "Physics"
    assert rows[("c.json", 1)]["text"] == "unit\nItem 2\nsecond\nthird\n{'a': 1}"
    assert rows[("d.jsonl", 1)]["text"] == "y" and rows[("e.csv", 0)]["text"] == "a | b\n1 | 2"
    assert rows[("f.pdf", 0)]["text"] is None and "PDF" in rows[("f.pdf", 0)]["error"]
    assert rows[("h.docx", 0)]["text"] == "Head\nBody\nSub" and rows[("h.docx", 0)]["metadata"]["heading_path"] == "Head > Sub"
    assert not any(k[0] == "g.exe" for k in rows)
    assert "Unsupported" in load(spark, str(tmp_path / "g.exe")).first()["error"] and load(spark, str(tmp_path / "e.csv"), {"grade": "3"}).first()["metadata"]["grade"] == "3"
    assert html_lines("") == [] and list(json_docs({"a": 1})) == [] and parse("x.yaml", b"text: hi")[0][0] == "hi" and flat({"_x": 1, "a": None, "b": [1, 2]}) == {"b": "1 > 2"}


def test_files_beyond_the_limit_give_an_error_row(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(loaders, "LARGEST", 20)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "small.txt").write_text("x" * 20, "utf-8")
    (tmp_path / "in" / "large.TXT").write_text("x" * 21, "utf-8")
    (tmp_path / "in" / "large.exe").write_text("x" * 21, "utf-8")
    rows = {r["source"].rsplit("/", 1)[1]: r for r in load(spark, str(tmp_path / "in")).collect()}
    assert set(rows) == {"small.txt", "large.TXT"} and rows["small.txt"]["error"] is None
    assert rows["large.TXT"]["text"] is None and rows["large.TXT"]["source_type"] == "txt" and "21 bytes" in rows["large.TXT"]["error"]
    ingest_new_files(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "cp"))
    assert {r["source"].rsplit("/", 1)[1] for r in spark.read.parquet(f"{tmp_path}/store/errors").collect()} == {"large.TXT", "large.exe"}
    assert spark.read.parquet(f"{tmp_path}/store/registry").count() == 1


def test_streaming_ingest(spark, tmp_path):
    inbox, store, checkpoint = (str(tmp_path / x) for x in ("in", "store", "check"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("Subject: Physics\nA long enough text about **water** and stones.", "utf-8")
    ingest_new_files(spark, inbox, store, checkpoint)
    (tmp_path / "in/b.txt").write_text("Subject: Physics\nA long enough text about **water** and stones.", "utf-8")
    (tmp_path / "in/c.txt").write_text("Another text that is about the wind and the sea.", "utf-8")
    ingest_new_files(spark, inbox, store, checkpoint)
    assert ingestion.registry(spark, store).count() == 2
    assert spark.read.parquet(f"{store}/chunks").count() == 2 and spark.read.parquet(f"{store}/parents").count() == 2 and spark.read.parquet(f"{store}/questions").count() >= 2
    assert {r["file_name"]: r["status"] for r in ingestion.jobs(spark, store).collect()} == {"a.txt": "completed", "b.txt": "duplicate_skipped", "c.txt": "completed"}
    assert spark.read.parquet(f"{store}/chunks").filter("subject = 'Physics'").count() == 1


def test_batch_ingest_force_stale_and_forget(spark, tmp_path):
    import shutil

    store = str(tmp_path / "store")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("A long enough text about water and stones.", "utf-8")
    (tmp_path / "in/bad.json").write_text("{", "utf-8")
    s = ingestion.ingest(spark, str(tmp_path / "in"), store, 1).first()
    assert (s["files"], s["chunks"], s["language_counts"]) == (1, 1, {"en": 1}) and s["subject"] == 100.0  # the name of the file
    first = ingestion.registry(spark, store).first()
    assert ingestion.ingest(spark, str(tmp_path / "in"), store, 2).first()["chunks"] == 0
    assert ingestion.ingest(spark, str(tmp_path / "in"), store, 3, force=True).first()["chunks"] == 1
    for n in (1, 3):
        shutil.rmtree(f"{store}/chunks/batch={n}")
    assert ingestion.stale(spark, store).count() == 1
    assert ingestion.ingest(spark, str(tmp_path / "in"), store, 4).first()["chunks"] == 1
    assert ingestion.registry(spark, store).first()["file_reference_id"] == first["file_reference_id"] and ingestion.stale(spark, store).count() == 0
    ingestion.forget(spark, store, ingestion.registry(spark, store), 5)
    assert ingestion.registry(spark, store).count() == 0 and ingestion.ingest(spark, str(tmp_path / "in"), store, 6).first()["chunks"] == 1
    assert {r["status"] for r in ingestion.jobs(spark, store).collect()} == {"completed", "failed"}


def test_page_boxes(spark):
    ddl = "book string, page int, text string, font_size double, bold boolean, y0 double, x0 double, width double"
    two = [("b", 1, f"col{c}-{i}", 10.0, False, i * 15.0, x, 600.0) for c, x in ((1, 20.0), (2, 320.0)) for i in range(6)]
    one = [("b", 2, t, size, size > 20, y, x, 600.0) for t, size, y, x in (("Body one", 10.0, 130.0, 50.0), ("Title", 30.0, 50.0, 100.0), ("Subtitle", 14.0, 90.0, 100.0), ("LOGO", 8.0, 40.0, 500.0), ("Body two", 10.0, 150.0, 50.0), ("Body three", 10.0, 170.0, 50.0))]
    lines = spark.createDataFrame([*two[::-1], *one, ("b", 3, "\x07", 1.0, False, 0.0, 0.0, 600.0)], ddl)
    got = {r["at"]: r for r in boxes.page_texts(lines).collect()}
    assert got[1]["text"].split("\n") == [f"col{c}-{i}" for c in (1, 2) for i in range(6)]
    assert got[2]["text"].split("\n") == ["LOGO", "Title", "Subtitle", "Body one", "Body two", "Body three"] and got[2]["median_size"] == 10.0 and got[2]["styled"] == ["Title", "Subtitle"] and 3 not in got
    assert boxes.cover_text(lines, 1).first()["text"] == got[1]["text"] and boxes.page_texts(lines.limit(0)).count() == 0
    parsed = spark.createDataFrame([("b", None, "", "# Head", 1), ("b", 7, "text", None, 2), ("b", None, " ", None, 3)], "book string, page int, text string, markdown string, idx int")
    cloud = boxes.parsed_pages(parsed)
    assert sorted((r["at"], r["text"]) for r in cloud.collect()) == [(1, "# Head"), (7, "text")]
    local = spark.createDataFrame([("b", 1, "x"), ("c", 1, "y")], "book string, at int, text string")
    assert sorted(r["text"] for r in boxes.preferred_pages(cloud, local).collect()) == ["# Head", "text", "y"]


def test_filters_and_isolation(spark):
    df = spark.createDataFrame([(1, "a", None, True), (2, "a", 5, False), (3, None, 5, None)], "id int, s string, n int, b boolean")
    cols = {c: F.col(c) for c in df.columns}
    ids = lambda c: sorted(r["id"] for r in df.filter(c).collect())
    assert ids(search.matches({"s": "a", "n": None}, cols)) == [1, 2] and ids(search.matches({"n": "5"}, cols)) == [2, 3] and ids(search.matches({"n": "None"}, cols)) == [1] and ids(search.matches({"b": True}, cols)) == [1] and ids(search.matches({"x": "None"}, cols)) == [1, 2, 3]
    assert ids(search.matches_typed({"n": 5}, cols)) == [2, 3] and ids(search.matches_typed({"x": 1}, cols)) == [] and ids(search.matches_typed({}, cols)) == [1, 2, 3]
    with pytest.raises(ValueError):
        search.isolated(spark.createDataFrame([(1,)], "query_id int"))
    q = spark.createDataFrame([(1, "x", ["river"]), (2, "y", ["river"]), (3, "z", ["river"]), (4, None, ["river"])], "query_id bigint, book string, tokens array<string>")
    c = spark.createDataFrame([(1, "x", ["river", "stone"]), (2, "y", ["river", "river"]), (3, "y", ["stone"]), (4, None, ["river"])], "id bigint, book string, tokens array<string>")
    assert {(r["query_id"], r["id"]) for r in search.bm25(q, c, 5).collect()} == {(1, 1), (2, 2)}
    assert search.bm25(q.limit(0), c, 5).count() == 0 and search.bm25(q, c.limit(0), 5).count() == 0


def test_fallback_and_retry(spark):
    ddl = "query_id bigint, rank int, confidence double, id bigint"
    narrow = spark.createDataFrame([(1, 1, 0.9, 1), (2, 1, 0.2, 2), (3, 1, 0.2, 3)], ddl)
    wide = spark.createDataFrame([(1, 1, 0.95, 10), (2, 1, 0.8, 20), (3, 1, 0.1, 30), (4, 1, 0.3, 40), (4, 2, 0.2, 41)], ddl)
    assert sorted((r["query_id"], r["id"]) for r in search.better_of(narrow, wide, 0.25).collect()) == [(1, 1), (2, 20), (3, 3), (4, 40), (4, 41)]


def test_retrieve_takes_reranked_scores(spark):
    q = spark.createDataFrame([(1, ["river"])], "query_id bigint, tokens array<string>")
    chunks = spark.createDataFrame([(1, "b", 1, "river stone", None, "paragraph", "p"), (2, "b", 1, "river stone", None, "paragraph", "p"), (3, "b", 2, "river sand", "river", "table", None)], "id bigint, book string, page int, text string, heading string, content_type string, parent_id string")
    parents = spark.createDataFrame([("p", "the whole river")], "parent_id string, parent_text string")
    near = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.2), (1, 3, 0.9)], "query_id bigint, id bigint, distance double")
    none = near.limit(0)
    words = spark.createDataFrame([(1, 3, 4.0)], "query_id bigint, id bigint, score double")
    rows = search.retrieve(q, chunks, parents, (near, none, words), 5).orderBy("rank").collect()
    assert [r["id"] for r in rows] == [1, 3] and rows[0]["context"] == "the whole river" and rows[0]["context_expanded"] and not rows[1]["context_expanded"] and rows[1]["channels"] == ["dense", "keyword"]
    scores = embedding.rerank(spark.createDataFrame([(1, 1, "q", "a"), (1, 3, "q", "b")], "query_id bigint, id bigint, query string, text string"), lambda pairs: [0.01 if t == "a" else 2.0 for _, t in pairs])
    again = search.retrieve(q, chunks, parents, (near, none, words), 5, scores).orderBy("rank").collect()
    assert [r["id"] for r in again] == [3, 1] and again[0]["reranker"] == 0.98
    failed = embedding.rerank(spark.createDataFrame([(1, 1, "q", "a")], "query_id bigint, id bigint, query string, text string"), lambda pairs: 1 / 0).first()
    assert failed["reranker"] is None and "ZeroDivision" in failed["error"]


def test_embedding(spark):
    import numpy as np

    a = embedding.hash_vectors(["x", "y", "x", ""])
    assert a.shape == (4, 384) and np.allclose(np.linalg.norm(a, axis=1), 1) and np.array_equal(a[0], a[2]) and not np.array_equal(a[0], a[1])
    assert embedding.ordered_unit([{"index": 1, "embedding": [0, 4]}, {"index": 0, "embedding": [3, 0]}], 2).tolist() == [[1, 0], [0, 1]]
    assert embedding.ordered_scores([{"index": 1, "relevance_score": 0.9}, {"index": 0, "relevance_score": 0.2}], 3) == [0.2, 0.9, None]
    for bad in ([], [{"index": 0}], [{"index": 0, "embedding": []}]):
        with pytest.raises(ValueError):
            embedding.ordered_unit(bad, 1)
    df = spark.createDataFrame([(1, "x", "old"), (2, None, "old")], "id bigint, t string, vector string")
    rows = {r["id"]: r["vector"] for r in embedding.encode(df, "t").collect()}
    assert rows[2] is None and len(rows[1]) == 384 and embedding.encode(df.limit(0), "t").count() == 0
    assert len(embedding.encode(df, "t", lambda ts: np.ones((len(ts), 2))).first()["vector"]) == 2


def test_inverted_file_covers_every_row(spark):
    rows = [(i, [float(i % 7), float(i % 5), 1.0 + i % 3]) for i in range(90)] + [(99, None)]
    c = spark.createDataFrame(rows, "id bigint, vector array<double>")
    q = c.filter("id % 10 = 0").withColumnRenamed("id", "query_id")
    centers = embedding.centroids(c.filter("vector IS NOT NULL"), 6)
    indexed = embedding.nearest_cells(c, centers)
    assert indexed.count() == 90
    exact = {(r["query_id"], r["rank"]): round(r["distance"], 9) for r in search.knn(q, c, 4).collect()}
    assert {(r["query_id"], r["rank"]): round(r["distance"], 9) for r in embedding.knn_indexed(q, indexed, centers, 4, 6).collect()} == exact


def test_answers(spark):
    assert answers.structured('```json\n{"status": "answered", "answer": "Yes 【Evidence 1†L2】 ."}\n```') == ("Yes.", "answered")
    assert answers.structured('{"answer": ""}') == ("", "insufficient_evidence") and answers.structured("no json") is None and answers.structured('{"a": 1}') is None and answers.structured(None) is None
    assert answers.without_citations("So it is [Evidence 2], as (source 3) says.") == "So it is, as says."
    asked = spark.createDataFrame([(1, "What is a river?", "c", "A river is water.", 0.1), (2, "What is a star?", "c", "A river is water.", 0.1), (3, "What is a star?", "c", "A river is water.", 0.5), (4, None, None, None, None), (5, "x", "c", " ", 0.9)], "query_id bigint, query string, context string, evidence string, reranker double")
    got = {r["query_id"]: (r["status"], r["answer"].startswith(answers.FROM_LESSON)) for r in answers.generated(asked).collect()}
    assert got == {1: ("answered", True), 2: ("insufficient_evidence", False), 3: ("answered", True), 4: ("insufficient_evidence", False), 5: ("insufficient_evidence", False)}
    provider = lambda q, c, h: '{"status": "answered", "answer": "told"}' if q.startswith("What") else 1 / 0
    rows = {r["query_id"]: (r["answer"], r["self_reported"]) for r in answers.generated(asked, (lambda *_: 1 / 0, provider)).collect()}
    assert rows[1] == ("told", True) and rows[5][1] is False
    state, grounded = answers.grounding(F.col("s"), F.col("m"), F.col("r"), F.col("c"))
    df = spark.createDataFrame([("answered", True, 0.0, 0.0), ("answered", False, 0.3, 0.3), ("answered", False, 0.2, 0.9), ("insufficient_evidence", False, 0.9, 0.9), (None, None, 0.1, 0.1)], "s string, m boolean, r double, c double")
    assert [tuple(r) for r in df.select(state, grounded).collect()] == [("answered", True), ("answered", True), ("grounding_failed", False), ("insufficient_evidence", False), ("insufficient_evidence", False)]
    shown = spark.createDataFrame([(" a  b ",), ("مثلث",), ("= 5 cm",), ("",), (None,)], "x string").select(answers.clean_source(F.col("x"))).collect()
    assert [r[0] for r in shown] == ["a b", None, None, None, None]


def test_context_blocks(spark):
    r = spark.createDataFrame([(1, 1, "s", 3, None, "text"), (1, 2, None, None, "h", None)], "query_id bigint, rank bigint, source string, page int, heading string, t string")
    b = r.select("query_id", "rank", search.evidence_block(F.col("rank"), F.col("source"), F.col("page"), F.col("heading"), F.col("t")).alias("text"))
    assert search.build_context(b).first()["context"] == "[Evidence 1]\nSource: s\nPage: 3\nSection: None\nText: text\n\n[Evidence 2]\nSource: None\nPage: None\nSection: h\nText: "


def test_follow_up_puts_the_current_question_first(spark):
    rows = [(1, "s", 1, "What is the wave length of light?", "It is short."), (2, "s", 2, " and it? ", "x" * 400), (3, "s", 3, "A new question about several other things", None), (4, "s", 4, None, None)]
    t = spark.createDataFrame(rows, "turn_key bigint, session_id string, turn int, query string, answer string")
    got = {r["turn_key"]: (r["expanded"], r["is_follow_up"]) for r in catalog.follow_up(t).collect()}
    assert got[1] == ("What is the wave length of light?", False) and got[2] == ("and it?\nWhat is the wave length of light?\nIt is short.", True)
    assert got[3][1] is False and got[4] == ("A new question about several other things", True)
    placed_ = t.withColumn("chapter", F.lit("Light")).withColumn("lesson", F.lit("")).filter("turn_key = 1")
    assert catalog.follow_up(placed_).first()["expanded"].endswith("\nسياق الدرس: Light")


def test_windows_of_large_books_in_ranges(spark):
    rows = [(i, b, p) for i, (b, p) in enumerate([("x", 1), ("x", 1), ("x", 5), ("x", 250), ("x", 999), ("y", 400), (None, 3), (None, 700)])]
    df = spark.createDataFrame(rows, "id bigint, b string, p int")
    got = {r["id"]: r["previous"] for r in catalog.previous(df, "b", "p", "id").collect()}
    assert got == {0: None, 1: 1, 2: 1, 3: 5, 4: 250, 5: None, 6: None, 7: 3} and catalog.previous(df.limit(0), "b", "p", "id").count() == 0
    seen = {r["id"]: r["seen"] for r in catalog.seen_before(df, "b", [F.col("p"), F.col("id")], F.col("p") > 200).collect()}
    assert seen == {0: False, 1: False, 2: False, 3: True, 4: True, 5: True, 6: False, 7: True}


def test_sessions(spark):
    s = spark.createDataFrame([("a", "f1", "c", "v1", "2024-01-01 10:00:00"), ("b", "f2", "c", "v1", "2024-01-01 10:30:00"), ("c", "f3", "c", "v1", "2024-01-01 08:00:00")], "session_id string, file_reference_id string, curriculum_id string, version string, at string").withColumn("seen", F.col("at").cast("timestamp"))
    now = F.lit("2024-01-01 11:00:00").cast("timestamp")
    kept = lambda **k: sorted(r["session_id"] for r in catalog.swept(s, "seen", now, **k).collect())
    assert kept() == ["a", "b"] and kept(most=1) == ["b"] and kept(ttl=1800) == ["b"]
    t = spark.createDataFrame([(i, "a", i, f"q{i}", f"a{i}", None) for i in range(1, 9)], "turn_key bigint, session_id string, turn int, query string, answer string, recorded_at timestamp")
    state = {r["session_id"]: r["turns"] for r in catalog.session_state(s, t).collect()}
    assert [x["user"] for x in state["a"]] == ["q3", "q4", "q5", "q6", "q7", "q8"] and state["b"] is None
    asks = spark.createDataFrame([(1, "a", None), (2, "a", "f9"), (3, None, "f5"), (4, "zz", None)], "id int, session_id string, file_reference_id string")
    assert {(r["id"], r["file_reference_id"]) for r in catalog.resolved_requests(asks, s).collect()} == {(1, "f1"), (3, "f5")} and [r["id"] for r in catalog.bound_elsewhere(asks, s).collect()] == [2]
    new = spark.createDataFrame([(20, "a", 2), (21, "a", 1), (22, "b", 1)], "turn_key bigint, session_id string, ts int")
    more = {r["turn_key"]: r["turn"] for r in catalog.append_turns(t.withColumn("ts", F.lit(0)), new).collect()}
    assert (more[21], more[20], more[22]) == (9, 10, 1)
    whole = catalog.conversation(s, t, "a").first()
    assert [x["turn"] for x in whole["turns"]] == list(range(1, 9)) and catalog.conversation(s, t, "zz").count() == 0
    chunks = spark.createDataFrame([("short",), ("  a text of  more than\ntwenty characters ",), (None,)], "raw_text string")
    assert [r["raw_text"] for r in catalog.valid_chunks(chunks).collect()] == ["a text of more than twenty characters"]


def test_knn_blocks(spark, monkeypatch):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)]
    c = spark.createDataFrame(rows, "id bigint, vector array<double>")
    q = c.filter("id % 10 = 0").withColumnRenamed("id", "query_id")
    whole = {tuple(r) for r in search.knn(q, c, 3).select("query_id", "id", "rank").collect()}
    monkeypatch.setattr(search, "QUERY_BLOCK", 2)
    assert {tuple(r) for r in search.knn(q, c, 3).select("query_id", "id", "rank").collect()} == whole


def test_channel_merge_and_budget(spark):
    d = spark.createDataFrame([(1, 1, 0.2)], "query_id bigint, id bigint, distance double")
    k = spark.createDataFrame([(1, 1, 4.0), (1, 2, 1.0)], "query_id bigint, id bigint, score double")
    rows = {r["id"]: r for r in search.merge_channels(d, d.limit(0), k).collect()}
    assert rows[1]["distance"] == 0.2 and rows[1]["keyword_match"] and rows[1]["keyword_score"] == 4.0
    assert rows[2]["distance"] == 0.5 and not rows[2]["question_match"]
    r = spark.createDataFrame([(1, 1, "a" * 600), (1, 2, "b" * 600), (1, 3, "c")], "query_id bigint, rank bigint, text string")
    assert sorted(tuple(x) for x in search.context_budget(r, 900).collect()) == [(1, 1, 600), (1, 2, 300)]


def test_calibration(spark):
    a, b = search.calibrated(F.lit(0.75), F.lit(None).cast("double"), F.lit(1.0))
    r = spark.range(1).select(a.alias("a"), b.alias("b")).first()
    assert abs(r["a"] - 0.98) < 1e-9 and abs(r["b"] - 0.98) < 1e-9


def test_sessions_keep_an_exact_gap(spark):
    e = spark.sql("SELECT 1 AS u, ts FROM VALUES (TIMESTAMP '2024-01-01 00:00:00'), (TIMESTAMP '2024-01-01 01:00:00'), (TIMESTAMP '2024-01-01 02:00:01') AS x(ts)")
    assert sorted(r["events"] for r in catalog.sessions_by_gap(e, "u", "ts").collect()) == [1, 2]


def test_empty_tables(spark):
    e = spark.createDataFrame([], "chunk_id string, ingested_at timestamp, v int")
    assert catalog.latest_per_key(e, "chunk_id", F.col("ingested_at")).count() == 0
    assert catalog.coverage(e, {"v": F.col("v").isNotNull()}).first()["v"] == 0.0


@pytest.mark.parametrize("name", ["language_counts", "bm25_topk", "knn_by_label", "subject_tree", "structure_tree", "followup_query", "sessions_ttl", "context_budget", "retrieve", "eval_metrics", "question_index", "toc_parse", "scoped_chunks", "session_histories"])
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "rag_chunks", "turns", "books", "events", "embeddings", "sessions", "toc_entries", "text_chunks"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = registry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    text = lambda v: str(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else str([str(x) for x in v]) if isinstance(v, (list, tuple)) else f"{v:.6f}" if isinstance(v, float) else str(v)
    got = sorted(tuple(text(r[c]) for c in cols) for r in df.collect())
    rel = con.sql(registry.oracle_sql()[name])
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(tuple(text(r[i]) for i in at) for r in rel.fetchall())
