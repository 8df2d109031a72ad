"""Documents from files: text, Markdown, HTML, JSON, JSON lines, CSV, YAML and DOCX.

Files are read by Spark's ``binaryFile`` source, so that listing, splitting and retries are
Spark's; parsing runs in Arrow batches.  PDF needs a parser that is not installed: such
files give one row with a null text and the error (:mod:`.pages` takes what a parser gives).
So do files of unknown types and those beyond the size limit.  Every text comes with the
metadata that its file states (name, declared keys, headings) and the place at its end, of
which chunking starts.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.structure import State, hierarchy, name_metadata, seeded, sign_of

SUFFIXES = (".txt", ".md", ".markdown", ".json", ".jsonl", ".html", ".htm", ".pdf", ".docx", ".csv", ".yaml", ".yml")
LARGEST = 104_857_600
# Keys of a JSON object that hold a text, and those that are taken over.
TEXT_KEYS = frozenset(("content", "text", "body", "description"))
META_KEYS = ("subject", "grade", "chapter", "lesson", "section", "topic", "language")
_BLOCKS = {"h1", "h2", "h3", "h4", "p", "li"}
_DROPPED = {"script", "style", "noscript"}
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


class _Html(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, list[str]]] = []
        self.open: list[int] = []
        self.dropped = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _DROPPED:
            self.dropped += 1
        elif tag in _BLOCKS:
            if tag in ("p", "li") and self.open and self.blocks[self.open[-1]][0] == tag:
                self.open.pop()  # an unclosed p or li ends where the next begins
            self.blocks.append((tag, []))
            self.open.append(len(self.blocks) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag in _DROPPED:
            self.dropped = max(0, self.dropped - 1)
        elif tag in ("ul", "ol", "div", "body"):  # ends what was left open in it
            while self.open and self.blocks[self.open[-1]][0] in ("li", "p"):
                self.open.pop()
        elif tag in _BLOCKS and any(self.blocks[i][0] == tag for i in self.open):
            while self.blocks[self.open.pop()][0] != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            for i in self.open:  # nested blocks each get the text
                self.blocks[i][1].append(data)


Doc = tuple[str, dict]  # text and metadata


def json_docs(obj: object, path: tuple[str, ...] = ()) -> Iterator[Doc]:
    """A text for every object with text keys: the last six parts of its path and its texts, a line each; declared keys are its metadata."""
    if isinstance(obj, list):
        for n, item in enumerate(obj, 1):
            yield from json_docs(item, (*path, f"Item {n}"))
    if not isinstance(obj, dict):
        return
    texts = {k: v for k, v in obj.items() if str(k).casefold() in TEXT_KEYS}
    body = [t for t in (str(v).strip() for v in texts.values()) if t]
    if body:
        low = {str(k).casefold(): v for k, v in obj.items()}
        yield "\n".join([*path[-6:], *body]), {k: low[k] for k in META_KEYS if k in low and not isinstance(low[k], (dict, list))}
    for k, v in obj.items():
        if k not in texts and isinstance(v, (dict, list)):
            yield from json_docs(v, (*path, str(k)))


def headed_lines(lines: list[tuple[int, str]], seed: dict) -> Doc:
    """Lines (heading level or 0, text) as one text, with the place at its end."""
    state = seeded(seed)
    for level, text in lines:
        if level:
            state = State(text, level, (*state.path[: level - 1], text), state.fields, state.explicit, state.pending)
        state, _ = state.after(sign_of(text))
    return "\n".join(t for _, t in lines), {k: v for k, v in state.metadata().items() if v is not None}


def docx_lines(data: bytes) -> list[tuple[int, str]]:
    """(heading level or 0, text) of the paragraphs."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    out = []
    for p in root.iter(f"{_WORD}p"):
        text = "".join(t.text or "" for t in p.iter(f"{_WORD}t")).strip()
        style = p.find(f"{_WORD}pPr/{_WORD}pStyle")
        name = style.get(f"{_WORD}val", "").casefold() if style is not None else ""
        m = re.search(r"heading\s*(\d+)", name)
        if text:
            out.append((int(m[1]) if m else 1 if "heading" in name else 0, text))
    return out


def html_lines(source: str) -> list[tuple[int, str]]:
    """(heading level or 0, text) of headings, paragraphs and list items in document order."""
    parser = _Html()
    parser.feed(source)
    parser.close()
    found = ((int(tag[1]) if tag[0] == "h" else 0, re.sub(r"\s+", " ", " ".join(p.strip() for p in parts if p.strip())).strip()) for tag, parts in parser.blocks)
    return [(level, t) for level, t in found if t]


def parse(path: str, data: bytes, extra: dict | None = None) -> list[Doc]:
    """(text, metadata) of each document of one file; ``extra`` is metadata that goes with all of them."""
    name = path.rsplit("/", 1)[-1]
    suffix = name[name.rfind(".") :].lower()
    if suffix not in SUFFIXES:
        raise ValueError(f"Unsupported file type: {suffix}")
    base = {"source": name, "source_type": suffix[1:], **name_metadata(name), **{k: v for k, v in (extra or {}).items() if v is not None}}
    if suffix == ".docx":
        docs = [headed_lines(docx_lines(data), base)]
    elif suffix == ".pdf":
        raise NotImplementedError("no PDF parser is installed")
    else:
        text = data.decode("utf-8", "ignore")
        if suffix in (".html", ".htm"):
            docs = [headed_lines(html_lines(text), base)]
        elif suffix == ".csv":
            docs = [("\n".join(" | ".join(row) for row in csv.reader(io.StringIO(text))), {})]
        elif suffix == ".jsonl":
            docs = [d for line in text.splitlines() if line.strip() for d in json_docs(json.loads(line))]
        elif suffix in (".json", ".yaml", ".yml"):
            if suffix == ".json":
                obj = json.loads(text)
            else:
                import yaml

                obj = yaml.safe_load(text)
            docs = list(json_docs(obj)) or [(json.dumps(obj, ensure_ascii=False, indent=2, default=str), {})]
        else:
            docs = [(text, {k: v for k, v in hierarchy(text, base).items() if v is not None})]
    return [(t, base | m) for t, m in docs]


def flat(metadata: dict) -> dict[str, str]:
    """Metadata as a store of plain values takes it: lists joined by ' > ', nulls and private keys left out."""
    return {k: " > ".join(map(str, v)) if isinstance(v, (list, tuple, set)) else str(v) for k, v in metadata.items() if v is not None and not k.startswith("_")}


def load(spark: SparkSession, path: str, extra: dict | None = None) -> DataFrame:
    """(source, source_type, content_hash, doc_idx, text, metadata, error) of the files under ``path``, a folder or one file, in the order of their paths.

    In a folder files of unknown types are passed over; one that is named itself gives an error row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    single = re.search(r"\.[^./]+$", path.rstrip("/")) is not None
    return documents(files, extra, known_only=not single).orderBy("source", "doc_idx")


def documents(files: DataFrame, extra: dict | None = None, known_only: bool = False) -> DataFrame:
    """The same from rows of the binaryFile source, unordered; works on a stream too."""
    if known_only:
        files = files.filter(F.lower(F.regexp_extract("path", r"\.[^./]+$", 0)).isin(*SUFFIXES))
    # The content of larger files is not read, so they have no hash.
    none = F.lit(None).cast("string")
    large = files.filter(F.col("length") > LARGEST).select(
        F.col("path").alias("source"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("source_type"), none.alias("content_hash"), F.lit(0).alias("doc_idx"), none.alias("text"), F.lit(None).cast("map<string,string>").alias("metadata"),
        F.concat(F.lit("ValueError: the file has "), F.col("length").cast("string"), F.lit(f" bytes, more than the {LARGEST} that are read")).alias("error"),
    )
    rows = files.filter(F.col("length") <= LARGEST).select("path", "content", F.sha2("content", 256).alias("content_hash"))
    schema = pa.schema([("source", pa.string()), ("source_type", pa.string()), ("content_hash", pa.string()), ("doc_idx", pa.int32()), ("text", pa.string()), ("metadata", pa.map_(pa.string(), pa.string())), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, content, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name = path.rsplit("/", 1)[-1]
                kind = name[name.rfind(".") + 1 :].lower() if "." in name else ""
                try:
                    out += [(path, kind, key, i, t, sorted(flat(m).items()), None) for i, (t, m) in enumerate(parse(path, content or b"", extra))]
                except Exception as e:  # one bad file must not stop the others
                    out.append((path, kind, key, 0, None, None, f"{type(e).__name__}: {e}"[:300]))
            if out:
                yield pa.RecordBatch.from_pydict({n: [r[k] for r in out] for k, n in enumerate(schema.names)}, schema=schema)

    return rows.mapInArrow(run, "source string, source_type string, content_hash string, doc_idx int, text string, metadata map<string,string>, error string").unionByName(large)
