"""Word manuscripts: paragraphs as rows, and export to a copy.

A manuscript is never written to. Export makes a new file from the source's
parts, without comments and review placeholders, and refuses a path that exists.
"""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Iterator, Mapping
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches

#: Paragraphs in one frame of a task, about.
ROWS = 1000
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_COMMENT_PARTS = re.compile(r"^word/comments[^/]*\.xml$|^word/people\.xml$")
_COMMENT_TAGS = re.compile(rb"<w:(commentRangeStart|commentRangeEnd|commentReference)\b[^>]*/>")
_COMMENT_LINKS = re.compile(rb"<(?:Relationship|Override)\b[^>]*comments[^>]*/>")


def paragraphs(content: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    return ["".join(t.text or "" for t in p.iter(f"{W}t")) for p in body.iter(f"{W}p")]


def composed(lines: list[str]) -> bytes:
    """A manuscript with a paragraph for each line, and a comment on the first."""
    escaped = [x.replace("&", "&amp;").replace("<", "&lt;") for x in lines]
    noted = '<w:commentRangeStart w:id="0"/>'
    body = "".join(f'<w:p>{noted if i == 0 else ""}<w:r><w:t xml:space="preserve">{x}</w:t></w:r></w:p>' for i, x in enumerate(escaped))
    parts = {
        "[Content_Types].xml": '<Types><Override PartName="/word/comments.xml" ContentType="c"/></Types>',
        "word/document.xml": f'<w:document xmlns:w="{W[1:-1]}"><w:body>{body}</w:body></w:document>',
        "word/comments.xml": f'<w:comments xmlns:w="{W[1:-1]}"/>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(zipfile.ZipInfo(name), data)  # with a fixed time, so a second run gives the same bytes
    return out.getvalue()


def compose(files: DataFrame, tasks: int | None = None) -> DataFrame:
    """(rel, content) of manuscripts with the given lines, for files (rel, lines); with `tasks` the files are dealt to so many tasks first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"rel": pdf["rel"], "content": [composed(list(x)) for x in pdf["lines"]]})

    bounded_batches(files.sparkSession)
    asked = files.select("rel", "lines")
    return (asked if tasks is None else asked.repartition(tasks)).mapInPandas(run, "rel string, content binary")


def manuscript_items(files: DataFrame) -> DataFrame:
    """(rel, item_id, text, error) for each paragraph with text of files (rel, content).

    item_id counts from 0 within a manuscript. One that can't be read gives one
    row with an error and no text, so it is not lost and stops no other.
    """

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["rel", "item_id", "text", "error"]).astype({"item_id": "Int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for rel, content in zip(pdf["rel"], pdf["content"], strict=True):
                try:
                    rows += [(rel, i, t, None) for i, t in enumerate(x for x in paragraphs(content) if x.strip())]
                except Exception as e:
                    rows.append((rel, None, None, type(e).__name__))
                if len(rows) >= ROWS:  # making a frame takes longer than reading a manuscript
                    yield frame(rows)
                    rows = []
            if rows:
                yield frame(rows)

    bounded_batches(files.sparkSession)
    return files.select("rel", "content").mapInPandas(run, "rel string, item_id long, text string, error string")


def map_items(items: DataFrame, pattern: str) -> DataFrame:
    """(rel, item_id, expected_subject, column_key) of items whose text has the pattern's two groups."""
    subject, key = (F.trim(F.regexp_extract("text", pattern, k)) for k in (1, 2))
    return items.filter(F.rlike("text", F.lit(pattern))).select("rel", "item_id", subject.alias("expected_subject"), key.alias("column_key"))


def cleaned(content: bytes, fill: Mapping[str, str], placeholder: str = r"\[\[[^\]]*\]\]") -> bytes:
    """The manuscript with `fill` put in, and without comments and placeholders that are left."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for name in z.namelist():
            if _COMMENT_PARTS.match(name):
                continue
            data = z.read(name)
            if name == "word/document.xml":
                text = _COMMENT_TAGS.sub(b"", data).decode("utf-8")
                for mark, value in fill.items():
                    text = text.replace(mark, value.replace("&", "&amp;").replace("<", "&lt;"))
                data = re.sub(placeholder, "", text).encode("utf-8")
            elif name.endswith(".rels") or name == "[Content_Types].xml":
                data = _COMMENT_LINKS.sub(b"", data)
            new.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


def export_copy(content: bytes, path: str, fill: Mapping[str, str]) -> None:
    """Write the cleaned copy to a path that doesn't exist yet."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "xb") as f:
        f.write(cleaned(content, fill))


def export_files(files: DataFrame, root: str) -> DataFrame:
    """(rel, error) for files (rel, content, fill): each is cleaned, filled and written to a new path below root, which all executors mount.

    A path that holds other bytes is refused; the same bytes are a task that ran twice.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for rel, content, fill in zip(pdf["rel"], pdf["content"], pdf["fill"], strict=True):
                path, error = os.path.join(root, rel), None
                try:
                    export_copy(content, path, dict(fill))
                except FileExistsError:
                    with open(path, "rb") as f:
                        error = None if f.read() == cleaned(content, dict(fill)) else "FileExistsError"
                except Exception as e:
                    error = type(e).__name__
                rows.append((rel, error))
            yield pd.DataFrame(rows, columns=["rel", "error"])

    bounded_batches(files.sparkSession)
    return files.select("rel", "content", "fill").mapInPandas(run, "rel string, error string")
