"""Folders of files of many kinds as one table of documents, with a row for each file that fails.

Spark lists and reads the files, so any store it reaches will do; a task parses the bytes of the
files it got. Texts, Markdown, comma-separated values, zipped spreadsheets and word documents
are read here; other kinds take a parser from outside. A sheet or CSV file becomes Markdown
tables of at most ``most_rows`` rows each, so a long one becomes several parts and none is cut.

Defined cases: a file that can't be parsed, or whose kind has no parser, gives one row with its
error and no text; an empty sheet gives no part, an empty file none; columns without values are
left out; an empty cell gets the value above it; each cell of a merged range has the value of
its first one; numbers stand as they are stored.
"""

from __future__ import annotations

import csv
import hashlib
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from typing import NamedTuple
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.files import decoded, read_binary

MOST_ROWS = 200
#: The kinds of files that are looked for; those without a parser give failures.
KINDS = ("txt", "pdf", "docx", "md", "xlsx", "xls", "csv", "png", "jpg", "jpeg", "tiff", "tif", "bmp", "webp")
CSV_ENCODINGS = ("utf-8", "gbk", "gb2312", "utf-8-sig", "latin-1")

SCHEMA = (
    "path string, source string, file_type string, file_size long, doc_hash string, modified_at timestamp, part int, title string, "
    "is_table boolean, headers array<string>, n_rows int, text string, error string"
)


class Part(NamedTuple):
    """A document of a file; ``headers`` and ``n_rows`` are those of a table."""

    text: str
    title: str | None = None
    headers: list[str] | None = None
    n_rows: int | None = None


Parser = Callable[[bytes, int], list[Part]]  # content and most_rows


def _cell(value: str) -> str:
    return " ".join(value.split("\n")).strip().replace("|", "\\|")


def table_parts(rows: list[list[str]], title: str | None, most_rows: int) -> list[Part]:
    """A table whose first row names the columns, as Markdown."""
    wide = max(map(len, rows), default=0)
    rows = [r + [""] * (wide - len(r)) for r in rows]
    body = [r for r in rows[1:] if any(c.strip() for c in r)]
    columns = [k for k in range(wide) if any(r[k].strip() for r in body)]
    if not columns:
        return []
    headers, above = [rows[0][k].strip() or f"Unnamed: {k}" for k in columns], [""] * len(columns)
    filled = []
    for r in body:
        above = [r[k].strip() or a for k, a in zip(columns, above, strict=True)]
        filled.append(above)
    line = lambda cells: f"| {' | '.join(map(_cell, cells))} |"
    head = [line(headers), line(["---"] * len(headers))]
    return [
        Part("\n".join([*head, *map(line, filled[at : at + most_rows])]), title, headers, len(filled[at : at + most_rows]))
        for at in range(0, len(filled), most_rows)
    ]


def parse_text(content: bytes, most_rows: int) -> list[Part]:
    text = decoded(content)
    if text is None:
        raise ValueError("no encoding fits")
    return [Part(text)] if text.strip() else []


def parse_csv(content: bytes, most_rows: int) -> list[Part]:
    text = decoded(content, CSV_ENCODINGS)
    return table_parts([r for r in csv.reader(io.StringIO(text, newline="")) if r], None, most_rows)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _elements(package: zipfile.ZipFile, name: str) -> Iterator[ElementTree.Element]:
    """The elements of a part as they end."""
    with package.open(name) as f:
        for _, element in ElementTree.iterparse(f):
            yield element


def _text_in(element: ElementTree.Element) -> str:
    """The text of an element, without the readings that stand beside characters."""
    if _local(element.tag) == "rPh":
        return ""
    return (element.text or "" if _local(element.tag) == "t" else "") + "".join(map(_text_in, element))


def _place(reference: str) -> tuple[int, int]:
    """(row, column) from 0 of a reference like AB12."""
    letters, digits = re.fullmatch(r"\$?([A-Z]+)\$?([0-9]+)", reference).groups()
    column = 0
    for c in letters:
        column = 26 * column + ord(c) - 64
    return int(digits) - 1, column - 1


def _sheet(package: zipfile.ZipFile, name: str, shared: list[str]) -> list[list[str]]:
    cells: dict[tuple[int, int], str] = {}
    at, merged = (0, -1), []
    for e in _elements(package, name):
        kind = _local(e.tag)
        if kind == "c":
            at = _place(e.get("r")) if e.get("r") else (at[0], at[1] + 1)
            value = next((x.text or "" for x in e if _local(x.tag) == "v"), "")
            if e.get("t") == "s":
                value = shared[int(value)] if value else ""
            elif e.get("t") == "inlineStr":
                value = _text_in(e)
            elif e.get("t") == "b":
                value = "True" if value == "1" else "False"
            elif e.get("t") == "e":
                value = ""
            if value:
                cells[at] = value
        elif kind == "row":
            at = (int(e.get("r", at[0] + 1)), -1)
            e.clear()
        elif kind == "mergeCell":
            merged.append([_place(p) for p in e.get("ref").split(":")])
    for (top, left), (bottom, right) in (m for m in merged if len(m) == 2):
        if (top, left) in cells:
            cells.update({(r, c): cells[top, left] for r in range(top, bottom + 1) for c in range(left, right + 1)})
    rows: dict[int, dict[int, str]] = {}
    for (r, c), value in cells.items():
        rows.setdefault(r, {})[c] = value
    return [[rows[r].get(c, "") for c in range(max(rows[r]) + 1)] for r in sorted(rows)]


def parse_spreadsheet(content: bytes, most_rows: int) -> list[Part]:
    """Each sheet as tables, in the order of the workbook."""
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        names = set(package.namelist())
        shared = [_text_in(e) for e in _elements(package, "xl/sharedStrings.xml") if _local(e.tag) == "si"] if "xl/sharedStrings.xml" in names else []
        targets = {e.get("Id"): e.get("Target") for e in _elements(package, "xl/_rels/workbook.xml.rels") if _local(e.tag) == "Relationship"}
        parts = []
        for e in _elements(package, "xl/workbook.xml"):
            if _local(e.tag) == "sheet":
                target = targets[next(v for k, v in e.attrib.items() if _local(k) == "id" and k != "sheetId")]
                name = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
                parts += table_parts(_sheet(package, name, shared), e.get("name"), most_rows)
        return parts


def parse_word(content: bytes, most_rows: int) -> list[Part]:
    """Paragraphs in order, headings marked by #, tables as Markdown."""
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        body = next(e for e in ElementTree.fromstring(package.read("word/document.xml")).iter() if _local(e.tag) == "body")

    def written(e: ElementTree.Element) -> str:
        kind = _local(e.tag)
        inner = e.text or "" if kind == "t" else "\t" if kind == "tab" else "\n" if kind in ("br", "cr") else "".join(map(written, e))
        return inner

    out = []
    for e in body:
        if _local(e.tag) == "p":
            style = next((v for x in e.iter() if _local(x.tag) == "pStyle" for k, v in x.attrib.items() if _local(k) == "val"), "")
            level = re.fullmatch(r"(?i)heading ?([1-6])", style)
            text = written(e).strip()
            if text:
                out.append(f"{'#' * int(level[1])} {text}" if level else text)
        elif _local(e.tag) == "tbl":
            rows = [[written(c).strip() for c in r if _local(c.tag) == "tc"] for r in e if _local(r.tag) == "tr"]
            out += [p.text for p in table_parts(rows, None, max(1, len(rows)))]
    return [Part("\n\n".join(out))] if out else []


PARSERS: dict[str, Parser] = {"txt": parse_text, "md": parse_text, "csv": parse_csv, "xlsx": parse_spreadsheet, "docx": parse_word}


def parsed(files: DataFrame, more: dict[str, Parser] | None = None, most_rows: int = MOST_ROWS) -> DataFrame:
    """SCHEMA of files (path, content, length, modificationTime), the columns of Spark's binary reader."""
    parsers = {**PARSERS, **(more or {})}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content, size, at in zip(batch["path"], batch["content"], batch["length"], batch["modificationTime"], strict=True):
                name, content = path.rpartition("/")[2], bytes(content)
                kind = name.rpartition(".")[2].lower() if "." in name else ""
                about = [path, name, kind, size, hashlib.md5(content).hexdigest()[:8], at]
                try:
                    if kind not in parsers:
                        raise ValueError(f"no parser for .{kind}")
                    rows = [(*about, k, p.title, p.headers is not None, p.headers, p.n_rows, p.text, None) for k, p in enumerate(parsers[kind](content, most_rows))]
                except Exception as e:  # noqa: BLE001  any broken file is told, none stops the others
                    rows = [(*about, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:500])]
                frame = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
                yield frame.astype({"part": "Int32", "n_rows": "Int32", "is_table": "boolean"})

    return files.select("path", "content", "length", "modificationTime").mapInPandas(run, SCHEMA)


def load_folder(spark: SparkSession, path: str, more: dict[str, Parser] | None = None, most_rows: int = MOST_ROWS) -> DataFrame:
    """All files of KINDS below a folder."""
    endings = ",".join(sorted({*KINDS, *(k.upper() for k in KINDS), *(more or {})}))
    return parsed(read_binary(spark, path, f"*.{{{endings}}}"), more, most_rows)


def documents(loaded: DataFrame) -> DataFrame:
    return loaded.filter("error is null").drop("error")


def failures(loaded: DataFrame) -> DataFrame:
    """(path, error) of the files that gave no document."""
    return loaded.filter("error is not null").select("path", "error")
