"""Workbooks (XLSX) as rows: the zip container and its sheets' XML, read in tasks a file at a time."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

from ..shipping import ship
from .statements import MOST_COLUMNS, MOST_ROWS

#: Limits of a container: entries, and bytes of all of them once unpacked.
MOST_ENTRIES, MOST_EXPANDED = 10_000, 200 * 1024 * 1024
#: The built-in number formats that are dates or times (ECMA-376, 18.8.30).
DATE_FORMATS = {14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0"}

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
WORKBOOK_ROW = "path string, segment string, line int, end_line int, values array<string>, cell_types array<string>, formats array<string>, formulas map<int,string>, issue string"


def container_issue(content: bytes) -> str | None:
    """Why a zip file is no workbook to read, or None. Sizes are those that the directory states."""
    try:
        entries = zipfile.ZipFile(io.BytesIO(content)).infolist()
    except zipfile.BadZipFile:
        return "CORRUPT_WORKBOOK"
    if len(entries) > MOST_ENTRIES or sum(e.file_size for e in entries) > MOST_EXPANDED:
        return "ARCHIVE_TOO_LARGE"
    return None if any(e.filename == "xl/workbook.xml" for e in entries) else "UNSUPPORTED_ARCHIVE"


def _column(reference: str) -> int:
    number = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        number = number * 26 + ord(letter) - 64
    return number - 1


def _texts(element: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in element.iter(f"{_MAIN}t"))


class Workbook:
    """A workbook's shared parts: strings, number formats, epoch, and where its sheets are."""

    def __init__(self, content: bytes) -> None:
        self.archive = zipfile.ZipFile(io.BytesIO(content))
        names = set(self.archive.namelist())
        part = lambda name: ElementTree.fromstring(self.archive.read(name)) if name in names else None
        strings, styles, book = part("xl/sharedStrings.xml"), part("xl/styles.xml"), part("xl/workbook.xml")
        self.strings = [_texts(s) for s in strings.findall(f"{_MAIN}si")] if strings is not None else []
        own = {int(f.get("numFmtId")): f.get("formatCode") for f in styles.iter(f"{_MAIN}numFmt")} if styles is not None else {}
        formats = styles.find(f"{_MAIN}cellXfs") if styles is not None else None
        self.formats = [(DATE_FORMATS | own).get(int(x.get("numFmtId") or 0), "General") for x in formats] if formats is not None else []
        setting = book.find(f"{_MAIN}workbookPr")
        self.epoch = datetime(1904, 1, 1) if setting is not None and setting.get("date1904") in ("1", "true") else datetime(1899, 12, 30)
        targets = {r.get("Id"): r.get("Target") for r in part("xl/_rels/workbook.xml.rels")}
        place = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
        self.sheets = [(s.get("name"), place(targets[s.get(_RELATION)])) for s in book.iter(f"{_MAIN}sheet")]

    def value(self, cell: ElementTree.Element, style: str) -> tuple[str, str | None]:
        """(type, text) of a cell: n number, s text, d date or time, b truth value, e error."""
        kind, held = cell.get("t", "n"), cell.find(f"{_MAIN}v")
        if kind == "inlineStr":
            return "s", _texts(cell)
        if held is None or held.text is None:
            return "n", None
        if kind == "s":
            return "s", self.strings[int(held.text)]
        if kind in ("str", "b", "e", "d"):
            return {"str": "s"}.get(kind, kind), held.text
        number, plain = float(held.text), re.sub(r'"[^"]*"|\[(?![hs])[^\]]*\]|\\.', "", style.lower())
        if style != "General" and re.search("[ydhs]|m{1,5}", plain) and "#" not in plain and "0.0" not in plain:
            timed = re.search("[hs]", plain)
            if 0 <= number < 1 and timed and "y" not in plain and "d" not in plain:
                return "d", str(timedelta(seconds=round(number * 86400))).rjust(8, "0")
            at = self.epoch + timedelta(seconds=round(number * 86400))
            return "d", at.isoformat(sep=" ") if timed else at.date().isoformat()
        return "n", str(int(number)) if number == int(number) and abs(number) < 1e15 else held.text

    def rows(self, place: str) -> Iterator[tuple[int, list, list, list, dict]]:
        """(line, values, types, formats, formulas) of a sheet's rows, one at a time; lines count from 1."""
        expected = 1
        with self.archive.open(place) as stream:
            for _, row in ElementTree.iterparse(stream):
                if row.tag != f"{_MAIN}row":
                    continue
                line = int(row.get("r") or expected)
                for missing in range(expected, min(line, expected + MOST_ROWS)):
                    yield missing, [], [], [], {}
                values, types, formats, formulas = [], [], [], {}
                for cell in row.findall(f"{_MAIN}c"):
                    at = _column(cell.get("r")) if cell.get("r") else len(values)
                    while len(values) < at <= MOST_COLUMNS:
                        values.append(None), types.append("n"), formats.append("General")
                    style = int(cell.get("s") or 0)
                    style = self.formats[style] if style < len(self.formats) else "General"
                    kind, text = self.value(cell, style)
                    formula = cell.find(f"{_MAIN}f")
                    if formula is not None:
                        formulas[at] = "=" + (formula.text or "")
                    values.append(text), types.append(kind), formats.append(style)
                yield line, values, types, formats, formulas
                expected = line + 1
                row.clear()


def workbook_rows(files: DataFrame) -> DataFrame:
    """WORKBOOK_ROW for each row of each sheet of the files (path, content); a file that cannot be read
    gives one row with its issue. The limits are those of statement files; a sheet is read row by row."""
    ship(files.sparkSession)
    columns = [f.split()[0] for f in WORKBOOK_ROW.split(", ")]

    def read(path: str, content: bytes) -> list[tuple]:
        issue = container_issue(content)
        if issue:
            return [(path, None, 0, 0, [], [], [], {}, issue)]
        out: list[tuple] = []
        try:
            book = Workbook(content)
            for name, place in book.sheets:
                for line, values, types, formats, formulas in book.rows(place):
                    if len(out) >= MOST_ROWS or len(values) > MOST_COLUMNS:
                        return [(path, None, 0, 0, [], [], [], {}, "TABLE_TOO_LARGE")]
                    out.append((path, name, line, line, values, types, formats, formulas, None))
        except (ElementTree.ParseError, KeyError, ValueError, AttributeError, TypeError, zipfile.BadZipFile):
            return [(path, None, 0, 0, [], [], [], {}, "DOCUMENT_UNREADABLE")]
        return out or [(path, None, 0, 0, [], [], [], {}, "NO_TRANSACTIONS")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                found = read(path, bytes(content))
                for at in range(0, len(found), 10_000):
                    yield pd.DataFrame(found[at : at + 10_000], columns=columns)

    return files.select("path", "content").mapInPandas(run, WORKBOOK_ROW)
