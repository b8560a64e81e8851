"""Spreadsheet files as one long cell table."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

# The namespaces and text kinds of the file format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
TEXT_KINDS = ("s", "inlineStr", "str")
ROWS_PER_BATCH = 20_000


def _ended(book: zipfile.ZipFile, member: str, tag: str) -> Iterator[ElementTree.Element]:
    """Elements of a part by their local name as they end, each emptied after use; none if the part is missing."""
    if member not in book.namelist():
        return
    with book.open(member) as stream:
        for _, node in ElementTree.iterparse(stream):
            if node.tag.rpartition("}")[2] == tag:
                yield node
                node.clear()


def _plain(node: ElementTree.Element) -> str:
    """All text runs below a string item or an inline cell."""
    return "".join(run.text for run in node.iterfind(f".//{MAIN}t") if run.text)


def _part_path(target: str) -> str:
    """Path in the archive of a relation of the workbook: absolute, or relative to the workbook's folder."""
    return posixpath.normpath(posixpath.join("/xl", target)).lstrip("/")


def _sheet_parts(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Sheet names with the path of their part, in workbook order."""
    order = [(node.get("name"), node.get(RELATION + "id")) for node in _ended(book, "xl/workbook.xml", "sheet")]
    paths = {node.get("Id"): _part_path(node.get("Target")) for node in _ended(book, "xl/_rels/workbook.xml.rels", "Relationship")}
    return [(name, paths[key]) for name, key in order if key in paths]


def _cells(content: bytes) -> Iterator[tuple]:
    """(sheet, row, column letters, ctype, value) of every cell that holds a value, row by row.

    A row or a cell without an address follows the one before it, as the format says.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = [_plain(item) for item in _ended(book, "xl/sharedStrings.xml", "si")]
        for name, member in _sheet_parts(book):
            number = 0
            for row in _ended(book, member, "row"):
                number = int(row.get("r") or number + 1)
                column = 0
                for cell in row.iterfind(MAIN + "c"):
                    letters = (cell.get("r") or "").rstrip("0123456789")
                    column = _index(letters) if letters else column + 1
                    kind, held = cell.get("t") or "n", cell.findtext(MAIN + "v")
                    if kind == "inlineStr":
                        held = _plain(cell)
                    elif kind == "s" and held:
                        held = shared[int(held)]
                    if held:
                        yield name, number, column, "s" if kind in TEXT_KINDS else kind, held


def _index(letters: str) -> int:
    """Number of a column: A is 1."""
    number = 0
    for letter in letters.upper():
        number = number * 26 + ord(letter) - ord("A") + 1
    return number


def workbook_cells(workbooks: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Cells of many workbooks: workbook, sheet, row, col, ctype, value.

    ``workbooks`` has one file per row, as the binaryFile source gives it.  Cells stream out in
    batches, so a task holds one file and one batch.  ctype: s text, n number, b boolean, e error.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["workbook", "sheet", "row", "col", "ctype", "value"]
        for batch in batches:
            held: list[tuple] = []
            for name, data in zip(batch[path], batch[content]):
                for cell in _cells(data):
                    held.append((name, *cell))
                    if len(held) >= ROWS_PER_BATCH:
                        yield pd.DataFrame(held, columns=columns)
                        held = []
            yield pd.DataFrame(held, columns=columns)

    return workbooks.select(path, content).mapInPandas(read, "workbook string, sheet string, row bigint, col bigint, ctype string, value string")
