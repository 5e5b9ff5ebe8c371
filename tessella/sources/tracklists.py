"""Tracklist spreadsheets (CSV or XLSX, told apart by content) as one table keyed by file name."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.catalog import latest
from tessella.schema import TRACKLIST


def csv_rows(content: bytes) -> list[list[str]]:
    """Rows of a CSV file: UTF-8 with or without a mark, else Latin-1, decided for the whole file."""
    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = content.decode("latin-1")
    return list(csv.reader(io.StringIO(text, newline="")))


def xlsx_rows(content: bytes) -> list[list[str]]:
    """Rows of all worksheets, one after another; empty cells are empty texts."""
    tag = lambda e: e.tag.rpartition("}")[2]
    rows = []
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in item.iter() if tag(t) == "t"))
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        for sheet in sheets:
            for row in (e for e in ElementTree.fromstring(book.read(sheet)).iter() if tag(e) == "row"):
                cells: list[str] = []
                for cell in (c for c in row if tag(c) == "c"):
                    place = 0
                    for letter in re.match(r"[A-Z]*", cell.get("r", ""))[0]:
                        place = place * 26 + ord(letter) - 64
                    cells += [""] * max(0, (place or len(cells) + 1) - 1 - len(cells))
                    value = "".join(t.text or "" for t in cell.iter() if tag(t) in ("v", "t"))
                    cells.append(shared[int(value)] if cell.get("t") == "s" and value else value)
                rows.append(cells)
    return rows


def entries(content: bytes) -> Iterator[tuple[int, str, str, str, str]]:
    """(row, filename, library, supplier, url) below the first row with a cell FILENAME; the last matching header wins."""
    rows = xlsx_rows(content) if content[:2] == b"PK" else csv_rows(content)
    at: dict[str, int] = {}
    for k, row in enumerate(rows):
        cells = [(c or "").strip() for c in row]
        if not at:
            upper = [c.upper() for c in cells]
            if "FILENAME" in upper:
                at = {"FILENAME": upper.index("FILENAME")}
                for name in ("LIBRARY", "SUPPLIER", "URL"):
                    at |= {name: j for j, c in enumerate(upper) if c.startswith(name)}
            continue
        value = lambda name: cells[at[name]] if name in at and at[name] < len(cells) else ""  # noqa: B023, E731
        if value("FILENAME"):
            yield k, value("FILENAME"), value("LIBRARY"), value("SUPPLIER"), value("URL")


def load(spark: SparkSession, root: str) -> DataFrame:
    """All rows of all tracklists under root, with the order of files and rows; names with "catalog" are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    chosen = files.where(name.rlike(r"\.(csv|xlsx|csv\.xls)$") & ~name.contains("catalog")).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for path, content in zip(rows["path"], rows["content"]):
                found = [(path, *e) for e in entries(content)]
                yield pd.DataFrame(found, columns=["file", "row_seq", "filename", "library", "supplier", "url"])

    return chosen.mapInPandas(run, "file string, row_seq int, filename string, library string, supplier string, url string")


def index(rows: DataFrame) -> DataFrame:
    """One row for each lower-case file name: the last file's last row."""
    keyed = rows.withColumn("filename", F.lower("filename"))
    return latest(keyed, ["filename"], ["file", "row_seq"]).select("filename", "library", "supplier", "url")


__all__ = ["TRACKLIST", "csv_rows", "entries", "index", "load", "xlsx_rows"]
