"""Sources that Spark has no reader for: event files of scalars, and sheets of xlsx workbooks."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _varint(buf: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = buf[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value, at


def _fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message; fixed-width values as bytes."""
    at = 0
    while at < len(buf):
        tag, at = _varint(buf, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(buf, at)
        else:
            if kind == 2:
                size, at = _varint(buf, at)
            else:
                size = {1: 8, 5: 4}[kind]
            value, at = buf[at : at + size], at + size
        yield tag >> 3, value


def _tensor(buf: bytes) -> float | None:
    for number, value in _fields(buf):
        if number in (4, 5) and len(value) == 4:
            return struct.unpack("<f", value)[0]
        if number in (4, 6) and len(value) == 8:
            return struct.unpack("<d", value)[0]
    return None


def event_scalars(raw: bytes) -> Iterator[tuple[str, int, float, float]]:
    """(tag, step, wall_time, value) of an event file; a record cut off at the end is left out."""
    at = 0
    while at + 12 <= len(raw):
        size = struct.unpack_from("<Q", raw, at)[0]
        record = raw[at + 12 : at + 12 + size]
        at += 16 + size
        if len(record) < size:
            return
        step, wall, values = 0, 0.0, []
        for number, value in _fields(record):
            if number == 1:
                wall = struct.unpack("<d", value)[0]
            elif number == 2:
                step = value
            elif number == 5:
                values += [v for n, v in _fields(value) if n == 1]
        for entry in values:
            tag, x = None, None
            for number, value in _fields(entry):
                if number == 1:
                    tag = value.decode("utf-8", "replace")
                elif number == 2:
                    x = struct.unpack("<f", value)[0]
                elif number == 8:
                    x = _tensor(value)
            if tag is not None and x is not None:
                yield tag, step, wall, x


def scalars(spark: SparkSession, root: str, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """SRC-17: (run, tag, step, wall_time, value) of all event files below a folder; a run is the folder below it.

    Tags count that hold one of ``include``, if there is any, and none of ``exclude``. Each file is read in one task.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "events.out.tfevents.*").load(root)
    run = F.regexp_replace(F.regexp_replace("path", r"/[^/]*$", ""), rf"^.*?{re.escape(root.rstrip('/').split(':')[-1].lstrip('/'))}/?", "")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, raw in zip(pdf["run"], pdf["content"]):
                rows = [(name, *s) for s in event_scalars(bytes(raw))]
                yield pd.DataFrame(rows, columns=["run", "tag", "step", "wall_time", "value"])

    out = files.select(run.alias("run"), "content").mapInPandas(read, "run string, tag string, step long, wall_time double, value double")
    if include:
        out = out.filter(" or ".join(f"contains(tag, '{x}')" for x in include))
    for x in exclude:
        out = out.filter(~F.contains("tag", F.lit(x)))
    return out


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _texts(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def workbook_rows(raw: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row number from 1, cells as text) of every row of a workbook that has a value."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        shared = [_texts(si) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        for sheet in book.iter(f"{_MAIN}sheet"):
            target = links[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))].lstrip("/")
            for row in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_MAIN}row"):
                cells: dict[int, str] = {}
                for cell in row.iter(f"{_MAIN}c"):
                    kind, v = cell.get("t"), cell.find(f"{_MAIN}v")
                    text = _texts(cell) if kind == "inlineStr" else None if v is None or v.text is None else shared[int(v.text)] if kind == "s" else v.text
                    if text:
                        cells[_column(cell.get("r", "")) if cell.get("r") else len(cells)] = text
                if cells:
                    yield sheet.get("name"), int(row.get("r", 0)), [cells.get(i) for i in range(max(cells) + 1)]


def workbooks(spark: SparkSession, path: str) -> DataFrame:
    """SRC-14: (file, sheet, row_no, cells) of all sheets of xlsx workbooks, rows without any value left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, raw in zip(pdf["path"], pdf["content"]):
                yield pd.DataFrame([(name, *r) for r in workbook_rows(bytes(raw))], columns=["file", "sheet", "row_no", "cells"])

    return files.select("path", "content").mapInPandas(read, "file string, sheet string, row_no long, cells array<string>")
