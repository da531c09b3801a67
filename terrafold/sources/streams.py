"""Readers that stream: members of archives, features of GeoJSON documents, elements of GraphML files.

Each is a Python data source: ``register`` makes them known, then
``spark.read.format("zipped_csv").option(...).load(path)``.  A partition is a member of an archive,
or a file; it is read front to back in batches of bounded size, so that a file may
be larger than a worker's memory.  Files are opened through Arrow's file systems, by
path or URI; ``path`` may be a file, a folder or a pattern within one.
"""

from __future__ import annotations

import csv
import fnmatch
import io
import json
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree.ElementTree import iterparse

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from terrafold.session import workers_import

ROWS, CHUNK = 5_000, 1 << 16


@dataclass
class Piece(InputPartition):
    """A file, and which member of it."""

    path: str
    member: str = ""

    def __post_init__(self) -> None:
        super().__init__(f"{self.path}!{self.member}")


def _open(path: str):
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store, at


def _files(path: str) -> list[str]:
    """Files at ``path``: itself, those below a folder, or those that match the pattern in its last part, in order."""
    from pyarrow import fs

    store, at = _open(path)
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    folder, _, last = at.rpartition("/")
    if any(c in last for c in "*?["):
        found = [f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, last)]
    else:
        info = store.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [at] if info.type == fs.FileType.File else [f.path for f in store.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
    return [prefix + f for f in sorted(found)]


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = ROWS, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of text as batches of at most ``size`` rows or some ``most_bytes``, a row at least."""
    held: list[tuple] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= size or weight >= most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.names = dict(options), schema.fieldNames()

    def partitions(self) -> list[Piece]:
        return [Piece(f) for f in _files(self.options["path"])]


class ZippedCsvReader(_Reader):
    """Members of archives that match ``member`` (all .csv by default), every column as text; a column that a member lacks is null."""

    def partitions(self) -> list[Piece]:
        wanted, out = self.options.get("member", "*.csv"), []
        for path in _files(self.options["path"]):
            store, at = _open(path)
            with store.open_input_file(at) as f, zipfile.ZipFile(f) as archive:
                out += [Piece(path, n) for n in archive.namelist() if fnmatch.fnmatch(n.lower(), wanted.lower())]
        return out

    def rows(self, piece: Piece) -> Iterator[tuple]:
        store, at = _open(piece.path)
        with store.open_input_file(at) as f, zipfile.ZipFile(f) as archive, archive.open(piece.member) as raw:
            lines = csv.reader(io.TextIOWrapper(raw, encoding=self.options.get("encoding", "cp932"), newline=""))
            head = [h.strip().lstrip("﻿") for h in next(lines, [])]
            places = [head.index(n) if n in head else None for n in self.names]
            for line in lines:
                if line:
                    yield tuple(line[p] if p is not None and p < len(line) else None for p in places)

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        return _batches(self.rows(piece), pa.schema([(n, pa.string()) for n in self.names]))


class ZippedCsv(DataSource):
    """``option("columns", "a,b")`` names the columns; ``encoding`` (cp932) and ``member`` say how and what is read."""

    @classmethod
    def name(cls) -> str:
        return "zipped_csv"

    def schema(self) -> str:
        return ", ".join(f"`{c.strip()}` string" for c in self.options["columns"].split(","))

    def reader(self, schema: StructType) -> ZippedCsvReader:
        return ZippedCsvReader(self.options, schema)


def json_elements(chunks: Iterator[str], key: str) -> Iterator[object]:
    """The elements of the array ``key`` of the object that the text of ``chunks`` holds, one after the other; what stands beside the array is passed over.

    Only the element at hand is held.
    """
    decoder, text, at, ended = json.JSONDecoder(), "", 0, False

    def more() -> bool:
        nonlocal text, at, ended
        new = next(chunks, None)
        while new == "":
            new = next(chunks, None)
        if new is None:
            ended = True
            return False
        # Twice what is held: an element that many chunks hold is not begun anew for each.
        need = len(text) - at
        parts = [text[at:], new]
        while need > 0 and (new := next(chunks, None)) is not None:
            parts.append(new)
            need -= len(new)
        text, at = "".join(parts), 0
        return True

    def skip() -> str:
        """The next character that is no white space, '' at the end."""
        nonlocal at
        while True:
            while at < len(text) and text[at] in " \t\r\n":
                at += 1
            if at < len(text):
                return text[at]
            if not more():
                return ""

    def value() -> object:
        nonlocal at
        skip()
        while True:
            try:
                found, end = decoder.raw_decode(text, at)
                # A number at the end of what is held may go on.
                if end < len(text) or ended or not isinstance(found, int | float) or isinstance(found, bool):
                    at = end
                    return found
            except json.JSONDecodeError:
                if ended:
                    raise
            if not more() and not ended:
                raise json.JSONDecodeError("unexpected end", text, at)

    def expect(c: str) -> None:
        nonlocal at
        if skip() != c:
            raise json.JSONDecodeError(f"expected {c!r}", text, at)
        at += 1

    expect("{")
    while skip() != "}":
        name = value()
        expect(":")
        if name == key and skip() == "[":
            expect("[")
            while skip() != "]":
                yield value()
                if skip() == ",":
                    at += 1
            expect("]")
        else:
            value()
        if skip() == ",":
            at += 1
        elif skip() == "":
            raise json.JSONDecodeError("unexpected end", text, at)


class FeatureReader(_Reader):
    def rows(self, piece: Piece) -> Iterator[tuple]:
        store, at = _open(piece.path)
        with store.open_input_stream(at) as f:
            text = io.TextIOWrapper(f, encoding="utf-8-sig")
            for place, feature in enumerate(json_elements(iter(lambda: text.read(CHUNK) or None, None), "features")):
                geometry = feature.get("geometry") or {}
                properties = {k: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in (feature.get("properties") or {}).items()}
                yield piece.path, place, geometry.get("type"), json.dumps(geometry["coordinates"]) if "coordinates" in geometry else None, list(properties.items())

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        text = pa.string()
        return _batches(self.rows(piece), pa.schema([("file", text), ("place", pa.int64()), ("type", text), ("coordinates", text), ("properties", pa.map_(text, text))]))


class GeoJsonFeatures(DataSource):
    """(file, place, type, coordinates as JSON, properties) of the features of GeoJSON documents."""

    @classmethod
    def name(cls) -> str:
        return "geojson_features"

    def schema(self) -> str:
        return "file string, place long, type string, coordinates string, properties map<string,string>"

    def reader(self, schema: StructType) -> FeatureReader:
        return FeatureReader(self.options, schema)


class GraphReader(_Reader):
    def rows(self, piece: Piece) -> Iterator[tuple]:
        wanted = self.options.get("element", "node")
        store, at = _open(piece.path)
        with store.open_input_stream(at) as f:
            keys: dict[str, str] = {}
            parents: list = []
            for event, e in iterparse(f, ("start", "end")):
                tag = e.tag.rpartition("}")[2]
                if event == "start":
                    parents.append(e)
                    continue
                parents.pop()
                if tag == "key":
                    keys[e.get("id")] = e.get("attr.name") or e.get("id")
                if tag in ("node", "edge"):
                    if tag == wanted:
                        data = [(keys.get(x.get("key"), x.get("key")), x.text) for x in e if x.tag.rpartition("}")[2] == "data"]
                        yield (e.get("id"), data) if tag == "node" else (e.get("source"), e.get("target"), data)
                    if parents:
                        parents[-1].remove(e)  # what was read is let go

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        data = ("data", pa.map_(pa.string(), pa.string()))
        ends = [("node", pa.string())] if self.options.get("element", "node") == "node" else [("u", pa.string()), ("v", pa.string())]
        return _batches(self.rows(piece), pa.schema([*ends, data]))


class GraphMl(DataSource):
    """Nodes (node, data) or, by ``option("element", "edge")``, edges (u, v, data) of GraphML files; data by the names of its keys."""

    @classmethod
    def name(cls) -> str:
        return "graphml"

    def schema(self) -> str:
        return "node string, data map<string,string>" if self.options.get("element", "node") == "node" else "u string, v string, data map<string,string>"

    def reader(self, schema: StructType) -> GraphReader:
        return GraphReader(self.options, schema)


def register(spark: SparkSession) -> None:
    """Make the formats ``zipped_csv``, ``geojson_features`` and ``graphml`` known to the session."""
    workers_import(spark)
    for source in (ZippedCsv, GeoJsonFeatures, GraphMl):
        spark.dataSource.register(source)
