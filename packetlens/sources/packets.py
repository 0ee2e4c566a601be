"""A packet source: a folder of packets as one relation of parts, read page range by page range.

The driver lists files and their lengths, nothing more. Small packets share a
split; a large one is cut into page ranges, each a split of its own, so a packet
of thousands of pages is many tasks. A split opens its packet once and yields
everything asked for in one pass: a row for the packet (with its digest and
number of pages), for each page, text run and image, and for each failure.

What isn't asked for isn't made: parts that a filter on ``kind`` leaves out are
skipped, and images are decoded only if the schema has ``content``.
"""

from __future__ import annotations

import hashlib
import importlib
import re
from collections.abc import Iterable, Iterator
from contextlib import closing
from dataclasses import dataclass

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .readers import schema_of

PACKET, PAGE, SPAN, IMAGE, ERROR = "packet", "page", "span", "image", "error"
KINDS = (PACKET, PAGE, SPAN, IMAGE, ERROR)
PARTS = schema_of(
    "kind string, case_id string, path string, sha256 string, page int, ord long, text string, x0 double, y0 double, x1 double, y1 double, size double, color int, source string, "
    "width double, height double, channels int, content binary"
)

#: Bytes of packets that a split reads; a longer packet is cut into as many page ranges.
SPLIT_BYTES = 4_000_000


def place(path: str) -> tuple[fs.FileSystem, str]:
    """A file system and the path in it, of a URI or a local path."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def read_bytes(path: str) -> bytes:
    system, at = place(path)
    with system.open_input_stream(at) as stream:
        return stream.read()


class PdfPacket:
    """A PDF file by PyMuPDF. Any class with these methods can stand in its place (option ``parser``)."""

    def __init__(self, content: bytes):
        import fitz

        self._document = fitz.open(stream=content, filetype="pdf")

    def __len__(self) -> int:
        return len(self._document)

    def close(self) -> None:
        self._document.close()

    def page(self, number: int) -> tuple[float, float, str]:
        """Width, height and plain text of a page; pages count from 1."""
        page = self._document[number - 1]
        return page.rect.width, page.rect.height, page.get_text() or ""

    def spans(self, number: int) -> Iterator[tuple]:
        """(text, (x0, y0, x1, y1), size, color) of each text run in reading order."""
        return runs(self._document[number - 1].get_text("dict"))

    def images(self, number: int, decode: bool) -> Iterator[tuple]:
        """(width, height, channels, PNG) of each embedded image, CMYK turned to RGB; all null if it is broken. Without ``decode`` its stated size alone."""
        import fitz

        for image in self._document[number - 1].get_images(full=True):
            if not decode:
                yield image[2], image[3], None, None
                continue
            try:
                raster = fitz.Pixmap(self._document, image[0])
                raster = fitz.Pixmap(fitz.csRGB, raster) if raster.n >= 5 else raster
                yield raster.width, raster.height, raster.n, raster.tobytes("png")
            except Exception:  # an image that can't be decoded still counts as one
                yield None, None, None, None


def runs(page: dict) -> Iterator[tuple]:
    """Text runs of a page's nested blocks, lines and spans."""
    for block in page.get("blocks", ()):
        for line in block.get("lines", ()):
            for span in line.get("spans", ()):
                yield span["text"], tuple(map(float, span["bbox"])), float(span["size"]), int(span["color"])


def parser_of(name: str):
    """A class by its name ``module:class``."""
    module, _, what = name.partition(":")
    return getattr(importlib.import_module(module), what)


@dataclass
class Split(InputPartition):
    """(path, part, of how many) of each piece: part k of m holds the pages from n * k // m up to n * (k + 1) // m."""

    pieces: list[tuple[str, int, int]]


def splits(files: Iterable[tuple[str, int]], size: int) -> list[list[tuple[str, int, int]]]:
    """Files (path, length) dealt into splits of about ``size`` bytes."""
    out: list[list[tuple[str, int, int]]] = []
    held, bytes_ = [], 0
    for path, length in files:
        parts = max(1, -(-length // size))
        if parts > 1:
            out += [[(path, k, parts)] for k in range(parts)]
            continue
        if held and bytes_ + length > size:
            out.append(held)
            held, bytes_ = [], 0
        held.append((path, 0, 1))
        bytes_ += length
    return out + [held] * bool(held)


class PacketReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema = schema
        self.folder, self.suffix = options["path"], options.get("suffix", ".pdf")
        self.size = int(options.get("splitBytes", SPLIT_BYTES))
        self.parser = options.get("parser", f"{__name__}:PdfPacket")
        self.kinds = set(KINDS)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keeps filters on ``kind``; Spark applies the others."""
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if wanted is not None and f.attribute == ("kind",):
                self.kinds &= wanted
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, at = place(self.folder)
        found = system.get_file_info(fs.FileSelector(at, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith(self.suffix))
        scheme = re.match(r"[a-z0-9]+://[^/]*", self.folder)  # paths of a store lose their scheme in the listing
        head = "" if isinstance(system, fs.LocalFileSystem) or not scheme else scheme[0].rsplit("://", 1)[0] + "://"
        dealt = splits(((head + path, length) for path, length in files), self.size)
        return [Split(pieces) for pieces in dealt or [[]]]

    def read(self, partition: Split) -> Iterator[tuple]:
        names = self.schema.names
        for path, part, parts in partition.pieces:
            for row in parts_of(path, part, parts, parser_of(self.parser), self.kinds, "content" in names, self.suffix):
                yield tuple(row.get(n) for n in names)


def parts_of(path: str, part: int, parts: int, parser, kinds: set[str], decode: bool, suffix: str = ".pdf") -> Iterator[dict]:
    """The rows of a piece of a packet. What can't be opened or read gives a row of its error."""
    own = {"case_id": path.rsplit("/", 1)[1].removesuffix(suffix), "path": path}
    failed = lambda error, **more: {**own, "kind": ERROR, "text": f"{type(error).__name__}: {error}", **more}
    try:
        content = read_bytes(path)
        document = parser(content)
    except Exception as error:
        if part == 0 and ERROR in kinds:
            yield failed(error)
        return
    with closing(document):
        n = len(document)
        if part == 0 and PACKET in kinds:
            yield {**own, "kind": PACKET, "sha256": hashlib.sha256(content).hexdigest(), "ord": n}
        for number in range(n * part // parts + 1, n * (part + 1) // parts + 1):
            try:
                yield from _page(document, own, number, kinds, decode)
            except Exception as error:
                if ERROR in kinds:
                    yield failed(error, page=number)


def _page(document, own: dict, number: int, kinds: set[str], decode: bool) -> Iterator[dict]:
    own = {**own, "page": number}
    if PAGE in kinds:
        width, height, text = document.page(number)
        yield {**own, "kind": PAGE, "width": width, "height": height, "text": text}
    if SPAN in kinds:
        for order, (text, (x0, y0, x1, y1), size, color) in enumerate(document.spans(number)):
            yield {**own, "kind": SPAN, "ord": order, "text": text, "x0": x0, "y0": y0, "x1": x1, "y1": y1, "size": size, "color": color, "source": "text_layer"}
    if IMAGE in kinds:
        for order, (width, height, channels, png) in enumerate(document.images(number, decode)):
            size = [None if x is None else float(x) for x in (width, height)]
            yield {**own, "kind": IMAGE, "ord": order, "width": size[0], "height": size[1], "channels": channels, "content": png}


class PacketSource(DataSource):
    """``spark.read.format("packets").load(folder)``: the parts of all packets of a folder.

    Options: ``suffix`` of the files, ``splitBytes``, ``parser`` (module:class).
    A schema of fewer columns prunes: without ``content`` no image is decoded.
    """

    @classmethod
    def name(cls) -> str:
        return "packets"

    def schema(self) -> T.StructType:
        return PARTS

    def reader(self, schema: T.StructType) -> PacketReader:
        return PacketReader(schema, self.options)


def parts(spark: SparkSession, folder: str, columns: Iterable[str] | None = None, **options) -> DataFrame:
    """The parts of a folder's packets; ``columns`` prunes at the source."""
    spark.dataSource.register(PacketSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    schema = PARTS if columns is None else T.StructType([PARTS[c] for c in columns])
    return spark.read.format("packets").schema(schema).options(**options).load(folder)


def relation(parts: DataFrame, kind: str) -> DataFrame:
    """One relation of the parts, with the columns that the engine gives it."""
    rows = parts.where(parts["kind"] == kind)
    return rows.selectExpr(
        *{
            PACKET: ("case_id", "path", "sha256", "cast(ord AS int) AS n_pages"),
            PAGE: ("case_id", "page", "width", "height", "text"),
            SPAN: ("case_id", "page", "ord", "text", "x0", "y0", "x1", "y1", "size", "color", "source"),
            IMAGE: ("case_id", "page", "cast(ord AS int) AS img_no", "cast(width AS int) AS width", "cast(height AS int) AS height", "channels", "content"),
            ERROR: ("case_id", "page", "text AS error"),
        }[kind]
    )
