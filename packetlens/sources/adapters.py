"""Adapters for PDF parsing and OCR: the only Python on the path, and optional.

Each takes a packet relation (case_id, content) and returns a relation with a
fixed schema by ``mapInPandas``. Where a library is missing the adapter says so
before any job runs. A packet that can't be opened gives no rows, and one of
``unreadable`` with its error. Rows are built by plain functions.
"""

from __future__ import annotations

import importlib.util
import io
import os
import shutil
import subprocess
import tempfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetlens.operators.ocr import distinct_texts

from .packets import read_bytes, runs
from .readers import ERRORS, IMAGES, PAGES, RASTERS, READS, SPANS, VIEWS, WORDS

# Rendering resolutions of the OCR ladder.
OCR_DPI, RAPID_DPI, BOOST_DPI, FORENSIC_DPI = 160, 140, 200, 180


@dataclass(frozen=True)
class View:
    """A part of an image, its edges as shares of width and height (left, top, right, bottom), and what is done to it, in order."""

    box: tuple[float, float, float, float] = (0.0, 0.0, 1.0, 1.0)
    steps: tuple[tuple[str, object], ...] = ()


_GREY, _LEVEL = ("grey", None), ("level", None)
_PAGE, _LOWER, _MIDDLE = (0.0, 0.0, 1.0, 1.0), (0.0, 0.50, 1.0, 1.0), (0.0, 0.25, 1.0, 0.75)
# What the OCR ladder reads besides whole pages: retries of a page, its fee receipt, bands of embedded images.
CONTRAST = View(_PAGE, (_GREY, ("contrast", 1.8)))
CLEAN = View(_PAGE, (_GREY, ("contrast", 1.8), ("median", 3)))
FEE = View((0.02, 0.05, 0.92, 0.58), (("double", "BICUBIC"),))
FEE_LEVEL = View(FEE.box, (*FEE.steps, _GREY, _LEVEL))
HEADER = View((0.0, 0.0, 0.92, 0.58), (_GREY, _LEVEL))
HEADER_LARGE = View(HEADER.box, (*HEADER.steps, ("double", "LANCZOS")))
MID_LARGE = View((0.0, 0.12, 0.92, 0.58), HEADER_LARGE.steps)
# The six views of a forensic read.
FORENSIC = (View(), View(_PAGE, (_GREY, ("contrast", 2.0), ("sharpen", None))), View(_LOWER), View(_LOWER, (_GREY, ("contrast", 2.2))), View(_MIDDLE), View(_MIDDLE, (_GREY, ("contrast", 2.0))))


class AdapterMissing(RuntimeError):
    """A native library or program that an adapter needs isn't installed."""


def _need(module: str | None = None, program: str | None = None) -> None:
    if module and importlib.util.find_spec(module) is None:
        raise AdapterMissing(f"the Python module {module} is not installed")
    if program and shutil.which(program) is None:
        raise AdapterMissing(f"the program {program} is not installed")


def _opened(frame: pd.DataFrame) -> Iterator[tuple[str, object, str | None]]:
    """(case_id, document, None) of each packet, or (case_id, None, error) of one that can't be opened."""
    import fitz

    for case_id, content in zip(frame["case_id"], frame["content"], strict=True):
        try:
            document = fitz.open(stream=bytes(content), filetype="pdf")
        except Exception as error:
            yield case_id, None, f"{type(error).__name__}: {error}"
            continue
        with document:
            yield case_id, document, None


def _mapped(packets: DataFrame, rows_of: Callable[[str, object], Iterable[tuple]], schema: T.StructType) -> DataFrame:
    """The rows of every packet that can be opened; ``unreadable`` names the others."""
    _need("fitz")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [row for case_id, document, _ in _opened(frame) if document is not None for row in rows_of(case_id, document)]
            yield pd.DataFrame(rows, columns=schema.names)

    return packets.select("case_id", "content").mapInPandas(run, schema)


def unreadable(packets: DataFrame) -> DataFrame:
    """(case_id, error) of the packets that can't be opened; the driver gives them the blank record."""
    _need("fitz")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(case_id, error) for case_id, _, error in _opened(frame) if error], columns=ERRORS.names)

    return packets.select("case_id", "content").mapInPandas(run, ERRORS)


def span_rows(case_id: str, number: int, page: dict) -> Iterator[tuple]:
    """Rows of SPANS from a page's nested blocks, lines and spans, in reading order."""
    for order, (text, box, size, color) in enumerate(runs(page)):
        yield (case_id, number, order, text, *box, size, color, "text_layer")


def text_spans(packets: DataFrame) -> DataFrame:
    """Every text run of every page with its geometry; filters stay in Catalyst."""
    return _mapped(packets, lambda case_id, document: (row for i, page in enumerate(document, start=1) for row in span_rows(case_id, i, page.get_text("dict"))), SPANS)


def plain_pages(packets: DataFrame) -> DataFrame:
    """Size and plain text of every page."""
    return _mapped(packets, lambda case_id, document: ((case_id, i, page.rect.width, page.rect.height, page.get_text() or "") for i, page in enumerate(document, start=1)), PAGES)


def _image_rows(case_id: str, document) -> Iterator[tuple]:
    import fitz

    for number, page in enumerate(document, start=1):
        for k, image in enumerate(page.get_images(full=True)):
            try:
                raster = fitz.Pixmap(document, image[0])
                raster = fitz.Pixmap(fitz.csRGB, raster) if raster.n >= 5 else raster
                yield case_id, number, k, raster.width, raster.height, raster.n, raster.tobytes("png")
            except Exception:  # an image that can't be decoded still counts as one
                yield case_id, number, k, None, None, None, None


def page_images(packets: DataFrame) -> DataFrame:
    """Embedded images of every page as PNG, CMYK turned to RGB; a broken image has its place alone."""
    return _mapped(packets, _image_rows, IMAGES)


def _picture(content: bytes):
    from PIL import Image

    return Image.open(io.BytesIO(content)).convert("RGB")


def _seen(picture, view: View):
    """A view of a picture; at least a pixel wide and high."""
    from PIL import Image, ImageEnhance, ImageFilter, ImageOps

    width, height = picture.size
    left, top, right, bottom = view.box
    edges = (int(width * left), int(height * top), max(1, int(width * right)), max(1, int(height * bottom)))
    out = picture if view.box == _PAGE else picture.crop(edges)
    done = {
        "grey": lambda image, _: ImageOps.grayscale(image),
        "level": lambda image, _: ImageOps.autocontrast(image),
        "contrast": lambda image, by: ImageEnhance.Contrast(image).enhance(by),
        "median": lambda image, size: image.filter(ImageFilter.MedianFilter(size=size)),
        "sharpen": lambda image, _: image.filter(ImageFilter.SHARPEN),
        "double": lambda image, how: image.resize((image.width * 2, image.height * 2), Image.Resampling[how]),
    }
    for step, value in view.steps:
        out = done[step](out, value)
    return out


def _view_of(content: bytes, view: View) -> bytes | None:
    """A view as PNG; none if the image can't be decoded."""
    out = io.BytesIO()
    try:
        _seen(_picture(content), view).save(out, format="PNG")
    except Exception:
        return None
    return out.getvalue()


def _numbered(images: DataFrame) -> DataFrame:
    """(case_id, page, img_no, content): drawn pages have no images of their own, so theirs is 0."""
    return images.select("case_id", "page", (F.col("img_no") if "img_no" in images.columns else F.lit(0)).cast("int").alias("img_no"), "content")


def views(images: DataFrame, view: View) -> DataFrame:
    """A view of every image (case_id, page, content; img_no if a page has several) that can be decoded, as PNG."""
    _need("PIL")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            seen = zip(frame["case_id"], frame["page"], frame["img_no"], frame["content"], strict=True)
            yield pd.DataFrame([(case_id, page, k, made) for case_id, page, k, content in seen if content is not None and (made := _view_of(bytes(content), view)) is not None], columns=VIEWS.names)

    return _numbered(images).mapInPandas(run, VIEWS)


def word_rows(case_id: str, page: int, source: str, table: str, image: int = 0) -> Iterator[list[str]]:
    """Rows of WORDS from tab-separated values with a header; missing columns are empty. Blocks of a page's several images keep apart."""
    header, *lines = table.splitlines() or [""]
    names = header.split("\t")
    for line in lines:
        row = dict(zip(names, line.split("\t"), strict=False)) | {"case_id": case_id, "source": source, "page_num": str(page)}
        if image:
            row["block_num"] = f"{image}:{row.get('block_num', '')}"
        yield [row.get(n, "") for n in WORDS.names]


def _read(content: bytes, psm: int, *form: str) -> str:
    """What tesseract writes for an image; empty if it fails."""
    with tempfile.NamedTemporaryFile(suffix=".png") as file:
        file.write(content)
        file.flush()
        done = subprocess.run(["tesseract", file.name, "stdout", "--psm", str(psm), *form], capture_output=True, text=True, check=False, env={**os.environ, "OMP_THREAD_LIMIT": "1"})
    return "" if done.returncode else done.stdout


def ocr_words(images: DataFrame, source: str = "ocr:original", psm: int = 6) -> DataFrame:
    """Words that tesseract reads in images (case_id, page, content; img_no if a page has several), as strings; a failed read gives none."""
    _need(program="tesseract")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            read = zip(frame["case_id"], frame["page"], frame["img_no"], frame["content"], strict=True)
            yield pd.DataFrame([row for case_id, page, k, content in read if content is not None for row in word_rows(case_id, page, source, _read(bytes(content), psm, "tsv"), k)], columns=WORDS.names)

    return _numbered(images).mapInPandas(run, WORDS)


def ocr_texts(images: DataFrame, modes: tuple[int, ...] = (6, 11)) -> DataFrame:
    """Raw text that tesseract reads in each image in each page segmentation mode; empty where a read fails. ``crop`` numbers the modes."""
    _need(program="tesseract")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            read = zip(frame["case_id"], frame["page"], frame["content"], strict=True)
            yield pd.DataFrame([(case_id, page, k, "" if content is None else _read(bytes(content), mode)) for case_id, page, content in read for k, mode in enumerate(modes)], columns=READS.names)

    return images.select("case_id", "page", "content").mapInPandas(run, READS)


def _rendered(content: bytes, page: int, dpi: int) -> bytes | None:
    """One page as PNG, by pdftoppm or else PyMuPDF; none if the page isn't there or can't be drawn."""
    if shutil.which("pdftoppm"):
        with tempfile.TemporaryDirectory() as folder:
            file = Path(folder) / "packet.pdf"
            file.write_bytes(content)
            done = subprocess.run(["pdftoppm", "-png", "-r", str(dpi), "-f", str(page), "-l", str(page), str(file), f"{folder}/page"], capture_output=True, check=False)
            drawn = sorted(Path(folder).glob("page-*.png"))
            return drawn[0].read_bytes() if drawn and not done.returncode else None
    import fitz

    try:
        with fitz.open(stream=content, filetype="pdf") as document:
            return document[page - 1].get_pixmap(dpi=dpi, alpha=False).tobytes("png") if 0 < page <= len(document) else None
    except Exception:
        return None


#: Pages of a packet that one task draws: so many that opening the packet doesn't count.
DRAWN_TOGETHER = 32


def render_pages(packets: DataFrame, pages: DataFrame, dpi: int = OCR_DPI) -> DataFrame:
    """Pages (case_id, page) of packets drawn as PNG at ``dpi``, each once.

    Packets come with their ``content`` or with a ``path``, which tasks then
    read themselves, so that no content is shuffled. A packet of many pages is
    drawn in pieces. To draw pages once for several reads or runs, see ``rasters``.
    """
    if not shutil.which("pdftoppm"):
        _need("fitz")
    by_path = "content" not in packets.columns
    of = "path" if by_path else "content"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for case_id, body, numbers in zip(frame["case_id"], frame[of], frame["pages"], strict=True):
                content = read_bytes(body) if by_path else bytes(body)
                rows += [(case_id, n, dpi, image) for n in sorted(numbers) if (image := _rendered(content, n, dpi)) is not None]
            yield pd.DataFrame(rows, columns=RASTERS.names)

    page = F.col("page").cast("int")
    wanted = pages.where("page is not null").groupBy("case_id", F.floor(page / DRAWN_TOGETHER).alias("piece")).agg(F.collect_set(page).alias("pages"))
    chosen = packets.select("case_id", of).join(wanted, "case_id").select("case_id", of, "pages")
    return (chosen.repartition("case_id", "pages") if by_path else chosen).mapInPandas(run, RASTERS)


@lru_cache(maxsize=1)
def _engine():
    """The neural reader, loaded once a worker."""
    os.environ.setdefault("OMP_THREAD_LIMIT", "1")
    from rapidocr import RapidOCR

    return RapidOCR()


def _said(engine, image: np.ndarray) -> str:
    """What the reader finds in an RGB image; empty if it fails."""
    try:
        result = engine(image)
    except Exception:
        return ""
    return "\n".join(str(t) for t in getattr(result, "txts", None) or () if t)


def _crops(content: bytes, forensic: bool) -> list[np.ndarray]:
    """The whole page in RGB; a forensic read has six views of it."""
    whole = _picture(content)
    return [np.asarray(_seen(whole, view).convert("RGB")) for view in (FORENSIC if forensic else FORENSIC[:1])]


def neural_reads(rasters: DataFrame, forensic: bool = False) -> DataFrame:
    """What the neural reader finds on drawn pages: a row for each page and crop, the text empty where a read fails."""
    _need("rapidocr")
    _need("PIL")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for case_id, page, content in zip(frame["case_id"], frame["page"], frame["content"], strict=True):
                try:
                    crops = _crops(bytes(content), forensic)
                except Exception:
                    crops = []
                rows += [(case_id, page, i, _said(_engine(), crop)) for i, crop in enumerate(crops)]
            yield pd.DataFrame(rows, columns=READS.names)

    return rasters.select("case_id", "page", "content").mapInPandas(run, READS)


def neural_reader(packets: DataFrame, pages: DataFrame, dpi: int = RAPID_DPI, forensic: bool = False, draw: Callable[..., DataFrame] | None = None):
    """A reader of gap filling (case ids in, case_id and text out) that draws and reads ``pages`` of the packets it is asked for.

    ``draw`` takes packets, pages and a resolution (``render_pages``, or a store of drawn pages). The passes use RAPID_DPI, BOOST_DPI, and FORENSIC_DPI with ``forensic``.
    Of the crops of a page each distinct text counts once; pages follow in order.
    """
    _need("rapidocr")
    _need("PIL")

    def read(cases: DataFrame) -> DataFrame:
        own = cases.select("case_id").distinct()
        reads = neural_reads((draw or render_pages)(packets.join(own, "case_id", "left_semi"), pages.join(own, "case_id", "left_semi"), dpi), forensic)
        by_page = distinct_texts(reads, ["case_id", "page"])
        ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
        return by_page.groupBy("case_id").agg(F.array_join(F.transform(ordered, lambda r: r["text"]), "\n").alias("text"))

    return read
