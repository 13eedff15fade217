"""Pixels: filling boxes, the ink guard, a PNG and PDF writer from the standard library, and the seams that models fill."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P

#: A page image: rows of RGB (or grey) bytes.
PIXELS = "width int, height int, channels int, data binary"
_SEAMS: dict[str, Callable] = {}


def plug(name: str, function: Callable) -> None:
    """Gives a seam its model: 'ocr', 'unwarp', 'rasterize', 'decode_codes', 'decode_linear', 'outline_codes', 'jpeg' or 'person'."""
    _SEAMS[name] = function


def seam(name: str) -> Callable:
    """The function plugged in; fails loudly without one, rather than passing pages through unread."""
    if name not in _SEAMS:
        raise RuntimeError(f"no {name!r} is plugged in")
    return _SEAMS[name]


def apply_model(pages: DataFrame, name: str, schema: str) -> DataFrame:
    """Runs a plugged-in model over pages in Arrow batches; it is built once in each Python worker, when the first batch comes."""
    build = seam(name)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for b in batches:
            model = model or build()
            yield model(b)

    return pages.mapInPandas(run, schema)


def enlarged(pages: DataFrame, factor: int) -> DataFrame:
    """Pages with every pixel repeated `factor` times in both directions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["data"] = [_array(d, w, h, c).repeat(factor, 0).repeat(factor, 1).tobytes() for d, w, h, c in zip(b["data"], b["width"], b["height"], b["channels"], strict=True)]
            yield b.assign(width=b["width"] * factor, height=b["height"] * factor)

    return pages.mapInPandas(run, pages.schema)


def grey(pixels: np.ndarray) -> np.ndarray:
    """Luma of RGB rows by the usual integer weights."""
    if pixels.shape[2] == 1:
        return pixels[:, :, 0].astype(np.float32)
    rgb = pixels.astype(np.uint32)
    return ((rgb[:, :, 0] * 19595 + rgb[:, :, 1] * 38470 + rgb[:, :, 2] * 7471 + 0x8000) >> 16).astype(np.float32)


def _array(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, channels)


def filled(data: bytes, width: int, height: int, channels: int, boxes: list, fill: tuple[int, int, int]) -> bytes:
    """The page with its boxes painted over, right and bottom edges included."""
    out = _array(data, width, height, channels).copy()
    for x0, y0, x1, y1 in boxes:
        out[max(0, y0) : max(0, y1 + 1), max(0, x0) : max(0, x1 + 1)] = fill[:channels]
    return out.tobytes()


def fill_boxes(pages: DataFrame, boxes: DataFrame, fill: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """pages (doc_id, page, pixels) with the boxes of each page painted over. Pages without boxes stay as they are. Only ids and boxes
    are grouped; pixels move once, in the join."""
    own = boxes.groupBy("doc_id", "page").agg(F.collect_list(F.array("x0", "y0", "x1", "y1")).alias("boxes"))

    @F.pandas_udf("binary")
    def painted(data: pd.Series, width: pd.Series, height: pd.Series, channels: pd.Series, boxes: pd.Series) -> pd.Series:
        return pd.Series([bytes(d) if b is None or not len(b) else filled(d, w, h, c, [tuple(map(int, x)) for x in b], fill) for d, w, h, c, b in zip(data, width, height, channels, boxes, strict=True)])

    return pages.join(own, ["doc_id", "page"], "left").withColumn("data", painted("data", "width", "height", "channels", "boxes")).drop("boxes")


def ink(pixels: np.ndarray, rect: tuple[float, float, float, float]) -> bool:
    """Whether the middle of a rectangle is dark enough for a code: INK_SHARE of the paper around it, over MIN_INK of its area."""
    h, w = pixels.shape[:2]

    def crop(x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
        a, b, c, d = max(0, int(x0)), max(0, int(y0)), min(w, int(round(x1))), min(h, int(round(y1)))
        return grey(pixels[b:d, a:c]) if c > a and d > b else np.empty(0, np.float32)

    x0, y0, x1, y1 = rect
    reach = max(x1 - x0, y1 - y0) / 2
    mx, my = (x1 - x0) * P.INK_INNER / 2, (y1 - y0) * P.INK_INNER / 2
    cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
    around, middle = crop(x0 - reach, y0 - reach, x1 + reach, y1 + reach), crop(cx - mx, cy - my, cx + mx, cy + my)
    if not around.size or not middle.size:
        return False
    return float((middle < P.INK_SHARE * float(np.percentile(around, 95))).mean()) >= P.MIN_INK


def inked(rects: DataFrame, pages: DataFrame) -> DataFrame:
    """Rectangles that hold ink, or are decoded: a checksum outranks pixels."""

    @F.pandas_udf("boolean")
    def holds(data: pd.Series, width: pd.Series, height: pd.Series, channels: pd.Series, x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
        return pd.Series([ink(_array(d, w, h, c), r) for d, w, h, c, *r in zip(data, width, height, channels, x0, y0, x1, y1, strict=True)])

    sure = rects.where("decoded")
    rest = rects.where("NOT decoded").join(pages.select("doc_id", "page", "width", "height", "channels", "data"), ["doc_id", "page"])
    return sure.unionByName(rest.where(holds("data", "width", "height", "channels", "x0", "y0", "x1", "y1")).select(rects.columns))


def png(data: bytes, width: int, height: int, channels: int) -> bytes:
    """A PNG file, without filters."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = _array(data, width, height, channels).reshape(height, -1)
    raw = np.concatenate([np.zeros((height, 1), np.uint8), rows], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if channels == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def pdf(pages: list[tuple[bytes, int, int, int]], dpi: int = 72) -> bytes:
    """A PDF with one image a page, sized pixels * 72 / dpi points. No pages are an error."""
    if not pages:
        raise ValueError("no pages to assemble")
    out, at = bytearray(b"%PDF-1.4\n"), []

    def add(body: bytes) -> None:
        at.append(len(out))
        out.extend(b"%d 0 obj\n" % len(at) + body + b"\nendobj\n")

    kids = b" ".join(b"%d 0 R" % (3 + 3 * i) for i in range(len(pages)))
    add(b"<< /Type /Catalog /Pages 2 0 R >>")
    add(b"<< /Type /Pages /Kids [" + kids + b"] /Count %d >>" % len(pages))
    for i, (data, w, h, c) in enumerate(pages):
        pw, ph = w * 72 / dpi, h * 72 / dpi
        draw = b"q %.4f 0 0 %.4f 0 0 cm /I Do Q" % (pw, ph)
        image = zlib.compress(data, 6)
        add(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %.4f %.4f] /Contents %d 0 R /Resources << /XObject << /I %d 0 R >> >> >>" % (pw, ph, 4 + 3 * i, 5 + 3 * i))
        add(b"<< /Length %d >>\nstream\n" % len(draw) + draw + b"\nendstream")
        add(b"<< /Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace %s /BitsPerComponent 8 /Filter /FlateDecode /Length %d >>\nstream\n" % (w, h, b"/DeviceRGB" if c == 3 else b"/DeviceGray", len(image)) + image + b"\nendstream")
    start = len(out)
    out.extend(b"xref\n0 %d\n0000000000 65535 f \n" % (len(at) + 1) + b"".join(b"%010d 00000 n \n" % x for x in at))
    out.extend(b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(at) + 1, start))
    return bytes(out)


def assemble_pdf(pages: DataFrame, dpi: int = 72) -> DataFrame:
    """(doc_id, content): one PDF for each document, pages in order. A document's pages meet in one task; max_pages bounds them."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("page")
        made = pdf([(bytes(d), int(w), int(h), int(c)) for d, w, h, c in zip(rows.data, rows.width, rows.height, rows.channels, strict=True)], dpi)
        return pd.DataFrame({"doc_id": [rows.doc_id.iloc[0]], "content": [made]})

    return pages.groupBy("doc_id").applyInPandas(run, "doc_id long, content binary")


def encode_image(pages: DataFrame) -> DataFrame:
    """pages with `content`, an image file: JPEG by the plugged-in encoder, else PNG."""
    jpeg = _SEAMS.get("jpeg")

    @F.pandas_udf("binary")
    def encoded(data: pd.Series, width: pd.Series, height: pd.Series, channels: pd.Series) -> pd.Series:
        return pd.Series([(jpeg or png)(bytes(d), w, h, c) for d, w, h, c in zip(data, width, height, channels, strict=True)])

    return pages.withColumn("content", encoded("data", "width", "height", "channels")).withColumn("content_type", F.lit("image/jpeg" if jpeg else "image/png"))


def rgb_of_image_source(image: Column) -> Column:
    """Spark's image source gives blue first; this swaps the channels of its struct's data."""

    @F.pandas_udf("binary")
    def swapped(data: pd.Series, channels: pd.Series) -> pd.Series:
        return pd.Series([bytes(d) if c == 1 else np.frombuffer(d, np.uint8).reshape(-1, c)[:, [2, 1, 0]].tobytes() for d, c in zip(data, channels, strict=True)])

    return swapped(image["data"], image["nChannels"])
