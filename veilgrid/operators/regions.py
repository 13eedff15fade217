"""Regions of a page: letterhead and footer bands, sender and recipient blocks, grown from anchors over adjacent lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import is_recipient_anchor, is_sender_anchor, not_blank
from ..schema import LINE, PAGE, bottom, by_document


@dataclass(frozen=True)
class RegionParams:
    """Geometry as fractions of the page; a zero fraction, or an empty window, turns a region off."""

    header_frac: float = 0.12
    footer_frac: float = 0.10
    column_x_frac: float = 0.50
    column_y_frac: float = 0.50
    vgap_factor: float = 1.2
    align_factor: float = 0.4
    recipient_y_min_frac: float = 0.05
    recipient_y_max_frac: float = 0.45
    padding: int = 2


def _adjacent(a: str, b: str, p: RegionParams) -> Column:
    """Near-touching and sharing a left edge, in units of the lower height. The gap is signed: an overlap is closest of all."""
    h = f"least({a}.height, {b}.height)"
    gap = f"greatest({a}.top, {b}.top) - least({a}.top + {a}.height, {b}.top + {b}.height)"
    return F.expr(f"abs({a}.left - {b}.left) <= {p.align_factor}D * {h} AND {gap} <= {p.vgap_factor}D * {h}")


def adjacent_pairs(lines: DataFrame, p: RegionParams = RegionParams()) -> DataFrame:
    """(doc_id, page, a, b) with a < b: adjacent lines that aren't blank."""
    some = lines.where(not_blank(F.col("text"))).select(*LINE, "left", "top", "height")
    x, y = some.alias("x"), some.alias("y")
    pairs = x.join(y, F.expr("x.doc_id = y.doc_id AND x.page = y.page AND x.line_no < y.line_no") & _adjacent("x", "y", p))
    return pairs.select(F.col("x.doc_id").alias("doc_id"), F.col("x.page").alias("page"), F.col("x.line_no").alias("a"), F.col("y.line_no").alias("b"))


def _labels(page: np.ndarray, left: np.ndarray, top: np.ndarray, height: np.ndarray, no: np.ndarray, p: RegionParams) -> np.ndarray:
    """For lines of many pages, the smallest line number of each line's connected component, all pages at once.

    By page and left edge, a line's partners follow it within the alignment that the page's tallest line allows. So lines are held
    against the next one, the one after it, and so on, as long as any is that near. Edges join trees until none has two roots."""
    order = np.lexsort((no, left, page))
    page, left, top, height, no = (x[order] for x in (page, left, top, height, no))
    starts = np.flatnonzero(np.concatenate([[True], page[1:] != page[:-1]])) if len(page) else np.zeros(0, np.int64)
    widest = np.repeat(np.maximum.reduceat(height, starts), np.diff(np.append(starts, len(page)))) * p.align_factor if len(page) else height
    root, near, step, edges = np.arange(len(no)), np.arange(len(no)), 0, []
    while len(near):
        step += 1
        near = near[near + step < len(no)]
        near = near[(page[near + step] == page[near]) & (left[near + step] - left[near] <= widest[near])]
        i, j = near, near + step
        h = np.minimum(height[i], height[j])
        gap = np.maximum(top[i], top[j]) - np.minimum(top[i] + height[i], top[j] + height[j])
        hit = (left[j] - left[i] <= p.align_factor * h) & (gap <= p.vgap_factor * h)
        edges.append((i[hit], j[hit]))
    if edges:
        a, b = (np.concatenate(x) for x in zip(*edges, strict=True))
        while True:
            high, low = np.maximum(root[a], root[b]), np.minimum(root[a], root[b])
            if not (open_ := high != low).any():
                break
            np.minimum.at(root, high[open_], low[open_])
            while (root[root] != root).any():
                root = root[root]
    least = no.copy()
    np.minimum.at(least, root, no)
    out = np.empty(len(no), np.int64)
    out[order] = least[root]
    return out


_LISTED = ["line_no", "left", "top", "width", "height", "marks"]
_CLAIMED = ["block", "x0", "y0", "x1", "y1", "marks"]
_CLAIM = f"struct<{','.join(f'{c}:int' for c in _CLAIMED)}>"


def _listed(lists: pa.ListArray, p: RegionParams, marked_only: bool) -> pa.ListArray:
    """For each page's list of lines, every line's block, or the extent and marks of each block that has any."""
    fields = ["line_no", "block"] if marked_only is False else _CLAIMED
    page = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    flat = lists.flatten()
    no, left, top, width, height, marks = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in _LISTED)
    block = _labels(page, left, top, height, no, p)
    if marked_only:
        order = np.lexsort((block, page))
        page, block = page[order], block[order]
        begin = np.flatnonzero(np.concatenate([[True], (page[1:] != page[:-1]) | (block[1:] != block[:-1])])) if len(page) else np.zeros(0, np.int64)
        fold = lambda f, x: f.reduceat(x[order], begin) if len(begin) else x[:0]
        columns = [block[begin], fold(np.minimum, left), fold(np.minimum, top), fold(np.maximum, left + width), fold(np.maximum, top + height), fold(np.bitwise_or, marks)]
        some = columns[-1] != 0
        page, columns = page[begin][some], [c[some] for c in columns]
    else:
        columns = [no, block]
    ends = np.searchsorted(page, np.arange(len(lists) + 1))
    rows = pa.StructArray.from_arrays([pa.array(c.astype(np.int32)) for c in columns], fields)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)


def _blocked(p: RegionParams, marked_only: bool):
    """Pages with arrays of their lines to (doc_id, page, bs): see _listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("page"), _listed(b.column("ls"), p, marked_only)], ["doc_id", "page", "bs"])

    return run


def claimed_blocks(pages: Column, p: RegionParams) -> Column:
    """For a document's array of pages, each an array of its lines (_LISTED), the blocks of each page that have marks."""

    def run(documents: pa.Array) -> pa.Array:
        sizes = documents.value_lengths().to_numpy(zero_copy_only=False)
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        return pa.ListArray.from_arrays(ends, _listed(documents.flatten(), p, True))

    # types are given here, as annotations would be names that a worker has to resolve
    run.__annotations__ = {"documents": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, f"array<array<{_CLAIM}>>")(pages)


def _page_lists(lines: DataFrame, marks: Column) -> DataFrame:
    some = by_document(lines).where(not_blank(F.col("text"))).select(*PAGE, F.struct(*_LISTED[:-1], marks.alias("marks")).alias("x"))
    return some.groupBy(*PAGE).agg(F.collect_list("x").alias("ls"), F.bit_or("x.marks").alias("any"))


def blocks(lines: DataFrame, p: RegionParams = RegionParams()) -> DataFrame:
    """(line, block) of all lines that aren't blank: connected components of adjacency. A component has no order, so its smallest line number
    names it. Pages are rows here, with their lines in arrays, and Python sees thousands of pages at a time."""
    pages = _page_lists(lines, F.lit(0)).select(*PAGE, "ls").mapInArrow(_blocked(p, False), "doc_id long, page int, bs array<struct<line_no:int,block:int>>")
    return pages.select(*PAGE, F.inline("bs"))


#: Bits of the regions that a line seeds.
_KINDS = ["header", "footer", "sender", "recipient"]


def seeds(width: int, height: int, p: RegionParams, sender_anchor: Column, recipient_anchor: Column) -> Column:
    """The bits of the regions that a line seeds. Windows are tested before anchors."""
    w, h = float(width), float(height)
    off = F.lit(False)
    header = F.col("top") < p.header_frac * h if p.header_frac * h > 0 else off
    footer = bottom() > h - p.footer_frac * h if p.footer_frac > 0 else off
    sender = (F.col("left") >= p.column_x_frac * w) & (F.col("top") <= p.column_y_frac * h) if p.column_x_frac < 1 and p.column_y_frac > 0 else off
    y_min, y_max = p.recipient_y_min_frac * h, p.recipient_y_max_frac * h
    recipient = (F.col("left") < p.column_x_frac * w) & F.col("top").between(y_min, y_max) if p.recipient_y_max_frac > p.recipient_y_min_frac else off
    bit = lambda c, n: F.when(c, F.lit(n)).otherwise(F.lit(0))
    bits = bit(header, 1) + bit(footer, 2) + bit(sender, 4)
    return F.when((header | footer | sender) & sender_anchor, bits).otherwise(F.lit(0)) + bit(recipient & recipient_anchor, 8)


def block_regions(lines: DataFrame, width: int, height: int, p: RegionParams = RegionParams()) -> DataFrame:
    """One row for each block that a region claims: its extent, and which regions seed it.

    Patterns are evaluated in the JVM, and only pages with an anchor in a window are looked at as a whole."""
    text = F.col("text")
    marks = seeds(width, height, p, is_sender_anchor(text), is_recipient_anchor(text))
    pages = _page_lists(lines, marks).where("any <> 0").select(*PAGE, "ls")
    claimed = pages.mapInArrow(_blocked(p, True), f"doc_id long, page int, bs array<{_CLAIM}>")
    claimed = by_document(claimed, lines)  # what Python returns lies nowhere in particular, as far as Spark knows
    return claimed.select(*PAGE, F.inline("bs")).select(*PAGE, "block", "x0", "y0", "x1", "y1", *((F.col("marks").bitwiseAND(1 << i) != 0).alias(k) for i, k in enumerate(_KINDS)))


def _reach(y0: Column, y1: Column, height: int, p: RegionParams) -> tuple[Column, Column]:
    """The lower edge of the header's band, and the upper one of the footer's."""
    edge = p.header_frac * height
    foot = height - (height - (height - p.footer_frac * height)) * P.BAND_STRETCH
    low = F.bround(F.least(y1.cast("double"), F.lit(edge * P.BAND_STRETCH))).cast("int") + p.padding
    return low, F.bround(F.greatest(y0.cast("double"), F.lit(float(foot)))).cast("int") - p.padding


def page_boxes(claims: Column, width: int, height: int, p: RegionParams) -> Column:
    """region_boxes of one page's claimed blocks: an array of (kind, x0, y0, x1, y1)."""
    box = lambda kind, *xs: F.struct(F.lit(kind).alias("kind"), *((x if isinstance(x, Column) else F.lit(x)).cast("int").alias(c) for x, c in zip(xs, ("x0", "y0", "x1", "y1"), strict=True)))
    of = lambda i: F.filter(claims, lambda b: b["marks"].bitwiseAND(1 << i) != 0)
    some = lambda i: F.exists(claims, lambda b: b["marks"].bitwiseAND(1 << i) != 0)
    low = _reach(F.lit(0), F.array_max(F.transform(of(0), lambda b: b["y1"])), height, p)[0]
    high = _reach(F.array_min(F.transform(of(1), lambda b: b["y0"])), F.lit(0), height, p)[1]
    block = lambda kind: lambda b: box(kind, b["x0"] - p.padding, b["y0"] - p.padding, b["x1"] + p.padding, b["y1"] + p.padding)
    none = F.array().cast("array<struct<kind:string,x0:int,y0:int,x1:int,y1:int>>")
    bands = [F.when(some(0), F.array(box("header", 0, 0, width, low))).otherwise(none), F.when(some(1), F.array(box("footer", 0, high, width, height))).otherwise(none)]
    return F.concat(none, *bands, F.transform(of(2), block("sender")), F.transform(of(3), block("recipient")))


def region_boxes(lines: DataFrame, width: int, height: int, p: RegionParams = RegionParams()) -> DataFrame:
    """(doc_id, page, kind, x0, y0, x1, y1): header and footer bands over the page's width, and a box for each sender and recipient block.

    Bands reach as far as their blocks do, at most BAND_STRETCH windows; halves round to even."""
    claimed = block_regions(lines, width, height, p)
    cols = [*PAGE, "kind", "x0", "y0", "x1", "y1"]
    # one row for each block and region, so that the blocks are computed once
    kinds = F.filter(F.array(*(F.when(F.col(k), F.lit(k)) for k in _KINDS)), lambda k: k.isNotNull())
    rows = claimed.select(*PAGE, "block", "x0", "y0", "x1", "y1", F.explode(kinds).alias("kind"))
    band = F.col("kind").isin("header", "footer")
    boxes = rows.groupBy(*PAGE, "kind", F.when(band, F.lit(-1)).otherwise(F.col("block")).alias("block")).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    low, high = _reach(F.col("y0"), F.col("y1"), height, p)
    pad = p.padding
    is_h, is_f = F.col("kind") == "header", F.col("kind") == "footer"
    return boxes.select(
        *PAGE, "kind", F.when(band, 0).otherwise(F.col("x0") - pad).cast("int").alias("x0"),
        F.when(is_h, 0).when(is_f, high).otherwise(F.col("y0") - pad).cast("int").alias("y0"),
        F.when(band, width).otherwise(F.col("x1") + pad).cast("int").alias("x1"),
        F.when(is_h, low).when(is_f, height).otherwise(F.col("y1") + pad).cast("int").alias("y1"),
    ).select(cols)
