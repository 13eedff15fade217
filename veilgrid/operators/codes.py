"""Boxes of barcodes from what decoders report: guards, fragments reassembled, growth, and the ordered merge.

`reads` has (doc_id, page, read_no, pass, linear, decoded, x0, y0, x1, y1), corners as doubles in the pixels of that pass; the decoder
itself is a seam that fills it (see images.decode_codes).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..schema import PAGE
from . import images


def rect_of(corners: Column) -> Column:
    """The upright rectangle around four corners (x, y), in any order."""
    xs, ys = F.transform(corners, lambda c: c["x"]), F.transform(corners, lambda c: c["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def plausible(reads: DataFrame) -> DataFrame:
    """Reads that are large and square enough for a matrix code."""
    a, b = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return reads.where((a >= P.MIN_SIDE) & (b >= P.MIN_SIDE) & (F.greatest(a, b) <= P.MAX_ASPECT * F.least(a, b)))


def retry_pages(pages: DataFrame, reads: DataFrame) -> DataFrame:
    """Pages (doc_id, page, width, height) worth a second, enlarged pass: nothing decoded, and something read or the page small.
    Linear reads don't count: a readable barcode may stand beside an unreadable symbol."""
    seen = reads.where(~F.col("linear")).groupBy(*PAGE).agg(F.bool_or("decoded").alias("any"), F.count(F.lit(1)).alias("n"))
    joined = pages.join(seen, PAGE, "left")
    small = F.col("width").cast("long") * F.col("height") <= P.RETRY_BLIND_MAX_PIXELS
    return joined.where(~F.coalesce("any", F.lit(False)) & ((F.coalesce("n", F.lit(0)) > 0) | small)).select(pages.columns)


def unscaled(reads: DataFrame) -> DataFrame:
    """Reads of the enlarged pass (pass 2) in the page's own pixels, together with those of the first."""
    factor = F.when(F.col("pass") == 2, 1.0 / P.RETRY_UPSCALE).otherwise(1.0)
    return reads.select(*(c for c in reads.columns if c not in ("x0", "y0", "x1", "y1")), *((F.col(c) * factor).alias(c) for c in ("x0", "y0", "x1", "y1")))


def _overlap(a: str, b: str) -> Column:
    return F.expr(f"{a}.doc_id = {b}.doc_id AND {a}.page = {b}.page AND {a}.x0 < {b}.x1 AND {b}.x0 < {a}.x1 AND {a}.y0 < {b}.y1 AND {b}.y0 < {a}.y1")


def apart_from(rects: DataFrame, exact: DataFrame) -> DataFrame:
    """Rectangles that overlap none of the exact ones of their page; touching is no overlap."""
    return rects.alias("a").join(exact.alias("b"), _overlap("a", "b"), "left_anti")


def _grouped(page: pa.Table) -> pa.Table:
    """A page's fragments to one square for each group of pieces within reach of each other, from the group's top left."""
    x0, y0, x1, y1 = (page.column(c).to_numpy() for c in ("x0", "y0", "x1", "y1"))
    longest = np.maximum(x1 - x0, y1 - y0)
    left = np.arange(len(x0))
    order = np.argsort(page.column("read_no").to_numpy(), kind="stable")
    group = np.full(len(x0), -1)
    for seed in order:
        if group[seed] >= 0:
            continue
        group[seed] = seed
        open_ = [seed]
        while open_:
            i = open_.pop()
            free = left[group < 0]
            gap = np.maximum(np.maximum(x0[i], x0[free]) - np.minimum(x1[i], x1[free]), np.maximum(y0[i], y0[free]) - np.minimum(y1[i], y1[free]))
            near = free[np.maximum(gap, 0) <= P.FRAGMENT_REACH * np.maximum(longest[i], longest[free])]
            group[near] = seed
            open_ += near.tolist()
    seeds, place = np.unique(group, return_inverse=True)
    gx0, gy0 = np.full(len(seeds), np.inf), np.full(len(seeds), np.inf)
    gx1, gy1 = np.full(len(seeds), -np.inf), np.full(len(seeds), -np.inf)
    no = np.full(len(seeds), np.iinfo(np.int64).max)
    np.minimum.at(gx0, place, x0), np.minimum.at(gy0, place, y0), np.maximum.at(gx1, place, x1), np.maximum.at(gy1, place, y1)
    np.minimum.at(no, place, page.column("read_no").to_numpy().astype(np.int64))
    side = np.maximum(gx1 - gx0, gy1 - gy0)
    first = page.slice(0, 1)
    n = len(seeds)
    return pa.Table.from_pydict({"doc_id": first.column("doc_id").to_pylist() * n, "page": pa.array(first.column("page").to_pylist() * n, pa.int32()), "read_no": no, "x0": gx0, "y0": gy0, "x1": gx0 + side, "y1": gy0 + side})


def fuse_fragments(fragments: DataFrame) -> DataFrame:
    """(doc_id, page, read_no, x0, y0, x1, y1): whole squares from pieces; read_no is the smallest of a group."""
    rows = fragments.select(*PAGE, F.col("read_no").cast("long"), *(F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")))
    return rows.groupBy(*PAGE).applyInArrow(_grouped, "doc_id long, page int, read_no long, x0 double, y0 double, x1 double, y1 double")


def grown(rects: DataFrame, margin_frac: float = 0.08, padding: int = 2, width: int = 1 << 30, height: int = 1 << 30) -> DataFrame:
    """Rectangles as boxes: grown by a share of the longer side and the padding, kept within the page; empty ones go. Halves round to even."""
    grow = F.bround(F.lit(margin_frac) * F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).cast("int") + padding
    near = [(F.greatest(F.lit(0), F.bround(c).cast("int") - grow)).alias(c) for c in ("x0", "y0")]
    far = [(F.least(F.lit(m), F.bround(c).cast("int") + grow)).alias(c) for c, m in (("x1", width), ("y1", height))]
    return rects.select(*(c for c in rects.columns if c not in ("x0", "y0", "x1", "y1")), *near, *far).where("x1 > x0 AND y1 > y0")


def merge_sweep(boxes: DataFrame, order: str = "read_no") -> DataFrame:
    """(doc_id, page, box_no, x0, y0, x1, y1): overlapping boxes of a page merged in one sweep in the order given.

    Each box in turn takes in those of the list so far that it overlaps as it grows, one pass from the front; a box passed before the growth
    stays. So the result depends on the order, and some overlaps can remain.
    """
    box = F.struct(F.col(order).alias("o"), *(F.col(c).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")))
    pages = boxes.groupBy(*PAGE).agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    kind = "array<struct<x0:int,y0:int,x1:int,y1:int>>"
    plain = F.transform("boxes", lambda b: F.struct(b["x0"], b["y0"], b["x1"], b["y1"]))

    def sweep(merged: Column, b: Column) -> Column:
        def meet(acc: Column, o: Column) -> Column:
            c = acc["cur"]
            hit = (c["x0"] < o["x1"]) & (o["x0"] < c["x1"]) & (c["y0"] < o["y1"]) & (o["y0"] < c["y1"])
            wide = F.struct(F.least(c["x0"], o["x0"]).alias("x0"), F.least(c["y0"], o["y0"]).alias("y0"), F.greatest(c["x1"], o["x1"]).alias("x1"), F.greatest(c["y1"], o["y1"]).alias("y1"))
            return F.when(hit, F.struct(wide.alias("cur"), acc["rest"].alias("rest"))).otherwise(F.struct(c.alias("cur"), F.concat(acc["rest"], F.array(o)).alias("rest")))

        start = F.struct(b.alias("cur"), F.array().cast(kind).alias("rest"))
        return F.aggregate(merged, start, meet, lambda a: F.concat(a["rest"], F.array(a["cur"])))

    return pages.select(*PAGE, F.posexplode(F.aggregate(plain.cast(kind), F.array().cast(kind), sweep)).alias("box_no", "b")).select(*PAGE, "box_no", "b.x0", "b.y0", "b.x1", "b.y1")


def admitted(reads: DataFrame, pages: DataFrame) -> DataFrame:
    """Reads that count: those of the first pass in a matrix code's shape, those of the enlarged pass on pages that need one
    (retry_pages), and linear ones of any shape, for which a checksum stands."""
    linear, matrix = reads.where("linear"), plausible(reads.where("NOT linear"))
    first = matrix.where("pass = 1")
    again = matrix.where("pass = 2").join(retry_pages(pages, first).select(*PAGE), PAGE, "left_semi").select(reads.columns)
    return first.unionByName(again).unionByName(linear)


def code_pass(pages: DataFrame, margin_frac: float = 0.08, padding: int = 2) -> DataFrame:
    """Boxes of all codes on page images (doc_id, page, width, height, channels, data), by the decoders plugged in as seams.

    'decode_codes' gives matrix reads, decoded or not; it sees a page a second time, enlarged, if retry_pages says so. 'decode_linear' is asked
    once for each format, as it finds some codes only alone. 'outline_codes' is asked only where fragments are left."""
    schema, cols = "doc_id long, page int, read_no long, decoded boolean, x0 double, y0 double, x1 double, y1 double", [*PAGE, "read_no", "pass", "linear", "decoded", "x0", "y0", "x1", "y1"]
    told = lambda df, number, linear: df.withColumn("pass", F.lit(number)).withColumn("linear", F.lit(linear)).select(cols)
    first = images.inked(plausible(told(images.apply_model(pages, "decode_codes", schema), 1, False)), pages)
    large = images.enlarged(retry_pages(pages, first), P.RETRY_UPSCALE)
    again = images.inked(plausible(told(images.apply_model(large, "decode_codes", schema), 2, False)), large)
    formats = pages.withColumn("format", F.explode(F.array(*(F.lit(f) for f in P.LINEAR_FORMATS))))
    linear = told(images.apply_model(formats, "decode_linear", schema).where("decoded"), 1, True)
    reads = first.unionByName(again).unionByName(linear)
    with_pieces = pages.join(reads.where("NOT decoded").select(*PAGE).distinct(), PAGE, "left_semi")
    outlines = images.apply_model(with_pieces, "outline_codes", schema)
    return clamped(code_boxes(reads, outlines, margin_frac, padding, pages=pages), pages)


def clamped(boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """Boxes kept within their pages."""
    joined = boxes.join(pages.select(*PAGE, "width", "height"), PAGE)
    return joined.withColumn("x1", F.least("x1", "width")).withColumn("y1", F.least("y1", "height")).where("x1 > x0 AND y1 > y0").select(boxes.columns)


def code_boxes(reads: DataFrame, outlines: DataFrame | None = None, margin_frac: float = 0.08, padding: int = 2, width: int = 1 << 30, height: int = 1 << 30, pages: DataFrame | None = None) -> DataFrame:
    """From reads of both passes to boxes: decoded, linear and outlined symbols are exact; fragments that touch none of them are fused.
    Exact ones come first in the merge. Reads must have passed the guards (admitted, images.inked); outlines pass that of shape here, and with
    pages given both outlines and fused squares must hold ink: squaring a group goes beyond what was measured."""

    def inked(rects: DataFrame) -> DataFrame:
        return rects if pages is None else images.inked(rects.withColumn("decoded", F.lit(False)), pages).drop("decoded")

    cols = [*PAGE, "read_no", "x0", "y0", "x1", "y1"]
    own = unscaled(reads)
    exact = own.where("decoded OR linear").select(cols)
    fragments = own.where("NOT decoded AND NOT linear").select(cols)
    if outlines is not None:
        withf = outlines.join(fragments.select(*PAGE).distinct(), PAGE, "left_semi")  # asked for only where there are fragments
        exact = exact.unionByName(apart_from(inked(plausible(withf).select(cols)), exact))
    fused = inked(fuse_fragments(apart_from(fragments, exact)).select(cols))
    ordered = exact.withColumn("late", F.lit(0)).unionByName(fused.withColumn("late", F.lit(1))).withColumn("place", F.struct("late", "read_no"))
    return merge_sweep(grown(ordered, margin_frac, padding, width, height), "place")
