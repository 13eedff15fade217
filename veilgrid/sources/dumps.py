"""Frozen dumps of recognised lines, and the snapshots of verdicts on them: read, rendered and compared."""

from __future__ import annotations

import ast
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import excerpt, python_repr
from ..operators.sheets import by_documents, changes, numbers
from ..schema import LINE, PAGE

# The formats of dumps and snapshots.
PAGE_LINE = r"^=== page (\d+)(?: \((\d+)x(\d+)\))? ===$"
DUMP_LINE = r"^line @\((-?\d+),(-?\d+) (\d+)x(\d+) conf=(\S+)\): (.+)$"
VERDICT_LINE = r"^\s+-> (REDACT|keep|PARTIAL)\b(.*)$"
REGION_LINE = r"^region -> REDACT \[(-?\d+), (-?\d+), (-?\d+), (-?\d+)\]$"
REASON = r"\(([^)]*)\)\s*$"
DUMP_GLOB = "*_ocr.txt"


def read_texts(spark: SparkSession, path: str, glob: str = DUMP_GLOB) -> DataFrame:
    """(path, pos, raw): every line of every file, in order within its file. A file is one row until it is split, as dumps are small."""
    whole = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).withColumn("path", F.input_file_name())
    return split_texts(whole)


def split_texts(whole: DataFrame) -> DataFrame:
    """(path, pos, raw): every line of texts (path, value)."""
    return whole.select("path", F.posexplode(F.split(F.regexp_replace("value", "\r\n?", "\n"), "\n")).alias("pos", "raw"))


@F.pandas_udf(T.StringType())
def _literal(text: pd.Series) -> pd.Series:
    def one(x: str | None) -> str | None:
        if x is None:
            return None
        got = ast.literal_eval(x)
        if not isinstance(got, str):
            raise ValueError(f"line text is not a string: {x}")
        return got

    return text.map(one)


def _of_page(raw: DataFrame) -> DataFrame:
    """raw lines with the number of the last page header before them."""
    along = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    number = F.when(F.col("raw").rlike(PAGE_LINE), F.regexp_extract("raw", PAGE_LINE, 1).cast("int"))
    return raw.withColumn("head", number).withColumn("page", F.last("head", ignorenulls=True).over(along))


def parse_dump(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, pages) of dumps. Comments and blank lines are skipped; a header without a size, a line before any header, and anything
    else fail the job with the line in the message. Lines keep their path; doc_id is a hash of it."""
    some = _of_page(raw.where(F.col("raw").rlike(r"(?U)\S") & ~F.col("raw").startswith("#")))
    is_line, is_page = F.col("raw").rlike(DUMP_LINE), F.col("head").isNotNull()
    wrong = (
        F.when(is_page & (F.regexp_extract("raw", PAGE_LINE, 2) == ""), F.concat(F.lit("page header without a size: "), F.col("raw")))
        .when(~is_page & ~is_line, F.concat(F.lit("not an OCR line: "), F.col("raw")))
        .when(~is_page & F.col("page").isNull(), F.concat(F.lit("OCR line before any page header: "), F.col("raw")))
    )
    checked = some.withColumn("raw", F.when(wrong.isNotNull(), F.raise_error(wrong).cast("string")).otherwise(F.col("raw"))).withColumn("doc_id", F.xxhash64("path"))
    pages = checked.where("head IS NOT NULL").select("path", "doc_id", "page", *(F.regexp_extract("raw", PAGE_LINE, i).cast("int").alias(c) for i, c in ((2, "width"), (3, "height"))))
    part = [F.regexp_extract("raw", DUMP_LINE, i) for i in range(1, 7)]
    order = Window.partitionBy("path", "page").orderBy("pos")
    lines = checked.where("head IS NULL").select(
        "path", "doc_id", "page", (F.row_number().over(order) - 1).alias("line_no"), _literal(part[5]).alias("text"),
        *(part[i].cast("int").alias(c) for i, c in enumerate(("left", "top", "width", "height"))),
        F.when(part[4] != "None", F.expr(f"try_cast(regexp_extract(raw, r'{DUMP_LINE}', 5) AS double)")).alias("conf"),
    )
    return lines, pages


def line_header(x: Column | None = None) -> Column:
    """A line, of the columns or a struct, as dumps write it."""
    at = F.col if x is None else (lambda c: x[c])
    whole = lambda c: F.coalesce(at(c).cast("string"), F.lit("null"))
    conf = F.when(at("conf").isNull(), "None").otherwise(at("conf").cast("string"))
    return F.concat(F.lit("line @("), whole("left"), F.lit(","), whole("top"), F.lit(" "), whole("width"), F.lit("x"), whole("height"), F.lit(" conf="), conf, F.lit("): "), F.coalesce(python_repr(at("text")), F.lit("null")))


def render_dump(lines: DataFrame, pages: DataFrame, engine: str, unwarp: bool = False) -> DataFrame:
    """(doc_id, content): dumps, pages and lines in order, pages without lines too."""
    head = pages.select(*PAGE, F.lit(-1).alias("line_no"), F.format_string("=== page %d (%dx%d) ===", "page", "width", "height").alias("raw"))
    body = lines.select(*LINE, line_header().alias("raw"))
    texts = head.unionByName(body).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "line_no", "raw"))).alias("xs"))
    top = F.lit(f"# ocr: {engine}\n# unwarp: {str(unwarp).lower()}\n")
    return texts.select("doc_id", F.concat(F.format_string("# document: %s\n", F.col("doc_id").cast("string")), top, F.concat_ws("\n", F.transform("xs", lambda x: x["raw"])), F.lit("\n")).alias("content"))


def parse_snapshot(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verdicts, regions) of expected snapshots: whole texts (path, value), or their lines (path, pos, raw). Lenient on everything unknown; a
    code's box, or a verdict before any line, is an error.

    A text stays one row until its verdicts are told: no line is shuffled or sorted. It is cut before page headers; what stands under equal
    page numbers is put together, what stands before any header is page 0's; that is cut before lines, and the last verdict after a line is the line's."""
    if "raw" in texts.columns:
        in_order = F.array_sort(F.collect_list(F.struct("pos", "raw")))
        texts = texts.groupBy("path").agg(F.array_join(F.transform(in_order, lambda x: x["raw"]), "\n").alias("value"))
    else:
        texts = texts.withColumn("value", F.regexp_replace("value", "\r\n?", "\n"))
    value = F.concat(F.lit("\n"), F.col("value"))
    codes = F.raise_error(F.lit("code boxes are not replayed; remove the `code -> REDACT` line")).cast("array<string>")
    texts = texts.select("path", F.when(F.contains(value, F.lit("\ncode -> REDACT")), codes).otherwise(F.split(value, r"\n(?==== page \d+(?: \(\d+x\d+\))? ===[\u0085\u2028\u2029]?(?:\n|\z))")).alias("parts"))
    number = F.transform("parts", lambda x, i: F.struct(F.when(i == 0, 0).otherwise(F.regexp_extract(x, r"^=== page (\d+)", 1).cast("int")).alias("page"), x.alias("body")))
    pages = texts.select("path", number.alias("parts")).select("path", "parts", F.explode(F.array_distinct(F.transform("parts", lambda x: x["page"]))).alias("page"))
    own = F.filter("parts", lambda x: x["page"] == F.col("page"))
    pages = pages.select("path", "page", F.array_join(F.transform(own, lambda x: x["body"]), "\n").alias("body"))
    chunks = pages.select("path", "page", F.posexplode(F.split(F.concat(F.lit("\n"), F.col("body")), r"\n(?=line @)")).alias("line_no", "chunk")).withColumn("line_no", F.col("line_no").cast("long") - 1)
    raws = F.split("chunk", "\n")
    v = F.try_element_at(F.filter(raws, lambda x: x.rlike(VERDICT_LINE)), F.lit(-1))
    rows = chunks.select("path", "page", "line_no", F.get(raws, F.lit(0)).alias("line"), v.alias("v"))
    early = F.raise_error(F.concat(F.lit("verdict before any line: "), F.col("v"))).cast("boolean")
    rows = rows.where(F.when(F.col("line_no") >= 0, True).when(F.col("v").isNull(), False).otherwise(early))
    reason = F.regexp_extract(F.regexp_extract("v", VERDICT_LINE, 2), REASON, 1)
    verdicts = rows.select("path", "page", "line_no", "line", F.when(F.col("v").isNull(), "keep").otherwise(F.regexp_extract("v", VERDICT_LINE, 1)).alias("kind"), F.when(reason != "", reason).alias("reason"))
    # found in the whole text of a page: REGION_LINE at the ends of a line instead of a text's
    whole = r"\n" + REGION_LINE[1:-1] + r"(?=[\r\u0085\u2028\u2029]?(?:\n|\z))"
    found = F.regexp_extract_all(F.concat(F.lit("\n"), F.col("body")), F.lit(whole), F.lit(0))
    boxes = pages.select("path", "page", F.explode(found).alias("raw")).withColumn("raw", F.substring("raw", 2, 1 << 20))
    regions = boxes.select("path", "page", *(F.regexp_extract("raw", REGION_LINE, i).cast("int").alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"), 1)))
    return verdicts, regions


def verdict_text(kind: Column, reason: Column, coverage: Column) -> Column:
    named = F.when(reason.isNull(), F.lit("")).otherwise(F.concat(F.lit(" ("), reason, F.lit(")")))
    share = F.concat(F.bround(coverage * 100).cast("int").cast("string"), F.lit("%"))
    return F.concat(F.lit("    -> "), F.when(kind == "PARTIAL", F.concat(F.lit("PARTIAL "), share)).otherwise(kind), named)


def render_snapshot(outcomes: DataFrame, regions: DataFrame, classifier: str) -> DataFrame:
    """(doc_id, content): verdicts of every line and the boxes of regions, page by page."""
    line, box = F.struct(*outcomes.columns), F.struct(*regions.columns)
    rows = outcomes.select("doc_id", "page", line.alias("l"), F.lit(None).cast(regions.select(box.alias("b")).schema["b"].dataType).alias("b"))
    rows = rows.unionByName(regions.select("doc_id", "page", F.lit(None).cast(rows.schema["l"].dataType).alias("l"), box.alias("b")))
    pages = rows.groupBy(*PAGE).agg(F.collect_list("l").alias("ls"), F.collect_list("b").alias("rs"))  # nulls are left out
    return render_snapshots(pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "ls", "rs"))).alias("ps")), classifier)


def render_snapshots(documents: DataFrame, classifier: str) -> DataFrame:
    """(doc_id, content) of documents (doc_id, ps), as verdicts.outcome_documents has them: pages in order, with lines ls and boxes rs. No row meets another."""
    rank = {k: i for i, k in enumerate(("header", "footer", "sender", "recipient"))}
    place = lambda b: F.coalesce(*(F.when(b["kind"] == k, i) for k, i in rank.items()))
    raw = lambda x: F.concat(line_header(x), F.lit("\n"), verdict_text(x["kind"], x["reason"], x["coverage"]))
    box = lambda b: F.concat(F.lit("region -> REDACT ["), F.concat_ws(", ", *(b[c].cast("string") for c in ("x0", "y0", "x1", "y1"))), F.lit("]"))

    def page(p: Column) -> Column:
        lines = F.array_sort(F.transform(p["ls"], lambda x: F.struct(x["line_no"].alias("at"), raw(x).alias("raw"))))
        boxes = F.array_sort(F.transform(p["rs"], lambda b: F.struct(place(b).alias("at"), box(b).alias("raw"))))
        return F.concat(F.array(F.concat(F.lit("=== page "), p["page"].cast("string"), F.lit(" ==="))), F.transform(F.concat(lines, boxes), lambda x: x["raw"]))

    some = F.filter("ps", lambda p: (F.size(p["ls"]) > 0) | (F.size(p["rs"]) > 0))
    text = lambda ps: F.concat(F.lit(f"# classifier: {classifier}\n"), F.array_join(F.flatten(F.transform(ps, page)), "\n"), F.lit("\n"))
    told = F.transform(F.array(some), lambda ps: F.when(F.size(ps) > 0, text(ps)))
    # a filter of rows would be pushed below what makes the pages, and have them made twice
    return documents.select("doc_id", F.explode(F.filter(told, lambda x: x.isNotNull())).alias("content"))


def _joined(columns: list[pa.Array], first: str) -> pa.Array:
    """Snapshots of documents, each at its last row, from rows (doc_id, page, line_no, raw, boxes) by document and page: the text of a line, of a page's boxes, or neither."""
    doc, page, no, raw, boxes = columns
    new_doc, new_page = changes(doc), changes(doc, page)
    d, p = np.cumsum(new_doc), np.cumsum(new_page)
    lines, after = (np.flatnonzero(x.is_valid().to_numpy(zero_copy_only=False)) for x in (raw, boxes))
    starts = np.append(0, np.flatnonzero(new_page))
    some = np.unique(np.concatenate([p[lines], p[after]]))
    heads = pc.binary_join_element_wise("=== page ", page.take(pa.array(starts[some])).cast(pa.string()), " ===", "")
    pieces = pa.concat_arrays([raw.take(pa.array(lines)), boxes.take(pa.array(after)), heads])
    at = np.concatenate([p[lines], p[after], some])
    rank = np.repeat([1, 2, 0], [len(lines), len(after), len(some)])
    order = np.lexsort((np.concatenate([numbers(no)[lines], np.zeros(len(after) + len(some), np.int64)]), rank, at))
    ends = np.searchsorted(d[starts][at[order]], np.arange(d[-1] + 2))
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pieces.take(pa.array(order))), "\n")
    texts = pc.binary_join_element_wise(first, texts, "\n", "")
    last = np.append(new_doc[1:], True) & (np.diff(ends) > 0)[d]
    return texts.take(pa.array(d, mask=~last))


def render_judged(judged: DataFrame, classifier: str) -> DataFrame:
    """(doc_id, content), as render_snapshots has it, of lines that sheets.judged told, named by verdicts.named_rows: lines are quoted where they are, and joined document by document."""
    box = lambda b: F.concat(F.lit("region -> REDACT ["), F.concat_ws(", ", *(b[c].cast("string") for c in ("x0", "y0", "x1", "y1"))), F.lit("]"))
    boxes = F.array_sort(F.transform("rs", lambda b: F.struct(b["kind"].alias("at"), box(b).alias("raw"))))
    raw = F.concat(line_header(), F.lit("\n"), verdict_text(F.col("kind"), F.col("reason"), F.col("coverage")))
    rows = judged.select(*LINE, F.when(F.col("full"), raw).alias("raw"), F.when(F.size("rs") > 0, F.array_join(F.transform(boxes, lambda b: b["raw"]), "\n")).alias("boxes"))
    first = f"# classifier: {classifier}\n"
    return rows.select("doc_id", by_documents(lambda c: _joined(c, first), "string", *map(F.col, rows.columns)).alias("content")).where("content IS NOT NULL")


def compare_verdicts(actual: DataFrame, expected: DataFrame, ignore_text: bool = False) -> DataFrame:
    """(doc_id, page, line_no, failure): a full join by position. With ignore_text a line is known by its geometry alone."""
    a = actual.select(*LINE, F.col("line").alias("a_line"), F.col("kind").alias("a_kind"), F.col("reason").alias("a_reason"))
    b = expected.select(*LINE, F.col("line").alias("b_line"), F.col("kind").alias("b_kind"), F.col("reason").alias("b_reason"))
    joined = a.join(b, LINE, "full")
    differs = _difference(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}"), ignore_text)
    failure = F.when(F.col("a_line").isNull(), "missing line").when(F.col("b_line").isNull(), "unexpected line").otherwise(differs)
    return joined.select(*LINE, failure.alias("failure")).where("failure IS NOT NULL")


def _difference(a: Callable[[str], Column], b: Callable[[str], Column], ignore_text: bool) -> Column:
    """How two lines at one position differ in line, kind and reason; null if they don't."""
    cut = (lambda c: F.substring_index(c, "): ", 1)) if ignore_text else (lambda c: c)
    shown = lambda x: F.concat(x("kind"), F.coalesce(F.concat(F.lit(" ("), x("reason"), F.lit(")")), F.lit("")))
    head = F.element_at(F.split(a("line"), ": ", 2), -1)
    return F.when(~(cut(a("line")) == cut(b("line"))), "the snapshot was written for different OCR output").when(
        ~(a("kind").eqNullSafe(b("kind")) & a("reason").eqNullSafe(b("reason"))), F.concat(excerpt(head), F.lit(": expected "), shown(b), F.lit(", got "), shown(a))
    )


def compare_page(actual: Column, expected: Column, ignore_text: bool = False) -> Column:
    """compare_verdicts of one page, where both sides lie in one row as arrays of (line_no, line, kind, reason): an array of (line_no, failure).
    Sorted by number, a line stands just before the one expected in its place; a side has a number once."""
    side = lambda n: lambda x: F.struct(x["line_no"].alias("at"), F.lit(n).alias("side"), x["line"].alias("line"), x["kind"].alias("kind"), x["reason"].alias("reason"))

    def told(xs: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            before, after = F.get(xs, i - 1), F.get(xs, i + 1)
            own = F.when(after["at"].eqNullSafe(x["at"]), _difference(lambda c: x[c], lambda c: after[c], ignore_text)).otherwise("unexpected line")
            return F.struct(x["at"].alias("line_no"), F.when(x["side"] == 0, own).when(~before["at"].eqNullSafe(x["at"]), "missing line").alias("failure"))

        return F.filter(F.transform(xs, one), lambda x: x["failure"].isNotNull())

    both = F.array_sort(F.concat(F.transform(actual, side(0)), F.transform(expected, side(1))))
    return F.element_at(F.transform(F.array(both), told), 1)


def _compared(columns: list[pa.Array], ignore_text: bool) -> pa.Array:
    """compare_page's failure, or null, of each row (doc_id, page, line_no, side, line, kind, reason) by document and page; side: 0 actual, 1 expected."""
    doc, page, no, side, line, kind, reason = columns
    p, at, side, null = np.cumsum(changes(doc, page)), numbers(no), numbers(side), no.is_null().to_numpy(zero_copy_only=False)
    o = np.lexsort((side, at, null, p))
    p, at, side, null = (x[o] for x in (p, at, side, null))
    met = np.zeros(len(o) + 1, bool)
    met[1:-1] = (p[1:] == p[:-1]) & (at[1:] == at[:-1]) & (null[1:] == null[:-1])
    failure = np.full(len(o), None, object)
    failure[o[(side == 0) & ~met[1:]]] = "unexpected line"
    failure[o[(side == 1) & ~met[:-1]]] = "missing line"
    a = np.flatnonzero((side == 0) & met[1:])
    a, b = o[a], o[a + 1]
    cut = (lambda x: pa.array([None if y is None else y.split("): ", 1)[0] for y in x.to_pylist()], pa.string())) if ignore_text else (lambda x: x)
    own = lambda c, rows: c.take(pa.array(rows))
    other = pc.fill_null(pc.not_equal(cut(own(line, a)), cut(own(line, b))), False).to_numpy(zero_copy_only=False)
    failure[a[other]] = "the snapshot was written for different OCR output"
    a, b = a[~other], b[~other]
    unlike = lambda c: pc.not_equal(pc.fill_null(own(c, a), "\0"), pc.fill_null(own(c, b), "\0")).to_numpy(zero_copy_only=False)
    k = np.flatnonzero(unlike(kind) | unlike(reason))
    shown = lambda rows: [x and x + (f" ({y})" if y is not None else "") for x, y in zip(own(kind, rows).to_pylist(), own(reason, rows).to_pylist())]
    for row, text, got, want in zip(a[k], own(line, a[k]).to_pylist(), shown(a[k]), shown(b[k])):
        head = None if text is None else text.split(": ", 1)[-1]
        if None not in (head, got, want):
            failure[row] = f"{head if len(head) <= 48 else head[:47] + '…'}: expected {want}, got {got}"
    return pa.array(failure, pa.string())


def compare_sides(rows: DataFrame, ignore_text: bool = False) -> DataFrame:
    """compare_verdicts of rows (doc_id, page, line_no, side, line, kind, reason), by document and page, with both sides of a page among each other."""
    columns = [F.col(c) for c in (*LINE, "side", "line", "kind", "reason")]
    failure = by_documents(lambda c: _compared(c, ignore_text), "string", *columns)
    return rows.select(*LINE, failure.alias("failure")).where("failure IS NOT NULL")


def compare_regions(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """(doc_id, page, x0, y0, x1, y1, failure): what either bag of boxes has beyond the other."""
    cols = [*PAGE, "x0", "y0", "x1", "y1"]
    a, b = actual.select(cols), expected.select(cols)
    return a.exceptAll(b).withColumn("failure", F.lit("unexpected region")).unionByName(b.exceptAll(a).withColumn("failure", F.lit("missing region")))


def plan_dumps(files: DataFrame) -> DataFrame:
    """files (path) with `out`, its dump's place, and `skipped`: whether a file before it in order dumps to the same place."""
    out = F.concat(F.regexp_replace("path", r"\.[^./]*$", ""), F.lit("_ocr.txt"))
    first = F.row_number().over(Window.partitionBy("out").orderBy("path"))
    return files.withColumn("out", out).withColumn("skipped", first > 1)


