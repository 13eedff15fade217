"""Outputs: the JSON report, the redacted document, files beside their inputs, and assembly from reviewed boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AssembleOptions, RedactOptions
from ..operators.images import assemble_pdf, encode_image, fill_boxes

EXTENSIONS = {"application/pdf": ".pdf", "image/jpeg": ".jpg", "image/png": ".png", "application/json": ".json"}


def artifact(content_type: Column, content: Column) -> Column:
    return F.struct(content_type.alias("content_type"), F.translate(F.base64(content), "\r\n", "").alias("data"))


def render_documents(redacted: DataFrame, documents: DataFrame, opts: RedactOptions) -> DataFrame:
    """(doc_id, content_type, content): a PDF for a PDF, else an image. By filter and union, so that neither encoder sees the other's pages.
    documents: (doc_id, is_pdf)."""
    pages = redacted.join(documents, "doc_id")
    pdfs = assemble_pdf(pages.where("is_pdf"), opts.pdf_dpi).withColumn("content_type", F.lit("application/pdf"))
    images = encode_image(pages.where("NOT is_pdf AND page = 0")).select("doc_id", "content", "content_type")
    return pdfs.unionByName(images)


def build_reports(pages: DataFrame, boxes: DataFrame, rendered: DataFrame, opts: RedactOptions, trace: DataFrame | None = None) -> DataFrame:
    """(doc_id, report): JSON with the clean pages, their boxes in order, and the redacted document. `debug` is there only if asked for."""
    own = boxes.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("seq", F.array("x0", "y0", "x1", "y1").alias("b")))).alias("bs"))
    one = F.struct(F.col("page").alias("index"), "width", "height", F.coalesce(F.transform("bs", lambda x: x["b"]), F.array().cast("array<array<int>>")).alias("boxes"), artifact(F.col("content_type"), F.col("content")).alias("image"))
    told = encode_image(pages).join(own, ["doc_id", "page"], "left").groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("pages"))
    done = rendered.select("doc_id", artifact(F.col("content_type"), F.col("content")).alias("redacted"))
    out = told.join(done, "doc_id")
    cols = [F.lit(opts.unwarp).alias("unwarped"), "pages", "redacted"]
    if opts.debug and trace is not None:
        said = trace.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "line_no", "seq", "message"))).alias("m"))
        out = out.join(said.select("doc_id", F.concat_ws("\n", F.transform("m", lambda x: x["message"])).alias("debug")), "doc_id", "left")
        cols.append("debug")
    return out.select("doc_id", F.to_json(F.struct(*cols)).alias("report"))


def output_path(path: Column, content_type: Column) -> Column:
    """Beside the input: its name with _redacted and the extension of what was made."""
    extension = F.coalesce(*(F.when(content_type == t, F.lit(e)) for t, e in EXTENSIONS.items()))
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit("_redacted"), extension)


def exit_status(results: DataFrame) -> DataFrame:
    """(status): 1 if any file failed (error not null), else 0."""
    return results.agg(F.when(F.count_if(F.col("error").isNotNull()) > 0, 1).otherwise(0).alias("status"))


def assemble(pages: DataFrame, boxes: DataFrame, opts: AssembleOptions, fill: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """(doc_id, content_type, content) from pages and reviewed boxes alone. A JPEG holds exactly one page; more fail the job."""
    done = fill_boxes(pages, boxes, fill)
    if opts.format == "pdf":
        return assemble_pdf(done, opts.dpi).withColumn("content_type", F.lit("application/pdf"))
    counts = done.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    only = F.when(F.col("n") != 1, F.raise_error(F.concat(F.lit("format 'jpeg' expects exactly one page, got "), F.col("n").cast("string"))).cast("int")).otherwise(F.col("page"))
    return encode_image(done.join(counts, "doc_id").withColumn("page", only).where("page IS NOT NULL")).select("doc_id", "content_type", "content")
