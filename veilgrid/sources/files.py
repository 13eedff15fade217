"""Input files and request bodies, with their guards as columns: what fails a guard is set aside with a status, not thrown away."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config

# Fixed values.
SUFFIXES = ("jpg", "jpeg", "png", "pdf")
MEDIA_TYPES = {"pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg"}
BODY = T.StructType([T.StructField("pages", T.ArrayType(T.StructType([T.StructField("data", T.StringType()), T.StructField("content_type", T.StringType()), T.StructField("boxes", T.ArrayType(T.ArrayType(T.IntegerType())))])))])


def collect_inputs(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, modificationTime, length, content) of files, and of folders' supported files, one level deep, without earlier outputs, in no
    order (a sort would move all content; sort what comes of it by path). A path that isn't there, or a file of another kind, is warned of and left out. Content is read only if a later step asks for it."""
    name = F.element_at(F.split("path", "/"), -1)
    hadoop, there = spark._jvm.org.apache.hadoop.fs.Path, []
    for path in paths:
        at = hadoop(path)
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(at):
            warnings.warn(f"path not found, skipping: {path}", stacklevel=2)
        elif files.getFileStatus(at).isFile() and path.rsplit(".", 1)[-1].lower() not in SUFFIXES:
            warnings.warn(f"unsupported file type, skipping: {path}", stacklevel=2)
        else:
            there.append(path)
    if not there:
        return spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(there)
    return files.where(F.lower(F.element_at(F.split(name, r"\."), -1)).isin(*SUFFIXES) & ~name.contains("_redacted"))


def checked_inputs(files: DataFrame, config: Config) -> DataFrame:
    """files with media_type, status (200, 400, 413 or 415) and detail. Files that are too large are told apart by a filter on their length,
    which the reader knows, so their content (null here) is never read."""
    small = files.where(F.col("length") <= config.api.max_upload_bytes)
    large = files.where(F.col("length") > config.api.max_upload_bytes).withColumn("content", F.lit(None).cast("binary"))
    return _told(small, config).unionByName(_told(large, config))


def _told(files: DataFrame, config: Config) -> DataFrame:
    suffix = F.lower(F.element_at(F.split("path", r"\."), -1))
    kind = F.coalesce(*(F.when(suffix == s, F.lit(m)) for s, m in MEDIA_TYPES.items()))
    magic = F.hex(F.substring("content", 1, 4))
    good = F.when(kind == "application/pdf", magic == "25504446").when(kind == "image/png", magic == "89504E47").otherwise(F.substring(magic, 1, 4) == "FFD8")
    status = F.when(F.col("length") > config.api.max_upload_bytes, 413).when(kind.isNull() | ~kind.isin(*config.api.input_content_types), 415).when((F.col("length") == 0) | ~good, 400).otherwise(200)
    detail = F.when(status == 413, F.lit(f"body larger than {config.api.max_upload_bytes} bytes")).when(status == 415, F.lit("unsupported content type")).when(F.col("length") == 0, F.lit("empty body")).when(status == 400, F.lit("not a valid file of its type"))
    return files.withColumn("media_type", kind).withColumn("status", status).withColumn("detail", detail)


def page_guards(pages: DataFrame, config: Config) -> DataFrame:
    """(doc_id, detail) of documents whose pages (doc_id, page, width, height) are too many, or one of them too large: rejected, not cut."""
    big = F.max(F.col("width").cast("long") * F.col("height")) > config.api.max_image_pixels
    many = F.count(F.lit(1)) > config.redaction.max_pages
    seen = pages.groupBy("doc_id").agg(big.alias("big"), many.alias("many"))
    return seen.where("big OR many").select("doc_id", F.when(F.col("many"), f"more than {config.redaction.max_pages} pages").otherwise(f"a page exceeds {config.api.max_image_pixels} pixels").alias("detail"))


def parse_assemble(bodies: DataFrame) -> DataFrame:
    """(doc_id, page, content, boxes, detail) of assemble requests (doc_id, body): at least one page, data in base64, boxes of four.
    A body that isn't so has one row with the detail and no page."""
    parsed = bodies.withColumn("b", F.from_json("body", BODY, {"mode": "PERMISSIVE"}))
    empty = F.col("b").isNull() | F.col("b.pages").isNull() | (F.size("b.pages") < 1)
    wrong = F.exists("b.pages", lambda p: F.coalesce(F.exists(p["boxes"], lambda x: F.size(x) != 4), F.lit(False)))
    no_data = F.exists("b.pages", lambda p: p["data"].isNull() | ~p["data"].rlike("^[A-Za-z0-9+/\\s]*={0,2}$"))
    detail = F.when(empty, "pages: List should have at least 1 item").when(no_data, "data: Base64 decoding error").when(wrong, "boxes: a box has four numbers")
    rows = parsed.withColumn("detail", detail)
    bad = rows.where("detail IS NOT NULL").select("doc_id", F.lit(None).cast("int").alias("page"), F.lit(None).cast("binary").alias("content"), F.lit(None).cast("array<array<int>>").alias("boxes"), "detail")
    good = rows.where("detail IS NULL").select("doc_id", F.posexplode("b.pages").alias("page", "p"))
    return good.select("doc_id", "page", F.unbase64("p.data").alias("content"), F.coalesce("p.boxes", F.array()).alias("boxes"), F.lit(None).cast("string").alias("detail")).unionByName(bad)
