"""The relations of the engine, with explicit types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE = ["doc_id", "page"]
LINE = ["doc_id", "page", "line_no"]

LINES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("page", T.IntegerType()), T.StructField("line_no", T.IntegerType()),
    T.StructField("text", T.StringType()), T.StructField("left", T.IntegerType()), T.StructField("top", T.IntegerType()),
    T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("conf", T.DoubleType()),
])
#: A box belongs to the pixel space of its page's image.
BOX = "x0 int, y0 int, x1 int, y1 int"


def bottom() -> Column:
    return F.col("top") + F.col("height")


def center() -> Column:
    return F.col("top") + F.col("height") / 2


def by_document(rows: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """rows with a document's in one partition, of as many as `like` (rows, if there is none) says in the metadata of doc_id. Rows that
    are dealt out so already are not shuffled: Spark leaves a repartition to the same partitioning out."""
    dealt = (rows if like is None else like).schema["doc_id"].metadata.get("dealt")
    return rows.repartition(dealt, "doc_id") if dealt else rows.repartition("doc_id")
