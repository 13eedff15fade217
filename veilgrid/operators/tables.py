"""Item tables: where amounts repeat row by row, the classifier doesn't run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import matches
from ..schema import PAGE, bottom, center


def median_heights(lines: DataFrame) -> DataFrame:
    """(doc_id, page, median_height) over all lines, blank ones included."""
    return lines.groupBy(*PAGE).agg(F.percentile("height", F.lit(0.5)).alias("median_height"))


def item_table_bands(lines: DataFrame) -> DataFrame:
    """(doc_id, page, band_top, band_bottom): lines with amounts that overlap are one row; rows no farther apart than TABLE_GAP
    median heights are one cluster; clusters of MIN_TABLE_ROWS rows are bands. Two scans of sorted islands, no pairs."""
    page = Window.partitionBy(*PAGE)
    sized = lines.withColumn("median_height", F.percentile("height", F.lit(0.5)).over(page))
    money = sized.where(matches(F.col("text"), P.MONEY)).select(*PAGE, "median_height", "top", bottom().alias("bottom"))
    along = page.orderBy("top", "bottom")
    so_far = F.max("bottom").over(along.rowsBetween(Window.unboundedPreceding, -1))
    rows = money.withColumn("new", F.when(F.col("top") <= so_far, 0).otherwise(1)).withColumn("row", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.groupBy(*PAGE, "row").agg(F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.first("median_height").alias("m"))
    by_row = page.orderBy("row")
    gap = F.col("top") - F.lag("bottom").over(by_row)
    rows = rows.withColumn("new", F.when(gap <= P.TABLE_GAP * F.col("m"), 0).otherwise(1)).withColumn("cluster", F.sum("new").over(by_row.rowsBetween(Window.unboundedPreceding, 0)))
    bands = rows.groupBy(*PAGE, "cluster").agg(F.min("top").alias("band_top"), F.max("bottom").alias("band_bottom"), F.count(F.lit(1)).alias("n"))
    return bands.where(F.col("n") >= P.MIN_TABLE_ROWS).select(*PAGE, "band_top", "band_bottom")


def with_item_table(lines: DataFrame) -> DataFrame:
    """lines with in_table: whether the vertical centre lies in a band of the page."""
    bands = item_table_bands(lines).groupBy(*PAGE).agg(F.collect_list(F.struct("band_top", "band_bottom")).alias("bands"))  # a page has a handful
    inside = F.exists("bands", lambda b: (b["band_top"] <= center()) & (center() <= b["band_bottom"]))
    return lines.join(bands, PAGE, "left").withColumn("in_table", F.coalesce(inside, F.lit(False))).drop("bands")
