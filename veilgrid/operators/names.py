"""Name memory: names harvested from lines that label a person, met again on this or a later page of the document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import capital_words, is_name_evidence, name_tokens
from ..schema import LINE, PAGE, by_document


def harvested_names(lines: DataFrame) -> DataFrame:
    """Distinct (doc_id, page, name)."""
    told = lines.where(is_name_evidence(F.col("text")))
    return told.select("doc_id", "page", F.explode(name_tokens(F.col("text"))).alias("name")).distinct()


def name_memory_hits(lines: DataFrame) -> DataFrame:
    """(doc_id, page, line_no) of lines with a harvested name as a whole word that begins with a capital, in any case otherwise.

    A name is letters only, so it stands as a whole word exactly if one of the line's words equals it: words are held against the
    names that the document has up to this page, after one shuffle by document and one look at each text.
    """
    text, nothing = F.col("text"), F.array().cast("array<string>")
    names = F.when(is_name_evidence(text), F.transform(name_tokens(text), F.lower)).otherwise(nothing)
    told = by_document(lines).select(*LINE, names.alias("names"), capital_words(text).alias("words"))
    pages = told.groupBy(*PAGE).agg(F.collect_list(F.struct("line_no", "words")).alias("ls"), F.array_distinct(F.flatten(F.collect_list("names"))).alias("own"))
    so_far = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    known = F.array_distinct(F.flatten(F.collect_list("own").over(so_far)))
    pages = pages.select(*PAGE, "ls", known.alias("known")).where(F.size("known") > 0)
    hits = F.filter("ls", lambda x: F.arrays_overlap(x["words"], F.col("known")))
    return pages.select(*PAGE, F.explode(F.array_distinct(F.transform(hits, lambda x: x["line_no"]))).alias("line_no"))
