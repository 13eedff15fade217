"""The engine that settings describe: classifier, regions and codes joined to boxes, outputs chosen and written."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config, RedactOptions
from ..functions import patterns as P
from ..functions.text import entities, person_tokens
from ..operators import codes, verdicts
from ..operators.images import fill_boxes
from ..operators.regions import RegionParams
from ..schema import LINE, PAGE
from .report import output_path


def person_lines(spans: DataFrame, least: float) -> DataFrame:
    """Lines with a person: spans (line, tokens, start, end, score) of a language model that score enough and are worth two name tokens."""
    worth = F.filter(F.array(person_tokens(F.col("tokens"), F.col("start"), F.col("end"))), lambda n: n >= 2)
    return spans.where(F.col("score") >= least).select(*LINE, F.explode(worth)).select(*LINE).distinct()  # a filter would evaluate what tokens are made of for each mention of them


def classifier(config: Config, kinds: tuple[str, ...] = tuple(P.PII_ENTITIES), spans: DataFrame | None = None) -> verdicts.Classifier:
    """The classifier for the settings' threshold: recognisers that stay in the JVM, and a model's PERSON spans where there are any."""
    least = config.redaction.score_threshold
    by_pattern = verdicts.patterns(kinds, least)
    if spans is None or "PERSON" not in kinds:
        return by_pattern

    def told(lines: DataFrame) -> DataFrame:
        persons = person_lines(spans, least).withColumn("__person", F.lit(True))
        found = F.size(entities(F.col("text"), kinds, least)) > 0
        return lines.join(persons, LINE, "left").withColumn("pii", found | F.coalesce("__person", F.lit(False))).drop("__person")

    return told


@dataclass(frozen=True)
class Engine:
    """Parts as the settings have them; None where a part is turned off."""

    classifier: verdicts.Classifier
    regions: RegionParams | None
    code_margin: float | None
    padding: int
    fill: tuple[int, int, int]

    def boxes(self, lines: DataFrame, width: int, height: int, reads: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
        """(doc_id, page, source, x0, y0, x1, y1) of lines, regions and codes. Codes come from reads that are made already, or from page images."""
        found = None
        if self.code_margin is not None and reads is not None:
            found = codes.code_boxes(reads, None, self.code_margin, self.padding, width, height)
        elif self.code_margin is not None and pages is not None:
            found = codes.code_pass(pages, self.code_margin, self.padding)
        return verdicts.all_boxes(lines, width, height, self.regions, self.classifier, found, self.padding)

    def outcomes(self, lines: DataFrame, width: int, height: int) -> DataFrame:
        return verdicts.outcomes(lines, width, height, self.regions, self.classifier, self.padding)

    def redact(self, pages: DataFrame, boxes: DataFrame) -> DataFrame:
        """Page images with their boxes painted over."""
        return fill_boxes(pages, boxes.select(*PAGE, "x0", "y0", "x1", "y1"), self.fill)


def build(config: Config, kinds: tuple[str, ...] = tuple(P.PII_ENTITIES), spans: DataFrame | None = None) -> Engine:
    """An engine from settings: redact_regions and redact_codes turn their parts off, padding and fill hold for all."""
    r = config.redaction
    return Engine(classifier(config, kinds, spans), RegionParams(**r.regions, padding=r.padding) if r.redact_regions else None, r.code_margin_frac if r.redact_codes else None, r.padding, r.fill)


def produce_output(rendered: DataFrame, reports: DataFrame, opts: RedactOptions) -> DataFrame:
    """(doc_id, content_type, content): the JSON report if it is asked for, else the redacted document."""
    if not opts.json_output:
        return rendered.select("doc_id", "content_type", "content")
    return reports.select("doc_id", F.lit("application/json").alias("content_type"), F.col("report").cast("binary").alias("content"))


def write_beside(results: DataFrame) -> DataFrame:
    """Writes results (path, content_type, content, error) beside their inputs; returns (path, written, error).

    Runs where the rows are, one file each, under another name until it is whole. A row that has an error already, or whose file can't be
    written, keeps the others from nothing: its error is told, and exit_status counts it."""
    from pyarrow import fs

    to = results.withColumn("to", output_path(F.col("path"), F.col("content_type"))).select("path", "to", "content", "error")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done, faults = [], []
            for to_, content, error in zip(*(b.column(c).to_pylist() for c in ("to", "content", "error")), strict=True):
                try:
                    if error is None and (to_ is None or content is None):
                        error = "nothing to write"
                    if error is None:
                        files, at = fs.FileSystem.from_uri(to_) if ":" in to_.split("/")[0] else (fs.LocalFileSystem(), to_)
                        with files.open_output_stream(f"{at}.tmp") as f:
                            f.write(content)
                        files.move(f"{at}.tmp", at)
                except (OSError, ValueError, pa.ArrowException) as e:
                    error = str(e)
                done.append(to_ if error is None else None)
                faults.append(error)
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(done, pa.string()), pa.array(faults, pa.string())], ["path", "written", "error"])

    return to.mapInArrow(run, "path string, written string, error string")
