import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilgrid.config import AssembleOptions, Config, RedactOptions, load_config
from veilgrid.functions.text import python_repr
from veilgrid.operators import verdicts
from veilgrid.plans import engine, report
from veilgrid.schema import LINES
from veilgrid.sources import dumps, files
from veilgrid.streaming.names import name_memory_stream

DUMP = """# document: a.pdf
=== page 0 (1000x1000) ===
line @(0,10 100x10 conf=99.5): 'Patient Mustermann, Max'

line @(-5,30 40x12 conf=None): "it's"
=== page 1 (900x800) ===
"""


def test_dumps_round_trip(spark, tmp_path):
    (tmp_path / "a_ocr.txt").write_text(DUMP, encoding="utf-8")
    (tmp_path / "other.txt").write_text("no dump")
    lines, pages = dumps.parse_dump(dumps.read_texts(spark, str(tmp_path)))
    got = [(r.page, r.line_no, r.text, r.left, r.top, r.width, r.height, r.conf) for r in lines.orderBy("page", "line_no").collect()]
    assert got == [(0, 0, "Patient Mustermann, Max", 0, 10, 100, 10, 99.5), (0, 1, "it's", -5, 30, 40, 12, None)]
    assert [(r.page, r.width, r.height) for r in pages.orderBy("page").collect()] == [(0, 1000, 1000), (1, 900, 800)]
    text = dumps.render_dump(lines, pages, "onnx").first().content
    assert [x for x in text.split("\n") if not x.startswith("#")] == [x for x in DUMP.split("\n") if x and not x.startswith("#")] + [""]


@pytest.mark.parametrize("bad", ["=== page 0 ===\n", "=== page 0 (1x1) ===\nhello\n", "line @(0,0 1x1 conf=None): 'x'\n"])
def test_bad_dumps_fail(spark, tmp_path, bad):
    (tmp_path / "b_ocr.txt").write_text(bad)
    with pytest.raises(Exception, match="page header without a size|not an OCR line|before any page header"):
        lines, pages = dumps.parse_dump(dumps.read_texts(spark, str(tmp_path)))
        lines.collect(), pages.collect()


SNAPSHOT = """# classifier: x
=== page 0 ===
line @(0,10 100x10 conf=99.5): 'Patient'
      Ignoring PERSON
    -> REDACT (static-rule)
line @(0,30 100x10 conf=99.5): 'x'
    -> PARTIAL 40% (overlap)
line @(0,60 100x10 conf=99.5): 'y'
region -> REDACT [0, -2, 10, 20]
"""


def test_snapshots(spark, tmp_path):
    (tmp_path / "a.expected.txt").write_text(SNAPSHOT)
    v, r = dumps.parse_snapshot(dumps.read_texts(spark, str(tmp_path), "*.expected.txt"))
    assert [(x.page, x.line_no, x.kind, x.reason) for x in v.orderBy("line_no").collect()] == [(0, 0, "REDACT", "static-rule"), (0, 1, "PARTIAL", "overlap"), (0, 2, "keep", None)]
    assert [tuple(x)[1:] for x in r.collect()] == [(0, 0, -2, 10, 20)]
    (tmp_path / "b.expected.txt").write_text("code -> REDACT [0, 0, 1, 1]\n")
    with pytest.raises(Exception, match="not replayed"):
        dumps.parse_snapshot(dumps.read_texts(spark, str(tmp_path), "b.expected.txt"))[1].collect()


def test_comparison(spark):
    schema = "doc_id long, page int, line_no int, line string, kind string, reason string"
    a = spark.createDataFrame([(1, 0, 0, "line @(0,0 1x1 conf=1): 'a'", "keep", None), (1, 0, 1, "line @(0,5 1x1 conf=1): 'b'", "REDACT", "region")], schema)
    b = spark.createDataFrame([(1, 0, 0, "line @(0,0 1x1 conf=1): 'z'", "keep", None), (1, 0, 1, "line @(0,5 1x1 conf=1): 'b'", "keep", None), (1, 0, 2, "l", "keep", None)], schema)
    assert sorted(r.line_no for r in dumps.compare_verdicts(a, b).collect()) == [0, 1, 2]
    loose = {r.line_no: r.failure for r in dumps.compare_verdicts(a, b, ignore_text=True).collect()}
    assert sorted(loose) == [1, 2] and loose[1] == "'b': expected keep, got REDACT (region)"
    box = lambda *xs: spark.createDataFrame([(1, 0, *x) for x in xs], "doc_id long, page int, x0 int, y0 int, x1 int, y1 int")
    got = dumps.compare_regions(box((0, 0, 1, 1), (0, 0, 1, 1)), box((0, 0, 1, 1), (5, 5, 6, 6))).collect()
    assert sorted(r.failure for r in got) == ["missing region", "unexpected region"]


def test_snapshot_text(spark):
    lines = spark.createDataFrame([(1, 0, 0, "Muster GmbH", 0, 20, 100, 20, 99.0), (1, 0, 1, "Rechnung", 300, 600, 80, 20, None)], LINES)
    from veilgrid.operators.regions import region_boxes

    text = dumps.render_snapshot(verdicts.outcomes(lines, 1000, 1000), region_boxes(lines, 1000, 1000), "patterns").first().content
    assert text == "# classifier: patterns\n=== page 0 ===\nline @(0,20 100x20 conf=99.0): 'Muster GmbH'\n    -> REDACT (static-rule)\nline @(300,600 80x20 conf=None): 'Rechnung'\n    -> keep\nregion -> REDACT [0, 0, 1000, 42]\n"
    more = lines.union(spark.createDataFrame([(1, 0, 2, "Tel. 0231 / 123456 oder 01.02.2024", 0, 700, 300, 20, 98.5), (1, 1, 0, " ", 0, 0, 1, 1, None)], LINES))
    codes = spark.createDataFrame([(1, 0, 5, 6, 7, 8)], "doc_id long, page int, x0 int, y0 int, x1 int, y1 int")
    said = [(r.page, r.message) for r in verdicts.trace(more, regions=region_boxes(lines, 1000, 1000), codes=codes).orderBy("page", "line_no", "seq").collect()]
    assert [m for p, m in said if p == 0][:5] == ["=== page 0 ===", "line @(0,20 100x20 conf=99.0): 'Muster GmbH'", "    rule ORG_LEGAL matched 'GmbH'", "    -> REDACT (static-rule)", "line @(300,600 80x20 conf=None): 'Rechnung'"]
    assert said[-3:] == [(0, "region -> REDACT [0, 0, 1000, 42]"), (0, "code -> REDACT [5, 6, 7, 8]"), (1, "=== page 1 ===")]
    found = spark.createDataFrame([(2, 0, 0, "Karte 4111111111111111 und 0123456789", 0, 700, 300, 20, 98.5)], LINES)
    assert [(r.line_no, r.seq, r.message) for r in verdicts.trace(found).orderBy("line_no", "seq").collect()][2:] == [
        (0, 1, "    match CREDIT_CARD 1.00 '4111111111111111' [pattern]"), (0, 2, "      Ignoring PHONE_NUMBER '0123456789': a date or an identifier"), (0, 3, "    -> REDACT (classifier)"),
    ]


def test_inputs_and_guards(spark, tmp_path):
    for name, data in (("a.pdf", b"%PDF-1.4"), ("b.PNG", b"\x89PNG...."), ("c_redacted.pdf", b"%PDF"), ("d.txt", b"x"), ("e.jpg", b"nope"), ("f.png", b"")):
        (tmp_path / name).write_bytes(data)
    got = files.checked_inputs(files.collect_inputs(spark, str(tmp_path)), Config()).select(F.element_at(F.split("path", "/"), -1), "status").collect()
    assert dict(map(tuple, got)) == {"a.pdf": 200, "b.PNG": 200, "e.jpg": 400}  # the source leaves out files without bytes
    planned = dumps.plan_dumps(spark.createDataFrame([("/x/a.pdf",), ("/x/a.png",)], "path string")).orderBy("path").collect()
    assert [(r.out, r.skipped) for r in planned] == [("/x/a_ocr.txt", False), ("/x/a_ocr.txt", True)]
    pages = spark.createDataFrame([(1, i, 10, 10) for i in range(31)] + [(2, 0, 9000, 9000), (3, 0, 10, 10)], "doc_id long, page int, width int, height int")
    assert sorted(r.doc_id for r in files.page_guards(pages, Config()).collect()) == [1, 2]


def test_assemble_bodies(spark):
    body = lambda **k: json.dumps(k)
    rows = [(1, body(pages=[{"data": "YWI=", "boxes": [[1, 2, 3, 4]]}])), (2, body(pages=[])), (3, "no json"), (4, body(pages=[{"data": "YWI=", "boxes": [[1, 2]]}])), (5, body(pages=[{"data": "?"}]))]
    got = {r.doc_id: r for r in files.parse_assemble(spark.createDataFrame(rows, "doc_id long, body string")).collect()}
    assert bytes(got[1].content) == b"ab" and got[1].boxes == [[1, 2, 3, 4]] and got[1].detail is None
    assert all(got[i].detail for i in (2, 3, 4, 5))


def test_options_and_settings(tmp_path):
    c = Config()
    assert RedactOptions.from_query({"json-output": "true", "pdf-dpi": "300"}, c) == RedactOptions(True, True, 300, 90, False)
    for raw, said in (({"json_output": "1"}, "unknown parameter 'json_output'"), ({"pdf-dpi": "10"}, "greater than or equal to 36"), ({"debug": "1"}, "requires json-output"), ({"unwarp": "maybe"}, "boolean")):
        with pytest.raises(ValueError, match=said):
            RedactOptions.from_query(raw, c)
    with pytest.raises(ValueError):
        AssembleOptions.from_query({"format": "gif"}, c)
    (tmp_path / "c.toml").write_text('[engine]\nname = "onnx"\n[redaction.regions]\nheader_frac = 0.2\n')
    got = load_config(str(tmp_path / "c.toml"), {})
    assert got.models() == {"name": "onnx", "ocr": "onnxruntime", "classifier": "presidio"} and got.redaction.regions.header_frac == 0.2
    assert Config({"engine": {"name": "onnx", "ocr_backend": "paddle"}}).models()["ocr"] == "paddle"
    env = {"PII_CONFIG": str(tmp_path / "c.toml"), "PII_ENGINE": "native", "PII_UNWARP": "off", "PII_REDACT_REGIONS": "no", "PII_REDACT_CODES": "0"}
    got = load_config(None, env)
    assert got.engine.name == "native" and not (got.redaction.unwarp or got.redaction.redact_regions or got.redaction.redact_codes) and got.redaction.regions.header_frac == 0.2
    with pytest.raises(ValueError, match="redaction.unwarp: Input should be a valid boolean"):
        load_config(None, {"PII_UNWARP": "maybe"})
    with pytest.raises(ValueError, match="redaction.padding: .*; api.port: Input should be less"):
        Config({"redaction": {"padding": "x"}, "api": {"port": 70000}})
    with pytest.raises(ValueError, match="pdf-dpi: .*; jpeg-quality: "):
        RedactOptions.from_query({"pdf-dpi": "x", "jpeg-quality": 0}, c)
    with pytest.raises(AttributeError):
        c.engine.name = "onnx"
    for bad in ("[redaction]\nunwarp = \"maybe\"\n", "[extra]\nx = 1\n", "[api]\nport = \"x\"\n", "[redaction.regions]\ngap_factor = 1\n", "[redaction]\nfill = [1]\n", "[engine]\nname = 'gliner'\n", "[redaction.regions]\nheader_frac = 0.9\n"):
        (tmp_path / "c.toml").write_text(bad)
        with pytest.raises(ValueError):
            load_config(str(tmp_path / "c.toml"), {})


def test_reports_and_documents(spark):
    white = bytearray(np.full((4, 6, 3), 255, np.uint8).tobytes())
    pages = spark.createDataFrame([(1, 0, 6, 4, 3, white), (1, 1, 6, 4, 3, white), (2, 0, 6, 4, 3, white)], "doc_id long, page int, width int, height int, channels int, data binary")
    kinds = spark.createDataFrame([(1, True), (2, False)], "doc_id long, is_pdf boolean")
    opts = RedactOptions(False, True, 72, 90, False)
    rendered = report.render_documents(pages, kinds, opts)
    assert {r.doc_id: r.content_type for r in rendered.collect()} == {1: "application/pdf", 2: "image/png"}
    boxes = spark.createDataFrame([(1, 0, 1, 0, 0, 2, 2), (1, 0, 0, 1, 1, 3, 3)], "doc_id long, page int, seq int, x0 int, y0 int, x1 int, y1 int")
    got = {r.doc_id: json.loads(r.report) for r in report.build_reports(pages, boxes, rendered, opts).collect()}
    assert got[1]["pages"][0]["boxes"] == [[1, 1, 3, 3], [0, 0, 2, 2]] and got[1]["pages"][1]["boxes"] == [] and "debug" not in got[1] and not got[1]["unwarped"]
    assert len(report.assemble(pages, boxes, AssembleOptions("pdf", 72, 90)).collect()) == 2
    with pytest.raises(Exception, match="exactly one page"):
        report.assemble(pages, boxes, AssembleOptions("jpeg", 72, 90)).collect()
    df = spark.createDataFrame([("/a/b.pdf", "image/jpeg", None), ("/a/c.png", "application/pdf", "broken")], "path string, t string, error string")
    assert [r[0] for r in df.select(report.output_path(F.col("path"), F.col("t"))).collect()] == ["/a/b_redacted.jpg", "/a/c_redacted.pdf"]
    assert report.exit_status(df).first().status == 1


def test_quoting_of_what_is_not_printable(spark):
    texts = ["a\u00a0b", "x\x0cy", "z\u200bz", "it's", 'both \' and "', "tab\t\\", "\x85", "ü€ß", "plain", "\U000e0001"]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(python_repr(F.col("text"))).collect()
    assert [r[0] for r in got] == [repr(t) for t in texts]


def test_paths_that_are_missing_or_unsupported_are_warned_of(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for n in ("b.PNG", "a.pdf", "c_redacted.png", "e.txt"):
        (tmp_path / "d" / n).write_bytes(b"x")
    (tmp_path / "one.jpg").write_bytes(b"y")
    with pytest.warns(UserWarning) as told:
        got = files.collect_inputs(spark, str(tmp_path / "d"), str(tmp_path / "one.jpg"), str(tmp_path / "none.png"), str(tmp_path / "d" / "e.txt")).collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in got) == ["a.pdf", "b.PNG", "one.jpg"]
    assert sorted(str(w.message).split(":")[0] for w in told if "skipping" in str(w.message)) == ["path not found, skipping", "unsupported file type, skipping"]
    assert files.collect_inputs(spark).count() == 0


def test_engine_follows_the_settings(spark, tmp_path):
    rows = [(1, 0, 0, "Muster GmbH", 100, 20, 200, 20, None), (1, 0, 1, "44137 Dortmund Str", 600, 400, 100, 10, None), (1, 0, 2, "Anna Muster", 100, 700, 100, 10, None), (1, 0, 3, "0231 / 1234567", 100, 800, 100, 10, None)]
    lines = spark.createDataFrame(rows, LINES)
    whole = engine.build(Config())
    assert {r.source for r in whole.boxes(lines, 1000, 1000).collect()} >= {"line", "region-header"}
    bare = engine.build(Config({"redaction": {"redact_regions": False, "redact_codes": False, "score_threshold": 0.65, "padding": 5}}))
    assert bare.regions is None and bare.code_margin is None
    assert {r.source for r in bare.boxes(lines, 1000, 1000).collect()} == {"line"}
    assert {r.line_no for r in whole.outcomes(lines, 1000, 1000).where("reason = 'classifier'").collect()} == {3}
    assert not bare.outcomes(lines, 1000, 1000).where("line_no = 3 AND kind <> 'keep'").count()
    token = lambda i, t, p: {"idx": i, "text": t, "pos": p}
    spans = spark.createDataFrame([(1, 0, 2, [token(0, "Anna", "PROPN"), token(5, "Muster", "PROPN")], 0, 11, 0.85), (1, 0, 0, [token(0, "Muster", "PROPN")], 0, 6, 0.85)], "doc_id long, page int, line_no int, tokens array<struct<idx:int,text:string,pos:string>>, start int, end int, score double")
    told = engine.build(Config(), spans=spans).outcomes(lines, 1000, 1000).where("reason = 'classifier'").collect()
    assert {r.line_no for r in told} == {2, 3}
    results = spark.createDataFrame([(str(tmp_path / "a.pdf"), "application/pdf", bytearray(b"ab"), None), (str(tmp_path / "no" / "b.png"), "image/png", bytearray(b"c"), None), (str(tmp_path / "c.png"), None, None, "broken")], "path string, content_type string, content binary, error string")
    done = engine.write_beside(results)
    got = {r.path.rsplit("/", 1)[1]: r for r in done.collect()}
    assert (tmp_path / "a_redacted.pdf").read_bytes() == b"ab" and got["a.pdf"].error is None and got["b.png"].error and got["c.png"].error == "broken"
    assert report.exit_status(done).first().status == 1
    rendered, reports = spark.createDataFrame([(1, "image/png", bytearray(b"p"))], "doc_id long, content_type string, content binary"), spark.createDataFrame([(1, "{}")], "doc_id long, report string")
    c = Config()
    assert engine.produce_output(rendered, reports, RedactOptions.from_query({}, c)).first().content_type == "image/png"
    assert bytes(engine.produce_output(rendered, reports, RedactOptions.from_query({"json-output": "1"}, c)).first().content) == b"{}"


def test_name_stream_equals_the_batch(spark, tmp_path):
    from veilgrid.operators.names import name_memory_hits

    rows = [(d, p, i, t, 0, 10 * i, 50, 8, None) for d in (1, 2) for p, ts in enumerate([["Patient Mustermann, Max", "x"], ["Diagnose Mustermann", "Weber"], ["Dr. Weber", "MUSTERMANN"]]) for i, t in enumerate(ts)]
    lines = spark.createDataFrame(rows, LINES)
    for p in range(3):
        lines.where(f"page = {p}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = name_memory_stream(stream, None).writeStream.format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("hits").collect()} == {tuple(r) for r in name_memory_hits(lines).collect()}
