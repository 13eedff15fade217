import random
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilgrid.functions import patterns as P
from veilgrid.operators import codes, images, labels, names, regions, tables, verdicts
from veilgrid.schema import LINES


def page(spark, lines, doc=1, no=0):
    """Lines as (text, left, top, width, height)."""
    return spark.createDataFrame([(doc, no, i, *x, 99.0) for i, x in enumerate(lines)], LINES)


def at(text, top, left=0, width=100, height=10):
    return (text, left, top, width, height)


def numbers(df):
    return sorted(r.line_no for r in df.collect())


def labeled(spark, lines):
    return numbers(labels.labeled_values(page(spark, lines)))


def test_birth_date_beside_its_label(spark):
    assert labeled(spark, [at("Geburtstag", 100), at("01.02.1980", 101), at("Rechnungsdatum 05.06.2024", 200)]) == [1]
    assert labeled(spark, [at("Geb.Nr.", 50), at("11.03.2024", 51)]) == []


def test_column_below_a_header(spark):
    head = at("Geburtsdatum", 100, 200, 120)
    assert labeled(spark, [head, at("01.02.1980", 130, 205), at("03.04.1990", 160, 205)]) == [1, 2]
    assert labeled(spark, [head, at("01.02.1980", 400, 205)]) == []
    assert labeled(spark, [head, at("Summe", 112, 205), at("01.02.1980", 130, 205)]) == []


def test_details_below_a_name(spark):
    lines = [at("Behandelte Person:", 100), at("Max Mustermann", 101, 200), at("01.01.1990", 115, 200), at("A123456789", 129, 200), at("Rechnung", 143, 200)]
    assert labeled(spark, lines) == [1, 2, 3]


def test_item_tables(spark):
    lines = [at("Kopf", 100), at("4,66", 220, 300), at("Beratung", 222), at("Wort", 240), at("1.234,56", 250, 300), at("Fuß", 600)]
    assert numbers(tables.with_item_table(page(spark, lines)).where("in_table")) == [1, 2, 3, 4]
    assert numbers(tables.with_item_table(page(spark, [at("4,66", 10), at("x", 30)])).where("in_table")) == []
    assert numbers(tables.with_item_table(page(spark, [at("9,99", 100), at("x", 200), at("y", 300), at("1,00", 400), at("2,00", 420)])).where("in_table")) == [3, 4]


def test_bands_equal_a_loop(spark):
    rng = random.Random(3)
    rows, want = [], set()
    for doc in range(60):
        lines = [("1,00" if rng.random() < 0.5 else "x", 0, rng.randrange(0, 400), 10, rng.randrange(5, 25)) for _ in range(rng.randrange(1, 15))]
        rows += [(doc, 0, i, *x, None) for i, x in enumerate(lines)]
        merged = []
        for top, end in sorted((x[2], x[2] + x[4]) for x in lines if x[0] == "1,00"):
            if merged and top <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], end)
            else:
                merged.append([top, end])
        gap, groups = 3 * median(x[4] for x in lines), []
        for r in merged:
            if groups and r[0] - groups[-1][-1][1] <= gap:
                groups[-1].append(r)
            else:
                groups.append([r])
        want |= {(doc, g[0][0], g[-1][1]) for g in groups if len(g) > 1}
    got = {(r.doc_id, r.band_top, r.band_bottom) for r in tables.item_table_bands(spark.createDataFrame(rows, LINES)).collect()}
    assert got == want


def test_name_memory_reaches_forward_only(spark):
    first, second = page(spark, [at("Patient Mustermann, Max", 10)]), page(spark, [at("Diagnose Mustermann", 10), at("mustermann klein", 30), at("MUSTERMANN", 50)], no=1)
    got = {(r.page, r.line_no) for r in names.name_memory_hits(first.union(second)).collect()}
    assert got == {(0, 0), (1, 0), (1, 2)}
    assert names.name_memory_hits(second).count() == 0
    turned = page(spark, [at("Diagnose Mustermann", 10)], no=0).union(page(spark, [at("Patient Mustermann, Max", 10)], no=1))
    assert {(r.page, r.line_no) for r in names.name_memory_hits(turned).collect()} == {(1, 0)}


def boxes(spark, lines, **kw):
    p = regions.RegionParams(**({"padding": 0} | kw))
    return sorted((r.kind, r.x0, r.y0, r.x1, r.y1) for r in regions.region_boxes(page(spark, lines), 1000, 1000, p).collect())


BANDS = {"header_frac": 0.1, "footer_frac": 0.1, "column_x_frac": 1.0, "column_y_frac": 0.0, "recipient_y_max_frac": 0.0, "recipient_y_min_frac": 0.0}


def test_bands_follow_their_blocks(spark):
    assert boxes(spark, [at("Muster GmbH", 20, 0, 100, 20)], **BANDS) == [("header", 0, 0, 1000, 40)]
    assert boxes(spark, [at("Muster GmbH", 10, 0, 100, 170), at("HRB 1234", 700, 0, 100, 250)], **BANDS) == [("footer", 0, 850, 1000, 1000), ("header", 0, 0, 1000, 150)]
    assert boxes(spark, [at("Rechnung", 20)], **BANDS) == []
    assert boxes(spark, [at("Muster GmbH", 20)], **BANDS | {"header_frac": 0.0}) == []


COLUMN = {"header_frac": 0.0, "footer_frac": 0.0, "column_x_frac": 0.5, "column_y_frac": 0.5, "vgap_factor": 0.5, "recipient_y_max_frac": 0.0, "recipient_y_min_frac": 0.0}


def test_sender_blocks_grow_over_adjacent_lines(spark):
    block = [at("Muster GmbH", 200, 600, 100, 20), at("Zeile", 222, 600, 200, 20), at("Zeile", 244, 600, 80, 20)]
    assert boxes(spark, block, **COLUMN) == [("sender", 600, 200, 800, 264)]
    assert boxes(spark, [block[0], at("weit", 235, 600, 100, 20), at("daneben", 220, 700, 100, 20)], **COLUMN) == [("sender", 600, 200, 700, 220)]


def test_recipient_block_reaches_its_unmatched_lines(spark):
    lines = [at("Herrn", 200, 100, 120, 20), at("c/o Hof", 222, 100, 120, 20), at("Max Muster", 244, 100, 120, 20), at("Musterweg 3", 266, 100, 120, 20), at("12345 Musterstadt", 288, 100, 120, 20)]
    assert boxes(spark, lines, header_frac=0.0, footer_frac=0.0, column_y_frac=0.0) == [("recipient", 100, 200, 220, 308)]


def test_components_do_not_depend_on_order(spark):
    rng = random.Random(5)
    lines = [at("x", rng.randrange(0, 300), rng.randrange(0, 3) * 5, 50, rng.randrange(8, 20)) for _ in range(40)]
    got = {frozenset(g) for g in groups(spark, lines)}
    mixed = list(range(40))
    rng.shuffle(mixed)
    turned = {frozenset(mixed[i] for i in g) for g in groups(spark, [lines[i] for i in mixed])}
    assert got == turned
    pairs = {(r.a, r.b) for r in regions.adjacent_pairs(page(spark, lines)).collect()}
    assert all(any({a, b} <= g for g in got) for a, b in pairs)


def groups(spark, lines):
    out = {}
    for r in regions.blocks(page(spark, lines)).collect():
        out.setdefault(r.block, []).append(r.line_no)
    assert all(b == min(v) for b, v in out.items())
    return out.values()


def test_verdicts_and_the_gate_before_the_classifier(spark):
    lines = [at("Herrn", 10), at("Orientierende Testuntersuchg.", 240), at("1,00", 230, 300), at("2,00", 250, 300), at("Orientierende Testuntersuchg.", 600), at("   ", 700)]

    def asked(df):
        told = F.when(F.col("text").startswith("Orient") & (F.col("top") < 300), F.raise_error(F.lit("asked about a table line")).cast("boolean"))
        return df.withColumn("pii", F.coalesce(told, F.col("text").startswith("Orient")))

    got = {r.line_no: r.reason for r in verdicts.reasons(page(spark, lines), asked).collect()}
    assert got == {0: "static-rule", 1: None, 2: None, 3: None, 4: "classifier"}
    own = verdicts.line_boxes(verdicts.reasons(page(spark, lines), asked), 0).where("line_no = 4").first()
    assert (own.x0, own.y0, own.x1, own.y1) == (0, 600, 100, 610)


def test_coverage_equals_a_mask(spark):
    rng = random.Random(9)
    lines = [(1, 0, i, "t", rng.randrange(0, 50), rng.randrange(0, 50), rng.randrange(0, 30), rng.randrange(0, 20), None) for i in range(60)]
    bs = [(1, 0, *(a := (rng.randrange(-10, 70), rng.randrange(-10, 60))), a[0] + rng.randrange(0, 30), a[1] + rng.randrange(0, 30)) for _ in range(12)]
    got = {r.line_no: r.coverage for r in verdicts.coverage(spark.createDataFrame(lines, LINES), spark.createDataFrame(bs, "doc_id long, page int, x0 int, y0 int, x1 int, y1 int")).collect()}
    for _, _, i, _, left, top, w, h, _ in lines:
        mask = np.zeros((h, w), bool)
        for _, _, x0, y0, x1, y1 in bs:
            mask[max(0, y0 - top) : max(0, y1 - top), max(0, x0 - left) : max(0, x1 - left)] = True
        assert got[i] == pytest.approx(mask.mean() if mask.size else 0.0)


READ = "doc_id long, page int, read_no int, `pass` int, linear boolean, decoded boolean, x0 double, y0 double, x1 double, y1 double"


def reads(spark, *rects, decoded=False):
    return spark.createDataFrame([(1, 0, i, 1, False, decoded, *map(float, r)) for i, r in enumerate(rects)], READ)


def test_fragments_become_a_square(spark):
    got = codes.fuse_fragments(reads(spark, (100, 100, 130, 130), (100, 100, 130, 190))).collect()
    assert [(r.x0, r.y0, r.x1, r.y1) for r in got] == [(100, 100, 190, 190)]
    apart = reads(spark, (100, 100, 160, 160), (100, 490, 170, 560), (220, 490, 240, 510))
    assert codes.fuse_fragments(apart).count() == 2


def test_shape_guard_and_growth(spark):
    assert codes.plausible(reads(spark, (0, 0, 12, 12), (0, 0, 11, 40), (0, 0, 40, 13), (0, 0, 36, 12))).count() == 2
    got = codes.grown(reads(spark, (0, 0, 100, 50), (90, 90, 100, 100)), 0.08, 2, 95, 95).orderBy("read_no").collect()
    assert [(r.x0, r.y0, r.x1, r.y1) for r in got] == [(0, 0, 95, 60), (87, 87, 95, 95)]


def test_merge_is_one_sweep_in_order(spark):
    rng = random.Random(2)
    for _ in range(5):
        rects = [(x := rng.randrange(0, 60), y := rng.randrange(0, 60), x + rng.randrange(1, 25), y + rng.randrange(1, 25)) for _ in range(9)]
        merged = []
        for b in rects:
            rest = []
            for o in merged:
                if b[0] < o[2] and o[0] < b[2] and b[1] < o[3] and o[1] < b[3]:
                    b = (min(b[0], o[0]), min(b[1], o[1]), max(b[2], o[2]), max(b[3], o[3]))
                else:
                    rest.append(o)
            merged = [*rest, b]
        got = codes.merge_sweep(reads(spark, *rects)).orderBy("box_no").collect()
        assert [(r.x0, r.y0, r.x1, r.y1) for r in got] == merged


def test_code_boxes_leave_fragments_of_exact_symbols_out(spark):
    both = reads(spark, (100, 100, 200, 200), decoded=True).union(reads(spark, (150, 150, 190, 190)).withColumn("read_no", F.lit(5)))
    got = codes.code_boxes(both, width=1000, height=1000).collect()
    assert [(r.x0, r.y0, r.x1, r.y1) for r in got] == [(90, 90, 210, 210)]


def test_retry_gate(spark):
    pages = spark.createDataFrame([(1, 0, 1000, 1000), (2, 0, 4000, 4000), (3, 0, 4000, 4000), (4, 0, 1000, 1000)], "doc_id long, page int, width int, height int")
    seen = reads(spark, (0, 0, 20, 20)).withColumn("doc_id", F.lit(3).cast("long")).union(reads(spark, (0, 0, 20, 20), decoded=True).withColumn("doc_id", F.lit(4).cast("long")))
    assert sorted(r.doc_id for r in codes.retry_pages(pages, seen).collect()) == [1, 3]


def test_fill_ink_and_files(spark):
    white = np.full((20, 30, 3), 255, np.uint8)
    pages = spark.createDataFrame([(1, 0, 30, 20, 3, bytearray(white.tobytes())), (1, 1, 30, 20, 3, bytearray(white.tobytes()))], "doc_id long, page int, width int, height int, channels int, data binary")
    bs = spark.createDataFrame([(1, 0, 2, 3, 5, 6)], "doc_id long, page int, x0 int, y0 int, x1 int, y1 int")
    got = {r.page: np.frombuffer(r.data, np.uint8).reshape(20, 30, 3) for r in images.fill_boxes(pages, bs).collect()}
    want = white.copy()
    want[3:7, 2:6] = 0
    assert (got[0] == want).all() and (got[1] == white).all()
    code = white.copy()
    code[5:15, 10:20:2] = 0
    assert images.ink(code, (10, 5, 20, 15)) and not images.ink(white, (10, 5, 20, 15))
    made = images.assemble_pdf(pages, 72).first().content
    assert bytes(made).startswith(b"%PDF") and b"/Count 2" in made and b"[0 0 30.0000 20.0000]" in made
    assert bytes(images.encode_image(pages).first().content).startswith(b"\x89PNG")
    with pytest.raises(ValueError):
        images.pdf([])
    with pytest.raises(RuntimeError):
        images.seam("ocr")


def test_png_opens_in_the_image_source(spark, tmp_path):
    rng = np.random.default_rng(1)
    rgb = rng.integers(0, 255, (4, 5, 3), dtype=np.uint8)
    (tmp_path / "a.png").write_bytes(images.png(rgb.tobytes(), 5, 4, 3))
    row = spark.read.format("image").load(str(tmp_path)).select("image.width", "image.height", images.rgb_of_image_source(F.col("image")).alias("rgb")).first()
    assert (row.width, row.height, bytes(row.rgb)) == (5, 4, rgb.tobytes())


def test_constants():
    assert (P.COVERED, P.UNTOUCHED, P.MIN_TABLE_ROWS) == (0.9, 0.1, 2) and len(P.STOPWORDS) == 45
