"""What a pattern needs, told before it, never hides a match; rendered lines are dealt by document before they are lines."""

import random

import pytest
from pyspark.sql import functions as F

from veilgrid.functions import patterns as P
from veilgrid.functions.text import NEEDS, all_found, java, matches
from veilgrid.plans import registry
from veilgrid.plans.invoices import lines

SF = "/root/testdata/sf0.001"
SEEDS = [
    "Herrn", "Fräulein Klein", "Frl", "Fam. Groß", "Eheleute", "Familie", "Frau", "Herr", "Patient Klein", "Pat.: Weber", "Patientin Groß", "Versicherter: Max", "Mitglied Öztürk", "Name Weber",
    "Rechnungsempfängerin Klein", "Zahlungspflichtiger Weber", "Dr. med. Weber", "Priv.-Doz. Klein", "Dipl.-Med. Groß", "Dres. Groß", "Prof. Groß", "Klein, Max 1.2.80", "Klein,Max 01.02.1980", "Hauptstraße 3", "HauptSTRASSE 3a",
    "Hauptſtraße 3", "Rıngrİng 4", "Am-Ring 5", "Burgallee 1", "BurgRıNG ٣", "Hauptweg 9", "Marktplatz 12", "Enggaſſe 4", "Deichdamm 7", "12345 Berlin", "12345BERLIN", "٤٤١٣٧ Dortmund", "gGmbH", "e.V.", "e. K.", "PartGmbB", "X AG",
    "OHG", "GbR", "UG", "KG", "Ltd", "Inc", "mbH", "www.a-b.de", "WWW.A.DE", "praxis.ch", "a.at", "b.eu", "c.org", "d.net", "e.com", "http://x", "HTTPS://x", "a@b.de", "Tel. 0231 / 100000", "TELEFAX: +49 231 12345",
    "Mobıl 0171 123456", "mobİl 0171 123456", "Fax 0231 1234567", "HRB 12", "hra 4", "USt-Id", "Umſatzſteuer-ID", "UMSATZSTEUER İd", "Steuernummer", "Steuer-Nr", "ſteuer nr", "IK 123", "İK: 5", "LANR", "LAN-Nr", "bsnr", "Iban", "BİC",
    "blz", "Bankverbindung", "banKverbindung", "Konto-Nr", "Poſtfach", "MVZ", "Zahnarztpraxis", "Praxisgemeinschaft", "Klinikum", "Krankenhaus", "ÄRZTEHAUS", "Rehazentrum", "Inſtitut", "Großlabor", "Apotheke", "SANITÄTSHAUS",
    "Krankenkasse", "BerufsausÜbungsgemeinschaft", "Abrechnungsstelle", "Privatverſicherung", "Verrechnungsstelle", "Behandlung durch", "geboren", "GEB. DAT", "geb. am 1.2.80", "* 01.02.1980", "Geburtsdatum:", "Geburtstag", "Versicherten-Nr.",
    "Fall Nummer", "PAT.-NR", "A123456789", "1 2-3/4", "1.234,56 €", "0,99", "DE12 5001 0517 5407 3249 31 / BIC INGDDEFFXXX", "ſwift INGDDEFF", "Karte 4111 1111 1111 1111", "4111111111111111", "Kto 1234", "Kontonummer: 4 399 100 00",
    "BLZ 1234", "Bankleitzahl 12 34", "0231 123456 - 0", "+49 231 12345678", "0٢٣١٤٥٦٧٨", "013.03.1975", "Person:", "Behandelte Person:", "   ", "", "Beratung, auch telefonisch",
]


def test_needs_never_hide_a_match(spark):
    rng = random.Random(4)
    letters = "aAeE.,:-*@ 0159/ßſıİKÄäst"
    texts = list(SEEDS)
    for _ in range(1500):
        x = " ".join(rng.sample(SEEDS, rng.choice((1, 1, 2))))
        i = rng.randrange(len(x) + 1)
        x = x[:i] + rng.choice(letters) + x[i + rng.randrange(2) :]
        texts.append(rng.choice((x, x, x.upper(), x.lower())))
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, text string").repartition(1)
    text = F.col("text")
    patterns = list(NEEDS)
    plain = df.select("i", *(text.rlike(java(p)).alias(f"m{n}") for n, p in enumerate(patterns)), *(F.regexp_extract_all(text, F.lit(java(p)), F.lit(0)).alias(f"a{n}") for n, p in enumerate(patterns)))
    quick = df.select("i", *(matches(text, p).alias(f"m{n}") for n, p in enumerate(patterns)), *(all_found(text, p).alias(f"a{n}") for n, p in enumerate(patterns)))
    want, got = (sorted(x.collect()) for x in (plain, quick))
    assert got == want
    assert all(sum(bool(r[f"m{n}"]) for r in want) >= 2 for n in range(len(patterns)))


def exchanges(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x.strip() for x in plan.split("\n") if "Exchange " in x]


def test_rule_hits_are_counted_by_many_tasks(spark):
    """The made tables are files of one row group: without dealing them out, one task matches all patterns."""
    plan = exchanges(registry.queries()["rule_hit_counts"](spark, SF))
    assert sum("o_orderkey" in x or "l_orderkey" in x for x in plan) == 3


def test_lines_are_not_shuffled_again(spark):
    assert all("_orderkey" in x for x in exchanges(lines(spark, SF)))
    assert all("_orderkey" in x for x in exchanges(lines(spark, SF).groupBy("doc_id").count()))


def test_reasons_shuffle_no_lines(spark):
    df = registry.queries()["verdict_reasons"](spark, SF)
    assert all("_orderkey" in x for x in exchanges(df))


def test_regions_shuffle_blocks_only(spark):
    plan = [x for x in exchanges(registry.queries()["region_boxes"](spark, SF)) if "_orderkey" not in x]
    assert len(plan) == 1 and "hashpartitioning(doc_id" in plan[0]
