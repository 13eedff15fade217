import re

import pytest
from pyspark.sql import functions as F

from veilgrid.functions import patterns as P
from veilgrid.functions.text import capital_words, entities, excerpt, has_static_rule, iban_valid, java, luhn_valid, matches, name_tokens, not_blank, person_tokens, python_repr, static_rule


def column(spark, texts, **exprs):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r for r in df.select("i", *(e.alias(k) for k, e in exprs.items())).orderBy("i").collect()]


T = None


@pytest.fixture(autouse=True)
def _text(spark):
    global T
    T = F.col("text")


def test_first_rule_in_order_with_its_match(spark):
    texts = ["Herrn", "Musterstrasse 23", "Internet: praxis-muster.de", "Behandlung Zahn", "Patient Mustermann, Max", "MUSTERSTR.23", "Dr. Dr. Daphne Schlegel", "Muster,Andrea 05.03.11", "Praxis GmbH", "HRB 1234", None]
    got = [r.r and (r.r.rule, r.r.matched) for r in column(spark, texts, r=static_rule(T))]
    assert got == [("SALUT", "Herrn"), ("DE_STREET", "Musterstrasse 23"), ("CONTACT", "praxis-muster.de"), None, ("PATIENT_NAME", "Patient Mustermann"), ("DE_STREET", "MUSTERSTR.23"),
                   ("TITLE_NAME", "Dr. Dr. Daphne"), ("NAME_DATE", "Muster,Andrea 05.03.11"), ("ORG_LEGAL", "GmbH"), ("IMPRINT", "HRB 1"), None]


@pytest.mark.parametrize(("name", "yes", "no"), [
    ("DE_PLZ_CITY", ["12345 Musterstadt", "12345Musterstadt", "D-12345 Musterhausen", "54321 MUSTERSTADT"], ["15118 MID", "44/20101 Massage", "44-20101 Massage"]),
    ("CONTACT", ["www.a-b.de", "info@a.de", "Tel. 0231 / 123456", "https://x", "praxis-muster.de"], ["Stütz-Bew.org.oder", "einschl.der Kosten", "Tel. 12"]),
    ("BIRTH_MARK", ["Max'geb. 13.08.1964", "*13.03.1975", "* 13.03.75", "geb. am 1.2.1980"], ["Geb.Nr. 5", "geb. 5"]),
    ("ID_LABEL", ["Versicherten-Nr.", "Fallnummer", "Pat.-Nr:", "Aufnahme Nr"], ["Rechnungs-Nr", "Versicherte"]),
    ("NAME_VALUE", ["Max Mustermann", "MUSTER,ANDREA", "loanna Muster"], ["Mustermann", "max mustermann", "Max Muster und"]),
    ("PERSON_LABEL_CELL", ["Patient:", "Behandelte Person:", "Versicherte Person"], ["Beratung Person", "des Patienten"]),
    ("MONEY", ["4,66 €", "1.234,56"], ["4,6", "12345"]),
    ("ORG_MEDICAL", ["Zahnarztpraxis Weber", "Rechenzentrum", "ÄRZTEHAUS"], ["Laboruntersuchung"]),
    ("SALUT", ["Frau Müller", "Fräulein"], ["Frauen", "herr"]),
])
def test_patterns(spark, name, yes, no):
    got = column(spark, yes + no, hit=matches(T, getattr(P, name)))
    assert [r.hit for r in got] == [True] * len(yes) + [False] * len(no)


def test_unicode_flags(spark):
    assert java("(?i)ä").startswith("(?U)(?iu)")
    got = column(spark, ["Müller", "xÜber", "ÄRZTE", " ", "a"], words=F.regexp_extract_all(T, F.lit(java(r"\w+")), F.lit(0)), edge=matches(T, r"\bÜber"), any=matches(T, "(?i)ärzte"), full=not_blank(T))
    assert [r.words for r in got][0] == ["Müller"]
    assert [r.edge for r in got] == [False] * 5 and got[2].any
    assert [r.full for r in got] == [True, True, True, False, True]


def test_names(spark):
    texts = ["PATIENT MUSTER, ANDREA 13.03.1978", "Sehr geehrte Frau Öztürk", "Diagnose Mustermann", "klein Klein"]
    got = column(spark, texts, names=name_tokens(T), words=capital_words(T))
    assert sorted(got[0].names) == ["ANDREA", "MUSTER"] and got[1].names == ["Öztürk"]
    assert got[3].words == ["klein"] and "diagnose" in got[2].words


def test_checksums(spark):
    got = column(spark, ["DE89 3704 0044 0532 0130 00", "DE88 3704 0044 0532 0130 00"], ok=iban_valid(T))
    assert [r.ok for r in got] == [True, False]
    got = column(spark, ["4111 1111 1111 1111", "4111-1111-1111-1112", "411"], ok=luhn_valid(T))
    assert [r.ok for r in got] == [True, False, False]


def test_entities_and_phone_guard(spark):
    texts = ["09.07.2026", "2106315267", "0231 000000- 000", "BIC INGDDEFF", "RECHNUNG", "Kto. 520 22 111", "a.b@c.de", "Muster Straße 23", "12.12.15 51-61"]
    got = [sorted({e.entity for e in r.e}) for r in column(spark, texts, e=entities(T))]
    assert got == [[], [], ["PHONE_NUMBER"], ["BIC_CODE"], [], ["KONTO"], ["EMAIL_ADDRESS"], ["DE_ADDRESS"], []]


@pytest.mark.parametrize(("tokens", "span", "n"), [
    ([(0, "Max", "PROPN")], (0, 3), 1), ([(0, "Max", "PROPN"), (4, "Muster", "PROPN")], (0, 10), 2), ([(0, "Cleed", "NOUN"), (6, "Agar", "PROPN")], (0, 10), 1),
    ([(0, "Wolf", "NOUN"), (4, ",", "PUNCT"), (5, "Uwe", "PROPN")], (5, 8), 2), ([(0, "Faktor", "PROPN"), (7, "Max", "PROPN")], (0, 10), 1), ([], (0, 3), 0),
    ([(0, "loanna", "PROPN"), (7, "Muster", "PROPN")], (0, 13), 2), ([(0, "wolf", "NOUN"), (4, ",", "PUNCT"), (5, "Uwe", "PROPN")], (5, 8), 1),
])
def test_person_guard(spark, tokens, span, n):
    df = spark.createDataFrame([(tokens, *span)], "tokens array<struct<idx:int,text:string,pos:string>>, a int, b int")
    assert df.select(person_tokens(F.col("tokens"), F.col("a"), F.col("b")).alias("n")).first().n == n


def test_quotes_and_excerpts(spark):
    texts = ["plain", "it's", 'say "it\'s"', "tab\there\\", "x" * 60]
    got = column(spark, texts, quoted=python_repr(T), short=excerpt(T))
    assert [r.quoted for r in got] == [repr(t) for t in texts]
    assert got[4].short == "x" * 47 + "…" and got[0].short == "plain"


def test_any_rule_agrees_with_the_first_rule(spark):
    texts = ["Herrn", "nichts", "12345 Musterstadt", "Bgr"]
    for r in column(spark, texts, any=has_static_rule(T), first=static_rule(T)):
        assert r.any == (r.first is not None)
    assert all(re.compile(p.replace("(?i)", "")) for _, p in P.STATIC_RULES)
