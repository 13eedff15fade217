"""All kinds of entities, and all candidates for phone numbers, against Python's own regular expressions."""

import re
from collections import Counter

from veilgrid.functions import patterns as P
from veilgrid.plans import registry
from veilgrid.schema import LINE

SF = "/root/testdata/sf0.001"
MADE = ["Tel. 0231 / 123456", "Muster Straße 23, 44137 Dortmund", "0231123456 und 0231 / 7654321", "a.b@c.de", "", None, "Summe 12,50"]


def guarded(found):
    return not re.search(P.DOTTED_DATE, found.strip()) and not re.search(P.BARE_DIGITS, found.strip())


def rows(df, *cols):
    return Counter(tuple(r[c] for c in (*LINE, *cols)) for r in df.collect())


def brute(lines):
    """Counts of phone numbers and addresses by line, and candidates with the guard's word on each."""
    kinds, candidates = Counter(), Counter()
    for r in lines:
        key, text = tuple(r[c] for c in LINE), r["text"] or ""
        found = re.findall(P.PHONE, text)
        candidates.update((*key, c, guarded(c)) for c in found)
        for kind, n in (("PHONE_NUMBER", sum(map(guarded, found))), ("DE_ADDRESS", len(re.findall(P.ADDRESS_STREET, text)) + sum(1 for _ in re.finditer(P.DE_PLZ_CITY, text)))):
            if n:
                kinds[(*key, kind, n)] += 1
    return kinds, candidates


def test_all_kinds_of_made_lines(spark):
    ls = spark.createDataFrame([(1, 0, i, t) for i, t in enumerate(MADE)], "doc_id long, page int, line_no int, text string")
    kinds, candidates = brute(ls.collect())
    got = rows(registry._entities(ls), "entity", "n")
    assert kinds == Counter({k: n for k, n in got.items() if k[3] in ("PHONE_NUMBER", "DE_ADDRESS")})
    assert {k[2:] for k in got} == {(0, "PHONE_NUMBER", 1), (1, "DE_ADDRESS", 2), (2, "PHONE_NUMBER", 1), (3, "EMAIL_ADDRESS", 1)}
    found = rows(registry._phone_guard_candidates(ls), "candidate", "kept")
    assert found == candidates
    assert {k[2:] for k in found} == {(0, "0231 / 123456", True), (2, "0231123456", False), (2, "0231 / 7654321", True)}


def test_all_kinds_of_a_table(spark):
    queries = registry.queries()
    kinds, candidates = brute(queries["rendered_lines"](spark, SF).collect())
    assert kinds
    got = rows(queries["entities_regex"](spark, SF), "entity", "n")
    assert kinds == Counter({k: n for k, n in got.items() if k[3] in ("PHONE_NUMBER", "DE_ADDRESS")})
    assert rows(queries["phone_guard_candidates"](spark, SF), "candidate", "kept") == candidates
