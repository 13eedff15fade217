"""Columns that decide on a line's text. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def java(pattern: str) -> str:
    """The pattern with Unicode classes, boundaries and case folding, which Java has only by flag."""
    return "(?U)" + pattern.replace("(?i)", "(?iu)").replace("(?i:", "(?iu:").replace("(?-i:", "(?-iu:")


def _any(text: Column, *parts: str) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(x) for x in parts))


def folded(text: Column) -> Column:
    """The text in lower case. Of what isn't ASCII, case folding takes ſ for s, ı and İ for i (and the Kelvin sign for k, but so does `lower`)."""
    return F.when(_any(text, "ſ", "ı", "İ"), F.lower(F.translate(text, "ſıİ", "sii"))).otherwise(F.lower(text))


def _folded(text: Column, low: Column | None, *parts: str) -> Column:
    """Whether one of the parts, in lower case, may stand there in any case. low: a column of the folded text, if there is one."""
    if low is not None:
        return _any(low, *parts)
    exotic = [x for x, plain in (("ſ", "s"), ("ı", "i"), ("İ", "i")) if any(plain in y for y in parts)]
    return _any(F.lower(text), *parts) | _any(text, *exotic) if exotic else _any(F.lower(text), *parts)


def _digits(text: Column, n: int = 1) -> Column:
    return text.rlike(r"\p{Nd}" + (f"{{{n}}}" if n > 1 else ""))


def _person_label(text: Column) -> Column:
    return _any(text, "Pat", "Versicherte", "Mitglied", "Person", "Name", "Rechnungsempfänger", "Zahlungspflichtige")


def _street(text: Column, low: Column | None) -> Column:
    return _folded(text, low, "str", "weg", "platz", "gasse", "allee", "ring", "damm") & _digits(text)


#: What a line must have for a pattern to match anywhere on it: substrings, told far more cheaply than the pattern itself. Never the other way round.
NEEDS = {
    P.SALUT: lambda t, low: _any(t, "Herr", "Fr", "Fam", "Eheleute"),
    P.PATIENT_NAME: lambda t, low: _person_label(t),
    P.PERSON_LABEL_CELL: lambda t, low: _person_label(t),
    P.TITLE_NAME: lambda t, low: t.contains(".") & _any(t, "Prof", "Priv.", "Dr", "med", "dent", "vet", "univ", "habil", "Dipl"),
    P.NAME_DATE: lambda t, low: t.contains(",") & t.contains("."),
    P.DATE: lambda t, low: t.contains("."),
    P.DE_STREET: _street,
    P.ADDRESS_STREET: _street,
    P.DE_PLZ_CITY: lambda t, low: _digits(t, 5),
    P.ORG_LEGAL: lambda t, low: _any(t, "mbH", "UG", "AG", "KG", "OHG", "GbR", "PartG", "Ltd", "Inc", "e."),
    P.CONTACT: lambda t, low: _any(t, "@", "://", ".de", ".com", ".net", ".org", ".eu", ".at", ".ch") | _folded(t, low, "www.", "tel", "fax", "mobil"),
    P.IMPRINT: lambda t, low: _folded(t, low, "hra", "hrb", "steuer", "ik", "lan", "bsnr", "iban", "bic", "blz", "bankverbindung", "konto", "postfach") | (_folded(t, low, "ust", "umsatzsteuer") & _folded(t, low, "id")),
    P.ORG_MEDICAL: lambda t, low: _folded(t, low, "mvz", "praxis", "klinik", "krankenhaus", "ärztehaus", "zentrum", "institut", "labor", "apotheke", "sanitätshaus", "krankenkasse", "versicherung", "verrechnungsstelle", "abrechnungs", "berufsausübungsgemeinschaft", "behandl"),
    P.BIRTH_LABEL: lambda t, low: _folded(t, low, "geb"),
    P.BIRTH_LABEL_CELL: lambda t, low: _folded(t, low, "geb"),
    P.BIRTH_MARK: lambda t, low: t.contains(".") & (_folded(t, low, "geb") | t.contains("*")),
    P.ID_LABEL: lambda t, low: _folded(t, low, "nr", "nummer"),
    P.ID_VALUE: lambda t, low: _digits(t),
    P.MONEY: lambda t, low: t.contains(","),
    P.BIC_CONTEXT: lambda t, low: _folded(t, low, "bic", "swift"),
    P.BIC: lambda t, low: t.rlike("[A-Z]{6}"),
    P.EMAIL: lambda t, low: t.contains("@"),
    P.IBAN: lambda t, low: t.rlike("[A-Z]{2}[0-9]{2}"),
    P.CARD: lambda t, low: t.rlike("[0-9](?:[ -]?[0-9]){12}"),
    P.KONTO: lambda t, low: _any(t, "Kto", "Konto", "BLZ", "Bankleitzahl"),
    P.PHONE: lambda t, low: t.rlike(r"0\p{Nd}|\+49"),
}


def matches(text: Column, pattern: str, low: Column | None = None) -> Column:
    """Whether a pattern matches. low: a column of the text folded, for those who ask for many patterns."""
    whole = text.rlike(java(pattern))
    return NEEDS[pattern](text, low) & whole if pattern in NEEDS else whole


def found(text: Column, pattern: str) -> Column:
    """The first match, as text; empty if there is none."""
    return F.regexp_extract(text, java(pattern), 0)


def all_found(text: Column, pattern: str) -> Column:
    """All matches, as texts."""
    every = F.regexp_extract_all(text, F.lit(java(pattern)), F.lit(0))
    return F.when(~NEEDS[pattern](text, None), F.array().cast("array<string>")).otherwise(every) if pattern in NEEDS else every


def static_rule(text: Column) -> Column:
    """The first rule, in order, that fires: a struct (rule, matched), or null."""
    return F.coalesce(*(F.when(matches(text, p), F.struct(F.lit(name).alias("rule"), found(text, p).alias("matched"))) for name, p in P.STATIC_RULES))


def static_rule_name(text: Column) -> Column:
    return F.coalesce(*(F.when(matches(text, p), F.lit(name)) for name, p in P.STATIC_RULES))


def only(value: Column) -> Column:
    """Rows where a value isn't null, with the value: a filter that evaluates it once, not again in what is selected."""
    return F.explode(F.filter(F.array(value), lambda x: x.isNotNull()))


def has_static_rule(text: Column, low: Column | None = None, names: Column | None = None) -> Column:
    """Whether any static rule fires. names: a column that tells it of NAME_RULES."""
    rest = [matches(text, p, low) for _, p in P.STATIC_RULES if names is None or p not in NAME_RULES]
    return reduce(lambda a, b: a | b, rest if names is None else [names, *rest])


#: The static rules that are name evidence too.
NAME_RULES = (P.PATIENT_NAME, P.TITLE_NAME, P.SALUT, P.NAME_DATE)


def has_name_rule(text: Column, low: Column | None = None) -> Column:
    return reduce(lambda a, b: a | b, (matches(text, p, low) for p in NAME_RULES))


def is_sender_anchor(text: Column) -> Column:
    """Whether a line tells of a sender: any static rule, a loose organisation noun, or a titled name."""
    return has_static_rule(text) | matches(text, P.ORG_MEDICAL)


def is_recipient_anchor(text: Column) -> Column:
    return matches(text, P.DE_STREET) | matches(text, P.DE_PLZ_CITY)


def not_blank(text: Column) -> Column:
    """Whether there is anything but white space, of any script."""
    return matches(text, r"\S")


def is_name_evidence(text: Column, low: Column | None = None, names: Column | None = None) -> Column:
    """Whether a line labels a person: a label, title, salutation, or a birth date next to the name. names: a column that tells of NAME_RULES."""
    named = has_name_rule(text, low) if names is None else names
    return named | matches(text, P.BIRTH_MARK, low) | (matches(text, P.BIRTH_LABEL, low) & matches(text, P.DATE, low))


def name_tokens(text: Column) -> Column:
    """Name-shaped tokens of a line, without the words that labels and letters are made of."""
    stop = F.array(*(F.lit(w.lower()) for w in P.STOPWORDS))
    tokens = F.array_distinct(F.regexp_extract_all(text, F.lit(java(P.NAME_TOKEN)), F.lit(0)))
    return F.filter(tokens, lambda t: ~F.array_contains(stop, F.lower(t)))


def capital_words(text: Column) -> Column:
    """The whole words of a line that begin with a capital, in lower case."""
    words = F.regexp_extract_all(text, F.lit(r"(?U)\w+"), F.lit(0))
    return F.array_distinct(F.transform(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")), F.lower))


def excerpt(text: Column, width: int = 48) -> Column:
    return F.when(F.length(text) <= width, text).otherwise(F.concat(F.substring(text, 1, width - 1), F.lit("…")))


def python_repr(text: Column) -> Column:
    """A line's text as the dump format quotes it: in single quotes, or in double quotes where only those save an escape. Of most texts one
    look tells that they have nothing to escape: ASCII without quote and backslash, and the printable of Latin-1 and Latin Extended-A."""
    plain = text.rlike(r"^[ -&(-\[\]-~\u00a1-\u00ac\u00ae-\u017f€]*\z")
    return F.when(plain, F.concat(F.lit("'"), text, F.lit("'"))).otherwise(_escaped(text))


def _escaped(text: Column) -> Column:
    body = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(raw), F.lit(shown))
    odd = r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}\p{Zl}\p{Zp}\p{Zs}&&[^ ]]"  # what isn't printable is shown by its code

    def shown(c: Column) -> Column:
        code = F.lower(F.hex(F.ascii(c)))
        return F.when(~c.rlike(odd), c).when(F.length(code) <= 2, F.concat(F.lit("\\x"), F.lpad(code, 2, "0"))).when(F.length(code) <= 4, F.concat(F.lit("\\u"), F.lpad(code, 4, "0"))).otherwise(F.concat(F.lit("\\U"), F.lpad(code, 8, "0")))

    body = F.when(body.rlike(odd), F.array_join(F.transform(F.split(body, ""), shown), "")).otherwise(body)
    single, double = text.contains("'"), text.contains('"')
    return F.when(single & ~double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'")))


def iban_valid(iban: Column) -> Column:
    """Whether the check digits hold: the rest on division by 97 is 1, folded digit by digit."""
    bare = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4))
    chars = F.filter(F.split(turned, ""), lambda c: c != "")

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        letter = code >= 65
        value = F.when(letter, code - 55).otherwise(code - 48)
        return (rest * F.when(letter, 100).otherwise(10) + value) % 97

    return F.aggregate(chars, F.lit(0), step) == 1


def luhn_valid(digits: Column) -> Column:
    """Whether a card number's sum, every second digit from the right doubled, ends in 0."""
    bare = F.regexp_replace(digits, "[^0-9]", "")
    values = F.transform(F.filter(F.split(F.reverse(bare), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, F.ascii(c) - 48).otherwise((F.ascii(c) - 48) * 2))
    total = F.aggregate(values, F.lit(0), lambda acc, v: acc + F.when(v > 9, v - 9).otherwise(v))
    return (total % 10 == 0) & (F.length(bare) >= 13)


def may_be_phone(found: Column) -> Column:
    """The guard on candidates for phone numbers: neither a date nor a bare run of digits."""
    return ~matches(F.trim(found), P.DOTTED_DATE) & ~matches(F.trim(found), P.BARE_DIGITS)


def phone_candidates(text: Column) -> Column:
    """What looks like a phone number anywhere on a line, before the guard."""
    return all_found(text, P.PHONE)


def _recognisers(kinds: Sequence[str], least: float) -> list[dict]:
    """Those that are looked for at all."""
    all_ = [
        dict(entity="IBAN_CODE", pattern=P.IBAN, keep=iban_valid), dict(entity="EMAIL_ADDRESS", pattern=P.EMAIL), dict(entity="CREDIT_CARD", pattern=P.CARD, keep=luhn_valid),
        dict(entity="PHONE_NUMBER", pattern=P.PHONE, keep=may_be_phone), dict(entity="BIC_CODE", pattern=P.BIC, context=P.BIC_CONTEXT), dict(entity="KONTO", pattern=P.KONTO),
        dict(entity="DE_ADDRESS", pattern=P.ADDRESS_STREET), dict(entity="DE_ADDRESS", pattern=P.DE_PLZ_CITY, score=0.6),
    ]
    return [r for r in all_ if r["entity"] in kinds and r.get("score", P.SCORES[r["entity"]]) >= least]


def has_entity(text: Column, kinds: Sequence[str] = tuple(P.PII_ENTITIES), least: float = 0.0) -> Column:
    """Whether `entities` finds anything; the first hit decides, and all but e-mail addresses and BICs are looked for only where there is a digit."""

    def hit(pattern: str, keep=None, context: str | None = None, **_) -> Column:
        some = F.exists(all_found(text, pattern), keep) if keep else matches(text, pattern)
        return matches(text, context) & some if context else some

    bare = [hit(**r) for r in _recognisers(kinds, least) if r["pattern"] in (P.EMAIL, P.BIC)]
    digits = [hit(**r) for r in _recognisers(kinds, least) if r["pattern"] not in (P.EMAIL, P.BIC)]
    either = lambda xs: reduce(lambda a, b: a | b, xs)
    return either([F.lit(False), *bare, *([_digits(text) & either(digits)] if digits else [])])


def entities(text: Column, kinds: Sequence[str] = tuple(P.PII_ENTITIES), least: float = 0.0) -> Column:
    """What the deterministic recognisers of some kinds find on a line with a score of at least `least`: an array of (entity, matched, score)."""

    def one(entity: str, pattern: str, keep=None, score: float | None = None, context: str | None = None) -> Column:
        all_ = all_found(text, pattern)
        kept = F.filter(all_, keep) if keep else all_
        rows = F.transform(kept, lambda m: F.struct(F.lit(entity).alias("entity"), m.alias("matched"), F.lit(P.SCORES[entity] if score is None else score).alias("score")))
        return F.when(matches(text, context), rows).otherwise(F.array()) if context else rows

    found_ = [one(**r) for r in _recognisers(kinds, least)]
    return F.concat(*found_) if found_ else F.array().cast("array<struct<entity:string,matched:string,score:double>>")


def person_tokens(tokens: Column, start: Column, end: Column) -> Column:
    """How many name tokens a PERSON span is worth: proper nouns in it, and a capitalised neighbour across a comma.

    `tokens` is an array of (idx, text, pos), as the language model gives them; a span worth less than two is no person.
    """
    white = F.array(*(F.lit(w) for w in P.PERSON_WHITELIST))
    inside = F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), lambda i: (F.get(tokens, i)["idx"] < end) & (F.get(tokens, i)["idx"] + F.length(F.get(tokens, i)["text"]) > start))
    inside = F.when(F.size(tokens) > 0, inside).otherwise(F.array().cast("array<int>"))
    proper = F.size(F.filter(inside, lambda i: (F.get(tokens, i)["pos"] == "PROPN") & ~F.array_contains(white, F.get(tokens, i)["text"])))

    def across(edge: Column, step: int) -> Column:
        comma, other = F.get(tokens, edge + step), F.get(tokens, edge + 2 * step)
        in_range = (edge + 2 * step >= 0) & (edge + 2 * step < F.size(tokens))
        good = in_range & (comma["text"] == ",") & other["text"].rlike(r"^\p{Lu}") & ~F.array_contains(white, other["text"])
        return F.when(good, 1).otherwise(0)

    return F.when(F.size(inside) == 0, 0).otherwise(proper + across(F.get(inside, F.lit(0)), -1) + across(F.get(inside, F.size(inside) - 1), 1))
