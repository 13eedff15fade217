"""The patterns of the line rules, as Java regular expressions (see text.matches for the flags they run under)."""

from __future__ import annotations

# Fixed values -----------------------------------------------------------------------------------------------
# Patterns, word lists and their order; results depend on every character.
NAME_PART = r"[A-ZÄÖÜ][A-ZÄÖÜa-zäöüß]+(?:-[A-ZÄÖÜ][A-ZÄÖÜa-zäöüß]+)?"
PERSON_LABEL = r"(?:Pat(?:ient(?:in|en)?)?|Versicherte[rn]?|Mitglied|Person|Name|Rechnungsempfänger(?:in)?|Zahlungspflichtige[rn]?)"
NAME_SEP = r"(?:\s*,\s*|\s+)"
NAME_PART_OCR = r"[A-ZÄÖÜa-zäöüß][A-ZÄÖÜa-zäöüß]{2,}(?:-[A-ZÄÖÜa-zäöüß][A-ZÄÖÜa-zäöüß]+)?"
CITY = r"(?:[A-ZÄÖÜ][a-zäöüß]{2,}|[A-ZÄÖÜ]{4,})"

SALUT = r"\b(?:Herrn?|Frau|Fräulein|Frl|Familie|Fam|Eheleute)\b"
PATIENT_NAME = r"\b" + PERSON_LABEL + r"\b\.?\s*:?\s*(?:[A-ZÄÖÜ]\.\s*)*" + NAME_PART
TITLE_NAME = r"\b(?:(?:Prof|Priv\.-Doz|Dr(?:es)?|med|dent|vet|univ|habil|Dipl\.-?Med)\.\s*)+(?:[A-ZÄÖÜ]\.\s*)*[A-ZÄÖÜ][a-zäöüß]+"
DATE = r"\b\d{1,2}\.\s?\d{1,2}\.\s?\d{2,4}\b"
NAME_DATE = NAME_PART + r"\s*,\s*" + NAME_PART + r"\s+" + DATE
DE_STREET = r"\b[A-ZÄÖÜ][A-ZÄÖÜa-zäöüß.\-]+(?i:stra(?:ße|sse)|str|weg|platz|gasse|allee|ring|damm)\.?\s*\d+[a-zA-Z]?\b"
DE_PLZ_CITY = rf"(?<![\d/])(?<!\d-)\b\d{{5}}\s*{CITY}(?:[ \-]{CITY})?\b"
ORG_LEGAL = r"\b(?:g?GmbH|mbH|UG|AG|KG|OHG|GbR|PartG(?:mbB)?|Ltd|Inc)\b|\be\.\s?[KV]\."
CONTACT = (
    r"(?i)\bhttps?://\S+|\bwww\.[\w\-]+(?:\.[\w\-]+)+"
    r"|(?-i:\b[a-z\d][a-z\d\-]+(?:\.[a-z\d\-]+)*\.(?:de|com|net|org|eu|at|ch))(?![\w.\-])"
    r"|[\w.\-+]+@[\w\-]+(?:\.[\w\-]+)+"
    r"|\b(?:Tel(?:efon)?|Telefax|Fax|Mobil)\b\.?\s*:?\s*(?=[\d\s()/+\-]{6,})[\d(+]"
)
IMPRINT = (
    r"(?i)\bHR[AB]\s*\d|\b(?:USt|Umsatzsteuer)[\-.\s]?Id|\bSteuer[\-\s]?(?:nummer|Nr)|\bIK[\-\s.]?(?:Nr\.?)?\s*:?\s*\d"
    r"|\b(?:LANR|LAN\-Nr|BSNR|IBAN|BIC|BLZ)\b|\bBankverbindung\b|\bKonto(?:\-?Nr)?\b|\bPostfach\b"
)
ORG_MEDICAL = (
    r"(?i)\b(?:MVZ|\w*praxis|Praxisgemeinschaft|\w*klinik(?:um)?|\w*krankenhaus|\w*ärztehaus|\w*zentrum|Institut"
    r"|\w*labor|Laborgemeinschaft|Apotheke|Sanitätshaus|Krankenkasse|\w*versicherung|\w*verrechnungsstelle"
    r"|Abrechnungsstelle|Abrechnungsgesellschaft|Berufsausübungsgemeinschaft)\b|\bBehandl\w*\s+durch\b"
)
PERSON_LABEL_CELL = r"^\s*(?:[A-ZÄÖÜ][a-zäöüß]+e[rnsm]?\s+)?" + PERSON_LABEL + r"\s*\.?\s*:?\s*$"
NAME_VALUE = rf"^\s*(?:{NAME_PART}{NAME_SEP}{NAME_PART_OCR}|{NAME_PART_OCR}{NAME_SEP}{NAME_PART})\s*$"
BIRTH_LABEL = r"(?i)geburt|geboren|geb[.\s-]*dat"
BIRTH_LABEL_CELL = r"(?i)^\s*(?:geburts(?:datum|tag)|geb[.\s-]*dat(?:um)?)\.?\s*:?\s*$"
GEB_DATE = r"(?i)\bgeb\.?\s*(?:am\s+)?" + DATE
STAR_DATE = r"\*\s*" + DATE
BIRTH_MARK = GEB_DATE + r"|" + STAR_DATE
ID_LABEL = r"(?i)\b(?:Versicherten|Versicherungs(?:schein)?|Patienten|Pat\.?|Fall|Aufnahme|Mitglieds?|Vertrags)[-\s.]*(?:Nr|Nummer)\b"
ID_VALUE = r"\b[A-Z]?\d(?:[ ./-]?\d){3,}\b"
PERSON_DETAIL = rf"{NAME_VALUE}|^\s*{DATE}\s*$|^\s*{ID_VALUE}\s*$"
MONEY = r"\b\d{1,3}(?:\.\d{3})*,\d{2}\b"
NAME_TOKEN = r"\b[A-ZÄÖÜ][A-ZÄÖÜa-zäöüß]{3,}\b"

STATIC_RULES = [
    ("SALUT", SALUT), ("PATIENT_NAME", PATIENT_NAME), ("TITLE_NAME", TITLE_NAME), ("NAME_DATE", NAME_DATE), ("DE_STREET", DE_STREET),
    ("DE_PLZ_CITY", DE_PLZ_CITY), ("ORG_LEGAL", ORG_LEGAL), ("CONTACT", CONTACT), ("IMPRINT", IMPRINT),
]
# Words that are no names.
STOPWORDS = [
    "Sehr", "Geehrte", "Geehrter", "Geehrtes", "Herr", "Herrn", "Frau", "Fräulein", "Familie", "Eheleute", "Patient", "Patientin", "Patienten",
    "Versicherte", "Versicherter", "Versicherten", "Mitglied", "Rechnungsempfänger", "Rechnungsempfängerin", "Zahlungspflichtige",
    "Zahlungspflichtiger", "Geburtsdatum", "Geburtstag", "Geboren", "Januar", "Februar", "März", "April", "Juni", "Juli", "August", "September",
    "Oktober", "November", "Dezember", "Arzt", "Ärztin", "Zahnarzt", "Zahnärztin", "Facharzt", "Fachärztin", "Praxis", "Medizin", "Innere",
    "Allgemeinmedizin",
]

# The deterministic part of the classifier: entity, pattern, score, and a context that the line must have.
BIC = r"\b[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b"
BIC_CONTEXT = r"(?i)\b(?:bic|swift)\b"
KONTO = r"\b(?:Kto|Konto(?:nummer|[ \-]?Nr)?|BLZ|Bankleitzahl)\.?\s*:?\s*\d(?:[ .]?\d){3,}\b"
_SUFFIX = r"(?i:stra(?:ße|sse)|str|weg|platz|gasse|allee|ring|damm)"
ADDRESS_STREET = rf"\b[A-ZÄÖÜ][A-ZÄÖÜa-zäöüß.\-]+(?:{_SUFFIX}|\s+{_SUFFIX})\.?\s*\d+[a-zA-Z]?\b"
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b"
CARD = r"\b[0-9](?:[ \-]?[0-9]){12,18}\b"
PHONE = r"(?<![\d.,/])(?:\+49[ \-/]?|0)\d{2,4}[ /\-]{1,3}\d[\d \-]{3,12}\d\b|(?<![\d.,/])0\d{6,12}\b"
DOTTED_DATE = r"^\d{1,2}\.\d{1,2}\.\d{2,4}[\s\d.\-/]*$"
BARE_DIGITS = r"^\d+$"
PII_ENTITIES = ["PERSON", "IBAN_CODE", "BIC_CODE", "DE_ADDRESS", "EMAIL_ADDRESS", "KONTO", "PHONE_NUMBER", "CREDIT_CARD"]
PERSON_WHITELIST = ["Bgr", "Faktor", "Anz", "Anzahl"]
SCORES = {"IBAN_CODE": 1.0, "EMAIL_ADDRESS": 1.0, "CREDIT_CARD": 1.0, "PHONE_NUMBER": 0.4, "BIC_CODE": 0.5, "KONTO": 0.7, "DE_ADDRESS": 0.7}

# Factors of the geometry.
COLUMN_GAP, TABLE_GAP, MIN_TABLE_ROWS, BAND_STRETCH = 3.0, 3.0, 2, 1.5
FRAGMENT_REACH, MAX_ASPECT, MIN_SIDE, MIN_INK, INK_INNER, INK_SHARE = 1.5, 3.0, 12, 0.30, 0.7, 0.6
LINEAR_FORMATS = ["ITF", "Code128", "Code39"]
RETRY_UPSCALE, RETRY_BLIND_MAX_PIXELS = 2, 2_000_000
COVERED, UNTOUCHED = 0.9, 0.1
