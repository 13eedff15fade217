"""Verdicts of whole documents at once: lines stay rows, and what becomes of each is told by arrays of numbers over thousands of pages.

Rows come by document and page. A Python function sees them as Arrow columns, some thousands of documents together, and answers for each row;
texts don't come back from it. No pattern asks which digit stands somewhere, but for the checks of numbers, so a text is looked up with all its
digits alike: most lines of invoices are then known already. Only texts of plain letters are looked at in Python, where classes of characters and
edges of words are those of Java; the few others bring along what the JVM says of them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..schema import by_document
from .labels import RULES
from .regions import RegionParams, _labels

#: Rows that are judged together, at least; a document is never cut.
ROWS = 1 << 15
#: Texts that are remembered at most.
KNOWN = 1 << 17
PLAIN = r"^[ -~À-ÖØ-öø-ÿ€]*\z"
#: What becomes of a line, and why, by number.
KINDS = ["keep", "REDACT", "PARTIAL"]
REASONS = ["labeled-value", "static-rule", "name-memory", "classifier", "item table", "region", "overlap"]
REGIONS = ["header", "footer", "sender", "recipient"]
_BIT = {n: 1 << i for i, n in enumerate(["full", "ruled", "org", "address", "money", *(f"{w}{i}" for i in range(len(RULES)) for w in ("label", "value", "merged", "header")), "detail", "pii", "asked"])}
_WIDE = 1 << 34


def _tests() -> dict[str, list[str]]:
    """The patterns behind each bit: any of them."""
    out = {"full": [r"\S"], "ruled": [p for _, p in P.STATIC_RULES], "org": [P.ORG_MEDICAL], "address": [P.DE_STREET, P.DE_PLZ_CITY], "money": [P.MONEY], "detail": [P.PERSON_DETAIL]}
    for i, r in enumerate(RULES):
        out |= {f"{w}{i}": [p] for w, p in (("label", r.label), ("value", r.value), ("merged", r.merged), ("header", r.header)) if p}
    return out


def _iban_valid(x: str) -> bool:
    bare = x.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def _luhn_valid(x: str) -> bool:
    digits = [int(c) for c in reversed(x) if c.isdigit()]
    return len(digits) >= 13 and sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


_DOTTED, _BARE = re.compile(P.DOTTED_DATE), re.compile(P.BARE_DIGITS)


def _may_be_phone(x: str) -> bool:
    return not _DOTTED.search(x.strip(" ")) and not _BARE.search(x.strip(" "))


_CHECKS = {T.iban_valid: _iban_valid, T.luhn_valid: _luhn_valid, T.may_be_phone: _may_be_phone}


class Reader:
    """What patterns say of plain texts."""

    def __init__(self, recognisers: Sequence[tuple]):
        some = lambda ps: [re.compile(p).search for p in ps]
        self.tests = [(_BIT[k], some(ps)) for k, ps in _tests().items()]
        self.named, self.marked, self.birth = some(T.NAME_RULES), re.compile(P.BIRTH_MARK).search, some([P.BIRTH_LABEL, P.DATE])
        self.tokens, self.words, self.stop = re.compile(P.NAME_TOKEN).findall, re.compile(r"\w+").findall, {w.lower() for w in P.STOPWORDS}
        self.sure = [(re.compile(p).search, c and re.compile(c).search) for p, c, check in recognisers if check is None]
        self.checked = [(re.compile(p).finditer, re.compile(p.replace(r"\+49", r"\+00")).search, check) for p, _, check in recognisers if check]
        self.facts, self.hits = {}, {}

    def told(self, shape: str) -> tuple:
        """(bits, names, words) of a text whose digits are all 0."""
        got = self.facts.get(shape)
        if got is None:
            bits = sum(b for b, ps in self.tests if any(p(shape) for p in ps))
            if any(p(shape) and (c is None or c(shape)) for p, c in self.sure):
                bits |= _BIT["pii"]
            elif any(may(shape) for _, may, _ in self.checked):
                bits |= _BIT["asked"]
            names = ()
            if any(p(shape) for p in self.named) or self.marked(shape) or all(p(shape) for p in self.birth):
                names = tuple(x for x in {t.lower() for t in self.tokens(shape)} if x not in self.stop)
            got = bits, names, tuple({w.lower() for w in self.words(shape) if w[0].isupper()})
            if len(self.facts) >= KNOWN:
                self.facts.clear()
            self.facts[shape] = got
        return got

    def hit(self, text: str) -> bool:
        """Whether a number on a text passes its check."""
        got = self.hits.get(text)
        if got is None:
            got = any(check(m[0]) for each, _, check in self.checked for m in each(text))
            if len(self.hits) >= KNOWN:
                self.hits.clear()
            self.hits[text] = got
        return got


def _told(text: Column, kinds: Sequence[str], least: float) -> Column:
    """What patterns say of a text in the JVM, see Reader.told: the bits, names and words, in a string. (Spark measures rows for Python one by
    one, and walks through all lists so far for each.)"""
    bits = {k: [T.matches(text, p) for p in ps] for k, ps in _tests().items()} | {"pii": [T.has_entity(text, kinds, least)]}
    any_ = lambda cs: F.coalesce(F.greatest(*cs, F.lit(False)), F.lit(False))
    total = F.lit(0)
    for k, cs in bits.items():
        total = total + F.when(any_(cs), _BIT[k]).otherwise(0)
    names = F.when(T.is_name_evidence(text), F.transform(T.name_tokens(text), F.lower)).otherwise(F.array().cast("array<string>"))
    return F.concat(total.cast("string"), *(x for a in (names, T.capital_words(text)) for x in (F.lit("\t"), F.array_join(a, " "))))


def _shapes(text: pa.Array) -> pa.Array:
    """Texts with 0 for each digit. In UTF-8 no other letter has a digit's byte."""
    valid, offsets, data = text.buffers()
    raw = np.frombuffer(data, np.uint8).copy() if data is not None else np.zeros(0, np.uint8)
    raw[(raw >= 48) & (raw <= 57)] = 48
    return pa.StringArray.from_buffers(len(text), offsets, pa.py_buffer(raw), valid, -1, text.offset)


def chunks(batches: Iterator[tuple], key: int = 0) -> Iterator[list[pa.Array]]:
    """Columns of ROWS rows or more, cut between values of the first column."""
    held, n = [], 0
    whole = lambda xs: [pa.concat_arrays([x[i] for x in xs]) for i in range(len(xs[0]))]
    for b in batches:
        b = list(b)
        if not len(b[0]):
            continue
        held.append(b)
        n += len(b[0])
        if n < ROWS:
            continue
        doc = b[key]
        last = np.flatnonzero(changes(doc))
        cut = int(last[-1]) if len(last) else 0
        if not cut and (len(held) == 1 or held[-2][key][-1].as_py() == doc[0].as_py()):
            continue  # one document, so far; it goes on
        rest = [x.slice(cut) for x in b]
        held[-1] = [x.slice(0, cut) for x in b]
        yield whole(held)
        held, n = [rest], len(rest[0])
    if held:
        yield whole(held)


def numbers(x: pa.Array) -> np.ndarray:
    return pc.fill_null(x, 0).to_numpy(zero_copy_only=False).astype(np.int64)


def changes(*columns: pa.Array) -> np.ndarray:
    """Whether a row differs from the one before it in any column; of the first row, no."""
    out = np.zeros(len(columns[0]), bool)
    for c in columns:
        x, null = numbers(c), c.is_null().to_numpy(zero_copy_only=False)
        out[1:] |= (x[1:] != x[:-1]) | (null[1:] != null[:-1])
    return out


def _pairs(first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): each row i with `many[i]` rows j from `first[i]` on."""
    i = np.repeat(np.arange(len(first)), many)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + first[i]


def _found(keys: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where equal keys begin among sorted ones, and how many they are."""
    at = np.searchsorted(keys, of, "left")
    return at, np.searchsorted(keys, of, "right") - at


def _bands(page: np.ndarray, top: np.ndarray, end: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(page, top, bottom) of item tables, from lines with amounts; see pages.bands. gap: by page."""
    if not len(page):
        return page, top, end
    o = np.lexsort((end, top, page))
    page, top, end = page[o], top[o], end[o]
    so_far = np.maximum.accumulate(end + page * _WIDE) - page * _WIDE
    fresh = np.ones(len(page), bool)
    fresh[1:] = (page[1:] != page[:-1]) | (top[1:] > so_far[:-1])
    rows = np.flatnonzero(fresh)
    page, top, end = page[rows], top[rows], so_far[np.append(rows[1:], len(page)) - 1]
    fresh = np.ones(len(page), bool)
    fresh[1:] = (page[1:] != page[:-1]) | (top[1:] - end[:-1] > gap[page[1:]])
    first = np.flatnonzero(fresh)
    after = np.append(first[1:], len(page))
    some = after - first >= P.MIN_TABLE_ROWS
    return page[first][some], top[first][some], end[after - 1][some]


def _union(boxes: list[tuple[int, int, int, int]]) -> int:
    """The area that boxes (x0, y0, x1, y1) cover together."""
    cuts, total = sorted({y for b in boxes for y in (b[1], b[3])}), 0
    for y, below in zip(cuts, cuts[1:]):
        to = -(1 << 40)
        for x0, y0, x1, y1 in sorted(boxes):
            if y0 <= y < y1:
                total += max(0, x1 - max(to, x0)) * (below - y)
                to = max(to, x1)
    return total


def shares(lines: list[np.ndarray], boxes: list[np.ndarray]) -> np.ndarray:
    """The share of each line (page, left, top, right, bottom) that the boxes of its page cover together; boxes are sorted by page."""
    page, x0, y0, x1, y1 = lines
    i, j = _pairs(*_found(boxes[0], page))
    bx0, by0, bx1, by1 = (b[j] for b in boxes[1:])
    met = (bx0 < x1[i]) & (bx1 > x0[i]) & (by0 < y1[i]) & (by1 > y0[i])
    i, bx0, by0, bx1, by1 = i[met], bx0[met], by0[met], bx1[met], by1[met]
    one = np.zeros(len(page), bool)
    one[i[(bx0 <= x0[i]) & (bx1 >= x1[i]) & (by0 <= y0[i]) & (by1 >= y1[i])]] = True
    cx0, cy0, cx1, cy1 = np.maximum(bx0, x0[i]), np.maximum(by0, y0[i]), np.minimum(bx1, x1[i]), np.minimum(by1, y1[i])
    clip = np.maximum(cx1 - cx0, 0) * np.maximum(cy1 - cy0, 0)
    n = np.bincount(i, minlength=len(page))
    area = np.zeros(len(page), np.int64)
    np.add.at(area, i, clip)
    begin = np.cumsum(n) - n
    two = np.flatnonzero((n == 2) & ~one)
    a, b = begin[two], begin[two] + 1
    area[two] -= np.maximum(np.minimum(cx1[a], cx1[b]) - np.maximum(cx0[a], cx0[b]), 0) * np.maximum(np.minimum(cy1[a], cy1[b]) - np.maximum(cy0[a], cy0[b]), 0)
    for k in np.flatnonzero((n > 2) & ~one):
        s = slice(begin[k], begin[k] + n[k])
        area[k] = _union(list(zip(*(c[s].tolist() for c in (cx0, cy0, cx1, cy1)))))
    w, h = x1 - x0, y1 - y0
    whole = w.astype(np.float64) * h
    out = np.where(one, 1.0, area / np.where(whole == 0, 1.0, whole))
    return np.where((n == 0) | (w <= 0) | (h <= 0), 0.0, out)


_BOX = pa.struct([("kind", pa.int32()), *((c, pa.int32()) for c in ("x0", "y0", "x1", "y1"))])
_JUDGED = "struct<full:boolean,reason:int,why:int,kind:int,coverage:double,in_table:boolean,held:int,rs:array<struct<kind:int,x0:int,y0:int,x1:int,y1:int>>>"


def judge(columns: list[pa.Array], reader: Reader, size: tuple[int, int], params: RegionParams | None, pad: int, covered: bool) -> pa.StructArray:
    """For rows (doc_id, page, line_no, text, left, top, width, height, told) by document and page, see judged."""
    doc, page, no, text, *geometry, told = columns
    n = len(doc)
    new_doc = changes(doc)
    new_page = changes(doc, page)
    d, p = np.cumsum(new_doc), np.cumsum(new_page)
    starts = np.append(0, np.flatnonzero(new_page))
    ends = np.append(starts[1:], n)
    pages = len(starts)
    no, left, top, width, height = (numbers(x) for x in (no, *geometry))
    # facts by code: of plain texts by their shape, of others a row each
    odd = told.is_valid()
    coded = pc.if_else(odd, pa.scalar(None, pa.string()), _shapes(text)).dictionary_encode()
    facts = [reader.told(s) for s in coded.dictionary.to_pylist()]
    code = numbers(coded.indices)
    some = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    code[some] = len(facts) + np.arange(len(some))
    facts += [(int(b), names.split(), words.split()) for b, names, words in (x.split("\t") for x in told.take(pa.array(some)).to_pylist())]
    null = text.is_null().to_numpy(zero_copy_only=False)
    code[null] = len(facts)
    facts.append((0, (), ()))
    # by page, top and number
    o = np.lexsort((no, top, p))
    d, p, no, left, top, width, height, code, null = (x[o] for x in (d, p, no, left, top, width, height, code, null))
    end, right = top + height, left + width
    bits = np.array([f[0] for f in facts], np.int64)[code]
    is_ = lambda k: (bits & _BIT[k]) != 0
    full = is_("full")
    # item tables
    by_height = height[np.lexsort((height, p))]
    m = ends - starts
    gap = P.TABLE_GAP * ((by_height[starts + (m - 1) // 2] + by_height[starts + m // 2]) / 2)
    money = np.flatnonzero(is_("money"))
    bp, b0, b1 = _bands(p[money], top[money], end[money], gap)
    inside = np.zeros(n, bool)
    if len(bp):
        middle = 2 * top + height
        at = np.searchsorted(bp * _WIDE + 2 * b0, p * _WIDE + middle, "right") - 1
        inside = (at >= 0) & (bp[at] == p) & (middle >= 2 * b0[at]) & (middle <= 2 * b1[at])
    # labelled values
    labeled = np.zeros(n, bool)
    walks = []
    for r, rule in enumerate(RULES):
        label, merged, header = is_(f"label{r}"), is_(f"merged{r}"), is_(f"header{r}")
        paged = np.zeros(pages, bool)
        paged[p[label | merged]] = True
        values = paged[p] & is_(f"value{r}") & ~header
        labeled |= values & (label | merged)
        v, b = np.flatnonzero(values & ~label & ~merged), np.flatnonzero(label)
        i, j = _pairs(*_found(p[b], p[v]))
        v, b = v[i], b[j]
        beside = np.unique(v[(end[v] >= top[b]) & (top[v] <= end[b])])
        labeled[beside] = True
        if rule.header:
            walks += [(beside, is_("detail")), (np.flatnonzero(header), is_(f"value{r}"))]
    column = P.COLUMN_GAP * (gap / P.TABLE_GAP)
    order = p * _WIDE + top
    for begin, good in walks:
        x0, x1, bottom, to = left[begin], right[begin], end[begin], ends[p[begin]]
        j = np.searchsorted(order, p[begin] * _WIDE + bottom, "left")
        while len(j):
            on = j < to
            j, x0, x1, bottom, to = j[on], x0[on], x1[on], bottom[on], to[on]
            middle = 2 * left[j] + width[j]
            met = (top[j] >= bottom) & (middle >= 2 * x0) & (middle <= 2 * x1) & ~null[j]
            taken = met & ~inside[j] & (top[j] - bottom <= column[p[j]]) & good[j]
            labeled[j[taken]] = True
            bottom = np.where(taken, end[j], bottom)
            on = taken | ~met
            j, x0, x1, bottom, to = j[on] + 1, x0[on], x1[on], bottom[on], to[on]
    # names, met on their page or a later one of the document
    met = np.zeros(n, bool)
    ids = {}
    for _, names, _ in facts:
        for x in names:
            ids.setdefault(x, len(ids))
    if ids:
        rows, which = _listed([[ids[x] for x in f[1]] for f in facts], code)
        key = d[rows] * len(ids) + which
        k = np.lexsort((p[rows], key))
        key, since = key[k], p[rows][k]
        key, first = np.unique(key, return_index=True)
        since = since[first]
        rows, which = _listed([[ids[x] for x in f[2] if x in ids] for f in facts], code)
        wanted = d[rows] * len(ids) + which
        at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
        met[rows[(key[at] == wanted) & (since[at] <= p[rows])]] = True
    reason = np.where(labeled, 1, np.where(is_("ruled"), 2, np.where(met, 3, 0)))
    asked = np.flatnonzero(full & ~inside & (reason == 0))
    hit = (bits[asked] & _BIT["pii"]) != 0
    maybe = np.flatnonzero((bits[asked] & _BIT["asked"]) != 0)
    hit[maybe] = [reader.hit(x) for x in text.take(pa.array(o[asked[maybe]])).to_pylist()]
    reason[asked[hit]] = 4
    reason[~full] = 0
    # regions
    rp = rk = np.zeros(0, np.int64)
    rx = [rp] * 4
    if params:
        rp, rk, rx = _regions(p, no, left, top, right, end, full, is_("ruled") | is_("org"), is_("address"), size, params)
    share, why, kind = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    if covered:
        own = np.flatnonzero(reason > 0)
        boxes = [np.concatenate(x) for x in zip((p[own], left[own] - pad, top[own] - pad, right[own] + pad, end[own] + pad), (rp, *rx))]
        k = np.argsort(boxes[0], kind="stable")
        boxes = [x[k] for x in boxes]
        whole = (reason > 0) & (width > 0) & (height > 0) & (pad >= 0)
        share[whole] = 1.0
        rest = np.flatnonzero(full & ~whole)
        line = [x[rest] for x in (p, left, top, right, end)]
        share[rest] = shares(line, boxes)
        kept = share <= P.UNTOUCHED
        kind = np.where(kept, 0, np.where(share >= P.COVERED, 1, 2))
        why = np.where(kept, np.where(inside & (reason == 0), 5, 0), reason)
        open_ = np.flatnonzero(full & ~kept & (reason == 0))
        why[open_] = np.where(shares([x[open_] for x in (p, left, top, right, end)], [rp, *rx]) > P.UNTOUCHED, 6, 7)
    held = np.bincount(p[inside], minlength=pages)
    back = np.empty(n, np.int64)
    back[o] = np.arange(n)
    out = lambda x, t: pa.array(x[back], t)
    leads = np.ones(n, bool)
    leads[starts] = False
    each = np.zeros(n + 1, np.int64)
    each[starts + 1] = np.bincount(rp, minlength=pages)
    held_ = np.zeros(n, np.int64)
    held_[starts] = held
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum(each), pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in (rk, *rx)], fields=list(_BOX)), mask=pa.array(leads))
    number = lambda x: pa.array(x[back], pa.int32(), mask=x[back] == 0)
    return pa.StructArray.from_arrays(
        [out(full, pa.bool_()), number(reason), number(why), out(kind, pa.int32()), out(share, pa.float64()), out(inside, pa.bool_()), pa.array(held_, pa.int32(), mask=leads), lists],
        ["full", "reason", "why", "kind", "coverage", "in_table", "held", "rs"],
    )


def _listed(lists: list[list[int]], code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) for each value in the list of each row's code."""
    many = np.array([len(x) for x in lists], np.int64)
    flat = np.array([y for x in lists for y in x], np.int64)
    i, j = _pairs((np.cumsum(many) - many)[code], many[code])
    return i, flat[j]


def _regions(p, no, left, top, right, end, full, sender_anchor, recipient_anchor, size, params: RegionParams) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(page, kind, [x0, y0, x1, y1]) of all regions, by page and kind: see regions.seeds and regions.page_boxes."""
    w, h = map(float, size)
    never = np.zeros(len(p), bool)
    header = top < params.header_frac * h if params.header_frac * h > 0 else never
    footer = end > h - params.footer_frac * h if params.footer_frac > 0 else never
    sender = (left >= params.column_x_frac * w) & (top <= params.column_y_frac * h) if params.column_x_frac < 1 and params.column_y_frac > 0 else never
    y_min, y_max = params.recipient_y_min_frac * h, params.recipient_y_max_frac * h
    recipient = (left < params.column_x_frac * w) & (top >= y_min) & (top <= y_max) if y_max > y_min else never
    marks = np.where(sender_anchor, header * 1 + footer * 2 + sender * 4, 0) + 8 * (recipient & recipient_anchor)
    marks[~full] = 0
    seeded = np.zeros(p[-1] + 1, bool)
    seeded[p[marks != 0]] = True
    on = np.flatnonzero(seeded[p] & full)
    page, block = p[on], _labels(p[on], left[on], top[on], end[on] - top[on], no[on], params)
    k = np.lexsort((block, page))
    page, block, on = page[k], block[k], on[k]
    if not len(on):
        return page, page, [page] * 4
    at = np.flatnonzero(np.append(True, (page[1:] != page[:-1]) | (block[1:] != block[:-1])))
    page, bits = page[at], np.bitwise_or.reduceat(marks[on], at)
    x0, y0, x1, y1 = np.minimum.reduceat(left[on], at), np.minimum.reduceat(top[on], at), np.maximum.reduceat(right[on], at), np.maximum.reduceat(end[on], at)
    out, (width, height), pad = [], size, params.padding
    edge = params.header_frac * height
    foot = height - (height - (height - params.footer_frac * height)) * P.BAND_STRETCH
    for i, fold, y in ((0, np.maximum, y1), (1, np.minimum, y0)):
        s = np.flatnonzero(bits & (1 << i))
        if len(s):
            first = np.flatnonzero(np.append(True, page[s][1:] != page[s][:-1]))
            reach, q = fold.reduceat(y[s], first).astype(np.float64), page[s][first]
            z = np.zeros(len(q), np.int64)
            low = np.rint(np.minimum(reach, edge * P.BAND_STRETCH)).astype(np.int64) + pad
            high = np.rint(np.maximum(reach, float(foot))).astype(np.int64) - pad
            out.append((q, z + i, z, high if i else z, z + width, z + height if i else low))
    for i in (2, 3):
        s = np.flatnonzero(bits & (1 << i))
        out.append((page[s], np.full(len(s), i), x0[s] - pad, y0[s] - pad, x1[s] + pad, y1[s] + pad))
    page, kind, *box = (np.concatenate(x) for x in zip(*out))
    k = np.lexsort((kind, page))
    return page[k], kind[k], [b[k] for b in box]


def by_documents(f: Callable[[list[pa.Array]], pa.Array], returns: str, *columns: Column) -> Column:
    """A column that f gives for whole documents: the first column is the document."""

    def run(batches):
        for c in chunks(batches):
            yield f(c)

    # types are given here, as annotations would be names that a worker has to resolve
    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    # said to be non-deterministic, so that no filter on what it tells is pushed below it, to ask twice
    return F.arrow_udf(run, returns).asNondeterministic()(*columns)


def judged(lines: DataFrame, size: tuple[int, int], params: RegionParams | None, kinds: Sequence[str] | None, least: float, pad: int, covered: bool = True) -> DataFrame:
    """lines, by document and page, with a struct `j`: full (not blank), reason and why (by number in REASONS, from 1), kind (in KINDS), coverage and in_table as
    verdicts.outcome_documents has them; on the first line of a page, held and the boxes of its regions rs, too. kinds: those of the classifier, if there is one.
    Without `covered`, neither kind nor coverage nor why is told."""
    recognisers = [(r["pattern"], r.get("context"), _CHECKS[r["keep"]] if r.get("keep") else None) for r in T._recognisers(kinds or (), least)]

    def answer(columns: list[pa.Array], readers: list = []) -> pa.Array:  # noqa: B006: one reader for each worker
        if not readers:
            readers.append(Reader(recognisers))
        return judge(columns, readers[0], size, params, pad, covered)

    text = F.col("text")
    rows = by_document(lines).sortWithinPartitions("doc_id", "page")
    rows = rows.select(*lines.columns, F.when(~text.rlike(PLAIN), _told(text, kinds or (), least)).alias("__told"))
    columns = [F.col(c) for c in ("doc_id", "page", "line_no", "text", "left", "top", "width", "height", "__told")]
    return rows.withColumn("j", by_documents(answer, _JUDGED, *columns)).drop("__told")


def named(number: Column, names: list[str]) -> Column:
    """The name behind a number from 1 on; null for none."""
    return F.get(F.array(*map(F.lit, names)), number - 1)
