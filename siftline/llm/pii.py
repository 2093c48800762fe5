"""Personal information inside free text (problem 6).

``find_spans`` finds typed spans; ``mask_text`` puts ``<TYPE>`` in their places;
``pseudonymise`` replaces validated numbers and dates by a keyed permutation of
their own format (a Feistel network with cycle walking), so the same value has the
same pseudonym in every document, check digits stay valid and separators stay.

Given names come as a gazetteer that ``given_table`` learns from rows known to be
persons, all of them; everything else is rules and check digits. Up to ``most_held``
names every task holds them all; beyond, each text is joined with those it contains.
Texts are scanned whole, each in one Arrow batch with others.

Defined results: null and empty texts have no spans and stay as they are; offsets
count code points, the end exclusive; of overlapping spans the one of the type
earlier in ``TYPES`` stays, then the longer; replayed rows give equal findings,
which count once in the output of ``pii_findings``.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterable, Iterator
from datetime import date, timedelta

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.checks import luhn_ok, verhoeff_ok
from siftline.sources.shared import materialize

TYPES = ("EMAIL_ADDRESS", "CREDIT_CARD", "IN_AADHAAR", "IN_PAN", "PHONE_NUMBER", "STREET_ADDRESS", "PERSON")

# --- check digits -----------------------------------------------------------


def _with_check(body: str, ok) -> str:
    return next(body + d for d in "0123456789" if ok(body + d))


# --- patterns ---------------------------------------------------------------

LETTER = r"(?:[^\W\d_][̀-ͯ]*)"
CAPITAL = r"(?:[A-ZÀ-ÖØ-Þ][̀-ͯ]*)"
NAME = rf"{CAPITAL}(?:{LETTER}|(?<=\w)['’\-](?={LETTER}))+"

EMAIL = re.compile(
    r"(?<![\w.+\-])[A-Za-z0-9][\w.+\-]*(?:\s?(?:@|\(at\)|\[at\]|\{at\})\s?|\s(?:at|AT)\s(?=[\w\-]+(?:\s(?:dot|DOT)\s|\s?[\[({]dot[\])}])))"
    r"[A-Za-z0-9][\w\-]*(?:(?:\.|\s?(?:\(dot\)|\[dot\]|\{dot\})\s?|\s(?:dot|DOT)\s)[A-Za-z0-9\-]+)*"
    r"(?:\.|\s?(?:\(dot\)|\[dot\]|\{dot\})\s?|\s(?:dot|DOT)\s)[A-Za-z]{2,}(?![\w@])",
    re.IGNORECASE,
)
DIGITS = re.compile(r"(?<![\w.,/#+\-])(?:\d[ \-]?){11,15}\d(?![\w]|[.,/\-]\d)")
CARD_SHAPE = re.compile(r"(?:\d{4}([ \-]?)\d{4}\1\d{4}\1\d{4}|\d{4}([ \-]?)\d{6}\2\d{5})")
AADHAAR_SHAPE = re.compile(r"[2-9]\d{3}([ \-]?)\d{4}\1\d{4}")
PAN = re.compile(r"\b[A-Z]{3}[ABCFGHJLPT][A-Z]\d{4}[A-Z]\b")
PHONE = re.compile(
    r"(?<![\w+.,/#\-(])(?<!\d )(?:"
    r"\+\d{1,3}[ .\-]?(?:\(0?\d{0,4}\)[ .\-]?)?\d(?:[ .\-/]?\d){6,11}"
    r"|00\d{1,3}[ .\-]\d{1,4}[ .\-]\d(?:[ .\-]?\d){5,9}"
    r"|\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}|\d{3}([.\- ])\d{3}\1\d{4}"
    r"|\(0\d{2,4}\)[ ]?\d{3,4}[ ]?\d{3,6}|\(0?\d{4,5}\)[ ]?\d{5,6}|0\d{2,3}[ \-]\d{4}[ \-]\d{4}|0\d{4}[ \-]\d{6}"
    r")(?!\w|[.\-/]\d|\s?%)"
)
# Words that make a street of the name before or after them.
STREET_WORDS = ("Street", "St", "Road", "Rd", "Cross Road", "Nagar Road", "Court", "Lane", "Terrace", "Close", "Marg", "Avenue", "Ave", "Drive", "Way", "Square", "Place", "Crescent", "Gardens", "Grove", "Row", "Walk", "Mews", "Boulevard", "Blvd")
STREET_BEFORE = ("Calle", "Avenida", "Plaza", "Paseo", "Via", "Viale", "Piazza")
STREET_ENDS = ("gasse", "strasse", "straße", "str", "allee", "weg", "platz", "ufer")
_HOUSE = r"\d{1,4}(?:-?[A-Za-z](?!\w))?"


def _cases(words: Iterable[str]) -> str:
    ws = sorted({v for w in words for v in (w, w.upper())}, key=len, reverse=True)
    return "|".join(w.replace(" ", r"\s") for w in ws)


_FLAT = r"(?:(?:Flat|FLAT|flat|Apt|APT|Apartment|Unit)\.?\s\d{1,4}[A-Za-z]?,?\s)?"
STREET = re.compile(
    rf"(?<![\w.,\-/])(?:{_FLAT}{_HOUSE},?\s(?:(?!(?:Of|The|And|Or)\s){NAME}\s){{1,3}}?(?:{_cases(STREET_WORDS)})(?!\w)"
    rf"|{_FLAT}{_HOUSE},?\s(?:[Rr]ue|RUE)\s(?:(?:de\sla|de|du|des|DE|DU|De)\s)?{NAME}"
    rf"|(?:{_cases(STREET_BEFORE)})\s(?:(?:de|del|DE)\s)?{NAME},?\s{_HOUSE}(?!\w)"
    rf"|{CAPITAL}{LETTER}*(?:{'|'.join(STREET_ENDS)}|{'|'.join(s.upper() for s in STREET_ENDS)})\.?\s{_HOUSE}(?!\w)"
    rf"|(?:flat\s\d{{1,4}},\s)\d{{1,4}}[a-z]?\s\w+\s(?:{'|'.join(w.lower() for w in STREET_WORDS)})(?!\w)"
    rf"|\d{{1,4}}[a-z]?,?\srue\s(?:de\s)?[a-z]{{5,}}|calle\s[a-z]{{5,}}\s\d{{1,4}}[a-z]?(?!\w)|[a-z]{{4,}}(?:gasse|strasse|straße|allee)\s\d{{1,4}}[a-z]?(?!\w))"
)
TITLE = r"(?:(?:Mr|Mrs|Ms|Miss|Dr|Prof|Eng|Capt|Herr|Frau|Sr|Sra|MR|MRS|MS|DR|PROF|ENG|CAPT)\.?\s)"
INITIALS = re.compile(rf"(?<![\w.\-])(?:{CAPITAL}\.[ \-]?){{1,2}}(?:{CAPITAL}{LETTER}{{3,}})(?!\w)|(?<![\w.])(?:{CAPITAL}{LETTER}{{3,}}),\s?{CAPITAL}\.(?:\s?{CAPITAL}\.)?(?!\w)")
#: Nouns before a letter that names a place, not a person.
LETTERED = frozenset("building block section annex appendix hall room gate table page plan phase unit type class wing bay area zone part grade vitamin".split())
# Words that end the name of a firm, a programme or a product.
FIRM = re.compile(r"\s(?:Holdings?|Scanners?|Group|Ltd|LLC|GmbH|Inc|PLC|plc|AB|Company|Services|Partners|Systems|Network|Works|Insurance|Logistics|Management|Publishing|Foods|Club|College|Cooperative|Leasing|Instruments|Safety|Campaign|Market|HOLDINGS?|SCANNERS?|GROUP|COMPANY|SERVICES|PARTNERS|SYSTEMS)(?!\w)")
AFTER_GIVEN = re.compile(rf"(?:[ \-]{CAPITAL}\.?(?=[ \-]))?(?:[ \-]{CAPITAL}\.?(?=[ \-]))?[ ]({CAPITAL}(?:{LETTER}|['’\-](?={LETTER})){{2,}})(?!\w)")
AFTER_LOWER = re.compile(r" ([a-z]{7,})(?!\w)")
BEFORE_GIVEN = re.compile(rf"(?<![\w\-])({NAME}),\s{TITLE}?$")
INITIAL_AFTER = re.compile(rf"[ \-]{CAPITAL}(?:\.|(?!\w))(?:[ \-]{CAPITAL}\.)?")


def written(given: Iterable[str]) -> Iterator[str]:
    """The ways in which given names may be written."""
    for g in given:
        for form in ("NFC", "NFD"):
            for v in (g, g.upper(), g.lower()):
                yield unicodedata.normalize(form, v)


class Finder:
    """Holds the compiled gazetteer of one list of given names."""

    def __init__(self, given: Iterable[str]):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for w in written(given):
            self.auto.add_word(w, w)
        self.any = len(self.auto) > 0
        if self.any:
            self.auto.make_automaton()

    def hits(self, t: str) -> Iterator[tuple[int, int, str]]:
        for last, w in self.auto.iter(t) if self.any else ():
            yield last - len(w) + 1, last + 1, w

    def given_spans(self, t: str) -> Iterator[tuple[int, int, str]]:
        """(start, end, given name as written) of the persons around given names."""
        for a, b, w in self.hits(t):
            if (a and (t[a - 1].isalnum() or t[a - 1] in "@_.-")) or (b < len(t) and (t[b].isalnum() or t[b] in "@_" or unicodedata.combining(t[b]))):
                continue
            lower = w.islower()
            if not lower and (m := BEFORE_GIVEN.search(t, max(0, a - 60), a)):
                end = m2.end() if (m2 := INITIAL_AFTER.match(t, b)) else b
                yield m.start(1), end, w
                continue
            m = (AFTER_LOWER if lower else AFTER_GIVEN).match(t, b)
            if m and not FIRM.match(t, m.end()) and not FIRM.match(t, m.start(1) - 1):
                yield a, m.end(), w

    def persons(self, t: str) -> Iterator[tuple[int, int]]:
        for a, b, _ in self.given_spans(t):
            yield a, b
        for m in INITIALS.finditer(t):
            before = t[max(0, m.start() - 14) : m.start()].split()
            if before and before[-1].lower() in LETTERED and not before[-1].endswith((".", ",")):
                continue
            if FIRM.match(t, m.end()):
                continue
            yield m.span()


LETTERS = regex.compile(r"[\p{L}\p{M}]+")


class WordFinder(Finder):
    """Looks words up instead of names: those in ``words``, or every word without."""

    def __init__(self, words: Iterable[str] | None = None):
        self.words = None if words is None else set(words)

    def hits(self, t: str) -> Iterator[tuple[int, int, str]]:
        for m in LETTERS.finditer(t):
            a, b = m.span()
            marks = [i for i in range(a, b) if not t[i].isalnum()]  # next to a mark a name may begin or end
            for start in (a, *(i + 1 for i in marks)):
                for end in (*(i for i in marks if i > start), b):
                    if start < end and (self.words is None or t[start:end] in self.words):
                        yield start, end, t[start:end]


def find_spans(text: str, finder: Finder) -> list[tuple[int, int, str]]:
    """(start, end, type) in order of start, not overlapping."""
    found: list[tuple[int, int, str]] = []
    if "@" in text or "at" in text.lower():
        found += [(*m.span(), "EMAIL_ADDRESS") for m in EMAIL.finditer(text)]
    if any("0" <= c <= "9" for c in text):
        for m in DIGITS.finditer(text):
            s, e = m.span()
            digits = re.sub(r"\D", "", m.group())
            if len(digits) in (15, 16) and CARD_SHAPE.fullmatch(m.group()) and luhn_ok(digits):
                found.append((s, e, "CREDIT_CARD"))
            elif len(digits) == 12 and AADHAAR_SHAPE.fullmatch(m.group()) and verhoeff_ok(digits):
                found.append((s, e, "IN_AADHAAR"))
        found += [(*m.span(), "IN_PAN") for m in PAN.finditer(text)]
        found += [(*m.span(), "PHONE_NUMBER") for m in PHONE.finditer(text)]
        found += [(*m.span(), "STREET_ADDRESS") for m in STREET.finditer(text)]
    found += [(a, b, "PERSON") for a, b in finder.persons(text)]
    taken = bytearray(len(text))  # characters of spans of surer types
    kept = []
    for span in sorted(found, key=lambda x: (TYPES.index(x[2]), x[0] - x[1], x[0])):
        place = slice(span[0], span[1])
        if not any(taken[place]):
            taken[place] = bytes([1]) * (span[1] - span[0])
            kept.append(span)
    return sorted(kept)


def mask_text(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``<TYPE>`` in the place of each of the spans, which are in order."""
    ends = [0, *(e for _, e, _ in spans)]
    starts = [*(s for s, _, _ in spans), len(text)]
    between = [text[e:s] for e, s in zip(ends, starts)]
    return "".join(x for pair in zip(between, [*(f"<{k}>" for *_, k in spans), ""]) for x in pair)


# --- format-preserving pseudonyms -------------------------------------------


def permute(value: int, size: int, key: bytes, tweak: bytes = b"", rounds: int = 8) -> int:
    """A keyed permutation of ``range(size)``: balanced Feistel network with cycle walking."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for i in range(rounds):
            f = hmac.new(key, tweak + bytes([i]) + right.to_bytes(16, "big"), hashlib.sha256).digest()
            left, right = right, left ^ (int.from_bytes(f[:16], "big") & mask)
        value = left << half | right
        if value < size:
            return value


def _refill(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


#: Dates by format: ISO, and day first with points or slashes.
DATE = re.compile(r"(?<![\d\-./])(?:(?P<y>(?:19|20)\d\d)-(?P<m>\d\d)-(?P<d>\d\d)|(?P<dd>\d\d?)(?P<sep>[./])(?P<mm>\d\d?)(?P=sep)(?P<yy>(?:19|20)\d\d))(?![\d\-/]|\.\d)")
_FIRST_DAY, _DAYS = date(1900, 1, 1), 73_049  # to the end of 2099


def _shift_date(value: str, key: bytes) -> str | None:
    """Another day in the format of ``value``; a day has one stand-in in all formats. None if it is no date."""
    g = DATE.fullmatch(value)
    try:
        day = date(*(int(g[x] or g[y]) for x, y in (("y", "yy"), ("m", "mm"), ("d", "dd")))) - _FIRST_DAY
    except (TypeError, ValueError):
        return None
    new = _FIRST_DAY + timedelta(permute(day.days, _DAYS, key, b"date"))
    return new.isoformat() if g["y"] else f"{new.day:0{len(g['dd'])}d}{g['sep']}{new.month:0{len(g['mm'])}d}{g['sep']}{new.year}"


def _other_phone(value: str, key: bytes) -> str:
    """Country and area stay, the last six digits change; ``+`` and ``00`` before a country make no difference."""
    digits = re.sub(r"\D", "", value)
    n = min(6, len(digits))
    head = digits[2:-n] if digits.startswith("00") and not value.startswith("+") else digits[:-n]
    return _refill(value, digits[:-n] + f"{permute(int(digits[-n:]), 10**n, key, b'phone' + head.encode()):0{n}d}")


def pseudonym(value: str, kind: str, key: bytes) -> str | None:
    """The stand-in of a validated value in its own format; None for types without one."""
    if kind == "PHONE_NUMBER":
        return _other_phone(value, key)
    if kind in ("CREDIT_CARD", "IN_AADHAAR"):
        digits = re.sub(r"\D", "", value)
        if kind == "CREDIT_CARD":
            n = len(digits) - 1
            return _refill(value, _with_check(f"{permute(int(digits[:n]), 10**n, key, b'card%d' % n):0{n}d}", luhn_ok))
        body = permute(int(digits[:11]) - 2 * 10**10, 8 * 10**10, key, b"aadhaar") + 2 * 10**10
        return _refill(value, _with_check(str(body), verhoeff_ok))
    if kind == "IN_PAN":
        letters = [ord(c) - 65 for c in value[:3] + value[4] + value[9]]
        code = int(value[5:9])
        for x in letters:
            code = code * 26 + x
        code = permute(code, 10**4 * 26**5, key, b"pan" + value[3].encode())
        out = []
        for _ in range(5):
            code, x = divmod(code, 26)
            out.append(chr(65 + x))
        a, b, c, d, e = reversed(out)
        return f"{a}{b}{c}{value[3]}{d}{code:04d}{e}"
    return _shift_date(value, key) if kind == "DATE" else None


def pseudonymise(text: str, spans: list[tuple[int, int, str]], key: bytes) -> str:
    """Numbers and dates by pseudonym, all other findings by placeholder."""
    taken = [(s, e) for s, e, _ in spans]
    dates = [(*m.span(), "DATE") for m in DATE.finditer(text) if all(m.end() <= s or m.start() >= e for s, e in taken)]
    for s, e, k in sorted(spans + dates, reverse=True):
        stand_in = pseudonym(text[s:e], k, key)
        text = text[:s] + (stand_in if stand_in is not None else text[s:e] if k == "DATE" else f"<{k}>") + text[e:]
    return text


# --- Spark ------------------------------------------------------------------


def given_table(persons: DataFrame, name: str = "name", *, least_surnames: int = 3) -> DataFrame:
    """(g): given names, first words of two-word person names seen with several second words. Counts run over all rows."""
    words = F.split(F.trim(F.col(name)), r"\s+")
    pairs = persons.where(F.col(name).rlike(r"^\s*\p{Lu}\p{M}*\p{Ll}[\p{L}\p{M}]+\s+\p{Lu}[\p{L}\p{M}'-]{2,}\s*$")).select(words[0].alias("g"), F.initcap(words[1]).alias("s"))
    return pairs.where(~F.col("g").isin("The", "Dr", "Ms", "Mr", "Mrs", "Prof", "Eng", "Capt")).groupBy("g").agg(F.approx_count_distinct("s").alias("n")).where(F.col("n") >= least_surnames).select("g")


def given_names(persons: DataFrame, name: str = "name", *, least_surnames: int = 3) -> list[str]:
    """All of ``given_table`` as a list, for tables known to be small."""
    return sorted(r["g"] for r in given_table(persons, name, least_surnames=least_surnames).collect())


def _with_names(df: DataFrame, text: str, given: list[str] | DataFrame, most_held: int) -> tuple[DataFrame, list[str] | None]:
    """(rows, names): all names where they are few enough to be held; else None, and the rows with ``_known``, the names written in their text."""
    if not isinstance(given, DataFrame):
        return df, list(given)
    given = materialize(given.select("g").distinct(), "given")
    if given.count() <= most_held:
        return df, sorted(r["g"] for r in given.collect())

    def forms(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"w": sorted({*written(pdf["g"])})})

    def words(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = WordFinder()
        for pdf in it:
            rows = [(h, w) for h, t in zip(pdf["_h"], pdf["t"]) for w in {w for *_, w in every.given_spans(t)}]
            yield pd.DataFrame(rows, columns=["_h", "w"])

    h = F.sha2(F.col(text), 256)
    texts = df.where(F.col(text) != "").select(h.alias("_h"), F.col(text).alias("t"))
    said = texts.mapInPandas(words, "_h string, w string").distinct()
    known = said.join(given.mapInPandas(forms, "w string").distinct(), "w").groupBy("_h").agg(F.collect_set("w").alias("_known"))
    return df.withColumn("_h", h).join(known, "_h", "left").drop("_h").withColumn("_known", F.coalesce("_known", F.array().cast("array<string>"))), None


def pii_findings(df: DataFrame, given: list[str] | DataFrame, *, id: str = "id", text: str = "text", key: bytes, most_held: int = 20_000) -> DataFrame:
    """record_id, start_offset, end_offset, type, stand_in: one row a place, with the pseudonym of a validated number.

    Equal values have equal stand-ins in all records; names, addresses and streets have
    none (null) and go by ``<TYPE>`` alone. ``given``: names, or a table of them (g); a
    table of more than ``most_held`` is joined with the texts.
    """
    columns = ["record_id", "start_offset", "end_offset", "type", "stand_in"]
    rows = df.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(id).cast("string").alias("record_id"), F.col(text).alias("text"))
    rows, names = _with_names(rows, "text", given, most_held)

    def scan(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = None if names is None else Finder(names)
        for pdf in it:
            finders = (finder or WordFinder(k) for k in pdf["_known" if names is None else "text"])
            found = [(r, s, e, k, pseudonym(t[s:e], k, key)) for r, t, f in zip(pdf["record_id"], pdf["text"], finders) if t for s, e, k in find_spans(t, f)]
            yield pd.DataFrame(found, columns=columns)

    return rows.mapInPandas(scan, "record_id string, start_offset int, end_offset int, type string, stand_in string").distinct()


def mask_pii(df: DataFrame, given: list[str] | DataFrame, *, text: str = "text", key: bytes, masked: str = "masked", pseudo: str = "pseudonymous", most_held: int = 20_000) -> DataFrame:
    """``df`` with the text masked by ``<TYPE>`` and with format-preserving pseudonyms; ``given`` as in ``pii_findings``."""
    rest = [c for c in df.columns if c not in (masked, pseudo)]
    df, names = _with_names(df, text, given, most_held)

    @F.pandas_udf("masked string, pseudonymous string")
    def rewrite(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        finder = None if names is None else Finder(names)
        for texts, known in parts:
            out = []
            for t, k in zip(texts, known):
                spans = find_spans(t, finder or WordFinder(k)) if t else []
                out.append((mask_text(t, spans), pseudonymise(t, spans, key)) if t else (t, t))
            yield pd.DataFrame(out, columns=["masked", "pseudonymous"])

    known = F.lit(0) if names is not None else F.col("_known")
    return df.select(*rest, rewrite(F.col(text), known).alias("_r")).select(*rest, F.col("_r.masked").alias(masked), F.col("_r.pseudonymous").alias(pseudo))
