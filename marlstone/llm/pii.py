"""Personal information inside free text: finding it, and format-preserving pseudonyms in its place.

Emails, phone numbers, identity numbers, bank and card numbers, street addresses and full names are found by their
written form, dates where a birth is spoken of. Each find is replaced by a typed placeholder. Numbers and dates keep
their format: they go through a keyed Feistel permutation of all numbers of that length or of all days, so that two
documents with the same number still show the same one and nobody without the key can go back. A card or bank number
is one only if its check digits hold, and holds them again afterwards. Other values become a keyed tag, equal for
equal values.

A full name is told by a title or an attribution before it, by a common given name, or by the names the collection
itself uses: an email address of two names, as in ``first.last@``, is evidence of a given and a family name, and so is
a name that is told otherwise. Two capitalised words are a name if the first is a given name by the evidence of two different
family names; where the order is turned or all is in capitals, the other must be a family name too. The evidence of
all texts of all tables is counted, and candidates are joined to it, so nothing grows on the driver or is broadcast.
"""

from __future__ import annotations

import datetime
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.session import written

KINDS = ("email", "phone", "id_number", "address", "name")

# Words of postal addresses, given names and endings of family names that names are told by.
STREET_WORDS = "Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Boulevard|Blvd|Drive|Dr|Close|Court|Ct|Way|Place|Square|Terrace|Crescent|Highway|Hwy"
STREET_FIRST = "Calle|Avenida|Avda|Plaza|Paseo|Rue|Via|Viale|Place de|Rua"
STREET_TAILS = "weg|straße|strasse|str\\.|platz|gasse|allee|damm|ring|ufer"
GIVEN_NAMES = (
    "Adam Ahmed Aisha Alice Amina Ana Andrea Anna Anouk Anton Arjun Ben Bruna Carl Carla Carlos Chiara Clara Daniel Dario David Deepak Elena Emma Eric Eva Fatima Felix Fenja "
    "Francesca Frank George Giulia Hans Hassan Helen Hiroshi Imre Ines Ingrid Ivan James Jane Jean Joana John Jose Julia Karl Katarzyna Kofi Kwame Laura Leda Leila Linda Louis "
    "Lucas Luis Lukas Magdalena Marek Maren Maria Mark Martin Mary Matteo Mehmet Michael Mohammed Nadia Nina Olga Oliver Olumide Omar Oriel Ottmar Paul Peter Petra Pierre "
    "Priya Quentin Rajesh Robert Ruben Sakura Salka Sara Sarah Simon Sindre Sofia Stefan Susan Svetlana Tilda Tobin Thomas Ulric Vesna Victor Vikram Walter Wei William Wim Xenia "
    "Yorick Yuki Yusra Zelda Zhang"
).split()
TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Madame|Monsieur"

#: Nothing that would make the find a part of a longer word; an escaped line break of JSON text is no word.
_EDGE = r"(?:(?<![\w.+/-])|(?<=\\n)|(?<=\\t)|(?<=\\r))"
_SEP = r"(?:[ .\-\u2010-\u2015\u00a0\u202f]|\\{1,4}u(?:201[0-5]|00a0|202f))"
_LOCAL = r"(?:(?<=\\n)|(?<=\\t)|(?<=\\r)|(?<![\w.+%\\-]))[A-Za-z0-9][\w.+%-]*"
EMAIL = re.compile(
    rf"{_LOCAL}(?:@|%40)(?:[A-Za-z0-9-]+\.)+[A-Za-z]{{2,24}}\b"
    rf"|{_LOCAL}"
    r"\s?[\[({]\s?(?:at|AT)\s?[\])}]\s?[\w-]+(?:\s?(?:[\[({]\s?(?:dot|DOT)\s?[\])}]|\.)\s?[A-Za-z][\w-]*)+"
    rf"|{_LOCAL}"
    r"\s(?:at|AT)\s[\w-]+(?:\s(?:dot|DOT)\s[A-Za-z][\w-]*)+"
)
PHONE = re.compile(
    rf"{_EDGE}(?:tel:)?(?:"
    rf"\+\d{{9,15}}|\+\d{{1,3}}{_SEP}?(?:\(\d{{1,4}}\){_SEP}?)?\d{{1,5}}(?:{_SEP}\d{{2,5}}){{1,4}}"
    rf"|\(\d{{3}}\){_SEP}?\d{{3}}{_SEP}\d{{4}}|\d{{3}}{_SEP}\d{{3}}{_SEP}\d{{4}}|0\d{{2,4}}[ /-]\d{{6,8}}"
    r")(?![\w-]|\.\d)(?:,? ?(?:ext\.?|x) ?\d{1,5})?"
)
ID_NUMBER = re.compile(
    rf"{_EDGE}(?:\d{{3}}{_SEP}\d{{2}}{_SEP}\d{{4}}|\d{{1,2}}\.\d{{3}}\.\d{{3}}-[\dKk]|\d{{2}}/\d{{3}}/\d{{5}})(?![\w/-]|\.\d)"
    r"|(?i:\b(?:ssn|social security(?: number)?|national id|tax id|passport(?: no\.?| number)?|identity number)\b[:# ]{1,3})(?:[A-Z]{1,3} ?)?\d(?:[ ./\-\u2010-\u2015]?\d){5,14}(?![\w-])"
    r"|(?i:\b(?:passport|driver'?s? licen[cs]e|driving licen[cs]e|id card)(?: no\b\.?| number)?[:# ]{1,3})(?=[A-Z-]*\d)[A-Z0-9][A-Z0-9-]{5,19}\b"
)
_CITY = r"[A-ZÄÖÜ][\w'-]+(?: [A-ZÄÖÜ][\w'-]+)?"
ADDRESS = re.compile(
    rf"(?<![\w-])\d{{1,5}}[a-zA-Z]? (?:[A-Z][\w'-]+ ){{1,3}}(?:{STREET_WORDS})\b\.?(?:, (?:Apt|Apartment|Suite|Unit|Flat)\.? ?\w+)?(?:, {_CITY})?(?: \d{{4,5}}\b)?"
    rf"|\bP\.? ?O\.? ?Box \d+(?:, (?:[A-Z][\w'-]+ ){{1,3}}(?:{STREET_WORDS})\b\.?)?(?:, {_CITY})?"
    rf"|\b(?:{STREET_FIRST}) (?:[A-Z][\w'-]+ ){{1,3}}\d{{1,4}}\b(?:, \d{{4,5}} {_CITY})?"
    rf"|\b[A-ZÄÖÜ][\w-]*(?:{STREET_TAILS}) \d{{1,4}}\b(?:, \d{{4,5}} {_CITY})?"
)
_UP = r"[A-ZÀ-Ý][a-zà-ÿ']+(?:-[A-ZÀ-Ý][a-zà-ÿ']+)*"
_GIVEN = "|".join(GIVEN_NAMES)
_MIDDLE = r"(?: [A-Z]\.| (?:de|van|von|der|la|di|da))*"
_START = r"(?:(?<![\w-])|(?<=\\n)|(?<=\\t)|(?<=\\r))"
NAME = re.compile(
    rf"{_START}(?:(?:{TITLES})\.? )?(?:(?:{_GIVEN}){_MIDDLE} {_UP}|(?<=[\"'(;|]){_UP}, (?:{_GIVEN})(?: [A-Z]\.)?(?=[\"');|])"
    rf"|(?:{_GIVEN.upper()})(?: [A-Z]\.)? [A-ZÀ-Ý'-]{{3,}})(?![\w-])"
    rf"|{_START}(?:{TITLES})\.? {_UP}{_MIDDLE} {_UP}(?![\w-])"
    rf"|(?:(?:Signed-off-by|Co-authored-by|Reviewed-by|Acked-by|Co-authored by): ?|author=['\"]){_UP}{_MIDDLE} {_UP}(?![\w-])"
)
#: Two words that are a name if the collection knows them as such: in order, turned round, in capitals.
PAIR = re.compile(rf"{_START}(?:({_UP}){_MIDDLE} ({_UP})|({_UP}), ({_UP})(?: [A-Z]\.)?|([A-ZÀ-Ý]{{2,}})(?: [A-Z]\.)? ([A-ZÀ-Ý'-]{{3,}}))(?![\w-])")
CARD = re.compile(r"(?<![\w.+-])(?:4\d{3}|5[1-5]\d\d|2[2-7]\d\d|6(?:011|5\d\d))([ -]?)\d{4}\1\d{4}\1\d{4}(?![\w-]|\.\d)|(?<![\w.+-])3[47]\d\d([ -]?)\d{6}\2\d{5}(?![\w-]|\.\d)")
IBAN = re.compile(r"(?<![\w-])[A-Z]{2}\d\d(?:[A-Z\d]{11,30}|(?: [A-Z\d]{4}){2,7}(?: [A-Z\d]{1,3})?)(?![\w-])")
BIRTH = re.compile(r"(?i:\b(?:born|birth|birthday|birthdate|dob|d\.o\.b|geboren)\b)[^\d\n]{0,16}(\d{4}-\d\d-\d\d|\d\d[./]\d\d[./]\d{4})(?!\d)")
#: Names of mailboxes that are nobody's.
ROLES = frozenset("admin bot build ci dev do help info mail noreply no not office ops release reply root service support team test user web".split())
_HINTED = re.compile(r"(?:(?:Signed-off-by|Co-authored-by|Reviewed-by|Acked-by|Co-authored by): ?|author=['\"])")
#: A first word that is no given name however it is written.
_NOT_GIVEN = frozenset("The A An This That These Those It As If When We They There To By In On At Of Or And But Mask Call Phone Ship Send Apt Box Lines Main According With For From Look One Nobody".split())


# Cheap tests that a text must pass before the patterns of a kind are tried on it; each passes all that its pattern finds.
_EMAIL_LIKE = re.compile(r"[\[({]\s?(?:at|AT)\s?[\])}]|\s(?:dot|DOT)\s")
_NUMBER_LIKE = re.compile(r"\d[^\w\n]{1,2}[\d(]|\d{15}|[A-Z]{2}\d\d[A-Z\d]{11}|[A-Z]{2}\d\d [A-Z\d]{4} |\+\d{9}|\d\\{1,4}u")
_ADDRESS_LIKE = re.compile(rf"\d[a-zA-Z]? [A-Z]|\bP\.? ?O\.? ?B|\b(?:{STREET_FIRST}) [A-Z]|(?:{STREET_TAILS}) \d")
_ID_WORDS = ("ssn", "social security", "national id", "tax id", "passport", "identity number", "licen", "id card")
#: Letters that equal an ASCII one only where a pattern ignores case.
_FOLDED = "\u0130\u0131\u017f\u212a"
_CAPITALS = re.compile(r"[A-Z][A-Za-z]{2,}")
_TITLED = re.compile(rf"(?:{TITLES})\.? [A-ZÀ-Ý]")
_ATTRIBUTIONS = ("-by:", "Co-authored by:", "author='", 'author="')
_NAME_WORDS = frozenset([*GIVEN_NAMES, *map(str.upper, GIVEN_NAMES)])
_ESCAPE = re.compile(r"\\+u[0-9a-f]{4}")


def gates(text: str) -> set[str]:
    """The kinds whose patterns may find something in the text."""
    out = set()
    if "@" in text or "%40" in text or _EMAIL_LIKE.search(text):
        out.add("email")
    if _ADDRESS_LIKE.search(text):
        out.add("address")
    if _NUMBER_LIKE.search(text):
        out |= {"id_number", "phone"}
    else:
        low = text.lower()
        if any(w in low for w in _ID_WORDS) or (not text.isascii() and any(c in text for c in _FOLDED)):
            out.add("id_number")
    if any(x in text for x in _ATTRIBUTIONS) or _TITLED.search(text) or any(w in _NAME_WORDS for w in _CAPITALS.findall(text)):
        out.add("name")
    return out


def find(text: str, known: frozenset = frozenset()) -> list[tuple[int, int, str]]:
    """The ``(start, end, kind)`` of each piece of personal information, in order and apart from each other.

    ``known`` holds the ``(given, family)`` pairs, in small letters, that are names though nothing around them says so.
    """
    out: list[tuple[int, int, str]] = []

    def keep(start: int, end: int, kind: str) -> None:
        if all(end <= s or start >= e for s, e, _ in out):
            out.append((start, end, kind))

    may = gates(text)
    if "email" in may:
        for m in EMAIL.finditer(text):
            keep(m.start(), m.end(), "email")
    if "address" in may:
        for m in ADDRESS.finditer(text):
            keep(m.start(), m.end(), "address")
    if "id_number" in may:
        for m in CARD.finditer(text):
            if luhn(re.sub(r"\D", "", m[0])) == 0:
                keep(m.start(), m.end(), "id_number")
        for m in IBAN.finditer(text):
            if bank_rest(m[0]) == 1:
                keep(m.start(), m.end(), "id_number")
        for m in ID_NUMBER.finditer(text):
            keep(m.start(), m.end(), "id_number")
    for m in BIRTH.finditer(text):
        if day_of(m[1]):
            keep(*m.span(1), "date")
    if "phone" in may:
        for m in PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, re.split("ext|x", _ESCAPE.sub("-", m[0]))[0])) <= 15:
                keep(m.start(), m.end(), "phone")
    if "name" in may:
        for m in NAME.finditer(text):
            start = m.start()
            hint = _HINTED.match(m[0])
            start += hint.end() if hint else 0
            if text[start : m.end()].split()[0] not in _NOT_GIVEN:
                keep(start, m.end(), "name")
    if known:
        for start, end, given, family, _ in pairs_of(text):
            if (given, family) in known:
                keep(start, end, "name")
    return sorted(out)


def pairs_of(text: str) -> list[tuple[int, int, str, str, bool]]:
    """``(start, end, given, family, sure)`` of two words that may be a name; unless ``sure``, the family name must be known as well."""
    out = []
    at = 0
    while m := PAIR.search(text, at):
        one, two, last, first, big, bigger = m.groups()
        given, family = (one, two) if one else (first, last) if first else (big, bigger)
        if not (one and one in _NOT_GIVEN):
            out.append((*m.span(), given.lower(), family.lower(), bool(one)))
        at = m.start(2) if one else m.start() + len(last or big)  # the second word may be the first of a name
    return out


def evidence(text: str, finds: list[tuple[int, int, str]]) -> set[tuple[str, str]]:
    """The ``(given, family)`` pairs, in small letters, that emails of two names and names that are told without them tell of."""
    out = set()
    for start, end, kind in finds:
        value = text[start:end]
        if kind == "email":
            local = re.split(r"@|%40|\s?[\[({]\s?(?:at|AT)|\s(?:at|AT)\s", value)[0]
            parts = re.split(r"[._-]", re.sub(r"\d+$", "", local.split("+")[0]).lower())
            if len(parts) == 2 and all(len(x) > 1 and x.isalpha() for x in parts) and parts[0] not in ROLES:
                out.add((parts[0], parts[1]))
        elif kind == "name" and (m := re.fullmatch(rf"(?:(?:{TITLES})\.? )?({_UP}){_MIDDLE} ({_UP})", value)):
            out.add((m[1].lower(), m[2].lower()))
    return out


def luhn(digits: str) -> int:
    """The weighted sum of the digits modulo 10; 0 if the last is the right check digit."""
    return sum(d if i % 2 == 0 else (2 * d) % 10 + d // 5 for i, d in enumerate(map(int, reversed(digits)))) % 10


def bank_rest(account: str) -> int:
    """What is left of an international account number modulo 97; 1 if its check digits are right."""
    bare = account.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97


def day_of(text: str) -> datetime.date | None:
    """The day of ``2001-12-31``, ``31.12.2001`` or ``31/12/2001``; null if there is none."""
    parts = [int(x) for x in re.split(r"\D", text)]
    try:
        return datetime.date(*(parts if text[4] == "-" else parts[::-1]))
    except ValueError:
        return None


def permuted(digits: str, key: bytes, back: bool = False) -> str:
    """A keyed Feistel permutation of the decimal numbers of this length (2 or more digits)."""
    n = len(digits)
    if n < 2:
        return digits
    u = n // 2
    a, b = int(digits[:u]), int(digits[u:])
    widths = (u, n - u)
    mark = lambda i, x: int.from_bytes(hashlib.blake2b(b"%d,%d,%d" % (n, i, x), key=key, digest_size=16).digest(), "big")
    for i in reversed(range(10)) if back else range(10):
        m = 10 ** widths[i % 2]
        if back:
            a, b = (b - mark(i, a)) % m, a
        else:
            a, b = b, (a + mark(i, b)) % m
    return f"{a:0{u}d}{b:0{n - u}d}"


def permuted_date(day: datetime.date, key: bytes, back: bool = False) -> datetime.date:
    """A keyed permutation of the days of 1900 to 2099, by walking the cycle of five-digit numbers."""
    first, count = datetime.date(1900, 1, 1).toordinal(), 73_049
    at = day.toordinal() - first
    if not 0 <= at < count:
        return day
    while True:
        at = int(permuted(f"{at:05d}", key, back))
        if at < count:
            return datetime.date.fromordinal(first + at)


def pseudonym(value: str, kind: str, key: bytes) -> str:
    """The typed placeholder of a value: numbers and dates keep their format, others become a keyed tag."""
    if kind in ("phone", "id_number"):
        shown = _ESCAPE.sub("-", value)
        digits = re.sub(r"\D", "", shown)
        card, bank = CARD.fullmatch(shown) and luhn(digits) == 0, IBAN.fullmatch(shown) and bank_rest(shown) == 1
        if card:
            fresh = permuted(digits[:-1], key)
            fresh += str(-luhn(fresh + "0") % 10)
        elif bank:
            fresh = "00" + permuted(digits[2:], key)
        else:
            fresh = permuted(digits, key)
        left = iter(fresh)
        shape = re.sub(r"\d", lambda m: next(left), shown)
        if bank:
            shape = f"{shape[:2]}{98 - bank_rest(shape):02d}{shape[4:]}"
        return f"[{kind.upper()}:{shape}]"
    if kind == "date":
        day = permuted_date(day_of(value), key)
        return f"[DATE:{day.isoformat() if value[4] == '-' else day.strftime(f'%d{value[2]}%m{value[2]}%Y')}]"
    plain = " ".join(value.lower().split())
    return f"[{kind.upper()}:{hashlib.blake2b(plain.encode(), key=key, digest_size=5).hexdigest()}]"


def replaced(text: str, key: bytes, known: frozenset = frozenset()) -> tuple[str, list[str]]:
    """The text with every find replaced by its placeholder, and the kinds of what was replaced."""
    out, at, kinds = [], 0, []
    for start, end, kind in find(text, known):
        out += [text[at:start], pseudonym(text[start:end], kind, key)]
        kinds.append(kind)
        at = end
    return ("".join([*out, text[at:]]) if out else text), kinds


def scrubbed(text: str, key: bytes) -> str:
    """The text with every find replaced by its placeholder."""
    return replaced(text, key)[0]


def _key(secret: str) -> bytes:
    return hashlib.blake2b(secret.encode(), digest_size=32).digest()


def _records(parts: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """``(src, rec_id, t)`` of the records of a non-null key of tables ``(name, table, key, text)``."""
    out = None
    for name, df, key, text in parts:
        rows = df.where(F.col(key).isNotNull()).select(F.lit(name).alias("src"), F.col(key).cast("string").alias("rec_id"), F.col(text).alias("t"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _scanned(records: DataFrame, secret: str) -> DataFrame:
    """``(src, rec_id, kind, given, family)``: a row per kind replaced in a text, ``pair`` for each pair of words that
    may be a name (``turned`` if the family name must be known too) and ``known`` for each that the text tells of."""
    own = _key(secret)

    def scan(batches):
        for batch in batches:
            rows = []
            for src, rid, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                finds = find(t)
                # A kind counts by the placeholder that takes its place.
                rows += [(src, rid, kind, None, None) for kind in {k for s, e, k in finds if pseudonym(t[s:e], k, own) != t[s:e]}]
                rows += [(src, rid, "known", given, family) for given, family in evidence(t, finds)]
                apart = [p for p in pairs_of(t) if all(p[1] <= s or p[0] >= e for s, e, _ in finds)]
                rows += [(src, rid, "pair" if sure else "turned", given, family) for given, family, sure in {p[2:] for p in apart}]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["src", "rec_id", "kind", "given", "family"])

    return written(records.where("t is not null").mapInArrow(scan, "src string, rec_id string, kind string, given string, family string"), "scanned")


def _names(scanned: DataFrame) -> DataFrame:
    """``(src, rec_id, given, family)`` of the pairs of words that the whole collection knows as names."""
    told = scanned.where("kind = 'known'").select("given", "family").distinct()
    given = told.groupBy("given").agg(F.count("*").alias("n")).where("n > 1").select("given")
    pairs = scanned.where("kind in ('pair', 'turned')").select("src", "rec_id", "kind", "given", "family").distinct().join(given, "given", "left_semi")
    # Who is called so somewhere in order may be called so turned round or in capitals.
    family = told.select("family").unionByName(pairs.where("kind = 'pair'").select("family")).distinct()
    sure = pairs.where("kind = 'pair'").unionByName(pairs.where("kind = 'turned'").join(family, "family", "left_semi").select(*pairs.columns))
    return sure.select("src", "rec_id", "given", "family").distinct()


def found_in(parts: list[tuple[str, DataFrame, str, str]], secret: str) -> DataFrame:
    """``(src, rec_id, kind)``, a row per kind replaced in a record of tables ``(name, table, key, text)``.

    Null keys and null texts have none. Repeated rows count once, whatever their texts. Names that the tables
    themselves tell of are found in all of them.
    """
    scanned = _scanned(_records(parts), secret)
    certain = scanned.where(F.col("kind").isin(*KINDS)).select("src", "rec_id", "kind")
    return certain.unionByName(_names(scanned).select("src", "rec_id", F.lit("name").alias("kind"))).distinct()


def pseudonymised_in(parts: list[tuple[str, DataFrame, str, str]], secret: str) -> DataFrame:
    """``(src, rec_id, text, finds)`` for each row of a non-null key: the scrubbed text and the number of finds.

    A null text stays null, with 0 finds. Equal values get equal placeholders in all texts of the same ``secret``.
    """
    own = _key(secret)
    records = _records(parts)
    names = _names(_scanned(records, secret)).groupBy("src", "rec_id").agg(F.collect_set(F.struct("given", "family")).alias("known"))  # of one record's own words

    def scrub(batches):
        for batch in batches:
            texts, finds = [], []
            for t, known in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                new, kinds = (None, []) if t is None else replaced(t, own, frozenset((n["given"], n["family"]) for n in known or []))
                texts.append(new)
                finds.append(len(kinds))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array(finds, pa.int32())], ["src", "rec_id", "text", "finds"])

    return records.join(names, ["src", "rec_id"], "left").select("src", "rec_id", "t", "known").mapInArrow(scrub, "src string, rec_id string, text string, finds int")


def kinds_found(df: DataFrame, key: str, text: str) -> DataFrame:
    """:func:`found_in` of one table: ``(rec_id, kind)``."""
    return found_in([("", df, key, text)], "").select("rec_id", "kind")


def pseudonymised(df: DataFrame, key: str, text: str, secret: str) -> DataFrame:
    """:func:`pseudonymised_in` of one table: ``(rec_id, text, finds)``."""
    return pseudonymised_in([("", df, key, text)], secret).select("rec_id", "text", "finds")
