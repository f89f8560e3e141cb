"""Format-preserving pseudonyms of personal data: a keyed Feistel permutation within each format.

Numbers and dates are found by their form and then validated; what passes is read as a number below N, the count of valid
values of its format, and permuted among those. So a card keeps its length and a right check digit, a date stays a date, and
letters, digits and separators stay where they are. The permutation depends on the kind of value, its size and the key alone:
equal values get equal pseudonyms in every document, in whatever grouping they are written, and different ones differ.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from footprints.llm.storage import fresh, prepared
from footprints.llm.text import PIECE_BYTES, pieces

ROUNDS = 10
# For demonstration; a user brings a secret of their own.
DEMONSTRATION_KEY = b"not a secret"
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
KINDS = ["email", "iban", "date", "ssn", "ip", "phone", "card", "secret"]

# Characters of an IBAN by country; others are found too, the longest valid one first.
IBAN_LENGTHS = {
    x[:2]: int(x[2:])
    for x in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 "
        "IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 "
        "TN24 TR26 UA29 VA22 VG24 XK20"
    ).split()
}

# Forms; what stands around them must not continue them. Runs are bounded or possessive, so that no text takes long.
_FORMS = [
    r"(?P<email>(?<![A-Za-z0-9_%+-])[A-Za-z0-9_%+-][A-Za-z0-9._%+-]{0,63}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-]))",
    r"(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))",
    r"(?P<date>(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}(?P<point>[./])[0-9]{2}(?P=point)[0-9]{4})(?![0-9]|[./-][0-9]))",
    r"(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9]))",
    r"(?P<ip>(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9]))",
    r"(?P<phone>(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){1,4}|(?:\([0-9]{3}\)[ ]?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4})(?![0-9]))",
    r"(?P<card>(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9]))",
    r"(?P<secret>(?<![0-9A-Za-z])[0-9A-Fa-f]{32,128}(?![0-9A-Za-z]))",
]
FORMS = re.compile("|".join(_FORMS))
FORM = {kind: re.compile(form) for kind, form in zip(KINDS, _FORMS)}
_DIGITS, _LOWER, _UPPER, _HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"


def permuted(x: int, n: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0..n-1: rounds on two unequal halves, walked on until the result is below n."""
    if n < 2:
        return x
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    while True:
        left, right, m, k = x // b, x % b, a, b
        for i in range(ROUNDS):
            digest = hashlib.blake2b(f"{tweak}:{n}:{i}:{right}".encode(), key=key[:64]).digest()
            left, right = right, (left + int.from_bytes(digest, "big")) % m
            m, k = k, m
        # After an even number of rounds the halves are back in place.
        x = left * b + right
        if x < n:
            return x


def luhn(digits: str) -> int:
    """0 for a number whose check digit is right."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10


def iban_rest(code: str) -> int:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97


def _classes(text: str) -> list[str | None]:
    return [_DIGITS if c in _DIGITS else _LOWER if c in _LOWER else _UPPER if c in _UPPER else None for c in text]


def _mixed(text: str, classes: list[str | None], key: bytes, tweak: str) -> str:
    """Letters and digits permuted together, each staying of its class."""
    x, n = 0, 1
    for c, chars in zip(text, classes):
        if chars:
            x, n = x * len(chars) + chars.index(c), n * len(chars)
    x = permuted(x, n, key, tweak)
    out = []
    for c, chars in zip(reversed(text), reversed(classes)):
        if chars:
            x, i = divmod(x, len(chars))
            c = chars[i]
        out.append(c)
    return "".join(reversed(out))


def _regrouped(text: str, plain: str) -> str:
    """The characters of ``plain`` in place of the letters and digits of ``text``."""
    rest = iter(plain)
    return "".join(next(rest) if c.isalnum() else c for c in text)


def _in_case_of(text: str, plain: str) -> str:
    """``plain`` in the case of the letters of ``text`` at the same places; digits go with the letter before them, or the first one."""
    upper = next(c for c in text if c.isalpha()).isupper()
    out = []
    for old, new in zip(text, plain):
        upper = old.isupper() if old.isalpha() else upper
        out.append(new.upper() if upper else new)
    return "".join(out)


@lru_cache(100_000)
def pseudonym(kind: str, text: str, key: bytes) -> str | None:
    """What the value becomes, or null if it is not valid for its kind."""
    digits = re.sub("[^0-9]", "", text)
    if kind == "email":
        # The domain says where mail goes, not whose it is.
        local, _, domain = text.partition("@")
        return _mixed(local, _classes(local), key, "email:" + re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", local)))) + "@" + domain
    if kind == "iban":
        plain = text.replace(" ", "")
        if not 15 <= len(plain) <= 34 or iban_rest(plain) != 1:
            return None
        body = _mixed(plain[4:], _classes(plain[4:]), key, "iban:" + plain[:2])
        check = 98 - iban_rest(plain[:2] + "00" + body)
        return _regrouped(text, f"{plain[:2]}{check:02d}{body}")
    if kind == "date":
        order = (digits[:4], digits[4:6], digits[6:]) if text[4] == "-" else (digits[4:], digits[2:4], digits[:2])
        try:
            day = datetime.date(*map(int, order)).toordinal()
        except ValueError:
            return None
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        new = datetime.date.fromordinal(FIRST_DAY + permuted(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date"))
        return new.isoformat() if text[4] == "-" else f"{new.day:02d}{text[2]}{new.month:02d}{text[2]}{new.year:04d}"
    if kind == "ssn":
        area, group, serial = int(digits[:3]), int(digits[3:5]), int(digits[5:])
        if area in (0, 666) or area >= 900 or group == 0 or serial == 0:
            return None
        x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        x, serial = divmod(permuted(x, 898 * 99 * 9999, key, "ssn"), 9999)
        area, group = divmod(x, 99)
        return f"{area + 1 + (area + 1 >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"
    if kind == "ip":
        parts = text.split(".")
        if any(int(p) > 255 or p != str(int(p)) for p in parts):
            return None
        x = permuted(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, "ip")
        return ".".join(map(str, x.to_bytes(4, "big")))
    if kind == "phone":
        if not 8 <= len(digits) <= 15:
            return None
        # The country code stays: what follows the plus sign up to a separator, else one digit.
        country = len(re.match(r"\+([0-9]{1,3})(?=[ .(-])|\+[0-9]|", text).group().lstrip("+"))
        rest = digits[country:]
        return _regrouped(text, digits[:country] + str(permuted(int(rest), 10 ** len(rest), key, f"phone:{digits[:country]}")).zfill(len(rest)))
    if kind == "card":
        if luhn(digits) or set(digits) == {"0"}:
            return None
        body = str(permuted(int(digits[:-1]), 10 ** (len(digits) - 1), key, "card")).zfill(len(digits) - 1)
        return _regrouped(text, body + str(-luhn(body + "0") % 10))
    if not (re.search("[0-9]", text) and re.search("[A-Fa-f]", text)):
        return None
    return _in_case_of(text, f"{permuted(int(text, 16), 16 ** len(text), key, 'secret'):0{len(text)}x}")


def _ends(kind: str, text: str, start: int, end: int) -> list[int]:
    """Where a value of this form may end, the longest first: forms in groups may have taken in groups of what follows, such as a date."""
    if kind not in ("iban", "card"):
        return [end]
    ends = [end, *(i for i in range(end - 1, start, -1) if not text[i].isalnum())]
    lengths = {i: sum(c.isalnum() for c in text[start:i]) for i in ends}
    if kind == "card":
        return [i for i in ends if lengths[i] >= 13]
    # The length that the country has goes first.
    return sorted((i for i in ends if lengths[i] >= 15), key=lambda i: lengths[i] != IBAN_LENGTHS.get(text[start : start + 2]))


def _valid(kind: str, text: str, start: int, key: bytes) -> tuple[str, int, str] | None:
    """(kind, end, pseudonym) of the first valid value that begins at ``start``, from ``kind`` on in the order of kinds."""
    for kind in KINDS[KINDS.index(kind) :]:
        if match := FORM[kind].match(text, start):
            for end in _ends(kind, text, start, match.end()):
                value = pseudonym(kind, text[start:end], key)
                if value is not None:
                    return kind, end, value
    return None


def replaced(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int, str]]]:
    """The text with pseudonyms, and (kind, start, end, pseudonym) of each; lengths may change only where an address of numbers does."""
    out, spans, done, at = [], [], 0, 0
    while match := FORMS.search(text, at):
        found = _valid(match.lastgroup, text, match.start(), key)
        if found is None:
            # Another value may begin within what was no valid one.
            at = match.start() + 1
            while at < match.end() and text[at - 1].isalnum() and text[at].isalnum():
                at += 1
            continue
        kind, end, value = found
        out += [text[done : match.start()], value]
        spans.append((kind, match.start(), end, value))
        done = at = end
    return "".join([*out, text[done:]]), spans


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("pseudonym", T.StringType())]))
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("pseudonym", pa.string())]))


def pseudonymised(docs: DataFrame, key: bytes = DEMONSTRATION_KEY) -> DataFrame:
    """The documents with pseudonyms in their texts, and ``pii``: kind, start and end in the old text, and pseudonym of each value.

    Found are mail addresses, IBANs, dates from 1900 to 2099, social security numbers, IPv4 addresses, telephone numbers, card
    numbers and hexadecimal secrets in either case; numbers that fail validation stay. At equal places the kinds go first in that order, and
    values do not overlap. A null text stays null, with no values. A value may be its own pseudonym once in N cases, as in any
    permutation. A column ``pii`` of the documents is replaced; all others stay.
    """
    prepared(docs.sparkSession)
    docs = docs.drop("pii")
    names = docs.columns

    def run(batches):
        for batch in batches:
            for part in pieces(batch, limit=PIECE_BYTES):
                texts, found = [], []
                for text in part.column("text").to_pylist():
                    spans = []
                    if text is not None and _HINT.search(text):
                        text, spans = replaced(text, key)
                    texts.append(text)
                    found.append([{"kind": k, "start": s, "end": e, "pseudonym": v} for k, s, e, v in spans])
                columns = [pa.array(texts, part.schema.field("text").type) if c == "text" else part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, _ARROW_SPANS)], names=[*names, "pii"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("pii", SPANS)]))


# Every form holds a digit or an at sign.
_HINT = re.compile("[0-9@]|[A-Fa-f]{32}")


def without_personal_data(docs: DataFrame, key: bytes = DEMONSTRATION_KEY) -> DataFrame:
    """The documents' own columns, n_chars following the texts."""
    whole = fresh(docs, "_doc")
    found = pseudonymised(docs.select(F.struct(*docs.columns).alias(whole), "text"), key)
    columns = [
        F.col("text") if c == "text" else F.when(F.size("pii") > 0, F.length("text")).otherwise(F.col(f"{whole}.{c}")).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"{whole}.`{c}`")
        for c in docs.columns
    ]
    return found.select(*columns)
