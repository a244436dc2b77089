"""Format-preserving pseudonyms for personal data.

Validated values (e-mail addresses, payment cards, IBANs, IPv4 addresses, US social security
numbers, phone numbers, dates) are replaced by a keyed permutation of the set of all values
of the same format: a Feistel network over ``a x b`` numbers with cycle walking. The result
is valid again (check digits, calendar, octets), the layout stays, and equal values get equal
pseudonyms in all documents.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import isqrt, prod

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repochron.llm.common import table

ROUNDS = 8
KINDS = ("email", "iban", "ip", "ssn", "date", "card", "phone")
#: Stands for a secret of the operator's user; the registered query needs a fixed one.
DEMO_KEY = "public-demonstration-key"

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ACCENTED = "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
_CLASSES = (_DIGITS, _LOWER, _UPPER, _ACCENTED)
_FIRST_DAY = dt.date(1900, 1, 1).toordinal()
_DAYS = dt.date(2099, 12, 31).toordinal() - _FIRST_DAY + 1


def permute(value: int, size: int, key: bytes, tweak: str, valid: Callable[[int], bool] | None = None) -> int:
    """Keyed permutation of the numbers below ``size`` (those that are ``valid``, which ``value`` is)."""
    if size < 2:
        return value
    a = isqrt(size - 1) + 1
    b = -(-size // a)
    while True:
        left, right = divmod(value, b)
        for k in range(0, ROUNDS, 2):
            left = (left + _round(right, key, f"{tweak}/{size}/{k}")) % a
            right = (right + _round(left, key, f"{tweak}/{size}/{k + 1}")) % b
        value = left * b + right
        if value < size and (valid is None or valid(value)):
            return value


def _round(half: int, key: bytes, tweak: str) -> int:
    data = half.to_bytes(max(1, (half.bit_length() + 7) // 8), "big")
    mac = hashlib.blake2b(data, key=key, person=hashlib.blake2b(tweak.encode(), digest_size=16).digest(), digest_size=32)
    return int.from_bytes(mac.digest(), "big")


def permute_text(text: str, key: bytes, tweak: str) -> str:
    """Permute digits, letters and accented letters of a text, each within its class and place."""
    where = [(i, c) for i, ch in enumerate(text) for c in _CLASSES if ch in c]
    value = 0
    for i, c in where:
        value = value * len(c) + c.index(text[i])
    layout = "".join(str(_CLASSES.index(c)) for _, c in where)
    value = permute(value, prod(len(c) for _, c in where), key, f"{tweak}/{layout}")
    out = list(text)
    for i, c in reversed(where):
        value, at = divmod(value, len(c))
        out[i] = c[at]
    return "".join(out)


def _fill(layout: str, digits: str) -> str:
    """``layout`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if ch in _DIGITS else ch for ch in layout)


def _only_digits(text: str) -> str:
    return "".join(ch for ch in text if ch in _DIGITS)


def luhn_digit(payload: str) -> str:
    """Check digit of a payment card number without its last digit."""
    total = 0
    for i, ch in enumerate(reversed(payload)):
        d = int(ch) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def card(text: str, key: bytes) -> str | None:
    d = _only_digits(text)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1]:
        return None
    body = str(permute(int(d[:-1]), 10 ** (len(d) - 1), key, f"card/{len(d)}")).zfill(len(d) - 1)
    return _fill(text, body + luhn_digit(body))


def _iban_rest(country: str, account: str) -> int:
    return int("".join(str(int(ch, 36)) for ch in account + country + "00")) % 97


def iban_start(text: str) -> str:
    """The longest start of the match (whole groups) that passes mod 97, or nothing."""
    end = len(text)
    while end > 0:
        flat = text[:end].replace(" ", "")
        if 15 <= len(flat) <= 34 and 98 - _iban_rest(flat[:2], flat[4:]) == int(flat[2:4]):
            return text[:end]
        end = text.rfind(" ", 0, end)
    return ""


def iban(text: str, key: bytes) -> str | None:
    if not iban_start(text) == text:
        return None
    flat = text.replace(" ", "")
    account = permute_text(flat[4:], key, f"iban/{flat[:2]}")
    new = flat[:2] + str(98 - _iban_rest(flat[:2], account)).zfill(2) + account
    it = iter(new)
    return "".join(ch if ch == " " else next(it) for ch in text)


def ip(text: str, key: bytes) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    n = int.from_bytes(bytes(map(int, parts)), "big")
    return ".".join(map(str, permute(n, 1 << 32, key, "ip").to_bytes(4, "big")))


def _ssn_ok(n: int) -> bool:
    area, group, serial = n // 1_000_000, n // 10_000 % 100, n % 10_000
    return area not in (0, 666) and area < 900 and group > 0 and serial > 0


def ssn(text: str, key: bytes) -> str | None:
    n = int(_only_digits(text))
    return _fill(text, str(permute(n, 10 ** 9, key, "ssn", _ssn_ok)).zfill(9)) if _ssn_ok(n) else None


def date(text: str, key: bytes) -> str | None:
    """ISO dates, and day/month or month/day dates with four-digit years; years 1900 to 2099."""
    a, b, c = (int(x) for x in re.findall("[0-9]+", text))
    for order, (y, m, d) in (("ymd", (a, b, c)),) if len(text) == 10 and text[4] == "-" else (
            ("dmy", (c, b, a)), ("mdy", (c, a, b))):
        try:
            day = dt.date(y, m, d).toordinal() - _FIRST_DAY
        except ValueError:
            continue
        if not 0 <= day < _DAYS:
            continue
        # all layouts of a date share one permutation, so that a day stays linked across them
        new = dt.date.fromordinal(_FIRST_DAY + permute(day, _DAYS, key, "date"))
        if order == "ymd":
            return new.isoformat()
        sep = next(ch for ch in text if ch not in _DIGITS)
        first, second = (new.day, new.month) if order == "dmy" else (new.month, new.day)
        return f"{first:02d}{sep}{second:02d}{sep}{new.year:04d}"
    return None


def phone(text: str, key: bytes) -> str | None:
    """The country code after ``+`` stays; all layouts of a number share one permutation."""
    lead = re.match(r"\+\d{1,3}(?=\D)", text)
    code, rest = (lead.group(), text[lead.end():]) if lead else ("", text)
    d = _only_digits(rest)
    if not 7 <= len(d) + max(0, len(code) - 1) <= 15 or len(d) < 4:
        return None
    return code + _fill(rest, str(permute(int(d), 10 ** len(d), key, f"phone/{len(d)}")).zfill(len(d)))


def email(text: str, key: bytes) -> str | None:
    """Local part and domain name are permuted (upper and lower case are one); the last label stays."""
    local, domain = text.lower().rsplit("@", 1)
    name, dot, top = domain.rpartition(".")
    if not name or local.startswith(".") or ".." in domain or local.endswith("."):
        return None
    return f"{permute_text(local, key, 'local')}@{permute_text(name, key, 'domain')}{dot}{top}"


_EMAIL = re.compile(r"(?<![\w.+%-])[\w+%-][\w.+%-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.)+[A-Za-z]{2,24}(?![\w-])")
_NUMBER = re.compile(
    r"(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<ip>(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9]))"
    r"|(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9]))"
    r"|(?P<date>(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}(?P<s1>[./-])[0-9]{1,2}(?P=s1)[0-9]{4})(?![0-9]|[./-][0-9]))"
    r"|(?P<card>(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?P<s2>[ -])[0-9]{4}(?P=s2)[0-9]{4}(?P=s2)[0-9]{1,7}|[0-9]{4}(?P<s3>[ -])[0-9]{6}(?P=s3)[0-9]{5})(?![0-9]))"
    r"|(?P<phone>\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
    r"|\+[0-9]{1,3}(?P<s5>[ .-]?)(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:(?:(?P=s5)|-)[0-9]{2,4}){2,4}(?![0-9]|\.[0-9])"
    r"|(?<![0-9(])\([0-9]{3}\)[ -]?[0-9]{3}[ .-][0-9]{4}(?![0-9])"
    r"|(?<![0-9.-])[0-9]{3}(?P<s4>[.-])[0-9]{3}(?P=s4)[0-9]{4}(?![0-9]|[.-][0-9]))")
_RULES = {"email": email, "iban": iban, "ip": ip, "ssn": ssn, "date": date, "card": card, "phone": phone}


@lru_cache(maxsize=1 << 16)
def _pseudonym(kind: str, text: str, key: bytes) -> str | None:
    return _RULES[kind](text, key)


def pseudonymise(text: str, key: bytes) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms, and how many values of each kind it held."""
    count: dict[str, int] = {}

    def replace(old: str, kind: str) -> str | None:
        new = _pseudonym(kind, old, key)
        if new is not None:
            count[kind] = count.get(kind, 0) + 1
        return new

    def numbers(text: str) -> str:
        out, at, pos = [], 0, 0
        while m := _NUMBER.search(text, pos):
            # what an IBAN's pattern took beyond a valid IBAN is searched again
            old = iban_start(m.group()) if m.lastgroup == "iban" else m.group()
            new = replace(old, m.lastgroup) if old else None
            if new is None:
                pos = m.end() if old else m.start() + 1
                continue
            out += text[at: m.start()], new
            at = pos = m.start() + len(old)
        return "".join(out) + text[at:]

    if not _ANY.search(text):
        return text, count
    # addresses first; their spans are not searched again
    parts, at = [], 0
    for m in _EMAIL.finditer(text) if "@" in text else ():
        parts.append(numbers(text[at: m.start()]))
        parts.append(replace(m.group(), "email") or m.group())
        at = m.end()
    parts.append(numbers(text[at:]))
    return "".join(parts), count


_ANY = re.compile("[0-9@]")


def pseudonyms(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` pseudonymised, and ``pii_<kind>`` counts in the struct ``pii``.

    Each row is changed where it lies (no shuffle); whole texts are searched. Values that fail
    their check (Luhn, mod 97, calendar, octets) stay as they are. Null texts stay null, empty texts
    empty; ids are not used, so null and repeated ids do not matter; equal texts get equal results;
    an empty table gives no rows. All columns are kept; an input column named ``pii`` is replaced.
    """
    if not key:
        raise ValueError("a key is needed")
    secret = hashlib.blake2b(key.encode(), digest_size=32).digest()
    others = [c for c in docs.columns if c not in (text_col, "pii")]
    src = docs.select(F.col(text_col).cast("string").alias("t"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(others)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([(k, pa.int32()) for k in KINDS])
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                done = [(None, {}) if t is None else pseudonymise(t, secret) for t in part.column(0).to_pylist()]
                count = [{k: c.get(k, 0) for k in KINDS} for _, c in done]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t for t, _ in done], pa.string()), *part.columns[1:], pa.array(count, kind)], names)

    names = [*src.columns, "pii"]
    out = src.withColumn("pii", F.struct(*[F.lit(0).alias(k) for k in KINDS])).schema
    got = src.mapInArrow(run, out)
    return got.select(*[F.col("t").alias(c) if c == text_col else F.col(f"c{others.index(c)}").alias(c)
                        for c in docs.columns if c != "pii"], "pii")


def op4_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms; ``pii_<kind>`` tells how many values were replaced."""
    got = pseudonyms(table(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY)
    return got.select("doc_id", "text", *[F.col(f"pii.{k}").alias(f"pii_{k}") for k in KINDS])
