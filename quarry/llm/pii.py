"""PII pseudonyms by format-preserving Feistel permutations.

Found values that pass their check (a card's Luhn digit, an address's octets, a calendar date, a
telephone number's length) are replaced by a keyed permutation of their own format: digits stay
digits, letters letters, separators stand; a card keeps a valid check digit, an address valid
octets, a date is a date. The permutation depends on the key, the kind and the value alone, so
equal values stay linked across documents and different ones stay different. Every pattern begins where
no such value may already have begun, or is bounded, so a text takes time linear in its length.

Defined cases: a null text stays null; texts of any length are searched whole; values that fail
their check stay as they are, but a long run of digits that fails Luhn is still an account
number and permuted as such; other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ROUNDS = 8
_FIRST_DAY, _DAYS = datetime.date(1900, 1, 1).toordinal(), 200 * 365 + 48
_LOWER, _HEX = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
#: What may be a value, by kind.
_FOUND = re.compile(
    r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?P<secret>(?<![0-9A-Za-z])[0-9a-f]{32,64}(?![0-9A-Za-z]))"
    r"|(?P<date>(?<![\d.\-/])(?:\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?![\d\-/]))"
    r"|(?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<phone>(?<![\w+])\+?\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w+])\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]\d{2,4}){2,4}(?!\d)|(?<![\w+.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-]\d))"
    r"|(?P<card>(?<![\w.,-])\d(?:[ -]?\d){12,18}(?![\w-]))"
)


#: Where a value may be: non-blanks with a digit or @, and further ones with digits after blanks.
_TRIGGER, _STRETCH = re.compile("[0-9@]"), re.compile(r"\S+(?: [^\s0-9]*[0-9]\S*)*")


class Permuter:
    """Keyed permutations of the numbers below a bound, by a balanced Feistel network over a
    square that holds them, walked until the image is below the bound again."""

    def __init__(self, key: str) -> None:
        self.key = hashlib.blake2b(key.encode(), digest_size=32).digest()

    def number(self, x: int, bound: int, kind: str) -> int:
        if bound < 2:
            return x
        side = 2
        while side * side < bound:
            side = side * 2 if side * side * 4 < bound else side + max(1, side // 64)
        tag = f"{kind}:{bound}:".encode()
        while True:
            left, right = divmod(x, side)
            for i in range(ROUNDS):
                mixed = hashlib.blake2b(tag + b"%d:%d" % (i, right), key=self.key, digest_size=16).digest()
                left, right = right, (left + int.from_bytes(mixed, "big")) % side
            x = left * side + right
            if x < bound:
                return x

    def signs(self, text: str, alphabet: str, kind: str) -> str:
        x = 0
        for c in text:
            x = x * len(alphabet) + alphabet.index(c)
        x, out = self.number(x, len(alphabet) ** len(text), kind), []
        for _ in text:
            x, i = divmod(x, len(alphabet))
            out.append(alphabet[i])
        return "".join(reversed(out))

    def refill(self, text: str, kind: str, inner: Callable[[str], str]) -> str:
        """text with its digits replaced by those of inner(digits)."""
        new = iter(inner("".join(c for c in text if c.isascii() and c.isdigit())))
        return "".join(next(new) if c.isascii() and c.isdigit() else c for c in text)


def luhn_digit(body: str) -> str:
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def luhn(digits: str) -> bool:
    return luhn_digit(digits[:-1]) == digits[-1]


def _date(p: Permuter, text: str) -> str | None:
    sign = next(c for c in text if not c.isdigit())
    a, b, c = (int(x) for x in text.split(sign))
    y, m, d = (a, b, c) if sign == "-" else (c, b, a) if sign == "." else (c, a, b)
    try:
        day = datetime.date(y, m, d).toordinal() - _FIRST_DAY
    except ValueError:
        return None
    if not 0 <= day < _DAYS:
        return None
    # a date of which both forms are wide is permuted among all days; one with a narrow part among
    # those of the same widths
    widths = [len(x) for x in text.split(sign)]
    while True:
        day = p.number(day, _DAYS, "date")
        new = datetime.date.fromordinal(_FIRST_DAY + day)
        parts = (new.year, new.month, new.day) if sign == "-" else (new.day, new.month, new.year) if sign == "." else (new.month, new.day, new.year)
        out = [str(x).zfill(w) for x, w in zip(parts, widths, strict=True)]
        if [len(x) for x in out] == widths and all(w > 1 or x < 10 for x, w in zip(parts, widths, strict=True)):
            return sign.join(out)


def _card(p: Permuter, text: str) -> str | None:
    def inner(digits: str) -> str:
        if luhn(digits):
            body = p.signs(digits[:-1], "0123456789", "card")
            return body + luhn_digit(body)
        while True:  # an account number stays one that isn't a card's
            digits = p.signs(digits, "0123456789", "account")
            if not luhn(digits):
                return digits

    return p.refill(text, "card", inner)


def _phone(p: Permuter, text: str) -> str | None:
    """The country code, if there is one, stands; so do digits alone don't tell a country."""
    n = sum(c.isdigit() for c in text)
    if not 7 <= n <= 15:
        return None
    lead = re.match(r"\+?\d{1,3}(?=[ .-]?\()|\+\d{1,3}(?=[ .-])", text)
    at = lead.end() if lead else 0
    return text[:at] + p.refill(text[at:], "phone", lambda d: p.signs(d, "0123456789", "phone"))


def _ip(p: Permuter, text: str) -> str | None:
    octets = text.split(".")
    if any(int(o) > 255 or str(int(o)) != o for o in octets):
        return None
    x = p.number(int.from_bytes(bytes(map(int, octets)), "big"), 1 << 32, "ip")
    return ".".join(map(str, x.to_bytes(4, "big")))


def _ssn(p: Permuter, text: str) -> str | None:
    area, group, serial = text.split("-")
    if area in ("000", "666") or area >= "900" or group == "00" or serial == "0000":
        return None
    areas = [a for a in range(1, 900) if a != 666]
    x = p.number((areas.index(int(area)) * 99 + int(group) - 1) * 9999 + int(serial) - 1, len(areas) * 99 * 9999, "ssn")
    x, s = divmod(x, 9999)
    a, g = divmod(x, 99)
    return f"{areas[a]:03d}-{g + 1:02d}-{s + 1:04d}"


def _email(p: Permuter, text: str) -> str | None:
    """Letters and digits of the local part (64 signs at most, as mail allows), each run of them in
    its own format; the domain stands. Capitals count as their letters."""
    local, domain = text.split("@", 1)
    kinds = [c for c in local if c.isascii() and c.isalnum()]
    if not kinds:
        return None
    x, bound = 0, 1
    for c in kinds:
        size = 10 if c.isdigit() else 26
        x, bound = x * size + (int(c) if c.isdigit() else _LOWER.index(c.lower())), bound * size
    x = p.number(x, bound, "email")
    new = []
    for c in reversed(kinds):
        x, i = divmod(x, 10 if c.isdigit() else 26)
        new.append(str(i) if c.isdigit() else _LOWER[i].upper() if c.isupper() else _LOWER[i])
    it = reversed(new)
    return "".join(next(it) if c.isascii() and c.isalnum() else c for c in local) + "@" + domain


def _secret(p: Permuter, text: str) -> str | None:
    return p.signs(text, _HEX, "secret") if any(c.isdigit() for c in text) and any(c in "abcdef" for c in text) else None


_KINDS: dict[str, Callable[[Permuter, str], str | None]] = {"email": _email, "secret": _secret, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonymised(p: Permuter, text: str) -> tuple[str, list[str]]:
    """The text with its values permuted, and the kinds found, in order."""
    kinds: list[str] = []

    def swap(m: re.Match) -> str:
        new = _KINDS[m.lastgroup](p, m.group())
        if new is None:
            return m.group()
        kinds.append(m.lastgroup)
        return new

    out, done = [], 0
    while m := _TRIGGER.search(text, done):
        left = m.start()
        while left > done and not text[left - 1].isspace():
            left -= 1
        right = _STRETCH.match(text, left).end()
        out += (text[done:left], _FOUND.sub(swap, text[left:right]))
        done = right
    return "".join([*out, text[done:]]) if out else text, kinds


def pseudonyms(docs: DataFrame, key: str) -> DataFrame:
    """docs with text replaced; also n_pii and pii_kinds (sorted); columns of docs with these names
    are replaced. Who knows the key can undo the pseudonyms: it belongs in a secret store."""
    if not key:
        raise ValueError("pseudonyms need a key")
    names = [c for c in docs.columns if c not in ("text", "n_pii", "pii_kinds")]
    schema = docs.select(*names, "text", F.lit(0).cast("long").alias("n_pii"), F.array().cast("array<string>").alias("pii_kinds")).schema
    for field in schema:
        field.nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Permuter(key)
        for batch, texts in common.pieces(batches, "text"):
            found = [(None, []) if t is None else pseudonymised(p, t) for t in texts]
            more = {"text": pa.array([t for t, _ in found], pa.string()), "n_pii": pa.array([len(k) for _, k in found], pa.int64()), "pii_kinds": pa.array([sorted(set(k)) for _, k in found], pa.list_(pa.string()))}
            yield common.keep_columns(batch, names, more)

    return docs.transform(common.in_arrow, run, schema)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is the session's spark.quarry.pii.key; without one, a published one that hides
    nothing, which is enough for invented tables alone."""
    key = spark.conf.get("spark.quarry.pii.key", None) or "published key for invented data"
    return pseudonyms(common.table(spark, sf_dir, "documents").select("doc_id", "text"), key)
