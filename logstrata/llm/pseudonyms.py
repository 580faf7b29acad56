"""Personal data replaced by format-preserving pseudonyms.

Validated numbers and dates are permuted, by a key, within all values of their
kind and format: a card number stays one of as many digits that passes the Luhn
test, a date stays a date. The permutation is a Feistel network, so different
values stay different, and equal values, however they are punctuated, get equal
pseudonyms in all documents without any table of them.
"""

from __future__ import annotations

import datetime as dt
import hmac
import math
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROUNDS = 10
#: Pseudonyms that a task remembers.
REMEMBERED = 100_000
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1), dt.date(2099, 12, 31)
_DIGITS, _HEX = "0123456789", "0123456789abcdef"
_LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Hexadecimal digits of a secret that are permuted together; a longer one is so in parts.
HEX_BLOCK = 96

# The forms in which personal data is written. Repetitions are
# bounded or possessive, so that no text makes the search quadratic.
KINDS = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w-])",
    "secret": r"(?i:\b(?:token|secret|api[_-]?key|access[_-]?key|passw(?:or)?d)\b)\W{1,4}(?P<hex>[0-9A-Fa-f]{16,}+)(?![\w])",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "date": r"(?<![\w.-])(?:(?P<y>(?:19|20)\d\d)(?P<s1>[-/.])(?P<m>\d{1,2})(?P=s1)(?P<d>\d{1,2})|(?P<d2>\d{1,2})(?P<s2>[-/.])(?P<m2>\d{1,2})(?P=s2)(?P<y2>(?:19|20)\d\d))(?:(?=[Tt]\d\d:?\d\d)|(?![\w-]|\.\d))",
    "ip": r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w-])(?:1-)?\d{3}-\d{3}-\d{4}(?![\w-])|(?<![\w.-])(?:1\.)?\d{3}\.\d{3}\.\d{4}(?![\w-]|\.\d)",
    "card": r"(?<!\w)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{4,5})(?!\w)",
}
#: Kinds whose groups can run on into words and numbers behind them.
_RUNS_ON = {kind: re.compile(KINDS[kind]) for kind in ("iban", "phone")}
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
        21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ DZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC",
        32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
#: Digits of a telephone number with its country code, where they are always as many.
PHONE_DIGITS = {
    "1": 11, "7": 11, "20": 12, "27": 11, "31": 11, "33": 11, "34": 11, "41": 11, "44": 12, "45": 10, "47": 10,
    "48": 11, "61": 11, "82": 12, "86": 13, "90": 12, "91": 12, "351": 12, "353": 12, "420": 12, "421": 12,
}
_ANY = re.compile("|".join(f"(?P<{kind}>{form})" for kind, form in KINDS.items()))
#: No kind is without one of these.
_TRIGGER = re.compile(r"\d|@|(?i:token|secret|key|passw)")
#: Decimal digits of all scripts but ASCII, and those that stand for them.
_PLAIN = {
    c: str(unicodedata.decimal(chr(c)))
    for c in range(128, sys.maxunicode + 1)
    if chr(c).isdecimal()
}
_OTHER_DIGIT = re.compile(r"[^\D0-9]")


class Permutation:
    """A keyed permutation of 0 .. size - 1 for each tweak."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: bytes, turn: int, value: int, modulus: int) -> int:
        text = b"%b|%d|%d" % (tweak, turn, value)
        return int.from_bytes(hmac.digest(self.key, text, "sha256")[:24], "big") % modulus

    def __call__(
        self, value: int, size: int, tweak: bytes, valid: Callable[[int], bool] = lambda v: True
    ) -> int:
        """Walks the cycle of a network on a rectangle until in the domain again."""
        a = math.isqrt(max(size - 1, 0)) + 1
        b = -(-size // a)
        while True:
            left, right = divmod(value, b)
            for turn in range(ROUNDS):
                if turn % 2:
                    right = (right + self._round(tweak, turn, left, b)) % b
                else:
                    left = (left + self._round(tweak, turn, right, a)) % a
            value = left * b + right
            if value < size and valid(value):
                return value


def luhn(digits: str) -> int:
    """The check digit that belongs behind ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 if i % 2 else 2)
        total += v - 9 if v > 9 else v
    return -total % 10


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _only(text: str, kept: str) -> str:
    return "".join(c for c in text if c in kept)


def _poured(shape: str, values: str, places: str) -> str:
    """``shape`` with its characters of ``places`` replaced by ``values`` in turn."""
    source = iter(values)
    return "".join(next(source) if c in places else c for c in shape)


def _in_script(new: str, text: str) -> str:
    """``new`` with the digits of the script that ``text`` has at each place.

    Where ``text`` has no digit, or values differ in length, its first digit decides.
    """
    zeros = [ord(c) - unicodedata.decimal(c) if c.isdecimal() else None for c in text]
    first = next(z for z in zeros if z is not None)
    if len(new) != len(text):
        zeros = [first] * len(new)
    return "".join(
        chr((first if z is None else z) + int(c)) if c in _DIGITS else c
        for c, z in zip(new, zeros)
    )


def _day(year: str, month: str, day: str) -> dt.date | None:
    try:
        return dt.date(int(year), int(month), int(day))
    except ValueError:
        return None


class Pseudonyms:
    """The pseudonym of a found value, or None where it is not valid."""

    def __init__(self, key: bytes):
        self.permute = Permutation(key)
        self.known: dict[tuple[str, str], str | None] = {}

    def of(self, kind: str, found: re.Match) -> str | None:
        text = found.group()
        got = self.known.get((kind, text), "")
        if got == "":
            got = getattr(self, f"_{kind}")(text, found)
            if len(self.known) < REMEMBERED:
                self.known[kind, text] = got
        return got

    def _number(self, digits: str, tweak: str, valid=lambda v: True) -> str:
        size = 10 ** len(digits)
        tweak = f"{tweak}{len(digits)}".encode()
        return str(self.permute(int(digits), size, tweak, valid)).zfill(len(digits))

    def _card(self, text: str, _: re.Match) -> str | None:
        digits = _only(text, _DIGITS)
        if luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
            return None
        body = digits[0] + self._number(digits[1:-1], f"card{digits[0]}")
        return _poured(text, body + str(luhn(body)), _DIGITS)

    def _iban(self, text: str, _: re.Match) -> str | None:
        plain = text.replace(" ", "")
        if not 15 <= len(plain) <= 34 or _mod97(plain[4:] + plain[:4]) != 1:
            return None
        own = _only(plain[4:], _DIGITS)
        shape = re.sub(r"\d", "9", plain[4:])
        body = _poured(plain[4:], self._number(own, plain[:2] + shape), _DIGITS) if own else plain[4:]
        check = f"{98 - _mod97(body + plain[:2] + '00'):02d}"
        return _poured(text, plain[:2] + check + body, text.replace(" ", ""))

    def _ssn(self, text: str, _: re.Match) -> str | None:
        def valid(v: int) -> bool:
            area, group, serial = v // 10**6, v // 10**4 % 100, v % 10**4
            return area not in (0, 666) and area < 900 and group > 0 and serial > 0

        digits = _only(text, _DIGITS)
        return _poured(text, self._number(digits, "ssn", valid), _DIGITS) if valid(int(digits)) else None

    def _phone(self, text: str, _: re.Match) -> str | None:
        digits = _only(text, _DIGITS)
        if not 8 <= len(digits) <= 15:
            return None
        code = re.match(r"\+(1(?!\d)|1|7|\d{1,3})", text)
        kept = min(len(code.group(1)), len(digits) - 7) if code else 0
        if not code and len(digits) == 11:  # a leading 1 in front of ten digits
            kept = 1
        return _poured(text, digits[:kept] + self._number(digits[kept:], "phone"), _DIGITS)

    def _ip(self, text: str, _: re.Match) -> str | None:
        parts = [int(p) for p in text.split(".")]
        if max(parts) > 255:
            return None
        value = self.permute(int.from_bytes(bytes(parts), "big"), 1 << 32, b"ip")
        return ".".join(map(str, value.to_bytes(4, "big")))

    def _secret(self, text: str, found: re.Match) -> str:
        at = found.start("hex") - found.start()
        value = found.group("hex")
        parts = [value[i : i + HEX_BLOCK] for i in range(0, len(value), HEX_BLOCK)]
        for i, part in enumerate(parts):
            tweak = b"hex%d" % len(value) + (b"/%d" % i if i else b"")
            parts[i] = format(self.permute(int(part, 16), 16 ** len(part), tweak), "x").zfill(len(part))
        new = "".join(parts)
        return text[:at] + (new.upper() if value == value.upper() else new)

    def _date(self, text: str, found: re.Match) -> str | None:
        first = found.group("y") is not None
        y, m, d = (found.group(g if first else g + "2") for g in "ymd")
        day, month_first = _day(y, m, d), False
        if day is None and not first:
            day, month_first = _day(y, d, m), True
        if day is None:
            return None
        size = (LAST_DAY - FIRST_DAY).days + 1
        new = FIRST_DAY + dt.timedelta(self.permute((day - FIRST_DAY).days, size, b"date"))
        s = found.group("s1" if first else "s2")
        width = 2 if len(m) == len(d) == 2 else 1  # 1/2/1980 stays without zeros
        year, month, day_of = f"{new.year:04d}", f"{new.month:0{width}d}", f"{new.day:0{width}d}"
        if first:
            return s.join((year, month, day_of))
        return s.join((month, day_of, year) if month_first else (day_of, month, year))

    def _email(self, text: str, _: re.Match) -> str:
        name, domain = text.split("@")
        value, size = 0, 1
        for c in name.lower():
            radix = 10 if c in _DIGITS else 26 if c in _LOWER else 1
            value, size = value * radix + (_DIGITS if radix == 10 else _LOWER).find(c) * (radix > 1), size * radix
        shape = re.sub("[a-z]", "a", re.sub(r"\d", "9", name.lower()))
        value = self.permute(value, size, f"{shape}@{domain.lower()}".encode())
        out = []
        for c in reversed(name.lower()):
            radix = 10 if c in _DIGITS else 26 if c in _LOWER else 1
            value, at = divmod(value, radix)
            out.append(c if radix == 1 else (_DIGITS if radix == 10 else _LOWER)[at])
        cased = (c.upper() if old.isupper() else c for c, old in zip(reversed(out), name))
        return "".join(cased) + "@" + domain


def _ends(kind: str, found: re.Match) -> Iterator[re.Match]:
    """The match and shorter ones that end with a group, likeliest first.

    First is the length that the country prescribes, then the longest; a phone's
    groups are not joined by a space once they were by another separator.
    """
    if kind not in _RUNS_ON:
        yield found
        return
    text, start = found.group(), found.start()
    ends = [found.end(), *(start + m.start() for m in reversed(list(re.finditer(r"[ .-]+", text))))]
    tries = [m for end in ends if (m := _RUNS_ON[kind].fullmatch(found.string, start, end))]

    def rank(m: re.Match) -> int:
        if kind == "iban":
            return len(m.group().replace(" ", "")) != IBAN_LENGTHS.get(m.group()[:2])
        digits = _only(m.group(), _DIGITS)
        if m.group()[0] == "+":
            # At most one of these begins a number: no country code begins another.
            due = next((n for code, n in PHONE_DIGITS.items() if digits.startswith(code)), None)
            if len(digits) == due:
                return 0
        return 2 if re.search(r"\d[.-]\d+ ", m.group()) else 1

    yield from sorted(tries, key=rank)


def replace(text: str, names: Pseudonyms) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and kind, place and length of each, in the new text."""
    if not _TRIGGER.search(text):
        return text, []
    other = _OTHER_DIGIT.search(text) is not None
    plain = text.translate(_PLAIN) if other else text
    out, spans, done, length, at = [], [], 0, 0, 0
    while found := _ANY.search(plain, at):
        kind = found.lastgroup if found.lastgroup in KINDS else next(k for k in KINDS if found.group(k))
        for found in _ends(kind, first := found):
            if (new := names.of(kind, found)) is not None:
                break
        else:
            found = first
        if new is None:  # not valid: look for another kind behind its first character
            at = found.start() + 1
            while at < found.end() and text[at - 1].isalnum() and text[at].isalnum():
                at += 1
            continue
        if other and _OTHER_DIGIT.search(own := text[found.start() : found.end()]):
            new = _in_script(new, own)
        out += [text[done : found.start()], new]
        length += found.start() - done
        spans.append((kind, length, len(new)))
        length += len(new)
        done = at = found.end()
    if not spans:
        return text, []
    return "".join(out) + text[done:], spans


_SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("length", T.IntegerType()),
        ]
    )
)
_ARROW_SPANS = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32())])
)


def pseudonymise(docs: DataFrame, key: str, spans: str = "pseudonyms") -> DataFrame:
    """``docs`` with pseudonyms in the column text, and their spans in one more column.

    Replaced are e-mail names, hexadecimal secrets that are named as such, IBANs,
    dates, IPv4 addresses, social security numbers, telephone and card numbers,
    where they are valid, in the decimal digits of any script. A date that
    is none with the day first is read with the month first. Anything else stays as it is, as do all other columns;
    one of the name ``spans`` is replaced. Null stays null and empty empty, both
    without spans; equal rows give equal rows. One pass, no shuffle; ``key``
    decides the permutations and must be kept as long as links are needed. An
    e-mail name keeps its capitals in place, and links without them; a secret of
    more than ``HEX_BLOCK`` digits is permuted in parts. Texts of any length are
    searched as a whole; an empty table gives none.
    """
    docs = docs.drop(spans).withColumn("text", F.col("text").cast("string"))
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(spans, _SPANS)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key.encode())
        for batch in batches:
            new, found = [], []
            for text in batch.column(at).to_pylist():
                got = (None, []) if text is None else replace(text, names)
                new.append(got[0])
                found.append([dict(zip(("kind", "start", "length"), s)) for s in got[1]])
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            columns.append(pa.array(found, _ARROW_SPANS))
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, spans])

    return docs.mapInArrow(work, schema)
