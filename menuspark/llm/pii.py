"""Format-preserving pseudonyms for personal numbers, dates and addresses.

Values are found by pattern and then validated: payment cards by the Luhn sum, IBANs by the remainder mod 97, dates by the
calendar, IPv4 addresses by their octets, telephone and social security numbers by their shape and ranges, e-mail addresses by
shape. A pattern may take the next word or number along: so an IBAN is first tried at its country's length, a telephone number
that is too long is tried at its shorter ends, and after a candidate that doesn't pass the search goes on one token after its start.
What doesn't pass is left alone. A number of up to 15 digits after a + is one telephone
number, with whatever figure follows it. Where a pseudonym would make an overlapping refused candidate valid, the next one of the
permutation is taken, to keep the way back; only there equal values may get different pseudonyms.

A keyed Feistel network permutes each value's digits and letters within its format: length, separators, letter case, script,
country code, mail domain, widths of day and month all stay, and check digits are made anew, so a pseudonym is valid where its value
was. Digits of any script count by their values and letters of any script move within their script, case and code page. Dates move
among those whose day and month have as many digits (and whose day is as much over 12), so a date has one pseudonym in every
notation. No value is its own pseudonym: E and D being the network and its inverse, x goes to D(E(x) + 1), a permutation without
fixed points. The key, the kind and the format alone choose the permutation; so equal values get equal pseudonyms in all documents,
different values of one format different ones, and who has the key, of any length, can turn them back (``reveal``). It is a map over
documents without any state or shuffle.
"""

from __future__ import annotations

import datetime as dt
import functools
import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import slices

ROUNDS = 10
_FIRST, _LAST = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()
PATTERN = re.compile(
    r"(?P<email>(?:(?<![\w.%+\-\u0300-\u036f])[\w.%+\-\u0300-\u036f]{1,64}|(?<![A-Za-z0-9_.%+\-])[A-Za-z0-9_.%+\-]{1,64})@(?:[\w\-]{1,63}\.){1,8}(?:[A-Za-z]{2,24}(?![A-Za-z0-9_\-])|[^\W\d_\x00-\x7f]{2,24}))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<date>(?<![\d.\-/])(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}-\d{1,2}-\d{4})(?![\d\-/]|\.\d))"
    r"|(?P<ip>(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d))"
    r"|(?P<ssn>(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-]))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}(?:[ .\-]?\(\d{1,4}\)|[ .\-]?\d{1,4}){2,5}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d\-])\d{3}-\d{3}-\d{4}(?![\d\-]))"
    r"|(?P<card>(?<!\d)(?:\d{4}([ \-])\d{4}\8\d{4}\8\d{1,7}|\d{4}([ \-])\d{6}\9\d{5}|\d{13,19})(?!\d))"
)
#: Lengths of IBANs by country, from the registry.
IBAN_LENGTHS = {
    c: n
    for n, own in {
        15: "NO", 16: "BE", 18: "DK FI FO GL FK NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in own.split()
}
_TOKEN = re.compile(r"[^\W_]+|.", re.DOTALL)
_WORTH = re.compile(r"[\d@]")


def feistel(key: bytes, tweak: str, value: int, size: int, back: bool = False) -> int:
    """A keyed permutation of 0..size-1: a balanced network on the next even number of bits, walked until it is in range."""
    if size < 2:
        return value
    half = max(1, -(-(size - 1).bit_length() // 2))
    mask, width = (1 << half) - 1, -(-half // 8)
    if width > 64:
        raise ValueError("the value is too long")
    person = hashlib.blake2b(f"{tweak}:{size}".encode(), digest_size=16).digest()

    def f(r: int, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(bytes([r]) + x.to_bytes(width, "big"), key=key, person=person, digest_size=64).digest()[:width], "big") & mask

    while True:
        left, right = value >> half, value & mask
        if back:
            for r in range(ROUNDS - 1, -1, -1):
                left, right = right ^ f(r, left), left
        else:
            for r in range(ROUNDS):
                left, right = right, left ^ f(r, right)
        value = left << half | right
        if value < size:
            return value


def moved(key: bytes, tweak: str, value: int, size: int, back: bool = False) -> int:
    """The permutation of 0..size-1 that is used: one place further in the network's order, so that nothing stays itself."""
    if size < 2:
        return value
    return feistel(key, tweak, (feistel(key, tweak, value, size) + (-1 if back else 1)) % size, size, True)


_ASCII = {c: a for a in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ") for c in a}


@functools.lru_cache(65_536)
def alphabet(c: str) -> str:
    """What a character may become, itself included: the ten digits of its script, or the letters of its script and case on its page
    of 256 code points; "" for what keeps its place."""
    if c.isascii():
        return _ASCII.get(c, "")
    if c.isdecimal():
        zero = ord(c) - unicodedata.decimal(c)
        return "".join(map(chr, range(zero, zero + 10)))
    if not c.isalpha():
        return ""
    script = lambda x: (unicodedata.category(x), unicodedata.name(x, "").split(" ")[0])
    page = ord(c) & ~0xFF
    own = "".join(x for x in map(chr, range(max(page, 128), page + 256)) if x.isalpha() and script(x) == script(c))
    return own if len(own) > 1 else ""


def characters(key: bytes, kind: str, text: str, back: bool = False) -> str:
    """Digits among digits, letters among letters of their script and case; all other characters keep their places. The tweak is
    the shape without separators, so one number written in several ways keeps one pseudonym."""
    own = [(c, a) for c in text if (a := alphabet(c))]
    value, size = 0, 1
    for c, a in own:
        value, size = value * len(a) + a.index(c), size * len(a)
    value = moved(key, kind + "".join(a[0] for _, a in own), value, size, back)
    out = []
    for _, a in reversed(own):
        value, i = divmod(value, len(a))
        out.append(a[i])
    return "".join(out.pop() if alphabet(c) else c for c in text)


def _plain(text: str) -> str:
    """With ASCII digits for those of other scripts."""
    return "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in text)


def _dressed(new: str, like: str) -> str:
    """``new`` with its digits in the script that ``like`` has at their places; where the lengths differ, in that of its first digit."""
    places = like if len(like) == len(new) else next(c for c in like if c.isdecimal()) * len(new)
    return "".join(chr(ord(c) - unicodedata.decimal(c) + int(n)) if n.isdecimal() and c.isdecimal() else n for n, c in zip(new, places))


def luhn_digit(digits: str) -> str:
    total = sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


def _card(key: bytes, text: str, back: bool) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    inner = digits
    while True:  # walk past numbers of one repeated digit, which are never taken as cards
        inner = characters(key, "card", inner[:-1], back)
        inner += luhn_digit(inner)
        if len(set(inner)) > 1:
            break
    own = iter(inner)
    return "".join(next(own) if c.isdigit() else c for c in text)


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _iban(key: bytes, text: str, back: bool) -> str | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or not 2 <= int(plain[2:4]) <= 98 or _mod97(plain[4:] + plain[:4]) != 1:
        return None
    inner = characters(key, "iban" + plain[:2], plain[4:], back)
    own = iter(plain[:2] + f"{98 - _mod97(inner + plain[:2] + '00'):02d}" + inner)
    return "".join(c if c == " " else next(own) for c in text)


@functools.cache
def _days() -> tuple[dict[tuple, list[int]], dict[int, tuple[tuple, int]]]:
    """All days by the digits of day and month and whether the day is over 12, and each day's group and place in it."""
    groups: dict[tuple, list[int]] = {}
    places = {}
    for n in range(_FIRST, _LAST + 1):
        d = dt.date.fromordinal(n)
        group = (d.day > 9) + (d.day > 12), d.month > 9
        own = groups.setdefault(group, [])
        places[n] = group, len(own)
        own.append(n)
    return groups, places


def _date(key: bytes, text: str, back: bool) -> str | None:
    """A number over 12 tells day from month; otherwise the day comes first. So the pseudonym's is read as its value's was."""
    parts, mark = re.split(r"[./\-]", text), re.search(r"[./\-]", text)[0]
    first, second = int(parts[0]), int(parts[1])
    order = "ymd" if len(parts[0]) == 4 else "mdy" if first <= 12 < second else "dmy"
    own = dict(zip(order, map(int, parts)))
    groups, places = _days()
    try:
        group, place = places[dt.date(own["y"], own["m"], own["d"]).toordinal()]
    except (ValueError, KeyError):
        return None
    d = dt.date.fromordinal(groups[group][moved(key, f"date{group}", place, len(groups[group]), back)])
    return mark.join(str({"y": d.year, "m": d.month, "d": d.day}[c]).zfill(len(p)) for c, p in zip(order, parts))


def _ip(key: bytes, text: str, back: bool) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    n = moved(key, "ip", int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, back)
    return ".".join(map(str, n.to_bytes(4, "big")))


def _valid_ssn(digits: str) -> bool:
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def _ssn(key: bytes, text: str, back: bool) -> str | None:
    digits = text.replace("-", "")
    if not _valid_ssn(digits):
        return None
    while True:
        digits = characters(key, "ssn", digits, back)
        if _valid_ssn(digits):
            return f"{digits[:3]}-{digits[3:5]}-{digits[5:]}"


def _phone(key: bytes, text: str, back: bool) -> str | None:
    head = re.match(r"\+\d{1,3}(?=\D)|\+\d", text)
    code = head[0] if head else ""
    digits = re.sub(r"\D", "", text)
    if not 8 <= len(digits) <= 15:
        return None
    return code + characters(key, "phone" + code, text[len(code) :], back)


def _email(key: bytes, text: str, back: bool) -> str | None:
    local, at, domain = text.rpartition("@")
    if ".." in text or local[0] in ".-" or local[-1] == "." or not any(map(alphabet, local)):
        return None
    return characters(key, "email", local, back) + at + domain


KINDS: dict[str, Callable[[bytes, str, bool], str | None]] = {"email": _email, "iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonym(kind: str, key: bytes, text: str, back: bool = False) -> str | None:
    """A candidate's pseudonym, or None if it isn't valid. It is looked at with ASCII digits; an IP address of several scripts' digits
    isn't valid, as its pseudonym couldn't be turned back."""
    if text.isascii():
        return KINDS[kind](key, text, back)
    if kind == "ip" and len({alphabet(c) for c in text if c.isdecimal()}) > 1:
        return None
    new = KINDS[kind](key, _plain(text), back)
    return None if new is None else _dressed(new, text)


def _ends(m: re.Match) -> list[int]:
    """Where the match may end, in order of trial. A shorter end is one at a separator."""
    text, start, end = m.string, m.start(), m.end()
    if m.lastgroup == "iban":
        count, at = IBAN_LENGTHS.get(text[start : start + 2], 0), start
        while count and at < end:
            count, at = count - (text[at] != " "), at + 1
        return [at, end] if not count and at < end and text[at] == " " else [end]
    if m.lastgroup == "phone" and text[start] == "+":
        return [end, *(i for i in range(end - 1, start + 1, -1) if text[i] in " .-(" and (text[i - 1].isdigit() or text[i - 1] == ")"))]
    return [end]


def replace(text: str, key: bytes, back: bool = False) -> tuple[str, list[tuple[int, int, str, str]]]:
    """The text with pseudonyms, and (start, end, kind, pseudonym) of each value; places are in the given text and, as lengths
    may differ only for IP addresses, in order.

    A candidate that was refused may overlap a value that is found after it. If the pseudonym made it valid, the way back would
    read it instead; so the permutation is walked on until it is refused as before."""
    if not _WORTH.search(text):
        return text, []
    key = key if len(key) <= 64 else hashlib.blake2b(key).digest()
    out, found, at, place = [], [], 0, 0
    refused: list[tuple[int, int, str, str]] = []  # (start, end, kind, its characters, with the pseudonyms so far)
    while m := PATTERN.search(text, place):
        kind, start, place = m.lastgroup, m.start(), _TOKEN.match(text, m.start()).end()
        refused = [r for r in refused if r[1] > start]
        for end in _ends(m):
            new = pseudonym(kind, key, text[start:end], back)
            if new is None:
                refused.append((start, end, kind, text[start:end]))
                continue

            def put(r: tuple[int, int, str, str], value: str) -> str:
                return r[3][: start - r[0]] + value[: max(0, r[1] - start)] + r[3][end - r[0] :]

            over = [r for r in refused if r[0] <= start]
            while any(pseudonym(r[2], key, put(r, new), back) is not None for r in over):
                new = pseudonym(kind, key, new, back)
            refused = [(*r[:3], put(r, new)) for r in refused if r[1] > end]
            out += [text[at:start], new]
            found.append((start, end, kind, new))
            at = place = end
            break
    return ("".join([*out, text[at:]]), found) if found else (text, [])


VALUES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("pseudonym", T.StringType())]))


def _map(key: bytes, back: bool, names: list[str]):
    values = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("pseudonym", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            texts, found = [], []
            for text in batch.column(0).to_pylist():
                new, own = (None, []) if text is None else replace(text, key, back)
                texts.append(new)
                found.append([dict(zip(("start", "end", "kind", "pseudonym"), v)) for v in own])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), pa.array(found, values)], names)

    return run


def pseudonymise(docs: DataFrame, key: bytes, *, text_col: str = "text", to: str = "pii", back: bool = False) -> DataFrame:
    """``docs`` with ``to`` = struct(text, values): the whole text with pseudonyms, and what was replaced. A null text stays null
    and an empty one empty, without values. All other columns stay, whatever their names."""
    rest = [c for c in docs.columns if c != to]
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.struct(*[docs[c] for c in rest]).alias("row"))
    types = T.StructType([rows.schema["row"], T.StructField("text", T.StringType()), T.StructField("values", VALUES)])
    out = rows.mapInArrow(_map(key, back, types.names), types)
    return out.select("row.*", F.struct("text", "values").alias(to))


def reveal(docs: DataFrame, key: bytes, *, text_col: str = "text", to: str = "pii") -> DataFrame:
    """The way back, with the same key."""
    return pseudonymise(docs, key, text_col=text_col, to=to, back=True)
