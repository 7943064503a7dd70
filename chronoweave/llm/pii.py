"""Format-preserving pseudonyms for personal data: validated values are keyed-permuted within their format.

Found in whole texts: payment cards (13 to 19 digits, Luhn), IBANs (mod 97), US social security numbers,
international phone numbers, IPv4 addresses, calendar dates and e-mail addresses. A Feistel network with
cycle walking permutes each value's domain (the numbers of that form, the days of 1900-2099), so a pseudonym
is valid, keeps separators and length, and equal values get equal pseudonyms in every document: they stay
linked, and nobody without the key can go back. Numbers that fail validation are left as they are; what stands
inside such a number is looked at again, with shorter ends and later starts. An IBAN ends by its country's length, a
phone number by its country's digits or, where they vary, before a blank that follows a tighter separator.

The key is an argument, never a constant here: who has it can invert every pseudonym.

Where findings overlap, the earlier start wins, then the longer, then the order above. Defined results: null text
stays null; an empty text and one without findings are unchanged; equal values in repeated rows get equal
pseudonyms; very long texts are searched whole; an empty table gives an empty one; other columns stay, but for one
of the name of the spans. No shuffle.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import without

ROUNDS = 8
KINDS = ("card", "iban", "ssn", "phone", "ip", "date", "email")


def permute(x: int, n: int, key: bytes, tweak: str) -> int:
    """The keyed permutation of [0, n) at x: balanced Feistel rounds, walked until the value falls under n."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, size = (1 << half) - 1, (half + 7) // 8
    person = blake2b(f"{tweak}:{n}".encode(), digest_size=16).digest()
    while True:
        left, right = x >> half, x & mask
        for i in range(ROUNDS):
            digest = blake2b(bytes([i]) + right.to_bytes(size), key=key[:64], person=person, digest_size=min(64, size + 8)).digest()
            left, right = right, left ^ (int.from_bytes(digest) & mask)
        x = left << half | right
        if x < n:
            return x


def luhn_sum(digits: str) -> int:
    odd, even = digits[-1::-2], digits[-2::-2]
    return sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)


def _refill(form: str, digits: str) -> str:
    """form with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in form)


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def _card(s: str, key: bytes) -> str | None:
    d = _digits(s)
    if not 13 <= len(d) <= 19 or d[0] == "0" or luhn_sum(d) % 10:
        return None
    low = 10 ** (len(d) - 2)
    body = str(low + permute(int(d[:-1]) - low, 9 * low, key, "card"))
    return _refill(s, body + str(-luhn_sum(body + "0") % 10))


def _iban_check(country: str, rest: str) -> int:
    return int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97


def _iban(s: str, key: bytes) -> str | None:
    plain = s.replace(" ", "")
    country, check, rest = plain[:2], plain[2:4], plain[4:]
    if not 15 <= len(plain) <= 34 or 98 - _iban_check(country, rest) != int(check):
        return None
    rest = _letters(rest, key, f"iban{country}")
    it = iter(f"{country}{98 - _iban_check(country, rest):02d}{rest}")
    return "".join(c if c == " " else next(it) for c in s)


def _ssn(s: str, key: bytes) -> str | None:
    area, group, serial = map(int, s.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    x, serial = divmod(permute(x, 898 * 99 * 9999, key, "ssn"), 9999)
    area, group = divmod(x, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _phone(s: str, key: bytes) -> str | None:
    head = re.match(r"\+[0-9]{1,3}(?=[^0-9])|\+[0-9]", s)[0]
    rest, d = s[len(head) :], _digits(s[len(head) :])
    if not 6 <= len(d) <= 14:
        return None
    return head + _refill(rest, str(permute(int(d), 10 ** len(d), key, f"phone{head}")).zfill(len(d)))


def _ip(s: str, key: bytes) -> str | None:
    parts = s.split(".")
    if any(int(p) > 255 or str(int(p)) != p for p in parts):
        return None
    x = permute(int.from_bytes(bytes(map(int, parts))), 1 << 32, key, "ip")
    return ".".join(map(str, x.to_bytes(4)))


_FIRST, _DAYS = datetime.date(1900, 1, 1), (datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days


def _date(s: str, key: bytes) -> str | None:
    a, sep, b, _, c = re.split(r"([-./])", s)
    orders = ("ymd",) if len(a) == 4 else ("dmy", "mdy") if sep == "/" else ("dmy",)
    for order in orders:
        part = dict(zip(order, map(int, (a, b, c)), strict=True))
        try:
            day = datetime.date(part["y"], part["m"], part["d"])
        except ValueError:
            continue
        x = (day - _FIRST).days
        if not 0 <= x < _DAYS:
            continue
        new = _FIRST + datetime.timedelta(permute(x, _DAYS, key, "date"))
        out = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
        return sep.join(out[k] for k in order)
    return None


_LOWER, _UPPER, _NUMBERS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def _letters(s: str, key: bytes, tweak: str) -> str:
    """s with its letters and digits permuted, each within its own class."""
    classes = [next((k for k in (_LOWER, _UPPER, _NUMBERS) if c in k), "") for c in s]
    x, n = 0, 1
    for c, k in zip(s, classes, strict=True):
        if k:
            x, n = x * len(k) + k.index(c), n * len(k)
    if n == 1:
        return s
    x, out = permute(x, n, key, tweak), []
    for c, k in zip(reversed(s), reversed(classes), strict=True):
        if k:
            x, i = divmod(x, len(k))
            c = k[i]
        out.append(c)
    return "".join(reversed(out))


def _email(s: str, key: bytes) -> str | None:
    name, _, domain = s.partition("@")
    host, dot, top = domain.rpartition(".")
    return f"{_letters(name, key, 'name')}@{_letters(host, key, 'host')}{dot}{top}"


FINDERS: dict[str, tuple[re.Pattern, Callable[[str, bytes], str | None]]] = {
    "card": (re.compile(r"(?<!\w)(?<!\+)(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?!\w)"), _card),
    "iban": (re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"), _iban),
    "ssn": (re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"), _ssn),
    "phone": (re.compile(r"(?<!\w)\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])"), _phone),
    "ip": (re.compile(r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"), _ip),
    "date": (re.compile(r"(?<![\w./-])(?:[0-9]{4}([-./])[0-9]{2}\1[0-9]{2}|[0-9]{2}([./-])[0-9]{2}\2[0-9]{4})(?![0-9]|[./-][0-9])"), _date),
    "email": (re.compile(r"(?<![\w.+-])[A-Za-z0-9_.+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w@])"), _email),
}


@lru_cache(maxsize=100_000)
def pseudonym(kind: str, value: str, key: bytes) -> str | None:
    """The value's pseudonym, or None if it fails validation."""
    return FINDERS[kind][1](value, key)


_DIGIT = re.compile("[0-9]")
_EDGE = re.compile(r"(?<=\w)(?!\w)")

#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    country: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
#: Digits after the country code, where all numbers of the country have as many.
PHONE_DIGITS = {"1": 10, "7": 10, "30": 10, "31": 9, "33": 9, "34": 9, "41": 9, "45": 8, "47": 8, "48": 9, "91": 10, "351": 9}


def _ends(kind: str, text: str, m: re.Match) -> list[int]:
    """Where the finding at the match's start may end, the likeliest first."""
    pattern, start, end = FINDERS[kind][0], m.start(), m.end()
    if kind not in ("iban", "phone"):
        return [end]
    edges = [x.start() for x in _EDGE.finditer(text, start + 1, end) if x.start() < end]
    ends = [end, *(e for e in reversed(edges) if pattern.fullmatch(text, start, e))]
    if kind == "iban":
        n = IBAN_LENGTHS.get(text[start : start + 2])
        return sorted(ends, key=lambda e: len(text[start:e].replace(" ", "")) != n)
    code = re.match(r"\+([0-9]{1,3})(?=[^0-9])|\+([0-9])", m[0])
    n = PHONE_DIGITS.get(code[1] or code[2])
    body = start + code.end()
    exact = [e for e in ends if len(_digits(text[body:e])) == n]
    if exact:
        return exact
    tight = re.search(r"[.-][0-9]+(?= )|[0-9](?= [0-9]+[.-])", text[body:end])
    return sorted(ends, key=lambda e: bool(tight) and e > body + tight.end())


def findings(text: str, key: bytes) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) in order, without overlaps."""
    found = []
    for order, (kind, (pattern, _)) in enumerate(FINDERS.items()):
        if kind == "email":
            if "@" not in text:
                continue
        elif kind == "phone":
            if "+" not in text:
                continue
        elif not _DIGIT.search(text):
            continue
        m = pattern.search(text)
        while m:
            at = m.start() + 1
            for end in _ends(kind, text, m):
                new = pseudonym(kind, text[m.start() : end], key)
                if new is not None:
                    found.append((m.start(), -end, order, kind, new))
                    at = end
                    break
            m = pattern.search(text, at)
    out, at = [], 0
    for start, end, _, kind, new in sorted(found):
        if start >= at:
            out.append((start, -end, kind, new))
            at = -end
    return out


def pseudonymised(text: str, found: list[tuple[int, int, str, str]]) -> str:
    out, at = [], 0
    for start, end, _, new in found:
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]])


def _replaced(batches: Iterator[pa.RecordBatch], key: bytes):
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])
    for batch in batches:
        texts, spans = [], []
        for t in batch.column(1):
            t = t.as_py()
            found = findings(t, key) if t else []
            texts.append(pseudonymised(t, found) if found else t)
            spans.append([{"start": s, "end": e, "kind": k} for s, e, k, _ in found])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(spans, pa.list_(span))], ["row", "text", "spans"])


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", out: str = "pii") -> DataFrame:
    """docs with pseudonyms in text_col, and one more column: the spans replaced (places in the old text); a column of its name goes."""
    docs = without(docs, out)
    names = [f"c{i}" for i, c in enumerate(docs.columns) if c != text_col]
    at = docs.columns.index(text_col)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    packed = plain.selectExpr(f"struct({', '.join(names) or '0 AS none'}) AS row", f"cast(c{at} AS string) AS text")
    got = packed.mapInArrow(partial(_replaced, key=key), f"row {packed.schema['row'].dataType.simpleString()}, text string, spans array<struct<start:int,end:int,kind:string>>")
    picks = [f"text AS `{c}`" if i == at else f"row.c{i} AS `{c}`" for i, c in enumerate(docs.columns)]
    return got.selectExpr(*picks, f"spans AS `{out}`")
