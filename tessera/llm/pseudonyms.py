"""Format-preserving pseudonyms for personal data.

Validated values (card numbers, IBANs, social security and phone numbers, IP addresses, dates, e-mail local
parts, hexadecimal credentials) are permuted within their format by a keyed Feistel
network, and check digits are computed anew. The permutation depends on the key and the kind only: equal values
stay equal in all documents, whatever their separators, and whoever has the key can invert it.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.common import byte_buffer, slices

ROUNDS = 10
DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
#: Letters of Latin-1 beyond ASCII.
LATIN_LOWER = "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
LATIN_UPPER = "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7)
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()

# Shapes of the values that are looked for, most specific first. Each is tried where a run of digits begins.
SHAPES = {
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    "card": r"(?<![0-9A-Za-z.-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2,3}(?:[ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z-])",
    "date": r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?![0-9A-SU-Za-z/-]|T(?![0-9]))",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "phone": r"(?<![0-9A-Za-z])(?:"
             r"\+1[ .-]?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])|"
             r"\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,5}\)[ .-]?[0-9]{1,8}|[ .-][0-9]{1,8})(?:[ .-][0-9]{1,8}){0,11}(?![0-9A-Za-z]|[.:/-][0-9])|"
             r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])|"
             r"\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,5}(?![0-9A-Za-z])|\+[0-9]{8,15}(?![0-9A-Za-z]))",
}
NUMBER = [(kind, re.compile(shape)) for kind, shape in SHAPES.items()]
#: Characters of an IBAN by country.
IBAN_LENGTH = {country: int(n) for n, countries in (held.split(":") for held in (
    "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,OM,SO,TL "
    "24:AD,CZ,DZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,SM 28:AL,AZ,BY,CY,DO,GT,HN,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA "
    "30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU").split()) for country in countries.split(",")}
DIGIT_RUN = re.compile("[0-9]+")
HEX_RUN = re.compile("(?<![0-9A-Za-z])[0-9A-Fa-f]{32,128}(?![0-9A-Za-z])")
CREDENTIAL = re.compile(r"(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\"']?[ \t]*[=:][ \t]*[\"']?$", re.IGNORECASE)
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def _number(key: bytes, *parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("|".join(map(str, parts)).encode(), key=key, digest_size=64).digest(), "big")


def permute(text: str, alphabet: str, key: bytes, tweak: str, back: bool = False) -> str:
    """Keyed permutation of the strings over ``alphabet`` of one length (alternating Feistel network)."""
    base, n = len(alphabet), len(text)
    if n == 0:
        return text
    place = {c: i for i, c in enumerate(alphabet)}
    if n == 1:
        shift = _number(key, tweak, base) % base
        return alphabet[(place[text] + (-shift if back else shift)) % base]

    def value(part: str) -> int:
        out = 0
        for c in part:
            out = out * base + place[c]
        return out

    half = n // 2
    left, right = value(text[:half]), value(text[half:])
    widths = (half, n - half)
    for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
        size = base ** widths[turn % 2]
        if back:
            left, right = (right - _number(key, tweak, n, base, turn, left)) % size, left
        else:
            left, right = right, (left + _number(key, tweak, n, base, turn, right)) % size

    def shown(number: int, width: int) -> str:
        out = []
        for _ in range(width):
            number, digit = divmod(number, base)
            out.append(alphabet[digit])
        return "".join(reversed(out))

    return shown(left, half) + shown(right, n - half)


def permute_number(number: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """Keyed permutation of ``0 .. size - 1``: bits are permuted until the result lies in the range."""
    width = max(2, (size - 1).bit_length())
    while True:
        number = int(permute(format(number, f"0{width}b"), "01", key, tweak, back), 2)
        if number < size:
            return number


def _refill(shape: str, values: Iterator[str], alphabet: str) -> str:
    return "".join(next(values) if c in alphabet else c for c in shape)


def _digits(text: str) -> str:
    return "".join(c for c in text if c in DIGITS)


def luhn_digit(payload: str) -> str:
    """Check digit that completes ``payload``."""
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _card(text: str, key: bytes, back: bool) -> str | None:
    digits = _digits(text)
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1]:
        return None
    payload = permute(digits[:-1], DIGITS, key, "card", back)
    return _refill(text, iter(payload + luhn_digit(payload)), DIGITS)


def _iban_check(country: str, account: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in account + country + '00')) % 97:02d}"


def _iban(text: str, key: bytes, back: bool) -> str | None:
    plain = text.replace(" ", "")
    country, check, account = plain[:2], plain[2:4], plain[4:]
    if not 15 <= len(plain) <= 34 or _iban_check(country, account) != check:
        return None
    account = _classes(account, key, f"iban|{country}", back)
    filled = iter(country + _iban_check(country, account) + account)
    return "".join(c if c == " " else next(filled) for c in text)


def _ip(text: str, key: bytes, back: bool) -> str | None:
    parts = [int(p) for p in text.split(".")]
    if any(p > 255 for p in parts):
        return None
    bits = permute("".join(f"{p:08b}" for p in parts), "01", key, "ip", back)
    return ".".join(str(int(bits[i:i + 8], 2)) for i in range(0, 32, 8))


def _ssn(text: str, key: bytes, back: bool) -> str | None:
    area, group, serial = map(int, text.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    area -= 1 + (area > 666)
    number = permute_number((area * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, key, "ssn", back)
    rest, serial = divmod(number, 9999)
    area, group = divmod(rest, 99)
    area += 1
    return f"{area + (area >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"


def _phone(text: str, key: bytes, back: bool) -> str | None:
    country = re.match(r"\+[0-9]{1,3}(?=[^0-9])|\+", text)
    head = country.group() if country else ""
    digits = _digits(text[len(head):])
    if not 8 <= len(_digits(text)) <= 15:
        return None
    return head + _refill(text[len(head):], iter(permute(digits, DIGITS, key, f"phone|{len(digits)}", back)), DIGITS)


def _date(text: str, key: bytes, back: bool) -> str | None:
    marks = re.sub("[0-9]", "", text)
    parts = text.split(marks[0])
    orders = [(0, 1, 2)] if len(parts[0]) == 4 else [(2, 1, 0)] if marks[0] == "." else [(2, 0, 1), (2, 1, 0)]
    for y, m, d in orders:
        try:
            day = dt.date(int(parts[y]), int(parts[m]), int(parts[d])).toordinal()
        except ValueError:
            continue
        if FIRST_DAY <= day <= LAST_DAY:
            new = dt.date.fromordinal(FIRST_DAY + permute_number(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date", back))
            shown = ["", "", ""]
            bare = any(len(parts[i]) == 1 for i in (m, d))
            shown[y], shown[m], shown[d] = str(new.year), *(str(v) if bare else f"{v:02d}" for v in (new.month, new.day))
            return marks[0].join(shown)
    return None


def _classes(text: str, key: bytes, tweak: str, back: bool) -> str:
    """Digits among digits, letters among letters of their case; other characters stay."""
    for alphabet in (DIGITS, LOWER, UPPER, LATIN_LOWER, LATIN_UPPER):
        held = "".join(c for c in text if c in alphabet)
        text = _refill(text, iter(permute(held, alphabet, key, f"{tweak}|{len(alphabet)}", back)), alphabet)
    return text


def _email(text: str, key: bytes, back: bool) -> str | None:
    local, at, host = text.rpartition("@")
    return _classes(local, key, "email", back) + at + host


def _secret(text: str, key: bytes, back: bool) -> str | None:
    new = permute(text.lower(), HEX, key, "secret", back)
    return new.upper() if text.upper() == text else new


KINDS: dict[str, Callable[[str, bytes, bool], str | None]] = {
    "email": _email, "secret": _secret, "iban": _iban, "ip": _ip, "card": _card, "date": _date, "ssn": _ssn, "phone": _phone}


def pseudonym(kind: str, text: str, key: bytes, back: bool = False) -> str | None:
    """What ``text`` becomes, or none if it is no valid value of its kind; ``back`` inverts."""
    return KINDS[kind](text, key, back)


def _named(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans that an ``@`` or a credential's name tells."""
    at = text.find("@")
    while at >= 0:
        host = HOST.match(text, at + 1)
        start = at
        while start and (text[start - 1].isalnum() or text[start - 1] in "._%+-"):
            start -= 1
        if host and start < at:
            yield "email", start, host.end()
        at = text.find("@", at + 1)
    for run in HEX_RUN.finditer(text):
        if CREDENTIAL.search(text, max(0, run.start() - 32), run.start()):
            yield "secret", *run.span()


def _ends(kind: str, text: str, start: int, end: int) -> list[int]:
    """Where a value of the shape found at ``start`` to ``end`` may end, best first: shapes also take words or numbers that follow."""
    if kind == "iban":
        stops = [i for i in range(end, start, -1) if i == end or text[i] == " "]
        length = IBAN_LENGTH.get(text[start:start + 2])
        fit = [i for i in stops if i - start - text.count(" ", start, i) == length]
        return [*fit, end] if length else stops
    if kind == "phone" and text[start] == "+":
        stops = [i for i in range(end, start, -1) if i == end or text[i] in " .-" and text[i - 1] in DIGITS]
        for run in DIGIT_RUN.finditer(text, start + 1, end):
            if any((match := shape.match(text, run.start())) and KINDS[other](match.group(), b"", False) for other, shape in NUMBER if other in ("ip", "card", "date", "ssn")):
                return [i for i in stops if i < run.start()] + [i for i in stops if i >= run.start()]
        return stops
    return [end]


def replace(text: str, key: bytes, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """Text with pseudonyms, and kind and span (characters of the input) of each value."""
    spans: list[tuple[str, int, int, str]] = []
    for kind, start, end in sorted(_named(text), key=lambda s: s[1]):
        if not spans or start >= spans[-1][2]:
            spans.append((kind, start, end, pseudonym(kind, text[start:end], key, back)))
    taken = iter([*spans, ("", len(text) + 1, 0, "")])
    held, done = next(taken), 0
    for run in DIGIT_RUN.finditer(text):
        start = run.start()
        while start >= held[2] and held[2]:
            held = next(taken)
        if start < done or start >= held[1]:
            continue
        begin = start - (text[max(0, start - 1):start] == "(")
        begin -= text[max(0, begin - 1):begin] == "+"
        for kind, shape in NUMBER:
            match = shape.match(text, max(0, start - 2) if kind == "iban" else begin)
            ends = _ends(kind, text, *match.span()) if match else []
            found = ((end, pseudonym(kind, text[match.start():end], key, back)) for end in ends if end <= held[1])
            done_here = next((f for f in found if f[1] is not None), None)
            if done_here:
                spans.append((kind, match.start(), *done_here))
                done = done_here[0]
                break
    spans.sort(key=lambda s: s[1])
    out, done = [], 0
    for _, start, end, new in spans:
        out += [text[done:start], new]
        done = end
    return "".join(out) + text[done:], [s[:3] for s in spans]


def pseudonymise(docs: DataFrame, key: bytes, text_column: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in the text and a column ``private``: kind, start and end of each value in the input.

    An IBAN ends where the length of its country says; where the country is unknown, at the last group end that passes
    mod 97. Phone numbers have a country code (groups of 1 to 8 digits, 8 to 15 in all; numbers that follow and could belong
    are taken too, other valid values are not) or the form 3-3-4; other national forms stay in clear, and so do times of day after a date.
    Texts without such values come back unchanged, null stays null. Numbers that fail their check (Luhn, mod
    97, ranges, calendar) stay. Rows are taken one by one and keep all columns; an input column
    ``private`` is replaced. An empty table gives no rows. Nothing is shuffled.
    """
    kept = [c for c in docs.columns if c != "private"]
    rows = docs.select(*kept)
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_column):
                data, offsets = byte_buffer(part[text_column])
                telling = np.concatenate([[0], np.cumsum((data == 0x40) | ((data >= 0x30) & (data <= 0x39)))])
                suspect = telling[offsets[1:]] > telling[offsets[:-1]]
                texts, found = part[text_column].to_pylist(), [[] for _ in range(part.num_rows)]
                for i in np.flatnonzero(suspect):
                    texts[i], at = replace(texts[i], key)
                    found[i] = [dict(zip(("kind", "start", "end"), s)) for s in at]
                columns = [pa.array(texts, pa.string()) if c == text_column else part[c] for c in kept]
                yield from pa.table([*columns, pa.array(found, spans)], names=[*kept, "private"]).to_batches()

    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL("private array<struct<kind: string, start: int, end: int>>").fields])
    return rows.mapInArrow(run, schema)

