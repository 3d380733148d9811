"""Format-preserving pseudonyms for personal numbers, dates and addresses.

A validated value becomes an integer in the range that its format allows, a keyed Feistel
network permutes that range, and the result is written in the same format. Equal values get
equal pseudonyms in every document; who has the key can invert them.

Found are: card numbers (Luhn), IBANs (mod 97), calendar dates, IPv4 addresses, telephone numbers
of North America and with another country's code, social security numbers, and the local part of
e-mail addresses. Check digits are computed anew, separators stay, and so does every value's
length. A date with slashes is read month first, or day first if it is none that way.

What follows a value may look like a part of it (a card and its expiry date), so shorter readings
from the same place are tried down to a valid one, and then readings from the next place on.

Defined results: a null text stays null; an empty text stays empty; invalid values stay as they
are; a very long text, or a very long e-mail name, is replaced whole; where values overlap the
leftmost counts; repeated rows give repeated results; an empty table gives no rows; columns named n_found or
spans in the table are replaced by the new ones.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ROUNDS = 8
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

_EDGE, _END = r"(?<![A-Za-z0-9@_])", r"(?![A-Za-z0-9@_])"
#: What a value of each kind looks like, and what may not follow it.
_FORMS = {
    "email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", r"(?![A-Za-z0-9-])"),
    "iban": (rf"{_EDGE}[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?", _END),
    "date": (rf"{_EDGE}(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{2}}[./]\d{{2}}[./]\d{{4}})", _END),
    "ip": (r"(?<![0-9A-Za-z.])\d{1,3}(?:\.\d{1,3}){3}", r"(?![0-9A-Za-z]|\.[0-9])"),
    "phone": (r"(?:(?:(?<![0-9A-Za-z])\+?1[ .-]?)?(?<![0-9A-Za-z])\(?[1-9]\d{2}\)?[ .-]\d{3}[ .-]\d{4}|(?<![0-9A-Za-z+])\+[2-9]\d{0,2}(?:[ .-]\d{1,8}){1,6})", _END),
    "ssn": (rf"{_EDGE}\d{{3}}-\d{{2}}-\d{{4}}", _END),
    "card": (rf"{_EDGE}\d(?:[ -]?\d){{12,18}}", _END),
}
PATTERN = re.compile("|".join(f"(?P<{kind}>{form}{end})" for kind, (form, end) in _FORMS.items()))
KINDS = tuple(PATTERN.groupindex)
_ALONE = {kind: (re.compile(form + end), re.compile(form), re.compile(end)) for kind, (form, end) in _FORMS.items()}


class Feistel:
    """A keyed permutation of 0..n-1: balanced Feistel rounds, walked until the result is in range."""

    def __init__(self, key: bytes, tweak: str, n: int, rounds: int = ROUNDS):
        self.n, self.rounds = n, rounds
        self.half = max(1, (max(2, n - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.key = hashlib.blake2b(f"{tweak}:{n}".encode(), key=hashlib.sha256(key).digest(), digest_size=32).digest()

    def _round(self, k: int, value: int) -> int:
        size = (self.half + 7) // 8
        block = bytes([k]) + value.to_bytes(size, "big")
        digest = hashlib.blake2b(block, key=self.key, digest_size=min(64, max(8, size))).digest()
        for more in range(1, -(-size // 64)):
            digest += hashlib.blake2b(block + more.to_bytes(4, "big"), key=self.key, digest_size=64).digest()
        return int.from_bytes(digest, "big") & self.mask

    def _once(self, value: int, inverse: bool) -> int:
        left, right = value >> self.half, value & self.mask
        for k in range(self.rounds)[:: -1 if inverse else 1]:
            if inverse:
                left, right = right ^ self._round(k, left), left
            else:
                left, right = right, left ^ self._round(k, right)
        return (left << self.half) | right

    def apply(self, value: int, inverse: bool = False) -> int:
        value = self._once(value, inverse)
        while value >= self.n:
            value = self._once(value, inverse)
        return value


def _places(key: bytes, kind: str, digits: list[int], radices: list[int], inverse: bool) -> list[int]:
    """Permute mixed-radix digits as one number."""
    value = n = 0
    for digit, radix in zip(digits, radices, strict=True):
        value = value * radix + digit
    n = int(np.prod(np.array(radices, object))) if radices else 1
    value = _network(key, f"{kind}:{radices}", n).apply(value, inverse) if n > 1 else value
    out = []
    for radix in reversed(radices):
        value, digit = divmod(value, radix)
        out.append(digit)
    return out[::-1]


@lru_cache(4096)
def _network(key: bytes, tweak: str, n: int) -> Feistel:
    return Feistel(key, tweak, n)


def luhn_digit(payload: list[int]) -> int:
    """Check digit of a card number without it."""
    total = sum(d if k % 2 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(reversed(payload)))
    return -total % 10


def _into(text: str, digits: Iterable[str]) -> str:
    """Write characters over the letters and digits of a text, separators stay."""
    source = iter(digits)
    return "".join(next(source) if c.isalnum() else c for c in text)


def _card(key: bytes, text: str, inverse: bool) -> str | None:
    digits = [int(c) for c in text if c.isdigit()]
    if luhn_digit(digits[:-1]) != digits[-1]:
        return None
    payload = [digits[0], *_places(key, "card", digits[1:-1], [10] * (len(digits) - 2), inverse)]
    return _into(text, map(str, [*payload, luhn_digit(payload)]))


def _iban(key: bytes, text: str, inverse: bool) -> str | None:
    plain = text.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = plain[4:]
    digits = [int(c) if c.isdigit() else ord(c) - 65 for c in body]
    moved = _places(key, "iban" + plain[:2], digits, [10 if c.isdigit() else 26 for c in body], inverse)
    body = "".join(str(d) if c.isdigit() else chr(65 + d) for c, d in zip(body, moved, strict=True))
    return _into(text, plain[:2] + f"{98 - number(body + plain[:2] + '00') % 97:02d}" + body)


@lru_cache(1)
def _late_days() -> tuple[int, ...]:
    """The days after the twelfth of their month: read day first, none of them is a date month first."""
    return tuple(d for d in range(FIRST_DAY, LAST_DAY + 1) if datetime.date.fromordinal(d).day > 12)


def _ordinal(year: int, month: int, day: int) -> int | None:
    try:
        ordinal = datetime.date(year, month, day).toordinal()
    except ValueError:
        return None
    return ordinal if FIRST_DAY <= ordinal <= LAST_DAY else None


def _date(key: bytes, text: str, inverse: bool) -> str | None:
    parts = [int(p) for p in re.split(r"[-./]", text)]
    day_first = text[2] == "."
    if text[2] != text[5] and text[4] != text[7:8]:
        return None
    year, month, day = parts if text[4] == "-" else (parts[2], *((parts[1], parts[0]) if day_first else (parts[0], parts[1])))
    ordinal = _ordinal(year, month, day)
    if ordinal is None and text[2] == "/" and (late := _ordinal(year, day, month)) is not None:
        days = _late_days()
        place = _network(key, "late date", len(days)).apply(bisect.bisect_left(days, late), inverse)
        return datetime.date.fromordinal(days[place]).strftime("%d/%m/%Y")
    if ordinal is None:
        return None
    moved = _network(key, "date", LAST_DAY - FIRST_DAY + 1).apply(ordinal - FIRST_DAY, inverse) + FIRST_DAY
    return datetime.date.fromordinal(moved).strftime("%Y-%m-%d" if text[4] == "-" else f"%d{text[2]}%m{text[2]}%Y" if day_first else "%m/%d/%Y")


#: First value and number of values of an octet written with 1, 2 or 3 digits.
OCTETS = {1: (0, 10), 2: (10, 90), 3: (100, 156)}


def _ip(key: bytes, text: str, inverse: bool) -> str | None:
    octets = text.split(".")
    bases = [OCTETS[len(o)] for o in octets]
    digits = [int(o) - base for o, (base, _) in zip(octets, bases, strict=True)]
    if any(not 0 <= d < n for d, (_, n) in zip(digits, bases, strict=True)):
        return None
    moved = _places(key, "ip", digits, [n for _, n in bases], inverse)
    return ".".join(str(d + base) for d, (base, _) in zip(moved, bases, strict=True))


def _phone(key: bytes, text: str, inverse: bool) -> str | None:
    digits = [int(c) for c in text if c.isdigit()]
    if text[0] == "+" and text[1] != "1":
        # The groups after the country code, which is the first of them.
        code = len(re.match(r"\+(\d+)", text)[1])
        if not 7 <= len(digits) <= 15:
            return None
        moved = _places(key, f"phone+{text[1 : 1 + code]}", digits[code:], [10] * (len(digits) - code), inverse)
        return _into(text, map(str, [*digits[:code], *moved]))
    moved = _places(key, "phone", [digits[-10] - 1, *digits[-9:]], [9, *[10] * 9], inverse)
    return _into(text, map(str, [*digits[:-10], moved[0] + 1, *moved[1:]]))


def _ssn(key: bytes, text: str, inverse: bool) -> str | None:
    area, group, serial = (int(p) for p in text.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    areas = area - 1 - (area > 666)
    area, group, serial = _places(key, "ssn", [areas, group - 1, serial - 1], [898, 99, 9999], inverse)
    area += 1
    return f"{area + (area >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"


#: Letters and digits of a name permuted as one number; the rest of a longer name follows in parts of its own.
EMAIL_LETTERS = 64


def _email(key: bytes, text: str, inverse: bool) -> str | None:
    local, _, domain = text.partition("@")
    kinds = [("0", 10) if c.isdigit() else ("a", 26) if c.islower() else ("A", 26) if c.isupper() else None for c in local]
    digits = [ord(c) - ord(k[0]) for c, k in zip(local, kinds, strict=True) if k]
    radices, tweak, moved = [k[1] for k in kinds if k], "email@" + domain.lower(), []
    for at in range(0, len(digits), EMAIL_LETTERS):
        part = slice(at, at + EMAIL_LETTERS)
        moved += _places(key, f"{tweak}:{at}" if at else tweak, digits[part], radices[part], inverse)
    moved = iter(moved)
    return "".join(chr(ord(k[0]) + next(moved)) if k else c for c, k in zip(local, kinds, strict=True)) + "@" + domain


_MAKERS = {"email": _email, "iban": _iban, "date": _date, "ip": _ip, "phone": _phone, "ssn": _ssn, "card": _card}


def _value_at(text: str, start: int, key: bytes, inverse: bool) -> tuple[str, int, str] | None:
    """Kind, end and pseudonym of the longest valid value at a place, kinds in the order of ``KINDS``."""
    for kind in KINDS:
        whole, form, end = _ALONE[kind]
        if not (match := whole.match(text, start)):
            continue
        if (made := _MAKERS[kind](key, match.group(), inverse)) is not None:
            return kind, match.end(), made
        # What follows a value may look like a part of it.
        for stop in range(match.end() - 1, start, -1):
            if end.match(text, stop) and form.fullmatch(text, start, stop) and (made := _MAKERS[kind](key, text[start:stop], inverse)) is not None:
                return kind, stop, made
    return None


def _values(text: str, key: bytes, inverse: bool) -> Iterator[tuple[str, int, int, str]]:
    at = 0
    while match := PATTERN.search(text, at):
        start = match.start()
        if value := _value_at(text, start, key, inverse):
            kind, at, made = value
            yield kind, start, at, made
        else:
            at = start + 1


def pseudonymise(text: str, key: bytes, inverse: bool = False, known: Iterable[tuple[str, int, int]] | None = None) -> tuple[str, list[tuple[str, int, int]]]:
    """One text with pseudonyms, and (kind, start, end) of what was replaced, in code points.

    ``known`` are the places of an earlier call. A pseudonym may be valid together with digits that
    follow it where the value was not, so only they undo a call with certainty.
    """
    parts, spans, at = [], [], 0
    if known is None:
        values = _values(text, key, inverse)
    else:
        values = ((kind, start, end, _MAKERS[kind](key, text[start:end], inverse)) for kind, start, end in known)
    for kind, start, end, made in values:
        parts += [text[at:start], made]
        spans.append((kind, start, end))
        at = end
    return ("".join([*parts, text[at:]]) if spans else text), spans


_MAY_HOLD = np.zeros(256, bool)
_MAY_HOLD[0x30:0x3A] = True
_MAY_HOLD[0x40] = True


def pseudonymise_documents(docs: DataFrame, key: bytes, text_col: str = "text", inverse: bool = False) -> DataFrame:
    """All rows and columns with texts pseudonymised, plus ``n_found`` and ``spans`` (kind:start:end, comma-joined).

    The inverse goes by the ``spans`` of the table if it has them, and finds values anew otherwise.
    """
    from lectern.llm import words

    undone = inverse and "spans" in docs.columns
    docs = docs.drop("n_found") if undone else docs.drop("n_found", "spans")
    names = [c for c in docs.columns if c != "spans"]
    docs = docs.select(*[f"`{c}`" for c in names], *(["spans"] if undone else []))
    place = names.index(text_col)
    known = lambda spans: [(a, int(b), int(c)) for a, b, c in (s.split(":") for s in (spans or "").split(",") if s)]

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, data, offsets in words.chunks(batch.column(place)):
                rows = batch.slice(first, n)
                before = np.concatenate(([0], np.cumsum(_MAY_HOLD[data])))[offsets]
                texts, found, spans = rows.column(place), np.zeros(n, np.int32), [""] * n
                if hits := np.flatnonzero(np.diff(before)).tolist():
                    changed = texts.to_pylist()
                    places = rows.column(len(names)).to_pylist() if undone else None
                    for k in hits:
                        changed[k], own = pseudonymise(changed[k], key, inverse, known(places[k]) if undone else None)
                        found[k], spans[k] = len(own), ",".join(f"{a}:{b}:{c}" for a, b, c in own)
                    texts = pa.array(changed, texts.type)
                columns = [*rows.columns[: len(names)], pa.array(found), pa.array(spans, pa.string())]
                columns[place] = texts
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_found", "spans"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "spans")
    return docs.mapInArrow(made, f"{schema}, n_found int, spans string")
