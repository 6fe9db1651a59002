"""Format-preserving pseudonyms: personal numbers, dates, addresses and secrets, found and validated, are permuted within their format.

Each kind has a pattern, a check (Luhn, mod 97, calendar, octet and area rules) and a set of values of its format. A keyed
Feistel network permutes that set (cycle-walking back into it), so a pseudonym passes the same check as its value, and equal
values have equal pseudonyms in every document, whatever their separators or case. Who holds the key can invert it.

Defined results. Null text stays null and has no findings. Where findings overlap, the kind listed first in KINDS wins, then
the earlier one. Values that fail their check stay as they are. Cards in a usual grouping (unbroken, 4-4-4-4, 4-6-5, 4-6-4)
are found first, whatever numbers stand beside them; in other groupings only as the longest run of up to 19 digits.
Rows and other columns pass through; a column that has the name of an added one is replaced. Texts are read whole, whatever their
length. An empty table gives no rows.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: production jobs pass a key of their own
DEFAULT_KEY = b"pseudonym key for tests"
ROUNDS = 8
LOWER, UPPER, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"


def permuted(x: int, n: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """The place of x in a keyed permutation of range(n), or the inverse."""
    if n < 2:
        return x
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, size = (1 << half) - 1, (half + 7) // 8

    def f(i: int, part: int) -> int:
        out, block = b"", 0
        while len(out) < size:
            out += hashlib.blake2b(b"%d,%d,%d," % (i, n, block) + part.to_bytes(size, "big") + tweak, key=key[:64]).digest()
            block += 1
        return int.from_bytes(out[:size], "big") & mask

    while True:
        left, right = x >> half, x & mask
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ f(i, left), left
            else:
                left, right = right, left ^ f(i, right)
        x = left << half | right
        if x < n:
            return x


def permuted_in(value: str, alphabets: list[str], key: bytes, tweak: bytes, valid: Callable[[str], bool] = lambda _: True, back: bool = False) -> str:
    """A value permuted among all strings whose i-th letter is in alphabets[i] and that are valid, as this one is."""
    n = 1
    for a in alphabets:
        n *= len(a)
    while True:
        x = 0
        for c, a in zip(value, alphabets):
            x = x * len(a) + a.index(c)
        x = permuted(x, n, key, tweak, back)
        out = []
        for a in reversed(alphabets):
            x, r = divmod(x, len(a))
            out.append(a[r])
        value = "".join(reversed(out))
        if valid(value):
            return value


def _refill(shape: str, letters: str) -> str:
    """Letters put in the place of a shape's ASCII letters and digits, in its case."""
    it = iter(letters)
    return "".join((c2.upper() if c.isupper() else c2) if c.isascii() and c.isalnum() and (c2 := next(it)) else c for c in shape)


def luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _card(m: re.Match, key: bytes, back: bool) -> str | None:
    digits = re.sub(r"\D", "", m[0])
    if not 13 <= len(digits) <= 19 or not luhn(digits) or len(set(digits)) == 1:
        return None
    body = permuted_in(digits[1:-1], [DIGITS] * (len(digits) - 2), key, b"card" + digits[0].encode(), back=back)
    return _refill(m[0], next(v for d in DIGITS if luhn(v := digits[0] + body + d)))


class _GroupedCards:
    """Within runs of numbers across single spaces or hyphens: every sub-run of numbers in a card's usual grouping; those that no hyphen ties to a neighbour come first."""

    _RUN = re.compile(r"(?<![0-9A-Za-z.-])(?=(?:[0-9][ -]?){12}[0-9])[0-9]+(?:[ -][0-9]+)*(?![0-9A-Za-z]|[-.][0-9])")
    _NUMBER, _WHOLE = re.compile(r"[0-9]+"), re.compile(r"[0-9 -]+")
    _SHAPES = ((4, 4, 4, 4), (4, 6, 5), (4, 6, 4), *((n,) for n in range(13, 20)))

    def finditer(self, text: str) -> Iterator[re.Match]:
        for run in self._RUN.finditer(text):
            spans = [n.span() for n in self._NUMBER.finditer(text, *run.span())]
            sizes = [b - a for a, b in spans]
            cut = [(spans[i][0], spans[i + len(shape) - 1][1]) for i in range(len(spans)) for shape in self._SHAPES if tuple(sizes[i : i + len(shape)]) == shape]
            for a, b in sorted(cut, key=lambda at: (text[max(at[0] - 1, 0)] == "-") + (text[at[1] : at[1] + 1] == "-")):
                yield self._WHOLE.match(text, a, b)


def _phone(m: re.Match, key: bytes, back: bool) -> str | None:
    country = m[1] or ""
    rest = m[0][len(country) :]
    digits = re.sub(r"\D", "", rest)
    plain = country.lstrip("+").strip()
    if not 9 <= len(digits) <= 12:
        return None
    north = plain in ("", "1") and len(digits) == 10
    rule = (lambda v: v[0] in "23456789" and v[3] in "23456789") if north else (lambda v: True)
    if not rule(digits):
        return None
    return country + _refill(rest, permuted_in(digits, [DIGITS] * len(digits), key, b"phone", rule, back))


def _ssn(m: re.Match, key: bytes, back: bool) -> str | None:
    def rule(v: str) -> bool:
        return v[:3] not in ("000", "666") and v[0] != "9" and v[3:5] != "00" and v[5:] != "0000"

    digits = m[0].replace("-", "")
    return _refill(m[0], permuted_in(digits, [DIGITS] * 9, key, b"ssn", rule, back)) if rule(digits) else None


def _ip(m: re.Match, key: bytes, back: bool) -> str | None:
    octets = [int(x) for x in m[0].split(".")]
    if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in m[0].split(".")):
        return None
    x = permuted(int.from_bytes(bytes(octets), "big"), 1 << 32, key, b"ip", back)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _iban(m: re.Match, key: bytes, back: bool) -> str | None:
    raw = m[0].replace(" ", "")
    if not 15 <= len(raw) <= 34 or mod97(raw) != 1:
        return None
    body = permuted_in(raw[4:], [DIGITS if c.isdigit() else UPPER for c in raw[4:]], key, b"iban" + raw[:2].encode(), back=back)
    return _refill(m[0], raw[:2] + f"{98 - mod97(f'{raw[:2]}00{body}'):02d}" + body)


_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def _date(m: re.Match, key: bytes, back: bool) -> str | None:
    """ISO, or day and month in either order: month first where it can be, else day first, which the pseudonym keeps. An unpadded day or month may get a second digit, and inverts padded."""
    a, sep, b, c = m[1], m[2], m[3], m[4]
    iso = len(a) == 4
    if iso == (len(c) == 4):
        return None
    y, x, z = (int(a), int(b), int(c)) if iso else (int(c), int(a), int(b))
    day_first = not iso and (x > 12 or sep == ".")
    month, day = (z, x) if day_first else (x, z)
    try:
        at = datetime.date(y, month, day).toordinal()
    except ValueError:
        return None
    if not _FIRST <= at <= _LAST:
        return None
    while True:
        at = _FIRST + permuted(at - _FIRST, _LAST - _FIRST + 1, key, b"date", back)
        d = datetime.date.fromordinal(at)
        if not day_first or sep == "." or d.day > 12:
            break
    first, second = (d.day, d.month) if day_first else (d.month, d.day)
    w = 2 if len(b) == 2 or iso else 1
    return f"{d.year:04d}{sep}{d.month:02d}{sep}{d.day:02d}" if iso else f"{first:0{w}d}{sep}{second:0{w}d}{sep}{d.year:04d}"


def _letters(value: str, key: bytes, tweak: bytes, back: bool, hexes: bool = False) -> str:
    """Letters and digits permuted, each within its own class, whatever the case."""
    chars = [c for c in value.lower() if c.isascii() and c.isalnum()]
    alphabets = [HEX] * len(chars) if hexes else [DIGITS if c.isdigit() else LOWER for c in chars]
    return _refill(value, permuted_in("".join(chars), alphabets, key, tweak, back=back))


def _email(m: re.Match, key: bytes, back: bool) -> str | None:
    local, _, domain = m[0].rpartition("@")
    return f"{_letters(local, key, b'email@' + domain.lower().encode(), back)}@{domain}"


def _key_id(m: re.Match, key: bytes, back: bool) -> str | None:
    return m[0][:4] + permuted_in(m[0][4:], [DIGITS + UPPER] * 16, key, b"keyid", back=back)


def _secret(m: re.Match, key: bytes, back: bool) -> str | None:
    value = m[2]
    hexes = re.fullmatch(r"[0-9a-f]+", value) is not None
    return m[1] + _letters(value, key, b"secret" + bytes([hexes]), back, hexes)


#: kind, pattern, pseudonym or None if the check fails; the first kinds win
KINDS: tuple[tuple[str, re.Pattern | _GroupedCards, Callable], ...] = (
    ("secret", re.compile(r"(?i)(\b(?:password|passwd|pwd|token|secret|api[_-]?key)[ \t]*[=:][ \t]*[\"']?)([A-Za-z0-9_+/.=-]{5,}[A-Za-z0-9])"), _secret),
    ("key_id", re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])"), _key_id),
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"), _email),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![A-Za-z0-9])"), _iban),
    ("ssn", re.compile(r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"), _ssn),
    ("card", _GroupedCards(), _card),
    ("card", re.compile(r"(?<![0-9A-Za-z.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z]|[-.][0-9])"), _card),
    ("phone", re.compile(r"(?<![0-9A-Za-z.])(\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]|[-.][0-9])"), _phone),
    ("phone", re.compile(r"(?<![0-9A-Za-z.])(\+[0-9]{1,3}[ .-]?)[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9A-Za-z]|[-.][0-9])"), _phone),
    ("ip", re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])"), _ip),
    ("date", re.compile(r"(?<![0-9A-Za-z./-])([0-9]{1,4})([-/.])([0-9]{1,2})\2([0-9]{1,4})(?![0-9A-Za-z]|[-/.][0-9])"), _date),
)
_MAYBE, _NAMED = re.compile(r"[0-9@=]").search, re.compile(r"(?i)(?:password|passwd|pwd|token|secret|api[_-]?key)[ \t]*:").search


def pseudonymised(text: str, key: bytes = DEFAULT_KEY, back: bool = False) -> tuple[str, list[dict]]:
    """The text with pseudonyms, and the findings: kind, start and end (code points of the input)."""
    if not _MAYBE(text) and not (":" in text and _NAMED(text)):
        return text, []
    found: list[tuple[int, int, str, str]] = []
    # the findings so far, which don't overlap: their starts in order, and where each ends
    starts: list[int] = []
    stop: dict[int, int] = {}
    for kind, pattern, pseudonym in KINDS:
        for m in pattern.finditer(text):
            a, b = m.span()
            i = bisect_left(starts, a)
            free = (i == len(starts) or b <= starts[i]) and (i == 0 or stop[starts[i - 1]] <= a)
            if free and (new := pseudonym(m, key, back)) is not None:
                found.append((a, b, kind, new))
                starts.insert(i, a)
                stop[a] = b
    found.sort()
    out, at = [], 0
    for a, b, _, new in found:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), [{"kind": k, "start": a, "end": b} for a, b, k, _ in found]


_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def with_pseudonyms(docs: DataFrame, key: bytes = DEFAULT_KEY, text: str = "text") -> DataFrame:
    """The columns of ``docs`` with pseudonyms in the text, and ``pii_found``: array of (kind, start, end)."""
    fields = [f for f in docs.schema.fields if f.name != "pii_found"]
    at = [f.name for f in fields].index(text)
    schema = T.StructType([*fields, T.StructField("pii_found", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if x is None else pseudonymised(x, key) for x in b.column(at).to_pylist()]
            columns = [*b.columns, pa.array([[] if x is None else x[1] for x in texts], _FOUND)]
            columns[at] = pa.array([None if x is None else x[0] for x in texts], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*(docs[f"`{f.name}`"] for f in fields)).mapInArrow(run, schema)
