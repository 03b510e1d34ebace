"""Format-preserving pseudonyms for personal data and secrets.

Validated values are permuted by a keyed Feistel network within their own format: digits stay
digits, letters stay letters of the same case, separators stay. Card numbers keep a right check
digit, IBANs keep right check digits and the country, dates stay dates of the calendar, IPv4
addresses stay addresses. The permutation depends on the key, the kind and the value alone, so
equal values get equal pseudonyms in all documents, also in other groupings, and different values
of a format never collide. ``restore=True`` inverts it with the same key.

What counts as one value: a phone number is its digits with the calling code after a plus, in any grouping
(the code stays; a number without a plus is another value than one with a code, as its country isn't known, and keeps a first 0);
an email address is its lower case, whose pseudonym takes on the case of the text and keeps the public suffix, and characters beyond Latin-1, as they are; a date is its day in any
layout, also with the name of the month in English, German, French or Spanish, and before a time. The permutation of days keeps day and month on their side of 10 and the day on its side of 13, so that
layout and padding stay as they were and reading the pseudonym again gives the same parts.

Null texts stay null, with no finds; empty texts stay empty; rows that are repeated get equal results, row by
row. Texts of any length are read whole, in slices of their own. Empty tables give no rows. Other columns
stay; one named ``found`` is replaced. Where finds overlap, the kind that stands first in KINDS wins. Values
that fail validation (a wrong check digit, no such day) are left alone.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from bisect import bisect
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm.common import slices

ROUNDS = 8
KINDS = ("secret", "email", "iban", "card", "phone", "ip", "ssn", "date")

#: Latin letters and digits, a label of a domain in any script, and what ends one.
_L = "A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_DOMAIN = r"@(?:[^\W_](?:[\w-]{0,61}[^\W_])?\.)+[^\W\d_]{2,24}(?![\w-])"
_EMAIL = re.compile(rf"(?<![\w.+%-])[{_L}](?:[{_L}._%+'-]{{0,62}}[{_L}_%+-])?{_DOMAIN}|(?<=[^\W_{_L}])[{_L}._%+-]{{1,64}}{_DOMAIN}")
#: Second labels that are part of a country's public suffix, as in co.uk. Fixed values.
_SUFFIX = re.compile(r"(?:ac|co|com|edu|go|gob|gov|gouv|ne|net|or|org)\.[a-z]{2}$|[^.]+$")
_SECRET = re.compile(r"""(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key|auth)["']?\s*[:=]\s*["']?([A-Za-z0-9_/+\-]{16,}={0,2}(?:\.[A-Za-z0-9_\-]{8,}){0,2})|(?i:bearer)\s+([A-Za-z0-9_~/+\-]{16,}(?:\.[A-Za-z0-9_\-]{8,}){0,2}={0,2})|(?<!\w)(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9a-f]{32})(?!\w)""")
#: Public marks by which keys of known services are told; they stay.
_MARK = re.compile("AKIA|ASIA|eyJ|gh[pousr]_|sk-")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_CARD = re.compile(r"(?<![\w.])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?!\w)")
_PHONE = re.compile(r"(?<![\w+.])(?<![0-9][ -])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?!\w|[ .-][0-9])|(?<![\w+.])\+[0-9](?:[ ./-]?[0-9]|[ .-]?\([0-9]{1,5}\)){7,14}(?!\w|[.-][0-9])|(?<![\w+.])\(0[0-9]{1,4}\)[ ./-]?[0-9]{3,8}(?:[ .-][0-9]{2,4})?(?!\w|[.-][0-9])|(?<![\w+./-])0[0-9]{1,4}[ /-][0-9]{5,8}(?!\w|[.-][0-9])|(?<![\w+./-])0[0-9](?:[ .-][0-9]{2}){4}(?!\w|[ .-]?[0-9])")
_IP = re.compile(r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9])")
_SSN = re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
_DATE = re.compile(r"(?<![\w./-])(?:([0-9]{4})([-/.])([0-9]{1,2})\2([0-9]{1,2})|([0-9]{1,2})([-/.])([0-9]{1,2})\6([0-9]{4}))(?!(?!T[0-9]{2}:)\w|[./-][0-9])")
#: Months in the languages of the named layouts, in their order. Fixed values.
_MONTHS = {
    "en": "January February March April May June July August September October November December".split(),
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split(),
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
}
#: Layouts of days with a month's name: each tells its language by its points, its "de" or its capitals.
_NAMED = {
    "en1": ("en", r"(?P<m>{})(?P<a> )(?P<d>[0-9]{{1,2}})(?P<b>,? )(?P<y>[0-9]{{4}})"), "en2": ("en", r"(?P<d>[0-9]{{1,2}})(?P<a> )(?P<m>{})(?P<b>,? )(?P<y>[0-9]{{4}})"),
    "de": ("de", r"(?P<d>[0-9]{{1,2}})(?P<a>\. )(?P<m>{})(?P<b> )(?P<y>[0-9]{{4}})"), "fr": ("fr", r"(?P<d>[0-9]{{1,2}})(?P<a> )(?P<m>{})(?P<b> )(?P<y>[0-9]{{4}})"),
    "es": ("es", r"(?P<d>[0-9]{{1,2}})(?P<a> de )(?P<m>{})(?P<b> del? )(?P<y>[0-9]{{4}})"),
}
_NAMED = {k: (lang, re.compile(rf"(?<!\w){p.format('|'.join(_MONTHS[lang]))}(?!\w)")) for k, (lang, p) in _NAMED.items()}
_SOME_MONTH = re.compile("|".join({m for names in _MONTHS.values() for m in names}))
_DIGIT = re.compile("[0-9]")
#: Calling codes of one and two digits; all others have three. Fixed values (ITU-T E.164).
_CODE = re.compile("[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}")

#: Classes of symbols that a permutation keeps; the letters of the last two have one-character counterparts in the other case.
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ")

FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Feistel:
    """Keyed permutations of vectors of symbols and of ranges of integers."""

    def __init__(self, key: bytes, restore: bool = False):
        self.key, self.restore = hashlib.sha256(key).digest(), restore

    def _stream(self, kind: str, round_: int, radices: tuple[int, ...], other: list[int], n: int) -> list[int]:
        seed = repr((kind, round_, radices, other)).encode()
        out = b"".join(hashlib.blake2b(seed + bytes([i]), key=self.key).digest() for i in range(-(-n * 8 // 64)))
        return [int.from_bytes(out[8 * i : 8 * i + 8], "little") for i in range(n)]

    def symbols(self, kind: str, values: list[int], radices: list[int]) -> list[int]:
        """Permute the vectors with values[i] < radices[i]: each half in turn is shifted by a function of the other."""
        middle, shape = len(values) // 2, tuple(radices)
        halves, parts = [values[:middle], values[middle:]], [radices[:middle], radices[middle:]]
        for r in reversed(range(ROUNDS)) if self.restore else range(ROUNDS):
            side = r % 2
            shift = self._stream(kind, r, shape, halves[1 - side], len(halves[side]))
            sign = -1 if self.restore else 1
            halves[side] = [(v + sign * s) % m for v, s, m in zip(halves[side], shift, parts[side], strict=True)]
        return halves[0] + halves[1]

    def below(self, kind: str, value: int, size: int) -> int:
        """Permute 0 .. size - 1: a square of digits is permuted until the value falls into the range."""
        side = 1
        while side * side < size:
            side += 1
        while True:
            high, low = self.symbols(kind, list(divmod(value, side)), [side, side])
            value = high * side + low
            if value < size:
                return value

    def string(self, kind: str, text: str, hexadecimal: bool = False) -> str:
        """Permute digits and letters within their classes; other characters stay."""
        alphabets = [next((a for a in ("0123456789abcdef",) * hexadecimal + ALPHABETS if c in a), "") for c in text]
        at = [i for i, a in enumerate(alphabets) if a]
        new = self.symbols(kind, [alphabets[i].index(text[i]) for i in at], [len(alphabets[i]) for i in at])
        out = list(text)
        for i, v in zip(at, new, strict=True):
            out[i] = alphabets[i][v]
        return "".join(out)


def regroup(template: str, digits: str) -> str:
    """The template with its alphanumeric characters replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isalnum() else c for c in template)


def luhn_digit(payload: str) -> str:
    """The digit that makes payload + digit pass the Luhn check."""
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 - i % 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def iban_rest(compact: str) -> int:
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97


def date_of(match: re.Match) -> tuple[datetime.date, str] | None:
    """The day and the order of its parts; a pair that can be both is day, month."""
    g = match.groups()
    tries = [((g[0], g[2], g[3]), "ymd")] if g[0] else [((g[7], g[6], g[4]), "dmy"), ((g[7], g[4], g[6]), "mdy")]
    for parts, order in tries:
        try:
            day = datetime.date(*map(int, parts))
        except ValueError:
            continue
        if FIRST_DAY <= day.toordinal() <= LAST_DAY:
            return day, order
    return None


class Pseudonymizer:
    def __init__(self, key: bytes, restore: bool = False):
        self.net = Feistel(key, restore)
        self.one = lru_cache(maxsize=50_000)(self._one)

    def _one(self, kind: str, value: str) -> str | None:
        """The pseudonym of a value, None if it isn't valid."""
        net, compact = self.net, "".join(c for c in value if c.isalnum())
        if kind == "card":
            if luhn_digit(compact[:-1]) != compact[-1]:
                return None
            payload = net.string("card", compact[:-1])
            return regroup(value, payload + luhn_digit(payload))
        if kind == "iban":
            if not 15 <= len(compact) <= 34 or iban_rest(compact) != 1:
                return None
            inner = net.string("iban" + compact[:2], compact[4:])
            return regroup(value, f"{compact[:2]}{98 - iban_rest(compact[:2] + '00' + inner):02d}{inner}")
        if kind == "phone":
            if not 9 <= len(compact) <= 15:
                return None
            if value[0] != "+" and compact[0] != "0":  # 0 is a trunk's prefix, no first digit of an area
                first, *rest = net.symbols("phone", [int(compact[0]) - 1, *map(int, compact[1:])], [9] + [10] * (len(compact) - 1))
                return regroup(value, "".join(map(str, [first + 1, *rest])))
            code = _CODE.match(compact)[0] if value[0] == "+" else "0"
            return regroup(value, code + net.string("phone" + code, compact[len(code) :]))
        if kind == "ip":
            octets = list(map(int, value.split(".")))
            if max(octets) > 255 or any(len(o) > 1 and o[0] == "0" for o in value.split(".")):
                return None
            return ".".join(map(str, net.symbols("ip", octets, [256] * 4)))
        if kind == "ssn":
            area, group, serial = int(compact[:3]), int(compact[3:5]), int(compact[5:])
            if area in (0, 666) or area >= 900 or not group or not serial:
                return None
            rank = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
            rank, serial = divmod(net.below("ssn", rank, 898 * 99 * 9999), 9999)
            area, group = divmod(rank, 99)
            area += 1 + (area >= 665)
            return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"
        if kind == "date":
            if (match := _DATE.fullmatch(value)) is None:
                return self._named(value)
            return self._date(match, *found) if (found := date_of(match)) else None
        if kind == "email":
            plain = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
            local, _, domain = plain.rpartition("@")
            top = _SUFFIX.search(domain)[0] if domain.count(".") > 1 else domain.rpartition(".")[2]
            new = net.string("email", local) + "@" + net.string("domain", domain[: -len(top)]) + top
            return "".join(o if n == p else n.upper() if o.isupper() else n for n, p, o in zip(new, plain, value, strict=True))
        mark = _MARK.match(value)
        head, rest = (value[: mark.end()], value[mark.end() :]) if mark else ("", value)
        return head + net.string("secret" + head, rest, bool(re.fullmatch("[0-9a-f]+", rest)))

    def _day(self, day: datetime.date) -> datetime.date:
        side = lambda x: (x.day < 10, x.day > 12, x.month < 10)
        new = day
        while True:
            new = datetime.date.fromordinal(self.net.below("date", new.toordinal() - FIRST_DAY, LAST_DAY - FIRST_DAY + 1) + FIRST_DAY)
            if side(new) == side(day):
                return new

    def _named(self, value: str) -> str | None:
        """The new date in a layout with a month's name, in its language."""
        lang, match = next((lang, m) for lang, p in _NAMED.values() if (m := p.fullmatch(value)))
        try:
            day = datetime.date(int(match["y"]), _MONTHS[lang].index(match["m"]) + 1, int(match["d"]))
        except ValueError:
            return None
        if not FIRST_DAY <= day.toordinal() <= LAST_DAY:
            return None
        new = self._day(day)
        parts = {"y": f"{new.year:04d}", "m": _MONTHS[lang][new.month - 1], "d": f"{new.day:0{len(match['d'])}d}", "a": match["a"], "b": match["b"]}
        return "".join(parts[k] for k in sorted(parts, key=match.start))

    def _date(self, match: re.Match, day: datetime.date, order: str) -> str:
        """The new date in the old layout, each number padded as it was."""
        g = match.groups()
        separator, new = g[1] or g[5], self._day(day)
        old = {"ymd": (g[0], g[2], g[3]), "dmy": (g[4], g[6], g[7]), "mdy": (g[4], g[6], g[7])}[order]
        parts = {"ymd": (new.year, new.month, new.day), "dmy": (new.day, new.month, new.year), "mdy": (new.month, new.day, new.year)}[order]
        return separator.join(f"{n:0{len(o)}d}" for n, o in zip(parts, old))

    def find(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, pseudonym) of the valid values, without overlaps."""
        mail, digits = "@" in text, _DIGIT.search(text) is not None
        patterns = [("secret", _SECRET)] if digits or "=" in text or ":" in text else []
        patterns += [("email", _EMAIL)] if mail else []
        patterns += [("iban", _IBAN), ("card", _CARD), ("phone", _PHONE), ("ip", _IP), ("ssn", _SSN), ("date", _DATE)] if digits else []
        patterns += [("date", p) for _, p in _NAMED.values()] if digits and _SOME_MONTH.search(text) else []
        taken: list[tuple[int, int, str, str]] = []
        for kind, pattern in patterns:
            for match in pattern.finditer(text):
                group = next((i for i in (1, 2, 3) if match.group(i)), 0) if kind == "secret" else 0
                start, end = match.span(group)
                at = bisect(taken, (end,))  # the finds before it begin before this one's end; they don't overlap
                if at and taken[at - 1][1] > start:
                    continue
                new = self.one(kind, match.group(group))
                if new is not None:
                    taken.insert(at, (start, end, kind, new))
        return taken

    def replace(self, text: str) -> tuple[str, list[tuple[int, int, str, str]]]:
        found, out, last = self.find(text), [], 0
        for start, end, _, new in found:
            out += [text[last:start], new]
            last = end
        return "".join([*out, text[last:]]) if found else text, found


def replaced(key: bytes, restore: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonymizer(key, restore)
        spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in slices(batches):
            column = batch.column(batch.schema.get_field_index("text")).to_pylist()
            both = [(None, []) if text is None else names.replace(text) for text in column]
            found = pa.array([[{"kind": k, "start": s, "end": e} for s, e, k, _ in f] for _, f in both], spans)
            arrays = {"text": pa.array([t for t, _ in both], pa.string()), "found": found}
            arrays |= {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names if c != "text"}
            order = [*batch.schema.names, "found"]
            yield pa.RecordBatch.from_arrays([arrays[c] for c in order], order)

    return apply


def pseudonymize(docs: DataFrame, key: bytes, restore: bool = False) -> DataFrame:
    """``docs`` with ``text`` replaced and ``found`` array<struct<kind, start, end>> (code points of the old text).

    A column of docs that is already named ``found`` is replaced.
    """
    docs = docs.drop("found")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(replaced(key, restore), f"{fields}, found array<struct<kind:string,start:int,end:int>>")
