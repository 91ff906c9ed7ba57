"""Personal data replaced by format-preserving pseudonyms from a keyed Feistel permutation.

Every kind of value is read as a whole number below the count of its valid
values, permuted under the key, and written in the same format: digits stay
digits, separators stay, check digits are right again, dates are calendar dates.
Digits of any script are read, and written in their own script.
A permutation has one image for each value, so equal values stay linked across
documents and different ones stay apart; who holds the key can undo it.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from datetime import date
from functools import lru_cache
from math import isqrt, prod

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ROUNDS = 8
_HEX = "0123456789abcdefABCDEF"
_BLOCK = 128  # letters or digits that are permuted as one number
_FIRST_DAY, _LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()

# What values look like; the checks below decide.
PATTERNS = {
    "email": r"(?<![\w.+-])[\w.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "secret": r"(?i:\b(?:token|key|secret|password)\s*[=:]\s*[\"']?)([0-9a-fA-F]{24,})\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/-]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "number": r"(?<![\d.,-])\d(?:[ -]?\d){11,18}(?![\d-]|[.,]\d)",
}
KINDS = tuple(PATTERNS)
_MAY = r"[\p{Nd}@]|[a-fA-F]{24}"  # what every value holds
_ANY = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in PATTERNS.items()))
_EACH = {kind: re.compile(pattern) for kind, pattern in PATTERNS.items()}

_IBAN_LENGTHS = (
    "NO15 BE16 DK18 FI18 FK18 FO18 GL18 NL18 SD18 MK19 SI19 AT20 BA20 EE20 KZ20 LT20 LU20 MN20 XK20 CH21 HR21 LI21 LV21 BG22 BH22 CR22 DE22 GB22 GE22 IE22 ME22 RS22 VA22 "
    "AE23 GI23 IL23 IQ23 OM23 SO23 TL23 AD24 CZ24 ES24 MD24 PK24 RO24 SA24 SE24 SK24 TN24 VG24 LY25 PT25 ST25 IS26 TR26 BI27 DJ27 FR27 GR27 IT27 MC27 MR27 SM27 "
    "AL28 AZ28 BY28 CY28 DO28 GT28 HN28 HU28 LB28 NI28 PL28 SV28 BR29 EG29 PS29 QA29 UA29 JO30 KW30 MU30 YE30 MT31 SC31 LC32 RU33"
)
IBAN_LENGTHS = {x[:2]: int(x[2:]) for x in _IBAN_LENGTHS.split()}


class Pseudonyms:
    """The permutations under one key; ``undo`` inverts them."""

    def __init__(self, key: bytes, undo: bool = False):
        self.key, self.undo = hashlib.blake2b(key, digest_size=32).digest(), undo

    def permute(self, value: int, count: int, tweak: str) -> int:
        """The image of ``value`` among 0..count-1; walks the cycle while it lies outside."""
        if count < 2:
            return value
        a = isqrt(count - 1) + 1
        b = -(-count // a)
        while True:
            value = self._feistel(value, a, b, tweak)
            if value < count:
                return value

    def _feistel(self, value: int, a: int, b: int, tweak: str) -> int:
        left, right = divmod(value, b)
        for r in reversed(range(_ROUNDS)) if self.undo else range(_ROUNDS):
            step = self._round(r, right if r % 2 == 0 else left, a if r % 2 == 0 else b, tweak) * (-1 if self.undo else 1)
            if r % 2 == 0:
                left = (left + step) % a
            else:
                right = (right + step) % b
        return left * b + right

    def _round(self, number: int, half: int, most: int, tweak: str) -> int:
        """A number that is even below ``most``, up to a part in 2^128."""
        said = f"{number}|{tweak}|".encode() + half.to_bytes((half.bit_length() + 7) // 8, "big")
        return int.from_bytes(hashlib.shake_256(self.key + said).digest((most.bit_length() + 7) // 8 + 16), "big")

    def sequence(self, places: list[int], sizes: list[int], tweak: str) -> list[int]:
        """The image of a sequence, the i-th below ``sizes[i]``.  Blocks of ``_BLOCK`` places are permuted in turn,
        each under the images of those before it, from the left and then from the right: all of the sequence
        decides about each place, in time that grows with its length."""
        cuts = range(0, len(places), _BLOCK)
        counts = [prod(sizes[c : c + _BLOCK]) for c in cuts]
        values = [_joined(places[c : c + _BLOCK], sizes[c : c + _BLOCK]) for c in cuts]
        if len(values) == 1:
            values = [self.permute(values[0], counts[0], tweak)]
        elif values:
            short = hashlib.blake2b(tweak.encode("utf-8", "surrogatepass"), digest_size=32).hexdigest()
            turns = [(0, range(len(values))), (1, range(len(values) - 1, -1, -1))]
            for turn, order in reversed(turns) if self.undo else turns:
                chain = b""
                for i in order:
                    before = values[i]
                    values[i] = self.permute(before, counts[i], f"{short}|{turn}|{i}|{chain.hex()}")
                    seen = before if self.undo else values[i]
                    chain = hashlib.blake2b(chain + seen.to_bytes((counts[i].bit_length() + 7) // 8, "big"), digest_size=32).digest()
        return [place for c, value in zip(cuts, values) for place in _parted(value, sizes[c : c + _BLOCK])]

    def permute_valid(self, value: int, count: int, tweak: str, valid: Callable[[int], bool]) -> int:
        """As ``permute``, inside the valid values alone."""
        while True:
            value = self.permute(value, count, tweak)
            if valid(value):
                return value

    def digits(self, text: str, tweak: str, keep: int = 0, valid: Callable[[str], bool] | None = None) -> str:
        """All digits of ``text`` but the first ``keep``; everything else stays in its place."""
        plain = _plain(text)
        head, body = plain[:keep], plain[keep:]
        n = len(body)
        tweak = f"{tweak}|{head}|{n}"
        if valid is None:
            image = self.permute(int(body), 10**n, tweak)
        else:
            image = self.permute_valid(int(body), 10**n, tweak, lambda x: valid(head + str(x).zfill(n)))
        return _refill(text, head + str(image).zfill(n))

    def pseudonym(self, kind: str, text: str) -> str | None:
        """The pseudonym of a value, or None if it is no valid value of its kind."""
        return getattr(self, f"_{kind}")(text)

    def _number(self, text: str) -> str | None:
        """Any 12 to 19 digits that are not all the same.  Each length from 13 on at which the digits are a card's stays
        one, and no other becomes one, so that the same digits are read again wherever they are grouped."""
        plain = _plain(text)
        n, free = len(plain), 11 if len(plain) == 12 else 12
        if len(set(plain)) == 1:
            return None
        same = len(set(plain[:free])) == 1
        value, count, cards = (int(plain[0]), 10, "") if same else (int(plain[:free]), 10**free, "")
        for i in range(free, n):
            off = (int(plain[i]) - int(luhn_digit(plain[:i]))) % 10
            cards += "-" if off else "+"
            if off:
                value, count = value * 9 + off - 1, count * 9

        def read(x: int) -> str:
            offs = []
            for card in reversed(cards):
                x, off = (x, -1) if card == "+" else divmod(x, 9)
                offs.append(off + 1)
            out = str(x) * free if same else str(x).zfill(free)
            for off in reversed(offs):
                out += str((int(luhn_digit(out)) + off) % 10)
            return out

        return _refill(text, read(self.permute_valid(value, count, f"number{n}{cards}{same}", lambda x: len(set(read(x)[: n if same else free])) > 1)))

    def _card(self, text: str) -> str | None:
        plain = _plain(text)
        return self._number(text) if len(plain) >= 12 and luhn(plain) else None

    def _iban(self, text: str) -> str | None:
        plain = _ascii(text.replace(" ", ""))
        if not 15 <= len(plain) <= 34 or iban_check(plain[:2], plain[4:]) != plain[2:4]:
            return None
        body = self._letters(plain[4:], "iban" + plain[:2])
        return _refill(text, plain[:2] + iban_check(plain[:2], body) + body, also_letters=True)

    def _ip(self, text: str) -> str | None:
        """Written in the script of its first digit, as octets change their length."""
        said = _ascii(text).split(".")
        parts = [int(p) for p in said]
        if max(parts) > 255 or any(str(n) != p for n, p in zip(parts, said)):
            return None
        image = self.permute(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip")
        return ".".join(_refill(text[0] * len(str(b)), str(b)) for b in image.to_bytes(4, "big"))

    def _date(self, text: str) -> str | None:
        """Dates from 1900 to 2099.  With slashes the month is first where that is a date, else the day."""
        mark = next(c for c in text if c in "-/.")
        a, b, c = (int(p) for p in text.split(mark))
        month_first = mark == "/" and a <= 12
        y, m, d = (a, b, c) if mark == "-" else (c, a, b) if month_first else (c, b, a)
        try:
            day = date(y, m, d).toordinal()
        except ValueError:
            return None
        if not _FIRST_DAY <= day <= _LAST_DAY:
            return None

        def fits(x: int) -> bool:  # what is read again in the same order of day and month
            return mark != "/" or month_first or date.fromordinal(_FIRST_DAY + x).day > 12

        kind = "dates, day above 12" if mark == "/" and not month_first else "dates"
        new = date.fromordinal(_FIRST_DAY + self.permute_valid(day - _FIRST_DAY, _LAST_DAY - _FIRST_DAY + 1, kind, fits))
        form = "{y:04}{m:02}{d:02}" if mark == "-" else "{m:02}{d:02}{y:04}" if month_first else "{d:02}{m:02}{y:04}"
        return _refill(text, form.format(y=new.year, m=new.month, d=new.day))

    def _ssn(self, text: str) -> str | None:
        return self.digits(text, "ssn", valid=is_ssn) if is_ssn(_plain(text)) else None

    def _phone(self, text: str) -> str | None:
        plain = _plain(text)
        if not 9 <= len(plain) <= 15:
            return None
        country = re.match(r"\+(\d{1,3})(?=[ .(-])", text)
        return self.digits(text, "phone", keep=len(country[1]) if country else 0)

    def _email(self, text: str) -> str | None:
        name, domain = text.rsplit("@", 1)
        if all(len(_alike(c)) < 2 for c in name):  # marks only: nothing to permute
            return None
        return f"{self._letters(name, 'email' + domain.lower())}@{domain}"

    def _secret(self, text: str) -> str | None:
        """Hexadecimal digits in capitals, in small letters or in both, and the image so again."""
        head = re.match(r".*?[=:]\s*[\"']?", text, re.S)[0]
        body = text[len(head) :]
        case = _hex_case(body)
        digits = {"upper": _HEX[:10] + _HEX[16:], "lower": _HEX[:16], "mixed": _HEX}[case]
        image, sizes = body, [len(digits)] * len(body)
        while True:
            image = "".join(digits[i] for i in self.sequence([digits.index(c) for c in image], sizes, f"secret{case}{len(body)}"))
            if _hex_case(image) == case:
                return head + image

    def _letters(self, text: str, tweak: str) -> str:
        """Letters among letters of their case and script, digits among digits; the rest stays."""
        alike = [_alike(c) for c in text]
        shape = "".join(letters[0] for letters in alike)
        image = self.sequence([letters.index(c) for c, letters in zip(text, alike)], [len(letters) for letters in alike], f"{tweak}|{shape}")
        return "".join(letters[place] for letters, place in zip(alike, image))

    def apply(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and kind, begin and end of each in the new text (code points)."""
        out, spans, at, length, begin = [], [], 0, 0, 0
        failed: list[tuple[str, int, int]] = []
        while match := _ANY.search(text, begin):
            begin = match.start()
            failed = [f for f in failed if f[2] > begin]
            found = self._value(text, match, failed)
            if found is None:
                begin += 1
                continue
            kind, end, image = found
            out += [text[at:begin], image]
            length += begin - at
            spans.append((kind, length, length + len(image)))
            length, at, begin = length + len(image), end, end
        return ("".join([*out, text[at:]]) if spans else text), spans

    def _value(self, text: str, match: re.Match, failed: list[tuple[str, int, int]]) -> tuple[str, int, str] | None:
        """Kind, end and pseudonym of the value that begins where ``match`` does; what is no value goes to ``failed``.

        Where the pseudonym would make a value of something that failed, its own pseudonym is taken, so that
        the new text is read as the old one.
        """
        begin = match.start()
        first = match.lastgroup if match.lastgroup in PATTERNS else next(k for k in KINDS if match[k] is not None)
        for kind in KINDS[KINDS.index(first) :]:
            form = match[0] if kind == first else (m := _EACH[kind].match(text, begin)) and m[0]
            if not form:
                continue
            if kind == "number" and (accounts := [b for k, b, _ in failed if k == "iban" and b < begin]):
                if begin < max(accounts) + 4:
                    continue  # check digits, no number
                kind = "card"  # other digits belong to what only looks like an IBAN
            for end in _ends(kind, form, text[begin + len(form) : begin + len(form) + 1]):
                image = self.pseudonym(kind, form[:end])
                if image is None:
                    failed.append((kind, begin, begin + end))
                    continue
                while any(self.pseudonym(k, (text[b:begin] + image + text[begin + end :])[: e - b]) is not None for k, b, e in failed):
                    image = self.pseudonym(kind, image)
                return "number" if kind == "card" else kind, begin + end, image
        return None


def _ends(kind: str, form: str, after: str) -> Iterator[int]:
    """Lengths of ``form`` that may be a value, the likeliest first: patterns take what stands behind a value, too."""
    gaps = [i for i in range(1, len(form)) if form[i] in " .-" and form[i - 1] not in " .-"]
    if kind == "iban":
        places = [i + 1 for i, c in enumerate(form) if c != " "]
        own = IBAN_LENGTHS.get(form[:2], 0)
        if 0 < own <= len(places) and not (form[places[own - 1] :] + after)[:1].isalnum():
            yield places[own - 1]
        yield len(form)
        if not own:
            yield from reversed(gaps)
    elif kind == "number":
        for end in gaps:
            plain = _plain(form[:end])
            if 13 <= len(plain) <= 19 and luhn(plain) and len(set(plain)) > 1:
                yield end
        yield len(form)
    elif kind == "card":
        yield from (i for i in gaps if len(_plain(form[:i])) >= 13)
        yield len(form)
    else:
        yield len(form)
        if kind == "phone":
            yield from reversed(gaps)


def _hex_case(digits: str) -> str:
    return "upper" if digits == digits.upper() else "lower" if digits == digits.lower() else "mixed"


def _joined(places: list[int], sizes: list[int]) -> int:
    value = 0
    for place, size in zip(places, sizes):
        value = value * size + place
    return value


def _parted(value: int, sizes: list[int]) -> list[int]:
    out = []
    for size in reversed(sizes):
        value, place = divmod(value, size)
        out.append(place)
    return out[::-1]


def _ascii(text: str) -> str:
    """``text`` with the digits of all scripts as 0-9."""
    return text if text.isascii() else "".join(str(int(c)) if c.isdecimal() else c for c in text)


def _plain(text: str) -> str:
    """The digits of ``text`` as 0-9."""
    return "".join(c for c in _ascii(text) if c in "0123456789")


def _refill(form: str, values: str, also_letters: bool = False) -> str:
    """``form`` with its digits (and letters) replaced by ``values``, in order; digits stay in their script."""
    given = iter(values)

    def digit(c: str) -> str:
        return next(given) if c.isascii() else chr(ord(c) - int(c) + int(next(given)))

    return "".join(digit(c) if c.isdecimal() else next(given) if also_letters and c.isalnum() else c for c in form)


@lru_cache(maxsize=1 << 14)
def _alike(c: str) -> str:
    """What may stand for a character: the digits of its script; the letters of its case, among ASCII or
    the 128 code points around it; else itself."""
    if c.isdecimal():
        return "".join(chr(ord(c) - int(c) + i) for i in range(10))
    if not c.isalnum():
        return c
    first = ord(c) & ~127
    return "".join(x for x in map(chr, range(first, first + 128)) if x.isalnum() and not x.isdecimal() and unicodedata.category(x) == unicodedata.category(c))


def luhn(digits: str) -> bool:
    return luhn_digit(digits[:-1]) == digits[-1]


def luhn_digit(body: str) -> str:
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body)))
    return str(-total % 10)


def iban_check(country: str, body: str) -> str:
    number = int("".join(str(int(c, 36)) for c in body + country + "00"))
    return f"{98 - number % 97:02}"


def is_ssn(digits: str) -> bool:
    area, group, serial = digits[:3], digits[3:5], digits[5:]
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def pseudonymise(documents: DataFrame, key: bytes, undo: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text (with pseudonyms), n_found, kinds (sorted, distinct, joined by
    ``;``), spans (kind, begin, end in code points of the new text).

    Null text stays null and empty text empty, with nothing found; whole texts are read; a text without
    a valid value comes back unchanged.  Values that only look like one (wrong check digit of an
    IBAN, no calendar date, an octet above 255) stay; values that begin inside them or end earlier are found, but in
    what looks like an IBAN, of the long numbers, only cards.  Where a pseudonym would
    make a value of something invalid around it, its own pseudonym stands there, so that undoing reads the same values;
    only there has a value another pseudonym than elsewhere, at the worst itself, where every other value would
    make one of what failed.  A permutation may map a value to itself: one in as many as its format has.  Rows with equal or null ids are separate.
    Other columns are not read.  No rows in, no rows out.
    Ids are whole numbers.
    """
    schema = "doc_id long, text string, n_found int, kinds string, spans array<struct<kind:string,begin:int,end:int>>"
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_replace(key, undo), schema)


def _replace(key: bytes, undo: bool) -> Callable:
    span = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))
    names = ["doc_id", "text", "n_found", "kinds", "spans"]

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permuted = Pseudonyms(key, undo)
        for batch in batches:
            texts = batch.column("text")
            may = pc.fill_null(pc.match_substring_regex(texts, _MAY), False).to_numpy(zero_copy_only=False)
            found: list[list] = [[] for _ in range(len(batch))]
            new = {}
            for i in may.nonzero()[0].tolist():
                text, spans = permuted.apply(texts[i].as_py())
                if spans:
                    new[i], found[i] = text, spans
            if new:
                at = sorted(new)
                mask = pa.array([i in new for i in range(len(batch))])
                texts = pc.replace_with_mask(texts, mask, pa.array([new[i] for i in at], texts.type))
            counts = pa.array([len(x) for x in found], pa.int32())
            kinds = pa.array([";".join(sorted({k for k, _, _ in x})) for x in found], pa.string())
            spans = pa.array([[{"kind": k, "begin": b, "end": e} for k, b, e in x] for x in found], span)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts, counts, kinds, spans], names=names)

    return replace
