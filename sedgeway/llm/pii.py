"""Format-preserving Feistel pseudonyms for personal data.

Every value is found by its format and validated (Luhn, mod-97, calendar, octet and area rules),
read as an integer below the number of values of that format, permuted there by a keyed Feistel
network with cycle walking, and written back in the same format and punctuation.  The permutation
depends only on key and format, so equal values get equal pseudonyms in all documents and stay
linked; it is a bijection without fixed points (x -> P'(P(x)+1), P' the inverse of P), so different
values stay different and none is left as it was.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgeway.llm import common

ROUNDS = 10
#: Key of the registered query; a real job passes its own secret.
DEMO_KEY = b"sedgeway demonstration key"
_DAY0 = datetime.date(1900, 1, 1)
_DAYS = (datetime.date(2100, 1, 1) - _DAY0).days

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_PII = re.compile(
    r"(?P<email>[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<secret>(?<![0-9A-Za-z])(?=[0-9A-Fa-f]*[0-9])(?=[0-9A-Fa-f]*[A-Fa-f])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z]))"
    rf"|(?P<ip>(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d))"
    r"|(?P<date>(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}-\d{1,2}-\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d/-]|\.\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-]))"
    r"|(?P<card>(?<![\d-])(?:\d{13,19}|\d{4}(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{1,7}|\d{4}[ -]\d{6}[ -]\d{4,5})(?![\d-]))"
)


class Permuter:
    """Keyed permutations of the integers below any bound."""

    def __init__(self, key: bytes, rounds: int = ROUNDS) -> None:
        self.key, self.rounds = hashlib.blake2b(key, digest_size=32).digest(), rounds

    def _round(self, tweak: bytes, r: int, half: int, bits: int) -> int:
        data = tweak + bytes([r]) + half.to_bytes((bits + 7) // 8 or 1, "big")
        size = min(64, (bits + 7) // 8 or 1)
        out = hashlib.blake2b(data, key=self.key, digest_size=size).digest()
        while len(out) * 8 < bits:
            out += hashlib.blake2b(out[-64:] + data, key=self.key, digest_size=64).digest()
        return int.from_bytes(out, "big") & ((1 << bits) - 1)

    def _feistel(self, x: int, bits: int, tweak: bytes, back: bool) -> int:
        half = bits // 2
        mask = (1 << half) - 1
        left, right = x >> half, x & mask
        if back:
            for r in reversed(range(self.rounds)):
                left, right = right ^ self._round(tweak, r, left, half), left
        else:
            for r in range(self.rounds):
                left, right = right, left ^ self._round(tweak, r, right, half)
        return left << half | right

    def _walk(self, x: int, n: int, tweak: bytes, back: bool) -> int:
        bits = max(2, (n - 1).bit_length())
        bits += bits % 2
        x = self._feistel(x, bits, tweak, back)
        while x >= n:  # at most four steps expected: the even number of bits is the next one
            x = self._feistel(x, bits, tweak, back)
        return x

    def move(self, x: int, n: int, tweak: bytes) -> int:
        """The pseudonym of x among 0..n-1; never x itself where n > 1."""
        return self._walk((self._walk(x, n, tweak, False) + 1) % n, n, tweak, True)

    def unmove(self, y: int, n: int, tweak: bytes) -> int:
        """The value whose pseudonym is y, for who has the key."""
        return self._walk((self._walk(y, n, tweak, False) - 1) % n, n, tweak, True)


def _mixed(move: Callable[[int, int], int], text: str, places: list[int]) -> str:
    """Permute the characters at ``places``, each within its own class of 10, 26 or 26."""
    radix, digit = [], []
    for p in places:
        c = text[p]
        base = "0" if c.isdigit() else "a" if c.islower() else "A"
        radix.append((10 if base == "0" else 26, ord(base)))
        digit.append(ord(c) - ord(base))
    x, n = 0, 1
    for (r, _), d in zip(radix, digit, strict=True):
        x, n = x * r + d, n * r
    x = move(x, n)
    out = list(text)
    for p, (r, base) in zip(reversed(places), reversed(radix), strict=True):
        x, d = divmod(x, r)
        out[p] = chr(base + d)
    return "".join(out)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


#: Characters of an IBAN by country (ISO 13616).
_IBAN_LENGTHS = {
    c: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS", 23: "AE GI IL TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ CY DO GT HU LB PL", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC",
    }.items()
    for c in countries.split()
}


def _iban_end(text: str) -> int:
    """Where a valid IBAN of its country's length ends before further words of the match; else the whole length."""
    size = _IBAN_LENGTHS.get(text[:2], 0)
    at = [k for k, c in enumerate(text, 1) if c.isalnum()]
    if 0 < size < len(at) and text[at[size - 1]] == " " and _mod97(text[: at[size - 1]].replace(" ", "")) == 1:
        return at[size - 1]
    return len(text)


#: Country calling codes of one and of two digits (ITU-T E.164); the others have three.
_CODES = {*"17", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}


def _country_digits(digits: str) -> int:
    return next((n for n in (1, 2) if digits[:n] in _CODES), 3)


def _shape(text: str) -> bytes:
    return "".join("9" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else "." for c in text).encode()


def _put(digits: str, text: str) -> str:
    """Digits written into the places of text's digits."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in text)


def pseudonym(kind: str, text: str, permuter: Permuter, back: bool = False) -> str | None:
    """The pseudonym of a value of this kind (or, with ``back``, its value), None if it isn't valid."""
    step = permuter.unmove if back else permuter.move
    bare = re.sub(r"[^0-9A-Za-z]", "", text)
    tweak = kind.encode() + b":"
    if kind == "email":
        # whatever its case it is the same address: permuted in lower case, written with the case it had
        local = text.split("@")[0]
        small = local.lower()
        places = [i for i, c in enumerate(small) if c.isalnum()]
        t = tweak + _shape(small) + text[len(local) :].lower().encode()
        new = _mixed(lambda x, n: step(x, n, t), small, places)
        return "".join(c.upper() if o.isupper() else c for c, o in zip(new, local, strict=True)) + text[len(local) :]
    if kind == "ip":
        octets = [int(o) for o in text.split(".")]
        x = step(int.from_bytes(bytes(octets), "big"), 1 << 32, tweak)
        return ".".join(map(str, x.to_bytes(4, "big")))
    if kind == "date":
        parts = re.split(r"([/.-])", text)
        numbers = [int(parts[k]) for k in (0, 2, 4)]
        orders = [(0, 1, 2)] if len(parts[0]) == 4 else [(2, 0, 1), (2, 1, 0)] if parts[1] != "." else [(2, 1, 0)]
        for order in orders:  # month first where both readings are dates
            try:
                day = datetime.date(*(numbers[k] for k in order))
            except ValueError:
                continue
            if not 0 <= (day - _DAY0).days < _DAYS:
                return None
            new = _DAY0 + datetime.timedelta(days=step((day - _DAY0).days, _DAYS, tweak))
            put = dict(zip(order, (new.year, new.month, new.day), strict=True))
            if order == (2, 1, 0) and len(orders) == 2 and new.day <= 12:
                # read back as month first: take the walk on to a date that reads the same way
                while new.day <= 12:
                    new = _DAY0 + datetime.timedelta(days=step((new - _DAY0).days, _DAYS, tweak))
                put = dict(zip(order, (new.year, new.month, new.day), strict=True))
            return parts[1].join(f"{put[k]:0{4 if len(parts[2 * k]) == 4 else 2}d}" for k in range(3))
        return None
    if kind == "ssn":
        area, group, serial = (int(v) for v in text.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        x = step(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, tweak)
        x, serial = divmod(x, 9999)
        area, group = divmod(x, 99)
        return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"
    if kind == "iban":
        if not 15 <= len(bare) <= 34 or _mod97(bare) != 1:
            return None
        t = tweak + _shape(bare) + bare[:2].encode()
        new = _mixed(lambda x, n: step(x, n, t), bare, list(range(4, len(bare))))
        new = new[:2] + f"{98 - _mod97(new[:2] + '00' + new[4:]):02d}" + new[4:]
        it = iter(new)
        return "".join(next(it) if c.isalnum() else c for c in text)
    if kind == "secret":
        n = 1 << 4 * len(text)
        while True:  # walk to one that is still found: with a digit and a letter
            text2 = f"{step(int(text, 16), n, tweak + str(len(text)).encode()):0{len(text)}x}"
            text = text2.upper() if text.isupper() else text2
            if re.search(r"\d", text) and re.search(r"[a-fA-F]", text):
                return text
    digits = re.sub(r"\D", "", text)
    if kind == "phone":
        # by its digits alone, however they are grouped; the country code of an international number stays
        if not 7 <= len(digits) <= 15:
            return None
        fixed = _country_digits(digits) if text.startswith("+") else 0
        tail, t = digits[fixed:], tweak + digits[:fixed].encode() + b"/" + str(len(digits)).encode()
        return _put(digits[:fixed] + f"{step(int(tail), 10 ** len(tail), t):0{len(tail)}d}", text)
    if kind == "card":
        if not luhn(digits):  # an order number or the like
            return None
        t = tweak + str(len(digits)).encode()
        body = f"{step(int(digits[:-1]), 10 ** (len(digits) - 1), t + b'v'):0{len(digits) - 1}d}"
        return _put(body + next(c for c in "0123456789" if luhn(body + c)), text)
    raise ValueError(kind)



def replace_pii(text: str, permuter: Permuter, known: dict[str, str | None], kinds: list[str] | None = None) -> tuple[str, int]:
    """The text with every valid value replaced, and their number."""
    count = 0

    def swap(m: re.Match) -> str:
        nonlocal count
        kind, value = next(k for k, v in m.groupdict().items() if v is not None and k != "gap"), m[0]
        end = _iban_end(value) if kind == "iban" else len(value)
        value, rest = value[:end], value[end:]
        if value not in known:
            if len(known) > 100_000:
                known.clear()
            known[value] = pseudonym(kind, value, permuter)
        new = known[value]
        if new is None:
            return value + rest
        count += 1
        if kinds is not None:
            kinds.append(kind)
        return new + rest

    return _PII.sub(swap, text), count


def pseudonymise(docs: DataFrame, key: bytes = DEMO_KEY) -> DataFrame:
    """``doc_id, n_pii, kinds, text``: every whole text with personal data pseudonymised.

    kinds lists the kinds found, sorted, joined by commas.  A null text stays null with 0 found; an
    empty one stays empty; repeated rows are treated alike; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permuter, known = Permuter(key), {}
        for batch in batches:
            text = batch.column(1)
            may = pc.fill_null(pc.match_substring_regex(text, r"@|\d"), False)
            out, counts, kinds = text.to_pylist(), [0] * len(text), [""] * len(text)
            for k in pc.indices_nonzero(may).to_pylist():
                found: list[str] = []
                out[k], counts[k] = replace_pii(out[k], permuter, known, found)
                kinds[k] = ",".join(sorted(set(found)))
            yield pa.record_batch(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(kinds, pa.string()), pa.array(out, pa.string())], names=["doc_id", "n_pii", "kinds", "text"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        common.frugal(run), "doc_id long, n_pii long, kinds string, text string"
    )
