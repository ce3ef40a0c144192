"""Personal data replaced by format-preserving Feistel pseudonyms.

Validated numbers and dates are permuted with a key inside their own format: a card number becomes another card number
with the same issuer prefix and a right check digit, a date another date. The same value always becomes the same
pseudonym, however it is spaced, so records stay linked across documents, and the key's holder can invert it. Numbers
that fail their check (Luhn, mod 97, octets up to 255, the calendar) are left as they are. A phone number has one
pseudonym with and without its country's code.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import socket
from collections import Counter

from pyspark.sql import DataFrame, functions as F

from .common import map_rows

ROUNDS = 10
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
LONG = (16, 17, 18, 19)
# Issuer prefixes of card numbers, with the lengths of their numbers; none is the beginning of another one,
# so a pseudonym has the prefix of its value. 60 keeps four digits, as several issuers share it. Maestro's numbers below
# 16 digits are left out: article numbers look like them.
ISSUERS = {
    "1": (15,),
    "4": (13, 16, 19),
    **dict.fromkeys(("34", "37"), (15,)),
    **dict.fromkeys(("36", "38", "39", "3095", *map(str, range(300, 306))), (14, 15, *LONG)),
    **dict.fromkeys(("35", "50", "56", "57", "58", "61", "62", "63", "64", "65", "66", "67", "68", "69", "81", *(f"60{n:02d}" for n in range(100))), LONG),
    **dict.fromkeys((*map(str, range(51, 56)), *map(str, range(2221, 2721)), "82", "9792"), (16,)),
    **dict.fromkeys(map(str, range(2200, 2205)), LONG),
}
# Country codes of one and two digits; all others have three.
COUNTRIES = {"1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}
# Most digits of a number with its country code, where that is fewer than 15.
LONGEST = {"1": 11, "7": 11, "33": 11, "34": 11, "44": 12}

PATTERN = re.compile(
    r"""(?P<email>(?<![\w.+-])[A-Za-z0-9][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w-]))
    |(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w))
    |(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?(?:\d(?:[ .-]\d\d){4}|\d{2,4}(?:[ .-]?\d{2,4}){1,3})(?!\d))
    |(?P<national>(?<![\w.+-])(?:\([2-9]\d\d\)[ ]?[2-9]\d\d[ .-]\d{4}|[2-9]\d\d(?P<nansep>[ .-])[2-9]\d\d(?P=nansep)\d{4}|0[1-9](?P<frsep>[ .-])\d\d(?:(?P=frsep)\d\d){3})(?![\w-]|\.\d))
    |(?P<iso>(?<![\w/-])\d{4}(?P<isosep>[-/])\d{2}(?P=isosep)\d{2}(?=T\d\d:\d\d|(?![\w/-])))
    |(?P<us>(?<![\w/.-])\d{2}/\d{2}/\d{4}(?![\w/-]))
    |(?P<eu>(?<![\w/.-])\d{2}\.\d{2}\.\d{4}(?![\w/-]|\.\d))
    |(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d))
    |(?P<ip6>(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]))
    |(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))
    |(?P<card>(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-]))""",
    re.X | re.A,
)
_hint = re.compile(r"[0-9@]")
#: Groups inside a kind's pattern, and the names of kinds that have several patterns.
INSIDE = {"isosep": "iso", "nansep": "national", "frsep": "national"}
SPACED = ("phone", "card", "iban")
_gap = re.compile(r"[ .-]+")
NAMES = {"iso": "date", "us": "date", "eu": "date", "national": "phone", "ip6": "ip"}


def luhn(digits: str) -> int:
    """Sum of the Luhn scheme modulo 10; 0 for a valid number."""
    back = [int(c) for c in reversed(digits)]
    return (sum(back[::2]) + sum(sum(divmod(2 * d, 10)) for d in back[1::2])) % 10


def issuer(digits: str) -> str | None:
    return next((digits[:n] for n in range(1, 5) if len(digits) in ISSUERS.get(digits[:n], ())), None)


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


class Feistel:
    """Keyed permutations of the numbers below a bound."""

    def __init__(self, key: bytes):
        self.key = key

    def word(self, tweak: str, turn: int, value: int, modulus: int) -> int:
        digest = hashlib.blake2b(f"{tweak}|{turn}|{value}".encode(), key=self.key, digest_size=16).digest()
        return int.from_bytes(digest, "big") % modulus

    def mix(self, tweak: str, value: int, left: int, right: int, back: bool) -> int:
        """Permutes the numbers below left * right."""
        a, b = divmod(value, right)
        for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if turn % 2:
                b = (b + (-1 if back else 1) * self.word(tweak, turn, a, right)) % right
            else:
                a = (a + (-1 if back else 1) * self.word(tweak, turn, b, left)) % left
        return a * right + b

    def below(self, tweak: str, value: int, bound: int, back: bool = False, allowed=lambda x: True) -> int:
        """Permutes the allowed numbers below a bound, walking on while a number isn't one of them."""
        left = int(bound**0.5)
        left = max(2, left + (left * left < bound))
        right = max(2, -(-bound // left))
        while True:
            value = self.mix(f"{tweak}|{bound}", value, left, right, back)
            if value < bound and allowed(value):
                return value

    def digits(self, tweak: str, text: str, back: bool = False) -> str:
        n = len(text)
        return str(self.below(tweak, int(text), 10**n, back)).zfill(n) if n else text

    def characters(self, tweak: str, text: str, back: bool = False) -> str:
        """Letters and digits permuted as one number of mixed radix; the class of each place and other signs stay."""
        radix = [10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 1 for c in text]
        value, size = 0, 1
        for c, r in zip(text, radix):
            if r > 1:
                value = value * r + (int(c) if r == 10 else ord(c.lower()) - 97)
                size *= r
        if size == 1:
            return text
        shape = "".join("9" if r == 10 else "a" if r == 26 else c for c, r in zip(text, radix))
        value, out = self.below(f"{tweak}|{shape}", value, size, back), []
        for c, r in zip(reversed(text), reversed(radix)):
            if r == 1:
                out.append(c)
                continue
            value, d = divmod(value, r)
            out.append(str(d) if r == 10 else chr((65 if c.isupper() else 97) + d))
        return "".join(reversed(out))


def spaced(shape: str, digits: str) -> str:
    """digits put in the places of the digits of shape."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


class Pseudonyms:
    def __init__(self, key: bytes, back: bool = False):
        self.f, self.back = Feistel(key), back

    def email(self, s: str) -> str:
        local, _, domain = s.partition("@")
        return f"{self.f.characters('email', local, self.back)}@{domain}"

    def iban(self, s: str) -> str | None:
        bare = s.replace(" ", "")
        if not 15 <= len(bare) <= 34 or mod97(bare) != 1:
            return None
        account = self.f.characters(f"iban|{bare[:2]}", bare[4:], self.back)
        check = 98 - mod97(f"{bare[:2]}00{account}")
        it = iter(f"{bare[:2]}{check:02d}{account}")
        return "".join(c if c == " " else next(it) for c in s)

    def phone(self, s: str) -> str | None:
        s = s.replace("(0)", "(\0)")  # a trunk zero is no part of the number
        digits = re.sub(r"\D", "", s)
        if not 8 <= len(digits) <= next((n for code, n in LONGEST.items() if digits.startswith(code)), 15):
            return None
        code = next((n for n in (1, 2) if digits[:n] in COUNTRIES), 3)
        return spaced(s, digits[:code] + self.subscriber(digits[:code], digits[code:])).replace("\0", "0")

    def subscriber(self, country: str, digits: str) -> str:
        """A number inside its country. Whether its parts begin as the country's numbers do stays, so national forms stay such."""
        n = len(digits)
        starts = (lambda d: (d[0] > "1", d[3:4] > "1")) if country == "1" else (lambda d: d[0] > "0")
        alike = lambda x: starts(str(x).zfill(n)) == starts(digits)
        return str(self.f.below(f"phone|{country}", int(digits), 10**n, self.back, alike)).zfill(n)

    def national(self, s: str) -> str:
        """A number written without its country: ten digits of North America, or a zero and nine digits of France."""
        digits = re.sub(r"\D", "", s)
        return spaced(s, "0" + self.subscriber("33", digits[1:]) if digits[0] == "0" else self.subscriber("1", digits))

    def date(self, year: int, month: int, day: int) -> datetime.date | None:
        try:
            at = datetime.date(year, month, day).toordinal()
        except ValueError:
            return None
        if not FIRST_DAY <= at <= LAST_DAY:
            return None
        return datetime.date.fromordinal(FIRST_DAY + self.f.below("date", at - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, self.back))

    def iso(self, s: str) -> str | None:
        d = self.date(int(s[:4]), int(s[5:7]), int(s[8:]))
        return d and f"{d.year:04d}{s[4]}{d.month:02d}{s[4]}{d.day:02d}"

    def us(self, s: str) -> str | None:
        d = self.date(int(s[6:]), int(s[:2]), int(s[3:5]))
        return d and f"{d.month:02d}/{d.day:02d}/{d.year:04d}"

    def eu(self, s: str) -> str | None:
        d = self.date(int(s[6:]), int(s[3:5]), int(s[:2]))
        return d and f"{d.day:02d}.{d.month:02d}.{d.year:04d}"

    def ip(self, s: str) -> str | None:
        octets = s.split(".")
        if any(int(o) > 255 or o != str(int(o)) for o in octets):
            return None
        value = self.f.below("ip", int.from_bytes(bytes(map(int, octets)), "big"), 1 << 32, self.back)
        return ".".join(map(str, value.to_bytes(4, "big")))

    def ip6(self, s: str) -> str | None:
        """An address of at least four groups with a digit, permuted below its first group; written in the shortest form."""
        if sum(map(bool, s.split(":"))) < 4 or not re.search(r"\d", s):
            return None
        try:
            value = int.from_bytes(socket.inet_pton(socket.AF_INET6, s), "big")
        except OSError:
            return None
        top, low = divmod(value, 1 << 112)
        new = top << 112 | self.f.below(f"ip6|{top}", low, 1 << 112, self.back)
        return socket.inet_ntop(socket.AF_INET6, new.to_bytes(16, "big"))

    def ssn(self, s: str) -> str | None:
        valid = lambda n: n // 10**6 not in (0, 666) and n // 10**6 < 900 and n // 10**4 % 100 and n % 10**4
        n = int(s.replace("-", ""))
        return spaced(s, str(self.f.below("ssn", n, 10**9, self.back, valid)).zfill(9)) if valid(n) else None

    def card(self, s: str) -> str | None:
        digits = re.sub(r"\D", "", s)
        prefix = issuer(digits)
        if prefix is None or luhn(digits):
            return None
        body = prefix + self.f.digits(f"card|{prefix}", digits[len(prefix) : -1], self.back)
        return spaced(s, body + str(-luhn(body + "0") % 10))

    def replaced(self, text: str | None) -> tuple[str | None, list[tuple[str, str]]]:
        """The text with pseudonyms, and (kind, pseudonym) of each that was put in."""
        if not text or not _hint.search(text):
            return text, []
        found: list[tuple[str, str]] = []
        out, done, at = [], 0, 0
        while m := PATTERN.search(text, at):
            kind, start = INSIDE.get(m.lastgroup, m.lastgroup), m.start()
            # a pattern of spaced groups may have run into a number behind the value: the longest valid beginning counts
            ends = [m.end(), *(g.start() + start for g in reversed(list(_gap.finditer(m[0]))))] if kind in SPACED else [m.end()]
            made = next(((end, new) for end in ends if (new := getattr(self, kind)(text[start:end])) is not None), None)
            if made is None:
                at = _gap.search(text, start + 1, m.end()).end() if len(ends) > 1 else m.end()
                continue
            at, new = made
            found.append((NAMES.get(kind, kind), new))
            out += [text[done:start], new]
            done = at
        return "".join([*out, text[done:]]), found


def pseudonymised(docs: DataFrame, key: bytes, back: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_found, kinds, pseudonyms, text), one row per document.

    kinds is the kinds found with their counts, pseudonyms each value that was put in, in order, as kind:value. `back`
    inverts with the same key. A null text stays null and an empty one empty, with nothing found; other text is kept to
    the character. Extra columns are ignored; repeated rows repeat.
    """

    def make():
        names = Pseudonyms(key, back)

        def work(b):
            got = [names.replaced(t) for t in b["t"]]
            kinds = [Counter(k for k, _ in found) for _, found in got]
            return {
                "doc_id": b["i"],
                "n_found": [len(found) for _, found in got],
                "kinds": [",".join(f"{k}:{n}" for k, n in sorted(c.items())) for c in kinds],
                "pseudonyms": [[f"{k}:{v}" for k, v in found] for _, found in got],
                "text": [t for t, _ in got],
            }

        return work

    return map_rows(docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")), make, "doc_id long, n_found long, kinds string, pseudonyms array<string>, text string")
