"""Format-preserving pseudonyms for personal numbers, dates and addresses.

Candidates are found by format and validated (card numbers by Luhn, IBANs by mod 97, dates by the calendar, IPv4 octets,
North American and international phone numbers, social security numbers, e-mail addresses). The free characters of a value are read as one
mixed-radix number below N and moved by a keyed Feistel permutation of 0..N-1 (cycle walking keeps it inside); check
digits are computed anew. A day has one pseudonym in all date formats, an address one in any case. So a pseudonym is again a valid value of its format, equal values have equal pseudonyms in
all documents, different ones different pseudonyms, and the key's holder can reverse them. No value maps to itself:
the permutation is a rotation conjugated by the Feistel network.

Rows are independent (no shuffle). Defined cases: null stays null, texts without a valid value stay as they are, texts of any length are
read whole, repeated rows give equal results, an empty table gives an empty one. Numbers that fail validation are not touched.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "iban", "ip", "ssn", "date", "phone", "card")
ROUNDS = 10

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
FORMATS = re.compile("|".join((
    r"(?P<email>(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24})",
    r"(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9]))",
    rf"(?P<ip>(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9]))",
    r"(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))",
    r"(?P<date>(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9]|[./-][0-9]))",
    r"(?P<phone>(?:(?<![0-9+])\+?1[ .-]?|(?<![0-9+]))(?:\([0-9]{3}\) ?[0-9]{3}|[2-9][0-9]{2}[ .-][2-9][0-9]{2})[ .-][0-9]{4}(?![0-9])"
    r"|(?<![0-9+])\+[1-9][0-9]{0,2}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9]))",
    r"(?P<card>(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9]))",
)))
_FIRST, _LAST = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()
# Days up to the 12th and later ones are moved among themselves, so a date in any order of day and month stays readable in it
_DAYS = [[d for d in range(_FIRST, _LAST + 1) if (date.fromordinal(d).day > 12) == late] for late in (False, True)]
_RANK = [{d: i for i, d in enumerate(days)} for days in _DAYS]


class Permutation:
    """Keyed permutations of 0..n-1, one for each tweak."""

    def __init__(self, key: bytes, reverse: bool = False):
        self.key, self.reverse = key, reverse

    def _f(self, tweak: bytes, i: int, x: int, half: int) -> int:
        h = hashlib.blake2b(b"%s|%d|%d" % (tweak, i, x), key=self.key, digest_size=max(8, half // 8 + 8))
        return int.from_bytes(h.digest(), "big") & ((1 << half) - 1)

    def _walk(self, x: int, n: int, tweak: bytes, back: bool) -> int:
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        while True:
            a, b = x >> half, x & mask
            for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
                a, b = (b ^ self._f(tweak, i, a, half), a) if back else (b, a ^ self._f(tweak, i, b, half))
            x = a << half | b
            if x < n:
                return x

    def __call__(self, x: int, n: int, tweak: str) -> int:
        if n < 2:
            return x
        t = b"%s|%d" % (tweak.encode(), n)
        step = 1 + self._f(t, ROUNDS, 0, 60) % (n - 1)
        y = self._walk(x, n, t, back=False)
        return self._walk((y - step if self.reverse else y + step) % n, n, t, back=True)

    def digits(self, values: list[int], radices: list[int], tweak: str) -> list[int]:
        """Mixed-radix digits moved as one number."""
        x, n = 0, 1
        for v, r in zip(values, radices):
            x, n = x * r + v, n * r
        x = self(x, n, tweak)
        out = []
        for r in reversed(radices):
            x, v = divmod(x, r)
            out.append(v)
        return out[::-1]


def _put(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in shape)


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _luhn(digits: str) -> int:
    """Luhn sum modulo 10 of a number with its check digit (0: valid)."""
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10


def _characters(s: str, p: Permutation, tweak: str) -> str:
    """Letters and digits moved within their class, other signs kept."""
    base = [next((b for b in "aA0" if b <= c <= chr(ord(b) + (9 if b == "0" else 25))), "") for c in s]
    at = [i for i, b in enumerate(base) if b]
    moved = p.digits([ord(s[i]) - ord(base[i]) for i in at], [10 if base[i] == "0" else 26 for i in at],
                     f"{tweak}|" + "".join(b or c for b, c in zip(base, s)))
    out = list(s)
    for i, v in zip(at, moved):
        out[i] = chr(ord(base[i]) + v)
    return "".join(out)


def _mod97(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s)) % 97


def _email(v: str, p: Permutation) -> tuple[str, int]:
    local, _, domain = v.partition("@")  # case makes no other address: the lower-cased name is moved and gets the case again
    new = _characters(local.lower(), p, "email")
    return "".join(n.upper() if o.isupper() else n for o, n in zip(local, new)) + f"@{domain}", len(v)


def _iban(v: str, p: Permutation) -> tuple[str, int] | None:
    ends = [i + 1 for i in range(len(v)) if i + 1 == len(v) or v[i + 1] == " "]
    for end in reversed(ends):
        s = v[:end].replace(" ", "")
        if len(s) >= 15 and _mod97(s[4:] + s[:4]) == 1:
            body = _characters(s[4:], p, "iban|" + s[:2])
            full = iter(f"{s[:2]}{98 - _mod97(body + s[:2] + '00'):02d}{body}")
            return "".join(c if c == " " else next(full) for c in v[:end]), end
    return None


def _ip(v: str, p: Permutation) -> tuple[str, int]:
    return ".".join(map(str, p.digits([int(x) for x in v.split(".")], [256] * 4, "ip"))), len(v)


def _ssn(v: str, p: Permutation) -> tuple[str, int] | None:
    a, g, n = int(v[:3]), int(v[4:6]), int(v[7:])
    if not (0 < a < 900 and a != 666 and g and n):
        return None
    a, g, n = p.digits([a - 1 - (a > 666), g - 1, n - 1], [898, 99, 9999], "ssn")
    return f"{a + 1 + (a >= 665):03d}-{g + 1:02d}-{n + 1:04d}", len(v)


def _date(v: str, p: Permutation) -> tuple[str, int] | None:
    def day(y: str, m: str, d: str) -> int | None:
        try:
            n = date(int(y), int(m), int(d)).toordinal()
        except ValueError:
            return None
        return n if _FIRST <= n <= _LAST else None

    def moved(n: int) -> date:
        late = date.fromordinal(n).day > 12
        return date.fromordinal(_DAYS[late][p(_RANK[late][n], len(_DAYS[late]), f"date|{late}")])

    if v[4] == "-":
        n = day(v[:4], v[5:7], v[8:])
        return None if n is None else (f"{moved(n):%Y-%m-%d}", len(v))
    if v[2] == ".":
        n = day(v[6:], v[3:5], v[:2])
        return None if n is None else (f"{moved(n):%d.%m.%Y}", len(v))
    if (n := day(v[6:], v[:2], v[3:5])) is not None:
        return f"{moved(n):%m/%d/%Y}", len(v)
    n = day(v[6:], v[3:5], v[:2])  # day first: only days after the 12th are read so
    return None if n is None else (f"{moved(n):%d/%m/%Y}", len(v))


def _phone(v: str, p: Permutation) -> tuple[str, int] | None:
    ds = _only_digits(v)
    if len(ds) in (10, 11) and (len(ds) == 10 or ds[0] == "1"):  # ten digits after the country code 1
        head, ten = ds[:-10], ds[-10:]
        low = [0 if c < "2" else 200 for c in (ten[0], ten[3])]  # codes from 200 up stay there, others below
        size = [800 if x else 200 for x in low]
        a, e, n = p.digits([int(ten[:3]) - low[0], int(ten[3:6]) - low[1], int(ten[6:])], [*size, 10_000],
                           f"phone|{low}")
        return _put(v, f"{head}{a + low[0]:03d}{e + low[1]:03d}{n:04d}"), len(v)
    if v[0] != "+" or not 8 <= len(ds) <= 15:
        return None
    keep = 3  # the longest country code stays, so that the country does
    return _put(v, ds[:keep] + "".join(map(str, p.digits([int(c) for c in ds[keep:]], [10] * (len(ds) - keep),
                                                         f"phone|{ds[:keep]}")))), len(v)


def _card(v: str, p: Permutation) -> tuple[str, int] | None:
    ends = [i + 1 for i in range(len(v)) if i + 1 == len(v) or not v[i + 1].isdigit()]
    for end in reversed(ends):
        ds = _only_digits(v[:end])
        if v[end - 1].isdigit() and 13 <= len(ds) <= 19 and _luhn(ds) == 0:
            body = ds[0] + "".join(map(str, p.digits([int(c) for c in ds[1:-1]], [10] * (len(ds) - 2), f"card|{ds[0]}")))
            return _put(v[:end], f"{body}{-_luhn(body + '0') % 10}"), end
    return None


_MOVE = {"email": _email, "iban": _iban, "ip": _ip, "ssn": _ssn, "date": _date, "phone": _phone, "card": _card}
_ANY = re.compile(r"[0-9@]")


def pseudonymise(text: str | None, p: Permutation) -> tuple[str | None, Counter]:
    """The text with every valid value replaced, and how many of each kind."""
    found: Counter = Counter()
    if not text or not _ANY.search(text):
        return text, found
    out, done, at = [], 0, 0
    while m := FORMATS.search(text, at):
        got = _MOVE[m.lastgroup](m.group(), p)
        if got is None:  # not valid: something else may begin inside
            at = m.start() + 1
            continue
        new, n = got
        found[m.lastgroup] += 1
        out += [text[done:m.start()], new]
        done = at = m.start() + n
    return "".join([*out, text[done:]]), found


def pseudonyms(text: Column, key: bytes, reverse: bool = False) -> Column:
    """A struct: ``text`` and a count ``n_<kind>`` for each kind."""
    @F.pandas_udf("text string, " + ", ".join(f"n_{k} int" for k in KINDS))
    def udf(s: pd.Series) -> pd.DataFrame:
        p = Permutation(key, reverse)
        rows = [(t, *(n[k] for k in KINDS)) for t, n in (pseudonymise(t, p) for t in s)]
        return pd.DataFrame(rows, columns=["text", *(f"n_{k}" for k in KINDS)])
    return udf(text)


def hide_private(docs: DataFrame, key: bytes, *, text: str = "text") -> DataFrame:
    """``docs`` with the values in ``text`` replaced; all columns kept, in order."""
    return docs.withColumn(text, pseudonyms(F.col(text), key)["text"])
