"""Personal data replaced by format-preserving Feistel pseudonyms.

A value is read as an integer of its format's domain (all valid card numbers of 16 digits, all
days of 1900 to 2099, ...), permuted by a keyed Feistel network over exactly that domain and
written in the form in which it stood. Equal values thus get equal pseudonyms in every
document, distinct values stay distinct, and pseudonyms pass the validity checks that the
values passed. The key holder can invert it.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from datetime import date, timedelta
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, text_array

ROUNDS = 8


def _round(key: bytes, tag: str, n: int, i: int, half: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{tag}|{n}|{i}|{half}".encode(), key=key, digest_size=16).digest(), "big")


def feistel(x: int, n: int, key: bytes, tag: str, back: bool = False) -> int:
    """A keyed permutation of range(n): a Feistel network over a * b >= n cells, walked on until inside."""
    if n < 2:
        return x
    a = isqrt(n - 1) + 1
    b = -(-n // a)
    while True:
        left, right = divmod(x, b)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2:
                right = (right + sign * _round(key, tag, n, i, left)) % b
            else:
                left = (left + sign * _round(key, tag, n, i, right)) % a
        x = left * b + right
        if x < n:
            return x


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def iban_check(country: str, account: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97


def _into(form: str, digits: str) -> str:
    """The digits put in place of those of ``form``."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in form)


class Pseudonyms:
    """The permutation of each kind of value. Each method takes the matched text; None: not valid, leave it."""

    def __init__(self, key: bytes, back: bool = False):
        self.key, self.back = hashlib.sha256(key).digest(), back

    def permute(self, x: int, n: int, tag: str) -> int:
        return feistel(x, n, self.key, tag, self.back)

    def chars(self, text: str, tag: str) -> str:
        """Letters and digits permuted together, each place within its own alphabet."""
        sets = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")
        places = [next((s for s in sets if c in s), None) for c in text]
        x, n = 0, 1
        for c, s in zip(text, places):
            if s:
                x, n = x * len(s) + s.index(c), n * len(s)
        x, out = self.permute(x, n, tag + re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", text)))), []
        for c, s in zip(reversed(text), reversed(places)):
            if s:
                x, k = divmod(x, len(s))
                c = s[k]
            out.append(c)
        return "".join(reversed(out))

    def email(self, m: re.Match) -> str | None:
        local, _, domain = m[0].partition("@")
        return f"{self.chars(local, 'email:' + domain.lower() + ':')}@{domain}"

    def card(self, m: re.Match) -> str | None:
        digits = re.sub(r"\D", "", m[0])
        if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
            return None
        k = len(digits) - 1
        payload = f"{self.permute(int(digits[:-1]), 10**k, 'card'):0{k}d}"
        return _into(m[0], payload + luhn_digit(payload))

    def phone(self, m: re.Match) -> str | None:
        digits = re.sub(r"\D", "", m[0])
        code = len(re.match(r"\+?(\d*)", m[0])[1]) if m[0].startswith("+") else 0
        own = digits[code:]
        if not 7 <= len(own) <= 12:
            return None
        return _into(m[0], digits[:code] + f"{self.permute(int(own), 10 ** len(own), 'phone'):0{len(own)}d}")

    def ip(self, m: re.Match) -> str | None:
        parts = [int(p) for p in m[0].split(".")]
        if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in m[0].split(".")):
            return None
        x = self.permute(int.from_bytes(bytes(parts), "big"), 2**32, "ip")
        return ".".join(str(p) for p in x.to_bytes(4, "big"))

    def ssn(self, m: re.Match) -> str | None:
        area, group, serial = (int(p) for p in m[0].split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        x, serial = divmod(self.permute(x, 898 * 99 * 9999, "ssn"), 9999)
        area, group = divmod(x, 99)
        area += 1 + (area + 1 >= 666)
        return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"

    def iban(self, m: re.Match) -> str | None:
        plain = m[0].replace(" ", "")
        country, check, account = plain[:2], plain[2:4], plain[4:]
        if not 15 <= len(plain) <= 34 or iban_check(country, account) != int(check):
            return None
        account = self.chars(account, "iban" + country)
        it = iter(f"{country}{iban_check(country, account):02d}{account}")
        return "".join(c if c == " " else next(it) for c in m[0])

    FIRST = date(1900, 1, 1)
    #: Days of 1900 to 2099, and those that only a month-first reading can mean.
    DAYS = range((date(2100, 1, 1) - FIRST).days)
    LATE = [i for i in DAYS if (date(1900, 1, 1) + timedelta(i)).day > 12]

    def day(self, m: re.Match) -> str | None:
        """Year first, day first, or month first where day first is no date; the form and its order stay."""
        parts = re.findall(r"\d+", m[0])
        orders = [((2, 1, 0), self.DAYS)] if len(parts[0]) == 4 else [((0, 1, 2), self.DAYS), ((1, 0, 2), self.LATE)]
        for order, days in orders:  # places of day, month and year
            try:
                k = (date(*(int(parts[i]) for i in reversed(order))) - self.FIRST).days
            except ValueError:
                continue
            if k not in self.DAYS:
                continue
            at = k if days is self.DAYS else bisect_left(days, k)
            new = self.FIRST + timedelta(days[self.permute(at, len(days), "day" if days is self.DAYS else "late day")])
            for i, v in zip(order, (f"{new.day:02d}", f"{new.month:02d}", f"{new.year:04d}")):
                parts[i] = v
            it = iter(parts)
            return re.sub(r"\d+", lambda _: next(it), m[0])
        return None

    def secret(self, m: re.Match) -> str | None:
        word = m[0]
        if not re.search(r"\d", word) or not re.search(r"[a-fA-F]", word):
            return None
        n = 16 ** len(word)
        out = f"{self.permute(int(word, 16), n, f'hex{len(word)}'):0{len(word)}x}"
        return out.upper() if word.upper() == word else out


#: Kinds in the order in which they are tried at a place; a kind that doesn't validate leaves it to the next.
KINDS = {
    "email": r"[A-Za-z0-9._%+\-]{1,64}@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])",
    "card": r"(?<![\w.+\-])\d(?:[ \-]?\d){12,18}(?![\w]|[.\-]\d)",
    "ip": r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d)",
    "day": r"(?<![\w./\-])(?:\d{4}([./\-])\d{2}\1\d{2}|\d{2}([./\-])\d{2}\2\d{4})(?!\w|[./\-]\d)",
    "ssn": r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .\-]?)(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]\d{2,4}){1,4}(?!\w)|(?<![\w+(])\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\w)|(?<![\w+\-.])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\w\-])|(?<![\w+])\+\d{9,15}(?!\w)",
}
_PATTERNS = {k: re.compile(v, re.ASCII) for k, v in KINDS.items()}
_HINT = re.compile(r"[0-9@]")


def pseudonymise(text: str, key: bytes, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with all valid values replaced, and their numbers by kind. No place is replaced twice."""
    counts = dict.fromkeys(KINDS, 0)
    if not _HINT.search(text):
        return text, counts
    names, spans = Pseudonyms(key, back), []
    for kind, pattern in _PATTERNS.items():
        if kind == "email" and "@" not in text:
            continue
        # finds come in order, as the spans of earlier kinds stand: one walk along both
        found, k = [], 0
        for m in pattern.finditer(text):
            while k < len(spans) and spans[k][1] <= m.start():
                k += 1
            if k < len(spans) and spans[k][0] < m.end():
                continue
            new = getattr(names, kind)(m)
            if new is not None:
                found.append((m.start(), m.end(), new))
                counts[kind] += 1
        spans = sorted(spans + found)
    out, at = [], 0
    for s, e, new in spans:
        out += [text[at:s], new]
        at = e
    return "".join([*out, text[at:]]), counts


#: The Spark setting that holds the key.
KEY_SETTING = "spark.pseudonyms.key"


def key_of(spark: SparkSession, default: bytes | None = None) -> bytes:
    """The secret key of the session, from its setting KEY_SETTING. Without one, and without a default, nothing runs."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key and not default:
        raise ValueError(f"set {KEY_SETTING}, or give a key: whoever knows it can read the values again")
    return key.encode() if key else default


def pseudonymise_docs(docs: DataFrame, key: bytes | None = None, text_col: str = "text", counts: bool = False, back: bool = False) -> DataFrame:
    """``docs`` with the text column pseudonymised, all other columns as they are; no shuffle.

    With ``counts`` a column ``pii`` (map of kind to number) is added, or replaces one of that
    name. Without ``key`` the session's setting is used. Null texts stay null, empty ones empty;
    overlapping finds go to the first kind of KINDS; repeated rows are replaced alike; an empty
    table gives an empty result.
    """
    key = key or key_of(docs.sparkSession)
    field = docs.schema[text_col]
    kept = [f for f in docs.schema.fields if not (counts and f.name == "pii")]
    source = docs.select(*[F.col(f"`{f.name}`") for f in kept])
    schema = T.StructType([*kept, T.StructField("pii", T.MapType(T.StringType(), T.IntegerType()))] if counts else kept)
    place = [f.name for f in kept].index(field.name)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            done = [(None, dict.fromkeys(KINDS, 0)) if t is None else pseudonymise(t, key, back) for t in texts]
            columns = list(batch.columns)
            columns[place] = pa.array([d[0] for d in done], batch.column(place).type)
            names = list(batch.schema.names)
            if counts:
                columns.append(pa.array([list(d[1].items()) for d in done], pa.map_(pa.string(), pa.int32())))
                names.append("pii")
            yield pa.RecordBatch.from_arrays(columns, names)

    return source.mapInArrow(lean(replace), schema)
