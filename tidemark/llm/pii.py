"""Format-preserving pseudonyms of personal values: keyed Feistel permutations within each value's own format."""

from __future__ import annotations

import datetime
import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.workspace import session

ROUNDS = 8
#: Most values of a Permutation: either half of its numbers is then far narrower than a round's hash of 256 bits.
WIDEST = 1 << 256


class Permutation:
    """A keyed permutation of 0..n-1, n up to WIDEST, that leaves no number in place (n > 1).

    A Feistel network, a keyed turn, and the network backwards. Such a permutation leaves nothing in place, but all its
    cycles have one length (that of the turn): it is no random permutation, and only single values are hidden by it.
    """

    def __init__(self, key: bytes, tweak: str, n: int):
        if n > WIDEST:
            raise ValueError("a round's hash is narrower than half of that")
        self.n, self.side = n, isqrt(n - 1) + 1 if n > 1 else 1
        self.seed = hashlib.blake2b(f"{tweak}|{n}".encode(), key=key[:64], digest_size=32).digest()
        self.turn = 1 + int.from_bytes(self._hash(b"turn"), "big") % (n - 1) if n > 1 else 0

    def _hash(self, data: bytes) -> bytes:
        return hashlib.blake2b(data, key=self.seed, digest_size=32).digest()

    def _mix(self, x: int, forth: bool) -> int:
        side = self.side
        while True:
            a, b = divmod(x, side)
            for r in range(ROUNDS):
                if forth:
                    a, b = b, (a + int.from_bytes(self._hash(b"%d|%d" % (r, b)), "big")) % side
                else:
                    a, b = (b - int.from_bytes(self._hash(b"%d|%d" % (ROUNDS - 1 - r, a)), "big")) % side, a
            x = a * side + b
            if x < self.n:  # else walk on along the cycle
                return x

    def map(self, x: int, back: bool = False) -> int:
        if self.n < 2:
            return x
        return self._mix((self._mix(x, True) + (-self.turn if back else self.turn)) % self.n, False)


@lru_cache(maxsize=256)
def permutation(key: bytes, tweak: str, n: int) -> Permutation:
    return Permutation(key, tweak, n)


def permute_symbols(values: list[int], sizes: list[int], key: bytes, tweak: str, back: bool = False) -> list[int]:
    """Permutes numbers of mixed radix (each of at most 256 values where there are many): each place keeps its range."""
    x, n = 0, 1
    for v, s in zip(values, sizes, strict=True):
        x, n = x * s + v, n * s
        if n > WIDEST:
            return permute_long(values, sizes, key, tweak, back)
    x, out = permutation(key, f"{tweak}|{','.join(map(str, sizes))}", n).map(x, back), []
    for s in reversed(sizes):
        x, v = divmod(x, s)
        out.append(v)
    return out[::-1]


def permute_long(values: list[int], sizes: list[int], key: bytes, tweak: str, back: bool = False) -> list[int]:
    """As permute_symbols, for more combinations than one number holds: a Feistel network whose halves are the first and
    the second half of the places. A round adds to every place of one half, modulo its size, eight bytes of a stream
    that is as long as the half and depends on all of the other half; so work grows with the length."""
    size, x = np.array(sizes, dtype=np.uint64), np.array(values, dtype=np.uint64)
    seed = hashlib.blake2b(tweak.encode() + b"|long|" + size.astype(np.uint8).tobytes(), key=key[:64], digest_size=32).digest()
    halves = (slice(0, len(x) // 2), slice(len(x) // 2, len(x)))
    for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
        mine, other = halves[r % 2], halves[1 - r % 2]
        stream = hashlib.shake_256(seed + bytes([r]) + x[other].astype(np.uint8).tobytes()).digest(8 * (mine.stop - mine.start))
        add = np.frombuffer(stream, dtype="<u8") % size[mine]
        x[mine] = (x[mine] + (size[mine] - add if back else add)) % size[mine]
    return x.astype(np.int64).tolist()


def luhn(digits: str) -> int:
    """The check digit that follows `digits`."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _refill(value: str, old: Callable[[str], bool], new: str) -> str:
    """value with its characters that are `old`, in turn, replaced by those of `new`."""
    it = iter(new)
    return "".join(next(it) if old(c) else c for c in value)


def _digits(value: str) -> str:
    return "".join(c for c in value if c.isdigit())


def card(value: str, key: bytes, back: bool) -> str | None:
    d = _digits(value)
    if not 13 <= len(d) <= 19 or d[0] not in "23456" or int(d[-1]) != luhn(d[:-1]) or len(set(d)) == 1:
        return None
    body = d[0] + "".join(map(str, permute_symbols([int(c) for c in d[1:-1]], [10] * (len(d) - 2), key, "card" + d[0], back)))
    return _refill(value, str.isdigit, body + str(luhn(body)))


#: Least and most digits of a number after the country code, where the plan of the country is narrow.
NATIONAL = {"1": (10, 10), "7": (10, 10), "31": (9, 9), "32": (8, 9), "33": (9, 9), "34": (9, 9), "41": (9, 9), "44": (9, 10), "45": (8, 8), "46": (7, 9), "47": (8, 8), "48": (9, 9), "52": (10, 10), "55": (10, 11), "61": (9, 9), "81": (9, 10), "86": (10, 11), "91": (10, 10)}


def whole_phone(value: str) -> bool:
    """Whether the digits are as many as the country's numbers have, or stand in one piece."""
    code = re.match(r"\+(\d{1,3})(?=\D)", value)
    if not code:
        return bool(re.fullmatch(r"\+\d{8,15}", value))
    least, most = NATIONAL.get(code[1], (1, 0))
    return least <= len(_digits(value)) - len(code[1]) <= most


def phone(value: str, key: bytes, back: bool) -> str | None:
    d = _digits(value)
    code = ""
    if value.startswith("+"):
        code = re.match(r"\+(\d{1,3}?)(?=\D)", value)
        code = code[1] if code else d[:1]
    elif len(d) == 11 and d[0] == "1":
        code = "1"
    rest = d[len(code) :]
    if not 7 <= len(rest) <= 12 or len(set(rest)) == 1:
        return None
    lows = [2 if code in ("", "1") and len(rest) == 10 and k in (0, 3) and rest[k] >= "2" else 1 if k == 0 and rest[0] != "0" else 0 for k in range(len(rest))]
    tweak = "1" if len(rest) == 10 and not code else code  # a number with and without its 1 is the same one
    new = permute_symbols([int(c) - low for c, low in zip(rest, lows, strict=True)], [10 - low for low in lows], key, "phone" + tweak, back)
    return _refill(value, str.isdigit, code + "".join(str(v + low) for v, low in zip(new, lows, strict=True)))


def ssn(value: str, key: bytes, back: bool) -> str | None:
    area, group, serial = map(int, value.split("-"))
    if not (0 < area < 900 and area != 666 and group and serial):
        return None
    a, g, s = permute_symbols([area - 1 - (area > 666), group - 1, serial - 1], [898, 99, 9999], key, "ssn", back)
    return f"{a + 1 + (a + 1 >= 666):03d}-{g + 1:02d}-{s + 1:04d}"


def ipv4(value: str, key: bytes, back: bool) -> str | None:
    parts = value.split(".")
    octets = [int(p) for p in parts]
    if max(octets) > 255 or any(p != str(o) for p, o in zip(parts, octets, strict=True)) or octets[0] in (0, 127):
        return None
    if octets[0] > 223:  # multicast and reserved addresses stay such
        first, *rest = permute_symbols([octets[0] - 224, *octets[1:]], [32, 256, 256, 256], key, "ipv4 from 224", back)
        return ".".join(map(str, [first + 224, *rest]))
    first = octets[0] - 1 - (octets[0] > 127)
    first, *rest = permute_symbols([first, *octets[1:]], [222, 256, 256, 256], key, "ipv4", back)
    return ".".join(map(str, [first + 1 + (first + 1 >= 127), *rest]))


#: Pseudonyms of dates stay within these days.
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def date(value: str, key: bytes, back: bool) -> str | None:
    a, sep, b, _, c = re.split(r"([-/.])", value)
    year_first = len(a) == 4
    y, m, d = (a, b, c) if year_first else (c, b, a)
    swapped = False
    if not year_first and sep == "/" and int(m) > 12 >= int(d):
        m, d, swapped = d, m, True
    try:
        day = datetime.date(int(y), int(m), int(d)).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    # the day decides the way it can be read back, so days up to the 12th of a month stay such days where it could not
    p = permutation(key, f"date{swapped}", LAST_DAY - FIRST_DAY + 1)
    new = p.map(day - FIRST_DAY, back)
    while swapped and datetime.date.fromordinal(new + FIRST_DAY).day <= 12:
        new = p.map(new, back)
    t = datetime.date.fromordinal(new + FIRST_DAY)
    y, m, d = f"{t.year:04d}", f"{t.month:02d}", f"{t.day:02d}"
    return sep.join((y, m, d) if year_first else (m, d, y) if swapped else (d, m, y))


def iban(value: str, key: bytes, back: bool) -> str | None:
    plain = value.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = _letters(plain[4:], key, "iban" + plain[:2], back)
    check = 98 - number(body + plain[:2] + "00") % 97
    return _refill(value, lambda c: c != " ", f"{plain[:2]}{check:02d}{body}")


def _letters(value: str, key: bytes, tweak: str, back: bool) -> str:
    """Digits stay digits, ASCII letters stay letters of their case, all else stays."""
    kinds = [("0", 10) if c in "0123456789" else ("a", 26) if "a" <= c <= "z" else ("A", 26) if "A" <= c <= "Z" else None for c in value]
    new = iter(permute_symbols([ord(c) - ord(k[0]) for c, k in zip(value, kinds, strict=True) if k], [k[1] for k in kinds if k], key, tweak, back))
    return "".join(chr(ord(k[0]) + next(new)) if k else c for c, k in zip(value, kinds, strict=True))


def email(value: str, key: bytes, back: bool) -> str | None:
    name, host = value.rsplit("@", 1)
    if ".." in name or ".." in host:
        return None
    return _letters(name, key, "email" + host.lower(), back) + "@" + host


def secret(value: str, key: bytes, back: bool) -> str | None:
    if re.fullmatch(r"[0-9a-f]+", value):
        return "".join("0123456789abcdef"[v] for v in permute_symbols([int(c, 16) for c in value], [16] * len(value), key, "secret", back))
    if len(value) >= 32 and re.fullmatch(r"[0-9A-Fa-f]+", value):
        if value == value.upper():
            return secret(value.lower(), key, back).upper()
        kinds = [("0", 10) if c.isdigit() else ("a", 6) if c >= "a" else ("A", 6) for c in value]
        new = permute_symbols([ord(c) - ord(k) for c, (k, _) in zip(value, kinds, strict=True)], [n for _, n in kinds], key, "secret", back)
        return "".join(chr(ord(k) + v) for v, (k, _) in zip(new, kinds, strict=True))
    return _letters(value, key, "secret", back)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    change: Callable[[str, bytes, bool], str | None]
    #: Of several ends at group borders, those for which this holds are tried first.
    whole: Callable[[str], bool] | None = None


#: In order: where several could begin at one place, the first that validates is taken. Cards in one piece or in the
#: groups they are embossed with come before all other numbers, cards in other groups after them.
KINDS = (
    Kind("email", r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,63})@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}(?![A-Za-z0-9])", email),
    Kind("secret", r"(?:(?<=password=)|(?<=passwd=)|(?<=secret=)|(?<=token=)|(?<=api_key=)|(?<=apikey=))[A-Za-z0-9_+/=.-]{8,}(?<![.=])", secret),
    Kind("secret", r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9])", lambda v, k, b: v[:4] + secret(v[4:], k, b)),
    Kind("secret", r"(?<![A-Za-z0-9])(?=[0-9A-Fa-f]*[A-Fa-f])(?=[0-9A-Fa-f]*[0-9])[0-9A-Fa-f]{32,64}(?![A-Za-z0-9])", secret),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", iban),
    Kind("date", r"(?<![0-9./-])(?:[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\2[0-9]{4})(?![0-9]|[./-][0-9])", date),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", ssn),
    Kind("ip", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])", ipv4),
    Kind("card", r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5})(?![0-9])", card),
    Kind("phone", r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)(?:\([0-9]{2,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])", phone, whole_phone),
    Kind("phone", r"(?<![0-9A-Za-z(])(?:1[ .-])?(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![0-9])", phone),
    Kind("card", r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])", card),
)
#: A text without these holds none of the kinds.
TRACE = re.compile(r"[0-9@]|passw|secret=|token=|api_?key=|AKIA|gh[pousr]_")
_COMPILED = tuple((k, re.compile(k.pattern)) for k in KINDS)


def _ends(text: str, pattern: re.Pattern, start: int, end: int, limit: int, whole: Callable[[str], bool] | None) -> Iterator[int]:
    """Where a value that begins at `start` may end: at `end` or at a group border before it, up to `limit`, longest
    first; those that are `whole` come before all others (the kinds that tell have short spans)."""

    def ends() -> Iterator[int]:
        if end <= limit:
            yield end
        for p in range(min(end, limit + 1) - 1, start, -1):
            if text[p - 1].isalnum() and not text[p].isalnum() and (m := pattern.match(text, start, p)) and m.end() == p:
                yield p

    return ends() if whole is None else iter(sorted(ends(), key=lambda p: not whole(text[start:p])))


def find(text: str, key: bytes, back: bool = False) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, pseudonym) of the personal values of a whole text, in order and without overlaps.

    Where a span fails its validation or overlaps a value found before, its shorter spans up to a group border are tried,
    then those that begin later."""
    if not TRACE.search(text):
        return []
    found, taken = [], []  # taken: by start
    for kind, pattern in _COMPILED:
        at, mine = 0, []
        while m := pattern.search(text, at):
            start, at = m.start(), m.start() + 1
            k = bisect_right(taken, (start, len(text)))
            if k and taken[k - 1][1] > start:
                at = taken[k - 1][1]
                continue
            limit = taken[k][0] if k < len(taken) else len(text)
            for end in _ends(text, pattern, start, m.end(), limit, kind.whole):
                new = kind.change(text[start:end], key, back)
                if new is not None and new != text[start:end]:
                    mine.append((start, end))
                    found.append((kind.name, start, end, new))
                    at = end
                    break
        taken = sorted(taken + mine)
    return sorted(found, key=lambda f: f[1])


def replaced(text: str, found: list[tuple[str, int, int, str]]) -> str:
    out, at = [], 0
    for _, start, end, new in found:
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]])


def pseudonymise(df: DataFrame, secret_key: bytes, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, text (with pseudonyms), n_found, found (kind, start, end, pseudonym), and `keep`.

    E-mail addresses, card numbers (Luhn), IBANs (mod 97), social security and phone numbers, IPv4 addresses, dates
    (calendar) and secrets are each mapped by a permutation that depends on the key and their format alone, so equal
    values stay equal across documents and different ones different. Secrets of any length are changed as a whole, in
    time that grows with their length. What fails its validation is left alone. start and
    end count characters of the original. Null texts stay null with nothing found; empty texts, repeated rows and null
    ids are kept; an empty table gives an empty result.
    """
    session(df)
    cols = [F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("_t"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]]
    kept = df.select(*cols)
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("pseudonym", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, lists = [], [], []
            for x in batch.column(1):
                t = x.as_py()
                found = find(t, secret_key) if t else []
                texts.append(replaced(t, found) if found else t)
                counts.append(len(found))
                lists.append([{"kind": k, "start": s, "end": e, "pseudonym": p} for k, s, e, p in found])
            names = ["doc_id", "text", "n_found", "found", *[f"_k{i}" for i in range(len(keep))]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32()), pa.array(lists, spans), *batch.columns[2:]], names)

    extra = "".join(f", _k{i} {kept.schema[f'_k{i}'].dataType.simpleString()}" for i in range(len(keep)))
    out = kept.mapInArrow(run, "doc_id long, text string, n_found int, found array<struct<kind:string,start:int,end:int,pseudonym:string>>" + extra)
    return out.select("doc_id", "text", "n_found", "found", *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)])
