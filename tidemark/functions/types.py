"""Types of keys, values and results, with their Spark forms, encoded lengths and canonical key bytes.

U64 is DECIMAL(20,0): Spark has no unsigned BIGINT. Unit has no column.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64_MAX = (1 << 64) - 1
I64_MIN, I64_MAX = -(1 << 63), (1 << 63) - 1
MAX_DEPTH, MAX_FIELDS, MAX_ROWS, MAX_KEY_BYTES = 16, 256, 65_535, 1024


class Invalid(ValueError):
    """A type, value, program or argument that is refused before anything is sequenced."""


@dataclass(frozen=True)
class Type:
    """kind: unit, bool, i64, u64, bytes, string, tuple or rows. bound: of bytes and strings in bytes, of rows in rows."""

    kind: str
    bound: int = 0
    fields: tuple[Type, ...] = ()

    def __post_init__(self):
        if self.kind not in ("unit", "bool", "i64", "u64", "bytes", "string", "tuple", "rows"):
            raise Invalid(f"no type {self.kind}")
        if self.kind == "tuple" and len(self.fields) > MAX_FIELDS:
            raise Invalid("too many fields")
        if self.kind == "rows" and (len(self.fields) != 2 or not 0 <= self.bound <= MAX_ROWS):
            raise Invalid("rows have a key, a value and at most 65,535 rows")
        if any(f.kind == "rows" for f in self.fields):
            raise Invalid("rows can't be nested")
        if self.depth() > MAX_DEPTH:
            raise Invalid("nested too deep")

    def depth(self) -> int:
        return 1 + max((f.depth() for f in self.fields), default=0)

    def same_shape(self, other: Type) -> bool:
        """Equal but for the bounds of bytes, strings and rows."""
        return self.kind == other.kind and len(self.fields) == len(other.fields) and all(a.same_shape(b) for a, b in zip(self.fields, other.fields, strict=True))

    def to_json(self) -> str:
        plain = lambda t: {"kind": t.kind, "bound": t.bound, "fields": [plain(f) for f in t.fields]}
        return json.dumps(plain(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Type:
        build = lambda d: Type(d["kind"], d["bound"], tuple(build(f) for f in d["fields"]))
        return build(json.loads(text))

    def spark(self) -> T.DataType:
        simple = {"bool": T.BooleanType(), "i64": T.LongType(), "u64": T.DecimalType(20, 0), "bytes": T.BinaryType(), "string": T.StringType()}
        if self.kind in simple:
            return simple[self.kind]
        if self.kind == "tuple":
            return T.StructType([T.StructField(f"_{k}", f.spark(), False) for k, f in enumerate(self.fields)])
        if self.kind == "rows":
            return T.ArrayType(T.StructType([T.StructField("key", self.fields[0].spark(), False), T.StructField("value", self.fields[1].spark(), False)]), False)
        raise Invalid("unit has no column")


UNIT, BOOL, I64, U64 = Type("unit"), Type("bool"), Type("i64"), Type("u64")


def Bytes(n: int) -> Type:  # noqa: N802
    return Type("bytes", n)


def String(n: int) -> Type:  # noqa: N802
    return Type("string", n)


def Tuple(*fields: Type) -> Type:  # noqa: N802
    return Type("tuple", 0, fields)


def Rows(key: Type, value: Type, n: int) -> Type:  # noqa: N802
    return Type("rows", n, (key, value))


def fits(value, t: Type) -> bool:
    """Whether a Python value is of the type, bounds included."""
    k = t.kind
    if k == "unit":
        return value is None
    if k == "bool":
        return isinstance(value, bool)
    if k in ("i64", "u64"):
        return isinstance(value, int) and not isinstance(value, bool) and (I64_MIN <= value <= I64_MAX if k == "i64" else 0 <= value <= U64_MAX)
    if k == "bytes":
        return isinstance(value, bytes) and len(value) <= t.bound
    if k == "string":
        return isinstance(value, str) and len(value.encode()) <= t.bound
    if k == "tuple":
        return isinstance(value, tuple) and len(value) == len(t.fields) and all(fits(v, f) for v, f in zip(value, t.fields, strict=True))
    return isinstance(value, list) and len(value) <= t.bound and all(fits(a, t.fields[0]) and fits(b, t.fields[1]) for a, b in value)


def encoded_len(value, t: Type) -> int:
    """Bytes that a value counts for against limits."""
    k = t.kind
    if k == "unit":
        return 0
    if k == "bool":
        return 1
    if k in ("i64", "u64"):
        return 8
    if k == "bytes":
        return 4 + len(value)
    if k == "string":
        return 4 + len(value.encode())
    if k == "tuple":
        return sum(encoded_len(v, f) for v, f in zip(value, t.fields, strict=True))
    return 4 + sum(encoded_len(a, t.fields[0]) + encoded_len(b, t.fields[1]) for a, b in value)


def encoded_len_column(c: Column, t: Type) -> Column:
    """encoded_len as a BIGINT column."""
    k = t.kind
    if k in ("unit", "bool", "i64", "u64"):
        return F.lit({"unit": 0, "bool": 1}.get(k, 8)).cast("bigint")
    if k in ("bytes", "string"):
        return (F.octet_length(c) + 4).cast("bigint")
    if k == "tuple":
        total = F.lit(0).cast("bigint")
        for i, f in enumerate(t.fields):
            total = total + encoded_len_column(c[f"_{i}"], f)
        return total
    each = lambda s, e: s + encoded_len_column(e["key"], t.fields[0]) + encoded_len_column(e["value"], t.fields[1])
    return F.aggregate(c, F.lit(4).cast("bigint"), each)


def key_bytes(value, t: Type) -> bytes:
    """The canonical key: bytes whose unsigned order is the order of the values."""
    k = t.kind
    if k == "unit":
        return b""
    if k == "bool":
        return b"\x01" if value else b"\x00"
    if k == "i64":
        return (value + (1 << 63)).to_bytes(8, "big")
    if k == "u64":
        return value.to_bytes(8, "big")
    if k in ("bytes", "string"):
        raw = value if k == "bytes" else value.encode()
        return raw.replace(b"\x00", b"\x00\xff") + b"\x00\x00"
    if k == "tuple":
        return b"".join(key_bytes(v, f) for v, f in zip(value, t.fields, strict=True))
    raise Invalid("rows are no key")


def bit_pattern(c: Column) -> Column:
    """A U64 column (DECIMAL(20,0)) as the BIGINT of the same 64 bits."""
    over = F.lit(Decimal(1 << 64)).cast("decimal(21,0)")
    return F.when(c > F.lit(Decimal(I64_MAX)).cast("decimal(20,0)"), c.cast("decimal(21,0)") - over).otherwise(c).cast("bigint")


def from_bit_pattern(c: Column) -> Column:
    """The U64 of a BIGINT's 64 bits."""
    d = c.cast("decimal(21,0)")
    return F.when(c < 0, d + F.lit(Decimal(1 << 64)).cast("decimal(21,0)")).otherwise(d).cast("decimal(20,0)")


def key_hex_column(c: Column, t: Type) -> Column:
    """The canonical key in upper-case hexadecimal, which sorts as the bytes do."""
    k = t.kind
    wide = lambda x: F.lpad(F.hex(x), 16, "0")
    if k == "bool":
        return F.when(c, F.lit("01")).otherwise(F.lit("00"))
    if k == "i64":
        return wide(c.bitwiseXOR(F.lit(I64_MIN)))
    if k == "u64":
        return wide(bit_pattern(c))
    if k in ("bytes", "string"):
        pairs = F.regexp_extract_all(F.hex(c.cast("binary")), F.lit("([0-9A-F]{2})"), F.lit(1))
        return F.concat(F.array_join(F.transform(pairs, lambda h: F.when(h == "00", F.lit("00FF")).otherwise(h)), ""), F.lit("0000"))
    if k == "tuple":
        return F.concat(*[key_hex_column(c[f"_{i}"], f) for i, f in enumerate(t.fields)]) if t.fields else F.lit("")
    raise Invalid(f"{k} is no key column")


def key_column(c: Column, t: Type) -> Column:
    """The canonical key as BINARY."""
    return F.unhex(key_hex_column(c, t))
