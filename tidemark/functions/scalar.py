"""Checked scalar operators as columns: each gives STRUCT<value, abort>, and no row's failure fails the job.

abort is 0 or the reason's number. Operators take plain columns or such structs; the first operand that aborted wins.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.types import I64_MIN, U64_MAX, Type, bit_pattern, encoded_len_column, from_bit_pattern

# The numbers of the abort reasons.
MISSING_KEY, KEY_EXISTS, REQUIRE_FAILED, EXPLICIT_ABORT, INTEGER_OVERFLOW, BOUND_EXCEEDED = 1, 2, 3, 4, 5, 6
RESOURCE_LIMIT, DIVISION_BY_ZERO, INVALID_SHIFT, INDEX_OUT_OF_BOUNDS, INVALID_UTF8, NAME_IN_USE, TABLE_NOT_LIVE = 7, 8, 9, 10, 11, 16, 17
REASONS = {1: "MissingKey", 2: "KeyExists", 3: "RequireFailed", 4: "ExplicitAbort", 5: "IntegerOverflow", 6: "BoundExceeded", 7: "ResourceLimit", 8: "DivisionByZero", 9: "InvalidShift", 10: "IndexOutOfBounds", 11: "InvalidUtf8", 16: "NameInUse", 17: "TableNotLive"}

U = "decimal(20,0)"


def ok(value: Column) -> Column:
    return F.struct(value.alias("value"), F.lit(0).alias("abort"))


def checked(value: Column, *aborts: tuple[Column, int]) -> Column:
    """The value, or the first of the (condition, reason) pairs that holds."""
    reason = F.lit(0)
    for condition, number in reversed(aborts):
        reason = F.when(condition, F.lit(number)).otherwise(reason)
    return F.struct(F.when(reason == 0, value).alias("value"), reason.alias("abort"))


def then(a: Column, f) -> Column:
    """f of a result's value, unless that result aborted. f gives a result."""
    out = f(a["value"])
    reason = F.when(a["abort"] != 0, a["abort"]).otherwise(out["abort"])
    return F.struct(F.when(reason == 0, out["value"]).alias("value"), reason.alias("abort"))


def _i(x: int) -> Column:
    return F.lit(x).cast("bigint")


def _u(x: Column) -> Column:
    return x.cast("decimal(38,0)")


def _in_u64(x: Column) -> tuple[Column, int]:
    return x.isNull() | (x < 0) | (x > F.lit(Decimal(U64_MAX)).cast("decimal(38,0)")), INTEGER_OVERFLOW


def add(a: Column, b: Column, unsigned: bool = False) -> Column:
    if unsigned:
        x = _u(a) + _u(b)
        return checked(x.cast(U), _in_u64(x))
    x = F.try_add(a, b)
    return checked(x, (x.isNull(), INTEGER_OVERFLOW))


def sub(a: Column, b: Column, unsigned: bool = False) -> Column:
    if unsigned:
        x = _u(a) - _u(b)
        return checked(F.when(x >= 0, x).cast(U), _in_u64(x))
    x = F.try_subtract(a, b)
    return checked(x, (x.isNull(), INTEGER_OVERFLOW))


def mul(a: Column, b: Column, unsigned: bool = False) -> Column:
    if unsigned:
        x = F.try_multiply(a.cast(U), b.cast(U))
        fits = x <= F.lit(Decimal(U64_MAX)).cast("decimal(38,0)")
        return checked(F.when(fits, x).cast(U), _in_u64(x))
    x = F.try_multiply(a, b)
    return checked(x, (x.isNull(), INTEGER_OVERFLOW))


def div(a: Column, b: Column, unsigned: bool = False) -> Column:
    """Truncates towards zero. Decimal `div` wraps in Spark, so the unsigned quotient is (a - a % b) / b, which is exact."""
    if unsigned:
        safe = F.when(b != 0, b.cast(U))
        return checked(((a - a % safe) / safe).cast(U), (b == 0, DIVISION_BY_ZERO))
    safe = F.when((b != 0) & ~((a == _i(I64_MIN)) & (b == -1)), b)
    return checked(F.call_function("div", a, safe), (b == 0, DIVISION_BY_ZERO), ((a == _i(I64_MIN)) & (b == -1), INTEGER_OVERFLOW))


def rem(a: Column, b: Column, unsigned: bool = False) -> Column:
    if unsigned:
        return checked((a % F.when(b != 0, b)).cast(U), (b == 0, DIVISION_BY_ZERO))
    return checked(a % F.when(b != 0, b), (b == 0, DIVISION_BY_ZERO), ((a == _i(I64_MIN)) & (b == -1), INTEGER_OVERFLOW))


def neg(a: Column) -> Column:
    return checked(-F.when(a != _i(I64_MIN), a), (a == _i(I64_MIN), INTEGER_OVERFLOW))


def to_i64(a: Column) -> Column:
    x = a.try_cast("bigint")
    return checked(x, (x.isNull(), INTEGER_OVERFLOW))


def to_u64(a: Column) -> Column:
    return checked(a.cast(U), (a < 0, INTEGER_OVERFLOW))


def bit(a: Column, b: Column, op: str, unsigned: bool = False) -> Column:
    """op: and, or, xor."""
    x, y = (bit_pattern(a), bit_pattern(b)) if unsigned else (a, b)
    z = {"and": x.bitwiseAND(y), "or": x.bitwiseOR(y), "xor": x.bitwiseXOR(y)}[op]
    return ok(from_bit_pattern(z) if unsigned else z)


def bit_not(a: Column, unsigned: bool = False) -> Column:
    return ok(from_bit_pattern(F.bitwise_not(bit_pattern(a))) if unsigned else F.bitwise_not(a))


def shift(a: Column, n: Column, left: bool, unsigned: bool = False) -> Column:
    """Left shifts drop high bits; right shifts keep an I64's sign. n is 0..63."""
    by = F.when((n >= 0) & (n < 64), n.cast("int"))
    x = bit_pattern(a) if unsigned else a
    z = F.call_function("shiftleft", x, by) if left else F.call_function("shiftrightunsigned" if unsigned else "shiftright", x, by)
    return checked(from_bit_pattern(z) if unsigned else z, ((n < 0) | (n >= 64), INVALID_SHIFT))


def both(a: Column, b: Column) -> Column:
    """Eager AND; `a && b` is branch(a, b, FALSE)."""
    return ok(a & b)


def either(a: Column, b: Column) -> Column:
    return ok(a | b)


def differ(a: Column, b: Column) -> Column:
    return ok(a != b)


def branch(condition: Column, yes: Column, no: Column) -> Column:
    """The result of one side; the other can neither read nor abort."""
    return F.when(condition, yes).otherwise(no)


def compare(a: Column, b: Column, op: str) -> Column:
    return ok({"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op])


def byte_len(a: Column) -> Column:
    return ok(F.octet_length(a).cast("bigint"))


def concat(a: Column, b: Column, bound: int) -> Column:
    return checked(F.concat(a, b), (F.octet_length(a).cast("bigint") + F.octet_length(b) > bound, BOUND_EXCEEDED))


def slice_bytes(a: Column, start: Column, length: Column) -> Column:
    """`length` bytes from `start` (from 0) on; all of them must exist."""
    n = F.octet_length(a).cast("bigint")
    bad = (start < 0) | (length < 0) | (start > n) | (length > n - start)
    return checked(F.substring(a, F.when(~bad, start + 1).cast("int"), F.when(~bad, length).cast("int")), (bad, INDEX_OUT_OF_BOUNDS))


def utf8_bytes(a: Column) -> Column:
    return ok(a.cast("binary"))


def parse_utf8(a: Column) -> Column:
    return checked(F.when(F.is_valid_utf8(a.cast("string")), a.cast("string")), (~F.is_valid_utf8(a.cast("string")), INVALID_UTF8))


def sha256(a: Column) -> Column:
    return ok(F.unhex(F.sha2(a, 256)))


def rows_len(rows: Column) -> Column:
    return ok(F.size(rows).cast("bigint"))


def rows_at(rows: Column, index: Column, side: str) -> Column:
    """side: key or value, of the row at `index` (from 0)."""
    bad = (index < 0) | (index >= F.size(rows))
    return checked(F.get(rows, F.when(~bad, index).cast("int"))[side], (bad, INDEX_OUT_OF_BOUNDS))


def bounded(value: Column, t: Type) -> Column:
    """The value, if it is within its type's bounds."""
    def over(c: Column, t: Type) -> Column:
        if t.kind in ("bytes", "string"):
            return F.octet_length(c) > t.bound
        if t.kind == "tuple":
            out = F.lit(False)
            for i, f in enumerate(t.fields):
                out = out | over(c[f"_{i}"], f)
            return out
        if t.kind == "rows":
            return F.size(c) > t.bound
        return F.lit(False)

    return checked(value, (over(value, t), BOUND_EXCEEDED))


def require(condition: Column) -> Column:
    return checked(F.lit(True), (~condition, REQUIRE_FAILED))


def within(value: Column, t: Type, limit: int) -> Column:
    """The value, if its encoded length is within a resource limit."""
    return checked(value, (encoded_len_column(value, t) > limit, RESOURCE_LIMIT))
