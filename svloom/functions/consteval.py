"""Checked 64-bit constant arithmetic: struct(value, err), never an exception.

err is one of Overflow, DivideByZero, InvalidArgument, NonConstant, Unsupported, or null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OVERFLOW, DIVIDE_BY_ZERO, INVALID, NON_CONSTANT, UNSUPPORTED = "Overflow", "DivideByZero", "InvalidArgument", "NonConstant", "Unsupported"


def result(value: Column, err: Column | None = None) -> Column:
    """A value unless there is an error; a null value without one is an overflow."""
    err = F.when(value.isNull(), F.lit(OVERFLOW)) if err is None else err
    return F.struct(F.when(err.isNull(), value).cast("long").alias("value"), err.alias("err"))


def add(a: Column, b: Column) -> Column:
    return result(F.try_add(a, b))


def subtract(a: Column, b: Column) -> Column:
    return result(F.try_subtract(a, b))


def multiply(a: Column, b: Column) -> Column:
    return result(F.try_multiply(a, b))


def _guarded(a: Column, b: Column, value: Column) -> Column:
    least = F.expr("cast('-9223372036854775808' as bigint)")
    err = F.when(b == 0, F.lit(DIVIDE_BY_ZERO)).when((a == least) & (b == -1), F.lit(OVERFLOW))
    return result(F.when(err.isNull(), value), err)


def divide(a: Column, b: Column) -> Column:
    """Truncates toward zero. (a - a % b) is a multiple of b, which decimals divide without loss."""
    safe = F.when((b == 0) | (b == -1), F.lit(1)).otherwise(b)
    wide = (a - a % safe).cast("decimal(20,0)") / safe.cast("decimal(20,0)")
    return _guarded(a, b, F.when(b == -1, F.try_subtract(F.lit(0).cast("long"), a)).otherwise(F.round(wide, 0).cast("long")))


def remainder(a: Column, b: Column) -> Column:
    """Takes the sign of the dividend."""
    return _guarded(a, b, a % F.when((b == 0) | (b == -1), F.lit(1)).otherwise(b))


def shift_left(a: Column, s: Column) -> Column:
    """Bits shifted out are lost; counts outside 0..63 overflow."""
    ok = s.between(0, 63)
    return result(F.when(ok, F.call_function("shiftleft", a.cast("long"), s.cast("int"))), F.when(~ok, F.lit(OVERFLOW)))


def shift_right(a: Column, s: Column) -> Column:
    """Arithmetic, as all constant values are signed."""
    ok = s.between(0, 63)
    return result(F.when(ok, F.call_function("shiftright", a.cast("long"), s.cast("int"))), F.when(~ok, F.lit(OVERFLOW)))


def negate(a: Column) -> Column:
    return result(F.try_subtract(F.lit(0).cast("long"), a))


def clog2(n: Column) -> Column:
    """Bits that count n states: 0 up to 1; negative numbers are invalid."""
    return result(F.when(n <= 1, F.lit(0)).otherwise(F.length(F.bin(n - 1))), F.when(n < 0, F.lit(INVALID)))


def decimal_literal(text: Column) -> Column:
    return result(F.replace(text, F.lit("_"), F.lit("")).try_cast("long"))


def based_literal(text: Column) -> Column:
    """[size]'[s]{b,o,d,h}digits of 128 bits at most, cut to its size; 64 bits with the top one set are negative.

    Unknown digits (x, z, ?) are NonConstant, signed forms Unsupported; sizes over 64, digits that the base
    lacks and forms without a size that exceed 63 bits Overflow.
    """
    clean = F.lower(F.replace(text, F.lit("_"), F.lit("")))
    shape = r"^\s*([0-9]*)\s*'\s*(s?)([bodh])\s*([0-9a-fxz?]+)$"
    part = lambda i: F.regexp_extract(clean, shape, i)
    base = F.when(part(3) == "b", 2).when(part(3) == "o", 8).when(part(3) == "d", 10).otherwise(16)
    size = part(1).try_cast("int")
    digits = F.regexp_replace(part(4), "^0+(?=.)", "")
    n, wide = F.length(digits), lambda c: c.try_cast("decimal(20,0)")
    foreign = digits.rlike(r"[^01]") & (base == 2) | digits.rlike("[^0-7]") & (base == 8) | digits.rlike("[^0-9]") & (base == 10)
    most = F.lit(str((1 << 128) - 1))
    over_128 = F.when(base == 2, n > 128).when(base == 16, n > 32).when(base == 8, (n > 43) | (n == 43) & (F.substring(digits, 1, 1) > "3")).otherwise((n > 39) | (n == 39) & (digits > most))
    turn = F.lit(str(1 << 64)).cast("decimal(20,0)")
    conv = lambda t, b: wide(F.call_function("conv", t, F.lit(b), F.lit(10)))
    # The low 64 bits: the last digits of a power of two, the remainder of a decimal number without its last digit.
    octal = conv(F.right(digits, F.lit(21)), 8) + F.when(n > 21, (F.substring(digits, -22, 1).try_cast("int") % 2) * F.lit(str(1 << 63)).cast("decimal(20,0)")).otherwise(F.lit(0))
    tens = F.when(n == 39, (wide(F.substring(digits, 1, 38).try_cast("decimal(38,0)") % turn) * 10 + F.right(digits, F.lit(1)).try_cast("int")) % turn).otherwise(digits.try_cast("decimal(38,0)") % turn)
    low = F.when(base == 2, conv(F.right(digits, F.lit(64)), 2)).when(base == 16, conv(F.right(digits, F.lit(16)), 16)).when(base == 8, octal).otherwise(tens).cast("decimal(20,0)")
    high = F.when(base == 2, n > 63).when(base == 16, (n > 16) | (n == 16) & (F.substring(digits, 1, 1) > "7")).when(base == 8, n > 21).otherwise((n > 19) | (n == 19) & (digits > str((1 << 63) - 1)))
    cut = F.when(size < 64, low % F.pow(F.lit(2.0), size).cast("decimal(20,0)")).otherwise(low)
    signed = F.when(cut >= F.lit(str(1 << 63)).cast("decimal(20,0)"), cut - turn).otherwise(cut).cast("long")
    err = (
        F.when(~clean.rlike(shape), F.lit(UNSUPPORTED))
        .when(part(4).rlike("[xz?]"), F.lit(NON_CONSTANT))
        .when(part(2) == "s", F.lit(UNSUPPORTED))
        .when(foreign | over_128 | (size > 64) | size.isNull() & high, F.lit(OVERFLOW))
    )
    return result(F.when(err.isNull(), F.when(size == 0, F.lit(0)).otherwise(signed)), err)


def dim_query(name: str, msb: Column, lsb: Column) -> Column:
    """left, right, low, high, size or increment of a fixed dimension [msb:lsb]."""
    found = {
        "left": msb,
        "right": lsb,
        "low": F.least(msb, lsb),
        "high": F.greatest(msb, lsb),
        "size": F.abs(msb - lsb) + 1,
        "increment": F.when(msb >= lsb, 1).otherwise(-1),
    }
    return found[name].cast("long")
