"""String, bit, enum and array methods of the analysed language as column expressions.

Strings are byte strings to the language; these expressions are exact for ASCII.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Strings


def str_len(s: Column) -> Column:
    return F.octet_length(s)


def str_getc(s: Column, i: Column) -> Column:
    return F.when((i >= 0) & (i < F.length(s)), F.ascii(F.substring(s, i + 1, F.lit(1)))).otherwise(0)


def str_putc(s: Column, i: Column, c: Column) -> Column:
    """Out-of-range places and a zero character leave the string as it is."""
    ok = (i >= 0) & (i < F.length(s)) & (c != 0)
    return F.when(ok, F.overlay(s, F.char(c), i + 1, F.lit(1))).otherwise(s)


def str_compare(a: Column, b: Column) -> Column:
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def str_icompare(a: Column, b: Column) -> Column:
    return str_compare(F.lower(a), F.lower(b))


def str_substr(s: Column, i: Column, j: Column) -> Column:
    """From i to j, both included; empty unless 0 <= i <= j < length."""
    return F.when((i < 0) | (j < i) | (j >= F.length(s)), F.lit("")).otherwise(F.substring(s, i + 1, j - i + 1))


_DIGITS = {10: "[0-9_]", 16: "[0-9a-fA-F_]", 8: "[0-7_]", 2: "[01_]"}


def str_ato(s: Column, base: int) -> Column:
    """The number that the leading digits of a base spell; 0 without any."""
    lead = F.replace(F.regexp_extract(s, f"^{_DIGITS[base]}+", 0), F.lit("_"), F.lit(""))
    return F.when(lead == "", F.lit(0)).otherwise(F.conv(lead, base, 10).try_cast("long"))


def str_atoreal(s: Column) -> Column:
    lead = F.regexp_extract(s, r"^[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?", 0)
    return F.coalesce(F.when(lead != "", lead).try_cast("double"), F.lit(0.0))


def toa(n: Column, base: int) -> Column:
    return n.cast("string") if base == 10 else F.lower(F.conv(n.cast("string"), 10, base))


# Bits


def countones(v: Column) -> Column:
    return F.bit_count(v)


def countbits(v: Column, width: int, ones: bool, zeros: bool) -> Column:
    n = F.bit_count(v.bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1)))
    return (n if ones else F.lit(0)) + ((width - n) if zeros else F.lit(0))


def onehot(v: Column) -> Column:
    return F.bit_count(v) == 1


def onehot0(v: Column) -> Column:
    return F.bit_count(v) <= 1


def isunknown(mask: Column) -> Column:
    return mask != 0


def as_signed(v: Column, width: int) -> Column:
    """Two's complement reading of the low bits of v."""
    if width >= 64:
        return v
    low = v.bitwiseAND(F.lit((1 << width) - 1))
    return F.when(low >= 1 << (width - 1), low - (1 << width)).otherwise(low)


def as_unsigned(v: Column, width: int) -> Column:
    return v.bitwiseAND(F.lit((1 << width) - 1)) if width < 64 else v


#: Real functions by their system name.
REAL_FUNCTIONS: dict[str, Callable[..., Column]] = {
    "$ln": F.ln, "$log10": F.log10, "$exp": F.exp, "$sqrt": F.sqrt, "$floor": lambda x: F.floor(x).cast("double"), "$ceil": lambda x: F.ceil(x).cast("double"),
    "$sin": F.sin, "$cos": F.cos, "$tan": F.tan, "$asin": F.asin, "$acos": F.acos, "$atan": F.atan,
    "$sinh": F.sinh, "$cosh": F.cosh, "$tanh": F.tanh, "$asinh": F.asinh, "$acosh": F.acosh, "$atanh": F.atanh,
    "$pow": F.pow, "$atan2": F.atan2, "$hypot": F.hypot, "$itor": lambda x: x.cast("double"), "$rtoi": lambda x: x.try_cast("int"),
}


@F.udf(T.LongType(), useArrow=True)
def realtobits(x: float | None) -> int | None:
    import struct

    return None if x is None else struct.unpack("<q", struct.pack("<d", x))[0]


@F.udf(T.DoubleType(), useArrow=True)
def bitstoreal(x: int | None) -> float | None:
    import struct

    return None if x is None else struct.unpack("<d", struct.pack("<q", x))[0]


@F.udf(T.IntegerType(), useArrow=True)
def shortrealtobits(x: float | None) -> int | None:
    import struct

    return None if x is None else struct.unpack("<i", struct.pack("<f", x))[0]


@F.udf(T.FloatType(), useArrow=True)
def bitstoshortreal(x: int | None) -> float | None:
    import struct

    return None if x is None else struct.unpack("<f", struct.pack("<i", x))[0]


# Enums: members are numbered from 0


def enum_next(ordinal: Column, n: Column, count: Column) -> Column:
    return F.pmod(ordinal + n, count)


def enum_prev(ordinal: Column, n: Column, count: Column) -> Column:
    return F.pmod(ordinal - n, count)


# Arrays and queues; predicates are functions of an element (or of element and index)

Fn = Callable[..., Column]


def find(a: Column, p: Fn) -> Column:
    return F.filter(a, p)


def find_index(a: Column, p: Fn) -> Column:
    pairs = F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.transform(F.filter(pairs, lambda s: p(s["x"])), lambda s: s["i"])


def _first(a: Column) -> Column:
    return F.slice(a, 1, 1)


def _last(a: Column) -> Column:
    return F.slice(a, -1, 1)


def find_first(a: Column, p: Fn) -> Column:
    return _first(find(a, p))


def find_first_index(a: Column, p: Fn) -> Column:
    return _first(find_index(a, p))


def find_last(a: Column, p: Fn) -> Column:
    found = find(a, p)
    return F.when(F.size(found) == 0, found).otherwise(_last(found))


def find_last_index(a: Column, p: Fn) -> Column:
    found = find_index(a, p)
    return F.when(F.size(found) == 0, found).otherwise(_last(found))


def arr_min(a: Column, key: Fn | None = None) -> Column:
    """A queue of the least element, the first of several; empty of an empty array."""
    if key is None:
        return F.when(F.size(a) == 0, a).otherwise(F.array(F.array_min(a)))
    ranked = F.transform(a, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))
    return F.when(F.size(a) == 0, a).otherwise(F.array(F.array_min(ranked)["x"]))


def arr_max(a: Column, key: Fn | None = None) -> Column:
    """A queue of the greatest element, the first of several."""
    if key is None:
        return F.when(F.size(a) == 0, a).otherwise(F.array(F.array_max(a)))
    ranked = F.transform(a, lambda x, i: F.struct(key(x).alias("k"), (-i).alias("i"), x.alias("x")))
    return F.when(F.size(a) == 0, a).otherwise(F.array(F.array_max(ranked)["x"]))


def unique(a: Column) -> Column:
    return F.array_distinct(a)


def unique_index(a: Column) -> Column:
    return F.transform(F.array_distinct(a), lambda x: (F.array_position(a, x) - 1).cast("int"))


def arr_sort(a: Column, key: Fn | None = None) -> Column:
    if key is None:
        return F.array_sort(a)
    return F.transform(F.array_sort(F.transform(a, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))), lambda s: s["x"])


def arr_rsort(a: Column) -> Column:
    return F.reverse(F.array_sort(a))


def reduce(a: Column, op: str, zero: Column) -> Column:
    """sum, product, and, or, xor of integral elements; sums and products that overflow are null."""
    steps = {
        "sum": F.try_add,
        "product": F.try_multiply,
        "and": lambda x, y: x.bitwiseAND(y),
        "or": lambda x, y: x.bitwiseOR(y),
        "xor": lambda x, y: x.bitwiseXOR(y),
    }
    return F.aggregate(a, zero, steps[op])


def push_front(q: Column, x: Column) -> Column:
    return F.array_prepend(q, x)


def push_back(q: Column, x: Column) -> Column:
    return F.array_append(q, x)


def pop_front(q: Column) -> Column:
    return F.when(F.size(q) > 1, F.slice(q, F.lit(2), F.greatest(F.size(q) - 1, F.lit(0)))).otherwise(F.slice(q, 1, 0))


def pop_back(q: Column) -> Column:
    return F.slice(q, F.lit(1), F.greatest(F.size(q) - 1, F.lit(0)))


def insert(q: Column, i: Column, x: Column) -> Column:
    """Before place i from 0; places beyond the end leave the queue as it is."""
    ok = (i >= 0) & (i <= F.size(q))
    return F.when(ok, F.concat(F.slice(q, F.lit(1), F.when(ok, i).otherwise(0)), F.array(x), F.slice(q, F.when(ok, i).otherwise(0) + 1, F.size(q)))).otherwise(q)


# Associative arrays


def assoc_first(m: Column) -> Column:
    return F.array_min(F.map_keys(m))


def assoc_last(m: Column) -> Column:
    return F.array_max(F.map_keys(m))


def assoc_next(m: Column, k: Column) -> Column:
    return F.array_min(F.filter(F.map_keys(m), lambda x: x > k))


def assoc_prev(m: Column, k: Column) -> Column:
    return F.array_max(F.filter(F.map_keys(m), lambda x: x < k))


def assoc_exists(m: Column, k: Column) -> Column:
    return F.map_contains_key(m, k)


def assoc_delete(m: Column, k: Column) -> Column:
    return F.map_filter(m, lambda key, _: key != k)
