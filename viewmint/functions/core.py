"""Text, vector and hash expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_title(title: Column) -> Column:
    """Lower case, underscores and white space to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.translate(title, "_", " ")), r"\s+", " "))


def norm_key(key: Column) -> Column:
    """Lower case; each run of anything but ``[a-z0-9_]`` is ``_``, trimmed."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(key)), "[^a-z0-9_]+", "_"), "^_+|_+$", "")


def tokens(text: Column) -> Column:
    """Runs of ``[a-z0-9]`` of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def hash_unit(key: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of a key's MD5."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_index(key: Column, n: Column) -> Column:
    """An index in [0, n) from a key's MD5."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), n)


def mix32(x: Column) -> Column:
    """32 well mixed bits of a whole number's lowest 32, as a long."""
    low = F.lit(0xFFFFFFFF)
    x = x.bitwiseAND(low)
    for shift, factor in ((16, 0x7FEB352D), (15, 0x045D9F3B)):
        x = (x.bitwiseXOR(F.shiftright(x, shift)) * F.lit(factor).cast("long")).bitwiseAND(low)
    return x.bitwiseXOR(F.shiftright(x, 16))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also where lambdas in it name it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def renormed(a: Column) -> Column:
    length = norm(a)
    return F.transform(a, lambda x: x / F.when(length == 0, 1.0).otherwise(length))


def int8_view(a: Column) -> Column:
    """Codes of 1/127, half to even, scaled back and normed."""
    codes = F.transform(a, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint(x * 127.0))) / 127.0)
    return renormed(codes)


def binary_view(a: Column) -> Column:
    unit = 1 / F.sqrt(F.size(a).cast("double"))
    return F.transform(a, lambda x: F.when(x >= 0, unit).otherwise(-unit))


def truncated_view(a: Column, dims: int) -> Column:
    return renormed(F.slice(a, 1, dims))


def overlap_share(question: Column, title: Column) -> Column:
    """Share of the title's tokens in the question, and 1 more if the title
    stands in it as a whole."""
    q, t = token_set(question), token_set(title)
    share = F.when(F.size(t) > 0, F.size(F.array_intersect(q, t)) / F.size(t)).otherwise(0.0)
    inside = F.contains(norm_title(question), norm_title(title)) & (norm_title(title) != "")
    return share + F.when(inside, 1.0).otherwise(0.0)
