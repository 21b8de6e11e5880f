"""Matches of a pattern with their places, as column expressions only.

Everything here takes time in proportion to the text plus n log n for n matches:
no fold copies what it has gathered, and no expression counts characters from
the start of the text for each match.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "array<struct<s:int,e:int,m:string>>"
#: Code points of the pieces that a text is cut into where many places of it are looked up.
PIECE = 256


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Inclusive running totals of an array under an associative ``op``, by doubling: log2(n) passes over the array."""
    rounds = F.when(F.size(values) < 2, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(2)))).cast("int") - 1))

    def double(acc: Column, k: Column) -> Column:
        return let(F.pow(F.lit(2.0), k).cast("int"), lambda back: F.transform(acc, lambda x, i: F.when(i >= back, op(F.get(acc, i - back), x)).otherwise(x)))

    return F.aggregate(rounds, values, double)


def matches(text: Column, pattern: str, hint: Column | None = None) -> Column:
    """Leftmost non-overlapping matches as array<struct<s,e,m>>: code points, end exclusive.

    What lies between matches (``split``) and the matches themselves give the
    places by a running sum.  ``hint`` is a cheap necessary condition.
    """
    found = F.rlike(text, F.lit(pattern)) if hint is None else hint & F.rlike(text, F.lit(pattern))
    gaps = F.split(text, pattern, -1)
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(gaps) - 1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def placed(p: Column) -> Column:
        ends = running(F.transform(p, lambda x: F.length(x["g"]) + F.length(x["m"])), lambda a, b: a + b)
        return let(ends, lambda e: F.transform(p, lambda x, i: F.struct((F.get(e, i) - F.length(x["m"])).alias("s"), F.get(e, i).alias("e"), x["m"].alias("m"))))

    return F.when(found, let(pairs, placed)).otherwise(F.array().cast(EMPTY))


def pieces(text: Column) -> Column:
    """The text in pieces of PIECE code points, the last one shorter."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}+"), F.lit(0))


def cut(of: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` (exclusive, may lie past the end) of a text, by its pieces."""
    first, last = F.floor(start / PIECE).cast("int"), F.floor(F.greatest(end - 1, start) / PIECE).cast("int")
    window = F.array_join(F.transform(F.sequence(first, last), lambda i: F.get(of, i)), "")  # slice() would copy all pieces
    return F.when(end <= start, "").otherwise(F.substring(window, start - first * PIECE + 1, end - start))


def digest(arrays: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """kind:start:end of all spans by start, then by kind in the order given, comma-joined; and its SHA-256."""
    tag = lambda i, k: lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("i"), x["e"].alias("e"), F.lit(k).alias("k"))
    tagged = [F.transform(a, tag(i, k)) for i, (k, a) in enumerate(arrays)]
    ordered = F.sort_array(F.concat(*tagged))
    joined = F.array_join(F.transform(ordered, lambda x: F.concat(x["k"], F.lit(":"), x["s"], F.lit(":"), x["e"])), ",")
    return joined, F.sha2(joined, 256)
