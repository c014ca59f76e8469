"""Similarities of sets, multisets, sequences and vectors, as Column functions.

What two empty arguments give differs by measure and is part of each one's
meaning: 0 for sets, 0.5 for multisets, 1 for sequences and count profiles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ratio(top: Column, bottom: Column, empty: float) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(empty))


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Of the arrays' distinct elements; ``empty`` if both have none."""
    return _ratio(shared(a, b), F.size(F.array_union(a, b)), empty)


def overlap(a: Column, b: Column) -> Column:
    """Shared elements over the smaller set; 0 if either is empty."""
    return _ratio(shared(a, b), F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))), 0.0)


def _times(items: Column, x: Column) -> Column:
    return F.size(F.filter(items, lambda y: y == x))


def multiset_jaccard(a: Column, b: Column, empty: float = 0.5) -> Column:
    """Summed smaller over summed larger counts."""
    keys = F.array_union(a, b)
    low = F.aggregate(keys, F.lit(0), lambda n, k: n + F.least(_times(a, k), _times(b, k)))
    high = F.aggregate(keys, F.lit(0), lambda n, k: n + F.greatest(_times(a, k), _times(b, k)))
    return _ratio(low, high, empty)


def letters(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != "")


#: Characters that stand for distinct elements, from this code point on.
FIRST, ALPHABET = 0x4E00, 20_000


def _coded(items: Column, names: Column) -> Column:
    """Each element as the character whose code point follows from its place among ``names``."""
    def character(x: Column) -> Column:
        return F.decode(F.unhex(F.hex(F.array_position(names, x) + (FIRST - 1))), "UTF-16BE")

    return F.array_join(F.transform(items, character), "")


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edits / longer length, of two arrays; 1 if both are empty, 0 if one is.

    Distinct elements become characters, so that Spark's own levenshtein
    counts the edits. Null elements and more than ALPHABET distinct ones have
    no character: the result is null.
    """
    names = F.array_distinct(F.concat(a, b))
    edits = F.levenshtein(_coded(a, names), _coded(b, names))
    longer = F.greatest(F.size(a), F.size(b))
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .when(F.size(names) <= ALPHABET, 1 - edits / longer)
    )


def binary_jaccard(a: Column, b: Column) -> Column:
    """Of numeric arrays: positions above 0 in both over those in either; 0 if none."""
    def count(test) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(test(x, y), 1).otherwise(0)), F.lit(0), lambda n, x: n + x)

    return _ratio(count(lambda x, y: (x > 0) & (y > 0)), count(lambda x, y: (x > 0) | (y > 0)), 0.0)


def count_similarity(a: Column, b: Column) -> Column:
    """Of key -> count maps: 1 - summed differences / summed larger counts; 1 if all are 0."""
    both = F.map_values(
        F.map_zip_with(a, b, lambda _, x, y: F.struct(F.coalesce(x, F.lit(0)).alias("x"), F.coalesce(y, F.lit(0)).alias("y")))
    )
    apart = F.aggregate(both, F.lit(0.0), lambda s, e: s + F.abs(e["x"] - e["y"]))
    high = F.aggregate(both, F.lit(0.0), lambda s, e: s + F.greatest(e["x"], e["y"]))
    return F.when(high > 0, 1 - apart / high).otherwise(F.lit(1.0))


def agreement(a: Column, b: Column) -> Column:
    """Share of the maps' common keys with equal values; 0.5 without common keys."""
    keys = F.array_intersect(F.map_keys(a), F.map_keys(b))
    same = F.size(F.filter(keys, lambda k: F.element_at(a, k) == F.element_at(b, k)))
    return F.when(F.size(keys) > 0, same / F.size(keys)).otherwise(F.lit(0.5))


def tri_state(a: Column, b: Column) -> Column:
    """1 if equal, 0 if not, 0.5 if either is null or empty."""
    known = a.isNotNull() & b.isNotNull() & (a.cast("string") != "") & (b.cast("string") != "")
    return F.when(known & (a == b), F.lit(1.0)).when(known, F.lit(0.0)).otherwise(F.lit(0.5))


def same(a: Column, b: Column) -> Column:
    """1.0 if equal, nulls included, else 0.0."""
    return F.when(a.eqNullSafe(b), F.lit(1.0)).otherwise(F.lit(0.0))


def cell_similarity(a: Column, b: Column) -> Column:
    """Share of equal characters of two strings of the same length, else 0."""
    equal = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y) & (x != "")), lambda e: e))
    return F.when((F.length(a) == F.length(b)) & (F.length(a) > 0), equal / F.length(a)).otherwise(F.lit(0.0))


def longest_run(items: Column) -> Column:
    """The most equal elements in a row; 0 for none."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, x: Column) -> Column:
        x = x.cast("string")
        run = F.when(s["last"].eqNullSafe(x) & (s["run"] > 0), s["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(items, start, step, lambda s: s["best"])


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y)), F.lit(0.0), lambda s, d: s + d))


def difference_vector(a: Column, b: Column) -> Column:
    """|a - b|, a, b in one array: the features of a pair of vectors."""
    return F.concat(F.zip_with(a, b, lambda x, y: F.abs(x - y)), a, b)


def length_similarity(a: Column, b: Column) -> Column:
    """max(0, 1 - |a - b| / 2) of two lengths."""
    return F.greatest(F.lit(0.0), 1 - 0.5 * F.abs(a - b))


def rating_similarity(a: Column, b: Column, span: float = 500.0) -> Column:
    """max(0, 1 - |a - b| / span); 0.5 if either is missing."""
    near = F.greatest(F.lit(0.0), 1 - F.abs(a - b) / span)
    return F.when(a.isNull() | b.isNull(), F.lit(0.5)).otherwise(near)
