"""Trigram similarity and pattern texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trigrams(text: Column) -> Column:
    """Distinct three-letter pieces of a text's words, each with two spaces before and one after."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "), " "), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    pieces = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(pieces))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of two texts; 0 if neither has any, null if one is null."""
    x, y = trigrams(a), trigrams(b)
    union = F.size(F.array_union(x, y))
    value = F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / union)
    return F.when(a.isNotNull() & b.isNotNull(), value)


def pattern_text(predicates: Column) -> Column:
    """Text of an array of structs (name, op, value): sorted and joined by `` ∧ ``."""
    return F.array_join(F.array_sort(F.transform(predicates, lambda p: F.concat(p["name"], p["op"], p["value"]))), " ∧ ")


def pattern_triplets(text: Column) -> Column:
    """Structs (name, op, value) of a pattern's text."""
    parts = F.filter(F.split(text, " ∧ "), lambda x: x != "")
    pattern = "^([^=<>]+)([=<>])(.*)$"
    return F.transform(parts, lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("name"), F.regexp_extract(x, pattern, 2).alias("op"), F.regexp_extract(x, pattern, 3).alias("value")))


def highlighted(text: Column) -> Column:
    """Distinct node names in a pattern's text, sorted."""
    return F.array_sort(F.array_distinct(F.transform(pattern_triplets(text), lambda p: F.substring_index(p["name"], ".", 1))))
