"""Scalar functions of names, headlines and documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised(x: Column) -> Column:
    """Lower case with one blank for every run of other characters than a-z and 0-9."""
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def name_key(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9 ]", " "), r"\s+", " "))


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://([^/:?#]+)", 1)


def source_tier(url: Column, tiers: tuple, other: int) -> Column:
    out = F
    for end, tier in tiers:
        out = out.when(host(url).endswith(end), tier)
    return out.otherwise(other)


def tokens(x: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normalised(x), " "), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def containment(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b)))


def plain_text(html: Column) -> Column:
    """Markup and silent elements removed, white space joined."""
    silent = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(silent, r"(?s)<[^>]*>", " "), r"\s+", " "))


def number_scaled(x: Column) -> Column:
    """First number of a text with its scale word; years from 1900 to 2100 are not numbers."""
    m = F.regexp_extract(x, r"(?i)\$?([0-9]+(?:\.[0-9]+)?)\s*(thousand|million|billion|%)?", 1)
    scale = F.lower(F.regexp_extract(x, r"(?i)\$?([0-9]+(?:\.[0-9]+)?)\s*(thousand|million|billion|%)?", 2))
    v = F.when(m != "", m.cast("double"))
    v = v * F.when(scale == "thousand", 1e3).when(scale == "million", 1e6).when(scale == "billion", 1e9).when(scale == "%", 0.01).otherwise(1.0)
    return F.when((scale == "") & v.between(1900, 2100), None).otherwise(v)
