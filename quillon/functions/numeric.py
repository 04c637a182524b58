"""Arithmetic of print geometry, colour and reading."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def spine_width(pages: Column, leaf: Column, binding: Column) -> Column:
    """Millimetres: half the pages times a leaf, at least 3; none for stapled or spiral-bound books."""
    return F.when(binding.isin("staple", "spiral"), 0.0).otherwise(F.greatest(F.lit(3.0), F.ceil(pages / 2) * leaf))


def effective_dpi(pixels: Column, millimetres: Column) -> Column:
    return F.when(millimetres > 0, pixels / (millimetres / 25.4))


def aspect_delta(w: Column, h: Column, want_w: Column, want_h: Column) -> Column:
    """Relative distance of two aspect ratios."""
    want = want_w / want_h
    return F.abs(w / h - want) / want


def luminance(rgb: Column) -> Column:
    """Relative luminance of "#rrggbb"."""

    def part(at: int) -> Column:
        v = F.conv(F.substring(rgb, at, 2), 16, 10).cast("double") / 255
        return F.when(v <= 0.03928, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * part(2) + 0.7152 * part(4) + 0.0722 * part(6)


def ratio(x: Column, y: Column) -> Column:
    """Contrast of two luminances; null if either is."""
    return F.when(x.isNotNull() & y.isNotNull(), (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05))


def contrast(a: Column, b: Column) -> Column:
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def shares(values: Column) -> Column:
    """An array scaled to sum to one; equal shares if it sums to nothing."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.transform(values, lambda x: F.when(total > 0, x / total).otherwise(F.lit(1.0) / F.size(values)))


def type_scale(base: Column, step: Column) -> Column:
    """Sizes in the golden ratio."""
    return base * F.pow(F.lit(1.6180339887498949), step)


def reading_minutes(n_words: Column) -> Column:
    return F.greatest(F.lit(1), F.round(n_words / 200).cast("int"))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine of two float arrays; null if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, 1 - dot(a, b) / norm)
