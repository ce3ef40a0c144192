"""Difference hashes of grey images that are given as arrays of values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WIDTH, HEIGHT = 9, 8


def _overlaps(size: Column, parts: int, k: Column) -> Column:
    """(first, last, low, high) of part k of an axis: the places that it covers, and its ends in units of 1 / parts of a place."""
    low, high = k * size, (k + 1) * size
    return F.struct(F.floor(low / parts).cast("int").alias("first"), (F.ceil(high / parts) - 1).cast("int").alias("last"), low.cast("long").alias("low"), high.cast("long").alias("high"))


def _weight(part: Column, i: Column, parts: int) -> Column:
    return F.least((i + 1) * parts, part["high"]) - F.greatest(i * parts, part["low"])


def resampled(pixels: Column, width: Column, height: Column) -> Column:
    """Sums of grey values over HEIGHT x WIDTH equal parts of an image (rows one after another), each value by the area it shares.

    All in whole numbers: a part's mean is its sum over the same area for all parts, so sums compare as means do.
    """

    def part(y: Column, x: Column) -> Column:
        rows, columns = _overlaps(height, HEIGHT, y), _overlaps(width, WIDTH, x)

        def row(total: Column, j: Column) -> Column:
            line = F.aggregate(F.sequence(columns["first"], columns["last"]), F.lit(0).cast("long"), lambda s, i: s + F.element_at(pixels, (j * width + i + 1).cast("int")).cast("long") * _weight(columns, i, WIDTH))
            return total + line * _weight(rows, j, HEIGHT)

        return F.aggregate(F.sequence(rows["first"], rows["last"]), F.lit(0).cast("long"), row)

    places = F.sequence(F.lit(0), F.lit(HEIGHT * WIDTH - 1))
    return F.transform(places, lambda p: part(F.floor(p / WIDTH).cast("int"), p % WIDTH))


def difference_hash(pixels: Column, width: Column, height: Column) -> Column:
    """The 64-bit difference hash: a bit for each value of HEIGHT rows, the first on top, set where the next to its right is brighter.

    Null for an image without pixels or whose size doesn't fit its array. Images smaller than 9 x 8 are stretched.
    """
    from ..functions import text

    step = F.sequence(F.lit(0), F.lit(63))

    def bits(small: Column) -> Column:
        brighter = lambda k: F.element_at(small, (F.floor(k / 8) * WIDTH + k % 8 + 1).cast("int")) < F.element_at(small, (F.floor(k / 8) * WIDTH + k % 8 + 2).cast("int"))
        return F.aggregate(step, F.lit(0).cast("long"), lambda h, k: F.shiftleft(h, 1).bitwiseOR(F.when(brighter(k), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))))

    good = (width > 0) & (height > 0) & (F.size(pixels) == width * height)
    return F.when(good, text.let(resampled(pixels, width, height), bits))


def hex_hash(h: Column) -> Column:
    """A hash as sixteen hexadecimal digits."""
    return F.lower(F.lpad(F.hex(h), 16, "0"))
