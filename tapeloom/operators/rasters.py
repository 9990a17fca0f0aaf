"""Pictures: screen rows in their stored order, bit planes as pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEIGHT, COLUMNS, SCREEN = 192, 32, 6144


def row_offset(y: Column) -> Column:
    """Where a pixel row of 32 bytes is stored: thirds of the screen, then rows of characters, then lines inside them."""
    third = F.shiftleft(y.bitwiseAND(0xC0), 5)
    line = F.shiftleft(y.bitwiseAND(0x07), 8)
    return third.bitwiseOR(line).bitwiseOR(F.shiftleft(y.bitwiseAND(0x38), 2))


def linear(bitmap: Column) -> Column:
    """The rows of a stored bitmap of 6144 bytes from top to bottom, as hexadecimal digits."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(HEIGHT - 1)), lambda y: F.hex(F.substring(bitmap, row_offset(y) + 1, F.lit(COLUMNS))))
    return F.array_join(rows, "")


def stored(rows: Column) -> Column:
    """The inverse: hexadecimal digits of the rows top to bottom, back in stored order."""
    places = F.transform(F.sequence(F.lit(0), F.lit(HEIGHT - 1)), lambda y: F.struct(row_offset(y).alias("at"), F.substring(rows, y * 2 * COLUMNS + 1, F.lit(2 * COLUMNS)).alias("row")))
    return F.unhex(F.array_join(F.transform(F.array_sort(places), lambda p: p["row"]), ""))


def pixels(planes: DataFrame, keys: list[str], plane: str, byte: str) -> DataFrame:
    """(keys, x, color): eight pixels of each group of plane bytes, plane 0 the lowest bit of a color."""
    bit = lambda x: F.shiftright(F.col(byte), 7 - x).bitwiseAND(1)
    # one row a group in the shuffle, with eight sums
    sums = planes.groupBy(*keys).agg(*(F.sum(F.expr(f"shiftleft(1L, `{plane}`)") * bit(x)).alias(f"_{x}") for x in range(8)))
    each = F.array(*(F.struct(F.lit(x).alias("x"), F.col(f"_{x}").alias("color")) for x in range(8)))
    return sums.select(*keys, F.inline(each))
