"""The 64-bit cell id as Column expressions: 4 bits of base cell, then 20 digits of 3 bits, 7 beyond the resolution.

Ids are kept in signed longs with the same bits, so base cells from 8 on are negative: never sort by an id, but by the
number on the line of its level (:mod:`heptagrid.functions.mono`).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 20
PAD = 7
#: The lowest bit of every digit, and all bits of the digits.
ONES = int("1" * DIGITS, 8)
BODY = (1 << 3 * DIGITS) - 1


def _shift(i: int) -> int:
    return 3 * (DIGITS - i)


def base_cell(cell: Column) -> Column:
    return F.shiftrightunsigned(cell, 60).cast("int")


def digit(cell: Column, i: int) -> Column:
    """Digit i, from 1 on."""
    return F.shiftrightunsigned(cell, _shift(i)).bitwiseAND(F.lit(7)).cast("int")


def digits(cell: Column) -> Column:
    return F.array(*[digit(cell, i) for i in range(1, DIGITS + 1)])


def _pads(cell: Column) -> Column:
    """The lowest bits of the digits that are 7."""
    return cell.bitwiseAND(F.shiftrightunsigned(cell, 1)).bitwiseAND(F.shiftrightunsigned(cell, 2)).bitwiseAND(F.lit(ONES))


def _first(marks: Column) -> Column:
    """Digits before the first one whose lowest bit is marked; only where there is one."""
    return F.lit(DIGITS - 1) - ((F.length(F.bin(marks)) - 1) / 3).cast("int")


def resolution(cell: Column) -> Column:
    """Digits before the first 7; null for null."""
    pads = _pads(cell)
    return F.when(pads == 0, F.lit(DIGITS)).when(pads != 0, _first(pads))


def pack(base: Column, parts: list[Column]) -> Column:
    """Base cell and digits, coarsest first; the rest is padding."""
    cell = F.shiftleft(base.cast("long"), 60)
    for i, d in enumerate(parts[:DIGITS], 1):
        cell = cell.bitwiseOR(F.shiftleft(d.cast("long"), _shift(i)))
    return cell.bitwiseOR(F.lit((1 << 3 * (DIGITS - min(DIGITS, len(parts)))) - 1))


def encode(base: Column, parts: Column) -> Column:
    """Base cell and an array of digits, of which 20 are used."""
    return pack(base, [F.coalesce(F.get(parts, F.lit(i)), F.lit(PAD)) for i in range(DIGITS)])


def decode(cell: Column) -> Column:
    return F.struct(base_cell(cell).alias("base"), digits(cell).alias("digits"))


def parent_at(cell: Column, level: int) -> Column:
    """The ancestor at a level, 0 to 20; an id that is coarser stays as it is."""
    return cell.bitwiseOR(F.lit((1 << 3 * (DIGITS - min(max(level, 0), DIGITS))) - 1))


def parent(cell: Column, level: int = -1) -> Column:
    """One level up, or at a level; a base cell is its own parent."""
    if level >= 0:
        return parent_at(cell, level)
    masks = F.array(*[F.lit((1 << 3 * (DIGITS - r)) - 1).cast("long") for r in range(DIGITS)])
    return cell.bitwiseOR(F.get(masks, F.greatest(resolution(cell) - 1, F.lit(0))))


def first_non_zero(cell: Column) -> Column:
    """The place of the first digit that isn't 0, padding included; 0 for a base cell, and where all 20 are 0."""
    some = cell.bitwiseOR(F.shiftrightunsigned(cell, 1)).bitwiseOR(F.shiftrightunsigned(cell, 2)).bitwiseAND(F.lit(ONES))
    return F.when((some == 0) | (digit(cell, 1) == PAD), F.lit(0)).when(some != 0, _first(some) + 1)


def to_hex(cell: Column) -> Column:
    return F.lower(F.lpad(F.hex(cell), 16, "0"))


def from_hex(text: Column) -> Column:
    return F.conv(text, 16, -10).cast("long")


def from_uint64(number: Column) -> Column:
    """Unsigned 64-bit numbers are read from Parquet as decimal(20, 0); the same bits as a long."""
    number = number.cast("decimal(20,0)")
    return F.when(number >= F.lit("9223372036854775808").cast("decimal(20,0)"), number - F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(number).cast("long")


def hex_resolution(text: Column) -> Column:
    """The number of digits under 7, wherever they are; on malformed ids not the same as :func:`resolution`."""
    return F.lit(DIGITS) - F.bit_count(_pads(from_hex(text)))


def to_string(cell: Column) -> Column:
    """Two decimal digits of base cell, then the digits."""
    octal = F.lpad(F.conv(cell.bitwiseAND(F.lit(BODY)).cast("string"), 10, 8), DIGITS, "0")
    return F.concat(F.lpad(base_cell(cell).cast("string"), 2, "0"), F.left(octal, resolution(cell)))


def from_string(text: Column) -> Column:
    """Null for what isn't two decimal digits and then digits up to 7; digits after the twentieth don't count."""
    body = F.conv(F.rpad(F.substring(text, 3, DIGITS), DIGITS, str(PAD)), 8, 10).cast("long")
    return F.when(text.rlike("^[0-9]{2}[0-7]*$"), F.shiftleft(F.substring(text, 1, 2).try_cast("long"), 60).bitwiseOR(body))


def hex_to_string(text: Column) -> Column:
    return to_string(from_hex(text))


def string_resolution(text: Column) -> Column:
    return F.length(text) - 2


def string_local_pos(text: Column) -> Column:
    """Parent, last digit, and whether it is the centre; of a base cell the last digit of its number."""
    last = F.right(text, F.lit(1))
    return F.struct(F.left(text, F.length(text) - 1).alias("parent"), last.alias("local"), (last == "0").alias("is_center"))


def hex_local_pos(text: Column) -> Column:
    return string_local_pos(hex_to_string(text))


def base7_to_int(text: Column) -> Column:
    return F.conv(text, 7, 10).cast("long")


def int_to_base7(number: Column, length: int) -> Column:
    return F.lpad(F.conv(number.cast("string"), 10, 7), length, "0")
