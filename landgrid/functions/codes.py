"""Thirty-digit parcel codes, twenty-digit old codes and division codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The twelve segments of the code and their widths.
SEGMENTS = [
    ("department", 2),
    ("municipality", 3),
    ("zone", 2),
    ("sector", 2),
    ("commune", 2),
    ("neighborhood", 2),
    ("block", 4),
    ("parcel", 4),
    ("condition", 1),
    ("building", 2),
    ("floor", 2),
    ("unit", 4),
]
CODE_LENGTH = 30
OLD_CODE_LENGTH = 20
TERRAIN_LENGTH = 21
UNIT_TAIL = "0" * (CODE_LENGTH - TERRAIN_LENGTH)


def digits(col: Column) -> Column:
    """The code without blanks, points, dashes, underscores and slashes."""
    return F.regexp_replace(col, "[\\s.\\-_/]", "")


def is_code(col: Column) -> Column:
    return digits(col).rlike(f"^[0-9]{{{CODE_LENGTH}}}$")


def is_old_code(col: Column) -> Column:
    return digits(col).rlike(f"^[0-9]{{{OLD_CODE_LENGTH}}}$")


def is_candidate(col: Column) -> Column:
    return is_code(col) | is_old_code(col)


def parts(col: Column) -> Column:
    """Struct of the twelve segments; NULL for anything but thirty digits."""
    code = digits(col)
    fields, start = [], 1
    for name, width in SEGMENTS:
        fields.append(F.substring(code, start, width).alias(name))
        start += width
    return F.when(is_code(col), F.struct(*fields))


def reason_invalid(col: Column) -> Column:
    """NULL for a valid code, else one short reason."""
    code = digits(col)
    return (
        F.when(col.isNull(), F.lit("missing"))
        .when(is_old_code(col), F.lit("old_format"))
        .when(~is_code(col), F.lit("not_30_digits"))
        .when(F.substring(code, 1, 2) == "00", F.lit("department_00"))
        .when(F.substring(code, 3, 3) == "000", F.lit("municipality_000"))
    )


def muni_code(col: Column) -> Column:
    return F.when(is_code(col), F.substring(digits(col), 1, 5))


def dept_code(col: Column) -> Column:
    return F.when(is_code(col), F.substring(digits(col), 1, 2))


def terrain_prefix(col: Column) -> Column:
    return F.when(is_code(col), F.substring(digits(col), 1, TERRAIN_LENGTH))


def matrix_code(col: Column) -> Column:
    """The code of the whole parcel a unit belongs to."""
    return F.concat(terrain_prefix(col), F.lit(UNIT_TAIL))


def is_unit(col: Column) -> Column:
    """TRUE when any digit after the terrain part is not zero."""
    tail = F.substring(digits(col), TERRAIN_LENGTH + 1, len(UNIT_TAIL))
    return F.when(is_code(col), tail != UNIT_TAIL)


def zone_kind(col: Column) -> Column:
    """rural for segment 00, seat for 01, other_urban for the rest."""
    zone = F.substring(digits(col), 6, 2)
    return F.when(
        is_code(col),
        F.when(zone == "00", "rural").when(zone == "01", "seat").otherwise("other_urban"),
    )


def pretty(col: Column) -> Column:
    p = parts(col)
    return F.concat_ws("-", *[p[name] for name, _ in SEGMENTS])
