"""Text folding, number parsing, title case and trigrams as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with marks and their plain forms, position by position.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyyAAAAAAEEEEIIIIOOOOOUUUUNCY"

LIGATURES = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O"}

# Lower-case particles of Spanish names.
NAME_PARTICLES = ["de", "del", "la", "las", "los", "y", "el", "en"]

MISSING_WORDS = ["", "-", "ND"]


def strip_accents(col: Column) -> Column:
    plain = F.translate(col, ACCENTED, PLAIN)
    return F.regexp_replace(plain, "[\\u0300-\\u036f]", "")


def fold(col: Column) -> Column:
    """Upper case without accents, the key used by every text comparison."""
    plain = strip_accents(col)
    for letter, letters in LIGATURES.items():
        plain = F.replace(plain, F.lit(letter), F.lit(letters))
    return F.upper(plain)


def category_key(col: Column) -> Column:
    """Lower-case key with every run of other characters as one underscore."""
    key = F.regexp_replace(F.lower(strip_accents(col)), "[^a-z0-9]+", "_")
    return F.regexp_replace(key, "^_+|_+$", "")


def address_fold(col: Column) -> Column:
    """Fold that keeps the signs an address needs (``# ° º ª . - /``)."""
    kept = F.regexp_replace(strip_accents(col), "[^A-Za-z0-9_\\s#°ºª.\\-/]", " ")
    return F.upper(F.trim(F.regexp_replace(kept, "\\s+", " ")))


def title_case(col: Column) -> Column:
    """Capital first letters, with Spanish particles left lower-case after the first word."""
    tokens = F.regexp_extract_all(F.lower(col), F.lit("([^\\s-]+|\\s+|-)"), 1)
    cased = F.transform(
        tokens,
        lambda t, i: F.when((i > 0) & t.isin(NAME_PARTICLES), t).otherwise(
            F.concat(F.upper(F.substring(t, 1, 1)), t.substr(F.lit(2), F.length(t)))
        ),
    )
    return F.array_join(cased, "")


def decimal_from_text(col: Column) -> Column:
    """Number from text whose first comma is the decimal sign; NULL when it is no number."""
    raw = F.trim(col)
    comma = F.locate(",", raw)
    head = raw.substr(F.lit(1), comma - 1)
    tail = F.replace(raw.substr(comma + 1, F.length(raw)), F.lit(","), F.lit(""))
    return F.when(comma > 0, F.concat(head, F.lit("."), tail)).otherwise(raw).try_cast("double")


def measure_from_text(col: Column) -> Column:
    """Number from a statistics sheet: decimal comma, with blanks, ND and - as NULL."""
    raw = F.upper(F.trim(col))
    value = F.replace(raw, F.lit(","), F.lit(".")).try_cast("double")
    return F.when(~raw.isin(MISSING_WORDS), value)


def number_from_text(col: Column) -> Column:
    """Number from free text: drop everything but digits, sign and point."""
    return F.regexp_replace(col, "[^0-9.\\-]", "").try_cast("double")


def int_from_text(col: Column) -> Column:
    return F.regexp_replace(col, "[^0-9\\-]", "").try_cast("bigint")


def padded_code(col: Column, width: int = 5) -> Column:
    """Trimmed code, zero-padded when shorter than ``width``; longer codes stay as they are."""
    code = F.trim(col)
    return F.when(code == "", None).when(F.length(code) < width, F.lpad(code, width, "0")).otherwise(code)


def words(col: Column) -> Column:
    """Lower-case alphanumeric words without accents."""
    spaced = F.trim(F.regexp_replace(F.lower(strip_accents(col)), "[^a-z0-9]+", " "))
    return F.filter(F.split(spaced, " "), lambda w: F.length(w) > 0)


def trigrams(col: Column) -> Column:
    """Distinct trigrams of every word padded with two blanks before and one after."""
    per_word = F.transform(
        words(col),
        lambda w: F.transform(
            F.sequence(F.lit(1), F.length(w) + 1),
            lambda i: F.concat(F.lit("  "), w, F.lit(" ")).substr(i, F.lit(3)),
        ),
    )
    return F.array_distinct(F.flatten(per_word))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over joint distinct elements of two distinct arrays; 0 when both are empty."""
    shared = F.size(F.array_intersect(a, b))
    joint = F.size(a) + F.size(b) - shared
    return F.when(joint > 0, shared / joint).otherwise(F.lit(0.0))
