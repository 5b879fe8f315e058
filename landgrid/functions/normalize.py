"""Scores from 0 to 100 for raw values; a missing value never becomes a score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from landgrid.functions.text import category_key

TRUE_WORDS = ["true", "si", "verdadero"]
FALSE_WORDS = ["false", "no", "falso"]


def round_up(value: Column, digits: int) -> Column:
    """Round to some decimals with halves up, on the double itself."""
    factor = 10.0**digits
    return F.floor(value * factor + 0.5) / factor


def finite(value: Column) -> Column:
    """The value as a double, NULL for NaN and infinities."""
    number = value.cast("double")
    return F.when(~unusable(number), number)


def unusable(number: Column) -> Column:
    return F.isnan(number) | (F.abs(number) == float("inf"))


def linear(value: Column, low: float, high: float) -> Column:
    """0 at the lower end, 100 at the upper end."""
    if low == high:
        raise ValueError("linear needs two different ends")
    low, high = float(min(low, high)), float(max(low, high))
    number = value.cast("double")
    # NULL passes no branch and stays NULL in the last one.
    return (
        F.when(unusable(number), F.lit(None).cast("double"))
        .when(number <= low, F.lit(0.0))
        .when(number >= high, F.lit(100.0))
        .otherwise(round_up((number - low) / (high - low) * 100.0, 2))
    )


def linear_inverse(value: Column, low: float, high: float) -> Column:
    return round_up(100.0 - linear(value, low, high), 2)


def stepped(value: Column, steps: list[tuple[float, float]], above: float | None = 0.0) -> Column:
    """Score of the first step whose upper end is not below the value."""
    ends = [end for end, _ in steps]
    if not ends or ends != sorted(set(ends)):
        raise ValueError("steps must rise")
    number = value.cast("double")
    chain = reduce(
        lambda c, s: c.when(number <= float(s[0]), F.lit(float(s[1]))),
        steps,
        F.when(number.isNull() | unusable(number), F.lit(None).cast("double")),
    )
    return chain.otherwise(F.lit(above).cast("double"))


def band(value: Column, hard_min: float, ideal_min: float, ideal_max: float, hard_max: float) -> Column:
    """100 inside the ideal band, falling to 0 at the hard ends."""
    if not hard_min <= ideal_min <= ideal_max <= hard_max:
        raise ValueError("band ends must rise")
    number = value.cast("double")
    rise = (number - float(hard_min)) / float(ideal_min - hard_min or 1) * 100.0
    fall = (float(hard_max) - number) / float(hard_max - ideal_max or 1) * 100.0
    return (
        F.when(unusable(number), F.lit(None).cast("double"))
        .when(number.between(ideal_min, ideal_max), F.lit(100.0))
        .when((number <= hard_min) | (number >= hard_max), F.lit(0.0))
        .when(number < ideal_min, round_up(rise, 2))
        .when(number > ideal_max, round_up(fall, 2))
    )


def lookup(key: Column, table: dict) -> Column:
    """Value of a small literal table, NULL when the key is absent."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def present_key(value: Column) -> Column:
    """Category key of a value, NULL for NULL and blank text."""
    text = value.cast("string")
    return F.when(F.trim(text) != "", category_key(text))


def categorical(value: Column, scores: dict[str, float], fallback: float | None = None) -> Column:
    return categorical_by_key(present_key(value), scores, fallback)


def categorical_by_key(key: Column, scores: dict[str, float], fallback: float | None = None) -> Column:
    """Score of a ready category key."""
    hit = lookup(key, {k: float(v) for k, v in scores.items()})
    if fallback is None:
        return hit
    return F.when(key.isNotNull(), F.coalesce(hit, F.lit(float(fallback))))


def to_boolean(value: Column) -> Column:
    """TRUE or FALSE from a boolean or its Spanish or English word, else NULL."""
    key = category_key(value.cast("string"))
    return F.when(key.isin(TRUE_WORDS), True).when(key.isin(FALSE_WORDS), False)


def boolean(value: Column, when_true: float | None, when_false: float | None) -> Column:
    flag = to_boolean(value)
    return F.when(flag, F.lit(when_true).cast("double")).when(~flag, F.lit(when_false).cast("double"))


def road_access(distance_m: Column, missing_as: float | None = None, whole: bool = False) -> Column:
    """100 at 100 m from a paved road, 0 from 5 km on."""
    d = distance_m if missing_as is None else F.coalesce(distance_m, F.lit(float(missing_as)))
    score = F.least(F.greatest(100.0 - (d - 100.0) / 49.0, F.lit(0.0)), F.lit(100.0))
    score = F.when(d.isNotNull(), score)
    return round_up(score, 0) if whole else score


def school_age(bands: Column) -> Column:
    """Children of 5 to 16 years from a map of five-year bands; two fifths of the last band."""
    n = lambda band: F.coalesce(F.try_element_at(bands, F.lit(band)).cast("double"), F.lit(0.0))
    total = n("5_9") + n("10_14") + n("15_19") * 0.4
    return F.when(bands.isNotNull() & (total > 0), round_up(total, 0).cast("bigint"))


def score_column(value: Column, rule: tuple, key: Column | None = None) -> Column:
    """Column of a catalogue rule ``(kind, *arguments)``; ``key`` is a ready category key."""
    kind, *args = rule
    if kind == "categorical":
        return categorical_by_key(present_key(value) if key is None else key, *args)
    rules = {
        "linear": linear,
        "linear_inverse": linear_inverse,
        "stepped": stepped,
        "band": band,
        "boolean": boolean,
    }
    return rules[kind](value, *args)


def flag_column(value: Column, rule: tuple, key: Column | None = None) -> Column:
    """ok, caution, blocker or unknown by a catalogue rule."""
    kind, *args = rule
    unknown = F.lit("unknown")
    if kind in ("above", "below", "band"):
        number = value.cast("double")
        chain = F.when(number.isNull() | unusable(number), unknown)
        if kind == "above":
            caution, blocker = args
            if blocker is not None:
                chain = chain.when(number > blocker, "blocker")
            if caution is not None:
                chain = chain.when(number > caution, "caution")
        elif kind == "below":
            chain = chain.when(number < args[0], "caution")
        else:
            (caution_low, caution_high), (block_low, block_high) = args
            chain = chain.when((number < block_low) | (number > block_high), "blocker")
            chain = chain.when((number < caution_low) | (number > caution_high), "caution")
        return chain.otherwise("ok")
    if kind == "category":
        table, fallback = args
        key = present_key(value) if key is None else key
        known = F.coalesce(lookup(key, table), F.lit(fallback))
        return F.when(key.isNull(), unknown).otherwise(known)
    if kind == "boolean":
        flag = to_boolean(value)
        return F.when(flag, args[0]).when(~flag, args[1]).otherwise(unknown)
    if kind == "always_ok":
        return F.when(value.isNull(), unknown).otherwise("ok")
    raise ValueError(f"unknown flag rule {kind}")
