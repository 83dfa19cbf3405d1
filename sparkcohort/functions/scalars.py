"""Scalar column functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NOISE = -1


def missing_to_null(c: Column, markers: Sequence[str] = ("", "n/a")) -> Column:
    """Trimmed text; null where nothing or a marker of a missing value is left."""
    t = F.trim(c)
    return F.when(~t.isin(*markers), t)


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def group_of(subject: Column, pattern: str, groups: dict[str, str], default: str | None = None) -> Column:
    """Group of a subject id: the pattern's first group, looked up. An id that does not match raises; an unlisted code gives the default, or raises without one."""
    code = F.regexp_extract(subject, pattern, 1)
    found = F.lit(default) if default is not None else F.raise_error(F.concat(F.lit("no group for subject "), subject)).cast("string")
    for key, name in groups.items():
        found = F.when(code == key, name).otherwise(found)
    return F.when(subject.isNull(), None).when(~subject.rlike(pattern), F.raise_error(F.concat(F.lit("malformed subject id "), subject)).cast("string")).otherwise(found)


def canonical_id(raw: Column, prefix: str = "sub-") -> Column:
    """prefix and the id without separators; an id that has the prefix already stays."""
    return F.when(raw.startswith(prefix), raw).otherwise(F.concat(F.lit(prefix), F.regexp_replace(raw, "[_-]", "")))


def laterality_index(left: Column, right: Column) -> Column:
    """(L - R) / (L + R), null where both are 0."""
    return F.when(left + right != 0, (left - right) / (left + right))


def side_of(index: Column, threshold: float) -> Column:
    """both below the threshold (strictly) in absolute value, else left above 0 and right below; null stays."""
    return F.when(index.isNull(), None).when(F.abs(index) < threshold, "both").when(index > 0, "left").otherwise("right")


def fraction(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, part / whole)


def plain_number(v: Column) -> Column:
    """Text of a number: whole values without a decimal point."""
    return F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(v.cast("string"))


def comma_number(v: Column, decimals: int) -> Column:
    """Points between thousands and a decimal comma."""
    return F.translate(F.format_number(v, decimals), ",.", ".,")


def comma_scientific(v: Column, decimals: int) -> Column:
    return F.translate(F.format_string(f"%.{decimals}e", v), ".", ",")


def cluster_name(label: Column) -> Column:
    return F.when(label == NOISE, "noise").otherwise(label.cast("string"))


def reading_level(value: Column, bounds: Sequence[float], levels: Sequence[str]) -> Column:
    """The level whose range holds the value; a bound belongs to the level above it."""
    if len(levels) != len(bounds) + 1:
        raise ValueError(f"{len(bounds)} bounds need {len(bounds) + 1} levels, got {len(levels)}")
    out = F.lit(levels[0])
    for bound, level in zip(bounds, levels[1:], strict=True):
        out = F.when(value >= bound, level).otherwise(out)
    return F.when(value.isNotNull(), out)


def combo_key(keys: Sequence[str]) -> Column:
    """k=v,k=v of the named columns, in that order."""
    return F.concat_ws(",", *[F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit("None"))) for k in keys])


def parse_combo_key(key: Column) -> Column:
    return F.str_to_map(key, F.lit(","), F.lit("="))


def joined_tag(*values: Column) -> Column:
    """Values joined by _, nulls left out."""
    return F.concat_ws("_", *values)


def decades(low: Column, high: Column) -> Column:
    """Powers of ten that span [low, high]."""
    return F.transform(F.sequence(F.floor(F.log10(low)).cast("int"), F.ceil(F.log10(high)).cast("int")), lambda e: F.pow(F.lit(10.0), e))


def run_time(name: Column) -> Column:
    """Timestamp in a run's name, day-month-year two digits each, then __hour-minute-second."""
    return F.try_to_timestamp(F.regexp_extract(name, r"(\d{2}-\d{2}-\d{2}__\d{2}-\d{2}-\d{2})", 1), F.lit("dd-MM-yy__HH-mm-ss"))


def elapsed(start: Column, end: Column) -> Column:
    """H:MM:SS between two timestamps."""
    s = F.unix_timestamp(end) - F.unix_timestamp(start)
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
