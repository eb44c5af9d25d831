"""Parsing and cleaning of loosely typed source columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Text that counts as missing.
BLANK = ("", "nan", "none", "-")


def present(c: Column) -> Column:
    text = F.trim(c.cast("string"))
    return F.when(text.isNotNull() & ~F.lower(text).isin(*BLANK), text)


def pick(df: DataFrame, names: Sequence[str], default: str | None = None) -> Column:
    """First non-blank value among the alias columns that exist, names compared without case."""
    have = {c.strip().lower(): c for c in df.columns}
    cols = [present(F.col(f"`{have[n.lower()]}`")) for n in names if n.lower() in have]
    return F.coalesce(*cols, F.lit(default).cast("string")) if cols else F.lit(default).cast("string")


def number(c: Column) -> Column:
    """Double from text with thousands separators; blanks and dashes are null."""
    text = present(F.regexp_replace(c.cast("string"), ",", ""))
    return text.try_cast("double")


def canonical(c: Column, aliases: Mapping[str, str]) -> Column:
    """Alias map lookup; unknown names stay as they are."""
    text = F.trim(c.cast("string"))
    if not aliases:
        return text
    table = F.create_map(*[F.lit(v) for kv in aliases.items() for v in kv])
    return F.coalesce(F.try_element_at(table, text), text)


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("1", "true", "yes", "y"), F.lit(False))


def collapse(c: Column) -> Column:
    """Lower-case with every space (plain or ideographic) run removed down to one."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), r"[\s　]+", " "))


def stamp(day: Column, clock: Column, zone: str = "Asia/Tokyo") -> Column:
    """UTC time from an 8-digit date and an HHMM clock (18:00 when absent) in a local zone."""
    digits = F.regexp_replace(day.cast("string"), r"\D", "")
    hhmm = F.lpad(F.coalesce(present(F.regexp_replace(clock.cast("string"), r"\D", "")), F.lit("1800")), 4, "0")
    local = F.try_to_timestamp(F.concat(F.substring(digits, 1, 8), hhmm), F.lit("yyyyMMddHHmm"))
    return F.to_utc_timestamp(local, zone)


def finite_or_zero(c: Column) -> Column:
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(bad, 0.0).otherwise(c)


def contained(name: Column, other: Column) -> Column:
    """Either team name contains the other, both non-empty."""
    return F.coalesce(
        (F.length(name) > 0) & (F.length(other) > 0) & (name.contains(other) | other.contains(name)), F.lit(False)
    )
