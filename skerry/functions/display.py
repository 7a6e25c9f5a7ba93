"""Sizes, ages and counts in words, as Python helpers and as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of sizes, in steps of 1024 (fixed values).
UNITS = ("KB", "MB", "GB", "TB", "PB")


def size_text(n: int) -> str:
    """1536 -> '1.5 KB'; one decimal below ten, none from ten on."""
    if n < 1024:
        return f"{n} B"
    step = min(len(UNITS), (n.bit_length() - 1) // 10)
    f = n / 1024**step
    return f"{f:.1f} {UNITS[step - 1]}" if f < 10 else f"{f:.0f} {UNITS[step - 1]}"


def human_size(n: Column) -> Column:
    """``size_text`` as a column; rounds half to even."""
    f = n.cast("double")
    out = F.format_string("%d B", n)
    for step, unit in enumerate(UNITS, 1):
        v = f / F.lit(float(1024**step))
        text = F.when(v < 10, F.format_string("%.1f " + unit, F.bround(v, 1))).otherwise(F.format_string("%.0f " + unit, F.bround(v, 0)))
        out = F.when(n >= 1024**step, text).otherwise(out)
    return out


def human_age(mod: Column, now: int) -> Column:
    """Age of a Unix time: future, now, then whole minutes, hours, days, months of 30 and years of 365 days."""
    age = F.lit(now).cast("bigint") - mod
    out = F.when(age < 0, "future").when(age < 60, "now")
    for limit, unit, suffix in ((3600, 60, "m"), (86400, 3600, "h"), (30 * 86400, 86400, "d"), (365 * 86400, 30 * 86400, "mo")):
        out = out.when(age < limit, F.format_string(f"%d{suffix} ago", F.floor(age / unit)))
    return out.otherwise(F.format_string("%dy ago", F.floor(age / (365 * 86400))))


def commas(n: Column) -> Column:
    return F.format_number(n, 0)


def duration_text(seconds: float) -> str:
    """A run time: microseconds, milliseconds or seconds with one decimal."""
    if seconds < 1e-5:
        return "<10µs"
    if seconds < 1e-3:
        return f"{int(seconds * 1e6)}µs"
    return f"{int(seconds * 1e3)}ms" if seconds < 1 else f"{seconds:.1f}s"


def shorten_left(text: Column, width: int) -> Column:
    """The end of a text that is longer than ``width`` characters, after an ellipsis."""
    return F.when(F.char_length(text) <= width, text).otherwise(F.concat(F.lit("…"), F.right(text, F.lit(width - 1))))


def looks_like_text(content: Column) -> Column:
    """True if fewer than 5 percent of the first 4,000 characters are control characters other than white space."""
    head = F.substring(content, 1, 4000)
    control = F.char_length(head) - F.char_length(F.regexp_replace(head, r"[\x00-\x08\x0b\x0e-\x1f\x7f]", ""))
    return control * 20 < F.greatest(F.char_length(head), F.lit(1))


def valid_utf8(raw: Column) -> Column:
    """Bytes as text, each run of invalid bytes replaced by one question mark."""
    return F.regexp_replace(F.make_valid_utf8(raw.cast("string")), "�+", "?")
