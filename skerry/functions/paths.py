"""Column functions on file paths. Lower case is ASCII only, lengths count bytes, both separators count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def name_of(path: Column) -> Column:
    """Text after the last separator; the whole path if there is none or it is the last character."""
    name = F.substring_index(F.translate(path, "\\", "/"), "/", -1)
    return F.when(name == "", path).otherwise(name)


def base_offset(path: Column) -> Column:
    """Byte offset of the name."""
    return F.octet_length(path) - F.octet_length(name_of(path))


def dir_of(path: Column) -> Column:
    """Text before the name, with its separator."""
    return F.substring(path, F.lit(1), F.char_length(path) - F.char_length(name_of(path)))


def extension_of(path: Column) -> Column:
    """Lower-cased text after the last dot of the name of a path; empty if the dot is the first or last of the name, or absent."""
    return F.lower(F.regexp_extract(path, r"[^\\/]\.([^.\\/]+)$", 1))
