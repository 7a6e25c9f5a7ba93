"""Metadata filters and text words of a search plan as columns.

The cheap conjuncts come first and keep the forms that reach the Parquet scan (ranges on size and mod, prefix of the path).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from skerry.functions.paths import LOWER, UPPER
from skerry.plans.language import SearchPlan, Term


_CAPITALS = str.maketrans(LOWER, UPPER)


def in_folder(folder: str) -> Column:
    """An absolute folder holds itself and what lies below it; any other text is looked for in the parent folders."""
    path = F.col("path_lower")
    if folder == "" or folder.startswith("/") or folder[1:3] in (":\\", ":/"):
        if folder == "":
            return path.startswith("/")
        below = (path == folder) | path.startswith(folder + "/") | path.startswith(folder + "\\")
        # Every spelling of the folder lies between that in capitals and that in small letters. This range on the stored path
        # reaches the scan, and a catalog sorted by path reads only the row groups that may hold it.
        return F.col("path").between(folder.translate(_CAPITALS), folder + chr(0x10FFFF)) & below
    return F.col("dir_lower").contains(folder)


def has_extension(extensions: frozenset[str]) -> Column:
    """The extension is in the set, or a dot file's whole remaining name is."""
    names = sorted(extensions)
    dotted = F.col("name").startswith(".") & (F.octet_length("name") > 1) & F.lower(F.substring("name", 2, 2147483647)).isin(names)
    return F.col("ext").isin(names) | dotted


def filters(plan: SearchPlan) -> Column:
    """All metadata filters of a plan."""
    out: list[Column] = []
    if plan.only_dirs:
        out.append(F.col("is_dir"))
    if plan.only_files:
        out.append(~F.col("is_dir"))
    if plan.min_size > 0:
        out.append(F.col("size") >= plan.min_size)
    if plan.max_size is not None:
        out.append(F.col("size") <= plan.max_size)
    if plan.mod_after:
        out.append(F.col("mod") >= plan.mod_after)
    if plan.mod_before:
        out.append(F.col("mod") <= plan.mod_before)
    if plan.extensions:
        out.append(has_extension(plan.extensions))
    out += [in_folder(f) for f in plan.folders]
    return reduce(lambda a, b: a & b, out, F.lit(True))


def subsequence(text: str) -> str:
    """A pattern that ends at the earliest place where all characters of ``text`` have occurred in order."""
    return "(?s)^" + "".join(f"[^{escape(c)}]*{escape(c)}" for c in text)


def escape(c: str) -> str:
    return "\\" + c if c in "\\^-[]{}().*+?$|&~#" else c


def holds(term: Term) -> Column:
    """True if an entry satisfies one text word."""
    path, name = F.col("path_lower"), F.col("name_lower")
    match term.kind:
        case "not":
            return ~path.contains(term.text)
        case "exact":
            return path.contains(term.text)
        case "prefix":
            return name.startswith(term.text)
        case "suffix":
            return path.endswith(term.text)
        case "name":
            return name.rlike(subsequence(term.text))
    return path.rlike(subsequence(term.text))
