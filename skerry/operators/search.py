"""Ranked name search: filter, score, and the first rows of a total order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.operators.predicates import filters, holds
from skerry.operators.score import NAME_EDGE, fuzzy, gaps_of, quoted, relevance, window_patterns
from skerry.plans.language import SearchPlan, Term

SORTS = ("relevance", "newest", "largest")
FIND_ROWS = 50


def matching(entries: DataFrame, plan: SearchPlan) -> DataFrame:
    """Entries that pass every filter and every text word."""
    return reduce(lambda df, t: df.where(holds(t)), plan.terms, entries.where(filters(plan)))


def sort_key(plan: SearchPlan, sort: str) -> Column:
    """The number by which results fall: points, date or size. Relevance without text words means newest."""
    if sort not in SORTS:
        raise ValueError(f"sort: expects one of {', '.join(SORTS)}")
    if sort == "largest":
        return F.col("size")
    return F.col("mod") if sort == "newest" or not plan.has_terms else relevance(plan)


def ranked(entries: DataFrame, plan: SearchPlan, sort: str = "relevance") -> DataFrame:
    """Matching entries with ``key``. Ties fall to the shorter path, then to the order of paths."""
    return matching(entries, plan).withColumn("key", sort_key(plan, sort).cast("bigint"))


def find(entries: DataFrame, plan: SearchPlan, n: int = FIND_ROWS, sort: str = "relevance", offset: int = 0) -> DataFrame:
    """(path, key, path_len, rank): the first ``n`` results after ``offset``; each task keeps only its own best rows."""
    order = [F.col("key").desc(), F.col("path_len"), F.col("path")]
    top = ranked(entries, plan, sort).select("path", "key", "path_len").orderBy(*order).limit(max(0, n) + offset)
    # The window runs over the few rows of the page, never over the catalog.
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).where(F.col("rank") > offset)


def total(entries: DataFrame, plan: SearchPlan) -> DataFrame:
    """(total): how many entries match."""
    return matching(entries, plan).agg(F.count("*").alias("total"))


def keep_position(results: DataFrame, path: str) -> DataFrame:
    """(position): 0-based row of a path in a result page, 0 if it is not there."""
    return results.agg(F.coalesce(F.max(F.when(F.col("path") == path, F.col("rank") - 1)), F.lit(0)).cast("bigint").alias("position"))


def term_offsets(term: Term) -> Column:
    """Character offsets in the path that one text word matches, for highlighting."""
    path = F.col("path_lower")
    size = len(term.text)
    span = lambda start: F.sequence(start, start + size - 1)
    name_at = F.char_length("path") - F.char_length("name")
    match term.kind:
        case "not":
            return F.array().cast("array<int>")
        case "exact":
            return span(F.instr(path, term.text) - 1)
        case "prefix":
            return span(name_at)
        case "suffix":
            return span(F.char_length(path) - size)

    def walk(low: str, base: Column) -> Column:
        forward, backward, _ = window_patterns(term.text)
        pre = F.regexp_extract(low, forward, 0)
        win = F.reverse(F.regexp_extract(F.reverse(pre), backward, 0))
        start = base + F.char_length(pre) - F.char_length(win)
        if size == 1:
            return F.array(start)
        window = f"reverse(regexp_extract(reverse(regexp_extract({low}, {quoted(forward)}, 0)), {quoted(backward)}, 0))"
        return F.aggregate(F.expr(gaps_of(window, term.text)), F.array(start), lambda acc, g: F.concat(acc, F.array(F.element_at(acc, -1) + F.char_length(g) + 1)))

    in_name = walk("name_lower", name_at)
    if term.kind == "name":
        return in_name
    named, full = fuzzy("name_lower", "name", term.text), fuzzy("path_lower", "path", term.text)
    return F.when(named.isNotNull() & (named + NAME_EDGE >= full), in_name).otherwise(walk("path_lower", F.lit(0)))


def match_positions(plan: SearchPlan) -> Column:
    """Sorted distinct character offsets of the path that the text words match."""
    parts = [term_offsets(t).cast("array<int>") for t in plan.terms] or [F.array().cast("array<int>")]
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def highlight_runs(name: Column, offsets: Column) -> Column:
    """A name as (text, matched) runs; ``offsets`` count characters of the name."""
    each = F.transform(F.sequence(F.lit(0), F.char_length(name) - 1), lambda i: F.struct(F.substring(name, i + 1, F.lit(1)).alias("text"), F.array_contains(offsets, i.cast("int")).alias("matched")))

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.concat(last["text"], x["text"]).alias("text"), x["matched"].alias("matched"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["matched"] == x["matched"]), joined).otherwise(F.concat(acc, F.array(x)))

    return F.when(F.char_length(name) > 0, F.aggregate(each, F.array().cast("array<struct<text:string,matched:boolean>>"), step))
