"""Relevance of an entry to the text words of a plan, as one integer column without Python workers.

A fuzzy word is a literal at query time, so its walk over the text becomes three regular expressions and one fold: the
first finds where the word ends earliest, the second (on the reversed text) where it then starts latest, the third
splits that window into the gaps between matched characters. Positions count characters; gaps, spans and lengths count bytes.

The expression is written as one SQL text, since building it call by call takes longer than a search.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from skerry.operators.predicates import escape, subsequence
from skerry.plans.language import SearchPlan, Term

# Points of a match (fixed values).
MATCH = 16
AFTER_SEPARATOR = 12
CAMEL = 8
CONSECUTIVE = 10
GAP_BASE, GAP_MOST = 4, 20
SPAN_EXACT, SPAN_CLOSE = 30, 10
IN_NAME = 40
PREFIX = 60
WHOLE_NAME = 25
NAME_EDGE = 15
ALL_IN_NAME = 50
LENGTH_STEP = 12
SEPARATORS = "/\\_-. (["
_MARK = "\x01"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def quoted(text: str) -> str:
    """A text as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _bonus(original: str, at: str) -> str:
    """Points for a match at a character position: after a separator or at a camel hump."""
    before, here = f"substring({original}, {at}, 1)", f"substring({original}, {at} + 1, 1)"
    return f"case when {at} = 0 or instr({quoted(SEPARATORS)}, {before}) > 0 then {AFTER_SEPARATOR} when {here} rlike '[A-Z]' and {before} rlike '[a-z]' then {CAMEL} else 0 end"


def window_patterns(text: str) -> tuple[str, str, str]:
    """The patterns of the earliest end, of the latest start in the reversed text, and of the gaps between."""
    backward = "(?s)^" + escape(text[-1]) + "".join(f"[^{escape(c)}]*{escape(c)}" for c in reversed(text[:-1]))
    parts = r"(?s)\A" + escape(text[0]) + "".join(f"([^{escape(c)}]*){escape(c)}" for c in text[1:]) + r"\z"
    return subsequence(text), backward, parts


def gaps_of(window: str, text: str) -> str:
    """The texts between the matched characters of a window."""
    marks = _MARK.join(f"${i}" for i in range(1, len(text)))
    return f"split(regexp_replace({window}, {quoted(window_patterns(text)[2])}, {quoted(marks)}), {quoted(_MARK)}, -1)"


def fuzzy_sql(low: str, original: str, text: str) -> str:
    """Points of the best window of ``text`` as a subsequence of column ``low``; NULL if it is none."""
    if not text:
        return "0"
    size = len(text.encode())
    forward, backward, _ = window_patterns(text)
    start = "(char_length(pre) - char_length(win))"
    first = f"named_struct('at', cast({start} as int), 'points', cast({_bonus(original, start)} + {MATCH} as int))"
    if len(text) == 1:
        total = f"{first}.points"
    else:
        cost = f"case when gap = '' then {CONSECUTIVE} else -(least(octet_length(gap), {GAP_MOST}) + {GAP_BASE}) end"
        step = _let("here", "acc.at + char_length(gap) + 1", f"named_struct('at', cast(here as int), 'points', cast(acc.points + {MATCH} + {_bonus(original, 'here')} + {cost} as int))")
        total = f"aggregate({gaps_of('win', text)}, {first}, (acc, gap) -> {step}, acc -> acc.points)"
    extra = (MATCH + CONSECUTIVE) * (size - len(text))
    scored = f"{total} + {extra} + case when octet_length(win) = {size} then {SPAN_EXACT} when octet_length(win) <= {2 * size} then {SPAN_CLOSE} else 0 end"
    return _let("pre", f"regexp_extract({low}, {quoted(forward)}, 0)", f"case when pre = '' then null else {_let('win', f'reverse(regexp_extract(reverse(pre), {quoted(backward)}, 0))', scored)} end")


def fuzzy(low: str, original: str, text: str) -> Column:
    """``fuzzy_sql`` as a column."""
    return F.expr(fuzzy_sql(low, original, text))


def _term_points(term: Term) -> str:
    """(points, inside) of one text word that the entry satisfies."""
    size = len(term.text.encode())
    whole = f"case when octet_length(name) = {size} then {WHOLE_NAME} else 0 end"

    def out(points: str, inside: str) -> str:
        return f"named_struct('points', cast({points} as bigint), 'inside', {inside})"

    match term.kind:
        case "not":
            return out("0", "true")
        case "exact":
            inside = f"octet_length(substring(path_lower, 1, instr(path_lower, {quoted(term.text)}) - 1)) >= base_off"
            return out(f"{MATCH * size} + case when {inside} then {IN_NAME} else 0 end", inside)
        case "prefix":
            return out(str(MATCH * size + PREFIX), "true")
        case "suffix":
            return out(str(MATCH * size), f"{size} <= octet_length(name)")
        case "name":
            return out(f"{fuzzy_sql('name_lower', 'name', term.text)} + {IN_NAME} + {whole}", "true")
    better = f"(named is not null and named + {NAME_EDGE} >= full)"
    chosen = out(f"case when {better} then named + {NAME_EDGE} + {whole} else full end", better)
    return _let("full", fuzzy_sql("path_lower", "path", term.text), _let("named", fuzzy_sql("name_lower", "name", term.text), chosen))


def relevance(plan: SearchPlan) -> Column:
    """Sum of the points of all words, the bonus for words that all lie in the name, less a step for the path's length."""
    length = f"cast(floor(path_len / {LENGTH_STEP}) as bigint)"
    if not plan.terms:
        return F.expr(f"-{length}")
    together = f" + case when forall(words, w -> w.inside) then {ALL_IN_NAME} else 0 end" if len(plan.terms) > 1 else ""
    total = f"aggregate(words, 0L, (sum, w) -> sum + w.points){together} - {length}"
    return F.expr(f"cast({_let('words', f'array({", ".join(map(_term_points, plan.terms))})', total)} as bigint)")
