"""Registered queries of the engine's own operators, with their DuckDB texts.

Keys carry the identifier of the operator they exercise. Every query runs over its whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Observation
from pyspark.sql import functions as F

from skerry.functions import display
from skerry.operators import changes, grep, search, stats
from skerry.plans.language import KINDS, parse
from skerry.runtime import shared_folder, table
from skerry.sources import trees
from skerry.sources.catalog import DEFAULT_EXCLUDES, CatalogStore, below_excluded, with_folders
from skerry.sources.trees import BEFORE_SQL, CONTENTS_SQL, DOCUMENTS_SQL, LATEST_SQL, NOW

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def plan(line: str):
    return parse(line, now=NOW, strict=True, home="/home/user", cwd="/")


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLE[name] = oracle
        return f

    return put


# ---------- DuckDB texts


def _bonus_sql(original: str, at: str) -> str:
    return (
        f"(case when {at} = 0 then 12 when contains('/\\_-. ([', substr({original}, {at}, 1)) then 12 "
        f"when regexp_matches(substr({original}, {at} + 1, 1), '[A-Z]') and regexp_matches(substr({original}, {at}, 1), '[a-z]') then 8 else 0 end)"
    )


def fuzzy_sql(low: str, original: str, text: str) -> str:
    """Points of a fuzzy word, unrolled by character."""
    esc = lambda c: "\\" + c if c in "\\^-[].()" else c
    forward = "^" + "".join(f"[^{esc(c)}]*{esc(c)}" for c in text)
    backward = "^" + esc(text[-1]) + "".join(f"[^{esc(c)}]*{esc(c)}" for c in reversed(text[:-1]))
    parts = "^" + esc(text[0]) + "".join(f"([^{esc(c)}]*){esc(c)}" for c in text[1:]) + "$"
    at, points = "(length(pre) - length(win))", [f"16 + {_bonus_sql(original, '(length(pre) - length(win))')}"]
    for k in range(1, len(text)):
        gap = f"regexp_extract(win, '{parts}', {k})"
        at = f"({at} + 1 + length({gap}))"
        points.append(f"16 + {_bonus_sql(original, at)} + case when {gap} = '' then 10 else -(4 + least(strlen({gap}), 20)) end")
    span = f"case when strlen(win) = {len(text)} then 30 when strlen(win) <= {2 * len(text)} then 10 else 0 end"
    return f"(select case when pre = '' then null else {' + '.join(points)} + {span} end from (select pre, reverse(regexp_extract(reverse(pre), '{backward}')) as win from (select regexp_extract({low}, '{forward}') as pre)))"


def fuzzy_term_sql(text: str) -> str:
    """(points, inside) of a fuzzy word over path and name."""
    whole = f"case when strlen(name) = {len(text)} then 25 else 0 end"
    return f"(select case when n is not null and n + 15 >= f then {{'p': n + 15 + {whole}, 'i': true}} else {{'p': f, 'i': false}} end from (select {fuzzy_sql('path_lower', 'path', text)} as f, {fuzzy_sql('name_lower', 'name', text)} as n))"


def top_sql(tree: str, where: str, key: str, n: int, offset: int = 0) -> str:
    return f"""select path, key, path_len, rank from (select path, key, path_len, row_number() over (order by key desc, path_len, path) as rank
from (select path, cast({key} as bigint) as key, cast(path_len as int) as path_len from {tree} where {where}) where key is not null) where rank > {offset} and rank <= {offset + n}"""


_LEN = "(path_len // 12)"


def _match(name: str, line: str, where: str) -> None:
    """A query for the whole set of matching paths in the newest snapshot."""

    @query(name, f"select path, size, mod from {LATEST_SQL} where {where}")
    def run(spark, sf_dir):
        return search.matching(trees.snapshot(spark, sf_dir), plan(line)).select("path", "size", "mod")


def _rank(name: str, line: str, where: str, key: str, n: int = 200, sort: str = "relevance") -> None:
    """A query for the first results over the documents as files."""

    @query(name, top_sql(DOCUMENTS_SQL, where, key, n))
    def run(spark, sf_dir):
        return search.find(trees.documents(spark, sf_dir), plan(line), n, sort)


# ---------- catalog

_COLUMNS = ["path", "size", "mod", "is_dir", "name", "path_lower", "dir_lower", "base_off", "path_len", "ext"]


@query("s1_catalog", f"select path, size, mod, is_dir, name, path_lower, dir_lower, cast(base_off as int) as base_off, cast(path_len as int) as path_len, ext from {LATEST_SQL}")
def _(spark, sf_dir):
    return trees.snapshot(spark, sf_dir).select(*_COLUMNS)


_FOLDERS = f"""with f as (select path, size, mod, is_dir from {DOCUMENTS_SQL}),
up as (select unnest(list_transform(range(2, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) as path, mod from f)
select path, cast(0 as bigint) as size, max(mod) as mod, true as is_dir from up group by path union all select * from f"""


@query("s1_folders", _FOLDERS)
def _(spark, sf_dir):
    return with_folders(trees.documents(spark, sf_dir).select("path", "size", "mod", "is_dir"))


_EXCLUDED = "('" + "','".join([*(x.lower() for x in DEFAULT_EXCLUDES), "tmp"]) + "')"


@query("s3_exclude", f"select path from {LATEST_SQL} where len(list_filter(regexp_split_to_array(lower(path), '[\\\\/]'), lambda p: p in {_EXCLUDED})) = 0")
def _(spark, sf_dir):
    return trees.snapshot(spark, sf_dir).where(~below_excluded(F.col("path"), (*DEFAULT_EXCLUDES, "tmp"))).select("path")


@query("k1_roundtrip", f"select path, size, mod, is_dir, ext from {LATEST_SQL}")
def _(spark, sf_dir):
    store = CatalogStore(spark, f"{shared_folder(spark)}/catalog-{uuid.uuid4().hex}")
    store.save(trees.snapshot(spark, sf_dir), roots=["/"], created=NOW)
    return store.load().select("path", "size", "mod", "is_dir", "ext")


# ---------- filters

_match("f1_dirs", "is:dir", "is_dir")
_match("f1_files", "is:file", "not is_dir")
_match("f2_size_range", "1mb..1gb", "not is_dir and size between 1048576 and 1073741824")
_match("f2_size_over", "size:>1.5mb", "not is_dir and size >= 1572864")
_match("f3_mod_range", ">30d <2y", f"mod <= {NOW - 30 * 86400} and mod >= {NOW - 730 * 86400}")
_match("f4_ext_dotfile", "ext:txt,py,bundlerc", "not is_dir and (ext in ('txt','py','bundlerc') or name in ('.txt', '.py', '.bundlerc') or (name like '.%' and lower(substr(name, 2)) in ('txt','py','bundlerc')))")
_match("f5_in_abs", "/srv/common", "path_lower = '/srv/common' or starts_with(path_lower, '/srv/common/') or starts_with(path_lower, '/srv/common\\')")
_match("f6_in_rel", "in:music", "contains(dir_lower, 'music')")
_match("f8_yesterday", "yesterday", f"mod between {NOW - 86400} and {NOW}")
_match("f8_month", "month", f"mod >= {NOW - 30 * 86400}")
_match("q14_kind_image", "is:images", "not is_dir and (ext in ('" + "','".join(KINDS["image"]) + "') or (name like '.%' and lower(substr(name, 2)) in ('" + "','".join(KINDS["image"]) + "')))")
_match("q_combined", "report .pdf,.md >1kb year /srv", f"not is_dir and size >= 1024 and mod >= {NOW - 365 * 86400} and (ext in ('pdf','md') or lower(substr(name, 2)) in ('pdf','md') and name like '.%') and starts_with(path_lower, '/srv/') and regexp_matches(path_lower, '^[^r]*r[^e]*e[^p]*p[^o]*o[^r]*r[^t]*t')")

_match("f7_relative", "in:./srv/Common/", "path_lower = '/srv/common' or starts_with(path_lower, '/srv/common/') or starts_with(path_lower, '/srv/common\\')")
_match("f7_together", "is:file >1kb <3y .md,.txt,.pdf /srv", f"not is_dir and size >= 1024 and mod >= {NOW - 3 * 365 * 86400} and (ext in ('md', 'txt', 'pdf') or name like '.%' and lower(substr(name, 2)) in ('md', 'txt', 'pdf')) and starts_with(path_lower, '/srv/')")
_match("f8_today", "today", f"mod >= {NOW // 86400 * 86400}")

# ---------- text words

_match("t1_not", "!archive", "not contains(path_lower, 'archive')")
_match("t2_exact_match", "'budget", "contains(path_lower, 'budget')")
_match("t6_fuzzy_match", "rprt", "regexp_matches(path_lower, '^[^r]*r[^p]*p[^r]*r[^t]*t')")
_rank("t2_exact", "'report", "contains(path_lower, 'report')", f"16 * 6 + case when strlen(substr(path_lower, 1, instr(path_lower, 'report') - 1)) >= base_off then 40 else 0 end - {_LEN}")
_rank("t3_prefix", "^annual", "starts_with(name_lower, 'annual')", f"16 * 6 + 60 - {_LEN}")
_rank("t4_suffix", "gz$", "ends_with(path_lower, 'gz')", f"32 - {_LEN}")
_rank("t4_suffix_prefix", "^doc .md md$", "starts_with(name_lower, 'doc') and ext = 'md' and ends_with(path_lower, 'md')", f"16 * 3 + 60 + 32 + 50 - {_LEN}")
_rank("t6_fuzzy", "rpt", "true", f"({fuzzy_term_sql('rpt')}).p - {_LEN}")
_rank("t6_fuzzy_camel", "ar01", "true", f"({fuzzy_term_sql('ar01')}).p - {_LEN}")
_two = f"(select (a).p + (b).p + case when (a).i and (b).i then 50 else 0 end from (select {fuzzy_term_sql('wiki')} as a, {fuzzy_term_sql('nual')} as b))"
_rank("t7_multi_term", "wiki nual", "true", f"{_two} - {_LEN}")
_mixed = f"(select (a).p + 16 * 2 + case when (a).i and inside then 50 else 0 end from (select {fuzzy_term_sql('doc')} as a, strlen(name) >= 2 as inside))"
_rank("t7_mixed", "doc !html md$", "not contains(path_lower, 'html') and ends_with(path_lower, 'md')", f"{_mixed} - {_LEN}")


@query("t5_name", top_sql(LATEST_SQL, "is_dir", f"{fuzzy_sql('name_lower', 'name', 'doc')} + 40 + case when strlen(name) = 3 then 25 else 0 end - {_LEN}", 300))
def _(spark, sf_dir):
    return search.find(trees.snapshot(spark, sf_dir), plan("doc/"), 300)


# ---------- order and limits

_rank("o1_topk_relevance", "doc .md", "ext = 'md' and not is_dir", f"({fuzzy_term_sql('doc')}).p - {_LEN}", 20)
_rank("o2_newest", ".py", "ext = 'py' and not is_dir", "mod", 50, "newest")
_rank("o2_largest", "is:file", "not is_dir", "size", 50, "largest")
_rank("o2_no_terms", ".go", "ext = 'go' and not is_dir", "mod", 50)


@query("o5_defaults", top_sql(DOCUMENTS_SQL, "true", f"({fuzzy_term_sql('doc')}).p - {_LEN}", 50))
def _(spark, sf_dir):
    return search.find(trees.documents(spark, sf_dir), plan("doc"))


@query("k5_pick", "select path from (" + top_sql(DOCUMENTS_SQL, "ext = 'md' and not is_dir", f"({fuzzy_term_sql('doc')}).p - {_LEN}", 1) + ")")
def _(spark, sf_dir):
    return search.find(trees.documents(spark, sf_dir), plan("doc .md"), 1).select("path")


@query("k3_find", "with f as (" + top_sql(LATEST_SQL, "not is_dir and ext = 'go'", "mod", 50) + f") select path, rank, (select count(*) from {LATEST_SQL} where not is_dir and (ext = 'go' or name = '.go')) as total from f")
def _(spark, sf_dir):
    """The rows that the command prints, and the total it reports beside them."""
    entries, p = trees.snapshot(spark, sf_dir), plan(".go")
    return search.find(entries, p, sort="newest").select("path", "rank").crossJoin(F.broadcast(search.total(entries, p)))  # one row


@query("o4_total", f"select count(*) as total from {LATEST_SQL} where not is_dir and size >= 1048576")
def _(spark, sf_dir):
    return search.total(trees.snapshot(spark, sf_dir), plan(">1mb"))


@query("o9_page", top_sql(DOCUMENTS_SQL, "not is_dir", "size", 25, 50))
def _(spark, sf_dir):
    return search.find(trees.documents(spark, sf_dir), plan("is:file"), 25, "largest", offset=50)


@query("o8_keep_position", "select cast(arg_min(rank, path) - 1 as bigint) as position from (" + top_sql(DOCUMENTS_SQL, "ext = 'py'", "mod", 50) + ")")
def _(spark, sf_dir):
    page = search.find(trees.documents(spark, sf_dir), plan(".py"), 50)
    return search.keep_position(page, page.agg(F.min("path").alias("path")).first().path)


@query("o8_keep_position_gone", "select cast(0 as bigint) as position from (select count(*) from documents)")
def _(spark, sf_dir):
    return search.keep_position(search.find(trees.documents(spark, sf_dir), plan(".py"), 50), "/no such path")


_NAME_AT = "(length(path) - length(name))"


def offsets_sql(low: str, base: str, text: str) -> str:
    """Character offsets of a fuzzy word, unrolled by character."""
    esc = lambda c: "\\" + c if c in "\\^-[].()" else c
    forward = "^" + "".join(f"[^{esc(c)}]*{esc(c)}" for c in text)
    backward = "^" + esc(text[-1]) + "".join(f"[^{esc(c)}]*{esc(c)}" for c in reversed(text[:-1]))
    parts = "^" + esc(text[0]) + "".join(f"([^{esc(c)}]*){esc(c)}" for c in text[1:]) + "$"
    places = ["(length(pre) - length(win))"]
    for k in range(1, len(text)):
        places.append(f"{places[-1]} + 1 + length(regexp_extract(win, '{parts}', {k}))")
    return f"(select [{', '.join(f'cast({base} + {x} as int)' for x in places)}] from (select pre, reverse(regexp_extract(reverse(pre), '{backward}')) as win from (select regexp_extract({low}, '{forward}') as pre)))"


def fuzzy_offsets_sql(text: str) -> str:
    """Offsets in the path: within the name if the word scores there."""
    return f"case when ({fuzzy_term_sql(text)}).i then {offsets_sql('name_lower', _NAME_AT, text)} else {offsets_sql('path_lower', '0', text)} end"


def _offsets(name: str, line: str, where: str, offsets: str) -> None:
    """A query for the highlighted offsets of every match."""

    @query(name, f"select path, {offsets} as offsets from {DOCUMENTS_SQL} where {where}")
    def run(spark, sf_dir):
        p = plan(line)
        return search.matching(trees.documents(spark, sf_dir), p).select("path", search.match_positions(p).alias("offsets"))


_offsets("t11_prefix", "^doc", "starts_with(name_lower, 'doc')", f"[cast(x as int) for x in range({_NAME_AT}, {_NAME_AT} + 3)]")
_offsets("t11_exact", "'port", "contains(path_lower, 'port')", "[cast(x as int) for x in range(instr(path_lower, 'port') - 1, instr(path_lower, 'port') + 3)]")
_offsets("t11_suffix", "md$", "ends_with(path_lower, 'md')", "[cast(x as int) for x in range(length(path) - 2, length(path))]")
_offsets("t11_fuzzy", "rpt", "regexp_matches(path_lower, '^[^r]*r[^p]*p[^t]*t')", fuzzy_offsets_sql("rpt"))
_offsets("t11_several", "wiki 'al txt$", "regexp_matches(path_lower, '^[^w]*w[^i]*i[^k]*k[^i]*i') and contains(path_lower, 'al') and ends_with(path_lower, 'txt')", f"list_sort(list_distinct(list_concat({fuzzy_offsets_sql('wiki')}, [cast(x as int) for x in range(instr(path_lower, 'al') - 1, instr(path_lower, 'al') + 1)], [cast(x as int) for x in range(length(path) - 3, length(path))])))")


@query(
    "t12_runs",
    f"""with o as (select path, name, [x - {_NAME_AT} for x in {fuzzy_offsets_sql('dc')} if x >= {_NAME_AT}] as offs from {DOCUMENTS_SQL} where regexp_matches(path_lower, '^[^d]*d[^c]*c'))
select path, cast(1 + len([i for i in range(1, length(name)) if list_contains(offs, i) <> list_contains(offs, i - 1)]) as bigint) as runs,
array_to_string([substr(name, cast(i + 1 as int), 1) for i in range(0, length(name)) if list_contains(offs, i)], '') as matched from o""",
)
def _(spark, sf_dir):
    p = plan("dc")
    name_at = F.char_length("path") - F.char_length("name")
    inside = F.filter(F.transform(search.match_positions(p), lambda x: (x - name_at).cast("int")), lambda x: x >= 0)
    runs = search.matching(trees.documents(spark, sf_dir), p).select("path", search.highlight_runs(F.col("name"), inside).alias("r"))
    return runs.select("path", F.size("r").cast("bigint").alias("runs"), F.concat_ws("", F.transform(F.filter("r", lambda x: x["matched"]), lambda x: x["text"])).alias("matched"))


# ---------- content search


def grep_sql(at: str, found: str, where: str, n: int | None = 500, per_file: int | None = 100) -> str:
    """Hits over the documents; ``at`` is the 0-based place of the match in ``raw``."""
    head = "coalesce((select max(k) from unnest(range(0, 401)) t(k) where strlen(substr(rest, 1, k)) <= 400), 0)"
    cut = f"case when strlen(rest) <= 400 then rest else substr(rest, 1, {head}) || case when strlen(substr(rest, 1, {head})) < 400 then '?' else '' end end"
    limit = f" qualify row_number() over (order by path, line) <= {n}" if n is not None else ""
    cap = f" qualify row_number() over (partition by path order by line) <= {per_file}" if per_file is not None else ""
    return f"""with l as (select path, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as line from {CONTENTS_SQL}),
h as (select path, line, raw, {at} as hit_at, {found} as found, regexp_replace(raw, '\\r+$', '') as body from l where {where}),
b as (select *, least(length(regexp_extract(body, '^[ \\t]*')), hit_at) as blank from h),
s as (select *, case when hit_at - blank > 80 then hit_at - 40 else blank end as start from b),
r as (select *, substr(body, start + 1) as rest from s),
a as (select *, substr(rest, 1, hit_at - start) as ahead from r{cap})
select path, cast(line as int) as line, cast(strlen(ahead) + length(ahead) - length(replace(ahead, chr(9), '')) as int) as col, cast(strlen(found) as int) as mlen,
replace({cut}, chr(9), '  ') as text from a{limit}"""


def _literal(name: str, pattern: str, n: int | None = 500, per_file: int | None = 100) -> None:
    low = f"translate(raw, '{trees.UPPER}', '{trees.LOWER}')" if pattern == pattern.lower() else "raw"
    at = f"instr({low}, '{pattern}') - 1"

    @query(name, grep_sql(at, f"substr(raw, {at} + 1, {len(pattern)})", f"contains({low}, '{pattern}')", n, per_file))
    def run(spark, sf_dir):
        return grep.grep(trees.contents(spark, sf_dir), grep.Matcher(pattern), n, per_file)


def _regex(name: str, pattern: str, n: int | None = None) -> None:
    re2 = pattern if any(c.isupper() for c in pattern) else "(?i)" + pattern
    found = f"regexp_extract(raw, '{re2}')"

    @query(name, grep_sql(f"instr(raw, {found}) - 1", found, f"{found} <> ''", n))
    def run(spark, sf_dir):
        return grep.grep(trees.contents(spark, sf_dir), grep.Matcher(pattern, regex=True), n)


_literal("g_literal", "archive", None)
_literal("g_smartcase", "Roughly", None)
_literal("g_top", "folder")
_literal("g_per_file_cap", "the", None, 3)
_regex("g_regex", "v[0-9]+\\.[0-9]+\\.[0-9]+")
_regex("g_regex_case", "U\\.S\\. [a-z]+")


# Lines with tabs, carriage returns and capitals: every blank a tab, every line of the text twice, the second in capitals.
_HOSTILE = f"(select path, replace(text, ' ', chr(9)) || chr(13) || chr(13) || chr(10) || translate(replace(text, chr(10), chr(13) || chr(10)), '{trees.LOWER}', '{trees.UPPER}') as text from {CONTENTS_SQL})"


def _hostile(spark, sf_dir):
    tabbed = F.concat(F.replace("text", F.lit(" "), F.lit("\t")), F.lit("\r\r\n"), F.translate(F.replace("text", F.lit("\n"), F.lit("\r\n")), trees.LOWER, trees.UPPER))
    return trees.contents(spark, sf_dir).select("path", tabbed.alias("text"))


@query("g10_hostile_lines", grep_sql("instr(low, 'archive') - 1", "substr(raw, instr(low, 'archive'), 7)", "contains(low, 'archive')", None, None).replace(CONTENTS_SQL, _HOSTILE).replace("h as (select path, line, raw,", f"m as (select *, translate(raw, '{trees.UPPER}', '{trees.LOWER}') as low from l), h as (select path, line, raw,").replace(" from l where", " from m where"))
def _(spark, sf_dir):
    return grep.grep(_hostile(spark, sf_dir), grep.Matcher("archive"), None, None)


@query("g3_binary_gate", f"select path, (length(path) % 3 = 0) as is_binary from {CONTENTS_SQL}")
def _(spark, sf_dir):
    """A zero byte at the front of every text whose path has a length divisible by three hides the file from content search."""
    raw = F.when(F.char_length("path") % 3 == 0, F.concat(F.lit(b"\x00"), F.encode("text", "utf-8"))).otherwise(F.encode("text", "utf-8"))
    return trees.contents(spark, sf_dir).select("path", grep.text_of_bytes(raw).isNull().alias("is_binary"))


_CONTROLS = "repeat(chr(1), length(path) % 17) || substr(text, 1, 200)"


@query("x10_looks_like_text", f"select path, (length(t) - length(regexp_replace(t, '[\\x00-\\x08\\x0b\\x0e-\\x1f\\x7f]', '', 'g'))) * 20 < greatest(length(t), 1) as is_text from (select path, {_CONTROLS} as t from {CONTENTS_SQL})")
def _(spark, sf_dir):
    mixed = F.concat(F.repeat(F.lit("\x01"), F.char_length("path") % 17), F.substring("text", 1, 200))
    return trees.contents(spark, sf_dir).select("path", display.looks_like_text(mixed).alias("is_text"))


_WHOLE = "coalesce((select max(k) from unnest(range(0, 102)) t(k) where strlen(substr(text, 1, k)) <= 101), 0)"


@query("x11_valid_utf8", f"select path, case when strlen(text) <= 101 then text else substr(text, 1, {_WHOLE}) || case when strlen(substr(text, 1, {_WHOLE})) < 101 then '?' else '' end end as cut from {CONTENTS_SQL}")
def _(spark, sf_dir):
    """The first 101 bytes of each text, which may end inside a character."""
    return trees.contents(spark, sf_dir).select("path", display.valid_utf8(F.substring(F.encode("text", "utf-8"), F.lit(1), F.lit(101))).alias("cut"))


_Q9 = "regexp_extract(raw, '^The [a-z]+')"


@query("q9_marks_in_patterns", grep_sql(f"instr(raw, {_Q9}) - 1", _Q9, f"{_Q9} <> ''", None, None))
def _(spark, sf_dir):
    """A text word keeps its mark in the pattern of a content search."""
    return grep.grep(trees.contents(spark, sf_dir), grep.Matcher(plan("^The [a-z]+").pattern, regex=True), None, None)


@query("a5_counters", f"select count(*) as files, count(*) filter (contains(text, 'Roughly')) as files_with_hits, cast(sum(len(list_filter(string_split(text, chr(10)), lambda l: contains(l, 'Roughly')))) as bigint) as hits from {CONTENTS_SQL}")
def _(spark, sf_dir):
    """What a content search has read and found, from the metrics of its own run."""
    read, found = Observation(), Observation()
    files = trees.contents(spark, sf_dir).observe(read, F.count(F.lit(1)).alias("files"))
    hits = grep.grep(files, grep.Matcher("Roughly"), None, None).observe(found, F.count(F.lit(1)).alias("hits"))
    with_hits = hits.select("path").distinct().count()
    return spark.createDataFrame([(read.get["files"], with_hits, found.get["hits"])], "files bigint, files_with_hits bigint, hits bigint")


@query("g2_candidates", f"select path from {LATEST_SQL} where not is_dir and size between 1 and 16777216 and ext not in ('" + "','".join(grep.BINARY_EXTENSIONS) + "') and contains(dir_lower, 'src')")
def _(spark, sf_dir):
    return grep.candidates(trees.snapshot(spark, sf_dir), plan("in:src")).select("path")


@query("g12_group_header", "select path, line, case when row_number() over (partition by path order by line) = 1 then path else '' end as header from (" + grep_sql("instr(raw, 'Roughly') - 1", "'Roughly'", "contains(raw, 'Roughly')", None) + ")")
def _(spark, sf_dir):
    return grep.group_headers(grep.grep(trees.contents(spark, sf_dir), grep.Matcher("Roughly"), None)).select("path", "line", "header")


@query("k4_grep_lines", "select path || ':' || line || ': ' || text as out from (" + grep_sql("instr(raw, 'Really') - 1", "'Really'", "contains(raw, 'Really')", None) + ")")
def _(spark, sf_dir):
    return grep.hit_lines(grep.grep(trees.contents(spark, sf_dir), grep.Matcher("Really"), None))


# ---------- aggregations and display


@query("a1_counts", f"select count(*) filter (not is_dir) as files, count(*) filter (is_dir) as dirs from {LATEST_SQL}")
def _(spark, sf_dir):
    return stats.counts(trees.snapshot(spark, sf_dir))


@query("a2_stats", f"select count(*) filter (not is_dir) as files, count(*) filter (is_dir) as dirs, cast(sum(size) as bigint) as bytes, cast(sum(path_len) as bigint) as path_bytes from {LATEST_SQL}")
def _(spark, sf_dir):
    return stats.stats(trees.snapshot(spark, sf_dir))


@query("a7_folder_counts", f"select regexp_replace(path, '[\\\\/][^\\\\/]*$', '') as parent, count(*) filter (not is_dir) as files, count(*) filter (is_dir) as dirs from {LATEST_SQL} group by all")
def _(spark, sf_dir):
    return stats.folder_counts(trees.snapshot(spark, sf_dir))


@query("a8_changes_per_minute", "select cast(floor(epoch(arrival_ts) / 60) as bigint) as minute, count(*) as n from path_changes where arrival_ts is not null group by all")
def _(spark, sf_dir):
    return stats.changes_per_minute(table(spark, sf_dir, "path_changes")).select(F.floor(F.unix_seconds("minute") / 60).alias("minute"), "n")


_UNIT = "case when size < 1024 then cast(size as varchar) || ' B' " + " ".join(
    f"when size < {1024 ** (i + 1)} then case when size / {float(1024**i)!r} < 10 then printf('%.1f {u}', size / {float(1024**i)!r}) else printf('%.0f {u}', size / {float(1024**i)!r}) end" for i, u in enumerate(("KB", "MB", "GB", "TB"), 1)
) + f" else case when size / {float(1024**5)!r} < 10 then printf('%.1f PB', size / {float(1024**5)!r}) else printf('%.0f PB', size / {float(1024**5)!r}) end end"


@query("x4_human_size", f"select path, {_UNIT} as size_text from {LATEST_SQL}")
def _(spark, sf_dir):
    return trees.snapshot(spark, sf_dir).select("path", display.human_size(F.col("size")).alias("size_text"))


_AGE = f"({NOW} - mod)"


@query(
    "x5_human_age",
    f"""select path, case when {_AGE} < 0 then 'future' when {_AGE} < 60 then 'now' when {_AGE} < 3600 then ({_AGE} // 60) || 'm ago' when {_AGE} < 86400 then ({_AGE} // 3600) || 'h ago'
when {_AGE} < 30 * 86400 then ({_AGE} // 86400) || 'd ago' when {_AGE} < 365 * 86400 then ({_AGE} // (30 * 86400)) || 'mo ago' else ({_AGE} // (365 * 86400)) || 'y ago' end as age_text from {LATEST_SQL}""",
)
def _(spark, sf_dir):
    return trees.snapshot(spark, sf_dir).select("path", display.human_age(F.col("mod"), NOW).alias("age_text"))


@query("x6_commas", f"select path, format('{{:,}}', size) as size_commas from {LATEST_SQL}")
def _(spark, sf_dir):
    return trees.snapshot(spark, sf_dir).select("path", display.commas(F.col("size")).alias("size_commas"))


@query("x9_shorten", f"select path, case when length(path) <= 24 then path else '…' || right(path, 23) end as short from {LATEST_SQL}")
def _(spark, sf_dir):
    return trees.snapshot(spark, sf_dir).select("path", display.shorten_left(F.col("path"), 24).alias("short"))


_CATEGORY = "case when is_dir then 'dir' " + " ".join("when ext in ('" + "','".join(KINDS[k]) + f"') then '{stats.CATEGORIES[k][0]}'" for k in KINDS) + " else 'other' end"


@query("x8_category", f"select {_CATEGORY} as category, count(*) as n from {LATEST_SQL} group by all")
def _(spark, sf_dir):
    return stats.with_category(trees.snapshot(spark, sf_dir)).groupBy("category").agg(F.count("*").alias("n"))


# ---------- previews

_LINES = f"string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(9), '    '), chr(10))"


@query("v1_preview", f"select path || ':0' as key, len({_LINES}[1:400]) as shown, {_LINES}[1] as first_text, case when text = '' then 'empty' else '' end as note from {CONTENTS_SQL}")
def _(spark, sf_dir):
    p = stats.preview(trees.contents(spark, sf_dir))
    return p.select("key", F.greatest(F.size("lines"), F.when(F.col("note") == "empty", 1).otherwise(0)).cast("bigint").alias("shown"), F.coalesce(F.try_element_at("lines", F.lit(1)), F.lit("")).alias("first_text"), "note")


@query("v2_preview_window", f"select path || ':200' as key, len({_LINES}[50:449]) as shown, {_LINES}[50] as first_text from {CONTENTS_SQL} where len({_LINES}) >= 50")
def _(spark, sf_dir):
    p = stats.preview(trees.contents(spark, sf_dir), line=200).where(F.size("lines") > 0)
    return p.select("key", F.size("lines").cast("bigint").alias("shown"), F.element_at("lines", 1).alias("first_text"))


_BIGGEST = f"(select regexp_replace(path, '[\\\\/][^\\\\/]*$', '') as parent from {LATEST_SQL} group by 1 order by count(*) desc, 1 limit 1)"


@query("v3_folder_listing", f"select name, is_dir, size from {LATEST_SQL} where regexp_replace(path, '[\\\\/][^\\\\/]*$', '') = {_BIGGEST} order by is_dir desc, lower(name), name limit 500")
def _(spark, sf_dir):
    entries = trees.snapshot(spark, sf_dir)
    top = stats.folder_counts(entries).orderBy((F.col("files") + F.col("dirs")).desc(), "parent").first().parent
    return stats.folder_listing(entries, top).select("name", "is_dir", "size")


# ---------- changes

_UP = "list_transform(range(2, len(string_split(path, '/')) + 1), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))"
_CHANGES = f"""with old as (select path, size, mod, is_dir from {BEFORE_SQL}), cur as (select path, size, mod, is_dir from {LATEST_SQL}),
ch as (select distinct path from path_changes where path is not null),
k as (select ch.path, old.is_dir as was_dir, cur.is_dir, cur.size, cur.mod, case when cur.is_dir is null and old.is_dir is null then 'none' when cur.is_dir is null then 'remove'
 when cur.is_dir and not coalesce(old.is_dir, false) then 'walk' when not cur.is_dir and coalesce(old.is_dir, false) then 'retype' else 'refresh' end as effect
 from ch left join old on old.path = ch.path left join cur on cur.path = ch.path),
trees as (select path from k where effect in ('remove', 'walk', 'retype')),
old_up as (select path, unnest({_UP}) as above from old), cur_up as (select path, unnest({_UP}) as above from cur), k_up as (select path, unnest({_UP}) as above from k where is_dir is not null)
"""


def _state(spark, sf_dir):
    return trees.snapshot(spark, sf_dir, 1), table(spark, sf_dir, "path_changes"), trees.snapshot(spark, sf_dir)


@query("j2_classify", _CHANGES + "select path, effect from k")
def _(spark, sf_dir):
    old, notices, now = _state(spark, sf_dir)
    return changes.classify(notices, old, now).select("path", "effect")


_LEFT_OUT = ("src", "lib", "docs", "archive", "old", "music", "photos")


@query("j6_excluded", _CHANGES + f"select path, effect from k where len(list_filter(regexp_split_to_array(lower(path), '[\\\\/]'), lambda p: p in {_LEFT_OUT})) = 0")
def _(spark, sf_dir):
    """Notices below an excluded folder, in any letter case, change nothing."""
    old, notices, now = _state(spark, sf_dir)
    return changes.classify(notices, old, now, _LEFT_OUT).select("path", "effect")


@query("j3_self_remove", _CHANGES + "select path from old where path not in (select path from ch)")
def _(spark, sf_dir):
    old, notices, _now = _state(spark, sf_dir)
    return old.select("path").join(notices.select("path").where("path is not null").distinct(), "path", "left_anti")


@query("j4_subtree_remove", _CHANGES + "select path from old where path not in (select path from old_up where above in (select path from trees))")
def _(spark, sf_dir):
    old, notices, now = _state(spark, sf_dir)
    gone = changes.classify(notices, old, now).where("effect in ('remove', 'walk', 'retype')")
    return changes.in_subtrees(old.select("path"), gone, "left_anti")


@query("j5_subsumed", _CHANGES + "select path from k where is_dir is not null and path in (select path from k_up where above <> path and above in (select path from trees))")
def _(spark, sf_dir):
    old, notices, now = _state(spark, sf_dir)
    known = changes.classify(notices, old, now)
    return changes.in_subtrees(known.where("is_dir is not null").select("path"), known.where("effect in ('remove', 'walk', 'retype')"), strictly=True)


@query(
    "j8_apply_changes",
    _CHANGES
    + """select path, size, mod, is_dir from old where path not in (select path from k) and path not in (select path from old_up where above in (select path from trees))
union all (select path, size, mod, is_dir from cur where path in (select path from cur_up where above in (select path from k where effect = 'walk'))
union select path, size, mod, is_dir from k where is_dir is not null and path not in (select path from k_up where above <> path and above in (select path from trees)))""",
)
def _(spark, sf_dir):
    old, notices, now = _state(spark, sf_dir)
    return changes.apply_changes(old, notices, now)


_CATALOG = ["path", "size", "mod", "is_dir"]


@query("u1_publish", ORACLE["j8_apply_changes"])
def _(spark, sf_dir):
    """The change batch published beside its base, as a reader sees both."""
    old, notices, now = _state(spark, sf_dir)
    store = CatalogStore(spark, f"{shared_folder(spark)}/catalog-{uuid.uuid4().hex}")
    store.save(old, roots=["/"], created=NOW)
    store.publish(changes.change_ops(store.load(), notices, now), created=NOW)
    return store.load().select(*_CATALOG)


@query("u2_readers_keep_their_version", f"select path, size, mod, is_dir from {BEFORE_SQL}")
def _(spark, sf_dir):
    """What a reader sees that opened a catalog before the next version was saved and the batch published."""
    old, notices, now = _state(spark, sf_dir)
    store = CatalogStore(spark, f"{shared_folder(spark)}/catalog-{uuid.uuid4().hex}")
    store.save(old, roots=["/"], created=NOW)
    reader = store.load().select(*_CATALOG)
    store.publish(changes.change_ops(reader, notices, now), created=NOW)
    store.save(now, roots=["/"], created=NOW)
    return reader


@query("u5_accepted", f"select distinct path from path_changes where path is not null and not starts_with(lower(path), '/srv/common') and len(list_filter(regexp_split_to_array(lower(path), '[\\\\/]'), lambda p: p in {_LEFT_OUT})) = 0")
def _(spark, sf_dir):
    from skerry.streaming.updates import accepted

    notices = table(spark, sf_dir, "path_changes").select("path", F.lit(False).alias("lost"))
    return accepted(notices, "/SRV/common", _LEFT_OUT).select("path").distinct()


@query(
    "u4_debounce",
    """with recursive e as (select path, epoch_us(arrival_ts) // 1000 as ms from path_changes where path is not null and arrival_ts is not null),
t as (select distinct ms from e), g as (select ms, ms - lag(ms) over (order by ms) as gap from t),
r as (select ms, sum(case when gap is null or gap > 300 then 1 else 0 end) over (order by ms) as run from g),
b as (select run, min(ms) as start from r group by run union all select r.run, min(r.ms) from b join r on r.run = b.run and r.ms > b.start + 2000 group by r.run)
select start as batch_ms, path, count(*) as n from (select e.path, max(b.start) as start, e.ms, count(*) over () from e join r using (ms) join b on b.run = r.run and b.start <= e.ms group by e.path, e.ms, r.run) s
join e using (path, ms) group by all""",
)
def _(spark, sf_dir):
    return changes.debounce_batches(table(spark, sf_dir, "path_changes"))


@query("u12_stream_tally", "select cast(floor(epoch(arrival_ts) / 60) as bigint) as minute, count(*) as n from path_changes where arrival_ts is not null group by all")
def _(spark, sf_dir):
    from skerry.streaming.updates import stream_tally

    return stream_tally(spark, f"{sf_dir}/path_changes.parquet")
