"""Content search: candidate files, a cheap rejection of whole files, lines, and the first match of each line."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions.paths import ascii_lower
from skerry.operators.predicates import filters
from skerry.operators.score import bind
from skerry.plans.language import SearchPlan

LARGEST_FILE = 16 << 20
SNIFF_BYTES = 8000
HITS_PER_FILE = 100
GREP_ROWS = 500
SNIPPET_BYTES = 400
LEAD, KEEP = 80, 40
# Extensions whose content is never text (fixed values).
BINARY_EXTENSIONS = tuple(
    """exe dll sys bin obj o a lib so dylib pdb iso img vhd vhdx dmg msi cab
    zip 7z rar gz tgz bz2 xz zst tar jar war apk ipa nupkg whl
    png jpg jpeg gif bmp ico tif tiff webp heic psd raw cr2 nef avif
    mp3 wav flac ogg m4a aac wma mp4 mkv avi mov wmv webm flv m4v
    pdf doc docx xls xlsx ppt pptx odt ods odp epub mobi
    ttf otf woff woff2 eot class pyc pyd db sqlite mdb accdb dat pak blob
    lnk node wasm""".split()
)
_UNSUPPORTED = re.compile(r"\(\?(?:=|!|<=|<!|>)|\\[1-9]|\\k<|(?<!\\)[*+?}]\+")


@dataclass(frozen=True)
class Matcher:
    """A literal or regular expression with smart case: any capital letter makes it case-sensitive."""

    pattern: str
    regex: bool = False

    def __post_init__(self) -> None:
        if not self.pattern:
            raise ValueError("nothing to search for")
        if self.regex and _UNSUPPORTED.search(self.pattern):
            raise ValueError("look-around, back-references and possessive quantifiers are not supported")

    @property
    def sensitive(self) -> bool:
        return any(c.isupper() for c in self.pattern)

    @property
    def expression(self) -> str:
        """The pattern in the dialect of the engine; only a line feed ends a line."""
        return ("(?d)" if self.sensitive else "(?diu)") + self.pattern

    def _literal(self) -> str:
        return self.pattern if self.sensitive else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in self.pattern)

    def rejects_file(self, text: Column) -> Column | None:
        """A test of whole files that lets every file with a hit pass; None for a regular expression."""
        if self.regex:
            return None
        return (text if self.sensitive else ascii_lower(text)).contains(self._literal())

    def first(self, line: Column) -> Column:
        """(at, text): 0-based character position and text of the leftmost match; NULL if there is none or it is empty."""
        if self.regex:
            found = F.regexp_substr(line, F.lit(self.expression))
            at = F.regexp_instr(line, F.lit(self.expression)) - 1
            return F.when(F.octet_length(found) > 0, F.struct(at.alias("at"), found.alias("text")))
        at = F.instr(line if self.sensitive else ascii_lower(line), self._literal()) - 1
        return F.when(at >= 0, F.struct(at.alias("at"), F.substring(line, at + 1, F.lit(len(self.pattern))).alias("text")))


def candidates(entries: DataFrame, plan: SearchPlan) -> DataFrame:
    """Files whose content is worth reading; text words of the plan are the pattern, not a filter."""
    return entries.where(~F.col("is_dir") & F.col("size").between(1, LARGEST_FILE)).where(~F.col("ext").isin(list(BINARY_EXTENSIONS))).where(filters(plan))


def text_of_bytes(content: Column) -> Column:
    """File bytes as text, NULL for a file with a zero byte near its start."""
    binary = F.contains(F.substring(content, 1, SNIFF_BYTES), F.lit(b"\x00"))
    return F.when(~binary, F.make_valid_utf8(content.cast("string")))


def snippet(line: Column, at: Column) -> Column:
    """(text, col) to show of a line: starts near the match, tabs as two spaces, at most 400 bytes."""
    body = F.regexp_replace(line, r"\r+\z", "")
    blank = F.char_length(F.regexp_extract(body, "^[ \t]*", 0))
    start = F.least(blank, at)
    start = F.when(at - start > LEAD, at - KEEP).otherwise(start)

    def shown(begin: Column) -> Column:
        rest = F.substring(body, begin + 1, F.char_length(body))
        ahead = F.substring(rest, F.lit(1), at - begin)
        tabs = F.char_length(ahead) - F.char_length(F.replace(ahead, F.lit("\t"), F.lit("")))
        head = F.substring(F.encode(rest, "utf-8"), F.lit(1), F.lit(SNIPPET_BYTES))
        text = F.regexp_replace(F.make_valid_utf8(head.cast("string")), "�+", "?")
        return F.struct(F.replace(text, F.lit("\t"), F.lit("  ")).alias("text"), (F.octet_length(ahead) + tabs).cast("int").alias("col"))

    return bind(start, shown)


def grep(contents: DataFrame, matcher: Matcher, n: int | None = GREP_ROWS, per_file: int | None = HITS_PER_FILE) -> DataFrame:
    """(path, line, col, mlen, text): hits of files (path, text), in the order of paths and lines.

    Whole files are rejected before they are split into lines. ``col`` and ``mlen`` count bytes of ``text``.
    """
    files = contents.select("path", F.col("text").alias("body")).where(F.col("body").isNotNull())
    reject = matcher.rejects_file(F.col("body"))
    if reject is not None:
        files = files.where(reject)
    lines = files.select("path", F.posexplode(F.split("body", "\n", -1)).alias("pos", "raw"))
    hits = lines.withColumn("m", matcher.first(F.col("raw"))).where(F.col("m").isNotNull())
    out = hits.withColumn("s", snippet(F.col("raw"), F.col("m.at"))).select(
        "path", (F.col("pos") + 1).cast("int").alias("line"), F.col("s.col").alias("col"), F.octet_length("m.text").cast("int").alias("mlen"), F.col("s.text").alias("text")
    )
    if per_file is not None:
        out = out.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy("line"))).where(F.col("_n") <= per_file).drop("_n")
    return out if n is None else out.orderBy("path", "line").limit(max(0, n))


def group_headers(hits: DataFrame) -> DataFrame:
    """Hits with ``header``: the path on the first hit of each file, empty on the others."""
    w = Window.partitionBy("path").orderBy("line")
    return hits.withColumn("header", F.when(F.row_number().over(w) == 1, F.col("path")).otherwise(""))


def hit_lines(hits: DataFrame) -> DataFrame:
    """(out): ``path:line: text``."""
    return hits.select(F.format_string("%s:%d: %s", "path", "line", "text").alias("out"))
