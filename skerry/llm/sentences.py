"""Sentence units of documents in any script, with character positions.

A text is cut into blocks first (headings, list items, fenced code, paragraphs), then each block into sentences. A period is
disambiguated inside its document: a word is an abbreviation if elsewhere in the document it stands with a period before a
lower-case word or a digit and never without one; a capitalised word that also occurs in lower case opens a sentence, one
that does not may be a name. Where the document has no evidence, counts over the whole corpus decide, then the shape of
the word. Scripts without case, spaces or periods have their own terminators; Thai divides at spaces between Thai letters.

Defined results: NULL, empty and blank texts have no unit; a NULL id is left out; repeated documents are reported each; texts
of any length are processed whole, block by block; an unclosed fence runs to the end; an unpaired quote protects nothing;
extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.arrow import text_stage
from skerry.runtime import cut as cut_lineage
from skerry.runtime import table

#: A word needs this share of all counted period words to enter the corpus statistics, so they hold at most 1/share words.
MIN_SHARE = 1e-5
#: Share of lower-case or digit continuations from which a period word counts as an abbreviation.
ABBREVIATION_SHARE = 0.5

# Abbreviations that stand before a capitalised name (fixed values).
TITLES = set("Mr Mrs Ms Dr Prof St Sr Sra Srta Dra Jr Hr Fr Mme Mlle Dott Sig Gen Col Capt Lt Rev Hon г-н проф".split())
# Months that follow an ordinal day number (fixed values).
MONTHS = set("Januar Februar März April Mai Juni Juli August September Oktober November Dezember Jänner".split())
# Abbreviations known in any document, used only where neither document nor corpus has evidence (fixed values).
KNOWN = set("e.g i.e cf vs approx incl esp resp No Fig pp vol ed z.B d.h u.a bzw ca Nr Abb S Bd p.ex env p.ej pág núm aprox т.е т.д г стр рис см".split())

_FENCE = re.compile(r"[ \t]{0,3}(```+|~~~+)")
_HEADING = re.compile(r"[ \t]{0,3}#{1,6}[ \t]+")
_BULLET = re.compile(r"[ \t]*(?:[-*+•‣◦▪–][ \t]+(?:\[[ xX]\][ \t]+)?)")
_NUMBER = re.compile(r"[ \t]*(?:\(?\d{1,3}[.)]|\(?[a-zA-Z]\)|[०-९]{1,3}[.)]|[0-9]{1,3}、)[ \t]+")
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\n|\r|$)")
_SPACE = " \t\r\n\x0b\x0c\x85\xa0                　"
_PAIRS = re.compile(r"(?<![\w.])\"(?=[^\s\"])[^\"]*?\"|“[^“”]*+[“”]|„[^„“”]*+[“”]|«[^«»]*+»|「[^「」]*+」|『[^『』]*+』|‘[^‘’\n]*?[.!?。！？]’|\((?:[^()]++|\([^()]*+\))*+\)|（[^（）]*+）|【[^【】]*+】|\[[^\[\]]*+\]")
_QUOTES = re.compile("[\"“„«「『‘(（【\\[]")
_CLOSERS = "\"”’»)）」』】]“*_"
_END = re.compile(r"[.!?…。！？｡।॥؟۔]+|(?<=[฀-๿])[ \t\xa0 \r\n]+(?=[฀-๿])|(?<=[฀-๿])[ \t\xa0 \r\n]+(?=[A-Z][a-z]+ [a-z])")
_MARKS = re.compile(r"[.!?…。！？｡।॥؟۔]+")  # all of `_END` in a block without Thai letters
_THAI = re.compile("[\u0e00-\u0e7f]")
_WIDE = set("。！？｡।॥؟۔")
_BEFORE = re.compile(r"[^\s(\[\"“„«]+$")
_ABBREVIATED = re.compile(r"(?:[^\W\d_]\.)*([^\W\d_]+)$")
_CAMEL = re.compile(r"[a-zà-ÿ]+[A-Z]")
_GLUED = re.compile(r"[^\W\d_a-zà-ÿа-яё][^\W\d_A-ZÀ-ÞА-ЯЁ]|[A-ZÀ-Þ][’']|[A-ZÀ-Þ]*[À-Þ][A-ZÀ-Þ]*\s|[A-ZА-ЯЁ]\s|[¿¡«„“]")
_NEXT_WORD = re.compile(r"[^\W\d_]+")


_PERIOD = re.compile(r"\.(?:[)\"”»]?(?=\s+([a-zà-ÿ]+[A-Z]|\w))|,)")
_OPENERS = set(" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000([\"„«“.")
_LOWER_WORD = re.compile(r"(?<![^\W_])[^\W\d_A-ZÀ-ÞА-ЯЁ]+(?![^\W_])")


def period_words(text: str) -> Iterator[tuple[str, str]]:
    """(word, what follows) of the words before a period that is followed by a blank or a comma; the search starts at the periods."""
    for m in _PERIOD.finditer(text):
        end = at = m.start()
        while at and (c := text[at - 1]).isalnum() and not c.isdecimal():
            at -= 1
        if at < end and (not at or text[at - 1] in _OPENERS):
            yield text[at:end], m[1] or ""


class Evidence:
    """What one document and the corpus say about words with periods."""

    def __init__(self, text: str, corpus: dict[str, tuple[int, int]]) -> None:
        self.text, self.corpus = text, corpus
        self.known: dict[str, bool] = {}
        self.counts: dict[str, list[int]] | None = None
        self.lower: set[str] | None = None

    def abbreviation(self, word: str) -> bool:
        known = self.known.get(word)
        if known is None:
            known = self.known[word] = word.lower() != word.upper() and self._abbreviation(word)
        return known

    def _abbreviation(self, word: str) -> bool:
        if self.counts is None:
            self.counts = {}
            for w, c in period_words(self.text):
                n = self.counts.setdefault(w, [0, 0])
                if len(c) < 2 and not (c.isdigit() and len(w) > 4):
                    n[0 if not c or c.islower() or c.isdigit() else 1] += 1
        low, up = self.counts.get(word, (0, 0))
        bare = len(word) > 1 and (f" {word} " in self.text or f" {word}, " in self.text)
        seen, total = self.corpus.get(word, (0, 0))
        if low >= 2 and not bare and not up and (not total or seen / total >= 0.1):
            return True
        if low <= 1 and up + 2 * bare >= 2:
            return False
        low = seen
        if total:
            return low / total >= ABBREVIATION_SHARE
        return word in KNOWN or len(word) == 1

    def opens_sentence(self, word: str) -> bool:
        """True if a capitalised word also occurs in lower case in the document: it is no name."""
        if self.lower is None:
            self.lower = set(_LOWER_WORD.findall(self.text))
        return word.lower() in self.lower

    def ends_sentences(self, word: str) -> bool:
        """True if the corpus knows a period word and does not hold it for an abbreviation."""
        low, total = self.corpus.get(word, (0, 0))
        return total > 0 and low / total < ABBREVIATION_SHARE


def blocks_of(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, code) of headings, items, paragraphs and fenced blocks, without signs and bullets."""
    out: list[tuple[int, int, bool]] = []
    start = None  # of the open block
    last, at, size, listed, fence = 0, 0, len(text), False, None

    def close() -> None:
        nonlocal start
        if start is not None and start < last:
            out.append((start, last, False))
        start = None

    while at < size:
        m = _LINE.match(text, at)
        line, begin, at = m[0], at, m.end()
        body_end = begin + len(line.rstrip("\r\n"))
        mark = _FENCE.match(line)
        if fence:
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not line[mark.end() :].strip():
                out.append((start, body_end, True))
                start, fence = None, None
            last = body_end
            continue
        if mark:
            close()
            start, fence, last = begin + len(line) - len(line.lstrip()), mark[1], body_end
        elif not line.strip(_SPACE):
            close()
            listed = False
        elif h := _HEADING.match(line):
            close()
            start, last = begin + h.end(), body_end
            close()
            listed = False
        elif (b := _BULLET.match(line)) or (start is None or listed) and (b := _NUMBER.match(line)):
            close()
            start, last, listed = begin + b.end(), body_end, True
        else:
            if start is None:
                start, listed = begin, False
            last = body_end
    if fence:
        out.append((start, last, True))
    else:
        close()
    return out


def last_token(block: str, begin: int, end: int) -> re.Match | None:
    """The run without blanks and opening signs that stands before ``end``; the part searched grows until it holds the run."""
    reach = 60
    while True:
        low = max(begin, end - reach)
        found = _BEFORE.search(block, low, end)
        if low == begin or not found or found.start() > low:
            return found
        reach *= 8


def sentences_of(block: str, evidence: Evidence) -> list[tuple[int, int]]:
    """Spans of the sentences of one block."""
    spans = [m.span() for m in _PAIRS.finditer(block)] if _QUOTES.search(block) else []
    out, begin, k, size = [], 0, 0, len(block)

    def cut(end: int) -> None:
        nonlocal begin
        a = begin
        while a < end and block[a] in _SPACE:
            a += 1
        b = end
        while b > a and block[b - 1] in _SPACE:
            b -= 1
        if a < b:
            out.append((a, b))
        begin = end

    at, ends = 0, _END if not block.isascii() and _THAI.search(block) else _MARKS
    while m := ends.search(block, at):
        p, q = m.span()
        while k < len(spans) and spans[k][1] <= p:
            k += 1
        quoted = k < len(spans) and spans[k][0] <= p
        if quoted:
            # Inside quotes or brackets nothing divides; the whole span may be a sentence of its own.
            a, b = spans[k]
            at = b
            inner = block[b - 2] if block[b - 1] in _CLOSERS else ""
            if inner not in ".!?…。！？।؟" or block[begin:a].strip(_SPACE) or (b < size and block[b] not in _SPACE):
                continue
            p, q, char = b, b, "?"
        else:
            at = q
            char = m[0][-1]
            if char in _SPACE:
                cut(p)
                continue
            while q < size and block[q] in _CLOSERS and not (block[q] in "\"*_“" and q + 1 < size and block[q + 1] not in _SPACE and block[q + 1] not in _CLOSERS):
                q += 1
            at = max(at, q)
        n = q
        while n < size and block[n] in _SPACE:
            n += 1
        if n >= size:
            break
        if not quoted and _WIDE.intersection(m[0]):
            cut(q)
            continue
        nxt = n
        while nxt < size - 1 and block[nxt] in "*_`":
            nxt += 1
        c = block[nxt]
        if n == q:  # nothing between the mark and the next character
            if char == "…" and len(m[0]) > 1 and not c.islower() and not c.isupper() and c.isalpha():
                cut(q)
            elif (m[0] != "." or q - p == 1) and _GLUED.match(block, q) and p > begin and (block[p - 1].isalnum() or block[p - 1] in ")\"”»") and not (block[p - 1].isupper() and (p < 2 or not block[p - 2].isalnum())):
                if m[0] != "." or block[p - 1].islower() or block[p - 1].isdigit() or block[p - 1] in ")\"”»" or block[p - 1].isupper():
                    cut(q)
            continue
        if quoted:
            if not (c.islower() and not _CAMEL.match(block, nxt)) and c not in ",;:—–-،":
                cut(q)
            continue
        if char == "…" or m[0].endswith("..."):
            if not c.islower() and c not in ",;:)—–":
                cut(q)
            continue
        if char in "!?":
            if c not in ",;:—–)" and (not c.islower() or q == p + len(m[0]) or _CAMEL.match(block, nxt)):
                cut(q)
            continue
        if c in ",;:)":
            continue
        before = last_token(block, begin, p)
        token = _ABBREVIATED.match(before[0]) if before else None
        word = token[1] if token else ""
        if c.isupper():
            follow = _NEXT_WORD.match(block, nxt)[0]
            if word in TITLES and not evidence.opens_sentence(follow) or 0 < len(word) < 3 and len(follow) == 1 and block[nxt + 1 : nxt + 2] == ".":
                continue
            if word and len(word) == 1 and word.isupper() and len(token[0]) == 1 and not evidence.opens_sentence(follow):
                continue
            if not word and follow in MONTHS and re.search(r"(?<![\d.])\d{1,2}$", block[max(begin, p - 3) : p]):
                continue
            if word and evidence.abbreviation(word) and not evidence.ends_sentences(word) and not evidence.opens_sentence(follow):
                continue
            cut(q)
        elif c.islower():
            if word and len(word) < 3 and block[nxt + 1 : nxt + 2] == ".":
                continue
            if _CAMEL.match(block, nxt):
                if not word or not evidence.abbreviation(word):
                    cut(q)
            elif word and evidence.ends_sentences(word) and not evidence.abbreviation(word):
                cut(q)
            elif not word and before and len(before[0]) > 3:
                cut(q)
        elif not word or not evidence.abbreviation(word):
            cut(q)
    cut(size)
    return out


def units_of(text: str | None, corpus: dict[str, tuple[int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the sentence units of a text, in order."""
    if not text:
        return []
    evidence, out = Evidence(text, corpus), []
    for start, end, code in blocks_of(text):
        if code:
            out.append((start, end))
        else:
            out += [(start + a, start + b) for a, b in sentences_of(text[start:end], evidence)]
    return out


def _count_periods(batch: pa.RecordBatch) -> list[list]:
    low, every = Counter(), Counter()
    for text in batch.column(0).to_pylist():
        for w, c in period_words(text):
            if len(c) < 2 and not (c.isdigit() and len(w) > 4):
                every[w] += 1
                low[w] += not c or c.islower() or c.isdigit()
    return [list(every), [low[w] for w in every], list(every.values())]


def period_counts(docs: DataFrame) -> dict[str, tuple[int, int]]:
    """word -> (continued in lower case or by a digit, all), over every text; bounded by ``MIN_SHARE``."""
    stage = text_stage([("word", pa.string()), ("low", pa.int64()), ("n", pa.int64())], _count_periods)
    counted = docs.where("text is not null").select("text").mapInArrow(stage, "word string, low bigint, n bigint")
    counts = cut_lineage(counted.groupBy("word").agg(F.sum("low").alias("low"), F.sum("n").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    kept = counts.where(F.col("n") >= max(5.0, MIN_SHARE * total))
    return {r.word: (r.low, r.n) for r in kept.toLocalIterator()}


def sentence_units(docs: DataFrame, key: str, text: str, with_text: bool = False) -> DataFrame:
    """(key, start_pos, end_pos): one row per sentence unit; positions count characters, the end is exclusive.

    ``with_text`` adds the unit itself, cut out in the same pass.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).where("key is not null and text is not null")
    corpus = rows.sparkSession.sparkContext.broadcast(period_counts(rows))

    def work(batch: pa.RecordBatch) -> list[list]:
        keys, starts, ends, units = [], [], [], []
        for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = units_of(t, corpus.value)
            keys += [k] * len(found)
            starts += [a for a, _ in found]
            ends += [b for _, b in found]
            if with_text:
                units += [t[a:b] for a, b in found]
        return [keys, starts, ends, *([units] if with_text else [])]

    fields = [("key", pa.int64()), ("start_pos", pa.int32()), ("end_pos", pa.int32()), *([("unit", pa.string())] if with_text else [])]
    return rows.mapInArrow(text_stage(fields, work), "key bigint, start_pos int, end_pos int" + (", unit string" if with_text else ""))


def p8_found(spark, sf_dir):
    return sentence_units(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")


def p8_texts(spark, sf_dir):
    return sentence_units(table(spark, sf_dir, "documents"), "doc_id", "text", with_text=True).withColumnRenamed("key", "doc_id")


def p8_cover(spark, sf_dir):
    """(doc_id, length, ordered): the length of each text, and whether its units are ordered, apart and within it, and their texts stand there.

    A text is rebuilt from its units laid over its own characters, so a wrong position or unit shows.
    """
    docs = table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", "text", F.char_length("text").alias("length"))
    units = p8_texts(spark, sf_dir).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_pos", "end_pos", "unit"))).alias("u"))
    apart = F.aggregate("u", F.struct(F.lit(0).alias("at"), F.lit(True).alias("ok")), lambda s, x: F.struct(x["end_pos"].alias("at"), (s["ok"] & (x["start_pos"] >= s["at"]) & (x["end_pos"] > x["start_pos"])).alias("ok")))
    there = F.forall("u", lambda x: F.substring(F.col("text"), x["start_pos"] + 1, x["end_pos"] - x["start_pos"]) == x["unit"])
    ends = F.coalesce(F.element_at("u", -1)["end_pos"] <= F.col("length"), F.lit(True))
    return docs.join(units, "doc_id", "left").select("doc_id", "length", (F.col("u").isNull() | (apart["ok"] & there & ends)).alias("ordered"))


QUERIES = {f.__name__: f for f in (p8_found, p8_texts, p8_cover)}
ORACLE = {"p8_cover": "select doc_id, cast(length(text) as int) as length, true as ordered from documents where doc_id is not null"}
