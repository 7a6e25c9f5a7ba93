"""Evaluation passages inside a training corpus: documents that hold a window of a test item, and the items they leak.

The unit of comparison is a window of 8 consecutive words of an item (for items in ``DENSE_LANGS`` 16 consecutive letters
or digits). A prefix-filtered set join finds them:

1. One pass over the corpus normalises every text, counts the document frequency of each token of the item vocabulary and
   keeps the maximal runs of vocabulary tokens that are at least a window long (the length bound). No other text can hold
   a window, so everything after this pass works on a small part of the corpus.
2. The tokens of each window are ordered by rarity. Containment of a whole window needs its rarest token, so that token
   alone is the prefix on which runs and windows are joined; its offset in the window fixes where the window must start
   (the positional bound).
3. Every candidate is verified by exact comparison of the window-sized slice.

Items are taken in blocks of ``BLOCK_CHARS`` characters. A window begins at a word, so a block has at most half as many windows,
which bounds the vocabulary and the windows that are broadcast for any item table.

Defined results: NULL texts and ids on either side give no row, an item shorter than its window is never found, repeated
documents are reported each, repeated item ids once; texts are processed whole; empty tables give an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.arrow import text_stage
from skerry.runtime import broadcast_if_small, cut, table

WORDS = 8
LETTERS = 16
GRAM = 4
DENSE_LANGS = ("zh", "ja")
#: Characters of the items whose windows are broadcast together; a longer item is a block of its own.
BLOCK_CHARS = 1 << 20
#: Size of a window in memory: its tokens and a row around them.
WINDOW_BYTES = 120
_WORD = re.compile(r"[^\W_]+")
_DENSE = re.compile("[぀-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff]")
_TAG = re.compile(r"</?(?:a|b|i|u|s|p|em|strong|span|br|div|mark|code|pre|sub|sup|li|ul|ol|h[1-6]|td|th|tr|table|font|small|big|blockquote)(?:\s[^<>]*+)?/?>", re.I)
RECORD = "kind string, doc_id bigint, token int, n bigint, run array<int>"


def words_of(text: str) -> list[str]:
    """Words in one form: unbroken runs of letters and digits without case, width and markup."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _WORD.findall(text.lower())


def grams(stream: str) -> list[str]:
    return [stream[i : i + GRAM] for i in range(len(stream) - GRAM + 1)]


class Vocabulary:
    """Token numbers of the items of one block, and the windows they form."""

    def __init__(self, items: list[tuple[int, str | None, str]]) -> None:
        self.words: dict[str, int] = {}
        self.grams: dict[str, int] = {}
        self.windows: dict[tuple[int, ...], set[int]] = {}
        self.sparse: set[str] = set()
        for item, lang, text in items:
            words = words_of(text)
            if lang in DENSE_LANGS:
                stream = "".join(words)
                ids = [self.grams.setdefault(g, len(self.grams)) for g in grams(stream)]
                self._add(item, [-1 - i for i in ids], LETTERS - GRAM + 1)
                self.sparse.update(s for i in range(len(stream) - LETTERS + 1) if not _DENSE.search(s := stream[i : i + LETTERS]))
            else:
                self._add(item, [self.words.setdefault(w, len(self.words)) for w in words], WORDS)
        self.sparse_found = _automaton(self.sparse) if self.sparse else None

    def _add(self, item: int, ids: list[int], size: int) -> None:
        for i in range(len(ids) - size + 1):
            self.windows.setdefault(tuple(ids[i : i + size]), set()).add(item)

    def runs(self, words: list[str], text: str) -> tuple[list[list[int]], set[int]]:
        """Runs of vocabulary tokens at least a window long, and the vocabulary tokens present."""
        known, out = self.words, []
        marks = bytes(map(known.__contains__, words))
        for m in re.finditer(b"\x01{%d,}" % WORDS, marks):
            out.append([known[w] for w in words[m.start() : m.end()]])
        present = {known[w] for w in known.keys() & set(words)}
        if self.grams:
            stream = None
            if _DENSE.search(text) or self.sparse_found and self.sparse_found(stream := "".join(words)):
                g = grams(stream if stream is not None else "".join(words))
                marks = bytes(map(self.grams.__contains__, g))
                for m in re.finditer(b"\x01{%d,}" % (LETTERS - GRAM + 1), marks):
                    out.append([-1 - self.grams[x] for x in g[m.start() : m.end()]])
                present.update(-1 - self.grams[x] for x in self.grams.keys() & set(g))
        return out, present


def _automaton(patterns: set[str]):
    """A function that tells if a text holds one of the patterns."""
    try:
        import ahocorasick
    except ImportError:
        return lambda text: any(text[i : i + LETTERS] in patterns for i in range(len(text) - LETTERS + 1))
    machine = ahocorasick.Automaton()
    for p in patterns:
        machine.add_word(p, True)
    machine.make_automaton()
    return lambda text: next(machine.iter(text), None) is not None


def _blocks(items: DataFrame) -> list[list[tuple[int, str | None, str]]]:
    """The item table in blocks; the set of test items is a stated query set, read once by the driver."""
    rows = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "lang", "text")
    out, block, size = [], [], 0
    for r in rows.toLocalIterator():
        block.append((r.item_id, r.lang, r.text))
        size += len(r.text)
        if size >= BLOCK_CHARS:
            out.append(block)
            block, size = [], 0
    return [*out, block] if block else out


def _records(docs: DataFrame, items: list[tuple[int, str | None, str]]) -> DataFrame:
    """The one pass over the corpus: (run) records by document and (df) records by token."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    state: dict[str, Vocabulary] = {}

    def work(batch: pa.RecordBatch) -> list[list]:
        vocabulary = state.get("v") or state.setdefault("v", Vocabulary(shared.value))
        out: list[list] = [[], [], [], [], []]
        df: Counter = Counter()
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            runs, present = vocabulary.runs(words_of(text), text)
            df.update(present)
            for run in runs:
                for column, value in zip(out, ("run", doc, None, None, run)):
                    column.append(value)
        for token, n in df.items():
            for column, value in zip(out, ("df", None, token, n, None)):
                column.append(value)
        return out

    fields = [("kind", pa.string()), ("doc_id", pa.int64()), ("token", pa.int32()), ("n", pa.int64()), ("run", pa.list_(pa.int32()))]
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(text_stage(fields, work), RECORD)


def _block_leaks(docs: DataFrame, items: list[tuple[int, str | None, str]]) -> DataFrame:
    spark = docs.sparkSession
    records = cut(_records(docs, items))
    vocabulary = Vocabulary(items)
    df = {r.token: r.n for r in records.where("kind = 'df'").groupBy("token").agg(F.sum("n").alias("n")).toLocalIterator()}
    prefixed = []
    for window, owners in vocabulary.windows.items():
        offset = min(range(len(window)), key=lambda i: (df.get(window[i], 0), window[i], i))
        if df.get(window[offset], 0):  # a token that no document has rules its windows out
            prefixed += [(window[offset], offset, list(window), item) for item in owners]
    windows = spark.createDataFrame(prefixed, "token int, offset int, tokens array<int>, item_id bigint")
    tokens = records.where("kind = 'run'").select("doc_id", "run", F.posexplode("run").alias("pos", "token"))
    start = F.col("pos") - F.col("offset")
    near = tokens.join(broadcast_if_small(windows, WINDOW_BYTES), "token").where((start >= 0) & (start + F.size("tokens") <= F.size("run")))
    return near.where(F.slice("run", start + 1, F.size("tokens")) == F.col("tokens")).select("doc_id", "item_id")


def leaked_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): one row per document and item of which the document holds a window."""
    blocks = _blocks(items)
    if not blocks:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint")
    found = reduce(DataFrame.unionByName, [_block_leaks(docs, b) for b in blocks])
    return found.distinct()


def leak_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, suite, n_docs): how many documents leak each test item, items without a leak included."""
    n = leaked_items(docs, items).groupBy("item_id").agg(F.count("*").alias("n_docs"))
    return items.select("item_id", "suite").where("item_id is not null").dropDuplicates(["item_id"]).join(n, "item_id", "left").select("item_id", "suite", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


def p7_found(spark, sf_dir):
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_report(spark, sf_dir):
    return leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


# DuckDB knows no compatibility forms, so the text folds the full-width block only; words and windows are those of the docstring.
_FULL, _HALF = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u3000", "".join(map(chr, range(0x21, 0x7F))).replace("'", "''") + " "
_TAG_SQL = _TAG.pattern.replace("*+", "*").replace("'", "''")


def _words_sql(key: str, rows: str) -> str:
    return f"select {key}, regexp_extract_all(lower(translate(regexp_replace(text, '{_TAG_SQL}', ' ', 'gi'), '{_FULL}', '{_HALF}')), '[\\p{{L}}\\p{{N}}]+') as w from {rows} where text is not null and {key.split(',')[0]} is not null"


_LEAKS_SQL = f"""with i as ({_words_sql("item_id, lang", "eval_items")}), d as ({_words_sql("doc_id", "documents")}),
iw as (select item_id, array_to_string(w[k : k + {WORDS - 1}], ' ') as win from (select item_id, w, unnest(range(1, len(w) - {WORDS - 2})) as k from i where lang is null or lang not in {DENSE_LANGS})),
dw as (select doc_id, array_to_string(w[k : k + {WORDS - 1}], ' ') as win from (select doc_id, w, unnest(range(1, len(w) - {WORDS - 2})) as k from d)),
ic as (select item_id, substr(s, cast(k as int), {LETTERS}) as win from (select item_id, array_to_string(w, '') as s, unnest(range(1, length(array_to_string(w, '')) - {LETTERS - 2})) as k from i where lang in {DENSE_LANGS})),
dc as (select doc_id, substr(s, cast(k as int), {LETTERS}) as win from (select doc_id, array_to_string(w, '') as s, unnest(range(1, length(array_to_string(w, '')) - {LETTERS - 2})) as k from d)),
f as (select distinct doc_id, item_id from dw join (select distinct * from iw) using (win) union select distinct doc_id, item_id from dc join (select distinct * from ic) using (win))
"""
QUERIES = {"p7_found": p7_found, "p7_report": p7_report}
ORACLE = {
    "p7_found": _LEAKS_SQL + "select doc_id, item_id from f",
    "p7_report": _LEAKS_SQL + "select item_id, suite, (select count(*) from f where f.item_id = e.item_id) as n_docs from eval_items e where item_id is not null",
}
