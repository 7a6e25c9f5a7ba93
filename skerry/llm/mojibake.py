"""Text decoded with the wrong character encoding: affected records, and the original text where it can be restored.

1. Pair statistics. Adjacent character pairs with a non-ASCII member are counted over every row, in a hashed table of
   ``2**PAIR_BITS`` slots, so the model has the same bounded size for any corpus. Rows that show the structure of
   multi-byte text read as single bytes are left out of the counts, otherwise frequent damage would look normal. Two models
   are kept: one counts rows, the other each distinct text once, so that copies of one damaged text do not vote for it.
2. Each pair gets its smoothed mutual information; maximum-scoring segments of improbable pairs are isolated.
3. Only inside those segments, inverse mappings (encode with the wrong decoder, decode with the right one) are tried. One
   is accepted if the pairs of the restored text are sufficiently more frequent in the corpus than those that stand there.
   By the model of distinct texts all other runs are tried too, since many damaged texts make their pairs probable.

A replacement character or a C1 control is as improbable as a pair can be, so it always lies in a segment; where no mapping
takes it away, the original is lost at that place. A segment is widened to the whole run of non-ASCII characters it touches,
because a mapping is not defined on a part of a multi-byte character.

Defined results: NULL, empty and pure ASCII texts are never affected; repeated rows are reported each; texts are processed
whole; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.arrow import text_stage
from skerry.llm.lookalike import skeleton
from skerry.runtime import table

PAIR_BITS = 20
CHAR_BITS = 16
#: Share of all counted pairs below which a pair counts as unsupported, whatever the size of the corpus.
RARE = 2e-5
#: Pairs with less mutual information than this join an improbable segment.
TAU = 1.0
#: Least gain in mean log frequency for a restored run: UTF-8 carries its own check, other encodings do not, and a single
#: character least of all.
GAIN_UTF8, GAIN_OTHER, GAIN_SINGLE = 0.7, 2.2, 3.0
#: So many different runs of a text may be restored by one mapping that is too weak for each of them.
SCATTERED = 3
#: Least gain for a run outside the improbable segments, and its least length.
GAIN_FREQUENT, FREQUENT = 3.0, 2
#: Pairs whose figures a task keeps at hand.
MOST_KNOWN = 500_000
#: Minus the information of a pair with a lost character, which no text holds rightly.
LOST_BITS = 20.0
#: Share of a run's bytes that must form valid UTF-8 where the run was cut or lost characters.
VALID = 0.6

# Decoders that texts are wrongly read with (fixed values).
WRONG = ["cp1252", "latin-1", "cp437", "cp850", "cp852", "cp866", "cp1250", "cp1251", "cp1253", "cp1254", "cp1256", "cp1257", "koi8-r", "mac_roman", "iso8859-2", "iso8859-5", "iso8859-7", "cp874", "gb18030", "big5", "cp932", "euc_jp", "cp949"]
# Encodings that texts are really in (fixed values).
RIGHT = ["utf-8", "cp1252", "cp1250", "cp1251", "cp866", "koi8-r", "cp1253", "cp1254", "cp437", "cp850", "mac_roman", "iso8859-2", "cp874", "gb18030", "big5", "cp932", "euc_jp", "cp949"]
WIDE = {"gb18030", "big5", "cp932", "euc_jp", "cp949"}
RUN = re.compile(r"[^\x00-\x7f]+")
PHRASE = re.compile(r"[^\x00-\x7f]+(?: ?[^\x00-\x7f]+)*")
#: A run in which single ASCII characters stand between: second bytes of a double-byte encoding.
MIXED = re.compile(r"[^\x00-\x7f](?:[@-~]?[^\x00-\x7f])*+[@-~]?")
_DIGIT, _ASCII = re.compile(r"\d"), re.compile("[\x00-\x7f]")
LOST = re.compile("[\x80-\x9f�]")


def _encode_char(ch: str, codec: str) -> bytes | None:
    try:
        return ch.encode(codec)
    except UnicodeEncodeError:
        # Bytes that a code page leaves undefined are commonly passed through as C1 controls.
        return bytes([ord(ch)]) if codec.startswith("cp125") and "\x80" <= ch <= "\x9f" else None


_ENCODED: dict[str, dict[str, bytes | None]] = {w: {} for w in WRONG}


def encode_run(run: str, codec: str) -> bytes | None:
    """The bytes a run was read from if ``codec`` had been the decoder; None if it cannot have been. U+FFFD stays unknown."""
    known, out = _ENCODED[codec], []
    for ch in run:
        if ch == "�":
            out.append(b"?")
            continue
        if ch not in known:
            known[ch] = _encode_char(ch, codec)
        if known[ch] is None:
            return None
        out.append(known[ch])
    return b"".join(out)


def utf8_of(raw: bytes) -> tuple[str, float] | None:
    """Decoded text without invalid bytes, and the share of the non-ASCII bytes that were valid; None below ``VALID``."""
    try:
        return raw.decode("utf-8"), 1.0
    except UnicodeDecodeError:
        text = raw.decode("utf-8", "ignore")
        high = sum(b > 127 for b in raw)
        kept = sum(len(c.encode()) for c in text if c > "\x7f")
        return (text, kept / high) if high and kept >= 2 and kept / high >= VALID else None


def structurally_wrong(text: str) -> bool:
    """True if a text has lost characters, or a run of it reads as strict multi-byte UTF-8 under a wrong decoder."""
    if LOST.search(text):
        return True
    for m in PHRASE.finditer(text):
        run = m[0].replace(" ", "")
        for codec in WRONG:
            if len(run) < (3 if codec in WIDE else 2):
                continue
            raw = encode_run(run, codec)
            if raw is None or raw.isascii():
                continue
            try:
                good = raw.decode("utf-8")
            except UnicodeDecodeError:
                continue
            if len(good) < len(raw) and not LOST.search(good):
                return True
    return False


def pair_slot(a: str, b: str) -> int:
    return ((ord(a) * 0x9E3779B1) ^ (ord(b) * 0x85EBCA77)) % 0xFFFFFFFB & ((1 << PAIR_BITS) - 1)


def margin(ch: str) -> int:
    """The slot of a character in the margins: its code point; those beyond the basic plane share the private use area."""
    code = ord(ch)
    return code if code < 1 << CHAR_BITS else 0xE000 + code * 0x9E3779B1 % 6400


def pairs_of(text: str) -> list[tuple[str, str]]:
    """Adjacent pairs with a non-ASCII member; the text is framed by spaces, digits count alike."""
    framed = " " + _DIGIT.sub("0", text) + " "
    return [(a, b) for a, b in zip(framed, framed[1:]) if a > "\x7f" or b > "\x7f"]


def _count(batch: pa.RecordBatch) -> list[list]:
    """(slot, rows, distinct texts) of a batch of (distinct text, its rows)."""
    pairs: dict[tuple[str, str], list[int]] = {}
    for text, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        if not structurally_wrong(text):
            for p in pairs_of(text):
                got = pairs.setdefault(p, [0, 0])
                got[0] += n
                got[1] += 1
    rows: Counter = Counter()
    once: Counter = Counter()
    for (a, b), (n, d) in pairs.items():
        for slot in (pair_slot(a, b), -1 - margin(a), -1 - (1 << CHAR_BITS) - margin(b)):
            rows[slot] += n
            once[slot] += d
    return [list(rows), list(rows.values()), [once[s] for s in rows]]


class PairModel:
    """Pair and margin counts of a corpus in arrays of fixed size."""

    def __init__(self, rows) -> None:
        self.pair = np.zeros(1 << PAIR_BITS, np.int64)
        self.left, self.right = np.zeros(1 << CHAR_BITS, np.int64), np.zeros(1 << CHAR_BITS, np.int64)
        for slot, n in rows:
            if slot >= 0:
                self.pair[slot] += n
            elif slot >= -(1 << CHAR_BITS):
                self.left[-1 - slot] += n
            else:
                self.right[-1 - slot - (1 << CHAR_BITS)] += n
        self.total = max(1, int(self.pair.sum()))
        self.floor = max(0.5, RARE * self.total)
        self.log = np.log((self.pair + 0.02 * self.floor) / self.floor)
        self.memo: dict[tuple[str, str], float] = {}
        self.logs: dict[tuple[str, str], float] = {}

    def information(self, a: str, b: str) -> float:
        """Mutual information of a pair, smoothed so that unsupported pairs fall below zero."""
        got = self.memo.get((a, b))
        if got is None and (LOST.match(a) or LOST.match(b)):
            got = self.memo[a, b] = -LOST_BITS
        if got is None:
            n = int(self.pair[pair_slot(a, b)])
            if len(self.memo) > MOST_KNOWN:
                self.memo.clear()
            expected = int(self.left[margin(a)]) * int(self.right[margin(b)]) / self.total
            got = self.memo[a, b] = math.log((n + 0.01 * self.floor) / (expected + self.floor))
        return got

    def support(self, pairs: list[tuple[str, str]]) -> float:
        """Mean log frequency of pairs, in units of the rarity floor."""
        known, total = self.logs, 0.0
        for p in pairs:
            got = known.get(p)
            if got is None:
                if len(known) > MOST_KNOWN:
                    known.clear()
                got = known[p] = float(self.log[pair_slot(*p)])
            total += got
        return total / len(pairs) if pairs else -9.0


def _plain_score(text: str) -> float:
    """The score of the pairs of an ASCII stretch: each costs half a point at a blank, three points elsewhere."""
    pairs = len(text) - 1
    if pairs < 1:
        return 0.0
    if "  " in text:
        blank = sum(a == " " or b == " " for a, b in zip(text, text[1:]))
    else:
        blank = 2 * text.count(" ") - (text[0] == " ") - (text[-1] == " ")
    return -0.5 * blank - 3.0 * (pairs - blank)


def improbable_segments(text: str, model: PairModel) -> list[tuple[int, int]]:
    """All maximum-scoring segments (character spans) of improbable pairs, in one pass over the text."""
    stack: list[list[float]] = []  # start, end, sum before, sum after
    total, framed, at, known = 0.0, " " + _DIGIT.sub("0", text) + " ", 0, model.memo
    for m in RUN.finditer(framed):
        first, last = m.span()
        total += _plain_score(framed[at:first])
        at = last
        for i in range(first - 1, last):
            a, b = framed[i], framed[i + 1]
            got = known.get((a, b))
            before, s = total, TAU - (model.information(a, b) if got is None else got)
            total += s
            if s <= 0:
                continue
            seg = [i, i + 1, before, total]
            while True:
                j = len(stack) - 1
                while j >= 0 and stack[j][2] >= seg[2]:
                    j -= 1
                if j < 0 or stack[j][3] >= seg[3]:
                    stack.append(seg)
                    break
                seg = [stack[j][0], seg[1], stack[j][2], seg[3]]
                del stack[j:]
    return [(max(0, int(a) - 1), min(len(text), int(b))) for a, b, *_ in stack]


def restore_run(run: str, before: str, after: str, model: PairModel) -> tuple[str, str, str, float] | None:
    """(restored, wrong decoder, right encoding, gain) of the best accepted inverse mapping of a run."""
    # A spelling in other letter case is as good as the text itself.
    now = max(model.support(pairs_of_framed(before, x, after)) for x in {run, run.lower(), run.upper()})
    plain = not run.strip("\u00a0\u2002\u2003\u2007\u2009\u202f\u3000") or skeleton(run).isascii()
    best, seen = None, {run}
    for wrong in WRONG:
        raw = encode_run(run, wrong)
        if raw is None or raw.isascii():
            continue
        for right in RIGHT:
            if right != "utf-8" and plain:  # spaces and look-alike letters are another matter
                continue
            if right == wrong or (wrong in WIDE and right != "utf-8" and right not in WIDE):
                continue
            if right == "utf-8":
                got = utf8_of(raw)
                if got is None or len(got[0]) >= len(raw):
                    continue
                good, need = got[0], GAIN_UTF8
                again = None
                if not good.isascii() and len(good) > 1:
                    for w2 in ("cp1252", "latin-1", "cp437", "cp850"):
                        raw2 = encode_run(good, w2)
                        again = raw2 and not raw2.isascii() and utf8_of(raw2)
                        if again and again[1] == 1.0 and len(again[0]) < len(raw2):
                            good = again[0]
                            break
            else:
                try:
                    good, need = raw.decode(right), GAIN_OTHER
                except UnicodeDecodeError:
                    continue
            if good in seen or LOST.search(good) or good.isascii():
                continue
            seen.add(good)
            if right != "utf-8" and len(run) == 1:
                if not unicodedata.name(good[0], "").startswith("LATIN"):
                    continue
                need = GAIN_SINGLE
            gain = model.support(pairs_of_framed(before, good, after)) - now
            if gain >= need and (best is None or (right == "utf-8", gain - need) > (best[2] == "utf-8", best[3] - best[4])):
                best = (good, wrong, right, gain, need)
    return best[:4] if best else None


def restore_mixed(run: str, before: str, after: str, model: PairModel) -> tuple[str, str, str, float] | None:
    """Like ``restore_run`` for a run with ASCII characters in it, read from a double-byte encoding."""
    now, best = model.support(pairs_of_framed(before, run, after)), None
    for wrong in ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251"):
        raw = encode_run(run, wrong)
        if raw is None:
            continue
        for right in sorted(WIDE):
            try:
                good = raw.decode(right)
            except UnicodeDecodeError:
                continue
            wide = [c for c in good if c > "\x7f"]
            if LOST.search(good) or len(wide) < 2 or len(good) > 0.67 * len(run):
                continue
            gain = model.support(pairs_of_framed(before, good, after)) - now
            if gain >= GAIN_OTHER and (best is None or gain > best[3]):
                best = (good, wrong, right, gain)
    return best


def restore_scattered(runs: list[tuple[str, str, str]], model: PairModel) -> tuple[list[str], str, str] | None:
    """One mapping for several short runs (before, run, after) of a text that are too weak alone."""
    now = [model.support(pairs_of_framed(*r)) for r in runs]
    best = None
    for wrong in WRONG:
        raws = [encode_run(r[1], wrong) for r in runs] if wrong not in WIDE else [None]
        if None in raws:
            continue
        for right in RIGHT:
            if right == wrong or right == "utf-8" or right in WIDE:
                continue
            try:
                good = [raw.decode(right) for raw in raws]
            except UnicodeDecodeError:
                continue
            if any(LOST.search(g) or g == r[1] for g, r in zip(good, runs)):
                continue
            gain = sum(model.support(pairs_of_framed(r[0], g, r[2])) - n for g, r, n in zip(good, runs, now)) / len(runs)
            if gain >= GAIN_OTHER and (best is None or gain > best[0]):
                best = (gain, good, wrong, right)
    return best and best[1:]


def pairs_of_framed(before: str, run: str, after: str) -> list[tuple[str, str]]:
    framed = before + _DIGIT.sub("0", run) + after
    return [(a, b) for a, b in zip(framed, framed[1:]) if a > "\x7f" or b > "\x7f"]


def repair(text: str, model: PairModel, spans: list[tuple[int, int]], memo: dict, frequent: bool = False) -> tuple[str, list[str], bool] | None:
    """(restored text, mappings used, wholly restored) of an affected text, None if it is not affected.

    ``spans`` are its improbable segments; ``frequent`` tries the runs outside them as well.
    """
    hits: list[tuple[int, int, tuple]] = []
    for pattern, restore in ((RUN, restore_run), (MIXED, restore_mixed)) if spans or frequent else ():
        for m in pattern.finditer(text):
            a, b = m.span()
            if restore is restore_mixed and not _ASCII.search(m[0]):
                continue
            improbable = bool(spans) and any(x < b and a < y for x, y in spans)
            if not (improbable or frequent and b - a >= FREQUENT) or hits and any(x < b and a < y for x, y, _ in hits):
                continue
            key = (text[a - 1 : a] or " ", m[0], text[b : b + 1] or " ", restore is restore_run)
            if key not in memo:
                if len(memo) > 50_000:
                    memo.clear()
                memo[key] = restore(m[0], *(_DIGIT.sub("0", x) for x in (key[0], key[2])), model)
            if memo[key] and (improbable or memo[key][3] >= GAIN_FREQUENT):
                hits.append((a, b, memo[key]))
    left = [m for m in RUN.finditer(text) if any(x < m.end() and m.start() < y for x, y in spans) and not any(x < m.end() and m.start() < y for x, y, _ in hits)] if spans else []
    if len({m[0] for m in left}) >= SCATTERED and not any(skeleton(m[0]).isascii() for m in left):
        frames = [(_DIGIT.sub("0", text[m.start() - 1 : m.start()] or " "), m[0], _DIGIT.sub("0", text[m.end() : m.end() + 1] or " ")) for m in left]
        joint = restore_scattered(frames, model)
        if joint:
            hits += [(m.start(), m.end(), (good, joint[1], joint[2])) for m, good in zip(left, joint[0])]
    out, used, at = [], [], 0
    for a, b, hit in sorted(hits):
        out += [text[at:a], hit[0]]
        used.append(f"{hit[2]}>{hit[1]}")
        at = b
    fixed = "".join([*out, text[at:]])
    lost = any(LOST.search(text, x, y) for x, y in spans)
    if used or lost:
        return fixed, sorted(set(used)), not LOST.search(fixed)
    return None


class Reader:
    """Repairs texts by the model of rows and then, on the result, by that of distinct texts.

    A unit is a run with the characters around it. Units of a text that is not affected and has no improbable pair are
    remembered; a text of such units alone has the same result, as every pair and every run of it has been looked at.
    """

    def __init__(self, models: tuple[PairModel, PairModel]) -> None:
        self.models = models
        self.memos: tuple[dict, dict] = ({}, {})
        self.clean: set[tuple[str, str, str]] = set()

    def repair(self, text: str) -> tuple[str, list[str], bool] | None:
        units = {(text[m.start() - 1 : m.start()], m[0], text[m.end() : m.end() + 1]) for m in MIXED.finditer(text)}
        if units <= self.clean:
            return None
        rows, once = self.models
        spans = improbable_segments(text, rows)
        first = repair(text, rows, spans, self.memos[0])
        now = first[0] if first else text
        left = improbable_segments(now, once)
        second = repair(now, once, left, self.memos[1], frequent=True)
        if first and second:
            return second[0], sorted({*first[1], *second[1]}), second[2]
        if not (first or second or spans or left):
            if len(self.clean) > MOST_KNOWN:
                self.clean.clear()
            self.clean |= units
        return second or first


_READERS: dict[str, Reader] = {}


def _reader(run: str, model) -> Reader:
    """The reader of one run of the operator; tasks of a worker share it, so what it has learnt is learnt once a worker."""
    if run not in _READERS:
        _READERS.clear()
        _READERS[run] = Reader(model.value)
    return _READERS[run]


def fit_pairs(texts: DataFrame) -> tuple[PairModel, PairModel]:
    """Pair statistics of a one-column frame by rows and by distinct texts; the result has a fixed size and may be broadcast."""
    odd = texts.where(F.octet_length("text") > F.char_length("text")).groupBy("text").agg(F.count("*").alias("n"))
    stage = text_stage([("slot", pa.int64()), ("n", pa.int64()), ("d", pa.int64())], _count)
    counts = odd.mapInArrow(stage, "slot bigint, n bigint, d bigint").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    rows = [(r.slot, r.n, r.d) for r in counts.toLocalIterator()]
    return PairModel((s, n) for s, n, _ in rows), PairModel((s, d) for s, _, d in rows)


def wrongly_decoded(rows: DataFrame) -> DataFrame:
    """(src, rec_id, restored, mappings, complete) of the affected rows of a frame (src, rec_id, text)."""
    model = rows.sparkSession.sparkContext.broadcast(fit_pairs(rows))
    run = uuid.uuid4().hex

    def work(batch: pa.RecordBatch) -> list[list]:
        out: list[list] = [[], [], [], [], []]
        reader = _reader(run, model)
        for src, rec, text in zip(*(c.to_pylist() for c in batch.columns)):
            hit = reader.repair(text)
            if hit:
                for column, value in zip(out, (src, rec, *hit)):
                    column.append(value)
        return out

    stage = text_stage([("src", pa.string()), ("rec_id", pa.int64()), ("restored", pa.string()), ("mappings", pa.list_(pa.string())), ("complete", pa.bool_())], work)
    odd = rows.where(F.octet_length("text") > F.char_length("text")).select("src", F.col("rec_id").cast("bigint"), "text")
    return odd.mapInArrow(stage, "src string, rec_id bigint, restored string, mappings array<string>, complete boolean")


def _rows(spark, sf_dir) -> DataFrame:
    hits = table(spark, sf_dir, "content_hits").select(F.lit("content_hits").alias("src"), F.col("hit_id").alias("rec_id"), "text")
    return hits.unionByName(table(spark, sf_dir, "raw_entries").select(F.lit("raw_entries").alias("src"), F.col("raw_id").alias("rec_id"), F.col("path").alias("text")))


def p4_found(spark, sf_dir):
    return wrongly_decoded(_rows(spark, sf_dir)).select("src", "rec_id")


def p4_restored(spark, sf_dir):
    return wrongly_decoded(_rows(spark, sf_dir))


def p4_lost(spark, sf_dir):
    """Every record with a replacement character or a C1 control, and whether it is found."""
    rows = _rows(spark, sf_dir)
    lost = rows.where(F.col("text").rlike("[\\x{80}-\\x{9f}\\x{fffd}]")).select("src", "rec_id")
    found = wrongly_decoded(rows).select("src", "rec_id", F.lit(True).alias("found")).distinct()
    return lost.join(found, ["src", "rec_id"], "left").select("src", "rec_id", F.coalesce("found", F.lit(False)).alias("found"))


def p4_plain(spark, sf_dir):
    """Every record without a text or with an ASCII text, and whether it is left alone."""
    rows = _rows(spark, sf_dir)
    plain = rows.where(F.col("text").isNull() | (F.octet_length("text") == F.char_length("text"))).select("src", "rec_id")
    found = wrongly_decoded(rows).select("src", "rec_id", F.lit(False).alias("spared")).distinct()
    return plain.join(found, ["src", "rec_id"], "left").select("src", "rec_id", F.coalesce("spared", F.lit(True)).alias("spared"))


_ROWS_SQL = "(select 'content_hits' as src, hit_id as rec_id, text from content_hits union all select 'raw_entries', raw_id, path from raw_entries)"
QUERIES = {f.__name__: f for f in (p4_found, p4_restored, p4_lost, p4_plain)}
ORACLE = {
    "p4_lost": f"select src, rec_id, true as found from {_ROWS_SQL} where regexp_matches(text, '[\\x{{80}}-\\x{{9f}}\\x{{fffd}}]')",
    "p4_plain": f"select src, rec_id, true as spared from {_ROWS_SQL} where text is null or strlen(text) = length(text)",
}
