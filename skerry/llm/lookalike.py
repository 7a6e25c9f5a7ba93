"""Visually identical text: a confusables skeleton and the rows it groups.

``skeleton`` decomposes a text, replaces every character by the prototype of its look-alike class and decomposes
again. Two texts look the same when their skeletons are equal. Set aside are full- and half-width forms, ligatures,
letters styled as mathematical alphabets, composed against decomposed letters, invisible characters, kinds of space,
kinds of hyphen and letters of other scripts with the shape of a Latin letter. Letter case, accents, dotless letters
and ASCII characters among themselves stay different.

Defined results: NULL text has a NULL skeleton and is in no pair; empty text has an empty skeleton; repeated rows with
identical text are no pair of each other, but each of them pairs with every look-alike row; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.arrow import text_stage
from skerry.runtime import cut, table

#: Letters with the shape of an ASCII letter, each followed by that letter (fixed values).
LOOK_ALIKE = {
    "Cyrillic": "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ҮY ԌG ԚQ ԜW ѴV ӀI аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ѵv үy ӏl ԍg гr",
    "Greek": "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ αa νv οo ρp υu ϲc ϳj",
    "Armenian": "ՍU ՏS ՕO օo սu ոn հh ցg զq ԝw",
    "Cherokee": "ᎪA ᏴB ᏟC ᎠD ᎬE ᏀG ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᎡR ᏚS ᎢT ᏙV ᎳW ᏃZ",
    "Lisu": "ꓮA ꓐB ꓚC ꓓD ꓰE ꓝF ꓖG ꓧH ꓲI ꓙJ ꓗK ꓡL ꓟM ꓠN ꓳO ꓑP ꓣR ꓢS ꓔT ꓴU ꓦV ꓪW ꓫX ꓬY ꓜZ",
    "Coptic": "ⲞO ⲟo ⲤC ⲥc ⲢP ⲣp ⲘM ⲚN ⲦT ⲔK ⲎH",
    "Latin": "ɡg ɑa ⱭA ꞬG ʋv ꙅs",
}
#: Characters drawn as a hyphen (fixed values).
HYPHENS = "‐‑‒–—―−﹘﹣－˗⁃➖"
#: Inclusive code point ranges that draw nothing (fixed values).
INVISIBLE = ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF))
#: Compatibility decompositions that keep the look of the text.
SAME_LOOK = {"<wide>", "<narrow>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>"}


def _prototypes() -> dict[str, str]:
    out = {pair[0]: pair[1] for pairs in LOOK_ALIKE.values() for pair in pairs.split()}
    return out | dict.fromkeys(HYPHENS, "-")


class _Skeleton(dict):
    """A ``str.translate`` table that works out each character when it is first met."""

    def __init__(self) -> None:
        super().__init__()
        self.prototypes = _prototypes()

    def _decompose(self, ch: str) -> str:
        kind, _, rest = unicodedata.decomposition(ch).rpartition(">")
        if not rest or ch == "ſ":
            return unicodedata.normalize("NFD", ch) if ch >= "가" and ch <= "힣" else ch
        kind = kind + ">" if kind else ""
        if kind == "<compat>" and unicodedata.category(ch) not in ("Ll", "Lu", "Lo", "Nl", "Zs"):
            return ch
        if kind and kind != "<compat>" and kind not in SAME_LOOK:
            return ch
        return "".join(self._decompose(chr(int(x, 16))) for x in rest.split())

    def _prototype(self, ch: str) -> str:
        if any(a <= ord(ch) <= b for a, b in INVISIBLE):
            return ""
        if unicodedata.category(ch) == "Zs":
            return " "
        return self.prototypes.get(ch, ch)

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        out = ch if code < 128 else self._prototype(ch) if any(a <= code <= b for a, b in INVISIBLE) else "".join(map(self._prototype, self._decompose(ch)))
        self[code] = out
        return out


_TABLE = _Skeleton()


def skeleton(text: str | None) -> str | None:
    """The one consistent form of ``text``."""
    if text is None or text.isascii():
        return text
    return unicodedata.normalize("NFD", text.translate(_TABLE))


def with_skeleton(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, skeleton). ASCII texts are their own skeleton and never leave the JVM."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    plain = F.octet_length("text") == F.char_length("text")
    stage = text_stage([("key", pa.int64()), ("text", pa.string()), ("skeleton", pa.string())], lambda b: [b.column(0), b.column(1), [skeleton(t) for t in b.column(1).to_pylist()]])
    odd = rows.where(~plain).select(F.col("key").cast("bigint").alias("key"), "text").mapInArrow(stage, "key bigint, text string, skeleton string")
    return rows.where(F.coalesce(plain, F.lit(True))).select(F.col("key").cast("bigint").alias("key"), "text", F.col("text").alias("skeleton")).unionByName(odd)


def look_alike_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, skeleton) of the rows whose skeleton has more than one spelling.

    An ASCII text is its own skeleton, so a class of several spellings has one that is not ASCII. Those are turned into
    skeletons once; ASCII rows only join the skeletons found there.
    """
    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).where("key is not null and text is not null")
    plain = F.octet_length("text") == F.char_length("text")
    odd = cut(with_skeleton(rows.where(~plain), "key", "text"))
    forms = odd.groupBy("skeleton").agg(F.min("text").alias("lo"), F.max("text").alias("hi"))
    same = rows.where(plain).select("key", "text", F.col("text").alias("skeleton")).join(forms.select("skeleton"), "skeleton", "left_semi")
    members = odd.unionByName(same.select("key", "text", "skeleton"))
    shared = forms.unionByName(same.select("skeleton", F.col("skeleton").alias("lo"), F.col("skeleton").alias("hi")))
    shared = shared.groupBy("skeleton").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("skeleton")
    return members.join(shared, "skeleton", "left_semi").select("key", "text", "skeleton")


def look_alike_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(a, b), a < b: keys of rows whose texts differ but have the same skeleton.

    Spellings are paired once each, not row by row, and rows join their spelling, so copies of a text cost one join and no
    comparison.
    """
    kept = cut(look_alike_rows(df, key, text))
    spelling = kept.select("skeleton", "text").distinct()
    pairs = spelling.alias("x").join(spelling.alias("y"), "skeleton").where("x.text <> y.text").select(F.col("x.text").alias("text"), F.col("y.text").alias("other"))
    left = kept.select(F.col("key").alias("a"), "text").join(pairs, "text").select("a", F.col("other").alias("text"))
    return left.join(kept.select(F.col("key").alias("b"), "text"), "text").where("a < b").select("a", "b")


def look_alike_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, class_key, links): for each row of a class its least key and the number of rows that look the same but differ.

    As large as the rows themselves, whatever the size of a class.
    """
    kept = cut(look_alike_rows(df, key, text))
    spelling = kept.groupBy("skeleton", "text").agg(F.count("*").alias("n"), F.min("key").alias("k"))
    classes = spelling.groupBy("skeleton").agg(F.sum("n").alias("rows"), F.min("k").alias("class_key"))
    links = spelling.join(classes, "skeleton").select("text", "class_key", (F.col("rows") - F.col("n")).alias("links"))
    return kept.select("key", "text").join(links, "text").select("key", "class_key", "links")


def p5_found(spark, sf_dir):
    return look_alike_pairs(table(spark, sf_dir, "raw_entries"), "raw_id", "path").select(F.col("a").alias("raw_id"), F.col("b").alias("raw_id2"))


def p5_skeletons(spark, sf_dir):
    return with_skeleton(table(spark, sf_dir, "raw_entries"), "raw_id", "path").select(F.col("key").alias("raw_id"), F.col("text").alias("path"), "skeleton")


def p5_classes(spark, sf_dir):
    return look_alike_classes(table(spark, sf_dir, "raw_entries"), "raw_id", "path").select(F.col("key").alias("raw_id"), F.col("class_key").alias("class_id"), "links")


def p5_stable(spark, sf_dir):
    """Every path, and whether its skeleton is its own skeleton (ASCII: the path itself)."""
    once = p5_skeletons(spark, sf_dir)
    twice = with_skeleton(once, "raw_id", "skeleton").select(F.col("key").alias("raw_id"), F.col("text").alias("skeleton"), F.col("skeleton").alias("again"))
    plain = F.octet_length("path") == F.char_length("path")
    return once.drop("skeleton").join(twice, "raw_id").select("raw_id", "path", (F.col("skeleton").eqNullSafe(F.col("again")) & (~F.coalesce(plain, F.lit(False)) | F.col("skeleton").eqNullSafe(F.col("path")))).alias("stable"))


QUERIES = {f.__name__: f for f in (p5_found, p5_skeletons, p5_classes, p5_stable)}
ORACLE = {"p5_stable": "select raw_id, path, true as stable from raw_entries"}
