"""Filling fixed-capacity containers with texts: vector best-fit in shards of bounded size.

A text is measured once, in tokens of a public tokenizer whose file is a parameter. Only a text longer than a container is
divided, into full containers and one rest. Pieces are spread over shards by hash, so a shard is a fair sample of all sizes
and holds a bounded number of containers whatever the corpus; each shard is packed on its own, largest piece first. A piece
has three demands (tokens, one document, attention cost = tokens squared) and goes to the open container that keeps every
capacity and has the smallest weighted norm of what remains after placing it. The attention capacity is less than the cost of
one text that fills the container, so two long texts may not meet although their tokens fit; a text that is too costly by
itself, yet may not be divided, opens a container whose attention capacity is that cost and the share of the tokens left. A shard leaves at most a few containers open,
so the unused space does not grow with the number of shards beyond ``1 / SHARD_CONTAINERS``.

Defined results: NULL, empty and zero-token texts need no space and have no row; NULL ids are left out; repeated ids are placed
each; NULL and non-positive capacities are ignored, repeated rows of ``containers`` count once and a kind with several
capacities is filled for each; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.arrow import text_stage
from skerry.runtime import cut, table

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Expected containers of a shard; bounds the memory and time of a task.
SHARD_CONTAINERS = 2000
#: Documents a container may hold, as a share of its token capacity.
DOCUMENT_SHARE = 1 / 96
#: Attention cost a container may hold, as a share of the cost of one text that fills it.
ATTENTION_SHARE = 0.75
#: Weights of the remaining tokens, documents and attention cost in the norm that selects a container.
WEIGHTS = (1.0, 0.1, 0.1)
PLACED = "kind string, capacity int, container bigint, doc_id bigint, piece int, start_token int, tokens int"

_ENCODERS: dict = {}


def encoder(path: str):
    """The tokenizer of a ranks file; loaded once per worker."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("skerry", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n): whole texts measured in tokens."""

    def work(batch: pa.RecordBatch) -> list[list]:
        e = encoder(tokenizer)
        return [batch.column(0), [len(e.encode_ordinary(t)) for t in batch.column(1).to_pylist()]]

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text <> ''")
    return rows.mapInArrow(text_stage([("doc_id", pa.int64()), ("n", pa.int32())], work), "doc_id bigint, n int").where("n > 0")


def limits(capacity: int) -> tuple[int, float]:
    """Documents and attention cost of a container."""
    return max(1, int(capacity * DOCUMENT_SHARE)), ATTENTION_SHARE * capacity * capacity


def best_fit(tokens: np.ndarray, capacity: int, documents: int, attention: float) -> np.ndarray:
    """Container number of each piece; pieces come largest first."""
    scale = np.array([capacity, documents, attention], np.float64)
    weight = np.array(WEIGHTS)
    free = np.empty((len(tokens) + 1, 3))
    number = np.empty(len(tokens) + 1, np.int64)
    out = np.empty(len(tokens), np.int64)
    opened = used = 0
    smallest = float(tokens[-1]) if len(tokens) else 0.0
    for i, t in enumerate(tokens.tolist()):
        demand = np.array([t, 1.0, float(t) * t])
        left = free[:used] - demand
        fits = np.flatnonzero((left >= 0).all(axis=1))
        if len(fits):
            r = left[fits] / scale
            j = fits[np.argmin((r * r) @ weight)]
            free[j] = left[j]
        else:
            j = used
            free[j], number[j] = scale - demand, opened
            if demand[2] > attention:
                free[j][2] = attention * (capacity - t) / capacity
            opened, used = opened + 1, used + 1
        out[i] = number[j]
        if free[j][0] < smallest or free[j][1] < 1 or free[j][2] < smallest * smallest:  # closed: no later piece can fit
            used -= 1
            free[j], number[j] = free[used], number[used]
    return out


def pack(sizes: DataFrame, containers: list[tuple[str, int]]) -> DataFrame:
    """(kind, capacity, container, doc_id, piece, start_token, tokens): every text in containers of every kind."""
    spark = sizes.sparkSession
    if not containers:
        return spark.createDataFrame([], PLACED)
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).alias("capacity"), F.lit(max(1, round(total / (c * SHARD_CONTAINERS)))).alias("shards")) for k, c in containers])
    each = sizes.select("doc_id", "n", F.inline(kinds))
    pieces = each.select("kind", "capacity", "shards", "doc_id", "n", F.explode(F.sequence(F.lit(0), F.expr("int((n - 1) div capacity)"))).alias("piece"))
    pieces = pieces.withColumn("start_token", F.col("piece") * F.col("capacity")).withColumn("tokens", F.least("capacity", F.col("n") - F.col("start_token")))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), "shards"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        capacity = int(pdf["capacity"].iloc[0])
        placed = best_fit(pdf["tokens"].to_numpy(), capacity, *limits(capacity))
        shard = int(pdf["shard"].iloc[0])
        return pd.DataFrame({"kind": pdf["kind"], "capacity": capacity, "container": (shard << 32) + placed, "doc_id": pdf["doc_id"], "piece": pdf["piece"], "start_token": pdf["start_token"], "tokens": pdf["tokens"]})

    return pieces.groupBy("kind", "capacity", "shard").applyInPandas(work, PLACED)


def container_kinds(containers: DataFrame) -> list[tuple[str, int]]:
    """The capacities: a parameter table of a few rows."""
    rows = containers.where("kind is not null and capacity > 0").select("kind", F.col("capacity").cast("int").alias("c")).distinct().orderBy("kind", "c").collect()
    return [(r.kind, r.c) for r in rows]


def filled(placed: DataFrame) -> DataFrame:
    """(kind, capacity, container, tokens, documents, attention, first): what each container holds, and its largest piece."""
    cost = F.sum(F.col("tokens").cast("bigint") * F.col("tokens"))
    return placed.groupBy("kind", "capacity", "container").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"), cost.alias("attention"), F.max("tokens").alias("first"))


def fill_report(placed: DataFrame) -> DataFrame:
    """(kind, capacity, containers, least, tokens, unused_share): containers used, the fewest possible, and the space left over."""
    out = filled(placed).groupBy("kind", "capacity").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"))
    return out.select("kind", "capacity", "containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("least"), "tokens", (1 - F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("unused_share"))


def limit_report(placed: DataFrame) -> DataFrame:
    """(kind, capacity, full, most_documents, most_attention, over): containers that reach each limit (attention: within 2 %), and those beyond any."""
    c = F.col("capacity")
    documents, attention = F.greatest(F.lit(1), F.floor(c * DOCUMENT_SHARE)), c.cast("double") * c * ATTENTION_SHARE
    first = F.col("first").cast("double") * F.col("first")
    allowed = F.when(first > attention, first + attention * (c - F.col("first")) / c).otherwise(attention)
    over = (F.col("tokens") > c) | (F.col("documents") > documents) | (F.col("attention") > allowed)
    count = lambda x: F.count(F.when(x, 1))
    return filled(placed).groupBy("kind", "capacity").agg(count(F.col("tokens") == c).alias("full"), count(F.col("documents") == documents).alias("most_documents"), count((F.col("attention") >= 0.98 * allowed) & (F.col("documents") > 1)).alias("most_attention"), count(over).alias("over"))


def p6_packed(spark, sf_dir):
    return pack(cut(token_counts(table(spark, sf_dir, "documents"))), container_kinds(table(spark, sf_dir, "containers")))


def p6_fill(spark, sf_dir):
    return fill_report(p6_packed(spark, sf_dir))


def p6_limits(spark, sf_dir):
    return limit_report(p6_packed(spark, sf_dir))


def p6_whole(spark, sf_dir):
    """Every text and kind of container, and whether its pieces follow each other without a gap, as long as they may be, and none beyond need."""
    sizes = cut(token_counts(table(spark, sf_dir, "documents")))
    placed = pack(sizes, container_kinds(table(spark, sf_dir, "containers")))
    laid = placed.groupBy("kind", "capacity", "doc_id").agg(F.sort_array(F.collect_list(F.struct("start_token", "tokens"))).alias("p"), F.sum("tokens").alias("sum"))
    c = F.col("capacity")
    gapless = F.forall(F.sequence(F.lit(1), F.size("p")), lambda i: F.element_at("p", i)["start_token"] == (i - 1) * c)
    whole = gapless & (F.col("sum") == F.col("n")) & (F.size("p") == F.ceil(F.col("n") / c))
    return laid.join(sizes, "doc_id").select("kind", "capacity", "doc_id", whole.alias("whole"))


QUERIES = {f.__name__: f for f in (p6_packed, p6_fill, p6_limits, p6_whole)}
ORACLE = {"p6_whole": "select kind, capacity, doc_id, true as whole from documents, (select distinct kind, capacity from containers where kind is not null and capacity > 0) where doc_id is not null and text <> ''"}
