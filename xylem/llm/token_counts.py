"""Exact length histogram of encoded documents.

Documents are aggregated by their number of tokens; suffix sums over the
histogram then answer totals, quantiles and truncated totals for every context
limit without another look at the documents.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, read_table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's authors split text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Lengths are summed in blocks of so many before blocks are summed.
BLOCK = 4096


def encoder(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_lengths(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(n_tokens) per document: whole texts, null as empty."""
    with open(vocabulary, "rb") as f:  # a fixed file of under 1 MB
        held = docs.sparkSession.sparkContext.broadcast(f.read())

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(held.value)
        for batch in batches:
            counts = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int64())], ["n_tokens"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(lean(lengths), "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """Per distinct length, taken as a context limit, from (n_tokens).

    n_docs: documents of this length; docs_upto: of this or a smaller one;
    docs_over: of a larger one; tokens_upto, tokens_over: their tokens;
    truncated_tokens: all tokens if each document is cut at this length;
    quantile: share of documents that fit. No rows for an empty table.
    """
    h = lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))
    h = h.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_docs") * F.col("n_tokens"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    whole = Window.partitionBy(F.lit(0))
    earlier = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("b_docs").over(earlier), F.lit(0)).alias("docs_before"),
        F.coalesce(F.sum("b_tokens").over(earlier), F.lit(0)).alias("tokens_before"),
        F.sum("b_docs").over(whole).alias("all_docs"), F.sum("b_tokens").over(whole).alias("all_tokens"))
    upto = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("d", F.sum("n_docs").over(upto)).withColumn("t", F.sum("tokens").over(upto)).join(blocks, "block")
    docs_upto, tokens_upto = F.col("docs_before") + F.col("d"), F.col("tokens_before") + F.col("t")
    return h.select(
        "n_tokens", "n_docs", docs_upto.alias("docs_upto"), (F.col("all_docs") - docs_upto).alias("docs_over"),
        tokens_upto.alias("tokens_upto"), (F.col("all_tokens") - tokens_upto).alias("tokens_over"),
        (tokens_upto + F.col("n_tokens") * (F.col("all_docs") - docs_upto)).alias("truncated_tokens"),
        (docs_upto / F.col("all_docs")).alias("quantile"))


def at_limit(histogram: DataFrame, limit: int) -> DataFrame:
    """One row for any limit, also between lengths: total, truncated total, documents that fit."""
    n = F.col("n_tokens")
    return histogram.agg(
        F.coalesce(F.sum(n * F.col("n_docs")), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.sum(F.least(n, F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("truncated_tokens"),
        F.coalesce(F.sum(F.when(n <= limit, F.col("n_docs"))), F.lit(0)).alias("docs_fitting"))


def op4(spark, sf_dir):
    return length_histogram(token_lengths(read_table(spark, sf_dir, "documents")))
