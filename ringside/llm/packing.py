"""Sequence packing into optimal length buckets.

The lengths of all documents form one histogram, on a grid of FINE bins an
octave, so a few hundred bins for any input; a bin's boundary is the longest
length in it. Dynamic programming over the bins
chooses the bucket boundaries that minimise the padding of all documents. Inside
a bucket documents are numbered, and each run of as many as the token budget
holds forms a batch.

Only the histogram reaches the driver. Numbering a bucket doesn't gather it: its
rows are dealt into shards, each shard is numbered alone, and the shards' counts
give each its offset.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FINE = 128
BUCKETS = 12
BUDGET = 65_536
SHARD_ROWS = 2_000
PIECE = r"[\p{L}\p{M}]{1,6}|\p{N}{1,3}|[^\s\p{L}\p{M}\p{N}]"


def piece_count(text: Column) -> Column:
    """A token count without a vocabulary: letters in runs of up to six, digits
    in runs of up to three, each other visible character alone."""
    return F.coalesce(F.regexp_count(text, F.lit(PIECE)), F.lit(0)).cast("long")


def bin_of(n: Column) -> Column:
    """The grid: lengths up to 2 * FINE are their own bins, longer ones share
    FINE bins an octave."""
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double"))) - FINE.bit_length() + 1, F.lit(0)))
    return (F.floor(n / step) * step).cast("long")


def boundaries(lengths: list[int], counts: list[int], buckets: int = BUCKETS) -> list[int]:
    """The upper boundaries of at most ``buckets`` buckets over ascending
    lengths that minimise sum(count * (boundary - length)); the fewest on ties."""
    if not lengths:
        return []
    x, c = np.asarray(lengths, np.float64), np.asarray(counts, np.float64)
    n = len(x)
    rows, tokens = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * x)])
    # cost[i, j]: bins i..j padded to x[j]
    cost = x[None, :] * (rows[1:][None, :] - rows[:-1][:, None]) - (tokens[1:][None, :] - tokens[:-1][:, None])
    cost[np.tril_indices(n, -1)] = np.inf
    best, back = cost[0].copy(), [np.zeros(n, np.int64)]
    totals = [best[-1]]
    for _ in range(1, min(buckets, n)):
        via = np.concatenate([[np.inf], best[:-1]])[:, None] + cost  # the last bucket begins at bin i
        begin = via.argmin(axis=0)
        best = via[begin, np.arange(n)]
        back.append(begin)
        totals.append(best[-1])
    k = int(np.argmin(totals))
    ends, j = [], n - 1
    for level in range(k, -1, -1):
        ends.append(int(x[j]))
        j = int(back[level][j]) - 1
    return ends[::-1]


def pack(documents: DataFrame, length: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``documents`` with all its columns and n_tokens, bucket, boundary (the
    padded length), batch, slot, padding; an input's columns of these names are
    replaced.

    A batch holds floor(budget / boundary) documents, one at least; only a
    bucket's last batch may hold fewer. ``length`` counts a document's tokens;
    a null text has none, and documents without tokens share a bucket with
    the boundary 0 or the least one above. Nothing is cut or dropped. Inside
    a bucket documents are in the order of a hash of doc_id; rows that tie
    are interchangeable. No rows: no buckets.
    """
    new = ("n_tokens", "bucket", "boundary", "batch", "slot", "padding")
    count = F.coalesce((length if length is not None else piece_count(F.col("text"))).cast("long"), F.lit(0).cast("long"))
    # Exploding the one value keeps it a column: a projection would be inlined into each use and count again.
    docs = documents.select(*[c for c in documents.columns if c.lower() not in new], F.explode_outer(F.array(count)).alias("n_tokens"))
    bins = docs.groupBy(bin_of(F.col("n_tokens")).alias("bin")).agg(F.max("n_tokens").alias("longest"), F.count("*").alias("n"))
    histogram = sorted((r["longest"], r["n"]) for r in bins.collect())
    if not histogram:
        return docs.select("*", F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("boundary"), F.lit(0).cast("long").alias("batch"), F.lit(0).alias("slot"), F.lit(0).cast("long").alias("padding"))
    ends = boundaries([r[0] for r in histogram], [r[1] for r in histogram], buckets)
    held = [sum(n for x, n in histogram if lo < x <= hi) for lo, hi in zip([-1, *ends[:-1]], ends, strict=True)]
    rows = [(i, hi, max(1, budget // hi) if hi else max(1, budget), max(1, -(-n // shard_rows))) for i, (hi, n) in enumerate(zip(ends, held, strict=True))]
    pick = lambda k: F.element_at(F.array(*[F.lit(r[k]).cast("long") for r in rows]), F.col("bucket") + 1)
    bucket = F.lit(len(ends) - 1)
    for i in range(len(ends) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= ends[i], F.lit(i)).otherwise(bucket)
    docs = docs.withColumn("bucket", bucket).withColumn("boundary", pick(1)).withColumn("_pack_room", pick(2))
    docs = docs.withColumn("_pack_h", F.xxhash64("doc_id")).withColumn("_pack_shard", F.pmod(F.col("_pack_h"), pick(3)))
    sizes = docs.groupBy("bucket", "_pack_shard").agg(F.count("*").alias("_pack_n"))
    before = Window.partitionBy("bucket").orderBy("_pack_shard")
    offsets = sizes.select("bucket", "_pack_shard", (F.sum("_pack_n").over(before) - F.col("_pack_n")).alias("_pack_offset"))
    if sum(r[3] for r in rows) <= 200_000:
        offsets = F.broadcast(offsets)
    alone = Window.partitionBy("bucket", "_pack_shard").orderBy("_pack_h", "doc_id", "n_tokens")
    docs = docs.withColumn("_pack_rank", F.row_number().over(alone) - 1).join(offsets, ["bucket", "_pack_shard"])
    rank = F.col("_pack_rank") + F.col("_pack_offset")
    docs = docs.withColumn("batch", F.floor(rank / F.col("_pack_room"))).withColumn("slot", F.pmod(rank, F.col("_pack_room")).cast("int")).withColumn("padding", F.col("boundary") - F.col("n_tokens"))
    return docs.select(*[c for c in documents.columns if c.lower() not in new], *new)
