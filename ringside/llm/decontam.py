"""Benchmark decontamination: n-gram windows of test items found in documents.

The windows of all items become a set of 64-bit keys. Documents are scanned
once: each text yields one key a word position, and a hash join against the key
set keeps the few positions that may match. Only these positions are then
compared word by word with the item's window, so a hit is never a hash
collision. The key set is broadcast while its summed size is under
``broadcast_bytes``; beyond that the join shuffles by key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, save

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
BROADCAST_BYTES = 64 << 20
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _with_keys(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds key_m for each window length m: the hash of each m consecutive
    entries of ``words``. Hashes of 1, 2, 4, 8 words are doubled up, and two
    overlapping ones cover the window."""
    df = df.withColumn("n", F.size("words")).withColumn("h1", F.transform("words", lambda w: F.xxhash64(w)))
    pair = lambda a, b: F.xxhash64(a, b)
    p = 1
    while 2 * p <= max(lengths):
        m, left = 2 * p, F.greatest(F.col("n") - (2 * p - 1), F.lit(0))
        df = df.withColumn(f"h{m}", F.zip_with(F.slice(f"h{p}", F.lit(1), left), F.slice(f"h{p}", F.lit(p + 1), left), pair))
        p = m
    for m in lengths:
        p = 1 << (m.bit_length() - 1)
        left = F.greatest(F.col("n") - (m - 1), F.lit(0))
        key = F.col(f"h{p}") if p == m else F.zip_with(F.slice(f"h{p}", F.lit(1), left), F.slice(f"h{p}", F.lit(m - p + 1), left), pair)
        df = df.withColumn(f"key_{m}", key)
    return df


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, list[int]]:
    """(key, m, gram, items): the distinct windows of all items, and the
    window lengths that occur (one for each length under ``window``)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    lengths = sorted(r[0] for r in items.select(F.least(F.size("words"), F.lit(window))).distinct().collect())
    parts = []
    for m in lengths:
        own = items.filter(F.size("words") >= m if m == window else F.size("words") == m)
        grams = _with_keys(own, [m]).select("item", "words", F.posexplode_outer(f"key_{m}").alias("at", "key"))
        parts.append(grams.select("key", F.lit(m).alias("m"), F.array_join(F.slice("words", F.col("at") + 1, F.lit(m)), " ").alias("gram"), "item"))
    if not parts:
        return benchmark.sparkSession.createDataFrame([], "key long, m int, gram string, items array<string>"), []
    found = reduce(DataFrame.unionByName, parts).groupBy("key", "m", "gram").agg(F.collect_set("item").alias("items"))
    return save(found, "windows"), lengths


def _within(start: Column, count: Column):
    return lambda s: (s["at"] >= start) & (s["at"] < start + count)


def _grown(m: int, start: Column):
    """A spot as a span of m words, with its words."""
    gram = lambda at: F.array_join(F.slice("words", at + 1, F.lit(m)), " ")
    return lambda s: F.struct((s["at"] - start).alias("at"), F.lit(m).alias("m"), s["key"].alias("key"), gram(s["at"] - start).alias("gram"))


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row for each row of ``documents``: doc_id, fp (hash of the text),
    n_words, hits (array of [start, end) word spans), items (sorted ids).

    A null text has no words. Rows with the same doc_id and text get the same
    result, each its own row; rows that share a doc_id with other texts are
    judged on their own text. Without benchmark words nothing is hit. Items
    that share a window are all listed; long texts are rows like others.
    Further columns of either table are ignored; no rows, none.
    """
    docs = documents.select("doc_id", "text", F.xxhash64("text").alias("fp"))
    grams, lengths = item_windows(benchmark, window)
    if not lengths:
        return docs.select("doc_id", "fp", F.size(words(F.col("text"))).cast("long").alias("n_words"), F.array().cast("array<struct<at:int,end:int>>").alias("hits"), F.array().cast("array<string>").alias("items"))
    keys = grams.select("key").distinct()
    size = F.sum(40 + 4 * F.length("gram") + 24 * F.size("items"))
    if (grams.agg(size.alias("n")).first()["n"] or 0) <= broadcast_bytes:
        keys, grams = F.broadcast(keys), F.broadcast(grams)
    # The outer form: the plain one adds a filter that computes the keys again, inlined.
    scanned = _with_keys(docs.select("doc_id", "fp", words(F.col("text")).alias("words")), lengths)
    every = F.col(f"key_{lengths[0]}") if len(lengths) == 1 else F.concat(*[F.col(f"key_{m}") for m in lengths])
    at = scanned.select("doc_id", "fp", F.posexplode_outer(every).alias("at", "key")).join(keys, "key", "left_semi")
    spots = save(at.groupBy("doc_id", "fp").agg(F.collect_set(F.struct("at", "key")).alias("spots")), "found")
    if (spots.agg(F.sum(40 + 24 * F.size("spots")).alias("n")).first()["n"] or 0) <= broadcast_bytes:
        spots = F.broadcast(spots)  # no text is shuffled

    # The texts meet their candidate positions once; what stays is a row a document without its text.
    same = (F.col("d.fp") == F.col("s.fp")) & F.col("d.doc_id").eqNullSafe(F.col("s.doc_id"))
    met = docs.alias("d").join(spots.alias("s"), same, "left").select("d.doc_id", "d.fp", words(F.col("d.text")).alias("words"), "s.spots")
    of, before = None, F.lit(0)  # which window length a position of the concatenated keys belongs to
    for m in lengths:
        count = F.greatest(F.size("words") - (m - 1), F.lit(0))
        part = F.transform(F.filter("spots", _within(before, count)), _grown(m, before))
        of = part if of is None else F.concat(of, part)
        before = before + count
    met = save(met.select("doc_id", "fp", F.size("words").cast("long").alias("n_words"), of.alias("spots")), "spots")

    spans = met.filter(F.size("spots") > 0).dropDuplicates(["doc_id", "fp"]).select("doc_id", "fp", F.explode("spots").alias("s")).select("doc_id", "fp", "s.*")
    hits = spans.join(grams, ["key", "m", "gram"]).groupBy("doc_id", "fp").agg(
        F.sort_array(F.collect_set(F.struct("at", (F.col("at") + F.col("m")).alias("end")))).alias("hits"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    same = (F.col("d.fp") == F.col("h.fp")) & F.col("d.doc_id").eqNullSafe(F.col("h.doc_id"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    return met.alias("d").join(hits.alias("h"), same, "left").select("d.doc_id", "d.fp", "d.n_words", none(F.col("h.hits"), "array<struct<at:int,end:int>>").alias("hits"), none(F.col("h.items"), "array<string>").alias("items"))


def covered(hits: Column) -> Column:
    """Words in the union of sorted [at, end) spans."""
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(s["end"] - F.greatest(s["at"], acc["reach"]), F.lit(0))).alias("n"), F.greatest(acc["reach"], s["end"]).alias("reach"))
    return F.aggregate(hits, F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")), step, lambda acc: acc["n"].cast("long"))


def judged(found: DataFrame, share: int = 20) -> DataFrame:
    """contaminated: some word is hit, and hit words are 1/share of all or more."""
    return found.withColumn("n_hit", covered(F.col("hits"))).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that aren't contaminated, with all their columns."""
    bad = judged(contamination(documents, benchmark, **options)).filter("contaminated").select(F.col("doc_id").alias("_bench_id"), F.col("fp").alias("_bench_fp")).distinct()
    bad = save(bad, "contaminated")
    if bad.count() <= BROADCAST_ROWS:
        bad = F.broadcast(bad)
    return documents.join(bad, F.col("doc_id").eqNullSafe(F.col("_bench_id")) & (F.xxhash64("text") == F.col("_bench_fp")), "left_anti")
