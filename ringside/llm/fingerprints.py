"""Document fingerprints from closed syncmers.

A text is a sequence of tokens: runs of letters and digits, or single other
characters (each ideograph is its own token). A k-mer of K tokens is a closed
syncmer, and so an anchor, when the smallest of the hashes of its S-token inner
strings lies at one of its two edges. Whether it does depends on the K tokens
alone, so an edit moves or changes only the anchors that touch it. The
fingerprint is the SIZE smallest distinct anchor hashes, and the likeness of
two fingerprints is their estimate of the anchor sets' Jaccard similarity
(exact while both sets fit).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}]]+|\S"
S = 2
W = 4
K = S + W - 1
SIZE = 64


def _with_anchors(df: DataFrame, text: str, out: str, never_none: bool = False) -> DataFrame:
    """Adds ``out``: array of (at, hash), the closed syncmers of a text column
    with the place of each k-mer's first token. A text of under K tokens, but
    not none, is one anchor; with ``never_none`` also one in which no k-mer is a
    syncmer. That takes under W k-mers: among W in a row one always is."""
    keep = df.columns
    df = df.withColumn("_t", F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0))).withColumn("_n", F.size("_t"))
    left = lambda width: F.greatest(F.col("_n") - (width - 1), F.lit(0))
    pair = lambda a, b: F.xxhash64(a, b)
    df = df.withColumn("_h", F.zip_with(F.slice("_t", F.lit(1), left(S)), F.slice("_t", F.lit(S), left(S)), pair))
    # Sliding minima over 2 and then 4 inner hashes.
    df = df.withColumn("_m", F.zip_with(F.slice("_h", F.lit(1), left(S + 1)), F.slice("_h", F.lit(2), left(S + 1)), lambda a, b: F.least(a, b)))
    df = df.withColumn("_m", F.zip_with(F.slice("_m", F.lit(1), left(K)), F.slice("_m", F.lit(3), left(K)), lambda a, b: F.least(a, b)))
    inner = lambda m, i: (m == F.get("_h", i)) | (m == F.get("_h", i + W - 1))
    at = F.filter(F.transform("_m", lambda m, i: F.when(inner(m, i), i)), lambda i: i.isNotNull())
    df = df.withColumn("_at", at)
    # Inner strings at 0, 2 and 3 cover the K tokens.
    anchor = lambda i: F.struct(i.alias("at"), F.xxhash64(F.get("_h", i), F.get("_h", i + 2), F.get("_h", i + 3)).alias("hash"))
    whole = F.array(F.struct(F.lit(0).alias("at"), F.xxhash64(F.array_join("_t", " ")).alias("hash")))
    none = F.array().cast("array<struct<at:int,hash:bigint>>")
    some = F.col("_n") >= (K + W - 1 if never_none else K)
    if never_none:
        some = some | ((F.col("_n") >= K) & (F.size("_at") > 0))
    found = F.when(some, F.transform("_at", anchor)).when(F.col("_n") > 0, whole).otherwise(none)
    return df.select(*keep, found.alias(out))


def anchors(documents: DataFrame) -> DataFrame:
    """doc_id and its anchors (at, hash), for positional matching. A null text
    is empty and has none."""
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return _with_anchors(docs, "text", "anchors").drop("text")


def sketch(found: Column) -> Column:
    """The SIZE smallest distinct 32-bit hashes of an anchor array."""
    return F.slice(F.sort_array(F.array_distinct(F.transform(found, lambda a: F.shiftrightunsigned(a["hash"], 32)))), 1, SIZE)


def placed(found: Column) -> Column:
    """Each anchor of an array, with its place, as one number."""
    return F.transform(found, lambda a: F.xxhash64(a["at"], a["hash"]))


def printed(hashes: Column) -> Column:
    """A fingerprint as text: eight hex digits a hash."""
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.lpad(F.hex(h), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketches: of the SIZE smallest
    hashes of both, the share that both have. Two empty ones are alike."""
    both = F.slice(F.sort_array(F.array_union(a, b)), 1, SIZE)
    common = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(common / F.size(both))


#: Quantile ranges of doc_id, at most as many parts of each, and the rows that a part should have.
RANGES, STEP, BUCKET = 256, 16, 256
KEY = ["b", "seg", "slice"]


def _many(bounds: Column, doc_id: Column) -> Column:
    return F.size(F.filter(bounds, lambda x: x <= doc_id))


def _in_ranges(docs: DataFrame, few: float) -> tuple[DataFrame, int] | None:
    """``docs`` with ``part``, the quantile range of doc_id, and ``b``, its part
    by the range's own quantiles, both ascending with it, whatever gaps the ids
    have; and the rows that one id may have before it is split. None: no ids."""
    facts = docs.agg(F.percentile_approx("doc_id", F.lit([i / RANGES for i in range(1, RANGES)]), 100 * RANGES).alias("at"), F.count("doc_id").alias("n")).first()
    if not facts["n"]:
        return None
    bounds = sorted(facts["at"])
    literal = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    coarse = _many(literal(bounds[STEP - 1 :: STEP]), F.col("doc_id")) * STEP
    docs = docs.withColumn("part", coarse + _many(F.slice(literal(bounds), coarse + 1, F.lit(STEP - 1)), F.col("doc_id")))
    steps = min(RANGES, -(-facts["n"] // (RANGES * BUCKET)))
    if steps == 1:
        docs = docs.withColumn("b", F.col("part").cast("long"))
    else:
        # RANGES rows of RANGES ids at most.
        inner = docs.filter("part is not null").groupBy("part").agg(F.percentile_approx("doc_id", F.lit([i / steps for i in range(1, steps)]), 100 * steps).alias("_inner"))
        docs = docs.join(F.broadcast(inner), "part", "left").withColumn("b", F.col("part").cast("long") * steps + _many(F.array_sort("_inner"), F.col("doc_id"))).drop("_inner")
    return docs, max(int(few * BUCKET), -(-facts["n"] // RANGES**2))


def with_next(documents: DataFrame, broadcast_rows: int = 200_000, few: float = 4) -> tuple[DataFrame, bool]:
    """Whether an id was split, and doc_id, text, b, seg, slice, salt, k, copies, ghost: every row, dealt by
    ranges of doc_id into buckets (b, seg, slice), and at the end of each bucket
    a ghost of the row that follows it (after the last row: the first), so that
    lead() inside a bucket finds the next document of the whole table. Only
    buckets' least keys are gathered, range by range, and then one row a range;
    no window spans the table.

    A doc_id of more than ``few`` buckets' rows is split: its equal rows are
    counted (``copies``), the others follow each other by their texts' hashes
    (k), and slices of these hashes are buckets of their own. There are at most
    RANGES * RANGES such ids."""
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("salt", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(4096))).otherwise(F.lit(0)))
    found = _in_ranges(docs, few)
    plain = [F.lit(0).alias("seg"), F.lit(0).cast("long").alias("slice"), F.lit(0).cast("long").alias("k"), F.lit(1).cast("long").alias("copies")]
    if not found:
        return docs.select("doc_id", "text", "salt", F.lit(None).cast("long").alias("b"), *plain, F.lit(False).alias("ghost")), False
    docs, most = found
    hot = docs.filter("doc_id is not null").groupBy("doc_id", "part", "b").agg(F.count("*").alias("rows")).filter(F.col("rows") > most)
    split = bool(hot.limit(1).count())
    if not split:
        docs = docs.select("doc_id", "text", "salt", "part", "b", *plain)
    else:
        hots = hot.groupBy("b").agg(F.array_sort(F.collect_list(F.struct("doc_id", "rows"))).alias("_hot"))
        docs = docs.join(F.broadcast(hots), "b", "left")
        own = F.filter("_hot", lambda h: h["doc_id"] == F.col("doc_id"))
        below = F.coalesce(F.size(F.filter("_hot", lambda h: h["doc_id"] < F.col("doc_id"))), F.lit(0))
        docs = docs.withColumn("_own", F.get(own, F.lit(0))["rows"]).withColumn("seg", 2 * below + F.col("_own").isNotNull().cast("int"))
        base = ["doc_id", "text", "salt", "part", "b", "seg"]
        single = docs.filter("_own is null").select(*base, *plain[1:])
        counted = docs.filter("_own is not null").withColumn("k", F.xxhash64("text")).groupBy(*base, "k", "_own").agg(F.count("*").alias("copies"))
        at = (F.col("k").cast("double") + 2.0**63) / 2.0**64 * F.ceil(F.col("_own") / most)
        docs = single.unionByName(counted.select(*base, F.floor(at).alias("slice"), "k", "copies"))
    firsts = docs.filter("doc_id is not null").groupBy("part", *KEY).agg(F.min(F.struct("doc_id", "k")).alias("first"))
    tops = {r["part"]: r["top"] for r in firsts.groupBy("part").agg(F.max(F.struct(*KEY)).alias("top")).collect()}  # RANGES rows at most
    parts = sorted(tops)
    as_key = lambda t: F.struct(F.lit(t["b"]).cast("long").alias("b"), F.lit(t["seg"]).alias("seg"), F.lit(t["slice"]).cast("long").alias("slice"))
    before = F.create_map(*[x for p, q in zip(parts, [parts[-1], *parts]) for x in (F.lit(p), as_key(tops[q]))])
    prior = F.coalesce(F.lag(F.struct(*KEY)).over(Window.partitionBy("part").orderBy(*KEY)), before[F.col("part")])
    firsts = firsts.select(F.col("first.doc_id").alias("_id"), F.col("first.k").alias("_k"), prior.alias("_to"))
    if firsts.count() <= broadcast_rows:
        firsts = F.broadcast(firsts)
    ghosts = docs.join(firsts, (F.col("doc_id") == F.col("_id")) & (F.col("k") == F.col("_k")))
    cols = ["doc_id", "text", "salt", "k", "copies"]
    ghosts = ghosts.select(*cols, "_to.*", F.lit(True).alias("ghost"))
    return docs.select(*cols, *KEY, F.lit(False).alias("ghost")).unionByName(ghosts), split


def fingerprints(documents: DataFrame, **options) -> DataFrame:
    """One row for each row of ``documents``: doc_id, text, edited (the last
    quarter of the text's code points replaced by the first as many, or all,
    of the next document's), the sketches of both and of the next text, and
    matched, the anchors that text and edited have at the same place.

    A null text is empty. Rows follow each other by doc_id, those that share
    one by their texts (by their texts' hashes where very many do). A row without doc_id has no next document (an empty
    one). Equal texts have equal sketches; an empty text has an empty one.
    Repeated rows are rows of their own, and follow each other. Long texts are
    rows like others; other columns are ignored; no rows, none.
    """
    rows, split = with_next(documents, **options)
    order = Window.partitionBy(*KEY, "salt").orderBy("ghost", "doc_id", "k", "text")
    known = F.col("doc_id").isNotNull()
    # Texts alone are shuffled; anchors are found behind the first window.
    rows = rows.withColumn("next", F.when(known, F.lead("text").over(order)))
    rows = _with_anchors(rows, "text", "own", never_none=True).withColumn("_placed", placed(F.col("own"))).withColumn("own", sketch(F.col("own")))
    rows = rows.withColumn("next_own", F.when(known, F.lead("own").over(order))).filter(~F.col("ghost"))
    if split:  # all but the last of equal rows that were counted are followed by their like
        rows = rows.select("*", F.posexplode(F.array(F.lit(1).cast("long"), F.col("copies") - 1)).alias("_like", "_times")).filter("_times > 0")
        rows = rows.withColumns({"next": F.when(F.col("_like") == 1, F.col("text")).otherwise(F.col("next")), "next_own": F.when(F.col("_like") == 1, F.col("own")).otherwise(F.col("next_own"))})
    n = F.char_length("text")
    q = F.floor(n / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - q), F.coalesce(F.substring("next", F.lit(1), q), F.lit("")))).drop("next")
    rows = _with_anchors(rows, "edited", "other", never_none=True).withColumn("matched", F.size(F.array_intersect("_placed", placed(F.col("other")))).cast("long")).withColumn("other", sketch(F.col("other")))
    if split:
        rows = rows.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))).alias("_copy"))
    return rows.select("doc_id", "text", "edited", "own", "other", F.coalesce("next_own", F.array().cast("array<bigint>")).alias("next_own"), "matched")
