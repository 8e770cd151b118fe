"""Phrase collocation mining with counting quotient filters.

Word ids of a phrase are packed into one number of 3 * b bits. An invertible
permutation of these numbers spreads them evenly; the high bits of the result
are the quotient, the low bits the remainder, kept in full, so that a filter
is lossless: quotient and remainder give back the phrase. A filter is written
in the order of its numbers: the run length of each quotient in unary, the
remainders in whole bytes, and counters only where they are over one. Tasks
write a filter for each shard of SHARD phrases, cut into ranges of quotients;
the sorted filters of a range are merged, and since the permutation spreads
the phrases, no range is hot.

Only words that occur ``min_count`` times can be in a phrase that does, so ids
are given to these. The dictionary is broadcast and bounded (DICTIONARY words
of LONG bytes at most, the most frequent first); where it does not hold all of
them, phrases with other words are counted by their text instead.
"""

from __future__ import annotations

import math
import struct
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import save, ship

MIN_COUNT = 10
WITHIN = 50
TOP = 2000
PARTS = 16
SHARD = 1 << 20
#: Phrases (with repeats) that a range of quotients gets.
RANGE = 1 << 20
#: Bytes of texts that a task takes at once, from Spark and in its own steps.
PART = 1 << 21
DICTIONARY = 500_000
LONG = 64
BROADCAST_ROWS = 100_000

#: 0: part of a word, 1: blank, 2: end of a piece.
_KIND = np.zeros(256, np.uint8)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND[list(b" \t")] = 1
_KIND[list(b".,;:!?\x0a\x0b\x0c\x0d")] = 2


# --- words -------------------------------------------------------------------------


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of some texts, A-Z lower-cased, and whether each goes on the
    piece of the word before it."""
    full = pc.fill_null(texts, "")
    wide = np.dtype(np.int64 if pa.types.is_large_string(full.type) else np.int32)
    at = np.frombuffer(full.buffers()[1], wide, len(full) + 1, wide.itemsize * full.offset).astype(np.int64) if len(full) else np.zeros(1, np.int64)
    if at[0] == at[-1]:
        return pa.array([], pa.large_string()), np.zeros(0, bool)
    raw = _LOWER[np.frombuffer(full.buffers()[2], np.uint8)[at[0] : at[-1]]]
    at = at - at[0]
    kind = _KIND[raw]
    inside = kind == 0
    before, behind = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    before[1:], behind[:-1] = inside[:-1], inside[1:]
    before[at[:-1][at[:-1] < len(raw)]] = False
    behind[at[1:][at[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~behind) + 1
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw[inside]))
    piece = np.searchsorted(np.flatnonzero(kind == 2), starts) + np.searchsorted(at, starts, "right")
    return words, np.concatenate([[False], piece[1:] == piece[:-1]])[: len(starts)]


def _by_lang(batch: pa.RecordBatch):
    """(lang, texts) of a batch, in parts of PART bytes or one row."""
    size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).cumsum()
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + PART, "right")))
        part = batch.slice(lo, hi - lo)
        for lang in part.column("lang").unique().to_pylist():
            yield lang, part.column("text").filter(pc.equal(part.column("lang"), lang))
        lo = hi


@contextmanager
def _small_batches(spark: SparkSession):
    """Batches of PART bytes or one row for what is written inside, unless the
    session names a size of its own. Large ones are allocated beside the heap,
    each anew, and an executor keeps that memory."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(name, None)
    if own is None:
        spark.conf.set(name, PART)
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(name)


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), "text")


def word_counts(documents: DataFrame) -> DataFrame:
    """(lang, word, n) of all words."""

    def run(batches):
        for batch in batches:
            for lang, texts in _by_lang(batch):
                found = words_of(texts)[0].value_counts()
                if len(found):
                    word, n = found.flatten()
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), word.cast(pa.string()), n.cast(pa.int64())], names=["lang", "word", "n"])

    each = _keyed(documents).mapInArrow(run, "lang string, word string, n long")
    return each.groupBy("lang", "word").agg(F.sum("n").alias("n"))


# --- counting quotient filters --------------------------------------------------------


class Permutation:
    """An invertible permutation of the numbers of ``bits`` bits."""

    FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)

    def __init__(self, bits: int):
        self.mask, self.shift = np.uint64((1 << bits) - 1), np.uint64((bits + 1) // 2)

    def forward(self, x: np.ndarray) -> np.ndarray:
        for f in self.FACTORS:
            x = (x * np.uint64(f)) & self.mask
            x = x ^ (x >> self.shift)  # its own inverse: half the bits or more are shifted out
        return x

    def backward(self, x: np.ndarray) -> np.ndarray:
        for f in reversed(self.FACTORS):
            x = x ^ (x >> self.shift)
            x = (x * np.uint64(pow(f, -1, 1 << 64))) & self.mask
        return x


def counted(x: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers and their counts, which are added up, of sorted numbers."""
    begin = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[begin], np.diff(np.append(begin, len(x))) if n is None else np.add.reduceat(n, begin) if len(x) else n


def dump(x: np.ndarray, n: np.ndarray, first: int, width: int, quotient: int) -> bytes:
    """A filter of sorted permuted numbers from ``first`` on, in a range of
    2**width, of which the high ``quotient`` bits are the quotient."""
    low = width - quotient
    part = x - np.uint64(first)
    runs = np.bincount((part >> np.uint64(low)).astype(np.int64), minlength=1 << quotient)
    unary = np.ones(len(x) + len(runs), np.uint8)
    unary[np.cumsum(runs) + np.arange(len(runs))] = 0
    size = (low + 7) // 8
    rest = (part & np.uint64((1 << low) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]
    many = n > 1
    return struct.pack("<IBBB", len(x), quotient, width, size) + np.packbits(unary).tobytes() + rest.tobytes() + np.packbits(many).tobytes() + n[many].astype("<u8").tobytes()


def load(blob: bytes, first: int) -> tuple[np.ndarray, np.ndarray]:
    """What dump wrote."""
    count, quotient, width, size = struct.unpack_from("<IBBB", blob)
    at = 7
    bits = count + (1 << quotient)
    unary = np.unpackbits(np.frombuffer(blob, np.uint8, (bits + 7) // 8, at), count=bits)
    at += (bits + 7) // 8
    ones = np.flatnonzero(unary)
    high = (ones - np.arange(count)).astype(np.uint64)  # zeros before it
    wide = np.zeros((count, 8), np.uint8)
    wide[:, :size] = np.frombuffer(blob, np.uint8, count * size, at).reshape(count, size)
    at += count * size
    many = np.unpackbits(np.frombuffer(blob, np.uint8, (count + 7) // 8, at), count=count).astype(bool)
    n = np.ones(count, np.int64)
    n[many] = np.frombuffer(blob, "<u8", int(many.sum()), at + (count + 7) // 8)
    return np.uint64(first) + ((high << np.uint64(width - quotient)) | wide.view("<u8").ravel()), n


def filters(x: np.ndarray, bits: int, ranges: int) -> tuple[np.ndarray, list[bytes]]:
    """A shard's permuted numbers as one filter for each of its ranges (the
    high ``ranges`` bits)."""
    x, n = counted(np.sort(x))
    width = bits - ranges
    of = (x >> np.uint64(width)).astype(np.int64)
    begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(x) else np.zeros(0, np.int64)
    end = np.append(begin[1:], len(x)) if len(x) else begin
    # About one slot for each number.
    fit = lambda k: min(width, max(0, k.bit_length() - 1))
    return of[begin], [dump(x[a:b], n[a:b], int(of[a]) << width, width, fit(int(b - a))) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]


def merge(blobs: list, first: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted filters (bytes or buffers) of one range as one: numbers and counts."""
    ends = np.cumsum([struct.unpack_from("<I", b)[0] for b in blobs]).tolist()
    x, n = np.empty(ends[-1], np.uint64), np.empty(ends[-1], np.int64)
    for blob, a, b in zip(blobs, [0, *ends], ends, strict=False):
        x[a:b], n[a:b] = load(blob, first)
    order = np.argsort(x, kind="stable")
    x, n = x[order], n[order]
    del order
    return counted(x, n)


# --- phrases -------------------------------------------------------------------------


class Dictionary:
    """Ids, from 1 on, of words by language."""

    def __init__(self, langs: pa.Array, words: pa.Array, whole: bool):
        self.whole = whole
        self.bits = max(1, len(words).bit_length())
        self.words = words.cast(pa.large_string())
        coded = langs.dictionary_encode()
        self.langs, self.lang_of = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        self.of: dict[str, tuple[pa.Array, np.ndarray]] = {}
        order = np.argsort(self.lang_of, kind="stable")
        ends = np.searchsorted(self.lang_of[order], np.arange(len(self.langs) + 1))
        for k, lang in enumerate(self.langs.to_pylist()):
            at = order[ends[k] : ends[k + 1]]
            self.of[lang] = self.words.take(pa.array(at)), at + 1

    def ids(self, lang: str, words: pa.Array) -> np.ndarray:
        """0: a word that has none."""
        coded = words.dictionary_encode()
        known, ids = self.of.get(lang, (pa.array([], pa.large_string()), np.zeros(0, np.int64)))
        found = pc.fill_null(pc.index_in(coded.dictionary, value_set=known), -1).to_numpy(zero_copy_only=False)
        each = np.append(ids, 0)[found]
        return each[coded.indices.to_numpy(zero_copy_only=False)].astype(np.uint64)

    def phrases(self, ids: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
        """Languages and texts of phrases by their three ids (the last may be 0)."""
        words = [self.words.take(pa.array(np.maximum(i, 1) - 1)) for i in ids]
        space = pa.scalar(" ", pa.large_string())
        two, three = (pc.binary_join_element_wise(*words[:k], space) for k in (2, 3))
        return self.langs.take(pa.array(self.lang_of[ids[0] - 1])), pc.if_else(pa.array(ids[2] > 0), three, two)


def _dictionary(words: DataFrame, size: int) -> Dictionary:
    """The ``size`` most frequent words of LONG bytes at most."""
    rows = words.filter(F.octet_length("word") <= LONG).orderBy(F.desc("n"), "lang", "word").limit(size).select("lang", "word").toArrow()
    rows = rows.combine_chunks()
    whole = lambda c: pa.concat_arrays(rows[c].chunks) if rows[c].num_chunks else pa.array([], pa.string())
    return Dictionary(whole("lang"), whole("word"), rows.num_rows == words.count())


def phrase_counts(documents: DataFrame, words: DataFrame, total: int, min_count: int = MIN_COUNT, dictionary: int = DICTIONARY, shard: int = SHARD, per_range: int = RANGE) -> DataFrame:
    """(lang, phrase, words, a): the phrases of two and three words that occur
    ``min_count`` times. ``words``: those that do; ``total``: words in all."""
    known = _dictionary(words, dictionary)
    bits = 3 * known.bits
    ranges = min(bits, math.ceil(math.log2(max(1, 2 * total / per_range))))
    sent = documents.sparkSession.sparkContext.broadcast(known)
    names = ["range", "filter", "lang", "phrase", "words", "n"]
    kinds = [pa.int64(), pa.binary(), pa.string(), pa.string(), pa.int32(), pa.int64()]

    def rows(*cols) -> pa.RecordBatch:
        n = max(len(c) for c in cols if c is not None)
        return pa.RecordBatch.from_arrays([pa.nulls(n, t) if c is None else pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    def run(batches):
        own, permutation = sent.value, Permutation(bits)
        held: list[np.ndarray] = []

        def out():
            packed = np.concatenate(held)
            held.clear()
            at, blobs = filters(permutation.forward(packed), bits, ranges)
            return rows(at, blobs, None, None, None, None)

        for batch in batches:
            for lang, texts in _by_lang(batch):
                found, goes_on = words_of(texts)
                ids = own.ids(lang, found)
                for k in (2, 3):
                    if len(ids) < k:
                        continue
                    last = len(ids) - k + 1
                    inside = np.logical_and.reduce([goes_on[j : last + j] for j in range(1, k)])
                    parts = [ids[j : last + j] for j in range(k)]
                    in_all = inside & np.logical_and.reduce([p > 0 for p in parts])
                    packed = np.zeros(int(in_all.sum()), np.uint64)
                    for j in range(3):
                        packed = packed << np.uint64(own.bits) | (parts[j][in_all] if j < k else np.uint64(0))
                    held.append(packed)
                    odd = np.flatnonzero(inside & ~in_all) if not own.whole else []
                    if len(odd):
                        texts_ = pc.binary_join_element_wise(*(found.take(pa.array(odd + j)) for j in range(k)), pa.scalar(" ", pa.large_string())).value_counts()
                        text, n = texts_.flatten()
                        yield rows(None, None, [lang] * len(n), text.cast(pa.string()), np.full(len(n), k, np.int32), n.cast(pa.int64()))
                if sum(map(len, held)) >= shard:
                    yield out()
        if sum(map(len, held)):
            yield out()

    def merged(key, table):
        own = sent.value
        x, n = merge([f.as_buffer() for f in table["filter"]], key[0].as_py() << (bits - ranges))
        x, n = Permutation(bits).backward(x[n >= min_count]), n[n >= min_count]
        mask, b = np.uint64((1 << own.bits) - 1), np.uint64(own.bits)
        ids = [(x >> (b * np.uint64(j)) & mask).astype(np.int64) for j in (2, 1, 0)]
        langs, texts = own.phrases(ids)
        return pa.table([langs.cast(pa.string()), texts.cast(pa.string()), pa.array(2 + (ids[2] > 0), pa.int32()), pa.array(n, pa.int64())], names=["lang", "phrase", "words", "a"])

    with _small_batches(documents.sparkSession):
        each = save(_keyed(documents).mapInArrow(run, "range long, filter binary, lang string, phrase string, words int, n long"), "filters")
    out = each.filter("filter is not null").select("range", "filter").groupBy("range").applyInArrow(merged, "lang string, phrase string, words int, a long")
    if known.whole:
        return out
    plain = each.filter("filter is null").groupBy("lang", "phrase", "words").agg(F.sum("n").alias("a")).filter(F.col("a") >= min_count)
    return out.unionByName(plain)


def _score(df: DataFrame) -> DataFrame:
    """score = floor(1000000 * a * a / (l * r)), exactly: ``div`` of decimals."""
    whole = df.withColumns({f"_{c}": F.col(c).cast("decimal(15,0)") for c in "alr"})
    return whole.withColumn("score", F.expr("(_a * _a * cast(1000000 as decimal(7,0))) div (_l * _r)")).drop("_a", "_l", "_r")


def _few(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= rows else df


def collocations(documents: DataFrame, min_count: int = MIN_COUNT, within: int = WITHIN, top: int | None = TOP, broadcast_rows: int = BROADCAST_ROWS, **options) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top``
    phrases of two and three words (None: all).

    A null language counts as ``und``; null and empty texts have no words, and
    repeated rows count each. Long texts are read whole. Ties in score and
    count are ranked by the phrase's bytes. Further columns of the input are
    ignored, whatever their names. No rows: none.
    """
    ship(documents.sparkSession)
    with _small_batches(documents.sparkSession):
        counts = save(word_counts(documents), "words")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = counts.filter(F.col("n") >= min_count)
    total = totals.agg(F.sum("n")).first()[0] or 0
    found = save(phrase_counts(documents, frequent, total, min_count, **options), "phrases")

    parts = F.split("phrase", " ")
    head, tail = F.array_join(F.slice(parts, 1, F.col("words") - 1), " "), F.substring_index("phrase", " ", -1)
    first, rest = F.substring_index("phrase", " ", 1), F.array_join(F.slice(parts, 2, F.col("words") - 1), " ")
    # The cut before the last word, and for three words that behind the first too.
    cuts = F.when(F.col("words") == 2, F.array(F.struct(F.lit(1).alias("k"), first.alias("left"), tail.alias("right")))).otherwise(
        F.array(F.struct(F.lit(1).alias("k"), first.alias("left"), rest.alias("right")), F.struct(F.lit(2).alias("k"), head.alias("left"), tail.alias("right")))
    )
    known = save(frequent.select("lang", F.col("word").alias("part"), "n").unionByName(found.filter("words = 2").select("lang", F.col("phrase").alias("part"), F.col("a").alias("n"))), "parts")
    each = found.select("lang", "phrase", "a", F.explode(cuts).alias("c")).select("lang", "phrase", "a", "c.*")
    for side, name in (("left", "l"), ("right", "r")):
        each = each.join(_few(known.select("lang", F.col("part").alias(side), F.col("n").alias(name)), broadcast_rows), ["lang", side])
    scored = _score(each).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("s"))

    longer = found.filter("words = 3")
    inner = longer.select("lang", F.explode(F.array(head, rest)).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = scored.join(_few(inner, broadcast_rows), ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < within * F.col("a")))
    ranked = left.select("lang", "phrase", "a", "s.l", "s.r", "s.score")
    best = [F.desc("score"), F.desc("a"), "phrase"]
    if top is not None:
        # A language's first ``top`` are among the first ``top`` of its parts, so
        # the last window gets PARTS times as many rows at most.
        part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*best)
        ranked = ranked.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.join(_few(totals, broadcast_rows), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
