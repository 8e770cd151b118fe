"""Substring dedup by content-defined chunking.

A gear hash rolls over a text's UTF-8 bytes, and a chunk ends where some of its
bits are zero, so borders depend on the bytes just before them and an insertion
shifts no border behind it. Chunks are compared by digest. A digest's first
occurrence (by doc_id, text hash, place) owns it; every other is a seed, in
another document or further on in the same one.

A repeated passage begins and ends inside chunks, so seeds are grown to its true
borders: consecutive seeds that are consecutive in one owner form a segment, the
owner's CONTEXT bytes on both sides are fetched, and the segment is extended
while the bytes are equal. (Behind a passage's border the chunkers fall into
step within a few chunks, far less than CONTEXT.) Segments of MIN_WORDS words
or more are removed; the owner keeps its passage, and as owners come strictly
earlier, one copy of every passage stays. A digest that two different chunks
share by chance is harmless: the bytes around it differ, so its segment stays
one chunk, far under MIN_WORDS.

Chunks are written once as (digest, doc_id, fp, seq) and shuffled twice: as
partial counts, and to meet the repeated digests where those are too many to
broadcast. Only owners of seeds and documents with seeds are chunked again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save, ship

MIN, MAX, BITS = 16, 128, 5
MIN_WORDS = 50
CONTEXT = 512
PIECE = 1 << 20
BROADCAST_ROWS = 500_000

_RNG = np.random.default_rng(11)
_GEAR = _RNG.integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64)
_R = 0x9E3779B97F4A7C15
_M = np.uint64(0xC2B2AE3D27D4EB4F)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.cumprod(out)


_POWERS: list[np.ndarray] = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        _POWERS.extend([_powers(_R, PIECE + MAX + 1), _powers(pow(_R, -1, 1 << 64), PIECE + MAX + 1)])
    return _POWERS[0], _POWERS[1]


def chunk_ends(raw: np.ndarray) -> np.ndarray:
    """The ends of a byte array's chunks, each MIN to MAX bytes (the last may
    be shorter). The hash of the last 16 bytes is summed in four doublings."""
    marks = []
    for lo in range(0, len(raw), PIECE):
        start = max(0, lo - 15)
        h = _GEAR[raw[start : lo + PIECE]]
        for k in (1, 2, 4, 8):
            more = h.copy()
            more[k:] += h[:-k] << np.uint32(k)
            h = more
        hits = np.flatnonzero((h >> np.uint32(15 - BITS)) & np.uint32((1 << BITS) - 1) == 0) + start + 1
        marks.append(hits[hits > lo])
    ends, last, n = [], 0, len(raw)
    for p in [*np.concatenate(marks).tolist(), n] if marks else []:
        while p - last > MAX:
            last += MAX
            ends.append(last)
        if p - last >= MIN or p == n and p > last:
            last = p
            ends.append(p)
    return np.array(ends, np.int64)


def digests(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each chunk: a polynomial over random byte values,
    shifted back to the chunk's start and mixed with its length."""
    up, down = _tables()
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    out = np.zeros(len(ends), np.uint64)
    for lo in range(0, len(raw), PIECE):
        mine = slice(*np.searchsorted(starts, [lo, lo + PIECE]))
        if mine.start == mine.stop:
            continue
        part = raw[lo : lo + PIECE + MAX]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=sums[1:])
        a, b = starts[mine] - lo, ends[mine] - lo
        x = (sums[b] - sums[a]) * down[a] ^ (b - a).astype(np.uint64)
        x = (x ^ (x >> np.uint64(31))) * _M
        out[mine] = x ^ (x >> np.uint64(29))
    return out


def _raw(text: str | None) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass") if text else b"", np.uint8)


def _keyed(documents: DataFrame) -> DataFrame:
    """doc_id, fp (hash of the text), text; rows without doc_id go."""
    return documents.filter("doc_id is not null").select("doc_id", F.xxhash64("text").alias("fp"), "text")


def chunks(documents: DataFrame) -> DataFrame:
    """(digest, doc_id, fp, seq): all chunks of all texts."""

    def run(batches):
        for pdf in batches:
            found = []
            for text in pdf["text"].tolist():
                raw = _raw(text)
                found.append(digests(raw, chunk_ends(raw)))
            sizes = [len(x) for x in found]
            if sum(sizes):
                seq = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
                yield pd.DataFrame({"digest": np.concatenate(found).view(np.int64), "doc_id": np.repeat(pdf["doc_id"].to_numpy(), sizes), "fp": np.repeat(pdf["fp"].to_numpy(), sizes), "seq": seq})

    return _keyed(documents).mapInPandas(run, "digest long, doc_id long, fp long, seq int")


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


DOC = ["doc_id", "fp"]


def segments(documents: DataFrame) -> DataFrame:
    """(doc_id, fp, first, last, owner, owner_fp, owner_first, owner_last):
    runs of chunks that are a run of the owner too, which comes earlier."""
    found = save(chunks(documents), "chunks")
    shared = save(found.groupBy("digest").agg(F.min("doc_id").alias("owner"), F.count("*").alias("n")).filter("n > 1").select("digest", "owner"), "shared")
    met = save(found.join(_few(shared), "digest").dropDuplicates(["digest", *DOC, "seq"]), "met")
    first = met.filter("doc_id = owner").groupBy("digest").agg(F.min(F.struct("fp", "seq")).alias("o")).select("digest", F.col("o.fp").alias("owner_fp"), F.col("o.seq").alias("owner_seq"))
    own = (F.col("doc_id") == F.col("owner")) & (F.col("fp") == F.col("owner_fp")) & (F.col("seq") == F.col("owner_seq"))
    seeds = met.join(_few(save(first, "owners")), "digest").filter(~own).drop("digest")
    w = Window.partitionBy(*DOC).orderBy("seq")
    same = lambda c, step: F.col(c) == F.lag(c).over(w) + step
    goes_on = same("seq", 1) & same("owner", 0) & same("owner_fp", 0) & same("owner_seq", 1)
    seeds = seeds.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = [f("seq").alias(a) for f, a in ((F.min, "first"), (F.max, "last"))] + [f("owner_seq").alias(a) for f, a in ((F.min, "owner_first"), (F.max, "owner_last"))]
    return seeds.groupBy(*DOC, "_run", "owner", "owner_fp").agg(*ends).drop("_run")


def _contexts(documents: DataFrame, found: DataFrame) -> DataFrame:
    """(owner, owner_fp, seq, side, bytes): CONTEXT bytes before (side 0) those
    chunks of owners at which segments begin and behind (1) those at which they end."""
    ends = F.array(F.struct(F.col("owner_first").alias("seq"), F.lit(0).alias("side")), F.struct(F.col("owner_last").alias("seq"), F.lit(1).alias("side")))
    asked = found.select("owner", "owner_fp", F.explode(ends).alias("at")).distinct().groupBy("owner", "owner_fp").agg(F.collect_list("at.seq").alias("seqs"), F.collect_list("at.side").alias("sides"))
    texts = _keyed(documents).join(save(asked, "asked"), (F.col("doc_id") == F.col("owner")) & (F.col("fp") == F.col("owner_fp"))).select("owner", "owner_fp", "seqs", "sides", "text")

    def run(batches):
        for pdf in batches:
            rows = []
            for owner, fp, seqs, sides, text in zip(*(pdf[c] for c in ("owner", "owner_fp", "seqs", "sides", "text")), strict=True):
                raw = _raw(text)
                ends = chunk_ends(raw)
                for seq, side in zip(seqs, sides, strict=True):
                    a, b = int(ends[seq - 1]) if seq else 0, int(ends[seq])
                    rows.append((owner, fp, seq, side, (raw[b : b + CONTEXT] if side else raw[max(0, a - CONTEXT) : a]).tobytes()))
            yield pd.DataFrame(rows, columns=["owner", "owner_fp", "seq", "side", "bytes"])

    return texts.mapInPandas(run, "owner long, owner_fp long, seq int, side int, bytes binary")


def grown(documents: DataFrame) -> DataFrame:
    """The segments with the owner's bytes to their left and right."""
    found = save(segments(documents), "segments")
    around = save(_contexts(documents, found), "contexts")
    for side, (at, name) in enumerate((("owner_first", "left"), ("owner_last", "right"))):
        # Repeated rows give the same bytes more than once.
        own = around.filter(F.col("side") == side).dropDuplicates(["owner", "owner_fp", "seq"]).select("owner", "owner_fp", F.col("seq").alias(at), F.col("bytes").alias(name))
        found = found.join(own, ["owner", "owner_fp", at])
    return found


def _equal_from(a: np.ndarray, b: np.ndarray) -> int:
    """How many bytes two arrays share from their starts on."""
    n = min(len(a), len(b))
    odd = np.flatnonzero(a[:n] != b[:n])
    return int(odd[0]) if len(odd) else n


def _cut(text: str | None, found, min_words: int) -> tuple:
    """A text without its repeated passages, the number of code points
    removed, their spans, and the owners."""
    if text is None or found is None:
        return text, 0, [], []
    raw = _raw(text)
    data, ends = raw.tobytes(), chunk_ends(raw)
    spans, owners = [], set()
    for r in found:
        a, b = int(ends[r["first"] - 1]) if r["first"] else 0, int(ends[r["last"]])
        left, right = np.frombuffer(r["left"], np.uint8), np.frombuffer(r["right"], np.uint8)
        b += _equal_from(raw[b:], right)
        a -= _equal_from(raw[:a][::-1], left[::-1])
        while a < b and raw[a] & 0xC0 == 0x80:  # never inside a character
            a += 1
        while a < b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if len(data[a:b].split()) >= min_words:
            spans.append((a, b))
            owners.add(r["owner"])
    joined: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if joined and a <= joined[-1][1]:
            joined[-1] = joined[-1][0], max(b, joined[-1][1])
        else:
            joined.append((a, b))
    at, chars = 0, 0
    kept, places = [], []
    for a, b in [*joined, (len(data), len(data))]:
        before, gone = (data[x:y].decode("utf-8", "surrogatepass") for x, y in ((at, a), (a, b)))
        kept.append(before)
        chars += len(before)
        if gone:
            places.append({"start": chars, "end": chars + len(gone)})
        chars += len(gone)
        at = b
    return "".join(kept), sum(p["end"] - p["start"] for p in places), places, sorted(owners)


def dedup_substrings(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``documents`` with all its columns, the text without repeated passages,
    and n_removed (code points), spans (their [start, end) in the old text)
    and owners (the doc_ids that keep them) added; an input's columns of these
    names are replaced.

    A null text stays null; an empty one has no chunks. Rows without doc_id
    are left as they are and lend nothing. Rows that repeat a doc_id and its
    text are one document and get one result; rows that share a doc_id but
    not the text are documents of their own, those of the lesser text hash
    first. Long texts are chunked in pieces. No rows: none.
    """
    ship(documents.sparkSession)
    new = ("n_removed", "spans", "owners")
    cols = [c for c in documents.columns if c.lower() not in new]
    found = grown(documents).groupBy(F.col("doc_id").alias("_sub_id"), F.col("fp").alias("_sub_fp")).agg(F.collect_list(F.struct("first", "last", "owner", "left", "right")).alias("_sub_r"))
    found = save(found, "found")
    rows = documents.select(*cols).join(found, (F.col("doc_id") == F.col("_sub_id")) & (F.xxhash64("text") == F.col("_sub_fp")), "left").drop("_sub_id", "_sub_fp")
    touched = F.col("_sub_r").isNotNull() & F.col("text").isNotNull()

    @F.pandas_udf("text string, n_removed long, spans array<struct<start:int,end:int>>, owners array<long>")
    def cut(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_cut(t, r, min_words) for t, r in zip(texts, found, strict=True)], columns=["text", *new])

    still = F.struct("text", F.lit(0).cast("long").alias("n_removed"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"), F.array().cast("array<long>").alias("owners"))
    # Only touched texts go to Python; the others' places are null there.
    got = cut(F.when(touched, F.col("text")), F.when(touched, F.col("_sub_r")))
    done = rows.withColumn("_sub_cut", got).withColumn("_sub_cut", F.when(touched, F.col("_sub_cut")).otherwise(still))
    return done.select(*[F.col("_sub_cut.text") if c == "text" else F.col(c) for c in cols], *[F.col(f"_sub_cut.{c}") for c in new])
