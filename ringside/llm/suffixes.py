"""Suffix-array dedup: removes every byte of a LENGTH-byte string that also starts earlier.

Only suffixes that can have such a string are sorted. Among the K-byte strings
in LENGTH bytes, the one with the least hash (the leftmost of equals) is their
anchor. Equal strings have equal anchors at equal places, so a text falls into
blocks, runs of starts with one anchor, and a block of which no anchor recurs
in the corpus has no repeats. Then

* blocks that are equal as a whole are found by digest: all but the first are
  repeats throughout, and copies, however many, go no further;
* different blocks of one anchor are fetched as bytes, and their suffixes are
  sorted by deep-shallow sorting: multikey quicksort, with eight bytes as one
  character, orders them to SHALLOW bytes; the groups that are still alike are
  ordered by a blind trie each, down to LENGTH bytes. Neighbours that are equal
  to LENGTH bytes form a class, and all but its first suffix are repeats.

An anchor with over SPLIT different blocks is dealt to several sorts. The first
suffix of each class of such a sort then meets those of the others by the
digest of its LENGTH bytes. "First" is the order of doc_id, text hash, start.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, ship

LENGTH = 100
K = 32
SHALLOW = 32
SPLIT = 4096
#: Starts that one sort gets.
BUNDLE = 300_000
PIECE = 1 << 20
BROADCAST_ROWS = 300_000

_RNG = np.random.default_rng(12)
_LETTER, _BYTE = (_RNG.integers(0, 1 << 63, 256, dtype=np.uint64) for _ in range(2))
_P, _R = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)
_LOW = np.uint64(PIECE - 1)
_POWERS: list[np.ndarray] = []

DOC = ["doc_id", "fp"]


# --- anchors ---------------------------------------------------------------------


def _rolling(raw: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each place on, summed by doubling."""
    part, n, found, m = _LETTER[raw], 1, None, 0
    while k:
        if k & 1:
            if found is None:
                found, m = part, n
            else:
                size = len(raw) - m - n + 1
                found, m = found[:size] * np.uint64(pow(_P, n, 1 << 64)) + part[m : m + size], m + n
        k >>= 1
        if k:
            size = len(raw) - 2 * n + 1
            part, n = part[:size] * np.uint64(pow(_P, n, 1 << 64)) + part[n : n + size], 2 * n
    found = (found ^ (found >> np.uint64(29))) * _MIX
    return found ^ (found >> np.uint64(32))


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of the ``width`` keys from each place on."""
    n = 1
    while 2 * n <= width:
        keys, n = np.minimum(keys[:-n], keys[n:]), 2 * n
    return np.minimum(keys[: len(keys) - width + n], keys[width - n :]) if n < width else keys


def _digests(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    if not _POWERS:
        for base in (_R, pow(_R, -1, 1 << 64)):
            powers = np.ones(PIECE + (1 << 13), np.uint64)
            powers[1:] = np.uint64(base)
            _POWERS.append(np.cumprod(powers))
    up, down = _POWERS
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    x = (sums[end] - sums[start]) * down[start] ^ (end - start).astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def blocks(raw: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """The blocks of a text: anchor, digest, first start, number of starts,
    place of the anchor from the first start on."""
    k = min(K, max(1, length // 3))
    width = length - k + 1
    out = []
    for lo in range(0, len(raw) - length + 1, PIECE // 2):
        part = raw[lo : lo + PIECE // 2 + length - 1]
        hashes = _rolling(part, k)
        least = _least(hashes & ~_LOW | np.arange(len(hashes), dtype=np.uint64), width)
        at = (least & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        n = np.diff(np.append(first, len(at)))
        at = at[first]
        out.append((hashes[at].view(np.int64), _digests(part, first, first + n + length - 1).view(np.int64), first + lo, n, at - first))
    if not out:
        return (np.zeros(0, np.int64),) * 5
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _keyed(documents: DataFrame) -> DataFrame:
    """doc_id, fp (hash of the text), raw bytes; rows without doc_id go."""
    return documents.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("fp"), F.col("text").cast("binary").alias("raw"))


def _raw(value) -> np.ndarray:
    return np.frombuffer(value or b"", np.uint8)


def recurring_anchors(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """(anchor): those of more than one block."""

    def run(batches):
        for batch in batches:
            found = [blocks(_raw(x), length)[0] for x in batch.column("raw").to_pylist()]
            if found:
                anchor, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(n)], names=["anchor", "n"])

    each = _keyed(documents).mapInArrow(run, "anchor long, n long")
    return each.groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor")


def all_blocks(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """(anchor, digest, doc_id, fp, place): place has the first start, the
    number of starts and the anchor's place, in bits 24 on, 12 to 23, 0 to 11."""

    def run(batches):
        for batch in batches:
            found = [blocks(_raw(x), length) for x in batch.column("raw").to_pylist()]
            sizes = [len(x[0]) for x in found]
            if sum(sizes):
                anchor, digest, first, n, at = (np.concatenate(x) for x in zip(*found, strict=True))
                ids = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), sizes) for c in DOC)
                yield pa.RecordBatch.from_arrays(list(map(pa.array, (anchor, digest, *ids, first << 24 | n << 12 | at))), names=["anchor", "digest", *DOC, "place"])

    return _keyed(documents).mapInArrow(run, "anchor long, digest long, doc_id long, fp long, place long")


# --- deep-shallow sorting -----------------------------------------------------------


def words(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros behind the end."""
    x = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(np.uint64)
    for n in (1, 2, 4):
        x[:-n] = (x[:-n] << np.uint64(8 * n)) | x[n:]
        x[-n:] <<= np.uint64(8 * n)
    return x[: len(raw)]


def _partition(group: np.ndarray, side: np.ndarray) -> np.ndarray:
    """The order that puts each group's sides 0, 1, 2 one after the other."""
    return np.argsort(3 * group + side, kind="stable")


def shallow(data: np.ndarray, starts: np.ndarray, group: np.ndarray, depth: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of suffixes inside given groups, to ``depth`` bytes:
    their order, and a number for each place in it that only those alike so far
    share. Every round splits all open groups at a pivot each; those alike
    to the pivot go on with their next eight bytes."""
    word = words(data)
    order = np.argsort(group, kind="stable")
    group = group[order]
    new = np.concatenate([[True], group[1:] != group[:-1]])
    at = np.zeros(len(order), np.int64)  # bytes alike so far
    while True:
        begin = np.flatnonzero(new)
        number = np.cumsum(new) - 1
        size = np.diff(np.append(begin, len(order)))
        open_ = np.flatnonzero((size[number] > 1) & (at < depth))
        if not len(open_):
            return order, number
        of = number[open_]
        key = word[starts[order[open_]] + at[open_]]
        middle = begin + size // 2
        pivot_of = np.zeros(len(order), word.dtype)
        pivot_of[open_] = key
        pivot = pivot_of[middle[of]]
        side = (key >= pivot).astype(np.int64) + (key > pivot)
        moved = _partition(of, side)
        order[open_] = order[open_[moved]]
        side, of = side[moved], of[moved]
        at[open_] += 8 * (side == 1)
        new[open_] |= np.concatenate([[True], (side[1:] != side[:-1]) | (of[1:] != of[:-1])])


class BlindTrie:
    """Orders suffixes by a trie that keeps only the places where they branch:
    [depth, children by byte], or a list of the suffixes that are equal to
    ``length`` bytes. A suffix goes down by its bytes at these depths alone,
    is compared once with a suffix found there, and branches off where the two
    first differ."""

    def __init__(self, data: bytes, length: int):
        self.data, self.length, self.root = data, length, None

    def add(self, start: int) -> None:
        data, length = self.data, self.length
        if self.root is None:
            self.root = ([start], None)
            return
        node = self.root
        while node[1] is not None:
            found = node[1].get(data[start + node[0]])
            node = found if found is not None else next(iter(node[1].values()))
        other = node[0][0]
        a, b = data[start : start + length], data[other : other + length]
        if a == b:
            node[0].append(start)
            return
        same = length - ((int.from_bytes(a) ^ int.from_bytes(b)).bit_length() + 7) // 8
        parent, node = None, self.root
        while node[1] is not None and node[0] < same:
            parent, node = node, node[1][data[start + node[0]]]
        leaf = ([start], None)
        if node[1] is not None and node[0] == same:
            node[1][data[start + same]] = leaf
            return
        inner = (same, {b[same]: node, a[same]: leaf})
        if parent is None:
            self.root = inner
        else:
            parent[1][a[parent[0]]] = inner

    def classes(self) -> list[list[int]]:
        """The suffixes in order, equal ones together."""
        out, rest = [], [self.root] if self.root else []
        while rest:
            depth, children = rest.pop()
            if children is None:
                out.append(depth)
            else:
                rest.extend(children[c] for c in sorted(children, reverse=True))
        return out


def sort_suffixes(raw: bytes, starts: np.ndarray, group: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Deep-shallow sorting: the order of ``starts`` inside each group by their
    ``length`` bytes, and which of this order begin a class of equal ones."""
    order, number = shallow(np.frombuffer(raw, np.uint8), starts, group, min(SHALLOW, length // 8 * 8))
    new = np.concatenate([[True], number[1:] != number[:-1]]) if len(order) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(order))
    alike = end - begin > 1
    place = starts.tolist()
    for lo, hi in zip(begin[alike].tolist(), end[alike].tolist(), strict=True):
        mine = order[lo:hi].tolist()
        trie, at = BlindTrie(raw, length), {}
        for i in mine:
            at[place[i]] = i
            trie.add(place[i])
        found = trie.classes()
        order[lo:hi] = [at[p] for c in found for p in c]
        if len(found) > 1:
            k = lo
            for c in found:
                new[k] = True
                k += len(c)
    return order, new


# --- repeats -------------------------------------------------------------------------

FOUND = "doc_id long, fp long, first long, n long, digest binary"


def _sorted_bundle(length: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pandas().drop_duplicates(["doc_id", "fp", "place"]).sort_values(["doc_id", "fp", "place"], kind="stable")
        raw = b"".join(rows["raw"])
        n = (rows["place"].to_numpy() >> 12) & 0xFFF
        at = rows["place"].to_numpy() & 0xFFF
        size = n + length - 1
        row = np.repeat(np.arange(len(rows)), n)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        starts = np.repeat(np.cumsum(size) - size, n) + inner
        # Equal strings have one anchor, at one place.
        _, anchor = np.unique(rows["anchor"].to_numpy(), return_inverse=True)
        order, new = sort_suffixes(raw, starts, (anchor << 12)[row] + (at[row] - inner), length)
        least = np.minimum.reduceat(order, np.flatnonzero(new))
        lost = np.ones(len(row), bool)
        lost[least] = False
        first = (rows["place"].to_numpy() >> 24)[row] + inner
        begins = lost & ~np.concatenate([[False], lost[:-1] & (row[1:] == row[:-1])])
        ends = lost & ~np.concatenate([lost[1:] & (row[1:] == row[:-1]), [False]])
        begins, ends = np.flatnonzero(begins), np.flatnonzero(ends)
        split = np.flatnonzero(~lost & (rows["salts"].to_numpy() > 1)[row])
        which = np.concatenate([begins, split])
        ids = [rows[c].to_numpy()[row[which]] for c in DOC]
        digests = [None] * len(begins) + [hashlib.sha256(raw[p : p + length]).digest()[:16] for p in starts[split].tolist()]
        many = np.concatenate([ends - begins + 1, np.ones(len(split), np.int64)])
        return pa.table([*map(pa.array, ids), pa.array(first[which]), pa.array(many), pa.array(digests, pa.binary())], names=["doc_id", "fp", "first", "n", "digest"])

    return run


def _few(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= rows else df


def repeats(documents: DataFrame, length: int = LENGTH, split: int = SPLIT, bundle: int = BUNDLE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, fp, first, n): the runs of starts of ``length``-byte strings
    that also start earlier. A start is in one run."""
    if not 1 <= length <= 4000:
        raise ValueError("length must be from 1 to 4000 bytes")
    ship(documents.sparkSession)
    again = save(recurring_anchors(documents, length), "anchors")
    met = save(all_blocks(documents, length).join(_few(again, broadcast_rows), "anchor"), "blocks")
    owners = met.groupBy("anchor", "digest").agg(F.min(F.struct(*DOC, "place")).alias("o")).select("anchor", "o.*")
    owners = save(owners, "owners")
    start, many = F.shiftright("place", 24), F.shiftright("place", 12).bitwiseAND(0xFFF)
    # Blocks and their owners are matched by place, which no two of a text share.
    copies = met.join(owners.select(*DOC, "place"), [*DOC, "place"], "left_anti").select(*DOC, start.alias("first"), many.alias("n"))

    several = owners.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1")
    contested = owners.join(several, "anchor").withColumn("salts", F.ceil(F.col("n") / split).cast("int"))
    contested = save(contested.withColumn("salt", F.pmod(F.xxhash64(*DOC, "place"), "salts")), "contested")
    parts = contested.agg(F.sum(many)).first()[0] or 0
    parts = parts // bundle + 1
    asked = contested.select(*DOC, "place", "anchor", "salts", F.pmod(F.xxhash64("anchor", "salt"), F.lit(parts)).alias("bundle"))
    asked = asked.groupBy(*DOC).agg(F.collect_list(F.struct("place", "anchor", "salts", "bundle")).alias("asked"))
    texts = _keyed(documents).join(save(asked, "asked"), DOC)

    def cut(batches):
        for batch in batches:
            rows = []
            for doc, fp, raw, mine in zip(*(batch.column(c).to_pylist() for c in (*DOC, "raw", "asked")), strict=True):
                for r in mine:
                    a, n = r["place"] >> 24, (r["place"] >> 12) & 0xFFF
                    rows.append((r["bundle"], doc, fp, r["place"], r["anchor"], r["salts"], raw[a : a + n + length - 1]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            cols = zip(*rows, strict=True) if rows else ([],) * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["bundle", *DOC, "place", "anchor", "salts", "raw"])

    pieces = texts.mapInArrow(cut, "bundle long, doc_id long, fp long, place long, anchor long, salts int, raw binary")
    found = save(pieces.groupBy("bundle").applyInArrow(_sorted_bundle(length), FOUND), "sorted")
    kept = found.filter("digest is not null")
    least = kept.groupBy("digest").agg(F.min(F.struct(*DOC, "first")).alias("o")).select("o.*")
    later = kept.join(least, [*DOC, "first"], "left_anti")
    cols = [*DOC, "first", "n"]
    return copies.select(*cols).unionByName(found.filter("digest is null").select(*cols)).unionByName(later.select(*cols))


def _removed(raw: bytes, runs, length: int) -> tuple[bytes, list[dict]]:
    """A text's remaining bytes and the spans that go."""
    spans: list[list[int]] = []
    for a, n in sorted((r["first"], r["n"]) for r in runs):
        b = a + n + length - 1
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
        else:
            spans.append([a, b])
    ends = [0, *(x for s in spans for x in s), len(raw)]
    return b"".join([raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)]), [{"start": a, "end": b} for a, b in spans]


def dedup_suffixes(documents: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """``documents`` with all its columns and n_bytes, n_removed, spans (the
    maximal removed runs, [start, end) in bytes) and kept (the remaining bytes)
    added; an input's columns of these names are replaced.

    A null text counts as empty; a text of fewer than ``length`` bytes keeps all.
    Rows without doc_id are left as they are and lend nothing. Rows that repeat
    a doc_id and its text are one document and get one result; rows that share
    a doc_id but not the text are documents of their own, those of the lesser
    text hash first. Long texts are cut into pieces of anchors. No rows: none.
    """
    new = ("n_bytes", "n_removed", "spans", "kept")
    cols = [c for c in documents.columns if c.lower() not in new]
    found = repeats(documents, length, **options).groupBy(F.col("doc_id").alias("_suf_id"), F.col("fp").alias("_suf_fp")).agg(F.collect_list(F.struct("first", "n")).alias("_suf_runs"))
    found = save(found, "repeats")
    rows = documents.select(*cols).join(found, (F.col("doc_id") == F.col("_suf_id")) & (F.xxhash64("text") == F.col("_suf_fp")), "left").drop("_suf_id", "_suf_fp")
    raw = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    touched = F.col("_suf_runs").isNotNull()

    @F.pandas_udf("kept binary, spans array<struct<start:long,end:long>>")
    def remove(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, []) if r is None else _removed(t, r, length) for t, r in zip(texts, found, strict=True)], columns=["kept", "spans"])

    # Only touched texts go to Python; the others' places are null there.
    got = remove(F.when(touched, raw), F.when(touched, F.col("_suf_runs")))
    still = F.struct(raw.alias("kept"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))
    done = rows.withColumn("_suf_cut", got).withColumn("_suf_cut", F.when(touched, F.col("_suf_cut")).otherwise(still))
    n = F.octet_length(raw).cast("long")
    return done.select(*cols, n.alias("n_bytes"), (n - F.octet_length("_suf_cut.kept")).alias("n_removed"), F.col("_suf_cut.spans").alias("spans"), F.col("_suf_cut.kept").alias("kept"))
