"""Token-ID output: patched frame-of-reference blocks of token ids.

File format. A table of segments (Parquet rows, so that Spark's committer makes
the write atomic and lost tasks are repeated): shard, segment, doc_ids, counts
and one binary ``payload`` per segment of at most ``SEGMENT`` ids or one
document. The payload, little-endian throughout:

    magic "PFR1" | n ids u32 | n blocks u32 | starts u32 x (n blocks + 1)
    block: minimum u32 | width u8 | n exceptions u8 | ids packed in ``width``
           bits each (block minimum subtracted, low bits only)
           | exception positions u8 | exception high parts u32

A block holds BLOCK ids (the last of a segment fewer). The width is the smallest
even one (over 16: multiple of 4) that holds PERCENTILE of the block; what is
larger leaves its high bits in the exception list. ``starts`` index the blocks, so one block can be read alone.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save, ship

BLOCK = 128
PERCENTILE = 0.9
SEGMENT = 1 << 18
CACHE = 1_000_000
MAGIC = b"PFR1"
SEGMENTS = "shard int, segment int, doc_ids array<long>, counts array<long>, payload binary"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# --- the block codec -------------------------------------------------------


def _lay(rows: np.ndarray, width: int) -> np.ndarray:
    """The low bits of each row, laid end to end: four values (two of over 16
    bits) fill whole bytes of one 64-bit word."""
    per = 4 if width <= 16 else 2
    parts = (rows & np.uint32((1 << width) - 1)).astype("<u8").reshape(len(rows), -1, per)
    words = sum(parts[:, :, k] << np.uint64(k * width) for k in range(per))
    return words[:, :, None].view(np.uint8)[:, :, : per * width // 8].reshape(len(rows), -1)


def _lift(packed: np.ndarray, width: int) -> np.ndarray:
    """What _lay laid."""
    per = 4 if width <= 16 else 2
    wide = np.zeros((len(packed), BLOCK // per, 8), np.uint8)
    wide[:, :, : per * width // 8] = packed.reshape(len(packed), BLOCK // per, -1)
    words = wide.view("<u8")
    mask = np.uint64((1 << width) - 1)
    return np.concatenate([(words >> np.uint64(k * width)) & mask for k in range(per)], axis=2).astype(np.uint32).reshape(len(packed), BLOCK)


def pack(ids: np.ndarray) -> bytes:
    """Encodes a segment's ids (unsigned 32-bit)."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK, np.uint32)
    padded[:n] = ids
    if n:
        padded[n:] = ids[n - 1]
    rows = padded.reshape(blocks, BLOCK)
    low = rows.min(axis=1) if n else np.zeros(0, np.uint32)
    rest = rows - low[:, None]
    if n:
        at = np.partition(rest, int(PERCENTILE * (BLOCK - 1)), axis=1)[:, int(PERCENTILE * (BLOCK - 1))]
        width = np.ceil(np.log2(at.astype(np.float64) + 1)).astype(np.int64)
        step = np.where(width <= 16, 2, 4)  # whole bytes, see _lay
        width = -(-width // step) * step
    else:
        width = np.zeros(0, np.int64)
    high = rest >> np.minimum(width, 31).astype(np.uint32)[:, None]
    high[width >= 32] = 0
    out: list[bytes] = [b""] * blocks
    for w in np.unique(width):
        mine = np.flatnonzero(width == w)
        if w:
            packed = _lay(rest[mine], int(w))
        else:
            packed = np.zeros((len(mine), 0), np.uint8)
        for row, b in zip(packed, mine, strict=True):
            odd = np.flatnonzero(high[b])
            out[b] = struct.pack("<IBB", int(low[b]), int(w), len(odd)) + row.tobytes() + odd.astype(np.uint8).tobytes() + high[b][odd].astype("<u4").tobytes()
    starts = np.zeros(blocks + 1, np.int64)
    np.cumsum([len(x) for x in out], out=starts[1:])
    return MAGIC + struct.pack("<II", n, blocks) + starts.astype("<u4").tobytes() + b"".join(out)


def unpack(payload: bytes) -> np.ndarray:
    """Decodes a segment."""
    if payload[:4] != MAGIC:
        raise ValueError("not a PFR1 segment")
    n, blocks = struct.unpack_from("<II", payload, 4)
    starts = np.frombuffer(payload, "<u4", blocks + 1, 12).astype(np.int64)
    raw = np.frombuffer(payload, np.uint8, offset=12 + 4 * (blocks + 1))
    head = starts[:-1]
    low = sum(raw[head + k].astype(np.uint32) << np.uint32(8 * k) for k in range(4)) if blocks else np.zeros(0, np.uint32)
    width, odd = raw[head + 4].astype(np.int64), raw[head + 5].astype(np.int64)
    rows = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            mine = np.flatnonzero(width == w)
            size = w * BLOCK // 8
            rows[mine] = _lift(raw[(head[mine] + 6)[:, None] + np.arange(size)], int(w))
    if odd.any():  # the exception lists of all blocks, laid end to end
        block = np.repeat(np.arange(blocks), odd)
        order = np.arange(len(block)) - np.repeat(np.cumsum(odd) - odd, odd)
        base = (head + 6 + width * BLOCK // 8)[block]
        pos = raw[base + order].astype(np.int64)
        tail = base + odd[block] + 4 * order
        high = sum(raw[tail + k].astype(np.uint32) << np.uint32(8 * k) for k in range(4))
        rows[block, pos] |= high << width[block].astype(np.uint32)
    return (rows + low[:, None]).reshape(-1)[:n]


def unpack_block(payload: bytes, block: int) -> np.ndarray:
    """Decodes one block, found through the index."""
    n, blocks = struct.unpack_from("<II", payload, 4)
    start, end = struct.unpack_from("<II", payload, 12 + 4 * block)
    base = 12 + 4 * (blocks + 1)
    left = min(BLOCK, n - block * BLOCK)
    one = MAGIC + struct.pack("<II", left, 1) + struct.pack("<II", 0, end - start) + payload[base + start : base + end]
    return unpack(one)


# --- tokenising -------------------------------------------------------------

_ENCODERS: dict[str, "Encoder"] = {}


class Encoder:
    """Encodes texts with a tokenizers file; ids as little-endian u32 bytes.

    A single space between two characters that aren't white space is always a
    border of byte-level pre-tokens, so a text is the sequence of its pieces
    between such spaces, and marks after a letter or digit are pre-tokens of
    their own. Pieces are encoded by the library once and then kept, up to
    CACHE of them; new ones go to it many at a time, as one text, whose ids
    part where a token begins with a space. Texts with a piece that begins or
    ends with white space, or holds an added token's string, go to the library
    whole. A batch's pieces are dictionary-encoded by Arrow, so that each
    distinct one is looked up once, and the ids of all places are gathered by
    numpy.
    """

    MARKS = ".,!|%&*$#;:"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        import re

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")
        # A character that all added tokens have, for a quick test.
        self.mark = min(set.intersection(*map(set, special)), default="") if special else "\0"
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True  # the byte-level space
        self.pieces: dict[str, bytes] = {}  # each stands for a space and the piece
        self.odd: set[str] = set()  # pieces whose texts go to the library whole; they have no ids here
        self.ends: dict[bytes, tuple[int, bytes]] = {}  # marks behind a letter or digit
        self.is_mark, self.is_stem = np.zeros(256, bool), np.zeros(256, bool)
        self.is_mark[list(self.MARKS.encode())] = True
        self.is_stem[[b for b in range(128) if chr(b).isalnum()]] = True
        self.split_ok = self._is_byte_level(path)

    @staticmethod
    def _is_byte_level(path: str) -> bool:
        import json

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        return pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and spec.get("normalizer") is None

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _spaced_ids(self, new: list[str]) -> list[bytes]:
        """The ids of each piece after a space."""
        out: list[bytes] = []
        for lo in range(0, len(new), 500):
            part = new[lo : lo + 500]
            raw = self._ids([" " + " ".join(part)])[0]
            at = (4 * np.flatnonzero(self.spaced[np.frombuffer(raw, "<u4")])).tolist()
            if len(at) == len(part):
                out.extend([raw[a:b] for a, b in zip(at, [*at[1:], len(raw)])])
            else:
                out.extend(self._ids([" " + x for x in part]))
        return out

    def _learn(self, new: list[str]) -> None:
        plain = [x for x in new if x.isalnum()]
        if len(plain) < len(new):
            for x in new:
                if not x.isalnum():
                    if not x or x[0].isspace() or x[-1].isspace() or self.mark in x and self.special.search(x):
                        self.odd.add(x)
                        self.pieces[x] = b""
                    else:
                        plain.append(x)
        self.pieces.update(zip(plain, self._spaced_ids(plain), strict=True))

    def _split(self, texts: list[str]):
        """The texts' pieces and where each text's begin: pieces without the
        marks behind an ASCII letter or digit, and these marks as codes of
        ``ends`` (0: none)."""
        import pyarrow as pa
        import pyarrow.compute as pc

        parts = pc.split_pattern(pa.array(texts, pa.string()), " ")
        values, begin = parts.flatten(), parts.offsets.to_numpy() - parts.offsets[0].as_py()
        at = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1, 4 * values.offset)
        raw = np.frombuffer(values.buffers()[2], np.uint8) if at[-1] else np.zeros(1, np.uint8)
        lo, end = at[:-1], at[1:].copy()
        open_ = np.flatnonzero((end > lo) & self.is_mark[raw[np.maximum(end - 1, 0)]])
        marked = open_
        while len(open_):
            end[open_] -= 1
            open_ = open_[(end[open_] > lo[open_]) & self.is_mark[raw[np.maximum(end[open_] - 1, 0)]]]
        marked = marked[(end[marked] > lo[marked]) & self.is_stem[raw[np.maximum(end[marked] - 1, 0)]]]
        marked = np.setdiff1d(marked, begin[:-1], assume_unique=True)  # first pieces have no space before them
        clean = np.zeros(len(values), bool)
        clean[marked] = True
        stems = pc.if_else(pa.array(clean), pc.utf8_rtrim(values, characters=self.MARKS), values)
        code = np.zeros(len(values), np.int64)
        one = at[1:][marked] - end[marked] == 1
        single, byte = marked[one], raw[end[marked[one]]]
        for b in np.unique(byte).tolist():
            code[single[byte == b]] = self._end(bytes([b]))
        for i in marked[~one].tolist():
            code[i] = self._end(raw[end[i] : at[i + 1]].tobytes())
        return stems.dictionary_encode(), code, begin

    def _end(self, marks: bytes) -> int:
        """The code of some marks: their place in ``ends``, from 1 on."""
        if marks not in self.ends:
            self.ends[marks] = len(self.ends) + 1, self._ids([marks.decode()])[0]
        return self.ends[marks][0]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.split_ok:
            return self._ids(texts)
        if len(self.pieces) > CACHE:
            self.pieces.clear()
            self.odd.clear()
        if not texts:
            return []
        coded, marks, begin = self._split(texts)
        code, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        heads = [distinct[c] for c in code[begin[:-1]].tolist()]
        known = self.pieces
        self._learn([x for x in distinct if x not in known])
        each = [known[x] for x in distinct]
        each += self._ids(heads)
        each += [b"", *(ids for _, ids in self.ends.values())]
        whole = np.fromiter((h[-1:].isspace() for h in heads), bool, len(heads))
        if self.odd:
            odd = np.fromiter((x in self.odd for x in distinct), bool, len(distinct))
            whole |= np.logical_or.reduceat(odd[code], begin[:-1])
        code[begin[:-1]] = len(distinct) + np.arange(len(texts))
        code = np.stack([code, marks + (len(distinct) + len(texts))], axis=1).ravel()
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
        pool = np.frombuffer(b"".join(each), "<u4")
        n = sizes[code]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = pool[np.repeat((np.cumsum(sizes) - sizes)[code] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        upto = (4 * ends[2 * begin]).tolist()
        out = [ids[a:b] for a, b in zip(upto, upto[1:])]
        again = np.flatnonzero(whole).tolist()
        for i, x in zip(again, self._ids([texts[i] for i in again]), strict=True):
            out[i] = x
        return out


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_ids(documents: DataFrame, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Writes all documents' ids, each followed by ``end_id``, as segments in
    ascending doc_id order (shards are ranges of doc_id), and returns the
    table read back. A null text is an empty one; a null doc_id comes first;
    rows that share a doc_id follow in the order of their texts. A text
    longer than a segment gets a segment of its own. No rows: no segments.
    """
    ship(documents.sparkSession)
    path = tokenizer or default_tokenizer()

    def run(batches):
        from pyspark import TaskContext

        shard, k = TaskContext.get().partitionId(), 0
        ids: list[bytes] = []
        docs: list = []
        held = 0
        end = np.array([end_id], "<u4").tobytes()

        def out():
            nonlocal k, held
            counts = [len(x) // 4 for x in ids]
            row = (shard, k, list(docs), counts, pack(np.frombuffer(b"".join(ids), "<u4")))
            ids.clear()
            docs.clear()
            k, held = k + 1, 0
            return pd.DataFrame([row], columns=["shard", "segment", "doc_ids", "counts", "payload"])

        for pdf in batches:
            texts = pdf["text"].tolist()
            for lo in range(0, len(texts), 1024):
                for doc, x in zip(pdf["doc_id"].iloc[lo : lo + 1024].tolist(), encoder(path).encode(texts[lo : lo + 1024]), strict=True):
                    if held and held + len(x) // 4 + 1 > SEGMENT:
                        yield out()
                    ids.append(x + end)
                    docs.append(None if doc is None else int(doc))
                    held += len(x) // 4 + 1
        if docs:
            yield out()

    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spark = documents.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    # As text, ids pass through pandas unrounded even beside nulls.
    return save(ranged.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, SEGMENTS), "ids")


def read_ids(segments: DataFrame, broadcast_rows: int = 500_000) -> DataFrame:
    """Reads the segments: doc_id, start (ids of all documents before it),
    n_tokens, ids_crc32 (over the ids as little-endian u32). The segments'
    starts are broadcast while there are ``broadcast_rows`` of them or fewer."""
    ship(segments.sparkSession)
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    sums = segments.groupBy("shard").agg(F.sum(total).alias("n"))
    # One row a shard: as many as the write had partitions.
    before = sums.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    inside = Window.partitionBy("shard").orderBy("segment")
    starts = segments.select("shard", "segment", total.alias("n")).withColumn("inside", F.sum("n").over(inside) - F.col("n")).join(before, "shard").select("shard", "segment", (F.col("inside") + F.col("shard_start")).alias("start"))

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                raw = unpack(r.payload).astype("<u4").tobytes()
                ends = np.cumsum(r.counts)
                begin = ends - r.counts
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array([None if d is None or d != d else int(d) for d in r.doc_ids], dtype="Int64"),
                        "start": begin + r.start,
                        "n_tokens": np.asarray(r.counts, np.int64),
                        "ids_crc32": np.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin, ends, strict=True)], np.int64),
                    }
                )

    if segments.count() <= broadcast_rows:
        starts = F.broadcast(starts)
    joined = segments.join(starts, ["shard", "segment"]).select("doc_ids", "counts", "payload", "start")
    return joined.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
