"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Both tokenizers encode a space and the text. The cumulative byte ends of each
side's tokens are the keys of a dictionary from end to index; the ends that
both dictionaries have, sorted, cut the two id lists into groups, and the
links, pairs of tokens whose byte ranges overlap, are expanded group by group.

Between two words that a single space parts, both tokenizers always begin a
token with that space (byte-level pre-tokens begin there, and no piece holds a
space behind another character), so a text is aligned word by word and each
distinct word only once a worker. Texts where this is not certain (white space
in a row, at an end, or at a word's edge), and words whose tokens don't give
back their bytes, are encoded whole.

A pair's count is the number of links that hold it in the whole corpus. A text
keeps its distinct pairs with their numbers; these are summed over the corpus,
and the counts are joined back to the pairs, by a broadcast where their number
is small and a shuffle otherwise.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import save, ship

#: Words that a worker keeps aligned, in two generations each.
WORDS = 150_000
#: Bytes of text that a task aligns before it gives rows on.
PART = 1 << 19
BROADCAST_ROWS = 1_000_000
ADDED = "n_a long, n_b long, n_groups long, n_links long, groups string, pair_a array<int>, pair_b array<int>, pair_n array<int>"


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# --- one pair of token lists ---------------------------------------------------


def slices(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The groups between common ends: each one's end in bytes, and how many a
    and b tokens end there or before. Ends are cumulative byte counts."""
    at_a = dict(zip(ends_a.tolist(), range(1, len(ends_a) + 1)))  # noqa: B905
    at_b = dict(zip(ends_b.tolist(), range(1, len(ends_b) + 1)))  # noqa: B905
    common = sorted(at_a.keys() & at_b.keys())
    upto = (np.fromiter(map(at.__getitem__, common), np.int64, len(common)) for at in (at_a, at_b))
    return np.array(common, np.int64), *upto


def links(ends_a: np.ndarray, ends_b: np.ndarray, common: np.ndarray, upto_a: np.ndarray, upto_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of the a and b tokens whose byte ranges overlap, and how many
    links there are up to the end of each group. Inside a group, tokens that
    overlap do so up to the first end of either, so a group of n and m tokens
    expands to one link for each of its n + m - 1 different ends."""
    ends = np.sort(np.concatenate([ends_a, np.setdiff1d(ends_b, common, assume_unique=True)]), kind="stable")
    return np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends), upto_a + upto_b - np.arange(1, len(common) + 1)


class Aligner:
    """Aligns texts under two tokenizers: a byte-level tokenizers file and a
    sentencepiece model."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        back = byte_letters()
        self.bytes_a: dict[int, bytes] = {}
        added = {i: t.content for i, t in self.a.get_added_tokens_decoder().items()}
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = added[i].encode() if i in added else bytes(back[c] for c in token)
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        of_a = [self.bytes_a.get(i, b"") for i in range(max(self.bytes_a) + 1)]
        self.length_a, self.length_b = (np.array([len(t) for t in x], np.int64) for x in (of_a, self.bytes_b))
        shown = [str(i) for i in range(max(len(of_a), len(self.bytes_b)))]
        # An id before a comma, before the bar, and before a semicolon.
        self.shown, self.n_shown = np.array([x + mark for mark in ",|;" for x in shown], object), len(shown)
        self.by_word = not any(b" " in t.lstrip(b" ") for t in self.bytes_b)
        self.words: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def ids(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Both sides' ids of a space and each text."""
        of_a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        return of_a, self.b.encode(texts, num_threads=1)

    def _aligned(self, parts: list[str], ids_a: list[int], ids_b: list[int]) -> list[tuple] | None:
        """(sizes, groups, link pairs as bytes) of each of ``parts``, whose ids are those of all, each behind a space. None where
        the tokens don't give back the bytes, or no group ends with a part."""
        raw = [b" " + p.encode("utf-8", "surrogatepass") for p in parts]
        whole = b"".join(raw)
        if b"".join([self.bytes_a[i] for i in ids_a]) != whole or b"".join([self.bytes_b[i] for i in ids_b]) != whole:
            return None
        a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        common, upto_a, upto_b = slices(ends_a, ends_b)
        last = np.cumsum([len(x) for x in raw])
        at = np.searchsorted(common, last)
        if at[-1] == len(common) or (common[at] != last).any():
            return None
        link_a, link_b, upto = links(ends_a, ends_b, common, upto_a, upto_b)
        pairs = (a[link_a] << 32 | b[link_b]).tobytes()
        shown = self._shown(a, b, upto_a, upto_b)
        n_a, n_b, n_groups = (np.diff(x, prepend=0).tolist() for x in (upto_a[at], upto_b[at], at + 1))
        # The three numbers as one, so that a text's are added up at once.
        sizes = [x << 80 | y << 40 | z for x, y, z in zip(n_a, n_b, n_groups, strict=True)]
        out, x, p = [], 0, 0
        for n, to_x, to_p in zip(sizes, (upto_a[at] + upto_b[at]).tolist(), (8 * upto[at]).tolist(), strict=True):
            out.append((n, "".join(shown[x:to_x]), pairs[p:to_p]))
            x, p = to_x, to_p
        return out

    def _shown(self, a: np.ndarray, b: np.ndarray, upto_a: np.ndarray, upto_b: np.ndarray) -> list[str]:
        """The ids of all groups in the order in which they are written, each
        with the mark behind it."""
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[upto_a - 1] = last_b[upto_b - 1] = True
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + np.concatenate([[0], upto_b])[group_a]] = a + self.n_shown * last_a
        code[np.arange(len(b)) + upto_a[group_b]] = b + 2 * self.n_shown * last_b
        return self.shown[code].tolist()

    def _learn(self, new: list[str]) -> None:
        """Aligns new words, many as one text. None stands for a word whose
        texts are aligned whole."""
        for lo in range(0, len(new), 2000):
            part = new[lo : lo + 2000]
            self.words.update(dict.fromkeys(part))
            plain = [w for w in part if w and not w[0].isspace() and not w[-1].isspace()]
            if plain:
                (of_a,), (of_b,) = self.ids([" ".join(plain)])
                rows = self._aligned(plain, of_a, of_b)
                if rows is None:
                    alone = [self._aligned([w], x, y) for w, x, y in zip(plain, *self.ids(plain), strict=True)]
                    rows = [x[0] if x else None for x in alone]
                self.words.update(zip(plain, rows, strict=True))

    def align(self, texts: list[str | None]) -> list[tuple]:
        """A row of ADDED for each text."""
        if len(self.words) > WORDS:
            self.words, self.older = {}, self.words
        split = [t.split(" ") if t and self.by_word else [] for t in texts]
        known = self.words
        new = set().union(*split).difference(known)
        again = new & self.older.keys()
        known.update({w: self.older[w] for w in again})
        self._learn(list(new - again))
        found = [list(map(known.__getitem__, words)) for words in split]
        again = [k for k, (t, parts) in enumerate(zip(texts, found, strict=True)) if t and (not parts or None in parts)]
        for k, x, y in zip(again, *self.ids([texts[k] for k in again]), strict=True):
            found[k] = self._aligned([texts[k]], x, y) or []
        return [self._row(parts) for parts in found]

    @staticmethod
    def _row(parts: list[tuple]) -> tuple:
        if not parts:
            return 0, 0, 0, 0, "", *(np.zeros(0, np.int32) for _ in range(3))
        sizes, shown, linked = zip(*parts, strict=True)
        size, low = sum(sizes), (1 << 40) - 1
        pairs, n = np.unique(np.frombuffer(b"".join(linked), np.int64), return_counts=True)
        return size >> 80, size >> 40 & low, size & low, int(n.sum()), "".join(shown)[:-1], (pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32), n.astype(np.int32)


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable
    Latin-1 characters stand for themselves, the others follow from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


# --- the corpus ------------------------------------------------------------------


def align(documents: DataFrame, tokenizers: tuple[str, str] | None = None) -> DataFrame:
    """``documents`` with all its columns and ADDED: the numbers of tokens,
    groups and links, the groups as ``a1,a2|b1;a3|b2,b3``, and the distinct
    linked id pairs with their numbers; an input's columns of these names are
    replaced.

    A text that is null, empty, or whose tokens don't give back its bytes has
    zeros, no groups and no pairs. Repeated rows get one result each. Long
    texts are whole; a task holds about PART characters more. No rows: none.
    """
    ship(documents.sparkSession)
    paths = tokenizers or default_tokenizers()
    added = StructType.fromDDL(ADDED)
    base = documents.select(*[c for c in documents.columns if c.lower() not in added.names])
    schema = to_arrow_schema(added)
    at = next(k for k, c in enumerate(base.columns) if c.lower() == "text")

    def run(batches):
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < len(size):
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + PART, "right")))
                part = batch.slice(lo, hi - lo)
                rows = zip(*aligner(*paths).align(part.column(at).to_pylist()), strict=True)
                new = [pa.array(values, kind) for values, kind in zip(rows, schema.types, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*batch.schema.names, *schema.names])
                lo = hi

    return base.mapInArrow(run, StructType([*base.schema.fields, *added.fields]))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, n, best) of all linked id pairs: n links hold the pair, and best
    says that no other pair of b has more."""
    each = aligned.select(F.explode(F.arrays_zip("pair_a", "pair_b", "pair_n")).alias("p"))
    counts = each.groupBy(F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b")).agg(F.sum("p.pair_n").alias("n"))
    counts = save(counts, "pair_counts")
    # A b has no more pairs than tokenizer a has ids.
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(aligned: DataFrame, counts: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``aligned`` without its pairs, with n_best (links whose pair is the best
    of its b) and count_sum (the counts of all links) added. ``aligned`` should
    be a written table: its rows are numbered."""
    kept = [c for c in aligned.columns if c.lower() not in ("pair_a", "pair_b", "pair_n", "n_best", "count_sum", "_row")]
    rows = aligned.withColumn("_row", F.monotonically_increasing_id())
    each = rows.select("_row", *kept, F.explode_outer(F.arrays_zip("pair_a", "pair_b", "pair_n")).alias("_p"))
    each = each.withColumns({"_a": F.col("_p.pair_a"), "_b": F.col("_p.pair_b"), "_n": F.col("_p.pair_n")}).drop("_p")
    right = counts.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("n").alias("_count"), F.col("best").alias("_best"))
    if right.count() <= broadcast_rows:
        right = F.broadcast(right)
    sums = [F.sum(F.when(F.col("_best"), F.col("_n").cast("long")).otherwise(0)).alias("n_best"), F.coalesce(F.sum(F.col("_n") * F.col("_count")), F.lit(0)).alias("count_sum")]
    firsts = [F.first(c).alias(c) for c in kept]
    return each.join(right, ["_a", "_b"], "left").groupBy("_row").agg(*firsts, *sums).drop("_row")
