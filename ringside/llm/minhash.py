"""Near-duplicate documents by a chosen-path set similarity join.

Documents are sets of word shingles; documents with equal sets form one class
first, and only classes are compared. Every class has 64 minwise values. A tree
branches its documents: at each node BRANCH coordinates are chosen, and a
document goes on to one child a coordinate, keyed by its minwise value there. A
node of SMALL classes or fewer is compared exhaustively; a larger one branches
on. TREES independent trees are grown. A pair of similarity j survives a branch
unless all chosen coordinates differ, so the chance q that one tree loses it
solves q = (1 - j + j q)^2: 0.0625 at j = 0.8, and 1.5e-5 for four trees.

A pair inside one component changes nothing, so what is linked early is not
branched again. The roots' children are compared first: small ones give a
spanning forest of their likely pairs (LEAST_EQUAL of 64 minwise values equal;
34 is 5 standard deviations below 0.8), large ones join each member to the
likeliest of PIVOTS members. These candidates are confirmed on full sets, and
their components become the classes' roots. Only large nodes with several roots
branch on, and only while that pays: where the children have as many open pairs
(of two roots) as the node itself, as in a family of texts that are all alike,
the node is compared as it is. To that end it is dealt into blocks, those of its
largest root apart, and each pair of blocks with open pairs becomes a node of at
most TASK members. So no pair of a node is left out, however large the node is.

Where a candidate of a forest turns out not to be similar, other pairs of its
node may still link what the forest was to join. Such nodes are looked at again
with the new roots: members with a likely pair across two roots meet with their
full sets, and every such pair is decided there, in the first of the nodes that
the pair has in common. Only links leave a node, never its pairs, so a group of
n near copies costs a few n rows; a family of n texts just under the bar costs
n squared comparisons inside tasks of bounded size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, ship
from .components import components

COORDINATES = 64
TREES = 4
BRANCH = 2
SMALL = 256
DEPTH = 4
TASK = 1024
SET_BYTES = 16 << 20
PIVOTS = 4
PAIRS_AT_ONCE = 1 << 17
COLUMNS = 4096
LEAST_EQUAL = 34
BROADCAST_ROWS = 200_000

_RNG = np.random.default_rng(7)
_A = (_RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


class _WordHashes(dict):
    """64-bit word hashes, kept while there are 100 000 or fewer."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _WordHashes()


def shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct ``size``-word shingles:
    A-Z lower-cased, words between ASCII white space. Fewer words are one
    shingle; none, or no text, an empty set."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    size = min(size, len(h))
    out = np.full(len(h) - size + 1, np.uint64(size), np.uint64)
    for k in range(size):
        out = _mix(out ^ h[k : k + len(out)])
    return np.unique(out)


def minwise(found: np.ndarray) -> np.ndarray:
    """64 minwise values, 32 bits of each."""
    low = np.full(COORDINATES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for lo in range(0, len(found), 4096):
        low = np.minimum(low, (found[lo : lo + 4096, None] * _A + _B).min(axis=0))
    return (_mix(low) >> np.uint64(32)).astype(np.uint32)


def _digest(found: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def _named_rows(documents: DataFrame) -> DataFrame:
    """row (the doc_id as text; for null the text's hash), doc_id, fp, text."""
    fp = F.xxhash64("text")
    return documents.select(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("#"), fp.cast("string"))).alias("row"), F.col("doc_id").cast("string").alias("doc_id"), fp.alias("fp"), "text")


def sketches(documents: DataFrame, size: int) -> DataFrame:
    """row, doc_id (as text), fp, n_shingles, cls (digest of the set, null for an empty one), sig."""

    def run(batches):
        for pdf in batches:
            n, cls, sig = [], [], []
            for text in pdf["text"]:  # one set at a time
                found = shingles(text, size)
                n.append(len(found))
                cls.append(_digest(found) if len(found) else None)
                sig.append(minwise(found).tobytes() if len(found) else None)
            out = {"row": pdf["row"], "doc_id": pdf["doc_id"], "fp": pdf["fp"]}
            yield pd.DataFrame(out | {"n_shingles": np.array(n, np.int64), "cls": pd.array(cls, dtype="Int64"), "sig": sig})

    return _named_rows(documents).mapInPandas(run, "row string, doc_id string, fp long, n_shingles long, cls long, sig binary")


# --- the trees ---------------------------------------------------------------

NODE = "parent long, key long, path int, used long, cls long, n long, est binary"


def _children(key: np.ndarray, path: np.ndarray, used: np.ndarray, sig: np.ndarray, depth: int):
    """Each row's child nodes at ``depth`` (1: the children of the roots).
    Down to the third level every path has coordinates of its own; below, a
    node draws among those that its path hasn't used."""
    for j in range(BRANCH):
        child = path * BRANCH + j
        first = sum(TREES * BRANCH**d for d in range(1, depth))
        if first + TREES * BRANCH**depth <= COORDINATES:
            at = first + child
        else:
            at = (_mix(key ^ np.uint64(j + 1)) % np.uint64(COORDINATES)).astype(np.int64)
            while (taken := (used >> at.astype(np.uint64)) & np.uint64(1) == 1).any():
                at = np.where(taken, (at + 1) % COORDINATES, at)
        value = sig[np.arange(len(sig)), at].astype(np.uint64)
        tag = (np.uint64(depth) << np.uint64(40)) ^ (at.astype(np.uint64) << np.uint64(32)) ^ value
        yield _mix(key ^ _mix(tag)), child, used | (np.uint64(1) << at.astype(np.uint64))


def _grow(rows: DataFrame, depth: int) -> DataFrame:
    """The next level of nodes: at depth 1 from classes, else from members of
    large nodes. ``est`` is a byte of each minwise value, enough to compare."""

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            sig = np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(len(pdf), COORDINATES)
            raw = sig.astype(np.uint8).tobytes()
            est = [raw[k : k + COORDINATES] for k in range(0, len(raw), COORDINATES)]
            if depth == 1:
                starts = [(np.full(len(pdf), _mix(np.array([t + 1], np.uint64))[0]), np.full(len(pdf), t), np.zeros(len(pdf), np.uint64)) for t in range(TREES)]
            else:
                starts = [(pdf["key"].to_numpy().astype(np.int64).view(np.uint64), pdf["path"].to_numpy().astype(np.int64), pdf["used"].to_numpy().astype(np.int64).view(np.uint64))]
            for key, path, used in starts:
                for k, p, u in _children(key, path, used, sig, depth):
                    yield pd.DataFrame({"parent": key.view(np.int64), "key": k.view(np.int64), "path": p.astype(np.int32), "used": u.view(np.int64), "cls": pdf["cls"].to_numpy(), "n": pdf["n"].to_numpy(), "est": est})

    return rows.mapInPandas(run, NODE)


# --- comparing inside nodes ------------------------------------------------------

EDGE = "key long, a long, b long"


def _few_nodes(pdf: pd.DataFrame):
    """Parts of a table of whole nodes with few pairs, or one node, each."""
    key = pdf["key"].to_numpy()
    begin = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
    upto = np.cumsum(np.diff(begin) ** 2)
    k = 0
    while k < len(upto):
        after = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + PAIRS_AT_ONCE, side="right")))
        yield pdf.iloc[begin[k] : begin[after]]
        k = after


def _whole_nodes(batches):
    """Batches sorted by key, cut so that a node is never split."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        key = pdf["key"].to_numpy()
        tail = int(np.flatnonzero(key == key[-1])[0])
        if tail:
            yield from _few_nodes(pd.concat([*held, pdf.iloc[:tail]]) if held else pdf.iloc[:tail])
            held = []
        held.append(pdf.iloc[tail:])
    if held:
        yield from _few_nodes(pd.concat(held))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _by_node(nodes: DataFrame) -> DataFrame:
    return nodes.repartition("key").sortWithinPartitions("key")


def _estimates(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), COORDINATES)


def _likely(pdf: pd.DataFrame, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows (i, j) of one node that may be similar and aren't of one
    root, and their numbers of equal minwise values."""
    key, n, root = (pdf[c].to_numpy() for c in ("key", "n", "root"))
    est = _estimates(pdf["est"])
    begin = np.flatnonzero(np.diff(key, prepend=key[0] - 1 if key[0] > 0 else key[0] + 1))
    sizes = np.diff(np.append(begin, len(key)))
    after = np.repeat(begin + sizes, sizes) - np.arange(len(key)) - 1  # rows of the node behind each
    upto = np.cumsum(after)
    out, lo = [], 0
    while lo < len(key):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS_AT_ONCE, side="right")))
        i = np.repeat(np.arange(lo, hi), after[lo:hi])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after[lo:hi]) - after[lo:hi], after[lo:hi])
        ok = (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & (root[i] != root[j])
        i, j = i[ok], j[ok]
        equal = (est[i] == est[j]).sum(axis=1, dtype=np.int16)
        ok = equal >= LEAST_EQUAL
        out.append((i[ok].astype(np.int32), j[ok].astype(np.int32), equal[ok]))
        lo = hi
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _forest(i: np.ndarray, j: np.ndarray, order: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The pairs of a spanning forest over labels, the first in ``order``
    before others: each round every tree takes its first pair to another."""
    rank = np.argsort(order, kind="stable")
    label = np.unique(label, return_inverse=True)[1]
    count, keep = int(label.max(initial=-1)) + 1, []
    while len(rank):
        x, y = label[i[rank]], label[j[rank]]
        open_ = x != y
        rank, x, y = rank[open_], x[open_], y[open_]
        if not len(rank):
            break
        first = np.full(count, len(rank))
        for side in (x, y):
            mine = np.full(count, len(rank))
            mine[side[::-1]] = np.arange(len(rank))[::-1]
            first = np.minimum(first, mine)
        chosen = np.unique(first[first < len(rank)])
        keep.append(rank[chosen])
        parent = np.arange(count)
        for a, b in zip(x[chosen].tolist(), y[chosen].tolist(), strict=True):
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            parent[max(a, b)] = min(a, b)
        while (up := parent[parent]).tolist() != parent.tolist():
            parent = up
        label = parent[label]
    return np.concatenate(keep) if keep else np.zeros(0, np.int64)


def _edges(pdf: pd.DataFrame, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
    key, cls = pdf["key"].to_numpy(), pdf["cls"].to_numpy()
    return pd.DataFrame({"key": key[i], "a": np.minimum(cls[i], cls[j]), "b": np.maximum(cls[i], cls[j])})


def _forests(nodes: DataFrame, percent: int) -> DataFrame:
    """(key, a, b): a spanning forest of each node's likely pairs over its
    roots, the likeliest first (ties by a hash of the pair, so that nodes with
    the same members give the same pairs)."""

    def run(batches):
        for pdf in _whole_nodes(batches):
            i, j, equal = _likely(pdf, percent)
            cls, key = pdf["cls"].to_numpy().view(np.uint64), pdf["key"].to_numpy()
            tie = _mix(np.minimum(cls[i], cls[j]) ^ _mix(np.maximum(cls[i], cls[j])))
            order = np.empty(len(i), np.int64)
            order[np.lexsort((tie, -equal))] = np.arange(len(i))
            # A root is a tree of its own in each node.
            label = np.unique(np.stack([key, pdf["root"].to_numpy()]), axis=1, return_inverse=True)[1].ravel()
            kept = _forest(i, j, order, label)
            yield _edges(pdf, i[kept], j[kept])

    return _by_node(nodes.select("key", "cls", "n", "est", "root")).mapInPandas(run, EDGE)


def _stars(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): each member of a large node with the likeliest of the node's
    PIVOTS, if that is likely and of another root."""
    least = [F.min(F.struct(F.xxhash64("cls", "key", F.lit(s)), "cls", "n", "root", "est")).alias(f"p{s}") for s in range(PIVOTS)]
    names = ("cls", "n", "root", "est")
    chosen = rows.groupBy("key").agg(*least).select("key", *[F.array(*[F.col(f"p{s}.{c}") for s in range(PIVOTS)]).alias(f"p_{c}") for c in names])
    chosen = save(chosen, "pivots")
    if chosen.count() * PIVOTS <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            cls, n, root, est = pdf["cls"].to_numpy(), pdf["n"].to_numpy(), pdf["root"].to_numpy(), _estimates(pdf["est"])
            best, to = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            p_cls, p_n, p_root = (np.stack(pdf[f"p_{c}"].to_numpy()) for c in ("cls", "n", "root"))
            for s in range(PIVOTS):
                equal = (est == _estimates(pd.Series([p[s] for p in pdf["p_est"]]))).sum(axis=1)
                m = p_n[:, s]
                ok = (equal >= LEAST_EQUAL) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (p_root[:, s] != root) & (equal > best)
                best, to = np.where(ok, equal, best), np.where(ok, p_cls[:, s], to)
            ok = best > 0
            yield pd.DataFrame({"a": np.minimum(cls, to)[ok], "b": np.maximum(cls, to)[ok]})

    return rows.join(chosen, "key").select("cls", "n", "root", "est", "p_cls", "p_n", "p_root", "p_est").mapInPandas(run, "a long, b long")


def _dealt(rows: DataFrame) -> DataFrame:
    """Nodes for large ones: the members of the largest root (main) and the
    others are dealt into blocks, and each pair of blocks but those of two main
    ones is a node. ``rows``: with size, main and most (main's members)."""
    block = TASK // 2
    of_main = F.col("root") == F.col("main")
    n_main, n_rest = (F.ceil(x / block).cast("int") for x in (F.col("most"), F.col("size") - F.col("most")))
    rows = rows.withColumn("of_main", of_main).withColumn("n_main", n_main).withColumn("n_rest", n_rest)
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("cls", "key"), F.when(F.col("of_main"), F.col("n_main")).otherwise(F.col("n_rest"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    task = lambda kind, i, j: F.xxhash64("key", F.lit(kind), i, j)
    to_main = F.transform(upto("n_main"), lambda k: task(0, F.col("mine"), k))
    to_rest = F.transform(upto("n_rest"), lambda k: task(1, F.least("mine", k), F.greatest("mine", k)))
    own = F.when(F.col("of_main"), F.transform(upto("n_rest"), lambda k: task(0, k, F.col("mine")))).otherwise(F.concat(to_main, to_rest))
    return rows.withColumn("key", F.explode(own)).select("key", "cls", "n", "est", "root")


# --- confirming ----------------------------------------------------------------


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar."""

    def run(batches):
        for pdf in batches:
            keep = np.zeros(len(pdf), bool)
            for i, (x, y) in enumerate(zip(pdf["x"], pdf["y"], strict=True)):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(u) + len(v) - both)
            yield pdf.loc[keep, ["a", "b"]]

    x, y = sets.select(F.col("cls").alias("a"), F.col("found").alias("x")), sets.select(F.col("cls").alias("b"), F.col("found").alias("y"))
    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInPandas(run, "a long, b long")


def _suspects(nodes: DataFrame, percent: int) -> DataFrame:
    """The members of nodes that have a likely pair across two roots."""

    def run(batches):
        for pdf in _whole_nodes(batches):
            i, j, _ = _likely(pdf, percent)
            yield pdf.iloc[np.unique(np.concatenate([i, j]))]

    return _by_node(nodes.select("key", "cls", "n", "est", "root")).mapInPandas(run, "key long, cls long, n long, est binary, root long")


def _common(rows: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """How many hashes each of ``rows`` shares with each of ``columns``."""
    both = np.intersect1d(np.concatenate(rows), np.concatenate(columns))
    out = np.zeros((len(rows), len(columns)), np.float32)
    for lo in range(0, len(both), COLUMNS):
        part = both[lo : lo + COLUMNS]
        sides = []
        for sets in (rows, columns):
            held = np.zeros((len(sets), len(part)), np.float32)
            for i, s in enumerate(sets):
                s = s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], side="right")]
                at = np.searchsorted(part, s)
                held[i, at[part[at] == s]] = 1
            sides.append(held)
        out += sides[0] @ sides[1].T
    return out


def _decided(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """A spanning forest, over roots, of the similar pairs of one node of
    suspects, without the pairs that an earlier node decides."""
    pdf = pdf.reset_index(drop=True)
    none = pd.DataFrame({"key": np.zeros(0, np.int64), "a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    i, j, _ = _likely(pdf, percent)
    key = pdf["key"].iloc[0]
    earlier = [np.sort(k[k < key]) for k in pdf["keys"]]
    known = np.unique(np.concatenate(earlier))
    if len(known):
        held = np.zeros((len(pdf), len(known)), np.float32)
        for row, mine in enumerate(earlier):
            held[row, np.searchsorted(known, mine)] = 1
        fresh = (held @ held.T)[i, j] == 0
        i, j = i[fresh], j[fresh]
    if not len(i):
        return none
    sets = [np.frombuffer(f, np.uint64) for f in pdf["found"]]
    similar = np.zeros(len(i), bool)
    r = np.unique(i)
    for lo in range(0, len(r), TASK // 4):  # some rows at a time, against those that they are likely like
        part = r[lo : lo + TASK // 4]
        mine = np.flatnonzero((i >= part[0]) & (i <= part[-1]))
        c = np.unique(j[mine])
        both = _common([sets[k] for k in part], [sets[k] for k in c])[np.searchsorted(part, i[mine]), np.searchsorted(c, j[mine])].astype(np.int64)
        n = pdf["n"].to_numpy()
        similar[mine] = 100 * both >= percent * (n[i[mine]] + n[j[mine]] - both)
    i, j = i[similar], j[similar]
    kept = _forest(i, j, np.arange(len(i)), pdf["root"].to_numpy())
    return _edges(pdf, i[kept], j[kept])


# --- the whole join ---------------------------------------------------------------


class _Sets:
    """Full sets of the classes that are asked for, computed once each."""

    def __init__(self, documents: DataFrame, classes: DataFrame, size: int):
        self.documents, self.classes, self.size = documents, classes, size
        self.known: DataFrame | None = None

    def of(self, wanted: DataFrame) -> DataFrame:
        """(cls, found) of all classes asked for so far, ``wanted`` (cls) included."""
        new = wanted if self.known is None else wanted.join(self.known.select("cls"), "cls", "left_anti")
        reps = save(self.classes.join(new, "cls", "left_semi").select("row", "cls"), "reps")
        many = reps.count()
        if many:
            found = save(self._computed(reps, many <= BROADCAST_ROWS), "sets")
            self.known = found if self.known is None else self.known.unionByName(found)
        return self.known if self.known is not None else reps.select("cls", F.lit(b"").alias("found"))

    def _computed(self, reps: DataFrame, few: bool) -> DataFrame:
        size = self.size

        def run(batches):
            for pdf in batches:
                found = [shingles(t, size) for t in pdf["text"]]
                yield pd.DataFrame({"cls": np.array([_digest(s) for s in found], np.int64), "found": [s.tobytes() for s in found]})

        rows = reps.select("row").distinct()
        if few:
            rows, reps = F.broadcast(rows), F.broadcast(reps)
        texts = _named_rows(self.documents).join(rows, "row", "left_semi").select("text")
        return texts.mapInPandas(run, "cls long, found binary").join(reps.select("cls"), "cls", "left_semi").dropDuplicates(["cls"])


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()


def _joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """(cls, root) after ``links`` (a, b); a class that isn't there is its own root."""
    if roots is None:
        return components(links).select(F.col("node").alias("cls"), "root")
    for side in ("a", "b"):
        at = roots.select(F.col("cls").alias(side), F.col("root").alias("_r"))
        links = links.join(at, side, "left").withColumn(side, F.coalesce("_r", side)).drop("_r")
    links = save(links.filter("a <> b").distinct(), "links")
    if not links.limit(1).count():
        return roots
    up = components(links)
    moved = roots.join(up, roots["root"] == up["node"], "left").select("cls", F.coalesce(up["root"], roots["root"]).alias("root"))
    fresh = up.join(roots, up["node"] == roots["cls"], "left_anti").select(F.col("node").alias("cls"), "root")
    return save(moved.unionByName(fresh), "roots")


def _rooted(rows: DataFrame, roots: DataFrame, few: bool) -> DataFrame:
    """``rows`` with their present root."""
    return rows.drop("root").join(F.broadcast(roots) if few else roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _sized(rows: DataFrame) -> DataFrame:
    """``rows`` (key, cls, root, ...) with their node's size, its open pairs
    (of two roots), its largest root (main) and that one's members (most).
    Nodes of one root go."""
    counts = rows.groupBy("key", "root").agg(F.count("*").alias("c"))
    total = F.sum("c")
    sizes = counts.groupBy("key").agg(total.alias("size"), ((total * total - F.sum(F.col("c") * F.col("c"))) / 2).cast("long").alias("open"), F.max(F.struct("c", "root")).alias("top"))
    sizes = sizes.filter("open > 0").select("key", "size", "open", F.col("top.root").alias("main"), F.col("top.c").alias("most"))
    return rows.join(sizes, "key")


def _is_small():
    """A node that one task compares as it is."""
    return (F.col("size") <= SMALL) | ((F.col("size") <= TASK) & (F.col("open") <= SMALL * SMALL))


def _roots(classes: DataFrame, sets: _Sets, percent: int) -> DataFrame:
    """(cls, root): the components of all classes that have links."""
    level = save(_sized(_grow(classes, 1).drop("parent").withColumn("root", F.col("cls"))), "nodes")
    nodes = [level.filter(_is_small())]
    large = level.filter(~_is_small())
    forests = [save(_forests(nodes[0], percent), "forests")]
    first = save(forests[0].select("a", "b").unionByName(_stars(large, percent)).distinct(), "pairs")
    similar = save(_confirmed(first, sets.of(_ends(first)), percent), "links")
    roots = _joined(None, similar)
    few = roots.count() <= BROADCAST_ROWS

    facts = ("size", "open", "main", "most")
    member = ("key", "cls", "n", "est", "root")
    rows = save(_sized(_rooted(large.drop(*facts), roots, few)), "mixed")
    found, deeper = [], []
    for depth in range(2, DEPTH + 1):
        deeper.append(rows.filter(_is_small()).select(*member))
        rows = rows.filter(~_is_small())
        if not rows.limit(1).count():
            break
        if depth > 2:
            found.append(_stars(rows, percent))
        grown = _grow(rows.select("key", "path", "used", "cls", "n").join(classes.select("cls", "sig"), "cls"), depth)
        level = save(_sized(_rooted(grown, roots, few)), "nodes")
        left = level.select("parent", "key", "open").distinct().groupBy("parent").agg(F.sum("open").alias("left"))
        pays = save(rows.select("key", "open").distinct().join(left, F.col("key") == F.col("parent"), "left").filter(F.coalesce("left", F.lit(0)) < F.col("open")).select("key"), "pays") if depth < DEPTH else rows.select("key").limit(0)
        deeper.append(_dealt(rows.join(_few(pays), "key", "left_anti")))
        rows = save(level.join(_few(pays.withColumnRenamed("key", "parent")), "parent", "left_semi"), "rows")
    nodes.append(save(_union(deeper), "deeper"))
    if nodes[1].limit(1).count():
        forests.append(save(_forests(nodes[1], percent), "forests"))
        pairs = _union([forests[1].select("a", "b"), *found]).distinct().join(first, ["a", "b"], "left_anti")
        pairs = save(pairs, "pairs")
        links = save(_confirmed(pairs, sets.of(_ends(pairs)), percent), "links")
        similar = similar.unionByName(links)
        roots = _joined(roots, links)
        few = roots.count() <= BROADCAST_ROWS

    again = []
    for own, forest in zip(nodes, forests):
        failed = save(forest.join(similar, ["a", "b"], "left_anti").select("key").distinct(), "failed")
        again.append(own.select("key", "cls", "n", "est").join(_few(failed), "key", "left_semi"))
    rows = save(_suspects(_sized(_rooted(_union(again), roots, few)), percent), "suspects")
    if not rows.limit(1).count():
        return roots
    keys = rows.groupBy("cls").agg(F.collect_set("key").alias("keys"))
    # A node whose sets are long is dealt once more, so that a task holds 2 * SET_BYTES of them.
    parts = rows.groupBy("key").agg(F.ceil(F.sum("n") * 8 / SET_BYTES).cast("int").alias("parts"))
    mine = F.pmod(F.xxhash64("cls", "key"), F.col("parts")).cast("int")
    task = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.xxhash64("key", F.least(F.col("mine"), k), F.greatest(F.col("mine"), k)))
    met = rows.join(_few(parts), "key").withColumn("mine", mine).withColumn("task", F.explode(F.when(F.col("parts") > 1, task).otherwise(F.array("key")))).drop("parts", "mine")
    met = met.join(keys, "cls").join(sets.of(keys.select("cls")), "cls")
    links = save(met.groupBy("task").applyInPandas(lambda pdf: _decided(pdf, percent), EDGE).select("a", "b").distinct(), "links")
    return _joined(roots, links)


def groups(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of ``documents``: doc_id, fp (hash of the text),
    n_shingles, component_id (the smallest doc_id that links reach).

    Two rows are linked when 100 * intersection >= percent * union of their
    shingle sets. A null or empty text has no shingles and no links, and is its
    own component. Rows without doc_id have links as others do, but never give
    a component its id; one of such rows alone has none. Repeated rows are
    linked to each other; no rows, no groups. Other columns are ignored. Long
    texts are sets like others; ties don't occur, as component ids are minima.
    """
    ship(documents.sparkSession)
    own = save(sketches(documents, size), "sketches")
    number = F.col("doc_id").cast("long")
    classes = own.filter("cls is not null").groupBy("cls").agg(F.min(number).alias("least"), F.max("n_shingles").alias("n"), F.first("sig").alias("sig"), F.min("row").alias("row"))
    classes = save(classes, "classes")
    roots = _roots(classes.select("cls", "n", "sig"), _Sets(documents, classes.select("row", "cls"), size), percent)
    placed = classes.select("cls", "least").join(roots, "cls", "left").select("cls", "least", F.coalesce("root", "cls").alias("root"))
    named = placed.join(placed.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("cls", "component_id")
    out = ("doc_id", "fp", "n_shingles", "component_id")
    linked = own.filter("cls is not null").join(named, "cls").withColumn("doc_id", number).select(*out)
    # Empty texts skip the join, where their null classes would meet in one task.
    return linked.unionByName(own.filter("cls is null").withColumn("doc_id", number).withColumn("component_id", F.col("doc_id")).select(*out))


def kept(found: DataFrame) -> DataFrame:
    """Adds ``kept``: the document that stays of its group. Rows without doc_id
    stay only in a group that has no doc_id at all."""
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def drop_near_duplicates(documents: DataFrame, **options) -> DataFrame:
    """``documents`` with all columns, one document of each group: the smallest
    doc_id. Rows that repeat a doc_id and its text stay or go together."""
    gone = save(kept(groups(documents, **options)).filter("not kept").select(F.col("doc_id").alias("_near_id"), F.col("fp").alias("_near_fp")).distinct(), "gone")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return documents.join(gone, F.col("doc_id").eqNullSafe(F.col("_near_id")) & (F.xxhash64("text") == F.col("_near_fp")), "left_anti")
