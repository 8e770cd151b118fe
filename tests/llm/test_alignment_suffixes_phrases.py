"""Alignment, suffix dedup and phrases against brute force, with nulls, empty
and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import re
import tracemalloc
from collections import Counter
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_ops import frame, prose

from ringside.llm import alignment, phrases, suffixes

# --- alignment ------------------------------------------------------------------

ODD = ["", None, " ", "  x", "a\n b", "x▁y", "ab \x00", "a  b", "<s> </s> <|endoftext|> <unk>", "naïve café Ünï", "日本語 テキスト", "　y z", "a​b ﬁ", "x " * 5, "tab\tin word", "\n", "0x41 <0x41>"]


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(*alignment.default_tokenizers())


def brute_alignment(aligner, text):
    """(ids of a, ids of b, groups, links), token by token; None without tokens."""
    if not text:
        return None
    (a,), (b,) = aligner.ids([text])
    sides = []
    for ids, of in ((a, aligner.bytes_a), (b, aligner.bytes_b)):
        if b"".join(of[i] for i in ids) != f" {text}".encode():
            return None
        ends = np.cumsum([len(of[i]) for i in ids]).tolist()
        sides.append(list(zip([0, *ends], ends, ids)))  # noqa: B905
    left, right = sides
    links = Counter((x, y) for s, e, x in left for u, v, y in right if u < e and s < v)
    groups = []
    for lo, hi in pairwise([0, *sorted({e for _, e, _ in left} & {e for _, e, _ in right})]):
        groups.append("|".join(",".join(str(i) for _, e, i in side if lo < e <= hi) for side in sides))
    return a, b, groups, links


def test_alignment_equals_brute_force_token_by_token(aligner):
    rng = np.random.default_rng(3)
    texts = [*ODD, *(prose(int(rng.integers(1, 60)), rng) for _ in range(30)), "Don't e.g. 12,345.67 naïve!!! $&% ..."]
    for text, row in zip(texts, aligner.align(texts), strict=True):
        want = brute_alignment(aligner, text)
        if want is None:
            assert row[:5] == (0, 0, 0, 0, "") and not len(row[5])
            continue
        a, b, groups, links = want
        assert row[:5] == (len(a), len(b), len(groups), links.total(), ";".join(groups))
        assert dict(zip(zip(row[5].tolist(), row[6].tolist(), strict=True), row[7].tolist(), strict=True)) == links


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab .,\n\tXé▁<0x1>日  "), max_size=30), max_size=6))
def test_alignment_of_any_texts(aligner, texts):
    for text, row in zip(texts, aligner.align(texts), strict=True):
        want = brute_alignment(aligner, text)
        assert row[4] == (";".join(want[2]) if want else "")
        assert row[3] == (want[3].total() if want else 0)


def test_alignment_keeps_rows_and_columns_and_counts_over_the_corpus(spark, aligner):
    texts = [*ODD, "the cat sat on the mat", "the cat sat on the mat", prose(3000)]
    rows = [(None if i == 3 else i % 16, t, f"c{i}", None if i % 2 else i) for i, t in enumerate(texts)]
    docs = frame(spark, rows, "doc_id long, text string, groups string, _row int")
    found = alignment.align(docs.select("doc_id", "text", F.col("groups").alias("n_A"), F.col("_row").alias("note")))
    assert found.columns[:3] == ["doc_id", "text", "note"] and found.count() == len(rows)
    links, best = Counter(), Counter()
    for t in texts:
        want = brute_alignment(aligner, t)
        links.update(want[3] if want else {})
    for (_, b), n in links.items():
        best[b] = max(best[b], n)
    found.write.mode("overwrite").parquet(path := spark.conf.get("spark.sql.warehouse.dir") + "/aligned")
    written = spark.read.parquet(path)
    counts = alignment.pair_counts(written)
    assert {(r["a"], r["b"]): r["n"] for r in counts.collect()} == links
    for bound in (10**6, 0):
        got = sorted((str(r["text"]), r["n_best"], r["count_sum"]) for r in alignment.scored(written, counts, bound).collect())
        want = []
        for t in texts:
            own = (brute_alignment(aligner, t) or [None] * 3 + [{}])[3]
            want.append((str(t), sum(n for p, n in own.items() if links[p] == best[p[1]]), sum(n * links[p] for p, n in own.items())))
        assert got == sorted(want)
    assert alignment.align(frame(spark, [])).count() == 0


# --- suffixes -------------------------------------------------------------------


def brute_suffixes(docs, length=100):
    """{(doc_id, text): (removed, spans, kept)}; the order is that of the rows."""
    seen, out = set(), {}
    for doc, text in docs:
        raw, gone = (text or "").encode(), set()
        for s in range(len(raw) - length + 1):
            if (one := raw[s : s + length]) in seen:
                gone.update(range(s, s + length))
            seen.add(one)
        spans = sum(1 for k in gone if k - 1 not in gone)
        out[doc, text] = len(gone), spans, bytes(b for k, b in enumerate(raw) if k not in gone)
    return out


@pytest.fixture(scope="module")
def repeating():
    rng = np.random.default_rng(8)
    shared, other = prose(40, rng), prose(60, rng)
    texts = [prose(int(rng.integers(1, 80)), rng) for _ in range(25)]
    for k in range(30):  # a passage between different words; near copies; long runs
        texts.append(f"{prose(int(rng.integers(0, 9)), rng)} {shared} {prose(int(rng.integers(0, 9)), rng)}")
        words = other.split()
        words[k % 60] = "edited"
        texts.append(" ".join(words))
    texts += [None, "", "x" * 99, "x" * 100, "x" * 300, "ab" * 150, "é" * 120, texts[3], texts[3], shared * 3, "\0" * 250, prose(4000, rng)]
    return [(3 * i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("options", [{}, {"split": 3, "bundle": 500, "broadcast_rows": 0}, {"length": 24}, {"length": 1}])
def test_suffix_dedup_equals_brute_force(spark, repeating, options):
    docs = frame(spark, [*((d, t, 1) for d, t in repeating), (0, repeating[0][1], 1), (None, repeating[4][1], 1)], "doc_id long, text string, spans int").repartition(5)
    got = suffixes.dedup_suffixes(docs, **options).collect()
    want = brute_suffixes(repeating, options.get("length", 100))
    assert len(got) == len(repeating) + 2
    for r in got:
        raw = (r["text"] or "").encode()
        if r["doc_id"] is None:
            assert (r["n_removed"], bytes(r["kept"])) == (0, raw)
            continue
        n, spans, kept = want[r["doc_id"], r["text"]]
        assert (r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) == (len(raw), n, spans, kept)
        assert sum(s["end"] - s["start"] for s in r["spans"]) == n
    assert suffixes.dedup_suffixes(frame(spark, [])).count() == 0


def test_rows_that_share_an_id_are_ordered_by_their_texts_hash(spark):
    a = f"{"p" * 7} {prose(30)}"
    b = f"quite another beginning {a}"
    got = {r["text"]: r for r in suffixes.dedup_suffixes(frame(spark, [(5, a), (5, b)])).collect()}
    hashed = {r["text"]: r["h"] for r in frame(spark, [(5, a), (5, b)]).select("text", F.xxhash64("text").alias("h")).collect()}
    first, later = sorted((a, b), key=hashed.get)
    assert got[first]["n_removed"] == 0
    assert got[later]["n_removed"] == len(a.encode())


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab"), min_size=0, max_size=60), min_size=1, max_size=5), st.integers(9, 40))
def test_deep_shallow_sorting_orders_suffixes(texts, length):
    raw = b"".join(t.encode() + b"\0" * length for t in texts)
    starts = np.arange(len(raw) - length + 1)
    group = starts % 3
    order, new = suffixes.sort_suffixes(raw, starts, group, length)
    shown = [(int(group[i]), raw[starts[i] : starts[i] + length]) for i in order]
    assert shown == sorted(shown) and sorted(order.tolist()) == starts.tolist()
    assert new.tolist() == [True] + [x != y for x, y in pairwise(shown)]


def test_blind_trie_orders_and_joins_equals():
    data = b"banana_bandana_banana_anna"
    trie = suffixes.BlindTrie(data, 6)
    places = range(len(data) - 5)
    for p in places:
        trie.add(p)
    found = trie.classes()
    assert [data[c[0] : c[0] + 6] for c in found] == sorted({data[p : p + 6] for p in places})
    assert sorted(p for c in found for p in c) == list(places)
    assert all(len({data[p : p + 6] for p in c}) == 1 for c in found)


def test_every_window_has_one_block_and_equal_windows_one_anchor():
    rng = np.random.default_rng(4)
    text = prose(300, rng)
    raw = np.frombuffer(f"{text} and {text} {'z' * 400}".encode(), np.uint8)
    anchor, _, first, n, at = suffixes.blocks(raw)
    starts = np.concatenate([np.arange(a, a + k) for a, k in zip(first, n, strict=True)])
    assert starts.tolist() == list(range(len(raw) - 99))
    place = np.repeat(at + first, n) - starts
    seen = {}
    for s, a, p in zip(starts.tolist(), np.repeat(anchor, n).tolist(), place.tolist(), strict=True):
        assert seen.setdefault(raw[s : s + 100].tobytes(), (a, p)) == (a, p) and 0 <= p <= 100 - suffixes.K


def test_long_texts_are_cut_into_pieces(monkeypatch, spark):
    monkeypatch.setattr(suffixes, "PIECE", 1 << 20)
    text = prose(60_000)
    raw = np.frombuffer(text.encode(), np.uint8)
    big = np.concatenate([raw] * (2 + (1 << 20) // len(raw)))
    _, _, first, n, _ = suffixes.blocks(big)
    assert first[0] == 0 and (first[1:] == (first + n)[:-1]).all() and first[-1] + n[-1] == len(big) - 99


# --- phrases ---------------------------------------------------------------------


def brute_collocations(rows, least=10, top=2000):
    f, n = Counter(), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[k : k + m])) for m in (1, 2, 3) for k in range(len(words) - m + 1))
    out = []
    for lang in n:
        mine = []
        for (at, p), a in f.items():
            if at != lang or len(p) < 2 or a < least:
                continue
            if len(p) == 2 and any(q[1][:2] == p or q[1][1:] == p for q, b in f.items() if q[0] == lang and len(q[1]) == 3 and b >= least and 2 * b >= a):
                continue
            score, _, l, r = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            mine.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(mine)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


@pytest.fixture(scope="module")
def speech():
    rng = np.random.default_rng(6)
    few = ["of", "The", "new", "york", "city", "naïve", "ß", "don't", "x-1", "Ä"]
    rows = []
    for k in range(60):
        words = rng.choice(few, 40, p=[0.25, 0.25, 0.1, 0.1, 0.1, 0.04, 0.04, 0.04, 0.04, 0.04])
        text = "".join(w + str(rng.choice([" ", "  ", "\t", ". ", ",", "\n", "\r\n", " "], p=[0.7, 0.05, 0.05, 0.05, 0.05, 0.04, 0.02, 0.04])) for w in words)
        rows.append((["en", "de", None][k % 3], text))
    rows += [("en", None), ("en", ""), (None, " . "), ("fr", "new york city " * 40), ("fr", "w" * 100 + " one two "), ("es", "solo")]
    return rows + rows[:2] + [("fr", ("w" * 100 + " one two. ") * 12)]


def plain(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("options", [{}, {"dictionary": 4, "broadcast_rows": 0}, {"dictionary": 0}, {"shard": 50, "per_range": 40}, {"top": 3}])
def test_collocations_equal_brute_force(spark, speech, options):
    docs = frame(spark, [(*r, "x", 1) for r in speech], "lang string, text string, phrase string, n int").repartition(3)
    assert plain(phrases.collocations(docs, **options)) == brute_collocations(speech, top=options.get("top", 2000))


def test_collocations_of_no_rows(spark):
    assert phrases.collocations(frame(spark, [], "lang string, text string")).count() == 0
    assert phrases.collocations(frame(spark, [(None, None)], "lang string, text string")).count() == 0


@pytest.mark.parametrize("own", [None, "100"])
def test_collocation_tasks_get_small_batches(spark, speech, monkeypatch, own):
    name, seen, save = "spark.sql.execution.arrow.maxBytesPerBatch", {}, phrases.save
    monkeypatch.setattr(phrases, "save", lambda df, table: (seen.update({table: spark.conf.get(name)}), save(df, table))[1])
    if own is not None:
        spark.conf.set(name, own)
    try:
        docs = frame(spark, speech, "lang string, text string").repartition(3)
        assert plain(phrases.collocations(docs)) == brute_collocations(speech)
        assert spark.conf.get(name, None) == own  # as it was before
    finally:
        spark.conf.unset(name)
    assert {seen["words"], seen["filters"]} == {own or str(phrases.PART)}


def test_a_task_gets_batches_of_a_few_texts(spark):
    docs = spark.range(40, numPartitions=1).select(F.lit("en").alias("lang"), F.repeat(F.lit("word "), 40_000).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows]})

    with phrases._small_batches(spark):
        got = [r["rows"] for r in docs.mapInArrow(sizes, "rows long").collect()]
    assert sum(got) == 40 and max(got) <= 11  # of 200 kB each; 40 by Spark's own rule


def test_a_merge_holds_its_numbers_only_a_few_times():
    rng = np.random.default_rng(4)
    blobs = [phrases.filters(rng.integers(0, 1 << 45, 1 << 16, np.uint64), 45, 0)[1][0] for _ in range(4)]
    numbers = len(phrases.merge(blobs, 0)[0])
    tracemalloc.start()
    try:
        phrases.merge(blobs, 0)
        assert tracemalloc.get_traced_memory()[1] < 56 * numbers
    finally:
        tracemalloc.stop()


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [(10**12 + 7, 10**12 + 9, 10**12 + 8), (3, 7, 11), (999_999_999_999, 10**12, 10**12)]
    got = phrases._score(spark.createDataFrame(rows, "a long, l long, r long")).collect()
    assert {(r["a"], r["score"]) for r in got} == {(a, 10**6 * a * a // (l * r)) for a, l, r in rows}


def test_words_are_those_of_a_plain_search(speech):
    texts = [t for _, t in speech]
    for part in (pa.array(texts)[:0], pa.array([None, ""]), pa.array(["Cut off", "Ab, c"])[1:]):  # a slice without nulls shares its buffers
        assert phrases.words_of(part)[0].to_pylist() == ([] if len(part) != 1 else ["ab", "c"])
    words, goes_on = phrases.words_of(pa.array(["cut off", *texts])[1:])
    want, follows = [], []
    for t in texts:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", t or ""):
            found = re.findall(r"[^\x20\x09]+", piece)
            want += found
            follows += [k > 0 for k in range(len(found))]
    assert [w.lower() for w in want] == [w.lower() for w in words.to_pylist()] and goes_on.tolist() == follows


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.data())
def test_quotient_filters_give_back_their_numbers(bits, data):
    x = data.draw(st.lists(st.integers(0, (1 << bits) - 1), min_size=1, max_size=300))
    ranges = data.draw(st.integers(0, min(bits, 6)))
    keys = np.array(x + x[: len(x) // 2], np.uint64)
    permutation = phrases.Permutation(bits)
    moved = permutation.forward(keys)
    assert permutation.backward(moved).tolist() == keys.tolist() and int(moved.max()) < 1 << bits
    halves = [dict(zip(*(p.tolist() if isinstance(p, np.ndarray) else p for p in phrases.filters(moved[k::2], bits, ranges)), strict=True)) for k in (0, 1)]
    total = Counter()
    for at in {k for h in halves for k in h}:
        found, n = phrases.merge([h[at] for h in halves if at in h], at << (bits - ranges))
        assert (np.diff(found.astype(object)) > 0).all()
        total.update(dict(zip(permutation.backward(found).tolist(), n.tolist(), strict=True)))
    assert total == Counter(keys.tolist())


def test_suffix_query_digests_what_remains(spark):
    from ringside.llm.queries import QUERIES

    rows = QUERIES["op12_suffix_dedup"](spark, "/root/testdata/sf0.001").collect()
    texts = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
    want = brute_suffixes(texts)
    for r in rows:
        n, spans, kept = want[r["doc_id"], dict(texts)[r["doc_id"]]]
        assert (r["n_removed"], r["n_spans"], r["kept_sha256"]) == (n, spans, hashlib.sha256(kept).hexdigest())
