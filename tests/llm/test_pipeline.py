"""The pipeline's stages on a small table, held against brute force."""

import corpus_pipeline as P
import numpy as np
from pyspark.sql import functions as F
from test_ops import brute_contamination, brute_groups

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    at = {}
    for name, stage in P.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        rows = out.collect()
        after = {r["doc_id"]: r for r in rows}
        assert len(after) == len(rows) and set(after) <= set(before)
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        at[name] = before, after
        docs = spark.createDataFrame(rows, out.schema)
    before, after = at["quality"]
    known = [d for d in before if d in labels]
    assert np.mean([(d in after) == bool(labels[d]) for d in known]) > 0.9
    before, after = at["line_dedup"]
    assert set(before) == set(after)
    for d, r in after.items():
        lines = before[d]["text"].split("\n")
        assert all(x in lines for x in r["text"].split("\n")) or r["text"] == ""
        assert r["n_chars"] == len(r["text"])
    before, after = at["near_dedup"]
    groups = brute_groups([(d, r["text"]) for d, r in before.items()], 5, 80)
    assert set(after) == {d for d, (_, c) in groups.items() if d == c}
    before, after = at["decontaminate"]
    for d, r in before.items():
        n, hit, _ = brute_contamination(r["text"], bench)
        assert (d in after) == (not (hit and 20 * hit >= n))
    before, after = at["packing"]
    assert set(before) == set(after)
    assert P.run(spark, SF).count() == len(after)


def test_empty_tables_pass(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_stages_keep_further_columns_whatever_their_names(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    named = "score x n_lines n_dropped spans n_removed _gone _id fp root items text_ key N_TOKENS".split()
    wide = docs.select("*", *[F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in named])
    odd = spark.createDataFrame([(None, None, None, None, None, *["v"] * len(named)), (None, "one two", "en", "s", 7, *["v"] * len(named)), (10**9, "", "en", "s", 0, *["v"] * len(named))], wide.schema)
    wide = wide.unionByName(odd).unionByName(wide.limit(1))
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, wide, SF)
        assert out.columns == wide.columns, name
        for r in out.filter("doc_id < 1000000").collect():
            assert all(r[c] == f"{c}:{r['doc_id']}" for c in named), name
    packed = P.STAGES[-1][1](spark, wide, SF)
    assert packed.count() == wide.count() and set(named) - {"N_TOKENS"} <= set(packed.columns)
