"""The corpus queries: one for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontam, fingerprints, linededup, minhash, packing, phrases, quality, secrets, substring, suffixes, tokenbin, toxicity
from .common import held_out, save, table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.fingerprints(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprints.printed(F.col("own")).alias("fingerprint"),
        fingerprints.printed(F.col("other")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("own"), F.col("other")).alias("near_edited"),
        fingerprints.likeness(F.col("own"), F.col("next_own")).alias("near_next"),
        "matched",
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.judged(decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "text")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Each text is counted once; the lengths alone are read again.
    docs = save(table(spark, sf_dir, "documents").select("doc_id", packing.piece_count(F.col("text")).alias("pieces")), "lengths")
    return packing.pack(docs, F.col("pieces")).drop("pieces")


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.read_ids(tokenbin.write_ids(table(spark, sf_dir, "documents")))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = substring.dedup_substrings(docs.withColumn("n_chars", F.char_length("text").cast("long")))
    return found.select("doc_id", "n_chars", "n_removed", F.size("spans").cast("long").alias("n_spans"), (F.col("n_removed") > 0).alias("repeated"), "owners", "text")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.kept(minhash.groups(table(spark, sf_dir, "documents"), size=2, percent=80))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"), 3, 1)).select("doc_id", F.col("toxic").alias("y"))
    held = {r["y"]: r["n"] for r in labels.filter("y in (0, 1)").groupBy("y").agg(F.count("*").alias("n")).collect()}
    texts = docs.join(F.broadcast(toxicity.chosen(labels)), "doc_id").select("text", "y")
    scored = toxicity.score(docs, toxicity.train(texts, held=held))
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = save(quality.measured(table(spark, sf_dir, "documents").select("doc_id", "text")), "measured")
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"), 4, 2)).select("doc_id", F.col("quality").alias("y"))
    scored = quality.score(rows, quality.train(rows.join(labels, "doc_id")))
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    found = save(found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"), "pair_a", "pair_b", "pair_n"), "aligned")
    counts = save(alignment.pair_counts(found), "counts")
    return alignment.scored(found, counts).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.dedup_suffixes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


QUERIES = {
    f.__name__: f
    for f in (op1_fingerprints, op2_decontamination, op3_line_dedup, op4_packing, op5_token_output, op6_substring_dedup, op7_near_duplicates, op8_toxicity, op9_secrets, op10_quality, op11_alignment, op12_suffix_dedup, op13_collocations)
}
_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    "op2_decontamination": f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) w FROM documents), i AS (SELECT item_id::VARCHAR item, {_WORDS} w FROM benchmark),
g AS (SELECT DISTINCT item, least(13, len(w)) m, array_to_string(w[k : k + least(13, len(w)) - 1], ' ') gram FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) k FROM i WHERE len(w) > 0)),
l AS (SELECT DISTINCT m FROM g), p AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) k FROM d, l WHERE len(w) >= m),
h AS (SELECT DISTINCT doc_id, k, m, item FROM (SELECT doc_id, k, m, array_to_string(w[k : k + m - 1], ' ') gram FROM p) JOIN g USING (m, gram)),
n AS (SELECT doc_id, count(DISTINCT place) n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) place FROM (SELECT DISTINCT doc_id, k, m FROM h)) GROUP BY 1),
s AS (SELECT doc_id, count(DISTINCT item) n_items, string_agg(DISTINCT item, ',' ORDER BY item) items FROM h GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)""",
    "op13_collocations": r"""
WITH d AS (SELECT doc_id, coalesce(lang, 'und') lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) piece FROM d)),
g AS (SELECT lang, m, array_to_string(w[k : k + m - 1], ' ') phrase, w[k] w1, w[k + m - 1] w9, array_to_string(w[k : k + m - 2], ' ') head, array_to_string(w[k + 1 : k + m - 1], ' ') rest
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) k FROM p, (VALUES (1), (2), (3)) x(m) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, any_value(w1) w1, any_value(w9) w9, any_value(head) head, any_value(rest) rest, count(*) a FROM g GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(len(w))::BIGINT n FROM p GROUP BY 1),
c AS (SELECT lang, phrase, m, a, 1 k, w1 x, rest y FROM f WHERE m > 1 UNION ALL SELECT lang, phrase, m, a, 2, head, w9 FROM f WHERE m = 3),
s AS (SELECT c.*, u.a l, v.a r, (1000000::HUGEINT * c.a * c.a) // (u.a::HUGEINT * v.a) score FROM c JOIN f u ON u.lang = c.lang AND u.phrase = c.x JOIN f v ON v.lang = c.lang AND v.phrase = c.y),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT lang, part, max(a) longer FROM (SELECT lang, head part, a FROM f WHERE m = 3 UNION ALL SELECT lang, rest, a FROM f WHERE m = 3) GROUP BY 1, 2),
r AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, phrase) "rank" FROM b LEFT JOIN o ON o.lang = b.lang AND o.part = b.phrase WHERE longer IS NULL OR 100 * longer < 50 * b.a)
SELECT lang, "rank", phrase, a, l, r, n, score::BIGINT AS score FROM r JOIN n USING (lang) WHERE "rank" <= 2000""",
    # Strings of 100 bytes meet by their 128-bit digests.
    "op12_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) h FROM documents),
u AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY w ORDER BY doc_id, s) n FROM (SELECT doc_id, s, md5_number(substring(h, 2 * s - 1, 200)) w FROM (SELECT doc_id, h, unnest(range(1, len(h) // 2 - 98)) s FROM d WHERE len(h) >= 200))) WHERE n > 1),
r AS (SELECT doc_id, s, CASE WHEN s - lag(s) OVER w <= 100 THEN 0 ELSE 1 END b FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY s)),
q AS (SELECT doc_id, s, sum(b) OVER (PARTITION BY doc_id ORDER BY s) k FROM r),
x AS (SELECT doc_id, min(s) a, max(s) + 100 z FROM q GROUP BY doc_id, k),
y AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 1) f FROM x),
k AS (SELECT doc_id, count(*) n_spans, sum(z - a) n_removed, max(z) z, string_agg(substring(h, 2 * f - 1, 2 * (a - f)), '' ORDER BY a) kept FROM y JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, '') || substring(h, 2 * coalesce(z, 1) - 1))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
}
