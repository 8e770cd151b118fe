"""Secret scan: fixed patterns, and character Markov models for what they miss.

Two first-order Markov models over the characters of a token, one of random
strings and one of ordinary identifiers, are counted from labelled samples; a
long token is a secret when the log-likelihood ratio of the two favours the
random model clearly. Random samples are the values that the fixed patterns
find and, so that alphabets beyond theirs are known too, a hexadecimal and a
base64 digest of every document; ordinary ones are the distinct words of all
texts but those values. Letters count in lower case, and separators part a token, so
that capitals, snake_case and paths read like the words that they are made of.

All of it is expressions over each row's text. One pass finds the base spans and
the long tokens of every text, which are written; one more gathers the words. Only
the model's counts, at most two a pair of characters, reach the driver.
"""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save

# Fixed values of the scan's contract: kind, pattern, group that is measured, least length.
BASE = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # runs under 24 fail, and a run of 24 or more starts where the longest one does
]
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
WORD = r"[A-Za-z0-9+/_=-]{4,}"
PAIRS = r"(?=([a-z0-9]{2}))"
SPANS = "array<struct<start:int,kind_no:int,end:int,kind:string,value:string>>"
THRESHOLD, LEAST_PAIRS = 1.2, 8
BLOCK = 128


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _spans(text: Column, kind_no: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """The matches of a pattern with their places, in code points. The texts
    between the matches (split) and the matches, laid end to end, give them:
    blocks of matches are summed, then each block is walked from its start, so
    that no long array is copied once a match."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kept = hits if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    laid = lambda m, g: F.struct(F.char_length(g).alias("gap"), F.char_length(m["hit"]).alias("long"), m["kept"].alias("kept"))
    rows = F.zip_with(F.zip_with(hits, kept, lambda h, k: F.struct(h.alias("hit"), k.alias("kept"))), F.slice(gaps, 1, F.size(hits)), laid)
    begin = lambda at: F.struct(at.alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc, r):
        start = acc["at"] + r["gap"]
        end = start + r["long"]
        one = F.struct(start.alias("start"), F.lit(kind_no).alias("kind_no"), end.alias("end"), F.lit(kind).alias("kind"), r["kept"].alias("value"))
        grown = F.when(F.char_length(r["kept"]) >= least, F.concat(acc["out"], F.array(one))).otherwise(acc["out"])
        return F.struct(end.alias("at"), grown.cast(SPANS).alias("out"))

    def walked(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, r: n + r["gap"] + r["long"]))
        grow = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        starts = F.aggregate(sums, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), grow, lambda acc: acc["out"])
        return F.flatten(F.zip_with(blocks, starts, lambda b, at: F.aggregate(b, begin(at), step, lambda acc: acc["out"])))

    blocks = _let(rows, lambda r: F.transform(F.sequence(F.lit(0), F.floor((F.size(r) - 1) / BLOCK).cast("int")), lambda k: F.slice(r, k * BLOCK + 1, BLOCK)))
    return F.when(text.rlike(pattern), _let(blocks, walked)).otherwise(F.array().cast(SPANS))


def base_spans(text: Column) -> Column:
    """All spans of the fixed patterns, by start and then in the order of BASE."""
    return F.sort_array(reduce(F.concat, [_spans(text, i, *spec) for i, spec in enumerate(BASE)]))


def scanned(documents: DataFrame) -> DataFrame:
    """doc_id, the base spans of each row's text (null: empty), and ``long``, its
    tokens of 16 or more characters that touch no base span."""
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("base", base_spans(F.col("text")))
    tokens = _spans(F.col("text"), len(BASE), "markov", TOKEN, 0, 16)
    clear = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return docs.select("doc_id", "base", F.filter(tokens, clear).alias("long"))


def _counts(strings: DataFrame, label: str) -> DataFrame:
    """pair, n and label of a table of strings (value)."""
    pairs = strings.select(F.explode_outer(F.regexp_extract_all(F.lower("value"), F.lit(PAIRS), F.lit(1))).alias("pair"))
    return pairs.filter("pair is not null").groupBy("pair").agg(F.count("*").alias("n")).withColumn("label", F.lit(label))


def samples(documents: DataFrame, found: DataFrame) -> DataFrame:
    """Counts of character pairs under the labels ``secret`` and ``ordinary``,
    from the documents and what ``scanned`` found in them."""
    digest = F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.xxhash64("text").cast("string")), 256)
    drawn = documents.select(digest.alias("h")).select(F.explode(F.array("h", F.base64(F.unhex("h")))).alias("value"))
    values = found.filter(F.size("base") > 0).select(F.explode("base.value").alias("value"))
    parts = lambda c: F.explode_outer(F.regexp_extract_all(c, F.lit(WORD), F.lit(0))).alias("value")
    words = documents.select(parts("text")).filter("value is not null").distinct()
    ordinary = words.join(values.select(parts("value")).filter("value is not null").distinct(), "value", "left_anti")
    return _counts(ordinary, "ordinary").unionByName(_counts(values.unionByName(drawn), "secret"))


def train(counts: DataFrame, smooth: float = 20.0) -> list[float]:
    """log P(b|a, secret) - log P(b|a, ordinary), a flat table over the
    alphabet. At most two counts a character pair reach the driver. Each row
    leans on its label's character frequencies with the weight of ``smooth``
    counts; without samples both models are uniform."""
    size = len(ALPHABET)
    n = {label: [[0] * size for _ in range(size)] for label in ("secret", "ordinary")}
    for r in counts.groupBy("label", "pair").agg(F.sum("n").alias("n")).collect():
        a, b = ALPHABET.find(r["pair"][0]), ALPHABET.find(r["pair"][1])
        if a >= 0 and b >= 0:
            n[r["label"]][a][b] += r["n"]

    def logs(rows: list[list[int]]) -> list[list[float]]:
        total = sum(map(sum, rows))
        alone = [(sum(row[b] for row in rows) + 1) / (total + size) for b in range(size)]
        return [[math.log((row[b] + smooth * alone[b]) / (sum(row) + smooth)) for b in range(size)] for row in rows]

    secret, ordinary = logs(n["secret"]), logs(n["ordinary"])
    return [secret[a][b] - ordinary[a][b] for a in range(size) for b in range(size)]


def ratio(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio over a token's character pairs, LEAST_PAIRS at least."""
    size = len(ALPHABET)
    weights = F.from_json(F.lit(json.dumps([round(x, 6) for x in model])), "array<double>")
    pairs = F.regexp_extract_all(F.lower(token), F.lit(PAIRS), F.lit(1))
    step = lambda acc, p: acc + F.get(weights, (F.position(F.substring(p, 1, 1), F.lit(ALPHABET)) - 1) * size + F.position(F.substring(p, 2, 1), F.lit(ALPHABET)) - 1)
    return F.aggregate(pairs, F.lit(0.0), step) / F.greatest(F.size(pairs), F.lit(LEAST_PAIRS))


def secrets(documents: DataFrame, model: list[float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``documents``: doc_id, base and spans (arrays of
    start, kind_no, end, kind, value; spans has those of the model too).

    A null text is empty and has no spans; equal rows get equal results, rows
    without doc_id as others do. Spans that start together are in the order of
    their kinds. A long text takes time in proportion to its matches. Other
    columns are ignored; no rows, none. A token of 16 or more characters is
    added as ``markov`` when its mean ratio is over ``threshold`` nats a pair
    and it touches no base span.
    """
    found = save(scanned(documents), "scanned")
    model = model if model is not None else train(samples(documents, found))
    added = F.filter("long", lambda s: ratio(s["value"], model) > threshold)
    return found.select("doc_id", "base", F.sort_array(F.concat("base", added)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
