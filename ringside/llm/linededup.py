"""Line dedup by a log-template tree.

A line is a path of fixed depth: its number of tokens, then its LEAD first
tokens, where a token that holds a digit counts as the wildcard <*>. Lines with
one path share a leaf. Inside a leaf a token is constant where enough of the
leaf's lines have it at that place; other places become <*>. The result is a
template of the line. Enough is SHARE of the leaf's lines, then SHARE of that,
and so on down to ``min_docs``: a line has a template at each of these levels,
so that a template is found in a leaf of any size. Lines of a template that
recurs across documents are dropped.

A line of copied documents recurs as well; dropping it would empty every copy.
So a template counts as recurring only when ``min_docs`` different votes have
it, and copies share a vote. A document votes with the least hash of its own
lines, those whose leaves recur nowhere else. Where these are less than OWN of
its text, it counts as a near copy and votes with the least of its recurring
leaves, which copies have in common however they were edited. (Two copies with
a share s of own lines are alike by (1 - s) / (1 + s): 0.8 for a ninth, 0.6 for
OWN, so OWN leaves room below the bar of near duplicates, and short pages under
one boilerplate are documents of their own down to a quarter of own text.)
The leaves that fail this already are left out before any token is compared.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAD = 3
MIN_DOCS = 20
SHARE = 0.1
CONSTANT = 0.5
OWN = 0.25
BROADCAST_ROWS = 100_000
VARIABLE = r"\S*[0-9]\S*"


def _tokens(line: Column) -> Column:
    """A line's tokens, those with a digit masked."""
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, VARIABLE, "<*>")).otherwise(line)
    return F.filter(F.split(masked, r"[\s]+"), lambda t: t != "")


def _lines(documents: DataFrame) -> DataFrame:
    """doc_id, fp, doc (hash of both), line_no, line, leaf; no blank lines."""
    docs = documents.select("doc_id", F.xxhash64("text").alias("fp"), F.split("text", "\n", -1).alias("lines"))
    # The leaf needs the token count and the first tokens alone, not the whole list.
    head = lambda s: F.slice(F.split(s, r"\s+", LEAD + 1), 1, LEAD)
    masked = lambda t: F.when(t.rlike("[0-9]"), F.lit("<*>")).otherwise(t)
    leaf = lambda s: F.xxhash64(F.regexp_count(s, F.lit(r"\S+")), F.transform(head(F.ltrim(s)), masked))
    every = F.transform("lines", lambda s, i: F.struct(i.alias("line_no"), s.alias("line"), leaf(s).alias("leaf")))
    # The outer form: the plain one adds a filter that computes the leaves again.
    return docs.select("doc_id", "fp", F.xxhash64("doc_id", "fp").alias("doc"), F.explode_outer(every).alias("l")).select("doc_id", "fp", "doc", "l.*").filter(F.col("line").rlike(r"\S"))


def _recurring(df: DataFrame, key: str, value: str, least: int) -> DataFrame:
    """The keys with at least ``least`` different values. The count first drops
    repeats of (key, value), then adds up, so a hot key's rows are spread over
    the tasks."""
    pairs = df.select(key, value).groupBy(key, value).agg(F.lit(1).alias("one"))
    return pairs.groupBy(key).agg(F.sum("one").alias("n")).filter(F.col("n") >= least).select(key)


def _votes(brief: DataFrame, hot: DataFrame) -> DataFrame:
    """doc, vote of every document. ``brief``: doc, leaf, hash and length of
    each line; ``hot``: the leaves that recur."""
    flagged = brief.join(hot.withColumn("hot", F.lit(True)), "leaf", "left")
    own = F.col("hot").isNull()
    found = flagged.groupBy("doc").agg(
        F.min(F.when(own, F.col("hash"))).alias("own"),
        F.min(F.when(~own, F.col("leaf"))).alias("shared"),
        F.sum(F.when(own, (1 - OWN) * F.col("length")).otherwise(-OWN * F.col("length"))).alias("more"),
    )
    return found.filter("shared is not null").select("doc", F.when(F.col("more") < 0, F.col("shared")).otherwise(F.col("own")).alias("vote"))


def _small(df: DataFrame, broadcast_rows: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= broadcast_rows else df


def templates(documents: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, constant: float = CONSTANT, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The lines that fall to recurring templates: doc_id, fp, line_no,
    template; a line has a row for each level at which its template recurs."""
    from .common import save

    lines = _lines(documents)
    brief = save(lines.select("doc", "leaf", F.xxhash64("line").alias("hash"), F.char_length("line").cast("long").alias("length")), "brief")
    hot = save(_recurring(brief, "leaf", "doc", min_docs), "leaves")
    votes = save(_votes(brief, _small(hot, broadcast_rows)), "votes")
    voted = brief.select("leaf", "doc").join(_small(hot, broadcast_rows), "leaf", "left_semi").join(votes, "doc")
    hot = save(_recurring(voted, "leaf", "vote", min_docs), "leaves")
    kept = lines.join(_small(hot, broadcast_rows), "leaf", "left_semi").join(votes, "doc")
    kept = save(kept, "lines").withColumn("tokens", _tokens(F.col("line")))
    at = kept.select("doc_id", "fp", "doc", "line_no", "vote", "leaf", F.posexplode("tokens").alias("at", "token"))
    counts = at.groupBy("leaf", "at", "token").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs)
    counts = save(counts, "constants")
    sizes = save(kept.groupBy("leaf").agg(F.count("*").alias("total")), "sizes")
    rows = at.join(_small(counts, broadcast_rows), ["leaf", "at", "token"], "left")
    rows = rows.groupBy("doc_id", "fp", "doc", "line_no", "vote", "leaf").agg(F.array_sort(F.collect_set(F.struct("at", "token", F.coalesce("n", F.lit(0)).alias("n")))).alias("tokens"))
    rows = rows.join(_small(sizes, broadcast_rows), "leaf")
    last = F.ceil(F.log(F.col("total") / F.lit(min_docs)) / F.lit(math.log(1 / share)))
    level = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), last).cast("int"))).alias("level")
    rows = rows.select("*", level).withColumn("bar", F.greatest(F.lit(min_docs), F.ceil(F.col("total") * F.pow(F.lit(share), F.col("level")))))
    rows = rows.withColumn("shape", F.transform("tokens", lambda t: F.when(t["n"] >= F.col("bar"), t["token"]).otherwise("<*>")))
    fixed = F.size(F.filter("shape", lambda t: t != "<*>"))
    rows = rows.filter(fixed >= F.size("shape") * constant).withColumn("template", F.array_join("shape", " "))
    joined = save(rows.select("doc_id", "fp", "line_no", "vote", "template"), "templates")
    drop = save(_recurring(joined, "template", "vote", min_docs), "recurring")
    return joined.join(_small(drop, broadcast_rows), "template", "left_semi").select("doc_id", "fp", "line_no", "template")


def dedup_lines(documents: DataFrame, **options) -> DataFrame:
    """``documents`` with all its columns, the text without the lines of
    recurring templates, and n_lines, n_dropped added; an input's columns of
    these names are replaced.

    A null text stays null, with no lines; an empty one has one (blank) line.
    Blank lines stay. Rows with the same doc_id and text, or without doc_id and
    the same text, are one document and get the same result. Ties have no
    part: all lines of a recurring template go. No rows: none.
    A document whose lines all go keeps its row, with an empty text.
    """
    gone = templates(documents, **options).groupBy("doc_id", "fp").agg(F.collect_set("line_no").alias("_lines_gone")).select(F.col("doc_id").alias("_lines_id"), F.col("fp").alias("_lines_fp"), "_lines_gone")
    same = F.col("doc_id").eqNullSafe(F.col("_lines_id")) & (F.xxhash64("text") == F.col("_lines_fp"))
    cols = [c for c in documents.columns if c.lower() not in ("n_lines", "n_dropped")]
    joined = documents.select(*cols).join(gone, same, "left")
    rest = F.filter(F.split("text", "\n", -1), lambda s, i: ~F.array_contains("_lines_gone", i))
    text = F.when(F.col("_lines_gone").isNull(), F.col("text")).otherwise(F.array_join(rest, "\n"))
    n_lines = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0))
    out = joined.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long")).withColumn("n_dropped", F.coalesce(F.size("_lines_gone"), F.lit(0)).cast("long"))
    out = out.withColumn("n_dropped", F.when(F.col("_lines_gone").isNull(), 0).otherwise(F.col("n_dropped")).cast("long"))
    return out.withColumn("text", text).select(*cols, "n_lines", "n_dropped")
