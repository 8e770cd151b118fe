"""Join shapes: bands, nearest, as-of, upsert and exclusion."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringside.functions.text import whole_name

from .folds import fold


def band_join(left: DataFrame, right: DataFrame, keys: list[str], lt: str, rt: str, before: float, after: float) -> DataFrame:
    """Pairs with equal keys and rt in [lt - before, lt + after]. Both sides are
    cut into buckets as wide as the band; a left row goes to the two or three
    buckets it touches, so the join is an equi-join on (keys, bucket)."""
    width = max(before + after, 1e-9)
    lo, hi = F.floor((F.col(lt) - before) / width), F.floor((F.col(lt) + after) / width)
    a = left.withColumn("_b", F.explode(F.sequence(lo, hi)))
    b = right.withColumn("_b", F.floor(F.col(rt) / width))
    return a.join(b, [*keys, "_b"]).filter((F.col(rt) >= F.col(lt) - before) & (F.col(rt) <= F.col(lt) + after)).drop("_b")


def interval_sums(events: DataFrame, keys: list[str], t: str, v: str, span: int) -> DataFrame:
    """(keys, sec, value): for each whole second s, the sum of v of the events
    with s in [t, t + span). An event is spread over its seconds and summed."""
    first = F.ceil(F.col(t)).cast("long")
    last = F.ceil(F.col(t) + span).cast("long") - 1
    return events.withColumn("sec", F.explode(F.sequence(first, last))).groupBy(*keys, "sec").agg(F.sum(v).alias("value"))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], lt: str, rt: str, value: str) -> DataFrame:
    """Left rows with the right row of equal keys that is nearest in t (the
    earlier on ties; of right rows at one time that of the greatest value).

    Two as-of passes in opposed orders over both sides, dealt by key once: each
    carries the last right row it has seen, so a row costs the same in a key of
    any length, and no pairs are made."""
    a = left.withColumn("_at", F.col(lt)).withColumn("_side", F.lit(1))
    b = right.groupBy(*keys, F.col(rt).alias("_at")).agg(F.max(value).alias("_v")).select(*keys, "_at", F.struct(F.col("_at").alias("t"), F.col("_v").alias("v")).alias("_r"), F.lit(0).alias("_side"))
    both = a.unionByName(b, allowMissingColumns=True)
    seen = lambda *order: F.last("_r", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("_p", seen("_at", "_side")).withColumn("_n", seen(F.desc("_at"), "_side")).filter("_side = 1")
    take = F.when(F.col("_n").isNull() | (F.col(lt) - F.col("_p.t") <= F.col("_n.t") - F.col(lt)), F.col("_p")).otherwise(F.col("_n"))
    return found.withColumn("_t", take).select(*left.columns, F.col("_t.t").alias("near_t"), F.col("_t.v").alias("near_value"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], lt: str, rt: str, value: str) -> DataFrame:
    """Left rows with the value of the last right row at or before their t."""
    a = left.withColumn("_at", F.col(lt)).withColumn("_side", F.lit(1))
    b = right.select(*keys, F.col(rt).alias("_at"), F.struct(F.col(rt).alias("t"), F.col(value).alias("v")).alias("_r"), F.lit(0).alias("_side"))
    w = Window.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = a.unionByName(b, allowMissingColumns=True).withColumn("_r", F.last("_r", ignorenulls=True).over(w)).filter("_side = 1")
    return found.select(*left.columns, F.col("_r.t").alias("prior_t"), F.col("_r.v").alias("prior_value"))


def latest(df: DataFrame, key: Column, *order: Column) -> DataFrame:
    """One row a key: the first in the given order (newest first for an upsert)."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_rn = 1").drop("_rn")


def upserted(old: DataFrame, new: DataFrame, name: str) -> DataFrame:
    """Old and new rows by case-folded name, the newest run's row winning;
    nameless rows go. Ordered by name."""
    both = old.withColumn("_run", F.lit(0)).unionByName(new.withColumn("_run", F.lit(1)), allowMissingColumns=True)
    named = both.filter(F.trim(F.col(name)) != "")
    return latest(named, F.lower(F.trim(F.col(name))), F.desc("_run")).drop("_run").orderBy(name)


def unordered(a: Column, b: Column) -> Column:
    """The same array for (a, b) and (b, a), case-folded."""
    return F.array_sort(F.array(F.lower(F.trim(a)), F.lower(F.trim(b))))


def without_pairs(df: DataFrame, pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Rows whose unordered pair isn't in ``pairs`` (the same two columns)."""
    known = pairs.select(unordered(F.col(a), F.col(b)).alias("_pair")).distinct()
    return df.withColumn("_pair", unordered(F.col(a), F.col(b))).join(known, "_pair", "left_anti").drop("_pair")


#: Names that may be broadcast, after a count.
BROADCAST_NAMES = 200_000


def named_in(texts: DataFrame, text: str, names: DataFrame) -> DataFrame:
    """Rows of ``texts`` with each ``name`` of ``names`` that stands in their
    text as whole_name has it. A text is cut into its runs of letters, which
    meet the names' first runs in an equi-join; only these pairs are matched.
    Names without a letter are tried on every text."""
    low = F.lower(F.col(text))
    runs = F.array_distinct(F.concat(F.split(low, "[^a-z]+"), F.array(F.lit(""))))
    known = names.select("name").distinct().withColumn("_run", F.regexp_extract(F.lower("name"), "[a-z]+", 0))
    known = F.broadcast(known) if known.count() <= BROADCAST_NAMES else known
    return texts.withColumn("_run", F.explode(runs)).join(known, "_run").filter(whole_name(F.col(text), F.col("name"))).drop("_run")


def enriched(df: DataFrame, name: str, roster: DataFrame, *columns: str) -> DataFrame:
    """``df`` with the roster's columns by case-folded name (the roster's last
    name in order wins); rows that it lacks keep NULLs."""
    key = F.lower(F.trim(F.col(name)))
    known = latest(roster.filter(F.trim("name") != ""), F.lower(F.trim("name")), F.desc("name"))
    known = known.select(F.lower(F.trim("name")).alias("_key"), *columns)
    return df.withColumn("_key", key).join(known, "_key", "left").drop("_key")


def matched_truth(truth: DataFrame, found: DataFrame, keys: list[str], tolerance: float = 1.0) -> DataFrame:
    """(keys, truth_t, found_t): truths in order each take the first unused
    finding within ``tolerance``; a findings' order is time. NULL times match
    nothing.

    One merge pass a key over both sides in order of time: a finding goes to
    the first truth that waits for one, else it waits itself; what is more than
    ``tolerance`` old is forgotten, so the state is what stands within it."""
    side = lambda df, n: df.select(*keys, F.col("t").cast("double").alias("t"), F.lit(n).alias("side")).filter("t is not null")
    both = side(truth, 0).unionByName(side(found, 1))
    kinds = dict(both.dtypes)

    def step(waiting: tuple[deque, deque], pdf: pd.DataFrame) -> pd.DataFrame:
        rows, pairs = [], []
        for i, (t, own) in enumerate(zip(pdf["t"].tolist(), pdf["side"].tolist(), strict=True)):
            other = waiting[1 - own]
            for queue in waiting:
                while queue and t - queue[0] > tolerance:
                    queue.popleft()
            if other:
                rows.append(i)
                pairs.append((other.popleft(), t)[:: 1 if own else -1])
            else:
                waiting[own].append(t)
        out = pdf.iloc[rows][keys].reset_index(drop=True)
        return out.assign(truth_t=[p[0] for p in pairs], found_t=[p[1] for p in pairs])

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "truth_t double", "found_t double"])
    return fold(both, keys, ["t", "side"], lambda: (deque(), deque()), step, schema)
