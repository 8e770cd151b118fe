"""A content-addressed cache of model responses, and what it saves.

Requests have task, model and payload. A cache is a table (key, entry): the
content key of the three and a JSON document with the response as ``result``.
An entry that is no such document is worth nothing: its request is made again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringside.functions.text import content_key


def request_key() -> Column:
    return content_key(F.col("task"), F.col("model"), F.coalesce("payload", F.lit("")))


def usable(cache: DataFrame) -> DataFrame:
    """(key, result) of the cache's sound entries, one a key; results are JSON texts."""
    return cache.select("key", F.get_json_object("entry", "$.result").alias("result")).filter("key is not null and result is not null").groupBy("key").agg(F.max("result").alias("result"))


def answered(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests with their key and, where the cache has one, the result."""
    return requests.withColumn("key", request_key()).join(usable(cache), "key", "left")


def calls(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """(key, task, model, payload) of the calls that are to be made: one for
    all requests of a key that the cache lacks."""
    missing = answered(requests, cache).filter("result is null")
    return missing.groupBy("key").agg(*[F.min(c).alias(c) for c in ("task", "model", "payload")])


def stored(cache: DataFrame, responses: DataFrame) -> DataFrame:
    """The sound entries of a cache and those of new responses (task, model,
    payload, result as a JSON text), which win over old ones of their key."""
    # The result is JSON already; the head's closing brace gives way to it.
    head = F.to_json(F.struct("task", "model"))
    entry = F.concat(F.left(head, F.char_length(head) - 1), F.lit(',"result":'), F.col("result"), F.lit("}"))
    new = responses.select(request_key().alias("key"), entry.alias("entry")).groupBy("key").agg(F.max("entry").alias("entry"))
    old = cache.filter(F.get_json_object("entry", "$.result").isNotNull()).groupBy("key").agg(F.max("entry").alias("entry"))
    return old.join(new.select("key"), "key", "left_anti").unionByName(new)


def usage(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """(task, requests, hits, calls): how often each task asked, was answered
    by the cache, or by an earlier call of the same key, and called."""
    asked = answered(requests, cache).groupBy("task", "key").agg(F.count("*").alias("n"), F.max(F.col("result").isNull()).cast("long").alias("call"))
    return asked.groupBy("task").agg(F.sum("n").alias("requests"), F.sum(F.col("n") - F.col("call")).alias("hits"), F.sum("call").alias("calls"))
