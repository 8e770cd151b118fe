"""Streaming forms of the causal operators: the same results, row by row.

Stateful forms keep a small state a key. They follow the event time of their
rows: a row more than ``late`` behind the latest one seen is dropped, in
whatever batch it comes, and an event-time timer ends the state of a key once
it can't change a result any more. Between those bounds rows count in order of
time inside a micro-batch, and in the order of the batches.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ringside.operators.prebout import RATING, League
from ringside.shipping import ship

LATE, SHIFT = "10 seconds", 1.0


def _timed(rows: DataFrame, t: str, late: str) -> DataFrame:
    """Rows with their seconds as event time, SHIFT later: Spark's first
    watermark is the epoch, and second 0 must not be behind it."""
    return rows.withColumn("_at", F.timestamp_micros(((F.col(t) + SHIFT) * 1_000_000).cast("long"))).withWatermark("_at", late)


def _on_time(batches, t: str, state: GroupState) -> pd.DataFrame:
    """The rows ahead of the watermark, in order of time."""
    rows = pd.concat(list(batches)).sort_values(t)
    return rows[(rows[t] + SHIFT) * 1000 > state.getCurrentWatermarkMs()]


def _ends(state: GroupState, at: float) -> None:
    """Ends a state once the watermark is past ``at`` seconds."""
    state.setTimeoutTimestamp(max(int((at + SHIFT) * 1000) + 1, state.getCurrentWatermarkMs() + 1))


def resampled(stream: DataFrame, keys: list[str], ts: str, v: str, every: str = "1 second", late: str = LATE) -> DataFrame:
    """Mean in tumbling windows; rows later than the watermark are dropped."""
    w = F.window(ts, every)
    out = stream.withWatermark(ts, late).groupBy(*keys, w.alias("w")).agg(F.avg(v).alias("value"), F.count(v).alias("n"))
    return out.filter("n > 0").select(*keys, F.col("w.start").alias("start"), "value")


def sessions(stream: DataFrame, keys: list[str], ts: str, gap: str, late: str = LATE) -> DataFrame:
    """Bursts as session windows. A row exactly ``gap`` later joins the session,
    where the batch operator begins a new burst."""
    w = F.session_window(ts, gap)
    return stream.withWatermark(ts, late).groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def interval_sums(stream: DataFrame, keys: list[str], ts: str, v: str, span: str, slide: str, late: str = LATE) -> DataFrame:
    """Sums over sliding windows of ``span``."""
    w = F.window(ts, span, slide)
    return stream.withWatermark(ts, late).groupBy(*keys, w.alias("w")).agg(F.sum(v).alias("value")).select(*keys, F.col("w.end").alias("end"), "value")


def debounced(stream: DataFrame, key: str, t: str, gap: float, late: str = LATE) -> DataFrame:
    """The greedy debounce: state is each key's last accepted time, and ends
    ``gap`` after it, when the next row is accepted anyway. A row before the
    last accepted one is not accepted."""
    kinds = dict(stream.dtypes)

    def run(k, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = _on_time(batches, t, state)
        keep = []
        for at in rows[t]:
            ok = last is None or at - last >= gap
            keep.append(ok)
            last = float(at) if ok else last
        if last is not None:
            state.update((last,))
            _ends(state, last + gap)
        yield rows.loc[keep, [key, t]]

    rows = _timed(stream.select(key, F.col(t).cast("double").alias(t)), t, late)
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {t} double", "last double", "append", GroupStateTimeout.EventTimeTimeout)


def rolling_mean(stream: DataFrame, key: str, t: str, v: str, rows: int = 100, idle: float | None = None, late: str = LATE) -> DataFrame:
    """The trailing mean of ``rows`` rows: state is the last rows' values. With
    ``idle``, a key that is silent for more seconds begins a new window, and its
    state ends then; without, a window reaches back over any silence, as the
    batch form's does, and its state stays."""
    kinds = dict(stream.dtypes)
    pause = float("inf") if idle is None else idle

    def run(k, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        past, last = (list(state.get[0]), state.get[1]) if state.exists else ([], None)
        now = _on_time(batches, t, state)
        if not len(now):
            return
        gaps = now[t].diff()
        gaps.iloc[0] = 0.0 if last is None else now[t].iloc[0] - last
        means = []
        for _, part in now[v].groupby((gaps > pause).cumsum().to_numpy()):
            if gaps.loc[part.index].iloc[0] > pause:
                past = []
            values = pd.Series([*past, *part], dtype=float)
            means.extend(values.rolling(rows, min_periods=1).mean().iloc[len(past) :])
            past = [None if pd.isna(x) else float(x) for x in values.iloc[len(values) - min(len(values), rows - 1) :]]
        last = float(now[t].max()) if last is None else max(last, float(now[t].max()))
        state.update((past, last))
        if idle is not None:
            _ends(state, last + idle)
        yield pd.DataFrame({key: now[key].to_numpy(), t: now[t].to_numpy(), "roll": means})

    rows_ = _timed(stream.select(key, F.col(t).cast("double").alias(t), F.col(v).cast("double").alias(v)), t, late)
    return rows_.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {t} double, roll double", "past array<double>, last double", "append", GroupStateTimeout.EventTimeTimeout)


def filled(stream: DataFrame, key: str, sec: str, v: str, fill: float, idle: float | None = None, late: str = LATE) -> DataFrame:
    """The dense forward fill: from second 0 on, each second up to the last one
    seen, with the value last known. A second that was filled already is left
    out. With ``idle``, a key that is silent for more seconds is not filled over
    the silence: it begins anew, with ``fill``, at its next row, and its state
    ends then; without, it is, as in the batch form, and its state stays."""
    kinds = dict(stream.dtypes)
    pause = float("inf") if idle is None else idle

    def run(k, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        at, value, known = (*state.get, True) if state.exists else (-1, fill, False)
        rows = _on_time(batches, sec, state)
        secs, values = [], []
        for s, x in zip(rows[sec].tolist(), rows[v].tolist(), strict=True):
            if s <= at:
                continue
            if s - at > pause and (known or s > pause):
                at, value = s - 1, fill
            secs += range(at + 1, s + 1)
            values += [value] * (s - at - 1)
            value = value if pd.isna(x) else float(x)
            values.append(value)
            at, known = s, True
        if known:
            state.update((int(at), float(value)))
        if known and idle is not None:
            _ends(state, at + idle)
        yield pd.DataFrame({key: [k[0]] * len(secs), sec: secs, v: values})

    rows = _timed(stream.select(key, F.col(sec).cast("long").alias(sec), F.col(v).cast("double").alias(v)), sec, late)
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {sec} long, {v} double", "at long, value double", "append", GroupStateTimeout.EventTimeTimeout)


class _Ratings(StatefulProcessor):
    """A league's ratings, an entry of state for each bot and each pair of classes."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bots = handle.getMapState("bots", "bot string", "rating double, games int", self.ttl_ms)
        self.pairs = handle.getMapState("pairs", "a string, b string", "wins double, n double", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        fights = pd.concat(list(rows)).sort_values(["episode", "fight_id", "ka", "kb"])
        league = League()
        bots = {*fights["ka"], *fights["kb"]}
        classes = {*fights["ca"], *fights["cb"]}
        for bot in bots:
            if self.bots.containsKey((bot,)):
                league.rating[bot], league.games[bot] = self.bots.getValue((bot,))
        for pair in ((a, b) for a in classes for b in classes):
            if self.pairs.containsKey(pair):
                league.met[pair] = self.pairs.getValue(pair)
        out = []
        for r in fights.itertuples(index=False):
            e, p = league.forecast(r.ka, r.kb, (r.ca, r.cb), (r.ra, r.rb))
            league.learn(r.ka, r.kb, (r.ca, r.cb), (r.ra, r.rb), e, r.y)
            out.append((key[0], str(r.fight_id), p, r.y))
        for bot in bots:
            self.bots.updateValue((bot,), (float(league.rating[bot]), int(league.games[bot])))
        for pair, (wins, n) in league.met.items():
            self.pairs.updateValue(pair, (float(wins), float(n)))
        yield pd.DataFrame(out, columns=["league", "fight_id", "p", "y"])

    def close(self) -> None:
        pass


def walk_forward(stream: DataFrame, priors: DataFrame, classes: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Each fight's P(bot_a wins) before its result, from fights (league,
    fight_id, bot_a, bot_b, winner, and perhaps episode) that arrive in order;
    the model of the batch form, with the same tables of priors (bot, rating)
    and classes (bot, class).

    A league's state is an entry for each bot and each pair of classes, of which
    a batch reads and writes those of its fights; with ``ttl_ms``, entries not
    written for so long end. A late fight is rated when it arrives. The session
    is set to keep state in RocksDB, as such state needs."""
    ship(stream.sparkSession)
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    named = classes.join(priors, "bot", "full").select(F.lower("bot").alias("bot"), "rating", "class")
    rows = stream.withColumn("episode", F.coalesce(F.col("episode").cast("double"), F.lit(float("inf"))) if "episode" in stream.columns else F.lit(0.0))
    for s in "ab":
        own = named.select(F.col("bot").alias(f"_k{s}"), F.col("rating").alias(f"_r{s}"), F.col("class").alias(f"_c{s}"))
        rows = rows.withColumn(f"k{s}", F.lower(f"bot_{s}")).join(own, F.col(f"k{s}") == F.col(f"_k{s}"), "left")
        rows = rows.withColumn(f"r{s}", F.coalesce(f"_r{s}", F.lit(RATING))).withColumn(f"c{s}", F.coalesce(f"_c{s}", F.lit("other")))
    rows = rows.filter("ka is not null and kb is not null").select("league", "episode", "fight_id", "ka", "kb", "ra", "rb", "ca", "cb", (F.col("winner") == F.col("bot_a")).cast("double").alias("y"))
    return rows.groupBy("league").transformWithStateInPandas(_Ratings(ttl_ms), "league string, fight_id string, p double, y double", "append", "processingTime" if ttl_ms else "none")


def drained(result: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all there is, into a memory table (tests, replays of
    small streams)."""
    q = result.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return result.sparkSession.table(name)
