"""Pre-contest prediction: a history prior and a walk-forward Elo fold."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import fold

# Fixed values of the model.
RATING, SCALE, K_NEW, K_OLD, NEW_GAMES, SHIFT, HALF_LIFE, PRIOR_WINS, BLEND = 1500.0, 400.0, 40.0, 24.0, 10, 200.0, 5.0, 2.0, 8.0


def history(rows: DataFrame) -> DataFrame:
    """(bot, wins, fights) from result rows (bot, opponent, won, method): rows
    without a method are unplayed and don't count."""
    played = rows.filter((F.trim("bot") != "") & (F.trim(F.coalesce("method", F.lit(""))) != ""))
    won = F.lower(F.trim(F.col("won").cast("string"))).isin("true", "1", "yes")
    return played.groupBy(F.lower(F.trim("bot")).alias("bot")).agg(F.count_if(won).alias("wins"), F.count("*").alias("fights"))


def prior(wins: Column, fights: Column) -> Column:
    """A first rating: the win rate's shift, shrunk by how few fights there are."""
    return RATING + 2 * SHIFT * (wins / fights - 0.5) * (fights / (fights + HALF_LIFE))


class League:
    """The state of one league: ratings, games, and wins by pair of classes."""

    def __init__(self) -> None:
        self.rating: dict[str, float] = {}
        self.games: dict[str, int] = {}
        self.met: dict[tuple[str, str], tuple[float, float]] = {}

    def forecast(self, a: str, b: str, classes: tuple[str, str], priors: tuple[float, float]) -> tuple[float, float]:
        """The rating's expectation and the blended P(a wins)."""
        ra, rb = self.rating.get(a, priors[0]), self.rating.get(b, priors[1])
        e = 1 / (1 + 10 ** (-(ra - rb) / SCALE))
        wins, n = self.met.get(classes, (0.0, 0.0))
        weight = n / (n + BLEND)
        p = (1 - weight) * e + weight * (wins + PRIOR_WINS) / (n + 2 * PRIOR_WINS)
        return e, min(max(p, 1e-6), 1 - 1e-6)

    def learn(self, a: str, b: str, classes: tuple[str, str], priors: tuple[float, float], e: float, y: float) -> None:
        for bot, prior, gain in ((a, priors[0], y - e), (b, priors[1], e - y)):
            k = K_NEW if self.games.get(bot, 0) < NEW_GAMES else K_OLD
            self.rating[bot] = self.rating.get(bot, prior) + k * gain
            self.games[bot] = self.games.get(bot, 0) + 1
        # Both directions; a pair of one class counts twice under its one key.
        for pair, won in ((classes, y), (classes[::-1], 1 - y)):
            wins, n = self.met.get(pair, (0.0, 0.0))
            self.met[pair] = wins + won, n + 1


def walk_forward(fights: DataFrame, priors: DataFrame, classes: DataFrame) -> DataFrame:
    """Each fight's P(bot_a wins) before its own result: a fold over the fights
    (fight_id, episode, bot_a, bot_b, winner) in order, NULL episodes last.

    A league is one chain, walked in one pass; ``league``, where there is such
    a column, separates chains, which run in parallel; so do priors' and
    classes' bots, which are looked up by name: (bot, rating) and (bot, class).
    """
    df = fights if "league" in fights.columns else fights.withColumn("league", F.lit(""))
    low = lambda c: F.lower(F.col(c))
    known = lambda side: df.select(F.lower(side).alias("bot"))
    bots = known("bot_a").unionByName(known("bot_b")).distinct()
    named = bots.join(priors, "bot", "left").join(classes, "bot", "left").select("bot", F.coalesce("rating", F.lit(RATING)).alias("rating"), F.coalesce("class", F.lit("other")).alias("class"))
    a, b = (named.select(F.col("bot").alias(f"k{s}"), F.col("rating").alias(f"r{s}"), F.col("class").alias(f"c{s}")) for s in "ab")
    episode = F.coalesce(F.col("episode").cast("double"), F.lit(float("inf"))).alias("episode")
    rows = df.join(a, low("bot_a") == F.col("ka")).join(b, low("bot_b") == F.col("kb"))
    rows = rows.select("league", episode, "fight_id", "ka", "kb", "ra", "rb", "ca", "cb", (F.col("winner") == F.col("bot_a")).cast("double").alias("y"))

    def step(league: League, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for a, b, ra, rb, ca, cb, y in zip(*(pdf[c].tolist() for c in ("ka", "kb", "ra", "rb", "ca", "cb", "y")), strict=True):
            e, p = league.forecast(a, b, (ca, cb), (ra, rb))
            out.append(p)
            league.learn(a, b, (ca, cb), (ra, rb), e, y)
        return pd.DataFrame({"league": pdf["league"], "fight_id": pdf["fight_id"].astype(str), "p": out, "y": pdf["y"]})

    order = ["episode", "fight_id", "ka", "kb", "y"]
    return fold(rows, ["league"], order, League, step, "league string, fight_id string, p double, y double")


def pick(p: Column, a: Column, b: Column) -> Column:
    return F.when(p >= 0.5, a).when(p < 0.5, b)


def compared(rows: DataFrame) -> DataFrame:
    """Picks of two models (generic_p, main_p) beside the winner; NULL without one."""
    g, m = (pick(F.col(f"{x}_p"), F.col("bot_a"), F.col("bot_b")) for x in ("generic", "main"))
    return rows.select("*", g.alias("generic_pick"), m.alias("main_pick"), (g == F.col("winner")).alias("generic_correct"), (m == F.col("winner")).alias("main_correct"))


def paired(rows: DataFrame, left: str, right: str, outcome: str) -> DataFrame:
    """Only the fights for which both models and the outcome are known."""
    return rows.filter(F.col(left).isNotNull() & F.col(right).isNotNull() & F.col(outcome).isNotNull())


def entrants(manifest: DataFrame) -> DataFrame:
    """The distinct names of all fights' bots, in order."""
    return manifest.select(F.explode("bots").alias("bot")).distinct().orderBy("bot")
