"""Flat corpora: manifest, rosters, result histories, fetch log, HTML tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringside.functions.text import WEAPON_RULES, first_rule, palette_index, result_method, squeezed, stripped, stripped_html
from ringside.sources.pages import read_in_one_pass

# Known colours, and the palette of all others.
KNOWN_COLORS = {
    "Minotaur": "#D4AF37",
    "Bloodsport": "#1E6FD9",
    "HyperShock": "#2FBF71",
    "HUGE": "#8CC63E",
    "Witch Doctor": "#C0392B",
    "End Game": "#27AE60",
    "Malice": "#E67E22",
    "DeathRoll": "#16A085",
    "Golden Fury": "#F1C40F",
    "Orbitron": "#9B59B6",
    "Cobalt": "#2980B9",
    "The Twins": "#E74C3C",
}
PALETTE = ["#D4AF37", "#1E6FD9", "#2FBF71", "#C0392B", "#9B59B6", "#E67E22", "#16A085", "#F1C40F", "#2980B9", "#E74C3C"]
MANIFEST = "fight_id STRING, episode INT, bots ARRAY<STRING>, role STRING, synthetic BOOLEAN, yt_id STRING, fight_start_s STRING, fight_end_s STRING, winner STRING, method STRING, time_s STRING"


# How the pages are written. A card links to a robot's page, whose
# address ends in ROBOT_PAGE, with a name of NAME_CHARS characters; the weapon
# stands, in WEAPON_CHARS characters, behind its label in the next CARD_CHARS;
# some links are to the list itself. A tag and its text have ADDRESS_CHARS at most.
ROBOT_PAGE = re.compile(r"/robots?/[a-z0-9-]+/?(?:\r\n|[\n\r\x85\u2028\u2029])?\Z", re.IGNORECASE | re.ASCII)
NAME_CHARS, WEAPON_CHARS, CARD_CHARS, ADDRESS_CHARS = (2, 40), (3, 60), 1500, 4000
LIST_LINKS = ("", "robots", "the robots", "meet the robots")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The hand-edited YAML registry: a few dozen rows, read on the driver
    through Spark's text reader, so any path Spark knows will do."""
    import yaml

    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    fields = [f.split(" ")[0] for f in MANIFEST.split(", ")]
    rows = []
    for e in (yaml.safe_load(text) or {}).get("fights") or []:
        v = {k: e.get(k) for k in fields}
        as_text = {k: None if v[k] is None else str(v[k]) for k in ("fight_id", "yt_id", "fight_start_s", "fight_end_s", "time_s")}
        rows.append(tuple((v | as_text | {"bots": [str(b) for b in e["bots"]], "synthetic": bool(v["synthetic"])})[k] for k in fields))
    return spark.createDataFrame(rows, MANIFEST)


def colours(bots: Column) -> Column:
    """name -> colour for an ordered pair: the known colour, else a stable pick;
    the second takes the next free palette entry if its own is taken."""
    known = F.create_map(*[F.lit(x) for kv in KNOWN_COLORS.items() for x in kv])
    palette = F.array(*[F.lit(c) for c in PALETTE])
    first_bot, second_bot = F.get(bots, F.lit(0)), F.get(bots, F.lit(1))
    at = lambda b, k: F.get(palette, (palette_index(b) + k) % len(PALETTE))
    one = F.coalesce(known[first_bot], at(first_bot, 0))
    free = F.when(known[second_bot] != one, known[second_bot])
    two = F.coalesce(free, F.when(at(second_bot, 0) != one, at(second_bot, 0)), at(second_bot, 1))
    return F.map_from_arrays(F.array(first_bot, second_bot), F.array(one, two))


def to_meta(rows: DataFrame) -> DataFrame:
    """Manifest rows as meta documents: TODO and blanks are NULL, synthetic
    fights are left out."""
    num = lambda c: F.nullif(F.nullif(F.col(c), F.lit("TODO")), F.lit("")).try_cast("double")
    yt = F.nullif(F.nullif("yt_id", F.lit("TODO")), F.lit(""))
    return rows.filter(~F.coalesce("synthetic", F.lit(False))).select(
        "fight_id", "episode", "bots", colours(F.col("bots")).alias("colors"),
        F.struct("winner", "method", num("time_s").alias("time_s")).alias("result"),
        F.struct(yt.alias("yt_id"), num("fight_start_s").alias("fight_start_s"), num("fight_end_s").alias("fight_end_s")).alias("video"),
        F.coalesce("role", F.lit("proleague")).alias("role"),
    )


def roster_classes(spark: SparkSession, path: str) -> DataFrame:
    """(bot, class) of the roster CSV: names case-folded, blank classes other;
    the last of repeated names counts."""
    rows = spark.read.csv(path, header=True, schema="name STRING, weapon_class STRING, weapon_text STRING, record STRING")
    cls = F.coalesce(F.nullif(F.trim("weapon_class"), F.lit("")), F.lit("other"))
    named = rows.select(F.lower(F.trim("name")).alias("bot"), cls.alias("class"), F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row")).alias("_n")).filter("bot <> ''")
    return named.groupBy("bot").agg(F.max_by("class", "_n").alias("class"))


HISTORY = "bot STRING, season STRING, stage STRING, opponent STRING, won STRING, method STRING, result_text STRING"


def history(spark: SparkSession, folder: str) -> DataFrame:
    """All result rows of <folder>/*_history.csv."""
    return spark.read.csv(f"{folder}/*_history.csv", header=True, schema=HISTORY, multiLine=True, escape='"')


def roster(spark: SparkSession, path: str) -> DataFrame:
    """The collector's roster JSON, flat."""
    rows = spark.read.json(path, multiLine=True)
    stats = lambda c: F.col(f"career_stats.{c}")
    return rows.select(F.col("robot_name").alias("name"), "robot_type", "team_name", "builder_name", "hometown", stats("total_matches").alias("total_matches"), stats("total_wins").alias("total_wins"), stats("losses").alias("losses"), F.col("website_urls").alias("social_urls"))


def fetch_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("ts DOUBLE, url STRING, via STRING, status INT, cached BOOLEAN").json(path)


def table_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, table_no, row_no, cells): the cells' texts of all HTML tables."""
    every = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<table[^>]*>(.*?)</table>"), F.lit(1))
    tables = pages.select(key, F.posexplode(every).alias("table_no", "_t"))
    rows = tables.select(key, "table_no", F.posexplode(F.regexp_extract_all("_t", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row_no", "_r"))
    cells = F.transform(F.regexp_extract_all("_r", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), stripped_html)
    return rows.select(key, "table_no", "row_no", cells.alias("cells"))


def history_rows(rows: DataFrame, bot: Column) -> DataFrame:
    """Result rows from 3-column tables with some 'vs.' row: a row of three
    equal cells sets the season (the bot's own name doesn't), without its
    trailing record; prefixes and seeds go from opponents."""
    w = Window.partitionBy("page", "table_no")
    c = [stripped(F.get("cells", F.lit(k))) for k in range(3)]
    versus = F.lower(c[1]).startswith("vs.")
    df = rows.filter(F.size("cells") == 3).withColumn("_c1", c[1]).withColumn("_vs", versus).withColumn("_any", F.max(versus).over(w)).filter("_any")
    banner = (c[0] == c[1]) & (c[1] == c[2]) & (c[0] != "") & ~F.col("_vs")
    # A season may end in its record, wins and losses.
    heading = squeezed(c[0])
    record = F.substring_index(heading, " ", -1).rlike("^[0-9]+-[0-9]+$") & heading.contains(" ")
    name = F.when(record, F.array_join(F.slice(F.split(heading, " "), F.lit(1), F.size(F.split(heading, " ")) - 1), " ")).otherwise(c[0])
    season = F.when(banner & (F.upper(c[0]) != F.upper(bot)), name)
    ordered = w.orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("season", F.last(season, ignorenulls=True).over(ordered)).filter("_vs")
    # Behind "vs." stands the opponent, and perhaps its seed in brackets.
    named = stripped(F.expr("substring(_c1, 4)"))
    opponent = stripped(F.regexp_replace(named, "[(][0-9]+[)]$", ""))
    out = df.select("page", bot.alias("bot"), "season", F.nullif(c[0], F.lit("")).alias("stage"), opponent.alias("opponent"), F.lower(c[2]).startswith("w").alias("won"), result_method(c[2]).alias("method"), c[2].alias("result_text"))
    return out.filter("opponent <> ''")


_LINK, _TAG, _LABEL = re.compile('href="', re.IGNORECASE | re.ASCII), re.compile("<[^>]*>"), re.compile("weapon", re.IGNORECASE)
# What may stand between a label and its value: "type", a colon, tags.
_SKIPPED = re.compile(r"(?:\s+(?i:type))?\s*:?[\s\x01]*")


def robot_cards(html: str) -> list[dict]:
    """The cards (name, weapon_text) that link to a robot, in order. Only the
    places behind a link are looked at, so the time grows with the text alone."""
    out = []
    for m in _LINK.finditer(html):
        # The address, the rest of the tag, and the name, up to the next tag.
        most = m.end() + ADDRESS_CHARS
        quote = html.find('"', m.end(), most)
        close = html.find(">", quote + 1, most) if quote >= 0 else -1
        end = html.find("<", close + 1, most) if close >= 0 else -1
        if end >= 0 and NAME_CHARS[0] <= end - close - 1 <= NAME_CHARS[1] and ROBOT_PAGE.search(html[m.end() : quote]):
            out.append({"name": html[close + 1 : end], "weapon_text": weapon_after(html[end + 1 : end + 1 + CARD_CHARS])})
    return out


def weapon_after(html: str) -> str:
    """The text behind the first "weapon" label, or "weapon type", that has
    one: past a colon and any tags, up to the next tag. '' without one."""
    least, most = WEAPON_CHARS
    plain = _TAG.sub("\x01", html) if _LABEL.search(html) else ""
    for m in _LABEL.finditer(plain):
        value = re.split("[<\x01]", plain[_SKIPPED.match(plain, m.end()).end() :], maxsplit=1)[0][:most]
        if len(value) >= least:
            return value.strip()
    return ""


def roster_cards(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, name, weapon_text, weapon_class): cards that link to a robot, the
    first of each name; the weapon is looked for in the next CARD_CHARS
    characters. A page is read in one row and one pass."""
    both = read_in_one_pass(pages, key, F.make_valid_utf8(html), robot_cards, ["name", "weapon_text"])
    rows = both.select(key, "at", squeezed(F.col("name")).alias("name"), "weapon_text").filter(~F.lower("name").isin(*LIST_LINKS))
    first = F.row_number().over(Window.partitionBy(key, F.lower("name")).orderBy("at"))
    cls = first_rule(F.when(F.col("weapon_text") != "", F.col("weapon_text")).otherwise(F.col("name")), WEAPON_RULES)
    return rows.withColumn("_rn", first).filter("_rn = 1").select(key, "name", "weapon_text", cls.alias("weapon_class"))


def cached(urls: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests (url) beside what a content-addressed cache (key, body) has."""
    return urls.withColumn("key", F.sha2(F.col("url").cast("binary"), 256)).join(cache, "key", "left").withColumn("cached", F.col("body").isNotNull())


def export_csv(df: DataFrame, path: str) -> None:
    """A small report as CSV; arrays become ' vs ' lists."""
    flat = [F.array_join(c, " vs ").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).coalesce(1).write.mode("overwrite").csv(path, header=True)
