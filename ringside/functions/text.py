"""Text column functions: classifiers, parsers and extractors."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Keyword -> class, in order; the first match wins.
WEAPON_RULES = [
    ("vertical spinner", "vertical_spinner"),
    ("vert spinner", "vertical_spinner"),
    ("vertical disc", "vertical_spinner"),
    ("horizontal spinner", "horizontal_spinner"),
    ("horizontal bar", "horizontal_spinner"),
    ("undercutter", "horizontal_spinner"),
    ("shell spinner", "horizontal_spinner"),
    ("ring spinner", "horizontal_spinner"),
    ("drum", "drum"),
    ("eggbeater", "drum"),
    ("beater", "drum"),
    ("flipper", "flipper"),
    ("launcher", "flipper"),
    ("hammer saw", "hammer"),
    ("hammersaw", "hammer"),
    ("hammer", "hammer"),
    ("axe", "hammer"),
    ("crusher", "crusher"),
    ("grabber", "crusher"),
    ("gripper", "crusher"),
    ("clamp", "crusher"),
    ("lifter", "control"),
    ("wedge", "control"),
    ("plow", "control"),
    ("plough", "control"),
    ("pusher", "control"),
    ("spinner", "vertical_spinner"),
]
# Words of a result text, by method; knockouts are looked for first.
METHOD_RULES = [("ko", "ko"), ("knockout", "ko"), ("knocked out", "ko"), ("jd", "jd"), ("judge", "jd"), ("decision", "jd"), ("split", "jd"), ("unanimous", "jd")]


def first_rule(text: Column, rules: list[tuple[str, str]], default: str = "other") -> Column:
    """The class of the first keyword, in order, that the lower-cased text
    contains. The text is lower-cased once, not once a keyword."""

    def chosen(low: Column) -> Column:
        out = F.lit(default)
        for word, label in reversed(rules):
            out = F.when(F.contains(low, F.lit(word)), label).otherwise(out)
        return out

    return F.get(F.transform(F.array(F.lower(text)), chosen), F.lit(0))


def result_method(text: Column) -> Column:
    """ko, jd or NULL."""
    return F.nullif(first_rule(text, METHOD_RULES, ""), F.lit(""))


def slug(text: Column) -> Column:
    return F.replace(F.trim(text), F.lit(" "), F.lit("_"))


def view_count(text: Column) -> Column:
    """'1,234 views', '123K views', '1.2M views' as a truncated integer; NULL
    without such a count. Hard spaces count as spaces."""
    pattern = r"(?i)([0-9,.]+)\s*([KMB])?\s*views"
    clean = F.translate(text, "\u00a0", " ")
    number = F.replace(F.regexp_extract(clean, pattern, 1), F.lit(","), F.lit(""))
    unit = F.upper(F.regexp_extract(clean, pattern, 2))
    scale = F.when(unit == "K", 1_000).when(unit == "M", 1_000_000).when(unit == "B", 1_000_000_000).otherwise(1)
    return F.floor(number.try_cast("double") * scale).cast("bigint")


def whole_name(text: Column, name: Column) -> Column:
    """Whether a name stands in the text with no letter on either side; case doesn't matter."""
    quoted = F.regexp_replace(F.lower(name), r"([^\p{L}\p{N}\s])", r"\\$1")
    return F.rlike(F.lower(text), F.concat(F.lit("(^|[^A-Za-z])"), quoted, F.lit("([^A-Za-z]|$)")))


def stripped_html(html: Column) -> Column:
    """The text of an HTML string: tags out, white space squeezed."""
    return squeezed(F.regexp_replace(html, "<[^>]*>", " "))


#: White space of all scripts, control characters that separate included.
SPACES = r"[\s\x1c-\x1f\x85\p{Z}]+"


def squeezed(text: Column) -> Column:
    """A text with single spaces between its words and none around them."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def stripped(text: Column) -> Column:
    """A text without white space around it."""
    return F.regexp_replace(text, rf"^{SPACES}|{SPACES}\z", "")


def marks(text: Column, pattern: str) -> Column:
    """Where a pattern stands in a text: an array of (start, stop) in
    characters, summed up once over the lengths of the marks and of what is
    between them."""
    lengths = lambda xs: F.transform(xs, lambda x: F.char_length(x))
    both = F.arrays_zip(lengths(F.split(text, pattern, -1)).alias("gap"), lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("own"))
    kind = "struct<at:int,out:array<struct<start:int,stop:int>>>"

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + x["gap"]
        one = F.array(F.struct(start.alias("start"), (start + x["own"]).alias("stop")))
        return F.when(x["own"].isNull(), s).otherwise(F.struct((start + x["own"]).alias("at"), F.concat(s["out"], one).alias("out")).cast(kind))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("out")).cast(kind)
    return F.aggregate(both, begin, step, lambda s: s["out"])


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), F.lit(1))


def markers(text: Column, key: str) -> Column:
    """All integers that follow ``"key":`` in a text."""
    found = F.regexp_extract_all(text, F.lit(f'"{re.escape(key)}"\\s*:\\s*([0-9]+)'), F.lit(1))
    return F.transform(found, lambda v: v.cast("bigint"))


def json_blob(text: Column, marker: str) -> Column:
    """The JSON object that follows a marker, up to its closing brace: braces in
    strings don't count. Found in Python, as it is no regular language."""
    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        import json

        def one(text: str | None) -> str | None:
            at = text.find(marker) if text else -1
            begin = text.find("{", at + len(marker)) if at >= 0 else -1
            if begin < 0:
                return None
            try:
                return text[begin : json.JSONDecoder().raw_decode(text, begin)[1]]
            except ValueError:
                return None

        return texts.map(one)

    return cut(text)


def unfenced(text: Column) -> Column:
    """A reply without its ``` fence."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def content_key(*parts: Column) -> Column:
    """A content address: the parts' sha256, zero-separated."""
    return F.sha2(F.concat_ws("\0", *parts).cast("binary"), 256)


def palette_index(name: Column, size: int = 10) -> Column:
    """A stable index: the first eight hex digits of the name's sha256, mod size."""
    return (F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("bigint") % size).cast("int")


def clock(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("int")
    return F.format_string("%d:%02d", (whole / 60).cast("int"), whole % 60)
