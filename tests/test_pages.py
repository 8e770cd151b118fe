"""Web pages: fight cards, info boxes, cards and cells, in any script."""

import re
import time

import numpy as np
from pyspark.sql import functions as F

from ringside.functions import text as T
from ringside.sources import corpora, pages


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def is_name(s, letter):
    return 2 <= len(s) <= 31 and letter(s[0]) and all(c.isalnum() or c in "_ .'-" for c in s)


def plain_card(html):
    """The pairings by definition: the leftmost name that a word of pairing
    follows, the nearest such word, and the longest name behind it."""
    text = " ".join(re.sub("<[^>]*>", " ", html).split())
    ascii_letter = lambda c: c.isascii() and c.isalpha()
    capital = lambda c: c.isascii() and c.isupper()

    def pairing(s):
        for stop in range(s + 2, min(s + 31, len(text)) + 1):
            if not is_name(text[s:stop], ascii_letter):
                continue
            for word in ("versus", "vs.", "vs"):
                begin = stop + len(word) + 2
                if text[stop:begin].lower() != f" {word} ":
                    continue
                for end in range(min(begin + 31, len(text)), begin + 1, -1):
                    if is_name(text[begin:end], ascii_letter):
                        return text[s:stop].strip(), text[begin:end].strip(), end
        return None

    def winner(part):
        for s in range(len(part)):
            for stop in range(s + 2, min(s + 31, len(part)) + 1):
                if is_name(part[s:stop], capital) and any(part[stop:].startswith(f" {w} ") for w in ("defeat", "defeats", "defeated", "def.", "beat")):
                    return part[s:stop].strip()
        return None

    at, seen, out = 0, set(), []
    while at < len(text):
        found = pairing(at)
        if not found:
            at += 1
            continue
        a, b, end = found
        pair = tuple(sorted((a.lower(), b.lower())))
        if len(a) > 1 and len(b) > 1 and a.lower() != b.lower() and pair not in seen:
            seen.add(pair)
            won = winner(text[max(0, at - 200) : end + 200])
            out.append((a, b, won if won in (a, b) else None))
        at = end
    return out


def cards(spark, html):
    rows = pages.fight_card(frame(spark, list(html.items()), "page string, html string"), "page", "html").orderBy("page", "at").collect()
    got = {k: [] for k in html}
    for r in rows:
        got[r["page"]].append((r["bot_a"], r["bot_b"], r["winner"]))
    return got


def test_fight_cards_equal_their_definition_on_repeated_runs(spark):
    rng = np.random.default_rng(3)
    words = ["vs", "vs.", "Versus", "VS.", "Red Storm", "Blue", "Señor Bot", "Ñandú", "tombstone", "X", "defeats", "beat", "def.", "defeated", "won", "12", "O'Neil-2", ",", ":", "<b>", "</b>", "\n", " ", "(", "a very long name that goes on and on and on", "日本", "x" * 250]
    html = {f"p{i}": "".join(str(rng.choice(words)) + str(rng.choice([" ", "  ", ""], p=[0.8, 0.1, 0.1])) for _ in range(40)) for i in range(60)}
    html |= {"x": "Señor Bot vs Tombstone", "y": "<p>Red vs. Blue!</p> Red defeats Blue. <i>Gold</i> versus Jade, JADE vs Gold", "z": "", "long": "Red vs Blue, " + "# " * 300 + "Blue beat Red"}
    want = {k: plain_card(v) for k, v in html.items()}
    assert want["x"] == [("Señor Bot", "Tombstone", None)] and want["y"][0] == ("Red", "Blue", "Red") and want["long"] == [("Red", "Blue", None)]
    assert sum(map(len, want.values())) > 60 and any(w for v in want.values() for *_, w in v)
    for _ in range(3):
        assert cards(spark, html) == want
    assert cards(spark, {"y": html["y"]})["y"] == want["y"]


def test_a_long_fight_card_is_read_in_one_pass(spark):
    n = 3000
    html = "".join(f"<p>Señor {k} vs. Señor {k + n}!</p> Señor {k}\u00a0defeats Señor {k + n}.{'# ' * 300}" for k in range(n))
    began = time.perf_counter()
    got = cards(spark, {"p": html})["p"]
    assert got == [(f"Señor {k}", f"Señor {k + n}", f"Señor {k}") for k in range(n)]
    assert time.perf_counter() - began < 30  # minutes, when each name was cut out of the whole text


def test_marks_are_summed_up_once(spark):
    r = frame(spark, [("añb--c-", "plain", "")], "a string, b string, c string").select(*[T.marks(F.col(c), "-+").alias(c) for c in "abc"]).first()
    assert [tuple(x) for x in r["a"]] == [(3, 5), (6, 7)] and r["b"] == [] and r["c"] == []


def test_white_space_of_any_script_is_squeezed(spark):
    r = frame(spark, [(" a  b\x1c\n<br>c　",)], "h string").select(T.stripped_html(F.col("h")).alias("x"), T.stripped(F.col("h")).alias("y")).first()
    assert r["x"] == "a b c" and r["y"].startswith("a") and r["y"].endswith("c")


def test_infoboxes(spark):
    box = '<h3 class="pi-data-label x">\n Team</h3><div class="pi-data-value">Us</div><h3 class="pi-data-label"> Weapon type</h3> <div class="pi-data-value pi">\n Drum <b>spinner</b>\n</div>'
    rows = frame(spark, [(0, box), (1, "none"), (2, None), (3, '<h3 class="pi-data-label">Weapon</h3>')], "i int, h string")
    assert [r[0] for r in rows.orderBy("i").select(pages.infobox(F.col("h"), "Weapon")).collect()] == ["Drum spinner", "", "", ""]
    assert rows.orderBy("i").select(pages.infobox(F.col("h"), "Team")).first()[0] == "Us"


def test_cards_and_their_weapons(spark):
    html = (
        '<A HREF="https://x.y/robots/el-niño"></A><a class="c" href="/robot/el-toro/" id=1>\n El  Toro </a> <b>Weapon Type : </b> <i>\n Vertical spinner </i>'
        '<a href="/robots/two">Two</a> weapon <b>ax</b> and weapon: overhead axe<br> <a href="/robots/three">Th</a><a href="/robots/x">T</a><a href="/robots/two/">TWO</a><a href="/robots">Robots</a>'
    )
    got = {r["name"]: (r["weapon_text"], r["weapon_class"]) for r in corpora.roster_cards(frame(spark, [("p", html)], "page string, html string"), "page", "html").collect()}
    assert set(got) == {"El Toro", "Two", "Th"}
    assert got["El Toro"][0] == "Vertical spinner" and got["Two"][0] == "overhead axe" and got["Th"][0] == ""


def test_a_long_list_of_cards_is_read_in_one_pass(spark):
    n = 1000
    html = "".join(f'<a href="/robots/b-{k}">Bot {k}</a> weapon: <i>drum {k}</i>{"<hr>" * 400}<a href="/robots/">Robots</a>{"<hr>" * 400}' for k in range(n))
    began = time.perf_counter()
    got = corpora.roster_cards(frame(spark, [("p", html)], "page string, html string"), "page", "html").collect()
    assert sorted(map(tuple, got)) == sorted(("p", f"Bot {k}", f"drum {k}", "drum") for k in range(n))
    assert time.perf_counter() - began < 30  # minutes, when each card was cut out of the whole page


def test_history_rows_strip_seeds_records_and_spaces(spark):
    cell = lambda *c: "<tr>" + "".join(f"<td>{x}</td>" for x in c) + "</tr>"
    html = f"<table>{cell(*['World Cup  2-1'] * 3)}{cell('Final', 'VS.  Señor Bot (12) ', 'Lost (JD)')}{cell(*['Exhibition'] * 3)}{cell('', 'vs. Ox', 'Won')}{cell('', 'vs. (1)', 'Won')}</table>"
    rows = corpora.history_rows(corpora.table_rows(frame(spark, [("p", html)], "page string, html string"), "page", "html"), F.lit("Red")).collect()
    assert [(r["season"], r["stage"], r["opponent"], r["won"]) for r in rows] == [("World Cup", "Final", "Señor Bot", False), ("Exhibition", None, "Ox", True)]
