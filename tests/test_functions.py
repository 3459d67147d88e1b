"""Hand cases for text functions; expected values were worked out from the rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import arabic, text


@pytest.fixture
def value(spark):
    def run(make, *rows, kind="string"):
        df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, c {kind}")
        return [r.v for r in df.select("i", make(F.col("c")).alias("v")).orderBy("i").collect()]

    return run


def test_normalize(value):
    rows = ["ما حكم الصلاة في السفر؟", "إِنَّمَا الأعمالُ  بالنيات", "كتـــاب", None, ""]
    assert value(arabic.normalize, *rows) == ["ما حكم الصلاه في السفر؟", "انما الاعمال بالنيات", "كتاب", None, ""]
    once = value(arabic.normalize, *rows[:3])
    assert value(arabic.normalize, *once) == once


def test_tokens(value):
    rows = ["ما حكم الصلاة في السفر؟", "إِنَّمَا الأعمالُ  بالنيات", "التي", "كتـــاب", "hello world", None]
    assert value(arabic.arabic_tokens, *rows) == [["حكم", "صلا", "سفر؟"], ["انم", "اعمال", "نيا"], ["الت"], ["كتاب"], [], []]


def test_stem(value):
    words = ["والكتاب", "المسلمون", "وبالحق", "كتابها", "قال", "وول"]
    assert value(arabic.stem, *words)[:3] == ["كتاب", "مسلم", "الحق"] and value(arabic.stem, "قال", "وول", "من") == ["قال", "وول", "من"]
    assert len(value(arabic.stem, "كتابها")[0]) >= 3


def test_stem_against_the_rule(value):
    import random

    rng = random.Random(1)
    letters = "والبكفلتسنيهامةىدح"

    def rule(word):
        if len(word) < 3:
            return word
        short = word
        for p in sorted(arabic.PREFIXES, key=len, reverse=True):
            if short.startswith(p) and len(short) - len(p) >= 3:
                short = short[len(p) :]
                break
        for s in sorted(arabic.SUFFIXES, key=len, reverse=True):
            if short.endswith(s) and len(short) - len(s) >= 3:
                short = short[: -len(s)]
                break
        short = short[1:] if short.startswith("وو") else short
        return short if len(short) >= 3 else word

    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 10))) for _ in range(3000)]
    assert value(arabic.stem, *words) == [rule(w) for w in words]


def test_folding(value):
    assert value(arabic.fold_for_search, "  Éléphant — l'Été! ", "Ṣaḥīḥ al-Bukhārī", "الصَّلاة", "Ǘß") == ["elephant lete", "sahih albukhari", "الصلاه", "uß"]


def test_stop_words():
    words = arabic.stop_words()
    assert {"من", "إلى", "الى", "عليهن", "معها", "أين", "اين"} <= set(words) and "كان" in words and len(words) > 200


def test_citations(value):
    t = "x [1, 2] y [3،4] [2] z [12,"
    assert value(text.cited_ids, t, None, "no") == [[1, 2, 3, 4], [], []]
    assert value(text.citation_groups, t) == [[[1, 2], [3, 4, 2]]]
    assert value(text.text_between_citations, t) == [["x ", " y ", " z [12,"]]
    assert value(text.without_open_citation, "text [12,", "text [1]", "a [1, 2") == ["text ", "text [1]", "a "]
    assert value(text.book_of, 205870000055, kind="bigint") == [20587]


def test_answers(value):
    rows = ["plain", " a <!-- DETAILED_ANSWER --> b ", "<!-- DETAILED_ANSWER -->", "a<!-- DETAILED_ANSWER -->"]
    assert value(text.simple_answer, *rows) == ["plain", "a", None, "a"] and value(text.detailed_answer, *rows) == [None, "b", None, None]
    assert value(lambda c: text.history_content(F.lit("assistant"), c), rows[1]) == ["a"] and value(lambda c: text.history_content(F.lit("user"), c), rows[1]) == [rows[1]]


def test_html(value):
    html = '<p>x</p><font size="2" color="#be0000">١٢-3</font>[5, 6].<p> </p><p class="a"></p>⦗٧⦘end'
    assert value(text.clean_html, html) == ["<p>x</p><br><br>end"]
    assert value(text.spliced_html, ["<div>a</div> ", "<div>b</div>"], kind="array<string>") == ["<div>a</div><br><br><div>b</div>"]


def test_direction(value):
    assert value(text.direction, "سلام a", "abc س", "123", None, "x" * 200 + "س" * 300) == ["rtl", "ltr", "ltr", "ltr", "ltr"]
    assert value(text.direction_of_all, "x" * 200 + "س" * 300, "привет س", "  ") == ["rtl", "ltr", "ltr"]


def test_values(value):
    assert value(text.positive_ints, "1, x,-2, 3", "", "a,b", None) == [[1, 3], None, None, None]
    assert value(text.floats, "1, nan, x, 2.5") == [[1.0, 2.5]]
    assert value(text.leading_digits, "12 vols", "x 3") == ["12", None]
    assert value(lambda c: text.or_query(c, F.lit(" q ")), [" a ", " "], [" "], None, kind="array<string>") == [["a"], ["q"], ["q"]]
    assert value(lambda c: text.shortened(c, 4), "abcd", "abcde") == ["abcd", "abc…"]
    assert value(text.is_uuid, "123e4567-E89b-12d3-a456-426614174000", "x") == [True, False]
    assert value(text.word_stream, "a b") == [["a ", "b "]]
    assert [tuple(x) for x in value(text.language_names, "__label__fr", "xx")] == [("French", "Français", "Vous DEVEZ rédiger toute votre réponse en français uniquement."), ("xx", "xx", "You MUST write your entire response in xx only.")]


def test_times(value):
    now = dt.datetime(2024, 5, 20, 12)
    rows = [now - dt.timedelta(hours=h) for h in (3, 30, 24 * 5, 24 * 40)]
    assert value(lambda c: text.relative_time(c, F.lit(now)), *rows, kind="timestamp") == ["09:00 AM", "Yesterday", "5 days ago", "Apr 10"]
    assert value(text.iso_time, now, kind="timestamp") == ["2024-05-20T12:00:00.000Z"]
