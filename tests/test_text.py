import unicodedata

import pytest
from pyspark.sql import functions as F

from factloom.functions.freshness import age_days, decay, first_date, is_volatile_text, mtime_date, must_reverify, status
from factloom.functions.tags import line_tag, strip_tags, without_tag
from factloom.functions.text import content_words, normalized, porter_stem, words_of


@pytest.mark.parametrize(
    "word, stem",
    [x.split(":") for x in "caresses:caress ponies:poni ties:ti cats:cat feed:feed agreed:agre plastered:plaster motoring:motor sing:sing conflated:conflat troubled:troubl sized:size hopping:hop falling:fall hissing:hiss filing:file happy:happi sky:sky relational:relat conditional:condit digitizer:digit operator:oper callousness:callous triplicate:triplic formalize:formal electrical:electr hopeful:hope revival:reviv allowance:allow inference:infer adjustment:adjust adoption:adopt probate:probat rate:rate controlling:control roll:roll generalization:gener relocating:reloc relocate:reloc technology:technolog biology:biologi analogy:analog possibly:possibl terribly:terribl nationally:nation conformably:conform is:is 2026:2026 v2beta:v2beta 日本語:日本語".split()],
)
def test_porter(word, stem):
    assert porter_stem(word) == stem


def test_words_and_tokens(spark):
    df = spark.createDataFrame([("Mara's phone: 555-0142",), ("The meetings were in the morning, isn't it? Café_ÜBER Straße O’Brien",), (None,), ("",)], "t string")
    rows = df.withColumn("n", normalized(F.coalesce("t", F.lit("")))).select(words_of(F.col("n")).alias("w")).withColumn("c", content_words(F.col("w"))).collect()
    assert rows[0].w == ["mara", "phone", "555", "0142"]
    assert rows[1].w == ["the", "meetings", "were", "in", "the", "morning", "isnt", "it", "cafe", "uber", "strasse", "obrien"]
    assert rows[1].c == ["meetings", "morning", "isnt", "cafe", "uber", "strasse", "obrien"]
    assert rows[2].w == rows[3].w == []


def test_normalized_is_plain_python(spark):
    chars = [chr(c) for c in range(1, 0x3000) if unicodedata.category(chr(c)) not in ("Cn", "Cs") and c != 0x1C89] + ["ﬁ", "İ", "ẞ", "ŉ", "กำ", "कि", "ΑΣ", "Ǆ", "𝐀", "e\u0301\u0327", "ﬃ"]
    df = spark.createDataFrame([(c,) for c in chars], "t string")
    want = {c: "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).casefold() for c in chars}
    wrong = {r.t: (r.n, want[r.t]) for r in df.withColumn("n", normalized(F.col("t"))).collect() if r.n != want[r.t]}
    assert not wrong


def test_dates(spark):
    df = spark.createDataFrame([("on 2026-02-30 then 2026-03-01",), ("20260314",), ("12026-03-01",), (None,)], "t string")
    assert [str(r[0]) for r in df.select(first_date(F.col("t"))).collect()] == ["2026-03-01", "None", "None", "None"]
    df = spark.createDataFrame([(0.0,), (-5.0,), (1772323200.0,), (9e20,), (None,)], "m double")
    assert [str(r[0]) for r in df.select(mtime_date(F.col("m"))).collect()] == ["None", "None", "2026-03-01", "None", "None"]


def test_freshness_boundaries(spark):
    ages = [0, 30, 31, 90, 91, 365, 366, -5, None]
    df = spark.createDataFrame([(a, v) for a in ages for v in (False, True)], "n int, v boolean")
    day = F.date_sub(F.lit("2026-09-29").cast("date"), F.col("n"))
    age = age_days(F.when(F.col("n").isNotNull(), day), F.lit("2026-09-29").cast("date"))
    must = must_reverify(age, F.col("v"))
    got = {(r.n, r.v): (r.s, r.m, r.a) for r in df.select("n", "v", status(age, must).alias("s"), must.alias("m"), age.alias("a")).collect()}
    assert [got[a, False][0] for a in ages] == ["FRESH"] * 4 + ["AGING", "AGING", "STALE", "FRESH", "STALE"]
    assert got[30, True] == ("FRESH", False, 30) and got[31, True] == ("STALE", True, 31) and got[None, True] == ("STALE", True, None) and got[-5, True][2] == 0
    assert [r[0] for r in spark.createDataFrame([(180,), (0,), (None,)], "a int").select(decay(F.col("a"))).collect()] == [0.5, 1.0, 0.0]


@pytest.mark.parametrize("text, volatile", [("currently $5", True), ("Costs rose", True), ("open until nine", True), ("Status: on", True), ("the coast is clear", False), ("opened a jar", False), ("5 EUR", True)])
def test_volatile(spark, text, volatile):
    assert spark.createDataFrame([(text,)], "t string").select(is_volatile_text(F.col("t"))).first()[0] is volatile


def test_tags(spark):
    good = ["x {explicit, user, from 2026-08-14}", "x {Inferred}", "x {until 2026-01-01} ", "x {supersedes: old key}", "x {from 2026-01-01, until 2026-01-01}"]
    bad = ["x {explicit, explicit}", "x {explicit, observed}", "x {guess}", "x {from 2026-02-30}", "x {from 2026-02-02, until 2026-02-01}", "x {}", "x {explicit,}", "x {explicit} y", "x"]
    df = spark.createDataFrame([(t,) for t in good + bad], "t string").select("t", line_tag(F.col("t")).alias("m"), without_tag(F.col("t")).alias("w"))
    rows = {r.t: r for r in df.collect()}
    assert all(rows[t].m is not None and rows[t].w == "x" for t in good) and all(rows[t].m is None and rows[t].w == t for t in bad)
    m = rows[good[0]].m
    assert (m.authority, m.source, str(m.valid_from), m.valid_until, m.supersedes) == ("explicit", "user", "2026-08-14", None, None)
    assert rows[good[1]].m.authority == "inferred" and rows[good[3]].m.supersedes == "old key"
    assert spark.createDataFrame([("a {user}\nb {no}\n",)], "t string").select(strip_tags(F.col("t"))).first()[0] == "a\nb {no}\n"
