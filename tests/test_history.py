import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators.intervals import merge_periods
from factloom.operators.ledger import bitemporal_ledger, versions

DAY0 = dt.date(2024, 1, 1)


def day(n):
    return None if n is None else DAY0 + dt.timedelta(n)


def brute_periods(rows):
    out = set()
    for k in {r[0] for r in rows if r[0] is not None}:
        spans = sorted((a, 10**6 if b is None else b) for q, a, b in rows if q == k and a is not None and (b is None or b >= a))
        merged = []
        for a, b in spans:
            if merged and a <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        for i, (a, b) in enumerate(merged):
            out.add((k, "period", day(a), None if b == 10**6 else day(b)))
            if i:
                out.add((k, "gap", day(merged[i - 1][1] + 1), day(a - 1)))
    return out


def test_periods_match_brute_force(spark):
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.3 else f"k{rnd.randrange(40)}", rnd.choice([None] + [rnd.randrange(400)] * 9), rnd.choice([None] + [rnd.randrange(400)] * 5)) for _ in range(900)]
    rows += rows[:50] + [(None, 1, 2)]
    df = spark.createDataFrame([(k, day(a), day(b), "x", "y") for k, a, b in rows], "k string, a date, b date, key string, node string")
    got = {tuple(r)[:4] for r in merge_periods(df, "k", F.col("a"), F.col("b")).collect()}
    assert got == brute_periods(rows)


def test_periods_of_nothing(spark):
    df = spark.createDataFrame([], "k string, a date, b date")
    assert merge_periods(df, "k", F.col("a"), F.col("b")).collect() == []


def brute_ledger(rows):
    """Replays the updates in recorded order and writes down every row that is opened or closed."""
    out = []
    for k in {r[0] for r in rows}:
        now = {}
        for _, d, seen, seq, v in sorted((r for r in set(rows) if r[0] == k), key=lambda r: (r[2], r[3])):
            nxt = min((e for e in now if e > d), default=None)
            if d in now:
                out.append((k, *now[d], seen))
                now[d] = (now[d][0], d, now[d][2], seen)
                now[d] = (v, d, now[d][2], seen)
                continue
            prev = max((e for e in now if e < d), default=None)
            if prev is not None:
                out.append((k, *now[prev], seen))
                now[prev] = (now[prev][0], prev, d, seen)
            now[d] = (v, d, nxt, seen)
        out += [(k, *x, None) for x in now.values()]
    return [(k, v, day(a), day(b), r, s) for k, v, a, b, r, s in out if s is None or s > r]


@pytest.mark.parametrize("seed", [1, 2])
def test_ledger_matches_replay(spark, seed):
    rnd = random.Random(seed)
    rows = [(f"f{rnd.choice([0, 0, rnd.randrange(9)])}", rnd.randrange(30), rnd.randrange(200), i, rnd.choice("abc")) for i in range(300)]
    at = lambda s: dt.datetime(2024, 6, 1) + dt.timedelta(hours=s)
    df = spark.createDataFrame([(f, day(d), at(s), i, v) for f, d, s, i, v in rows + rows[:20]], "f string, d date, r timestamp_ntz, i long, v string")
    df = df.withColumn("seen", F.lit("clash")).withColumn("fact", F.lit("clash"))
    back = lambda t: None if t is None else (t - dt.datetime(2024, 6, 1)) // dt.timedelta(hours=1)
    led = bitemporal_ledger(df, "f", "v", F.col("d"), "r", "i")
    cast = led.select("f", "v" if "v" in led.columns else "value", "valid_from", "valid_to", F.col("recorded_from").cast("timestamp_ntz"), F.col("recorded_to").cast("timestamp_ntz"))
    key = lambda t: tuple((x is None, str(x)) for x in t)
    got = sorted(((*tuple(r)[:4], back(r[4]), back(r[5])) for r in cast.collect()), key=key)
    assert got == sorted(brute_ledger(rows), key=key)


def test_versions_join_equal_spellings_and_ignore_dirt(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [
        ("a", day(0), t, 1, "Paused"), ("a", day(3), t, 2, " paused. "), ("a", day(5), t, 3, "paused (tbc)"), ("a", day(9), t, 4, "Café"), ("a", day(10), t, 5, "Café"),
        ("a", None, t, 6, "x"), ("a", day(4), t, 7, None), ("a", day(4), t, 8, "  "), (None, day(4), t, 9, "x"), ("b", day(1), None, None, "old"), ("b", day(1), t, 1, "new"),
    ]
    df = spark.createDataFrame(rows, "f string, d date, r timestamp_ntz, i long, v string")
    got = {(r.f, r.value, r.version_start, r.version_end) for r in versions(bitemporal_ledger(df, "f", "v", F.col("d"), "r", "i"), "f").collect()}
    assert got == {("a", "Paused", day(0), day(9)), ("a", "Café", day(9), None), ("b", "new", day(1), None)}
    empty = spark.createDataFrame([], df.schema)
    assert versions(bitemporal_ledger(empty, "f", "v", F.col("d"), "r", "i"), "f").collect() == []
