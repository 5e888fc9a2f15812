"""Queries over whole tables: version histories and validity periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.intervals import merge_periods
from factloom.operators.ledger import bitemporal_ledger, versions
from factloom.session import load


def entry_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = load(spark, sf_dir, "entries")
    return bitemporal_ledger(entries, "fact_key", "value", F.coalesce("valid_from", "as_of"), "recorded_at", "entry_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    found = versions(entry_ledger(spark, sf_dir), "fact_key")
    return found.select("fact_key", text("version_start").alias("version_start"), F.coalesce(text("version_end"), F.lit("open")).alias("version_end"))


def p5_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ledger, times as text so that its rows compare as they are."""
    led = entry_ledger(spark, sf_dir)
    day, instant = (lambda c: F.date_format(c, "yyyy-MM-dd")), (lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return led.select(
        "fact_key", "value", day("valid_from").alias("valid_from"), F.coalesce(day("valid_to"), F.lit("open")).alias("valid_to"), instant("recorded_from").alias("recorded_from"), F.coalesce(instant("recorded_to"), F.lit("now")).alias("recorded_to")
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = load(spark, sf_dir, "fact_tags")
    spans = merge_periods(tags, "fact_key", F.coalesce("valid_from", "as_of"), F.col("valid_until"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    return spans.select("fact_key", "span_kind", text("first_day").alias("first_day"), F.when(F.col("is_open"), "open").otherwise(text("last_day")).alias("last_day"))


QUERIES = {"p5_found": p5_found, "p5_ledger": p5_ledger, "p6_found": p6_found}

ORACLE = {
    # Every update in recorded order: it replaces its day's value, or splits the interval that covers its day.
    "p5_ledger": """
WITH e AS (SELECT DISTINCT fact_key AS k, entry_id AS seq, value, coalesce(valid_from, as_of) AS d, coalesce(epoch_us(recorded_at), -4611686018427387904) AS seen FROM entries
  WHERE value IS NOT NULL AND trim(value) <> '' AND coalesce(valid_from, as_of) IS NOT NULL AND fact_key IS NOT NULL),
f AS (SELECT k, d, seen, seq FROM e QUALIFY row_number() OVER (PARTITION BY k, d ORDER BY seen, seq) = 1),
after_ AS (SELECT a.k, a.d, a.seen, a.seq, min(b.d) AS until FROM f a LEFT JOIN f b ON b.k = a.k AND b.d > a.d AND (b.seen, b.seq) < (a.seen, a.seq) GROUP BY ALL),
split AS (SELECT b.k, max(a.d) AS d, b.seen, b.seq, b.d AS until FROM f b JOIN f a ON a.k = b.k AND a.d < b.d AND (a.seen, a.seq) < (b.seen, b.seq) GROUP BY b.k, b.seen, b.seq, b.d),
ev AS (SELECT k, d, seen, seq, value, NULL::DATE AS until FROM e UNION ALL SELECT k, d, seen, seq, NULL, coalesce(until, DATE '9999-12-31') FROM after_ UNION ALL SELECT k, d, seen, seq, NULL, until FROM split),
told AS (SELECT k, d, seen, last_value(value IGNORE NULLS) OVER o AS value, last_value(until IGNORE NULLS) OVER o AS until, lead(seen) OVER (PARTITION BY k, d ORDER BY seen, seq, value NULLS FIRST) AS replaced
  FROM ev WINDOW o AS (PARTITION BY k, d ORDER BY seen, seq, value NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT k AS fact_key, value, strftime(d, '%Y-%m-%d') AS valid_from, CASE WHEN until = DATE '9999-12-31' THEN 'open' ELSE strftime(until, '%Y-%m-%d') END AS valid_to,
  CASE WHEN seen > -4611686018427387904 THEN strftime(make_timestamp(seen), '%Y-%m-%d %H:%M:%S.%f') END AS recorded_from, coalesce(strftime(make_timestamp(replaced), '%Y-%m-%d %H:%M:%S.%f'), 'now') AS recorded_to
FROM told WHERE replaced IS NULL OR replaced > seen""",
    "p5_found": r"""
WITH r AS (SELECT fact_key, coalesce(valid_from, as_of) AS day, value, recorded_at, entry_id FROM entries
           WHERE coalesce(valid_from, as_of) IS NOT NULL AND value IS NOT NULL AND trim(value) <> ''),
d AS (SELECT fact_key, day, arg_max(value, (recorded_at, entry_id)) AS value FROM r GROUP BY ALL),
n AS (SELECT fact_key, day, trim(regexp_replace(trim(regexp_replace(regexp_replace(lower(nfc_normalize(value)), '\([^()]*\)', ' ', 'g'), '\s+', ' ', 'g')), '[\s.]+$', '')) AS same FROM d),
c AS (SELECT *, lag(same) OVER (PARTITION BY fact_key ORDER BY day) AS prev FROM n),
k AS (SELECT fact_key, day FROM c WHERE prev IS DISTINCT FROM same)
SELECT fact_key, strftime(day, '%Y-%m-%d') AS version_start,
       coalesce(strftime(lead(day) OVER (PARTITION BY fact_key ORDER BY day), '%Y-%m-%d'), 'open') AS version_end FROM k""",
    "p6_found": r"""
WITH i AS (SELECT DISTINCT fact_key, coalesce(valid_from, as_of) AS a, coalesce(valid_until, DATE '9999-12-31') AS b FROM fact_tags
           WHERE coalesce(valid_from, as_of) IS NOT NULL AND (valid_until IS NULL OR valid_until >= coalesce(valid_from, as_of))),
m AS (SELECT *, max(b) OVER (PARTITION BY fact_key ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY fact_key ORDER BY a, b) AS grp FROM m),
p AS (SELECT fact_key, grp, min(a) AS a, max(b) AS b FROM g GROUP BY ALL),
q AS (SELECT *, lead(a) OVER (PARTITION BY fact_key ORDER BY a) AS nxt FROM p)
SELECT fact_key, 'period' AS span_kind, strftime(a, '%Y-%m-%d') AS first_day, CASE WHEN b = DATE '9999-12-31' THEN 'open' ELSE strftime(b, '%Y-%m-%d') END AS last_day FROM q
UNION ALL SELECT fact_key, 'gap', strftime(b + 1, '%Y-%m-%d'), strftime(nxt - 1, '%Y-%m-%d') FROM q WHERE nxt IS NOT NULL""",
}
