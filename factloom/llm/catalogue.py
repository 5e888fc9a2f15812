"""Queries of this subpackage by name, and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.markup import clean_markup
from factloom.llm.mixing import mix_sources
from factloom.llm.packing import pack_documents
from factloom.llm.pii import find_pii, redact
from factloom.llm.splitting import split_oversized
from factloom.llm.subjects import assign_subjects
from factloom.llm.survivors import surviving_records
from factloom.session import load, spread


#: White space of any kind, written out so that both engines agree.
BLANK = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(load(spark, sf_dir, "chunks"), load(spark, sf_dir, "name_parts"), id="chunk_id", text="text")
    return found.select("chunk_id", "pii_type", "pii_text").distinct()


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = load(spark, sf_dir, "chunks").select("chunk_id", "text").distinct()
    return redact(chunks, load(spark, sf_dir, "name_parts"), id="chunk_id", text="text").select("chunk_id", "redacted", "n_pii")


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every delivered chunk; those of a chunk delivered twice occur twice."""
    chunks = load(spark, sf_dir, "chunks").select("chunk_id", "path", "start_line", "text")
    return split_oversized(spread(chunks, "chunk_id"), text="text", start_line="start_line")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).filter("cut_kind is not null").select("chunk_id", "cut_kind").distinct()


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).select("chunk_id", "piece_no", "piece_start", "piece_end", "overlap_chars", "piece_text", "cut_kind").distinct()


def p2_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pieces of each chunk hold without their overlaps and without white space, and that none is too long."""
    own = F.regexp_replace(F.substring("piece_text", F.col("overlap_chars") + 1, F.length("piece_text")), BLANK, "")
    pieces = _pieces(spark, sf_dir).select("chunk_id", "path", "start_line", "piece_no", F.xxhash64("piece_text").alias("same"), F.length(own).alias("signs"), F.length("piece_text").alias("n")).distinct()
    return pieces.groupBy("chunk_id").agg(F.sum("signs").alias("signs"), F.count_if(F.col("n") > 1500).alias("too_long"))


def _survivors(spark: SparkSession, sf_dir: str, undated: str) -> DataFrame:
    found = surviving_records(
        load(spark, sf_dir, "conflicts"), id="conflict_id", key="fact_key", winner="winner", values="value_map", resolved="resolved", authority="authority", reported_at="reported_at", undated=undated
    )
    return found.filter("group_id < last_id").select("group_id", "winner", "winner_value", F.col("resolved").cast("int").alias("resolved"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _survivors(spark, sf_dir, "earliest")


def p3_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _survivors(spark, sf_dir, "learned")


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_markup(load(spark, sf_dir, "chunks"), id="chunk_id", text="text", headings="heading_path")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = _cleaned(spark, sf_dir)
    rows = cleaned.select("chunk_id", F.explode(F.create_map(F.lit("text"), "text_markup", F.lit("heading_path"), "heading_markup")).alias("field_name", "langs"))
    return rows.select("chunk_id", "field_name", F.explode("langs").alias("markup")).distinct()


def p4_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir).select("chunk_id", "clean_text", F.array_join("clean_headings", " > ").alias("clean_heading_path")).distinct()


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents"), id="doc_id", text="text")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that came out in more than one container."""
    return _packed(spark, sf_dir).groupBy("doc_id").agg(F.min("container").alias("a"), F.max("container").alias("b")).filter("a < b").select("doc_id")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placed documents, containers over their capacity, and documents in several containers that would fit into one."""
    placed = _packed(spark, sf_dir)
    full = placed.groupBy("container").agg(F.sum("n_tokens").alias("n")).agg(F.count_if(F.col("n") > 2048).alias("overfull"))
    docs = placed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("parts")).agg(F.count("*").alias("documents"), F.count_if((F.col("n") <= 2048) & (F.col("parts") > 1)).alias("torn"))
    return docs.crossJoin(F.broadcast(full))


def p8_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each target its documents, those taken too often, and whether the reported shares agree with the mixture."""
    mixture, report = _mixed(spark, sf_dir)
    made = mixture.groupBy("source").agg(F.max("copies").alias("most"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"))
    whole = made.agg(F.sum("tokens").alias("whole"))
    rows = report.join(made, "source", "left").crossJoin(F.broadcast(whole))
    agree = F.abs(F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)) - F.col("actual_share")) < 1e-9
    return rows.select("source", "n_documents", (F.coalesce("most", F.lit(0)) > F.col("max_repeats")).cast("int").alias("too_often"), agree.cast("int").alias("agrees"))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mix_sources(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"), id="doc_id", text="text", source="source")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1].filter("falls_short").select("source").distinct()


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [r["subject"] for r in load(spark, sf_dir, "subjects").collect()]
    return assign_subjects(load(spark, sf_dir, "documents"), load(spark, sf_dir, "doc_labels"), names, id="doc_id", text="text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir).select("doc_id", "subject").distinct()


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of each subject, and the share of all documents that has it."""
    whole = load(spark, sf_dir, "documents").agg(F.countDistinct("doc_id").alias("all_documents"))
    counts = p9_found(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("documents"))
    return counts.crossJoin(F.broadcast(whole)).select("subject", "documents", (F.col("documents") / F.col("all_documents")).alias("share"))


PLACEHOLDERS = "('', '-', '--', '---', '?', '??', '???', 'n/a', 'na', 'n.a.', 'none', 'null', 'nil', 'unknown', 'tbd', 'tba', 'tbc', '...', '…')"

ORACLE = {
    "p2_found": r"""
WITH c AS (SELECT DISTINCT chunk_id, text FROM chunks WHERE length(text) > 1500),
m AS (SELECT chunk_id, list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS l,
  list_max(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda x: length(x))) AS s,
  list_max(list_transform(regexp_split_to_array(text, '\s+'), lambda x: length(x))) AS w FROM c)
SELECT DISTINCT chunk_id, CASE WHEN l <= 1500 THEN 'line' WHEN s <= 1500 THEN 'sentence' WHEN w <= 1500 THEN 'word' ELSE 'char' END AS cut_kind FROM m""",
    "p3_found": r"""
WITH r AS (SELECT DISTINCT conflict_id AS id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(fact_key), '[^\p{L}\p{N}]+'), lambda w: w <> ''))), ' ') AS grp,
  CASE WHEN winner >= 0 THEN winner END AS winner, value_map, resolved, reported_at AS t,
  CASE authority WHEN 'explicit' THEN 4 WHEN 'observed' THEN 3 WHEN 'imported' THEN 2 WHEN 'inferred' THEN 1 ELSE 0 END AS rank FROM conflicts),
g AS (SELECT grp, min(id) AS group_id FROM r GROUP BY grp HAVING count(DISTINCT id) > 1),
w AS (SELECT grp, winner FROM r WHERE winner IS NOT NULL QUALIFY row_number() OVER (PARTITION BY grp ORDER BY rank DESC, t DESC NULLS LAST, id DESC) = 1),
s AS (SELECT grp, resolved FROM r WHERE resolved IS NOT NULL QUALIFY row_number() OVER (PARTITION BY grp ORDER BY rank DESC, t DESC NULLS LAST, id DESC) = 1),
v AS (SELECT r.grp, value_map[w.winner] AS winner_value, r.rank, r.t, r.id FROM r JOIN w USING (grp)
  WHERE value_map[w.winner] IS NOT NULL AND lower(trim(value_map[w.winner])) NOT IN ('', '-', '--', '---', '?', '??', '???', 'n/a', 'na', 'n.a.', 'none', 'null', 'nil', 'unknown', 'tbd', 'tba', 'tbc', '...')
  QUALIFY row_number() OVER (PARTITION BY r.grp ORDER BY r.rank DESC, r.t DESC NULLS LAST, r.id DESC) = 1)
SELECT group_id, winner, winner_value, CAST(resolved AS INT) AS resolved FROM g LEFT JOIN w USING (grp) LEFT JOIN s USING (grp) LEFT JOIN v USING (grp)""",
    "p3_currency": rf"""
WITH RECURSIVE r AS (SELECT DISTINCT conflict_id AS id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(fact_key), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''))), ' ') AS grp,
  CASE WHEN winner >= 0 THEN winner END AS winner, value_map, resolved, reported_at AS t, CASE authority WHEN 'explicit' THEN 4 WHEN 'observed' THEN 3 WHEN 'imported' THEN 2 WHEN 'inferred' THEN 1 ELSE 0 END AS rank FROM conflicts),
s AS (SELECT *, CASE WHEN value_map[winner] IS NOT NULL AND lower(trim(value_map[winner])) NOT IN {PLACEHOLDERS} THEN lower(trim(value_map[winner])) END AS said FROM r),
steps AS (SELECT earlier, later, count(*) AS n FROM (SELECT lag(said) OVER (PARTITION BY grp ORDER BY t, id) AS earlier, said AS later FROM (SELECT DISTINCT grp, t, id, said FROM s WHERE t IS NOT NULL AND said IS NOT NULL)) WHERE earlier <> later GROUP BY ALL),
pairs AS (SELECT a.earlier, a.later FROM steps a LEFT JOIN steps b ON a.earlier = b.later AND a.later = b.earlier WHERE a.n > coalesce(b.n, 0)),
own AS (SELECT * FROM s WHERE said IS NOT NULL AND grp IN (SELECT grp FROM s WHERE t IS NULL AND said IS NOT NULL)),
reach AS (SELECT earlier, later FROM pairs WHERE earlier IN (SELECT said FROM own) UNION SELECT x.earlier, p.later FROM reach x JOIN pairs p ON x.later = p.earlier),
before AS (SELECT x.earlier, x.later FROM reach x LEFT JOIN reach y ON x.earlier = y.later AND x.later = y.earlier WHERE y.later IS NULL UNION SELECT earlier, later FROM pairs),
vals AS (SELECT DISTINCT grp, said FROM own),
newer AS (SELECT a.grp, a.said, -count(*) AS newer FROM vals a JOIN before b ON a.said = b.earlier JOIN vals c ON c.grp = a.grp AND c.said = b.later GROUP BY ALL),
aft AS (SELECT o.grp, o.rank, b.later AS said, max(o.t) AS aft FROM own o JOIN before b ON o.said = b.earlier WHERE o.t IS NOT NULL GROUP BY ALL),
f AS (SELECT s.*, coalesce(s.t, aft) AS at_, CASE WHEN s.t IS NULL THEN 1 ELSE 0 END AS late, CASE WHEN s.t IS NULL THEN coalesce(newer, 0) ELSE 0 END AS fresh
  FROM s LEFT JOIN newer USING (grp, said) LEFT JOIN aft USING (grp, rank, said)),
g AS (SELECT grp, min(id) AS group_id FROM s GROUP BY grp HAVING count(DISTINCT id) > 1),
w AS (SELECT grp, winner FROM f WHERE winner IS NOT NULL QUALIFY row_number() OVER (PARTITION BY grp ORDER BY rank DESC, at_ DESC NULLS LAST, late DESC, fresh DESC, id DESC) = 1),
z AS (SELECT grp, resolved FROM f WHERE resolved IS NOT NULL QUALIFY row_number() OVER (PARTITION BY grp ORDER BY rank DESC, at_ DESC NULLS LAST, late DESC, fresh DESC, id DESC) = 1),
v AS (SELECT f.grp, value_map[w.winner] AS winner_value FROM f JOIN w USING (grp) WHERE value_map[w.winner] IS NOT NULL AND lower(trim(value_map[w.winner])) NOT IN {PLACEHOLDERS}
  QUALIFY row_number() OVER (PARTITION BY f.grp ORDER BY f.rank DESC, f.at_ DESC NULLS LAST, f.late DESC, f.fresh DESC, f.id DESC) = 1)
SELECT group_id, winner, winner_value, CAST(resolved AS INT) AS resolved FROM g LEFT JOIN w USING (grp) LEFT JOIN z USING (grp) LEFT JOIN v USING (grp)""",
    "p2_tiles": rf"SELECT chunk_id, CAST(sum(length(regexp_replace(text, '{BLANK}', '', 'g'))) AS BIGINT) AS signs, 0 AS too_long FROM (SELECT DISTINCT chunk_id, path, start_line, text FROM chunks WHERE text IS NOT NULL) GROUP BY chunk_id",
    "p7_fill": "SELECT count(DISTINCT doc_id) AS documents, 0 AS torn, 0 AS overfull FROM documents WHERE text IS NOT NULL AND text <> '' AND doc_id IS NOT NULL",
    "p8_bounds": r"""SELECT m.source, count(DISTINCT CASE WHEN text <> '' THEN (doc_id, text) END) AS n_documents, 0 AS too_often, 1 AS agrees FROM mix_targets m
LEFT JOIN documents d ON regexp_replace(lower(d.source), '[^\p{L}\p{N}]+', '', 'g') = regexp_replace(lower(m.source), '[^\p{L}\p{N}]+', '', 'g') GROUP BY m.source""",
}

QUERIES = {f.__name__: f for f in (p1_found, p1_redacted, p2_found, p2_pieces, p2_tiles, p3_found, p3_currency, p4_found, p4_clean, p7_found, p7_containers, p7_fill, p8_found, p8_mixture, p8_report, p8_bounds, p9_found, p9_composition)}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
