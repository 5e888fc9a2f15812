"""Made-up vaults of notes with questions whose answers are known, and the figures of searching them.

Everything follows from numbers and a seed by hashing, in Spark expressions, so that a vault of any size is made in
parallel and is the same every time.
"""

from __future__ import annotations

import hashlib
import json
import os
from datetime import date
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import with_tokens
from factloom.operators import evaluate, retrieval, search
from factloom.session import cut, spread

NOW = date(2026, 10, 1)
FIRST = "2024-01-05"
HEADS = ["Alder", "Basalt", "Cinder", "Dorian", "Ember", "Fjord", "Granite", "Harrow", "Indigo", "Juniper", "Kestrel", "Lumen", "Marram", "Nimbus", "Osprey", "Pumice"]
TAILS = ["Works", "Bridge", "Harbor", "Mill", "Garden", "Tower", "Field", "Station"]
PEOPLE = ["Ana", "Boris", "Chidi", "Dara", "Emil", "Farah", "Goran", "Hana", "Ines", "Jonas", "Kaya", "Liam", "Mina", "Noor", "Oskar", "Petra"]
SURNAMES = ["Abbott", "Brandt", "Castillo", "Dumont", "Eriksen", "Fontaine", "Garcia", "Holm"]
#: Attributes with another way to ask for each.
ATTRIBUTES = {"project lead": "person in charge", "budget owner": "holder of the purse", "release manager": "who ships it", "support contact": "whom to call for help"}


def _pick(words: list[str], *of: Column | str) -> Column:
    return F.get(F.array(*map(F.lit, words)), F.pmod(F.xxhash64(*[F.lit(x) if isinstance(x, str) else x for x in of]), F.lit(len(words))).cast("int"))


def recorded(spark: SparkSession, n_entities: int, seed: int = 7) -> DataFrame:
    """(entity, name, attribute, version, versions, value, day): what is told about each entity, one to three values a fact."""
    e, s = F.col("entity"), F.lit(seed)
    name = F.concat_ws(" ", _pick(HEADS, e, s, "head"), _pick(TAILS, e, s, "tail"), F.format_string("%d", e))
    rows = spark.range(n_entities).withColumnRenamed("id", "entity").withColumn("name", name).withColumn("attribute", F.explode(F.array(*map(F.lit, ATTRIBUTES))))
    rows = rows.withColumn("versions", (F.pmod(F.xxhash64("entity", "attribute", s), F.lit(3)) + 1).cast("int")).withColumn("version", F.explode(F.sequence(F.lit(1), "versions")))
    value = F.concat_ws(" ", _pick(PEOPLE, e, F.col("attribute"), F.col("version"), s), _pick(SURNAMES, e, F.col("version"), s), F.format_string("%d", "version"))
    day = F.date_add(F.lit(FIRST).cast("date"), (F.pmod(F.xxhash64("entity", s), F.lit(90)) + (F.col("version") - 1) * 200 + F.pmod(F.xxhash64("attribute", "entity", s), F.lit(60))).cast("int"))
    return rows.withColumn("value", value).withColumn("day", day)


def vault(facts: DataFrame) -> DataFrame:
    """(path, text, mtime): a page for each entity with its first values, and a journal page a day for later ones."""
    said = F.concat(F.lit("- "), F.initcap("attribute"), F.lit(": "), F.col("value"))
    first = facts.filter("version = 1").groupBy("entity", "name").agg(F.array_sort(F.collect_list(F.struct("attribute", said.alias("line")))).alias("lines"), F.min("day").alias("day"))
    body = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    pages = first.select(
        F.format_string("projects/%06d.md", "entity").alias("path"), F.concat(F.lit("---\nverified: "), F.date_format("day", "yyyy-MM-dd"), F.lit("\n---\n# "), F.col("name"), F.lit("\n\n"), body, F.lit("\n\nThe page was set up with the team.\n")).alias("text")
    )
    # A day's page is cut into parts by entity, so that none grows with the vault.
    later = facts.filter("version > 1").withColumn("part", (F.col("entity") / 500).cast("int"))
    entry = F.concat(F.lit("- "), F.col("name"), F.lit(" "), F.col("attribute"), F.lit(": "), F.col("value"))
    days = later.groupBy("day", "part").agg(F.array_sort(F.collect_list(entry)).alias("lines"))
    journal = days.select(F.format_string("journal/%s-%04d.md", F.date_format("day", "yyyy-MM-dd"), "part").alias("path"), F.concat(F.lit("# "), F.date_format("day", "yyyy-MM-dd"), F.lit("\n\n"), F.array_join("lines", "\n"), F.lit("\n")).alias("text"))
    return pages.unionByName(journal).withColumn("mtime", F.lit(0.0))


def cases(facts: DataFrame, one_in: int = 4) -> DataFrame:
    """(qid, question, category, want, old, entity): lookup, paraphrase and superseded questions for a share of the facts."""
    per = facts.groupBy("entity", "name", "attribute").agg(F.max_by("value", "version").alias("want"), F.array_sort(F.collect_list(F.struct("version", "value"))).alias("all"), F.max("versions").alias("versions"))
    per = per.filter(F.pmod(F.xxhash64("entity", "attribute", F.lit("asked")), F.lit(one_in)) == 0)
    other = F.element_at(F.create_map(*[F.lit(x) for kv in ATTRIBUTES.items() for x in kv]), F.col("attribute"))
    category = F.when(F.col("versions") > 1, "superseded").when(F.pmod("entity", F.lit(2)) == 0, "lookup").otherwise("paraphrase")
    asked = F.concat(F.lit("who is the "), F.col("name"), F.lit(" "), F.when(category == "paraphrase", other).otherwise(F.col("attribute")))
    return per.select(
        F.concat_ws("/", "entity", "attribute").alias("qid"), asked.alias("question"), category.alias("category"), "want", F.transform(F.slice("all", 1, F.greatest(F.size("all") - 1, F.lit(0))), lambda x: x["value"]).alias("old"), "entity", "name"
    )


def written(notes: DataFrame, asked: DataFrame, root: str | os.PathLike) -> dict:
    """Writes a vault as files, its cases as JSON lines, and a manifest with a hash of these; files are written one by one."""
    root = Path(root)
    n = 0
    for r in notes.toLocalIterator():
        path = root / r["path"]
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(r["text"], encoding="utf-8")
        n += 1
    digest = hashlib.sha256()
    with open(root / "cases.jsonl", "w", encoding="utf-8") as f:
        for r in asked.orderBy("qid").toLocalIterator():
            line = json.dumps(r.asDict(), sort_keys=True, ensure_ascii=False) + "\n"
            digest.update(line.encode())
            f.write(line)
    made = {"files": n, "cases_sha256": digest.hexdigest()}
    (root / "manifest.json").write_text(json.dumps(made, sort_keys=True))
    return made


def grep(chunks: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(qid, chunk_id, score, rank): chunks by the number of different question words they hold, as in a search without an index."""
    words = with_tokens(chunks.select("chunk_id", "text"), "text").select("chunk_id", F.explode(F.array_distinct("tokens")).alias("term"))
    wanted = asked.select("qid", F.explode(F.array_distinct("terms")).alias("term"))
    return retrieval.top_k(words.join(wanted, "term").groupBy("qid", "chunk_id").agg(F.count("*").cast("double").alias("score")), k)


def systems(tables: dict[str, DataFrame], raw: dict[str, DataFrame], spark: SparkSession, asked: DataFrame, k: int = 10) -> DataFrame:
    """(system, qid, rank, chunk_id) of grep, BM25 without and with stems, and the full search."""
    terms = cut(with_tokens(asked.select("qid", F.col("question").alias("query")), "query", "terms"))
    from factloom.functions.text import stem_all_udf

    stems = cut(terms.withColumn("terms", stem_all_udf("terms")))
    runs = {
        "grep": grep(tables["chunks"], terms, k), "bm25-raw": search.search(raw, terms, k=k, now=NOW, mode="bm25"), "bm25": search.search(tables, stems, k=k, now=NOW, mode="bm25"), "full": search.search(tables, stems, k=k, now=NOW),
    }
    out = None
    for name, found in runs.items():
        one = found.select(F.lit(name).alias("system"), "qid", "rank", "chunk_id")
        out = one if out is None else out.unionByName(one)
    return cut(out)


def figures(spark: SparkSession, n_entities: int = 100, seed: int = 7) -> DataFrame:
    """(system, category, n, r1, r5, mrr, stale_rate) of each system on a vault of its own."""
    told = cut(recorded(spark, n_entities, seed))
    asked = cut(cases(told))
    notes = spread(vault(told))
    tables = search.index_tables(notes)
    raw = tables | {"postings": cut(retrieval.forward(search.with_index_tokens(tables["chunks"], stem=False)))}
    found = systems(tables, raw, spark, asked)
    said = found.join(tables["chunks"].select("chunk_id", "text", "path", "heading_path"), "chunk_id").join(asked, "qid")
    about = F.array_contains("heading_path", F.col("name")) | F.col("text").contains(F.col("name"))
    right = said.filter(about & F.col("text").contains(F.col("want"))).groupBy("system", "qid").agg(F.min("rank").alias("rank"))
    names = found.select("system").distinct()
    all_ = asked.select("qid", "category", (F.size("old") > 0).alias("stale")).crossJoin(F.broadcast(names)).join(right, ["system", "qid"], "left")
    keyed = all_.withColumn("category", F.concat_ws("/", "system", "category"))
    by = evaluate.retrieval_metrics(keyed, "category").filter("category != 'all'")
    whole = evaluate.retrieval_metrics(all_.withColumn("category", F.concat_ws("/", "system", F.lit("all"))), "category").filter("category != 'all'")
    parts = F.split("category", "/")
    return by.unionByName(whole).select(parts[0].alias("system"), parts[1].alias("category"), "n", "r1", "r5", "mrr", "stale_rate")


def markdown(rows: DataFrame, title: str, by: list[str]) -> str:
    """A table of figures as Markdown, three places each, a dash for what there is none of."""
    held = rows.orderBy(*by).collect()
    show = lambda v: "-" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(map(show, r)) + " |" for r in held]
    return "\n".join([f"## {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "-|" * len(rows.columns), *lines, ""])
