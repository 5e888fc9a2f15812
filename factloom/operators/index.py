"""The index of a folder of notes: manifests, versions, and a store that fails closed."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMA_VERSION = 2
MANIFEST = "_manifest.json"


class IndexMissing(Exception):
    """There is no index at this place."""


class IndexCorrupt(Exception):
    """The index at this place can't be trusted."""


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status, mtime, size, sha1) of two manifests with path, mtime, size and sha1.

    unchanged: time and size are equal; touched: only the content is, and the new time is adopted; added, updated, removed.
    """
    o = old.select("path", F.col("mtime").alias("m0"), F.col("size").alias("s0"), F.col("sha1").alias("h0"), F.lit(True).alias("was"))
    both = o.join(new.select("path", "mtime", "size", "sha1", F.lit(True).alias("is")), "path", "full")
    status = (
        F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed")
        .when((F.col("m0") == F.col("mtime")) & (F.col("s0") == F.col("size")), "unchanged").when(F.col("h0") == F.col("sha1"), "touched").otherwise("updated")
    )
    return both.select("path", status.alias("status"), "mtime", "size", "sha1")


def version_of(manifest: DataFrame) -> DataFrame:
    """One row (version, files): a hash over paths and content hashes, in any order; times don't matter.

    Hashes of single files are added up, so no list of files is ever gathered.
    """
    one = F.conv(F.substring(F.sha2(F.concat_ws("|", "path", F.coalesce("sha1", F.lit(""))), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    each = manifest.agg(F.count("*").alias("files"), F.coalesce(F.sum(one).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")).cast("string").alias("total"))
    return each.select(F.substring(F.sha2(F.concat_ws(":", "files", "total"), 256), 1, 12).alias("version"), "files")


def checksum(df: DataFrame) -> tuple[int, int]:
    """(rows, an order-free sum over the hashes of all rows)."""
    cols = [F.to_json(F.struct(F.col(c))) for c in sorted(df.columns)]
    r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).alias("h")).first()
    return r["n"], int(r["h"] or 0)


def misaligned(chunks: DataFrame, postings: DataFrame) -> DataFrame:
    """(chunk_id, missing): chunks without postings, and postings without a chunk; none in a sound index."""
    a, b = chunks.select("chunk_id", F.lit(True).alias("c")), postings.select("chunk_id", F.lit(True).alias("p"))
    return a.join(b, "chunk_id", "full").filter("c is null or p is null").select("chunk_id", F.when(F.col("c").isNull(), "chunk").otherwise("postings").alias("missing"))


class Folder:
    """A folder on any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, place: str):
        self.jvm, self.place = spark.sparkContext._jvm, place.rstrip("/")
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.place}/{name}" if name else self.place)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self.path(name))

    def read(self, name: str) -> str:
        with_ = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(with_)).decode("utf-8")
        finally:
            with_.close()

    def write(self, name: str, text: str) -> None:
        """Puts a whole file in place at once."""
        tmp = f"_tmp-{uuid.uuid4().hex}"
        out = self.fs.create(self.path(tmp), True)
        out.write(bytearray(text.encode("utf-8")))
        out.hsync()
        out.close()
        options = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.jvm.java.lang.reflect.Array.newInstance(options.OVERWRITE.getClass(), 1)
        how[0] = options.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self.path(tmp), self.path(name), how)

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(""))]

    def drop(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def move(self, name: str, to: str) -> None:
        self.fs.rename(self.path(name), self.path(to))

    def bytes(self) -> int:
        return self.fs.getContentSummary(self.path("")).getLength()


def save(tables: dict[str, DataFrame], folder: str) -> dict:
    """Writes all tables into a new generation, then points the manifest at it; gives back the manifest.

    Readers see the old index until the manifest is replaced, which happens at once; only then the old one goes.
    """
    spark = next(iter(tables.values())).sparkSession
    home, generation = Folder(spark, folder), f"gen-{uuid.uuid4().hex}"
    meta: dict = {"schema": SCHEMA_VERSION, "generation": generation, "built_at": datetime.now(timezone.utc).isoformat(timespec="seconds"), "tables": {}}
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{generation}/{name}")
        n, h = checksum(spark.read.schema(df.schema).parquet(f"{folder}/{generation}/{name}"))
        meta["tables"][name] = {"rows": n, "checksum": h, "schema": df.schema.jsonValue()}
    home.write(MANIFEST, json.dumps(meta, sort_keys=True))
    for name in home.names():
        if name.startswith("gen-") and name != generation:
            home.drop(name)
    return meta


def describe(spark: SparkSession, folder: str) -> dict:
    """The size and age of a saved index: index_bytes, built_at."""
    home = Folder(spark, folder)
    return {"index_bytes": home.bytes(), "built_at": json.loads(home.read(MANIFEST)).get("built_at")}


def open_index(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a saved index, after its manifest, row counts and checksums have been verified."""
    home = Folder(spark, folder)
    if not home.exists():
        raise IndexMissing(folder)
    try:
        meta = json.loads(home.read(MANIFEST))
        if meta["schema"] != SCHEMA_VERSION:
            raise IndexCorrupt(f"schema {meta['schema']}")
        out = {}
        for name, want in meta["tables"].items():
            df = spark.read.schema(StructType.fromJson(want["schema"])).parquet(f"{folder}/{meta['generation']}/{name}")
            if checksum(df) != (want["rows"], want["checksum"]):
                raise IndexCorrupt(f"table {name} is not as it was written")
            out[name] = df
        return out
    except IndexCorrupt:
        raise
    except Exception as e:
        raise IndexCorrupt(str(e)) from e
