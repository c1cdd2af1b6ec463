"""Files and listings as tables: local trees, remote listings in JSON, paged and damaged sources, disk usage."""

from __future__ import annotations

import itertools
import os
import shutil
from collections.abc import Iterable, Iterator, Sequence
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import scalars as X

#: Names that listings ignore, and folders that can't be read without a further sign-in (in any listing) or
#: at all (in listings of one level).
IGNORED = (".DS_Store", "Thumbs.db", "desktop.ini")
PROTECTED, PROTECTED_ALBUMS = ("Personal Vault", "Cofre Pessoal"), ("Recently Deleted",)
#: Services that are walked a directory at a time, and prefixes of temporary files.
WALKED = ("photos",)
TEMPORARY = ("_cloud_tmp_", "_rclone_tmp_", "_tmp_", "_enc_", "_rclone_stage_")
ITEM = "Path string, Name string, Size bigint, ModTime string, IsDir boolean"
CONFIG = "map<string,struct<type:string,service:string>>"


def tree(spark: SparkSession, root: str, with_content: bool = False) -> DataFrame:
    """path (below the root), size, modified and, if asked for, content of all files below a folder that every executor
    sees, names with a leading dot or underscore among them (which Spark's file sources leave out).  Folders at the top
    are walked by tasks of their own, which stream what they find; a file that goes away meanwhile is left out."""
    schema = "path string, size bigint, modified timestamp" + (", content binary" if with_content else "")
    names = schema.split(", ")

    def rows(folder: str, deep: bool) -> Iterator[tuple]:
        for at, inner, files in os.walk(folder):
            inner.sort()
            for name in sorted(files):
                path = os.path.join(at, name)
                try:
                    state = os.stat(path)
                    body = (open(path, "rb").read(),) if with_content else ()
                except OSError:
                    continue
                yield (os.path.relpath(path, root), state.st_size, pd.Timestamp(state.st_mtime_ns // 1000, unit="us", tz="UTC"), *body)
            if not deep:
                return

    def walk(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for top in batch["top"]:
                found = rows(os.path.join(root, top), deep=bool(top))
                while some := list(itertools.islice(found, 64 if with_content else 10_000)):
                    yield pd.DataFrame(some, columns=[n.split()[0] for n in names])

    with os.scandir(root) as entries:
        tops = ["", *sorted(x.name for x in entries if x.is_dir(follow_symlinks=False))]
    return spark.createDataFrame([(t,) for t in tops], "top string").repartition(len(tops), "top").mapInPandas(walk, schema)


def walked(files: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    """Files of a tree(path, size, modified) in the order of their paths, without ignored names and excluded components."""
    parts = F.split("path", "/")
    kept = files.where(~F.element_at(parts, -1).isin(*IGNORED))
    kept = kept.where(~F.arrays_overlap(parts, F.array(*map(F.lit, excluded)))) if excluded else kept
    return kept.select("path", "size", (F.unix_millis(F.col("modified").cast("timestamp")) / 1000.0).alias("mtime")).orderBy("path")


def hashed(files: DataFrame) -> DataFrame:
    """path, size, sha256 of a tree with content: each file is hashed where it is read."""
    return files.select("path", F.octet_length("content").cast("bigint").alias("size"), F.sha2("content", 256).alias("sha256"))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Listing files, each a JSON array of items, as rows; no schema is inferred."""
    return spark.read.schema(ITEM).option("multiLine", "true").json(folder)


def recursive_files(items: DataFrame) -> DataFrame:
    """path, size, mtime of a listing of a whole tree; protected folders count at the top only."""
    parts = F.split("Path", "/")
    kept = items.where(~F.coalesce("IsDir", F.lit(False)) & ~F.element_at(parts, -1).isin(*IGNORED) & ~F.element_at(parts, 1).isin(*PROTECTED))
    return kept.select(F.col("Path").alias("path"), F.coalesce("Size", F.lit(0)).alias("size"), X.iso_seconds(F.col("ModTime")).alias("mtime"))


def one_level(items: DataFrame, folder: Column) -> DataFrame:
    """kind (file or directory), path, size, mtime of listings of single directories; protected folders count at any level."""
    path = F.when(folder == "", F.col("Name")).otherwise(F.concat_ws("/", folder, F.col("Name")))
    is_dir = F.coalesce("IsDir", F.lit(False))
    kept = items.where(F.when(is_dir, ~F.col("Name").isin(*PROTECTED, *PROTECTED_ALBUMS)).otherwise(~F.col("Name").isin(*IGNORED)))
    return kept.select(
        F.when(is_dir, "directory").otherwise("file").alias("kind"), path.alias("path"),
        F.when(~is_dir, F.coalesce("Size", F.lit(0))).alias("size"), F.when(~is_dir, X.iso_seconds(F.col("ModTime"))).alias("mtime"),
    )


def folders(items: DataFrame) -> DataFrame:
    """name, path of the directories of a listing that may be browsed."""
    return items.where(F.coalesce("IsDir", F.lit(False)) & ~F.col("Name").isin(*PROTECTED)).select(F.col("Name").alias("name"), F.col("Path").alias("path"))


def remote_service(config: Column, remote: Column) -> Column:
    """The service of a remote in a configuration dump (JSON map); null if the dump or the remote is not there."""
    return F.try_element_at(F.from_json(config, CONFIG), remote)["service"]


def uses_walk(service: Column) -> Column:
    return F.coalesce(service.isin(*WALKED), F.lit(False))


def remotes(text: Column) -> Column:
    """Names of a listing of remotes: lines without their closing colons, empty ones left out."""
    return F.transform(F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != ""), lambda x: F.regexp_replace(x, ":+$", ""))


def page_bounds(low: int, high: int, rows: int = 500) -> list[str]:
    """Predicates that read the keys from low to high in pages; every key is in one page."""
    return [f"id >= {a} AND id < {a + rows}" for a in range(low, high + 1, rows)]


def paged(spark: SparkSession, url: str, name: str, low: int, high: int, rows: int = 500, properties: dict[str, str] | None = None) -> DataFrame:
    """A database table in pages of its key, a partition each; needs a JDBC driver on the class path."""
    return spark.read.jdbc(url, name, predicates=page_bounds(low, high, rows), properties=properties or {})


def tolerant(spark: SparkSession, folder: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, texts of rows that can't be read) of JSON lines; unreadable files are left out."""
    raw = spark.read.option("ignoreCorruptFiles", "true").text(folder)
    read = raw.select("value", F.from_json("value", schema + ", damaged string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "damaged"}).alias("x"))
    return read.where("x.damaged IS NULL").select("x.*").drop("damaged"), read.where("x.damaged IS NOT NULL").select("value")


def probe(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The volumes table of these folders on the driver's host; one that can't be read is degraded."""
    rows = []
    for ord_, path in enumerate(paths):
        try:
            usage = shutil.disk_usage(path)
            rows.append((path, ord_, usage.total, usage.used, usage.free, False))
        except OSError:
            rows.append((path, ord_, 0, 0, 0, True))
    return spark.createDataFrame(rows, "path string, ord int, total bigint, used bigint, free bigint, degraded boolean")


def temporaries(spark: SparkSession, root: str, cutoff: datetime, prefixes: Sequence[str] = TEMPORARY) -> DataFrame:
    """path, size, modified of temporary files of a volume, at its top or in staging folders there, that are older than the
    cutoff (a time without zone, of the session's zone)."""
    name, match = F.element_at(F.split("path", "/"), 1), F.lit(False)
    for p in prefixes:
        match = match | F.startswith(name, F.lit(p))
    return tree(spark, root).where(match & (F.col("modified") < F.lit(cutoff)))
