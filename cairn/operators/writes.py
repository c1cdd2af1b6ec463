"""Writes as new tables: inserts that keep or ignore what is there, merges by key, cascades, appends with trimming."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterable, Iterator, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes that a copy reads at a time.
STEP = 1 << 20
#: The square root of the number of ranges in which new ids are counted.
RANGES = 16
WRITTEN = "path string, size bigint, sha256 string, whole boolean"


def numbered(rows: DataFrame, held: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows with new ids that continue the greatest one held (a sequence reset to the maximum).  Row numbers are made
    in ranges of the order: counts of the ranges give each its first number.  A range is told from the row alone, so
    counts and rows agree however often and in whatever partitions they are computed."""
    keys = [F.col(c) for c in order]
    # the rows of the least hashes are drawn evenly: their keys cut the order
    drawn = rows.select(*keys).orderBy(F.xxhash64(*keys), *keys).limit(RANGES * RANGES - 1)
    cuts = drawn.agg(F.sort_array(F.collect_list(F.struct(*keys))).alias("cuts"))  # one row
    ranged = rows.crossJoin(cuts).withColumn("part", range_of(F.col("cuts"), F.struct(*keys))).drop("cuts")
    counts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    firsts = counts.select("part", before.alias("before"))
    last = held.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*keys))
    placed = ranged.withColumn("at", inside).join(firsts, "part").crossJoin(last)  # one row
    return placed.withColumn("id", (F.col("last") + F.col("before") + F.col("at")).cast("bigint")).drop("part", "at", "before", "last")


def range_of(cuts: Column, key: Column) -> Column:
    """How many of the sorted cuts are not above the key: first of every RANGES-th one, then of those that follow it."""
    upto = lambda some: F.size(F.filter(some, lambda cut: cut <= key))
    coarse = F.filter(cuts, lambda _, i: (i + 1) % RANGES == 0)
    return upto(coarse) * RANGES + upto(F.slice(cuts, upto(coarse) * RANGES + 1, RANGES - 1))


def upserted(files: DataFrame, new: DataFrame) -> DataFrame:
    """files(id, version_id, path, sha256, mtime) after new(version_id, path, sha256, mtime, ordinal): a path that is there
    keeps its id and takes the new content, another one gets the next id; of a repeated path the last counts."""
    key = ["version_id", "path"]
    last = new.groupBy(*key).agg(F.max_by(F.struct("sha256", "mtime"), "ordinal").alias("x")).select(*key, F.col("x.sha256").alias("new_sha"), F.col("x.mtime").alias("new_mtime"))
    held = files.select("id", *key, "sha256", "mtime")
    changed = held.join(last, key, "left").select("id", *key, F.coalesce("new_sha", "sha256").alias("sha256"), F.coalesce("new_mtime", "mtime").alias("mtime"))
    fresh = last.join(held.select(*key), key, "left_anti").select(*key, F.col("new_sha").alias("sha256"), F.col("new_mtime").alias("mtime"))
    return changed.unionByName(numbered(fresh, held, key))


def registered_once(files: DataFrame, new: DataFrame) -> DataFrame:
    """Rows to add when a path that is there stays as it is; of a repeated path the first counts."""
    key = ["version_id", "path"]
    first = new.groupBy(*key).agg(F.min_by(F.struct("sha256", "mtime"), "ordinal").alias("x")).select(*key, "x.sha256", "x.mtime")
    return first.join(files.select(*key), key, "left_anti")


def inserted_or_ignored(table: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """The table with the new rows whose key it lacks; of new rows with one key any stays."""
    return table.unionByName(new.dropDuplicates(list(key)).join(table.select(*key), list(key), "left_anti"))


def merged(table: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """The table with the new rows in place of those of their key."""
    return table.join(new.select(*key), list(key), "left_anti").unionByName(new)


def without_labels(labels: DataFrame, versions: DataFrame, files: DataFrame, moves: DataFrame, contents: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """All tables after labels go, with their versions, the files of these, and what no file refers to any longer:
    contents and their waiting moves."""
    left_labels = labels.join(gone.select("label"), "label", "left_anti")
    left_versions = versions.join(gone.select("label"), "label", "left_anti")
    left_files = files.join(left_versions.select(F.col("id").alias("version_id")), "version_id", "left_semi")
    held = left_files.select("sha256")
    return {"labels": left_labels, "versions": left_versions, "files": left_files, "contents": contents.join(held, "sha256", "left_semi"), "moves": moves.join(held, "sha256", "left_semi")}


def with_samples(samples: DataFrame, new: DataFrame, keep: int) -> DataFrame:
    """Samples with new ones appended, and the last `keep` of each volume."""
    newest = Window.partitionBy("volume_path").orderBy(F.desc("sampled_at"), F.desc("id"))
    return samples.unionByName(new).withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= keep).drop("rn")


def compacted(spark: SparkSession, source: str, target: str, files: int) -> DataFrame:
    """A table's files written anew, as so many, into another folder (what is read is never overwritten)."""
    spark.read.parquet(source).repartition(files).write.parquet(target)
    return spark.read.parquet(target)


def exported(tables: dict[str, DataFrame], folder: str, stamp: str) -> list[str]:
    """Each table written below <folder>/<stamp>; the paths."""
    paths = [f"{folder}/{stamp}/{name}" for name in tables]
    for path, df in zip(paths, tables.values(), strict=True):
        df.write.parquet(path)
    return paths


def digest(path: Path) -> str:
    """SHA-256 of a file, read in steps."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def put(target: Path, parts: Iterable[bytes]) -> tuple[int, str, bool]:
    """Write a file beside its place, hashing on the way, move it there and read it again: size, digest, whether what is
    there is what was written.  A task that runs twice leaves one file."""
    target.parent.mkdir(parents=True, exist_ok=True)
    beside, seen, size = target.with_name(f"_tmp_{uuid.uuid4().hex}"), hashlib.sha256(), 0
    try:
        with open(beside, "wb") as out:
            for part in parts:
                out.write(part)
                seen.update(part)
                size += len(part)
        os.replace(beside, target)
    finally:
        beside.unlink(missing_ok=True)
    return size, seen.hexdigest(), digest(target) == seen.hexdigest()


def contents_written(rows: DataFrame, root: str) -> DataFrame:
    """Write rows(path, body) below a folder that every executor sees: path, size, sha256, whole of each file.  Bodies may
    be plain contents or frames; they are written by the tasks that hold them."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [(p, *put(Path(root, p.lstrip("/")), [b])) for p, b in zip(batch["path"], batch["body"], strict=True)]
            yield pd.DataFrame(done, columns=["path", "size", "sha256", "whole"])

    return rows.select("path", "body").mapInPandas(run, WRITTEN)


def contents_copied(rows: DataFrame, root: str) -> DataFrame:
    """Copy rows(source, path) below the folder, a step at a time and hashed on the way: path, size, sha256, whole; a source
    that can't be read has nulls and is not whole."""

    def parts(source: str) -> Iterator[bytes]:
        with open(Path(root, source.lstrip("/")), "rb") as f:
            while part := f.read(STEP):
                yield part

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done: list[tuple] = []
            for source, path in zip(batch["source"], batch["path"], strict=True):
                try:
                    done.append((path, *put(Path(root, path.lstrip("/")), parts(source))))
                except OSError:
                    done.append((path, None, None, False))
            yield pd.DataFrame(done, columns=["path", "size", "sha256", "whole"]).astype({"size": "Int64"})

    return rows.select("source", "path").mapInPandas(run, WRITTEN)
