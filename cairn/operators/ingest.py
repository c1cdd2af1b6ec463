"""Incremental ingest: what must be uploaded, registering, inheriting, change detection, batching, restoring."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_FILES, BATCH_BYTES = 250, 3 * 1024**3
#: Names that a restore ignores.
IGNORED = (".DS_Store", "Thumbs.db", "desktop.ini")


def check_files(asked: DataFrame, files: DataFrame, contents: DataFrame, version_id: int) -> DataFrame:
    """For asked(ordinal, path, sha256): whether an upload is needed, why not, and the id of a file that is registered."""
    mine = files.where(F.col("version_id") == version_id).select("path", "sha256", F.lit(True).alias("registered"), F.col("id").alias("file_id"))
    known = contents.select("sha256", F.lit(True).alias("known"))
    rows = asked.join(mine, ["path", "sha256"], "left").join(known, "sha256", "left")
    reason = F.when(F.col("registered"), "registered").when(F.col("known"), "content_exists").otherwise("new")
    return rows.select("ordinal", "path", F.col("registered").isNull().alias("needs_upload"), (F.coalesce("registered", F.lit(False)) | F.coalesce("known", F.lit(False))).alias("content_exists"), reason.alias("reason"), "file_id")


def register_batch(asked: DataFrame, files: DataFrame, contents: DataFrame, version_id: int) -> DataFrame:
    """The version's files after registering asked(ordinal, path, sha256, mtime): of a repeated path the last one
    counts, rows of unknown contents are left out."""
    usable = asked.join(contents.select("sha256"), "sha256", "left_semi")
    new = usable.groupBy("path").agg(F.max_by(F.struct("sha256", "mtime"), "ordinal").alias("x")).select("path", F.col("x.sha256").alias("new_sha"), F.col("x.mtime").alias("new_mtime"))
    old = files.where(F.col("version_id") == version_id).select("path", "sha256", "mtime")
    both = old.join(new, "path", "full_outer")
    return both.select("path", F.coalesce("new_sha", "sha256").alias("sha256"), F.coalesce("new_mtime", "mtime").alias("mtime"))


def register_results(asked: DataFrame, contents: DataFrame) -> DataFrame:
    """ordinal, path, registered, reason for every request row."""
    rows = asked.join(contents.select("sha256", F.lit(True).alias("known")), "sha256", "left")
    return rows.select("ordinal", "path", F.col("known").isNotNull().alias("registered"), F.when(F.col("known"), "registered").otherwise("missing").alias("reason"))


def valid_requests(asked: DataFrame, most: int = 500) -> DataFrame:
    """ordinal, valid of asked(ordinal, batch, sha256, size): a digest of 64 characters, no negative size, and one to `most`
    rows in its batch."""
    sizes = asked.groupBy("batch").agg(F.count(F.lit(1)).alias("n"))
    rows = asked.join(sizes, "batch")
    return rows.select("ordinal", (F.coalesce(F.length("sha256") == 64, F.lit(False)) & F.coalesce(F.col("size") >= 0, F.lit(False)) & (F.col("n") <= most)).alias("valid"))


def register_counts(asked: DataFrame, contents: DataFrame) -> DataFrame:
    known = contents.select("sha256", F.lit(True).alias("known"))
    return asked.join(known, "sha256", "left").agg(F.count_if(F.col("known").isNotNull()).alias("registered"), F.count_if(F.col("known").isNull()).alias("missing"))


def inherit(files: DataFrame, source: int, target: int) -> DataFrame:
    """Rows that the target version takes over: paths of the source that it lacks."""
    mine = files.where(F.col("version_id") == target).select("path")
    rows = files.where(F.col("version_id") == source).join(mine, "path", "left_anti")
    return rows.select(F.lit(target).cast("bigint").alias("version_id"), "path", "sha256", "mtime")


def inherit_counts(versions: DataFrame, files: DataFrame, source: int, target: int) -> DataFrame:
    """allowed (the target is running), inherited and skipped rows of inherit()."""
    rows = files.where(F.col("version_id") == source).agg(F.count(F.lit(1)).alias("n"))
    taken = inherit(files, source, target).agg(F.count(F.lit(1)).alias("inherited"))
    allowed = versions.where(F.col("id") == target).agg(F.coalesce(F.bool_and(F.col("status") == "running"), F.lit(False)).alias("allowed"))
    out = allowed.crossJoin(taken).crossJoin(rows)  # one row each
    return out.select("allowed", F.when(F.col("allowed"), F.col("inherited")).otherwise(0).alias("inherited"), F.when(F.col("allowed"), F.col("n") - F.col("inherited")).otherwise(0).alias("skipped"))


def local_changes(listing: DataFrame, previous: DataFrame, contents: DataFrame) -> DataFrame:
    """For listing(path, sha256, size, mtime) against the previous snapshot: fast (same time and size, no read), then
    skip, register or upload by content."""
    before = previous.join(contents.select("sha256", "size"), "sha256", "left").select("path", F.col("sha256").alias("old_sha"), F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"))
    known = contents.select("sha256", F.lit(True).alias("known"))
    rows = listing.join(before, "path", "left").join(known, "sha256", "left")
    same = F.coalesce((F.col("mtime") == F.col("old_mtime")) & (F.col("size") == F.col("old_size")), F.lit(False))
    action = F.when(F.col("sha256") == F.col("old_sha"), "skip").when(F.col("known"), "register").otherwise("upload")
    return rows.select("path", same.alias("fast"), F.when(same, "skip").otherwise(action).alias("action"))


def cloud_changes(listing: DataFrame, finished: DataFrame, resumed: DataFrame) -> DataFrame:
    """For listing(path, mtime): download unless the time is that of the baseline, in which the resumed version's
    rows override the finished one's."""
    base = finished.select("path", F.col("mtime").alias("a")).join(resumed.select("path", F.col("mtime").alias("b")), "path", "full_outer").select("path", F.coalesce("b", "a").alias("known"))
    rows = listing.join(base, "path", "left")
    return rows.select("path", F.when(F.col("mtime") == F.col("known"), "skip").otherwise("download").alias("action"))


def batches(listing: DataFrame, files: int = BATCH_FILES, size: int = BATCH_BYTES) -> DataFrame:
    """group, path, size, batch: a group's files in path order, a batch closed when it has enough files or bytes.  A
    resetting fold: each group is streamed in order, only the running counts are held."""

    def fold(rows: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, batch, count, held = None, 0, 0, 0
        for pdf in rows:
            numbers = []
            for g, n in zip(pdf["group"], pdf["size"], strict=True):
                if g != group:
                    group, batch, count, held = g, 0, 0, 0
                elif count >= files or held >= size:
                    batch, count, held = batch + 1, 0, 0
                count, held = count + 1, held + n
                numbers.append(batch)
            yield pdf.assign(batch=pd.Series(numbers, index=pdf.index, dtype="int64"))

    ordered = listing.select("group", "path", "size").repartition("group").sortWithinPartitions("group", "path")
    return ordered.mapInPandas(fold, "group string, path string, size bigint, batch bigint")


def restore_plan(paths: DataFrame, prefix: str, excluded: list[str], only_below: bool = False) -> DataFrame:
    """For paths(path): the path below the prefix and whether it is unsafe, ignored, excluded or processed.  Paths elsewhere
    are kept whole, or left out with only_below."""
    paths = paths.where(F.startswith("path", F.lit(prefix))) if only_below else paths
    below = F.when(F.startswith("path", F.lit(prefix)), F.substr(F.col("path"), F.lit(len(prefix) + 1))).otherwise(F.col("path"))
    relative = F.ltrim(below, F.lit("/"))
    parts = F.split("relative", "/")
    depth = F.aggregate(
        parts, F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")),
        lambda a, p: F.struct((a["at"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("at"), F.least(a["low"], a["at"] + F.when(p == "..", -1).otherwise(0)).alias("low")),
        lambda a: a["low"],
    )
    kind = F.when(F.col("depth") < 0, "unsafe").when(F.element_at(parts, -1).isin(*IGNORED), "ignored").when(F.arrays_overlap(parts, F.array(*map(F.lit, excluded))), "excluded").otherwise("process")
    return paths.withColumn("relative", relative).withColumn("depth", depth).select("path", "relative", kind.alias("kind"))


def labels_of(shas: DataFrame, files: DataFrame, versions: DataFrame) -> DataFrame:
    hit = files.join(shas, "sha256", "left_semi").select(F.col("version_id").alias("id")).distinct()
    return versions.join(hit, "id", "left_semi").select("label").distinct()
