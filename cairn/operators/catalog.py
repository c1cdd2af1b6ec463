"""Versions, their files and contents: which version is the latest, sizes, differences, reclaimable space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def total(column: Column | str) -> Column:
    """Sum, 0 for no rows."""
    return F.coalesce(F.sum(column), F.lit(0)).cast("bigint")


def done(versions: DataFrame) -> DataFrame:
    return versions.where(F.col("status") == "done")


def latest_by_time(versions: DataFrame, only_done: bool = False) -> DataFrame:
    """Versions at the time of their label's latest finished one: ties stay, and so do other states at that time
    unless only_done."""
    latest = done(versions).groupBy("label").agg(F.max("created_at").alias("created_at"))
    kept = versions.join(latest, ["label", "created_at"], "left_semi")
    return done(kept) if only_done else kept


def latest_by_id(versions: DataFrame) -> DataFrame:
    """label, id: the finished version with the greatest id."""
    return done(versions).groupBy("label").agg(F.max("id").alias("id"))


def one_latest(versions: DataFrame) -> DataFrame:
    """One finished version a label: the last by time, then by id."""
    best = done(versions).groupBy("label").agg(F.max(F.struct("created_at", "id", "version_key")).alias("x"))
    return best.select("label", F.col("x.id").alias("id"), F.col("x.version_key").alias("version_key"))


def latest_by_key(versions: DataFrame) -> DataFrame:
    """label, id, version_key: the finished version with the greatest key."""
    best = done(versions).groupBy("label").agg(F.max(F.struct("version_key", "id")).alias("x"))
    return best.select("label", F.col("x.id").alias("id"), F.col("x.version_key").alias("version_key"))


def page(rows: DataFrame, key: list[str], limit: int, offset: int = 0) -> DataFrame:
    """One page in the order of a key, which a page without order lacks."""
    return rows.orderBy(*key).offset(offset).limit(limit)


def version_sizes(files: DataFrame, contents: DataFrame) -> DataFrame:
    """version_id, n_files, total_size; files without a content count with size 0."""
    sized = files.select("version_id", "sha256").join(contents.select("sha256", "size"), "sha256", "left")
    return sized.groupBy("version_id").agg(F.count(F.lit(1)).alias("n_files"), total(F.coalesce("size", F.lit(0))).alias("total_size"))


def seconds(a: Column, b: Column) -> Column:
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(b) - micros(a)) / F.lit(1e6)


def reclaimable_bytes(versions: DataFrame, files: DataFrame, contents: DataFrame) -> DataFrame:
    """Bytes of contents that no label's latest finished version holds."""
    kept = files.join(latest_by_time(versions).select(F.col("id").alias("version_id")), "version_id", "left_semi").select("sha256")
    return contents.join(kept, "sha256", "left_anti").agg(total("size").alias("reclaimable_bytes"))


def version_stats(versions: DataFrame, files: DataFrame, contents: DataFrame) -> DataFrame:
    sizes = version_sizes(files, contents)
    out = versions.join(sizes, versions["id"] == sizes["version_id"], "left")
    return out.select(
        "id", "label", "version_key", "status", F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("total_size", F.lit(0)).alias("total_size"), seconds(F.col("created_at"), F.col("finished_at")).alias("duration_s")
    )


def visible(labels: DataFrame, user_id: int, role: str) -> DataFrame:
    """Labels that a user may see: all for an administrator, else their own; labels without owner are nobody's."""
    return labels if role == "admin" else labels.where(F.col("owner_user_id") == user_id)


def backup_list(labels: DataFrame, versions: DataFrame, files: DataFrame, contents: DataFrame, users: DataFrame) -> DataFrame:
    counts = versions.groupBy("label").agg(F.count_if(F.col("status") == "done").alias("n_done"), F.bool_or(F.col("status") == "running").alias("running"))
    latest = one_latest(versions)
    sizes = version_sizes(files.join(latest.select(F.col("id").alias("version_id")), "version_id", "left_semi"), contents)
    latest = latest.join(sizes, F.col("id") == F.col("version_id"), "left").select("label", F.col("version_key").alias("latest_key"), "n_files", "total_size")
    owners = users.select(F.col("id").alias("owner_user_id"), F.col("username").alias("owner"))
    out = labels.join(counts, "label", "left").join(latest, "label", "left").join(owners, "owner_user_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return out.select("label", zero("n_done"), "latest_key", zero("n_files"), zero("total_size"), F.coalesce("running", F.lit(False)).alias("has_running"), "owner")


def list_files(files: DataFrame, contents: DataFrame, version_id: int) -> DataFrame:
    found = files.where(F.col("version_id") == version_id).join(contents.select("sha256", "size"), "sha256", "left")
    return found.select("path", "sha256", F.coalesce("size", F.lit(0)).alias("size"), "mtime").orderBy("path")


def differences(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys, path, kind, delta between two sets of (keys, path, sha256, size); a null size is 0."""
    size = lambda c: F.coalesce(c, F.lit(0))
    a = old.select(*keys, "path", F.col("sha256").alias("old_sha"), size("size").alias("old_size"))
    b = new.select(*keys, "path", F.col("sha256").alias("new_sha"), size("size").alias("new_size"))
    kind = F.when(F.col("old_sha").isNull(), "added").when(F.col("new_sha").isNull(), "deleted").when(F.col("old_sha") == F.col("new_sha"), "unchanged").otherwise("modified")
    return a.join(b, [*keys, "path"], "full_outer").select(*keys, "path", kind.alias("kind"), (size("new_size") - size("old_size")).alias("delta"))


def compare_versions(files: DataFrame, contents: DataFrame, first: int, second: int) -> DataFrame:
    side = lambda i: files.where(F.col("version_id") == i).join(contents.select("sha256", "size"), "sha256", "left")
    return differences(side(first), side(second), []).orderBy("path")


def previous_done(versions: DataFrame) -> DataFrame:
    """Finished versions with previous_id, by version key inside the label."""
    return done(versions).withColumn("previous_id", F.lag("id").over(Window.partitionBy("label").orderBy("version_key")))


def change_counts(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """id, added, modified, removed for pairs(id, previous_id); without a previous version all files are added."""
    now = pairs.select("id", F.col("id").alias("version_id")).join(files.select("version_id", "path", "sha256"), "version_id").withColumn("size", F.lit(0))
    before = pairs.where(F.col("previous_id").isNotNull()).select("id", F.col("previous_id").alias("version_id")).join(files.select("version_id", "path", "sha256"), "version_id").withColumn("size", F.lit(0))
    kinds = differences(before, now, ["id"]).groupBy("id").agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in (("added", "added"), ("modified", "modified"), ("deleted", "removed"))])
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return pairs.select("id").join(kinds, "id", "left").select("id", zero("added"), zero("modified"), zero("removed"))
