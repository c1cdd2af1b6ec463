"""The cache disk: copies without a waiting move, and rounds of the queue that moves contents to their volume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.scalars import content_path

ROUND, RETRIES = 10, 5


def on_cache(copies: DataFrame, pending: DataFrame, cache: str) -> DataFrame:
    """id, sha256, stored_at of the cache's copies without a waiting move, and another copy's path (of the least id)."""
    here = copies.where(F.col("volume_path") == cache).join(pending.select("sha256"), "sha256", "left_anti").select("id", "sha256", "stored_at")
    other = copies.where(F.col("volume_path") != cache).groupBy("sha256").agg(F.min_by("stored_at", "id").alias("fallback"))
    return here.join(other, "sha256", "left")


def stuck(copies: DataFrame, pending: DataFrame, contents: DataFrame, exists: DataFrame, cache: str, volume: str | None) -> DataFrame:
    """Moves to make for contents that are on the cache only: sha256, ssd_path, dest_volume, dest_path.  exists(stored_at)
    names the files that are there; a content whose primary is another file that is there needs none.  Without a
    volume to take them there are none."""
    rows = on_cache(copies, pending, cache).where(F.col("fallback").isNull()).join(exists.select("stored_at"), "stored_at", "left_semi")
    there = exists.select(F.col("stored_at").alias("primary"), F.lit(True).alias("primary_there"))
    rows = rows.join(contents.select("sha256", F.col("stored_at").alias("primary")), "sha256", "left").join(there, "primary", "left")
    elsewhere = F.coalesce((F.col("primary") != F.col("stored_at")) & F.col("primary_there"), F.lit(False))
    rows = rows.where(~elsewhere & F.lit(volume is not None))
    return rows.select("sha256", F.col("stored_at").alias("ssd_path"), F.lit(volume).alias("dest_volume"), content_path(F.lit(volume), F.col("sha256")).alias("dest_path"))


def orphans(copies: DataFrame, pending: DataFrame, contents: DataFrame, exists: DataFrame, cache: str) -> DataFrame:
    """id, sha256, action, new_primary of the cache's copies without a waiting move: "redundant" ones go, and a primary that
    names them takes the other copy's path; "missing" ones go, as their file is not there; others are "kept"."""
    there = exists.select("stored_at", F.lit(True).alias("there"))
    rows = on_cache(copies, pending, cache).join(there, "stored_at", "left").join(contents.select("sha256", F.col("stored_at").alias("primary")), "sha256", "left")
    action = F.when(F.col("fallback").isNotNull(), "redundant").when(F.col("there").isNull(), "missing").otherwise("kept")
    return rows.select("id", "sha256", action.alias("action"), F.when(F.col("primary") == F.col("stored_at"), F.col("fallback")).alias("new_primary"))


def move_round(queue: DataFrame, outcomes: DataFrame, files: DataFrame, limit: int = ROUND, retries: int = RETRIES) -> DataFrame:
    """One round of queue(sha256, ssd_path, dest_volume, dest_path, retry_count), the first `limit` by sha256, with
    outcomes(sha256, outcome, other_volume): "moved", "absent" (not on the cache), "full" (with another volume: sent
    there and tried at once, and moved), "failed" or "corrupt".

    sha256, action, retry_count, dest_volume, dest_path, n_versions: moves that are done or absent leave the queue;
    a failure waits, or at its fifth is given up, which fails the versions that hold the content (n_versions).
    """
    first = queue.orderBy("sha256").limit(limit)
    rows = first.join(outcomes, "sha256", "left")
    sent = (F.col("outcome") == "full") & F.col("other_volume").isNotNull() & (F.col("other_volume") != F.col("dest_volume"))
    failed = F.col("outcome").isin("failed", "corrupt") | ((F.col("outcome") == "full") & ~F.coalesce(sent, F.lit(False)))
    count = F.when(sent, 0).otherwise(F.col("retry_count") + F.when(failed, 1).otherwise(0))
    action: Column = F.when((F.col("outcome") == "moved") | sent, "moved").when(F.col("outcome") == "absent", "dropped").when(failed & (count >= retries), "abandoned").when(failed, "waiting").otherwise("waiting")
    rows = rows.select("sha256", action.alias("action"), count.cast("bigint").alias("retry_count"), F.when(sent, F.col("other_volume")).otherwise(F.col("dest_volume")).alias("dest_volume"))
    held = files.join(rows.where(F.col("action") == "abandoned").select("sha256"), "sha256", "left_semi").groupBy("sha256").agg(F.countDistinct("version_id").alias("n"))
    rows = rows.join(held, "sha256", "left")
    return rows.select("sha256", "action", "retry_count", "dest_volume", content_path(F.col("dest_volume"), F.col("sha256")).alias("dest_path"), F.coalesce("n", F.lit(0)).alias("n_versions"))


def queue_after(queue: DataFrame, done: DataFrame) -> DataFrame:
    """The queue after a round: what it did not touch, and what waits, with new counts."""
    waiting = done.where(F.col("action") == "waiting").select("sha256", "retry_count", "dest_volume", "dest_path")
    return queue.join(done.select("sha256"), "sha256", "left_anti").select("sha256", "retry_count", "dest_volume", "dest_path").unionByName(waiting)


def failed_versions(versions: DataFrame, files: DataFrame, done: DataFrame) -> DataFrame:
    """Versions with those failed that hold a content whose move was given up."""
    hit = files.join(done.where(F.col("action") == "abandoned").select("sha256"), "sha256", "left_semi").select(F.col("version_id").alias("id"), F.lit(True).alias("hit")).distinct()
    return versions.join(hit, "id", "left").withColumn("status", F.when(F.col("hit"), "failed").otherwise(F.col("status"))).drop("hit")
