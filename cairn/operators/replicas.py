"""Copies of contents on volumes: too few, too many, where to put them, moving a disk, the cache disk."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.catalog import total

FREE_LIMIT = 10 * 1024**3


def target_copies(volumes: DataFrame, factor: int) -> DataFrame:
    """One row: the copies a content should have (0: one on every volume), at most the healthy volumes, at least 1."""
    healthy = F.greatest(F.lit(1), F.count_if(~F.col("degraded")))
    return volumes.agg(F.least(F.lit(factor) if factor else F.count(F.lit(1)), healthy).cast("bigint").alias("target"))


def copy_counts(contents: DataFrame, copies: DataFrame) -> DataFrame:
    """sha256, n_copies, those on degraded volumes included, 0 without any."""
    held = copies.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"))
    return contents.select("sha256").join(held, "sha256", "left").select("sha256", F.coalesce("n", F.lit(0)).alias("n_copies"))


def deficit(contents: DataFrame, copies: DataFrame, volumes: DataFrame, factor: int) -> DataFrame:
    """Contents below the target and the first copy on a healthy volume to copy from (null: skipped)."""
    few = copy_counts(contents, copies).crossJoin(target_copies(volumes, factor)).where(F.col("n_copies") < F.col("target"))
    healthy = volumes.where(~F.col("degraded")).select(F.col("path").alias("volume_path"))
    source = copies.join(healthy, "volume_path").groupBy("sha256").agg(F.min_by("volume_path", "id").alias("source"))
    return few.join(source, "sha256", "left")


def placement(contents: DataFrame, copies: DataFrame, volumes: DataFrame, factor: int) -> DataFrame:
    """sha256, volume_path of the copies to make: healthy volumes without one, in declared order.  The healthy volumes are
    one list; what a content holds is taken out of it, and as many as it wants are left."""
    few = deficit(contents, copies, volumes, factor).where(F.col("source").isNotNull())
    healthy = volumes.where(~F.col("degraded")).agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "path"))), lambda x: x["path"]).alias("healthy"))
    held = copies.join(few.select("sha256"), "sha256", "left_semi").groupBy("sha256").agg(F.collect_set("volume_path").alias("held"))
    rows = few.join(held, "sha256", "left").crossJoin(healthy)  # one row
    free = F.array_except("healthy", F.coalesce("held", F.array().cast("array<string>")))
    return rows.select("sha256", F.explode(F.slice(free, F.lit(1), (F.col("target") - F.col("n_copies")).cast("int"))).alias("volume_path"))


def excess(contents: DataFrame, copies: DataFrame, volumes: DataFrame, factor: int) -> DataFrame:
    """Copies beyond the target with the path that becomes primary: the primary first, then healthy ones, then by id."""
    state = volumes.select(F.col("path").alias("volume_path"), (~F.col("degraded")).alias("healthy"))
    rows = copies.select("id", "sha256", "volume_path", "stored_at").join(contents.select("sha256", F.col("stored_at").alias("primary")), "sha256").join(state, "volume_path", "left")
    order = Window.partitionBy("sha256").orderBy(F.desc(F.col("stored_at") == F.col("primary")), F.desc("healthy"), "id")
    ranked = rows.withColumns({"rn": F.row_number().over(order), "new_primary": F.first("stored_at").over(order)})
    return ranked.crossJoin(target_copies(volumes, factor)).where(F.col("rn") > F.col("target")).select("id", "sha256", "volume_path", "new_primary")


def for_volume(contents: DataFrame, copies: DataFrame, volumes: DataFrame, factor: int, volume: str) -> DataFrame:
    there = copies.where(F.col("volume_path") == volume).select("sha256")
    return deficit(contents, copies, volumes, factor).join(there, "sha256", "left_anti").select("sha256", "n_copies", "source")


def missing_copy_rows(contents: DataFrame, copies: DataFrame) -> DataFrame:
    """Contents without a copy row, and the volume that their stored path names: its third parent folder."""
    parts = F.split("stored_at", "/")
    volume = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 3), "/")
    return contents.join(copies.select("sha256"), "sha256", "left_anti").select("sha256", "stored_at", volume.alias("volume_path"))


def pick_volume(volumes: DataFrame, limit: int) -> DataFrame:
    """The first declared healthy volume with more than `limit` free, else the one with most free."""
    healthy = volumes.where(~F.col("degraded"))
    first = F.min_by("path", F.when(F.col("free") > limit, F.col("ord")))
    return healthy.agg(F.coalesce(first, F.max_by("path", F.struct("free", -F.col("ord")))).alias("volume_path"))


def pending_budget(pending: DataFrame, contents: DataFrame, cap: int) -> DataFrame:
    """Bytes waiting on the cache disk and whether the cap still takes more."""
    out = pending.join(contents.select("sha256", "size"), "sha256").agg(total("size").alias("pending_bytes"))
    return out.withColumn("accepts", F.col("pending_bytes") < cap)


def stuck_on_cache(copies: DataFrame, pending: DataFrame, cache: str) -> DataFrame:
    """Contents on the cache disk without a pending move; orphan: no other copy exists."""
    here = copies.where(F.col("volume_path") == cache).select("sha256").join(pending.select("sha256"), "sha256", "left_anti")
    other = copies.where(F.col("volume_path") != cache).select("sha256").distinct().withColumn("other", F.lit(True))
    return here.join(other, "sha256", "left").select("sha256", F.when(F.col("other"), "redundant").otherwise("only_copy").alias("kind"))


def migration_preview(copies: DataFrame, contents: DataFrame, volumes: DataFrame, source: str, targets: list[str]) -> DataFrame:
    here = copies.where(F.col("volume_path") == source).select("sha256").distinct()
    there = copies.where(F.col("volume_path").isin(targets)).select("sha256").distinct().withColumn("there", F.lit(True))
    rows = here.join(there, "sha256", "left").join(contents.select("sha256", "size"), "sha256")
    moved = rows.agg(F.count_if(F.col("there").isNull()).alias("n_copy"), total(F.when(F.col("there").isNull(), F.col("size"))).alias("copy_bytes"), F.count_if(F.col("there").isNotNull()).alias("n_there"))
    room = volumes.where(F.col("path").isin(targets) & ~F.col("degraded")).agg(total("free").alias("free"))
    return moved.crossJoin(room).withColumn("feasible", F.col("free") >= F.col("copy_bytes"))  # one row each


def migration_plan(copies: DataFrame, contents: DataFrame, free: dict[str, int], source: str) -> DataFrame:
    """sha256, size, action, volume_path, new_primary of contents with a copy on the source or their primary there.

    action: "there" if a target holds a copy, else "copy" to volume_path, the target with most room left (of equal
    ones the first named), in the order of the source's copies, or "skip" if no target has room at all; null if only
    the primary is on the source.  As room is an estimate, a content need not fit into it: what is left is then 0.
    new_primary replaces a primary on the source: the copy elsewhere with the least id, else the new copy, else null.

    Each choice depends on all before it, so one task folds the contents that no target holds, sorted and streamed;
    only the room left is held.
    """
    names = list(free)
    here = copies.where(F.col("volume_path") == source).groupBy("sha256").agg(F.min("id").alias("id"))
    there = copies.where(F.col("volume_path").isin(names)).select("sha256").distinct()
    sized = here.join(there, "sha256", "left_anti").join(contents.select("sha256", "size"), "sha256")
    ordered = sized.repartition(1).sortWithinPartitions("id")

    def fold(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        room = dict(free)
        for pdf in batches:
            chosen = []
            for size in pdf["size"]:
                best = max(names, key=room.__getitem__) if names else None
                if best is not None and room[best] <= 0:
                    best = None
                if best is not None:
                    room[best] = max(0, room[best] - size)
                chosen.append(best)
            yield pdf[["sha256"]].assign(volume_path=pd.Series(chosen, index=pdf.index, dtype=object))

    dealt = ordered.mapInPandas(fold, "sha256 string, volume_path string").withColumn("action", F.when(F.col("volume_path").isNull(), "skip").otherwise("copy"))
    held = here.join(there, "sha256", "left_semi").select("sha256", F.lit(None).cast("string").alias("volume_path"), F.lit("there").alias("action"))
    stale = F.startswith("primary", F.lit(source.rstrip("/") + "/"))
    primaries = contents.select("sha256", "size", F.col("stored_at").alias("primary"))
    elsewhere = copies.where(F.col("volume_path") != source).groupBy("sha256").agg(F.min_by("stored_at", "id").alias("alternative"))
    fresh = F.when(F.col("action") == "copy", F.concat_ws("/", "volume_path", F.lit("_content"), F.substring("sha256", 1, 2), "sha256"))
    rows = primaries.join(dealt.unionByName(held), "sha256", "left").where(F.col("action").isNotNull() | stale).join(elsewhere, "sha256", "left")
    return rows.select("sha256", "size", "action", "volume_path", F.when(stale, F.coalesce("alternative", fresh)).alias("new_primary"))


def unencrypted(contents: DataFrame, copies: DataFrame, volumes: DataFrame) -> DataFrame:
    """Contents still in the clear with their copies on healthy volumes."""
    healthy = volumes.where(~F.col("degraded")).select(F.col("path").alias("volume_path"))
    reach = copies.join(healthy, "volume_path").groupBy("sha256").agg(F.count(F.lit(1)).alias("n"))
    return contents.where(~F.col("encrypted")).select("sha256", "size").join(reach, "sha256", "left").select("sha256", "size", F.coalesce("n", F.lit(0)).alias("n_reachable"))


def download_candidates(files: DataFrame, copies: DataFrame, contents: DataFrame, volumes: DataFrame, version_id: int) -> DataFrame:
    """A row a file: the healthy copies in the order in which they are tried, their number, the first, and what a reader is
    told if there is none."""
    state = volumes.select(F.col("path").alias("volume_path"), "degraded")
    healthy = F.when(~F.col("degraded"), F.struct("id", "stored_at"))
    held = copies.join(state, "volume_path").groupBy("sha256").agg(F.count_if("degraded").alias("n_degraded"), F.transform(F.sort_array(F.collect_list(healthy)), lambda x: x["stored_at"]).alias("tried"))
    found = files.where(F.col("version_id") == version_id).join(held, "sha256", "left")
    found = found.select("path", "sha256", F.coalesce("n_degraded", F.lit(0)).alias("n_degraded"), F.coalesce("tried", F.array().cast("array<string>")).alias("tried"))
    answer = F.when(F.size("tried") > 0, 200).when(F.col("n_degraded") > 0, 503).otherwise(410).cast("bigint")
    return found.select("path", "sha256", F.size("tried").cast("bigint").alias("n_healthy"), F.get("tried", F.lit(0)).alias("first"), F.concat_ws(",", "tried").alias("candidates"), answer.alias("answer"))


def file_access(files: DataFrame, versions: DataFrame, labels: DataFrame, users: DataFrame) -> DataFrame:
    """id, label, owner_user_id, user_id for every file and user who may read it: its label's owner, and administrators."""
    owned = files.select("id", "version_id").join(versions.select(F.col("id").alias("version_id"), "label"), "version_id").join(labels.select("label", "owner_user_id"), "label")
    own = owned.select("id", "label", "owner_user_id", F.col("owner_user_id").alias("user_id")).join(users.where(F.col("role") != "admin").select(F.col("id").alias("user_id")), "user_id", "left_semi")
    admins = users.where(F.col("role") == "admin").select(F.col("id").alias("user_id"))
    return own.unionByName(owned.select("id", "label", "owner_user_id").crossJoin(admins).select(own.columns))  # administrators are few
