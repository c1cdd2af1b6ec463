"""What maintenance would delete, keep or mark: retention, stale and orphaned state, integrity, state changes."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.catalog import done, latest_by_id, latest_by_time, total

#: Edges of the retention tiers, and the time without activity after which a running version is stale.
EDGES = (timedelta(hours=24), timedelta(days=30), timedelta(days=180))
STALE = timedelta(hours=6)
#: Steps that are added up together in a running total.
STEPS = 1 << 16


def at(moment: datetime) -> Column:
    return F.lit(moment).cast("timestamp_ntz")


def orphan_contents(files: DataFrame, contents: DataFrame) -> DataFrame:
    return contents.join(files.select("sha256"), "sha256", "left_anti")


def beyond_newest(versions: DataFrame, keep: int) -> DataFrame:
    newest = Window.partitionBy("label").orderBy(F.desc("version_key"))
    return versions.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") > keep).drop("rn")


def before_date(versions: DataFrame, cutoff: datetime, label: str | None = None) -> DataFrame:
    """Versions before the cutoff but running ones and their label's last finished one."""
    found = versions.where((F.col("created_at") < at(cutoff)) & (F.col("status") != "running"))
    found = found.where(F.col("label") == label) if label is not None else found
    return found.join(latest_by_id(versions).select("id"), "id", "left_anti")


def retention(versions: DataFrame, now: datetime) -> DataFrame:
    """Finished versions with tier and keep: all of a day, then the newest a day, an ISO week and a month."""
    edge = [at(now - e) for e in EDGES]
    made = F.col("created_at")
    tier = F.when(made >= edge[0], "all").when(made >= edge[1], "day").when(made >= edge[2], "week").otherwise("month")
    bucket = (
        F.when(F.col("tier") == "all", F.col("id").cast("string"))
        .when(F.col("tier") == "day", F.date_format(made, "yyyy-MM-dd"))
        .when(F.col("tier") == "week", F.concat_ws("-", F.extract(F.lit("YEAROFWEEK"), made).cast("string"), F.weekofyear(made).cast("string")))
        .otherwise(F.date_format(made, "yyyy-MM"))
    )
    tiers = done(versions).withColumn("tier", tier).withColumn("bucket", bucket)
    newest = Window.partitionBy("label", "tier", "bucket").orderBy(F.desc("created_at"), F.desc("id"))
    return tiers.withColumn("keep", F.row_number().over(newest) == 1).drop("bucket")


def retention_counts(versions: DataFrame, now: datetime) -> DataFrame:
    """label, tier, n_kept, n_deleted of the retention."""
    return retention(versions, now).groupBy("label", "tier").agg(F.count_if("keep").alias("n_kept"), F.count_if(~F.col("keep")).alias("n_deleted"))


def previewed(versions: DataFrame, cutoff: datetime) -> DataFrame:
    """n_labels, n_versions that a cleanup by date would delete."""
    return before_date(versions, cutoff).agg(F.countDistinct("label").alias("n_labels"), F.count(F.lit(1)).alias("n_versions"))


def overtaken(versions: DataFrame) -> DataFrame:
    """Failed and incomplete versions with a newer finished one of their label."""
    newer = done(versions).groupBy("label").agg(F.max("created_at").alias("newest"))
    return versions.where(F.col("status").isin("failed", "incomplete")).join(newer, "label").where(F.col("newest") > F.col("created_at")).drop("newest")


def inactive(versions: DataFrame, files: DataFrame, now: datetime, span: timedelta = STALE) -> DataFrame:
    last = files.groupBy(F.col("version_id").alias("id")).agg(F.max("created_at").alias("active_at"))
    found = versions.where(F.col("status") == "running").join(last, "id", "left")
    return found.where(F.coalesce("active_at", "created_at") < at(now - span)).drop("active_at")


def damage(versions: DataFrame, files: DataFrame, present: DataFrame) -> DataFrame:
    """Finished versions, latest or not, that hold a content which a latest one holds and `present` (sha256) lacks."""
    latest = latest_by_time(versions, only_done=True).select(F.col("id").alias("version_id"))
    missing = files.join(latest, "version_id", "left_semi").select("sha256").distinct().join(present, "sha256", "left_anti")
    hit = files.join(missing, "sha256").groupBy(F.col("version_id").alias("id")).agg(F.countDistinct("sha256").alias("n_missing"))
    return done(versions).join(hit, "id").select("id", "label", "n_missing")


def running_total(rows: DataFrame, groups: list[str], part: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """The rows with the running total of a value in the order, in each group.  `part` rises with the order and has few
    values: their totals are summed up first, then each part adds up its own rows by itself."""
    rows = rows.withColumn("part", part)
    upto = Window.partitionBy(*groups).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*groups, "part").agg(F.sum(value).alias("of_part")).select(*groups, "part", F.coalesce(F.sum("of_part").over(upto), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*groups, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("own", F.sum(value).over(inside)).join(parts, [*groups, "part"]).withColumn(name, (F.col("before") + F.col("own")).cast("bigint")).drop("part", "own", "before")


def cleanup_plan(versions: DataFrame, files: DataFrame, contents: DataFrame, copies: DataFrame, volumes: DataFrame, factor: int, threshold: int) -> DataFrame:
    """Versions in the order of deletion until `factor` healthy volumes have `threshold` bytes free: step, id, n_ready.

    If they have at the start, there is nothing to do.  Step 0 deletes all incomplete and failed versions; then
    finished ones go one at a time by age, but for the last of their label by time.  A content goes with the last
    version that holds it, or at once if no version does, from all volumes that have it.  n_ready are the volumes
    that are ready after the step.
    """
    stale = versions.where(F.col("status").isin("failed", "incomplete")).select("id", F.lit(0).cast("bigint").alias("step"))
    ranked = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("created_at"), F.desc("id")))
    old = done(versions).withColumn("rn", ranked).where(F.col("rn") > 1).select("id", "created_at", F.lit(0).alias("group"))
    old = running_total(old, ["group"], F.to_date("created_at"), ["created_at", "id"], F.lit(1), "step").select("id", "step")
    steps = stale.unionByName(old)
    held = files.select(F.col("version_id").alias("id"), "sha256").distinct().join(steps, "id", "left")
    last = held.groupBy("sha256").agg(F.max("step").alias("step"), F.count_if(F.col("step").isNull()).alias("kept"))
    going = contents.select("sha256", "size").join(last, "sha256", "left").where(F.coalesce("kept", F.lit(0)) == 0).select("sha256", "size", F.coalesce("step", F.lit(0)).alias("step"))
    freed = going.join(copies.select("sha256", "volume_path"), "sha256").groupBy("volume_path", "step").agg(F.sum("size").alias("freed"))
    room = running_total(freed, ["volume_path"], F.floor(F.col("step") / STEPS), ["step"], F.col("freed"), "upto")
    # each healthy volume's first step with enough room (-1: from the start; null: never); volumes are few
    healthy = volumes.where(~F.col("degraded")).select(F.col("path").alias("volume_path"), "free")
    enough = F.min(F.when(F.col("free") + F.col("upto") >= threshold, F.col("step")))
    ready = healthy.join(room, "volume_path", "left").groupBy("volume_path").agg(F.when(F.first("free") >= threshold, F.lit(-1).cast("bigint")).otherwise(enough).alias("at"))
    ready = ready.agg(F.sort_array(F.collect_list("at")).alias("ready"))  # one row
    end = F.coalesce(F.get("ready", F.lit(factor - 1)), F.lit(2**62))
    plan = steps.crossJoin(ready).where((end >= 0) & (F.col("step") <= end))
    return plan.select("step", "id", F.size(F.filter("ready", lambda at: at <= F.col("step"))).cast("bigint").alias("n_ready"))


def beyond_rotation(names: DataFrame, keep: int = 7) -> DataFrame:
    """Export files after the `keep` greatest names of their folder: names(folder, name)."""
    return names.withColumn("rn", F.row_number().over(Window.partitionBy("folder").orderBy(F.desc("name")))).where(F.col("rn") > keep).drop("rn")


def old_temporaries(files: DataFrame, cutoff: datetime, prefixes: tuple[str, ...]) -> DataFrame:
    """Number and bytes of files(name, size, modified) that begin with a prefix and are older than the cutoff."""
    match = F.lit(False)
    for p in prefixes:
        match = match | F.startswith("name", F.lit(p))
    return files.where(match & (F.col("modified") < at(cutoff))).agg(F.count(F.lit(1)).alias("n_files"), total("size").alias("n_bytes"))


def prefix_counts(tables: dict[str, tuple[DataFrame, str]], old: str, new: str) -> DataFrame:
    """name, n_rows, n_moved, n_new (rows already under the new folder) for each table's path column."""
    out = None
    for name, (rows, column) in tables.items():
        under = lambda folder, c=column: (F.col(c) == folder) | F.startswith(c, F.lit(folder.rstrip("/") + "/"))
        counts = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(under(old)).alias("n_moved"), F.count_if(under(new)).alias("n_new")).select(F.lit(name).alias("name"), "*")
        out = counts if out is None else out.unionByName(counts)
    return out


def moved_paths(rows: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """Paths under the folder `old` put under `new`; a sibling that only shares the prefix stays."""
    under = (F.col(column) == old) | F.startswith(column, F.lit(old.rstrip("/") + "/"))
    return rows.withColumns({"moved": under, column: F.when(under, F.concat(F.lit(new), F.substr(F.col(column), F.lit(len(old) + 1)))).otherwise(F.col(column))})


# state changes: a table in, the new table out


def with_status(versions: DataFrame, test: Column, status: str) -> DataFrame:
    return versions.withColumn("status", F.when(test, status).otherwise(F.col("status")))


def rename_label(versions: DataFrame, old: str, new: str) -> DataFrame:
    if not new.strip() or new.strip() == old:
        raise ValueError("the new label is empty or the old one")
    return versions.withColumn("label", F.when(F.col("label") == old, new.strip()).otherwise(F.col("label")))


def with_owner(labels: DataFrame, label: str, owner: int) -> DataFrame:
    return labels.withColumn("owner_user_id", F.when(F.col("label") == label, F.lit(owner)).otherwise(F.col("owner_user_id")).cast("bigint"))


def owners_filled(labels: DataFrame, owner: int) -> DataFrame:
    return labels.withColumn("owner_user_id", F.coalesce("owner_user_id", F.lit(owner)).cast("bigint"))


def without_label(versions: DataFrame, files: DataFrame, label: str) -> DataFrame:
    """Files that remain when a label's versions go."""
    gone = versions.where(F.col("label") == label).select(F.col("id").alias("version_id"))
    return files.join(gone, "version_id", "left_anti")


def with_new_version(versions: DataFrame, label: str, key: str, now: datetime) -> DataFrame:
    """A running version more; running ones of the label become incomplete.  Identifiers continue the greatest."""
    fresh = versions.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id")).select(
        "id", F.lit(label).alias("label"), F.lit(key).alias("version_key"), at(now).alias("created_at"), F.lit("running").alias("status"), F.lit(None).cast("timestamp_ntz").alias("finished_at")
    )
    return with_status(versions, (F.col("label") == label) & (F.col("status") == "running"), "incomplete").select(fresh.columns).unionByName(fresh)


def finished(versions: DataFrame, version_id: int, status: str, now: datetime) -> DataFrame:
    if status not in ("done", "failed"):
        raise ValueError("a version ends as done or failed")
    this = F.col("id") == version_id
    return with_status(versions, this, status).withColumn("finished_at", F.when(this, at(now)).otherwise(F.col("finished_at")))
