"""Figures of the statistics and activity pages."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.scalars import trend_class, utc_range
from cairn.operators.catalog import change_counts, done, latest_by_id, latest_by_time, one_latest, previous_done, seconds, total, version_sizes

TREND, RECENT = timedelta(days=30), timedelta(hours=24)
SAMPLES_KEPT = 48
#: The texts of removed versions and of freed megabytes in job summaries, and the jobs that leave them.
REMOVED, FREED = r"(\d+) versão\(ões\) removidas", r"\(([\d.]+) MB\)"
CLEANUPS = ("cleanup-by-date", "auto-cleanup", "cleanup-versions", "nightly-cleanup")


def counts(labels: DataFrame, versions: DataFrame) -> DataFrame:
    found = labels.where(F.col("status") == "active").select("label").join(versions.select("label", "id", "status"), "label", "left")
    out = found.agg(F.countDistinct("label").alias("n_labels"), F.count("id").alias("n_versions"), F.count_if(F.col("status") == "done").alias("n_done"), F.count_if(F.col("status") == "failed").alias("n_failed"))
    ended = F.col("n_done") + F.col("n_failed")
    return out.withColumn("success_rate", F.when(ended > 0, F.col("n_done") * 100.0 / ended).otherwise(100.0))


def average_duration(versions: DataFrame) -> DataFrame:
    taken = done(versions).where(F.col("finished_at").isNotNull()).select(seconds(F.col("created_at"), F.col("finished_at")).cast("bigint").alias("s"))
    return taken.agg((F.sum("s") / F.count("s")).alias("avg_seconds"))


def storage(volumes: DataFrame) -> DataFrame:
    out = volumes.where(~F.col("degraded")).agg(total("total").alias("total"), total("used").alias("used"), total("free").alias("free"))
    return out.withColumn("used_pct", F.when(F.col("total") > 0, F.col("used") * 100.0 / F.col("total")).otherwise(0.0))


def dedup(files: DataFrame, contents: DataFrame) -> DataFrame:
    unique = contents.agg(F.count(F.lit(1)).alias("n_contents"), total("size").alias("stored"))
    refs = files.select("sha256").join(contents.select("sha256", "size"), "sha256").agg(F.count(F.lit(1)).alias("n_refs"), total("size").alias("logical"))
    out = unique.crossJoin(refs)  # one row each
    return out.withColumns({"saved": F.greatest(F.col("logical") - F.col("stored"), F.lit(0)), "ratio": F.when(F.col("stored") > 0, F.col("logical") / F.col("stored")).otherwise(1.0)})


def trend(versions: DataFrame, files: DataFrame, contents: DataFrame, now: datetime, span: timedelta = TREND) -> DataFrame:
    recent = done(versions).where(F.col("created_at") >= F.lit(now - span).cast("timestamp_ntz"))
    sizes = version_sizes(files.join(recent.select(F.col("id").alias("version_id")), "version_id", "left_semi"), contents)
    rows = recent.join(sizes, F.col("id") == F.col("version_id"), "left")
    return rows.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n_versions"), total("total_size").alias("total_size"))


def top_labels(versions: DataFrame, files: DataFrame, contents: DataFrame, n: int = 10) -> DataFrame:
    latest = latest_by_id(versions)
    sizes = version_sizes(files.join(latest.select(F.col("id").alias("version_id")), "version_id", "left_semi"), contents)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return latest.join(sizes, F.col("id") == F.col("version_id"), "left").select("label", zero("n_files"), zero("total_size")).orderBy(F.desc("total_size"), "label").limit(n)


def maintenance_by_type(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("job_type").agg(F.count_if(F.col("status") == "done").alias("n_done"), F.count_if(F.col("status") == "error").alias("n_error"), F.max("started_at").alias("last_run"))


def last_jobs(jobs: DataFrame, n: int = 5) -> DataFrame:
    return jobs.select("id", "job_type", "status", "started_at").orderBy(F.desc("started_at"), F.desc("id")).limit(n)


def cloud_counts(cloud_jobs: DataFrame) -> DataFrame:
    return cloud_jobs.agg(F.count(F.lit(1)).alias("n_jobs"), F.count_if("enabled").alias("n_enabled"))


def label_lifecycle(labels: DataFrame, jobs: DataFrame, now: datetime) -> DataFrame:
    """n_labels made in the last 30 days; n_cleaned and freed_bytes that the summaries of finished cleanups tell, whenever
    they ran.  A summary without one of the two texts counts with the other."""
    new = labels.where(F.col("created_at") >= F.lit(now - TREND).cast("timestamp_ntz")).agg(F.count(F.lit(1)).alias("n_labels"))
    first = lambda rule: F.try_element_at(F.regexp_extract_all(F.col("summary"), F.lit(rule), F.lit(1)), F.lit(1))
    freed = F.floor(F.coalesce(first(FREED).try_cast("double"), F.lit(0.0)) * 1024 * 1024)
    cleaned = jobs.where(F.col("job_type").isin(*CLEANUPS) & (F.col("status") == "done") & F.col("summary").isNotNull())
    return new.crossJoin(cleaned.agg(total(first(REMOVED).cast("bigint")).alias("n_cleaned"), total(freed).alias("freed_bytes")))  # one row each


def label_activity(labels: DataFrame, versions: DataFrame) -> DataFrame:
    found = labels.where(F.col("status") == "active").select("label").join(versions.select("label", "status", "finished_at"), "label", "left")
    is_done = F.col("status") == "done"
    return found.groupBy("label").agg(F.max(F.when(is_done, F.col("finished_at"))).alias("last_done_at"), F.count_if(is_done).alias("n_done")).orderBy(F.asc_nulls_first("last_done_at"), "label")


def reclaimable_by_label(versions: DataFrame, files: DataFrame, contents: DataFrame) -> DataFrame:
    """Bytes that only old finished versions hold, by label; contents shared by labels count in each."""
    keepers = latest_by_id(versions).select(F.col("id").alias("version_id"))
    kept = files.join(keepers, "version_id", "left_semi").select("sha256")
    old = done(versions).select(F.col("id").alias("version_id"), "label").join(keepers, "version_id", "left_anti")
    held = old.join(files.select("version_id", "sha256"), "version_id").select("label", "sha256").distinct()
    sizes = held.join(kept, "sha256", "left_anti").join(contents.select("sha256", "size"), "sha256").groupBy("label").agg(total("size").alias("reclaimable"))
    return sizes.where(F.col("reclaimable") > 0).join(old.groupBy("label").agg(F.count(F.lit(1)).alias("n_old")), "label").orderBy(F.desc("reclaimable"), "label")


def running(versions: DataFrame, files: DataFrame, contents: DataFrame) -> DataFrame:
    """Running versions so far, with the size of the label's latest finished one (null if there is none)."""
    now = versions.where(F.col("status") == "running")
    before = one_latest(versions).select("label", F.col("id").alias("previous"))
    wanted = now.select(F.col("id").alias("version_id")).unionByName(before.select(F.col("previous").alias("version_id"))).distinct()
    sizes = version_sizes(files.join(wanted, "version_id", "left_semi"), contents)
    own, last = sizes.alias("own"), sizes.alias("last")
    out = now.join(before, "label", "left").join(own, F.col("id") == F.col("own.version_id"), "left").join(last, F.col("previous") == F.col("last.version_id"), "left")
    zero = lambda c: F.coalesce(F.col(f"own.{c}"), F.lit(0)).alias(c)
    return out.select("id", "label", zero("n_files"), zero("total_size"), F.col("last.total_size").alias("previous_size"))


def recent_diffs(versions: DataFrame, files: DataFrame, now: datetime, span: timedelta = RECENT, n: int = 30) -> DataFrame:
    """The last versions that ended within the span, with changes against the finished version before; null for those that
    did not finish."""
    ended = versions.where(F.col("status").isin("done", "failed", "incomplete") & (F.col("finished_at") >= F.lit(now - span).cast("timestamp_ntz"))).orderBy(F.desc("finished_at"), F.desc("id")).limit(n)
    pairs = previous_done(versions).join(ended.select("id"), "id", "left_semi").select("id", "previous_id")
    return ended.select("id", "label", "status").join(change_counts(pairs, files), "id", "left")


def recent_jobs(jobs: DataFrame, now: datetime, n: int = 20) -> DataFrame:
    found = jobs.where((F.col("status") == "running") | (F.col("started_at") >= F.lit(now - RECENT).cast("timestamp_ntz")))
    return found.select("id", "job_type", "status", "started_at").orderBy(F.desc("started_at"), F.desc("id")).limit(n)


def daily_digest(versions: DataFrame, files: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """A row a label: finished, failed and other versions of the day, and changes of the finished ones."""
    day = versions.where((F.col("created_at") >= F.lit(start).cast("timestamp_ntz")) & (F.col("created_at") < F.lit(end).cast("timestamp_ntz")))
    pairs = previous_done(versions).join(day.select("id"), "id", "left_semi").select("id", "previous_id")
    rows = day.join(change_counts(pairs, files), "id", "left")
    tally = lambda name, test: F.count_if(test).alias(name)
    status = F.col("status")
    return rows.groupBy("label").agg(tally("n_done", status == "done"), tally("n_failed", status == "failed"), tally("n_other", ~status.isin("done", "failed")), *[total(c).alias(c) for c in ("added", "modified", "removed")])


def digest_totals(versions: DataFrame, files: DataFrame, day: datetime, zone: str = "UTC") -> DataFrame:
    """n_versions, n_labels and changes of a zone's day, over all labels; stored times are of UTC then."""
    edges = versions.sparkSession.range(1).select(*[c.alias(n) for c, n in zip(utc_range(F.lit(day.date()), zone), ("start", "end"), strict=True)])
    found = versions.crossJoin(edges).where((F.col("created_at") >= F.col("start")) & (F.col("created_at") < F.col("end"))).select(*versions.columns)  # one row
    pairs = previous_done(versions).join(found.select("id"), "id", "left_semi").select("id", "previous_id")
    return found.join(change_counts(pairs, files), "id", "left").agg(F.count(F.lit(1)).alias("n_versions"), F.countDistinct("label").alias("n_labels"), *[total(c).alias(c) for c in ("added", "modified", "removed")])


def disk_usage(copies: DataFrame, contents: DataFrame, volumes: DataFrame) -> DataFrame:
    held = copies.join(contents.select("sha256", "size"), "sha256").groupBy("volume_path").agg(F.count(F.lit(1)).alias("n_copies"), total("size").alias("n_bytes"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return volumes.join(held, F.col("path") == F.col("volume_path"), "left").select("path", zero("n_copies"), zero("n_bytes"), F.when(F.col("degraded"), "degraded").otherwise("ok").alias("status"))


def kept_samples(samples: DataFrame, n: int = SAMPLES_KEPT) -> DataFrame:
    newest = Window.partitionBy("volume_path").orderBy(F.desc("sampled_at"), F.desc("id"))
    return samples.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= n).drop("rn")


def throttled(samples: DataFrame, gap: timedelta = timedelta(minutes=30)) -> DataFrame:
    """Samples taken when the last one kept of the volume is at least `gap` old.  A sample at least `gap` after the one
    before it is kept whatever came earlier, so a volume falls apart into stretches that are folded by themselves; within
    one each kept sample decides the next.  Rows arrive sorted, and only the last kept time is held."""
    import pandas as pd

    least = gap.total_seconds()

    def fold(batches):
        stretch, last = None, None
        for pdf in batches:
            keep = []
            for v, t in zip(zip(pdf["volume_path"], pdf["stretch"], strict=True), pdf["sampled_at"], strict=True):
                take = v != stretch or (t - last).total_seconds() >= least
                stretch, last = v, (t if take else last)
                keep.append(take)
            yield pdf[pd.Series(keep, index=pdf.index, dtype=bool)].drop(columns="stretch")

    order = Window.partitionBy("volume_path").orderBy("sampled_at", "id")
    micros = F.unix_micros(F.col("sampled_at").cast("timestamp"))
    apart = F.coalesce(micros - F.lag(micros).over(order) >= int(least * 1e6), F.lit(True))
    marked = samples.withColumn("apart", apart.cast("int")).withColumn("stretch", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("apart")
    ordered = marked.repartition("volume_path", "stretch").sortWithinPartitions("volume_path", "stretch", "sampled_at", "id")
    return ordered.mapInPandas(fold, samples.schema)


def disk_trends(samples: DataFrame) -> DataFrame:
    """volume_path, n, first, last, least, most, change, class over the samples kept of each volume; no class for one."""
    time = F.struct("sampled_at", "id")
    out = kept_samples(samples).groupBy("volume_path").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("used_pct", time).alias("first"), F.max_by("used_pct", time).alias("last"), F.min("used_pct").alias("least"), F.max("used_pct").alias("most")
    )
    change = F.col("last") - F.col("first")
    return out.withColumns({"change": change, "class": F.when(F.col("n") > 1, trend_class(change))})


def types_by_runs(jobs: DataFrame) -> DataFrame:
    """maintenance_by_type in the order of the page: most runs that ended first."""
    runs = F.col("n_done") + F.col("n_error")
    return maintenance_by_type(jobs).withColumn("place", F.row_number().over(Window.orderBy(F.desc(runs), "job_type")))  # a row a type


def labels_by_count(labels: DataFrame, versions: DataFrame) -> DataFrame:
    """label_activity in the order of finished versions, most first."""
    return label_activity(labels, versions).orderBy(F.desc("n_done"), "label")


def label_disks(versions: DataFrame, files: DataFrame, copies: DataFrame, contents: DataFrame) -> DataFrame:
    """label, volume_path, n_contents, n_bytes of the latest finished versions (ties included), contents once a version."""
    latest = latest_by_time(versions, only_done=True).select(F.col("id").alias("version_id"), "label")
    held = latest.join(files.select("version_id", "sha256"), "version_id").select("label", "version_id", "sha256").distinct()
    found = held.join(copies.select("sha256", "volume_path"), "sha256").join(contents.select("sha256", "size"), "sha256")
    return found.groupBy("label", "volume_path").agg(F.count(F.lit(1)).alias("n_contents"), total("size").alias("n_bytes"))
