"""Resumable directory walks and event windows as streams."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairn.functions import scalars as X

LISTING = "version_id bigint, directory string, Path string, Size bigint, ModTime string, IsDir boolean, failed boolean"
FILE = "version_id bigint, path string, size bigint, mtime string, directory string, bucket int"
MAX_RESUMES = 3
#: Parts of the sink, by directory: a batch of a few directories reads and writes only theirs.
BUCKETS = 256
#: How long a stream waits for more before it writes what it has.
IDLE = "5 seconds"


def listings(spark: SparkSession, folder: str, files_a_batch: int = 16) -> DataFrame:
    """Listing files (JSON lines, one file a directory or more) as a stream; the file limit is the backpressure."""
    return spark.readStream.schema(LISTING).option("maxFilesPerTrigger", files_a_batch).json(folder)


def register_stream(listing: DataFrame, sink: str, checkpoint: str, retry: str | None = None, idle: str | None = None) -> StreamingQuery:
    """Append files of the listing to a table, each path of a version once: within a batch by the last time, across
    batches by an anti-join with what the sink holds of the same parts, so that a batch delivered again adds nothing.
    Directories whose listing failed are written to `retry`, for the next run, and none of their files is registered.

    Without `idle` the stream ends when it has read all there is, else it runs on and writes each time it has waited so
    long (IDLE is the usual time).
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bad = batch.where("failed").select("version_id", "directory").distinct()
        if retry:
            bad.write.mode("append").parquet(retry)
        good = batch.where(~F.coalesce("IsDir", F.lit(False))).join(bad, ["version_id", "directory"], "left_anti")
        last = F.max_by(F.struct(F.col("Size").alias("size"), F.col("ModTime").alias("mtime"), "directory"), "ModTime").alias("x")
        new = good.groupBy("version_id", F.col("Path").alias("path")).agg(last).select("version_id", "path", "x.*")
        new = new.withColumn("bucket", F.pmod(F.xxhash64("version_id", "directory"), F.lit(BUCKETS)).cast("int"))
        try:
            held = spark.read.schema(FILE).parquet(sink)
            parts = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # BUCKETS at most
            new = new.join(held.where(F.col("bucket").isin(parts)).select("version_id", "path"), ["version_id", "path"], "left_anti")
        except AnalysisException as e:  # the sink does not exist before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
        new.write.mode("append").partitionBy("bucket").parquet(sink)

    writer = listing.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=idle) if idle else writer.trigger(availableNow=True)).start()


def pending_directories(expected: DataFrame, done: DataFrame, failed: DataFrame) -> DataFrame:
    """directory, again: what a next run lists: directories that were found and are not done, those that failed marked."""
    bad = failed.select("directory", F.lit(True).alias("again")).distinct()
    return expected.select("directory").union(failed.select("directory")).distinct().join(done.select("directory"), "directory", "left_anti").join(bad, "directory", "left").select("directory", F.coalesce("again", F.lit(False)).alias("again"))


def walk_progress(expected: DataFrame, registered: DataFrame, failed: DataFrame) -> DataFrame:
    """directory, n_files, n_registered, state: done when all files of the listing are registered, failed directories
    wait for the next run.  expected(directory, path), registered(path), failed(directory)."""
    rows = expected.join(registered.select("path", F.lit(1).alias("ok")).distinct(), "path", "left")
    counts = rows.groupBy("directory").agg(F.count("path").alias("n_files"), F.count("ok").alias("n_registered"))
    bad = failed.select("directory", F.lit(True).alias("bad")).distinct()
    state = F.when(F.col("bad"), "retry").when(F.col("n_files") == F.col("n_registered"), "done").otherwise("pending")
    return counts.join(bad, "directory", "left").select("directory", "n_files", "n_registered", state.alias("state"))


def resume_decision(versions: DataFrame) -> DataFrame:
    """label, id, action, resume_count, n_done, n_found of the version that a label's next walk takes up: of those that did
    not finish (running ones count as incomplete by then) and have a checkpoint, the one with the greatest key.

    It is resumed, which counts, while its resumes are few, else abandoned for a new version.  n_done are directories
    that are done, n_found those and the pending ones together (the root, if none is pending).
    versions(id, label, version_key, status, progress_json).
    """
    open_ = versions.where(F.col("status").isin("incomplete", "failed", "running") & F.col("progress_json").isNotNull())
    newest = open_.groupBy("label").agg(F.max_by(F.struct("id", "progress_json"), F.struct("version_key", "id")).alias("x"))
    found = newest.select("label", "x.id", X.checkpoint(F.col("x.progress_json")).alias("at"))
    resumed = F.col("at.resume_count") < MAX_RESUMES
    pending = F.when(F.size("at.pending_dirs") > 0, F.col("at.pending_dirs")).otherwise(F.array(F.lit("")))
    return found.select(
        "label", "id", F.when(resumed, "resume").otherwise("abandon").alias("action"), F.when(resumed, F.col("at.resume_count") + 1).otherwise(0).alias("resume_count"),
        F.when(resumed, F.size(F.array_distinct("at.done_dirs"))).otherwise(0).cast("bigint").alias("n_done"),
        F.when(resumed, F.size(F.array_union("at.done_dirs", pending))).otherwise(1).cast("bigint").alias("n_found"),
    )


def saved_checkpoint(done: Column, pending: Column, resumes: Column) -> Column:
    """A checkpoint as JSON."""
    return F.to_json(F.struct(done.alias("done_dirs"), pending.alias("pending_dirs"), resumes.alias("resume_count")))


def event_windows(events: DataFrame, length: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and values by tumbling window and type; works on a stream (with a watermark) and on a table."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    out = rows.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n_events"), F.max("value").alias("max_value"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n_events", "max_value")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see, as the session names it; a local one in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "/tmp/checkpoints/cairn-streams"


def windows_of_stream(spark: SparkSession, folder: str, name: str, length: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """event_windows of the files of a folder, read as a stream to its end.  Each batch writes the windows that it changed
    under its own number, so that a batch that runs again replaces what it wrote; the last state of a window counts."""
    rows = spark.readStream.schema(spark.read.parquet(f"{folder}/{name}").schema).option("pathGlobFilter", name).parquet(folder)
    out = f"{shared_folder(spark)}/windows-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/states/batch={number}")

    windows = event_windows(rows, length, late)
    windows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    states = spark.read.option("basePath", f"{out}/states").parquet(f"{out}/states")
    last = states.groupBy("window_start", "event_type").agg(F.max_by(F.struct("n_events", "max_value"), "batch").alias("x"))
    return last.select("window_start", "event_type", "x.n_events", "x.max_value")
