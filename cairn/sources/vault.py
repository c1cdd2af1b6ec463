"""The snapshot catalogue as DataFrames, and its derivation from the driver's star-schema tables."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The clock of the test catalogue: all queries take their time from outside.
NOW = datetime(2001, 8, 2)
VOLUMES = [("/vol0", 0, 1000, 400, 600, False), ("/vol1", 1, 2000, 500, 1500, False), ("/vol2", 2, 4000, 3990, 10, False), ("/vol3", 3, 0, 0, 0, True)]
VOLUME_SCHEMA = "path string, ord int, total bigint, used bigint, free bigint, degraded boolean"
USERS = [(1, "admin", "admin"), (2, "alice", "user"), (3, "bob", "user")]


@dataclass
class Vault:
    """labels(label, client_name, owner_user_id, status, created_at), versions(id, label, version_key, created_at,
    finished_at, status, progress_json), files(id, version_id, path, sha256, mtime, created_at), contents(sha256, size,
    encrypted, created_at, stored_at), copies(id, sha256, volume_path, stored_at), volumes, users, jobs, samples,
    cloud_jobs, events."""

    labels: DataFrame
    versions: DataFrame
    files: DataFrame
    contents: DataFrame
    copies: DataFrame
    volumes: DataFrame
    users: DataFrame
    jobs: DataFrame
    samples: DataFrame
    cloud_jobs: DataFrame
    events: DataFrame


def content_id(part: str) -> Column:
    return F.sha2(F.concat(F.lit("part-"), F.col(part).cast("string")).cast("binary"), 256)


def load(spark: SparkSession, sf_dir: str) -> Vault:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    label = F.concat("c_mktsegment", F.lit("/"), F.col("c_nationkey").cast("string"))
    customers = read("customer").select("c_custkey", "c_mktsegment", "c_nationkey", label.alias("label"))
    owner = F.when(F.col("c_nationkey") % 4 != 0, F.col("c_nationkey") % 4)
    state = F.when(F.col("c_nationkey") == 24, "archived").otherwise("active")
    labels = customers.select("label", F.col("c_mktsegment").alias("client_name"), owner.cast("bigint").alias("owner_user_id"), state.alias("status"), (F.to_timestamp_ntz(F.lit("2001-06-01 00:00:00")) + F.make_dt_interval(days=F.col("c_nationkey") * 3)).alias("created_at")).distinct()
    open_state = F.element_at(F.array(F.lit("running"), F.lit("failed"), F.lit("incomplete")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    status = F.when(F.col("o_orderstatus") == "O", open_state).otherwise("done")
    orders = read("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    key = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0"))
    versions = orders.select(F.col("o_orderkey").alias("id"), "label", key.alias("version_key"), F.col("o_orderdate").alias("created_at"), status.alias("status"))
    ends = F.col("created_at") + F.make_dt_interval(secs=(F.col("id") % 3600).cast("decimal(18,6)"))
    versions = versions.withColumn("finished_at", F.when(F.col("status").isin("done", "failed"), ends))
    # a walk's state, for three of four versions that did not end
    walk = F.to_json(F.struct(F.array(F.concat(F.lit("d"), F.col("id").cast("string"))).alias("done_dirs"), F.array(F.lit("p"), F.concat(F.lit("d"), (F.col("id") + F.col("id") % 2).cast("string"))).alias("pending_dirs"), (F.col("id") % 5).alias("resume_count")))
    versions = versions.withColumn("progress_json", F.when(F.col("status").isin("running", "failed", "incomplete") & (F.col("id") % 4 != 0), walk))
    path = F.concat(F.lit("/d"), F.col("l_linenumber").cast("string"), F.lit("/f"), (F.col("l_suppkey") % 10).cast("string"))
    best = F.max(F.struct("l_shipdate", "l_partkey", "l_extendedprice")).alias("best")
    lines = read("lineitem").select("l_orderkey", path.alias("path"), "l_shipdate", "l_partkey", "l_extendedprice", "l_suppkey")
    files = lines.groupBy(F.col("l_orderkey").alias("version_id"), "path").agg(best).select("version_id", "path", F.col("best.l_partkey").alias("part"), F.col("best.l_shipdate").alias("created_at"))
    mtime = F.unix_timestamp(F.col("created_at").cast("timestamp")).cast("double")
    number = F.col("version_id") * 100 + F.substring("path", 3, 1).cast("bigint") * 10 + F.substring("path", 6, 1).cast("bigint")
    files = files.select(number.alias("id"), "version_id", "path", content_id("part").alias("sha256"), mtime.alias("mtime"), "created_at")
    parts = read("part").select("p_partkey", "p_size", content_id("p_partkey").alias("sha256"))
    home = F.concat(F.lit("/vol"), (F.col("p_partkey") % 4).cast("string"))
    born = F.to_timestamp_ntz(F.lit("2001-07-31 06:00:00")) + F.make_dt_interval(hours=(F.col("p_partkey") % 72).cast("int"))
    contents = parts.select("sha256", (F.col("p_size").cast("bigint") * 1024).alias("size"), (F.col("p_partkey") % 5 == 0).alias("encrypted"), born.alias("created_at"), stored(home, F.col("sha256")).alias("stored_at"))
    placed = read("lineitem").select("l_partkey", (F.col("l_suppkey") % 4).alias("k")).distinct()
    # some copies are missing, and some contents are on the degraded volume only
    placed = placed.where(((F.col("l_partkey") * 4 + F.col("k")) % 5 != 0) & ((F.col("l_partkey") % 50 != 0) | (F.col("k") == 3)))
    copies = placed.select((F.col("l_partkey") * 4 + F.col("k")).alias("id"), content_id("l_partkey").alias("sha256"), F.concat(F.lit("/vol"), F.col("k").cast("string")).alias("volume_path"))
    copies = copies.withColumn("stored_at", stored(F.col("volume_path"), F.col("sha256")))
    events = read("events").select("event_id", "ts", "user_id", "event_type", "value")
    ended = F.element_at(F.array(*map(F.lit, ("error", "failed", "running", "done"))), F.least(F.col("event_id") % 10 + 1, F.lit(4)).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ("cleanup-by-date", "auto-cleanup", "cleanup-versions", "nightly-cleanup", "encrypt-existing"))), (F.col("event_id") % 5 + 1).cast("int"))
    # the two texts that cleanups leave; the first alone names the versions in the form that is counted
    freed = F.concat(F.floor("value").cast("string"), F.lit(".5 MB)"))
    by_date = F.concat((F.col("event_id") % 7).cast("string"), F.lit(" versão(ões) removidas, "), (F.col("event_id") % 11).cast("string"), F.lit(" arquivo(s) liberados ("), freed)
    other = F.concat((F.col("event_id") % 7).cast("string"), F.lit(" versão(ões) removida(s), espaço liberado ("), freed)
    summary = F.when(F.col("event_id") % 6 == 0, by_date).when(F.col("event_id") % 6 == 3, other)
    jobs = events.select(F.col("event_id").alias("id"), kind.alias("job_type"), F.col("ts").alias("started_at"), ended.alias("status"), summary.alias("summary"))
    samples = events.select(F.col("event_id").alias("id"), F.concat(F.lit("/vol"), (F.col("user_id") % 4).cast("string")).alias("volume_path"), F.col("value").alias("used_pct"), F.col("ts").alias("sampled_at"))
    clouds = read("nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("remote_name"), (F.col("n_nationkey") % 3 != 0).alias("enabled"))
    return Vault(
        labels, versions, files, contents, copies, spark.createDataFrame(VOLUMES, VOLUME_SCHEMA), spark.createDataFrame(USERS, "id bigint, username string, role string"), jobs, samples, clouds, read("events"),
    )


def stored(volume: Column, sha: Column) -> Column:
    """<volume>/_content/<first two digits>/<sha256>"""
    return F.concat_ws("/", volume, F.lit("_content"), F.substring(sha, 1, 2), sha)


def save(vault: Vault, folder: str) -> None:
    """The catalogue's tables as files, once: queries on what open_saved() reads derive nothing.  Files are sorted by
    version and contents by digest, so that a scan for one of them skips the rest."""
    for name, df in vars(vault).items():
        order = {"files": "version_id", "contents": "sha256", "copies": "sha256"}.get(name)
        (df.repartitionByRange(F.col(order)).sortWithinPartitions(order) if order else df).write.mode("overwrite").parquet(f"{folder}/{name}")


def open_saved(spark: SparkSession, folder: str) -> Vault:
    return Vault(**{name: spark.read.parquet(f"{folder}/{name}") for name in Vault.__dataclass_fields__})
