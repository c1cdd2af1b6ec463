"""All queries of the engine by name, and for each the SQL that DuckDB can run on the same tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import frame
from cairn.functions import scalars as X
from cairn.operators import catalog as C
from cairn.operators import ingest as I  # noqa: E741
from cairn.operators import lifecycle as L
from cairn.operators import moves as M
from cairn.operators import replicas as R
from cairn.operators import stats as S
from cairn.operators import writes as W
from cairn.plans.tables_sql import TABLES
from cairn.sources import listing as G
from cairn.sources.vault import NOW, Vault, load
from cairn.streaming import walk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Versions that single-version queries look at.
ONE, TWO = 7, 32
CUTOFF, DAY = datetime(2001, 1, 1), datetime(2001, 7, 31)
TS = "TIMESTAMP '2001-08-02'"


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Vault], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(load(spark, sf_dir))
        if sql is not None:
            SQL[name] = TABLES + sql
        return f

    return add


def asked(t: Vault) -> DataFrame:
    """All file rows as requests; every seventh names an unknown content."""
    n = (F.col("version_id") * 100 + F.substring("path", 3, 1).cast("int") * 10 + F.substring("path", 6, 1).cast("int")).cast("bigint")
    sha = F.when(F.col("version_id") % 7 == 0, F.lit("f" * 64)).otherwise(F.col("sha256"))
    return t.files.select(n.alias("ordinal"), "path", sha.alias("sha256"), "mtime")


ASKED = f"""asked AS (SELECT CAST(version_id * 100 + CAST(substr(path, 3, 1) AS INTEGER) * 10 + CAST(substr(path, 6, 1) AS INTEGER) AS BIGINT) AS ordinal, path,
  CASE WHEN version_id % 7 = 0 THEN '{"f" * 64}' ELSE sha256 END AS sha256, mtime FROM vf)"""

query("reclaimable_bytes", "SELECT CAST(coalesce(sum(size), 0) AS BIGINT) AS reclaimable_bytes FROM fc WHERE sha256 NOT IN (SELECT sha256 FROM vf WHERE version_id IN (SELECT id FROM keep_loose))")(
    lambda t: C.reclaimable_bytes(t.versions, t.files, t.contents)
)
query(
    "version_stats",
    "SELECT id, label, version_key, status, coalesce(n_files, 0) AS n_files, coalesce(total_size, 0) AS total_size, epoch_us(finished_at) / 1e6 - epoch_us(created_at) / 1e6 AS duration_s FROM v LEFT JOIN fs ON id = version_id",
)(lambda t: C.version_stats(t.versions, t.files, t.contents))
LIST = """, latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY created_at DESC, id DESC) AS rn FROM done) WHERE rn = 1),
states AS (SELECT label, count(*) FILTER (status = 'done') AS n_done, bool_or(status = 'running') AS running FROM v GROUP BY label)
SELECT l.label, coalesce(n_done, 0) AS n_done, version_key AS latest_key, coalesce(n_files, 0) AS n_files, coalesce(total_size, 0) AS total_size, coalesce(running, FALSE) AS has_running, username AS owner
FROM labels_ l LEFT JOIN states USING (label) LEFT JOIN latest ON latest.label = l.label LEFT JOIN fs ON latest.id = fs.version_id LEFT JOIN users_ u ON u.id = l.owner_user_id"""
query("backup_list", LIST)(lambda t: C.backup_list(t.labels, t.versions, t.files, t.contents, t.users))
query("backup_info", LIST + " WHERE l.label = 'BUILDING/1'")(lambda t: C.backup_list(t.labels, t.versions, t.files, t.contents, t.users).where(F.col("label") == "BUILDING/1"))
query("backup_list_of_owner", LIST + " WHERE l.owner_user_id = 2")(lambda t: C.backup_list(C.visible(t.labels, 2, "user"), t.versions, t.files, t.contents, t.users))
query(
    "stats_counts",
    """, x AS (SELECT l.label, id, v.status FROM labels_ l LEFT JOIN v USING (label) WHERE l.status = 'active'),
y AS (SELECT count(DISTINCT label) AS n_labels, count(id) AS n_versions, count(*) FILTER (status = 'done') AS n_done, count(*) FILTER (status = 'failed') AS n_failed FROM x)
SELECT *, CASE WHEN n_done + n_failed > 0 THEN n_done * 100.0::DOUBLE / (n_done + n_failed) ELSE 100.0::DOUBLE END AS success_rate FROM y""",
)(lambda t: S.counts(t.labels, t.versions))
query("stats_avg_duration", "SELECT CAST(sum(s) AS DOUBLE) / count(s) AS avg_seconds FROM (SELECT CAST((epoch_us(finished_at) - epoch_us(created_at)) // 1000000 AS BIGINT) AS s FROM done WHERE finished_at IS NOT NULL)")(
    lambda t: S.average_duration(t.versions)
)
query(
    "stats_storage",
    ", x AS (SELECT CAST(sum(total) AS BIGINT) AS total, CAST(sum(used) AS BIGINT) AS used, CAST(sum(free) AS BIGINT) AS free FROM vol WHERE NOT degraded) SELECT *, used * 100.0::DOUBLE / total AS used_pct FROM x",
)(lambda t: S.storage(t.volumes))
query(
    "stats_dedup",
    """, u AS (SELECT count(*) AS n_contents, CAST(sum(size) AS BIGINT) AS stored FROM fc), r AS (SELECT count(*) AS n_refs, CAST(sum(size) AS BIGINT) AS logical FROM vf JOIN fc USING (sha256))
SELECT *, greatest(logical - stored, 0) AS saved, CAST(logical AS DOUBLE) / stored AS ratio FROM u, r""",
)(lambda t: S.dedup(t.files, t.contents))
query("stats_trend_30d", f"SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n_versions, CAST(coalesce(sum(total_size), 0) AS BIGINT) AS total_size FROM done LEFT JOIN fs ON id = version_id WHERE created_at >= {TS} - INTERVAL 30 DAY GROUP BY 1")(
    lambda t: S.trend(t.versions, t.files, t.contents, NOW)
)
query("stats_top_backups", "SELECT label, coalesce(n_files, 0) AS n_files, coalesce(total_size, 0) AS total_size FROM last_id LEFT JOIN fs ON id = version_id ORDER BY total_size DESC, label LIMIT 10")(
    lambda t: S.top_labels(t.versions, t.files, t.contents)
)
query("stats_maintenance_by_type", "SELECT job_type, count(*) FILTER (status = 'done') AS n_done, count(*) FILTER (status = 'error') AS n_error, max(started_at) AS last_run FROM jobs GROUP BY 1")(
    lambda t: S.maintenance_by_type(t.jobs)
)
query("stats_last_jobs", "SELECT id, job_type, status, started_at FROM jobs ORDER BY started_at DESC, id DESC LIMIT 5")(lambda t: S.last_jobs(t.jobs))
query("stats_rclone", "SELECT count(*) AS n_jobs, count(*) FILTER (enabled) AS n_enabled FROM clouds")(lambda t: S.cloud_counts(t.cloud_jobs))
query(
    "stats_label_lifecycle",
    f""", n AS (SELECT count(*) AS n_labels FROM labels_ WHERE created_at >= {TS} - INTERVAL 30 DAY),
j AS (SELECT CAST(coalesce(sum(CAST(nullif(regexp_extract(summary, '(\\d+) versão\\(ões\\) removidas', 1), '') AS BIGINT)), 0) AS BIGINT) AS n_cleaned,
  CAST(coalesce(sum(trunc(CAST(nullif(regexp_extract(summary, '\\(([\\d.]+) MB\\)', 1), '') AS DOUBLE) * 1048576)), 0) AS BIGINT) AS freed_bytes
  FROM jobs WHERE job_type IN ('cleanup-by-date', 'auto-cleanup', 'cleanup-versions', 'nightly-cleanup') AND status = 'done' AND summary IS NOT NULL)
SELECT * FROM n, j""",
)(lambda t: S.label_lifecycle(t.labels, t.jobs, NOW))
query("stats_activity", "SELECT l.label, max(CASE WHEN v.status = 'done' THEN finished_at END) AS last_done_at, count(*) FILTER (v.status = 'done') AS n_done FROM labels_ l LEFT JOIN v USING (label) WHERE l.status = 'active' GROUP BY 1")(
    lambda t: S.label_activity(t.labels, t.versions)
)
query(
    "stats_reclaimable_by_label",
    """, kept AS (SELECT DISTINCT sha256 FROM vf WHERE version_id IN (SELECT id FROM last_id)), old AS (SELECT id, label FROM done WHERE id NOT IN (SELECT id FROM last_id)),
held AS (SELECT DISTINCT label, sha256 FROM old JOIN vf ON old.id = version_id), x AS (SELECT label, CAST(sum(size) AS BIGINT) AS reclaimable FROM held JOIN fc USING (sha256) WHERE sha256 NOT IN (SELECT sha256 FROM kept) GROUP BY 1)
SELECT label, reclaimable, n_old FROM x JOIN (SELECT label, count(*) AS n_old FROM old GROUP BY 1) USING (label) WHERE reclaimable > 0""",
)(lambda t: S.reclaimable_by_label(t.versions, t.files, t.contents))
query(
    "activity_running",
    """, latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY created_at DESC, id DESC) AS rn FROM done) WHERE rn = 1)
SELECT v.id, v.label, coalesce(a.n_files, 0) AS n_files, coalesce(a.total_size, 0) AS total_size, b.total_size AS previous_size
FROM v LEFT JOIN latest ON latest.label = v.label LEFT JOIN fs a ON a.version_id = v.id LEFT JOIN fs b ON b.version_id = latest.id WHERE v.status = 'running'""",
)(lambda t: S.running(t.versions, t.files, t.contents))
CHANGES = """, prev AS (SELECT *, lag(id) OVER (PARTITION BY label ORDER BY version_key) AS previous_id FROM done),
cur AS (SELECT prev.id, path, sha256 FROM prev JOIN vf ON prev.id = version_id), bef AS (SELECT prev.id, path, sha256 FROM prev JOIN vf ON previous_id = version_id),
diff AS (SELECT coalesce(cur.id, bef.id) AS id, count(*) FILTER (bef.sha256 IS NULL) AS added, count(*) FILTER (cur.sha256 <> bef.sha256) AS modified, count(*) FILTER (cur.sha256 IS NULL) AS removed
  FROM cur FULL JOIN bef ON cur.id = bef.id AND cur.path = bef.path GROUP BY 1),
changes AS (SELECT prev.id, coalesce(added, 0) AS added, coalesce(modified, 0) AS modified, coalesce(removed, 0) AS removed FROM prev LEFT JOIN diff USING (id))"""
query("version_changes", CHANGES + " SELECT * FROM changes")(lambda t: C.change_counts(C.previous_done(t.versions).select("id", "previous_id"), t.files))
query(
    "activity_recent_diffs",
    CHANGES + f", ended AS (SELECT * FROM v WHERE status IN ('done', 'failed', 'incomplete') AND finished_at >= {TS} - INTERVAL 24 HOUR ORDER BY finished_at DESC, id DESC LIMIT 30) SELECT e.id, label, status, added, modified, removed FROM ended e LEFT JOIN changes USING (id)",
)(lambda t: S.recent_diffs(t.versions, t.files, NOW))
query("activity_jobs", "SELECT id, job_type, status, started_at FROM jobs WHERE status = 'running' OR started_at >= TIMESTAMP '2024-01-29' ORDER BY started_at DESC, id DESC LIMIT 20")(lambda t: S.recent_jobs(t.jobs, datetime(2024, 1, 30)))
query(
    "daily_digest",
    CHANGES
    + """ SELECT label, count(*) FILTER (status = 'done') AS n_done, count(*) FILTER (status = 'failed') AS n_failed, count(*) FILTER (status NOT IN ('done', 'failed')) AS n_other,
CAST(coalesce(sum(added), 0) AS BIGINT) AS added, CAST(coalesce(sum(modified), 0) AS BIGINT) AS modified, CAST(coalesce(sum(removed), 0) AS BIGINT) AS removed
FROM v LEFT JOIN changes USING (id) WHERE created_at >= TIMESTAMP '2001-07-31' AND created_at < TIMESTAMP '2001-08-01' GROUP BY label""",
)(lambda t: S.daily_digest(t.versions, t.files, DAY, DAY + timedelta(days=1)))
query("digest_new_bytes", "SELECT count(*) AS n_contents, CAST(coalesce(sum(size), 0) AS BIGINT) AS n_bytes FROM fc WHERE created_at >= TIMESTAMP '2001-07-31' AND created_at < TIMESTAMP '2001-08-01'")(
    lambda t: t.contents.where((F.col("created_at") >= L.at(DAY)) & (F.col("created_at") < L.at(DAY + timedelta(days=1)))).agg(F.count(F.lit(1)).alias("n_contents"), C.total("size").alias("n_bytes"))
)
query(
    "disk_usage",
    """, x AS (SELECT volume_path, count(*) AS n_copies, CAST(sum(size) AS BIGINT) AS n_bytes FROM cp JOIN fc USING (sha256) GROUP BY 1)
SELECT path, coalesce(n_copies, 0) AS n_copies, coalesce(n_bytes, 0) AS n_bytes, CASE WHEN degraded THEN 'degraded' ELSE 'ok' END AS status FROM vol LEFT JOIN x ON path = volume_path""",
)(lambda t: S.disk_usage(t.copies, t.contents, t.volumes))
query("disk_history", "SELECT id, volume_path, used_pct, sampled_at FROM (SELECT *, row_number() OVER (PARTITION BY volume_path ORDER BY sampled_at DESC, id DESC) AS rn FROM samples) WHERE rn <= 48")(lambda t: S.kept_samples(t.samples))
query(
    "disk_snapshot_throttle",
    """, s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY volume_path ORDER BY sampled_at, id) AS rn FROM samples),
nxt AS MATERIALIZED (SELECT a.volume_path, a.rn, min(b.rn) AS to_ FROM s a JOIN s b ON a.volume_path = b.volume_path AND b.sampled_at >= a.sampled_at + INTERVAL 30 MINUTE GROUP BY 1, 2),
k AS (SELECT DISTINCT volume_path, CAST(1 AS BIGINT) AS rn FROM s UNION ALL SELECT k.volume_path, to_ FROM k JOIN nxt ON nxt.volume_path = k.volume_path AND nxt.rn = k.rn)
SELECT id, volume_path, used_pct, sampled_at FROM (SELECT s.*, row_number() OVER (PARTITION BY s.volume_path ORDER BY sampled_at DESC, id DESC) AS back FROM s JOIN k ON k.volume_path = s.volume_path AND k.rn = s.rn) WHERE back <= 48""",
)(lambda t: S.kept_samples(S.throttled(t.samples)))
DISKS = """, held AS (SELECT DISTINCT label, version_id, sha256 FROM keep_done JOIN vf ON keep_done.id = version_id)
SELECT label, volume_path, count(*) AS n_contents, CAST(sum(size) AS BIGINT) AS n_bytes FROM held JOIN cp USING (sha256) JOIN fc USING (sha256)"""
query("disk_summary_all", DISKS + " GROUP BY 1, 2")(lambda t: S.label_disks(t.versions, t.files, t.copies, t.contents))
query("backup_disks", DISKS + " WHERE label = 'BUILDING/1' GROUP BY 1, 2")(lambda t: S.label_disks(t.versions.where(F.col("label") == "BUILDING/1"), t.files, t.copies, t.contents))

query(
    "check_files",
    f", {ASKED} SELECT ordinal, a.path, m.path IS NULL AS needs_upload, m.path IS NOT NULL OR fc.sha256 IS NOT NULL AS content_exists, CASE WHEN m.path IS NOT NULL THEN 'registered' WHEN fc.sha256 IS NOT NULL THEN 'content_exists' ELSE 'new' END AS reason, m.id AS file_id FROM asked a LEFT JOIN (SELECT * FROM vf WHERE version_id = {TWO}) m ON m.path = a.path AND m.sha256 = a.sha256 LEFT JOIN fc ON fc.sha256 = a.sha256",
)(lambda t: I.check_files(asked(t), t.files, t.contents, TWO))
query(
    "register_batch",
    f""", {ASKED}, n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ordinal DESC) AS rn FROM asked WHERE sha256 IN (SELECT sha256 FROM fc)) WHERE rn = 1)
SELECT coalesce(n.path, o.path) AS path, coalesce(n.sha256, o.sha256) AS sha256, coalesce(n.mtime, o.mtime) AS mtime FROM (SELECT * FROM vf WHERE version_id = {TWO}) o FULL JOIN n ON n.path = o.path""",
)(lambda t: I.register_batch(asked(t), t.files, t.contents, TWO))
query("register_counts", f", {ASKED} SELECT count(*) FILTER (fc.sha256 IS NOT NULL) AS registered, count(*) FILTER (fc.sha256 IS NULL) AS missing FROM asked LEFT JOIN fc USING (sha256)")(lambda t: I.register_counts(asked(t), t.contents))
query("absorb", f"SELECT CAST({TWO} AS BIGINT) AS version_id, path, sha256, mtime FROM vf WHERE version_id = {ONE} AND path NOT IN (SELECT path FROM vf WHERE version_id = {TWO})")(lambda t: I.inherit(t.files, ONE, TWO))
query("list_files", f"SELECT path, sha256, coalesce(size, 0) AS size, mtime FROM vf LEFT JOIN fc USING (sha256) WHERE version_id = {TWO}")(lambda t: C.list_files(t.files, t.contents, TWO))
query(
    "download_candidates",
    f""", h AS (SELECT sha256, count(*) FILTER (NOT degraded) AS n_healthy, count(*) FILTER (degraded) AS n_degraded, min_by(stored_at, id) FILTER (NOT degraded) AS first,
  string_agg(stored_at, ',' ORDER BY id) FILTER (NOT degraded) AS candidates FROM cp JOIN vol ON path = volume_path GROUP BY 1)
SELECT vf.path, sha256, coalesce(n_healthy, 0) AS n_healthy, first, coalesce(candidates, '') AS candidates, CAST(CASE WHEN n_healthy > 0 THEN 200 WHEN n_degraded > 0 THEN 503 ELSE 410 END AS BIGINT) AS answer FROM vf LEFT JOIN h USING (sha256) WHERE version_id = {TWO}""",
)(lambda t: R.download_candidates(t.files, t.copies, t.contents, t.volumes, TWO))
query(
    "compare_versions",
    f""", a AS (SELECT path, sha256, coalesce(size, 0) AS size FROM vf LEFT JOIN fc USING (sha256) WHERE version_id = {ONE}), b AS (SELECT path, sha256, coalesce(size, 0) AS size FROM vf LEFT JOIN fc USING (sha256) WHERE version_id = {TWO})
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' WHEN a.sha256 = b.sha256 THEN 'unchanged' ELSE 'modified' END AS kind, coalesce(b.size, 0) - coalesce(a.size, 0) AS delta FROM a FULL JOIN b ON a.path = b.path""",
)(lambda t: C.compare_versions(t.files, t.contents, ONE, TWO))

query("orphan_contents", "SELECT sha256, size FROM fc WHERE sha256 NOT IN (SELECT sha256 FROM vf)")(lambda t: L.orphan_contents(t.files, t.contents).select("sha256", "size"))
query("cleanup_keep_n", "SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY version_key DESC) AS rn FROM v) WHERE rn > 5")(lambda t: L.beyond_newest(t.versions, 5).select("id", "label"))
query("cleanup_by_date", "SELECT label, count(*) AS n_versions FROM v WHERE created_at < TIMESTAMP '2001-01-01' AND status <> 'running' AND id NOT IN (SELECT id FROM last_id) GROUP BY 1")(
    lambda t: L.before_date(t.versions, CUTOFF).groupBy("label").agg(F.count(F.lit(1)).alias("n_versions"))
)
READY = 200_000
query(
    "auto_cleanup_plan",
    f""", old AS (SELECT id, created_at, row_number() OVER (PARTITION BY label ORDER BY created_at DESC, id DESC) AS rn FROM done),
steps AS MATERIALIZED (SELECT id, CAST(0 AS BIGINT) AS step FROM v WHERE status IN ('failed', 'incomplete') UNION ALL SELECT id, row_number() OVER (ORDER BY created_at, id) FROM old WHERE rn > 1),
held AS (SELECT DISTINCT version_id, sha256 FROM vf), last AS (SELECT sha256, max(step) AS step, count(*) - count(step) AS kept FROM held LEFT JOIN steps ON id = version_id GROUP BY 1),
going AS (SELECT fc.sha256, size, coalesce(step, 0) AS step FROM fc LEFT JOIN last USING (sha256) WHERE coalesce(kept, 0) = 0),
freed AS (SELECT volume_path, step, sum(size) AS freed FROM going JOIN cp USING (sha256) GROUP BY 1, 2),
grid AS (SELECT step, path, free FROM (SELECT step FROM steps UNION SELECT 0) CROSS JOIN vol WHERE NOT degraded),
upto AS (SELECT grid.step, path, free + sum(coalesce(freed, 0)) OVER (PARTITION BY path ORDER BY grid.step) AS room FROM grid LEFT JOIN freed ON volume_path = path AND freed.step = grid.step),
ready AS MATERIALIZED (SELECT step, count(*) FILTER (room >= {READY}) AS n_ready FROM upto GROUP BY 1)
SELECT step, id, n_ready FROM steps JOIN ready USING (step) WHERE (SELECT count(*) FROM vol WHERE NOT degraded AND free >= {READY}) < 2 AND step <= coalesce((SELECT min(step) FROM ready WHERE n_ready >= 2), step)""",
)(lambda t: L.cleanup_plan(t.versions, t.files, t.contents, t.copies, t.volumes, 2, READY))
query(
    "retention_plan",
    f""", x AS (SELECT *, CASE WHEN created_at >= {TS} - INTERVAL 24 HOUR THEN 'all' WHEN created_at >= {TS} - INTERVAL 30 DAY THEN 'day' WHEN created_at >= {TS} - INTERVAL 180 DAY THEN 'week' ELSE 'month' END AS tier FROM done),
y AS (SELECT *, CASE tier WHEN 'all' THEN CAST(id AS VARCHAR) WHEN 'day' THEN strftime(created_at, '%Y-%m-%d') WHEN 'week' THEN CAST(isoyear(created_at) AS VARCHAR) || '-' || CAST(weekofyear(created_at) AS VARCHAR) ELSE strftime(created_at, '%Y-%m') END AS bucket FROM x)
SELECT id, label, tier, row_number() OVER (PARTITION BY label, tier, bucket ORDER BY created_at DESC, id DESC) = 1 AS keep FROM y""",
)(lambda t: L.retention(t.versions, NOW).select("id", "label", "tier", "keep"))
query("stale_versions", "SELECT id, label FROM v JOIN (SELECT label, max(created_at) AS newest FROM done GROUP BY 1) USING (label) WHERE status IN ('failed', 'incomplete') AND newest > created_at")(lambda t: L.overtaken(t.versions).select("id", "label"))
query(
    "stale_running",
    f"SELECT id, label FROM v LEFT JOIN (SELECT version_id, max(created_at) AS last FROM vf GROUP BY 1) ON id = version_id WHERE status = 'running' AND coalesce(last, created_at) < {TS} - INTERVAL 6 HOUR",
)(lambda t: L.inactive(t.versions, t.files, NOW).select("id", "label"))
query(
    "integrity_check",
    """, present AS (SELECT DISTINCT sha256 FROM cp JOIN vol ON path = volume_path WHERE ord < 2), missing AS (SELECT DISTINCT sha256 FROM vf WHERE version_id IN (SELECT id FROM keep_done) AND sha256 NOT IN (SELECT sha256 FROM present))
SELECT done.id, label, count(DISTINCT sha256) AS n_missing FROM done JOIN vf ON done.id = version_id WHERE sha256 IN (SELECT sha256 FROM missing) GROUP BY 1, 2""",
)(lambda t: L.damage(t.versions, t.files, t.copies.where(F.col("volume_path").isin("/vol0", "/vol1")).select("sha256").distinct()))
DEFICIT = """, n AS (SELECT fc.sha256, count(cp.id) AS n_copies FROM fc LEFT JOIN cp USING (sha256) GROUP BY 1), tgt AS (SELECT least(4, greatest(1, count(*) FILTER (NOT degraded))) AS target FROM vol),
src AS (SELECT sha256, min_by(volume_path, id) AS source FROM cp JOIN vol ON path = volume_path WHERE NOT degraded GROUP BY 1),
few AS (SELECT n.sha256, n_copies, CAST(target AS BIGINT) AS target, source FROM n CROSS JOIN tgt LEFT JOIN src ON src.sha256 = n.sha256 WHERE n_copies < target)"""
query("replica_deficit", DEFICIT + " SELECT * FROM few")(lambda t: R.deficit(t.contents, t.copies, t.volumes, 4))
query(
    "replica_placement",
    DEFICIT
    + """ SELECT sha256, volume_path FROM (SELECT sha256, vol.path AS volume_path, target - n_copies AS want, row_number() OVER (PARTITION BY sha256 ORDER BY ord) AS rn FROM few CROSS JOIN vol
WHERE NOT degraded AND source IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cp WHERE cp.sha256 = few.sha256 AND cp.volume_path = vol.path)) WHERE rn <= want""",
)(lambda t: R.placement(t.contents, t.copies, t.volumes, 4))
query(
    "replica_excess",
    """, r AS (SELECT cp.id, cp.sha256, cp.volume_path, cp.stored_at, row_number() OVER w AS rn, first_value(cp.stored_at) OVER w AS new_primary FROM cp JOIN fc USING (sha256) LEFT JOIN vol ON path = volume_path
WINDOW w AS (PARTITION BY cp.sha256 ORDER BY cp.stored_at = fc.stored_at DESC, NOT degraded DESC, cp.id)) SELECT id, sha256, volume_path, new_primary FROM r WHERE rn > 2""",
)(lambda t: R.excess(t.contents, t.copies, t.volumes, 2))
query("rereplicate_to_volume", DEFICIT + " SELECT sha256, n_copies, source FROM few WHERE sha256 NOT IN (SELECT sha256 FROM cp WHERE volume_path = '/vol1')")(lambda t: R.for_volume(t.contents, t.copies, t.volumes, 4, "/vol1"))
query("backfill_copies", "SELECT sha256, stored_at, regexp_extract(stored_at, '^(/[^/]+)', 1) AS volume_path FROM fc WHERE sha256 NOT IN (SELECT sha256 FROM cp WHERE id % 8 <> 0)")(lambda t: R.missing_copy_rows(t.contents, t.copies.where(F.col("id") % 8 != 0)))
query("volume_pick", "SELECT coalesce((SELECT path FROM vol WHERE NOT degraded AND free > 1000 ORDER BY ord LIMIT 1), (SELECT path FROM vol WHERE NOT degraded ORDER BY free DESC, ord LIMIT 1)) AS volume_path")(lambda t: R.pick_volume(t.volumes, 1000))
query("volume_last_resort", "SELECT path AS volume_path FROM vol WHERE NOT degraded ORDER BY free DESC, ord LIMIT 1")(lambda t: R.pick_volume(t.volumes, 10**9))
PENDING = ", pending AS (SELECT sha256 FROM cp WHERE volume_path = '/vol0' AND id % 3 = 0)"
pending = lambda t: t.copies.where((F.col("volume_path") == "/vol0") & (F.col("id") % 3 == 0)).select("sha256")
query("ssd_budget", PENDING + " SELECT CAST(sum(size) AS BIGINT) AS pending_bytes, sum(size) < 10000000 AS accepts FROM pending JOIN fc USING (sha256)")(lambda t: R.pending_budget(pending(t), t.contents, 10_000_000))
FEWER = """, cc AS (SELECT * FROM cp WHERE volume_path = '/vol0' OR (id // 4) % 3 = 0), here AS (SELECT id, sha256, stored_at FROM cc WHERE volume_path = '/vol0' AND sha256 NOT IN (SELECT sha256 FROM pending)),
other AS (SELECT sha256, min_by(stored_at, id) AS fallback FROM cc WHERE volume_path <> '/vol0' GROUP BY 1), there AS (SELECT stored_at FROM cp WHERE id % 7 <> 0)"""
fewer = lambda t: t.copies.where((F.col("volume_path") == "/vol0") | (F.floor(F.col("id") / 4) % 3 == 0))
there = lambda t: t.copies.where(F.col("id") % 7 != 0).select("stored_at")
query(
    "ssd_stuck",
    PENDING + FEWER + """ SELECT here.sha256, here.stored_at AS ssd_path, '/vol1' AS dest_volume, '/vol1/_content/' || substr(here.sha256, 1, 2) || '/' || here.sha256 AS dest_path FROM here LEFT JOIN fc ON fc.sha256 = here.sha256
WHERE here.sha256 NOT IN (SELECT sha256 FROM other) AND here.stored_at IN (SELECT stored_at FROM there) AND NOT coalesce(fc.stored_at <> here.stored_at AND fc.stored_at IN (SELECT stored_at FROM there), FALSE)""",
)(lambda t: M.stuck(fewer(t), pending(t), t.contents, there(t), "/vol0", "/vol1"))
query(
    "ssd_orphans",
    PENDING + FEWER + """ SELECT here.id, here.sha256, CASE WHEN fallback IS NOT NULL THEN 'redundant' WHEN here.stored_at NOT IN (SELECT stored_at FROM there) THEN 'missing' ELSE 'kept' END AS action,
CASE WHEN fc.stored_at = here.stored_at THEN fallback END AS new_primary FROM here LEFT JOIN other ON other.sha256 = here.sha256 LEFT JOIN fc ON fc.sha256 = here.sha256""",
)(lambda t: M.orphans(fewer(t), pending(t), t.contents, there(t), "/vol0"))
QUEUE = """, queue AS (SELECT sha256, stored_at AS ssd_path, '/vol1' AS dest_volume, '/vol1/_content/' || substr(sha256, 1, 2) || '/' || sha256 AS dest_path, id % 5 AS retry_count,
  CASE (id // 4) % 6 WHEN 0 THEN 'moved' WHEN 1 THEN 'absent' WHEN 2 THEN 'full' WHEN 3 THEN 'failed' WHEN 4 THEN 'corrupt' ELSE 'full' END AS outcome, CASE WHEN (id // 4) % 6 = 2 THEN '/vol2' END AS other_volume FROM cp WHERE volume_path = '/vol0'),
taken AS (SELECT *, outcome = 'full' AND other_volume IS NOT NULL AS sent FROM queue ORDER BY sha256 LIMIT 100),
counted AS (SELECT *, CASE WHEN sent THEN 0 WHEN outcome IN ('failed', 'corrupt', 'full') THEN retry_count + 1 ELSE retry_count END AS now FROM taken),
round AS (SELECT sha256, CASE WHEN outcome = 'moved' OR sent THEN 'moved' WHEN outcome = 'absent' THEN 'dropped' WHEN now >= 5 THEN 'abandoned' ELSE 'waiting' END AS action, now AS retry_count, CASE WHEN sent THEN '/vol2' ELSE '/vol1' END AS dest_volume FROM counted)"""


def queued(t: Vault) -> tuple[DataFrame, DataFrame]:
    """A queue of the cache's copies, and what becomes of each."""
    kind = F.element_at(F.array(*map(F.lit, ("moved", "absent", "full", "failed", "corrupt", "full"))), (F.floor(F.col("id") / 4) % 6 + 1).cast("int"))
    rows = t.copies.where(F.col("volume_path") == "/vol0").select("id", "sha256", F.col("stored_at").alias("ssd_path"), F.lit("/vol1").alias("dest_volume"), X.content_path(F.lit("/vol1"), F.col("sha256")).alias("dest_path"), (F.col("id") % 5).alias("retry_count"), kind.alias("outcome"))
    return rows.drop("id", "outcome"), rows.select("sha256", "outcome", F.when(F.floor(F.col("id") / 4) % 6 == 2, "/vol2").alias("other_volume"))


query(
    "move_round",
    QUEUE + """ SELECT round.sha256, action, retry_count, dest_volume, dest_volume || '/_content/' || substr(round.sha256, 1, 2) || '/' || round.sha256 AS dest_path, coalesce(n, 0) AS n_versions
FROM round LEFT JOIN (SELECT sha256, count(DISTINCT version_id) AS n FROM vf GROUP BY 1) x ON x.sha256 = round.sha256 AND action = 'abandoned'""",
)(lambda t: M.move_round(*queued(t), t.files, 100))
query(
    "move_queue_after",
    QUEUE + """ SELECT sha256, retry_count, dest_volume, dest_path FROM queue WHERE sha256 NOT IN (SELECT sha256 FROM round)
UNION ALL SELECT sha256, retry_count, dest_volume, dest_volume || '/_content/' || substr(sha256, 1, 2) || '/' || sha256 FROM round WHERE action = 'waiting'""",
)(lambda t: M.queue_after(queued(t)[0], M.move_round(*queued(t), t.files, 100)))
query(
    "move_failed_versions",
    QUEUE + " SELECT id, CASE WHEN id IN (SELECT version_id FROM vf JOIN round ON round.sha256 = vf.sha256 WHERE action = 'abandoned') THEN 'failed' ELSE status END AS status FROM v",
)(lambda t: M.failed_versions(t.versions, t.files, M.move_round(*queued(t), t.files, 100)).select("id", "status"))
query(
    "migrate_disk_preview",
    """, h AS (SELECT sha256, size, sha256 IN (SELECT sha256 FROM cp WHERE volume_path = '/vol1') AS there FROM (SELECT DISTINCT sha256 FROM cp WHERE volume_path = '/vol0') JOIN fc USING (sha256)),
m AS (SELECT count(*) FILTER (NOT there) AS n_copy, CAST(coalesce(sum(size) FILTER (NOT there), 0) AS BIGINT) AS copy_bytes, count(*) FILTER (there) AS n_there FROM h), f AS (SELECT CAST(sum(free) AS BIGINT) AS free FROM vol WHERE path = '/vol1')
SELECT *, free >= copy_bytes AS feasible FROM m, f""",
)(lambda t: R.migration_preview(t.copies, t.contents, t.volumes, "/vol0", ["/vol1"]))
query(
    "migrate_disk_plan",
    """, src AS (SELECT sha256, min(id) AS id FROM cp WHERE volume_path = '/vol0' GROUP BY 1), there AS (SELECT DISTINCT sha256 FROM cp WHERE volume_path = '/vol1'),
todo AS MATERIALIZED (SELECT sha256, size, row_number() OVER (ORDER BY id) AS k FROM src JOIN fc USING (sha256) WHERE sha256 NOT IN (SELECT sha256 FROM there)),
fold AS (SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS sha256, CAST(2000000 AS BIGINT) AS a, CAST(1200000 AS BIGINT) AS b, CAST(NULL AS VARCHAR) AS pick
  UNION ALL SELECT todo.k, todo.sha256, CASE WHEN a >= b AND a > 0 THEN greatest(0, a - size) ELSE a END, CASE WHEN b > a AND b > 0 THEN greatest(0, b - size) ELSE b END,
  CASE WHEN greatest(a, b) <= 0 THEN NULL WHEN a >= b THEN '/vol1' ELSE '/vol9' END FROM fold JOIN todo ON todo.k = fold.k + 1),
dealt AS (SELECT sha256, pick AS volume_path, CASE WHEN pick IS NULL THEN 'skip' ELSE 'copy' END AS action FROM fold WHERE k > 0 UNION ALL SELECT sha256, NULL, 'there' FROM src WHERE sha256 IN (SELECT sha256 FROM there)),
alt AS (SELECT sha256, min_by(stored_at, id) AS alternative FROM cp WHERE volume_path <> '/vol0' GROUP BY 1)
SELECT fc.sha256, size, action, volume_path, CASE WHEN stored_at LIKE '/vol0/%' THEN coalesce(alternative, CASE WHEN action = 'copy' THEN volume_path || '/_content/' || substr(fc.sha256, 1, 2) || '/' || fc.sha256 END) END AS new_primary
FROM fc LEFT JOIN dealt ON dealt.sha256 = fc.sha256 LEFT JOIN alt ON alt.sha256 = fc.sha256 WHERE action IS NOT NULL OR stored_at LIKE '/vol0/%'""",
)(lambda t: R.migration_plan(t.copies, t.contents, {"/vol1": 2_000_000, "/vol9": 1_200_000}, "/vol0"))
query("encrypt_pending", "SELECT sha256, size, coalesce(n, 0) AS n_reachable FROM fc LEFT JOIN (SELECT sha256, count(*) AS n FROM cp JOIN vol ON path = volume_path WHERE NOT degraded GROUP BY 1) USING (sha256) WHERE NOT encrypted")(
    lambda t: R.unencrypted(t.contents, t.copies, t.volumes)
)
query("labels_for_shas", "SELECT DISTINCT label FROM v JOIN vf ON v.id = version_id WHERE sha256 IN (SELECT sha256 FROM fc WHERE size = 1024)")(lambda t: I.labels_of(t.contents.where(F.col("size") == 1024).select("sha256"), t.files, t.versions))

LISTING = ", listing AS (SELECT path, version_id, sha256, coalesce(size, 0) AS size, mtime FROM vf LEFT JOIN fc USING (sha256))"


def listing(t: Vault) -> DataFrame:
    return t.files.join(t.contents.select("sha256", "size"), "sha256", "left").select("version_id", "path", "sha256", F.coalesce("size", F.lit(0)).alias("size"), "mtime")


query(
    "change_detect_local",
    LISTING
    + f""", p AS (SELECT path, sha256 AS old_sha, size AS old_size, mtime AS old_mtime FROM listing WHERE version_id = {ONE})
SELECT l.path, coalesce(mtime = old_mtime AND l.size = old_size, FALSE) AS fast, CASE WHEN coalesce(mtime = old_mtime AND l.size = old_size, FALSE) OR l.sha256 = old_sha THEN 'skip' WHEN fc.sha256 IS NOT NULL THEN 'register' ELSE 'upload' END AS action
FROM listing l LEFT JOIN p USING (path) LEFT JOIN fc ON fc.sha256 = l.sha256""",
)(lambda t: I.local_changes(listing(t), t.files.where(F.col("version_id") == ONE), t.contents).select("path", "fast", "action"))
query(
    "change_detect_cloud",
    f""", a AS (SELECT path, mtime FROM vf WHERE version_id = {ONE}), b AS (SELECT path, mtime FROM vf WHERE version_id = {TWO}), base AS (SELECT coalesce(b.path, a.path) AS path, coalesce(b.mtime, a.mtime) AS known FROM a FULL JOIN b ON a.path = b.path)
SELECT vf.path, CASE WHEN mtime = known THEN 'skip' ELSE 'download' END AS action FROM vf LEFT JOIN base ON base.path = vf.path""",
)(lambda t: I.cloud_changes(t.files, t.files.where(F.col("version_id") == ONE), t.files.where(F.col("version_id") == TWO)))
query(
    "batch_pack",
    LISTING + """, n AS MATERIALIZED (SELECT 'b/' || CAST(version_id % 50 AS VARCHAR) AS "group", lpad(CAST(version_id AS VARCHAR), 9, '0') || path AS path, size, row_number() OVER (PARTITION BY version_id % 50 ORDER BY lpad(CAST(version_id AS VARCHAR), 9, '0') || path) AS k FROM listing),
fold AS (SELECT "group", k, path, size, CAST(0 AS BIGINT) AS batch, 1 AS c, CAST(size AS BIGINT) AS h FROM n WHERE k = 1
  UNION ALL SELECT n."group", n.k, n.path, n.size, CASE WHEN c >= 40 OR h >= 1000000 THEN batch + 1 ELSE batch END, CASE WHEN c >= 40 OR h >= 1000000 THEN 1 ELSE c + 1 END, CASE WHEN c >= 40 OR h >= 1000000 THEN n.size ELSE h + n.size END
  FROM fold JOIN n ON n."group" = fold."group" AND n.k = fold.k + 1)
SELECT "group", path, size, batch FROM fold""",
)(
    lambda t: I.batches(listing(t).select(F.concat_ws("/", F.lit("b"), (F.col("version_id") % 50).cast("string")).alias("group"), F.concat(F.lpad(F.col("version_id").cast("string"), 9, "0"), "path").alias("path"), "size"), 40, 1_000_000)
)
query(
    "walk_progress",
    """, e AS (SELECT CAST(version_id AS VARCHAR) AS directory, CAST(version_id AS VARCHAR) || path AS path, sha256 FROM vf), r AS (SELECT path FROM e WHERE sha256 IN (SELECT sha256 FROM fc WHERE size > 2048)), f AS (SELECT CAST(id AS VARCHAR) AS directory FROM v WHERE status = 'failed'),
c AS (SELECT directory, count(*) AS n_files, count(*) FILTER (path IN (SELECT path FROM r)) AS n_registered FROM e GROUP BY 1)
SELECT *, CASE WHEN directory IN (SELECT directory FROM f) THEN 'retry' WHEN n_files = n_registered THEN 'done' ELSE 'pending' END AS state FROM c""",
)(
    lambda t: walk.walk_progress(
        t.files.select(F.col("version_id").cast("string").alias("directory"), F.concat(F.col("version_id").cast("string"), "path").alias("path")),
        t.files.join(t.contents.where(F.col("size") > 2048), "sha256", "left_semi").select(F.concat(F.col("version_id").cast("string"), "path").alias("path")),
        t.versions.where(F.col("status") == "failed").select(F.col("id").cast("string").alias("directory")),
    )
)
query(
    "walk_resume",
    """, o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY version_key DESC, id DESC) AS rn FROM v WHERE status IN ('incomplete', 'failed', 'running') AND progress_json IS NOT NULL),
x AS (SELECT label, id, CAST(json_extract(progress_json, '$.resume_count') AS BIGINT) AS c, CAST(json_extract(progress_json, '$.done_dirs') AS VARCHAR[]) AS d, CAST(json_extract(progress_json, '$.pending_dirs') AS VARCHAR[]) AS p FROM o WHERE rn = 1)
SELECT label, id, CASE WHEN c < 3 THEN 'resume' ELSE 'abandon' END AS action, CASE WHEN c < 3 THEN c + 1 ELSE 0 END AS resume_count, CASE WHEN c < 3 THEN len(d) ELSE 0 END AS n_done, CASE WHEN c < 3 THEN len(list_distinct(list_concat(d, p))) ELSE 1 END AS n_found FROM x""",
)(lambda t: walk.resume_decision(t.versions))
query(
    "walk_pending",
    """, e AS (SELECT DISTINCT CAST(version_id AS VARCHAR) AS directory FROM vf), f AS (SELECT CAST(id AS VARCHAR) AS directory FROM v WHERE status = 'failed'), d AS (SELECT CAST(id AS VARCHAR) AS directory FROM done)
SELECT directory, directory IN (SELECT directory FROM f) AS again FROM (SELECT directory FROM e UNION SELECT directory FROM f) WHERE directory NOT IN (SELECT directory FROM d)""",
)(
    lambda t: walk.pending_directories(
        t.files.select(F.col("version_id").cast("string").alias("directory")), t.versions.where(F.col("status") == "done").select(F.col("id").cast("string").alias("directory")), t.versions.where(F.col("status") == "failed").select(F.col("id").cast("string").alias("directory"))
    )
)
query(
    "restore_plan",
    """, p AS (SELECT DISTINCT path, ltrim(CASE WHEN path LIKE '/d1/%' THEN substr(path, 4) ELSE path END, '/') AS relative FROM (SELECT path FROM vf UNION ALL SELECT '/d1/../../' || substr(path, 2) FROM vf UNION ALL SELECT path || '/.DS_Store' FROM vf))
SELECT path, relative, CASE WHEN relative LIKE '../%' THEN 'unsafe' WHEN relative LIKE '%/.DS_Store' OR relative = '.DS_Store' THEN 'ignored' WHEN list_contains(string_split(relative, '/'), 'f3') THEN 'excluded' ELSE 'process' END AS kind FROM p""",
)(
    lambda t: I.restore_plan(
        t.files.select("path").unionByName(t.files.select(F.concat(F.lit("/d1/../../"), F.expr("substr(path, 2)")).alias("path"))).unionByName(t.files.select(F.concat("path", F.lit("/.DS_Store")).alias("path"))).distinct(), "/d1/", ["f3"]
    )
)
TEMPS = "SELECT CASE WHEN event_id % 2 = 0 THEN 'tmp_' ELSE 'f_' END || CAST(event_id AS VARCHAR) AS name, CAST(floor(value) AS BIGINT) AS size, ts AS modified FROM events"
query("tmp_sweep", f", x AS ({TEMPS}) SELECT count(*) AS n_files, CAST(coalesce(sum(size), 0) AS BIGINT) AS n_bytes FROM x WHERE name LIKE 'tmp~_%' ESCAPE '~' AND modified < TIMESTAMP '2024-01-20'")(
    lambda t: L.old_temporaries(
        t.samples.select(F.concat(F.when(F.col("id") % 2 == 0, "tmp_").otherwise("f_"), F.col("id").cast("string")).alias("name"), F.floor("used_pct").cast("bigint").alias("size"), F.col("sampled_at").alias("modified")), datetime(2024, 1, 20), ("tmp_",)
    )
)
query("db_backup_rotation", "SELECT folder, name FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY name DESC) AS rn FROM (SELECT label AS folder, version_key AS name FROM v)) WHERE rn > 7")(
    lambda t: L.beyond_rotation(t.versions.select(F.col("label").alias("folder"), F.col("version_key").alias("name")))
)
query("path_prefix_migration", "SELECT id, CASE WHEN stored_at LIKE '/vol1/%' THEN '/mnt/new' || substr(stored_at, 6) ELSE stored_at END AS stored_at, stored_at LIKE '/vol1/%' AS moved FROM cp")(
    lambda t: L.moved_paths(t.copies.select("id", "stored_at"), "stored_at", "/vol1", "/mnt/new")
)
STATES = "SELECT status, count(*) AS n, count(DISTINCT label) AS n_labels FROM {} GROUP BY 1"
states = lambda v: v.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("n_labels"))
query("rename_label", "SELECT id, CASE WHEN label = 'BUILDING/1' THEN 'renamed' ELSE label END AS label FROM v")(lambda t: L.rename_label(t.versions, "BUILDING/1", " renamed ").select("id", "label"))
query("reassign_owner", "SELECT label, CASE WHEN label = 'BUILDING/1' THEN CAST(3 AS BIGINT) ELSE owner_user_id END AS owner_user_id FROM labels_")(lambda t: L.with_owner(t.labels, "BUILDING/1", 3).select("label", "owner_user_id"))
query("owner_backfill", "SELECT label, coalesce(owner_user_id, 1) AS owner_user_id FROM labels_")(lambda t: L.owners_filled(t.labels, 1).select("label", "owner_user_id"))
query("delete_label", "SELECT version_id, path FROM vf WHERE version_id NOT IN (SELECT id FROM v WHERE label = 'BUILDING/1')")(lambda t: L.without_label(t.versions, t.files, "BUILDING/1").select("version_id", "path"))
query("delete_version", f"SELECT version_id, path FROM vf WHERE version_id <> {ONE}")(lambda t: t.files.where(F.col("version_id") != ONE).select("version_id", "path"))
query(
    "create_version",
    ", x AS (SELECT id, label, CASE WHEN label = 'BUILDING/1' AND status = 'running' THEN 'incomplete' ELSE status END AS status FROM v UNION ALL SELECT max(id) + 1, 'BUILDING/1', 'running' FROM v) SELECT id, label, status FROM x",
)(lambda t: L.with_new_version(t.versions, "BUILDING/1", "2001-08-02T00:00:00", NOW).select("id", "label", "status"))
query("finish_version", f"SELECT id, CASE WHEN id = {ONE} THEN 'failed' ELSE status END AS status, CASE WHEN id = {ONE} THEN {TS} ELSE finished_at END AS finished_at FROM v")(lambda t: L.finished(t.versions, ONE, "failed", NOW).select("id", "status", "finished_at"))
query("startup_stale_reset", f", x AS (SELECT label, CASE WHEN status = 'running' THEN 'incomplete' ELSE status END AS status FROM v) {STATES.format('x')}")(lambda t: states(L.with_status(t.versions, F.col("status") == "running", "incomplete")))
query("startup_jobs_reset", "SELECT id, CASE WHEN status = 'running' THEN 'error' ELSE status END AS status FROM jobs")(lambda t: L.with_status(t.jobs, F.col("status") == "running", "error").select("id", "status"))
query(
    "scalar_functions",
    "SELECT sha256, 12 + size + CAST(ceil(size / 1048576.0) AS BIGINT) * 20 AS stored_size, '/x/_content/' || substr(sha256, 1, 2) || '/' || sha256 AS content_path, sha256 AS base, regexp_replace(stored_at, '/[^/]+$', '') AS folder FROM fc",
)(lambda t: t.contents.select("sha256", X.stored_size(F.col("size")).alias("stored_size"), X.content_path(F.lit("/x"), F.col("sha256")).alias("content_path"), X.base_name(F.col("stored_at")).alias("base"), X.parent(F.col("stored_at")).alias("folder")))
query("disk_classes", "SELECT id, CASE WHEN used_pct >= 90 THEN 'critical' WHEN used_pct >= 75 THEN 'warning' ELSE 'ok' END AS class FROM samples")(lambda t: t.samples.select("id", X.disk_class(F.col("used_pct")).alias("class")))
query("event_windows", "SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS window_start, event_type, count(*) AS n_events, max(value) AS max_value FROM events GROUP BY 1, 2")(lambda t: walk.event_windows(t.events))


def streamed(t: Vault) -> DataFrame:
    """All files as listing files that a stream registers, twice over, the directories of some versions failed."""
    spark = t.files.sparkSession
    folder = f"{walk.shared_folder(spark)}/listings-{uuid.uuid4().hex}"
    rows = t.files.select(
        "version_id", X.parent(F.col("path")).alias("directory"), F.col("path").alias("Path"), F.col("id").alias("Size"), F.date_format("created_at", "yyyy-MM-dd").alias("ModTime"), F.lit(False).alias("IsDir"), (F.col("version_id") % 37 == 0).alias("failed")
    )
    rows.repartition(20).write.json(f"{folder}/in")
    for _ in range(2):  # the second run is delivered the same files again, and adds nothing
        walk.register_stream(walk.listings(spark, f"{folder}/in"), f"{folder}/out", f"{folder}/state-{uuid.uuid4().hex}", f"{folder}/retry").awaitTermination()
    return spark.read.schema(walk.FILE).parquet(f"{folder}/out").select("version_id", "path", "size", "mtime", "directory")


query("register_stream", "SELECT version_id, path, id AS size, strftime(created_at, '%Y-%m-%d') AS mtime, regexp_replace(path, '/[^/]+$', '') AS directory FROM vf WHERE version_id % 37 <> 0")(streamed)
SQL["event_windows_stream"] = SQL["event_windows"]
QUERIES["event_windows_stream"] = lambda spark, sf_dir: walk.windows_of_stream(spark, sf_dir, "events.parquet")

# listings, made up from the files
ITEMS = """, items AS (SELECT id, version_id, CASE version_id % 11 WHEN 0 THEN 'Personal Vault' || path WHEN 1 THEN 'a/Personal Vault' || path WHEN 2 THEN substr(path, 2) || '/.DS_Store' WHEN 3 THEN 'Recently Deleted' ELSE substr(path, 2) END AS p,
  version_id % 13 = 0 OR version_id % 11 = 3 AS d, CASE WHEN version_id % 17 = 0 THEN 'n/a' ELSE strftime(created_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN version_id % 2 = 0 THEN 'Z' ELSE '+01:00' END END AS m,
  CASE WHEN version_id % 5 > 0 THEN id END AS size, mtime FROM vf), named AS (SELECT *, regexp_extract(p, '[^/]*$') AS name, CASE WHEN m = 'n/a' THEN 0.0::DOUBLE WHEN version_id % 2 = 0 THEN mtime ELSE mtime - 3600 END AS t FROM items)"""
NAMES = "('.DS_Store', 'Thumbs.db', 'desktop.ini')"


def items(t: Vault) -> DataFrame:
    v = F.col("version_id")
    below = F.substr("path", F.lit(2))
    path = F.when(v % 11 == 0, F.concat(F.lit("Personal Vault"), "path")).when(v % 11 == 1, F.concat(F.lit("a/Personal Vault"), "path")).when(v % 11 == 2, F.concat(below, F.lit("/.DS_Store"))).when(v % 11 == 3, "Recently Deleted").otherwise(below)
    time = F.when(v % 17 == 0, "n/a").otherwise(F.concat(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"), F.when(v % 2 == 0, "Z").otherwise("+01:00")))
    rows = t.files.select(path.alias("Path"), F.when(v % 5 > 0, F.col("id")).alias("Size"), time.alias("ModTime"), ((v % 13 == 0) | (v % 11 == 3)).alias("IsDir"), v.cast("string").alias("folder"))
    return rows.withColumn("Name", F.element_at(F.split("Path", "/"), -1))


query("list_files_recursive", ITEMS + f" SELECT p AS path, coalesce(size, 0) AS size, t AS mtime FROM named WHERE NOT d AND name NOT IN {NAMES} AND split_part(p, '/', 1) NOT IN ('Personal Vault', 'Cofre Pessoal')")(lambda t: G.recursive_files(items(t)))
query(
    "list_one_level",
    ITEMS + f" SELECT CASE WHEN d THEN 'directory' ELSE 'file' END AS kind, CAST(version_id AS VARCHAR) || '/' || name AS path, CASE WHEN NOT d THEN coalesce(size, 0) END AS size, CASE WHEN NOT d THEN t END AS mtime FROM named WHERE CASE WHEN d THEN name NOT IN ('Personal Vault', 'Cofre Pessoal', 'Recently Deleted') ELSE name NOT IN {NAMES} END",
)(lambda t: G.one_level(items(t), F.col("folder")))
query("browse_folders", ITEMS + " SELECT name, p AS path FROM named WHERE d AND name NOT IN ('Personal Vault', 'Cofre Pessoal')")(lambda t: G.folders(items(t)))
CONFIG = '{"ALGERIA": {"type": "iclouddrive", "service": "photos"}, "BRAZIL": {"type": "iclouddrive", "service": "drive"}, "CHINA": {"type": "onedrive"}}'
query("remote_strategy", "SELECT remote_name, CASE remote_name WHEN 'ALGERIA' THEN 'photos' WHEN 'BRAZIL' THEN 'drive' END AS service, remote_name = 'ALGERIA' AS walks FROM clouds")(
    lambda t: t.cloud_jobs.select("remote_name", G.remote_service(F.lit(CONFIG), F.col("remote_name")).alias("service")).select("remote_name", "service", G.uses_walk(F.col("service")).alias("walks"))
)
query("list_remotes", "SELECT remote_name AS remote FROM clouds")(lambda t: t.cloud_jobs.agg(F.concat_ws("\n", F.lit(" "), F.collect_list(F.concat("remote_name", F.lit(":"))), F.lit("")).alias("x")).select(F.explode(G.remotes(F.col("x"))).alias("remote")))

# writes
NEW = f""", new AS (SELECT version_id, path, sha256, mtime + 1 AS mtime, id AS ordinal FROM vf WHERE version_id = {ONE} UNION ALL SELECT {ONE}, '/n' || CAST(version_id AS VARCHAR) || path, sha256, mtime, id FROM vf WHERE version_id % 50 = 1
  UNION ALL SELECT {ONE}, '/n' || CAST(version_id AS VARCHAR) || path, 'other', mtime, id - 1000000000 FROM vf WHERE version_id % 50 = 1)"""


def fresh(t: Vault) -> DataFrame:
    """Rows for one version: its own paths again, and new ones, each twice."""
    own = t.files.where(F.col("version_id") == ONE).select("version_id", "path", "sha256", (F.col("mtime") + 1).alias("mtime"), F.col("id").alias("ordinal"))
    some = t.files.where(F.col("version_id") % 50 == 1)
    path = F.concat(F.lit("/n"), F.col("version_id").cast("string"), "path")
    late = some.select(F.lit(ONE).cast("bigint").alias("version_id"), path.alias("path"), "sha256", "mtime", F.col("id").alias("ordinal"))
    return own.unionByName(late).unionByName(late.withColumns({"sha256": F.lit("other"), "ordinal": F.col("ordinal") - 1_000_000_000}))


query(
    "upsert_files",
    NEW + """, l AS (SELECT version_id, path, max_by(sha256, ordinal) AS sha256, max_by(mtime, ordinal) AS mtime FROM new GROUP BY 1, 2)
SELECT vf.id, vf.version_id, vf.path, coalesce(l.sha256, vf.sha256) AS sha256, coalesce(l.mtime, vf.mtime) AS mtime FROM vf LEFT JOIN l ON l.version_id = vf.version_id AND l.path = vf.path
UNION ALL SELECT (SELECT max(id) FROM vf) + row_number() OVER (ORDER BY version_id, path), version_id, path, sha256, mtime FROM l WHERE (version_id, path) NOT IN (SELECT (version_id, path) FROM vf)""",
)(lambda t: W.upserted(t.files, fresh(t)))
query("register_once", NEW + " SELECT version_id, path, min_by(sha256, ordinal) AS sha256, min_by(mtime, ordinal) AS mtime FROM new WHERE (version_id, path) NOT IN (SELECT (version_id, path) FROM vf) GROUP BY 1, 2")(lambda t: W.registered_once(t.files, fresh(t)))
query("insert_or_ignore", "SELECT id, label, status FROM v WHERE id % 3 = 0 UNION ALL SELECT id, 'new', status FROM v WHERE id % 3 <> 0 AND id % 2 = 0")(
    lambda t: W.inserted_or_ignored(t.versions.where(F.col("id") % 3 == 0).select("id", "label", "status"), t.versions.where(F.col("id") % 2 == 0).select("id", F.lit("new").alias("label"), "status"), ["id"])
)
query("merge_by_key", "SELECT id, CASE WHEN id % 2 = 0 THEN 'new' ELSE label END AS label, status FROM v WHERE id % 3 = 0 OR id % 2 = 0")(
    lambda t: W.merged(t.versions.where(F.col("id") % 3 == 0).select("id", "label", "status"), t.versions.where(F.col("id") % 2 == 0).select("id", F.lit("new").alias("label"), "status"), ["id"])
)
GONE = "SELECT label FROM labels_ WHERE label LIKE 'B%'"


def cascade(t: Vault) -> DataFrame:
    out = None
    for name, df in W.without_labels(t.labels, t.versions, t.files, pending(t), t.contents, t.labels.where(F.startswith("label", F.lit("B")))).items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


query(
    "delete_labels_cascade",
    PENDING + f""", lv AS (SELECT * FROM v WHERE label NOT IN ({GONE})), lf AS (SELECT * FROM vf WHERE version_id IN (SELECT id FROM lv))
SELECT 'labels' AS name, count(*) AS n FROM labels_ WHERE label NOT IN ({GONE}) UNION ALL SELECT 'versions', count(*) FROM lv UNION ALL SELECT 'files', count(*) FROM lf
UNION ALL SELECT 'contents', count(*) FROM fc WHERE sha256 IN (SELECT sha256 FROM lf) UNION ALL SELECT 'moves', count(*) FROM pending WHERE sha256 IN (SELECT sha256 FROM lf)""",
)(cascade)
query("disk_snapshot_append", "SELECT id, volume_path, used_pct, sampled_at FROM (SELECT *, row_number() OVER (PARTITION BY volume_path ORDER BY sampled_at DESC, id DESC) AS rn FROM samples) WHERE rn <= 48")(
    lambda t: W.with_samples(t.samples.where(F.col("id") % 2 == 0), t.samples.where(F.col("id") % 2 != 0), 48)
)

# further figures
query(
    "disk_trends",
    """, k AS (SELECT *, row_number() OVER (PARTITION BY volume_path ORDER BY sampled_at DESC, id DESC) AS rn FROM samples),
x AS (SELECT volume_path, count(*) AS n, max_by(used_pct, rn) AS first, min_by(used_pct, rn) AS last, min(used_pct) AS least, max(used_pct) AS most FROM k WHERE rn <= 48 GROUP BY 1)
SELECT *, last - first AS change, CASE WHEN n > 1 THEN CASE WHEN last - first > 5 THEN 'red' WHEN last - first > 1 THEN 'amber' ELSE 'green' END END AS class FROM x""",
)(lambda t: S.disk_trends(t.samples))
query("maintenance_order", "SELECT *, row_number() OVER (ORDER BY n_done + n_error DESC, job_type) AS place FROM (SELECT job_type, count(*) FILTER (status = 'done') AS n_done, count(*) FILTER (status = 'error') AS n_error, max(started_at) AS last_run FROM jobs GROUP BY 1)")(
    lambda t: S.types_by_runs(t.jobs)
)
query("labels_by_count", "SELECT l.label, max(CASE WHEN v.status = 'done' THEN finished_at END) AS last_done_at, count(*) FILTER (v.status = 'done') AS n_done FROM labels_ l LEFT JOIN v USING (label) WHERE l.status = 'active' GROUP BY 1")(
    lambda t: S.labels_by_count(t.labels, t.versions)
)
query("retention_counts", SQL["retention_plan"].removeprefix(TABLES).replace("SELECT id, label, tier, row_number()", "SELECT label, tier, count(*) FILTER (keep) AS n_kept, count(*) FILTER (NOT keep) AS n_deleted FROM (SELECT id, label, tier, row_number()") + ") GROUP BY 1, 2")(
    lambda t: L.retention_counts(t.versions, NOW)
)
query("cleanup_preview_totals", "SELECT count(DISTINCT label) AS n_labels, count(*) AS n_versions FROM v WHERE created_at < TIMESTAMP '2001-01-01' AND status <> 'running' AND id NOT IN (SELECT id FROM last_id)")(lambda t: L.previewed(t.versions, CUTOFF))
query("cleanup_by_date_of_label", "SELECT id, label FROM v WHERE created_at < TIMESTAMP '2001-01-01' AND status <> 'running' AND id NOT IN (SELECT id FROM last_id) AND label = 'BUILDING/1'")(lambda t: L.before_date(t.versions, CUTOFF, "BUILDING/1").select("id", "label"))
query("latest_by_key", "SELECT label, max_by(id, version_key) AS id, max(version_key) AS version_key FROM done GROUP BY 1")(lambda t: C.latest_by_key(t.versions))
query("files_page", "SELECT id, path FROM vf ORDER BY id LIMIT 500 OFFSET 1000")(lambda t: C.page(t.files.select("id", "path"), ["id"], 500, 1000))
query(
    "file_access",
    "SELECT vf.id, l.label, l.owner_user_id, u.id AS user_id FROM vf JOIN v ON v.id = vf.version_id JOIN labels_ l ON l.label = v.label JOIN users_ u ON u.role = 'admin' OR u.id = l.owner_user_id",
)(lambda t: R.file_access(t.files, t.versions, t.labels, t.users))
query("absorb_counts", f""", r AS (SELECT id AS target FROM v WHERE status = 'running' ORDER BY id LIMIT 1), s AS (SELECT path FROM vf WHERE version_id = {ONE}), n AS (SELECT count(*) FILTER (path NOT IN (SELECT path FROM vf WHERE version_id = {TWO})) AS inherited, count(*) AS n FROM s)
SELECT status = 'running' AS allowed, CASE WHEN status = 'running' THEN inherited ELSE 0 END AS inherited, CASE WHEN status = 'running' THEN n - inherited ELSE 0 END AS skipped FROM v, n WHERE id = {TWO}""")(lambda t: I.inherit_counts(t.versions, t.files, ONE, TWO))
query("register_results", f", {ASKED} SELECT ordinal, path, fc.sha256 IS NOT NULL AS registered, CASE WHEN fc.sha256 IS NOT NULL THEN 'registered' ELSE 'missing' END AS reason FROM asked LEFT JOIN fc USING (sha256)")(lambda t: I.register_results(asked(t), t.contents))
query(
    "request_bounds",
    ", a AS (SELECT id AS ordinal, id // 40000 AS batch, CASE WHEN id % 9 = 0 THEN substr(sha256, 2) ELSE sha256 END AS sha256, id % 7 - 1 AS size FROM vf) SELECT ordinal, length(sha256) = 64 AND size >= 0 AND count(*) OVER (PARTITION BY batch) <= 500 AS valid FROM a",
)(
    lambda t: I.valid_requests(
        t.files.select(F.col("id").alias("ordinal"), F.floor(F.col("id") / 40000).alias("batch"), F.when(F.col("id") % 9 == 0, F.substr("sha256", F.lit(2))).otherwise(F.col("sha256")).alias("sha256"), (F.col("id") % 7 - 1).alias("size"))
    )
)
query("restore_subset", "SELECT DISTINCT path, substr(path, 5) AS relative, CASE WHEN path = '/d1/f3' THEN 'excluded' ELSE 'process' END AS kind FROM vf WHERE path LIKE '/d1/%'")(lambda t: I.restore_plan(t.files.select("path").distinct(), "/d1/", ["f3"], only_below=True))
query(
    "path_prefix_counts",
    "SELECT 'copies' AS name, count(*) AS n_rows, count(*) FILTER (stored_at LIKE '/vol1/%') AS n_moved, count(*) FILTER (stored_at LIKE '/vol2/%') AS n_new FROM cp UNION ALL SELECT 'contents', count(*), count(*) FILTER (stored_at LIKE '/vol1/%'), count(*) FILTER (stored_at LIKE '/vol2/%') FROM fc",
)(lambda t: L.prefix_counts({"copies": (t.copies, "stored_at"), "contents": (t.contents, "stored_at")}, "/vol1", "/vol2"))
query(
    "daily_digest_totals",
    CHANGES
    + """ SELECT count(*) AS n_versions, count(DISTINCT label) AS n_labels, CAST(coalesce(sum(added), 0) AS BIGINT) AS added, CAST(coalesce(sum(modified), 0) AS BIGINT) AS modified, CAST(coalesce(sum(removed), 0) AS BIGINT) AS removed
FROM v LEFT JOIN changes USING (id) WHERE created_at >= TIMESTAMP '2001-07-31 02:00:00' AND created_at < TIMESTAMP '2001-08-01 02:00:00'""",
)(lambda t: S.digest_totals(t.versions, t.files, DAY, "Etc/GMT+2"))

# texts and checks
query(
    "display_texts",
    """, x AS (SELECT id, CASE WHEN id % 6 <> 1 THEN (id * 7919) % 200000 // 360 * 360 + id % 97 END AS s, (id * 104729) % 70000000 AS a, sampled_at FROM samples)
SELECT id, CASE WHEN s IS NULL THEN '—' WHEN s < 60 THEN CAST(s AS VARCHAR) || 's' WHEN s < 3600 THEN CAST(s // 60 AS VARCHAR) || 'min' ELSE printf('%.1fh', s / 3600.0::DOUBLE) END AS duration,
CASE WHEN s IS NULL THEN '—' WHEN s < 60 THEN CAST(s AS VARCHAR) || 's' WHEN s < 3600 THEN CAST(s // 60 AS VARCHAR) || 'min ' || CAST(s % 60 AS VARCHAR) || 's' ELSE printf('%.1fh', s / 3600.0::DOUBLE) END AS duration_split,
CASE WHEN a < 60 THEN 'agora' WHEN a < 3600 THEN 'há ' || (a // 60) || 'min' WHEN a < 86400 THEN 'há ' || (a // 3600) || 'h' WHEN a // 86400 < 30 THEN 'há ' || (a // 86400) || 'd' WHEN a // 86400 // 30 = 1 THEN 'há 1 mês'
  WHEN a // 86400 // 30 < 12 THEN 'há ' || (a // 86400 // 30) || ' meses' ELSE 'há ' || (a // 86400 // 30 // 12) || 'a' END AS age,
CASE WHEN a < 10 THEN 'agora' WHEN a < 60 THEN a || 's atrás' WHEN a < 3600 THEN (a // 60) || 'min atrás' WHEN a < 86400 THEN (a // 3600) || 'h atrás' WHEN a < 2592000 THEN (a // 86400) || 'd atrás' ELSE strftime(sampled_at, '%Y-%m-%d') END AS relative,
CASE WHEN a < 1024 THEN printf('%.1f B', a * 1.0::DOUBLE) WHEN a < 1048576 THEN printf('%.1f KB', a / 1024.0::DOUBLE) ELSE printf('%.1f MB', a / 1048576.0::DOUBLE) END AS size FROM x""",
)(
    lambda t: t.samples.select("id", F.when(F.col("id") % 6 != 1, F.floor(F.col("id") * 7919 % 200000 / 360) * 360 + F.col("id") % 97).alias("s"), (F.col("id") * 104729 % 70000000).alias("a"), "sampled_at").select(
        "id", *[X.duration_text(F.col("s").cast("double"), k).alias(n) for k, n in (("whole", "duration"), ("split", "duration_split"))], X.age_text(F.col("a")).alias("age"), X.relative_text(F.col("a"), F.col("sampled_at")).alias("relative"), X.human_bytes(F.col("a")).alias("size"),
    )
)
query("stale_labels", f"SELECT l.label, last IS NULL OR last < {TS} - INTERVAL 30 DAY AS stale FROM labels_ l LEFT JOIN (SELECT label, max(finished_at) AS last FROM done GROUP BY 1) USING (label) WHERE status = 'active'")(
    lambda t: S.label_activity(t.labels, t.versions).select("label", X.stale(F.col("last_done_at"), F.lit(NOW).cast("timestamp_ntz")).alias("stale"))
)
query("sample_millis", "SELECT id, epoch_us(sampled_at) // 1000 AS millis FROM samples")(lambda t: t.samples.select("id", X.epoch_millis(F.col("sampled_at")).alias("millis")))
query("job_last_lines", "SELECT id, CASE WHEN id % 2 = 0 THEN 'end ' || CAST(id AS VARCHAR) ELSE '' END AS line FROM jobs")(lambda t: t.jobs.select("id", X.last_line(F.when(F.col("id") % 2 == 0, F.concat(F.lit("begin\n\nend "), F.col("id").cast("string"), F.lit("\n"))).otherwise(F.lit("\n"))).alias("line")))
query("version_gates", "SELECT id, (id % 9, id % 11) >= (2, 6) AS checks, id % 10 <> 3 AND (id % 9, id % 11) >= (7, 8) AS registers FROM jobs")(
    lambda t: t.jobs.select(
        "id", X.at_least(F.concat_ws(".", F.col("id") % 9, F.col("id") % 11, F.lit("x")), 2, 6).alias("checks"),
        X.at_least(F.when(F.col("id") % 10 == 3, "old").otherwise(F.concat_ws(".", F.col("id") % 9, F.col("id") % 11)), 7, 8).alias("registers"),
    )
)
query(
    "checked_names",
    """, x AS (SELECT id, CASE id % 4 WHEN 0 THEN 'fotos_' || id WHEN 1 THEN 'a b' || id WHEN 2 THEN repeat('x', 70) ELSE 'ok-' || id END AS name, CASE id % 6 WHEN 0 THEN '0 2 * * *' WHEN 1 THEN '0 2 * *' WHEN 2 THEN '61 2 * * *' WHEN 3 THEN '*/5 1-3,7 1 jan mon-fri' WHEN 4 THEN '5-3 * * * *' ELSE 'x * * * *' END AS cron FROM jobs)
SELECT id, id % 4 IN (0, 3) AS valid_name, id % 6 IN (0, 3) AS valid_cron, CASE id % 4 WHEN 1 THEN 'a%20b' || id ELSE name END AS quoted FROM x""",
)(
    lambda t: t.jobs.select(
        "id", F.when(F.col("id") % 4 == 0, F.concat(F.lit("fotos_"), F.col("id"))).when(F.col("id") % 4 == 1, F.concat(F.lit("a b"), F.col("id"))).when(F.col("id") % 4 == 2, "x" * 70).otherwise(F.concat(F.lit("ok-"), F.col("id"))).alias("name"),
        F.element_at(F.array(*map(F.lit, ("0 2 * * *", "0 2 * *", "61 2 * * *", "*/5 1-3,7 1 jan mon-fri", "5-3 * * * *", "x * * * *"))), (F.col("id") % 6 + 1).cast("int")).alias("cron"),
    ).select("id", X.valid_remote(F.col("name")).alias("valid_name"), X.valid_cron(F.col("cron")).alias("valid_cron"), X.quoted_name(F.col("name")).alias("quoted"))
)
query("decoded_paths", "SELECT id, CASE WHEN id % 2 = 0 THEN path ELSE '/' || path || '?' END AS path FROM vf")(
    lambda t: t.files.select("id", X.decoded_path(F.when(F.col("id") % 2 == 0, F.base64(F.encode("path", "utf-8"))).otherwise(F.concat(F.lit("/"), "path", F.lit("?")))).alias("path"))
)
query("checkpoints", "SELECT id, progress_json FROM v WHERE progress_json IS NOT NULL")(
    lambda t: t.versions.where(F.col("progress_json").isNotNull()).select("id", X.checkpoint(F.col("progress_json")).alias("c")).select("id", walk.saved_checkpoint(F.col("c.done_dirs"), F.col("c.pending_dirs"), F.col("c.resume_count")).alias("progress_json"))
)
KEY, FIRST = bytes(range(32)), bytes(range(100, 112))
query("encrypted_frames", "SELECT sha256, 12 + 64 + CAST(ceil(64 / 10.0) AS BIGINT) * 20 AS stored, sha256 AS opened FROM fc")(
    lambda t: t.contents.select("sha256", frame.encrypted(F.col("sha256").cast("binary"), F.lit(KEY), F.lit(FIRST), 10).alias("f")).select(
        "sha256", F.octet_length("f").cast("bigint").alias("stored"), F.concat_ws("", F.transform(frame.decrypted(F.col("f"), F.lit(KEY), 10), lambda x: x.cast("string"))).alias("opened")
    )
)
