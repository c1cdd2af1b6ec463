"""The catalogue tables in SQL over the driver's tables; every oracle query begins with these."""

TABLES = """WITH RECURSIVE customers AS (SELECT c_custkey, c_mktsegment, c_nationkey, c_mktsegment || '/' || CAST(c_nationkey AS VARCHAR) AS label FROM customer),
labels_ AS (SELECT DISTINCT label, c_mktsegment AS client_name, CASE WHEN c_nationkey % 4 <> 0 THEN CAST(c_nationkey % 4 AS BIGINT) END AS owner_user_id,
  CASE WHEN c_nationkey = 24 THEN 'archived' ELSE 'active' END AS status, TIMESTAMP '2001-06-01' + to_days(c_nationkey * 3) AS created_at FROM customers),
v0 AS (SELECT o_orderkey AS id, label, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '-' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS version_key, o_orderdate AS created_at,
  CASE WHEN o_orderstatus <> 'O' THEN 'done' WHEN o_orderkey % 3 = 0 THEN 'running' WHEN o_orderkey % 3 = 1 THEN 'failed' ELSE 'incomplete' END AS status
  FROM orders JOIN customers ON o_custkey = c_custkey),
v AS (SELECT *, CASE WHEN status IN ('done', 'failed') THEN created_at + to_seconds(id % 3600) END AS finished_at,
  CASE WHEN status <> 'done' AND id % 4 <> 0 THEN '{"done_dirs":["d' || CAST(id AS VARCHAR) || '"],"pending_dirs":["p","d' || CAST(id + id % 2 AS VARCHAR) || '"],"resume_count":' || CAST(id % 5 AS VARCHAR) || '}' END AS progress_json FROM v0),
vf AS (SELECT l_orderkey * 100 + CAST(substr(path, 3, 1) AS BIGINT) * 10 + CAST(substr(path, 6, 1) AS BIGINT) AS id, l_orderkey AS version_id, path, sha256('part-' || CAST(l_partkey AS VARCHAR)) AS sha256, CAST(epoch(l_shipdate) AS DOUBLE) AS mtime, l_shipdate AS created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, path ORDER BY l_shipdate DESC, l_partkey DESC, l_extendedprice DESC) AS rn FROM (
    SELECT *, '/d' || CAST(l_linenumber AS VARCHAR) || '/f' || CAST(l_suppkey % 10 AS VARCHAR) AS path FROM lineitem)) WHERE rn = 1),
fc AS (SELECT sha256('part-' || CAST(p_partkey AS VARCHAR)) AS sha256, CAST(p_size AS BIGINT) * 1024 AS size, p_partkey % 5 = 0 AS encrypted,
  TIMESTAMP '2001-07-31 06:00:00' + to_hours(CAST(p_partkey % 72 AS INTEGER)) AS created_at,
  '/vol' || CAST(p_partkey % 4 AS VARCHAR) || '/_content/' || substr(sha256('part-' || CAST(p_partkey AS VARCHAR)), 1, 2) || '/' || sha256('part-' || CAST(p_partkey AS VARCHAR)) AS stored_at FROM part),
cp AS (SELECT l_partkey * 4 + k AS id, sha256('part-' || CAST(l_partkey AS VARCHAR)) AS sha256, '/vol' || CAST(k AS VARCHAR) AS volume_path,
  '/vol' || CAST(k AS VARCHAR) || '/_content/' || substr(sha256('part-' || CAST(l_partkey AS VARCHAR)), 1, 2) || '/' || sha256('part-' || CAST(l_partkey AS VARCHAR)) AS stored_at
  FROM (SELECT DISTINCT l_partkey, l_suppkey % 4 AS k FROM lineitem) WHERE (l_partkey * 4 + k) % 5 <> 0 AND (l_partkey % 50 <> 0 OR k = 3)),
vol AS (SELECT * FROM (VALUES ('/vol0', 0, 1000, 400, 600, FALSE), ('/vol1', 1, 2000, 500, 1500, FALSE), ('/vol2', 2, 4000, 3990, 10, FALSE), ('/vol3', 3, 0, 0, 0, TRUE)) t(path, ord, total, used, free, degraded)),
users_ AS (SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'admin', 'admin'), (2, 'alice', 'user'), (3, 'bob', 'user')) t(id, username, role)),
jobs AS (SELECT event_id AS id, ['cleanup-by-date', 'auto-cleanup', 'cleanup-versions', 'nightly-cleanup', 'encrypt-existing'][event_id % 5 + 1] AS job_type, ts AS started_at,
  CASE WHEN event_id % 10 = 0 THEN 'error' WHEN event_id % 10 = 1 THEN 'failed' WHEN event_id % 10 = 2 THEN 'running' ELSE 'done' END AS status,
  CASE event_id % 6 WHEN 0 THEN CAST(event_id % 7 AS VARCHAR) || ' versão(ões) removidas, ' || CAST(event_id % 11 AS VARCHAR) || ' arquivo(s) liberados (' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || '.5 MB)'
    WHEN 3 THEN CAST(event_id % 7 AS VARCHAR) || ' versão(ões) removida(s), espaço liberado (' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || '.5 MB)' END AS summary FROM events),
samples AS (SELECT event_id AS id, '/vol' || CAST(user_id % 4 AS VARCHAR) AS volume_path, value AS used_pct, ts AS sampled_at FROM events),
clouds AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS remote_name, n_nationkey % 3 <> 0 AS enabled FROM nation),
fs AS (SELECT version_id, count(*) AS n_files, CAST(sum(coalesce(size, 0)) AS BIGINT) AS total_size FROM vf LEFT JOIN fc USING (sha256) GROUP BY version_id),
done AS (SELECT * FROM v WHERE status = 'done'),
last_id AS (SELECT label, max(id) AS id FROM done GROUP BY label),
keep_loose AS (SELECT v.* FROM v JOIN (SELECT label, max(created_at) AS created_at FROM done GROUP BY label) m USING (label, created_at)),
keep_done AS (SELECT * FROM keep_loose WHERE status = 'done')
"""
