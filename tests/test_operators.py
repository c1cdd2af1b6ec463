"""Cases with known results."""

import hashlib
import json
from datetime import datetime, timedelta, timezone
from decimal import ROUND_HALF_UP, Decimal

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
from cairn.sources import listing as G
from cairn.sources import vault
from cairn.streaming import walk

T0 = datetime(2026, 1, 1)


def versions(spark, rows):
    return spark.createDataFrame(rows, "id bigint, label string, version_key string, created_at timestamp_ntz, finished_at timestamp_ntz, status string")


def test_mixed_diff(spark):
    files = spark.createDataFrame([(1, "kept", "s"), (1, "changed", "o"), (1, "gone", "d"), (2, "kept", "s"), (2, "changed", "n"), (2, "fresh", "a")], "version_id bigint, path string, sha256 string")
    contents = spark.createDataFrame([("o", 5), ("n", 19)], "sha256 string, size bigint")
    got = {r["path"]: (r["kind"], r["delta"]) for r in C.compare_versions(files, contents, 1, 2).collect()}
    assert got == {"kept": ("unchanged", 0), "changed": ("modified", 14), "gone": ("deleted", 0), "fresh": ("added", 0)}


def test_reclaimable_counts_unfinished(spark):
    v = versions(spark, [(1, "a", "1", T0, None, "running"), (2, "a", "2", T0 + timedelta(1), T0, "done")])
    files = spark.createDataFrame([(1, "f", "x"), (2, "f", "y")], "version_id bigint, path string, sha256 string")
    contents = spark.createDataFrame([("x", 10), ("y", 7)], "sha256 string, size bigint")
    assert C.reclaimable_bytes(v, files, contents).first()[0] == 10


def test_register_last_wins(spark):
    files = spark.createDataFrame([(1, "p", "old", 1.0)], "version_id bigint, path string, sha256 string, mtime double")
    contents = spark.createDataFrame([("a", 1), ("b", 1)], "sha256 string, size bigint")
    asked = spark.createDataFrame([(0, "p", "a", 2.0), (1, "p", "b", 3.0), (2, "q", "f", 3.0)], "ordinal bigint, path string, sha256 string, mtime double")
    assert [tuple(r) for r in I.register_batch(asked, files, contents, 1).collect()] == [("p", "b", 3.0)]
    assert tuple(I.register_counts(asked, contents).first()) == (2, 1)


def test_keep_n_and_orphans(spark):
    v = versions(spark, [(i, "a", str(i), T0, None, "done") for i in range(1, 5)])
    assert sorted(r["id"] for r in L.beyond_newest(v, 2).collect()) == [1, 2]
    assert L.beyond_newest(v, 10).count() == 0
    files = spark.createDataFrame([(1, "f", "x")], "version_id bigint, path string, sha256 string")
    contents = spark.createDataFrame([("x", 10), ("y", 7)], "sha256 string, size bigint")
    assert [r["sha256"] for r in L.orphan_contents(files, contents).collect()] == ["y"]


def test_new_version_makes_old_incomplete(spark):
    v = versions(spark, [(1, "a", "1", T0, None, "running")])
    assert {r["id"]: r["status"] for r in L.with_new_version(v, "a", "2", T0).collect()} == {1: "incomplete", 2: "running"}


def test_integrity_marks_all_versions(spark):
    v = versions(spark, [(1, "a", "1", T0, T0, "done"), (2, "a", "2", T0 + timedelta(1), T0, "done")])
    files = spark.createDataFrame([(1, "f", "x"), (2, "f", "x"), (2, "g", "y")], "version_id bigint, path string, sha256 string")
    present = spark.createDataFrame([("y",)], "sha256 string")
    assert sorted(r["id"] for r in L.damage(v, files, present).collect()) == [1, 2]


def test_replicas(spark):
    volumes = spark.createDataFrame([("/a", 0, 0, 0, 5, False), ("/b", 1, 0, 0, 9, False), ("/c", 2, 0, 0, 0, True)], "path string, ord int, total bigint, used bigint, free bigint, degraded boolean")
    contents = spark.createDataFrame([("x", 1, "/a/_content/x"), ("y", 1, "/c/_content/y")], "sha256 string, size bigint, stored_at string")
    copies = spark.createDataFrame([(1, "x", "/a", "/a/_content/x"), (2, "y", "/c", "/c/_content/y")], "id bigint, sha256 string, volume_path string, stored_at string")
    assert {r["sha256"]: r["source"] for r in R.deficit(contents, copies, volumes, 2).collect()} == {"x": "/a", "y": None}
    assert [tuple(r) for r in R.placement(contents, copies, volumes, 2).collect()] == [("x", "/b")]
    assert R.pick_volume(volumes, 6).first()[0] == "/b"
    assert R.pick_volume(volumes, 100).first()[0] == "/b"


def test_migration_plan_is_one_greedy(spark):
    free = {"/b": 70, "/a": 100}
    sizes = {"big": 190, "c1": 40, "c2": 35, "c3": 30, "c4": 8, "held": 60, "moved": 1}
    contents = spark.createDataFrame([(s, n, f"/s/_content/{s[:2]}/{s}") for s, n in sizes.items()], "sha256 string, size bigint, stored_at string")
    copies = [(i, s, "/s", f"/s/_content/{s[:2]}/{s}") for i, s in enumerate(sizes) if s != "moved"] + [(10, "held", "/b", "/b/held"), (11, "moved", "/x", "/x/moved"), (12, "c4", "/x", "/x/c4")]
    found = R.migration_plan(spark.createDataFrame(copies, "id bigint, sha256 string, volume_path string, stored_at string"), contents, free, "/s").collect()
    # in the order of ids: to the target with most room while it has any, whether the content fits or not
    assert {r["sha256"]: (r["action"], r["volume_path"], r["new_primary"]) for r in found} == {
        "big": ("copy", "/a", "/a/_content/bi/big"), "c1": ("copy", "/b", "/b/_content/c1/c1"), "c2": ("copy", "/b", "/b/_content/c2/c2"), "c3": ("skip", None, None),
        "c4": ("skip", None, "/x/c4"), "held": ("there", None, "/b/held"), "moved": (None, None, "/x/moved"),
    }


def test_throttle_and_batches(spark):
    samples = spark.createDataFrame([(i, "/v", 1.0, T0 + timedelta(minutes=m)) for i, m in enumerate((0, 10, 30, 59, 61))], "id bigint, volume_path string, used_pct double, sampled_at timestamp_ntz")
    assert sorted(r["id"] for r in S.throttled(samples).collect()) == [0, 2, 4]
    rows = spark.createDataFrame([("g", str(i), 10) for i in range(5)], "group string, path string, size bigint")
    assert [r["batch"] for r in I.batches(rows, files=2).orderBy("path").collect()] == [0, 0, 1, 1, 2]
    assert [r["batch"] for r in I.batches(rows, size=25).orderBy("path").collect()] == [0, 0, 0, 1, 1]


def test_restore_classes(spark):
    paths = spark.createDataFrame([("/d/a/b",), ("/d/../../x",), ("/d/.DS_Store",), ("/d/skip/x",)], "path string")
    assert [r["kind"] for r in I.restore_plan(paths, "/d/", ["skip"]).collect()] == ["process", "unsafe", "ignored", "excluded"]


def test_stored_size(spark):
    sizes = spark.createDataFrame([(0,), (1,), (1 << 20,), ((1 << 20) + 1,)], "n bigint")
    assert [r[0] for r in sizes.select(X.stored_size(F.col("n"))).collect()] == [12, 33, 1048608, 1048629]


def test_stream_resumes(spark, tmp_path):
    source, sink, state, retry = (str(tmp_path / x) for x in ("in", "out", "state", "retry"))
    one = [(1, "d", "d/a", 1, "2026-01-01", False, False), (1, "d", "d/b", 2, "2026-01-01", False, False), (1, "x", "x/q", 2, "2026-01-01", False, True)]
    spark.createDataFrame(one, walk.LISTING).write.json(source)
    walk.register_stream(walk.listings(spark, source), sink, state, retry).awaitTermination()
    more = [(1, "e", "e/c", 3, "2026-01-02", False, False), (2, "d", "d/a", 1, "2026-01-03", False, False), (1, "x", "x/q", 2, "2026-01-02", False, False), (1, "e", "e/s", None, None, True, False)]
    spark.createDataFrame([*one[:2], *more], walk.LISTING).write.mode("append").json(source)
    walk.register_stream(walk.listings(spark, source), sink, state, retry).awaitTermination()
    got = spark.read.parquet(sink)
    assert sorted((r["version_id"], r["path"]) for r in got.collect()) == [(1, "d/a"), (1, "d/b"), (1, "e/c"), (1, "x/q"), (2, "d/a")]
    assert [tuple(r) for r in spark.read.parquet(retry).collect()] == [(1, "x")]


def walks(spark, rows):
    return spark.createDataFrame(rows, "id bigint, label string, version_key string, status string, progress_json string")


def test_walk_resumes_and_gives_up(spark):
    state = lambda n, done, pending: json.dumps({"done_dirs": done, "pending_dirs": pending, "resume_count": n})
    rows = [(9, "a", "2026-01-01", "failed", state(0, ["x"], ["y"])), (1, "a", "2026-01-02", "incomplete", state(2, ["x", "z"], ["y", "z"])), (2, "a", "2026-01-03", "incomplete", None)]
    rows += [(3, "b", "k", "failed", state(3, ["x"], [])), (4, "c", "k", "done", state(0, [], [])), (5, "d", "k", "running", "no json"), (6, "e", "k", "failed", state(0, [], []))]
    got = {r["label"]: tuple(r)[1:] for r in walk.resume_decision(walks(spark, rows)).collect()}
    assert got == {"a": (1, "resume", 3, 2, 3), "b": (3, "abandon", 0, 0, 1), "d": (5, "resume", 1, 0, 1), "e": (6, "resume", 1, 0, 1)}


def test_cleanup_goes_on_until_volumes_are_ready(spark):
    day = lambda n: T0 + timedelta(days=n)
    v = versions(spark, [(1, "a", "1", day(0), T0, "done"), (2, "a", "2", day(3), T0, "done"), (3, "b", "1", day(1), T0, "done"), (4, "b", "2", day(2), T0, "done"), (5, "b", "3", day(9), None, "failed"), (9, "a", "0", day(3), T0, "done")])
    files = spark.createDataFrame([(1, "f", "one"), (3, "f", "three"), (4, "f", "four"), (5, "f", "five"), (2, "f", "two"), (9, "f", "nine")], "version_id bigint, path string, sha256 string")
    contents = spark.createDataFrame([(s, 10) for s in ("one", "two", "three", "four", "five", "nine", "nobody")], "sha256 string, size bigint")
    copies = spark.createDataFrame([(s, "/a") for s in ("one", "three", "five", "nobody")] + [("three", "/b"), ("two", "/b")], "sha256 string, volume_path string")
    volumes = spark.createDataFrame([("/a", 5, False), ("/b", 0, False), ("/c", 0, True)], "path string, free bigint, degraded boolean")
    plan = lambda factor, limit: {r["id"]: (r["step"], r["n_ready"]) for r in L.cleanup_plan(v, files, contents, copies, volumes, factor, limit).collect()}
    assert plan(1, 5) == {}  # enough at the start
    assert plan(1, 25) == {5: (0, 1)}  # the failed version and what nobody holds make room
    assert plan(2, 10) == {5: (0, 1), 1: (1, 1), 3: (2, 2)}  # the oldest first, the last of each label never (of equal times the greater id)
    assert plan(2, 1000) == {5: (0, 0), 1: (1, 0), 3: (2, 0), 2: (3, 0)}


def test_lifecycle_reads_summaries(spark):
    texts = ["3 versão(ões) removidas, 5 arquivo(s) liberados (1.5 MB)", "2 versão(ões) removida(s)", "9 versão(ões) removida(s), (2 MB)", None]
    jobs = [("cleanup-by-date", "done", t) for t in texts] + [("cleanup-by-date", "failed", texts[0]), ("encrypt-existing", "done", texts[0])]
    labels = spark.createDataFrame([("a", T0), ("b", T0 - timedelta(days=31))], "label string, created_at timestamp_ntz")
    got = S.label_lifecycle(labels, spark.createDataFrame(jobs, "job_type string, status string, summary string"), T0).first()
    assert tuple(got) == (1, 3, 3_670_016)


def test_trees_and_hashes(spark, tmp_path):
    for name, text in {"a.txt": "hello", "sub/b.txt": "world!", "sub/.DS_Store": "x", "skip/c": "y", "_rclone_tmp_1": "zz"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    found = G.tree(spark, str(tmp_path))
    assert [tuple(r)[:2] for r in G.walked(found, ["skip"]).collect()] == [("_rclone_tmp_1", 2), ("a.txt", 5), ("sub/b.txt", 6)]
    assert abs(G.walked(found).where("path = 'a.txt'").first()["mtime"] - (tmp_path / "a.txt").stat().st_mtime) < 0.01
    sums = {r["path"]: (r["size"], r["sha256"]) for r in G.hashed(G.tree(spark, str(tmp_path), with_content=True)).collect()}
    assert sums["sub/b.txt"] == (6, hashlib.sha256(b"world!").hexdigest()) and len(sums) == 5
    assert [r["path"] for r in G.temporaries(spark, str(tmp_path), datetime.now() + timedelta(hours=1)).collect()] == ["_rclone_tmp_1"]
    assert G.temporaries(spark, str(tmp_path), datetime.now() - timedelta(hours=1)).count() == 0


def test_listings_and_damaged_lines(spark, tmp_path):
    items = [{"Path": "d/a.jpg", "Name": "a.jpg", "Size": 10, "ModTime": "2026-01-01T00:00:01.5Z", "IsDir": False}, {"Path": "Personal Vault/x", "Name": "x", "Size": 1, "ModTime": "bad", "IsDir": False}, {"Path": "d", "Name": "d", "IsDir": True}]
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "root.json").write_text(json.dumps(items))
    assert [tuple(r) for r in G.recursive_files(G.listing(spark, str(tmp_path / "l"))).collect()] == [("d/a.jpg", 10, datetime(2026, 1, 1, 0, 0, 1, 500000, timezone.utc).timestamp())]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "rows.json").write_text('{"id": 1}\n{"id": oops\n{"id": 3}\n')
    good, bad = G.tolerant(spark, str(tmp_path / "t"), "id bigint")
    assert sorted(r["id"] for r in good.collect()) == [1, 3] and [r["value"] for r in bad.collect()] == ['{"id": oops']
    assert G.page_bounds(1, 1001)[0] == "id >= 1 AND id < 501" and len(G.page_bounds(1, 1001)) == 3
    usage = {r["path"]: r["degraded"] for r in G.probe(spark, [str(tmp_path), str(tmp_path / "none")]).collect()}
    assert usage == {str(tmp_path): False, str(tmp_path / "none"): True}


def test_frames(spark):
    key, nonce = bytes(range(32)), bytes(range(200, 212))
    texts = [b"", b"a", b"0123456789", b"0123456789x", bytes(range(256)) * 3]
    rows = spark.createDataFrame([(t,) for t in texts], "t binary").select("t", frame.encrypted(F.col("t"), F.lit(key), F.lit(nonce), 10).alias("f"))
    for r in rows.select("*", frame.decrypted(F.col("f"), F.lit(key), 10).alias("back")).collect():
        assert bytes(r["f"][:12]) == nonce and b"".join(map(bytes, r["back"])) == bytes(r["t"])
        assert len(r["f"]) == 12 + len(r["t"]) + -(-len(r["t"]) // 10) * 20
        at, i = 12, 0
        while at < len(r["f"]):  # each chunk by itself, its nonce the frame's with its number XORed in
            n = int.from_bytes(r["f"][at : at + 4], "little")
            iv = bytes(a ^ b for a, b in zip(nonce, i.to_bytes(12, "little")))
            one = spark.range(1).select(F.aes_decrypt(F.lit(iv + bytes(r["f"][at + 4 : at + 4 + n])), F.lit(key), F.lit("GCM"))).first()[0]
            assert bytes(one) == bytes(r["t"])[10 * i : 10 * i + 10]
            at, i = at + 4 + n, i + 1
    keys = spark.createDataFrame([("A" * 43 + "=",), ("AAAA",), ("!",), (None,)], "k string").select(frame.valid_key(F.col("k"))).collect()
    assert [r[0] for r in keys] == [True, False, False, False]


def test_move_rounds_give_up_at_the_fifth(spark):
    queue = spark.createDataFrame([(s, f"/ssd/{s}", "/a", f"/a/{s}", n) for s, n in (("a", 0), ("b", 4), ("c", 3), ("d", 4), ("e", 0))], "sha256 string, ssd_path string, dest_volume string, dest_path string, retry_count bigint")
    outcomes = spark.createDataFrame([("a", "moved", None), ("b", "corrupt", None), ("c", "failed", None), ("d", "full", "/b"), ("e", "absent", None)], "sha256 string, outcome string, other_volume string")
    files = spark.createDataFrame([(1, "b"), (2, "b"), (2, "c")], "version_id bigint, sha256 string")
    done = M.move_round(queue, outcomes, files, 4)
    assert {r["sha256"]: (r["action"], r["retry_count"], r["dest_volume"], r["n_versions"]) for r in done.collect()} == {"a": ("moved", 0, "/a", 0), "b": ("abandoned", 5, "/a", 2), "c": ("waiting", 4, "/a", 0), "d": ("moved", 0, "/b", 0)}
    assert {r["sha256"]: r["retry_count"] for r in M.queue_after(queue, done).collect()} == {"c": 4, "e": 0}
    v = versions(spark, [(i, "l", str(i), T0, T0, "done") for i in (1, 2, 3)])
    assert {r["id"]: r["status"] for r in M.failed_versions(v, files, done).collect()} == {1: "failed", 2: "failed", 3: "done"}


def test_upserts_keep_ids(spark):
    files = spark.createDataFrame([(5, 1, "p", "old", 1.0)], "id bigint, version_id bigint, path string, sha256 string, mtime double")
    new = spark.createDataFrame([(1, "p", "a", 2.0, 0), (1, "p", "b", 3.0, 1), (1, "q", "c", 1.0, 2), (2, "p", "d", 1.0, 3)], "version_id bigint, path string, sha256 string, mtime double, ordinal bigint")
    assert sorted(tuple(r) for r in W.upserted(files, new).collect()) == [(5, 1, "p", "b", 3.0), (6, 1, "q", "c", 1.0), (7, 2, "p", "d", 1.0)]
    assert sorted(r["path"] for r in W.registered_once(files, new).where("version_id = 1").collect()) == ["q"]


def test_new_ids_have_no_gaps_whatever_the_partitions(spark):
    """Partitions that are joined by size or computed twice neither lose a row nor repeat a number."""
    rows = spark.range(30_000).select((F.col("id") % 3).alias("version_id"), F.concat(F.lit("/n"), F.col("id") * 7919 % 30_000).alias("path"), F.sha2(F.col("id").cast("string"), 256).alias("sha256"))
    held = spark.createDataFrame([(41,)], "id bigint")
    adviser = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(adviser, "200k")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = W.numbered(rows.repartition(20, "sha256"), held, ["version_id", "path"]).collect()
    finally:
        spark.conf.unset(adviser)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [(r["version_id"], r["path"]) for r in sorted(got, key=lambda r: r["id"])] == sorted((i % 3, f"/n{i * 7919 % 30_000}") for i in range(30_000))
    assert sorted(r["id"] for r in got) == list(range(42, 30_042))
    few = spark.createDataFrame([(2, "b"), (None, "b"), (2, None)], "version_id bigint, path string")
    assert [tuple(r) for r in W.numbered(few, held, ["version_id", "path"]).select("id", "version_id", "path").orderBy("id").collect()] == [(42, None, "b"), (43, 2, None), (44, 2, "b")]
    assert W.numbered(few.limit(0), held, ["version_id", "path"]).count() == 0


def test_tables_are_written(spark, tmp_path):
    table = spark.range(100)
    (path,) = W.exported({"t": table}, str(tmp_path), "2026-01-01")
    assert W.compacted(spark, path, str(tmp_path / "c"), 1).count() == 100
    assert len(list((tmp_path / "c").glob("part-*"))) == 1
    one, folder = vault.load(spark, "/root/testdata/sf0.001"), str(tmp_path / "v")
    vault.save(one, folder)
    two = vault.open_saved(spark, folder)
    assert C.reclaimable_bytes(two.versions, two.files, two.contents).first() == C.reclaimable_bytes(one.versions, one.files, one.contents).first()


def test_contents_are_written_and_copied(spark, tmp_path):
    rows = spark.createDataFrame([("/v/_content/aa/x", b"hello"), ("/v/_content/bb/y", b"")], "path string, body binary")
    got = {r["path"]: (r["size"], r["sha256"], r["whole"]) for r in W.contents_written(rows, str(tmp_path)).collect()}
    assert got == {"/v/_content/aa/x": (5, hashlib.sha256(b"hello").hexdigest(), True), "/v/_content/bb/y": (0, hashlib.sha256(b"").hexdigest(), True)}
    pairs = spark.createDataFrame([("/v/_content/aa/x", "/w/_content/aa/x"), ("/none", "/w/none")], "source string, path string")
    got = {r["path"]: (r["size"], r["whole"]) for r in W.contents_copied(pairs, str(tmp_path)).collect()}
    assert got == {"/w/_content/aa/x": (5, True), "/w/none": (None, False)} and (tmp_path / "w/_content/aa/x").read_bytes() == b"hello"
    assert not list(tmp_path.rglob("_tmp_*"))


def test_texts(spark):
    show = lambda c: spark.range(1).select(c).first()[0]
    assert [show(X.duration_text(F.lit(s).cast("double"), k)) for s, k in ((None, "whole"), (59.0, "whole"), (61.0, "whole"), (61.0, "split"), (90.0, "decimal"), (5400.0, "whole"))] == ["—", "59s", "1min", "1min 1s", "1.5min", "1.5h"]
    assert [show(X.age_text(F.lit(s))) for s in (59, 3599, 7200, 86400 * 29, 86400 * 30, 86400 * 60, 86400 * 400)] == ["agora", "há 59min", "há 2h", "há 29d", "há 1 mês", "há 2 meses", "há 1a"]
    assert [show(X.valid_cron(F.lit(t))) for t in ("0 1 * * *", " 0 1 * * * ", "*/0 1 * * *", "0 24 * * *", "0-5/2 1 last jan,3 sun", "0 1 * *", "")] == [True, True, False, False, True, False, False]
    assert [show(X.last_line(F.lit(t))) for t in ("a\nb\n\n", "", "\n")] == ["b", "", ""]
    assert [show(X.iso_seconds(F.lit(t))) for t in ("1970-01-01T00:00:01Z", "1970-01-01T01:00:00+01:00", "x")] == [1.0, 0.0, 0.0]
    begin, end = X.utc_range(F.lit(datetime(2026, 7, 1).date()), "Europe/Lisbon")
    assert (show(begin), show(end)) == (datetime(2026, 6, 30, 23), datetime(2026, 7, 1, 23))
    assert show(X.quoted_name(F.lit("a b*ü.txt"))) == "a%20b%2A%C3%BC.txt"


def test_one_decimal_is_rounded_by_its_exact_value(spark):
    """Ties, and numbers whose shortest text looks like one, as Python writes them; the pages round exact ties up."""
    numbers = [0.0, 0.04, 0.05, 0.15, 0.25, 0.35, 0.75, 1.45, 2.5, 9.95, 103.25, 1023.95, 0.1 * 3, 123456.05, 2.0**40 + 0.25, 2.0**52, 1e22, *(k / 20 for k in range(-9, 2000, 2)), *(s / 3600 for s in range(180, 400_000, 360))]
    shown = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", X.one_decimal(F.col("x")).alias("t"), X.one_decimal(F.col("x"), ties_up=True).alias("up")).collect()
    assert [(r["x"], r["t"]) for r in shown if r["t"] != f"{r['x']:.1f}"] == []
    exact = lambda x: str(Decimal(x).quantize(Decimal("0.1"), ROUND_HALF_UP))
    assert [(r["x"], r["up"]) for r in shown if r["x"] < 1e15 and r["up"] != exact(r["x"])] == []
    sizes = [(6400, "6.2 KB"), (6912, "6.8 KB"), (105728, "103.2 KB"), (1310720, "1.2 MB"), (1023, "1023.0 B"), (2**60, "1024.0 PB"), (None, None)]
    assert [r["t"] for r in spark.createDataFrame(sizes, "n bigint, want string").select(X.human_bytes(F.col("n")).alias("t")).collect()] == [t for _, t in sizes]
    show = lambda c: spark.range(1).select(c).first()[0]
    assert [show(X.duration_text(F.lit(s), k)) for s, k in ((2.5, "decimal"), (2.5, "whole"), (75.0, "decimal"), (4500.0, "decimal"), (4500.0, "whole"))] == ["2s", "3s", "1.2min", "1.2h", "1.3h"]
