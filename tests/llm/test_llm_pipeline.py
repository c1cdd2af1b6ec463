"""The registered queries against DuckDB, and the pipeline against brute-force stages."""

import collections
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from cairn.llm import toxicity
from cairn.llm.common import table
from cairn.llm.queries import QUERIES, SQL
from tests.llm.test_llm_operators import exact_components, low, words

TABLES = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_agree_with_sql(spark, name):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{TABLES}/documents.parquet'")
    want = c.sql(SQL[name])
    columns = sorted(want.columns)
    at = [want.columns.index(x) for x in columns]
    df = QUERIES[name](spark, TABLES)
    assert sorted(df.columns) == columns
    assert collections.Counter(tuple(r[x] for x in columns) for r in df.collect()) == collections.Counter(tuple(r[i] for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_queries_cover_the_table(spark, name):
    n = table(spark, TABLES, "documents").count()
    found = QUERIES[name](spark, TABLES)
    assert found.select("doc_id").distinct().count() == n and (name.startswith("op8") or found.count() == n)


def marked_up(spark, folder):
    """documents with names that operators use, repeated rows, nulls and copies."""
    rnd = random.Random(21)
    stock = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6))) for _ in range(400)]
    say = lambda n: " ".join(rnd.choice(stock) for _ in range(n))
    texts = [say(rnd.randint(1, 120)) + (" zqvile gromp" if i % 7 == 0 else "") for i in range(240)]
    for i in range(20):  # exact copies in other letters, near copies
        texts.append(texts[i * 3 + 1].upper())
        w = texts[100 + i].split()
        texts.append(" ".join([*w, "tail"]))
    texts += [None, "", " \n", texts[5], say(3000)]
    rows = [(i, t, "en", ["s0", "s1", None, "s2"][min(3, i % 5)], len(t or ""), "k", 0.5, 3, True, 9, "d", i, "g") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], rows[50]]
    columns = "doc_id long, text string, lang string, source string, n_chars long, kept string, score double, size int, cut boolean, n_bytes long, digest string, component_id long, shard string"
    spark.createDataFrame(rows, columns).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int("zqvile" in low(t))) for i, t in enumerate(texts)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_run_by_brute_force(spark, tmp_path):
    rows = marked_up(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = [docs]
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, kept[-1], str(tmp_path)).cache()
        assert out.columns == docs.columns
        kept.append(out)
    have = [collections.Counter(tuple(r) for r in x.collect()) for x in kept]
    # toxicity: what the classifier predicts goes, others stay, repeated rows too
    toxic = {r["doc_id"] for r in toxicity.score_documents(docs, table(spark, str(tmp_path), "labels")).where("predicted = 1").collect()}
    assert have[1] == collections.Counter(r for r in rows if r[0] not in toxic)
    marked = {r[0] for r in rows if "zqvile" in low(r[1])}
    assert toxic <= marked and len(toxic) > 0.8 * len(marked)
    # exact copies: the least identifier of each folded text, once
    least = {}
    for r in sorted(set(have[1]), key=lambda r: r[0]):
        least.setdefault(low(r[1]), r)
    assert have[2] == collections.Counter(least.values())
    # near copies: the least of each component, once
    parts = exact_components([(r[0], r[1]) for r in have[2]], 5, 80)
    assert have[3] == collections.Counter(r for r in have[2] if parts[r[0]][1] == r[0])
    # mixing: words taken of each source near its target, no document more than twice
    size = lambda r: len(words(r[1]))
    total, taken = collections.Counter(), collections.Counter()
    for r in have[3]:
        total[r[3]] += size(r)
    for r, n in have[4].items():
        assert n <= 2 and r in have[3]
        taken[r[3]] += n * size(r)
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight, fixed = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {}
    while True:
        level = (1.5 * sum(total.values()) - sum(fixed.values())) / sum(weight[s] for s in names if s not in fixed)
        over = [s for s in names if s not in fixed and level * weight[s] > 2 * total[s]]
        if not over:
            break
        fixed |= {s: 2 * total[s] for s in over}
    for s in names:
        assert abs(taken[s] - fixed.get(s, level * weight[s])) <= max(size(r) for r in have[3] if r[3] == s)
    # packing: all pieces of all documents of the mixture, whole, in sequences of 2048 at most
    packed = P.STAGES[-1][1](spark, kept[-1], str(tmp_path)).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path(P.VOCABULARY))
    pieces, places = collections.Counter(), collections.defaultdict(list)
    for r in packed:
        pieces[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    want = collections.Counter()
    for r, n in have[4].items():
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for k in range(-(-len(ids) // 2048)):
            length = (len(ids) - 1) % 2048 + 1 if k == 0 else 2048
            want[r[0], k, at, length, zlib.crc32(ids[at : at + length].tobytes())] += n
            at += length
    assert pieces == want
    for spots in places.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 2048
    # run() is the stages one after the other
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in P.run(spark, str(tmp_path)).collect()) == want


def test_run_on_an_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
    for name, query in QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name


def test_stages_on_the_smallest_tables(spark):
    docs = table(spark, TABLES, "documents")
    kept = [docs]
    for _, stage in P.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], TABLES).cache())
    ids = [[r["doc_id"] for r in x.select("doc_id").collect()] for x in kept]
    predicted = {r["doc_id"] for r in toxicity.score_documents(docs, table(spark, TABLES, "labels")).where("predicted = 0").collect()}
    assert set(ids[1]) == predicted < set(ids[0])
    assert max(collections.Counter(ids[4]).values()) <= 2


def test_null_identifiers_and_ties(spark, tmp_path):
    """Rows without identifier, and many equal rows, through every query."""
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text, "en", "s0", 0)] * 5 + [(None, None, None, None, None)] * 2 + [(i, text, "en", "s0", 0) for i in range(12)] + [(3, text, "en", "s0", 0)] * 3 + [(50, "other words here", "en", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 1), (2, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = {name: [r.asDict() for r in query(spark, str(tmp_path)).collect()] for name, query in QUERIES.items()}
    for name, got in found.items():
        assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(r[0] for r in rows), name
    slots = collections.defaultdict(list)
    for r in found["op4_shard_tree"]:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert len({r["shard"] for r in found["op4_shard_tree"] if r["doc_id"] is None}) == 1
    assert all(r["component_id"] == (r["doc_id"] if r["doc_id"] in (None, 50) else 0) for r in found["op5_near_dedup"])
    assert {(r["keep_id"], r["group_size"]) for r in found["op6_exact_dedup"]} == {(11, 20), (None, 2), (50, 1)}
    assert all(r["taken"] <= 2 * r["size"] for r in found["op1_mix_sources"])
    places = collections.defaultdict(list)
    for r in found["op8_pack_sequences"]:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert len(places) == 1 and all(sum(n for _, n in v) <= 2048 for v in places.values())
    packed = P.run(spark, str(tmp_path)).collect()
    # one of the equal texts by its least identifier, and rows without identifier one of each text that is left
    assert {r["doc_id"] for r in packed} <= {None, 0, 50}
