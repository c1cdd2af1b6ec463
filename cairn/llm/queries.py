"""The queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import exact, language, mixing, near, packing, pii, quality, sharding, tokens, toxicity
from cairn.llm.common import table

SHARD_COUNT = 40
VOCABULARY = "byte_bpe_50k.json"


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixture = mixing.mix(table(spark, sf_dir, "documents"))
    draws = F.concat_ws(",", F.transform("draws", lambda d: F.concat_ws(":", d["pass"], d["shard"])))
    return mixture.select("doc_id", "size", "source_size", "target", "taken", draws.alias("draws"))


def op2_find_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[f"n_{k}" for k in pii.KINDS], F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op3_score_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_rows(table(spark, sf_dir, "documents"), sharding.even(SHARD_COUNT), sharding.with_shard(sharding.even(SHARD_COUNT)))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_dedup(table(spark, sf_dir, "documents"), size=4)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.score_texts(table(spark, sf_dir, "documents"))


def op8_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op9_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op10_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.apply_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources,
        op2_find_pii,
        op3_score_toxicity,
        op4_shard_tree,
        op5_near_dedup,
        op6_exact_dedup,
        op7_language_model,
        op8_pack_sequences,
        op9_count_tokens,
        op10_host_rules,
    )
}
#: Words in DuckDB: white space is that of common.SPACE.
_SPLIT = r"list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _host_rules_sql() -> str:
    low, high = quality.HOST_RATES
    weak, strong = quality.PRIOR_DOCS
    rules = {
        "words": f"n_words < {quality.MIN_WORDS}",
        "repeats": f"100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words",
        "symbols": f"100 * n_symbols > {quality.MAX_SYMBOL_PERCENT} * word_chars",
        "lines_": f"100 * n_dup_lines > {quality.MAX_DUP_LINE_PERCENT} * n_lines",
    }
    priors, limits = [], []
    for k in rules:
        mean = f"(sum({k}) / sum(n))"
        spread = f"(sum({k} * {k} / n) - sum(n) * {mean} * {mean} - (count(*) - 1) * {mean} * (1 - {mean})) / greatest(sum(n) - sum(n * n) / sum(n), 1e-9)"
        priors.append(f"{mean} AS m_{k}, CASE WHEN {spread} > 0 THEN greatest({weak}, least({strong}, {mean} * (1 - {mean}) / ({spread}) - 1)) ELSE {strong} END AS s_{k}")
        rate = f"(({k} + m_{k} * s_{k}) / (n + s_{k}))"
        limits.append(f"{rate} - sqrt({rate} * (1 - {rate}) / (n + s_{k} + 1)) > least({high}, greatest({low}, {quality.EXCESS} * m_{k}))")
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
a AS MATERIALIZED (SELECT r, doc_id, source, t, {_SPLIT} AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
win AS (SELECT r, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS s FROM a WHERE len(w) >= 5),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM win) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice CROSS JOIN range(0, 5) x(k) GROUP BY r),
f AS (SELECT a.r, doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '{quality.SYMBOLS}', '')) AS BIGINT) AS n_symbols, len(l) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM a LEFT JOIN covered ON covered.r = a.r),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, {", ".join(f"CAST(count(*) FILTER ({test}) AS DOUBLE) AS {k}" for k, test in rules.items())} FROM f GROUP BY source),
p AS (SELECT {", ".join(priors)} FROM h),
v AS (SELECT source, {" OR ".join(limits)} AS rejected FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({rules["words"]} OR {rules["repeats"]}) AS base_failed, NOT ({rules["words"]} OR {rules["repeats"]}) AND NOT rejected AS kept
FROM f JOIN v ON v.source IS NOT DISTINCT FROM f.source"""


#: The others can't be written in SQL (their hashes, tokenizers, models or searches); tests hold them against plain
#: loops, held-out rows or a round trip.
SQL: dict[str, str] = {
    "op5_near_dedup": f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_SPLIT} AS w FROM (SELECT doc_id, {_FOLD} AS t FROM documents)),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
least_ AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1)
SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, component_id, documents.doc_id = component_id AS kept FROM documents LEFT JOIN n ON n.doc_id = documents.doc_id LEFT JOIN least_ ON a = documents.doc_id""",
    "op6_exact_dedup": f"""WITH t AS (SELECT doc_id, {_FOLD} AS low FROM documents), g AS (SELECT low, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY low)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t.low) AS text_sha256 FROM t JOIN g ON g.low = t.low""",
    "op10_host_rules": _host_rules_sql(),
}
