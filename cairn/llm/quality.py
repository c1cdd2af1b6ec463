"""Quality rules with verdicts by host: a host's failures of each rule are shrunk with an empirical beta prior.

A document fails the base rules or passes them; besides, each host has a rate of failing documents for every rule,
shrunk towards the corpus rate of that rule, and a host with a rate far above the corpus's is rejected as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import SPACE, own_names, store, text_or_empty

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_SYMBOL_PERCENT, MAX_DUP_LINE_PERCENT = 25, 50
#: A host is rejected when its shrunk rate of documents that fail a rule, less one posterior standard deviation, is above
#: EXCESS times the corpus rate, but not below the first of HOST_RATES and in any case above the second.
EXCESS, HOST_RATES = 3.0, (0.25, 0.5)
#: Rules, on the figures of measure(); the first two are the base rules.
RULES = {
    "words": lambda: F.col("n_words") < MIN_WORDS,
    "repeats": lambda: 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"),
    "symbols": lambda: 100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("word_chars"),
    "lines": lambda: 100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines"),
}
#: Bounds on the prior's strength, in documents.
PRIOR_DOCS = (2.0, 1000.0)
SYMBOLS = "#*$%&|<>"


def window_hashes(hashed: str) -> Column:
    """The hash of each 5-word window, from the column that holds the words' hashes."""
    at = F.sequence(F.lit(0), F.size(hashed) - WINDOW)
    of = F.transform(at, lambda i: F.xxhash64(*[F.get(F.col(hashed), i + k) for k in range(WINDOW)]))
    return F.when(F.size(hashed) >= WINDOW, of).otherwise(F.array().cast("array<bigint>"))


def ordered_if_repeated(windows: str) -> Column:
    """(hash, place) of all windows in hash order; null if no hash repeats."""
    pairs = F.sort_array(F.transform(F.col(windows), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), pairs)


def repeated_places(pairs: str) -> Column:
    """Places of the windows whose hash occurs twice or more, in order."""
    at = lambda k: F.get(F.col(pairs), k)["h"]
    same = lambda p, k: F.coalesce(at(k - 1) == p["h"], F.lit(False)) | F.coalesce(at(k + 1) == p["h"], F.lit(False))
    return F.sort_array(F.transform(F.filter(F.col(pairs), same), lambda p: p["i"]))


def covered(places: str) -> Column:
    """Words that the windows at these places cover; 0 for null."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def step(acc: Column, i: Column) -> Column:
        return F.struct((acc["n"] + i + WINDOW - F.greatest(acc["end"], i)).cast("long").alias("n"), (i + WINDOW).alias("end"))

    return F.coalesce(F.aggregate(F.col(places), start, step, lambda acc: acc["n"]), F.lit(0).cast("long"))


def measure(docs: DataFrame, host: Column) -> DataFrame:
    """The rules' figures for docs(doc_id, text): doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words (words in a 5-word window that the text holds twice or more, the first included), base_failed.
    A null text has no words; windows are compared by 64-bit hashes of their words.
    """
    text = F.col("text")
    rows = docs.select("doc_id", host.alias("host"), text_or_empty().alias("text"))
    rows = rows.select(
        "doc_id", "host",
        F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "").alias("words"),
        F.length(F.regexp_replace(text, f"[{SPACE}]+", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]")).alias("lines"),
    )
    rows = rows.select(
        "doc_id", "host", "word_chars", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashed"),
    )
    figures = ["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    rows = rows.select(*figures, window_hashes("hashed").alias("windows"))
    rows = rows.select(*figures, ordered_if_repeated("windows").alias("pairs"))
    rows = rows.select(*figures, repeated_places("pairs").alias("places"))
    rows = rows.select(*figures, covered("places").alias("n_repeat_words"))
    return rows.withColumn("base_failed", RULES["words"]() | RULES["repeats"]())


def host_rates(measured: DataFrame) -> DataFrame:
    """host, n_docs, rates (for each rule the beta posterior mean of the host's failure rate), rejected.

    A rule's prior has the corpus rate as its mean, and its strength comes from the spread of the hosts' rates by
    moments (between-host variance less what binomial noise explains), kept within PRIOR_DOCS.  One row a host; hosts
    are aggregated before the shuffle, so a host with a third of all rows is no hot spot.
    """
    fails = [F.sum(rule().cast("long")).alias(name) for name, rule in RULES.items()]
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *fails)
    n = F.col("n_docs")
    sums = [F.sum(n).alias("n"), F.count(F.lit(1)).alias("m"), F.sum((n * n).cast("double")).alias("nn")]
    for name in RULES:
        sums += [F.sum(name).alias(f"k_{name}"), F.sum(F.col(name) * F.col(name) / n).alias(f"squares_{name}")]
    whole = hosts.agg(*sums)

    def prior(name: str) -> Column:
        mean = F.col(f"k_{name}") / F.col("n")
        noise = mean * (1 - mean)
        spread = (F.col(f"squares_{name}") - F.col("n") * mean * mean - (F.col("m") - 1) * noise) / F.greatest(F.col("n") - F.col("nn") / F.col("n"), F.lit(1e-9))
        strength = F.when(spread > 0, F.greatest(F.lit(PRIOR_DOCS[0]), F.least(F.lit(PRIOR_DOCS[1]), noise / spread - 1))).otherwise(F.lit(PRIOR_DOCS[1]))
        limit = F.least(F.lit(HOST_RATES[1]), F.greatest(F.lit(HOST_RATES[0]), EXCESS * mean))
        return F.struct(mean.alias("mean"), strength.alias("strength"), limit.alias("limit")).alias(name)

    priors = whole.select(*[prior(name).alias(f"prior_{name}") for name in RULES])
    # one row against all hosts: the priors are a single row by construction
    rated = hosts.join(F.broadcast(priors), F.lit(True))
    rate = lambda name: (F.col(name) + F.col(f"prior_{name}.mean") * F.col(f"prior_{name}.strength")) / (n + F.col(f"prior_{name}.strength"))
    doubt = lambda name: F.sqrt(rate(name) * (1 - rate(name)) / (n + F.col(f"prior_{name}.strength") + 1))
    rejected = F.lit(False)
    for name in RULES:
        rejected = rejected | (rate(name) - doubt(name) > F.col(f"prior_{name}.limit"))
    return rated.select("host", "n_docs", F.struct(*[rate(name).alias(name) for name in RULES]).alias("rates"), rejected.alias("rejected"))


def apply_rules(docs: DataFrame, host: Column | None = None) -> DataFrame:
    """Figures, base verdict and kept for every row of docs(doc_id, text, source).

    Rows: doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, host_rates,
    host_rejected, kept.  kept is false when the base rules fail, or when the host is rejected.  A null host is a host
    of its own.  Repeated rows are judged each; an empty table gives none.
    """
    rows = own_names(docs, ["doc_id", "text", "source"])
    measured = store(measure(rows, F.col("source") if host is None else host), "quality")
    rates = host_rates(measured).select(F.col("host").alias("of"), F.col("rates").alias("host_rates"), F.col("rejected").alias("host_rejected"))
    out = measured.join(rates, F.col("host").eqNullSafe(F.col("of")), "left").drop("of")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
