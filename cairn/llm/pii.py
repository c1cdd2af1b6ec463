"""Personal data by base rules and bootstrapped contextual extraction, in built-in functions only.

Base rules find seeds.  Every seed, and every other span of one to MAX_WORDS words (outer punctuation stripped) that is
plausible for some kind by its digits, at sign and separators, is an instance with the lexical patterns of its place:
one and two words before it, one and two words after it, and its own shape (digits as 9, letters as a).  On the graph of
patterns and instances, a pattern's confidence for a kind is the mean score of the instances that are plausible for
that kind (weighted by plausibility; seeds score 1, with one instance's worth of doubt added), and an instance that is
no seed scores the mean confidence of its patterns.  After ROUNDS rounds, instances plausible for a kind in a place of
a pattern trusted for it are identifiers of that kind.

Places in a text come from folds over its matches that work in runs of about the square root of their number, and
neighbours by binary search, so a text that is one long list of numbers takes no time squared in its length.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import SPACE, own_names, store, text_or_empty

ROUNDS = 3
#: A pattern is trusted for a kind from this confidence on, with so many different seeds.
TRUST, SEEDS = 0.8, 3

_LOCAL = "A-Za-z0-9._%+-"
#: Kinds in their order.  Possessive repeats and the starts allowed keep long runs linear; a run is entered at its
#: first character or where the last match ended, which is where the leftmost match of the plain rule begins.
RULES = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A quick test that a text may hold a match.
MAY = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": "+"}
KINDS = list(RULES)
#: Words that a new instance may be made of: with a digit or an at sign, or of separators alone.
CANDIDATE = rf"[0-9@]|^[-./()+]+$"
#: What a single word needs to be plausible for any kind: an at sign, four digits or two colons.
ALONE = "@|(?:[0-9][^0-9]*+){4}|:[^:]*+:"
#: A word that another may follow in a span: digits and separators, perhaps after a bracket or quote.
JOINS = r"^[\[({<\"']*[+(]?[0-9()./+-]+$"
#: What several words together may look like: digits and separators, perhaps an extension.
JOINED = r"^[\[({<\"']*[+(]?[\x20+()./0-9-]+(?i:x|ext\.?)?[\x20]?[0-9]*[\"'>\]},.;:!?)]*$"
#: Words of a new instance, each one white space from the next, and its characters (those of the longest address).
MAX_WORDS, MAX_CHARS = 7, 254
#: An instance is taken for a kind from this plausibility on.
PLAUSIBLE = 0.5
#: Outer punctuation; a bracket stays if its other half is within.
LEAD = r"^(?:[\"'<\[{,;:]|\((?![^)]*\)))*+"
TRAIL = r"(?:[\"'>\]},.;:!?]|(?<!\([^()]{0,80})\))+$"
_AT = rf"(?:[{SPACE}]++at[{SPACE}]++|[{SPACE}]*+[\[(]at[\])][{SPACE}]*+|[{SPACE}]++@[{SPACE}]*+|@[{SPACE}]++)"
_DOT = rf"(?:[{SPACE}]++dot[{SPACE}]++|[{SPACE}]*+[\[(]dot[\])][{SPACE}]*+|\.)"
#: An address that is written out: name at host dot com.
WRITTEN = rf"(?i)(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}+{_AT}[a-z0-9-]{{1,64}}+(?:{_DOT}[a-z0-9-]{{1,64}}+){{1,4}}+"
#: What a text needs for such an address: all but the name.
SPELT = rf"(?i){_AT}[a-z0-9-]{{1,64}}+{_DOT}[a-z0-9-]"
PLACES = "array<struct<kind:int,start:int,end:int>>"


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(s: Column) -> Column:
    """The Luhn check of a string of digits: from the right, every second digit counts double, cross-summed."""

    def value(d: Column, i: Column) -> Column:
        n = d.cast("int")
        doubled = F.when(n > 4, 2 * n - 9).otherwise(2 * n)
        return F.when(i % 2 == 1, doubled).otherwise(n)

    each = F.transform(F.filter(F.split(F.reverse(s), ""), lambda d: d != ""), value)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


VALID = {
    "email": lambda s: F.lit(True),
    "ip": lambda s: F.forall(F.split(s, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")),
    "card": lambda s: F.length(digits(s)).between(13, 19) & luhn(digits(s)),
    "phone": lambda s: F.length(digits(s)).between(9, 15),
}


def walked(items: str, start: Column, out: str, step) -> Column:
    """The outputs of a fold over the array column `items`: step(acc, x) gives struct(state, out).  An array that grows
    by one element is copied at each step, so the fold goes over runs of sqrt(n) elements, then joins their outputs."""
    n, none = F.size(F.col(items)), F.array().cast(out)
    width = F.ceil(F.sqrt(n)).cast("int")

    def of_run(acc: Column, run: Column) -> Column:
        begin = F.struct(acc["last"]["state"].alias("state"), none.alias("out"))
        last = F.aggregate(F.slice(F.col(items), run * width + 1, width), begin, step)
        return F.struct(last.alias("last"), F.array_append(acc["outs"], acc["last"]["out"]).alias("outs"))

    begin = F.struct(F.struct(start.alias("state"), none.alias("out")).alias("last"), F.array().cast(f"array<{out}>").alias("outs"))
    runs = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(runs, begin, of_run, lambda acc: F.concat(F.flatten(acc["outs"]), acc["last"]["out"]))


def matches(text: Column, rule: str, when: Column) -> Column:
    """What lies before each match, and the match: array of (gap, match)."""
    pairs = F.arrays_zip(F.split(text, rule, -1).alias("gap"), F.regexp_extract_all(text, F.lit(rule), F.lit(0)).alias("match"))
    return F.when(when, pairs).otherwise(F.array().cast("array<struct<gap:string,match:string>>"))


def ends(pairs: str) -> Column:
    """Where the matches of a column of matches() end, in code points: gaps and matches add up to places."""

    def step(acc: Column, p: Column) -> Column:
        end = acc["state"] + F.length(p["gap"]) + F.coalesce(F.length(p["match"]), F.lit(0))
        return F.struct(end.alias("state"), F.array_append(acc["out"], end).alias("out"))

    return walked(pairs, F.lit(0), "array<int>", step)


def found(pairs: str, kind: int, valid=lambda s: F.lit(True)) -> Column:
    """The valid matches of the columns `pairs` and `pairs`_ends, as spans."""

    def span(p: Column, i: Column) -> Column:
        end = F.get(F.col(f"{pairs}_ends"), i)
        return F.struct(F.lit(kind).alias("kind"), (end - F.length(p["match"])).alias("start"), end.alias("end"), p["match"].alias("literal"))

    return F.filter(F.transform(F.col(pairs), span), lambda x: x["literal"].isNotNull() & valid(x["literal"]))


def may_hold(text: Column, kind: str) -> Column:
    return F.contains(text, F.lit(MAY[kind])) if len(MAY[kind]) == 1 else text.rlike(MAY[kind])


def below(spans: str, limit: Column) -> Column:
    """How many of the column's spans, which are in order, start before the limit: by binary search."""
    n = F.size(F.col(spans))

    def half(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        right = F.struct((middle + 1).alias("low"), acc["high"].alias("high"))
        left = F.struct(acc["low"].alias("low"), middle.alias("high"))
        return F.when(acc["low"] >= acc["high"], acc).when(F.get(F.col(spans), middle)["start"] < limit, right).otherwise(left)

    halvings = F.sequence(F.lit(0), F.ceil(F.log2(n + 1)).cast("int"))
    return F.aggregate(halvings, F.struct(F.lit(0).alias("low"), n.alias("high")), half, lambda acc: acc["low"])


def meets(spans: str, x: Column) -> Column:
    """Whether x overlaps one of the column's spans, which are in order and disjoint."""
    before = F.get(F.col(spans), below(spans, x["end"]) - 1)["end"] > x["start"]
    return F.when(F.size(F.col(spans)) > 0, F.coalesce(before, F.lit(False))).otherwise(F.lit(False))


def places_of(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def written(places: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(F.sort_array(places), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])))


def plausible(s: Column, kind: str) -> Column:
    """0 to 1: how far a span may be of a kind by its digits, at sign and separators, context aside."""
    n = F.length(digits(s))
    if kind == "email":
        return F.when(s.rlike(rf"^[^@{SPACE}]*[\p{{L}}\p{{N}}][^@{SPACE}]*@[\p{{L}}\p{{N}}][^@{SPACE}]*$") | s.rlike(f"^{WRITTEN}$"), 1.0).otherwise(0.0)
    if kind == "ip":
        other = s.rlike(r"^[0-9]{1,3}(?:[-:,][0-9]{1,3}){3}$") | s.rlike(r"^(?i)(?=.*::|(?:[^:]*:){4})[0-9a-f]{0,4}(?::[0-9a-f]{0,4}){2,7}$")
        return F.when(other, 0.75).otherwise(0.0)  # four parts up to 255 with dots are always seeds
    if kind == "card":
        alone = s.rlike(rf"^[0-9][0-9{SPACE}./-]*[0-9]$")
        return F.when(alone & n.between(13, 19), F.when(luhn(digits(s)), 1.0).otherwise(0.75)).when(alone & n.isin(12, 20), 0.5).otherwise(0.0)
    alone = s.rlike(rf"^[+(]?[{SPACE}]?[0-9][0-9{SPACE}()./-]*[0-9](?i:[{SPACE}]?(?:x|ext\.?)[{SPACE}]?[0-9]{{1,5}})?$")
    date = s.rlike(r"^(?:[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./][0-9]{4})$") | s.rlike(r"^[0-9]+(?:\.[0-9]+){3}$")
    parted = s.rlike(r"[^0-9]")
    return F.when(~alone | date | ~n.between(7, 20), 0.0).when(parted & n.between(9, 15), 1.0).when(n.between(9, 15) | (parted & (n < 9)), 0.75).when(n < 9, 0.5).otherwise(0.0)


def any_kind(s: Column) -> Column:
    return F.greatest(*[plausible(s, k) for k in KINDS]) >= PLAUSIBLE


def stripped(x: Column) -> Column:
    """A span without its outer punctuation."""
    lead = F.length(F.regexp_extract(x["literal"], LEAD, 0))
    trail = F.length(F.regexp_extract(x["literal"], TRAIL, 0))
    literal = F.substring(x["literal"], lead + 1, F.greatest(F.length(x["literal"]) - lead - trail, F.lit(0)))
    return placed(x["start"] + lead, x["end"] - trail, literal, x["first"], x["last"])


def placed(start: Column, end: Column, literal: Column, first: Column, last: Column, kind: Column | None = None) -> Column:
    """A span of the words from the place `first` to `last`."""
    kind = F.lit(-1) if kind is None else kind
    return F.struct(kind.alias("kind"), start.alias("start"), end.alias("end"), literal.alias("literal"), first.alias("first"), last.alias("last"))


def joined_words(words: str) -> Column:
    """Spans of one to MAX_WORDS of the column's words that follow each other one white space apart, which is a space in
    the literal."""
    col = F.col(words)

    def of(k: int) -> Column:
        def at(i: Column) -> Column:
            some = F.slice(col, i, F.lit(k))
            one, other = F.get(col, i - 1), F.get(col, i + (k - 2))
            return placed(one["start"], other["end"], F.concat_ws(" ", F.transform(some, lambda w: w["literal"])), one["first"], other["first"])

        starts = F.when(F.size(col) >= k, F.sequence(F.lit(1), F.size(col) - (k - 1))).otherwise(F.array().cast("array<int>"))
        if k == 1:
            return F.transform(F.filter(starts, lambda i: (F.get(col, i - 1)["end"] - F.get(col, i - 1)["start"] <= MAX_CHARS) & F.get(col, i - 1)["literal"].rlike(ALONE)), at)
        follow = lambda i: reduce(and_, [F.get(col, i + j)["joins"] for j in range(-1, k - 2)])
        near = F.filter(starts, lambda i: follow(i) & (F.get(col, i + (k - 2))["end"] - F.get(col, i - 1)["start"] <= MAX_CHARS) & (F.get(col, i + (k - 2))["first"] - F.get(col, i - 1)["first"] == k - 1))
        some = F.filter(F.transform(near, at), lambda x: F.length(x["literal"]) == x["end"] - x["start"])
        return F.filter(some, lambda x: x["literal"].rlike(JOINED) & F.length(digits(x["literal"])).between(7, 20))

    return F.concat(*[of(k) for k in range(1, MAX_WORDS + 1)])


def patterns(x: Column) -> Column:
    """The lexical patterns of an instance: words around it, without outer punctuation, and its shape."""
    word = lambda i: F.lower(F.regexp_replace(F.coalesce(F.get(F.col("words"), i)["literal"], F.lit("")), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    one, two = word(x["first"] - 1), word(x["first"] - 2)
    next_, then = word(x["last"] + 1), word(x["last"] + 2)
    shape = F.regexp_replace(F.regexp_replace(x["literal"], "[0-9]", "9"), r"\p{L}+", "a")
    given = F.array(
        F.when(one != "", F.concat(F.lit("before:"), one)), F.when((one != "") & (two != ""), F.concat(F.lit("before:"), two, F.lit(" "), one)),
        F.when(next_ != "", F.concat(F.lit("after:"), next_)), F.when((next_ != "") & (then != ""), F.concat(F.lit("after:"), next_, F.lit(" "), then)),
        F.concat(F.lit("shape:"), shape),
    )
    return F.filter(given, lambda p: p.isNotNull())


def instances(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, base (spans), items: spans with their patterns, both the base spans and other plausible spans
    of words outside all base spans."""
    text = F.col("text")
    some = text.rlike("[0-9@]")
    spelt = text.rlike(SPELT)
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    rows = rows.select(
        "doc_id", F.xxhash64(text).alias("text_hash"), *[matches(text, RULES[k], may_hold(text, k)).alias(k) for k in KINDS],
        matches(text, f"[^{SPACE}]+", some | spelt).alias("words"), matches(text, WRITTEN, spelt).alias("spelt"),
    )
    rows = rows.select("*", *[ends(k).alias(f"{k}_ends") for k in (*KINDS, "words", "spelt")])
    rows = rows.select(
        "doc_id", "text_hash", *[found(k, i, VALID[k]).alias(k) for i, k in enumerate(KINDS)],
        found("words", -1).alias("words"), found("spelt", -1).alias("spelt"),
    )
    numbered = F.transform("words", lambda w, i: F.struct(w["start"].alias("start"), w["end"].alias("end"), w["literal"].alias("literal"), i.alias("first"), w["literal"].rlike(JOINS).alias("joins")))
    rows = rows.select("*", F.filter(numbered, lambda w: w["literal"].rlike(CANDIDATE)).alias("able"))
    between = lambda x, kind=None: placed(x["start"], x["end"], x["literal"], below("words", x["start"] + 1) - 1, below("words", x["end"]) - 1, kind)
    rows = rows.select("*", F.concat(joined_words("able"), F.transform("spelt", between)).alias("spans"))
    plausible_ = F.filter(F.transform("spans", stripped), lambda w: any_kind(w["literal"]))
    free = lambda w: ~(meets(KINDS[0], w) | meets(KINDS[1], w) | meets(KINDS[2], w) | meets(KINDS[3], w))
    rows = rows.select("doc_id", "text_hash", "words", *KINDS, F.concat(*KINDS).alias("base"), F.filter(plausible_, free).alias("others"))
    seeds = F.transform("base", lambda x: between(x, x["kind"]))
    rows = rows.select("doc_id", "text_hash", "words", "base", F.concat(seeds, "others").alias("items"))
    described = F.transform("items", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["literal"].alias("literal"), patterns(x).alias("patterns")))
    return rows.select("doc_id", "text_hash", "base", described.alias("items"))


def bootstrap(items: DataFrame, rounds: int = ROUNDS, trust: float = TRUST, seeds: int = SEEDS) -> DataFrame:
    """Discovered (pattern, literal, kind, confidence, weight) from rows (pattern, literal, kind: -1 if no seed)."""
    edges = items.groupBy("pattern", "literal").agg(F.max("kind").alias("seed"))
    weight = lambda i, k: F.struct(F.lit(i).alias("kind"), F.when(F.col("seed") == i, 1.0).otherwise(plausible(F.col("literal"), k)).alias("weight"))
    edges = edges.select("pattern", "literal", "seed", F.explode(F.array(*[weight(i, k) for i, k in enumerate(KINDS)])).alias("x"))
    edges = store(edges.select("pattern", "literal", "seed", "x.*").where(F.col("weight") >= PLAUSIBLE), "pii-edges")
    known = edges.where(F.col("seed") == F.col("kind")).select("literal", "kind").distinct()
    scores = known.withColumn("score", F.lit(1.0))
    sizes = edges.groupBy("pattern", "kind").agg(F.sum("weight").alias("n"))
    fresh = edges.join(known.select("literal").distinct(), "literal", "left_anti").select("pattern", "literal", "kind")
    confident = None
    for turn in range(rounds):
        marked = edges.join(scores, ["literal", "kind"]).groupBy("pattern", "kind").agg(F.sum(F.col("score") * F.col("weight")).alias("mass"), F.sum(F.floor(F.col("score"))).alias("seeds"))
        confident = marked.join(sizes, ["pattern", "kind"]).select("pattern", "kind", "seeds", (F.col("mass") / (F.col("n") + 1)).alias("confidence"))
        confident = confident.where(F.col("seeds") >= seeds)
        guessed = fresh.join(confident, ["pattern", "kind"]).groupBy("literal", "kind").agg(F.avg("confidence").alias("score"))
        scores = store(known.withColumn("score", F.lit(1.0)).unionByName(guessed.where(F.col("score") < 1)), f"pii-scores-{turn}")
    trusted = confident.where(F.col("confidence") >= trust).select("pattern", "kind", "confidence")
    return edges.join(trusted, ["pattern", "kind"]).select("pattern", "literal", "kind", "confidence", "weight")


KEPT = "struct<kind:int,start:int,end:int,rank:double>"


def apart(spans: str) -> Column:
    """Of the column's spans(kind, start, end, rank), which are in order, none that overlap in a kind: of one and
    the next the higher rank stays.  The last element, of a kind of its own, ends the fold."""

    def step(acc: Column, x: Column) -> Column:
        now = acc["state"]
        met = (now["kind"] == x["kind"]) & (x["start"] < now["end"])
        state = F.when(met & (now["rank"] >= x["rank"]), now).otherwise(x)
        return F.struct(state.alias("state"), F.when(met | (now["kind"] < 0), acc["out"]).otherwise(F.array_append(acc["out"], now)).alias("out"))

    begin = F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0.0).alias("rank"))
    return walked(spans, begin, f"array<{KEPT}>", step)


def find_pii(docs: DataFrame) -> DataFrame:
    """Spans of personal data in docs(doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base (the base spans as
    kind:start:end by kind and start, code points, end exclusive), spans (base and discovered ones, likewise).

    A null or empty text has none.  Repeated rows are found alike.  Patterns common to a third of all rows are
    aggregated before the shuffle; no group is gathered in one task but what is discovered in one text.
    """
    rows = store(instances(own_names(docs, ["doc_id", "text"])), "pii-instances")
    each = rows.select("doc_id", "text_hash", F.explode("items").alias("x")).select("doc_id", "text_hash", "x.*")
    places = each.withColumn("pattern", F.explode("patterns")).drop("patterns")
    found_ = bootstrap(places)
    # a shape alone tells nothing of a span that fails the checks of the kind
    found_ = found_.where(~F.startswith("pattern", F.lit("shape:")) | (F.col("weight") >= 1))
    new = places.where(F.col("kind") < 0).drop("kind").join(found_, ["pattern", "literal"])
    # trusted by more patterns comes first, then the likelier, then the longer
    new = new.groupBy("doc_id", "text_hash", "kind", "start", "end", "literal").agg(F.countDistinct("pattern").alias("sides"), F.max(F.col("confidence") * F.col("weight")).alias("likely"))
    rank = F.col("sides") * 1000 + F.floor(F.col("likely") * 100) + (F.col("end") - F.col("start")) / 1000
    spans = F.struct("kind", "start", "end", rank.cast("double").alias("rank"))
    last = F.struct(F.lit(len(KINDS)).alias("kind"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0.0).alias("rank"))
    new = new.groupBy("doc_id", "text_hash").agg(F.array_append(F.sort_array(F.collect_set(spans)), last).alias("all"))
    new = new.select("doc_id", "text_hash", apart("all").alias("kept"))
    new = new.select(F.col("doc_id").alias("of"), F.col("text_hash").alias("of_hash"), places_of(F.col("kept")).alias("new"))
    joined = rows.join(new, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("of_hash")), "left")
    number = lambda i: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long")
    return joined.select(
        "doc_id",
        *[number(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        written(places_of(F.col("base"))).alias("base"),
        written(F.concat(places_of(F.col("base")), F.coalesce("new", F.array().cast(PLACES)))).alias("spans"),
    )
