"""Secrets in texts: fixed patterns, and random-looking strings by a battery of tests.

Runs of encoding characters are candidates, whole and cut at the characters that join names to
values.  The encoding (hex, base 32, 36, 64) is inferred from the characters.  Three numbers are
taken within its alphabet: the chi-squared statistic of the character counts, the runs of characters
of one class (upper, lower, digit), and the serial correlation at lag one.

Each is tested twice.  Against a uniform source, with small-sample bounds: a string that fails is not
random.  Against written language in that alphabet, towards uniform: the three p-values are combined
by Brown's method into one, which long strings can make smaller than short ones, and over all
candidates of the corpus the Benjamini-Hochberg rule on it bounds the share of false finds.
DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linetrace.llm.common import carried, stash
from linetrace.llm.quality_rules import binomial_tail

#: Patterns and least lengths of the base kinds, in their order.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Candidates of the battery: runs between the characters that join names to values.  Each of "=", "/"
#: and "+", "-" and "_" may join, or be a digit of the encoding: base 64 in either form is cut at what it
#: does not use, and a run is also cut at all of them.
CANDIDATES = (r"[A-Za-z0-9+/_-]{20,}={0,2}", r"[A-Za-z0-9+/]{20,}={0,2}", r"[A-Za-z0-9_-]{20,}={0,2}", r"[A-Za-z0-9+]{20,}")
PATTERNS = (ASSIGN, ACCESS, HEX, *CANDIDATES)
KINDS = ("assign", "access", "hex", *["random"] * len(CANDIDATES))
BASE = 3
LEAST_VALUE = 6

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Pattern, alphabet in order, and of written language within it: the sums of squared and of cubed
#: character frequencies, and the chance that the next character is of another class.
ENCODINGS = (
    ("^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", DIGITS + "abcdef", 0.20, 0.055, 0.20),
    ("^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", DIGITS + "ABCDEF", 0.20, 0.055, 0.20),
    ("^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+=*$", UPPER + "234567", 0.065, 0.0055, 0.12),
    ("^(?=.*[2-7])(?=.*[a-z])[a-z2-7]+=*$", LOWER + "234567", 0.065, 0.0055, 0.12),
    ("^(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]+$", DIGITS + UPPER, 0.065, 0.0055, 0.15),
    ("^(?=.*[0-9])(?=.*[a-z])[a-z0-9]+$", DIGITS + LOWER, 0.065, 0.0055, 0.15),
    ("^(?=.*[A-Z])(?=.*[a-z])[A-Za-z]+$", UPPER + LOWER, 0.065, 0.0055, 0.25),
    ("^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9+/]+=*$", UPPER + LOWER + DIGITS + "+/", 0.065, 0.0055, 0.35),
    ("^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9_-]+=*$", UPPER + LOWER + DIGITS + "-_", 0.065, 0.0055, 0.35),
)
#: Lag-one correlation of written language along an alphabet whose classes are blocks.
CORRELATION = 0.4
#: A string that fails a test at this level (times three tests) is not random.
UNIFORM = 0.001
#: Correlation of the tests' log p-values that Brown's method allows for.
TOGETHER = 0.5
FALSE_SHARE = 0.01
#: The rule reads its numbers on a grid of -log10 of so many steps a decade.
STEPS, DECADES = 20, 300


def _classes(alphabet: str) -> str:
    return "".join("A" if c in UPPER else "a" if c in LOWER else "0" for c in alphabet)


def turn_rate(alphabet: str) -> float:
    """The chance that two independent characters are of different classes."""
    kinds = _classes(alphabet)
    return 1 - sum(kinds.count(k) ** 2 for k in set(kinds)) / len(kinds) ** 2


def normal_below(z: Column) -> Column:
    """P(Z < z) of the standard normal, by the five-term rational approximation (1e-7)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) * 0.3989422804014327 * poly
    return F.when(z < 0, tail).otherwise(1 - tail)


def _matches(rank: int, pattern: str) -> Column:
    """Matches of one kind in order, each with the length of the text between it and the last one."""
    found = F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1))
    value = F.regexp_extract_all("text", F.lit(pattern), F.lit(1)) if rank == 0 else found
    gaps = F.transform(F.split("text", pattern, -1), lambda p: F.length(p))
    return F.transform(
        F.arrays_zip(found.alias("match"), value.alias("value"), gaps.alias("gap")),
        lambda x, i: F.struct(F.lit(rank).alias("rank"), i.alias("i"), x["match"].alias("match"), x["value"].alias("value"), x["gap"].alias("gap")),
    )


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, key, spans) of the rows with any span; key is a hash of the text.  A span has start,
    rank (of its kind), end and kind, in code points, the end not included."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key"))
    hits = rows.filter(F.col("text").rlike("|".join(PATTERNS))).dropDuplicates(["doc_id", "key"])
    cells = [_matches(rank, pattern) for rank, pattern in enumerate(PATTERNS)]
    found = hits.select("doc_id", "key", F.explode(F.concat(*cells)).alias("c")).select("doc_id", "key", "c.*")
    # Where a match starts follows from the lengths of what stands before it.
    before = W.partitionBy("doc_id", "key", "rank").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    size = F.coalesce(F.length("match"), F.lit(0))
    found = found.withColumn("end", F.sum(F.col("gap") + size).over(before)).filter("match is not null")
    found = found.withColumn("start", F.col("end") - F.length("match")).filter((F.col("rank") > 0) | (F.length("value") >= LEAST_VALUE))
    found = stash(found.select("doc_id", "key", "rank", "start", "end", "match"))
    parts = found.filter(F.col("rank") < BASE).select("doc_id", "key", "rank", "start", "end")
    # A part that is a whole run is one candidate.
    candidates = found.filter(F.col("rank") >= BASE).groupBy("doc_id", "key", "start", "end", "match").agg(F.lit(BASE).alias("rank"))
    parts = parts.unionByName(random_strings(candidates))
    span = F.struct("start", "rank", "end")
    by = parts.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set(span)).alias("all"))
    # What lies inside another random string, or inside a span of a base kind, is not told again.
    inside = lambda s: F.exists("all", lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]) & ((b["rank"] < BASE) | (b["end"] - b["start"] > s["end"] - s["start"])))
    kept = F.filter("all", lambda s: (s["rank"] < BASE) | ~inside(s))
    return by.select("doc_id", "key", kept.alias("spans"))


def random_strings(candidates: DataFrame) -> DataFrame:
    """Those of the candidate runs (doc_id, key, rank, start, end, match) that look random."""
    pick = lambda of: F.coalesce(*[F.when(F.col("match").rlike(e[0]), F.lit(of(e))) for e in ENCODINGS])
    c = candidates.withColumn("alphabet", pick(lambda e: e[1])).filter("alphabet is not null")
    numbers = {"ic": lambda e: e[2], "ic3": lambda e: e[3], "said": lambda e: e[4], "even": lambda e: turn_rate(e[1])}
    c = c.withColumns({name: pick(of) for name, of in numbers.items()}).withColumn("s", F.regexp_replace("match", "=+$", ""))
    c = c.withColumn("len", F.length("s").cast("double")).withColumn("size", F.length("alphabet").cast("double")).filter("len >= 20")
    c = c.withColumn("chars", F.split("s", "")).withColumn("kinds", F.split(F.translate("s", UPPER + LOWER + DIGITS + "+/-_", _classes(UPPER + LOWER + DIGITS + "+/-_")), ""))
    c = c.withColumn("v", F.transform("chars", lambda x: F.instr(F.col("alphabet"), x).cast("double") - 1))
    sum_of = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    square = F.aggregate(F.array_distinct("chars"), F.lit(0.0), lambda a, x: a + F.pow(F.col("len") - F.length(F.replace(F.col("s"), x, F.lit(""))), F.lit(2.0)))
    turns = sum_of(F.transform("kinds", lambda x, i: F.coalesce((x != F.get("kinds", i - 1)).cast("double"), F.lit(0.0))))
    c = c.withColumn("square", square).withColumn("mean", sum_of("v") / F.col("len")).withColumn("turns", turns)
    spread = sum_of(F.transform("v", lambda x: (x - F.col("mean")) * (x - F.col("mean"))))
    lag = sum_of(F.transform("v", lambda x, i: F.coalesce((x - F.col("mean")) * (F.get("v", i - 1) - F.col("mean")), F.lit(0.0))))
    n, size = F.col("len"), F.col("size")
    clip = lambda x: F.greatest(F.lit(-0.999), F.least(F.lit(0.999), x))
    c = c.withColumn("lag", F.atanh(clip(lag / F.greatest(spread, F.lit(1e-9)) + 1 / n)))
    # Chi-squared is (2 pairs + n) size / n - n, pairs being those of equal characters, which are
    # independent two by two under a uniform source: a Poisson tail, by Chernoff's bound.
    pairs, all_pairs = (F.col("square") - n) / 2, n * (n - 1) / 2
    rate = all_pairs / size
    crowded = F.when(pairs > rate, F.exp(pairs - rate - pairs * F.log(pairs / rate))).otherwise(1.0)
    two = lambda z: 2 * normal_below(-F.abs(z))
    even = F.col("even")
    uneven = two((F.col("turns") - (n - 1) * even) / F.sqrt((n - 1) * even * (1 - even)))
    c = c.withColumn("uniform", 3 * F.least(crowded, uneven, two(F.col("lag") * F.sqrt(n - 3))))
    # The same numbers if written language were the source.
    sd = F.sqrt(all_pairs * (F.col("ic") * (1 - F.col("ic")) + 2 * (n - 2) * (F.col("ic3") - F.col("ic") * F.col("ic"))))
    tests = (
        normal_below((pairs - all_pairs * F.col("ic")) / sd),
        binomial_tail(n - 1 - F.col("turns"), n - 1, 1 - F.col("said")),
        normal_below((F.col("lag") - math.atanh(CORRELATION)) * F.sqrt(n - 3)),
    )
    c = c.withColumn("x", sum((-2 * F.log(F.greatest(p, F.lit(1e-99))) for p in tests), F.lit(0.0)))
    # Brown: the sum over its scale is chi-squared of fewer degrees, here 6 / 2 = 3.
    scale = 1 + 2 * TOGETHER
    assert 6 / scale == 3, "the tail below is that of three degrees of freedom"
    y = F.col("x") / scale
    language = 2 * normal_below(-F.sqrt(y)) + F.sqrt(2 * y / math.pi) * F.exp(-y / 2)
    step = F.least(F.floor(-F.log10(F.greatest(language, F.lit(1e-299))) * STEPS), F.lit(STEPS * DECADES))
    c = stash(c.select("doc_id", "key", "rank", "start", "end", "uniform", step.alias("step")))
    # At most STEPS * DECADES + 1 groups, whatever the corpus; the least strict step that the rule admits.
    at = W.orderBy(F.col("step").desc())
    grid = c.groupBy("step").count().select("step", F.sum("count").over(at).alias("found"), F.sum("count").over(W.partitionBy()).alias("all"))
    cut = grid.filter(F.col("all") * F.pow(F.lit(10.0), -F.col("step") / STEPS) <= FALSE_SHARE * F.col("found")).agg(F.min("step")).first()[0]
    kept = c.filter((F.col("step") >= F.lit(cut)) & (F.col("uniform") >= UNIFORM)) if cut is not None else c.limit(0)
    return kept.select("doc_id", "key", "rank", "start", "end")


def _written(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans for each row of ``docs``.

    Null and blank texts have no spans.  A null doc_id stays; repeated rows give repeated results;
    other columns are ignored; an empty table gives an empty result; long texts are searched whole.
    Spans that start together are in the order of the kinds."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"))
    found = spans(docs)
    out = rows.alias("r").join(found.alias("f"), F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("r.key") == F.col("f.key")), "left")
    none = F.array().cast("array<struct<start: bigint, rank: int, end: bigint>>")
    out = out.select("r.doc_id", F.coalesce("spans", none).alias("found"))
    count = lambda rank: F.size(F.filter("found", lambda s: s["rank"] == rank)).cast("long")
    base = F.filter("found", lambda s: s["rank"] < BASE)
    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("found")).alias("spans")
    )


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; overlapping spans become one.  n_chars, where
    there is such a column, follows the text.  Null and blank texts and texts without secrets stay as
    they are, repeated rows repeated; all columns keep their names and kinds; an empty table gives an
    empty result; long texts are redacted whole."""
    # The patterns meet each text once; what follows reads the rows that they hit, or copies the others.
    suspect = F.coalesce(F.col("text").rlike("|".join(PATTERNS)), F.lit(False))
    rows = stash(carried(docs).select("doc_id", F.xxhash64("text").alias("key"), suspect.alias("suspect"), "row"))
    hits = rows.filter("suspect").select("doc_id", F.col("row.text").alias("text"), "key", "row")
    found = spans(hits.select("doc_id", "text")).select(F.col("doc_id").alias("f_id"), F.col("key").alias("f_key"), "spans")
    both = hits.join(found, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("key") == F.col("f_key")), "left")
    cut = F.aggregate(
        F.coalesce("spans", F.array().cast("array<struct<start: bigint, rank: int, end: bigint>>")),
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.concat(a["out"], F.when(s["start"] >= a["at"], F.concat(F.substring(F.col("text"), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mark))).otherwise("")).alias("out"),
        ),
        lambda a: F.concat(a["out"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), F.length("text"))),
    )
    row = F.col("row").withField("text", cut)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length(cut).cast(docs.schema["n_chars"].dataType))
    return rows.filter("not suspect").select("row.*").unionByName(both.select(row.alias("row")).select("row.*"))
