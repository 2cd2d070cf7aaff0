"""Quality rules whose cutoffs are chosen under a bound on false rejections.

Each rule rejects a text whose measure exceeds a cutoff, and the cutoffs of all rules tighten
together, step by step.  Labelled good texts are the holdout: for a stratum with n of them, of which
any rule at a step rejects k, the step is admitted if the exact binomial tail P(X <= k),
X ~ Bin(n, alpha), is at most delta / (strata + 1).  Steps are tested from the most lenient to the
strictest and the test stops at the first that fails (a fixed sequence, so no further correction),
which is the same as taking the strictest admitted one, since k only grows.  With probability
1 - delta no stratum loses more than alpha of its good texts to all rules together.

A stratum whose labels admit no step takes the steps of all strata pooled (the one more test above);
the bound then holds for the pool, not for that stratum.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linetrace.llm.common import SPACES, carried, sent_if_few, stash, words

#: Share of a stratum's good texts that may be rejected, and the chance that any bound fails.
ALPHA, DELTA = 0.05, 0.05
#: Cutoffs of each rule at each step, from lenient to strict.
GRID: dict[str, tuple[float, ...]] = {
    "symbols": (2.0, 1.5, 1.0, 0.75, 0.5, 0.3, 0.2, 0.1, 0.05, 0.02),
    "dup_lines": (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.05, 0.03),
    "repeats": (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08),
    "long_words": (30.0, 20.0, 15.0, 12.0, 10.0, 9.0, 8.5, 8.0, 7.5, 7.0),
    "short_words": (-1.2, -1.5, -1.8, -2.0, -2.2, -2.5, -2.8, -3.0, -3.2, -3.5),
}
STEPS = 10
#: A position in a text takes so many bits of a sort key; longer texts skip the first sieve.
_AT = 21


def measures(docs: DataFrame, *keep: str) -> DataFrame:
    """The five counts of each text, and the columns ``keep``.

    Repeated 3-word windows are found without shuffling: the windows' hashes, each with its position
    in the low bits, are sorted as plain numbers; neighbours that agree in the high bits are
    candidates; only those are sorted again with full hashes."""
    rows = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text")).withColumn("w", words(F.col("text")))
    n = F.size("w")
    window = lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))
    low = (1 << _AT) - 1
    places = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("at", places)
    packed = F.transform("at", lambda i: window(i).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))
    rows = rows.withColumn("packed", F.sort_array(packed))
    high = lambda i: F.shiftright(F.get("packed", i), _AT)
    near = F.filter("at", lambda i: (high(i) == high(i - 1)) | (high(i) == high(i + 1)))
    sieve = F.transform(near, lambda i: F.get("packed", i).bitwiseAND(F.lit(low)).cast("int"))
    rows = rows.withColumn("maybe", F.when(n <= low, sieve).otherwise(F.col("at")))
    rows = rows.withColumn("full", F.sort_array(F.transform("maybe", lambda i: F.struct(window(i).alias("h"), i.alias("i")))))
    same = lambda x, i: (F.get("full", i - 1)["h"] == x["h"]) | (F.get("full", i + 1)["h"] == x["h"])
    rows = rows.withColumn("found", F.sort_array(F.transform(F.filter("full", lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"])))
    step = lambda p, k: F.least(F.lit(3), F.coalesce(p - F.get("found", k - 1), F.lit(3)))
    covered = F.aggregate(F.transform("found", step), F.lit(0).cast("long"), lambda s, x: s + x)
    joined = F.array_join("w", "")
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(f"[^{SPACES}]"))
    rows = rows.withColumn("joined", joined).withColumn("lines", lines)
    return rows.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length("joined").cast("long").alias("word_chars"),
        F.length(F.regexp_replace("joined", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    )


def rule_values() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "symbols": F.col("n_symbols") / n,
        "dup_lines": F.col("n_dup_lines") / n,
        "repeats": F.col("n_repeat_words") / n,
        "long_words": F.col("word_chars") / n,
        "short_words": -F.col("word_chars") / n,
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1, by Stirling's series at x + 8; to about 1e-13."""
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    product = x
    for k in range(1, 8):
        product = product * (x + k)
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - F.log(product)


def binomial_tail(k: Column, n: Column, alpha: float | Column) -> Column:
    """P(X <= k) for X ~ Bin(n, alpha), exact up to rounding; 1 where k is not below the mean.

    The terms fall geometrically below k, so those beyond 40 standard deviations of n add nothing."""
    n, k = n.cast("double"), k.cast("double")
    top = F.exp(log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * F.log(F.lit(alpha)) + (n - k) * F.log(F.lit(1 - alpha)))
    steps = F.sequence(F.lit(0), F.least(k, 40 * F.sqrt(n) + 100).cast("int"))
    total = F.aggregate(
        steps,
        F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda a, m: F.struct((a["sum"] + a["term"]).alias("sum"), (a["term"] * (k - m) * (1 - alpha) / ((n - k + m + 1) * alpha)).alias("term")),
        lambda a: a["sum"],
    )
    return F.when(k >= n * alpha, 1.0).otherwise(F.least(F.lit(1.0), top * total))


def notch() -> Column:
    """The first step, from 0, at which any rule rejects the text; STEPS if none does."""
    steps = lambda cuts, value: F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: value <= c))
    return F.least(*[steps(GRID[rule], value) for rule, value in rule_values().items()])


def admitted(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, steps): how many steps each stratum's labels admit, or else those of all strata.

    ``measured`` has doc_id, stratum and the counts; ``labels`` has doc_id and quality.  A document
    is good if its labels are all 1; labels without a value or a document say nothing.  Several rows
    of one doc_id and stratum are one label, rejected where one of them is."""
    good = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("good")).filter("good = 1")
    held = measured.filter(~base_failed()).join(good.select("doc_id"), "doc_id").groupBy("stratum", "doc_id").agg(F.min(notch()).alias("notch"))
    lost = [F.count_if(F.col("notch") <= step).alias(f"k{step}") for step in range(STEPS)]
    by = stash(held.groupBy("stratum").agg(F.count("*").alias("n"), *lost))
    allowed = delta / (by.count() + 1)
    passed = sum(((binomial_tail(F.col(f"k{step}"), F.col("n"), alpha) <= allowed).cast("int") for step in range(STEPS)), F.lit(0)).alias("steps")
    pool = by.agg(F.sum("n").alias("n"), *[F.sum(f"k{step}").alias(f"k{step}") for step in range(STEPS)]).filter("n > 0").select(F.lit(None).cast("string").alias("stratum"), passed)
    own = by.select("stratum", passed)
    return own.filter("steps > 0").unionByName(pool)


def with_verdict(measured: DataFrame, labels: DataFrame, alpha: float, delta: float) -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept``."""
    steps = stash(admitted(measured, labels, alpha, delta))
    pooled = steps.filter("stratum is null").first()
    by = measured.join(sent_if_few(steps.filter("stratum is not null")), "stratum", "left")
    fits = notch() >= F.coalesce("steps", F.lit(pooled.steps if pooled else 0))
    return by.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & fits)


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, the counts, base_failed and kept for each row of ``docs``.

    Null texts have no words and fail the base rule; null strata are one stratum of their own; a
    stratum without enough labels takes the cutoffs of all strata pooled, and without enough labels
    at all whatever passes the base rule is kept; a measure that equals a cutoff passes; repeated
    rows give repeated results; columns besides doc_id, text and the stratum are ignored; empty
    tables give an empty result; long texts are measured whole.  Labels of documents that fail the
    base rule are not part of the holdout."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"))
    measured = stash(measures(rows, "doc_id", "stratum"))
    return with_verdict(measured, labels, alpha, delta).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, all columns as they are, with the same handling of
    nulls, blanks, ties, long texts and empty tables; repeated rows stay repeated."""
    rows = carried(docs).withColumn("stratum", F.coalesce(F.col(f"row.{stratum}").cast("string"), F.lit("")))
    measured = stash(measures(rows, "doc_id", "stratum", "k1", "k2"))
    # Most rows stay, so those that go are looked up.
    gone = stash(with_verdict(measured, labels, alpha, delta).filter(~F.col("kept")).select("k1", "k2", "stratum").distinct())
    return rows.join(sent_if_few(gone), ["k1", "k2", "stratum"], "left_anti").select("row.*")
