"""Source mixing by temperature, realised as block permutations.

A source with share p of the tokens gets weight p**t / sum(p**t).  The exponent t in [0, 1] is found
by bisection: the entropy of the weights falls with t, and so does the most repeated source's number
of passes.  A budget of tokens is then spent: every source is laid out in a fixed pseudo-random
order, repeated as often as its share of the budget asks for, and cut into blocks that all hold the
same mixture; a second pseudo-random key orders each block.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from linetrace.llm.common import n_words, stash

#: Sources that are handled on the driver and broadcast; more are aggregated and joined by Spark.
SMALL = 65_536
#: Hash buckets of one source: running sums go over buckets, then over the rows of one bucket.
BUCKET_BITS = 12
SEED = 20_111

Moments = Callable[[float], tuple[float, float, float]]


def _moments(sources: DataFrame) -> Moments:
    """t -> (z, entropy, largest p**(t - 1) / z) of the weights p**t / z."""
    sources = sources.filter("tokens > 0")
    if sources.limit(SMALL + 1).count() <= SMALL:
        tokens = [float(r.tokens) for r in sources.select("tokens").collect()]
        total = sum(tokens)
        shares = [x / total for x in tokens]

        def local(t: float) -> tuple[float, float, float]:
            z = sum(p**t for p in shares)
            return z, math.log(z) - t * sum(p**t * math.log(p) for p in shares) / z, max(p ** (t - 1) for p in shares) / z

        return local
    total = sources.agg(F.sum("tokens")).first()[0]
    p = F.col("tokens") / F.lit(float(total))

    def spread(t: float) -> tuple[float, float, float]:
        z, h, most = sources.agg(F.sum(F.pow(p, F.lit(t))), F.sum(F.pow(p, F.lit(t)) * F.log(p)), F.max(F.pow(p, F.lit(t - 1)))).first()
        return z, math.log(z) - t * h / z, most / z

    return spread


def _bisect(holds: Callable[[float], bool]) -> float:
    """The least t in [0, 1] for which ``holds``, true from some t on; 1 if none is found."""
    if holds(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(40):
        middle = (low + high) / 2
        low, high = (low, middle) if holds(middle) else (middle, high)
    return high


def exponent(sources: DataFrame, budget_share: float, entropy: float | None, passes: float | None) -> float:
    """The exponent that meets the target: the weights' entropy (as a share of the log of the number
    of sources) is ``entropy``, unless that would repeat a source more than ``passes`` times; then
    the least exponent that does not.  ``budget_share``: the budget over all tokens."""
    n = sources.filter("tokens > 0").count()
    if n <= 1:
        return 1.0
    at = _moments(sources)
    t = 1.0 if entropy is None else _bisect(lambda t: at(t)[1] <= entropy * math.log(n))
    if passes is not None and at(t)[2] * budget_share > passes:
        t = max(t, _bisect(lambda t: at(t)[2] * budget_share <= passes))
    return t


def mix(docs: DataFrame, entropy: float | None = 0.95, passes: float | None = 4.0, budget: int | None = None, block_tokens: int = 1 << 18, source: str = "source") -> DataFrame:
    """One row for each use of a document: doc_id, source, n_tokens, epoch, block and place.

    Reading rows by (block, place) gives the training order.  Tokens are words; ``budget`` defaults
    to all tokens of ``docs``.  A source uses whole passes over its rows and then a prefix of its
    order; it overshoots its budget by less than one document.

    A null source is a source of its own, written as ''; null texts have no tokens and go along with
    their source's order; a source without tokens is not used; repeated rows are rows; other columns
    are ignored; an empty table gives an empty result."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), n_words(F.col("text")).alias("n_tokens"), F.xxhash64(F.lit(SEED), "doc_id", "text").alias("h")
    )
    rows = stash(rows)
    sources = stash(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens")))
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return rows.limit(0).select("doc_id", "source", "n_tokens", *[F.lit(0).cast("long").alias(c) for c in ("epoch", "block", "place")])
    budget = total if budget is None else budget
    t = exponent(sources, budget / total, entropy, passes)
    z = _moments(sources)(t)[0]
    weighed = sources.filter("tokens > 0").select("source", "tokens", F.round(F.pow(F.col("tokens") / F.lit(float(total)), F.lit(t)) / z * budget).cast("long").alias("target"))
    weighed = F.broadcast(weighed) if sources.limit(SMALL + 1).count() <= SMALL else weighed
    # The place of a row in its source's order: what the buckets before hold, and the rows before it
    # in its own bucket.
    rows = rows.withColumn("bucket", F.shiftrightunsigned("h", 64 - BUCKET_BITS).cast("int"))
    sums = rows.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"))
    earlier = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("source", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = W.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("own", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(sums, ["source", "bucket"]).join(weighed, "source")
    before = F.col("base") + F.col("own")
    whole = F.floor(F.col("target") / F.col("tokens"))
    uses = whole + (before < F.col("target") - whole * F.col("tokens")).cast("long")
    used = rows.withColumn("before", before).withColumn("epoch", F.explode(F.when(uses > 0, F.sequence(F.lit(0).cast("long"), uses - 1))))
    blocks = max(1, -(-budget // block_tokens))
    at = (F.col("epoch") * F.col("tokens") + F.col("before")).cast("double") / F.greatest(F.col("target"), F.lit(1))
    return used.select(
        "doc_id", "source", "n_tokens", "epoch", F.least(F.floor(at * blocks), F.lit(blocks - 1)).cast("long").alias("block"), F.xxhash64(F.lit(SEED + 1), "h", "epoch").alias("place")
    )


def shares(docs: DataFrame, entropy: float | None = 0.95, passes: float | None = 4.0, budget: int | None = None, source: str = "source") -> DataFrame:
    """source, tokens, weight: the normalised weights that ``mix`` realises."""
    sources = stash(docs.groupBy(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")).agg(F.sum(n_words(F.col("text"))).alias("tokens")).filter("tokens > 0"))
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    t = exponent(sources, (budget or total) / max(1, total), entropy, passes)
    z = _moments(sources)(t)[0] if total else 1.0
    return sources.select("source", "tokens", (F.pow(F.col("tokens") / F.lit(float(max(1, total))), F.lit(t)) / z).alias("weight"))
