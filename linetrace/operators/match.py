"""Ranked retrieval of canonical lines for noisy queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linetrace.functions.scoring import Coded, partial_ratios, ratio
from linetrace.functions.text import ALIKE, COVERED, LONG_TOKEN, first_letters, length_softening, phonetic_key, tokens

POOL, PREFILTER, MIN_LETTERS = 50, 1500, 3
#: Characters of queries in one block; each block is one pass over the lines.
BLOCK_CHARS = 1 << 18
ACCEPT, STRONG, LEAD = 60.0, 40.0, 1.8
SCORED = "query_id string, order_id long, passage_id long, partial double, coverage double, score double"


@lru_cache(maxsize=1 << 18)
def _alike(a: str, b: str) -> bool:
    return ratio(a, b) >= COVERED


def coverage(query: str, line: str) -> float:
    """Share of the query's long tokens that resemble some token of the line, less for short queries."""
    wanted = [t for t in query.split() if len(t) >= LONG_TOKEN]
    have = set(line.split())
    met = sum(t in have or any(_alike(t, h) for h in have) for t in wanted)
    return met / len(wanted) * min(1.0, len(wanted) / 4) if wanted else 0.0


#: What a line covers of a query, from 0 to 1.
Covers = Callable[[str, str], float]


def _letters(text: str) -> str:
    return "".join(t[0] for t in text.split()).translate(str.maketrans(*ALIKE))


#: Lines that meet a query at once; each such part raises the score that later ones must reach, the first,
#: smaller one most.
FIRST, PART = 1 << 10, 1 << 14


def _pool_batches(batches: Iterator[pa.RecordBatch], queries, pool: int, letters: bool) -> Iterator[pa.RecordBatch]:
    """The best lines of this task for every query; ties go to the lower line."""
    asked = [(query_id, _letters(query) if letters else query) for query_id, query in queries.value]
    # Of each query the best so far: score, line, passage and text, best first.
    best = {query_id: (np.zeros(0), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=object)) for query_id, _ in asked}
    first = True
    for batch in batches:
        order, passage = (np.asarray(batch.column(c)) for c in ("order_id", "passage_id"))
        text = np.array(batch.column("norm").to_pylist(), dtype=object)
        coded = Coded(batch.column("against").to_pylist())
        cuts = [0, *range(FIRST if first else PART, len(text), PART), len(text)] if len(text) else [0]
        first = first and not len(text)
        for at, end in zip(cuts, cuts[1:], strict=False):
            part = coded.some(at, end)
            for query_id, query in asked:
                held = best[query_id]
                floor = held[0][-1] if len(held[0]) == pool else 0.0
                soft = np.sqrt(np.minimum(part.size, len(query)) / np.maximum(np.maximum(part.size, len(query)), 1)) if letters else 1.0
                scores = partial_ratios(query, part, floor / np.maximum(soft, 1e-9)) * soft
                take = np.flatnonzero(scores >= floor)
                if not len(take):
                    continue
                new = tuple(np.concatenate((x, y[at + take])) for x, y in zip(held[1:], (order, passage, text), strict=True))
                new = (np.concatenate((held[0], scores[take])), *new)
                rank = np.lexsort((new[1], -new[0]))[:pool]
                best[query_id] = tuple(x[rank] for x in new)
    columns = [np.repeat(np.array([q for q, _ in asked], dtype=object), [len(best[q][0]) for q, _ in asked]), *(np.concatenate([best[q][k] for q, _ in asked]) for k in (1, 2, 0, 3))]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.string())
    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], ["query_id", "order_id", "passage_id", "partial", "norm"])


def _blocks(queries: DataFrame) -> Iterator[list[tuple[str, str]]]:
    block, size = [], 0
    for r in queries.select("query_id", "query").toLocalIterator():
        block.append((r.query_id, r.query))
        size += len(r.query)
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def best_by_query(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """Rows of rank 1 to n of each query, with ``rank``."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= n)


def candidate_pool(queries: DataFrame, lines: DataFrame, pool: int = POOL, letters: bool = False) -> DataFrame:
    """The ``pool`` best lines (order_id, passage_id, norm) of each query (query_id, query): by
    partial ratio, or by the softened partial ratio of phonetic first letters.

    Queries go to the lines in blocks of bounded size, so no line is shuffled; every task returns at
    most ``pool`` rows a query."""
    spark, out = lines.sparkSession, None
    schema = "query_id string, order_id long, passage_id long, partial double, norm string"
    against = phonetic_key(first_letters(tokens(F.col("norm")))) if letters else F.col("norm")
    lines = lines.select("order_id", "passage_id", "norm", against.alias("against"))
    for block in _blocks(queries):
        shared = spark.sparkContext.broadcast(block)
        part = lines.mapInArrow(lambda b, s=shared: _pool_batches(b, s, pool, letters), schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    return best_by_query(out, pool, F.col("partial").desc(), F.col("order_id")).drop("rank")


def _partial_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial ratios of given pairs, a query's lines at once."""
    for batch in batches:
        queries, lines = batch.column("query").to_pylist(), batch.column("norm").to_pylist()
        own: dict[str, list[int]] = {}
        for i, q in enumerate(queries):
            own.setdefault(q, []).append(i)
        partial = np.zeros(len(lines))
        for q, at in own.items():
            partial[at] = partial_ratios(q, [lines[i] for i in at])
        columns = [batch.column(c) for c in ("query_id", "order_id", "passage_id", "query", "norm")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(partial)], ["query_id", "order_id", "passage_id", "query", "norm", "partial"])


PAIRED = "query_id string, order_id long, passage_id long, query string, norm string, partial double"


def _score_batches(batches: Iterator[pa.RecordBatch], covers: Covers) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        partial = batch.column("partial").to_pylist()
        cover = [covers(a, b) for a, b in zip(batch.column("query").to_pylist(), batch.column("norm").to_pylist(), strict=True)]
        columns = [batch.column(c) for c in ("query_id", "order_id", "passage_id", "partial")]
        score = [a * b for a, b in zip(partial, cover, strict=True)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(cover, pa.float64()), pa.array(score, pa.float64())], ["query_id", "order_id", "passage_id", "partial", "coverage", "score"])


def rescore(pool: DataFrame, covers: Covers = coverage) -> DataFrame:
    """Coverage and score of a pool (query_id, order_id, passage_id, query, norm, partial): the partial
    ratio times what ``covers`` says of a query and a line, the share of its tokens unless another is given."""
    rows = pool.select("query_id", "order_id", "passage_id", "query", "norm", "partial")
    return rows.mapInArrow(lambda b: _score_batches(b, covers), SCORED)


def rank_matches(scored: DataFrame, k: int) -> DataFrame:
    """Final order: score, partial ratio, coverage, then the later line."""
    return best_by_query(scored, k, F.col("score").desc(), F.col("partial").desc(), F.col("coverage").desc(), F.col("order_id").desc())


def fuzzy_topk_join(queries: DataFrame, lines: DataFrame, k: int = 5, pool: int = POOL, covers: Covers = coverage) -> DataFrame:
    """Exact: the pool by partial ratio over all lines, rescored with token coverage or another measure
    from 0 to 1 (``covers``), best k."""
    found = candidate_pool(queries, lines, pool).join(queries.select("query_id", "query"), "query_id")
    return rank_matches(rescore(found, covers), k)


def prefiltered_topk_join(queries: DataFrame, lines: DataFrame, k: int = 5, prefilter: int = PREFILTER, pool: int = POOL) -> DataFrame:
    """As ``fuzzy_topk_join`` over the best ``prefilter`` lines by first letters; queries of fewer
    than three words search everything."""
    long_enough = F.size(F.split("query", " ")) >= MIN_LETTERS
    few = candidate_pool(queries.filter(long_enough), lines, prefilter, letters=True).join(queries.select("query_id", "query"), "query_id")
    scored = few.select("query_id", "order_id", "passage_id", "query", "norm").mapInArrow(_partial_batches, PAIRED)
    kept = best_by_query(scored, pool, F.col("partial").desc(), F.col("order_id")).drop("rank")
    rest = candidate_pool(queries.filter(~long_enough), lines, pool).join(queries.select("query_id", "query"), "query_id")
    return rank_matches(rescore(kept.unionByName(rest)), k)


def scoped_topk_join(queries: DataFrame, lines: DataFrame, scopes: DataFrame, k: int = 5, pool: int = POOL) -> DataFrame:
    """Candidates are the lines of the passages given for each query (query_id, passage_id); the
    partial ratio is softened by the lengths and carried into the score."""
    near = scopes.join(lines.select("order_id", "passage_id", "norm"), "passage_id").join(queries.select("query_id", "query"), "query_id")
    scored = near.select("query_id", "order_id", "passage_id", "query", "norm").mapInArrow(_partial_batches, PAIRED)
    soft = scored.withColumn("partial", length_softening(F.col("partial"), F.col("query"), F.col("norm")))
    return rank_matches(rescore(best_by_query(soft, pool, F.col("partial").desc(), F.col("order_id"))), k)


def first_letters_topk(queries: DataFrame, lines: DataFrame, k: int = 5, cutoff: float = 0.8) -> DataFrame:
    """Live path: phonetic first letters only, coverage 1, and a cutoff relative to the best."""
    found = candidate_pool(queries.filter(F.size(F.split("query", " ")) >= MIN_LETTERS), lines, k, letters=True)
    scored = found.select("query_id", "order_id", "passage_id", "partial", F.lit(1.0).alias("coverage"), F.col("partial").alias("score"))
    return relative_cutoff(rank_matches(scored, k), cutoff)


def relative_cutoff(ranked: DataFrame, cutoff: float) -> DataFrame:
    """Matches of at least ``cutoff`` times the best score of their query; 0 keeps all."""
    top = F.max("score").over(W.partitionBy("query_id"))
    return ranked.withColumn("top", top).filter(F.col("score") >= cutoff * F.col("top")).drop("top") if cutoff else ranked


def runner_up_gate(ranked: DataFrame, key: str = "query_id") -> DataFrame:
    """The best match of each query, whether it is accepted, and by how much it leads."""
    w = W.partitionBy(key).orderBy("rank")
    led = ranked.withColumn("runner_up", F.coalesce(F.lead("score").over(w), F.lit(0.0))).filter("rank = 1")
    lead = (F.col("runner_up") == 0) | (F.col("score") >= LEAD * F.col("runner_up"))
    return led.withColumn("accepted", (F.col("score") >= ACCEPT) | ((F.col("score") >= STRONG) & lead))


def cascade_match(queries: DataFrame, lines: DataFrame, current: DataFrame, recent: DataFrame, k: int = 3) -> DataFrame:
    """The first tier that is accepted: the current passage, recent passages without it, all lines.
    ``current`` and ``recent`` hold (query_id, passage_id)."""
    out, rest = None, queries
    others = recent.join(current, ["query_id", "passage_id"], "left_anti")
    for tier, scope in enumerate((current, others, None), 1):
        found = scoped_topk_join(rest, lines, scope, k) if scope is not None else prefiltered_topk_join(rest, lines, k)
        good = runner_up_gate(found).filter("accepted").withColumn("tier", F.lit(tier))
        good = good.checkpoint() if rest.sparkSession.sparkContext.getCheckpointDir() else good.persist()
        out = good if out is None else out.unionByName(good)
        rest = rest.join(good.select("query_id"), "query_id", "left_anti")
    return out


def nearby_lines(events: DataFrame, lines: DataFrame, reach: int) -> DataFrame:
    """Lines within ``reach`` order ids of each event's last confident line, by bucketed ranges."""
    wide = events.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("at") - reach) / reach), F.floor((F.col("at") + reach) / reach))))
    placed = lines.withColumn("bucket", F.floor(F.col("order_id") / reach))
    return wide.join(placed, "bucket").filter(F.abs(F.col("order_id") - F.col("at")) <= reach).drop("bucket")
