"""Spelling variants by a trie over letter-group counts.

Words are arranged by their length and then by their counts of successive letter groups, a level for
each.  One edit changes those counts by one surplus and one deficit at most: a replaced character
takes one of each (or none, within a group), an inserted one a surplus.  A word therefore meets all
its variants by a depth-first walk that may spend one surplus and, at equal length, one deficit
after it; leaf words are verified.  Each pair is met once: from the shorter word, and at equal length
from the word with the smaller count where their counts first differ.

The trie is spread over the cluster.  Its upper levels are tables of nodes: a node of more than
``LEAF`` words is split by the next level, and the walks go down by joins, dying where there is no
node.  A leaf of that table goes to a task, which arranges its words by the remaining levels as
sorted rows of counts and carries on with the walks that arrive there, many at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linetrace.llm.common import Stash, scratch, stash

LETTERS = r"[a-zÀ-ÿ]"
SHORTEST, RAREST, DROPPED, RATIO = 6, 5, 199, 5
#: Words of a node that goes to a task as it is; walks that meet one copy of it.
LEAF, WALKS = 1 << 14, 1 << 16
#: Letter groups: the most frequent letters each are one, the rest are dealt to the last ones.
GROUPS, SHARED = 24, 4
#: Words of a node of a task's trie that are verified without going further down; walks at once.
FEW, AT_ONCE = 4, 1 << 12


def words(docs: DataFrame) -> DataFrame:
    """Words (word, n) of ``docs`` (doc_id, text): runs of letters, A-Z in lower case, one code point
    deleted where the run's hash says so.  Runs too short to leave a word are not built."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(low, F.lit(f"({LETTERS}{{{SHORTEST},}})"))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    found = runs.withColumn("h", h).select(F.when(F.col("h") % DROPPED == 0, cut).otherwise(F.col("run")).alias("word"))
    return found.filter(F.length("word") >= SHORTEST).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= RAREST)


def letter_groups(found: DataFrame) -> list[str]:
    """Groups of letters, the most frequent first.  There are 90 letters, whatever the input."""
    each = found.select(F.explode(F.split("word", "")).alias("c")).groupBy("c").count().filter("c <> ''")
    order = [r.c for r in each.orderBy(F.col("count").desc(), "c").collect()]
    single, rest = order[: GROUPS - SHARED], order[GROUPS - SHARED :]
    return single + ["".join(rest[k::SHARED]) for k in range(SHARED) if rest[k::SHARED]]


def _count_of(group: str) -> Column:
    return F.length("word") - F.length(F.translate("word", group, ""))


def _stored(found: DataFrame, levels: int, keep: Stash) -> tuple[DataFrame, list[DataFrame]]:
    """Words with their ``leaf``, and the nodes (node, ends) of each level that is in the table."""
    out, nodes, rest = None, [], found
    for level in range(levels):
        rest = rest.withColumn("node", F.slice("counts", 1, level + 1))
        sized = rest.groupBy("node").count()
        nodes.append(keep(sized.select("node", ((F.col("count") <= LEAF) | F.lit(level == levels - 1)).alias("ends"))))
        met = rest.join(nodes[-1], "node")
        here = met.filter("ends").select(F.col("node").alias("leaf"), "word", "n", "counts")
        out = here if out is None else out.unionByName(here)
        rest = keep(met.filter("not ends").drop("ends", "node"))
        if rest.isEmpty():
            break
    return keep(out), nodes


def _walks(found: DataFrame, nodes: list[DataFrame], keep: Stash) -> DataFrame:
    """Walks (leaf, word, n, counts, grown, spent) that arrive at leaves of the table.  grown: the
    sought words are longer by one; spent: 0 nothing, 1 a surplus, 2 a deficit too."""
    starts = F.explode(F.array(F.lit(0), F.lit(1))).alias("grown")
    rest = found.select("word", "n", "counts", starts).withColumn("node", F.array(F.col("counts")[0] + F.col("grown"))).withColumn("spent", F.lit(0))
    out = None
    for level, table in enumerate(nodes):
        met = rest.join(table, "node")
        here = met.filter("ends").select(F.col("node").alias("leaf"), "word", "n", "counts", "grown", "spent")
        out = here if out is None else out.unionByName(here)
        if level == len(nodes) - 1:
            break
        own = F.col("counts")[level + 1]
        step = lambda by, spent: F.struct((own + by).alias("count"), spent.cast("int").alias("spent"))  # noqa: B023, E731
        surplus, deficit = F.col("spent") == 0, (F.col("spent") == 1) & (F.col("grown") == 0) & (own > 0)
        steps = F.array_compact(F.array(step(0, F.col("spent")), F.when(surplus, step(1, F.lit(1))), F.when(deficit, step(-1, F.lit(2)))))
        rest = met.filter("not ends").select("word", "n", "counts", "grown", "node", F.explode(steps).alias("s"))
        rest = rest.select("word", "n", "counts", "grown", F.concat("node", F.array("s.count")).alias("node"), "s.spent")
    return keep(out)


class _Trie:
    """Words of one leaf, arranged by their counts from ``level`` on: a node is a stretch of sorted rows."""

    def __init__(self, found: list[str], sizes: list[int], counts: np.ndarray, level: int):
        order = np.lexsort(counts[:, level:].T[::-1]) if level < counts.shape[1] else np.arange(len(found))
        self.words = np.array(found, dtype=object)[order]
        self.sizes = np.array(sizes, dtype=np.int64)[order]
        self.counts = counts = counts[order]
        self.lo, self.hi = [np.zeros(1, np.int64)], [np.array([len(found)])]
        self.keys: list[np.ndarray] = []
        self.level = level
        node = np.zeros(len(found), dtype=np.int64)
        for k in range(level, counts.shape[1]):
            key = node << 32 | counts[:, k]
            new = np.flatnonzero(np.diff(key, prepend=-1))
            self.keys.append(key[new])
            self.lo.append(new)
            self.hi.append(np.append(new[1:], len(found)))
            node = np.repeat(np.arange(len(new)), self.hi[-1] - new)

    def candidates(self, counts: np.ndarray, grown: np.ndarray, spent: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a walk and a word (its place) that the budgets allow."""
        walk, node = np.arange(len(counts)), np.zeros(len(counts), dtype=np.int64)
        for depth in range(len(self.keys) + 1):
            lo, hi = self.lo[depth][node], self.hi[depth][node]
            ends = (hi - lo <= FEW) | (depth == len(self.keys))
            if ends.any():
                n = (hi - lo)[ends]
                first = np.repeat(np.cumsum(n) - n, n)
                yield np.repeat(walk[ends], n), np.repeat(lo[ends], n) + np.arange(n.sum()) - first
            if ends.all():
                return
            walk, node, spent = walk[~ends], node[~ends], spent[~ends]
            own, keys = counts[walk, self.level + depth].astype(np.int64), self.keys[depth]
            some = []
            deficit = (spent == 1) & (grown[walk] == 0) & (own > 0)
            for by, now, may in ((0, spent, None), (1, np.ones_like(spent), spent == 0), (-1, np.full_like(spent, 2), deficit)):
                at = np.arange(len(walk)) if may is None else np.flatnonzero(may)
                key = node[at] << 32 | own[at] + by
                place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                met = keys[place] == key
                some.append((walk[at[met]], place[met], now[at[met]]))
            walk, node, spent = (np.concatenate(x) for x in zip(*some, strict=True))


def one_edit(a: str, b: str) -> bool:
    """Whether b comes from a by one replaced or one inserted code point."""
    if len(b) - len(a) not in (0, 1) or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


PAIRS = "a string, a_n long, b string, b_n long"


def _met(trie: _Trie, walks: list[tuple], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(walks), AT_ONCE):
        part = walks[at : at + AT_ONCE]
        grown, spent = (np.array([w[k] for w in part], dtype=np.int64) for k in (2, 3))
        out = []
        own = counts[at : at + AT_ONCE].astype(np.int64)
        for walk, place in trie.candidates(own, grown, spent):
            apart = trie.counts[place, 1:] - own[walk, 1:]
            first = apart[np.arange(len(apart)), (apart != 0).argmax(axis=1)]
            fits = (np.abs(apart).sum(axis=1) <= 2) & (first >= 0)
            same = (first == 0).tolist()
            for k in np.flatnonzero(fits).tolist():
                word, n, longer, _ = part[walk[k]]
                other = trie.words[place[k]]
                # At equal counts both words walk to each other: one of the two pairs is taken.
                if len(other) - len(word) == longer and (not same[k] or word < other) and one_edit(word, other):
                    out.append((word, n, other, int(trie.sizes[place[k]])))
        if out:
            columns = zip(zip(*out, strict=True), (pa.string(), pa.int64()) * 2, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], ["a", "a_n", "b", "b_n"])


def _counts(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _pair_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by leaf and part, words before walks: a task holds the words of one leaf."""
    now, trie, level = None, None, 0
    held: list[tuple[list[str], list[int], np.ndarray]] = []
    for batch in batches:
        leaf, part = batch.column("leaf").to_pylist(), batch.column("part").to_pylist()
        walks, counts = np.asarray(batch.column("spent").fill_null(-1)), _counts(batch.column("counts"))
        found, sizes, grown = (batch.column(c).to_pylist() for c in ("word", "n", "grown"))
        kind = walks >= 0
        keys = list(zip(map(tuple, leaf), part, strict=True))
        borders = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1] or kind[i] != kind[i - 1]), len(keys)]
        for a, b in zip(borders, borders[1:], strict=False):
            if a == b:
                continue
            if keys[a] != now:
                now, trie, held, level = keys[a], None, [], len(leaf[a])
            if not kind[a]:
                held.append((found[a:b], sizes[a:b], counts[a:b]))
                continue
            if trie is None and held:
                trie = _Trie([w for x in held for w in x[0]], [n for x in held for n in x[1]], np.concatenate([x[2] for x in held]), level)
                held = []
            if trie is not None:
                yield from _met(trie, list(zip(found[a:b], sizes[a:b], grown[a:b], walks[a:b].tolist(), strict=True)), counts[a:b])


def near_pairs(found: DataFrame, keep: Stash) -> DataFrame:
    """Pairs (a, a_n, b, b_n) of words (word, n) that differ by exactly one edit, each pair once.

    A leaf that many walks reach is copied, with ``WALKS`` of them to a copy."""
    groups = letter_groups(found)
    found = keep(found.withColumn("counts", F.array(F.length("word"), *[_count_of(g) for g in groups]).cast("array<int>")))
    stored, nodes = _stored(found, len(groups) + 1, keep)
    walks = _walks(found, nodes, keep)
    parts = walks.groupBy("leaf").agg(F.ceil(F.count("*") / WALKS).cast("int").alias("parts"))
    walks = walks.join(parts, "leaf").withColumn("part", F.pmod(F.xxhash64("word", "grown"), "parts").cast("int")).drop("parts")
    stored = stored.join(parts, "leaf").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    rows = stored.withColumn("grown", F.lit(None).cast("int")).withColumn("spent", F.lit(None).cast("int")).unionByName(walks)
    rows = rows.select("leaf", "part", "word", "n", "counts", "grown", "spent").repartition("leaf", "part")
    rows = rows.sortWithinPartitions("leaf", "part", F.col("spent").isNotNull())
    return keep(rows.mapInArrow(_pair_batches, PAIRS))


def roots(forms: DataFrame, steps: int, keep: Stash) -> DataFrame:
    """(word, root) for words with a form (word, form): ``steps`` forms or more are followed, twice as
    many each round."""
    out = keep(forms.select("word", F.col("form").alias("root")))
    for _ in range(max(0, ceil(log(max(1, steps), 2)))):
        nxt = out.select(F.col("word").alias("w"), F.col("root").alias("r"))
        out = keep(out.join(nxt, F.col("root") == F.col("w"), "left").select("word", F.coalesce("r", "root").alias("root")))
    return out


def variants(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n and root of each word of ``docs`` (doc_id, text).

    Words are runs of Latin letters of six code points and more that occur five times or more, after
    the deletions of ``words``.  A word's form is its most frequent near word (ties: the first in
    code-point order) if that is at least ``RATIO`` times as frequent; the root is where forms lead.

    Null and blank texts have no words; a null doc_id counts as an empty one; repeated rows count
    again; very long texts and runs are whole; an empty table gives an empty result; other columns
    are ignored."""
    with scratch(docs.sparkSession) as keep:
        found = keep(words(docs))
        most = found.agg(F.max("n")).first()[0] or 1
        side = lambda a, b: F.struct(F.col(a).alias("word"), F.col(b).alias("o"), F.col(f"{b}_n").alias("o_n"))
        ends = near_pairs(found, keep).select(F.explode(F.array(side("a", "b"), side("b", "a"))).alias("e"))
        order = F.struct((-F.col("e.o_n")).alias("m"), F.col("e.o").alias("form"))
        best = ends.groupBy(F.col("e.word").alias("word")).agg(F.count("*").alias("n_near"), F.min(order).alias("best"))
        rows = found.join(best, "word", "left")
        form = F.when(-F.col("best.m") >= RATIO * F.col("n"), F.col("best.form"))
        form_n = F.when(form.isNotNull(), -F.col("best.m"))
        rows = keep(rows.select("word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), form_n.alias("form_n")))
        # Each step multiplies n by RATIO at least.
        steps = floor(log(max(1, most), RATIO)) + 1
        ends_at = roots(rows.filter("form is not null"), steps, keep)
        return stash(rows.join(ends_at, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
