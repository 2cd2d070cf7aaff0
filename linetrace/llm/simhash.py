"""SimHash near-duplicates by the generalised pigeonhole principle.

Bits that vary together are grouped into partitions.  If thresholds t_i (at least -1) satisfy
sum(t_i + 1) = radius + 1, two fingerprints within the radius are within t_i of each other in some
partition i; a partition with t_i = -1 is never probed.  Dynamic programming picks the thresholds,
and the best of several partitionings, by estimated candidates plus probes.  Candidates are
verified on all 64 bits, and components follow from the verified links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linetrace.llm.common import Stash, carried, scratch, sent_if_few, stash

BITS, SEED = 64, 42
#: A bucket of more fingerprints is probed again by its remaining bits, so often at most.
BUCKET, DEPTH = 64, 4
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of ``size`` words, repeats included, A-Z lower-cased."""
    parts = text.encode().translate(_LOWER).split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = np.concatenate(([0], ends[:-1]))
    if len(parts) > size:
        starts, ends = starts[: len(parts) - size + 1], ends[size - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends - 1).tolist(), strict=True)], dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; as a signed 64-bit number."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 4096):  # bounded memory for very long texts
        ones += np.unpackbits(hashes[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def _print_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [fingerprint(shingle_hashes(t.as_py() or "", size)) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """doc_id and its 64-bit fingerprint fp.  Texts without words (null, blank) get zero; texts of
    fewer words than a shingle are one shingle."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda b: _print_batches(b, shingle_words), "doc_id long, fp long")


def _joint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((BITS, BITS), dtype=np.int64)
    for batch in batches:
        x = np.unpackbits(np.asarray(batch.column("fp")).astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1].astype(np.float64)
        total += (x.T @ x).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS)), pa.array(total.ravel())], ["cell", "n"])


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j (0: lowest) both set.  Over all rows;
    what reaches the driver is 64 x 64 counts, whatever the input."""
    joint = np.zeros(BITS * BITS, dtype=np.int64)
    for row in nodes.select("fp").mapInArrow(_joint_batches, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        joint[row.cell] = row.n
    return nodes.count(), joint.reshape(BITS, BITS)


def correlated_groups(n: int, joint: np.ndarray, parts: int) -> list[list[int]]:
    """Bits dealt to ``parts`` groups of about equal size, each grown from its most correlated bit."""
    p = np.diag(joint) / max(1, n)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    r = np.abs(joint / max(1, n) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(r, 0)
    free, out = set(range(BITS)), []
    for k in range(parts):
        size = -(-len(free) // (parts - k))
        pool = sorted(free)
        group = [max(pool, key=lambda b: (r[b, pool].sum(), -b))]
        while len(group) < size:
            group.append(max(sorted(free - set(group)), key=lambda b: (r[b, group].mean(), -b)))
        free -= set(group)
        out.append(sorted(group))
    return out


def _mask(bits: Sequence[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << BITS) if m >> (BITS - 1) else m


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = total and the least sum of costs[i][t_i + 1]."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for spend in range(min(len(row) - 1, total - used) + 1):
                new = (cost + row[spend], [*chosen, spend - 1])
                if used + spend not in step or new[0] < step[used + spend][0]:
                    step[used + spend] = new
        best = step
    return best[total]


def plan_partitions(nodes: DataFrame, radius: int) -> tuple[list[list[int]], list[int]]:
    """Partitions and thresholds of the least estimated work.

    The pairs that agree in a whole partition are counted over all fingerprints.  Those that differ
    there in k bits are estimated from them by the k-th elementary symmetric polynomial of the odds
    of disagreement of its bits.  A probe counts as four comparisons."""
    n, joint = bit_statistics(nodes)
    p = np.diag(joint) / max(1, n)
    agree = p**2 + (1 - p) ** 2
    layouts = [correlated_groups(n, joint, m) for m in range(1, radius + 2)]
    keyed = [(m, i, _mask(g)) for m, layout in enumerate(layouts) for i, g in enumerate(layout)]
    cells = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(mask)).alias("bits")) for m, i, mask in keyed])
    counts = nodes.select(F.explode(cells).alias("c")).groupBy("c").count()
    same = {(r.m, r.i): float(r.pairs) for r in counts.groupBy("c.m", "c.i").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("pairs")).collect()}
    best = None
    for m, layout in enumerate(layouts):
        costs = []
        for i, group in enumerate(layout):
            base = max(same.get((m, i), 0.0), n * (n - 1) / 2 * float(np.prod(agree[group])))
            poly = np.zeros(radius + 1)
            poly[0] = 1
            for odds in (1 - agree[group]) / np.maximum(agree[group], 1e-9):
                poly[1:] += odds * poly[:-1]
            row, probes = [0.0], 0
            for t in range(radius + 1):
                probes += comb(len(group), t)
                row.append(base * float(poly[: t + 1].sum()) + 4.0 * n * probes)
            costs.append(row)
        cost, thresholds = allocate(costs, radius + 1)
        if best is None or cost < best[0]:
            best = (cost, layout, thresholds)
    return best[1], best[2]


def _probe(groups: list[list[int]], thresholds: list[int], index: bool) -> Column:
    """Keys under which a fingerprint is kept (index) or looked up."""
    out = []
    for i, (group, t) in enumerate(zip(groups, thresholds, strict=True)):
        for size in range(0, (0 if index else t) + 1 if t >= 0 else 0):
            for flips in combinations(group, size):
                bits = F.col("fp").bitwiseXOR(F.lit(_mask(flips))) if flips else F.col("fp")
                out.append(F.struct(F.lit(i).alias("path"), F.xxhash64(F.lit(i), bits.bitwiseAND(F.lit(_mask(group)))).alias("key")))
    return F.explode(F.array(*out))


def links(nodes: DataFrame, radius: int, keep: Stash = stash) -> DataFrame:
    """All pairs a < b of distinct fingerprints ``fp`` that differ in at most ``radius`` bits.

    A bucket of many fingerprints is never joined with itself: its members are dealt again by the
    radius + 1 parts of their remaining bits, one of which two partners must share.  After ``DEPTH``
    deals a bucket's fingerprints differ at most in (2/3)**4 of the bits that were not its first key
    (radius 2: some ten), so no bucket of the last join can be large."""
    groups, thresholds = plan_partitions(nodes, radius)
    index = nodes.select("fp", _probe(groups, thresholds, True).alias("c")).select("fp", "c.*")
    probe = nodes.select("fp", _probe(groups, thresholds, False).alias("c")).select("fp", "c.*")
    rests = [[b for b in range(BITS) if b not in group] for group in groups]
    found = []
    for depth in range(DEPTH + 1):
        hot = None
        if depth < DEPTH:
            hot = keep(index.groupBy("key").count().filter(F.col("count") > BUCKET).select("key"))
            hot = None if hot.isEmpty() else hot
        a, b = (x if hot is None else x.join(hot, "key", "left_anti") for x in (index, probe))
        pair = (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius) & (F.col("a.fp") < F.col("b.fp"))
        found.append(a.alias("a").join(b.alias("b"), (F.col("a.key") == F.col("b.key")) & pair).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")))
        # A bucket's key fits one partition only up to hash collisions, which verification removes.
        if hot is None:
            break
        parts = [[rest[k :: radius + 1] for k in range(radius + 1)] for rest in rests]
        masks = F.array(*[F.array(*[F.lit(_mask(x)) for x in row]) for row in parts])
        deal = F.transform(
            masks[F.col("path")],
            lambda m, k: F.struct((F.col("path") * (radius + 1) + k).alias("path"), F.xxhash64("key", k, F.col("fp").bitwiseAND(m)).alias("key")),
        )
        index, probe = (x.join(hot, "key", "left_semi").select("fp", F.explode(deal).alias("c")).select("fp", "c.*") for x in (index, probe))
        rests = [[b for b in rest if b not in part] for rest, row in zip(rests, parts, strict=True) for part in row]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def components(edges: DataFrame, keep: Stash = stash) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node that it reaches.

    Alternates large-star and small-star steps; each is a grouped minimum and a join, so no
    component is ever gathered.  The edges of each round are written, and the rounds end when a
    round changes nothing."""
    swap = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    state = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    edges = keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = state(edges)
    while before[0]:
        both = swap(edges)
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = keep(small.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        now = state(edges)
        if now == before:
            break
        before = now
    tops = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(tops)


def near_duplicates(docs: DataFrame, shingle_words: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for each row of ``docs`` (doc_id, text):
    the smallest doc_id that is reachable over links of at most ``radius`` differing bits.

    Rows of one fingerprint are one node, so copies are never paired.  Null and blank texts have
    fingerprint zero and link like any other.  A null doc_id is kept; it never names a component
    unless the component has no other.  A bit that is set in just half of the hashes is 0.  Very long
    texts are hashed whole, a few thousand shingles at a time.  Repeated rows give repeated results.
    Other columns are ignored, an empty table gives an empty result."""
    prints = stash(fingerprints(docs, shingle_words))
    with scratch(docs.sparkSession) as keep:
        nodes = keep(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
        roots = components(links(nodes, radius, keep), keep)
        named = keep(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root")))
        ids = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
        named = stash(named.join(ids, "root").select("fp", "component_id"))
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Cells that count all shingles of the corpus by their first bits, to tell frequent ones from rare ones.
CELL_BITS = 16
#: Members of a shingle's bucket that meet in one task.
MEET = 1024
#: Words of the short form of a parity, which goes along where there is a row for each shingle.
BRIEF = 8


def prefix_length(n: int, share: float) -> int:
    """So many first shingles of a set of ``n``: whoever misses them all has fewer than ``share`` of it."""
    return n - math.ceil(share * n - 1e-9) + 1 if n else 0


def _load_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << CELL_BITS, dtype=np.int64)
    for batch in batches:
        for t in batch.column("text"):
            own = np.unique(shingle_hashes(t.as_py() or "", size))
            total += np.bincount((own >> np.uint64(BITS - CELL_BITS)).astype(np.int64), minlength=1 << CELL_BITS)
    cells = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total[cells])], ["cell", "n"])


def cell_loads(docs: DataFrame, size: int) -> np.ndarray:
    """How many shingles of all documents fall into each cell.  A shingle that very many documents
    hold makes its cell stand out; what reaches the driver is one number a cell, whatever the input.
    The loads only put shingles in an order, rare ones first; any order gives the same groups."""
    out = np.zeros(1 << CELL_BITS, dtype=np.int64)
    rows = docs.select("text").mapInArrow(lambda b: _load_batches(b, size), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    for r in rows.toLocalIterator():
        out[r.cell] = r.n
    return out


def parity(own: np.ndarray) -> np.ndarray:
    """For each of at least twice as many bits as there are shingles, a power of two: whether an odd
    number of shingles falls on it, in words of 64.  Folding the second half onto the first by xor
    gives the parity for half as many bits."""
    bits = max(BITS, 1 << (2 * len(own) - 1).bit_length()) if len(own) else BITS
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _profile_batches(batches: Iterator[pa.RecordBatch], size: int, similarity: float, loads: Broadcast) -> Iterator[pa.RecordBatch]:
    """Fingerprint, a name for the set of shingles, its size, its rarest shingles and its parity."""
    for batch in batches:
        prints, signs, sizes, rare, parities, briefs = [], [], [], [], [], []
        for t in batch.column("text"):
            hashes = shingle_hashes(t.as_py() or "", size)
            prints.append(fingerprint(hashes))
            own = np.unique(hashes)
            signs.append(xxhash.xxh64_intdigest(own.tobytes(), SEED) - (1 << 63))
            sizes.append(len(own))
            load = loads.value[(own >> np.uint64(BITS - CELL_BITS)).astype(np.int64)]
            rare.append(own[np.lexsort((own, load))][: prefix_length(len(own), similarity)].view(np.int64))
            parities.append(parity(own))
            briefs.append(np.bitwise_xor.reduce(parities[-1].reshape(-1, min(BRIEF, len(parities[-1]))), axis=0))
        numbers = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "k1", "k2")), pa.array(prints, pa.int64()), pa.array(signs, pa.int64()), pa.array(sizes, pa.int32()), pa.array(rare, numbers), pa.array(parities, numbers),
             pa.array(briefs, numbers)],
            ["doc_id", "k1", "k2", "fp", "node", "n", "rare", "parity", "brief"],
        )


PROFILE = "doc_id long, k1 long, k2 int, fp long, node long, n int, rare array<long>, parity array<long>, brief array<long>"


def _set_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.unique(shingle_hashes(t.as_py() or "", size)).view(np.int64) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])


def _bits_apart(a: Column, b: Column) -> Column:
    """Bits in which two parities differ, the longer one folded: at most the shingles that only one
    of the two sets has.  One is as long as the other or twice so."""
    short = F.least(F.size(a), F.size(b))
    folded = lambda p, i: F.get(p, i).bitwiseXOR(F.coalesce(F.get(p, i + short), F.lit(0).cast("long")))
    words = F.transform(F.sequence(F.lit(0), short - 1), lambda i: F.bit_count(folded(a, i).bitwiseXOR(folded(b, i))))
    return F.aggregate(words, F.lit(0), lambda s, x: s + x)


def _may_be_similar(a: str, b: str, sketch: str, similarity: float) -> Column:
    """Whether sizes and parities (``sketch``) of two sides, whose columns begin so, allow the similarity."""
    t = similarity
    both, least = F.col(f"{a}n") + F.col(f"{b}n"), F.least(F.col(f"{a}n"), F.col(f"{b}n"))
    apart = _bits_apart(F.col(f"{a}{sketch}"), F.col(f"{b}{sketch}"))
    return (least >= t * (both - least) - 1e-9) & (least > 0) & (apart <= (1 - t) / (1 + t) * both + 1e-9)


def _neighbours(shared: DataFrame) -> DataFrame:
    """Pairs (x, y) of texts that stand next to each other in a bucket, in an order of its own; a large
    bucket is first dealt to parts.  A text meets others at random in each of its buckets."""
    h = F.xxhash64("node", "shingle")
    part = F.pmod(F.xxhash64(h), F.ceil(F.col("count") / BUCKET))
    beside = W.partitionBy("shingle", "part").orderBy("h", "node")
    rows = shared.select("shingle", "node", h.alias("h"), part.alias("part")).withColumn("next", F.lead("node").over(beside)).filter("next is not null")
    return rows.select(F.least("node", "next").alias("x"), F.greatest("node", "next").alias("y"))


def _nearest(close: DataFrame) -> DataFrame:
    """Of each text's pairs (x, y, apart) the nearest one, and two more where it has them."""
    ends = close.select(F.explode(F.array(F.struct(F.col("x").alias("node"), F.col("y").alias("other")), F.struct(F.col("y").alias("node"), F.col("x").alias("other")))).alias("e"), "apart").select("e.*", "apart")
    kind = F.pmod(F.xxhash64("other"), F.lit(3))
    best = ends.groupBy("node").agg(*[F.min(F.when(kind == k, F.struct("apart", "other"))).alias(f"b{k}") for k in range(3)])
    found = best.select("node", F.explode(F.array_compact(F.array("b0.other", "b1.other", "b2.other"))).alias("other"))
    return found.select(F.least("node", "other").alias("x"), F.greatest("node", "other").alias("y")).distinct()


def _unresolved(shared: DataFrame, roots: DataFrame, nodes: DataFrame, similarity: float, keep: Stash) -> DataFrame:
    """Pairs (x, y) from different groups that share one of their rarest shingles and may be similar.

    ``shared``: shingle, at, node, n and count.  Of two sets the longer one must show the shingle
    among its first n - t n + 1, the shorter one among its first n - 2 t n / (1 + t) + 1, and neither
    may stand so late that too few shingles would follow.  A bucket is split: members of its largest
    group never meet each other, and the shorter sets are dealt to tasks, at most ``MEET`` to one."""
    t = similarity
    rows = shared.filter("count > 2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = keep(rows.select("shingle", "at", "node", "n", "root"))
    sizes = rows.groupBy("shingle", "root").count()
    by = sizes.groupBy("shingle").agg(F.sum("count").alias("all"), F.max(F.struct("count", "root")).alias("m"), F.count("*").alias("groups")).filter("groups > 1")
    by = by.select("shingle", F.col("m.root").alias("top"), F.ceil(F.col("m.count") / MEET).alias("top_parts"), F.ceil((F.col("all") - F.col("m.count")) / MEET).alias("parts"))
    rows = rows.join(by, "shingle").withColumn("main", F.col("root") == F.col("top"))
    rows = keep(rows.join(nodes.select("node", "brief"), "node"))
    here = F.when(F.col("main"), F.col("top_parts")).otherwise(F.col("parts"))
    kept = ("shingle", "at", "node", "n", "root", "brief")
    short = rows.filter(F.col("at") <= F.col("n") - F.ceil(2 * t / (1 + t) * F.col("n") - 1e-9))
    short = short.select(*kept, "main", F.pmod(F.xxhash64("node"), here).cast("long").alias("part"))
    spread = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    main_too = F.when(~F.col("main"), F.transform(spread(F.col("top_parts")), lambda p: F.struct(F.lit(True).alias("main"), p.alias("part"))))
    places = F.concat(F.transform(spread(F.col("parts")), lambda p: F.struct(F.lit(False).alias("main"), p.alias("part"))), F.coalesce(main_too, F.array().cast("array<struct<main: boolean, part: long>>")))
    long_ = rows.select(*kept, F.explode(places).alias("p")).select(*kept, "p.*")
    a, b = short.alias("a"), long_.alias("b")
    left = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at"))
    ordered = (F.col("a.n") < F.col("b.n")) | (F.col("a.n") == F.col("b.n")) & (F.col("a.node") < F.col("b.node"))
    fits = (F.col("a.root") != F.col("b.root")) & ordered & (left >= t / (1 + t) * (F.col("a.n") + F.col("b.n")) - 1e-9) & _may_be_similar("a.", "b.", "brief", t)
    same = (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.main") == F.col("b.main")) & (F.col("a.part") == F.col("b.part"))
    pairs = a.join(b, same & fits).select(F.col("a.node").alias("x"), F.col("b.node").alias("y"))
    return pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))


def similar_groups(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8, radius: int = 2) -> DataFrame:
    """(k1, k2, doc_id, node, root) of each row of ``carried`` documents: node names the texts of one
    set of shingles, root a group of texts linked by a Jaccard similarity of ``similarity`` or more.

    Candidates are fingerprints within ``radius`` bits by the generalised pigeonhole, and texts that
    share one of their rarest shingles, which two sets of that similarity must (prefix filter).  The
    members of a shingle's bucket first meet only their neighbours there, and each text's nearest
    candidates are verified; that joins large groups without comparing all their pairs.  Then the
    other candidates, and all pairs of a bucket, are compared as far as they are not yet in one
    group, so no link is lost.

    Pairs whose parities show that they differ too much are dropped, all others are verified on
    whole sets of 64-bit hashes.  A verified pair costs little more than twice the longer of its two
    sets, and there are a few pairs for each text.

    Texts without words (null, blank) are one group; fewer words than a shingle are one shingle;
    very long texts are whole sets; a null doc_id and repeated rows are rows like any other; an
    empty table gives an empty result."""
    spark, t = docs.sparkSession, similarity
    loads = spark.sparkContext.broadcast(cell_loads(docs, shingle_words))
    with scratch(spark) as keep:
        profile = keep(docs.select("doc_id", "k1", "k2", "text").mapInArrow(lambda b: _profile_batches(b, shingle_words, t, loads), PROFILE))
        carried_on = ("fp", "n", "rare", "parity", "brief")
        nodes = keep(profile.groupBy("node").agg(F.min(F.struct("k1", "k2")).alias("row"), *[F.first(c).alias(c) for c in carried_on]).select("node", "row.*", *carried_on))

        def possible(pairs: DataFrame) -> DataFrame:
            """Those of the pairs (x, y) whose parities, the short form first, allow the similarity, and
            the share of bits in which they differ."""
            for sketch in ("brief", "parity"):
                side = lambda c, k=sketch: nodes.select(F.col("node").alias(c), F.col("n").alias(f"{c}n"), F.col(k).alias(f"{c}{k}"))
                pairs = pairs.select("x", "y").join(side("x"), "x").join(side("y"), "y").filter(_may_be_similar("x", "y", sketch, t))
            return pairs.select("x", "y", (_bits_apart(F.col("xparity"), F.col("yparity")) / (F.col("xn") + F.col("yn"))).alias("apart"))

        def verified(pairs: DataFrame) -> DataFrame:
            """The links among pairs (x, y)."""
            needed = pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct()
            needed = keep(nodes.select("node", "k1", "k2").join(needed, "node", "left_semi"))
            texts = docs.select("k1", "k2", "text").join(sent_if_few(needed), ["k1", "k2"])
            sets = keep(texts.select("node", "text").mapInArrow(lambda b: _set_batches(b, shingle_words), "node long, shingles array<long>").dropDuplicates(["node"]))
            left, right = sets.withColumnsRenamed({"node": "x", "shingles": "s"}), sets.withColumnsRenamed({"node": "y", "shingles": "t"})
            shared = F.size(F.array_intersect("s", "t"))
            return keep(pairs.join(left, "x").join(right, "y").filter(shared >= t * (F.size("s") + F.size("t") - shared) - 1e-9).select(F.col("x").alias("a"), F.col("y").alias("b")))

        # One node stands for each fingerprint; nodes that share one are candidates with it.
        tops = keep(nodes.groupBy("fp").agg(F.min("node").alias("top")))
        a, b = tops.withColumnsRenamed({"fp": "a", "top": "x"}), tops.withColumnsRenamed({"fp": "b", "top": "y"})
        pairs = links(tops.select("fp"), radius, keep).join(a, "a").join(b, "b").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        pairs = pairs.unionByName(nodes.join(tops, "fp").filter("node <> top").select(F.col("top").alias("x"), F.col("node").alias("y")))
        # Shingles that only one text has among its rarest make no pair.
        entries = nodes.select("node", "n", F.posexplode("rare").alias("at", "shingle"))
        shared = keep(entries.join(entries.groupBy("shingle").count().filter("count > 1"), "shingle"))
        pairs = pairs.unionByName(_neighbours(shared)).distinct()
        close = keep(possible(pairs))
        nearest = keep(_nearest(close))
        found = verified(nearest)
        roots = keep(components(found, keep))
        of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}root"))
        other = close.select("x", "y").join(nearest, ["x", "y"], "left_anti").join(of("x"), "x", "left").join(of("y"), "y", "left")
        other = other.filter(F.coalesce("xroot", "x") != F.coalesce("yroot", "y")).select("x", "y")
        rest = possible(_unresolved(shared, roots, nodes, t, keep).distinct()).select("x", "y")
        more = verified(keep(other.unionByName(rest).distinct()))
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), keep)
        named = nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        return stash(profile.select("doc_id", "k1", "k2", "node").join(named, "node"))


def keep_one(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of ``similar_groups`` (the least doc_id, then the least hash of the
    row), all columns as they are.  Rows of one doc_id and text are copies like any other; texts
    without words are one group; a null doc_id comes after all others."""
    rows = carried(docs)
    groups = similar_groups(rows, shingle_words, similarity)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k1", "k2")
    kept = groups.groupBy("root").agg(F.min(order).alias("m")).select("m.k1", "m.k2", F.lit(True).alias("kept"))
    by = groups.groupBy("k1", "k2").agg(F.count("*").alias("n")).join(kept, ["k1", "k2"], "left")
    by = stash(by.select("k1", "k2", "n", F.coalesce("kept", F.lit(False)).alias("kept")).filter("n > 1 or not kept"))
    # Most rows stay: only those that go, and those that are repeated, are looked up.
    one = rows.join(sent_if_few(by.select("k1", "k2")), ["k1", "k2"], "left_anti").select("row.*")
    again = rows.join(sent_if_few(by.filter("kept").select("k1", "k2")), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select("row.*")
    return one.unionByName(again)
