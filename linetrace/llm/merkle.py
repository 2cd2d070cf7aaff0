"""A Merkle tree over the rows of a dataset, with nodes labelled by the leaf ranks they cover.

A node of level k covers an interval [lo, hi) of leaf ranks, where lo is a multiple of 2**k.  The
ancestors of a row are the nodes whose intervals contain its rank, and the siblings of a node are its
parent's interval less its own.  Containment is an equality of buckets: the nodes of ``BAND`` levels
that lie under one node are a bucket, named by the first rank they cover, shifted.  So rows of one
bucket meet its nodes by a join on the bucket, and what is proved above a bucket is worked out once
for all of it.  Each band has 2**BAND times fewer rows than the one below.

H is the SHA-256 of its inputs joined, digests as lowercase hex text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linetrace.llm.common import Stash, scratch, sent_if_few, stash

BAND = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = pa.struct([("left", pa.bool_()), ("digest", pa.string())])
PATH = "array<struct<left: boolean, digest: string>>"


def h(*inputs: str) -> str:
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def leaf_digest(fields: Sequence[Column]) -> Column:
    """H of a row: each field as ``-`` if null, else its number of UTF-8 bytes, a colon and itself."""
    told = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in told]), 256)


def ranked(rows: DataFrame, keep: Stash) -> DataFrame:
    """``rows`` (tree, and the columns that order it, ``by``) with ``rank`` from 0 within the tree and the
    tree's ``size``, null trees and ``by`` first.

    Rows are dealt to tasks by ranges and written with their places; a rank is the place in its task
    plus the rows of the tree in the tasks before, so no tree is ever in one task.  What is summed up
    has one row for each task and tree that meet."""
    placed = keep(rows.repartitionByRange("tree", "by").sortWithinPartitions("tree", "by").withColumn("place", F.monotonically_increasing_id()))
    placed = placed.withColumn("task", F.shiftright("place", 33))
    sums = placed.groupBy("tree", "task").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = W.partitionBy("tree").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("size", F.sum("n").over(W.partitionBy("tree")))
    sums = sums.select(F.col("tree").alias("t"), F.col("task").alias("k"), "first", "before", "size")
    out = placed.join(sums, F.col("tree").eqNullSafe(F.col("t")) & (F.col("task") == F.col("k")))
    return out.withColumn("rank", F.col("place") - F.col("first") + F.col("before")).drop("t", "k", "task", "place", "first", "before", "by")


def height(size: int) -> int:
    """Levels above the leaves of a tree."""
    return (size - 1).bit_length()


def bucket_nodes(digests: Sequence[str], lo: int, width: int, size: int, levels: int) -> list[dict[tuple[int, int], str]]:
    """Nodes of each level of a bucket by their intervals: ``digests`` cover ``width`` ranks each from
    rank ``lo`` on, the tree has ``size`` leaves."""
    level = {(lo + i * width, min(lo + (i + 1) * width, size)): d for i, d in enumerate(digests)}
    out = [level]
    for _ in range(levels):
        width *= 2
        joined: dict[tuple[int, int], str] = {}
        for (a, _), d in level.items():
            parent = a // width * width
            joined[parent, min(parent + width, size)] = joined.get((parent, min(parent + width, size)), "") + d
        level = {cover: h(d) for cover, d in joined.items()}
        out.append(level)
    return out


def siblings(nodes: list[dict[tuple[int, int], str]], rank: int, width: int, size: int) -> list[tuple[bool, str] | None]:
    """Of the nodes that contain ``rank``, level by level, what their parent covers besides: whether it
    stands to the left, and its digest; None where the parent covers no more."""
    out = []
    for level in nodes[:-1]:
        lo = rank // width * width
        hi = min(lo + width, size)
        width *= 2
        above = rank // width * width, min(rank // width * width + width, size)
        rest = (above[0], lo) if above[0] < lo else (hi, above[1])
        out.append((rest[0] < lo, level[rest]) if rest[0] < rest[1] else None)
    return out


def fold(digest: str, path: Sequence[tuple[bool, str] | None]) -> str:
    """The root that a leaf's digest and its siblings give."""
    for step in path:
        digest = h(digest) if step is None else h(step[1], digest) if step[0] else h(digest, step[1])
    return digest


def _levels(size: int, band: int) -> int:
    return max(0, min(BAND, height(size) - band * BAND))


def _rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Rows of the columns, a few buckets at a time as Python values."""
    for batch in batches:
        for at in range(0, batch.num_rows, 16):
            yield from zip(*(batch.column(c).slice(at, 16).to_pylist() for c in columns), strict=True)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 1 << 13) -> Iterator[pa.RecordBatch]:
    out = []
    for row in rows:
        out.append(row)
        if len(out) >= most:
            yield _batch(out, schema)
            out = []
    yield _batch(out, schema)


def _nodes_of(bucket: int, members: list[dict], size: int, band: int) -> list[dict[tuple[int, int], str]]:
    return bucket_nodes([m["digest"] for m in members], bucket << BAND * (band + 1), 1 << BAND * band, size, _levels(size, band))


_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "bigint": pa.int64()}


def _top_batches(batches: Iterator[pa.RecordBatch], band: int, kind: str) -> Iterator[pa.RecordBatch]:
    """The uppermost node of each bucket, as a leaf of the next band."""

    def tops() -> Iterator[tuple]:
        for tree, size, bucket, members in _rows(batches, "tree", "size", "bucket", "members"):
            (top,) = _nodes_of(bucket, members, size, band)[-1].values()
            yield tree, size, bucket, top

    return _in_batches(tops(), pa.schema([("tree", _KINDS[kind]), ("size", pa.int64()), ("rank", pa.int64()), ("digest", pa.string())]))


def _path_batches(batches: Iterator[pa.RecordBatch], band: int, kind: str) -> Iterator[pa.RecordBatch]:
    """The path to the root of every member of a bucket: its siblings in the bucket, then the bucket's."""

    def paths() -> Iterator[tuple]:
        width = 1 << BAND * band
        for tree, size, bucket, members, root, above in _rows(batches, "tree", "size", "bucket", "members", "root", "path"):
            nodes = _nodes_of(bucket, members, size, band)
            for m in members:
                own = [{"left": s and s[0], "digest": s and s[1]} for s in siblings(nodes, m["rank"] * width, width, size)]
                yield tree, m["rank"], root, own + above

    return _in_batches(paths(), pa.schema([("tree", _KINDS[kind]), ("rank", pa.int64()), ("root", pa.string()), ("path", pa.list_(STEP))]))


def proved(leaves: DataFrame, keep: Stash) -> tuple[DataFrame, DataFrame]:
    """Of ``leaves`` (tree, size, rank, digest, and more columns): the roots of the trees (tree, digest),
    and the leaves in buckets (tree, size, bucket, members) with the ``root`` and the ``path`` above each.

    Up the tree a bucket of a band becomes one leaf of the next; down again, the path of a bucket's
    top is joined to the bucket and goes on to its members."""
    kind = leaves.schema["tree"].dataType.simpleString()
    largest = height(leaves.agg(F.max("size")).first()[0] or 1)
    rows, floors = leaves, []
    for band in range(max(1, -(-largest // BAND))):
        more = [c for c in rows.columns if c not in ("tree", "size", "rank")]
        by = rows.groupBy("tree", "size", F.shiftright("rank", BAND).alias("bucket"))
        floors.append(keep(by.agg(F.sort_array(F.collect_list(F.struct("rank", *more))).alias("members"))))
        schema = f"tree {kind}, size long, rank long, digest string"
        rows = keep(floors[-1].mapInArrow(lambda b, k=band: _top_batches(b, k, kind), schema))
    up = rows.select("tree", "rank", F.col("digest").alias("root"), F.array().cast(PATH).alias("path"))
    for band in reversed(range(len(floors))):
        up = up.select(F.col("tree").alias("t"), F.col("rank").alias("r"), "root", "path")
        met = floors[band].join(up, F.col("tree").eqNullSafe(F.col("t")) & (F.col("bucket") == F.col("r"))).drop("t", "r")
        if band:
            up = keep(met.mapInArrow(lambda b, k=band: _path_batches(b, k, kind), f"tree {kind}, rank long, root string, path {PATH}"))
    return rows.select("tree", "digest"), met


MANIFEST = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
_MANIFEST = pa.schema([(c.split()[0], {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[c.split()[1]]) for c in MANIFEST.split(", ")])


def _proof_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the manifest of each bucket's leaves."""

    def proofs() -> Iterator[tuple]:
        for size, bucket, members, subroot, path, root, top_path in _rows(batches, "size", "bucket", "members", "root", "path", "top", "top_path"):
            above = [None if s["digest"] is None else (s["left"], s["digest"]) for s in (*path, *top_path)]
            nodes = _nodes_of(bucket, members, size, 0)
            for m in members:
                way = siblings(nodes, m["rank"], 1, size) + above
                folded = fold(m["seen"] or m["digest"], way)
                yield m["doc_id"], m["digest"], subroot, root, h(*[s[1] for s in way if s]), folded, folded == root

    return _in_batches(proofs(), _MANIFEST)


def manifest(docs: DataFrame, seen: Mapping[str, Column] | None = None) -> DataFrame:
    """For each row of ``docs`` (doc_id, source, lang, n_chars, text): its leaf, the root of its lang's
    tree (subroot) and of the dataset, the digest of its proof, the root that follows from the row as
    it is found now, and whether that is the root.

    ``seen`` has what is found now in place of some of the five fields; without it nothing has changed.
    Within a lang leaves ascend by doc_id (null first, rows of one doc_id by their digests); a null lang
    is a tree of its own and comes first.  Texts are hashed whole, whatever their length; null and
    empty fields differ; repeated rows are leaves of their own; an empty table gives an empty manifest;
    other columns are ignored."""
    as_is = {f: docs[f] for f in FIELDS}
    leaf, now = leaf_digest(list(as_is.values())), leaf_digest(list((as_is | dict(seen or {})).values()))
    rows = docs.select(docs["lang"].cast("string").alias("tree"), docs["doc_id"].cast("long").alias("doc_id"), leaf.alias("digest"), now.alias("seen"))
    with scratch(docs.sparkSession) as keep:
        rows = keep(rows.withColumn("seen", F.when(F.col("seen") != F.col("digest"), F.col("seen"))))
        subroots, buckets = proved(ranked(rows.withColumn("by", F.struct("doc_id", "digest")), keep), keep)
        ordered = ranked(subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("lang"), F.col("tree").alias("by"), "digest"), keep)
        _, whole = proved(ordered, keep)
        tops = keep(whole.mapInArrow(lambda b: _path_batches(b, 0, "int"), f"tree int, rank long, root string, path {PATH}"))
        tops = keep(ordered.select("rank", "lang").join(tops, "rank").select("lang", F.col("root").alias("top"), F.col("path").alias("top_path")))
        met = buckets.join(sent_if_few(tops), F.col("tree").eqNullSafe(F.col("lang")))
        return stash(met.mapInArrow(_proof_batches, MANIFEST))
