"""Exact removal of repeated passages by difference-cover anchors.

A window is ``WINDOW`` consecutive words.  Hashing every window of a corpus is wasteful; instead
shorter anchors of ``WINDOW - PERIOD + 1`` words are hashed only where the word position modulo
``PERIOD`` lies in a difference cover.  For any two positions i and j some shift below the period
puts both i+shift and j+shift on the cover, so two equal windows always share an aligned anchor.
Anchors that occur once are discarded; around the others the windows that contain them are hashed
with 95 bits and counted, which extends the anchor to whole windows exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linetrace.llm.common import IS_SPACE, slices, stash, utf8

#: Every difference modulo 21 occurs once between members of this set (a perfect difference set).
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
WINDOW = 35
#: Of texts that are equal as a whole, the one that stands for all, and the others.
FIRST, COPY = 1, 2

# Two independent odd multipliers for polynomial hashes modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**k and base**-k modulo 2**64 for k below n at least."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = 1 << max(16, int(n).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            row = np.full(size, b, dtype=np.uint64)
            row[0] = 1
            out.append(np.cumprod(row, dtype=np.uint64))
        _POWERS[base] = (out[0], out[1])
    return _POWERS[base]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def _ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[s:e] for each pair of starts and ends."""
    power, inverse = _powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * power[: len(values)], out=total[1:])
    return _mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


class Words:
    """Word boundaries of a run of texts and hashes over them."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        """data: the bytes of the run; at: where each text starts and the last one ends."""
        self.data = data
        space = IS_SPACE[data]
        first = np.ones(len(data) + 1, dtype=bool)
        first[1:-1] = space[:-1]
        first[at] = True
        self.starts = np.flatnonzero(~space & first[:-1])
        last = np.ones(len(data) + 1, dtype=bool)
        last[1:-1] = space[1:]
        last[at] = True
        self.ends = np.flatnonzero(~space & last[1:]) + 1
        self.of = np.searchsorted(self.starts, at)  # first word of each text
        self._hashes: dict[int, np.ndarray] = {}

    def hashes(self, base: int) -> np.ndarray:
        if base not in self._hashes:
            self._hashes[base] = _ranges(self.data.astype(np.uint64) + np.uint64(1), self.starts, self.ends, base)
        return self._hashes[base]

    def windows(self, at: np.ndarray, length: int, base: int) -> np.ndarray:
        return _ranges(self.hashes(base), at, at + length, base)


def _anchor_batches(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    length = window - PERIOD + 1
    on = np.zeros(PERIOD, dtype=bool)
    on[list(COVER)] = True
    for batch in batches:
        data, at, _ = utf8(batch.column("text"))
        for i, j in slices(at):
            w = Words(data[at[i] : at[j]], at[i : j + 1] - at[i])
            n = np.diff(w.of)
            own = np.repeat(np.arange(j - i), n)
            rank = np.arange(len(w.starts)) - w.of[:-1][own]
            pick = np.flatnonzero(on[rank % PERIOD] & (rank + length <= n[own]) & (n[own] >= window))
            h = w.windows(pick, length, BASES[0]).view(np.int64)
            offsets = np.concatenate(([0], np.cumsum(np.bincount(own[pick], minlength=j - i)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("rk")[i:j], pa.ListArray.from_arrays(pa.array(offsets), pa.array(h))], ["rk", "anchors"]
            )


def _positions(n: int, length: int) -> np.ndarray:
    """Word position of the k-th anchor of a text of n words."""
    rank = np.arange(max(0, n - length + 1))
    return rank[np.isin(rank % PERIOD, COVER)]


def _digest(parts: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(parts)).hexdigest()


def _base_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word count and digest of every text; the text itself only where its windows must be hashed."""
    for batch in batches:
        n, sha = [], []
        hit = [r != COPY and h.is_valid for r, h in zip(batch.column("role").to_pylist(), batch.column("hits"), strict=True)]
        for text in batch.column("text"):
            parts = (text.as_py() or "").encode().split()
            n.append(len(parts))
            sha.append(_digest(parts))
        text = pa.array([t.as_py() if h else None for t, h in zip(batch.column("text"), hit, strict=True)], pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("rk"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), text, batch.column("hits"), batch.column("role")],
            ["doc_id", "rk", "n_words", "full_sha256", "text", "hits", "role"],
        )


def _window_batches(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """95-bit hashes of the windows that hold a repeated anchor."""
    length = window - PERIOD + 1
    for batch in batches:
        data, at, _ = utf8(batch.column("text"))
        for i in range(len(at) - 1):
            w = Words(data[at[i] : at[i + 1]], np.array([0, at[i + 1] - at[i]]))
            n = len(w.starts)
            places = _positions(n, length)
            hits = np.asarray(batch.column("hits")[i].values)
            mark = np.zeros(n + 2, dtype=np.int64)
            p = places[hits[hits < len(places)]]
            np.add.at(mark, np.maximum(0, p - PERIOD + 1), 1)
            np.add.at(mark, np.minimum(p, n - window) + 1, -1)
            starts = np.flatnonzero(np.cumsum(mark)[: max(0, n - window + 1)] > 0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(starts), batch.column("rk")[i].as_py()), pa.int64()),
                    pa.array(starts.astype(np.int32)),
                    pa.array(w.windows(starts, window, BASES[0]).view(np.int64)),
                    pa.array((w.windows(starts, window, BASES[1]) >> np.uint64(33)).astype(np.int32)),
                ],
                ["rk", "start", "h1", "h2"],
            )


def _cut_batches(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, removed, sha, kept, spans = [], [], [], [], []
        for text, starts in zip(batch.column("text"), batch.column("starts"), strict=True):
            source = text.as_py()
            data = source.encode()
            parts = data.split()
            mark = np.zeros(len(parts) + 1, dtype=np.int64)
            s = np.asarray(starts.values)
            np.add.at(mark, s, 1)
            np.add.at(mark, s + window, -1)
            gone = np.cumsum(mark)[:-1] > 0
            left = [p for p, g in zip(parts, gone.tolist(), strict=True) if not g]
            removed.append(int(gone.sum()))
            sha.append(_digest(left))
            kept.append(b" ".join(left).decode())
            edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
            spans.append([{"first": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
        kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("rk"), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string()), pa.array(spans, kind)],
            ["doc_id", "rk", "n_removed", "kept_sha256", "kept_text", "spans"],
        )


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256,
    kept_text and spans.  Every word inside a window of ``window`` words that also starts anywhere
    else, in this text or another, is removed; ``spans`` are the removed word ranges.  kept_text and
    spans are null where nothing is removed.

    Nulls: a null text has no words; a null doc_id is kept as such.  Blank texts have no words and
    the digest of the empty string.  Texts shorter than the window lose nothing.  A row that occurs
    twice repeats itself, so both copies lose their windows.  Other columns are ignored; an empty
    table gives an empty result.  ``window`` must exceed the period of 21.
    """
    if window <= PERIOD:
        raise ValueError(f"the window must be longer than {PERIOD} words")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("rk", F.xxhash64("doc_id", "text"))
    anchors = rows.select("rk", "text").mapInArrow(lambda b: _anchor_batches(b, window), "rk long, anchors array<long>")
    # An anchor that occurs once matters no more.  Counting combines on the map side, so a passage
    # that a third of the corpus holds costs one row a task.
    repeated = stash(anchors.select(F.explode("anchors").alias("h")).groupBy("h").count().filter("count > 1").select("h"))
    hits = anchors.select("rk", F.posexplode("anchors").alias("k", "h")).join(repeated, "h").select("rk", "k", F.lit(None).cast("int").alias("role"))
    # All windows of a text that occurs twice repeat; one copy is hashed for all, and counts twice.
    whole = rows.select("rk", F.xxhash64("text").alias("t1"), F.hash("text").alias("t2"))
    copied = stash(whole.groupBy("t1", "t2").agg(F.count("*").alias("n"), F.min("rk").alias("first")).filter("n > 1").select("t1", "t2", "first"))
    role = F.when(F.col("rk") == F.col("first"), FIRST).otherwise(COPY)
    roles = whole.join(copied, ["t1", "t2"]).select("rk", F.lit(None).cast("int").alias("k"), role.alias("role"))
    marks = hits.unionByName(roles).groupBy("rk").agg(F.collect_set("k").alias("hits"), F.max("role").alias("role"))
    marks = marks.withColumn("hits", F.when(F.size("hits") > 0, F.col("hits")))
    schema = "doc_id long, rk long, n_words long, full_sha256 string, text string, hits array<int>, role int"
    base = stash(rows.join(marks, "rk", "left").select("doc_id", "rk", "text", "hits", "role").mapInArrow(_base_batches, schema))
    suspects = base.filter("text is not null and role is null")

    def hashed(frame: DataFrame) -> DataFrame:
        return frame.select("rk", "text", "hits").mapInArrow(lambda b: _window_batches(b, window), "rk long, start int, h1 long, h2 int")

    weighed = hashed(suspects).withColumn("w", F.lit(1)).unionByName(hashed(base.filter(F.col("role") == FIRST).filter("text is not null")).withColumn("w", F.lit(2)))
    twice = stash(weighed.groupBy("h1", "h2").agg(F.sum("w").alias("w")).filter("w > 1").select("h1", "h2"))
    starts = hashed(suspects).join(twice, ["h1", "h2"]).groupBy("rk").agg(F.collect_set("start").alias("starts"))
    cut = suspects.select("doc_id", "rk", "text").join(starts, "rk").select("doc_id", "rk", "text", "starts")
    cut = cut.mapInArrow(
        lambda b: _cut_batches(b, window),
        "doc_id long, rk long, n_removed long, kept_sha256 string, kept_text string, spans array<struct<first: long, end: long>>",
    )
    found = suspects.select("doc_id", "rk", "n_words", "full_sha256").join(cut.drop("doc_id").dropDuplicates(["rk"]), "rk", "left")
    found = found.select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "full_sha256").alias("kept_sha256"), "kept_text", "spans"
    )
    gone = F.col("role").isNotNull() & (F.col("n_words") >= window)
    rest = base.filter("text is null or role is not null").select(
        "doc_id", "n_words", F.when(gone, F.col("n_words")).otherwise(0).cast("long").alias("n_removed"), F.when(gone, F.lit(_digest([]))).otherwise(F.col("full_sha256")).alias("kept_sha256"),
        F.when(gone, F.lit("")).alias("kept_text"), F.when(gone, F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n_words").alias("end")))).alias("spans"),
    )
    return found.unionByName(rest)
