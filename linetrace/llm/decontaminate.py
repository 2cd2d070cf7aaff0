"""Benchmark items hidden in texts, found through the pigeonhole principle on edits.

An item with an error budget of k edits is cut into k + 1 pieces; whatever contains the item within
k edits contains one piece unchanged.  All pieces are searched at once, and each hit is verified by
Myers' bit-parallel edit distance over the part of the text where the item would lie.  Short items
have no budget: they are one piece, and found where they stand as whole words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linetrace.llm.common import carried, scratch, stash

#: Edits allowed, as a share of the item's characters, and characters below which there are none.
ERRORS, SHORT = 0.06, 24
#: Bytes of benchmark text in one block, whose automaton takes some 50 bytes for each; each block is
#: one pass over the corpus.
BLOCK_BYTES = 2 << 20
_GAPS = re.compile(r"[\W_]+")


def normal(text: str) -> str:
    """Lower case; whatever is neither letter nor digit is one space."""
    return _GAPS.sub(" ", text.lower()).strip()


def budget(item: str, errors: float) -> int:
    return int(len(item) * errors) if len(item) >= SHORT else 0


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece): k + 1 pieces of about equal length that make up the item."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def letter_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def best_within(masks: dict[str, int], size: int, text: str) -> tuple[int, int]:
    """Least edit distance of the item to any part of ``text``, and where that part ends."""
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score, best, end = full, 0, size, size, 0
    for at, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        diag = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        up, down = (minus | ~(diag | plus)) & full, plus & diag
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = (down | ~(diag | up)) & full, up & diag
        if score < best:
            best, end = score, at
    return best, end


class Index:
    """All pieces of a block of items in one automaton."""

    def __init__(self, items: tuple[tuple[int, str], ...], errors: float):
        self.items = []
        self.automaton = ahocorasick.Automaton()
        at: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            if not text:
                continue
            k = budget(text, errors)
            text = text if len(text) >= SHORT else f" {text} "
            self.items.append((item_id, text, k, letter_masks(text)))
            for offset, piece in pieces(text, k):
                at.setdefault(piece, []).append((len(self.items) - 1, offset))
        for piece, places in at.items():
            self.automaton.add_word(piece, (len(piece), places))
        if at:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[dict]:
        """The items in a normalised text, each with its least distance."""
        if not self.items:
            return []
        text = f" {text} "
        best: dict[int, tuple[int, int]] = {}
        done: dict[int, int] = {}
        for last, (size, places) in self.automaton.iter(text):
            for i, offset in places:
                _, item, k, masks = self.items[i]
                start = max(0, last + 1 - size - offset - k)
                # The pieces of one occurrence would verify nearly the same part again and again.
                if start <= done.get(i, -1):
                    continue
                stop = last + 1 - size - offset + len(item) + 2 * k
                distance, end = best_within(masks, len(item), text[start:stop])
                if distance <= k:
                    done[i] = last + 1 - size - offset + k
                    if distance < best.get(i, (k + 1, 0))[0]:
                        best[i] = (distance, start + end)
        return [{"item_id": self.items[i][0], "distance": d, "end": e - 1} for i, (d, e) in sorted(best.items())]


@lru_cache(maxsize=4)
def _index(items: tuple[tuple[int, str], ...], errors: float) -> Index:
    return Index(items, errors)


MATCH = "array<struct<item_id: long, distance: long, end: long>>"


def _match_batches(batches: Iterator[pa.RecordBatch], items, errors: float, hits_only: bool) -> Iterator[pa.RecordBatch]:
    index = _index(items.value, errors)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        found = [index.find(normal(t.as_py() or "")) for t in batch.column("text")]
        if hits_only:
            batch = batch.select(["k1", "k2"]).filter(pa.array([bool(f) for f in found], pa.bool_()))
            found = [f for f in found if f]
        yield batch.append_column("matches", pa.array(found, kind))


def _searched(docs: DataFrame, block: DataFrame, errors: float, hits_only: bool) -> DataFrame:
    items = tuple(sorted({(r.item_id if r.item_id is not None else -1, normal(r.text)) for r in block.toLocalIterator()}))
    shared = docs.sparkSession.sparkContext.broadcast(items)
    fields = [f for f in docs.schema if not hits_only or f.name in ("k1", "k2")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", matches {MATCH}"
    return docs.mapInArrow(lambda x: _match_batches(x, shared, errors, hits_only), schema)


def with_matches(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` (k1, k2, text and more) and ``matches``: the benchmark items (item_id, text) that each
    text contains within their error budgets, with distance and end in the normalised text.

    The benchmark is read in blocks of at most ``block_bytes``, decided by the hash of the item; only
    a block is ever on the driver or in a task.  Several blocks are searched one after the other, and
    what each finds is written and joined to the documents."""
    items = benchmark.filter("text is not null").select("item_id", "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + int(size * 1.25) // block_bytes
    if blocks == 1:
        return _searched(docs, items, errors, False)
    with scratch(docs.sparkSession) as keep:
        found = None
        for b in range(blocks):
            block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
            part = keep(_searched(docs.select("k1", "k2", "text"), block, errors, True))
            found = part if found is None else found.unionByName(part)
        # Rows of one doc_id and text have found the same.
        hits = stash(found.groupBy("k1", "k2").agg(F.array_distinct(F.flatten(F.collect_list("matches"))).alias("matches")))
    none = F.array().cast(MATCH)
    return docs.join(hits, ["k1", "k2"], "left").withColumn("matches", F.coalesce("matches", none))


def contamination(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, contaminated, n_items and item_ids for each row of ``docs``.

    Null and blank texts contain nothing; null items and items without letters and digits are not
    searched; items of under 24 normalised characters are found as whole words without edits; a null
    item_id counts as -1; repeated items count once, repeated rows of docs give repeated results; of
    several places of an item the first of the least distance counts; long texts are searched whole;
    other columns are ignored; empty tables give empty or clean results."""
    found = with_matches(carried(docs).select("doc_id", "text", "k1", "k2"), benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"), errors, block_bytes)
    ids = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    return found.select("doc_id", (F.size("matches") > 0).alias("contaminated"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item, all columns as they are; with the same
    handling of nulls, blanks, repeated rows, long texts and empty tables as ``contamination``."""
    rows = carried(docs).select("text", "k1", "k2", "row")
    found = with_matches(rows, benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"), errors, block_bytes)
    return found.filter(F.size("matches") == 0).select("row.*")
