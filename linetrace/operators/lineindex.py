"""Canonical lines in sorted blocks, looked up by intervals of order_id from inside a task."""

from __future__ import annotations

import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linetrace.functions.text import first_letters, phonetic_key, tokens

#: Lines of a block, which is a file, and of a group of rows, which is what a look-up reads.
BLOCK, GROUP = 1 << 14, 128
#: Blocks (open files) and groups that a worker keeps.
KEPT, KEPT_GROUPS = 64, 256
#: First letters that so many lines at most can share few enough of to be sent to all tasks.
SHORT, FEW = 3, 1 << 17

#: Scores of lines against a query, 0 to 100.
Scorer = Callable[[str, Sequence[str]], np.ndarray]


@lru_cache(maxsize=1 << 15)
def _words(text: str) -> frozenset[str]:
    """Distinct words; a line meets many utterances, one after the other."""
    return frozenset(text.split(" ")) - {""}


class _Texts(list):
    """Texts of a group.  The places of each word and the distinct words of each text are found once, for a
    group that has met so many queries that it pays."""

    #: Texts met one by one before that, for each text of the group.
    PAYS, met = 4, 0

    @cached_property
    def places(self) -> dict[str, np.ndarray]:
        found: dict[str, list[int]] = {}
        for k, text in enumerate(self):
            for word in set(text.split(" ")):
                found.setdefault(word, []).append(k)
        found.pop("", None)
        return {word: np.array(at, dtype=np.intp) for word, at in found.items()}

    @cached_property
    def sizes(self) -> np.ndarray:
        return np.array([len(set(text.split(" ")) - {""}) for text in self], dtype=np.int64)

    def scores(self, words: frozenset[str], a: int, b: int) -> np.ndarray:
        """``overlap_scores`` of the texts from ``a`` to before ``b``."""
        self.met += b - a
        if self.met < self.PAYS * len(self):
            return _scores(words, self[a:b])
        places = [at for word in words if (at := self.places.get(word)) is not None]
        if not places:
            return np.zeros(b - a)
        met = np.bincount(np.concatenate(places), minlength=len(self))[a:b]
        return 200.0 * met / (len(words) + self.sizes[a:b])


class Lines(Sequence):
    """Texts of lines that lie in groups, as (texts of the group, first place, place after the last)."""

    def __init__(self, parts: list[tuple[_Texts, int, int]]):
        self.parts = parts

    def __len__(self) -> int:
        return sum(b - a for _, a, b in self.parts)

    def __iter__(self) -> Iterator[str]:
        return chain.from_iterable(texts[a:b] for texts, a, b in self.parts)

    def __getitem__(self, k):
        return list(self)[k]


def _scores(words: frozenset[str], lines: Sequence[str]) -> np.ndarray:
    both = [(len(words & other), len(words) + len(other)) for other in map(_words, lines)]
    return np.array([200.0 * met / n if n else 0.0 for met, n in both], dtype=np.float64)


def overlap_scores(query: str, lines: Sequence[str]) -> np.ndarray:
    """Twice the shared distinct words by the distinct words of both."""
    own = _words(query)
    if not isinstance(lines, Lines):
        return _scores(own, lines)
    found = [texts.scores(own, a, b) for texts, a, b in lines.parts]
    return found[0] if len(found) == 1 else np.concatenate(found) if found else np.zeros(0)


def ranked_scores(query: str, lines: Sequence[str]) -> np.ndarray:
    """The score of the ranked searches: partial ratio, softened by the lengths, times word coverage."""
    from linetrace.functions.scoring import partial_ratios
    from linetrace.operators.match import coverage

    if not lines or not query:
        return np.zeros(len(lines))
    sizes = np.array([max(1, len(x)) for x in lines])
    soft = np.sqrt(np.minimum(sizes, len(query)) / np.maximum(sizes, len(query)))
    return partial_ratios(query, list(lines)) * soft * np.array([coverage(query, x) for x in lines])


@lru_cache(maxsize=KEPT)
def _block(name: str) -> tuple[pa.RecordBatchFileReader, list[int], list[int]]:
    """A block, opened, with the first and the last order_id of each of its groups."""
    store, path = fs.FileSystem.from_uri(name)
    file = pa.ipc.open_file(store.open_input_file(path))
    firsts, lasts = (np.frombuffer(file.schema.metadata[k], dtype="<i8").tolist() for k in (b"firsts", b"lasts"))
    return file, firsts, lasts


@lru_cache(maxsize=KEPT_GROUPS)
def _group(name: str, k: int) -> tuple[np.ndarray, np.ndarray, _Texts]:
    batch = _block(name)[0].get_batch(k)
    return batch["order_id"].to_numpy(), batch["passage_id"].to_numpy(), _Texts(batch["norm"].to_pylist())


class LineIndex:
    """The first and last order_id and the file of each block; what a task looks up it reads from the
    shared folder, a few groups of rows at a time, so no line is sent to where it is not asked for, and
    what is read grows with the look-ups alone, however many tasks there are."""

    def __init__(self, blocks: list[tuple[int, int, str]]):
        self.blocks = sorted(blocks)
        self.lasts = [b[1] for b in self.blocks]

    def between(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """order_id, passage_id and text of the lines from ``lo`` to ``hi``, both included."""
        orders, passages, parts = [], [], []
        for k in range(bisect_left(self.lasts, lo), len(self.blocks)):
            if self.blocks[k][0] > hi:
                break
            name = self.blocks[k][2]
            _, firsts, lasts = _block(name)
            for g in range(bisect_left(lasts, lo), bisect_right(firsts, hi)):
                order, passage, norm = _group(name, g)
                a, b = order.searchsorted(lo), order.searchsorted(hi, side="right")
                orders.append(order[a:b])
                passages.append(passage[a:b])
                parts.append((norm, a, b))
        if len(orders) == 1:
            return orders[0], passages[0], Lines(parts)
        if not orders:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), Lines([])
        return np.concatenate(orders), np.concatenate(passages), Lines(parts)


def _written(rows: pa.Table, path: str) -> tuple[int, int, str]:
    """Writes a block, whose footer says where its groups lie and, as a few numbers, what each begins and
    ends with: one that is opened for a single look-up costs little.  A task that runs again writes new
    files, and only those it names are read."""
    name = f"{path}/{uuid.uuid4().hex}.arrow"
    orders = rows["order_id"].to_numpy().astype("<i8")
    firsts, lasts = orders[::GROUP], orders[np.minimum(np.arange(GROUP, len(orders) + GROUP, GROUP), len(orders)) - 1]
    schema = rows.schema.with_metadata({"firsts": firsts.tobytes(), "lasts": lasts.tobytes()})
    store, at = fs.FileSystem.from_uri(path)
    store.create_dir(at, recursive=True)
    with store.open_output_stream(f"{at}/{name.rsplit('/', 1)[-1]}") as out, pa.ipc.new_file(out, schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as file:
        file.write_table(rows.replace_schema_metadata(schema.metadata).combine_chunks(), max_chunksize=GROUP)
    return int(orders[0]), int(orders[-1]), name


def index_lines(lines: DataFrame, path: str) -> LineIndex:
    """Writes ``lines`` (order_id, passage_id, norm) to ``path`` in blocks sorted by order_id, cut into
    groups of ``GROUP`` rows.  What comes back holds one row for each ``BLOCK`` lines."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, made = [], 0, []
        for batch in batches:
            held.append(batch)
            n += len(batch)
            while n >= BLOCK:
                rows = pa.Table.from_batches(held)
                made.append(_written(rows[:BLOCK], path))
                held, n = rows[BLOCK:].to_batches(), n - BLOCK
        if n:
            made.append(_written(pa.Table.from_batches(held), path))
        columns = [pa.array([m[k] for m in made], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, ["lo", "hi", "file"])

    rows = lines.select("order_id", "passage_id", "norm").repartitionByRange("order_id").sortWithinPartitions("order_id")
    return LineIndex([(r.lo, r.hi, r.file) for r in rows.mapInArrow(write, "lo long, hi long, file string").collect()])


def _letters(column: str) -> Column:
    return phonetic_key(first_letters(tokens(F.col(column))))


def first_hits(lines: DataFrame) -> DataFrame:
    """The first line of the whole corpus with given phonetic first letters (letters, hit_line,
    hit_passage, hit_text), and the interval of its passage (hit_lo, hit_hi)."""
    first = lines.groupBy(_letters("norm").alias("letters")).agg(F.min_by(F.struct("order_id", "passage_id", "norm"), "order_id").alias("hit"))
    spans = lines.groupBy("passage_id").agg(F.min("order_id").alias("hit_lo"), F.max("order_id").alias("hit_hi"))
    named = [F.col(f"hit.{a}").alias(b) for a, b in (("order_id", "hit_line"), ("passage_id", "hit_passage"), ("norm", "hit_text"))]
    hits = first.filter("letters <> ''").select("letters", *named)
    return hits.join(spans.withColumnRenamed("passage_id", "hit_passage"), "hit_passage")


def with_hit(utterances: DataFrame, hits: DataFrame) -> DataFrame:
    """``utterances`` (with text) and the hit of their letters, nulls where there is none.

    Many utterances share a few short letters: those meet their hits by a broadcast where these are few,
    so that no task gets all utterances of one key.  Such rows take part in the shuffle of the others
    under keys of their own, which have no hits."""
    short, long = hits.filter(F.length("letters") <= SHORT), hits.filter(F.length("letters") > SHORT)
    said = utterances.withColumn("letters", _letters("text"))
    if short.limit(FEW + 1).count() > FEW:
        return said.join(hits, "letters", "left").drop("letters")
    columns = ["hit_line", "hit_passage", "hit_text", "hit_lo", "hit_hi"]
    spread = F.concat(F.lit("\0"), F.xxhash64(*utterances.columns).cast("string"))
    said = said.withColumn("spread", F.when(F.length("letters") > SHORT, F.col("letters")).otherwise(spread))
    said = said.join(F.broadcast(short.select("letters", *[F.col(c).alias(f"s_{c}") for c in columns])), "letters", "left").drop("letters")
    said = said.join(long.withColumnRenamed("letters", "spread"), "spread", "left")
    return said.select(*utterances.columns, *[F.coalesce(c, f"s_{c}").alias(c) for c in columns])


def with_first_hit(utterances: DataFrame, lines: DataFrame) -> DataFrame:
    """``utterances`` (with text) and the first line of the whole corpus that has their phonetic first
    letters (hit_line, hit_passage, hit_text), with the interval of its passage (hit_lo, hit_hi); nulls
    where there is none.  An equality of keys, for batches and for streams against a fixed corpus."""
    return with_hit(utterances, first_hits(lines))
