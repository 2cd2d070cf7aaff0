"""Token ids as files of independent zstandard frames that end in a seek table.

A file is a row of data frames and two skippable frames, so any zstandard reader sees one stream of
little-endian ids.  All numbers are little-endian.

- A data frame holds ids of one document, ``FRAME_IDS`` at most, as numbers of 2 or 4 bytes, and
  zstandard's own checksum.  A document has one frame, a longer one several in a row.
- The index frame (magic 0x184D2A51) lists the documents: ``HEAD`` and, compressed, their doc_ids,
  presence of doc_ids, numbers of ids and numbers of frames.
- The seek table (magic 0x184D2A5E) is the published seekable format's: compressed size,
  decompressed size and the low 32 bits of the XXH64 of the content of each frame, then the number of
  frames, a descriptor byte (128: with checksums) and the magic 0x8F92EAB1.

A reader takes the last bytes of a file, then its index, then only the frames of the documents that
are asked for.  Files are listed by a table (``manifest``) in the order of their documents.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Collection, Iterator
from functools import lru_cache
from string import punctuation

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from linetrace.llm.token_counts import _byte_symbols, _Memo

# The fixed values of the formats.
INDEX_MAGIC, TABLE_MAGIC, SEEKABLE, CHECKSUMS = 0x184D2A51, 0x184D2A5E, 0x8F92EAB1, 128
HEAD = struct.Struct("<4sBBQ")  # "LTOK", version, bytes of an id, documents
FRAME, ENTRY, FOOT = struct.Struct("<II"), np.dtype([("packed", "<u4"), ("plain", "<u4"), ("check", "<u4")]), struct.Struct("<IBI")
GPT_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Marks that end most words; no letters, numbers or white space, and pieces of their own like all runs of punctuation.
MARKS = ",.;:!?"

FRAME_IDS, FILE_BYTES, FILE_DOCS = 1 << 22, 1 << 28, 1 << 22
#: Characters of a text that are cut into chunks at once, and bytes of ids in one batch read.
SLICE, BATCH = 1 << 20, 1 << 22
LEVEL = 1
#: Words that a task keeps in each half of its table, some 200 bytes each.
WORDS = 450_000
MANIFEST = "file string, part int, no int, first long, last long, has_null boolean, n_docs long, n_ids long"

class _Mixed(Exception):
    """A chunk with white space other than one space before all else: where to cut depends on what is beside it."""


#: Before one of these spaces every text can be cut: the space goes with what follows it.
_CUT = re.compile(r"(?<=[!-~¡-ɏ])(?= [!-~¡-ɏ])")
#: Only where a space stands amid white space, or ends it, may it belong to what precedes it.
_WIDE_SPACE = re.compile(r"\s \s|\s $")
_SPACE = re.compile(r"\s")


class Encoder:
    """Ids of texts by a byte-level BPE file of the tokenizers library.

    Texts are cut where the pre-tokenizer always cuts, and the ids of each chunk are kept, so a word
    meets the library once and not at each of its uses.  Files whose pre-tokenizer is another one, or
    that normalise, encode whole texts."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.model, self.symbols = self.library.model, "".join(_byte_symbols()[b] for b in range(256))
        last = max(self.library.get_vocab().values(), default=0)
        self.width = 2 if last < 1 << 16 else 4
        self.ids = [i.to_bytes(self.width, "little") for i in range(last + 1)]
        pre = spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True) and not spec.get("normalizer")
        added = [t["content"] for t in spec.get("added_tokens", ())]
        flags = any(t[k] for t in spec.get("added_tokens", ()) for k in ("lstrip", "rstrip", "single_word", "normalized"))
        self.by_chunk = plain and not flags and not any(c.isspace() for t in added for c in t)
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        # A chunk of letters and a mark holds no added token if each of these has some other character.
        self.words_are_plain = all(any(not c.isalpha() and c not in MARKS for c in t) for t in added)
        self.pieces = regex.compile(GPT_PIECES)
        self.piece, self.chunk = _Memo(self._piece), _Memo(self._word, WORDS)
        self.mixed = _Memo(self._chunk, WORDS // 8)

    def _packed(self, ids: list[int]) -> bytes:
        return b"".join([self.ids[i] for i in ids])

    def _piece(self, piece: str) -> bytes:
        # Visible ASCII characters are their own symbols.
        plain = piece.isascii() and piece.isprintable()
        said = piece.replace(" ", self.symbols[32]) if plain else "".join([self.symbols[b] for b in piece.encode()])
        return b"".join([self.ids[t.id] for t in self.model.tokenize(said)])

    def _word(self, chunk: str) -> bytes:
        """Ids of a chunk that is the same wherever it stands: a line break, or no white space but a space
        that begins it."""
        if chunk != "\n" and (not (bare := chunk.removeprefix(" ")) or _SPACE.search(bare)):
            raise _Mixed
        return self._chunk(chunk)

    def _chunk(self, chunk: str) -> bytes:
        # Which characters are letters is settled up to U+024F; beyond that the library has its own tables.
        bare = chunk[1:] if chunk[0] == " " else chunk
        letters = bare.rstrip(punctuation)
        tail, worded = bare[len(letters) :], letters.isalpha()
        known = self.words_are_plain and worded and (not tail or tail in MARKS and len(tail) == 1)
        if not chunk.isascii() and max(chunk) > "\u024f" or not known and self.added.search(chunk):
            return self._packed(self.library.encode(chunk, add_special_tokens=False).ids)
        if not worded:
            return b"".join([self.piece[p] for p in self.pieces.findall(chunk)])
        if not tail:  # kept as a chunk, so not as a piece as well
            return self._piece(chunk)
        word = chunk[: -len(tail)]
        return (self.chunk.get(word) or self.chunk.older.get(word) or self._piece(word)) + self.piece[tail]

    def _part(self, part: str) -> bytes:
        if "\0" not in part:
            # Most texts have single spaces, which go with what follows, and line breaks between other characters.
            chunks, chunk = part.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0"), self.chunk
            try:
                return b"".join([chunk[c] for c in chunks[not chunks[0] : len(chunks) - (not chunks[-1])]])
            except _Mixed:
                pass
        chunks = _CUT.split(part) if "\0" in part or _WIDE_SPACE.search(part) else part.replace(" ", "\0 ").split("\0")
        return b"".join([self._either(c) for c in chunks if c])

    def _either(self, chunk: str) -> bytes:
        try:
            return self.chunk[chunk]
        except _Mixed:
            return self.mixed[chunk]

    def packed(self, text: str) -> bytes:
        """Ids as little-endian numbers of ``width`` bytes."""
        if not self.by_chunk:
            return self._packed(self.library.encode(text, add_special_tokens=False).ids)
        out, at = [], 0
        while at < len(text):
            # Very long texts a slice at a time, which ends at a safe cut as well.
            end = next((m.start() for m in _CUT.finditer(text, at + SLICE)), len(text)) if len(text) - at > 2 * SLICE else len(text)
            out.append(self._part(text[at:end]))
            at = end
        return b"".join(out)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class _File:
    """One file being written."""

    def __init__(self, folder: str, width: int):
        self.name, self.width = f"{folder}/{uuid.uuid4().hex}.ltok", width
        store, path = fs.FileSystem.from_uri(self.name)
        self.out, self.pack = store.open_output_stream(path), zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.docs: list[tuple[int | None, int, int]] = []
        self.frames: list[tuple[int, int, int]] = []
        self.bytes = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        step = FRAME_IDS * self.width
        for at in range(0, len(ids), step):
            plain = ids[at : at + step]
            packed = self.pack.compress(plain)
            self.out.write(packed)
            self.bytes += len(packed)
            self.frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.docs.append((doc_id, len(ids) // self.width, -(-len(ids) // step)))

    def full(self) -> bool:
        return self.bytes >= FILE_BYTES or len(self.docs) >= FILE_DOCS

    def close(self, part: int, no: int) -> pa.RecordBatch:
        ids, sizes, frames = zip(*self.docs, strict=True)
        known = np.array([i is not None for i in ids])
        numbers = np.array([i or 0 for i in ids], dtype="<i8")
        listed = numbers.tobytes() + known.astype("u1").tobytes() + np.array(sizes, dtype="<u8").tobytes() + np.array(frames, dtype="<u4").tobytes()
        index = HEAD.pack(b"LTOK", 1, self.width, len(ids)) + self.pack.compress(listed)
        table = np.array(self.frames, dtype=ENTRY).tobytes() + FOOT.pack(len(self.frames), CHECKSUMS, SEEKABLE)
        for magic, content in ((INDEX_MAGIC, index), (TABLE_MAGIC, table)):
            self.out.write(FRAME.pack(magic, len(content)) + content)
        self.out.close()
        some = numbers[known]
        first, last = (int(some.min()), int(some.max())) if len(some) else (None, None)
        row = (self.name, part, no, first, last, not known.all(), len(ids), sum(sizes))
        names = [c.split()[0] for c in MANIFEST.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)


def _write_batches(batches: Iterator[pa.RecordBatch], tokenizer: str, folder: str, end_id: int) -> Iterator[pa.RecordBatch]:
    made, part, no, file = encoder(tokenizer), TaskContext.get().partitionId(), 0, None
    end = np.array([end_id], dtype=f"<u{made.width}").tobytes()
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            file = file or _File(folder, made.width)
            file.add(doc_id, made.packed(text.as_py() or "") + end)
            if file.full():
                yield file.close(part, no)
                file, no = None, no + 1
    if file:
        yield file.close(part, no)


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2) -> None:
    """Writes the ids of all ``docs`` (doc_id, text) to new files of ``folder``, in ascending doc_id
    order, each document followed by ``end_id``; then the table of the files.

    Rows are dealt to tasks by ranges of doc_id and sorted there, and a task writes its frames one
    after the other: it holds one document and the index of one file.  A task that is run again
    writes files of other names, and only files of tasks that succeeded are listed.  ``folder`` is a
    URI or path of a store that all executors share and that pyarrow can open.

    Null and empty texts have the end id alone.  A null doc_id comes before all others; rows of one
    doc_id stand in the order of a hash of their texts, repeated rows beside each other; a very long
    text has several frames; an empty table gives an empty list of files; other columns are
    ignored."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tie = F.xxhash64("text")
    rows = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    folder = folder if "://" in folder or folder.startswith("/") else f"file://{folder.removeprefix('file:')}"
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    rows.mapInArrow(lambda b: _write_batches(b, tokenizer, folder, end_id), MANIFEST).write.parquet(f"{folder}/manifest")


class Reader:
    """One file, opened: its documents, and where their frames are."""

    def __init__(self, name: str):
        store, path = fs.FileSystem.from_uri(name)
        self.file = store.open_input_file(path)
        size = self.file.size()
        n, flags, magic = FOOT.unpack(self.file.read_at(FOOT.size, size - FOOT.size))
        if magic != SEEKABLE or flags != CHECKSUMS:
            raise ValueError(f"{name} does not end in a seek table")
        at = size - FOOT.size - n * ENTRY.itemsize - FRAME.size
        self.frames = np.frombuffer(self.file.read_at(n * ENTRY.itemsize, at + FRAME.size), dtype=ENTRY)
        self.at = np.concatenate(([0], np.cumsum(self.frames["packed"], dtype=np.int64)))
        magic, length = FRAME.unpack(self.file.read_at(FRAME.size, int(self.at[-1])))
        index = self.file.read_at(length, int(self.at[-1]) + FRAME.size)
        mark, version, self.width, docs = HEAD.unpack(index[: HEAD.size])
        if magic != INDEX_MAGIC or mark != b"LTOK" or version != 1:
            raise ValueError(f"{name} has no index of this format")
        self.unpack = zstandard.ZstdDecompressor()
        listed = self.unpack.decompress(index[HEAD.size :])
        numbers, known = np.frombuffer(listed, "<i8", docs), np.frombuffer(listed, "u1", docs, 8 * docs).astype(bool)
        self.ids = [int(i) if k else None for i, k in zip(numbers, known, strict=True)]
        self.sizes = np.frombuffer(listed, "<u8", docs, 9 * docs).astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        self.first = np.concatenate(([0], np.cumsum(np.frombuffer(listed, "<u4", docs, 17 * docs), dtype=np.int64)))

    def document(self, k: int) -> bytes:
        """Ids of the k-th document as numbers of four bytes; its frames alone are read and checked."""
        a, b = int(self.first[k]), int(self.first[k + 1])
        packed = self.file.read_at(int(self.at[b] - self.at[a]), int(self.at[a]))
        out = []
        for f in range(a, b):
            x, y = int(self.at[f] - self.at[a]), int(self.at[f + 1] - self.at[a])
            plain = self.unpack.decompress(packed[x:y])
            if len(plain) != self.frames["plain"][f] or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.frames["check"][f]:
                raise ValueError(f"frame {f} fails its checksum")
            out.append(np.frombuffer(plain, dtype=f"<u{self.width}").astype("<u4").tobytes())
        return b"".join(out)


def _read_batches(batches: Iterator[pa.RecordBatch], wanted: frozenset[int] | None) -> Iterator[pa.RecordBatch]:
    names, kinds = ["doc_id", "start", "n_tokens", "ids"], [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    for batch in batches:
        for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
            file, rows, held = Reader(name), [], 0
            for k, doc_id in enumerate(file.ids):
                if wanted is not None and doc_id not in wanted:
                    continue
                rows.append((doc_id, base + int(file.starts[k]), int(file.sizes[k]), file.document(k)))
                held += len(rows[-1][3])
                if held >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The files of ``folder`` in the order of their documents, with the ids before each (``base``).
    One row for each 256 MB of frames."""
    before = W.orderBy("part", "no").rowsBetween(W.unboundedPreceding, -1)
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    return files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read(spark: SparkSession, folder: str, doc_ids: Collection[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens (with the end id) and ids (numbers of
    four bytes, little-endian) of each document, or of those of ``doc_ids``: then only files whose
    range has one of them are opened, and only their frames are decompressed."""
    files, wanted = manifest(spark, folder), None
    n = max(1, files.count())
    if doc_ids is not None:
        wanted = frozenset(doc_ids)
        files = files.filter(F.exists(F.array(*map(F.lit, sorted(wanted))) if wanted else F.array().cast("array<long>"), lambda i: i.between(F.col("first"), F.col("last"))))
    return files.select("file", "base").repartition(n).mapInArrow(lambda b: _read_batches(b, wanted), "doc_id long, start long, n_tokens long, ids binary")
