"""Exact token counts at every prefix of a text, by dynamic programming.

A word of a BPE vocabulary has one valid segmentation, and its prefixes have segmentations that
share their last tokens: the segmentation of a prefix ends in token t exactly if t may follow the
last token of the segmentation before t.  One left-to-right pass thus finds the last token, and so
the count, of every prefix.  Texts store the change of the count at each code point (one byte), so
truncation and budgets are sums over bytes and nothing is encoded twice.

For vocabularies in the JSON format whose normaliser is NFC, white space to one space, lower case,
and whose words end in a marked symbol.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries of the tables of words (each half), and of prefixes, that a task keeps; some 200 bytes each.
MEMO, HEADS = 300_000, 1_000_000
#: A starter with more marks than this is counted by the change that each new one makes.
FEW = 24
#: Pieces of more characters are not kept by their prefixes.
SHORT = 64
_NONE = 1 << 62


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for
    itself, the others follow from U+0100 in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


@lru_cache(maxsize=1)
def _joins_left() -> frozenset[str]:
    """Characters that normalisation may merge with, or move before, what precedes them."""
    out = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    for c in map(chr, range(0x300, sys.maxunicode + 1)):
        if unicodedata.combining(c):
            out.add(c)
        elif (d := unicodedata.decomposition(c)) and d[0] != "<" and " " in d:
            out.add(chr(int(d.split()[1], 16)))
    return frozenset(out)


class _Memo(dict):
    """A table that computes what it lacks.  Once full it becomes the older half, from which entries
    in use move over, and a new half begins."""

    def __init__(self, make, most: int = MEMO):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        if len(key) < 200:
            self[key] = value
        return value


#: White_Space of the vocabulary's normaliser.
_SPACE = re.compile("([\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+)")


#: Texts without these characters can be cut at any border of a letter run (quotes aside): nothing
#: below U+0300 joins with what follows, and only U+0130 changes its length in lower case.
_ODD = re.compile("[\u0130\u0300-\U0010ffff]")
_RUNS = re.compile("((?:(?<![^\\w \\t-\\r\\x85\\xa0])(?<!_)')?[^\\W\\d_]+(?:'[^\\W\\d_]+)*)")


def _parts(c: str) -> str:
    """A code point taken apart as normalisation does; Hangul syllables stay whole."""
    return c if "\uac00" <= c <= "\ud7a3" else unicodedata.normalize("NFD", c)


def _lower(text: str) -> str:
    return "".join(c.lower() for c in text)


class _Cluster:
    """A starter and the marks after it, in canonical order: by class, and as they came within one.
    The first marks of a class may merge with the starter."""

    __slots__ = ("blocks", "head", "merged", "order", "starter")

    def __init__(self, starter: str = ""):
        self.starter = self.head = starter
        self.blocks: dict[int, list[str]] = {}
        self.merged: dict[int, int] = {}
        self.order: list[int] = []

    def add(self, mark: str, kind: int) -> bool:
        """Whether the marks that merge with the starter are others than before."""
        block = self.blocks.get(kind)
        if block is None:
            block = self.blocks[kind] = []
            self.merged[kind] = 0
            self.order = sorted(self.blocks)
        block.append(mark)
        # Behind a mark that does not merge, none of its class does.
        if len(block) > self.merged[kind] + 1 or not self.starter:
            return False
        head, before = self.starter, dict(self.merged)
        for k in self.order:
            n = 0
            for m in self.blocks[k]:
                whole = unicodedata.normalize("NFC", head + m)
                if len(whole) > 1:
                    break
                head, n = whole, n + 1
            self.merged[k] = n
        self.head = head
        return self.merged != before

    def join(self, other: str) -> bool:
        """Merge with a second starter, which must stand next to this one."""
        if not self.head or any(len(b) > self.merged[k] for k, b in self.blocks.items()):
            return False
        whole = unicodedata.normalize("NFC", self.head + other)
        if len(whole) == 1:
            self.__init__(whole)
        return len(whole) == 1

    def marks(self) -> Iterator[str]:
        """The marks that do not merge, class by class, in lower case."""
        return (_lower("".join(self.blocks[k][self.merged[k] :])) for k in self.order)

    def text(self) -> str:
        return _lower(self.head) + "".join(self.marks())


class _Row:
    """Entries along a piece of which symbols come in anywhere.  From the new symbols on entries are
    found again, until as many in a row as one can depend on are what they were; beyond, only counts
    move, all by the same number."""

    def __init__(self, vocab: Vocabulary, walk: _Walk):
        self.vocab, self.text, self.far = vocab, walk.text, 1
        self.last = [h & 0xFFFFFFFF for h in walk.heads]
        self.count = np.array([h >> 64 for h in walk.heads], np.int64)

    def _at(self, end: int) -> int:
        begin = max(0, end - self.vocab.reach)
        return self.vocab._entry(self.text[begin:end], lambda at: int(self.count[begin + at]) << 64 | self.last[begin + at])

    def insert(self, at: int, new: str) -> None:
        k, size = len(new), len(self.text)
        self.text = self.text[:at] + new + self.text[at:]
        self.last[at + 1 : at + 1] = [0] * k
        if len(self.count) < size + k + 1:
            self.count = np.concatenate([self.count, np.zeros(len(self.count) + k, np.int64)])
        self.count[at + 1 + k : size + 1 + k] = self.count[at + 1 : size + 1].copy()
        same = shift = 0
        for end in range(at + 1, size + k + 1):
            entry = self._at(end)
            self.far = max(self.far, self.vocab.read)
            token, count = entry & 0xFFFFFFFF, entry >> 64
            moved = count - int(self.count[end])
            same = (same + 1 if moved == shift else 1) if end > at + k and token == self.last[end] else 0
            shift = moved
            self.last[end], self.count[end] = token, count
            if same > self.far:
                self.count[end + 1 : size + k + 1] += shift
                break

    def ended(self) -> int:
        return self._at(len(self.text)) >> 32 & 0xFFFFFFFF


class _Walk:
    """The last symbols of a piece, and the entries at the borders between them.  ``lead`` is a
    character of the piece's kind."""

    __slots__ = ("heads", "lead", "text")

    def __init__(self, text: str = "", heads: list[int] | None = None, lead: str = ""):
        self.text, self.heads, self.lead = text, heads or [0], lead

    def copy(self) -> _Walk:
        return _Walk(self.text, list(self.heads), self.lead)

    def ended(self) -> int:
        return self.heads[-1] >> 32 & 0xFFFFFFFF


class Vocabulary:
    """Merges of one file, and the counts of words and prefixes met so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        end = model["end_of_word_suffix"]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for r, (a, b) in enumerate(model["merges"]):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.rank[left, right] = r
            if whole not in self.parts:
                self.parts[whole], self.made[whole] = (left, right), r
        # Endings of tokens: the token, or -1 where only longer tokens end so.
        self.endings: tuple[dict[str, int], dict[str, int]] = ({}, {})
        for text, token in vocab.items():
            last = text.endswith(end)
            bare = text.removesuffix(end)
            if len(bare) > 1 and token not in self.parts:
                continue  # no merge makes it
            for k in range(1, len(bare)):
                self.endings[last].setdefault(bare[k:], -1)
            self.endings[last][bare] = token
        self.symbols = [_byte_symbols()[b] for b in range(256)]
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self.fits: dict[int, bool] = {}
        self.read = 0  # how many symbols the last entry looked at
        self.reach = max(map(len, (*self.endings[0], *self.endings[1])))
        self.letter = regex.compile(r"\p{L}")
        # Of each prefix of a word, in byte symbols, in one number: its count, its count if the word
        # ends here, and its last token plus one, in fields of 32 bits.
        self.heads: dict[str, int] = {"": 0}
        self.piece = _Memo(self._piece)
        self.chunk = _Memo(self._chunk)

    def _joinable(self, a: int, b: int) -> bool:
        """Whether two tokens in a row stay two tokens: no merge across their border would have
        come before the merges that made them."""
        pair, bound, out = a << 32 | b, _NONE, True
        while True:
            if self.rank.get((a, b), _NONE) < bound:
                out = False
                break
            ra, rb = self.made.get(a, -1), self.made.get(b, -1)
            if ra < 0 and rb < 0:
                break
            # Undo the later merge of the two; on a tie the left one was made first.
            if ra > rb:
                bound, a = ra, self.parts[a][1]
            else:
                bound, b = rb + 1, self.parts[b][0]
        self.fits[pair] = out
        return out

    def _entry(self, word: str, head_at: Callable[[int], int]) -> int:
        """The entry of a prefix whose last symbols are ``word``; head_at(k) is the entry of the prefix
        that ends before word[k:]."""
        inner, final = self.endings
        fits = self.fits
        last, ended = [], []
        at = len(word) - 1
        while at >= 0:
            end = word[at:]
            a, b = inner.get(end), final.get(end)
            if a is None and b is None:
                break
            if a is not None and a >= 0:
                last.append((at, a))
            if b is not None and b >= 0:
                ended.append((at, b))
            at -= 1
        self.read = len(word) - at
        out = 0
        for found, place in ((last, 64), (ended, 32)):
            for at, token in reversed(found):
                head = head_at(at)
                before = (head & 0xFFFFFFFF) - 1
                if before >= 0:
                    fit = fits.get(before << 32 | token)
                    if not (self._joinable(before, token) if fit is None else fit):
                        continue
                out |= (head >> 64) + 1 << place
                if place == 64:
                    out |= token + 1
                break
            else:
                raise ValueError(f"the vocabulary has no symbol for {word!r}")
        return out

    def _tidy(self) -> None:
        if len(self.heads) > HEADS:
            self.heads.clear()
            self.heads[""] = 0
        if len(self.fits) > HEADS:
            self.fits.clear()

    def _along(self, piece: str, walk: _Walk) -> list[int]:
        """Token count of each prefix of what ``walk`` has passed and ``piece``; moves the walk.  Linear
        in the piece, and nothing is kept but the counts."""
        self._tidy()
        out, symbols, reach = [], self.symbols, self.reach
        for c in piece:
            for b in c.encode():
                text, heads = walk.text + symbols[b], walk.heads
                heads.append(self._entry(text, heads.__getitem__))
                walk.text = text
                if len(text) > 2 * reach:
                    walk.text, walk.heads = text[-reach:], heads[-reach - 1 :]
            out.append(walk.ended())
        return out

    def _piece(self, piece: str) -> list[int]:
        """Token count of each prefix of one piece of lower-cased text.  The prefixes of short pieces are
        shared by all pieces that begin alike."""
        if len(piece) > SHORT:
            return self._along(piece, _Walk())
        self._tidy()
        out, word, heads, symbols = [], "", self.heads, self.symbols
        for c in piece:
            for b in c.encode():
                word += symbols[b]
                head = heads.get(word)
                if head is None:
                    head = heads[word] = self._entry(word, lambda at, w=word: heads[w[:at]])
            out.append(head >> 32 & 0xFFFFFFFF)
        return out

    def _running(self, text: str, walk: _Walk | None = None) -> list[int]:
        """Token count of each prefix of normalised text, which may go on with the piece of ``walk``."""
        lead, begun = ("", 0) if walk is None else (walk.lead, walk.ended())
        out: list[int] = []
        for m in self.pieces.finditer(lead + text):
            start = m.start() - len(lead)
            if start < 0:
                out += self._along(m[0][1:], walk.copy())
                continue
            base = out[-1] if out else begun
            out += [base] * (start - len(out))
            own = self.piece[m[0]]
            if len(own) > 2 and m[0][0] == "'" and m[0][1].isalpha():  # a cut contraction is a quote and a letter
                own = [own[0], own[0] + self.piece[m[0][1]][0], *own[2:]]
            out += [base + x for x in own]
        return out + [out[-1] if out else begun] * (len(text) - len(out))

    def _total(self, text: str, walk: _Walk | None) -> int:
        return self._running(text, walk)[-1] if text else 0 if walk is None else walk.ended()

    def _chunk(self, chunk: str) -> bytes:
        """Change of the count at each code point of a part of a text, plus 128."""
        low = chunk.lower() if chunk.isascii() else "".join(c.lower() for c in chunk)
        if len(low) == len(chunk) and (chunk.isascii() or max(chunk) < "\u0300"):
            counts = self._piece(low) if low.isalpha() else self._running(low)
        else:
            counts = self._unsettled(chunk)
        delta = np.diff(np.array([0, *counts])) if len(chunk) > 64 else [b - a for a, b in zip([0, *counts], counts)]
        if max(delta) > 127 or min(delta) < -128:
            raise ValueError("one code point changes the count by more than a byte holds")
        return bytes([int(d) + 128 for d in delta])

    def _row(self, cluster: _Cluster, tail: str, walk: _Walk | None) -> tuple[_Row, int, int]:
        """The piece that holds the marks of a cluster, its symbols before them, and the count before it."""
        lead, text, marks = "" if walk is None else walk.lead, tail + _lower(cluster.head), "".join(cluster.marks())
        start = list(self.pieces.finditer(lead + text + marks[0]))[-1].start() - len(lead)
        begun, base = (walk.copy(), 0) if start < 0 else (_Walk(), self._total(text[:start], walk))
        self._along(text[max(0, start) :], begun)
        row, before = _Row(self, begun), len(begun.text)
        row.insert(before, "".join(self.symbols[b] for b in marks.encode()))
        return row, before, base

    def _unsettled(self, chunk: str) -> list[int]:
        """As _running, where normalisation or lower case may change lengths: only what a later
        character can still change, a starter and its marks, is counted again, and where there are
        many marks, only around the place of the new one."""
        out, base, tail, walk = [], 0, "", None
        joins, cluster, row, sizes, waiting = _joins_left(), _Cluster(), None, {}, 0
        for c in chunk:
            for part in _parts(c):
                kind = unicodedata.combining(part)
                if kind:
                    waiting += 1
                    if cluster.add(part, kind):
                        row = None
                    elif row is not None:
                        new = "".join(self.symbols[b] for b in part.lower().encode())
                        row[0].insert(row[1] + sum(n for k, n in sizes.items() if k <= kind), new)
                        sizes[kind] = sizes.get(kind, 0) + len(new)
                elif part in joins and cluster.join(part):
                    waiting = 0
                else:
                    base, tail, walk = self._settled(base, tail + cluster.text(), walk)
                    cluster, row, waiting = _Cluster(part), None, 0
            if waiting > FEW and row is None:
                row = self._row(cluster, tail, walk)
                sizes = {k: len(m.encode()) for k, m in zip(cluster.order, cluster.marks())}
            out.append(base + (self._total(tail + cluster.text(), walk) if row is None else row[2] + row[0].ended()))
        return out

    def _settled(self, base: int, tail: str, walk: _Walk | None) -> tuple[int, str, _Walk | None]:
        """Count what no later character can change: the new count, text still open, and walk."""
        lead = "" if walk is None else walk.lead
        pieces = list(self.pieces.finditer(lead + tail))
        # The last two pieces may turn out to be one contraction; those before are settled.
        if len(pieces) > 2:
            cut = pieces[-2].start() - len(lead)
            base += self._total(tail[:cut], walk)
            tail, walk, lead = tail[cut:], None, ""
            pieces = list(self.pieces.finditer(tail))
        # No contraction is so long: the piece can only grow, so a walk along it is enough.
        if pieces and len(pieces[-1][0]) > 4 and pieces[-1].end() == len(lead + tail):
            cut = pieces[-1].start() - len(lead)
            if cut >= 0:
                base += self._total(tail[:cut], walk)
                walk = _Walk()
            self._along(tail[max(0, cut) :], walk)
            walk.lead = "a" if self.letter.match(pieces[-1][0]) else "!"
            tail = ""
        return base, tail, walk

    def deltas(self, text: str) -> bytes:
        """Change of the count at each code point, plus 128.  A special string is one token once it
        is whole; its prefixes are ordinary text."""
        out, at = [], 0
        for m in self.special.finditer(text):
            before, both = self._plain(text[at : m.start()]), self._plain(text[at : m.end()])
            change = sum(before) - 128 * len(before) + 1 - (sum(both[:-1]) - 128 * (len(both) - 1))
            out += [both[:-1], bytes([128 + change])]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def _plain(self, text: str) -> bytes:
        chunk = self.chunk
        cut = _SPACE if _ODD.search(text) else _RUNS
        return b"".join([chunk[part] for part in cut.split(text) if part])


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _count_batches(batches: Iterator[pa.RecordBatch], path: str, keep: bool) -> Iterator[pa.RecordBatch]:
    vocab = vocabulary(path)
    for batch in batches:
        size, total, store = [], [], []
        for t in batch.column("text"):
            text = t.as_py() or ""
            deltas = vocab.deltas(text)
            size.append(len(text.encode()))
            total.append(int(np.frombuffer(deltas, np.uint8).sum(dtype=np.int64)) - 128 * len(deltas))
            store.append(deltas if keep else None)
        columns = [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(total, pa.int64())]
        names = ["doc_id", "n_bytes", "n_tokens"]
        if keep:
            columns, names = [*columns, pa.array(store, pa.binary())], [*names, "deltas"]
        yield pa.RecordBatch.from_arrays(columns, names)


def prefix_counts(docs: DataFrame, path: str, keep_prefixes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_tokens and, if asked for, ``deltas`` for each row of ``docs``.

    ``deltas`` has one byte for each code point: 128 plus the change of the token count there, so
    the count of any prefix is a sum over it (``count_at``), and the longest prefix within a budget
    a scan of it (``fits``).  The vocabulary file is opened by its path on each executor, where it
    is installed.  Null texts count as empty; a null doc_id stays; repeated rows give repeated
    results; other columns are ignored; an empty table gives an empty result; ties don't occur.  Very
    long texts are counted whole, in time that grows with their length; one starter with very many
    marks costs a copy of its marks for each (20,000 marks: some 2 s)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_bytes long, n_tokens long" + ", deltas binary" * keep_prefixes
    return rows.mapInArrow(lambda b: _count_batches(b, path, keep_prefixes), schema)


def count_at(deltas: Column, prefix: Column) -> Column:
    """Token count of the first ``prefix`` code points."""

    @F.pandas_udf("long")
    def at(d, k):
        import pandas as pd

        return pd.Series([None if x is None else int(np.frombuffer(x, np.uint8)[: int(n)].sum(dtype=np.int64)) - 128 * min(int(n), len(x)) for x, n in zip(d, k, strict=True)], dtype="Int64")

    return at(deltas, prefix)


def fits(deltas: Column, budget: int) -> Column:
    """Code points of the longest prefix of at most ``budget`` tokens."""

    @F.pandas_udf("long")
    def at(d):
        import pandas as pd

        out = []
        for x in d:
            running = np.concatenate(([0], np.cumsum(np.frombuffer(x or b"", np.uint8).astype(np.int64) - 128)))
            out.append(int(np.flatnonzero(running <= budget)[-1]) if budget >= 0 else 0)
        return pd.Series(out, dtype="int64")

    return at(deltas)
