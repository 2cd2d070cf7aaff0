"""String scores: native expressions for short strings, array code for line-length text."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from linetrace.functions.text import COVERED

#: Characters of the first string whose bits fit one signed number, with room for a carry.
NATIVE = 61


def _zero() -> Column:
    return F.lit(0).cast("long")


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda x: x != "")


def _bits(size: Column) -> Column:
    return F.pow(F.lit(2.0), size).cast("long") - 1


def _mask(part: Column, c: Column) -> Column:
    """The places of a character in a part of the first string, as bits."""
    return F.aggregate(F.transform(_chars(part), lambda x, i: F.when(x == c, F.pow(F.lit(2.0), i).cast("long")).otherwise(_zero())), _zero(), lambda s, x: s + x)


def _clear_bits(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of a string of at most 61 characters and another one,
    counted bit by bit: a clear bit of the state is a matched character of the first."""
    full = _bits(F.length(a))

    def step(v: Column, c: Column) -> Column:
        hit = v.bitwiseAND(_mask(a, c))
        return (v + hit).bitwiseOR(v.bitwiseAND(F.bitwise_not(_mask(a, c)))).bitwiseAND(full)

    return F.length(a) - F.bit_count(F.aggregate(_chars(b), full, step))


def _clear_bits_in_parts(a: Column, b: Column) -> Column:
    """The same for a first string of any length: its bits are in several numbers, with carries."""
    starts = F.sequence(F.lit(0), F.floor((F.length(a) - 1) / NATIVE).cast("int"))
    parts = F.transform(starts, lambda k: F.substring(a, k * NATIVE + 1, F.lit(NATIVE)))
    first = F.transform(parts, lambda p: _bits(F.length(p)))

    def step(state: Column, c: Column) -> Column:
        def one(acc: Column, k: Column) -> Column:
            part, v = F.get(parts, k), F.get(state, k)
            mask = _mask(part, c)
            total = v + v.bitwiseAND(mask) + acc["carry"]
            kept = total.bitwiseOR(v.bitwiseAND(F.bitwise_not(mask))).bitwiseAND(_bits(F.length(part)))
            return F.struct((total > _bits(F.length(part))).cast("long").alias("carry"), F.concat(acc["out"], F.array(kept)).alias("out"))

        none = F.struct(_zero().alias("carry"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(starts, none, one, lambda acc: acc["out"])

    return F.length(a) - F.aggregate(F.aggregate(_chars(b), first, step), F.lit(0), lambda s, v: s + F.bit_count(v))


def indel_ratio(a: Column, b: Column) -> Column:
    """100 * 2 * LCS / (len a + len b), 100 for two empty strings; of any length, native."""
    lcs = F.when(F.length(a) == 0, 0).when(F.length(a) <= NATIVE, _clear_bits(a, b)).otherwise(_clear_bits_in_parts(a, b))
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 100.0).otherwise(200.0 * lcs / total)


def token_coverage(query: Column, line: Column, least: float = COVERED) -> Column:
    """Share of the query's long tokens whose best ratio over the line's tokens is ``least`` or
    more, times min(1, n / 4)."""
    n = F.size(query)
    met = F.size(F.filter(query, lambda q: F.exists(line, lambda t: indel_ratio(q, t) >= least)))
    return F.when(n > 0, met / n * F.least(F.lit(1.0), n / 4.0)).otherwise(0.0)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


class Coded:
    """Many strings as one array of code points, for several queries."""

    def __init__(self, lines: list[str]):
        self.codes = _codes("".join(lines))
        self.size = np.array([len(t) for t in lines], dtype=np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.size)))[:-1].astype(np.int64)

    def some(self, a: int, b: int) -> Coded:
        out = object.__new__(Coded)
        out.codes, out.size, out.start = self.codes, self.size[a:b], self.start[a:b]
        return out


def _masks(codes: np.ndarray) -> tuple[dict[int, int], np.ndarray, np.ndarray]:
    """Character numbers (0: any other), their position masks in 64-bit words, and the full mask."""
    number = {int(c): i + 1 for i, c in enumerate(dict.fromkeys(codes.tolist()))}
    words = -(-len(codes) // 64)
    masks = np.zeros((len(number) + 1, words), dtype=np.uint64)
    full = np.zeros(words, dtype=np.uint64)
    for i, c in enumerate(codes.tolist()):
        bit = np.uint64(1) << np.uint64(i % 64)
        masks[number[c], i // 64] |= bit
        full[i // 64] |= bit
    return number, masks, full


def _matched(masks: list[np.ndarray], at: np.ndarray, bits: list[np.ndarray], size: np.ndarray | int) -> np.ndarray:
    """Matched bits for many rows at once.  masks: for each word of 64 bits the masks of a text's
    characters, one after the other; at: where each row starts there; bits: the bits of each row, a word
    at a time; size: how many characters it takes, one number, or one a row in falling order."""
    n, kind = len(at), bits[0].dtype
    state = [x.copy() for x in bits]
    m, hit, total = (np.empty(n, dtype=kind) for _ in range(3))
    steps = size if isinstance(size, int) else int(size[0])
    active = None if isinstance(size, int) else np.searchsorted(-size, -np.arange(steps), side="left")
    for k in range(steps):
        j = n if active is None else int(active[k])
        carry = None
        for w, mask in enumerate(masks):
            s, mm, h, t = state[w][:j], m[:j], hit[:j], total[:j]
            np.take(mask[k:], at[:j], out=mm, mode="clip")
            np.bitwise_and(s, mm, out=h)
            np.add(s, h, out=t)
            if len(masks) > 1:  # carries run from word to word
                more = t < s
                if carry is not None:
                    t += carry
                    more |= t < carry
                carry = more.astype(kind)
            np.bitwise_xor(s, h, out=h)
            np.bitwise_or(t, h, out=s)
    return sum(np.bitwise_count(x).astype(np.int64) - np.bitwise_count(x & y).astype(np.int64) for x, y in zip(bits, state, strict=True))


def _ones(first: np.ndarray, size: np.ndarray, words: int) -> np.ndarray:
    """Rows of ``words`` numbers with ``size`` bits set from bit ``first`` on."""
    at = np.arange(words, dtype=np.int64) * 64
    low, high = np.clip(first[:, None] - at, 0, 64), np.clip((first + size)[:, None] - at, 0, 64)
    below = lambda n: np.where(n == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(n, 63).astype(np.uint64)) - np.uint64(1))
    return below(high) & ~below(low)


#: Places of a line that are tried one after the other; longer lines are tried at several places at once.
RUN = 32


def partial_ratios(query: str, lines: list[str] | Coded, floor: np.ndarray | float = 0.0, most: int = 1 << 13) -> np.ndarray:
    """Best ratio of the shorter string to any part of its length of the longer, for one query and
    many lines; an empty side gives 0.

    Results of at least ``floor`` (one, or one a line) are exact, others are below it.  A part moved by
    one place changes the number of matched characters by one at most, so parts too near to a poor one
    to reach the floor, or to beat the best so far, are passed over.  The places of a line are cut into runs
    of ``RUN``, each tried by itself, and ``most`` runs are under way at any time: as some end others
    begin, so a long line is never tried alone."""
    coded = lines if isinstance(lines, Coded) else Coded(lines)
    out = np.zeros(len(coded.size))
    q = _codes(query)
    if not len(q) or not len(out):
        return out
    number, masks, full = _masks(q)
    table = np.zeros(max(number) + 2, dtype=np.int16)
    for c, k in number.items():
        table[c] = k
    first, last = coded.start[0], coded.start[-1] + coded.size[-1]
    chars = table[np.minimum(coded.codes[first:last], len(table) - 1)]
    if len(q) <= 32:  # half the memory to go through
        masks, full = masks.astype(np.uint32), full.astype(np.uint32)
    stream = [np.ascontiguousarray(masks[:, w])[chars] for w in range(len(full))]
    begin, words = coded.start - first, len(full)
    short = np.minimum(coded.size, len(q))
    need = np.ceil(np.broadcast_to(floor, out.shape) * short / 100 - 1e-6).astype(np.int64)
    able = (short > 0) & (need <= short)
    for whole in (True, False):
        rows_all = np.flatnonzero(able & (coded.size >= len(q)) if whole else able & (coded.size < len(q)))
        if not whole:  # longest first, so that those still running come before those that have ended
            rows_all = rows_all[np.argsort(-coded.size[rows_all], kind="stable")]
        runs = (np.abs(coded.size[rows_all] - len(q)) + RUN) // RUN
        rows = np.repeat(rows_all, runs)
        place = (np.arange(len(rows)) - np.repeat(np.cumsum(runs) - runs, runs)) * RUN
        end = np.minimum(place + RUN, np.abs(coded.size[rows] - len(q)) + 1)
        best, left, taken = np.zeros(len(rows), dtype=np.int64), np.zeros(0, dtype=np.int64), 0
        while len(left) or taken < len(rows):
            if len(left) <= most // 2 and taken < len(rows):
                more = min(len(rows), taken + most - len(left))
                left, taken = np.concatenate((left, np.arange(taken, more))), more
            r, p = rows[left], place[left]
            if whole:  # parts of the line against the query
                v = _matched(stream, begin[r] + p, [np.full(len(r), x) for x in full], len(q))
            else:  # the line against parts of the query
                bits = _ones(p, coded.size[r], words)
                v = _matched(stream, begin[r], [bits[:, w].astype(full.dtype) for w in range(words)], coded.size[r])
            top = best[left] = np.maximum(best[left], v)
            p += np.maximum(1, np.maximum(top + 1, need[r]) - v)
            place[left] = p
            left = left[(p < end[left]) & (top < short[r])]
        np.maximum.at(out, rows, 100.0 * best / short[rows])
    return out


def ratio(a: str, b: str) -> float:
    """The ratio of the native expression, for any length."""
    if not a and not b:
        return 100.0
    return 200.0 * common(a, b) / (len(a) + len(b))


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence; bits of one whole number are the characters of a."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for c in b:
        if m := places.get(c):
            hit = state & m
            state = (state + hit | state & ~m) & full
    return len(a) - state.bit_count()
