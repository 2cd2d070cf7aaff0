"""Rules that carry a small state from event to event of a session: machines, one for each rule, run
over sorted batches or over streams."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PEAK, PEAK_AGE_S, BEATS, MARGIN = 85.0, 2.5, 90.0, 5.0
SECOND = 1_000_000
KINDS = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


class Follower:
    """The sticky position of one session.  A match is stale, first, highlight, swap or held: a swap
    to another passage is held back while a recent high score of the present one is not beaten."""

    STATE = "passage long, line long, seq long, peak double, at long"

    def __init__(self, passage=None, line=None, seq=-1, peak=0.0, at=0):
        self.passage, self.line, self.seq, self.peak, self.at = passage, line, seq, peak, at

    def state(self) -> tuple:
        return self.passage, self.line, self.seq, self.peak, self.at

    def act(self, us: int, seq: int, passage: int, line: int, score: float) -> str:
        if seq < self.seq:
            return "stale"
        if passage == self.passage:
            self.line, self.seq, self.at, self.peak = line, seq, us, max(self.peak, score)
            return "highlight"
        if self.passage is not None and self.peak >= PEAK and us - self.at < PEAK_AGE_S * SECOND and score < BEATS and score < self.peak - MARGIN:
            return "held"
        did = "first" if self.passage is None else "swap"
        self.passage, self.line, self.seq, self.peak, self.at = passage, line, seq, score, us
        return did

    def take(self, key, us, seq, passage, line, score) -> list[tuple]:
        did = self.act(us, seq, passage, line, score)
        return [(key, us, seq, did, self.passage, self.line)]

    def end(self, key) -> list[tuple]:
        return []


class Tracker:
    """SEARCHING, LOCKED and DRIFTING by the scores of matches."""

    def __init__(self):
        self.mode, self.low = "SEARCHING", None

    def take(self, key, us, seq, score) -> list[tuple]:
        self.low = None if score >= 50 else us if self.low is None else self.low
        if score >= (75 if self.mode == "SEARCHING" else 65):
            self.mode = "LOCKED"
        elif self.mode == "LOCKED":
            self.mode = "DRIFTING"
        elif self.mode == "DRIFTING" and self.low is not None and us - self.low >= 30 * SECOND:
            self.mode = "SEARCHING"
        return [(key, us, seq, self.mode)]

    def end(self, key) -> list[tuple]:
        return []


class Frozen:
    """An empty text leaves what is shown; so does one under half as long as a shown text of more than
    twelve characters, unless the canonical source says it."""

    STATE = "shown string"

    def __init__(self, shown=""):
        self.shown = shown

    def state(self) -> tuple:
        return (self.shown,)

    def take(self, key, us, seq, text, canonical) -> list[tuple]:
        if text and (canonical or len(self.shown) <= 12 or 2 * len(text) >= len(self.shown)):
            self.shown = text
        return [(key, us, seq, self.shown)]

    def end(self, key) -> list[tuple]:
        return []


class Transcript:
    """Texts joined by spaces; a part's head is dropped where it repeats the last characters so far."""

    STATE = "parts long, said string"
    TAIL = 20

    def __init__(self, parts=0, said=""):
        self.parts, self.said = parts, said

    def state(self) -> tuple:
        return self.parts, self.said

    def take(self, key, seq, text) -> list[tuple]:
        self.parts += 1
        tail = self.said[-self.TAIL :]
        if text and self.said:
            self.said += text[len(tail) :] if text.startswith(tail) else f" {text}"
        elif text:
            self.said = text
        return [(key, seq, self.parts, self.said)]

    def end(self, key) -> list[tuple]:
        return []


class Limiter:
    """At most ``limit`` accepted hits in the window before each, its edge included; rejected ones do
    not count."""

    def __init__(self, limit: int, window_s: float):
        self.limit, self.window, self.recent = limit, window_s * SECOND, deque()

    def take(self, key, us, id_) -> list[tuple]:
        while self.recent and self.recent[0] < us - self.window:
            self.recent.popleft()
        allowed = len(self.recent) < self.limit
        if allowed:
            self.recent.append(us)
        reset = (self.recent[0] if self.recent else us) + int(self.window)
        return [(key, us, id_, allowed, self.limit - len(self.recent), reset)]

    def end(self, key) -> list[tuple]:
        return []


class Cascade:
    """The present passage of a session and those it has seen.  An utterance comes with its best match
    in each tier: the present passage is tier 1, seen ones tier 2, all others tier 3.  A short text
    is only taken from tier 1 with a high score, tier 3 has a bar of its own, and an interjection
    changes nothing."""

    STATE = "passage long, seen string, seq long"
    SHORT, SURE, ANY, ACCEPT = 6, 85.0, 45.0, 60.0

    def __init__(self, passage=None, seen="", seq=-1):
        self.passage, self.seen, self.seq = passage, {int(x) for x in seen.split(",") if x}, seq

    def state(self) -> tuple:
        return self.passage, ",".join(map(str, sorted(self.seen))), self.seq

    def take(self, key, seq, size, interjection, passages, scores) -> list[tuple]:
        best: dict[int, tuple[float, int]] = {}
        for passage, score in zip(() if passages is None else passages, () if scores is None else scores, strict=True):
            tier = 1 if passage == self.passage else 2 if passage in self.seen else 3
            if tier not in best or (score, -passage) > (best[tier][0], -best[tier][1]):
                best[tier] = score, passage
        if interjection or seq < self.seq:
            return [(key, seq, "interjection" if interjection else "stale", self.passage)]
        bars = {1: self.SURE} if size < self.SHORT else {1: self.ACCEPT, 2: self.ACCEPT, 3: self.ANY}
        for tier, bar in bars.items():
            if tier in best and best[tier][0] >= bar:
                self.passage, self.seq = best[tier][1], seq
                self.seen.add(self.passage)
                return [(key, seq, f"tier {tier}", self.passage)]
        return [(key, seq, "none", self.passage)]

    def end(self, key) -> list[tuple]:
        return []


def _columns(schema: str) -> tuple[list[str], list[pa.DataType]]:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return list(names), [KINDS[k] for k in kinds]


def fold(rows: DataFrame, machine: Callable[[], object], order: list[str], schema: str, last_only: bool = False) -> DataFrame:
    """Runs a machine over the rows of each key (the first column) in ``order``; ``last_only`` keeps the
    last result of each key.

    Rows are brought together by key and sorted by Spark, which may spill, and pass the machine batch
    by batch: a task holds one batch and one state, however many rows a key has."""
    key = rows.columns[0]
    names, kinds = _columns(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out, last = None, None, [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or row[0] != now:
                    if state is not None:
                        out += [last] if last_only else state.end(now)
                    now, state = row[0], machine()
                new = state.take(*row)
                if last_only:
                    last = new[-1]
                else:
                    out += new
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)
            out = []
        if state is not None:
            out = [last] if last_only else state.end(now)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def stream(rows: DataFrame, machine: type, order: list[str], schema: str, idle_ms: int | None = None) -> DataFrame:
    """The same over a stream, results appended as events come; events of one trigger are put in order.
    With ``idle_ms`` a key's state ends after so long without events.

    A stream with such a timeout runs another batch whenever it could expire a state, so a trigger that
    takes what is available and stops would never stop: ``idle_ms`` is for streams that run on."""
    key, columns = rows.columns[0], rows.columns
    names, _ = _columns(schema)
    kept, kinds = zip(*(x.split() for x in machine.STATE.split(", ")), strict=True)
    # A state's fields may be unset; they are kept as text, which knows no missing numbers.
    stored = ", ".join(f"{k} string" for k in kept)
    back = {"long": int, "double": float, "string": str}

    def step(k: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        old = state.getOption
        values = () if old is None else [None if v == "-" else back[kind](v[1:]) for v, kind in zip(old, kinds, strict=True)]
        runner, out = machine(*values), []
        events = pd.concat(list(pdfs)).sort_values(order)
        for row in zip(*(events[c].tolist() for c in columns), strict=True):
            out += runner.take(*row)
        state.update(tuple("-" if v is None else f"={v}" for v in runner.state()))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=names)

    return rows.groupBy(F.col(key)).applyInPandasWithState(step, schema, stored, "append", "NoTimeout" if idle_ms is None else "ProcessingTimeTimeout")
