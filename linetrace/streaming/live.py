"""Live sessions that search by where they stand: machines with timers, over sorted rows or over streams
with ``transformWithStateInPandas``.

A machine takes the events of one key in order.  ``fire`` gives what falls due up to a moment without
an event, and ``due`` the moments of its timers, if it is ``TIMED``.  Over sorted rows each event first
fires what was due before it, and the end of the table fires up to the horizon; over a stream event-time
timers do, and the horizon is the watermark.  So a stream that has read everything gives the rows of the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, MutableMapping
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from linetrace.operators.lineindex import LineIndex, Scorer
from linetrace.operators.match import ACCEPT, LEAD, STRONG
from linetrace.streaming.machines import SECOND, Limiter, fold

UNSET = -(1 << 63)
#: Groups that keys with small states are dealt to.
GROUPS = 1 << 10
SEARCHING, LOCKED, DRIFTING = "SEARCHING", "LOCKED", "DRIFTING"


class Position:
    """Where a reader stands.  SEARCHING takes the best line of the whole corpus, which comes with the
    utterance, from 75 on.  LOCKED and DRIFTING look themselves among the lines near the last one
    (``REACH``), nearer and later lines first at like scores, and keep it from 65 on.  ``WEAK`` low scores
    in a row lead from LOCKED to DRIFTING, 30 seconds under 50 from there to SEARCHING.  A pause of 10
    seconds holds everything as it is, one of 5 minutes asks whether anybody still reads."""

    TIMED = True
    STATE = "mode string, line long, weak long, low long, last long, held boolean, asked boolean"
    ROWS = "session_id long, us long, seq long, event string, mode string, line long, score double, held boolean, asked boolean"
    REACH, BIAS = {LOCKED: 200, DRIFTING: 2000}, {LOCKED: 5.0, DRIFTING: 2.0}
    FIND, KEEP, LOW, WEAK = 75.0, 65.0, 50.0, 2
    LOST, HOLD, ASK = 30 * SECOND, 10 * SECOND, 300 * SECOND

    def __init__(self, index: LineIndex, scorer: Scorer, horizon: int | None = None):
        self.index, self.scorer, self.horizon = index, scorer, horizon
        self.restore((SEARCHING, None, 0, None, None, False, False))

    def restore(self, state: tuple) -> None:
        self.mode, self.line, self.weak, self.low, self.last, self.held, self.asked = state

    def state(self) -> tuple:
        return self.mode, self.line, self.weak, self.low, self.last, self.held, self.asked

    def _pending(self) -> list[tuple[int, str]]:
        if self.last is None:
            return []
        out = []
        # A reader who pauses is not lost.
        if self.mode == DRIFTING and self.low is not None and self.low + self.LOST <= self.last + self.HOLD:
            out.append((self.low + self.LOST, "search"))
        if not self.held:
            out.append((self.last + self.HOLD, "hold"))
        if not self.asked:
            out.append((self.last + self.ASK, "ask"))
        return sorted(out)

    def due(self) -> list[int]:
        return [us for us, _ in self._pending()]

    def fire(self, key, now: int) -> list[tuple]:
        out = []
        while (pending := self._pending()) and pending[0][0] <= now:
            us, event = pending[0]
            if event == "search":
                self._search()
            self.held, self.asked = self.held or event == "hold", self.asked or event == "ask"
            out.append((key, us, None, event, self.mode, self.line, None, self.held, self.asked))
        return out

    def _search(self) -> None:
        self.mode, self.line, self.weak, self.low = SEARCHING, None, 0, None

    def _best(self, text: str, hit_line, hit_text) -> tuple[int | None, float]:
        if self.mode == SEARCHING:
            return (None, 0.0) if hit_line is None else (hit_line, float(self.scorer(text, [hit_text])[0]))
        reach, bias = self.REACH[self.mode], self.BIAS[self.mode]
        orders, _, lines = self.index.between(self.line - reach, self.line + reach)
        if not len(orders):
            return None, 0.0
        scores = self.scorer(text, lines)
        worth = scores + bias * (1.0 - np.abs(orders - self.line) / reach)
        best = np.lexsort((orders, worth))[-1]
        return int(orders[best]), float(scores[best])

    def take(self, key, us, seq, text, hit_line, hit_text) -> list[tuple]:
        if self.last is not None and us < self.last:
            return [(key, us, seq, "stale", self.mode, self.line, None, self.held, self.asked)]
        out = self.fire(key, us)
        line, score = self._best(text or "", hit_line, hit_text)
        if score >= (self.FIND if self.mode == SEARCHING else self.KEEP):
            self.mode, self.line, self.weak, self.low = LOCKED, line, 0, None
        else:
            self.low = None if score >= self.LOW else us if self.low is None else self.low
            self.weak += self.mode == LOCKED
            if self.weak >= self.WEAK:
                self.mode, self.weak = DRIFTING, 0
            elif self.mode == DRIFTING and self.low is not None and us - self.low >= self.LOST:
                self._search()
        out.append((key, us, seq, "utterance", self.mode, self.line, score, self.held, self.asked))
        self.last, self.held, self.asked = us, False, False
        return out

    def end(self, key) -> list[tuple]:
        return [] if self.horizon is None else self.fire(key, self.horizon)


class PassageCascade:
    """The passage of a session by three tiers: its present passage, those it has seen, and the best of
    all lines, which comes with the utterance.  The first two are searched here and accepted from 60 on,
    or from 40 on with a lead of 1.8 over the runner-up; the third from 45 on.  A text of under six
    characters is only taken from the present passage, from 85 on.  Interjections and stale utterances
    change nothing."""

    TIMED = False
    STATE = "passage long, lo long, hi long, seq long"
    ROWS = "session_id long, us long, seq long, outcome string, passage long, line long, score double"
    SHORT, SURE, ANY = 6, 85.0, 45.0

    def __init__(self, index: LineIndex, scorer: Scorer, seen: MutableMapping[int, tuple[int, int]] | None = None):
        self.index, self.scorer, self.seen = index, scorer, {} if seen is None else seen
        self.restore((None, None, None, -1))

    def restore(self, state: tuple) -> None:
        self.passage, self.lo, self.hi, self.seq = state

    def state(self) -> tuple:
        return self.passage, self.lo, self.hi, self.seq

    def due(self) -> list[int]:
        return []

    def fire(self, key, now: int) -> list[tuple]:
        return []

    def end(self, key) -> list[tuple]:
        return []

    def _best(self, text: str, scopes: list[tuple[int, tuple[int, int]]]) -> tuple[float, float, int, int, tuple[int, int]] | None:
        """Score, runner-up's score, line and passage of the best line, ties to the later line."""
        found = []
        for n, (passage, (lo, hi)) in enumerate(scopes):
            orders, passages, lines = self.index.between(lo, hi)
            own = passages == passage
            found.append((self.scorer(text, lines)[own], orders[own], np.full(int(own.sum()), n)))
        scores, orders, of = map(np.concatenate, zip(*found, strict=True))
        if not len(scores):
            return None
        rank = np.lexsort((orders, scores))
        top = rank[-1]
        return float(scores[top]), float(scores[rank[-2]]) if len(rank) > 1 else 0.0, int(orders[top]), *scopes[of[top]]

    def _decide(self, text: str, hit) -> tuple[str, float, int, int, tuple[int, int]] | None:
        short = len(text) < self.SHORT
        if self.passage is not None and (top := self._best(text, [(self.passage, (self.lo, self.hi))])):
            score, second, line, passage, cover = top
            if score >= self.SURE if short else self._accepted(score, second):
                return "tier 1", score, line, passage, cover
        if short:
            return None
        others = [(p, c) for p, c in self.seen.items() if p != self.passage]
        if others and (top := self._best(text, others)) and self._accepted(*top[:2]):
            return "tier 2", top[0], *top[2:]
        line, passage, hit_text, lo, hi = hit
        if line is not None and (score := float(self.scorer(text, [hit_text])[0])) >= self.ANY:
            return "tier 3", score, line, passage, (lo, hi)
        return None

    @staticmethod
    def _accepted(score: float, second: float) -> bool:
        return score >= ACCEPT or score >= STRONG and (second == 0 or score >= LEAD * second)

    def take(self, key, us, seq, text, interjection, hit_line, hit_passage, hit_text, hit_lo, hit_hi) -> list[tuple]:
        if interjection or seq < self.seq:
            return [(key, us, seq, "interjection" if interjection else "stale", self.passage, None, None)]
        found = self._decide(text or "", (hit_line, hit_passage, hit_text, hit_lo, hit_hi))
        if found is None:
            return [(key, us, seq, "none", self.passage, None, None)]
        outcome, score, line, self.passage, (self.lo, self.hi) = found
        self.seq = seq
        self.seen[self.passage] = self.lo, self.hi
        return [(key, us, seq, outcome, self.passage, line, score)]


class Utterances:
    """Stretches of speech in frames of ``frame_s`` seconds.  The last ``before_s`` seconds before the first
    voiced frame belong to it.  An utterance ends by silence once enough voiced time has come together,
    by its length, or when no frame comes for ``gap_s``; one without enough voiced time is then dropped."""

    TIMED = True
    STATE = "since long, last long, voiced long, silent long, total long"
    ROWS = "session_id long, since long, until long, voiced long, reason string"

    def __init__(
        self, level: float, frame_s: float, silence_s: float, speech_s: float, longest_s: float, before_s: float, gap_s: float, horizon: int | None = None
    ):
        self.level, self.horizon = level, horizon
        self.frame, self.silence, self.speech = (int(x * SECOND) for x in (frame_s, silence_s, speech_s))
        self.longest, self.before, self.gap = (int(x * SECOND) for x in (longest_s, before_s, gap_s))
        self.ring: list[int] = []
        self.restore((None, None, 0, 0, 0))

    def restore(self, state: tuple) -> None:
        self.since, self.last, self.voiced, self.silent, self.total = state

    def state(self) -> tuple:
        return self.since, self.last, self.voiced, self.silent, self.total

    def due(self) -> list[int]:
        return [] if self.since is None else [self.last + self.gap]

    def _close(self, key, until: int, reason: str) -> list[tuple]:
        out = [(key, self.since, until, self.voiced, reason)] if self.voiced >= self.speech else []
        self.restore((None, self.last, 0, 0, 0))
        return out

    def fire(self, key, now: int) -> list[tuple]:
        return self._close(key, self.last + self.frame, "gap") if self.since is not None and self.last + self.gap <= now else []

    def take(self, key, us, prob) -> list[tuple]:
        if self.last is not None and us < self.last:
            return []
        out, active = self.fire(key, us), prob is not None and prob >= self.level
        self.last = us
        if self.since is None:
            self.ring = [x for x in self.ring if x >= us + self.frame - self.before] + [us]
            if active:
                self.restore((self.ring[0], us, self.frame, 0, self.frame))
                self.ring = []
            return out
        self.total += self.frame
        self.voiced, self.silent = (self.voiced + self.frame, 0) if active else (self.voiced, self.silent + self.frame)
        quiet = self.silent >= self.silence and self.voiced >= self.speech
        if quiet or self.total >= self.longest:
            # By its length an utterance ends whatever has been voiced.
            out.append((key, self.since, us + self.frame, self.voiced, "silence" if quiet else "length"))
            self.restore((None, us, 0, 0, 0))
        return out

    def end(self, key) -> list[tuple]:
        return [] if self.horizon is None else self.fire(key, self.horizon)


def _values(column: pd.Series) -> list:
    """The values of a column, None where one is missing or ``UNSET``."""
    gone = (column.to_numpy() == UNSET) if column.dtype.kind == "i" else column.isna().to_numpy()
    values = column.tolist()
    return [None if g else v for g, v in zip(gone.tolist(), values, strict=True)] if gone.any() else values


class _Live(StatefulProcessor):
    """Runs a machine for each session of a group: a call takes all rows that a batch has of the group, as
    it costs far more than a row.  A session's state is an entry of a map, read once and written once.  The
    first moment that is due in each session is in one value, and the group has one timer, at the least of
    them: when it comes, all sessions that are due up to the watermark fire."""

    #: State that a machine has besides its own.
    MORE = ""

    def __init__(self, make: Callable[[], object], columns: list[str], order: list[str]):
        self.make, self.columns, self.order = make, columns, order
        self.names, self.timed = [c.split()[0] for c in make().ROWS.split(", ")], make().TIMED

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.entries = handle, handle.getMapState("sessions", "session long", self.make().STATE + self.MORE)
        if self.timed:
            self.value = handle.getValueState("due", "timer long, sessions array<long>, moments array<long>")

    def load(self, session: int) -> object:
        machine = self.make()
        if (state := self.entries.getValue((session,))) is not None:
            self.restore(machine, tuple(state))
        return machine

    def restore(self, machine, state: tuple) -> None:
        machine.restore(state)

    def save(self, session: int, machine) -> None:
        self.entries.updateValue((session,), self.state(machine))

    def state(self, machine) -> tuple:
        return machine.state()

    def _due(self) -> tuple[int | None, dict[int, int]]:
        """The group's timer, and the first moment of each session that has one."""
        known = self.value.get() if self.timed else None
        return (None, {}) if known is None else (known[0], dict(zip(known[1], known[2], strict=True)))

    @staticmethod
    def _note(due: dict[int, int], session: int, machine) -> None:
        if moments := machine.due():
            due[session] = min(moments)
        else:
            due.pop(session, None)

    def _set_timer(self, old: int | None, due: dict[int, int], expired: bool = False) -> None:
        at = -(-min(due.values()) // 1000) if due else None
        if at != old:
            if old is not None and not expired:  # one that has expired goes by itself
                self.handle.deleteTimer(old)
            if at is not None:
                self.handle.registerTimer(at)
        self.value.update((at, list(due), list(due.values())))

    def _frame(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in zip(self.names, zip(*rows, strict=True), strict=True)})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = list(rows)
        events = parts[0] if len(parts) == 1 else pd.concat(parts)
        sessions = events[self.columns[0]].to_numpy()
        events = events.iloc[np.lexsort([*(events[c].to_numpy() for c in reversed(self.order)), sessions])]
        timer, due = self._due()
        before, out = dict(due), []
        taken = zip(events[self.columns[0]].tolist(), zip(*(_values(events[c]) for c in self.columns), strict=True), strict=True)
        for session, own in groupby(taken, itemgetter(0)):
            machine = self.load(session)
            for _, row in own:
                out += machine.take(*row)
            self.save(session, machine)
            self._note(due, session, machine)
        if due != before:
            self._set_timer(timer, due)
        yield from self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000
        timer, due = self._due()
        out = []
        for session in [s for s, us in due.items() if us <= now]:
            machine = self.load(session)
            out += machine.fire(None if session == UNSET else session, now)
            self.save(session, machine)
            self._note(due, session, machine)
        self._set_timer(timer, due, expired=True)
        yield from self._frame(out)

    def close(self) -> None:
        pass


class _Seen(dict):
    """The passages that a session has seen.  A map state holds them; it is read once in a batch, when
    the second tier first asks, and what is new is written at the end of the batch."""

    def __init__(self, state):
        super().__init__()
        self.known, self.read, self.new = state, False, {}

    def __setitem__(self, passage: int, cover: tuple[int, int]) -> None:
        if self.get(passage) != cover:
            self.new[passage] = cover
        super().__setitem__(passage, cover)

    def items(self):
        if not self.read:
            self.read = True
            for k, v in self.known.iterator():
                self.setdefault(k[0], tuple(v))
        return super().items()

    def flush(self) -> None:
        for passage, cover in self.new.items():
            self.known.updateValue((passage,), cover)


class _Passages:
    """The passages that one session has seen, as a map: they are an entry of its group's map."""

    def __init__(self, entries, session: int):
        self.entries, self.session, self.known, self.new = entries, (session,), None, {}

    def iterator(self) -> Iterator[tuple[tuple, tuple]]:
        if self.known is None:
            entry = self.entries.getValue(self.session)
            self.known = {} if entry is None else {(p,): (lo, hi) for p, lo, hi in zip(*entry, strict=True)}
        return iter(self.known.items())

    def updateValue(self, passage: tuple, cover: tuple[int, int]) -> None:
        self.new[passage] = cover

    def flush(self) -> None:
        if self.new:
            seen = dict(self.iterator()) | self.new
            self.entries.updateValue(self.session, ([p for (p,) in seen], *map(list, zip(*seen.values(), strict=True))))


class _CascadeLive(_Live):
    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.seen = handle.getMapState("seen", "session long", "passages array<long>, los array<long>, his array<long>")

    def load(self, session: int) -> object:
        machine = super().load(session)
        machine.seen = _Seen(_Passages(self.seen, session))
        return machine

    def save(self, session: int, machine) -> None:
        super().save(session, machine)
        machine.seen.flush()
        machine.seen.known.flush()


class _UtterancesLive(_Live):
    MORE = ", ring array<long>"

    def restore(self, machine, state: tuple) -> None:
        machine.restore(state[:-1])
        machine.ring = list(state[-1] or ())

    def state(self, machine) -> tuple:
        return *machine.state(), machine.ring


class _Limits(StatefulProcessor):
    """Accepted hits of the keys of a group, each key's in an entry of a map that Spark itself forgets after
    the window (TTL): a key that is idle for so long has no state left.  A call takes all keys of a group
    that a batch has, as it costs far more than a hit; a key's entry is read once and written if it changed."""

    def __init__(self, limit: int, window_s: float):
        self.limit, self.window_s = limit, window_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getMapState("recent", "key long", "hits array<long>", ttlDurationMs=int(self.window_s * 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        hits = pd.concat(list(rows)).sort_values(["key", "us", "id"])
        out = []
        for of, group in groupby(zip(*(hits[c].tolist() for c in ("key", "us", "id")), strict=True), itemgetter(0)):
            machine, known = Limiter(self.limit, self.window_s), self.recent.getValue((of,))
            machine.recent.extend(before := sorted(known[0]) if known else [])
            name = None if of == UNSET else of
            for _, us, id_ in group:
                out += machine.take(name, int(us), None if id_ == UNSET else id_)
            if (now := list(machine.recent)) != before:
                self.recent.updateValue((of,), (now,))
        names = ("key", "us", "id", "allowed", "remaining", "reset")
        yield pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in zip(names, zip(*out, strict=True), strict=True)})

    def close(self) -> None:
        pass


POSITION = ["session_id", "us", "seq", "text", "hit_line", "hit_text"]
CASCADE = ["session_id", "us", "seq", "text", "interjection", "hit_line", "hit_passage", "hit_text", "hit_lo", "hit_hi"]


def horizon(rows: DataFrame, delay_s: float = 0.0) -> int:
    """The last watermark of a stream that reads all of ``rows`` (us): whole milliseconds."""
    return (rows.agg(F.max("us")).first()[0] or 0) // 1000 * 1000 - int(delay_s * SECOND)


def _machine_rows(rows: DataFrame, columns: list[str], make: Callable[[], object], processor: type, order: list[str], delay: str) -> DataFrame:
    schema = make().ROWS
    if not rows.isStreaming:
        return fold(rows.select(*columns), make, order, schema)
    # pandas has no missing whole numbers: they travel as one that no id has.
    kinds = dict(rows.dtypes)
    numbers = [F.coalesce(c, F.lit(UNSET)).alias(c) if kinds[c] == "bigint" else F.col(c) for c in columns]
    timed = rows.select(F.pmod(F.xxhash64("session_id"), F.lit(GROUPS)).alias("group"), F.timestamp_micros("us").alias("at"), *numbers).withWatermark("at", delay)
    return timed.groupBy("group").transformWithStateInPandas(processor(make, columns, order), schema, "append", "EventTime")


def follow_positions(utterances: DataFrame, index: LineIndex, scorer: Scorer, until: int | None = None, delay: str = "0 seconds") -> DataFrame:
    """Position after each utterance (session_id, us, seq, text, hit_line, hit_text), and the moments of
    pauses and of a new search, of a table or of a stream.  ``until`` is the horizon of a table."""
    return _machine_rows(utterances, POSITION, lambda: Position(index, scorer, until), _Live, ["us", "seq"], delay)


def follow_passages(utterances: DataFrame, index: LineIndex, scorer: Scorer, delay: str = "0 seconds") -> DataFrame:
    """Outcome of the cascade for each utterance of a table or of a stream."""
    return _machine_rows(utterances, CASCADE, lambda: PassageCascade(index, scorer), _CascadeLive, ["us", "seq"], delay)


def segment_utterances(frames: DataFrame, until: int | None = None, delay: str = "0 seconds", **rules: float) -> DataFrame:
    """Utterances of frames (session_id, us, prob) of a table or of a stream."""
    known = {"level": 0.3, "frame_s": 0.032, "silence_s": 0.5, "speech_s": 0.25, "longest_s": 7.0, "before_s": 1.0, "gap_s": 1.0} | rules
    return _machine_rows(frames, ["session_id", "us", "prob"], lambda: Utterances(**known, horizon=until), _UtterancesLive, ["us", "prob"], delay)


def limit_rates(hits: DataFrame, limit: int, window_s: float) -> DataFrame:
    """``feedback.rate_limit`` over a stream of hits (key long, us, id).  Rows of a batch are taken in
    order; idle keys lose their state by themselves, in processing time.  Keys are dealt to ``GROUPS``
    groups by a hash; a stream with a checkpoint needs the number it began with."""
    schema = "key long, us long, id long, allowed boolean, remaining long, reset long"
    numbers = [F.coalesce(F.col(c).cast("long"), F.lit(UNSET)).alias(c) for c in ("key", "id")]
    grouped = hits.select(F.pmod(F.xxhash64("key"), F.lit(GROUPS)).alias("group"), "us", *numbers).groupBy("group")
    return grouped.transformWithStateInPandas(_Limits(limit, window_s), schema, "append", "ProcessingTime")
