"""Machines with timers: streams against the same rows as a table; late rows, exactly-once appends, erasure."""

import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from linetrace.operators import feedback, lineindex
from linetrace.streaming import live, sinks

S = 1_000_000


def replayed(spark, rows, schema, folder, cuts):
    """Rows as a stream whose batches end at the given places."""
    for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.parquet(f"{folder}/{n}")
        time.sleep(0.02)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(3)
    words = [f"{a}{b}{c}" for a in "kgctdp" for b in "aeiou" for c in ("n", "r", "l", "m")]
    lines = [(p * 1000 + k, p, " ".join(rng.choice(words) for _ in range(7))) for p in range(8) for k in range(40)]
    rows = spark.createDataFrame(lines, "order_id long, passage_id long, norm string")
    return lines, rows, lineindex.index_lines(rows, f"file://{tmp_path_factory.mktemp('index')}/lines")


def test_index_finds_what_lies_between(corpus, monkeypatch):
    lines, rows, index = corpus
    for lo, hi in ((0, 10), (35, 1003), (39, 999), (7039, 9000), (-5, 10**9), (5000, 5000)):
        orders, passages, texts = index.between(lo, hi)
        assert list(zip(orders.tolist(), passages.tolist(), texts, strict=True)) == [x for x in lines if lo <= x[0] <= hi]


def test_a_look_up_reads_only_the_groups_it_meets(spark, tmp_path):
    rows = spark.range(5000).selectExpr("id AS order_id", "id div 10 AS passage_id", "concat('line ', id) AS norm")
    index = lineindex.index_lines(rows, f"file://{tmp_path}/lines")
    lineindex._group.cache_clear()
    orders, passages, texts = index.between(2000, 2030)
    assert orders.tolist() == list(range(2000, 2031)) and passages.tolist() == [k // 10 for k in range(2000, 2031)] and texts[0] == "line 2000"
    read = lineindex._group.cache_info().currsize
    assert 1 <= read <= 2 and all(len(lineindex._block(b[2])[1]) >= (b[1] - b[0] + 1) // lineindex.GROUP for b in index.blocks)


def test_hits_of_frequent_letters(spark, corpus):
    """Short letters by a broadcast, longer ones by a shuffle: the same hits as an equality of keys."""
    lines = [(k, k // 4, text) for k, text in enumerate(["aa ba ca", "ab bb cb", "kan dor", "", "kan dor lim pas", "aa ba ca da", "kul dir len por"])]
    hits = lineindex.first_hits(spark.createDataFrame(lines, "order_id long, passage_id long, norm string"))
    said = [(s, s, s, text) for s, text in enumerate(["ax bx cx", "zz yy", "zz yy", None, "", "kan dor lim pas", "ka du", "zz yy xx ww"] * 3)]
    got = lineindex.with_hit(spark.createDataFrame(said, SAID), hits)
    want = {0: (0, 0, 1, 3), 5: (4, 1, 4, 6), 6: (2, 0, 1, 3)}
    spans = {0: (0, 3), 1: (4, 6)}
    rows = {r.seq: r for r in got.collect()}
    assert len(rows) == len(said)
    for seq, r in rows.items():
        found = want.get(seq % 8)
        assert (r.hit_line, r.hit_passage) == ((found[0], found[1]) if found else (None, None))
        assert (r.hit_lo, r.hit_hi) == (spans[r.hit_passage] if found else (None, None))


def test_passages_seen_are_read_once_a_batch():
    class State:
        asked, put = 0, []

        def iterator(self):
            self.asked += 1
            return iter([((1,), (0, 9)), ((2,), (10, 19))])

        def updateValue(self, key, value):
            self.put.append((key, value))

    state = State()
    seen = live._Seen(state)
    seen[2], seen[3] = (10, 19), (20, 29)
    assert sorted(seen.items()) == [(1, (0, 9)), (2, (10, 19)), (3, (20, 29))] == sorted(seen.items()) and state.asked == 1
    seen.flush()
    assert ((3,), (20, 29)) in state.put


def test_scorers():
    assert lineindex.overlap_scores("a b c", ["a b c", "a b d", "", "x"]).tolist() == [100.0, 200 * 2 / 6, 0.0, 0.0]
    scores = lineindex.ranked_scores("kanal sumer dorin", ["kanal sumer dorin", "kanal sumar dorin x", "nothing alike here"])
    assert scores[0] > scores[1] > scores[2]
    assert lineindex.ranked_scores("", ["a"]).tolist() == [0.0]


def test_scores_of_groups_are_those_of_plain_lines(corpus):
    """Before and after the words of a group are placed, over parts of one group and of several."""
    lines, rows, index = corpus
    rng = random.Random(2)
    for k in range(60):
        lo = rng.choice([0, 20, 1000, 3010, 7020])
        orders, passages, texts = index.between(lo, lo + rng.choice([0, 5, 30, 2500]))
        query = " ".join(rng.sample(rng.choice(lines)[2].split(), 4)) if k % 7 else rng.choice(["", "zzz yyy"])
        assert lineindex.overlap_scores(query, texts).tolist() == lineindex.overlap_scores(query, list(texts)).tolist()
    assert any(texts.met >= texts.PAYS * len(texts) and "places" in vars(texts) for texts, _, _ in index.between(0, 9000)[2].parts)


class Handle:
    """State of one group, counting what is asked of it."""

    def __init__(self):
        self.calls, self.entries, self.kept, self.timers = [], {}, None, set()

    def getMapState(self, name, key, value):
        handle = self

        class Map:
            def getValue(self, key):
                handle.calls.append(("get", name, key))
                return handle.entries.get((name, key))

            def updateValue(self, key, value):
                handle.calls.append(("put", name, key))
                handle.entries[name, key] = value

        return Map()

    def getValueState(self, name, schema):
        handle = self

        class Value:
            def get(self):
                return handle.kept

            def update(self, value):
                handle.kept = value

        return Value()

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class Clock:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms


def test_a_call_takes_the_sessions_of_a_group_and_sets_one_timer(corpus):
    """However many sessions a group has, it has one timer; an entry is read once and written once a call."""
    lines, rows, index = corpus
    handle = Handle()
    runner = live._Live(lambda: live.Position(index, lineindex.overlap_scores), live.POSITION, ["us", "seq"])
    runner.init(handle)
    said = [(s, (s + 10 * k) * S, k, lines[k][2], lines[k][0], lines[k][2]) for s in (3, 1, live.UNSET, 2) for k in (1, 0, 2) if s > 0 or k < 2]
    said = [(s, us if s > 0 else 5 * S + k, k, *rest) for s, us, k, *rest in said]
    frames = [pd.DataFrame(x, columns=live.POSITION) for x in (said[:5], said[5:])]
    out = pd.concat(runner.handleInputRows((0,), iter(frames), Clock(0)))
    want = {s: [] for s in (1, 2, 3, live.UNSET)}
    for s in want:
        machine = live.Position(index, lineindex.overlap_scores)
        for row in sorted(r for r in said if r[0] == s):
            want[s] += machine.take(None if s == live.UNSET else s, *row[1:])
    got = [tuple(None if v is None or v != v else v for v in r) for r in out.itertuples(index=False)]
    assert sorted(got, key=str) == sorted(sum(want.values(), []), key=str)
    assert sorted(handle.calls) == sorted((c, "sessions", (s,)) for s in want for c in ("get", "put"))
    assert handle.timers == {15_001}  # the unnamed session's pause comes first
    handle.timers.clear()  # it has expired
    fired = pd.concat(runner.handleExpiredTimer((0,), Clock(31_500), Clock(15_001)))
    assert sorted(map(str, fired.session_id)) == ["1", "None"] and set(fired.event) == {"hold"} and handle.timers == {32_000}
    handle.timers.clear()
    assert len(pd.concat(runner.handleExpiredTimer((0,), Clock(10**9), Clock(32_000)))) == 6 and not handle.timers


def told(rng, lines, n=60):
    """Utterances of readers: lines in order, some garbled, with pauses."""
    rows = []
    for session in range(5):
        us, at = session * 7 * S, rng.randrange(200)
        for seq in range(n):
            us += rng.choice([4, 4, 4, 4, 5, 12, 40, 400]) * S + rng.randrange(999) * 1000 + 137
            text = lines[at % len(lines)][2].split()
            kind = rng.choice("eeeeeddg") if not 20 <= seq < 34 else "g"
            text = text if kind == "e" else text[::2] if kind == "d" else ["zzz", "yyy"]
            rows.append((session, us, seq, " ".join(text)))
            at += 1 if rng.random() < 0.95 else 77
    return sorted(rows, key=lambda r: (r[1], r[2]))


SAID = "session_id long, us long, seq long, text string"


def test_positions_of_a_stream_are_those_of_the_table(spark, corpus, tmp_path):
    lines, rows, index = corpus
    said = told(random.Random(5), lines)
    table = lineindex.with_first_hit(spark.createDataFrame(said, SAID), rows)
    until = live.horizon(table)
    want = sorted(map(tuple, live.follow_positions(table, index, lineindex.overlap_scores, until).collect()), key=str)
    events, modes = {r[3] for r in want}, {r[4] for r in want}
    assert events == {"utterance", "hold", "ask", "search"} and modes == {"SEARCHING", "LOCKED", "DRIFTING"}
    stream = lineindex.with_first_hit(replayed(spark, said, SAID, f"{tmp_path}/in", [70, 71, 200]), rows)
    got, _ = sinks.run_to_end(live.follow_positions(stream, index, lineindex.overlap_scores), f"file://{tmp_path}/out")
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_position_rules():
    class Index:
        def between(self, lo, hi):
            at = [k for k in (10, 100, 1500) if lo <= k <= hi]
            return np.array(at), np.array(at), [f"line {k}" for k in at]

    m = live.Position(Index(), lineindex.overlap_scores, None)
    step = lambda s, text, hit=None: m.take(1, int(s * S), int(s), text, hit, f"line {hit}" if hit else None)[-1][3:7]
    assert step(1, "line 7", 10) == ("utterance", "SEARCHING", None, 50.0)
    assert step(2, "line 10", 10) == ("utterance", "LOCKED", 10, 100.0)
    assert step(3, "line 1500", 1500)[1:3] == ("LOCKED", 10)  # too far for LOCKED: a weak one
    assert step(4, "line 1500", 1500)[1:3] == ("DRIFTING", 10)
    assert step(5, "line 1500", 1500)[1:3] == ("LOCKED", 1500)
    for k in range(6, 9):
        assert step(k, "zzz")[1] == ("LOCKED" if k == 6 else "DRIFTING")
    for k in (16, 24, 32):
        step(k, "zzz")
    assert [r[3] for r in m.take(1, 39 * S, 39, "zzz", None, None)] == ["search", "utterance"]
    m.take(1, 40 * S, 40, "line 10", 10, "line 10")
    assert m.mode == "LOCKED" and [r[3] for r in m.fire(1, 1000 * S)] == ["hold", "ask"]
    assert m.mode == "LOCKED" and m.fire(1, 2000 * S) == []
    assert m.take(1, 39 * S, 41, "line 10", 10, "line 10")[0][3] == "stale"


def test_passages_of_a_stream_are_those_of_the_table(spark, corpus, tmp_path):
    lines, rows, index = corpus
    rng = random.Random(9)
    said = [(s, us, seq if rng.random() > 0.05 else seq - 3, text if rng.random() > 0.1 else text[:4], rng.random() < 0.05) for s, us, seq, text in told(rng, lines)]
    schema = f"{SAID}, interjection boolean"
    table = lineindex.with_first_hit(spark.createDataFrame(said, schema), rows)
    want = sorted(map(tuple, live.follow_passages(table, index, lineindex.overlap_scores).collect()), key=str)
    assert {"tier 1", "tier 2", "tier 3", "none", "stale", "interjection"} == {r[3] for r in want}
    stream = lineindex.with_first_hit(replayed(spark, said, schema, f"{tmp_path}/in", [100, 180]), rows)
    got, _ = sinks.run_to_end(live.follow_passages(stream, index, lineindex.overlap_scores), f"file://{tmp_path}/out")
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_cascade_needs_a_lead():
    class Index:
        def between(self, lo, hi):
            return np.array([1, 2]), np.array([7, 7]), ["a b c d e f", "a b x y z w"]

    m = live.PassageCascade(Index(), lambda q, lines: np.array([50.0, 30.0][: len(lines)]))
    m.passage, m.lo, m.hi = 7, 1, 2
    assert m.take(1, 0, 0, "a b c q r s", False, None, None, None, None, None)[0][3] == "none"
    m.scorer = lambda q, lines: np.array([50.0, 20.0])
    assert m.take(1, 0, 0, "a b c q r s", False, None, None, None, None, None)[0][3] == "tier 1"
    assert m.take(1, 0, 1, "a b", False, None, None, None, None, None)[0][3] == "none"
    m.scorer = lambda q, lines: np.array([90.0, 20.0])
    assert m.take(1, 0, 1, "a b", False, None, None, None, None, None)[0][3] == "tier 1"


def test_utterances_of_a_stream_are_those_of_the_table(spark, tmp_path):
    rng, frames = random.Random(1), []
    for session in range(4):
        us = session * 1000
        while us < 90 * S:
            loud = rng.random() < 0.5
            for _ in range(rng.choice([2, 5, 12, 40, 90])):
                frames.append((session, us, 0.9 if loud and rng.random() < 0.9 else 0.05))
                us += 100_000
            us += rng.choice([0, 0, 0, 1500_000, 5 * S])
    frames.sort(key=lambda r: r[1])
    schema = "session_id long, us long, prob double"
    table = spark.createDataFrame(frames, schema)
    rules = {"frame_s": 0.1}
    want = sorted(map(tuple, live.segment_utterances(table, live.horizon(table), **rules).collect()))
    assert {r[4] for r in want} == {"silence", "length", "gap"}
    stream = replayed(spark, frames, schema, f"{tmp_path}/in", [500, 501, 1200])
    got, _ = sinks.run_to_end(live.segment_utterances(stream, **rules), f"file://{tmp_path}/out")
    assert sorted(map(tuple, got.collect())) == want


def test_an_utterance_has_what_was_before_it():
    m = live.Utterances(0.3, 0.1, 0.5, 0.25, 7.0, 1.0, 1.0)
    out = []
    for k in range(60):
        out += m.take(1, k * 100_000, 0.9 if 20 <= k < 24 else 0.0)
    # Ten frames before it with its own first one, four voiced, five silent ones.
    assert out == [(1, 1_100_000, 2_900_000, 400_000, "silence")]
    assert m.take(1, 10 * S, 0.9) == [] and m.fire(1, 12 * S) == [] and m.since is None  # a blip is dropped
    assert m.take(1, 13 * S, 0.9) == [] and m.take(1, 13_100_000, 0.9) == [] and m.take(1, 13_200_000, 0.9) == []
    assert m.due() == [14_200_000] and m.fire(1, 14_200_000) == [(1, 13 * S, 13_300_000, 300_000, "gap")]


def test_limits_of_a_stream_and_idle_keys(spark, tmp_path):
    rng = random.Random(6)
    hits = sorted((rng.randrange(6), rng.randrange(400) * S, k) for k in range(400))
    hits.sort(key=lambda r: (r[1], r[2]))
    schema = "key long, us long, id long"
    table = spark.createDataFrame(hits, schema).withColumn("ts", F.timestamp_micros("us"))
    want = {(r.key, r.id, r.allowed, r.remaining) for r in feedback.rate_limit(table, 3, 60).collect()}
    stream = replayed(spark, hits, schema, f"{tmp_path}/in", [150, 300])
    got, _ = sinks.run_to_end(live.limit_rates(stream, 3, 60), f"file://{tmp_path}/out", timers=False)
    assert {(r.key, r.id, r.allowed, r.remaining) for r in got.collect()} == want
    # A key that is idle for the window has no state any more.
    place, out = f"{tmp_path}/idle", f"file://{tmp_path}/idle-out"

    def run(rows, n):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{place}/{n}")
        source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(place)
        return sinks.run_to_end(live.limit_rates(source, 3, 1), out, timers=False)[1]

    many = run([(k, 0, k) for k in range(50)], 0)
    time.sleep(2.5)
    assert many >= 50 and run([(1000, 5 * S, 1000)], 1) < many / 2


def test_limits_take_the_keys_of_a_group_in_one_call():
    """An entry is read once and written only if it changed, however many hits its key has."""

    class State(dict):
        read, written = 0, 0

        def getValue(self, key):
            self.read += 1
            return self.get(key)

        def updateValue(self, key, value):
            self.written += 1
            self[key] = value

    limits = live._Limits(2, 10)
    limits.recent = state = State({(7,): ([90 * S, 95 * S],), (8,): ([1 * S],)})
    rows = [(7, 99 * S, 5), (8, 99 * S, 2), (9, 99 * S, 3), (live.UNSET, 99 * S, live.UNSET), (9, 98 * S, 4), (9, 97 * S, 1)]
    parts = [pd.DataFrame(part, columns=["key", "us", "id"]) for part in (rows[:4], rows[4:])]
    (out,) = limits.handleInputRows((0,), iter(parts), None)
    got = {(r.key, r.id): (r.allowed, r.remaining, r.reset // S) for r in out.itertuples()}
    assert got == {(None, None): (True, 1, 109), (7, 5): (False, 0, 100), (8, 2): (True, 1, 109), (9, 1): (True, 1, 107), (9, 4): (True, 0, 107), (9, 3): (False, 0, 107)}
    assert (state.read, state.written) == (4, 3) and state[9,] == ([97 * S, 98 * S],)


def test_limits_of_a_stream_with_unnamed_keys_and_hits(spark, tmp_path):
    rng, big = random.Random(8), (1 << 60) + 1
    hits = [(rng.choice([None, 1, 2, big, big + 1]), k * 7 * S, None if k % 11 == 0 else big + k) for k in range(200)]
    schema = "key long, us long, id long"
    table = spark.createDataFrame(hits, schema).withColumn("ts", F.timestamp_micros("us"))
    want = feedback.rate_limit(table, 3, 60).select("key", F.unix_micros("ts"), "id", "allowed", "remaining", F.unix_micros("reset")).collect()
    got, _ = sinks.run_to_end(live.limit_rates(replayed(spark, hits, schema, f"{tmp_path}/in", [60, 61]), 3, 60), f"file://{tmp_path}/out", timers=False)
    assert len(want) == len(hits) and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want), key=str)


def test_late_rows_go_to_their_own_part(spark, tmp_path):
    schema = "id long, ts timestamp"
    at = lambda s: 1_700_000_000 + s
    rows = [(k, at(k)) for k in range(0, 100)] + [(1000, at(50)), (1001, at(95))] + [(k, at(k)) for k in range(100, 200)] + [(1002, at(10)), (1003, at(199)), (1004, None)]
    rows = [(i, None if s is None else time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime(s))) for i, s in rows]
    for n, (a, b) in enumerate(((0, 100), (100, 202), (202, 205))):
        spark.createDataFrame(rows[a:b], "id long, ts string").selectExpr("id", "cast(ts as timestamp) as ts").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        time.sleep(0.02)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    table = sinks.route_late(source, f"file://{tmp_path}/routed", "ts", 10)
    assert sorted(r.id for r in table.read("late").collect()) == [1000, 1002]
    assert table.read("clean").count() == 203
    assert not table.append("000000000", {"clean": table.read("clean")}) and table.read("clean").count() == 203


def test_a_batch_that_runs_again_adds_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    table, rows = sinks.CommittedTable(spark, path), spark.range(10).withColumnRenamed("id", "k")
    assert table.read("rows", "k long").count() == 0
    assert table.append("b1", {"rows": rows})
    assert not table.append("b1", {"rows": rows})
    # An attempt that wrote its files but not its commit.
    rows.write.parquet(f"{path}/rows/batch-b2")
    assert table.read("rows").count() == 10
    assert table.append("b2", {"rows": rows}) and table.read("rows").count() == 20


def test_erasure_rewrites_only_the_files_that_hold_a_key(spark, tmp_path):
    table = sinks.CommittedTable(spark, f"file://{tmp_path}/erased")
    rows = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 10).alias("owner"))
    table.append("b", {"rows": rows.repartitionByRange(5, "k")})
    keys = spark.createDataFrame([(33,), (34,), (5000,)], "k long")
    before = set(table.files("rows"))

    def fails(_):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        table.erase("rows", lambda r: r.join(keys, "k", "left_semi"), fails)
    assert set(table.files("rows")) == before and table.read("rows").count() == 100
    assert table.erase("rows", lambda r: r.join(keys, "k", "left_semi"), lambda r: r.join(keys, "k", "left_anti")) == 1
    after = set(table.files("rows"))
    assert len(before - after) == 1 and {r.k for r in table.read("rows").collect()} == set(range(100)) - {33, 34}
    assert table.erase("rows", lambda r: r.join(keys, "k", "left_semi"), lambda r: r.join(keys, "k", "left_anti")) == 0
