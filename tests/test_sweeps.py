"""Words in holes by one sweep, golden queries, the latch, and files by their times, against plain loops."""

import os
import random

import pytest
from pyspark.sql import functions as F

from linetrace.operators import align, evaluate
from linetrace.sources import views
from linetrace.streaming import sessions


@pytest.mark.parametrize("sweep", [600, 7])
def test_words_meet_the_hole_they_fall_into(spark, monkeypatch, sweep):
    monkeypatch.setattr(align, "SWEEP", sweep)
    rng = random.Random(sweep)
    holes, words = [], []
    for sample in range(4):
        at = 0.0
        while at < 300:
            at += rng.choice([0.0, 1.5, 4.0])
            end = at + rng.choice([2.5, 3.0, 60.0])
            holes.append((sample, at, end))
            at = end
        words += [(sample, rng.choice([round(rng.uniform(-5, 400), 1), float(rng.randrange(300))]), k) for k in range(500)]
    words += [(99, 1.0, -1)]
    want = sorted((s, m, k, a, b) for s, m, k in words for t, a, b in holes if s == t and a <= m < b)
    got = align.words_in_holes(spark.createDataFrame(holes, "sample_id long, start_sec double, end_sec double"), spark.createDataFrame(words, "sample_id long, mid double, k long"))
    assert sorted(map(tuple, got.select("sample_id", "mid", "k", "start_sec", "end_sec").collect())) == want and want


def test_golden_queries_name_lines_that_must_not_come_near_the_top(spark):
    found = spark.createDataFrame([(1, 10, 90.0, 1), (1, 11, 80.0, 2), (1, 12, 70.0, 3), (1, 13, 60.0, 4), (2, 20, 50.0, 1)], "query_id long, order_id long, score double, rank int")
    gold = spark.createDataFrame([(1, 10, 85.0, 95.0, [13]), (2, 21, 10.0, 30.0, [20]), (3, 1, 0.0, 9.0, []), (4, None, None, None, None)], "query_id long, order_id long, least double, most double, forbidden array<long>")
    got = {r.query_id: (r.line_ok, r.score_ok, r.forbidden_ok) for r in evaluate.gold_compare(found, gold).collect()}
    assert got == {1: (True, True, True), 2: (False, False, False), 3: (False, False, True), 4: (True, False, True)}
    near = gold.withColumn("forbidden", F.array(F.lit(12).cast("long")))
    assert {r.query_id: r.forbidden_ok for r in evaluate.gold_compare(found, near).collect()}[1] is False
    assert "forbidden_ok" not in evaluate.gold_compare(found, gold.drop("forbidden")).columns


def test_the_canonical_text_stays_until_a_pass_drops_it(spark):
    rows = [("a", None, None), (None, "LINE", 95.0), ("b", None, None), ("c", None, None), (None, "OTHER", 80.0), ("d", None, None), (None, "LINE", 90.0), (None, "NEW", 99.0)]
    events = spark.createDataFrame([(1, k, k, *r) for k, r in enumerate(rows)], "session_id long, s long, seq long, text string, matched string, score double").withColumn("ts", F.timestamp_seconds("s"))
    assert [r.shown for r in sessions.self_correct(events).orderBy("seq").collect()] == ["a", "LINE", "LINE", "LINE", "c", "d", "LINE", "NEW"]


def test_files_that_are_missing_broken_or_stale_are_rows_with_a_reason(spark, tmp_path):
    (tmp_path / "align").mkdir()
    (tmp_path / "audio").mkdir()
    (tmp_path / "cache/big").mkdir(parents=True)
    for k, name in enumerate("abcd"):
        (tmp_path / "audio" / f"{name}.wav").write_bytes(b"x")
        os.utime(tmp_path / "audio" / f"{name}.wav", (1000 + k, 1000 + k))
    for name, text, when in (("a", '{"audio_file": "a.wav"}', 2000), ("b", '{"audio_file": ', 2000), ("c", '{"audio_file": "c.wav"}', 500)):
        (tmp_path / "align" / f"{name}.json").write_text(text)
        os.utime(tmp_path / "align" / f"{name}.json", (when, when))
        (tmp_path / "cache/big" / f"{name}.json").write_text("{}")
        os.utime(tmp_path / "cache/big" / f"{name}.json", (when, when))
    samples = spark.createDataFrame([(n, f"{n}.wav", f"alignments/{n}.json") for n in "abcd"] + [("e", "e.wav", None)], "sample_id string, filename string, alignment_file string")
    got = {r.sample_id: r.reason for r in views.alignment_state(spark, samples, f"{tmp_path}/align", f"{tmp_path}/audio").collect()}
    assert got == {"a": "ok", "b": "broken", "c": "stale", "d": "missing", "e": "missing"}
    assert sorted(r["sample"] for r in views.uncached_files(spark, f"{tmp_path}/audio", f"{tmp_path}/cache", "big").collect()) == ["c", "d"]


def test_a_font_takes_the_longest_entry_and_reads_nothing_twice(spark):
    from linetrace.functions.text import legacy_font

    table = {"a": "b", "b": "a", "ab": "X", "abc": "Y", "i": "1", "ie": "E", "k": "K", "h": "+", ".": "never", "(": ")"}
    recode = legacy_font(table, dropped=".;", pairs=("ab", "kh"), prefix="i", halves="h")
    cases = {"ab": "X", "abc": "Y", "bb": "aa", "aab": "bX", "ba": "X", "ik": "K1", "ikh": "K+1", "ie": "E", "ikz": "K1z", "i": "1", "hk": "K+", "a.b": "X", "(\n?": ")\n?", "": "", "izh": "z+1"}
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()] + [(None, None)], "t string, want string")
    assert [(r.t, r.got) for r in rows.select("t", "want", recode(F.col("t")).alias("got")).collect()] == [*cases.items(), (None, None)]
    plain = legacy_font({"q": "k", "k": "q"})
    assert rows.limit(1).select(plain(F.lit("qkq-")).alias("x")).first().x == "kqk-"


def test_a_font_takes_long_stretches_at_once(spark):
    from linetrace.functions.text import legacy_font

    table = {"a": "b", "b": "a", "ab": "X", "th": "d", "z": "zz", "i": "1", "ie": "E", "h": "+"}
    recode = legacy_font(table, prefix="i", halves="h")
    text, want = "kkbabkkz" * 40_000, "kkaXkkzz" * 40_000
    rows = spark.createDataFrame([(text,), ("k" * 300_000,), ("\U0001d11ei",), ("i\U0001d11ez",), ("ziba",)], "t string")
    got = [r.x for r in rows.select(recode(F.col("t")).alias("x")).collect()]
    assert got == [want, "k" * 300_000, "\U0001d11e1", "\U0001d11e1zz", "zza1b"]
    assert "++" in rows.select(recode(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()


def test_an_empty_scope_is_an_error_and_few_rows_a_warning(spark):
    lines = spark.createDataFrame([("src1-a",), ("src2",)], "source string")
    assert views.scoped(lines, "src1").count() == 1
    with pytest.raises(ValueError, match="src9"):
        views.scoped(lines, "src9")
    with pytest.warns(UserWarning, match="2 lines kept, at least 3"):
        views.expect(lines, 3, "lines")
    assert views.expect(lines, 2).count() == 2


def test_another_measure_may_rank_the_pool(spark):
    from linetrace.operators import match

    lines = spark.createDataFrame([(1, 1, "kanal sumer dorin"), (2, 1, "kanal sumer dorin tolep"), (3, 2, "other words here")], "order_id long, passage_id long, norm string")
    q = spark.createDataFrame([("q", "kanal sumer dorin")], "query_id string, query string")
    own = [(r.order_id, r.score) for r in match.fuzzy_topk_join(q, lines, 3, covers=lambda a, b: 1.0 if len(b) > len(a) else 0.5).orderBy("rank").collect()]
    assert own[0] == (2, 100.0) and own[1] == (1, 50.0)
    assert match.fuzzy_topk_join(q, lines, 1).first().order_id == 2  # a tie goes to the later line
