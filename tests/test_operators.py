"""Brute-force twins and stated cases of the library's own operators."""

import hashlib
import hmac
import random

import numpy as np
from pyspark.sql import functions as F

from linetrace.functions import scoring
from linetrace.functions import text as T
from linetrace.operators import align, dataset, evaluate, feedback, match, registry
from linetrace.sources import views
from linetrace.streaming import machines, sessions


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def partial(a, b):
    a, b = sorted((a, b), key=len)
    return max(100 * lcs(a, b[i : i + len(a)]) / len(a) for i in range(len(b) - len(a) + 1)) if a else 0.0


def test_scores_against_plain_dynamic_programming(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abc dé") for _ in range(n))
    for _ in range(60):
        q, rows = word(rng.choice([0, 5, 40, 130])), [word(rng.choice([0, 3, 50, 140])) for _ in range(4)]
        assert all(abs(x - partial(q, r)) < 1e-9 for x, r in zip(scoring.partial_ratios(q, rows), rows, strict=True))
    pairs = [(word(rng.randrange(30)), word(rng.randrange(30))) for _ in range(50)] + [("", "")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", scoring.indel_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert all(abs(r.r - (200 * lcs(r.a, r.b) / (len(r.a) + len(r.b)) if r.a or r.b else 100)) < 1e-9 for r in got)


def test_search_against_brute_force(spark):
    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choice("abcde") for _ in range(rng.randrange(1, 6))) for _ in range(n))
    lines = [(k, k // 10, text(8)) for k in range(150)]
    queries = [("q0", lines[7][2]), ("q1", text(5)), ("q2", "ab")]
    df = spark.createDataFrame(lines, "order_id long, passage_id long, norm string")
    got = match.fuzzy_topk_join(spark.createDataFrame(queries, "query_id string, query string"), df, 3, pool=20).collect()
    for name, q in queries:
        pool = sorted(((partial(q, t), -o, t) for o, _, t in lines), reverse=True)[:20]
        best = sorted(((p * match.coverage(q, t), p, match.coverage(q, t), -o) for p, o, t in pool), reverse=True)[:3]
        assert [r.order_id for r in sorted((r for r in got if r.query_id == name), key=lambda r: r.rank)] == [b[3] for b in best]
    assert next(r for r in got if r.query_id == "q0" and r.rank == 1).order_id == 7


def test_text_cases(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert [value(T.vowel_only(F.lit(w))) for w in ("aa", "aaaa", "ee", "naam", "har", "aya")] == [True, True, True, False, False, False]
    assert value(T.strip_final_schwa(F.lit("nanaka dhana maya sa"))) == "nanak dhan maya sa"
    assert value(T.is_repetition_loop(F.lit("abababababab"))) and not value(T.is_repetition_loop(F.lit("hello world again")))
    # Only a head that repeats the last twenty characters as a whole is dropped.
    assert value(T.overlap_append(F.array(F.lit("one two three four five"), F.lit("two three four five six")))) == "one two three four five two three four five six"
    assert value(T.overlap_append(F.array(F.lit("one two three four five"), F.lit(" two three four five six")))) == "one two three four five six"
    assert value(T.detect_interjection(F.lit(T.SEEDS[2]))) == T.SEEDS[2]
    assert value(T.pseudonymize(F.lit("token"), "a secret of enough length")) == hmac.new(b"a secret of enough length", b"token", hashlib.sha256).hexdigest()
    assert value(T.confidence_label(F.lit(96.0), F.lit(95.0))) == "likely"
    assert value(T.sanitize_transcript(F.lit("Transcript: hello"))) == "hello"


def test_spans(spark):
    rows = [("s", 1, 0.0, 3.0, 626, 19, 90.0, 0.9, "a"), ("s", 2, 3.0, 6.0, 626, 19, 90.0, 0.9, "b"), ("s", 3, 6.0, 9.0, 626, 20, 90.0, 0.9, "c"), ("s", 4, 20.0, 23.0, 626, 19, 90.0, 0.9, "d")]
    hyp = spark.createDataFrame(rows, "sample_id string, seq long, start_sec double, end_sec double, page long, line_no long, confidence double, coverage double, text string")
    spans = align.detect_repeats(align.merge_windows(hyp)).orderBy("idx").collect()
    assert [(s.end_sec, s.line_no) for s in spans] == [(6.0, 19), (9.0, 20), (23.0, 19)]
    assert spans[0].repeat_group == spans[2].repeat_group == "rg_626_19_0" and spans[1].repeat_group is None
    words = spark.createDataFrame([("s", 12.0, 12.4, "aaaa")], "sample_id string, start_sec double, end_sec double, word string")
    ends = spark.createDataFrame([("s", 30.0)], "sample_id string, duration_sec double")
    gaps = align.detect_gaps(align.merge_windows(hyp), words, ends).orderBy("start_sec").collect()
    assert [(g.start_sec, g.end_sec, g.kind) for g in gaps] == [(9.0, 20.0, "vocalise"), (23.0, 30.0, "silence")]


def test_limits_and_positions(spark):
    hits = spark.sql("SELECT 'k' AS key, timestamp_seconds(id * 10) AS ts, id FROM range(8)")
    assert [r.allowed for r in feedback.rate_limit(hits, 2, 30).orderBy("id").collect()] == [True, True, False, False, True, True, False, False]
    f = machines.Follower()
    assert [f.act(int(t * 1e6), *x) for t, *x in ((0.0, 1, 5, 1, 90.0), (1.0, 2, 6, 1, 80.0), (1.5, 1, 6, 1, 99.0), (1.6, 3, 6, 1, 95.0), (9.0, 4, 5, 2, 50.0))] == ["first", "held", "swap", "highlight", "swap"]
    first = feedback.rate_limit(hits, 2, 30).filter("id = 0").first()
    assert first.remaining == 1 and (first.reset - first.ts).total_seconds() == 30


def test_draws_follow_weights(spark):
    rows = spark.range(2000).select("id", F.when(F.col("id") < 1000, 3.0).otherwise(1.0).alias("w"))
    drawn = dataset.weighted_sample(rows, "w", 4000)
    n = {r.heavy: r["count"] for r in drawn.groupBy((F.col("id") < 1000).alias("heavy")).count().collect()}
    assert sum(n.values()) == 4000 and 2850 < n[True] < 3150
    again = dataset.weighted_sample(rows.repartition(7), "w", 4000)
    assert sorted(drawn.collect()) == sorted(again.collect())
    assert dataset.weighted_sample(rows.limit(0), "w", 5).count() == 0 and dataset.weighted_sample(rows.withColumn("w", F.lit(0.0)), "w", 5).count() == 0


def test_rare_strata_are_drawn_as_often_as_asked(spark):
    rows = spark.createDataFrame([(i, "rare" if i < 2 else "common") for i in range(402)], "id long, source string")
    got = dataset.weighted_sample(dataset.stratum_weights(rows, "source"), "weight", 1000).groupBy("source", "id").count().collect()
    assert sum(r["count"] for r in got) == 1000
    assert all(180 <= r["count"] <= 320 for r in got if r.source == "rare") and len([r for r in got if r.source == "rare"]) == 2


def test_error_rates_of_many_words(spark):
    words = [f"w{i}" for i in range(600)]
    wrong = [*words[256:], *words[:256]]
    pairs = spark.createDataFrame([(" ".join(words), " ".join(["x", *words[1:300], words[44], *words[301:]])), (" ".join(words), " ".join(wrong))], "reference string, hypothesis string")
    assert abs(evaluate.error_rates(pairs.limit(1)).first().wer - 2 / 600) < 1e-12
    assert abs(evaluate.error_rates(pairs).first().wer - (2 + 512) / 1200) < 1e-12


def test_shown_text_is_frozen_and_transcripts_join(spark):
    rows = [(1, i, t, c) for i, (t, c) in enumerate([("a longer text here", False), ("short", False), ("", False), (None, False), ("short", True), ("nearly a", False)])]
    events = spark.createDataFrame(rows, "session_id long, seq long, text string, canonical boolean").withColumn("ts", F.timestamp_seconds("seq"))
    got = [r.shown for r in sessions.freeze_last_good(events).orderBy("seq").collect()]
    assert got == ["a longer text here"] * 4 + ["short", "nearly a"]
    assert sessions.freeze_last_good(events.limit(0)).collect() == []
    parts = spark.createDataFrame([(1, 2, "over lap and"), (1, 1, "lap"), (1, 3, None), (2, 1, "x")], "session_id long, seq long, text string")
    assert {r.session_id: (r.parts, r.transcript) for r in sessions.accumulated(parts).collect()} == {1: (3, "lap over lap and"), 2: (1, "x")}
    hits = spark.createDataFrame([("a", 0), ("a", 90), ("b", 30)], "key string, s long").select("key", F.timestamp_seconds("s").alias("ts"))
    assert [r.key for r in sessions.active_keys(hits, 30).collect()] == ["a"]


def test_comparison_files_and_manifests(spark, tmp_path):
    (tmp_path / "run.json").write_text('{"id": "r1", "created_at": "t", "rows": [{"provider": "p", "elapsed_ms": 5, "transcript": "x"}, {"provider": "q", "elapsed_ms": 7, "error": "late"}]}')
    got = {r.provider: r.ok for r in views.read_comparisons(spark, f"{tmp_path}/run.json").collect()}
    assert got == {"p": True, "q": False}
    one = spark.range(1).select(F.lit(3).alias("n_rows"))
    views.write_manifest(one, spark.createDataFrame([("s",)], "id string"), spark.range(1).select(F.lit("abc").alias("build_id")), f"{tmp_path}/m")
    built = spark.read.json(f"{tmp_path}/m/build").first()
    assert built.id == "abc" and built.coverage.n_rows == 3 and built.eligibility_predicate.tiers == ["high", "medium"]


def test_ratio_of_long_strings(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    pairs = [(word(a), word(b)) for a, b in ((61, 70), (62, 61), (70, 3), (122, 130), (123, 90), (200, 200), (0, 80), (80, 0))]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", scoring.indel_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert all(abs(r.r - 200 * lcs(r.a, r.b) / (len(r.a) + len(r.b))) < 1e-9 for r in got)
    assert all(scoring.common(a, b) == lcs(a, b) for a, b in pairs)


def test_scores_with_a_floor_are_exact_above_it():
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abc dé") for _ in range(n))
    for _ in range(60):
        q, rows, floor = word(rng.choice([5, 40, 64, 130])), [word(rng.choice([0, 3, 50, 140])) for _ in range(5)], rng.choice([40.0, 60.0, 75.0])
        got, want = scoring.partial_ratios(q, rows, floor), [partial(q, r) for r in rows]
        assert all(abs(x - w) < 1e-9 if w >= floor else x < floor for x, w in zip(got, want, strict=True))


def test_a_long_line_is_tried_at_many_places_at_once(monkeypatch):
    """The number of rounds is that of a run of places, however long the longest line is."""
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    for size in (20, 32, 33, 70):
        q, rows = word(size), [word(n) for n in (0, 3, size - 1, size, size + 31, size + 32, size + 33, 400)]
        want = [partial(q, r) for r in rows]
        for most in (4, 1 << 13):
            assert all(abs(x - w) < 1e-9 for x, w in zip(scoring.partial_ratios(q, rows, most=most), want, strict=True))
            assert all(abs(x - w) < 1e-9 if w >= 60 else x < 60 for x, w in zip(scoring.partial_ratios(q, rows, 60.0, most), want, strict=True))
    rounds, matched = [], scoring._matched
    monkeypatch.setattr(scoring, "_matched", lambda *a: rounds.append(1) or matched(*a))
    q, inside = word(30), word(9000)
    got = scoring.partial_ratios(q, [word(60) for _ in range(50)] + [inside + q + inside])
    assert got[-1] == 100.0 and len(rounds) < 3 * scoring.RUN


def searched(spark):
    rng = random.Random(14)
    text = lambda n: " ".join("".join(rng.choice("abcde") for _ in range(rng.randrange(1, 6))) for _ in range(n))
    lines = [(k, k // 10, text(rng.randrange(3, 10))) for k in range(200)]
    known = next(t for _, p, t in lines if p == 6 and sum(len(w) >= T.LONG_TOKEN for w in t.split()) >= 4)
    queries = [("q0", lines[7][2]), ("q1", text(5)), ("q2", "ab cd"), ("q3", known)]
    return lines, queries, spark.createDataFrame(lines, "order_id long, passage_id long, norm string"), spark.createDataFrame(queries, "query_id string, query string")


def letters(text):
    return "".join(t[0] for t in text.split()).translate(str.maketrans(*T.ALIKE))


def soft(a, b):
    return (min(len(a), len(b)) / max(len(a), len(b))) ** 0.5 if a and b else 0.0


def test_scores_meet_characters_by_runs_of_a_text():
    """Rows of any length in any order, queries of one and of several words of bits, with and without a
    floor: each row takes the bits of its own places, also after shorter rows have ended."""
    from linetrace.functions import scoring

    masks = [np.array([1, 2, 4, 3, 0], dtype=np.uint64)]
    full = [np.full(3, 7, dtype=np.uint64)]
    got = scoring._matched(masks, np.array([0, 1, 4]), full, np.array([3, 2, 1]))
    assert got.tolist() == [3, 2, 0]
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab cd") for _ in range(rng.randrange(0, 170))) for _ in range(60)]
    for size in (1, 5, 63, 64, 65, 130):
        q = "".join(rng.choice("ab cd") for _ in range(size))
        whole = scoring.partial_ratios(q, texts)
        for text, score in zip(texts, whole, strict=True):
            a, b = sorted((q, text), key=len)
            want = max((100.0 * scoring.common(a, b[k : k + len(a)]) / len(a) for k in range(len(b) - len(a) + 1)), default=0.0) if a else 0.0
            assert abs(score - want) < 1e-9
        floored = scoring.partial_ratios(q, texts, 70.0)
        assert all(x == y if y >= 70 else x < 70 for x, y in zip(floored, whole, strict=True))


def test_other_searches_against_brute_force(spark):
    lines, queries, table, asked = searched(spark)
    ranked = lambda rows: {q: [r.order_id for r in sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)] for q, _ in queries}
    best = lambda scored, k: [-x[3] for x in sorted(scored, key=lambda x: (-x[0], -x[1], -x[2], x[3]))[:k]]
    got = ranked(match.prefiltered_topk_join(asked, table, 3, prefilter=60, pool=20).collect())
    for name, q in queries:
        few = sorted(lines, key=lambda x: (-partial(letters(q), letters(x[2])) * soft(letters(q), letters(x[2])), x[0]))[:60] if len(q.split()) >= 3 else lines
        pool = sorted(few, key=lambda x: (-partial(q, x[2]), x[0]))[:20]
        assert got[name] == best([(partial(q, t) * match.coverage(q, t), partial(q, t), match.coverage(q, t), -o) for o, _, t in pool], 3), name
    scopes = spark.createDataFrame([(q, p) for q, _ in queries for p in (0, 3, 6)], "query_id string, passage_id long")
    got = ranked(match.scoped_topk_join(asked, table, scopes, 3).collect())
    for name, q in queries:
        inside = [(o, t, partial(q, t) * soft(q, t)) for o, p, t in lines if p in (0, 3, 6)]
        assert got[name] == best([(s * match.coverage(q, t), s, match.coverage(q, t), -o) for o, t, s in inside], 3), name
    got = ranked(match.first_letters_topk(asked, table, 4, cutoff=0.8).collect())
    for name, q in queries:
        scored = sorted(((partial(letters(q), letters(t)) * soft(letters(q), letters(t)), o) for o, _, t in lines), key=lambda x: (-x[0], x[1]))[:4] if len(q.split()) >= 3 else []
        kept = [o for s, o in sorted(scored, key=lambda x: (-x[0], -x[1])) if s >= 0.8 * scored[0][0]]
        assert got[name] == kept, name


def test_cascade_takes_the_first_tier_that_fits(spark):
    lines, queries, table, asked = searched(spark)
    now = spark.createDataFrame([("q0", 0), ("q1", 1), ("q2", 2), ("q3", 2)], "query_id string, passage_id long")
    recent = spark.createDataFrame([("q3", 6), ("q3", 2)], "query_id string, passage_id long")
    got = {r.query_id: (r.tier, r.order_id) for r in match.cascade_match(asked, table, now, recent).collect()}
    assert got["q0"] == (1, 7) and got["q3"] == (2, next(o for o, _, t in lines if t == queries[3][1]))
    scoped = lambda p: match.runner_up_gate(match.scoped_topk_join(asked, table, p, 3)).filter("accepted")
    first = {r.query_id for r in scoped(now).collect()}
    assert {q for q, (tier, _) in got.items() if tier == 1} == first


def test_scripts(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert value(T.to_latin(F.lit("ਨਾਨਕ ਨਾਮੁ"))) == "naanak naamu" and value(T.to_latin(F.lit("सत नाम"))) == "sat naam"
    assert value(T.to_latin(F.lit("ॲक वाहि!"))) == "ka vaahi!" and value(T.to_latin(F.lit("Harī naaṭaka"))) == "Haree naatak"
    assert value(T.recode_script(F.lit("नानक ँऋष१। a"))) == "ਨਾਨਕ ਂਸ਼੧। a".replace("ਸ਼", "\u0a36")
    assert value(T.strip_marks(F.lit("Åsa ſ ṩñ ß ǭ"))) == "Asa ſ sn ß o"
    rows = spark.createDataFrame([(1, "नाम"), (2, "Waiting for speech"), (3, "a\ufffd"), (4, "latin only"), (5, "नानानानानानानाना"), (6, ""), (7, None)], "id long, text string")
    assert sorted(r.id for r in T.drop_bad_transcripts(rows).collect()) == [1, 6, 7]


def test_build_ids(spark):
    samples = [("b", "2"), ("a", "1"), ("c", None)]
    df = spark.createDataFrame(samples, "id string, audio_sha256 string")
    want = hashlib.sha256("".join(f"{i}|{h or ''}\n" for i, h in sorted(samples)).encode()).hexdigest()[:16]
    assert dataset.build_id(df).first().build_id == want
    assert dataset.tree_id(df).first() == dataset.tree_id(df.orderBy("audio_sha256")).first() != dataset.tree_id(df.limit(2)).first()


def test_near_misses_by_passage(spark):
    rows = [("a", "x", 1, 90.0), ("b", "y", 1, 50.0), ("c", "y", 2, 50.0), ("d", "y", 2, 40.0), ("e", "x", 3, 50.0), ("f", "x", None, 0.0), ("g", "x", None, 0.0)]
    df = spark.createDataFrame(rows, "sample_id string, grp string, best_passage long, best_confidence double")
    assert {r.sample_id for r in evaluate.near_misses(df, "grp").filter("near_miss").collect()} == {"b", "c", "d"}


def test_registry(spark):
    names = ["bhai_harjinder_singh_srinagar_soohee_626_19_studio.mp3", "unknown_raag_unknown_unknown_unknown_nagar_kirtan.mp3", "harjinder singh 3.mp3", None]
    got = [r.n for r in spark.createDataFrame([(n,) for n in names], "name string").select(registry.parse_sample_name(F.col("name")).alias("n")).collect()]
    assert (got[0].singer, got[0].raag, got[0].page, got[0].line_no, got[0].difficulty, got[0].legacy) == ("bhai_harjinder_singh_srinagar", "soohee", 626, 19, "studio", False)
    assert (got[1].raag, got[1].page, got[1].difficulty) == ("unknown", None, "nagar_kirtan") and got[2].legacy and got[3].legacy
    files = spark.createDataFrame([("a.WAV", None, 5, 3.0), ("a", "audio/x", 0, 3.0), ("a.txt", "text/plain", 5, 1.0), ("b.mp3", None, 11 << 20, 1.0), ("c.ogg", None, 9, None), ("d.flac", None, 9, 61.0)], "name string, mime string, bytes long, duration_sec double")
    assert [r.reason for r in registry.admission(files).collect()] == ["ok", "empty_audio_file", "unsupported_media_type", "file_too_large", "unreadable_audio", "audio_too_long"]


def test_files(spark, tmp_path):
    (tmp_path / "words.json").write_text('{"sample_id": "s", "words": [{"start": 0.5, "end": 1.5, "word": "a"}, {"start": 2.0, "end": 2.5, "word": "b"}]}')
    assert [(r.word, r.duration_sec) for r in views.read_words(spark, f"{tmp_path}/words.json").collect()] == [("a", 2.5), ("b", 2.5)]
    (tmp_path / "registry.json").write_text('{"raags": {"soohee": {"display": "Soohee", "sggs_position": 15}}, "coverage_targets_v1": {"distinct_raags": 12}, "samples": [{"id": "1", "raag": "soohee", "categories": ["x"]}, {"id": "2", "raag": "odd"}]}')
    got = {r.id: (r.raag_display, r.targets.distinct_raags) for r in views.read_registry(spark, f"{tmp_path}/registry.json").collect()}
    assert got == {"1": ("Soohee", 12), "2": (None, 12)}
    (tmp_path / "al").mkdir()
    (tmp_path / "al" / "a.json").write_text('{"audio_file": "a.mp3", "segments": [{"start_sec": 1.0, "kind": "line"}, {"start_sec": 2.0, "kind": "silence"}]}')
    (tmp_path / "al" / "b.json").write_text("{broken")
    rows = views.read_alignments(spark, f"{tmp_path}/al").collect()
    assert sorted(r.idx for r in rows if r.broken is None) == [0, 1] and len([r for r in rows if r.broken]) == 1
    (tmp_path / "x.wav").write_bytes(b"sound")
    assert [(r.bytes, r.audio_sha256) for r in views.audio_catalog(spark, f"{tmp_path}/x.wav").collect()] == [(5, hashlib.sha256(b"sound").hexdigest())]


# --- Streams: the machines over files that arrive, against the same machines over sorted rows
def streamed(spark, rows, machine, order, schema, path):
    rows.repartition(1).write.parquet(f"{path}/in")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        source = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
        out = machines.stream(source, machine, order, schema)
        out.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/progress").format("parquet").option("path", f"{path}/out").start().awaitTermination(120)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    return sorted(map(tuple, spark.read.parquet(f"{path}/out").collect()))


def test_streams_end_and_equal_the_batch_form(spark, tmp_path):
    rng = random.Random(3)
    matches = spark.createDataFrame([(k % 3, k * 400_000, k, rng.randrange(3), rng.randrange(4), float(rng.randrange(101))) for k in range(60)], "session_id long, us long, seq long, passage_id long, line_no long, score double")
    schema = "session_id long, us long, seq long, action string, passage_id long, line_no long"
    assert streamed(spark, matches, machines.Follower, ["us", "seq"], schema, tmp_path / "a") == sorted(map(tuple, machines.fold(matches, machines.Follower, ["us", "seq"], schema).collect()))
    texts = ["a longer text here", "short", "", None, "here and so on", "text here and so on"]
    said = spark.createDataFrame([(k % 2, k, k, rng.choice(texts), rng.random() < 0.3) for k in range(40)], "session_id long, us long, seq long, text string, canonical boolean")
    schema = "session_id long, us long, seq long, shown string"
    assert streamed(spark, said, machines.Frozen, ["us", "seq"], schema, tmp_path / "b") == sorted(map(tuple, machines.fold(said, machines.Frozen, ["us", "seq"], schema).collect()))
    parts, schema = said.select("session_id", "seq", "text"), "session_id long, seq long, parts long, transcript string"
    assert streamed(spark, parts, machines.Transcript, ["seq"], schema, tmp_path / "c") == sorted(map(tuple, machines.fold(parts, machines.Transcript, ["seq"], schema).collect()))
    calls = spark.createDataFrame([(1, 1, 20, False, [5, 6], [70.0, 50.0]), (1, 2, 4, False, [5, 7], [84.0, 99.0]), (1, 3, 4, False, [5], [86.0]), (1, 4, 20, False, [7, 5], [46.0, 30.0]), (1, 5, 20, True, [5], [99.0]), (1, 6, 20, False, [5, 8], [61.0, 99.0]), (1, 2, 20, False, [9], [99.0]), (1, 7, 20, False, [], [])],
                                  "session_id long, seq long, size long, interjection boolean, passages array<long>, scores array<double>")
    calls = calls.withColumn("n", F.monotonically_increasing_id()).select("session_id", "seq", "size", "interjection", "passages", "scores")
    schema = "session_id long, seq long, what string, passage_id long"
    machine, run = machines.Cascade(), []
    for r in calls.collect():
        run += machine.take(*r)
    assert [x[2] for x in run] == ["tier 3", "none", "tier 1", "tier 3", "interjection", "tier 2", "stale", "none"]
    ordered = calls.filter("seq <> 2 or size = 4")
    assert streamed(spark, ordered, machines.Cascade, ["seq"], schema, tmp_path / "d") == sorted(map(tuple, machines.fold(ordered, machines.Cascade, ["seq"], schema).collect()))


def test_feedback_is_stored_from_batches_and_streams(spark, tmp_path):
    kinds = "session_token string, correction struct<type: string, ang: long, notes: string>, audio_base64 string"
    rows = spark.createDataFrame([("a good token", ("unknown", 5, None), "AA"), ("short", ("unknown", 5, None), None), ("a good token", ("nothing", 5, None), None), ("a good token", ("unknown", -1, None), None)], kinds)
    assert [list(r.issues) for r in feedback.validate(rows).collect()] == [[], ["session_token"], ["correction.type"], ["correction.ang"]]
    secret = "a secret of enough length"
    feedback.append_feedback(rows, secret, f"{tmp_path}/store")
    rows.write.parquet(f"{tmp_path}/in")
    feedback.append_feedback(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), secret, f"{tmp_path}/store")
    # A batch that runs again, under its old name or from its old offsets, is not stored twice.
    feedback.append_feedback(rows, secret, f"{tmp_path}/store", "stream-000000000")
    stored = feedback.read_feedback(spark, f"{tmp_path}/store")
    assert stored.count() == 2 and "session_token" not in stored.columns and "audio_base64" not in stored.columns and stored.select("id").distinct().count() == 2


def test_statuses_by_precedence(spark):
    rows = [(1, 0, 1, "listening"), (1, 0, 2, "recording"), (1, 1, 3, "recording"), (1, 2, 4, "processing"), (1, 3, 5, "error"), (1, 4, 6, "recording")]
    events = spark.createDataFrame(rows, "session_id long, s long, seq long, status string").withColumn("ts", F.timestamp_seconds("s"))
    assert [r.status for r in sessions.status_changes(events).orderBy("seq").collect()] == ["recording", "processing", "error"]
