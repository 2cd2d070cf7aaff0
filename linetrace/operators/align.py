"""Windows over words, spans, repeats, gaps and quality tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linetrace.functions.text import vowel_only

SIZE, STEP, SHORT, LEAST = 6, 3, 8, 3


def token_windows(segments: DataFrame, size: int = SIZE, step: int = STEP, short: int = SHORT) -> DataFrame:
    """Windows of segments (sample_id, seg, start_sec, end_sec, text): a short segment is whole; a
    longer one gives a window every ``step`` tokens, the last of three at least.  Times are
    interpolated by token."""
    rows = segments.withColumn("toks", F.filter(F.split(F.trim("text"), r"\s+"), lambda x: x != "")).withColumn("n", F.size("toks")).filter("n > 0")
    starts = F.when(F.col("n") <= short, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("n") - 1, F.lit(step)), lambda i: F.col("n") - i >= LEAST))
    cut = rows.withColumn("i", F.explode(starts))
    span = (F.col("end_sec") - F.col("start_sec")) / F.col("n")
    width = F.when(F.col("n") <= short, F.col("n")).otherwise(F.least(F.lit(size), F.col("n") - F.col("i")))
    return cut.select(
        "sample_id", "seg", F.col("i").cast("long").alias("word_start"), (F.col("i") + width).cast("long").alias("word_end"), F.round(F.col("start_sec") + F.col("i") * span, 6).alias("start_sec"),
        F.array_join(F.slice("toks", F.col("i") + 1, width), " ").alias("text"),
    )


def word_windows(words: DataFrame, size: int = SIZE, step: int = STEP) -> DataFrame:
    """Windows over the timed words of each sample; fewer than three words give none."""
    w = W.partitionBy("sample_id").orderBy("start_sec", "seg", "pos")
    rows = words.filter("word <> ''").withColumn("rn", F.row_number().over(w) - 1)
    ahead = w.rowsBetween(0, size - 1)
    rows = rows.withColumn("ws", F.collect_list("word").over(ahead)).withColumn("end", F.last("end_sec").over(ahead))
    kept = rows.filter((F.col("rn") % step == 0) & (F.size("ws") >= LEAST))
    return kept.select("sample_id", F.col("rn").cast("long").alias("word_start"), (F.col("rn") + F.size("ws")).cast("long").alias("word_end"), "start_sec", F.col("end").alias("end_sec"), F.array_join("ws", " ").alias("text"))


def run_ids(windows: DataFrame) -> DataFrame:
    """Numbers the runs of equal (page, line_no); a null line is always a run of its own."""
    w = W.partitionBy("sample_id").orderBy("seq")
    same = (F.col("page") == F.lag("page").over(w)) & (F.col("line_no") == F.lag("line_no").over(w))
    return windows.withColumn("new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("new").over(w)).drop("new")


def merge_windows(windows: DataFrame) -> DataFrame:
    """One span a run: first start, last end, mean scores, texts joined."""
    runs = run_ids(windows).groupBy("sample_id", "run").agg(
        F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), F.first("page").alias("page"), F.first("line_no").alias("line_no"), F.round(F.avg("confidence"), 6).alias("confidence"),
        F.round(F.avg("coverage"), 6).alias("coverage"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ").alias("text"),
    )
    return runs.withColumn("idx", (F.col("run") - 1).cast("long")).withColumn("kind", F.when(F.col("page").isNull(), "unknown").otherwise("line")).drop("run")


def detect_repeats(spans: DataFrame, gap: float = 1.0, rule: str = "gap") -> DataFrame:
    """``repeat_group``: spans of one line that comes again at least ``gap`` after it ended share an
    id, all earlier ones included; rule='non_adjacent' takes any that comes again after another."""
    w = W.partitionBy("sample_id", "page", "line_no").orderBy("idx")
    far = F.col("start_sec") - F.lag("end_sec").over(w) >= gap if rule == "gap" else F.col("idx") - F.lag("idx").over(w) > 1
    rows = spans.withColumn("again", F.coalesce(far, F.lit(False)) & (F.col("kind") == "line"))
    last = F.max(F.when(F.col("again"), F.col("idx"))).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    first = F.min("idx").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    member = (F.col("kind") == "line") & (F.col("idx") <= last)
    return rows.withColumn("repeat_group", F.when(member, F.concat_ws("_", F.lit("rg"), "page", "line_no", first))).drop("again")


#: Seconds of a sample that are swept at once.
SWEEP = 600


def words_in_holes(holes: DataFrame, words: DataFrame) -> DataFrame:
    """``words`` (sample_id, mid, ...) with the hole (start_sec, end_sec) that they fall into, its start
    included.  Holes of a sample must not overlap.

    One sorted pass over both: the hole of a word can only be the last that began before it.  A pass
    covers ``SWEEP`` seconds, and a longer hole begins again in each, so the rows are those of both
    tables, and no sample is in one task."""
    of = lambda t: F.floor(t / SWEEP).cast("long")
    cover = F.struct("start_sec", "end_sec")
    began = holes.select("sample_id", cover.alias("hole"), F.explode(F.sequence(of(F.col("start_sec")), of(F.col("end_sec")))).alias("part"))
    began = began.withColumn("at", F.greatest(F.col("hole.start_sec"), F.col("part") * F.lit(float(SWEEP)))).withColumn("word", F.lit(None).cast(words.schema.simpleString()))
    said = words.select("sample_id", F.lit(None).cast("struct<start_sec: double, end_sec: double>").alias("hole"), of(F.col("mid")).alias("part"), F.col("mid").alias("at"), F.struct(*words.columns).alias("word"))
    sweep = W.partitionBy("sample_id", "part").orderBy("at", F.col("word").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    met = began.unionByName(said).withColumn("hole", F.last("hole", ignorenulls=True).over(sweep))
    return met.filter("word is not null and word.mid < hole.end_sec").select("word.*", "hole.*")


def detect_gaps(spans: DataFrame, words: DataFrame, durations: DataFrame, gap: float = 2.0) -> DataFrame:
    """Stretches of more than ``gap`` seconds before, between and after spans: without words
    silence, with only vowel words vocalise, else unknown."""
    ends = durations.select("sample_id", F.col("duration_sec").alias("start_sec"), F.lit(None).cast("double").alias("end_sec"))
    w = W.partitionBy("sample_id").orderBy("start_sec", F.col("end_sec").asc_nulls_last())
    both = spans.select("sample_id", "start_sec", "end_sec").unionByName(ends)
    holes = both.withColumn("from", F.lag("end_sec", 1, 0.0).over(w)).filter(F.col("start_sec") - F.col("from") > gap).select("sample_id", F.col("from").alias("start_sec"), F.col("start_sec").alias("end_sec"))
    said = words.select("sample_id", ((F.col("start_sec") + F.col("end_sec")) / 2).alias("mid"), vowel_only(F.col("word")).alias("vowel"))
    inside = words_in_holes(holes, said).groupBy("sample_id", "start_sec", "end_sec").agg(F.min("vowel").alias("vowels"))
    kind = F.when(F.col("vowels").isNull(), "silence").when(F.col("vowels"), "vocalise").otherwise("unknown")
    return holes.join(inside, ["sample_id", "start_sec", "end_sec"], "left").select("sample_id", "start_sec", "end_sec", kind.alias("kind"))


def retag_vowel_only(spans: DataFrame) -> DataFrame:
    """Line spans whose words are all vowels become vocalises without a line."""
    sung = (F.col("kind") == "line") & F.forall(F.split("text", " "), vowel_only)
    clear = {c: F.when(~sung, F.col(c)) for c in ("page", "line_no")}
    return spans.withColumns({**clear, "kind": F.when(sung, "vocalise").otherwise(F.col("kind")), "notes": F.when(sung, "retagged: vowels only")})


def score_tier(spans: DataFrame) -> DataFrame:
    """``tier`` of each span; an unknown boundary counts as exact, repeats go to review."""
    length, edge = F.col("end_sec") - F.col("start_sec"), F.coalesce("boundary", F.lit(0.0))
    good = lambda s, c, b: (F.col("confidence") >= s) & (F.col("coverage") >= c) & (edge <= b)
    tier = F.when(F.col("kind") != "line", "n/a").when(~length.between(1.5, 25.0) | F.col("repeat_group").isNotNull(), "needs_review")
    return spans.withColumn("tier", tier.when(good(80, 0.7, 0.3), "high").when(good(65, 0.5, 0.8), "medium").otherwise("needs_review"))


def reclass_unsure(spans: DataFrame, confidence: float = 70, coverage: float = 0.8) -> DataFrame:
    """Line spans below both bounds are not lines."""
    unsure = (F.col("kind") == "line") & (F.col("confidence") < confidence) & (F.col("coverage") < coverage)
    return spans.withColumn("kind", F.when(unsure, "unknown").otherwise(F.col("kind")))


def suppress_overlaps(spans: DataFrame, weaker: float = 15.0) -> DataFrame:
    """Drops a span that overlaps its neighbour in time and is much weaker."""
    w = W.partitionBy("sample_id").orderBy("idx")
    before = (F.lag("end_sec").over(w) > F.col("start_sec")) & (F.lag("confidence").over(w) - F.col("confidence") >= weaker)
    after = (F.lead("start_sec").over(w) < F.col("end_sec")) & (F.lead("confidence").over(w) - F.col("confidence") >= weaker)
    return spans.withColumn("lost", F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))).filter("not lost").drop("lost")


def backward_jumps(spans: DataFrame) -> DataFrame:
    w = W.partitionBy("sample_id").orderBy("idx")
    back = F.col("line_no") < F.lag("line_no").over(w)
    return spans.withColumn("jump_back", F.coalesce(back, F.lit(False)))


def attach_line_text(spans: DataFrame, lines: DataFrame, column: str = "text") -> DataFrame:
    """The first corpus line at each span's page and line."""
    first = lines.groupBy("page", "line_no").agg(F.min_by(column, "order_id").alias("line_text"))
    return spans.join(first, ["page", "line_no"], "left")


def align(windows: DataFrame, words: DataFrame, durations: DataFrame) -> DataFrame:
    """Windows to tiered spans: merged, repeats marked, gaps added, vowels retagged."""
    spans = retag_vowel_only(detect_repeats(merge_windows(windows)))
    gaps = detect_gaps(spans, words, durations)
    return score_tier(spans.withColumn("boundary", F.lit(None).cast("double")).unionByName(gaps, allowMissingColumns=True))
