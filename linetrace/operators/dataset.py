"""Training sets: eligibility with reasons, splits, weights, reports and gates."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The reason of the first rule that holds, else 'ok'."""
    out = F.lit("ok")
    for broken, reason in reversed(rules):
        out = F.when(F.coalesce(broken, F.lit(True)), reason).otherwise(out)
    return out


def sample_reason() -> Column:
    return first_reason(
        (~F.col("alignment_status").isin("machine_aligned", "human_reviewed"), "status"), (F.col("alignment_file").isNull(), "no_alignment_file"),
        (~F.col("recording_quality").isin("studio", "clean_live"), "recording_quality"), (F.coalesce(F.col("filename"), F.lit("")) == "", "no_filename"),
    )


def segment_reason() -> Column:
    return first_reason(
        (~F.col("tier").isin("high", "medium"), "tier"), (F.col("kind") != "line", "kind"), (F.coalesce(F.col("text"), F.lit("")) == "", "no_text"),
        (F.col("repeat_group").isNotNull(), "repeat"), (F.col("page").isNull() | F.col("line_no").isNull(), "no_line"),
    )


#: Columns of samples and spans that a training row carries along where they exist.
OF_SAMPLE = ("audio_sha256", "jatha", "raag", "recording_quality", "source_url", "license_notes")
OF_SPAN = ("text_latin", "shabad_id", "confidence", "coverage")


def training_rows(samples: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows of eligible spans of eligible samples, with their audio, split and duration."""
    from linetrace.functions.text import split_of

    carried = [c for c in OF_SAMPLE if c in samples.columns]
    good = samples.filter(sample_reason() == "ok").select("sample_id", "source", F.concat(F.lit("audio/"), "filename").alias("audio"), *carried)
    kept = spans.filter(segment_reason() == "ok").join(good, "sample_id")
    own = [F.round(c, 6).alias(c) if c in ("confidence", "coverage") else F.col(c) for c in OF_SPAN if c in spans.columns]
    return kept.select(
        "sample_id", "source", "idx", "audio", "tier", "page", "line_no", F.col("text").alias("sentence"), F.round("start_sec", 3).alias("start_sec"), F.round("end_sec", 3).alias("end_sec"),
        F.round(F.col("end_sec") - F.col("start_sec"), 3).alias("duration_sec"), split_of(F.col("sample_id").cast("string")).alias("split"), *carried, *own,
    )


def gathered(samples: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """All ``samples`` with the ``reason`` why one is left out, or ok.  ``files`` (sample_id, reason) is what
    became of their alignment files (``views.alignment_state``): a sample that it lacks has none."""
    rows, reason = samples.withColumn("reason", sample_reason()), F.col("reason")
    if files is None:
        return rows
    state = F.coalesce("state", F.lit("missing"))
    rows = rows.join(files.select("sample_id", F.col("reason").alias("state")), "sample_id", "left")
    return rows.withColumn("reason", F.when((reason == "ok") & (state != "ok"), F.concat(F.lit("alignment_"), state)).otherwise(reason)).drop("state")


def skip_reasons(samples: DataFrame, spans: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Why samples and segments are left out, with counts.  Where ``files`` says what became of the
    alignments, only the segments of samples that are taken are looked at."""
    a = gathered(samples, files)
    looked = spans if files is None else spans.join(a.filter("reason = 'ok'").select("sample_id"), "sample_id", "left_semi")
    b = looked.select(F.lit("segment").alias("level"), segment_reason().alias("reason"))
    return a.select(F.lit("sample").alias("level"), "reason").unionByName(b).filter("reason <> 'ok'").groupBy("level", "reason").count()


def build_report(rows: DataFrame) -> DataFrame:
    count = lambda c, v: F.count_if(F.col(c) == v).alias(v)
    return rows.agg(
        F.count("*").alias("n_rows"), F.round(F.sum("duration_sec"), 3).alias("duration_sec"), *[count("split", s) for s in ("train", "val", "test")], *[count("tier", t) for t in ("high", "medium")],
        F.count_distinct("page", "line_no").alias("n_lines"), F.count_distinct("source").alias("n_sources"),
    )


def tier_counts(spans: DataFrame) -> DataFrame:
    """Spans of each tier, tiers without any included."""
    return spans.groupBy("sample_id").pivot("tier", ["high", "medium", "needs_review", "n/a"]).count().na.fill(0).withColumnRenamed("n/a", "n_a")


def coverage_vs_targets(report: DataFrame, targets: DataFrame) -> DataFrame:
    """(metric, got, target, met) for every metric that has a target."""
    names = [c for c in report.columns if c != "duration_sec"]
    long_ = report.select(F.expr(f"stack({len(names)}, {', '.join(f"'{c}', cast({c} as double)" for c in names)}) as (metric, got)"))
    return long_.join(targets, "metric").select("metric", "got", "target", (F.col("got") >= F.col("target")).alias("met"))


#: Samples whose lines make one string for the build id; some 100 MB.
MANIFEST_ROWS = 1_000_000


def build_id(samples: DataFrame) -> DataFrame:
    """16 hex digits: the SHA-256 of the lines ``id|hash`` of (id, audio_sha256) in the order of ids,
    without a hash where it is null.

    A manifest of more than a million samples is an error: its lines would be one string in one
    task.  Such tables take ``tree_id``."""
    if samples.limit(MANIFEST_ROWS + 1).count() > MANIFEST_ROWS:
        raise ValueError(f"more than {MANIFEST_ROWS} samples: use tree_id")
    line = F.struct("id", F.concat("id", F.lit("|"), F.coalesce("audio_sha256", F.lit("")), F.lit("\n")).alias("line"))
    lines = F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"])
    return samples.agg(F.substring(F.sha2(F.array_join(lines, ""), 256), 1, 16).alias("build_id"))


def tree_id(samples: DataFrame) -> DataFrame:
    """Another id of the same content for tables of any size: sums of hashes of the lines, which need
    no order and no gathering.  Not the value of ``build_id``."""
    digest = F.sha2(F.concat_ws("|", "id", F.coalesce("audio_sha256", F.lit(""))), 256)
    word = lambda k: F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("decimal(38,0)")
    sums = [F.coalesce(F.sum(word(k)), F.lit(0)).cast("string").alias(f"s{k}") for k in range(8)]
    return samples.agg(F.count("*").alias("n"), *sums).select(F.concat(F.lit("tree-"), F.substring(F.sha2(F.concat_ws("|", "n", *[f"s{k}" for k in range(8)]), 256), 1, 16)).alias("tree_id"))


def stratum_weights(rows: DataFrame, *strata: str) -> DataFrame:
    """One over the size of each row's stratum; sizes are counted first, so no stratum is gathered."""
    sizes = rows.groupBy(*strata).agg((1 / F.count("*")).alias("weight"))
    return rows.join(sizes, list(strata))


#: Buckets of rows among which draws are dealt on the driver, whatever the number of rows.
BUCKETS = 4096


def _uniform(*columns: Column) -> Column:
    """A number in [0, 1) that is a function of the values."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 52)) / F.lit(float(1 << 52))


def weighted_sample(rows: DataFrame, weight: str, n: int, seed: int = 7) -> DataFrame:
    """``n`` draws with replacement, a row's chance being its share of the weight: ``rows`` with
    ``draw`` (from 1) for each time that a row is drawn.

    Draws are a function of the seed and the rows' values.  They are first dealt to buckets of rows
    by the buckets' weights, which alone reach the driver, and within a bucket to points on the line
    of its running weight, so a row may be drawn any number of times.  Rows without a positive weight
    are never drawn; equal rows share their draws; no rows give no draws."""
    columns = rows.columns
    whole = rows.filter(F.col(weight) > 0).select(F.struct(*columns).alias("row"), F.col(weight).cast("double").alias("w")).withColumn("h", F.xxhash64(F.lit(seed), F.to_json("row")))
    # Equal rows are one place on the line, with their weights together.
    whole = whole.groupBy("h", F.to_json("row").alias("key")).agg(F.first("row").alias("row"), F.sum("w").alias("w"), F.count("*").alias("copies"))
    whole = whole.withColumn("bucket", F.pmod("h", F.lit(BUCKETS)).cast("int"))
    sums = sorted((r.bucket, r.w) for r in whole.groupBy("bucket").agg(F.sum("w").alias("w")).collect())
    if not sums or n <= 0:
        return rows.limit(0).withColumn("draw", F.lit(1))
    weights = np.array([w for _, w in sums])
    dealt = np.random.default_rng(seed).multinomial(n, weights / weights.sum()).tolist()
    spark = rows.sparkSession
    shares = spark.createDataFrame([(b, w, k) for (b, w), k in zip(sums, dealt, strict=True) if k], "bucket int, total double, k long")
    points = shares.select("bucket", "total", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k"))).alias("j"))
    points = points.select("bucket", (_uniform(F.lit(seed), "bucket", "j") * F.col("total")).alias("at"), F.lit(True).alias("point"))
    running = W.partitionBy("bucket").orderBy("h", "key").rowsBetween(W.unboundedPreceding, -1)
    starts = whole.select("bucket", "h", "key", "row", "copies", F.coalesce(F.sum("w").over(running), F.lit(0.0)).alias("at"), F.lit(False).alias("point"))
    line = starts.unionByName(points, allowMissingColumns=True)
    # Of a point, the row whose stretch it falls on: the last one that starts at or before it.
    before = W.partitionBy("bucket").orderBy("at", "point").rowsBetween(W.unboundedPreceding, 0)
    found = line.withColumn("hit", F.last(F.when(~F.col("point"), F.struct("h", "key")), ignorenulls=True).over(before)).filter("point")
    counts = found.groupBy("hit.h", "hit.key").agg(F.count("*").alias("draws"))
    return whole.join(counts, ["h", "key"]).select("row.*", F.explode(F.sequence(F.lit(1), F.col("draws").cast("int"))).alias("draw"))


def curriculum(rows: DataFrame, epoch: int) -> DataFrame:
    return rows.filter(F.col("tier").isin(*(("high",) if epoch <= 1 else ("high", "medium"))))


def quality_ceiling(spans: DataFrame, samples: DataFrame) -> DataFrame:
    """Spans of archival or broadcast recordings are medium at best."""
    low = samples.filter(F.col("recording_quality").isin("archival", "broadcast")).select("sample_id", F.lit(True).alias("capped"))
    joined = spans.join(low, "sample_id", "left")
    return joined.withColumn("tier", F.when(F.col("capped") & (F.col("tier") == "high"), "medium").otherwise(F.col("tier"))).drop("capped")


def manifest_problems(samples: DataFrame, rows: DataFrame, stated: DataFrame, alignments: DataFrame | None = None, audio: DataFrame | None = None) -> DataFrame:
    """Samples without rows, splits (split, n) whose row count is not the stated one, and, where the
    files there are given (alignment_file; filename), samples that lack theirs."""
    missing = samples.join(rows, "sample_id", "left_anti").select(F.lit("no_rows").alias("problem"), F.col("sample_id").cast("string").alias("what"))
    for files, name, problem in ((alignments, "alignment_file", "no_alignment"), (audio, "filename", "no_audio")):
        if files is not None:
            missing = missing.unionByName(samples.join(files.select(name).distinct(), name, "left_anti").select(F.lit(problem).alias("problem"), F.col("sample_id").cast("string").alias("what")))
    counts = rows.groupBy("split").agg(F.count("*").alias("got"))
    wrong = stated.join(counts, "split", "left").filter(F.coalesce("got", F.lit(0)) != F.col("n")).select(F.lit("split_count").alias("problem"), F.col("split").alias("what"))
    return missing.unionByName(wrong)


def release_gate(coverage: DataFrame, problems: DataFrame) -> DataFrame:
    """Whether all targets are met and nothing is wrong."""
    both = coverage.select("met", F.lit(0).alias("problem")).unionByName(problems.select(F.lit(None).cast("boolean").alias("met"), F.lit(1).alias("problem")))
    out = both.agg(F.coalesce(F.min("met"), F.lit(False)).alias("targets_met"), (F.coalesce(F.sum("problem"), F.lit(0)) == 0).alias("clean"))
    return out.withColumn("passed", F.col("targets_met") & F.col("clean"))


def all_splits(splits: dict[str, DataFrame]) -> DataFrame:
    """The rows of all splits (name to rows), with the name of their split."""
    named = [rows.withColumn("split", F.lit(name)) for name, rows in splits.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def distinct_samples(rows: DataFrame) -> DataFrame:
    return rows.groupBy("sample_id").agg(F.min_by(F.struct("source", "split"), "idx").alias("f")).select("sample_id", "f.*")
