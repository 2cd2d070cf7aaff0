"""Summaries of recognised samples, near misses, error rates and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONFIDENT = 75.0


def sample_summary(windows: DataFrame) -> DataFrame:
    """Best window (the first on ties) with its line and passage, confident windows, first confident time
    and pages."""
    sure = F.col("confidence") >= CONFIDENT
    best = F.max(F.struct("confidence", (-F.col("seq")).alias("s"), "page", "line_no", "passage_id")).alias("b")
    by = windows.groupBy("sample_id").agg(
        best, F.count("*").alias("windows_total"), F.count_if(sure).alias("windows_confident"), F.min(F.when(sure, F.col("start_sec"))).alias("first_confident"), F.array_sort(F.collect_set(F.when(sure, F.col("page")))).alias("pages")
    )
    return by.select("sample_id", F.col("b.page").alias("best_page"), F.col("b.line_no").alias("best_line"), F.col("b.passage_id").alias("best_passage"), F.col("b.confidence").alias("best_confidence"), "windows_total", "windows_confident", "first_confident", F.array_join("pages", ",").alias("pages"))


def near_misses(summaries: DataFrame, group: str) -> DataFrame:
    """A sample (sample_id, best_passage, best_confidence) below the threshold is a likely hit if
    another sample with the same best passage is above it, or another of its group shares it."""
    sure = F.count_if(F.col("best_confidence") >= CONFIDENT).alias("sure")
    passages = summaries.groupBy("best_passage").agg(sure)
    peers = summaries.groupBy(group, "best_passage").agg(F.count("*").alias("peers"))
    joined = summaries.join(passages, "best_passage", "left").join(peers, [group, "best_passage"], "left")
    likely = (F.col("best_confidence") < CONFIDENT) & ((F.col("sure") > 0) | (F.col("peers") > 1))
    return joined.select("sample_id", group, "best_passage", "best_confidence", F.coalesce(likely, F.lit(False)).alias("near_miss"))


def notes(summaries: DataFrame) -> DataFrame:
    """What a summary says in words.  ``timed_out`` may be missing."""
    n, sure = F.col("windows_total"), F.col("windows_confident")
    late = F.coalesce(F.col("timed_out"), F.lit(False)) if "timed_out" in summaries.columns else F.lit(False)
    pages = F.when(F.col("pages") == "", 0).otherwise(F.size(F.split("pages", ",")))
    note = F.when(n == 0, "no windows").when(late, F.concat_ws(" ", F.lit("timed out after"), n, F.lit("windows"))).when(sure == 0, "none confident").when(sure == n, "all confident")
    note = note.when(pages == 1, F.concat(F.lit("one page: "), F.col("pages"))).when(pages > 3, F.concat_ws(" ", F.lit("scattered over"), pages, F.lit("pages"))).otherwise(F.concat_ws(" ", pages, F.lit("pages")))
    return summaries.select("sample_id", note.alias("note"))


def eval_rollup(summaries: DataFrame, *groups: str) -> DataFrame:
    return summaries.rollup(*groups).agg(F.count("*").alias("samples"), F.count_if(F.col("best_confidence") >= CONFIDENT).alias("samples_confident"), F.sum("windows_confident").alias("windows_confident"), F.sum("windows_total").alias("windows_total"))


def error_rates(pairs: DataFrame) -> DataFrame:
    """Character and word error rates of (reference, hypothesis); words become single characters."""
    words = F.array_distinct(F.concat(F.split("reference", " "), F.split("hypothesis", " ")))
    # Code points from 32 on, past the surrogates; F.char would start again at 256.
    point = lambda w: F.array_position("ws", w).cast("int") + 31
    wide = lambda p: F.lpad(F.hex(p + F.when(p >= 0xD800, 0x800).otherwise(0)), 8, "0")
    code = lambda text: F.decode(F.unhex(F.array_join(F.transform(F.split(text, " "), lambda w: wide(point(w))), "")), "UTF-32")
    rows = pairs.withColumn("ws", words).withColumn("r", code("reference")).withColumn("h", code("hypothesis"))
    return rows.agg((F.sum(F.levenshtein("reference", "hypothesis")) / F.sum(F.length("reference"))).alias("cer"), (F.sum(F.levenshtein("r", "h")) / F.sum(F.length("r"))).alias("wer"))


def confidence_histogram(rows: DataFrame, score: str, right: str, bins: int = 10) -> DataFrame:
    """Right and wrong results in equal bins of 0 to 100."""
    at = F.least(F.floor(F.col(score) / (100 / bins)), F.lit(bins - 1))
    return rows.groupBy(at.cast("long").alias("bin")).agg(F.count_if(F.col(right)).alias("right"), F.count_if(~F.col(right)).alias("wrong"))


def latency_by_provider(rows: DataFrame) -> DataFrame:
    return rows.groupBy("provider").agg(F.count("*").alias("n"), F.round(F.avg("elapsed_ms"), 6).alias("mean_ms"), F.max("elapsed_ms").alias("max_ms"), F.count_if(F.col("ok")).alias("succeeded"))


def model_compare(a: DataFrame, b: DataFrame, groups: DataFrame | None = None, negatives: DataFrame | None = None) -> DataFrame:
    """The same samples under two models.  With ``groups`` (sample_id, grp): how many groups of several
    samples agree on one best page under each.  With ``negatives`` (sample_id), samples that should
    match nothing: how many of them each model rejects."""
    x, y = (d.select("sample_id", F.col("best_page").alias(f"page_{k}"), (F.col("best_confidence") >= CONFIDENT).alias(f"sure_{k}")) for k, d in (("a", a), ("b", b)))
    both = x.join(y, "sample_id")
    named = both.join(negatives.select("sample_id", F.lit(True).alias("negative")).distinct(), "sample_id", "left") if negatives is not None else both.withColumn("negative", F.lit(None).cast("boolean"))
    rejected = lambda k: F.count_if(F.col("negative") & ~F.col(f"sure_{k}")).alias(f"rejected_{k}")
    counts = named.agg(F.count("*").alias("samples"), F.count_if("sure_a").alias("sure_a"), F.count_if("sure_b").alias("sure_b"), F.count_if(F.col("page_a") == F.col("page_b")).alias("same_page"), rejected("a"), rejected("b"))
    if groups is None:
        return counts.drop(*(() if negatives is not None else ("rejected_a", "rejected_b")))
    by = both.join(groups, "sample_id").groupBy("grp").agg(F.count("*").alias("n"), *[F.count_distinct(F.coalesce(f"page_{k}", F.lit(-1))).alias(f"pages_{k}") for k in "ab"]).filter("n > 1")
    stable = by.agg(F.count("*").alias("groups"), *[F.count_if(F.col(f"pages_{k}") == 1).alias(f"stable_{k}") for k in "ab"])
    # Two rows of one number each: put together by a key that both have.
    return counts.withColumn("k", F.lit(0)).join(stable.withColumn("k", F.lit(0)), "k").drop("k")


def gold_compare(found: DataFrame, gold: DataFrame, slack: float = 5.0, near_top: int = 3) -> DataFrame:
    """Golden queries (query_id, order_id, least, most) against the best line found for each.  A query
    may name lines that must not be among the first ``near_top`` (forbidden, an array)."""
    top = found.filter(F.col("rank") <= near_top).groupBy("query_id").agg(
        F.max_by("order_id", -F.col("rank")).alias("got"), F.max_by("score", -F.col("rank")).alias("got_score"), F.collect_list("order_id").alias("near")
    )
    fits = (F.col("got_score") >= F.coalesce(F.col("least") - slack, F.lit(0.0))) & (F.col("got_score") <= F.coalesce(F.col("most") + slack, F.lit(100.0)))
    line_ok = F.col("order_id").isNull() | F.coalesce(F.col("got") == F.col("order_id"), F.lit(False))
    checks = [line_ok.alias("line_ok"), F.coalesce(fits, F.lit(False)).alias("score_ok")]
    if "forbidden" in gold.columns:
        checks.append((~F.coalesce(F.arrays_overlap("forbidden", "near"), F.lit(False))).alias("forbidden_ok"))
    return gold.join(top, "query_id", "left").select("query_id", *checks)


def category_coverage(samples: DataFrame, goals: DataFrame) -> DataFrame:
    """Samples of each category of ``samples`` (sample_id, categories), held against ``goals``
    (category, goal); goals without samples are listed too."""
    got = samples.select("sample_id", F.explode(F.array_distinct("categories")).alias("category")).groupBy("category").agg(F.count("*").alias("got"))
    both = goals.join(got, "category", "left").withColumn("got", F.coalesce("got", F.lit(0).cast("long")))
    return both.select("category", "got", "goal", (F.col("got") >= F.col("goal")).alias("met"))


#: Columns of the summary file, in order.
CSV = ("filename", "group", "ground_truth", "best_page", "best_line", "best_passage", "best_confidence", "best_time", "windows_confident", "windows_total", "near_miss", "timed_out", "elapsed_sec", "notes")


def eval_csv(summaries: DataFrame, path: str) -> None:
    """The 14 columns as CSV: numbers of one decimal, blanks for what is missing, and semicolons for
    commas in notes.  Columns that ``summaries`` lacks are blank."""
    kinds = dict(summaries.dtypes)

    def written(name: str) -> Column:
        if name not in kinds:
            return F.lit("")
        text = F.format_string("%.1f", F.col(name)) if kinds[name] == "double" else F.col(name).cast("string")
        return F.coalesce(F.replace(text, F.lit(","), F.lit(";")), F.lit(""))

    summaries.select([written(c).alias(c) for c in CSV]).write.mode("overwrite").options(emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path, header=True)
