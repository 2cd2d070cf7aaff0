"""Tables of the domain, read from files or derived from general ones."""

from __future__ import annotations

import json
import tempfile
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linetrace.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` on all cores, where a table has fewer files than there are cores."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(2 * cores) if len(rows.inputFiles()) < cores else rows


def lines(docs: DataFrame) -> DataFrame:
    """Canonical lines of documents: a passage is a document, a line ends at a full stop or line
    feed; lines of fewer than three words are headings."""
    cut = docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", "[.\n]")).alias("line_no", "text"))
    cut = cut.withColumn("text", F.trim("text")).filter("text <> ''").withColumn("norm", T.normalize(F.col("text")))
    return cut.select(
        F.concat_ws(":", "doc_id", "line_no").alias("id"), F.col("doc_id").alias("passage_id"), (F.col("doc_id") % 1430 + 1).alias("page"), F.col("line_no").cast("long").alias("line_no"),
        F.when(F.size(T.tokens(F.col("norm"))) < 3, "heading").otherwise("pankti").alias("line_type"), "text", "norm", (F.col("doc_id") * 100000 + F.col("line_no")).alias("order_id"), "lang", "source",
    )


def indexable(rows: DataFrame, exclude_headings: bool = True) -> DataFrame:
    """Lines with text after normalisation, headings left out unless asked for."""
    kept = rows.filter("norm is not null and norm <> ''")
    return kept.filter("line_type <> 'heading'") if exclude_headings else kept


def corpus_index(rows: DataFrame) -> DataFrame:
    """The derived columns that matching uses."""
    toks = T.tokens(F.col("norm"))
    return rows.withColumn("n_tokens", F.size(toks).cast("long")).withColumn("first_letters", T.first_letters(toks)).withColumn("phonetic", T.phonetic_key(T.first_letters(toks)))


def corpus_view(lines: DataFrame, passages: DataFrame, line_types: DataFrame, transliterations: DataFrame, language_id: int, source_id: int | None = None) -> DataFrame:
    """The corpus star: lines (id, passage_id, type_id, order_id ...) of known passages (passage_id,
    source_id), with the name of their type (type_id, type_name) and their transliteration (line_id,
    language_id, latin) in one language, where they have them."""
    kept = passages if source_id is None else passages.filter(F.col("source_id") == source_id)
    latin = transliterations.filter(F.col("language_id") == language_id).select(F.col("line_id").alias("id"), "latin")
    return lines.join(kept, "passage_id").join(line_types, "type_id", "left").join(latin, "id", "left")


def passage_lines(lines: DataFrame, passages: DataFrame) -> DataFrame:
    """All lines of the given passages (passage_id), whatever their source, in canonical order."""
    return lines.join(passages.select("passage_id").distinct(), "passage_id", "left_semi").orderBy("order_id")


def canonical(lines: DataFrame) -> DataFrame:
    """Lines in the order of the corpus, equal places by id."""
    return lines.orderBy("order_id", "id")


BULKY = ("pronunciation", "pronunciation_information")


def drop_bulk_columns(rows: DataFrame, columns: tuple[str, ...] = BULKY) -> DataFrame:
    """``rows`` with null in the long text columns that a small copy does without."""
    kinds = dict(rows.dtypes)
    return rows.withColumns({c: F.lit(None).cast(kinds[c]) for c in columns if c in kinds})


def scoped(lines: DataFrame, prefix: str) -> DataFrame:
    """Lines whose source begins with ``prefix``; a scope without any line is an error."""
    kept = lines.filter(F.startswith("source", F.lit(prefix)))
    if kept.isEmpty():
        raise ValueError(f"no line has a source that begins with {prefix!r}")
    return kept


def expect(kept: DataFrame, least: int, what: str = "rows") -> DataFrame:
    """``kept``, with a warning if it has fewer than ``least`` rows."""
    n = kept.limit(least).count() if least else 0
    if n < least:
        warnings.warn(f"{n} {what} kept, at least {least} were expected", stacklevel=2)
    return kept


def curated(rows: DataFrame, kept: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``columns`` are among those of ``kept``, and how many rows of each went."""
    keys = kept.select(*columns).distinct()
    return rows.join(keys, columns, "left_semi"), rows.join(keys, columns, "left_anti").groupBy(*columns).agg(F.count("*").alias("removed"))


def write_curated(rows: DataFrame, kept: DataFrame, columns: list[str], path: str) -> None:
    """The curated rows without their bulky columns as Parquet, and the removed counts beside them."""
    left, removed = curated(rows, kept, columns)
    drop_bulk_columns(left).write.mode("overwrite").parquet(f"{path}/rows")
    removed.write.mode("overwrite").parquet(f"{path}/removed")


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share, ``spark.checkpoint.dir``; a temporary
    one only where that is unset and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", found := f"file://{tempfile.mkdtemp(prefix='linetrace-')}")
    return f"{found}/files-{uuid.uuid4().hex}"


def stashed(rows: DataFrame) -> DataFrame:
    """``rows`` written to the shared folder and read again."""
    path = shared_dir(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def words(conversations: DataFrame) -> DataFrame:
    """Timed words of conversations: a turn starts every ten seconds, a word every 0.4."""
    cut = conversations.select("conv_id", "turn", F.posexplode(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")).alias("pos", "word"))
    start = F.round(F.col("turn") * 10 + F.col("pos") * 0.4, 3)
    return cut.select(F.col("conv_id").alias("sample_id"), F.col("turn").cast("long").alias("seg"), F.col("pos").cast("long").alias("pos"), "word", start.alias("start_sec"), F.round(start + 0.4, 3).alias("end_sec"))


def window_hypotheses(conversations: DataFrame) -> DataFrame:
    """One hypothesis a turn, with page, line and scores that follow from the text's length."""
    n = F.length("text")
    page = F.when(n % 7 != 0, F.col("conv_id") % 1430 + 1)
    return conversations.select(
        F.col("conv_id").alias("sample_id"), F.col("turn").cast("long").alias("seq"), (F.col("turn") * 10).cast("double").alias("start_sec"), (F.col("turn") * 10 + n % 9 + 4).cast("double").alias("end_sec"),
        page.alias("page"), F.when(n % 7 != 0, n % 2).cast("long").alias("line_no"), F.when(n % 7 != 0, (F.col("conv_id") * 3 + F.col("turn")) % 400).cast("long").alias("passage_id"), ((n * 7) % 101).cast("double").alias("confidence"), ((n % 11) / 10.0).alias("coverage"), "text",
    )


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """Word captures: one JSON file a sample, words in an array; the duration is the last end."""
    schema = "sample_id string, words array<struct<start: double, end: double, word: string>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.select("sample_id", F.array_max(F.transform("words", lambda w: w["end"])).alias("duration_sec"), F.posexplode("words").alias("pos", "w")).select("sample_id", "duration_sec", "pos", "w.*")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Samples of a registry file, with the display name of their category and the targets."""
    sample = "id string, filename string, audio_sha256 string, duration_sec double, jatha string, raag string, ang_start int, ang_end int, recording_quality string, difficulty string, categories array<string>, alignment_status string, alignment_file string"
    schema = f"raags map<string, struct<display: string, sggs_position: int>>, coverage_targets_v1 struct<high_tier_audio_hours: double, distinct_jathas: int, distinct_raags: int, distinct_pangtis: int>, samples array<struct<{', '.join(x.replace(' ', ': ', 1) for x in sample.split(', '))}>>"
    whole = spark.read.schema(schema).option("multiLine", True).json(path)
    return whole.select(F.explode("samples").alias("s"), "raags", "coverage_targets_v1").select("s.*", F.col("raags")[F.col("s.raag")]["display"].alias("raag_display"), F.col("coverage_targets_v1").alias("targets"))


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """Spans of alignment envelopes with their index; a broken file is a row with only ``broken``."""
    span = "start_sec: double, end_sec: double, kind: string, ang: int, pangti_index: int, text_latin: string, text_gurmukhi: string, match_confidence: double, coverage: double, alignment_quality: string, repeat_group_id: string"
    rows = spark.read.schema(f"audio_file string, audio_sha256 string, duration_sec double, segments array<struct<{span}>>, broken string").option("multiLine", True).option("columnNameOfCorruptRecord", "broken").json(path)
    return rows.select("audio_file", "audio_sha256", "broken", F.posexplode_outer("segments").alias("idx", "s")).select("audio_file", "audio_sha256", "broken", "idx", "s.*")


def audio_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Files with size and content hash."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("audio_sha256"))


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """Names and times of the files under ``path``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("modificationTime").alias("mtime"))


def alignment_state(spark: SparkSession, samples: DataFrame, alignments: str, audio: str) -> DataFrame:
    """``samples`` (sample_id, filename, alignment_file) with what their files are: ``reason`` is missing
    where there is no alignment, broken where it is no JSON, stale where the audio is newer, else ok.
    Every sample stays, so that a report can name it."""
    own = _listed(spark, alignments).select(F.col("file").alias("a"), F.col("mtime").alias("aligned_at"))
    heard = _listed(spark, audio).select(F.col("file").alias("h"), F.col("mtime").alias("heard_at"))
    whole = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(alignments)
    bad = whole.filter(F.get_json_object("value", "$").isNull()).select(F.col("_metadata.file_name").alias("b")).distinct()
    name = F.element_at(F.split("alignment_file", "/"), -1)
    met = samples.join(own, name == F.col("a"), "left").join(heard, F.col("filename") == F.col("h"), "left").join(bad, F.col("a") == F.col("b"), "left")
    reason = F.when(F.col("a").isNull(), "missing").when(F.col("b").isNotNull(), "broken").when(F.col("heard_at") > F.col("aligned_at"), "stale").otherwise("ok")
    return met.select(*[samples[c] for c in samples.columns], "aligned_at", reason.alias("reason"))


def uncached_files(spark: SparkSession, audio: str, cache: str, model: str) -> DataFrame:
    """Audio files (sample, mtime) whose result in the cache (``cache/model/sample.json``) is missing or
    older, by the times of the files."""
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    sources = _listed(spark, audio).select(F.lit(model).alias("model"), stem.alias("sample"), "mtime")
    return uncached(sources, _listed(spark, f"{cache}/{model}").select(F.lit(model).alias("model"), stem.alias("sample"), "mtime"))


def uncached(sources: DataFrame, cache: DataFrame) -> DataFrame:
    """Source rows (model, sample, mtime) without a cached result that is at least as new."""
    cached = cache.select(F.col("model").alias("m"), F.col("sample").alias("s"), F.col("mtime").alias("t"))
    return sources.join(cached, (F.col("model") == F.col("m")) & (F.col("sample") == F.col("s")) & (F.col("t") >= F.col("mtime")), "left_anti")


def frames(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tagged JSON frames decoded into columns, and the frames of unknown type or broken payload."""
    schema = "type string, seq long, score double, text string"
    parsed = events.withColumn("f", F.from_json("payload", schema))
    known = F.coalesce(F.col("f.type").isin("ready", "partial", "match", "jaikara", "no_match", "ping"), F.lit(False))
    good = parsed.filter(known).select("session_id", "ts", "f.type", F.coalesce("f.seq", F.lit(-1)).alias("seq"), F.coalesce("f.score", F.lit(0.0)).alias("score"), F.coalesce("f.text", F.lit("")).alias("text"))
    return good, parsed.filter(~known).drop("f")


def read_comparisons(spark: SparkSession, path: str) -> DataFrame:
    """Rows of comparison files, one file a run: the results of several providers for one clip."""
    row = "provider: string, elapsed_ms: double, transcript: string, error: string"
    runs = spark.read.schema(f"id string, created_at string, rows array<struct<{row}>>").option("multiLine", True).json(path)
    return runs.select("id", "created_at", F.explode("rows").alias("r")).select("id", "created_at", "r.*", F.col("r.error").isNull().alias("ok"))


#: What a row must be like to be part of a build.
PREDICATE = {"tiers": ["high", "medium"], "kinds": ["line"], "require_text": True, "exclude_repeat_groups": True, "recording_qualities": ["clean_live", "studio"]}


def write_manifest(report: DataFrame, samples: DataFrame, build_id: DataFrame, path: str, splits: DataFrame | None = None) -> None:
    """A manifest: one line of JSON with build id, predicate, the rows of each split (split, rows) and
    the report as coverage; the samples beside it."""
    one = report.select(F.struct(*report.columns).alias("coverage")).first()
    said = build_id.select(F.col("build_id").alias("id"), F.from_json(F.lit(json.dumps(PREDICATE)), "tiers array<string>, kinds array<string>, require_text boolean, exclude_repeat_groups boolean, recording_qualities array<string>").alias("eligibility_predicate"))
    coverage = F.from_json(F.lit(json.dumps(one.coverage.asDict(), default=str)), report.schema)
    said = said.withColumn("coverage", coverage)
    if splits is not None:
        counts = {r.split: r.rows for r in splits.collect()}  # three splits
        said = said.withColumn("splits", F.struct(*[F.struct(F.lit(f"split={k}").alias("folder"), F.lit(n).alias("rows")).alias(k) for k, n in sorted(counts.items())]))
    said.write.mode("overwrite").json(f"{path}/build")
    samples.write.mode("overwrite").json(f"{path}/samples")


def write_json_splits(rows: DataFrame, path: str) -> None:
    """One folder of JSON a split, floats to three places."""
    kinds = dict(rows.dtypes)
    rows.select([F.round(c, 3).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in rows.columns]).write.partitionBy("split").mode("overwrite").json(path)


def write_alignments(spans: DataFrame, path: str) -> None:
    """The envelopes as JSON, one line a sample."""
    envelopes(spans).write.mode("overwrite").json(path)


def envelopes(spans: DataFrame) -> DataFrame:
    """One row a sample: its spans in order and the number of each tier."""
    span = F.struct("start_sec", "end_sec", "kind", "page", "line_no", "tier")
    tiers = F.map_from_arrays(F.array(*map(F.lit, ("high", "medium", "needs_review", "n/a"))), F.array(*[F.count_if(F.col("tier") == t) for t in ("high", "medium", "needs_review", "n/a")]))
    return spans.groupBy("sample_id").agg(F.count("*").alias("segment_count"), F.max("end_sec").alias("duration_sec"), tiers.alias("tier_counts"), F.sort_array(F.collect_list(span)).alias("segments"))


def readings(lines: DataFrame) -> DataFrame:
    """Utterances of readers (session_id, us, seq, text, interjection): a session reads the lines of four
    passages in order, a line every four seconds with pauses, some of them garbled or not heard."""
    k, at = (F.col("line_no") * 7 + F.col("passage_id")) % 10, F.col("line_no") % 40
    half = F.array_join(F.filter(T.tokens(F.col("norm")), lambda x, i: i % 2 == 0), " ")
    text = F.when(at.between(20, 31), "zzz yyy").when(k.isin(7, 8), half).otherwise(F.col("norm"))
    seconds = (F.col("passage_id") % 4 * 100_000 + F.col("line_no")) * 4 + F.floor(F.col("line_no") / 11) * 12
    us = (1_700_000_000 + seconds) * 1_000_000
    return lines.select(F.floor(F.col("passage_id") / 4).alias("session_id"), us.alias("us"), F.col("order_id").alias("seq"), text.alias("text"), (at == 25).alias("interjection"))
