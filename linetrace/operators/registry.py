"""Recordings of a registry: names, fields, files, and what may be admitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linetrace.operators.dataset import first_reason
from linetrace.operators.feedback import issues

# The registry's enumerations and limits.
DIFFICULTIES = ("studio", "live", "noisy", "nagar_kirtan", "kid", "instrumental", "archival", "broadcast", "paath_recitation", "simran")
QUALITIES = ("studio", "clean_live", "live_mic", "noisy_live", "archival", "broadcast")
STATUSES = ("pending", "in_progress", "machine_aligned", "human_reviewed", "excluded")
TRADITIONS = ("akj", "taksali", "damdami", "modern", "traditional", "mixed", "unknown")
SOURCES = ("youtube", "gurdwara_direct", "broadcaster", "personal_recording", "archived_dataset")
NAMED_FILES, PAGES = ("mp3", "wav", "m4a", "flac"), 1430
AUDIO_FILES, MOST_BYTES, MOST_SECONDS = ("wav", "mp3", "m4a", "flac", "ogg"), 10 * 1024 * 1024, 60


def parse_sample_name(filename: Column) -> Column:
    """singer, raag, page, line_no, difficulty and ext of a file name of five parts joined by
    underscores; page and line_no are null where unknown, and ``legacy`` marks other names."""
    pattern = rf"^([a-z0-9_]+?)_(unknown_raag|[a-z]+)_(\d+|unknown)_(\d+|unknown)_({'|'.join(DIFFICULTIES)})\.({'|'.join(NAMED_FILES)})$"
    fits = F.coalesce(filename.rlike(pattern), F.lit(False))
    part = lambda k: F.when(fits, F.regexp_extract(filename, pattern, k))
    number = lambda k: F.when(part(k) != "unknown", part(k)).try_cast("long")
    return F.struct(
        part(1).alias("singer"), part(2).alias("raag"), number(3).alias("page"), number(4).alias("line_no"), part(5).alias("difficulty"), part(6).alias("ext"), (~fits).alias("legacy")
    )


def registry_problems(samples: DataFrame, raags: DataFrame) -> DataFrame:
    """Samples of a registry with ``issues``, the fields that break a rule: enumerations, pages, the
    64 hex digits of the audio hash, and raags that the taxonomy ``raags`` (raag) lacks.  Optional
    fields may be null."""
    maybe = lambda ok: F.coalesce(ok, F.lit(True))
    known = samples.join(raags.select("raag", F.lit(True).alias("known")).distinct(), "raag", "left")
    rules = [
        (F.length("id") > 0, "id"), (F.col("audio_sha256").rlike("^[0-9a-f]{64}$"), "audio_sha256"), (F.col("known"), "raag"), (maybe(F.col("ang_start").between(1, PAGES)), "ang_start"),
        (maybe(F.col("ang_end").between(1, PAGES)) & maybe(F.col("ang_end") >= F.col("ang_start")), "ang_end"), (F.col("recording_quality").isin(*QUALITIES), "recording_quality"),
        (F.col("difficulty").isin(*DIFFICULTIES), "difficulty"), (F.col("alignment_status").isin(*STATUSES), "alignment_status"), (maybe(F.col("duration_sec") >= 0), "duration_sec"),
    ]
    for name, values in (("jatha_tradition", TRADITIONS), ("source_type", SOURCES)):
        if name in samples.columns:
            rules.append((maybe(F.col(name).isin(*values)), name))
    return known.withColumn("issues", issues(rules)).drop("known")


def admission(files: DataFrame) -> DataFrame:
    """``reason`` for each file (name, mime, bytes, duration_sec): the first rule that it breaks, or ok.
    Either the name or the kind must say that it is audio."""
    ext = F.lower(F.regexp_extract(F.coalesce("name", F.lit("")), r"\.([^./\\]+)$", 1))
    audio = F.startswith(F.coalesce("mime", F.lit("")), F.lit("audio/")) | ext.isin(*AUDIO_FILES)
    return files.withColumn(
        "reason",
        first_reason((~audio, "unsupported_media_type"), (F.col("bytes") > MOST_BYTES, "file_too_large"), (F.col("bytes") == 0, "empty_audio_file"), (F.col("duration_sec").isNull(), "unreadable_audio"),
                     (F.col("duration_sec") > MOST_SECONDS, "audio_too_long")),
    )
