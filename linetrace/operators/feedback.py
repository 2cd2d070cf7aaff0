"""Corrections from users: validation, pseudonyms, erasure, review, and request logs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linetrace.functions.text import pseudonymize
from linetrace.streaming import machines
from linetrace.streaming.sinks import CommittedTable

# Kinds of corrections that users send.
TYPES = ("wrong_pangti", "wrong_shabad", "not_gurbani", "unknown", "partial_match")
NEWEST = 500


#: Longest texts of the wire format.
LONGEST = {
    "app_version": 64, "platform": 64, "model_size": 32, "device_class": 32, "audio_base64": 2_000_000, "audio_codec": 32, "mode": 32, "matcher_window_text_latin": 4000,
    "match.shabad_id": 64, "match.line_type": 32, "correction.notes": 2000,
}
#: Numbers that must not be negative, where they are given.
COUNTS = ("match.ang", "match.pangti", "correction.ang", "correction.pangti")


def issues(rules: list[tuple[Column, str]]) -> Column:
    """Names of the rules that are broken; a test without an answer is broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for ok, name in rules]))


def _has(rows: DataFrame, name: str) -> bool:
    top, _, rest = name.partition(".")
    kind = rows.schema[top].dataType if top in rows.columns else None
    return kind is not None and (not rest or rest in kind.fieldNames())


def validate(rows: DataFrame) -> DataFrame:
    """``rows`` of the wire format (session_token, correction with its type, and optional fields, match
    among them) with ``issues``, the fields that break a rule.  Optional fields may be null or
    missing as columns; columns that the format does not know pass."""
    maybe = lambda ok: F.coalesce(ok, F.lit(True))
    rules = [(F.length("session_token").between(8, 256), "session_token"), (F.col("correction.type").isin(*TYPES), "correction.type")]
    rules += [(maybe(F.length(name) <= most), name) for name, most in LONGEST.items() if _has(rows, name)]
    rules += [(maybe(F.col(name) >= 0), name) for name in COUNTS if _has(rows, name)]
    if _has(rows, "audio_duration_sec"):
        rules.append((maybe(F.col("audio_duration_sec").between(0, 60)), "audio_duration_sec"))
    return rows.withColumn("issues", issues(rules))


def ingest(rows: DataFrame, secret: str) -> DataFrame:
    """Valid rows as they are stored: nested fields flattened, a pseudonym in place of the token, no
    audio bytes, an id and the time of receipt in milliseconds where they have none."""
    good = validate(rows).filter(F.size("issues") == 0)
    flat = []
    for top in ("match", "correction"):
        if top in rows.columns:
            flat += [F.col(f"{top}.{f}").alias(f"{top}_{f}") for f in rows.schema[top].dataType.fieldNames()]
    plain = [c for c in rows.columns if c not in ("session_token", "audio_base64", "match", "correction", "id", "received_at_ms")]
    own = [F.col("id") if "id" in rows.columns else F.expr("uuid()").alias("id")]
    own += [F.col("received_at_ms") if "received_at_ms" in rows.columns else F.unix_millis(F.current_timestamp()).alias("received_at_ms")]
    return good.select(*own, pseudonymize(F.col("session_token"), secret).alias("session_hmac"), *plain, *flat)


def append_feedback(rows: DataFrame, secret: str, path: str, name: str | None = None) -> None:
    """Appends valid rows to the store of ``path``, once for each ``name`` of a batch.  The batches of a
    stream are named by their numbers, so one that runs again is not stored twice."""
    stored, table = ingest(rows, secret), CommittedTable(rows.sparkSession, path)
    if not rows.isStreaming:
        table.append(name or uuid.uuid4().hex, {"feedback": stored})
        return
    named = name or "stream"
    writer = stored.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/_progress")
    writer.foreachBatch(lambda batch, k: table.append(f"{named}-{k:09d}", {"feedback": batch}) and None).start().awaitTermination()


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    return CommittedTable(spark, path).read("feedback")


def erase_stored(spark: SparkSession, path: str, tokens: DataFrame) -> int:
    """Erases the sessions of ``tokens`` from the store of ``path``: the files that hold them are written
    again without them, all others stay.  Returns how many files that were."""
    keys = ["session_hmac", "id"] if "id" in tokens.columns else ["session_hmac"]
    return CommittedTable(spark, path).erase("feedback", lambda rows: rows.join(tokens, keys, "left_semi"), lambda rows: erase(rows, tokens))


def newest(rows: DataFrame, key: str, n: int = NEWEST) -> DataFrame:
    """The newest rows of every session."""
    w = W.partitionBy(key).orderBy(F.col("received_at").desc(), F.col("id").desc())
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def erase(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """What remains when the sessions of ``tokens`` (session_hmac, and id to erase one row) go; an id
    goes only with the session that owns it."""
    keys = ["session_hmac", "id"] if "id" in tokens.columns else ["session_hmac"]
    return rows.join(tokens, keys, "left_anti")


def erased(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """How many rows of each session ``erase`` takes; sessions that own none are listed with 0."""
    keys = ["session_hmac", "id"] if "id" in tokens.columns else ["session_hmac"]
    gone = rows.join(tokens.distinct(), keys, "left_semi").groupBy("session_hmac").agg(F.count("*").alias("erased"))
    return tokens.select("session_hmac").distinct().join(gone, "session_hmac", "left").select("session_hmac", F.coalesce("erased", F.lit(0).cast("long")).alias("erased"))


def corrections_to_labels(corrections: DataFrame, decisions: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted corrections as labelled rows with the line that they name, and what remains in the
    queue: rows without a decision.  ``corrections`` (id, page, line_no, notes), ``decisions`` (id,
    accepted), ``lines`` with page, line_no, order_id and text."""
    first = lines.groupBy("page", "line_no").agg(F.min_by(F.struct("id", "text"), "order_id").alias("line"))
    accepted = corrections.join(decisions.filter("accepted").select("id").distinct(), "id", "left_semi")
    labels = accepted.join(first, ["page", "line_no"]).select("id", "page", "line_no", F.col("line.id").alias("line_id"), F.col("line.text").alias("sentence"), F.lit("human").alias("labeled_by"))
    return labels, corrections.join(decisions.select("id").distinct(), "id", "left_anti")


def review_queue(spans: DataFrame) -> DataFrame:
    return spans.filter("tier = 'needs_review'").groupBy("sample_id", "repeat_group").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"))


def apply_review(spans: DataFrame, decisions: DataFrame) -> DataFrame:
    """The latest decision on a span replaces its tier."""
    latest = decisions.groupBy("sample_id", "idx").agg(F.max_by("new_tier", "decided_at").alias("new_tier"))
    joined = spans.join(latest, ["sample_id", "idx"], "left")
    return joined.withColumn("labeled_by", F.when(F.col("new_tier").isNotNull(), "human").otherwise("auto")).withColumn("tier", F.coalesce("new_tier", "tier")).drop("new_tier")


def redact_log(rows: DataFrame) -> DataFrame:
    """Of each request the method, the path without its query, the status, and of an error its type,
    code and message; nothing else.  Columns that a log lacks are left out."""
    path = F.coalesce(F.substring_index("url", "?", 1), F.lit("")).alias("path")
    kept = [F.col(c) for c in ("method", "status", "error_type", "error_code", "error_message") if c in rows.columns]
    return rows.select("id", path, *kept)


def rate_limit(hits: DataFrame, limit: int, window_s: int) -> DataFrame:
    """``allowed``, ``remaining`` and ``reset`` for each hit of (key, ts, id): fewer than ``limit``
    accepted hits in the window before it, its edge included.  Rejected hits don't count, so the rule
    is greedy: an ordered fold over the hits of one key.  ``reset`` is when the oldest accepted hit of
    the window leaves it."""
    rows = hits.select("key", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "id")
    kind = {"bigint": "long", "int": "long"}.get(dict(hits.dtypes)["key"], "string")
    out = machines.fold(rows, lambda: machines.Limiter(limit, window_s), ["us", "id"], f"key {kind}, us long, id long, allowed boolean, remaining long, reset long")
    return out.select("key", F.timestamp_micros("us").alias("ts"), "id", "allowed", "remaining", F.timestamp_micros("reset").alias("reset"))


def monthly_quota(hits: DataFrame, limit: int = 50) -> DataFrame:
    w = W.partitionBy("key", F.date_format("ts", "yyyy-MM")).orderBy("ts", "id")
    return hits.withColumn("accepted", F.row_number().over(w) <= limit)
