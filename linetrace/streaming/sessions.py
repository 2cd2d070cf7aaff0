"""Rules of live sessions over ordered events, as window functions; the rules that carry a state from
event to event are machines of ``linetrace.streaming.machines``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linetrace.streaming import machines

#: Statuses from the one that wins to the one that yields; an error sticks.
PRECEDENCE = ("recording", "processing", "listening")


def _us(ts):
    """Microseconds of a timestamp, with or without time zone."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def _order(*more: str):
    return W.partitionBy("session_id").orderBy("ts", *more)


def drop_stale(events: DataFrame) -> DataFrame:
    """Drops events whose seq is below the highest before them in arrival order."""
    high = F.max("seq").over(_order("seq").rowsBetween(W.unboundedPreceding, -1))
    return events.withColumn("high", high).filter("high is null or seq >= high").drop("high")


def debounce(events: DataFrame, seconds: float = 0.3) -> DataFrame:
    """Keeps an update if no other follows within ``seconds`` and its text is not the last one's."""
    w = _order("seq")
    gap = F.lead(_us("ts")).over(w) - _us("ts")
    rows = events.withColumn("gap", gap).filter(F.col("gap").isNull() | (F.col("gap") >= seconds * 1e6))
    return rows.withColumn("before", F.lag("text").over(w)).filter("before is null or before <> text").drop("gap", "before")


def status_changes(events: DataFrame) -> DataFrame:
    """Transitions of the status (session_id, ts, seq, status): of the statuses of one moment the first
    by precedence counts, nothing follows an error, and a status like the one before is dropped."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, PRECEDENCE)), F.col("status")), F.lit(0))
    rank = F.when(F.col("status") == "error", -1).when(rank == 0, len(PRECEDENCE) + 1).otherwise(rank)
    tick = W.partitionBy("session_id", "ts").orderBy("rank", "seq")
    firsts = events.withColumn("rank", rank).withColumn("place", F.row_number().over(tick)).filter("place = 1").drop("rank", "place")
    w = _order("seq")
    failed = F.max((F.col("status") == "error").cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = firsts.withColumn("failed", F.coalesce(failed, F.lit(0))).filter("failed = 0").drop("failed")
    return rows.withColumn("before", F.lag("status").over(w)).filter("before is null or before <> status").drop("before")


def rolling_windows(events: DataFrame, length: str = "5 seconds", slide: str = "800 milliseconds", least: float = 0.0) -> DataFrame:
    """Events of the last ``length``, looked at every ``slide``; a look whose events span less than
    ``least`` seconds is left out."""
    by = events.groupBy("session_id", F.window("ts", length, slide)).agg(F.count("*").alias("n"), F.max("score").alias("best"), (F.max(_us("ts")) - F.min(_us("ts"))).alias("span"))
    return by.filter(F.col("span") >= least * 1e6).select("session_id", F.col("window.start").alias("start"), "n", "best")


def tumbling(events: DataFrame, length: str = "2 seconds") -> DataFrame:
    return events.groupBy("session_id", F.window("ts", length)).agg(F.count("*").alias("n"), F.max("score").alias("best")).select("session_id", F.col("window.start").alias("start"), "n", "best")


def merge_sources(events: DataFrame) -> DataFrame:
    """Preliminary rows are dropped once the canonical source has said something."""
    seen = F.max((F.col("canonical") & (F.col("text") != "")).cast("int")).over(_order("seq").rowsBetween(W.unboundedPreceding, 0))
    return events.withColumn("seen", seen).filter("canonical or seen = 0").drop("seen")


def silence_stop(events: DataFrame, seconds: float = 2.5, level: float = 0.02) -> DataFrame:
    """``stopped``: speech was heard, and not for longer than ``seconds`` since."""
    heard = F.last(F.when(F.col("score") > level, F.col("ts")), ignorenulls=True).over(_order("seq").rowsBetween(W.unboundedPreceding, 0))
    quiet = (_us("ts") - _us(heard)) > seconds * 1e6
    return events.withColumn("stopped", F.coalesce(quiet, F.lit(False)))


def self_correct(events: DataFrame, least: float = 90.0) -> DataFrame:
    """``shown`` after each event: a transcript (text) or a pass of the matcher (matched, score).  While
    the last pass scored ``least`` or more its canonical text stays, else the last transcript shows."""
    so_far = _order("seq").rowsBetween(W.unboundedPreceding, 0)
    last = F.last(F.when(F.col("matched").isNotNull(), F.struct("matched", "score")), ignorenulls=True).over(so_far)
    said = F.last("text", ignorenulls=True).over(so_far)
    return events.withColumn("shown", F.when(last["score"] >= least, last["matched"]).otherwise(said))


def auto_select(events: DataFrame, least: float = 90.0, seconds: float = 1.0) -> DataFrame:
    """Runs of one text that last ``seconds``, during which it alone scores ``least`` or more: at each
    moment (ts) of the run exactly one text does."""
    high = events.filter(F.col("score") >= least).groupBy("session_id", "ts").agg(F.count_distinct("text").alias("texts"), F.min("text").alias("one"))
    ticks = events.select("session_id", "ts").distinct().join(high, ["session_id", "ts"], "left").select("session_id", "ts", F.when(F.col("texts") == 1, F.col("one")).alias("text"))
    w = _order()
    new = ~F.coalesce(F.col("text") == F.lag("text").over(w), F.lit(False))
    runs = ticks.withColumn("run", F.sum(new.cast("int")).over(w)).filter("text is not null").groupBy("session_id", "run", "text").agg(F.min("ts").alias("since"), F.max("ts").alias("until"))
    return runs.filter(_us("until") - _us("since") >= seconds * 1e6).select("session_id", "text", "since", "until")


def banner_ttl(events: DataFrame, seconds: float = 3.0) -> DataFrame:
    """Stretches during which a banner shows; a newer one restarts the time."""
    w = _order("seq")
    far = F.coalesce(_us("ts") - F.lag(_us("ts")).over(w) > seconds * 1e6, F.lit(True))
    runs = events.withColumn("run", F.sum(far.cast("int")).over(w)).groupBy("session_id", "run").agg(F.min("ts").alias("since"), F.max("ts").alias("last"), F.count("*").alias("n"))
    return runs.select("session_id", "since", F.timestamp_micros(_us("last") + int(seconds * 1e6)).alias("until"), "n")


def warmup_gate(events: DataFrame, seconds: float = 1.5, level: float = 0.1) -> DataFrame:
    """Drops stops in the first moments of a session before any energy."""
    begun = F.min("ts").over(_order("seq").rowsBetween(W.unboundedPreceding, 0))
    loud = F.max("score").over(_order("seq").rowsBetween(W.unboundedPreceding, 0)) > level
    early = _us("ts") - _us(begun) < seconds * 1e6
    return events.withColumn("ok", (F.col("text") != "stop") | ~early | loud).filter("ok").drop("ok")


def energy_guard(events: DataFrame, n: int = 8, level: float = 0.1) -> DataFrame:
    """Drops a longer text whose last ``n`` energies are all low (against the previous row)."""
    w = _order("seq")
    recent = w.rowsBetween(1 - n, 0)
    quiet = (F.max("score").over(recent) < level) & (F.count("score").over(recent) == n)
    grew = F.length("text") > F.coalesce(F.lag(F.length("text")).over(w), F.lit(0))
    return events.withColumn("lost", quiet & grew).filter("not lost").drop("lost")


def follow_batch(matches: DataFrame) -> DataFrame:
    """Positions of every session (session_id, ts, seq, passage_id, line_no, score)."""
    rows = matches.select("session_id", _us("ts").alias("us"), "seq", "passage_id", "line_no", "score")
    out = machines.fold(rows, machines.Follower, ["us", "seq"], "session_id long, us long, seq long, action string, passage_id long, line_no long")
    return out.select("session_id", F.timestamp_micros("us").alias("ts"), "seq", "action", "passage_id", "line_no")


def track_position(matches: DataFrame) -> DataFrame:
    """SEARCHING, LOCKED and DRIFTING of every session's matches (session_id, ts, seq, score)."""
    out = machines.fold(matches.select("session_id", _us("ts").alias("us"), "seq", "score"), machines.Tracker, ["us", "seq"], "session_id long, us long, seq long, mode string")
    return out.select("session_id", F.timestamp_micros("us").alias("ts"), "seq", "mode")


def freeze_last_good(events: DataFrame) -> DataFrame:
    """What every session shows after each of its events (session_id, ts, seq, text, canonical)."""
    out = machines.fold(events.select("session_id", _us("ts").alias("us"), "seq", "text", "canonical"), machines.Frozen, ["us", "seq"], "session_id long, us long, seq long, shown string")
    return out.select("session_id", F.timestamp_micros("us").alias("ts"), "seq", "shown")


def accumulated(parts: DataFrame, key: str = "session_id") -> DataFrame:
    """The transcript of each key's parts (key, seq, text) in the order of seq, overlaps joined once."""
    rows = parts.select(F.col(key).alias("session_id"), "seq", "text")
    out = machines.fold(rows, machines.Transcript, ["seq", "text"], "session_id long, seq long, parts long, transcript string", last_only=True)
    return out.select(F.col("session_id").alias(key), "parts", "transcript")


def active_keys(hits: DataFrame, seconds: float) -> DataFrame:
    """Keys with a hit in the last ``seconds`` of the table; the others have expired."""
    now = hits.agg(F.max(_us("ts"))).first()[0]
    last = hits.groupBy("key").agg(F.max("ts").alias("last"))
    return last.filter(F.lit(now) - _us("last") <= int(seconds * 1e6))
