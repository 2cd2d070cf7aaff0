"""One query for each operator, over whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linetrace.functions import text as T
from linetrace.functions.scoring import indel_ratio, token_coverage
from linetrace.operators import align, dataset, evaluate, feedback, lineindex, match, registry
from linetrace.sources import views
from linetrace.streaming import live, sessions, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SECRET = "a secret of enough length"


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _known(df: DataFrame, *columns: str) -> DataFrame:
    """Missing numbers as -1, which every reader shows alike."""
    return df.withColumns({c: F.coalesce(c, F.lit(-1)).cast("long") for c in columns})


def _t(spark, d, name):
    return views.table(spark, d, name)


def _lines(spark, d):
    return views.lines(views.dealt(_t(spark, d, "documents")))


def _kept_lines(spark, d):
    """The lines that searches meet, cut and normalised once for a query that reads them several times."""
    return views.stashed(views.indexable(_lines(spark, d)).select("order_id", "passage_id", "norm"))


def _search(spark, d) -> DataFrame:
    """The query set of the searches: windows of the benchmark items whose id is divisible by 100."""
    items = _t(spark, d, "benchmark").filter("item_id % 100 = 0")
    rows = items.select(F.col("item_id").alias("sample_id"), F.lit(0).alias("seg"), F.lit(0.0).alias("start_sec"), F.lit(10.0).alias("end_sec"), T.normalize(F.col("text")).alias("text"))
    return align.token_windows(rows).select(F.concat_ws(":", "sample_id", "word_start").alias("query_id"), F.col("text").alias("query"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Best line of every searched window, its lead over the runner-up and its label."""
    found = match.fuzzy_topk_join(_search(spark, d), views.indexable(_lines(spark, d)), 2)
    return match.runner_up_gate(found).select("query_id", "order_id", F.round("score", 6).alias("score"), "accepted", T.confidence_label(F.col("score"), F.col("runner_up")).alias("label"))


# --- Sources, corpus and projections
def _latin(lines):
    """Transliterations of lines in two languages, missing for some."""
    both = F.explode(F.array(F.lit(1), F.lit(2))).alias("language_id")
    rows = lines.filter("line_no % 5 <> 4").select(F.col("id").alias("line_id"), both, "norm")
    return rows.select("line_id", "language_id", F.concat_ws("|", "language_id", T.strip_final_schwa(F.col("norm"))).alias("latin"))


@query
def corpus_view(spark, d):
    """Lines with passage, type and transliteration, of the passages that are labelled."""
    lines = _lines(spark, d).withColumn("type_id", F.when(F.col("line_type") == "heading", 1).when(F.col("line_no") % 7 != 3, 2))
    passages = _t(spark, d, "labels").select(F.col("doc_id").alias("passage_id"), F.col("quality").cast("int").alias("source_id")).distinct()
    types = spark.createDataFrame([(1, "heading"), (2, "pankti"), (3, "rahao")], "type_id int, type_name string")
    return views.corpus_view(lines, passages, types, _latin(lines), 1, 1).select("id", "passage_id", "order_id", "type_name", "latin")


@query
def passage_lines(spark, d):
    some = _t(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("passage_id"))
    return views.passage_lines(_lines(spark, d), some).select("passage_id", "id", "order_id")


@query
def canonical_order(spark, d):
    return views.canonical(_lines(spark, d)).select("order_id", "id")


@query
def small_copy(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", F.col("c_name").alias("pronunciation"), "c_mktsegment")
    return views.drop_bulk_columns(c).select("c_custkey", F.coalesce("pronunciation", F.lit("-")).alias("pronunciation"), "c_mktsegment")


@query
def curated_copy(spark, d):
    """A curated subset written and read back, with what was removed."""
    docs, path = _t(spark, d, "documents").select("doc_id", "lang", "source"), views.shared_dir(spark)
    views.write_curated(docs, spark.createDataFrame([("en",), ("fr",)], "lang string"), ["lang"], path)
    kept = spark.read.parquet(f"{path}/rows").groupBy("lang").agg(F.count("*").alias("n"), F.lit("kept").alias("fate"))
    return kept.unionByName(spark.read.parquet(f"{path}/removed").select("lang", F.col("removed").alias("n"), F.lit("removed").alias("fate")))


@query
def line_view(spark, d):
    return _lines(spark, d).select("id", "page", "line_no", "line_type", "norm", "order_id")


@query
def corpus_index(spark, d):
    return views.corpus_index(views.indexable(_lines(spark, d))).select("id", "n_tokens", "first_letters", "phonetic")


@query
def corpus_count(spark, d):
    return _lines(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("line_type") == "heading").alias("headings"))


@query
def scope_source(spark, d):
    return views.scoped(_lines(spark, d), "src1").groupBy("source", "line_type").agg(F.count("*").alias("n"))


@query
def point_lookup(spark, d):
    keys = _t(spark, d, "benchmark").select((F.col("item_id") % 1430 + 1).alias("page"), (F.col("item_id") % 5).alias("line_no")).distinct()
    return _lines(spark, d).join(keys, ["page", "line_no"]).select("page", "line_no", "id", "order_id")


@query
def passage_display_lines(spark, d):
    return _lines(spark, d).filter(F.lower("line_type").isin("pankti", "rahao")).groupBy("passage_id").agg(F.count("*").alias("n"), F.min("order_id").alias("first_order"))


@query
def curate_languages(spark, d):
    kept = spark.createDataFrame([("en",), ("fr",)], "lang string")
    return _t(spark, d, "documents").join(F.broadcast(kept), "lang", "left_semi").select("doc_id", "lang", "source")


@query
def reading_scope(spark, d):
    bridge = _t(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("passage_id")).distinct()
    return _lines(spark, d).join(bridge, "passage_id", "left_semi").groupBy("page").agg(F.count("*").alias("n"))


@query
def uncached_transcripts(spark, d):
    c = _t(spark, d, "conversations").groupBy(F.col("conv_id").alias("sample")).agg(F.max("turn").alias("mtime")).withColumn("model", F.lit("m"))
    cache = _t(spark, d, "labels").select(F.col("doc_id").alias("sample"), (F.col("quality") * 5).cast("long").alias("mtime")).withColumn("model", F.lit("m"))
    return views.uncached(c, cache).select("sample", "mtime")


@query
def event_frames(spark, d):
    """Frames of four types, some unknown, some broken, some without their fields."""
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("click", "match", "view", "partial", "purchase", "jaikara")]), F.col("event_type"))
    whole = F.to_json(F.struct(F.coalesce(kind, F.lit("other")).alias("type"), F.when(F.col("event_id") % 4 != 0, F.col("event_id")).alias("seq"), F.col("value").alias("score")))
    payload = F.when(F.col("event_id") % 10 == 9, F.lit("{broken")).otherwise(whole)
    good, bad = views.frames(_t(spark, d, "events").select(F.col("user_id").alias("session_id"), "ts", payload.alias("payload")))
    return good.groupBy("type").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq")).unionByName(bad.agg(F.lit("aside").alias("type"), F.count("*").alias("n"), F.lit(-1).cast("long").alias("first_seq")))


# --- Text
@query
def text_functions(spark, d):
    b, t = _t(spark, d, "conversations"), F.col("text")
    return b.select("conv_id", "turn", T.normalize(t).alias("norm"), F.size(T.long_tokens(T.normalize(t))).cast("long").alias("n_long"), T.strip_marks(F.lower(t)).alias("plain"), T.is_repetition_loop(t).alias("loop"))


@query
def final_schwa(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", T.strip_final_schwa(F.lower("text")).alias("latin"))


def _scripts(spark, d):
    """Conversations of which two thirds are written in letters of one script or the other."""
    t = F.col("text")
    first, second = (F.translate(F.lower(t), "abcdeghiklmnoprstuy", "".join(chr(base + k) for k in (0x05, 0x2C, 0x1A, 0x26, 0x47, 0x17, 0x39, 0x3F, 0x15, 0x32, 0x2E, 0x28, 0x4B, 0x2A, 0x30, 0x38, 0x24, 0x41, 0x2F))) for base in (T.GURMUKHI, T.DEVANAGARI))
    return _t(spark, d, "conversations").withColumn("text", F.when(F.col("turn") % 3 == 0, first).when(F.col("turn") % 3 == 1, F.concat(second, F.lit("\u0964"))).otherwise(t))


@query
def transliterated(spark, d):
    return _scripts(spark, d).select("conv_id", "turn", T.to_latin(F.col("text")).alias("latin"))


@query
def recoded(spark, d):
    return _scripts(spark, d).select("conv_id", "turn", T.recode_script(F.col("text")).alias("text"))


#: Passes of a made-up legacy font: pre-clean, a reversed pair, a vowel written before its consonant.
FONT = [("[\\^~]", ""), ("qs", "sq"), ("i([bcdfg])", "$1i"), ("x", "ks")]


@query
def recoded_font(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", F.lower("c_name").alias("name"), F.lower("c_mktsegment").alias("segment"))
    return T.recode_columns(c, ["name", "segment"], FONT).select("c_custkey", "name_unicode", "segment_unicode")


def _font_table() -> dict[str, str]:
    """A font's table by a rule: letters and digits are places of a block of letters, some pairs have
    entries of their own, and what these give are again letters of the font."""
    single = {c: chr(0x0A05 + k) for k, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZbcdefghijklmnopqrstuvwxyz0123456789")}
    double = {f"{a}{b}": b.upper() + a for a in "aeou" for b in "nrst"}
    return single | double | {"a": "o", "ie": "y", "the": "d", "th": "T"}


FONT_RULES = {"dropped": ".;>", "pairs": ("sq", "ur", "yN"), "prefix": "i", "halves": "hrv"}


@query
def recoded_legacy(spark, d):
    """All texts and names of the documents by a compiled font."""
    recoded = T.recode_columns(_t(spark, d, "documents").select("doc_id", "text", "source"), ["text", "source"], T.legacy_font(_font_table(), **FONT_RULES))
    return recoded.select("doc_id", F.md5("text_unicode").alias("text_md5"), F.length("text_unicode").cast("long").alias("n"), "source_unicode")


@query
def good_transcripts(spark, d):
    said = F.when(F.col("turn") % 5 == 0, "Waiting for speech").when(F.col("turn") % 5 == 1, F.concat("text", F.lit("\ufffd"))).when(F.col("conv_id") % 7 == 0, "12 34").otherwise(F.col("text"))
    return T.drop_bad_transcripts(_t(spark, d, "conversations").withColumn("said", said), "said", "[a-z]").select("conv_id", "turn")


@query
def script_of(spark, d):
    return _scripts(spark, d).select("conv_id", "turn", T.detect_script(F.col("text")).alias("script"))


@query
def interjections(spark, d):
    short = _lines(spark, d).select("id", F.col("text"))
    return short.select("id", T.detect_interjection(F.col("text"), ("the", "and of", "que")).alias("seed")).filter("seed is not null")


@query
def clean_transcripts(spark, d):
    r = F.col("turn") % 4
    t = F.when(r == 0, F.concat(F.lit("Text: "), F.col("text"))).when(r == 1, F.concat(F.lit("```json\n"), F.col("text"), F.lit("\n```"))).when(r == 2, F.concat(F.lit("  TRANSCRIPTION:  "), F.col("text"))).otherwise(F.concat(F.col("text"), F.lit(" ")))
    return _t(spark, d, "conversations").select("conv_id", "turn", T.sanitize_transcript(t).alias("text"))


@query
def extract_payloads(spark, d):
    r = F.col("turn") % 3
    j = F.when(r == 0, F.to_json(F.struct(F.col("text").alias("transcript")))).when(r == 1, F.to_json(F.struct(F.struct("text").alias("data")))).otherwise(F.to_json(F.struct(F.lit("").alias("transcript"), "text")))
    return _t(spark, d, "conversations").select("conv_id", "turn", T.extract_transcript(j).alias("transcript"))


@query
def split_of(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.split_of(F.col("doc_id").cast("string")).alias("split"))


@query
def pseudonyms(spark, d):
    return _t(spark, d, "customer").select("c_custkey", T.pseudonymize(F.col("c_custkey").cast("string"), SECRET).alias("pseudonym"))


@query
def labels_and_keys(spark, d):
    e = _t(spark, d, "events")
    return e.select("event_id", T.slug(F.concat_ws(" ", F.upper("event_type"), F.lit("No. 5!"))).alias("slug"), T.mmss(F.col("event_id") % 5000).alias("mmss"), T.month_key(F.col("ts")).alias("month"), T.group_of(F.concat(F.col("event_type"), F.lit(" 12.wav"))).alias("grp"))


@query
def request_paths(spark, d):
    log = _t(spark, d, "pages").select(F.col("page_id").alias("id"), "url", F.lit("GET").alias("method"), (200 + F.col("page_id") % 3).alias("status"), F.lit("a token").alias("cookie"))
    return feedback.redact_log(log)


@query
def token_ratio(spark, d):
    """How alike the first words of parts' names are, and longer strings of them."""
    w = F.split(F.lower("p_name"), " ")
    p = _t(spark, d, "part").select("p_partkey", w[0].alias("a"), w[1].alias("b"), F.array_join(F.array_repeat(F.array_join(w, ""), 4), "").alias("long_a"), F.array_join(F.reverse(w), "").alias("long_b"))
    return p.select("p_partkey", F.round(indel_ratio(F.col("a"), F.col("b")), 6).alias("ratio"), F.round(indel_ratio(F.col("long_a"), F.col("long_b")), 6).alias("long_ratio"))


@query
def line_coverage(spark, d):
    """Coverage of each part's name by its brand and type."""
    p = _t(spark, d, "part").select("p_partkey", F.split(F.lower("p_name"), " ").alias("q"), F.split(F.lower(F.concat_ws(" ", "p_brand", "p_type")), " ").alias("t"))
    return p.select("p_partkey", F.round(token_coverage(F.filter("q", lambda x: F.length(x) >= 3), F.col("t")), 6).alias("coverage"))


# --- Matching
@query
def fuzzy_topk(spark, d):
    return match.fuzzy_topk_join(_search(spark, d), views.indexable(_lines(spark, d)), 5).select("query_id", "order_id", F.round("score", 6).alias("score"), "rank")


@query
def fuzzy_topk_prefiltered(spark, d):
    return match.prefiltered_topk_join(_search(spark, d), views.indexable(_lines(spark, d)), 5).select("query_id", "order_id", F.round("score", 6).alias("score"), "rank")


@query
def first_letters_live(spark, d):
    return match.first_letters_topk(_search(spark, d), views.indexable(_lines(spark, d)), 5).select("query_id", "order_id", F.round("score", 6).alias("score"), "rank")


@query
def fuzzy_scoped(spark, d):
    """Each searched window within the passages that hold the rarest of its words that any passage holds."""
    q, lines = _search(spark, d), _kept_lines(spark, d)
    asked = q.select("query_id", F.explode(F.array_distinct(T.tokens(F.col("query")))).alias("word"))
    held = lines.select("passage_id", F.explode(F.array_distinct(T.tokens(F.col("norm")))).alias("word"))
    held = views.stashed(held.join(F.broadcast(asked.select("word").distinct()), "word", "left_semi").distinct())
    rarest = asked.join(held.groupBy("word").count(), "word").groupBy("query_id").agg(F.min(F.struct("count", "word")).alias("r"))
    scopes = held.join(rarest.select("query_id", "r.word"), "word").select("query_id", "passage_id")
    return match.scoped_topk_join(q, lines, scopes, 3).select("query_id", "order_id", F.round("score", 6).alias("score"), "rank")


@query
def lines_nearby(spark, d):
    e = _t(spark, d, "benchmark").select(F.col("item_id").alias("event"), (F.col("item_id") * 100000 + 3).alias("at"))
    return match.nearby_lines(e, _lines(spark, d), 200).select("event", "id", "order_id")


def _ranked(spark, d):
    from pyspark.sql import Window as W

    s = F.round(F.least(F.col("value"), F.lit(100.0)), 3)
    e = _t(spark, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("order_id"), s.alias("score"))
    return e.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("order_id").desc())))


@query
def gate_and_label(spark, d):
    g = match.runner_up_gate(_ranked(spark, d))
    return g.select("query_id", "order_id", "score", "accepted", T.confidence_label(F.col("score"), F.col("runner_up")).alias("label"), T.coarse_label(F.col("score")).alias("coarse"), (F.col("score") >= 75).alias("confident"))


@query
def relative_cutoff(spark, d):
    return match.relative_cutoff(_ranked(spark, d), 0.8).groupBy("query_id").agg(F.count("*").alias("n"), F.max("rank").cast("long").alias("last"))


@query
def alternates(spark, d):
    return _ranked(spark, d).filter(F.col("rank").between(2, 5)).select("query_id", "order_id", F.col("rank").cast("long").alias("rank"))


# --- Windows and spans
def _segments(spark, d):
    c = _t(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("sample_id"), F.col("turn").cast("long").alias("seg"), (F.col("turn") * 10).cast("double").alias("start_sec"), (F.col("turn") * 10 + 10).cast("double").alias("end_sec"), "text")


def _spans(spark, d):
    return align.merge_windows(views.window_hypotheses(_t(spark, d, "conversations")))


def _durations(spark, d):
    return _t(spark, d, "conversations").groupBy(F.col("conv_id").alias("sample_id")).agg((F.max("turn") * 10 + 30).cast("double").alias("duration_sec"))


def _tiered(spark, d):
    edge = F.when(F.col("idx") % 4 != 0, (F.col("idx") % 10) / 10.0)
    return align.score_tier(align.detect_repeats(_spans(spark, d)).withColumn("boundary", edge))


@query
def token_windows(spark, d):
    return align.token_windows(_segments(spark, d))


@query
def word_windows(spark, d):
    return align.word_windows(views.words(_t(spark, d, "conversations")))


@query
def merged_spans(spark, d):
    return _known(_spans(spark, d), "page", "line_no")


@query
def repeats(spark, d):
    return align.detect_repeats(_spans(spark, d)).select("sample_id", "idx", "repeat_group")


@query
def gaps(spark, d):
    return align.detect_gaps(_spans(spark, d), views.words(_t(spark, d, "conversations")), _durations(spark, d))


@query
def span_tiers(spark, d):
    return _tiered(spark, d).select("sample_id", "idx", "kind", "repeat_group", "tier")


@query
def unsure_spans(spark, d):
    return align.reclass_unsure(_spans(spark, d)).groupBy("kind").agg(F.count("*").alias("n"))


@query
def overlap_suppressed(spark, d):
    return align.suppress_overlaps(_spans(spark, d)).select("sample_id", "idx", "confidence")


@query
def backward_jumps(spark, d):
    return align.backward_jumps(_spans(spark, d)).select("sample_id", "idx", "jump_back")


@query
def span_line_text(spark, d):
    return align.attach_line_text(_spans(spark, d), _lines(spark, d)).select("sample_id", "idx", "line_text")


@query
def aligned(spark, d):
    return align.align(views.window_hypotheses(_t(spark, d, "conversations")), views.words(_t(spark, d, "conversations")), _durations(spark, d)).select("sample_id", "start_sec", "end_sec", "kind", "tier")


@query
def envelopes(spark, d):
    return views.envelopes(_tiered(spark, d)).select("sample_id", "segment_count", "duration_sec", F.col("tier_counts")["high"].alias("high"), F.col("tier_counts")["needs_review"].alias("review"))


# --- Training sets
def _samples(spark, d):
    k = F.col("conv_id")
    return _t(spark, d, "conversations").select("conv_id").distinct().select(
        k.alias("sample_id"), F.concat(F.lit("src"), k % 5).alias("source"), F.when(k % 7 == 0, "pending").otherwise("machine_aligned").alias("alignment_status"), F.when(k % 11 != 0, F.concat(k, F.lit(".json"))).alias("alignment_file"),
        F.when(k % 13 == 0, "archival").otherwise("clean_live").alias("recording_quality"), F.concat(k, F.lit(".wav")).alias("filename"),
    )


def _training(spark, d):
    return dataset.training_rows(_samples(spark, d), _tiered(spark, d))


@query
def training_rows(spark, d):
    return _training(spark, d)


@query
def skip_reasons(spark, d):
    return dataset.skip_reasons(_samples(spark, d), _tiered(spark, d)).withColumnRenamed("count", "n")


@query
def registry_reasons(spark, d):
    """Reasons where some alignment files are missing, broken or stale."""
    samples, k = _samples(spark, d), F.col("sample_id")
    state = F.when(k % 19 == 0, "broken").when(k % 23 == 0, "stale").otherwise("ok")
    files = samples.filter(k % 17 != 0).select("sample_id", state.alias("reason"))
    return dataset.skip_reasons(samples, _tiered(spark, d), files).withColumnRenamed("count", "n")


@query
def build_report(spark, d):
    return dataset.build_report(_training(spark, d))


@query
def tier_counts(spark, d):
    return dataset.tier_counts(_tiered(spark, d))


@query
def coverage_vs_targets(spark, d):
    targets = spark.createDataFrame([("n_rows", 10.0), ("n_lines", 1e6), ("n_sources", 3.0)], "metric string, target double")
    return dataset.coverage_vs_targets(dataset.build_report(_training(spark, d)), targets)


@query
def stratum_weights(spark, d):
    return dataset.stratum_weights(_training(spark, d), "source", "tier").select("sample_id", "idx", F.round("weight", 6).alias("weight"))


@query
def content_build_id(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.sha2("text", 256).alias("audio_sha256"))
    return dataset.build_id(docs)


@query
def content_tree_id(spark, d):
    """Whether the tree id tells two contents apart, and is the same for the same rows in another order."""
    docs = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.sha2("text", 256).alias("audio_sha256"))
    ids = [dataset.tree_id(x).select(F.lit(k).alias("k"), "tree_id") for k, x in (("a", docs), ("b", docs.repartition(7, "audio_sha256")), ("c", docs.withColumn("id", F.concat("id", F.lit("x")))))]
    return dataset.all_splits({"s": ids[0], "t": ids[1], "u": ids[2]}).groupBy().agg(F.count_distinct("tree_id").alias("ids"), F.count_distinct(F.when(F.col("k") != "c", F.col("tree_id"))).alias("same"))


@query
def all_splits(spark, d):
    rows = _training(spark, d)
    return dataset.all_splits({k: rows.filter(F.col("split") == k).drop("split") for k in ("train", "val", "test")}).groupBy("split").agg(F.count("*").alias("n"))


@query
def written_splits(spark, d):
    """Splits written as JSON and read back."""
    path = views.shared_dir(spark)
    views.write_json_splits(_training(spark, d), path)
    kinds = "sample_id long, idx long, sentence string, duration_sec double, split string"
    return spark.read.schema(kinds).json(path).select("sample_id", "idx", "duration_sec", "split", F.length("sentence").alias("chars"))


@query
def written_summaries(spark, d):
    """The 14 columns of the summary file, read back as text."""
    path, k = views.shared_dir(spark), F.col("sample_id")
    rows = _summaries(spark, d).select(
        F.concat(k, F.lit(".wav")).alias("filename"), (k % 5).alias("group"), "best_page", "best_line", "best_passage", "best_confidence", "windows_confident", "windows_total",
        F.lit(False).alias("timed_out"), F.concat_ws(", ", F.lit("a"), "pages").alias("notes"),
    )
    evaluate.eval_csv(rows, path)
    return spark.read.option("header", True).option("emptyValue", "").csv(path).na.fill("")


@query
def written_alignments(spark, d):
    """Envelopes written, read back as spans."""
    path = views.shared_dir(spark)
    views.write_alignments(_tiered(spark, d), path)
    kinds = "sample_id long, segment_count long, segments array<struct<start_sec: double, kind: string, tier: string>>"
    return spark.read.schema(kinds).json(path).select("sample_id", F.explode("segments").alias("s")).groupBy("sample_id", "s.tier").agg(F.count("*").alias("n"), F.max("s.start_sec").alias("last"))


def _store(spark, d) -> str:
    """Feedback appended in two batches; the second is sent twice."""
    path, rows = views.shared_dir(spark), _feedback(spark, d)
    for part in (0, 1, 1):
        feedback.append_feedback(rows.filter(F.col("id") % 2 == part), SECRET, path, f"batch-{part}")
    return path


@query
def stored_feedback(spark, d):
    """Feedback appended in parts, one of them twice, read back."""
    stored = feedback.read_feedback(spark, _store(spark, d))
    return stored.groupBy("correction_type").agg(F.count("*").alias("n"), F.sum("correction_ang").alias("pages"), F.count_distinct("session_hmac").alias("sessions"), F.lit("audio_base64" in stored.columns).alias("with_audio"))


@query
def stored_after_erasure(spark, d):
    """The rows that are left in the store after the sessions of one market segment were erased from its files."""
    path = _store(spark, d)
    token = F.concat(F.lit("session-"), F.col("c_custkey"))
    gone = _t(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(T.pseudonymize(token, SECRET).alias("session_hmac"))
    feedback.erase_stored(spark, path, gone)
    return feedback.read_feedback(spark, path).select("id", "session_hmac", "correction_type")


@query
def weighted_draws(spark, d):
    """How often each stratum is drawn among 1,000 draws."""
    drawn = dataset.weighted_sample(dataset.stratum_weights(_training(spark, d).select("sample_id", "idx", "source"), "source"), "weight", 1000)
    by = drawn.groupBy("source").agg(F.count("*").alias("n"))
    return by.agg(F.sum("n").alias("draws"), F.count("*").alias("strata"), (F.min("n") > 100).alias("all_drawn"))


@query
def curriculum(spark, d):
    return dataset.curriculum(_training(spark, d), 1).select("sample_id", "idx")


@query
def quality_ceiling(spark, d):
    return dataset.quality_ceiling(_tiered(spark, d), _samples(spark, d)).groupBy("tier").agg(F.count("*").alias("n"))


@query
def manifest_checked(spark, d):
    """What a manifest states against the rows, and the files of alignments and audio that there are."""
    samples, rows, k = _samples(spark, d), _training(spark, d), F.col("sample_id")
    alignments, audio = samples.filter(k % 3 != 0).select("alignment_file"), samples.filter(k % 5 != 0).select("filename")
    counts = rows.groupBy("split").agg(F.count("*").alias("n"))
    stated = counts.unionByName(spark.createDataFrame([("train", 1), ("extra", 3)], "split string, n long"))
    return dataset.manifest_problems(samples, rows, stated, alignments, audio)


@query
def release_gate(spark, d):
    rows = _training(spark, d)
    problems = dataset.manifest_problems(_samples(spark, d), rows, spark.createDataFrame([("train", 1)], "split string, n long"))
    targets = spark.createDataFrame([("n_rows", 1.0)], "metric string, target double")
    return dataset.release_gate(dataset.coverage_vs_targets(dataset.build_report(rows), targets), problems)


@query
def distinct_samples(spark, d):
    return dataset.distinct_samples(_training(spark, d))


# --- Evaluation
def _summaries(spark, d):
    return evaluate.sample_summary(views.window_hypotheses(_t(spark, d, "conversations")))


@query
def sample_summary(spark, d):
    return _known(_summaries(spark, d), "best_page", "best_line", "best_passage").na.fill(-1.0, ["first_confident"])


@query
def near_misses(spark, d):
    s = _summaries(spark, d).withColumn("grp", F.col("sample_id") % 5)
    return _known(evaluate.near_misses(s, "grp"), "best_passage")


@query
def eval_notes(spark, d):
    return evaluate.notes(_summaries(spark, d).withColumn("timed_out", F.col("sample_id") % 9 == 0))


@query
def eval_rollup(spark, d):
    return evaluate.eval_rollup(_summaries(spark, d).withColumn("grp", F.col("sample_id") % 5).withColumn("part", F.col("sample_id") % 2), "grp", "part").transform(_known, "grp", "part")


@query
def error_rates(spark, d):
    """Rates of hypotheses that lack the first word."""
    c = _t(spark, d, "conversations").select(F.col("text").alias("reference"), F.regexp_replace("text", "^[^ ]* ?", "").alias("hypothesis"))
    return evaluate.error_rates(c).select(F.round("cer", 9).alias("cer"), F.round("wer", 9).alias("wer"))


@query
def confidence_histogram(spark, d):
    h = views.window_hypotheses(_t(spark, d, "conversations")).withColumn("right", F.col("coverage") >= 0.5)
    return evaluate.confidence_histogram(h, "confidence", "right")


@query
def latency_by_provider(spark, d):
    e = _t(spark, d, "events").select(F.col("event_type").alias("provider"), F.col("value").alias("elapsed_ms"), (F.col("event_id") % 3 > 0).alias("ok"))
    return evaluate.latency_by_provider(e)


@query
def model_compare(spark, d):
    h = views.window_hypotheses(_t(spark, d, "conversations"))
    other = evaluate.sample_summary(h.withColumn("confidence", 100 - F.col("confidence")).withColumn("page", F.col("page") % 3))
    k = _t(spark, d, "conversations").select(F.col("conv_id").alias("sample_id")).distinct()
    return evaluate.model_compare(_summaries(spark, d), other, k.withColumn("grp", F.floor(F.col("sample_id") / 3)), k.filter("sample_id % 4 = 0"))


# --- Feedback
def _feedback(spark, d):
    """Events as corrections of the wire format, some of them broken."""
    e, k = _t(spark, d, "events"), F.col("event_id")
    kind = F.when(F.col("event_type") == "click", "wrong_pangti").when(F.col("event_type") == "view", "unknown").otherwise("other")
    return e.select(
        k.alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("received_at_ms"), F.concat(F.when(k % 50 == 0, "s-").otherwise("session-"), "user_id").alias("session_token"),
        F.struct(kind.alias("type"), F.when(k % 6 != 0, k % 1500 - 1).alias("ang"), F.when(k % 40 == 0, F.repeat(F.lit("n"), 2001)).otherwise(F.lit("")).alias("notes")).alias("correction"),
        F.struct((k % 1500).alias("ang"), F.col("value").alias("score"), F.lit("pankti").alias("line_type")).alias("match"), ((k % 62) * 1.0).alias("audio_duration_sec"), F.lit("raagi").alias("mode"),
        F.lit("AAAA").alias("audio_base64"), F.lit("kept").alias("unheard_of"),
    )


@query
def feedback_issues(spark, d):
    v = feedback.validate(_feedback(spark, d))
    return v.groupBy(F.array_join("issues", ",").alias("issues")).agg(F.count("*").alias("n"))


@query
def feedback_by_session(spark, d):
    return feedback.ingest(_feedback(spark, d), SECRET).groupBy("session_hmac", "correction_type").agg(F.count("*").alias("n"))


@query
def newest_feedback(spark, d):
    return feedback.newest(_feedback(spark, d).withColumn("received_at", F.col("received_at_ms")).filter("id % 50 <> 0"), "session_token", 5).select("session_token", "id", F.col("rank").cast("long").alias("rank"))


def _stored(spark, d):
    return _feedback(spark, d).select("id", F.col("session_token").alias("session_hmac"), F.col("correction.type").alias("correction_type"))


@query
def erased_feedback(spark, d):
    gone = _t(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("session-"), "c_custkey").alias("session_hmac"))
    return feedback.erase(_stored(spark, d), gone).groupBy("correction_type").agg(F.count("*").alias("n"))


@query
def erased_counts(spark, d):
    """Single rows erased, each asked for by its own session or, for odd ids, by a wrong one."""
    asked = _stored(spark, d).filter("id % 3 = 0").select("id", F.when(F.col("id") % 2 == 0, F.col("session_hmac")).otherwise(F.concat(F.lit("not-"), "session_hmac")).alias("session_hmac"))
    return feedback.erased(_stored(spark, d), asked)


def _corrections(spark, d):
    e, k = _t(spark, d, "events"), F.col("event_id")
    return e.select(k.alias("id"), (k % 1430 + 1).alias("page"), (k % 4).alias("line_no"), F.lit("").alias("notes")), e.filter("event_id % 3 > 0").select(k.alias("id"), (k % 3 == 1).alias("accepted"))


@query
def corrected_labels(spark, d):
    corrections, decisions = _corrections(spark, d)
    return feedback.corrections_to_labels(corrections, decisions, _lines(spark, d))[0].select("id", "line_id", "labeled_by")


@query
def correction_queue(spark, d):
    corrections, decisions = _corrections(spark, d)
    return feedback.corrections_to_labels(corrections, decisions, _lines(spark, d))[1].select("id")


# --- Registry
@query
def sample_names(spark, d):
    k = F.col("c_custkey")
    name = F.when(k % 5 == 0, F.concat(F.lit("old name "), k, F.lit(".mp3"))).otherwise(
        F.concat_ws("_", F.lit("bhai_singh"), F.when(k % 5 == 1, "unknown_raag").otherwise("soohee"), F.when(k % 5 == 2, "unknown").otherwise((k % 1430 + 1).cast("string")), (k % 19).cast("string"), F.concat(F.when(k % 5 == 3, "nagar_kirtan").otherwise("studio"), F.lit(".wav")))
    )
    return _t(spark, d, "customer").select("c_custkey", registry.parse_sample_name(name).alias("n")).select("c_custkey", "n.singer", "n.raag", F.coalesce("n.page", F.lit(-1)).alias("page"), F.coalesce("n.line_no", F.lit(-1)).alias("line_no"), "n.difficulty", "n.legacy")


@query
def registry_issues(spark, d):
    k = F.col("c_custkey")
    samples = _t(spark, d, "customer").select(
        k.cast("string").alias("id"), F.when(k % 4 != 0, F.sha2(k.cast("string"), 256)).alias("audio_sha256"), F.when(k % 3 == 0, "unheard_of").otherwise("soohee").alias("raag"), (k % 1600).alias("ang_start"),
        (k % 1600 + k % 2 - 1).alias("ang_end"), F.when(k % 7 == 0, "fine").otherwise("studio").alias("recording_quality"), F.lit("live").alias("difficulty"), F.lit("pending").alias("alignment_status"), F.lit(1.0).alias("duration_sec"),
    )
    taxonomy = spark.createDataFrame([("soohee",), ("aasaa",)], "raag string")
    return registry.registry_problems(samples, taxonomy).groupBy(F.array_join("issues", ",").alias("issues")).agg(F.count("*").alias("n"))


@query
def admitted_audio(spark, d):
    k = F.col("o_orderkey")
    files = _t(spark, d, "orders").select(
        F.concat(k, F.when(k % 3 == 0, ".WAV").when(k % 3 == 1, ".txt").otherwise("")).alias("name"), F.when(k % 5 == 0, "audio/x-any").when(k % 5 == 1, "text/plain").alias("mime"),
        F.when(k % 7 == 0, 0).otherwise(F.col("o_totalprice") * 60).cast("long").alias("bytes"), F.when(k % 11 != 0, k % 70).cast("double").alias("duration_sec"),
    )
    return registry.admission(files).groupBy("reason").agg(F.count("*").alias("n"))


@query
def review_queue(spark, d):
    return feedback.review_queue(_tiered(spark, d))


@query
def reviewed_spans(spark, d):
    dec = _tiered(spark, d).filter("idx % 3 = 0").select("sample_id", "idx", F.lit("high").alias("new_tier"), F.lit(1).alias("decided_at"))
    return feedback.apply_review(_tiered(spark, d), dec).groupBy("tier", "labeled_by").agg(F.count("*").alias("n"))


def _hits(spark, d):
    return _t(spark, d, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"))


@query
def rate_limited(spark, d):
    return feedback.rate_limit(_hits(spark, d), 3, 86_400).select("key", "id", "allowed", "remaining")


@query
def monthly_quota(spark, d):
    return feedback.monthly_quota(_hits(spark, d), 3).select("key", "id", "accepted")


# --- Sessions
def _seconds(*names):
    return [F.floor(F.unix_micros(F.col(n).cast("timestamp")) / 1_000_000).cast("long").alias(n) for n in names]


def _sessions(spark, d):
    e = _t(spark, d, "events")
    return e.select(F.col("user_id").alias("session_id"), "ts", ((F.col("event_id") * 7) % 1000).alias("seq"), F.col("event_id").alias("id"), (F.col("value") / 100).alias("score"), F.col("event_type").alias("text"), F.col("event_type").alias("status"), (F.col("event_type") == "click").alias("canonical"))


@query
def stale_dropped(spark, d):
    return sessions.drop_stale(_sessions(spark, d)).select("session_id", "id")


@query
def debounced(spark, d):
    return sessions.debounce(_sessions(spark, d), 600.0).select("session_id", "id")


@query
def status_transitions(spark, d):
    kind = F.when(F.col("status") == "click", "recording").when(F.col("status") == "view", "processing").when(F.col("id") % 211 == 0, "error").otherwise("listening")
    e = _sessions(spark, d).withColumn("status", kind).withColumn("ts", F.date_trunc("day", "ts"))
    return sessions.status_changes(e).groupBy("session_id", "status").agg(F.count("*").alias("n"))


@query
def rolling_scores(spark, d):
    days = "5 days", "19 hours 12 minutes"
    return sessions.rolling_windows(_sessions(spark, d), *days, least=25_920.0)


@query
def tumbling_scores(spark, d):
    return sessions.tumbling(_sessions(spark, d))


@query
def merged_sources(spark, d):
    return sessions.merge_sources(_sessions(spark, d)).select("session_id", "id")


@query
def silence_stops(spark, d):
    return sessions.silence_stop(_sessions(spark, d), 3600.0, 0.9).select("session_id", "id", "stopped")


@query
def auto_selected(spark, d):
    found = sessions.auto_select(_sessions(spark, d).withColumn("ts", F.date_trunc("week", "ts")), 0.5, 86_400.0)
    return found.select("session_id", "text", *_seconds("since", "until"))


@query
def banners(spark, d):
    return sessions.banner_ttl(_sessions(spark, d), 7200.0).select("session_id", "n", *_seconds("since", "until"))


@query
def warmup_gated(spark, d):
    e = _sessions(spark, d).withColumn("text", F.when(F.col("text") == "view", "stop").otherwise(F.col("text")))
    return sessions.warmup_gate(e, 86_400.0, 0.5).select("session_id", "id")


@query
def energy_guarded(spark, d):
    return sessions.energy_guard(_sessions(spark, d), 3, 0.5).select("session_id", "id")


def _matches(spark, d):
    e = _t(spark, d, "events")
    return e.select(F.col("user_id").alias("session_id"), "ts", F.col("event_id").alias("seq"), (F.col("event_id") % 7).alias("passage_id"), (F.col("event_id") % 3).alias("line_no"), F.least(F.col("value"), F.lit(100.0)).alias("score"))


@query
def followed_positions(spark, d):
    return sessions.follow_batch(_matches(spark, d)).groupBy("session_id", "action").agg(F.count("*").alias("n"))


@query
def tracked_modes(spark, d):
    return sessions.track_position(_matches(spark, d)).groupBy("session_id", "mode").agg(F.count("*").alias("n"))


_FRAMES = {"level": 0.3, "frame_s": 3600.0, "silence_s": 10_000.0, "speech_s": 7200.0, "longest_s": 28_800.0, "before_s": 90_000.0, "gap_s": 400_000.0}


def _frames(spark, d):
    return _t(spark, d, "events").select(F.col("user_id").alias("session_id"), _us("ts").alias("us"), (F.col("value") / 100).alias("prob"))


def _us(name):
    return F.unix_micros(F.col(name).cast("timestamp"))


def _parts(rows):
    """Rows by the thirds of their time: what a stream gets one after the other."""
    written = views.stashed(rows)
    low, high = written.agg(F.min("us"), F.max("us")).first()
    third = F.least(F.lit(2), F.floor((F.col("us") - (low or 0)) * 3 / F.lit(max(1, (high or 0) - (low or 0)))))
    return [written.filter(third == n) for n in range(3)]


def _streamed(rows, build, timers=True):
    return sinks.run_in_parts(_parts(rows), build, views.shared_dir(rows.sparkSession), timers)


@query
def utterances(spark, d):
    frames = _frames(spark, d)
    return live.segment_utterances(frames, live.horizon(frames), **_FRAMES)


@query
def utterances_live(spark, d):
    """The same by a stream: pre-roll in a list state, pauses by event-time timers."""
    return _streamed(_frames(spark, d), lambda s: live.segment_utterances(s, **_FRAMES))


def _read_aloud(spark, d):
    """First hits of the corpus by letters, its lines in an index, and utterances."""
    lines = views.stashed(views.indexable(_lines(spark, d)).select("order_id", "passage_id", "line_no", "norm"))
    index = lineindex.index_lines(lines, views.shared_dir(spark))
    return views.stashed(lineindex.first_hits(lines)), index, views.readings(lines)


_PLACED = ["session_id", "seq", "mode", "coalesce(line, -1) AS line", "round(score, 6) AS score", "held", "asked"]


@query
def positions_tracked(spark, d):
    """Positions of readers who are searched for near where they stand."""
    hits, index, said = _read_aloud(spark, d)
    found = live.follow_positions(lineindex.with_hit(said, hits), index, lineindex.overlap_scores)
    return found.filter("event = 'utterance'").selectExpr(*_PLACED)


@query
def positions_tracked_live(spark, d):
    """The same by a stream, joined with the fixed corpus, with a state and timers for each reader."""
    hits, index, said = _read_aloud(spark, d)
    found = _streamed(said, lambda s: live.follow_positions(lineindex.with_hit(s, hits), index, lineindex.overlap_scores))
    return found.filter("event = 'utterance'").selectExpr(*_PLACED)


_PASSED = ["session_id", "seq", "outcome", "coalesce(passage, -1) AS passage", "coalesce(line, -1) AS line", "round(coalesce(score, 0D), 6) AS score"]


@query
def passages_followed(spark, d):
    """Passages of readers by the three tiers, each searched by what the session has seen."""
    hits, index, said = _read_aloud(spark, d)
    return live.follow_passages(lineindex.with_hit(said, hits), index, lineindex.overlap_scores).selectExpr(*_PASSED)


@query
def passages_followed_live(spark, d):
    """The same by a stream, the passages seen in a map state."""
    hits, index, said = _read_aloud(spark, d)
    return _streamed(said, lambda s: live.follow_passages(lineindex.with_hit(s, hits), index, lineindex.overlap_scores)).selectExpr(*_PASSED)


@query
def rate_limited_live(spark, d):
    """``rate_limited`` by a stream, accepted hits in a map state with a time to live."""
    hits = _t(spark, d, "events").select(F.col("user_id").alias("key"), _us("ts").alias("us"), F.col("event_id").alias("id"))
    return _streamed(hits, lambda s: live.limit_rates(s, 3, 86_400), timers=False).select("key", "id", "allowed", "remaining")


@query
def late_events(spark, d):
    """Events that come in three batches by their ids; those of a batch that lie behind the watermark of
    the batches before are late."""
    events = views.stashed(_t(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts")))
    path = views.shared_dir(spark)
    for n in range(3):
        events.filter(F.col("event_id") % 3 == n).write.parquet(f"{path}/in/{n}")
        table = sinks.route_late(sinks.source(spark, f"{path}/in", events.schema), f"{path}/routed", "ts", 3 * 86_400)
    parts = [table.read(p, "event_id long, ts timestamp").select("event_id", F.lit(p).alias("part")) for p in ("clean", "late")]
    return parts[0].unionByName(parts[1])


@query
def self_corrected(spark, d):
    """Clicks are passes of the matcher, all other events transcripts."""
    e, hit = _sessions(spark, d), F.col("canonical")
    e = e.withColumn("matched", F.when(hit, F.concat(F.lit("line "), "id"))).withColumn("text", F.when(~hit, F.concat_ws(" ", "text", "id")))
    return sessions.self_correct(e, 0.3).select("session_id", "id", F.coalesce("shown", F.lit("")).alias("shown"))


@query
def last_good_shown(spark, d):
    e = _t(spark, d, "events")
    e = e.select(F.col("user_id").alias("session_id"), "ts", F.col("event_id").alias("seq"), F.col("props").alias("text"), (F.col("event_type") == "click").alias("canonical"))
    return sessions.freeze_last_good(e).groupBy("session_id").agg(F.count("*").alias("n"), F.sum(F.length("shown")).alias("chars"))


@query
def accumulated_transcripts(spark, d):
    return sessions.accumulated(_t(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "text"))


@query
def active_keys(spark, d):
    return sessions.active_keys(_hits(spark, d), 86_400.0)


@query
def category_coverage(spark, d):
    docs = _t(spark, d, "documents")
    goals = docs.groupBy(F.concat(F.lit("lang-"), "lang").alias("category")).agg(F.lit(200).cast("long").alias("goal"))
    return evaluate.category_coverage(docs.select(F.col("doc_id").alias("sample_id"), F.array(F.concat(F.lit("lang-"), "lang"), F.concat(F.lit("source-"), "source")).alias("categories")), goals)


@query
def gold_compared(spark, d):
    gold = _t(spark, d, "events").groupBy(F.col("user_id").alias("query_id")).agg(F.max("event_id").alias("order_id"), F.lit(60.0).alias("least"), F.lit(90.0).alias("most"), F.array(F.min("event_id"), F.max("event_id")).alias("forbidden"))
    return evaluate.gold_compare(_ranked(spark, d), gold)


@query
def cascaded(spark, d):
    q = _search(spark, d)
    now = q.select("query_id", F.split("query_id", ":")[0].cast("long").alias("passage_id"))
    before = now.select("query_id", (F.col("passage_id") + 1).alias("passage_id")).unionByName(now)
    return match.cascade_match(q, _kept_lines(spark, d), now, before).select("query_id", "order_id", F.round("score", 6).alias("score"), F.col("tier").cast("long").alias("tier"))
