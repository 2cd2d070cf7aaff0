"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from linetrace.plans.queries import _font_table

#: Normalisation, lines and the other derived tables, as in ``sources.views``.
NORM = r"""trim(regexp_replace(regexp_replace(lower({0}), '[.,;|:!?\-"''(){{}}\[\]0-9]+', ' ', 'g'), '\s+', ' ', 'g'))"""
LINES = f"""
cut AS (SELECT doc_id, lang, source, unnest(ps) AS text, unnest(range(len(ps))) AS line_no FROM (SELECT *, regexp_split_to_array(text, '[.\\n]') AS ps FROM (SELECT doc_id, lang, source, text FROM documents))),
nl AS (SELECT doc_id, lang, source, line_no, trim(text) AS text, {NORM.format("trim(text)")} AS norm FROM cut WHERE trim(text) <> ''),
lines AS (SELECT doc_id || ':' || line_no AS id, doc_id AS passage_id, doc_id % 1430 + 1 AS page, line_no, CASE WHEN len(list_filter(string_split(norm, ' '), lambda x: x <> '')) < 3 THEN 'heading' ELSE 'pankti' END AS line_type,
  text, norm, doc_id * 100000 + line_no AS order_id, lang, source FROM nl)
"""
HYP = """
hyp AS (SELECT conv_id AS sample_id, turn::BIGINT AS seq, (turn * 10)::DOUBLE AS start_sec, (turn * 10 + length(text) % 9 + 4)::DOUBLE AS end_sec, CASE WHEN length(text) % 7 <> 0 THEN conv_id % 1430 + 1 END AS page,
  CASE WHEN length(text) % 7 <> 0 THEN length(text) % 2 END AS line_no, CASE WHEN length(text) % 7 <> 0 THEN (conv_id * 3 + turn) % 400 END AS passage_id, (length(text) * 7 % 101)::DOUBLE AS confidence, (length(text) % 11) / 10.0::DOUBLE AS coverage, text FROM conversations)
"""
SPANS = f"""{HYP},
run0 AS (SELECT *, CASE WHEN page = lag(page) OVER w AND line_no = lag(line_no) OVER w THEN 0 ELSE 1 END AS new FROM hyp WINDOW w AS (PARTITION BY sample_id ORDER BY seq)),
run1 AS (SELECT *, sum(new) OVER (PARTITION BY sample_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM run0),
spans AS (SELECT sample_id, (run - 1)::BIGINT AS idx, min(start_sec) AS start_sec, max(end_sec) AS end_sec, any_value(page)::BIGINT AS page, any_value(line_no)::BIGINT AS line_no, round(avg(confidence), 6) AS confidence,
  round(avg(coverage), 6) AS coverage, string_agg(text, ' ' ORDER BY seq) AS text, CASE WHEN any_value(page) IS NULL THEN 'unknown' ELSE 'line' END AS kind FROM run1 GROUP BY sample_id, run)
"""
TIERED = f"""{SPANS},
rep0 AS (SELECT *, kind = 'line' AND coalesce(start_sec - lag(end_sec) OVER (PARTITION BY sample_id, page, line_no ORDER BY idx) >= 1.0, false) AS again FROM spans),
rep AS (SELECT *, CASE WHEN kind = 'line' AND idx <= max(CASE WHEN again THEN idx END) OVER p THEN 'rg_' || page || '_' || line_no || '_' || min(idx) OVER p END AS repeat_group FROM rep0 WINDOW p AS (PARTITION BY sample_id, page, line_no)),
tiered AS (SELECT *, CASE WHEN kind <> 'line' THEN 'n/a' WHEN NOT (end_sec - start_sec BETWEEN 1.5 AND 25) OR repeat_group IS NOT NULL THEN 'needs_review' WHEN confidence >= 80 AND coverage >= 0.7 AND edge <= 0.3::DOUBLE THEN 'high'
  WHEN confidence >= 65 AND coverage >= 0.5 AND edge <= 0.8::DOUBLE THEN 'medium' ELSE 'needs_review' END AS tier FROM (SELECT *, CASE WHEN idx % 4 <> 0 THEN (idx % 10) / 10.0::DOUBLE ELSE 0 END AS edge FROM rep))
"""
SAMPLES = """
samples AS (SELECT k AS sample_id, 'src' || k % 5 AS source, k % 7 = 0 AS pending, k % 11 = 0 AS no_file, k % 13 = 0 AS archival FROM (SELECT DISTINCT conv_id AS k FROM conversations))
"""
_SPLIT = "(('0x' || substring(sha256({0}::VARCHAR), 1, 8))::BIGINT % 100)"
SPLIT = f"CASE WHEN {_SPLIT} < 80 THEN 'train' WHEN {_SPLIT} < 90 THEN 'val' ELSE 'test' END"
TRAINING = f"""{TIERED}, {SAMPLES},
training AS (SELECT sample_id, source, idx, 'audio/' || sample_id || '.wav' AS audio, tier, page, line_no, text AS sentence, round(start_sec, 3) AS start_sec, round(end_sec, 3) AS end_sec, round(end_sec - start_sec, 3) AS duration_sec, {SPLIT.format("sample_id")} AS split, 'clean_live' AS recording_quality, round(confidence, 6) AS confidence, round(coverage, 6) AS coverage
  FROM tiered JOIN samples USING (sample_id) WHERE NOT pending AND NOT no_file AND NOT archival AND tier IN ('high', 'medium') AND kind = 'line' AND text <> '' AND repeat_group IS NULL)
"""
SUMMARY = f"""{HYP},
best AS (SELECT sample_id, arg_max(page, confidence * 1000000 - seq) AS p0, max(confidence) AS best_confidence, min(start_sec) FILTER (confidence >= 75) AS first_confident, count(*) AS windows_total,
  count(*) FILTER (confidence >= 75) AS windows_confident, array_to_string(list_sort(list_distinct(list(page) FILTER (confidence >= 75 AND page IS NOT NULL))), ',') AS pages FROM hyp GROUP BY sample_id),
top AS (SELECT DISTINCT ON (sample_id) sample_id, page AS best_page, line_no::BIGINT AS best_line, passage_id::BIGINT AS best_passage FROM hyp ORDER BY sample_id, confidence DESC, seq),
summary AS (SELECT sample_id, best_page, best_line, best_passage, best_confidence, windows_total, windows_confident, first_confident, coalesce(pages, '') AS pages FROM best JOIN top USING (sample_id))
"""
EVENTS = """
ev AS (SELECT user_id AS session_id, ts, event_id * 7 % 1000 AS seq, event_id AS id, value / 100 AS score, event_type AS text, event_type AS status, event_type = 'click' AS canonical FROM events)
"""
RANKED = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, order_id DESC) AS rank FROM (SELECT user_id AS query_id, event_id AS order_id, round(least(value, 100), 3) AS score FROM events))
"""
_W = "WINDOW w AS (PARTITION BY session_id ORDER BY ts, seq)"

#: The last a of tokens of more than three characters that don't end in aa, ia or ya; applied to each token.
SCHWA = r"""array_to_string(list_transform(regexp_split_to_array({0}, ' '), lambda w: CASE WHEN regexp_matches(w, '\s') THEN regexp_replace(regexp_replace(w, '(\S{{2}}[^\saiy])a(\s)', '\1\2', 'g'), '(\S{{2}}[^\saiy])a$', '\1') WHEN length(w) > 3 AND right(w, 1) = 'a' AND right(w, 2) NOT IN ('aa', 'ia', 'ya') THEN left(w, -1) ELSE w END), ' ')"""
FONT = r"""replace(regexp_replace(replace(regexp_replace({0}, '[\^~]', '', 'g'), 'qs', 'sq'), 'i([bcdfg])', '\1i', 'g'), 'x', 'ks')"""
_KEY = b"a secret of enough length".ljust(64, b"\0")
_PADS = ["".join(f"{b ^ pad:02X}" for b in _KEY) for pad in (0x5C, 0x36)]
#: HMAC-SHA256 of a text under the queries' secret.
HMAC = f"sha256(unhex('{_PADS[0]}') || unhex(sha256(unhex('{_PADS[1]}') || encode({{0}}))))"
FEEDBACK = """
fb0 AS (SELECT event_id AS id, CASE WHEN event_id % 50 = 0 THEN 's-' ELSE 'session-' END || user_id AS token, CASE event_type WHEN 'click' THEN 'wrong_pangti' WHEN 'view' THEN 'unknown' ELSE 'other' END AS kind,
  CASE WHEN event_id % 6 <> 0 THEN event_id % 1500 - 1 END AS ang FROM events),
fb AS (SELECT *, array_to_string(list_filter([CASE WHEN length(token) < 8 THEN 'session_token' END, CASE WHEN kind = 'other' THEN 'correction.type' END, CASE WHEN id % 40 = 0 THEN 'correction.notes' END, CASE WHEN ang < 0 THEN 'correction.ang' END,
  CASE WHEN id % 62 > 60 THEN 'audio_duration_sec' END], lambda x: x IS NOT NULL), ',') AS issues FROM fb0)
"""


def ratio(a: str, b: str) -> str:
    """100 * 2 * LCS / (len a + len b), by rows of the plain dynamic programme."""
    row = f"list_reduce(range(1, length({b}) + 1), lambda r, j: list_append(r, CASE WHEN substring({b}, j::INT, 1) = c THEN p[j] + 1 ELSE greatest(p[j + 1], r[j]) END), [0::BIGINT])"
    lcs = f"list_reduce(list_transform(range(1, length({a}) + 1), lambda i: {{c: substring({a}, i::INT, 1)}}), lambda s, x: {{p: {row.replace(' c ', ' x.c ').replace('p[', 's.p[')}}}, {{p: list_transform(range(length({b}) + 1), lambda k: 0::BIGINT)}}).p[-1]"
    return f"(CASE WHEN length({a}) + length({b}) = 0 THEN 100.0::DOUBLE ELSE 200.0::DOUBLE * {lcs} / (length({a}) + length({b})) END)"


ORACLES: dict[str, str] = {
    "line_view": f"WITH {LINES} SELECT id, page, line_no, line_type, norm, order_id FROM lines",
    "corpus_index": f"""WITH {LINES}, t AS (SELECT id, list_filter(string_split(norm, ' '), lambda x: x <> '') AS ts FROM lines WHERE norm <> '' AND line_type <> 'heading'),
        f AS (SELECT id, len(ts)::BIGINT AS n_tokens, array_to_string(list_transform(ts, lambda x: x[1]), '') AS first_letters FROM t) SELECT *, translate(first_letters, 'bfgdj', 'ppktc') AS phonetic FROM f""",
    "corpus_count": f"WITH {LINES} SELECT source, count(*) AS n, count(*) FILTER (line_type = 'heading') AS headings FROM lines GROUP BY source",
    "scope_source": f"WITH {LINES} SELECT source, line_type, count(*) AS n FROM lines WHERE starts_with(source, 'src1') GROUP BY ALL",
    "point_lookup": f"WITH {LINES}, k AS (SELECT DISTINCT item_id % 1430 + 1 AS page, item_id % 5 AS line_no FROM benchmark) SELECT page, line_no, id, order_id FROM lines JOIN k USING (page, line_no)",
    "passage_display_lines": f"WITH {LINES} SELECT passage_id, count(*) AS n, min(order_id) AS first_order FROM lines WHERE lower(line_type) IN ('pankti', 'rahao') GROUP BY passage_id",
    "curate_languages": "SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'fr')",
    "reading_scope": f"WITH {LINES} SELECT page, count(*) AS n FROM lines WHERE passage_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY page",
    "uncached_transcripts": "WITH c AS (SELECT conv_id AS sample, max(turn) AS mtime FROM conversations GROUP BY conv_id) SELECT sample, mtime FROM c WHERE NOT EXISTS (SELECT 1 FROM labels WHERE doc_id = sample AND quality * 5 >= mtime)",
    "extract_payloads": "SELECT conv_id, turn, CASE WHEN turn % 3 < 2 AND trim(text) <> '' THEN trim(text) END AS transcript FROM conversations",
    "split_of": f"SELECT doc_id, {SPLIT.format('doc_id')} AS split FROM documents",
    "labels_and_keys": "SELECT event_id, event_type || '-no-5' AS slug, printf('%02d:%02d', event_id % 5000 // 60, event_id % 5000 % 60) AS mmss, strftime(ts, '%Y-%m') AS month, event_type AS grp FROM events",
    "lines_nearby": f"WITH {LINES} SELECT item_id AS event, id, order_id FROM lines JOIN benchmark ON order_id BETWEEN item_id * 100000 + 3 - 200 AND item_id * 100000 + 3 + 200",
    "gate_and_label": f"""WITH {RANKED}, g AS (SELECT *, coalesce(lead(score) OVER (PARTITION BY query_id ORDER BY rank), 0) AS r FROM ranked),
        l AS (SELECT *, CASE WHEN score >= 95 THEN 1 WHEN score >= 85 THEN 2 WHEN score >= 70 THEN 3 WHEN score >= 50 THEN 4 ELSE 5 END + (score >= 85 AND score - r <= 2)::INT AS k FROM g WHERE rank = 1)
        SELECT query_id, order_id, score, score >= 60 OR (score >= 40 AND (r = 0 OR score >= 1.8::DOUBLE * r)) AS accepted, ['certain', 'likely', 'probable', 'possible', 'uncertain'][k] AS label,
        CASE WHEN score >= 75 THEN 'high' WHEN score >= 50 THEN 'medium' ELSE 'low' END AS coarse, score >= 75 AS confident FROM l""",
    "relative_cutoff": f"WITH {RANKED}, m AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM ranked) SELECT query_id, count(*) AS n, max(rank) AS last FROM m WHERE score >= 0.8::DOUBLE * top GROUP BY query_id",
    "alternates": f"WITH {RANKED} SELECT query_id, order_id, rank FROM ranked WHERE rank BETWEEN 2 AND 5",
    "merged_spans": f"WITH {SPANS} SELECT * REPLACE (coalesce(page, -1) AS page, coalesce(line_no, -1) AS line_no) FROM spans",
    "repeats": f"WITH {TIERED} SELECT sample_id, idx, repeat_group FROM rep",
    "span_tiers": f"WITH {TIERED} SELECT sample_id, idx, kind, repeat_group, tier FROM tiered",
    "unsure_spans": f"WITH {SPANS} SELECT CASE WHEN kind = 'line' AND confidence < 70 AND coverage < 0.8 THEN 'unknown' ELSE kind END AS kind, count(*) AS n FROM spans GROUP BY 1",
    "overlap_suppressed": f"""WITH {SPANS}, o AS (SELECT *, coalesce(lag(end_sec) OVER w > start_sec AND lag(confidence) OVER w - confidence >= 15, false) OR coalesce(lead(start_sec) OVER w < end_sec AND lead(confidence) OVER w - confidence >= 15, false) AS lost
        FROM spans WINDOW w AS (PARTITION BY sample_id ORDER BY idx)) SELECT sample_id, idx, confidence FROM o WHERE NOT lost""",
    "backward_jumps": f"WITH {SPANS} SELECT sample_id, idx, coalesce(line_no < lag(line_no) OVER (PARTITION BY sample_id ORDER BY idx), false) AS jump_back FROM spans",
    "span_line_text": f"WITH {SPANS}, {LINES}, f AS (SELECT page, line_no, arg_min(text, order_id) AS line_text FROM lines GROUP BY page, line_no) SELECT sample_id, idx, line_text FROM spans LEFT JOIN f USING (page, line_no)",
    "envelopes": f"WITH {TIERED} SELECT sample_id, count(*) AS segment_count, max(end_sec) AS duration_sec, count(*) FILTER (tier = 'high') AS high, count(*) FILTER (tier = 'needs_review') AS review FROM tiered GROUP BY sample_id",
    "training_rows": f"WITH {TRAINING} SELECT * FROM training",
    "build_report": f"""WITH {TRAINING} SELECT count(*) AS n_rows, round(sum(duration_sec), 3) AS duration_sec, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test,
        count(*) FILTER (tier = 'high') AS high, count(*) FILTER (tier = 'medium') AS medium, count(DISTINCT (page, line_no)) AS n_lines, count(DISTINCT source) AS n_sources FROM training""",
    "tier_counts": f"WITH {TIERED} SELECT sample_id, count(*) FILTER (tier = 'high') AS high, count(*) FILTER (tier = 'medium') AS medium, count(*) FILTER (tier = 'needs_review') AS needs_review, count(*) FILTER (tier = 'n/a') AS n_a FROM tiered GROUP BY sample_id",
    "stratum_weights": f"WITH {TRAINING} SELECT sample_id, idx, round(1.0::DOUBLE / count(*) OVER (PARTITION BY source, tier), 6) AS weight FROM training",
    "curriculum": f"WITH {TRAINING} SELECT sample_id, idx FROM training WHERE tier = 'high'",
    "quality_ceiling": f"WITH {TIERED}, {SAMPLES} SELECT CASE WHEN archival AND tier = 'high' THEN 'medium' ELSE tier END AS tier, count(*) AS n FROM tiered JOIN samples USING (sample_id) GROUP BY 1",
    "sample_summary": f"WITH {SUMMARY} SELECT * REPLACE (coalesce(best_page, -1) AS best_page, coalesce(best_line, -1) AS best_line, coalesce(best_passage, -1) AS best_passage, coalesce(first_confident, -1) AS first_confident) FROM summary",
    "eval_rollup": f"""WITH {SUMMARY} SELECT coalesce(sample_id % 5, -1) AS grp, coalesce(sample_id % 2, -1) AS part, count(*) AS samples, count(*) FILTER (best_confidence >= 75) AS samples_confident, sum(windows_confident)::BIGINT AS windows_confident,
        sum(windows_total)::BIGINT AS windows_total FROM summary GROUP BY ROLLUP (sample_id % 5, sample_id % 2)""",
    "confidence_histogram": f"WITH {HYP} SELECT least(floor(confidence / 10), 9)::BIGINT AS bin, count(*) FILTER (coverage >= 0.5) AS right, count(*) FILTER (coverage < 0.5) AS wrong FROM hyp GROUP BY 1",
    "latency_by_provider": "SELECT event_type AS provider, count(*) AS n, round(avg(value), 6) AS mean_ms, max(value) AS max_ms, count(*) FILTER (event_id % 3 > 0) AS succeeded FROM events GROUP BY event_type",
    "review_queue": f"WITH {TIERED} SELECT sample_id, repeat_group, count(*) AS n, min(idx) AS first_idx FROM tiered WHERE tier = 'needs_review' GROUP BY sample_id, repeat_group",
    "reviewed_spans": f"WITH {TIERED} SELECT CASE WHEN idx % 3 = 0 THEN 'high' ELSE tier END AS tier, CASE WHEN idx % 3 = 0 THEN 'human' ELSE 'auto' END AS labeled_by, count(*) AS n FROM tiered GROUP BY 1, 2",
    "monthly_quota": "SELECT user_id AS key, event_id AS id, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m') ORDER BY ts, event_id) <= 3 AS accepted FROM events",
    "stale_dropped": f"WITH {EVENTS}, h AS (SELECT *, max(seq) OVER (PARTITION BY session_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM ev) SELECT session_id, id FROM h WHERE high IS NULL OR seq >= high",
    "debounced": f"""WITH {EVENTS}, g AS (SELECT *, lead(epoch_us(ts)) OVER w - epoch_us(ts) AS gap FROM ev {_W}), k AS (SELECT * FROM g WHERE gap IS NULL OR gap >= 600000000),
        b AS (SELECT *, lag(text) OVER w AS before FROM k {_W}) SELECT session_id, id FROM b WHERE before IS NULL OR before <> text""",
    "merged_sources": f"WITH {EVENTS}, b AS (SELECT *, max((canonical AND text <> '')::INT) OVER (PARTITION BY session_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS seen FROM ev) SELECT session_id, id FROM b WHERE canonical OR seen = 0",
    "silence_stops": f"""WITH {EVENTS}, b AS (SELECT *, max(CASE WHEN score > 0.9 THEN epoch_us(ts) END) OVER (PARTITION BY session_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS heard FROM ev)
        SELECT session_id, id, coalesce(epoch_us(ts) - heard > 3600000000, false) AS stopped FROM b""",
    "warmup_gated": f"""WITH {EVENTS}, b AS (SELECT *, min(ts) OVER p AS begun, max(score) OVER p AS loud FROM ev WINDOW p AS (PARTITION BY session_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING))
        SELECT session_id, id FROM b WHERE text <> 'view' OR epoch_us(ts) - epoch_us(begun) >= 86400000000 OR loud > 0.5""",
    "self_corrected": f"""WITH {EVENTS}, k AS (SELECT *, last_value(CASE WHEN canonical THEN score END IGNORE NULLS) OVER w AS s, last_value(CASE WHEN canonical THEN 'line ' || id END IGNORE NULLS) OVER w AS m,
        last_value(CASE WHEN NOT canonical THEN text || ' ' || id END IGNORE NULLS) OVER w AS t FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING))
        SELECT session_id, id, coalesce(CASE WHEN s >= 0.3 THEN m ELSE t END, '') AS shown FROM k""",
    "active_keys": "SELECT user_id AS key, max(ts) AS last FROM events GROUP BY user_id HAVING (SELECT max(epoch_us(ts)) FROM events) - max(epoch_us(ts)) <= 86400000000",
    "category_coverage": "SELECT 'lang-' || lang AS category, count(*) AS got, 200::BIGINT AS goal, count(*) >= 200 AS met FROM documents WHERE lang IS NOT NULL GROUP BY lang",
    "gold_compared": f"""WITH {RANKED}, gold AS (SELECT user_id AS query_id, max(event_id) AS order_id, min(event_id) AS lowest FROM events GROUP BY user_id)
        SELECT query_id, r.order_id = g.order_id AS line_ok, r.score BETWEEN 55 AND 95 AS score_ok,
          NOT EXISTS (SELECT 1 FROM ranked x WHERE x.query_id = g.query_id AND x.rank <= 3 AND x.order_id IN (g.order_id, g.lowest)) AS forbidden_ok FROM gold g JOIN ranked r USING (query_id) WHERE r.rank = 1""",
    "accumulated_transcripts": """WITH p AS (SELECT conv_id AS session_id, count(*) AS parts, list(coalesce(text, '') ORDER BY turn, text) AS ts FROM conversations GROUP BY conv_id)
        SELECT session_id, parts, list_reduce(ts, lambda a, b: CASE WHEN a = '' THEN b WHEN b = '' THEN a WHEN starts_with(b, right(a, 20)) THEN a || substring(b, length(right(a, 20)) + 1) ELSE a || ' ' || b END) AS transcript FROM p""",
}

# --- Sources, corpus and registry
ORACLES |= {
    "corpus_view": f"""WITH {LINES}, p AS (SELECT DISTINCT doc_id AS passage_id FROM labels WHERE quality = 1) SELECT id, passage_id, order_id, CASE WHEN line_type = 'heading' THEN 'heading' WHEN line_no % 7 <> 3 THEN 'pankti' END AS type_name,
        CASE WHEN line_no % 5 <> 4 THEN '1|' || {SCHWA.format("norm")} END AS latin FROM lines JOIN p USING (passage_id)""",
    "passage_lines": f"WITH {LINES} SELECT passage_id, id, order_id FROM lines WHERE passage_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "canonical_order": f"WITH {LINES} SELECT order_id, id FROM lines ORDER BY order_id, id",
    "small_copy": "SELECT c_custkey, '-' AS pronunciation, c_mktsegment FROM customer",
    "curated_copy": "SELECT lang, count(*) AS n, CASE WHEN lang IN ('en', 'fr') THEN 'kept' ELSE 'removed' END AS fate FROM documents WHERE lang IS NOT NULL GROUP BY lang",
    "event_frames": """WITH f AS (SELECT *, CASE WHEN event_id % 10 <> 9 THEN CASE event_type WHEN 'click' THEN 'match' WHEN 'view' THEN 'partial' WHEN 'purchase' THEN 'jaikara' END END AS type FROM events)
        SELECT type, count(*) AS n, min(CASE WHEN event_id % 4 = 0 THEN -1 ELSE event_id END) AS first_seq FROM f WHERE type IS NOT NULL GROUP BY type UNION ALL SELECT 'aside', count(*), -1 FROM f WHERE type IS NULL""",
    "sample_names": """WITH c AS (SELECT c_custkey, c_custkey % 5 AS k FROM customer) SELECT c_custkey, CASE WHEN k > 0 THEN 'bhai_singh' END AS singer, CASE WHEN k = 1 THEN 'unknown_raag' WHEN k > 0 THEN 'soohee' END AS raag,
        CASE WHEN k IN (0, 2) THEN -1 ELSE c_custkey % 1430 + 1 END AS page, CASE WHEN k = 0 THEN -1 ELSE c_custkey % 19 END AS line_no, CASE WHEN k = 3 THEN 'nagar_kirtan' WHEN k > 0 THEN 'studio' END AS difficulty, k = 0 AS legacy FROM c""",
    "registry_issues": """WITH c AS (SELECT c_custkey AS k, c_custkey % 1600 AS a, c_custkey % 1600 + c_custkey % 2 - 1 AS b FROM customer) SELECT array_to_string(list_filter([CASE WHEN k % 4 = 0 THEN 'audio_sha256' END, CASE WHEN k % 3 = 0 THEN 'raag' END,
        CASE WHEN a NOT BETWEEN 1 AND 1430 THEN 'ang_start' END, CASE WHEN b NOT BETWEEN 1 AND 1430 OR b < a THEN 'ang_end' END, CASE WHEN k % 7 = 0 THEN 'recording_quality' END], lambda x: x IS NOT NULL), ',') AS issues, count(*) AS n FROM c GROUP BY 1""",
    "admitted_audio": """WITH f AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE (o_totalprice * 60)::DOUBLE END AS b FROM orders) SELECT CASE WHEN k % 3 <> 0 AND k % 5 <> 0 THEN 'unsupported_media_type' WHEN trunc(b) > 10485760 THEN 'file_too_large'
        WHEN trunc(b) = 0 THEN 'empty_audio_file' WHEN k % 11 = 0 THEN 'unreadable_audio' WHEN k % 70 > 60 THEN 'audio_too_long' ELSE 'ok' END AS reason, count(*) AS n FROM f GROUP BY 1""",
    "request_paths": "SELECT page_id AS id, string_split(url, '?')[1] AS path, 'GET' AS method, 200 + page_id % 3 AS status FROM pages",
}
# --- Text
ORACLES |= {
    "text_functions": f"""WITH t AS (SELECT conv_id, turn, text, {NORM.format("text")} AS norm, regexp_replace(text, '\\s+', '', 'g') AS bare FROM conversations)
        SELECT conv_id, turn, norm, len(list_filter(string_split(norm, ' '), lambda x: length(x) >= 3))::BIGINT AS n_long, strip_accents(lower(text)) AS plain,
        length(bare) > 500 OR (length(bare) >= 12 AND (len(list_filter(range(1, length(bare) - 8), lambda i: substring(bare, i, 10) = repeat(substring(bare, i, 1), 10))) > 0
        OR len(list_filter(range(1, length(bare) - 8, 2), lambda i: substring(bare, i, 10) = repeat(substring(bare, i, 2), 5))) > 0)) AS loop FROM t""",
    "final_schwa": f"SELECT conv_id, turn, {SCHWA.format('lower(text)')} AS latin FROM conversations",
    "script_of": """SELECT conv_id, turn, CASE WHEN turn % 3 = 2 OR NOT regexp_matches(lower(text), '[abcdeghiklmnoprstuy]') THEN CASE WHEN turn % 3 = 1 THEN 'devanagari' ELSE 'other' END WHEN turn % 3 = 0 THEN 'gurmukhi' ELSE 'devanagari' END AS script FROM conversations""",
    "interjections": f"""WITH {LINES}, n AS (SELECT id, norm AS low, length(norm) AS n FROM lines), s AS (SELECT id, CASE WHEN n > 24 THEN NULL ELSE coalesce({", ".join(f"CASE WHEN CASE WHEN n < 8 THEN n >= 3 AND starts_with('{x}', low) ELSE contains(low, '{x}') END THEN '{x}' END" for x in ("the", "and of", "que"))}) END AS seed FROM n)
        SELECT id, seed FROM s WHERE seed IS NOT NULL""",
    "clean_transcripts": "SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN regexp_replace(trim(regexp_replace(text, '\\s*$', '')), '^(transcript|transcription|text):\\s*', '', 'i') ELSE trim(text) END AS text FROM conversations",
    "recoded_font": f"SELECT c_custkey, {FONT.format('lower(c_name)')} AS name_unicode, {FONT.format('lower(c_mktsegment)')} AS segment_unicode FROM customer",
    "good_transcripts": """WITH b AS (SELECT conv_id, turn, trim(text) AS said, regexp_replace(trim(text), '\\s+', '', 'g') AS bare FROM conversations WHERE turn % 5 > 1 AND conv_id % 7 <> 0)
        SELECT conv_id, turn FROM b WHERE (said = '' OR regexp_matches(said, '[a-z]')) AND NOT (length(bare) > 500 OR (length(bare) >= 12 AND (len(list_filter(range(1, length(bare) - 8), lambda i: substring(bare, i, 10) = repeat(substring(bare, i, 1), 10))) > 0
        OR len(list_filter(range(1, length(bare) - 8, 2), lambda i: substring(bare, i, 10) = repeat(substring(bare, i, 2), 5))) > 0)))""",
    "pseudonyms": f"SELECT c_custkey, {HMAC.format('c_custkey::VARCHAR')} AS pseudonym FROM customer",
    "token_ratio": f"WITH p AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS w FROM part) SELECT p_partkey, round({ratio('w[1]', 'w[2]')}, 6) AS ratio, round({ratio('repeat(array_to_string(w, chr(0)), 4)', 'array_to_string(list_reverse(w), chr(0))').replace('chr(0)', chr(39) * 2)}, 6) AS long_ratio FROM p",
    "line_coverage": f"""WITH p AS (SELECT p_partkey, list_filter(string_split(lower(p_name), ' '), lambda x: length(x) >= 3) AS q, string_split(lower(p_brand || ' ' || p_type), ' ') AS t FROM part),
        m AS (SELECT p_partkey, len(q) AS n, len(list_filter(q, lambda a: len(list_filter(t, lambda b: {ratio('a', 'b')} >= 55)) > 0)) AS met FROM p)
        SELECT p_partkey, round(CASE WHEN n > 0 THEN met / n::DOUBLE * least(1.0, n / 4.0::DOUBLE) ELSE 0 END, 6) AS coverage FROM m""",
}
# --- Windows and spans
_VOWEL = r"(regexp_matches({0}, '\p{{L}}') AND NOT regexp_matches(lower({0}), '[b-df-hj-np-tv-z]'))"
WORDS = r"""
said AS (SELECT conv_id AS sample_id, turn::BIGINT AS seg, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM (SELECT *, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS ws FROM conversations)),
words AS (SELECT *, round(seg * 10 + pos * 0.4::DOUBLE, 3) AS start_sec, round(round(seg * 10 + pos * 0.4::DOUBLE, 3) + 0.4::DOUBLE, 3) AS end_sec FROM said)
"""
GAPS = f"""
ends AS (SELECT conv_id AS sample_id, (max(turn) * 10 + 30)::DOUBLE AS start_sec, NULL::DOUBLE AS end_sec FROM conversations GROUP BY conv_id),
both_ AS (SELECT sample_id, start_sec, end_sec FROM spans UNION ALL SELECT * FROM ends),
holes AS (SELECT sample_id, since AS start_sec, start_sec AS end_sec FROM (SELECT *, lag(end_sec, 1, 0) OVER (PARTITION BY sample_id ORDER BY start_sec, end_sec NULLS LAST) AS since FROM both_) WHERE start_sec - since > 2),
gaps AS (SELECT h.sample_id, h.start_sec, h.end_sec, CASE WHEN count(word) = 0 THEN 'silence' WHEN bool_and({_VOWEL.format("word")}) FILTER (word IS NOT NULL) THEN 'vocalise' ELSE 'unknown' END AS kind
  FROM holes h LEFT JOIN words w ON w.sample_id = h.sample_id AND (w.start_sec + w.end_sec) / 2 >= h.start_sec AND (w.start_sec + w.end_sec) / 2 < h.end_sec GROUP BY ALL)
"""
ORACLES |= {
    "token_windows": r"""WITH t AS (SELECT conv_id AS sample_id, turn::BIGINT AS seg, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ts FROM conversations), n AS (SELECT *, len(ts) AS n FROM t WHERE len(ts) > 0),
        w AS (SELECT *, unnest(CASE WHEN n <= 8 THEN [0] ELSE list_filter(range(0, n, 3), lambda i: n - i >= 3) END) AS i FROM n), x AS (SELECT *, CASE WHEN n <= 8 THEN n ELSE least(6, n - i) END AS size FROM w)
        SELECT sample_id, seg, i AS word_start, i + size AS word_end, round(seg * 10 + i * (10.0::DOUBLE / n), 6) AS start_sec, array_to_string(ts[i + 1:i + size], ' ') AS text FROM x""",
    "word_windows": f"""WITH {WORDS}, r AS (SELECT *, row_number() OVER w - 1 AS rn, list(word) OVER a AS ws, last_value(end_sec) OVER a AS until FROM words WHERE word <> ''
        WINDOW w AS (PARTITION BY sample_id ORDER BY start_sec, seg, pos), a AS (PARTITION BY sample_id ORDER BY start_sec, seg, pos ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING))
        SELECT sample_id, rn AS word_start, rn + len(ws) AS word_end, start_sec, until AS end_sec, array_to_string(ws, ' ') AS text FROM r WHERE rn % 3 = 0 AND len(ws) >= 3""",
    "gaps": f"WITH {SPANS}, {WORDS}, {GAPS} SELECT * FROM gaps",
    "aligned": f"""WITH {TIERED}, {WORDS}, {GAPS}, k AS (SELECT *, kind = 'line' AND len(list_filter(string_split(text, ' '), lambda x: NOT {_VOWEL.format("x")})) = 0 AS sung FROM rep),
        z AS (SELECT sample_id, start_sec, end_sec, CASE WHEN sung THEN 'vocalise' ELSE kind END AS kind, repeat_group, confidence, coverage FROM k)
        SELECT sample_id, start_sec, end_sec, kind, CASE WHEN kind <> 'line' THEN 'n/a' WHEN NOT (end_sec - start_sec BETWEEN 1.5 AND 25) OR repeat_group IS NOT NULL THEN 'needs_review' WHEN confidence >= 80 AND coverage >= 0.7 THEN 'high'
        WHEN confidence >= 65 AND coverage >= 0.5 THEN 'medium' ELSE 'needs_review' END AS tier FROM z UNION ALL SELECT sample_id, start_sec, end_sec, kind, 'n/a' FROM gaps""",
    "written_alignments": f"WITH {TIERED} SELECT sample_id, tier, count(*) AS n, max(start_sec) AS last FROM tiered GROUP BY ALL",
}
# --- Training sets
_REPORT = """rep_ AS (SELECT count(*) AS n_rows, count(DISTINCT (page, line_no)) AS n_lines, count(DISTINCT source) AS n_sources FROM training)"""
ORACLES |= {
    "skip_reasons": f"""WITH {TIERED}, {SAMPLES}, r AS (SELECT 'sample' AS level, CASE WHEN pending THEN 'status' WHEN no_file THEN 'no_alignment_file' WHEN archival THEN 'recording_quality' END AS reason FROM samples
        UNION ALL SELECT 'segment', CASE WHEN tier NOT IN ('high', 'medium') THEN 'tier' WHEN kind <> 'line' THEN 'kind' WHEN text = '' THEN 'no_text' WHEN repeat_group IS NOT NULL THEN 'repeat' WHEN page IS NULL OR line_no IS NULL THEN 'no_line' END FROM tiered)
        SELECT level, reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY ALL""",
    "registry_reasons": f"""WITH {TIERED}, {SAMPLES}, s AS (SELECT sample_id, CASE WHEN pending THEN 'status' WHEN no_file THEN 'no_alignment_file' WHEN archival THEN 'recording_quality' WHEN sample_id % 17 = 0 THEN 'alignment_missing'
          WHEN sample_id % 19 = 0 THEN 'alignment_broken' WHEN sample_id % 23 = 0 THEN 'alignment_stale' END AS reason FROM samples),
        r AS (SELECT 'sample' AS level, reason FROM s
        UNION ALL SELECT 'segment', CASE WHEN tier NOT IN ('high', 'medium') THEN 'tier' WHEN kind <> 'line' THEN 'kind' WHEN text = '' THEN 'no_text' WHEN repeat_group IS NOT NULL THEN 'repeat' WHEN page IS NULL OR line_no IS NULL THEN 'no_line' END
          FROM tiered WHERE sample_id IN (SELECT sample_id FROM s WHERE reason IS NULL))
        SELECT level, reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY ALL""",
    "coverage_vs_targets": f"WITH {TRAINING}, {_REPORT} SELECT metric, got::DOUBLE AS got, target, got >= target AS met FROM (SELECT unnest(['n_rows', 'n_lines', 'n_sources']) AS metric, unnest([n_rows, n_lines, n_sources]) AS got, unnest([10.0::DOUBLE, 1e6::DOUBLE, 3.0::DOUBLE]) AS target FROM rep_)",
    "manifest_checked": f"""WITH {TRAINING}, c AS (SELECT split, count(*) AS got FROM training GROUP BY split), stated AS (SELECT split, got AS n FROM c UNION ALL SELECT 'train', 1 UNION ALL SELECT 'extra', 3)
        SELECT 'no_rows' AS problem, sample_id::VARCHAR AS what FROM samples WHERE sample_id NOT IN (SELECT sample_id FROM training)
        UNION ALL SELECT 'no_alignment', sample_id::VARCHAR FROM samples WHERE no_file OR sample_id % 3 = 0 UNION ALL SELECT 'no_audio', sample_id::VARCHAR FROM samples WHERE sample_id % 5 = 0
        UNION ALL SELECT 'split_count', split FROM stated LEFT JOIN c USING (split) WHERE coalesce(got, 0) <> n""",
    "release_gate": f"""WITH {TRAINING}, g AS (SELECT (SELECT count(*) FROM training) >= 1 AS targets_met, (SELECT count(*) FROM samples ANTI JOIN training USING (sample_id)) = 0 AND (SELECT count(*) FROM training WHERE split = 'train') = 1 AS clean) SELECT *, targets_met AND clean AS passed FROM g""",
    "distinct_samples": f"WITH {TRAINING} SELECT DISTINCT sample_id, source, split FROM training",
    "content_build_id": "SELECT substring(sha256(string_agg(doc_id || '|' || sha256(text) || chr(10), '' ORDER BY doc_id::VARCHAR)), 1, 16) AS build_id FROM documents",
    "content_tree_id": "SELECT 2 AS ids, 1 AS same",
    "all_splits": f"WITH {TRAINING} SELECT split, count(*) AS n FROM training GROUP BY split",
    "written_splits": f"WITH {TRAINING} SELECT sample_id, idx, duration_sec, split, length(sentence)::INT AS chars FROM training",
    "weighted_draws": f"WITH {TRAINING} SELECT 1000 AS draws, count(DISTINCT source) AS strata, true AS all_drawn FROM training",
    "stored_feedback": f"""WITH {FEEDBACK} SELECT kind AS correction_type, count(*) AS n, sum(ang) AS pages, count(DISTINCT token) AS sessions, false AS with_audio FROM fb WHERE issues = '' GROUP BY kind""",
}
# --- Evaluation
ORACLES |= {
    "near_misses": f"""WITH {SUMMARY}, s AS (SELECT *, sample_id % 5 AS grp FROM summary) SELECT sample_id, grp, coalesce(best_passage, -1) AS best_passage, best_confidence, best_confidence < 75 AND best_passage IS NOT NULL AND EXISTS (SELECT 1 FROM s AS o
        WHERE o.sample_id <> s.sample_id AND o.best_passage = s.best_passage AND (o.best_confidence >= 75 OR o.grp = s.grp)) AS near_miss FROM s""",
    "eval_notes": f"""WITH {SUMMARY} SELECT sample_id, CASE WHEN sample_id % 9 = 0 THEN 'timed out after ' || windows_total || ' windows' WHEN windows_confident = 0 THEN 'none confident' WHEN windows_confident = windows_total THEN 'all confident'
        WHEN pages <> '' AND pages NOT LIKE '%,%' THEN 'one page: ' || pages WHEN len(string_split(pages, ',')) > 3 THEN 'scattered over ' || len(string_split(pages, ',')) || ' pages' ELSE (CASE WHEN pages = '' THEN 0 ELSE len(string_split(pages, ',')) END) || ' pages' END AS note FROM summary""",
    "written_summaries": f"""WITH {SUMMARY} SELECT sample_id || '.wav' AS filename, (sample_id % 5)::VARCHAR AS "group", '' AS ground_truth, coalesce(best_page::VARCHAR, '') AS best_page, coalesce(best_line::VARCHAR, '') AS best_line, coalesce(best_passage::VARCHAR, '') AS best_passage,
        printf('%.1f', best_confidence) AS best_confidence, '' AS best_time, windows_confident::VARCHAR AS windows_confident, windows_total::VARCHAR AS windows_total, '' AS near_miss, 'false' AS timed_out, '' AS elapsed_sec, replace('a, ' || pages, ',', ';') AS notes FROM summary""",
    "error_rates": "WITH t AS (SELECT text AS r, regexp_replace(text, '^[^ ]* ?', '') AS h FROM conversations) SELECT round(sum(length(r) - length(h)) / sum(length(r))::DOUBLE, 9) AS cer, round(count(*) / sum(len(string_split(r, ' ')))::DOUBLE, 9) AS wer FROM t",
    "model_compare": f"""WITH {HYP}, h2 AS (SELECT * REPLACE (100 - confidence AS confidence, page % 3 AS page) FROM hyp), a AS (SELECT DISTINCT ON (sample_id) sample_id, page, confidence >= 75 AS sure FROM hyp ORDER BY sample_id, confidence DESC, seq),
        b AS (SELECT DISTINCT ON (sample_id) sample_id, page, confidence >= 75 AS sure FROM h2 ORDER BY sample_id, confidence DESC, seq), j AS (SELECT a.sample_id, a.page AS pa, b.page AS pb, a.sure AS sa, b.sure AS sb FROM a JOIN b USING (sample_id)),
        g AS (SELECT sample_id // 3 AS grp, count(DISTINCT coalesce(pa, -1)) AS na, count(DISTINCT coalesce(pb, -1)) AS nb FROM j GROUP BY 1 HAVING count(*) > 1)
        SELECT count(*) AS samples, count(*) FILTER (sa) AS sure_a, count(*) FILTER (sb) AS sure_b, count(*) FILTER (pa = pb) AS same_page, count(*) FILTER (sample_id % 4 = 0 AND NOT sa) AS rejected_a, count(*) FILTER (sample_id % 4 = 0 AND NOT sb) AS rejected_b,
        (SELECT count(*) FROM g) AS groups, (SELECT count(*) FROM g WHERE na = 1) AS stable_a, (SELECT count(*) FROM g WHERE nb = 1) AS stable_b FROM j""",
}
# --- Feedback
ORACLES |= {
    "feedback_issues": f"WITH {FEEDBACK} SELECT issues, count(*) AS n FROM fb GROUP BY issues",
    "feedback_by_session": f"WITH {FEEDBACK} SELECT {HMAC.format('token')} AS session_hmac, kind AS correction_type, count(*) AS n FROM fb WHERE issues = '' GROUP BY ALL",
    "newest_feedback": "WITH r AS (SELECT 'session-' || user_id AS session_token, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) DESC, event_id DESC) AS rank FROM events WHERE event_id % 50 <> 0) SELECT * FROM r WHERE rank <= 5",
    "erased_feedback": f"WITH {FEEDBACK} SELECT kind AS correction_type, count(*) AS n FROM fb WHERE token NOT IN (SELECT 'session-' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1",
    "erased_counts": f"WITH {FEEDBACK} SELECT CASE WHEN id % 2 = 0 THEN token ELSE 'not-' || token END AS session_hmac, CASE WHEN max(id % 2) = 0 THEN count(*) ELSE 0 END AS erased FROM fb WHERE id % 3 = 0 GROUP BY 1",
    "corrected_labels": f"WITH {LINES}, f AS (SELECT page, line_no, arg_min(id, order_id) AS line_id FROM lines GROUP BY page, line_no) SELECT event_id AS id, line_id, 'human' AS labeled_by FROM events JOIN f ON page = event_id % 1430 + 1 AND line_no = event_id % 4 WHERE event_id % 3 = 1",
    "correction_queue": "SELECT event_id AS id FROM events WHERE event_id % 3 = 0",
}
# --- Sessions: folds over the ordered events of a session
_FOLD = "f AS (SELECT session_id, list_reduce(list({{{0}}} ORDER BY ts, seq), lambda a, x: {1}, {2}) AS s FROM m GROUP BY session_id)"
_MATCHES = "m AS (SELECT user_id AS session_id, ts, epoch_us(ts) AS us, event_id AS seq, event_id % 7 AS passage, event_id % 3 AS line, least(value, 100) AS score FROM events)"
_HELD = "a.passage >= 0 AND x.passage <> a.passage AND a.peak >= 85 AND x.us - a.seen < 2500000 AND x.score < 90 AND x.score < a.peak - 5"
_STALE, _SAME = "x.seq < a.seq", "x.passage = a.passage"
_FOLLOW = (
    f"CASE WHEN {_STALE} THEN {{passage: a.passage, seq: a.seq, peak: a.peak, seen: a.seen, n: list_append(a.n, 'stale')}} WHEN {_SAME} THEN {{passage: a.passage, seq: x.seq, peak: greatest(a.peak, x.score), seen: x.us, n: list_append(a.n, 'highlight')}} "
    f"WHEN {_HELD} THEN {{passage: a.passage, seq: a.seq, peak: a.peak, seen: a.seen, n: list_append(a.n, 'held')}} ELSE {{passage: x.passage, seq: x.seq, peak: x.score, seen: x.us, n: list_append(a.n, CASE WHEN a.passage < 0 THEN 'first' ELSE 'swap' END)}} END"
)
_LOW = "CASE WHEN x.score >= 50 THEN -1 WHEN a.low < 0 THEN x.us ELSE a.low END"
_MODE = f"CASE WHEN a.mode = 'SEARCHING' AND x.score >= 75 OR a.mode <> 'SEARCHING' AND x.score >= 65 THEN 'LOCKED' WHEN a.mode = 'LOCKED' THEN 'DRIFTING' WHEN a.mode = 'DRIFTING' AND {_LOW} >= 0 AND x.us - {_LOW} >= 30000000 THEN 'SEARCHING' ELSE a.mode END"
ORACLES |= {
    "rolling_scores": """WITH e AS (SELECT user_id AS session_id, epoch_us(ts) AS us, value / 100 AS score, unnest(range(7)) AS j FROM events), w AS (SELECT *, us - us % 69120000000 - j * 69120000000 AS s FROM e)
        SELECT session_id, make_timestamp(s) AS start, count(*) AS n, max(score) AS best FROM w WHERE us < s + 432000000000 GROUP BY session_id, s HAVING max(us) - min(us) >= 25920000000""",
    "tumbling_scores": "SELECT user_id AS session_id, make_timestamp(epoch_us(ts) - epoch_us(ts) % 2000000) AS start, count(*) AS n, max(value / 100) AS best FROM events GROUP BY 1, 2",
    "auto_selected": """WITH t AS (SELECT user_id AS session_id, date_trunc('week', ts) AS ts, CASE WHEN count(DISTINCT event_type) FILTER (value / 100 >= 0.5) = 1 THEN min(event_type) FILTER (value / 100 >= 0.5) END AS text FROM events GROUP BY ALL),
        r AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY ts) AS run FROM (SELECT *, CASE WHEN text = lag(text) OVER (PARTITION BY session_id ORDER BY ts) THEN 0 ELSE 1 END AS new FROM t))
        SELECT session_id, text, epoch(min(ts))::BIGINT AS since, epoch(max(ts))::BIGINT AS until FROM r WHERE text IS NOT NULL GROUP BY session_id, run, text HAVING epoch(max(ts)) - epoch(min(ts)) >= 86400""",
    "banners": f"""WITH {EVENTS}, g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 7200000000 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS far FROM ev {_W}),
        r AS (SELECT *, sum(far) OVER (PARTITION BY session_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT session_id, count(*) AS n, epoch_us(min(ts)) // 1000000 AS since, (epoch_us(max(ts)) + 7200000000) // 1000000 AS until FROM r GROUP BY session_id, run""",
    "energy_guarded": f"""WITH {EVENTS}, b AS (SELECT *, max(score) OVER r < 0.5 AND count(score) OVER r = 3 AS quiet, length(text) > coalesce(lag(length(text)) OVER w, 0) AS grew FROM ev
        WINDOW w AS (PARTITION BY session_id ORDER BY ts, seq), r AS (PARTITION BY session_id ORDER BY ts, seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) SELECT session_id, id FROM b WHERE NOT (quiet AND grew)""",
    "status_transitions": f"""WITH {EVENTS}, k AS (SELECT session_id, date_trunc('day', ts) AS ts, seq, id, CASE text WHEN 'click' THEN 'recording' WHEN 'view' THEN 'processing' ELSE CASE WHEN id % 211 = 0 THEN 'error' ELSE 'listening' END END AS status FROM ev),
        o AS (SELECT *, CASE status WHEN 'error' THEN 0 WHEN 'recording' THEN 1 WHEN 'processing' THEN 2 ELSE 3 END AS rank FROM k), t AS (SELECT DISTINCT ON (session_id, ts) * FROM o ORDER BY session_id, ts, rank, seq),
        e AS (SELECT * FROM t WHERE ts <= coalesce((SELECT min(x.ts) FROM t AS x WHERE x.session_id = t.session_id AND x.status = 'error'), ts)), b AS (SELECT *, lag(status) OVER (PARTITION BY session_id ORDER BY ts) AS before FROM e)
        SELECT session_id, status, count(*) AS n FROM b WHERE before IS NULL OR before <> status GROUP BY ALL""",
    "followed_positions": f"WITH {_MATCHES}, {_FOLD.format('us: us, seq: seq, passage: passage, score: score', _FOLLOW, '{passage: -1::BIGINT, seq: -1::BIGINT, peak: 0::DOUBLE, seen: 0::BIGINT, n: []::VARCHAR[]}')} SELECT session_id, action, count(*) AS n FROM (SELECT session_id, unnest(s.n) AS action FROM f) GROUP BY ALL",
    "tracked_modes": f"WITH {_MATCHES}, {_FOLD.format('us: us, score: score', '{mode: ' + _MODE + ', low: ' + _LOW + ', n: list_append(a.n, ' + _MODE + ')}', chr(123) + 'mode: ' + repr('SEARCHING') + ', low: -1::BIGINT, n: []::VARCHAR[]}')} SELECT session_id, mode, count(*) AS n FROM (SELECT session_id, unnest(s.n) AS mode FROM f) GROUP BY ALL",
    "last_good_shown": f"""WITH m AS (SELECT user_id AS session_id, ts, event_id AS seq, coalesce(props, '') AS text, event_type = 'click' AS canonical FROM events),
        {_FOLD.format('text: text, canonical: canonical', '{shown: CASE WHEN x.text <> ' + repr('') + ' AND (x.canonical OR length(a.shown) <= 12 OR 2 * length(x.text) >= length(a.shown)) THEN x.text ELSE a.shown END, n: a.n + 1, chars: a.chars + length(CASE WHEN x.text <> ' + repr('') + ' AND (x.canonical OR length(a.shown) <= 12 OR 2 * length(x.text) >= length(a.shown)) THEN x.text ELSE a.shown END)}', '{shown: ' + repr('') + ', n: 0::BIGINT, chars: 0::BIGINT}')}
        SELECT session_id, s.n AS n, s.chars AS chars FROM f""",
    "rate_limited": f"""WITH m AS (SELECT user_id AS session_id, ts, epoch_us(ts) AS us, event_id AS seq FROM events),
        {_FOLD.format('us: us, seq: seq', '{recent: CASE WHEN len(list_filter(a.recent, lambda r: r >= x.us - 86400000000)) < 3 THEN list_append(list_filter(a.recent, lambda r: r >= x.us - 86400000000), x.us) ELSE list_filter(a.recent, lambda r: r >= x.us - 86400000000) END, out: list_append(a.out, {id: x.seq, before: len(list_filter(a.recent, lambda r: r >= x.us - 86400000000))})}', '{recent: []::BIGINT[], out: []::STRUCT(id BIGINT, before BIGINT)[]}')},
        o AS (SELECT session_id AS key, unnest(s.out) AS o FROM f) SELECT key, o.id AS id, o.before < 3 AS allowed, 3 - least(3, o.before + 1) AS remaining FROM o""",
}

# --- Live sessions, step by step
UTTERANCES = """
WITH RECURSIVE u AS (SELECT user_id AS session_id, epoch_us(ts) AS us, value / 100 AS prob, row_number() OVER (PARTITION BY user_id ORDER BY ts, value) AS n FROM events),
r AS (SELECT DISTINCT session_id, 0::BIGINT AS n, NULL::BIGINT AS since, NULL::BIGINT AS last, 0::BIGINT AS voiced, 0::BIGINT AS silent, 0::BIGINT AS total, []::BIGINT[] AS ring,
    NULL::BIGINT AS e_since, NULL::BIGINT AS e_until, NULL::BIGINT AS e_voiced, NULL::VARCHAR AS e_reason FROM u
  UNION ALL
  SELECT session_id, n, CASE WHEN ends THEN NULL WHEN open THEN s0 WHEN active THEN ring2[1] END, us, CASE WHEN ends THEN 0 WHEN open THEN v WHEN active THEN 3600000000 ELSE 0 END, CASE WHEN open AND NOT ends THEN q ELSE 0 END,
    CASE WHEN ends THEN 0 WHEN open THEN t WHEN active THEN 3600000000 ELSE 0 END, CASE WHEN open OR active THEN [] ELSE ring2 END,
    CASE WHEN ends OR (gapped AND v0 >= 7200000000) THEN s0 END, CASE WHEN ends THEN us + 3600000000 ELSE last + 3600000000 END, CASE WHEN ends THEN v ELSE v0 END, CASE WHEN quiet THEN 'silence' WHEN ends THEN 'length' ELSE 'gap' END
  FROM (SELECT *, open AND q >= 10000000000 AND v >= 7200000000 AS quiet, open AND (q >= 10000000000 AND v >= 7200000000 OR t >= 28800000000) AS ends
    FROM (SELECT *, s0 IS NOT NULL AND NOT gapped AS open, v0 + CASE WHEN active THEN 3600000000 ELSE 0 END AS v, CASE WHEN active THEN 0 ELSE q0 + 3600000000 END AS q, t0 + 3600000000 AS t,
        list_append(list_filter(ring, lambda x: x >= us + 3600000000 - 90000000000), us) AS ring2
      FROM (SELECT r.session_id, u.n, u.us, u.prob >= 0.3 AS active, last, ring, since AS s0, voiced AS v0, silent AS q0, total AS t0, since IS NOT NULL AND last + 400000000000 <= us AS gapped
        FROM r JOIN u ON u.session_id = r.session_id AND u.n = r.n + 1)))),
h AS (SELECT max(us) // 1000 * 1000 AS until FROM u)
SELECT session_id, e_since AS since, e_until AS until, e_voiced AS voiced, e_reason AS reason FROM r WHERE e_since IS NOT NULL
UNION ALL SELECT session_id, since, last + 3600000000, voiced, 'gap' FROM r, h WHERE since IS NOT NULL AND voiced >= 7200000000 AND last + 400000000000 <= until
  AND n = (SELECT count(*) FROM u WHERE u.session_id = r.session_id)
"""
_DICE = "(CASE WHEN len({0}) + len({1}) = 0 THEN 0 ELSE 200.0::DOUBLE * len(list_intersect({0}, {1})) / (len({0}) + len({1})) END)"
_LETTERS = "translate(array_to_string(list_transform(list_filter(string_split({0}, ' '), lambda x: x <> ''), lambda x: x[1]), ''), 'bfgdj', 'ppktc')"
_TOKS = "list_distinct(list_filter(string_split({0}, ' '), lambda x: x <> ''))"
READERS = f"""{LINES},
c AS (SELECT order_id, passage_id AS doc, line_no, norm, {_TOKS.format("norm")} AS toks FROM lines WHERE norm <> '' AND line_type <> 'heading'),
said AS (SELECT doc // 4 AS session_id, (1700000000 + (doc % 4 * 100000 + line_no) * 4 + line_no // 11 * 12) * 1000000 AS us, order_id AS seq, line_no % 40 = 25 AS interjection,
  CASE WHEN line_no % 40 BETWEEN 20 AND 31 THEN 'zzz yyy' WHEN (line_no * 7 + doc) % 10 IN (7, 8) THEN array_to_string(list_filter(string_split(norm, ' '), lambda x, i: i % 2 = 1), ' ') ELSE norm END AS text FROM c),
first_ AS (SELECT {_LETTERS.format("norm")} AS letters, min(order_id) AS hit, arg_min(toks, order_id) AS hit_toks FROM c GROUP BY letters),
u AS (SELECT session_id, us, seq, interjection, text, own, hit, CASE WHEN hit IS NOT NULL THEN {_DICE.format("own", "hit_toks")} ELSE 0 END AS hit_score, row_number() OVER (PARTITION BY session_id ORDER BY us, seq) AS n
  FROM (SELECT *, {_TOKS.format("text")} AS own FROM said) LEFT JOIN first_ ON letters = {_LETTERS.format("text")} AND letters <> '')"""
POSITIONS = f"""
WITH RECURSIVE {READERS},
r AS (SELECT DISTINCT session_id, 0::BIGINT AS n, NULL::BIGINT AS seq, 'SEARCHING' AS mode, NULL::BIGINT AS line, 0 AS weak, NULL::BIGINT AS low, NULL::BIGINT AS last, 0::DOUBLE AS score, false AS held, false AS asked FROM u
  UNION ALL
  SELECT session_id, n, seq, CASE WHEN found THEN 'LOCKED' WHEN drifts THEN 'DRIFTING' WHEN lost THEN 'SEARCHING' ELSE mode END, CASE WHEN found THEN best WHEN lost AND NOT drifts THEN NULL ELSE line END,
    CASE WHEN found OR drifts OR lost THEN 0 ELSE weak2 END, CASE WHEN found OR (lost AND NOT drifts) THEN NULL ELSE low2 END, us, score, held, asked
  FROM (SELECT *, NOT found AND weak2 >= 2 AS drifts, NOT found AND mode = 'DRIFTING' AND low2 IS NOT NULL AND us - low2 >= 30000000 AS lost
    FROM (SELECT *, score >= CASE WHEN mode = 'SEARCHING' THEN 75 ELSE 65 END AS found, weak + CASE WHEN mode = 'LOCKED' THEN 1 ELSE 0 END AS weak2, CASE WHEN score < 50 THEN coalesce(low, us) END AS low2
      FROM (SELECT session_id, n, seq, us, mode, line, weak, low, held, asked, CASE WHEN mode = 'SEARCHING' THEN hit ELSE b.o END AS best, CASE WHEN mode = 'SEARCHING' THEN hit_score ELSE coalesce(b.s, 0) END AS score
        FROM (SELECT session_id, n, x.seq, us, mode, line, weak, low, held, asked, hit, hit_score,
            max({{v: {_DICE.format("own", "toks")} + CASE WHEN mode = 'LOCKED' THEN 5.0::DOUBLE ELSE 2.0::DOUBLE END * (1.0::DOUBLE - abs(order_id - line) / (CASE WHEN mode = 'LOCKED' THEN 200 ELSE 2000 END)::DOUBLE), o: order_id, s: {_DICE.format("own", "toks")}}}) FILTER (order_id IS NOT NULL) AS b
          FROM (SELECT session_id, n, seq, us, own, hit, hit_score, held, asked, CASE WHEN gone THEN 'SEARCHING' ELSE mode END AS mode, CASE WHEN NOT gone THEN line END AS line, CASE WHEN gone THEN 0 ELSE weak END AS weak, CASE WHEN NOT gone THEN low END AS low
            FROM (SELECT r.session_id, u.n, u.seq, u.us, u.own, u.hit, u.hit_score, mode, line, weak, low, coalesce(u.us >= last + 10000000, false) AS held, coalesce(u.us >= last + 300000000, false) AS asked,
                coalesce(mode = 'DRIFTING' AND low + 30000000 <= last + 10000000 AND low + 30000000 <= u.us, false) AS gone FROM r JOIN u ON u.session_id = r.session_id AND u.n = r.n + 1)) AS x
          LEFT JOIN c ON mode <> 'SEARCHING' AND c.doc = line // 100000 AND abs(c.order_id - line) <= CASE WHEN mode = 'LOCKED' THEN 200 ELSE 2000 END
          GROUP BY session_id, n, x.seq, us, mode, line, weak, low, held, asked, hit, hit_score)))))
SELECT session_id, seq, mode, coalesce(line, -1) AS line, round(score, 6) AS score, held, asked FROM r WHERE n > 0
"""
_TAKEN = "({0}.s >= 60 OR ({0}.s >= 40 AND (coalesce({1}, 0) = 0 OR {0}.s >= 1.8::DOUBLE * {1})))"
PASSAGES = f"""
WITH RECURSIVE {READERS},
r AS (SELECT DISTINCT session_id, 0::BIGINT AS n, NULL::BIGINT AS seq, 'none' AS outcome, NULL::BIGINT AS passage, -1::BIGINT AS stand, []::BIGINT[] AS seen, NULL::BIGINT AS line, 0::DOUBLE AS score FROM u
  UNION ALL
  SELECT session_id, n, seq, outcome, CASE WHEN line IS NULL THEN passage ELSE line // 100000 END, CASE WHEN line IS NULL THEN stand ELSE seq END, CASE WHEN line IS NULL THEN seen ELSE list_distinct(list_append(seen, line // 100000)) END, line, score
  FROM (SELECT session_id, n, seq, passage, stand, seen, what AS outcome, CASE what WHEN 'tier 1' THEN a.o WHEN 'tier 2' THEN b.o WHEN 'tier 3' THEN hit END AS line, CASE what WHEN 'tier 1' THEN a.s WHEN 'tier 2' THEN b.s WHEN 'tier 3' THEN hit_score ELSE 0 END AS score
    FROM (SELECT *, CASE WHEN interjection THEN 'interjection' WHEN seq < stand THEN 'stale' WHEN a IS NOT NULL AND CASE WHEN short THEN a.s >= 85 ELSE {_TAKEN.format("a", "a2")} END THEN 'tier 1' WHEN short THEN 'none'
        WHEN b IS NOT NULL AND {_TAKEN.format("b", "b2")} THEN 'tier 2' WHEN hit IS NOT NULL AND hit_score >= 45 THEN 'tier 3' ELSE 'none' END AS what
      FROM (SELECT session_id, n, x.seq, interjection, short, passage, stand, seen, hit, hit_score,
          max({{s: {_DICE.format("own", "toks")}, o: order_id}}) FILTER (c.doc = passage) AS a, (list({_DICE.format("own", "toks")} ORDER BY {_DICE.format("own", "toks")} DESC) FILTER (c.doc = passage))[2] AS a2,
          max({{s: {_DICE.format("own", "toks")}, o: order_id}}) FILTER (c.doc <> passage) AS b, (list({_DICE.format("own", "toks")} ORDER BY {_DICE.format("own", "toks")} DESC) FILTER (c.doc <> passage))[2] AS b2
        FROM (SELECT r.session_id, u.n, u.seq, u.interjection, length(u.text) < 6 AS short, u.own, u.hit, u.hit_score, passage, stand, seen, unnest(CASE WHEN len(seen) = 0 THEN [-1::BIGINT] ELSE seen END) AS doc
          FROM r JOIN u ON u.session_id = r.session_id AND u.n = r.n + 1) AS x LEFT JOIN c ON c.doc = x.doc
        GROUP BY session_id, n, x.seq, interjection, short, passage, stand, seen, hit, hit_score))))
SELECT session_id, seq, outcome, coalesce(passage, -1) AS passage, coalesce(line, -1) AS line, round(score, 6) AS score FROM r WHERE n > 0
"""
ORACLES |= {
    "utterances": UTTERANCES,
    "utterances_live": UTTERANCES,
    "positions_tracked": POSITIONS,
    "positions_tracked_live": POSITIONS,
    "passages_followed": PASSAGES,
    "passages_followed_live": PASSAGES,
    "rate_limited_live": ORACLES["rate_limited"],
    "late_events": """WITH e AS (SELECT event_id, ts, event_id % 3 AS part FROM events), h AS (SELECT k AS part, (SELECT max(ts) FROM e WHERE e.part < k) AS high FROM range(3) AS t(k))
        SELECT event_id, CASE WHEN ts < high - INTERVAL 3 DAY THEN 'late' ELSE 'clean' END AS part FROM e JOIN h USING (part)""",
    "stored_after_erasure": f"WITH {FEEDBACK} SELECT id, {HMAC.format('token')} AS session_hmac, kind AS correction_type FROM fb WHERE issues = '' AND token NOT IN (SELECT 'session-' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
}

# --- A legacy font: the longest entry at each place, from left to right
_ENTRIES = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in _font_table().items()) + "}"
_LONGER = "|".join(sorted((k for k in _font_table() if len(k) > 1), key=lambda k: (-len(k), k)))
_TURNED = "replace(replace(replace(translate({0}, '.;>', ''), 'qs', 'sq'), 'ru', 'ur'), 'Ny', 'yN')"
_RECODED = "array_to_string(list_transform(regexp_extract_all({0}, '(?s)(?:" + _LONGER + "|i.[hrv]?|.)'), lambda x: CASE WHEN m[x] IS NOT NULL THEN m[x] WHEN starts_with(x, 'i') AND length(x) > 1 " \
    "THEN coalesce(m[x[2]], x[2]) || CASE WHEN length(x) > 2 THEN coalesce(m[x[3]], x[3]) ELSE '' END || m['i'] ELSE x END), '')"
ORACLES["recoded_legacy"] = f"""WITH k AS (SELECT doc_id, {_RECODED.format(_TURNED.format("text"))} AS t, {_RECODED.format(_TURNED.format("source"))} AS s FROM documents, (SELECT {_ENTRIES} AS m))
    SELECT doc_id, md5(t) AS text_md5, length(t)::BIGINT AS n, s AS source_unicode FROM k"""
