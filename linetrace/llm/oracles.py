"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from linetrace.llm import license_rules
from linetrace.llm.license_scan import SPDX, SPDX_PART
from linetrace.llm.quality_rules import ALPHA, DELTA, GRID, STEPS

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP3 = f"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
win AS (SELECT doc_id, s, md5(array_to_string(ws[s:s + 34], ' ')) AS h FROM w, unnest(range(1, len(ws) - 33)) AS t(s)),
rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, p FROM win SEMI JOIN rep USING (h), unnest(range(s, s + 35)) AS t(p)),
word AS (SELECT doc_id, p, ws[p] AS word FROM w, unnest(range(1, len(ws) + 1)) AS t(p)),
left_ AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN left_ USING (doc_id)
"""

_VALUES = {
    "symbols": "n_symbols / greatest(n_words, 1)::DOUBLE",
    "dup_lines": "n_dup_lines / greatest(n_words, 1)::DOUBLE",
    "repeats": "n_repeat_words / greatest(n_words, 1)::DOUBLE",
    "long_words": "word_chars / greatest(n_words, 1)::DOUBLE",
    "short_words": "-(word_chars / greatest(n_words, 1)::DOUBLE)",
}
_NOTCH = "least(" + ", ".join(f"len(list_filter({[float(c) for c in cuts]}::DOUBLE[], lambda c: {_VALUES[rule]} <= c))" for rule, cuts in GRID.items()) + ")"
OP4 = rf"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text, {WORDS} AS ws FROM documents),
tri AS (SELECT doc_id, p, ws[p:p + 2] AS t FROM w, unnest(range(1, len(ws) - 1)) AS x(p)),
rep AS (SELECT doc_id, t FROM tri GROUP BY doc_id, t HAVING count(*) > 1),
cov AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 3)) AS q FROM tri SEMI JOIN rep USING (doc_id, t)) GROUP BY doc_id),
line AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
m AS (SELECT w.doc_id, stratum, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w JOIN line USING (doc_id) LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
held AS (SELECT stratum, doc_id, min({_NOTCH}) AS notch FROM f SEMI JOIN good USING (doc_id) WHERE NOT base_failed GROUP BY stratum, doc_id),
tests AS (SELECT stratum, step, count(*) AS n, count(*) FILTER (notch <= step) AS k FROM held, range({STEPS}) AS s(step) GROUP BY GROUPING SETS ((stratum, step), (step))),
tail AS (SELECT stratum, CASE WHEN k >= n * {ALPHA} THEN 1.0 ELSE
  list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({ALPHA}) + (n - j) * ln(1 - {ALPHA})))) END AS p FROM tests),
steps AS (SELECT stratum, count(*) FILTER (p <= {DELTA} / (SELECT count(DISTINCT stratum) + 1 FROM held)) AS steps FROM tail GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {_NOTCH} >= coalesce((SELECT steps FROM steps WHERE steps.stratum = m.stratum AND steps > 0), (SELECT steps FROM steps WHERE stratum IS NULL), 0) AS kept FROM f AS m
"""

_TEXT = "list_transform({0}, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || chr(10))"
_MASK = (
    "array_to_string(list_filter(list_transform(range(1, len({0}) + 1), lambda i: CASE WHEN {0}[i].role = 'assistant' THEN "
    "(coalesce(list_sum(list_transform({0}[1:i - 1], lambda t: length(t.role) + length(t.text) + 6)), 0) + length({0}[i].role) + 5)::BIGINT || ':' || "
    "(coalesce(list_sum(list_transform({0}[1:i], lambda t: length(t.role) + length(t.text) + 6)), 0))::BIGINT END), lambda x: x IS NOT NULL), ',')"
)
OP7 = f"""
WITH t AS (SELECT DISTINCT conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
r AS (SELECT DISTINCT ON (conv_id) conv_id, turn, role, text FROM t WHERE role = 'assistant' ORDER BY conv_id, turn DESC, text DESC),
p AS (SELECT r.conv_id, coalesce(list({{turn: t.turn, role: t.role, text: t.text}} ORDER BY t.turn, t.role, t.text) FILTER (t.turn < r.turn), []) AS before FROM r JOIN t USING (conv_id) GROUP BY r.conv_id),
s AS (SELECT r.conv_id AS pair_id, r.conv_id AS chosen_id, o.conv_id AS rejected_id, before || [{{turn: r.turn, role: r.role, text: r.text}}] AS a,
  CASE WHEN o.conv_id IS NULL THEN [] ELSE before || [{{turn: r.turn, role: o.role, text: o.text}}] END AS b
  FROM r JOIN p USING (conv_id) LEFT JOIN r AS o ON o.conv_id = xor(r.conv_id, 1)),
n AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i].role <> b[i].role OR a[i].text <> b[i].text)) - 1, least(len(a), len(b))) AS n FROM s),
x AS (SELECT *, a[1:n] AS p, a[n + 1:] AS c, b[n + 1:] AS d FROM n)
SELECT pair_id::BIGINT AS pair_id, chosen_id, rejected_id, n::BIGINT AS n_prompt_turns, array_to_string({_TEXT.format("p")}, '') AS prompt, array_to_string({_TEXT.format("c")}, '') AS chosen,
  array_to_string({_TEXT.format("d")}, '') AS rejected, {_MASK.format("c")} AS chosen_mask, {_MASK.format("d")} AS rejected_mask,
  CASE WHEN least(len(a), len(b)) = 0 THEN 'unpaired' WHEN len(c) = 0 AND len(d) = 0 THEN 'identical' ELSE 'pair' END AS status FROM x
"""

def _map(pairs: dict[str, str]) -> str:
    return "(MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in pairs.items()) + "})"


# Sentences are cut as RE2 can, without looking around: letters' full stops go first (twice, as they may
# follow each other), then ends are doubled, and every word stands between spaces of its own.
_END = license_rules.END
_WIDE, _NAME = license_rules.known().replace(" ", "  "), license_rules.name().replace(" ", "  ")


def _replace(text: str, *steps: tuple[str, str]) -> str:
    for pattern, new in steps:
        quoted = pattern.replace("'", "''")
        text = f"regexp_replace({text}, '{quoted}', '{new}', 'g')"
    return text


_LETTER = (r"([^\p{L}\p{N}]\p{L})[.!?]+([\x20\x09-\x0D]|\z)", r"\1 \2")
_PLAIN = _replace(
    f"replace(replace(low, '{_END}', ' '), 'licence', 'license')",
    *[(pattern, license_rules.written(parts, chr(92))) for pattern, parts in (license_rules.FIELD, license_rules.BARE_MIT)],
    _LETTER,
    _LETTER,
    (r"[.!?]+([\x20\x09-\x0D]|\z)", rf"{_END}\1"),
    (r"\n[^\p{L}\p{N}\n]*\n", f"{_END}\n"),
    (rf"[^\p{{L}}\p{{N}}{_END}]+", " "),
    (rf" ?{_END}[ {_END}]*", _END * 2),
)
_TITLED = _replace(f"trim({_PLAIN})", (rf"(\A|{_END})({license_rules.title()})({_END}|\z)", r"\1license is \2\3"))
_ON = {
    name: "(" + " OR ".join("line LIKE '%" + "%".join(f" {x} " for x in rule).replace("_", r"\_") + r"%' ESCAPE '\'" for rule in rules) + ")" for name, rules in license_rules.rules().items()
}
for _less, _more in license_rules.OUTDONE:
    _ON[_less] += f" AND NOT {_ON[_more]}"
_FOUND = ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in _ON.items())
_STATED = _map({k: license_rules.declared(v) for k, v in license_rules.spdx_ids().items()})
OP2 = rf"""
WITH s AS (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents),
w AS (SELECT doc_id, low, ' ' || replace(replace({_TITLED}, ' ', '  '), '{_END}', ' {_END} ') || ' ' AS said FROM s),
k AS (SELECT doc_id, flatten(list_transform(regexp_extract_all(said, ' (?:{_WIDE}) '), lambda x: CASE
    WHEN {_map(license_rules.SENTENCES)}[replace(trim(x), '  ', ' ')] IS NOT NULL THEN [{_map(license_rules.SENTENCES)}[replace(trim(x), '  ', ' ')]]
    WHEN regexp_matches(replace(trim(x), '  ', ' '), '{license_rules.NO}') THEN []
    ELSE list_transform(regexp_extract_all(x, ' {_NAME} '), lambda y: {_map(license_rules.names())}[replace(trim(y), '  ', ' ')]) END))
  || list_filter(list_transform(flatten(list_transform(regexp_extract_all(low, '{SPDX}', 1), lambda x: regexp_extract_all(x, '{SPDX_PART}'))), lambda p: {_STATED}[p]), lambda p: p IS NOT NULL) AS ids FROM w),
l AS (SELECT doc_id, ids, ' ' || array_to_string(ids, '  ') || ' ' AS line FROM k)
SELECT doc_id, array_to_string(list_sort(list_filter([{_FOUND}], lambda x: x IS NOT NULL)), ',') AS licenses, len(ids)::BIGINT AS n_sentences, array_to_string(ids, ',') AS sentence_ids FROM l
"""

# CRC-32 of a list of bytes, by the table of its reflected polynomial.
_CRC_TABLE = "(SELECT list(c ORDER BY i) FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS t(i)))"
_CRC = "xor(list_reduce([4294967295::BIGINT] || {0}, lambda c, b: xor(c >> 8, crc_table[xor(c & 255, b) + 1])), 4294967295)"
_BYTES = "flatten(list_transform(string_split({0}, ''), lambda s: CASE WHEN unicode(s) < 128 THEN [unicode(s)::BIGINT] ELSE [192 + (unicode(s) >> 6)::BIGINT, 128 + (unicode(s) & 63)::BIGINT] END))"
OP11 = rf"""
WITH RECURSIVE crc AS (SELECT {_CRC_TABLE} AS crc_table),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
s AS (SELECT doc_id, run, count(*) AS k FROM r WHERE length(run) >= 6 GROUP BY ALL),
h AS (SELECT run, k, {_CRC.format(_BYTES.format("coalesce(doc_id::VARCHAR, '') || ':' || run"))} AS h FROM s, crc),
w AS (SELECT CASE WHEN h % 199 = 0 THEN run[1:(h % length(run))] || run[(h % length(run)) + 2:] ELSE run END AS word, sum(k)::BIGINT AS n FROM h GROUP BY word HAVING sum(k) >= 5 AND length(word) >= 6),
d AS (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS rest FROM w, unnest(range(1, length(word) + 1)) AS t(i)),
p AS (SELECT a.word AS x, b.word AS y, b.n AS m FROM d AS a JOIN d AS b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, w.word, w.n FROM d AS a JOIN w ON a.rest = w.word UNION SELECT w.word, a.word, a.n FROM d AS a JOIN w ON a.rest = w.word),
b AS (SELECT x, count(*) AS n_near, max(m) AS m, arg_min(y, (-m, y)) AS y FROM p GROUP BY x),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN y END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n FROM w LEFT JOIN b ON x = word),
g AS (SELECT word, word AS top, 0 AS step FROM f UNION ALL SELECT g.word, f.form, step + 1 FROM g JOIN f ON f.word = g.top WHERE f.form IS NOT NULL),
e AS (SELECT word, arg_max(top, step) AS root FROM g GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN e USING (word)
"""

_FIELD = "coalesce(octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{0}", "text")) + ")"
_TREE = """{0}_n AS (SELECT tree, i, 0 AS level, digest, count(*) OVER (PARTITION BY tree) AS n FROM {0}
  UNION ALL SELECT tree, i // 2, level + 1, digest, (n + 1) // 2 FROM (SELECT tree, i, level, n, sha256(digest || coalesce(lead(digest) OVER (PARTITION BY tree ORDER BY i), '')) AS digest FROM {0}_n WHERE n > 1) WHERE i % 2 = 0)"""
_WAY = """{0}_p AS (SELECT a.tree, a.i, coalesce(list({{odd: (a.i >> b.level) & 1, digest: s.digest}} ORDER BY b.level) FILTER (b.n > 1), []) AS way, max(b.digest) FILTER (b.n = 1) AS top
  FROM {0} AS a JOIN {0}_n AS b ON a.tree IS NOT DISTINCT FROM b.tree AND b.i = a.i >> b.level LEFT JOIN {0}_n AS s ON s.tree IS NOT DISTINCT FROM b.tree AND s.level = b.level AND s.i = xor(b.i, 1) AND b.n > 1 GROUP BY a.tree, a.i)"""
OP13 = rf"""
WITH RECURSIVE crc AS (SELECT {_CRC_TABLE} AS crc_table),
d AS (SELECT doc_id, lang, {_LEAF.format("n_chars")} AS leaf, {_LEAF.format("(n_chars + 1)")} AS other, {_CRC.format(_BYTES.format("doc_id::VARCHAR"))} % 7 = 0 AS bad FROM documents, crc),
l AS (SELECT lang AS tree, (row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1) AS i, leaf AS digest, doc_id, CASE WHEN bad THEN other ELSE leaf END AS now FROM d),
{_TREE.format("l")},
{_WAY.format("l")},
t AS (SELECT 0 AS tree, row_number() OVER (ORDER BY encode(tree) NULLS FIRST) - 1 AS i, digest, tree AS lang FROM l_n WHERE n = 1),
{_TREE.format("t")},
{_WAY.format("t")},
a AS (SELECT doc_id, l.digest AS leaf, t.digest AS subroot, t_p.top AS root, l_p.way || t_p.way AS way, now FROM l JOIN l_p ON l.tree IS NOT DISTINCT FROM l_p.tree AND l.i = l_p.i
  JOIN t ON t.lang IS NOT DISTINCT FROM l.tree JOIN t_p ON t.i = t_p.i),
f AS (SELECT *, list_reduce([{{odd: 0::BIGINT, digest: now}}] || way, lambda x, s: {{odd: 0::BIGINT, digest: sha256(CASE WHEN s.odd = 1 THEN s.digest || x.digest ELSE x.digest || coalesce(s.digest, '') END)}}).digest AS folded_root FROM a)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(list_filter(way, lambda s: s.digest IS NOT NULL), lambda s: s.digest), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM f
"""

ORACLES = {
    "op2_license_scan": OP2,
    "op3_substring_dedup": OP3,
    "op4_quality_rules": OP4,
    "op7_preference_pairs": OP7,
    "op11_spelling_variants": OP11,
    "op13_merkle_manifest": OP13,
}
