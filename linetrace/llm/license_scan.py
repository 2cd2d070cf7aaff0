"""Licences in texts, by known sentences and ordered rules.

A text is cut into sentences, comment leaders and line feeds being spaces; what a sentence holds of
the known licence sentences and notices gives identifiers, and so does every part of an SPDX line.
The identifiers, in order, are matched against the ordered rules of each licence.  DataFrame
functions only; the licences are data (``license_rules``)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linetrace.llm import license_rules as L

#: Every known sentence holds one of these, so other texts need not be cut.
HINTS = "licen|under|subject|copyright|warrant|permission|permitted|redistribut|distribut|releas|reserved|unencumbered|spdx|waived|marked|anyone|avail|provid|publish|cover|govern|bound|issued|shared|you just do"
#: A sentence ends at a full stop, question or exclamation mark before white space (not after a single
#: letter), at a line without letters and digits, and where the value of a licence field ends.
END = L.END
STOP = r"(?<![.!?])(?<![^\p{L}\p{N}]\p{L})[.!?]++(?=[\x20\x09-\x0D]|\z)"
BLANK = r"\n[^\p{L}\p{N}\n]*+(?=\n)"
SPDX = r"spdx-license-identifier:[\x20\t]*([^\n]*)"
SPDX_PART = "[a-z0-9.+-]+"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, licenses, n_sentences and sentence_ids for each row of ``docs``: the licences whose
    rules the text meets (sorted), the number of licence sentences and their identifiers in order,
    those of SPDX lines last.

    Null and blank texts have none.  Repeated rows give repeated results; null ids stay; other
    columns are ignored; an empty table gives an empty result; texts of any length are scanned
    whole, in time that grows with their length.  Of known sentences that begin at one word the
    longest counts.  A notice is a lead ("released under", "License:", "governed by") and names joined by
    "or" or "and", or a sentence of names alone; one that is denied ("not released under", "no longer
    under") is none.  A BSD text that meets the longer rule is not reported under the shorter one."""
    low = F.lower("text")
    text = F.replace(F.translate(low, END, " "), F.lit("licence"), F.lit("license"))
    for pattern, parts in (L.FIELD, L.BARE_MIT):
        text = F.regexp_replace(text, pattern, L.written(parts, "$"))
    cut = F.regexp_replace(F.regexp_replace(text, STOP, END), BLANK, END)
    plain = F.regexp_replace(cut, rf"[^\p{{L}}\p{{N}}{END}]++", " ")
    plain = F.trim(F.regexp_replace(plain, rf" ?{END}[ {END}]*+", END))
    # Possessive repeats need no stack, however many names a notice joins.
    stop = f"(?![^ {END}])"
    plain = F.regexp_replace(plain, rf"(\A|{END})({L.title(stop, '*+')})(?={END}|\z)", "$1license is $2")
    found = F.regexp_extract_all(plain, F.lit(rf"(?<![^ {END}])(?:{L.known(stop, '*+')}){stop}"), F.lit(0))
    to_map = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    one = lambda s: F.element_at(to_map(L.SENTENCES), s)
    called = lambda s: F.transform(F.regexp_extract_all(s, F.lit(rf"(?<![^ ]){L.name()}(?![^ ])"), F.lit(0)), lambda x: F.element_at(to_map(L.names()), x))
    none = F.array().cast("array<string>")
    ids_of = lambda s: F.when(one(s).isNotNull(), F.array(one(s))).when(s.rlike(L.NO), none).otherwise(called(s))
    named = F.flatten(F.transform(found, ids_of))
    lines = F.regexp_extract_all(low, F.lit(SPDX), F.lit(1))
    parts = F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(SPDX_PART), F.lit(0))))
    stated = F.array_compact(F.transform(parts, lambda x: F.element_at(to_map({k: L.declared(v) for k, v in L.spdx_ids().items()}), x)))
    ids = F.when(low.rlike(HINTS), F.concat(named, stated))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(ids, none).alias("sentence_ids"))
    rows = rows.withColumn("line", F.concat(F.lit(" "), F.array_join("sentence_ids", "  "), F.lit(" ")))
    follow = lambda rule: F.col("line").rlike(".*".join(f" {x} " for x in rule).replace("2.0", r"2\.0"))
    on = {spdx: reduce(lambda a, b: a | b, map(follow, several)) for spdx, several in L.rules().items()}
    for less, more in L.OUTDONE:
        on[less] = on[less] & ~on[more]
    met = F.array_sort(F.array_compact(F.array(*[F.when(test, F.lit(spdx)) for spdx, test in on.items()])))
    return rows.select("doc_id", F.when(F.size("sentence_ids") > 0, met).otherwise(none).alias("licenses"), F.size("sentence_ids").cast("long").alias("n_sentences"), "sentence_ids")
