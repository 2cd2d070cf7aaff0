"""Text functions as native Column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters that normalisation treats as spaces; vowels before which a final a stays.
SEPARATORS = r"""[.,;|:!?\-"'(){}\[\]0-9]+"""
LONG_TOKEN, COVERED = 3, 55.0
# Consonants that sound alike, and the one that stands for each; long vowels; interjections.
ALIKE = ("bfgdj", "ppktc")
LONG_VOWELS = (("ā", "aa"), ("Ā", "Aa"), ("ī", "ee"), ("Ī", "Ee"), ("ū", "oo"), ("Ū", "Oo"))
MARKED, PLAIN = "āīūṭḍṇṛṅñśṣḥṃéèêëàâäáîïíìôöóòûüúùçñ", "aiutdnrnnsshmeeeeaaaaiiiioooouuuucn"
#: Interjections, in the order in which they are tried.
SEEDS = ("ਵਾਹਿਗੁਰੂ ਵਾਹਿਗੁਰੂ", "ਸਤਿ ਨਾਮੁ ਵਾਹਿਗੁਰੂ", "ਬੋਲੇ ਸੋ ਨਿਹਾਲ", "ਸਤਿ ਸ੍ਰੀ ਅਕਾਲ", "ਧੰਨ ਗੁਰੂ ਨਾਨਕ ਦੇਵ ਜੀ", "ਧੰਨ ਗੁਰੂ ਗ੍ਰੰਥ ਸਾਹਿਬ ਜੀ", "ਵਾਹਿਗੁਰੂ", "ਅਕਾਲ", "ਓਅੰਕਾਰ")


def normalize(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), SEPARATORS, " "), r"\s+", " "))


def tokens(normal: Column) -> Column:
    return F.filter(F.split(normal, " "), lambda x: x != "")


def long_tokens(normal: Column) -> Column:
    return F.filter(F.split(normal, " "), lambda x: F.length(x) >= LONG_TOKEN)


def first_letters(toks: Column) -> Column:
    return F.array_join(F.transform(toks, lambda x: F.substring(x, 1, 1)), "")


def phonetic_key(letters: Column) -> Column:
    return F.translate(letters, *ALIKE)


def length_softening(ratio: Column, a: Column, b: Column) -> Column:
    """A ratio times the root of the shorter length over the longer."""
    low, high = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return F.when(high > 0, ratio * F.sqrt(low / high)).otherwise(F.lit(0.0))


def detect_script(text: Column) -> Column:
    """The block with more code points, the first on a tie, 'other' without any."""
    first = F.length(F.regexp_replace(text, "[^਀-੿]", ""))
    second = F.length(F.regexp_replace(text, "[^ऀ-ॿ]", ""))
    return F.when((first == 0) & (second == 0), "other").when(first >= second, "gurmukhi").otherwise("devanagari")


def double_long_vowels(text: Column) -> Column:
    for mark, double in LONG_VOWELS:
        text = F.replace(text, F.lit(mark), F.lit(double))
    return text


def strip_marks(text: Column) -> Column:
    """Text without the marks on its letters: decomposed, nonspacing marks dropped.  Texts of ASCII
    and of a closed alphabet of marked letters stay native; only others go through Python, in Arrow
    batches."""

    @F.pandas_udf("string")
    def open_text(values: pd.Series) -> pd.Series:
        plain = lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")
        return values.map(plain, na_action="ignore")

    closed = F.translate(text, MARKED, PLAIN)
    return F.when(closed.rlike(r"^\p{ASCII}*$"), closed).otherwise(open_text(F.when(~closed.rlike(r"^\p{ASCII}*$"), text)))


def strip_final_schwa(text: Column) -> Column:
    """Drops the last a of tokens of more than three characters that do not end in aa, ia or ya."""
    return F.regexp_replace(text, r"(?<=\S{3})(?<![aiy])a(?=\s|$)", "")


# The two scripts' blocks have their letters in the same places.  Sounds by place: stops
# and nasals from 0x15, then the other consonants; vowels, vowel signs and marks.
GURMUKHI, DEVANAGARI = 0x0A00, 0x0900
CONSONANTS = {
    **dict(enumerate("k kh g gh ṅ c ch j jh ñ ṭ ṭh ḍ ḍh ṇ t th d dh n".split(), 0x15)), **dict(enumerate("p ph b bh m y r".split(), 0x2A)),
    0x32: "l", 0x33: "ḷ", 0x35: "v", 0x36: "ś", 0x37: "ṣ", 0x38: "s", 0x39: "h", 0x5C: "ṛ",
}
VOWELS = {**dict(enumerate("a ā i ī u ū".split(), 0x05)), 0x0F: "e", 0x10: "ai", 0x13: "o", 0x14: "au"}
SIGNS = {**dict(enumerate("ā i ī u ū".split(), 0x3E)), 0x47: "e", 0x48: "ai", 0x4B: "o", 0x4C: "au", 0x4D: ""}
MARKS = {0x01: "ṃ", 0x02: "ṃ", 0x03: "ḥ", 0x70: "ṃ", **{0x66 + k: str(k) for k in range(10)}}
#: Places that the recoding of the second script into the first keeps, and two that it changes.
KEPT = (*range(0x02, 0x04), *range(0x05, 0x0B), 0x0F, 0x10, *range(0x13, 0x29), *range(0x2A, 0x31), 0x32, 0x35, 0x36, 0x38, 0x39, 0x3C, *range(0x3E, 0x43), 0x47, 0x48, *range(0x4B, 0x4E), 0x5C, *range(0x66, 0x70))
CHANGED = {0x01: 0x02, 0x37: 0x36}
#: Full stops, which the scripts share, stand in the second one's block.
STOPS = "\u0964\u0965"


def _block(base: int) -> str:
    return f"[{chr(base)}-{chr(base + 0x63)}{chr(base + 0x66)}-{chr(base + 0x7F)}]"


def map_script(text: Column, base: int) -> Column:
    """A script to Latin by the tables: a consonant is followed by a, which a vowel sign replaces and a
    virama drops; what the tables lack within the block is dropped, the rest passes."""
    out = {**{k: f"{v}a" for k, v in CONSONANTS.items()}, **VOWELS, **MARKS, **{k: f"\u0001{v}" for k, v in SIGNS.items()}}
    table = F.create_map(*[F.lit(x) for place, sound in out.items() for x in (chr(base + place), sound)])
    each = F.transform(F.split(text, ""), lambda c: F.coalesce(F.element_at(table, c), F.when(c.rlike(_block(base)), "").otherwise(c)))
    return F.replace(F.replace(F.array_join(each, ""), F.lit("a\u0001"), F.lit("")), F.lit("\u0001"), F.lit(""))


def to_latin(text: Column) -> Column:
    """Text of either script, or Latin text, as plain Latin: long vowels doubled, marks and final a's
    dropped."""
    script = detect_script(text)
    mapped = F.when(script == "gurmukhi", map_script(text, GURMUKHI)).when(script == "devanagari", map_script(text, DEVANAGARI)).otherwise(text)
    return strip_final_schwa(strip_marks(double_long_vowels(mapped)))


def recode_script(text: Column) -> Column:
    """The second script's text in the first script, code point by code point; what has no counterpart
    is dropped, the rest passes."""
    moved = {**{k: k for k in KEPT}, **CHANGED}
    source, target = ("".join(chr(base + k) for k in places) for base, places in ((DEVANAGARI, moved), (GURMUKHI, moved.values())))
    return F.regexp_replace(F.translate(text, source, target), _block(DEVANAGARI), "")


def recode_columns(rows: DataFrame, columns: list[str], font: list[tuple[str, str]] | Callable[[Column], Column]) -> DataFrame:
    """``rows`` with ``<column>_unicode`` for each of the columns, recoded from a legacy font: by passes or
    by a compiled one."""
    recode = font if callable(font) else lambda c: recode_font(c, font)
    return rows.withColumns({f"{c}_unicode": recode(F.col(c)) for c in columns})


def recode_font(text: Column, passes: list[tuple[str, str]]) -> Column:
    """Successive replacements (pattern, replacement), such as a legacy font's table."""
    for pattern, replacement in passes:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def legacy_font(mapping: Mapping[str, str], dropped: str = "", pairs: Sequence[str] = (), prefix: str = "", halves: str = "") -> Callable[[Column], Column]:
    """A recoding of texts in a font's own bytes, compiled from its table.

    Characters of ``dropped`` go.  ``pairs`` are marks in their right order; where one stands reversed it
    is turned.  Then one pass from left to right takes the longest entry at each place, so what an entry
    gives is never read again; characters without an entry stay.  ``prefix`` is a vowel that is written
    before its consonant and belongs after it, and after one of ``halves`` that follows the consonant,
    unless the table has an entry for both together."""
    quoted = lambda keys: "|".join(re.escape(k) for k in sorted(keys, key=lambda k: (-len(k), k)))
    single = {k: v for k, v in mapping.items() if len(k) == 1}
    longer = {k: v for k, v in mapping.items() if len(k) > 1}
    moved = f"{re.escape(prefix)}.(?:{quoted(halves)})?" if prefix and halves else f"{re.escape(prefix)}." if prefix else ""
    marked = "|".join(x for x in (quoted(longer), moved) if x)
    # Stretches of characters that stand for themselves alone are taken at once; "++" never goes back, so
    # they may be of any length.
    wide = "".join(re.escape(k) for k, v in sorted(single.items()) if len(v) != 1)
    alone = f"[^{wide}]" if wide else "."
    run = f"(?:(?!{marked}){alone})++" if marked else f"{alone}++"
    token = f"(?s)(?:{marked + '|' if marked else ''}{run}|.)"
    plain = {k: v for k, v in single.items() if len(v) == 1}
    table = F.create_map(*[F.lit(x) for k, v in mapping.items() if len(k) > 1 or len(v) != 1 for x in (k, v)]) if len(plain) < len(mapping) else None
    chars = lambda c: F.translate(c, "".join(plain), "".join(plain.values())) if plain else c
    one = lambda c: F.coalesce(F.try_element_at(table, c), chars(c)) if table is not None else chars(c)

    def given(x: Column) -> Column:
        if prefix:
            shifted = F.concat(one(F.substring(x, 2, 1)), one(F.substring(x, 3, 1)), one(F.lit(prefix)))
            other = F.when((F.length(x) > 1) & x.startswith(prefix), shifted).otherwise(chars(x))
        else:
            other = chars(x)
        return F.coalesce(F.try_element_at(table, x), other) if table is not None else other

    def recode(text: Column) -> Column:
        text = F.translate(text, dropped, "") if dropped else text
        for pair in pairs:
            text = F.replace(text, F.lit(pair[::-1]), F.lit(pair))
        return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(token), F.lit(0)), given), "")

    return recode


def vowel_only(token: Column) -> Column:
    """Has a letter and no ASCII consonant; y is a consonant."""
    return token.rlike(r"\p{L}") & ~F.lower(token).rlike("[b-df-hj-np-tv-z]")


#: What a recogniser says while it hears nothing.
PLACEHOLDERS = ("Waiting for speech", "<|")


def is_bad_transcript(text: Column, letters: str = "[\u0900-\u097f]", placeholders: tuple[str, ...] = PLACEHOLDERS) -> Column:
    """Broken characters, a placeholder, no letter of the expected script, or a repetition loop; null
    and blank texts are none of these."""
    bare = F.trim(text)
    begins = [F.startswith(bare, F.lit(p)) for p in placeholders]
    bad = F.contains(bare, F.lit("\ufffd")) | reduce(lambda a, b: a | b, begins) | ((bare != "") & ~bare.rlike(letters)) | is_repetition_loop(bare)
    return F.coalesce(bad, F.lit(False))


def drop_bad_transcripts(rows: DataFrame, column: str = "text", letters: str = "[\u0900-\u097f]") -> DataFrame:
    return rows.filter(~is_bad_transcript(F.col(column), letters))


def sanitize_transcript(text: Column) -> Column:
    bare = F.regexp_replace(F.trim(text), r"^```[a-z]*\s*|\s*```$", "")
    return F.trim(F.regexp_replace(F.trim(bare), r"^(?i:transcript|transcription|text):\s*", ""))


def extract_transcript(payload: Column) -> Column:
    """The first of several places in a JSON reply; a present but empty one ends the search."""
    paths = ("$.transcript", "$.text", "$.data.transcript", "$.data.text", "$.results[0].alternatives[0].transcript")
    found = F.trim(F.coalesce(*[F.get_json_object(payload, p) for p in paths]))
    return F.when(found != "", found)


def is_repetition_loop(text: Column) -> Column:
    bare = F.regexp_replace(text, r"\s+", "")
    repeats = bare.rlike(r"(.)\1{9}") | bare.rlike(r"^(..)*?(..)\2{4}")
    return (F.length(bare) > 500) | ((F.length(bare) >= 12) & repeats)


def detect_interjection(text: Column, seeds: tuple[str, ...] = SEEDS) -> Column:
    """The first seed that the text means; null if it is too long or means none."""
    low, n = normalize(text), F.length(normalize(text))
    tests = [F.when(F.when(n < 8, (n >= 3) & F.startswith(F.lit(s), low)).otherwise(F.contains(low, F.lit(s))), F.lit(s)) for s in seeds]
    return F.when(n <= 24, F.coalesce(*tests))


def overlap_append(parts: Column, tail: int = 20) -> Column:
    """Texts of an array joined by spaces; a part's head is dropped where it repeats the last
    ``tail`` characters so far."""

    def step(out: Column, part: Column) -> Column:
        end = F.when(F.length(out) > tail, F.substring(out, -tail, tail)).otherwise(out)
        rest = F.when(F.startswith(part, end), F.substring(part, F.length(end) + 1, F.length(part))).otherwise(F.concat(F.lit(" "), part))
        return F.when(out == "", part).when(part == "", out).otherwise(F.concat(out, rest))

    return F.aggregate(parts, F.lit(""), step)


def split_of(sample_id: Column) -> Column:
    """A stable split by the first four bytes of a hash: 80, 10, 10."""
    bucket = F.conv(F.substring(F.sha2(sample_id, 256), 1, 8), 16, 10).cast("long") % 100
    return F.when(bucket < 80, "train").when(bucket < 90, "val").otherwise("test")


def pseudonymize(token: Column, secret: str) -> Column:
    """HMAC-SHA256 in hex, from two plain hashes over padded keys."""
    if len(secret) < 16:
        raise ValueError("the secret needs 16 characters")
    import hashlib

    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(token, "UTF-8")), 256))), 256)


def group_of(filename: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(filename, r"\.[^.]*$", ""), r"\s+\d+$", "")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def mmss(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d", F.floor(whole / 60).cast("long"), whole % 60)


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def confidence_label(score: Column, runner_up: Column) -> Column:
    """Five labels by score, one step down if a high score leads by no more than two points."""
    names = ("certain", "likely", "probable", "possible", "uncertain")
    rank = F.when(score >= 95, 0).when(score >= 85, 1).when(score >= 70, 2).when(score >= 50, 3).otherwise(4)
    down = ((score >= 85) & (score - runner_up <= 2)).cast("int")
    return F.element_at(F.array(*map(F.lit, names)), rank + F.coalesce(down, F.lit(0)) + 1)


def coarse_label(score: Column) -> Column:
    return F.when(score >= 75, "high").when(score >= 50, "medium").otherwise("low")
