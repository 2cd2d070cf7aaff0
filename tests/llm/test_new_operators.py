"""Spelling variants, token files and the Merkle manifest against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from linetrace.llm import merkle, spelling, token_frames

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, n long, leaf string, part int, tree string, ids binary, digest string, seen string, rank long, node long, start long"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def make(spark, rows):
    """Documents (doc_id, text, lang, source, n_chars) with extra columns of names used inside."""
    return spark.createDataFrame([(*r, "w", 1, "l", 2, "t", b"x", "d", "s", 3, 4, 5) for r in rows], SCHEMA)


def plain(spark, rows):
    return make(spark, [(i, t, "en", "s", 1) for i, t in rows])


def brute_variants(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: k for w, k in count.items() if k >= 5 and len(w) >= 6}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    out, form = {}, {}
    for w in n:
        others = [x for x in n if x != w and near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
        out[w] = len(others)
    result = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        result.add((w, form[w], root, n[w], out[w], n[form[w]] if form[w] else None))
    return result


@pytest.mark.parametrize(("leaf", "walks"), [(1 << 14, 1 << 16), (6, 10)])
def test_variants_against_brute_force(spark, monkeypatch, leaf, walks):
    monkeypatch.setattr(spelling, "LEAF", leaf)
    monkeypatch.setattr(spelling, "WALKS", walks)
    rng = random.Random(leaf)
    bases = ["".join(rng.choice("aeinrstlé") for _ in range(rng.randrange(6, 10))) for _ in range(40)] + ["anagram", "nagaram", "granama", "aaaaaa", "aaaaaaa", "àbcdèfg"]
    vocabulary = collections.Counter({"chainone": 400, "chainonx": 50, "chainoyx": 7})
    for b in bases:
        vocabulary[b] += 150
        for _ in range(4):
            k, c = rng.randrange(len(b)), rng.choice("aexyÿ")
            vocabulary[rng.choice([b[:k] + c + b[k:], b[:k] + b[k + 1 :], b[:k] + c + b[k + 1 :]])] += rng.choice([5, 6, 25, 29])
    bag = [w.upper() if w.isascii() and rng.random() < 0.1 else w for w in vocabulary.elements()]
    rng.shuffle(bag)
    long_run = "abc" * 3000
    rows = [(i, " ".join(bag[i::40])) for i in range(40)] + [(None, bag[0]), (41, None), (42, ""), (43, " \n\t 12 !"), (44, f"{long_run} " * 6), (45, f"x{long_run},"), (46, "short but ok"), (7, " ".join(bag[7::40]))]
    got = {tuple(r) for r in spelling.variants(plain(spark, rows)).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    want = brute_variants(rows)
    assert got == want
    assert any(r[2] != r[0] and r[2] != r[1] for r in want), "no chain of forms"
    assert spelling.variants(plain(spark, rows).limit(0)).count() == 0


def test_one_edit():
    assert spelling.one_edit("abcd", "abxd") and spelling.one_edit("abcd", "abcde") and spelling.one_edit("abcd", "xabcd")
    assert not spelling.one_edit("abcd", "abcd") and not spelling.one_edit("abcd", "abdc") and not spelling.one_edit("abcde", "abcd")
    assert not spelling.one_edit("abcd", "badce")


def test_encoder_is_the_library_s():
    library, own = Tokenizer.from_file(PATH), token_frames.encoder(PATH)
    rng = random.Random(2)
    alphabet = ["a", "b", "Th", " ", " ", "  ", "\n", "\t", "é", "ß", "1", "²", "!", "'s", "'", "\0", "\x1c", "\x85", "\xa0", " ", "漢", "가", "́", "😀", "\xad", "<|endoftext|>", "word", ","]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(14)))
        assert np.frombuffer(own.packed(text), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_a_long_text_is_cut_without_a_trace(monkeypatch):
    monkeypatch.setattr(token_frames, "SLICE", 50)
    library, own = Tokenizer.from_file(PATH), token_frames.encoder(PATH)
    text = " ".join(f"word{k}," if k % 3 else "x\n \n  y" for k in range(400)) + "a" * 500
    assert np.frombuffer(own.packed(text), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids


def test_token_files_round_trip(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["the", "lantern", "döt", "x9", "\n"]) for _ in range(rng.randrange(90)))) for i in rng.sample(range(-50, 900), 300)]
    rows += [(None, "no id"), (None, None), (1000, None), (1001, ""), (1002, "tie"), (1002, "tie"), (1002, "other"), (1003, "long " * 60_000)]
    folder = f"file://{tmp_path}/tokens"
    token_frames.write(plain(spark, rows).repartition(5), PATH, folder)
    library = Tokenizer.from_file(PATH)
    got = token_frames.read(spark, folder).collect()
    texts = collections.Counter((i, tuple([*library.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in rows)
    assert collections.Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == texts
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [(r.doc_id is not None, r.doc_id or 0) for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)
    some = token_frames.read(spark, folder, [1002, 1003, 12345]).collect()
    assert sorted(r.doc_id for r in some) == [1002, 1002, 1002, 1003] and {(r.doc_id, r.start) for r in some} <= {(r.doc_id, r.start) for r in got}
    assert token_frames.read(spark, folder, []).count() == 0
    files = [r.file for r in token_frames.manifest(spark, folder).orderBy("part", "no").collect()]
    # Any zstandard reader sees one stream of ids.
    stream = b"".join(zstandard.ZstdDecompressor().stream_reader(open(f.removeprefix("file://"), "rb"), read_across_frames=True).read() for f in files)
    assert np.frombuffer(stream, "<u2").tolist() == [t for r in sorted(got, key=lambda r: r.start) for t in np.frombuffer(r.ids, "<u4").tolist()]
    token_frames.write(plain(spark, rows).limit(0), PATH, f"{folder}-none")
    assert token_frames.read(spark, f"{folder}-none").count() == 0


def test_damage_is_found_and_only_asked_frames_are_read(tmp_path, monkeypatch):
    monkeypatch.setattr(token_frames, "FRAME_IDS", 10)
    (tmp_path / "f").mkdir()
    file = token_frames._File(f"file://{tmp_path}/f", 2)
    ids = {k: np.arange(k * 7, k * 7 + 25, dtype="<u2") for k in range(4)}
    for k, x in ids.items():
        file.add(k, x.tobytes())
    name = file.close(0, 0).column("file")[0].as_py()
    reader = token_frames.Reader(name)
    assert len(reader.frames) == 12
    for k, x in ids.items():
        assert np.frombuffer(reader.document(k), "<u4").tolist() == x.tolist()
    path = name.removeprefix("file://")
    content = bytearray(open(path, "rb").read())
    content[int(reader.at[7]) - 1] ^= 1  # the checksum of a frame of document 2
    open(path, "wb").write(content)
    damaged = token_frames.Reader(name)
    assert np.frombuffer(damaged.document(3), "<u4").tolist() == ids[3].tolist()
    with pytest.raises((ValueError, zstandard.ZstdError)):
        damaged.document(2)


def digest(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def brute_manifest(rows, bad):
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, t, lang, s, n: digest(*[told(v) for v in (i, s, lang, n, t)])
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))

    def tree(leaves):
        """Root, and the path of each leaf, level by level: (side, digest) or None."""
        paths, level, at = [[] for _ in leaves], leaves, list(range(len(leaves)))
        while len(level) > 1:
            for k, p in enumerate(at):
                sib = p ^ 1
                paths[k].append((sib < p, level[sib]) if sib < len(level) else None)
            level = [digest(*level[j : j + 2]) for j in range(0, len(level), 2)]
            at = [p // 2 for p in at]
        return level[0], paths

    trees = {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[lang] = own, *tree([leaf(*r) for r in own])
    root, tops = tree([trees[x][1] for x in langs])
    out = []
    for lang, top in zip(langs, tops, strict=True):
        own, sub, paths = trees[lang]
        for r, path in zip(own, paths, strict=True):
            way = path + top
            i, t, lang_, s, n = r
            folded = leaf(i, t, lang_, s, n + 1 if bad(i) and n is not None else n)
            for step in way:
                folded = digest(folded) if step is None else digest(step[1], folded) if step[0] else digest(folded, step[1])
            out.append((i, leaf(*r), sub, root, digest(*[s[1] for s in way if s]), folded, folded == root))
    return out


@pytest.mark.parametrize("most", [700, 5, 1])
def test_manifest_against_brute_force(spark, most):
    rng = random.Random(most)
    rows = [(i, rng.choice([None, "", "text é", f"t{i}"]), "en", rng.choice(["a", None]), rng.choice([None, i])) for i in range(most)]
    if most > 1:
        rows += [(i, "x", lang, "b", 9) for i in range(3) for lang in (None, "", "de", "éa", "zz")]
        rows += [(None, "no id", "en", "a", 3), (4, "again", "en", "a", 1), (4, "again", "en", "a", 1), (9, "long " * 50_000, "fr", "a", 250_000)]
    bad = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 0
    docs = make(spark, rows).repartition(3)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    got = merkle.manifest(docs, {"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    want = brute_manifest(rows, bad)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(want)
    assert most == 1 or {r[-1] for r in want} == {True, False}
    assert merkle.manifest(docs).filter("not verified").count() == 0
    assert merkle.manifest(docs.limit(0)).count() == 0


def test_siblings_are_what_the_parent_covers_besides():
    leaves = [digest(str(k)) for k in range(11)]
    nodes = merkle.bucket_nodes(leaves, 0, 1, 11, merkle.height(11))
    assert list(nodes[2]) == [(0, 4), (4, 8), (8, 11)] and list(nodes[-1]) == [(0, 11)]
    (root,) = nodes[-1].values()
    for k, leaf in enumerate(leaves):
        assert merkle.fold(leaf, merkle.siblings(nodes, k, 1, 11)) == root
    assert merkle.siblings(nodes, 10, 1, 11)[:2] == [None, (True, nodes[1][8, 10])]


def test_words_and_marks_are_encoded_as_the_library_does():
    """A word is kept once, as a chunk; ids are the library's with marks, controls and special strings too."""
    made = token_frames.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["onen the haed, onen: erst.", "añadoó ciónes, a\x7fb \x01 x\tend", "a <|endoftext|> b<|endoftext|>.", " of  the\nThe", "ab, ab ab,", "日本, 日", "don't 12. !?", "word\xa0, x"]
    for text in texts:
        assert np.frombuffer(made.packed(text), "<u2").tolist() == made.library.encode(text, add_special_tokens=False).ids
    assert " ab" in made.chunk and " ab" not in made.piece


def test_lines_are_cut_and_have_the_ids_of_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    made, library = token_frames.Encoder(path), Tokenizer.from_file(path)
    assert made.packed("ab cd.\nEf gh,***") == made._packed(library.encode("ab cd.\nEf gh,***", add_special_tokens=False).ids)
    # Words beside a line break are kept as words, not as a pair that hardly comes again.
    assert {"ab", " cd.", "\n", "Ef", " gh,***"} == set(made.chunk) and not made.mixed
    rng = random.Random(12)
    bits = ["\n", "\n", "\n\n", " ", " ", "  ", "\t", "\r\n", "\x1c", "\x85", "\u00a0", "\u2028", "\0", "ab", "Cd", "été", "x1", "77", ",", ".", "***", "'", "'s", "n't", "<|endoftext|>", "<|", "ß", "東", "🙂", "\u0301"]
    for n in range(6000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 9)))
        text = f"a {text} b" if n % 3 == 0 else f"a\n{text}\nb" if n % 3 == 1 else text
        assert made.packed(text) == made._packed(library.encode(text, add_special_tokens=False).ids), repr(text)
