"""The stages of the pipeline one after the other, against brute force, on awkward documents."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linetrace.llm import decontaminate, simhash

WORD = re.compile(r"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 long, row string, stratum int, matches string, kept string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    item = "the lantern stood upon the old stone wall while seven grey gulls cried over the harbour"
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(64))
    base = text(120)
    near = " ".join("changed" if i == 60 else w for i, w in enumerate(base.split()))
    far = " ".join(w if i % 3 else "x" + w for i, w in enumerate(base.split()))
    long_ = text(60_000)
    texts = [
        (1, base), (2, near), (3, base), (3, base), (4, far), (5, None), (6, ""), (7, " \n\t"), (8, "too short"), (9, ("one two three " * 40).strip()), (None, text(80)), (None, base),
        (10, f"{text(60)} {item.upper()}! {text(10)}"), (11, f"{text(60)} {item.replace('stone', 'stome')} {text(3)}"), (12, f"{text(70)} {key} end"), (13, long_), (14, f"{long_} tail"), (15, text(60)), (15, text(60)), (0, far),
    ]
    path = tmp_path_factory.mktemp("tables")
    rows = [(i, t, ["en", None, "fr"][n % 3], ["a", "b", None][n % 3], None if t is None else len(t), 1, "r", 2, "m", "k") for n, (i, t) in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality long, toxic long").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), texts, item, key


def test_stages_against_brute_force(spark, folder):
    path, texts, item, key = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns

    def repeats(w):
        seen = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        count = {}
        for t in seen:
            count[t] = count.get(t, 0) + 1
        return len({z for k, t in enumerate(seen) if count[t] > 1 for z in (k, k + 1, k + 2)})

    words = [WORD.findall(t or "") for _, t in texts]
    good = [n for n, w in enumerate(words) if len(w) >= 50 and 2 * repeats(w) <= len(w)]
    sets = {n: set(simhash.shingle_hashes(texts[n][1], 5).tolist()) for n in good}
    root = {n: n for n in good}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in good:
        for b in good:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    order = lambda n: (texts[n][0] is None, texts[n][0] or 0)
    groups = {}
    for n in good:
        groups.setdefault(find(n), []).append(n)
    single = [min(g, key=order) for g in groups.values()]
    clean = [n for n in single if decontaminate.normal(item) not in decontaminate.normal(texts[n][1]) and "stome" not in texts[n][1]]
    ids = lambda some: sorted(str(texts[n][0]) for n in some)
    want = {"quality": good, "near_duplicates": single, "benchmark": clean, "secrets": clean}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path).cache()
        assert docs.columns == columns
        assert sorted(str(r.doc_id) for r in docs.select("doc_id").collect()) == ids(want[name]), name
    found = {r.doc_id: (r.text, r.n_chars) for r in docs.filter("doc_id = 12").collect()}
    assert key not in found[12][0] and found[12][0].endswith("[secret] end") and found[12][1] == len(found[12][0])
    used = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    assert {str(r.doc_id) for r in used} <= set(ids(clean)) and {r.source for r in used} == {"a", "b", ""}
    assert sum(r.n_tokens for r in used) >= 0.5 * sum(len(words[n]) for n in clean)


def test_stages_on_empty_tables(spark, folder):
    path, *_ = folder
    none = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, path)
        assert out.count() == 0 and (name == "mixture" or out.columns == none.columns), name
    assert none.select(F.lit(1)).count() == 0
