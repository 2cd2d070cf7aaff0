"""Token counts where marks reorder and merge: every prefix against the library, and time on long rows."""

import random
import time
import unicodedata

import public_tokenizers
import pytest
import tokenizers

from linetrace.llm import token_counts

MARKS = [*map(chr, range(0x300, 0x370)), *"़゙्ְִًّཱཱིི⃐\U0001d165"]
OTHERS = ["a", "A", "e", "<", "=", "'s", "!", "1", " ", "ü", "日", "é", "İ", "the", "'", "ᅡ", "ᆨ", "া", "ා", "ᄀ", "가"]


@pytest.fixture(scope="module")
def both():
    path = public_tokenizers.path("word_bpe_49k.json")
    return token_counts.Vocabulary(path), tokenizers.Tokenizer.from_file(path)


def counted(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def test_every_prefix_with_many_marks(both):
    vocab, library = both
    rng = random.Random(11)
    for _ in range(150):
        text = "".join(rng.choice(OTHERS) if rng.random() < 0.1 else rng.choice(MARKS) for _ in range(rng.randrange(1, 90)))
        count = 0
        for end, change in enumerate(vocab.deltas(text), 1):
            count += change - 128
            assert count == counted(library, text[:end]), ascii(text[:end])


def test_long_rows_of_marks(both):
    vocab, library = both
    rng = random.Random(12)
    mixed = rng.choices(MARKS, k=20_000)
    rows = ["a" + "".join(mixed), "x" + "".join(sorted(mixed, key=unicodedata.combining, reverse=True)), "q" + "̣́" * 10_000, "가" + "ᅡ" * 20_000, "".join(mixed)]
    began = time.time()
    got = [sum(d) - 128 * len(d) for d in map(vocab.deltas, rows)]
    assert time.time() - began < 60
    assert got == [counted(library, row) for row in rows]
