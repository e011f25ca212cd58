"""The word-by-word encoder against the library, on letters that composing and lower-casing treat in turn."""

import random
import string
import tracemalloc

import pytest

from threadstats.llm import queries, tokens
from threadstats.llm.tokens import Encoder


@pytest.fixture(scope="module")
def pair():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.WORD_BPE), Encoder(queries.WORD_BPE)


def _same(pair, texts):
    library, ours = pair
    wanted = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    data = [t.encode() for t in texts]
    assert [x.tolist() for x in ours.encode(data)] == wanted
    assert ours.counts(data).tolist() == [len(x) for x in wanted]


def test_capitals_before_combining_marks(pair):
    _same(pair, [f"the word {c}{chr(mark)} and X{c}{chr(mark)}y here" for c in string.ascii_uppercase for mark in range(0x300, 0x370)])


def test_random_strings(pair):
    rng = random.Random(2)
    alphabet = string.printable + "éÉßẞÅÅİıſΣς日本̱́̈̌ -ǅﬁ<|endoftext|>" + "\U0001f600"
    marks = [chr(m) for m in range(0x300, 0x370)]
    _same(pair, ["".join(rng.choice(marks) if rng.random() < 0.15 else rng.choice(alphabet) for _ in range(rng.randrange(30)))
                 for _ in range(20_000)])


def test_punctuation_after_a_word_makes_no_other_word():
    ours = Encoder(queries.WORD_BPE)
    ours.counts([b"Word, word. word; (word) word's", b"", b" word\tWORD? "])
    assert set(ours.place) == {b"word", b",", b".", b";", b"(word", b")", b"?", b"'s"}


def test_cuts_between_letters_and_others(pair):
    rng = random.Random(5)
    parts = ["'s", "'re", "s'", "'", "re", "Don", ".", "...", "?!", ",\u0301", "=\u0338", "7", "é", "É.", "Σ", "Σ,", "x", "-", "_", "\x00", "\x1f", "<|"]
    _same(pair, ["".join(rng.choice(parts) if rng.random() < 0.85 else " " for _ in range(rng.randrange(12))) for _ in range(20_000)])


def test_words_take_few_bytes():
    ours = Encoder(queries.WORD_BPE)
    rng = random.Random(8)
    words = [f"w{rng.getrandbits(40):x}".encode() for _ in range(60_000)]
    ours.counts(words[:100])
    tracemalloc.start()
    for low in range(0, len(words), 10_000):
        ours.counts(words[low:low + 10_000])
    taken = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert taken < 120 * len(words)


def test_words_of_one_hash_are_apart(pair, monkeypatch):
    monkeypatch.setattr(tokens, "hash", lambda word: len(word) % 3, raising=False)
    library, _ = pair
    ours = Encoder(queries.WORD_BPE)
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcd") * rng.randrange(1, 4) + rng.choice(["", "1", "."]) for _ in range(9)) for _ in range(300)]
    for low in range(0, 300, 50):
        _same((library, ours), texts[low:low + 100])


def test_words_are_forgotten_beyond_the_memo(pair, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 5_000)
    library, _ = pair
    ours = Encoder(queries.WORD_BPE)
    for low in range(0, 3_000, 200):
        _same((library, ours), [f"the w{i:x} word, and v{i * 977:x}" for i in range(low, low + 200)])
        assert len(ours.place) < 1_500
