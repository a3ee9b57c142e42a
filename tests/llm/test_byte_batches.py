"""Byte-level ids of a batch are those of the library, text by text."""

import random
import tracemalloc

import public_tokenizers
import pyarrow as pa
import pytest

from wattloom.llm import tokens

ODD = [" ", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "　", "a", "b,", "c.", "Foo", "\xe9", "é", "12", "!!", "'s", "<|endoftext|>", "日本", "x" * 70, "\U0001f600"]


@pytest.fixture(scope="module")
def path():
    return public_tokenizers.path("byte_bpe_50k.json")


def test_odd_texts(path):
    rnd = random.Random(1)
    plain = [" ", "\n", "a", "b,", "c.", "Foo", "\xe9", "12", "word", "!!"]
    texts = [None, "", " ", "\n", "a ", " a", *("".join(rnd.choice(ODD if k % 3 else plain) for _ in range(rnd.randrange(14))) for k in range(3000))]
    own = tokens.ByteLevel(path)
    want = [e.ids for e in own.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [list(memoryview(b).cast("I")) for b in own.texts(pa.array(texts))] == want
    assert own.texts(pa.array([], pa.string())) == []


def test_new_words_are_encoded_together_and_looked_up_once(path, monkeypatch):
    """200 texts of 2000 words: one call for all new words, and no text is split by itself."""
    own, calls = tokens.ByteLevel(path), []
    monkeypatch.setattr(tokens.Words, "direct", lambda self, text, f=tokens.Words.direct: calls.append(text) or f(self, text))
    texts = [" ".join(["the", *(f"w{chr(97 + j % 26)}{chr(97 + j // 26 % 26)}{chr(97 + j // 676)}q" for j in range(i, 2000, 200))]) + "." for i in range(200)]
    want = [e.ids for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [list(memoryview(b).cast("I")) for b in own.texts(pa.array(texts))] == want
    assert len(calls) <= 2 and len(own) > 2000  # the first word and the full stop


def test_memory_is_bounded(path, monkeypatch):
    monkeypatch.setattr(tokens, "WORDS_KEPT", 50)
    own = tokens.ByteLevel(path)
    for k in range(20):
        texts = [f"a{k} b{k}, c{k % 3} d." for _ in range(3)] + [" ".join(f"z{k}y{j}" for j in range(30))]
        want = [e.ids for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [list(memoryview(b).cast("I")) for b in own.texts(pa.array(texts))] == want
        assert len(own) + len(own.older) < 300


def words_of_letters(n):
    return ["w" + "".join(chr(97 + j // 26**k % 26) for k in range(4)) + "q" for j in range(n)]


def test_remembered_words_take_few_bytes(path):
    """60,000 words remembered: under 100 bytes a word (as Python objects they took more than 200)."""
    own = tokens.ByteLevel(path)
    texts = pa.array([" ".join(["the", *words_of_letters(60_000)[i::60]]) for i in range(60)])
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    try:
        own.texts(texts)
        took = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    finally:
        tracemalloc.stop()
    assert len(own) >= 60_000 and took < 100 * 60_000
