"""Ids of lower-cased words of a batch are those of the library, text by text, in little memory."""

import random
import tracemalloc

import public_tokenizers
import pyarrow as pa
import pytest

from wattloom.llm import support, tokens

ODD = [" ", " ", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "　", "a", "b,", "c.", "Foo", "\xe9", "É", "é", "É", "12", "3,", "!!", "'s", "it's,", "<|endoftext|>", "日本", "x" * 70, "İ", "ẞ", "Word."]


@pytest.fixture(scope="module")
def path():
    return public_tokenizers.path("word_bpe_49k.json")


def test_odd_texts(path):
    rnd = random.Random(2)
    texts = [None, "", " ", "\n", *("".join(rnd.choice(ODD) for _ in range(rnd.randrange(14))) for _ in range(3000))]
    own = tokens.DroppedSpace(path)
    want = [e.ids for e in own.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [list(memoryview(b).cast("I")) for b in own.texts(pa.array(texts))] == want
    assert own.texts(pa.array([], pa.string())) == []


def test_memory_is_bounded_and_keeps_what_was_used_last(path, monkeypatch):
    monkeypatch.setattr(tokens, "WORDS_KEPT", 50)
    own = tokens.DroppedSpace(path)
    for k in range(20):
        texts = [f"a{k} b{k}, Often {k % 3} d." for _ in range(3)] + [" ".join(f"z{k}y{j}" for j in range(30))]
        want = [e.ids for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [list(memoryview(b).cast("I")) for b in own.texts(pa.array(texts))] == want
        assert len(own) <= 50 and "often" in own.known.to_pylist()


def test_remembered_words_take_few_bytes(path):
    """60,000 words remembered: under 100 bytes a word (as Python objects they took more than 200)."""
    own = tokens.DroppedSpace(path)
    words = ["w" + "".join(chr(97 + j // 26**k % 26) for k in range(4)) + "q" for j in range(60_000)]
    texts = pa.array([" ".join(words[i::60]) for i in range(60)])
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    try:
        own.texts(texts)
        took = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    finally:
        tracemalloc.stop()
    assert len(own) >= 60_000 and took < 100 * 60_000


def test_free_memory_goes_back_when_another_operator_comes(monkeypatch):
    calls = []
    monkeypatch.setattr(support, "_IN_USE", {})
    monkeypatch.setattr(support, "give_back", lambda: calls.append("back"))
    support.take_memory("a", lambda: calls.append("clear"))
    support.take_memory("a", lambda: calls.append("clear"))
    assert calls == []
    support.take_memory("b", lambda: None)
    assert calls == ["clear", "back"]
