"""Texts that are encoded together."""

import random

import pyarrow as pa
import pytest

from tidepool.llm import tokenizing

POOL = ["mot", "Été", "don't", "(716)", "+1", ",", ".", "...", "…", "мир", "a_b", "中文", "é", "H̱", "İx", "ß", " ", "\n", "  ", "<|endoftext|>", "<|ENDOFTEXT|>", "A'LL", "w" * 250, "é" * 230, "a×b", "naïve!?", "--", "\t", "\xa0", "\0"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize(("group", "words"), [(1 << 20, 160_000), (300, 50), (1, 5)])
def test_texts_together_have_the_librarys_ids(monkeypatch, name, group, words):
    monkeypatch.setattr(tokenizing, "_GROUP", group)
    monkeypatch.setattr(tokenizing, "_WORDS", words)
    r = random.Random(7)
    texts = ["".join(r.choice(POOL) + r.choice(["", " ", " ", "\n"]) for _ in range(r.randint(0, 12))) for _ in range(600)]
    texts += [" ".join(t.split()) for t in texts]
    enc = tokenizing.ChunkEncoder(tokenizing.vocabulary(name))
    got = list(enc.encode_each(pa.array(["before", *texts])[1:]))
    assert got == [enc._one(t) if t else b"" for t in texts]
    assert list(enc.encode_each(pa.array(texts[:9], pa.large_string()))) == got[:9] and not list(enc.encode_each(pa.array([], pa.string())))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_a_word_of_many_texts_is_learned_once_whatever_marks_follow(monkeypatch, name):
    enc, learned = tokenizing.ChunkEncoder(tokenizing.vocabulary(name)), []
    real = enc._add
    monkeypatch.setattr(enc, "_add", lambda chunks: (learned.extend(chunks), real(chunks)))
    texts = [f"x word{a} word{b}" for a in ("", ",", ".", "!?") for b in ("", ")", ";")]
    assert list(enc.encode_each(pa.array(texts))) == [enc._one(t) for t in texts]
    assert sum("word" in c for c in learned) == 1
