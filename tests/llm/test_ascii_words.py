"""What words cost an encoder."""

import pytest

from tidepool.llm import tokenizing


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ascii_words_need_no_pattern(monkeypatch, name):
    real = tokenizing._LATIN

    class Pattern:
        def fullmatch(self, w, at=0):
            assert not w.isascii()
            return real.fullmatch(w, at)

    monkeypatch.setattr(tokenizing, "_LATIN", Pattern())
    enc, text = tokenizing.ChunkEncoder(tokenizing.vocabulary(name)), "Plain words, café and мир plain Words again; a1 x"
    assert enc.encode(text).tolist() == enc.plain.encode(text, add_special_tokens=False).ids
