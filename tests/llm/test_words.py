"""op5's memory of words: arrays by hash, bounded, exact when hashes are equal."""

from __future__ import annotations

import numpy as np
import public_tokenizers

from quillon.llm import tokenout


def test_equal_hashes_and_forgetting(monkeypatch):
    """With hashes of two bits and room for 50 words the ids are still the library's, and what is held stays bounded."""
    plain = tokenout.word_spans

    def coarse(*args, **kwargs):
        h, start, end = plain(*args, **kwargs)
        return h & np.uint64(3), start, end

    coder = tokenout.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefgh,.7é"), size=rng.integers(1, 9))) for _ in range(400)]
    batches = [[" ".join(rng.choice(words, size=40)) for _ in range(5)] + ["", " \n"] for _ in range(12)]
    for hashed in (plain, coarse):
        monkeypatch.setattr(tokenout, "word_spans", hashed)
        coder.words = tokenout.Memory(50)
        for batch in batches:
            assert coder(batch) == [coder.whole(x) for x in batch]
        assert sum(len(x.hashes) for x in coder.words.old) < 300 and len(coder.words.new) < 10


def test_known_words_are_not_encoded_again():
    coder = tokenout.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    asked = []
    learn = coder.learn
    coder.learn = lambda words: asked.extend(words) or learn(words)
    for text in ("one two three", "two Three four", "one, two four five"):
        coder([text])
    assert asked == [b"one", b"two", b"three", b"four", b"one,", b"five"]
    assert all(isinstance(x, tokenout.Words) for x in coder.words.new)
