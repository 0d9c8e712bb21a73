"""What one part of the texts takes in a worker of the MinHash and suffix stages."""

from __future__ import annotations

import tracemalloc

import numpy as np

from quillon.llm import minhash, suffix


def test_a_part_takes_little_memory():
    raw = np.random.default_rng(0).choice(np.frombuffer(b"abcdefgh ", np.uint8), size=minhash.PART)
    at = np.arange(0, minhash.PART + 1, 2048)
    tracemalloc.start()
    s, to = minhash.shingles(raw, at, 5)
    minhash.bands(minhash.signatures(s, to), minhash.ROWS)
    suffix.anchors(raw, at, 100)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 100, peak
