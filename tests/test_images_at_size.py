"""Image kernels whose cost must grow with the pixels alone."""

from __future__ import annotations

import numpy as np
import pytest

from quillon.operators import kernels


def test_earlier_images_are_moved_by_one_kernel(spark):
    """An expression for each pixel looked the whole image up again."""
    from quillon.plans.queries import _earlier

    rng = np.random.default_rng(3)
    images = {k: rng.random((9, 7)).astype(np.float32) for k in range(5)}
    df = spark.createDataFrame([(k, 9, 7, im.ravel().tolist()) for k, im in images.items()] + [(9, 9, 7, None)], "case_id long, h int, w int, pixels array<float>")
    got = _earlier(df)
    assert "MapInArrow" in got._jdf.queryExecution().toString() and got.columns == ["case_id", "pixels", "h", "w"]
    got = {r.case_id: np.array(r.pixels, np.float32).reshape(r.h, r.w) for r in got.collect()}
    assert got.keys() == images.keys()
    for k, im in images.items():
        assert (got[k] == np.array([[im[(y + 4) % 9, (x + 3) % 7] for x in range(7)] for y in range(9)])).all()


@pytest.mark.parametrize("shape", [(64, 64), (7, 5), (1, 40)])
def test_blurs_are_sums_of_mirrored_neighbours(shape):
    image = np.random.default_rng(1).random(shape)
    want = image
    for axis in (1, 0):
        radius, size = 18, want.shape[axis]
        weight = np.exp(-np.arange(-radius, radius + 1.0) ** 2 / 72)
        wide = np.pad(want, [(radius, radius) if k == axis else (0, 0) for k in range(2)], mode="reflect" if size > radius else "symmetric")
        want = sum(w * np.take(wide, range(k, k + size), axis=axis) for k, w in enumerate(weight / weight.sum()))
    assert kernels.blur(image, 6.0) == pytest.approx(want, abs=1e-12)


def test_winding_components_and_silenced_peaks():
    """A spiral is one component, found by its runs; a peak silences what lies less than twice its reach away."""
    mask = np.zeros((21, 21), dtype=bool)
    mask[1::4, 1:20], mask[3::4, 1:20] = True, True
    mask[2::8, 19] = mask[4::8, 1] = mask[6::8, 19] = mask[8::8, 1] = True
    ring, grown = np.zeros_like(mask), None
    ring[1, 1] = True
    while grown is None or (ring != grown).any():
        grown = ring.copy()
        ring[1:] |= grown[:-1]
        ring[:-1] |= grown[1:]
        ring[:, 1:] |= grown[:, :-1]
        ring[:, :-1] |= grown[:, 1:]
        ring &= mask
    assert (kernels.component(mask, (1, 1)) == grown).all() and not kernels.component(mask, (0, 0)).any()
    image = np.zeros((128, 128))
    image[30, 30] = image[30, 110] = image[100, 30] = 30.0
    centers = [(x0 + x1) // 2 for x0, _, x1, _, _ in kernels.propose(image)]
    assert len(centers) == 3 and kernels.propose(np.zeros((5, 5))) == []


@pytest.mark.parametrize("block", [4096, 16])
def test_near_hashes_in_narrow_bands_are_compared_by_blocks(spark, monkeypatch, block):
    """Up to 15 of 64 bits: bands of four bits would make a row of nearly every pair before it is compared."""
    from quillon.operators import splits

    monkeypatch.setattr(splits, "BLOCK", block)
    rng = np.random.default_rng(8)
    base = rng.integers(-(2**63), 2**63 - 1, 12)
    codes = [int(b) ^ sum(1 << int(k) for k in rng.choice(63, n, replace=False)) for b in base for n in (0, 5, 8, 15)] + [int(base[0]), -1, 0, None]
    df = spark.createDataFrame([(c,) for c in codes], "ahash bigint")
    out = splits.near_hashes(df, 15)
    assert "MapInArrow" in out._jdf.queryExecution().toString()
    own = sorted({c for c in codes if c is not None})
    want = {(a, b, d) for a in own for b in own if a <= b and (d := ((a ^ b) & (2**64 - 1)).bit_count()) <= 15}
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want
    assert splits.near_hashes(df.where("false"), 15).count() == 0
