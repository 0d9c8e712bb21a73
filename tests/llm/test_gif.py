"""GIF media: round trips, a plain decoder's results, frame rules, broken files and the contract query."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pytest

from quillon.llm import gif
from quillon.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string"


def plain_lzw(raw, size):
    """A decoder that reads bit by bit."""
    bits = "".join(f"{x:08b}"[::-1] for x in raw)
    at, out, table, width, before = 0, b"", None, size + 1, None
    while at + width <= len(bits):
        code, at = int(bits[at : at + width][::-1], 2), at + width
        if code == 1 << size:
            table, width, before = [bytes([k]) for k in range(1 << size)] + [None, None], size + 1, None
            continue
        if code == (1 << size) + 1:
            break
        if before is not None and len(table) < 4096:
            table.append(before + (table[code] if code < len(table) else before)[:1])
        out += table[code]
        before = table[code]
        if len(table) == 1 << width and width < 12:
            width += 1
    return out


@pytest.mark.parametrize("size", [2, 4, 8])
def test_code_streams(size):
    rng = np.random.default_rng(size)
    for n in (1, 2, 3, 5, 64, 700, 20_000):
        for data in (bytes(n), rng.integers(0, 1 << size, n, dtype=np.uint8).tobytes(), (b"\0\1\2\1" * n)[:n]):
            stream = gif.lzw_encode(data, size)
            assert gif.lzw_decode(stream, size) == data == plain_lzw(stream, size)
    assert gif.lzw_decode(gif.lzw_encode(b"", size), size) == b""


def test_a_full_table_without_a_clear_code():
    """Writers may go on with 12 bits once the table is full."""
    rng = np.random.default_rng(5)
    data = rng.integers(0, 256, 30_000, dtype=np.uint8).tolist()
    codes, table, now = [], {}, data[0]
    for x in data[1:]:
        if (now, x) in table:
            now = table[now, x]
            continue
        codes.append(now)
        if len(table) < 4096 - 258:
            table[now, x] = 258 + len(table)
        now = x
    bits = f"{256:09b}"[::-1]
    for k, code in enumerate([*codes, now, 257]):
        width = min(12, max(9, int(min(258 + max(k - 1, 0), 4095)).bit_length()))
        bits += f"{code:0{width}b}"[::-1]
    raw = bytes(int(bits[k : k + 8][::-1], 2) for k in range(0, len(bits), 8))
    assert gif.lzw_decode(raw, 8) == bytes(data) == plain_lzw(raw, 8)


@pytest.mark.parametrize("raw", [gif.lzw_encode(b"ab", 8)[:0] + bytes([255, 255, 3]), np.packbits(np.unpackbits(np.array([256, 65, 400], "<u2").view(np.uint8), bitorder="little").reshape(-1, 16)[:, :9].ravel(), bitorder="little").tobytes()])
def test_unknown_codes(raw):
    with pytest.raises(ValueError):
        gif.lzw_decode(raw, 8)


def shown(width, height, frames):
    """Canvases by loops over pixels."""
    canvas, out = {}, []
    for f in frames:
        before = dict(canvas)
        for y, row in enumerate(f.indices.tolist()):
            for x, k in enumerate(row):
                if k != f.transparent and f.left + x < width and f.top + y < height:
                    canvas[f.left + x, f.top + y] = (*f.palette[k].tolist(), 255)
        out.append([[canvas.get((x, y), (0, 0, 0, 0)) for x in range(width)] for y in range(height)])
        h, w = f.indices.shape
        if f.disposal == gif.BACKGROUND:
            canvas = {k: v for k, v in canvas.items() if not (f.left <= k[0] < f.left + w and f.top <= k[1] < f.top + h)}
        elif f.disposal == gif.PREVIOUS:
            canvas = before
    return out


def test_palettes_disposal_transparency_and_interlacing():
    rng = np.random.default_rng(3)
    shared = rng.integers(0, 256, (16, 3), dtype=np.uint8)
    frames = []
    for k in range(24):
        own = shared if k % 3 else rng.integers(0, 256, (4 << k % 2, 3), dtype=np.uint8)
        h, w = rng.integers(1, 12, 2)
        frames.append(gif.Frame(int(rng.integers(0, 9)), int(rng.integers(0, 7)), rng.integers(0, len(own), (h, w), dtype=np.uint8), own, k, k % 5, [None, 0, 2][k % 3], k % 4 == 1))
    width, height, got = gif.decode(gif.encode(12, 10, frames, shared))
    assert (width, height, len(got)) == (12, 10, 24)
    for a, b, want in zip(frames, got, shown(12, 10, frames), strict=True):
        assert (a.left, a.top, a.delay, a.disposal, a.transparent, a.interlaced) == (b.left, b.top, b.delay, b.disposal, b.transparent, b.interlaced)
        assert (a.indices == b.indices).all() and (a.palette == b.palette).all()
        assert (b.canvas == np.array(want, np.uint8)).all()
        counts = gif.histograms(b.canvas)
        drawn = [p for row in want for p in row if p[3]]
        assert counts.tolist() == [[sum(p[c] // 32 == k for p in drawn) for k in range(8)] for c in range(3)]


def test_broken_files_are_errors():
    whole = gif.picture(gif.padded(b"some text" * 500), gif.palette_332())
    for raw in (b"", b"GIF89a", b"PNG" * 30, whole[:-1], whole[:900], whole[:100], whole[:13] + whole[13 + 768 :]):
        with pytest.raises(ValueError):
            gif.decode(raw)


def test_operator_edges(spark):
    long = "é word " * 60_000
    rows = [(1, "abc"), (2, None), (3, ""), (None, "abc"), (1, "abc"), (5, "x" * 64), (6, long), (7, "x" * 65)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'mine' media", "'mine' feature", "'mine' n_bytes").repartition(3)
    media = gif.store(docs)
    assert media.columns == ["doc_id", "feature", "n_bytes", "media"] and media.count() == len(rows)
    got = gif.features(media).toPandas()
    assert sorted(got.n_bytes) == sorted(len((t or "").encode()) for _, t in rows)
    for n, size, digest, tail in got[["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"]].itertuples(index=False):
        payload = next(gif.padded((t or "").encode()) for _, t in rows if len((t or "").encode()) == n)
        assert (size, digest, tail) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])) and size % 64 == 0 < size
    frames = gif.frames(media).where("doc_id = 6").orderBy("frame").toPandas()
    n = -(-len(long.encode()) // 64)
    assert len(frames) == -(-n // gif.ROWS) > 1 and frames.start_ms.tolist() == [100 * k for k in range(len(frames))]
    assert frames.height.sum() == n and [sum(x) + e for x, e in zip(frames.red, frames.blank, strict=True)] == [64 * gif.ROWS] * len(frames)
    none = spark.createDataFrame([], SCHEMA)
    assert gif.features(gif.store(none)).count() == gif.frames(gif.store(none)).count() == 0


def test_media_that_are_no_gif(spark):
    media = spark.createDataFrame([(1, None), (2, b"GIF89a"), (3, gif.encode(2, 2, [], gif.palette_332()))], "doc_id bigint, media binary")
    got = gif.frames(media).toPandas()
    assert sorted(got.doc_id) == [1, 2] and got.frame.isna().all() and got.error.notna().all()
    rows = gif.features(media).toPandas().set_index("doc_id")
    assert rows.payload_bytes.isna().tolist() == [True, True, False] and rows.loc[3].payload_bytes == 0 and rows.loc[2].media_bytes == 6


def test_query(spark, sf_dir):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet").set_index("doc_id").text
    got = QUERIES["op11_gif"](spark, sf_dir).toPandas().set_index("doc_id")
    assert len(got) == len(docs) and set(got.index) == set(docs.index)
    for i, t in docs.items():
        payload, r = gif.padded(t.encode()), got.loc[i]
        media = gif.picture(payload, gif.palette_332())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert got.groupby("payload_sha256").feature.nunique().max() == 1
