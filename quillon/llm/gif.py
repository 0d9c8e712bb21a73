"""GIF media columns: LZW code streams, palettes, disposal and transparency, timed frames with colour histograms."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField

from quillon.llm.common import mapped, materialize, prepare, schema

#: Samples in a row of a stored payload, rows of its tallest frame, and hundredths of a second that a frame shows.
WIDTH, ROWS, DELAY = 64, 1024, 10
#: Bins of each colour channel's histogram.
BINS = 8
#: Most codes of an LZW table.
FULL = 4096

# Fixed values of the format: block introducers, extension labels and the disposal methods.
EXTENSION, IMAGE, TRAILER = 0x21, 0x2C, 0x3B
CONTROL, APPLICATION = 0xF9, 0xFF
KEEP, BACKGROUND, PREVIOUS = 1, 2, 3
#: First row and step of each pass of an interlaced image.
PASSES = ((0, 8), (4, 8), (2, 4), (1, 2))


def palette_332() -> np.ndarray:
    """256 different colours: three bits of red, three of green, two of blue."""
    i = np.arange(256)
    return np.stack([(i >> 5) * 255 // 7, ((i >> 2) & 7) * 255 // 7, (i & 3) * 85], axis=1).astype(np.uint8)


@dataclass
class Frame:
    """One image as stored (indices) and as shown (canvas, RGBA; alpha 0 where nothing is drawn)."""

    left: int
    top: int
    indices: np.ndarray
    palette: np.ndarray
    delay: int = 0
    disposal: int = 0
    transparent: int | None = None
    interlaced: bool = False
    canvas: np.ndarray | None = None


@cache
def _widths(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each code after a clear code, and the bits up to each: the reader adds an entry with every code but the first.

    FULL of them are given; the table is full before, and all later codes take as many bits as the last.
    """
    known = np.minimum((1 << size) + 2 + np.maximum(np.arange(FULL) - 1, 0), FULL - 1)
    widths = np.maximum(size + 1, np.frexp(known)[1])
    return widths, np.concatenate([[0], np.cumsum(widths)])


def lzw_encode(data: bytes, size: int = 8) -> bytes:
    """The code stream of samples below 2**size, packed from the low bit up; the table is cleared when it is full."""
    clear, runs, run = 1 << size, [], []
    table: dict[int, int] = {}
    get, add, code = table.get, run.append, clear + 2
    now = data[0] if data else None
    for sample in data[1:]:
        key = now << 8 | sample
        longer = get(key)
        if longer is not None:
            now = longer
            continue
        add(now)
        now = sample
        table[key] = code
        code += 1
        if code == FULL:
            add(clear)
            runs.append(run)
            run, code = [], clear + 2
            add = run.append
            table.clear()
    if now is not None:
        add(now)
    add(clear + 1)
    runs.append(run)
    codes = np.fromiter(chain([clear], *runs), dtype="<u2", count=1 + sum(map(len, runs)))
    widths = np.concatenate([[size + 1], *(_widths(size)[0][: len(x)] for x in runs)])
    bits = np.unpackbits(codes.view(np.uint8), bitorder="little").reshape(-1, 16)
    return np.packbits(bits[np.arange(16) < widths[:, None]], bitorder="little").tobytes()


def _runs(raw: bytes, size: int) -> Iterator[list[int]]:
    """The codes between clear codes, up to the end code or the last whole code."""
    wide = np.frombuffer(raw + bytes(4), dtype=np.uint8)
    bits, clear = 8 * len(raw), 1 << size
    at, held = 0, []
    while True:
        widths, offsets = _widths(size) if not held else (np.full(FULL, 12), np.arange(FULL + 1) * 12)
        n = int(np.searchsorted(offsets, bits - at, side="right")) - 1
        starts = at + offsets[:n]
        first = starts >> 3
        codes = wide[first].astype(np.int32) | wide[first + 1].astype(np.int32) << 8 | wide[first + 2].astype(np.int32) << 16
        codes = (codes >> (starts & 7)) & ((1 << widths[:n]) - 1)
        marks = np.flatnonzero((codes & ~1) == clear)
        stop = int(marks[0]) if len(marks) else n
        held += codes[:stop].tolist()
        if len(marks):
            yield held
            if codes[stop] == clear + 1:
                return
            at, held = int(at + offsets[stop + 1]), []
        elif n < FULL:
            yield held
            return
        else:
            at += int(offsets[FULL])


def lzw_decode(raw: bytes, size: int) -> bytes:
    """The samples of a code stream; a code that no table entry has is a ValueError."""
    base = [bytes([k]) for k in range(1 << size)] + [b"", b""]
    out: list[bytes] = []
    for run in _runs(raw, size):
        if not run:
            continue
        table, add = base.copy(), out.append
        if run[0] >= 1 << size:
            raise ValueError("an LZW run starts with an unknown code")
        before = base[run[0]]
        add(before)
        grows = FULL - len(base)
        known, keep = len(base), table.append
        for code in run[1 : 1 + grows]:
            if code < known:
                entry = table[code]
                keep(before + entry[:1])
            elif code == known:
                entry = before + before[:1]
                keep(entry)
            else:
                raise ValueError("an LZW code is ahead of its table")
            known += 1
            add(entry)
            before = entry
        out += [table[code] for code in run[1 + grows :]]
    return b"".join(out)


def _blocks(data: bytes) -> bytes:
    """Sub-blocks of at most 255 bytes, then the empty one."""
    return b"".join(bytes([len(x)]) + x for x in (data[k : k + 255] for k in range(0, len(data), 255))) + b"\0"


def encode(width: int, height: int, frames: list[Frame], palette: np.ndarray | None = None, loop: bool = True) -> bytes:
    """A GIF of frames on a canvas; a frame whose palette is the global one stores none. Palettes have 2 to 256 colours, a power of two."""
    depth = 0 if palette is None else len(palette).bit_length() - 2
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, (palette is not None) << 7 | 7 << 4 | max(depth, 0), 0, 0)]
    if palette is not None:
        out.append(palette.astype(np.uint8).tobytes())
    if loop and len(frames) > 1:
        out.append(bytes([EXTENSION, APPLICATION, 11]) + b"NETSCAPE2.0" + b"\x03\x01\0\0\0")
    for f in frames:
        h, w = f.indices.shape
        own = f.palette is not palette
        out.append(bytes([EXTENSION, CONTROL, 4]) + struct.pack("<BHB", f.disposal << 2 | (f.transparent is not None), f.delay, f.transparent or 0) + b"\0")
        bits = len(f.palette).bit_length() - 1
        out.append(struct.pack("<BHHHHB", IMAGE, f.left, f.top, w, h, own << 7 | f.interlaced << 6 | (bits - 1 if own else 0)))
        if own:
            out.append(f.palette.astype(np.uint8).tobytes())
        rows = f.indices[np.concatenate([np.arange(a, h, b) for a, b in PASSES])] if f.interlaced else f.indices
        size = max(2, bits)
        out += [bytes([size]), _blocks(lzw_encode(rows.astype(np.uint8).tobytes(), size))]
    return b"".join([*out, bytes([TRAILER])])


def _colours(raw: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 0x80:
        return None, at
    end = at + 3 * (2 << (flags & 7))
    if end > len(raw):
        raise ValueError("a palette is cut")
    return np.frombuffer(raw[at:end], dtype=np.uint8).reshape(-1, 3), end


def _joined(raw: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        if at >= len(raw):
            raise ValueError("a chain of blocks is cut")
        n = raw[at]
        if not n:
            return b"".join(parts), at + 1
        parts.append(raw[at + 1 : at + 1 + n])
        at += 1 + n


def decode(raw: bytes, draw: bool = True) -> tuple[int, int, list[Frame]]:
    """(width, height, frames in order); with draw each frame's canvas too. What isn't a whole GIF is a ValueError.

    The canvas starts empty. A frame is drawn where its samples aren't the transparent one, and what lies beyond
    the canvas is cut off. Then its disposal holds: its rectangle is emptied (2), what was there before the frame
    comes back (3), or all stays (0, 1 and undefined ones).
    """
    if raw[:6] not in (b"GIF87a", b"GIF89a") or len(raw) < 13:
        raise ValueError("no GIF header")
    width, height, flags = struct.unpack_from("<HHB", raw, 6)
    shared, at = _colours(raw, 13, flags)
    frames, delay, disposal, transparent = [], 0, 0, None
    canvas = np.zeros((height, width, 4), dtype=np.uint8) if draw else None
    while True:
        kind = raw[at] if at < len(raw) else None
        if kind == TRAILER:
            return width, height, frames
        if kind == EXTENSION and at + 1 < len(raw):
            label = raw[at + 1]
            body, at = _joined(raw, at + 2)
            if label == CONTROL and len(body) >= 4:
                bits, delay, index = struct.unpack_from("<BHB", body)
                disposal, transparent = bits >> 2 & 7, index if bits & 1 else None
            continue
        if kind != IMAGE or at + 10 > len(raw):
            raise ValueError("the blocks of the file end or are unknown")
        left, top, w, h, bits = struct.unpack_from("<HHHHB", raw, at + 1)
        own, at = _colours(raw, at + 10, bits)
        palette = shared if own is None else own
        if palette is None or at >= len(raw) or not 1 <= raw[at] <= 8:
            raise ValueError("an image has no palette or no code size")
        size = raw[at]
        stream, at = _joined(raw, at + 1)
        samples = lzw_decode(stream, size)
        if len(samples) < w * h:
            raise ValueError("an image has too few samples")
        indices = np.frombuffer(samples[: w * h], dtype=np.uint8).reshape(h, w)
        if bits & 0x40:
            rows = np.empty_like(indices)
            rows[np.concatenate([np.arange(a, h, b) for a, b in PASSES])] = indices
            indices = rows
        f = Frame(left, top, indices, palette, delay, disposal, transparent, bool(bits & 0x40))
        if draw:
            if indices.size and int(indices.max()) >= len(palette):
                raise ValueError("a sample has no colour")
            before = canvas.copy() if disposal == PREVIOUS else None
            place = canvas[top : top + h, left : left + w]
            seen = indices[: place.shape[0], : place.shape[1]]
            colours = np.empty((*seen.shape, 4), dtype=np.uint8)
            colours[..., :3], colours[..., 3] = palette[seen], 255
            place[...] = colours if transparent is None else np.where((seen == transparent)[..., None], place, colours)
            f.canvas = canvas.copy()
            if disposal == BACKGROUND:
                place[...] = 0
            elif disposal == PREVIOUS:
                canvas = before
        frames.append(f)
        delay, disposal, transparent = 0, 0, None


def histograms(canvas: np.ndarray) -> np.ndarray:
    """Pixels drawn in each of BINS equal ranges, for red, green and blue."""
    drawn = canvas[canvas[..., 3] > 0]
    return np.stack([np.bincount(drawn[:, k].astype(np.int64) * BINS >> 8, minlength=BINS) for k in range(3)])


def padded(text: bytes) -> bytes:
    """text with bytes 0 up to a positive multiple of WIDTH."""
    return text + bytes(-len(text) % WIDTH if text else WIDTH)


def picture(payload: bytes, palette: np.ndarray) -> bytes:
    """A GIF whose samples are the payload, row by row, ROWS rows a frame; a frame goes before the next one shows."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    frames = [Frame(0, 0, rows[k : k + ROWS], palette, DELAY, BACKGROUND) for k in range(0, len(rows), ROWS)]
    return encode(WIDTH, min(len(rows), ROWS), frames, palette)


def store(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (all but text, if none are named) with n_bytes and media: each whole text as a GIF.

    A null text is empty, and an empty one is a row of zeros. Columns of docs with the new names are replaced. The
    table is written to the shared folder and read back. Repeated rows, null keys and an empty table give as many rows.
    """
    prepare(docs.sparkSession)
    carried = [f for f in docs.schema if (f.name != text if carry is None else f.name in carry) and f.name not in ("n_bytes", "media")]
    kept, palette = [f.name for f in carried], palette_332()
    docs = docs.select(*kept, docs[text].alias("_text"))

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [(x or "").encode() for x in batch.column(batch.schema.get_field_index("_text")).to_pylist()]
        media = pa.array([picture(padded(x), palette) for x in raw], pa.binary())
        return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(x)) for x in kept), pa.array(list(map(len, raw)), pa.int64()), media], names=[*kept, "n_bytes", "media"])

    return materialize(mapped(docs, fn, schema(carried, "n_bytes bigint, media binary"), "_text"), "gif")


def frames(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """A row per frame: the key, frame (from 0), left, top, width, height, start_ms, delay_ms, disposal, blank (pixels of the
    canvas that nothing is drawn on), red, green and blue (histograms of the canvas as shown), and error.

    Media that are null or no whole GIF give one row with a null frame and the error; a GIF without images gives none.
    """
    prepare(media.sparkSession)
    field = media.schema[key]
    names = ["frame", "left", "top", "width", "height", "start_ms", "delay_ms", "disposal", "blank", "red", "green", "blue", "error"]
    rows_schema = schema([StructField("key", field.dataType)], "frame int, left int, top int, width int, height int, start_ms bigint, delay_ms bigint, disposal int, blank bigint, red array<bigint>, green array<bigint>, blue array<bigint>, error string")

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, rows = [], []
        for i, raw in enumerate(batch.column(batch.schema.get_field_index("media")).to_pylist()):
            try:
                found = decode(raw or b"")[2]
            except ValueError as error:
                keys.append(i)
                rows.append((*[None] * (len(names) - 1), str(error)))
                continue
            start = 0
            for k, f in enumerate(found):
                keys.append(i)
                rows.append((k, f.left, f.top, f.indices.shape[1], f.indices.shape[0], start, 10 * f.delay, f.disposal, int((f.canvas[..., 3] == 0).sum()), *histograms(f.canvas).tolist(), None))
                start += 10 * f.delay
        kinds = [pa.int32()] * 5 + [pa.int64()] * 2 + [pa.int32(), pa.int64()] + [pa.list_(pa.int64())] * 3 + [pa.string()]
        key_column = batch.column(batch.schema.get_field_index("key")).take(pa.array(keys, pa.int64()))
        return pa.RecordBatch.from_arrays([key_column, *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=["key", *names])

    out = mapped(media.select(media[key].alias("key"), media[column].alias("media")), fn, rows_schema, "media")
    return out.withColumnRenamed("key", key)


def features(media: DataFrame, column: str = "media") -> DataFrame:
    """The other columns of media with what their GIFs hold: payload_bytes, payload_sha256, tail_crc32 (of the last 64 samples),
    media_bytes, media_sha256 and feature (frames, milliseconds, canvas and the frames' summed histograms).

    Media that are null or no whole GIF have null payload columns and the error as feature.
    """
    prepare(media.sparkSession)
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    carried = [f for f in media.schema if f.name != column and f.name not in names]
    kept = [f.name for f in carried]

    def one(raw: bytes) -> tuple:
        own = (len(raw), hashlib.sha256(raw).hexdigest())
        try:
            width, height, found = decode(raw)
        except ValueError as error:
            return (None, None, None, *own, str(error))
        payload = b"".join(f.indices.tobytes() for f in found)
        total = sum((histograms(f.canvas) for f in found), np.zeros((3, BINS), dtype=np.int64))
        colours = " ".join(f"{c}={','.join(map(str, x))}" for c, x in zip(("red", "green", "blue"), total.tolist(), strict=True))
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), *own, f"frames={len(found)} ms={sum(10 * f.delay for f in found)} canvas={width}x{height} {colours}"

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [one(x or b"") for x in batch.column(batch.schema.get_field_index("media")).to_pylist()]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(x)) for x in kept), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=[*kept, *names])

    source = media.select(*kept, media[column].alias("media"))
    return mapped(source, fn, schema(carried, "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"), "media")
