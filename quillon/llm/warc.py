"""WARC archives: writing with identical-payload revisits, and a reader that salvages what follows damage."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize, prepare

#: Bytes of an archive; zlib level of its members.
ARCHIVE, LEVEL = 16 << 20, 4
#: Fixed values of the formats.
VERSION, GZIP, PROFILE = b"WARC/1.1", b"\x1f\x8b\x08", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CANDIDATE = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r?\n")
VERSION_LINE = re.compile(rb"WARC/1\.[01]\r?\n")
#: Bytes in which a member must give its first ones, else it is taken for none: its names and extra field are that short.
LEAD = 1 << 11


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@dataclass
class Record:
    headers: dict[str, str]
    content: bytes
    start: int = 0
    end: int = 0

    @property
    def payload(self) -> bytes:
        """The entity body of a response; nothing for other types."""
        if self.headers.get("warc-type") != "response":
            return b""
        head, gap, body = self.content.partition(b"\r\n\r\n")
        return body if gap else b""


@dataclass
class Salvaged:
    records: list[Record] = field(default_factory=list)
    #: Byte ranges that no record covers, each with the reason why its first byte failed.
    gaps: list[tuple[int, int, str]] = field(default_factory=list)


def _clean(value: str) -> str:
    """Header values hold no control characters; they are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", value)


def write_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, compress: bool = True) -> bytes:
    """One record: a response, or with refers_to a revisit, which carries no payload but its length and digest."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    content = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'none' if page_id is None else page_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        *([("WARC-Target-URI", _clean(url))] if url else []),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Payload-Length", str(len(payload))),
        ("WARC-Block-Digest", f"sha1:{digest(content)}"),
        *([("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")] if revisit else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(content))),
    ]
    raw = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + content + b"\r\n\r\n"
    if not compress:
        return raw
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _inflate(data: memoryview, at: int) -> tuple[bytes, int, str]:
    """What the gzip member at a place holds, as far as it can be read, where reading ended, and what is wrong with it ("" if nothing).

    A member that doesn't begin with a version line is given up after its first bytes.
    """
    z, out, have, begun, size = zlib.decompressobj(31), [], 0, at, len(data)
    while not z.eof:
        if at >= size:
            return b"".join(out), size, "member is cut off"
        part, before = data[at : at + (65536 if have >= 16 else 512)], z.copy()
        try:
            out.append(z.decompress(part))
        except zlib.error as error:
            return b"".join([*out, *_upto(before, part)]), at + len(part), str(error)
        at += len(part)
        if have < 16:
            have += len(out[-1])
            if (have >= 16 or z.eof) and not VERSION_LINE.match(b"".join(out)) or at - begun > LEAD and have < 16:
                return b"", at, "member does not begin with a version line"
    return b"".join(out), at - len(z.unused_data), ""


def _upto(z: zlib._Decompress, part: memoryview) -> Iterator[bytes]:
    """What part gives before its first bad byte."""
    for step in (4096, 64, 1):
        at = 0
        while at < len(part):
            before = z.copy()
            try:
                yield z.decompress(part[at : at + step])
            except zlib.error:
                z, part = before, part[at : at + step]
                break
            at += step


class Damaged(ValueError):
    """A record whose length fits and whose content does not: what stands inside it is no record of the archive."""

    def __init__(self, reason: str, end: int) -> None:
        super().__init__(reason)
        self.end = end


HEADER_LINE = re.compile(rb"([^:\r\n]+):([^\r\n]*)\r\n")


def _parse(data: bytes, at: int) -> tuple[Record, int]:
    """The uncompressed record at a place, and where it ends; ValueError if anything about it is wrong.

    Lines are read one by one up to the first that is no header, so a false version line costs no more than them.
    """
    found = VERSION_LINE.match(data, at)
    if not found:
        raise ValueError("no version line")
    headers: dict[str, str] = {}
    start = found.end()
    while data[start : start + 2] != b"\r\n":
        line = HEADER_LINE.match(data, start)
        if not line:
            raise ValueError("bad header line" if data.find(b"\n", start, start + (1 << 16)) >= 0 else "header is cut off")
        headers[line[1].decode("latin-1").strip().lower()] = line[2].decode("utf-8", "replace").strip()
        start = line.end()
    if not (headers.get("content-length", "").isascii() and headers.get("content-length", "").isdecimal()):
        raise ValueError("no length")
    start += 2
    end = start + int(headers["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("length does not fit")
    record = Record(headers, data[start:end])
    said = headers.get("warc-block-digest", "")
    if said.startswith("sha1:") and said != f"sha1:{digest(record.content)}":
        raise Damaged("block digest does not fit", end + 4)
    if headers.get("warc-type") == "response" and (said := headers.get("warc-payload-digest", "")).startswith("sha1:") and said != f"sha1:{digest(record.payload)}":
        raise Damaged("payload digest does not fit", end + 4)
    return record, end + 4


def _inside(body: bytes) -> tuple[list[Record], list[tuple[int, int, str]]]:
    """The intact records of a member's content and the byte ranges between them: after damage the search goes on at the next version line."""
    found, gaps, at = [], [], 0
    bad: tuple[int, str] | None = None
    while at < len(body):
        try:
            record, end = _parse(body, at)
        except ValueError as error:
            bad = bad or (at, str(error))
            line = VERSION_LINE.search(body, error.end if isinstance(error, Damaged) else at + 1)
            at = line.start() if line else len(body)
            continue
        if bad:
            gaps.append((bad[0], at, bad[1]))
            bad = None
        found.append(record)
        at = end
    if bad:
        gaps.append((bad[0], len(body), bad[1]))
    return found, gaps


def salvage(data: bytes) -> Salvaged:
    """All intact records of an archive, compressed or not, in order.

    Where a record fails its checks, the search goes on at the next gzip magic or version line, or, where its length fits
    and only a digest does not, after its end: a record that stands in the payload of a damaged one is not taken for one
    of the archive. In a sound member it goes on at the next version line of its content. A member that is cut or broken gives
    the records before that place whose own digest fits (without one nothing vouches for them), and the search goes on
    after its first byte. Outside of intact members every byte lies in a record or in a gap; the gaps of a sound member are ranges of
    its content, and of a broken one the whole place is a gap, whatever was recovered. Digests of other kinds than sha1 are not checked.
    """
    out, at, view = Salvaged(), 0, memoryview(data)
    bad: tuple[int, str] | None = None
    while at < len(data):
        member, later, reason, end = data[at : at + 3] == GZIP, at + 1, "", at
        found: list[Record] = []
        inner: list[tuple[int, int, str]] = []
        if member:
            body, end, reason = _inflate(view, at)
            found, inner = _inside(body)
            if reason:
                found = [r for r in found if r.headers.get("warc-block-digest", "").startswith("sha1:")]
            elif not found:
                reason, later = inner[0][2] if inner else "empty member", end
        else:
            try:
                record, end = _parse(data, at)
                found = [record]
            except ValueError as error:
                reason, later = str(error), getattr(error, "end", later)
        for record in found:
            record.start, record.end = at, end
        out.records += found
        if reason:
            bad = bad or (at, reason)
            candidate = CANDIDATE.search(data, later)
            at = candidate.start() if candidate else len(data)
            continue
        if bad:
            out.gaps.append((bad[0], at, bad[1]))
            bad = None
        out.gaps += [(at, end, f"bytes {a} to {b} of the member: {why}") for a, b, why in inner]
        at = end
    if bad:
        out.gaps.append((bad[0], len(data), bad[1]))
    return out


def write_archives(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Archives (archive, data) of one record per row of pages.

    Of rows with equal payloads of at least `least` bytes that with the smallest key is a response, the others
    revisit it. Equality is by length and SHA-256. A null html is an empty payload; rows with a null key, and
    those that repeat the smallest key, are responses.
    """
    prepare(pages.sparkSession)
    rows = pages.select(F.col(key).cast("bigint").alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    sums = rows.select("id", F.sha2("html", 256).alias("sha"), F.octet_length("html").alias("n")).where(F.col("n") >= least)
    firsts = sums.groupBy("sha", "n").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first != last")
    again = sums.join(firsts, ["sha", "n"]).where("id != first").select("id", "sha", "first").distinct()
    again = materialize(again, "warc-revisits")
    rows = rows.join(again.withColumnRenamed("sha", "sha_"), (rows.id == again.id) & (F.sha2("html", 256) == F.col("sha_")), "left").select(rows.id, "url", "html", "first")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, held, have = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for i, u, h, first in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                raw = write_record(i, u, (h or "").encode(), first)
                held.append(raw)
                have += len(raw)
                if have >= ARCHIVE:
                    yield pa.RecordBatch.from_pydict({"archive": [(part << 32) | seq], "data": pa.array([b"".join(held)], pa.binary())})
                    seq, held, have = seq + 1, [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"archive": [(part << 32) | seq], "data": pa.array([b"".join(held)], pa.binary())})

    return materialize(rows.mapInArrow(over, "archive bigint, data binary"), "warc")


def _number(value: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(found[1]) if found else None


def _length(value: str | None, otherwise: int) -> int:
    """A length as the header gives it; archives of other writers may have none, or something else there."""
    return int(value) if value and re.fullmatch(r"[0-9]{1,18}", value) else otherwise


def read_archives(archives: DataFrame, key: str = "page_id", payload: bool = False) -> DataFrame:
    """One row per intact record: key, payload_bytes, payload_digest, record_type, refers_to and, with payload, url and html."""
    names = [key, "payload_bytes", "payload_digest", "record_type", "refers_to", *(["url", "html"] if payload else [])]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(batch.schema.get_field_index("data")).to_pylist():
                found = salvage(raw or b"").records
                h = [r.headers for r in found]
                cols = [
                    pa.array([_number(x.get("warc-record-id")) for x in h], pa.int64()),
                    pa.array([_length(x.get("warc-payload-length"), len(r.payload)) for x, r in zip(h, found, strict=True)], pa.int64()),
                    pa.array([x.get("warc-payload-digest", "").removeprefix("sha1:") for x in h], pa.string()),
                    pa.array([x.get("warc-type") for x in h], pa.string()),
                    pa.array([_number(x.get("warc-refers-to")) for x in h], pa.int64()),
                ]
                if payload:
                    cols += [pa.array([x.get("warc-target-uri") for x in h], pa.string()), pa.array([r.payload.decode("utf-8", "replace") for r in found], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    more = ", url string, html string" if payload else ""
    return archives.select("data").mapInArrow(over, f"{key} bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint{more}")


def quarantine(archives: DataFrame) -> DataFrame:
    """The byte gaps of all archives: archive, gap_start, gap_end and reason."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, raw in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                gaps = salvage(raw or b"").gaps
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gaps), archive, dtype=np.int64)), pa.array([g[0] for g in gaps], pa.int64()), pa.array([g[1] for g in gaps], pa.int64()), pa.array([g[2] for g in gaps], pa.string())], names=["archive", "gap_start", "gap_end", "reason"])

    return archives.select("archive", "data").mapInArrow(over, "archive bigint, gap_start bigint, gap_end bigint, reason string")
