"""Ogg media columns.

Writes and reads the Ogg container: pages with checksums, packets laced over pages, logical streams by
serial number, time from granule positions.  A payload of 8-bit samples is stored losslessly as packets of
one stream; a second stream, interleaved with it, marks the seconds.

Reading verifies the checksum of every page, page order and continuation flags, and raises ``OggError`` on
damage; ``read_media`` turns that into a row with an error.  Cases: a null or empty text is 64 zero bytes;
equal texts give equal media; null ids and repeated rows are carried along; bytes that are not UTF-8 are stored as they are; extra columns are ignored; very
long texts take as many pages as they need; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenfold.llm import textops

RATE = 8000
PACKET = 4000
PACKETS_A_PAGE = 8
UNIT = 64
SAMPLES, MARKS = 0x534D504C, 0x4D41524B
CONTINUED, FIRST, LAST = 1, 2, 4
NONE = (1 << 64) - 1
_HEAD = struct.Struct("<4sBBQIIIB")
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    """The bytes aren't a sound Ogg stream."""


def checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, no reflection, start 0: zlib's on mirrored bits, without its inversions."""
    crc = ~zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) & 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_MIRROR), "big")


def page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    whole = head + body
    return whole[:22] + checksum(whole).to_bytes(4, "little") + whole[26:]


def paged(serial: int, packets: list[tuple[bytes, int]], number: int = 0, most: int = PACKETS_A_PAGE, last: bool = True) -> list[bytes]:
    """Pages for (packet, granule position at its end): at most ``most`` packets and 255 segments each; the first page has the first packet alone."""
    pages: list[bytes] = []
    lacing, body, granule, done, open_ = bytearray(), bytearray(), NONE, 0, False

    def close(flags: int) -> None:
        nonlocal lacing, body, granule, done, open_
        pages.append(page(serial, number + len(pages), flags | (CONTINUED if open_ else 0) | (FIRST if number + len(pages) == 0 else 0), granule, bytes(lacing), bytes(body)))
        open_ = bool(lacing) and lacing[-1] == 255
        lacing, body, granule, done = bytearray(), bytearray(), NONE, 0

    for k, (packet, end) in enumerate(packets):
        at = 0
        while True:
            step = min(255, len(packet) - at)
            lacing.append(step)
            body += packet[at : at + step]
            at += step
            if step < 255:
                granule, done = end, done + 1
                break
            if len(lacing) == 255:
                close(0)
        final = k == len(packets) - 1
        if done == most or len(lacing) >= 240 or final or (k == 0 and number == 0):
            close(LAST if final and last else 0)
    return pages


def write_samples(payload: bytes) -> bytes:
    """An Ogg file of 8-bit samples: a header, the samples, and a stream of marks."""
    head = struct.pack("<8sIQ", b"SAMPLES8", RATE, len(payload))
    data = [(payload[a : a + PACKET], min(a + PACKET, len(payload))) for a in range(0, len(payload), PACKET)]
    one = paged(SAMPLES, [(head, 0), *data])
    marks = [(struct.pack("<Q", s), s) for s in range(0, len(payload), RATE)]
    two = paged(MARKS, [(struct.pack("<8sI", b"SECONDS\0", RATE), 0), *marks])
    mixed = [one[0], two[0]]  # all first pages come first, then the streams take turns
    for k in range(1, max(len(one), len(two))):
        mixed += one[k : k + 1] + two[k : k + 1]
    return b"".join(mixed)


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    ends: list[float | None] = field(default_factory=list)  # granule position at the end of a packet, where a page gives it
    pages: int = 0
    part: bytearray | None = None
    closed: bool = False


def read(raw: bytes) -> dict[int, Stream]:
    """Logical streams by serial number."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(raw):
        if len(raw) - at < 27 or raw[at : at + 4] != b"OggS":
            raise OggError(f"no page at byte {at}")
        _, version, flags, granule, serial, number, crc, segments = _HEAD.unpack_from(raw, at)
        lacing = raw[at + 27 : at + 27 + segments]
        size = 27 + segments + sum(lacing)
        if version or len(lacing) < segments or at + size > len(raw):
            raise OggError(f"cut or unknown page at byte {at}")
        if checksum(raw[at : at + 22] + b"\0\0\0\0" + raw[at + 26 : at + size]) != crc:
            raise OggError(f"wrong checksum at byte {at}")
        if (serial in streams) == bool(flags & FIRST):
            raise OggError(f"stream {serial} begins twice or not at all")
        s = streams.setdefault(serial, Stream(serial))
        if number != s.pages or s.closed:
            raise OggError(f"page {s.pages} of stream {serial} is missing")
        if bool(flags & CONTINUED) != (s.part is not None):
            raise OggError(f"packet of stream {serial} torn at page {number}")
        s.pages += 1
        pos, done = at + 27 + segments, len(s.packets)
        for n in lacing:
            if s.part is None:
                s.part = bytearray()
            s.part += raw[pos : pos + n]
            pos += n
            if n < 255:
                s.packets.append(bytes(s.part))
                s.ends.append(None)
                s.part = None
        if len(s.packets) > done and granule != NONE:
            s.ends[-1] = granule
        s.closed = bool(flags & LAST)
        at += size
    for s in streams.values():
        if s.part is not None or not s.closed:
            raise OggError(f"stream {s.serial} has no end")
    return streams


def read_samples(raw: bytes) -> tuple[bytes, dict[int, Stream]]:
    streams = read(raw)
    s = streams.get(SAMPLES)
    if s is None or not s.packets or s.packets[0][:8] != b"SAMPLES8":
        raise OggError("no stream of samples")
    payload = b"".join(s.packets[1:])
    if len(payload) != struct.unpack_from("<Q", s.packets[0], 12)[0] or s.ends[-1] != len(payload):
        raise OggError("wrong number of samples")
    return payload, streams


def describe(payload: bytes, streams: dict[int, Stream]) -> str:
    """Pages, packets, length and loudness, as text."""
    s = streams[SAMPLES]
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    centred = x - 128
    crossings = int(np.count_nonzero((centred[1:] >= 0) != (centred[:-1] >= 0)))
    marks = [struct.unpack("<Q", p)[0] / RATE for p in streams[MARKS].packets[1:]] if MARKS in streams else []
    pages = ",".join(f"{t.serial:08x}:{t.pages}/{len(t.packets)}" for t in sorted(streams.values(), key=lambda t: t.serial))
    return f"streams={pages};samples={len(x)};ms={s.ends[-1] * 1000 // RATE};marks={len(marks)};mean_milli={int(x.sum()) * 1000 // len(x)};power={int((centred * centred).sum()) // len(x)};crossings={crossings}"


def payload_of(text: bytes) -> bytes:
    return text + bytes(-len(text) % UNIT or (UNIT if not text else 0))


def media_columns(docs: DataFrame, with_media: bool = False) -> DataFrame:
    """One row per document: the payload as stored and read back, digests, and features (and ``with_media`` the Ogg file)."""
    extra = ", media binary" if with_media else ""

    def work(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            data, offsets = textops.buffers(batch.column("text"))
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                rows = [_row(data[offsets[k] : offsets[k + 1]].tobytes(), with_media) for k in range(lo, lo + part.num_rows)]
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id")} | {n: pa.array(c, k) for n, c, k in zip(names, cols, kinds, strict=False)})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + extra)


def _row(text: bytes, with_media: bool) -> tuple:
    media = write_samples(payload_of(text))
    payload, streams = read_samples(media)
    row = (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), describe(payload, streams))
    return (*row, media) if with_media else row


def read_media(files: DataFrame, content: str = "content") -> DataFrame:
    """Any Ogg files (``content``: binary) as packets: the file's other columns, serial, packet, data, seconds (null where no page gives the time) and error; a file without packets, null or empty ones too, has one row with an error."""
    keep = [f for f in files.schema.fields if f.name != content and f.name not in ("serial", "packet", "data", "seconds", "error")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "serial long, packet int, data binary, seconds double, error string"])

    def work(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column(content)[i].as_py()
                try:
                    rows = [(s.serial, k, p, None if e is None else e / RATE, None) for s in read(raw or b"").values() for k, (p, e) in enumerate(zip(s.packets, s.ends, strict=True))]
                    rows = rows or [(None, None, None, None, "no packets")]
                except OggError as e:
                    rows = [(None, None, None, None, str(e))]
                cols = list(zip(*rows, strict=True))
                own = {f.name: batch.column(f.name).take(pa.array([i] * len(rows))) for f in keep}
                yield pa.RecordBatch.from_pydict(own | {n: pa.array(c, k) for n, c, k in zip(("serial", "packet", "data", "seconds", "error"), cols, (pa.int64(), pa.int32(), pa.binary(), pa.float64(), pa.string()), strict=True)})

    return files.select(*[f.name for f in keep], content).mapInArrow(work, schema)
