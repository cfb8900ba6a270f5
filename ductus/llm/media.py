"""Media columns as MPEG transport streams.

A payload of 8-bit samples is cut into access units, each a PES packet with a presentation timestamp,
carried by 188-byte packets behind program tables (PAT and PMT, repeated every TABLES_EVERY units). The first
packet of a unit is a random-access point and has the clock reference. Reading parses the tables and their
checksums, checks every continuity counter, and reassembles the units.

Defined cases: a null text counts as empty; an empty payload gives the tables and no unit; a stream with
lost, repeated or broken packets is read as far as it goes, with the errors counted; rows repeat as given;
an empty table gives an empty table; other columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ductus.llm.common import by_bytes, text_or_empty

PACKET = 188
PAT_PID, PMT_PID, DATA_PID, NULL_PID = 0, 0x1000, 0x100, 0x1FFF
PROGRAM = 1
#: Private data in PES packets, private stream 1.
STREAM_TYPE, STREAM_ID = 0x06, 0xBD
CLOCK, RATE = 90_000, 8_000
UNIT = 1536
TABLES_EVERY = 64
WRAP = 1 << 33


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


@lru_cache(1000)
def section_crc(data: bytes) -> int:
    """CRC-32 of MPEG-2 sections: not reflected, from all ones; 0 over a section with its checksum."""
    c = 0xFFFFFFFF
    for x in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ x]
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    """A section with pointer field and checksum, padded to a packet's payload."""
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\0\0"
    data = head + body
    return (b"\0" + data + section_crc(data).to_bytes(4, "big")).ljust(PACKET - 4, b"\xff")


PAT = _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
PMT = _section(2, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([STREAM_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\0")


def _pts(ticks: int) -> bytes:
    return bytes([0x21 | ticks >> 29 & 0xE, ticks >> 22 & 0xFF, ticks >> 14 & 0xFE | 1, ticks >> 7 & 0xFF, ticks << 1 & 0xFE | 1])


def _head(pid: int, start: bool, control: int, counter: int) -> bytes:
    return bytes([0x47, start << 6 | pid >> 8, pid & 0xFF, control << 4 | counter])


_NEXT = [_head(DATA_PID, False, 1, c) for c in range(16)]


def mux(payload: bytes, unit: int = UNIT, rate: int = RATE) -> bytes:
    """The transport stream of a payload."""
    out: list[bytes] = []
    counter = tables = 0
    for k, at in enumerate(range(0, max(len(payload), 1), unit)):
        if k % TABLES_EVERY == 0:
            out += _head(PAT_PID, True, 1, tables), PAT, _head(PMT_PID, True, 1, tables), PMT
            tables = tables + 1 & 15
        chunk = payload[at : at + unit]
        if not chunk:
            break
        ticks = at * CLOCK // rate % WRAP
        pes = b"\0\0\1" + bytes([STREAM_ID]) + (len(chunk) + 8).to_bytes(2, "big") + b"\x84\x80\5" + _pts(ticks) + chunk
        reference = (ticks << 15 | 0x7E00).to_bytes(6, "big")
        room = PACKET - 4 - 8
        stuffing = max(0, room - len(pes))
        out += _head(DATA_PID, True, 3, counter), bytes([7 + stuffing, 0x50]), reference, b"\xff" * stuffing, pes[:room]
        counter = counter + 1 & 15
        for p in range(room, len(pes), PACKET - 4):
            part = pes[p : p + PACKET - 4]
            if short := PACKET - 4 - len(part):
                out += _head(DATA_PID, False, 3, counter), bytes([short - 1]), b"\0" + b"\xff" * (short - 2) if short > 1 else b"", part
            else:
                out += _NEXT[counter], part
            counter = counter + 1 & 15
    return b"".join(out)


@dataclass
class Stream:
    """What a transport stream held: the payload, its units (pts, offset, size, random access) and errors."""

    payload: bytes = b""
    units: list[tuple[int, int, int, bool]] = field(default_factory=list)
    programs: dict[int, int] = field(default_factory=dict)  # program -> pid of its table
    streams: dict[int, int] = field(default_factory=dict)  # pid -> stream type
    packets: int = 0
    tables: int = 0
    clock_references: int = 0
    continuity_errors: int = 0
    broken: int = 0  # packets without sync byte, sections with a wrong checksum, units of a wrong length


def demux(data: bytes) -> Stream:
    s = Stream()
    counters: dict[int, int] = {}
    parts: list[bytes] = []
    chunks: list[bytes] = []
    point = False
    offset = last = 0

    def unit() -> None:
        nonlocal offset, last
        if not parts:
            return
        pes = b"".join(parts)
        parts.clear()
        if len(pes) < 14 or pes[:3] != b"\0\0\1" or not pes[7] & 0x80 or int.from_bytes(pes[4:6], "big") != len(pes) - 6:
            s.broken += 1
            return
        t = pes[9:14]
        ticks = (t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1
        ticks += (last - ticks + WRAP // 2) // WRAP * WRAP  # the timestamp wraps; time goes on
        last = ticks
        chunk = pes[9 + pes[8] :]
        s.units.append((ticks, offset, len(chunk), point))
        chunks.append(chunk)
        offset += len(chunk)

    for at in range(0, len(data) - PACKET + 1, PACKET):
        s.packets += 1
        if data[at] != 0x47 or data[at + 1] & 0x80:
            s.broken += 1
            continue
        b1, b3 = data[at + 1], data[at + 3]
        pid = (b1 & 0x1F) << 8 | data[at + 2]
        if pid == NULL_PID or not b3 & 0x10:
            continue
        counter = b3 & 15
        if (before := counters.get(pid)) is not None and counter != before + 1 & 15:
            s.continuity_errors += 1
            if counter == before:  # a repeated packet
                continue
            if pid in s.streams:
                parts.clear()
        counters[pid] = counter
        start, low = b1 & 0x40, at + 4
        flags = 0
        if b3 & 0x20:
            flags = data[low + 1] if data[low] else 0
            low += 1 + data[low]
        if pid in s.streams:
            if start:
                unit()
                point = bool(flags & 0x40)
            if flags & 0x10:
                s.clock_references += 1
            if start or parts:
                parts.append(data[low : at + PACKET])
        elif start and (pid == PAT_PID or pid in s.programs.values()):
            low += 1 + data[low]
            size = int.from_bytes(data[low + 1 : low + 3], "big") & 0xFFF
            section = data[low : low + 3 + size]
            if section_crc(section):
                s.broken += 1
                continue
            s.tables += 1
            if section[0] == 0:
                for i in range(8, len(section) - 4, 4):
                    s.programs[int.from_bytes(section[i : i + 2], "big")] = int.from_bytes(section[i + 2 : i + 4], "big") & 0x1FFF
            elif section[0] == 2:
                i = 12 + (int.from_bytes(section[10:12], "big") & 0xFFF)
                while i < len(section) - 4:
                    s.streams[int.from_bytes(section[i + 1 : i + 3], "big") & 0x1FFF] = section[i]
                    i += 5 + (int.from_bytes(section[i + 3 : i + 5], "big") & 0xFFF)
    unit()
    s.broken += len(data) % PACKET > 0
    s.payload = b"".join(chunks)
    return s


#: Bytes of payloads or streams that a task turns at a time, or one row's.
SLICE_BYTES = 16_000_000


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, n in by_bytes(batch.column(1), SLICE_BYTES, 256):
            yield batch.slice(low, n)


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        media = [mux(x.as_py()) for x in batch.column(1).cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], ["id", "media"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("pts", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("random_access", pa.bool_())]))
    for batch in _slices(batches):
        rows = [demux(x.as_py() or b"") for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([s.payload for s in rows], pa.binary()),
                pa.array([[dict(zip(("pts", "offset", "size", "random_access"), u)) for u in s.units] for s in rows], kind),
                pa.array([s.continuity_errors for s in rows], pa.int64()),
                pa.array([s.broken for s in rows], pa.int64()),
            ],
            ["id", "payload", "units", "continuity_errors", "broken"],
        )


def write_streams(df: DataFrame, id_col: str = "doc_id", payload_col: str = "payload") -> DataFrame:
    """id, media: the transport stream of every payload (binary or string)."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    return rows.mapInArrow(_write, f"id {rows.schema[0].dataType.simpleString()}, media binary")


def read_streams(df: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """id, payload, units (array of pts, offset, size, random_access), continuity_errors, broken."""
    rows = df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    schema = "payload binary, units array<struct<pts:long,offset:long,size:long,random_access:boolean>>, continuity_errors long, broken long"
    return rows.mapInArrow(_read, f"id {rows.schema[0].dataType.simpleString()}, {schema}")


def padded(text: bytes, to: int = 192) -> bytes:
    """text with spaces up to a positive multiple of `to`."""
    return text.ljust(max(to, -(-len(text) // to) * to), b" ")


def feature(s: Stream) -> str:
    """Structure, timing and level of a stream, in whole numbers."""
    import numpy as np

    x = np.frombuffer(s.payload, np.uint8).astype(np.int64)
    points = sum(u[3] for u in s.units)
    return (
        f"packets={s.packets};tables={s.tables};units={len(s.units)};random_access={points};clock={s.clock_references};"
        f"first_pts={s.units[0][0] if s.units else -1};last_pts={s.units[-1][0] if s.units else -1};continuity_errors={s.continuity_errors};broken={s.broken};"
        f"sum={int(x.sum())};energy={int((x * x).sum())};peak={int(x.max(initial=0))};crossings={int(((x[1:] < 128) != (x[:-1] < 128)).sum())}"
    )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in _slices(batches):
        rows = []
        for x in batch.column(1):
            media = x.as_py()
            s = demux(media)
            rows.append((len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(s)))
        columns = list(zip(*rows)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)


def op8_transport_streams(spark, sf_dir: str) -> DataFrame:
    """Texts padded and stored as streams, then read back from the stored bytes and digested."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = text_or_empty("text").cast("binary")
    n = F.octet_length(text)
    size = F.greatest(F.lit(192), F.ceil(n / 192).cast("int") * 192)
    payload = F.rpad(text, size, F.lit(b" "))
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), n.cast("long").alias("n_bytes"))
    media = write_streams(docs.select(key.alias("key"), payload.alias("payload")), "key")
    out = media.mapInArrow(_digest, "id struct<doc_id:long,n_bytes:long>, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return out.select("id.*", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
