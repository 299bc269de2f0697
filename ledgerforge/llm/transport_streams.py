"""Operator 2: MPEG transport streams.

A payload is carried as private data of one program: a program association table, a
program map table, then one elementary packet (PES) for each access unit, cut into
188-byte transport packets with continuity counters, adaptation fields and stuffing. Units
have 33-bit timestamps on the 90 kHz clock; every `RANDOM_ACCESS`-th unit is marked as a
random-access point and carries the program clock.

Parsing takes any transport stream: it checks sync bytes and table checksums, follows the
tables to the elementary streams, drops repeated packets, notes gaps in the continuity
counters, reassembles PES packets and records each unit's timestamps, place and
random-access mark.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import stored, texts

PACKET = 188
SYNC = 0x47
PAT_PID, PMT_PID, STREAM_PID, NULL_PID = 0x0000, 0x1000, 0x0100, 0x1FFF
#: stream_type "PES packets with private data" and its stream_id
PRIVATE_TYPE, PRIVATE_STREAM = 0x06, 0xBD
UNIT_BYTES = 2048
UNIT_TICKS = 3600
RANDOM_ACCESS = 8
PAD_TO = 64


@lru_cache(maxsize=1)
def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        value = byte << 24
        for _ in range(8):
            value = (value << 1) ^ (0x04C11DB7 if value & 0x80000000 else 0)
        table.append(value & 0xFFFFFFFF)
    return table


@lru_cache(maxsize=1024)
def section_crc(data: bytes) -> int:
    value, table = 0xFFFFFFFF, _crc_table()
    for byte in data:
        value = (value << 8 & 0xFFFFFFFF) ^ table[value >> 24 ^ byte]
    return value


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | len(body) + 9, number, 0xC1, 0, 0)
    return head + body + struct.pack(">I", section_crc(head + body))


def _table_packet(pid: int, section: bytes) -> bytes:
    return struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10) + b"\0" + section.ljust(PACKET - 5, b"\xff")


@lru_cache(maxsize=1)
def _tables() -> bytes:
    pat = _section(0x00, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID))
    pmt = _section(0x02, 1, struct.pack(">HHBHH", 0xE000 | STREAM_PID, 0xF000, PRIVATE_TYPE, 0xE000 | STREAM_PID, 0xF000))
    return _table_packet(PAT_PID, pat) + _table_packet(PMT_PID, pmt)


def _stamp(mark: int, ticks: int) -> bytes:
    return bytes((mark << 4 | ticks >> 29 & 0x0E | 1, ticks >> 22 & 0xFF, ticks >> 14 & 0xFE | 1, ticks >> 7 & 0xFF, ticks << 1 & 0xFE | 1))


def _ticks(raw: bytes) -> int:
    return (raw[0] & 0x0E) << 29 | raw[1] << 22 | (raw[2] & 0xFE) << 14 | raw[3] << 7 | raw[4] >> 1


def multiplex(payload: bytes) -> bytes:
    """The transport stream of one payload."""
    out, counter = [_tables()], 0
    for unit, at in enumerate(range(0, len(payload), UNIT_BYTES)):
        data = payload[at : at + UNIT_BYTES]
        ticks = unit * UNIT_TICKS & 0x1FFFFFFFF
        pes = struct.pack(">IHBBB", 0x100 | PRIVATE_STREAM, len(data) + 8, 0x80, 0x80, 5) + _stamp(2, ticks) + data
        pos = 0
        while pos < len(pes):
            field_bytes = b""
            if pos == 0 and unit % RANDOM_ACCESS == 0:
                field_bytes = b"\x50" + struct.pack(">IH", ticks >> 1, (ticks & 1) << 15 | 0x7E00)
            room = PACKET - 4 - (len(field_bytes) + 1 if field_bytes else 0)
            take = min(room, len(pes) - pos)
            spare = room - take
            if spare and not field_bytes:
                # A field of length 0 is one stuffing byte; a longer one needs its flags.
                spare -= 1
                field_bytes = b"\0" + b"\xff" * (spare - 1) if spare else b""
                header = bytes([len(field_bytes)]) + field_bytes
            elif field_bytes:
                header = bytes([len(field_bytes) + spare]) + field_bytes + b"\xff" * spare
            else:
                header = b""
            start = 0x4000 if pos == 0 else 0
            out.append(struct.pack(">BHB", SYNC, start | STREAM_PID, (0x30 if header else 0x10) | counter))
            out.append(header)
            out.append(pes[pos : pos + take])
            pos += take
            counter = counter + 1 & 15
    return b"".join(out)


@dataclass
class Unit:
    pid: int
    pts: int | None
    dts: int | None
    packet: int
    random_access: bool
    data: bytes


@dataclass
class Parsed:
    packets: int = 0
    units: list[Unit] = field(default_factory=list)
    streams: dict[int, int] = field(default_factory=dict)
    #: sync, scrambled, checksum, gap, repeated, pes: how often each was met
    faults: Counter = field(default_factory=Counter)


def _read_table(packet: bytes, at: int, faults: Counter) -> tuple[int, bytes] | None:
    """(table id, body) of a section that begins in the packet, when its checksum holds."""
    at += 1 + packet[at]
    length = struct.unpack_from(">H", packet, at + 1)[0] & 0x0FFF if at + 3 <= PACKET else PACKET
    section = packet[at : at + 3 + length]
    if at + 3 + length > PACKET or length < 9 or section_crc(section[:-4]) != struct.unpack(">I", section[-4:])[0]:
        faults["checksum"] += 1
        return None
    return section[0], section[8:-4]


def _unit(pid: int, packet: int, mark: bool, raw: bytes, faults: Counter) -> Unit | None:
    if len(raw) < 9 or raw[:3] != b"\0\0\1" or 9 + raw[8] > len(raw):
        faults["pes"] += 1
        return None
    length = struct.unpack_from(">H", raw, 4)[0]
    data = raw[9 + raw[8] : 6 + length if length else None]
    if length and len(raw) < 6 + length:
        faults["pes"] += 1
    flags = raw[7] >> 6
    pts = _ticks(raw[9:14]) if flags & 2 and raw[8] >= 5 else None
    dts = _ticks(raw[14:19]) if flags == 3 and raw[8] >= 10 else pts
    return Unit(pid, pts, dts, packet, mark, data)


def demultiplex(media: bytes) -> Parsed:
    """Tables, units and faults of a transport stream; damaged parts are counted, not raised."""
    found, maps, last = Parsed(), set(), {}
    open_units: dict[int, list] = {}

    def close(pid: int) -> None:
        if entry := open_units.pop(pid, None):
            unit = _unit(pid, entry[0], entry[1], b"".join(entry[2]), found.faults)
            if unit:
                found.units.append(unit)

    for number, begin in enumerate(range(0, len(media), PACKET)):
        packet = media[begin : begin + PACKET]
        if len(packet) < PACKET or packet[0] != SYNC:
            found.faults["sync"] += 1
            continue
        found.packets += 1
        head, control = packet[1] << 8 | packet[2], packet[3]
        pid, start = head & 0x1FFF, bool(head & 0x4000)
        if pid == NULL_PID or control & 0xC0:
            found.faults["scrambled"] += bool(control & 0xC0)
            continue
        at, mark, restarted = 4, False, False
        if control & 0x20:
            if packet[4]:
                mark, restarted = bool(packet[5] & 0x40), bool(packet[5] & 0x80)
            at += 1 + packet[4]
        if not control & 0x10 or at >= PACKET:
            continue
        counter = control & 15
        if pid in last and not restarted:
            if last[pid] == (counter, packet):
                found.faults["repeated"] += 1
                continue
            if counter != last[pid][0] + 1 & 15:
                found.faults["gap"] += 1
        last[pid] = (counter, packet)
        if pid == PAT_PID and start:
            if (table := _read_table(packet, at, found.faults)) and table[0] == 0x00:
                maps |= {p & 0x1FFF for n, p in struct.iter_unpack(">HH", table[1]) if n}
        elif pid in maps and start:
            if (table := _read_table(packet, at, found.faults)) and table[0] == 0x02:
                body = table[1]
                pos = 4 + (struct.unpack_from(">H", body, 2)[0] & 0x0FFF)
                while pos + 5 <= len(body):
                    kind, stream, info = struct.unpack_from(">BHH", body, pos)
                    found.streams[stream & 0x1FFF] = kind
                    pos += 5 + (info & 0x0FFF)
        elif pid in found.streams:
            if start:
                close(pid)
                open_units[pid] = [number, mark, [packet[at:]]]
            elif pid in open_units:
                open_units[pid][2].append(packet[at:])
    for pid in list(open_units):
        close(pid)
    found.units.sort(key=lambda u: u.packet)
    return found


def padded(text: str) -> bytes:
    """UTF-8 with zero bytes up to a positive multiple of `PAD_TO`."""
    raw = text.encode("utf-8")
    return raw + b"\0" * (max(1, -(-len(raw) // PAD_TO)) * PAD_TO - len(raw))


def to_streams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media (one transport stream) of every row; a null text counts as empty."""

    def write(batches):
        for batch in batches:
            rows = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(t.encode("utf-8")) for t in rows], pa.int64()),
                    pa.array([multiplex(padded(t)) for t in rows], pa.binary()),
                ],
                names=["doc_id", "n_bytes", "media"],
            )

    return texts(docs, id_col, text_col).mapInArrow(write, "doc_id long, n_bytes long, media binary")


FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, n_packets long, n_units long, n_faults long, "
    "random_access array<struct<pts: long, packet: long>>"
)


def stream_features(media: DataFrame) -> DataFrame:
    """What parsing each stored stream gives: payload digests, unit counts, random-access points.

    `feature` sums up the stream: packets, units, last timestamp, marks, and the shares of
    bytes in eight ranges of values.
    """
    names = [part.split(" ")[0] for part in FEATURES.split(", ")[:11]] + ["random_access"]
    points = pa.list_(pa.struct([("pts", pa.int64()), ("packet", pa.int64())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), points]

    def read(batches):
        import numpy as np

        for batch in batches:
            rows = []
            for doc_id, n_bytes, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media"))):
                found = demultiplex(raw)
                payload = b"".join([u.data for u in found.units])
                marks = [{"pts": u.pts, "packet": u.packet} for u in found.units if u.random_access]
                shares = np.bincount(np.frombuffer(payload, np.uint8) >> 5, minlength=8) * 1000 // max(1, len(payload))
                last = max((u.pts or 0 for u in found.units), default=0)
                feature = f"p{found.packets}u{len(found.units)}t{last}r{len(marks)}h" + ".".join(map(str, shares))
                rows.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD_TO:]), len(raw), hashlib.sha256(raw).hexdigest(), feature, found.packets, len(found.units), sum(found.faults.values()), marks))
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return media.mapInArrow(read, FEATURES)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as a transport stream, read the stored bytes back, return their features.

    One row for each row of `docs`: null and empty texts are 64 zero bytes, repeated rows
    repeat, further columns are ignored. Nothing is shuffled or collected.
    """
    return stream_features(stored(to_streams(docs, id_col, text_col)))
