"""Media columns: MPEG transport streams of 188-byte packets.

``mux`` stores a payload as access units in elementary packets with timestamps, behind program tables; ``parse`` reads
any stream: it follows the program tables, checks continuity counters, reassembles the elementary packets and returns
their timestamps and random-access points. Both work on whole streams with array operations, a stream at a time.

Defined results: a null text is empty; an empty text is one padding block; a null or broken stream parses to no
program, with its count of sync, continuity and table errors; equal bytes give equal values; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarrylight.llm.common import prepare, slices, texts

PACKET, BLOCK = 188, 192
PMT_PID, MEDIA_PID, STREAM_TYPE, STREAM_ID = 0x1000, 0x0100, 0x06, 0xBD
#: Bytes of an access unit, ticks of the 90 kHz clock between two, units from one random-access point to the next.
UNIT, TICKS, RANDOM_ACCESS = 40 * BLOCK, 3600, 8


def _table_crc(n: int) -> int:
    n <<= 24
    for _ in range(8):
        n = (n << 1) ^ (0x104C11DB7 if n & 0x80000000 else 0)
    return n & 0xFFFFFFFF


CRC = [_table_crc(i) for i in range(256)]


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, key: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + key.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([0x47]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + section).ljust(PACKET, b"\xff")


READ = "ts_programs int, ts_streams array<struct<pid:int,type:int>>, ts_payload binary, ts_pts array<bigint>, ts_random_access array<int>, ts_errors int, ts_feature string"
TABLES = _table_packet(0, _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID, _section(2, 1, (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00")
)


def _pts_bytes(pts: np.ndarray) -> np.ndarray:
    p = pts.astype(np.int64) & ((1 << 33) - 1)
    return np.stack([0x21 | (p >> 30 << 1), p >> 22 & 0xFF, 1 | (p >> 15 & 0x7F) << 1, p >> 7 & 0xFF, 1 | (p & 0x7F) << 1], 1).astype(np.uint8)


def _units(samples: np.ndarray, first: int, counter: int) -> np.ndarray:
    """Packets of equally long access units, a row each; first is the first unit's number, counter its continuity counter."""
    n, size = samples.shape
    number = np.arange(first, first + n)
    pes = np.empty((n, 14 + size), np.uint8)
    pes[:, :9] = np.frombuffer(b"\x00\x00\x01" + bytes([STREAM_ID]) + (8 + size).to_bytes(2, "big") + b"\x80\x80\x05", np.uint8)
    pes[:, 9:14] = _pts_bytes(number * TICKS)
    pes[:, 14:] = samples
    more = max(0, 14 + size - 176)
    packets, rest = 1 + -(-more // 184), more % 184
    out = np.full((n, packets, PACKET), 0xFF, np.uint8)
    out[:, :, 0], out[:, :, 1], out[:, :, 2] = 0x47, MEDIA_PID >> 8, MEDIA_PID & 0xFF
    out[:, 0, 1] |= 0x40
    out[:, :, 3] = 0x10 | (counter + np.arange(n * packets).reshape(n, packets)) % 16
    head = min(176, 14 + size)
    out[:, 0, 3] |= 0x20
    out[:, 0, 4] = 183 - head
    out[:, 0, 5] = np.where(number % RANDOM_ACCESS == 0, 0x50, 0x10)
    base = (number * TICKS).astype(np.int64)
    out[:, 0, 6:12] = np.stack([base >> 25 & 0xFF, base >> 17 & 0xFF, base >> 9 & 0xFF, base >> 1 & 0xFF, (base & 1) << 7 | 0x7E, base * 0], 1)
    out[:, 0, PACKET - head :] = pes[:, :head]
    full = more // 184
    out[:, 1 : 1 + full, 4:] = pes[:, head : head + 184 * full].reshape(n, full, 184)
    if rest:
        out[:, -1, 3] |= 0x20
        out[:, -1, 4] = 183 - rest
        if rest < 183:
            out[:, -1, 5] = 0
        out[:, -1, PACKET - rest :] = pes[:, 14 + size - rest :]
    return out.reshape(-1, PACKET)


def mux(payload: bytes) -> bytes:
    """A transport stream that holds payload in one elementary stream of timestamped access units."""
    data = np.frombuffer(payload, np.uint8)
    full = len(data) // UNIT
    parts = [TABLES]
    packets = _units(data[: full * UNIT].reshape(full, UNIT), 0, 0) if full else np.empty((0, PACKET), np.uint8)
    parts.append(packets.tobytes())
    if len(data) > full * UNIT:
        parts.append(_units(data[None, full * UNIT :], full, len(packets) % 16).tobytes())
    return b"".join(parts)


def _sections(packets: np.ndarray) -> bytes:
    """The first section carried by a table's packets."""
    out = b""
    for p in packets:
        at = 4 + (1 + int(p[4]) if p[3] & 0x20 else 0)
        if p[1] & 0x40:
            if out:
                break
            at += 1 + int(p[at]) if at < PACKET else 0
        elif not out:
            continue
        out += p[at:].tobytes()
    if len(out) < 12:
        return b""
    size = 3 + (int.from_bytes(out[1:3], "big") & 0xFFF)
    return out[:size] if 12 <= size <= len(out) and crc32_mpeg(out[:size]) == 0 else b""


def parse(stream: bytes | None) -> dict:
    """programs, streams [(pid, type)], payload of the first stream, pts, random_access (unit numbers), and error counts."""
    out: dict = {"programs": 0, "streams": [], "payload": b"", "pts": [], "random_access": [], "sync_errors": 0, "continuity_errors": 0, "table_errors": 0, "packets": 0}
    raw = np.frombuffer(stream or b"", np.uint8)
    out["sync_errors"] += int(len(raw) % PACKET > 0)
    packets = raw[: len(raw) // PACKET * PACKET].reshape(-1, PACKET)
    good = packets[:, 0] == 0x47
    out["packets"], out["sync_errors"] = len(packets), out["sync_errors"] + int((~good).sum())
    if not good.all():
        packets = packets[good]
    pid = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    pat = _sections(packets[pid == 0])
    if not pat or pat[0] != 0:
        out["table_errors"] += 1
        return out
    programs = [(int.from_bytes(pat[i : i + 2], "big"), int.from_bytes(pat[i + 2 : i + 4], "big") & 0x1FFF) for i in range(8, len(pat) - 4, 4)]
    out["programs"] = sum(n > 0 for n, _ in programs)
    for _, where in (x for x in programs if x[0]):
        pmt = _sections(packets[pid == where])
        if not pmt or pmt[0] != 2:
            out["table_errors"] += 1
            continue
        at = 12 + (int.from_bytes(pmt[10:12], "big") & 0xFFF)
        while at + 5 <= len(pmt) - 4:
            out["streams"].append((int.from_bytes(pmt[at + 1 : at + 3], "big") & 0x1FFF, pmt[at]))
            at += 5 + (int.from_bytes(pmt[at + 3 : at + 5], "big") & 0xFFF)
    if not out["streams"]:
        return out
    own = packets[pid == out["streams"][0][0]]
    own = own[(own[:, 3] & 0x10) > 0]
    if not len(own):
        return out
    counter = own[:, 3].astype(np.int32) & 0xF
    step = np.diff(counter) % 16
    again = np.concatenate(([False], (step == 0) & (own[1:] == own[:-1]).all(1))) if (step == 0).any() else np.zeros(len(own), bool)
    out["continuity_errors"] = int(((step != 1) & ~again[1:]).sum())
    if again.any():
        own = own[~again]
    adapted = (own[:, 3] & 0x20) > 0
    offset = np.where(adapted, 5 + own[:, 4].astype(np.int32), 4).clip(4, PACKET)
    starts = (own[:, 1] & 0x40) > 0
    marked = starts & adapted & (own[:, 4] > 0) & ((own[:, 5] & 0x40) > 0)
    data = own[np.arange(PACKET) >= offset[:, None]]
    ends = np.cumsum(PACKET - offset)
    firsts = np.flatnonzero(starts)
    begins = np.concatenate(([0], ends))[firsts]
    raw_bytes = data.tobytes()
    parts = []
    for k, (a, b) in enumerate(zip(begins.tolist(), [*begins[1:].tolist(), len(raw_bytes)], strict=True)):
        head = raw_bytes[a : a + 14]
        if head[:3] != b"\x00\x00\x01" or len(head) < 9:
            out["table_errors"] += 1
            continue
        size = int.from_bytes(head[4:6], "big")
        if head[7] & 0x80 and len(head) == 14:
            out["pts"].append((head[9] >> 1 & 7) << 30 | head[10] << 22 | (head[11] >> 1) << 15 | head[12] << 7 | head[13] >> 1)
        if marked[firsts[k]]:
            out["random_access"].append(k)
        parts.append(raw_bytes[a + 9 + head[8] : min(b, a + 6 + size) if size else b])
    out["payload"] = b"".join(parts)
    return out


def feature(read: dict) -> str:
    """Packets, units, random-access points, last timestamp, errors, then sum, sum of squares, least and greatest sample."""
    x = np.frombuffer(read["payload"], np.uint8)
    squares = int((np.bincount(x, minlength=256) * np.arange(256, dtype=np.int64) ** 2).sum())
    errors = read["sync_errors"] + read["continuity_errors"] + read["table_errors"]
    return f"ts:{read['packets']}:{len(read['pts'])}:{len(read['random_access'])}:{read['pts'][-1] if read['pts'] else -1}:{errors}|u8:{int(x.sum())}:{squares}:{int(x.min()) if len(x) else 0}:{int(x.max()) if len(x) else 0}"


def payload_of(text: str) -> tuple[bytes, int]:
    raw = text.encode()
    size = max(BLOCK, -(-len(raw) // BLOCK) * BLOCK)
    return raw.ljust(size, b" "), len(raw)


def store(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: each text as a transport stream."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4 << 20):
            stored = [payload_of(t) for t in texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for _, n in stored], pa.int64()), pa.array([mux(p) for p, _ in stored], pa.binary())], ["doc_id", "n_bytes", "media"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, media binary")


def read(media: DataFrame, *, media_col: str = "media") -> DataFrame:
    """media with the columns of READ: what each stream holds."""
    prepare(media.sparkSession)
    at = media.columns.index(media_col)
    schema = StructType([*media.schema.fields, *StructType.fromDDL(READ).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.struct([("pid", pa.int32()), ("type", pa.int32())])
        for b in slices(batches, 4 << 20):
            found = [parse(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([x["programs"] for x in found], pa.int32()), pa.array([[{"pid": p, "type": t} for p, t in x["streams"]] for x in found], pa.list_(pair)), pa.array([x["payload"] for x in found], pa.binary()), pa.array([x["pts"] for x in found], pa.list_(pa.int64())), pa.array([x["random_access"] for x in found], pa.list_(pa.int32())), pa.array([x["sync_errors"] + x["continuity_errors"] + x["table_errors"] for x in found], pa.int32()), pa.array([feature(x) for x in found])],
                [f.name for f in schema],
            )

    return media.mapInArrow(run, schema)


def digest(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored, read back and described: one pass, so that streams never leave the worker that made them."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4 << 20):
            out = []
            for text in texts(b.column(1)):
                stored, n = payload_of(text)
                media = mux(stored)
                back = parse(media)
                payload = back["payload"]
                out.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(back)))
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
