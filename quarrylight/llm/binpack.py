"""Token-id output packed best fit decreasing, with a segment tree over the rooms left that finds the tightest window.

A document longer than a window is split losslessly: full windows first, its rest is packed with the others. Each input
split is packed by itself in shards of about ``shard_tokens`` ids, so nothing is shuffled and memory is bounded.

A row per window: ``ids`` (the row of the id matrix, little-endian, padded), ``positions`` (unsigned 16-bit, starting
again at 0 in every segment; 32-bit if the window is longer than 65,536), ``cu_seqlens`` (0, then the ends of the
segments), and which document and start each segment has.

Defined results: a null text is empty and holds only the end id; repeated rows are packed as often as they occur; equal
lengths keep the input's order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import prepare, slices, tidy
from quarrylight.llm.tokens import encoder

WINDOW, END, PAD, SHARD_TOKENS = 2048, 1, 0, 1 << 22


class Rooms:
    """Open windows by the room they have left. Node i of the tree is set if a room in its range has a window."""

    def __init__(self, capacity: int):
        self.half = 1 << capacity.bit_length()
        self.tree = bytearray(2 * self.half)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, window: int) -> None:
        self.open[room].append(window)
        i = room + self.half
        while i and not self.tree[i]:
            self.tree[i] = 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, window) with the least room of at least need, which is no longer open; None if there is none."""
        i = need + self.half
        while not self.tree[i]:
            while i & 1:
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.half:
            i = 2 * i if self.tree[2 * i] else 2 * i + 1
        room = i - self.half
        window = self.open[room].pop()
        if not self.open[room]:
            while i and not (i < self.half and (self.tree[2 * i] or self.tree[2 * i + 1])):
                self.tree[i] = 0
                i >>= 1
        return room, window


def best_fit(lengths: list[int], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """The (document, start, length) segments of each window."""
    out: list[list[tuple[int, int, int]]] = []
    rests = []
    for d, n in enumerate(lengths):
        full = n // window
        out += [[(d, k * window, window)] for k in range(full)]
        if n % window:
            rests.append((n % window, d, full * window))
    rooms = Rooms(window)
    for n, d, start in sorted(rests, key=lambda x: -x[0]):
        room, k = rooms.take(n) or (window, len(out))
        if k == len(out):
            out.append([])
        out[k].append((d, start, n))
        if room > n:
            rooms.add(room - n, k)
    return out


def packed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, window: int = WINDOW, end_id: int = END, pad_id: int = PAD, id_bytes: int = 2, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """A row per window. id_bytes: 2 if the vocabulary is below 65,536 ids, else 4."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        base = TaskContext.get().partitionId() << 36
        most = (1 << 8 * id_bytes) - 1
        wide, count = f"<u{id_bytes}", np.arange(window, dtype="<u2" if window <= 65536 else "<u4")
        keys: list[pa.Array] = []
        shard: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal base, held
            windows = best_fit([len(x) for x in shard], window)
            owners = pa.concat_arrays(keys)
            for a in range(0, len(windows), 512):
                part = windows[a : a + 512]
                ids = np.full((len(part), window), pad_id, wide)
                positions = np.zeros((len(part), window), count.dtype)
                ends = []
                for r, segments in enumerate(part):
                    at = 0
                    ends.append([0])
                    for d, s, n in segments:
                        ids[r, at : at + n] = shard[d][s : s + n]
                        positions[r, at : at + n] = count[:n]
                        at += n
                        ends[-1].append(at)
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in part]))), pa.int32())
                flat = [x for segments in part for x in segments]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(base + a, base + a + len(part)), pa.int64()), pa.array([x[-1] for x in ends], pa.int32()), pa.ListArray.from_arrays(offsets, owners.take(pa.array([x[0] for x in flat], pa.int64()))), pa.ListArray.from_arrays(offsets, pa.array([x[1] for x in flat], pa.int64())), pa.array(ends, pa.list_(pa.int32())), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([x.tobytes() for x in positions], pa.binary()), pa.array([zlib.crc32(x) for x in ids], pa.int64())],
                    ["sequence_id", "n_tokens", "doc_ids", "starts", "cu_seqlens", "ids", "positions", "ids_crc32"],
                )
            base += len(windows)
            keys.clear(), shard.clear()
            held = 0

        for b in slices(batches, 4 << 20):
            keys.append(b.column(0))
            new = [np.frombuffer(x + end, "<u4") for x in enc.encode(b.column(1))]
            if most < 1 << 32 and any(x.max() > most for x in new):
                raise ValueError(f"an id doesn't fit into id_bytes={id_bytes}; take 4")
            shard += new
            held += sum(map(len, new))
            if held >= shard_tokens:
                yield from flush()
        if shard:
            yield from flush()

    return rows.mapInArrow(tidy(run), f"sequence_id bigint, n_tokens int, doc_ids array<{kind}>, starts array<bigint>, cu_seqlens array<int>, ids binary, positions binary, ids_crc32 bigint")
