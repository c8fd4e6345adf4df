"""Embedders: a protocol, a deterministic hashing one that needs no model, and chunked embedding of long texts."""

from __future__ import annotations

import time
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarrylight.functions.text import tokens_of
from quarrylight.session import ship

CHUNK_BYTES = 2000


class Embedder(Protocol):
    dims: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """Signed hashed token counts, of unit length: equal texts have equal vectors everywhere."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dims), np.float64)
        for i, t in enumerate(texts):
            for w in tokens_of(t):
                h = zlib.crc32(w.encode())
                out[i, h % self.dims] += 1 if h >> 31 else -1
        length = np.sqrt((out * out).sum(1, keepdims=True))
        return (out / np.where(length > 0, length, 1)).astype(np.float32).tolist()


class ContextLengthError(ValueError):
    """An embedder's answer to a text, or to a batch, that is too long for it."""


class PatientEmbedder:
    """Another embedder, asked in batches: a batch that is too long is halved, a text alone is shortened and asked again.

    After ``retries`` shortenings, or beyond the deadline, the error is passed on. It is pickled with the one it asks.
    """

    def __init__(self, inner: Embedder, *, batch: int = 50, shrink: float = 0.75, retries: int = 15, deadline_s: float = 300.0):
        self.inner, self.dims, self.batch, self.shrink, self.retries, self.deadline_s = inner, inner.dims, batch, shrink, retries, deadline_s

    def embed(self, texts: list[str]) -> list[list[float]]:
        end = time.monotonic() + self.deadline_s
        return [v for at in range(0, len(texts), self.batch) for v in self._asked(texts[at : at + self.batch], end)]

    def _asked(self, texts: list[str], end: float) -> list[list[float]]:
        if time.monotonic() > end:
            raise TimeoutError(f"no vectors after {self.deadline_s:g} s")
        try:
            return self.inner.embed(texts)
        except ContextLengthError:
            if len(texts) > 1:
                half = len(texts) // 2
                return [*self._asked(texts[:half], end), *self._asked(texts[half:], end)]
        return [self._shortened(texts[0], end)]

    def _shortened(self, text: str, end: float) -> list[float]:
        for k in range(1, self.retries + 1):
            text = text[: max(1, int(len(text) * self.shrink))]
            if time.monotonic() > end:
                raise TimeoutError(f"no vectors after {self.deadline_s:g} s")
            try:
                return self.inner.embed([text])[0]
            except ContextLengthError:
                if k == self.retries:
                    raise
        raise AssertionError


class RememberingEmbedder:
    """Another embedder with the vectors of single texts, as queries are, kept: the ``most`` used last."""

    def __init__(self, inner: Embedder, known: dict[str, list[float]] | None = None, most: int = 10_000):
        self.inner, self.dims, self.most, self.known = inner, inner.dims, most, OrderedDict(known or {})

    def embed(self, texts: list[str]) -> list[list[float]]:
        if len(texts) != 1:
            return self.inner.embed(texts)
        if texts[0] not in self.known:
            self.known[texts[0]] = self.inner.embed(texts)[0]
        self.known.move_to_end(texts[0])
        while len(self.known) > self.most:
            self.known.popitem(last=False)
        return [self.known[texts[0]]]


def chunks_of(text: str, limit: int = CHUNK_BYTES) -> list[str]:
    """Pieces of at most ``limit`` bytes, cut between characters."""
    raw, out, at = text.encode(), [], 0
    while at < len(raw):
        end = min(len(raw), at + limit)
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        end = end if end > at else min(len(raw), at + limit)
        out.append(raw[at:end].decode("utf-8", "ignore"))
        at = end
    return out or [""]


def chunks(content: DataFrame, *, key: str = "path", text: str = "content", limit: int = CHUNK_BYTES) -> DataFrame:
    """chunks(key, chunk_idx, chunk, hash)."""
    ship(content.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut = [chunks_of(t or "", limit) for t in b.column(1).to_pylist()]
            take = pa.array([i for i, c in enumerate(cut) for _ in c], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), pa.array([k for c in cut for k in range(len(c))], pa.int32()), pa.array([x for c in cut for x in c], pa.string())], ["key", "chunk_idx", "chunk"])

    kind = content.schema[key].dataType.simpleString()
    return content.select(F.col(key).alias("key"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"key {kind}, chunk_idx int, chunk string").withColumn("hash", F.sha2("chunk", 256))


def embedded(rows: DataFrame, embedder: Embedder, *, text: str = "chunk", out: str = "vec", budget_s: float | None = None) -> DataFrame:
    """rows with a vector column, a batch at a time.

    With a budget a task that has used it up, or whose embedder fails, leaves the rest without a vector: these rows are
    searched by their words, and embedded when the index is next brought up to date.
    """
    ship(rows.sparkSession)
    at, schema = rows.columns.index(text), StructType([*rows.schema.fields, *StructType.fromDDL(f"{out} array<float>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, spent = time.monotonic() + (budget_s or 0), False
        for b in batches:
            spent = spent or budget_s is not None and time.monotonic() >= end
            try:
                vectors = [None] * b.num_rows if spent else embedder.embed([t or "" for t in b.column(at).to_pylist()])
            except (OSError, TimeoutError):
                if budget_s is None:
                    raise
                vectors, spent = [None] * b.num_rows, True
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float32()))], [f.name for f in schema])

    return rows.mapInArrow(run, schema)


def embedded_long(content: DataFrame, embedder: Embedder, *, key: str = "path", text: str = "content", budget_s: float | None = None) -> DataFrame:
    """(key, vec): the mean of a text's chunk vectors, weighted by their bytes; none of a text that the budget left out."""
    from quarrylight.operators.vectors import weighted_mean

    parts = embedded(chunks(content, key=key, text=text), embedder, budget_s=budget_s).withColumn("w", F.greatest(F.octet_length("chunk"), F.lit(1)))
    return weighted_mean(parts, "key", "vec", "w")
