"""Packing by lexical retrieval: a sharded BM25 inverted index returns a seed's unused neighbours, which fill its window.

Documents are encoded once; with them come each id's document frequency over the whole corpus and a route, the two least
hashes among a document's ids, so that documents which share ids, whatever file they are in, come close together in the
order of routes. That order is cut into shards of at most ``SHARD_TOKENS`` ids and ``SHARD_DOCS`` documents. A shard has an
inverted index over its ids, weighted by the corpus' frequencies and mean length, and every id of a seed is a query term:
the ids that many of the shard's documents have are scored by one matrix product, the others by their postings.

A window takes its seed (the rest of the document cut by the window before, else the shard's first unused one), then the
unused neighbours by falling BM25 score, then unused documents in order; the last one is cut where the window ends and
seeds the next. A shard's last window goes on in the next shard, so only a task's last window has padding.

Neighbours come from the seed's shard alone: a search of the whole corpus for every seed grows with its square.

Defined results: a null text is empty, and an empty one still has its end id; repeated rows are packed as often as they
occur; ties go to the earlier document; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import checkpoint, prepare, slices, tidy
from quarrylight.llm.tokens import encoder

WINDOW, END, SHARD_TOKENS, SHARD_DOCS, K1, B = 2048, 1, 1 << 22, 2048, 1.2, 0.75
#: An id is common in a shard if this part of its documents, and at least so many, have it.
COMMON, LEAST_COMMON = 1 / 16, 16
#: Neighbours that are put in order at once.
NEXT = 64


class Corpus:
    """What BM25 knows of all documents: how many there are, their mean length, and how many have each id."""

    def __init__(self, n: int, mean_length: float, df: np.ndarray):
        self.n, self.mean_length, self.df = n, max(1.0, mean_length), df

    @classmethod
    def of(cls, docs: list[np.ndarray]) -> "Corpus":
        terms = np.concatenate([np.unique(x) for x in docs]) if docs else np.empty(0, np.uint32)
        return cls(len(docs), float(np.mean([len(x) for x in docs])) if docs else 1.0, np.bincount(terms, minlength=1))


class Index:
    """BM25 inverted index of a shard's documents, given as arrays of ids."""

    def __init__(self, docs: list[np.ndarray], corpus: Corpus | None = None, k1: float = K1, b: float = B):
        corpus = corpus or Corpus.of(docs)
        n = self.n = len(docs)
        found = [np.unique(x, return_counts=True) for x in docs]
        sizes = np.array([len(t) for t, _ in found], np.int64)
        terms = np.concatenate([t for t, _ in found]).astype(np.int64) if n else np.empty(0, np.int64)
        tf = np.concatenate([c for _, c in found]).astype(np.float32) if n else np.empty(0, np.float32)
        owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
        here = np.bincount(terms, minlength=1)
        every = np.maximum(here, np.pad(corpus.df, (0, max(0, len(here) - len(corpus.df))))[: len(here)])
        idf = np.log1p((max(corpus.n, n) - every + 0.5) / (every + 0.5))
        length = np.array([len(x) for x in docs], np.float32)
        norm = k1 * (1 - b + b * length / corpus.mean_length)
        weight = (idf[terms] * tf * (k1 + 1) / (tf + norm[owner])).astype(np.float32)
        common = here >= max(LEAST_COMMON, n * COMMON)
        place = np.cumsum(common) - 1
        of_common = common[terms]
        dense = np.zeros((n, int(common.sum())), np.float32)
        dense[owner[of_common], place[terms[of_common]]] = weight[of_common]
        self.common = (dense > 0).astype(np.float32) @ dense.T
        rare = ~of_common & (here[terms] > 1)
        terms, owner, weight = terms[rare], owner[rare], weight[rare]
        order = np.argsort(terms, kind="stable")
        self.owner, self.weight = owner[order], weight[order]
        self.begin = np.concatenate(([0], np.cumsum(np.bincount(terms, minlength=len(here)))))
        self.terms, self.at = terms, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n))))

    def scores(self, seed: int) -> np.ndarray:
        """Of each document, for a query of all the seed's ids."""
        own = self.terms[self.at[seed] : self.at[seed + 1]]
        out = self.common[seed].astype(np.float64)
        if len(own):
            spans = [slice(a, z) for a, z in zip(self.begin[own].tolist(), self.begin[own + 1].tolist(), strict=True)]
            out += np.bincount(np.concatenate([self.owner[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), minlength=self.n)
        return out

    def neighbours(self, seed: int, used: np.ndarray) -> Iterator[int]:
        """Unused documents that share an id with the seed, best first, ties by number."""
        score = self.scores(seed).round(3)
        score[used] = 0
        score[seed] = 0
        rest = np.flatnonzero(score)
        while len(rest):
            best = score[rest]
            bar = np.partition(best, len(best) - NEXT)[len(best) - NEXT] if len(best) > NEXT else 0
            now = rest[best >= bar]
            yield from now[np.lexsort((now, -score[now]))].tolist()
            rest = rest[best < bar]


def pack(docs: list[np.ndarray], index: Index | None = None, window: int = WINDOW, sequence: int = 0, room: int | None = None) -> tuple[list[tuple[int, int, int, int, int]], int, int]:
    """((document, start, length, sequence, offset) of each piece, the open sequence and its room), going on in an open one."""
    index, room = index or Index(docs), window if room is None else room
    used, first, out = np.zeros(len(docs), bool), 0, []
    queue: Iterator[int] | None = None
    seed = current = -1
    at = 0
    while True:
        if current < 0:
            if room < window and queue is None and seed >= 0:
                queue = index.neighbours(seed, used)
            current = next((x for x in queue if not used[x]), -1) if queue is not None else -1
            while current < 0 and first < len(docs):
                if not used[first]:
                    current = first
                first += 1
            if current < 0:
                return out, sequence, room
            used[current], at = True, 0
        if room == window:
            seed, queue = current, None
        size = min(room, len(docs[current]) - at)
        out.append((current, at, size, sequence, window - room))
        at, room = at + size, room - size
        if at == len(docs[current]):
            current = -1
        if not room:
            sequence, room, queue, seed = sequence + 1, window, None, -1


def route(ids: np.ndarray) -> tuple[int, int]:
    """The two least hashes among distinct ids: documents that share most of their ids mostly share them."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h = (h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(1)
    h = np.sort(np.partition(h, 1)[:2] if len(h) > 2 else h).astype(np.int64)
    return int(h[0]), int(h[-1])


def encoded(rows: DataFrame, tokenizer: str | None, end_id: int) -> DataFrame:
    """rows(doc_id, text) as (doc_id, ids, n, near, next), and with term and df how many documents of a task have an id."""
    import zstandard

    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "ids", "n", "near", "next", "term", "df"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        shrink = zstandard.ZstdCompressor(level=1).compress
        df, type_ = np.zeros(1 << 16, np.int64), None
        for b in slices(batches, 4 << 20):
            type_ = b.column(0).type
            ids = [np.frombuffer(x + end, "<u4") for x in enc.encode(b.column(1))]
            distinct = [np.unique(x) for x in ids]
            routes = [route(x) for x in distinct]
            for seen in distinct:
                if seen[-1] >= len(df):
                    df = np.pad(df, (0, int(seen[-1]) + 1 - len(df)))
                df[seen] += 1
            # half the bytes where every id fits
            small = [shrink(x.astype("<u2").tobytes() + b"\0") if x.max() < 65536 else shrink(x.tobytes()) for x in ids]
            none = pa.nulls(len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(small, pa.binary()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x for x, _ in routes], pa.int64()), pa.array([x for _, x in routes], pa.int64()), none, none], names)
        terms = np.flatnonzero(df)
        if type_ is not None:
            none = pa.nulls(len(terms), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(terms), type_), pa.nulls(len(terms), pa.binary()), none, none, none, pa.array(terms), pa.array(df[terms])], names)

    return rows.mapInArrow(tidy(run), f"doc_id {kind}, ids binary, n bigint, near bigint, next bigint, term bigint, df bigint")


def _ids(packed: bytes, unpack) -> bytes:
    raw = unpack(packed)
    return np.frombuffer(raw[:-1], "<u2").astype("<u4").tobytes() if len(raw) % 2 else raw


def packed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, window: int = WINDOW, end_id: int = END, shard_tokens: int = SHARD_TOKENS, shard_docs: int = SHARD_DOCS, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with_ids the ids themselves.

    sequence_id holds the task's number in its upper bits.
    """
    import zstandard

    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    stored = checkpoint(encoded(rows, tokenizer, end_id))
    own = stored.where("term is null").select("doc_id", "ids", "n", "near", "next")
    n_docs, n_ids = own.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # a number for each id of the vocabulary
    counts = stored.where("term is not null").groupBy("term").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(max((r.term for r in counts), default=0) + 1, np.int64)
    for r in counts:
        df[r.term] = r.df
    shared = docs.sparkSession.sparkContext.broadcast(Corpus(n_docs, n_ids / max(1, n_docs), df))
    parts = max(1, -(-n_ids // shard_tokens))
    # the last key tells rows apart that are equal in all others, so that no group of copies is one task
    keys = ["near", "next", F.xxhash64("ids"), F.col("doc_id"), F.col("__row")]
    near = own.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("doc_id", "ids", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus, unpack = shared.value, zstandard.ZstdDecompressor().decompress
        base, sequence, room = TaskContext.get().partitionId() << 36, 0, window
        keys: list[pa.Array] = []
        shard: list[bytes] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, room, held
            arrays = [np.frombuffer(x, "<u4") for x in shard]
            pieces, sequence, room = pack(arrays, Index(arrays, corpus), window, sequence, room)
            owner = pa.array([x[0] for x in pieces], pa.int64())
            number = pa.array([base + x[3] for x in pieces], pa.int64())
            cut = [shard[d][4 * s : 4 * (s + n)] for d, s, n, _, _ in pieces]
            columns = [pa.concat_arrays(keys).take(owner), pa.array([x[1] for x in pieces], pa.int64()), pa.array([x[2] for x in pieces], pa.int64()), pa.array([zlib.crc32(x) for x in cut], pa.int64()), pa.array([len(arrays[x[0]]) for x in pieces], pa.int64()), number, pa.array([x[4] for x in pieces], pa.int64()), *[pa.array(cut, pa.binary())] * with_ids]
            keys.clear(), shard.clear()
            held = 0
            yield from slices(iter([pa.RecordBatch.from_arrays(columns, names)]), 8 << 20)

        for b in slices(batches, 2 << 20):
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                keys.append(part.column(0))
                shard += [_ids(x, unpack) for x in part.column(1).to_pylist()]
                held += sum(part.column(2).to_pylist())
                if held >= shard_tokens or len(shard) >= shard_docs:
                    yield from flush()
        if shard:
            yield from flush()

    kind = rows.schema["doc_id"].dataType.simpleString()
    return near.mapInArrow(tidy(run), f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids binary" * with_ids)
