"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model trained on trusted text.

The model is over UTF-8 bytes, ``ORDER`` at a time, after one normalisation: in a run of equal words the
second to the ninth become bytes of their own that UTF-8 can't hold, which trusted text hardly has. Counts of all trusted text are summed in shards by gram; continuation counts,
discounts and the probabilities of each order are joins and sums over those shards, for the grams that occur anywhere.

Texts are scored in blocks of about ``BLOCK_CHARS``: the distinct grams of a block are joined with the sharded
probabilities and return to it, so that neither model nor corpus is ever whole in one place. A block's texts and its
grams are made by two passes over the same input splits; a block's number holds a digest of its texts, so that blocks
that were cut differently would not meet, which is an error.

A text's score is its perplexity per byte, with ``PRIOR_BYTES`` of average trusted text added, so that very short texts
aren't judged by a few bytes. It is rejected if its score is beyond its language's ``QUANTILE`` among
trusted texts that the counts don't include (a fourth of them, by a hash of the id), and a margin: ``MARGIN`` at ``LEAST``
texts, as the quantile of few texts is little more than their greatest score, and less with the root of their number; a language with fewer than ``LEAST`` such texts takes the
quantile over all languages.

Defined results: a null text is empty; an empty text has no perplexity and is rejected; a null language is a language;
trusted is an id whose labels are all positive; rows repeated with their id and text have the same result; without
trusted text nothing but empty text is rejected; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import checkpoint, prepare, slices, texts, tidy, trim

ORDER, BLOCK_CHARS, QUANTILE, LEAST, FOLDS = 5, 16 << 20, 0.995, 50, 4
#: Bytes of texts whose grams are in memory at once: an array over them takes eight times as much.
CHUNK_BYTES = 1 << 20
#: Scored grams that are packed together on their way back.
SHARD_ROWS = 2_000_000
MARGIN = 0.1
#: Bytes that UTF-8 never holds: for the second to the ninth of a run of equal words, and for the start of a text.
MARKS, START = [bytes([0xF7 + i]) for i in range(9)], b"\xc0"
#: Bytes of average trusted text that every text is taken to have besides its own, so that a few bytes decide nothing.
PRIOR_BYTES = 48
#: Trusted ids are broadcast up to so many, else joined by a shuffle.
BROADCAST_IDS = 1_000_000


def normalised(text: str) -> bytes:
    words = text.encode().split(b" ")
    out, before, run = [], None, 0
    for w in words:
        if w == before and w:
            run = min(run + 1, 8)
            out.append(MARKS[run])
        else:
            out.append(w)
            before, run = w, 0
    return b" ".join(out)


def grams(batch: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The grams of the texts, one for each byte, and how many each text has."""
    raw = [normalised(t) if t else b"" for t in batch]
    lengths = np.array([len(x) for x in raw], np.int64)
    pad = START * (order - 1)
    data = np.frombuffer(b"".join(pad + x for x in raw), np.uint8).astype(np.int64)
    if not len(data):
        return np.empty(0, np.int64), lengths
    out = np.zeros(max(0, len(data) - order + 1), np.int64)
    for j in range(order):
        out = out << 8 | data[j : len(data) - order + 1 + j]
    own = np.ones(len(data), bool)
    starts = np.concatenate(([0], np.cumsum(lengths + order - 1)))[:-1]
    for j in range(order - 1):
        own[starts + j] = False
    return out[own[order - 1 :]], lengths


def _blocks(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[int, pa.Table]]:
    """(block, rows): cut by the texts' lengths in the order of rows, whatever the batches are."""
    number, held, size = TaskContext.get().partitionId() << 12, [], 0
    for b in batches:
        at = 0
        for i, t in enumerate(texts(b.column(text_at))):
            size += len(t)
            if size >= BLOCK_CHARS:
                held.append(b.slice(at, i + 1 - at))
                t = pa.Table.from_batches(held)
                yield number << 32 | _digest(t, text_at), t
                number, held, size, at = number + 1, [], 0, i + 1
        if at < b.num_rows:
            held.append(b.slice(at))
    if held:
        t = pa.Table.from_batches(held)
        yield number << 32 | _digest(t, text_at), t


def _digest(t: pa.Table, text_at: int) -> int:
    c = 0
    for x in t.column(text_at).to_pylist():
        c = zlib.crc32((x or "")[:64].encode(), c + len(x or "") & 0xFFFFFFFF)
    return c


def _chunks(t: pa.Table, at: int) -> Iterator[list[str]]:
    """A column's texts, few enough at a time that the arrays over their bytes stay small."""
    for b in slices(iter(t.combine_chunks().to_batches()), CHUNK_BYTES):
        yield texts(b.column(at))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 8 << 20):
        parts = [np.unique(grams(x)[0], return_counts=True) for x in _chunks(pa.Table.from_batches([b]), 0)]
        found, place = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
        n = np.bincount(place, np.concatenate([c for _, c in parts])).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["g", "c"])


def _block_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    for block, t in _blocks(batches, 0):
        found = np.unique(np.concatenate([np.unique(grams(x)[0]) for x in _chunks(t, 0)]))
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([pack(np.diff(found, prepend=0).tobytes())], pa.binary())], ["block", "grams"])


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for b in batches:
        for block, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            found = np.cumsum(np.frombuffer(unpack(packed), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), block)), pa.array(found)], ["block", "g"])


def _pack_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, g, lp) rows of a shard to a packed row per block and so many rows."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        block, g, lp = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(3))
        order = np.lexsort((g, block))
        block, g, lp = block[order], g[order], lp[order]
        starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        parts = list(zip(starts.tolist(), [*starts[1:].tolist(), len(block)], strict=True))
        return pa.RecordBatch.from_arrays([pa.array(block[starts]), pa.array([pack(np.diff(g[a:z], prepend=0).tobytes()) for a, z in parts], pa.binary()), pa.array([pack(lp[a:z].tobytes()) for a, z in parts], pa.binary())], ["block", "g", "lp"])

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= SHARD_ROWS:
            yield packed(held)
            held, n = [], 0
    if n:
        yield packed(held)


def _payload(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    pack = zstandard.ZstdCompressor(level=5).compress
    for block, t in _blocks(batches, 3):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema) as w:
            w.write_table(t)
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([pack(sink.getvalue())], pa.binary())], ["block", "rows"])


def _score(left: pa.Table, right: pa.Table) -> pa.Table:
    """A block's rows with those of its grams."""
    try:
        return _scored_block(left, right)
    finally:
        trim()


def _scored_block(left: pa.Table, right: pa.Table) -> pa.Table:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    keys = np.concatenate([np.cumsum(np.frombuffer(unpack(x), np.int64)) for x in right["g"].to_pylist()] or [np.empty(0, np.int64)])
    logs = np.concatenate([np.frombuffer(unpack(x), np.float32) for x in right["lp"].to_pylist()] or [np.empty(0, np.float32)])
    order = np.argsort(keys)
    keys, logs = keys[order], logs[order].astype(np.float64)
    out = []
    for packed in left["rows"].to_pylist():
        t = pa.ipc.open_stream(unpack(packed)).read_all()
        sums, counts = [], []
        for part in _chunks(t, 3):
            found, n = grams(part)
            if len(found) and not len(keys):
                raise RuntimeError("two passes over the input cut different blocks; checkpoint the input first")
            ends = np.cumsum(n)
            total = np.concatenate(([0.0], np.cumsum(logs[np.searchsorted(keys, found)] if len(found) else np.empty(0))))
            sums.append(total[ends] - total[ends - n])
            counts.append(n)
        sums, counts = np.concatenate(sums), np.concatenate(counts)
        perplexity = pa.array(np.exp(-sums / np.maximum(counts, 1)), mask=counts == 0)
        out.append(pa.table([t.column(0), t.column(1), t.column(2), pa.array(counts), perplexity], names=["doc_id", "lang", "k", "n_bytes", "perplexity"]))
    none = pa.table([pa.array([], k) for k in (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64())], names=["doc_id", "lang", "k", "n_bytes", "perplexity"])
    if not out and len(keys):
        raise RuntimeError("two passes over the input cut different blocks; checkpoint the input first")
    return pa.concat_tables(out) if out else none


def _low(n: int) -> int:
    return (1 << 8 * n) - 1


def discounts(counted: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the counts of counts."""
    found = {r.c: r.n for r in counted.where("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()}
    n1, n2, n3, n4 = (found.get(i, 0) for i in range(1, 5))
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))


def probabilities(counts: DataFrame, needed: DataFrame, order: int = ORDER) -> DataFrame:
    """(g, p) of every needed gram (g), from the highest order's counts (g, c): each order is a join with the one below."""
    tables = {order: counts}
    for n in range(order - 1, 0, -1):
        tables[n] = checkpoint(tables[n + 1].groupBy(F.col("g").bitwiseAND(F.lit(_low(n))).alias("g")).agg(F.count("*").alias("c")))
    lower = None
    for n in range(1, order + 1):
        d1, d2, d3 = discounts(tables[n])
        reserved = F.sum(F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3))
        context = tables[n].groupBy(F.shiftright("g", 8).alias("ctx")).agg(F.sum("c").alias("total"), reserved.alias("reserved"))
        here = needed if n == order else needed.select(F.col("g").bitwiseAND(F.lit(_low(n))).alias("g")).distinct()
        here = here.join(tables[n], "g", "left").withColumn("ctx", F.shiftright("g", 8)).join(context, "ctx", "left")
        if lower is None:
            here = here.withColumn("q", F.lit(1 / 256))
        else:
            here = here.withColumn("tail", F.col("g").bitwiseAND(F.lit(_low(n - 1)))).join(lower.select(F.col("g").alias("tail"), F.col("p").alias("q")), "tail")
        count = F.coalesce("c", F.lit(0))
        spared = F.when(count == 0, 0.0).when(count == 1, d1).when(count == 2, d2).otherwise(d3)
        lower = here.select("g", F.when(F.col("total").isNull(), F.col("q")).otherwise((count - spared) / F.col("total") + F.col("reserved") / F.col("total") * F.col("q")).alias("p"))
    return lower


def _stable(docs: DataFrame) -> DataFrame:
    """docs if two passes over it surely cut the same partitions: a plain scan of files."""
    plan = docs._jdf.queryExecution().executedPlan().toString()
    plain = "FileScan" in plan and not any(x in plan for x in ("Exchange", "Join", "Aggregate", "Union", "Python", "Arrow", "AdaptiveSparkPlan"))
    return docs if plain else checkpoint(docs)


def _trusted(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    return labels.select(F.col(id_col).alias("t"), F.col(label_col).alias("y")).where("t is not null and y is not null").groupBy("t").agg(F.min("y").alias("y")).where("y > 0").select("t", (F.pmod(F.crc32(F.col("t").cast("string")), F.lit(FOLDS)) == 0).alias("held"))


def scored(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality", quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, k (the text's hash), n_bytes, perplexity, score, threshold, rejected: a row per row of docs."""
    prepare(docs.sparkSession)
    docs = _stable(docs)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text).alias("k"), text.alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    trusted = checkpoint(_trusted(labels, id_col, label_col))
    few = (lambda x: F.broadcast(x)) if trusted.count() <= BROADCAST_IDS else (lambda x: x)
    fitting = own.join(few(trusted.where("not held").select(F.col("t").alias("doc_id"))), "doc_id", "left_semi").select("text")
    counts = checkpoint(fitting.mapInArrow(tidy(_count), "g bigint, c bigint").groupBy("g").agg(F.sum("c").alias("c")))
    blocks = checkpoint(own.select("text").mapInArrow(tidy(_block_grams), "block bigint, grams binary"))
    found = blocks.mapInArrow(tidy(_unpack), "block bigint, g bigint")
    needed = checkpoint(found.select("g").distinct())
    logs = probabilities(counts, needed).select("g", F.log("p").cast("float").alias("lp"))
    back = found.join(logs, "g").select("block", "g", "lp").mapInArrow(tidy(_pack_scores), "block bigint, g binary, lp binary")
    payload = own.mapInArrow(tidy(_payload), "block bigint, rows binary")
    result = checkpoint(payload.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_score, f"doc_id {kind}, lang string, k bigint, n_bytes bigint, perplexity double"))
    held = result.join(few(trusted.where("held").select(F.col("t").alias("doc_id"))), "doc_id", "left_semi").where("perplexity is not null")
    usual = held.agg(F.sum(F.log("perplexity") * F.col("n_bytes")) / F.sum("n_bytes")).first()[0] or 0.0
    result = result.withColumn("score", F.exp((F.log("perplexity") * F.col("n_bytes") + PRIOR_BYTES * usual) / (F.col("n_bytes") + PRIOR_BYTES)))
    calibration = result.join(few(trusted.where("held").select(F.col("t").alias("doc_id"))), "doc_id", "left_semi").where("perplexity is not null")
    at = F.percentile_approx("score", quantile, 10_000).alias("threshold")
    every, n = calibration.agg(at, F.count("*")).first()
    margin = lambda n: 1 + MARGIN * F.sqrt(F.lit(LEAST) / n)
    bars = calibration.groupBy("lang").agg(at, F.count("*").alias("n")).where(F.col("n") >= LEAST).select(F.col("lang").alias("l"), (F.col("threshold") * margin(F.col("n"))).alias("threshold"))
    result = result.join(F.broadcast(bars) if bars.count() <= 10_000 else bars, F.col("lang").eqNullSafe(F.col("l")), "left").drop("l")
    result = result.withColumn("threshold", F.coalesce("threshold", F.lit(math.inf) if every is None else every * margin(F.lit(n))))
    return result.withColumn("rejected", F.coalesce(F.col("score") > F.col("threshold"), F.lit(True)))


def digest(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    return scored(docs, labels, **columns).select("doc_id", "lang", "n_bytes", F.round("perplexity", 4).alias("perplexity"), F.round("score", 4).alias("score"), F.round("threshold", 4).alias("threshold"), "rejected")


def keep(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality", quantile: float = QUANTILE) -> DataFrame:
    """The rows of docs that aren't rejected, with all their columns."""
    found = scored(docs, labels, id_col=id_col, text_col=text_col, lang_col=lang_col, label_col=label_col, quantile=quantile)
    gone = found.where("rejected").select(F.col("doc_id").alias("__id"), F.col("k").alias("__k"))
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.join(gone, docs[id_col].eqNullSafe(gone["__id"]) & (F.xxhash64(text) == gone["__k"]), "left_anti")
