"""Nearest neighbours (exact, and an inverted file of centroids), quality checks, merges and near pairs of vectors."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import StructType

from quarrylight.functions import vectors as V
from quarrylight.session import checkpoint, ship


def nearest(store: DataFrame, query: list[float], top_k: int, *, key: str = "key", vec: str = "vec", kernel: bool = False) -> DataFrame:
    """Exact (key, similarity): a scan and a bounded top-k, ties by key. Vectors of other dimensions don't take part."""
    rows = store.where(F.size(vec) == len(query))
    similarity = V.cosine_to(query)(F.col(vec)) if kernel else V.cosine(F.col(vec), V.literal(query))
    return rows.select(F.col(key).alias("key"), similarity.alias("similarity")).orderBy(F.desc("similarity"), "key").limit(top_k)


def similarity_of(store: DataFrame, query: list[float], keys: list, *, key: str = "key", vec: str = "vec") -> DataFrame:
    """Cosine for given keys, 0 for a missing one."""
    asked = store.sparkSession.createDataFrame([(k,) for k in keys], f"key {store.schema[key].dataType.simpleString()}")
    rows = store.select(F.col(key).alias("key"), V.cosine(F.col(vec), V.literal(query)).alias("s"))
    return asked.join(rows, "key", "left").select("key", F.coalesce("s", F.lit(0.0)).alias("similarity"))


#: The part of the nearest vectors that an index should find.
RECALL = 0.95


class CentroidIndex:
    """An inverted file: k-means centroids fitted on a bounded sample; every vector is assigned to its nearest one.

    The sample bounds the fit only; all vectors of the first one's dimensions are indexed. There are about as many lists as
    a list has vectors, so both grow with the root of the store. A query reads the ``probes`` lists nearest to it, where
    it isn't said as many as hold ``RECALL`` of the sample's own neighbours, and ranks them exactly. Written partitioned by ``list``, a query prunes the rest.
    """

    def __init__(self, store: DataFrame, *, key: str = "key", vec: str = "vec", lists: int | None = None, sample: int = 20_000, rounds: int = 10):
        dims = inferred_dim(store, key=key, vec=vec)
        rows = store.where(F.size(vec) == dims).select(F.col(key).alias("key"), F.col(vec).alias("vec"))
        lists = lists or max(16, min(4096, math.isqrt(rows.count())))
        m = np.array([r.vec for r in rows.orderBy(F.xxhash64("key"), "key").limit(sample).collect()], np.float64).reshape(-1, dims)
        m /= np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-12)
        centres = m[:: max(1, len(m) // lists)][:lists].copy() if len(m) else np.zeros((1, dims))
        for _ in range(rounds):
            own = (m @ centres.T).argmax(1)
            for i in range(len(centres)):
                if (own == i).any():
                    c = m[own == i].sum(0)
                    centres[i] = c / max(float(np.sqrt(c @ c)), 1e-12)
        self.centres = centres
        self.probes = self._enough(m)

        @F.pandas_udf("int")
        def place(vectors: pd.Series) -> pd.Series:
            return pd.Series((np.stack(vectors.to_list()).astype(np.float64) @ centres.T).argmax(1).astype(np.int32))

        self.assigned = rows.withColumn("list", place("vec"))

    def _enough(self, sample: np.ndarray, asked: int = 200, top: int = 10) -> int:
        """How many lists of a vector hold its nearest ones of the sample, but for a small part."""
        if len(sample) < 2:
            return 1
        some = sample[:: max(1, len(sample) // asked)]
        lists = (sample @ self.centres.T).argmax(1)
        near = np.argsort(-(some @ sample.T), 1, kind="stable")[:, 1 : top + 1]
        rank = np.argsort(np.argsort(-(some @ self.centres.T), 1, kind="stable"), 1)
        return int(np.quantile(np.take_along_axis(rank, lists[near], 1), RECALL, method="higher")) + 1

    def search(self, query: list[float], top_k: int, probes: int | None = None, kernel: bool = True) -> DataFrame:
        if len(query) != self.centres.shape[1]:
            return nearest(self.assigned.where(F.lit(False)), query, top_k)
        probes = probes or self.probes
        near = np.argsort(-(self.centres @ np.asarray(query, np.float64)), kind="stable")[:probes].tolist()
        return nearest(self.assigned.where(F.col("list").isin(*near)), query, top_k, kernel=kernel)


def quality(store: DataFrame, expected_dim: int, *, key: str = "key", vec: str = "vec") -> DataFrame:
    """(key, kind): dim_mismatch, non_finite (and then nothing else), zero, duplicate (equal after normalisation)."""
    v = F.col(vec)
    broken = F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    state = F.when(F.size(v) != expected_dim, "dim_mismatch").when(broken, "non_finite").when(V.norm(v) < 1e-6, "zero").otherwise("good")
    rows = store.select(F.col(key).alias("key"), v.alias("vec"), state.alias("kind"))
    bad = rows.where("kind <> 'good'").select("key", "kind")
    good = rows.where("kind = 'good'").select("key", F.xxhash64(F.transform(V.normalised(F.col("vec")), lambda x: F.round(x, 9))).alias("h"))
    again = good.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    return bad.unionByName(good.join(again, "h", "left_semi").select("key", F.lit("duplicate").alias("kind")))


def inferred_dim(store: DataFrame, *, key: str = "key", vec: str = "vec") -> int:
    row = store.where(F.size(vec) > 0).select(F.min_by(F.size(vec), F.col(key))).first()
    return row[0] or 0


def weighted_mean(rows: DataFrame, group: str, vec: str, weight: str) -> DataFrame:
    """(group, vec): the weighted mean of each group's vectors, position by position, null for one of mixed dimensions.

    Each task first sums what it holds, so that a row per group and task is sent, whatever the groups' sizes.
    """
    import pyarrow as pa

    ship(rows.sparkSession)
    kind = rows.schema[group].dataType.simpleString()
    own = rows.where(F.col(vec).isNotNull()).select(F.col(group).alias("g"), F.transform(vec, lambda x: x.cast("double")).alias("v"), F.col(weight).cast("double").alias("w"))

    def summed(batches):
        held: dict = {}
        for b in batches:
            keys = b.column(0).to_pylist()
            flat, ends = b.column(1).flatten().to_numpy(zero_copy_only=False), np.asarray(b.column(1).offsets) - b.column(1).offsets[0].as_py()
            for i, (k, w) in enumerate(zip(keys, b.column(2).to_pylist(), strict=True)):
                v = flat[ends[i] : ends[i + 1]]
                at = (k, len(v))
                old = held.get(at)
                if old is None:
                    held[at] = [v * w, w]
                else:
                    old[0] += v * w
                    old[1] += w
            if len(held) >= 4096:
                yield batch(held)
                held = {}
        if held:
            yield batch(held)

    def batch(held):
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], key_type), pa.array([x.tolist() for x, _ in held.values()], pa.list_(pa.float64())), pa.array([w for _, w in held.values()], pa.float64())], ["g", "s", "w"])

    key_type = to_arrow_type(own.schema["g"].dataType)
    parts = own.mapInArrow(summed, f"g {kind}, s array<double>, w double")
    sums = parts.groupBy("g").agg(F.collect_list(F.struct("s", "w")).alias("x"), F.min(F.size("s")).alias("lo"), F.max(F.size("s")).alias("hi"))
    total = F.aggregate("x", F.array_repeat(F.lit(0.0), F.col("hi")), lambda a, x: F.zip_with(a, x["s"], lambda p, q: p + q))
    weights = F.aggregate("x", F.lit(0.0), lambda a, x: a + x["w"])
    return sums.select(F.col("g").alias(group), F.when(F.col("lo") == F.col("hi"), F.transform(total, lambda x: x / weights)).alias("vec"))


def _block(key: str, n: int):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(n)).cast("int")


def blocks(store: DataFrame, *, key: str = "key", vec: str = "vec", carry: DataFrame | None = None, block: int = 4096) -> DataFrame:
    """(block, dims, keys, vecs, carried): about ``block`` vectors of a length in a row, dealt by a hash of the key; shuffled
    and stored once.

    carry(key, carried), a row a key at most, is what near pairs are to have of their lesser key.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    ship(store.sparkSession)
    n = max(1, -(-store.count() // block))
    parts = min(n, max(32, -(-n // 4)))
    rows = store.where(F.size(vec) > 0).select(F.col(key).alias("key"), F.col(vec).alias("vec"), _block(key, n).alias("block"), F.size(vec).alias("dims")).repartition(parts, "block")
    kind = rows.schema["key"].dataType.simpleString()
    carried = carry.schema["carried"].dataType.simpleString() if carry is not None else "boolean"

    def pack(t: pa.Table, held: pa.Table | None = None) -> pa.Table:
        out = []
        for dims in pc.unique(t["dims"]).to_pylist():
            own = t.filter(pc.equal(t["dims"], dims))
            keys, flat = own["key"].combine_chunks(), own["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            raw = flat.astype(np.float32 if flat.dtype == np.float32 else np.float64, copy=False).tobytes()
            more = pa.nulls(len(keys), pa.bool_()) if held is None else held["carried"].combine_chunks().take(pc.index_in(keys, value_set=held["key"].combine_chunks()))
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            out.append(pa.table([pa.array([own["block"][0].as_py()], pa.int32()), pa.array([dims], pa.int32()), one(keys), pa.array([raw], pa.binary()), one(more)], names=["block", "dims", "keys", "vecs", "carried"]))
        return pa.concat_tables(out) if out else none

    schema = f"block int, dims int, keys array<{kind}>, vecs binary, carried array<{carried}>"
    none = to_arrow_schema(StructType.fromDDL(schema)).empty_table()
    if carry is None:
        packed = rows.groupBy("block").applyInArrow(lambda t: pack(t), schema)  # of two parameters the first would be the key
    else:
        held = carry.select(F.col("key").cast(kind), F.col("carried").cast(carried), _block("key", n).alias("block")).repartition(parts, "block")
        packed = rows.groupBy("block").cogroup(held.groupBy("block")).applyInArrow(pack, schema)
    return checkpoint(packed.coalesce(parts))  # a product has the square of the partitions as tasks, whatever a session makes of their number


def _unit(raw: bytes, n: int, dims: int) -> np.ndarray:
    m = np.frombuffer(raw, np.float32 if len(raw) == 4 * n * dims else np.float64).reshape(n, dims).astype(np.float64)
    return m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-300)


def _met(left: DataFrame, right: DataFrame, threshold: float, meet, ordered: bool, tile: int = 256) -> DataFrame:
    """(a, b, similarity, carried) of the rows of blocks that meet. Each pair of blocks is a row of a product that is not
    shuffled, so the disk grows with the vectors and not with their pairs; a task holds a tile of the product at a time."""
    import pyarrow as pa
    import pyarrow.compute as pc

    names = ("block", "dims", "keys", "vecs", "carried")
    kinds = [left.schema[c].dataType.elementType for c in ("keys", "carried")]
    one, two = (x.select(*(F.col(c).alias(f"{side}_{c}") for c in names)) for x, side in ((left, "l"), (right, "r")))

    def run(batches):
        for batch in batches:
            column = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            for at in range(batch.num_rows):
                block, dims, keys, vecs, carried = ([column[f"{side}_{c}"][at] for side in "lr"] for c in names)
                if dims[0].as_py() != dims[1].as_py():
                    continue
                p, q = (_unit(v.as_py(), len(k), d.as_py()) for v, k, d in zip(vecs, keys, dims, strict=True))
                same = ordered and block[0].as_py() == block[1].as_py()
                for start in range(0, len(p), tile):
                    s = (p[start : start + tile] @ q.T).ravel()
                    hit = np.flatnonzero(s >= threshold)
                    i, j = (pa.array(x) for x in (hit // len(q) + start, hit % len(q)))
                    a, b, ca, cb = keys[0].values.take(i), keys[1].values.take(j), carried[0].values.take(i), carried[1].values.take(j)
                    less = pc.less(a, b)
                    c = pc.if_else(less, ca, cb)
                    found = pa.record_batch([pc.if_else(less, a, b), pc.if_else(less, b, a), pa.array(s[hit]), c] if ordered else [a, b, pa.array(s[hit]), c], names=["a", "b", "similarity", "carried"])
                    yield found.filter(less if same else pc.not_equal(a, b)) if ordered else found

    pairs = one.join(two.hint("shuffle_replicate_nl"), meet)
    key, carried = (k.simpleString() for k in kinds)
    return pairs.mapInArrow(run, f"a {key}, b {key}, similarity double, carried {carried}")


def pairs_within(own: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity, carried) of all pairs a < b of the vectors of blocks() at or above the threshold."""
    p, q = F.col("l_block"), F.col("r_block")
    even = (p + q) % 2 == 0  # deals both halves of the square to all tasks
    return _met(own, own, threshold, (even & (p <= q)) | (~even & (p > q)), True)


def pairs_across(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity, carried) of all pairs of a vector of left's blocks() and one of right's at or above the threshold."""
    return _met(left, right, threshold, F.lit(True), False)


def near_pairs(store: DataFrame, threshold: float, *, key: str = "key", vec: str = "vec", block: int = 4096) -> DataFrame:
    """(a, b, similarity) of all pairs a < b at or above the threshold: exact, so each block of vectors meets every other."""
    return pairs_within(blocks(store, key=key, vec=vec, block=block), threshold).drop("carried")


def near_between(left: DataFrame, right: DataFrame, threshold: float, *, key: str = "key", vec: str = "vec", block: int = 4096) -> DataFrame:
    """(a, b, similarity) of all pairs of a row of left and a row of right at or above the threshold, block by block."""
    return pairs_across(*(blocks(x, key=key, vec=vec, block=block) for x in (left, right)), threshold).drop("carried")
