"""SimHash near-duplicates by a binary trie self-join.

A text is lower-cased (A-Z), cut into words at ASCII white space, and its ``shingle``-word shingles (all of them; a text
of fewer words is one shingle) are hashed with XXH64, seed 42. A bit of the fingerprint is 1 if set in over half of the
hashes. Fingerprints link when at most ``budget`` bits differ.

Equal fingerprints are grouped first, so that copies meet only once. The fingerprints are then dealt by pigeonhole: of
``blocks`` bit blocks any linked pair agrees in at least ``agree`` ones, so they meet in the bucket of some such choice.
A bucket is a subtree whose top bits agree; in it the trie is joined with itself, node pairs go down together with the
bits that differ so far, and a pair is pruned beyond the budget. A bucket gives only a spanning forest of its links,
never its pairs. Buckets above ``hot`` fingerprints are dealt once more by the bits outside of their key, in which the
same pigeonhole holds. Links become components by distributed stars; nothing of the documents meets in the driver.

With a ``similarity`` representatives() takes a link for what it is only after comparing the sets of shingles: texts of
equal sets are a class, classes meet in the buckets of ``BANDS`` min-hash bands of ``ROWS`` rows, and the trie of a
bucket's fingerprints is joined with itself at a budget of ``WIDE`` bits; of the pairs it leaves those are compared whose
sizes and parities (see parity(); a bound, never an estimate) allow the similarity. Only a Jaccard similarity of at least
``similarity`` links such a pair. A class first meets its nearest lesser one, then ``GROWTH`` times as many each round;
subtrees whose classes are linked already aren't compared again, nor are pairs, and the rounds end when no pair is left,
so no bucket has a cap. The classes of crowded buckets first meet the least one of their largest, without being gathered; what that links is then
dealt over blocks, and the rest is copied to each of them.

Defined results: null or empty text, and text of white space only, has fingerprint 0 and links like any other; repeated
rows and equal texts are one component; a null doc_id is never a component_id unless all of its component are null; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import SALTS, checkpoint, few, join_hot, prepare, slices, texts, tidy
from quarrylight.llm.components import components

SHINGLE, BUDGET, HOT, LEAF = 3, 2, 100_000, 48
#: Two texts of Jaccard similarity 0.8 miss each other in all bands with a chance of 2 in 10,000; about 10 of their bits differ.
BANDS, ROWS, WIDE, GROWTH = 16, 4, 24, 16
#: Bits of a parity for each shingle at least, and bytes of parities that are compared at once.
PARITY, GAP_BYTES = 2, 16 << 20
#: Classes of a bucket that meet in one task, and a block of a crowded bucket.
CROWD = 1024
#: (blocks, agree) by budget: blocks - budget blocks at least are equal.
DEAL = {0: (1, 1), 1: (2, 1), 2: (3, 1), 3: (5, 2), 4: (6, 2), 5: (7, 2), 6: (8, 2), 7: (9, 2), 8: (10, 2)}


def shingles(text: str, size: int) -> list[bytes]:
    words = text.encode().lower().split()
    joined = b" ".join(words)
    if len(words) <= size:
        return [joined] if words else []
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    return [joined[a:b] for a, b in zip([0, *(e + 1 for e in ends)], ends[size - 1 :], strict=False)]


def _hashes(found: list[bytes]) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(x, 42) for x in found), np.uint64, len(found))


def _majority(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[a : a + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str, size: int = SHINGLE) -> int:
    return _majority(_hashes(shingles(text, size)))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (as a signed long), text_hash."""
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 8 << 20):
            found = np.array([fingerprint(t, shingle) for t in texts(b.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64)), b.column(2)], ["doc_id", "fp", "text_hash"])

    return rows.mapInArrow(tidy(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp bigint, text_hash bigint")


def masks(budget: int, bits: list[int] | None = None) -> list[int]:
    """Bit masks of the buckets' keys over the given bits (all 64): a pair within the budget agrees on one of them."""
    bits = list(range(64)) if bits is None else bits
    blocks, agree = DEAL[budget]
    parts = [sum(1 << int(x) for x in p) for p in np.array_split(np.array(bits), blocks)]
    return [sum(c) for c in combinations(parts, agree)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def trie_blocks(values: np.ndarray, budget: int, kinds: np.ndarray | None = None) -> Iterator[tuple[int, int, int, int]]:
    """Pairs of small ranges (a, b), (c, d) of the sorted fingerprints in which pairs within the budget may be.

    A node is a range of them with a common prefix; the first bit in which its ends differ is where it branches. Two
    nodes go down together, and are pruned when the bits that surely differ are beyond the budget, or when all their
    values are of one kind.
    """
    plain = values.tolist()
    turns = None if kinds is None else np.concatenate(([0], np.cumsum(kinds[1:] != kinds[:-1]))).tolist()

    def depth(a: int, b: int) -> int:
        return 64 - (plain[a] ^ plain[b - 1]).bit_length()

    def halves(a: int, b: int) -> tuple[tuple[int, int], tuple[int, int]]:
        at = 63 - depth(a, b)
        middle = a + int(np.searchsorted(values[a:b], np.uint64((plain[b - 1] >> at) << at))) if at >= 0 else (a + b) // 2
        return (a, middle), (middle, b)

    def alike(a: int, b: int, c: int, d: int) -> bool:
        return turns is not None and turns[a] == turns[b - 1] and turns[c] == turns[d - 1] and kinds[a] == kinds[c]

    stack = [((0, len(values)), (0, len(values)))]
    while stack:
        (a, b), (c, d) = stack.pop()
        if a == b or c == d or alike(a, b, c, d):
            continue
        if (a, b) == (c, d):
            if b - a <= 1:
                continue
            if b - a > LEAF:
                left, right = halves(a, b)
                stack += [(left, left), (right, right), (left, right)]
                continue
        else:
            known = min(depth(a, b), depth(c, d))
            if known and ((plain[a] ^ plain[c]) >> (64 - known)).bit_count() > budget:
                continue
            if (b - a) * (d - c) > LEAF * LEAF:
                if d - c == 1 or b - a > 1 and depth(a, b) <= depth(c, d):
                    stack += [(x, (c, d)) for x in halves(a, b)]
                else:
                    stack += [((a, b), x) for x in halves(c, d)]
                continue
        yield a, b, c, d


def trie_join(values: np.ndarray, budget: int) -> list[int]:
    """The least index linked to each of the sorted, distinct fingerprints."""
    forest = Forest(len(values))
    for a, b, c, d in trie_blocks(values, budget):
        near = np.bitwise_count(values[a:b, None] ^ values[None, c:d]) <= budget
        for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
            if a + i < c + j:
                forest.join(a + i, c + j)
    return [forest.root(i) for i in range(len(values))]


def _bucket_links(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray]] = []

        def links(values: np.ndarray) -> pa.RecordBatch:
            values = np.unique(values.view(np.uint64))
            root = np.array(trie_join(values, budget), np.int64)
            own = np.flatnonzero(root != np.arange(len(values)))
            return pa.RecordBatch.from_arrays([pa.array(values[own].view(np.int64)), pa.array(values[root[own]].view(np.int64))], ["u", "v"])

        for b in batches:
            m, k, fp = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(fp):
                continue
            cut = np.flatnonzero((m[1:] != m[:-1]) | (k[1:] != k[:-1])) + 1
            for a, z in zip([0, *cut.tolist()], [*cut.tolist(), len(fp)], strict=True):
                if held and (held[0][0], held[0][1]) != (m[a], k[a]):
                    if sum(len(x) for *_, x in held) > 1:
                        yield links(np.concatenate([x for *_, x in held]))
                    held.clear()
                held.append((m[a], k[a], fp[a:z]))
        if held and sum(len(x) for *_, x in held) > 1:
            yield links(np.concatenate([x for *_, x in held]))

    return run


def links(distinct: DataFrame, budget: int = BUDGET, hot: int = HOT) -> DataFrame:
    """(u, v): a spanning forest, bucket by bucket, of the links between distinct fingerprints fp."""
    own = masks(budget)
    dealt = distinct.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(_signed(x))).alias("k")) for i, x in enumerate(own)))).alias("x")).select("x.m", "x.k", "fp")
    crowded = checkpoint(dealt.groupBy("m", "k").count().where(F.col("count") > hot).select("m", "k"))
    if not crowded.isEmpty():
        finer = [(i, j, x | y) for i, x in enumerate(own) for j, y in enumerate(masks(budget, [b for b in range(64) if not x >> b & 1]))]
        again = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(1000 * (i + 1) + j).alias("m"), F.col("fp").bitwiseAND(F.lit(_signed(x))).alias("k")) for i, j, x in finer))
        split = dealt.join(crowded, ["m", "k"], "left_semi").select("fp", "m", F.explode(F.filter(again, lambda x: x.i == F.col("m"))).alias("x")).select("x.m", "x.k", "fp")
        dealt = dealt.join(crowded, ["m", "k"], "left_anti").unionByName(split)
    return dealt.repartition("m", "k").sortWithinPartitions("m", "k").mapInArrow(tidy(_bucket_links(budget)), "u bigint, v bigint")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, budget: int = BUDGET, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable), text_hash: a row per row of docs."""
    own = checkpoint(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle))
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(distinct.select("fp"), budget, hot))
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = checkpoint(join_hot(placed, least, "root").select("fp", "component_id"))
    return join_hot(own, classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_hash")


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """A 64-bit hash of each shingle, made of its words' hashes."""
    import xxhash

    words = text.encode().lower().split()
    numbers = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - size + 1) if words else 0
    h = np.zeros(n, np.uint64)
    for j in range(min(size, len(words))):
        h = (h ^ numbers[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(31))


def hashes_of(text: str, size: int) -> np.ndarray:
    """Sorted, distinct hashes of a text's shingles."""
    return np.unique(shingle_hashes(text, size))


@functools.cache
def _band_terms() -> np.ndarray:
    return np.random.default_rng(42).integers(0, 1 << 31, (2, BANDS * ROWS, 1)).astype(np.uint32) * np.uint32(2) + np.uint32(1)


def bands(hashes: np.ndarray) -> list[int]:
    """A key for each band: texts that share ``ROWS`` least hashes in a band share its key."""
    import xxhash

    factor, plus = _band_terms()
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    mixed = np.empty((BANDS * ROWS, 1024), np.uint32)
    for a in range(0, len(high), 1024):
        part = high[None, a : a + 1024]
        room = mixed[:, : part.shape[1]]
        np.multiply(factor, part, out=room)
        np.add(room, plus, out=room)
        np.minimum(least, room.min(1), out=least)
    return [xxhash.xxh64_intdigest(x.tobytes(), 42) for x in least.reshape(BANDS, ROWS)]


def parity(hashes: np.ndarray) -> bytes:
    """A bit for each remainder of the hashes by a power of two: whether an odd number of them has it.

    What two sets share cancels out, so their parities differ in at most as many bits as there are hashes in only one of
    the sets; xor of its halves is the parity of half as many remainders.
    """
    width = max(64, 1 << (PARITY * len(hashes) - 1).bit_length())
    counts = np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def parity_gaps(parities: list[bytes]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of two arrays of indexes: in how many bits these parities differ, pair by pair, at the lesser's width."""
    widths = np.array([len(x) for x in parities])
    levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    rows, folded, width = np.empty(0, np.int64), np.empty((0, int(widths.max()) // 4), np.uint64), int(widths.max())
    while width >= widths.min():
        own, half = np.flatnonzero(widths == width), width // 8
        new = np.frombuffer(b"".join(parities[i] for i in own), np.uint64).reshape(len(own), half)
        rows, folded = np.concatenate([rows, own]), np.concatenate([folded[:, :half] ^ folded[:, half:], new])
        place = np.zeros(len(parities), np.int64)
        place[rows] = np.arange(len(rows))
        levels[width] = folded, place
        width //= 2

    def gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out, lesser = np.zeros(len(x), np.int64), np.minimum(widths[x], widths[y])
        for width in np.unique(lesser).tolist():
            (values, place), at = levels[width], np.flatnonzero(lesser == width)
            step = max(1, GAP_BYTES // width)
            for i in (at[a : a + step] for a in range(0, len(at), step)):
                out[i] = np.bitwise_count(values[place[x[i]]] ^ values[place[y[i]]]).sum(1)
        return out

    return gaps


def _profiles(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """doc_id, text_hash, class (of equal shingle sets; 0 without shingles), fp, keys, size (of the set), parity."""
    import xxhash

    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 8 << 20):
            kinds, fps, keys, sizes, parities = [], [], [], [], []
            for t in texts(b.column(1)):
                every = shingle_hashes(t, shingle)
                own = np.unique(every)
                kinds.append(xxhash.xxh64_intdigest(own.tobytes(), 42) if len(own) else 0)
                fps.append(_majority(every))
                keys.append(np.array(bands(own) if len(own) else [], np.uint64).view(np.int64))
                sizes.append(len(own))
                parities.append(parity(own) if len(own) else b"")
            signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (kinds, fps)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *signed, pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int64()), pa.array(parities, pa.binary())], ["doc_id", "text_hash", "class", "fp", "keys", "size", "parity"])

    return rows.mapInArrow(tidy(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash bigint, class bigint, fp bigint, keys array<bigint>, size bigint, parity binary")


def bucket_pairs(fp: np.ndarray, root: np.ndarray, most: int, wide: int = WIDE, sizes: np.ndarray | None = None, parities: list[bytes] | None = None, similarity: float = 0) -> tuple[list[tuple[int, int]], bool]:
    """Pairs (greater, lesser index) of unequal roots within ``wide`` bits, of each row its nearest ``most``, and whether there are more.

    With the sizes and parities of their sets only pairs that these allow to be similar, the nearest by their parities.
    """
    order = np.lexsort((root, fp))
    values, kinds = fp[order], root[order]
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    gaps = None if parities is None else parity_gaps(parities)
    for a, b, c, d in trie_blocks(values, wide, kinds):
        apart = np.bitwise_count(values[a:b, None] ^ values[None, c:d])
        i, j = np.nonzero((apart <= wide) & (kinds[a:b, None] != kinds[None, c:d]))
        if (a, b) == (c, d):
            i, j = i[i < j], j[i < j]
        x, y, far = order[a + i], order[c + j], apart[i, j]
        if gaps is not None and len(x):
            near = np.minimum(sizes[x], sizes[y]) >= similarity * np.maximum(sizes[x], sizes[y]) - 1e-6
            x, y = x[near], y[near]
            gap, both = gaps(x, y), sizes[x] + sizes[y]
            near = (1 + similarity) * gap <= (1 - similarity) * both + 1e-6
            x, y, far = x[near], y[near], gap[near] / both[near]
        parts.append((x, y, far))
    if not parts:
        return [], False
    x, y, apart = (np.concatenate(p) for p in zip(*parts, strict=True))
    high, low = np.maximum(x, y), np.minimum(x, y)
    ranked = np.lexsort((low, apart, high))
    high, low = high[ranked], low[ranked]
    begins = np.concatenate(([True], high[1:] != high[:-1])) if len(high) else np.empty(0, bool)
    place = np.arange(len(high)) - np.maximum.accumulate(np.where(begins, np.arange(len(high)), 0))
    return list(zip(high[place < most].tolist(), low[place < most].tolist(), strict=True)), bool((place >= most).any())


def _candidates(buckets: DataFrame, most: int, similarity: float) -> DataFrame:
    """(m, k, block, u, v): a round's pairs, and a row without u and v for a block that has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[tuple[int, int, int], np.ndarray, list[bytes]]] = []

        def found() -> Iterator[pa.RecordBatch]:
            rows = np.concatenate([x for _, x, _ in held])
            if len(rows) < 2 or (rows[:, 2] == rows[0, 2]).all():
                return
            order = np.argsort(rows[:, 0], kind="stable")
            parities = [x for *_, part in held for x in part]
            rows, parities = rows[order], [parities[i] for i in order.tolist()]
            pairs, more = bucket_pairs(rows[:, 1].copy().view(np.uint64), rows[:, 2], most, WIDE, rows[:, 3], parities, similarity)
            u, v = rows[[i for i, _ in pairs], 0].tolist(), rows[[j for _, j in pairs], 0].tolist()
            if more:
                u, v = [*u, None], [*v, None]
            if u:
                m, k, block = held[0][0]
                yield pa.RecordBatch.from_arrays([pa.array([m] * len(u), pa.int32()), pa.array([k] * len(u), pa.int64()), pa.array([block] * len(u), pa.int32()), pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["m", "k", "block", "u", "v"])

        for b in batches:
            m, k, block, *rest = (b.column(i).to_numpy(zero_copy_only=False) for i in range(7))
            if not len(m):
                continue
            rows, parities = np.stack(rest, 1), b.column(7).to_pylist()
            cut = np.flatnonzero((m[1:] != m[:-1]) | (k[1:] != k[:-1]) | (block[1:] != block[:-1])) + 1
            for a, z in zip([0, *cut.tolist()], [*cut.tolist(), len(m)], strict=True):
                at = (int(m[a]), int(k[a]), int(block[a]))
                if held and held[0][0] != at:
                    yield from found()
                    held.clear()
                held.append((at, rows[a:z], parities[a:z]))
        if held:
            yield from found()

    sorted_rows = buckets.select("m", "k", "block", "class", "fp", "root", "size", "parity").repartition("m", "k", "block").sortWithinPartitions("m", "k", "block")
    return sorted_rows.mapInArrow(tidy(run), "m int, k bigint, block int, u bigint, v bigint")


def _sets(own: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(class, s): the sorted hashes of the classes' shingles. A class's text is met by its document, so copies aren't gathered."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    wanted = join_hot(own.select("class", "doc_id", "text_hash"), classes, "class").groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("d"), F.col("text_hash").alias("h"))).alias("x")).select("class", "x.d", "x.h")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    held = rows.join(wanted, rows["doc_id"].eqNullSafe(F.col("d")) & (F.xxhash64("t") == F.col("h"))).select("class", "t")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4 << 20):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([hashes_of(t, shingle).tobytes() for t in texts(b.column(1))], pa.binary())], ["class", "s"])

    return checkpoint(held.mapInArrow(tidy(sets), "class bigint, s binary").dropDuplicates(["class"]))


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) of classes whose sets of shingles are similar."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= similarity * max(len(x), len(y)) else 0
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    a, b = (sets.select(F.col("class").alias(n), F.col("s").alias(f"s{n}")) for n in "uv")
    return join_hot(pairs.join(a, "u"), b, "v").select("u", "v", "su", "sv").mapInArrow(tidy(compare), "u bigint, v bigint")


def _linked(roots: DataFrame | None, good: DataFrame) -> DataFrame:
    """(node, root) after more links: only the roots that these join are compared anew."""
    if roots is None:
        return checkpoint(components(good))
    at = lambda c: F.coalesce(F.col(f"r{c}"), F.col(c))
    known = [roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "uv"]
    links = good.join(known[0], "u", "left").join(known[1], "v", "left").select(at("u").alias("u"), at("v").alias("v"))
    moved = checkpoint(components(links))
    named = moved.select(F.col("node").alias("root"), F.col("root").alias("new"))
    old = roots.join(named, "root", "left").select("node", F.coalesce("new", "root").alias("root"))
    return checkpoint(old.unionByName(moved.join(roots.select("node"), "node", "left_anti")))


def _rooted(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """rows with the root of their class."""
    if roots is None:
        return rows.withColumn("root", F.col("class"))
    return rows.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))


def _met(rows: DataFrame, buckets: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with some buckets (m, k), which are crowded: by a broadcast if they are few, else by a part of rows each."""
    at = ["m", "k"]
    if few(buckets):
        return rows.join(F.broadcast(buckets), at, how)
    parts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return rows.withColumn("salt", F.pmod(F.xxhash64("class"), F.lit(SALTS)).cast("int")).join(buckets.withColumn("salt", parts), [*at, "salt"], how).drop("salt")


def _dealt(rows: DataFrame, crowded: DataFrame | None, roots: DataFrame | None, crowd: int) -> DataFrame:
    """rows with a block: one each for the buckets, several for the crowded ones.

    Of a crowded bucket the classes of its largest component are dealt over the blocks, and the others are in each.
    """
    if crowded is None:
        return rows.withColumn("block", F.lit(0))
    at = ["m", "k"]
    plain = _met(rows, crowded, "left_anti").withColumn("block", F.lit(0))
    hot = checkpoint(_rooted(_met(rows, crowded), roots))
    largest = hot.groupBy(*at, "root").count().groupBy(*at).agg(F.min_by("root", F.struct((-F.col("count")).alias("n"), "root")).alias("main"))
    spread = _met(hot, checkpoint(largest)).withColumn("blocks", F.ceil(F.col("n") / crowd).cast("int"))
    own = F.array(F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    everywhere = F.sequence(F.lit(0), F.col("blocks") - 1)
    return plain.unionByName(spread.withColumn("block", F.explode(F.when(F.col("root") == F.col("main"), own).otherwise(everywhere))).select(*plain.columns))


def verified_duplicates(docs: DataFrame, similarity: float, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, crowd: int = CROWD) -> DataFrame:
    """doc_id, component_id (least doc_id reachable by links of at least that similarity), text_hash: a row per row of docs."""
    own = checkpoint(_profiles(docs, id_col, text_col, shingle))
    distinct = checkpoint(own.groupBy("class").agg(F.min("doc_id").alias("first"), F.first("keys").alias("keys"), F.min("fp").alias("fp"), F.first("size").alias("size"), F.first("parity").alias("parity")))
    dealt = distinct.select("class", "fp", "size", "parity", F.posexplode("keys").alias("m", "k"))
    shared = checkpoint(dealt.groupBy("m", "k").agg(F.count("*").alias("n"), F.min("class").alias("centre")).where("n > 1"))
    crowded = shared.where(F.col("n") > crowd)
    some = not crowded.isEmpty()
    if not some:
        rows = dealt.join(shared.select("m", "k"), ["m", "k"], "left_semi")
    else:  # rows of crowded buckets are met where they are
        rest = _met(dealt, crowded.select("m", "k"), "left_anti").join(shared.where(F.col("n") <= crowd).select("m", "k"), ["m", "k"], "left_semi")
        rows = rest.unionByName(_met(dealt, crowded.select("m", "k"), "left_semi"))
    rows = checkpoint(rows.select("m", "k", "class", "fp", "size", "parity"))
    roots, compared = None, None
    if rows.isEmpty():
        sets = None
    else:
        sets = _sets(own, rows.select("class").distinct(), docs, id_col, text_col, shingle)
    if some:
        centres = crowded.select("m", "k", "n", "centre")
        largest = _met(rows, centres).groupBy("class").agg(F.min_by("centre", F.struct((-F.col("n")).alias("n"), "m", "k")).alias("v"))
        compared = checkpoint(largest.where("class <> v").select(F.col("class").alias("u"), "v"))  # a centre for each class
        roots = _linked(None, checkpoint(_similar(compared, sets, similarity)))
    buckets, most = checkpoint(_dealt(rows, crowded.select("m", "k", "n") if some else None, roots, crowd)), 1
    while not buckets.isEmpty():
        found = checkpoint(_candidates(_rooted(buckets, roots), most, similarity))
        pairs = found.where("u is not null").select("u", "v").distinct()
        pairs = checkpoint(pairs if compared is None else pairs.join(compared, ["u", "v"], "left_anti"))
        compared = pairs if compared is None else compared.unionByName(pairs)
        good = checkpoint(_similar(pairs, sets, similarity))
        if not good.isEmpty():
            roots = _linked(roots, good)
        buckets = checkpoint(buckets.join(found.where("u is null").select("m", "k", "block"), ["m", "k", "block"], "left_semi"))
        most *= GROWTH
    placed = _rooted(distinct.select("class", "first"), roots)
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = checkpoint(join_hot(placed, least, "root").select("class", "component_id"))
    return join_hot(own.select("doc_id", "class", "text_hash"), classes, "class").select("doc_id", "component_id", "text_hash")


def representatives(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, budget: int = BUDGET, hot: int = HOT, similarity: float | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each component the one whose id is the component's.

    With a similarity the links are those of verified_duplicates(), not the bits within the budget.
    Rows repeated with id and text stay once. Rows without an id stay where their component has none, a text once.
    """
    if similarity is None:
        found = checkpoint(near_duplicates(docs, id_col=id_col, text_col=text_col, shingle=shingle, budget=budget, hot=hot))
    else:
        found = checkpoint(verified_duplicates(docs, similarity, id_col=id_col, text_col=text_col, shingle=shingle))
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias("__id")).distinct()
    named = docs.join(kept, docs[id_col] == kept["__id"], "left_semi").dropDuplicates([id_col, text_col])
    nameless = found.where("doc_id is null and component_id is null").select(F.col("text_hash").alias("__k")).distinct()
    if nameless.isEmpty():
        return named
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return named.unionByName(docs.where(docs[id_col].isNull()).join(nameless, F.xxhash64(text) == nameless["__k"], "left_semi").dropDuplicates([text_col]))
