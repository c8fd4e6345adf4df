"""Repeated passages by sparse suffix arrays.

Words are separated by ASCII white space. A passage is a run of at least ``LENGTH`` words. Of every window of that many
words one suffix is retained: the one at the window's minimiser, the leftmost least hash among its ``GRAM``-word grams.
It depends on the window's words alone, so equal windows retain equal suffixes at equal offsets, wherever they are.

Only suffixes whose gram occurs elsewhere go on. They meet by that gram with the words around them, are sorted, and
neighbours are compared: the common prefixes to the right and, from a second order, to the left give the classes of
suffixes that agree in so many words; two suffixes agree in a whole window if they agree in r words to the right and
in the rest to the left. The matches of all offsets together extend left and right to the whole repeated passage.

The earliest occurrence (by doc_id, then position) stays, every later one that doesn't overlap it is reported. So a word
is reported exactly if it lies in a window of LENGTH words that occurs earlier. Equal texts are compared once, as the
text of their least doc_id; the others are repeated as a whole, if they have LENGTH words.

How often a gram occurs is known from partial counts before any suffix is sent by it. The suffixes of one that more than
``hot`` share aren't: their windows are aggregated by hash, with partial minima before the exchange, and meet these by a
broadcast of counted size, or beyond it in ``SALTS`` tasks. Only first documents of a text have suffixes, and rows meet
their text's findings by id and text, so that copies never meet in one task. Texts are sent compressed.

Defined results: null and empty texts, and texts below LENGTH words, have no passages; a null doc_id comes last; rows
repeated with their doc_id have the same result; an empty table gives no rows; other columns pass or are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from quarrylight.llm.common import SALTS, checkpoint, few, prepare, slices, texts, tidy

LENGTH, GRAM, HOT = 50, 8, 50_000
BESIDE = LENGTH - GRAM
WORD = re.compile(rb"[^\x20\x09-\x0d]+")
POSITION = (1 << 28) - 1


def _numbers(text: str | bytes) -> np.ndarray:
    words = (text if isinstance(text, bytes) else text.encode()).split()
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


def _grams(numbers: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM words from each position on."""
    n = len(numbers) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(GRAM):
        h = h * np.uint64(0x9E3779B97F4A7C15) + numbers[j : j + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _retained(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, gram) of the minimisers of all windows of the rows."""
    sizes = np.array([len(x) for x in rows], np.int64)
    numbers = np.concatenate(rows) if rows else np.empty(0, np.uint64)
    if len(numbers) < LENGTH:
        return (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))
    grams = _grams(numbers)
    least = (grams & ~np.uint64(POSITION)) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= BESIDE + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < BESIDE + 1:
        rest = BESIDE + 1 - width
        least = np.minimum(least[:-rest], least[rest:])
    begins = np.concatenate(([0], np.cumsum(sizes)))
    inside = np.zeros(len(numbers) + 1, np.int32)
    some = sizes >= LENGTH
    np.add.at(inside, begins[:-1][some], 1)
    np.add.at(inside, (begins[1:] - LENGTH + 1)[some], -1)
    chosen = np.unique((least[np.cumsum(inside)[: len(least)] > 0] & np.uint64(POSITION)).astype(np.int64))
    row = np.searchsorted(begins, chosen, "right") - 1
    return row, chosen - begins[row], grams[chosen]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def _occurrences(keyed: DataFrame) -> DataFrame:
    """(doc_id, a, b, found): the grams and positions of each text's retained suffixes."""
    kind = keyed.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 8 << 20):
            row, position, gram = _retained([_numbers(t) for t in texts(b.column(1))])
            ends = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32))
            pairs = pa.StructArray.from_arrays([pa.array(gram.view(np.int64)), pa.array(position.astype(np.int32))], ["h", "pos"])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.ListArray.from_arrays(ends, pairs)], ["doc_id", "a", "b", "found"])

    return keyed.mapInArrow(tidy(run), f"doc_id {kind}, a bigint, b bigint, found array<struct<h:bigint,pos:int>>")


def _packed(rows: DataFrame, text_col: str) -> DataFrame:
    """rows with the text compressed, for the exchanges that texts can't be kept out of. Null stays null."""
    import zstandard

    at = rows.columns.index(text_col)
    schema = StructType([StructField(f.name, BinaryType()) if i == at else f for i, f in enumerate(rows.schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1, write_checksum=False).compress
        for b in slices(batches, 8 << 20):
            columns = list(b.columns)
            columns[at] = pa.array([x if x is None else pack(x.encode()) for x in columns[at].to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return rows.mapInArrow(tidy(run), schema)


def _unpack(column: pa.Array) -> Iterator[bytes]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    return (b"" if x is None else unpack(x) for x in column.to_pylist())


def _contexts(found: DataFrame) -> DataFrame:
    """(doc_id, a, text, places) to a row per suffix with the words around it: BESIDE, the gram, BESIDE."""
    kind = found.schema["doc_id"].dataType.simpleString()
    around = np.arange(-BESIDE, LENGTH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1 << 20):
            for i, text in enumerate(_unpack(b.column(2))):
                numbers, own = _numbers(text), b.column(3)[i].values
                p, first = np.unique(own.field(0).to_numpy(zero_copy_only=False), return_index=True)
                p = p.astype(np.int64)
                for x in range(0, len(p), 1 << 14):
                    part = p[x : x + (1 << 14)]
                    at = part[:, None] + around
                    words = np.where((at >= 0) & (at < len(numbers)), numbers[at.clip(0, len(numbers) - 1)], 0).astype("<u4")
                    one = pa.array(np.full(len(part), i))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(_grams(numbers)[part].view(np.int64)), b.column(0).take(one), b.column(1).take(one), pa.array(part.astype(np.int32)), pa.array(np.minimum(part, BESIDE).astype(np.int32)), pa.array(np.minimum(len(numbers) - part - GRAM, BESIDE).astype(np.int32)), pa.array([w.tobytes() for w in words], pa.binary()), own.field(1).take(pa.array(first[x : x + (1 << 14)]))],
                        ["h", "doc_id", "a", "pos", "left", "right", "words", "crowded"],
                    )

    return found.select("doc_id", "a", "text", "places").mapInArrow(tidy(run), f"h bigint, doc_id {kind}, a bigint, pos int, left int, right int, words binary, crowded boolean")


def _classes(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by group and words, and how many words each has in common with the one before; -1 at a group's first."""
    raw = rows.astype(">u4").tobytes()
    width = 4 * rows.shape[1]
    keys = [raw[i : i + width] for i in range(0, len(raw), width)]
    groups = group.tolist()
    order = np.array(sorted(range(len(keys)), key=lambda i: (groups[i], keys[i])), np.int64)
    a = rows[order]
    differ = a[1:] != a[:-1]
    common = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    common[group[order[1:]] != group[order[:-1]]] = -1
    return order, np.concatenate(([-1], common))


def matches(words: np.ndarray, group: np.ndarray, place: np.ndarray, position: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, begin, end, later) of what windows repeat. Rows come in order of occurrence; place numbers their texts.

    later tells the windows that occur before from those that occur again.
    """
    n = len(words)
    right_order, right_common = _classes(words[:, BESIDE:], group)
    left_order, left_common = _classes(words[:, :BESIDE][:, ::-1], group)
    begin, end = np.full((2, n), np.iinfo(np.int64).max), np.zeros((2, n), np.int64)
    kind_right, kind_left, index = np.empty(n, np.int64), np.empty(n, np.int64), np.arange(n)
    for before in range(BESIDE + 1):
        kind_right[right_order] = np.cumsum(right_common < LENGTH - before)
        kind_left[left_order] = np.cumsum(left_common < before)
        own = index[(left >= before) & (right >= BESIDE - before)]
        if len(own) < 2:
            continue
        _, first, which = np.unique(kind_right[own] * (n + 1) + kind_left[own], return_index=True, return_inverse=True)
        earliest = own[first[which]]
        again = (place[earliest] != place[own]) | (position[own] - position[earliest] >= LENGTH)
        for i, hit in ((0, np.unique(earliest[again])), (1, own[again])):
            begin[i, hit] = np.minimum(begin[i, hit], position[hit] - before)
            end[i, hit] = np.maximum(end[i, hit], position[hit] - before + LENGTH)
    later, hit = np.nonzero(end)
    return hit, begin[later, hit], end[later, hit], later == 1


def _in_order(t: pa.Table) -> pa.Table:
    return t.take(pc.sort_indices(t, [("doc_id", "ascending"), ("a", "ascending"), ("pos", "ascending")], null_placement="at_end"))


def _matrix(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t["words"].to_pylist()), "<u4").reshape(-1, BESIDE + LENGTH)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by h: whole groups of them at once."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def settle(t: pa.Table) -> pa.RecordBatch:
        t = _in_order(t)
        h, a, p = (t[x].to_numpy() for x in ("h", "a", "pos"))
        p = p.astype(np.int64)
        hit, begin, end, later = matches(_matrix(t), h, a, p, t["left"].to_numpy(), t["right"].to_numpy())
        return pa.RecordBatch.from_arrays([t["doc_id"].combine_chunks().take(pa.array(hit)), pa.array(a[hit]), pa.array(begin), pa.array(end), pa.array(later)], ["doc_id", "a", "begin", "end", "later"])

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        h = b.column(0).to_numpy()
        if rows >= HOT and h[0] != h[-1]:
            cut = int(np.flatnonzero(h != h[-1])[-1]) + 1
            held[-1] = b.slice(0, cut)
            yield settle(pa.Table.from_batches(held))
            held, rows = [b.slice(cut)], b.num_rows - cut
    if held:
        yield settle(pa.Table.from_batches(held))


def _windows(rows: DataFrame) -> DataFrame:
    """The windows of suffixes as rows: two multilinear hashes of their words, the place and the window's first word."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    factors = np.random.default_rng(42).integers(0, 1 << 63, (2, LENGTH)).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1 << 20):
            t = pa.Table.from_batches([b])
            words, p, left, right = _matrix(t).astype(np.uint64), *(t[x].to_numpy().astype(np.int64) for x in ("pos", "left", "right"))
            for before in range(BESIDE + 1):
                own = np.flatnonzero((left >= before) & (right >= BESIDE - before))
                part = words[own, BESIDE - before : BESIDE - before + LENGTH]
                keys = [pa.array((part * x).sum(1, dtype=np.uint64).view(np.int64)) for x in factors]
                take = pa.array(own)
                yield pa.RecordBatch.from_arrays([*keys, b.column(b.schema.names.index("doc_id")).take(take), b.column(b.schema.names.index("a")).take(take), pa.array(p[own] - before)], ["x", "y", "doc_id", "a", "begin"])

    return rows.mapInArrow(tidy(run), f"x bigint, y bigint, doc_id {kind}, a bigint, begin bigint")


def _crowded_spans(context: DataFrame) -> DataFrame:
    """The same as of _compare for grams that too many suffixes share: windows are aggregated, never gathered."""
    windows = _windows(context)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "a", "begin")
    again = lambda x: (F.col("f.a") != x("a")) | ~F.col("f.doc_id").eqNullSafe(x("doc_id")) | (x("begin") - F.col("f.begin") >= LENGTH)
    # most windows occur once, as a passage's surroundings differ
    first = checkpoint(windows.groupBy("x", "y").agg(F.min(place).alias("f"), F.max(place).alias("l")).where(again(lambda c: F.col(f"l.{c}"))).select("x", "y", "f"))
    if few(first):
        met = windows.join(F.broadcast(first), ["x", "y"])
    else:
        salts = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = windows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "a", "begin"), F.lit(SALTS)).cast("int")).join(salts, ["x", "y", "salt"])
    ranges = lambda rows, later: rows.select("doc_id", "a", "begin", (F.col("begin") + LENGTH).alias("end"), F.lit(later).alias("later"))
    return ranges(met.where(again(F.col)), True).unionByName(ranges(first.select("f.doc_id", "f.a", "f.begin"), False))


def _owners(keyed: DataFrame) -> DataFrame:
    """(a, b, owner, copies) of each distinct text."""
    return checkpoint(keyed.groupBy("a", "b").agg(F.min("doc_id").alias("owner"), F.count("*").alias("copies")))


def _owned(rows: DataFrame, owners: DataFrame, how: str) -> DataFrame:
    """rows (doc_id, a, b) with their text's owner where they are it. Ids are nearly unique, so no key is hot."""
    named = owners.withColumnsRenamed({"a": "oa", "b": "ob"})
    return rows.join(named, rows["doc_id"].eqNullSafe(named["owner"]) & (rows["a"] == named["oa"]) & (rows["b"] == named["ob"]), how)


def hits(keyed: DataFrame, owners: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, a, begin, end, later): word ranges of first documents that repeat earlier ones, or are repeated later."""
    occurrences = checkpoint(_owned(_occurrences(keyed).where(F.size("found") > 0), owners, "left_semi"))
    rows = occurrences.select("doc_id", "a", F.inline("found"))
    mixed = F.xxhash64("doc_id", "a", "pos")
    shared = checkpoint(rows.groupBy("h").agg(F.count("*").alias("n"), F.min(mixed).alias("x"), F.max(mixed).alias("y")).where("x <> y").select("h", (F.col("n") > hot).alias("crowded")))
    crowded = shared.where("crowded").select("h")
    if crowded.isEmpty():
        met = rows.join(shared.select("h"), "h", "left_semi").withColumn("crowded", F.lit(False))
    elif few(crowded):  # their rows meet nothing by h, so none of them is sent by it
        met = rows.join(F.broadcast(crowded), "h", "left_anti").join(shared.where("not crowded").select("h"), "h", "left_semi").withColumn("crowded", F.lit(False))
        met = met.unionByName(rows.join(F.broadcast(crowded), "h", "left_semi").withColumn("crowded", F.lit(True)))
    else:
        salts = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = rows.withColumn("salt", F.pmod(mixed, F.lit(SALTS)).cast("int")).join(salts, ["h", "salt"])
    places = met.groupBy("doc_id", "a").agg(F.collect_list(F.struct("pos", "crowded")).alias("places")).withColumnsRenamed({"doc_id": "cid", "a": "ca"})
    packed = _packed(keyed.select("doc_id", "a", "text"), "text")
    context = _contexts(packed.join(places, (packed["a"] == F.col("ca")) & packed["doc_id"].eqNullSafe(F.col("cid"))))
    kind = keyed.schema["doc_id"].dataType.simpleString()
    compare = lambda rows: rows.repartition("h").sortWithinPartitions("h").mapInArrow(tidy(_compare), f"doc_id {kind}, a bigint, begin bigint, end bigint, later boolean")
    if crowded.isEmpty():
        return compare(context)
    context = checkpoint(context)
    return compare(context.where("not crowded")).unionByName(_crowded_spans(context.where("crowded")))


def _with_ranges(docs: DataFrame, id_col: str, text_col: str, hot: int) -> DataFrame:
    """docs' rows with the text packed, then __own (its text's first document), __copies and __found."""
    prepare(docs.sparkSession)
    keyed = _keyed(docs, id_col, text_col)
    owners = _owners(keyed)
    found = hits(keyed, owners, hot).groupBy("doc_id", "a").agg(F.collect_set(F.struct("begin", "end", "later")).alias("found"))
    classes = owners.join(found, found["doc_id"].eqNullSafe(owners["owner"]) & (found["a"] == owners["a"]), "left").select(owners["a"].alias("__oa"), owners["b"].alias("__ob"), F.col("owner").alias("__owner"), F.col("copies").alias("__copies"), F.col("found").alias("__found"))
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = _packed(docs.withColumns({text_col: F.col(text_col).cast("string"), "__a": F.xxhash64(text), "__b": F.xxhash64(F.lit(1), text)}), text_col)
    joined = rows.join(classes, rows[id_col].eqNullSafe(F.col("__owner")) & (F.col("__a") == F.col("__oa")) & (F.col("__b") == F.col("__ob")), "left")
    return joined.select(*(rows[f"`{c}`"] for c in docs.columns), F.col("__oa").isNotNull().alias("__own"), "__copies", "__found")


def _merged(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _runs(n: int, own: bool, copies: int, found: list[dict]) -> tuple[list[tuple[int, int]], int]:
    """The ranges that occur earlier, and how many of the n words lie in a passage that occurs elsewhere at all."""
    whole = [(0, n)] if n >= LENGTH else []
    if not own:
        return whole, n if whole else 0
    every = whole if copies > 1 and whole else _merged([(x["begin"], x["end"]) for x in found])
    return _merged([(x["begin"], x["end"]) for x in found if x["later"]]), sum(b - a for a, b in every)


def cut(raw: bytes, found: list[tuple[int, int]]) -> str:
    """The text without those ranges of words; the white space around each stays."""
    places = [m.span() for m in WORD.finditer(raw)]
    out, at = [], 0
    for a, b in found:
        out.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, raw[at:]]).decode()


def _resolved(b: pa.RecordBatch, at: int) -> Iterator[tuple[bytes, list[tuple[int, int]], int]]:
    """Of each row of _with_ranges: its text, its later ranges and its shared words."""
    own, copies, found = (x.to_pylist() for x in b.columns[-3:])
    for raw, *x in zip(_unpack(b.column(at)), own, copies, found, strict=True):
        yield raw, *_runs(len(raw.split()), x[0], x[1] or 1, x[2] or [])


def digest(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """A row per row of docs: doc_id, n_repeated and spans (the words that occur earlier, an array of begin and end), n_spans, n_shared (words in passages that occur elsewhere, earlier or later), text (what is left without the spans)."""
    base = _with_ranges(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text", hot)
    kind = base.schema["doc_id"].dataType.simpleString()
    ranges = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2 << 20):
            rows = list(_resolved(b, 1))
            text = [None if z is None else cut(raw, r) for (raw, r, _), z in zip(rows, b.column(1).to_pylist(), strict=True)]
            sizes = [sum(z - a for a, z in r) for _, r, _ in rows]
            spans = [[{"begin": a, "end": z} for a, z in r] for _, r, _ in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array([len(x) for x in spans], pa.int32()), pa.array(spans, ranges), pa.array([x for *_, x in rows], pa.int64()), pa.array(text, pa.string())], ["doc_id", "n_repeated", "n_spans", "spans", "n_shared", "text"])

    return base.mapInArrow(tidy(run), f"doc_id {kind}, n_repeated bigint, n_spans int, spans array<struct<begin:bigint,end:bigint>>, n_shared bigint, text string")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", hot: int = HOT) -> DataFrame:
    """docs without the later occurrences of repeated passages; a document of which no word is left goes."""
    names, schema = docs.columns, docs.schema
    base = _with_ranges(docs, id_col, text_col, hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text_col)
        for b in slices(batches, 2 << 20):
            rows = list(_resolved(b, at))
            text = [None if z is None else cut(raw, r) for (raw, r, _), z in zip(rows, b.column(at).to_pylist(), strict=True)]
            columns = list(b.columns[: len(names)])
            columns[at] = pa.array(text, pa.string())
            if length_col in names:
                sizes = b.column(names.index(length_col))
                columns[names.index(length_col)] = pa.array([len(t) if r else o for t, (_, r, _), o in zip(text, rows, sizes.to_pylist(), strict=True)], sizes.type)
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array([not r or bool(t.strip()) for t, (_, r, _) in zip(text, rows, strict=True)]))

    return base.mapInArrow(tidy(run), schema)
