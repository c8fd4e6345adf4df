"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against every training token window.

Normalisation: A-Z are lower-cased; a word is a maximal run of digits, a-z and characters beyond ASCII. A window is
``n`` consecutive words of an item; an item of fewer words is one window; an item without words has none.

The set is broadcast while the benchmark holds at most ``max_bytes`` of text. A larger one is cut into chunks below
that size; the documents are scanned once a chunk and checkpointed in between, so that no broadcast outgrows the bound.

Defined results: null or empty text has no words and is never contaminated; repeated benchmark rows count once an
item; a null item_id is the item named "null"; an empty benchmark or documents table gives no hits or no rows; other
columns of either table pass through or are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarrylight.llm.common import checkpoint, prepare, slices, texts

#: Upper case to lower case; every byte that is in no word to a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Most bytes of benchmark text in one broadcast.
MAX_BYTES = 16 << 20
HITS = "array<struct<first:bigint,last:bigint,item:string>>"


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


class Windows:
    """The hash set: windows as word numbers, by length, with the items that hold each."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        self.number: dict[bytes, int] = {}
        self.held: dict[int, dict[bytes, list[int]]] = {}
        self.names = sorted({k for k, _ in items})
        place = {k: i for i, k in enumerate(self.names)}
        for name, text in sorted(items, key=lambda x: x[0]):
            words = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)], np.int32)
            size = min(n, len(words))
            for at in range(len(words) - size + 1 if size else 0):
                holders = self.held.setdefault(size, {}).setdefault(words[at : at + size].tobytes(), [])
                if not holders or holders[-1] != place[name]:  # they come in order
                    holders.append(place[name])
        self.powers = {size: np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(size)], np.uint64) for size in self.held}
        self.hashes = {size: np.sort(self._hash(np.frombuffer(b"".join(w), np.int32).reshape(-1, size), size)) for size, w in self.held.items()}

    def _hash(self, rows: np.ndarray, size: int) -> np.ndarray:
        return (rows.astype(np.uint64) * self.powers[size]).sum(1, dtype=np.uint64)

    def scan(self, numbers: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
        """(start, length, items) of each verified window in a row of word numbers; 0 is a word of no item or a border."""
        known = np.concatenate(([0], np.cumsum(numbers > 0)))
        for size, hashes in self.hashes.items():
            if len(numbers) < size:
                continue
            starts = np.flatnonzero(known[size:] - known[:-size] == size)
            for part in np.array_split(starts, max(1, len(starts) // 200_000)):
                rows = numbers[part[:, None] + np.arange(size)]
                hashed = self._hash(rows, size)
                found = np.searchsorted(hashes, hashed)
                found[found == len(hashes)] = 0
                for i in np.flatnonzero(hashes[found] == hashed):
                    if items := self.held[size].get(rows[i].astype(np.int32).tobytes()):
                        yield int(part[i]), size, items


def _scan(batch: list[str], windows: Windows) -> tuple[np.ndarray, list[list[tuple[int, int, int]]]]:
    """Words of each text, and its hits as (first word, beyond the last, item)."""
    counts, numbers = np.zeros(len(batch), np.int64), []
    get = windows.number.get
    for i, text in enumerate(batch):
        words = words_of(text)
        counts[i] = len(words)
        numbers.append(np.fromiter(map(get, words, repeat(0)), np.int32, len(words)))
        numbers.append(np.zeros(1, np.int32))
    begins = np.concatenate(([0], np.cumsum(counts + 1)))
    hits: list[list[tuple[int, int, int]]] = [[] for _ in batch]
    if numbers:
        for at, size, items in windows.scan(np.concatenate(numbers)):
            k = int(np.searchsorted(begins, at, "right")) - 1
            hits[k] += [(at - int(begins[k]), at - int(begins[k]) + size, x) for x in items]
    return counts, hits


def _merged(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(hits):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _chunks(benchmark: DataFrame, item_col: str, text_col: str, max_bytes: int) -> Iterator[list[tuple[str, str]]]:
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("k"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("t") + 64), F.lit(0))).first()[0]
    n = -(-2 * size // max_bytes) if size > max_bytes else 1
    for i in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("k", "t"), F.lit(n)) == i)
        yield [(r.k, r.t) for r in part.distinct().toLocalIterator()]


def hits(docs: DataFrame, benchmark: DataFrame, *, n: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", out: str = "hits", max_bytes: int = MAX_BYTES) -> DataFrame:
    """docs with a column of hits, each a word span and the item whose window occurs there, and ``<out>_words``, its words."""
    prepare(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    at = docs.columns.index(text_col)
    schema, names = docs.schema, [*docs.columns, out, f"{out}_words"]
    for k, items in enumerate(_chunks(benchmark, item_col, item_text_col, max_bytes)):
        shared = sc.broadcast(Windows(items, n))

        def scan(batches, shared=shared, first=k == 0, at=at):
            windows = shared.value
            kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("item", pa.string())]))
            for b in slices(batches, 8 << 20):
                counts, found = _scan(texts(b.column(at)), windows)
                lists = [[{"first": x, "last": y, "item": windows.names[z]} for x, y, z in rows] for rows in found]
                if first:
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lists, kind), pa.array(counts)], names)
                else:
                    before = b.column(b.num_columns - 2).to_pylist()
                    yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array([x + y for x, y in zip(before, lists, strict=True)], kind), b.column(b.num_columns - 1)], b.schema.names)

        if k == 0:
            schema = StructType([*docs.schema.fields, *StructType.fromDDL(f"{out} {HITS}, {out}_words bigint").fields])
        else:
            docs = checkpoint(docs)
        docs = docs.mapInArrow(scan, schema)
    return docs


def digest(docs: DataFrame, benchmark: DataFrame, *, n: int = 10, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = MAX_BYTES) -> DataFrame:
    """A row per document: n_words, n_hit, n_items, items_sha256 (of the sorted item ids, comma-joined), contaminated."""
    found = hits(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, n=n, max_bytes=max_bytes)
    kind = found.schema["doc_id"].dataType.simpleString()

    def summarise(batches):
        for b in batches:
            spans = b.column("hits").to_pylist()
            names = [sorted({h["item"] for h in x}) for x in spans]
            n_hit = [sum(y - x for x, y in _merged([(h["first"], h["last"]) for h in s])) for s in spans]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("hits_words"), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in names], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]), pa.array([x > 0 for x in n_hit])],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return found.select("doc_id", "hits", "hits_words").mapInArrow(summarise, f"doc_id {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the bytes from the first to the last word of each span."""
    raw = text.encode()
    places = [m.span() for m in WORD.finditer(raw.translate(FOLD))]
    out, at = [], 0
    for a, b in _merged(spans):
        out.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, raw[at:]]).decode()


def remove_spans(docs: DataFrame, benchmark: DataFrame, *, n: int = 10, text_col: str = "text", length_col: str | None = "n_chars", drop_share: float = 1.0, max_bytes: int = MAX_BYTES) -> DataFrame:
    """docs with every hit span cut out of the text, length_col set anew where it is a column.

    A document of whose words at least drop_share are hit goes as a whole (1.0: only one that has nothing else).
    """
    found = hits(docs, benchmark, n=n, text_col=text_col, out="__hits", max_bytes=max_bytes)
    names = docs.columns

    def cut(batches):
        for b in slices(batches, 16 << 20):
            spans = [_merged([(h["first"], h["last"]) for h in x]) for x in b.column("__hits").to_pylist()]
            n_words = b.column("__hits_words").to_pylist()
            keep = [not s or sum(y - x for x, y in s) < drop_share * w for s, w in zip(spans, n_words, strict=True)]
            at = names.index(text_col)
            text = [cut_words(t, s) if s and k else t for t, s, k in zip(b.column(at).to_pylist(), spans, keep, strict=True)]
            columns = list(b.columns[: len(names)])
            columns[at] = pa.array(text, pa.string())
            if length_col in names:
                old = b.column(names.index(length_col))
                columns[names.index(length_col)] = pa.array([len(t) if s else o for t, s, o in zip(text, spans, old.to_pylist(), strict=True)], old.type)
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep))

    return found.mapInArrow(cut, docs.schema)
