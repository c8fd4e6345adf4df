"""Toxicity by compression distance.

Zstandard dictionaries are trained on windows of ordinary and of toxic text, of ``WINDOW`` words each. A window's margin is
how many bytes fewer it takes when the toxic dictionary stands behind the ordinary one. A label says only that a text is
toxic, not where; so most of what a dictionary learns from toxic texts is ordinary. Each of its segments is therefore put
behind the ordinary dictionary by itself, and stays only if the windows of toxic texts that it was not trained on gain
more by it than the windows of ordinary texts that are most like them, by ``LEAST_Z`` standard errors. Further rounds do
the same with the toxic texts that are still like ordinary ones. Thresholds on a text's margins are calibrated by logistic regression on labelled
texts that no dictionary saw, of which a third are toxic where there are enough. Nothing but lengths of compressed windows enters.

Trained dictionaries are used as content, without their entropy tables: lengths are then comparable between dictionaries.

Training takes a bounded sample of the labelled rows, the first by a hash of their id: ``SAMPLE`` gives toxic and
ordinary texts for the dictionaries and for calibration, each of at most ``MAX_CHARS`` characters; ``JUDGES`` of their
windows, evenly spaced, measure a segment. Whole texts are scored. Labels, language, source and id are no inputs of a score.

Defined results: a null text is empty, and an empty one has one window without margin; equal texts have equal scores;
a null doc_id is not held out; without toxic or ordinary labels every score is the smoothed share of toxic ones;
contradicting labels of an id count as toxic; of several texts of an id the least is sampled; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import checkpoint, prepare, slices, texts

WINDOW, FOLDS, HELD_OUT, CALIBRATION = 8, 4, 2, 3
#: Rows: toxic and ordinary for the dictionaries, toxic and ordinary for calibration. Longer texts aren't sampled.
SAMPLE, MAX_CHARS = (1500, 2500, 1000, 2000), 30_000
#: Bytes of the ordinary dictionary, of the toxic one's candidates in each round, and of a segment.
ORDINARY_BYTES, CANDIDATE_BYTES, SEGMENT = 8_192, (6_144, 4_096, 3_072, 3_072), 16
#: Windows that measure a segment at first, and then, if it has half the standard errors asked for.
JUDGES, LEAST_Z, HEADER = (2_000, 10_000), 2.5, 256
#: The part of ordinary windows that gain as much as a window that counts as telling.
USUAL = 0.02


def windows(text: str) -> list[bytes]:
    words = text.encode().lower().split()
    return [b" " + b" ".join(words[i : i + WINDOW]) for i in range(0, max(1, len(words)), WINDOW)]


def _content(samples: list[bytes], size: int, segment: int, unit: int) -> bytes:
    """The content of a dictionary trained on samples."""
    import zstandard

    try:
        return zstandard.train_dictionary(size + HEADER, samples, k=segment, d=unit).as_bytes()[HEADER:]
    except zstandard.ZstdError:  # too few samples: their ends are the content
        return b"".join(samples)[-size:]


def _compressor(content: bytes) -> Callable[[bytes], bytes]:
    import zstandard

    how = zstandard.ZstdCompressionParameters(window_log=15, chain_log=15, hash_log=15, search_log=5, min_match=4, target_length=16, strategy=zstandard.STRATEGY_LAZY2, write_content_size=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    own = zstandard.ZstdCompressionDict(content or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    own.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=own, compression_params=how).compress


def _lengths(compress: Callable[[bytes], bytes], some: list[bytes]) -> np.ndarray:
    return np.fromiter(map(len, map(compress, some)), np.int64, len(some))


def _spaced(some: list[bytes], most: int) -> list[bytes]:
    """At most so many of them, evenly spaced and in an order in which every start is so too."""
    step = max(1, -(-len(some) // most))
    chosen = some[::step]
    turn = next(x for x in (7919, 7907, 7901, 7883) if len(chosen) % x)
    return [chosen[i * turn % len(chosen)] for i in range(len(chosen))] if chosen else []


def _telling(candidates: bytes, ordinary: bytes, judges: list[bytes], others: list[bytes]) -> list[tuple[float, bytes]]:
    """The segments by which judges gain more than others do, with the difference in standard errors."""
    plain = _compressor(ordinary)
    own, there = _lengths(plain, judges), _lengths(plain, others)
    out = []
    for at in range(0, len(candidates) - SEGMENT + 1, SEGMENT):
        piece = candidates[at : at + SEGMENT]
        compress = _compressor(ordinary + piece)
        a, b, z = np.empty(0), np.empty(0), 0.0
        for most, least in zip(JUDGES, (LEAST_Z / 2, LEAST_Z), strict=True):
            a, b = (np.concatenate((x, n[len(x) : most] - _lengths(compress, w[len(x) : most]))) for x, n, w in ((a, own, judges), (b, there, others)))
            z = (a.mean() - b.mean()) / np.sqrt(a.var() / len(a) + b.var() / len(b) + 1e-9)
            if z < least:
                break
        else:
            out.append((float(z), piece))
    return out


class Model:
    """Both dictionaries and the calibration. It is a few ten kB, whatever the corpus."""

    def __init__(self, toxic: list[str], ordinary: list[str], rows: list[tuple[str, int]]):
        labels = np.array([y for _, y in rows])
        self.weights = None
        self.prior = (len(toxic) + labels.sum() + 1) / (len(toxic) + len(ordinary) + len(rows) + 2)
        if len(toxic) < 2 or len(ordinary) < 2 or len(set(labels.tolist())) < 2:
            return
        self.ordinary = _content([w for t in ordinary[::2] for w in windows(t)], ORDINARY_BYTES, 64, 8)
        self.toxic = self._learnt(toxic, ordinary[1::2])
        self._calibrate(np.array([self.features(t) for t, _ in rows]), labels)

    def _learnt(self, toxic: list[str], ordinary: list[str]) -> bytes:
        texts = [[windows(t) for t in part] for part in (toxic[::2], toxic[1::2])]
        pool = _spaced([w for t in ordinary for w in windows(t)], 4 * JUDGES[1])
        kept: dict[bytes, float] = {}
        found = b""
        for size in CANDIDATE_BYTES:
            base = self.ordinary + found
            flat = [[w for t in part for w in t] for part in texts]
            for part, judge in zip(flat, reversed(flat), strict=True):
                if part and judge:
                    candidates = _content(part, size, SEGMENT, 6)
                    for z, piece in _telling(candidates, base, _spaced(judge, JUDGES[1]), self._alike(pool, base, candidates)):
                        kept[piece] = max(z, kept.get(piece, 0.0))
            # the most telling segments are the nearest
            found = b"".join(sorted(kept, key=lambda x: (kept[x], x)))
            plain, both = _compressor(self.ordinary), _compressor(self.ordinary + found)
            gain = lambda some: _lengths(plain, some) - _lengths(both, some)  # noqa: E731, B023
            bar = np.quantile(gain(pool), 1 - USUAL)
            texts = [[t for t in part if (gain(t) > bar).mean() <= 2 * USUAL] for part in texts]
        return found

    def _alike(self, pool: list[bytes], base: bytes, candidates: bytes) -> list[bytes]:
        """The ordinary windows that gain most by all candidates at once: what they have in common with them, as a language, tells nothing."""
        gain = _lengths(_compressor(base), pool) - _lengths(_compressor(base + candidates), pool)
        return [pool[i] for i in sorted(np.argsort(-gain, kind="stable")[: JUDGES[1]].tolist())]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_compressors"}

    def margins(self, text: str) -> np.ndarray:
        """Of each window: how many bytes the toxic dictionary spares behind the ordinary one."""
        if "_compressors" not in self.__dict__:
            self._compressors = _compressor(self.ordinary), _compressor(self.ordinary + self.toxic)
        own = windows(text)
        return _lengths(self._compressors[0], own) - _lengths(self._compressors[1], own)

    def features(self, text: str) -> list[float]:
        n = self.margins(text)
        best = np.concatenate((np.sort(n)[::-1][:4], np.zeros(4)))[:4]
        return [np.log(len(n)), n.mean(), n.sum() / np.sqrt(len(n)), *np.clip(best, -3, 12), *((n >= k).mean() for k in (1, 2, 3, 4)), *(np.log1p((n >= k).sum()) for k in (1, 2, 3, 4, 5))]

    def _calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        x = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        w = np.zeros(x.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (p - y) + np.r_[w[:-1], 0])
        self.weights = w

    def score(self, text: str) -> float:
        if self.weights is None:
            return float(self.prior)
        x = np.r_[(np.array(self.features(text)) - self.mean) / self.scale, 1]
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30))))


def fold(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: tuple[int, int, int, int] = SAMPLE, max_chars: int = MAX_CHARS) -> Model:
    """A model from the sampled labelled rows outside of the held-out fold."""
    known = labels.select(F.col(id_col).alias("k"), F.col(label_col).alias("y")).where("k is not null and y is not null").groupBy("k").agg(F.max("y").cast("int").alias("y")).withColumn("fold", fold("k"))
    own = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("text"))
    fitting = own.where(f"length(text) between 1 and {max_chars}").select("k")
    known = checkpoint(known.where(F.col("fold") != HELD_OUT).join(fitting, "k", "left_semi"))
    parts = []
    for (n, y), held in zip(zip(sample, (1, 0, 1, 0), strict=True), (False, False, True, True), strict=True):
        parts.append(known.where((F.col("y") == y) & ((F.col("fold") == CALIBRATION) == held)).orderBy(F.xxhash64("k"), "k").limit(n))
    chosen = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).collect()
    if not chosen:
        return Model([], [], [])
    # at most sum(sample) ids, so the join sends nothing that grows
    few = docs.sparkSession.createDataFrame([(r.k, r.y, r.fold == CALIBRATION) for r in chosen], f"k {own.schema['k'].dataType.simpleString()}, y int, held boolean")
    texts_of = own.join(F.broadcast(few), "k").where(f"length(text) between 1 and {max_chars}").groupBy("k").agg(F.min(F.struct("text", "y", "held")).alias("x"))
    rows = [r.x for r in texts_of.orderBy("k").collect()]
    return Model([r.text for r in rows if not r.held and r.y], [r.text for r in rows if not r.held and not r.y], [(r.text, r.y) for r in rows if r.held])


def scored(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(fold(id_col) == HELD_OUT, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.score
        for b in slices(batches, 8 << 20):
            found = np.array([score(t) for t in texts(b.column(2))], np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found), pa.array((found >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
