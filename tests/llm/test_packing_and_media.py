"""Tokens, both packings, chat formatting and transport streams: brute force and exact round trips."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrylight.llm import binpack, chat, media_ts, retrieval_packing
from quarrylight.llm.tokens import default_path, encoder

pytest.importorskip("public_tokenizers")
RNG = np.random.default_rng(5)
DOCS = "doc_id bigint, text string, ids int"
TEXTS = [None, "", " ", "a", "The the  the\n\n x <|endoftext|> y", "don't 's \t\tend \n", "naïve café Ω漢字 \U0001f600", *(" ".join(RNG.choice(["sun", "moon", "tide", "Über", "x,y"], n)) for n in (5, 300, 2047, 2048, 5000, 900, 40, 40))]


def frame(spark, texts=TEXTS, ids=None):
    return spark.createDataFrame([(i, t, 0) for i, t in zip(ids or range(len(texts)), texts, strict=True)], DOCS)


def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t\r  　'stremvdl<|endoftext|>abc1,.é"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_ids_equal_the_tokenizer_s(text):
    expected = np.array(whole_once().encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert encoder().encode(pa.array([text])) == [expected]


def whole_once(cache={}):  # noqa: B006
    return cache.setdefault("t", whole())


def expected_ids(text):
    return [*whole_once().encode(text or "", add_special_tokens=False).ids, 1]


def test_retrieval_packing_places_every_id_once(spark):
    rows = retrieval_packing.packed(frame(spark), with_ids=True).collect()
    for i, t in enumerate(TEXTS):
        ids = expected_ids(t)
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        assert np.frombuffer(b"".join(r.ids for r in own), "<u4").tolist() == ids
        for r in own:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    sizes = []
    for s in {r.sequence_id for r in rows}:
        own = sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        sizes.append(sum(r.length for r in own))
    assert max(sizes) <= 2048
    assert retrieval_packing.packed(frame(spark, [])).count() == 0


def test_an_open_window_goes_on_in_the_next_shard():
    docs = [RNG.integers(0, 300, n).astype(np.uint32) for n in RNG.integers(1, 900, 120)]
    sequence, room, used, size = 0, 256, np.zeros(0), 0
    for part in (docs[:50], docs[50:51], docs[51:]):
        pieces, sequence, room = retrieval_packing.pack(part, None, 256, sequence, room)
        own = np.bincount([p[3] for p in pieces], [p[2] for p in pieces])
        used = np.pad(used, (0, len(own) - len(used))) + own
        size += sum(map(len, part))
    assert (used[:-1] == 256).all() and used.sum() == size and 256 - room == used[-1] % 256


def by_the_definition(docs, corpus, seed):
    """BM25 of each document for all ids of a seed, by the formula."""
    out = []
    for i, d in enumerate(docs):
        total = 0.0
        for t in set(docs[seed].tolist()) if i != seed else ():
            tf = int((d == t).sum())
            if tf:
                idf = np.log1p((corpus.n - corpus.df[t] + 0.5) / (corpus.df[t] + 0.5))
                total += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / corpus.mean_length))
        out.append(total)
    return np.array(out)


def test_neighbours_are_all_in_the_order_of_bm25():
    docs = [np.concatenate((RNG.integers(0, 60, n), RNG.integers(60, 2000, n // 3))).astype(np.uint32) for n in RNG.integers(5, 60, 150)]
    every = retrieval_packing.Corpus.of([*docs, *[RNG.integers(0, 2000, 30).astype(np.uint32) for _ in range(100)]])
    index = retrieval_packing.Index(docs, every)
    assert index.common.any() and len(index.owner)
    used = RNG.random(150) < 0.2
    for seed in (0, 7, 31):
        expected = by_the_definition(docs, every, seed)
        found = list(index.neighbours(seed, used))
        assert set(found) == {i for i in range(150) if expected[i] > 5e-4 and not used[i]}
        assert all(a >= b - 2e-3 for a, b in zip(expected[found], expected[found][1:], strict=False))


def test_similar_documents_share_windows(spark):
    topics = [RNG.integers(100 * k, 100 * k + 100, 60).astype(np.uint32) for k in RNG.permutation(np.repeat(np.arange(8), 16))]
    pieces, *_ = retrieval_packing.pack(topics, None, 240)
    pure = [len({int(topics[p[0]][0]) // 100 for p in pieces if p[3] == s}) for s in {p[3] for p in pieces}]
    assert np.mean(pure) < 1.8


def test_the_order_of_files_decides_nothing(spark):
    texts = [" ".join(RNG.choice([f"w{k}x{i}" for i in range(40)], 60)) for k in RNG.permutation(np.repeat(np.arange(12), 10))]
    docs = frame(spark, texts)
    key = lambda r: (r.sequence_id, r.offset, r.doc_id, r.start, r.length)
    a, b = (sorted(map(key, retrieval_packing.packed(d, window=512).collect())) for d in (docs.repartition(7), docs.repartition(2)))
    assert a == b


# -- best fit decreasing

def test_ids_beyond_the_width_are_an_error(spark):
    with pytest.raises(Exception, match="id_bytes"):
        binpack.packed(frame(spark, ["a"]), end_id=70_000).collect()
    assert binpack.packed(frame(spark, ["a"]), end_id=70_000, id_bytes=4).count() == 1



@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 90), max_size=80), st.integers(1, 40))
def test_best_fit_equals_a_linear_search(lengths, window):
    rooms = []
    for n in sorted((n % window for n in lengths if n % window), reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
        rooms.append((min(fit) if fit else window) - n)
    packed = binpack.best_fit(lengths, window)
    assert len(packed) == len(rooms) + sum(n // window for n in lengths)
    pieces = sorted(x for w in packed for x in w)
    for d, n in enumerate(lengths):
        own = [(s, k) for i, s, k in pieces if i == d]
        assert sum(k for _, k in own) == n and [s for s, _ in own] == np.cumsum([0, *(k for _, k in own)])[:-1].tolist()
    assert all(sum(k for *_, k in w) <= window for w in packed)


def test_id_matrices_hold_every_document(spark):
    rows = binpack.packed(frame(spark)).collect()
    found = {}
    for r in rows:
        ids, positions = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.positions, "<u2")
        assert len(ids) == len(positions) == 2048 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and not ids[r.n_tokens :].any()
        for k, (d, s) in enumerate(zip(r.doc_ids, r.starts, strict=True)):
            a, b = r.cu_seqlens[k : k + 2]
            assert positions[a:b].tolist() == list(range(b - a))
            found.setdefault(d, []).append((s, ids[a:b].tolist()))
    for i, t in enumerate(TEXTS):
        assert [x for _, part in sorted(found[i]) for x in part] == expected_ids(t)
    assert binpack.packed(frame(spark, [])).count() == 0


# -- chat

TURNS = "conv_id bigint, turn bigint, role string, text string, ids int"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a:b", ""]), st.text(st.sampled_from("\\#< /turn>:A\n é\U0001f600"), max_size=25)), max_size=5))
def test_templates_are_reversible_and_masks_exact(turns):
    text, spans = chat.render(turns)
    assert chat.turns_of(text) == turns
    e = whole_once().encode(text, add_special_tokens=False)
    mask = chat.loss_mask(e.offsets, spans)
    assert chat.masked_text(text, mask) == "".join(t for r, t in turns if r == "assistant")
    brute = {k for k, (a, b) in enumerate(e.offsets) for x, y in spans if max(a, x) < min(b, y)}
    assert {k for k, _, _ in mask} == brute


def test_chat_digest_and_edges(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "### user: </turn> ok"), (2, None, None, None), (2, 0, "assistant", "b"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (None, 0, "user", "x" * 50_000)]
    shaped = chat.formatted(spark.createDataFrame([(*r, 0) for r in rows], TURNS))
    out = {r.conv_id: r for r in chat.digest(shaped).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert (out[1].n_turns, out[1].loss_chars, out[1].loss_sha256) == (2, 20, sha("### user: </turn> ok"))
    assert out[1].turns_sha256 == sha("user\nhi\nassistant\n### user: </turn> ok\n")
    assert out[2].turns_sha256 == sha("\n\nassistant\na\nassistant\na\nassistant\nb\n") and out[2].loss_sha256 == sha("aab")
    assert out[None].n_turns == 1 and out[None].loss_chars == 0
    assert chat.digest(chat.formatted(spark.createDataFrame([], TURNS))).count() == 0


# -- media

@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 7679, 7680, 7681, 7872, 100_000])
def test_streams_round_trip(n):
    payload, size = media_ts.payload_of("é" * (n // 2) + "x" * (n % 2))
    read = media_ts.parse(stream := media_ts.mux(payload))
    assert size == n and len(payload) % 192 == 0 and read["payload"] == payload and len(stream) % 188 == 0
    units = -(-len(payload) // media_ts.UNIT)
    assert read["pts"] == [k * media_ts.TICKS for k in range(units)] and read["random_access"] == list(range(0, units, media_ts.RANDOM_ACCESS))
    assert (read["programs"], read["streams"]) == (1, [(media_ts.MEDIA_PID, media_ts.STREAM_TYPE)])
    assert read["sync_errors"] + read["continuity_errors"] + read["table_errors"] == 0


def test_damage_is_counted():
    stream = media_ts.mux(media_ts.payload_of("abc" * 9000)[0])
    packets = [stream[i : i + 188] for i in range(0, len(stream), 188)]
    lost = media_ts.parse(b"".join(packets[:10] + packets[11:]))
    assert lost["continuity_errors"] == 1
    again = media_ts.parse(b"".join(packets[:10] + [packets[9]] + packets[10:]))
    assert again["continuity_errors"] == 0 and again["payload"] == media_ts.parse(stream)["payload"]
    assert media_ts.parse(b"\0" + stream[1:])["sync_errors"] == 1 and media_ts.parse(stream[: 188 * 5 + 3])["sync_errors"] == 1
    assert media_ts.parse(None)["programs"] == 0 and media_ts.parse(stream[188:])["table_errors"] == 1


def test_table_checksums_follow_the_standard():
    assert media_ts.crc32_mpeg(b"123456789") == 0x0376E6E7


def test_media_columns_and_digest(spark):
    docs = frame(spark)
    rows = {r.doc_id: r for r in media_ts.digest(docs).collect()}
    full = media_ts.read(media_ts.store(docs).selectExpr("*", "1 as pts")).collect()
    for r in full:
        payload, n = media_ts.payload_of(TEXTS[r.doc_id] or "")
        d = rows[r.doc_id]
        assert bytes(r.ts_payload) == payload and r.ts_errors == 0 and r.ts_feature == d.feature and r.pts == 1
        assert (d.n_bytes, d.payload_bytes, d.payload_sha256, d.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (d.media_bytes, d.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest())
    assert rows[13].feature != rows[12].feature and media_ts.digest(frame(spark, [])).count() == 0
