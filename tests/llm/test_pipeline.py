"""The pipeline on a small corpus: each stage's decisions, brute force beside, and the whole run."""

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from quarrylight.llm import queries, retrieval_packing  # noqa: E402

RNG = np.random.default_rng(9)
VOCABULARY = ["".join(RNG.choice(["ta", "ri", "mo", "len", "su", "ka"], k)) for k in (1, 2, 3) for _ in range(150)]


def prose(n):
    return " ".join(RNG.choice(VOCABULARY, n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("tables"))
    passage, leak = prose(70), prose(16)
    texts = [prose(int(n)) for n in RNG.integers(60, 140, 90)]
    texts += ["@@@### " * 80, "|||&&& " * 60]  # 90, 91: junk
    texts += [texts[0], " ".join([*texts[1].split()[:-1], "moka"])]  # 92, 93: copies
    texts += [f"{prose(40)} {passage} {prose(30)}", f"{prose(50)} {passage} {prose(20)}"]  # 94, 95: a shared passage
    texts += [f"{prose(60)} {leak} {prose(10)}"]  # 96: benchmark
    texts += [None, ""]
    rows = [(i, t, "en", "s0", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(90)] + [(90, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, leak), (2, prose(12))], "item_id bigint, text string").write.parquet(f"{base}/benchmark.parquet")
    return base, texts, passage, leak


def test_stages_keep_columns_and_decide(spark, corpus, tmp_path):
    base, texts, passage, leak = corpus
    docs = spark.read.parquet(f"{base}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "retrieval_packing"]
    after = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, base).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after.append({r.doc_id: r.text for r in docs.collect()})
    good, single, cut, clean = after
    assert not {90, 91, 97, 98} & set(good) and len(set(range(90)) - set(good)) <= 3
    assert {92, 93}.isdisjoint(single) and {0, 1, 94, 95, 96} <= set(single) and set(good) - set(single) <= {92, 93}
    assert passage in cut[94] and passage not in cut[95] and all(cut[i] == texts[i] for i in cut if i != 95)
    assert leak not in clean[96] and clean[96].startswith(texts[96][:50]) and all(clean[i] == cut[i] for i in clean if i != 96)
    pieces = retrieval_packing.packed(docs).groupBy("doc_id").sum("length").count()
    assert pieces == len(clean)


def test_the_run_packs_what_stays(spark, corpus):
    base = corpus[0]
    rows = corpus_pipeline.run(spark, base).collect()
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"} <= set(rows[0].asDict())
    assert {0, 1, 94, 95, 96} <= {r.doc_id for r in rows} and not {90, 91, 92, 93} & {r.doc_id for r in rows}
    assert all(len(r.ids) == 4 * r.length for r in rows)


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(queries.queries())
