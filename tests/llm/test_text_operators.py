"""Decontamination, licenses, suffix dedup, SimHash, toxicity and the quality classifier against brute force and on edges."""

import re

import numpy as np
import pytest

from quarrylight.llm import decontaminate, kneser_ney, licenses, simhash, suffix_dedup, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
RNG = np.random.default_rng(3)
VOCABULARY = [f"w{i}" for i in range(900)]


def prose(n):
    return " ".join(RNG.choice(VOCABULARY, n))


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids or range(len(texts)), texts, strict=True)], DOCS)


EDGES = [None, "", "  \n\t ", "one", "one two", "é ü ÀB", "x " * 4000, "same text here", "same text here"]


# -- decontamination

def brute_hits(text, items, n=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own, covered, named = words(text), set(), set()
    for k, t in items:
        w = words(t)
        size = min(n, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            for j in range(len(own) - size + 1):
                if own[j : j + size] == w[i : i + size]:
                    covered |= set(range(j, j + size))
                    named.add(str(k))
    return len(own), len(covered), sorted(named)


def leaky(spark):
    items = [(1, prose(14)), (2, "Only Three words"), (10, prose(10)), (3, None), (4, "?!"), (1, prose(12))]
    texts = [prose(40), f"{prose(20)} {items[0][1]} {prose(5)}", f"A. {items[0][1].upper()}! {items[2][1]}", "only, three WORDS", "only three", items[5][1], *EDGES]
    return texts, items, spark.createDataFrame(items, "item_id bigint, text string")


def test_decontamination_matches_brute_force_and_has_edges(spark):
    texts, items, benchmark = leaky(spark)
    rows = {r.doc_id: r for r in decontaminate.digest(frame(spark, texts), benchmark).collect()}
    for i, t in enumerate(texts):
        n_words, n_hit, named = brute_hits(t, items)
        r = rows[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n_words, n_hit, len(named), n_hit > 0)


def test_decontamination_beyond_the_broadcast_bound_is_the_same(spark):
    texts, _, benchmark = leaky(spark)
    key = lambda r: (r.doc_id, r.n_hit, r.items_sha256)
    small = decontaminate.digest(frame(spark, texts), benchmark, max_bytes=300).collect()
    assert sorted(map(key, small)) == sorted(map(key, decontaminate.digest(frame(spark, texts), benchmark).collect()))


def test_decontamination_cuts_spans_and_keeps_clean_rows_with_clashing_columns(spark):
    texts, items, benchmark = leaky(spark)
    docs = frame(spark, texts).selectExpr("*", "1 as hits", "2 as item_id", "3 as h")
    kept = {r.doc_id: r for r in decontaminate.remove_spans(docs, benchmark).collect()}
    assert kept[0].text == texts[0] and kept[0].hits == 1 and kept[6].text is None
    assert brute_hits(kept[1].text, items)[1] == 0 and kept[1].n_chars == len(kept[1].text)
    assert 3 not in kept and 5 not in kept and 4 in kept


def test_decontamination_of_empty_tables(spark):
    _, _, benchmark = leaky(spark)
    assert decontaminate.digest(frame(spark, []), benchmark).count() == 0
    assert decontaminate.digest(frame(spark, ["a b"]), benchmark.limit(0)).first().contaminated is False


# -- licenses

def test_license_scan_finds_exact_edited_and_embedded_templates(spark):
    mit = licenses.MIT.split()
    edited = " ".join(w for i, w in enumerate(mit) if i % 25 != 7)
    texts = [prose(60), f"{prose(9)} {licenses.MIT} {prose(9)}", f"{prose(3)} {edited}", "All Rights Reserved.", " ".join(mit[:20]), f"Released under the MIT License. {prose(30)} All rights reserved.", *EDGES]
    rows = {r.doc_id: r for r in licenses.scan(frame(spark, texts).selectExpr("*", "1 as license")).collect()}
    assert rows[0].n_matches == 0 and rows[0].license is None
    assert rows[1].license == "MIT" and rows[1].coverage == 1.0 and rows[1].matches[0].begin == 9
    assert rows[2].license == "MIT" and rows[2].coverage > 0.9
    assert rows[3].license == "Proprietary notice" and rows[4].n_matches == 0 and rows[5].n_matches == 2
    assert all(rows[i].n_matches == 0 for i in range(6, len(texts)))
    assert licenses.scan(frame(spark, [])).count() == 0


def test_adjacent_notices_are_all_found():
    index = licenses.Index(licenses.TEMPLATES)
    notices = {k: t for k, t in licenses.TEMPLATES if len(t.split()) < 14}
    for k, t in notices.items():
        size = len(licenses.words_of(t))
        for times in (1, 2, 3, 40):
            for between in range(4):
                words, spans = [], []
                for _ in range(times):
                    spans.append((len(words), len(words) + size))
                    words += [*licenses.words_of(t), *["zz"] * between]
                numbers = np.array([index.number.get(w, 0) for w in words])
                assert [(b, e, index.names[n]) for b, e, n, _, _ in index.matches(numbers, 0.6)] == [(*x, k) for x in spans]


def test_a_fragment_does_not_hide_an_edited_notice():
    t = list(range(1, 11))
    text = np.array([*t[:5], 0, 0, 0, *t[:2], 0, *t[3:5], 0, *t[6:8], 0, t[9]])
    assert [n for _, _, n in licenses.occurrences(t, text, -20, 20, 0.6)] == [7]


def test_alignment_equals_full_local_alignment():
    for _ in range(30):
        t = RNG.integers(1, 5, 8).tolist()
        d = np.array([*RNG.integers(1, 5, 3), *t[:3], *RNG.integers(1, 5, 1), *t[4:], *RNG.integers(1, 5, 2)])
        score = np.zeros((len(t) + 1, len(d) + 1), int)
        for i in range(len(t)):
            for j in range(len(d)):
                score[i + 1, j + 1] = max(0, score[i, j] + (2 if t[i] == d[j] else -1), score[i, j + 1] - 1, score[i + 1, j] - 1)
        begin, end, n = licenses.align(t, d, -20, 20)
        assert n >= 1 and 0 <= begin < end <= len(d) and score.max() <= 2 * n


# -- suffix dedup

def brute_repeats(rows):
    """rows of (id, text) with unique ids: the spans of each."""
    owner, first, out = {}, {}, {}
    for i, t in sorted(rows):
        owner.setdefault(t or "", i)
    for i, t in sorted(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        covered = np.zeros(len(w) + 2, int)
        if owner[t or ""] != i:
            covered[1:-1] = len(w) >= 50
        else:
            for p in range(len(w) - 49):
                k = first.setdefault(tuple(w[p : p + 50]), (i, p))
                if k[0] != i or p - k[1] >= 50:
                    covered[p + 1 : p + 51] = 1
        edges = np.flatnonzero(np.diff(covered))
        out[i] = [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)]
    return out


def repeating():
    shared, other = prose(70), prose(55)
    words = shared.split()
    near = [" ".join([*words[:k], "edit", *words[k + 1 :]]) for k in range(0, 70, 9)]
    return [f"{prose(30)} {shared} {prose(20)}", f"{shared} {prose(10)}", f"{prose(5)} {other}", f"{other} {prose(8)} {shared}", prose(120), *near, "x " * 300, "x " * 200, f"{prose(49)}", f"{other}\n\n{other}", *EDGES]


def test_suffix_dedup_equals_brute_force(spark):
    texts = repeating()
    found = {r.doc_id: [(x.begin, x.end) for x in r.spans] for r in suffix_dedup.digest(frame(spark, texts)).collect()}
    assert found == brute_repeats(list(enumerate(texts)))


def test_suffix_dedup_of_hot_grams_is_the_same(spark):
    texts = repeating()
    found = {r.doc_id: [(x.begin, x.end) for x in r.spans] for r in suffix_dedup.digest(frame(spark, texts), hot=2).collect()}
    assert found == brute_repeats(list(enumerate(texts)))


def test_suffix_dedup_cuts_later_occurrences_only(spark):
    texts = repeating()
    kept = {r.doc_id: r for r in suffix_dedup.remove_repeats(frame(spark, texts).selectExpr("*", "1 as spans", "2 as a")).collect()}
    assert kept[0].text == texts[0] and kept[4].text == texts[4] and kept[0].spans == 1
    assert len(kept[1].text.split()) == 10 and kept[1].n_chars == len(kept[1].text)
    again = suffix_dedup.digest(frame(spark, [r.text for r in kept.values()])).where("n_spans > 0")
    assert again.count() == 0


def test_suffix_dedup_with_null_and_repeated_ids(spark):
    t = prose(60)
    rows = suffix_dedup.digest(frame(spark, [t, t, t, prose(60)], [None, 5, 5, 6])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_repeated) for r in rows) == [(False, 5, 0), (False, 5, 0), (False, 6, 0), (True, 0, 60)]
    assert suffix_dedup.digest(frame(spark, [])).count() == 0


# -- SimHash

def brute_components(prints, budget):
    n = len(prints)
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("budget", [0, 1, 2, 3, 6, 8])
def test_trie_join_and_masks_lose_no_link(budget):
    base = [int(x) for x in RNG.integers(0, 2**63, 60)]
    values = sorted({x ^ sum(1 << int(b) for b in set(RNG.integers(0, 64, k))) for x in base for k in (0, 1, 2, 3, 7, 9)})
    assert simhash.trie_join(np.array(values, np.uint64), budget) == brute_components(values, budget)
    keys = simhash.masks(budget)
    for _ in range(200):
        flipped = sum(1 << int(b) for b in RNG.choice(64, budget, replace=False))
        assert any(not flipped & m for m in keys)


@pytest.mark.parametrize("hot", [100_000, 1])
def test_near_duplicates_equal_brute_force(spark, hot):
    words = prose(80).split()
    texts = [" ".join([*words[:k], *RNG.choice(VOCABULARY, 1), *words[k + 1 :]]) for k in range(0, 80, 8)] + [prose(30) for _ in range(15)] + EDGES
    rows = {r.doc_id: r for r in simhash.near_duplicates(frame(spark, texts).selectExpr("*", "1 as fp"), hot=hot).collect()}
    prints = [simhash.fingerprint(t or "") for t in texts]
    assert [rows[i].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [rows[i].component_id for i in range(len(texts))] == brute_components(prints, 2)
    assert prints[len(texts) - len(EDGES)] == 0


def test_representatives_keep_one_of_each_group(spark):
    a, b = prose(100), prose(100)
    near = " ".join([*a.split()[:-1], "tail"])
    docs = frame(spark, [a, near, b, b, None, None, prose(50), b], [7, 3, 9, 9, 4, 5, None, None])
    kept = simhash.representatives(docs, shingle=5, budget=8).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in kept) == [-1, 3, 4, 9]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def brute_kept(texts, similarity):
    """Least number of each group of texts linked by the Jaccard similarity of their 5-word shingles."""
    sets, up = [set(simhash.shingles(t or "", 5)) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    return sorted(set(up))


def test_the_near_copies_of_the_pipeline_are_those_of_brute_force(spark):
    import corpus_pipeline

    texts = list(EDGES)
    for n in (60, 120, 300, 1000):
        for _ in range(6):
            words = prose(n).split()
            texts.append(" ".join(words))
            for share in (0.005, 0.015, 0.02, 0.03, 0.05):
                edited = list(words)
                for k in RNG.choice(n, max(1, int(share * n)), replace=False):
                    edited[k] = "edited"
                texts.append(" ".join(edited))
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, frame(spark, texts), "").collect())
    assert kept == brute_kept(texts, 0.8)


def test_a_bucket_gives_the_nearest_pairs_of_unequal_roots():
    fp, root = RNG.integers(0, 1 << 20, 300).astype(np.uint64), RNG.integers(0, 4, 300)
    apart = lambda i, j: (int(fp[i]) ^ int(fp[j])).bit_count()
    near = {i: sorted((apart(i, j), j) for j in range(i) if root[i] != root[j] and apart(i, j) <= 7) for i in range(300)}
    for most in (1, 16, 256):
        pairs, more = simhash.bucket_pairs(fp, root, most, 7)
        assert sorted(pairs) == sorted((i, j) for i, x in near.items() for _, j in x[:most])
        assert more == any(len(x) > most for x in near.values())


def test_crowded_buckets_give_the_same_components(spark):
    texts = list(EDGES)
    for n in (30, 90):
        words = prose(n).split()
        for _ in range(40):
            edited = list(words)
            for k in RNG.choice(n, 1 + n // 40, replace=False):
                edited[k] = str(RNG.choice(VOCABULARY))
            texts.append(" ".join(edited))
    kept = [sorted(r.component_id for r in simhash.verified_duplicates(frame(spark, texts), 0.5, shingle=5, crowd=c).collect()) for c in (4096, 3)]
    assert kept[0] == kept[1] and len(set(kept[0])) < len(texts) - 40


def test_parities_bound_the_difference_of_sets():
    pool = RNG.integers(0, 1 << 63, 3000).astype(np.uint64)
    sets = [np.unique(RNG.choice(pool, k)) for k in (1, 2, 30, 31, 33, 120, 500, 500, 2000)]
    gaps = simhash.parity_gaps([simhash.parity(x) for x in sets])
    x, y = (a.ravel() for a in np.indices((len(sets), len(sets))))
    for i, j, gap in zip(x.tolist(), y.tolist(), gaps(x, y).tolist(), strict=True):
        assert gap <= len(np.setxor1d(sets[i], sets[j])) and (i != j or gap == 0)
    far = simhash.parity_gaps([simhash.parity(pool[:500]), simhash.parity(pool[1000:1500])])
    assert far(np.array([0]), np.array([1]))[0] > 2 * 500 / 9


@pytest.mark.parametrize("crowd", [1024, 20])
def test_a_group_below_the_similarity_is_not_compared_pair_by_pair(spark, monkeypatch, crowd):
    """Copies of one text, each with own edits: all meet in the bands, few pairs are similar."""
    words, texts, met, similar = prose(300).split(), [], [], simhash._similar
    for n in range(120):
        edited = list(words)
        for k in RNG.choice(300, 10 if n >= 20 else 4, replace=False):
            edited[k] = f"edit{n}"
        texts.append(" ".join(edited))

    def counted(pairs, sets, similarity):
        met.append(pairs.count())
        return similar(pairs, sets, similarity)

    monkeypatch.setattr(simhash, "_similar", counted)
    found = simhash.verified_duplicates(frame(spark, texts), 0.8, shingle=5, crowd=crowd).collect()
    assert sorted({r.component_id for r in found}) == brute_kept(texts, 0.8)
    assert len({r.component_id for r in found}) > 60 and sum(met) < 4 * len(texts)


# -- toxicity

def test_toxicity_separates_held_out_texts(spark):
    marks = ["vileword", "badlingo", "nastyterm", "foulspeak"]
    rows = []
    for i in range(700):
        words = prose(40).split()
        if bad := i % 3 == 0:
            for k in RNG.choice(40, 3, replace=False):
                words[k] = str(RNG.choice(marks))
        rows.append((i, " ".join(words), int(bad)))
    docs = frame(spark, [t for _, t, _ in rows] + EDGES).selectExpr("*", "1 as score", "0 as toxic")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (5000, 1, None)], "doc_id bigint, quality int, toxic int")
    found = {r.doc_id: r for r in toxicity.scored(docs, toxicity.train(docs, labels)).collect()}
    held = [(found[i].predicted, y) for i, _, y in rows if found[i].held_out]
    assert len(found) == 700 + len(EDGES) and len(held) > 100
    assert np.mean([p == y for p, y in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found.values())
    assert found[700].score == found[701].score and found[707].score == found[708].score


def test_toxicity_without_labels_gives_the_prior(spark):
    docs = frame(spark, ["a b", None])
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in toxicity.scored(docs, toxicity.train(docs, labels)).collect()} == {0.5}
    assert toxicity.scored(docs.limit(0), toxicity.Model([], [], [])).count() == 0


# -- quality

def kneser_ney_by_hand(trusted, texts, order=5):
    """Probabilities by the definition, with dictionaries."""
    from collections import Counter

    tables = {order: Counter(g for t in trusted for g in kneser_ney.grams([t])[0].tolist())}
    for n in range(order - 1, 0, -1):
        tables[n] = Counter(g & ((1 << 8 * n) - 1) for g in tables[n + 1])
    reduced = {}
    for n, c in tables.items():
        k = [sum(v == i for v in c.values()) for i in range(1, 5)]
        if all(k):
            y = k[0] / (k[0] + 2 * k[1])
            d = (1 - 2 * y * k[1] / k[0], 2 - 3 * y * k[2] / k[1], 3 - 4 * y * k[3] / k[2])
            reduced[n] = tuple(min(max(x, 0.05), i - 0.05) for i, x in enumerate(d, 1))
        else:
            reduced[n] = (0.5, 0.75, 0.9)

    def p(g, n):
        if n == 0:
            return 1 / 256
        followers = [c for x, c in tables[n].items() if x >> 8 == g >> 8]
        low = p(g & ((1 << 8 * (n - 1)) - 1), n - 1)
        if not followers:
            return low
        d = lambda c: 0 if c == 0 else reduced[n][min(c, 3) - 1]
        c = tables[n].get(g, 0)
        return (c - d(c)) / sum(followers) + sum(map(d, followers)) / sum(followers) * low

    out = []
    for t in texts:
        g = kneser_ney.grams([t or ""])[0].tolist()
        out.append(float(np.exp(-np.mean([np.log(p(x, order)) for x in g]))) if g else None)
    return out


def test_kneser_ney_equals_the_definition(spark):
    import zlib

    good = [f"the cat {w} on the mat and the dog {v} it" for w in ("sat", "sang", "slept", "stood", "ran") for v in ("saw", "bit", "fed")]
    texts = [*good, "the the the the the", "@@@ %%% |||", None, "", "été à la mer"]
    docs = frame(spark, texts).selectExpr("*", "1 as score", "2 as g", "3 as block")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(len(good))] + [(len(good), 0, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    rows = {r.doc_id: r for r in kneser_ney.scored(docs, labels).collect()}
    trusted = [t for i, t in enumerate(good) if zlib.crc32(str(i).encode()) % kneser_ney.FOLDS]
    for i, expected in enumerate(kneser_ney_by_hand(trusted, texts)):
        assert rows[i].perplexity == (None if expected is None else pytest.approx(expected, rel=1e-4))
    assert rows[len(good) + 2].rejected and rows[len(good) + 1].rejected and not rows[0].rejected


def test_quality_keeps_rows_and_columns(spark):
    good = [prose(40) for _ in range(60)]
    texts = [*good, "### " * 100, None, good[0]]
    docs = frame(spark, texts, [*range(61), None, 0]).selectExpr("*", "1 as perplexity", "2 as t")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id bigint, quality int, toxic int")
    kept = kneser_ney.keep(docs, labels)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 60 not in ids and None not in ids and ids.count(0) == 2 and len(ids) >= 55
    assert kneser_ney.keep(docs.limit(0), labels).count() == 0
    assert kneser_ney.keep(docs, labels.limit(0)).count() == 62
