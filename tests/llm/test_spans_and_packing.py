"""Repeated passages, packing and the pipeline against brute force."""

import random
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from voxmill.llm import decontaminate, exact_dedup, lang_id, near_dedup, packing, superkmers
from voxmill.llm import substring_dedup as sub
from voxmill.llm import suffix_dedup as suf
from voxmill.llm import textvec as tv

K = 12


def _windows(rows, k):
    where = defaultdict(set)
    for doc, text in rows:
        if doc is None or text is None:
            continue
        words = tv.words(pa.array([text], pa.string()))[0].tolist()
        for p in range(len(words) - k + 1):
            where[tuple(words[p : p + k])].add((doc, p))
    return [sorted(v) for v in where.values() if len(v) > 1]


def _isles(points, k):
    out = []
    for p in sorted(points):
        if out and p <= out[-1][1]:
            out[-1][1] = p + k
        else:
            out.append([p, p + k])
    return out


def _spans(rows, k):
    by = defaultdict(dict)
    for places in _windows(rows, k):
        for n, (doc, p) in enumerate(places):
            by[doc, n == 0][p] = (len(places), places[0][0])
    return {(doc, s, e, max(c for p, (c, _) in at.items() if s <= p < e), min(f for p, (_, f) in at.items() if s <= p < e), kept) for (doc, kept), at in by.items() for s, e in _isles(at, k)}


def _matches(rows, k):
    by = defaultdict(set)
    for places in _windows(rows, k):
        for (d0, p0), (d1, p1) in zip(places, places[1:]):
            by[d1, d0, p0 - p1].add(p1)
    return {(doc, s, e, source, s + shift) for (doc, source, shift), at in by.items() for s, e in _isles(at, k)}


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(9)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyz")
    shared = [[word() for _ in range(rng.randrange(8, 40))] for _ in range(6)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randrange(0, 5)):
            words += [word() for _ in range(rng.randrange(0, 30))]
            if rng.random() < 0.5:
                words += rng.choice(shared)
        rows.append((i, " ".join(words)))
    rows += [(70, "Go " * 90), (71, "go, go " * 30), (5, rows[5][1]), (72, None), (73, ""), (None, rows[1][1]), (74, rows[2][1].upper())]
    return rows


@pytest.fixture(scope="module")
def docs(spark, passages):
    return spark.createDataFrame([(a, b, a, "k") for a, b in passages], "doc_id long, text string, start_word long, kept string")


def test_repeated_spans_match_brute_force(docs, passages):
    assert {tuple(r) for r in sub.repeated_spans(docs, K).collect()} == _spans(passages, K)


def test_repeated_suffixes_match_brute_force(docs, passages):
    got = [tuple(r) for r in suf.repeated_suffixes(docs, K).collect()]
    assert len(got) == len(set(got)) and set(got) == _matches(passages, K)


def test_no_documents_no_spans(docs):
    assert sub.repeated_spans(docs.limit(0), K).count() == suf.repeated_suffixes(docs.limit(0), K).count() == 0


@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(2, 13), st.lists(st.integers(1, 20), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_bucket_pointers_sort_suffixes(words, depth, regions):
    n = len(words)
    ends = []
    while len(ends) < n:
        size = regions[len(ends) % len(regions)]
        ends += [min(n, len(ends) + size)] * size
    room = np.array(ends[:n]) - np.arange(n)
    pointers = suf.bucket_pointers(np.array(words), room, depth)
    deep = [p for p in range(n) if room[p] >= depth]
    key = {p: tuple(words[p : p + depth]) for p in deep}
    for a in deep:
        for b in deep:
            assert (pointers[a] < pointers[b]) == (key[a] < key[b]) and (pointers[a] == pointers[b]) == (key[a] == key[b])


@given(st.lists(st.lists(st.sampled_from("a b c dd ee".split()), max_size=40), min_size=1, max_size=5), st.integers(1, 12))
@settings(max_examples=100, deadline=None)
def test_super_kmers_hold_every_window_once(texts, k):
    want = Counter((i, p) for i, t in enumerate(texts) for p in range(len(t) - k + 1))
    got, by_window = Counter(), {}
    for row, first, count, key, begin, end, data in superkmers.super_kmers(pa.array([" ".join(t) for t in texts]), k):
        for r, f, c, m, b, e in zip(row, first, count, key, begin, end):
            words = data[b:e].tobytes().decode().split()
            assert words == texts[r][f : f + c]
            for p in range(c - k + 1):
                got[r, f + p] += 1
                assert by_window.setdefault(tuple(words[p : p + k]), m) == m
    assert got == want


def _bucket(rows, k):
    """A bucket of all super-k-mers of (doc, text) rows, as one shuffle partition holds them."""
    ids, texts = pa.array([d for d, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string())
    batches = [pa.RecordBatch.from_arrays([ids.slice(i, 50), texts.slice(i, 50)], names=["doc_id", "text"]) for i in range(0, len(rows), 50)]
    return superkmers.Bucket(superkmers._post(k, 1)(iter(batches)))


def _chain_windows(found):
    return Counter((d, p + i, c) for d, p, n, c in zip(found.doc.tolist(), found.pos.tolist(), found.length.tolist(), found.copies.tolist()) for i in range(n))


@pytest.mark.parametrize("bits", [64, 3, 0])
def test_chains_are_exact_whatever_the_hashes(passages, monkeypatch, bits):
    """Hashes of few bits collide all the time; words decide."""
    plain = tv.range_hash
    monkeypatch.setattr(tv, "range_hash", lambda values, begin, end: plain(values, begin, end) & np.uint64((1 << bits) - 1))
    monkeypatch.setattr(superkmers, "FLUSH", 2000)
    rows = [(d, t) for d, t in passages if d is not None and t is not None]
    bucket = _bucket(rows, K)
    count = bucket.strings.count
    words = np.unique(bucket.words, return_inverse=True)[1]
    room = np.repeat(bucket.at + count, count) - np.arange(len(words))
    monkeypatch.undo()
    want = Counter((d, p, len(places)) for places in _windows(rows, K) for d, p in places)
    for same in (tv.window_hash(bucket.words, K)[bucket.windows(K)], suf.bucket_pointers(words, room, K)[bucket.windows(K)]):
        assert _chain_windows(superkmers.chains(bucket, same, K)) == want


def test_a_passage_of_all_documents_is_held_once(monkeypatch):
    """The bucket's text does not grow with the copies, nor do the chains with the windows."""
    shared = " ".join(f"boiler{k}" for k in range(300))
    sizes = []
    for n in (100, 1000):
        rows = [(i, f"{' '.join(f'own{i}x{k}' for k in range(60))} {shared}") for i in range(n)]
        monkeypatch.setattr(superkmers, "HELD", 1 << 16)
        bucket = _bucket(rows, 50)
        inside = bucket.strings.count[np.bincount(bucket.strings.of) > 1].sum()
        found = superkmers.chains(bucket, tv.window_hash(bucket.words, 50)[bucket.windows(50)], 50)
        assert set(found.copies.tolist()) == {n} and _chain_windows(found).total() == n * 251
        sizes.append((inside, len(found.doc) / n))
    assert sizes[0] == sizes[1] and sizes[0][1] < 30


def test_very_long_texts_have_few_super_kmers(spark):
    """A text of one word, and one that repeats a page, of hundreds of thousands of words."""
    page = [f"w{k}" for k in range(500)]
    rows = [(1, "go " * 300_000), (2, " ".join(page * 400)), (3, " ".join(page)), (4, "x " * 49)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {tuple(r) for r in sub.repeated_spans(docs).collect()}
    assert (1, 0, 50, 299_951, 1, True) in spans and (1, 1, 300_000, 299_951, 1, False) in spans
    assert {s for s in spans if s[0] in (2, 3)} == {(2, 0, 549, 401, 2, True), (2, 500, 200_000, 401, 2, False), (3, 0, 500, 401, 2, False)}
    found = {tuple(r) for r in suf.repeated_suffixes(docs).collect()}
    assert {f for f in found if f[0] != 2} == {(1, 1, 300_000, 1, 0), (3, 0, 500, 2, 199_500)} | {f for f in found if f[0] == 3}
    assert (2, 500, 200_000, 2, 0) in found


# -- packing


def _optimum(sizes, capacity):
    best = len(sizes)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k, room in enumerate(rooms):
            if room >= sizes[i] and room not in rooms[:k]:
                go(i + 1, [*rooms[:k], room - sizes[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best


@given(st.lists(st.integers(1, 50), min_size=1, max_size=9), st.integers(50, 90))
@settings(max_examples=150, deadline=None)
def test_bin_completion_is_optimal_on_small_problems(sizes, capacity):
    sizes = sorted(sizes, reverse=True)
    bins = packing.bin_completion(sizes, capacity)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= capacity for b in bins)
    assert packing.lower_bound(sizes, capacity) <= len(bins) == _optimum(sizes, capacity)


def test_search_improves_on_best_fit():
    sizes = [44, 24, 24, 22, 21, 17, 8, 8, 6, 6]
    assert len(packing.best_fit_decreasing(sizes, 60)) >= len(packing.bin_completion(sizes, 60)) == _optimum(sizes, 60)
    wide = list(range(1, 1500))[::-1]
    assert len(packing.bin_completion(wide, 2048, 50)) <= len(packing.best_fit_decreasing(wide, 2048))


@given(st.lists(st.integers(1, 14), min_size=1, max_size=8), st.integers(0, 30))
@settings(max_examples=200, deadline=None)
def test_fillings_are_all_undominated_ones_least_waste_first(pieces, room):
    counts = Counter(pieces)
    values = sorted(counts, reverse=True)
    every = [()]
    for v in values:
        every = [(*f, *(v,) * n) for f in every for n in range(counts[v] + 1) if sum(f) + v * n <= room]

    def dominated(f):
        left, used = room - sum(f), Counter(f)
        return any(counts[v] > used[v] and low < v <= low + left for low in (0, *used) for v in values)

    want = {f for f in every if not dominated(f)}
    got = list(packing.fillings(values, counts, room))
    assert len(got) == len(set(got) - {None}) + got.count(None) and set(got) - {None} == want
    waste = [room - sum(f) for f in got if f is not None]
    assert waste == sorted(waste) and got[0] is not None


def test_search_settles_whole_groups():
    """Groups of production size that best-fit leaves above the bound."""
    rng = random.Random(1)
    for low, high in ((100, 500), (90, 480)):
        sizes = sorted((rng.randrange(low, high) for _ in range(packing.GROUP)), reverse=True)
        bound = packing.lower_bound(sizes, packing.CAPACITY)
        bins, looked = packing.search(sizes, packing.CAPACITY)
        assert len(packing.best_fit_decreasing(sizes, packing.CAPACITY)) > bound == len(bins) and 0 < looked < packing.NODES
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= packing.CAPACITY for b in bins)
    sizes = sorted((rng.randrange(500, 900) for _ in range(packing.GROUP)), reverse=True)
    began = time.process_time()
    bins, looked = packing.search(sizes, packing.CAPACITY)
    assert looked >= packing.NODES and len(bins) <= len(packing.best_fit_decreasing(sizes, packing.CAPACITY))
    assert time.process_time() - began < 30


def _check_packing(packed, lengths, capacity):
    pieces = defaultdict(list)
    sequences = defaultdict(list)
    for r in packed:
        pieces[r.doc_id].append((r.piece, r.n_words))
        sequences[r.sequence].append((r.position, r.n_words))
    assert {d: sum(n for _, n in p) for d, p in pieces.items()} == lengths
    for spans in sequences.values():
        spans.sort()
        assert sum(n for _, n in spans) <= capacity
        assert all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:]))
    return len(sequences)


def test_documents_are_packed_whole_and_tightly(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lengths = {r.doc_id: len(r.text.split()) for r in docs.collect()}
    n = _check_packing(packing.pack_documents(docs).collect(), lengths, packing.CAPACITY)
    assert n <= 1.02 * sum(lengths.values()) / packing.CAPACITY + 1


def test_packing_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "  "), (4, "w " * 10_000), (5, "a b"), (5, "a b"), (None, "x y z")]
    docs = spark.createDataFrame([(a, b, "s", 7) for a, b in rows], "doc_id long, text string, sequence string, grp long")
    packed = packing.pack_documents(docs).collect()
    _check_packing(packed, {1: 0, 2: 0, 3: 0, 4: 10_000, 5: 4, None: 3}, packing.CAPACITY)
    assert packing.pack_documents(docs.limit(0)).count() == 0


# -- pipeline


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """Every stage on what the one before kept, held against plain Python."""
    sf = "/root/testdata/sf0.001"
    source = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(90_001, "???", "en", "x", 3), (90_002, None, None, None, None), (None, "Thing of the and by the is", "en", "x", 26)], source.schema)
    docs, columns = source.unionByName(odd), source.columns
    benchmark = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, sf).write.parquet(out := f"{tmp_path}/{k}")
        docs = spark.read.parquet(out)
        rows = docs.collect()
        if name != "packing":
            assert docs.columns == columns
        if name == "language_id":
            assert set(before) - {r.doc_id for r in rows} == {90_001, 90_002}
        elif name == "exact_dedup":
            first = {}
            for d in sorted(before, key=lambda d: (d is None, d)):
                first.setdefault(before[d].text, d)
            assert {r.doc_id for r in rows} == set(first.values()) and len(rows) == len(first)
        elif name == "near_dedup":
            ids = [d for d in before if d is not None]
            prints, any_word = near_dedup.fingerprints(pa.array([before[d].text for d in ids], pa.string()))
            root = {d: d for d in ids}

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x

            for i, d in enumerate(ids):
                for j in np.flatnonzero(near_dedup.bits_apart(prints, prints[i]) <= near_dedup.MAX_BITS):
                    a, b = find(d), find(ids[j])
                    root[max(a, b)] = min(a, b)
            kept = {r.doc_id for r in rows}
            want = {d for d in ids if find(d) == d}
            assert len(want - kept) == 0 and len(kept - want - {None}) <= 0.1 * len(set(ids) - want) and None in kept
        elif name == "decontamination":
            items = [(i, tv.words(pa.array([t]))[0]) for i, t in benchmark.items()]
            for r in rows:
                words = tv.words(pa.array([r.text]))[0].tolist()
                grams = {tuple(words[p : p + decontaminate.LIMIT]) for p in range(len(words))}
                assert not any(tuple(w[p : p + decontaminate.LIMIT].tolist()) in grams for _, w in items for p in range(len(w) - decontaminate.LIMIT + 1))
                assert r.n_chars == len(r.text)
            assert any(before[r.doc_id].text != r.text for r in rows)
        else:
            _check_packing(rows, {d: len(b.text.split()) for d, b in before.items()}, packing.CAPACITY)


def test_run_applies_all_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = lang_id.train(lang_id.training_sample(docs))
    kept = near_dedup.drop_near_duplicates(exact_dedup.drop_exact_duplicates(lang_id.keep_identified(docs, model)))
    packed = corpus_pipeline.run(spark, sf)
    assert packed.select("doc_id").distinct().count() <= kept.count()
    assert {r.doc_id for r in packed.collect()} <= {r.doc_id for r in kept.collect()}


def test_clashing_and_extra_columns_pass_through(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "1 as part", "'x' as `row`", "array(1) as digest", "doc_id as keep_doc_id", "named_struct('text', 1) as item", "null as `print`")
    docs = docs.withColumn("print", docs["print"].cast("string"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert docs.count() > 100


def test_empty_table_passes_through(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.count() == 0
