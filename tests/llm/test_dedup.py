"""Exact and near deduplication against brute force, and their edge cases."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxmill.llm import exact_dedup as ed
from voxmill.llm import golay
from voxmill.llm import near_dedup as nd
from voxmill.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@given(st.lists(st.tuples(st.sampled_from("idf"), st.integers(0, 40)), max_size=300))
@settings(max_examples=60, deadline=None)
def test_cuckoo_index_follows_a_dict(ops):
    index, live = ed.CuckooIndex(4), {}
    for op, k in ops:
        text = f"text {k}"
        key = ed.digest(text) if k % 3 else 7  # every third shares a digest
        if op == "i" and index.find(key, text) is None:
            index.insert(key, text, [k])
            live[k] = True
        elif op == "d":
            assert index.delete(key, text) == bool(live.pop(k, False))
        assert (index.find(key, text) is not None) == (k in live)


def test_cuckoo_index_grows_from_its_keys():
    index = ed.CuckooIndex(4)
    for k in range(5000):
        index.insert(ed.digest(str(k)), str(k), k)
    assert index.resizes > 3
    assert all(index.find(ed.digest(str(k)), str(k)) == k for k in range(5000))
    assert sum(index.suspects(ed.digest(f"x{k}")) for k in range(5000)) < 50


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, "a", "x", 1), (1, "a", "b", 1), (None, "a", "c", 1), (2, None, "z", 1), (3, None, "z", 1), (4, "", "q", 1), (5, "", "q", 1), (6, "u", None, None), (7, "w " * 200_000, "l", 1), (8, "w " * 200_000, "l", 1)]
    return spark.createDataFrame([(a, b, c, d, c, "p", c) for a, b, c, d in rows], "doc_id long, text string, lang string, n_chars long, part string, `print` string, node string")


def test_exact_duplicates_of_odd_rows(odd):
    found = sorted(ed.exact_duplicates(odd).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [tuple(r) for r in found] == [(1, 1, 3), (5, 4, 2), (8, 7, 2), (None, 1, 3)]
    kept = ed.drop_exact_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id, r.lang) for r in kept.collect()) == [(1, "b"), (2, "z"), (3, "z"), (4, "q"), (6, None), (7, "l")]
    assert ed.exact_duplicates(odd.limit(0)).count() == ed.drop_exact_duplicates(odd.limit(0)).count() == 0


def test_live_and_deleted_documents(spark):
    docs = spark.createDataFrame([(10, "a"), (11, "b"), (12, "c")], "doc_id long, text string")
    live = spark.createDataFrame([(90, "a"), (91, "b")], "doc_id long, text string")
    gone = spark.createDataFrame([(91, "b")], "doc_id long, text string")
    assert [tuple(r) for r in ed.exact_duplicates(docs, live, gone).collect()] == [(10, 90, 2)]


def test_exact_duplicates_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first, want = {}, set()
    for r in docs.orderBy("doc_id").collect():
        if first.setdefault(r.text, r.doc_id) != r.doc_id:
            want.add((r.doc_id, first[r.text]))
    assert {(r.doc_id, r.keep_doc_id) for r in ed.exact_duplicates(docs).collect()} == want
    assert ed.drop_exact_duplicates(docs).count() == len(first)


def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 23, 400)
    a = golay.keys(v)
    assert set((a >= 0).sum(axis=1)) <= {1, 6}
    for i in range(23):
        for j in range(i, 23):
            b = golay.keys(v ^ (1 << i) ^ (0 if i == j else 1 << j))
            assert all(set(x[x >= 0]) & set(y[y >= 0]) for x, y in zip(a, b))


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    want = {(x, find(x)) for x in root}
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {p for p in want if sum(q[1] == p[1] for q in want) > 1}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _brute(ids, prints, any_word):
    root = {int(i): int(i) for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = set()
    keep = np.flatnonzero(any_word)
    for n, i in enumerate(keep):
        for j in keep[n + 1 :][nd.bits_apart(prints[keep[n + 1 :]], prints[i]) <= nd.MAX_BITS]:
            a, b = find(int(ids[i])), find(int(ids[j]))
            root[max(a, b)] = min(a, b)
            pairs.add((int(ids[i]), int(ids[j])))
    return {(x, find(x)) for x in root if find(x) != x}, pairs


def test_near_duplicates_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").orderBy("doc_id").toPandas()
    prints, any_word = nd.fingerprints(pa.array(rows["text"], pa.string()))
    want, pairs = _brute(rows["doc_id"].to_numpy(), prints, any_word)
    got = {tuple(r) for r in nd.near_duplicates(docs).collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 0.02 * len(want)
    # recall of pairs: all pairs that meet in a bucket, of those that brute force finds
    keys, of = nd.key_table(prints)
    buckets = {}
    for k, r in zip(keys.tolist(), of.tolist()):
        buckets.setdefault(k, set()).add(r)
    met = {(a, b) for m in buckets.values() if len(m) > 1 for a in m for b in m if a < b}
    place = {int(d): i for i, d in enumerate(rows["doc_id"])}
    assert sum((min(place[a], place[b]), max(place[a], place[b])) in met for a, b in pairs) >= 0.9 * len(pairs)


def test_crowded_buckets_keep_all_members(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(240)]
    rows = []
    for i in range(400):
        copy = list(words)
        for _ in range(5):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    rows.append((1000, " ".join(f"other{i}" for i in range(240))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in nd.near_duplicates(docs).collect()} == {(i, 0) for i in range(1, 400)}
    assert sorted(r.doc_id for r in nd.drop_near_duplicates(docs).collect()) == [0, 1000]


def test_near_dedup_of_odd_rows(odd):
    assert nd.near_duplicates(odd).collect() == [(8, 7)]
    kept = nd.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert [d for d, _ in got if d is not None] == [1, 2, 3, 4, 5, 6, 7]
    assert sum(d is None for d, _ in got) == 1
    assert nd.drop_near_duplicates(odd.limit(0)).count() == 0
