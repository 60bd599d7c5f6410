"""Rows and passages that an operator once left out."""

import math
import random
from collections import Counter

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from voxmill.llm import decontaminate as dc
from voxmill.llm import lang_id as li
from voxmill.llm import licenses as lic
from voxmill.llm import queries

SF = "/root/testdata/sf0.01"


def brute_runs(words, item):
    """Contaminating runs (start, length), diagonal by diagonal."""
    out, covered = [], set()
    for d in range(-len(words), len(item)):
        run = 0
        for s in range(len(words) + 1):
            if s < len(words) and 0 <= s + d < len(item) and words[s] == item[s + d]:
                run += 1
                continue
            if run >= dc.MIN_MATCH:
                out.append((s - run, run))
                covered |= set(range(s - run + d, s + d))
            run = 0
    whole = len(covered) >= dc.COVERAGE * len(item)
    return [(s, n) for s, n in out if whole or n >= dc.LIMIT]


# -- licenses


def test_license_query_finds_all_five_kinds_of_line(spark):
    plain = [("MIT License.", "MIT"), ("Apache License, Version 2.0", "Apache-2.0"), ("CC BY-NC 4.0", "CC-BY-NC-4.0"), ("GNU General Public License, version 3", "GPL-3.0"), ("All rights reserved.", "Proprietary")]
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = Counter((d, name) for d, text in texts for part, name in plain for _ in range(text.count(part)))
    assert {name for _, name in want} == {name for _, name in plain}
    assert Counter((r.doc_id, r.license) for r in queries.op10_license_scan(spark, SF).collect()) == want


def test_long_reserved_notice_is_one_finding():
    scanner = lic.Scanner(lic.NOTICES)
    text = "x y. All rights reserved. Unauthorized copying of this file is prohibited. z"
    assert [(name, start, end) for _, name, _, start, end in scanner.scan(pa.array([text]))] == [("Proprietary", 2, 12)]


def test_altered_notices_beside_a_whole_one_are_found():
    """Each notice that keeps the coverage stands, whichever words it lacks."""
    rng = random.Random(6)
    for name, notice in lic.NOTICES:
        scanner = lic.Scanner([(name, notice)])
        template = notice.replace("-", " ").replace(".", " ").replace(",", " ").split()
        spare = len(template) - int(scanner.needed[0])
        filler = [f"filler{k}" for k in range(100)]
        for _ in range(20 if spare else 1):
            lost = set(rng.sample(range(1, len(template) - 1), min(spare, len(template) - 2)))
            altered = ["changed" if k in lost else w for k, w in enumerate(template)]
            text = " ".join([*template, *filler, *altered, *filler])
            starts = [start for _, _, _, start, _ in scanner.scan(pa.array([text]))]
            assert starts == [0, len(template) + 100], (notice, lost)


def test_grant_without_its_rarest_words_is_found():
    grant = next(text for _, text in lic.TEMPLATES if text.startswith("Permission"))
    altered = grant.replace("granted", "given").replace("charge", "cost").replace("person", "body")
    found = list(lic.Scanner().scan(pa.array([f"{grant} {'filler ' * 100} {altered}"])))
    assert [(name, round(share * 27)) for _, name, share, _, _ in found] == [("MIT", 27), ("MIT", 24)]


def _common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for k, y in enumerate(b):
            row.append(last[k] + 1 if x == y else max(last[k + 1], row[k]))
    return row[-1]


def test_notices_with_words_put_in_and_left_out_are_found():
    """Against the longest common subsequence, at random places of a text, as sparse as DENSITY allows."""
    rng = random.Random(12)
    for _ in range(150):
        template = [f"t{k}" for k in range(rng.randrange(6, 40))]
        scanner = lic.Scanner([("L", " ".join(template))])
        text, want = [], []
        for _ in range(rng.randrange(1, 4)):
            text += [f"f{rng.randrange(30)}" for _ in range(80)]
            keep = sorted(rng.sample(range(len(template)), rng.randrange(int(scanner.needed[0]), len(template) + 1)))
            strays = rng.randrange(0, max(1, int(len(keep) / lic.DENSITY) - len(keep)))
            notice = [template[k] for k in keep]
            for _ in range(strays):
                notice.insert(rng.randrange(1, len(notice)), "stray")
            assert _common(notice, template) == len(keep)
            want.append((len(text), len(text) + len(notice), len(keep)))
            text += notice
        text += ["f"] * 80
        got = [(start, end, round(share * len(template))) for _, _, share, start, end in scanner.scan(pa.array([" ".join(text)]))]
        assert got == want


def test_whole_license_texts_are_found_as_such():
    rng = random.Random(4)
    scanner = lic.Scanner(lic.LICENSES)
    for name, text in lic.TEXTS:
        words = text.split()
        for lost in (0, len(words) // 12):
            gone = set(rng.sample(range(1, len(words) - 1), lost))
            altered = " ".join("changed" if k in gone else w for k, w in enumerate(words))
            page = f"Copyright someone. {altered} {'def f x return x ' * 50} {altered}"
            found = [f for f in scanner.scan(pa.array([page])) if f[4] - f[3] > 0.7 * len(words)]
            assert [f[1] for f in found] == [name] * 2, (name, lost, found)


def test_templates_of_a_folder(tmp_path):
    (tmp_path / "B.txt").write_text("one two three four five six")
    (tmp_path / "A-2.0").write_text("seven eight nine ten eleven twelve")
    templates = lic.read_templates(str(tmp_path))
    assert [name for name, _ in templates] == ["A-2.0", "B"]
    found = list(lic.Scanner([*templates, ("empty", "")]).scan(pa.array(["x seven eight nine ten eleven twelve y one two three four five six", "", None])))
    assert [(row, name, start, end) for row, name, _, start, end in found] == [(0, "A-2.0", 1, 7), (0, "B", 8, 14)]


# -- decontamination


def test_cleaned_texts_do_not_depend_on_the_shards(spark):
    """Items that share a passage, in shards of their own: what one cuts is still judged by the others."""
    shared = " ".join(f"shared{k}" for k in range(30))
    tails = {i: " ".join(f"tail{i}x{k}" for k in range(6)) for i in range(8)}
    items = spark.createDataFrame([(i, f"{shared} {t}") for i, t in tails.items()], "item_id long, text string")
    rows = [(i, f"before it {shared} {t} and after", i, "x") for i, t in tails.items()] + [(90, f"{shared} {tails[3]}", 0, "y"), (91, None, 0, "z"), (92, "nothing of it", 13, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, runs string")
    want = sorted([(i, "before it and after", 19, "x") for i in tails] + [(91, None, 0, "z"), (92, "nothing of it", 13, "z")])
    assert len(list(dc.shards(items, 40))) > 2
    for size, together in ((dc.SHARD_WORDS, dc.SHARDS), (40, dc.SHARDS), (40, 1), (40, 3)):
        out = dc.remove_contamination(docs, items, size, together)
        assert out.schema == docs.schema and sorted(tuple(r) for r in out.collect()) == want


def test_random_cleaning_is_the_same_in_any_shards(spark):
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = spark.createDataFrame([(i, text(rng.randrange(5, 22))) for i in range(12)], "item_id long, text string")
    docs = spark.createDataFrame([(i, text(rng.randrange(0, 60))) for i in range(60)], "doc_id long, text string")
    one, many, passes = (sorted(map(tuple, dc.remove_contamination(docs, items, *n).collect())) for n in ((dc.SHARD_WORDS,), (30,), (30, 2)))
    assert one == many == passes


def test_spans_of_items_with_repeated_and_null_ids_match_brute_force(spark):
    """Every distinct text under an id is an item; a null id gives no spans."""
    rng = random.Random(11)
    text = lambda low, high: " ".join(rng.choice("abc") for _ in range(rng.randrange(low, high)))
    items = [(rng.choice([1, 2, 3, None]), text(3, 18)) for _ in range(16)]
    items += items[:3]
    docs = [(rng.choice([None, *range(30)]), text(0, 50)) for _ in range(40)]
    want = Counter()
    for i, q in set(items):
        if i is not None and len(q.split()) >= dc.MIN_MATCH:
            want.update((d, i, s, s + n) for d, t in docs for s, n in brute_runs(t.split(), q.split()))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size, together in ((dc.SHARD_WORDS, dc.SHARDS), (25, dc.SHARDS), (25, 2)):
        assert Counter(map(tuple, dc.contaminated_spans(*frames, size, together).collect())) == want


def test_the_automaton_decides(spark, monkeypatch):
    """Runs come from its states: one that says that nothing matches finds nothing."""
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine")], "item_id long, text string")
    texts = pa.array(["x one two three four five six seven eight nine y"])
    benchmark = dc.Benchmark(next(dc.passes(items, dc.SHARD_WORDS, dc.SHARDS)))
    assert list(benchmark.documents(texts)) == [(0, [(1, 1, 9)], 11)]
    monkeypatch.setattr(dc.SuffixAutomaton, "walk", lambda self, words: ((0, 0) for _ in words))
    assert not list(benchmark.documents(texts))


@given(st.lists(st.lists(st.integers(0, 2), max_size=9), max_size=4), st.lists(st.integers(0, 3), max_size=20), st.integers(1, 4))
@settings(max_examples=200, deadline=None)
def test_places_of_matches_match_brute_force(items, text, least):
    automaton = dc.SuffixAutomaton(items)
    all_words = [(i, e) for i, q in enumerate(items) for e in range(1, len(q) + 1)]
    at = {int(p): where for p, where in zip(automaton.place, all_words)}
    assert sorted(at) == list(range(len(all_words)))
    for end, (state, size) in enumerate(automaton.walk(text), 1):
        got = {(*at[p], n) for a, b, n in automaton.matches(state, size, least) for p in range(a, b)}
        want = set()
        for i, e in all_words:
            n = 0
            while n < min(e, end) and items[i][e - 1 - n] == text[end - 1 - n]:
                n += 1
            if n >= least:
                want.add((i, e, n))
        assert got == want


def test_every_text_of_an_item_is_looked_for(spark):
    one, two, nameless = (" ".join(f"{name}{k}" for k in range(12)) for name in ("a", "b", "n"))
    items = spark.createDataFrame([(1, two), (1, one), (1, one), (None, nameless)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {one} y"), (2, f"x {two} y"), (3, f"x {nameless} y"), (4, "x y")], "doc_id long, text string")
    for size in (dc.SHARD_WORDS, 20):
        assert sorted(map(tuple, dc.contaminated_spans(docs, items, size).collect())) == [(1, 1, 1, 13), (2, 1, 1, 13)]
        assert sorted(map(tuple, dc.remove_contamination(docs, items, size).collect())) == [(k, "x y") for k in (1, 2, 3, 4)]
    again = spark.createDataFrame([(7, one)], "item_id long, text string")
    assert [tuple(r) for r in dc.contaminated_spans(docs, again).collect()] == [(1, 7, 1, 13)]


# -- language


def test_a_small_share_of_a_long_document_is_found(spark):
    """1 % of a second language in 20,000 words, for which the penalised likelihood pays."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").filter("n_chars between 1000 and 5000").orderBy("doc_id").collect()
    by = {k: [w for r in rows if r.lang == k and "|" not in r.text for w in r.text.split()] for k in ("en", "fr")}
    model = li.train([(r.lang, r.text) for r in rows])
    en, fr = (by["en"] * 40)[:19_800], by["fr"][:200]
    shares, _ = li.infer(model, pa.array([" ".join(en + fr)]))
    assert 0.005 < shares[0][model.names.index("fr")] < 0.02


def _plain_em(odds, allowed):
    """(shares, log-likelihood) of a mixture over some components, in plain floats to the end."""
    share = {k: 1 / len(allowed) for k in allowed}
    for _ in range(20_000):
        new = dict.fromkeys(allowed, 0.0)
        for word in odds:
            total = sum(share[k] * word[k] for k in allowed)
            for k in allowed:
                new[k] += share[k] * word[k] / total / len(odds)
        done = max(abs(new[k] - share[k]) for k in allowed) < 1e-9
        share = new
        if done:
            break
    return share, sum(math.log(sum(share[k] * word[k] for k in allowed)) for word in odds)


def test_mixtures_match_brute_force(spark):
    """Shares and language sets against plain expectation-maximisation over every set size."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").filter("n_chars between 200 and 900").orderBy("doc_id").collect()
    model = li.train([(r.lang, r.text) for r in rows[:150]])
    rng = random.Random(3)
    words = [r.text.split() for r in rows[150:400]]
    texts = [" ".join(w for part in rng.sample(words, rng.randrange(1, 4)) for w in part[: rng.randrange(1, 40)]) for _ in range(25)]
    shares, counts = li.infer(model, pa.array(texts))
    for text, got, n in zip(texts, shares, counts):
        slots, begin, _ = li.gram_slots(pa.array([text]))
        logs = [model.logs[slots[a:b]].astype(float).sum(axis=0) for a, b in zip(begin, [*begin[1:], len(slots)])]
        top = [x.max() for x in logs]
        odds = [[math.exp(v - t) for v in x] for x, t in zip(logs, top)]
        full, _ = _plain_em(odds, list(range(len(model.names))))
        order = sorted(full, key=lambda k: (-full[k], k))
        best = max(((fit - 0.5 * math.log(max(n, 2)) * (2 * size - 1), share) for size in range(1, len(order) + 1) for share, fit in [_plain_em(odds, order[:size])]), key=lambda x: x[0])
        assert max(abs(got[k] - best[1].get(k, 0.0)) for k in range(len(model.names))) < 0.01
        assert {k for k in range(len(got)) if got[k] > 0} == set(best[1])


def test_training_rows_do_not_hang_on_ids(spark):
    """Rows that share an id, or have none, and rows that are repeated all leave their label a sample."""
    rows = [(None, f"text number {i} of it", "nameless") for i in range(600)] + [(i % 3, f"words {i} and more", "three") for i in range(600)] + [(7, "always the same", "copies")] * 600 + [(8, None, "null"), (9, "seldom", "rare")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = li.training_sample(docs, 10)
    assert Counter(label for label, _ in sample) == {"nameless": 10, "three": 10, "copies": 1, "rare": 1} and len(set(sample)) == len(sample)
    assert {label for label, _ in li.training_sample(docs, 10, labels=2)} == {"copies", "nameless"}


def test_sets_that_are_left_out_would_lose(spark, monkeypatch):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(300).collect()
    texts = pa.array([r.text for r in rows] + ["", None, "x", "der the la"])
    model = li.train([(r.lang, r.text) for r in rows])
    bounded, _ = li.infer(model, texts)
    monkeypatch.setattr(li, "_most", lambda odds, first, share, fit: li.np.full(len(fit), li.np.inf))
    assert (bounded == li.infer(model, texts)[0]).all()
