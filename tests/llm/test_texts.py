"""Language, HTML, token counts, licenses and decontamination."""

import random
import re
import time
from html.parser import HTMLParser

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxmill.llm import decontaminate as dc
from voxmill.llm import html_extract as hx
from voxmill.llm import lang_id as li
from voxmill.llm import licenses as lic
from voxmill.llm import token_counts as tc
from voxmill.llm import textvec as tv

LONG = "word " * 200_000


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None), (None, "the thing is on the table and it was by the door"), (2, ""), (3, "!!! ??? ..."), (4, LONG), (5, "same text here of the"), (5, "same text here of the")]
    return spark.createDataFrame([(a, b, None if a == 2 else "en", "x", 1.5) for a, b in rows], "doc_id long, text string, lang string, words string, coverage double")


# -- words


def test_words_are_cut_as_documented():
    x = pa.array(["The  quick, “fox” a’b 漢字か", None, "", "É été—the", "fox ÉTÉ"])
    h, first = tv.words(x)
    assert first.tolist() == [0, 8, 8, 8, 11, 13]
    assert h[2] == h[11] and h[9] == h[12]
    sliced = tv.words(x.slice(3, 2))[0]
    assert sliced.tolist() == h[8:].tolist()


@given(st.lists(st.text(alphabet="ab é“漢 ,.", max_size=30), min_size=1, max_size=8))
@settings(max_examples=100, deadline=None)
def test_word_counts_do_not_depend_on_neighbours(texts):
    _, first = tv.words(pa.array(texts))
    alone = [len(tv.words(pa.array([t]))[0]) for t in texts]
    assert [b - a for a, b in zip(first, first[1:])] == alone


def test_long_texts_hash_like_short_ones():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 12))) for _ in range(300_000)]
    long, first = tv.words(pa.array([" ".join(words)]))
    short = tv.words(pa.array(words))[0]
    assert first[-1] == len(words) and (long == short).all()
    assert (tv.window_hash(long, 50)[:100] == tv.window_hash(long[:149], 50)).all()
    assert (tv.window_hash(long, 50)[-100:] == tv.window_hash(long[-149:], 50)).all()


# -- language


def test_language_accuracy_held_out(docs):
    rows = docs.select("doc_id", "lang", "text").collect()
    train = [(r.lang, r.text) for r in rows if r.doc_id % 2]
    test = [r for r in rows if not r.doc_id % 2]
    model = li.train(train)
    shares, words = li.infer(model, pa.array([r.text for r in test]))
    right = sum(model.names[s[:-1].argmax()] == r.lang for s, r in zip(shares, test))
    assert right >= 0.97 * len(test)
    assert (shares[:, -1] <= li.MAX_NOISE).mean() >= 0.995


def test_mixtures_are_found(docs):
    rows = docs.select("lang", "text").filter("n_chars between 1500 and 3000").collect()
    model = li.train([(r.lang, r.text) for r in rows[:200]])
    by = {k: [r.text for r in rows[200:] if r.lang == k and "|" not in r.text] for k in ("en", "fr")}
    en, fr = by["en"][0].split()[:90], by["fr"][0].split()[:30]
    shares, _ = li.infer(model, pa.array([" ".join(en + fr), " ".join(en), "zzqxv kkjqx wwxz qqqjq vvxqk zzzqj"]))
    names = model.names
    assert abs(shares[0][names.index("en")] - 0.75) < 0.12 and abs(shares[0][names.index("fr")] - 0.25) < 0.12
    assert shares[1][names.index("en")] > 0.93
    assert shares[2][-1] > li.MAX_NOISE


def test_language_of_odd_rows(odd):
    sample = li.training_sample(odd, 3)
    assert len(sample) == 3
    model = li.train(sample)
    got = li.identify(odd, model).collect()
    accepted = sorted((r.doc_id is None, r.doc_id or 0, r.accepted) for r in got)
    assert accepted == [(False, 1, False), (False, 2, False), (False, 3, False), (False, 4, True), (False, 5, True), (False, 5, True), (True, 0, True)]
    kept = li.keep_identified(odd, model)
    assert kept.columns == odd.columns and kept.count() == 4
    nothing = li.train([])
    assert li.keep_identified(odd, nothing).count() == 4
    assert li.identify(odd.limit(0), nothing).count() == 0 and li.training_sample(odd.limit(0)) == []


def test_training_sample_is_bounded(docs):
    sample = li.training_sample(docs, 20)
    assert len(sample) == 80 and sample == li.training_sample(docs, 20)


# -- HTML

GOOD = "This is the text of an article that goes on for a while and has all of the words that it should have in it, as they are in the language. " * 2


def test_two_passes_over_blocks():
    nav = "<ul><li><a href='/a'>Home</a></li><li><a href='/b'>News and more</a></li></ul>"
    page = f"<html><head><title>x</title><script>var a='<p>no</p>';</script></head><body>{nav}<h2>A heading</h2><p>{GOOD}</p><p>Yes.</p><p>{GOOD}</p><!-- <p>no</p> --><p>© 2020 all of the rights and the rest of it for the people who are on it</p></body>"
    found = [(b.text[:9], b.label) for b in hx.classify(page)]
    assert found == [("Home", "bad"), ("News and ", "bad"), ("A heading", "good"), ("This is t", "good"), ("Yes.", "good"), ("This is t", "good"), ("© 2020 al", "bad")]


class _Cut(HTMLParser):
    """Blocks of a well-formed page by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.now, self.links, self.anchor, self.breaks, self.hidden = [], "", 0, False, 0, 0

    def flush(self):
        text = " ".join(self.now.split())
        if text:
            self.out.append((text, min(self.links, len(text))))
        self.now, self.links, self.breaks = "", 0, 0

    def handle_starttag(self, tag, attrs):
        if tag in hx._HIDDEN:
            self.flush()
            self.hidden += 1
        elif tag == "a":
            self.anchor = True
        elif tag == "br":
            self.breaks += 1
            self.now += "\n"
            if self.breaks == 2:
                self.flush()
        elif tag in hx._BLOCKS:
            self.flush()
            self.anchor = False

    def handle_endtag(self, tag):
        if tag in hx._HIDDEN:
            self.hidden -= 1
        elif tag == "a":
            self.anchor = False
        elif tag in hx._BLOCKS:
            self.flush()
            self.anchor = False

    def handle_data(self, data):
        if self.hidden:
            return
        self.now += data
        if data.strip():
            self.breaks = 0
            if self.anchor:
                self.links += len(" ".join(data.split()))


def _labels(cut):
    """The first pass, block by block, from the counts that define it."""
    stops = [set(words.split()) for words in hx.STOP_WORDS.values()]
    rows = []
    for text, links in cut:
        words = re.findall(r"[^\W_]+", text.lower())
        best = [sum(w in s for w in words) for s in stops]
        rows.append((text, links / len(text), words, best, len(text) + 2 * sum("\u3040" <= c <= "\u9fff" or "\uac00" <= c <= "\ud7af" for c in text)))
    plain = [r for r in rows if r[2] and r[1] <= hx.LINKS_HIGH]
    total = [sum(r[3][k] for r in plain) for k in range(len(stops))]
    listed = any(len(r[0]) >= hx.LENGTH_LOW and max(r[3]) >= hx.STOP_HIGH * len(r[2]) for r in plain) or max(total) >= hx.STOP_LOW * sum(len(r[2]) for r in plain)
    out = []
    for text, share, words, best, size in rows:
        if not words or share > hx.LINKS_HIGH or ("©" in text and size <= hx.LENGTH_HIGH):
            out.append("bad")
        elif size < hx.LENGTH_LOW:
            out.append("bad" if share else "short")
        elif listed:
            d = max(best) / len(words)
            out.append(("good" if size > hx.LENGTH_HIGH else "near-good") if d >= hx.STOP_HIGH else "near-good" if d >= hx.STOP_LOW else "bad")
        else:
            out.append("bad" if not any(c in text for c in ".!?…。！？؟।") else "good" if size > hx.LENGTH_HIGH else "near-good")
    return out


def _first(page):
    found = hx.blocks(page)
    listed = hx.is_listed(found)
    return [(b.text, b.links) for b in found], [hx.first_pass(b, listed) for b in found]


def test_first_pass_matches_brute_force(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    assert len(pages) > 200
    for page in pages:
        parser = _Cut()
        parser.feed(page)
        parser.close()
        parser.flush()
        cut, labels = _first(page)
        assert cut == parser.out and labels == _labels(parser.out)


PHRASES = st.sampled_from(["the of and to in it is ", "der die und das ", "wort fgh ", "漢字の文。", "Конец фразы и не ", "Zdanie skończone. ", "© ", "x" * 60 + " ", "a & b &amp; ", "12 "])
TAGS = st.sampled_from(["<p>", "</p>", "<br>", "<a href='x>y'>", "</a>", "<h2>", "</h2>", "<div class=\"k\">", "<script>var p='<p>';</script>", "<!-- <p>no</p> -->", "<b>", "</b>"])


@given(st.lists(st.tuples(TAGS, st.lists(PHRASES, max_size=9)), max_size=12))
@settings(max_examples=300, deadline=None)
def test_blocks_of_any_page_match_brute_force(parts):
    page = "".join(tag + "".join(text) for tag, text in parts)
    parser = _Cut()
    parser.feed(page)
    parser.close()
    parser.flush()
    cut, labels = _first(page)
    assert cut == parser.out and labels == _labels(parser.out)


@pytest.mark.parametrize("evil", ["<a ", "<a \"", "<a '>x", "<a \"><a\" ", "<!", "<!--", "</script ", "<script>", "<svg>", "<", "&", "&#9", "<p>x", "<br>"])
def test_a_long_malformed_page_takes_linear_time(evil):
    page = evil * (1_000_000 // len(evil))
    began = time.process_time()
    hx.classify(page + "'")
    assert time.process_time() - began < 10


def test_malformed_pages_have_a_defined_text():
    text = lambda page: "\n".join(b.text for b in hx.classify(page) if b.label == "good")
    assert text(f"<p>{GOOD}<a ") == GOOD.strip() + " <a"
    assert text(f"<svg><p>{GOOD}</p>") == text(f"<object><p>{GOOD}") == text(f"<template>{GOOD}") == GOOD.strip()
    assert text(f"<script><p>{GOOD}</p>") == text(f"<style>{GOOD}") == ""
    assert text(f"<p title=\"x>{GOOD}</p><p>{GOOD}</p>") != ""
    assert text("<p>&#" + "9" * 5000 + f"; {GOOD}") == "\ufffd " + GOOD.strip()


def test_languages_without_a_list_are_judged_by_sentences():
    polish = "Wszystkie zwierzęta leżały spokojnie przy drodze, gdzie wieczorem słońce ogrzewało kamienie. " * 4
    chinese = "所有动物都静静地躺在路边，傍晚的阳光温暖了石头。孩子们从学校回家，看见它们便停下脚步。" * 3
    nav = "<ul><li><a href='/'>Strona</a></li><li><a href='/b'>Dalej i dalej</a></li></ul>"
    for text in (polish, chinese, "Все животные спокойно лежали у дороги, и вечером солнце грело камни, как это было всегда. " * 4):
        found = [(b.text, b.label) for b in hx.classify(f"{nav}<p>{text}</p><p>spis tresci wykaz stron tabela dane liczby inne wpisy dalsze pozycje wykazu</p>")]
        assert [label for _, label in found] == ["bad", "bad", "good", "bad"], found
    long_notice = f"© {GOOD}"
    assert [b.label for b in hx.classify(f"<p>{long_notice}</p>")] == ["good"]


def _settle(labels):
    """The second pass looked up block by block."""
    out = []
    for i, label in enumerate(labels):
        if label in ("good", "bad"):
            out.append(label)
            continue
        left = next(((labels[k], i - k) for k in range(i - 1, -1, -1) if labels[k] in ("good", "bad")), ("bad", i + 1))
        right = next(((labels[k], k - i) for k in range(i + 1, len(labels)) if labels[k] in ("good", "bad")), ("bad", len(labels) - i))
        near_l = "near-good" in labels[i - left[1] + 1 : i]
        near_r = "near-good" in labels[i + 1 : i + right[1]]
        if left[0] == right[0]:
            out.append(left[0])
        elif label == "near-good" or (left[0] == "bad" and near_l) or (right[0] == "bad" and near_r):
            out.append("good")
        else:
            out.append(left[0] if left[1] < right[1] else right[0] if right[1] < left[1] else "bad")
    return out


@given(st.lists(st.sampled_from(["good", "bad", "short", "near-good"]), max_size=14))
@settings(max_examples=300, deadline=None)
def test_second_pass_matches_brute_force(labels):
    assert hx.second_pass(labels) == _settle(labels)


def test_html_of_odd_pages(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<"), (None, f"<p>{GOOD}"), (4, "<script>never closed"), (5, f"<p>{GOOD}</p>"), (5, f"<p>{GOOD}</p>"), (6, "<p>" + GOOD * 3000)], "page_id long, html string")
    got = {(r.page_id, r.text if r.text is None else len(r.text) > 0, r.n_good) for r in hx.extract_text(pages.selectExpr("*", "1 as text", "2 as n_good")).collect()}
    assert got == {(1, None, 0), (2, False, 0), (3, False, 0), (None, True, 1), (4, False, 0), (5, True, 1), (6, True, 1)}
    assert hx.extract_text(pages.limit(0)).count() == 0


# -- token counts


@given(st.text(alphabet="ab '’sltrevdm\n\t 12é漢.,<", max_size=150), st.lists(st.tuples(st.integers(0, 160), st.integers(0, 60), st.text(alphabet="ab '\n 1é.", max_size=90)), max_size=6))
@settings(max_examples=300, deadline=None)
def test_edits_count_like_the_whole_text(text, edits):
    own = tc.counter(tc.VOCABULARY)
    doc = tc.Document(text, own)
    for start, size, new in edits:
        doc.edit(start, start + size, new)
        assert doc.tokens == len(own.encoding.encode_ordinary(doc.text)) == int(doc.counts.sum())
        assert doc.sizes.sum() == len(doc.counts)


def test_an_edit_encodes_little_again():
    own = tc.counter(tc.VOCABULARY)
    doc = tc.Document("some words and more of them. " * 2000, own)
    before = doc.encoded
    doc.edit(30_000, 30_004, "edited")
    assert doc.tokens == len(own.encoding.encode_ordinary(doc.text)) and doc.encoded - before < 12


def test_sums_follow_splices():
    rng = random.Random(7)
    for _ in range(300):
        values = [rng.randrange(9) for _ in range(rng.randrange(0, 40))]
        tree = tc.SegmentTree(tc.np.array(values, tc.np.int64))
        for _ in range(6):
            a = rng.randrange(len(values) + 1)
            b = rng.randrange(a, len(values) + 1)
            new = [rng.randrange(9) for _ in range(b - a if rng.random() < 0.5 else rng.randrange(12))]
            values[a:b] = new
            tree.splice(a, b, tc.np.array(new, tc.np.int64))
            fresh = tc.SegmentTree(tc.np.array(values, tc.np.int64))
            assert tree.total == sum(values) and tree.values.tolist() == values
            if values:
                assert [x.tolist() for x in tree.levels if len(x)][-1] == [sum(values)] and len(tree.levels) == len(fresh.levels)


def test_token_counts_beside_columns_of_their_names(spark):
    docs = spark.createDataFrame([(1, "a b", 9, "x", 3)], "doc_id long, text string, tokens long, edits string, tokens_after long")
    assert [tuple(r)[:4] for r in tc.count_tokens(docs).collect()] == [(1, 2, 0, 2)]


def test_token_counts_of_documents(docs, odd):
    own = tc.counter(tc.VOCABULARY)
    texts = {r.doc_id: r.text for r in docs.filter("doc_id < 200").collect()}
    for r in tc.count_tokens(docs.filter("doc_id < 200")).collect():
        text = texts[r.doc_id]
        edits = tc.redactions(text)
        after = text
        for a, b, new in edits:
            after = after[:a] + new + after[b:]
        assert (r.tokens, r.edits, r.tokens_after) == (len(own.encoding.encode_ordinary(text)), len(edits), len(own.encoding.encode_ordinary(after)))
    assert sorted((r.doc_id or -1, r.tokens) for r in tc.count_tokens(odd).collect() if r.doc_id != 4)[1:3] == [(1, 0), (2, 0)]
    assert tc.count_tokens(odd.limit(0)).count() == 0


# -- licenses


def test_alignment_rises_and_agrees():
    rng = random.Random(2)
    for _ in range(300):
        template = [rng.randrange(12) for _ in range(rng.randrange(1, 12))]
        text = [rng.randrange(12) for _ in range(rng.randrange(0, 20))]
        at = rng.randrange(len(text) + 1)
        pairs = lic.align(text, template)
        assert all(text[a] == template[b] for a, b in pairs)
        assert all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:]))
        whole = lic.align(text[:at] + [100, *range(50, 60), 100] + text[at:], list(range(50, 60)))
        assert len(whole) == 10


def _longest_rising(pairs):
    best = [1] * len(pairs)
    for i in range(len(pairs)):
        for j in range(i):
            if pairs[j][1] < pairs[i][1]:
                best[i] = max(best[i], best[j] + 1)
    return max(best, default=0)


@given(st.permutations(range(9)))
def test_longest_rising_sequence(values):
    pairs = list(enumerate(values))
    got = lic.rising(pairs)
    assert len(got) == _longest_rising(pairs) and all(a[1] < b[1] for a, b in zip(got, got[1:]))


def test_license_scan(spark, docs, odd):
    rows = [
        (1, "x y z. Released under the MIT License. more text. Released under the MIT License."),
        (2, "It was licensed. The work is under review, version 3 of the public record."),
        (3, "this is licensed under the very GNU General Public License, version 3"),
        (4, "Licensed under CC BY-NC 4.0"),
        (5, None),
    ]
    got = sorted((r.doc_id, r.license, r.start_word, r.end_word) for r in lic.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, "MIT", 3, 8), (1, "MIT", 10, 15), (3, "GPL-3.0", 0, 12), (4, "CC-BY-NC-4.0", 0, 7)]
    plain = [("MIT License.", "MIT"), ("Apache License, Version 2.0", "Apache-2.0"), ("CC BY-NC 4.0", "CC-BY-NC-4.0"), ("GNU General Public License, version 3", "GPL-3.0")]
    want = sorted((r.doc_id, name) for r in docs.collect() for part, name in plain for _ in range(r.text.count(part)))
    assert sorted((r.doc_id, r.license) for r in lic.scan_licenses(docs).collect()) == want
    assert lic.scan_licenses(odd).count() == lic.scan_licenses(odd.limit(0)).count() == 0


# -- decontamination


@given(st.lists(st.lists(st.integers(0, 3), max_size=10), max_size=4), st.lists(st.integers(0, 4), max_size=25))
@settings(max_examples=200, deadline=None)
def test_automaton_tracks_longest_matches(items, text):
    automaton = dc.SuffixAutomaton(items)
    subs = {tuple(i[a:b]) for i in items for a in range(len(i)) for b in range(a + 1, len(i) + 1)}
    want = [max((n for n in range(e + 1) if n == 0 or tuple(text[e - n : e]) in subs)) for e in range(1, len(text) + 1)]
    assert automaton.longest(text) == want


def _runs(words, item):
    out, covered = [], set()
    for d in range(-len(words), len(item)):
        run = 0
        for s in range(len(words) + 1):
            same = s < len(words) and 0 <= s + d < len(item) and words[s] == item[s + d]
            if same:
                run += 1
                continue
            if run >= dc.MIN_MATCH:
                out.append((s - run, run))
                covered |= set(range(s - run + d, s + d))
            run = 0
    whole = len(covered) >= dc.COVERAGE * len(item)
    return [(s, n) for s, n in out if whole or n >= dc.LIMIT]


def test_contamination_matches_brute_force(spark):
    rng = random.Random(4)
    items = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(3, 22)))) for i in range(12)]
    docs = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 60)))) for i in range(40)]
    want = {(d, i, s, s + n) for d, t in docs for i, q in items if len(q.split()) >= dc.MIN_MATCH for s, n in _runs(t.split(), q.split())}
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in dc.contaminated_spans(*frames).collect()} == want
    assert {tuple(r) for r in dc.contaminated_spans(*frames, shard_words=40).collect()} == want


def test_contamination_is_cut_out(spark, odd):
    item = "one two three four five six seven eight nine ten"
    items = spark.createDataFrame([(1, item), (1, item), (None, item), (2, None), (3, "the of")], "item_id long, text string")
    rows = [(1, f"Before it. {item.title()}, and after."), (2, item), (3, "one two three four and five six"), (4, f"{item}. x {item}"), (5, None), (6, ""), (None, item + " tail")]
    docs = spark.createDataFrame([(a, b, len(b or ""), "t") for a, b in rows], "doc_id long, text string, n_chars long, item_id string")
    got = {r.doc_id: (r.text, r.n_chars) for r in dc.remove_contamination(docs, items).collect()}
    assert got == {1: ("Before it. and after.", 21), 3: (rows[2][1], 31), 4: ("x ", 2), 5: (None, 0), 6: ("", 0), None: ("tail", 4)}
    assert {(r.doc_id, r.item_id) for r in dc.contaminated_spans(docs, items).collect()} == {(1, 1), (2, 1), (4, 1), (None, 1)}
    for frame in (odd, odd.limit(0)):
        assert dc.contaminated_spans(frame, items).count() == 0
        assert dc.remove_contamination(frame, items).count() == frame.count()
    assert dc.contaminated_spans(docs, items.limit(0)).count() == 0
