"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all benchmark items make one automaton. Training words are
streamed through it, which gives the state and the longest match that ends at each word.
The state and those on its path of suffix links have the places at which the items hold
that match or a shorter one: a place that a state has and the one before it on the path
has not ends a common run as long as the state's strings. Of the runs of ``MIN_MATCH``
words or more that the next word does not go on with, those of ``LIMIT`` words or more are
contamination, and all of an item where they cover ``COVERAGE`` of it or more.

Before that, whole batches are sieved at once by pairs of consecutive words: a match of
``MIN_MATCH`` words consists of pairs that the benchmark has, so only unbroken
stretches of such pairs are streamed. This loses nothing.

The items are split into automata of about ``SHARD_WORDS`` words, kept as flat arrays, and
``SHARDS`` of them go to the tasks at once; a larger benchmark takes several passes over
the documents. Each automaton judges the whole text as it came.

Defined cases: null and empty texts have no words and match nothing, on either side; an
item of fewer than ``MIN_MATCH`` words is never found (it would match ordinary text);
each different text of an item_id is an item of its own, repeated ones count once; texts
under a null item_id are cut out, but give no spans; repeated
documents repeat their result; a null doc_id is passed on. In the cleaned table a
document of which no word is left goes; n_chars, where there is such a column, is that
of the cleaned text. Other columns play no part, whatever their names.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec
from .runtime import ranges, split_runs

MIN_MATCH = 5
LIMIT = 8
COVERAGE = 0.5
SHARD_WORDS = 100_000
SHARDS = 10


class SuffixAutomaton:
    """All substrings of several word sequences; states are numbers, state 0 is empty.

    It is built on a dictionary a state and then kept as sorted arrays. ``low`` and
    ``high`` bound the places (see ``place``) at which a state's strings end.
    """

    def __init__(self, sequences):
        self.length, self.link, self.next = [0], [-1], [{}]
        ends: list[int] = []
        for words in sequences:
            last = 0
            for word in words:
                last = self._extend(last, word)
                ends.append(last)
        self._freeze(np.array(ends, np.int64))

    def _state(self, length: int, link: int, following: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        return len(self.length) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        """A copy of q for the strings of at most length(p) + 1."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int) -> int:
        there = self.next[last].get(word)
        if there is not None:
            return there if self.length[there] == self.length[last] + 1 else self._split(last, there, word)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
        return new

    def _freeze(self, ends: np.ndarray) -> None:
        """Sorted transitions, and the places by state: those of a subtree of links lie together."""
        n = len(self.length)
        sizes = np.fromiter(map(len, self.next), np.int64, n)
        total = int(sizes.sum())
        words = np.fromiter((w for f in self.next for w in f), np.uint64, total)
        to = np.fromiter((t for f in self.next for t in f.values()), np.int64, total)
        order = np.lexsort((words, np.repeat(np.arange(n), sizes)))
        self.first = array("q", np.concatenate(([0], np.cumsum(sizes))).tobytes())
        self.words, self.to = array("Q", words[order].tobytes()), array("q", to[order].tobytes())
        self.next = None
        own = np.bincount(ends, minlength=n)
        held, link, by_length = own.tolist(), self.link, np.argsort(self.length, kind="stable").tolist()
        for v in reversed(by_length[1:]):
            held[link[v]] += held[v]
        low, cursor = [0] * n, [0] * n
        for v in by_length:
            if v:
                low[v] = cursor[link[v]]
                cursor[link[v]] += held[v]
            cursor[v] = low[v] + int(own[v])
        self.low = array("q", low)
        self.high = array("q", [a + b for a, b in zip(low, held)])
        self.length, self.link = array("q", self.length), array("q", link)
        #: the place of each word of the sequences, one after another; several can have one state
        by_state = np.argsort(ends, kind="stable")
        starts, runs = split_runs(ends[by_state])
        self.place = np.empty(len(ends), np.int64)
        self.place[by_state] = np.repeat(np.array(low, np.int64)[ends[by_state][starts]], runs) + ranges(np.zeros(len(runs), np.int64), runs)

    def _step(self, state: int, word: int) -> int:
        end = self.first[state + 1]
        k = bisect_left(self.words, word, self.first[state], end)
        return self.to[k] if k < end and self.words[k] == word else -1

    def walk(self, words) -> Iterator[tuple[int, int]]:
        """For each word, the state and the length of the longest match that ends with it."""
        state = size = 0
        for word in words:
            step = self._step(state, word)
            while step < 0 and state:
                state = self.link[state]
                size = self.length[state]
                step = self._step(state, word)
            state, size = (0, 0) if step < 0 else (step, size + 1)
            yield state, size

    def longest(self, words) -> list[int]:
        return [size for _, size in self.walk(words)]

    def matches(self, state: int, size: int, least: int) -> Iterator[tuple[int, int, int]]:
        """(first place, end, length): where the items hold the match and its suffixes of ``least`` words or more."""
        low = high = -1
        while size >= least:
            a, b = self.low[state], self.high[state]
            if low < 0:
                yield a, b, size
            else:
                if a < low:
                    yield a, low, size
                if high < b:
                    yield high, b, size
            low, high = a, b
            state = self.link[state]
            size = self.length[state] if state >= 0 else 0


def _pairs(words: np.ndarray) -> np.ndarray:
    return textvec.mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])


class Matcher:
    """One automaton with the items that its places lie in; an item_id may have several texts."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.ids = [i for i, _ in items]
        self.size = np.array([len(w) for _, w in items], np.int64)
        self.automaton = SuffixAutomaton([w.tolist() for _, w in items])
        n = int(self.size.sum())
        self.item, self.end, self.following = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.uint64)
        self.last = np.zeros(n, bool)
        place = self.automaton.place
        self.item[place] = np.repeat(np.arange(len(items)), self.size)
        self.end[place] = ranges(np.ones(len(items), np.int64), self.size)
        words = np.concatenate([w for _, w in items])
        self.following[place] = np.append(words[1:], np.uint64(0))
        self.last[place[np.cumsum(self.size) - 1]] = True

    def runs(self, words: np.ndarray, stretches: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(item, start, length) of contaminating runs in a document's words."""
        found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for s, e in stretches:
            for k, (state, size) in enumerate(self.automaton.walk(words[s:e].tolist()), s + 1):
                for a, b, length in self.automaton.matches(state, size, MIN_MATCH):
                    # a run goes on where the item's next word is the document's; a stretch ends all
                    at = np.arange(a, b)
                    if k < e:
                        at = at[self.last[a:b] | (self.following[a:b] != words[k])]
                    for item, end in zip(self.item[at].tolist(), self.end[at].tolist()):
                        found[item].append((k - length, length, end - length))
        out = []
        for item, runs in found.items():
            covered = np.zeros(self.size[item], bool)
            for _, size, at in runs:
                covered[at : at + size] = True
            whole = covered.mean() >= COVERAGE
            out += [(item, start, size) for start, size, _ in runs if whole or size >= LIMIT]
        return [(self.ids[item], start, size) for item, start, size in sorted(out)]


SIEVE = 1 << 20


class Benchmark:
    """The matchers of one pass, and the sieve of all their pairs of words."""

    def __init__(self, shards: list[list[tuple[int, bytes]]]):
        items = [[(i, np.frombuffer(w, np.uint64)) for i, w in shard] for shard in shards]
        self.matchers = [Matcher(shard) for shard in items]
        self.pairs = np.unique(np.concatenate([_pairs(w) for shard in items for _, w in shard] or [np.zeros(0, np.uint64)]))
        self.sieve = np.zeros(SIEVE, bool)
        self.sieve[(self.pairs & np.uint64(SIEVE - 1)).astype(np.int64)] = True

    def stretches(self, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
        """Unbroken runs of at least MIN_MATCH words all of whose pairs the items have."""
        if len(words) < MIN_MATCH or not len(self.pairs):
            return []
        pairs = _pairs(words)
        maybe = self.sieve[(pairs & np.uint64(SIEVE - 1)).astype(np.int64)]
        inner = first[(first > 0) & (first < len(words))]
        maybe[inner - 1] = False
        at = np.flatnonzero(maybe)
        at = at[self.pairs[np.minimum(np.searchsorted(self.pairs, pairs[at]), len(self.pairs) - 1)] == pairs[at]]
        starts, sizes = split_runs(at - np.arange(len(at)))
        return [(int(at[s]), int(at[s] + n + 1)) for s, n in zip(starts, sizes) if n + 1 >= MIN_MATCH]

    def documents(self, texts: pa.Array) -> Iterator[tuple[int, list[tuple[int, int, int]], int]]:
        """(row, runs, words) of each text that is contaminated."""
        for at, part in textvec.chunks(texts):
            words, first = textvec.words(part)
            by_row: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for s, e in self.stretches(words, first):
                by_row[int(np.searchsorted(first, s, "right")) - 1].append((s, e))
            for row, stretches in by_row.items():
                base = int(first[row])
                own = words[base : first[row + 1]]
                runs = [r for m in self.matchers for r in m.runs(own, [(s - base, e - base) for s, e in stretches])]
                if runs:
                    yield at + row, runs, len(own)


_built: dict[tuple, Benchmark] = {}


def _benchmark(shards: list[list[tuple[int, bytes]]]) -> Benchmark:
    """The automata of these shards, built once in each Python worker."""
    key = tuple(map(tuple, shards))
    if key not in _built:
        _built.clear()
        _built[key] = Benchmark(shards)
    return _built[key]


def shards(items: DataFrame, shard_words: int = SHARD_WORDS) -> Iterator[list[tuple[int, bytes]]]:
    """The items' word hashes, a bounded number of words at a time."""
    named = items.select(F.col("item_id").cast("long").alias("item"), F.col("text").cast("string").alias("text")).filter("item is not null and text is not null")
    texts = named.distinct()
    # a word has a letter and what parts it from the next
    room = int(texts.agg(F.sum(F.length("text"))).first()[0] or 0) // 2
    n = max(1, -(-room // shard_words))
    for shard in range(n):
        rows = texts.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == shard).orderBy("item", "text").collect()
        out: dict[tuple[int, bytes], None] = {}
        for row in rows:
            words, _ = textvec.words(pa.array([row["text"]], pa.string()))
            if len(words) >= MIN_MATCH:
                out[row["item"], words.tobytes()] = None
        if out:
            yield list(out)


def passes(items: DataFrame, shard_words: int, shards_a_pass: int) -> Iterator[list[list[tuple[int, bytes]]]]:
    """The shards, ``shards_a_pass`` at a time."""
    found = shards(items, shard_words)
    while some := list(islice(found, shards_a_pass)):
        yield some


def contaminated_spans(docs: DataFrame, items: DataFrame, shard_words: int = SHARD_WORDS, shards_a_pass: int = SHARDS) -> DataFrame:
    """(doc_id, item_id, start_word, end_word) of every contaminating run; end_word is exclusive."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, start_word long, end_word long"

    def scan(some):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            benchmark = _benchmark(some)
            for batch in batches:
                ids = batch.column(0)
                found = [(ids[row].as_py(), item, start, start + size) for row, runs, _ in benchmark.documents(batch.column(1)) for item, start, size in runs]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else ([],) * 4)], names=["doc_id", "item_id", "start_word", "end_word"])

        return run

    out = None
    for some in passes(items, shard_words, shards_a_pass):
        spans = rows.mapInArrow(scan(some), schema)
        out = spans if out is None else out.unionByName(spans)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def cut_words(text: str, runs: list[tuple[int, int]]) -> str:
    """``text`` without these runs of words (start, end), each up to where the next word begins."""
    data, _, begin, _, _ = textvec.word_spans(pa.array([text], pa.string()))
    keep = np.ones(len(data), bool)
    for start, end in runs:
        keep[begin[start] : begin[end] if end < len(begin) else len(data)] = False
    return data[keep].tobytes().decode("utf-8", "replace")


def remove_contamination(docs: DataFrame, items: DataFrame, shard_words: int = SHARD_WORDS, shards_a_pass: int = SHARDS) -> DataFrame:
    """``docs`` with contaminating runs cut out of the texts; all columns kept.

    Every shard judges the text as it came. Where there is more than one pass, the runs found
    so far go along in a column, and the last pass cuts them all at once.
    """
    low = [c.lower() for c in docs.columns]
    text_at = low.index("text")
    chars_at = low.index("n_chars") if "n_chars" in low else None
    marked = "runs"
    while marked in low:
        marked += "_"

    def find(some, first):
        """Adds the column of runs, or what this pass finds to it."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            benchmark = _benchmark(some)
            for batch in batches:
                before = [None] * len(batch) if first else batch.column(len(low)).to_pylist()
                for row, runs, _ in benchmark.documents(batch.column(text_at)):
                    before[row] = (before[row] or b"") + np.array([(start, size) for _, start, size in runs], np.int64).tobytes()
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(low)], pa.array(before, pa.binary())], names=[*batch.schema.names[: len(low)], marked])

        return run

    def clean(some, first):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            benchmark = _benchmark(some)
            for batch in batches:
                changed, gone = {}, set()
                texts = batch.column(text_at)
                found: dict[int, list[tuple[int, int]]] = defaultdict(list)
                for row, runs, _ in benchmark.documents(texts):
                    found[row] += [(start, size) for _, start, size in runs]
                if not first:
                    for row, runs in enumerate(batch.column(len(low)).to_pylist()):
                        if runs:
                            found[row] += np.frombuffer(runs, np.int64).reshape(-1, 2).tolist()
                    batch = pa.RecordBatch.from_arrays(batch.columns[: len(low)], names=batch.schema.names[: len(low)])
                for row, runs in found.items():
                    left = np.ones(len(textvec.words(texts.slice(row, 1))[0]), bool)
                    for start, size in runs:
                        left[start : start + size] = False
                    if not left.any():
                        gone.add(row)
                        continue
                    at = np.flatnonzero(~left)
                    starts, sizes = split_runs(at - np.arange(len(at)))
                    changed[row] = cut_words(texts[row].as_py(), [(int(at[s]), int(at[s] + n)) for s, n in zip(starts, sizes)])
                if not changed and not gone:
                    yield batch
                    continue
                columns = list(batch.columns)
                mask = pa.array([i in changed for i in range(len(batch))])
                columns[text_at] = pc.replace_with_mask(texts, mask, pa.array([changed[i] for i in sorted(changed)], texts.type))
                if chars_at is not None and pa.types.is_integer(columns[chars_at].type):
                    columns[chars_at] = pc.replace_with_mask(columns[chars_at], mask, pa.array([len(changed[i]) for i in sorted(changed)], columns[chars_at].type))
                made = pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
                yield made.filter(pa.array([i not in gone for i in range(len(batch))])) if gone else made

        return run

    # what is cut needs no name, so items without one count too
    parts = list(passes(items.select(F.lit(0).alias("item_id"), "text"), shard_words, shards_a_pass))
    out = docs
    for k, some in enumerate(parts[:-1]):
        out = out.mapInArrow(find(some, k == 0), T.StructType([*docs.schema, T.StructField(marked, T.BinaryType())]))
    return out.mapInArrow(clean(parts[-1], len(parts) == 1), docs.schema) if parts else out
