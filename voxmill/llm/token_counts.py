"""Edit-aware token counts on segment trees of pre-tokens.

A byte-level BPE splits a text into pre-tokens by a pattern and encodes each on its own,
so a document's count is the sum over its pre-tokens. The pre-tokens are the leaves of
a segment tree, ``LEAF`` to a leaf, whose inner nodes hold subtree sums. An edit replaces a range of
characters: only the pre-tokens that it touches, those before it whose match could have
looked into it, and those after it up to where old and new boundaries meet again are
split and encoded anew; the sums on their paths to the root are updated. The pattern
looks at nothing behind a match's start, so from a common boundary on nothing changes.

The query counts the documents table as it is and after redaction, whose edits replace
e-mail addresses, long digit strings and secret tokens by placeholders.

Defined cases: null and empty texts have no tokens; edits are applied in order, each in
the coordinates that the ones before it left, and are clipped to the text; the
strings of special tokens are ordinary text; rows are handled one by one, so repeated
rows repeat their result; a null doc_id is passed on. Other columns play no part.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 32
CACHE = 400_000
#: How far a pattern's match may look beyond its end (contractions look two characters on).
LOOK = 3

REDACTIONS = (
    (regex.compile(r"[\w.+-]+@[\w-]+\.[\w.]+"), "<email>"),
    (regex.compile(r"\"[0-9a-f]{32,}\""), "<secret>"),
    (regex.compile(r"\d{13,19}"), "<number>"),
)


class Counter:
    """Tokens of pre-tokens by a rank file, remembered for the most recent ones."""

    def __init__(self, path: str = VOCABULARY):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.encoding = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        try:
            return [known[p] for p in pieces]
        except KeyError:
            pass
        if len(known) > CACHE:
            known.clear()
        for p in pieces:
            if p not in known:
                known[p] = len(self.encoding.encode_ordinary(p))
        return [known[p] for p in pieces]


class SegmentTree:
    """Sums over leaves, changed at leaves; ``splice`` replaces a run of leaves."""

    def __init__(self, values: np.ndarray):
        self.values = np.asarray(values, np.int64)
        self._build()

    def _build(self) -> None:
        self.levels = [self.values]
        while len(self.levels[-1]) > 1:
            level = self.levels[-1]
            if len(level) % 2:
                level = np.append(level, 0)
            self.levels.append(level[::2] + level[1::2])

    @property
    def total(self) -> int:
        return int(self.levels[-1][0]) if len(self.values) else 0

    def splice(self, start: int, end: int, values: np.ndarray) -> None:
        """Leaves [start, end) become ``values``; paths to the root are updated."""
        if len(values) == end - start:
            self.values[start:end] = values
            lo, hi = start, end
            for below, level in zip(self.levels, self.levels[1:]):
                lo, hi = lo // 2, (hi + 1) // 2
                for i in range(lo, hi):
                    level[i] = below[2 * i] + (below[2 * i + 1] if 2 * i + 1 < len(below) else 0)
            return
        # leaves behind the run move: sums over these are formed anew, those before it stay
        self.values = np.concatenate([self.values[:start], values, self.values[end:]])
        old, self.levels, lo = self.levels, [self.values], start
        while len(self.levels[-1]) > 1:
            below, k = self.levels[-1], len(self.levels)
            lo = lo // 2 if k < len(old) else 0
            tail = below[2 * lo :]
            if len(tail) % 2:
                tail = np.append(tail, 0)
            sums = tail[::2] + tail[1::2]
            self.levels.append(np.concatenate([old[k][:lo], sums]) if lo else sums)


class Document:
    """A text with its pre-tokens, the leaves over them and their token counts."""

    def __init__(self, text: str, counter: Counter):
        self.text, self.counter = text, counter
        pieces = counter.pattern.findall(text)
        self.ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        self.counts = np.array(counter.counts(pieces), np.int64)
        self.encoded = len(pieces)
        self.tree = SegmentTree(np.add.reduceat(self.counts, np.arange(0, len(pieces), LEAF)) if pieces else np.zeros(0, np.int64))
        # how many pre-tokens each leaf has; edits leave leaves of other sizes
        self.sizes = np.full(-(-len(pieces) // LEAF), LEAF, np.int64)
        if len(pieces) % LEAF:
            self.sizes[-1] = len(pieces) % LEAF

    @property
    def tokens(self) -> int:
        return self.tree.total

    def edit(self, start: int, end: int, new: str) -> None:
        """Characters [start, end) become ``new``."""
        start = min(max(start, 0), len(self.text))
        end = min(max(end, start), len(self.text))
        text = self.text[:start] + new + self.text[end:]
        at = max(0, start - LOOK)
        while at and self.text[at - 1].isspace():
            at -= 1
        # pre-tokens [keep, resume) are replaced; old boundaries from `end` on move by `shift`
        keep = int(np.searchsorted(self.ends, at, "right"))
        place = int(self.ends[keep - 1]) if keep else 0
        shift = len(text) - len(self.text)
        resume = int(np.searchsorted(self.ends, end, "left"))
        pieces: list[str] = []
        while place < len(text):
            while resume < len(self.ends) and self.ends[resume] + shift < place:
                resume += 1
            if place >= start + len(new) and resume < len(self.ends) and self.ends[resume] + shift == place and self.ends[resume] >= end:
                resume += 1
                break
            piece = self.counter.pattern.match(text, place).group()
            pieces.append(piece)
            place += len(piece)
        else:
            resume = len(self.ends)
        counts = np.array(self.counter.counts(pieces), np.int64)
        self.encoded += len(pieces)
        ends = (int(self.ends[keep - 1]) if keep else 0) + np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        self._splice(keep, resume, counts)
        self.ends = np.concatenate([self.ends[:keep], ends, self.ends[resume:] + shift])
        self.counts = np.concatenate([self.counts[:keep], counts, self.counts[resume:]])
        self.text = text

    def _splice(self, keep: int, resume: int, counts: np.ndarray) -> None:
        """The leaves that held pre-tokens [keep, resume) are formed anew."""
        bounds = np.cumsum(self.sizes)
        first = min(int(np.searchsorted(bounds, keep, "right")), max(len(bounds) - 1, 0))
        last = max(int(np.searchsorted(bounds, resume, "left")), first)
        low = int(bounds[first - 1]) if first else 0
        high = int(bounds[last]) if last < len(bounds) else len(self.counts)
        region = np.concatenate([self.counts[low:keep], counts, self.counts[resume:high]])
        # as many leaves as before, so that sums change on their paths only, unless they got too large or small
        n = min(last + 1, len(self.sizes)) - first
        if not n * LEAF // 4 <= len(region) <= n * LEAF * 4 or len(region) < n or not n:
            n = max(1, round(len(region) / LEAF)) if len(region) else 0
        cuts = np.linspace(0, len(region), n + 1).astype(np.int64)
        sizes = np.diff(cuts)
        sums = np.add.reduceat(region, cuts[:-1]) if n else np.zeros(0, np.int64)
        self.tree.splice(first, min(last + 1, len(self.sizes)), sums)
        self.sizes = np.concatenate([self.sizes[:first], sizes, self.sizes[last + 1 :]])


def redactions(text: str) -> list[tuple[int, int, str]]:
    """Edits (start, end, replacement) that redact a text, from its end to its beginning."""
    found: list[tuple[int, int, str]] = []
    for pattern, placeholder in REDACTIONS:
        found += [(m.start(), m.end(), placeholder) for m in pattern.finditer(text)]
    found.sort(key=lambda e: (-e[1], -e[0]))
    out: list[tuple[int, int, str]] = []
    for e in found:
        if not out or e[1] <= out[-1][0]:
            out.append(e)
    return out


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The counter of this vocabulary, loaded once in each Python worker."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, edits=redactions, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens, edits, tokens_after, reencoded) of every document.

    ``edits`` gives the edits of a text; ``reencoded`` counts the pre-tokens that they
    made the document encode again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary)
        for batch in batches:
            rows: list[tuple[int, int, int, int]] = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                todo = edits(text)
                doc = Document(text, own)
                tokens, encoded = doc.tokens, doc.encoded
                for edit in todo:
                    doc.edit(*edit)
                rows.append((tokens, len(todo), doc.tokens, doc.encoded - encoded))
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "tokens", "edits", "tokens_after", "reencoded"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, tokens long, edits long, tokens_after long, reencoded long")
