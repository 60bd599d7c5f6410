"""Super-k-mers of word windows, brought to the bucket of their minimiser.

A window is ``k`` consecutive words of a document. Its minimiser is the ``M``-word
sequence in it of least hash, wherever it stands. Consecutive windows with one minimiser
overlap in all but one word, so they travel as one string of words. Equal windows have equal minimisers
and meet in one bucket, wherever they come from.

Equal super-k-mers travel and are held once, with a list of the places (document and first
word) at which they stand: those of one block before the shuffle, all of a bucket
after it. So a passage that many documents share costs a bucket its text once and 16
bytes a document. Windows are told apart among the distinct super-k-mers only, and runs
of windows that keep the same company go on together as a chain.

Hashes only propose: super-k-mers are united, and windows of a chain taken as equal, where
their words are, byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .runtime import BLOCKS, block_batch, blocks_of, exchange, pack, partitions, ranges, split_runs

M = 8
FLUSH = 4 << 20
HELD = 64 << 20
SPACE = 32


def _cut(texts: pa.Array, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """What ``super_kmers`` gives, and a hash of the words of each, and whether its minimiser moves."""
    m = min(M, k)
    for at, part in textvec.chunks(texts):
        data, off = textvec.byte_view(pc.utf8_lower(part))
        begin, end = textvec.spans(data, off)
        first = np.searchsorted(begin, off)
        sizes = np.diff(first)
        valid = ranges(first[:-1], np.maximum(sizes - k + 1, 0))
        if not len(valid):
            continue
        hashes = textvec.range_hash(data, begin, end)
        grams = textvec.mix(textvec.window_hash(hashes, m) ^ np.uint64(0x5851F42D4C957F2D))
        where = textvec.sliding_argmin(grams, k - m + 1)[valid]
        least = grams[where]
        row = np.repeat(np.arange(len(part)), np.maximum(sizes - k + 1, 0))
        new = np.ones(len(valid), bool)
        new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
        starts = np.flatnonzero(new)
        count = np.diff(np.append(starts, len(valid)))
        p = valid[starts]
        lengths = end - begin
        places = np.concatenate(([0], np.cumsum(lengths + 1)))
        words = np.full(int(places[-1]), SPACE, np.uint8)
        words[ranges(places[:-1], lengths)] = data[ranges(begin, lengths)]
        rows, size = row[starts], count + k - 1
        # the minimiser stands in it more than once, so the windows of one string may be equal
        twice = where[starts] != where[starts + count - 1]
        yield at + rows, p - first[rows], size, least[starts], places[p], places[p + size], words, textvec.range_hash(hashes, p, p + size), twice


def super_kmers(texts: pa.Array, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, first word, words, minimiser, begin, end, bytes) of the super-k-mers of a chunk at a time.

    ``bytes`` holds the chunk's lower-cased words, each with a space behind it; a
    super-k-mer is the slice from begin to end.
    """
    for found in _cut(texts, k):
        yield found[:7]


@dataclass
class Strings:
    """Distinct super-k-mers: words, bytes, minimiser, hash and whether it moves of each, and their texts one
    after another; ``doc``, ``start`` and ``of`` (which string) of every place."""

    doc: np.ndarray
    start: np.ndarray
    of: np.ndarray
    count: np.ndarray
    size: np.ndarray
    key: np.ndarray
    hash: np.ndarray
    twice: np.ndarray
    text: np.ndarray

    def pack(self) -> bytes:
        narrow = (x.astype(np.uint32) for x in (self.start, self.of, self.count, self.size))
        return pack(self.doc, *narrow, self.key, self.hash, self.twice.astype(np.uint8), self.text)

    @staticmethod
    def unpack(arrays: list[np.ndarray]) -> Strings:
        doc, start, of, count, size, key, hash_, twice, text = arrays
        return Strings(doc, *(x.astype(np.int64) for x in (start, of, count, size)), key, hash_, twice.astype(bool), text)

    def chosen(self, some: np.ndarray) -> Strings:
        """The strings at ``some`` (rising), with their places."""
        number = np.full(len(self.count), -1, np.int64)
        number[some] = np.arange(len(some))
        of = number[self.of]
        here = of >= 0
        begin = np.cumsum(self.size) - self.size
        return Strings(self.doc[here], self.start[here], of[here], self.count[some], self.size[some], self.key[some], self.hash[some], self.twice[some], self.text[ranges(begin[some], self.size[some])])


def unite(parts: list[Strings]) -> Strings:
    """All strings of the parts, equal ones as one with the places of all."""
    shift = np.cumsum([0] + [len(p.count) for p in parts])
    one = Strings(
        *(np.concatenate([getattr(p, name) for p in parts]) for name in ("doc", "start")),
        np.concatenate([p.of + n for p, n in zip(parts, shift)]),
        *(np.concatenate([getattr(p, name) for p in parts]) for name in ("count", "size", "key", "hash", "twice", "text")),
    )
    n = len(one.count)
    order = np.lexsort((one.size, one.hash, one.key))
    new = np.ones(n, bool)
    new[1:] = (one.key[order][1:] != one.key[order][:-1]) | (one.hash[order][1:] != one.hash[order][:-1]) | (one.size[order][1:] != one.size[order][:-1])
    begin = np.cumsum(one.size) - one.size
    head = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    again = ~new
    again[again] = same_bytes(one.text, begin[head[again]], begin[order[again]], one.size[order[again]])
    stands_for = np.arange(n)
    stands_for[order[again]] = head[again]
    one.of = stands_for[one.of]
    return one.chosen(np.flatnonzero(stands_for == np.arange(n)))


def same_bytes(text: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, block: int = 1 << 22) -> np.ndarray:
    """Whether the slices of ``size`` (positive) bytes from a and from b are equal; a block of bytes at a time."""
    out = np.empty(len(a), bool)
    ends = np.cumsum(size)
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + block, "right")))
        equal = text[ranges(a[i:j], size[i:j])] == text[ranges(b[i:j], size[i:j])]
        out[i:j] = np.logical_and.reduceat(equal, ends[i:j] - ends[i] + size[i] - size[i:j])
        i = j
    return out


def _post(k: int, n: int):
    def blocks(held: list[Strings]) -> pa.RecordBatch:
        one = unite(held)
        part = (one.key % np.uint64(n)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        runs, sizes = split_runs(part[order])
        made = [one.chosen(np.sort(order[s : s + size])).pack() for s, size in zip(runs, sizes)]
        return block_batch(part[order][runs].tolist(), made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids = np.asarray(batch.column(0)).astype(np.int64)
            for row, start, count, key, begin, end, words, hashed, twice in _cut(batch.column(1), k):
                held.append(Strings(ids[row], start, np.arange(len(row)), count, end - begin, key, hashed, twice, words[ranges(begin, end - begin)]))
                size += len(words)
                if size > FLUSH:
                    yield blocks(held)
                    held, size = [], 0
        if held:
            yield blocks(held)

    return run


def bucketed(docs: DataFrame, k: int, times: int = 4) -> DataFrame:
    """Packed super-k-mers of all documents, each partition with whole buckets."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    n = partitions(docs.sparkSession, times)
    return exchange(rows.mapInArrow(_post(k, n), BLOCKS), n)


class Bucket:
    """The distinct super-k-mers of a partition whose minimiser stands at two places or more there.

    ``strings`` are they; ``words`` the hashes of all their words, ``begin`` and ``end`` the
    bytes of each, ``at`` the first word of each string.
    """

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        held, size, most = [], 0, HELD
        for arrays in blocks_of(batches):
            held.append(Strings.unpack(arrays))
            size += len(held[-1].text)
            if size > most:
                held = [unite(held)]
                size = len(held[0].text)
                most = max(HELD, 2 * size)
        self.empty = not held
        if self.empty:
            return
        one = unite(held)
        _, inverse = np.unique(one.key, return_inverse=True)
        again = np.flatnonzero((np.bincount(inverse[one.of])[inverse] > 1) | one.twice)
        self.empty = not len(again)
        if self.empty:
            return
        self.strings = one.chosen(again)
        self.end = np.flatnonzero(self.strings.text == SPACE)
        self.begin = np.concatenate(([0], self.end[:-1] + 1))
        self.words = textvec.range_hash(self.strings.text, self.begin, self.end)
        self.at = np.cumsum(self.strings.count) - self.strings.count

    def windows(self, k: int) -> np.ndarray:
        """Place among the words of every window, string by string."""
        return ranges(self.at, self.strings.count - k + 1)


def _classes(bucket: Bucket, k: int) -> np.ndarray:
    """Numbers of the windows by their bytes, one after another: only where hashes collide."""
    known: dict[bytes, int] = {}
    raw = bucket.strings.text
    return np.array([known.setdefault(raw[bucket.begin[w] : bucket.end[w + k - 1]].tobytes(), len(known)) for w in bucket.windows(k)], np.int64)


@dataclass
class Chains:
    """Places of chains, sorted by chain and then by (doc, pos), without repeats, two at least a chain.

    ``length`` is how many windows the chain has, ``first`` where its first place is in these arrays,
    ``copies`` how many places it has.
    """

    doc: np.ndarray
    pos: np.ndarray
    length: np.ndarray
    first: np.ndarray
    copies: np.ndarray


def chains(bucket: Bucket, same: np.ndarray, k: int, exact: bool = False) -> Chains:
    """Chains of windows of the bucket, of which those with one number in ``same`` are taken as equal.

    A class of equal windows goes on as the class of the windows one word on where these
    are all of that class, and as many. The classes of a chain have the same places but for
    the shift.
    """
    strings = bucket.strings
    per = strings.count - k + 1
    string = np.repeat(np.arange(len(per)), per)
    offset = ranges(np.zeros(len(per), np.int64), per)
    _, cls = np.unique(same, return_inverse=True)
    order = np.argsort(cls, kind="stable")
    starts, members = split_runs(cls[order])
    following = np.full(len(cls), -1, np.int64)
    inner = np.flatnonzero(offset < per[string] - 1)
    following[inner] = cls[inner + 1]
    low, high = (f.reduceat(following[order], starts) for f in (np.minimum, np.maximum))
    goes_on = (low == high) & (low >= 0)
    goes_on[goes_on] = members[low[goes_on]] == members[goes_on]
    head = np.ones(len(members), bool)
    head[low[goes_on]] = False
    stops = np.flatnonzero(~goes_on[cls])
    leader = order[starts]
    length = stops[np.searchsorted(stops, leader)] - leader + 1
    places = np.bincount(strings.of, minlength=len(per))
    total = np.add.reduceat(places[string][order], starts)
    heads = order[np.repeat(head & (total > 1), members)]
    # the words of each member of a chain against those of its first one
    if not exact:
        others = heads[heads != leader[cls[heads]]]
        words = bucket.windows(k)
        mine, theirs, last = words[others], words[leader[cls[others]]], length[cls[others]] + k - 2
        sizes = bucket.end[mine + last] - bucket.begin[mine]
        fits = sizes == bucket.end[theirs + last] - bucket.begin[theirs]
        if not fits.all() or not same_bytes(strings.text, bucket.begin[mine], bucket.begin[theirs], sizes).all():
            return chains(bucket, _classes(bucket, k), k, exact=True)
    by_string = np.argsort(strings.of, kind="stable")
    cuts = np.cumsum(places) - places
    s = string[heads]
    at = by_string[ranges(cuts[s], places[s])]
    chain = np.repeat(cls[heads], places[s])
    doc, pos = strings.doc[at], strings.start[at] + np.repeat(offset[heads], places[s])
    order = np.lexsort((pos, doc, chain))
    chain, doc, pos = chain[order], doc[order], pos[order]
    fresh = np.ones(len(chain), bool)
    fresh[1:] = (chain[1:] != chain[:-1]) | (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])
    chain, doc, pos = chain[fresh], doc[fresh], pos[fresh]
    _, sizes = split_runs(chain)
    many = np.repeat(sizes > 1, sizes)
    sizes = sizes[sizes > 1]
    return Chains(doc[many], pos[many], length[chain[many]], np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(sizes, sizes))
