"""Near-duplicate groups by SimHash and Golay-code fuzzy hashing.

A document's fingerprint has 276 bits, voted by its distinct words, in twelve segments
of 23 bits. Golay decoding turns a segment into the one or six nearby codeword indices;
two segments that differ in at most two bits share one, and six of ten pairs that
differ in three or four bits do so too. Segments are joined in six pairs: a key is a
pair number and one index of either segment (24 bits), so a document has 36 keys a
pair at most. By the pigeonhole principle 17 differing bits cannot put three errors
into one segment of every pair, so documents that close always meet. ``MAX_BITS``
admits more, since a copy with 4 % of its words changed differs in some 25 bits, and one
with a line of boilerplate besides in some 45: there
the search is approximate, with a recall over 0.9 against brute force (see tests).
Documents that meet are verified by the distance of their whole fingerprints.

No bucket is capped. A bucket of many documents is walked breadth-first, each reached
document being compared with those not yet reached; this finds the same components as
all pairs do, and gives one edge a document.

Keys travel as packed blocks, one for each batch of documents and shuffle partition.

Defined cases: a document with a null text or without a word is near to nothing; a
null doc_id cannot be grouped and is left alone; rows with one doc_id are one document
(its least fingerprint distance counts), of which one row stays for each distinct
text; groups are connected components, and the least doc_id of each stays. Other
columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import golay, textvec
from .components import components
from .runtime import BLOCKS, block_batch, blocks_of, cut, exchange, pack, partitions, split_runs, unpack

PAIRS = 6
SEGMENTS = 2 * PAIRS
BITS = SEGMENTS * golay.BITS
MAX_BITS = 46
_BYTES = -(-BITS // 8)
_WORDS = -(-BITS // 64)
_SIGNS = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2 - 1)


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n, 5) uint64 fingerprints, and which texts have a word."""
    n = len(texts)
    out, any_word = np.zeros((n, _WORDS * 8), np.uint8), np.zeros(n, bool)
    for at, part in textvec.chunks(texts):
        hashes, first = textvec.words(part)
        m = len(part)
        doc = np.repeat(np.arange(m), np.diff(first))
        salted = textvec.mix(hashes + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, distinct = np.unique(salted, return_index=True)
        hashes, doc = hashes[distinct], doc[distinct]
        votes = np.empty((m, _BYTES * 8), np.float32)
        for k in range(0, _BYTES, 8):
            octets = textvec.mix(hashes + np.uint64(k + 1)).view(np.uint8).reshape(-1, 8)
            for j in range(min(8, _BYTES - k)):
                counts = np.bincount(doc * 256 + octets[:, j], minlength=m * 256).reshape(m, 256)
                votes[:, (k + j) * 8 : (k + j + 1) * 8] = counts.astype(np.float32) @ _SIGNS
        votes[:, BITS:] = 0
        out[at : at + m, :_BYTES] = np.packbits(votes > 0, axis=1, bitorder="little")
        any_word[at : at + m] = np.diff(first) > 0
    return out.view(np.uint64), any_word


def bits_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def key_table(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of fingerprints, and the row that each is of."""
    bits = np.unpackbits(prints.view(np.uint8).reshape(len(prints), -1), axis=1, bitorder="little")[:, :BITS]
    segments = bits.reshape(-1, SEGMENTS, golay.BITS).astype(np.int64) @ (1 << np.arange(golay.BITS))
    keys, rows = [], []
    for pair in range(PAIRS):
        a, b = golay.keys(segments[:, 2 * pair]), golay.keys(segments[:, 2 * pair + 1])
        both = ((pair << 24) | (a.astype(np.int64)[:, :, None] << 12) | b[:, None, :]).reshape(len(prints), -1)
        used = ((a >= 0)[:, :, None] & (b >= 0)[:, None, :]).reshape(len(prints), -1)
        rows.append(np.nonzero(used)[0])
        keys.append(both[used])
    return np.concatenate(keys), np.concatenate(rows)


def _print_column(prints: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in prints], pa.binary())


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints, any_word = fingerprints(batch.column(1))
        keep = pa.array(any_word)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), _print_column(prints[any_word])], names=["doc_id", "print"])


def _post(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            ids = np.asarray(batch.column(0)).astype(np.int64)
            prints = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, _WORDS)
            keys, rows = key_table(prints)
            part = (textvec.mix((keys >> 12).astype(np.uint64)) % np.uint64(n)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            keys, rows, part = keys[order], rows[order], part[order]
            starts, sizes = split_runs(part)
            blocks = []
            for s, m in zip(starts, sizes):
                used, local = np.unique(rows[s : s + m], return_inverse=True)
                blocks.append(pack(ids[used], prints[used].ravel(), keys[s : s + m].astype(np.uint32), local.astype(np.uint32)))
            yield block_batch(part[starts].tolist(), blocks)

    return run


def _walk(prints: np.ndarray, members: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the members within ``max_bits`` of each other."""
    left, frontier = members, []
    a, b = [], []
    while len(left):
        if not frontier:
            frontier.append(left[0])
            left = left[1:]
            continue
        here = frontier.pop()
        near = bits_apart(prints[left], prints[here]) <= max_bits
        found = left[near]
        a.append(np.full(len(found), here))
        b.append(found)
        frontier.extend(found)
        left = left[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (members[:0], members[:0])


SMALL = 24


def edges_of(ids: np.ndarray, prints: np.ndarray, keys: np.ndarray, rows: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified edges among rows that share a key."""
    order = np.argsort(keys, kind="stable")
    keys, rows = keys[order], rows[order].astype(np.int64)
    starts, sizes = split_runs(keys)
    found_a, found_b = [], []
    for size in np.unique(sizes):
        if size < 2:
            continue
        at = starts[sizes == size]
        if size > SMALL:
            for s in at:
                a, b = _walk(prints, rows[s : s + size], max_bits)
                found_a.append(a)
                found_b.append(b)
            continue
        i, j = np.triu_indices(size, 1)
        step = max(1, (1 << 19) // len(i))
        for k in range(0, len(at), step):
            a, b = (rows[(at[k : k + step, None] + x[None, :]).ravel()] for x in (i, j))
            near = bits_apart(prints[a], prints[b]) <= max_bits
            found_a.append(a[near])
            found_b.append(b[near])
    if not found_a:
        return ids[:0], ids[:0]
    a, b = ids[np.concatenate(found_a)], ids[np.concatenate(found_b)]
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first &= a != b
    return a[first], b[first]


def _match(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, prints, keys, rows = [], [], [], []
        at = 0
        for i, p, k, r in blocks_of(batches):
            ids.append(i)
            prints.append(p.reshape(-1, _WORDS))
            keys.append(k)
            rows.append(r.astype(np.int64) + at)
            at += len(i)
        if not ids:
            return
        a, b = edges_of(np.concatenate(ids), np.concatenate(prints), np.concatenate(keys), np.concatenate(rows), max_bits)
        for s in range(0, len(a), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[s : s + 100_000]), pa.array(b[s : s + 100_000])], names=["a", "b"])

    return run


def document_prints(docs: DataFrame) -> DataFrame:
    """(doc_id, print), written once: every later step reads it instead of the texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    return cut(rows.mapInArrow(_fingerprint, "doc_id long, print binary"))


def near_groups(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, keep_doc_id) of every document in a group of two or more; each group is a component.

    Documents with one fingerprint are one node of the search, named by their least doc_id.
    """
    n = partitions(prints.sparkSession)
    groups = prints.groupBy("print").agg(F.min("doc_id").alias("node"), F.count("*").alias("n"))
    # minima are combined before the shuffle; only prints of several documents are joined back
    many = groups.filter("n > 1").select("print", "node")
    same = prints.join(many, "print").filter("node <> doc_id").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    distinct = groups.select("node", "print")
    near = exchange(distinct.mapInArrow(_post(n), BLOCKS), n).mapInArrow(_match(max_bits), "a long, b long")
    return components(same.unionByName(near)).select(F.col("node").alias("doc_id"), F.col("root").alias("keep_doc_id"))


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, keep_doc_id) for every document that goes in favour of another of its group."""
    return near_groups(document_prints(docs), max_bits).filter("doc_id <> keep_doc_id")


def drop_near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one document of each group; all columns kept."""
    prints = document_prints(docs)
    gone = near_groups(prints, max_bits).filter("doc_id <> keep_doc_id").select(F.col("doc_id").alias("__vm_gone"))
    kept = docs.join(gone, docs["doc_id"] == gone["__vm_gone"], "left_anti")
    again = cut(prints.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("__vm_again")))
    if again.isEmpty():
        return kept
    rows = kept.join(again, kept["doc_id"] == again["__vm_again"], "left_semi")
    order = Window.partitionBy("doc_id", "text").orderBy(F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns]))
    first = rows.withColumn("__vm_row", F.row_number().over(order)).filter("__vm_row = 1").drop("__vm_row")
    return kept.join(again, kept["doc_id"] == again["__vm_again"], "left_anti").unionByName(first)
