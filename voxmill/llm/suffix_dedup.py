"""Suffix-array deduplication by bucket-pointer refinement.

Suffixes are sorted as far as ``DEPTH`` words, which is what a repeated passage must have.
The sort is distributed by content: regions of the documents go to the bucket of their
minimiser (see superkmers), so all suffixes that agree in ``DEPTH`` words lie in one
partition. A region whose minimiser is alone there has no equal suffix and is done.

In a partition the suffixes get initial buckets by their first two words. A bucket pointer
is the last place of the suffix's bucket in the array. Buckets of several suffixes are
refined by sorting them on the bucket pointers of the suffixes ``offset`` words on; the
pointers are updated and are the keys of the next refinement, which therefore reaches
twice as deep: 2, 4, 8, 16, 32 and 50 words. Suffixes alone in their bucket are final
and take no further part.

Suffixes that share a bucket at the end repeat each other. Each is matched with the one
before it in the bucket (by doc_id, then position; the first stands for itself), and
matches that continue each other on one diagonal are joined.

Defined cases: as in substring_dedup: null and short texts have no suffix deep enough, rows
with a null doc_id are left out, rows that repeat a doc_id are one document, repeats
within one document count, and other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import split_runs
from .superkmers import Bucket, bucketed, chains

DEPTH = 50


def bucket_pointers(words: np.ndarray, room: np.ndarray, depth: int) -> np.ndarray:
    """Bucket pointers of the suffixes of ``words`` sorted by ``depth`` words (at least 2).

    ``room`` is how many words a suffix has before its region ends. Pointers are defined
    where ``room`` is ``depth`` or more; two of those are equal just if the suffixes are.
    """
    n = len(words)
    pointers = np.full(n, -1, np.int64)
    at = np.flatnonzero(room >= 2)
    if not len(at):
        return pointers
    key = words[at].astype(np.int64) * (int(words.max()) + 1) + words[at + 1]
    order = np.argsort(key, kind="stable")
    starts, sizes = split_runs(key[order])
    pointers[at[order]] = np.repeat(starts + sizes - 1, sizes)
    open_, reached = at[order][np.repeat(sizes > 1, sizes)], 2
    while reached < depth:
        offset = min(reached, depth - reached)
        open_ = open_[room[open_] >= reached + offset]
        own, later = pointers[open_], pointers[open_ + offset]
        order = np.lexsort((later, own))
        open_, own, later = open_[order], own[order], later[order]
        new = np.ones(len(open_), bool)
        new[1:] = (own[1:] != own[:-1]) | (later[1:] != later[:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(open_)))
        bucket_starts, bucket_sizes = split_runs(own)
        # a bucket's places end at its pointer; its parts fill them from the end backwards
        last = np.repeat(bucket_starts + bucket_sizes - 1, bucket_sizes)
        part_last = np.repeat(starts + sizes - 1, sizes)
        pointers[open_] = own - (last - part_last)
        open_ = open_[np.repeat(sizes > 1, sizes)]
        reached += offset
    return pointers


def _matches(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = Bucket(batches)
        if bucket.empty:
            return
        count = bucket.strings.count
        words = np.unique(bucket.words, return_inverse=True)[1]
        room = np.repeat(bucket.at + count, count) - np.arange(len(words))
        found = chains(bucket, bucket_pointers(words, room, depth)[bucket.windows(depth)], depth)
        later = np.flatnonzero(found.first != np.arange(len(found.first)))
        doc, pos, length, source, shift = found.doc[later], found.pos[later], found.length[later], found.doc[later - 1], found.pos[later - 1] - found.pos[later]
        order = np.lexsort((pos, shift, source, doc))
        doc, pos, length, source, shift = doc[order], pos[order], length[order], source[order], shift[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (source[1:] != source[:-1]) | (shift[1:] != shift[:-1]) | (pos[1:] != pos[:-1] + length[:-1])
        starts = np.flatnonzero(new)
        if not len(starts):
            return
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (doc[starts], pos[starts], pos[starts] + np.add.reduceat(length, starts) - 1 + depth, source[starts], shift[starts])],
            names=["doc_id", "start_word", "end_word", "source_doc_id", "shift"],
        )

    return run


def repeated_suffixes(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, start_word, end_word, source_doc_id, source_start_word) of every later copy of a passage.

    The passage [start_word, end_word) of doc_id stands at source_start_word of
    source_doc_id too, and each of its runs of ``depth`` words nowhere between the two in the
    order of doc_id and position.
    """
    pieces = bucketed(docs, depth).mapInArrow(_matches(depth), "doc_id long, start_word long, end_word long, source_doc_id long, shift long")
    own = Window.partitionBy("doc_id", "source_doc_id", "shift").orderBy("start_word", "end_word")
    reach = F.max("end_word").over(own.rowsBetween(Window.unboundedPreceding, -1))
    marked = pieces.withColumn("fresh", F.coalesce((F.col("start_word") > reach).cast("int"), F.lit(1)))
    isles = marked.withColumn("isle", F.sum("fresh").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    joined = isles.groupBy("doc_id", "source_doc_id", "shift", "isle").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"))
    return joined.select("doc_id", "start_word", "end_word", "source_doc_id", (F.col("start_word") + F.col("shift")).alias("source_start_word"))
