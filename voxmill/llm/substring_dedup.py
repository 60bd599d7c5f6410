"""Substring deduplication by counting word windows in super-k-mer buckets.

Every window of ``WINDOW`` words of every document is counted: its super-k-mer brings it to
the bucket of its minimiser, where sorting puts windows of equal hash next to each other;
their words, lower-cased and without punctuation, are then compared.
Windows that occur at two places or more are merged into spans, apart for the first place
(least doc_id, then least position) and the later ones.

Defined cases: null texts and texts of fewer than ``WINDOW`` words have no windows; rows
with a null doc_id have no address and are left out; rows that repeat a doc_id are one
document, so a row repeated whole adds no occurrence; repeats within one document count.
Other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec
from .superkmers import Bucket, bucketed, chains

WINDOW = 50


def _spans(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = Bucket(batches)
        if bucket.empty:
            return
        found = chains(bucket, textvec.window_hash(bucket.words, k)[bucket.windows(k)], k)
        kept, first_doc = found.first == np.arange(len(found.first)), found.doc[found.first]
        order = np.lexsort((found.pos, found.doc, kept))
        doc, pos, length, first_doc, copies, kept = (x[order] for x in (found.doc, found.pos, found.length, first_doc, found.copies, kept))
        new = np.ones(len(doc), bool)
        new[1:] = (kept[1:] != kept[:-1]) | (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + length[:-1])
        starts = np.flatnonzero(new)
        if not len(starts):
            return
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (doc[starts], pos[starts], pos[starts] + np.add.reduceat(length, starts) - 1 + k, np.maximum.reduceat(copies, starts), np.minimum.reduceat(first_doc, starts), kept[starts])],
            names=["doc_id", "start_word", "end_word", "copies", "first_doc_id", "kept"],
        )

    return run


def repeated_spans(docs: DataFrame, k: int = WINDOW) -> DataFrame:
    """(doc_id, start_word, end_word, copies, first_doc_id, kept) of all repeated passages of k words or more.

    ``end_word`` is exclusive; ``copies`` is the most occurrences of a window of the
    span; ``kept`` tells the first occurrence, which stays, from later ones.
    """
    pieces = bucketed(docs, k).mapInArrow(_spans(k), "doc_id long, start_word long, end_word long, copies long, first_doc_id long, kept boolean")
    own = Window.partitionBy("doc_id", "kept").orderBy("start_word", "end_word")
    reach = F.max("end_word").over(own.rowsBetween(Window.unboundedPreceding, -1))
    marked = pieces.withColumn("fresh", F.coalesce((F.col("start_word") > reach).cast("int"), F.lit(1)))
    isles = marked.withColumn("isle", F.sum("fresh").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return isles.groupBy("doc_id", "kept", "isle").agg(
        F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), F.max("copies").alias("copies"), F.min("first_doc_id").alias("first_doc_id")
    ).select("doc_id", "start_word", "end_word", "copies", "first_doc_id", "kept")
