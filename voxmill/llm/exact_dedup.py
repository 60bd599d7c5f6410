"""Exact deduplication on a cuckoo-filter index.

Every text has a 128-bit digest. Digests are split over index shards by the shuffle;
a shard holds a cuckoo filter of its live digests and, per digest, the content that
it stands for. A miss in the filter proves that a text is new. A hit is only a
suspicion: it is verified against the content kept for that digest, so neither a
false positive of the filter nor a digest collision ever drops a text. Live digests can
be deleted; when an insertion finds no slot the filter is rebuilt, twice as large,
from the keys stored with the content.

Before the shuffle each batch goes through an index of its own, so that copies which
lie together travel as one text with a list of ids, however many they are.

Defined cases: a null text is no copy of anything; empty texts are copies of each
other; a null doc_id comes last in the order that picks the kept row; rows that repeat
a doc_id and its text are copies (one stays); other columns play no part, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import exchange, partitions

SLOTS = 4
MAX_KICKS = 200


def digest(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), "little")


class CuckooIndex:
    """A cuckoo filter of 16-bit fingerprints over buckets of content, keyed by digest."""

    def __init__(self, capacity: int = 64):
        self.buckets = 1
        while self.buckets * SLOTS * 0.9 < capacity:
            self.buckets *= 2
        self.table = array("H", bytes(2 * SLOTS * self.buckets))
        self.content: dict[int, list] = {}
        self.resizes = 0

    def _places(self, key: int) -> tuple[int, int, int]:
        mark = (key & 0xFFFF) or 1
        first = (key >> 16) & (self.buckets - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995 >> 7)) & (self.buckets - 1)

    def suspects(self, key: int) -> bool:
        mark, a, b = self._places(key)
        t = self.table
        return mark in t[a * SLOTS : a * SLOTS + SLOTS] or mark in t[b * SLOTS : b * SLOTS + SLOTS]

    def _place(self, key: int) -> bool:
        mark, a, b = self._places(key)
        t = self.table
        for bucket in (a, b):
            for s in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not t[s]:
                    t[s] = mark
                    return True
        bucket = b
        for kick in range(MAX_KICKS):
            s = bucket * SLOTS + (kick + mark) % SLOTS
            mark, t[s] = t[s], mark
            bucket = self._other(bucket, mark)
            for s in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not t[s]:
                    t[s] = mark
                    return True
        return False

    def _resize(self) -> None:
        """A larger filter from the stored keys; the fingerprint left over by kicks is among them."""
        while True:
            self.buckets *= 2
            self.resizes += 1
            self.table = array("H", bytes(2 * SLOTS * self.buckets))
            if all(self._place(key) for key in self.content):
                return

    def find(self, key: int, text: str):
        """What is kept with ``text``, or None; a filter hit is verified against the content."""
        if self.suspects(key):
            for kept, value in self.content.get(key, ()):
                if kept == text:
                    return value
        return None

    def insert(self, key: int, text: str, value) -> None:
        bucket = self.content.get(key)
        if bucket is not None:
            bucket.append((text, value))
            return
        self.content[key] = [(text, value)]
        if not self._place(key):
            self._resize()

    def delete(self, key: int, text: str) -> bool:
        """Takes a live text out; True if it was there."""
        bucket = self.content.get(key) if self.suspects(key) else None
        left = [x for x in bucket or () if x[0] != text]
        if bucket is None or len(left) == len(bucket):
            return False
        if left:
            self.content[key] = left
            return True
        del self.content[key]
        mark, a, b = self._places(key)
        for bucket_no in (a, b):
            for s in range(bucket_no * SLOTS, bucket_no * SLOTS + SLOTS):
                if self.table[s] == mark:
                    self.table[s] = 0
                    return True
        raise AssertionError("a live digest has no slot")


LIVE, DELETE, NEW = 0, 1, 2
_KEYS = T.StructType().add("part", T.IntegerType()).add("op", T.IntegerType()).add("text", T.StringType()).add("ids", T.ArrayType(T.LongType()))


def _collapse(n: int):
    """Batches of (op, doc_id, text) to one row for each distinct (op, text) of the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ops, ids, texts = (batch.column(i).to_pylist() for i in range(3))
            out: list[tuple] = []
            seen = {op: CuckooIndex(len(texts)) for op in set(ops)}
            for op, doc, text in zip(ops, ids, texts):
                if text is None:
                    continue
                key = digest(text)
                held = seen[op].find(key, text)
                if held is None:
                    held = []
                    seen[op].insert(key, text, held)
                    out.append(((key >> 64) % n, op, text, held))
                held.append(doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), kind) for c, kind in zip(zip(*out) if out else ([],) * 4, (pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int64())))],
                names=["part", "op", "text", "ids"],
            )

    return run


def _last(doc: int | None) -> tuple:
    return (doc is None, doc or 0)


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One shard: live texts in, deletions out, then the new texts against what is live."""
    rows: dict[int, list[tuple]] = {LIVE: [], DELETE: [], NEW: []}
    for batch in batches:
        for op, text, ids in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
            rows[op].append((digest(text), text, ids))
    index = CuckooIndex()
    groups: list[tuple[list, list]] = []
    for op in (LIVE, DELETE, NEW):
        for key, text, ids in rows[op]:
            if op == DELETE:
                index.delete(key, text)
                continue
            held = index.find(key, text)
            if held is None:
                held = ([], [])
                index.insert(key, text, held)
                groups.append(held)
            held[op == NEW].extend(ids)
    out: tuple[list, list, list] = ([], [], [])

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "keep_doc_id", "copies"])
        for c in out:
            c.clear()
        return made

    live = {id(v) for bucket in index.content.values() for _, v in bucket}
    for held in groups:
        old, new = held
        if id(held) not in live or len(old) + len(new) < 2 or not new:
            continue
        new.sort(key=_last)
        keep = min(old, key=_last) if old else new[0]
        for doc in new if old else new[1:]:
            out[0].append(doc)
            out[1].append(keep)
            out[2].append(len(old) + len(new))
        if len(out[0]) > 50_000:
            yield batch()
    yield batch()


def exact_duplicates(docs: DataFrame, live: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """(doc_id, keep_doc_id, copies) for every row of ``docs`` that copies an earlier one.

    The kept row is the one with the least doc_id; ``copies`` counts all rows with the
    text. ``live`` holds documents that the index already has, ``deleted`` those to take
    out of it first; a copy of a live document is kept as that document.
    """
    ops = [
        df.select(F.lit(op).alias("op"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        for op, df in ((LIVE, live), (DELETE, deleted), (NEW, docs))
        if df is not None
    ]
    rows = ops[0]
    for more in ops[1:]:
        rows = rows.unionByName(more)
    n = partitions(docs.sparkSession)
    return exchange(rows.mapInArrow(_collapse(n), _KEYS), n).mapInArrow(_decide, "doc_id long, keep_doc_id long, copies long")


class _Best:
    """The row of a text that stays: least doc_id, then the least other values."""

    __slots__ = ("order", "place")

    def __init__(self, order: tuple, place: tuple[int, int]):
        self.order, self.place = order, place


def _winners(batches: Iterator[tuple[int, pa.StructArray]], index: CuckooIndex, id_at: int, text_at: int) -> tuple[list, list[_Best]]:
    kept, best = [], []
    for b, rows in batches:
        kept.append(rows)
        ids, texts = rows.field(id_at).to_pylist(), rows.field(text_at).to_pylist()
        for i, (doc, text) in enumerate(zip(ids, texts)):
            if text is None:
                best.append(_Best((), (b, i)))
                continue
            key = digest(text)
            held = index.find(key, text)
            if held is None:
                held = _Best((_last(doc), None), (b, i))
                index.insert(key, text, held)
                best.append(held)
                continue
            order = (_last(doc), None)
            if order[0] > held.order[0]:
                continue
            if order[0] == held.order[0]:
                there = held.order[1] or repr(kept[held.place[0]][held.place[1]].as_py())
                here = repr(rows[i].as_py())
                if here >= there:
                    held.order = (order[0], there)
                    continue
                order = (order[0], here)
            held.order, held.place = order, (b, i)
    return kept, best


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row for each text, all columns kept; rows with a null text all stay."""
    names = docs.columns
    low = [c.lower() for c in names]
    id_at, text_at = low.index("doc_id"), low.index("text")
    n = partitions(docs.sparkSession)
    carried = T.StructType().add("part", T.IntegerType()).add("row", docs.schema)

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.StructArray.from_arrays(batch.columns, fields=list(batch.schema))
            _, best = _winners(iter([(0, rows)]), CuckooIndex(len(rows)), id_at, text_at)
            at = [x.place[1] for x in best]
            texts = rows.field(text_at)
            part = [i % n if (t := texts[i].as_py()) is None else (digest(t) >> 64) % n for i in at]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), rows.take(pa.array(at, pa.int64()))], names=["part", "row"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, best = _winners(((b, batch.column(1)) for b, batch in enumerate(batches)), CuckooIndex(), id_at, text_at)
        by: dict[int, list[int]] = {}
        for x in best:
            by.setdefault(x.place[0], []).append(x.place[1])
        for b, at in sorted(by.items()):
            rows = kept[b].take(pa.array(sorted(at), pa.int64()))
            yield pa.RecordBatch.from_arrays(rows.flatten(), names=[f.name for f in rows.type])

    return exchange(docs.mapInArrow(collapse, carried), n).mapInArrow(decide, docs.schema)
