"""Best-fit packing of documents into sequences by bin completion.

A document is as long as its words, parted by white space. Every ``CAPACITY`` words of a
longer document are a full sequence of their own; its rest is packed as a document.
Documents are spread by hash over groups of about ``GROUP`` pieces, so groups are alike at
every size of table, and each group is one packing problem.

In a group best-fit decreasing gives the first incumbent. If it uses more sequences
than the lower bound, a branch-and-bound search tries to do better: the largest piece
left is put into a sequence, the undominated fillings of the room beside it are
enumerated in the order of least waste, and each is completed in turn. A branch is cut
when the waste so far shows that it cannot beat the incumbent. A filling is dominated
where one piece of it can be exchanged for a larger one that still fits. No filling is
left out, but the search looks at ``NODES`` of them at most; what it has not settled by then
keeps its incumbent, a complete packing of every piece.

Defined cases: a null text or one without a word has length 0 and is placed, with
length 0, in a sequence; ties in length go by doc_id, nulls last, then by place in the
document; repeated rows are packed each. Other columns play no part, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import partitions

CAPACITY = 2048
GROUP = 2048
NODES = 20_000
FIRST = 8


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Sequences that any packing needs: by total, and by pieces that cannot share (Martello-Toth L2)."""
    best = -(-sum(sizes) // capacity)
    ordered = np.sort(np.array(sizes, np.int64))
    below = np.concatenate(([0], np.cumsum(ordered)))
    for k in np.unique(ordered[ordered * 2 <= capacity]).tolist() + [0]:
        large = int(np.searchsorted(ordered, capacity - k, "right"))
        half = int(np.searchsorted(ordered, capacity / 2, "right"))
        small = int(np.searchsorted(ordered, k, "left"))
        half = min(half, large)
        n_large, n_half = len(ordered) - large, large - half
        room = n_half * capacity - int(below[large] - below[half])
        more = max(0, -(-(int(below[half] - below[small]) - room) // capacity))
        best = max(best, n_large + n_half + more)
    return best


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of places in ``sizes``, which fall; each piece goes to the fullest bin that holds it."""
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []
    for i, size in enumerate(sizes):
        at = bisect_left(rooms, (size, -1))
        if at == len(rooms):
            bins.append([i])
            insort(rooms, (capacity - size, len(bins) - 1))
            continue
        room, b = rooms.pop(at)
        bins[b].append(i)
        insort(rooms, (room - size, b))
    return bins


def fillings(values: list[int], counts: dict[int, int], room: int) -> Iterator[tuple[int, ...] | None]:
    """Undominated multisets of ``values`` (falling, by counts) that fit ``room``, least waste first.

    Sums that the values from a place on can reach are kept as bits, so only fillings of
    the waste at hand are gone through. A filling is dominated where a piece left out fits its
    remaining room, or can replace a smaller one of it; None stands for it. Those of the
    least waste never are.
    """
    values = [v for v in values if v <= room and counts[v]]
    mask = (1 << room + 1) - 1
    reach = [1] * (len(values) + 1)
    for i in range(len(values) - 1, -1, -1):
        sums, v, n, step = reach[i + 1], values[i], min(counts[values[i]], room // values[i]), 1
        while n:
            step = min(step, n)
            sums |= sums << v * step & mask
            n -= step
            step *= 2
        reach[i] = sums
    rising = values[::-1]

    def undominated(chosen: tuple[int, ...], left: int) -> bool:
        used = Counter(chosen)
        for low in (0, *used):
            for v in rising[bisect_right(rising, low) : bisect_right(rising, low + left)]:
                if counts[v] > used[v]:
                    return False
        return True

    def filled(target: int) -> Iterator[tuple[int, ...]]:
        """All multisets of this sum; every branch that is entered has one."""
        todo: list[tuple[int, int, tuple[int, ...]]] = [(0, target, ())]
        while todo:
            at, left, chosen = todo.pop()
            if not left:
                yield chosen
                continue
            while values[at] > left or not reach[at] >> left & 1:
                at += 1
            v = values[at]
            for n in range(min(counts[v], left // v) + 1):
                if reach[at + 1] >> left - n * v & 1:
                    todo.append((at + 1, left - n * v, (*chosen, *(v,) * n)))

    least = room + 1 - reach[0].bit_length()
    for waste in range(least, room + 1):
        if reach[0] >> room - waste & 1:
            for chosen in filled(room - waste):
                yield chosen if waste == least or undominated(chosen, waste) else None


def search(sizes: list[int], capacity: int, nodes: int = NODES) -> tuple[list[list[int]], int]:
    """Bins of places in ``sizes`` (positive, falling, none over capacity), and the fillings looked at."""
    best = best_fit_decreasing(sizes, capacity)
    bound = lower_bound(sizes, capacity)
    if len(best) <= bound:
        return best, 0
    counts = dict(Counter(sizes))
    total = sum(sizes)
    best_values: list[tuple[int, ...]] | None = None
    best_n = len(best)
    seen = 0
    # explicit stack: each level holds its remaining fillings, the one in use, and how to go on
    levels: list[list] = []
    values = sorted(counts, reverse=True)
    waste = 0
    left = len(sizes)

    def open_level(skip: int = 0, more: int = FIRST) -> list:
        """The next ``more`` fillings beside the largest piece; they are found anew, since few levels need more than the first."""
        nonlocal seen
        largest = next(v for v in values if counts[v])
        counts[largest] -= 1
        found = list(islice(fillings(values, counts, capacity - largest), skip, skip + more))
        counts[largest] += 1
        seen += len(found)
        return [iter([(largest, *f) for f in found if f is not None]), None, skip + more if len(found) == more else 0, more]

    levels.append(open_level())
    while levels and seen < nodes and best_n > bound:
        level = levels[-1]
        if level[1] is not None:
            for v in level[1]:
                counts[v] += 1
            left += len(level[1])
            waste -= capacity - sum(level[1])
            level[1] = None
        option = next(level[0], None)
        if option is None:
            if level[2]:
                levels[-1] = open_level(level[2], level[3] * 8)
            else:
                levels.pop()
            continue
        spare = capacity - sum(option)
        # total + waste of all bins must fit the incumbent less one bin; later fillings waste no less
        if total + waste + spare > (best_n - 1) * capacity and left > len(option):
            level[0], level[2] = iter(()), 0
            continue
        for v in option:
            counts[v] -= 1
        left -= len(option)
        waste += spare
        level[1] = option
        if not left:
            if len(levels) < best_n:
                best_n = len(levels)
                best_values = [x[1] for x in levels]
            continue
        if len(levels) + 1 < best_n:
            levels.append(open_level())
    if best_values is None:
        return best, seen
    places: dict[int, list[int]] = {}
    for i in range(len(sizes) - 1, -1, -1):
        places.setdefault(sizes[i], []).append(i)
    return [[places[v].pop() for v in values] for values in best_values], seen


def bin_completion(sizes: list[int], capacity: int, nodes: int = NODES) -> list[list[int]]:
    return search(sizes, capacity, nodes)[0]


def pack_group(lengths: np.ndarray, capacity: int, nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece of a group; pieces come in falling length."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    positive = int((lengths > 0).sum())
    for b, places in enumerate(bin_completion(lengths[:positive].tolist(), capacity, nodes) if positive else []):
        at = 0
        for i in sorted(places):
            bins[i], offsets[i] = b, at
            at += int(lengths[i])
    return bins, offsets


def pieces(docs: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, n_words): full sequences first, then the rest."""
    text = F.col("text").cast("string")
    words = F.coalesce(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(text.isNull(), 0).otherwise(words).alias("words"))
    last = F.greatest(F.ceil(F.col("words") / capacity), F.lit(1)) - 1
    return rows.select("doc_id", "words", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("piece")).select(
        "doc_id", "piece", F.least(F.lit(capacity).cast("long"), F.col("words") - F.col("piece") * capacity).alias("n_words")
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP, nodes: int = NODES) -> DataFrame:
    """(doc_id, piece, n_words, sequence, position) of every piece of every document.

    ``sequence`` names the sequence ("group-number"; "full-doc-piece" where a piece fills
    one alone), ``position`` is the piece's first word in it.
    """
    cut = pieces(docs, capacity)
    full = cut.filter(F.col("n_words") == capacity).select(
        "doc_id", "piece", "n_words", F.concat_ws("-", F.lit("full"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("piece").cast("string")).alias("sequence"), F.lit(0).cast("long").alias("position")
    )
    rest = cut.filter(F.col("n_words") < capacity)
    groups = max(1, round(docs.count() / group))
    # a number is asked for, so that small shuffles are not coalesced to few tasks of many groups
    tasks = min(groups, partitions(docs.sparkSession, 4))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_words", "doc_id", "piece"], ascending=[False, True, True], na_position="last", kind="stable", ignore_index=True)
        bins, offsets = pack_group(pdf["n_words"].to_numpy(np.int64), capacity, nodes)
        name = str(pdf["grp"].iloc[0])
        return pd.DataFrame({"doc_id": pdf["doc_id"], "piece": pdf["piece"], "n_words": pdf["n_words"], "sequence": [f"{name}-{b}" for b in bins], "position": offsets})

    grouped = rest.withColumn("grp", F.pmod(F.xxhash64("doc_id", "n_words"), F.lit(groups)))
    packed = grouped.repartition(tasks, "grp").groupBy("grp").applyInPandas(run, "doc_id long, piece long, n_words long, sequence string, position long")
    return full.unionByName(packed)
