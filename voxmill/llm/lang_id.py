"""Language identification as multilingual mixture inference.

Each language has a model of hashed byte 4-grams of its lower-cased words, trained on a
bounded sample of labelled documents: ``TRAIN_ROWS`` distinct ones a language, thinned by hash
of doc_id and text and then taken by hash of doc_id, of the ``TRAIN_LABELS`` most frequent languages. A further component,
``noise``, gives every 4-gram the same likelihood. A document is a mixture: each of its
words is drawn from one component, and expectation-maximisation over all its words
estimates the proportions. It goes on until no mixture of the same components can be
likelier by more than ``TOLERANCE`` nats (and a millionth of a nat a word), which a bound on the likelihood tells, or for
``MOST_ROUNDS`` rounds. The language set is the one
of best penalised likelihood (BIC) among the sets of the k most present components,
k = 1, 2, ...; the proportions are then those of the mixture over that set alone. Sets
are left out only where a bound on the likelihood of any mixture shows that they lose.

Defined cases: a document is rejected where it has no word (null and empty texts
included) or where noise makes up more than ``MAX_NOISE`` of the chosen mixture; all
others are accepted. Rows are judged one by one, so repeated rows repeat their result.
Ties go to the component first in name. A null doc_id is passed on. Labels that are
null don't train, nor do null texts; rows that repeat a doc_id and text train once, whatever
ids they share; without any label every document with a word is accepted as ``und``.
Other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec
from .runtime import ranges

TRAIN_ROWS = 400
TRAIN_LABELS = 200
GRAM = 4
SLOTS = 1 << 16
SMOOTHING = 0.05
MAX_NOISE = 0.9
TOLERANCE = 0.01
MOST_ROUNDS = 1000
NOISE = "noise"
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)


def gram_slots(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot of the 4-gram that ends at each byte of each word and its closing mark; where words and texts begin.

    A word takes one gram more than it has bytes: it is padded with zeros in front and
    one behind.
    """
    data, off = textvec.byte_view(pc.utf8_lower(texts))
    begin, end = textvec.spans(data, off)
    first = np.searchsorted(begin, off)
    lengths = end - begin
    size = int(lengths.sum()) + len(begin) * GRAM
    at = np.cumsum(lengths + GRAM) - (lengths + GRAM)
    padded = np.zeros(size + GRAM, np.uint32)
    inside = np.repeat(at + GRAM - 1 - begin, lengths) + ranges(begin, lengths)
    padded[inside] = data[ranges(begin, lengths)]
    h = padded[: size] * _MULTIPLIERS[0]
    for k in range(1, GRAM):
        h = h + padded[k : size + k] * _MULTIPLIERS[k]
    h ^= h >> np.uint32(15)
    h = h * np.uint32(0x2C1B3C6D)
    slots = (h >> np.uint32(16)).astype(np.int32)
    keep = np.ones(size, bool)
    tails = (at[:, None] + lengths[:, None] + np.arange(1, GRAM)[None, :]).ravel()
    keep[tails] = False
    return slots[keep], np.cumsum(lengths + 1) - (lengths + 1), first


class Model:
    """Log-likelihoods of 4-grams by component; the last component is noise."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = [*names, NOISE]
        total = counts.sum(axis=1, keepdims=True)
        known = np.log((counts + SMOOTHING) / (total + SMOOTHING * SLOTS))
        noise = np.full((1, SLOTS), -np.log(SLOTS))
        self.logs = np.ascontiguousarray(np.concatenate([known, noise]).T.astype(np.float32))


def train(sample: list[tuple[str, str]]) -> Model:
    """A model from (label, text) pairs."""
    names = sorted({label for label, _ in sample})
    counts = np.zeros((len(names), SLOTS))
    for k, name in enumerate(names):
        for _, part in textvec.chunks(pa.array([text for label, text in sample if label == name], pa.string())):
            counts[k] += np.bincount(gram_slots(part)[0], minlength=SLOTS)
    return Model(names, counts)


def training_sample(docs: DataFrame, rows: int = TRAIN_ROWS, labels: int = TRAIN_LABELS) -> list[tuple[str, str]]:
    """At most ``rows`` distinct labelled documents a language.

    A first filter on the hash of doc_id and text leaves about three times as many, whatever
    ids the rows share, so that the window that makes the bound exact, by the hash of
    doc_id, sorts a bounded number of texts at any size of table. Of
    more than ``labels`` languages, the most frequent ones train.
    """
    named = docs.select(F.col("lang").cast("string").alias("label"), F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).filter("label is not null and text is not null")
    hashed = named.withColumn("hash", F.xxhash64("doc", "text", F.lit(17)))
    sizes = hashed.groupBy("label").agg(F.count("*").alias("n"), F.approx_count_distinct("hash", 0.02).alias("d")).orderBy(F.desc("n"), "label").limit(labels).collect()
    if not sizes:
        return []
    scale = 1 << 30
    limit = F.create_map(*[x for r in sizes for x in (F.lit(r["label"]), F.lit(scale if r["d"] <= 3 * rows else scale * 3 * rows // r["d"]))])
    thin = hashed.filter(F.pmod("hash", F.lit(scale)) < limit[F.col("label")])
    distinct = thin.groupBy("label", "hash").agg(F.min("doc").alias("doc"), F.min("text").alias("text"))
    order = F.pmod(F.xxhash64("doc", F.lit(17)), F.lit(scale))
    ranked = distinct.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy(order, F.xxhash64("text"))))
    return sorted((r["label"], r["text"]) for r in ranked.filter(F.col("place") <= rows).select("label", "text").collect())


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of rows by segment; an empty segment has zero."""
    n = len(first) - 1
    out = np.zeros((n, values.shape[1]), np.float64)
    some = np.flatnonzero(first[1:] > first[:-1])
    if len(some):
        out[some] = np.add.reduceat(values, first[some], axis=0)
    return out


def _mix(odds: np.ndarray, base: np.ndarray, first: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions by document over its allowed components, and the log-likelihoods.

    By Jensen's inequality a document of n words gains at most n log(largest factor by
    which the next round raises a proportion); documents that gain little are done.
    """
    words = np.diff(first)
    share = allowed / np.maximum(allowed.sum(axis=1, keepdims=True), 1)
    active = np.flatnonzero((allowed.sum(axis=1) > 1) & (words > 0))
    part, cuts, counts = odds, first, words
    if len(active) < len(words):
        part, cuts, counts = _rows(odds, first, active)
    live = np.ones(len(active), bool)
    for _ in range(MOST_ROUNDS):
        if not live.any():
            break
        old = share[active]
        joint = part * np.repeat(old.astype(np.float32), counts, axis=0)
        joint /= np.maximum(joint.sum(axis=1, keepdims=True), 1e-30)
        new = _sums(joint, cuts) / counts[:, None]
        # a document stops by itself, so its shares do not hang on its neighbours
        share[active[live]] = new[live]
        gain = counts * np.log((new / np.where(old > 1e-30, old, np.inf)).max(axis=1))
        live &= gain > TOLERANCE + 1e-6 * counts
        if counts[live].sum() < 0.8 * len(part):
            part, cuts, counts = _rows(part, cuts, np.flatnonzero(live))
            active, live = active[live], np.ones(int(live.sum()), bool)
    joint = (odds * np.repeat(share.astype(np.float32), words, axis=0)).sum(axis=1)
    fit = _sums((np.log(np.maximum(joint, 1e-30)) + base)[:, None], first)[:, 0]
    return share, fit


def _rows(odds: np.ndarray, first: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of some documents, where they begin, and how many each has."""
    words = np.diff(first)[some]
    return odds[ranges(first[:-1][some], words)], np.concatenate(([0], np.cumsum(words))), words


def _most(odds: np.ndarray, first: np.ndarray, share: np.ndarray, fit: np.ndarray) -> np.ndarray:
    """What the log-likelihood of no mixture of a document exceeds, given one of them.

    By Jensen's inequality another mixture gains at most n log(max over components of
    the mean of their odds to the given one); something is added for rounding.
    """
    words = np.diff(first)
    joint = (odds * np.repeat(share.astype(np.float32), words, axis=0)).sum(axis=1, keepdims=True)
    gain = (_sums(odds / np.maximum(joint, 1e-30), first) / np.maximum(words, 1)[:, None]).max(axis=1)
    return fit + words * np.log(np.maximum(gain, 1)) + 0.01 + 1e-6 * words


def word_logs(model: Model, slots: np.ndarray, begin: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """Log-likelihood of each word by component; a block of words at a time, for long texts."""
    out = np.empty((len(begin), model.logs.shape[1]), np.float32)
    for s in range(0, len(begin), block):
        e = min(s + block, len(begin))
        low, high = begin[s], begin[e] if e < len(begin) else len(slots)
        out[s:e] = np.add.reduceat(model.logs[slots[low:high]], begin[s:e] - low, axis=0)
    return out


def infer(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n, K) proportions over the chosen sets, and the number of words."""
    k = len(model.names)
    shares, counts = np.zeros((len(texts), k)), np.zeros(len(texts), np.int64)
    for at, part in textvec.chunks(texts):
        slots, begin, first = gram_slots(part)
        n = len(part)
        counts[at : at + n] = np.diff(first)
        if not len(begin):
            continue
        logs = word_logs(model, slots, begin)
        base = logs.max(axis=1)
        odds = np.exp(logs - base[:, None])
        base = base.astype(np.float64)
        share, fit = _mix(odds, base, first, np.ones((n, k)))
        order = np.argsort(-share, axis=1, kind="stable")
        places = np.empty_like(order)
        np.put_along_axis(places, order, np.arange(k)[None, :].repeat(n, axis=0), axis=1)
        price = 0.5 * np.log(np.maximum(counts[at : at + n], 2))
        best_fit = np.full(n, -np.inf)
        best = np.zeros((n, k))
        most = _most(odds, first, share, fit)
        for size in range(1, k + 1):
            some = np.flatnonzero(most - price * (2 * size - 1) > best_fit)
            if not len(some):
                break
            words = np.diff(first)[some]
            rows = ranges(first[:-1][some], words)
            local = np.concatenate(([0], np.cumsum(words)))
            tried, got = _mix(odds[rows], base[rows], local, (places[some] < size).astype(np.float64))
            got = got - price[some] * (2 * size - 1)
            better = got > best_fit[some]
            best_fit[some[better]] = got[better]
            best[some[better]] = tried[better]
        shares[at : at + n] = best
    return shares, counts


def _accept(model: Model, shares: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (words > 0) & ((shares[:, -1] <= MAX_NOISE) | (len(model.names) == 1))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang, share, langs, shares, words, accepted) for every row of ``docs``.

    ``lang`` is the most present language (``und`` for a rejected document), ``langs``
    and ``shares`` the chosen set by falling proportion.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares, words = infer(model, batch.column(1))
            good = _accept(model, shares, words)
            langs, parts, top, top_share = [], [], [], []
            for i, row in enumerate(shares):
                order = [j for j in np.argsort(-row, kind="stable") if row[j] > 0]
                langs.append([model.names[j] for j in order])
                parts.append([round(float(row[j]), 6) for j in order])
                known = [j for j in order if j != len(model.names) - 1]
                top.append(model.names[known[0]] if good[i] and known else "und")
                top_share.append(round(float(row[known[0]]), 6) if known else 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(top, pa.string()), pa.array(top_share, pa.float64()), pa.array(langs, pa.list_(pa.string())), pa.array(parts, pa.list_(pa.float64())), pa.array(words, pa.int64()), pa.array(good)],
                names=["doc_id", "lang", "share", "langs", "shares", "words", "accepted"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang string, share double, langs array<string>, shares array<double>, words long, accepted boolean")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The accepted rows of ``docs``, all columns kept."""
    text_at = [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares, words = infer(model, batch.column(text_at))
            yield batch.filter(pa.array(_accept(model, shares, words)))

    return docs.mapInArrow(run, docs.schema)
