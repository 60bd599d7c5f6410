"""Numeric functions: clipping, grading, weighting, losses, vectors and arrays."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def number(c: Column | str) -> Column:
    """A finite double, or null where the value is no number, NaN or infinite."""
    v = col(c).try_cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def scaled_round(c: Column | str, places: int) -> Column:
    """A double rounded as DuckDB does: its multiple by 10^places to the nearest whole, halves away from zero.

    Spark's ``round`` goes by the decimals of the double instead, which differs where the multiple is not exact.
    """
    scaled = col(c) * F.lit(10.0**places)
    return F.when(F.abs(scaled) == float("inf"), col(c)).otherwise(F.round(scaled, 0) / F.lit(10.0**places))


def clip(c: Column | str, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(c)))


def min_max(c: Column | str, low: float, high: float) -> Column:
    """Scaled to 0..1 between ``low`` and ``high`` and clipped there."""
    return clip((col(c) - F.lit(low)) / F.lit(high - low), 0.0, 1.0)


def quality_score(mos: Column, snr: Column, similarity: Column) -> Column:
    """0.45 MOS (1..5), 0.25 SNR (10..50 dB), 0.30 speaker similarity (0..1)."""
    return F.lit(0.45) * min_max(mos, 1.0, 5.0) + F.lit(0.25) * min_max(snr, 10.0, 50.0) + F.lit(0.30) * clip(similarity, 0.0, 1.0)


GRADES: tuple[tuple[float, str], ...] = ((0.90, "A+"), (0.80, "A"), (0.70, "B"), (0.60, "C"))


def grade(score: Column | str, grades: Sequence[tuple[float, str]] = GRADES, last: str = "D", unknown: str = "UNKNOWN") -> Column:
    """The first grade whose threshold the score reaches."""
    out = F.when(col(score).isNull(), unknown)
    for least, name in grades:
        out = out.when(col(score) >= least, name)
    return out.otherwise(last)


def edge_bucket(c: Column | str, edges: Sequence[float]) -> Column:
    """``[a, b)`` between edges; what lies below the first or from the last edge on is ``[y, z]``."""
    x, outside = col(c), f"[{edges[-2]:.1f}, {edges[-1]:.1f}]"
    out = F.when(x.isNull(), None)
    for a, b in zip(edges, edges[1:]):
        out = out.when((x >= a) & (x < b), f"[{a:.1f}, {b:.1f})")
    return out.otherwise(outside)


def equal_bin(c: Column | str, low: float, high: float, bins: int) -> Column:
    """1..bins, values outside in the edge bins."""
    return F.least(F.lit(bins), F.greatest(F.lit(1), (F.floor((col(c) - low) / F.lit((high - low) / bins)) + 1).cast("int")))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where either is null or b is 0."""
    return F.try_divide(a, b)


def dummy_length(c: Column | str, per: float, low: int, high: int) -> Column:
    """ceil(length * per), at least ``low`` and at most ``high``."""
    return F.least(F.lit(high), F.greatest(F.lit(low), F.ceil(F.length(col(c)) * F.lit(per)).cast("int")))


def tanh_reward(wer: Column | str) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.tanh(F.lit(3.0) * col(wer)))


def log_sigmoid(x: Column) -> Column:
    """-log(1 + exp(-x)) without overflow."""
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def preference_loss(chosen: Column, rejected: Column, ref_chosen: Column, ref_rejected: Column, beta: float, smoothing: float = 0.0) -> Column:
    """DPO loss of a row from the four log-probabilities."""
    logits = (chosen - rejected) - (ref_chosen - ref_rejected)
    return -log_sigmoid(F.lit(beta) * logits) * (1 - smoothing) - log_sigmoid(F.lit(-beta) * logits) * smoothing


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(col(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column | str) -> Column:
    """Unit vector in doubles; a zero vector gives nulls."""
    n = norm(v)
    return F.transform(col(v), lambda x: F.try_divide(x.cast("double"), n))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def top_positions(v: Column | str, k: int) -> Column:
    """Zero-based positions of the k largest, ties by position."""
    ranked = F.array_sort(F.transform(col(v), lambda x, i: F.struct((-x).alias("x"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, k), lambda s: s["i"])


def top_k_overlap(a: Column | str, b: Column | str, k: int) -> Column:
    return F.size(F.array_intersect(top_positions(a, k), top_positions(b, k))) / F.lit(float(k))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, where it is used more than once inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def log_sum_exp(x: Column) -> Column:
    return let(F.array_max(x), lambda m: m + F.log(F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v - m))))


def top_k_divergence(student: Column | str, teacher: Column | str, k: int, forward: bool = False, temperature: float = 1.0) -> Column:
    """Distillation loss of a position: KL divergence over the k largest scores, times the squared temperature.

    The reverse kind takes the student's largest and weighs by the student, the forward kind the teacher's.
    Shares are normalised over these k. What is no number counts as 0.
    """
    own, other = (teacher, student) if forward else (student, teacher)

    def at(support: Column, scored: Column | str) -> Column:
        return F.transform(support, lambda i: F.get(col(scored), i).cast("double") / temperature)

    both = let(top_positions(own, k), lambda support: F.struct(at(support, own).alias("p"), at(support, other).alias("q")))
    summed = let(both, lambda x: F.struct(x["p"].alias("p"), x["q"].alias("q"), log_sum_exp(x["p"]).alias("a"), log_sum_exp(x["q"]).alias("b")))
    terms = let(summed, lambda z: F.aggregate(F.zip_with(z["p"], z["q"], lambda x, y: F.exp(x - z["a"]) * (x - z["a"] - y + z["b"])), F.lit(0.0), lambda s, v: s + v))
    return let(terms, lambda loss: F.when(F.isnan(loss) | (F.abs(loss) == float("inf")), 0.0).otherwise(loss) * temperature**2)


def chunk_ends(n: Column | str, hop: int, lookahead: int, rate: int | None = None, most: int = 48) -> Column:
    """STR-06: where the chunks of a stream of n tokens end, which goes out when hop and lookahead are there.

    Without ``rate`` every hop is ``hop``; with it the hops after the first are rate, 2 rate, 4 rate, ... The last chunk
    has what is left. No token, no chunk.
    """
    size = col(n).cast("long")
    if rate is None:
        full = F.greatest(F.floor((size - lookahead) / hop), F.lit(0))
        ends = F.when(full > 0, F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(full, F.lit(1))), lambda i: i * hop)).otherwise(F.array().cast("array<bigint>"))
    else:
        ends = F.filter(F.array(*[F.lit(hop + rate * (2**i - 1)).cast("long") for i in range(most)]), lambda e: e + lookahead <= size)
    return F.when(size <= 0, F.array().cast("array<bigint>")).otherwise(F.array_distinct(F.concat(ends, F.array(size))))


def time_based_ends(arrivals: Sequence[float], hop: int, lookahead: int, rate: int, cost: float) -> list[int]:
    """STR-06 by the clock: chunk ends where each chunk takes ``cost`` seconds and token i is there at ``arrivals[i]``.

    A stream that is ahead of playback by over two chunk times takes all whole hops that wait, by over four one more.
    """
    ends, at, now, step = [], 0, 0.0, hop
    for i, arrived in enumerate(arrivals, 1):
        now = max(now, arrived)
        while i - at >= step + lookahead:
            now += cost
            at += step
            ends.append(at)
            step = hop
            if len(ends) > 1 and now > 0:
                ahead = (at / rate - now) / (now / len(ends))
                waiting = (i - at) // hop
                step = hop * max(1, waiting + 1 if ahead > 4 else waiting if ahead > 2 else 1)
    return [*ends, len(arrivals)] if arrivals else []


def pad(a: Column | str, size: Column, value=0) -> Column:
    return F.concat(col(a), F.array_repeat(F.lit(value), F.greatest(size - F.size(col(a)), F.lit(0))))


def fit(a: Column | str, size: int, start: Column | int = 1, value=0) -> Column:
    """``size`` items from ``start`` on, padded behind."""
    part = F.slice(col(a), F.lit(start) if isinstance(start, int) else start, F.lit(size))
    return pad(part, F.lit(size), value)


def has_prefix(a: Column | str, prefix: Sequence) -> Column:
    return F.slice(col(a), 1, len(prefix)) == F.array(*[F.lit(x) for x in prefix])


def prepend_once(a: Column | str, prefix: Sequence) -> Column:
    return F.when(has_prefix(a, prefix), col(a)).otherwise(F.concat(F.array(*[F.lit(x) for x in prefix]), col(a)))


def pad_mask(length: Column, most: Column) -> Column:
    """True where a padded sequence has no item."""
    return F.when(most <= 0, F.array().cast("array<boolean>")).otherwise(F.transform(F.sequence(F.lit(0), most - 1), lambda i: i >= length))


def interleave(text: Column | str, speech: Column | str, text_n: int, speech_n: int) -> Column:
    """Blocks of ``text_n`` text and ``speech_n`` speech tokens; the last block has all speech left.

    Applies only where speech is more than speech_n / text_n times the text; else text
    is followed by speech.
    """
    t, s = col(text), col(speech)
    blocks = F.ceil(F.size(t) / F.lit(text_n)).cast("int")
    part = F.transform(
        F.sequence(F.lit(0), F.greatest(blocks - 1, F.lit(0))),
        lambda i: F.concat(
            F.slice(t, i * text_n + 1, F.lit(text_n)),
            F.when(i == blocks - 1, F.slice(s, i * speech_n + 1, F.greatest(F.size(s), F.lit(1)))).otherwise(F.slice(s, i * speech_n + 1, F.lit(speech_n))),
        ),
    )
    long_enough = (F.size(s) * text_n > F.size(t) * speech_n) & (F.size(t) > 0)
    return F.when(long_enough, F.flatten(part)).otherwise(F.concat(t, s))


def chunk_array(a: Column | str, size: int, first: int | None = None) -> Column:
    """Array of arrays: the first of ``first`` items, then ``size`` each."""
    first = first or size
    n = F.size(col(a))
    rest = F.when(n > first, F.transform(F.sequence(F.lit(first + 1), F.greatest(n, F.lit(first + 1)), F.lit(size)), lambda i: F.slice(col(a), i, F.lit(size))))
    return F.when(n <= 0, F.array().cast("array<array<int>>")).otherwise(F.concat(F.array(F.slice(col(a), 1, first)), F.coalesce(rest, F.array().cast("array<array<int>>"))))
