"""Operators without SQL against brute force, and the edge cases of sources, folds and pools."""

import random
import re
import struct
import threading
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxmill.catalog.files import event_record, workbook
from voxmill.functions import resources, scores, text
from voxmill.operators import aggregates, vectors, windows
from voxmill.sources import binary, readers, writers

# -- text


def test_emphasis_matches_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(300):
        words = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 4))) for _ in range(3)]
        line = "".join(rng.choice("abc ") for _ in range(rng.randrange(0, 25)))
        taken = [False] * len(line)
        starts, ends = {}, {}
        for word in sorted(set(words), key=lambda w: (-len(w), w)):
            for m in re.finditer(re.escape(word), line):
                if len(starts) < 2 and not any(taken[m.start() : m.end()]):
                    taken[m.start() : m.end()] = [True] * len(word)
                    starts[m.start()] = ends[m.end()] = True
        want = "".join(("</strong>" if i in ends else "") + ("<strong>" if i in starts else "") + c for i, c in enumerate(line + "\0"))[:-1]
        assert text.emphasize_text(line, words) == want
        rows.append((line, words[0]))
    df = spark.createDataFrame([("x ab y",), ("has <strong>ab</strong>",), (None,)], "v string")
    assert [r[0] for r in df.select(text.emphasize("v", ["ab"])).collect()] == ["x <strong>ab</strong> y", "has <strong>ab</strong>", None]


def _read_back(words):
    """The number that English words say."""
    units = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
    tens = {w: 10 * i for i, w in enumerate("_ _ twenty thirty forty fifty sixty seventy eighty ninety".split())}
    total = part = 0
    for w in re.findall("[a-z]+", words):
        if w in units:
            part += units[w]
        elif w in tens:
            part += tens[w]
        elif w == "hundred":
            part *= 100
        elif w != "and":
            total, part = total + part * {"thousand": 10**3, "million": 10**6, "billion": 10**9, "trillion": 10**12}[w], 0
    return total + part


def test_numbers_in_words_read_back():
    rng = random.Random(2)
    for n in [*range(2100), *(rng.randrange(10 ** rng.randrange(1, 16)) for _ in range(3000))]:
        assert _read_back(text.digits_in_words(f"00{n}")) == n
    long = "".join(rng.choice("123456789") for _ in range(9000))
    names = "zero one two three four five six seven eight nine".split()
    assert text.digits_in_words(long).split() == [names[int(d)] for d in long]


def test_sentences_match_brute_force():
    rng = random.Random(3)
    for _ in range(500):
        line = "".join(rng.choice("ab1 2，,.。！?:：\n”)") for _ in range(rng.randrange(0, 25)))
        cuts, fresh = [0], True
        for i, c in enumerate(line):
            if fresh and len(cuts) > 1 and c in "\"”’』」）)】]":
                cuts[-1] = i + 1
                continue
            fresh = c in "，,。！？!?；;：:\n" and not (c in "，,.:：" and i and line[i - 1].isdigit() and line[i + 1 : i + 2].isdigit())
            if fresh:
                cuts.append(i + 1)
        want = [p for a, b in zip(cuts, [*cuts[1:], len(line)]) if (p := line[a:b].strip())]
        assert text.sentence_pieces(line) == want


def test_paragraphs_match_brute_force():
    rng = random.Random(4)
    for _ in range(400):
        line = "".join(rng.choice("字句") if rng.random() < 0.8 else rng.choice("。？！") for _ in range(rng.randrange(1, 120)))
        most, least, merge = rng.randrange(8, 30), rng.randrange(3, 12), rng.randrange(0, 6)
        whole = line if line[-1] in "。？！" else line + "。"
        # a mark with nothing before it is no sentence
        sentences = re.findall("[字句]+[。？！]", whole)
        want, held = [], ""
        for s in sentences:
            if len(held + s) > most and len(held) > least:
                want, held = [*want, held], ""
            held += s
        if held and want and len(held) < merge:
            want[-1] += held
        elif held:
            want.append(held)
        assert text.paragraph_pieces(line, "zh", most, least, merge) == want


def test_word_errors_match_the_fold():
    """The table and the row-by-row fold choose the same alignment."""
    rng = random.Random(8)
    for _ in range(500):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(0, 14))] for _ in range(2))
        got = text.word_errors(a, b)
        assert got == text._folded_errors(a, b)
        assert got[0] + got[2] + got[3] == len(a) and got[0] + got[1] + got[3] == len(b)


# -- hops and losses


def _hops(n, hop, lookahead, rate):
    """A stream of n tokens, token by token."""
    ends, at, step, chunk = [], 0, hop, 0
    for have in range(1, n + 1):
        while have - at >= step + lookahead:
            at += step
            ends.append(at)
            if rate is not None:
                step = rate * 2**chunk
            chunk += 1
    return [*ends, n] if n else []


def test_chunk_ends_match_a_stream(spark):
    rows = spark.range(0, 700).withColumnRenamed("id", "n")
    for hop, lookahead, rate in ((25, 3, 25), (10, 3, 7), (15, 3, None), (1, 1, 1)):
        got = {r.n: r.e for r in rows.select("n", scores.chunk_ends("n", hop, lookahead, rate).alias("e")).collect()}
        assert got == {n: _hops(n, hop, lookahead, rate) for n in range(700)}


def test_time_based_ends():
    """Slow chunks keep the hop; a stream far ahead of playback takes all that waits."""
    slow = scores.time_based_ends([i / 25 for i in range(200)], 25, 3, 25, 2.0)
    assert slow[:-1] == list(range(25, 25 * len(slow[:-1]) + 1, 25)) and slow[-1] == 200
    # with a long lookahead two hops wait behind each chunk, and the stream takes one more than these
    fast = scores.time_based_ends([0.0] * 500, 25, 60, 25, 0.1)
    assert fast[:2] == [25, 50] and fast[-1] == 500 and set(np.diff(fast[1:-1]).tolist()) == {75}
    assert scores.time_based_ends([], 25, 3, 25, 1.0) == []


def test_divergence_of_odd_scores(spark):
    rows = [([1.0, 2.0, 3.0], [1.0, 2.0, 3.0]), ([float("nan"), 1.0], [1.0, 2.0]), ([0.0, 5.0], [5.0, 0.0])]
    df = spark.createDataFrame(rows, "s array<double>, t array<double>")
    same, bad, apart = [r[0] for r in df.select(scores.top_k_divergence("s", "t", 2)).collect()]
    assert same == pytest.approx(0) and bad == 0 and apart > 4


# -- pools


def test_retries_wait_and_give_up():
    waits, calls = [], []

    def call(row):
        calls.append(row)
        raise resources.RateLimited(5.0) if len(calls) == 1 else TimeoutError("late")

    assert resources.call_with_retries(call, {}, 3, 1.0, 3.5, waits.append) == (None, 4, "TimeoutError: late")
    assert waits == [3.5, 2.0, 3.5]
    assert resources.call_with_retries(lambda row: 1 / 0, {}, 3, 1.0, 9.0, waits.append)[1:] == (1, "ZeroDivisionError: division by zero")


def test_pool_is_bounded(spark):
    def build():
        lock, now, most = threading.Lock(), [0], [0]

        def call(row):
            with lock:
                now[0] += 1
                most[0] = max(most[0], now[0])
            time.sleep(0.005)
            with lock:
                now[0] -= 1
            return most[0]

        return call

    out = resources.pooled(spark.range(60).coalesce(1), build, T.LongType(), 3).collect()
    assert len(out) == 60 and max(r.answer for r in out) == 3 and {r.attempts for r in out} == {1}
    assert resources.pooled(spark.range(0), build, T.LongType()).count() == 0


# -- folds and percentiles


def test_batches_fold_over_any_number_of_arrow_batches(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 2, None]), i, rng.choice([None, rng.randrange(0, 2500)])) for i in range(400)]
    df = spark.createDataFrame(rows, "s long, i long, n long").repartition(7)
    want = {}
    for s in (1, 2, None):
        batch = longest = held = 0
        for _, i, n in [r for r in rows if r[0] == s]:
            if held and max(longest, (n or 0) * 4) * (held + 1) > 24_000:
                batch, longest, held = batch + 1, 0, 0
            longest, held = max(longest, (n or 0) * 4), held + 1
            want[i] = batch
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert {r.i: r.batch for r in windows.padded_batches(df, "s", ["i"], "n", 24_000).collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_percentiles_of_groups_with_nulls(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, rng.random()]), None) for _ in range(200)] + [("c", None, None)]
    df = spark.createDataFrame(rows, "g string, v double, w double")
    stats = df.groupBy("g").agg(F.count("*").alias("n"))
    got = {r.g: (r.n, r.v_p50, r.v_p95, r.w_p50) for r in aggregates.with_percentiles(stats, df, {"v": F.col("v"), "w": F.col("w")}, (0.5, 0.95), ["g"]).collect()}
    for g in ("a", "b", None, "c"):
        own = [v for k, v, _ in rows if k == g and v is not None]
        n = sum(k == g for k, _, _ in rows)
        want = (n, *(float(np.quantile(own, p)) if own else None for p in (0.5, 0.95)), None)
        assert got[g] == pytest.approx(want)


def test_majority_goes_to_the_first_on_ties(spark):
    rows = [("g", "b", 3), ("g", "a", 1), ("g", "b", 2), ("g", "a", 4), ("g", None, 0), ("h", None, 1)]
    df = spark.createDataFrame(rows, "g string, v string, i int")
    got = {r.g: tuple(r)[1:] for r in aggregates.majority(df, "g", "v", [F.col("i")]).collect()}
    assert got == {"g": (2, "a", 2, 0.4), "h": (0, "", 0, 0.0)}


def test_clusters_of_nothing(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [2.0, 5.0])], "k long, v array<double>")
    assert {r.k for r in vectors.cluster_distances(df, "k", "v", 2, 2).collect()} == {1, 3}
    assert vectors.cluster_distances(df.filter("v is null"), "k", "v", 2, 2).count() == 0
    assert vectors.cluster_distances(df.limit(0), "k", "v", 2, 2).count() == 0
    assert {(r.k, r.pos, r.value) for r in aggregates.mean_vector(df.withColumn("k", F.lit(1)), "k", "v").collect()} == {(1, 0, 1.5), (1, 1, 3.5)}


# -- files


def test_lines_of_a_split_file_are_numbered(spark, tmp_path):
    values = [f"line {i} " + "x" * (i % 50) for i in range(3000)]
    values[7] = values[2999] = ""
    (tmp_path / "a b.txt").write_text("\r\n".join(values) + "\r\n")
    (tmp_path / "c.txt").write_text("one\n\ntwo")
    (tmp_path / "empty.txt").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        got = readers.lines(spark, str(tmp_path))
        assert got.select("file").distinct().count() == 2 and readers.plain_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 3
        rows = {(r.file.rsplit("/", 1)[1], r.line_no): r.value for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert rows == {("a%20b.txt", i + 1): v for i, v in enumerate(values)} | {("c.txt", 1): "one", ("c.txt", 2): "", ("c.txt", 3): "two"}


def test_json_dicts_of_one_name(spark, tmp_path):
    for folder, body in (("a", '{"k": "1", "x": "a"}'), ("b c", '{"k": "2"}')):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "utt2wav.json").write_text(body)
    paths = [str(tmp_path / f / "utt2wav.json") for f in ("a", "b c")]
    assert {r.key: r.value for r in readers.json_dicts(spark, paths).collect()} == {"k": "2", "x": "a"}
    assert {r.key: r.value for r in readers.json_dicts(spark, paths[::-1]).collect()} == {"k": "1", "x": "a"}
    assert {r.key: r.value for r in readers.json_dicts(spark, [*paths, paths[0]]).collect()} == {"k": "1", "x": "a"}


def test_transcripts_of_odd_lines(spark, tmp_path):
    (tmp_path / "TRANS.txt").write_text("wav\tspk\tcontent\nu1.wav\ts\t a [FIL]b \nu2.wav\ts\n\nu1.wav\tt\t[SPK]\n")
    got = {tuple(r) for r in readers.transcripts(readers.lines(spark, str(tmp_path)), "/r").collect()}
    assert got == {("u1", "/r/t/u1.wav", "t", "")}


def test_scalars_and_cells_of_odd_files(spark, tmp_path):
    tensor = b"\x42\x0c" + b"\x08\x01\x22\x04" + struct.pack("<f", 2.5) + b"\x12\x02\x08\x01"
    entry = b"\x0a\x01t" + tensor
    data = b"\x10\x05\x2a" + bytes([len(entry) + 2]) + b"\x0a" + bytes([len(entry)]) + entry
    raw = event_record(1.0, 300, "loss", 0.5) + struct.pack("<Q", len(data)) + b"\0\0\0\0" + data + b"\0\0\0\0"
    assert list(binary.event_scalars(raw)) == [("loss", 300, 1.0, 0.5), ("t", 5, 0.0, 2.5)]
    assert list(binary.event_scalars(raw[:-9])) == [("loss", 300, 1.0, 0.5)] and list(binary.event_scalars(b"")) == []
    assert list(binary.workbook_rows(workbook([["a", "b"], ["c", "a"]]))) == [("regions", 1, ["a", "b"]), ("regions", 2, ["c", "a"])]


def test_rewriting_keeps_the_table_before(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (3, 2, 1):
        writers.rewrite(spark.range(n), path)
    assert spark.read.parquet(path).count() == 1 and spark.read.parquet(f"{path}.bak").count() == 2
    writers.rewrite(spark.range(7), path, keep_backup=False)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t"] and spark.read.parquet(path).count() == 7


def test_every_reader_has_shards(spark):
    """All shards are read, and no reader is empty, however many there are."""
    for n in (1, 3, 10):
        shards = spark.range(n)
        for world, workers in ((2, 2), (7, 2)):
            parts = [[r.id for r in readers.assign_shards(shards, F.col("id"), rank, world, worker, workers, epoch=3).collect()] for rank in range(world) for worker in range(workers)]
            assert all(parts) and set(sum(parts, [])) == set(range(n))
            if n >= world * workers:
                assert Counter(sum(parts, [])) == Counter(range(n))
