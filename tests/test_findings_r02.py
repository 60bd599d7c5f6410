"""What the review of round 2 found."""

import datetime as dt

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from voxmill.catalog import QUERIES, SQL
from voxmill.functions import batches, scores


def test_scalar_series_of_fractional_seconds_and_ties(spark, tmp_path):
    """seconds are rounded before they are cut into hours, and the slope's tie goes as in SQL."""
    day, hours = dt.datetime(2024, 1, 1), lambda h, s=0.0: dt.timedelta(hours=h, seconds=s)
    rows = [
        (1, day + hours(0, 3599.7), 1, "view", 3.0), (2, day + hours(2, 3599.5), 1, "view", 4.0), (3, day + hours(4, 3598.5), 1, "view", 9.0),
        (4, day, 2, "click", 4.99), (5, day + hours(640), 2, "click", 13.0),
        (6, dt.datetime(1969, 12, 31, 22, 59, 59, 600_000), 3, "view", 1.0), (7, dt.datetime(1970, 1, 1), 3, "view", 2.0),
        (8, day, 4, "view", 1e308), (9, day + hours(1), 4, "view", 1e308),
    ]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["agg_19_scalar_series"](spark, str(tmp_path))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = duck.sql(f"SELECT {', '.join(got.columns)} FROM ({SQL['agg_19_scalar_series']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_scaled_round_goes_as_in_duckdb(spark):
    values = [8.01 / 640, -8.01 / 640, 0.5, -0.5, 1.005, 2.675, 1e308, float("inf"), 0.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(scores.scaled_round(F.col("v"), 8)).collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 8)", [v]).fetchone()[0] for v in values]


# -- F2


def test_a_batch_is_mapped_slice_by_slice():
    """The first results leave while most of a batch of 20 MB is not yet looked at; nulls and long rows included."""
    texts = ["x" * 2000, None] * 10_000 + ["y" * 1_000_000] * 2 + ["z"]
    seen = []
    out = batches.mapped(lambda t: seen.append(t) or [t], pa.list_(pa.string()), iter([(pa.array(texts),)]))
    first = next(out)
    assert sum(map(len, seen)) <= batches.SLICE_BYTES
    rest = list(out)
    assert [x and x[0] for a in [first, *rest] for x in a.to_pylist()] == texts
    assert max(a.nbytes for a in rest) < 1_100_000
    assert sum(map(len, batches.mapped(len, pa.int64(), iter([(pa.array([], pa.string()),)])))) == 0


def test_paragraphs_of_long_and_missing_texts(spark):
    from voxmill.functions import text

    given = [None, "", "One. Two? " * 5000, "a"] * 300
    rows = spark.createDataFrame(list(enumerate(given)), "k int, t string").coalesce(1)
    got = [r[0] for r in rows.orderBy("k").select(text.split_paragraph("t", lang="en")).collect()]
    want = {t: text.paragraph_pieces(t, "en") if t is not None else None for t in set(given)}
    assert got == [want[t] for t in given]


# -- F3


def test_word_errors_of_near_copies_and_long_pairs():
    """The same alignment as the fold, and one of 36 million cells in seconds (the fold takes about a minute)."""
    import random
    import time

    from voxmill.functions import text

    rng = random.Random(3)
    for n in (1, 60, 130, 300):
        for words in (2, 20, 1000):
            a = [str(rng.randrange(words)) for _ in range(n)]
            b = [w for x in a for w in ([x] if rng.random() < 0.8 else [x, "new"] if rng.random() < 0.5 else [])]
            for x, y in ((a, b), (b, a), (a, a), (a, ["other"] * n), (a, [])):
                assert text.word_errors(x, y) == text._folded_errors(x, y)
    a, b = ([rng.randrange(300) for _ in range(6000)] for _ in range(2))
    began = time.process_time()
    s, i, d, k = text.word_errors(a, b)
    assert s + d + k == s + i + k == 6000
    assert time.process_time() - began < 10


# -- F4


def test_normalize_has_one_worker_a_task(spark):
    from voxmill.functions import text

    given = ["<|spk_1|>你好，世界 12。 再见", "I have 12 cats. No", None, "", "<|spk_2|>a <|x|> b 3", "...", "<|spk_3|>3 of 4"]
    want = [["<|spk_1|>你好，世界12。再见。"], ["I have twelve cats. No."], None, [""], ["<|spk_2|>a <|x|> b 3"], [], ["<|spk_3|>three of four."]]
    rows = spark.createDataFrame(list(enumerate(given)), "k int, t string").coalesce(1)
    out = rows.select("k", text.normalize("t").alias("p"))
    assert [r["p"] for r in out.orderBy("k").collect()] == want
    plan = rows.select("k", F.posexplode(text.normalize("t")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1


# -- F6


def test_sentences_of_long_runs_and_in_slices(spark):
    """A run of closing marks in linear time (it was quadratic), and a batch's sentences slice by slice."""
    import time

    from voxmill.functions import text

    began = time.process_time()
    assert text.sentence_pieces("甲。" + "”" * 500_000 + "1,000 乙") == ["甲。" + "”" * 500_000, "1,000 乙"]
    assert time.process_time() - began < 2
    given = [None, "", "One, two! 1,000: 3:4 (five.)" * 300, "a。」b"] * 200
    rows = spark.createDataFrame(list(enumerate(given)), "k int, t string").coalesce(1)
    out = rows.select("k", text.split_sentences("t").alias("p"))
    assert [r["p"] for r in out.orderBy("k").collect()] == [t if t is None else text.sentence_pieces(t) for t in given]


# -- F5


def test_numbers_are_read_as_by_all_rules_and_in_many_tasks(spark, sf):
    import random

    from voxmill.functions import digits

    rng = random.Random(5)
    words = ["手机尾号 ", "验证码是", "订单号", "拨打 ", "分机", "按", "您是", "号码", "后4位", "末四位", "邮编", "工号", "电话", "移动", "中国移动", "M的", "G宽带", "-", "*", " ", "10086", "95588", "400", "12345", "13812345678", "1", "300", "１２３", "123456"]
    for _ in range(3000):
        given = want = "".join(rng.choice(words) for _ in range(rng.randrange(1, 6)))
        for pattern, reading, _needs in digits.rules():
            want = pattern.sub(reading, want)
        assert digits.read_numbers(given) == want
    there = digits._needed() & set("分机 12")
    assert len(digits._candidates(there)) < len(digits.rules()) / 4
    out = QUERIES["strf_02_09_customer_service_numbers"](spark, sf)
    assert "Exchange hashpartitioning(c_custkey" in out._jdf.queryExecution().executedPlan().toString()


# -- F7


def test_pool_takes_a_batch_in_slices_and_keeps_rows(spark):
    """The calls of a batch of 20 MB are not all under way or held before the first answers leave."""
    from pyspark.sql import types as T

    from voxmill.functions import resources

    rows = spark.range(5000, numPartitions=1).select("id", F.repeat(F.lit("x"), 4000).alias("text"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("n"))

    def build():
        seen = []

        def call(row):
            if row["id"] == 7:
                raise ValueError("no")
            seen.append(row["n"])
            return None if row["n"] is None else row["n"] + len(row["text"])

        return call

    out = resources.pooled(rows, build, T.LongType(), 4)
    got = out.select("id", "n", F.length("text"), "answer", "attempts", "error").collect()
    assert [tuple(r) for r in got] == [(i, None if i % 2 else i, 4000, None if i % 2 else i + 4000, 1, "ValueError: no" if i == 7 else None) for i in range(5000)]
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
