"""Behaviour captured in FIXTURES.md section 3."""

import pytest
from pyspark.sql import functions as F

from voxmill.functions import digits, json_fields, scores, text
from voxmill.operators import aggregates, filters, joins, projections, sampling, windows
from voxmill.plans import latency, prepare, preference
from voxmill.streaming import chunker


@pytest.fixture(scope="module")
def candidates(spark):
    rows = [(1, "g1_002", "b", [1, 2]), (2, "g1", "a", [1, 2]), (3, "g1_001", "a", [3]), (4, "g1_003", None, None), (5, "g2_000", "z", [9]), (6, "g2_001", "z", [9]), (7, None, "n", [1])]
    return spark.createDataFrame(rows, "line int, utt string, text string, token array<int>")


def _items(df):
    return {r["group_id"]: [x["utt"] for x in r["items"]] for r in df.collect()}


def test_prepare_pipeline(candidates):
    first = prepare.grouped_rows(candidates, "utt", "line")
    order = [aggregates.suffix_order("suffix_idx"), F.col("utt"), F.col("line")]
    assert _items(aggregates.group_items(first, "group_id", order, ["utt"])) == {"g1": ["g1_001", "g1_002", "g1_003", "g1"], "g2": ["g2_000", "g2_001"]}
    votes = {r["group_id"]: (r["majority"], r["majority_count"], r["unique_count"], r["majority_ratio"]) for r in aggregates.majority(first, "group_id", "text", order).collect()}
    assert votes == {"g1": ("a", 2, 2, 0.5), "g2": ("z", 2, 1, 1.0)}
    kept = prepare.drop_repeats(first, text.fingerprint("token"), "line")
    assert _items(prepare.regrouped(kept, "utt", "line", ["utt"])) == {"g1": ["g1_001", "g1_002", "g1_003"], "g2": ["g2_000"]}
    marked = first.join(kept.select("line", F.lit(True).alias("k")), "line", "left")
    row = aggregates.dedup_statistics(marked, "group_id", F.col("k")).first()
    assert (row.total_in, row.total_out, row.removed, row.groups, row.groups_reduced, row.max_removed) == (6, 4, 2, 2, 2, 1)


def test_missing_suffix_comes_first_when_regrouped(spark):
    rows = spark.createDataFrame([("g_001", 1, 0, 1, "g"), ("g", -1, 1, 2, "g"), ("x", -1, 0, 3, None)], "utt string, suffix_idx int, group_rank int, line int, group_id string")
    assert _items(prepare.regrouped(rows, "utt", "line", ["utt"])) == {"g": ["g", "g_001"], "__NO_GROUP__": ["x"]}


def test_group_of_nulls_has_no_majority(spark):
    rows = spark.createDataFrame([("g", None, 1), ("g", None, 2)], "g string, v string, n int")
    r = aggregates.majority(rows, "g", "v", [F.col("n")]).first()
    assert (r.majority, r.majority_count, r.unique_count) == ("", 0, 0)


LEFT = [("u1", "ok", 0.1, 0.5, 1.0, 2.0), ("u2", "ok", 0.2, 0.7, 2.0, 4.0), ("u3", "fail", None, None, 3.0, None), ("u1", "ok", 0.3, 0.9, 1.5, 2.0)]
RIGHT = [("u1", "ok", 0.2, 0.4, 1.2, 2.0), ("u4", "ok", 0.2, 0.4, 1.2, 2.0)]
LATENCY = "line int, utt string, status string, chunk double, audio double, done double, duration double"


def test_latency_tools(spark):
    left, right = (spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], LATENCY) for rows in (LEFT, RIGHT))
    r = latency.summary(left, [], "status", ["chunk", "audio", "done"], "done", "duration").first()
    got = [r.rows, r.ok, r.fail, *[round(x, 6) for x in (r.chunk_mean, r.chunk_p50, r.chunk_p95, r.audio_p95, r.done_p95, r.duration_mean, r.rtf)]]
    assert got == [4, 3, 1, 0.2, 0.2, 0.29, 0.88, 1.95, 2.666667, 0.5625]
    last = [joins.last_wins(df, ["utt"], [F.col("line")]) for df in (left, right)]
    both = {r.utt: (r.in_left, r.in_right, r.done_diff) for r in joins.compare_full(*last, "utt", ["done"]).collect()}
    assert both["u1"][:2] == (True, True) and round(both["u1"][2], 6) == -0.3
    assert both["u2"] == (True, False, None) and both["u3"] == (True, False, None) and both["u4"] == (False, True, None)
    counts = {r.metric: (r.left_value, r.right_value) for r in latency.paired_summary(*last, "utt", "status", ["done"]).collect()}
    assert counts == {"rows": (3.0, 2.0), "done": (1.5, 1.2)}


def test_evaluation_comparison(spark):
    rows = [("s", "m", "baseline_a", 4.0), ("s", "m", "opd_x", 3.0), ("s", "m", "opd_y", None), ("s", "m", "other", 1.0), ("t", "m", "opd_z", 2.0)]
    df = spark.createDataFrame(rows, "set string, meta string, exp string, cer double").withColumn("role", projections.role_of(F.col("exp"), "baseline", "opd"))
    out = joins.cross_in_group(df, ["set", "meta"], "role", "baseline", "candidate", ["cer"], "exp")
    got = {r.cand_exp: (r.d, r.g) for r in out.select("cand_exp", (F.col("cand_cer") - F.col("base_cer")).alias("d"), joins.improvement(F.col("base_cer"), F.col("cand_cer")).alias("g")).collect()}
    assert got == {"opd_x": (-1.0, 25.0), "opd_y": (None, None)}


def test_hash_split_is_strict_and_stable(spark):
    keys = spark.range(2000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"))
    share = keys.select(windows.hash_split(F.col("k"), "s", 0.1).alias("s")).filter("s = 'cv'").count() / 2000
    assert 0.07 < share < 0.13
    assert keys.select(windows.hash_split(F.col("k"), "s", 0.0).alias("s")).filter("s = 'cv'").count() == 0


def test_converter_reasons(spark):
    rows = [([1, 2], [3, 4], "u", "t"), (None, [1], "u", "t"), ([1], [1, 2], "u", "t"), ([1, 2], [3, 4], "", "t"), ([1, 2], [3, 4], "u", None)]
    df = spark.createDataFrame(rows, "c array<int>, r array<int>, u string, t string")
    got = [r[0] for r in df.select(projections.pair_record_reason(F.col("c"), F.col("r"), F.col("u"), F.col("t"))).collect()]
    assert got == [None, "bad_token_type", "token_too_short", "missing_utt", "missing_text"]


def test_validator(spark):
    rows = [("a", "[1,2]"), ("", "[1]"), ("a", "[7000]"), ("a", "[true]"), ("a", None)]
    df = spark.createDataFrame(rows, "t string, s string").withColumn("tok", json_fields.int_list("s"))
    got = [r[0] for r in df.select(filters.record_errors(F.col("t"), F.col("tok"))).collect()]
    assert got == [[], ["empty_text"], ["token_out_of_range"], ["no_tokens", "empty_tokens"], ["no_tokens", "empty_tokens"]]


@pytest.mark.parametrize(
    "given,want",
    [
        ("手机尾号 6789", "手机尾号 六七八九"), ("拨打 10086", "拨打 幺零零八六"), ("验证码是 123456", "验证码是 幺二三四五六"), ("订单号 123456", "订单号 幺二三四五六"),
        ("300M的带宽", "三百兆的带宽"), ("1G宽带", "千兆宽带"), ("请按 1 号键", "请按一"), ("分机 8001", "分机 八零零一"), ("400-123-4567", "四零零幺二三四五六七"),
        ("13812345678", "幺三八幺二三四五六七八"), ("12315", "幺二三幺五"), ("5G手机", "5G手机"), ("编号A12315B", "编号A12315B"),
    ],
)
def test_digit_reading(given, want):
    assert digits.read_numbers(given) == want


def test_cardinals():
    assert [digits.cardinal(n) for n in (0, 7, 10, 11, 20, 101, 110, 1001, 1010, 1234, 10_000)] == [None, "七", "十", "十一", "二十", "一百零一", "一百十", "一千零一", "一千零十", "一千二百三十四", None]


def test_english_numbers():
    assert [text.english_number(n) for n in (0, 13, 42, 100, 215, 1001, 1_234_567)] == ["zero", "thirteen", "forty-two", "one hundred", "two hundred and fifteen", "one thousand and one", "one million, two hundred and thirty-four thousand, five hundred and sixty-seven"]


def test_text_chunker():
    said = "Hello there, my order id is 12345. Please check it now! Thanks a lot for help."
    assert chunker.chunks_of(said, least=2, most=4) == ["Hello there,", "my order", "id is", "12345. Please", "check it", "now! Thanks", "a lot", "for help."]
    assert chunker.chunks_of("<|spk_1|>hi there you", least=1, most=2, tag="<|spk_9|>")[0].startswith("<|spk_1|>")
    assert chunker.chunks_of("") == []
    assert "".join(chunker.chunks_of("a [tag] b <x> c 12.5元 d", least=1, most=1)).replace(" ", "") == "a[tag]b<x>c12.5元d"


def test_edge_buckets_and_splits(spark):
    df = spark.createDataFrame([(1.0,), (2.5,), (4.0,), (5.0,), (9.0,)], "x double")
    assert [r[0] for r in df.select(scores.edge_bucket("x", (2.5, 3.0, 5.0))).collect()] == ["[3.0, 5.0]", "[2.5, 3.0)", "[3.0, 5.0)", "[3.0, 5.0]", "[3.0, 5.0]"]
    parts = windows.even_parts(spark.range(10), [F.col("id")], 4).groupBy("part").count().orderBy("part").collect()
    assert [r["count"] for r in parts] == [3, 3, 2, 2]


def test_floor_percentile_is_not_a_builtin(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)], "v double")
    assert aggregates.floor_percentiles(df, "v", (0.95,)).first()["value"] == 3.0


def test_padded_batches_start_without_an_empty_one(spark):
    rows = spark.createDataFrame([(0, 0, 6001), (0, 1, 10), (0, 2, 10), (1, 0, 5)], "bucket long, place int, n long")
    got = {(r.bucket, r.place): r.batch for r in windows.padded_batches(rows, "bucket", ["place"], "n", 24_000).collect()}
    assert got == {(0, 0): 0, (0, 1): 1, (0, 2): 1, (1, 0): 0}


def test_buffered_shuffle_keeps_rows():
    import pandas as pd

    frames = [pd.DataFrame({"x": range(i, i + 7)}) for i in range(0, 70, 7)]
    out = pd.concat(list(windows.buffered_shuffle(iter(frames), 20, 1)))
    assert sorted(out["x"]) == list(range(70)) and list(out["x"]) != list(range(70))


def test_tournament_ends_for_every_size():
    import pandas as pd

    pdf = pd.DataFrame({"k": range(30), "s": [(i * 7) % 31 for i in range(30)]})
    judge = preference.score_judge("s", "k")
    for size, calls in ((2, None), (3, None), (4, None), (6, None)):
        best, worst, n = preference.tournament(pdf, judge, size)
        assert pdf.s[best] == pdf.s.max() and pdf.s[worst] == pdf.s.min() and n < 60
    assert preference.champion_challenger(pdf, judge) == preference.tournament(pdf, judge, 4)[:2]
    with pytest.raises(ValueError):
        preference.tournament(pdf, judge, 1)


def test_judge_errors_are_data(spark):
    def broken(pdf):
        raise ValueError("no")

    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "g string, k int")
    got = {r.g: r.error for r in preference.select_pairs(df, "g", "k", ["k"], broken).collect()}
    assert got == {"a": "ValueError: no", "b": "too_few_candidates"}
    tries = []

    def flaky(pdf):
        tries.append(1)
        if len(tries) < 3:
            raise TimeoutError
        return 0, 1

    assert preference.retrying(flaky)(None) == (0, 1) and len(tries) == 3


def test_word_errors_match_edit_distance():
    import random

    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("xyz") for _ in range(rng.randrange(8))] for _ in range(2))
        s, i, d, k = text.word_errors(a, b)
        assert k + s + d == len(a) and k + s + i == len(b)
        row = list(range(len(b) + 1))
        for x, p in enumerate(a, 1):
            last, row = row, [x]
            for y, q in enumerate(b, 1):
                row.append(min(last[y - 1] + (p != q), last[y] + 1, row[-1] + 1))
        assert s + i + d == row[-1]


def test_paragraphs_and_blanks(spark):
    assert text.paragraph_pieces("一。二。", most=2, least=0, merge=0) == ["一。", "二。"]
    assert text.paragraph_pieces("ab. cd", lang="en", merge=1)[-1].endswith(".")
    assert text.paragraph_pieces("") == []
    df = spark.createDataFrame([("你 好 a b 中",), (" x ",)], "t string")
    assert [r[0] for r in df.select(text.blanks_between_ascii("t")).collect()] == ["你好a b中", "x"]
    assert text.sentence_pieces('a 1,5 b；"c" d, e') == ['a 1,5 b；"', 'c" d,', "e"]


def test_versions_are_unique(spark):
    df = spark.createDataFrame([("g", "v1", 1, 1), ("g", "v1", 2, 2), ("g", "v1", 2, 3)], "g string, b string, r int, n int")
    out = preference.unique_versions(df, "g", F.col("b"), F.col("r"), [F.col("n")])
    assert [r.version for r in out.orderBy("n").collect()] == ["v1", "v1_r002", "v1_u002"]


def test_samples_have_their_sizes(spark):
    df = spark.range(500).withColumn("g", F.col("id") % 7)
    a = [r.id for r in sampling.sample_rows(df, F.col("id"), 50, 1).collect()]
    assert len(set(a)) == 50 and a == [r.id for r in sampling.sample_rows(df, F.col("id"), 50, 1).collect()] != sorted(a)
    assert sampling.sample_two_levels(df, "g", F.col("id"), 3, 4, 1).groupBy("g").count().filter("count = 4").count() == 3


def test_sorted_percentiles_match_the_aggregate(spark):
    rows = [(g, float((i * 37) % 101)) for g in ("a", "b", None) for i in range(23)] + [("a", None), ("one", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    ps = (0.0, 0.3, 0.5, 0.95, 1.0)
    want = {(r.g, p): r[f"p{i}"] for r in df.groupBy("g").agg(*aggregates.linear_percentiles("v", ps, [f"p{i}" for i in range(5)])).collect() for i, p in enumerate(ps)}
    got = {(r.g, r.p): r.value for r in aggregates.sorted_percentiles(df, "v", ps, ["g"]).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    floors = {(r.g, r.p): r.value for r in aggregates.floor_percentiles(df, "v", ps, ["g"]).collect()}
    by = {g: sorted(v for h, v in rows if h == g and v is not None) for g, _ in rows}
    assert floors == {(g, p): v[int((len(v) - 1) * p)] for g, v in by.items() for p in ps}
    assert aggregates.floor_percentiles(df.filter("v > 1e9"), "v").count() == 0
