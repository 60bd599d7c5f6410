"""Readers, writers, pipelines from specs and streams over small files."""

import json

import pytest
from pyspark.sql import functions as F

from voxmill.operators import sampling, vectors, windows
from voxmill.plans.pipeline import build, transform
from voxmill.sources import readers, writers
from voxmill.streaming import chunker, incremental


def test_line_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n\nfour\n", encoding="utf-8")
    assert [(r.line_no, r.value) for r in readers.lines(spark, str(tmp_path / "a.txt")).orderBy("line_no").collect()] == [(1, "one"), (2, "two"), (3, ""), (4, "four")]
    assert readers.path_list(spark, str(tmp_path / "a.txt")) == ["one", "two", "", "four"]
    spark.range(5).write.parquet(str(tmp_path / "p1"))
    spark.range(5, 9).write.parquet(str(tmp_path / "p2"))
    (tmp_path / "list").write_text(f"{tmp_path}/p1 \n\n{tmp_path}/p2\n")
    assert readers.listed(spark, str(tmp_path / "list")).count() == 9


def test_json_dicts_later_wins(spark, tmp_path):
    for name, d in (("x.json", {"a": "1", "b": "2"}), ("y.json", {"b": "3"})):
        (tmp_path / name).write_text(json.dumps(d))
    got = {r.key: r.value for r in readers.json_dicts(spark, [str(tmp_path / "x.json"), str(tmp_path / "y.json")]).collect()}
    assert got == {"a": "1", "b": "3"}


def test_samples_quarantine_only_bad_rows(spark, tmp_path):
    lines = ['{"key": "a", "txt": "t", "code": [1, 2]}', "{bad", '{"utt": "b", "text": "u", "speech_token": "[3, 4]"}', '{"key": "c", "code": "oops("}', '{"key": null, "utt": "no", "txt": "d"}', "[1]"]
    (tmp_path / "s.jsonl").write_text("\n".join(lines) + "\n")
    rows = readers.sample_lines(readers.lines(spark, str(tmp_path / "s.jsonl")))
    got = [(r.utt, r.tokens, r.reason) for r in rows.orderBy("line_no").collect()]
    assert got == [("a", [1, 2], None), (None, None, "malformed_json"), ("b", [3, 4], None), ("c", None, "bad_tokens"), (None, None, None), (None, None, "malformed_json")]
    good, bad = readers.quarantine(rows)
    assert good.count() == 3 and bad.count() == 3 and readers.policy(rows, "skip").count() == 3
    with pytest.raises(Exception, match="bad record"):
        readers.policy(rows, "fail").collect()


def test_keyed_tables(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("utt\tv\na\t1\nb\t2\na\t3\n")
    assert {r.utt: r.v for r in readers.keyed_tsv(spark, str(tmp_path / "t.tsv"), "utt").collect()} == {"a": "3", "b": "2"}
    with pytest.raises(ValueError):
        readers.keyed_tsv(spark, str(tmp_path / "t.tsv"), "nope")
    (tmp_path / "text").write_text("u1  hello   world\nu2\n\n")
    assert [tuple(r) for r in readers.keyed_lines(readers.lines(spark, str(tmp_path / "text"))).orderBy("key").collect()] == [("u1", "hello world"), ("u2", "")]


def test_listings(spark, tmp_path):
    for p in ("m/e1/s1.wav", "m/e1/s2.wav", "m/e1/s1.normalized.txt", "top.wav"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    audio, words = readers.files(spark, str(tmp_path), "*.wav"), readers.files(spark, str(tmp_path), "*.txt")
    assert {(r.model, r.scene) for r in readers.path_tree(audio, str(tmp_path), ["model", "epoch", "scene"]).collect()} == {("m", "s1.wav"), ("m", "s2.wav")}
    paired, alone = readers.utterances_from_listing(audio, words)
    assert [r.utt for r in paired.collect()] == ["s1"] and sorted(r.utt for r in alone.collect()) == ["s2", "top"]
    assert readers.is_grouped(spark.createDataFrame([([1],)], "items array<int>")) and not readers.is_grouped(audio)


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a\tb", 1.5, "中"), ("c", None, "x")], "s string, d double, g string")
    writers.write_tsv(df.coalesce(1), f"{tmp_path}/tsv", F.col("s"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "tsv").glob("part-*")))
    assert "a b\t1.500000\t中" in text and "c\t\tx" in text
    writers.write_json(df, f"{tmp_path}/json")
    assert "中" in "".join(p.read_text() for p in (tmp_path / "json").glob("part-*"))
    writers.write_by(df, f"{tmp_path}/by", "g")
    assert (tmp_path / "by" / "g=x").exists()
    keys, speakers = writers.write_shards(spark.range(25).withColumn("spk", F.col("id") % 2).coalesce(1), f"{tmp_path}/shards", 10, "id", "spk")
    assert keys.select("file").distinct().count() == 3 and speakers.count() == 6
    writers.write_summary(df.agg(F.count("*").alias("n")), f"{tmp_path}/sum")
    writers.write_csv(df, f"{tmp_path}/csv")
    writers.write_splits(df.withColumn("split", F.lit("cv")), f"{tmp_path}/split", "split", ["train", "cv"])
    assert spark.read.json(f"{tmp_path}/split").count() == 2
    writers.append(spark.range(3), f"{tmp_path}/t")
    writers.append(spark.range(3), f"{tmp_path}/t")
    writers.rewrite(spark.read.parquet(f"{tmp_path}/t").filter("id > 0"), f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 4 and spark.read.parquet(f"{tmp_path}/t.bak").count() == 6


def test_row_numbers_without_one_partition(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x"))
    got = [(r.x, r.rn) for r in windows.numbered(df, [F.col("x")]).collect()]
    assert sorted(got) == [(x, i) for i, x in enumerate(sorted(x for x, _ in got), 1)]
    assert windows.numbered(df.limit(0), [F.col("x")]).count() == 0


def test_pipeline_from_a_spec(spark):
    @transform("double_for_test")
    def double(df, column):
        return df.withColumn(column, F.col(column) * 2)

    run = build([{"filter": {"condition": "id > 5"}}, {"double_for_test": {"column": "id"}}, {"with_columns": {"y": "id + 1"}}], {"filter": {"condition": "id > 7"}})
    assert [(r.id, r.y) for r in run(spark.range(10)).collect()] == [(16, 17), (18, 19)]
    with pytest.raises(KeyError):
        build(["nothing"])


def test_kmeans_invariants(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    d = vectors.flag_outliers(vectors.cluster_distances(e, "vec_id", "embedding", 4, 8), "distance", 0.1)
    rows = d.collect()
    assert len(rows) == e.count() and {r.cluster for r in rows} == {0, 1, 2, 3} and all(r.distance >= 0 for r in rows)
    edge = min(r.distance for r in rows if r.outlier)
    assert edge >= max(r.distance for r in rows if not r.outlier) and 0.05 < sum(r.outlier for r in rows) / len(rows) < 0.15


def test_chunk_stream_equals_batch(spark, tmp_path):
    texts = {1: "Hello there, my order id is 12345. Please check it now! Thanks a lot for help.", 2: "一二三，四五六。七八九十"}
    rows = []
    for session, said in texts.items():
        pieces = [said[i : i + 9] for i in range(0, len(said), 9)]
        rows += [(session, i, p, i == len(pieces) - 1) for i, p in enumerate(pieces)]
    half = len(rows) // 3
    for k, part in enumerate((rows[:half], rows[half : 2 * half], rows[2 * half :])):
        spark.createDataFrame(part, "session long, seq int, text string, final boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("session long, seq int, text string, final boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = chunker.chunk_stream(stream, "session", "seq", "text", "final", least=2, most=4)
    q = out.writeStream.format("memory").queryName("chunks").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(100)
    finally:
        q.stop()
    got = [r.chunk for r in spark.table("chunks").filter("session = 1").collect()]
    assert got == chunker.chunks_of(texts[1], least=2, most=4)


def test_incremental_runs_are_exactly_once(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/in")
    process = lambda df: df.withColumn("y", F.col("id") * 2)
    for _ in range(2):
        stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
        incremental.run_incremental(stream, f"{tmp_path}/out", f"{tmp_path}/cp", process).awaitTermination(120)
    spark.range(10, 15).write.mode("append").parquet(f"{tmp_path}/in")
    incremental.run_incremental(spark.readStream.schema("id long").parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp", process).awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(15))
    done = spark.range(4)
    assert incremental.resume(spark.range(10), done, "id", process).count() == 6


def test_code_collisions_are_seen(spark):
    codes = spark.range(300).select(sampling.suffix_id(F.col("id"), 1, 2).alias("c"))
    assert sampling.repeated_codes(codes, "c").count() > 0
