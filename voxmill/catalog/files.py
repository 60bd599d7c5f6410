"""Sources and sinks: every query writes what it needs to the shared folder with a writer and reads it back."""

from __future__ import annotations

import io
import struct
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import resources, scores
from ..operators import vectors, windows
from ..sources import binary, readers, writers
from ..storage import scratch
from ..streaming import incremental
from .registry import Tables, query


def _put(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file in the shared folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(data))
    out.close()


def _part(spark: SparkSession, folder: str) -> str:
    """The one data file of a folder."""
    return readers.files(spark, folder, "part-*").first()["path"]


# -- sources


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 < 2")
def src_01_list_file(t: Tables) -> DataFrame:
    """A list file names two of three shards; a blank line in it is no shard."""
    root = scratch(t.spark)
    for k in range(3):
        t.orders.filter(F.col("o_orderkey") % 3 == k).select("o_orderkey", "o_custkey").write.parquet(f"{root}/shard {k}")
    _put(t.spark, f"{root}/list", f"  {root}/shard 0  \n\n{root}/shard 1\n".encode())
    return readers.listed(t.spark, f"{root}/list")


@query("SELECT c_nationkey::VARCHAR AS key, arg_max(c_name, (c_custkey % 3) * 100000000 + c_custkey) AS value FROM customer GROUP BY c_nationkey")
def src_02_merge_later_wins(t: Tables) -> DataFrame:
    """One-object JSON files of one name in three folders: the last file that has a key wins."""
    root = scratch(t.spark)
    rows = t.customer.groupBy((F.col("c_custkey") % 3).alias("k"), "c_nationkey").agg(F.max_by("c_name", "c_custkey").alias("v"))
    objects = {r["k"]: r["j"] for r in rows.groupBy("k").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("c_nationkey").cast("string"), "v")))).alias("j")).collect()}
    for k, text in objects.items():
        _put(t.spark, f"{root}/{k}/utt2wav.json", text.encode())
    return readers.json_dicts(t.spark, [f"{root}/{k}/utt2wav.json" for k in sorted(objects)])


@query("SELECT count(*) AS rows, sum(o_custkey)::BIGINT AS custkeys, 4 AS files FROM orders")
def src_05_src_07_scan_with_file(t: Tables) -> DataFrame:
    """Parquet files with the file of each row; one that is no parquet file is skipped."""
    root = scratch(t.spark)
    t.orders.select("o_orderkey", "o_custkey").repartition(4).write.parquet(f"{root}/t")
    _put(t.spark, f"{root}/t/part-broken.parquet", b"PAR1 this is no parquet file PAR1" * 100)
    _put(t.spark, f"{root}/list", f"{root}/t\n".encode())
    rows = readers.listed(t.spark, f"{root}/list", schema="o_orderkey long, o_custkey long", ignoreCorruptFiles="true").select("*", F.col("_metadata.file_path").alias("file"))
    return rows.agg(F.count("*").alias("rows"), F.sum("o_custkey").alias("custkeys"), F.countDistinct("file").cast("int").alias("files"))


def _assigned_sql(epoch: int, rank: int, world: int, worker: int, workers: int, where: str) -> str:
    return f"""WITH o AS (SELECT s_suppkey, row_number() OVER (ORDER BY md5('{epoch}:' || s_suppkey), s_suppkey) - 1 AS i, count(*) OVER () AS n FROM supplier WHERE {where}),
    p AS (SELECT s_suppkey, unnest(range(i, greatest(n, {world}), n)) AS p FROM o), r AS (SELECT s_suppkey, p // {world} AS j FROM p WHERE p % {world} = {rank}),
    m AS (SELECT s_suppkey, j, count(*) OVER () AS m FROM r), q AS (SELECT s_suppkey, unnest(range(j, greatest(m, {workers}), m)) AS q FROM m)
    SELECT s_suppkey, q // {workers} AS place FROM q WHERE q % {workers} = {worker}"""


@query(_assigned_sql(2, 1, 4, 1, 3, "true"))
def src_06_shard_assignment(t: Tables) -> DataFrame:
    """The shards, shuffled by the epoch, of the second worker of three of the second rank of four."""
    return readers.assign_shards(t.supplier.select("s_suppkey"), F.col("s_suppkey"), 1, 4, 1, 3, epoch=2)


@query(_assigned_sql(0, 5, 7, 2, 4, "s_suppkey <= 3"))
def src_06_fewer_shards_than_readers(t: Tables) -> DataFrame:
    """Three shards for seven ranks of four workers: each reader has one."""
    return readers.assign_shards(t.supplier.filter("s_suppkey <= 3").select("s_suppkey"), F.col("s_suppkey"), 5, 7, 2, 4)


@query("SELECT user_id::VARCHAR AS user_id, printf('%.6f', value) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def src_12_last_row_wins(t: Tables) -> DataFrame:
    """A TSV of several files with a header each; of a key the last row counts."""
    root = scratch(t.spark)
    writers.write_tsv(t.events.select("event_id", "user_id", "value"), root, F.col("event_id"))
    return readers.keyed_tsv(t.spark, root, "user_id").select("user_id", "value")


_BOOK = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>',
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="regions" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml" Type="x"/></Relationships>',
}


def workbook(rows: list[list[str]]) -> bytes:
    """A workbook of one sheet, texts shared."""
    shared = sorted({c for r in rows for c in r})
    texts = "".join(f"<si><t>{c}</t></si>" for c in shared)
    body = "".join(f'<row r="{i}">' + "".join(f'<c r="{chr(65 + k)}{i}" t="s"><v>{shared.index(c)}</v></c>' for k, c in enumerate(r)) + "</row>" for i, r in enumerate(rows, 1))
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in (_BOOK | {"xl/sharedStrings.xml": f"<sst {ns}>{texts}</sst>", "xl/worksheets/sheet1.xml": f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>"}).items():
            z.writestr(name, text)
    return out.getvalue()


@query("SELECT n_nationkey::VARCHAR AS key, n_name AS name FROM nation")
def src_14_workbook(t: Tables) -> DataFrame:
    """The cells of an xlsx workbook, below its header."""
    root = scratch(t.spark)
    _put(t.spark, f"{root}/book.xlsx", workbook([["key", "name"], *([str(r["n_nationkey"]), r["n_name"]] for r in t.nation.collect())]))
    rows = binary.workbooks(t.spark, root).filter("sheet = 'regions' and row_no > 1")
    return rows.select(F.get("cells", F.lit(0)).alias("key"), F.get("cells", F.lit(1)).alias("name"))


def event_record(wall: float, step: int, tag: str, value: float) -> bytes:
    """A scalar as a record of an event file, without check sums."""

    def size(n: int) -> bytes:
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    entry = b"\x0a" + size(len(tag.encode())) + tag.encode() + b"\x15" + struct.pack("<f", value)
    summary = b"\x0a" + size(len(entry)) + entry
    data = b"\x09" + struct.pack("<d", wall) + b"\x10" + size(step) + b"\x2a" + size(len(summary)) + summary
    return struct.pack("<Q", len(data)) + b"\0" * 4 + data + b"\0" * 4


@query("SELECT 'n' || r_regionkey AS run, 'nations/' || n_name AS tag, n_nationkey::BIGINT * 1000 AS step, n_nationkey / 4.0::DOUBLE AS value FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name <> 'NATION_3'")
def src_17_scalars(t: Tables) -> DataFrame:
    """Scalars of event files in a folder a run; one tag is left out by name."""
    root = scratch(t.spark)
    by_run: dict[int, bytes] = {}
    for r in t.nation.orderBy("n_nationkey").collect():
        by_run[r["n_regionkey"]] = by_run.get(r["n_regionkey"], b"") + event_record(1.5, r["n_nationkey"] * 1000, f"nations/{r['n_name']}", r["n_nationkey"] / 4)
    for k, raw in by_run.items():
        _put(t.spark, f"{root}/n{k}/events.out.tfevents.1", raw + b"\x40\0\0\0")
    return binary.scalars(t.spark, root, include=["nations/"]).filter("tag <> 'nations/NATION_3'").select("run", "tag", "step", "value")


@query("SELECT * FROM (VALUES ('a', 'x.jsonl'), ('a', 'y.JSON'), ('b', 'u.txt'), ('b', 'v.lst')) AS v(entry, name)")
def src_18_record_files(t: Tables) -> DataFrame:
    """Files with a known suffix below two folders, two at most of each."""
    root = scratch(t.spark)
    for name in ("a/x.jsonl", "a/deep/y.JSON", "a/z.wav", "a/zz.txt", "b/u.txt", "b/c/v.lst", "b/w", "b/z/z.list"):
        _put(t.spark, f"{root}/{name}", b"{}\n")
    entry = F.regexp_extract("path", r"/tables/[^/]+/([^/]+)/", 1)
    found = readers.record_files(readers.files(t.spark, root), entry, most=2)
    return found.select("entry", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"))


@query(
    """SELECT 'u' || c_custkey AS utt, 'root/' || c_mktsegment || '/u' || c_custkey || '.wav' AS wav, c_mktsegment AS spk, 'said ' || c_name AS text FROM customer WHERE c_custkey % 5 <> 0"""
)
def src_20_transcripts(t: Tables) -> DataFrame:
    """A transcript file with a header and noise tags, against the audio files that are there."""
    root = scratch(t.spark)
    wav = F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit(".wav"))
    line = F.concat_ws("\t", wav, "c_mktsegment", F.concat(F.lit("[FIL]said "), F.col("c_name"), F.lit("[SPK]")))
    head = t.spark.range(1).select(F.lit(-1).cast("long").alias("c_custkey"), F.lit("wav\tspk\tcontent").alias("value"))
    head.unionByName(t.customer.select("c_custkey", line.alias("value"))).coalesce(1).sortWithinPartitions("c_custkey").select("value").write.text(root)
    existing = t.customer.filter("c_custkey % 5 <> 0").select(F.concat_ws("/", F.lit("root"), "c_mktsegment", wav).alias("path"))
    return readers.transcripts(readers.lines(t.spark, root), "root/", existing)


@query("SELECT * FROM (VALUES ('flat', false), ('grouped', true), ('odd', false)) AS v(name, grouped)")
def src_21_autodetect(t: Tables) -> DataFrame:
    """Whether a file has groups or flat rows, by its first non-blank line."""
    root = scratch(t.spark)
    for name, text in (("grouped", '\n  \n{"group_id": "g", "items": [{"utt": "a"}]}\n{"utt": "b"}\n'), ("flat", '{"utt": "b"}\n{"items": []}\n'), ("odd", '{"items": "none"}\n')):
        _put(t.spark, f"{root}/{name}.jsonl", text.encode())
    found = readers.grouped_files(readers.lines(t.spark, root))
    return found.select(F.regexp_extract("file", r"([^/]*)\.jsonl$", 1).alias("name"), "grouped")


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS line_no FROM documents")
def src_lines_are_numbered(t: Tables) -> DataFrame:
    """Beyond the survey's operators: numbers of lines that are read in many splits."""
    root = scratch(t.spark)
    t.documents.select("doc_id").coalesce(1).sortWithinPartitions("doc_id").select(F.col("doc_id").cast("string").alias("value")).write.text(root)
    return readers.lines(t.spark, root).select(F.col("value").cast("long").alias("doc_id"), F.col("line_no").cast("long").alias("line_no"))


# -- sinks


@query("SELECT doc_id, text, row_number() OVER (ORDER BY lang, doc_id) AS place FROM documents WHERE doc_id % 5 = 0")
def snk_01_json_lines(t: Tables) -> DataFrame:
    """JSON lines in a global order, texts as they are."""
    root = scratch(t.spark)
    writers.write_json(t.documents.filter("doc_id % 5 = 0").select("lang", "doc_id", "text"), root, F.col("lang"), F.col("doc_id"))
    lines = windows.numbered(readers.lines(t.spark, root), [F.col("file"), F.col("line_no")], "place")
    return lines.select(F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id"), F.get_json_object("value", "$.text").alias("text"), "place")


@query("SELECT o_orderkey::VARCHAR AS o_orderkey, printf('%.6f', o_totalprice) AS price, o_orderpriority || '  x' AS note FROM orders")
def snk_02_fixed_point_text(t: Tables) -> DataFrame:
    """A TSV with fixed places; breaks and tabs in a text are blanks in it."""
    root = scratch(t.spark)
    rows = t.orders.select("o_orderkey", F.col("o_totalprice").alias("price"), F.concat("o_orderpriority", F.lit("\t\nx")).alias("note"), F.lit(None).cast("double").alias("blank"))
    writers.write_tsv(rows, root, F.col("o_orderkey"))
    parts = F.split("value", "\t")
    lines = readers.lines(t.spark, root).filter("line_no > 1")
    return lines.filter((F.size(parts) == 4) & (F.get(parts, F.lit(3)) == "")).select(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(("o_orderkey", "price", "note"))])


@query("SELECT s_suppkey, s_name || ', \"x\"' AS name, s_acctbal FROM supplier")
def snk_03_csv(t: Tables) -> DataFrame:
    """A CSV with commas and quotes in it."""
    root = scratch(t.spark)
    writers.write_csv(t.supplier.select("s_suppkey", F.concat("s_name", F.lit(', "x"')).alias("name"), "s_acctbal"), root)
    return t.spark.read.csv(root, header=True, schema="s_suppkey long, name string, s_acctbal double", escape="\\")


@query("SELECT count(*) AS rows, count(DISTINCT lang) AS langs, sum(n_chars)::BIGINT AS chars, min(n_chars) AS shortest, max(n_chars) AS longest FROM documents")
def snk_04_summary_counters(t: Tables) -> DataFrame:
    """Counters as one JSON document."""
    root = scratch(t.spark)
    counters = t.documents.agg(F.count("*").alias("rows"), F.countDistinct("lang").alias("langs"), F.sum("n_chars").alias("chars"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"))
    writers.write_summary(counters, root)
    return t.spark.read.schema(counters.schema).json(_part(t.spark, root))


@query("SELECT source, count(*) AS utts, true AS within FROM documents GROUP BY source")
def snk_05_shards_of_rows(t: Tables) -> DataFrame:
    """Files of 100 rows at most, and where each utterance and each speaker is."""
    root = scratch(t.spark)
    keys, speakers = writers.write_shards(t.documents.select("doc_id", "source", "text"), root, 100, "doc_id", "source")
    largest = keys.groupBy("file").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"))
    pairs = keys.join(t.documents.select("doc_id", "source"), "doc_id").join(speakers, ["source", "file"])
    return pairs.groupBy("source").agg(F.count("*").alias("utts")).crossJoin(largest).select("source", "utts", (F.col("most") <= 100).alias("within"))


@query("SELECT c_mktsegment AS grade, count(*) AS n, min(c_custkey) AS first FROM customer GROUP BY c_mktsegment")
def snk_06_demultiplexed(t: Tables) -> DataFrame:
    """What the files in each folder of a table partitioned by grade hold."""
    root = scratch(t.spark)
    writers.write_by(t.customer.select(F.col("c_mktsegment").alias("grade"), "c_custkey"), root, "grade")
    rows = t.spark.read.option("recursiveFileLookup", "true").schema("c_custkey long").parquet(root)
    return rows.groupBy(F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), r"/grade=([^/]*)/", 1)).alias("grade")).agg(F.count("*").alias("n"), F.min("c_custkey").alias("first"))


@query("SELECT split, count(*) AS n, min(doc_id) AS first FROM (SELECT doc_id, CASE WHEN n_chars < 100 THEN 'bad' WHEN doc_id % 10 = 0 THEN 'cv' ELSE 'train' END AS split FROM documents) GROUP BY split")
def snk_07_three_way_split(t: Tables) -> DataFrame:
    """Train, cv and bad rows from one pass, each read from its own folder."""
    root = scratch(t.spark)
    split = F.when(F.col("n_chars") < 100, "bad").when(F.col("doc_id") % 10 == 0, "cv").when(F.col("doc_id") >= 0, "train").otherwise("none")
    writers.write_splits(t.documents.select("doc_id", split.alias("split")), root, "split", ["train", "cv", "bad"])
    parts = [t.spark.read.schema("doc_id long").json(f"{root}/split={name}").select(F.lit(name).alias("split"), "doc_id") for name in ("train", "cv", "bad")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("split").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query("SELECT o_orderkey, o_totalprice FROM orders")
def snk_08_appended(t: Tables) -> DataFrame:
    """Rows of three writers in one table."""
    root = scratch(t.spark)
    for k in range(3):
        writers.append(t.orders.filter(F.col("o_orderkey") % 3 == k).select("o_orderkey", "o_totalprice"), root)
    return t.spark.read.parquet(root)


@query(
    """WITH j AS (SELECT source, count(*) AS n, min(doc_id) AS best, max(doc_id) AS worst FROM documents GROUP BY source)
    SELECT 'pairs' AS part, count(*) AS rows, coalesce(sum(best), 0)::BIGINT AS keys FROM j WHERE n > 1 UNION ALL SELECT 'discarded', count(*), coalesce(sum(best), 0)::BIGINT FROM j WHERE n <= 1
    UNION ALL SELECT 'manifest', count(*), coalesce(sum(best), 0)::BIGINT FROM j WHERE n > 1"""
)
def snk_09_incremental_writer(t: Tables) -> DataFrame:
    """Groups stream in; pairs, discarded groups and a manifest come out, batch by batch."""
    root = scratch(t.spark)
    judged = t.documents.groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("best"), F.max("doc_id").alias("worst"))
    judged.select("source", "best", "worst", F.when(F.col("n") <= 1, "too_few").alias("reason")).repartition(3).write.parquet(f"{root}/in")
    stream = t.spark.readStream.schema("source string, best long, worst long, reason string").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    incremental.run_judged(stream, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    read = lambda name: t.spark.read.schema("source string, best long, worst long, reason string").json(f"{root}/out/{name}").select(F.lit(name).alias("part"), "best")
    manifest = t.spark.read.schema("source string, best long, worst long").csv(f"{root}/out/manifest", sep="\t", header=True).select(F.lit("manifest").alias("part"), "best")
    names = t.spark.createDataFrame([("pairs",), ("discarded",), ("manifest",)], "part string")
    counts = read("pairs").unionByName(read("discarded")).unionByName(manifest).groupBy("part").agg(F.count("*").alias("rows"), F.sum("best").alias("keys"))
    return names.join(counts, "part", "left").select("part", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("keys", F.lit(0)).cast("long").alias("keys"))


@query("SELECT count(*) FILTER (o_orderkey % 2 = 0) AS rows, count(*) AS backup FROM orders")
def snk_10_rewritten(t: Tables) -> DataFrame:
    """A table replaced by a part of itself, twice; the backup is the table before."""
    root = scratch(t.spark)
    t.orders.select("o_orderkey").write.parquet(f"{root}/t")
    writers.rewrite(t.spark.read.parquet(f"{root}/t").filter("o_orderkey >= 0"), f"{root}/t")
    writers.rewrite(t.spark.read.parquet(f"{root}/t").filter("o_orderkey % 2 = 0"), f"{root}/t")
    counts = [t.spark.read.parquet(f"{root}/{name}").agg(F.count("*").alias(column)) for name, column in (("t", "rows"), ("t.bak", "backup"))]
    return counts[0].crossJoin(counts[1])


@query("SELECT 3 AS shards, count(*) AS done FROM events")
def snk_11_progress(t: Tables) -> DataFrame:
    """Counters of three shards, one of them run again, summed by a monitor."""
    root = scratch(t.spark)
    for k in (0, 1, 2, 1):
        writers.write_counted(t.events.filter(F.col("event_id") % 3 == k), f"{root}/{k}", f"{root}/progress", k)
    return writers.total_progress(t.spark, f"{root}/progress").withColumn("shards", F.col("shards").cast("int"))


# -- resources


@query("SELECT doc_id, len(string_split(text, ' ')) AS tokens, coalesce(list_sum(list_transform(string_split(text, ' '), lambda x: len(x))), 0)::BIGINT AS ids FROM documents")
def udf_03_tokenizer(t: Tables) -> DataFrame:
    """The default tokenizer in the JVM, and one that is built once a task, whose ids are lengths of words."""

    def build():
        lengths: dict[str, int] = {}
        return lambda s: [lengths.setdefault(w, len(w)) for w in s.split(" ")]

    ids = F.aggregate(resources.token_ids("text", build), F.lit(0).cast("long"), lambda a, x: a + x)
    return t.documents.select("doc_id", resources.blank_tokens("text").alias("tokens"), ids.alias("ids"))


@query("SELECT doc_id, length(text)::BIGINT AS size, 1::BIGINT AS attempts FROM documents WHERE doc_id % 4 = 0")
def udf_04_pooled_extraction(t: Tables) -> DataFrame:
    """A feature of each row by a pool of calls in each task."""
    rows = t.documents.filter("doc_id % 4 = 0").select("doc_id", "text")
    out = resources.pooled(rows, lambda: lambda row: len(row["text"]), T.LongType(), 4)
    return out.select("doc_id", F.col("answer").alias("size"), "attempts")


@query(
    """SELECT event_id, CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 THEN NULL WHEN value >= 50 THEN 'win' ELSE 'lose' END AS verdict,
    CASE WHEN event_id % 11 = 0 THEN 1 WHEN event_id % 13 = 0 THEN 4 ELSE 1 + event_id % 3 END::BIGINT AS attempts,
    CASE WHEN event_id % 11 = 0 THEN 'ValueError: no audio' WHEN event_id % 13 = 0 THEN 'RateLimited: rate limited' END AS error FROM events WHERE event_id < 2000"""
)
def udf_05_judge_with_retries(t: Tables) -> DataFrame:
    """A stub judge that is rate limited at first, always, or fails for good; four calls at once in a task."""

    def build():
        asked: dict[int, int] = {}

        def judge(row: dict) -> str:
            key = row["event_id"]
            if key % 11 == 0:
                raise ValueError("no audio")
            asked[key] = asked.get(key, 0) + 1
            if key % 13 == 0 or asked[key] <= key % 3:
                raise resources.RateLimited()
            return "win" if row["value"] >= 50 else "lose"

        return judge

    out = resources.pooled(t.events.filter("event_id < 2000").select("event_id", "value"), build, T.StringType(), 4, retries=3, backoff=0.0)
    return out.select("event_id", F.col("answer").alias("verdict"), "attempts", "error")


@query("SELECT vec_id, label * 2 AS first, 2 AS passes FROM embeddings")
def ml_05_cached_embeddings(t: Tables) -> DataFrame:
    """Half of the keys are in the cache, the others are computed and added; each once."""
    root = scratch(t.spark)
    rows = t.embeddings.select("vec_id", "label")

    def compute(missing: DataFrame) -> DataFrame:
        return missing.select("vec_id", F.array(F.col("label") * 2).alias("emb"))

    vectors.cached_embeddings(rows.filter("vec_id % 2 = 0"), "vec_id", root, compute).count()
    out = vectors.cached_embeddings(rows, "vec_id", root, compute)
    return out.select("vec_id", F.get("emb", F.lit(0)).alias("first"), F.lit(2).alias("passes"))


# -- losses and hops


@query(
    """WITH ex AS (SELECT vec_id, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings),
    j AS (SELECT a.vec_id, a.x / 2 AS s, b.x / 2 AS t, row_number() OVER (PARTITION BY a.vec_id ORDER BY a.x DESC, a.pos) AS rs, row_number() OVER (PARTITION BY a.vec_id ORDER BY b.x DESC, b.pos) AS rt
          FROM ex a JOIN ex b ON b.vec_id = a.vec_id + 1 AND b.pos = a.pos),
    r AS (SELECT vec_id, s - ln(sum(exp(s)) OVER w) AS ls, t - ln(sum(exp(t)) OVER w) AS lt FROM j WHERE rs <= 8 WINDOW w AS (PARTITION BY vec_id)),
    f AS (SELECT vec_id, s - ln(sum(exp(s)) OVER w) AS ls, t - ln(sum(exp(t)) OVER w) AS lt FROM j WHERE rt <= 8 WINDOW w AS (PARTITION BY vec_id)),
    a AS (SELECT vec_id, 4 * sum(exp(ls) * (ls - lt)) AS rev FROM r GROUP BY vec_id), b AS (SELECT vec_id, 4 * sum(exp(lt) * (lt - ls)) AS fwd FROM f GROUP BY vec_id)
    SELECT vec_id % 5 AS batch, round(avg(rev), 6) AS reverse_kl, round(avg(fwd), 6) AS forward_kl, count(*) AS positions FROM a JOIN b USING (vec_id) WHERE vec_id % 3 > 0 GROUP BY 1"""
)
def math_08_top_k_losses(t: Tables) -> DataFrame:
    """Masked means of the sparse distillation losses, each vector against the next."""
    a = t.embeddings.select("vec_id", F.col("embedding").alias("x"))
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    rows = a.join(b, "vec_id").select("vec_id", *[scores.top_k_divergence("x", "y", 8, forward, 2.0).alias(n) for n, forward in (("r", False), ("f", True))])
    kept = F.col("vec_id") % 3 > 0
    out = rows.groupBy((F.col("vec_id") % 5).alias("batch")).agg(F.avg(F.when(kept, F.col("r"))).alias("r"), F.avg(F.when(kept, F.col("f"))).alias("f"), F.count_if(kept).alias("positions"))
    return out.select("batch", F.round("r", 6).alias("reverse_kl"), F.round("f", 6).alias("forward_kl"), "positions")


@query(
    """WITH k AS (SELECT doc_id, n_chars AS n, unnest(range(0, 40)) AS k FROM documents), e AS (SELECT doc_id, n, 25 + 25 * ((2 ^ k)::BIGINT - 1) AS e FROM k),
    f AS (SELECT doc_id, e FROM e WHERE e + 3 <= n UNION SELECT doc_id, n_chars FROM documents WHERE n_chars > 0)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY e) - 1 AS chunk, e::BIGINT AS chunk_end FROM f"""
)
def str_06_exponential_hops(t: Tables) -> DataFrame:
    """Chunks of a stream of as many tokens as a document has characters."""
    rows = t.documents.select("doc_id", F.posexplode(scores.chunk_ends("n_chars", 25, 3, 25)).alias("chunk", "chunk_end"))
    return rows.withColumn("chunk", F.col("chunk").cast("long"))


# -- streams of a reader


@query("SELECT doc_id, n_chars FROM documents")
def win_10_buffered_shuffle(t: Tables) -> DataFrame:
    """A shuffle through a buffer of 200 rows: other order, the same rows."""
    rows = t.documents.select("doc_id", "n_chars")
    return rows.mapInPandas(lambda batches: windows.buffered_shuffle(batches, 200, 11), rows.schema)


@query(
    """WITH RECURSIVE r AS (SELECT doc_id, doc_id % 16 AS reader, (n_chars % 4000)::BIGINT AS len, row_number() OVER (PARTITION BY doc_id % 16 ORDER BY doc_id) AS i FROM documents),
    f AS (SELECT reader, i, doc_id, 0::BIGINT AS batch, len AS longest, 1 AS held FROM r WHERE i = 1
          UNION ALL SELECT r.reader, r.i, r.doc_id, f.batch + CASE WHEN greatest(f.longest, r.len) * 4 * (f.held + 1) > 24000 THEN 1 ELSE 0 END,
                 CASE WHEN greatest(f.longest, r.len) * 4 * (f.held + 1) > 24000 THEN r.len ELSE greatest(f.longest, r.len) END,
                 CASE WHEN greatest(f.longest, r.len) * 4 * (f.held + 1) > 24000 THEN 1 ELSE f.held + 1 END
          FROM f JOIN r ON r.reader = f.reader AND r.i = f.i + 1)
    SELECT doc_id, reader, batch FROM f"""
)
def win_12_dynamic_batch(t: Tables) -> DataFrame:
    """Greedy padded batches over each reader's stream, the longest carried along."""
    rows = t.documents.select("doc_id", F.pmod("doc_id", F.lit(16)).alias("reader"), F.pmod("n_chars", F.lit(4000)).alias("len"))
    return windows.padded_batches(rows, "reader", ["doc_id"], "len", 24_000).select("doc_id", "reader", "batch")
