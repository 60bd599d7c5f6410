"""Readers. Each returns a DataFrame; those of line files add ``file`` and ``line_no``."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.json_fields import first_present, int_list
from ..operators.windows import hash_order, latest, numbered
from ..storage import fixed


def plain_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(file, value) of every line; files are split, so one of any size is read in parallel."""
    text = spark.read.option("lineSep", "\n").text(list(paths) if not isinstance(paths, str) else paths)
    return text.select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r"\r$", "").alias("value"))


def lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(file, line_no, value). Lines are numbered in their split, and a split starts where the ones before it end.

    The sizes of the splits are one small row each; no file is ever in one task.
    """
    text = spark.read.option("lineSep", "\n").text(list(paths) if not isinstance(paths, str) else paths)
    split = text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__id"), F.regexp_replace("value", r"\r$", "").alias("value")
    )
    sizes = split.groupBy("file", "__start").agg(F.count("*").alias("__n"), F.min("__id").alias("__low"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("file").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("file", "__start", (before - F.col("__low") + 1).alias("__o"))
    return split.join(offsets, ["file", "__start"]).select("file", (F.col("__id") + F.col("__o")).cast("int").alias("line_no"), "value")


def path_list(spark: SparkSession, path: str) -> list[str]:
    """The paths that a list file names, one a line, stripped; blank lines are kept as empty paths."""
    return [r["value"].strip() for r in lines(spark, path).orderBy("file", "line_no").select("value").collect()]


def listed(spark: SparkSession, path: str, fmt: str = "parquet", schema=None, **options) -> DataFrame:
    """All shards of a list file. Unreadable files are skipped as the option says."""
    paths = [p for p in path_list(spark, path) if p]
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(paths)


def _qualified(spark: SparkSession, path: str) -> str:
    """A path as file metadata has it, but for the slashes behind the scheme."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return re.sub(r"^([a-z0-9]+):/+", r"\1:/", p.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(p).toUri().toString())


def json_dicts(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(key, value) of many one-object JSON files; the later file in ``paths`` wins, by its whole path."""
    last = {_qualified(spark, p): i for i, p in enumerate(paths)}
    order = F.create_map(*[x for p, i in last.items() for x in (F.lit(p), F.lit(i))])
    name = F.regexp_replace(F.col("_metadata.file_path"), r"^([a-z0-9]+):/+", "$1:/")
    text = spark.read.text(list(paths), wholetext=True).select(name.alias("name"), "value")
    pairs = text.select(order[F.col("name")].alias("seq"), F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))
    return latest(pairs, ["key"], [F.col("seq")]).select("key", "value")


ALIASES = {"utt": ("key", "utt"), "text": ("txt", "text"), "tokens": ("code", "speech_token"), "prompt_tokens": ("prompt_code", "prompt_speech_token"), "reject_tokens": ("reject_code", "reject_speech_token")}


def sample_lines(raw: DataFrame, value: str = "value") -> DataFrame:
    """Samples from JSON lines with aliases and token lists that may be text; ``reason`` marks bad rows.

    A bad row is quarantined by itself; the rows behind it in its file are not affected.
    """
    v = F.col(value)
    is_object = F.json_object_keys(v).isNotNull()
    fields = {name: first_present(v, *keys) for name, keys in ALIASES.items()}
    lists = ("tokens", "prompt_tokens", "reject_tokens")
    parsed = [int_list(fields[name]).alias(name) if name in lists else fields[name].alias(name) for name in fields]
    bad = F.when(~F.coalesce(is_object, F.lit(False)), "malformed_json")
    for name in lists:
        bad = bad.when(fields[name].isNotNull() & int_list(fields[name]).isNull(), f"bad_{name}")
    return raw.select("*", *parsed, F.get_json_object(v, "$.duration").try_cast("double").alias("duration"), bad.alias("reason"))


def policy(df: DataFrame, mode: str, reason: str = "reason") -> DataFrame:
    """Bad records: ``skip`` drops them, ``fail`` raises on the first, ``keep`` leaves them marked."""
    if mode == "skip":
        return df.filter(F.col(reason).isNull())
    if mode == "fail":
        return df.filter(F.coalesce(F.assert_true(F.col(reason).isNull(), F.concat(F.lit("bad record: "), F.col(reason))).isNull(), F.lit(True)))
    return df


def quarantine(df: DataFrame, reason: str = "reason") -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows)."""
    return df.filter(F.col(reason).isNull()).drop(reason), df.filter(F.col(reason).isNotNull())


def with_texts(samples: DataFrame, texts: DataFrame, key: str = "utt") -> DataFrame:
    """Inference fan-out: a row for each of the texts listed for an utterance; none listed, no row."""
    listed_texts = texts.select(key, F.posexplode("texts").alias("tts_index", "tts_text"))
    return samples.join(listed_texts, key)


def piped_manifest(raw: DataFrame, order: Sequence[Column], shard: int = 0, shards: int = 1, existing: DataFrame | None = None) -> DataFrame:
    """``id|prompt_text|prompt_wav|tts_text[|caption]``; the shard counts valid rows only."""
    parts = F.split("value", r"\|")
    rows = raw.filter(F.size(parts) >= 4).select("*", *[F.trim(F.get(parts, F.lit(i))).alias(n) for i, n in enumerate(("id", "prompt_text", "prompt_wav", "tts_text", "caption"))])
    if existing is not None:
        rows = rows.join(existing, rows["prompt_wav"] == existing["path"], "left_semi")
    if shards == 1:
        return rows
    return numbered(rows, order, "__i").filter(F.pmod(F.col("__i") - 1, F.lit(shards)) == shard).drop("__i")


def keyed_tsv(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A TSV with header, one row a key, the last one winning; the key column must be there.

    A folder's files are read in the order of their names, each with the header.
    """
    raw = lines(spark, path)
    head = raw.filter("line_no = 1").orderBy("file").select(F.split("value", "\t").alias("h")).first()
    names = list(head["h"]) if head else []
    if key not in names:
        raise ValueError(f"{path} has no column {key}")
    parts = F.split("value", "\t")
    rows = raw.filter("line_no > 1 and value <> ''").select("file", "line_no", *[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])
    return latest(rows, [key], [F.col("file"), F.col("line_no")]).drop("file", "line_no")


def keyed_lines(raw: DataFrame) -> DataFrame:
    """(key, rest) of ``key word word ...`` lines, words parted by one blank."""
    v = F.trim(F.regexp_replace("value", r"\s+", " "))
    return raw.filter(v != "").select(F.split_part(v, F.lit(" "), F.lit(1)).alias("key"), F.trim(F.regexp_replace(v, r"^\S+ ?", "")).alias("rest"))


def excel(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """One sheet as text columns, rows without any value left out; needs openpyxl."""
    import pandas as pd

    frame = pd.read_excel(path, sheet_name=sheet, dtype=str).dropna(how="all")
    return spark.createDataFrame(frame.astype(object).where(frame.notna(), None).rename(columns=str))


def files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path) of all files below a folder; the contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path")


def path_tree(listing: DataFrame, root: str, names: Sequence[str]) -> DataFrame:
    """Folder names below ``root`` as columns; files that lie less deep are left out."""
    below = F.split(F.regexp_replace("path", rf"^.*?{root.strip('/')}/", ""), "/")
    return listing.filter(F.size(below) >= len(names)).select("path", *[F.get(below, F.lit(i)).alias(n) for i, n in enumerate(names)])


def dimensions(df: DataFrame, path: str, pattern: str, names: Sequence[str]) -> DataFrame:
    """Columns from the groups of a pattern on the file's path."""
    return df.select("*", *[F.regexp_extract(path, pattern, i + 1).alias(n) for i, n in enumerate(names)])


def utterances_from_listing(audio: DataFrame, text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(utt, path, text_path, spk) of audio with a text file of the same stem, and audio without."""
    stem = F.regexp_extract("path", r"([^/]*?)\.[^./]*$", 1)
    a = audio.select(stem.alias("utt"), F.col("path"))
    b = text.select(F.regexp_extract("path", r"([^/]*?)\.[^./]*(?:\.[^./]*)?$", 1).alias("utt"), F.col("path").alias("text_path"))
    paired = a.join(b, "utt").withColumn("spk", F.split_part("utt", F.lit("_"), F.lit(1)))
    return paired, a.join(b.select("utt"), "utt", "left_anti")


def is_grouped(df: DataFrame) -> bool:
    """True where rows are groups already, with an array ``items``."""
    return "items" in df.columns and df.schema["items"].dataType.typeName() == "array"


def grouped_files(raw: DataFrame) -> DataFrame:
    """(file, grouped) from (file, line_no, value): whether a file's first non-blank line is an object with an array ``items``."""
    first = raw.filter(F.trim("value") != "").groupBy("file").agg(F.min_by("value", "line_no").alias("v"))
    items = F.trim(F.get_json_object("v", "$.items"))
    return first.select("file", F.coalesce(items.startswith("[") & F.from_json(items, "array<string>").isNotNull(), F.lit(False)).alias("grouped"))


SUFFIXES = (".jsonl", ".json", ".txt", ".list", ".lst")


def record_files(listing: DataFrame, entry: Column, suffixes: Sequence[str] = SUFFIXES, most: int = 0) -> DataFrame:
    """(entry, path) of the files with one of the suffixes, in any case; the first ``most`` by path of each entry, 0 for all."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    rows = listing.select(entry.alias("entry"), "path").filter(suffix.isin(*suffixes))
    if not most:
        return rows
    return rows.withColumn("__i", F.row_number().over(Window.partitionBy("entry").orderBy("path"))).filter(F.col("__i") <= most).drop("__i")


NOISE_TAGS = ("[FIL]", "[SPK]")


def transcripts(raw: DataFrame, root: str, existing: DataFrame | None = None, tags: Sequence[str] = NOISE_TAGS) -> DataFrame:
    """(utt, wav, spk, text) of ``wav<TAB>spk<TAB>content`` lines below a header; of an utterance the last line counts.

    Noise tags go from the text. With ``existing`` (path), only files that are there count.
    """
    parts = F.split("value", "\t")
    wav, spk, text = (F.trim(F.get(parts, F.lit(i))) for i in range(3))
    for tag in tags:
        text = F.replace(text, F.lit(tag), F.lit(""))
    rows = raw.filter((F.col("line_no") > 1) & (F.size(parts) == 3)).select(
        F.replace(F.regexp_extract(wav, r"([^/]*)$", 1), F.lit(".wav"), F.lit("")).alias("utt"), F.concat_ws("/", F.lit(root.rstrip("/")), spk, wav).alias("wav"), spk.alias("spk"), text.alias("text"), "file", "line_no"
    )
    if existing is not None:
        rows = rows.join(existing, rows["wav"] == existing["path"], "left_semi")
    return latest(rows, ["utt"], [F.col("file"), F.col("line_no")]).drop("file", "line_no")


def shard_for(df: DataFrame, order: Sequence[Column], rank: int, world: int) -> DataFrame:
    """Rows of one of ``world`` readers, striding through the order."""
    return numbered(df, order, "__i").filter(F.pmod(F.col("__i") - 1, F.lit(world)) == rank).drop("__i")


def _stride(df: DataFrame, place: str, n: Column, rank: int, world: int) -> DataFrame:
    """Rows by zero-based place, repeated round and round where there are fewer than ``world``; every ``world``-th from ``rank`` on, numbered anew."""
    tiled = df.withColumn(place, F.explode(F.sequence(F.col(place), F.greatest(n, F.lit(world)).cast("long") - 1, n)))
    return tiled.filter(F.pmod(F.col(place), F.lit(world)) == rank).withColumn(place, F.floor(F.col(place) / world).cast("long"))


def assign_shards(shards: DataFrame, key: Column, rank: int, world: int, worker: int = 0, workers: int = 1, epoch: int = 0, shuffle: bool = True, partition: bool = True) -> DataFrame:
    """The shards that a worker of a rank reads, with their order in ``place``.

    All are shuffled by the epoch and strided over the ranks, then over the workers of a rank. Where
    there are fewer shards than readers they are handed out again, so that no reader is empty.
    """
    order = [hash_order(key, epoch), key] if partition and shuffle else [key]
    rows = numbered(shards, order, "place").withColumn("place", F.col("place") - 1)
    if partition:
        rows = _stride(rows.crossJoin(shards.agg(F.count("*").alias("__n"))), "place", F.col("__n"), rank, world).drop("__n")
    mine = fixed(rows)
    return _stride(mine.crossJoin(mine.agg(F.count("*").alias("__n"))), "place", F.col("__n"), worker, workers).drop("__n")
