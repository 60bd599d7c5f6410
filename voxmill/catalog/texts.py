"""Text normalization, JSON fields, dialogue parsing and chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import digits, json_fields, text
from ..streaming import chunker
from .registry import Tables, query


@query("SELECT c_custkey, translate(c_custkey::VARCHAR, '0123456789', '零幺二三四五六七八九') AS phone, translate(c_custkey::VARCHAR, '0123456789', '零一二三四五六七八九') AS plain FROM customer")
def strf_01_read_digits(t: Tables) -> DataFrame:
    n = F.col("c_custkey").cast("string")
    return t.customer.select("c_custkey", digits.read_digits(n, phone=True).alias("phone"), digits.read_digits(n).alias("plain"))


@query()
def strf_02_09_customer_service_numbers(t: Tables) -> DataFrame:
    """All rule families over sentences made from keys; RE2 has no lookbehind, so the tests hold the goldens."""
    key = F.lpad(F.col("c_custkey").cast("string"), 4, "1")
    made = F.array(
        F.concat(F.lit("手机尾号 "), key), F.concat(F.lit("验证码是 "), key), F.concat(key, F.lit("M的带宽")), F.concat(F.lit("请按 "), F.substring(key, 1, 1), F.lit(" 号键")),
        F.concat(F.lit("订单号 "), key, key), F.concat(F.lit("拨打 10086 或 400-123-"), key), F.concat(F.lit("分机 "), key),
    )
    # keys are few bytes a row, so a file of millions is one task unless they are spread
    rows = t.customer.select("c_custkey").repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    return rows.select("c_custkey", F.posexplode(made).alias("rule", "sentence")).select("c_custkey", "rule", "sentence", digits.read_customer_service_numbers("sentence").alias("reading"))


@query("SELECT doc_id, regexp_matches(text || CASE WHEN doc_id % 2 = 0 THEN '中' ELSE '' END, '[\\x{4e00}-\\x{9fff}]') AS chinese FROM documents")
def strf_10_contains_chinese(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.contains_chinese(F.concat("text", F.when(F.col("doc_id") % 2 == 0, "中").otherwise(""))).alias("chinese"))


@query("SELECT item_id, translate(replace(replace('（' || text || '】 m² “x” ', '²', '平方'), '——', ' '), '（）【】`“”', '') AS plain FROM benchmark")
def strf_11_plain_symbols(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", text.plain_symbols(F.concat(F.lit("（"), "text", F.lit("】 m² “x” "))).alias("plain"))


@query()
def strf_12_spell_numbers(t: Tables) -> DataFrame:
    """Numbers in English words; tested against goldens."""
    return t.part.select("p_partkey", text.spell_numbers(F.concat(F.lit("part "), F.col("p_partkey").cast("string"), F.lit(" of "), F.col("p_size").cast("string"))).alias("spelled"))


@query("SELECT p_partkey, '中文' || p_size || ' ok' AS text FROM part")
def strf_13_blanks_between_ascii(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.blanks_between_ascii(F.concat(F.lit(" 中 文 "), F.col("p_size").cast("string"), F.lit(" ok "))).alias("text"))


@query()
def strf_14_paragraph_split(t: Tables) -> DataFrame:
    pieces = text.split_paragraph("text", lang="en")
    return t.documents.select("doc_id", F.posexplode(pieces).alias("place", "piece"))


@query()
def strf_15_normalize(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.posexplode(text.normalize(F.concat(F.lit("<|spk_3|>"), "text"))).alias("place", "piece"))


@query("SELECT item_id, regexp_replace(regexp_replace(text, '(.)([，,、])', '\\1#2\\2', 'g'), '(.)([。！？!?；;])', '\\1#3\\2', 'g') AS marked FROM benchmark WHERE NOT regexp_matches(text, '[，,、。！？!?；;]{2}') AND NOT regexp_matches(text, '\\n[，,、。！？!?；;]')")
def strf_16_pause_marks(t: Tables) -> DataFrame:
    rows = t.benchmark.filter(~F.col("text").rlike("[，,、。！？!?；;]{2}") & ~F.col("text").rlike("\n[，,、。！？!?；;]"))
    return rows.select("item_id", text.pause_marks(text.pause_marks("text")).alias("marked"))


@query()
def strf_17_strf_18_emphasis(t: Tables) -> DataFrame:
    """Lexicon emphasis on the fourth field of a piped line; tested against a brute-force version."""
    line = F.concat_ws("|", F.col("item_id").cast("string"), F.lit("p"), F.lit("w"), "text")
    fields = F.split(line, r"\|", 4)
    marked = F.concat_ws("|", F.slice(fields, 1, 3), text.emphasize(F.get(fields, F.lit(3)), ["the", "tion", "and"]))
    return t.benchmark.select("item_id", F.when(F.size(fields) >= 4, marked).otherwise(line).alias("line"))


@query("SELECT doc_id, CASE WHEN regexp_matches(b, '[A-Za-z]') THEN upper(b) ELSE b END AS norm FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '<[^<>]*>', '', 'g'), '[\\p{P}\\p{S}\\s]', '', 'g') AS b FROM documents WHERE lang = 'en' AND NOT contains(text, 'ß'))")
def strf_19_evaluation_text(t: Tables) -> DataFrame:
    return t.documents.filter("lang = 'en' and not contains(text, 'ß')").select("doc_id", text.evaluation_text("text").alias("norm"))


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, role, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM conversations")
def strf_20_dialogue_turns(t: Tables) -> DataFrame:
    line = F.concat(F.col("role"), F.lit("："), F.col("text"))
    cells = t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("cell"))
    turns = cells.select("conv_id", F.posexplode(text.dialogue_turns("cell", ["user", "assistant", "system", "tool"])).alias("place", "t"))
    return turns.select("conv_id", F.col("place").cast("long"), "t.role", "t.text")


@query("SELECT o_orderkey, o_custkey + 7 AS total, '<|s_' || o_custkey || '|><|s_7|>' AS code FROM orders")
def strf_21_speech_ids(t: Tables) -> DataFrame:
    code = text.speech_text(F.array(F.col("o_custkey"), F.lit(7).cast("long")))
    return t.orders.select("o_orderkey", code.alias("code")).withColumn("total", F.aggregate(text.speech_ids("code"), F.lit(0).cast("long"), lambda s, x: s + x))


@query("SELECT item_id, text AS bare FROM benchmark")
def strf_22_strip_tags(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", text.strip_speaker_tags(F.concat(F.lit("<|spk_1|>"), "text", F.lit("<|spk_22|>"))).alias("bare"))


@query("SELECT doc_id, translate(text, chr(9) || chr(13) || chr(10), '   ') AS line FROM documents")
def strf_23_one_line(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.one_line("text").alias("line"))


@query("SELECT a.p_partkey, levenshtein(a.p_name, b.p_name) AS distance FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def strf_24_edit_distance(t: Tables) -> DataFrame:
    other = t.part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return t.part.join(other, "p_partkey").select("p_partkey", F.levenshtein("p_name", "other").cast("long").alias("distance"))


@query("SELECT page_id, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') AS stem FROM pages")
def strf_26_path_stem(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.stem("url").alias("stem"))


@query("SELECT event_id, '{\"k\": ' || (props->>'$.k') || '}' AS object, TRY_CAST(props->>'$.k' AS INT) AS k FROM events")
def json_01_embedded_object(t: Tables) -> DataFrame:
    noisy = F.concat(F.lit("```json\n"), "props", F.lit("\n``` done"))
    found = json_fields.embedded_object(noisy)
    return t.events.select("event_id", F.regexp_replace(found, r"^\{\s*\"k\":\s*", '{"k": ').alias("object"), json_fields.field(found, "k").try_cast("int").alias("k"))


@query(
    """WITH v AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'yes' WHEN 1 THEN '是' WHEN 2 THEN '12' ELSE 'x' END AS s FROM events)
    SELECT event_id, s IN ('yes', '是') AS flag, TRY_CAST(s AS INT) AS n FROM v"""
)
def json_02_tolerant_casts(t: Tables) -> DataFrame:
    k = F.col("event_id") % 4
    s = F.when(k == 0, "yes").when(k == 1, "是").when(k == 2, "12").otherwise("x")
    return t.events.select("event_id", json_fields.truth(s).alias("flag"), json_fields.whole(s).alias("n"))


@query(
    """SELECT event_id, CASE WHEN event_type = 'view' THEN 'bad_winner' WHEN event_id % 2 = 0 THEN 'same_winner_and_loser' WHEN event_id % 9 > 5 THEN 'bad_margin' WHEN event_id % 7 NOT BETWEEN 1 AND 5 THEN 'bad_confidence' END AS reason FROM events"""
)
def json_03_judge_checks(t: Tables) -> DataFrame:
    e = F.col("event_id")
    winner = F.when(F.col("event_type") == "view", "C").otherwise("A")
    loser = F.when(e % 2 == 0, winner).otherwise("B")
    loser = F.when(F.col("event_type") == "view", "B").otherwise(loser)
    return t.events.select("event_id", json_fields.pair_result_reason(winner, loser, e % 9, e % 7).alias("reason"))


@query("SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN event_id + event_id % 10 END AS total FROM events")
def json_04_stringified_list(t: Tables) -> DataFrame:
    e = F.col("event_id")
    s = F.when(e % 3 == 0, F.concat(F.lit("("), e.cast("string"), F.lit(",)"))).otherwise(F.concat(F.lit("["), e.cast("string"), F.lit(" , "), (e % 10).cast("string"), F.lit("]")))
    return t.events.select("event_id", F.aggregate(json_fields.int_list(s), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query()
def str_01_str_02_stream_chunks(t: Tables) -> DataFrame:
    """Chunks of every turn fed a character at a time; the same state machine runs over streams."""
    short = t.conversations.filter("length(text) < 600")
    return short.select("conv_id", "turn", F.posexplode(chunker.chunk_texts("text", least=3, most=8)).alias("place", "chunk"))


@query()
def str_03_sentence_split(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(text.split_sentences("text")).alias("place", "sentence"))


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def extra_tumbling_window(t: Tables) -> DataFrame:
    """Beyond the survey's operators: event-time windows over a batch."""
    w = F.window(F.col("ts").cast("timestamp"), "1 hour")
    return t.events.groupBy("event_type", w.alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.col("w.start").cast("timestamp_ntz").alias("hour"), "n", "total")
