"""Grouping, deduplication, batching and sampling of candidate rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.text import fingerprint
from ..operators import aggregates, filters, projections, sampling, windows
from ..plans import pipeline, prepare
from ..sources import readers
from ..streaming import incremental
from .registry import Tables, query

# Documents as utterances: ten rows a group, every ninth without a suffix.
UTT_SQL = "CASE WHEN doc_id % 9 = 0 THEN 'g' || (doc_id // 10) ELSE 'g' || (doc_id // 10) || '_' || lpad((doc_id % 10)::VARCHAR, 3, '0') END"
BASE_SQL = f"""base AS (SELECT doc_id, text, lang, source, n_chars, {UTT_SQL} AS utt FROM documents),
    named AS (SELECT *, CASE WHEN regexp_matches(utt, '_[0-9]{{3}}$') THEN regexp_extract(utt, '^(.*)_([0-9]{{3}})$', 1) ELSE utt END AS group_id,
              CASE WHEN regexp_matches(utt, '_[0-9]{{3}}$') THEN regexp_extract(utt, '^(.*)_([0-9]{{3}})$', 2)::INT ELSE -1 END AS suffix_idx FROM base)"""


def _utt() -> Column:
    return F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("g"), F.floor(F.col("doc_id") / 10).cast("string"))).otherwise(
        F.concat(F.lit("g"), F.floor(F.col("doc_id") / 10).cast("string"), F.lit("_"), F.lpad((F.col("doc_id") % 10).cast("string"), 3, "0"))
    )


def utterances(t: Tables) -> DataFrame:
    return t.documents.withColumn("utt", _utt())


def named(t: Tables) -> DataFrame:
    return utterances(t).withColumn("group_id", projections.group_of(F.col("utt"))).withColumn("suffix_idx", projections.suffix_of(F.col("utt")))


@query(
    f"""WITH {BASE_SQL},
    sized AS (SELECT *, count(*) OVER (PARTITION BY group_id) AS n FROM named),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY CASE WHEN suffix_idx < 0 THEN 1000000000 ELSE suffix_idx END, utt, doc_id) - 1 AS group_rank FROM sized WHERE n >= 2),
    kept AS (SELECT *, row_number() OVER (PARTITION BY group_id, md5(text) ORDER BY doc_id) AS f FROM ranked),
    again AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY suffix_idx, group_rank, utt, doc_id) - 1 AS new_rank, count(*) OVER (PARTITION BY group_id) AS group_size FROM kept WHERE f = 1)
    SELECT group_id, group_size, new_rank, doc_id, utt FROM again"""
)
def ops_01_prepare_groups(t: Tables) -> DataFrame:
    """Group, drop repeats, regroup; the items flattened with their new rank."""
    groups = prepare.prepare(utterances(t), "utt", "doc_id", F.md5("text"), ["doc_id", "utt"], least=2)
    return groups.select("group_id", "group_size", F.posexplode("items").alias("new_rank", "i")).select("group_id", "group_size", F.col("new_rank").cast("long"), "i.doc_id", "i.utt")


@query(
    f"""WITH {BASE_SQL},
    o AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY CASE WHEN suffix_idx < 0 THEN 1000000000 ELSE suffix_idx END, utt, doc_id) - 1 AS r, count(*) OVER (PARTITION BY group_id) AS group_size FROM named)
    SELECT group_id, r AS place, doc_id, group_size FROM o"""
)
def agg_01_group_items(t: Tables) -> DataFrame:
    order = [aggregates.suffix_order("suffix_idx"), F.col("utt"), F.col("doc_id")]
    groups = aggregates.group_items(named(t), "group_id", order, ["doc_id", "utt"])
    return groups.select("group_id", "group_size", F.posexplode("items").alias("place", "i")).select("group_id", F.col("place").cast("long"), "i.doc_id", "group_size")


@query(
    """WITH v AS (SELECT user_id, event_type, count(*) AS c, min(event_id) AS f FROM events GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, f) AS rn, count(*) OVER (PARTITION BY user_id) AS u, sum(c) OVER (PARTITION BY user_id) AS n FROM v)
    SELECT user_id, u AS unique_count, event_type AS majority, c AS majority_count, round(c / n, 6) AS majority_ratio FROM r WHERE rn = 1"""
)
def agg_02_majority_value(t: Tables) -> DataFrame:
    return aggregates.majority(t.events, "user_id", "event_type", [F.col("event_id")]).withColumn("majority_ratio", F.round("majority_ratio", 6))


@query("SELECT group_size, count(*) AS groups FROM (SELECT source, lang, count(*) AS group_size FROM documents GROUP BY ALL) GROUP BY group_size")
def agg_03_group_size_distribution(t: Tables) -> DataFrame:
    return aggregates.size_distribution(t.documents, "source", "lang")


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY source, md5(text) ORDER BY doc_id) = 1 AS k FROM documents),
    g AS (SELECT source, count(*) AS i, count(*) FILTER (k) AS o FROM r GROUP BY source)
    SELECT sum(i)::BIGINT AS total_in, sum(o)::BIGINT AS total_out, sum(i - o)::BIGINT AS removed, round(sum(i - o) / sum(i), 6) AS removed_ratio,
           count(*) AS groups, count(*) FILTER (i > o) AS groups_reduced, max(i - o) AS max_removed FROM g"""
)
def agg_05_dedup_statistics(t: Tables) -> DataFrame:
    first = F.row_number().over(Window.partitionBy("source", F.md5("text")).orderBy("doc_id")) == 1
    return aggregates.dedup_statistics(t.documents.withColumn("k", first), "source", F.col("k")).withColumn("removed_ratio", F.round("removed_ratio", 6))


@query("SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE n BETWEEN 3 AND 5")
def flt_03_group_size_range(t: Tables) -> DataFrame:
    return filters.sized_groups(t.conversations, "conv_id", 3, 5).select("conv_id", "turn", "text")


@query(
    """WITH t AS (SELECT doc_id, text, len(string_split(text, ' ')) AS n FROM documents)
    SELECT doc_id, n AS tokens FROM t WHERE n * 4 BETWEEN 400 AND 6000 AND n BETWEEN 1 AND 1000 AND n / (n * 4.0) BETWEEN 0.0005 AND 1"""
)
def flt_01_length_ratio(t: Tables) -> DataFrame:
    n = F.size(F.split("text", " "))
    return t.documents.select("doc_id", n.cast("long").alias("tokens")).filter(filters.length_ok(filters.frames(F.col("tokens")), F.col("tokens"), 6000, 400, 1000))


@query("SELECT doc_id, source FROM documents WHERE NOT starts_with(coalesce(source, ''), 'src1')")
def flt_02_prefix_exclusion(t: Tables) -> DataFrame:
    return t.documents.filter(filters.not_prefixed(F.col("source"), "src1")).select("doc_id", "source")


@query(
    """WITH g AS (SELECT conv_id, count(*) AS n, count(DISTINCT text) AS d, count(*) FILTER (text IS NULL) AS z FROM conversations GROUP BY conv_id)
    SELECT conv_id, CASE WHEN n <> 4 THEN 'wrong_size' WHEN z > 0 THEN 'missing_token' WHEN d <> 4 THEN 'repeated_token' END AS reason FROM g"""
)
def flt_04_unique_token_groups(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", F.split("text", " ").alias("token"))
    groups = aggregates.group_items(rows, "conv_id", [F.col("turn")], ["token"])
    return groups.select("conv_id", filters.unique_token_group(F.col("items"), "token", 4).alias("reason"))


@query(
    """SELECT doc_id, CASE WHEN n_chars < 50 THEN 'short_text' ELSE '' END || CASE WHEN q IS NULL THEN '|unlabelled' ELSE '' END || CASE WHEN x = 1 THEN '|toxic' ELSE '' END AS errors
    FROM (SELECT d.doc_id, n_chars, l.quality AS q, l.toxic AS x FROM documents d LEFT JOIN labels l USING (doc_id))"""
)
def flt_07_record_validation(t: Tables) -> DataFrame:
    from ..functions.json_fields import all_failures

    rows = t.documents.join(t.labels, "doc_id", "left")
    errors = all_failures((F.col("n_chars") >= 50, "short_text"), (F.col("quality").isNotNull(), "|unlabelled"), (F.coalesce(F.col("toxic"), F.lit(0)) != 1, "|toxic"))
    return rows.select("doc_id", F.concat_ws("", errors).alias("errors"))


@query("SELECT doc_id, n_chars FROM documents WHERE length(text) <= 400 ORDER BY doc_id LIMIT 25")
def flt_09_short_rows(t: Tables) -> DataFrame:
    return filters.short_rows(t.documents, "text", 400, [F.col("doc_id")], 25).select("doc_id", "n_chars")


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ar') OR contains(p_brand, '13')")
def flt_11_substring_search(t: Tables) -> DataFrame:
    return filters.search(t.part, "ar", "p_name").select("p_partkey", "p_name").unionByName(filters.search(t.part, "13", "p_brand").filter(~F.col("p_name").contains("ar")).select("p_partkey", "p_name"))


@query(
    """SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM conversations)
    WHERE NOT regexp_full_match(word, '[\\p{P}\\p{S}]*') GROUP BY word HAVING count(*) > 3"""
)
def flt_12_punctuation_only(t: Tables) -> DataFrame:
    from ..functions.text import only_punctuation

    words = t.conversations.select(F.explode(F.split("text", " ")).alias("word"))
    return words.filter(~only_punctuation("word")).groupBy("word").agg(F.count("*").alias("n")).filter("n > 3")


@query("SELECT event_type, count(*) AS n FROM events WHERE (contains(event_type, 'c') OR contains(event_type, 'v')) AND NOT contains(event_type, 'u') GROUP BY event_type")
def flt_08_tag_selection(t: Tables) -> DataFrame:
    return t.events.filter(filters.tag_selected(F.col("event_type"), ["c", "v"], ["u"])).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT p AS missing FROM (VALUES ('click'), ('no such tag'), ('zzz')) v(p) WHERE NOT EXISTS (SELECT 1 FROM events WHERE contains(event_type, p))")
def flt_08_missing_patterns(t: Tables) -> DataFrame:
    return filters.missing_patterns(t.events, "event_type", ["click", "no such tag", "zzz"])


@query("SELECT event_id, value FROM events WHERE value / 10 <= 30")
def flt_14_duration_limit(t: Tables) -> DataFrame:
    return t.events.filter(filters.within_duration(F.col("value") / 10)).select("event_id", "value")


@query(f"WITH {BASE_SQL} SELECT doc_id, group_id, suffix_idx FROM named")
def prj_04_split_utterance_id(t: Tables) -> DataFrame:
    return named(t).select("doc_id", "group_id", "suffix_idx")


@query(f"WITH {BASE_SQL} SELECT doc_id, CASE WHEN suffix_idx >= 0 THEN 'v' || lpad(suffix_idx::VARCHAR, 3, '0') ELSE 'v-01' END AS version FROM named")
def prj_05_version_id(t: Tables) -> DataFrame:
    return named(t).select("doc_id", projections.version_id(F.col("suffix_idx"), F.col("utt")).alias("version"))


@query("SELECT conv_id, turn, CASE WHEN starts_with(text, '<|spk_') THEN trim(text) ELSE '<|spk_7|>' || trim(text) END AS tagged FROM conversations")
def prj_06_speaker_tag(t: Tables) -> DataFrame:
    from ..functions.text import with_speaker_tag

    return t.conversations.select("conv_id", "turn", with_speaker_tag("text", "<|spk_7|>").alias("tagged"))


@query("SELECT c_custkey, CASE WHEN starts_with(c_mktsegment, 'BUILD') THEN 'baseline' WHEN starts_with(c_mktsegment, 'A') THEN 'candidate' ELSE 'other' END AS role FROM customer")
def prj_07_role_by_prefix(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", projections.role_of(F.col("c_mktsegment"), "BUILD", "A").alias("role"))


@query(
    """WITH u AS (SELECT conv_id, min(turn) AS turn, min_by(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id),
    a AS (SELECT conv_id, min_by(text, turn) AS answer FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
    SELECT conv_id AS idx, 'conversations' AS data_source, 'user' AS role_0, question AS content_0, 'assistant' AS role_1, answer AS content_1 FROM u JOIN a USING (conv_id)"""
)
def prj_01_chat_record(t: Tables) -> DataFrame:
    first = lambda role, name: t.conversations.filter(F.col("role") == role).groupBy("conv_id").agg(F.min_by("text", "turn").alias(name))
    rows = first("user", "question").join(first("assistant", "answer"), "conv_id")
    r = rows.select(projections.chat_record(F.col("conv_id"), F.col("question"), F.col("answer"), "conversations").alias("r"))
    p = lambda i, f: F.get("r.prompt", F.lit(i))[f]
    return r.select(F.col("r.extra.index").alias("idx"), "r.data_source", p(0, "role").alias("role_0"), p(0, "content").alias("content_0"), p(1, "role").alias("role_1"), p(1, "content").alias("content_1"))


@query(
    """WITH p AS (SELECT a.doc_id, string_split(a.text, ' ') AS c, string_split(b.text, ' ') AS r, a.source AS utt, a.text AS txt
        FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id + 1)
    SELECT doc_id, CASE WHEN c IS NULL OR r IS NULL THEN 'bad_token_type' WHEN len(c) < 40 OR len(r) < 40 THEN 'token_too_short' WHEN coalesce(utt, '') = '' THEN 'missing_utt'
        WHEN coalesce(txt, '') = '' THEN 'missing_text' END AS reason FROM p"""
)
def prj_02_pair_to_record(t: Tables) -> DataFrame:
    a = t.documents.select("doc_id", F.split("text", " ").alias("c"), F.col("source").alias("utt"), F.col("text").alias("txt"))
    b = t.documents.select((F.col("doc_id") - 1).alias("doc_id"), F.split("text", " ").alias("r"))
    rows = a.join(b, "doc_id", "left")
    return rows.select("doc_id", projections.pair_record_reason(F.col("c"), F.col("r"), F.col("utt"), F.col("txt"), 40).alias("reason"))


@query(
    """SELECT count(*) AS checked, count(*) FILTER (n_chars >= 100) AS valid, min(n_chars) AS least, max(n_chars) AS most, round(avg(n_chars), 6) AS mean,
    array_to_string(list_slice(list(doc_id ORDER BY doc_id) FILTER (n_chars < 100), 1, 5), ',') AS bad_examples FROM documents"""
)
def agg_32_validation_summary(t: Tables) -> DataFrame:
    bad = aggregates.examples(F.col("doc_id"), F.col("doc_id"), F.col("n_chars") < 100, 5)
    return t.documents.agg(
        F.count("*").alias("checked"), F.count_if(F.col("n_chars") >= 100).alias("valid"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.round(F.avg("n_chars"), 6).alias("mean"),
        F.array_join(F.transform(bad, lambda x: x.cast("string")), ",").alias("bad_examples"),
    )


@query("SELECT o_custkey, array_to_string(list(o_orderkey ORDER BY o_orderkey), ',') AS orders FROM orders GROUP BY o_custkey")
def agg_33_key_lists(t: Tables) -> DataFrame:
    gathered = F.array_sort(F.collect_list("o_orderkey"))
    return t.orders.groupBy("o_custkey").agg(F.array_join(F.transform(gathered, lambda x: x.cast("string")), ",").alias("orders"))


@query(f"WITH {BASE_SQL} SELECT doc_id, group_id, row_number() OVER (PARTITION BY group_id ORDER BY doc_id) - 1 AS group_rank, count(*) OVER (PARTITION BY group_id) AS group_size FROM named")
def win_01_rank_in_group(t: Tables) -> DataFrame:
    return windows.rank_in_group(named(t), "group_id", [F.col("doc_id")]).select("doc_id", "group_id", F.col("group_rank").cast("long"), "group_size")


@query("SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang, md5(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def win_02_first_occurrence(t: Tables) -> DataFrame:
    return windows.first_occurrence(t.documents, ["lang", F.md5("text")], [F.col("doc_id")]).select("doc_id", "lang")


@query(
    """WITH r AS (SELECT source, text, doc_id, row_number() OVER (PARTITION BY source, text ORDER BY doc_id) AS f FROM documents WHERE text <> '')
    SELECT source, count(*) FILTER (f = 1) AS kept, count(*) FILTER (f > 1) AS dropped FROM r GROUP BY source"""
)
def win_03_path_dedup_counts(t: Tables) -> DataFrame:
    rows = t.documents.filter("text <> ''").withColumn("f", F.row_number().over(Window.partitionBy("source", "text").orderBy("doc_id")))
    return rows.groupBy("source").agg(F.count_if(F.col("f") == 1).alias("kept"), F.count_if(F.col("f") > 1).alias("dropped"))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def win_04_latest_event(t: Tables) -> DataFrame:
    return windows.latest(t.events, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("SELECT o_custkey, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def win_05_upsert(t: Tables) -> DataFrame:
    half = F.col("o_orderkey") % 2 == 0
    both = t.orders.filter(half).unionByName(t.orders.filter(~half))
    return windows.latest(both, ["o_custkey", "o_orderpriority"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderpriority", "o_orderkey")


@query(
    """WITH a AS (SELECT *, event_type = 'view' AS f, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events),
    b AS (SELECT *, p - row_number() OVER (PARTITION BY user_id, f ORDER BY p) AS run FROM a),
    c AS (SELECT *, row_number() OVER (PARTITION BY user_id, f, run ORDER BY p) AS i FROM b)
    SELECT event_id, user_id FROM c WHERE NOT f OR i <= 2"""
)
def win_06_run_suppression(t: Tables) -> DataFrame:
    return windows.trim_runs(t.events, ["user_id"], [F.col("event_id")], F.col("event_type") == "view", 2).select("event_id", "user_id")


@query(
    """WITH p AS (SELECT p_brand, p_partkey, round(p_retailprice / sum(p_retailprice) OVER (PARTITION BY p_brand), 9) AS p FROM part),
    c AS (SELECT *, row_number() OVER w AS rank, sum(p) OVER w - p AS before FROM p WINDOW w AS (PARTITION BY p_brand ORDER BY p DESC, p_partkey ROWS UNBOUNDED PRECEDING))
    SELECT p_brand, p_partkey, rank FROM c WHERE before < 0.8 AND rank <= 25"""
)
def win_07_nucleus_cut(t: Tables) -> DataFrame:
    share = F.round(F.col("p_retailprice") / F.sum("p_retailprice").over(Window.partitionBy("p_brand")), 9)
    return windows.running_share(t.part.select("p_brand", "p_partkey", share.alias("p")), ["p_brand"], "p", [F.col("p_partkey")], 0.8, 25).select("p_brand", "p_partkey", F.col("rank").cast("long"))


@query(
    """WITH l AS (SELECT event_id, user_id, event_type, list(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS past FROM events)
    SELECT event_id, len(list_filter(coalesce(past, []), lambda x: x = event_type)) AS repeats FROM l"""
)
def win_08_recent_repeats(t: Tables) -> DataFrame:
    return windows.recent_repeats(t.events, ["user_id"], [F.col("event_id")], "event_type", 10).select("event_id", F.col("repeats").cast("long"))


@query(
    """WITH r AS (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 500 AS bucket FROM documents)
    SELECT doc_id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY n_chars, doc_id) AS place FROM r"""
)
def win_09_length_buckets(t: Tables) -> DataFrame:
    return windows.length_buckets(t.documents.select("doc_id", "n_chars"), [F.col("doc_id")], "n_chars", 500).select("doc_id", F.col("bucket").cast("long"), F.col("place").cast("long"))


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('11:' || doc_id), doc_id) AS place FROM documents")
def win_10_hash_shuffle(t: Tables) -> DataFrame:
    return windows.numbered(t.documents.select("doc_id"), [windows.hash_order(F.col("doc_id"), 11), F.col("doc_id")], "place")


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS batch FROM documents")
def win_11_static_batch(t: Tables) -> DataFrame:
    return windows.static_batches(t.documents.select("doc_id"), [F.col("doc_id")], 32).select("doc_id", F.col("batch").cast("long"))


@query("SELECT doc_id, CASE WHEN r > n - 50 THEN 'cv' ELSE 'train' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, count(*) OVER () AS n FROM documents)")
def win_14_tail_split(t: Tables) -> DataFrame:
    return windows.split_ends(t.documents.select("doc_id"), [F.col("doc_id")], 50)


@query("WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS rn, count(*) OVER () AS n FROM part) SELECT p_partkey FROM r WHERE n <= 40 OR ((rn - 190) % n + n) % n < 40")
def win_15_circular_window(t: Tables) -> DataFrame:
    n = t.part.agg(F.count("*").alias("n"))
    rows = windows.numbered(t.part.select("p_partkey"), [F.col("p_partkey")]).crossJoin(n)
    return rows.filter(windows.circular_window(F.col("rn"), F.col("n"), 190, 40)).select("p_partkey")


@query(
    """WITH d AS (SELECT doc_id, list_slice(string_split(text, ' '), 1, 12) AS t, list_transform(range(1, (n_chars % 90)::BIGINT + 1), lambda x: '#' || x) AS s FROM documents),
    b AS (SELECT doc_id, t, s, ceil(len(t) / 5.0)::BIGINT AS k FROM d),
    m AS (SELECT doc_id, t, s, k, list_transform(range(0, k), lambda i: array_to_string(list_concat(list_slice(t, i * 5 + 1, i * 5 + 5),
          CASE WHEN i = k - 1 THEN list_slice(s, i * 15 + 1, len(s)) ELSE list_slice(s, i * 15 + 1, i * 15 + 15) END), ' ')) AS parts FROM b)
    SELECT doc_id, trim(CASE WHEN len(s) * 5 > len(t) * 15 THEN array_to_string(list_filter(parts, lambda x: x <> ''), ' ') ELSE array_to_string(list_concat(t, s), ' ') END) AS mixed FROM m"""
)
def win_16_token_interleave(t: Tables) -> DataFrame:
    count = F.col("n_chars") % 90
    speech = F.when(count > 0, F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(count, F.lit(1))), lambda x: F.concat(F.lit("#"), x.cast("string")))).otherwise(F.array().cast("array<string>"))
    rows = t.documents.select("doc_id", F.slice(F.split("text", " "), 1, 12).alias("t"), speech.alias("s"))
    return rows.select("doc_id", F.trim(F.array_join(scores.interleave("t", "s", 5, 15), " ")).alias("mixed"))


@query("SELECT doc_id, CASE WHEN ('0x' || substr(md5('voxmill::' || doc_id), 1, 8))::BIGINT / 4294967295.0::DOUBLE < 0.1 THEN 'cv' ELSE 'train' END AS split FROM documents")
def win_17_hash_split(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", windows.hash_split(F.col("doc_id").cast("string"), "voxmill", 0.1).alias("split"))


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) % 8 AS shard FROM documents")
def win_18_round_robin_chunks(t: Tables) -> DataFrame:
    return windows.numbered(t.documents.select("doc_id"), [F.col("doc_id")]).select("doc_id", F.pmod(F.col("rn") - 1, F.lit(8)).cast("long").alias("shard"))


@query("SELECT s_suppkey, ntile(7) OVER (ORDER BY s_suppkey) AS part FROM supplier")
def win_19_even_parts(t: Tables) -> DataFrame:
    return windows.even_parts(t.supplier.select("s_suppkey"), [F.col("s_suppkey")], 7)


@query("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100")
def smp_01_sample_rows(t: Tables) -> DataFrame:
    return sampling.sample_rows(t.documents.select("doc_id"), F.col("doc_id"), 100, 42)


@query(
    """WITH g AS (SELECT source FROM documents GROUP BY source HAVING count(*) >= 5 ORDER BY md5('7:' || source), source LIMIT 6),
    r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('7:' || doc_id), doc_id) AS k FROM documents WHERE source IN (SELECT source FROM g))
    SELECT source, doc_id FROM r WHERE k <= 5"""
)
def smp_02_two_level_sample(t: Tables) -> DataFrame:
    return sampling.sample_two_levels(t.documents, "source", F.col("doc_id"), 6, 5, 7).select("source", "doc_id")


@query("SELECT event_id, value FROM events ORDER BY md5('3:' || event_id), event_id LIMIT 500")
def smp_03_reservoir(t: Tables) -> DataFrame:
    return sampling.sample_rows(t.events, F.col("event_id"), 500, 3).select("event_id", "value")


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('5:' || doc_id), doc_id) AS r FROM documents) WHERE r <= 20")
def smp_04_stratified_sample(t: Tables) -> DataFrame:
    return sampling.sample_per_label(t.documents, "lang", F.col("doc_id"), 20, 5).select("doc_id", "lang")


@query("SELECT row_number() OVER (ORDER BY md5('9:' || p_partkey), p_partkey) AS place, p_partkey FROM part")
def smp_05_shuffled_order(t: Tables) -> DataFrame:
    return windows.numbered(t.part.select("p_partkey"), [windows.hash_order(F.col("p_partkey"), 9), F.col("p_partkey")], "place").select("place", "p_partkey")


@query("SELECT p_partkey, substr(md5('1:' || p_partkey), 1, 8) AS code FROM part")
def smp_06_suffix_codes(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", sampling.suffix_id(F.col("p_partkey"), 1).alias("code"))


@query(
    """WITH v AS (SELECT p_partkey, p_name, p_brand, row_number() OVER (ORDER BY p_partkey) AS i FROM part WHERE p_partkey % 4 <> 0)
       SELECT p_partkey, p_name AS prompt_text, p_brand AS tts_text FROM v WHERE (i - 1) % 3 = 1""")
def src_09_piped_manifest(t: Tables) -> DataFrame:
    full = F.concat_ws("|", F.col("p_partkey").cast("string"), "p_name", F.lit("a.wav"), "p_brand")
    raw = t.part.select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).otherwise(full).alias("value"))
    return readers.piped_manifest(raw, [F.col("p_partkey")], 1, 3).select("p_partkey", "prompt_text", "tts_text")


@query("SELECT min(p_partkey) AS first_valid, count(*) AS valid FROM part WHERE p_partkey % 4 <> 0")
def src_10_src_11_manifest_first_and_count(t: Tables) -> DataFrame:
    full = F.concat_ws("|", F.col("p_partkey").cast("string"), "p_name", F.lit("a.wav"), "p_brand")
    raw = t.part.select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).otherwise(full).alias("value"))
    return readers.piped_manifest(raw, [F.col("p_partkey")]).agg(F.min("p_partkey").alias("first_valid"), F.count("*").alias("valid"))


@query(
    """SELECT doc_id, source AS utt, lang AS text, len(t) AS n_tokens, CASE WHEN doc_id % 7 = 0 THEN 'malformed_json' WHEN doc_id % 5 = 0 THEN 'bad_tokens' END AS reason
    FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE source END AS source, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE lang END AS lang,
          CASE WHEN doc_id % 7 = 0 OR doc_id % 5 = 0 THEN NULL ELSE [1, 2, n_chars] END AS t FROM documents)"""
)
def src_03_sample_lines(t: Tables) -> DataFrame:
    good = F.to_json(F.struct(F.col("source").alias("key"), F.col("lang").alias("text"), F.array(F.lit(1), F.lit(2), F.col("n_chars").cast("int")).alias("code")))
    text = F.to_json(F.struct(F.col("source").alias("utt"), F.col("lang").alias("txt"), F.lit("oops(").alias("speech_token")))
    raw = t.documents.select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.lit("{oops")).when(F.col("doc_id") % 5 == 0, text).otherwise(good).alias("value"))
    return readers.sample_lines(raw).select("doc_id", "utt", "text", F.when(F.col("tokens").isNotNull(), F.size("tokens")).cast("long").alias("n_tokens"), "reason")


@query("SELECT c.conv_id, c.turn, t.turn - 1 AS tts_index, t.text AS tts_text FROM conversations c JOIN (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn, text FROM conversations WHERE role = 'assistant') t USING (conv_id) WHERE c.role = 'user'")
def src_04_inference_fanout(t: Tables) -> DataFrame:
    texts = t.conversations.filter("role = 'assistant'").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("texts"))
    return readers.with_texts(t.conversations.filter("role = 'user'").select("conv_id", "turn"), texts, "conv_id").withColumn("tts_index", F.col("tts_index").cast("long"))


@query("SELECT split_part(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ', 1) AS key, count(*) AS n FROM benchmark GROUP BY 1")
def src_13_keyed_lines(t: Tables) -> DataFrame:
    return readers.keyed_lines(t.benchmark.select(F.col("text").alias("value"))).groupBy("key").agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment AS model, 'e' || c_nationkey AS epoch, c_name AS scene FROM customer")
def src_15_path_tree(t: Tables) -> DataFrame:
    paths = t.customer.select(F.concat_ws("/", F.lit("file:/data/root"), "c_mktsegment", F.concat(F.lit("e"), F.col("c_nationkey").cast("string")), "c_name").alias("path"))
    return readers.path_tree(paths, "/data/root", ["model", "epoch", "scene"]).select("model", "epoch", "scene")


@query("SELECT p_brand AS meta, p_size AS epoch, count(*) AS files FROM part GROUP BY ALL")
def src_16_path_dimensions(t: Tables) -> DataFrame:
    paths = t.part.select(F.concat(F.lit("out/"), "p_brand", F.lit("/epoch_"), F.col("p_size").cast("string"), F.lit("/latency.tsv")).alias("path"))
    named_paths = readers.dimensions(paths, "path", r"out/([^/]+)/epoch_(\d+)/", ["meta", "epoch"])
    return named_paths.groupBy("meta", F.col("epoch").cast("int").alias("epoch")).agg(F.count("*").alias("files"))


@query("SELECT c_custkey, 'Customer#' AS spk FROM customer WHERE c_custkey % 3 = 0")
def src_19_pair_by_stem(t: Tables) -> DataFrame:
    audio = t.customer.select(F.concat(F.lit("a/Customer#_"), F.col("c_custkey").cast("string"), F.lit(".wav")).alias("path"))
    text = t.customer.filter("c_custkey % 3 = 0").select(F.concat(F.lit("a/Customer#_"), F.col("c_custkey").cast("string"), F.lit(".normalized.txt")).alias("path"))
    paired, _ = readers.utterances_from_listing(audio, text)
    return paired.select(F.split_part("utt", F.lit("_"), F.lit(2)).cast("long").alias("c_custkey"), "spk")


@query("SELECT doc_id, md5('[' || doc_id || ',' || n_chars || ']') AS print FROM documents")
def strf_25_fingerprint(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", fingerprint(F.array("doc_id", "n_chars")).alias("print"))


@query(
    f"""WITH {BASE_SQL}, o AS (SELECT coalesce(group_id, '__NO_GROUP__') AS group_id, doc_id, row_number() OVER (PARTITION BY group_id ORDER BY suffix_idx, utt, doc_id) - 1 AS new_rank, count(*) OVER (PARTITION BY group_id) AS group_size FROM named WHERE doc_id % 4 <> 1)
    SELECT group_id, group_size, new_rank, doc_id FROM o"""
)
def agg_04_regroup_flat_rows(t: Tables) -> DataFrame:
    rows = named(t).filter("doc_id % 4 <> 1").withColumn("group_rank", F.lit(0))
    groups = prepare.regrouped(rows, "utt", "doc_id", ["doc_id"])
    return groups.select("group_id", "group_size", F.posexplode("items").alias("new_rank", "i")).select("group_id", "group_size", F.col("new_rank").cast("long"), "i.doc_id")


@query("SELECT doc_id, lang, n_chars // 10 AS tens FROM (SELECT *, row_number() OVER (PARTITION BY lang, n_chars ORDER BY doc_id) AS r FROM documents WHERE n_chars > 500) WHERE r = 1")
def src_08_udf_01_udf_02_pipeline_from_spec(t: Tables) -> DataFrame:
    """Stages named in a spec, folded over the source, with an option overridden."""
    run = pipeline.build(
        [{"filter": {"condition": "n_chars > 0"}}, {"first_occurrence": {"keys": ["lang", "n_chars"], "order": ["doc_id"]}}, {"select": {"columns": ["doc_id", "lang", "cast(floor(n_chars / 10) as bigint) as tens"]}}],
        {"filter": {"condition": "n_chars > 500"}},
    )
    return run(t.documents)


@query("SELECT source, min(doc_id) AS best FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id < 8) GROUP BY source")
def str_07_resume(t: Tables) -> DataFrame:
    """Only groups that are not in the output yet are processed."""
    done = t.documents.filter("doc_id < 8").select("source")
    return incremental.resume(t.documents, done, "source", lambda df: df.groupBy("source").agg(F.min("doc_id").alias("best")))
