"""Joins, set operations, orders and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import joins, projections, sampling, windows
from .registry import Tables, query


@query(
    """SELECT l_orderkey, l_linenumber, p_name, s_name, n_name, r_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_quantity > 45"""
)
def jon_01_jon_02_star_assemble(t: Tables) -> DataFrame:
    base = t.lineitem.filter("l_quantity > 45")
    return joins.star(
        base,
        (t.part, F.col("l_partkey") == F.col("p_partkey"), "inner"),
        (t.supplier, F.col("l_suppkey") == F.col("s_suppkey"), "inner"),
        (t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "inner"),
        (t.region, F.col("n_regionkey") == F.col("r_regionkey"), "inner"),
    ).select("l_orderkey", "l_linenumber", "p_name", "s_name", "n_name", "r_name")


def _runs(t: Tables) -> tuple[DataFrame, DataFrame]:
    per = lambda kind: t.events.filter(F.col("event_type") == kind).groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("latency"), F.count("*").alias("n"))
    return per("click"), per("view")


@query(
    """WITH a AS (SELECT user_id, round(avg(value), 6) AS latency, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY user_id),
    b AS (SELECT user_id, round(avg(value), 6) AS latency, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY user_id)
    SELECT coalesce(a.user_id, b.user_id) AS user_id, a.user_id IS NOT NULL AS in_left, b.user_id IS NOT NULL AS in_right, a.latency AS latency_left, b.latency AS latency_right,
    round(b.latency - a.latency, 6) AS latency_diff, a.n AS n_left, b.n AS n_right, b.n - a.n AS n_diff FROM a FULL JOIN b ON a.user_id = b.user_id"""
)
def jon_03_full_outer_compare(t: Tables) -> DataFrame:
    return joins.compare_full(*_runs(t), "user_id", ["latency", "n"]).withColumn("latency_diff", F.round("latency_diff", 6))


@query(
    """WITH l AS (SELECT user_id, event_type, last(value ORDER BY event_id) AS value FROM events GROUP BY ALL)
    SELECT c_custkey, c_mktsegment, value FROM customer LEFT JOIN l ON c_custkey = user_id AND event_type = 'click'"""
)
def jon_04_left_enrich(t: Tables) -> DataFrame:
    side = joins.last_wins(t.events.filter("event_type = 'click'"), ["user_id", "event_type"], [F.col("event_id")]).select("user_id", "value")
    return t.customer.join(side, F.col("c_custkey") == F.col("user_id"), "left").select("c_custkey", "c_mktsegment", "value")


@query(
    """WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN starts_with(o_orderpriority, '1') THEN 'baseline' WHEN starts_with(o_orderpriority, '2') THEN 'candidate' ELSE 'other' END AS role FROM orders)
    SELECT a.o_custkey, a.o_orderkey AS base_o_orderkey, b.o_orderkey AS cand_o_orderkey, round((a.o_totalprice - b.o_totalprice) * 100.0 / nullif(a.o_totalprice, 0), 4) AS gain
    FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.role = 'baseline' AND b.role = 'candidate'"""
)
def jon_05_cross_in_group(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("role", projections.role_of(F.col("o_orderpriority"), "1", "2"))
    pairs = joins.cross_in_group(rows, ["o_custkey"], "role", "baseline", "candidate", ["o_totalprice"], "o_orderkey")
    return pairs.select("o_custkey", "base_o_orderkey", "cand_o_orderkey", F.round(joins.improvement(F.col("base_o_totalprice"), F.col("cand_o_totalprice")), 4).alias("gain"))


@query(
    """WITH a AS (SELECT doc_id, 'q' || quality AS v FROM labels WHERE quality = 1), b AS (SELECT source, 'm' || min(doc_id) AS v FROM documents WHERE doc_id % 2 = 0 GROUP BY source)
    SELECT d.doc_id, coalesce(a.v, b.v, d.lang) AS v FROM documents d LEFT JOIN a USING (doc_id) LEFT JOIN b ON d.source = b.source AND d.n_chars < 2000"""
)
def jon_06_fallback_lookup(t: Tables) -> DataFrame:
    first = t.labels.filter("quality = 1").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("v"))
    second = t.documents.filter("doc_id % 2 = 0").groupBy("source").agg(F.concat(F.lit("m"), F.min("doc_id").cast("string")).alias("v"))
    docs = t.documents.withColumn("s", F.when(F.col("n_chars") < 2000, F.col("source")))
    return joins.fallback(docs, [(first, "doc_id", "doc_id"), (second, "s", "source")], "v", F.col("lang")).select("doc_id", "v")


@query("SELECT conv_id FROM conversations WHERE role = 'user' INTERSECT SELECT conv_id FROM conversations WHERE role = 'assistant' INTERSECT SELECT conv_id FROM conversations WHERE turn >= 2")
def jon_07_key_intersection(t: Tables) -> DataFrame:
    c = t.conversations
    return joins.common_keys("conv_id", c.filter("role = 'user'"), c.filter("role = 'assistant'"), c.filter("turn >= 2"))


@query(
    """WITH a AS (SELECT item_id, text, row_number() OVER (ORDER BY item_id) AS rn FROM benchmark), b AS (SELECT doc_id, text AS other, row_number() OVER (ORDER BY doc_id) AS rn FROM documents)
    SELECT rn, item_id, doc_id, text = other AS same FROM a JOIN b USING (rn)"""
)
def jon_08_positional_zip(t: Tables) -> DataFrame:
    pairs = joins.zip_rows(t.benchmark, t.documents.select("doc_id", F.col("text").alias("other")), [F.col("item_id")], [F.col("doc_id")])
    return pairs.select("rn", "item_id", "doc_id", (F.col("text") == F.col("other")).alias("same"))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def jon_09_resume_anti_join(t: Tables) -> DataFrame:
    return joins.pending(t.documents, t.labels, "doc_id").select("doc_id", "source")


@query("SELECT count(*) AS unmatched FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def jon_10_unmatched_count(t: Tables) -> DataFrame:
    return joins.unmatched_count(t.documents, t.labels, "doc_id")


@query(
    """WITH a AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) % 10 AS slot FROM documents), b AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS slot FROM benchmark WHERE item_id < 10)
    SELECT doc_id, item_id FROM a JOIN b USING (slot)"""
)
def jon_11_round_robin_assign(t: Tables) -> DataFrame:
    return joins.round_robin(t.documents.select("doc_id"), t.benchmark.filter("item_id < 10").select("item_id"), [F.col("doc_id")], [F.col("item_id")], 10)


@query(
    """WITH b AS (SELECT l_partkey, l_returnflag, sum(l_linenumber)::BIGINT AS n FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' GROUP BY ALL),
    a AS (SELECT l_partkey, l_returnflag, sum(l_linenumber)::BIGINT AS n FROM lineitem GROUP BY ALL)
    SELECT a.l_partkey, a.l_returnflag, a.n - coalesce(b.n, 0) AS n FROM a LEFT JOIN b ON a.l_partkey = b.l_partkey AND a.l_returnflag = b.l_returnflag"""
)
def jon_12_counter_difference(t: Tables) -> DataFrame:
    counts = lambda df: df.groupBy("l_partkey", "l_returnflag").agg(F.sum("l_linenumber").alias("n"))
    return joins.counter_difference(counts(t.lineitem.filter("l_shipdate < timestamp_ntz '1996-01-01'")), counts(t.lineitem), ["l_partkey", "l_returnflag"], ["n"])


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY conv_id HAVING bool_and(role <> 'user' OR length(text) < 1500))")
def jon_13_jon_14_complete_sessions(t: Tables) -> DataFrame:
    complete = joins.complete_groups(t.conversations, "conv_id", (F.col("role") != "user") | (F.length("text") < 1500))
    return joins.rows_of(t.conversations, complete, "conv_id").select("conv_id", "turn", "role")


@query(
    """WITH l AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS v FROM orders GROUP BY o_custkey)
    SELECT c_custkey, generate_subscripts(v, 1) - 1 AS tts_index, unnest(v) AS tts_text FROM customer JOIN l ON c_custkey = o_custkey WHERE c_nationkey < 5"""
)
def jon_15_explode_lookup(t: Tables) -> DataFrame:
    lists = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("v"))
    return joins.explode_lookup(t.customer.filter("c_nationkey < 5").select("c_custkey"), lists, "c_custkey", "v").withColumn("tts_index", F.col("tts_index").cast("long"))


@query("SELECT user_id FROM events WHERE event_type = 'click' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def set_01_union_keys(t: Tables) -> DataFrame:
    return sampling.union_keys("user_id", t.events.filter("event_type = 'click'"), t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("user_id")))


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels WHERE toxic = 1")
def set_02_intersect_keys(t: Tables) -> DataFrame:
    return joins.common_keys("doc_id", t.documents, t.labels.filter("toxic = 1"))


@query("SELECT conv_id, count(DISTINCT role) FILTER (role NOT IN ('user', 'assistant')) = 0 AS subset FROM conversations GROUP BY conv_id")
def set_03_subset_test(t: Tables) -> DataFrame:
    roles = t.conversations.groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    return roles.select("conv_id", sampling.is_subset(F.col("roles"), F.array(F.lit("user"), F.lit("assistant"))).alias("subset"))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_04_difference(t: Tables) -> DataFrame:
    return joins.pending(t.customer.select("c_custkey"), t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT item_id AS id, text FROM benchmark UNION ALL SELECT doc_id, text FROM documents WHERE doc_id < 50")
def set_05_bag_union(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("id"), "text").unionByName(t.documents.filter("doc_id < 50").select(F.col("doc_id").alias("id"), "text"))


@query("SELECT event_type, min(event_id) AS first_at FROM events GROUP BY event_type")
def set_06_distinct_in_order(t: Tables) -> DataFrame:
    return sampling.distinct_in_order(t.events, "event_type", F.col("event_id"))


@query("SELECT lang, count(*) AS n FROM (SELECT lang FROM documents, range(2) WHERE lang = 'de' UNION ALL SELECT lang FROM documents, range(3) WHERE lang = 'fr') GROUP BY lang")
def set_07_weighted_mix(t: Tables) -> DataFrame:
    mixed = sampling.mix([(t.documents.filter("lang = 'de'"), 2), (t.documents.filter("lang = 'fr'"), 3)])
    return mixed.groupBy("lang").agg(F.count("*").alias("n"))


@query(
    """SELECT doc_id, 'missing' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id < 300
    UNION ALL SELECT doc_id, 'unexpected' FROM (SELECT DISTINCT doc_id FROM labels) WHERE doc_id >= 300"""
)
def set_08_key_difference(t: Tables) -> DataFrame:
    return sampling.key_difference(t.documents.filter("doc_id < 300"), t.labels, "doc_id")


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 200")
def srt_01_top_k(t: Tables) -> DataFrame:
    return sampling.top(t.events, 200, F.desc("value"), F.col("event_id")).select("event_id", "value")


@query("SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN p_size < 10 THEN 1000000000 ELSE p_size END, p_name, p_partkey) AS place FROM part")
def srt_02_sentinel_order(t: Tables) -> DataFrame:
    key = F.when(F.col("p_size") < 10, 10**9).otherwise(F.col("p_size"))
    return windows.numbered(t.part.select("p_partkey", "p_size", "p_name"), [key, F.col("p_name"), F.col("p_partkey")], "place").select("p_partkey", "place")


@query("SELECT p_brand, row_number() OVER (ORDER BY p_brand) AS place FROM (SELECT DISTINCT p_brand FROM part)")
def srt_03_dictionary_order(t: Tables) -> DataFrame:
    return windows.numbered(t.part.select("p_brand").distinct(), [F.col("p_brand")], "place")


@query(
    """SELECT label, row_number() OVER (ORDER BY (label <> 'baseline')::INT, coalesce(try_cast(regexp_extract(label, '(\\d+)', 1) AS INT), 2147483647), label) AS place
    FROM (SELECT DISTINCT CASE WHEN p_size = 1 THEN 'baseline' WHEN p_size < 5 THEN 'final' ELSE 'step_' || p_size END AS label FROM part)"""
)
def srt_04_natural_labels(t: Tables) -> DataFrame:
    label = F.when(F.col("p_size") == 1, "baseline").when(F.col("p_size") < 5, "final").otherwise(F.concat(F.lit("step_"), F.col("p_size").cast("string")))
    return windows.numbered(t.part.select(label.alias("label")).distinct(), sampling.natural_label(F.col("label")), "place")


@query("SELECT 'epoch_' || p_size || '_step_' || p_partkey || '.pt' AS latest FROM part ORDER BY p_size DESC, p_partkey DESC LIMIT 1")
def srt_05_latest_checkpoint(t: Tables) -> DataFrame:
    return sampling.latest_checkpoint(t.part.select(F.concat(F.lit("epoch_"), F.col("p_size").cast("string"), F.lit("_step_"), F.col("p_partkey").cast("string"), F.lit(".pt")).alias("path")), "path")


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 5")
def srt_06_lowest_losses(t: Tables) -> DataFrame:
    return sampling.top(t.part, 5, F.col("p_retailprice"), F.col("p_partkey")).select("p_partkey", "p_retailprice")


@query("SELECT c_custkey, c_name, (SELECT greatest(1, ceil(count(*) / 20))::BIGINT FROM customer) AS pages FROM customer ORDER BY c_name, c_custkey LIMIT 20 OFFSET 40")
def srt_07_pagination(t: Tables) -> DataFrame:
    rows = sampling.page(t.customer, 3, 20, F.col("c_name"), F.col("c_custkey")).select("c_custkey", "c_name")
    return rows.crossJoin(sampling.page_count(t.customer, 20))


@query("SELECT doc_id, source, lang FROM documents WHERE source = 'src7' ORDER BY doc_id LIMIT 1")
def srt_08_point_lookup(t: Tables) -> DataFrame:
    return sampling.lookup(t.documents, "source", "src7", F.col("doc_id")).select("doc_id", "source", "lang")


@query("SELECT source, array_to_string(list(doc_id ORDER BY n_chars DESC, doc_id), ',') AS ids FROM documents GROUP BY source")
def srt_09_descending_length(t: Tables) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").alias("d"))))
    return t.documents.groupBy("source").agg(F.array_join(F.transform(ordered, lambda x: x["d"].cast("string")), ",").alias("ids"))
