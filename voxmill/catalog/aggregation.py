"""Statistics, scores, percentiles, histograms and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import aggregates, filters, sampling, vectors
from .registry import Tables, query

# Events as scored utterances: value as MOS, SNR and similarity in their ranges.
SCORED_SQL = """scored AS (SELECT event_id, user_id, event_type, value, 1 + value / 125 AS mos, value / 10 + 5 AS snr, (event_id % 100) / 100.0 AS sim,
    round(0.45 * greatest(0, least(1, (1 + value / 125 - 1) / 4)) + 0.25 * greatest(0, least(1, (value / 10 + 5 - 10) / 40)) + 0.30 * ((event_id % 100) / 100.0), 9) AS score FROM events)"""
GRADE_SQL = "CASE WHEN score >= 0.9 THEN 'A+' WHEN score >= 0.8 THEN 'A' WHEN score >= 0.7 THEN 'B' WHEN score >= 0.6 THEN 'C' ELSE 'D' END"


def scored(t: Tables) -> DataFrame:
    ranges = {"mos": 1 + F.col("value") / 125, "snr": F.col("value") / 10 + 5, "sim": F.pmod(F.col("event_id"), F.lit(100)) / 100.0}
    return t.events.withColumns(ranges).withColumn("score", F.round(scores.quality_score(F.col("mos"), F.col("snr"), F.col("sim")), 9))


@query(f"WITH {SCORED_SQL} SELECT event_id, round(score, 8) AS score, {GRADE_SQL} AS grade FROM scored")
def math_01_math_02_quality_grade(t: Tables) -> DataFrame:
    return scored(t).select("event_id", F.round("score", 8).alias("score"), scores.grade("score").alias("grade"))


@query(f"WITH {SCORED_SQL} SELECT {GRADE_SQL} AS grade, count(*) AS n FROM scored GROUP BY 1")
def agg_13_grade_counts(t: Tables) -> DataFrame:
    return scored(t).groupBy(scores.grade("score").alias("grade")).agg(F.count("*").alias("n"))


@query("SELECT coalesce(user_id::VARCHAR, 'UNKNOWN') AS speaker, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1 ORDER BY n DESC, first LIMIT 20")
def agg_13_speaker_top_n(t: Tables) -> DataFrame:
    counts = t.events.groupBy(F.coalesce(F.col("user_id").cast("string"), F.lit("UNKNOWN")).alias("speaker")).agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    return sampling.top(counts, 20, F.desc("n"), F.col("first"))


@query(f"WITH {SCORED_SQL} SELECT event_id, round(score, 8) AS score FROM scored WHERE mos >= 3.6 AND snr >= 30 AND sim >= 0.85 AND score >= 0.82")
def flt_05_strict_quality(t: Tables) -> DataFrame:
    rows = scored(t)
    return rows.filter(filters.strict_quality(F.col("mos"), F.col("snr"), F.col("sim"), F.col("score"))).select("event_id", F.round("score", 8).alias("score"))


@query(
    """WITH v AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'NaN' WHEN 1 THEN 'oops' WHEN 2 THEN 'Infinity' ELSE value::VARCHAR END AS raw FROM events)
    SELECT event_id, CASE WHEN isfinite(try_cast(raw AS DOUBLE)) THEN try_cast(raw AS DOUBLE) END AS number FROM v"""
)
def flt_06_castable_numbers(t: Tables) -> DataFrame:
    k = F.pmod(F.col("event_id"), F.lit(5))
    raw = F.when(k == 0, "NaN").when(k == 1, "oops").when(k == 2, "Infinity").otherwise(F.col("value").cast("string"))
    return t.events.select("event_id", scores.number(raw).alias("number"))


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max FROM events GROUP BY event_type")
def agg_06_moments(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(*aggregates.moments("value")).withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query(
    """WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events),
    p AS (SELECT unnest([0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99])::DOUBLE AS p)
    SELECT event_type, p, value FROM o, p WHERE r = floor((n - 1) * p)"""
)
def agg_07_floor_percentiles(t: Tables) -> DataFrame:
    return aggregates.floor_percentiles(t.events, "value", by=["event_type"])


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def agg_08_linear_percentiles(t: Tables) -> DataFrame:
    out = aggregates.percentile_columns(t.events, {"v": F.col("value")}, (0.5, 0.95), ["event_type"])
    return out.select("event_type", F.round("v_p50", 6).alias("p50"), F.round("v_p95", 6).alias("p95"))


@query(
    """WITH b AS (SELECT least(50, greatest(1, floor(value / 10.0)::INT + 1)) AS bin, count(*) AS c FROM events GROUP BY 1),
    u AS (SELECT bin, sum(c) OVER (ORDER BY bin) AS u, sum(c) OVER () AS n FROM b), p AS (SELECT unnest([0.05, 0.5, 0.95])::DOUBLE AS p)
    SELECT p, min(bin) AS bin, (min(bin) - 0.5) * 10.0::DOUBLE AS value FROM u, p WHERE u >= p * n GROUP BY p"""
)
def agg_09_histogram_percentiles(t: Tables) -> DataFrame:
    rows = t.events.withColumn("bin", scores.equal_bin("value", 0.0, 500.0, 50))
    return aggregates.histogram_percentiles(rows, "bin", 0.0, 500.0, 50, (0.05, 0.5, 0.95))


@query("SELECT user_id, count(value) AS n, round(avg(value), 5) AS mean, round(stddev_pop(value), 5) AS std FROM events GROUP BY user_id")
def agg_10_sum_square_moments(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(*aggregates.sum_square_moments("value")).withColumns({c: F.round(c, 5) for c in ("mean", "std")})


@query(
    """SELECT CASE WHEN value >= 100 AND value < 200 THEN '[100.0, 200.0)' WHEN value >= 200 AND value < 400 THEN '[200.0, 400.0)' ELSE '[200.0, 400.0]' END AS bucket, count(*) AS n FROM events GROUP BY 1"""
)
def agg_11_edge_histogram(t: Tables) -> DataFrame:
    return t.events.groupBy(scores.edge_bucket("value", (100.0, 200.0, 400.0)).alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT least(20, greatest(1, floor((value - 50) / 20.0)::INT + 1)) AS bin, count(*) AS n FROM events GROUP BY 1")
def agg_12_equal_histogram(t: Tables) -> DataFrame:
    return t.events.groupBy(scores.equal_bin("value", 50.0, 450.0, 20).alias("bin")).agg(F.count("*").alias("n"))


@query(
    """WITH s AS (SELECT l_quantity AS q, l_extendedprice AS e, l_discount AS d, l_tax AS t FROM lineitem)
    SELECT unnest(['q','q','q','e','e','d']) AS a, unnest(['e','d','t','d','t','t']) AS b, unnest([round(corr(q,e),6), round(corr(q,d),6), round(corr(q,t),6), round(corr(e,d),6), round(corr(e,t),6), round(corr(d,t),6)]) AS corr FROM s"""
)
def agg_14_correlations(t: Tables) -> DataFrame:
    rows = t.lineitem.selectExpr("l_quantity q", "l_extendedprice e", "l_discount d", "l_tax t")
    return aggregates.correlations(rows, ["q", "e", "d", "t"]).withColumn("corr", F.round("corr", 6))


CENTROID_SQL = """ex AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings)"""


@query(
    f"""WITH {CENTROID_SQL}, c AS (SELECT label, pos, avg(x) AS m FROM ex GROUP BY ALL),
    d AS (SELECT vec_id, label, sqrt(sum((x - m) * (x - m))) AS distance FROM ex JOIN c USING (label, pos) GROUP BY ALL),
    q AS (SELECT quantile_cont(distance, 0.95) AS q FROM d), f AS (SELECT *, distance >= q AS o FROM d, q)
    SELECT label AS cluster, count(*) AS size, round(avg(distance), 5) AS mean_dist, round(quantile_cont(distance, 0.5), 5) AS median_dist, round(quantile_cont(distance, 0.95), 5) AS p95_dist,
    round(max(distance), 5) AS max_dist, count(*) FILTER (o) AS outlier_count, round(count(*) / sum(count(*)) OVER (), 6) AS frac, round(count(*) FILTER (o) / count(*), 6) AS outlier_frac FROM f GROUP BY label"""
)
def agg_15_ml_02_cluster_outlier_stats(t: Tables) -> DataFrame:
    distances = vectors.flag_outliers(vectors.centroid_distances(t.embeddings, "vec_id", "embedding", "label"), "distance", 0.05)
    out = aggregates.cluster_statistics(distances, "cluster", "distance", "outlier")
    return out.withColumns({c: F.round(c, 5) for c in ("mean_dist", "median_dist", "p95_dist", "max_dist")} | {c: F.round(c, 6) for c in ("frac", "outlier_frac")})


@query(f"WITH {CENTROID_SQL} SELECT label, pos - 1 AS pos, round(avg(x), 6) AS value FROM ex GROUP BY ALL")
def agg_16_speaker_centroid(t: Tables) -> DataFrame:
    return aggregates.mean_vector(t.embeddings, "label", "embedding").select("label", F.col("pos").cast("long"), F.round("value", 6).alias("value"))


@query(f"WITH {CENTROID_SQL} SELECT pos - 1 AS pos, round(avg(x), 6) AS value FROM ex WHERE label IN (1, 2, 3) GROUP BY pos")
def agg_31_elementwise_mean(t: Tables) -> DataFrame:
    rows = t.embeddings.filter("label in (1, 2, 3)").withColumn("all", F.lit(0))
    return aggregates.mean_vector(rows, "all", "embedding").select(F.col("pos").cast("long"), F.round("value", 6).alias("value"))


@query(
    f"""WITH {CENTROID_SQL}, c AS (SELECT pos, avg(x) AS m FROM ex GROUP BY pos),
    d AS (SELECT vec_id, sqrt(sum((x - m) * (x - m))) AS distance FROM ex JOIN c USING (pos) GROUP BY vec_id)
    SELECT vec_id, round(distance, 5) AS distance, distance >= (SELECT quantile_cont(distance, 0.98) FROM d) AS outlier FROM d"""
)
def ml_03_centroid_outlier(t: Tables) -> DataFrame:
    d = vectors.flag_outliers(vectors.centroid_distances(t.embeddings, "vec_id", "embedding"), "distance", 0.02)
    return d.select("vec_id", F.round("distance", 5).alias("distance"), "outlier")


@query()
def ml_01_kmeans_outlier(t: Tables) -> DataFrame:
    """Scale, PCA, k-means, distance and flag; k-means has no SQL, its invariants are tested."""
    return vectors.flag_outliers(vectors.cluster_distances(t.embeddings, "vec_id", "embedding", 8, 16), "distance", 0.02)


@query(f"WITH {CENTROID_SQL}, n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM ex GROUP BY vec_id) SELECT vec_id, pos - 1 AS pos, round(x / n, 7) AS value FROM ex JOIN n USING (vec_id)")
def math_06_l2_normalize(t: Tables) -> DataFrame:
    rows = t.embeddings.select("vec_id", F.posexplode(scores.l2_normalize("embedding")).alias("pos", "value"))
    return rows.select("vec_id", F.col("pos").cast("long"), F.round("value", 7).alias("value"))


@query(
    f"""WITH {CENTROID_SQL}, r AS (SELECT vec_id, pos, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, pos) AS k FROM ex), t AS (SELECT vec_id, pos FROM r WHERE k <= 8)
    SELECT a.vec_id, count(b.pos) / 8.0::DOUBLE AS overlap FROM t a LEFT JOIN t b ON b.vec_id = a.vec_id + 1 AND b.pos = a.pos WHERE a.vec_id + 1 IN (SELECT vec_id FROM embeddings) GROUP BY a.vec_id"""
)
def math_07_top_k_overlap(t: Tables) -> DataFrame:
    a = t.embeddings.select("vec_id", F.col("embedding").alias("x"))
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    return a.join(b, "vec_id").select("vec_id", scores.top_k_overlap("x", "y", 8).alias("overlap"))


@query("SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 8) AS mean FROM lineitem GROUP BY l_returnflag")
def agg_29_weighted_mean(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.round(aggregates.weighted_mean(F.col("l_discount"), F.col("l_quantity")), 8).alias("mean"))


@query(
    """SELECT user_id, round(sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END) / greatest(count(*) FILTER (event_type = 'click'), 1), 6) AS clamped,
    round(avg(value) FILTER (event_type = 'click'), 6) AS plain FROM events GROUP BY user_id"""
)
def agg_30_masked_mean(t: Tables) -> DataFrame:
    mask = F.col("event_type") == "click"
    return t.events.groupBy("user_id").agg(
        F.round(aggregates.masked_mean(F.col("value"), mask), 6).alias("clamped"), F.round(aggregates.masked_mean(F.col("value"), mask, clamp=False), 6).alias("plain")
    )


@query("SELECT doc_id, least(1200, greatest(25, ceil(length(text) * 3.5)::INT)) AS n FROM documents")
def math_03_dummy_length(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", scores.dummy_length("text", 3.5, 25, 1200).alias("n"))


@query("SELECT event_id, round(greatest(0, 1 - tanh(3 * (value / 500))), 9) AS reward FROM events")
def math_04_tanh_reward(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.round(scores.tanh_reward(F.col("value") / 500), 9).alias("reward"))


@query("SELECT l_orderkey, l_linenumber, round(ln(1 + exp(-0.1 * ((l_tax * 100 - l_discount * 100) - (l_quantity / 10 - 2)))), 8) AS loss FROM lineitem")
def math_05_preference_loss(t: Tables) -> DataFrame:
    loss = scores.preference_loss(F.col("l_tax") * 100, F.col("l_discount") * 100, F.col("l_quantity") / 10, F.lit(2.0), 0.1)
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(loss, 8).alias("loss"))


@query(
    """WITH a AS (SELECT conv_id, list(length(text) ORDER BY turn) AS v FROM conversations GROUP BY conv_id), m AS (SELECT max(len(v)) AS m FROM a)
    SELECT conv_id, len(v) AS n, array_to_string(list_concat(v, list_transform(range(m - len(v)), lambda x: 0)), ',') AS padded,
    array_to_string(list_transform(range(m), lambda i: i >= len(v)), ',') AS mask FROM a, m"""
)
def arr_01_arr_04_pad_and_mask(t: Tables) -> DataFrame:
    rows = t.conversations.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))), lambda x: x["n"]).alias("v"))
    most = rows.agg(F.max(F.size("v")).alias("m"))
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    both = rows.crossJoin(most)
    return both.select("conv_id", F.size("v").cast("long").alias("n"), text(scores.pad("v", F.col("m"))).alias("padded"), text(scores.pad_mask(F.size("v"), F.col("m"))).alias("mask"))


@query("SELECT doc_id, array_to_string(list_slice(list_concat(list_slice(string_split(text, ' '), 3, 8), ['', '', '', '', '', '']), 1, 6), '|') AS part FROM documents")
def arr_02_fit_length(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(scores.fit(F.split("text", " "), 6, 3, ""), "|").alias("part"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '7,8,' || (event_id % 10) ELSE '7,8,' || (event_id % 10) END AS tokens FROM events")
def arr_03_prepend_once(t: Tables) -> DataFrame:
    last = F.pmod(F.col("event_id"), F.lit(10)).cast("int")
    given = F.when(F.col("event_id") % 2 == 0, F.array(F.lit(7), F.lit(8), last)).otherwise(F.array(last))
    return t.events.select("event_id", F.array_join(F.transform(scores.prepend_once(given, [7, 8]), lambda x: x.cast("string")), ",").alias("tokens"))


@query(
    """WITH d AS (SELECT doc_id, list_slice(list_transform(string_split(text, ' '), lambda x: length(x)), 1, 30) AS v FROM documents)
    SELECT doc_id, array_to_string(list_transform(list_concat([list_slice(v, 1, 3)], list_transform(range(4, greatest(len(v) + 1, 4), 5), lambda i: list_slice(v, i, i + 4))), lambda c: array_to_string(c, ' ')), '|') AS chunks FROM d"""
)
def str_04_fixed_ratio_chunks(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.slice(F.transform(F.split("text", " "), lambda x: F.length(x)), 1, 30).alias("v"))
    chunks = F.transform(scores.chunk_array("v", 5, 3), lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " "))
    return rows.select("doc_id", F.array_join(chunks, "|").alias("chunks"))


@query("SELECT conv_id, turn, CASE WHEN turn < 2 THEN 0 ELSE 1 + (turn - 2) // 3 END AS hop FROM conversations")
def str_05_token_hops(t: Tables) -> DataFrame:
    """First hop of two tokens, then three each, as arithmetic on the position."""
    return t.conversations.select("conv_id", "turn", F.when(F.col("turn") < 2, F.lit(0)).otherwise(1 + F.floor((F.col("turn") - 2) / 3)).cast("long").alias("hop"))
