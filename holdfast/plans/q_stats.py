"""Queries of aggregates, metrics, windows and selections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from holdfast.operators import aggregates as A
from holdfast.operators import metrics as M
from holdfast.operators import ordered as O
from holdfast.operators import selection as S
from holdfast.operators.frames import first_per_key
from holdfast.plans.registry import over, query

c = F.col

query("agg_value_counts", "SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1")(lambda t: t.orders.groupBy(c("o_custkey").alias("k")).agg(F.count("*").alias("n")))
rows_e, head_e = over("lineitem", "l_partkey % 500 AS query", "l_suppkey AS target", "l_discount AS score")
query("agg_symmetric_max", head_e + "SELECT key, max(score) AS score FROM (SELECT query AS key, score FROM i WHERE query <> target UNION ALL SELECT target, score FROM i WHERE query <> target) GROUP BY 1")(lambda t: A.symmetric_max(rows_e(t)))
query("agg_partial_max_batches", head_e + "SELECT query, max(score) AS score FROM i GROUP BY 1")(lambda t: rows_e(t).groupBy("query").agg(F.max("score").alias("score")))
query("agg_group_list_unique", "SELECT l_partkey AS k, max(l_quantity) AS q, bool_or(l_returnflag = 'R') AS any_r, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS s, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1")(
    lambda t: t.lineitem.groupBy(c("l_partkey").alias("k")).agg(F.max("l_quantity").alias("q"), F.bool_or(c("l_returnflag") == "R").alias("any_r"), A.sorted_sources(c("l_suppkey").cast("string"), ",").alias("s"), F.count_distinct("l_suppkey").alias("n")))
query("agg_group_any_sum_len", "SELECT p_type AS k, max(p_retailprice) AS m, bool_or(p_size = 1) AS a, sum(len(string_split(p_name, ' ')))::BIGINT AS n FROM part GROUP BY 1")(
    lambda t: t.part.groupBy(c("p_type").alias("k")).agg(F.max("p_retailprice").alias("m"), F.bool_or(c("p_size") == 1).alias("a"), F.sum(F.size(F.split("p_name", " "))).alias("n")))
query("agg_clash_check", "SELECT p_name, count(DISTINCT p_type) AS n_values FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1")(lambda t: A.clashes(t.part, ["p_name"], "p_type"))
query("agg_max_row_per_group", "SELECT l_partkey AS k, arg_max(l_orderkey, (l_extendedprice, l_orderkey, l_linenumber)) AS o, max(l_extendedprice) AS v FROM lineitem GROUP BY 1")(
    lambda t: t.lineitem.groupBy(c("l_partkey").alias("k")).agg(F.max_by("l_orderkey", F.struct("l_extendedprice", "l_orderkey", "l_linenumber")).alias("o"), F.max("l_extendedprice").alias("v")))
query("agg_log_mean", "SELECT l_partkey AS k, round(pow(10, avg(log10(l_extendedprice))), 4) AS v, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS source, arg_min(l_linestatus, (l_orderkey, l_linenumber, l_linestatus)) AS status FROM lineitem GROUP BY 1")(
    lambda t: t.lineitem.groupBy(c("l_partkey").alias("k")).agg(F.round(A.log_mean(c("l_extendedprice")), 4).alias("v"), A.sorted_sources(c("l_returnflag")).alias("source"), F.min_by("l_linestatus", F.struct("l_orderkey", "l_linenumber", "l_linestatus")).alias("status")))
query("agg_collect_set_multi", "SELECT l_orderkey AS k, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS a, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS b, min(l_partkey) AS m FROM lineitem GROUP BY 1")(
    lambda t: t.lineitem.groupBy(c("l_orderkey").alias("k")).agg(A.sorted_sources(c("l_returnflag"), ",").alias("a"), A.sorted_sources(c("l_linestatus"), ",").alias("b"), F.min("l_partkey").alias("m")))
query("agg_mean_pool_vectors", "SELECT label AS k, i, round(avg(x), 6) AS v FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2")(
    lambda t: A.mean_pool(t.embeddings.select(c("label").alias("k"), "embedding"), "k", "embedding").select("k", F.posexplode("embedding").alias("i", "v")).select("k", (c("i") + 1).cast("long").alias("i"), F.round("v", 6).alias("v")))
Q7 = ", ".join(f"round(quantile_cont(x, {q}::DOUBLE), 6) AS q{int(100 * q):02d}" for q in A.QUANTILES)


@query("agg_quantiles", f"SELECT o_orderpriority AS k, {Q7.replace('(x,', '(o_totalprice,')} FROM orders GROUP BY 1")
def _(t):
    got = t.orders.groupBy(c("o_orderpriority").alias("k")).agg(A.quantiles(c("o_totalprice")).alias("q"))
    return got.select("k", *[F.round(c("q")[i], 6).alias(f"q{int(100 * q):02d}") for i, q in enumerate(A.QUANTILES)])


query("agg_pop_moments", "SELECT o_orderstatus AS k, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS std, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1")(
    lambda t: t.orders.groupBy(c("o_orderstatus").alias("k")).agg(F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.stddev_pop("o_totalprice"), 4).alias("std"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi")))
SPLIT = "CASE WHEN o_orderkey % 10 < 8 THEN 'train' WHEN o_orderkey % 10 = 8 THEN 'val' ELSE 'test' END"
rows_s, head_s = over("orders", f"{SPLIT} AS split", "CASE WHEN o_orderkey % 10 = 9 THEN o_totalprice * 1.25 ELSE o_totalprice END AS x")
head_s = head_s.replace("* 1.25", "* 1.25::DOUBLE")
rows_s2 = lambda t: rows_s(t).withColumn("x", c("x").cast("double"))
TRAIN = "tr AS (SELECT avg(x) AS m, median(x) AS md, min(x) AS lo, max(x) AS hi, quantile_cont(x, 0.01::DOUBLE) AS a, quantile_cont(x, 0.99::DOUBLE) AS b FROM i WHERE split = 'train')"
KS = "u AS (SELECT DISTINCT x FROM i), cdf AS (SELECT s.split, u.x, (SELECT count(*) FROM i WHERE i.split = s.split AND i.x <= u.x) / s.n AS f FROM u, (SELECT split, count(*)::DOUBLE AS n FROM i GROUP BY 1) s)"
KS = "w AS (SELECT x, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'val') AS b, count(*) FILTER (split = 'test') AS d FROM i GROUP BY 1), f AS (SELECT sum(a) OVER o / sum(a) OVER () AS a, sum(b) OVER o / sum(b) OVER () AS b, sum(d) OVER o / sum(d) OVER () AS d FROM w WINDOW o AS (ORDER BY x)), k AS (SELECT 'train' AS split, 0.0::DOUBLE AS ks UNION ALL SELECT 'val', max(abs(b - a)) FROM f UNION ALL SELECT 'test', max(abs(d - a)) FROM f)"


@query("agg_split_shift", f"{head_s}, {TRAIN}, {KS} SELECT i.split, count(*) AS n, round(avg(x), 4) AS mean, round(stddev_pop(x), 4) AS std, round(avg(x) - any_value(m), 4) AS mean_shift, round(median(x) - any_value(md), 4) AS median_shift, round(avg((x < lo OR x > hi)::INT), 6) AS outside_range, "
       "round(avg((x < a OR x > b)::INT), 6) AS outside_q01_q99, round(sqrt(avg(pow(x - m, 2))), 4) AS rmse, round(avg(abs(x - m)), 4) AS mae, round(1 - avg(pow(x - m, 2)) / var_pop(x), 6) AS r2, round(any_value(ks), 6) AS ks FROM i JOIN k ON i.split = k.split, tr GROUP BY 1")  # fmt: skip
def _(t):
    got = A.split_shift(rows_s2(t), "split", "x")
    fine = {"outside_range", "outside_q01_q99", "r2", "ks"}
    return got.select("split", "n", *[F.round(k, 6 if k in fine else 4).alias(k) for k in got.columns if k not in ("split", "n")])


query("agg_ks", f"{head_s}, {KS} SELECT split, round(ks, 6) AS ks FROM k")(lambda t: A.ks(rows_s2(t), "split", "x").select("split", F.round("ks", 6).alias("ks")))


@query("agg_naive_reference", f"{head_s}, tr AS (SELECT avg(x) AS m, var_pop(x) AS v FROM i WHERE split = 'train') SELECT round(1 - avg(pow(x - m, 2)) / var_pop(x), 6) AS r2, round(avg(abs(x - m)), 4) AS mae, round(1 - (avg(pow(x - m, 2)) + any_value(v)) / var_pop(x), 6) AS r2_random FROM i, tr WHERE split = 'test'")
def _(t):
    rows = rows_s2(t)
    train = rows.filter("split = 'train'").agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    test = rows.filter("split = 'test'").crossJoin(F.broadcast(train))  # one row
    mse = F.avg(F.pow(c("x") - c("m"), 2))
    return test.agg(F.round(1 - mse / F.var_pop("x"), 6).alias("r2"), F.round(F.avg(F.abs(c("x") - c("m"))), 4).alias("mae"), F.round(1 - (mse + F.first("v")) / F.var_pop("x"), 6).alias("r2_random"))


query("agg_seed_mean_std", "SELECT CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS threshold, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std FROM orders GROUP BY 1")(
    lambda t: t.orders.groupBy(F.when(c("o_orderstatus") != "P", c("o_orderstatus")).alias("threshold")).agg(F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.stddev_samp("o_totalprice"), 4).alias("std")))
query("agg_histogram", "SELECT least(floor((l_quantity - 1) / 7.0::DOUBLE), 6)::BIGINT AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 1 AND 50 GROUP BY 1")(
    lambda t: t.lineitem.select(A.histogram(c("l_quantity"), 1.0, 50.0, 7).cast("long").alias("bin")).filter("bin is not null").groupBy("bin").agg(F.count("*").alias("n")))
query("agg_threshold_stats", f"SELECT {SPLIT} AS split, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS median, max(o_totalprice) AS hi, min(o_totalprice) AS lo, count(*) FILTER (o_totalprice >= 200000) AS above, count(*) FILTER (o_totalprice < 200000) AS below, round(100.0::DOUBLE * count(*) FILTER (o_totalprice >= 200000) / count(*), 6) AS percent FROM orders GROUP BY 1")(
    lambda t: t.orders.groupBy(F.expr(SPLIT).alias("split")).agg(F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.median("o_totalprice"), 4).alias("median"), F.max("o_totalprice").alias("hi"), F.min("o_totalprice").alias("lo"), F.count_if(c("o_totalprice") >= 200000).alias("above"), F.count_if(c("o_totalprice") < 200000).alias("below"), F.round(100.0 * F.count_if(c("o_totalprice") >= 200000) / F.count("*"), 6).alias("percent")))
query("agg_year_split_pivot", f"SELECT year(o_orderdate)::INT AS y, count(*) FILTER ({SPLIT} = 'train') AS train, count(*) FILTER ({SPLIT} = 'val') AS val, count(*) FILTER ({SPLIT} = 'test') AS test FROM orders GROUP BY 1")(
    lambda t: t.orders.withColumn("split", F.expr(SPLIT)).groupBy(F.year("o_orderdate").alias("y")).pivot("split", ["train", "val", "test"]).count().na.fill(0))
query("agg_coverage", "WITH s AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 40) SELECT count(*) AS n_rows, count(l_partkey) AS matched, count(*) - count(l_partkey) AS missing, count(DISTINCT l_partkey) AS keys FROM part LEFT JOIN s ON p_partkey = l_partkey")(
    lambda t: t.part.join(t.lineitem.filter("l_quantity > 40").select("l_partkey").distinct(), c("p_partkey") == c("l_partkey"), "left").agg(F.count("*").alias("n_rows"), F.count("l_partkey").alias("matched"), (F.count("*") - F.count("l_partkey")).alias("missing"), F.count_distinct("l_partkey").alias("keys")))
query("agg_first_match_breakdown", "SELECT CASE WHEN p_size < 10 THEN 'store' WHEN p_size < 30 THEN 'npz' ELSE 'none' END AS source, count(*) AS n FROM part GROUP BY 1")(
    lambda t: t.part.groupBy(F.coalesce(F.when(c("p_size") < 10, "store"), F.when(c("p_size") < 30, "npz"), F.lit("none")).alias("source")).agg(F.count("*").alias("n")))
rows_m, head_m = over("events", "event_type AS k", "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 13 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE value END AS x")
query("agg_missing_counts", head_m + "SELECT k, count(*) FILTER (x IS NULL) AS missing, count(*) FILTER (isnan(x) OR isinf(x)) AS non_finite FROM i GROUP BY 1")(
    lambda t: rows_m(t).groupBy("k").agg(F.count_if(c("x").isNull()).alias("missing"), F.count_if(F.isnan("x") | (F.abs("x") == float("inf"))).alias("non_finite")))
query("agg_reason_counts", "SELECT CASE WHEN p_size < 5 THEN 'too small' WHEN p_retailprice > 1500 THEN 'too dear' ELSE 'kept' END AS reason, count(*) AS n FROM part GROUP BY 1")(
    lambda t: t.part.groupBy(F.when(c("p_size") < 5, "too small").when(c("p_retailprice") > 1500, "too dear").otherwise("kept").alias("reason")).agg(F.count("*").alias("n")))
query("agg_source_pivot", "SELECT l_returnflag AS k, count(*) FILTER (l_linestatus = 'F') AS f_rows, count(DISTINCT l_partkey) FILTER (l_linestatus = 'F') AS f_keys, count(*) FILTER (l_linestatus = 'O') AS o_rows, count(DISTINCT l_partkey) FILTER (l_linestatus = 'O') AS o_keys FROM lineitem GROUP BY 1")(
    lambda t: t.lineitem.withColumnRenamed("l_returnflag", "k").groupBy("k").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("l_partkey").alias("keys")).na.fill(0).toDF("k", "f_rows", "f_keys", "o_rows", "o_keys"))
query("agg_block_scaling", "WITH x AS (SELECT unnest(embedding)::DOUBLE AS v FROM embeddings WHERE vec_id % 10 <> 0) SELECT round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM x")(
    lambda t: A.block_scaling(t.embeddings.select(F.when(c("vec_id") % 10 == 0, F.transform("embedding", lambda v: v * 0)).otherwise(c("embedding")).cast("array<double>").alias("v")), "v").select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std")))
query("agg_label_frequency", "SELECT v, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS v FROM part) GROUP BY 1")(lambda t: t.part.select(F.explode(F.split("p_name", " ")).alias("v")).groupBy("v").agg(F.count("*").alias("n")))
query("agg_group_sorted_set", "SELECT p_brand AS k, string_agg(DISTINCT p_type, ';' ORDER BY p_type) AS v FROM part GROUP BY 1")(lambda t: t.part.groupBy(c("p_brand").alias("k")).agg(A.sorted_sources(c("p_type"), ";").alias("v")))
query("agg_earliest_min", "SELECT l_partkey AS k, min(l_shipdate)::DATE AS d, min(l_returnflag) AS v FROM lineitem GROUP BY 1")(lambda t: t.lineitem.groupBy(c("l_partkey").alias("k")).agg(F.to_date(F.min("l_shipdate")).alias("d"), F.min("l_returnflag").alias("v")))
query("agg_delta_pct", "WITH a AS (SELECT l_returnflag AS split, l_linestatus AS method, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2) SELECT a.split, a.method, round(100 * (a.v - r.v) / r.v, 6) AS delta FROM a JOIN a r ON a.method = r.method AND r.split = 'N'")(
    lambda t: (lambda a: a.join(a.filter("split = 'N'").select("method", c("v").alias("r")), "method").select("split", "method", F.round(100 * (c("v") - c("r")) / c("r"), 6).alias("delta")))(t.lineitem.groupBy(c("l_returnflag").alias("split"), c("l_linestatus").alias("method")).agg(F.avg("l_quantity").alias("v"))))
query("agg_propagate_block", "SELECT p_partkey AS k, first_value(p_name) OVER (PARTITION BY p_partkey // 4 ORDER BY p_partkey) AS v, CASE WHEN p_partkey % 4 < 2 THEN p_brand END AS w FROM part")(
    lambda t: t.part.select(c("p_partkey").alias("k"), F.first_value("p_name").over(Window.partitionBy(F.floor(c("p_partkey") / 4)).orderBy("p_partkey")).alias("v"), F.when(c("p_partkey") % 4 < 2, c("p_brand")).alias("w")))

# Metrics
rows_r, head_r = over("lineitem", "l_returnflag AS k", "l_extendedprice / 1000 AS pred", "l_quantity AS target")
query("met_regression", head_r + "SELECT k, round(avg(pow(pred - target, 2)), 4) AS mse, round(sqrt(avg(pow(pred - target, 2))), 5) AS rmse, round(avg(abs(pred - target)), 5) AS mae, round(1 - avg(pow(pred - target, 2)) / var_pop(target), 6) AS r2 FROM i GROUP BY 1")(
    lambda t: rows_r(t).groupBy("k").agg(*M.regression(c("pred"), c("target"))).select("k", F.round("mse", 4).alias("mse"), F.round("rmse", 5).alias("rmse"), F.round("mae", 5).alias("mae"), F.round("r2", 6).alias("r2")))
query("met_pearson", head_r + "SELECT k, round(corr(pred, target), 6) AS pcc FROM i GROUP BY 1")(lambda t: rows_r(t).groupBy("k").agg(F.round(M.pearson(c("pred"), c("target")), 6).alias("pcc")))
RANK = "rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0::DOUBLE"
query("met_spearman", head_r + f", r AS (SELECT {RANK.format(x='pred')} AS a, {RANK.format(x='target')} AS b FROM i) SELECT round(corr(a, b), 6) AS scc FROM r")(lambda t: M.spearman(rows_r(t), "pred", "target").select(F.round("scc", 6).alias("scc")))
rows_c, head_c = over("part", "p_size % 7 AS pred", "CASE WHEN p_partkey % 6 = 0 THEN -1 ELSE (p_size + p_partkey % 3) % 6 END AS target")


@query("met_classification", head_c + ", v AS (SELECT * FROM i WHERE target >= 0), s AS (SELECT target AS class, count(*) AS n, count(*) FILTER (pred = target) AS hit FROM v GROUP BY 1), p AS (SELECT pred AS class, count(*) AS called FROM v WHERE pred < 6 GROUP BY 1), "
       "j AS (SELECT coalesce(n, 0) AS n, coalesce(hit, 0) AS hit, coalesce(called, 0) AS called, 2 * coalesce(hit, 0) / (coalesce(n, 0) + coalesce(called, 0)) AS f1 FROM s FULL JOIN p USING (class)) "
       "SELECT round(sum(hit) / sum(n), 6) AS accuracy, round(avg(hit / n) FILTER (n > 0), 6) AS balanced_accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * n) / sum(n), 6) AS weighted_f1 FROM j")  # fmt: skip
def _(t):
    got = M.classification(rows_c(t), "pred", "target", 6)
    return got.select(*[F.round(k, 6).alias(k) for k in got.columns])


SCORES = "concat(p_size % 7, ',', p_size % 11, ',', p_size % 13, ',', p_size % 5)"
rows_k, head_k = over("part", "p_partkey AS k", "CASE WHEN p_partkey % 9 = 0 THEN -1 ELSE p_partkey % 4 END AS target", f"{SCORES} AS s")
TOP = "list_transform(list_slice(list_sort(list_transform(string_split(s, ','), lambda v, j: {'a': -(v::INT), 'j': j})), 1, 2), lambda z: z.j - 1)"
scores_of = lambda: F.split("s", ",").cast("array<int>")
query("met_topk_hit", head_k + f"SELECT round(avg(list_contains({TOP}, target)::INT), 6) AS hit FROM i WHERE target >= 0")(
    lambda t: rows_k(t).filter("target >= 0").agg(F.round(F.avg(F.array_contains(M.top_k(F.array(*[F.lit(i) for i in range(4)]), scores_of(), 2), c("target").cast("int")).cast("int")), 6).alias("hit")))
query("met_topk_table", head_k + f"SELECT k, array_to_string({TOP}, ',') AS top FROM i")(lambda t: rows_k(t).select("k", F.array_join(M.top_k(F.array(*[F.lit(i) for i in range(4)]), scores_of(), 2).cast("array<string>"), ",").alias("top")))
rows_x, head_x = over("part", "p_partkey AS k", "concat(p_size % 3, '.', p_size % 2, '.', p_size % 5, '.1') AS a", "concat(p_partkey % 3, '.', p_size % 2, '.', p_partkey % 2, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '.1' END) AS b")
PAD = "list_slice(list_concat(string_split({x}, '.'), ['-','-','-','-']), 1, {n})"
query("met_exact_prefix", head_x + "SELECT " + ", ".join(f"round(avg(({PAD.format(x='a', n=n)} = {PAD.format(x='b', n=n)})::INT), 6) AS l{n}" for n in range(1, 5)) + " FROM i")(
    lambda t: rows_x(t).agg(*[F.round(F.avg(M.prefix_equal(c("a"), c("b"), n).cast("int")), 6).alias(f"l{n}") for n in range(1, 5)]))
LEVELS = "CASE WHEN len(string_split({b}, '.')) <> 4 THEN 0 WHEN {a} = {b} THEN 4 WHEN " + " WHEN ".join(f"{PAD.format(x='{a}', n=n)} = list_slice(string_split({{b}}, '.'), 1, {n}) THEN {n}" for n in (3, 2, 1)) + " ELSE 0 END"
query("met_matched_levels", head_x + f"SELECT k, {LEVELS.format(a='a', b='b')} AS n FROM i")(lambda t: rows_x(t).select("k", M.matched_levels(c("a"), c("b")).alias("n")))
PRED = "WITH p AS (SELECT l_suppkey AS query, concat(p_size % 3, '.', p_size % 4, '.', p_size % 5, '.', p_size % 7) AS label, l_extendedprice AS score FROM lineitem JOIN part ON l_partkey = p_partkey), b AS (SELECT query, label, max(score) AS score FROM p GROUP BY 1, 2), r AS (SELECT query, label, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, label) AS rank FROM b)"


def predictions(t):
    label = F.concat_ws(".", *[(c("p_size") % n).cast("string") for n in (3, 4, 5, 7)])
    return t.lineitem.join(t.part, c("l_partkey") == c("p_partkey")).select(c("l_suppkey").alias("query"), label.alias("label"), c("l_extendedprice").alias("score"))


TRUTH = "t AS (SELECT DISTINCT s_suppkey AS query, concat(s_nationkey % 3, '.', s_nationkey % 4, '.', s_suppkey % 5, '.', s_suppkey % 7) AS true FROM supplier)"


def truth(t):
    return t.supplier.select(c("s_suppkey").alias("query"), F.concat_ws(".", *[x.cast("string") for x in (c("s_nationkey") % 3, c("s_nationkey") % 4, c("s_suppkey") % 5, c("s_suppkey") % 7)]).alias("label"))


query("met_query_merge", PRED + " SELECT query, label, score, rank FROM r WHERE rank <= 20")(lambda t: M.merge_queries(predictions(t), 20).withColumn("rank", c("rank").cast("long")))
query("met_level_accuracy", PRED + f", {TRUTH}, m AS (SELECT k, t.query, t.true, max(CASE WHEN rank <= k THEN {LEVELS.format(a='t.true', b='label')} ELSE 0 END) AS m FROM t JOIN r ON t.query = r.query, (VALUES (1), (3), (5), (10), (20), (30), (40), (50)) g(k) WHERE rank <= 50 GROUP BY 1, 2, 3), s AS (SELECT k, level, query, avg((m >= level)::INT) AS share FROM m, (VALUES (1), (2), (3), (4)) l(level) GROUP BY 1, 2, 3) SELECT k, level, round(100 * avg(share), 6) AS accuracy FROM s GROUP BY 1, 2")(
    lambda t: M.level_accuracy(truth(t), M.merge_queries(predictions(t))).withColumn("accuracy", F.round("accuracy", 6)))
query("met_hit_coverage", "WITH h AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 48) SELECT count(*) AS queries, count(l_partkey) AS hits, count(*) - count(l_partkey) AS no_hit, round(count(l_partkey) / nullif(count(*), 0), 6) AS coverage FROM part LEFT JOIN h ON p_partkey = l_partkey")(
    lambda t: t.part.join(t.lineitem.filter("l_quantity > 48").select("l_partkey").distinct(), c("p_partkey") == c("l_partkey"), "left").agg(F.count("*").alias("queries"), F.count("l_partkey").alias("hits"), (F.count("*") - F.count("l_partkey")).alias("no_hit"), F.round(F.try_divide(F.count("l_partkey"), F.count("*")), 6).alias("coverage")))

# Windows
query("win_rank_average", f"SELECT o_orderkey AS k, {RANK.format(x='o_totalprice')} AS r FROM orders")(lambda t: O.average_rank(t.orders, "o_totalprice", "r").select(c("o_orderkey").alias("k"), "r"))
rows_g, head_g = over("orders", "o_orderkey AS k", "CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_custkey END AS g", "o_orderkey % 3 AS r")
query("win_group_min_transform", head_g + "SELECT k, min(r) OVER (PARTITION BY g) AS m FROM i")(lambda t: S.group_min(rows_g(t), ["g"], "r", "m").select("k", "m"))
query("win_running_count", "WITH d AS (SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1) SELECT day, coalesce(sum(n) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d")(
    lambda t: S.running_before(t.orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n")), "day", "n", "before").select("day", "before"))
query("win_latest_row", "SELECT user_id AS k, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY 1")(lambda t: t.events.groupBy(c("user_id").alias("k")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state")))
query("win_dedupe_keep", "SELECT user_id AS k, event_type AS e, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY 1, 2")(
    lambda t: first_per_key(t.events, ["user_id", "event_type"], [c("event_id")]).select(c("user_id").alias("k"), c("event_type").alias("e"), c("event_id").alias("first"))
    .join(first_per_key(t.events, ["user_id", "event_type"], [c("event_id").desc()]).select(c("user_id").alias("k"), c("event_type").alias("e"), c("event_id").alias("last")), ["k", "e"]))
query("win_pick_rules", "WITH m AS (SELECT p_name AS k, count(*) FILTER (p_size > 40) AS n1, min(p_partkey) FILTER (p_size > 40) AS v1, count(*) FILTER (p_brand = 'Brand#3') AS n2, min(p_partkey) FILTER (p_brand = 'Brand#3') AS v2, min(p_partkey) AS v3 FROM part GROUP BY 1) SELECT k, CASE WHEN n1 = 1 THEN v1 WHEN n2 = 1 THEN v2 ELSE v3 END AS v FROM m")(
    lambda t: S.pick_by_rules(t.part.withColumnRenamed("p_name", "k"), ["k"], "p_partkey", [c("p_size") > 40, c("p_brand") == "Brand#3"]).select("k", c("picked").alias("v")))

# Sorting and selection
SIMS = "WITH s AS (SELECT l_partkey AS key, round(max(l_discount), 6) AS sim, count(*) AS n FROM lineitem GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY sim, n, key) AS r FROM s)"
sims = lambda t: t.lineitem.groupBy(c("l_partkey").alias("key")).agg(F.round(F.max("l_discount"), 6).alias("sim"), F.count("*").alias("n"))
query("srt_similarity", SIMS + " SELECT key, sim, n FROM o ORDER BY r")(lambda t: sims(t).orderBy("sim", "n", "key"))
query("srt_mergesort_multi", "SELECT l_returnflag, l_quantity, l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY ALL")(lambda t: t.lineitem.select("l_returnflag", "l_quantity", "l_orderkey", "l_linenumber", "l_partkey").orderBy("l_returnflag", "l_quantity", "l_orderkey", "l_linenumber", "l_partkey"))
GREEDY = "f(r, total, key, took) AS (SELECT 0::BIGINT, 0::BIGINT, NULL::BIGINT, false UNION ALL SELECT o.r, CASE WHEN f.total + o.n <= {budget} THEN f.total + o.n ELSE f.total END, o.key, f.total + o.n <= {budget} FROM f JOIN o ON o.r = f.r + 1)"
query("sel_greedy_fill", SIMS.replace("WITH", "WITH RECURSIVE") + ", " + GREEDY.format(budget=5000) + " SELECT key FROM f WHERE took")(lambda t: S.greedy_fill(sims(t), [c("sim"), c("n"), c("key")], "n", F.lit(5000)).filter("taken").select("key"))
query("sel_topk_labels", PRED + ", q AS (SELECT label, count(*) AS n FROM p GROUP BY 1), x AS (SELECT b.query, b.label, row_number() OVER (PARTITION BY b.query ORDER BY b.score DESC, q.n DESC, b.label) AS rank FROM b JOIN q USING (label)) SELECT query, label, rank FROM x WHERE rank <= 20")(
    lambda t: S.rank_labels(predictions(t), predictions(t).groupBy("label").agg(F.count("*").alias("frequency")), 20).select("query", "label", c("rank").cast("long").alias("rank")))
query("sel_limit", "SELECT o_orderkey AS k FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")(lambda t: t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select(c("o_orderkey").alias("k")))
SPLIT_TARGETS = "[0.9::DOUBLE * {n}, 0.05::DOUBLE * {n}, 0.05::DOUBLE * {n}]"
CHANGE = "((a.f[s] + o.n) - a.t[s]) * ((a.f[s] + o.n) - a.t[s]) - (a.f[s] - a.t[s]) * (a.f[s] - a.t[s])"
#: A walk over the groups g (g, n) in order of hash, with the rows of each split so far; s runs over the splits that may be chosen.
BALANCED = ("o AS (SELECT g, n, row_number() OVER (ORDER BY sha256('42|' || g)) AS r, count(*) OVER () AS c FROM g), "
            "a(r, f, t, g, n, s) AS (SELECT 0::BIGINT, [0, 0, 0]::BIGINT[], " + SPLIT_TARGETS.format(n="(SELECT sum(n) FROM g)") + ", NULL::VARCHAR, 0::BIGINT, 0::BIGINT UNION ALL "
            "SELECT o.r, list_transform([1, 2, 3], lambda j: a.f[j] + CASE WHEN j = z.s THEN o.n ELSE 0 END)::BIGINT[], a.t, o.g, o.n::BIGINT, z.s::BIGINT FROM a JOIN o ON o.r = a.r + 1, "
            "LATERAL (SELECT list_sort(list_transform(list_filter([1, 2, 3], lambda s: a.f[s] = 0 OR len(list_filter(a.f, lambda v: v = 0)) < o.c - a.r), lambda s: {'cost': " + CHANGE + ", 's': s}))[1].s AS s) z)")  # fmt: skip
query("sel_balanced_assign", "WITH RECURSIVE g AS (SELECT o_custkey::VARCHAR AS g, count(*) AS n FROM orders GROUP BY 1), " + BALANCED + " SELECT g, n, ['train', 'val', 'test'][s] AS split FROM a WHERE r > 0")(lambda t: S.balanced_assign(t.orders.groupBy(c("o_custkey").cast("string").alias("g")).agg(F.count("*").alias("n")), "g", "n", {"train": 0.9, "val": 0.05, "test": 0.05}))
LIGHTEST = ("WITH RECURSIVE o AS (SELECT length(text) AS n, row_number() OVER (ORDER BY length(text) DESC, doc_id) AS r FROM documents), "
            "a(r, f, n, b) AS (SELECT 0::BIGINT, list_transform(range(8), lambda i: 0)::BIGINT[], 0::BIGINT, 0::BIGINT UNION ALL "
            "SELECT o.r, list_transform(range(1, 9), lambda j: a.f[j] + CASE WHEN j = list_position(a.f, list_min(a.f)) THEN o.n * o.n ELSE 0 END)::BIGINT[], o.n::BIGINT, list_position(a.f, list_min(a.f)) - 1 FROM a JOIN o ON o.r = a.r + 1) ")  # fmt: skip
query("sel_lpt_partition", LIGHTEST + "SELECT n AS length, b AS bin, count(*) AS n FROM a WHERE r > 0 GROUP BY 1, 2")(lambda t: S.lightest_bin(t.documents.groupBy(F.char_length("text").alias("length")).agg(F.count("*").alias("n")), 8))
BUCKETS = ("WITH RECURSIVE o AS (SELECT doc_id, length(text) AS n, row_number() OVER (ORDER BY length(text), doc_id) AS r FROM documents), "
           "a(r, doc_id, bucket, held) AS (SELECT 0::BIGINT, NULL::BIGINT, 0::BIGINT, 0::BIGINT UNION ALL "
           "SELECT o.r, o.doc_id, CASE WHEN z.cut THEN a.bucket + 1 ELSE a.bucket END, CASE WHEN z.cut THEN 1 ELSE a.held + 1 END FROM a JOIN o ON o.r = a.r + 1, LATERAL (SELECT a.held > 0 AND (a.held >= 20 OR (a.held + 1) * (o.n + 2) > 30000) AS cut) z) ")  # fmt: skip
query("sel_length_bucket", BUCKETS + "SELECT doc_id, bucket FROM a WHERE r > 0")(lambda t: S.length_buckets(t.documents.select("doc_id", F.char_length("text").alias("n")), "doc_id", "n", 30_000, 20))
NEGATIVES = ("WITH RECURSIVE p AS (SELECT s_suppkey AS k, s_nationkey AS own FROM supplier), q AS (SELECT k, n_nationkey AS cand, round(1 - abs(own - n_nationkey) / 25, 9) AS sim FROM p JOIN nation ON n_nationkey <> own), "
             "l AS (SELECT own AS cand, 2 * count(*) AS most FROM p GROUP BY 1), "
             "v AS (SELECT *, CASE WHEN sim >= 0.9 THEN 0 ELSE least(18, ceil(round((0.9 - sim) / 0.05, 9)))::INT END AS level FROM q WHERE sim <= 0.95), "
             "u AS (SELECT k, level, sum(count(*)) OVER (PARTITION BY k ORDER BY level) AS upto FROM v GROUP BY 1, 2), w AS (SELECT k, coalesce(min(level) FILTER (upto >= 2), max(level)) AS reach FROM u GROUP BY 1), "
             "d AS (SELECT v.k, v.cand, l.most, row_number() OVER (ORDER BY md5('42:' || v.k || ':' || v.cand), v.k) AS r FROM v JOIN w USING (k) JOIN l USING (cand) WHERE level <= reach), "
             "a(r, k, cand, ks, cs, took) AS (SELECT 0::BIGINT, 0::BIGINT, 0::BIGINT, MAP {0::BIGINT: 0::BIGINT}, MAP {0::BIGINT: 0::BIGINT}, false UNION ALL "
             "SELECT d.r, d.k::BIGINT, d.cand::BIGINT, CASE WHEN z.ok THEN map_concat(a.ks, MAP {d.k::BIGINT: coalesce(a.ks[d.k], 0) + 1}) ELSE a.ks END, CASE WHEN z.ok THEN map_concat(a.cs, MAP {d.cand::BIGINT: coalesce(a.cs[d.cand], 0) + 1}) ELSE a.cs END, z.ok FROM a JOIN d ON d.r = a.r + 1, "
             "LATERAL (SELECT coalesce(a.ks[d.k], 0) < 2 AND coalesce(a.cs[d.cand], 0) < d.most AS ok) z) SELECT k, cand FROM a WHERE took")  # fmt: skip


@query("sel_negative_sampling", NEGATIVES)
def _(t):
    positives = t.supplier.select(c("s_suppkey").alias("k"), c("s_nationkey").alias("cand"))
    pairs = positives.withColumnRenamed("cand", "own").join(F.broadcast(t.nation.select(c("n_nationkey").alias("cand"))), c("own") != c("cand"))
    return S.negatives(positives, pairs.select("k", "cand", F.round(1 - F.abs(c("own") - c("cand")) / 25, 9).alias("sim")), 0.9, 0.95, 0.05, 2)
