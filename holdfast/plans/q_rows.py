"""Queries of filters, projections, joins, set operations and explodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from holdfast.functions import keys as K
from holdfast.operators import clean as C
from holdfast.operators import joins as J
from holdfast.operators.frames import first_per_key, top_per_key
from holdfast.plans.registry import over, query

c = F.col

rows_n, head_n = over("lineitem", "l_orderkey AS k", "l_linenumber AS n", "CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END AS a", "CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_returnflag END AS b")
query("flt_drop_nulls", head_n + "SELECT k, n, a, b FROM i WHERE a IS NOT NULL AND b IS NOT NULL")(lambda t: rows_n(t).na.drop(subset=["a", "b"]))
query("flt_isin", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")(
    lambda t: C.is_in(t.orders.select("o_orderkey", "o_custkey"), t.customer.filter("c_mktsegment = 'BUILDING'").select(c("c_custkey").alias("o_custkey")), "o_custkey"))
query("flt_not_isin", "SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")(
    lambda t: C.is_not_in(t.part.select("p_partkey", "p_name"), t.lineitem.filter("l_returnflag = 'R'").select(c("l_partkey").alias("p_partkey")), "p_partkey"))
rows_t, head_t = over("lineitem", "l_orderkey AS k", "l_linenumber AS n", "CASE WHEN l_partkey % 11 = 0 THEN 'warm' ELSE concat(l_quantity * 3 + 250) END AS temp", "concat(l_quantity / 3) AS ph")


@query("flt_implausible_null", head_t.replace("concat(l_quantity * 3 + 250)", "(l_quantity * 3 + 250)::VARCHAR").replace("concat(l_quantity / 3)", "(l_quantity / 3)::VARCHAR")
       + "SELECT k, n, CASE WHEN TRY_CAST(temp AS DOUBLE) BETWEEN 273.15 AND 373.15 THEN TRY_CAST(temp AS DOUBLE) END AS temp, CASE WHEN TRY_CAST(ph AS DOUBLE) BETWEEN 0 AND 14 THEN round(TRY_CAST(ph AS DOUBLE), 9) END AS ph FROM i")
def _(t):
    return rows_t(t).select("k", "n", C.plausible(c("temp"), *C.TEMPERATURE).alias("temp"), F.round(C.plausible(c("ph"), *C.PH), 9).alias("ph"))


query("flt_non_positive", "SELECT c_custkey AS k, round(log10(c_acctbal), 9) AS v FROM customer WHERE c_acctbal > 0")(
    lambda t: t.customer.filter("c_acctbal > 0").select(c("c_custkey").alias("k"), F.round(F.log10("c_acctbal"), 9).alias("v")).filter(~F.isnan("v")))
rows_q, head_q = over("part", "p_partkey AS k", "CASE WHEN p_size % 5 = 0 THEN concat('>', p_size) WHEN p_size % 5 = 1 THEN concat('= 1,', 100 + p_size) WHEN p_size % 5 = 2 THEN 'n.a.' ELSE concat(' ', p_size, '.25') END AS x")
query("flt_qualified_value", head_q + r"SELECT k, CASE WHEN NOT regexp_matches(trim(x), '^[<>]') THEN TRY_CAST(regexp_replace(regexp_replace(x, '[,\s]', '', 'g'), '^=', '') AS DOUBLE) END AS v FROM i")(
    lambda t: rows_q(t).select("k", C.qualified_value(c("x")).alias("v")))
rows_p, head_p = over("part", "p_partkey AS k", "CASE WHEN p_size % 4 = 0 THEN 5.5 * pow(10.0, p_size % 7) ELSE p_retailprice END AS x", "p_brand AS source")
query("flt_placeholder", head_p.replace("5.5 *", "5.5::DOUBLE *") + "SELECT k, source, CASE WHEN source = 'Brand#2' OR NOT abs(log10(x / 5.5) - round(log10(x / 5.5))) < 1e-9 THEN x END AS v FROM i")(
    lambda t: rows_p(t).select("k", "source", F.when((c("source") == "Brand#2") | ~C.placeholder(c("x").cast("double")), c("x").cast("double")).alias("v")))
rows_l, head_l = over("part", "p_partkey AS k", "concat(p_size % 9, '.', p_size % 20, '.', CASE WHEN p_size % 6 = 0 THEN '-' ELSE '3' END, CASE WHEN p_partkey % 4 = 0 THEN '.n1' WHEN p_partkey % 4 = 1 THEN '' ELSE concat('.', p_partkey % 50) END) AS x")
query("flt_full_label", head_l + "SELECT k, x FROM i WHERE NOT contains(x, '-') AND len(string_split(x, '.')) = 4")(lambda t: rows_l(t).filter(C.full_label(c("x"))))
query("flt_numeric_label", head_l + r"SELECT k, x FROM i WHERE regexp_full_match(x, '\d+\.\d+\.\d+\.\d+')")(lambda t: rows_l(t).filter(C.numeric_label(c("x"))))
query("flt_partial_label_drop", head_l + "SELECT k, x FROM i WHERE NOT contains(x, '-') AND split_part(x, '.', 1)::INT BETWEEN 1 AND 7")(
    lambda t: rows_l(t).filter(~F.contains("x", F.lit("-")) & F.split_part("x", F.lit("."), F.lit(1)).try_cast("int").between(1, 7)))
#: Molecules of which it is known whether they are small or inorganic.
MOLECULES = "(VALUES (0, 'O', true), (1, 'CCO', true), (2, 'CCCC', false), (3, '[Na+].[Cl-]', true), (4, 'c1ccccc1', false), (5, 'OS(=O)(=O)O', true), (6, 'not a molecule', false), (7, 'C[C@H](N)C(=O)O', false), (8, 'ClC(Cl)(Cl)Cl', false), (9, '[2H]O[2H]', true), (10, 'C(C', false), (11, NULL, false), (12, 'O=[Si]=O', true), (13, 'N[C@@H](C)C(Br)=O', false)) m(i, x, tiny)"
query("flt_tiny", f"SELECT p_partkey AS k, x FROM part JOIN {MOLECULES} ON i = p_partkey % 14 WHERE NOT tiny")(
    lambda t: t.part.join(F.broadcast(t.spark.sql(f"SELECT i, x FROM {MOLECULES}")), c("p_partkey") % 14 == c("i")).select(c("p_partkey").alias("k"), "x").filter(~C.tiny(c("x"))))
query("flt_has_any", "WITH m AS (SELECT l_partkey, max(l_shipdate) AS d FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT p_partkey AS k FROM part LEFT JOIN m ON p_partkey = l_partkey WHERE coalesce(CASE WHEN p_size % 2 = 0 THEN p_brand END, d::VARCHAR) IS NOT NULL")(
    lambda t: t.part.join(t.lineitem.filter("l_returnflag = 'R'").groupBy("l_partkey").agg(F.max("l_shipdate").cast("string").alias("d")), c("p_partkey") == c("l_partkey"), "left")
    .filter(F.coalesce(F.when(c("p_size") % 2 == 0, c("p_brand")), c("d")).isNotNull()).select(c("p_partkey").alias("k")))
rows_v, head_v = over("events", "event_id AS k", "CASE WHEN event_id % 13 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 17 = 0 THEN NULL ELSE value END AS x")
query("flt_low_confidence", head_v + "SELECT k FROM i WHERE x IS NOT NULL AND NOT isnan(x) AND x >= 20")(lambda t: rows_v(t).filter(~C.low_confidence(c("x"), 20.0)).select("k"))

query("prj_rename_drop", "SELECT c_custkey AS id, c_name AS name FROM customer")(lambda t: t.customer.withColumnsRenamed({"c_custkey": "id", "c_name": "name"}).drop("c_nationkey", "c_acctbal", "c_mktsegment", "absent"))
query("prj_row_hash_key", "SELECT count(*) AS n_rows, count(DISTINCT (l_orderkey, l_linenumber, l_partkey)) AS n_keys FROM lineitem")(
    lambda t: t.lineitem.select(F.sha2(F.to_json(F.struct("l_orderkey", "l_linenumber", "l_partkey")), 256).alias("h")).agg(F.count("*").alias("n_rows"), F.count_distinct("h").alias("n_keys")))
query("prj_row_index", "SELECT count(*) AS n, count(*) AS n_ids FROM lineitem")(lambda t: t.lineitem.withColumn("i", F.monotonically_increasing_id()).agg(F.count("*").alias("n"), F.count_distinct("i").alias("n_ids")))
query("prj_default_when_null", head_n + "SELECT k, n, coalesce(CASE WHEN n = 2 THEN 0.0::DOUBLE ELSE a END, 7.5::DOUBLE) AS v FROM i")(lambda t: rows_n(t).select("k", "n", F.coalesce(F.when(c("n") == 2, F.lit(0.0)).otherwise(c("a")), F.lit(7.5)).alias("v")))
query("prj_fill_defaults", head_n + "SELECT k, n, coalesce(a, 298.15::DOUBLE) AS a, coalesce(b, 'none') AS b FROM i")(lambda t: rows_n(t).na.fill({"a": 298.15, "b": "none"}))
query("prj_unit_convert", "SELECT l_orderkey AS k, l_linenumber AS n, round(l_extendedprice / 1000000.0::DOUBLE, 9) AS mm, round(l_quantity + 273.15::DOUBLE, 6) AS kelvin FROM lineitem")(
    lambda t: t.lineitem.select(c("l_orderkey").alias("k"), c("l_linenumber").alias("n"), F.round(c("l_extendedprice") / 1e6, 9).alias("mm"), F.round(c("l_quantity") + 273.15, 6).alias("kelvin")))
rows_u, head_u = over("lineitem", "l_orderkey AS k", "l_linenumber AS n", "l_quantity AS ki", "CASE WHEN l_linenumber % 2 = 0 THEN l_discount END AS kd", "CASE WHEN l_linenumber % 3 = 0 THEN l_tax END AS ic50")
query("prj_case_unpivot", head_u + "SELECT * FROM (UNPIVOT i ON ki, kd, ic50 INTO NAME value_type VALUE value)")(lambda t: C.unpivot_present(rows_u(t), ["k", "n"], ["ki", "kd", "ic50"]))
query("prj_coalesce_id", "SELECT p_partkey AS k, coalesce('B:' || CASE WHEN p_size % 3 = 0 THEN p_brand END, 'T:' || CASE WHEN p_size % 3 = 1 THEN p_type END, 'N:' || p_name) AS v FROM part")(
    lambda t: t.part.select(c("p_partkey").alias("k"), C.prefixed_id([("B:", F.when(c("p_size") % 3 == 0, c("p_brand"))), ("T:", F.when(c("p_size") % 3 == 1, c("p_type"))), ("N:", c("p_name"))]).alias("v")))

# Joins
query("join_inner_map", "SELECT p_partkey AS k, substr(sha256(p_name), 1, 24) AS key FROM part WHERE contains(p_name, 'e')")(
    lambda t: J.inner_map(t.part.select(c("p_partkey").alias("k"), "p_name"), t.part.select("p_name").distinct().filter(F.contains("p_name", F.lit("e"))).withColumn("key", K.sha256_short(c("p_name"))), "p_name").select("k", "key"))
EDGES = "WITH s AS (SELECT l_suppkey, l_partkey, max(l_quantity) AS score FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2), m AS (SELECT l_partkey, max(score) AS sim FROM s GROUP BY 1) "


@query("join_left_similarity", EDGES + "SELECT p_partkey AS k, coalesce(sim, 0.0::DOUBLE) AS sim, sim IS NOT NULL AS has_hit FROM part LEFT JOIN m ON p_partkey = l_partkey")
def _(t):
    m = t.lineitem.filter("l_returnflag = 'A'").groupBy("l_partkey").agg(F.max("l_quantity").alias("sim"))
    return J.left_similarity(t.part.select(c("p_partkey").alias("k")), m.withColumnRenamed("l_partkey", "k"), "k", "sim", "has_hit")


LISTS = "WITH g AS (SELECT l_orderkey, string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) AS v FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) "


@query("join_left_struct_key", LISTS + "SELECT o_orderkey AS k, coalesce(v, '') AS v FROM orders LEFT JOIN g ON o_orderkey = l_orderkey")
def _(t):
    return J.left_lists(t.orders.select(c("o_orderkey").alias("k")), t.lineitem.filter("l_returnflag = 'N'").select(c("l_orderkey").alias("k"), c("l_partkey").cast("string").alias("v")), ["k"], "v").withColumn("v", F.array_join("v", ","))


rows_mg, head_mg = over("orders", "o_custkey AS k", "CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS p", "CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderstatus END AS v")
query("join_merge_left_list", head_mg + ", d AS (SELECT DISTINCT k, p FROM i), g AS (SELECT k, p, string_agg(DISTINCT v, ',' ORDER BY v) AS v FROM i WHERE v IS NOT NULL GROUP BY 1, 2) SELECT d.k, d.p, coalesce(g.v, '') AS v FROM d LEFT JOIN g ON d.k = g.k AND d.p IS NOT DISTINCT FROM g.p")(
    lambda t: J.left_lists(rows_mg(t).select("k", "p").distinct(), rows_mg(t).filter("v is not null"), ["k", "p"], "v").withColumn("v", F.array_join("v", ",")))
query("join_id_mapping_twice", "SELECT c_name AS a, s_name AS b, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2")(
    lambda t: J.map_ends(t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey")).select(c("o_custkey").alias("query"), c("l_suppkey").alias("target")), t.customer.select(c("c_custkey").alias("id"), c("c_name").alias("name")), t.supplier.select(c("s_suppkey").alias("id"), c("s_name").alias("name")))
    .groupBy(c("query_name").alias("a"), c("target_name").alias("b")).agg(F.count("*").alias("n")))
query("join_own_edges", "SELECT l_orderkey AS k, l_partkey AS q, l_suppkey AS s FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 25) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")(
    lambda t: C.is_in(C.is_in(t.lineitem.select(c("l_orderkey").alias("k"), c("l_partkey").alias("q"), c("l_suppkey").alias("s")), t.part.filter("p_size < 25").select(c("p_partkey").alias("q")), "q"), t.supplier.filter("s_acctbal > 0").select(c("s_suppkey").alias("s")), "s"))
query("join_self_same_group", "SELECT DISTINCT a.s_suppkey AS q, b.s_suppkey AS t FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey")(lambda t: J.same_group_pairs(t.supplier.select(c("s_suppkey").alias("id"), c("s_nationkey").alias("g"))))


@query("join_anti_pairs", "WITH e AS (SELECT DISTINCT l_partkey % 100 AS q, l_suppkey AS t FROM lineitem), s AS (SELECT a.s_suppkey AS q, b.s_suppkey AS t FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey) SELECT q, t FROM e ANTI JOIN s USING (q, t)")
def _(t):
    e = t.lineitem.select((c("l_partkey") % 100).alias("q"), c("l_suppkey").alias("t")).distinct()
    return J.without_same_group(e, t.supplier.select(c("s_suppkey").alias("id"), c("s_nationkey").alias("g")))


query("join_semi_keys", "SELECT DISTINCT p_name AS k FROM part WHERE sha256(p_name) NOT IN (SELECT sha256(p_name) FROM part WHERE p_size > 45)")(
    lambda t: J.missing_keys(t.part.select(c("p_name").alias("k")).distinct(), t.part.filter("p_size > 45").select(F.sha2("p_name", 256).alias("key_hash")).distinct(), "k"))


@query("join_candidate_priority", "WITH s AS (SELECT DISTINCT p_type AS key, 1 AS src FROM part WHERE p_size < 3 UNION ALL SELECT DISTINCT p_brand, 2 FROM part WHERE p_size < 20) "
       "SELECT p_partkey AS k, arg_min(s.key, c.pri) AS key FROM (SELECT p_partkey, p_type AS key, 1 AS pri FROM part UNION ALL SELECT p_partkey, p_brand, 2 FROM part) c JOIN s ON s.key = c.key GROUP BY 1")  # fmt: skip
def _(t):
    store = t.part.filter("p_size < 3").select(c("p_type").alias("key")).union(t.part.filter("p_size < 20").select("p_brand")).distinct()
    return J.by_candidates(t.part.select(c("p_partkey").alias("k"), F.array("p_type", "p_brand").alias("candidates")), store, "candidates", "key").select("k", "key")


@query("join_hash_fallback", "WITH s AS (SELECT DISTINCT substr(sha256(p_name), 1, 24) AS h FROM part WHERE p_size % 2 = 0 UNION SELECT DISTINCT substr(sha256(upper(p_name)), 1, 24) FROM part) "
       "SELECT p_partkey AS k, arg_min(h, pri) AS key FROM (SELECT p_partkey, substr(sha256(p_name), 1, 24) AS h, 1 AS pri FROM part UNION ALL SELECT p_partkey, substr(sha256(upper(p_name)), 1, 24), 2 FROM part) JOIN s USING (h) GROUP BY 1")  # fmt: skip
def _(t):
    short = K.sha256_short
    store = t.part.filter("p_size % 2 = 0").select(short(c("p_name")).alias("key")).union(t.part.select(short(F.upper("p_name")))).distinct()
    return J.by_candidates(t.part.select(c("p_partkey").alias("k"), F.array(short(c("p_name")), short(F.upper("p_name"))).alias("candidates")), store, "candidates", "key").select("k", "key")


@query("join_incremental_dedupe", "WITH a AS (SELECT p_name AS key, min(p_partkey) AS id FROM part WHERE p_size < 20 GROUP BY 1), b AS (SELECT p_name AS key, max(p_partkey) AS bid FROM part WHERE p_size >= 10 GROUP BY 1) "
       "SELECT a.key, id, bid, 'a' AS source FROM a LEFT JOIN b ON a.key = b.key UNION ALL SELECT b.key, NULL, bid, 'b' FROM b ANTI JOIN a ON a.key = b.key")  # fmt: skip
def _(t):
    a = t.part.filter("p_size < 20").groupBy(c("p_name").alias("key")).agg(F.min("p_partkey").alias("id"))
    b = t.part.filter("p_size >= 10").groupBy(c("p_name").alias("key")).agg(F.max("p_partkey").alias("bid"))
    return J.add_new(a, b, "key")


query("join_merge_left_conditions", "SELECT o_orderkey AS k, n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_discount > 0.05 GROUP BY 1) ON o_orderkey = l_orderkey")(
    lambda t: t.orders.select(c("o_orderkey").alias("k")).join(t.lineitem.filter("l_discount > 0.05D").groupBy(c("l_orderkey").alias("k")).agg(F.count("*").alias("n")), "k", "left"))
query("join_name_exact_ci", "WITH n AS (SELECT lower(trim(p_name)) AS name, min(p_partkey) AS id FROM part GROUP BY 1) SELECT p_partkey AS k, id FROM part JOIN n ON lower(trim(' ' || upper(p_name) || ' ')) = name")(
    lambda t: J.by_name(t.part.select(c("p_partkey").alias("k"), F.concat(F.lit(" "), F.upper("p_name"), F.lit(" ")).alias("name")), t.part.select(c("p_partkey").alias("id"), c("p_name").alias("name"))).select("k", "id"))

# Sets
query("set_union_all", "SELECT c_name AS name, c_acctbal AS v FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier")(lambda t: t.customer.select(c("c_name").alias("name"), c("c_acctbal").alias("v")).unionByName(t.supplier.select(c("s_acctbal").alias("v"), c("s_name").alias("name"))))
query("set_union_missing_cols", "SELECT c_name AS name, c_mktsegment AS seg FROM customer UNION ALL SELECT s_name, NULL FROM supplier")(lambda t: t.customer.select(c("c_name").alias("name"), c("c_mktsegment").alias("seg")).unionByName(t.supplier.select(c("s_name").alias("name")), allowMissingColumns=True))
query("set_distinct", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")(lambda t: t.lineitem.select("l_partkey", "l_suppkey").distinct())
query("set_distinct_on", "SELECT o_custkey AS k, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first FROM orders GROUP BY 1")(lambda t: first_per_key(t.orders.select(c("o_custkey").alias("k"), c("o_orderkey").alias("first"), "o_orderdate"), ["k"], [c("o_orderdate"), c("first")]).select("k", "first"))
query("set_superset_keys", "SELECT DISTINCT v FROM (SELECT p_name AS v FROM part UNION ALL SELECT unnest(string_split(p_name, ' ')) FROM part UNION ALL SELECT c_mktsegment FROM customer) WHERE v <> '' ORDER BY v")(
    lambda t: J.superset_keys([(t.part, "p_name"), (t.part.select(F.split("p_name", " ").alias("w")), "w"), (t.customer, "c_mktsegment")]))
query("set_difference", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")(lambda t: t.part.select(c("p_partkey").alias("k")).subtract(t.lineitem.filter("l_quantity > 45").select(c("l_partkey").alias("k"))))
query("set_intersection_check", "SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")(lambda t: t.lineitem.filter("l_returnflag = 'A'").select(c("l_partkey").alias("k")).intersect(t.lineitem.filter("l_returnflag = 'R'").select("l_partkey")))

# Explodes
query("exp_list", "SELECT p_partkey AS k, unnest(string_split(p_name, ' ')) AS v FROM part")(lambda t: t.part.select(c("p_partkey").alias("k"), F.explode(F.split("p_name", " ")).alias("v")))
query("exp_split", "SELECT p_partkey AS k, trim(v) AS v FROM (SELECT p_partkey, unnest(string_split(p_brand || '; ' || p_type || ';', ';')) AS v FROM part) WHERE trim(v) <> ''")(lambda t: t.part.select(c("p_partkey").alias("k"), F.explode(K.sorted_strings(F.split(F.concat("p_brand", F.lit("; "), "p_type", F.lit(";")), ";"))).alias("v")))
query("exp_inline", "SELECT p_partkey AS k, 'brand' AS name, p_brand AS v FROM part UNION ALL SELECT p_partkey, 'type', p_type FROM part")(
    lambda t: t.part.select(c("p_partkey").alias("k"), F.inline(F.array(F.struct(F.lit("brand").alias("name"), c("p_brand").alias("v")), F.struct(F.lit("type").alias("name"), c("p_type").alias("v"))))))
query("exp_wide_columns", "SELECT p_partkey AS k, 1 AS chain, p_brand AS v FROM part UNION ALL SELECT p_partkey, 2, p_type FROM part WHERE p_size % 2 = 0")(
    lambda t: t.part.selectExpr("p_partkey AS k", "stack(2, 1, p_brand, 2, CASE WHEN p_size % 2 = 0 THEN p_type END) AS (chain, v)").filter("v is not null"))
query("lk_explode_missing", "SELECT unnest(string_split(p_name, ' ')) AS v, p_partkey AS k FROM part WHERE p_size % 4 = 0")(lambda t: t.part.withColumn("kind", F.when(c("p_size") % 4 != 0, c("p_type"))).filter("kind is null").select(F.explode(F.split("p_name", " ")).alias("v"), c("p_partkey").alias("k")))
query("dc_explode_two", "SELECT k, a, unnest(string_split(b, '#')) AS b FROM (SELECT p_partkey AS k, unnest(string_split(p_name, ' ')) AS a, p_brand AS b FROM part)")(
    lambda t: t.part.select(c("p_partkey").alias("k"), F.explode_outer(F.split("p_name", " ")).alias("a"), "p_brand").select("k", "a", F.explode_outer(F.split("p_brand", "#")).alias("b")))
query("dc_chain_split", "SELECT p_partkey AS k, trim(unnest(string_split(replace(p_name, ' ', ' and '), ' and '))) AS v FROM part")(lambda t: t.part.select(c("p_partkey").alias("k"), F.explode(F.split(F.replace("p_name", F.lit(" "), F.lit(" and ")), " and ")).alias("v")))
query("dc_id_replace", "WITH m AS (SELECT DISTINCT p_type AS a, 'T' || length(p_type) AS b FROM part WHERE length(p_type) > 5) SELECT p_partkey AS k, p_brand || ',' || coalesce(b, p_type) AS v FROM part LEFT JOIN m ON p_type = a")(
    lambda t: J.replace_in_lists(t.part.select(c("p_partkey").alias("k"), F.array("p_brand", "p_type").alias("ids")), t.part.select(c("p_type").alias("old")).distinct().filter("length(old) > 5").withColumn("new", F.concat(F.lit("T"), F.length("old").cast("string"))), "k", "ids").select("k", F.array_join("ids", ",").alias("v")))
query("dc_stoich_repeat", "SELECT p_partkey AS k, array_to_string(list_concat(list_transform(range(p_size % 3 + 1), lambda z: p_type), [p_brand]), '.') AS v FROM part")(
    lambda t: t.part.select(c("p_partkey").alias("k"), F.array_join(F.flatten(F.transform(F.array(F.struct((c("p_size") % 3 + 1).alias("n"), c("p_type").alias("id")), F.struct(F.lit(1).alias("n"), c("p_brand").alias("id"))), lambda s: F.array_repeat(s["id"], s["n"]))), ".").alias("v")))
query("dc_multi_merge", "SELECT l_orderkey AS k, l_linenumber AS n, s_name, p_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey WHERE CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_name END IS NOT NULL")(
    lambda t: t.lineitem.join(t.supplier, c("l_suppkey") == c("s_suppkey")).join(t.part.withColumn("p_name", F.when(c("p_size") % 3 != 0, c("p_name"))), c("l_partkey") == c("p_partkey")).join(t.orders, c("l_orderkey") == c("o_orderkey"))
    .select(c("l_orderkey").alias("k"), c("l_linenumber").alias("n"), "s_name", "p_name").na.drop())
query("dc_all_or_null", "SELECT l_orderkey AS k, CASE WHEN bool_and(l_quantity > 3) THEN string_agg(l_partkey::VARCHAR, '.' ORDER BY l_partkey::VARCHAR) END AS v FROM lineitem GROUP BY 1")(
    lambda t: t.lineitem.groupBy(c("l_orderkey").alias("k")).agg(F.when(F.bool_and(c("l_quantity") > 3), F.array_join(F.array_sort(F.collect_list(c("l_partkey").cast("string"))), ".")).alias("v")))
query("lk_group_fanout", "SELECT p_partkey AS k, sha256(p_name) AS v FROM part")(lambda t: J.inner_map(t.part.select(c("p_partkey").alias("k"), "p_name"), t.part.select("p_name").distinct().withColumn("v", F.sha2("p_name", 256)), "p_name").select("k", "v"))

# Ranks and windows
query("win_first_per_key", "SELECT p_brand AS k, arg_min(p_partkey, (p_size % 3, -p_retailprice, p_partkey)) AS first FROM part GROUP BY 1")(
    lambda t: first_per_key(t.part.withColumnsRenamed({"p_brand": "k", "p_partkey": "first"}), ["k"], [c("p_size") % 3, c("p_retailprice").desc_nulls_last(), c("first")]).select("k", "first"))
query("win_best_partial", "SELECT l_orderkey AS k, arg_max(l_partkey, (l_discount, -l_linenumber, -l_partkey)) AS best FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_discount >= 0.08) GROUP BY 1")(
    lambda t: first_per_key(C.is_not_in(t.lineitem, t.lineitem.filter("l_discount >= 0.08D"), "l_orderkey"), ["l_orderkey"], [c("l_discount").desc(), c("l_linenumber"), c("l_partkey")]).select(c("l_orderkey").alias("k"), c("l_partkey").alias("best")))
query("win_topn_per_group", "SELECT * FROM (SELECT l_suppkey AS q, l_orderkey AS t, l_linenumber AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem) WHERE rank <= 50")(
    lambda t: top_per_key(t.lineitem, ["l_suppkey"], [c("l_extendedprice").desc(), c("l_orderkey"), c("l_linenumber"), c("l_partkey")], 50).select(c("l_suppkey").alias("q"), c("l_orderkey").alias("t"), c("l_linenumber").alias("n"), c("rank").cast("long").alias("rank")))
