"""Queries of sources and sinks, stores, structures, run control and parsing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions.records import article_records
from holdfast.operators import runs as R
from holdfast.operators import store as S
from holdfast.operators import structures as X
from holdfast.operators.clean import is_in
from holdfast.plans.registry import over, query
from holdfast.sources import io, shared

c = F.col

# Sources and sinks
query("src_parquet", "SELECT * FROM customer")(lambda t: t.customer)
query("src_parquet_cols", "SELECT l_orderkey, l_quantity FROM lineitem")(lambda t: io.read_columns(t.spark, t.path("lineitem"), ["l_orderkey", "l_quantity"]))
query("src_parquet_batches", "SELECT c_custkey, c_acctbal * 2 AS twice FROM customer")(lambda t: io.map_batches(t.customer.select("c_custkey", "c_acctbal"), _twice, "c_custkey long, twice double"))
query("src_parquet_meta", "SELECT count(*) AS n FROM lineitem")(lambda t: t.lineitem.agg(F.count("*").alias("n")))
query("src_multi_union", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")(
    lambda t: t.customer.select(c("c_nationkey").alias("k")).unionByName(t.supplier.select(c("s_nationkey").alias("k"))))


def _twice(batch):
    import pyarrow as pa
    import pyarrow.compute as pc

    return pa.RecordBatch.from_arrays([batch.column(0), pc.multiply(batch.column(1), 2.0)], names=["c_custkey", "twice"])


def tsv(t, df, name, **options):
    path = shared.scratch(t.spark, name)
    df.write.options(**options).csv(path, sep="\t")
    return path


query("src_tsv_typed", "SELECT l_partkey::INT AS query, l_suppkey::INT AS target, l_discount AS score FROM lineitem")(lambda t: io.read_hits(t.spark, tsv(t, t.lineitem.select("l_partkey", "l_suppkey", "l_discount"), "hits")))
query("src_tsv_lazy_coerce", "SELECT p_name AS query, p_type AS target, CASE WHEN p_size % 4 <> 0 THEN p_size / 10 END AS score FROM part")(
    lambda t: io.read_hits_coerced(t.spark, tsv(t, t.part.select(F.concat(F.lit(" "), "p_name", F.lit(" ")), "p_type", F.when(c("p_size") % 4 == 0, "n/a").otherwise(F.concat(F.lit(" "), (c("p_size") / 10).cast("string")))), "raw", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)))


@query("src_jsonl_tolerant", "SELECT event_id AS id, event_type AS kind FROM events WHERE event_id % 10 <> 9")
def _(t):
    path = shared.scratch(t.spark, "jsonl")
    line = F.to_json(F.struct(c("event_id").alias("id"), c("event_type").alias("kind")))
    t.events.select(F.when(c("event_id") % 10 == 9, F.substring(line, 1, 12)).otherwise(line)).write.text(path)
    return io.read_json_lines(t.spark, path, "id long, kind string")


query("src_gzip_scan_semijoin", "SELECT p_partkey::VARCHAR AS id, p_name AS value FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")(
    lambda t: io.scan_wanted(t.spark, tsv(t, t.part.select(c("p_partkey").cast("string"), "p_name"), "gz", compression="gzip"), t.lineitem.filter("l_quantity > 49").select(c("l_partkey").cast("string").alias("id"))))
LINES = "CASE WHEN p_size % 6 = 0 THEN '' WHEN p_size % 6 = 1 THEN '# note' WHEN p_size % 6 = 2 THEN concat(p_type, '  ', p_size) WHEN p_size % 6 = 3 THEN concat(p_type, ' x') WHEN p_size % 6 = 4 THEN concat(p_type, ' 0') ELSE p_type END"
REASON = "CASE WHEN value = '' THEN 'empty' WHEN value LIKE '#%' THEN 'comment' WHEN len(regexp_split_to_array(value, '\\s+')) <> 2 THEN 'fields' WHEN TRY_CAST(split_part(value, ' ', -1) AS INT) IS NULL THEN 'not a number' WHEN split_part(value, ' ', -1)::INT < 1 THEN 'too small' END"
rows_ln, head_ln = over("part", "p_partkey AS k", f"{LINES} AS value")
query("src_line_parse_reject", head_ln + f"SELECT k, {REASON} AS reason FROM i")(lambda t: io.parse_lines(rows_ln(t)).select("k", "reason"))
query("px_keep_reject", head_ln + f", r AS (SELECT {REASON} AS reason FROM i) SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM r GROUP BY 1")(
    lambda t: io.parse_lines(rows_ln(t)).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n")))


SPLIT_OF = "['train', 'val', 'test'][o_orderkey % 3 + 1]"


def named_splits(t):
    """A folder for each order status, the first of them under a threshold: its splits and, as stats, its rows."""
    root, marked = shared.scratch(t.spark, "splits"), t.orders.select("o_orderkey", "o_orderstatus", F.element_at(F.array(*map(F.lit, ("train", "val", "test"))), (c("o_orderkey") % 3 + 1).cast("int")).alias("split"))
    for name in sorted(r[0] for r in t.orders.select("o_orderstatus").distinct().collect()):
        own = marked.filter(c("o_orderstatus") == name).drop("o_orderstatus")
        io.write_named_splits(own, f"{root}/{name}" if name != "F" else f"{root}/F/threshold_0.5", {"rows": own.count()})
    return root


STATUSES = "(SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1)"
AT = "CASE WHEN status = 'F' THEN 'F/threshold_0.5' ELSE status END"
query("src_file_discovery", f"SELECT {AT} AS name FROM {STATUSES}")(lambda t: t.spark.createDataFrame([(x,) for x in io.find_splits(t.spark, named_splits(t))], "name string"))
query("dm_split_resolve", f"SELECT status, {AT} AS name FROM {STATUSES}")(
    lambda t: (lambda root: t.spark.createDataFrame([(x, io.resolve_split(t.spark, f"{root}/{x}")[len(root) + 1 :]) for x in shared.children(t.spark, root)], "status string, name string"))(named_splits(t)))
query("snk_named_splits", f"SELECT {AT} AS name, o_orderkey, {SPLIT_OF} AS split FROM (SELECT *, o_orderstatus AS status FROM orders)")(
    lambda t: (lambda root: reduce(DataFrame.unionByName, [t.spark.read.parquet(f"{root}/{x}/{s}.parquet").select(F.lit(x).alias("name"), "o_orderkey", F.lit(s).alias("split")) for x in io.find_splits(t.spark, root) for s in ("train", "val", "test")]))(named_splits(t)))
query("snk_manifest", f"SELECT {AT} AS name, n FROM {STATUSES}")(
    lambda t: (lambda root: t.spark.createDataFrame([(x, shared.read_json(t.spark, f"{root}/{x}/stats.json")["rows"]) for x in io.find_splits(t.spark, root)], "name string, n long"))(named_splits(t)))


def round_trip(t, df, partition_by=None):
    path = shared.scratch(t.spark, "table")
    io.write_parquet(df, path, partition_by)
    return t.spark.read.parquet(path)


query("snk_parquet_zstd", "SELECT * FROM supplier")(lambda t: round_trip(t, t.supplier))
query("snk_threshold_splits", "SELECT o_orderkey, o_orderkey % 2 AS threshold, o_orderstatus AS split FROM orders")(
    lambda t: round_trip(t, t.orders.select("o_orderkey", (c("o_orderkey") % 2).alias("threshold"), c("o_orderstatus").alias("split")), ["threshold", "split"]).withColumn("threshold", c("threshold").cast("long")))
query("snk_unify_nulls", "SELECT c_custkey AS k, c_name AS v FROM customer UNION ALL SELECT s_suppkey, NULL FROM supplier")(
    lambda t: (lambda a, b: a.unionByName(b))(*io.unify_nulls([t.customer.select(c("c_custkey").alias("k"), c("c_name").alias("v")), t.supplier.select(c("s_suppkey").alias("k"), F.lit(None).alias("v"))])))
query("snk_atomic", "SELECT count(*) || ' orders' AS text, 1::BIGINT AS files FROM orders")(lambda t: t.spark.createDataFrame([_rewritten(t)], "text string, files long"))


def _rewritten(t):
    """A file written twice: its text, and how many files that leaves."""
    folder = shared.scratch(t.spark, "file")
    shared.write_text(t.spark, f"{folder}/x.txt", "older")
    shared.write_text(t.spark, f"{folder}/x.txt", f"{t.orders.count()} orders")
    return shared.read_text(t.spark, f"{folder}/x.txt"), len(shared.children(t.spark, folder))


query("snk_fasta_smi", "SELECT '>' || p_partkey || chr(10) || upper(replace(p_name, ' ', '')) AS line FROM part")(lambda t: t.part.select(io.fasta(c("p_partkey").cast("string"), F.upper(F.replace("p_name", F.lit(" "), F.lit("")))).alias("line")))
query("snk_dict_rows_csv", "SELECT r_name AS a, NULL::VARCHAR AS b FROM region UNION ALL SELECT NULL, n_name FROM nation")(lambda t: io.append_rows(t.region.select(c("r_name").alias("a")), t.nation.select(c("n_name").alias("b"))))
query("snk_npy_memmap", "SELECT vec_id AS k, 64 AS n, round(list_sum(embedding::DOUBLE[]), 4) AS s FROM embeddings")(
    lambda t: round_trip(t, t.embeddings.select(c("vec_id").alias("k"), "embedding")).select("k", F.size("embedding").alias("n"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v), 4).alias("s")))
query("src_vector_source", "SELECT vec_id AS key FROM embeddings")(lambda t: io.vector_source(t.embeddings, "vec_id", "embedding").select("key"))

# Stores
STORE = "WITH r AS (SELECT substr(sha256(p_name), 1, 24) AS key_hash, p_name AS key, p_partkey AS seq FROM part)"
stored = lambda t: t.part.select(S.key_hash(c("p_name")).alias("key_hash"), c("p_name").alias("key"), F.array(c("p_size").cast("float")).alias("vec"), c("p_partkey").alias("seq"))
query("sto_compact", STORE + " SELECT key_hash, min(seq) AS seq FROM r GROUP BY 1")(lambda t: S.compact(stored(t)).select("key_hash", "seq"))
query("sto_drop", STORE + " SELECT key, seq FROM r WHERE NOT contains(key, 'ring')")(lambda t: S.drop_keys(stored(t), t.part.filter(F.contains("p_name", F.lit("ring"))).select(c("p_name").alias("key"))).select("key", "seq"))
query("sto_failures", "SELECT p_name AS key, arg_max(p_type, p_partkey) AS error FROM part GROUP BY 1")(lambda t: S.last_failure(t.part.select(S.key_hash(c("p_name")).alias("key_hash"), c("p_name").alias("key"), c("p_type").alias("error"), c("p_partkey").alias("seq"))).select("key", "error"))
query("sto_reader", "WITH s AS (SELECT DISTINCT p_name AS key FROM part WHERE p_size < 4) SELECT DISTINCT p_name AS key, p_name IN (SELECT key FROM s) AS found FROM part")(lambda t: S.read(stored(t).filter("vec[0] < 4"), t.part.select(c("p_name").alias("key"))).select("key", "found"))
query("cch_superset", "SELECT DISTINCT key FROM (SELECT p_name AS key FROM part UNION ALL SELECT p_type FROM part)")(lambda t: t.part.select(c("p_name").alias("key")).union(t.part.select("p_type")).distinct())
query("cch_balance", "SELECT p_name AS k, sha256(p_name) AS v FROM (SELECT DISTINCT p_name FROM part)")(
    lambda t: (lambda memo, todo: memo.unionByName(todo.join(memo, "k", "left_anti").withColumn("v", F.sha2("k", 256))))(t.part.filter("p_size < 5").select(c("p_name").alias("k")).distinct().withColumn("v", F.sha2("k", 256)), t.part.select(c("p_name").alias("k")).distinct()))


def a_store(t):
    s = S.VectorStore(t.spark, shared.scratch(t.spark, "store"), 2)
    compute = lambda keys: ([[float(len(k)), 1.0] for k in keys], [None if "ring" not in k else "no ring" for k in keys])
    s.embed(t.part.filter("p_size < 10").select(c("p_name").alias("key")), compute, 1)
    s.embed(t.part.select(c("p_name").alias("key")), compute, 2)
    return s


HAS_RING = "contains(p_name, 'ring')"
query("sto_incremental_embed", f"SELECT DISTINCT p_name AS key FROM part WHERE {HAS_RING}")(lambda t: (lambda s: s.missing(t.part.select(c("p_name").alias("key"))).select("key"))(a_store(t)))
query("sto_put", f"SELECT DISTINCT p_name AS key, length(p_name) AS n FROM part WHERE NOT {HAS_RING}")(lambda t: a_store(t).vectors().select("key", c("vec")[0].cast("long").alias("n")))
query("sto_flush", f"WITH a AS (SELECT DISTINCT p_name FROM part WHERE p_size < 10 AND NOT {HAS_RING}), b AS (SELECT DISTINCT p_name FROM part WHERE NOT {HAS_RING} EXCEPT SELECT * FROM a) SELECT 1::BIGINT AS seq, count(*) AS vectors, count(DISTINCT substr(sha256(p_name), 1, 24)) AS indexed FROM a HAVING count(*) > 0 UNION ALL SELECT 2, count(*), count(DISTINCT substr(sha256(p_name), 1, 24)) FROM b HAVING count(*) > 0")(
    lambda t: (lambda s: s.rows().groupBy("seq").agg(F.count("*").alias("vectors")).join(s.index().groupBy("seq").agg(F.count_distinct("key_hash").alias("indexed")), "seq"))(a_store(t)))


def _staged_only(t):
    """A store whose flush was cut off after the checkpoint, opened again."""
    s = S.VectorStore(t.spark, shared.scratch(t.spark, "store"), 1)
    s.stage(t.part.select(c("p_name").alias("key")), lambda keys: ([[float(len(k))] for k in keys], [None if "ring" not in k else "no ring" for k in keys]), 5)
    return S.VectorStore(t.spark, s.path, 1)


query("sto_checkpoint", f"SELECT DISTINCT p_name AS key, 5::BIGINT AS seq, length(p_name)::BIGINT AS n FROM part WHERE NOT {HAS_RING}")(lambda t: _staged_only(t).vectors().select("key", "seq", c("vec")[0].cast("long").alias("n")))


def _reclaimed(t):
    s = S.VectorStore(t.spark, shared.scratch(t.spark, "store"), 1)
    for k in range(4):
        s.put(t.part.filter(c("p_partkey") % 4 == k).select(c("p_name").alias("key"), F.array(c("p_size").cast("float")).alias("vec")), k)
    files = s.reclaim()
    return s.rows().groupBy("key").agg(F.count("*").alias("n")).withColumn("files", F.lit(files).cast("long"))


query("sto_reclaim", "SELECT DISTINCT p_name AS key, 1::BIGINT AS n, 1::BIGINT AS files FROM part")(_reclaimed)
query("sto_meta", "SELECT 2 AS dim")(lambda t: (lambda s: t.spark.createDataFrame([(shared.read_json(t.spark, s.path + "/meta.json")["dim"],)], "dim int"))(a_store(t)))
query("cch_fingerprint", "WITH k AS (SELECT DISTINCT sha256(p_name) AS h FROM part) SELECT sha256(count(*) || '|' || sum(('0x' || substr(h, 1, 15))::BIGINT) || '|' || sum(('0x' || substr(h, 16, 15))::BIGINT) || '|metric=cosine') AS fingerprint FROM k")(lambda t: S.fingerprint(t.part, "p_name", metric="cosine"))
query("cch_similarity", "SELECT p_name AS key, max(p_size) AS v FROM part GROUP BY 1")(lambda t: _cached_twice(t))


def _policies(t):
    """What each policy makes of a table that was published with a third of its rows, and of one for other parameters."""
    keys, out = t.part.select(c("p_name").alias("key")).distinct(), None
    whole = lambda: t.part.groupBy(c("p_name").alias("key")).agg(F.max("p_size").alias("v"))
    for policy in ("trust_complete", "metadata", "full"):
        for case, kind in (("partial", "max"), ("other", "min")):
            path = shared.scratch(t.spark, "features")
            S.materialized(keys, "key", path, lambda: whole().filter("v % 3 = 0"), kind="max")
            found = S.materialized(keys, "key", path, whole, policy, kind=kind).select("v", F.lit(policy).alias("policy"), F.lit(case).alias("found"))
            out = found if out is None else out.unionByName(found)
    return out.groupBy("policy", "found").agg(F.count("*").alias("n"), F.sum("v").cast("long").alias("v"))


query("cch_materialized", "WITH a AS (SELECT p_name, max(p_size) AS v FROM part GROUP BY 1) SELECT policy, found, count(*) AS n, sum(v)::BIGINT AS v FROM a, (VALUES ('trust_complete', 'partial', true), ('trust_complete', 'other', true), ('metadata', 'partial', true), ('metadata', 'other', false), ('full', 'partial', false), ('full', 'other', false)) p(policy, found, kept) WHERE NOT kept OR v % 3 = 0 GROUP BY 1, 2")(_policies)


def _cached_twice(t):
    path, keys = shared.scratch(t.spark, "cache"), t.part.select(c("p_name").alias("key")).distinct()
    for compute in (lambda: t.part.groupBy(c("p_name").alias("key")).agg(F.max("p_size").alias("v")), lambda: t.part.limit(0)):
        found = S.cached(keys, "key", path, compute, kind="max")
    return found


query("dm_mixed_batches", "WITH r AS (SELECT l_orderkey, l_linenumber, (row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1) // 64 AS chunk FROM lineitem), c AS (SELECT chunk, (row_number() OVER (ORDER BY sha256('42:' || chunk), chunk) - 1) // 8 AS batch FROM (SELECT DISTINCT chunk FROM r)) SELECT chunk, batch, count(*) AS n, min(l_orderkey) AS lo, max(l_orderkey) AS hi FROM r JOIN c USING (chunk) GROUP BY 1, 2")(
    lambda t: S.mixed_batches(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 64, 42, 8).groupBy("chunk", "batch").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("lo"), F.max("l_orderkey").alias("hi")))

# Features from several stores
STORES = "WITH a AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 3 <> 0), b AS (SELECT c_custkey, [c_acctbal] AS v FROM customer WHERE c_nationkey < 20)"


@query("join_multi_store_lookup", STORES + " SELECT event_id AS k, 65 AS width, (a.v IS NULL)::INT + (b.v IS NULL)::INT AS n_missing, round(coalesce(list_sum(a.v), 0) + coalesce(b.v[1], 0), 4) AS s FROM events LEFT JOIN a ON user_id = vec_id LEFT JOIN b ON user_id = c_custkey")
def _(t):
    from holdfast.operators.features import assemble

    stores = [("user_id", t.embeddings.filter("vec_id % 3 <> 0").select(c("vec_id").alias("key"), c("embedding").alias("v")), 64), ("user_id", t.customer.filter("c_nationkey < 20").select(c("c_custkey").alias("key"), F.array("c_acctbal").alias("v")), 1)]
    got = assemble(t.events.select(c("event_id").alias("k"), "user_id"), stores)
    return got.select("k", F.size("features").alias("width"), "n_missing", F.round(F.aggregate("features", F.lit(0.0), lambda s, x: s + x), 4).alias("s"))


# Structures
CATALOG = "WITH k AS (SELECT p_name AS id, ['alphafold', 'esmfold2', 'esm3', 'other'][p_partkey % 4 + 1] AS source, p_size AS version, 'f' || p_partkey AS path FROM part WHERE p_size > 40)"
query("str_locate", CATALOG + " SELECT id, arg_min(path, (CASE source WHEN 'alphafold' THEN 1 WHEN 'esmfold2' THEN 2 ELSE 3 END, -version, path)) AS path FROM k WHERE source <> 'other' GROUP BY 1")(
    lambda t: X.locate(t.part.filter("p_size > 40").select(c("p_name").alias("id"), F.element_at(F.array(*map(F.lit, (*X.SOURCES, "other"))), (c("p_partkey") % 4 + 1).cast("int")).alias("source"), c("p_size").alias("version"), F.concat(F.lit("f"), "p_partkey").alias("path"))).select("id", "path"))
query("str_choose", "SELECT l_orderkey AS row_key, arg_min('s' || l_partkey, (l_returnflag <> 'A', -l_discount, 's' || l_partkey)) AS pdb FROM lineitem GROUP BY 1")(
    lambda t: X.choose(t.lineitem.select(c("l_orderkey").alias("row_key"), F.concat(F.lit("s"), "l_partkey").alias("pdb"), F.when(c("l_returnflag") == "A", "experimental").otherwise("predicted").alias("kind"), c("l_discount").alias("coverage"))).select("row_key", "pdb"))
CHAINS = "WITH h AS (SELECT l_orderkey AS pdb, l_linenumber AS chain, l_partkey AS p, l_returnflag = 'A' AS own, 1 - l_tax AS identity, l_quantity / 50 AS coverage FROM lineitem), a AS (SELECT pdb, bool_or(own) AS any_own FROM h GROUP BY 1)"
query("str_select_chain", CHAINS + " SELECT pdb, min(-coverage) * -1 AS coverage FROM h JOIN a USING (pdb) WHERE (NOT any_own OR own) AND identity >= 0.9::DOUBLE AND coverage >= 0.3::DOUBLE GROUP BY 1")(
    lambda t: X.select_chain(t.lineitem.select(c("l_orderkey").alias("pdb"), c("l_linenumber").alias("chain"), (c("l_returnflag") == "A").alias("of_accession"), (1 - c("l_tax")).alias("identity"), (c("l_quantity") / 50).alias("coverage"))).select("pdb", "coverage"))
COVER = "WITH v AS (SELECT DISTINCT l_orderkey AS id, 's' || l_partkey AS pdb, l_quantity / 50 AS coverage FROM lineitem WHERE l_orderkey % 3 <> 0), f AS (SELECT id, pdb FROM v WHERE coverage >= 0.8::DOUBLE)"
query("str_assign", COVER + " SELECT DISTINCT id, pdb, 'full' AS kind FROM f UNION ALL SELECT id, arg_min(pdb, (-coverage, pdb)), 'partial' FROM v WHERE id NOT IN (SELECT id FROM f) GROUP BY 1 UNION ALL SELECT o_orderkey, NULL, 'predicted' FROM orders WHERE o_orderkey NOT IN (SELECT id FROM v)")(
    lambda t: X.assign(t.orders.select(c("o_orderkey").alias("id")), t.lineitem.filter("l_orderkey % 3 <> 0").select(c("l_orderkey").alias("id"), F.concat(F.lit("s"), "l_partkey").alias("pdb"), (c("l_quantity") / 50).alias("coverage")).distinct()).distinct())
query("str_merge_by_sequence", "SELECT p_name AS sequence, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS ids, arg_min(p_type, (p_brand, p_type)) AS kind FROM part GROUP BY 1")(
    lambda t: X.merge_by_sequence(t.part.groupBy(c("p_name").alias("sequence"), c("p_brand").alias("id")).agg(F.min("p_type").alias("kind"))).withColumn("ids", F.array_join("ids", ",")))
query("str_fallback_inputs", "WITH r AS (SELECT p_name AS hash, list(DISTINCT p_brand) AS ids FROM part WHERE p_size > 45 GROUP BY 1) SELECT hash FROM r WHERE hash IN (SELECT p_name FROM part WHERE p_size < 3) AND NOT list_has_any(ids, ['Brand#1', 'Brand#2', 'Brand#3', 'Brand#4'])")(
    lambda t: X.fallback_inputs(t.part.filter("p_size > 45").groupBy(c("p_name").alias("hash")).agg(F.collect_set("p_brand").alias("ids")), t.part.filter("p_size < 3").select(c("p_name").alias("hash")), t.part.select(c("p_brand").alias("id")).filter("id IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4')")).select("hash"))
query("nn_structure_eval", "WITH s AS (SELECT DISTINCT l_partkey AS k, true AS sel FROM lineitem WHERE l_quantity > 20), h AS (SELECT DISTINCT l_partkey AS k, true AS hit FROM lineitem WHERE l_quantity > 45) SELECT count(*) AS queries, count(hit) AS hits, count(*) FILTER (sel IS NULL) AS no_structure, count(*) FILTER (sel AND hit IS NULL) AS no_hit FROM part LEFT JOIN s ON p_partkey = s.k LEFT JOIN h ON p_partkey = h.k")(
    lambda t: (lambda q, s, h: q.join(s, "k", "left").join(h, "k", "left").agg(F.count("*").alias("queries"), F.count("hit").alias("hits"), F.count_if(c("sel").isNull()).alias("no_structure"), F.count_if(c("sel") & c("hit").isNull()).alias("no_hit")))(t.part.select(c("p_partkey").alias("k")), t.lineitem.filter("l_quantity > 20").select(c("l_partkey").alias("k"), F.lit(True).alias("sel")).distinct(), t.lineitem.filter("l_quantity > 45").select(c("l_partkey").alias("k"), F.lit(True).alias("hit")).distinct()))

# Run control
query("rc_upsert", "SELECT p_brand AS k, max(p_size) AS v FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 50) GROUP BY 1 UNION ALL SELECT DISTINCT p_brand, 0 FROM part WHERE p_size = 50")(
    lambda t: R.upsert(t.part.groupBy(c("p_brand").alias("k")).agg(F.max("p_size").alias("v")), t.part.filter("p_size = 50").select(c("p_brand").alias("k")).distinct().withColumn("v", F.lit(0)), ["k"]))
query("rc_lookup_required", "SELECT n_name AS k, n_regionkey AS v FROM nation")(lambda t: R.lookup_required(t.nation.select(c("n_name").alias("k"), c("n_regionkey").alias("v")), t.nation.select(c("n_name").alias("k")), "k", "v"))
query("rc_state_counts", "SELECT user_id AS k, count(*) FILTER (event_type = 'click') AS clicks, max(value) AS best, arg_max(event_type, event_id) AS latest FROM events GROUP BY 1")(
    lambda t: t.events.groupBy(c("user_id").alias("k")).agg(F.count_if(c("event_type") == "click").alias("clicks"), F.max("value").alias("best"), F.max_by("event_type", "event_id").alias("latest")))
LATEST = "WITH l AS (SELECT l_orderkey, arg_max(l_returnflag, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS state FROM lineitem GROUP BY 1)"


def states(t):
    return R.latest(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", c("l_returnflag").alias("state")), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])


query("rc_bucket_summary", LATEST + " SELECT o_orderpriority AS k, count(*) AS total, count(*) FILTER (state = 'A') AS success, count(*) FILTER (state = 'R') AS failed, count(*) FILTER (state IS NULL OR state = 'N') AS running FROM orders LEFT JOIN l ON o_orderkey = l_orderkey GROUP BY 1")(
    lambda t: t.orders.join(states(t), c("o_orderkey") == c("l_orderkey"), "left").groupBy(c("o_orderpriority").alias("k")).agg(F.count("*").alias("total"), F.count_if(c("state") == "A").alias("success"), F.count_if(c("state") == "R").alias("failed"), F.count_if(c("state").isNull() | (c("state") == "N")).alias("running")))
query("rc_all_succeeded", LATEST + " SELECT o_custkey AS k, bool_and(coalesce(state = 'A', false)) AS ok FROM orders LEFT JOIN l ON o_orderkey = l_orderkey GROUP BY 1")(
    lambda t: t.orders.join(states(t), c("o_orderkey") == c("l_orderkey"), "left").groupBy(c("o_custkey").alias("k")).agg(F.bool_and(F.coalesce(c("state") == "A", F.lit(False))).alias("ok")))
query("rc_evict_lru", "WITH e AS (SELECT p_partkey AS id, p_size AS size, p_size = 50 AS keep, sum(CASE WHEN p_size = 50 THEN 0 ELSE p_size END) OVER (ORDER BY p_retailprice, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gone, sum(p_size) OVER () AS total FROM part) SELECT id FROM e WHERE NOT keep AND coalesce(gone, 0) < total - 20000")(
    lambda t: R.evict_oldest(t.part.select(c("p_partkey").alias("id"), c("p_size").alias("size"), c("p_retailprice").alias("mtime")), 20000, c("size") == 50).select("id"))
query("rc_oversize_warn", "SELECT doc_id AS id, length(text) AS size FROM documents WHERE length(text) > 10000")(lambda t: t.documents.select(c("doc_id").alias("id"), F.char_length("text").cast("long").alias("size")).filter("size > 10000"))
query("rc_best_score", "SELECT user_id AS k, arg_max(event_id, (value, -event_id)) AS epoch, max(value) AS best FROM events GROUP BY 1")(lambda t: t.events.groupBy(c("user_id").alias("k")).agg(F.max_by("event_id", F.struct("value", (-c("event_id")).alias("e"))).alias("epoch"), F.max("value").alias("best")))
query("rc_best_trial", "SELECT arg_max(event_id, (value, -event_id)) AS trial, max(value) AS best, count(*) AS n FROM events WHERE event_type = 'purchase'")(lambda t: t.events.filter("event_type = 'purchase'").agg(F.max_by("event_id", F.struct("value", (-c("event_id")).alias("e"))).alias("trial"), F.max("value").alias("best"), F.count("*").alias("n")))

# Lookups
ALIAS = "WITH e AS (SELECT p_partkey AS id, p_size % 5 <> 0 AS active, p_partkey + 1 AS merge_to FROM part)"
query("lk_alias_follow", ALIAS + " SELECT e.id, CASE WHEN e.active THEN e.id ELSE e.merge_to END AS target FROM e JOIN e a ON a.id = CASE WHEN e.active THEN e.id ELSE e.merge_to END WHERE a.active")(
    lambda t: R.follow_alias(t.part.select(c("p_partkey").alias("id"), (c("p_size") % 5 != 0).alias("active"), (c("p_partkey") + 1).alias("merge_to"))))
query("lk_preferred_fallback", "WITH h AS (SELECT p_name AS k, p_partkey AS acc, p_size > 48 AS reviewed FROM part), a AS (SELECT k, bool_or(reviewed) AS any_r FROM h GROUP BY 1) SELECT k, acc FROM h JOIN a USING (k) WHERE NOT any_r OR reviewed")(
    lambda t: R.preferred_or_fallback(t.part.select(c("p_name").alias("k"), c("p_partkey").alias("acc"), (c("p_size") > 48).alias("reviewed")), "k", "reviewed").select("k", "acc"))
query("lk_phrase_match", r"WITH n AS (SELECT DISTINCT regexp_extract(text, '^([A-Za-z]+ [A-Za-z]+)', 1) AS name FROM benchmark WHERE regexp_matches(text, '^[A-Za-z]+ [A-Za-z]+')), x AS (SELECT doc_id AS id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ' AS w FROM documents) SELECT id, name FROM x JOIN n ON contains(w, ' ' || lower(name) || ' ')")(
    lambda t: R.phrase_matches(t.documents.select(c("doc_id").alias("id"), "text"), t.benchmark.select(F.regexp_extract("text", "^([A-Za-z]+ [A-Za-z]+)", 1).alias("name")).filter("name <> ''")))
MANIFEST = "WITH m AS (SELECT user_id AS k, arg_max(event_type, event_id) AS last, max(event_id) AS at FROM events WHERE event_type IN ('error', 'click') GROUP BY 1)"
query("lk_manifest_status", MANIFEST + " SELECT k, last FROM m WHERE last = 'error' AND k IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)")(
    lambda t: is_in(R.latest(t.events.filter("event_type IN ('error', 'click')").select(c("user_id").alias("k"), c("event_type").alias("last"), "event_id"), ["k"], ["event_id"]).filter("last = 'error'"), t.customer.filter("c_nationkey < 12").select(c("c_custkey").alias("k")), "k").select("k", "last"))
FIRST = "WITH w AS ({wanted}), h AS (SELECT l_partkey AS key, l_suppkey AS shard, l_orderkey AS row FROM lineitem WHERE l_partkey IN (SELECT key FROM w)), f AS (SELECT key, min(shard) AS first FROM h GROUP BY 1), e AS (SELECT CASE WHEN (SELECT count(*) FROM f) = (SELECT count(*) FROM w) THEN (SELECT max(first) FROM f) END AS stop) SELECT key, max((shard, row))[1] AS shard, max((shard, row))[2] AS row FROM h, e WHERE stop IS NULL OR shard <= stop GROUP BY 1"
ALL_KEYS, SOME_KEYS = "SELECT DISTINCT l_partkey AS key FROM lineitem WHERE l_suppkey < 3", "SELECT p_partkey AS key FROM part WHERE p_size < 10 UNION ALL SELECT -1"
query("lk_first_location", f"SELECT 'all' AS asked, * FROM ({FIRST.format(wanted=ALL_KEYS)}) UNION ALL SELECT 'some', * FROM ({FIRST.format(wanted=SOME_KEYS)})")(
    lambda t: (lambda rows: R.first_location(rows, t.lineitem.filter("l_suppkey < 3").select(c("l_partkey").alias("key"))).withColumn("asked", F.lit("all"))
               .unionByName(R.first_location(rows, t.part.filter("p_size < 10").select(c("p_partkey").alias("key")).union(t.spark.sql("SELECT -1L"))).withColumn("asked", F.lit("some"))))(t.lineitem.select(c("l_partkey").alias("key"), c("l_suppkey").alias("shard"), c("l_orderkey").alias("row"))))

# Parsing, reuse, expansion
ARTICLE = ("concat('<Set><PubmedArticle><MedlineCitation><Article><ArticleTitle>', p_name, '</ArticleTitle>', CASE WHEN p_size % 3 = 0 THEN '' ELSE concat('<Abstract><AbstractText>', p_type, '</AbstractText><AbstractText>more</AbstractText></Abstract>') END, "
           "'</Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType=\"doi\">10.1/', p_partkey, '</ArticleId>', CASE WHEN p_size % 4 = 0 THEN '' ELSE concat('<ArticleId IdType=\"pubmed\">', p_partkey, '</ArticleId>') END, "
           "'</ArticleIdList></PubmedData></PubmedArticle><PubmedArticle><PubmedData><ArticleIdList><ArticleId IdType=\"pubmed\">7</ArticleId></ArticleIdList></PubmedData></PubmedArticle>', CASE WHEN p_partkey % 9 = 0 THEN '' ELSE '</Set>' END)")  # fmt: skip
rows_xml, head_xml = over("part", "p_partkey AS k", f"{ARTICLE} AS x")
query("px_xml_records", "SELECT p_partkey AS k, CASE WHEN p_size % 4 <> 0 THEN p_partkey::VARCHAR END AS pmid, p_name AS title, CASE WHEN p_size % 3 <> 0 THEN p_type END AS abstract, '10.1/' || p_partkey AS doi FROM part WHERE p_partkey % 9 <> 0 UNION ALL SELECT p_partkey, '7', NULL, NULL, NULL FROM part WHERE p_partkey % 9 <> 0")(
    lambda t: rows_xml(t).select("k", F.inline(article_records(c("x")))))
query("px_schema_variants", "SELECT coalesce(CASE WHEN p_size % 2 = 0 THEN p_partkey END, p_partkey + 100000) AS id, p_name AS sequence FROM part WHERE p_size % 7 <> 0")(
    lambda t: t.part.select(F.coalesce(F.when(c("p_size") % 2 == 0, c("p_partkey")), c("p_partkey") + 100000).alias("id"), F.coalesce(F.when(c("p_size") % 7 == 0, F.lit("")), "p_name").alias("sequence")).filter("sequence <> '' AND id IS NOT NULL"))
query("px_name_clash", "SELECT regexp_replace(x, '[^A-Za-z0-9_.-]+', '_', 'g') AS name, count(DISTINCT x) AS n FROM (SELECT p_name AS x FROM part UNION ALL SELECT replace(p_name, ' ', '/') FROM part WHERE p_size < 5) GROUP BY 1 HAVING count(DISTINCT x) > 1")(
    lambda t: R.name_clashes(t.part.select(c("p_name").alias("x")).union(t.part.filter("p_size < 5").select(F.replace("p_name", F.lit(" "), F.lit("/")))), "x"))
query("px_skip_status", "SELECT p_partkey AS id, CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) THEN 'exists' WHEN p_size = 7 THEN 'skipped' WHEN length(p_name) > 11 THEN 'too long' ELSE 'to do' END AS status FROM part")(
    lambda t: R.classify_work(t.part.select(c("p_partkey").alias("id"), c("p_name").alias("sequence")), t.lineitem.filter("l_quantity > 49").select(c("l_partkey").alias("id")), t.part.filter("p_size = 7").select(c("p_partkey").alias("id")), 11).select("id", "status"))
query("rs_reuse_priority", "SELECT p_name AS k, arg_max(v, (pri, -v)) AS v FROM (SELECT p_name, min(p_partkey) AS v, 1 AS pri FROM part WHERE p_size % 3 <> 0 GROUP BY 1 UNION ALL SELECT p_name, max(p_partkey), 2 FROM part WHERE p_size < 9 GROUP BY 1) GROUP BY 1")(
    lambda t: R.reusable([(t.part.filter("p_size % 3 <> 0").groupBy(c("p_name").alias("k")).agg(F.min("p_partkey").alias("v")), 1), (t.part.filter("p_size < 9").groupBy(c("p_name").alias("k")).agg(F.max("p_partkey").alias("v")), 2)], "k", F.lit(True)))
query("rs_validated_fanout", "WITH r AS (SELECT DISTINCT p_type AS k, 'done' AS status FROM part WHERE p_size < 2) SELECT p_partkey AS id, CASE WHEN p_size = 9 THEN 'not_applicable' ELSE coalesce(status, 'missing') END AS status FROM part LEFT JOIN r ON k = p_type")(
    lambda t: R.fanout(t.part.select(c("p_partkey").alias("id"), F.when(c("p_size") != 9, c("p_type")).alias("k")), t.part.filter("p_size < 2").select(c("p_type").alias("k")).distinct().withColumn("status", F.lit("done")), "k", "status").select("id", "status"))
query("rs_filter_to_selected", "SELECT s_name AS name, s_suppkey AS id FROM supplier WHERE s_name IN (SELECT s_name FROM supplier WHERE s_acctbal > 5000)")(lambda t: is_in(t.supplier.select(c("s_name").alias("name"), c("s_suppkey").alias("id")), t.supplier.filter("s_acctbal > 5000").select(c("s_name").alias("name")), "name"))
query("ex_cross_product", "SELECT DISTINCT o_orderpriority AS endpoint, o_orderstatus AS split, seed FROM orders, (VALUES (666), (777), (888)) s(seed)")(
    lambda t: t.orders.select(c("o_orderpriority").alias("endpoint"), c("o_orderstatus").alias("split")).distinct().withColumn("seed", F.explode(F.array(*map(F.lit, (666, 777, 888))))))
query("ex_reindex_categories", "WITH a AS (SELECT l_returnflag AS category, l_linestatus AS method, avg(l_tax) AS mean FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2) SELECT c AS category, m AS method, round(mean, 6) AS mean, 0.0::DOUBLE AS std FROM (VALUES ('A'), ('R')) x(c), (VALUES ('F'), ('O')) y(m) LEFT JOIN a ON c = category AND m = method")(
    lambda t: R.complete_grid(t.lineitem.filter("l_returnflag <> 'R'").groupBy(c("l_returnflag").alias("category"), c("l_linestatus").alias("method")).agg(F.round(F.avg("l_tax"), 6).alias("mean"), F.lit(None).cast("double").alias("std")), ["A", "R"], ["F", "O"]).drop("at"))
query("ex_reuse_status_row", "SELECT a.p_partkey AS k FROM part a JOIN (SELECT DISTINCT p_brand, p_type FROM part WHERE p_size > 40) b USING (p_brand, p_type) WHERE a.p_size > 20")(
    lambda t: t.part.filter("p_size > 20").join(t.part.filter("p_size > 40").select("p_brand", "p_type").distinct(), ["p_brand", "p_type"], "left_semi").select(c("p_partkey").alias("k")))


@query("stream_latest_row", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def _(t):
    from holdfast.streaming.latest import current, upsert_latest

    base = shared.scratch(t.spark, "stream")
    rows = t.events.select("user_id", "event_id", "event_type", "ts")
    rows.repartition(3).write.parquet(f"{base}/in")
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    started = upsert_latest(stream, f"{base}/table", ["user_id"], ["ts", "event_id"], f"{base}/check")
    started.processAllAvailable()
    started.stop()
    return current(t.spark, f"{base}/table").drop("ts")
