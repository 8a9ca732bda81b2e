"""Queries of vectors, splits and label transfer."""

from __future__ import annotations

from pyspark.sql import functions as F

from holdfast.functions import vectors as V
from holdfast.functions.align import identity_coverage
from holdfast.operators import metrics as M
from holdfast.operators.aggregates import symmetric_max
from holdfast.operators.selection import rank_labels
from holdfast.plans import splits as P
from holdfast.plans.q_stats import BALANCED
from holdfast.plans.registry import over, query

c = F.col

# Vector functions
PAIR = "FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


def pairs(t):
    b = t.embeddings.select((c("vec_id") - 1).alias("vec_id"), c("embedding").alias("other"))
    return t.embeddings.select("vec_id", "embedding").join(b, "vec_id")


query("fn_cosine", f"SELECT a.vec_id AS k, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS v {PAIR}")(lambda t: pairs(t).select(c("vec_id").alias("k"), F.round(V.cosine(c("embedding"), c("other")), 6).alias("v")))
BITS = "list_sum(list_transform(range(1, 65), lambda i: ({c})::INT))"
query("fn_tanimoto_bits", f"SELECT a.vec_id AS k, round({BITS.format(c='a.embedding[i] > 0 AND b.embedding[i] > 0')} / {BITS.format(c='a.embedding[i] > 0 OR b.embedding[i] > 0')}, 6) AS v {PAIR}")(lambda t: pairs(t).select(c("vec_id").alias("k"), F.round(V.tanimoto_bits(c("embedding"), c("other")), 6).alias("v")))
query("fn_json_vector", "SELECT p_partkey AS k, p_size + p_partkey % 3 AS v FROM part WHERE p_partkey % 5 <> 0")(
    lambda t: t.part.select(c("p_partkey").alias("k"), V.json_vector(F.when(c("p_partkey") % 5 == 0, "oops").otherwise(F.concat(F.lit("["), c("p_size").cast("string"), F.lit(","), (c("p_partkey") % 3).cast("string"), F.lit("]")))).alias("v")).filter("v is not null").select("k", F.aggregate("v", F.lit(0.0), lambda s, x: s + x).cast("long").alias("v")))
zeroed = lambda t: t.embeddings.select(c("vec_id").alias("k"), "label", F.when(c("vec_id") % 10 == 1, F.transform("embedding", lambda v: v.cast("double") * 0)).when(c("vec_id") % 10 != 2, c("embedding").cast("array<double>")).alias("v"))
query("fn_vector_valid", "SELECT vec_id AS k, vec_id % 10 NOT IN (1, 2) AS v FROM embeddings")(lambda t: zeroed(t).select("k", V.valid(c("v")).alias("v")))
query("fn_nan_to_num", "SELECT event_id AS k, CASE WHEN event_id % 3 = 0 THEN 0.0::DOUBLE ELSE value END AS v FROM events")(
    lambda t: t.events.select(c("event_id").alias("k"), V.nan_to_zero(F.array(F.when(c("event_id") % 6 == 0, float("nan")).when(c("event_id") % 3 == 0, float("-inf")).otherwise(c("value"))))[0].alias("v")))
query("fn_concat_blocks", "SELECT vec_id AS k, 66 AS n, round(CASE WHEN vec_id % 10 IN (1, 2) THEN 0 ELSE list_sum(embedding::DOUBLE[]) END + 3, 4) AS s FROM embeddings")(
    lambda t: zeroed(t).select("k", V.concat_blocks([(c("v"), 64), (F.array(F.lit(1.0), F.lit(2.0)), 2)]).alias("v")).select("k", F.size("v").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 4).alias("s")))
query("fn_block_standardise", "SELECT vec_id AS k, round(CASE WHEN vec_id % 10 = 1 THEN 0 ELSE (embedding[1]::DOUBLE - 0.1::DOUBLE) / 0.5::DOUBLE END, 6) AS v FROM embeddings WHERE vec_id % 10 <> 2")(
    lambda t: zeroed(t).filter("v is not null").select("k", F.round(V.standardise(c("v"), F.lit(0.1), F.lit(0.5))[0], 6).alias("v")))
query("fn_label_encode", "WITH s AS (SELECT DISTINCT p_type AS l, false AS extra FROM part WHERE p_size < 3 UNION SELECT p_type, true FROM part WHERE p_size >= 3 AND p_size < 30 AND p_type NOT IN (SELECT p_type FROM part WHERE p_size < 3)), e AS (SELECT l, dense_rank() OVER (ORDER BY extra, l) - 1 AS i FROM s) SELECT p_partkey AS k, coalesce(i, -1) AS i FROM part LEFT JOIN e ON p_type = l AND p_size <> 40")(
    lambda t: _encode(t))


def _encode(t):
    from holdfast.operators.features import label_index

    index = label_index(t.part.filter("p_size < 3").select(c("p_type").alias("label")), t.part.filter("p_size < 30").select(c("p_type").alias("label")))
    own = t.part.select(c("p_partkey").alias("k"), F.when(c("p_size") != 40, c("p_type")).alias("label"))
    return own.join(index, "label", "left").select("k", F.coalesce("index", F.lit(-1)).cast("long").alias("i"))


rows_sh, head_sh = over("part", "p_partkey AS k", "p_name AS x", "p_type AS y")
GRAMS = "list_distinct(list_transform(range(1, length({x}) - 1), lambda i: substr({x}, i, 3)))"
AROUND = "list_transform(range(1, length(x) + 1), lambda i: '{r}' || substr(x, greatest(i - {r}, 1)::INT, (least(i, {r} + 1) + {r})::INT))"
query("fn_morgan", head_sh + "SELECT k, len(list_distinct(" + "list_concat(list_concat(" + AROUND.format(r=0) + ", " + AROUND.format(r=1) + "), " + AROUND.format(r=2) + "))) AS n FROM i")(lambda t: rows_sh(t).select("k", F.size(V.neighbourhoods(c("x"), 2)).cast("long").alias("n")))
APART = "list_transform(range(1, length(x) - {d} + 1), lambda i: least(substr(x, i, 1), substr(x, i + {d}, 1)) || '{d}' || greatest(substr(x, i, 1), substr(x, i + {d}, 1)))"
query("fn_atompair", head_sh + "SELECT k, array_to_string(list_sort(list_distinct(list_concat(list_concat(" + APART.format(d=1) + ", " + APART.format(d=2) + "), " + APART.format(d=3) + "))), ',') AS pairs FROM i")(lambda t: rows_sh(t).select("k", F.array_join(F.array_sort(V.character_pairs(c("x"), 3)), ",").alias("pairs")))
query("fn_drfp", head_sh + f"SELECT k, len(list_filter({GRAMS.format(x='x')}, lambda g: NOT list_contains({GRAMS.format(x='y')}, g))) + len(list_filter({GRAMS.format(x='y')}, lambda g: NOT list_contains({GRAMS.format(x='x')}, g))) AS n FROM i")(
    lambda t: rows_sh(t).select("k", F.size(V.set_difference_both(V.shingles(c("x"), 3), V.shingles(c("y"), 3))).cast("long").alias("n")))
#: A sequence against a stretch of itself, whole or with one letter in the middle that it does not have: the best alignment is known.
STRETCH = "CASE p_partkey % 4 WHEN 0 THEN substr(repeat(p_name, 2), 3, 12) WHEN 1 THEN concat(substr(repeat(p_name, 2), 3, 5), '#', substr(repeat(p_name, 2), 9, 6)) WHEN 2 THEN '' ELSE repeat(p_name, 2) END"
rows_al, head_al = over("part", "p_partkey AS k", "repeat(p_name, 2) AS a", f"{STRETCH} AS b")
query("fn_identity_coverage", head_al + "SELECT k, CASE k % 4 WHEN 0 THEN 1 WHEN 1 THEN round(11 / 12::DOUBLE, 6) WHEN 2 THEN 0 ELSE 1 END::DOUBLE AS identity, round(length(b) / length(a)::DOUBLE, 6) AS coverage FROM i")(
    lambda t: rows_al(t).select("k", identity_coverage("a", "b").alias("r")).select("k", F.round("r.identity", 6).alias("identity"), F.round("r.coverage", 6).alias("coverage")))
query("fn_mean_bfactor", "WITH b AS (SELECT l_orderkey AS k, count(*) AS n, avg(l_quantity / 50) AS m, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1) SELECT k, round(CASE WHEN lo = hi THEN NULL WHEN m <= 1 THEN m * 100 ELSE m END, 4) AS v FROM b")(
    lambda t: __import__("holdfast.operators.structures", fromlist=["x"]).mean_confidence(t.lineitem.select(c("l_orderkey").alias("k"), (c("l_quantity") / 50).alias("b")), "k", "b").select("k", F.round("v", 4).alias("v")))

# All pairs and similarity splits
KNOWN = "v AS (SELECT vec_id AS key, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id % 10 NOT IN (1, 2)), m AS (SELECT a.key, max(list_cosine_similarity(a.x, b.x)) AS sim FROM v a JOIN v b ON a.key <> b.key GROUP BY 1), s AS (SELECT vec_id AS key, round(sim, 9) AS sim, 1 + vec_id % 4 AS n FROM embeddings LEFT JOIN m ON vec_id = key)"
query("join_all_pairs_max", f"WITH {KNOWN} SELECT key, round(sim, 6) AS sim FROM m")(lambda t: V.max_similarity(zeroed(t).withColumnRenamed("k", "key"), "key", "v").select("key", F.round("sim", 6).alias("sim")))
FILL = ", o{i} AS (SELECT key, n, row_number() OVER (ORDER BY sim, n, key) AS r FROM {rows}), f{i}(r, total, key, took) AS (SELECT 0::BIGINT, 0::BIGINT, NULL::{kind}, false UNION ALL SELECT o.r, CASE WHEN f.total + o.n <= b.b THEN f.total + o.n ELSE f.total END, o.key, f.total + o.n <= b.b FROM f{i} f JOIN o{i} o ON o.r = f.r + 1, (SELECT {budget} AS b) b), t{i} AS (SELECT key FROM f{i} WHERE took)"


def split_sql(threshold, rows="s", kind="BIGINT", n="(SELECT sum(n) FROM s)", may="sim IS NOT NULL", val_may=None):
    test = FILL.format(i=1, rows=f"(SELECT * FROM {rows} WHERE {may} AND sim < {threshold}::DOUBLE)", kind=kind, budget=f"floor(0.05::DOUBLE * {n})::BIGINT")
    val = FILL.format(i=2, rows=f"(SELECT * FROM {rows} WHERE {val_may or may} AND key NOT IN (SELECT key FROM t1))", kind=kind, budget=f"floor(0.05::DOUBLE * {n})::BIGINT")
    return test + val + f" SELECT s.key, CASE WHEN s.key IN (SELECT key FROM t1) THEN 'test' WHEN s.key IN (SELECT key FROM t2) THEN 'val' ELSE 'train' END AS split FROM {rows} s"


def cosine_keys(t):
    rows = zeroed(t).withColumnRenamed("k", "key")
    sims = V.max_similarity(rows, "key", "v").withColumn("sim", F.round("sim", 9))
    return rows.select("key", (1 + c("key") % 4).alias("n")).join(sims, "key", "left")


def cosine_rows(t):
    return t.embeddings.agg(F.sum(1 + c("vec_id") % 4)).first()[0]


query("spl_embedding_cosine", f"WITH RECURSIVE {KNOWN}{split_sql(0.36)}")(lambda t: P.similarity_split(cosine_keys(t), cosine_rows(t), 0.36))


@query("spl_multi_threshold", "SELECT * FROM (" + ") UNION ALL SELECT * FROM (".join(f"SELECT *, {x}::DOUBLE AS threshold FROM (WITH RECURSIVE {KNOWN}{split_sql(x)})" for x in (0.33, 0.36, 0.4)) + ")")
def _(t):
    return P.multi_threshold(cosine_keys(t), cosine_rows(t), [0.33, 0.36, 0.4])


@query("spl_leak_check", f"WITH RECURSIVE {KNOWN}{split_sql(0.36)}".replace("SELECT s.key, CASE", "SELECT split, count(*) AS keys, 0::BIGINT AS leaks FROM (SELECT s.key, CASE") + ") GROUP BY 1")
def _(t):
    marks = P.similarity_split(cosine_keys(t), cosine_rows(t), 0.36)
    bad = P.leaks(marks, "key").agg(F.count("*").alias("leaks"))
    return marks.groupBy("split").agg(F.count("*").alias("keys")).join(bad)


query("spl_companion_1d", f"WITH RECURSIVE {KNOWN}{split_sql(0.36)}".replace(" SELECT s.key, CASE", ", z AS (SELECT s.key, CASE") + ") SELECT event_id AS k, coalesce(split, 'train') AS split FROM events LEFT JOIN z ON key = CASE WHEN event_id % 7 <> 0 THEN user_id END")(
    lambda t: P.companion_split(t.events.select(c("event_id").alias("k"), F.when(c("event_id") % 7 != 0, c("user_id")).alias("u")), P.similarity_split(cosine_keys(t), cosine_rows(t), 0.36), "u").select("k", "split"))
NAMES = f"g AS (SELECT p_name AS key, count(*) AS n, {GRAMS.format(x='p_name')} AS x FROM part GROUP BY 1), m AS (SELECT a.key, max(len(list_intersect(a.x, b.x)) / len(list_distinct(list_concat(a.x, b.x)))) AS sim FROM g a JOIN g b ON a.key <> b.key GROUP BY 1), s AS (SELECT g.key, g.n, round(sim, 9) AS sim FROM g JOIN m USING (key))"


def shingle_sims(df, key, n):
    """Largest Tanimoto of shingle sets, all keys against all in blocks."""
    sets = df.select(key, F.array_distinct(F.transform(V.shingles(c(key), n), lambda g: F.xxhash64(g))).alias("s"))
    return df.join(V.max_set_similarity(sets, key, "s").withColumn("sim", F.round("sim", 9)), key)


query("spl_molecule_tanimoto", f"WITH RECURSIVE {NAMES}{split_sql(0.5, kind='VARCHAR', may='length(key) >= 9')}")(
    lambda t: P.similarity_split(shingle_sims(t.part.groupBy(c("p_name").alias("key")).agg(F.count("*").alias("n")), "key", 3), t.part.count(), 0.5, eligible=F.length("key") >= 9))
RX = NAMES.replace("p_name", "rx").replace("FROM part GROUP", "FROM (SELECT p_name || '>>' || p_type AS rx FROM part) GROUP")
query("spl_reaction_tanimoto", f"WITH RECURSIVE {RX}{split_sql(0.75, kind='VARCHAR')}")(
    lambda t: P.similarity_split(shingle_sims(t.part.groupBy(F.concat("p_name", F.lit(">>"), "p_type").alias("key")).agg(F.count("*").alias("n")), "key", 3), t.part.count(), 0.75))
EDGE = "e AS (SELECT DISTINCT l_partkey AS query, (l_partkey * 7 + l_suppkey) % (SELECT count(*) FROM part) AS target, l_discount AS score FROM lineitem WHERE l_linenumber = 1 AND l_discount > 0), x AS (SELECT key, max(score) AS sim FROM (SELECT query AS key, score FROM e WHERE query <> target UNION ALL SELECT target, score FROM e WHERE query <> target) GROUP BY 1), s AS (SELECT p_partkey AS key, 1 + p_size % 3 AS n, coalesce(sim, 0.0::DOUBLE) AS sim FROM part LEFT JOIN x ON p_partkey = key)"


def part_edges(t):
    n = t.part.count()
    return t.lineitem.filter("l_linenumber = 1 AND l_discount > 0").select(c("l_partkey").alias("query"), ((c("l_partkey") * 7 + c("l_suppkey")) % n).alias("target"), c("l_discount").alias("score")).distinct()


query("spl_sequence_identity", f"WITH RECURSIVE {EDGE}{split_sql(0.07)}")(
    lambda t: P.similarity_split(t.part.select(c("p_partkey").alias("key"), (1 + c("p_size") % 3).alias("n")).join(symmetric_max(part_edges(t)).select("key", c("score").alias("sim")), "key", "left").na.fill({"sim": 0.0}), t.part.agg(F.sum(1 + c("p_size") % 3)).first()[0], 0.07, val_any=True))
LDDT = EDGE.split(", x AS")[0] + (", st AS (SELECT p_partkey AS id, CASE WHEN p_size % 9 = 0 THEN NULL ELSE p_partkey % 900 END AS seq, p_size % 10 = 0 AS low, p_size % 13 <> 0 AS has FROM part), y AS (SELECT query, target, score FROM e JOIN st a ON a.id = query JOIN st b ON b.id = target WHERE query <> target AND NOT coalesce(a.seq = b.seq, false)), "
       "x AS (SELECT id, max(score) AS sim FROM (SELECT query AS id, score FROM y UNION ALL SELECT target, score FROM y) GROUP BY 1), s AS (SELECT seq AS key, count(*) AS n, max(CASE WHEN low THEN 0 ELSE coalesce(sim, 0) END) AS sim, bool_or(has) AS has FROM st LEFT JOIN x USING (id) WHERE seq IS NOT NULL GROUP BY 1)")  # fmt: skip


@query("spl_structure_lddt", f"WITH RECURSIVE {LDDT}{split_sql(0.05, may='has AND sim > 0')}")
def _(t):
    st = t.part.select(c("p_partkey").alias("id"), F.when(c("p_size") % 9 != 0, c("p_partkey") % 900).alias("sequence"), (c("p_size") % 10 == 0).alias("low"), (c("p_size") % 13 != 0).alias("has"))
    sims = P.edge_maxima(st.select("id", "sequence"), part_edges(t))
    own = st.join(sims, "id").filter("sequence is not null").groupBy(c("sequence").alias("key")).agg(F.count("*").alias("n"), F.max(F.when(c("low"), 0.0).otherwise(c("sim"))).alias("sim"), F.bool_or("has").alias("has"))
    return P.similarity_split(own, own.agg(F.sum("n")).first()[0], 0.05, eligible=c("has") & (c("sim") > 0))


# Time and groups
DAYS = "d AS (SELECT day, count(*) AS n FROM x WHERE day IS NOT NULL GROUP BY 1), b AS (SELECT day, n, coalesce(sum(n) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d), t AS (SELECT day, n, before + (SELECT count(*) FROM x WHERE day IS NULL) < floor(0.9::DOUBLE * (SELECT n FROM n)) AS train FROM b), v AS (SELECT day, train, coalesce(sum(CASE WHEN NOT train THEN n END) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS later FROM t), r AS (SELECT day, CASE WHEN train THEN 0 WHEN later < floor(0.05::DOUBLE * (SELECT n FROM n)) THEN 1 ELSE 2 END AS rank FROM v)"
TIME = "WITH x AS (SELECT *, o_orderdate::DATE AS day FROM orders), n AS (SELECT count(*) AS n FROM x), " + DAYS
GROUPED = TIME + ", g AS (SELECT o_orderkey, min(rank) OVER (PARTITION BY o_custkey, o_orderpriority) AS rank FROM orders JOIN r ON o_orderdate::DATE = day)"
MESSY = "CASE o_orderkey % 17 WHEN 0 THEN 'unknown' WHEN 1 THEN '2020-13-45' WHEN 2 THEN NULL ELSE substr(cast(o_orderdate AS string), 1, 10) END"
rows_md, head_md = over("orders", "o_orderkey", f"{MESSY} AS date")
query("spl_time", head_md.replace("AS string", "AS VARCHAR").rstrip() + ", x AS (SELECT o_orderkey, TRY_CAST(date AS TIMESTAMP)::DATE AS day FROM i), n AS (SELECT count(*) AS n FROM x), " + DAYS + " SELECT o_orderkey, ['train', 'val', 'test'][coalesce(rank, 0) + 1] AS split FROM x LEFT JOIN r USING (day)")(
    lambda t: P.time_split(rows_md(t), "date").select("o_orderkey", "split"))


def flagship(t):
    return P.time_split(t.orders, "o_orderdate", groups=["o_custkey", "o_orderpriority"]).groupBy("split").agg(F.count("*").alias("n"))


query("spl_time_grouped", GROUPED + " SELECT ['train', 'val', 'test'][rank + 1] AS split, count(*) AS n FROM g GROUP BY 1")(flagship)
query("spl_random_grouped", "WITH RECURSIVE g AS (SELECT o_custkey::VARCHAR AS g, count(*) AS n FROM orders GROUP BY 1), " + BALANCED + " SELECT o_orderkey, o_custkey, ['train', 'val', 'test'][s] AS split FROM orders JOIN a ON g = o_custkey::VARCHAR")(
    lambda t: P.random_grouped_split(t.orders.select("o_orderkey", "o_custkey"), "o_custkey"))
query("spl_dispatch", "SELECT * FROM (VALUES ('kd', 'time'), ('kd', 'similarity'), ('km', 'time')) v(dataset, family)")(
    lambda t: t.spark.createDataFrame(P.dispatch({"km": {"time": {}}, "kd": {"similarity": {}, "time": {}}, "all_unified": {"time": {}}}), "dataset string, family string"))

# Label transfer
LABEL = "concat(label % 3, '.', label % 4, '.', label % 2, '.', label)"
HITS = f"WITH tr AS (SELECT vec_id, {LABEL} AS label, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id % 5 <> 0), te AS (SELECT vec_id, {LABEL} AS label, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id % 5 = 0), h AS (SELECT te.vec_id AS query, tr.label, max(round(list_cosine_similarity(te.x, tr.x), 9)) AS score FROM te, tr GROUP BY 1, 2), q AS (SELECT label, count(*) AS n FROM tr GROUP BY 1), r AS (SELECT query, label, row_number() OVER (PARTITION BY query ORDER BY score DESC, n DESC, label) AS rank FROM h JOIN q USING (label))"


def transferred(t):
    from holdfast.plans.transfer import best_hits

    label = F.concat_ws(".", *[x.cast("string") for x in (c("label") % 3, c("label") % 4, c("label") % 2, c("label"))])
    own = t.embeddings.select(c("vec_id").alias("id"), label.alias("label"), c("embedding").alias("v"))
    train = own.filter("id % 5 <> 0")
    hits = best_hits(own.filter("id % 5 = 0"), train).withColumn("score", F.round("score", 9))
    return own, rank_labels(hits, train.groupBy("label").agg(F.count("*").alias("frequency")), 20)


@query("nn_label_transfer", HITS + ", tt AS (SELECT vec_id AS query, label AS tl FROM te), m AS (SELECT k, r.query, max(CASE WHEN rank <= k THEN CASE WHEN string_split(label, '.')[1:4] = string_split(tl, '.')[1:4] THEN 4 WHEN string_split(label, '.')[1:3] = string_split(tl, '.')[1:3] THEN 3 WHEN string_split(label, '.')[1:2] = string_split(tl, '.')[1:2] THEN 2 WHEN split_part(label, '.', 1) = split_part(tl, '.', 1) THEN 1 ELSE 0 END ELSE 0 END) AS m FROM r JOIN tt USING (query), (VALUES (1), (3), (5)) g(k) GROUP BY 1, 2) SELECT k, level, round(100 * avg((m >= level)::INT), 6) AS accuracy FROM m, (VALUES (1), (2), (3), (4)) l(level) GROUP BY 1, 2")
def _(t):
    own, ranked = transferred(t)
    return M.level_accuracy(own.filter("id % 5 = 0").select(c("id").alias("query"), "label"), ranked, (1, 3, 5)).withColumn("accuracy", F.round("accuracy", 6))


query("nn_wide_rank_cols", HITS + " SELECT query, max(label) FILTER (rank = 1) AS c0, max(label) FILTER (rank = 2) AS c1, max(label) FILTER (rank = 11) AS c10 FROM r GROUP BY 1")(
    lambda t: __import__("holdfast.plans.transfer", fromlist=["x"]).wide_ranks(transferred(t)[1], 20).select("query", "c0", "c1", "c10"))

# Sequence search: stretches of eight letters as seeds, so a query of eight letters hits what holds it
SEARCHED = "SELECT q.k::VARCHAR AS query, t.p_name AS target, 1.0::DOUBLE AS identity, 1.0::DOUBLE AS coverage FROM (SELECT p_partkey AS k, substr(p_name, 2, 8) AS x FROM part WHERE p_partkey % 5 = 0 AND length(p_name) > 8) q JOIN (SELECT DISTINCT p_name FROM part) t ON contains(t.p_name, q.x)"


def searched(t, block):
    from holdfast.operators.search import sequence_hits

    queries = t.part.filter("p_partkey % 5 = 0 AND length(p_name) > 8").select(c("p_partkey").alias("id"), F.substring("p_name", 2, 8).alias("sequence"))
    return sequence_hits(queries, t.part.select(c("p_name").alias("id"), c("p_name").alias("sequence")).distinct(), 8, 1, 0.9, 0.9, block)


query("nn_search_seq", SEARCHED)(lambda t: searched(t, None))
query("nn_chunked_search", SEARCHED)(lambda t: searched(t, 16))
