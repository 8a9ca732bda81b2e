"""Queries of the scalar functions on keys, labels, reactions and dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from holdfast.functions import keys as K
from holdfast.plans.registry import over, query

LABEL = "concat(p_size % 7 + 1, '.', p_size % 20, '.', p_partkey % 9, CASE WHEN p_partkey % 4 = 0 THEN '.n1' WHEN p_partkey % 4 = 1 THEN '' ELSE concat('.', p_partkey % 50) END)"
REACTION = "concat(replace(p_name, ' ', '.'), CASE WHEN p_partkey % 3 = 0 THEN '.O' ELSE '' END, '>>', lower(p_type), CASE WHEN p_partkey % 5 = 0 THEN '. .[H+]' ELSE '' END)"


def scalar(name, table, exprs, make, sql, key="k"):
    """A query of one scalar function: key and v over a projection."""
    rows, head = over(table, *exprs)
    query(name, f"{head}SELECT {key}, {sql} AS v FROM i")(lambda t: rows(t).select(key, make().alias("v")))


c = F.col
scalar("fn_sha256_short", "part", ["p_partkey AS k", "p_name AS x"], lambda: K.sha256_short(c("x")), "substr(sha256(x), 1, 24)")
scalar("fn_sha256", "part", ["p_partkey AS k", "concat(p_name, p_brand) AS x"], lambda: F.sha2(c("x"), 256), "sha256(x)")
scalar("fn_sha1_id", "part", ["p_partkey AS k", "p_name AS a", "p_brand AS b"], lambda: K.pair_id(c("a"), c("b")), "substr(sha1(a || chr(0) || b), 1, 20)")
scalar("fn_slugify", "part", ["p_partkey AS k", "concat('__', p_brand, ' / ', p_name, '..') AS x"], lambda: K.slugify(c("x")), "regexp_replace(regexp_replace(x, '[^A-Za-z0-9_.-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g')")
scalar("fn_strip_ws", "documents", ["doc_id AS k", "text AS x"], lambda: F.md5(K.strip_whitespace(c("x"))), r"md5(regexp_replace(x, '[\t\n\x0b\f\r ]+', '', 'g'))")
scalar("fn_undirected_key", "part", ["p_partkey AS k", "CASE WHEN p_partkey % 7 = 0 THEN p_name ELSE concat(p_name, '>>', p_type, CASE WHEN p_size % 3 = 0 THEN '>>x' ELSE '' END) END AS x"], lambda: K.undirected_key(c("x")),
       "CASE WHEN strpos(x, '>>') > 0 THEN least(substr(x, 1, strpos(x, '>>') - 1), substr(x, strpos(x, '>>') + 2)) || '>>' || greatest(substr(x, 1, strpos(x, '>>') - 1), substr(x, strpos(x, '>>') + 2)) ELSE x END")
PARTS = "list_filter(list_transform(string_split(split_part(x, '>>', {n}), '.'), lambda p: trim(p)), lambda p: p <> '')"
scalar("fn_split_reaction", "part", ["p_partkey AS k", f"{REACTION} AS x"], lambda: F.concat_ws("|", F.array_join(K.parts(K.sides(c("x"))[0]), ","), F.array_join(K.parts(K.sides(c("x"))[1]), ",")),
       f"array_to_string({PARTS.format(n=1)}, ',') || '|' || array_to_string({PARTS.format(n=2)}, ',')")
ORDERED = "array_to_string(list_transform(list_sort(list_transform({p}, lambda p: {{'n': -length(p), 'p': p}})), lambda s: s.p), '.')"
scalar("fn_canonical_reaction", "part", ["p_partkey AS k", f"{REACTION} AS x"], lambda: K.canonical_reaction(c("x")), f"{ORDERED.format(p=PARTS.format(n=1))} || '>>' || {ORDERED.format(p=PARTS.format(n=2))}")
KEPT = "array_to_string(list_sort(list_filter({p}, lambda p: p NOT IN ('O', '[H+]'))), '.')"
REACTION_KEY = f"{KEPT.format(p=PARTS.format(n=1))} || '>>' || {KEPT.format(p=PARTS.format(n=2))}"
scalar("fn_reaction_key", "part", ["p_partkey AS k", f"{REACTION} AS x"], lambda: K.reaction_key(c("x")), REACTION_KEY)
scalar("fn_accession_base", "part", ["p_partkey AS k", "CASE WHEN p_size % 5 = 0 THEN ' |x' ELSE concat(' ', p_name, ' |', p_brand, '|y') END AS x"], lambda: K.accession_base(c("x")), "nullif(trim(split_part(x, '|', 1)), '')")
scalar("fn_isoform_root", "part", ["p_partkey AS k", "concat('P', p_size, CASE WHEN p_partkey % 2 = 0 THEN concat('-', p_partkey) ELSE '-b' END) AS x"], lambda: K.isoform_root(c("x")), r"regexp_replace(x, '-\d+$', '')")


def token_sql(x):
    """The label rule in SQL, for a text expression."""
    own = f"list_filter(list_transform(string_split({x}, '.'), lambda p: trim(p)), lambda p: p <> '')"
    clean = f"list_transform(list_slice({own}, 1, 4), lambda p: coalesce(nullif(regexp_replace(p, '[^A-Za-z0-9-]', '', 'g'), ''), '-'))"
    whole = f"list_concat({clean}, ['-', '-', '-', '-'])"
    return f"CASE WHEN len({own}) > 0 THEN array_to_string(list_slice({whole}, 1, 3), '.') || '.' || CASE WHEN regexp_full_match({whole}[4], '[0-9]+') THEN {whole}[4] ELSE '-' END END"


ODD_LABEL = f"CASE p_partkey % 11 WHEN 0 THEN concat(p_size, '..2.3') WHEN 1 THEN concat(p_size, '.2 .3.', p_partkey) WHEN 2 THEN ' . ' WHEN 3 THEN NULL WHEN 4 THEN concat(p_size, '.*.(', p_partkey, ').7') WHEN 5 THEN concat('1.2.3.4.', p_size) ELSE {LABEL} END"
scalar("fn_label_token", "part", ["p_partkey AS k", f"{ODD_LABEL} AS x"], lambda: K.label_token(c("x")), token_sql("x"))
FOUND = r"regexp_extract_all(i.x, '(\d+(?:\.(?:\d+|-)){1,3})', 1)"
scalar("fn_label_collection", "part", ["p_partkey AS k", f"concat('EC ', {LABEL}, '; also ', p_size % 7 + 1, '.2.-, and ', {LABEL}, ' end') AS x"], lambda: F.array_join(K.label_collection(c("x")), ";"),
       f"(SELECT string_agg(v, ';' ORDER BY n) FROM (SELECT v, min(n) AS n FROM (SELECT {token_sql('u.x')} AS v, u.n FROM (SELECT unnest({FOUND}) AS x, generate_subscripts({FOUND}, 1) AS n) u) GROUP BY v))")
scalar("fn_clean_label", "part", ["p_partkey AS k", "CASE WHEN p_size % 4 = 0 THEN ' NaN ' WHEN p_size % 4 = 1 THEN NULL ELSE concat(' ', p_type, ' ') END AS x"], lambda: K.clean_label(c("x")), "CASE WHEN lower(trim(coalesce(x, ''))) = 'nan' THEN '' ELSE trim(coalesce(x, '')) END")
EQUATION = "concat(CASE WHEN p_size % 2 = 0 THEN '2 ' WHEN p_size % 5 = 0 THEN '(n+1) ' ELSE '' END, 'C', p_partkey, ' + H+', CASE WHEN p_size % 3 = 0 THEN ' <=> ' WHEN p_size % 3 = 1 THEN ' => ' ELSE ' = ' END, 'C', p_size, '+', CASE WHEN p_partkey % 7 = 0 THEN ' + 3 water' WHEN p_partkey % 7 = 1 THEN ' = C1' ELSE ' + 3 C9' END)"
IDS = "[CH][0-9]*[+]?"


def _equation_text():
    e = K.parse_equation(c("x"), IDS)
    side = lambda s: F.array_join(F.transform(s, lambda p: F.concat(p["coef"], F.lit("*"), p["id"])), ",")
    return F.when(e.isNotNull(), F.concat_ws("|", side(e["left"]), side(e["right"]), e["direction"]))


HALVES = "string_split(replace(replace(x, ' <=> ', ' = '), ' => ', ' = '), ' = ')"
TERMS = "string_split(" + HALVES + "[{n}], ' + ')"
SIDE = "array_to_string(list_transform(" + TERMS + f", lambda p: coalesce(nullif(trim(regexp_extract(p, '(.*?){IDS}', 1)), ''), '1') || '*' || regexp_extract(p, '{IDS}')), ',')"
NO_ID = "len(list_filter(list_concat(" + TERMS.format(n=1) + ", " + TERMS.format(n=2) + f"), lambda p: regexp_extract(p, '{IDS}') = '')) > 0"
scalar("fn_parse_equation", "part", ["p_partkey AS k", f"{EQUATION} AS x"], _equation_text, f"CASE WHEN len({HALVES}) <> 2 OR {NO_ID} THEN NULL ELSE " + SIDE.format(n=1) + " || '|' || " + SIDE.format(n=2) + " || '|' || CASE WHEN contains(x, '<=>') THEN '<=>' ELSE '=>' END END")
scalar("fn_mutate", "part", ["p_partkey AS k", "upper(replace(p_name, ' ', '')) AS x", "concat(substr(upper(p_name), 1, 1), '1G,', CASE WHEN p_size % 3 = 0 THEN 'G2W' ELSE 'G1W' END) AS e"],
       lambda: K.mutate(c("x"), F.split(c("e"), ",")), "CASE WHEN split_part(e, ',', 2) = 'G1W' THEN 'W' || substr(x, 2) END")
scalar("fn_regex_extract", "part", ["p_partkey AS k", "concat('assay at pH ', p_size % 14, '.5, ', p_partkey % 90, ' C') AS x"],
       lambda: F.concat_ws("|", F.regexp_extract("x", r"pH\s*(\d+(?:\.\d+)?)", 1), F.regexp_extract("x", r"(\d+) C$", 1)), r"regexp_extract(x, 'pH\s*(\d+(?:\.\d+)?)', 1) || '|' || regexp_extract(x, '(\d+) C$', 1)")
scalar("fn_range_mean", "part", ["p_partkey AS k", "CASE WHEN p_size % 3 = 0 THEN concat(p_size, '-', p_size + 5) WHEN p_size % 3 = 1 THEN concat(p_size, '.5') ELSE 'n.d.' END AS x"], lambda: K.range_mean(c("x")),
       "CASE WHEN contains(x, '-') THEN (split_part(x, '-', 1)::DOUBLE + split_part(x, '-', 2)::DOUBLE) / 2 ELSE coalesce(TRY_CAST(x AS DOUBLE), -999.0::DOUBLE) END")
scalar("fn_first_part", "part", ["p_partkey AS k", "concat(p_name, ' ::', p_brand, '::z') AS x"], lambda: K.first_part(c("x")), "trim(split_part(x, '::', 1))")
scalar("fn_struct_key_parts", "part", ["p_partkey AS k", "concat(p_type, ':P', p_size, CASE WHEN p_size % 2 = 0 THEN '|A' ELSE '' END) AS x"], lambda: K.structure_key(c("x")), "upper(split_part(split_part(x, '|', 1), ':', 1)) || CASE WHEN split_part(x, '|', 2) <> '' THEN '_' || split_part(x, '|', 2) ELSE '' END")
scalar("fn_source_suffix", "part", ["p_partkey AS k", "concat(p_name, CASE WHEN p_size % 3 = 0 THEN '_alpha' WHEN p_size % 3 = 1 THEN '_beta' ELSE '' END) AS x"], lambda: K.source_suffix(c("x")), "CASE WHEN regexp_extract(x, '_(alpha|beta|gamma)$', 1) = '' THEN 'none' ELSE regexp_extract(x, '_(alpha|beta|gamma)$', 1) END")
scalar("lk_hash_seed", "part", ["p_partkey AS k", "p_name AS x"], lambda: K.hash_seed(c("x")), "('0x' || substr(sha256(x), 1, 16))::UBIGINT::DECIMAL(20, 0)")
scalar("px_sorted_tuple", "part", ["p_partkey AS k", "concat(p_type, ' ; ', p_brand, ';;', p_type) AS x"], lambda: F.array_join(K.sorted_strings(F.split(c("x"), ";")), ","), "array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(x, ';'), lambda v: trim(v)), lambda v: v <> ''))), ',')")
scalar("lk_wildcard_equal", "part", ["p_partkey AS k", "upper(substr(p_type, 1, 4)) AS a", "CASE WHEN p_size % 3 = 0 THEN upper(substr(p_type, 1, 4)) WHEN p_size % 3 = 1 THEN replace(upper(substr(p_type, 1, 4)), 'O', 'X') ELSE 'XXX' END AS b"], lambda: K.wildcard_equal(c("a"), c("b")),
       "length(a) = length(b) AND coalesce(list_bool_and(list_transform(range(1, length(a) + 1), lambda j: a[j] = b[j] OR (b[j] = 'X' AND strpos('ACDEFGHIKLMNPQRSTVWY', a[j]) = 0))), true)")

rows_fb, head_fb = over("part", "p_partkey AS k", "CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_name END AS x", "p_brand AS f")


@query("fn_key_fallback", head_fb + "SELECT coalesce(x, f) AS v, count(*) AS n, count(*) FILTER (x IS NULL) AS n_fallback FROM i GROUP BY 1")
def _(t):
    return rows_fb(t).groupBy(K.key_or_fallback(c("x"), c("f")).alias("v")).agg(F.count("*").alias("n"), F.count_if(c("x").isNull()).alias("n_fallback"))


rows_cs, head_cs = over("part", "p_partkey AS k", f"{REACTION} AS x")


@query("fn_canonical_series", head_cs + f", u AS (SELECT DISTINCT x, {REACTION_KEY} AS v FROM i) SELECT k, v FROM i JOIN u USING (x)")
def _(t):
    from holdfast.operators.frames import map_distinct

    return map_distinct(rows_cs(t), "x", "v", K.reaction_key).select("k", "v")


rows_tk, head_tk = over("part", "p_partkey AS k", "p_type AS x")


@query("fn_template_keys", head_tk + "SELECT k, 'emb_' || x || '_' || j AS v FROM i, (VALUES (0), (1), (2)) g(j)")
def _(t):
    return rows_tk(t).select("k", F.explode(K.template_keys(F.lit("emb_{key}_{i}"), c("x"), 3)).alias("v"))


@query("fn_reaction_from_parts", "WITH p AS (SELECT l_orderkey, l_linenumber, p_name, CASE WHEN p_size = 50 THEN NULL ELSE p_type END AS v FROM lineitem JOIN part ON l_partkey = p_partkey) "
       "SELECT l_orderkey AS k, CASE WHEN bool_and(v IS NOT NULL) THEN string_agg(v, '.' ORDER BY v) FILTER (l_linenumber % 2 = 0) || '>>' || string_agg(v, '.' ORDER BY v) FILTER (l_linenumber % 2 = 1) END AS v FROM p GROUP BY 1")  # fmt: skip
def _(t):
    p = t.lineitem.join(t.part, c("l_partkey") == c("p_partkey")).select("l_orderkey", "l_linenumber", F.when(c("p_size") != 50, c("p_type")).alias("v"))
    side = lambda r: F.nullif(F.array_join(F.array_sort(F.collect_list(F.when(c("l_linenumber") % 2 == r, c("v")))), "."), F.lit(""))
    return p.groupBy(c("l_orderkey").alias("k")).agg(F.when(F.bool_and(c("v").isNotNull()), F.concat(side(0), F.lit(">>"), side(1))).alias("v"))


@query("lk_hash_sorted_keys", "SELECT DISTINCT p_name AS k, sha256(p_name) AS h FROM part ORDER BY h")
def _(t):
    return t.part.select(c("p_name").alias("k")).distinct().withColumn("h", F.sha2("k", 256)).orderBy("h")


rows_day, head_day = over("events", "event_id AS k", "CASE WHEN event_id % 9 = 0 THEN 'not a date' ELSE substr(cast(ts AS string), 1, 19) END AS x")


@query("fn_to_day", head_day.replace("AS string", "AS VARCHAR") + "SELECT k, TRY_CAST(x AS TIMESTAMP)::DATE AS day, year(TRY_CAST(x AS TIMESTAMP)) AS y FROM i")
def _(t):
    day = F.to_date(F.try_to_timestamp("x"))
    return rows_day(t).select("k", day.alias("day"), F.year(day).cast("long").alias("y"))


@query("fn_date_fill", "WITH m AS (SELECT l_orderkey, min(l_shipdate) AS d FROM lineitem GROUP BY 1) SELECT o_orderkey AS k, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END, d)::DATE AS day FROM orders LEFT JOIN m ON o_orderkey = l_orderkey")
def _(t):
    m = t.lineitem.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("d"))
    own = F.when(c("o_orderkey") % 3 != 0, c("o_orderdate"))
    return t.orders.join(m, c("o_orderkey") == c("l_orderkey"), "left").select(c("o_orderkey").alias("k"), F.to_date(F.coalesce(own, "d")).alias("day"))


scalar("fn_log10_pow10", "lineitem", ["l_orderkey AS k", "l_linenumber AS n", "l_extendedprice AS x"], lambda: F.round(F.pow(F.lit(10.0), F.log10("x")), 4), "round(pow(10.0, log10(x)), 4)")


@query("fn_json_extract", "SELECT event_id AS k, (props->>'$.k')::BIGINT AS v, TRY_CAST(props->>'$.missing' AS BIGINT) AS w FROM events")
def _(t):
    p = F.from_json("props", "k long, missing long")
    return t.events.select(c("event_id").alias("k"), p["k"].alias("v"), p["missing"].alias("w"))
