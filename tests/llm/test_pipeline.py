"""The pipeline's stages, each against plain Python on its own input, and the registry."""

from collections import Counter

from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from holdfast.llm import quality
from holdfast.llm.common import written
from holdfast.llm.tokens import tokenizer_path
from tests.llm.test_dedup import best_overlaps, cut, groups_of
from tests.llm.test_filters import statistics

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def one_of_each(rows):
    """The least id of each group of near copies, by comparing the shingles of all pairs; it knows nothing of any index."""
    ids = sorted(rows)
    grams = [shingles(rows[d].text) for d in ids]
    return {ids[g] for g in set(groups_of(range(len(ids)), lambda i, j: len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])))}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        before, at = at, written(stage(spark, at, SF), name)
        seen[name] = (rows_of(before), at)
        if name != "packing":
            assert at.columns == docs.columns

    before, after = seen["quality_rules"]
    rules = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r.doc_id for r in quality.judge(docs, rules).filter("kept").collect()}
    failed = {d for d, r in before.items() if (s := statistics(r.text))[0] < 50 or 100 * s[4] > 50 * s[0]}
    assert set(rows_of(after)) == kept and not kept & failed and 0 < len(kept) < len(before)

    before, after = seen["line_dedup"]
    want = cut([(d, r.text) for d, r in before.items()])
    left = {d: t for d, (_, n, t) in want.items() if not n or t.strip()}
    got = rows_of(after)
    assert {d: r.text for d, r in got.items()} == left and any(n for _, n, _ in want.values())
    assert all(r.n_chars == len(r.text) for d, r in got.items() if want[d][1])

    before, after = seen["near_dedup"]
    assert set(rows_of(after)) == one_of_each(before) != set(before)

    before, after = seen["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {d for d, _ in best_overlaps([(d, r.text) for d, r in before.items()], items)}
    assert set(rows_of(after)) == set(before) - bad

    before, after = seen["packing"]
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    total = {d: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for d, r in before.items()}
    got = Counter()
    for r in after.collect():
        got[r.doc_id] += r.length
        assert r.length <= 4096 and r.offset + r.length <= 4096
    assert got == total

    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "length", "ids_crc32").collect())) == Counter(map(tuple, after.select("doc_id", "piece", "length", "ids_crc32").collect()))


def test_registry():
    found = __spark_entry__.queries()
    assert [sum(q.startswith(f"op{n}_") for q in found) for n in range(1, 11)] == [1] * 10 and "pipeline" in found
    assert set(__spark_entry__.oracle_sql()) <= set(found)


CLASHES = ["_cover", "_left", "_cut", "_text_hash", "_bad_id", "_first_id", "_words", "_lines", "_trigrams", "_statistics", "_n_left", "words", "node", "first", "root", "key", "seed", "h", "s", "f0", "salt", "rank", "doc"]


def odd_tables(spark, folder, rows):
    extra = ", ".join(f"{c} string" for c in CLASHES)
    docs = spark.createDataFrame([(*r, *["x"] * len(CLASHES)) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(None, None), (1, "short"), (None, " ".join(f"q{i}" for i in range(40)))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(None, 1, 0), (1, None, 0), (2, 0, 1), (2, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(None, None, None), (1, "", "x"), (1, "http://a.net/", None)], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")


def test_odd_rows_through_everything(spark, tmp_path):
    words = " ".join(f"w{i}" for i in range(90))
    long = " ".join(f"v{i}" for i in range(60_000))
    rows = [
        (None, None, None, None, None), (1, "", "en", None, 0), (2, words, None, "a", None), (2, words, None, "a", None), (None, words + " more", "en", "b", 3), (3, long, "en", "a", 1),
        (4, "\n".join([words] * 5), "fr", "a", 1), (5, " ".join(f"q{i}" for i in range(40)) + " " + words[::-1], "en", "a", 2), (6, "$ " * 70, "en", "a", 2),
    ]
    odd_tables(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        at = written(stage(spark, at, str(tmp_path)), name)
        if name != "packing":
            assert at.columns == docs.columns
            kept = {r.doc_id for r in at.collect()}
    assert kept >= {2, 3} and not kept & {1, 5, 6}
    for name, query in __spark_entry__.queries().items():
        if name.startswith("op"):
            assert query(spark, str(tmp_path)).count() > 0, name


def test_empty_tables_through_everything(spark, tmp_path):
    odd_tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name, query in __spark_entry__.queries().items():
        if name.startswith("op") and not name.startswith("op1_"):
            assert query(spark, str(tmp_path)).count() == 0, name
