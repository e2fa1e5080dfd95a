"""The pipeline against its stages, worked out another way."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import shingles
from tidemark.llm import toxicity
from tidemark.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    import corpus_pipeline

    folder = tmp_path_factory.mktemp("stages")
    out, docs = [table(spark, SF, "documents")], table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs)
    return out


def test_columns(stages):
    assert all(d.columns == stages[0].columns for d in stages[:-1])


def test_each_stage(spark, stages):
    ids = [Counter(r["doc_id"] for r in d.select("doc_id").collect()) for d in stages]
    texts = {r["doc_id"]: r["text"] for r in stages[0].collect()}
    # what is left after the model's stage scores below one half
    assert {r["doc_id"] for r in toxicity.op4_toxicity(spark, SF).where("predicted = 0").select("doc_id").collect()} == set(ids[1])
    leader = {d: d for d in ids[1]}

    def find(x):
        while leader[x] != x:
            x = leader[x]
        return x

    sets = {d: shingles(texts[d]) for d in ids[1]}
    for d in sets:
        for e in sets:
            if d < e and sets[d] and 100 * len(sets[d] & sets[e]) >= 80 * len(sets[d] | sets[e]):
                a, b = sorted((find(d), find(e)))
                leader[b] = a
    assert set(ids[2]) == {find(d) for d in sets}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    grams = set()
    for r in table(spark, SF, "benchmark").collect():
        w = words(r["text"])
        grams |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(g) for g in grams}
    clean = {d for d in ids[2] if not any(tuple(w[i : i + n]) in grams for w in [words(texts[d])] for n in sizes for i in range(len(w) - n + 1))}
    assert set(ids[3]) == clean
    assert set(ids[4]) <= clean and max(ids[4].values()) <= 2 and ids[5] == ids[4]
    assert sorted({r["shard"] for r in stages[5].collect()}) == list(range(24))


def test_stages_of_an_odd_table(spark, tmp_path):
    """Nulls in every column, empty and long texts, ties, repeated rows and other columns with names that operators use."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    base = " ".join(f"word{i}" for i in range(60))
    item = " ".join(f"bench{i}" for i in range(12))
    rows = [(1, base, "en", "a", 1), (1, base, "en", "a", 1), (2, base + " end", "en", "a", 1), (3, None, None, None, None), (4, "", "en", "b", 0), (None, base + " other end", "en", None, 1)]
    rows += [(5, item, "en", "b", 1), (6, "long " * 200_000, "en", "b", 1), (7, "long " * 200_000 + "x", "en", "b", 1), (None, None, None, None, None), (8, "one two", None, "c", 2)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 0, 0), (None, None, None), (8, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    odd = ["kind", "pos", "hash", "span", "its", "g_hash", "bad_id", "bad_hash", "label_id", "y", "score", "later_id", "row_key", "uid", "n_copies", "rate", "target", "shard", "slot", "size", "group", "cell"]
    docs = table(spark, str(tmp_path), "documents").withColumns({c: F.lit(1) for c in odd})
    out = []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, str(tmp_path))
        assert name == "sharding" or after.columns == docs.columns
        after.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        out.append(sorted((str(r["doc_id"]) for r in docs.collect())))
    assert out[0] == sorted(str(r[0]) for r in rows)  # no model, no toxic text
    assert out[1] == ["1", "3", "4", "5", "6", "7", "8", "None"] and out[2] == ["1", "3", "4", "6", "7", "8", "None"]
    assert set(out[3]) <= set(out[2]) and out[4] == out[3]


def test_stages_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert toxicity.op4_toxicity(spark, str(tmp_path)).count() == 0
