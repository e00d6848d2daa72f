"""Searches whose queries grow with the rows: against brute force, and without a shuffle of pairs."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestrata.operators import retrieval


def brute(docs, asked, k):
    """docs: (id, tokens) with distinct ids."""
    n, avg = len(docs), sum(len(t) for _, t in docs) / len(docs)
    df = Counter(x for _, t in docs for x in set(t))
    idf = {x: math.log((n - f + 0.5) / (f + 0.5)) for x, f in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {x: 0.25 * mean if v < 0 else v for x, v in idf.items()}
    out = set()
    for q, terms in docs:
        if not asked(q):
            continue
        score = defaultdict(float)
        for i, t in docs:
            tf = Counter(t)
            for x in terms:
                if x in tf:
                    score[i] += idf[x] * tf[x] * 2.5 / (tf[x] + 1.5 * (0.25 + 0.75 * len(t) / avg))
        best = sorted((-round(s, 9), i) for i, s in score.items())[:k]
        out |= {(q, i, r, round(-s, 6) + 0.0) for r, (s, i) in enumerate(best, 1)}
    return out


WIDE = [(i, ["all"] * (i % 3 + 1) + [f"a{i % 7}", f"b{i % 11}"] + (["half"] if i % 2 else []) + [f"own{i}"] * (i % 4)) for i in range(60)] + [(60, []), (61, ["alone"])]
#: Half of the documents have each of these, so every idf is 0 and so are the scores of pairs that share a term.
ZERO = [(i, ["x"] if i % 2 else ["y"]) for i in range(8)]


@pytest.mark.parametrize("docs", [WIDE, ZERO], ids=["wide", "zero"])
@pytest.mark.parametrize("sizes", [{}, {"lanes": 4, "query_block": 5, "task_rows": 16, "bound_pairs": 0, "bound_share": 4}], ids=["as it is", "small blocks"])
def test_bm25_search_brute(spark, docs, sizes):
    d = spark.createDataFrame(docs, "id long, t array<string>")
    s = retrieval.bm25_search(d, "id", "t", F.col("id") % 3 == 0, 5, **sizes)
    got = {(r.q, r.id, r["rank"], round(r.score, 6) + 0.0) for r in s.collect()}
    assert got == brute(docs, lambda q: q % 3 == 0, 5)


def test_bm25_search_empty(spark):
    d = spark.createDataFrame([(1, ["x"])], "id long, t array<string>")
    assert retrieval.bm25_search(d, "id", "t", F.col("id") == 5, 5).count() == 0
    assert retrieval.bm25_search(d.where("id = 5"), "id", "t", F.lit(True), 5).count() == 0


def shuffled(node):
    """The most records that a shuffle of an executed plan wrote."""
    most, name = 0, node.getClass().getSimpleName()
    if name == "ShuffleExchangeExec":
        most = node.metrics().apply("shuffleRecordsWritten").value()
    inner = [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else []
    children = node.children()
    return max([most, *map(shuffled, inner), *(shuffled(children.apply(i)) for i in range(children.size()))])


N = 2000


@pytest.fixture(scope="module")
def alike(spark, tmp_path_factory):
    """Texts that all share a term: every query meets every document."""
    d = tmp_path_factory.mktemp("alike")
    spark.range(N).selectExpr("id as doc_id", "concat('pain ', if(id % 2 = 0, 'worse', 'better'), ' after ', substr(md5(string(id)), 1, 6)) as text").write.parquet(f"{d}/documents.parquet")
    spark.range(50).selectExpr("id as vec_id", "array(float(id % 7), float(id % 5)) as embedding", "int(id % 3) as label").write.parquet(f"{d}/embeddings.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["bm25_search", "global_rrf", "hybrid_rrf"])
def test_no_pairs_shuffled(spark, alike, name):
    df = entry.queries()[name](spark, alike)
    assert df.collect()
    assert 0 < shuffled(df._jdf.queryExecution().executedPlan()) < N * (N // 100) // 4


@pytest.mark.parametrize("docs", [WIDE, ZERO], ids=["wide", "zero"])
@pytest.mark.parametrize("sizes", [{}, {"query_block": 5, "cells": 16, "dense": 2, "bound_pairs": 0, "bound_share": 4}], ids=["as it is", "small blocks"])
def test_bm25_product_brute(spark, docs, sizes):
    d = spark.createDataFrame(docs, "id long, t array<string>")
    s = retrieval.bm25_product(d, "id", "t", F.col("id") % 3 == 0, 5, **sizes)
    assert {(r.q, r.id, r["rank"], round(r.score, 6) + 0.0) for r in s.collect()} == brute(docs, lambda q: q % 3 == 0, 5)


def test_bm25_product_empty(spark):
    d = spark.createDataFrame([(1, ["x"]), (5, [])], "id long, t array<string>")
    for s in (retrieval.bm25_product(d, "id", "t", F.col("id") > 4, 5), retrieval.bm25_product(d.where("id = 5"), "id", "t", F.lit(True), 5), retrieval.bm25_product(d.where("id = 9"), "id", "t", F.lit(True), 5)):
        assert s.count() == 0


@pytest.mark.parametrize("sizes", [{}, {"query_block": 5, "cells": 16, "dense": 2, "bound_pairs": 0, "bound_share": 4}], ids=["as it is", "small blocks"])
def test_bm25_product_repeated_keys(spark, sizes):
    """Keys that are there twice, alike in length and not, and missing ones."""
    docs = [*WIDE, (3, ["all", "b3"]), (3, WIDE[3][1][::-1]), (6, ["a6", "all", "half"]), (6, []), (7, ["own7"]), (None, ["all", "half"]), (None, ["all"])]
    d = spark.createDataFrame(docs, "id long, t array<string>").repartition(3)
    asked = F.col("id") % 3 == 0
    seen = lambda s: Counter((r.q, r.id, r["rank"], round(r.score, 6) + 0.0) for r in s.collect())
    assert seen(retrieval.bm25_product(d, "id", "t", asked, 5, **sizes)) == seen(retrieval.bm25_search(d, "id", "t", asked, 5))


def written(node):
    """The most bytes that a shuffle of an executed plan wrote."""
    name = node.getClass().getSimpleName()
    own = node.metrics().apply("shuffleBytesWritten").value() if name == "ShuffleExchangeExec" else 0
    inner = [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else []
    children = node.children()
    return max([own, *map(written, inner), *(written(children.apply(i)) for i in range(children.size()))])


@pytest.mark.parametrize("name", ["global_rrf", "hybrid_rrf"])
def test_no_tokens_shuffled(spark, tmp_path, name):
    """What is shuffled doesn't grow with the lengths of the texts."""
    some = "concat_ws(' ', transform(sequence(1, 400), x -> translate(substr(md5(concat(id, '-', x % 97)), 1, 6), '0123456789', 'ghijklmnop')))"
    spark.range(1000).selectExpr("id as doc_id", f"{some} as text").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(50).selectExpr("id as vec_id", "array(float(id % 7), float(id % 5)) as embedding", "int(id % 3) as label").write.parquet(f"{tmp_path}/embeddings.parquet")
    df = entry.queries()[name](spark, str(tmp_path))
    assert df.collect()
    assert 0 < written(df._jdf.queryExecution().executedPlan()) < 100_000
