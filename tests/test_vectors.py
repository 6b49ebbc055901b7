"""Exact nearest vectors and linear chunking against brute force."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from clientlens.functions import text
from clientlens.operators import retrieval, vectors
from clientlens.plans import catalog as C

SF = "/root/testdata/sf0.001"


def brute(qs, docs, dim, k):
    """Distances of every pair, rounded, ties by key."""
    def vec(t):
        import hashlib
        import re
        v = np.zeros(dim)
        for w in re.findall(f"[{text.TOKEN_CHARS}]+", t.lower()):
            v[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim] += 1
        n = np.sqrt((v * v).sum())
        return v / n if n else v
    c = {i: vec(t) for i, t in docs}
    out = set()
    for q, t in qs:
        v = vec(t)
        d = sorted((round(float((v * v).sum() + (x * x).sum() - 2 * (v * x).sum()), 12) + 0.0, i) for i, x in c.items())
        out |= {(q, r + 1, i, f"{x:.6f}") for r, (x, i) in enumerate(d[:k])}
    return out


@pytest.mark.parametrize("seed, k", [(1, 5), (2, 1), (3, 90)])
def test_nearest_texts_equal_brute_force(spark, seed, k):
    rng = random.Random(seed)
    words = ["churn", "plan", "usage", "client", "offre", "été", "rétention", "appel", "mail", "suivi", "!!!"]
    docs = [(f"c{i:03d}", " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(70)]
    docs += [("c999", "!!! ??"), ("c000b", ""), ("a", "?"), ("dup", docs[0][1]), ("dup2", docs[0][1])]
    qs = [(1, "churn client"), (2, "zzz unknown"), (3, "été offre appel suivi"), (4, "?"), (5, docs[0][1])]
    corpus = spark.createDataFrame(docs, "id string, text string").repartition(3)
    got = vectors.nearest_texts(spark.createDataFrame(qs, "q int, text string"), "q", corpus, "id", k=k, dim=16)
    assert {(r.q, r["rank"], r.id, f"{r.distance:.6f}") for r in got.collect()} == brute(qs, docs, 16, k)


@pytest.mark.parametrize("block, k", [(1, 3), (7, 3), (64, 9)])
def test_scan_in_slices_and_blocks_of_any_size(block, k):
    rng = np.random.RandomState(block)
    x = rng.poisson(0.7, (200, 12)).astype(float)
    x[::17] = 0
    x[50:60] = x[3]
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    x = np.divide(x, norm, out=x, where=norm > 0)
    q = np.concatenate([x[:6], x[17:18], np.eye(12)[:2]])
    scan, keys = vectors.Scan(q, k, block), [f"k{i:03d}" for i in range(200)]
    for a in range(0, 200, 23):
        scan.add(x[a : a + 23], keys[a : a + 23], lambda i: None)
    for j, v in enumerate(q):
        d = sorted((round(float((v * v).sum() > 0) + float((y * y).sum() > 0) - 2 * float((v * y).sum()), 12) + 0.0, n) for y, n in zip(x, keys))
        got = sorted((o.distance, o.key) for o, _ in scan.best[j])
        assert [n for _, n in got] == [n for _, n in d[:k]] and np.allclose([a for a, _ in got], [a for a, _ in d[:k]])
    assert scan.exact + scan.skipped <= scan.pairs


def test_question_blocks_and_empty_sides(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUESTION_BYTES", 8 * 16 * 2)  # two questions a block
    qs = [(i, f"w{i} w{i + 1}") for i in range(5)]
    docs = [(f"d{i}", f"w{i % 7} x") for i in range(30)]
    q, d = spark.createDataFrame(qs, "q int, text string"), spark.createDataFrame(docs, "id string, text string")
    got = vectors.nearest_texts(q, "q", d, "id", k=3, dim=16)
    assert {(r.q, r["rank"], r.id, f"{r.distance:.6f}") for r in got.collect()} == brute(qs, docs, 16, 3)
    assert vectors.nearest_texts(q.limit(0), "q", d, "id").collect() == []
    assert vectors.nearest_texts(q, "q", d.limit(0), "id").collect() == []
    with pytest.raises(ValueError):
        vectors.nearest_texts(q, "q", d, "id", k=0)


def test_few_pairs_are_scored_exactly(spark):
    """At sf0.1 under a tenth of the pairs is scored in double precision."""
    t = C._t(spark, "/root/testdata/sf0.1")
    chunks = retrieval.chunk_fixed(t.documents.select("doc_id", "text"), "doc_id").repartition(4)
    n = vectors.nearest_texts(t.benchmark.select("item_id", "text"), "item_id", chunks, "id", counts=True).first()
    assert n.pairs == t.benchmark.count() * chunks.count() and n.exact < 0.1 * n.pairs and n.skipped > 0


def test_hashed_embedding_is_row_local(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, None), (3, "?"), (1, "É é")], "id int, text string")
    out = vectors.hashed_embedding(df, dim=8)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    rows = out.collect()
    assert [r.id for r in rows] == [1, 2, 3, 1] and all(len(r.embedding) == 8 for r in rows)
    assert [round(sum(x * x for x in r.embedding), 5) for r in rows] == [1, 0, 0, 1]


def clustered(spark, n, groups, dim=16, seed=5):
    rng = np.random.RandomState(seed)
    centre = rng.randn(groups, dim) * 10
    x = centre[rng.randint(0, groups, n)] + rng.randn(n, dim) * 0.3
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id int, embedding array<float>")


@pytest.mark.parametrize("pivots", [1, 8, 64])
def test_pivot_index_equals_brute_force_and_prunes(spark, pivots):
    emb = clustered(spark, 600, 12)
    qs = emb.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qvec"))
    index = vectors.PivotIndex.build(emb, "vec_id", pivots=pivots)
    got = index.topk(qs, "q", k=4)
    assert "CartesianProduct" not in (p := got._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in p
    want = retrieval.vector_topk(qs, "q", emb, "vec_id", k=4)
    rows = lambda d: {(r.q, r["rank"], r.vec_id, round(r.distance, 6)) for r in d.collect()}
    assert rows(got) == rows(want)
    if pivots == 64:
        assert index.pruned_share(qs, "q") > 0.7


def test_pivot_index_ties_hot_vector_and_few_rows(spark):
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(300)] + [(900, [0.0, 1.0])], "vec_id int, embedding array<float>")
    qs = same.where("vec_id IN (7, 900)").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qvec"))
    for emb, k in ((same, 3), (same, 400), (same.limit(2), 4)):
        got = vectors.PivotIndex.build(emb, "vec_id", pivots=8).topk(qs, "q", k=k)
        want = retrieval.vector_topk(qs, "q", emb, "vec_id", k=k)
        assert {(r.q, r["rank"], r.vec_id) for r in got.collect()} == {(r.q, r["rank"], r.vec_id) for r in want.collect()}


def greedy(sizes, limit):
    out, buf, first = [], 0, None
    for i, p in enumerate(sizes):
        if buf + p + 2 <= limit:
            first, buf = (i, p) if not buf else (first, buf + 2 + p)
        else:
            out += [first] if buf else []
            first, buf = i, p
    return out + ([first] if buf else [])


def test_chunk_starts_equal_the_greedy_fold():
    rng = random.Random(0)
    for _ in range(3000):
        limit = rng.choice([5, 10, 20, 50])
        sizes = [rng.randrange(1, limit + 8) for _ in range(rng.randrange(1, 30))]
        assert retrieval.chunk_starts(np.array(sizes), limit).tolist() == greedy(sizes, limit)


def test_many_paragraphs_are_packed_in_linear_time(spark):
    n = 200_000
    body = "\n\n".join("p" * (1 + i % 40) for i in range(n))
    docs = spark.createDataFrame([(1, body), (2, None), (3, " \n \n "), (4, "one")], "doc_id int, text string")
    t0 = time.time()
    rows = retrieval.chunk_paragraphs(docs, "doc_id").collect()
    assert time.time() - t0 < 60
    own = sorted((r.chunk, r.text) for r in rows if r.source == 1)
    assert [c for c, _ in own] == list(range(len(own))) and "\n\n".join(t for _, t in own) == body
    assert len(own) == len(greedy([1 + i % 40 for i in range(n)], 900)) and [(r.source, r.text) for r in rows if r.source != 1] == [(4, "one")]


def test_row_tokens_equal_the_expression(spark):
    docs = C._t(spark, SF).documents.select("doc_id", "text")
    want = docs.select("doc_id", F.explode(text.tokens(F.col("text"))).alias("token")).groupBy("doc_id", "token").count()
    assert sorted(map(tuple, retrieval.token_frequencies(docs, ["doc_id"]).collect())) == sorted(map(tuple, want.collect()))


def test_texts_of_hits_chunk_only_documents_that_hold_one(spark):
    docs = spark.createDataFrame([(i, f"p{i}\n\n" + "q" * 899) for i in range(40)] + [(3, "again"), (None, "none")], "doc_id long, text string")
    t = C.Tables(spark, SF, {"documents": docs})
    seen, chunked = [], retrieval.chunk_paragraphs
    hits = spark.createDataFrame([(1, 3, 0), (1, 5, 1), (2, 3, 0), (2, 77, 0)], "item_id int, doc_id long, chunk int")
    C.rt.chunk_paragraphs = lambda d, *a: seen.append(d.count()) or chunked(d, *a)
    try:
        got = sorted((r.item_id, r.doc_id, r.chunk, r.text) for r in C.with_chunk_texts(t, hits).collect())
    finally:
        C.rt.chunk_paragraphs = chunked
    assert seen == [3]
    assert got == sorted((i, d, c, x) for i, d, c in ((1, 3, 0), (1, 5, 1), (2, 3, 0)) for x in (["q" * 899] if c else [f"p{d}", *(["again"] if d == 3 else [])]))


def test_pivot_index_compares_blocks(spark, monkeypatch):
    """Pairs of a query and a vector are no rows of a plan; block borders change nothing."""
    monkeypatch.setattr(vectors, "CELL_ROWS", 7)
    monkeypatch.setattr(vectors, "QUERY_ROWS", 3)
    emb = clustered(spark, 200, 3).unionByName(clustered(spark, 200, 3).withColumn("vec_id", F.col("vec_id") + 500))
    qs = emb.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qvec"))
    sizes, nearest = [], vectors._nearest
    monkeypatch.setattr(vectors, "_nearest", lambda *a: sizes.append(a[1]) or nearest(*a))
    got = vectors.PivotIndex.build(emb, "vec_id", pivots=4).topk(qs, "q", k=5)
    assert sizes == [5, 5] and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"
    want = retrieval.vector_topk(qs, "q", emb, "vec_id", k=5)
    rows = lambda d: sorted((r.q, r["rank"], r.vec_id, r.distance) for r in d.collect())
    assert rows(got) == rows(want)
