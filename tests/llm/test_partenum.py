"""N-gram Jaccard join against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clientlens.llm import components, partenum
from clientlens.llm.shingles import shingle_set
from tests.llm.conftest import HARD


def sets_of(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).replace(" ", "\0").encode().split()
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute(rows):
    sets = [(i, sets_of(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}


def check(docs, rows):
    got = partenum.join(docs).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert sorted((r.doc_id or -1, r.n_shingles) for r in got) == sorted((i or -1, len(sets_of(t))) for i, t in rows)


def test_hard_rows(hard):
    check(hard, [(i, t) for i, t, _ in HARD])


def test_no_rows(empty):
    assert partenum.join(empty).count() == 0 and partenum.keep(empty).count() == 0


def words(n, seed):
    r = random.Random(seed)
    return [f"w{r.randrange(10**6)}" for _ in range(n)]


def edited(base, share, r):
    return " ".join(w if r.random() > share else f"e{r.randrange(10**6)}" for w in base)


@pytest.mark.parametrize("n", [6, 12, 40, 200])
def test_chains_of_near_copies(docs_of, n):
    """Copies around the threshold, links that only join through a third text, sizes apart."""
    r = random.Random(n)
    rows = []
    for c in range(6):
        base = words(n, 100 * n + c)
        rows += [(len(rows) + k, edited(base, 0.03 * k / 4, r)) for k in range(5)]
        rows += [(len(rows) + k, " ".join(base[: n - k * n // 12])) for k in range(4)]
        at = base[:]
        for _ in range(8):  # drifts away from the base, step by step
            at[r.randrange(n)] = f"d{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(at)))
    check(docs_of(rows), rows)


def test_large_buckets_and_the_exact_rest(docs_of, monkeypatch):
    """A small CAP sends near copies and shared passages through stars and prefix filter."""
    monkeypatch.setattr(partenum, "CAP", 3)
    r = random.Random(5)
    base, passage, rows = words(30, 1), words(12, 2), []
    rows += [(i, edited(base, r.choice([0.0, 0.02, 0.05, 0.1]), r)) for i in range(60)]
    rows += [(60 + i, " ".join(passage + words(4, 50 + i % 9) + ([f"z{i}"] if i % 2 else []))) for i in range(60)]
    check(docs_of(rows), rows)


def test_the_exact_rest_has_one_python_step_a_stage(docs_of, spark, monkeypatch):
    """Texts become shingles in one Python step: two of them in a stage hold two workers a task."""
    steps, write = {}, partenum.shared_table

    def seen(df, label):
        steps[label] = df._jdf.queryExecution().executedPlan().toString().split("Exchange")[0].count("MapInArrow")
        return write(df, label)

    r, base = random.Random(5), words(30, 1)
    rows = [(i, edited(base, r.choice([0.0, 0.02, 0.05, 0.1]), r)) for i in range(20)] + [(20, "one two"), (21, None)]
    texts = write(docs_of(rows).select("doc_id", "text"), "test-texts")
    monkeypatch.setattr(partenum, "shared_table", seen)
    step = partenum._Join(texts, write(texts.mapInArrow(partenum._sized, partenum._SIZED_DDL), "test-sized"), False)
    step.add(spark.createDataFrame([], "a long, b long"))
    step.rest(texts.select("doc_id"))
    got = step.labelled(texts.select(F.col("doc_id").alias("node")), "node", "component").collect()
    assert {x.node: x.component for x in got} == brute(rows)
    assert steps["jaccard-items"] == 1


def test_signatures_find_every_linked_pair():
    """Completeness by hand: linked sets share a signature or one of them is deficient."""
    r = np.random.default_rng(3)
    for size in (1, 2, 3, 4, 5, 7, 9, 11, 16, 30, 63, 64, 80, 200, 700):
        for _ in range(30):
            a = r.integers(0, 2**63, size).astype(np.uint64)
            keep = max(1, int(np.ceil(size * r.uniform(0.78, 1.0))))
            b = np.concatenate([r.permutation(a)[:keep], r.integers(0, 2**63, int(r.integers(0, size // 8 + 1))).astype(np.uint64)])
            a, b = np.unique(a), np.unique(b)
            both = len(np.intersect1d(a, b))
            if 100 * both < 80 * (len(a) + len(b) - both):
                continue
            who, sig, spare = partenum.signatures(np.array([len(a), len(b)]), np.concatenate([a, b]))
            shared = set(sig[who == 0].tolist()) & set(sig[who == 1].tolist())
            assert len(shared) > max(spare)  # what is shared outlasts what may be lost


def test_shingles_count_like_tuples():
    for t in ["", "a", "A b", "a a a a a a a", "x y z " * 50, "é É ß", None]:
        assert len(shingle_set(t)) == len(sets_of(t))


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, **{200 + i: 100 for i in range(50)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_has_one_document_of_each_group(docs_of, spark, tmp_path):
    base = " ".join(words(60, 9))
    rows = [(3, base), (1, base + " x"), (2, "other text of its own here"), (4, None), (None, base)]
    docs_of(rows).withColumn("component_id", F.lit(0)).withColumn("__slice", F.lit(0)).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    kept = partenum.keep(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "4"]


def test_keep_compares_rows_whatever_their_ids(docs_of, spark, tmp_path):
    x, y, z, v = (" ".join(words(60, 20 + i)) for i in range(4))
    rows = [(3, x), (5, x + " near"), (5, y), (7, z), (7, z + " near"), (8, None), (8, "")]
    rows += [(None, v + (f" n{i}" if i else "")) for i in range(6)]
    want = sorted([x, y, "", "None"])
    for docs in (docs_of(rows), docs_of(rows).repartition(3)):
        docs.write.mode("overwrite").parquet(str(tmp_path / "d"))
        for table in (docs, spark.read.parquet(str(tmp_path / "d"))):
            kept = partenum.keep(table).collect()
            assert sorted(str(r.text) for r in kept if r.doc_id in (3, 5, 8)) == want  # the clean text of id 5 stays
            assert sum(r.doc_id == 7 for r in kept) == 1  # near copies of one id
            assert sum(r.doc_id is None for r in kept) == 1 and len(kept) == 6
