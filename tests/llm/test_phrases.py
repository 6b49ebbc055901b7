"""Phrase mining against a plain restatement; the shard cycle itself; slots that collide."""

import random
import re
from collections import Counter, defaultdict

import pytest

from clientlens.llm import phrases


def brute(rows, min_count, top=2000, longest=5):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        cand = {p: a for p, a in own.items() if len(p) > 1 and a >= min_count}
        longer = Counter()
        for p, a in cand.items():
            for s in range(2, len(p)):
                for i in range(len(p) - s + 1):
                    longer[p[i : i + s]] = max(longer[p[i : i + s]], a)
        rows_ = []
        for p, a in cand.items():
            if 100 * longer[p] >= 100 * a:
                continue
            score, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for i, (s, a, p, x, y) in enumerate(sorted(rows_)[:top]):
            out.append((lang, i + 1, p.decode(), -a, x, y, n[lang], -s))
    return sorted(out)


def texts(seed, n=120):
    rng = random.Random(seed)
    vocabulary = ["of", "the", "New", "york", "city", "été", "x", "日本", "a\x0bb", "'q'"] + [f"w{i}" for i in range(30)]
    fixed = ["new york city hall of", "the cat sat on the mat", "a a a a a a a", "of the"]
    out = []
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.4 else " ".join(rng.choices(vocabulary, k=rng.randrange(1, 9))) for _ in range(rng.randrange(1, 12))]
        out.append((rng.choice(["en", "en", "en", "fr", None]), "".join(p + rng.choice([" ", "\t", ". ", "\n", "!?", ", ", "  "]) for p in parts)))
    return out


def table(spark, rows, parts=3):
    return spark.createDataFrame([(la, t, "x", 1) for la, t in rows], "lang string, text string, phrase string, n int").repartition(parts)


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("shards, slots, buckets", [(1, 1 << 20, 1 << 20), (2, 1 << 15, 16), (4, 64, 1 << 17)])
def test_equals_brute_force(spark, shards, slots, buckets):
    """Few slots or buckets: nearly every phrase shares one, which must cost work only."""
    rows = texts(shards) + [(None, None), ("en", ""), ("de", " .,; "), ("fr", "one"), ("en", "long word " * 3_000)] + [("en", "copied words here again")] * 50
    assert found(phrases.mine(table(spark, rows), min_count=20, shards=shards, slots=slots, buckets=buckets, chunk=200)) == brute(rows, 20)
    assert found(phrases.mine(table(spark, rows), min_count=5, top=7, shards=shards, slots=slots, buckets=buckets, chunk=200)) == brute(rows, 5, 7)


def test_words_of_two_languages_in_a_slice_do_not_meet(spark):
    rows = [("en", "a b"), ("fr", "a b"), ("en", "c")] * 30
    assert found(phrases.mine(table(spark, rows, 1), min_count=10)) == brute(rows, 10)


def test_scores_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a, n, x, y = 10**14 + 7, 9 * 10**16 + 1, 3 * 10**14 + 1, 10**14 + 9
    got = spark.range(1).select(phrases.score(F.lit(a), F.lit(n), F.lit(x), F.lit(y))).first()[0]
    assert got == 1000 * a * n // (x * y)


def test_empty_table(spark):
    assert phrases.mine(table(spark, [])).collect() == []
    assert phrases.mine(table(spark, [("en", None), (None, "")])).collect() == []


def test_batches_sent_are_small_and_counts_whole():
    import numpy as np
    import pyarrow as pa

    words = [f"w{i}" for i in range(3 * phrases.SENT)]
    hashes = np.arange(1, 2 * len(words) + 1, dtype=np.uint64).tobytes()
    chunk = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([words]), pa.array([hashes], pa.binary()), pa.array([np.arange(len(words), dtype=np.int32).tobytes()], pa.binary())],
                                       names=["lang", "words", "hashes", "ids"])

    class Shared:
        value = (np.full(64, phrases.NEVER, np.uint8).tobytes(),) * 2

    out = list(phrases._step(Shared, 0, 2, 5)(iter([chunk])))
    assert max(b.num_rows for b in out) <= phrases.SENT and sorted(p for b in out for p in b.column("phrase").to_pylist()) == sorted(words)
