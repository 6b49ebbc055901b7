"""Source divergence: the tree's sums against a plain restatement in exact integers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from clientlens.functions import runs
from clientlens.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, min_docs=3, top=200):
    count, in_docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        groups.add((lang, source))
        count[lang, source].update(terms)
        in_docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in in_docs[lang].items() if n >= min_docs]
        sources = sorted(s for x, s in groups if x == lang)
        c = {s: {t: count[lang, s][t] for t in kept} for s in sources}
        c[None] = {t: sum(c[s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + 10**9 * (n + 1) // (sum(own.values()) + len(kept)) for t, n in own.items()} for s, own in c.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(x, sum(f(p[s][t], p[x][t]) for t in kept)) for x in sources if x != s]
            terms = [(t, f(p[s][t], p[None][t])) for t in kept if c[s][t] and p[s][t] > p[None][t]]
            for part, own, limit in (("pair", pairs, None), ("term", terms, top)):
                own.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(own[:limit])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(1, t, la, s, "x") for la, s, t in rows], "doc_id long, text string, lang string, source string, term string")


def found(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in df.collect())


def test_equals_brute_force(spark):
    rng = random.Random(3)
    words = ["the", "The", "été", "x1y", "日本", "a-b", "Éa", "zz", "q"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s3", None, "é"]), " ".join(rng.choices(words, k=rng.randrange(0, 30)))) for _ in range(150)]
    rows += [("en", "s1", None), ("de", "only", "a b c"), ("it", "none", "1 2 3"), ("it", "two", ""), ("en", "s1", "long " * 20_000)] + [("en", "s2", "copy of copy")] * 40
    assert found(divergence.audit(table(spark, rows))) == brute(rows)
    assert found(divergence.audit(table(spark, rows), min_docs=30, top_terms=2)) == brute(rows, 30, 2)


def test_hot_source(spark):
    rows = [("en", "hot" if i % 3 else f"s{i % 7}", f"alpha beta{'abc'[i % 3]} gamma{'xyz'[i % 3]}") for i in range(90)]
    assert found(divergence.audit(table(spark, rows))) == brute(rows)


@pytest.mark.parametrize("pairs", [1, 7, 1 << 20])
def test_corrections_in_chunks_of_any_size(pairs):
    size, place, value = np.array([3, 3, 1, 2]), np.array([1, 2, 4, 1, 2, 5, 3, 3, 4]), np.array([50, 60, 9, 50, 60, 8, 7, 7, 11])
    zero = place + 1
    got = Counter()
    for a, b, add in divergence.corrections(place, value, zero, *divergence.nodes(size, place, value, np.array([2, 1, 1, 3])), pairs=pairs):
        for x, y, v in zip(a.tolist(), b.tolist(), add.tolist()):
            got[x, y] += v
    f = lambda p, q: (p - q) ** 2 // q
    want = Counter()
    for off, n, m in ((0, 3, 2), (3, 3, 1), (6, 1, 1), (7, 2, 3)):
        for i in range(off, off + n):
            for j in range(off, off + n):
                if i != j:
                    p, q, zp, zq = (int(x) for x in (value[i], value[j], zero[i], zero[j]))
                    want[int(place[i]), int(place[j])] += m * (f(p, q) - f(p, zq) - f(zp, q) + f(zp, zq))
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_shared_paths_are_one_node():
    # rows (1,5)(2,6), (1,5)(2,6)(3,1), (1,5)(2,7): the nodes are the distinct prefixes
    size, place = np.array([2, 3, 2]), np.array([1, 2, 1, 2, 3, 1, 2])
    value = np.array([5, 6, 5, 6, 1, 5, 7])
    entry, depth, terms = divergence.nodes(size, place, value, np.array([4, 2, 1]))
    assert sorted(zip(place[entry].tolist(), value[entry].tolist(), depth.tolist(), terms.tolist())) == [(1, 5, 0, 7), (2, 6, 1, 6), (2, 7, 1, 1), (3, 1, 2, 2)]


def test_hard_rows_and_empty_table(hard, empty, spark):
    rows = [(r.lang, r.source, r.text) for r in hard.collect()]
    assert found(divergence.audit(hard)) == brute(rows)
    assert divergence.audit(empty).collect() == []


def test_runs_do_not_cross_texts():
    import pyarrow as pa

    texts = pa.array(["ab", "cd e", None, "", "fé"])
    (a, b, data, starts), = runs.text_slices(texts)
    first, end = runs.runs(divergence.IN_TERM[data], starts[:-1])
    ids, names = runs.numbered(data, first, end)
    assert (a, b) == (0, 5) and [names[int(i)].as_py() for i in ids] == ["ab", "cd", "e", "fé"]
    assert [x[:2] for x in runs.text_slices(texts.slice(1, 3))] == [(0, 3)]
