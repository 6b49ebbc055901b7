"""Mixing: targets, offsets and positions against a plain restatement."""

import hashlib
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from clientlens.llm import mixing


def targets(sizes):
    """Iterated resharing, exact."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    left, open_, out = Fraction(3 * sum(sizes.values()), 2), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            return {**out, **{s: left * weight[s] / total for s in open_}}
        for s in over:
            out[s] = Fraction(2 * sizes[s])
        left -= sum(out[s] for s in over)
        open_ -= set(over)
    return out


def check(docs, rows):
    got = mixing.plan(mixing.sized(docs)).collect()
    size = lambda t: len((t or "").replace("\x0b", " ").split())
    per = defaultdict(int)
    for _, t, s in rows:
        per[s] += size(t)
    goal, order = targets(per), defaultdict(list)
    for i, t, s in rows:
        order[s].append((hashlib.md5(str(i).encode()).hexdigest(), i, size(t)))
    want = []
    for s, own in order.items():
        for e in (0, 1):
            at = e * per[s]
            for _, i, n in sorted(own):
                if (taken := max(0, min(n, int(goal[s]) - at))) > 0:
                    want.append((i, e, taken))
                at += n
    assert sorted((r.doc_id, x.epoch, x.words) for r in got for x in r.occurrences) == sorted(want)
    for r in got:
        assert r.target == pytest.approx(float(goal[r.source])) and r.taken <= 2 * r.size
        assert all(0 <= x.position <= 1 for x in r.occurrences)
    return got


@pytest.mark.parametrize("n, sources", [(40, 1), (60, 4), (90, 7)])
def test_plan_equals_restatement(docs_of, n, sources):
    rows = [(i, "w " * (i * 7 % 23), None if i % sources == 3 else f"s{i % sources if i % 3 else 0}") for i in range(n)]
    got = check(docs_of(rows), rows)
    # a source's first words are trained first
    for s in {r.source for r in got}:
        own = sorted((x.epoch, r.before, x.position) for r in got if r.source == s for x in r.occurrences)
        assert [p for _, _, p in own] == sorted(p for _, _, p in own)


def test_hard_rows_do_not_crash(hard, empty):
    got = mixing.plan(mixing.sized(hard)).collect()
    assert len(got) == 12 and all(r.taken == 0 for r in got if r.size == 0)
    assert mixing.plan(mixing.sized(empty)).count() == 0 and mixing.curriculum(empty).count() == 0


def test_no_words_at_all(docs_of):
    got = mixing.plan(mixing.sized(docs_of([(1, "", "a"), (2, None, None)]))).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2


def test_schedules_invert(spark):
    shares = [i / 50 for i in range(51)]
    d = spark.createDataFrame([(x,) for x in shares], "x double")
    for schedule in (*mixing.SCHEDULES, ((0.0, 0.0), (0.3, 2.0), (1.0, 0.0))):
        for x, t in d.select("x", mixing.time_at(F.col("x"), schedule).alias("t")).collect():
            area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:]))
            done = 0.0
            for a, b in zip(schedule, schedule[1:]):
                u = min(max(t - a[0], 0), b[0] - a[0])
                done += a[1] * u + (b[1] - a[1]) / (b[0] - a[0]) * u * u / 2
            assert done / area == pytest.approx(x, abs=1e-9)


def test_curriculum_is_in_order_and_keeps_texts_whole(docs_of, spark, tmp_path):
    rows = [(i, "\n".join(f"w{i}_{j}" for j in range(5 + i % 11)), f"s{i % 3}") for i in range(60)]
    docs_of(rows).withColumn("__position", F.lit("x")).withColumn("size", F.lit(1)).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    plan = {(r.doc_id): r for r in mixing.plan(mixing.sized(docs)).collect()}
    out = mixing.curriculum(docs)
    assert out.columns == docs.columns
    got = out.collect()
    texts = {i: t for i, t, _ in rows}
    assert all(r.text == texts[r.doc_id] and r.n_chars == len(r.text) for r in got)
    # an occurrence that the target cuts is taken if at least half of it is
    want = sorted((x.position, r.doc_id) for r in plan.values() for x in r.occurrences if 2 * x.words >= r.size)
    assert [r.doc_id for r in got] == [i for _, i in want]
    cut = [x for r in plan.values() for x in r.occurrences if x.words < r.size]
    assert 0 < len(cut) <= 3
    per = defaultdict(int)
    for r in got:
        per[r.source] += plan[r.doc_id].size
    assert all(abs(per[s] - next(r.target for r in plan.values() if r.source == s)) <= 8 for s in per)
