"""Quality rules and exact dedup."""

import hashlib
import re
from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clientlens.llm import exact_dedup, quality_rules
from tests.llm.conftest import HARD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    at = defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    covered = {i + o for v in at.values() if len(v) > 1 for i in v for o in range(5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def of(row):
    return (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words)


def test_measures_on_hard_rows(hard):
    got = sorted((r.doc_id is None, r.doc_id or 0, of(r)) for r in quality_rules.op4(hard).collect())
    assert got == sorted((i is None, i or 0, measures(t)) for i, t, _ in HARD)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.sampled_from("ab \n\t#!A"), max_size=60), min_size=1, max_size=12))
def test_measures_are_brute_force(docs_of, texts):
    rows = {r.doc_id: r for r in quality_rules.op4(docs_of(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        m = measures(t)
        assert of(rows[i]) == m
        assert rows[i].base_failed == (m[0] < 10 or 100 * m[4] > 20 * m[0])


def test_policies_are_masks_and_keep_keeps_columns(hard, empty):
    clean = "the quick brown fox jumps over a lazy dog near some river bank"
    d = hard.where("doc_id in (4, 7)").withColumn("text", F.when(F.col("doc_id") == 7, clean).otherwise(F.col("text")))
    d = d.withColumn("n_words", F.lit("clash")).withColumn("fail_bits", F.lit(1)).withColumn("t", F.lit(2))
    kept = quality_rules.keep(d)
    assert kept.columns == d.columns and [r.text for r in kept.collect()] == [clean]
    assert quality_rules.keep(empty).count() == 0
    led = quality_rules.ledger(d)
    assert {r.doc_id for r in led.where(quality_rules.verdict(F.col("fail_bits"), "base")).collect()} == {7}


def test_ablation_counts(docs_of):
    texts = ["a b c", "! " * 30, "p q r s t u v w x y z", "l1 | | | m n o p q r s t u v"]
    led = quality_rules.ledger(docs_of(list(enumerate(texts)))).cache()
    bits = [r.fail_bits for r in led.collect()]
    for r in quality_rules.ablation(led).collect():
        mask = quality_rules.POLICIES[quality_rules.POLICY]
        assert r.failed == sum(b & r.bit != 0 for b in bits)
        assert r.failed_alone == sum(b & mask == r.bit for b in bits)
        assert r.kept_without == sum(b & (mask ^ r.bit) == 0 for b in bits)


def groups(rows):
    by = defaultdict(list)
    for i, t, *_ in rows:
        by[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    return by


def check_groups(got, rows):
    by = groups(rows)
    assert len(got) == len(rows)
    for text, ids in by.items():
        own = [r for r in got if r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()]
        assert sorted(str(r.doc_id) for r in own) == sorted(map(str, ids))
        first = min((i for i in ids if i is not None), default=None)
        assert all(r.keep_id == first and r.group_size == len(ids) for r in own)
        assert [r.doc_id for r in own if r.kept] == [first]


def sha(df):
    return df.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")).collect()


def test_exact_dedup_on_hard_rows(hard):
    check_groups(sha(exact_dedup.dedup(hard)), HARD)


def test_exact_dedup_of_no_rows(empty):
    assert exact_dedup.dedup(empty).count() == 0 and exact_dedup.keep(empty).count() == 0


def test_digest_collisions_are_found_on_full_bytes(hard):
    weak = lambda t: F.substring(exact_dedup.sha256(F.substring(t, 1, 1)), 1, 1)
    got = exact_dedup.dedup(hard, digest=weak).collect()
    by = {i: ids for ids in groups(HARD).values() for i in ids}
    assert len(got) == len(HARD)
    for r in got:
        ids = by[r.doc_id]
        assert r.keep_id == min(i for i in ids if i is not None) and r.group_size == len(ids)


def test_hot_group_is_salted_and_right(docs_of):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i}") for i in range(300)]
    out = exact_dedup.dedup(docs_of(rows)).collect()
    assert len(out) == 300 and sum(r.kept for r in out) == 201
    assert {r.group_size for r in out if r.doc_id % 3 == 0} == {100}


def test_state_goes_on_over_calls(docs_of, spark):
    from clientlens.llm.common import shared_path

    where = shared_path(spark, "dedup-test")
    first, second = docs_of([(5, "a"), (6, "b")]), docs_of([(7, "a"), (8, "c")])
    exact_dedup.dedup(first, state_dir=where).count()
    ledger = spark.read.parquet(f"{where}/ledger")
    second = second.select("doc_id", F.lit("").alias("__path"), F.lit(1).cast("long").alias("__row"), exact_dedup.sha256(F.col("text")).alias("digest"))
    second.select(*ledger.columns).write.mode("append").parquet(f"{where}/ledger")
    state = exact_dedup.keyed_state(spark, f"{where}/ledger", ledger.schema, f"{where}/state")
    assert sorted((r["first"].id, r.n) for r in state.collect()) == [(5, 2), (6, 1), (8, 1)]


def test_calls_share_a_state(docs_of, spark):
    from clientlens.llm.common import shared_path

    weak = lambda t: F.substring(exact_dedup.sha256(F.substring(t, 1, 1)), 1, 1)
    calls = [[(5, "a one"), (6, "b"), (7, "a  one"), (8, "a two")], [(9, "a one"), (5, "b"), (6, "a two"), (10, "c"), (11, None)], [(6, "b"), (12, "a one"), (13, "")]]
    for digest in (exact_dedup.sha256, weak):  # weak: all that begins with one letter collides
        where, seen = shared_path(spark, "dedup-test"), []
        for k, rows in enumerate(calls):
            out = exact_dedup.dedup(docs_of(rows), digest=digest, state_dir=where, batch_bytes=1).collect()
            seen += [(i, k, " ".join((t or "").split())) for i, t in rows]
            want = []
            for i, t in rows:
                group = sorted(x for x in seen if x[2] == " ".join((t or "").split()))
                want.append((i, group[0][0], len(group), group[0][:2] == (i, k)))
            assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in out) == sorted(want)


def test_keep_drops_copies_of_a_file_table(hard, spark, tmp_path):
    wide = hard.withColumn("digest", F.lit("x")).withColumn("__hit", F.lit(1)).withColumn("row", F.lit(2))
    wide.repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    kept = exact_dedup.keep(docs)
    assert kept.columns == docs.columns
    want = {min((i for i in ids if i is not None), default=None) for ids in groups(HARD).values()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
