"""Dirty feeds through the reader into rejects; mergeable sketches against the payments themselves."""

import pytest
from pyspark.sql import functions as F

from clientlens.operators import clean, sketches
from clientlens.plans import catalog as C
from clientlens.sources.files import RAW_SCHEMAS, read_feed
from tests.conftest import SF_SMALL


def test_feed_captures_what_does_not_parse(spark, tmp_path):
    (tmp_path / "clients.csv").write_text(
        "client_id,ville,plan,date_inscription\n1,Paris,pro,2025-01-02\n2,Lyon,pro\n3,\"Saint\nDenis\",free,2025-01-03\n"
        "4,Nice,gold,2025-01-04\n5,Nice,pro,2025-01-05,extra\n,Nice,pro,2025-01-06\n6,\"Nice, \"\"bord\"\"\",basic,02/01/2025\n")
    feed = read_feed(spark, str(tmp_path / "clients.csv"), RAW_SCHEMAS["clients"])
    valid = {r.client_id: r.ville for r in clean.clean_feed("clients", feed).collect()}
    assert valid.keys() >= {"1", "3"} and valid["3"] == "Saint\nDenis"
    bad = sorted((r.client_id or "", r.reason, r.raw or "") for r in clean.feed_rejects("clients", feed).collect())
    assert ("", "corrupt_record", "2,Lyon,pro") in bad and ("", "corrupt_record", "5,Nice,pro,2025-01-05,extra") in bad
    assert ("4", "plan_invalid", "") in bad and ("", "client_id_missing", "") in bad
    r = clean.reconciliation("clients", feed).first()
    assert (r.n_records, r.n_valid + r.n_rejected, r.ok) == (7, 7, True)
    assert feed.select("_file").distinct().first()[0].endswith("clients.csv")


def test_empty_feed_reconciles(spark, tmp_path):
    (tmp_path / "u.csv").write_text("client_id,actions,sessions,timestamp\n")
    feed = read_feed(spark, str(tmp_path / "u.csv"), RAW_SCHEMAS["usage"])
    assert tuple(clean.reconciliation("usage", feed).first()) == ("usage", 0, 0, 0, True)


def test_dirty_feeds_reconcile(spark):
    rows = {r.source: r for r in C.QUERIES["feed_reconciliation"](spark, SF_SMALL).collect()}
    assert set(rows) == set(C.FEEDS) and all(r.ok and r.n_rejected > 0 and r.n_valid > 0 for r in rows.values())


@pytest.fixture(scope="module")
def payments(spark):
    n = 60_000
    rows = spark.range(n).select(
        (F.pmod(F.xxhash64("id"), F.lit(7_000))).alias("client_id"), F.element_at(F.array(F.lit("free"), F.lit("pro"), F.lit(None).cast("string")), (F.col("id") % 3 + 1).cast("int")).alias("plan"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(90)).cast("int")).alias("date_paiement"),
        (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1_000_000)) / 100).cast("decimal(18,2)").alias("montant"))
    # a third of all rows: one client, one day, one amount
    return rows.unionByName(spark.range(n // 2).select(F.lit(1).cast("long").alias("client_id"), F.lit("pro").alias("plan"), F.lit("2024-02-01").cast("date").alias("date_paiement"), F.lit(5).cast("decimal(18,2)").alias("montant")))


@pytest.mark.parametrize("first, last, quantile", [("2024-01-01", "2024-12-31", 0.5), ("2024-01-10", "2024-01-31", 0.9), ("2024-02-01", "2024-02-01", 0.5)])
def test_merged_sketches_stay_within_their_bounds(payments, first, last, quantile):
    facts = sketches.range_facts(sketches.daily_sketches(payments), first, last, quantile=quantile)
    rows = sketches.within_bounds(facts, payments, first, last, quantile).collect()
    assert rows and all(r.clients_ok and r.quantile_ok for r in rows)
    days = payments.where(F.col("date_paiement").between(first, last)).groupBy("plan").agg(F.count(F.lit(1)).alias("n"), F.sum("montant").alias("s")).collect()
    assert {(r.plan, r.n, r.total) for r in facts.collect()} == {(r.plan, r.n, r.s) for r in days}


def test_a_range_of_days_does_not_read_payments_again(spark, payments, tmp_path):
    table = sketches.sketch_table(spark, str(tmp_path / "s"))
    jan, rest = payments.where("date_paiement < '2024-02-01'"), payments.where("date_paiement >= '2024-02-01'")
    days = table.append(sketches.daily_sketches(jan))
    assert days == jan.select("date_paiement", "plan").distinct().count()
    assert table.append(sketches.daily_sketches(jan)) == 0 and table.append(sketches.daily_sketches(rest)) > 0
    facts = sketches.range_facts(table.read(), "2024-01-15", "2024-02-20")
    assert all("/batches/" in f for f in facts.inputFiles())
    assert {(r.plan, r.n) for r in facts.collect()} == {tuple(r) for r in payments.where("date_paiement BETWEEN '2024-01-15' AND '2024-02-20'").groupBy("plan").count().collect()}


def test_rows_without_date_or_amount(spark):
    p = spark.createDataFrame([(1, "pro", None, 5.0), (1, "pro", "2024-01-01", None)], "client_id long, plan string, d string, m double")
    p = p.select("client_id", "plan", F.col("d").cast("date").alias("date_paiement"), F.col("m").cast("decimal(18,2)").alias("montant"))
    r = sketches.range_facts(sketches.daily_sketches(p), "2024-01-01", "2024-01-31").collect()
    assert [(x.n, x.total, x.clients, x.quantile) for x in r] == [(1, None, 1, None)]
    assert sketches.range_facts(sketches.daily_sketches(p.limit(0)), "2024-01-01", "2024-01-31").collect() == []
