"""Whole-table properties on the driver's smallest tables."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from clientlens.operators import churn, retrieval
from clientlens.plans import catalog as C
from tests.conftest import SF_SMALL

Q = E.queries()


def test_report_covers_clients_and_sums(spark):
    t = C._t(spark, SF_SMALL)
    rep = C.build_report(t)
    assert rep.count() >= t.clients().count()
    assert rep.select("client_id").distinct().count() == rep.count()
    by_plan = Q["revenue_by_plan"](spark, SF_SMALL).agg(F.sum("ca_total")).first()[0]
    total = rep.where("plan IS NOT NULL").agg(F.sum(F.col("ca_total").cast("decimal(28,2)"))).first()[0]
    assert abs(by_plan - float(total)) < 1e-6
    paid = t.subscriptions().where("statut = 'paid'").agg(F.sum("montant")).first()[0]
    assert abs(rep.agg(F.sum(F.col("ca_total").cast("decimal(28,2)"))).first()[0] - paid) == 0


def test_split_is_a_partition(spark):
    cr = C.build_churn_ready(C._t(spark, SF_SMALL))
    sp = churn.temporal_split(cr)
    n = cr.count()
    assert sp.count() == n and sp.select("client_id").distinct().count() == n
    assert sorted(r._pos for r in sp.select("_pos").collect()) == list(range(n))
    n_test = sp.where("split = 'test'").count()
    assert n_test in (max(1, round(n * 0.3)), max(1, round(n * 0.3)) - 1)


def test_one_decision_per_client(spark):
    d = Q["decide_action"](spark, SF_SMALL)
    rep = C.build_report(C._t(spark, SF_SMALL))
    assert d.count() == rep.count() == d.select("client_id").distinct().count()


def test_chunks_rebuild_text(spark):
    docs = C._t(spark, SF_SMALL).documents.select("doc_id", "text")
    ch = retrieval.chunk_fixed(docs, "doc_id", size=900, overlap=150)
    # non-overlapping part of every window (first 750 chars, whole last window) rebuilds the stripped text
    w = ch.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("chunk", "text"))).alias("c"))
    rebuilt = {r.source: r.t for r in w.select(
        "source",
        F.concat(F.array_join(F.transform(F.slice("c", 1, F.size("c") - 1), lambda s: s["text"].substr(1, 750)), ""),
                 F.element_at("c", -1)["text"]).alias("t")).collect()}
    for r in docs.collect():
        txt = (r.text or "").strip()
        if not txt:
            continue
        # windows before the last start <= n - 750, so their first 750 chars plus the
        # whole last window are exactly the text
        assert rebuilt[r.doc_id] == txt


def test_rejects_plus_clean_is_input(spark):
    t = C._t(spark, SF_SMALL)
    n_in = t.raw_clients().count()
    assert Q["clean_clients"](spark, SF_SMALL).count() + Q["clean_rejects"](spark, SF_SMALL).where(
        "source = 'clients'").count() == n_in


def test_hot_client_report(spark):
    """A third of all payments moved to one client: totals stay exact."""
    from clientlens.operators import report
    t = C._t(spark, SF_SMALL)
    subs = t.subscriptions().withColumn(
        "client_id", F.when(F.col("payment_id") % 3 == 0, F.lit(0).cast("long")).otherwise(F.col("client_id")))
    rep = report.client_report(t.clients(), subs, t.usage(), sort=False)
    hot = rep.where("client_id = 0").first()
    paid = subs.where("statut = 'paid' AND client_id = 0")
    assert hot.nb_paiements == paid.count()
    assert abs(hot.ca_total - float(paid.agg(F.sum("montant")).first()[0])) < 1e-6
    total = rep.agg(F.sum(F.col("ca_total").cast("decimal(28,2)"))).first()[0]
    assert total == subs.where("statut = 'paid'").agg(F.sum("montant")).first()[0]
