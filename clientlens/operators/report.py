"""Per-client KPI reports.

``client_report`` is the full-outer merge of clients, paid payments and
usage.  It is planned as one null-padded ``unionByName`` of the three
sources feeding one partial+final ``groupBy(client_id)``: a single shuffle
of map-side-combined rows, where two full outer joins would need four
exchanges.  A hot client collapses to one partial row per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientlens.schemas import require_columns

REPORT_COLUMNS = [
    "client_id", "plan", "ville", "ca_total", "nb_paiements", "actions_total",
    "sessions_total", "last_payment_date", "last_activity_date",
]


def paid_kpis(subscriptions: DataFrame) -> DataFrame:
    """A1: per client over paid rows: revenue, payment count, last payment."""
    require_columns(subscriptions, ["client_id", "montant", "date_paiement", "statut"], "subscriptions")
    return (
        subscriptions.where((F.col("statut") == "paid") & F.col("client_id").isNotNull())
        .groupBy("client_id")
        .agg(
            F.sum("montant").cast("double").alias("ca_total"),
            F.count(F.lit(1)).alias("nb_paiements"),
            F.max("date_paiement").alias("last_payment_date"),
        )
    )


def usage_kpis(usage: DataFrame) -> DataFrame:
    """A2: totals, last activity, distinct active days and actions per active day.

    Two-level aggregation: (client, day) first, then client.  Both levels
    combine map-side, so the distinct-day count never ships raw rows."""
    require_columns(usage, ["client_id", "actions", "sessions", "activity_date"], "usage")
    daily = (
        usage.where(F.col("client_id").isNotNull())
        .groupBy("client_id", "activity_date")
        .agg(F.sum("actions").alias("a"), F.sum("sessions").alias("s"))
    )
    k = daily.groupBy("client_id").agg(
        F.sum("a").cast("long").alias("actions_total"),
        F.sum("s").cast("long").alias("sessions_total"),
        F.max("activity_date").alias("last_activity_date"),
        F.count("activity_date").alias("days_active"),
    )
    return k.withColumn(
        "freq_actions", F.coalesce(F.try_divide(F.col("actions_total"), F.col("days_active")), F.lit(0.0))
    )


def client_report(clients: DataFrame, subscriptions: DataFrame, usage: DataFrame,
                  order_col: str | None = None, sort: bool = True) -> DataFrame:
    """J1 + T1: full outer report, orphans included, duplicate client rows: last wins.

    Facts (client ids, paid payments, usage) are merged by one ``unionByName``
    into a single ``groupBy(client_id)`` whose buffers are all fixed-width, so
    it runs as a partial+final HashAggregate (no sort of the fact rows).  The
    client attributes (last row per id) are aggregated on the clients dimension
    alone; both sides come out hash-partitioned on client_id, so the final left
    join adds no exchange."""
    require_columns(clients, ["client_id", "plan", "ville"], "clients")
    order_col = order_col or ("_ord" if "_ord" in clients.columns else None)
    ord_c = F.col(order_col) if order_col else F.col("client_id")
    attrs = (
        clients.where(F.col("client_id").isNotNull())
        .groupBy("client_id")
        .agg(F.max_by(F.struct("plan", "ville"), ord_c).alias("attrs"))
    )
    c = clients.select("client_id")
    s = subscriptions.where(F.col("statut") == "paid").select("client_id", "montant", "date_paiement")
    u = usage.select("client_id", "actions", "sessions", "activity_date")
    tagged = (
        c.unionByName(s, allowMissingColumns=True)
        .unionByName(u, allowMissingColumns=True)
        .where(F.col("client_id").isNotNull())
    )
    facts = tagged.groupBy("client_id").agg(
        F.sum("montant").alias("ca"),
        F.count("montant").alias("nb_paiements"),
        F.sum("actions").alias("actions_total"),
        F.sum("sessions").alias("sessions_total"),
        F.max("date_paiement").alias("last_payment_date"),
        F.max("activity_date").alias("last_activity_date"),
    )
    rep = facts.join(attrs, "client_id", "left")
    out = rep.select(
        "client_id",
        F.col("attrs.plan").alias("plan"),
        F.col("attrs.ville").alias("ville"),
        F.coalesce(F.col("ca").cast("double"), F.lit(0.0)).alias("ca_total"),
        "nb_paiements",
        F.coalesce(F.col("actions_total").cast("long"), F.lit(0).cast("long")).alias("actions_total"),
        F.coalesce(F.col("sessions_total").cast("long"), F.lit(0).cast("long")).alias("sessions_total"),
        "last_payment_date",
        "last_activity_date",
    )
    if sort:
        out = out.orderBy(F.desc("ca_total"), F.desc("actions_total"), F.asc("client_id"))
    return out


def kpi_by_client(clients_dedup: DataFrame, subscriptions: DataFrame, usage: DataFrame) -> DataFrame:
    """J2 + FE1 inputs: clients left-joined to paid and usage KPIs, zeros filled,
    tenure and inactivity against the last observed usage day."""
    ref = usage.agg(F.max("activity_date").alias("_ref"))  # one row: broadcast is size-bounded
    k = (
        clients_dedup.join(paid_kpis(subscriptions), "client_id", "left")
        .join(usage_kpis(usage), "client_id", "left")
        .crossJoin(F.broadcast(ref))
    )
    zero_long = F.lit(0).cast("long")
    k = k.select(
        "client_id", "ville", "plan", "date_inscription",
        F.coalesce("ca_total", F.lit(0.0)).alias("ca_total"),
        F.coalesce("nb_paiements", zero_long).alias("nb_paiements"),
        "last_payment_date",
        F.coalesce("actions_total", zero_long).alias("actions_total"),
        F.coalesce("sessions_total", zero_long).alias("sessions_total"),
        "last_activity_date",
        F.coalesce("days_active", zero_long).alias("days_active"),
        F.coalesce("freq_actions", F.lit(0.0)).alias("freq_actions"),
        F.datediff("_ref", "date_inscription").alias("tenure_days"),
        F.datediff("_ref", "last_activity_date").alias("days_since_last_activity"),
    )
    return k.withColumn(
        "churn_heuristic", (F.coalesce("days_since_last_activity", F.lit(9999)) > 14).cast("int")
    )


def ml_ready_v1(kpi: DataFrame) -> DataFrame:
    """FE1: the 12-column v1 modelling table."""
    return kpi.select(
        "client_id", "plan", "ville", "tenure_days", "ca_total", "nb_paiements", "actions_total",
        "sessions_total", "days_active", "freq_actions", "days_since_last_activity", "churn_heuristic",
    )


def top_clients(report: DataFrame, n: int = 10) -> DataFrame:
    """Top-n by revenue then actions (client_id breaks ties) -> TakeOrderedAndProject."""
    return report.orderBy(F.desc("ca_total"), F.desc("actions_total"), F.asc("client_id")).limit(n)


def revenue_by_plan(report: DataFrame) -> DataFrame:
    """A4: revenue, client count and mean revenue per plan; null plan dropped."""
    return (
        report.where(F.col("plan").isNotNull())
        .groupBy("plan")
        .agg(
            F.sum(F.col("ca_total").cast("decimal(28,2)")).cast("double").alias("ca_total"),
            F.count("client_id").alias("nb_clients"),
            F.round(F.avg(F.col("ca_total").cast("decimal(28,2)")).cast("double"), 6).alias("ca_moyen_client"),
        )
        .orderBy(F.desc("ca_total"))
    )


def _with_anciennete(report: DataFrame) -> DataFrame:
    ref = report.agg(F.max("last_activity_date").alias("_ref"))
    return report.crossJoin(F.broadcast(ref)).withColumn(
        "anciennete_jours", F.datediff("_ref", "last_activity_date")
    )


def churn_rule_flags(report: DataFrame, x_days: int = 30) -> DataFrame:
    """Dashboard heuristic: no paid payment and inactive for more than x_days (null -> false)."""
    r = _with_anciennete(report)
    return r.withColumn(
        "is_churn", (F.col("nb_paiements") == 0) & F.coalesce(F.col("anciennete_jours") > x_days, F.lit(False))
    )


def churn_rule_summary(report: DataFrame, x_days: int = 30) -> DataFrame:
    """A5: reference date, flagged count, client count and rate (0 when no clients)."""
    f = churn_rule_flags(report, x_days)
    agg = f.agg(
        F.max("_ref").alias("date_ref"),
        F.sum(F.col("is_churn").cast("long")).alias("nb_churn"),
        F.count(F.lit(1)).alias("nb_clients"),
    )
    return agg.select(
        "date_ref",
        F.coalesce("nb_churn", F.lit(0).cast("long")).alias("nb_churn"),
        "nb_clients",
        F.round(F.coalesce(F.try_divide(F.col("nb_churn"), F.col("nb_clients")), F.lit(0.0)), 6).alias("taux_churn"),
    )


def churn_rule_list(report: DataFrame, x_days: int = 30) -> DataFrame:
    """Flagged clients, most inactive first."""
    f = churn_rule_flags(report, x_days)
    return f.where("is_churn").select(
        "client_id", "plan", "ville", "nb_paiements", "anciennete_jours", "last_activity_date"
    ).orderBy(F.desc("anciennete_jours"), F.asc("client_id"))


def ml_ready(report: DataFrame) -> DataFrame:
    """FE2: regression table, anciennete vs the last activity in the report; strict dropna."""
    require_columns(report, ["nb_paiements", "actions_total", "sessions_total", "plan", "ville",
                             "last_activity_date", "ca_total"], "report")
    r = _with_anciennete(report)
    cols = ["client_id", "nb_paiements", "actions_total", "sessions_total", "plan", "ville",
            "anciennete_jours", "ca_total"]
    return r.select(*cols).na.drop(subset=cols)
