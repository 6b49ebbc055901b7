"""Churn modelling dataset (pre-T payment features + label in [T+b, T+h]),
serving features and the temporal train/test split."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clientlens.operators.ranking import running_counts
from clientlens.schemas import require_columns

# fixed values: the frozen churn reference date on the driver tables and the label window
T_REF = dt.date(2001, 1, 1)
BUFFER_DAYS = 7
HORIZON_DAYS = 30

CHURN_COLUMNS = [
    "client_id", "paid_count_before_T", "paid_sum_before_T", "last_paid_before_T",
    "days_since_last_paid", "churn_7_30j", "plan", "ville",
]


def _window(t: dt.date, buffer_days: int, horizon_days: int):
    return t + dt.timedelta(days=buffer_days), t + dt.timedelta(days=horizon_days)


class CoverageError(ValueError):
    pass


def coverage_guard(subscriptions: DataFrame, t: dt.date = T_REF, horizon_days: int = HORIZON_DAYS) -> DataFrame:
    """One row (max_payment, required, ok); ``check_coverage`` raises on ok=false."""
    req = t + dt.timedelta(days=horizon_days)
    return subscriptions.agg(F.max("date_paiement").alias("max_payment")).select(
        "max_payment", F.lit(req).alias("required"),
        F.coalesce(F.col("max_payment") >= F.lit(req), F.lit(False)).alias("ok"),
    )


def check_coverage(subscriptions: DataFrame, t: dt.date = T_REF, horizon_days: int = HORIZON_DAYS) -> None:
    row = coverage_guard(subscriptions, t, horizon_days).first()
    if not row["ok"]:
        raise CoverageError(f"insufficient coverage: max(date_paiement)={row['max_payment']} < T+{horizon_days}d={row['required']}")


def require_coverage(df: DataFrame, subscriptions: DataFrame, t: dt.date = T_REF,
                     horizon_days: int = HORIZON_DAYS) -> DataFrame:
    """``df``, which fails when it runs if payments end before the label window does: labels
    would otherwise say churn for want of data.  No job runs while planning."""
    guard = coverage_guard(subscriptions, t, horizon_days)  # one row
    text = F.concat(F.lit("insufficient coverage: max(date_paiement)="), F.coalesce(F.col("max_payment").cast("string"), F.lit("none")),
                    F.lit(f" < T+{horizon_days}d="), F.col("required").cast("string"))
    out = df.crossJoin(F.broadcast(guard.select("ok", text.alias("_why"))))
    return out.where(F.when(F.col("ok"), F.lit(True)).otherwise(F.raise_error(F.col("_why")).cast("boolean"))).drop("ok", "_why")


def pre_t_features(subscriptions: DataFrame, t: dt.date = T_REF) -> DataFrame:
    """A3: rows dated before T, every status: count, sum, last date, days since."""
    pre = subscriptions.where(F.col("client_id").isNotNull() & (F.col("date_paiement") < F.lit(t)))
    return pre.groupBy("client_id").agg(
        F.count("date_paiement").alias("paid_count_before_T"),
        F.coalesce(F.sum("montant").cast("double"), F.lit(0.0)).alias("paid_sum_before_T"),
        F.max("date_paiement").alias("last_paid_before_T"),
    ).withColumn("days_since_last_paid", F.datediff(F.lit(t), F.col("last_paid_before_T")))


def window_payers(subscriptions: DataFrame, t: dt.date = T_REF, buffer_days: int = BUFFER_DAYS,
                  horizon_days: int = HORIZON_DAYS) -> DataFrame:
    start, end = _window(t, buffer_days, horizon_days)
    return (
        subscriptions.where(
            (F.col("statut") == "paid") & F.col("date_paiement").between(F.lit(start), F.lit(end))
            & F.col("client_id").isNotNull()
        )
        .select("client_id")
        .distinct()
    )


def churn_label(subscriptions: DataFrame, t: dt.date = T_REF, buffer_days: int = BUFFER_DAYS,
                horizon_days: int = HORIZON_DAYS) -> DataFrame:
    """Existence test. Population = clients with a pre-T row; label 1 when
    they did not pay inside the window.  Left join on distinct payer ids, not
    ``NOT IN`` (null-safe)."""
    pop = subscriptions.where(F.col("client_id").isNotNull() & (F.col("date_paiement") < F.lit(t))).select("client_id").distinct()
    payers = window_payers(subscriptions, t, buffer_days, horizon_days).withColumn("_paid", F.lit(True))
    return pop.join(payers, "client_id", "left").select(
        "client_id", F.when(F.col("_paid").isNull(), 1).otherwise(0).alias("churn_7_30j")
    )


def label_population_diff(subscriptions: DataFrame, t: dt.date = T_REF, buffer_days: int = BUFFER_DAYS,
                          horizon_days: int = HORIZON_DAYS) -> DataFrame:
    """U4: pre-T payers minus window payers (the churned population), as a left anti join."""
    pop = subscriptions.where(F.col("client_id").isNotNull() & (F.col("date_paiement") < F.lit(t))).select("client_id").distinct()
    return pop.join(window_payers(subscriptions, t, buffer_days, horizon_days), "client_id", "left_anti")


def churn_ready(report: DataFrame, subscriptions: DataFrame, t: dt.date = T_REF,
                buffer_days: int = BUFFER_DAYS, horizon_days: int = HORIZON_DAYS) -> DataFrame:
    """FE3 = A3 + J3 + J4 in one pass over payments.

    Features and the window label come out of the same ``groupBy(client_id)``
    (conditional aggregates), so payments shuffle once; the join with the
    report's (plan, ville) is between two client-partitioned aggregates and
    adds no exchange.  Rows without plan or ville are dropped (strict dropna)."""
    require_columns(subscriptions, ["client_id", "montant", "date_paiement", "statut"], "subscriptions")
    start, end = _window(t, buffer_days, horizon_days)
    pre = F.col("date_paiement") < F.lit(t)
    in_win = (F.col("statut") == "paid") & F.col("date_paiement").between(F.lit(start), F.lit(end))
    agg = (
        # the redundant upper bound (both branches imply it) reaches the parquet scan
        subscriptions.where(F.col("client_id").isNotNull() & (F.col("date_paiement") <= F.lit(end)) & (pre | in_win))
        .groupBy("client_id")
        .agg(
            F.count(F.when(pre, F.col("date_paiement"))).alias("paid_count_before_T"),
            F.sum(F.when(pre, F.col("montant"))).alias("_sum"),
            F.max(F.when(pre, F.col("date_paiement"))).alias("last_paid_before_T"),
            F.max(in_win.cast("int")).alias("_paid_in_window"),
        )
        .where(F.col("paid_count_before_T") > 0)
    )
    feats = agg.select(
        "client_id",
        "paid_count_before_T",
        F.coalesce(F.col("_sum").cast("double"), F.lit(0.0)).alias("paid_sum_before_T"),
        "last_paid_before_T",
        F.datediff(F.lit(t), F.col("last_paid_before_T")).alias("days_since_last_paid"),
        (1 - F.col("_paid_in_window")).alias("churn_7_30j"),
    )
    attrs = report.select("client_id", "plan", "ville")
    return feats.join(attrs, "client_id", "left").select(*CHURN_COLUMNS).na.drop()


def reference_date(report: DataFrame) -> DataFrame:
    """Max last activity, else max last payment (one row)."""
    return report.agg(
        F.coalesce(F.max("last_activity_date"), F.max("last_payment_date")).alias("reference_date")
    )


def serving_features(report: DataFrame) -> DataFrame:
    """FE4: the scoring payload per report row (all-time paid counts, days vs A14,
    missing payment -> 999, negative -> 0)."""
    ref = reference_date(report)  # one row
    r = report.crossJoin(F.broadcast(ref))
    days = F.datediff(F.col("reference_date"), F.col("last_payment_date"))
    return r.select(
        "client_id",
        F.coalesce(F.col("nb_paiements"), F.lit(0).cast("long")).alias("paid_count_before_T"),
        F.coalesce(F.col("ca_total"), F.lit(0.0)).alias("paid_sum_before_T"),
        F.coalesce(F.greatest(days, F.lit(0)), F.lit(999)).alias("days_since_last_paid"),
        "plan",
        "ville",
    )


def temporal_split(df: DataFrame, test_size: float = 0.3, label_col: str = "churn_7_30j",
                   order_col: str = "days_since_last_paid", key_col: str = "client_id") -> DataFrame:
    """Order by ``order_col`` (ties: ``key_col``); the last max(1, round_half_even(n*test_size))
    rows are test.  If train lacks a class present overall, the first label-1 test row moves
    to train.  Adds ``_pos`` (0-based) and ``split``: a row's position is the number of rows of
    earlier days (one row per day) and of smaller keys of its day (banded running counts)."""
    day = df.withColumn("_day", F.coalesce(F.col(order_col).cast("long"), F.lit(-(1 << 62)))).withColumn("_one", F.lit(1))
    per = day.groupBy("_day").agg(F.sum("_one").alias("_d"))
    earlier = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(F.col("_day"), F.coalesce(F.sum("_d").over(earlier), F.lit(0)).alias("_before"))
    pos = running_counts(day, ["_day"], key_col, "_one").join(F.broadcast(per), "_day")  # a row per day
    pos = pos.withColumn("_pos", (F.col("_before") + F.col("cum_before")).cast("long")).select(*df.columns, "_pos")
    n = df.agg(F.count(F.lit(1)).alias("n")).select(
        "n", F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(test_size), 0).cast("long")).alias("n_test")
    )
    p = pos.crossJoin(F.broadcast(n)).withColumn("_test", F.col("_pos") >= F.col("n") - F.col("n_test"))
    lab = F.col(label_col).cast("int")
    stats = p.agg(
        F.max(F.when(~F.col("_test") & (lab == 0), 1).otherwise(0)).alias("tr0"),
        F.max(F.when(~F.col("_test") & (lab == 1), 1).otherwise(0)).alias("tr1"),
        F.max(F.when(lab == 0, 1).otherwise(0)).alias("all0"),
        F.max(F.when(lab == 1, 1).otherwise(0)).alias("all1"),
        F.min(F.when(F.col("_test") & (lab == 1), F.col("_pos"))).alias("first_test_one"),
    )
    move = (F.col("all0") == 1) & (F.col("all1") == 1) & ((F.col("tr0") == 0) | (F.col("tr1") == 0))
    p = p.crossJoin(F.broadcast(stats))
    moved = move & F.col("_test") & (F.col("_pos") == F.col("first_test_one"))
    return p.withColumn("split", F.when(F.col("_test") & ~F.coalesce(moved, F.lit(False)), "test").otherwise("train")).drop(
        "_test", "n", "n_test", "tr0", "tr1", "all0", "all1", "first_test_one"
    )
