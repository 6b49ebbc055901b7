"""Watchlists, at-risk lists, health overview, plan medians, percentiles and
per-client signals over the churn dataset.

Medians and percentiles use the range-partitioned order statistics in
``ranking`` — never ``Window.partitionBy("plan")`` (three tasks for the whole
table) nor a whole-group percentile buffer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientlens.operators.ranking import cume_dist_in_group, exact_quantile
from clientlens.schemas import require_columns

INDICATORS = ["days_since_last_paid", "paid_count_before_T", "paid_sum_before_T"]
GLOBAL_SCOPE = "(global)"

REQ_COLS = ["client_id", "paid_count_before_T", "paid_sum_before_T", "last_paid_before_T",
            "days_since_last_paid", "plan", "ville"]


def filter_plan(df: DataFrame, plan: str | None) -> DataFrame:
    """Optional single filter on plan."""
    return df if plan is None else df.where(F.col("plan") == plan)


def plan_choices(df: DataFrame) -> DataFrame:
    return df.where(F.col("plan").isNotNull()).select("plan").distinct()


def watchlist(df: DataFrame, top_k: int = 30, plan: str | None = None) -> DataFrame:
    """Days desc, count asc, sum asc, id asc, nulls last; top_k."""
    require_columns(df, REQ_COLS, "watchlist dataset")
    d = filter_plan(df, plan)
    return d.orderBy(
        F.col("days_since_last_paid").desc_nulls_last(),
        F.col("paid_count_before_T").asc_nulls_last(),
        F.col("paid_sum_before_T").asc_nulls_last(),
        F.col("client_id").asc_nulls_last(),
    ).limit(top_k).select(
        "client_id", "plan", "ville", "days_since_last_paid", "paid_count_before_T",
        F.round("paid_sum_before_T", 2).alias("paid_sum_before_T"), "last_paid_before_T",
    )


def at_risk_inactive(df: DataFrame, top_n: int = 20, plan: str | None = None) -> DataFrame:
    """T4: longest time since last payment first."""
    d = filter_plan(df, plan).where(F.col("days_since_last_paid").isNotNull())
    return d.orderBy(F.desc("days_since_last_paid"), F.asc("client_id")).limit(top_n).select(
        "client_id", "plan", "ville", "days_since_last_paid", "last_paid_before_T"
    )


def at_risk_low_history(df: DataFrame, top_n: int = 20, plan: str | None = None) -> DataFrame:
    """T5: thinnest payment history first."""
    d = filter_plan(df, plan).where(F.col("paid_count_before_T").isNotNull() & F.col("paid_sum_before_T").isNotNull())
    return d.orderBy(F.asc("paid_count_before_T"), F.asc("paid_sum_before_T"), F.asc("client_id")).limit(top_n).select(
        "client_id", "plan", "ville", "paid_count_before_T", "paid_sum_before_T"
    )


def at_risk_union(df: DataFrame, top_n: int = 20, plan: str | None = None) -> DataFrame:
    """Distinct ids of both at-risk lists."""
    a = at_risk_inactive(df, top_n, plan).select("client_id")
    b = at_risk_low_history(df, top_n, plan).select("client_id")
    return a.union(b).distinct().orderBy("client_id")


def health_overview(df: DataFrame) -> DataFrame:
    """Client count, median and mean days since last payment, mean count and sum."""
    require_columns(df, ["days_since_last_paid", "paid_count_before_T", "paid_sum_before_T"], "health dataset")
    means = df.agg(
        F.count(F.lit(1)).alias("n_clients"),
        F.round(F.avg("days_since_last_paid"), 6).alias("avg_days"),
        F.round(F.avg("paid_count_before_T"), 6).alias("avg_paid_count"),
        F.round(F.avg("paid_sum_before_T"), 6).alias("avg_paid_sum"),
    )
    med = exact_quantile(df, [], "days_since_last_paid", 0.5, "med_days").select(F.round("med_days", 6).alias("med_days"))
    return means.crossJoin(med)  # 1 x 1 rows


def plan_distribution(df: DataFrame) -> DataFrame:
    """Clients per plan (null plan ignored)."""
    return df.where(F.col("plan").isNotNull()).groupBy("plan").agg(F.count(F.lit(1)).alias("clients"))


def segment_facts(df: DataFrame) -> DataFrame:
    """A10: clients and distinct villes per plan."""
    return df.where(F.col("plan").isNotNull()).groupBy("plan").agg(
        F.count(F.lit(1)).alias("n_clients"), F.countDistinct("ville").alias("n_villes")
    )


def _long(df: DataFrame, scope_global: bool) -> DataFrame:
    """(scope, indicator, value) rows; with ``scope_global`` every row appears
    twice: once for its plan and once for the global scope (grouping sets)."""
    stack = F.expr(
        "stack(3, 'days_since_last_paid', CAST(days_since_last_paid AS DOUBLE), "
        "'paid_count_before_T', CAST(paid_count_before_T AS DOUBLE), "
        "'paid_sum_before_T', CAST(paid_sum_before_T AS DOUBLE)) AS (indicator, value)"
    )
    base = df.where(F.col("plan").isNotNull()).select(F.col("plan").alias("scope"), stack)
    if scope_global:
        base = base.unionByName(
            df.select(F.lit(GLOBAL_SCOPE).alias("scope"), stack)
        )
    return base


def plan_medians(df: DataFrame) -> DataFrame:
    """Median of the three indicators per plan and globally (scope='(global)'),
    in one distributed quantile pass over (scope, indicator)."""
    require_columns(df, INDICATORS + ["plan"], "medians dataset")
    q = exact_quantile(_long(df, True), ["scope", "indicator"], "value", 0.5, "median")
    return q.groupBy("scope").agg(
        *[F.round(F.max(F.when(F.col("indicator") == i, F.col("median"))), 6).alias(f"median_{i}") for i in INDICATORS]
    )


def ca_quantile(report: DataFrame, q: float = 0.8, fallback: float = 300.0) -> DataFrame:
    """Q-quantile of ca_total; null or <= 0 -> fallback (one row)."""
    v = exact_quantile(report, [], "ca_total", q, "_q")
    # left join from a one-row frame: an empty report still yields the fallback row
    one = report.sparkSession.range(1).join(v, how="left")
    return one.select(
        F.when(F.col("_q").isNull() | (F.col("_q") <= 0), F.lit(fallback)).otherwise(F.round("_q", 6)).alias("ca_threshold")
    )


def percentile_in_plan(df: DataFrame) -> DataFrame:
    """Per client x indicator, share (x100, 1 decimal half-even) of plan values <= own value."""
    lng = df.where(F.col("plan").isNotNull()).select(
        "client_id", "plan",
        F.expr(
            "stack(3, 'days_since_last_paid', CAST(days_since_last_paid AS DOUBLE), "
            "'paid_count_before_T', CAST(paid_count_before_T AS DOUBLE), "
            "'paid_sum_before_T', CAST(paid_sum_before_T AS DOUBLE)) AS (indicator, value)"
        ),
    )
    cd = cume_dist_in_group(lng, ["plan", "indicator"], "value", "_cd")
    return cd.select("client_id", "plan", "indicator", "value",
                     F.bround(F.col("_cd") * 100.0, 1).alias("percentile_in_plan"))


def client_comparison(df: DataFrame) -> DataFrame:
    """Long table client x indicator: value, plan median, global median, percentile."""
    meds = plan_medians(df)
    lng = percentile_in_plan(df)
    m_long = meds.select(
        "scope",
        F.expr(
            "stack(3, 'days_since_last_paid', median_days_since_last_paid, "
            "'paid_count_before_T', median_paid_count_before_T, "
            "'paid_sum_before_T', median_paid_sum_before_T) AS (indicator, median)"
        ),
    )
    plan_m = m_long.where(F.col("scope") != GLOBAL_SCOPE).withColumnRenamed("scope", "plan").withColumnRenamed("median", "plan_median")
    glob_m = m_long.where(F.col("scope") == GLOBAL_SCOPE).select("indicator", F.col("median").alias("global_median"))
    # medians are (plans x 3) and 3 rows: bounded, broadcast
    return (
        lng.join(F.broadcast(plan_m), ["plan", "indicator"], "left")
        .join(F.broadcast(glob_m), "indicator", "left")
        .select(
            "client_id", "plan", "indicator",
            F.bround("value", 2).alias("client_value"),
            F.bround("plan_median", 2).alias("plan_median"),
            F.bround("global_median", 2).alias("global_median"),
            "percentile_in_plan",
        )
    )


def client_signals(df: DataFrame) -> DataFrame:
    """inactivity_high = days > plan median; history_low = count or sum < plan median."""
    meds = plan_medians(df).where(F.col("scope") != GLOBAL_SCOPE).withColumnRenamed("scope", "plan")
    j = df.join(F.broadcast(meds), "plan", "left")  # one row per plan
    return j.select(
        "client_id", "plan", "ville",
        F.coalesce(F.col("days_since_last_paid") > F.col("median_days_since_last_paid"), F.lit(False)).alias("inactivity_high"),
        (F.coalesce(F.col("paid_count_before_T") < F.col("median_paid_count_before_T"), F.lit(False))
         | F.coalesce(F.col("paid_sum_before_T") < F.col("median_paid_sum_before_T"), F.lit(False))).alias("history_low"),
    )


def client_fact_sheet(df: DataFrame) -> DataFrame:
    """Facts per client: ints, sum rounded to 2, last payment as text."""
    return df.select(
        "client_id", "plan", "ville",
        F.col("days_since_last_paid").cast("long").alias("days_since_last_paid"),
        F.col("paid_count_before_T").cast("long").alias("paid_count_before_T"),
        F.round("paid_sum_before_T", 2).alias("paid_sum_before_T"),
        F.date_format("last_paid_before_T", "yyyy-MM-dd").alias("last_paid_before_T"),
    )


def _fmt0(c):
    return F.format_string("%.0f", F.bround(c, 0))


def _fmt2(c):
    return F.format_string("%.2f", F.bround(c, 2))


def guided_reading(df: DataFrame) -> DataFrame:
    """Descriptive text per client (client mode) and per plan (segment mode)."""
    meds = plan_medians(df)
    plan_m = meds.where(F.col("scope") != GLOBAL_SCOPE).withColumnRenamed("scope", "plan")
    glob = meds.where(F.col("scope") == GLOBAL_SCOPE).select(
        *[F.col(f"median_{i}").alias(f"g_{i}") for i in INDICATORS]
    )
    j = df.join(F.broadcast(plan_m), "plan", "left").crossJoin(F.broadcast(glob))
    d, c, s = (F.col(i).cast("double") for i in INDICATORS)
    md, mc, ms = (F.col(f"median_{i}") for i in INDICATORS)
    gd, gc, gs = (F.col(f"g_{i}") for i in INDICATORS)
    # fixed values: the sentences of the reading, client and segment mode
    lines = F.concat_ws(
        "\n",
        F.format_string("- Périmètre : **client_id=%s** (plan=%s, ville=%s).", F.col("client_id").cast("string"),
                        F.col("plan"), F.col("ville")),
        F.when(d.isNotNull() & md.isNotNull(), F.concat(
            F.lit("- `days_since_last_paid` = **"), d.cast("long").cast("string"), F.lit("** vs médiane plan **"),
            _fmt0(md), F.lit("** (médiane globale **"), _fmt0(gd), F.lit("**)."))),
        F.when(c.isNotNull() & mc.isNotNull(), F.concat(
            F.lit("- `paid_count_before_T` = **"), _fmt0(c), F.lit("** vs médiane plan **"),
            _fmt0(mc), F.lit("** (médiane globale **"), _fmt0(gc), F.lit("**)."))),
        F.when(s.isNotNull() & ms.isNotNull(), F.concat(
            F.lit("- `paid_sum_before_T` = **"), _fmt2(s), F.lit("** vs médiane plan **"),
            _fmt2(ms), F.lit("** (médiane globale **"), _fmt2(gs), F.lit("**)."))),
        F.lit("- Ces comparaisons sont **descriptives** (pas de score, pas de décision automatique)."),
    )
    clients = j.select(F.lit("client").alias("scope_type"), F.col("client_id").cast("string").alias("scope_value"),
                       lines.alias("text"))
    seg = plan_m.crossJoin(F.broadcast(glob)).select(
        F.lit("plan").alias("scope_type"), F.col("plan").alias("scope_value"),
        F.concat_ws(
            "\n",
            F.format_string("- Périmètre : **plan=%s**.", F.col("plan")),
            F.concat(F.lit("- Médiane `days_since_last_paid` (plan) = **"), _fmt0(md), F.lit("** vs globale **"), _fmt0(gd), F.lit("**.")),
            F.concat(F.lit("- Médiane `paid_count_before_T` (plan) = **"), _fmt0(mc), F.lit("** vs globale **"), _fmt0(gc), F.lit("**.")),
            F.concat(F.lit("- Médiane `paid_sum_before_T` (plan) = **"), _fmt2(ms), F.lit("** vs globale **"), _fmt2(gs), F.lit("**.")),
            F.lit("- Cette lecture est **synthétique** et **descriptive** (pas de décision automatique)."),
        ).alias("text"),
    )
    return clients.unionByName(seg)


def dedup_first(df: DataFrame, key: str, order_cols: list[str]) -> DataFrame:
    """First row per key under an explicit order, as a grouped ``min_by``
    (one struct per key per task; no per-key sort)."""
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(
        F.min_by(F.struct(*others), F.struct(*order_cols)).alias("_r")
    ).select(key, *[F.col(f"_r.{c}").alias(c) for c in others])
