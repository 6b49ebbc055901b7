"""Approximate facts over any range of days from mergeable sketches (the approximate option of A6, A9,
A10 and A13): payments are read once, a day and plan become one row with a HyperLogLog of clients and
a KLL sketch of amounts, and a range of days merges those rows without reading payments again.

Errors: distinct clients within ``COUNT_ERROR`` of the exact count (three standard errors), a quantile's
rank within ``RANK_ERROR`` of the one asked for.  Counts and sums are exact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientlens.sources.commits import AppendTable

LOG_REGISTERS = 14  # HyperLogLog of 2^14 registers
KLL_K = 400
COUNT_ERROR, RANK_ERROR = 0.025, 0.02

SCHEMA = T.StructType([
    T.StructField("day", T.DateType()), T.StructField("plan", T.StringType()), T.StructField("n", T.LongType()), T.StructField("total", T.DecimalType(38, 2)),
    T.StructField("clients", T.BinaryType()), T.StructField("amounts", T.BinaryType())])


def daily_sketches(payments: DataFrame) -> DataFrame:
    """(day, plan, n, total, clients, amounts) of payments (client_id, plan, date_paiement, montant);
    sketches are built per task and merged, so no day's rows meet in one place.  Rows without a
    date have no day; a null plan is a plan of its own."""
    rows = payments.where(F.col("date_paiement").isNotNull())
    return rows.groupBy(F.col("date_paiement").alias("day"), "plan").agg(
        F.count(F.lit(1)).alias("n"), F.sum("montant").cast("decimal(38,2)").alias("total"),
        F.hll_sketch_agg(F.col("client_id").cast("long"), F.lit(LOG_REGISTERS)).alias("clients"),
        F.kll_sketch_agg_double(F.col("montant").cast("double"), F.lit(KLL_K)).alias("amounts"))


def sketch_table(spark: SparkSession, path: str) -> AppendTable:
    """Stored sketches: a day and plan once, appended as days come in."""
    key = F.sha2(F.to_json(F.struct("day", "plan")), 256)
    return AppendTable(spark, path, SCHEMA, key, F.date_format("day", "yyyy-MM"))


def range_facts(sketches: DataFrame, first: str, last: str, by: tuple[str, ...] = ("plan",), quantile: float = 0.5) -> DataFrame:
    """Per group the payments, their sum, distinct clients and a quantile of the amounts from ``first`` to
    ``last``."""
    days = sketches.where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    # a group without amounts has no sketch to ask
    amounts = F.kll_merge_agg_double("amounts", F.lit(KLL_K))
    merged = days.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.hll_union_agg("clients").alias("c"), amounts.alias("a"))
    value = F.when(F.kll_sketch_get_n_double("a") > 0, F.kll_sketch_get_quantile_double("a", F.lit(quantile)))
    return merged.select(*by, "n", "total", F.hll_sketch_estimate("c").alias("clients"), value.alias("quantile"))


def within_bounds(facts: DataFrame, payments: DataFrame, first: str, last: str, quantile: float = 0.5) -> DataFrame:
    """(plan, n, clients_ok, quantile_ok): are the approximate facts by plan within their stated errors of
    the payments themselves?"""
    rows = payments.where(F.col("date_paiement").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    rows = rows.join(F.broadcast(facts.select(F.col("plan").alias("p"), "quantile")), F.col("plan").eqNullSafe(F.col("p")))  # a row per plan
    v = F.col("montant").cast("double")
    exact = rows.groupBy("plan").agg(F.countDistinct("client_id").alias("exact"), F.avg((v <= F.col("quantile")).cast("double")).alias("upto"),
                                     F.avg((v < F.col("quantile")).cast("double")).alias("below"))
    both = facts.join(exact.withColumnRenamed("plan", "p"), F.col("plan").eqNullSafe(F.col("p")))
    return both.select("plan", "n", (F.abs(F.col("clients") - F.col("exact")) <= F.greatest(F.lit(1.0), COUNT_ERROR * F.col("exact"))).alias("clients_ok"),
                       ((F.col("below") <= quantile + RANK_ERROR) & (F.col("upto") >= quantile - RANK_ERROR)).alias("quantile_ok"))
