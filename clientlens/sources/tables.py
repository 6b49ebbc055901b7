"""Driver tables and the domain views put on top of them.

The domain views (clients, subscriptions, usage, revenue_events) are the
cleaned-table contracts of the analytics; ``raw_*`` are the same data as
all-string CSV-like feeds for the cleaning jobs.  Every view is a lazy
projection of a parquet scan, so filters and column pruning reach the scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clientlens.session import ship

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


# fixed values: the plans of the domain by market segment
def _plan_of(segment: Column) -> Column:
    return (
        F.when(segment.isin("AUTOMOBILE", "BUILDING"), F.lit("pro"))
        .when(segment.isin("FURNITURE", "HOUSEHOLD"), F.lit("basic"))
        .otherwise(F.lit("free"))
    )


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


@dataclass
class Tables:
    spark: SparkSession
    sf_dir: str
    _cache: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        ship(self.spark)

    def table(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = read_table(self.spark, f"{self.sf_dir.rstrip('/')}/{name}.parquet")
        return self._cache[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in DRIVER_TABLES:
            return self.table(name)
        raise AttributeError(name)

    # ---------------------------------------------------------------- clients
    def _customer_view(self) -> DataFrame:
        c = self.table("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
        n = self.table("nation").select("n_nationkey", "n_name")
        # nation is a fixed 25-row dimension: broadcast is size-bounded
        return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)

    def clients(self) -> DataFrame:
        """client_id, ville, plan, date_inscription of every customer."""
        v = self._customer_view()
        return v.select(
            F.col("c_custkey").alias("client_id"),
            F.col("n_name").alias("ville"),
            _plan_of(F.col("c_mktsegment")).alias("plan"),
            F.date_add(F.lit("1994-01-01").cast("date"), (F.col("c_custkey") % 365).cast("int")).alias("date_inscription"),
        )

    def raw_clients(self) -> DataFrame:
        """All customers as a string feed."""
        v = self._customer_view()
        return v.select(
            F.col("c_custkey").cast("string").alias("client_id"),
            F.col("n_name").alias("ville"),
            _plan_of(F.col("c_mktsegment")).alias("plan"),
            F.date_format(
                F.date_add(F.lit("1994-01-01").cast("date"), (F.col("c_custkey") % 365).cast("int")), "yyyy-MM-dd"
            ).alias("date_inscription"),
        )

    # ---------------------------------------------------------- subscriptions
    def subscriptions(self) -> DataFrame:
        o = self.table("orders")
        return o.select(
            F.col("o_custkey").alias("client_id"),
            F.col("o_totalprice").cast("decimal(18,2)").alias("montant"),
            F.col("o_orderdate").cast("date").alias("date_paiement"),
            F.when(F.col("o_orderstatus") == "F", "paid")
            .when(F.col("o_orderstatus") == "O", "failed")
            .otherwise("cancelled")
            .alias("statut"),
            F.col("o_orderkey").alias("payment_id"),
        )

    def raw_subscriptions(self) -> DataFrame:
        s = self.subscriptions()
        return s.select(
            F.col("client_id").cast("string").alias("client_id"),
            F.col("montant").cast("string").alias("montant"),
            F.date_format("date_paiement", "yyyy-MM-dd").alias("date_paiement"),
            F.col("statut"),
        )

    # ------------------------------------------------------------------ usage
    def usage(self) -> DataFrame:
        e = self.table("events")
        return e.select(
            F.col("user_id").alias("client_id"),
            F.floor("value").cast("int").alias("actions"),
            F.when(F.col("event_type").isin("view", "signup"), 1).otherwise(0).alias("sessions"),
            F.date_sub(F.col("ts").cast("date"), (F.col("user_id") % 30).cast("int")).alias("activity_date"),
            F.col("event_id"),
        )

    def raw_usage(self) -> DataFrame:
        u = self.usage()
        return u.select(
            F.col("client_id").cast("string").alias("client_id"),
            F.col("actions").cast("string").alias("actions"),
            F.col("sessions").cast("string").alias("sessions"),
            F.date_format("activity_date", "yyyy-MM-dd").alias("timestamp"),
        )

    # --------------------------------------------------------- revenue events
    def revenue_events(self) -> DataFrame:
        """Every event; types without a revenue meaning of their own keep their name."""
        e = self.table("events")
        return e.select(
            F.col("user_id").alias("client_id"),
            F.when(F.col("event_type") == "purchase", "one_shot")
            .when(F.col("event_type") == "signup", "upsell")
            .when(F.col("event_type") == "click", "extra_service")
            .otherwise(F.col("event_type"))
            .alias("event_type"),
            F.col("value").cast("decimal(18,2)").alias("amount"),
            F.col("ts").cast("date").alias("event_date"),
            F.col("event_id"),
        )

    # --------------------------------------------------------- decision feed
    def decision_feed(self) -> DataFrame:
        """Journal submissions derived from ``conversations``: a user turn records a
        client decision, an assistant turn a plan decision, a system turn an
        out-of-contract scope; the turn text is the rationale."""
        c = self.table("conversations")
        plans = F.array(F.lit("free"), F.lit("basic"), F.lit("pro"))
        dtypes = F.array(*[F.lit(x) for x in ("Surveiller", "À analyser (E5)", "Rien à faire", "Hors périmètre")])
        # UTC text built from date + integer arithmetic: independent of the session time zone
        minutes = F.col("conv_id") * 60 + F.col("turn")
        day = F.date_add(F.lit("2024-01-01").cast("date"), (minutes / 1440).cast("int"))
        iso = F.format_string("%sT%02d:%02d:00Z", F.date_format(day, "yyyy-MM-dd"),
                              ((minutes % 1440) / 60).cast("int"), (minutes % 60).cast("int"))
        return c.select(
            iso.alias("timestamp_iso"),
            F.when(F.col("role") == "user", "client").when(F.col("role") == "assistant", "plan")
            .otherwise(F.col("role")).alias("scope_type"),
            F.when(F.col("role") == "assistant", F.element_at(plans, (F.col("conv_id") % 3 + 1).cast("int")))
            .otherwise(F.col("conv_id").cast("string")).alias("scope_value"),
            F.element_at(dtypes, (F.col("turn") % 4 + 1).cast("int")).alias("decision_type"),
            F.col("text").alias("rationale_short"),
            F.col("role").alias("author"),
        )
