"""Per-client revenue-event summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientlens.schemas import require_columns


def revenue_type_counts(events: DataFrame) -> DataFrame:
    """Events per client x type."""
    require_columns(events, ["client_id", "event_type"], "revenue_events")
    return events.where(F.col("client_id").isNotNull()).groupBy("client_id", "event_type").agg(
        F.count(F.lit(1)).alias("n_events")
    )


def revenue_summary(events: DataFrame) -> DataFrame:
    """Total amount (unreadable -> 0), event count, type -> count map, most recent date.

    Two-level aggregation: (client, type) first, so the per-client map is built
    from at most one entry per event type, never from raw events."""
    require_columns(events, ["client_id", "event_type", "amount", "event_date"], "revenue_events")
    by_type = events.where(F.col("client_id").isNotNull()).groupBy("client_id", "event_type").agg(
        F.sum(F.coalesce(F.col("amount").cast("decimal(28,2)"), F.lit(0).cast("decimal(28,2)"))).alias("amt"),
        F.count(F.lit(1)).alias("n"),
        F.max("event_date").alias("last_date"),
    )
    s = by_type.groupBy("client_id").agg(
        F.sum("amt").cast("double").alias("total_amount"),
        F.sum("n").cast("long").alias("events_count"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("event_type").cast("string"), F.lit("nan")), "n")))
        ).alias("types"),
        F.max("last_date").alias("most_recent_date"),
    )
    return s


def types_text(c: str = "types"):
    """Map -> 'k:v,k:v' in key order (a flat, engine-neutral rendering)."""
    return F.array_join(
        F.transform(F.array_sort(F.map_entries(F.col(c))), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))),
        ",",
    )
