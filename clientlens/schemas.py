"""Declared schemas and the column-contract guard."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

S = T.StringType()

RAW_CLIENTS = T.StructType([T.StructField(c, S) for c in ("client_id", "ville", "plan", "date_inscription")])
RAW_SUBSCRIPTIONS = T.StructType([T.StructField(c, S) for c in ("client_id", "montant", "date_paiement", "statut")])
RAW_USAGE = T.StructType([T.StructField(c, S) for c in ("client_id", "actions", "sessions", "timestamp")])
RAW_REVENUE_EVENTS = T.StructType([T.StructField(c, S) for c in ("client_id", "event_type", "amount", "event_date")])

DECISION_LOG = T.StructType(
    [T.StructField(c, S) for c in ("timestamp_iso", "scope_type", "scope_value", "decision_type", "rationale_short", "author")]
)

SCORE_REQUEST = T.StructType([
    T.StructField("client_id", T.LongType()),
    T.StructField("paid_count_before_T", T.LongType()),
    T.StructField("paid_sum_before_T", T.DoubleType()),
    T.StructField("days_since_last_paid", T.IntegerType()),
    T.StructField("plan", S),
    T.StructField("ville", S),
])

# fixed values: the enumerations the reference validates against
PLANS = ("free", "basic", "pro")
STATUTS = ("paid", "failed", "cancelled")
DECISION_TYPES = ("Surveiller", "À analyser (E5)", "Rien à faire", "Hors périmètre")
SCOPE_TYPES = ("client", "plan")


class MissingColumnsError(KeyError):
    pass


def require_columns(df: DataFrame, required: Iterable[str], where: str) -> None:
    """Raise before any job runs when a contract column is missing (metadata only)."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise MissingColumnsError(f"missing columns in {where}: {missing}")
