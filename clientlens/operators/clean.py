"""Cleaning with rejects (valid / reject pairs from one projection)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientlens.functions.parsing import blank_to_null, parse_date, parse_float, parse_int, parse_number
from clientlens.schemas import PLANS, STATUTS, require_columns
from clientlens.sources.files import CORRUPT


def _first_reason(*checks: tuple[Column, str]) -> Column:
    out = None
    for cond, reason in checks:
        out = F.when(cond, F.lit(reason)) if out is None else out.when(cond, F.lit(reason))
    return out


def _parsed_clients(raw: DataFrame) -> DataFrame:
    require_columns(raw, ["client_id", "ville", "plan", "date_inscription"], "clients feed")
    extra = [c for c in raw.columns if c.startswith("_")]
    p = raw.select(
        blank_to_null("client_id").alias("client_id"),
        blank_to_null("ville").alias("ville"),
        blank_to_null("plan").alias("plan"),
        parse_date("date_inscription").alias("date_inscription"),
        F.col("client_id").alias("raw_client_id"),
        *extra,
    )
    return p.withColumn(
        "reason",
        _first_reason(
            (F.col("client_id").isNull(), "client_id_missing"),
            (F.col("ville").isNull(), "ville_missing"),
            (~F.coalesce(F.col("plan").isin(*PLANS), F.lit(False)), "plan_invalid"),
            (F.col("date_inscription").isNull(), "date_invalid"),
        ),
    )


def _parsed_subscriptions(raw: DataFrame, strict: bool = True) -> DataFrame:
    require_columns(raw, ["client_id", "montant", "date_paiement", "statut"], "subscriptions feed")
    p = raw.select(
        blank_to_null("client_id").alias("client_id"),
        (parse_float if strict else parse_number)("montant").alias("_montant"),
        parse_date("date_paiement").alias("date_paiement"),
        blank_to_null("statut").alias("statut"),
        F.col("client_id").alias("raw_client_id"),
    )
    return p.withColumn(
        "reason",
        _first_reason(
            (F.col("client_id").isNull(), "client_id_missing"),
            (~F.coalesce(F.col("statut").isin(*STATUTS), F.lit(False)), "statut_invalid"),
            (F.col("_montant").isNull() | (F.col("_montant") < 0), "montant_invalid"),
            (F.col("date_paiement").isNull(), "date_invalid"),
        ),
    ).withColumn("montant", F.col("_montant").cast("decimal(18,2)" if strict else "double")).drop("_montant")


def _parsed_usage(raw: DataFrame, strict: bool = True) -> DataFrame:
    require_columns(raw, ["client_id", "actions", "sessions", "timestamp"], "usage feed")
    num = parse_int if strict else (lambda c: parse_number(c))
    p = raw.select(
        blank_to_null("client_id").alias("client_id"),
        num("actions").alias("actions"),
        num("sessions").alias("sessions"),
        parse_date("timestamp").alias("activity_date"),
        F.col("client_id").alias("raw_client_id"),
    )
    return p.withColumn(
        "reason",
        _first_reason(
            (F.col("client_id").isNull(), "client_id_missing"),
            (F.col("actions").isNull() | (F.col("actions") < 0), "actions_invalid"),
            (F.col("sessions").isNull() | (F.col("sessions") < 0), "sessions_invalid"),
            (F.col("activity_date").isNull(), "date_invalid"),
        ),
    )


def clean_clients(raw: DataFrame) -> DataFrame:
    p = _parsed_clients(raw)
    keep = ["client_id", "ville", "plan", "date_inscription"] + [c for c in raw.columns if c.startswith("_")]
    return p.where(F.col("reason").isNull()).select(*keep)


def clean_subscriptions(raw: DataFrame, strict: bool = True) -> DataFrame:
    """P5; ``strict=False`` is P8: amounts coerced to numbers and kept as they are."""
    p = _parsed_subscriptions(raw, strict)
    return p.where(F.col("reason").isNull()).select("client_id", "montant", "date_paiement", "statut")


def clean_usage(raw: DataFrame, strict: bool = True) -> DataFrame:
    """P6; ``strict=False`` is P8: counts coerced to numbers, fractions kept."""
    p = _parsed_usage(raw, strict)
    return p.where(F.col("reason").isNull()).select("client_id", "actions", "sessions", "activity_date")


def clean_clients_dedup(raw: DataFrame, order_col: str | None = None) -> DataFrame:
    """Cleaned clients, first row per client_id in feed order.

    ``min_by`` inside a grouped aggregate keeps one struct per key on each
    side of the shuffle, so a hot client_id never materialises as a group."""
    order_col = order_col or ("_ord" if "_ord" in raw.columns else None)
    c = clean_clients(raw)
    ord_c = F.col(order_col) if order_col else F.col("client_id")
    return (
        c.groupBy("client_id")
        .agg(F.min_by(F.struct("ville", "plan", "date_inscription"), ord_c).alias("r"))
        .select("client_id", "r.ville", "r.plan", "r.date_inscription")
    )


def clean_rejects(raw_clients: DataFrame, raw_subscriptions: DataFrame, raw_usage: DataFrame) -> DataFrame:
    """Every rejected feed row with the first failing check."""
    parts = [
        ("clients", _parsed_clients(raw_clients)),
        ("subscriptions", _parsed_subscriptions(raw_subscriptions)),
        ("usage", _parsed_usage(raw_usage)),
    ]
    out = None
    for name, p in parts:
        r = p.where(F.col("reason").isNotNull()).select(
            F.lit(name).alias("source"), F.col("raw_client_id").alias("client_id"), "reason"
        )
        out = r if out is None else out.unionByName(r)
    return out


_CLEAN = {"clients": (_parsed_clients, clean_clients), "subscriptions": (_parsed_subscriptions, clean_subscriptions), "usage": (_parsed_usage, clean_usage)}


def clean_feed(name: str, feed: DataFrame) -> DataFrame:
    """Valid rows of a feed of ``sources.files.read_feed``: records that are whole and pass all checks."""
    whole = feed.where(F.col(CORRUPT).isNull()).drop(CORRUPT, "_file", "_ord")
    return _CLEAN[name][1](whole)


def feed_rejects(name: str, feed: DataFrame) -> DataFrame:
    """(source, client_id, reason, raw, file): every record of the feed that is not valid; a record
    that does not parse has its raw text, others their client."""
    whole = _CLEAN[name][0](feed.where(F.col(CORRUPT).isNull()).select(*[c for c in feed.columns if not c.startswith("_")])).where(F.col("reason").isNotNull())
    bad = feed.where(F.col(CORRUPT).isNotNull())
    out = lambda df, client, reason, raw: df.select(F.lit(name).alias("source"), client.alias("client_id"), reason.alias("reason"), raw.alias("raw"))
    text = F.regexp_replace(F.col(CORRUPT), "[\r\n]+$", "")
    return out(whole, F.col("raw_client_id"), F.col("reason"), F.lit(None).cast("string")).unionByName(
        out(bad, F.lit(None).cast("string"), F.lit("corrupt_record"), text))


def reconciliation(name: str, feed: DataFrame) -> DataFrame:
    """(source, n_records, n_valid, n_rejected, ok): every record is valid or rejected."""
    one = lambda df, c: df.agg(F.count(F.lit(1)).alias(c))
    rows = one(feed, "n_records").crossJoin(one(clean_feed(name, feed), "n_valid")).crossJoin(one(feed_rejects(name, feed), "n_rejected"))  # one row each
    return rows.select(F.lit(name).alias("source"), "n_records", "n_valid", "n_rejected", (F.col("n_records") == F.col("n_valid") + F.col("n_rejected")).alias("ok"))
