"""Decision journal: validation, append sink and the newest-first view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clientlens.functions.parsing import strip
from clientlens.schemas import DECISION_LOG, DECISION_TYPES, SCOPE_TYPES, require_columns
from clientlens.session import materialize, stored
from clientlens.sources.commits import AppendTable

MAX_RATIONALE = 200


def journal_validate(rows: DataFrame) -> DataFrame:
    """Add ``reason`` (null when valid) and the trimmed rationale/author."""
    require_columns(rows, [f.name for f in DECISION_LOG.fields], "decision rows")
    r = strip(F.coalesce(F.col("rationale_short"), F.lit("")))
    reason = (
        F.when(~F.coalesce(F.col("decision_type").isin(*DECISION_TYPES), F.lit(False)), F.lit("decision_type_invalid"))
        .when(~F.coalesce(F.col("scope_type").isin(*SCOPE_TYPES), F.lit(False)), F.lit("scope_type_invalid"))
        .when(F.length(r) == 0, F.lit("rationale_missing"))
        .when(F.length(r) > MAX_RATIONALE, F.lit("rationale_too_long"))
    )
    return rows.select(
        "timestamp_iso", "scope_type", F.col("scope_value").cast("string").alias("scope_value"), "decision_type",
        r.alias("rationale_short"), strip(F.coalesce(F.col("author"), F.lit(""))).alias("author"),
        reason.alias("reason"),
    )


def decision_id() -> Column:
    """A decision is all it says."""
    return F.sha2(F.to_json(F.struct(*[f.name for f in DECISION_LOG.fields])), 256)


def journal_table(spark: SparkSession, path: str) -> AppendTable:
    """The journal: a decision's day (the first ten characters of its time) is part of what it says."""
    return AppendTable(spark, path, DECISION_LOG, decision_id(), F.substring("timestamp_iso", 1, 10))


def journal_append(rows: DataFrame, path: str) -> DataFrame:
    """Append the valid rows that the journal doesn't have yet; return the valid rows.
    Appending the same rows again, or by two writers at once, leaves the journal as it is;
    only the days of the new rows are read."""
    v = materialize(journal_validate(rows).where(F.col("reason").isNull()).drop("reason"))
    journal_table(rows.sparkSession, path).append(v)
    return v


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """Journal (of ``journal_append`` or of the stream) with its declared schema; empty when it does not
    exist yet."""
    table = journal_table(spark, path)
    return table.read() if table.log.exists() else stored(spark, path, DECISION_LOG)


def journal_view(journal: DataFrame, scope_type: str | None = None, scope_value: str | None = None) -> DataFrame:
    """Newest first, optional exact filters."""
    j = journal
    if scope_type:
        j = j.where(F.col("scope_type") == scope_type)
    if scope_value:
        j = j.where(F.col("scope_value").cast("string") == scope_value)
    return j.orderBy(F.desc("timestamp_iso"))
