"""Structured Streaming jobs.

Each output has a query of its own that writes with Spark's Parquet sink: its log names the files
of every committed batch, so a batch that is replayed after a failure does not land twice for
readers of the table.  Scoring is stateless; the journal keeps the ids of the decisions that
arrived in the last ``REPEATS`` as keyed state (RocksDB, checkpointed).  ``availableNow`` drains what
has arrived (a scheduler can run the same job with a processing-time trigger)."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientlens.operators import journal as jr
from clientlens.operators.models import score_churn
from clientlens.operators.policy import Policy, risk_bucket
from clientlens.schemas import DECISION_LOG, SCORE_REQUEST


class Queries(list):
    """The running queries of a job."""

    def awaitTermination(self) -> None:
        for q in self:
            q.awaitTermination()


def _sink(rows: DataFrame, path: str, checkpoint: str, available_now: bool):
    w = rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")).start()


def stream_score(spark: SparkSession, landing: str, out: str, checkpoint: str, model: PipelineModel,
                 validate, policy: Policy | None = None, available_now: bool = True) -> Queries:
    """ST1: validate arriving score requests (P15), score valid ones with the churn
    model (stream-static transform), bucket the risk (FE6) into ``out``; rejected requests go
    to ``out``_rejects with their reason."""
    v = validate(spark.readStream.schema(SCORE_REQUEST).parquet(landing))
    scored = score_churn(model, v.where(F.col("reason").isNull()).drop("reason")).select(
        "client_id", "churn_probability", "churn",
        risk_bucket(F.col("churn_probability"), F.col("churn"), policy).alias("churn_risk"),
    )
    rejects = v.where(F.col("reason").isNotNull())
    return Queries([_sink(scored, out, f"{checkpoint}/scores", available_now),
                    _sink(rejects, f"{out}_rejects", f"{checkpoint}/rejects", available_now)])


#: A decision that arrives again within this time of its first arrival lands once.
REPEATS = "30 days"

ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def stream_journal(spark: SparkSession, landing: str, journal_path: str, rejects_path: str, checkpoint: str,
                   available_now: bool = True, repeats: str = REPEATS) -> Queries:
    """ST2: the valid ones of arriving decisions, each once; rejects (with reason) to their own sink.
    State is kept by decision id and expires by the time of arrival, so no decision is too late,
    whatever its own date; one that comes again after ``repeats`` lands again."""
    v = jr.journal_validate(spark.readStream.schema(DECISION_LOG).parquet(landing))
    valid = v.where(F.col("reason").isNull()).drop("reason")
    once = valid.withColumn("_id", jr.decision_id()).withColumn("_arrived", F.current_timestamp())
    once = once.withWatermark("_arrived", repeats).dropDuplicatesWithinWatermark(["_id"]).drop("_id", "_arrived")
    rejects = _sink(v.where(F.col("reason").isNotNull()), rejects_path, f"{checkpoint}/rejects", available_now)
    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for k, x in ROCKSDB.items():
        spark.conf.set(k, x)  # read when the query starts
    try:
        journal = _sink(once, journal_path, f"{checkpoint}/journal", available_now)
    finally:
        for k, x in before.items():
            spark.conf.unset(k) if x is None else spark.conf.set(k, x)
    return Queries([journal, rejects])
