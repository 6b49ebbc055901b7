"""Exact deduplication with streaming state.

1. A digest ledger (id, SHA-256 of the normalised text, content locator) is written to
   the shared folder; texts stay where they are.
2. A Structured Streaming job reads the ledger in bounded micro-batches into keyed state
   (RocksDB: on disk, checkpointed to the shared folder, no watermark, so keys never
   expire).  Per digest the state retains the smallest identifier with its content
   locator and the number of rows.  Rows are combined per task before the shuffle, so a
   digest that holds a third of all rows sends one row per task.  The operator may be
   called again with the same ``state_dir``: new ledger files go on from the state.  Each
   call then keeps its normalised texts in a folder of its own there, where later calls find
   its stayers, and returns its own rows with groups over all calls so far; a later row of a
   smaller id becomes the stayer, and rows returned before do not change.
3. Hits (digests with more than one row) are checked on their full bytes: the stayer's
   content is fetched by its locator and compared with each copy.  A fixed-size bitmap of
   the hit digests is broadcast, so only texts that have a copy are shuffled; digests that
   hold over a thousandth of all rows are salted.
4. Rows whose digest matches but whose bytes differ (a collision) are regrouped on the
   text itself, so results do not rest on the digest.

Defined results: null text counts as empty; equal texts are those identical after each
run of white space becomes one space; the smallest id stays, null ids last; of repeated
rows with one id the first by locator stays, so one row of a group is kept; an empty
table gives an empty result."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clientlens.llm.common import (
    WS, anti_by_key, documents, flag_by_bitmap, is_scan, key_bitmap, shared_path, shared_table, with_locator,
)

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_STATE_CONF = {
    _PROVIDER: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Ledger bytes that one micro-batch takes at most.
BATCH_BYTES = 32 << 30
#: Tasks over which the rows of a hot digest are dealt.
SALTS = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WS, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _first(id_col: str = "doc_id") -> Column:
    """What orders the rows of a group: ids, null last, then the locator."""
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("__path").alias("path"), F.col("__row").alias("row"))


def keyed_state(spark: SparkSession, ledger_dir: str, schema, state_dir: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Run the ledger files not yet seen through the keyed state and return it:
    digest, first (id and locator of the row that stays), n."""
    old = {k: spark.conf.get(k, None) for k in _STATE_CONF}
    for k, v in _STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        rows = spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).parquet(ledger_dir)
        state = rows.groupBy("digest").agg(F.min(_first()).alias("first"), F.count(F.lit(1)).alias("n"))
        query = (state.writeStream.outputMode("update").format("noop").trigger(availableNow=True)
                 .option("checkpointLocation", state_dir).start())
        query.awaitTermination()
        kept = spark.read.format("statestore").load(state_dir)
        names = kept.schema["value"].dataType.names
        first, n = (f"value.`{x}`" for x in names)
        return shared_table(kept.select("key.digest", F.col(first).alias("first"), F.col(n).alias("n")), "dedup-state")
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _fetched(spark: SparkSession, texts_dir: str, places: DataFrame) -> DataFrame:
    """digest, text of the rows at ``places`` (digest, __path, __row) in the folders of the calls."""
    calls = places.select(F.regexp_extract("__path", r"/texts/([^/]+)/[^/]+$", 1)).distinct().collect()
    if not calls:
        return places.select("digest", F.lit("").alias("text"))
    texts = with_locator(spark.read.parquet(*[f"{texts_dir}/{x[0]}" for x in calls]), [F.col("text")])
    where = F.struct("__path", "__row")
    found = flag_by_bitmap(texts, where, key_bitmap(places, where), "__hit").where("__hit")
    return found.join(places, ["__path", "__row"]).select("digest", "text")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256,
          state_dir: str | None = None, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, digest, __path, __row (with
    ``state_dir``, the place in this call's folder of texts)."""
    spark = docs.sparkSession
    call = state_dir and f"{time.time_ns():020d}-{uuid.uuid4().hex}"  # earlier calls come first
    state_dir = state_dir or shared_path(spark, "dedup-stream")
    if call:
        docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("text")).write.parquet(f"{state_dir}/texts/{call}")
        docs, id_col, text_col = spark.read.parquet(f"{state_dir}/texts/{call}"), "doc_id", "text"
    texts = with_locator(docs, [F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")])
    texts = texts.select("doc_id", "__path", "__row", normalised(F.col("text")).alias("text"))
    texts = texts.withColumn("digest", digest(F.col("text")))
    ledger_dir = f"{state_dir}/ledger"
    texts.drop("text").write.mode("append").parquet(ledger_dir)
    ledger = spark.read.parquet(ledger_dir)
    state = keyed_state(spark, ledger_dir, ledger.schema, f"{state_dir}/state", batch_bytes)
    own_call = F.col("__path").contains(f"/texts/{call}/") if call else F.lit(True)
    mine = ledger.where(own_call)
    hits = state.where("n > 1")
    if call:
        hits = shared_table(hits.join(mine.select("digest").distinct(), "digest", "left_semi"), "dedup-hits")

    # a digest with over a thousandth of all rows is dealt over SALTS tasks (there are under 1000)
    hot = hits.where(F.col("n") * 1000 > ledger.count()).select("digest", F.lit(True).alias("hot"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("__path", "__row"), F.lit(SALTS))).otherwise(F.lit(0))
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    one = lambda rows: rows.join(F.broadcast(hot), "digest", "left").withColumn("salt", salt.cast("int")).drop("hot")
    every = lambda rows: rows.join(F.broadcast(hot), "digest", "left").withColumn("salt", F.explode(salts)).drop("hot")

    # full bytes of every hit against the stayer's, found by its locator
    candidates = flag_by_bitmap(texts, F.col("digest"), key_bitmap(hits, F.col("digest")), "__hit").where("__hit").drop("__hit")
    places = hits.select(F.col("digest"), F.col("first.path").alias("__path"), F.col("first.row").alias("__row"))
    if call:
        stayer = _fetched(spark, f"{state_dir}/texts", places)
    else:
        stayer = candidates.join(places, ["digest", "__path", "__row"])
    stayer = stayer.select("digest", F.col("text").alias("kept_text"))
    clash = one(candidates).join(every(stayer), ["digest", "salt"]).where(F.col("text") != F.col("kept_text")).select("digest").distinct()
    if call:  # what clashed in an earlier call does so in this one
        clash.write.mode("append").parquet(f"{state_dir}/clash")
        clash = spark.read.parquet(f"{state_dir}/clash").distinct()
    else:
        clash = shared_table(clash, "dedup-clash")

    rows = one(mine).join(every(state), ["digest", "salt"]).withColumn("group", F.struct("first", "n"))
    if not clash.isEmpty():
        if call:
            texts = with_locator(spark.read.parquet(f"{state_dir}/texts/*"), [F.col("doc_id"), F.col("text")])
            texts = texts.withColumn("digest", digest(F.col("text")))
        again = texts.join(clash, "digest")
        by_text = again.groupBy("digest", "text").agg(F.struct(F.min(_first()).alias("first"), F.count(F.lit(1)).alias("n")).alias("group"))
        fixed = again.where(own_call).join(by_text, ["digest", "text"]).select("doc_id", "__path", "__row", "digest", "group")
        rows = rows.join(clash, "digest", "left_anti").select("doc_id", "__path", "__row", "digest", "group").unionByName(fixed)
    own = (F.col("__path") == F.col("group.first.path")) & (F.col("__row") == F.col("group.first.row"))
    return rows.select("doc_id", F.col("group.first.id").alias("keep_id"), F.col("group.n").cast("long").alias("group_size"),
                       own.alias("kept"), "digest", "__path", "__row")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(documents(spark, sf_dir))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the columns they came with; rows without copies are not shuffled."""
    docs = docs if is_scan(docs) else shared_table(docs, "dedup-input")
    placed = with_locator(docs, [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")])
    dropped = shared_table(dedup(docs, id_col, text_col).where("NOT kept").select("__path", "__row"), "dedup-dropped")
    return anti_by_key(placed, dropped, ["__path", "__row"]).select("row.*")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d
"""
