"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clientlens.session import arrow_rows, materialize, ship, work_dir  # noqa: F401

#: Fixed values of the contracts: the white space between words.
WS = r"[\x20\x09-\x0D]+"
NOT_WS = r"[^\x20\x09-\x0D]"

#: Bits of a key bitmap (8 MB in all, whatever the number of keys).
BITMAP_BITS = 1 << 26


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS, -1), "")


def shared_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back: a lineage
    cut that every executor can read and that a lost executor does not take along."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def drop_shared(*tables: DataFrame) -> None:
    """Remove tables of ``shared_table`` whose last reader is done; others are left alone."""
    for t in tables:
        if path := getattr(t, "_shared_path", None):
            drop_path(t.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark)}/llm/{label}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    return materialize(df)


def is_scan(docs: DataFrame) -> bool:
    """True if the rows come straight from files, so that Spark knows each row's file and place."""
    try:
        meta = docs.metadataColumn("_metadata")
        return bool(docs.select(meta["file_path"], meta["row_index"]).columns)
    except AnalysisException:
        return False


def with_locator(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """``keep`` plus a content locator ``__path``, ``__row`` that a second read finds again:
    the file and the row in it when ``docs`` is a file scan, else the row's place in a
    checkpointed copy (so that both reads see the same places)."""
    if is_scan(docs):
        meta = docs.metadataColumn("_metadata")
        return docs.select(*keep, meta["file_path"].alias("__path"), meta["row_index"].alias("__row"))
    return checkpointed(docs.select(*keep, F.lit("").alias("__path"), F.monotonically_increasing_id().alias("__row")))


def key_bitmap(keys: DataFrame, key: Column, bits: int = BITMAP_BITS) -> DataFrame:
    """A bitmap of hashed keys in slices of 4 KB: at most ``bits / 32768`` rows, so it can be
    broadcast whatever the number of keys.  It may name a key too many, never one too few."""
    h = F.pmod(F.xxhash64(key), F.lit(bits)) + 1
    return (
        keys.select(F.bitmap_bucket_number(h).alias("__slice"), F.bitmap_bit_position(h).alias("__bit"))
        .groupBy("__slice").agg(F.bitmap_construct_agg("__bit").alias("__bitmap"))
    )


def free(columns: list[str], name: str) -> str:
    """``name``, made longer until no column has it."""
    while name.lower() in (c.lower() for c in columns):
        name += "_"
    return name


def flag_by_bitmap(df: DataFrame, key: Column, bitmap: DataFrame, flag: str, bits: int = BITMAP_BITS) -> DataFrame:
    """``df`` with boolean ``flag``: false only if the key is not among the bitmap's keys."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    where, bit, found = (free(df.columns, x) for x in ("__slice", "__bit", "__bitmap"))
    h = F.pmod(F.xxhash64(key), F.lit(bits)) + 1
    probe = df.select(*cols, F.bitmap_bucket_number(h).alias(where), F.bitmap_bit_position(h).alias(bit))
    hit = probe.join(F.broadcast(bitmap.toDF(where, found)), where, "left")
    byte = F.substr(F.col(found), (F.col(bit) / 8).cast("int") + 1, F.lit(1))
    byte = F.conv(F.hex(byte), 16, 10).cast("int")
    return hit.select(*cols, F.coalesce(F.getbit(byte, F.pmod(F.col(bit), F.lit(8)).cast("int")) == 1, F.lit(False)).alias(flag))


def semi_by_key(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``keys`` (one column ``key``).  Wide rows are
    dropped by the bitmap before the shuffle; the join then decides exactly."""
    flag = free(df.columns, "__hit")
    hit = flag_by_bitmap(df, F.col(key), key_bitmap(keys, F.col(key)), flag).where(F.col(flag)).drop(flag)
    return hit.join(keys.select(key).distinct(), key, "left_semi")


def anti_by_key(df: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``df`` whose ``key`` columns are not in ``keys``: rows that the bitmap rules out
    pass without a shuffle, the others are anti-joined."""
    flag = free(df.columns, "__hit")
    hit = flag_by_bitmap(df, F.struct(*key), key_bitmap(keys, F.struct(*key)), flag)
    clear = hit.where(~F.col(flag)).drop(flag)
    rest = hit.where(F.col(flag)).drop(flag).join(keys.select(*key), key, "left_anti")
    return clear.unionByName(rest)
