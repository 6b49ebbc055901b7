"""File sources and sinks: raw CSV feeds, corpus folders, optional revenue events,
report export."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientlens.schemas import RAW_CLIENTS, RAW_REVENUE_EVENTS, RAW_SUBSCRIPTIONS, RAW_USAGE, require_columns
from clientlens.session import materialize

RAW_SCHEMAS = {"clients": RAW_CLIENTS, "subscriptions": RAW_SUBSCRIPTIONS, "usage": RAW_USAGE,
               "revenue_events": RAW_REVENUE_EVENTS}


def read_raw_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Header CSV, every column a string (no inference), PERMISSIVE.

    ``_ord`` orders rows as in the feed (file path, split start, row within
    split) for "first wins" / "last wins" rules."""
    df = (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
          .option("encoding", "UTF-8").csv(path))
    return df.withColumn(
        "_ord", F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"),
                         F.monotonically_increasing_id().alias("i"))
    )


def read_raw(spark: SparkSession, base: str, name: str) -> DataFrame:
    return read_raw_csv(spark, f"{base.rstrip('/')}/{name}.csv", RAW_SCHEMAS[name])


CORRUPT = "_corrupt"


def read_feed(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame:
    """S1/S2 for dirty feeds: every record of the feed as a row, nothing filled in or dropped in
    silence.  A record with too few or too many fields, or with quoting that does not end, has its raw
    text in ``_corrupt``; quoted line ends belong to their field (so a file is one task's: split
    large feeds into files).  ``_file`` and ``_ord`` say where it came from."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    df = (spark.read.schema(full).option("header", header).option("mode", "PERMISSIVE").option("encoding", "UTF-8")
          .option("multiLine", True).option("escape", '"').option("columnNameOfCorruptRecord", CORRUPT)
          .option("columnPruning", False)  # a record is judged by all its fields, whatever is selected
          .option("enforceSchema", True).csv(path))
    file = F.col("_metadata.file_path")
    # valid rows and rejects both read it: parsed once, whole records, into the shared folder
    return materialize(df.withColumn("_file", file).withColumn("_ord", F.struct(file.alias("f"), F.lit(0).cast("long").alias("b"), F.monotonically_increasing_id().alias("i"))))


def corpus_files(spark: SparkSession, corpus_dir: str, suffixes=("md", "yaml", "yml")) -> DataFrame:
    """Recursive corpus scan, one row per file (source, text), suffix filter
    case-insensitive, files ordered by path; an empty corpus is an error."""
    # binaryFile: exactly one row per file, whatever its line structure
    anycase = ["".join(f"[{c.lower()}{c.upper()}]" for c in x) for x in suffixes]
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
          .option("pathGlobFilter", "*.{" + ",".join(anycase) + "}").load(corpus_dir)  # other files are not read
          .select(F.col("path"), F.decode(F.col("content"), "UTF-8").alias("text")))
    if df.isEmpty():
        raise ValueError("No corpus files found (.md/.yml/.yaml).")
    return df.withColumn("source", F.regexp_extract("path", r"([^/]+)$", 1)).orderBy("path")


def ordered_files(corpus: DataFrame, names: list[str]) -> DataFrame:
    """Keep an explicit ordered file list (missing files skipped); ``file_ord`` keeps the order."""
    spark = corpus.sparkSession
    order = spark.createDataFrame(list(enumerate(names)), "file_ord int, source string")
    return corpus.join(F.broadcast(order), "source")  # the list is a small, fixed config


def read_revenue_events(spark: SparkSession, path: str) -> DataFrame:
    """Optional source.  Missing file -> empty typed result; missing columns -> error."""
    typed = T.StructType([T.StructField("client_id", T.StringType()), T.StructField("event_type", T.StringType()),
                          T.StructField("amount", T.DoubleType()), T.StructField("event_date", T.DateType())])
    try:
        raw = spark.read.option("header", True).csv(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], typed)
    require_columns(raw, ["client_id", "event_type", "amount", "event_date"], "revenue_events.csv")
    from clientlens.functions.parsing import parse_date, parse_number, strip

    return raw.select(strip("client_id").alias("client_id"), F.col("event_type"),
                      parse_number("amount").alias("amount"), parse_date("event_date").alias("event_date"))


def write_table(table: DataFrame, path: str, name: str = "table") -> DataFrame:
    """Overwrite an exported table (Parquet) and read it back; an empty one is an error."""
    table.write.mode("overwrite").parquet(path)
    out = table.sparkSession.read.schema(table.schema).parquet(path)
    if out.isEmpty():
        raise ValueError(f"empty {name}")
    return out


def write_report(report: DataFrame, path: str, fmt: str = "csv") -> None:
    """S3: overwrite the report; dates as yyyy-MM-dd; an empty report is an error."""
    if report.isEmpty():
        raise ValueError("empty report")
    out = report
    for f in report.schema.fields:
        if isinstance(f.dataType, T.DateType):
            out = out.withColumn(f.name, F.date_format(f.name, "yyyy-MM-dd"))
    w = out.write.mode("overwrite")
    (w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path))
