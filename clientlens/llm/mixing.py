"""Mixing sources to target weights along a time-varying curriculum.

Each source has a target (words) and a schedule: a piecewise-linear rate over training time
t in [0, 1].  The integral of the schedule gives the source's cumulative word demand D(t);
the words of a source, laid end to end (and repeated where the target exceeds them), take
the places D gives them, so the word at offset c is trained at t = D^-1(c).  Documents are
range-sorted by that position.

*Offsets* are distributed prefix sums: rows are range-partitioned on (source, key), summed
inside each slice, and slices get their offset from a table of slice totals (partitions +
sources rows), so a source with a third of all rows is spread over many tasks.
*Targets* are water-filled from one row per source.  The order of a source's documents is
the MD5 of the id, so reruns agree.

Defined results: null text has size 0; a null source is a source, last in order; documents of
size 0 take nothing; rows that share an id are placed one by one (equal ones are
interchangeable); a source without words has target 0; empty tables give empty results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clientlens.llm.common import checkpointed, documents, is_scan, shared_table, words

#: Weights by the sources' order, repeating; all targets are 150 % of all sizes together and
#: no target is above 2 times its source's size (fixed values of the contract).
WEIGHTS = (5, 2, 1)
TOTAL = (3, 2)
REPEATS = 2

#: Rate schedules as knots (t, rate), by the same order: the first kind of source fades out,
#: the second is even, the third is kept for the end.
SCHEDULES = (((0.0, 3.0), (1.0, 1.0)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.0), (0.5, 1.0), (1.0, 4.0)))


def sized(docs: DataFrame, *keep: Column, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                       F.size(words(F.col(text_col))).cast("long").alias("size"), *keep)


def targets(sizes: DataFrame, weights=WEIGHTS, total=TOTAL, repeats: int = REPEATS) -> DataFrame:
    """Per source: source_size, rank (0-based), weight, target.  One row per source is all
    that the windows here see; the sizes are summed per task first."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    per = per.withColumn("rank", rank)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod("rank", F.lit(len(weights))) + 1).cast("long"))
    # sources that reach their cap first come first; once one does not, none after it does
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before, rest, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    up, down = total
    capped = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * repeats
    per = per.withColumn("num", F.sum("source_size").over(everything) * up - capped * down)
    per = per.withColumn("den", F.sum("weight").over(rest) * down)
    fits = F.col("weight") * F.col("num") <= F.col("source_size") * repeats * F.col("den")
    # the first source that fits sets the level of all that are not capped
    first = F.struct(F.col("source_size") / F.col("weight"), "rank", "num", "den")
    per = per.withColumn("level", F.min(F.when(fits, first)).over(everything))
    level = (F.col("weight") * F.col("level.num")).cast("double") / F.col("level.den").cast("double")
    cap = (F.col("source_size") * repeats).cast("double")
    return per.select("source", "source_size", "rank", "weight", F.coalesce(F.least(level, cap), cap).alias("target"))


def place(rows: DataFrame, group: str, weight: str, order: list[str]) -> DataFrame:
    """``rows`` with ``before``: the sum of ``weight`` over the rows of its group that come
    earlier in ``order``."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # slice bounds are sampled per run: one written copy serves sums and totals
    cut = checkpointed(rows.repartitionByRange(n, group, *order).withColumn("__slice", F.spark_partition_id()))
    here = Window.partitionBy("__slice", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = cut.groupBy("__slice", group).agg(F.sum(weight).alias("t"))
    earlier = Window.partitionBy(group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("__slice").alias("s"), F.col(group).alias("g"), F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("o"))
    out = cut.withColumn("__sum", F.sum(weight).over(here))
    # at most (partitions + groups) rows
    out = out.join(F.broadcast(totals), (F.col("__slice") == F.col("s")) & F.col(group).eqNullSafe(F.col("g")))
    return out.withColumn("before", F.col("__sum") - F.col(weight) + F.col("o")).drop("__slice", "__sum", "s", "g", "o")


def _knots(schedule) -> list[tuple[float, float, float, float, float]]:
    """Segments (t, rate, end t, end rate, share of demand before) of a schedule, scaled to demand 1."""
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:]))
    out, done = [], 0.0
    for (t0, r0), (t1, r1) in zip(schedule, schedule[1:]):
        out.append((t0, r0 / area, t1, r1 / area, done))
        done += (t1 - t0) * (r0 + r1) / 2 / area
    return out


def time_at(share: Column, schedule) -> Column:
    """Inverse of the integrated schedule: the time at which ``share`` of a source's demand is met."""
    segments, out = _knots(schedule), None
    for i in reversed(range(len(segments))):
        t0, r0, t1, r1, done = segments[i]
        need = share - F.lit(done)
        slope = (r1 - r0) / (t1 - t0)  # r0 x + slope x^2 / 2 = need
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(r0 * r0) + F.lit(2 * slope) * need)) + F.lit(r0)
        here = F.lit(t0) + F.when(root > 0, F.lit(2.0) * need / root).otherwise(F.lit(0.0))
        out = here if out is None else F.when(share < F.lit(segments[i + 1][4]), here).otherwise(out)
    return out


def plan(sizes: DataFrame, schedules=SCHEDULES, **how) -> DataFrame:
    """Per row of ``sizes``: source_size, rank, target, before, taken, and ``occurrences``: an array
    of (epoch, words, position), position being the training time of its first word."""
    per = targets(sizes, **how)
    rows = place(sizes.withColumn("__key", F.md5(F.col("doc_id").cast("string"))), "source", "size", ["__key", "doc_id", "size"]).drop("__key")
    own = F.broadcast(per.withColumnRenamed("source", "__source"))  # a row per source
    rows = rows.join(own, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    goal = F.floor("target").cast("long")
    epochs = F.sequence(F.lit(0), F.lit(how.get("repeats", REPEATS) - 1))
    start = lambda e: F.col("before") + e * F.col("source_size")
    taken = lambda e: F.greatest(F.lit(0), F.least(F.col("size"), goal - start(e))).cast("long")

    def position(e):
        share = start(e).cast("double") / F.col("target")
        at = time_at(share, schedules[-1])
        for i in reversed(range(len(schedules) - 1)):
            at = F.when(F.pmod("rank", F.lit(len(schedules))) == i, time_at(share, schedules[i])).otherwise(at)
        return at

    each = F.transform(epochs, lambda e: F.struct(e.alias("epoch"), taken(e).alias("words"), F.when(taken(e) > 0, position(e)).alias("position")))
    rows = rows.withColumn("occurrences", F.filter(each, lambda x: x["words"] > 0))
    return rows.withColumn("taken", F.aggregate("occurrences", F.lit(0).cast("long"), lambda s, x: s + x["words"]))


def in_order(rows: DataFrame, *order: str) -> DataFrame:
    """Range-sorted: partitions follow each other in ``order``, as do the rows in each."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, *order).sortWithinPartitions(*order)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, in training order; documents that the mix does not take come first (null)."""
    rows = plan(sized(documents(spark, sf_dir)))
    rows = rows.withColumn("first_position", F.when(F.size("occurrences") > 0, F.col("occurrences")[0]["position"]))
    rows = rows.select("doc_id", "size", "source_size", "target", "taken", F.size("occurrences").cast("long").alias("n_epochs"), "first_position")
    return in_order(rows, "first_position", "doc_id")


def curriculum(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as documents in training order, with the columns they came with: a row per
    occurrence.  Texts stay as they are: the one occurrence of a source that its target cuts is
    taken whole if the target takes half of it or more, else not at all, whichever is nearer."""
    docs = docs if is_scan(docs) else shared_table(docs, "mix-input")
    cols = docs.columns
    meta = docs.metadataColumn("_metadata")
    place_of = (meta["file_path"].alias("__path"), meta["row_index"].alias("__row"))
    taken = plan(sized(docs, *place_of, id_col=id_col, text_col=text_col, source_col=source_col))
    whole = F.filter("occurrences", lambda x: x["words"] * 2 >= F.col("size"))
    taken = taken.select("__path", "__row", whole.alias("__occurrences")).where(F.size("__occurrences") > 0)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("__doc"), *place_of).join(taken, ["__path", "__row"])
    rows = rows.select("__doc", F.explode("__occurrences").alias("__x"))
    out = rows.select("__doc", F.col("__x.position").alias("__position"), F.col("__x.epoch").alias("__epoch"), F.col(f"__doc.`{id_col}`").alias("__id"))
    return in_order(out, "__position", "__id", "__epoch").select(*[F.col(f"__doc.`{c}`").alias(c) for c in cols])


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, CAST(CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS weight FROM s),
o AS (SELECT *, sum(source_size) OVER () * 3 - 2 * 2 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS num,
        2 * sum(weight) OVER (ORDER BY source_size / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS den FROM w),
f AS (SELECT num, den FROM o WHERE weight * num <= source_size * 2 * den ORDER BY source_size / weight, rank LIMIT 1),
t AS (SELECT source, source_size, rank, coalesce(least(CAST(weight * (SELECT num FROM f) AS DOUBLE) / CAST((SELECT den FROM f) AS DOUBLE), CAST(2 * source_size AS DOUBLE)),
        CAST(2 * source_size AS DOUBLE)) AS target FROM o),
p AS (SELECT d.*, t.source_size, t.rank, t.target, CAST(floor(t.target) AS BIGINT) AS goal,
        CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, greatest(0, least(size, goal - b)) AS one, greatest(0, least(size, goal - b - source_size)) AS two FROM p),
r AS (SELECT *, CASE WHEN one > 0 THEN CAST(b AS DOUBLE) / target END AS x FROM q)
SELECT doc_id, size, source_size, target, CAST(one + two AS BIGINT) AS taken,
  CAST((CASE WHEN one > 0 THEN 1 ELSE 0 END) + (CASE WHEN two > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_epochs,
  CASE WHEN one = 0 THEN NULL {positions} END AS first_position
FROM r
"""


def _sql_time(schedule) -> str:
    """The same inverse in SQL, for the oracle."""
    num, parts = lambda v: f"CAST('{v!r}' AS DOUBLE)", []
    segments = _knots(schedule)
    for i, (t0, r0, t1, r1, done) in enumerate(segments):
        need = f"(x - {num(done)})"
        root = f"(sqrt(greatest({num(0.0)}, {num(r0 * r0)} + {num(2 * ((r1 - r0) / (t1 - t0)))} * {need})) + {num(r0)})"
        end = num(segments[i + 1][4]) if i + 1 < len(segments) else num(2.0)
        parts.append(f"WHEN x < {end} THEN {num(t0)} + {num(2.0)} * {need} / {root}")
    return "CASE " + " ".join(parts) + " END"


SQL = SQL.replace("{positions}", " ".join(f"WHEN rank % 3 = {i} THEN {_sql_time(x)}" for i, x in enumerate(SCHEDULES)))
