"""Order statistics without single-task windows and without jobs while planning.

Values are cut into bands by a function that never falls as the value rises, so a group (a
plan, or the whole table) of any size is spread over its bands.  A band's offset is the
running total of the bands before it; there are at most some hundred thousand bands,
whatever the number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# tasks over which the rows of one very frequent value are dealt
SALTS = 32


def band(df: DataFrame, col: str) -> Column:
    """Numbers: 256 bands per factor e, by sign; text: its first characters."""
    if isinstance(df.schema[col].dataType, T.StringType):
        return F.substring(col, 1, 4)
    v = F.col(col).cast("double")
    size = F.floor(F.log1p(F.least(F.abs(v), F.lit(1e300))) * 256.0).cast("double")
    return F.when(F.isnan(v), F.lit(1e9)).otherwise(F.signum(v) * size + 0.0)


def running_counts(hist: DataFrame, group_cols: list[str], value_col: str, weight_col: str) -> DataFrame:
    """For rows (group..., value, weight) with distinct values in a group add ``cum_before`` /
    ``cum_incl``: the total weight of values strictly below / at-or-below ``value``."""
    h = hist.withColumn("_band", band(hist, value_col))
    gp = [*group_cols, "_band"]
    w_local = Window.partitionBy(*gp).orderBy(value_col).rowsBetween(Window.unboundedPreceding, 0)
    w_off = Window.partitionBy(*group_cols).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    totals = h.groupBy(*gp).agg(F.sum(weight_col).alias("_t"))
    offsets = totals.select(*gp, F.coalesce(F.sum("_t").over(w_off), F.lit(0)).alias("_off"))
    out = h.withColumn("_run", F.sum(weight_col).over(w_local)).join(offsets, gp)
    out = out.withColumn("cum_incl", F.col("_off") + F.col("_run"))
    return out.withColumn("cum_before", F.col("cum_incl") - F.col(weight_col)).drop("_band", "_run", "_off")


def exact_quantile(df: DataFrame, group_cols: list[str], value_col: str, q: float, out_col: str = "quantile") -> DataFrame:
    """Linear-interpolated quantile (numpy/pandas default, DuckDB ``quantile_cont``)
    per group, nulls ignored.  Values are first histogrammed (map-side combined), ranked with
    ``running_counts``, and only the two bracketing rows per group are kept."""
    v = df.where(F.col(value_col).isNotNull() & ~F.isnan(F.col(value_col).cast("double")))
    hist = v.groupBy(*group_cols, value_col).agg(F.count(F.lit(1)).alias("_w"))
    rc = running_counts(hist, group_cols, value_col, "_w")
    tot = hist.groupBy(*group_cols).agg(F.sum("_w").alias("_n"))
    pos = F.lit(q) * (F.col("_n") - 1)
    tot = tot.select(*group_cols, "_n", F.floor(pos).alias("_lo"), F.ceil(pos).alias("_hi"),
                     (pos - F.floor(pos)).alias("_frac"))
    # one row per group: a global quantile joins a 1-row table
    j = rc.join(tot, group_cols) if group_cols else rc.crossJoin(F.broadcast(tot))
    hit_lo = (F.col("cum_before") <= F.col("_lo")) & (F.col("_lo") < F.col("cum_incl"))
    hit_hi = (F.col("cum_before") <= F.col("_hi")) & (F.col("_hi") < F.col("cum_incl"))
    sel = j.where(hit_lo | hit_hi)
    agg = sel.groupBy(*group_cols).agg(
        F.max(F.when(hit_lo, F.col(value_col).cast("double"))).alias("_vlo"),
        F.max(F.when(hit_hi, F.col(value_col).cast("double"))).alias("_vhi"),
        F.max("_frac").alias("_frac"),
    )
    return agg.select(
        *group_cols, (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_frac")).alias(out_col)
    ).where(F.col(out_col).isNotNull())


def cume_dist_in_group(df: DataFrame, group_cols: list[str], value_col: str, out_col: str = "cume_dist") -> DataFrame:
    """Share of non-null values <= own value inside the group (= ``cume_dist``), null when the own
    value is null.  Histogram -> running counts -> joined back on (group, value).  Values
    that hold over a thousandth of all rows (there are under 1000) are salted."""
    keys = [*group_cols, value_col]
    v = df.where(F.col(value_col).isNotNull())
    hist = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("_w"))
    tot = hist.groupBy(*group_cols).agg(F.sum("_w").alias("_n"))
    frac = running_counts(hist, group_cols, value_col, "_w").join(tot, group_cols).select(
        *keys, (F.col("cum_incl") / F.col("_n")).alias(out_col), "_w")
    one = hist.agg(F.sum("_w").alias("_all"))  # one row
    frac = frac.crossJoin(F.broadcast(one)).withColumn("_hot", F.col("_w") * 1000 > F.col("_all"))
    hot = hist.crossJoin(F.broadcast(one)).where(F.col("_w") * 1000 > F.col("_all")).select(*keys, F.lit(True).alias("_hot"))
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(SALTS)).cast("int")
    rows = df.join(F.broadcast(hot), keys, "left")
    rows = rows.withColumn("_salt", F.when(F.col("_hot") | F.col(value_col).isNull(), spread).otherwise(F.lit(0))).drop("_hot")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    frac = frac.select(*keys, out_col, F.explode(salts).alias("_salt"))
    return rows.join(frac, [*keys, "_salt"], "left").drop("_salt")
