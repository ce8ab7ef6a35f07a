"""Exact distribution statistics: the numbers behind the charts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from entitynet.functions.ranking import ordered_prefix
from entitynet.session import cut

# Whisker length of the outlier rule, and points of a density curve.
WHISKER = 1.5
CURVE_POINTS = 200
#: Terms of a cell's series in a density curve, and bandwidths up to which a value counts.
TERMS, REACH = 16, 9.0


def quantiles(df: DataFrame, col: str, qs: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per ``by`` (one row in all without it).

    Values are counted first, then located by their distributed running count, so neither
    a large group nor the whole column is held in one task. ``df`` is evaluated once.
    """
    by = by or []
    counts = df.filter(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count("*").alias("_n"))
    placed = cut(ordered_prefix(counts, [F.col(col)], F.col("_n"), by, "_before"))
    if by:
        sized = placed.join(cut(placed.groupBy(*by).agg(F.sum("_n").alias("_size"))), by)
    else:
        sized = placed.withColumn("_size", placed.agg(F.sum("_n")).scalar())
    picks = []
    for name, q in qs.items():
        rank = (F.col("_size") - 1) * F.lit(q)
        for end, at in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            covers = (F.col("_before") <= at) & (at < F.col("_before") + F.col("_n"))
            picks.append(F.max(F.when(covers, F.col(col))).alias(f"{name}_{end}"))
        picks.append(F.max(rank - F.floor(rank)).alias(f"{name}_at"))
    found = sized.groupBy(*by).agg(*picks)
    value = lambda n: F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * F.col(f"{n}_at")
    return found.select(*by, *[value(n).alias(n) for n in qs])


def quartiles(df: DataFrame, col: str, by: list[str] | None = None) -> DataFrame:
    return quantiles(df, col, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, by)


def iqr_bounds(df: DataFrame, col: str, k: float = WHISKER, by: list[str] | None = None) -> DataFrame:
    q = quantiles(df, col, {"q25": 0.25, "q75": 0.75}, by)
    reach = (F.col("q75") - F.col("q25")) * k
    return q.select(*(by or []), (F.col("q25") - reach).alias("lower"), (F.col("q75") + reach).alias("upper"))


def _flag_inside(df: DataFrame, col: str, k: float, by: list[str] | None) -> DataFrame:
    df = cut(df)
    bounds = iqr_bounds(df, col, k, by)
    if by:
        flagged = df.join(cut(bounds), by)
        lower, upper = F.col("lower"), F.col("upper")
    else:
        flagged = df.withColumn("_b", bounds.select(F.struct("lower", "upper")).scalar())
        lower, upper = F.col("_b.lower"), F.col("_b.upper")
    return flagged.withColumn("inside", F.col(col).between(lower, upper)).drop("lower", "upper", "_b")


def iqr_filter(df: DataFrame, col: str, k: float = WHISKER, by: list[str] | None = None) -> DataFrame:
    """Rows within k interquartile ranges of the quartiles, bounds included."""
    return _flag_inside(df, col, k, by).filter("inside").drop("inside")


def iqr_removed(df: DataFrame, col: str, k: float = WHISKER, by: list[str] | None = None) -> DataFrame:
    """How many rows the outlier rule keeps and removes."""
    return _flag_inside(df, col, k, by).groupBy(*(by or [])).agg(
        F.count_if(F.col("inside")).alias("kept"), F.count_if(~F.col("inside")).alias("removed"))


def _auto_bins(df: DataFrame, col: str) -> Column:
    """The finer of Sturges' and Freedman-Diaconis' widths, as a scalar subquery."""
    q = quantiles(df, col, {"q25": 0.25, "q75": 0.75})
    s = df.agg(F.count(col).alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi"))
    iqr = q.select(F.col("q75") - F.col("q25")).scalar()
    span = F.col("hi") - F.col("lo")
    sturges = span / (F.log2("n") + 1)
    diaconis = 2 * iqr / F.cbrt("n")
    width = F.when(diaconis > 0, F.least(diaconis, sturges)).otherwise(sturges)
    return s.select(F.when(span > 0, F.ceil(span / width)).otherwise(1)).scalar()


def histogram(df: DataFrame, col: str, bins: int | str = 10) -> DataFrame:
    """(bin, lower, upper, n): equal width, last edge included, empty bins kept.

    ``bins='auto'`` derives their number from the data.
    """
    values = cut(df.filter(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("_v")))
    number = _auto_bins(values, "_v") if bins == "auto" else F.lit(bins)
    flat = F.col("lo") == F.col("hi")
    frame = values.agg(F.min("_v").alias("lo"), F.max("_v").alias("hi")).select(
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
        number.cast("int").alias("bins"),
    ).select("lo", "bins", ((F.col("hi") - F.col("lo")) / F.col("bins")).alias("width")).filter(F.col("lo").isNotNull())
    shape = frame.select(F.struct("lo", "bins", "width")).scalar()
    at = F.floor((F.col("_v") - F.col("_s.lo")) / F.col("_s.width"))
    counted = (
        values.withColumn("_s", shape)
        .select(F.least(at, F.col("_s.bins") - 1).cast("int").alias("bin"))
        .groupBy("bin").agg(F.count("*").alias("n"))
    )
    axis = frame.select("lo", "width", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    return axis.join(counted, "bin", "left").select(
        "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("lower"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("upper"),
        F.coalesce("n", F.lit(0)).alias("n"))


def kde(df: DataFrame, col: str, points: int = CURVE_POINTS) -> DataFrame:
    """(point, x, density): Gaussian kernel, Scott's bandwidth, from minimum to maximum.

    Values are filed in cells half a bandwidth wide. With t a value's and u a point's
    distance from the middle of a cell, in bandwidths, the kernel is exp(-u^2/2) times the sum of
    He_k(u) t^k / k! over the Hermite polynomials He_k, so a cell needs only the sums of its t^k.
    As |t| <= 1/4, what ``TERMS`` terms leave out is below 1e-16 of the kernel's height, and so is what a
    point beyond ``REACH`` bandwidths gets. Work is values x terms, then cells x points within reach.
    Without spread (a constant column, or a single row) the density is NULL.
    """
    values = cut(df.filter(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("_v")))
    row = values.agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.stddev_samp("_v").alias("sd")).first()
    if not row["n"]:
        return df.sparkSession.createDataFrame([], "point int, x double, density double")
    low, step = row["lo"], (row["hi"] - row["lo"]) / (points - 1)
    axis = df.sparkSession.range(points).select(F.col("id").cast("int").alias("point"), (low + F.col("id") * F.lit(step)).alias("x"))
    width = (row["sd"] or 0.0) * row["n"] ** -0.2 if step else 0.0
    if not width:
        return axis.withColumn("density", F.lit(None).cast("double"))
    cell = F.floor((F.col("_v") - low) / (width / 2))
    middle = low + (F.col("cell") + 0.5) * (width / 2)
    moments = values.select(cell.alias("cell"), "_v").select("cell", ((F.col("_v") - middle) / width).alias("t")).groupBy("cell").agg(
        F.array(*[F.sum(F.pow("t", F.lit(float(k)))) / math.factorial(k) for k in range(TERMS)]).alias("a"))
    first = F.greatest(F.ceil((middle - REACH * width - low) / step), F.lit(0))
    last = F.least(F.floor((middle + REACH * width - low) / step), F.lit(points - 1))
    met = moments.filter(first <= last).select("a", middle.alias("middle"), F.explode(F.sequence(first, last)).alias("i")).select(
        "a", F.col("i").cast("int").alias("point"), ((low + F.col("i") * F.lit(step) - F.col("middle")) / width).alias("u"))
    u = F.col("u")
    series = F.aggregate("a", F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("h"), F.lit(0.0).alias("before"), F.lit(0.0).alias("k")), lambda s, a: F.struct(
        (s["sum"] + a * s["h"]).alias("sum"), (u * s["h"] - s["k"] * s["before"]).alias("h"), s["h"].alias("before"), (s["k"] + 1.0).alias("k")))["sum"]
    sums = met.groupBy("point").agg(F.sum(F.exp(-u * u / 2) * series).alias("sum"))
    norm = row["n"] * width * math.sqrt(2 * math.pi)
    return axis.join(sums, "point", "left").select("point", "x", (F.greatest(F.coalesce("sum", F.lit(0.0)), F.lit(0.0)) / norm).alias("density"))


def largest_groups(df: DataFrame, by: str, k: int) -> DataFrame:
    """The k groups with most rows, ties by group."""
    counts = df.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), F.asc(by)).limit(k)


def group_distribution(df: DataFrame, by: str, col: str, k: int) -> DataFrame:
    """Size, minimum, quartiles and maximum in each of the k largest groups."""
    df = cut(df.select(by, col))
    top = largest_groups(df, by, k)
    kept = df.join(top.select(by), by, "left_semi")
    ends = kept.groupBy(by).agg(F.count(col).alias("n"), F.min(col).alias("min"), F.max(col).alias("max"))
    return ends.join(quartiles(kept, col, [by]), by)


def group_means(df: DataFrame, by: str, col: str) -> DataFrame:
    return df.groupBy(by).agg(F.avg(col).alias(col))


def group_totals(df: DataFrame, by: str, col: str) -> DataFrame:
    return df.groupBy(by).agg(F.sum(col).alias(col))


def describe(df: DataFrame, col: str) -> DataFrame:
    """Count, mean, standard deviation, extremes and exact quartiles in one row."""
    df = cut(df.select(col))
    q = quartiles(df, col).select(F.struct("q25", "q50", "q75")).scalar()
    return df.agg(F.count(col).alias("count"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
                  F.min(col).alias("min"), F.max(col).alias("max")).withColumn("_q", q).select(
        "count", "mean", "std", "min", F.col("_q.q25").alias("q25"), F.col("_q.q50").alias("q50"),
        F.col("_q.q75").alias("q75"), "max")


def over_threshold(df: DataFrame, col: str, threshold: float) -> DataFrame:
    return df.agg(F.count_if(F.col(col) > threshold).alias("n_over"), F.count("*").alias("n_rows"))
