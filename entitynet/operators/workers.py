"""Worker counts per employer from two kinds of returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def payroll_counts(payroll: DataFrame, measures: list[str]) -> DataFrame:
    """Distinct workers and the sum of every measure per employer, check digit and period."""
    return payroll.groupBy("employer", "dv", "period").agg(
        F.count_distinct("worker").alias("dependent_workers"), *[F.sum(m).alias(m) for m in measures])


def fee_counts(fees: DataFrame) -> DataFrame:
    """Distinct workers and total fees per payer and period."""
    return fees.groupBy("payer", "period").agg(
        F.count_distinct("worker").alias("fee_workers"), F.sum("fee").alias("total_fee"))


def latest_per_key(df: DataFrame, keys: list[str], order: str, strict: bool = False) -> DataFrame:
    """The latest row per key as an aggregation, so no group is sorted in one task.

    By default each column takes its latest non-null value, which may come from an older
    row than its neighbours; ``strict`` keeps the latest row as it is.
    """
    columns = [c for c in df.columns if c not in keys]
    if strict:
        row = F.max_by(F.struct(*columns), F.col(order)).alias("row")
        return df.groupBy(*keys).agg(row).select(*keys, "row.*")
    return df.groupBy(*keys).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def worker_table(payroll_latest: DataFrame, fee_latest: DataFrame) -> DataFrame:
    """Both counts per id, zero where one return is missing."""
    dependent = payroll_latest.select(F.col("employer").alias("id"), "dependent_workers")
    on_fees = fee_latest.select(F.col("payer").alias("id"), "fee_workers")
    return on_fees.join(dependent, "id", "full").na.fill(0, ["fee_workers", "dependent_workers"])
