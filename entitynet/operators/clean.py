"""Cleaning and data checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def require(df: DataFrame, *cols: str) -> DataFrame:
    return df.dropna(subset=list(cols))


def null_report(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in cols], F.count("*").alias("n_rows"))


def drop_header_rows(df: DataFrame, col: str, header: str) -> DataFrame:
    return df.filter(F.col(col) != header)


def drop_self_loops(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.filter(F.col(a) != F.col(b))


def keep_types(df: DataFrame, col: str, types: list[str]) -> DataFrame:
    return df.filter(F.col(col).isin(*types))


def in_periods(df: DataFrame, col: str, periods: list[int]) -> DataFrame:
    return df.filter(F.col(col).isin(*periods))


def between_periods(df: DataFrame, col: str, lo: int, hi: int) -> DataFrame:
    return df.filter(F.col(col).between(lo, hi))


def valid_during(df: DataFrame, start: str, end: str, lo: str, hi: str) -> DataFrame:
    """Rows whose validity meets [lo, hi); a null end is still open."""
    begins = F.col(start) < F.lit(hi).cast("date")
    ends = F.col(end).isNull() | (F.col(end) > F.lit(lo).cast("date"))
    return df.filter(begins & ends)


def id_prefix(df: DataFrame, col: str, prefix: str) -> DataFrame:
    return df.filter(F.col(col).startswith(prefix))


def restrict_to(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(keys, on, "left_semi")


def known_groups(df: DataFrame, min_size: int | None = None) -> DataFrame:
    """Distinct (id, com); with ``min_size`` only groups of at least that many members."""
    distinct = df.select("id", "com").distinct()
    if min_size is None:
        return distinct
    large = distinct.groupBy("com").agg(F.count("*").alias("n")).filter(F.col("n") >= min_size)
    return restrict_to(distinct, large.select("com"), "com")


OWNERSHIP_KEY = ["company", "partner", "capital_pct", "profit_pct"]


def clean_ownership(df: DataFrame) -> DataFrame:
    """Distinct relations with a capital share other than zero.

    They are dealt out by company and partner, so that sums by this pair need no second shuffle.
    """
    return df.filter(F.col("capital_pct") != 0).select(*OWNERSHIP_KEY).repartition("company", "partner").distinct()


def ownership_report(df: DataFrame) -> DataFrame:
    """Row, null, duplicate and zero counts in one pass over the de-duplicating aggregation."""
    capital, profit = F.col("capital_pct"), F.col("profit_pct")
    copies = df.groupBy(*OWNERSHIP_KEY).agg(F.count("*").alias("n"))
    return copies.agg(
        F.sum("n").alias("n_rows"),
        F.count("*").alias("distinct_rows"),
        F.count_if(F.col("n") > 1).alias("repeated_rows"),
        F.coalesce(F.sum(F.when(capital.isNull() | profit.isNull(), F.col("n"))), F.lit(0)).alias("null_pct_rows"),
        F.count_if((capital == 0) | (profit == 0)).alias("any_zero"),
        F.count_if((capital == 0) & (profit == 0)).alias("both_zero"),
        F.count_if(capital == 0).alias("zero_capital"),
        F.count_if(profit == 0).alias("zero_profit"),
    )


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def ownership_totals(df: DataFrame) -> DataFrame:
    """Sum of both percentages per company."""
    return df.groupBy("company").agg(F.sum("capital_pct").alias("capital"), F.sum("profit_pct").alias("profit"))


def distinct_complete_rows(df: DataFrame) -> DataFrame:
    """Distinct rows among those without any null."""
    no_null: Column = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in df.columns])
    return df.filter(no_null).distinct().agg(F.count("*").alias("n"))
