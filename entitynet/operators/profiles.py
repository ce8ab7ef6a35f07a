"""Attributes of known groups: coverage, frequencies and modes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from entitynet.session import cut


def attach(groups: DataFrame, attribute: DataFrame, on: str = "id") -> DataFrame:
    """Group members that have the attribute; a member of two groups appears in both."""
    return groups.join(attribute, on, "inner")


def coverage(groups: DataFrame, attached: DataFrame) -> DataFrame:
    """How many members and groups the attribute reaches."""
    have = attached.agg(F.count("*").alias("matched_rows"), F.count_distinct("id").alias("matched_ids"),
                        F.count_distinct("com").alias("matched_groups"))
    total = groups.agg(F.count_distinct("id").alias("n")).scalar()
    return have.withColumn("group_ids", total)


def lookup(facts: DataFrame, dimension: DataFrame, on: str) -> DataFrame:
    """Fact code to dimension row."""
    return facts.join(dimension, on, "inner")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))


def top_values(df: DataFrame, col: str, k: int) -> DataFrame:
    """The k most frequent values, ties by value."""
    return value_counts(df, col).orderBy(F.desc("n"), F.asc(col)).limit(k)


def group_modes(df: DataFrame, by: str, col: str) -> DataFrame:
    """Most frequent value per group, the smallest on a tie, NULL when a group has no value.

    Values are counted before the group is formed, so a group of any size reaches the
    second aggregation as one row per distinct value and is combined before the shuffle.
    """
    counted = df.groupBy(by, col).agg(F.count("*").alias("n"))
    rank = F.when(F.col(col).isNotNull(), F.struct((-F.col("n")).alias("n"), F.col(col).alias("v")))
    return counted.groupBy(by).agg(F.min_by(col, rank).alias(col))


def mode_of_modes(df: DataFrame, by: str, col: str, k: int) -> DataFrame:
    """How many groups share the same mode: the k most common modes."""
    return top_values(group_modes(df, by, col), col, k)


def categorical_profile(df: DataFrame, by: str, col: str, k: int) -> DataFrame:
    """Top-k values and top-k modes of one attribute, stacked with their kind."""
    df = cut(df.select(by, col))
    shape = lambda d, kind: d.select(F.lit(kind).alias("kind"), F.col(col).cast("string").alias("value"), "n")
    return shape(top_values(df, col, k), "value").unionByName(shape(mode_of_modes(df, by, col, k), "mode"))


def directors(fees: DataFrame) -> DataFrame:
    """Distinct (id, director): retained at 10 % or at 20 %."""
    paid = (F.col("dir10") > 0) | (F.col("dir20") > 0)
    return fees.filter(paid).select(F.col("payer").alias("id"), F.col("worker").alias("director")).distinct()
