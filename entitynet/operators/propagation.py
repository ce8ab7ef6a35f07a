"""Wealth passed up the ownership relation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from entitynet.functions.scalars import parse_money, whole_units
from entitynet.session import cut

# Rounds of the propagation, and the report thresholds.
ROUNDS = 10
COMPANY_THRESHOLD = 8e9
GROUP_THRESHOLD = 2.5e10


def known_wealth(text: DataFrame, numeric: DataFrame) -> DataFrame:
    """(id, wealth): mean of the positive values of two sources; equal values count once."""
    a = text.select("id", parse_money(F.col("wealth")).alias("wealth")).filter(F.col("wealth") > 0)
    b = numeric.filter(F.col("wealth") > 0).select("id", whole_units(F.col("wealth")).alias("wealth"))
    return a.union(b).distinct().groupBy("id").agg(F.avg("wealth").alias("wealth"))


def _relations(ownership: DataFrame, known: DataFrame) -> DataFrame:
    """One row per (company, partner) with the mean share and the partner's known wealth."""
    pairs = ownership.groupBy("company", "partner").agg(F.avg("capital_pct").alias("pct"))
    seeds = known.select(F.col("id").alias("partner"), F.col("wealth").alias("seed"))
    return pairs.join(seeds, "partner", "left")


def _propagate(ownership: DataFrame, known: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The relations, those whose partner is unknown at first, and (id, value, iteration) of the companies that became complete."""
    relations = cut(_relations(ownership, cut(known)))
    waiting = cut(relations.filter(F.col("seed").isNull()).select("company", "partner", "pct"))
    # Per company: total share, weighted wealth so far, and partners still unknown.
    state = cut(relations.groupBy("company").agg(
        F.sum("pct").alias("total"),
        F.coalesce(F.sum(F.col("pct") * F.col("seed") * 0.01), F.lit(0.0)).alias("weighted"),
        F.count_if(F.col("seed").isNull()).alias("unknown"),
    ))
    value = F.try_divide(F.col("weighted"), F.col("total")) * 100
    done = [state.filter("unknown = 0").select(F.col("company").alias("id"), value.alias("value"), F.lit(0).alias("iteration"))]
    for step in range(1, rounds):
        fresh = done[-1].select(F.col("id").alias("partner"), "value").filter(F.col("value").isNotNull())
        if fresh.isEmpty():
            break
        gained = waiting.join(fresh, "partner").groupBy("company").agg(
            F.sum(F.col("pct") * F.col("value") * 0.01).alias("gain"), F.count("*").alias("filled"))
        # Complete companies stay in the table of their round; only the others go on.
        state = cut(state.filter("unknown <> 0").join(gained, "company", "left").select(
            "company", "total", (F.col("weighted") + F.coalesce("gain", F.lit(0.0))).alias("weighted"),
            (F.col("unknown") - F.coalesce("filled", F.lit(0))).alias("unknown")))
        done.append(state.filter("unknown = 0").select(F.col("company").alias("id"), value.alias("value"), F.lit(step).alias("iteration")))
    return relations, waiting, reduce(DataFrame.unionByName, done)


def propagate(ownership: DataFrame, known: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(id, value, iteration) of every company all of whose partners became known.

    The value is the share-weighted mean of the partners' wealth. A partner is filled once
    and never changed, so each round only has to send the values completed in the round
    before; a company keeps running sums instead of re-reading its relations.
    """
    return _propagate(ownership, known, rounds)[2]


def incomplete(ownership: DataFrame, known: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(company, partner, pct, wealth) of all relations after propagation, unknown partners null.

    Values completed in the last round fill nobody: there is no round left to send them.
    """
    relations, waiting, complete = _propagate(ownership, known, rounds)
    sent = complete.filter(F.col("iteration") < rounds - 1).select(F.col("id").alias("partner"), "value")
    filled = waiting.join(sent, "partner", "left").select("company", "partner", "pct", F.col("value").alias("wealth"))
    return relations.filter(F.col("seed").isNotNull()).select("company", "partner", "pct", F.col("seed").alias("wealth")).unionByName(filled)


def partial_wealth(relations: DataFrame) -> DataFrame:
    """(id, wealth): plain sum over the partners that are known, companies without any left out."""
    return relations.groupBy(F.col("company").alias("id")).agg(F.sum("wealth").alias("wealth")).filter(
        F.col("wealth").isNotNull())
