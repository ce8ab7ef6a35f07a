"""Flows inside and between known groups."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, functions as F

from entitynet.functions.scalars import percent, ratio

#: Arcs that one task sums by pair, and the most tasks: up to 200 a shuffle is written straight to files, without a buffer of rows.
ARCS_OF_TASK, MOST_TASKS = 250_000, 200


def label_arcs(arcs: DataFrame, groups: DataFrame) -> DataFrame:
    """Positive arcs with the group of each side, kept when at least one side is labelled.

    A member of two groups yields one row per group. ``groups`` is expected distinct.
    No join hint: the optimizer broadcasts the groups while they are small and
    otherwise shuffles, splitting skewed emitters.
    """
    emitting = groups.select(F.col("id").alias("emitter"), F.col("com").alias("emitter_com"))
    receiving = groups.select(F.col("id").alias("receiver"), F.col("com").alias("receiver_com"))
    return (
        arcs.filter(F.col("amount") > 0)
        .join(emitting, "emitter", "left")
        .join(receiving, "receiver", "left")
        .filter(F.col("emitter_com").isNotNull() | F.col("receiver_com").isNotNull())
    )


def group_flows(labelled: DataFrame, count_unlabelled_as_extra: bool = False) -> DataFrame:
    """(com, intra_emission, extra_emission, intra_reception, extra_reception) in one aggregation.

    Each arc is seen once from each labelled side; a sum nobody contributed to is NULL.
    """
    e, r = F.col("emitter_com"), F.col("receiver_com")
    if not count_unlabelled_as_extra:
        labelled = labelled.filter(e.isNotNull() & r.isNotNull())
    sides = F.array(F.struct(e.alias("com"), F.lit(True).alias("emits")),
                    F.struct(r.alias("com"), F.lit(False).alias("emits")))
    seen = labelled.select("amount", e.eqNullSafe(r).alias("intra"), F.explode(sides).alias("side")).select(
        "amount", "intra", "side.com", "side.emits")
    total = lambda condition: F.sum(F.when(condition, F.col("amount")))
    intra, emits = F.col("intra"), F.col("emits")
    return seen.filter(F.col("com").isNotNull()).groupBy("com").agg(
        total(intra & emits).alias("intra_emission"), total(~intra & emits).alias("extra_emission"),
        total(intra & ~emits).alias("intra_reception"), total(~intra & ~emits).alias("extra_reception"))


def group_flow_kpis(flows: DataFrame, groups: DataFrame, missing_as_zero: bool = False) -> DataFrame:
    """Percentages outside, emission ratio and members per group; groups without flow stay, with nulls."""
    names = ["intra_emission", "extra_emission", "intra_reception", "extra_reception"]
    flows = flows.select("com", *[F.col(n).cast("double").alias(n) for n in names])
    if missing_as_zero:
        flows = flows.na.fill(0.0, names)
    members = groups.groupBy("com").agg(F.count("*").alias("members"))
    return members.join(flows, "com", "left").select(
        "com", *names, "members",
        percent(F.col("extra_reception"), F.col("intra_reception")).alias("pct_extra_reception"),
        percent(F.col("extra_emission"), F.col("intra_emission")).alias("pct_extra_emission"),
        ratio(F.col("intra_emission"), F.col("extra_emission")).alias("emission_ratio"),
    )


def inward_groups(kpis: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Number of groups that emit more inside than outside."""
    return kpis.agg(F.count_if(F.col("emission_ratio") > threshold).alias("inward_groups"),
                    F.count("*").alias("groups"))


def pair_sums(arcs: DataFrame, rows: int) -> DataFrame:
    """(src, dst, weight): the amounts between two parties in either direction, added.

    Most pairs occur once, so sums before the shuffle would hold a whole split of the input in memory and make
    it no smaller. The arcs are dealt out by pair first, to as many tasks as about ``rows`` arcs need.
    """
    ends = arcs.select(F.least("emitter", "receiver").alias("src"), F.greatest("emitter", "receiver").alias("dst"), "amount")
    tasks = min(MOST_TASKS, max(1, ceil(rows / ARCS_OF_TASK)))
    return ends.repartition(tasks, "src", "dst").groupBy("src", "dst").agg(F.sum("amount").cast("double").alias("weight"))
