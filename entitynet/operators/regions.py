"""Sales towards the extreme regions in the north and the south."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from entitynet.functions.scalars import repair_text, yes_no
from entitynet.session import cut

# Four-character region prefixes.
NORTH_PREFIXES = ["XV R", "I RE"]
SOUTH_PREFIXES = ["XI R", "XII "]


def extreme_regions(sales: DataFrame, groups: DataFrame, places: DataFrame, regions: DataFrame,
                    north: list[str] = NORTH_PREFIXES, south: list[str] = SOUTH_PREFIXES) -> DataFrame:
    """(emitter, com, north, south, both): places sold from in each extreme, 'si' when both occur.

    Sales are reduced to distinct (emitter, place) before any join.
    """
    points = sales.select("emitter", "place").distinct()
    members = groups.select(F.col("id").alias("emitter"), "com")
    named = (
        points.join(members, "emitter").join(places, "place").select("emitter", "com", "name").distinct()
        .withColumn("name", repair_text(F.col("name")))
    )
    prefix = F.substring("region", 1, 4)
    flagged = named.join(regions, "name").select(
        "emitter", "com", prefix.isin(*north).cast("int").alias("n"), prefix.isin(*south).cast("int").alias("s"))
    return flagged.groupBy("emitter", "com").agg(F.sum("n").alias("north"), F.sum("s").alias("south")).withColumn(
        "both_ends", yes_no((F.col("north") > 0) & (F.col("south") > 0)))


def extreme_regions_by_group(emitters: DataFrame) -> DataFrame:
    """'si' for a group with at least one such emitter."""
    return emitters.groupBy("com").agg(yes_no(F.bool_or(F.col("both_ends") == "si")).alias("both_ends"))


def extreme_region_counts(emitters: DataFrame) -> DataFrame:
    """Yes and no counts over emitters and over groups."""
    emitters = cut(emitters.select("com", "both_ends"))
    count = lambda df, level: df.groupBy("both_ends").agg(F.count("*").alias("n")).withColumn("level", F.lit(level))
    return count(emitters, "emitter").unionByName(count(extreme_regions_by_group(emitters), "group"))
