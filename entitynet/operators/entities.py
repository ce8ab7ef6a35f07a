"""Entities, their roles, and the node table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

# Role labels and the node table's one-hot columns.
PERSON, COMPANY, ACCOUNTANT, REPRESENTATIVE = "PERSONA", "SOCIEDAD", "CONTADOR", "REPRESENTANTE"
ROLE_COLUMNS = {"CONTADOR": "CONTADOR", "PERSONA": "NATURAL", "REPRESENTANTE": "REPRESENTANTE", "SOCIEDAD": "SOCIEDAD"}


def _typed(ids: DataFrame, natural: DataFrame) -> DataFrame:
    """PERSONA when the id has a mean value in the natural-person table, else SOCIEDAD."""
    people = natural.groupBy("id").agg(F.avg("value").alias("value"))
    role = F.when(F.col("value").isNull(), COMPANY).otherwise(PERSON)
    return ids.distinct().join(people, "id", "left").select("id", role.alias("role"))


def _ends(layer: DataFrame) -> DataFrame:
    return layer.select(F.explode(F.array("src", "dst")).alias("id"))


def _labelled(layer: DataFrame, end: str, role: str) -> DataFrame:
    return layer.select(F.col(end).alias("id")).distinct().withColumn("role", F.lit(role))


def entity_pool(layers: dict[str, DataFrame], natural: DataFrame) -> DataFrame:
    """Distinct (id, role) over the endpoints of all layers; an id keeps several roles.

    Ids of ownership, accountants' clients and representatives' principals are looked up
    together, so the natural-person table is joined once.
    """
    by_presence = [_ends(layers["ownership"])]
    by_presence += [layers[n].select(F.col("src").alias("id")) for n in ("accountant", "representative") if n in layers]
    parts = [_typed(reduce(DataFrame.unionByName, by_presence), natural)]
    if "family" in layers:
        parts.append(_ends(layers["family"]).distinct().withColumn("role", F.lit(PERSON)))
    if "accountant" in layers:
        parts.append(_labelled(layers["accountant"], "dst", ACCOUNTANT))
    if "representative" in layers:
        parts.append(_labelled(layers["representative"], "dst", REPRESENTATIVE))
    return reduce(DataFrame.unionByName, parts).distinct()


def _fold(labels: DataFrame, role: str) -> DataFrame:
    """``role`` if the id has it, else its alphabetically last label."""
    precedence = [role, *sorted(ROLE_COLUMNS, reverse=True)]
    has = {r: F.bool_or(F.col("role") == r).alias(f"has_{r}") for r in ROLE_COLUMNS}
    kept = F.coalesce(*[F.when(F.col(f"has_{r}"), F.lit(r)) for r in precedence])
    return labels.groupBy("id").agg(*has.values()).select("id", kept.alias("role"))


def resolve_role(layers: dict[str, DataFrame], natural: DataFrame) -> DataFrame:
    """One role per id, in two stages.

    First CONTADOR if the id has it, else the alphabetically last label. Then the labels
    of the representative layer are added and the same is done for REPRESENTANTE, so an
    accountant that is also a represented party loses the first label.
    """
    first = {k: v for k, v in layers.items() if k != "representative"}
    stage_one = _fold(entity_pool(first, natural), ACCOUNTANT)
    represented = _typed(layers["representative"].select(F.col("src").alias("id")), natural)
    reps = _labelled(layers["representative"], "dst", REPRESENTATIVE)
    return _fold(stage_one.unionByName(represented).unionByName(reps), REPRESENTATIVE)


def node_table(pool: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per id and known group: one-hot roles and the initial group."""
    roles = (
        pool.filter(F.col("id").isNotNull()).groupBy("id")
        .pivot("role", list(ROLE_COLUMNS)).agg(F.first(F.lit(1)))
        .na.fill(0)
        .withColumnsRenamed(ROLE_COLUMNS)
    )
    return roles.join(groups.withColumnRenamed("com", "com_inicial"), "id", "left")


def prior_groups(nodes: DataFrame) -> DataFrame:
    """(node, com), one row per node: the smallest of its groups, '0' where none is known; for the JSON export."""
    return nodes.groupBy(F.col("id").alias("node")).agg(F.coalesce(F.min("com_inicial"), F.lit("0")).alias("com"))
