"""Relation layers and the edge tables built from them.

A layer is (src, dst, weight). An edge table holds each undirected pair once, with
src <= dst; a self-loop has src = dst.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from entitynet.functions.scalars import share
from entitynet.operators.clean import (
    drop_header_rows, drop_self_loops, keep_types, require, valid_during,
)

# Default layer weights, and the order in which a later layer
# overwrites an earlier one, in the final run and in the sample builder.
DEFAULT_WEIGHTS = {"family": 1.0, "accountant": 0.25, "representative": 1.0}
FINAL_ORDER = ["ownership", "family", "representative", "accountant"]
SAMPLE_ORDER = ["ownership", "accountant", "representative", "family"]


def ownership_layer(df: DataFrame, repeats: bool = False) -> DataFrame:
    """One row per distinct relation.

    With ``repeats`` equal relations stay, for a caller that takes distinct ends or the largest
    weight of a pair: its own aggregation leaves no trace of them, and the rows are shuffled once.
    """
    cols = ["company", "partner", "capital_pct", "profit_pct", "period", "source"]
    rows = require(df.select(*cols), "company", "partner", "capital_pct")
    rows = rows if repeats else rows.distinct()
    return rows.select(F.col("company").alias("src"), F.col("partner").alias("dst"),
                       share(F.col("capital_pct")).alias("weight"))


def family_layer(df: DataFrame, kinds: list[str]) -> DataFrame:
    rows = require(df, "id", "relative", "kind")
    rows = drop_header_rows(rows, "kind", "TIPO_RELACION")
    rows = keep_types(drop_self_loops(rows, "id", "relative"), "kind", kinds)
    return with_weight(rows.select(F.col("id").alias("src"), F.col("relative").alias("dst")).distinct(),
                       DEFAULT_WEIGHTS["family"])


def accountant_layer(df: DataFrame) -> DataFrame:
    rows = require(df, "id", "accountant")
    return with_weight(rows.select(F.col("id").alias("src"), F.col("accountant").alias("dst")),
                       DEFAULT_WEIGHTS["accountant"])


def representative_layer(df: DataFrame, lo: str, hi: str) -> DataFrame:
    rows = valid_during(require(df, "id", "rep"), "start", "end", lo, hi)
    return with_weight(rows.select(F.col("id").alias("src"), F.col("rep").alias("dst")),
                       DEFAULT_WEIGHTS["representative"])


def with_weight(layer: DataFrame, weight: float) -> DataFrame:
    return layer.withColumn("weight", F.lit(weight))


def _pair(df: DataFrame, *more: str) -> DataFrame:
    return df.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), *more)


def build_edges_unweighted(layers: list[DataFrame]) -> DataFrame:
    """Simple graph of one to four layers, every edge of weight 1."""
    ends = [require(layer.select("src", "dst"), "src", "dst") for layer in layers]
    return _pair(reduce(DataFrame.unionByName, ends)).distinct().withColumn("weight", F.lit(1.0))


def _stack(layers: dict[str, DataFrame], order: list[str]) -> DataFrame:
    """All rows of the layers in canonical direction, with their layer, dealt out by pair."""
    parts = [
        layers[name].select("src", "dst", F.col("weight").cast("double").alias("weight"),
                            F.lit(name).alias("layer"))
        for name in order if name in layers
    ]
    rows = _pair(require(reduce(DataFrame.unionByName, parts), "src", "dst", "weight"), "weight", "layer")
    # Hardly a pair repeats within a task: summing before the shuffle would only fill memory, and spill, with large inputs.
    return rows.repartition("src", "dst")


def build_edges(layers: dict[str, DataFrame], order: list[str] = FINAL_ORDER, on_conflict: str = "last") -> DataFrame:
    """Weighted graph of several layers, one row per pair: (src, dst, weight, layer).

    A pair in two layers takes the weight of the later one (``last``), or the ``sum`` or
    ``max`` over its rows; the layer is the last one either way. Inside one layer the
    larger weight wins, so the result does not depend on row order, nor on repeated rows but for
    ``sum``. One number per layer is aggregated, which keeps the aggregation hash-based.
    """
    names = [n for n in order if n in layers]
    per_layer = [F.max(F.when(F.col("layer") == n, F.col("weight"))).alias(f"w_{n}") for n in names]
    rows = _stack(layers, order).groupBy("src", "dst").agg(
        *per_layer, F.sum("weight").alias("sum"), F.max("weight").alias("max"))
    last_first = names[::-1]
    weight = F.coalesce(*[F.col(f"w_{n}") for n in last_first]) if on_conflict == "last" else F.col(on_conflict)
    layer = F.coalesce(*[F.when(F.col(f"w_{n}").isNotNull(), F.lit(n)) for n in last_first])
    return rows.select("src", "dst", weight.alias("weight"), layer.alias("layer"))


def build_flagged_edges(layers: dict[str, DataFrame], order: list[str] = SAMPLE_ORDER) -> DataFrame:
    """Edges with their base weight and one flag per relation layer the pair occurs in.

    The flags make re-weighting an expression, so a search never rebuilds the graph.
    """
    flag = lambda name: F.bool_or(F.col("layer") == name).alias(f"is_{name}")
    names = [n for n in order if n in layers]
    per_layer = [F.max(F.when(F.col("layer") == n, F.col("weight"))).alias(f"w_{n}") for n in names]
    flags = [f"is_{n}" for n in ("family", "representative", "accountant")]
    rows = _stack(layers, order).groupBy("src", "dst").agg(*per_layer, *[flag(f[3:]) for f in flags])
    weight = F.coalesce(*[F.col(f"w_{n}") for n in names[::-1]])
    return rows.select("src", "dst", weight.alias("weight"), *flags)


def relation_weight(family: Column, representative: Column, accountant: Column) -> Column:
    """Weight of a flagged edge: family, then representative, then accountant overwrite the base."""
    return (
        F.when(F.col("is_accountant"), accountant)
        .when(F.col("is_representative"), representative)
        .when(F.col("is_family"), family)
        .otherwise(F.col("weight"))
    )


def reweight(flagged: DataFrame, family: float, representative: float, accountant: float) -> DataFrame:
    weight = relation_weight(F.lit(family), F.lit(representative), F.lit(accountant))
    return flagged.select("src", "dst", weight.alias("weight"))


def edges_of_graph(layer: DataFrame, edges: DataFrame) -> DataFrame:
    """Layer rows that are an edge of the graph in either direction."""
    keyed = layer.withColumns({"_a": F.least("src", "dst"), "_b": F.greatest("src", "dst")})
    ends = edges.select(F.col("src").alias("_a"), F.col("dst").alias("_b"))
    return keyed.join(ends, ["_a", "_b"], "left_semi").drop("_a", "_b")
