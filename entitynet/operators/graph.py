"""Degrees, samples and subgraphs of an edge table (src, dst, weight), src <= dst."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame, functions as F

from entitynet.functions.ranking import ordered_prefix
from entitynet.session import cut


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree, strength); a self-loop counts twice in both."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"), "weight")
    return ends.groupBy("node").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


def degree_centrality(edges: DataFrame) -> DataFrame:
    """(node, degree, centrality), centrality = degree / (n - 1)."""
    per_node = degrees(edges).select("node", "degree")
    n = per_node.agg(F.count("*").alias("n")).scalar()
    return per_node.withColumn("centrality", F.try_divide(F.col("degree").cast("double"), n - 1))


def top_central(edges: DataFrame, fraction: float = 0.1) -> DataFrame:
    """The floor(n * fraction) most central nodes, ties by id.

    The cut is a fraction of all nodes, so rows are numbered in parallel instead of
    collecting the top in one task.
    """
    ranked = ordered_prefix(degree_centrality(edges), [F.desc("degree"), F.asc("node")], name="position")
    n = ranked.agg(F.count("*").alias("n")).scalar()
    return ranked.filter(F.col("position") < F.floor(n * F.lit(fraction))).drop("position")


def induced_subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in ``nodes``."""
    keep = nodes.select("node")
    return edges.join(keep.withColumnRenamed("node", "src"), "src", "left_semi").join(
        keep.withColumnRenamed("node", "dst"), "dst", "left_semi").select(*edges.columns)


def non_isolated(edges: DataFrame) -> DataFrame:
    """Nodes that still have an edge."""
    return nodes_of(edges)


def seed_membership(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """(node, com): one prior group per node, the smallest of several, '0' when none."""
    prior = groups.groupBy(F.col("id").alias("node")).agg(F.min("com").alias("com"))
    return nodes.select("node").join(prior, "node", "left").select("node", F.coalesce("com", F.lit("0")).alias("com"))


def stratified_sample(edges: DataFrame, fraction: float, by: str = "layer", seed: int = 1) -> DataFrame:
    """About ``fraction`` of the edges of every stratum, chosen by a hash of the pair.

    The choice depends on nothing but the pair and the seed, so it is the same whatever the
    partitioning, and reruns of a lost task agree with the first run.
    """
    key = F.md5(F.concat_ws("|", F.col(by), "src", "dst", F.lit(str(seed))))
    draw = F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint") / F.lit(float(2**32))
    return edges.filter(draw < fraction)


def _draw(seed: int, *columns: str) -> Column:
    """A random place of a row that depends on nothing but its columns and the seed."""
    return F.md5(F.concat_ws("|", *columns, F.lit(str(seed))))


def draw_nodes(edges: DataFrame, roles: DataFrame, fraction: float, seed: int = 1) -> DataFrame:
    """(node, role): nodes for a sample of about ``fraction`` of the edges, every role with its share.

    An edge needs both its ends, so the square root of ``fraction`` of each role's nodes is
    drawn, rounded down: a share is off by less than one node. ``roles`` is (id, role) with one
    row an id; a node without one counts under the empty role. A role is ranked over all
    ranges, so one that holds most nodes is split.
    """
    role = roles.select(F.col("id").alias("node"), "role")
    marked = cut(nodes_of(edges).join(role, "node", "left").select(
        "node", F.coalesce("role", F.lit("")).alias("role"), _draw(seed, "node").alias("draw")))
    ranked = ordered_prefix(marked, [F.col("draw"), F.col("node")], by=["role"], name="position")
    sizes = marked.groupBy("role").agg(F.floor(F.count("*") * F.lit(sqrt(fraction))).alias("quota"))
    return ranked.join(sizes, "role").filter(F.col("position") < F.col("quota")).select("node", "role")


def draw_edges(edges: DataFrame, nodes: DataFrame, by: str = "layer", seed: int = 1) -> DataFrame:
    """The edges between ``nodes``, thinned so that every stratum keeps its share of all edges.

    Of each stratum's edges the same part stays, the largest that all strata still have
    between ``nodes``, rounded down: a share is off by less than one edge. The least frequent
    stratum sets that part; one without an edge between ``nodes`` leaves none. Pairs must be
    distinct within a stratum.
    """
    inside = cut(induced_subgraph(edges, nodes).withColumn("_draw", _draw(seed, by, "src", "dst")))
    count = lambda df, name: df.groupBy(by).agg(F.count("*").alias(name))
    counts = cut(count(edges, "total").join(count(inside, "n"), by, "left").na.fill(0, ["n"]))
    rarest = lambda c: counts.agg(F.min_by(c, F.struct(F.col("n") / F.col("total"), by)).alias(c)).scalar()
    exact = lambda c: c.cast("decimal(19,0)")
    quotas = counts.withColumns({"a": exact(F.col("total")), "b": exact(rarest("n")), "c": exact(rarest("total"))}).select(
        by, F.expr("(a * b) div c").alias("_quota"))
    ranked = ordered_prefix(inside, [F.col("_draw"), F.col("src"), F.col("dst")], by=[by], name="_position")
    return ranked.join(quotas, by).filter(F.col("_position") < F.col("_quota")).select(*edges.columns)


def shares(sample: DataFrame, whole: DataFrame, by: str) -> DataFrame:
    """(name, of_all, of_sample): the share of every value of ``by`` in ``whole`` and in ``sample``."""
    part = lambda df, name: df.groupBy(by).agg(F.count("*").alias(name))
    both = part(whole, "a").join(part(sample, "s"), by, "left").na.fill(0, ["s"])
    part_of = lambda c: F.try_divide(F.col(c), both.agg(F.sum(c).alias(c)).scalar())
    return both.select(F.col(by).alias("name"), part_of("a").alias("of_all"), part_of("s").alias("of_sample"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component), named by its smallest node.

    Alternates two star operations (Kiveris et al. 2014) on edges that point from the
    larger to the smaller node: every neighbour is linked to the smallest one seen. Each
    step is one minimum per node and one join; no neighbour list is ever collected. Nodes
    are numbered in their order first, so the smallest number is the smallest name. Every
    step is written out: both sides of a join on a hub are then plain shuffles, which
    adaptive execution can split. Rounds go on until one changes nothing; their number
    grows with the logarithm of the longest path.
    """
    ids = cut(ordered_prefix(nodes_of(edges), [F.col("node")], name="id"))
    number = lambda end, to: ids.select(F.col("node").alias(end), F.col("id").alias(to))
    ends = edges.filter(F.col("src") != F.col("dst")).select("src", "dst")
    ends = ends.join(number("src", "a"), "src").join(number("dst", "b"), "dst")
    links = cut(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    before, now = None, mark(links)
    while now != before:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = cut(both.join(lowest, "u").filter(F.col("v") > F.col("u")).select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        lowest = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(lowest, "u")
        small = small.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            lowest.select("u", F.col("m").alias("v"))).distinct()
        links = cut(small)
        before, now = now, mark(links)
    found = links.select(F.col("u").alias("id"), F.col("v").alias("root"))
    named = ids.join(found, "id", "left").withColumn("root", F.coalesce("root", "id"))
    return named.join(number("component", "root"), "root").select("node", "component")


def refine_connected(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(node, community): communities split into their connected parts, named by the smallest node."""
    side = lambda end: partition.select(F.col("node").alias(end), F.col("community").alias(f"{end}_c"))
    inside = edges.join(side("src"), "src").join(side("dst"), "dst").filter(F.col("src_c") == F.col("dst_c"))
    parts = connected_components(inside.select("src", "dst"))
    return partition.select("node").join(parts, "node", "left").select(
        "node", F.coalesce("component", "node").alias("community"))
