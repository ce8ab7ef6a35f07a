"""Community detection by modularity, many trials at a time.

The method is Louvain's (Blondel et al. 2008) in synchronous rounds that never lower
modularity, so none is taken back. In a round every active node names the neighbouring
community that gains most. What simultaneous moves can take from each other is known: two
that enter or leave the same community lose at most the product of their strengths in the null
model, and neighbours of which one enters what the other leaves lose the edge between them;
all else only adds. Proposals are ordered by their gain in parts of the node's strength, and one
goes ahead if it gains more than it can lose to all that are stronger. The strongest
always does, so rounds end only when no node gains, and modularity, which rises with each, bounds
their number. Afterwards the nodes next to a moved one are active, and those whose
proposal had to wait; totals of communities change by what moved.

Neighbours are written once a level, bucketed and sorted by node, so a round brings the
active nodes to the edges and shuffles only the edges of active nodes. While most of the
edges are active, every node's community is brought to its edges instead and sent to the neighbour:
the edges are shuffled once, not twice. What holds for both ends of an edge is found from one of its
two rows. A node of more than ``HUB`` neighbours does not fit a bucket: its edges lie in
a second table, bucketed by neighbour.

All trials (resolutions, or candidates of relation weights) share the nodes' table of
neighbours: a node's row holds an array with its community in each trial, an edge its
kind, and the weight of a kind in a trial is looked up in the trials' parameters. Only graphs of
communities, which differ by trial, have rows by trial. Such a graph is climbed like the
nodes' as long as it has more than ``SMALL`` rows in a trial; one of fewer is a group of bounded size,
and one task takes it to the top.

A graph of at most ``WHOLE`` times ``SMALL`` edges fits a task, by its nodes in memory and its edges in files: the trials are dealt out to tasks, and
each runs the same rounds, move by move, on its own copy (``louvain_arrays``). Larger ones go by the tables.

Weights are turned into whole numbers once, so every sum is exact and no result depends
on the order of summation. Only per-trial sums reach the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction
from functools import reduce
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from entitynet.functions.ranking import ordered_prefix
from entitynet.operators import louvain_arrays as arrays
from entitynet.operators.graph import nodes_of, refine_connected
from entitynet.session import cut, release, scratch

#: Bits of the largest total weight as a whole number; a smaller positive weight than one unit counts as one.
WEIGHT_BITS = 57
#: Least gain of a move, in parts of the node's own strength: above what rounding can feign.
LEAST_GAIN = 1e-12
#: Rows of a bucket of the neighbour table, and neighbours beyond which a node is a hub.
BUCKET, HUB = 250_000, 1_000_000
#: Steps of strength in a doubling.
STEPS = 4
#: A first pass over nodes goes on to communities when a round gains less than this part of the total weight.
PATIENCE = 2e-2
#: Rows of a trial's graph of communities that one task takes to the top.
SMALL = 1_000_000
#: Edges and nodes of a graph that one task holds, in multiples of ``SMALL``.
WHOLE, WHOLE_NODES = 60, 12
#: Share of the strength that is active above which the nodes' communities are sent along all edges.
DENSE = 0.5
#: Active rows (a node in a trial) that are sent to all tasks.
FEW = 1_000_000
#: Bits of a node's number; a community's number has its trial above them.
NODE_BITS = 40

#: Rows of a batch that a task returns.
ROWS = 100_000

#: Kinds of edges: the own weight of an edge, or the trial's weight of a relation.
KINDS = ("family", "representative", "accountant")


def _by_trial(values: dict[int, float], kind: str) -> Column:
    return F.create_map(*[F.lit(x) for t, v in values.items() for x in (t, v)])[F.col("trial")].cast(kind)


def number_nodes(edges: DataFrame) -> DataFrame:
    """(node, id): nodes numbered in their own order, so the smallest number is the smallest name."""
    return ordered_prefix(nodes_of(edges), [F.col("node")], name="id")


def numbered_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(src, dst, kind, weight) by number; repeated pairs of one kind are added."""
    side = lambda end: ids.select(F.col("node").alias(end), F.col("id").alias(f"{end}_id"))
    kind = F.lit(0)
    for n, name in enumerate(KINDS, 1):
        if f"is_{name}" in edges.columns:
            kind = F.when(F.col(f"is_{name}"), n).otherwise(kind)
    ends = edges.withColumn("kind", kind).join(side("src"), "src").join(side("dst"), "dst")
    return ends.groupBy(F.least("src_id", "dst_id").alias("src"), F.greatest("src_id", "dst_id").alias("dst"), "kind").agg(
        F.sum("weight").alias("weight"), F.count("*").alias("times"))


@dataclass
class Trials:
    """Resolutions by trial, and for each trial the weights of the relation kinds (none: edges keep their own)."""

    gammas: dict[int, float]
    weights: dict[int, tuple[float, ...]] | None = None
    unit: float = 1.0
    #: resolution / total strength of each trial
    pull: dict[int, float] = field(default_factory=dict)
    #: the nodes are communities, each of one trial
    of_communities: bool = False

    def of(self, some: set[int], communities: bool = False) -> Trials:
        """These trials only; of ``communities``: their edges have their own weights."""
        return Trials({t: self.gammas[t] for t in some}, None if communities else self.weights, self.unit, self.pull, communities)

    @property
    def once(self) -> bool:
        """A node has a row in one trial only."""
        return self.of_communities or len(self.gammas) == 1

    def kind_weight(self, trial: int, kind: int) -> int:
        weight = self.weights[trial][kind - 1]
        return max(1, round(weight * self.unit)) if weight > 0 else 0

    def weight(self, trial: Column) -> Column:
        """An edge's whole weight in ``trial``, from its kind and its own whole weight."""
        if self.weights is None:
            return F.col("weight")
        table = lambda kind: F.create_map(*[F.lit(x).cast("bigint") for t in self.weights for x in (t, self.kind_weight(t, kind))])
        by_kind = [(kind, table(kind)[trial.cast("bigint")] * F.col("times")) for kind in range(1, len(KINDS) + 1)]
        return reduce(lambda rest, x: F.when(F.col("kind") == x[0], x[1]).otherwise(rest), by_kind, F.col("weight"))


def whole(edges: DataFrame, trials: Trials) -> DataFrame:
    """Edges with BIGINT weights: units of the power of two that fits the largest total."""
    sums = edges.groupBy("kind").agg(F.sum("weight").alias("w"), F.sum("times").alias("n")).collect()
    if trials.weights is None:
        most = sum((r["w"] or 0.0) for r in sums)
    else:
        most = max((sum((r["w"] or 0.0) if r["kind"] == 0 else r["n"] * w[r["kind"] - 1] for r in sums) for w in trials.weights.values()), default=0.0)
    trials.unit = 2.0 ** (WEIGHT_BITS - Fraction(most or 1.0).__ceil__().bit_length())
    units = F.greatest(F.lit(1).cast("bigint"), F.round(F.col("weight") * trials.unit).cast("bigint"))
    return edges.withColumn("weight", F.when(F.col("weight") > 0, units).otherwise(F.lit(0).cast("bigint")))


def strengths(edges: DataFrame, trials: Trials) -> DataFrame:
    """(node, trial, k) from sums by node and kind: the edges are not multiplied by the trials."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"), "kind", "weight", "times")
    sums = ends.groupBy("node").agg(*[
        F.sum(F.when(F.col("kind") == kind, F.col("times" if kind and trials.weights else "weight")).otherwise(F.lit(0).cast("bigint"))).alias(f"s{kind}")
        for kind in range(len(KINDS) + 1)])
    each = sums.withColumn("trial", F.explode(F.array(*[F.lit(t) for t in trials.gammas])))
    part = lambda kind: F.col(f"s{kind}") * (_by_trial({t: trials.kind_weight(t, kind) for t in trials.gammas}, "bigint") if kind and trials.weights else 1)
    k = reduce(Column.__add__, [part(kind) for kind in range(len(KINDS) + 1)])
    return each.select("node", "trial", k.alias("k"))


@dataclass
class Neighbours:
    """(node, near, kind, weight, times) of every edge both ways, without loops, in one or two bucketed tables."""

    tables: list[str] = field(default_factory=list)
    read: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        for name, df in zip(self.tables, self.read):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
            release(df)


def stored(both: DataFrame, hub: int | None = None) -> Neighbours:
    """Write the neighbour table: bucketed by node; the rows of hubs, if there are any, by neighbour."""
    hub = hub or HUB
    spark = both.sparkSession
    found = Neighbours()
    rows = both.count()
    hubs = cut(both.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") > hub).select("node"))
    parts = [(both, "node")] if hubs.isEmpty() else [
        (both.join(hubs, "node", "left_anti"), "node"), (both.join(hubs, "node", "left_semi"), "near")]
    for df, key in parts:
        name, path = f"near_{uuid.uuid4().hex}", scratch(spark)
        buckets = max(1, ceil(rows / BUCKET))
        df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
        table = spark.table(name)
        table._cut_path = path
        found.tables.append(name)
        found.read.append(table)
    release(hubs)
    return found


def both_ways(edges: DataFrame) -> DataFrame:
    ways = F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("near")), F.struct(F.col("dst").alias("node"), F.col("src").alias("near")))
    return edges.filter(F.col("src") != F.col("dst")).select(F.explode(ways).alias("w"), "kind", "weight", "times").select("w.*", "kind", "weight", "times")


def gathered(rows: DataFrame, once: bool, name: str, *cols: str) -> DataFrame:
    """(node, ``name``): the node's rows as an array of structs; with ``once`` a node has one row, and nothing is shuffled."""
    row = F.struct(*cols)
    return rows.select("node", F.array(row).alias(name)) if once else rows.groupBy("node").agg(F.collect_list(row).alias(name))


def rows_by_node(flat: DataFrame, totals: DataFrame, once: bool = False) -> DataFrame:
    """(node, at): a node's community, its total and size, the node's strength, and whether it is active, by trial.

    ``flat`` is (node, trial, com, k, on), ``totals`` (com, tot, size).
    """
    return cut(gathered(flat.join(totals, "com"), once, "at", "trial", "com", "tot", "size", "k", "on"))


def one_of(rows: Column, once: bool) -> Column:
    """A row of the array for each of its structs; with ``once`` its only one, and no row is made."""
    return F.get(rows, F.lit(0)) if once else F.explode(rows)


def seen_from(near: Neighbours, state: DataFrame, trials: Trials) -> list[DataFrame]:
    """(node, trial, com, tot, size, weight): the neighbours' communities of active nodes, from each table.

    With most of the strength active, or few nodes, a row of the table is read from its other end: the bucketed
    rows meet that end's community where they are. Few active nodes pick their rows before; of
    many, the rows of inactive ones fall away where the candidates meet their own row.
    """
    mine = state.filter(F.exists("at", lambda x: x["on"])).select(
        "node", F.transform(F.filter("at", lambda x: x["on"]), lambda x: x["trial"]).alias("mine"))
    at = F.transform("at", lambda x: F.struct(x["trial"], x["com"], x["tot"], x["size"])).alias("at")
    among = F.col("at") if trials.once else F.filter("at", lambda x: F.array_contains("mine", x["trial"]))
    of = lambda rows, end, at: rows.select(F.col(end).alias("node"), "kind", "weight", "times", one_of(at, trials.once).alias("x")).select(
        "node", "x.trial", "x.com", "x.tot", "x.size", trials.weight(F.col("x.trial")).alias("weight"))
    if len(near.read) == 1:
        [table], theirs = near.read, state.select("node", at)
        strength = F.col("k").cast("double")
        active, every, rows = state.select(F.inline("at")).agg(
            F.sum(F.when(F.col("on"), strength)), F.sum(strength), F.count_if("on")).first()
        if (active or 0.0) > DENSE * (every or 0.0):
            return [of(table.join(theirs, "node"), "near", F.col("at"))]
        if rows <= FEW:
            return [of(table.join(F.broadcast(mine.withColumnRenamed("node", "near")), "near").join(theirs, "node"), "near", among)]
    theirs = state.select(F.col("node").alias("near"), at)
    return [of(table.join(mine, "node").join(theirs, "near"), "node", among) for table in near.read]


def best_moves(near: Neighbours, state: DataFrame, trials: Trials) -> DataFrame:
    """Every active node's best move: (node, trial, com, k, kin, tot, to, gain); ``to`` is null where none gains.

    ``state`` is a written table of ``rows_by_node``. A node alone joins another node alone
    only downwards; of equal gains the smaller community's number wins. The nodes meet
    the bucketed edges, as ``seen_from`` says. What leaves that join is dealt
    out by node and trial once, so candidates are summed, meet the node's own row, and are compared
    where they are. The rows of hubs are summed per (node, trial, community) before, so a hub
    sends one row per community next to it.
    """
    summed = lambda rows: rows.groupBy("node", "trial", "com").agg(F.sum("weight").alias("weight"), *[F.max(c).alias(c) for c in ("tot", "size")])
    seen = [summed(rows) if n else rows for n, rows in enumerate(seen_from(near, state, trials))]
    active = state.select("node", F.inline("at")).filter("on")
    itself = active.select("node", "trial", "com", "tot", "size", F.lit(0).cast("bigint").alias("weight"))
    own = active.select("node", "trial", F.col("com").alias("own"), "k", F.col("size").alias("own_size"))
    options = summed(reduce(DataFrame.unionByName, [*seen, itself]).repartition("node", "trial")).withColumnRenamed("weight", "kin").join(
        own, ["node", "trial"])
    here = F.col("com") == F.col("own")
    pull = _by_trial(trials.pull, "double") * F.col("k")
    worth = F.col("kin") - pull * (F.col("tot") - F.when(here, F.col("k")).otherwise(F.lit(0).cast("bigint")))
    allowed = ~here & ((F.col("size") > 1) | (F.col("own_size") > 1) | (F.col("com") < F.col("own")))
    per_node = options.withColumn("worth", worth).groupBy("node", "trial").agg(
        F.max("own").alias("com"), F.max("k").alias("k"), *[F.max(F.when(here, F.col(c))).alias(c) for c in ("kin", "tot", "worth")],
        F.max(F.when(allowed, F.struct("worth", (-F.col("com")).alias("com")))).alias("best"))
    gain = F.col("best.worth") - F.col("worth")
    gains = gain > LEAST_GAIN * F.col("k")
    return per_node.select("node", "trial", "com", "k", "kin", "tot", F.when(gains, -F.col("best.com")).alias("to"), F.when(gains, gain).alias("gain"))


def compatible(near: Neighbours, proposed: DataFrame, trials: Trials) -> DataFrame:
    """The proposals (node, trial, com, k, to, gain) that go ahead together without lowering modularity.

    Per community and step of strength the proposals are one row, so a community that half
    of all nodes want to join is neither gathered nor sorted; those of the same step count as stronger.
    An edge between two proposals that clash costs the weaker of its ends, so one of its two rows is enough.
    """
    strength = F.col("gain") / F.col("k")
    proposed = proposed.withColumns({"strength": strength, "step": F.floor(F.log2(strength) * STEPS)})
    rank = F.struct("strength", (-F.col("node")).alias("node"))
    sides = proposed.select("k", "strength", "step", "node", F.explode(F.array(
        F.struct(F.col("com").alias("at"), F.lit(True).alias("leaves")), F.struct(F.col("to").alias("at"), F.lit(False).alias("leaves")))).alias("side"))
    steps = sides.groupBy("side.at", "side.leaves", "step").agg(F.sum("k").alias("sum"), F.max(rank).alias("first"))
    every = Window.partitionBy("at", "leaves")
    steps = steps.select("at", "leaves", "step", F.sum("sum").over(every.orderBy(F.desc("step"))).alias("sum"), (-F.max("first").over(every)["node"]).alias("first"))
    gone, come = (steps.filter(side).select(F.col("at").alias(at), "step", F.col("sum").alias(name), F.col("first").alias(f"{name}_first"))
                  for side, at, name in (("leaves", "com", "gone"), ("not leaves", "to", "come")))
    of = gathered(proposed, trials.once, "of", "trial", "com", "to", "strength")
    clashes = []
    for table in near.read:
        pairs = table.filter("node < near").join(of, "node").join(of.select(F.col("node").alias("near"), F.col("of").alias("others")), "near").select(
            "node", "near", "kind", "weight", "times", one_of(F.col("of"), trials.once).alias("x"), "others")
        clash = lambda y: (y["trial"] == F.col("x.trial")) & ((y["com"] == F.col("x.to")) | (y["to"] == F.col("x.com")))
        if trials.once:
            pairs = pairs.withColumn("y", one_of(F.col("others"), True)).filter(clash(F.col("y")))
        else:
            pairs = pairs.withColumn("y", F.explode(F.filter("others", clash)))
        stronger = (F.col("y.strength") > F.col("x.strength")) | ((F.col("y.strength") == F.col("x.strength")) & (F.col("near") < F.col("node")))
        both = (F.col("y.com") == F.col("x.to")) & (F.col("y.to") == F.col("x.com"))
        clashes.append(pairs.select(F.when(stronger, F.col("node")).otherwise(F.col("near")).alias("node"), "x.trial",
                                    (trials.weight(F.col("x.trial")) * F.when(both, 2).otherwise(1)).alias("lost")))
    lost = reduce(DataFrame.unionByName, clashes).groupBy("node", "trial").agg(F.sum("lost").alias("lost"))
    all_of = proposed.join(gone, ["com", "step"]).join(come, ["to", "step"]).join(lost, ["node", "trial"], "left")
    others = _by_trial(trials.pull, "double") * (F.col("gone") + F.col("come") - 2 * F.col("k"))
    strongest = F.col("lost").isNull() & (F.col("gone_first") == F.col("node")) & (F.col("come_first") == F.col("node"))
    goes = (F.col("gain") > others * F.col("k") + F.coalesce("lost", F.lit(0).cast("bigint"))) | strongest
    return all_of.filter(goes).select("node", "trial", "com", "k", "to", "gain")


def settle(near: Neighbours, state: DataFrame, totals: DataFrame, trials: Trials, patience: float, again: bool) -> tuple[DataFrame, DataFrame, set[int]]:
    """Rounds until no active node gains: the state and totals after them, and the trials that changed.

    A trial stops early when a round gains less than ``patience`` of its total weight. With
    ``again`` all its nodes are tried once more, until a round over all of them moves none.
    The tables given are released once they are replaced.
    """
    changed: set[int] = set()
    running = complete = set(trials.gammas)
    while running:
        proposed = cut(best_moves(near, state, trials).filter(F.col("to").isNotNull()).select("node", "trial", "com", "k", "to", "gain"))
        moved = cut(compatible(near, proposed, trials))
        gained = {r["trial"]: r["gain"] for r in moved.groupBy("trial").agg(F.sum(F.floor("gain")).alias("gain")).collect()}
        changed |= set(gained)
        active = {t for t in running & set(gained) if gained[t] * trials.pull[t] >= patience * trials.gammas[t]}
        complete = running - set(gained) - complete if again else set()
        running = active | complete
        if gained:
            signed = lambda at, sign: moved.select(F.col(at).alias("com"), (sign * F.col("k")).alias("tot"), F.lit(sign).cast("bigint").alias("size"))
            before, totals = totals, cut(totals.unionByName(signed("com", -1)).unionByName(signed("to", 1)).groupBy("com").agg(
                F.sum("tot").alias("tot"), F.sum("size").alias("size")).filter("size > 0"))
            release(before)
        if gained or running:
            among = lambda some: F.col("trial").isin(*some) if some else F.lit(False)
            awake = []
            if active:  # the other trials end here, or go on with all nodes
                went = gathered(moved.filter(among(active)), trials.once, "went", "trial")
                stirred = [t.join(went, "node").select(F.col("near").alias("node"), one_of(F.col("went.trial"), trials.once).alias("trial")) for t in near.read]
                awake = [x.select("node", "trial", F.lit(None).cast("bigint").alias("to")) for x in [proposed.filter(among(active)), *stirred]]
            woken = reduce(DataFrame.unionByName, [moved.select("node", "trial", "to"), *awake]).groupBy("node", "trial").agg(
                F.max("to").alias("to"), F.first(F.lit(True)).alias("woken"))
            on = (among(active) & F.col("woken").isNotNull()) | among(complete)
            flat = state.select("node", F.inline("at")).select("node", "trial", "com", "k").join(woken, ["node", "trial"], "left")
            before, state = state, rows_by_node(flat.select("node", "trial", F.coalesce("to", "com").alias("com"), "k", on.alias("on")), totals, trials.once)
            release(before)
        release(proposed)
        release(moved)
    return state, totals, changed


def communities_graph(near: Neighbours, state: DataFrame, trials: Trials) -> DataFrame:
    """The neighbour rows of the graphs whose nodes are the communities; an edge is counted from one of its two rows."""
    some = F.filter("at", lambda x: x["trial"].isin(*trials.gammas))
    own = state.select("node", F.map_from_entries(F.transform(some, lambda x: F.struct(x["trial"], x["com"]))).alias("mine"))
    theirs = state.select(F.col("node").alias("near"), some.alias("theirs"))
    ends = lambda end: end(F.col("mine")[F.col("x.trial")], F.col("x.com"))
    rows = reduce(DataFrame.unionByName, [
        t.filter("node < near").join(own, "node").join(theirs, "near").withColumn("x", F.explode("theirs")).select(
            ends(F.least).alias("src"), ends(F.greatest).alias("dst"), trials.weight(F.col("x.trial")).alias("weight"))
        for t in near.read])
    between = rows.filter(F.col("src") != F.col("dst")).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    return both_ways(between.withColumns({"kind": F.lit(0), "times": F.lit(1).cast("bigint")}))


def to_the_top(edges: pd.DataFrame, nodes: pd.DataFrame, pull: float) -> pd.DataFrame:
    """(com, top) for one small graph (node, near, weight; com, k): node by node to a local optimum, then its communities, until none merges."""
    names = nodes["com"].sort_values().to_numpy()
    k = nodes.set_index("com")["k"].loc[names].to_numpy()
    at = pd.Index(names)
    a, b, w = at.get_indexer(edges["node"]), at.get_indexer(edges["near"]), edges["weight"].to_numpy()
    top = np.arange(len(names))
    while True:
        order = np.argsort(a, kind="stable")
        ends = np.searchsorted(a[order], np.arange(len(k) + 1)).tolist()
        near, weight, strength = b[order].tolist(), w[order].tolist(), k.tolist()
        com, total = list(range(len(k))), k.tolist()
        waiting = list(range(len(k)))
        while waiting:
            moved = set()
            for v in waiting:
                kin: dict[int, int] = {}
                for u, x in zip(near[ends[v]:ends[v + 1]], weight[ends[v]:ends[v + 1]]):
                    kin[com[u]] = kin.get(com[u], 0) + x
                own, each = com[v], pull * strength[v]
                stays = kin.pop(own, 0) - each * (total[own] - strength[v])
                gain, to = max(((x - each * total[c], -c) for c, x in kin.items()), default=(stays, 0))
                if gain > stays + LEAST_GAIN * strength[v]:
                    total[own] -= strength[v]
                    total[-to] += strength[v]
                    com[v] = -to
                    moved.update(near[ends[v]:ends[v + 1]], (v,))
            # Totals have changed for all, so a quiet end is checked by a round over all nodes.
            waiting = sorted(moved) or (list(range(len(k))) if len(waiting) < len(k) else [])
        kept, inverse = np.unique(com, return_inverse=True)
        if len(kept) == len(k):
            return pd.DataFrame({"com": names, "top": names[np.unique(top, return_index=True)[1]][top]})
        top = inverse[top]
        k = pd.Series(k).groupby(inverse).sum().to_numpy()
        merged = pd.DataFrame({"a": inverse[a], "b": inverse[b], "w": w}).query("a != b").groupby(["a", "b"])["w"].sum().reset_index()
        a, b, w = (merged[c].to_numpy() for c in "abw")


def top_of(g: arrays.Graph, k: np.ndarray, pull: float) -> np.ndarray:
    """``to_the_top`` of a graph of communities 0 to n - 1."""
    edges = pd.DataFrame({"node": np.repeat(np.arange(len(k)), np.diff(g.ends)), "near": g.near, "weight": g.value})
    return to_the_top(edges, pd.DataFrame({"com": np.arange(len(k)), "k": k}), pull)["top"].to_numpy()


def in_tasks(base: DataFrame, trials: Trials, given: DataFrame | None = None) -> DataFrame:
    """(trial, node, name) by trials dealt out to tasks, each of which holds the graph; name is the community's smallest node.

    ``base`` is (src, dst, kind, weight, times) with whole weights; ``given`` is (trial, node, first), the start by
    the smallest node of each community. Only the edges travel, once to each task.
    """
    order = list(trials.gammas)
    tasks = max(1, min(len(order), base.sparkSession.sparkContext.defaultParallelism))
    kind = F.col("kind") if trials.weights else F.lit(0)
    rows = base.select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), "src", "dst", kind.cast("tinyint").alias("kind"),
                       F.when(kind == 0, F.col("weight")).otherwise(F.col("times")).alias("value"))
    if given is not None:
        of = _by_trial({t: n % tasks for n, t in enumerate(order)}, "int")
        rows = rows.unionByName(given.select(of.alias("task"), F.col("node").alias("src"), F.col("first").alias("dst"),
                                             F.lit(-1).cast("tinyint").alias("kind"), F.col("trial").cast("bigint").alias("value")))
    patience, small = PATIENCE, SMALL

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, seeds, mine, n = arrays.Edges(bool(trials.weights)), [], None, 0
        for batch in batches:
            task, src, dst, kind, value = (batch.column(c).to_numpy() for c in ("task", "src", "dst", "kind", "value"))
            if not len(task):
                continue
            mine, n = order[int(task[0])::tasks], max(n, int(src.max()) + 1, int(dst.max()) + 1)
            edge = kind >= 0
            edges.append(src[edge], dst[edge], *([kind[edge]] if trials.weights else []), value[edge])
            if not edge.all():
                seeds.append((value[~edge], src[~edge], dst[~edge]))
        if mine is None:
            return
        there = np.zeros(n, bool)
        for src, dst, *_ in edges.pieces():
            there[src] = there[dst] = True
        g, every, k = arrays.graph(edges, n), np.flatnonzero(there), None
        for t in mine:
            if trials.weights:
                g.factor = np.array([1, *[trials.kind_weight(t, of) for of in range(1, len(KINDS) + 1)]], np.int64)
            if trials.weights or k is None:
                k = arrays.strengths(edges, n, g.factor)
            com, m2 = np.arange(n, dtype=np.int32), int(k.sum())
            for trial, node, first in seeds:
                com[node[trial == t]] = first[trial == t]
            com = arrays.trial(g, com, k, there, trials.gammas[t], trials.gammas[t] / m2 if m2 else 0.0, patience, small, top_of, LEAST_GAIN, STEPS)
            least = np.full(n, n, np.int64)
            np.minimum.at(least, com[every], every)
            for some in range(0, len(every), ROWS):
                node = every[some:some + ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), t, np.int32)), pa.array(node), pa.array(least[com[node]])], ["trial", "node", "name"])

    return rows.repartitionById(tasks, F.col("task")).mapInArrow(run, "trial int, node bigint, name bigint")


def climb(near: Neighbours, state: DataFrame, totals: DataFrame, trials: Trials, patience: float) -> tuple[DataFrame, set[int]]:
    """Communities become nodes, again and again: (com, top) of each, and the trials in which some merged."""
    rising, merged, lower, top = set(trials.gammas), set(), near, None
    trial = F.shiftright("com", NODE_BITS).cast("int").alias("trial")
    while rising:
        rows = cut(communities_graph(lower, state, trials.of(rising, lower is not near)))
        if lower is not near:
            lower.release()
        nodes = cut(totals.select("com", trial, F.col("tot").alias("k")).filter(F.col("trial").isin(*rising)))
        of = F.shiftright("node", NODE_BITS).cast("int").alias("trial")
        sizes = {r["trial"]: r["n"] for r in rows.groupBy(of).agg(F.count("*").alias("n")).collect()}
        small = {t for t in rising if sizes.get(t, 0) <= SMALL}
        steps = []
        if small:
            pull = dict(trials.pull)
            steps.append(cut(rows.select("node", "near", "weight", of).filter(F.col("trial").isin(*small)).groupBy("trial").cogroup(
                nodes.filter(F.col("trial").isin(*small)).groupBy("trial")).applyInPandas(
                    lambda key, edges, own: to_the_top(edges, own, pull[key[0]]), "com bigint, top bigint")))
            merged |= {r["trial"] for r in steps[0].filter("com <> top").select(trial).distinct().collect()}
        rising -= small
        if rising:
            lower = stored(rows.filter(F.shiftright("node", NODE_BITS).isin(*rising)))
            flat = nodes.filter(F.col("trial").isin(*rising)).select(F.col("com").alias("node"), "trial", "com", "k", F.lit(True).alias("on"))
            sums = cut(flat.select("com", F.col("k").alias("tot"), F.lit(1).cast("bigint").alias("size")))
            state, totals, rising = settle(lower, rows_by_node(flat, sums, True), sums, trials.of(rising, True), patience, False)
            steps.append(state.select(F.col("node").alias("com"), F.col("at")[0]["com"].alias("top")))
            merged |= rising
        step = reduce(DataFrame.unionByName, steps)
        if top is None:
            top = cut(step)
        else:
            up = step.select(F.col("com").alias("top"), F.col("top").alias("next"))
            top = cut(top.join(up, "top", "left").select("com", F.coalesce("next", "top").alias("top")))
    if lower is not near:
        lower.release()
    return top, merged


def louvain_trials(edges: DataFrame, gammas: dict[int, float], initial: DataFrame | None = None,
                   weights: dict[int, tuple[float, ...]] | None = None, numbers: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(trial, node, community) for edges (src, dst, weight); resolution per trial in ``gammas``.

    Resolution scales the null-model term: at 0 the communities are the connected
    components over positive weights. With ``weights`` (family, representative, accountant by
    trial) the edges are flagged ones, and a relation's weight replaces the edge's own.
    ``initial`` (trial, node, community) seeds the first pass. A community is named by its
    smallest node. No node, and no community as a whole, can gain by moving from the result.
    ``numbers`` is ``numbered(edges)``, for callers that have many runs on the same edges.
    """
    ids, pairs = numbers or numbered(edges)
    trials = Trials(gammas, weights)
    base = whole(pairs, trials)
    within = pairs.count() <= WHOLE * SMALL and ids.count() <= WHOLE_NODES * SMALL
    given = None if initial is None else cut(started(initial, ids))
    if within:
        return named(cut(in_tasks(base, trials, given)), ids)
    near, nodes = neighbours(cut(base), trials)
    tagged = lambda number: F.shiftleft(F.col("trial").cast("bigint"), NODE_BITS) + F.col(number)
    com = tagged("node")
    if given is not None:
        nodes = nodes.join(given, ["trial", "node"], "left")
        com = F.coalesce(tagged("first"), com)

    def placed(flat: DataFrame, of: Trials) -> tuple[DataFrame, DataFrame]:
        totals = cut(flat.groupBy("com").agg(F.sum("k").alias("tot"), F.count("*").alias("size")))
        return rows_by_node(flat, totals, of.once), totals

    state, totals, changed = settle(near, *placed(nodes.select("node", "trial", com.alias("com"), "k", F.lit(True).alias("on")), trials), trials, PATIENCE, False)
    finished, left, patience = [], set(gammas), PATIENCE
    settled = left - changed
    while left:
        top, merged = climb(near, state, totals, trials.of(left), patience)
        flat = cut(state.select("node", F.inline("at")).join(top, "com").select("node", "trial", F.col("top").alias("com"), "k", F.lit(True).alias("on")))
        done = (left - merged) & settled
        if done:
            finished.append(cut(flat.filter(F.col("trial").isin(*done)).select("trial", "node", "com")))
        left -= done
        if left:
            release(state)
            release(totals)
            state, totals, _ = settle(near, *placed(flat.filter(F.col("trial").isin(*left)), trials.of(left)), trials.of(left), 0.0, True)
        settled, patience = set(left), 0.0
        release(flat)
    near.release()
    partition = reduce(DataFrame.unionByName, finished)
    names = cut(partition.groupBy("com").agg(F.min("node").alias("name")))
    return named(partition.join(names, "com"), ids)


def named(found: DataFrame, ids: DataFrame) -> DataFrame:
    """(trial, node, community) of (trial, node, name) by number."""
    return (found.join(ids.select(F.col("id").alias("node"), F.col("node").alias("member")), "node")
            .join(ids.select(F.col("id").alias("name"), F.col("node").alias("community")), "name")
            .select("trial", F.col("member").alias("node"), "community"))


def started(initial: DataFrame, ids: DataFrame) -> DataFrame:
    """(trial, node, first) of a start (trial, node, community): the smallest node of each one's community."""
    given = initial.join(ids, "node").select("trial", "community", F.col("id").alias("node"))
    names = cut(given.groupBy("trial", "community").agg(F.min("node").alias("first")))
    first = F.when(F.count("*") == 1, F.min("first")).otherwise(F.raise_error(F.lit("a node is in two communities of the start")).cast("bigint"))
    return given.join(names, ["trial", "community"]).groupBy("trial", "node").agg(first.alias("first"))


def numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbers of the nodes, and the edges by number."""
    ids = cut(number_nodes(edges))
    return ids, cut(numbered_edges(edges, ids))


def neighbours(base: DataFrame, trials: Trials) -> tuple[Neighbours, DataFrame]:
    """The neighbour table and (node, trial, k); sets the trials' pull."""
    nodes = cut(strengths(base, trials))
    m2 = {r["trial"]: r["m2"] for r in nodes.groupBy("trial").agg(F.sum("k").alias("m2")).collect()}
    trials.pull = {t: g / m2[t] if m2.get(t) else 0.0 for t, g in trials.gammas.items()}
    return stored(both_ways(base)), nodes


def prepared(edges: DataFrame, gammas: dict[int, float], weights: dict[int, tuple[float, ...]] | None = None) -> tuple[DataFrame, Neighbours, DataFrame, Trials]:
    """Numbers of the nodes, the neighbour table, (node, trial, k), and the trials with their units."""
    ids, pairs = numbered(edges)
    trials = Trials(gammas, weights)
    near, nodes = neighbours(cut(whole(pairs, trials)), trials)
    return ids, near, nodes, trials


def louvain(edges: DataFrame, resolution: float = 1.0, initial: DataFrame | None = None) -> DataFrame:
    """(node, community) of one graph; ``initial`` is (node, community)."""
    start = None if initial is None else initial.withColumn("trial", F.lit(0))
    return louvain_trials(edges.select("src", "dst", "weight"), {0: resolution}, start).drop("trial")


def climb_connected(edges: DataFrame, resolution: float, found: DataFrame) -> DataFrame:
    """(node, community): ``found`` split into connected parts and climbed again, until all communities are connected.

    A community that falls into parts is split: no edge inside is lost and the null model's
    term gets smaller, so modularity rises, and from the parts the climb can only add to
    it. Each round therefore ends higher than the one before, and the rounds end.
    """
    count = lambda df: df.agg(F.count_distinct("community").alias("n")).first()["n"]
    own = None
    while True:
        parts = cut(refine_connected(edges, found))
        whole = count(parts) == count(found)
        if own is not None:
            release(own)
        if whole:
            return parts
        found = own = cut(louvain(edges, resolution, parts))
        release(parts)


def louvain_connected(edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(node, community) of one graph, as ``louvain``, but with every community connected."""
    return climb_connected(edges, resolution, cut(louvain(edges, resolution)))


def resolution_sweep(edges: DataFrame, resolutions: list[float]) -> DataFrame:
    """(resolution, node, community) for a whole grid of resolutions in one run."""
    found = louvain_trials(edges.select("src", "dst", "weight"), dict(enumerate(resolutions)))
    values = F.array(*[F.lit(float(r)) for r in resolutions])
    return found.select(F.element_at(values, F.col("trial") + 1).alias("resolution"), "node", "community")
