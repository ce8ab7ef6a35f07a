"""Registered queries: each runs one operator over the input views of a data directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from entitynet.operators import (
    clean, entities, flows, graph, layers, louvain, partition, profiles, propagation, regions, stats, tuning, workers,
)
from entitynet.session import cut, scratch
from entitynet.sources import io
from entitynet.sources.inputs import FAMILY_KINDS, NORTH, PERIODS, SOUTH, WINDOW, Inputs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Settings of the registered runs.
MEASURES = ["income", "tax", "zone"]
RESOLUTIONS = [step / 10 for step in range(11)]
SAMPLE = 0.1
# Published weights of family, representative and accountant.
WEIGHTS = (0.869142, 0.50927, 0.596811)
TRIALS = [(1.0, 1.0, 0.25, 0.2), (0.8, 0.5, 0.6, 0.1), (0.3, 0.9, 0.5, 0.4)]

_shared: dict[tuple, DataFrame] = {}


def query(run: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    QUERIES[run.__name__] = lambda spark, sf_dir: run(Inputs(spark, sf_dir))
    return run


def shared(build: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    """Written once per application and directory, then read by every query that needs it."""
    def get(i: Inputs) -> DataFrame:
        key = (build.__name__, i.spark.sparkContext.applicationId, i.sf_dir)
        if key not in _shared:
            _shared[key] = cut(build(i))
        return _shared[key]
    return get


def schema_of(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def r6(name: str):
    return F.round(F.col(name), 6).alias(name)


def r10(name: str):
    return F.round(F.col(name), 10).alias(name)


def cents(name: str):
    """Money to two places: what is left after the order of summation, which engines do not share."""
    return F.round(F.col(name), 2).alias(name)


# --- known groups and flows -------------------------------------------------------------

@shared
def groups(i):
    return clean.known_groups(i.groups())


@query
def known_groups(i):
    return clean.known_groups(i.groups())


@query
def known_groups_min_size(i):
    return clean.known_groups(i.groups(), min_size=5)


def _flows(i: Inputs, **how) -> DataFrame:
    return flows.group_flows(flows.label_arcs(i.arcs(), groups(i)), **how)


FLOWS = ["intra_emission", "extra_emission", "intra_reception", "extra_reception"]


@query
def labelled_arcs(i):
    return flows.label_arcs(i.arcs(), groups(i)).withColumn("amount", F.col("amount").cast("double"))


@query
def group_flows(i):
    return _flows(i).select("com", *[F.col(c).cast("double").alias(c) for c in FLOWS])


@query
def group_flows_with_unlabelled(i):
    return _flows(i, count_unlabelled_as_extra=True).select("com", *[F.col(c).cast("double").alias(c) for c in FLOWS])


def _kpis(i: Inputs) -> DataFrame:
    return flows.group_flow_kpis(_flows(i), groups(i))


@query
def group_flow_kpis(i):
    return _kpis(i).select("com", "members", *FLOWS, r6("pct_extra_reception"), r6("pct_extra_emission"),
                           r6("emission_ratio"))


@query
def inward_groups(i):
    return flows.inward_groups(_kpis(i), threshold=0.05)


# --- cleaning ---------------------------------------------------------------------------

@query
def ownership_clean(i):
    return clean.clean_ownership(i.ownership())


@query
def ownership_report(i):
    return clean.ownership_report(i.ownership())


@query
def ownership_totals(i):
    return clean.ownership_totals(clean.clean_ownership(i.ownership())).select("company", r10("capital"), r10("profit"))


@query
def ownership_repeated_keys(i):
    return clean.repeated_keys(clean.clean_ownership(i.ownership()), ["company", "partner"])


@query
def null_report(i):
    return clean.null_report(i.accountant(), ["id", "accountant"])


@query
def distinct_complete_rows(i):
    return clean.distinct_complete_rows(i.accountant())


@query
def id_prefix(i):
    return clean.id_prefix(i.ownership(), "company", "C1").select("company", "partner", r6("capital_pct"))


# --- layers and entities ----------------------------------------------------------------

@query
def ownership_layer(i):
    return layers.ownership_layer(i.ownership()).select("src", "dst", r10("weight"))


@query
def family_layer(i):
    return layers.family_layer(i.family(), FAMILY_KINDS)


@query
def accountant_layer(i):
    return layers.accountant_layer(i.accountant())


@query
def representative_layer(i):
    return layers.representative_layer(i.representative(), *WINDOW)


def relation_layers(i: Inputs, repeats: bool = True) -> dict[str, DataFrame]:
    """The layers as the node and edge tables need them; with ``repeats`` ownership keeps equal rows, which those aggregate away."""
    return {
        "ownership": layers.ownership_layer(i.ownership(), repeats),
        "family": layers.family_layer(i.family(), FAMILY_KINDS),
        "accountant": layers.accountant_layer(i.accountant()),
        "representative": layers.representative_layer(i.representative(), *WINDOW),
    }


@query
def entity_pool(i):
    return entities.entity_pool(relation_layers(i), i.natural())


@query
def role_resolved(i):
    return entities.resolve_role(relation_layers(i), i.natural())


def nodes(i: Inputs) -> DataFrame:
    return entities.node_table(entities.entity_pool(relation_layers(i), i.natural()), groups(i))


@query
def node_table(i):
    return nodes(i)


@query
def prior_groups(i):
    return entities.prior_groups(nodes(i))


# --- wealth -----------------------------------------------------------------------------

def known_wealth_of(i: Inputs) -> DataFrame:
    return propagation.known_wealth(i.wealth_text(), i.wealth_num())


@query
def known_wealth(i):
    return known_wealth_of(i).select("id", r6("wealth"))


@shared
def wealth_complete(i):
    return propagation.propagate(clean.clean_ownership(i.ownership()), known_wealth_of(i))


@shared
def wealth_relations(i):
    return propagation.incomplete(clean.clean_ownership(i.ownership()), known_wealth_of(i))


@query
def wealth_propagated(i):
    return wealth_complete(i).select("id", cents("value"), "iteration")


@query
def wealth_incomplete(i):
    return wealth_relations(i).select("company", "partner", r10("pct"), cents("wealth"))


@query
def wealth_partial_by_group(i):
    members = profiles.attach(groups(i), propagation.partial_wealth(wealth_relations(i)))
    return stats.group_totals(members, "com", "wealth").select("com", cents("wealth"))


@query
def wealth_over_threshold(i):
    """Companies and groups above a threshold, scaled to the data's unit."""
    members = profiles.attach(groups(i), propagation.partial_wealth(wealth_relations(i)))
    totals = stats.group_totals(members, "com", "wealth")
    level = lambda df, name, t: stats.over_threshold(df, "wealth", t).withColumn("level", F.lit(name))
    return level(members, "company", propagation.COMPANY_THRESHOLD / 1000).unionByName(
        level(totals, "group", propagation.GROUP_THRESHOLD / 1000))


@query
def wealth_describe(i):
    return stats.describe(wealth_complete(i), "value").select("count", *[
        F.round(c, 4).alias(c) for c in ["mean", "std", "min", "q25", "q50", "q75", "max"]])


@query
def wealth_of_groups(i):
    return profiles.attach(groups(i), wealth_complete(i)).select("id", "com", cents("value"), "iteration")


# --- workers ----------------------------------------------------------------------------

def _payroll(i: Inputs) -> DataFrame:
    return workers.payroll_counts(clean.in_periods(i.payroll(), "period", PERIODS), MEASURES)


def _fees(i: Inputs) -> DataFrame:
    return workers.fee_counts(clean.between_periods(i.fees(), "period", PERIODS[0], PERIODS[-1]))


def _plain(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


@query
def payroll_counts(i):
    return _plain(_payroll(i), *MEASURES)


@query
def payroll_latest(i):
    return _plain(workers.latest_per_key(_payroll(i), ["employer", "dv"], "period"), *MEASURES)


@query
def payroll_latest_strict(i):
    return _plain(workers.latest_per_key(_payroll(i), ["employer", "dv"], "period", strict=True), *MEASURES)


@query
def fee_latest(i):
    return _plain(workers.latest_per_key(_fees(i), ["payer"], "period"), "total_fee")


def _workers(i: Inputs) -> DataFrame:
    return workers.worker_table(workers.latest_per_key(_payroll(i), ["employer", "dv"], "period"),
                                workers.latest_per_key(_fees(i), ["payer"], "period"))


@query
def worker_table(i):
    return _workers(i)


@query
def workers_by_group(i):
    return stats.group_means(profiles.attach(groups(i), _workers(i)), "com", "dependent_workers").select(
        "com", r6("dependent_workers"))


# --- numeric profiles -------------------------------------------------------------------

def balances(i: Inputs) -> DataFrame:
    return profiles.attach(groups(i), i.balance())


@query
def attribute_coverage(i):
    return profiles.coverage(groups(i), balances(i))


@query
def quartiles(i):
    return stats.quartiles(balances(i), "value").select(r6("q25"), r6("q50"), r6("q75"))


@query
def quartiles_by_group(i):
    return stats.quartiles(balances(i), "value", ["com"]).select("com", r6("q25"), r6("q50"), r6("q75"))


@query
def iqr_filtered(i):
    return stats.iqr_filter(_kpis(i), "members").select("com", "members")


@query
def iqr_removed(i):
    return stats.iqr_removed(_plain(stats.group_totals(i.arcs(), "emitter", "amount"), "amount"), "amount", k=0.5)


@query
def iqr_by_group(i):
    return stats.iqr_filter(balances(i), "value", 0.5, ["com"]).select("id", "com", "value")


@query
def histogram(i):
    return stats.histogram(balances(i), "value", 20).select("bin", r6("lower"), r6("upper"), "n")


@query
def histogram_auto(i):
    return stats.histogram(balances(i), "value", "auto").select("bin", r6("lower"), r6("upper"), "n")


@query
def kde(i):
    return stats.kde(balances(i), "value").select("point", r6("x"), F.round("density", 12).alias("density"))


@query
def group_distribution(i):
    return stats.group_distribution(balances(i), "com", "value", 15).select(
        "com", "n", "min", r6("q25"), r6("q50"), r6("q75"), "max")


@query
def group_mean_histogram(i):
    return stats.histogram(stats.group_means(balances(i), "com", "value"), "value", 10).select(
        "bin", r6("lower"), r6("upper"), "n")


@query
def group_total_histogram(i):
    totals = _plain(stats.group_totals(profiles.attach(groups(i), i.arcs().withColumnRenamed("emitter", "id")),
                                       "com", "amount"), "amount")
    return stats.histogram(stats.iqr_filter(totals, "amount"), "amount", 10).select(
        "bin", F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper"), "n")


@query
def describe(i):
    return stats.describe(balances(i), "value").select("count", *[
        r6(c) for c in ["mean", "std", "min", "q25", "q50", "q75", "max"]])


# --- categorical profiles ---------------------------------------------------------------

def activities(i: Inputs) -> DataFrame:
    return profiles.attach(groups(i), profiles.lookup(i.activity(), i.activity_dim(), "code"))


@query
def top_values(i):
    return profiles.top_values(activities(i), "activity", 15)


@query
def group_modes(i):
    return profiles.group_modes(activities(i), "com", "activity")


@query
def mode_of_modes(i):
    return profiles.mode_of_modes(activities(i), "com", "subsector", 15)


@query
def activity_profile(i):
    a = cut(activities(i).select("com", "subsector", "sector"))
    mark = lambda col: profiles.categorical_profile(a, "com", col, 15).withColumn("attribute", F.lit(col))
    return mark("subsector").unionByName(mark("sector"))


@query
def accountant_profile(i):
    return profiles.categorical_profile(profiles.attach(groups(i), clean.require(i.accountant(), "accountant")),
                                        "com", "accountant", 5)


@query
def address_profile(i):
    return profiles.categorical_profile(
        profiles.attach(groups(i), profiles.lookup(i.addresses(), i.place_dict(), "place")), "com", "name", 15)


@query
def email_profile(i):
    return profiles.categorical_profile(profiles.attach(groups(i), i.emails()), "com", "email", 15)


@query
def directors(i):
    return profiles.attach(groups(i), profiles.directors(i.fees()))


@query
def director_profile(i):
    return profiles.categorical_profile(profiles.attach(groups(i), profiles.directors(i.fees())), "com", "director", 15)


def _extremes(i: Inputs) -> DataFrame:
    return regions.extreme_regions(i.sales(), groups(i), i.place_dict(), i.region_dim(), NORTH, SOUTH)


@query
def extreme_regions(i):
    return _extremes(i)


@query
def extreme_regions_by_group(i):
    return regions.extreme_regions_by_group(_extremes(i))


@query
def extreme_region_counts(i):
    return regions.extreme_region_counts(_extremes(i))


# --- edges and graph --------------------------------------------------------------------

@query
def edges_ownership(i):
    return layers.build_edges_unweighted([relation_layers(i)["ownership"]])


@query
def edges_unweighted(i):
    return layers.build_edges_unweighted(list(relation_layers(i).values()))


@query
def edges_share(i):
    return layers.build_edges({"ownership": relation_layers(i)["ownership"]}).select("src", "dst", r10("weight"))


def final_edges(i: Inputs) -> DataFrame:
    return layers.build_edges(relation_layers(i))


@shared
def edges(i):
    return final_edges(i)


@query
def edges_multilayer(i):
    return final_edges(i).select("src", "dst", r10("weight"), "layer")


@query
def edges_conflict_sum(i):
    return layers.build_edges(relation_layers(i, repeats=False), on_conflict="sum").select("src", "dst", r10("weight"), "layer")


@query
def edges_reweighted(i):
    return layers.reweight(layers.build_flagged_edges(relation_layers(i)), *WEIGHTS).select(
        "src", "dst", r10("weight"))


@query
def degree_centrality(i):
    return graph.degree_centrality(final_edges(i)).select("node", "degree", F.round("centrality", 12).alias("centrality"))


@query
def node_strength(i):
    return graph.degrees(final_edges(i)).select("node", "degree", r10("strength"))


@query
def top_central(i):
    return graph.top_central(edges(i), SAMPLE).select("node", "degree")


@shared
def sample_nodes(i):
    return graph.top_central(edges(i), SAMPLE).select("node")


@query
def induced_subgraph(i):
    return graph.induced_subgraph(edges(i), sample_nodes(i)).select("src", "dst", r10("weight"), "layer")


@query
def non_isolated(i):
    return graph.non_isolated(graph.induced_subgraph(edges(i), sample_nodes(i)))


@query
def seed_membership(i):
    return graph.seed_membership(graph.non_isolated(graph.induced_subgraph(edges(i), sample_nodes(i))), groups(i))


@query
def layer_rows_in_sample(i):
    """Relations between the sample's nodes; those of the sample are kept before they are made distinct."""
    sample = graph.induced_subgraph(edges(i), sample_nodes(i))
    rows = layers.edges_of_graph(i.ownership().withColumnsRenamed({"company": "src", "partner": "dst"}), sample)
    kept = layers.ownership_layer(rows.withColumnsRenamed({"src": "company", "dst": "partner"}))
    return kept.select("src", "dst", r10("weight"))


@shared
def roles(i):
    return entities.resolve_role(relation_layers(i), i.natural())


@shared
def drawn_nodes(i):
    return graph.draw_nodes(edges(i), roles(i), SAMPLE)


@shared
def drawn_edges(i):
    return graph.draw_edges(edges(i), drawn_nodes(i))


@query
def proportional_nodes(i):
    """The nodes of a random sample in which every role keeps its share."""
    return drawn_nodes(i)


@query
def proportional_edges(i):
    """The edges of that sample; every layer keeps its share."""
    return drawn_edges(i).select("src", "dst", "layer")


@query
def proportional_shares(i):
    """Shares of the roles and of the layers in the whole graph and in the sample."""
    every = graph.nodes_of(edges(i)).join(roles(i).withColumnRenamed("id", "node"), "node", "left").na.fill("", ["role"])
    of = lambda kind, sample, whole: graph.shares(sample, whole, kind).select(F.lit(kind).alias("kind"), "name", r10("of_all"), r10("of_sample"))
    return of("role", drawn_nodes(i), every).unionByName(of("layer", drawn_edges(i), edges(i)))


@query
def stratified_sample(i):
    return graph.stratified_sample(final_edges(i), SAMPLE).select("src", "dst", "layer")


@query
def components(i):
    return graph.connected_components(edges(i))


# --- scores of fixed partitions ---------------------------------------------------------

def prior_partition(i: Inputs) -> DataFrame:
    """Every node in its smallest known group, unlabelled nodes alone."""
    seeds = graph.seed_membership(graph.nodes_of(edges(i)), groups(i))
    return seeds.select("node", F.when(F.col("com") == "0", F.col("node")).otherwise(F.concat(F.lit("g"), "com")).alias("community"))


@query
def modularity_of_groups(i):
    return partition.modularity(edges(i), prior_partition(i)).select(F.round("modularity", 9).alias("modularity"))


@query
def modularity_sweep(i):
    return partition.modularity(flow_edges(i), i.partitions(), by=["resolution"]).select(
        "resolution", F.round("modularity", 9).alias("modularity"))


@shared
def flow_edges(i):
    """Undirected flow graph between suppliers and customers, amounts summed."""
    return flows.pair_sums(i.arcs(), i.table("lineitem").count())


def _score(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "n", *[F.round(c, 8).alias(c) for c in ["mi", "emi", "ami"]])


@query
def ami_groups(i):
    found = i.partitions().filter(F.col("resolution") == 1.0)
    labelled = found.join(groups(i).withColumnRenamed("id", "node"), "node")
    return _score(partition.ami(labelled, "com", "community"))


def _ami_sweep(i: Inputs) -> DataFrame:
    return partition.ami_sweep(i.partitions(), groups(i))


@query
def ami_sweep(i):
    return _score(_ami_sweep(i), "resolution")


@query
def ami_sweep_summary(i):
    return partition.sweep_summary(_ami_sweep(i)).select(
        F.round("mean_ami", 8).alias("mean_ami"), F.round("best_ami", 8).alias("best_ami"), "best_resolution")


@query
def partition_export_wide(i):
    return partition.export_wide(i.partitions(), [0.0, 0.5, 1.0])


@query
def partition_result_wide(i):
    """The nodes with their community and its modularity at each resolution."""
    scores = partition.modularity(flow_edges(i), i.partitions(), by=["resolution"]).select("resolution", F.round("modularity", 9).alias("modularity"))
    members = nodes(i).select("id", "com_inicial").distinct()
    return partition.result_wide(members, i.partitions(), scores, [0.0, 0.5, 1.0])


@query
def partition_with_groups(i):
    """All partition nodes with their known group where there is one."""
    return i.partitions().join(groups(i).withColumnRenamed("id", "node"), "node", "left")


@query
def community_labels_fixed(i):
    return partition.community_labels(prior_partition(i))


@query
def labelled_nodes(i):
    return partition.label_nodes(nodes(i), prior_partition(i)).select("id", "com_inicial", "label")


@query
def communities_fixed(i):
    return partition.communities(prior_partition(i))


# --- community detection ----------------------------------------------------------------

@query
def louvain_move_round(i):
    """One synchronous round from single nodes, resolution 1; weights back in their own unit."""
    ids, near, nodes, trials = louvain.prepared(edges(i).select("src", "dst", "weight"), {0: 1.0})
    alone = nodes.select("node", "trial", F.col("node").alias("com"), "k", F.lit(True).alias("on"))
    totals = alone.select("com", F.col("k").alias("tot"), F.lit(1).cast("bigint").alias("size"))
    moved = cut(louvain.best_moves(near, louvain.rows_by_node(alone, totals), trials).withColumn("proposal", F.coalesce("to", "com")))
    near.release()
    name = lambda col: ids.select(F.col("id").alias(col), F.col("node").alias(f"{col}_name"))
    return moved.join(name("node"), "node").join(name("proposal"), "proposal").select(
        F.col("node_name").alias("node"), F.col("proposal_name").alias("proposal"),
        F.round(F.col("kin") / trials.unit, 8).alias("kin"), F.round(F.col("tot") / trials.unit, 8).alias("tot"))


@shared
def found(i):
    return louvain.louvain(edges(i), 1.0)


@query
def louvain_communities(i):
    return found(i)


@query
def louvain_checks(i):
    """Facts about the found partition that hold for any correct run."""
    parts = cut(graph.connected_components(edges(i)))
    joined = found(i).join(parts, "node")
    split = joined.groupBy("community").agg(F.min("component").alias("a"), F.max("component").alias("b"))
    q_found = partition.modularity(edges(i), found(i)).scalar()
    q_prior = partition.modularity(edges(i), prior_partition(i)).scalar()
    return split.agg(F.count_if(F.col("a") != F.col("b")).alias("communities_across_components")).withColumns({
        "labelled_nodes": found(i).agg(F.count("*")).scalar(),
        "nodes": parts.agg(F.count("*")).scalar(),
        "beats_known_groups": q_found > q_prior})


@query
def louvain_optimum(i):
    """No single move of a node raises the modularity of the found partition, and a run from it changes nothing."""
    again = louvain.louvain(edges(i), 1.0, found(i))
    other = again.join(found(i).withColumnRenamed("community", "was"), "node").filter("community <> was")
    better = partition.improving_moves(edges(i), found(i))
    return found(i).agg(F.count("*").alias("nodes")).withColumns({
        "improving_moves": better.agg(F.count("*")).scalar(), "moved_again": other.agg(F.count("*")).scalar()})


@shared
def connected(i):
    return louvain.climb_connected(edges(i), 1.0, found(i))


@query
def louvain_connected(i):
    """The found partition with its communities split into connected parts and climbed again."""
    return connected(i)


@query
def connected_checks(i):
    """Facts about it: every node once, every community connected, modularity no lower than before."""
    parts = graph.refine_connected(edges(i), connected(i))
    number = lambda df: df.agg(F.count_distinct("community").alias("n")).scalar()
    score = lambda p: partition.modularity(edges(i), p).scalar()
    return connected(i).agg(F.count("*").alias("labelled"), F.count_distinct("node").alias("nodes")).withColumns({
        "disconnected": number(parts) - number(connected(i)), "no_worse": score(connected(i)) >= score(found(i)) - F.lit(1e-9)})


@query
def louvain_at_zero(i):
    """At resolution 0 the communities are the components, whatever the weights."""
    return louvain.louvain(edges(i), 0.0)


@query
def louvain_seeded(i):
    return louvain.louvain(edges(i), 1.0, prior_partition(i))


@query
def community_labels(i):
    return partition.community_labels(found(i))


@query
def communities(i):
    return partition.communities(found(i))


@query
def refine_connected(i):
    return graph.refine_connected(edges(i), prior_partition(i))


@shared
def swept(i):
    return louvain.resolution_sweep(edges(i), RESOLUTIONS)


@query
def resolution_sweep(i):
    """The whole graph at every resolution."""
    return swept(i)


@query
def resolution_modularity(i):
    return partition.modularity(edges(i), swept(i), by=["resolution"])


@query
def resolution_ami(i):
    return partition.ami_sweep(swept(i), groups(i))


@query
def resolution_checks(i):
    """Facts about the sweep at each resolution: every node is labelled once, and no single move of a node gains."""
    labelled = swept(i).groupBy("resolution").agg(F.count("*").alias("labelled"), F.count_distinct("node").alias("nodes"))
    better = partition.improving_moves_of_sweep(edges(i), swept(i)).groupBy("resolution").agg(F.count("*").alias("n"))
    return labelled.join(better, "resolution", "left").select("resolution", "labelled", "nodes", F.coalesce("n", F.lit(0)).alias("improving_moves"))


# --- tuning -----------------------------------------------------------------------------

@shared
def flagged_sample(i):
    return graph.induced_subgraph(layers.build_flagged_edges(relation_layers(i)), sample_nodes(i))


@query
def trial_edges(i):
    return tuning.trial_edges(flagged_sample(i), TRIALS).select("trial", "src", "dst", r10("weight"))


@shared
def trial_log(i):
    return tuning.evaluate(flagged_sample(i), groups(i), TRIALS)


@query
def trial_scores(i):
    return trial_log(i)


@query
def weight_search(i):
    return search_log(i)


@query
def weight_grid(i):
    return tuning.grid_search(flagged_sample(i), groups(i), TRIALS[0], [[0.5, 1.0], [], [0.5], [0.4]])


def partition_log(i: Inputs) -> DataFrame:
    """A trial log made of the fixed partitions' scores."""
    scores = _ami_sweep(i)
    return scores.select((F.col("resolution") * 10).cast("int").alias("trial"),
                         *[(F.col("resolution") / 3 + d).alias(p) for d, p in enumerate(tuning.PARAMETERS)],
                         F.round("ami", 8).alias("ami"))


@query
def best_trial(i):
    return tuning.best_trial(partition_log(i))


@shared
def search_log(i):
    return tuning.search(flagged_sample(i), groups(i))


@query
def search_summary(i):
    """Facts about the search's log: whole generations, parameters within bounds, scores in range, the best trial the maximum."""
    log, best = search_log(i), tuning.best_trial(search_log(i))
    size, axes = tuning.POPULATION_FACTOR * len(tuning.BOUNDS), len(tuning.PARAMETERS)
    batch = F.when(F.col("phase") == "polish", F.col("n").isin(2 * axes, 2 * axes + 1)).otherwise(F.col("n") == size)
    whole = log.groupBy("generation", "phase").agg(F.count("*").alias("n")).agg(F.bool_and(batch)).scalar()
    inside = [F.col(p).between(low, high) for p, (low, high) in zip(tuning.PARAMETERS, tuning.BOUNDS)]
    return log.agg(F.bool_and(inside[0] & inside[1] & inside[2] & inside[3]).alias("within_bounds"),
                   F.bool_and(F.col("ami").between(-1, 1)).alias("scored")).select(
        whole.alias("whole_generations"), "*").withColumn("best_is_max", F.coalesce(best.select("ami").scalar() == log.agg(F.max("ami")).scalar(), F.lit(False)))


_final: dict[tuple, tuple[DataFrame, DataFrame]] = {}


def final_run(i: Inputs) -> tuple[DataFrame, DataFrame]:
    """The search's best trial on the whole graph, run once for its labels and its scores."""
    key = (i.spark.sparkContext.applicationId, i.sf_dir)
    if key not in _final:
        _final[key] = tuning.final_partition(i.spark, search_log(i), relation_layers(i), groups(i))
    return _final[key]


@shared
def final_labels(i):
    return final_run(i)[0]


@query
def final_partition(i):
    return final_labels(i)


@query
def final_scores(i):
    return final_run(i)[1]


# --- sources and sinks ------------------------------------------------------------------

def round_trip(df: DataFrame, fmt: str = "parquet", mode: str = "errorifexists") -> str:
    path = scratch(df.sparkSession)
    io.sink(df, path, fmt, mode)
    return path


@query
def source_catalog(i):
    """A table of the session's catalog, its schema checked."""
    i.family().createOrReplaceTempView("entitynet_family")
    return io.source(i.spark, "entitynet_family", schema_of("id string, relative string, kind string"))


@query
def source_parquet(i):
    """A Parquet directory, read whole and its schema checked (names in any case, columns in another order)."""
    path = round_trip(i.groups().select(F.col("com").alias("COM"), "id"))
    return io.source(i.spark, path, schema_of("id string, com string"))


@query
def source_csv(i):
    """CSV with a header and a declared schema, written and read by the engine."""
    flows = i.arcs().select("emitter", "receiver", F.col("amount").cast("double").alias("amount"))
    return io.read_csv(i.spark, round_trip(flows, "csv"), flows.schema)


@query
def source_groups_json(i):
    """The map of nodes to prior groups through its JSON file."""
    path = scratch(i.spark)
    io.write_groups(entities.prior_groups(nodes(i)), path)
    return io.read_groups(i.spark, path)


@query
def source_sample_groups_json(i):
    """The map restricted to the sample, one entry for each of its nodes."""
    path = scratch(i.spark)
    io.write_groups(graph.seed_membership(sample_nodes(i), groups(i)), path)
    return io.read_groups(i.spark, path)


@query
def source_edges_by_layer(i):
    """One layer of the stored graph, read from its own directory."""
    path = scratch(i.spark)
    io.write_edges(edges(i), path)
    return io.read_edges(i.spark, path, ["ownership"]).select("src", "dst", r10("weight"), "layer")


@query
def sink_overwritten(i):
    """Overwriting leaves the second table only."""
    path = round_trip(i.family().select(F.col("id").alias("id"), F.lit("x").alias("com")))
    io.sink(i.groups().select("id", "com"), path, mode="overwrite")
    return io.source(i.spark, path)


@query
def sink_refused(i):
    """A sink that must not replace data leaves the first table as it is."""
    path = round_trip(i.groups().select("id", "com"))
    try:
        io.sink(i.family().select(F.col("id").alias("id"), F.lit("x").alias("com")), path)
        refused = False
    except AnalysisException as e:
        refused = e.getCondition() == "PATH_ALREADY_EXISTS"
    return io.source(i.spark, path).withColumn("refused", F.lit(refused))
