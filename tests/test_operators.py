"""Hand-written fixtures with known results, and brute force on small random ones."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from entitynet.functions.ranking import ordered_prefix
from entitynet.functions.scalars import log_factorial, parse_money, ratio, repair_text
from entitynet.operators import louvain_arrays as arrays
from entitynet.operators import (
    clean, entities, flows, graph, layers, louvain, partition, profiles, propagation, regions, stats, tuning, workers,
)
from entitynet.sources import io


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*(cols or df.columns)).collect())


def table(spark, data, schema):
    return spark.createDataFrame(data, schema)


# --- functions --------------------------------------------------------------------------

def test_scalars(spark):
    df = table(spark, [("1,234", 3.0, 0.0, "VI�A"), ("sin dato", None, 2.0, "A")], "m string, a double, b double, t string")
    got = df.select(parse_money(F.col("m")), ratio(F.col("a"), F.col("b")), repair_text(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(1234, None, "VINA"), (None, None, "A")]


def test_log_factorial(spark):
    numbers = [0, 1, 2, 9, 10, 11, 50, 1000, 10**6]
    got = table(spark, [(n,) for n in numbers], "n bigint").select("n", log_factorial(F.col("n")).alias("v")).collect()
    for r in got:
        assert r["v"] == pytest.approx(math.lgamma(r["n"] + 1), rel=1e-12, abs=1e-12)


def test_ordered_prefix(spark):
    data = [(f"g{i % 3}", i * 7 % 101, i) for i in range(101)]
    df = table(spark, data, "g string, v int, w int")
    got = rows(ordered_prefix(df, [F.col("v")], F.col("w"), ["g"]), "g", "v", "prefix")
    want = []
    for g in ("g0", "g1", "g2"):
        total = 0
        for _, v, w in sorted(d for d in data if d[0] == g):
            want.append((g, v, total))
            total += w
    assert got == sorted(want)
    order = rows(ordered_prefix(df, [F.desc("v")], name="pos"), "v", "pos")
    assert order == sorted((v, i) for i, v in enumerate(sorted((d[1] for d in data), reverse=True)))


# --- flows, layers, workers -------------------------------------------------------------

def test_flows_with_unlabelled_parties(spark):
    arcs = table(spark, [("a", "b", 10.0), ("a", "c", 5.0), ("c", "a", 2.0), ("a", "x", 7.0), ("x", "y", 9.0), ("a", "b", 0.0)],
                 "emitter string, receiver string, amount double")
    groups = table(spark, [("a", "1"), ("b", "1"), ("c", "2"), ("d", "3")], "id string, com string")
    labelled = flows.label_arcs(arcs, groups)
    assert labelled.count() == 4
    got = flows.group_flows(labelled)
    assert rows(got) == [("1", 10.0, 5.0, 10.0, 2.0), ("2", None, 2.0, None, 5.0)]
    outside = {r["com"]: r["extra_emission"] for r in flows.group_flows(labelled, True).collect()}
    assert outside == {"1": 12.0, "2": 2.0}
    kpi = {r["com"]: r for r in flows.group_flow_kpis(got, groups).collect()}
    assert kpi["1"]["emission_ratio"] == 2.0 and kpi["2"]["pct_extra_emission"] is None and kpi["3"]["members"] == 1
    filled = {r["com"]: r for r in flows.group_flow_kpis(got, groups, missing_as_zero=True).collect()}
    assert filled["2"]["pct_extra_emission"] == 100.0


def test_intra_emission_equals_intra_reception(spark):
    draw = random.Random(3)
    arcs = table(spark, [(f"n{draw.randrange(30)}", f"n{draw.randrange(30)}", float(draw.randrange(9))) for _ in range(300)],
                 "emitter string, receiver string, amount double")
    groups = table(spark, [(f"n{i}", str(i % 4)) for i in range(25)], "id string, com string")
    s = flows.group_flows(flows.label_arcs(arcs, groups)).agg(F.sum("intra_emission"), F.sum("intra_reception")).first()
    assert s[0] == s[1]


def layer(spark, *pairs):
    return table(spark, list(pairs), "src string, dst string, weight double")


def test_last_layer_wins_in_either_direction(spark):
    built = {"ownership": layer(spark, ("x", "y", 0.5), ("x", "x", 0.1), ("x", "z", 0.0), ("x", "y", 0.7)),
             "family": layer(spark, ("y", "x", 1.0)), "accountant": layer(spark, ("z", "x", 0.25))}
    assert rows(layers.build_edges(built), "src", "dst", "weight", "layer") == [
        ("x", "x", 0.1, "ownership"), ("x", "y", 1.0, "family"), ("x", "z", 0.25, "accountant")]
    assert rows(layers.build_edges(built, on_conflict="max"), "src", "dst", "weight") == [
        ("x", "x", 0.1), ("x", "y", 1.0), ("x", "z", 0.25)]
    assert rows(layers.build_edges(built, on_conflict="sum"), "src", "dst", "weight")[1] == ("x", "y", pytest.approx(2.2))
    again = layers.reweight(layers.build_flagged_edges(built), 0.3, 0.4, 0.9)
    assert rows(again) == [("x", "x", 0.1), ("x", "y", 0.3), ("x", "z", 0.9)]
    degree = {r["node"]: r["degree"] for r in graph.degrees(layers.build_edges(built)).collect()}
    assert degree == {"x": 4, "y": 1, "z": 1}
    assert layers.edges_of_graph(layer(spark, ("y", "x", 1.0), ("y", "z", 1.0)), layers.build_edges(built)).count() == 1


def test_validity_interval(spark):
    df = table(spark, [("a", "1999-01-01", None), ("b", "2001-01-01", None), ("c", "1998-01-01", "2000-01-01"),
                       ("d", "1998-01-01", "2000-01-02")], "id string, s string, e string")
    df = df.select("id", F.col("s").cast("date").alias("start"), F.col("e").cast("date").alias("end"))
    assert rows(clean.valid_during(df, "start", "end", "2000-01-01", "2001-01-01"), "id") == [("a",), ("d",)]


def test_latest_per_key(spark):
    df = table(spark, [("a", 2000, 5.0), ("a", 2001, None), ("b", 2000, None)], "k string, p int, v double")
    assert rows(workers.latest_per_key(df, ["k"], "p")) == [("a", 2001, 5.0), ("b", 2000, None)]
    assert rows(workers.latest_per_key(df, ["k"], "p", strict=True)) == [("a", 2001, None), ("b", 2000, None)]


def test_modes(spark):
    df = table(spark, [("g", v) for v in "baab"] + [("h", None), ("h", None)], "g string, v string")
    assert {r["g"]: r["v"] for r in profiles.group_modes(df, "g", "v").collect()} == {"g": "a", "h": None}
    assert rows(profiles.mode_of_modes(df, "g", "v", 5)) == [("a", 1)]


def test_extreme_regions_defaults(spark):
    sales = table(spark, [("a", 1), ("a", 2), ("a", 2), ("b", 1), ("c", 9)], "emitter string, place int")
    groups = table(spark, [("a", "1"), ("b", "1"), ("c", "2")], "id string, com string")
    places = table(spark, [(1, "ARICA"), (2, "PU�TA")], "place int, name string")
    dim = table(spark, [("ARICA", "XV REGION"), ("PUNTA", "XII REGION")], "name string, region string")
    found = regions.extreme_regions(sales, groups, places, dim)
    assert rows(found) == [("a", "1", 1, 1, "si"), ("b", "1", 1, 0, "no")]
    assert rows(regions.extreme_regions_by_group(found)) == [("1", "si")]


# --- statistics -------------------------------------------------------------------------

def test_quantiles_with_a_hot_group(spark):
    draw = random.Random(5)
    data = [("hot", float(draw.randrange(40))) for _ in range(900)] + [(f"g{i % 7}", draw.random()) for i in range(300)]
    data += [("one", 4.0), ("none", None)]
    df = table(spark, data, "g string, v double")
    got = {r["g"]: (r["q25"], r["q50"], r["q75"]) for r in stats.quartiles(df, "v", ["g"]).collect()}
    by = defaultdict(list)
    for g, v in data:
        if v is not None:
            by[g].append(v)
    assert set(got) == set(by)
    for g, values in by.items():
        assert got[g] == pytest.approx(tuple(np.percentile(values, [25, 50, 75])))
    total = stats.quartiles(df, "v").first()
    assert tuple(total) == pytest.approx(tuple(np.percentile([v for _, v in data if v is not None], [25, 50, 75])))


def test_iqr_keeps_bounds(spark):
    df = table(spark, [(float(v),) for v in [1, 2, 3, 10, 17, 24]], "v double")
    q1, q3 = np.percentile([1, 2, 3, 10, 17, 24], [25, 75])
    kept = [v for v in [1, 2, 3, 10, 17, 24] if q1 - .3 * (q3 - q1) <= v <= q3 + .3 * (q3 - q1)]
    assert [r[0] for r in rows(stats.iqr_filter(df, "v", 0.3))] == kept
    assert rows(stats.iqr_removed(df, "v", 0.3)) == [(len(kept), 6 - len(kept))]


@pytest.mark.parametrize("bins", [10, "auto"])
def test_histogram_matches_numpy(spark, bins):
    values = [random.Random(1).gauss(0, 1) for _ in range(1)] + [math.sin(i) * i for i in range(200)]
    got = stats.histogram(table(spark, [(v,) for v in values], "v double"), "v", bins).orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=bins)
    assert [r["n"] for r in got] == list(counts)
    assert [r["lower"] for r in got] == pytest.approx(list(edges[:-1]))


def test_histogram_of_one_value(spark):
    got = stats.histogram(table(spark, [(3.0,), (3.0,)], "v double"), "v", 4).orderBy("bin").collect()
    assert [r["n"] for r in got] == [0, 0, 2, 0] and got[0]["lower"] == 2.5


def test_kde(spark):
    values = np.array([0.0, 1.0, 1.5, 4.0])
    got = stats.kde(table(spark, [(float(v),) for v in values], "v double"), "v", 5).orderBy("point").collect()
    width = values.std(ddof=1) * 4 ** -0.2
    for r in got:
        want = np.exp(-0.5 * ((r["x"] - values) / width) ** 2).sum() / (4 * width * math.sqrt(2 * math.pi))
        assert r["density"] == pytest.approx(want)


def test_kde_of_clusters_and_outliers_is_the_sum_over_all_values(spark):
    draw = random.Random(3)
    values = [draw.gauss(0, 1) for _ in range(300)] + [draw.gauss(40, 0.1) for _ in range(300)] + [-500.0, 3000.0, 3000.0]
    got = stats.kde(table(spark, [(v,) for v in values], "v double"), "v", 333).orderBy("point").collect()
    width = np.std(values, ddof=1) * len(values) ** -0.2
    xs = np.linspace(min(values), max(values), 333)
    want = np.exp(-0.5 * ((xs[:, None] - np.array(values)) / width) ** 2).sum(1) / (len(values) * width * math.sqrt(2 * math.pi))
    assert np.allclose([r["x"] for r in got], xs) and np.abs(np.array([r["density"] for r in got]) - want).max() < 1e-14 / width


def test_kde_without_spread(spark):
    got = stats.kde(table(spark, [(2.0,), (2.0,)], "v double"), "v", 4).collect()
    assert len(got) == 4 and all(r["density"] is None and r["x"] == 2.0 for r in got)
    assert stats.kde(table(spark, [(None,)], "v double"), "v", 4).count() == 0


# --- propagation ------------------------------------------------------------------------

def test_propagation(spark):
    own = table(spark, [
        ("A", "p", 50.0), ("A", "q", 25.0), ("B", "A", 100.0), ("C", "B", 60.0), ("C", "p", 40.0),
        ("X", "Y", 100.0), ("Y", "X", 100.0), ("U", "p", 50.0), ("U", "unknown", 50.0), ("K", "p", 100.0), ("L", "K", 10.0),
    ], "company string, partner string, capital_pct double")
    known = table(spark, [("p", 10.0), ("q", 40.0), ("K", 7.0)], "id string, wealth double")
    got = {r["id"]: (round(r["value"], 9), r["iteration"]) for r in propagation.propagate(own, known).collect()}
    assert got == {"A": (20.0, 0), "B": (20.0, 1), "C": (16.0, 2), "K": (10.0, 0), "L": (7.0, 0)}
    early = {r["id"] for r in propagation.propagate(own, known, rounds=2).collect()}
    assert early == {"A", "B", "K", "L"}
    left = {(r["company"], r["partner"]): r["wealth"] for r in propagation.incomplete(own, known).collect()}
    assert left[("X", "Y")] is None and left[("L", "K")] == 7.0 and round(left[("C", "B")], 9) == 20.0
    partial = {r["id"]: r["wealth"] for r in propagation.partial_wealth(propagation.incomplete(own, known)).collect()}
    assert partial["U"] == 10.0 and "X" not in partial and partial["A"] == 50.0


def test_equal_sources_count_once(spark):
    a = table(spark, [("x", "1,000"), ("y", "5"), ("z", "-3")], "id string, wealth string")
    b = table(spark, [("x", 1000.9), ("y", 8.0)], "id string, wealth double")
    assert rows(propagation.known_wealth(a, b)) == [("x", 1000.0), ("y", 6.5)]


# --- graph ------------------------------------------------------------------------------

def ring(cliques, size):
    pairs = []
    for c in range(cliques):
        pairs += [(f"n{c:02d}{j}", f"n{c:02d}{i}", 1.0) for i in range(size) for j in range(i)]
        pairs.append((f"n{c:02d}0", f"n{(c + 1) % cliques:02d}1", 1.0))
    return pairs


def random_edges(nodes, count, seed):
    draw = random.Random(seed)
    found = {tuple(sorted((draw.randrange(nodes), draw.randrange(nodes)))): draw.randrange(1, 9) / 4 for _ in range(count)}
    return [(f"v{a:03d}", f"v{b:03d}", w) for (a, b), w in found.items()]


def roots(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, *_ in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    pairs = random_edges(120, 90, seed) + [(f"p{i:02d}", f"p{i + 1:02d}", 1.0) for i in range(40)]
    got = dict(rows(graph.connected_components(layer(spark, *pairs)), "node", "component"))
    assert got == roots(pairs)


def test_louvain_at_zero_is_components(spark):
    pairs = random_edges(60, 45, 7)
    got = dict(rows(louvain.louvain(layer(spark, *pairs), 0.0), "node", "community"))
    assert got == roots(pairs)


def brute_modularity(pairs, com, gamma=1.0):
    degree, inside, m = Counter(), 0.0, 0.0
    for a, b, w in pairs:
        degree[com[a]] += w
        degree[com[b]] += w
        m += w
        inside += w * (com[a] == com[b])
    return inside / m - gamma * sum((d / (2 * m)) ** 2 for d in degree.values())


def test_modularity(spark):
    pairs = random_edges(30, 80, 4)
    com = {n: int(n[1:]) % 4 for a, b, _ in pairs for n in (a, b)}
    part = table(spark, list(com.items()), "node string, community int")
    for gamma in (1.0, 0.3):
        got = partition.modularity(layer(spark, *pairs), part, gamma).first()[0]
        assert got == pytest.approx(brute_modularity(pairs, com, gamma))


def test_louvain_at_zero_with_heavy_tailed_weights(spark):
    pairs = [(f"p{i:02d}", f"p{i + 1:02d}", 1.0) for i in range(20)] + [("x", "y", 1e13)]
    got = dict(rows(louvain.louvain(layer(spark, *pairs), 0.0), "node", "community"))
    assert got == roots(pairs)


def test_louvain_ends_where_no_single_move_gains(spark):
    pairs = random_edges(40, 90, 3)
    edges = layer(spark, *pairs)
    found = louvain.louvain(edges, 1.0)
    com = dict(rows(found, "node", "community"))
    best = brute_modularity(pairs, com)
    for node in com:
        for other in set(com.values()):
            assert brute_modularity(pairs, {**com, node: other}) <= best + 1e-9
    assert partition.improving_moves(edges, found).count() == 0
    assert dict(rows(louvain.louvain(edges, 1.0, found), "node", "community")) == com
    worse = found.withColumn("community", F.when(F.col("node") == min(com), F.lit("alone")).otherwise(F.col("community")))
    assert {r["node"] for r in partition.improving_moves(edges, worse).collect()} >= {min(com)}


def test_modularity_refuses_a_partition_that_does_not_fit(spark):
    edges = layer(spark, ("a", "b", 1.0), ("b", "c", 1.0))
    for nodes in (["a", "b"], ["a", "b", "c", "c"]):
        with pytest.raises(Exception, match="missing from the partition"):
            partition.modularity(edges, table(spark, [(n, 1) for n in nodes], "node string, community int")).collect()


def test_prior_groups_have_one_row_per_node(spark):
    nodes = table(spark, [("a", "99"), ("a", "1"), ("b", None)], "id string, com_inicial string")
    assert rows(entities.prior_groups(nodes)) == [("a", "1"), ("b", "0")]


def test_hubs_and_large_graphs_of_communities(spark, monkeypatch):
    """Hubs in their own table, and graphs of communities climbed by rounds, end in an optimum too."""
    monkeypatch.setattr(louvain, "HUB", 6)
    monkeypatch.setattr(louvain, "SMALL", 0)
    pairs = random_edges(30, 60, 5) + [("hub", f"n{i:02d}", 0.5) for i in range(12)]
    edges = layer(spark, *pairs)
    found = louvain.louvain(edges, 1.0)
    assert partition.improving_moves(edges, found).count() == 0
    assert dict(rows(louvain.louvain(edges, 0.0), "node", "community")) == roots(pairs)


def test_rounds_do_not_shuffle_the_edges(spark):
    edges = layer(spark, *random_edges(40, 90, 3))
    _, near, nodes, trials = louvain.prepared(edges, {0: 1.0})
    alone = nodes.select("node", "trial", F.col("node").alias("com"), "k", F.lit(True).alias("on"))
    totals = alone.select("com", F.col("k").alias("tot"), F.lit(1).cast("bigint").alias("size"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = louvain.best_moves(near, louvain.rows_by_node(alone, totals), trials)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    scan = next(i for i, line in enumerate(plan) if "default.near_" in line)
    join = next(i for i in range(scan, 0, -1) if "Join" in plan[i])
    assert "Bucketed: true" in plan[scan] and not any("Exchange" in line for line in plan[join:scan])
    near.release()


def test_no_round_lowers_modularity(spark):
    pairs = random_edges(40, 90, 11)
    ids, near, nodes, trials = louvain.prepared(layer(spark, *pairs), {0: 1.0})
    names = {r["id"]: r["node"] for r in ids.collect()}
    flat = nodes.select("node", "trial", F.col("node").alias("com"), "k", F.lit(True).alias("on"))
    com, now = {n: n for n in names}, -1.0
    while True:
        totals = flat.groupBy("com").agg(F.sum("k").alias("tot"), F.count("*").alias("size"))
        proposed = louvain.best_moves(near, louvain.rows_by_node(flat, totals), trials).filter("to is not null")
        moved = louvain.compatible(near, proposed, trials).collect()
        if not moved:
            break
        com.update({r["node"]: r["to"] for r in moved})
        before, now = now, brute_modularity(pairs, {names[n]: c for n, c in com.items()})
        assert now > before
        flat = table(spark, [(r["node"], 0, com[r["node"]], r["k"], True) for r in nodes.collect()], "node bigint, trial int, com bigint, k bigint, on boolean")
    assert now > 0.2


def test_clique_ring_and_sweep(spark):
    pairs = ring(10, 5)
    swept = louvain.resolution_sweep(layer(spark, *pairs), [0.0, 0.5, 1.0])
    counts = {r["resolution"]: r["n"] for r in swept.groupBy("resolution").agg(F.count_distinct("community").alias("n")).collect()}
    assert counts[0.0] == 1 and counts[1.0] in (9, 10)
    assert swept.count() == 150
    q = {r["resolution"]: r["modularity"] for r in partition.modularity(layer(spark, *pairs), swept, by=["resolution"]).collect()}
    assert q[1.0] > 0.79


def test_stars_and_move_counts(spark):
    pairs = [(f"h{s}", f"l{s}{i:02d}", 1.0) for s in range(3) for i in range(50)]
    assert louvain.louvain(layer(spark, *pairs), 1.0).select("community").distinct().count() == 3


def test_planted_partition_is_found_from_a_seed_too(spark):
    draw = random.Random(11)
    pairs = []
    for a in range(80):
        for b in range(a):
            if draw.random() < (0.5 if a % 4 == b % 4 else 0.02):
                pairs.append((f"v{b:02d}", f"v{a:02d}", 1.0))
    truth = {f"v{a:02d}": a % 4 for a in range(80)}
    edges = layer(spark, *pairs)
    known = table(spark, list(truth.items()), "node string, com int")
    for start in (None, known.select("node", F.col("com").cast("string").alias("community"))):
        found = louvain.louvain(edges, 1.0, start)
        score = partition.ami(found.join(known, "node"), "com", "community").first()["ami"]
        assert score > 0.9
        com = dict(rows(found, "node", "community"))
        assert brute_modularity(pairs, com) >= brute_modularity(pairs, truth) - 0.02


def test_refine_connected(spark):
    edges = layer(spark, ("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0))
    part = table(spark, [("a", "1"), ("b", "2"), ("c", "1"), ("d", "1")], "node string, community string")
    assert rows(graph.refine_connected(edges, part)) == [("a", "a"), ("b", "b"), ("c", "c"), ("d", "c")]


def test_top_central_and_labels(spark):
    edges = layer(spark, *[("hub", f"n{i}", 1.0) for i in range(18)], ("n0", "n1", 1.0))
    assert [r[0] for r in rows(graph.top_central(edges, 0.15), "node")] == ["hub", "n0"]
    part = table(spark, [("a", "x"), ("b", "y"), ("c", "y"), ("d", "z")], "node string, community string")
    assert rows(partition.community_labels(part)) == [("a", 2), ("b", 1), ("c", 1), ("d", 3)]


# --- adjusted mutual information --------------------------------------------------------

U = [1] * 6 + [2] * 6 + [3] * 5
V = [1, 1, 1, 1, 2, 1, 2, 2, 2, 2, 3, 1, 3, 3, 3, 2, 2]


def score(spark, u, v):
    return partition.ami(table(spark, list(zip(u, v)), "u int, v int"), "u", "v").first()


def test_ami_golden(spark):
    r = score(spark, U, V)
    assert (r["mi"], r["emi"], r["ami"]) == pytest.approx((0.410218623, 0.150424803, 0.278209647), abs=1e-8)
    assert score(spark, V, U)["ami"] == pytest.approx(r["ami"])
    assert score(spark, [7 - x for x in U], V)["ami"] == pytest.approx(r["ami"])
    assert score(spark, U, U)["ami"] == pytest.approx(1.0)
    assert score(spark, [1] * 5, [2] * 5)["ami"] == 1.0
    assert score(spark, [1] * 5, [1, 1, 2, 2, 2])["ami"] == 0.0


def test_expected_mi_of_large_clusters(spark):
    """The restricted overlap range loses nothing that a double can hold."""
    a, b = [4000, 3000, 1000], [5000, 2500, 500]
    u = [i for i, n in enumerate(a) for _ in range(n)]
    v = [i for i, n in enumerate(b) for _ in range(n)]
    n, lg, want = 8000, math.lgamma, 0.0
    for x in a:
        for y in b:
            for k in range(max(1, x + y - n), min(x, y) + 1):
                p = math.exp(lg(x + 1) + lg(y + 1) + lg(n - x + 1) + lg(n - y + 1) - lg(n + 1) - lg(k + 1)
                             - lg(x - k + 1) - lg(y - k + 1) - lg(n - x - y + k + 1))
                want += k / n * math.log(n * k / (x * y)) * p
    assert score(spark, u, v)["emi"] == pytest.approx(want, rel=1e-8)


# --- tuning and storage -----------------------------------------------------------------

def test_search_improves_and_repeats(spark):
    built = {"ownership": layer(spark, *ring(4, 4)), "family": layer(spark, ("n000", "n012", 1.0), ("n021", "n033", 1.0))}
    flagged = layers.build_flagged_edges(built)
    truth = table(spark, [(f"n{c:02d}{i}", str(c)) for c in range(4) for i in range(4)], "id string, com string")
    logs = [tuning.search(flagged, truth, generations=1, population=3, seed=2, polish=False).orderBy("trial").collect() for _ in range(2)]
    assert logs[0] == logs[1] and [(r["trial"], r["phase"], r["generation"]) for r in logs[0]][::3] == [(0, "start", 0), (3, "evolve", 1)][:len(logs[0]) // 3]
    for r in logs[0]:
        assert all(lo <= r[p] <= hi for p, (lo, hi) in zip(tuning.PARAMETERS, tuning.BOUNDS)) and r["ami"] <= 1 + 1e-9
    best = tuning.best_trial(spark.createDataFrame(logs[0], tuning.LOG)).first()
    assert best["ami"] == max(r["ami"] for r in logs[0])


def surface(trial):
    """Highest, 1, at (0.9, 0.3, 0.55, 0.22)."""
    return 1 - sum(((x - at) / (hi - lo)) ** 2 for x, at, (lo, hi) in zip(trial, (0.9, 0.3, 0.55, 0.22), tuning.BOUNDS))


def test_first_generation_has_one_point_in_every_slice():
    points = tuning.latin_hypercube(random.Random(4), tuning.BOUNDS, 12)
    for axis, (low, high) in enumerate(tuning.BOUNDS):
        assert sorted(int((p[axis] - low) / (high - low) * 12) for p in points) == list(range(12))


def test_evolution_and_polish_find_the_top_within_bounds():
    phases, seen = [], []

    def score(phase, trials):
        phases.append(phase)
        seen.extend(trials)
        return [surface(t) for t in trials]

    best, value = tuning.evolve(score, tuning.BOUNDS, 10, 12, 3)
    polished, top = tuning.refine(score, tuning.BOUNDS, best, value)
    assert phases[0] == "start" and {*phases[1:11]} == {"evolve"} and {*phases[11:]} == {"polish"}
    assert top >= value and top > 1 - 5 * tuning.POLISH_TO ** 2 and top == surface(polished)
    assert all(lo <= x <= hi for t in seen for x, (lo, hi) in zip(t, tuning.BOUNDS))
    corner, top = tuning.refine(lambda _, trials: [sum(t) for t in trials], tuning.BOUNDS, (0.5, 0.5, 0.5, 0.2), 1.7)
    assert corner == tuple(hi for _, hi in tuning.BOUNDS) and top == sum(corner)
    flat, _ = tuning.refine(lambda _, trials: [0.0] * len(trials), tuning.BOUNDS, (0.5, 0.5, 0.5, 0.2), 0.0)
    assert flat == (0.5, 0.5, 0.5, 0.2)


def test_a_broken_search_resumes_to_the_log_of_an_unbroken_one(spark, tmp_path, monkeypatch):
    flagged = table(spark, [("a", "b")], "src string, dst string")
    truth = table(spark, [("a", "1")], "id string, com string")
    calls, fail_at = [], [None]

    def fake(flagged, truth, trials):
        if len(calls) == fail_at[0]:
            raise RuntimeError("lost")
        calls.append(len(trials))
        return table(spark, [(i, *t, surface(t)) for i, t in enumerate(trials)], "trial int, " + ", ".join(f"{p} double" for p in tuning.PARAMETERS) + ", ami double")

    monkeypatch.setattr(tuning, "evaluate", fake)
    run = lambda ledger, **kw: [tuple(r) for r in tuning.search(
        flagged, truth, **{"generations": 3, "population": 5, "seed": 7, **kw}, ledger=ledger).orderBy("trial").collect()]
    whole, batches = run(str(tmp_path / "whole")), len(calls)
    assert [r[0] for r in whole] == list(range(len(whole))) and {r[6] for r in whole} == {"start", "evolve", "polish"}
    calls.clear()
    fail_at[0] = 2
    with pytest.raises(RuntimeError):
        run(str(tmp_path / "broken"))
    fail_at[0] = None
    assert run(str(tmp_path / "broken")) == whole and len(calls) == batches
    calls.clear()
    assert run(str(tmp_path / "broken")) == whole and not calls
    # A generation that lacks trials is run anew, and nothing else.
    spark.createDataFrame([r[:7] for r in whole if r[7] == 1][:2], tuning.LOG.rpartition(",")[0]).write.mode("overwrite").parquet(
        str(tmp_path / "broken" / "trials" / "generation=1"))
    assert run(str(tmp_path / "broken")) == whole and calls == [5]
    with pytest.raises(ValueError):
        run(str(tmp_path / "broken"), seed=8)
    with pytest.raises(ValueError):
        tuning.search(flagged, truth.limit(0), generations=3, population=5, seed=7, ledger=str(tmp_path / "broken"))
    calls.clear()
    short = run(str(tmp_path / "short"), generations=1, polish=False)
    assert run(str(tmp_path / "short"), generations=3, polish=False)[:len(short)] == short and calls == [5] * 4


def test_storage(spark, tmp_path):
    edges = table(spark, [("a", "b", 1.0, "family"), ("a", "c", 0.5, "ownership")], "src string, dst string, weight double, layer string")
    io.write_edges(edges, f"{tmp_path}/edges")
    assert rows(io.read_edges(spark, f"{tmp_path}/edges", ["family"]), "src", "dst") == [("a", "b")]
    with pytest.raises(Exception):
        io.write_edges(edges, f"{tmp_path}/edges")
    groups = table(spark, [("a", "1"), ("b", "0")], "node string, com string")
    io.write_groups(groups, f"{tmp_path}/groups")
    assert rows(io.read_groups(spark, f"{tmp_path}/groups")) == rows(groups)
    io.sink(groups, f"{tmp_path}/csv", "csv")
    assert rows(io.read_csv(spark, f"{tmp_path}/csv", groups.schema)) == rows(groups)
    io.sink(groups, f"{tmp_path}/csv", "csv", "overwrite")
    assert rows(io.source(spark, f"{tmp_path}/edges", T.StructType([T.StructField("SRC", T.StringType())]))) == [("a",), ("a",)]
    with pytest.raises(io.SchemaMismatch):
        io.expect_schema(groups, T.StructType([T.StructField("node", T.LongType())]))


def test_a_drawn_sample_keeps_the_shares_of_roles_and_layers(spark):
    pairs = [(f"n{a:03d}", f"n{b:03d}", 1.0, "dense") for a in range(120) for b in range(a + 1, 120) if (a + b) % 3]
    pairs += [(f"n{a:03d}", "n120", 1.0, "star") for a in range(120)] + [(f"n{a:03d}", f"n{a + 1:03d}", 1.0, "path") for a in range(0, 120, 3)]
    edges = table(spark, pairs, "src string, dst string, weight double, layer string").dropDuplicates(["src", "dst"])
    roles = table(spark, [(f"n{a:03d}", "hot" if a % 10 else "rare") for a in range(100)], "id string, role string")
    nodes = graph.draw_nodes(edges, roles, 0.64, seed=3)
    drawn = nodes.groupBy("role").count().collect()
    assert {r["role"]: r["count"] for r in drawn} == {"hot": int(90 * 0.8), "rare": int(10 * 0.8), "": int(21 * 0.8)}
    assert sorted(nodes.collect()) == sorted(graph.draw_nodes(edges.repartition(7), roles.repartition(3), 0.64, seed=3).collect())
    everyone = graph.nodes_of(edges).filter("node < 'n118' OR node = 'n120'")
    kept = graph.draw_edges(edges, everyone, seed=3)
    assert kept.columns == edges.columns
    of = {r["layer"]: r["count"] for r in edges.groupBy("layer").count().collect()}
    left = {r["layer"]: r["count"] for r in graph.induced_subgraph(edges, everyone).groupBy("layer").count().collect()}
    part = min(left[x] / of[x] for x in of)
    assert {r["layer"]: r["count"] for r in kept.groupBy("layer").count().collect()} == {x: int(of[x] * part + 1e-9) for x in of}
    both = graph.shares(kept, edges, "layer").collect()
    assert all(abs(r["of_all"] - r["of_sample"]) <= 1 / sum(left.values()) * len(of) for r in both)
    assert graph.draw_edges(edges, everyone.limit(0)).count() == 0 and graph.draw_nodes(edges.limit(0), roles, 0.5).count() == 0


def test_connected_communities_are_connected_and_no_worse(spark):
    draw = random.Random(5)
    pairs = {(min(a, b), max(a, b)) for a, b in ((draw.randrange(60), draw.randrange(60)) for _ in range(110)) if a != b}
    edges = table(spark, [(f"n{a:02d}", f"n{b:02d}", 1.0) for a, b in sorted(pairs)], "src string, dst string, weight double")
    plain, found = louvain.louvain(edges, 1.0), louvain.louvain_connected(edges, 1.0)
    assert found.select("node").distinct().count() == found.count() == graph.nodes_of(edges).count()
    parts = graph.refine_connected(edges, found)
    assert parts.select("community").distinct().count() == found.select("community").distinct().count()
    q = lambda p: partition.modularity(edges, p).first()["modularity"]
    assert q(found) >= q(plain) - 1e-9
    broken = table(spark, [("a", "b", 1.0), ("c", "d", 1.0)], "src string, dst string, weight double")
    joined = table(spark, [(x, "a") for x in "abcd"], "node string, community string")
    again = louvain.climb_connected(broken, 1.0, joined)
    assert sorted(map(tuple, again.collect())) == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "c")]


def hash_exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_ownership_is_shuffled_once_for_its_pairs(spark):
    line = "company string, partner string, capital_pct double, profit_pct double"
    rows_ = [("A", "X", 10.0, 1.0), ("A", "X", 10.0, 1.0), ("A", "X", 30.0, 1.0), ("B", "Y", 0.0, 1.0), (None, "X", 5.0, None), (None, "X", 5.0, None)]
    kept = clean.clean_ownership(table(spark, rows_, line))
    assert Counter(tuple(r) for r in kept.collect()) == Counter([rows_[0], rows_[2], rows_[4]])
    known = table(spark, [("X", 4.0)], "id string, wealth double")
    relations = propagation._relations(kept, F.broadcast(known))
    assert hash_exchanges(relations) == 1
    assert Counter(tuple(r) for r in relations.select("company", "partner", "pct", "seed").collect()) == Counter([("A", "X", 20.0, 4.0), (None, "X", 5.0, 4.0)])


def test_complete_companies_stay_behind(spark):
    """A chain: every round completes one company; the last value reaches nobody, and known partners meet no join."""
    chain = [(f"c{n}", f"c{n + 1}", 100.0) for n in range(5)] + [("c0", "never", 100.0), ("z", "c5", 0.0)]
    own = table(spark, chain, "company string, partner string, capital_pct double")
    known = table(spark, [("c5", 8.0)], "id string, wealth double")
    done = propagation.propagate(own, known)
    assert rows(done) == [("c1", 8.0, 3), ("c2", 8.0, 2), ("c3", 8.0, 1), ("c4", 8.0, 0), ("z", None, 0)]
    _, waiting, _ = propagation._propagate(own, known, 10)
    assert ("c4", "c5") not in {(r["company"], r["partner"]) for r in waiting.collect()}
    part = propagation.incomplete(own, known, 3)
    assert sorted(part.select("company", "partner", "wealth").collect(), key=str) == sorted(
        [("c0", "c1", None), ("c0", "never", None), ("c1", "c2", None), ("c2", "c3", 8.0), ("c3", "c4", 8.0), ("c4", "c5", 8.0), ("z", "c5", 8.0)], key=str)


def test_edges_shuffle_ownership_once(spark):
    rows_ = [("A", "X", 10.0, 1.0, 1, "s"), ("A", "X", 10.0, 1.0, 1, "s"), ("X", "A", 30.0, 1.0, 1, "s"), ("B", None, 5.0, 1.0, 1, "s")]
    df = table(spark, rows_, "company string, partner string, capital_pct double, profit_pct double, period int, source string")
    repeated, distinct = layers.ownership_layer(df, repeats=True), layers.ownership_layer(df)
    assert (repeated.count(), distinct.count()) == (3, 2)
    assert hash_exchanges(layers.build_edges({"ownership": repeated})) == 1
    for how in ("last", "max"):
        edges = [layers.build_edges({"ownership": x}, on_conflict=how) for x in (repeated, distinct)]
        assert rows(edges[0]) == rows(edges[1]) == [("A", "X", 0.3, "ownership")]
    assert rows(layers.build_flagged_edges({"ownership": repeated})) == rows(layers.build_flagged_edges({"ownership": distinct}))
    assert rows(layers.build_edges({"ownership": distinct}, on_conflict="sum"), "weight") == [(0.4,)]


def test_candidates_are_dealt_out_once(spark):
    """What the edges of active nodes lead to is shuffled once, without the nodes' own rows, and a node of one trial is not grouped."""
    edges = layer(spark, *random_edges(40, 90, 3))
    _, near, nodes, trials = louvain.prepared(edges, {0: 1.0, 1: 0.5})
    com = F.shiftleft(F.col("trial").cast("bigint"), louvain.NODE_BITS) + F.col("node")
    alone = nodes.select("node", "trial", com.alias("com"), "k", F.lit(True).alias("on"))
    totals = alone.select("com", F.col("k").alias("tot"), F.lit(1).cast("bigint").alias("size"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = louvain.best_moves(near, louvain.rows_by_node(alone, totals), trials)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "map_from_entries" not in plan and sum("Exchange hashpartitioning" in line and "trial" in line for line in plan.splitlines()) == 2
    one = alone.filter("trial = 0")
    assert "Exchange" not in louvain.gathered(one, True, "at", "trial", "com")._jdf.queryExecution().executedPlan().toString()
    once, more = (louvain.rows_by_node(one, totals, x) for x in (True, False))
    assert sorted(map(str, once.collect())) == sorted(map(str, more.collect()))
    near.release()


def test_start_with_a_node_in_two_communities_is_refused(spark):
    start = table(spark, [("a", "x"), ("a", "y"), ("b", "y")], "node string, community string")
    with pytest.raises(Exception, match="two communities of the start"):
        louvain.louvain(layer(spark, ("a", "b", 1.0)), 1.0, start)


def test_pair_sums_are_dealt_out_before_they_are_summed(spark):
    arcs = table(spark, [("a", "b", 1), ("b", "a", 2), ("a", "c", 5), (None, "a", 7)], "emitter string, receiver string, amount int")
    found = flows.pair_sums(arcs, 600_000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("HashAggregate") < plan.index("Exchange") and ", 3), REPARTITION_BY_NUM" in plan
    assert sorted(map(str, found.collect())) == sorted(map(str, table(spark, [("a", "b", 3.0), ("a", "c", 5.0), ("a", "a", 7.0)], "src string, dst string, weight double").collect()))


@pytest.mark.parametrize("gammas", [{0: 1.0}, {0: 1.0, 1: 0.3}])
def test_ways_to_the_neighbours_agree(spark, monkeypatch, gammas):
    """Candidates are the same however the edges meet the communities; a round over all nodes shuffles edges by node and trial only."""
    _, near, nodes, trials = louvain.prepared(layer(spark, *random_edges(40, 90, 3)), gammas)
    com = F.shiftleft(F.col("trial").cast("bigint"), louvain.NODE_BITS) + F.floor(F.col("node") / 3)
    flat = nodes.select("node", "trial", com.alias("com"), "k", ((F.col("node") + F.col("trial")) % 4 != 0).alias("on"))
    totals = flat.groupBy("com").agg(F.sum("k").alias("tot"), F.count("*").alias("size"))
    state = louvain.rows_by_node(flat, totals, trials.once)
    found = []
    for dense, few in ((-1.0, 0), (2.0, 1000), (2.0, 0)):
        monkeypatch.setattr(louvain, "DENSE", dense)
        monkeypatch.setattr(louvain, "FEW", few)
        moves = louvain.best_moves(near, state, trials)
        plan = moves._jdf.queryExecution().executedPlan().toString()
        assert dense > 0 or "hashpartitioning(near" not in plan
        found.append(sorted(map(str, moves.collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) == flat.filter("on").count()
    near.release()


def test_graph_of_communities_counts_every_edge_both_ways(spark, monkeypatch):
    """Each edge is read from one of its two rows, hubs' too, and the graph has both."""
    monkeypatch.setattr(louvain, "HUB", 6)
    pairs = random_edges(30, 60, 5) + [("hub", f"n{i:02d}", 0.5) for i in range(12)]
    ids, near, nodes, trials = louvain.prepared(layer(spark, *pairs), {0: 1.0})
    assert len(near.read) == 2
    flat = nodes.select("node", "trial", (F.col("node") % 5).alias("com"), "k", F.lit(True).alias("on"))
    totals = flat.groupBy("com").agg(F.sum("k").alias("tot"), F.count("*").alias("size"))
    graph_ = louvain.communities_graph(near, louvain.rows_by_node(flat, totals, True), trials)
    assert graph_._jdf.queryExecution().executedPlan().toString().count("< near#") >= 2
    number, wanted = {r["node"]: r["id"] for r in ids.collect()}, {}
    for a, b, w in pairs:
        x, y = number[a] % 5, number[b] % 5
        if x != y:
            for key in ((x, y), (y, x)):
                wanted[key] = wanted.get(key, 0) + round(w * trials.unit)
    assert {(r["node"], r["near"]): r["weight"] for r in graph_.collect()} == wanted
    near.release()


def test_a_graph_that_fits_a_task_has_no_rounds_of_tables(spark, monkeypatch):
    """Trials of weights and of resolutions, with and without a start, end in the communities that the rounds of tables find."""
    pairs = random_edges(40, 80, 11) + [("n01", "n01", 2.0), ("lone", "lone", 1.0), ("n02", "n03", 0.0)]
    edges = layer(spark, *pairs)
    flagged = layers.build_flagged_edges({"ownership": edges, "family": layer(spark, ("n01", "n07", 1.0), ("x", "y", 1.0)), "accountant": layer(spark, ("n05", "n11", 1.0))})
    start = table(spark, [(1, f"n{i:02d}", str(i % 4)) for i in range(0, 50)] + [(1, "elsewhere", "1")], "trial int, node string, community string")
    runs = [lambda: louvain.louvain_trials(edges, {0: 0.0, 1: 1.0, 2: 0.4}, start),
            lambda: louvain.louvain_trials(flagged, {0: 0.2, 1: 0.4, 5: 1.0}, weights={0: (1.0, 0.5, 0.1), 1: (0.3, 0.0, 0.9), 5: (0.5, 0.5, 0.5)})]
    monkeypatch.setattr(louvain, "WHOLE", 0)
    wanted = [sorted(map(str, run().collect())) for run in runs]
    monkeypatch.undo()
    monkeypatch.setattr(louvain, "stored", None)
    monkeypatch.setattr(louvain, "settle", None)
    assert [sorted(map(str, run().collect())) for run in runs] == wanted


def test_arrays_in_files_and_by_rounds_agree_with_tables(spark, monkeypatch):
    """Files, pieces and ranges of any size give the same, and graphs of communities climbed by rounds are those of the tables."""
    pairs = random_edges(80, 200, 4) + [("hub", f"n{i:02d}", 0.5) for i in range(40)]
    ids, numbered = louvain.numbered(layer(spark, *pairs))
    trials = louvain.Trials({0: 1.0})
    base = louvain.whole(numbered, trials).toPandas()
    names = {r["id"]: r["node"] for r in ids.collect()}

    def found(small, *sizes):
        for name, size in zip(("HELD", "PIECE", "SORTED"), sizes):
            monkeypatch.setattr(arrays, name, size)
        edges, n = arrays.Edges(False), len(names)
        for k in range(0, len(base), 30):
            edges.append(*(base[c].to_numpy()[k:k + 30] for c in ("src", "dst", "weight")))
        k = arrays.strengths(edges, n, None)
        com = arrays.trial(arrays.graph(edges, n), np.arange(n), k, np.ones(n, bool), 1.0, 1.0 / int(k.sum()), louvain.PATIENCE, small,
                           louvain.top_of, louvain.LEAST_GAIN, louvain.STEPS)
        first = {c: names[v] for v, c in reversed(list(enumerate(com)))}
        return {names[v]: first[c] for v, c in enumerate(com)}

    assert found(1000, 1 << 20, 500, 500) == found(1000, 64, 7, 11)
    monkeypatch.setattr(louvain, "SMALL", 0)
    assert found(0, 64, 7, 11) == dict(rows(louvain.louvain(layer(spark, *pairs), 1.0), "node", "community"))
