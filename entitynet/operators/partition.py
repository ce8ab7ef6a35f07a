"""Scores of a partition: modularity and adjusted mutual information.

``by`` names extra key columns (resolution, trial), so a whole sweep is scored in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from entitynet.functions.ranking import ordered_prefix
from entitynet.functions.scalars import log_factorial
from entitynet.session import cut


def modularity(edges: DataFrame, partition: DataFrame, gamma: float = 1.0, by: list[str] | None = None) -> DataFrame:
    """Weighted modularity: sum over communities of L/m - gamma (d/2m)^2.

    ``edges`` may lack the ``by`` columns: then every partition is scored on the same graph.
    A partition that misses an edge's end, or holds it twice, is an error. The partition is
    written out, so that both joins are plain shuffles and the edges of a hub can be split.
    """
    by = by or []
    shared = [c for c in by if c in edges.columns]
    partition = cut(partition.select(*by, "node", "community"))
    side = lambda end: partition.select(
        *by, F.col("node").alias(end), F.col("community").alias(f"{end}_c"))
    placed = edges.join(side("src"), [*shared, "src"]).join(side("dst"), [*by, "dst"])
    ends = placed.select(
        *by, "weight", (F.col("src_c") == F.col("dst_c")).alias("inside"),
        F.posexplode(F.array("src_c", "dst_c")).alias("side", "community"))
    per = ends.groupBy(*by, "community").agg(
        F.sum("weight").alias("d"), F.count_if(F.col("side") == 0).alias("n"),
        F.sum(F.when(F.col("inside") & (F.col("side") == 0), F.col("weight")).otherwise(0.0)).alias("l"))
    sums = per.groupBy(*by).agg(F.sum("d").alias("m2"), F.sum("l").alias("l"), F.sum(F.col("d") * F.col("d")).alias("dd"),
                                F.sum("n").alias("n"))
    wanted = edges.groupBy(*shared).agg(F.count("*").alias("edges"))
    sums = sums.join(wanted, shared, "left") if shared else sums.withColumn("edges", wanted.scalar())
    q = F.try_divide(2 * F.col("l"), F.col("m2")) - gamma * F.try_divide(F.col("dd"), F.col("m2") * F.col("m2"))
    whole = F.when(F.coalesce("n", F.lit(0)) == F.col("edges"), q).otherwise(
        F.raise_error(F.lit("a node is missing from the partition, or in it twice")).cast("double"))
    return sums.select(*by, whole.alias("modularity"))


def improving_moves_of_sweep(edges: DataFrame, partitions: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(resolution, node, community, gain): moves of one node to a neighbour's community that raise modularity at that resolution.

    The gain is in parts of the node's strength; those up to ``tolerance`` are not listed.
    """
    by = ["resolution"]
    partitions = cut(partitions.select(*by, "node", "community"))
    ways = F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("near")), F.struct(F.col("dst").alias("node"), F.col("src").alias("near")))
    both = edges.select("weight", F.explode(ways).alias("w")).select("w.node", "w.near", "weight")
    strength = cut(both.groupBy("node").agg(F.sum("weight").alias("k")))
    placed = cut(partitions.join(strength, "node"))
    totals = cut(placed.groupBy(*by, "community").agg(F.sum("k").alias("tot")))
    kin = cut(both.filter("node <> near").join(partitions.withColumnRenamed("node", "near"), "near").groupBy(*by, "node", "community").agg(
        F.sum("weight").alias("kin")))
    pull = F.col("resolution") * F.col("k") / strength.agg(F.sum("k")).scalar()
    options = kin.join(totals, [*by, "community"]).join(placed.withColumnRenamed("community", "own"), [*by, "node"])
    worth = options.withColumn("worth", F.col("kin") - pull * (F.col("tot") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0.0)))
    here = worth.filter("community = own").select(*by, "node", F.col("worth").alias("here"))
    alone = placed.join(totals, [*by, "community"]).select(*by, "node", (-pull * (F.col("tot") - F.col("k"))).alias("without"))
    best = worth.filter("community <> own").join(here, [*by, "node"], "left").join(alone, [*by, "node"])
    gain = (F.col("worth") - F.coalesce("here", "without")) / F.col("k")
    return best.select(*by, "node", "community", gain.alias("gain")).filter(F.col("gain") > tolerance)


def improving_moves(edges: DataFrame, partition: DataFrame, gamma: float = 1.0, tolerance: float = 1e-9) -> DataFrame:
    """(node, community, gain) of one partition at resolution ``gamma``."""
    return improving_moves_of_sweep(edges, partition.withColumn("resolution", F.lit(float(gamma))), tolerance).drop("resolution")


def _sizes(counts: DataFrame, by: list[str], label: str, size: str) -> DataFrame:
    """(by, size, times): how many clusters have each size. At most sqrt(2N) sizes differ."""
    clusters = counts.groupBy(*by, label).agg(F.sum("n").alias(size))
    return clusters.groupBy(*by, size).agg(F.count("*").alias("times"))


def _expected_mi(counts: DataFrame, totals: DataFrame, by: list[str], truth: str, found: str) -> DataFrame:
    """Expected mutual information under random labels with the same cluster sizes.

    The hypergeometric sum runs over pairs of distinct sizes. Sizes on one side are held as
    one array per key: N rows have at most sqrt(2N) distinct cluster sizes, so the array
    stays small, and the work is spread over the sizes of the other side. Of the overlaps
    only those within 6 sqrt(min(a, b)) + 1 of the mean are added: by Hoeffding's bound the
    others together weigh less than 1e-30.
    """
    a = _sizes(counts, by, truth, "a").withColumnRenamed("times", "ta")
    b = _sizes(counts, by, found, "b").groupBy(*by).agg(F.collect_list(F.struct("b", "times")).alias("bs"))
    if by:
        pairs = a.join(b.join(totals, by), by)
    else:
        pairs = a.withColumns({"size": totals.scalar(), "bs": b.scalar()})
    pairs = pairs.select(*by, "a", "ta", "size", F.explode("bs").alias("_b")).select(
        *by, "a", "ta", F.col("size").alias("nn"), F.col("_b.b").alias("b"), F.col("_b.times").alias("tb"))
    reach = 6 * F.sqrt(F.least("a", "b").cast("double")) + 1
    mean = F.col("a").cast("double") * F.col("b") / F.col("nn")
    lo = F.greatest(F.lit(1).cast("bigint"), F.col("a") + F.col("b") - F.col("nn"), F.floor(mean - reach))
    hi = F.least(F.col("a"), F.col("b"), F.ceil(mean + reach))
    bounded = pairs.withColumns({"lo": lo, "hi": hi}).filter(F.col("lo") <= F.col("hi")).select(
        *by, "a", "b", "nn", "ta", "tb", "lo", "hi",
        (log_factorial(F.col("a")) + log_factorial(F.col("b")) + log_factorial(F.col("nn") - F.col("a"))
         + log_factorial(F.col("nn") - F.col("b")) - log_factorial(F.col("nn"))).alias("fixed"))
    nn = F.col("nn")

    def term(k: Column) -> Column:
        log_p = (F.col("fixed") - log_factorial(k) - log_factorial(F.col("a") - k) - log_factorial(F.col("b") - k)
                 - log_factorial(nn - F.col("a") - F.col("b") + k))
        return (k / nn) * F.ln(nn.cast("double") * k / (F.col("a").cast("double") * F.col("b"))) * F.exp(log_p)

    # The overlaps of a pair of sizes are folded in place: no row is made for them.
    folded = F.aggregate(F.sequence("lo", "hi"), F.lit(0.0), lambda total, k: total + term(k))
    weighted = F.col("ta").cast("double") * F.col("tb") * folded
    return bounded.groupBy(*by).agg(F.sum(weighted).alias("emi"))


def ami(df: DataFrame, truth: str, found: str, by: list[str] | None = None) -> DataFrame:
    """(by, n, mi, emi, ami) over the rows where both labels are known.

    Adjusted for chance with the arithmetic mean of the entropies (Vinh, Epps & Bailey 2010).
    Logarithms are natural. Two trivial partitions, or an exact hit, score 1.
    """
    by = by or []
    counts = df.filter(F.col(truth).isNotNull() & F.col(found).isNotNull()).groupBy(*by, truth, found).agg(
        F.count("*").alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("size"))

    def plogp(label: str | None, name: str) -> DataFrame:
        clusters = counts if label is None else counts.groupBy(*by, label).agg(F.sum("n").alias("n"))
        x = F.col("n").cast("double")
        return clusters.groupBy(*by).agg(F.sum(x * F.ln(x)).alias(name), F.count("*").alias(f"{name}_k"))

    emi = _expected_mi(counts, totals, by, truth, found)
    parts = [plogp(None, "joint"), plogp(truth, "left"), plogp(found, "right"), emi]
    scored = totals
    if by:
        for part in parts:
            scored = scored.join(part, by)
    else:
        for part in parts:
            row = part.select(F.struct(*part.columns)).scalar()
            scored = scored.withColumn("_r", row).select(*scored.columns, "_r.*")
    n = F.col("size").cast("double")
    h_left = F.ln(n) - F.col("left") / n
    h_right = F.ln(n) - F.col("right") / n
    mi = F.ln(n) + (F.col("joint") - F.col("left") - F.col("right")) / n
    values = scored.select(*by, "size", "left_k", "right_k", h_left.alias("hl"), h_right.alias("hr"),
                           mi.alias("mi"), "emi")
    top = F.col("mi") - F.col("emi")
    bottom = (F.col("hl") + F.col("hr")) / 2 - F.col("emi")
    trivial = (F.col("left_k") == 1) & (F.col("right_k") == 1)
    flat = F.abs(bottom) < 1e-12
    score = (F.when(trivial, 1.0).when(flat, F.when(F.abs(top) < 1e-12, 1.0).otherwise(0.0))
             .otherwise(F.try_divide(top, bottom)))
    return values.select(*by, F.col("size").alias("n"), "mi", "emi", score.alias("ami"))


def ami_sweep(partitions: DataFrame, truth: DataFrame, by: str = "resolution") -> DataFrame:
    """AMI of every partition in a long (by, node, community) table against (id, com)."""
    labelled = partitions.join(truth.select(F.col("id").alias("node"), "com"), "node")
    return ami(labelled, "com", "community", [by])


def sweep_summary(scores: DataFrame, by: str = "resolution", score: str = "ami") -> DataFrame:
    """Mean and best score, and where the best is reached (the smallest key on a tie)."""
    return scores.agg(F.avg(score).alias(f"mean_{score}"), F.max(score).alias(f"best_{score}"),
                      F.min_by(by, F.struct((-F.col(score)).alias("s"), F.col(by).alias("k"))).alias(f"best_{by}"))


def community_labels(partition: DataFrame) -> DataFrame:
    """(node, label): communities numbered from 1 by falling size, then smallest node."""
    sizes = partition.groupBy("community").agg(F.count("*").alias("members"), F.min("node").alias("first"))
    numbered = ordered_prefix(sizes, [F.desc("members"), F.asc("first")], name="position")
    numbers = cut(numbered.select("community", (F.col("position") + 1).alias("label")))
    return partition.join(numbers, "community").select("node", "label")


def label_nodes(nodes: DataFrame, partition: DataFrame) -> DataFrame:
    """The node table with its community number; null for a node outside the graph."""
    labels = community_labels(partition).withColumnRenamed("node", "id")
    return nodes.join(labels, "id", "left")


def communities(partition: DataFrame) -> DataFrame:
    """(community, members, first_member) per community; the members stay rows of the partition."""
    return partition.groupBy("community").agg(F.count("*").alias("members"), F.min("node").alias("first_member"))


def export_wide(partitions: DataFrame, resolutions: list[float]) -> DataFrame:
    """One column per resolution, named comunidad_<resolution> without the dot."""
    name = {r: "comunidad_" + f"{r:.1f}".replace(".", "_") for r in resolutions}
    wide = partitions.groupBy("node").pivot("resolution", resolutions).agg(F.first("community"))
    return wide.withColumnsRenamed({str(r): n for r, n in name.items()})


def result_wide(nodes: DataFrame, partitions: DataFrame, scores: DataFrame, resolutions: list[float]) -> DataFrame:
    """``nodes`` (with ``id``) with comunidad_<r> and modularidad_<r> of each resolution; null outside the graph.

    ``scores`` is (resolution, modularity): one number per resolution, repeated on every row.
    """
    name = {r: "modularidad_" + f"{r:.1f}".replace(".", "_") for r in resolutions}
    wide = export_wide(partitions, resolutions).withColumnRenamed("node", "id")
    return nodes.join(wide, "id", "left").withColumns({
        n: scores.filter(F.col("resolution") == r).select("modularity").scalar() for r, n in name.items()})
