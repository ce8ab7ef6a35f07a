"""The engine's input tables as views over the given star schema.

Every view reads its driver tables whole. Ids carry a prefix: C customer, S supplier,
O order, H holding of a nation, K accountant, R representative, W worker. Which rows
are duplicated, blank, zero or labelled twice follows from column values, so that each
operator meets the irregularities it exists for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

PERIOD = 202300
WINDOW = ("2000-01-01", "2001-01-01")
FAMILY_KINDS = ["HIJO", "CONYUGE"]
PERIODS = [199900, 200000, 200100]
NORTH = ["R03 "]
SOUTH = ["R21 "]


def _id(prefix: str, key: Column | str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.concat(F.lit(prefix), key.cast("string"))


def _money(name: str) -> Column:
    return F.col(name).cast("decimal(12,2)")


class Inputs:
    """Lazy input views for one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def ownership(self) -> DataFrame:
        """(company, partner, capital_pct, profit_pct, period, source); returned lines come twice."""
        def level(df, company, partner, capital, profit, source):
            return df.select(
                company.alias("company"), partner.alias("partner"),
                capital.cast("double").alias("capital_pct"), profit.cast("double").alias("profit_pct"),
                F.lit(PERIOD).alias("period"), F.lit(source).alias("source"),
            )

        line = self.table("lineitem")
        lines = [
            level(part, _id("O", "l_orderkey"), _id("S", "l_suppkey"),
                  F.col("l_extendedprice") * F.col("l_discount") / 100,
                  F.col("l_extendedprice") * F.col("l_tax") / 100, "line")
            for part in (line, line.filter(F.col("l_returnflag") == "R"))
        ]
        holdings = level(self.table("supplier"), _id("S", "s_suppkey"), _id("H", "s_nationkey"),
                         F.lit(100), F.lit(100), "holding")
        orders = level(self.table("orders"), _id("C", "o_custkey"), _id("O", "o_orderkey"),
                       F.col("o_totalprice") / 10000, F.col("o_totalprice") / 10000, "order")
        return reduce(DataFrame.unionByName, [*lines, holdings, orders])

    def natural(self) -> DataFrame:
        """(id, value) of natural persons; the value is null for a negative balance."""
        c = self.table("customer").filter(F.col("c_mktsegment").isin("HOUSEHOLD", "FURNITURE", "MACHINERY"))
        return c.select(_id("C", "c_custkey").alias("id"),
                        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("value"))

    def family(self) -> DataFrame:
        """(id, relative, kind), with self relations and a leaked header value."""
        pair = F.col("c_custkey").bitwiseXOR(F.lit(1))
        segment = F.col("c_mktsegment")
        kind = (
            F.when(segment == "FURNITURE", "HIJO")
            .when(segment.isin("MACHINERY", "HOUSEHOLD"), "CONYUGE")
            .when(segment == "AUTOMOBILE", "TIPO_RELACION")
            .otherwise("HERMANO")
        )
        return self.table("customer").select(
            _id("C", "c_custkey").alias("id"),
            _id("C", F.when(segment == "HOUSEHOLD", F.col("c_custkey")).otherwise(pair)).alias("relative"),
            kind.alias("kind"),
        )

    def accountant(self) -> DataFrame:
        """(id, accountant): 25 hubs, null for a negative balance, and pairs also in the family table."""
        c = self.table("customer")
        hubs = c.select(_id("C", "c_custkey").alias("id"),
                        F.when(F.col("c_acctbal") >= 0, _id("K", "c_nationkey")).alias("accountant"))
        kin = c.filter(F.col("c_mktsegment") == "MACHINERY").select(
            _id("C", "c_custkey").alias("id"),
            _id("C", F.col("c_custkey").bitwiseXOR(F.lit(1))).alias("accountant"))
        return hubs.unionByName(kin)

    def representative(self) -> DataFrame:
        """(id, rep, start, end): one representative per order day, open ends, and reversed family pairs."""
        shipped = self.table("lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").cast("date").alias("shipped"))
        orders = self.table("orders")
        rows = orders.join(shipped, orders.o_orderkey == shipped.l_orderkey, "left").select(
            _id("C", "o_custkey").alias("id"),
            F.concat(F.lit("R"), F.date_format("o_orderdate", "yyyyMMdd")).alias("rep"),
            F.col("o_orderdate").cast("date").alias("start"),
            F.when(F.col("o_orderstatus") != "O", F.col("shipped")).alias("end"),
        )
        kin = self.table("customer").filter(F.col("c_mktsegment") == "FURNITURE").select(
            _id("C", F.col("c_custkey").bitwiseXOR(F.lit(1))).alias("id"),
            _id("C", "c_custkey").alias("rep"),
            F.lit("1999-01-01").cast("date").alias("start"),
            F.lit(None).cast("date").alias("end"),
        )
        return rows.unionByName(kin)

    def groups(self) -> DataFrame:
        """(id, com): duplicates, unlabelled ids, and members of two groups (99 is the second)."""
        c = self.table("customer")
        s = self.table("supplier")
        labelled = c.filter(F.col("c_mktsegment") != "BUILDING")
        parts = [
            labelled.select(_id("C", "c_custkey").alias("id"), (F.col("c_nationkey") + 1).cast("string").alias("com")),
            labelled.filter(F.col("c_mktsegment") == "FURNITURE")
            .select(_id("C", "c_custkey").alias("id"), (F.col("c_nationkey") + 1).cast("string").alias("com")),
            c.filter(F.col("c_acctbal") > 9000).select(_id("C", "c_custkey").alias("id"), F.lit("99").alias("com")),
            s.filter(F.col("s_acctbal") > 0)
            .select(_id("S", "s_suppkey").alias("id"), (F.col("s_nationkey") + 1).cast("string").alias("com")),
        ]
        return reduce(DataFrame.unionByName, parts)

    def arcs(self) -> DataFrame:
        """(emitter, receiver, amount): tax on each line, and the way back for returned lines."""
        line, orders = self.table("lineitem"), self.table("orders")
        flows = line.join(orders, line.l_orderkey == orders.o_orderkey).select(
            _id("S", "l_suppkey").alias("seller"), _id("C", "o_custkey").alias("buyer"),
            (_money("l_extendedprice") * F.col("l_tax").cast("decimal(4,2)")).alias("amount"), "l_returnflag")
        ways = F.when(
            F.col("l_returnflag") == "R",
            F.array(F.struct(F.col("seller").alias("e"), F.col("buyer").alias("r")),
                    F.struct(F.col("buyer").alias("e"), F.col("seller").alias("r"))),
        ).otherwise(F.array(F.struct(F.col("seller").alias("e"), F.col("buyer").alias("r"))))
        return flows.select(F.explode(ways).alias("way"), "amount").select(
            F.col("way.e").alias("emitter"), F.col("way.r").alias("receiver"), "amount")

    def wealth_text(self) -> DataFrame:
        """(id, wealth): money as text with commas; the largest are not parsable."""
        units = F.round(F.col("s_acctbal") * 1000)
        return self.table("supplier").select(
            _id("S", "s_suppkey").alias("id"),
            F.when(F.col("s_acctbal") > 9500, F.lit("sin dato")).otherwise(F.format_number(units, 0)).alias("wealth"))

    def wealth_num(self) -> DataFrame:
        """(id, wealth): small suppliers differ from the text source, middle ones agree, holdings are new."""
        s = self.table("supplier").filter(F.col("s_acctbal") < 6000).select(
            _id("S", "s_suppkey").alias("id"),
            F.round(F.col("s_acctbal") * F.when(F.col("s_acctbal") < 3000, 1100).otherwise(1000), 2).alias("wealth"))
        c, n, r = self.table("customer"), self.table("nation"), self.table("region")
        h = (
            c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
            .filter(F.col("r_name") != "EUROPE")
            .groupBy("c_nationkey")
            .agg((F.sum(_money("c_acctbal")) * 1000).cast("double").alias("wealth"))
            .select(_id("H", "c_nationkey").alias("id"), "wealth")
        )
        return s.unionByName(h)

    def payroll(self) -> DataFrame:
        """(employer, dv, period, worker, income, tax, zone): income is missing for low-priority 2001 orders."""
        line, orders = self.table("lineitem"), self.table("orders")
        period = F.year("o_orderdate") * 100
        missing = (period == 200100) & (F.col("o_orderpriority") == "5-LOW")
        return line.join(orders, line.l_orderkey == orders.o_orderkey).select(
            _id("C", "o_custkey").alias("employer"), F.lit("0").alias("dv"), period.alias("period"),
            _id("W", "l_partkey").alias("worker"),
            F.when(~missing, _money("l_extendedprice")).alias("income"),
            (_money("l_extendedprice") * F.col("l_tax").cast("decimal(4,2)")).alias("tax"),
            F.when(F.col("l_discount") > 0, F.col("l_discount").cast("decimal(4,2)")).alias("zone"))

    def fees(self) -> DataFrame:
        """(payer, period, worker, fee, dir10, dir20): retentions, null unless the line is the first or second."""
        line, orders = self.table("lineitem"), self.table("orders")
        return line.join(orders, line.l_orderkey == orders.o_orderkey).select(
            _id("C", "o_custkey").alias("payer"), (F.year("o_orderdate") * 100).alias("period"),
            _id("W", "l_partkey").alias("worker"), _money("l_extendedprice").alias("fee"),
            F.when(F.col("l_linenumber") == 1, F.col("l_discount")).alias("dir10"),
            F.when(F.col("l_linenumber") == 2, F.col("l_tax")).alias("dir20"))

    def balance(self) -> DataFrame:
        """(id, value): one number per customer, skewed and partly negative."""
        return self.table("customer").select(_id("C", "c_custkey").alias("id"), F.col("c_acctbal").alias("value"))

    def activity(self) -> DataFrame:
        """(id, code): what a customer buys."""
        line, orders = self.table("lineitem"), self.table("orders")
        return line.join(orders, line.l_orderkey == orders.o_orderkey).select(
            _id("C", "o_custkey").alias("id"), F.col("l_partkey").alias("code"))

    def activity_dim(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("code"), F.col("p_name").alias("activity"),
                                         F.col("p_brand").alias("subsector"), F.col("p_type").alias("sector"))

    def sales(self) -> DataFrame:
        """(emitter, place): a customer's points of sale are the nations of the suppliers."""
        line, orders, s = self.table("lineitem"), self.table("orders"), self.table("supplier")
        return (
            line.join(orders, line.l_orderkey == orders.o_orderkey)
            .join(s, line.l_suppkey == s.s_suppkey)
            .select(_id("C", "o_custkey").alias("emitter"), F.col("s_nationkey").alias("place")))

    def place_dict(self) -> DataFrame:
        """(place, name): region-0 names are broken, the last nation is unmapped."""
        n = self.table("nation")
        name = F.when(F.col("n_regionkey") == 0, F.replace("n_name", F.lit("N"), F.lit("�"))).otherwise(F.col("n_name"))
        return n.filter(F.col("n_name") != "NATION_24").select(F.col("n_nationkey").alias("place"), name.alias("name"))

    def region_dim(self) -> DataFrame:
        n, r = self.table("nation"), self.table("region")
        return n.join(r, n.n_regionkey == r.r_regionkey).select(
            F.col("n_name").alias("name"),
            F.concat(F.lit("R"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"), F.lit(" "), "r_name").alias("region"))

    def addresses(self) -> DataFrame:
        """(id, place) of customers."""
        return self.table("customer").select(_id("C", "c_custkey").alias("id"), F.col("c_nationkey").alias("place"))

    def emails(self) -> DataFrame:
        """(id, email): shared per segment and nation, missing for a negative balance."""
        address = F.concat(F.lower("c_mktsegment"), F.lit("@n"), F.col("c_nationkey").cast("string"))
        return self.table("customer").select(_id("C", "c_custkey").alias("id"),
                                             F.when(F.col("c_acctbal") >= 0, address).alias("email"))

    def partitions(self) -> DataFrame:
        """(resolution, node, community): fixed partitions of customers and suppliers to score."""
        c, s, n = self.table("customer"), self.table("supplier"), self.table("nation")
        cust = c.join(n, c.c_nationkey == n.n_nationkey).select(
            _id("C", "c_custkey").alias("node"), F.col("n_regionkey").cast("string").alias("a"),
            F.col("c_mktsegment").alias("b"), F.col("c_nationkey").cast("string").alias("c"))
        supp = s.join(n, s.s_nationkey == n.n_nationkey).select(
            _id("S", "s_suppkey").alias("node"), F.col("n_regionkey").cast("string").alias("a"),
            F.lit("SUPPLIER").alias("b"), F.col("s_nationkey").cast("string").alias("c"))
        return cust.unionByName(supp).select("node", F.explode(F.array(
            F.struct(F.lit(0.0).alias("resolution"), F.col("a").alias("community")),
            F.struct(F.lit(0.5).alias("resolution"), F.col("b").alias("community")),
            F.struct(F.lit(1.0).alias("resolution"), F.concat("b", F.lit("-"), "c").alias("community")),
        )).alias("p")).select("p.resolution", "node", "p.community")
