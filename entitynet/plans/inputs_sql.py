"""The input views again, as DuckDB common table expressions for the SQL checks."""

from __future__ import annotations

VIEWS: dict[str, tuple[list[str], str]] = {}


def _view(name: str, sql: str, needs: list[str] | None = None) -> None:
    VIEWS[name] = (needs or [], sql.strip())


_view("ownership", """
SELECT 'O'||l_orderkey AS company, 'S'||l_suppkey AS partner, l_extendedprice*l_discount/100 AS capital_pct,
       l_extendedprice*l_tax/100 AS profit_pct, 202300 AS period, 'line' AS source FROM lineitem
UNION ALL SELECT 'O'||l_orderkey, 'S'||l_suppkey, l_extendedprice*l_discount/100, l_extendedprice*l_tax/100, 202300, 'line'
  FROM lineitem WHERE l_returnflag = 'R'
UNION ALL SELECT 'S'||s_suppkey, 'H'||s_nationkey, 100.0::DOUBLE, 100.0::DOUBLE, 202300, 'holding' FROM supplier
UNION ALL SELECT 'C'||o_custkey, 'O'||o_orderkey, o_totalprice/10000, o_totalprice/10000, 202300, 'order' FROM orders
""")
_view("naturals", """
SELECT 'C'||c_custkey AS id, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS value FROM customer
WHERE c_mktsegment IN ('HOUSEHOLD','FURNITURE','MACHINERY')
""")
_view("family", """
SELECT 'C'||c_custkey AS id,
  'C'||(CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN c_custkey ELSE xor(c_custkey, 1) END) AS relative,
  CASE c_mktsegment WHEN 'FURNITURE' THEN 'HIJO' WHEN 'MACHINERY' THEN 'CONYUGE' WHEN 'HOUSEHOLD' THEN 'CONYUGE'
       WHEN 'AUTOMOBILE' THEN 'TIPO_RELACION' ELSE 'HERMANO' END AS kind
FROM customer
""")
_view("accountant", """
SELECT 'C'||c_custkey AS id, CASE WHEN c_acctbal >= 0 THEN 'K'||c_nationkey END AS accountant FROM customer
UNION ALL SELECT 'C'||c_custkey, 'C'||xor(c_custkey, 1) FROM customer WHERE c_mktsegment = 'MACHINERY'
""")
_view("representative", """
SELECT 'C'||o_custkey AS id, 'R'||strftime(o_orderdate, '%Y%m%d') AS rep, CAST(o_orderdate AS DATE) AS start_day,
  CASE WHEN o_orderstatus <> 'O' THEN shipped END AS end_day
FROM orders LEFT JOIN (SELECT l_orderkey, CAST(max(l_shipdate) AS DATE) AS shipped FROM lineitem GROUP BY 1) x
  ON o_orderkey = l_orderkey
UNION ALL SELECT 'C'||xor(c_custkey, 1), 'C'||c_custkey, DATE '1999-01-01', NULL FROM customer
  WHERE c_mktsegment = 'FURNITURE'
""")
_view("raw_groups", """
SELECT 'C'||c_custkey AS id, CAST(c_nationkey + 1 AS VARCHAR) AS com FROM customer WHERE c_mktsegment <> 'BUILDING'
UNION ALL SELECT 'C'||c_custkey, CAST(c_nationkey + 1 AS VARCHAR) FROM customer WHERE c_mktsegment = 'FURNITURE'
UNION ALL SELECT 'C'||c_custkey, '99' FROM customer WHERE c_acctbal > 9000
UNION ALL SELECT 'S'||s_suppkey, CAST(s_nationkey + 1 AS VARCHAR) FROM supplier WHERE s_acctbal > 0
""")
_view("known", "SELECT DISTINCT id, com FROM raw_groups", ["raw_groups"])
_view("arcs", """
SELECT 'S'||l_suppkey AS emitter, 'C'||o_custkey AS receiver,
  CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)) AS amount
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
UNION ALL SELECT 'C'||o_custkey, 'S'||l_suppkey,
  CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2))
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'
""")
_view("wealth_text", """
SELECT 'S'||s_suppkey AS id, CASE WHEN s_acctbal > 9500 THEN 'sin dato'
  ELSE format('{:,}', CAST(round(s_acctbal*1000) AS BIGINT)) END AS wealth FROM supplier
""")
_view("wealth_num", """
SELECT 'S'||s_suppkey AS id, round(s_acctbal * CASE WHEN s_acctbal < 3000 THEN 1100 ELSE 1000 END, 2) AS wealth
FROM supplier WHERE s_acctbal < 6000
UNION ALL SELECT 'H'||c_nationkey, CAST(sum(CAST(c_acctbal AS DECIMAL(12,2))) * 1000 AS DOUBLE)
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name <> 'EUROPE' GROUP BY c_nationkey
""")
_view("payroll", """
SELECT 'C'||o_custkey AS employer, '0' AS dv, year(o_orderdate)*100 AS period, 'W'||l_partkey AS worker,
  CASE WHEN NOT (year(o_orderdate) = 2001 AND o_orderpriority = '5-LOW')
       THEN CAST(l_extendedprice AS DECIMAL(12,2)) END AS income,
  CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)) AS tax,
  CASE WHEN l_discount > 0 THEN CAST(l_discount AS DECIMAL(4,2)) END AS zone
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""")
_view("fees", """
SELECT 'C'||o_custkey AS payer, year(o_orderdate)*100 AS period, 'W'||l_partkey AS worker,
  CAST(l_extendedprice AS DECIMAL(12,2)) AS fee,
  CASE WHEN l_linenumber = 1 THEN l_discount END AS dir10, CASE WHEN l_linenumber = 2 THEN l_tax END AS dir20
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""")
_view("balance", "SELECT 'C'||c_custkey AS id, c_acctbal AS value FROM customer")
_view("activity", """
SELECT 'C'||o_custkey AS id, l_partkey AS code FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""")
_view("activity_dim", """
SELECT p_partkey AS code, p_name AS activity, p_brand AS subsector, p_type AS sector FROM part
""")
_view("sales", """
SELECT 'C'||o_custkey AS emitter, s_nationkey AS place
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
""")
_view("place_dict", """
SELECT n_nationkey AS place, CASE WHEN n_regionkey = 0 THEN replace(n_name, 'N', chr(65533)) ELSE n_name END AS name
FROM nation WHERE n_name <> 'NATION_24'
""")
_view("region_dim", """
SELECT n_name AS name, 'R'||lpad(CAST(n_nationkey AS VARCHAR), 2, '0')||' '||r_name AS region
FROM nation JOIN region ON n_regionkey = r_regionkey
""")
_view("addresses", "SELECT 'C'||c_custkey AS id, c_nationkey AS place FROM customer")
_view("emails", """
SELECT 'C'||c_custkey AS id,
  CASE WHEN c_acctbal >= 0 THEN lower(c_mktsegment)||'@n'||c_nationkey END AS email FROM customer
""")
_view("partitions", """
SELECT r.resolution, x.node, CASE r.resolution WHEN 0.0 THEN a WHEN 0.5 THEN b ELSE b||'-'||c END AS community
FROM (SELECT 'C'||c_custkey AS node, CAST(n_regionkey AS VARCHAR) AS a, c_mktsegment AS b,
             CAST(c_nationkey AS VARCHAR) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey
      UNION ALL
      SELECT 'S'||s_suppkey, CAST(n_regionkey AS VARCHAR), 'SUPPLIER', CAST(s_nationkey AS VARCHAR)
      FROM supplier JOIN nation ON s_nationkey = n_nationkey) x,
     (VALUES (0.0::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) r(resolution)
""")


def with_views(body: str, *names: str, more: str = "") -> str:
    """``WITH`` the named views (and what they need), then ``more`` CTEs, then ``body``."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in VIEWS[name][0]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    ctes = [f"{n} AS (\n{VIEWS[n][1]}\n)" for n in ordered]
    if more.strip():
        ctes.append(more.strip().rstrip(","))
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body.strip()
