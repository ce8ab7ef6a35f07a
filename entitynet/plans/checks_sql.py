"""DuckDB SQL for the registered queries, over whole tables and with the same column names."""

from __future__ import annotations

from entitynet.plans.inputs_sql import with_views

CHECKS: dict[str, str] = {}


def check(name: str, body: str, *views: str, more: str = "") -> None:
    CHECKS[name] = with_views(body, *views, more=more)


# --- known groups and flows -------------------------------------------------------------

check("known_groups", "SELECT id, com FROM known", "known")
check("known_groups_min_size", """
SELECT id, com FROM known WHERE com IN (SELECT com FROM known GROUP BY com HAVING count(*) >= 5)""", "known")

LABELLED = """
labelled AS (
  SELECT a.emitter, a.receiver, a.amount, e.com AS emitter_com, r.com AS receiver_com
  FROM arcs a LEFT JOIN known e ON a.emitter = e.id LEFT JOIN known r ON a.receiver = r.id
  WHERE a.amount > 0 AND (e.com IS NOT NULL OR r.com IS NOT NULL)
)"""
check("labelled_arcs", """
SELECT emitter, receiver, CAST(amount AS DOUBLE) AS amount, emitter_com, receiver_com FROM labelled""",
      "arcs", "known", more=LABELLED)


def _flows(extra_e: str, extra_r: str) -> str:
    return LABELLED + f""",
ie AS (SELECT emitter_com AS com, sum(amount) AS v FROM labelled WHERE emitter_com = receiver_com GROUP BY 1),
ee AS (SELECT emitter_com AS com, sum(amount) AS v FROM labelled WHERE {extra_e} GROUP BY 1),
ir AS (SELECT receiver_com AS com, sum(amount) AS v FROM labelled WHERE emitter_com = receiver_com GROUP BY 1),
er AS (SELECT receiver_com AS com, sum(amount) AS v FROM labelled WHERE {extra_r} GROUP BY 1),
flow AS (
  SELECT com, CAST(ie.v AS DOUBLE) AS intra_emission, CAST(ee.v AS DOUBLE) AS extra_emission,
         CAST(ir.v AS DOUBLE) AS intra_reception, CAST(er.v AS DOUBLE) AS extra_reception
  FROM ie FULL JOIN ee USING (com) FULL JOIN ir USING (com) FULL JOIN er USING (com)
)"""


FLOWS = _flows("emitter_com <> receiver_com", "emitter_com <> receiver_com")
check("group_flows", "SELECT * FROM flow", "arcs", "known", more=FLOWS)
check("group_flows_with_unlabelled", "SELECT * FROM flow", "arcs", "known", more=_flows(
    "emitter_com IS NOT NULL AND emitter_com IS DISTINCT FROM receiver_com",
    "receiver_com IS NOT NULL AND emitter_com IS DISTINCT FROM receiver_com"))
KPIS = FLOWS + """,
kpi AS (
  SELECT g.com, members, intra_emission, extra_emission, intra_reception, extra_reception,
    extra_reception / nullif(intra_reception + extra_reception, 0) * 100 AS pct_extra_reception,
    extra_emission / nullif(intra_emission + extra_emission, 0) * 100 AS pct_extra_emission,
    intra_emission / nullif(extra_emission, 0) AS emission_ratio
  FROM (SELECT com, count(*) AS members FROM known GROUP BY com) g LEFT JOIN flow f ON g.com = f.com
)"""
check("group_flow_kpis", """
SELECT com, members, intra_emission, extra_emission, intra_reception, extra_reception,
  round(pct_extra_reception, 6) AS pct_extra_reception, round(pct_extra_emission, 6) AS pct_extra_emission,
  round(emission_ratio, 6) AS emission_ratio FROM kpi""", "arcs", "known", more=KPIS)
check("inward_groups", """
SELECT count(*) FILTER (WHERE emission_ratio > 0.05) AS inward_groups, count(*) AS groups FROM kpi""",
      "arcs", "known", more=KPIS)

# --- cleaning ---------------------------------------------------------------------------

CLEAN = """
clean AS (SELECT DISTINCT company, partner, capital_pct, profit_pct FROM ownership WHERE capital_pct <> 0)"""
check("ownership_clean", "SELECT * FROM clean", "ownership", more=CLEAN)
check("ownership_report", """
SELECT CAST((SELECT count(*) FROM ownership) AS BIGINT) AS n_rows, count(*) AS distinct_rows,
  count(*) FILTER (WHERE n > 1) AS repeated_rows,
  (SELECT count(*) FROM ownership WHERE capital_pct IS NULL OR profit_pct IS NULL) AS null_pct_rows,
  count(*) FILTER (WHERE capital_pct = 0 OR profit_pct = 0) AS any_zero,
  count(*) FILTER (WHERE capital_pct = 0 AND profit_pct = 0) AS both_zero,
  count(*) FILTER (WHERE capital_pct = 0) AS zero_capital, count(*) FILTER (WHERE profit_pct = 0) AS zero_profit
FROM (SELECT company, partner, capital_pct, profit_pct, count(*) AS n FROM ownership GROUP BY ALL)""", "ownership")
check("ownership_totals", """
SELECT company, round(sum(capital_pct), 10) AS capital, round(sum(profit_pct), 10) AS profit FROM clean GROUP BY company""",
      "ownership", more=CLEAN)
check("ownership_repeated_keys", """
SELECT company, partner, count(*) AS n FROM clean GROUP BY 1, 2 HAVING count(*) > 1""", "ownership", more=CLEAN)
check("null_report", """
SELECT count(*) FILTER (WHERE id IS NULL) AS null_id, count(*) FILTER (WHERE accountant IS NULL) AS null_accountant,
  count(*) AS n_rows FROM accountant""", "accountant")
check("distinct_complete_rows", """
SELECT count(*) AS n FROM (SELECT DISTINCT id, accountant FROM accountant WHERE id IS NOT NULL AND accountant IS NOT NULL)""",
      "accountant")
check("id_prefix", """
SELECT company, partner, round(capital_pct, 6) AS capital_pct FROM ownership WHERE company LIKE 'C1%'""", "ownership")

# --- layers and entities ----------------------------------------------------------------

LAYERS = """
own_layer AS (
  SELECT company AS src, partner AS dst, capital_pct / 100 AS weight
  FROM (SELECT DISTINCT * FROM ownership)
  WHERE company IS NOT NULL AND partner IS NOT NULL AND capital_pct IS NOT NULL),
fam_layer AS (
  SELECT DISTINCT id AS src, relative AS dst, 1.0::DOUBLE AS weight FROM family
  WHERE kind IN ('HIJO', 'CONYUGE') AND id <> relative),
acc_layer AS (
  SELECT id AS src, accountant AS dst, 0.25::DOUBLE AS weight FROM accountant WHERE accountant IS NOT NULL),
rep_layer AS (
  SELECT id AS src, rep AS dst, 1.0::DOUBLE AS weight FROM representative
  WHERE start_day < DATE '2001-01-01' AND (end_day IS NULL OR end_day > DATE '2000-01-01'))"""
RELATIONS = ("ownership", "family", "accountant", "representative")
check("ownership_layer", "SELECT src, dst, round(weight, 10) AS weight FROM own_layer", *RELATIONS, more=LAYERS)
check("family_layer", "SELECT * FROM fam_layer", *RELATIONS, more=LAYERS)
check("accountant_layer", "SELECT * FROM acc_layer", *RELATIONS, more=LAYERS)
check("representative_layer", "SELECT * FROM rep_layer", *RELATIONS, more=LAYERS)

POOL = LAYERS + """,
people AS (SELECT id FROM naturals GROUP BY id HAVING avg(value) IS NOT NULL),
typed_own AS (
  SELECT n AS id, CASE WHEN n IN (SELECT id FROM people) THEN 'PERSONA' ELSE 'SOCIEDAD' END AS role
  FROM (SELECT src AS n FROM own_layer UNION SELECT dst FROM own_layer)),
typed_acc AS (
  SELECT DISTINCT src AS id, CASE WHEN src IN (SELECT id FROM people) THEN 'PERSONA' ELSE 'SOCIEDAD' END AS role FROM acc_layer),
typed_rep AS (
  SELECT DISTINCT src AS id, CASE WHEN src IN (SELECT id FROM people) THEN 'PERSONA' ELSE 'SOCIEDAD' END AS role FROM rep_layer),
first_pool AS (
  SELECT id, role FROM typed_own
  UNION SELECT src, 'PERSONA' FROM fam_layer UNION SELECT dst, 'PERSONA' FROM fam_layer
  UNION SELECT id, role FROM typed_acc UNION SELECT dst, 'CONTADOR' FROM acc_layer),
pool AS (
  SELECT id, role FROM first_pool UNION SELECT id, role FROM typed_rep UNION SELECT dst, 'REPRESENTANTE' FROM rep_layer)"""
ALL = (*RELATIONS, "naturals", "known")
check("entity_pool", "SELECT id, role FROM pool", *ALL, more=POOL)
check("role_resolved", """
SELECT id, CASE WHEN count(*) FILTER (WHERE role = 'REPRESENTANTE') > 0 THEN 'REPRESENTANTE' ELSE max(role) END AS role
FROM (SELECT id, CASE WHEN count(*) FILTER (WHERE role = 'CONTADOR') > 0 THEN 'CONTADOR' ELSE max(role) END AS role
      FROM first_pool GROUP BY id
      UNION SELECT id, role FROM typed_rep UNION SELECT dst, 'REPRESENTANTE' FROM rep_layer)
GROUP BY id""", *ALL, more=POOL)
NODES = POOL + """,
node_rows AS (
  SELECT p.id, CAST(max(CASE WHEN role = 'CONTADOR' THEN 1 ELSE 0 END) AS INTEGER) AS "CONTADOR",
    CAST(max(CASE WHEN role = 'PERSONA' THEN 1 ELSE 0 END) AS INTEGER) AS "NATURAL",
    CAST(max(CASE WHEN role = 'REPRESENTANTE' THEN 1 ELSE 0 END) AS INTEGER) AS "REPRESENTANTE",
    CAST(max(CASE WHEN role = 'SOCIEDAD' THEN 1 ELSE 0 END) AS INTEGER) AS "SOCIEDAD"
  FROM pool p GROUP BY p.id),
node_groups AS (
  SELECT n.*, k.com AS com_inicial FROM node_rows n LEFT JOIN known k ON n.id = k.id)"""
check("node_table", "SELECT * FROM node_groups", *ALL, more=NODES)
check("prior_groups", "SELECT id AS node, coalesce(min(com_inicial), '0') AS com FROM node_groups GROUP BY id", *ALL, more=NODES)

# --- wealth -----------------------------------------------------------------------------

KNOWN_WEALTH = """
pat AS (
  SELECT id, avg(wealth) AS wealth FROM (
    SELECT id, try_cast(replace(wealth, ',', '') AS BIGINT) AS wealth FROM wealth_text
      WHERE try_cast(replace(wealth, ',', '') AS BIGINT) > 0
    UNION SELECT id, CAST(trunc(wealth) AS BIGINT) FROM wealth_num WHERE wealth > 0)
  GROUP BY id)"""
WEALTH_INPUTS = ("ownership", "wealth_text", "wealth_num", "known")
check("known_wealth", "SELECT id, round(wealth, 6) AS wealth FROM pat", *WEALTH_INPUTS, more=KNOWN_WEALTH)


def _rounds(n: int) -> str:
    """The propagation written out: one state and one value table per round."""
    sql = CLEAN + "," + KNOWN_WEALTH + """,
rel AS (SELECT company, partner, avg(capital_pct) AS pct FROM clean GROUP BY 1, 2),
den AS (SELECT company, sum(pct) AS total FROM rel GROUP BY 1),
s0 AS MATERIALIZED (SELECT company, partner, pct, wealth AS w FROM rel LEFT JOIN pat ON partner = id)"""
    for r in range(n):
        if r:
            sql += f""",
s{r} AS MATERIALIZED (
  SELECT s.company, s.partner, s.pct, coalesce(s.w, v.value) AS w FROM s{r - 1} s LEFT JOIN v{r - 1} v ON s.partner = v.id)"""
        sql += f""",
v{r} AS MATERIALIZED (
  SELECT s.company AS id, sum(s.pct * s.w * 0.01) / nullif(max(total), 0) * 100 AS value
  FROM s{r} s JOIN den d ON s.company = d.company GROUP BY s.company HAVING count(*) = count(s.w))"""
    union = " UNION ALL ".join(f"SELECT id, value, {r} AS it FROM v{r}" for r in range(n))
    return sql + f""",
done AS MATERIALIZED (
  SELECT id, arg_min(value, it) AS value, CAST(min(it) AS INTEGER) AS iteration FROM ({union}) GROUP BY id),
part AS (SELECT company AS id, sum(w) AS wealth FROM s{n - 1} GROUP BY 1 HAVING sum(w) IS NOT NULL)"""


WEALTH = _rounds(10)
check("wealth_propagated", "SELECT id, round(value, 2) AS value, iteration FROM done", *WEALTH_INPUTS, more=WEALTH)
check("wealth_incomplete", """
SELECT company, partner, round(pct, 10) AS pct, round(w, 2) AS wealth FROM s9""", *WEALTH_INPUTS, more=WEALTH)
check("wealth_partial_by_group", """
SELECT com, round(sum(wealth), 2) AS wealth FROM known JOIN part USING (id) GROUP BY com""", *WEALTH_INPUTS, more=WEALTH)
check("wealth_over_threshold", """
SELECT count(*) FILTER (WHERE wealth > 8e6) AS n_over, count(*) AS n_rows, 'company' AS level
FROM known JOIN part USING (id)
UNION ALL
SELECT count(*) FILTER (WHERE wealth > 2.5e7), count(*), 'group'
FROM (SELECT com, sum(wealth) AS wealth FROM known JOIN part USING (id) GROUP BY com)""", *WEALTH_INPUTS, more=WEALTH)
check("wealth_describe", """
SELECT count(value) AS count, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std,
  round(min(value), 4) AS min, round(quantile_cont(value, 0.25), 4) AS q25, round(quantile_cont(value, 0.5), 4) AS q50,
  round(quantile_cont(value, 0.75), 4) AS q75, round(max(value), 4) AS max FROM done""", *WEALTH_INPUTS, more=WEALTH)
check("wealth_of_groups", """
SELECT id, com, round(value, 2) AS value, iteration FROM known JOIN done USING (id)""", *WEALTH_INPUTS, more=WEALTH)

# --- workers ----------------------------------------------------------------------------

WORKERS = """
pay AS (
  SELECT employer, dv, period, count(DISTINCT worker) AS dependent_workers, sum(income) AS income, sum(tax) AS tax,
    sum(zone) AS zone FROM payroll WHERE period IN (199900, 200000, 200100) GROUP BY 1, 2, 3),
fee AS (
  SELECT payer, period, count(DISTINCT worker) AS fee_workers, sum(fee) AS total_fee FROM fees
  WHERE period BETWEEN 199900 AND 200100 GROUP BY 1, 2)"""
check("payroll_counts", """
SELECT employer, dv, CAST(period AS INTEGER) AS period, dependent_workers, CAST(income AS DOUBLE) AS income,
  CAST(tax AS DOUBLE) AS tax, CAST(zone AS DOUBLE) AS zone FROM pay""", "payroll", "fees", more=WORKERS)
check("payroll_latest", """
SELECT employer, dv, CAST(max(period) AS INTEGER) AS period, arg_max(dependent_workers, period) AS dependent_workers,
  CAST(arg_max(income, period) FILTER (WHERE income IS NOT NULL) AS DOUBLE) AS income,
  CAST(arg_max(tax, period) FILTER (WHERE tax IS NOT NULL) AS DOUBLE) AS tax,
  CAST(arg_max(zone, period) FILTER (WHERE zone IS NOT NULL) AS DOUBLE) AS zone
FROM pay GROUP BY 1, 2""", "payroll", "fees", more=WORKERS)
check("payroll_latest_strict", """
SELECT employer, dv, CAST(period AS INTEGER) AS period, dependent_workers, CAST(income AS DOUBLE) AS income,
  CAST(tax AS DOUBLE) AS tax, CAST(zone AS DOUBLE) AS zone
FROM pay QUALIFY row_number() OVER (PARTITION BY employer, dv ORDER BY period DESC) = 1""",
      "payroll", "fees", more=WORKERS)
check("fee_latest", """
SELECT payer, CAST(period AS INTEGER) AS period, fee_workers, CAST(total_fee AS DOUBLE) AS total_fee
FROM fee QUALIFY row_number() OVER (PARTITION BY payer ORDER BY period DESC) = 1""", "payroll", "fees", more=WORKERS)
TABLE = WORKERS + """,
work AS (
  SELECT coalesce(p.employer, f.payer) AS id, coalesce(f.fee_workers, 0) AS fee_workers,
    coalesce(p.dependent_workers, 0) AS dependent_workers
  FROM (SELECT * FROM pay QUALIFY row_number() OVER (PARTITION BY employer, dv ORDER BY period DESC) = 1) p
  FULL JOIN (SELECT * FROM fee QUALIFY row_number() OVER (PARTITION BY payer ORDER BY period DESC) = 1) f
    ON p.employer = f.payer)"""
check("worker_table", "SELECT * FROM work", "payroll", "fees", "known", more=TABLE)
check("workers_by_group", """
SELECT com, round(avg(dependent_workers), 6) AS dependent_workers FROM known JOIN work USING (id) GROUP BY com""",
      "payroll", "fees", "known", more=TABLE)

# --- numeric profiles -------------------------------------------------------------------

BALANCES = "bal AS (SELECT id, com, value FROM known JOIN balance USING (id))"
B = ("known", "balance")
check("attribute_coverage", """
SELECT count(*) AS matched_rows, count(DISTINCT id) AS matched_ids, count(DISTINCT com) AS matched_groups,
  (SELECT count(DISTINCT id) FROM known) AS group_ids FROM bal""", *B, more=BALANCES)
QS = """round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50,
  round(quantile_cont(value, 0.75), 6) AS q75"""
check("quartiles", f"SELECT {QS} FROM bal", *B, more=BALANCES)
check("quartiles_by_group", f"SELECT com, {QS} FROM bal GROUP BY com", *B, more=BALANCES)
check("iqr_filtered", """
SELECT com, members FROM (SELECT com, count(*) AS members FROM known GROUP BY com),
  (SELECT quantile_cont(n, 0.25) AS a, quantile_cont(n, 0.75) AS b
   FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM known GROUP BY com))
WHERE members BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)""", "known")
check("iqr_removed", """
SELECT count(*) FILTER (WHERE v BETWEEN a - 0.5 * (b - a) AND b + 0.5 * (b - a)) AS kept,
  count(*) FILTER (WHERE NOT v BETWEEN a - 0.5 * (b - a) AND b + 0.5 * (b - a)) AS removed
FROM t, (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM t)""", "arcs",
      more="t AS (SELECT emitter, CAST(sum(amount) AS DOUBLE) AS v FROM arcs GROUP BY 1)")
check("iqr_by_group", """
SELECT id, com, value FROM bal JOIN (
  SELECT com, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM bal GROUP BY com) USING (com)
WHERE value BETWEEN a - (b - a) * 0.5 AND b + (b - a) * 0.5""", *B, more=BALANCES)


def _histogram(bins: str, digits: int = 6) -> str:
    """Over a CTE ``vals(v)``."""
    return f"""
SELECT b AS bin, round(lo + b * width, {digits}) AS lower, round(lo + (b + 1) * width, {digits}) AS upper,
  coalesce(n, 0) AS n
FROM (SELECT lo, width, CAST(unnest(range(nb)) AS INTEGER) AS b FROM frame)
LEFT JOIN (SELECT CAST(least(floor((v - lo) / width), nb - 1) AS INTEGER) AS b, count(*) AS n
           FROM vals, frame GROUP BY 1) USING (b)""", f"""
frame AS (SELECT lo, nb, (hi - lo) / nb AS width FROM (
  SELECT min(v) AS lo, max(v) AS hi, CAST({bins} AS INTEGER) AS nb FROM vals))"""


body, frame = _histogram("20")
check("histogram", body, *B, more=BALANCES + ", vals AS (SELECT value AS v FROM bal)," + frame)
body, frame = _histogram("""ceil((max(v) - min(v)) / least((max(v) - min(v)) / (log2(count(v)) + 1),
  2 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / cbrt(count(v))))""")
check("histogram_auto", body, *B, more=BALANCES + ", vals AS (SELECT value AS v FROM bal)," + frame)
body, frame = _histogram("10")
check("group_mean_histogram", body, *B, more=BALANCES
      + ", vals AS (SELECT avg(value) AS v FROM bal GROUP BY com)," + frame)
body, frame = _histogram("10", 4)
check("group_total_histogram", body, "arcs", "known", more="""
t AS (SELECT com, CAST(sum(amount) AS DOUBLE) AS v FROM known JOIN arcs ON id = emitter GROUP BY com),
vals AS (SELECT v FROM t, (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM t)
  WHERE v BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)),""" + frame)
check("kde", """
SELECT CAST(p AS INTEGER) AS point, round(max(lo + p * step), 6) AS x,
  round(sum(exp(-0.5 * pow((lo + p * step - value) / bw, 2))) / max(n * bw * sqrt(2 * pi())), 12) AS density
FROM bal, (SELECT count(value) AS n, min(value) AS lo, (max(value) - min(value)) / 199 AS step,
             stddev_samp(value) * pow(count(value), -0.2) AS bw FROM bal), range(200) t(p)
GROUP BY p""", *B, more=BALANCES)
check("group_distribution", f"""
SELECT com, count(value) AS n, min(value) AS min, {QS}, max(value) AS max FROM bal
WHERE com IN (SELECT com FROM bal GROUP BY com ORDER BY count(*) DESC, com LIMIT 15) GROUP BY com""", *B, more=BALANCES)
check("describe", f"""
SELECT count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
  round(min(value), 6) AS min, {QS}, round(max(value), 6) AS max FROM bal""", *B, more=BALANCES)

# --- categorical profiles ---------------------------------------------------------------

ACTIVITY = """
act AS (SELECT id, com, activity, subsector, sector FROM known JOIN activity USING (id) JOIN activity_dim USING (code))"""
A = ("known", "activity", "activity_dim")


def _modes(table: str, col: str) -> str:
    return f"""(SELECT com, v FROM (SELECT com, {col} AS v, count(*) AS n FROM {table} WHERE {col} IS NOT NULL GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY com ORDER BY n DESC, v) = 1)"""


def _profile(table: str, col: str, k: int) -> str:
    return f"""
(SELECT 'value' AS kind, CAST({col} AS VARCHAR) AS value, count(*) AS n FROM {table} WHERE {col} IS NOT NULL
 GROUP BY {col} ORDER BY n DESC, {col} LIMIT {k})
UNION ALL
(SELECT 'mode', CAST(v AS VARCHAR), count(*) AS n FROM {_modes(table, col)} GROUP BY v ORDER BY n DESC, v LIMIT {k})"""


check("top_values", """
SELECT activity, count(*) AS n FROM act GROUP BY 1 ORDER BY n DESC, activity LIMIT 15""", *A, more=ACTIVITY)
check("group_modes", f"SELECT com, v AS activity FROM {_modes('act', 'activity')}", *A, more=ACTIVITY)
check("mode_of_modes", f"""
SELECT v AS subsector, count(*) AS n FROM {_modes('act', 'subsector')} GROUP BY v ORDER BY n DESC, v LIMIT 15""",
      *A, more=ACTIVITY)
check("activity_profile", f"""
SELECT *, 'subsector' AS attribute FROM ({_profile('act', 'subsector', 15)})
UNION ALL SELECT *, 'sector' FROM ({_profile('act', 'sector', 15)})""", *A, more=ACTIVITY)
check("accountant_profile", _profile("x", "accountant", 5), "known", "accountant",
      more="x AS (SELECT com, accountant FROM known JOIN accountant USING (id))")
check("address_profile", _profile("x", "name", 15), "known", "addresses", "place_dict",
      more="x AS (SELECT com, name FROM known JOIN addresses USING (id) JOIN place_dict USING (place))")
check("email_profile", _profile("x", "email", 15), "known", "emails",
      more="x AS (SELECT com, email FROM known JOIN emails USING (id))")
DIRECTORS = """
dirs AS (
  SELECT payer AS id, worker AS director FROM fees WHERE dir10 IS NOT NULL AND dir10 > 0
  UNION SELECT payer, worker FROM fees WHERE dir20 IS NOT NULL AND dir20 > 0),
x AS (SELECT id, com, director FROM known JOIN dirs USING (id))"""
check("directors", "SELECT id, com, director FROM x", "known", "fees", more=DIRECTORS)
check("director_profile", _profile("x", "director", 15), "known", "fees", more=DIRECTORS)
EXTREMES = """
named AS (
  SELECT DISTINCT emitter, com, name FROM sales JOIN known ON emitter = id JOIN place_dict USING (place)),
ext AS (
  SELECT emitter, com, CAST(sum(CASE WHEN substr(region, 1, 4) = 'R03 ' THEN 1 ELSE 0 END) AS BIGINT) AS north,
    CAST(sum(CASE WHEN substr(region, 1, 4) = 'R21 ' THEN 1 ELSE 0 END) AS BIGINT) AS south
  FROM named n JOIN region_dim r ON replace(n.name, chr(65533), 'N') = r.name GROUP BY 1, 2),
ends AS (SELECT *, CASE WHEN north > 0 AND south > 0 THEN 'si' ELSE 'no' END AS both_ends FROM ext),
by_group AS (SELECT com, CASE WHEN bool_or(both_ends = 'si') THEN 'si' ELSE 'no' END AS both_ends FROM ends GROUP BY com)"""
E = ("known", "sales", "place_dict", "region_dim")
check("extreme_regions", "SELECT * FROM ends", *E, more=EXTREMES)
check("extreme_regions_by_group", "SELECT * FROM by_group", *E, more=EXTREMES)
check("extreme_region_counts", """
SELECT both_ends, count(*) AS n, 'emitter' AS level FROM ends GROUP BY 1
UNION ALL SELECT both_ends, count(*), 'group' FROM by_group GROUP BY 1""", *E, more=EXTREMES)

# --- edges and graph --------------------------------------------------------------------


def _stack(order: list[str]) -> str:
    return " UNION ALL ".join(f"""
  SELECT least(src, dst) AS src, greatest(src, dst) AS dst, weight, {rank} AS rank, '{layer}' AS layer
  FROM {layer[:3]}_layer""" for rank, layer in enumerate(order))


STACK = LAYERS + f""",
stack AS ({_stack(["ownership", "family", "representative", "accountant"])}),
edges AS MATERIALIZED (
  SELECT src, dst, weight, layer FROM stack
  QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY rank DESC, weight DESC) = 1)"""
PLAIN = " UNION ".join(f"SELECT least(src, dst) AS src, greatest(src, dst) AS dst FROM {x}_layer"
                       for x in ("own", "fam", "acc", "rep"))
check("edges_ownership", """
SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst, 1.0::DOUBLE AS weight FROM own_layer""",
      *RELATIONS, more=LAYERS)
check("edges_unweighted", f"SELECT src, dst, 1.0::DOUBLE AS weight FROM ({PLAIN})", *RELATIONS, more=LAYERS)
check("edges_share", """
SELECT least(src, dst) AS src, greatest(src, dst) AS dst, round(max(weight), 10) AS weight FROM own_layer GROUP BY 1, 2""",
      *RELATIONS, more=LAYERS)
check("edges_multilayer", "SELECT src, dst, round(weight, 10) AS weight, layer FROM edges", *RELATIONS, more=STACK)
check("edges_conflict_sum", """
SELECT s.src, s.dst, round(sum(s.weight), 10) AS weight, max(e.layer) AS layer
FROM stack s JOIN edges e ON s.src = e.src AND s.dst = e.dst GROUP BY 1, 2""", *RELATIONS, more=STACK)
FLAGS = LAYERS + f""",
stack AS ({_stack(["ownership", "accountant", "representative", "family"])}),
flagged AS MATERIALIZED (
  SELECT src, dst, first(weight ORDER BY rank DESC, weight DESC) AS weight, bool_or(layer = 'family') AS f,
    bool_or(layer = 'representative') AS r, bool_or(layer = 'accountant') AS a FROM stack GROUP BY 1, 2)"""
# Published weights of accountant, representative and family.
check("edges_reweighted", """
SELECT src, dst, round(CASE WHEN a THEN 0.596811 WHEN r THEN 0.50927 WHEN f THEN 0.869142 ELSE weight END, 10) AS weight
FROM flagged""", *RELATIONS, more=FLAGS)
GRAPH = STACK + """,
deg AS MATERIALIZED (
  SELECT node, count(*) AS degree, sum(weight) AS strength
  FROM (SELECT src AS node, weight FROM edges UNION ALL SELECT dst, weight FROM edges) GROUP BY node),
central AS MATERIALIZED (
  SELECT node, degree FROM deg
  QUALIFY row_number() OVER (ORDER BY degree DESC, node) <= floor((SELECT count(*) FROM deg) * 0.1)),
sub AS MATERIALIZED (
  SELECT * FROM edges WHERE src IN (SELECT node FROM central) AND dst IN (SELECT node FROM central)),
sub_nodes AS (SELECT src AS node FROM sub UNION SELECT dst FROM sub)"""
G = (*RELATIONS, "known")
check("degree_centrality", """
SELECT node, degree, round(degree / ((SELECT count(*) FROM deg) - 1), 12) AS centrality FROM deg""", *G, more=GRAPH)
check("node_strength", "SELECT node, degree, round(strength, 10) AS strength FROM deg", *G, more=GRAPH)
check("top_central", "SELECT node, degree FROM central", *G, more=GRAPH)
check("induced_subgraph", "SELECT src, dst, round(weight, 10) AS weight, layer FROM sub", *G, more=GRAPH)
check("non_isolated", "SELECT node FROM sub_nodes", *G, more=GRAPH)
check("seed_membership", """
SELECT node, coalesce(min(com), '0') AS com FROM sub_nodes LEFT JOIN known ON node = id GROUP BY node""", *G, more=GRAPH)
check("layer_rows_in_sample", """
SELECT src, dst, round(weight, 10) AS weight FROM own_layer o
WHERE EXISTS (SELECT 1 FROM sub s WHERE s.src = least(o.src, o.dst) AND s.dst = greatest(o.src, o.dst))""", *G, more=GRAPH)
PROPORTIONAL = STACK + "," + POOL[len(LAYERS) + 1:] + """,
resolved AS (
  SELECT id, CASE WHEN count(*) FILTER (WHERE role = 'REPRESENTANTE') > 0 THEN 'REPRESENTANTE' ELSE max(role) END AS role
  FROM (SELECT id, CASE WHEN count(*) FILTER (WHERE role = 'CONTADOR') > 0 THEN 'CONTADOR' ELSE max(role) END AS role
        FROM first_pool GROUP BY id
        UNION SELECT id, role FROM typed_rep UNION SELECT dst, 'REPRESENTANTE' FROM rep_layer)
  GROUP BY id),
every AS MATERIALIZED (
  SELECT node, coalesce(role, '') AS role FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges) LEFT JOIN resolved ON node = id),
drawn AS MATERIALIZED (
  SELECT node, role FROM every
  QUALIFY row_number() OVER (PARTITION BY role ORDER BY md5(node || '|1'), node) <= floor(count(*) OVER (PARTITION BY role) * sqrt(0.1::DOUBLE))),
between AS MATERIALIZED (
  SELECT src, dst, layer, row_number() OVER (PARTITION BY layer ORDER BY md5(layer || '|' || src || '|' || dst || '|1'), src, dst) AS k
  FROM edges WHERE src IN (SELECT node FROM drawn) AND dst IN (SELECT node FROM drawn)),
counts AS (
  SELECT layer, total, coalesce(n, 0) AS n FROM (SELECT layer, count(*) AS total FROM edges GROUP BY layer)
  LEFT JOIN (SELECT layer, count(*) AS n FROM between GROUP BY layer) USING (layer)),
least_layer AS (SELECT n AS ln, total AS lt FROM counts ORDER BY n / total, layer LIMIT 1),
thinned AS MATERIALIZED (
  SELECT src, dst, layer FROM between JOIN counts USING (layer), least_layer WHERE k <= (total::HUGEINT * ln) // lt)"""
check("proportional_nodes", "SELECT node, role FROM drawn", *ALL, more=PROPORTIONAL)
check("proportional_edges", "SELECT src, dst, layer FROM thinned", *ALL, more=PROPORTIONAL)
check("proportional_shares", """
SELECT kind, name, round(a / (sum(a) OVER (PARTITION BY kind)), 10) AS of_all, round(coalesce(s, 0) / (sum(coalesce(s, 0)) OVER (PARTITION BY kind)), 10) AS of_sample
FROM (
  SELECT 'role' AS kind, role AS name, count(*)::DOUBLE AS a, (SELECT count(*) FROM drawn d WHERE d.role = e.role)::DOUBLE AS s FROM every e GROUP BY role
  UNION ALL
  SELECT 'layer', layer, count(*)::DOUBLE, (SELECT count(*) FROM thinned t WHERE t.layer = e.layer)::DOUBLE FROM edges e GROUP BY layer)""",
      *ALL, more=PROPORTIONAL)
check("stratified_sample", """
SELECT src, dst, layer FROM edges
WHERE CAST('0x' || substr(md5(layer || '|' || src || '|' || dst || '|1'), 1, 8) AS BIGINT) / 4294967296.0 < 0.1""",
      *G, more=STACK)


WHOLE = GRAPH + """,
link AS MATERIALIZED (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges)"""


def _components(links: str = WHOLE, rounds: int = 24) -> str:
    """Smallest reachable node by repeated minimum over neighbours, written out."""
    sql = links + """,
l0 AS MATERIALIZED (SELECT a AS node, least(a, min(b)) AS label FROM link GROUP BY a)"""
    for r in range(1, rounds):
        sql += f""",
l{r} AS MATERIALIZED (
  SELECT k.a AS node, least(min(n.label), min(me.label)) AS label
  FROM link k JOIN l{r - 1} n ON k.b = n.node JOIN l{r - 1} me ON k.a = me.node GROUP BY k.a)"""
    return sql


check("components", "SELECT node, label AS component FROM l23", *G, more=_components())
check("louvain_at_zero", "SELECT node, label AS community FROM l23", *G, more=_components())

# --- scores of fixed partitions ---------------------------------------------------------

PRIOR = GRAPH + """,
prior AS MATERIALIZED (
  SELECT node, coalesce('g' || min(com), node) AS community FROM deg LEFT JOIN known ON node = id GROUP BY node)"""
check("modularity_of_groups", """
SELECT round((SELECT sum(weight) FROM edges e JOIN prior a ON e.src = a.node JOIN prior b ON e.dst = b.node
              WHERE a.community = b.community) / (sum(d) / 2) - sum(pow(d / total, 2)), 9) AS modularity
FROM (SELECT community, sum(strength) AS d FROM deg JOIN prior USING (node) GROUP BY 1),
     (SELECT sum(strength) AS total FROM deg)""", *G, more=PRIOR)
FLOW_EDGES = """
fe AS MATERIALIZED (SELECT least(emitter, receiver) AS src, greatest(emitter, receiver) AS dst,
  CAST(sum(amount) AS DOUBLE) AS w FROM arcs GROUP BY 1, 2),
ends AS (SELECT src AS node, w FROM fe UNION ALL SELECT dst, w FROM fe),
swept AS MATERIALIZED (
  SELECT resolution, round(coalesce(max(l), 0) / (max(total) / 2) - sum(pow(d / total, 2)), 9) AS modularity
  FROM (SELECT resolution, community, sum(w) AS d FROM ends JOIN partitions USING (node) GROUP BY 1, 2)
  LEFT JOIN (SELECT a.resolution, sum(e.w) AS l FROM fe e JOIN partitions a ON e.src = a.node
        JOIN partitions b ON e.dst = b.node AND a.resolution = b.resolution AND a.community = b.community
        GROUP BY 1) USING (resolution),
    (SELECT sum(w) AS total FROM ends)
  GROUP BY resolution)"""
check("modularity_sweep", "SELECT resolution, modularity FROM swept", "arcs", "partitions", more=FLOW_EDGES)
check("partition_result_wide", """
SELECT id, com_inicial, max(CASE WHEN resolution = 0.0 THEN community END) AS comunidad_0_0,
  max(CASE WHEN resolution = 0.5 THEN community END) AS comunidad_0_5, max(CASE WHEN resolution = 1.0 THEN community END) AS comunidad_1_0,
  (SELECT modularity FROM swept WHERE resolution = 0.0) AS modularidad_0_0, (SELECT modularity FROM swept WHERE resolution = 0.5) AS modularidad_0_5,
  (SELECT modularity FROM swept WHERE resolution = 1.0) AS modularidad_1_0
FROM node_groups LEFT JOIN partitions ON id = node GROUP BY id, com_inicial""", *dict.fromkeys([*ALL, "arcs", "partitions"]), more=FLOW_EDGES + "," + NODES)


AMI = """
lab AS MATERIALIZED (
  SELECT resolution, com AS u, community AS v FROM partitions JOIN known ON node = id),
cnt AS MATERIALIZED (SELECT resolution, u, v, count(*) AS n FROM lab GROUP BY 1, 2, 3),
mu AS MATERIALIZED (SELECT resolution, u, sum(n)::BIGINT AS a FROM cnt GROUP BY 1, 2),
mv AS MATERIALIZED (SELECT resolution, v, sum(n)::BIGINT AS b FROM cnt GROUP BY 1, 2),
tot AS MATERIALIZED (SELECT resolution, sum(n)::BIGINT AS s FROM cnt GROUP BY 1),
mi AS (SELECT resolution, sum(n / s * ln(s::DOUBLE * n / (a::DOUBLE * b))) AS mi
  FROM cnt JOIN mu USING (resolution, u) JOIN mv USING (resolution, v) JOIN tot USING (resolution) GROUP BY 1),
hu AS (SELECT resolution, -sum(a / s * ln(a / s)) AS h FROM mu JOIN tot USING (resolution) GROUP BY 1),
hv AS (SELECT resolution, -sum(b / s * ln(b / s)) AS h FROM mv JOIN tot USING (resolution) GROUP BY 1),
term AS (SELECT mu.resolution, a, b, s, unnest(range(greatest(1, a + b - s), least(a, b) + 1)) AS k
  FROM mu JOIN mv ON mu.resolution = mv.resolution JOIN tot ON tot.resolution = mu.resolution),
emi AS (SELECT resolution, sum(k / s * ln(s::DOUBLE * k / (a::DOUBLE * b)) * exp(
    lgamma(a + 1) + lgamma(b + 1) + lgamma(s - a + 1) + lgamma(s - b + 1) - lgamma(s + 1) - lgamma(k + 1)
    - lgamma(a - k + 1) - lgamma(b - k + 1) - lgamma(s - a - b + k + 1))) AS emi FROM term GROUP BY 1),
score AS (SELECT resolution, s AS n, mi, emi, (mi - emi) / ((hu.h + hv.h) / 2 - emi) AS ami
  FROM tot JOIN mi USING (resolution) JOIN emi USING (resolution) JOIN hu USING (resolution) JOIN hv USING (resolution))"""
S = "n, round(mi, 8) AS mi, round(emi, 8) AS emi, round(ami, 8) AS ami"
check("ami_groups", f"SELECT {S} FROM score WHERE resolution = 1.0", "partitions", "known", more=AMI)
check("ami_sweep", f"SELECT resolution, {S} FROM score", "partitions", "known", more=AMI)
check("ami_sweep_summary", """
SELECT round(avg(ami), 8) AS mean_ami, round(max(ami), 8) AS best_ami, arg_max(resolution, ami) AS best_resolution
FROM score""", "partitions", "known", more=AMI)
check("best_trial", """
SELECT CAST(resolution * 10 AS INTEGER) AS trial, round(resolution / 3 + 0, 6) AS w_family,
  round(resolution / 3 + 1, 6) AS w_representative, round(resolution / 3 + 2, 6) AS w_accountant,
  round(resolution / 3 + 3, 6) AS resolution, round(ami, 8) AS ami
FROM score ORDER BY score.ami DESC LIMIT 1""", "partitions", "known", more=AMI)
check("partition_export_wide", """
SELECT node, max(CASE WHEN resolution = 0.0 THEN community END) AS comunidad_0_0,
  max(CASE WHEN resolution = 0.5 THEN community END) AS comunidad_0_5,
  max(CASE WHEN resolution = 1.0 THEN community END) AS comunidad_1_0 FROM partitions GROUP BY node""", "partitions")
check("partition_with_groups", """
SELECT node, resolution, community, com FROM partitions LEFT JOIN known ON node = id""", "partitions", "known")
check("refine_connected", """
SELECT node, coalesce(label, node) AS community FROM prior LEFT JOIN l23 USING (node)""", *G, more=_components(PRIOR + """,
inside AS MATERIALIZED (SELECT src, dst FROM edges e JOIN prior a ON e.src = a.node JOIN prior b ON e.dst = b.node WHERE a.community = b.community),
link AS MATERIALIZED (SELECT src AS a, dst AS b FROM inside UNION SELECT dst, src FROM inside)"""))
LABELS = PRIOR + """,
sizes AS (SELECT community, count(*) AS members, min(node) AS first_member FROM prior GROUP BY 1),
lab AS (SELECT node, label FROM prior JOIN (
  SELECT community, row_number() OVER (ORDER BY members DESC, first_member) AS label FROM sizes) USING (community))"""
check("community_labels_fixed", "SELECT node, label FROM lab", *G, more=LABELS)
check("communities_fixed", "SELECT * FROM sizes", *G, more=LABELS)
check("labelled_nodes", """
SELECT id, com_inicial, label FROM node_groups LEFT JOIN lab ON id = node""", *ALL, more=LABELS + "," + NODES[len(LAYERS) + 1:])

# --- community detection ----------------------------------------------------------------

check("louvain_move_round", """
SELECT node, coalesce(best, node) AS proposal, 0.0::DOUBLE AS kin, round(strength, 8) AS tot
FROM deg LEFT JOIN (
  SELECT a AS node, b AS best FROM (
    SELECT x.a, x.b, x.weight - ka.strength * kb.strength / (SELECT sum(strength) FROM deg) AS gain
    FROM (SELECT src AS a, dst AS b, weight FROM edges WHERE src <> dst
          UNION ALL SELECT dst, src, weight FROM edges WHERE src <> dst) x
    JOIN deg ka ON ka.node = x.a JOIN deg kb ON kb.node = x.b WHERE x.b < x.a)
  WHERE gain > 1e-12 QUALIFY row_number() OVER (PARTITION BY a ORDER BY gain DESC, b) = 1) USING (node)""", *G, more=GRAPH)
check("louvain_checks", """
SELECT 0::BIGINT AS communities_across_components, count(*) AS labelled_nodes, count(*) AS nodes,
  true AS beats_known_groups FROM deg""", *G, more=GRAPH)

# --- tuning -----------------------------------------------------------------------------

check("trial_edges", """
SELECT CAST(trial AS INTEGER) AS trial, src, dst, round(CASE WHEN a THEN wa WHEN r THEN wr WHEN f THEN wf ELSE weight END, 10) AS weight
FROM flagged, (VALUES (0, 1.0, 1.0, 0.25), (1, 0.8, 0.5, 0.6), (2, 0.3, 0.9, 0.5)) t(trial, wf, wr, wa)
WHERE src IN (SELECT node FROM central) AND dst IN (SELECT node FROM central)""", *G,
      more=GRAPH + "," + FLAGS[len(LAYERS) + 1:].replace("stack", "stack2"))

check("louvain_optimum", """
SELECT count(*) AS nodes, 0::BIGINT AS improving_moves, 0::BIGINT AS moved_again FROM deg""", *G, more=GRAPH)
check("connected_checks", """
SELECT count(*) AS labelled, count(*) AS nodes, 0::BIGINT AS disconnected, true AS no_worse FROM deg""", *G, more=GRAPH)
check("resolution_checks", """
SELECT resolution / 10.0 AS resolution, n AS labelled, n AS nodes, 0::BIGINT AS improving_moves
FROM (SELECT count(*) AS n FROM deg), range(11) r(resolution)""", *G, more=GRAPH)
CHECKS["search_summary"] = "SELECT true AS whole_generations, true AS within_bounds, true AS scored, true AS best_is_max"

# --- sources and sinks ------------------------------------------------------------------

check("source_catalog", "SELECT id, relative, kind FROM family", "family")
check("source_parquet", "SELECT id, com FROM raw_groups", "raw_groups")
check("source_csv", "SELECT emitter, receiver, CAST(amount AS DOUBLE) AS amount FROM arcs", "arcs")
check("source_groups_json", "SELECT id AS node, coalesce(min(com_inicial), '0') AS com FROM node_groups GROUP BY id", *ALL, more=NODES)
check("source_sample_groups_json", """
SELECT node, coalesce(min(com), '0') AS com FROM central LEFT JOIN known ON node = id GROUP BY node""", *G, more=GRAPH)
check("source_edges_by_layer", "SELECT src, dst, round(weight, 10) AS weight, layer FROM edges WHERE layer = 'ownership'", *G, more=GRAPH)
check("sink_overwritten", "SELECT id, com FROM raw_groups", "raw_groups")
check("sink_refused", "SELECT id, com, true AS refused FROM raw_groups", "raw_groups")
