"""Matching and cleaning queries (D5-D11, D25, D27) with SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablefold.operators import cells as C
from tablefold.operators import clean as CL
from tablefold.operators import match as MT
from tablefold.plans.base import R, register
from tablefold.plans.tables import f4
from tablefold.sources.tables import table

CUST = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
SUPP = ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]


def _sfx(c):
    return c.split("_", 1)[1]


def _schema_sql() -> str:
    lv = " UNION ALL ".join(f"SELECT '{c}' AS source, CAST({c} AS VARCHAR) AS value FROM customer" for c in CUST)
    rv = " UNION ALL ".join(f"SELECT '{c}' AS target, CAST({c} AS VARCHAR) AS value FROM supplier" for c in SUPP)
    names = " UNION ALL ".join(f"SELECT '{a}' AS source, '{_sfx(a)}' AS s_sfx, '{b}' AS target, '{_sfx(b)}' AS t_sfx"
                               for a in CUST for b in SUPP)
    return f"""WITH lv AS (SELECT DISTINCT * FROM ({lv}) WHERE value IS NOT NULL),
rv AS (SELECT DISTINCT * FROM ({rv}) WHERE value IS NOT NULL),
inter AS (SELECT source, target, count(*) AS n_common FROM lv JOIN rv USING (value) GROUP BY ALL),
ln AS (SELECT source, count(*) AS n_s FROM lv GROUP BY ALL), rn AS (SELECT target, count(*) AS n_t FROM rv GROUP BY ALL),
names AS ({names}),
m AS (SELECT names.*, coalesce(n_common, 0) AS c, n_s, n_t FROM names LEFT JOIN inter USING (source, target)
      LEFT JOIN ln USING (source) LEFT JOIN rn USING (target)),
s AS (SELECT source, target, CAST(c AS DOUBLE) / (n_s + n_t - c) AS jaccard,
      0.5 * (1 - levenshtein(s_sfx, t_sfx) / greatest(length(s_sfx), length(t_sfx)))
      + 0.5 * (CAST(c AS DOUBLE) / (n_s + n_t - c)) AS score FROM m),
b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, target) AS r FROM s)
SELECT source, CASE WHEN score >= 0.5 THEN target END AS target, round(score, {R}) AS score,
       round(jaccard, {R}) AS jaccard FROM b WHERE r = 1"""


@register("schema_match", _schema_sql())
def q_schema_match(spark, sf_dir):
    """Customer columns matched to supplier columns."""
    m = MT.schema_match(table(spark, sf_dir, "customer").select(*CUST), table(spark, sf_dir, "supplier").select(*SUPP))
    return m.select("source", "target", F.round("score", R).alias("score"), F.round("jaccard", R).alias("jaccard"))


@register("entity_clusters", """SELECT p_partkey, min(p_partkey) OVER w AS cluster_id, count(*) OVER w AS cluster_size,
    count(*) OVER w > 1 AS is_duplicate FROM part
    WINDOW w AS (PARTITION BY p_brand, lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))),
                 lower(trim(CAST(p_size AS VARCHAR))))""")
def q_entity_clusters(spark, sf_dir):
    """Parts with equal normalized name and size inside a brand block form one cluster."""
    return MT.entity_clusters(table(spark, sf_dir, "part"), "p_partkey", ["p_brand"], ["p_name", "p_size"])


def _typos(spark, sf_dir):
    """Input for D8: p_type with its second letter dropped on every 97th part key."""
    p = table(spark, sf_dir, "part")
    t = F.col("p_type")
    return p.select("p_partkey", F.when(F.col("p_partkey") % 97 == 0, F.concat(F.substring(t, 1, 1), F.substring(t, 3, 1000)))
                    .otherwise(t).alias("p_type"))


@register("near_value_errors", """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 97 = 0
    THEN substr(p_type, 1, 1) || substr(p_type, 3, 1000) ELSE p_type END AS p_type FROM part),
c AS (SELECT p_type AS v, count(*) AS n FROM p GROUP BY 1),
cand AS (SELECT a.v AS rare, b.v AS freq, b.n AS freq_n FROM c a, c b
         WHERE a.v <> b.v AND b.n >= 10 * a.n AND levenshtein(a.v, b.v) <= 1),
best AS (SELECT rare, freq FROM (SELECT *, row_number() OVER (PARTITION BY rare ORDER BY freq_n DESC, freq) AS r
         FROM cand) WHERE r = 1)
SELECT p_partkey, p_type, freq AS suggestion FROM p JOIN best ON p.p_type = best.rare""")
def q_near_value_errors(spark, sf_dir):
    """Misspelt types found next to their frequent spelling."""
    return CL.near_frequent_errors(_typos(spark, sf_dir), "p_partkey", "p_type", ratio=10.0)


@register("impute_mode", """WITH p AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 50 = 0 THEN '' ELSE p_type END AS p_type FROM part),
g AS (SELECT p_brand, p_type, count(*) AS n FROM p WHERE p_type <> '' GROUP BY ALL),
m AS (SELECT p_brand, p_type AS mode FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS r
      FROM g) WHERE r = 1)
SELECT p_partkey, p.p_brand, mode AS imputed FROM p LEFT JOIN m USING (p_brand) WHERE p.p_type = ''""")
def q_impute_mode(spark, sf_dir):
    """Blanked types filled with their brand's most common type."""
    p = table(spark, sf_dir, "part")
    blanked = p.select("p_partkey", "p_brand",
                       F.when(F.col("p_partkey") % 50 == 0, F.lit("")).otherwise(F.col("p_type")).alias("p_type"))
    return CL.impute_mode(blanked, "p_partkey", "p_type", ["p_brand"])


@register("locate_cells", f4("""q AS (SELECT o_orderkey AS case_id, CAST(o_orderkey % 3 AS INTEGER) AS row_idx,
    ['l_linenumber', 'l_partkey', 'l_quantity', 'l_returnflag', 'l_shipdate'][CAST(o_orderkey % 5 AS INTEGER) + 1] AS col_name
    FROM orders)
SELECT q.case_id, q.row_idx, q.col_name, value FROM q JOIN cells c ON c.case_id = q.case_id AND c.row_idx = q.row_idx
    AND c.col_name = q.col_name"""))
def q_locate_cells(spark, sf_dir):
    """(row, column name) questions answered from each order's table."""
    o = table(spark, sf_dir, "orders")
    names = F.array(*[F.lit(n) for n in C.F4_COLUMNS])
    q = o.select(F.col("o_orderkey").alias("case_id"), (F.col("o_orderkey") % 3).cast("int").alias("row_idx"),
                 F.element_at(names, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("col_name"))
    return MT.locate_cells(C.lineitem_cells(spark, sf_dir), q)


@register("unique_cells", f4("""x AS (SELECT *, count(*) OVER (PARTITION BY case_id, table_name, value) AS n FROM cells)
SELECT case_id, table_name, row_idx, col_idx, col_name, value FROM x WHERE n = 1"""))
def q_unique_cells(spark, sf_dir):
    """Needle candidates: values that occur once in their table."""
    return MT.unique_cells(C.lineitem_cells(spark, sf_dir))


@register("sensitive_gate", "SELECT doc_id, " + ", ".join(
    f"regexp_matches(text, '{p}') AS has_{k}" for k, p in CL.SENSITIVE_PATTERNS.items())
    + ", CASE WHEN " + " OR ".join(f"regexp_matches(text, '{p}')" for p in CL.SENSITIVE_PATTERNS.values())
    + " THEN 'yes' ELSE 'no' END AS flagged FROM documents")
def q_sensitive_gate(spark, sf_dir):
    """yes/no sensitive-data flag per document (e-mail, phone, IPv4, card-like digits)."""
    return CL.sensitive_flags(table(spark, sf_dir, "documents"), "doc_id", "text")


@register("value_join", """SELECT l.n_name AS "left", r.v AS "right" FROM (SELECT DISTINCT n_name FROM nation) l
    JOIN (SELECT DISTINCT lower(replace(n_name, '_', ' ')) AS v FROM nation) r
    ON lower(regexp_replace(l.n_name, '[^A-Za-z0-9]', '', 'g')) = lower(regexp_replace(r.v, '[^A-Za-z0-9]', '', 'g'))""")
def q_value_join(spark, sf_dir):
    """Names joined to differently written copies after normalizing."""
    n = table(spark, sf_dir, "nation")
    right = n.select(F.lower(F.replace(F.col("n_name"), F.lit("_"), F.lit(" "))).alias("v"))
    return MT.value_join(n, "n_name", right, "v")


@register("region_mapping", """WITH ex AS (SELECT n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
    WHERE n_nationkey % 2 = 0),
m AS (SELECT n_regionkey, r_name FROM (SELECT n_regionkey, r_name, count(*) AS c FROM ex GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY c DESC, r_name) = 1)
SELECT n_nationkey, n.n_regionkey, r_name AS mapped FROM nation n LEFT JOIN m USING (n_regionkey)
WHERE n_nationkey % 2 = 1""")
def q_region_mapping(spark, sf_dir):
    """Region names learnt from even nations' examples, applied to odd nations."""
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    ex = n.filter(F.col("n_nationkey") % 2 == 0).join(r, n.n_regionkey == r.r_regionkey).select("n_regionkey", "r_name")
    mp = CL.learn_mapping(ex, "n_regionkey", "r_name")
    test = n.filter(F.col("n_nationkey") % 2 == 1).select("n_nationkey", "n_regionkey")
    return CL.apply_mapping(test, mp, "n_regionkey", "r_name").select("n_nationkey", "n_regionkey", "mapped")


@register("needle_positions", f4("""x AS (SELECT *, CAST(floor(row_idx / 2) AS INTEGER) AS row_bin,
    CAST(floor(col_idx / 2) AS INTEGER) AS col_bin FROM cells),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id, table_name, row_bin, col_bin ORDER BY row_idx, col_idx) AS rn FROM x)
SELECT case_id, table_name, row_bin, col_bin, row_idx, col_idx, col_name, value FROM r WHERE rn = 1"""))
def q_needle_positions(spark, sf_dir):
    """One needle cell per 2x2 block of every order's table."""
    return MT.needle_positions(C.lineitem_cells(spark, sf_dir), step=2)
