"""By-example transform (D24) and header assignment (D22) queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablefold.operators import cells as C
from tablefold.operators import transform as TR
from tablefold.operators.discover import TYPE_PATTERNS
from tablefold.plans.base import R, register
from tablefold.sources.tables import table


@register("transform_by_example", """SELECT c_custkey, lower(c_mktsegment) AS output FROM customer
    WHERE c_custkey % 2 = 1""")
def q_transform_by_example(spark, sf_dir):
    """Learn the segment -> lower-case segment rule on even customers, apply it to odd ones."""
    c = table(spark, sf_dir, "customer")
    ex = c.filter(F.col("c_custkey") % 2 == 0).select(F.col("c_mktsegment").alias("x"),
                                                      F.lower("c_mktsegment").alias("y"))
    name = TR.learn_transform(ex, "x", "y")
    test = c.filter(F.col("c_custkey") % 2 == 1).select("c_custkey", F.col("c_mktsegment").alias("x"))
    return TR.apply_transform(test, "x", name).select("c_custkey", "output")


@register("assign_headers", f"""WITH u AS (SELECT DISTINCT col_idx, value FROM (
    SELECT 0 AS col_idx, CAST(n_nationkey AS VARCHAR) AS value FROM nation
    UNION ALL SELECT 1, n_name FROM nation UNION ALL SELECT 2, CAST(n_regionkey AS VARCHAR) FROM nation)),
k AS (SELECT DISTINCT header, value FROM (
    SELECT 'r_regionkey' AS header, CAST(r_regionkey AS VARCHAR) AS value FROM region
    UNION ALL SELECT 'r_name', r_name FROM region)),
inter AS (SELECT col_idx, header, count(*) AS c FROM u JOIN k USING (value) GROUP BY ALL),
nu AS (SELECT col_idx, count(*) AS n_u FROM u GROUP BY ALL), nk AS (SELECT header, count(*) AS n_k FROM k GROUP BY ALL),
s AS (SELECT col_idx, header, CAST(c AS DOUBLE) / (n_u + n_k - c) AS jaccard FROM inter JOIN nu USING (col_idx)
      JOIN nk USING (header)),
r AS (SELECT *, row_number() OVER (PARTITION BY col_idx ORDER BY jaccard DESC, header) AS rc,
             row_number() OVER (PARTITION BY header ORDER BY jaccard DESC, col_idx) AS rh FROM s),
b AS (SELECT col_idx, header, jaccard FROM r WHERE rc = 1 AND rh = 1)
SELECT 'nation' AS case_id, 'nation' AS table_name, CAST(col_idx AS INTEGER) AS col_idx, header,
       round(jaccard, {R}) AS jaccard FROM (SELECT DISTINCT col_idx FROM u) LEFT JOIN b USING (col_idx)""")
def q_assign_headers(spark, sf_dir):
    """nation's columns (names hidden) get region's headers by value overlap (n_regionkey -> r_regionkey)."""
    cells = C.dataframe_cells(table(spark, sf_dir, "nation"), "nation", "nation", ["n_nationkey"])
    a = TR.assign_headers(cells, table(spark, sf_dir, "region"))
    return a.select("case_id", "table_name", "col_idx", "header", F.round("jaccard", R).alias("jaccard"))


HEADER_TABLES = {
    "lineitem": ("l_orderkey", {"l_partkey": "t", "l_suppkey": "t", "l_linenumber": "t", "l_quantity": "m", "l_extendedprice": "m", "l_discount": "m", "l_returnflag": "t",
                                "l_linestatus": "t", "l_shipdate": "d"}),
    "orders": ("o_orderkey", {"o_custkey": "t", "o_orderstatus": "t", "o_totalprice": "m", "o_orderdate": "d", "o_orderpriority": "t"}),
    "customer": ("c_custkey", {"c_name": "t", "c_nationkey": "t", "c_acctbal": "m", "c_mktsegment": "t"}),
}
SHAPE_SQL = "regexp_replace(regexp_replace(regexp_replace(value, '[0-9]+', '9', 'g'), '\\p{Lu}+', 'A', 'g'), '[\\p{Ll}\\p{Lt}\\p{Lm}\\p{Lo}]+', 'a', 'g')"


def _sides(spark, sf_dir):
    """Columns without names from the odd keys' rows, the same columns with their headers from the even keys' rows."""
    unnamed, known = [], []
    for name, (key, cols) in HEADER_TABLES.items():
        df = table(spark, sf_dir, name)
        text = {"t": lambda c: F.col(c).cast("string"), "m": lambda c: F.col(c).cast("decimal(18,2)").cast("string"), "d": lambda c: F.date_format(c, "yyyy-MM-dd")}
        cell = lambda tag: F.explode(F.array(*[F.struct((F.lit(i) if tag == "col_idx" else F.lit(c)).alias(tag), text[k](c).alias("value")) for i, (c, k) in enumerate(cols.items())]))
        for tag, rest, out in (("col_idx", 1, unnamed), ("header", 0, known)):
            out.append(df.where(F.col(key) % 2 == rest).select(F.lit(name).alias("case_id"), cell(tag).alias("x")).select("case_id", "x.*"))
    return reduce(DataFrame.union, unnamed), reduce(DataFrame.union, known)


def _match_sql() -> str:
    kinds = {"t": "CAST({c} AS VARCHAR)", "m": "CAST(CAST({c} AS DECIMAL(18,2)) AS VARCHAR)", "d": "strftime({c}, '%Y-%m-%d')"}
    side = lambda tag, rest: " UNION ALL ".join(
        f"SELECT '{t}' AS case_id, {i if tag == 'col_idx' else repr(c)} AS {tag}, {kinds[k].format(c=c)} AS value FROM {t} WHERE {key} % 2 = {rest}"
        for t, (key, cols) in HEADER_TABLES.items() for i, (c, k) in enumerate(cols.items()))
    kind = "CASE " + " ".join(f"WHEN regexp_matches(trim(value), '{p}') THEN '{k}'" for k, p in TYPE_PATTERNS.items()) + " ELSE 'text' END"
    parts = []
    for s, tag, rest in (("u", "col_idx", 1), ("k", "header", 0)):
        parts.append(f"""{s}0 AS ({side(tag, rest)}), {s}v AS (SELECT DISTINCT case_id, {tag}, value FROM {s}0),
{s}s AS (SELECT case_id, {tag}, {SHAPE_SQL} AS shape, CAST(count(*) AS DOUBLE) / any_value(t) AS share FROM (SELECT *, count(*) OVER (PARTITION BY case_id, {tag}) AS t FROM {s}0) GROUP BY ALL),
{s}t AS (SELECT * FROM (SELECT case_id, {tag}, {kind} AS kind, count(*) AS n FROM {s}0 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY case_id, {tag} ORDER BY n DESC, kind) = 1),
{s} AS (SELECT v.case_id, v.{tag}, count(*) AS nd, any_value(kind) AS kind FROM {s}v v JOIN {s}t USING (case_id, {tag}) GROUP BY ALL)""")
    return f"""WITH RECURSIVE {", ".join(parts)},
c AS (SELECT uv.case_id, col_idx, header, count(*) AS c FROM uv JOIN kv USING (case_id, value) GROUP BY ALL),
a AS (SELECT us.case_id, col_idx, header, sum(least(us.share, ks.share)) AS alike FROM us JOIN ks USING (case_id, shape) GROUP BY ALL),
s AS (SELECT case_id, col_idx, header, round(0.5 * (coalesce(c, 0) / CAST(u.nd + k.nd - coalesce(c, 0) AS DOUBLE)) + 0.3 * coalesce(alike, 0)
      + CASE WHEN u.kind = k.kind THEN 0.2 ELSE 0 END, 9) AS score FROM u JOIN k USING (case_id) LEFT JOIN c USING (case_id, col_idx, header) LEFT JOIN a USING (case_id, col_idx, header)),
o AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, col_idx, header) AS i FROM s WHERE score >= 0.4),
f AS (SELECT case_id, 0::BIGINT AS i, []::INTEGER[] AS cs, []::VARCHAR[] AS hs, []::DOUBLE[] AS ss FROM (SELECT DISTINCT case_id FROM u)
  UNION ALL SELECT f.case_id, o.i, CASE WHEN list_contains(cs, col_idx) OR list_contains(hs, header) THEN cs ELSE list_append(cs, col_idx) END,
    CASE WHEN list_contains(cs, col_idx) OR list_contains(hs, header) THEN hs ELSE list_append(hs, header) END,
    CASE WHEN list_contains(cs, col_idx) OR list_contains(hs, header) THEN ss ELSE list_append(ss, score) END FROM f JOIN o ON o.case_id = f.case_id AND o.i = f.i + 1),
l AS (SELECT case_id, unnest(cs) AS col_idx, unnest(hs) AS header, unnest(ss) AS score FROM f QUALIFY i = max(i) OVER (PARTITION BY case_id))
SELECT u.case_id, u.col_idx, l.header, round(l.score, {R}) AS score FROM u LEFT JOIN l ON u.case_id = l.case_id AND u.col_idx = l.col_idx"""


@register("match_headers", _match_sql())
def q_match_headers(spark, sf_dir):
    """The columns of three tables find their headers by the values, shapes and types of other rows."""
    unnamed, known = _sides(spark, sf_dir)
    m = TR.match_headers(TR.header_scores(unnamed, known))
    return m.select("case_id", "col_idx", "header", F.round("score", R).alias("score"))
