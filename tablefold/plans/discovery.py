"""Discovery queries (D1-D4, D23) on the shared tables, with brute-force SQL oracles."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import functions as F

from tablefold.operators import cells as C
from tablefold.operators import discover as DV
from tablefold.plans.base import R, register
from tablefold.plans.tables import f4
from tablefold.sources.tables import TABLES, table


def _fd_sql(tbl: str, cols: list[str]) -> str:
    parts = []
    for a, b in permutations(cols, 2):
        parts.append(f"""SELECT '{a}' AS det, '{b}' AS dep, count(*) AS n_det_values, CAST(sum(n_b) AS BIGINT) AS n_pairs,
  round(CAST(sum(rows_) - sum(top) AS DOUBLE) / sum(rows_), {R}) AS error, sum(rows_) - sum(top) = 0 AS holds
FROM (SELECT a, sum(n) AS rows_, max(n) AS top, count(*) AS n_b FROM (
  SELECT CAST({a} AS VARCHAR) AS a, CAST({b} AS VARCHAR) AS b, count(*) AS n FROM {tbl} GROUP BY 1, 2) GROUP BY a)""")
    return " UNION ALL ".join(parts)


def _fd(tbl, cols):
    def q(spark, sf_dir):
        f = DV.functional_dependencies(table(spark, sf_dir, tbl), cols)
        return f.select("det", "dep", "n_det_values", "n_pairs", F.round("error", R).alias("error"), "holds")
    return q


NATION_COLS = ["n_nationkey", "n_name", "n_regionkey"]
PART_COLS = ["p_brand", "p_type", "p_size", "p_name"]
register("fd_nation", _fd_sql("nation", NATION_COLS))(_fd("nation", NATION_COLS))
register("fd_part", _fd_sql("part", PART_COLS))(_fd("part", PART_COLS))

ARITH_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SQL_OPS = {"+": "{b} + {c}", "-": "{b} - {c}", "*": "{b} * {c}", "/": "CASE WHEN {c} = 0 THEN NULL ELSE {b} / {c} END"}


def _arith_sql() -> str:
    cands = [(a, b, op, c) for a in ARITH_COLS for b in ARITH_COLS for c in ARITH_COLS for op in SQL_OPS
             if len({a, b, c}) == 3 and not (op in "+*" and b > c)]
    parts = []
    for a, b, op, c in cands:
        e = SQL_OPS[op].format(b=f"CAST({b} AS DOUBLE)", c=f"CAST({c} AS DOUBLE)")
        parts.append(f"""SELECT '{a}' AS target, '{a}={b}{op}{c}' AS formula,
  round(avg(CASE WHEN abs({a} - ({e})) <= 1e-6 * greatest(1.0, abs({a})) THEN 1.0 ELSE 0.0 END), {R}) AS support
  FROM lineitem""")
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ")"


@register("arithmetic_relations", _arith_sql())
def q_arith(spark, sf_dir):
    """D2 over lineitem's numeric columns (all candidates with their support)."""
    r = DV.arithmetic_relations(table(spark, sf_dir, "lineitem"), ARITH_COLS, min_support=0.0)
    return r.select("target", "formula", F.round("support", R).alias("support"))


def _sr_sql(tbl: str, cols: list[str], min_support: float) -> str:
    parts = []

    def add(t, rel, cond):
        parts.append(f"SELECT '{t}' AS target, '{rel}' AS relation, round(avg(CASE WHEN coalesce({cond}, false) "
                     f"THEN 1.0 ELSE 0.0 END), {R}) AS support FROM {tbl}")
    for s, t in permutations(cols, 2):
        S, T = f"CAST({s} AS VARCHAR)", f"CAST({t} AS VARCHAR)"
        add(t, f"equal({s})", f"{T} = {S}")
        add(t, f"prefix({s})", f"starts_with({T}, {S})")
        add(t, f"suffix({s})", f"ends_with({T}, {S})")
        add(t, f"substring({s})", f"contains({T}, {S})")
        add(t, f"lower({s})", f"{T} = lower({S})")
        add(t, f"upper({s})", f"{T} = upper({S})")
        for sep in DV.STRING_SEPARATORS:
            for i in (1, 2, 3):
                add(t, f"split[{sep}]{i}({s})", f"{T} = split_part({S}, '{sep}', {i})")
    for t in cols:
        for s1, s2 in permutations([c for c in cols if c != t], 2):
            for sep in (" ", "_", "-"):
                add(t, f"concat[{sep}]({s1},{s2})",
                    f"CAST({t} AS VARCHAR) = concat_ws('{sep}', CAST({s1} AS VARCHAR), CAST({s2} AS VARCHAR))")
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE support >= {min_support}"


@register("string_relations", _sr_sql("nation", NATION_COLS, 0.5))
def q_string_relations(spark, sf_dir):
    """D3 over nation (finds n_name = 'NATION_' || n_nationkey as suffix / split part)."""
    r = DV.string_relations(table(spark, sf_dir, "nation"), NATION_COLS, min_support=0.5)
    return r.select("target", "relation", F.round("support", R).alias("support"))


#: Columns that share type family and name key with another one; the query finds them itself.
FK_COLUMNS = {
    "DOUBLE": ["region.r_regionkey", "nation.n_regionkey", "nation.n_nationkey", "customer.c_nationkey", "supplier.s_nationkey", "customer.c_custkey",
               "orders.o_custkey", "supplier.s_suppkey", "lineitem.l_suppkey", "part.p_partkey", "lineitem.l_partkey", "orders.o_orderkey", "lineitem.l_orderkey",
               "customer.c_acctbal", "supplier.s_acctbal", "documents.doc_id", "labels.doc_id"],
    "VARCHAR": ["region.r_name", "nation.n_name", "customer.c_name", "supplier.s_name", "part.p_name", "documents.text", "benchmark.text", "conversations.text"],
}


def _fk_sql() -> str:
    long = " UNION ALL ".join(
        f"SELECT '{c.split('.')[0]}' AS tbl, '{c.split('.')[1]}' AS col, '{DV.name_key(c.split('.')[1])}' AS suffix, "
        f"CAST(CAST({c.split('.')[1]} AS {kind}) AS VARCHAR) AS value FROM {c.split('.')[0]}"
        for kind, cols in FK_COLUMNS.items() for c in cols)
    return f"""WITH long AS ({long}),
stats AS (SELECT tbl, col, suffix, count(*) AS n, count(value) AS nn, count(DISTINCT value) AS nd FROM long GROUP BY ALL),
keys AS (SELECT tbl AS pk_table, col AS pk_column, suffix FROM stats WHERE n = nn AND nd = n),
dv AS (SELECT DISTINCT tbl, col, suffix, value FROM long WHERE value IS NOT NULL),
h AS (SELECT f.tbl AS fk_table, f.col AS fk_column, k.pk_table, k.pk_column, count(*) AS n_hits
      FROM dv f JOIN dv p ON f.suffix = p.suffix AND f.value = p.value
      JOIN keys k ON p.tbl = k.pk_table AND p.col = k.pk_column
      WHERE NOT (f.tbl = k.pk_table AND f.col = k.pk_column) GROUP BY ALL)
SELECT h.*, nd AS n_fk_distinct, CAST(n_hits AS DOUBLE) / nd AS containment
FROM h JOIN stats s ON s.tbl = h.fk_table AND s.col = h.fk_column WHERE CAST(n_hits AS DOUBLE) / nd >= 0.05"""


@register("key_foreign_keys", _fk_sql())
def q_fk(spark, sf_dir):
    """D4 over all columns of all tables: inclusions of 5 % and more in a key of the same name and type family."""
    return DV.key_foreign_keys({t: table(spark, sf_dir, t) for t in TABLES}, 0.05).select(
        "fk_table", "fk_column", "pk_table", "pk_column", "n_hits", "n_fk_distinct", "containment")


def _types_sql() -> str:
    shares = ", ".join(
        f"avg(CASE WHEN trim(value) = '' THEN NULL WHEN regexp_matches(trim(value), '{pat}') THEN 1.0 ELSE 0.0 END)"
        f" AS {name}_share" for name, pat in DV.TYPE_PATTERNS.items())
    return f4(f"""g AS (SELECT case_id, table_name, col_idx, col_name,
  avg(CASE WHEN trim(value) = '' THEN 1.0 ELSE 0.0 END) AS empty_share, {shares}
  FROM cells GROUP BY ALL)
SELECT case_id, table_name, col_idx, col_name, round(empty_share, {R}) AS empty_share,
  round(int_share, {R}) AS int_share, round(date_share, {R}) AS date_share,
  CASE WHEN empty_share = 1 THEN 'empty' WHEN int_share = 1 THEN 'int' WHEN float_share = 1 THEN 'float'
       WHEN date_share = 1 THEN 'date' WHEN bool_share = 1 THEN 'bool' ELSE 'text' END AS type FROM g""")


@register("column_types", _types_sql())
def q_column_types(spark, sf_dir):
    """Syntactic type shares per column of every order's table."""
    p = DV.column_type_profile(C.lineitem_cells(spark, sf_dir))
    return p.select("case_id", "table_name", "col_idx", "col_name", F.round("empty_share", R).alias("empty_share"),
                    F.round("int_share", R).alias("int_share"), F.round("date_share", R).alias("date_share"), "type")
