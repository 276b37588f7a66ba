"""Relation discovery over a typed DataFrame.

All candidates of a kind are checked in one pass over the data: the table is
turned into a long (column, value) form or one wide aggregate of generated
expressions, so Spark reads the table once per operator and aggregates with
map-side combining. Hot values only add to partial counts.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablefold.session import spread

NULL_TEXT = "\u0000null"
STRING_SEPARATORS = [" ", "#", "_", "-", ","]   # fixed values: separators tried by split/concat rules


def _txt(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(NULL_TEXT))


# D1 ------------------------------------------------------------------------
def functional_dependencies(df: DataFrame, columns: list[str] | None = None, max_error: float = 0.0) -> DataFrame:
    """Single-determinant dependencies A -> B with their error ratio.

    error = share of rows to remove so that every value of A maps to one value
    of B (rows outside each A-group's most common B). One pass: a row emits one
    (A, a, B, b) item per unordered column pair, counted map-side; both directions of
    a pair are read from the same counts, so the first exchange carries half of what ordered pairs would.
    """
    cols = columns or df.columns
    df = spread(df.select(*cols))
    side = lambda a, b: F.struct(F.lit(a).alias("det"), _txt(a).alias("a"), F.lit(b).alias("dep"), _txt(b).alias("b"))
    long = df.select(F.inline(F.array(*[side(a, b) for a, b in combinations(cols, 2)])))
    once = long.groupBy("det", "dep", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    back = F.struct(F.col("dep").alias("det"), F.col("b").alias("a"), F.col("det").alias("dep"), F.col("a").alias("b"), "n")
    ab = once.select(F.inline(F.array(F.struct("det", "a", "dep", "b", "n"), back)))
    per_a = ab.groupBy("det", "dep", "a").agg(F.max("n").alias("top"), F.sum("n").alias("rows"),
                                              F.count(F.lit(1)).alias("n_b"))
    g = per_a.groupBy("det", "dep").agg(
        F.sum("rows").alias("n_rows"), F.sum("top").alias("kept"),
        F.count(F.lit(1)).alias("n_det_values"), F.sum("n_b").alias("n_pairs"))
    err = (F.col("n_rows") - F.col("kept")) / F.col("n_rows")
    return g.select("det", "dep", F.col("n_det_values").cast("bigint").alias("n_det_values"),
                    F.col("n_pairs").cast("bigint").alias("n_pairs"),
                    err.cast("double").alias("error"), (err <= max_error).alias("holds"))


# D2 ------------------------------------------------------------------------
OPS = {"+": lambda b, c: b + c, "-": lambda b, c: b - c, "*": lambda b, c: b * c,
       "/": lambda b, c: F.try_divide(b, c)}


def arithmetic_relations(df: DataFrame, columns: list[str], tol: float = 1e-6, min_support: float = 0.95) -> DataFrame:
    """``A = B op C`` (op in + - * /) holding on at least ``min_support`` of rows.

    Every candidate is one ``avg`` in a single generated aggregate (one scan),
    which also says which columns are all zero or NULL: their candidates are left out.
    Support = share of rows with ``|A - (B op C)| <= tol * max(1, |A|)``.
    """
    cols = columns
    cands = [(a, b, op, c) for a in cols for b in cols for c in cols for op in OPS
             if len({a, b, c}) == 3 and not (op in "+*" and b > c)]
    if not cands:
        return df.sparkSession.createDataFrame([], "target string, formula string, support double")
    aggs = []
    for i, (a, b, op, c) in enumerate(cands):
        A, B, Cc = (F.col(x).cast("double") for x in (a, b, c))
        ok = F.abs(A - OPS[op](B, Cc)) <= F.lit(tol) * F.greatest(F.lit(1.0), F.abs(A))
        aggs.append(F.avg(F.when(ok, 1.0).otherwise(0.0)).alias(f"s{i}"))
    used = [F.coalesce(F.max(F.abs(F.col(c))) != 0, F.lit(False)).alias(f"u{i}") for i, c in enumerate(cols)]
    row = spread(df.select(*cols)).agg(*aggs, *used)
    use = lambda *names: F.least(*[F.col(f"u{cols.index(n)}") for n in names])
    stacked = row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("target"),
                                                      F.lit(f"{a}={b}{op}{c}").alias("formula"),
                                                      F.when(use(a, b, c), F.col(f"s{i}")).alias("support"))
                                             for i, (a, b, op, c) in enumerate(cands)])).alias("x")).select("x.*")
    return stacked.filter(F.col("support") >= min_support)


# D3 ------------------------------------------------------------------------
def _string_rules(s: Column, t: Column) -> list[tuple[str, Column]]:
    rules = [("equal", t == s), ("prefix", t.startswith(s)), ("suffix", t.endswith(s)),
             ("substring", t.contains(s)), ("lower", t == F.lower(s)), ("upper", t == F.upper(s))]
    for sep in STRING_SEPARATORS:
        for i in (1, 2, 3):
            rules.append((f"split[{sep}]{i}", t == F.split_part(s, F.lit(sep), F.lit(i))))
    return rules


def string_relations(df: DataFrame, columns: list[str], min_support: float = 0.95) -> DataFrame:
    """D3: string relations source -> target (equal, prefix, suffix, substring, case change,
    split part, and ``S1 <sep> S2`` concatenation) with support share, one generated aggregate."""
    cands = []
    for s, t in permutations(columns, 2):
        S, Tt = F.col(s).cast("string"), F.col(t).cast("string")
        for name, cond in _string_rules(S, Tt):
            cands.append((t, f"{name}({s})", cond))
    for t in columns:
        for s1, s2 in permutations([c for c in columns if c != t], 2):
            for sep in (" ", "_", "-"):
                cond = F.col(t).cast("string") == F.concat_ws(sep, F.col(s1).cast("string"), F.col(s2).cast("string"))
                cands.append((t, f"concat[{sep}]({s1},{s2})", cond))
    aggs = [F.avg(F.when(F.coalesce(cond, F.lit(False)), 1.0).otherwise(0.0)).alias(f"s{i}")
            for i, (_, _, cond) in enumerate(cands)]
    row = spread(df.select(*columns)).agg(*aggs)
    stacked = row.select(F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.lit(r).alias("relation"),
                                                      F.col(f"s{i}").alias("support"))
                                             for i, (t, r, _) in enumerate(cands)])).alias("x")).select("x.*")
    return stacked.filter(F.col("support") >= min_support)


# D4 ------------------------------------------------------------------------
def name_suffix(name: str) -> str:
    """``l_partkey`` -> ``partkey``: the name without its table prefix."""
    return name.split("_", 1)[1] if "_" in name else name


def name_key(name: str) -> str:
    """``l_partkey`` -> ``partkey``: the name without a table's abbreviation of one or two letters; ``doc_id`` stays."""
    head, _, rest = name.partition("_")
    return rest if rest and len(head) <= 2 else name


def _family(dtype: str) -> str | None:
    """Types whose values can be equal: numbers, texts, points in time, truth values; None for nested ones."""
    if dtype in ("tinyint", "smallint", "int", "bigint", "float", "double") or dtype.startswith("decimal"):
        return "n"
    return {"string": "s", "date": "d", "timestamp": "d", "timestamp_ntz": "d", "boolean": "b"}.get(dtype)


def _value_key(c: str, dtype: str) -> Column:
    """One text for equal values of a family; NULL and NaN have none, long texts go by their hash."""
    v = F.col(c)
    if _family(dtype) == "s":
        return F.when(F.length(v) > 48, F.md5(v.cast("binary"))).otherwise(v)
    if dtype in ("float", "double") or dtype.startswith("decimal"):
        d = v.cast("double")
        whole = (d == F.floor(d)) & (F.abs(d) < 1e15)
        return F.when(~F.isnan(d), F.when(whole, d.cast("bigint").cast("string")).otherwise(d.cast("string")))
    return (v.cast("timestamp") if dtype == "date" else v).cast("string")


WORD_BITS = 62


def key_foreign_keys(tables: dict[str, DataFrame], min_containment: float = 1.0) -> DataFrame:
    """(fk_table, fk_column) -> (pk_table, pk_column) over all columns of all scalar types.

    Key side: a column whose values are unique and never NULL. Pairs are formed between columns of one type family
    and name key (``o_custkey`` ~ ``c_custkey``): dense small integer keys make value overlap alone report
    false joins. Columns without a namesake are left out by metadata. One aggregate maps each value to a
    bitmap of the columns that hold it; a second one counts the bitmaps' column pairs and, from the same columns,
    rows and values by column. Pairs of columns fit in one row, from which containment (distinct fk values found among
    key values / distinct fk values) is read.
    """
    found = [(t, c, ty, (_family(ty), name_key(c))) for t, df in tables.items() for c, ty in df.dtypes if _family(ty)]
    names = [x[3] for x in found]
    cols = [x for x in found if names.count(x[3]) > 1]
    spark = next(iter(tables.values())).sparkSession
    if not cols:
        return spark.createDataFrame([], "fk_table string, fk_column string, pk_table string, pk_column string, "
                                         "n_hits bigint, n_fk_distinct bigint, containment double")
    words = -(-len(cols) // WORD_BITS)
    values, counts = [], []
    for t, df in tables.items():
        mine = [(i, c, ty, key) for i, (tt, c, ty, key) in enumerate(cols) if tt == t]
        if not mine:
            continue
        d = df.select(*[c for _, c, _, _ in mine])
        item = [F.struct(F.lit("|".join(key)).alias("key"), _value_key(c, ty).alias("value"),
                         *[F.lit(1 << i % WORD_BITS if i // WORD_BITS == w else 0).cast("long").alias(f"w{w}") for w in range(words)]) for i, c, ty, key in mine]
        values.append(d.select(F.explode(F.array(*item)).alias("x")).select("x.*").where("value IS NOT NULL"))
        tally = [F.struct(F.lit(i).alias("a"), F.lit(-1).alias("b")) for i, _, _, _ in mine]
        counts.append(d.select(F.explode(F.array(*tally)).alias("x")).select("x.a", "x.b"))
    held = reduce(DataFrame.unionByName, values).groupBy("key", "value").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(words)])
    bits = ", ".join(f"if((w{i // WORD_BITS} & {1 << i % WORD_BITS}L) <> 0, {i}, NULL)" for i in range(len(cols)))
    holders = F.array_compact(F.expr(f"array({bits})"))
    pairs = held.select(holders.alias("h")).select(F.explode("h").alias("a"), "h").select("a", F.explode("h").alias("b"))
    n = reduce(DataFrame.unionByName, counts, pairs).groupBy("a", "b").agg(F.count("*").alias("n"))
    # at most (columns + 1) ** 2 entries, by metadata
    row = n.agg(F.map_from_entries(F.collect_list(F.struct((F.col("a") * (len(cols) + 1) + F.col("b") + 1).alias("k"), "n"))).alias("m"))
    text = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    entry = lambda x, y: f"coalesce(try_element_at(m, {x * (len(cols) + 1) + y + 1}), 0L)"
    cands = [f"struct({text(ft)} AS fk_table, {text(fc)} AS fk_column, {text(pt)} AS pk_table, {text(pc)} AS pk_column, {entry(i, j)} AS n_hits, "
             f"{entry(i, i)} AS n_fk_distinct, {entry(j, j)} AS pk_distinct, {entry(j, -1)} AS pk_rows)"
             for i, (ft, fc, _, key) in enumerate(cols) for j, (pt, pc, _, other) in enumerate(cols) if i != j and key == other]
    out = row.select(F.expr(f"inline(array({', '.join(cands)}))")).where("n_fk_distinct > 0 AND pk_distinct = pk_rows")
    out = out.withColumn("containment", (F.col("n_hits") / F.col("n_fk_distinct")).cast("double")).drop("pk_distinct", "pk_rows")
    return out.filter(F.col("containment") >= min_containment)


# D23 -----------------------------------------------------------------------
TYPE_PATTERNS = {   # fixed values: syntactic classes of a text cell
    "int": r"^[+-]?\d+$",
    "float": r"^[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?$",
    "date": r"^\d{4}-\d{2}-\d{2}",
    "bool": r"(?i)^(true|false|yes|no)$",
}


def column_type_profile(cells: DataFrame) -> DataFrame:
    """Per (table, column): share of empty cells and of each syntactic type among the rest."""
    v = F.trim(F.col("value"))
    aggs = [F.avg(F.when(v == "", 1.0).otherwise(0.0)).alias("empty_share")]
    for name, pat in TYPE_PATTERNS.items():
        aggs.append(F.avg(F.when(v == "", None).when(v.rlike(pat), 1.0).otherwise(0.0)).alias(f"{name}_share"))
    g = cells.groupBy("case_id", "table_name", "col_idx", "col_name").agg(*aggs)
    best = F.when(F.col("int_share") == 1, "int").when(F.col("float_share") == 1, "float") \
        .when(F.col("date_share") == 1, "date").when(F.col("bool_share") == 1, "bool").otherwise("text")
    return g.withColumn("type", F.when(F.col("empty_share") == 1, F.lit("empty")).otherwise(best))
