"""The shared parquet tables and case-table readers."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablefold.functions.values import double_text

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One shared table; Spark prunes columns and pushes filters into the parquet scan."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


# ---------------------------------------------------------------------------
# CSV case tables -> cells
# ---------------------------------------------------------------------------
READERS = {
    "pandas": dict(header=True, infer=True),          # S1 inferred types
    "pandas.str": dict(header=True, infer=False),     # S2 all strings
    "pandas.w_idx": dict(header=True, infer=False, index=True),   # S3 first column is the row label
    "pandas.no_header": dict(header=False, infer=True),           # S4 positional names, inferred types
}

# possessive throughout: matching loops instead of recursing, so long texts don't overflow the stack
_QUOTED = r'"(?:[^"]++|"")*+"'
_FIELD = rf"(?:{_QUOTED}[^,\r\n]*+|[^,\r\n]*+)"
_RECORD = rf"({_FIELD}(?:,{_FIELD})*+)(?:\r\n|\n|\r)"
_IN_RECORD = rf"({_QUOTED}[^,]*+|[^,]*+),"
_INT, _FLOAT = r"^\s*[+-]?\d+\s*$", r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$"
_BOOL = r"^(?:True|TRUE|true|False|FALSE|false)$"


def _records(text: Column) -> Column:
    """CSV text -> records: quoted line breaks stay inside, blank lines are skipped."""
    text = F.regexp_replace(text, r"^\x{FEFF}", "")
    text = F.when(text.rlike(r"[\r\n]\z"), text).otherwise(F.concat(text, F.lit("\n")))
    return F.filter(F.regexp_extract_all(text, F.lit(_RECORD), 1), lambda r: F.trim(F.translate(r, "\t", " ")) != "")


def _fields(record: Column) -> Column:
    """One record -> unquoted fields; a quote that is not closed is plain text."""
    def plain(f: Column) -> Column:
        inner = F.regexp_extract(f, r'(?s)^"((?:[^"]++|"")*+)"', 1)
        after = F.regexp_extract(f, r'(?s)^"(?:[^"]++|"")*+"(.*)$', 1)
        return F.when(f.rlike(f"^{_QUOTED}"), F.concat(F.replace(inner, F.lit('""'), F.lit('"')), after)).otherwise(f)

    return F.transform(F.regexp_extract_all(F.concat(record, F.lit(",")), F.lit(_IN_RECORD), 1), plain)


def _header(names: Column) -> Column:
    """Blank names become ``Unnamed: <i>``; the k-th repetition of a name gets ``.k``."""
    named = F.transform(names, lambda n, i: F.when(n == "", F.concat(F.lit("Unnamed: "), i.cast("string"))).otherwise(n))

    def numbered(n: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(named, F.lit(1), i), lambda x: x == n))
        return F.when(before > 0, F.concat(n, F.lit("."), before.cast("string"))).otherwise(n)

    return F.transform(named, numbered)


def _kind(rows: Column, col: Column) -> Column:
    """int, float, bool or text: the narrowest type that all values of a column have."""
    def all_match(pattern: str) -> Column:
        return F.forall(rows, lambda r: F.get(r, col).rlike(pattern))

    return (F.when(F.size(rows) == 0, "text").when(all_match(_INT), "int").when(all_match(_FLOAT), "float")
            .when(all_match(_BOOL), "bool").otherwise("text"))


def _typed(value: Column, kind: Column) -> Column:
    """The text of a value once read as its column's type: ``007`` -> ``7``, ``1.50`` -> ``1.5``; integers of any length."""
    whole = F.regexp_replace(F.regexp_replace(F.trim(F.translate(value, "\t", " ")), r"^\+?(-?)0*(\d)", "$1$2"), "^-0$", "0")
    return (F.when(kind == "int", whole)
            .when(kind == "float", double_text(F.trim(value).try_cast("double")))
            .when(kind == "bool", F.initcap(value)).otherwise(value))


def parse_case_texts(texts: DataFrame, reader: str = "pandas", infer: bool | None = None) -> DataFrame:
    """``texts(file_path, text)`` -> one row per file: ``header``, ``rows``, ``bad_rows``.

    ``rows`` holds every row at the header's width: short rows are padded with '', of longer
    rows the surplus is cut and the row's number (from 0) listed in ``bad_rows``; no row is lost. An empty
    or NULL text is a table without columns, a header alone one without rows. ``infer`` overrides the
    reader's choice of typed or plain text. With row labels (S3) ``labels`` holds column 0.
    All work is inside the row (a case table is small, the corpus is many files): no shuffle.
    """
    opts = READERS[reader]
    infer = opts["infer"] if infer is None else infer
    d = texts.withColumn("_all", F.transform(_records(F.coalesce("text", F.lit(""))), _fields))
    first = F.coalesce(F.get("_all", F.lit(0)), F.array().cast("array<string>"))
    if opts["header"]:
        d = d.withColumn("header", _header(first)).withColumn("_body", F.slice("_all", F.lit(2), F.size("_all")))
    else:
        d = d.withColumn("header", F.transform(first, lambda _, i: i.cast("string"))).withColumn("_body", F.col("_all"))
    width = F.size("header")
    d = d.withColumn("bad_rows", F.filter(F.transform("_body", lambda r, i: F.when(F.size(r) > width, i)), lambda i: i.isNotNull()))
    d = d.withColumn("rows", F.transform("_body", lambda r: F.slice(
        F.concat(r, F.array_repeat(F.lit(""), F.greatest(width - F.size(r), F.lit(0)))), F.lit(1), width)))
    if infer:
        cols = F.when(width > 0, F.sequence(F.lit(0), width - 1)).otherwise(F.array().cast("array<int>"))
        d = d.withColumn("kinds", F.transform(cols, lambda c: _kind(F.col("rows"), c)))
        d = d.withColumn("rows", F.transform("rows", lambda r: F.transform(r, lambda v, i: _typed(v, F.get("kinds", i)))))
    if opts.get("index"):
        d = d.withColumn("labels", F.transform("rows", lambda r: F.coalesce(F.get(r, F.lit(0)), F.lit(""))))
        d = d.withColumn("header", F.slice("header", F.lit(2), F.greatest(width - 1, F.lit(0))))
        d = d.withColumn("rows", F.transform("rows", lambda r: F.slice(r, F.lit(2), F.size(r))))
    return d.drop("_all", "_body", "kinds", "text")


def case_cells(tables: DataFrame) -> DataFrame:
    """``parse_case_texts`` -> ``cells(file_path, case_id, table_name, row_idx, col_idx, col_name, value, bad_row)``."""
    label = ["labels"] if "labels" in tables.columns else []
    # an inner explode would infer a filter on ``rows``, pushed below the parsing and parsing once more per value
    rows = tables.select("file_path", "header", "bad_rows", *label, F.posexplode_outer("rows").alias("row_idx", "row")).where("row_idx IS NOT NULL")
    label = [F.get("labels", F.col("row_idx")).alias("row_label")] if label else []
    cells = rows.select("file_path", "header", "row_idx", F.array_contains("bad_rows", F.col("row_idx")).alias("bad_row"), *label,
                        F.posexplode("row").alias("col_idx", "value"))
    return cells.select("file_path", F.regexp_extract("file_path", r"([^/]+)/[^/]+$", 1).alias("case_id"),
                        F.regexp_extract("file_path", r"([^/]+)\.csv$", 1).alias("table_name"),
                        "row_idx", "col_idx", F.get("header", F.col("col_idx")).alias("col_name"), "value", "bad_row",
                        *(["row_label"] if label else []))


def case_headers(tables: DataFrame) -> DataFrame:
    """``parse_case_texts`` -> one row per file, those without rows or columns too."""
    return tables.select("file_path", F.regexp_extract("file_path", r"([^/]+)/[^/]+$", 1).alias("case_id"),
                         F.regexp_extract("file_path", r"([^/]+)\.csv$", 1).alias("table_name"),
                         F.col("header").alias("col_names"), F.size("rows").alias("n_rows"), F.size("bad_rows").alias("n_bad"))


SECOND_ENCODING = "ISO-8859-1"           # fixed value: tried where a file is not UTF-8


def decoded(content: Column, second: str = SECOND_ENCODING) -> Column:
    """Bytes (or a string of raw bytes) as UTF-8 if they are that, else in the second encoding."""
    raw = content.cast("string")
    return F.when(F.is_valid_utf8(raw), raw).otherwise(F.decode(content.cast("binary"), second))


def read_case_texts(spark: SparkSession, path_glob: str, second: str = SECOND_ENCODING) -> DataFrame:
    """Whole files -> ``texts(file_path, text)``, each decoded by itself (S9); Spark parallelises over files."""
    return (spark.read.text(path_glob, wholetext=True)
            .select(F.col("_metadata.file_path").alias("file_path"), decoded(F.col("value"), second).alias("text")))


def encoding_of(spark: SparkSession, path: str, second: str = SECOND_ENCODING) -> str:
    """The encoding of one large file, by a scan of its lines for bytes that are not UTF-8."""
    return second if spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).count() else "UTF-8"


def read_case_tables(spark: SparkSession, path_glob: str, reader: str = "pandas",
                     second: str = SECOND_ENCODING, infer: bool | None = None) -> DataFrame:
    """CSV files -> cells, see ``parse_case_texts``. Empty cells are '' (never NULL)."""
    return case_cells(parse_case_texts(read_case_texts(spark, path_glob, second), reader, infer))


def named_case_tables(cells: DataFrame, cases: DataFrame, field: str) -> DataFrame:
    """The cells of the table that each case's info names by relative path under ``field``.

    ``cases`` as ``read_case_infos`` gives them; one join on the path. ``case_id`` becomes the case's;
    a case whose info lacks the field, or names no file of ``cells``, has no cells.
    """
    named = F.get_json_object("info_json", f"$['{field}']")
    paths = cases.select(F.col("case_id").alias("_case"), F.concat_ws("/", "case_path", F.regexp_replace(named, r"^(?:\./)+", ""))
                         .alias("file_path")).where(named.isNotNull())
    return cells.join(paths, "file_path").withColumn("case_id", F.col("_case")).select(*cells.columns)


def read_case_infos(spark: SparkSession, root: str) -> DataFrame:
    """``<root>/<dataset>/<case>/info.json`` -> cases(dataset, case_id, case_path, info)."""
    raw = spark.read.text(os.path.join(root, "*", "*", "info.json"), wholetext=True)
    path = F.col("_metadata.file_path")
    return raw.select(
        F.regexp_extract(path, r"([^/]+)/[^/]+/info\.json$", 1).alias("dataset"),
        F.regexp_extract(path, r"([^/]+)/info\.json$", 1).alias("case_id"),
        F.regexp_extract(path, r"^(.*)/info\.json$", 1).alias("case_path"),
        F.col("value").alias("info_json"))


def load_entity_pairs(spark: SparkSession, folder: str, rename: dict | None = None,
                      drop: list[str] | None = None, second: str = SECOND_ENCODING) -> dict[str, DataFrame]:
    """tableA, tableB, train, valid, test, each in the encoding that it has; renames and drops (by default those
    of the folder's ``info.json``, ``rename_columns`` and ``drop_columns``) hold for the two tables only. ``info`` is that file as a row."""
    info = spark.read.text(os.path.join(folder, "info.json"), wholetext=True) if rename is None and drop is None else None
    if info is not None:
        parsed = info.select(F.from_json("value", "rename_columns map<string,string>, drop_columns array<string>").alias("i")).first()
        rename, drop = (parsed[0].rename_columns, parsed[0].drop_columns) if parsed and parsed[0] else ({}, [])
    out = {} if info is None else {"info": info}
    for name in ("tableA", "tableB", "train", "valid", "test"):
        path = os.path.join(folder, f"{name}.csv")
        df = spark.read.option("header", True).option("inferSchema", True).option("encoding", encoding_of(spark, path, second)).csv(path)
        if name in ("tableA", "tableB"):
            df = df.withColumnsRenamed({k: v for k, v in (rename or {}).items() if k in df.columns})
            df = df.drop(*[c for c in drop or [] if c in df.columns])
        out[name] = df
    return out
