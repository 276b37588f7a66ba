"""From case folders to prompts in one plan.

A configuration is data: the prompt's fields, and for any data set fields of its own under
``<dataset>_fields`` (lower case). Field kinds:

* ``table.csv``: the case's file ``path``, read by ``reader``, passed through ``processors`` and ``serializer``;
* ``table.csv.path``: the same for the file that the case's info names under ``name``;
* ``text``: the info's value under ``name``;
* ``list``: the info's list under ``name``, each element filled into ``template`` by ``fields`` (placeholder -> key), joined by line breaks.

Each table field of each set of fields is one branch: the texts of its data sets' files, parsed inside their row, processed and
serialised. The branches' texts are gathered by case and joined to the cases once, from the left, so that no case is lost: one
whose table is missing has a NULL prompt (``drop_failed`` drops it, T10), an absent text keeps its placeholder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablefold.functions import values as V
from tablefold.operators import cells as C
from tablefold.operators.prompts import build_metadata, fill, info_text
from tablefold.sources.tables import case_cells, parse_case_texts

TABLES = ("table.csv", "table.csv.path")
ALIAS = "/table.csv"


def field_sets(config: dict) -> list[tuple[Column, dict]]:
    """(which cases, their fields): every data set with fields of its own, then the others."""
    own = {k[:-len("_fields")]: v for k, v in config.items() if k.endswith("_fields")}
    name = F.lower("dataset")
    rest = ~name.isin(*own) if own else F.lit(True)
    return [(name == k, v) for k, v in own.items()] + [(F.coalesce(rest, F.lit(True)), config["fields"])]


def _file(field: dict) -> Column:
    name = F.lit(field["path"]) if field["type"] == "table.csv" else F.get_json_object("info_json", f"$['{field['name']}']")
    return F.concat_ws("/", "case_path", F.when(name.isNotNull(), F.regexp_replace(name, r"^(?:\./)+", "")))


def table_texts(texts: DataFrame, cases: DataFrame, field: dict) -> DataFrame:
    """(case_path, text) of one table field: read, process, serialise."""
    wanted = cases.select("case_path", _file(field).alias("file_path"))
    named = texts.join(wanted, "file_path").select(F.concat("case_path", F.lit(ALIAS)).alias("file_path"), "text")    # a file may serve several cases
    cells = case_cells(parse_case_texts(named, field["reader"])).withColumn("case_id", F.expr(f"left(file_path, length(file_path) - {len(ALIAS)})"))
    cells = cells.select("case_id", "table_name", "row_idx", "col_idx", "col_name", "value")
    out = field["serializer"](C.apply(cells, field.get("processors", [])))
    return out.select(F.col("case_id").alias("case_path"), "text")


def list_text(info: Column, name: str, template: str, fields: dict[str, str]) -> Column:
    """T5: a list of the info, each element filled into a template of its own; NULL if it is no list."""
    items = F.try_variant_get(V.field(V.json_variant(info), name), "$", "array<variant>")
    return F.array_join(F.transform(items, lambda x: fill(template, {k: V.py_str(V.field(x, key)) for k, key in fields.items()})), "\n")


def build_prompts(texts: DataFrame, cases: DataFrame, template: str, config: dict, home: str | None = None) -> DataFrame:
    """``texts(file_path, text)``, ``cases(dataset, case_id, case_path, info_json)`` -> (dataset, case_id, case_path, prompt, metadata).

    One row for each case; ``case_path`` must name a case once. Metadata holds the configuration's keys and the case's info, which wins.
    """
    sets = field_sets(config)
    parts = []
    for which, fields in sets:
        for name, field in fields.items():
            if field["type"] in TABLES:
                parts.append(table_texts(texts, cases.where(which), field).select("case_path", F.lit(name).alias("field"), "text"))
    rows = cases
    if parts:
        found = reduce(DataFrame.unionByName, parts).groupBy("case_path").agg(F.map_from_entries(F.collect_list(F.struct("field", "text"))).alias("_texts"))
        rows = cases.join(found, "case_path", "left")
    info = F.col("info_json")
    prompt = F.lit(None).cast("string")
    for which, fields in reversed(sets):
        values, complete = {}, F.lit(True)
        for name, field in fields.items():
            if field["type"] in TABLES:
                values[name] = F.try_element_at("_texts", F.lit(name))
                complete = complete & values[name].isNotNull()
            elif field["type"] == "text":
                values[name] = info_text(info, field["name"])
            elif field["type"] == "list":
                values[name] = list_text(info, field["name"], field["template"], field["fields"])
            else:
                raise ValueError(f"unknown field type {field['type']}")
        prompt = F.when(which, F.when(complete, fill(template, values))).otherwise(prompt)
    fixed = {k: F.lit(config.get(k, "")) for k in ("task", "version", "tag", "note")}
    meta = build_metadata({**fixed, "dataset": F.col("dataset"), "test_case": F.col("case_id"), "case_path": F.col("case_path")}, info, home)
    return rows.select("dataset", "case_id", "case_path", prompt.alias("prompt"), meta.alias("metadata"))
