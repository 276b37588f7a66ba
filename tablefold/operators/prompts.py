"""Prompt construction.

A template is split once on the driver into literal pieces and placeholder
names; filling it is one ``concat`` of literals and columns per row, so
Catalyst folds the literals and the fill stays inside whole-stage codegen.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablefold.functions import values as V

PLACEHOLDER = re.compile(r"\{\{\{(.*?)\}\}\}")   # fixed value: the reference's {{{name}}} syntax
IDENTIFIER = r"^[A-Za-z_][A-Za-z0-9_]*$"
REQUIRED_KEYS = ["prompt_template", "dataset_config"]


def split_template(template: str) -> list[tuple[str, str]]:
    """Template -> [("lit", text) | ("var", name)] (driver-side, once)."""
    out, pos = [], 0
    for m in PLACEHOLDER.finditer(template):
        if m.start() > pos:
            out.append(("lit", template[pos:m.start()]))
        out.append(("var", m.group(1)))
        pos = m.end()
    if pos < len(template):
        out.append(("lit", template[pos:]))
    return out


# T2 / T3 -------------------------------------------------------------------
def fill(template: str, values: dict[str, Column]) -> Column:
    """Single-pass fill (ledger L14); unknown or NULL fields keep their placeholder."""
    parts = []
    for kind, x in split_template(template):
        if kind == "lit":
            parts.append(F.lit(x))
        elif x in values:
            parts.append(F.coalesce(values[x].cast("string"), F.lit("{{{" + x + "}}}")))
        else:
            parts.append(F.lit("{{{" + x + "}}}"))
    return F.concat(*parts) if parts else F.lit("")


def info_text(info: Column, name: str) -> Column:
    """``str(info[name])`` from a JSON info column (NULL when absent)."""
    return V.py_str(V.field(V.json_variant(info), name))


# T1 ------------------------------------------------------------------------
def lint_configs(configs: DataFrame) -> DataFrame:
    """Per config row: placeholders that are not identifiers, missing required keys.

    ``configs(name, prompt_template, keys ARRAY<STRING>)``.
    """
    ph = F.regexp_extract_all("prompt_template", F.lit(r"\{\{\{(.*?)\}\}\}"), 1)
    bad = F.filter(ph, lambda p: ~p.rlike(IDENTIFIER))
    missing = F.filter(F.array(*[F.lit(k) for k in REQUIRED_KEYS]), lambda k: ~F.array_contains("keys", k))
    return configs.select("name", ph.alias("placeholders"), bad.alias("bad_placeholders"),
                          missing.alias("missing_keys"),
                          ((F.size(bad) == 0) & (F.size(missing) == 0)).alias("ok"))


# T5 ------------------------------------------------------------------------
def list_field(items: DataFrame, key: list[str], sub_template: str, columns: dict[str, str],
               order_col: str = "pos") -> DataFrame:
    """T5: one sub-template per element, elements joined by newline in ``order_col`` order."""
    filled = fill(sub_template, {k: F.col(v) for k, v in columns.items()})
    g = items.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(order_col), filled.alias("t"))))
                                .alias("xs"))
    return g.select(*key, F.array_join(F.transform("xs", lambda x: x["t"]), "\n").alias("text"))


# T6 / J7 -------------------------------------------------------------------
def fewshot_field(cases: DataFrame, shots: DataFrame, sub_template: str, columns: dict[str, str]) -> DataFrame:
    """Few-shot sub-cases (``shots(case_id, shot_name, ...)``) filled and joined in shot-name order.

    The shots' info never leaks into the parent case (ledger L23).
    """
    filled = fill(sub_template, {k: F.col(v) for k, v in columns.items()})
    g = shots.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("shot_name", filled.alias("t"))))
                                     .alias("xs"))
    text = F.array_join(F.transform("xs", lambda x: x["t"]), "\n")
    return cases.join(g.select("case_id", text.alias("fewshot")), "case_id", "left")


# T8 / T9 -------------------------------------------------------------------
def build_metadata(fixed: dict[str, Column], info: Column | None = None, home: str | None = None) -> Column:
    """JSON text of fixed keys, then the case's info keys (info wins on clashes).

    Info values keep their JSON types (lists, numbers, flags); an info that is no JSON object adds
    nothing. ``case_path`` has ``home`` replaced by ``$HOME``.
    """
    fx = dict(fixed)
    if home and "case_path" in fx:
        fx["case_path"] = F.replace(fx["case_path"], F.lit(home), F.lit("$HOME"))
    base = F.to_json(F.struct(*[v.alias(k) for k, v in fx.items()]))
    if info is None:
        return base
    # merge two JSON objects: keys of ``info`` replace fixed ones
    fm = F.from_json(base, "map<string,variant>")
    im = F.coalesce(F.from_json(info, "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))
    keep = F.map_filter(fm, lambda k, v: ~F.map_contains_key(im, k))
    return F.to_json(F.map_concat(keep, im))


# T10 / T11 ---------------------------------------------------------------
def drop_failed(prompts: DataFrame) -> DataFrame:
    """T10."""
    return prompts.filter(F.col("prompt").isNotNull())


def with_tag(configs: DataFrame, tag: str) -> DataFrame:
    """Configs carrying ``tag`` in their ``tags`` array."""
    return configs.filter(F.array_contains("tags", tag))

