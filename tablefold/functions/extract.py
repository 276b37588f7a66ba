"""Answer extraction from free-text completions (column expressions).

Everything is a built-in Spark expression except one Arrow-batched Python
helper that reproduces the reference parser's second chance (a lenient JSON
parse, then a Python-literal parse) for candidate objects that Spark's JSON
parser rejects. It is fed NULL for every row that does not need it.
"""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablefold.functions import values as V

# ---------------------------------------------------------------------------
# fixed values: markers and patterns that must equal the reference's
# ---------------------------------------------------------------------------
THINK_PREFIX = "<think>"
FLAT_OBJECT_PATTERN = r"\{[^}]*\}"          # one brace level, as the reference
CONTENT_FILTER_TEXT = "Error: content filter"
TIMEOUT_PREFIX = "API Timeout"
SQL_NOT_FOUND = "SQLCodeBlockNotFound"
SQL_KEYWORDS = ["select", "with", "insert", "update", "delete"]
ERROR_CLASSES = ["None", "CompletionNotString", "content_filter", "timeout", "empty",
                 "JSONParsingError", "normal"]


def pystrip(c: Column) -> Column:
    """Python ``str.strip()``: drop leading/trailing whitespace of any kind."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


# X1 / X2 -------------------------------------------------------------------
def completion(response: Column, choices: Column | None = None) -> Column:
    """Completion text of a row of either shape: ``choices[0].text``, else ``response``, else ''."""
    if choices is not None:
        return F.coalesce(F.try_element_at(choices, F.lit(1)).getField("text"), response, F.lit(""))
    return F.coalesce(response, F.lit(""))


def prompt_completion(prompt: Column, comp: Column) -> Column:
    return F.concat(F.coalesce(prompt, F.lit("")), F.lit("\n"), comp)


# X3 ------------------------------------------------------------------------
def strip_think(c: Column) -> Column:
    """Remove a *leading* ``<think>..</think>`` block (first closing tag)."""
    return F.regexp_replace(c, r"(?s)^<think>.*?</think>", "")


# the Python-side second chance ---------------------------------------------
def _json_default(o):
    if isinstance(o, (set, frozenset, tuple)):
        return list(o)
    return str(o)


_SYNTAXES = (json.loads, ast.literal_eval)      # JSON first, then Python literals


def _decoded(text):
    """(True, value) of a candidate in the first syntax that reads it, else (False, None)."""
    for read in _SYNTAXES:
        try:
            return True, read(text)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            pass
    return False, None


def _decode_all(cands):
    """Values of the candidates that can be read, in order."""
    return [value for ok, value in map(_decoded, [] if cands is None else cands) if ok]


def _as_json(value):
    try:
        return json.dumps(value, ensure_ascii=False, default=_json_default)
    except (TypeError, ValueError):
        return None


def _lookup(values, key):
    """JSON text of ``key`` in the first object that has it."""
    hits = (_as_json(v[key]) for v in values if isinstance(v, dict) and key in v)
    return next((h for h in hits if h is not None), None)


def _py_first_with_key(cands, key):
    return _lookup(_decode_all(cands), key)


def _py_keys_object(cands, keys):
    """JSON object text ``{key: value}`` of every key found, each searched on its own."""
    if cands is None:
        return None
    values, parts = _decode_all(cands), []
    for k in keys:
        v = _lookup(values, k)
        if v is not None:
            parts.append(json.dumps(k) + ": " + v)
    return "{" + ", ".join(parts) + "}"


def _py_all_objects(cands):
    values = _decode_all(cands)
    return _as_json(values) if values else None


@F.pandas_udf(T.StringType())
def _fallback_first(cands: pd.Series, keys: pd.Series) -> pd.Series:
    return pd.Series([_py_first_with_key(c, k) if c is not None else None
                      for c, k in zip(cands, keys)], dtype=object)


@F.pandas_udf(T.StringType())
def _fallback_keys(packed: pd.Series) -> pd.Series:
    return pd.Series([_py_keys_object(*json.loads(x)) if x is not None else None for x in packed], dtype=object)


@F.pandas_udf(T.StringType())
def _fallback_all(packed: pd.Series) -> pd.Series:
    return pd.Series([_py_all_objects(json.loads(x)) if x is not None else None for x in packed], dtype=object)


def fallback_keys(cands: Column, keys: Column) -> Column:
    """The second chance for ``keys``; candidates and keys travel as one text, NULL where there are none: arrays are dear to send, even empty."""
    return _fallback_keys(F.when(cands.isNotNull(), F.to_json(F.array(cands, keys))))


def fallback_all(cands: Column) -> Column:
    return _fallback_all(F.to_json(cands))


# X4 ------------------------------------------------------------------------
def parse_candidate(c: Column) -> Column:
    """VARIANT of a candidate object: JSON first, then the simple Python-literal form.

    A candidate without double quotes, backslashes or True/False/None that only
    fails JSON because of single quotes means the same after swapping the quote
    characters (strings, numbers, lists and string-keyed dicts). Anything else
    that fails JSON stays NULL here and goes to the Python second chance.
    """
    simple = (~c.contains('"') & ~c.contains("\\") & ~c.contains("True") & ~c.contains("False")
              & ~c.contains("None"))
    swapped = F.when(simple & c.contains("'"), F.replace(c, F.lit("'"), F.lit('"')))
    return F.coalesce(V.json_variant(c), V.json_variant(swapped))


def _first_true(flags: Column) -> Column:
    return F.array_position(flags, F.lit(True))


def json_answer_from_candidates(cands: Column, key: str) -> Column:
    """VARIANT value of ``key`` in the first candidate object holding it.

    Candidates Spark can parse are decided in Spark. A candidate Spark cannot
    parse that comes before the first Spark hit goes, with its row, to the
    Python second chance, which then decides the whole row as the reference
    would. NULL when no candidate holds the key.
    """
    parsed = F.transform(cands, lambda c: parse_candidate(c))
    has_key = F.transform(parsed, lambda p: p.isNotNull() & V.field(p, key).isNotNull()
                          & F.schema_of_variant(p).startswith("OBJECT"))
    bad = F.transform(parsed, lambda p: p.isNull())
    first_hit = _first_true(has_key)
    first_bad = _first_true(bad)
    need_py = (first_bad > 0) & ((first_hit == 0) | (first_bad < first_hit))
    spark_value = F.when(first_hit > 0, V.field(F.element_at(parsed, first_hit.cast("int")), key))
    py_json = _fallback_first(F.when(need_py, cands), F.lit(key))
    return F.when(need_py, V.json_variant(py_json)).otherwise(spark_value)


def extract_json(c: Column, key: str, think: bool = True) -> Column:
    """First flat ``{...}`` holding ``key`` -> VARIANT, NULL if none."""
    text = strip_think(c) if think else c
    return json_answer_from_candidates(F.regexp_extract_all(text, F.lit(FLAT_OBJECT_PATTERN), 0), key)


def extract_json_multi(c: Column, keys: list[str]) -> Column:
    """Struct of one VARIANT per key; callers need all of them present."""
    return F.struct(*[extract_json(c, k).alias(k) for k in keys])


# X6 ------------------------------------------------------------------------
def last_balanced_object(c: Column) -> Column:
    """Text of the last balanced ``{...}`` (nested braces allowed).

    Walks back from the last ``}`` counting braces, as the reference does, but
    over the brace characters only: the text is split on braces once, the walk
    is one ``aggregate`` over the (short) brace list, and the start position
    comes from the lengths of the pieces before the matching ``{``. NULL
    without a ``}``; the parse-error marker when the braces never balance.
    """
    init = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("pos"), F.lit(0).alias("found"))

    def step(acc, ch):
        pos = acc["pos"] + 1
        depth = acc["depth"] + F.when(ch == "}", 1).otherwise(0) - F.when(ch == "{", 1).otherwise(0)
        found = F.when(acc["found"] > 0, acc["found"]).when((ch == "{") & (depth == 0), pos).otherwise(0)
        return F.struct(depth.alias("depth"), pos.alias("pos"), found.alias("found"))

    def cut(head: Column, j: Column) -> Column:         # j: index of the matching '{' among the braces
        before = F.aggregate(F.slice(F.split(head, r"[{}]"), F.lit(1), F.greatest(j, F.lit(1))), F.lit(0), lambda acc, p: acc + F.length(p))
        return F.substring(head, before + j, F.length(head))

    def walk(head: Column) -> Column:
        braces = F.regexp_extract_all(head, F.lit(r"[{}]"), 0)
        at = V.once(braces, lambda x: V.once(F.aggregate(F.reverse(x), init, step)["found"], lambda k: F.when(k > 0, F.size(x) - k + 1)))
        return V.once(at, lambda j: F.when(j.isNotNull(), cut(head, j)).otherwise(F.lit(V.PARSE_ERROR)))

    def last(text: Column) -> Column:
        end = F.length(text) - F.locate("}", F.reverse(text)) + 1
        return F.when(F.locate("}", text) > 0, V.once(F.substring(text, F.lit(1), end), walk))

    return V.once(c, last)


def extract_last_json(c: Column, key: str, think: bool = True) -> Column:
    """Value of ``key`` in the last balanced object -> VARIANT, NULL if none."""
    text = strip_think(c) if think else c
    obj = last_balanced_object(text)
    return json_answer_from_candidates(F.when(obj.isNotNull(), F.array(obj)).otherwise(F.array()), key)


# X7 ------------------------------------------------------------------------
def extract_all_json(c: Column) -> Column:
    """Every flat object that parses, as a VARIANT array; NULL if none (no think strip)."""
    cands = F.regexp_extract_all(c, F.lit(FLAT_OBJECT_PATTERN), 0)
    parsed = F.transform(cands, lambda x: parse_candidate(x))
    any_bad = F.exists(parsed, lambda p: p.isNull())
    ok_text = F.concat(F.lit("["), F.array_join(F.transform(parsed, lambda p: F.to_json(p)), ","), F.lit("]"))
    spark_json = F.when(F.size(cands) > 0, ok_text)
    py_json = fallback_all(F.when(any_bad, cands))
    return V.json_variant(F.when(any_bad, py_json).otherwise(spark_json))


# X8 ------------------------------------------------------------------------
def code_block(c: Column, lang: str = "python", which: str = "first") -> Column:
    """Body of the first (or last) fenced block of ``lang``, stripped; NULL if none."""
    pat = r"(?s)```" + lang + r"(.*?)```"
    blocks = F.regexp_extract_all(c, F.lit(pat), 1)
    pick = F.try_element_at(blocks, F.lit(1 if which == "first" else -1))
    return pystrip(pick)


# X9 ------------------------------------------------------------------------
def extract_sql(c: Column) -> Column:
    """Last ```sql block -> execute_sql tool call -> leading statement -> marker."""
    blocks = F.regexp_extract_all(c, F.lit(r"(?s)```sql(.*?)```"), 1)
    from_block = pystrip(F.try_element_at(blocks, F.lit(-1)))
    calls = F.regexp_extract_all(c, F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), 1)
    queries = F.transform(F.filter(calls, lambda t: F.get_json_object(t, "$.name") == "execute_sql"),
                          lambda t: F.get_json_object(t, "$.arguments.query"))
    from_tool = pystrip(F.try_element_at(F.filter(queries, lambda q: q.isNotNull() & (q != "")), F.lit(1)))
    low = F.lower(pystrip(c))
    plain = F.lit(None).cast("string")
    for kw in reversed(SQL_KEYWORDS):
        stmt = F.regexp_extract(c, r"(?is)^(" + kw + r".*?)(;|\z)", 1)
        plain = F.when(low.startswith(kw), F.when(stmt != "", pystrip(stmt)).otherwise(pystrip(c))).otherwise(plain)
    return F.coalesce(F.when(F.size(blocks) > 0, from_block), from_tool, plain, F.lit(SQL_NOT_FOUND))


# X10 / X11 -----------------------------------------------------------------
def parse_tool_call(c: Column) -> Column:
    """``<tool_call>name(args)</tool_call>`` -> struct(name, arguments MAP<STRING,STRING>).

    Arguments are JSON when they parse, else ``k=v`` pairs split on commas with
    quotes stripped. NULL when the text holds no call.
    """
    pat = r"(?s)<tool_call>(\w+)\((.*?)\)</tool_call>"
    name = F.regexp_extract(c, pat, 1)
    args = F.regexp_extract(c, pat, 2)
    as_json = F.from_json(args, T.MapType(T.StringType(), T.StringType()))
    parts = F.filter(F.split(args, ","), lambda p: F.locate("=", p) > 0)
    pairs = F.transform(parts, lambda p: F.struct(
        pystrip(F.substring_index(p, "=", 1)).alias("key"),
        F.regexp_replace(pystrip(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1)), r"^['\"]+|['\"]+$", "")
        .alias("value")))
    # of a repeated name the last value counts
    kv = F.map_from_entries(F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"])))
    empty = F.create_map().cast("map<string,string>")
    arguments = (F.when(pystrip(args) == "", empty)
                 .when(as_json.isNotNull(), as_json)
                 .otherwise(kv))
    return F.when(name != "", F.struct(name.alias("name"), arguments.alias("arguments")))


def tool_arguments(c: Column) -> Column:
    """The call's arguments as JSON text; JSON ones keep their types, integers of ``k=v`` pairs become numbers. NULL without a call."""
    quoted = lambda t: F.substring(F.to_json(F.array(t)), F.lit(2), F.length(F.to_json(F.array(t))) - 2)
    digits = lambda v: F.regexp_replace(F.regexp_replace(pystrip(v), r"_|^[+]", ""), r"^(-?)0+(?=[0-9])|^-(?=0+$)", "$1")
    entry = lambda e: F.concat(quoted(e["key"]), F.lit(":"), F.when(
        pystrip(e["value"]).rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"), digits(e["value"])).otherwise(quoted(e["value"])))
    args = F.regexp_extract(c, r"(?s)<tool_call>(\w+)\((.*?)\)</tool_call>", 2)
    pairs = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(parse_tool_call(c)["arguments"]), entry), ","), F.lit("}"))
    return F.coalesce(F.when(pystrip(args) != "", F.to_json(F.try_parse_json(args))), pairs)


def clean_markers(c: Column) -> Column:
    """X11: remove tool call and tool result blocks, then strip."""
    t = F.regexp_replace(c, r"(?s)<tool_call>.*?</tool_call>", "")
    t = F.regexp_replace(t, r"(?s)<tool_result>.*?</tool_result>", "")
    return pystrip(t)


# X12 -----------------------------------------------------------------------
def error_class(comp: Column, found: Column) -> Column:
    """Error class from the raw completion and whether an answer was found."""
    return (F.when(comp.isNull(), F.lit("None"))
            .when(comp == CONTENT_FILTER_TEXT, F.lit("content_filter"))
            .when(comp.startswith(TIMEOUT_PREFIX), F.lit("timeout"))
            .when(comp == "", F.lit("empty"))
            .when(~found, F.lit("JSONParsingError"))
            .otherwise(F.lit("normal")))


# X13 / X14 -----------------------------------------------------------------
def parse_kv_metadata(c: Column) -> Column:
    """``k_v___k_v`` -> MAP; key is the text before the first ``_``; note defaults to ''."""
    pieces = F.split(c, "___")
    entries = F.transform(pieces, lambda p: F.struct(
        F.substring_index(p, "_", 1).alias("key"),
        F.substring(p, F.length(F.substring_index(p, "_", 1)) + 2, F.lit(1 << 30)).alias("value")))
    m = F.map_from_entries(entries)
    return F.when(F.map_contains_key(m, "note"), m).otherwise(
        F.map_concat(m, F.create_map(F.lit("note"), F.lit(""))))


def build_kv_metadata(**cols: Column) -> Column:
    """``key_value___key_value`` in the given order."""
    return F.concat_ws("___", *[F.concat(F.lit(k + "_"), v.cast("string")) for k, v in cols.items()])


# X15 -----------------------------------------------------------------------
# fixed values: short model codes and their full names
MODEL_CODES = {
    "D3": "text-davinci-003",
    "D2": "text-davinci-002",
    "T3.5": "gpt-3.5-turbo",
    "A": "text-ada-001",
    "B": "text-babbage-001",
    "C": "text-curie-001",
    "G4": "gpt-4",
    "G4-32": "gpt-4-32k",
}


def model_name(code: Column) -> Column:
    """Full model name; NULL for an unknown code (callers report those rows)."""
    m = F.create_map(*[x for kv in MODEL_CODES.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.try_element_at(m, code)


# X16 / X17 -----------------------------------------------------------------
SIZE_COLUMNS = {"_size_category": "string", "_table_rows": "bigint", "_table_cols": "bigint",
                "_table_cells": "bigint"}


def metadata_field(metadata: Column, key: str, dtype: str = "string") -> Column:
    """One typed field of the metadata JSON text."""
    return F.try_variant_get(V.json_variant(metadata), "$['" + key + "']", dtype)
