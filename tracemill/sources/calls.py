"""Tool arguments and tool calls embedded in text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Argument names that hold a path, in their order, per kind of source.
SESSION_PATH_KEYS = (
    "path",
    "file",
    "filePath",
    "file_path",
    "filename",
    "target",
    "source",
    "dest",
    "destination",
)
TREE_PATH_KEYS = (*SESSION_PATH_KEYS, "workdir")
TRANSCRIPT_PATH_KEYS = ("path", "file", "filePath", "file_path", "target_directory", "workdir")

CALLS = "array<struct<name:string,params:map<string,string>,result:string>>"
# How calls are written within a text.
_BLOCK = r"(?s)<function_calls>(.*?)</function_calls>(?:\s*<result>(.*?)</result>)?"
_INVOKE = r'(?s)<invoke name="([^"]+)">(.*?)</invoke>'
_PARAMETER = r'(?s)<parameter name="([^"]+)">(.*?)</parameter>'


def _pairs(text: Column, pattern: str) -> Column:
    """Groups 1 and 2 of every match, as structs `a` and `b`."""
    first = F.regexp_extract_all(text, F.lit(pattern), 1)
    second = F.regexp_extract_all(text, F.lit(pattern), 2)
    return F.zip_with(first, second, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _last_value_map(pairs: Column) -> Column:
    """Map in order of first appearance; a repeated key keeps its last value."""
    keys = F.array_distinct(F.transform(pairs, lambda p: p["a"]))
    values = F.transform(
        keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["a"] == k), -1)["b"]
    )
    return F.map_from_arrays(keys, values)


def embedded_calls(text: Column) -> Column:
    """Calls written as markup, each with its parameters and maybe its result.

    The result that follows a block belongs to the last call of the block.
    """

    def calls(block: Column) -> Column:
        invokes = _pairs(block["a"], _INVOKE)
        result = F.nullif(F.trim(F.translate(block["b"], "\r\t", "  ")), F.lit(""))
        trimmed = F.when(result.isNotNull(), F.regexp_replace(block["b"], r"^\s+|\s+$", ""))
        trimmed = F.nullif(trimmed, F.lit(""))
        return F.transform(
            invokes,
            lambda call, i: F.struct(
                call["a"].alias("name"),
                _last_value_map(_pairs(call["b"], _PARAMETER)).alias("params"),
                F.when(i == F.size(invokes) - 1, trimmed).alias("result"),
            ),
        )

    found = F.flatten(F.transform(_pairs(text, _BLOCK), calls))
    return F.when(F.contains(text, F.lit("<function_calls>")), found).otherwise(
        F.array().cast(CALLS)
    )


def without_markup(text: Column) -> Column:
    """Text without call blocks, thinking and results, trimmed."""
    for pattern in (
        r"(?s)<function_calls>.*?</function_calls>",
        r"(?s)<thinking>.*?</thinking>",
        r"(?s)<result>.*?</result>",
        r"^\s+|\s+$",
    ):
        text = F.regexp_replace(text, pattern, "")
    return text


def _filled(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def call_text(tool: Column, value, order: Sequence[str]) -> Column:
    """Searchable line about a call: its path, else its pattern, command or query.

    `value` maps an argument name to its text; `order` names the path arguments.
    """
    pattern = _filled(value("pattern"))
    paths = [F.concat(F.lit(" "), _filled(value(k))) for k in order]
    detail = F.coalesce(
        *paths,
        F.concat(F.lit(' pattern="'), pattern, F.lit('"')),
        F.concat(F.lit(" $ "), _filled(value("command"))),
        F.concat(F.lit(' query="'), _filled(value("query")), F.lit('"')),
        F.lit(""),
    )
    return F.concat(F.lit("Tool: "), tool, detail)


def map_paths(params: Column, keys: Sequence[str]) -> Column:
    """Path arguments of a string map; NULL when there are none."""
    found = F.array_compact(F.array(*[F.try_element_at(params, F.lit(k)) for k in keys]))
    return F.when(F.size(found) > 0, found)


def is_string(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def string_at(value: Column, path: str) -> Column:
    """String at a path of a variant, NULL for any other type."""
    part = F.try_variant_get(value, path, "variant")
    return F.when(is_string(part), F.try_variant_get(value, path, "string"))


def variant_paths(args: Column, keys: Sequence[str]) -> Column:
    """Path arguments of a variant object and of its `paths` list; NULL when none."""
    named = F.array(*[string_at(args, f"$.{k}") for k in keys])
    listed = F.transform(
        F.filter(F.try_variant_get(args, "$.paths", "array<variant>"), is_string),
        lambda p: F.try_variant_get(p, "$", "string"),
    )
    found = F.array_compact(F.concat(named, F.coalesce(listed, F.array().cast("array<string>"))))
    return F.when(F.size(found) > 0, found)
