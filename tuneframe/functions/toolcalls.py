"""Tool-call parsing.

Arguments become comparable keys: texts that are equal exactly when Python would call the parsed values equal. The argument of a
call may be JSON or a Python literal, spread over several lines, fenced, or unreadable, so an Arrow UDF reads it, each distinct text of a
batch once. Plain cases can be read with built-in expressions instead (``engine="variant"``), arguments as VARIANT: JSON of objects,
arrays, strings, integers, booleans and nulls up to :data:`DEPTH` deep, on one line, in printable ASCII. Then only the others
go to Python. Both engines give the same keys. Names, pairing, comparison and aggregation stay in Catalyst.
"""

from __future__ import annotations

import ast
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tuneframe.constants import CODE_FENCE, TOOL_LINE_REGEX
from tuneframe.functions.text import as_text, let, squeeze
from tuneframe.schemas import TOOL_CALLS

_TOOL_LINE = re.compile(TOOL_LINE_REGEX, re.IGNORECASE)
_ARROW_CALL = pa.struct([("action", pa.string()), ("input", pa.string())])
_ARROW_PARSED = pa.struct([("calls", pa.list_(_ARROW_CALL)), ("ok", pa.bool_())])


def _key(value) -> str:
    """Text that is the same for two parsed values exactly when Python calls them equal."""
    match value:
        case None:
            return "null"
        case bool() | int():
            return format(int(value), "x")
        case float():
            if value != value:
                return "nan"
            return format(int(value), "x") if value.is_integer() else repr(value)
        case complex():
            return _key(value.real) if value.imag == 0 else f"c({_key(value.real)},{_key(value.imag)})"
        case str():
            return f'"{value.encode("utf-8", "surrogatepass").hex()}"'
        case list() | tuple():
            return f"[{','.join(map(_key, value))}]"
        case dict():
            sorted(value)  # keys that cannot be ordered make the payload unreadable
            return "{" + ",".join(sorted(f"{_key(k)}:{_key(v)}" for k, v in value.items())) + "}"
        case set():
            return f"s({','.join(sorted(map(_key, value)))})"
        case _:
            return f"o{value!r}"


def _argument(payload: str) -> tuple[str, bool]:
    """(comparable text, readable?) of one call argument."""
    text = payload.strip()
    if text.startswith(CODE_FENCE) and text.endswith(CODE_FENCE):
        inside = text.splitlines()
        if len(inside) > 1:
            text = "\n".join(inside[1:-1]).strip()
    for read in (json.loads, ast.literal_eval):
        try:
            return _key(read(text)), True
        except Exception:  # noqa: BLE001 - any failure means "not in this notation"
            pass
    return _key(text), False


def _depth(line: str) -> int:
    return sum(map(line.count, "{[")) - sum(map(line.count, "}]"))


def _payload(head: str, following) -> str:
    """Argument text that starts with ``head``; takes the lines it spans from ``following``."""
    taken = [head]
    if head.startswith(CODE_FENCE):
        for line in following:
            taken.append(line)
            if line.strip().startswith(CODE_FENCE):
                break
    else:
        depth = _depth(head)
        while depth > 0 and (line := next(following, None)) is not None:
            taken.append(line)
            depth += _depth(line)
    return "\n".join(taken)


def parse_calls(prediction: str) -> dict:
    """Calls of one prediction and whether all of it was readable."""
    calls, name, ok = [], None, True
    following = iter(prediction.splitlines())
    for line in following:
        found = _TOOL_LINE.match(line)
        if found is None:
            continue
        is_argument, rest = found.groups()
        if not is_argument:
            name = " ".join(rest.split()) if rest else name
        elif name is not None:
            argument, readable = _argument(_payload(rest.strip(), following))
            calls.append({"action": name, "input": argument})
            ok, name = ok and readable, None
    return {"calls": calls, "ok": ok and bool(calls) and name is None}


def _once_per_value(texts: pa.Array, convert, value_type: pa.DataType) -> pa.Array:
    """Convert each distinct text of a batch once and spread the results back."""
    coded = texts.dictionary_encode()
    return pa.array([convert(t) for t in coded.dictionary.to_pylist()], value_type).take(coded.indices)


# ---------------------------------------------------------------- built-in form

# Containers that the built-in form looks into, one inside the other.
DEPTH = 3
_PLAIN = r"^[\x20-\x7E]*$"
_PLAIN_LINES = r"^[\x20-\x7E\n]*$"
# Escapes of characters beyond the first plane; a lone one has no bytes of its own.
_SURROGATE = r"(?i)\\u[d][89a-f]"
_LINE = f"(?i)^{TOOL_LINE_REGEX}"
_CALLS = "struct<name:string,calls:array<struct<action:string,input:string>>>"


def _text_key(text: Column) -> Column:
    return F.concat(F.lit('"'), F.lower(F.hex(text)), F.lit('"'))


def _value_key(value: Column, depth: int) -> Column:
    """Key of a VARIANT value, NULL if it is of no plain kind."""
    return let(F.schema_of_variant(value), lambda kind: _key_of_kind(value, kind, depth))


def _key_of_kind(value: Column, kind: Column, depth: int) -> Column:
    def joined(parts: Column, left: str, right: str) -> Column:
        whole = F.concat(F.lit(left), F.array_join(parts, ","), F.lit(right))
        return F.when(~F.exists(parts, lambda part: part.isNull()), whole)

    def integer(number: Column) -> Column:
        digits = F.lower(F.hex(F.abs(number)))
        return F.when(number >= 0, digits).when(number > -(2**63), F.concat(F.lit("-"), digits))

    key = (
        F.when(kind == "VOID", "null")
        .when(kind == "STRING", _text_key(F.try_variant_get(value, "$", "string")))
        .when(kind == "BIGINT", let(F.try_variant_get(value, "$", "bigint"), integer))
        .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("int").cast("string"))
    )
    if depth:
        def entry(pair: Column) -> Column:
            return F.concat(_text_key(pair["key"]), F.lit(":"), _value_key(pair["value"], depth - 1))

        entries = F.transform(F.map_entries(F.try_variant_get(value, "$", "map<string,variant>")), entry)
        items = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda item: _value_key(item, depth - 1))
        key = key.when(kind.startswith("OBJECT"), let(entries, lambda e: joined(F.array_sort(e), "{", "}")))
        key = key.when(kind.startswith("ARRAY"), let(items, lambda i: joined(i, "[", "]")))
    return key


def plain_key(argument: Column) -> Column:
    """Comparable key of one argument that is plain JSON, else NULL.

    The parser stops behind the first value, so the text is read as the first of two elements of an
    array, the second being the text's own digest, which no text can hold: only one that is a whole value gives these two.
    """
    digest = F.md5(argument)
    framed = F.try_parse_json(F.concat(F.lit("["), argument, F.lit(',"'), digest, F.lit('"]')))
    plain = F.regexp_like(argument, F.lit(_PLAIN)) & ~F.regexp_like(argument, F.lit(_SURROGATE))
    elements = F.when(plain, F.try_variant_get(framed, "$", "array<variant>"))
    whole = lambda e: (F.size(e) == 2) & (F.try_variant_get(F.get(e, F.lit(1)), "$", "string") == digest)
    return let(elements, lambda e: F.when(whole(e), _value_key(F.get(e, F.lit(0)), DEPTH)))


def plain_calls(prediction: Column) -> Column:
    """struct<calls, ok> of a prediction whose arguments are all plain JSON on one line, else NULL."""

    def line(text: Column) -> Column:
        rest = F.regexp_extract(text, _LINE, 2)
        argument = F.regexp_extract(text, _LINE, 1) != ""
        opened = F.length(text) - F.length(F.translate(text, "{[", ""))
        closed = F.length(text) - F.length(F.translate(text, "}]", ""))
        key = F.when(argument & (opened <= closed), plain_key(F.btrim(rest)))
        return F.struct(argument.alias("argument"), F.when(rest != "", squeeze(rest)).alias("name"), key.alias("key"))

    def step(state: Column, own: Column) -> Column:
        call = F.array(F.struct(state["name"].alias("action"), own["key"].alias("input")))
        calls = F.when(own["argument"] & state["name"].isNotNull(), F.concat(state["calls"], call)).otherwise(state["calls"])
        name = F.when(own["argument"], F.lit(None).cast("string")).otherwise(F.coalesce(own["name"], state["name"]))
        return F.struct(name.alias("name"), calls.alias("calls"))

    def parsed(lines: Column) -> Column:
        start = F.struct(F.lit(None).cast("string").alias("name"), F.array().cast(T.ArrayType(TOOL_CALLS["calls"].dataType.elementType)).alias("calls"))
        ok = lambda state: (F.size(state["calls"]) > 0) & state["name"].isNull()
        result = F.aggregate(lines, start, step, lambda state: F.struct(state["calls"].alias("calls"), ok(state).alias("ok")))
        return F.when(~F.exists(lines, lambda x: x["argument"] & x["key"].isNull()), result)

    plain = F.regexp_like(prediction, F.lit(_PLAIN_LINES)) & ~F.contains(prediction, F.lit(CODE_FENCE))
    tools = F.filter(F.split(F.when(plain, prediction), "\n"), lambda text: F.regexp_like(text, F.lit(_LINE)))
    return let(F.transform(tools, line), parsed)


# ---------------------------------------------------------------- Arrow form


@F.arrow_udf(TOOL_CALLS)
def _parse_predictions(predictions: pa.Array) -> pa.Array:
    return _once_per_value(predictions, parse_calls, _ARROW_PARSED)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _argument_keys(arguments: pa.Array) -> pa.Array:
    keys = _once_per_value(arguments.flatten(), lambda text: None if text is None else _argument(text)[0], pa.string())
    widths = arguments.value_lengths().fill_null(0).to_pylist()
    offsets = [0]
    for width in widths:
        offsets.append(offsets[-1] + width)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), keys)


def with_parsed_calls(df: DataFrame, prediction: str = "prediction", name: str = "calls", engine: str = "arrow") -> DataFrame:
    """Add struct<calls array<struct<action, input>>, ok boolean>; inputs are comparable keys. With the engine ``variant`` only
    predictions that are not plain reach Python."""
    text = F.coalesce(F.col(prediction), F.lit(""))
    if engine == "arrow":
        return df.withColumn(name, _parse_predictions(text))
    return (
        df.withColumn("_plain", plain_calls(text))
        .withColumn(name, F.coalesce("_plain", _parse_predictions(F.when(F.col("_plain").isNull(), text))))
        .drop("_plain")
    )


def parse_tool_calls(prediction: Column) -> Column:
    """The same as one expression, always in the Arrow form."""
    return _parse_predictions(F.coalesce(prediction, F.lit("")))


def expected_names(golden_answer: Column) -> Column:
    return F.transform(golden_answer, lambda step: squeeze(as_text(step["Action"])))


def with_expected_inputs(df: DataFrame, golden_answer: str = "golden_answer", name: str = "gold_inputs", engine: str = "arrow") -> DataFrame:
    """Add the gold arguments as comparable keys; an unreadable one is compared by its text. No steps give no keys."""
    if engine == "arrow":
        return df.withColumn(name, expected_inputs(F.col(golden_answer)))
    texts = F.coalesce(F.transform(F.col(golden_answer), lambda step: as_text(step["Action_Input"])), F.array().cast("array<string>"))
    rest = F.zip_with("_texts", "_plain", lambda text, key: F.when(key.isNull(), text))
    keyed = df.withColumn("_texts", texts).withColumn("_plain", F.transform("_texts", lambda text: plain_key(F.btrim(text))))
    keyed = keyed.withColumn(name, F.zip_with("_plain", _argument_keys(rest), lambda key, other: F.coalesce(key, other)))
    return keyed.drop("_texts", "_plain")


def expected_inputs(golden_answer: Column) -> Column:
    """The same as one expression, always in the Arrow form."""
    return _argument_keys(F.transform(golden_answer, lambda step: as_text(step["Action_Input"])))
