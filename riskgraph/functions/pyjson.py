"""JSON text as Python's ``json.dumps`` writes it: spaced separators, ``repr`` of floats, non-ASCII characters escaped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgraph.functions.text import py_float_text

_SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def _escaped(c: Column) -> Column:
    """One character."""
    code = F.ascii(c)
    unit = lambda x: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(x)), 4, "0"))
    above = code - 0x10000
    out = F.when((code >= 32) & (code < 127), c).when(code < 0x10000, unit(code)).otherwise(
        F.concat(unit(F.shiftright(above, 10) + 0xD800), unit(above.bitwiseAND(0x3FF) + 0xDC00)))
    for char, text in _SHORT.items():
        out = F.when(c == F.lit(char), F.lit(text)).otherwise(out)
    return out


def _string(s: Column) -> Column:
    plain = s.rlike(r"\A[ !#-\[\]-~]*\z")
    chars = F.transform(F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0)), _escaped)
    return F.concat(F.lit('"'), F.when(plain, s).otherwise(F.array_join(chars, "")), F.lit('"'))


def json_text(value: Column, kind: T.DataType) -> Column:
    """``json.dumps(value)``; NULL is ``null``, also inside arrays, maps (string keys) and structs."""
    if isinstance(kind, T.StringType):
        out = _string(value)
    elif isinstance(kind, T.BooleanType):
        out = value.cast("string")
    elif isinstance(kind, T.IntegralType):
        out = value.cast("string")
    elif isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        text = py_float_text(value)
        out = F.replace(F.replace(text, F.lit("inf"), F.lit("Infinity")), F.lit("nan"), F.lit("NaN"))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: json_text(x, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, T.StructType):
        out = json_object([(f.name, value[f.name], f.dataType) for f in kind.fields], skip_nulls=False)
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        pairs = F.transform(F.map_entries(value), lambda e: F.concat(_string(e["key"]), F.lit(": "), json_text(e["value"], kind.valueType)))
        out = F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))
    else:
        raise TypeError(f"no JSON text for {kind.simpleString()}")
    return F.when(value.isNull(), F.lit("null")).otherwise(out)


def json_object(fields: Sequence[tuple[str, Column, T.DataType]], skip_nulls: bool = True) -> Column:
    """A JSON object with the given keys, in order; keys of NULL values are left out unless told otherwise."""
    parts = []
    for name, value, kind in fields:
        part = F.concat(_string(F.lit(name)), F.lit(": "), json_text(value, kind))
        parts.append(F.when(value.isNotNull(), part) if skip_nulls else part)
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
