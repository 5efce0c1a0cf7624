"""Indented JSON as a Column: the expression is put together from the type of the result, so that no row goes to Python."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, FractionalType, IntegralType, StringType, StructType

from vellum.functions.text import let

#: What stands for characters that must not stand for themselves.
ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
_RARE = {chr(i): f"\\u{i:04x}" for i in range(32) if chr(i) not in ESCAPES}


def quoted(text: Column) -> Column:
    """A text as JSON: characters beyond ASCII as they are."""

    def put(value: Column, table: dict[str, str]) -> Column:
        for old, new in table.items():
            value = F.replace(value, F.lit(old), F.lit(new))
        return value

    plain = F.when(text.rlike(r'[\x00-\x1f"\\]'), let(put(text, ESCAPES), lambda x: F.when(x.rlike(r"[\x00-\x1f]"), put(x, _RARE)).otherwise(x))).otherwise(text)
    return F.concat(F.lit('"'), plain, F.lit('"'))


def decimal(value: Column) -> Column:
    """A double with the fewest digits that tell it from others, with an exponent below 0.0001 and from 10**16 on."""

    def shown(s: Column) -> Column:
        sign, body = F.when(s.startswith("-"), "-").otherwise(""), F.regexp_replace(s, "^-", "")
        digits = F.regexp_replace(F.replace(F.substring_index(body, "E", 1), F.lit(".")), "(?<=.)0+$", "")
        e = F.substring_index(body, "E", -1).cast("int")
        zeros = lambda n: F.repeat(F.lit("0"), n)
        whole = F.when(F.length(digits) > e + 1, F.concat(F.substring(digits, F.lit(1), e + 1), F.lit("."), F.substring(digits, e + 2, F.length(digits)))).otherwise(F.concat(digits, zeros(e + 1 - F.length(digits)), F.lit(".0")))
        small = F.concat(F.lit("0."), zeros(-e - 1), digits)
        mantissa = F.when(F.length(digits) > 1, F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, F.lit(2), F.length(digits)))).otherwise(digits)
        power = F.concat(mantissa, F.lit("e"), F.when(e < 0, "-").otherwise("+"), F.lpad(F.abs(e).cast("string"), 2, "0"))
        power = F.when(F.abs(e) > 99, F.concat(mantissa, F.lit("e"), F.when(e < 0, "-").otherwise("+"), F.abs(e).cast("string"))).otherwise(power)
        return F.when(F.contains(s, F.lit("E")), F.concat(sign, F.when((e >= 0) & (e < 16), whole).when((e < 0) & (e >= -4), small).otherwise(power))).otherwise(s)

    return let(value.cast("double").cast("string"), shown)


def _block(lines: Column, ends: str, depth: int) -> Column:
    """Lines between brackets, each two spaces further in."""
    inner, outer = "\n" + "  " * (depth + 1), "\n" + "  " * depth
    return F.concat(F.lit(ends[0] + inner), F.array_join(lines, "," + inner), F.lit(outer + ends[1]))


def pretty(value: Column, kind: DataType, depth: int = 0) -> Column:
    """A value of a type as JSON, indented by two spaces: objects with their names in order, null as such, what is neither
    text, number, boolean, list nor object as a text."""
    if isinstance(kind, StructType):
        fields = [F.concat(quoted(F.lit(f.name)), F.lit(": "), pretty(value[f.name], f.dataType, depth + 1)) for f in kind.fields]
        shown = _block(F.array(*fields), "{}", depth) if fields else F.lit("{}")
    elif isinstance(kind, ArrayType):
        shown = F.when(F.size(value) == 0, "[]").otherwise(_block(F.transform(value, lambda x: pretty(x, kind.elementType, depth + 1)), "[]", depth))
    elif isinstance(kind, (IntegralType, BooleanType)):
        shown = value.cast("string")
    elif isinstance(kind, FractionalType):
        shown = decimal(value)
    else:
        shown = quoted(value if isinstance(kind, StringType) else value.cast("string"))
    return F.when(value.isNull(), F.lit("null")).otherwise(shown)
