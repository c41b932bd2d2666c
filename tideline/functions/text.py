"""Texts of values: canonical JSON, document ids, and plain rendering of numbers, arrays and maps."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(value) -> str:
    """Sorted keys, no blanks: equal values have equal texts."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def variant_type(x: Column) -> Column:
    return F.schema_of_variant(x)


def is_number(t: Column) -> Column:
    return t.isin("TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE") | t.startswith("DECIMAL")


def as_double(x: Column, t: Column) -> Column:
    """A numeric variant as double, else null; booleans are no numbers."""
    return F.when(is_number(t), F.try_variant_get(x, "$", "double"))


def as_text(x: Column) -> Column:
    return F.try_variant_get(x, "$", "string")


def plain_double(d: Column) -> Column:
    """A double in the digits of the JVM (the shortest but for rare cases): exponents only below 1e-4 and from 1e21, no point for whole numbers.

    Doubles that the JVM writes without an exponent, which nearly all are, only lose a last .0.
    """
    s, size = d.cast("string"), F.abs(d)
    short = F.when(s.endswith(".0"), F.substr(s, F.lit(1), F.length(s) - 2)).otherwise(s)
    return F.when((size >= 1e-3) & (size < 1e7), short).otherwise(_any_double(d))


def _any_double(d: Column) -> Column:
    s = F.abs(d).cast("string")
    mantissa = F.regexp_extract(s, r"^([0-9.]+)", 1)
    exponent = F.coalesce(F.try_element_at(F.split(s, "E"), F.lit(2)).cast("int"), F.lit(0))
    point = F.length(F.substring_index(mantissa, ".", 1))
    raw = F.replace(mantissa, F.lit("."), F.lit(""))
    lead = F.length(F.regexp_extract(raw, "^(0*)", 1))
    digits = F.regexp_replace(F.regexp_replace(raw, "^0+", ""), "0+$", "")
    e = exponent + point - 1 - lead  # power of ten of the first digit
    n = F.length(digits)
    exp_text = F.concat(F.when(e < 0, F.lit("e-")).otherwise(F.lit("e+")), F.lpad(F.abs(e).cast("string"), F.greatest(F.lit(2), F.length(F.abs(e).cast("string"))), F.lit("0")))
    scientific = F.concat(F.substring(digits, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(""), exp_text)
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
    whole = F.rpad(digits, e + 1, F.lit("0"))
    mixed = F.concat(F.substr(digits, F.lit(1), e + 1), F.lit("."), F.substr(digits, e + 2))
    body = F.when(digits == "", F.lit("0")).when((e < -4) | (e >= 21), scientific).when(e < 0, small).when(n <= e + 1, whole).otherwise(mixed)
    sign = F.when((d < 0) | (F.abs(d).isNotNull() & d.cast("string").startswith("-")), F.lit("-")).otherwise("")
    return F.when(F.isnan(d), F.lit("NaN")).when(d == float("inf"), F.lit("+Inf")).when(d == float("-inf"), F.lit("-Inf")).otherwise(F.concat(sign, body))


#: The tokens of JSON.
_TOKENS = r'"(?:[^"\\]|\\.)*"|[-+0-9.eE]+|true|false|null|[\[\]{}:,]'


def _plain_token(token: Column) -> Column:
    first = F.substring(token, 1, 1)
    text = F.when(F.contains(token, F.lit("\\")), F.try_variant_get(F.try_parse_json(token), "$", "string")).otherwise(F.substr(token, F.lit(2), F.length(token) - 2))
    number = F.when(F.rlike(token, F.lit("^-?[0-9]+$")), token).otherwise(plain_double(token.cast("double")))
    marks = F.when(token == "{", "map[").when(token == "}", "]").when(token == ",", " ").when(token == "null", "<nil>")
    return F.when(first == '"', text).otherwise(F.coalesce(marks, F.when(F.rlike(first, F.lit("[-0-9]")), number).otherwise(token)))


def plain(x: Column, t: Column | None = None) -> Column:
    """A value as plain text: null is <nil>, an array [a b], an object map[k:v] by key, however deep they are nested."""
    t = variant_type(x) if t is None else t
    nested = F.array_join(F.transform(F.regexp_extract_all(F.to_json(x), F.lit(_TOKENS), F.lit(0)), _plain_token), "")
    text = F.when(t.isin("STRING", "BOOLEAN", "TINYINT", "SMALLINT", "INT", "BIGINT"), as_text(x)).when(t == "VOID", F.lit("<nil>"))
    return text.when(is_number(t), plain_double(as_double(x, t))).when(t.startswith("ARRAY") | t.startswith("OBJECT"), nested).otherwise(F.to_json(x))


def plain_literal(value) -> str:
    """The same text of a Python value."""
    if value is None:
        return "<nil>"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return value
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        if value != value:
            return "NaN"
        if value in (float("inf"), float("-inf")):
            return "+Inf" if value > 0 else "-Inf"
        digits, exponent = repr(abs(value)), 0
        if "e" in digits:
            digits, power = digits.split("e")
            exponent = int(power)
        whole, _, part = digits.partition(".")
        raw = whole + part
        e = exponent + len(whole) - 1 - (len(raw) - len(raw.lstrip("0")))
        raw = raw.strip("0")
        if not raw:
            body = "0"
        elif e < -4 or e >= 21:
            body = raw[0] + ("." + raw[1:] if len(raw) > 1 else "") + f"e{'-' if e < 0 else '+'}{abs(e):02d}"
        elif e < 0:
            body = "0." + "0" * (-e - 1) + raw
        elif len(raw) <= e + 1:
            body = raw.ljust(e + 1, "0")
        else:
            body = raw[: e + 1] + "." + raw[e + 1 :]
        return ("-" if str(value).startswith("-") else "") + body
    if isinstance(value, list):
        return "[" + " ".join(map(plain_literal, value)) + "]"
    return "map[" + " ".join(f"{k}:{plain_literal(v)}" for k, v in sorted(value.items())) + "]"


def id_text(x: Column) -> Column:
    """A document id as text: object ids in hex, strings as they are, anything else as JSON; missing is empty."""
    t = variant_type(x)
    oid = F.try_variant_get(x, "$['$oid']", "string")
    return F.coalesce(F.when(t == "STRING", as_text(x)).otherwise(F.coalesce(oid, F.to_json(x))), F.lit(""))


def display_value(x: Column, limit: int = 120) -> Column:
    """For tables: missing is an en dash, null is null, objects and arrays are JSON, cut after `limit` characters."""
    text = F.when(variant_type(x) == "VOID", F.lit("null")).when(variant_type(x) == "STRING", as_text(x)).otherwise(F.to_json(x))
    cut = F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)
    return F.when(x.isNull(), F.lit("–")).otherwise(cut)
