"""The filter language: field conditions on old and new images, compiled to Columns.

A filter has up to two blocks, newImage and oldImage. A block maps fields (dots
walk into objects) to conditions; everything is ANDed. An empty block passes; a
block with fields needs an object image. Compiled Columns are never null, so
negation is safe.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import as_double, as_text, canonical_json, plain, plain_literal, variant_type

VALUE_OPERATORS = ("eq", "ne", "gt", "gte", "lt", "lte", "contains", "startsWith", "endsWith", "in", "notIn")
OPERATORS = (*VALUE_OPERATORS, "exists")


@dataclass(frozen=True)
class Filter:
    """new, old: field -> operator -> operand. A null operand is one not given."""

    new: dict = field(default_factory=dict)
    old: dict = field(default_factory=dict)

    @staticmethod
    def parse(source: str | dict | None) -> Filter:
        config = json.loads(source) if isinstance(source, str) and source else source or {}
        unknown = config.keys() - {"newImage", "oldImage"}
        if unknown:
            raise ValueError(f"unknown filter block: {sorted(unknown)[0]}")
        return Filter(_block(config.get("newImage")), _block(config.get("oldImage")))

    def config(self) -> dict:
        return {k: v for k, v in (("newImage", self.new), ("oldImage", self.old)) if v}

    def column(self, new: Column, old: Column) -> Column:
        return match_image(new, self.new) & match_image(old, self.old)


def _block(block: dict | None) -> dict:
    out = {}
    for name, condition in (block or {}).items():
        for operator, operand in condition.items():
            if operator not in OPERATORS:
                raise ValueError(f"unknown operator {operator} on {name}")
            if operator in ("in", "notIn") and operand is not None and not isinstance(operand, list):
                raise ValueError(f"{operator} on {name} takes a list")
            if operator == "exists" and operand is not None and not isinstance(operand, bool):
                raise ValueError(f"exists on {name} takes true or false")
        out[name] = {k: v for k, v in condition.items() if v is not None}
    return out


def path_of(name: str) -> str | None:
    """The path of a field; a dot always separates keys, so a key with a dot in it is out of reach. Paths can't quote a key with both quote signs: none."""
    keys = name.split(".")
    if any("'" in k and '"' in k for k in keys):
        return None
    return "$" + "".join(f'["{k}"]' if "'" in k else f"['{k}']" for k in keys)


@dataclass(frozen=True)
class Value:
    """A field's value, and what conditions ask of it: its type, and its double and text where it has one."""

    x: Column
    type: Column
    double: Column
    text: Column
    plain: Column

    @staticmethod
    def of(x: Column) -> Value:
        t = variant_type(x)
        return Value(x, t, as_double(x, t), as_text(x), plain(x, t))


def field_of(image: Column, name: str) -> Column:
    path = path_of(name)
    if path is not None:
        return F.try_variant_get(image, path, "variant")
    for key in name.split("."):  # by the map of each object on the way
        image = F.try_element_at(F.try_variant_get(image, "$", "map<string,variant>"), F.lit(key))
    return image


def _equals(v: Value, operand) -> Column:
    if isinstance(operand, bool):
        test = (v.type == "BOOLEAN") & (F.try_variant_get(v.x, "$", "boolean") == operand)
    elif isinstance(operand, (int, float)):
        test = v.double == float(operand)
    elif isinstance(operand, str):
        test = (v.type == "STRING") & (v.text == operand)
    else:  # arrays and objects: equal JSON with sorted keys
        test = F.to_json(v.x) == F.to_json(F.parse_json(F.lit(canonical_json(operand))))
    return F.coalesce(test, F.lit(False))


def _compares(v: Value, operand, compare) -> Column:
    if isinstance(operand, bool) or not isinstance(operand, (int, float)):
        return F.lit(False)
    return F.coalesce(compare(v.double, F.lit(float(operand))), F.lit(False))


def _any_of(v: Value, operands: list) -> Column:
    """Some operand equals: numbers and strings as one list each."""
    numbers = [float(o) for o in operands if isinstance(o, (int, float)) and not isinstance(o, bool)]
    strings = [o for o in operands if isinstance(o, str)]
    rest = [o for o in operands if isinstance(o, (bool, list, dict))]
    tests = [_equals(v, o) for o in rest]
    if numbers:
        tests.append(F.coalesce(v.double.isin(*numbers), F.lit(False)))
    if strings:
        tests.append(F.coalesce((v.type == "STRING") & v.text.isin(*strings), F.lit(False)))
    if any(o is None for o in operands):
        tests.append(v.type == "VOID")
    return reduce(or_, tests, F.lit(False))


def _contains(v: Value, operand) -> Column:
    inside = F.exists(F.try_variant_get(v.x, "$", "array<variant>"), lambda e: _equals(Value.of(e), operand))
    test = F.when(v.type.startswith("ARRAY"), inside)
    if isinstance(operand, str):
        test = test.when(v.type == "STRING", F.contains(v.text, F.lit(operand)))
    return F.coalesce(test.otherwise(False), F.lit(False))


_TESTS = {
    "eq": lambda v, o: _equals(v, o),
    "ne": lambda v, o: ~_equals(v, o),
    "gt": lambda v, o: _compares(v, o, lambda a, b: a > b),
    "gte": lambda v, o: _compares(v, o, lambda a, b: a >= b),
    "lt": lambda v, o: _compares(v, o, lambda a, b: a < b),
    "lte": lambda v, o: _compares(v, o, lambda a, b: a <= b),
    "contains": _contains,
    "startsWith": lambda v, o: F.startswith(v.plain, F.lit(plain_literal(o))),
    "endsWith": lambda v, o: F.endswith(v.plain, F.lit(plain_literal(o))),
    "in": _any_of,
    "notIn": lambda v, o: ~_any_of(v, o),
}


def match_value(v: Value, condition: dict) -> Column:
    """One field's conditions, ANDed. A missing field passes only where no value operator is given; a null is present."""
    present = v.x.isNotNull()
    tests = [_TESTS[k](v, o) for k, o in condition.items() if k != "exists"]
    passed = F.when(present, F.coalesce(reduce(and_, tests, F.lit(True)), F.lit(False))).otherwise(F.lit(not tests))
    return passed & (present == condition["exists"]) if "exists" in condition else passed


def is_object(image: Column) -> Column:
    return F.coalesce(F.startswith(variant_type(image), F.lit("OBJECT")), F.lit(False))


def match_image(image: Column, block: dict) -> Column:
    if not block:
        return F.lit(True)
    return reduce(and_, [match_value(Value.of(field_of(image, k)), c) for k, c in block.items()], is_object(image))


def with_matches(df: DataFrame, filters: list[Filter], new: str = "newImage", old: str = "oldImage") -> tuple[DataFrame, list[Column]]:
    """df with columns that these filters share, all named _f_..., and each filter as a Column over them.

    Every distinct field is taken out of its image once, its type, double and
    text are found once, and every distinct condition is tested once, whatever
    the number of filters; each step is a projection of its own, so Spark does
    not repeat one within the next.
    """
    images = {new: [f.new for f in filters], old: [f.old for f in filters]}
    fields = list(dict.fromkeys((i, k) for i, blocks in images.items() for b in blocks for k in b))
    conditions = list(dict.fromkeys((i, k, canonical_json(c)) for i, blocks in images.items() for b in blocks for k, c in b.items()))
    used = {i: {o for _, k, c in conditions if k == i[1] and _ == i[0] for o in json.loads(c)} for i in fields}
    col = F.col
    df = df.withColumns({f"_f_x{n}": field_of(col(i), k) for n, (i, k) in enumerate(fields)} | {f"_f_object_{i}": is_object(col(i)) for i in dict.fromkeys(i for i, _ in fields)})
    df = df.withColumns({f"_f_t{n}": variant_type(col(f"_f_x{n}")) for n in range(len(fields))})
    parts: dict[str, Column] = {}
    for n, f in enumerate(fields):
        x, t = col(f"_f_x{n}"), col(f"_f_t{n}")
        parts |= {f"_f_d{n}": as_double(x, t), f"_f_s{n}": F.when(t == "STRING", as_text(x))}
        if used[f] & {"startsWith", "endsWith"}:
            parts[f"_f_p{n}"] = plain(x, t)
    df = df.withColumns(parts)
    values = {f: Value(*(col(f"_f_{c}{n}") for c in "xtdsp")) for n, f in enumerate(fields)}
    df = df.withColumns({f"_f_c{n}": match_value(values[i, k], json.loads(c)) for n, (i, k, c) in enumerate(conditions)})
    number = {c: n for n, c in enumerate(conditions)}

    def block(image: str, fields: dict) -> list[Column]:
        return [col(f"_f_object_{image}"), *(col(f"_f_c{number[image, k, canonical_json(c)]}") for k, c in fields.items())] if fields else []

    return df, [reduce(and_, block(new, f.new) + block(old, f.old), F.lit(True)) for f in filters]


def event_type_allowed(record_type: Column, event_types: list[str] | None) -> Column:
    """No types allow all; configured types are upper-cased, the record's is compared as it is."""
    return record_type.isin(*(t.upper() for t in event_types)) if event_types else F.lit(True)


# -- forms


def form_to_filter(form: list[dict]) -> dict:
    """Rows {image, field, operator, value} of a form as a filter. Lists are split on commas, exists is true or false, other values stay texts; rows without a field or a value say nothing."""
    out: dict = {}
    for row in form:
        name, operator, value = row["field"], row["operator"], row.get("value", "")
        if operator in ("in", "notIn"):
            value = [x.strip() for x in value.split(",") if x.strip()]
        elif operator == "exists":
            value = {"true": True, "false": False}.get(value, "")
        if name and value not in ("", [], None):
            out.setdefault(row["image"], {}).setdefault(name, {})[operator] = value
    return out


def filter_to_form(config: dict) -> list[dict]:
    rows = []
    for image in ("newImage", "oldImage"):
        for name, condition in config.get(image, {}).items():
            for operator, value in condition.items():
                text = ", ".join(map(plain_literal, value)) if isinstance(value, list) else plain_literal(value)
                rows.append({"image": image, "field": name, "operator": operator, "value": text})
    return rows
