"""Routing by an index over the sinks' filters: a record meets the rules that it may satisfy, not all.

Distinct rules (collection, event types, filter) are kept as rows. A rule is
found by a key: its collection with all its `eq` conditions on texts, numbers
and booleans, as one text. Rules of one key that also compare a field (gt, gte,
lt, lte) are sorted by the bound, so those that hold are the first ones of a
list, counted by binary search. What is left of a rule's filter is tested on the
few rules found, by Columns that take operators and operands from the rule. So
the plan has the same size for ten sinks and for ten thousand.

Which fields are asked comes from the rules too: they are taken out of a
record's images once, as an array. The result is that of `Filter.column`.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.filters import Value, field_of, is_object, path_of
from ..functions.text import canonical_json, plain_literal, variant_type

#: Bytes of an index up to which it is broadcast; a larger one is joined by its key, as Spark plans it.
BROADCAST_BYTES = 64 << 20
#: Distinct fields up to which each is a Column; more are taken out by an array of paths.
COLUMNS = 48
_COMPARE = ("gt", "gte", "lt", "lte")
_OPERAND = "num double, text string, flag boolean, json string, nums array<double>, texts array<string>, jsons array<string>, flags array<boolean>, nothing boolean"
_TEST = f"field int, op string, {_OPERAND}"
_RULE = f"rule int, sinks array<string>, types array<string>, new boolean, old boolean, rest array<struct<{', '.join(f'{n}:{t}' for n, t in (x.split(' ', 1) for x in _TEST.split(', ')))}>>"
_ENTRY = "form int, parts array<struct<num:double,text:string,flag:boolean>>, field int, down boolean, strict boolean, bound double"


def _kind(x) -> str:
    if isinstance(x, bool):
        return "flag"
    if isinstance(x, (int, float)):
        return "num"
    return "text" if isinstance(x, str) else "none" if x is None else "json"


def _operand(op: str, x) -> dict:
    """An operand as typed columns."""
    out = dict.fromkeys(("num", "text", "flag", "json", "nums", "texts", "jsons", "flags", "nothing"))
    if op in ("in", "notIn"):
        of = lambda kind: [o for o in x if _kind(o) == kind]
        return out | {"nums": [float(o) for o in of("num")], "texts": of("text"), "flags": of("flag"), "jsons": [canonical_json(o) for o in of("json")], "nothing": any(o is None for o in x)}
    if op in ("startsWith", "endsWith"):
        return out | {"text": plain_literal(x)}
    kind = _kind(x)
    value = float(x) if kind == "num" else canonical_json(x) if kind == "json" else x
    return out | {kind: value}


def _equals(v: Column, c: Column) -> Column:
    """A value struct equals a condition's operand; never null."""
    test = F.when(c["num"].isNotNull(), v["double"] == c["num"]).when(c["text"].isNotNull(), v["text"] == c["text"]).when(c["flag"].isNotNull(), v["flag"] == c["flag"])
    return F.coalesce(test.when(c["json"].isNotNull(), F.to_json(v["x"]) == F.to_json(F.try_parse_json(c["json"]))), F.lit(False))


def _any_of(v: Column, c: Column) -> Column:
    inside = lambda values, x: F.coalesce(F.array_contains(values, x), F.lit(False))
    json = F.exists(c["jsons"], lambda j: F.to_json(v["x"]) == F.to_json(F.try_parse_json(j)))
    tests = [inside(c["nums"], v["double"]), inside(c["texts"], v["text"]), inside(c["flags"], v["flag"]), F.coalesce(json, F.lit(False)), c["nothing"] & (v["type"] == "VOID")]
    return reduce(or_, (F.coalesce(t, F.lit(False)) for t in tests))


def _value(x: Column, with_plain: bool = True) -> Column:
    v = Value.of(x)
    flag = F.when(v.type == "BOOLEAN", F.try_variant_get(x, "$", "boolean"))
    shown = v.plain if with_plain else F.lit(None).cast("string")
    return F.struct(x.alias("x"), v.type.alias("type"), v.double.alias("double"), F.when(v.type == "STRING", v.text).alias("text"), flag.alias("flag"), shown.alias("plain"))


def _holds(v: Column, c: Column) -> Column:
    """One condition on a field's value, both as structs; never null. Only `exists` holds of a missing value."""
    op = c["op"]
    there = v["x"].isNotNull()
    inside = F.exists(F.try_variant_get(v["x"], "$", "array<variant>"), lambda e: _equals(_value(e, False), c))
    contains = F.when(v["type"].startswith("ARRAY"), inside).when(c["text"].isNotNull(), F.contains(v["text"], c["text"]))
    number = lambda test: F.coalesce(test, F.lit(False))
    tests = {
        "eq": _equals(v, c), "ne": ~_equals(v, c), "in": _any_of(v, c), "notIn": ~_any_of(v, c),
        "gt": number(v["double"] > c["num"]), "gte": number(v["double"] >= c["num"]), "lt": number(v["double"] < c["num"]), "lte": number(v["double"] <= c["num"]),
        "contains": F.coalesce(contains, F.lit(False)), "startsWith": F.startswith(v["plain"], c["text"]), "endsWith": F.endswith(v["plain"], c["text"]),
    }
    test = reduce(lambda w, k: w.when(op == k, tests[k]), list(tests)[1:], F.when(op == "eq", tests["eq"]))
    return F.when(op == "exists", there == c["flag"]).otherwise(there & F.coalesce(test, F.lit(False)))


class RuleIndex:
    """The rules of a list of sinks, as rows for Spark: `forms` (which fields make up a key), `fields`, and entries with their rules."""

    def __init__(self, sinks):
        rules: dict[tuple, list] = {}
        for s in sinks:
            rules.setdefault(s.rule(), []).append(s)
        self.fields: dict[tuple[str, str], int] = {}
        self.shown = False
        self.forms: dict[tuple[int, ...], int] = {}
        self.rows: list[tuple] = []
        for number, of in enumerate(rules.values()):
            self._add(number, of)

    def _field(self, image: str, name: str) -> int:
        return self.fields.setdefault((image, name), len(self.fields))

    def _add(self, number: int, of: list) -> None:
        first = of[0]
        key: dict[int, dict] = {}
        compared, rest = None, []
        for image, block in (("newImage", first.filter.new), ("oldImage", first.filter.old)):
            for name, condition in block.items():
                field = self._field(image, name)
                if not condition:
                    continue
                for op, x in condition.items():
                    self.shown = self.shown or op in ("startsWith", "endsWith")
                    if op == "eq" and field not in key and _kind(x) in ("num", "text", "flag") and x == x:
                        key[field] = {k: v for k, v in _operand(op, x).items() if k in ("num", "text", "flag")}
                    elif op in _COMPARE and compared is None and _kind(x) == "num" and math.isfinite(x):
                        compared = (field, op in ("lt", "lte"), op in ("gt", "lt"), float(x))
                    else:
                        rest.append({"field": field, "op": op} | _operand(op, x))
        form = self.forms.setdefault(tuple(sorted(key)), len(self.forms))
        types = sorted({t.upper() for t in first.event_types}) or None
        self.rows.append((number, [s.id for s in of], types, bool(first.filter.new), bool(first.filter.old), rest, first.collection, form, [key[f] for f in sorted(key)], *(compared or (None, None, None, None))))

    # -- as Columns

    def values(self) -> Column:
        """A record's fields as an array of structs."""
        asked = list(self.fields)
        if len(asked) <= COLUMNS or any(path_of(name) is None for _, name in asked):
            return F.array(*(_value(field_of(F.col(image), name), self.shown) for image, name in asked)) if asked else F.array(_value(F.lit(None).cast("variant"), False))
        paths = F.array(*(F.struct(F.lit(image == "newImage").alias("new"), F.lit(path_of(name)).alias("path")) for image, name in asked))
        return F.transform(paths, lambda p: _value(F.try_variant_get(F.when(p["new"], F.col("newImage")).otherwise(F.col("oldImage")), p["path"], "variant"), self.shown))

    @staticmethod
    def part(v: Column) -> Column:
        """What a key says of a value: numbers by their double, texts and booleans as they are. Zero has one sign."""
        number = F.concat(F.lit("n"), (v["num"] + F.lit(0.0)).cast("string"))
        text = F.concat(F.lit("t"), F.length(v["text"]).cast("string"), F.lit(":"), v["text"])
        return F.coalesce(number, text, F.concat(F.lit("b"), v["flag"].cast("string")))

    def key(self, collection: Column, form: Column, parts: Column) -> Column:
        """Null where a part is: such a record has no rule of that form."""
        joined = F.aggregate(parts, F.lit(""), lambda a, p: F.concat(a, F.lit("|"), p))
        return F.concat(form.cast("string"), F.lit("/"), F.length(collection).cast("string"), F.lit("/"), collection, joined)

    def keys(self, values: str) -> Column:
        """A record's keys, one for each form whose fields it has."""
        said = lambda f: F.get(F.col(values), F.lit(f))
        as_part = lambda v: self.part({"num": v["double"], "text": v["text"], "flag": v["flag"]})
        parts = lambda fields: F.array(*(as_part(said(f)) for f in fields)) if fields else F.expr("cast(array() as array<string>)")
        return F.array_compact(F.array(*(self.key(F.col("tableName"), F.lit(n), parts(fields)) for fields, n in self.forms.items())))

    def entries(self, spark) -> DataFrame:
        """key, field, down, strict, bounds, rules: the rules of a key that compare the same field in the same way, by their bounds; down: from the highest. Without a comparison: field null."""
        shape = f"{_RULE}, collection string, {_ENTRY}"
        rows = spark.createDataFrame(self.rows, shape)
        key = self.key(F.col("collection"), F.col("form"), F.transform("parts", lambda p: self.part(p)))
        at = F.when(F.col("down"), -F.col("bound")).otherwise(F.col("bound"))
        rule = F.struct(at.alias("at"), "rule", "sinks", "types", "new", "old", "rest")
        grouped = rows.groupBy(key.alias("_key"), F.col("field").alias("_field"), F.col("down").alias("_down"), F.col("strict").alias("_strict")).agg(F.array_sort(F.collect_list(rule)).alias("_rules"))
        return grouped.withColumn("_bounds", F.transform("_rules", lambda r: r["at"]))

    def bytes(self) -> int:
        return sum(len(canonical_json(r)) for r in self.rows) * 4


def _count_below(bounds: Column, x: Column, strict: Column) -> Column:
    """How many of the sorted bounds are below x, or equal to it where that is not strict. A binary search of as many steps as 2^20 bounds need."""
    below = lambda b: F.when(strict, b < x).otherwise(b <= x)
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(21))))
    found = F.aggregate(steps, F.lit(0), lambda n, s: F.when((n + s <= F.size(bounds)) & F.coalesce(below(F.get(bounds, n + s - 1)), F.lit(False)), n + s).otherwise(n))
    return F.when(x.isNull(), 0).otherwise(found)


def matched(records: DataFrame, index: RuleIndex) -> DataFrame:
    """A row for each record and each rule that accepts it, with the rule's sinks as `_sinks`."""
    entries = index.entries(records.sparkSession)
    if index.bytes() <= BROADCAST_BYTES:
        entries = F.broadcast(entries)
    told = records.withColumns({"_values": index.values(), "_new": is_object(F.col("newImage")), "_old": is_object(F.col("oldImage"))})
    told = told.withColumn("_key", F.explode(index.keys("_values"))).join(entries, "_key")
    x = F.get(F.col("_values"), F.col("_field"))["double"]
    many = F.when(F.col("_field").isNull(), F.size("_rules")).otherwise(_count_below(F.col("_bounds"), F.when(F.col("_down"), -x).otherwise(x), F.col("_strict")))
    rule_holds = lambda r: (F.coalesce(F.array_contains(r["types"], F.col("recordType")), F.lit(True)) & (F.col("_new") | ~r["new"]) & (F.col("_old") | ~r["old"])) & F.forall(r["rest"], lambda c: _holds(F.get(F.col("_values"), c["field"]), c))
    rules = F.filter(F.slice(F.col("_rules"), 1, F.col("_many")), rule_holds)
    return told.withColumn("_many", many).where("_many > 0").withColumn("_rule", F.explode(rules)).select(*records.columns, F.col("_rule.sinks").alias("_sinks"))


def route_by_index(records: DataFrame, sinks) -> DataFrame:
    """As routing.route: a row for each record and each sink of its collection that accepts it, with sinkId."""
    sinks = list(sinks)
    if not sinks:
        return records.withColumn("sinkId", F.lit("")).where(F.lit(False))
    return matched(records, RuleIndex(sinks)).withColumn("sinkId", F.explode("_sinks")).select(*records.columns, "sinkId")
