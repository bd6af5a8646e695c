"""JSON Schemas compiled to column expressions over documents of any shape.

A schema becomes one expression that gives a document's violations as an array of JSON pointer and keyword: objects and
arrays are opened as VARIANT values, items by a transform with their index in the path, alternatives by the number of
violations that each gives. No document leaves the JVM, and each is one row's work.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A check takes a value (VARIANT, not SQL null) and its pointer and gives its violations.
Check = Callable[[Column, Column], Column]
NONE = "array<struct<path: string, rule: string>>"
# The forms of texts that `format` names.
FORMATS = {
    "date": r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$",
    "date-time": r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])[Tt]([01][0-9]|2[0-3]):[0-5][0-9]:([0-5][0-9]|60)(\.[0-9]+)?([Zz]|[+-]([01][0-9]|2[0-3]):[0-5][0-9])$",
    "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s<>\"{}|\\^`]*$",
    "email": r"^[^@\s]+@[^@\s]+$",
}
#: Keywords that say nothing about a value.
SILENT = {"$schema", "$id", "$defs", "$comment", "title", "description", "default", "examples", "deprecated"}


def _none() -> Column:
    return F.array().cast(NONE)


def _one(bad: Column, path: Column, rule: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.array(F.struct(path.alias("path"), F.lit(rule).alias("rule"))).cast(NONE)).otherwise(_none())


def _token(key: Column) -> Column:
    return F.concat(F.lit("/"), F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))


def _kind(value: Column) -> Column:
    """object, array, string, boolean, null, integer or number."""
    s = F.schema_of_variant(value)
    whole = F.try_variant_get(value, "$", "decimal(38,10)")
    number = F.when(whole == F.floor(whole), "integer").otherwise("number")
    return F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s == "VOID", "null").otherwise(number)


def _member(value: Column, name: str) -> Column:
    """An object's member, SQL null if it has none of that name."""
    return F.try_element_at(F.try_variant_get(value, "$", "map<string,variant>"), F.lit(name))


def _let(value: Column, result: Callable[[Column], Column]) -> Column:
    """result of a value that is made once, however often result names it."""
    return F.get(F.transform(F.array(value), result), 0)


class Compiler:
    """Checks of a schema and of what its references name; a reference that leads back to itself can't be compiled."""

    def __init__(self, root: dict):
        self.root = root

    def target(self, reference: str) -> dict:
        if not reference.startswith("#"):
            raise ValueError(f"only references within the schema are read: {reference}")
        node = self.root
        for part in reference[1:].split("/")[1:]:
            node = node[part.replace("~1", "/").replace("~0", "~")]
        return node

    def check(self, schema: dict | bool, within: tuple[str, ...] = ()) -> Check:
        """All of a schema's keywords in one check."""
        if isinstance(schema, bool):
            return lambda v, p: _none() if schema else _one(F.lit(True), p, "false")
        parts: list[Check] = []
        for keyword in sorted(schema):
            if keyword in SILENT or keyword in ("then", "else", "minContains"):
                continue
            make = getattr(self, "_" + keyword.lstrip("$").lower(), None)
            if make is None:
                raise ValueError(f"keyword that isn't compiled: {keyword}")
            parts.append(make(schema, within))
        return lambda v, p: F.concat(_none(), *(part(v, p) for part in parts))

    def _ref(self, schema: dict, within: tuple[str, ...]) -> Check:
        name = schema["$ref"]
        if name in within:
            raise ValueError(f"a reference leads back to itself: {name}")
        return self.check(self.target(name), (*within, name))

    # Values of any kind.
    def _type(self, schema: dict, within: tuple) -> Check:
        names = [schema["type"]] if isinstance(schema["type"], str) else list(schema["type"])
        names += ["integer"] if "number" in names else []
        return lambda v, p: _one(~_kind(v).isin(*names), p, "type")

    def _enum(self, schema: dict, within: tuple) -> Check:
        forms = [json.dumps(x, ensure_ascii=False, separators=(",", ":"), sort_keys=True) for x in schema["enum"]]
        return lambda v, p: _one(~F.to_json(v).isin(*forms), p, "enum")

    def _const(self, schema: dict, within: tuple) -> Check:
        form = json.dumps(schema["const"], ensure_ascii=False, separators=(",", ":"), sort_keys=True)
        return lambda v, p: _one(F.to_json(v) != form, p, "const")

    # Texts and numbers.
    def _text(self, keyword: str, bad: Callable[[Column], Column]) -> Check:
        return lambda v, p: _one((F.schema_of_variant(v) == "STRING") & bad(F.try_variant_get(v, "$", "string")), p, keyword)

    def _pattern(self, schema: dict, within: tuple) -> Check:
        return self._text("pattern", lambda t: ~t.rlike(schema["pattern"]))

    def _minlength(self, schema: dict, within: tuple) -> Check:
        return self._text("minLength", lambda t: F.char_length(t) < schema["minLength"])

    def _maxlength(self, schema: dict, within: tuple) -> Check:
        return self._text("maxLength", lambda t: F.char_length(t) > schema["maxLength"])

    def _format(self, schema: dict, within: tuple) -> Check:
        form = FORMATS.get(schema["format"])
        if form is None:
            raise ValueError(f"format that isn't compiled: {schema['format']}")
        day = (lambda t: F.try_to_date(F.substring(t, 1, 10), "yyyy-MM-dd").isNull()) if schema["format"].startswith("date") else (lambda t: F.lit(False))
        return self._text("format", lambda t: ~t.rlike(form) | day(t))

    def _number(self, keyword: str, bad: Callable[[Column], Column]) -> Check:
        return lambda v, p: _one(_kind(v).isin("integer", "number") & bad(F.try_variant_get(v, "$", "double")), p, keyword)

    def _minimum(self, schema: dict, within: tuple) -> Check:
        return self._number("minimum", lambda n: n < schema["minimum"])

    def _maximum(self, schema: dict, within: tuple) -> Check:
        return self._number("maximum", lambda n: n > schema["maximum"])

    def _exclusiveminimum(self, schema: dict, within: tuple) -> Check:
        return self._number("exclusiveMinimum", lambda n: n <= schema["exclusiveMinimum"])

    def _exclusivemaximum(self, schema: dict, within: tuple) -> Check:
        return self._number("exclusiveMaximum", lambda n: n >= schema["exclusiveMaximum"])

    # Objects.
    def _required(self, schema: dict, within: tuple) -> Check:
        return lambda v, p: F.concat(_none(), *(_one((_kind(v) == "object") & _member(v, n).isNull(), F.concat(p, _token(F.lit(n))), "required") for n in schema["required"]))

    def _properties(self, schema: dict, within: tuple) -> Check:
        checks = {n: self.check(s, within) for n, s in sorted(schema["properties"].items())}

        def run(v: Column, p: Column) -> Column:
            one = lambda n, c: _let(_member(v, n), lambda m: F.when(m.isNotNull(), c(m, F.concat(p, _token(F.lit(n))))).otherwise(_none()))
            return F.concat(_none(), *(one(n, c) for n, c in checks.items()))

        return run

    def _additionalproperties(self, schema: dict, within: tuple) -> Check:
        known, rule = list(schema.get("properties", {})), schema["additionalProperties"]
        own = self.check(rule, within) if isinstance(rule, dict) else None

        def run(v: Column, p: Column) -> Column:
            entries = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
            others = F.filter(entries, lambda e: ~e["key"].isin(*known)) if known else entries
            at = lambda e: F.concat(p, _token(e["key"]))
            if rule is True:
                return _none()
            found = F.transform(others, lambda e: own(e["value"], at(e)) if own else _one(F.lit(True), at(e), "additionalProperties"))
            return F.coalesce(F.flatten(found), _none())

        return run

    # Arrays.
    def _array(self, keyword: str, bad: Callable[[Column], Column]) -> Check:
        return lambda v, p: _one(bad(F.try_variant_get(v, "$", "array<variant>")), p, keyword)

    def _items(self, schema: dict, within: tuple) -> Check:
        own = self.check(schema["items"], within)
        return lambda v, p: F.coalesce(F.flatten(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x, i: own(x, F.concat(p, F.lit("/"), i.cast("string"))))), _none())

    def _minitems(self, schema: dict, within: tuple) -> Check:
        return self._array("minItems", lambda a: a.isNotNull() & (F.size(a) < schema["minItems"]))

    def _maxitems(self, schema: dict, within: tuple) -> Check:
        return self._array("maxItems", lambda a: a.isNotNull() & (F.size(a) > schema["maxItems"]))

    def _uniqueitems(self, schema: dict, within: tuple) -> Check:
        return self._array("uniqueItems", lambda a: a.isNotNull() & F.lit(bool(schema["uniqueItems"])) & (F.size(F.array_distinct(F.transform(a, lambda x: F.to_json(x)))) < F.size(a)))

    def _contains(self, schema: dict, within: tuple) -> Check:
        own, least = self.check(schema["contains"], within), schema.get("minContains", 1)
        return lambda v, p: self._array("contains", lambda a: a.isNotNull() & (F.size(F.filter(a, lambda x: F.size(own(x, p)) == 0)) < least))(v, p)

    # Alternatives: a schema holds if it gives no violation.
    def _holding(self, schemas: list, within: tuple) -> Callable[[Column, Column], Column]:
        checks = [self.check(s, within) for s in schemas]
        zero = F.lit(0)
        return lambda v, p: sum((F.when(F.size(c(v, p)) == 0, 1).otherwise(0) for c in checks), zero)

    def _allof(self, schema: dict, within: tuple) -> Check:
        checks = [self.check(s, within) for s in schema["allOf"]]
        return lambda v, p: F.concat(_none(), *(c(v, p) for c in checks))

    def _anyof(self, schema: dict, within: tuple) -> Check:
        n = self._holding(schema["anyOf"], within)
        return lambda v, p: _one(n(v, p) == 0, p, "anyOf")

    def _oneof(self, schema: dict, within: tuple) -> Check:
        n = self._holding(schema["oneOf"], within)
        return lambda v, p: _one(n(v, p) != 1, p, "oneOf")

    def _not(self, schema: dict, within: tuple) -> Check:
        n = self._holding([schema["not"]], within)
        return lambda v, p: _one(n(v, p) == 1, p, "not")

    def _if(self, schema: dict, within: tuple) -> Check:
        n = self._holding([schema["if"]], within)
        yes, no = (self.check(schema.get(k, True), within) for k in ("then", "else"))
        return lambda v, p: F.when(n(v, p) == 1, yes(v, p)).otherwise(no(v, p))


def violations(document: Column, schema: dict, first: int | None = 10) -> Column:
    """The violations of a JSON text by path and keyword as an array of structs, the first ten by default; a text that isn't JSON has one, null has none."""
    check = Compiler(schema).check(schema)

    def run(value: Column) -> Column:
        found = F.sort_array(F.array_distinct(check(value, F.lit(""))))
        found = found if first is None else F.slice(found, 1, first)
        return F.when(value.isNotNull(), found).when(document.isNotNull(), _one(F.lit(True), F.lit(""), "json")).otherwise(_none())

    return _let(F.try_parse_json(document), run)
