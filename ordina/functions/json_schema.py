"""A JSON Schema subset: type, properties, required, additionalProperties, items, enum, const, bounds, lengths,
anyOf, oneOf, allOf and local $ref. An unknown keyword is an error when the schema is compiled, not a pass;
true and false are no numbers, and 7.0 is no integer. Bounds on a value of another type are a violation.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Keywords (fixed values: the standard's names).
_KNOWN = frozenset(
    """$schema $id $defs definitions $ref title description type properties required additionalProperties items enum const minimum maximum exclusiveMinimum
    exclusiveMaximum minLength maxLength minItems maxItems anyOf oneOf allOf""".split()
)
_number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
_TYPES: dict[str, Callable[[object], bool]] = {
    "object": lambda v: isinstance(v, dict), "array": lambda v: isinstance(v, list), "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool), "null": lambda v: v is None, "number": _number, "integer": lambda v: _number(v) and isinstance(v, int),
}
_BOUNDS: dict[str, Callable[[object, object], bool]] = {
    "minimum": lambda v, b: _number(v) and v >= b, "maximum": lambda v, b: _number(v) and v <= b,
    "exclusiveMinimum": lambda v, b: _number(v) and v > b, "exclusiveMaximum": lambda v, b: _number(v) and v < b,
    "minLength": lambda v, b: isinstance(v, str) and len(v) >= b, "maxLength": lambda v, b: isinstance(v, str) and len(v) <= b,
    "minItems": lambda v, b: isinstance(v, list) and len(v) >= b, "maxItems": lambda v, b: isinstance(v, list) and len(v) <= b,
}


def check_schema(schema: object) -> None:
    if isinstance(schema, bool):
        return
    if unknown := set(schema) - _KNOWN:
        raise ValueError(f"keywords that are not supported: {sorted(unknown)}")
    for part in (*schema.get("properties", {}).values(), *schema.get("$defs", {}).values(), *schema.get("definitions", {}).values(), *(s for k in ("anyOf", "oneOf", "allOf") for s in schema.get(k, ()))):
        check_schema(part)
    for k in ("items", "additionalProperties"):
        if isinstance(schema.get(k), dict):
            check_schema(schema[k])


def referred(ref: str, root: dict) -> object:
    """What a local reference points to: steps from the root, in which ~1 stands for / and ~0 for ~."""
    if ref != "#" and not ref.startswith("#/"):
        raise ValueError(f"references must be local: {ref}")
    target = root
    for step in ref[2:].split("/") if len(ref) > 1 else ():
        step = step.replace("~1", "/").replace("~0", "~")
        try:
            target = target[int(step)] if isinstance(target, list) else target[step]
        except (KeyError, IndexError, ValueError):
            raise ValueError(f"nothing is at {ref}") from None
    return target


def violations(value: object, schema: object, at: str = "$", root: dict | None = None) -> list[str]:
    """Paths and keywords that the value violates."""
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: false"]
    root = schema if root is None else root
    out: list[str] = []
    if ref := schema.get("$ref"):
        out += violations(value, referred(ref, root), at, root)
    if kinds := schema.get("type"):
        if not any(_TYPES[k](value) for k in ([kinds] if isinstance(kinds, str) else kinds)):
            return [*out, f"{at}: type"]
    same = lambda a, b: a == b and isinstance(a, bool) == isinstance(b, bool)
    if "const" in schema and not same(value, schema["const"]):
        out.append(f"{at}: const")
    if "enum" in schema and not any(same(value, e) for e in schema["enum"]):
        out.append(f"{at}: enum")
    out += [f"{at}: {k}" for k, holds in _BOUNDS.items() if k in schema and not holds(value, schema[k])]
    if isinstance(value, dict):
        known, extra = schema.get("properties", {}), schema.get("additionalProperties", True)
        out += [f"{at}.{k}: required" for k in schema.get("required", ()) if k not in value]
        for k, v in value.items():
            out += violations(v, known.get(k, extra), f"{at}.{k}", root)
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += violations(v, schema["items"], f"{at}[{i}]", root)
    passing = lambda k: sum(not violations(value, s, at, root) for s in schema[k])
    if "allOf" in schema and passing("allOf") < len(schema["allOf"]):
        out.append(f"{at}: allOf")
    if "anyOf" in schema and not passing("anyOf"):
        out.append(f"{at}: anyOf")
    if "oneOf" in schema and passing("oneOf") != 1:
        out.append(f"{at}: oneOf")
    return out


def schema_violations(c: Column, schema: dict) -> Column:
    """Violations of each JSON text, as an array; text that is no JSON violates `$: json`, null stays null. Schemas are
    compiled to built-in expressions over a variant; those that refer to themselves, or have an enum or const that is an
    object or list, are checked in Python."""
    check_schema(schema)
    whole = lambda v: F.when(v.isNull(), F.array(F.lit("$: json"))).otherwise(_compiled(v, schema, F.lit("$"), schema, ()))
    try:
        found = _let(F.try_parse_json(c), whole)
    except _NotCompiled:
        return _checked_in_python(c, schema)
    return F.when(c.isNull(), None).otherwise(found)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression over a value that is made once, however often the expression names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


class _NotCompiled(Exception):  # noqa: N818
    pass


def _no_violations() -> Column:
    return F.array().cast("array<string>")


def _one(wrong: Column, at: Column, keyword: str) -> Column:
    return F.when(F.coalesce(wrong, F.lit(True)), F.array(F.concat(at, F.lit(f": {keyword}")))).otherwise(_no_violations())


def _part(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _is(name: Column, kind: str) -> Column:
    """Whether a variant (by the name of its type) is of a JSON type; a number with a fraction part, even .0, is no integer."""
    if kind in ("integer", "number"):
        # integers beyond 64 bits are decimals without a fraction, like 7.0 but longer
        whole = (name == "BIGINT") | name.rlike(r"^DECIMAL\((19|[23][0-9]),0\)$")
        return whole if kind == "integer" else whole | name.rlike("^(DECIMAL|DOUBLE|FLOAT)")
    return {"object": name.startswith("OBJECT"), "array": name.startswith("ARRAY"), "string": name == "STRING", "boolean": name == "BOOLEAN", "null": name == "VOID"}[kind]


def _same(v: Column, name: Column, wanted: object) -> Column:
    if isinstance(wanted, (dict, list)):
        raise _NotCompiled
    if wanted is None:
        return _is(name, "null")
    if isinstance(wanted, bool):
        return _is(name, "boolean") & (_part(v, "$", "boolean") == wanted)
    if isinstance(wanted, str):
        return _is(name, "string") & (_part(v, "$", "string") == wanted)
    return _is(name, "number") & (_part(v, "$", "double") == float(wanted))


def _compiled(v: Column, schema: object, at: Column, root: dict, through: tuple[str, ...]) -> Column:
    """The violations of a variant that is there, as built-in expressions."""
    if isinstance(schema, bool):
        return _no_violations() if schema else F.array(F.concat(at, F.lit(": false")))
    return _let(F.struct(v.alias("v"), F.schema_of_variant(v).alias("name")), lambda t: _rules(t["v"], t["name"], schema, at, root, through))


def _rules(v: Column, name: Column, schema: dict, at: Column, root: dict, through: tuple[str, ...]) -> Column:
    first: list[Column] = []
    if ref := schema.get("$ref"):
        if ref in through:
            raise _NotCompiled
        first.append(_compiled(v, referred(ref, root), at, root, (*through, ref)))
    out: list[Column] = []
    if "const" in schema:
        out.append(_one(~_same(v, name, schema["const"]), at, "const"))
    if "enum" in schema:
        out.append(_one(~reduce(lambda a, b: a | b, [_same(v, name, e) for e in schema["enum"]], F.lit(False)), at, "enum"))
    number, items = _part(v, "$", "double"), _part(v, "$", "array<variant>")
    sizes = {"Length": ("string", F.length(_part(v, "$", "string"))), "Items": ("array", F.size(items))}
    for k in _BOUNDS:
        if k in schema:
            kind, size = sizes.get(k[3:], ("number", number))
            holds = {"minimum": size >= schema[k], "maximum": size <= schema[k], "exclusiveMinimum": size > schema[k], "exclusiveMaximum": size < schema[k]}.get(k, size >= schema[k] if k.startswith("min") else size <= schema[k])
            out.append(_one(~(_is(name, kind) & holds), at, k))
    known, extra = schema.get("properties", {}), schema.get("additionalProperties", True)
    for k in (*schema.get("required", ()), *known):
        if "'" in k or "\\" in k:
            raise _NotCompiled
    if schema.get("required") or known or extra is not True:

        def of_object(there: Column) -> Column:
            parts = [_one(~F.array_contains(there, k), F.concat(at, F.lit(f".{k}")), "required") for k in schema.get("required", ())]
            for k, part in known.items():
                inner = _compiled(_part(v, f"$['{k}']", "variant"), part, F.concat(at, F.lit(f".{k}")), root, through)
                parts.append(F.when(F.array_contains(there, k), inner).otherwise(_no_violations()))
            if extra is not True:
                others = F.array_except(there, F.array(*[F.lit(k) for k in known]).cast("array<string>"))
                if extra is False:
                    parts.append(F.transform(others, lambda k: F.concat(at, F.lit("."), k, F.lit(": false"))))
                else:
                    values = _part(v, "$", "map<string,variant>")
                    parts.append(F.flatten(F.transform(others, lambda k: _compiled(values[k], extra, F.concat(at, F.lit("."), k), root, through))))
            return F.concat(*parts)

        out.append(F.when(_is(name, "object"), _let(F.json_object_keys(F.to_json(v)), of_object)).otherwise(_no_violations()))
    if "items" in schema:
        each = F.transform(items, lambda x, i: _compiled(x, schema["items"], F.concat(at, F.lit("["), i.cast("string"), F.lit("]")), root, through))
        out.append(F.when(_is(name, "array"), F.flatten(each)).otherwise(_no_violations()))
    for k, holds in (("allOf", lambda n, of: n == of), ("anyOf", lambda n, of: n > 0), ("oneOf", lambda n, of: n == 1)):
        if k in schema:
            passing = reduce(lambda a, b: a + b, [(F.size(_compiled(v, s, at, root, through)) == 0).cast("int") for s in schema[k]], F.lit(0))
            out.append(_one(~holds(passing, len(schema[k])), at, k))
    rest = F.concat(*out) if out else _no_violations()
    if kinds := schema.get("type"):
        right = reduce(lambda a, b: a | b, [_is(name, k) for k in ([kinds] if isinstance(kinds, str) else kinds)])
        rest = F.when(F.coalesce(right, F.lit(False)), rest).otherwise(F.array(F.concat(at, F.lit(": type"))))
    return F.concat(*first, rest) if first else rest


def _checked_in_python(c: Column, schema: dict) -> Column:
    def of(text: str | None) -> list[str] | None:
        if text is None:
            return None
        try:
            value = json.loads(text)
        except ValueError:
            return ["$: json"]
        return violations(value, schema)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def check(values: pd.Series) -> pd.Series:
        return values.map(of)

    return check(c)
