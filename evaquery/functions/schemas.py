"""Validation of JSON documents against a schema, one document at a time."""

from __future__ import annotations

import json
from collections.abc import Iterator

TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value: object, name: str) -> bool:
    if name in ("number", "integer"):
        right = isinstance(value, (int, float)) and not isinstance(value, bool)
        return right and (name == "number" or float(value).is_integer())
    return isinstance(value, TYPES[name])


def errors(value: object, schema: dict | bool, root: dict | None = None, path: tuple = ()) -> Iterator[tuple[tuple, str]]:
    """(path, message) of everything in ``value`` that breaks ``schema``.

    Knows type, const, enum, required, properties, additionalProperties, items, minItems,
    maxItems, uniqueItems, minimum, maximum, minLength, allOf, anyOf, oneOf and references
    into the schema itself; other keywords ask for nothing.
    """
    root = schema if root is None else root
    if schema is True or schema is False:
        if schema is False:
            yield path, "nothing is allowed here"
        return
    if "$ref" in schema:
        target = root
        for part in schema["$ref"].lstrip("#/").split("/"):
            target = target[part]
        yield from errors(value, target, root, path)
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        yield path, f"is not of type {' or '.join(kinds)}"
        return
    same = lambda other: value == other and isinstance(value, bool) == isinstance(other, bool)
    if "const" in schema and not same(schema["const"]):
        yield path, f"is not {json.dumps(schema['const'])}"
    if "enum" in schema and not any(map(same, schema["enum"])):
        yield path, f"is none of {json.dumps(schema['enum'])}"
    if isinstance(value, dict):
        for name in schema.get("required", ()):
            if name not in value:
                yield path, f"lacks {name}"
        known, rest = schema.get("properties", {}), schema.get("additionalProperties", True)
        for name, own in value.items():
            if name in known:
                yield from errors(own, known[name], root, (*path, name))
            elif rest is False:
                yield path, f"has the unknown property {name}"
            else:
                yield from errors(own, rest, root, (*path, name))
    if isinstance(value, list):
        if len(value) < schema.get("minItems", 0):
            yield path, f"has fewer than {schema['minItems']} items"
        if len(value) > schema.get("maxItems", len(value)):
            yield path, f"has more than {schema['maxItems']} items"
        if schema.get("uniqueItems") and len({json.dumps(x, sort_keys=True) for x in value}) < len(value):
            yield path, "repeats an item"
        for i, own in enumerate(value):
            yield from errors(own, schema.get("items", True), root, (*path, i))
    if _is(value, "number"):
        if value < schema.get("minimum", value):
            yield path, f"is less than {schema['minimum']}"
        if value > schema.get("maximum", value):
            yield path, f"is more than {schema['maximum']}"
    if isinstance(value, str) and len(value) < schema.get("minLength", 0):
        yield path, f"is shorter than {schema['minLength']}"
    for part in schema.get("allOf", ()):
        yield from errors(value, part, root, path)
    for name in ("anyOf", "oneOf"):
        if name in schema:
            fits = sum(not any(errors(value, part, root, path)) for part in schema[name])
            if fits == 0 or (name == "oneOf" and fits > 1):
                yield path, f"fits {fits} of the {len(schema[name])} ways of {name}"


def validated(text: str | None, schema: dict) -> list[tuple[str, str]]:
    """Errors of a document by path, then message; a text that is no JSON is one error at the root."""
    try:
        value = json.loads(text or "")
    except ValueError:
        return [("$", "is no JSON")]
    named = lambda path: "$" + "".join(f"[{p}]" if isinstance(p, int) else f".{p}" for p in path)
    found = sorted(errors(value, schema), key=lambda e: ([(isinstance(p, str), p) for p in e[0]], e[1]))
    return [(named(p), m) for p, m in found]
