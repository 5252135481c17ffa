"""JSON schemas: checks of documents as columns, and patches that rewrite typed rows."""

from __future__ import annotations

import copy

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PATCH_OPS = ("add", "remove", "replace", "move", "copy")


def violations(data: str, schema: dict) -> Column:
    """Problems of each document as texts `path: problem`; the schema is compiled once, rows are checked by columns."""
    doc = F.try_parse_json(F.col(data))
    checks = _checks(doc, "", "$", schema)
    return F.when(doc.isNull(), F.array(F.lit("not JSON"))).otherwise(F.array_compact(F.array(*checks)))


def _kind(doc: Column, path: str) -> Column:
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get(doc, path, "variant")), "^[A-Z]+", 0)


def _checks(doc: Column, name: str, path: str, schema: dict) -> list[Column]:
    kind = _kind(doc, path)
    label = name or "document"
    wanted = {"string": ("STRING",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",), "object": ("OBJECT",), "array": ("ARRAY",)}[schema.get("type", "object")]
    wrong = kind.isNotNull() & ~kind.isin(*wanted)
    out = [F.when(wrong, F.lit(f"{label}: not a {schema.get('type', 'object')}"))]
    text = F.try_variant_get(doc, path, "string")
    if "enum" in schema:
        out.append(F.when(text.isNotNull() & ~text.isin(*schema["enum"]), F.lit(f"{label}: not in the list")))
    if "pattern" in schema:
        out.append(F.when(text.isNotNull() & ~text.rlike(schema["pattern"]), F.lit(f"{label}: doesn't fit the pattern")))
    if schema.get("type") == "object":
        for key in schema.get("required", []):
            out.append(F.when(_kind(doc, f"{path}.{key}").isNull(), F.lit(f"{label}: {key} is missing")))
        if schema.get("additionalProperties") is False:
            keys = F.json_object_keys(F.to_json(doc)) if path == "$" else F.json_object_keys(F.get_json_object(F.to_json(doc), path))
            more = F.array_except(keys, F.array(*map(F.lit, schema["properties"])))
            out.append(F.when(F.size(more) > 0, F.concat(F.lit(f"{label}: more fields: "), F.array_join(F.sort_array(more), ", "))))
        for key, sub in schema["properties"].items():
            out += _checks(doc, f"{name}.{key}" if name else key, f"{path}.{key}", sub)
    return out


def steps_of(pointer: str) -> list[str]:
    """Field names of a pointer into a schema, such as /properties/a/properties/b."""
    parts = [p.replace("~1", "/").replace("~0", "~") for p in pointer.split("/")[1:]]
    if len(parts) % 2 or any(p != "properties" for p in parts[::2]):
        raise ValueError(f"not a field: {pointer}")
    return parts[1::2]


def patched(schema: dict, patches: list[dict]) -> dict:
    """The schema after patches."""
    out = copy.deepcopy(schema)

    def holder(path: list[str]) -> dict:
        node = out
        for p in path[:-1]:
            node = node["properties"][p]
        return node["properties"]

    for patch in patches:
        if patch["op"] not in PATCH_OPS:
            raise ValueError(f"unknown operation {patch['op']!r}")
        path = steps_of(patch["path"])
        if patch["op"] in ("add", "replace"):
            if patch["op"] == "replace" and path[-1] not in holder(path):
                raise ValueError(f"{patch['path']} is missing")
            holder(path)[path[-1]] = copy.deepcopy(patch["value"])
        elif patch["op"] == "remove":
            del holder(path)[path[-1]]
        else:
            source = steps_of(patch["from"])
            value = holder(source)[source[-1]] if patch["op"] == "copy" else holder(source).pop(source[-1])
            holder(path)[path[-1]] = copy.deepcopy(value)
    return out


def default_of(schema: dict) -> Column:
    from tessera.functions.jsonpath import schema_type

    if "default" in schema:
        return F.lit(schema["default"]).cast(schema_type(schema))
    if schema.get("type") == "object":
        return F.struct(*[default_of(v).alias(k) for k, v in schema["properties"].items()])
    if schema.get("type") == "array":
        return F.array().cast(schema_type(schema))
    return F.lit({"number": 0.0, "boolean": False}.get(schema.get("type"), ""))


def convert(value: Column, before: dict, after: dict) -> Column:
    """A value for another type; the default where it can't be read so."""
    from tessera.functions.jsonpath import schema_type

    a, b = before.get("type"), after.get("type")
    if a == b:
        return value
    if b == "string" and a == "number":
        whole = value == F.floor(value)
        return F.when(whole, F.floor(value).cast("string")).otherwise(value.cast("string"))
    if b == "string" and a == "boolean":
        return value.cast("string")
    if a in ("string", "number", "boolean") and b in ("number", "boolean"):
        return F.coalesce(value.try_cast(schema_type(after)), default_of(after))
    return default_of(after)


def apply_patches(rows: DataFrame, column: str, schema: dict, patches: list[dict]) -> tuple[DataFrame, dict]:
    """Typed rows rewritten patch by patch, and the new schema: one projection, as the struct is only rebuilt."""
    for patch in patches:
        after = patched(schema, [patch])
        path, d = steps_of(patch["path"]), F.col(column)

        def field(node: dict, names: list[str]) -> dict:
            for n in names:
                node = node["properties"][n]
            return node

        dotted = ".".join(path)
        if patch["op"] == "add":
            made = d.withField(dotted, default_of(patch["value"]))
        elif patch["op"] == "remove":
            made = d.dropFields(dotted)
        elif patch["op"] == "replace":
            made = d.withField(dotted, convert(F.col(f"{column}.{dotted}"), field(schema, path), patch["value"]))
        else:
            source = ".".join(steps_of(patch["from"]))
            made = d.withField(dotted, F.col(f"{column}.{source}"))
            if patch["op"] == "move":
                made = made.dropFields(source)
        rows, schema = rows.withColumn(column, made), after
    return rows, schema


def patch_value(document: Column, path: str, value: Column) -> Column:
    """A typed document with one value replaced."""
    return document.withField(path, value)
