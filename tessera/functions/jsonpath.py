"""Filters and sorts over JSON documents, compiled from request trees to columns.

A filter is {"AND": [...]}, {"OR": [...]}, {"NOT": {...} or [...]}, a system column {"id": {op: value}}, or
{"data": {"path": "a.b" or ["a", "*", "b"], op: value}}. A "*" in a path stands for any array element; the condition
then holds if any value fits. Choices where the behaviour was open: comparisons are numeric for numbers and by code
point for texts, a value of the other type doesn't match, and text operators are case-sensitive unless
{"mode": "insensitive"} is given. A missing value matches nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SYSTEM_COLUMNS = {"id": "string", "createdId": "string", "versionId": "string", "hash": "string", "schemaHash": "string", "readonly": "boolean", "createdAt": "date", "updatedAt": "date", "publishedAt": "date"}
#: Schema references whose fields stand for physical columns.
METADATA_REFS = {"RowId": "id", "RowCreatedId": "createdId", "RowVersionId": "versionId", "RowHash": "hash", "RowSchemaHash": "schemaHash", "RowCreatedAt": "createdAt", "RowUpdatedAt": "updatedAt", "RowPublishedAt": "publishedAt"}
TEXT_OPS = {"string_contains": "contains", "string_starts_with": "startsWith", "string_ends_with": "endsWith"}


def snake(name: str) -> str:
    return "".join("_" + c.lower() if c.isupper() else c for c in name)


def steps(path: str | list[str]) -> list[str]:
    return path.replace("[*]", ".*").split(".") if isinstance(path, str) else list(path)


def _schema(parts: list[str]) -> str:
    if not parts:
        return "string"
    inner = _schema(parts[1:])
    return f"array<{inner}>" if parts[0] == "*" else f"struct<`{parts[0]}`:{inner}>"


def values_at(data: Column | str, path: str | list[str]) -> Column:
    """All values at a path as an array of texts, in document order; JSON text for objects and arrays."""
    parts = steps(path)
    c = F.from_json(F.col(data) if isinstance(data, str) else data, _schema(parts))

    def walk(c: Column, rest: list[str]) -> Column:
        if not rest:
            return F.array(c)
        if rest[0] == "*":
            return F.flatten(F.transform(c, lambda x: walk(x, rest[1:])))
        return walk(c[rest[0]], rest[1:])

    return F.filter(F.coalesce(walk(c, parts), F.array().cast("array<string>")), lambda x: x.isNotNull())


def value_at(data: Column | str, path: str | list[str]) -> Column:
    parts = steps(path)
    return F.get_json_object(F.col(data) if isinstance(data, str) else data, "$." + ".".join(parts))


def _compare(value: Column, op: str, wanted, fold: bool) -> Column:
    if isinstance(wanted, bool):
        typed, wanted_c = value, F.lit(str(wanted).lower())
    elif isinstance(wanted, int | float):
        typed, wanted_c = value.try_cast("double"), F.lit(float(wanted))
    else:
        typed, wanted_c = (F.lower(value), F.lower(F.lit(wanted))) if fold else (value, F.lit(wanted))
    made = {
        "equals": lambda: typed == wanted_c, "not": lambda: typed != wanted_c, "gt": lambda: typed > wanted_c, "gte": lambda: typed >= wanted_c, "lt": lambda: typed < wanted_c, "lte": lambda: typed <= wanted_c,
        "contains": lambda: typed.contains(wanted_c), "startsWith": lambda: typed.startswith(wanted_c), "endsWith": lambda: typed.endswith(wanted_c),
    }
    if op not in made:
        raise ValueError(f"unknown operation {op!r}")
    return F.coalesce(made[op](), F.lit(False))


def _comparison(op: str, wanted, fold: bool):
    return lambda x: _compare(x, op, wanted, fold)


def _one_of(parts: list[Column], empty: bool, both) -> Column:
    return reduce(both, parts) if parts else F.lit(empty)


def compile_where(where: dict | None, data: str = "data") -> Column:
    parts: list[Column] = []
    for key, spec in (where or {}).items():
        if key == "AND":
            parts.append(_one_of([compile_where(w, data) for w in spec], True, lambda a, b: a & b))
        elif key == "OR":
            parts.append(_one_of([compile_where(w, data) for w in spec], False, lambda a, b: a | b))
        elif key == "NOT":
            parts.append(~_one_of([compile_where(w, data) for w in (spec if isinstance(spec, list) else [spec])], True, lambda a, b: a & b))
        elif key in ("data", "meta"):
            parts.append(_json_filter(spec, data if key == "data" else key))
        elif key in SYSTEM_COLUMNS:
            spec = spec if isinstance(spec, dict) else {"equals": spec}
            fold = spec.get("mode") == "insensitive"
            for op, wanted in spec.items():
                if op in ("in", "notIn"):
                    found = F.col(snake(key)).isin(list(wanted))
                    parts.append(found if op == "in" else ~found)
                elif op != "mode":
                    parts.append(_compare(F.col(snake(key)), op, wanted, fold))
        else:
            raise ValueError(f"unknown column {key!r}")
    return _one_of(parts, True, lambda a, b: a & b)


def _json_filter(spec: dict, column: str) -> Column:
    path = steps(spec["path"])
    fold = spec.get("mode") == "insensitive"
    parts = []
    for op, wanted in spec.items():
        if op in ("path", "mode"):
            continue
        if op == "array_contains":
            have = values_at(column, [*path, "*"])
            parts.append(_one_of([F.array_contains(have, str(w).lower() if isinstance(w, bool) else str(w)) for w in (wanted if isinstance(wanted, list) else [wanted])], True, lambda a, b: a & b))
        elif op == "in":
            parts.append(F.arrays_overlap(values_at(column, path), F.array(*[F.lit(str(w)) for w in wanted])))
        else:
            name = TEXT_OPS.get(op, op)
            if "*" in path:
                parts.append(F.exists(values_at(column, path), _comparison(name, wanted, fold)))
            else:
                parts.append(_compare(value_at(column, path), name, wanted, fold))
    return _one_of(parts, True, lambda a, b: a & b)


def remap(where: dict | None, schema: dict) -> dict | None:
    """The filter with `data` paths that a schema refers to row metadata rewritten to system columns."""
    if where is None:
        return None
    out: dict = {}
    for key, spec in where.items():
        if key in ("AND", "OR") or (key == "NOT" and isinstance(spec, list)):
            out[key] = [remap(w, schema) for w in spec]
        elif key == "NOT":
            out[key] = remap(spec, schema)
        elif key == "data" and (column := metadata_column(spec["path"], schema)):
            out.setdefault(column, {}).update({TEXT_OPS.get(op, op): v for op, v in spec.items() if op != "path"})
        else:
            out[key] = spec
    return out


def metadata_column(path: str | list[str], schema: dict) -> str | None:
    ref = schema.get("properties", {}).get(steps(path)[0], {}).get("$ref")
    return METADATA_REFS.get(ref)


def compile_order(order: list[dict] | None, data: str = "data") -> list[tuple[Column, bool]]:
    """(column, ascending) of each part, ended by the version id, descending. Without parts: newest first."""
    parts: list[tuple[Column, bool]] = []
    for item in order or [{"createdAt": "desc"}]:
        (key, spec), = item.items()
        if key == "data":
            value = value_at(data, spec["path"])
            value = value.try_cast("double") if spec.get("type") in ("int", "float", "number") else value
            parts.append((value, spec.get("order", "asc") == "asc"))
        else:
            parts.append((F.col(snake(key)), spec == "asc"))
    return [*parts, (F.col("version_id"), False)]


def sort_columns(parts: list[tuple[Column, bool]]) -> list[Column]:
    """Missing values are larger than all others: last if ascending, first if descending."""
    return [c.asc_nulls_last() if up else c.desc_nulls_first() for c, up in parts]


def canonical(data: Column | str) -> Column:
    """JSON text with sorted keys, for comparing and hashing."""
    return F.to_json(F.parse_json(data))


def schema_type(schema: dict) -> str:
    """Spark type of a JSON schema, as DDL."""
    if "$ref" in schema:
        if schema["$ref"] == "File":
            return "struct<status:string,fileId:string,url:string,fileName:string,hash:string,extension:string,mimeType:string,size:double,width:double,height:double>"
        return "string"
    kind = schema.get("type")
    if kind == "object":
        return "struct<" + ",".join(f"`{k}`:{schema_type(v)}" for k, v in schema["properties"].items()) + ">"
    if kind == "array":
        return f"array<{schema_type(schema['items'])}>"
    return {"string": "string", "number": "double", "boolean": "boolean"}[kind]


def _opened(schema: dict, path: list[str]) -> str:
    """Type of a document in which only a path is taken apart; all else stays as it is, as a variant."""
    if not path:
        return "string"
    if path[0] == "*":
        return f"array<{_opened(schema['items'], path[1:])}>"
    return "struct<" + ",".join(f"`{k}`:{_opened(v, path[1:]) if k == path[0] else 'variant'}" for k, v in schema["properties"].items()) + ">"


def rewritten(data: Column | str, schema: dict, path: str | list[str], f) -> Column:
    """Documents of a schema with f applied to the text at a path, or to each of them ("*" for array elements)."""
    parts = steps(path)

    def walk(c: Column, rest: list[str]) -> Column:
        if not rest:
            return f(c)
        if rest[0] == "*":
            return F.transform(c, lambda x: walk(x, rest[1:]))
        return c.withField(f"`{rest[0]}`", walk(c[rest[0]], rest[1:]))

    return F.to_json(walk(F.from_json(F.col(data) if isinstance(data, str) else data, _opened(schema, parts)), parts))


def with_target(schema: dict, old: str, new: str) -> dict:
    """The schema with all foreign keys to one table pointing to another."""
    out = dict(schema)
    if out.get("foreignKey") == old:
        out["foreignKey"] = new
    if "properties" in out:
        out["properties"] = {k: with_target(v, old, new) for k, v in out["properties"].items()}
    if "items" in out:
        out["items"] = with_target(out["items"], old, new)
    return out


def ref_paths(schema: dict, wanted: str, at: tuple[str, ...] = ()) -> list[list[str]]:
    """Every path whose schema is a $ref to `wanted`; "*" for array elements."""
    if schema.get("$ref") == wanted:
        return [list(at)]
    if schema.get("type") == "object":
        return [p for k, v in schema["properties"].items() for p in ref_paths(v, wanted, (*at, k))]
    if schema.get("type") == "array":
        return ref_paths(schema["items"], wanted, (*at, "*"))
    return []


def foreign_key_paths(schema: dict, at: tuple[str, ...] = ()) -> list[tuple[list[str], str]]:
    """Every path with a foreign key, and the table that it refers to."""
    if "foreignKey" in schema:
        return [(list(at), schema["foreignKey"])]
    if schema.get("type") == "object":
        return [p for k, v in schema["properties"].items() for p in foreign_key_paths(v, (*at, k))]
    if schema.get("type") == "array":
        return foreign_key_paths(schema["items"], (*at, "*"))
    return []
