"""Computed parts of rows: a chain of transforms in a fixed order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.jsonpath import METADATA_REFS, schema_type, snake

Transform = Callable[[DataFrame], DataFrame]
ORDER = ("rowId", "createdId", "versionId", "createdAt", "publishedAt", "updatedAt", "formula", "hash", "schemaHash", "file")


class Plugin:
    """Hooks of one plugin on rows with a typed document column; each gives the rows back. By default nothing happens."""

    name = ""

    def after_create(self, rows: DataFrame, column: str, schema: dict) -> DataFrame:
        return rows

    def after_update(self, rows: DataFrame, column: str, schema: dict) -> DataFrame:
        return rows

    def compute(self, rows: DataFrame, column: str, schema: dict) -> DataFrame:
        return rows

    def after_migrate(self, rows: DataFrame, column: str, schema: dict) -> DataFrame:
        return rows


class Metadata(Plugin):
    """One kind of fields that stand for a column of the row: empty when written, filled when read."""

    def __init__(self, name: str):
        self.name, self.ref = name, "Row" + name[0].upper() + name[1:] if name != "rowId" else "RowId"

    def _fields(self, schema: dict) -> list[str]:
        return [k for k, sub in schema["properties"].items() if sub.get("$ref") == self.ref]

    def _emptied(self, rows: DataFrame, column: str, schema: dict) -> DataFrame:
        for k in self._fields(schema):
            rows = rows.withColumn(column, F.col(column).withField(f"`{k}`", F.lit("")))
        return rows

    def after_create(self, rows: DataFrame, column: str, schema: dict) -> DataFrame:
        return self._emptied(rows, column, schema)

    after_update = after_migrate = after_create

    def compute(self, rows: DataFrame, column: str, schema: dict) -> DataFrame:
        mine = set(self._fields(schema))
        return fill_metadata(rows, column, {"properties": {k: v for k, v in schema["properties"].items() if k in mine}}) if mine else rows


class Formulas(Plugin):
    """Fields with `x-formula`: computed when read, at their defaults when written."""

    name = "formula"

    @staticmethod
    def of(schema: dict) -> dict[str, str]:
        made = {k: sub["x-formula"] for k, sub in schema["properties"].items() if "x-formula" in sub}
        return {k: f["expression"] if isinstance(f, dict) else f for k, f in made.items()}

    def after_create(self, rows: DataFrame, column: str, schema: dict) -> DataFrame:
        from tessera.functions.schema import default_of

        for k in self.of(schema):
            rows = rows.withColumn(column, F.col(column).withField(f"`{k}`", default_of(schema["properties"][k])))
        return rows

    after_update = after_migrate = after_create

    def compute(self, rows: DataFrame, column: str, schema: dict) -> DataFrame:
        from tessera.functions import formula

        made = self.of(schema)
        return formula.compute(rows, column, made, {k: schema["properties"][k].get("default", 0.0) for k in made}) if made else rows


class Files(Plugin):
    """Addresses of uploaded files: filled when read, empty when written."""

    name = "file"

    def __init__(self, prefix: str):
        self.prefix = prefix

    def _each(self, rows: DataFrame, column: str, schema: dict, url: Callable[[Column], Column]) -> DataFrame:
        for k, sub in schema["properties"].items():
            f = F.col(column)[k]
            if sub.get("$ref") == "File":
                rows = rows.withColumn(column, F.col(column).withField(f"`{k}`", f.withField("url", url(f))))
            elif sub.get("type") == "array" and sub["items"].get("$ref") == "File":
                rows = rows.withColumn(column, F.col(column).withField(f"`{k}`", F.transform(f, lambda x: x.withField("url", url(x)))))
        return rows

    def after_create(self, rows: DataFrame, column: str, schema: dict) -> DataFrame:
        return self._each(rows, column, schema, lambda _: F.lit(""))

    after_update = after_migrate = after_create

    def compute(self, rows: DataFrame, column: str, schema: dict) -> DataFrame:
        return self._each(rows, column, schema, lambda f: file_url(f, self.prefix))


def standard(prefix: str = "") -> list[Plugin]:
    return [*(Metadata(n) for n in ORDER if n not in ("formula", "file")), Formulas(), Files(prefix)]


def run(hook: str, plugins: list[Plugin], rows: DataFrame, column: str, schema: dict) -> DataFrame:
    """The rows through one hook of all plugins, in the fixed order whatever the order given."""
    for p in sorted(plugins, key=lambda p: ORDER.index(p.name)):
        rows = getattr(p, hook)(rows, column, schema)
    return rows


def computed(rows: DataFrame, schema: dict, plugins: list[Plugin]) -> DataFrame:
    """Rows with their documents typed as `d` and computed, and `formula_errors`."""
    typed = rows.withColumn("d", F.from_json("data", schema_type(schema)))
    out = run("compute", plugins, typed, "d", schema)
    return out if "formula_errors" in out.columns else out.withColumn("formula_errors", F.array().cast("array<string>"))


def chain(rows: DataFrame, plugins: dict[str, Transform]) -> DataFrame:
    """The rows through the given transforms, in the fixed order whatever the order given."""
    for name in ORDER:
        if name in plugins:
            rows = rows.transform(plugins[name])
    return rows


def iso(ms: Column) -> Column:
    """Milliseconds since 1970 as an ISO text in UTC."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def fill_metadata(rows: DataFrame, column: str, schema: dict) -> DataFrame:
    """Fields that refer to row metadata, which are stored empty, from the physical columns."""
    d = F.col(column)
    for name, sub in schema["properties"].items():
        physical = METADATA_REFS.get(sub.get("$ref", ""))
        if physical:
            value = F.col(snake(physical))
            d = d.withField(name, iso(value) if physical.endswith("At") else value)
    return rows.withColumn(column, d)


def published_at(fields: list[Column], stored: Column) -> Column:
    """The first value given by a field, else what is stored."""
    return F.coalesce(*[F.nullif(f, F.lit("")) for f in fields], stored)


def file_url(file: Column, prefix: str) -> Column:
    """Address of an uploaded file by its hash; empty for others."""
    return F.when((file["status"] == "uploaded") & (file["hash"] != ""), F.concat(F.lit(prefix), F.url_encode(file["hash"]))).otherwise(F.lit(""))
