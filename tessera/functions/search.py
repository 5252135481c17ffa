"""Full-text conditions over documents, and matches with scores."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOKEN = r"[\p{L}\p{N}]+"
SPLIT = r"[\s_-]+"
# Fixed values of the relevance score.
EXACT, STARTS, CONTAINS, LENGTH_BONUS, PRIMITIVE, MOST_MATCHES = 100, 50, 10, 20, 30, 5


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _begins(word: str):
    return lambda t: t.startswith(word)


def _holds(word: str):
    return lambda t: t.contains(word)


def json_values(data: Column) -> Column:
    """All texts, numbers and booleans of a document as one text, keys left out: members are told by the colon that
    follows them."""
    bare = F.regexp_replace(data, r'"(?:[^"\\]|\\.)*"\s*:', " ")
    return F.regexp_replace(bare, r"[{}\[\],]", " ")


def search_column(values: Column, query: str, kind: str = "plain") -> Column:
    """plain: all words; phrase: the words in a row; prefix: words that begin so; tsquery: & | ! and :* with brackets."""
    have = tokens(values)
    words = re.findall(r"[^\W_]+", query.lower())
    if kind == "tsquery":
        return _Tsquery(query, have).parse()
    if not words:
        return F.lit(False)
    if kind == "plain":
        return F.size(F.array_intersect(have, F.array(*map(F.lit, dict.fromkeys(words))))) == len(set(words))
    if kind == "phrase":
        return F.concat(F.lit(" "), F.array_join(have, " "), F.lit(" ")).contains(" " + " ".join(words) + " ")
    if kind == "prefix":
        out = F.lit(True)
        for w in words:
            out = out & F.exists(have, _begins(w))
        return out
    raise ValueError(f"unknown search {kind!r}")


class _Tsquery:
    """expr: term (| term)*; term: factor (& factor)*; factor: ! factor, (expr), word, word:*"""

    def __init__(self, text: str, have: Column):
        self.items, self.have, self.i = re.findall(r"[&|!()]|[^\W_]+(?::\*)?", text.lower()), have, 0

    def parse(self) -> Column:
        out = self.some("|", lambda: self.some("&", self.factor, lambda a, b: a & b), lambda a, b: a | b)
        if self.i < len(self.items):
            raise ValueError("unexpected " + self.items[self.i])
        return out

    def some(self, sign: str, part, both) -> Column:
        out = part()
        while self.i < len(self.items) and self.items[self.i] == sign:
            self.i += 1
            out = both(out, part())
        return out

    def factor(self) -> Column:
        if self.i >= len(self.items):
            raise ValueError("query ends early")
        x = self.items[self.i]
        self.i += 1
        if x == "!":
            return ~self.factor()
        if x == "(":
            out = self.some("|", lambda: self.some("&", self.factor, lambda a, b: a & b), lambda a, b: a | b)
            self.i += 1
            return out
        return F.exists(self.have, _begins(x[:-2])) if x.endswith(":*") else F.array_contains(self.have, x)


def leaves(rows: DataFrame, key: str = "version_id", data: str = "data") -> DataFrame:
    """One row for each leaf of each document: key, path (a.b[0]), value as text, primitive. Nulls are left out."""

    def walk(x, path: str) -> Iterator[tuple[str, str, bool]]:
        if isinstance(x, dict):
            for k, v in x.items():
                yield from walk(v, f"{path}.{k}" if path else k)
        elif isinstance(x, list):
            for i, v in enumerate(x):
                yield from walk(v, f"{path}[{i}]")
        elif isinstance(x, str):
            yield path or "data", x, False
        elif x is not None:
            yield path or "data", json.dumps(x), True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(k, *leaf) for k, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if d for leaf in walk(json.loads(d), "")]
            cols = list(zip(*out, strict=True)) if out else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.bool_())], names=["key", "path", "value", "primitive"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, data).mapInArrow(run, f"key {kind}, path string, value string, primitive boolean")


def score(value: Column, primitive: Column, query: str) -> Column:
    """Relevance of a leaf; null if no word of the query is in it."""
    wanted = [t for t in re.split(SPLIT, query.lower()) if t]
    have = F.filter(F.split(F.lower(value), SPLIT), lambda t: t != "")
    hit, every, starts = F.lit(False), F.lit(True), F.lit(False)
    whole = F.lit(False)
    for t in wanted:
        hit = hit | F.exists(have, _holds(t))
        every = every & F.array_contains(have, t)
        starts = starts | F.exists(have, _begins(t))
        whole = whole | F.lower(value).contains(t)
    base = F.when(every, EXACT).when(starts, STARTS).otherwise(CONTAINS) + F.greatest(F.lit(0), F.lit(LENGTH_BONUS) - F.length(value))
    return F.when(primitive & whole, F.lit(PRIMITIVE)).when(~primitive & hit, base)


def highlight(value: Column, query: str) -> Column:
    """The value with the query's words marked, one word after another."""
    for t in (t for t in re.split(SPLIT, query.lower()) if t):
        value = F.regexp_replace(value, "(?i)(" + re.sub(r"[.*+?^${}()|\[\]\\]", lambda m: "\\" + m[0], t) + ")", "<mark>$1</mark>")
    return value


def matches(found: DataFrame, query: str) -> DataFrame:
    """The five most relevant leaves of each document: key, path, value, highlight, relevance."""
    x = found.withColumn("relevance", score(F.col("value"), F.col("primitive"), query)).filter("relevance is not null")
    best = Window.partitionBy("key").orderBy(F.desc("relevance"), "path")
    x = x.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= MOST_MATCHES)
    return x.select("key", "path", "value", highlight(F.col("value"), query).alias("highlight"), "relevance")
