"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Only DataFrame functions are used. Items are partitioned by their number of shingles. In the partition of size u, each
item is indexed by its K = floor((1 - t) u) + 1 smallest shingle hashes (a bottom-K MinHash sketch). An item whose
containment in a document is at least t misses at most (1 - t) u of its shingles there, so at least one of its K minima
is among the document's shingles. A fixed number of minima of a long document would hardly ever be an item's, so a
document's sketch is cut by value: its shingles with hashes up to the largest minimum of any partition. The search
loses nothing, however long the document. What it finds is verified on the shingles themselves, not on hashes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Work

SHINGLE, PERCENT = 5, 80
#: Up to so many index entries, and shingles of all items, go into the plan as constants; beyond that, tables are joined.
#: The result is the same.
MOST_CONSTANTS = {"index": 4096, "shingles": 65536}


def words(text: Column) -> Column:
    """Lower-cased runs of letters, marks and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def with_value(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where the value is computed once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def hashes(h: Column, k: int) -> Column:
    """Hashes of every k consecutive words, out of the words' hashes."""
    return F.when(F.size(h) >= k, F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def shingles(w: Column, k: Column) -> Column:
    """The distinct runs of k consecutive words, each joined by spaces."""
    return F.when(F.size(w) >= k, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.array_join(F.slice(w, i, k), " ")))).otherwise(F.array().cast("array<string>"))


def minima(size: Column, percent: int) -> Column:
    """K for the partition of items with so many shingles."""
    return F.least(size, F.floor(F.lit(100 - percent) * size / 100).cast("int") + 1)


def _kept(df: DataFrame, column: Column, name: str) -> DataFrame:
    """df with a column that comes out of a generator, so that filters on it stay above and it is computed once."""
    return df.select("*", F.explode_outer(F.array(column)).alias(name))


def _prepared(benchmark: DataFrame, shingle: int, percent: int) -> DataFrame:
    """uid, item_id, words (joined by spaces), len (words in a shingle), n_item, minima (hashes in order) of items with words."""
    items = _kept(benchmark.select("item_id", words(F.col("text")).alias("w")), F.col("w"), "word").filter(F.size("word") > 0)
    items = items.select("item_id", "word", F.transform("word", lambda w: F.xxhash64(w)).alias("h"), F.least(F.size("word"), F.lit(shingle)).alias("len"))
    of_len = F.coalesce(*[F.when(F.col("len") == k, hashes(F.col("h"), k)) for k in range(1, shingle + 1)])
    items = _kept(items, F.sort_array(F.array_distinct(of_len)), "s")
    return items.select(F.monotonically_increasing_id().alias("uid"), "item_id", F.array_join("word", " ").alias("words"), "len", F.size("s").alias("n_item"), F.slice("s", F.lit(1), minima(F.size("s"), percent)).alias("minima"))


def _sketch(text: Column, bounds: dict[int, int]) -> Column:
    """Hashes of the text's shingles of each length, up to the bound of that length."""
    def upto(bound: int) -> Callable[[Column], Column]:
        return lambda s: s <= F.lit(bound)

    def of(h: Column) -> Column:
        return F.array_distinct(F.concat(*[F.filter(hashes(h, k), upto(b)) for k, b in sorted(bounds.items())]))

    return with_value(F.transform(words(text), lambda w: F.xxhash64(w)), of)


def _shared(item_words: Column, k: Column, doc: Column) -> Column:
    """n_shared and n_item of an item and the distinct shingles of a document."""
    return with_value(shingles(F.split(item_words, " "), k), lambda s: F.struct(F.size(F.array_intersect(s, doc)).alias("n_shared"), F.size(s).alias("n_item")))


def _enough(n_shared: Column, n_item: Column, percent: int) -> Column:
    return F.lit(100) * n_shared >= F.lit(percent) * n_item


def matches(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, most: dict[str, int] | None = None) -> DataFrame:
    """`doc` (all columns of every document, as one struct) and `items`: an array of (item_id, n_shared, n_item), empty
    for clean documents.

    An item counts if 100 * shared shingles >= percent * its distinct shingles. Words are lower-cased runs of letters,
    marks and digits; an item of fewer words than a shingle counts as one shingle of all its words. Null and empty texts match
    nothing, on either side. Items that repeat are found each by its own item_id, which may be null; repeated documents
    each get their items. An empty benchmark leaves all clean, an empty table gives no rows. Columns of the documents
    may have any names; texts may be of any length.
    """
    most = most or MOST_CONSTANTS
    items = Work(docs.sparkSession, "decontaminate").write(_prepared(benchmark, shingle, percent), "items")
    kind = f"array<struct<item_id:{benchmark.schema['item_id'].dataType.simpleString()},n_shared:int,n_item:int>>"
    # one row a shingle length
    bounds = {r["len"]: r["b"] for r in items.groupBy("len").agg(F.max(F.element_at("minima", -1)).alias("b")).collect()}
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    if not bounds:
        return rows.select("doc", F.array().cast(kind).alias("items"))
    n_index, n_shingles = items.agg(F.sum(F.size("minima")), F.sum("n_item")).first()
    if n_index <= most["index"] and n_shingles <= most["shingles"]:
        return _by_constants(rows, items.orderBy("uid").collect(), bounds, percent, kind)
    return _by_joins(rows, items, bounds, percent, kind)


def _by_constants(rows: DataFrame, items: list, bounds: dict[int, int], percent: int, kind: str) -> DataFrame:
    """A bounded benchmark: one pass over the documents, without a shuffle."""
    index: dict[int, list[int]] = {}
    for i, r in enumerate(items):
        for s in r["minima"]:
            index.setdefault(s, []).append(i)

    def array(values, kind: str) -> Column:
        return F.from_json(F.lit("[" + ",".join(map(str, values)) + "]"), f"array<{kind}>")

    keys = sorted(index)
    lists = array([index[k] for k in keys], "array<int>")
    texts, lens, ids = F.array(*[F.lit(r["words"]) for r in items]), array([r["len"] for r in items], "int"), F.array(*[F.lit(r["item_id"]) for r in items])
    text, n = F.col("doc.text"), [F.lit(k) for k in sorted(bounds)]
    df = _kept(rows, F.array_intersect(_sketch(text, bounds), array(keys, "bigint")), "hits")
    found = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.get(lists, (F.array_position(array(keys, "bigint"), h) - 1).cast("int")))))
    df = _kept(df, F.when(F.size("hits") > 0, found), "found")
    df = _kept(df, F.when(F.size("found") > 0, with_value(words(text), lambda w: F.concat(*[shingles(w, k) for k in n]))), "own")
    exact = F.transform("found", lambda i: with_value(_shared(F.get(texts, i), F.get(lens, i), F.col("own")), lambda x: F.struct(F.get(ids, i).alias("item_id"), x["n_shared"].alias("n_shared"), x["n_item"].alias("n_item"))))
    kept = F.filter(exact, lambda x: _enough(x["n_shared"], x["n_item"], percent))
    return _kept(df.select("doc", "hits", "found", "own"), F.when(F.size("found") > 0, kept).otherwise(F.array()).cast(kind), "items").select("doc", "items")


def _by_joins(rows: DataFrame, items: DataFrame, bounds: dict[int, int], percent: int, kind: str) -> DataFrame:
    """A benchmark of any size: sketches meet the index by a shuffled join, and only candidates are verified."""
    key = [F.xxhash64("doc.text").alias("k1"), F.xxhash64(F.lit(1), "doc.text").alias("k2")]  # told apart by 128 bits
    sketch = rows.select(key[0], F.explode_outer(_sketch(F.col("doc.text"), bounds)).alias("s")).filter("s is not null")
    pairs = sketch.join(items.select("uid", F.explode("minima").alias("s")), "s").select("k1", "uid").distinct()
    pairs = Work(rows.sparkSession, "decontaminate").write(pairs, "pairs")
    texts = rows.select(*key, F.col("doc.text").alias("text")).join(pairs.select("k1").distinct(), "k1", "left_semi").dropDuplicates(["k1", "k2"])
    both = texts.join(pairs, "k1").join(items.select("uid", "item_id", "words", "len"), "uid")
    both = _kept(both, with_value(words(F.col("text")), lambda w: _shared(F.col("words"), F.col("len"), shingles(w, F.col("len")))), "x")
    good = both.filter(_enough(F.col("x.n_shared"), F.col("x.n_item"), percent))
    per_doc = good.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("uid", "item_id", "x.n_shared", "x.n_item"))).alias("f"))  # items of one text
    per_doc = per_doc.select("k1", "k2", F.transform("f", lambda x: F.struct(x["item_id"].alias("item_id"), x["n_shared"].alias("n_shared"), x["n_item"].alias("n_item"))).alias("f"))
    return rows.select("doc", *key).join(per_doc, ["k1", "k2"], "left").select("doc", F.coalesce("f", F.array().cast(kind)).alias("items"))


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row for each document and item found in it: doc_id, item_id, n_shared, n_item, containment."""
    found = matches(docs, benchmark, **options).select(F.col("doc.doc_id").alias("doc_id"), F.explode_outer("items").alias("x")).filter("x is not null")
    return found.select("doc_id", "x.item_id", "x.n_shared", "x.n_item", (F.col("x.n_shared") / F.col("x.n_item")).alias("containment"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents, with all their columns, in which no item is found."""
    return matches(docs, benchmark, **options).filter(F.size("items") == 0).select("doc.*")


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark),
bs AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
       ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM b),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
short AS (SELECT DISTINCT len(w) AS k FROM b WHERE len(w) BETWEEN 1 AND 4),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM d WHERE len(w) >= 5
       UNION SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM d, short WHERE len(w) >= k)
SELECT doc_id, item_id, count(*)::INT AS n_shared, any_value(n_item)::INT AS n_item, count(*) / any_value(n_item) AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING 100 * count(*) >= 80 * any_value(n_item)
"""
