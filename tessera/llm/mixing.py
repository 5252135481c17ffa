"""Mixing sources to target weights by hierarchical token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import WORD, Work, prefix_sums

LEVELS = ("domain", "lang", "source")


def source_domain(source: str = "source") -> Column:
    """A stand-in domain for tables that have none: four groups of sources, by the first digit of their MD5."""
    return F.concat(F.lit("domain"), F.translate(F.substring(F.md5(F.coalesce(F.col(source), F.lit(""))), 1, 1), "0123456789abcdef", "0000111122223333"))


def _weight(column: str, table: dict[str, float]) -> Column:
    if not table:
        return F.lit(1.0)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for name, w in table.items() for x in (name, float(w))]), F.col(column).cast("string")), F.lit(1.0))


def budgets(leaves: DataFrame, target: float, weights: dict[str, dict[str, float]], max_epochs: int) -> DataFrame:
    """Token budget of each leaf (domain, lang, source, tokens).

    From the root down, a node's budget is filled into its children like water in proportion to their weights: child i
    gets min(c_i, m * w_i), where c_i is what its subtree can give (tokens times max_epochs). What a child can't use
    goes to its siblings; it is left to the ancestors only if all siblings are full, since a node never gets more than
    its own subtree can give. With children in the order of c / w, the level m is the largest
    (budget - capacity of earlier ones) / (weight of this and later ones), so one window a level does it. Budgets are
    rounded down to whole tokens at each level. Weights default to 1; a weight of 0 gives nothing.
    """
    w = leaves.withColumn("capacity", F.col("tokens") * F.lit(max_epochs))
    for i, level in enumerate(LEVELS):
        up, here = list(LEVELS[:i]), list(LEVELS[: i + 1])
        nodes = w.groupBy(*here, *(["parent"] if i else [])).agg(F.sum("capacity").alias("c")) if i < 2 else w.withColumnRenamed("capacity", "c")
        if not i:
            nodes = nodes.withColumn("parent", F.lit(int(target)).cast("long"))
        nodes = nodes.withColumn("w", _weight(level, weights.get(level, {})))
        order = Window.partitionBy(*up).orderBy(F.col("w") <= 0, (F.col("c") / F.when(F.col("w") > 0, F.col("w"))).asc_nulls_last(), F.col(level).asc_nulls_first())
        earlier, later = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
        rest = F.when(F.col("w") > 0, F.sum("w").over(later))
        level_m = F.max(F.col("m")).over(Window.partitionBy(*up))
        nodes = nodes.withColumn("m", (F.col("parent") - F.coalesce(F.sum("c").over(earlier), F.lit(0))) / rest)
        nodes = nodes.withColumn("budget", F.greatest(F.lit(0), F.least(F.col("c"), F.floor(F.coalesce(level_m, F.lit(0.0)) * F.col("w") + F.lit(1e-6)))).cast("long"))
        if i < 2:
            on = [F.col(f"w.{k}").eqNullSafe(F.col(f"n.{k}")) for k in here]
            w = w.drop("parent").alias("w").join(nodes.select(*here, F.col("budget").alias("parent")).alias("n"), on).select("w.*", "n.parent")
        else:
            return nodes.select(*LEVELS, "tokens", "budget")


def mix(
    docs: DataFrame,
    domain: Column | None = None,
    weights: dict[str, dict[str, float]] | None = None,
    target_share: float = 0.5,
    max_epochs: int = 2,
    seed: int = 17,
    keep: list[str] | None = None,
) -> DataFrame:
    """The documents drawn for a mixture of `target_share` times all tokens, with how many copies of each are drawn.

    Tokens are words. Each leaf (domain, lang, source) has a budget (see `budgets`); its stream is one seeded order of
    its documents after another, epoch by epoch, and the prefix of the stream that fits the budget is drawn: every
    document floor(budget / tokens) times, and those at the head of the next epoch's order once more, as long as the
    running total stays within the budget. A null domain, lang or source is a value of its own. Texts without words
    cost nothing and come as often as the stream reaches them; a leaf without tokens gives nothing. Rows with the same
    id are separate documents, in an order by their text's hash; full duplicates are interchangeable. An empty table
    gives no rows. Texts may be of any length. Columns: doc_id, domain, lang, source, n_tokens, leaf_tokens, leaf_budget,
    copies; with `keep`, those columns (of any names, but a column `copies` is replaced) and copies.

    Leaf totals are a small table that is joined by shuffling unless Spark finds it small; prefix sums come from global
    range partitions, so a leaf with a third of all rows is split.
    """
    work = Work(docs.sparkSession, "mix")
    rows = docs.select(
        "doc_id", (domain if domain is not None else source_domain()).alias("domain"), "lang", "source",
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"), F.xxhash64("text").alias("text_hash"),
    )
    rows = work.write(rows, "rows")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    target = float(rows.agg(F.sum("n_tokens")).first()[0] or 0) * target_share
    plan = work.write(budgets(leaves, target, weights or {}, max_epochs).filter("budget > 0 and tokens > 0"), "plan")
    plan = plan.withColumn("whole", F.floor(F.col("budget") / F.col("tokens")).cast("long")).withColumn("leaf", F.xxhash64(*LEVELS))
    # leaves are told apart by all three names; `leaf` only sorts them together
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"p.{k}")) for k in LEVELS]
    drawn = rows.alias("r").join(plan.alias("p"), on).select("r.*", "p.tokens", "p.budget", "p.whole", "p.leaf")
    drawn = drawn.withColumn("at", F.xxhash64(F.lit(seed), "whole", "doc_id", "text_hash"))
    drawn = prefix_sums(work, drawn, ["leaf", "at", "doc_id", "text_hash"], "n_tokens", within="leaf")
    rest = F.col("budget") - F.col("whole") * F.col("tokens")
    more = (F.col("before") + F.col("n_tokens") <= rest) & (rest > 0)
    out = drawn.withColumn("copies", F.col("whole") + more.cast("long")).filter("copies > 0")
    out = out.select("doc_id", *LEVELS, "n_tokens", F.col("tokens").alias("leaf_tokens"), F.col("budget").alias("leaf_budget"), "copies", "text_hash")
    if not keep:
        return out.drop("text_hash")
    # equal rows get one count, so that the join below doesn't multiply them
    keep = [c for c in keep if c != "copies"]
    counts = out.groupBy("doc_id", "text_hash", "lang", "source").agg(F.max("copies").alias("copies"))
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"c.{k}")) for k in ("doc_id", "text_hash", "lang", "source")]
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "lang", "source", F.struct(F.lit(0).alias("_"), *[F.col(f"`{k}`") for k in keep]).alias("own"))
    return rows.alias("d").join(counts.alias("c"), same).select(*[F.col("d.own").getField(k).alias(k) for k in keep], "c.copies")
