"""Quality rules whose cutoffs are certified on labelled documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.llm.common import Work, mix, owners, slices, views, words_of

SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")

#: rule: (score, cutoffs tried from the strictest on); a document fails if its score is above the cutoff
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5)),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8)),
    "repeat_words": ("n_repeat_words / greatest(n_words, 1)", (0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.45)),
    "upper": ("n_upper / greatest(n_letters, 1)", (0.2, 0.3, 0.4, 0.5, 0.6, 0.8, 0.9)),
    "long_words": ("word_chars / greatest(n_words, 1)", (8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 40.0)),
}


def count_words(batch: pa.RecordBatch, text: str) -> list[np.ndarray]:
    """COUNTS of each row."""
    column = batch.column(text)
    buf, at = views(column)
    words, ids, ends = words_of(column)
    n = len(at) - 1

    def per_row(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[at])

    table = np.zeros((256, 5), bool)
    table[:, 0] = (np.arange(256) & 0xC0) != 0x80
    table[[0x20, *range(9, 14)], 1] = True
    table[list(SYMBOLS), 2] = True
    table[ord("A") : ord("Z") + 1, 3] = True
    table[ord("A") : ord("Z") + 1, 4] = table[ord("a") : ord("z") + 1, 4] = True
    points, blanks, symbols, upper, letters = (per_row(table[buf, i]) for i in range(5))

    repeat = np.zeros(n, np.int64)
    if len(ids) > 2:
        row = owners(ends)
        k = ids.astype(np.uint64)
        wide = np.uint64(len(words) + 1)
        # the first two words are told apart exactly; the third and the row come in through a 64-bit mixer
        key = mix(mix(k[:-2] * wide + k[1:-1]) + mix(k[2:] + (row[:-2].astype(np.uint64) << np.uint64(32))))
        inside = row[:-2] == row[2:]
        order = np.argsort(key, kind="stable")
        s = key[order]
        same = s[1:] == s[:-1]
        twice = np.zeros(len(key), bool)
        # windows at the ends of rows are no windows
        ok = inside[order]
        run = np.concatenate([[0], np.cumsum(~same)])
        twice[order] = np.bincount(run, weights=ok)[run] > 1
        twice &= inside
        covered = np.zeros(len(ids), bool)
        for d in range(3):
            covered[d : d + len(twice)] |= twice
        repeat = np.diff(np.concatenate([[0], np.cumsum(covered)])[ends])

    lines, dup = np.zeros(n, np.int64), np.zeros(n, np.int64)
    whole = buf.tobytes()
    for i in range(n):
        got = [x for x in whole[at[i] : at[i + 1]].split(b"\n") if x and not x.isspace()]
        lines[i], dup[i] = len(got), len(got) - len(set(got))
    return [np.diff(ends), points - blanks, symbols, dup, repeat, lines, upper, letters]


def with_counts(docs: DataFrame, keep: list[Column], text: str = "text") -> DataFrame:
    """The columns `keep` and COUNTS, of whole texts. A null text has no words. No kept column may be named like a count."""
    rows = docs.select(*keep, F.col(text).cast("binary").alias("_text"))
    fields = rows.schema.fields[:-1]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "_text"):
                got = count_words(part, "_text")
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *(pa.array(x.astype(np.int64)) for x in got)], names=[*names, *COUNTS])

    return rows.mapInArrow(run, StructType([*fields, *(StructField(c, LongType()) for c in COUNTS)]))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p)."""
    if k >= n:
        return 1.0
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])
    i = np.arange(k + 1)
    return float(np.exp(logs[n] - logs[i] - logs[n - i] + i * np.log(p) + (n - i) * np.log1p(-p)).sum())


def certified(k: int, n: int, limit: float, delta: float) -> bool:
    """Whether the exact (Clopper-Pearson) upper bound for k of n, at confidence 1 - delta, is at most `limit`."""
    return n > 0 and binomial_cdf(k, n, limit) <= delta


def fit_cutoffs(counts: DataFrame, labels: DataFrame, max_false_rejection: float = 0.05, delta: float = 0.05) -> dict[str | None, dict[str, float]]:
    """For each stratum, the strictest certified cutoff of each rule; rules without one are left out.

    Good labelled documents that pass the base rules are the holdout. Equal texts of a stratum count as one document, as
    the bound is for independent ones; with several labels it is good if all of them say so. Null labels don't count. A
    cutoff is certified if, among them, the exact binomial upper bound of the share that it rejects is at most
    max_false_rejection / rules, so that all rules together stay within max_false_rejection. The bounds hold for all
    strata, rules and cutoffs at once with probability 1 - delta (Bonferroni). Strata too small to certify any cutoff
    are not fetched.
    """
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    texts = counts.filter(~base_failed()).join(known, "doc_id").groupBy("stratum", "text_hash").agg(F.min("quality").alias("quality"), *[F.max(c).alias(c) for c in COUNTS])
    sums = [F.sum((F.expr(score) > cut).cast("long")).alias(f"{rule}_{i}") for rule, (score, cuts) in RULES.items() for i, cut in enumerate(cuts)]
    table = texts.filter("quality = 1").groupBy("stratum").agg(F.count("*").alias("n"), *sums).persist()
    strata = table.count()
    if not strata:
        table.unpersist()
        return {}
    limit, level = max_false_rejection / len(RULES), delta / (strata * len(sums))
    least = int(np.ceil(np.log(level) / np.log1p(-limit)))
    out: dict[str | None, dict[str, float]] = {}
    for r in table.filter(F.col("n") >= least).collect():
        for rule, (_, cuts) in RULES.items():
            for i, cut in enumerate(cuts):
                if certified(r[f"{rule}_{i}"], r["n"], limit, level):
                    out.setdefault(r["stratum"], {})[rule] = cut
                    break
    table.unpersist()
    return out


def with_verdict(counts: DataFrame, cutoffs: dict[str | None, dict[str, float]]) -> DataFrame:
    """counts with `passes`: whether a row passes all rules of its stratum; rows of a stratum without cutoffs pass."""
    if not cutoffs:
        return counts.withColumn("passes", F.lit(True))
    kind = counts.schema["stratum"].dataType.simpleString()
    table = counts.sparkSession.createDataFrame([(name, *(cuts.get(rule) for rule in RULES)) for name, cuts in cutoffs.items()], f"of {kind}, " + ", ".join(f"cut_{rule} double" for rule in RULES))
    bad = F.lit(False)
    for rule, (score, _) in RULES.items():
        bad = bad | F.coalesce(F.expr(score) > F.col(f"cut_{rule}"), F.lit(False))
    # rows that the driver holds, one for a stratum with enough labelled documents
    return counts.join(F.broadcast(table), F.col("stratum").eqNullSafe(F.col("of")), "left").withColumn("passes", ~bad)


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", keep: list[str] | None = None, **options) -> DataFrame:
    """Counts, base verdict and final verdict of every document.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, then the rules'
    other counts (capitals and letters are those of ASCII) and those in `keep`, but for names of results. Null and empty
    texts have no words and fail. An empty table gives no rows; with no labels only the base rules hold. Rows with the
    same id are judged each by its own text. Texts may be of any length, and columns have any names.
    """
    work = Work(docs.sparkSession, "quality")
    keep = [c for c in keep or [] if c not in ("doc_id", *COUNTS, "base_failed", "kept")]
    own = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in keep]).alias("own")
    own_keys = [F.col("doc_id"), F.col(f"`{stratum}`").alias("stratum"), F.xxhash64("text").alias("text_hash")]
    counts = work.write(with_counts(docs, own_keys), "counts")
    cutoffs = fit_cutoffs(counts, labels, **options)
    # kept columns may be as large as the table: the words are counted again rather than written with them
    counts = with_verdict(with_counts(docs, [*own_keys, own]) if keep else counts, cutoffs)
    failed = base_failed()
    return counts.select("doc_id", *COUNTS[:5], failed.alias("base_failed"), (~failed & F.col("passes")).alias("kept"), *COUNTS[5:], *[F.col("own").getField(c).alias(c) for c in keep])


#: The same rows elsewhere; exact binomial sums are taken over logarithms of factorials.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT rid, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT rid, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM p WINDOW o AS (PARTITION BY rid ORDER BY i)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM g WHERE c IS NOT NULL) AS x WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM twice) AS x GROUP BY rid),
n AS (SELECT d.rid, doc_id, lang, t, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
      len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, len(ls) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters
      FROM d JOIN w USING (rid) LEFT JOIN covered USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM n),
rule AS (@rules),
good AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
held AS (SELECT * FROM (SELECT lang, t, min(good.quality) AS quality, any_value(f) AS f FROM f JOIN good USING (doc_id) WHERE NOT base_failed GROUP BY lang, t) AS x WHERE quality = 1),
tried AS (SELECT h.lang, r.rule, r.place, r.cut, count(*) AS n, count(*) FILTER (@score > r.cut) AS k FROM (SELECT lang, unnest(f) FROM held) AS h (lang, @columns) CROSS JOIN rule r GROUP BY ALL),
sure AS (SELECT *, CASE WHEN k >= n THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.01) + (n - i) * ln(0.99)))) END <= 0.05 / ((SELECT count(DISTINCT coalesce(lang, '?')) FROM held) * (SELECT count(*) FROM rule)) AS ok FROM tried),
cuts AS (SELECT lang, rule, arg_min(cut, place) AS cut FROM sure WHERE ok GROUP BY lang, rule),
bad AS (SELECT DISTINCT h.rid FROM f h JOIN cuts r ON h.lang IS NOT DISTINCT FROM r.lang WHERE @score > r.cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rid NOT IN (SELECT rid FROM bad) AS kept, n_lines, n_upper, n_letters FROM f
"""
SQL = SQL.replace("@rules", " UNION ALL ".join(f"SELECT '{rule}' AS rule, {i} AS place, {cut} AS cut" for rule, (_, cuts) in RULES.items() for i, cut in enumerate(cuts)))
SQL = SQL.replace("(SELECT lang, unnest(f) FROM held) AS h (lang, @columns)", "(SELECT lang, " + ", ".join(f"f.{c} AS {c}" for c in COUNTS) + " FROM held) AS h")
SQL = SQL.replace("@score", "CASE r.rule " + " ".join(f"WHEN '{rule}' THEN {score}" for rule, (score, _) in RULES.items()) + " END")
