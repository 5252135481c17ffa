"""Language identification: presence kernels on byte n-grams, Nystrom features, one-versus-rest kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from tessera.llm.common import slices, views

UNKNOWN = "und"
#: Bounds of the labelled sample that is fetched to the driver, for each language, and of the model: landmarks of each
#: language, and the n-grams of the kernel (those that most landmarks have).
SAMPLE_PER_LANG, LANDMARKS_PER_LANG, MAX_GRAMS = 300, 48, 8192
#: Codes of n-grams begin here for n of 1 to 3, and end here.
BEGINS, CODES = (0, 1 << 8, (1 << 8) + (1 << 16)), (1 << 8) + (1 << 16) + (1 << 24)
RIDGE, SHARPNESS = 1e-2, 6.0


def _lowered(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    parts = [(v.as_py() or b"").decode("utf-8", "replace").lower().encode() for v in batch.column("text")]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def grams(buf: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n of 1 to 3: the code of each n-gram of bytes that lies within a row, and its row."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    code = buf.astype(np.int32)
    for n in (1, 2, 3):
        if n > 1:
            code = (code[:-1] << 8) | buf[n - 1 :]
        inside = row[: len(code)] == row[n - 1 :]
        yield code[inside] + np.int32(BEGINS[n - 1]), row[: len(code)][inside]


_TABLES: dict[bytes, np.ndarray] = {}


@dataclass
class Model:
    langs: list[str]
    codes: np.ndarray  # the n-grams that count
    landmarks: np.ndarray  # landmarks x codes, rows of length 1
    weights: np.ndarray  # landmarks x langs

    def table(self) -> np.ndarray:
        """The place of each n-gram among those that count; 34 MB, made once by each Python worker."""
        key = self.codes.tobytes()
        if key not in _TABLES:
            _TABLES.clear()
            _TABLES[key] = np.full(CODES, len(self.codes), np.uint16)
            _TABLES[key][self.codes] = np.arange(len(self.codes))
        return _TABLES[key]

    def margins(self, buf: np.ndarray, at: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Rows x langs, by batched matrix products."""
        return kernel(presence(buf, at, table, len(self.codes)), self.landmarks) @ self.weights


def presence(buf: np.ndarray, at: np.ndarray, table: np.ndarray, n: int) -> np.ndarray:
    seen = np.zeros((len(at) - 1, n + 1), np.float32)
    flat, wide = seen.reshape(-1), n + 1
    for code, row in grams(buf, at):
        flat[row * wide + table[code]] = 1
    return seen[:, :n]


def kernel(seen: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """|x and l| / sqrt(|x| |l|) over presence vectors."""
    return (seen @ landmarks.T) / np.sqrt(np.maximum(seen.sum(1), 1))[:, None]


def fit(samples: list[tuple[str, np.ndarray]], langs: list[str], landmarks: int = LANDMARKS_PER_LANG, max_grams: int = MAX_GRAMS) -> Model:
    """samples: language and distinct n-gram codes of each labelled text, in a fixed order."""
    chosen: list[int] = []
    for lang in langs:
        chosen += [i for i, (x, _) in enumerate(samples) if x == lang][:landmarks]
    codes, df = np.unique(np.concatenate([samples[i][1] for i in chosen]), return_counts=True)
    codes = np.sort(codes[np.lexsort((codes, -df))][: min(max_grams, 65535)])
    seen = np.zeros((len(samples), len(codes)), np.float32)
    for i, (_, c) in enumerate(samples):
        at = np.searchsorted(codes, c)
        at = at[(at < len(codes))]
        seen[i, at[np.isin(codes[at], c)]] = 1
    marks = seen[chosen] / np.sqrt(np.maximum(seen[chosen].sum(1), 1))[:, None]
    k_mm, k_nm = kernel(seen[chosen], marks).astype(np.float64), kernel(seen, marks).astype(np.float64)
    values, vectors = np.linalg.eigh((k_mm + k_mm.T) / 2)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    z = k_nm @ root
    y = np.array([[1.0 if x == lang else -1.0 for lang in langs] for x, _ in samples])
    ridge = np.linalg.solve(z.T @ z + RIDGE * len(samples) * np.eye(z.shape[1]), z.T @ y)
    return Model(langs, codes.astype(np.int64), marks, (root @ ridge).astype(np.float32))


def sample(docs: DataFrame, trainable, per_lang: int = SAMPLE_PER_LANG) -> list[tuple[str, np.ndarray]]:
    """A seeded sample of labelled texts, at most per_lang of each language, as sets of n-gram codes."""
    rows = docs.filter(trainable & F.col("lang").isNotNull())
    draw = F.xxhash64(F.lit(11), "doc_id")
    share = rows.groupBy("lang").count().select(F.col("lang").alias("l"), F.least(F.lit(1.0), F.lit(4.0 * per_lang) / F.col("count")).alias("share"))
    picked = rows.withColumn("at", draw).join(F.broadcast(share), F.col("lang") == F.col("l"))  # one row a language
    picked = picked.filter(F.pmod("at", F.lit(1 << 40)) <= F.col("share") * F.lit(float(1 << 40))).filter(F.col("text").rlike(r"\p{L}"))
    picked = picked.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("at", "doc_id", F.xxhash64("text")))).filter(F.col("n") <= per_lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                codes = np.unique(np.concatenate([c for c, _ in grams(*_lowered(one))]))
                yield pa.RecordBatch.from_arrays([one.column("lang"), one.column("n"), pa.array([codes.tolist()], pa.list_(pa.int32()))], names=["lang", "n", "codes"])

    got = picked.select("lang", "n", F.col("text").cast("binary").alias("text")).mapInArrow(run, "lang string, n int, codes array<int>").toArrow()
    order = sorted(range(got.num_rows), key=lambda i: (got["lang"][i].as_py(), got["n"][i].as_py()))
    return [(got["lang"][i].as_py(), np.asarray(got["codes"][i].values)) for i in order]


def identify(docs: DataFrame, held_out_bucket: int = 2, buckets: int = 4, per_lang: int = SAMPLE_PER_LANG, landmarks: int = LANDMARKS_PER_LANG, max_grams: int = MAX_GRAMS, keep: list[str] | None = None) -> DataFrame:
    """Predicted language of every document, from its whole text: doc_id, held_out, lang_pred, score and those in `keep`.

    The model learns from a sample of at most `per_lang` documents of each language outside the held-out bucket (crc32 of the id's text, modulo
    `buckets`) whose lang is not null. A null text, one without a letter, or any text if nothing could be learned, is
    `und` with score 0. The score is the softmax of the regression outputs. An empty table gives no rows; a null id
    counts as the empty text. Rows that repeat are predicted alike. Kept columns may have any names; those named like a
    result are replaced.
    """
    bucket = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % buckets
    samples = sample(docs.select("doc_id", "text", "lang"), bucket != held_out_bucket, per_lang)
    langs = sorted({x for x, _ in samples})
    model = fit(samples, langs, landmarks, max_grams) if langs else None
    keep = [c for c in keep or [] if c not in ("doc_id", "held_out", "lang_pred", "score")]
    own = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in keep]).alias("own")
    out = ["doc_id", "held_out", "lang_pred", "score", *[F.col("own").getField(c).alias(c) for c in keep]]
    rows = docs.select(own, "doc_id", (bucket == held_out_bucket).alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"), F.col("text").cast("binary").alias("text"))
    if model is None:
        return rows.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)}).select(*out)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table, names = model.table(), np.array([*model.langs, UNKNOWN], object)
        for b in batches:
            for part in slices(b, "text", 1 << 19):
                f = model.margins(*_lowered(part), table)
                e = np.exp(SHARPNESS * (f - f.max(1, keepdims=True)))
                best, score = f.argmax(1), e.max(1) / e.sum(1)
                known = part.column("letters").to_numpy(zero_copy_only=False).astype(bool)
                best, score = np.where(known, best, len(model.langs)), np.where(known, score, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(names[best], pa.string()), pa.array(score.astype(np.float64)), part.column("own")], names=["doc_id", "held_out", "lang_pred", "score", "own"]
                )

    schema = StructType([docs.schema["doc_id"], StructField("held_out", BooleanType()), StructField("lang_pred", StringType()), StructField("score", DoubleType()), rows.schema["own"]])
    return rows.mapInArrow(run, schema).select(*out)
