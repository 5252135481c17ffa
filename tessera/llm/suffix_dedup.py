"""Removal of repeated byte strings by longest-previous-factor arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from tessera.llm.common import CHUNK_BYTES, Work, slices, views
from tessera.llm.repeats import BUCKET_UNITS, MOST_BLOCKS, Kind, covered, keyed, repeated_spans

WINDOW, ANCHOR = 100, 24
#: Strings that are compared at a time.
FACTORS_AT_ONCE = 1 << 16


def smaller_neighbours(place: np.ndarray, strict: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """For each index of a sequence, the nearest earlier and the nearest later index with a smaller number (-1: none).
    Numbers must be distinct unless `strict`. Links are followed for all open indices at once: each jump skips what the neighbour skipped."""
    n = len(place)
    above = np.greater_equal if strict else np.greater

    def one(x: np.ndarray) -> np.ndarray:
        link = np.arange(-1, n - 1)
        todo = np.flatnonzero(link >= 0)
        todo = todo[above(x[link[todo]], x[todo])]
        while todo.size:
            link[todo] = link[link[todo]]
            todo = todo[link[todo] >= 0]
            todo = todo[above(x[link[todo]], x[todo])]
        return link

    before = one(place)
    after = n - 1 - one(place[::-1])[::-1]
    return before, np.where(after == n, -1, after)


def common_prefix(text: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Length, up to depth, of what is common at the places a and b within their rows."""
    stop = np.repeat(ends[1:], np.diff(ends))
    most = np.minimum(np.minimum(stop[a] - a, stop[b] - b), depth)
    out, live = np.zeros(len(a), np.int64), np.arange(len(a))
    while live.size:
        live = live[out[live] < most[live]]
        live = live[text[a[live] + out[live]] == text[b[live] + out[live]]]
        out[live] += 1
    return out


def previous_factors(text: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest previous factors: places with `depth` units before their row's end; for each, the length (up to depth) of
    the longest string there that also starts at an earlier one of these places; and such an earlier place (-1: none).

    The places are put in suffix order, which matters to that depth only (ties by place). The previous and the next
    smaller place in that order are the candidates: no other earlier place shares more. Rows must come in the order that
    makes a place earlier.
    """
    place = np.flatnonzero(np.repeat(ends[1:], np.diff(ends)) - np.arange(len(text)) >= depth)
    lpf, source = np.zeros(len(place), np.int64), np.full(len(place), -1, np.int64)
    if not len(place):
        return place, lpf, source
    # all strings are of one length, so that padding plays no part in comparing them
    strings = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, depth)[place])
    order = np.argsort(strings.view(f"S{depth}").ravel(), kind="stable")
    for link in smaller_neighbours(order):
        has = np.flatnonzero(link >= 0)
        for part in np.array_split(has, len(has) // FACTORS_AT_ONCE + 1):
            at, prev = order[part], order[link[part]]
            differ = strings[at] != strings[prev]
            length = np.where(differ.any(1), differ.argmax(1), depth)
            better = length > lpf[at]
            lpf[at[better]], source[at[better]] = length[better], place[prev[better]]
    return place, lpf, source


def resolver(window: int):
    def resolve(units: np.ndarray, ends: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Blocks are laid out by (doc, start), so that earlier places are earlier in the corpus."""
        order = np.lexsort((at, doc))
        lengths = np.diff(ends)[order]
        new_ends = np.concatenate([[0], np.cumsum(lengths)])
        move = np.repeat(ends[:-1][order] - new_ends[:-1], lengths) + np.arange(new_ends[-1])
        place, lpf, _ = previous_factors(units[move], new_ends, window)
        flags = np.zeros(len(units), bool)
        flags[move[place]] = lpf >= window
        return flags

    return resolve


def drop_repeats(docs: DataFrame, keep: list[str] | None = None, window: int = WINDOW, anchor: int = ANCHOR, most_blocks: int = MOST_BLOCKS, bucket_units: int = BUCKET_UNITS, with_text: bool = False) -> DataFrame:
    """Every document without the bytes covered by a `window`-byte string that also starts earlier.

    Earlier is a smaller doc_id, or the same document and an earlier start; strings are judged on the input and may
    overlap. Columns: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, those in `keep`, and the
    kept bytes as `kept` if with_text. A null text has no bytes. Rows that repeat an id with the same text are one
    document, and each gives the same result; with other texts they are ordered by some bits of the text's hash after
    the start. A null id sorts first. An empty table gives no rows.
    """
    kind = Kind(False, window, anchor)
    work = Work(docs.sparkSession, "suffixes")
    spans = repeated_spans(work, docs.select("doc_id", "text"), kind, True, resolver(window), most_blocks, bucket_units)
    keep = [c for c in keep or [] if c not in ("doc_id", "text")]
    rows = keyed(docs, F.col("doc_id"), *keep).join(spans, ["doc", "base"], "left")
    fields = docs.select("doc_id", *keep).schema.fields
    out = [*fields[:1], *(StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")), StructField("kept_sha256", StringType()), *fields[1:], *([StructField("kept", BinaryType())] if with_text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text", CHUNK_BYTES):
                buf, at = views(part.column("text"))
                removed, n_spans, sha, texts = [], [], [], []
                for i, cut in enumerate(covered(part.column("spans"), np.diff(at), window)):
                    mine = buf[at[i] : at[i + 1]]
                    removed.append(int(cut.sum()))
                    n_spans.append(int((np.diff(np.concatenate([[0], cut.astype(np.int8)])) == 1).sum()))
                    left = (mine[~cut] if removed[-1] else mine).tobytes()
                    sha.append(hashlib.sha256(left).hexdigest())
                    texts.append(left if with_text else b"")
                arrays = [part.column("doc_id"), pa.array(np.diff(at)), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha), *(part.column(c) for c in keep)]
                yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(texts, pa.binary())] if with_text else [])], names=[f.name for f in out])

    return rows.mapInArrow(run, StructType(out))
