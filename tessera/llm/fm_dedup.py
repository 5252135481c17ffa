"""Removal of repeated word passages by compressed FM-indexes: backward search over wavelet matrices."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tessera.llm.common import CHUNK_BYTES, Work, slices, views
from tessera.llm.repeats import BUCKET_UNITS, MOST_BLOCKS, Kind, covered, keyed, repeated_spans
from tessera.llm.suffix_dedup import common_prefix, smaller_neighbours

WINDOW, ANCHOR = 50, 10


class Bits:
    """A bit vector with rank: 64-bit words and the ones before each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) + 64) // 64 * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))]).astype(np.int32)
        self.zeros = int(len(bits) - bits.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low).astype(np.int64)


class WaveletMatrix:
    """rank(symbol, i) over a sequence of small numbers, one bit vector a binary digit."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels: list[tuple[int, Bits]] = []
        s = symbols
        for d in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bit = ((s >> d) & 1).astype(np.uint8)
            self.levels.append((d, Bits(bit)))
            s = np.concatenate([s[bit == 0], s[bit == 1]])
        self.start = self._down(np.arange(sigma), np.zeros(sigma, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for d, bits in self.levels:
            ones = bits.rank(i)
            i = np.where((c >> d) & 1, bits.zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._down(c, i) - self.start[c]


class FMIndex:
    """Index of sequences of symbols 1..sigma-1, each ended by a separator 0 (separators in order of place).

    Suffixes are sorted by their first `depth` symbols, ties by place: strings of up to `depth` symbols have the same
    intervals as in the whole order. After building, the text and its suffix array are gone; what stays are the wavelet
    matrix over the Burrows-Wheeler transform, the counts of smaller symbols, the sequence that each suffix belongs to,
    and the intervals' parents.
    """

    def __init__(self, text: np.ndarray, sigma: int, depth: int):
        n = self.n = len(text)
        self.depth = depth
        ends = np.concatenate([[0], np.flatnonzero(text == 0) + 1])
        left = np.repeat(ends[1:], np.diff(ends)) - np.arange(n) - 1  # symbols before the separator
        rank, done = text.astype(np.int64), 1
        while done < min(depth, int(left.max(initial=0)) + 1):
            step = min(done, depth - done)
            after = np.zeros(n, np.int64)
            inside = left[: n - step] >= step if step < n else np.zeros(0, bool)
            after[: max(0, n - step)][inside] = rank[step:][inside] + 1
            key = rank * np.int64(max(n, sigma) + 2) + after
            order = np.argsort(key)
            s = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
            done += step
        sa = np.argsort(rank * np.int64(n) + np.arange(n))
        self.sequence = (np.searchsorted(ends, sa, side="right") - 1).astype(np.int32)
        self.wavelet = WaveletMatrix(text[sa - 1], sigma)  # the first symbol follows the last separator
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])[:-1]
        lcp = np.full(n + 1, -1, np.int64)
        lcp[1:n] = np.minimum(common_prefix(text, ends, sa[:-1], sa[1:], depth), np.minimum(left[sa[:-1]], left[sa[1:]]))
        before, after = smaller_neighbours(lcp, strict=True)
        self.lcp, self.before, self.after = lcp.astype(np.int32), np.maximum(before, 0).astype(np.int32), np.where(after < 0, n, after).astype(np.int32)

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of suffixes that begin with c followed by the intervals' strings."""
        both = self.smaller[np.concatenate([c, c])] + self.wavelet.rank(np.concatenate([c, c]), np.concatenate([lo, hi]))
        return both[: len(c)], both[len(c) :]

    def parents(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The longest proper prefix of each interval's string that more suffixes share: its interval and length."""
        depth = np.maximum(self.lcp[lo], self.lcp[hi])
        new_lo = np.where((self.lcp[lo] == depth) & (lo > 0), self.before[lo], lo)
        new_hi = np.where((self.lcp[hi] == depth) & (hi < self.n), self.after[hi], hi)
        whole = depth <= 0
        return np.where(whole, 0, new_lo), np.where(whole, self.n, new_hi), np.maximum(depth, 0)

    def matching_statistics(self, streams: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each place of the streams: length, up to `depth`, of the longest string from there, within its stream,
        that the index holds, and the interval of the suffixes that begin with it. Symbols that the index lacks are
        negative.

        All streams are read backward at once. A match of full length loses its last symbol before it is extended; a
        symbol that can't be put before the current match shortens it to the parent interval until it can, or nothing
        is left.
        """
        length, first, last = (np.zeros(len(streams), np.int64) for _ in range(3))
        k = len(ends) - 1
        lo, hi, size = np.zeros(k, np.int64), np.full(k, self.n, np.int64), np.zeros(k, np.int64)
        lane = np.argsort(-np.diff(ends), kind="stable")
        spans = np.diff(ends)[lane]
        for t in range(1, int(spans[0]) + 1 if k else 0):
            live = lane[: int(np.searchsorted(-spans, -t, side="right"))]
            at = ends[live + 1] - t
            c = streams[at]
            todo = live[c >= 0]
            lost = live[c < 0]
            lo[lost], hi[lost], size[lost] = 0, self.n, 0
            full = todo[size[todo] == self.depth]
            if full.size:
                size[full] -= 1
                a, b, up = self.parents(lo[full], hi[full])
                wider = up == self.depth - 1
                lo[full[wider]], hi[full[wider]] = a[wider], b[wider]
            while todo.size:
                a, b = self.extend(streams[ends[todo + 1] - t], lo[todo], hi[todo])
                ok = a < b
                good = todo[ok]
                lo[good], hi[good] = a[ok], b[ok]
                size[good] += 1
                todo = todo[~ok]
                todo = todo[size[todo] > 0]
                if todo.size:
                    lo[todo], hi[todo], size[todo] = self.parents(lo[todo], hi[todo])
            length[at], first[at], last[at] = size[live], lo[live], hi[live]
        return length, first, last


def least_in(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The smallest value in each interval [lo, hi); the intervals are equal or apart."""
    if not len(lo):
        return np.zeros(0, values.dtype)
    begins, which = np.unique(lo, return_inverse=True)
    stops = np.zeros(len(begins), np.int64)
    stops[which] = hi
    edges = np.stack([begins, stops], axis=1).ravel()
    return np.minimum.reduceat(np.append(values, values[:1]), edges)[::2][which]


def resolver(window: int):
    def resolve(units: np.ndarray, ends: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The bucket's blocks are indexed, and streamed against the index; an interval of a whole window tells which
        documents hold it."""
        k = len(doc)
        text = np.zeros(len(units) + k, np.int64)
        text[np.arange(len(units)) + np.repeat(np.arange(k), np.diff(ends))] = units + 1
        index = FMIndex(text, int(units.max()) + 2, window)
        length, lo, hi = index.matching_statistics(units + 1, ends)
        flags = length >= window
        flags[flags] = least_in(doc[index.sequence], lo[flags], hi[flags]) < np.repeat(doc, np.diff(ends))[flags]
        return flags

    return resolve


def drop_passages(docs: DataFrame, keep: list[str] | None = None, window: int = WINDOW, anchor: int = ANCHOR, most_blocks: int = MOST_BLOCKS, bucket_units: int = BUCKET_UNITS // 4, with_text: bool = False) -> DataFrame:
    """Every document without the words covered by a window of `window` words that also starts in an earlier document.

    Earlier is a smaller doc_id; repeats within a document stay, and windows are judged on the input. Words are runs of
    bytes other than ASCII white space, unchanged. Columns: doc_id, n_words, n_removed, kept_sha256 (kept words joined by
    one space), those in `keep`, and that text as `kept` if with_text. A null text has no words. Rows with the same id
    are the same document to each other: none is earlier. A null id sorts first. An empty table gives no rows.
    """
    kind = Kind(True, window, anchor)
    work = Work(docs.sparkSession, "passages")
    spans = repeated_spans(work, docs.select("doc_id", "text"), kind, False, resolver(window), most_blocks, bucket_units)
    keep = [c for c in keep or [] if c not in ("doc_id", "text")]
    rows = keyed(docs, F.col("doc_id"), *keep).join(spans, ["doc", "base"], "left")
    own = docs.select("doc_id", *keep).schema.fields
    out = [own[0], StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_sha256", StringType()), *own[1:], *([StructField("kept", StringType())] if with_text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text", CHUNK_BYTES):
                buf, at = views(part.column("text"))
                raw = buf.tobytes()
                words = [raw[i:j].split() for i, j in zip(at[:-1], at[1:], strict=True)]
                counts = np.array([len(w) for w in words], np.int64)
                removed, sha, texts = [], [], []
                for w, cut in zip(words, covered(part.column("spans"), counts, window), strict=True):
                    removed.append(int(cut.sum()))
                    left = b" ".join([x for x, c in zip(w, cut.tolist(), strict=True) if not c] if removed[-1] else w)
                    sha.append(hashlib.sha256(left).hexdigest())
                    texts.append(left.decode("utf-8", "replace") if with_text else "")
                arrays = [part.column("doc_id"), pa.array(counts), pa.array(removed, pa.int64()), pa.array(sha), *(part.column(c) for c in keep)]
                yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(texts)] if with_text else [])], names=[f.name for f in out])

    return rows.mapInArrow(run, StructType(out))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT doc_id, i, array_to_string(ws[i : i + 49], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d) AS x),
f AS (SELECT s, min(doc_id) AS m FROM g GROUP BY s HAVING min(doc_id) < max(doc_id)),
cut AS (SELECT DISTINCT doc_id, unnest(range(g.i, g.i + 50)) AS i FROM g JOIN f USING (s) WHERE m < doc_id),
kept AS (SELECT doc_id, count(*) AS n, string_agg(a, ' ' ORDER BY i) AS t FROM p ANTI JOIN cut USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
