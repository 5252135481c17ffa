"""Repeated passages across documents: where every window of W units that also starts earlier is found.

Units are words or bytes. A window's anchor is its smallest hash of K consecutive units (winnowing), so equal windows
have equal anchors. Runs of windows with one anchor form blocks: the text from the run's first window to the end of its
last. Blocks whose anchor occurs once in the corpus, and once in the block, hold no repeat. Of the rest, equal blocks
with equal anchors are brought down to their first copy, and the distinct blocks of one anchor are compared by an index
built in the task that holds them (the caller's `resolve`): a suffix order or an FM-index. Later copies of a block are
repeats as a whole. Blocks count as equal if two 64-bit hashes (anchor and block) agree.

Anchors are counted, and blocks brought down, by aggregates that combine before they shuffle; what is joined back are
plain equi-joins of written tables, whose hot keys Spark splits. An anchor with more distinct blocks than a task should
hold is split by longer anchors: its blocks are cut into runs again, with a larger K, and go through the same steps. With
K = W an anchor is a whole window, so its distinct blocks are few however hot it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import CHUNK_BYTES, Work, hash_words, mix, multipliers, slices, tasks_for, views, word_places, words_of

#: Longest run of windows in a block, where the window allows it (`Kind.longest_run`).
LONGEST_RUN = 96
#: Anchors with more distinct blocks than this are split by longer anchors.
MOST_BLOCKS = 1000
#: Tables of one length of anchors, which its spans are read from.
STEPS = ("found", "firsts", "hot", "answers", "split")
#: Units that a task indexes at a time.
BUCKET_UNITS = 1 << 19


@dataclass(frozen=True)
class Kind:
    words: bool
    window: int
    anchor: int  # K, units in an anchor

    def longer(self) -> Kind:
        """The kind with the next longer anchors: two and a half times as long, up to the window."""
        return replace(self, anchor=min(self.window, self.anchor * 5 // 2))

    @property
    def longest_run(self) -> int:
        """Such that the hashes of a block's first and last window cover the block."""
        return min(LONGEST_RUN, self.window)

    def sums(self, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, int]:
        """Hashes of G consecutive units at every place, row ends, and G; a hash of more is combined from these."""
        if self.words:
            return *hash_words(*views(part.column("text"))), 1
        buf, at = views(part.column("text"))
        n = len(buf) - 7
        if n <= 0:
            return np.zeros(0, np.uint64), at, 8
        return np.ascontiguousarray(np.ndarray((n,), "<u8", buf, 0, (1,))).view(np.uint64), at, 8


def gram_hash(sums: np.ndarray, g: int, n: int, seed: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hash of n units from every place, or from the places `at`."""
    offsets = list(range(0, n - g + 1, g))
    if offsets[-1] + g < n:
        offsets.append(n - g)
    m = multipliers(len(offsets), seed)
    length = len(sums) - offsets[-1]
    out = None
    for o, c in zip(offsets, m, strict=True):
        x = sums[o : o + length] if at is None else sums[at + o]
        y = x >> np.uint64(29)
        y ^= x
        y *= c
        if out is None:
            out = y
        else:
            out += y
    return mix(out)


def runs(kind: Kind, part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """row, start, n, anchor hash, block hash of every run of windows, and whether its anchor occurs in it twice.

    Only then can two windows of one run be equal.
    """
    sums, ends, g = kind.sums(part)
    w, k = kind.window, kind.anchor
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, bool))
    if len(sums) + g - 1 < w:
        return none
    h = gram_hash(sums, g, k, 1)
    span, width, low = w - k + 1, 1, h
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    n = len(low)
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(low[1:], low[:-1], out=new[1:])
    for edge in (ends[1:-1], ends[1:] - (w - 1)):  # rows begin, and their windows end
        new[edge[(edge > 0) & (edge < n)]] = True
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, n))
    row = np.searchsorted(ends, first, "right") - 1
    good = first + w <= ends[row + 1]
    first, length = first[good], length[good]
    most = kind.longest_run
    if length.size and length.max() > most:  # periodic texts
        pieces = -(-length // most)
        base, step = np.repeat(first, pieces), np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        length = np.minimum(np.repeat(length, pieces) - step * most, most)
        first = base + step * most
    if not first.size:
        return none
    block = mix(gram_hash(sums, g, w, 2, first) + gram_hash(sums, g, w, 3, first + length - 1) * np.uint64(3) + length.astype(np.uint64))
    value, twice = low[first], np.zeros(len(first), bool)
    # an anchor is nearly always among the smallest hashes; only values that occur again there, or are larger, are counted
    limit = np.uint64(min((1 << 64) - 1, 8 * (1 << 64) // span))
    few = np.sort(h[h <= limit])
    again = np.flatnonzero((np.searchsorted(few, value, "right") - np.searchsorted(few, value, "left") > 1) | (value > limit))
    if again.size:
        f, v, reach = first[again], value[again], length[again] + span - 1
        seen = np.zeros(len(again), np.int64)
        for o in range(int(reach.max())):
            seen += (reach > o) & (h[np.minimum(f + o, len(h) - 1)] == v)
        twice[again] = seen > 1
    row = np.searchsorted(ends, first, "right") - 1
    return row, first - ends[row], length, value, block, twice


def keyed(docs: DataFrame, *more) -> DataFrame:
    """doc, base and text. doc and base tell rows apart: the id (null: the smallest) and some bits of the text's hash."""
    text = F.col("text").cast("binary")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64("text").bitwiseAND(0x7FFFFFFF).alias("base"), text.alias("text"), *more)


def all_runs(rows: DataFrame, kind: Kind) -> DataFrame:
    """Every run of every row (doc, base, text): anchor, block, doc, base, at, n, twice.

    base and at are places in a document: the unit in the upper 32 bits, and below them what tells documents apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text", CHUNK_BYTES // 16):
                row, start, n, anchor, block, twice = runs(kind, part)
                doc, base = part.column("doc").to_numpy()[row], part.column("base").to_numpy()[row]
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(block.view(np.int64)), pa.array(doc), pa.array(base), pa.array((start << 32) + base), pa.array(n.astype(np.int16)), pa.array(twice)], names=["anchor", "block", "doc", "base", "at", "n", "twice"])

    return rows.mapInArrow(run, "anchor long, block long, doc long, base long, at long, n short, twice boolean")


def block_texts(rows: DataFrame, wanted: DataFrame, kind: Kind) -> DataFrame:
    """anchor, block, doc, at, n, units of the wanted runs; units are their bytes, for words with the white space between."""
    per = wanted.groupBy("doc", "base").agg(F.collect_list(F.struct("anchor", "block", "at", "n")).alias("w"))  # runs of one row
    joined = rows.join(per, ["doc", "base"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text", CHUNK_BYTES // 4):
                buf, ends = views(part.column("text"))
                raw = buf.tobytes()
                if kind.words:
                    starts, stops, ends = word_places(buf, ends)
                w = part.column("w")
                counts = np.diff(w.offsets.to_numpy().astype(np.int64))
                flat = w.flatten()
                at, n = flat.field("at").to_numpy(), flat.field("n").to_numpy().astype(np.int64)
                lo = np.repeat(ends[:-1], counts) + ((at - np.repeat(part.column("base").to_numpy(), counts)) >> 32)
                hi = lo + n + kind.window - 1
                if kind.words:
                    lo, hi = starts[lo], stops[hi - 1]
                yield pa.RecordBatch.from_arrays([flat.field("anchor"), flat.field("block"), pa.array(np.repeat(part.column("doc").to_numpy(), counts)), flat.field("at"), flat.field("n"), pa.array([raw[i:j] for i, j in zip(lo, hi, strict=True)], pa.binary())], names=["anchor", "block", "doc", "at", "n", "units"])

    return joined.mapInArrow(run, "anchor long, block long, doc long, at long, n short, units binary")


#: units, their ends by block, and each block's document and place, to one flag for each unit
Resolve = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def resolved(texts: DataFrame, kind: Kind, resolve: Resolve, bucket_units: int) -> DataFrame:
    """anchor, block, first_doc, first_at, hits: which windows of a first copy also start earlier, as [from, to) pairs.

    Blocks arrive by anchor in order, and are indexed together as they come, whole anchors at a time.
    """

    def close(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        pair = np.stack([t.column(c).to_numpy() for c in ("anchor", "block")], axis=1)
        once = np.unique(pair, axis=0, return_index=True)[1]  # rows that repeat in the table bring their blocks again
        t = (t.take(np.sort(once)) if len(once) < len(pair) else t).combine_chunks()
        units, ends = words_of(t.column("units").chunk(0))[1:] if kind.words else views(t.column("units").chunk(0))
        doc, start = (t.column(c).to_numpy() for c in ("doc", "at"))
        flagged = resolve(units, ends, doc, start)
        lists = []
        for i in range(len(doc)):
            f = flagged[ends[i] : ends[i + 1] - kind.window + 1].astype(np.int8)
            edges = np.flatnonzero(np.diff(np.concatenate([[0], f, [0]])))
            lists.append(edges.astype(np.int32))
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
        return pa.RecordBatch.from_arrays([t.column("anchor").chunk(0), t.column("block").chunk(0), t.column("doc").chunk(0), t.column("at").chunk(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int32)))], names=["anchor", "block", "first_doc", "first_at", "hits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            a = b.column("anchor").to_numpy()
            ends = np.cumsum(b.column("n").to_numpy().astype(np.int64) + kind.window - 1)
            i = 0
            while i < len(a):
                room = int(np.searchsorted(ends - (ends[i - 1] if i else 0), bucket_units - size, side="left"))
                j = min(i + max(room - i, 0) if room > i else i, len(a) - 1)
                # up to the end of the anchor at j
                j = int(np.searchsorted(a, a[j], side="right")) if (a[i:] >= a[i]).all() else len(a)
                if j == len(a):
                    held.append(b.slice(i))
                    size += int(ends[-1] - (ends[i - 1] if i else 0))
                    break
                if held and held[-1].column("anchor")[-1].as_py() != a[i] and size >= bucket_units:
                    yield close(held)
                    held, size = [], 0
                held.append(b.slice(i, j - i))
                yield close(held)
                held, size, i = [], 0, j
        if held:
            yield close(held)

    dealt = texts.repartition(tasks_for(texts.sparkSession), "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, "anchor long, block long, first_doc long, first_at long, hits array<int>")


def repeated_spans(work: Work, docs: DataFrame, kind: Kind, same_doc: bool, resolve: Resolve, most_blocks: int = MOST_BLOCKS, bucket_units: int = BUCKET_UNITS) -> DataFrame:
    """doc, base, spans: windows that also start earlier, as (s, e) of starts, for every document that has some.

    Earlier means in a smaller (doc, start) if same_doc, else in a smaller doc.
    """
    spans = work.write(_spans(work, keyed(docs), kind, same_doc, resolve, most_blocks, bucket_units, 0), "spans")
    work.drop(*(f"{name}0" for name in STEPS))
    return spans


def _spans(work: Work, rows: DataFrame, kind: Kind, same_doc: bool, resolve: Resolve, most_blocks: int, bucket_units: int, level: int) -> DataFrame:
    """doc, base, spans (starts from the row's first unit) of rows (doc, base, text), by anchors of one length."""
    every = work.write(all_runs(rows, kind), f"runs{level}")
    shared = every.groupBy("anchor").agg(F.count("*").alias("c"), F.max("twice").alias("t")).filter("c > 1 or t").select("anchor")
    found = work.write(every.drop("twice").join(work.write(shared, f"anchors{level}"), "anchor"), f"found{level}")
    work.drop(f"runs{level}", f"anchors{level}")
    firsts = found.groupBy("anchor", "block").agg(F.min(F.struct("doc", "at", "base", "n")).alias("f")).select("anchor", "block", "f.*")
    firsts = work.write(firsts, f"firsts{level}")
    cold = firsts
    split = kind.anchor < kind.window
    if split:
        hot = firsts.groupBy("anchor").agg(F.count("*").alias("c")).filter(F.col("c") > most_blocks).select("anchor")
        hot = work.write(hot, f"hot{level}")
        split = not hot.isEmpty()
    if split:
        cold = firsts.join(hot, "anchor", "left_anti")
    answers = work.write(resolved(block_texts(rows, cold, kind), kind, resolve, bucket_units), f"answers{level}")
    if split:
        blocks = block_texts(rows, firsts.join(hot, "anchor", "left_semi"), kind)
        blocks = blocks.dropDuplicates(["anchor", "block"]).select("anchor", "block", "doc", F.col("at").alias("base"), F.col("units").alias("text"))
        blocks = work.write(blocks, f"blocks{level}")
        inner = _spans(work, blocks.select("doc", "base", "text"), kind.longer(), same_doc, resolve, most_blocks, bucket_units, level + 1)
        hits = F.coalesce(F.flatten(F.transform("spans", lambda x: F.array(x["s"], x["e"]))), F.array().cast("array<int>"))
        inner = blocks.drop("text").join(inner, ["doc", "base"], "left").select("anchor", "block", F.col("doc").alias("first_doc"), F.col("base").alias("first_at"), hits.alias("hits"))
        answers = answers.unionByName(work.write(inner, f"split{level}"))
        work.drop(f"blocks{level}", *(f"{name}{level + 1}" for name in STEPS))

    both = found.join(answers, ["anchor", "block"])
    later = F.struct("doc", "at") > F.struct(F.col("first_doc").alias("doc"), F.col("first_at").alias("at")) if same_doc else F.col("doc") > F.col("first_doc")
    start = F.shiftright(F.col("at") - F.col("base"), 32).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.size("hits") - 2, F.lit(2)), lambda i: F.struct((start + F.get("hits", i)).alias("s"), (start + F.get("hits", i + 1)).alias("e")))
    whole = F.array(F.struct(start.alias("s"), (start + F.col("n")).cast("int").alias("e")))
    spans = F.when(later, whole).when(F.size("hits") > 0, pairs)
    each = both.select("doc", "base", F.explode_outer(spans).alias("x")).filter("x is not null")
    return each.groupBy("doc", "base").agg(F.collect_list("x").alias("spans"))  # spans of one row


def covered(spans: pa.Array, row_units: np.ndarray, window: int) -> Iterator[np.ndarray]:
    """For each document, which of its units lie in a flagged window."""
    counts = np.diff(spans.offsets.to_numpy().astype(np.int64)) if len(spans) else np.zeros(0, np.int64)
    counts = np.where(spans.is_valid().to_numpy(zero_copy_only=False), counts, 0)
    flat = spans.flatten()
    s, e = flat.field("s").to_numpy().astype(np.int64), flat.field("e").to_numpy().astype(np.int64)
    at = 0
    for c, n in zip(counts, row_units, strict=True):
        step = np.zeros(n + 1, np.int64)
        np.add.at(step, s[at : at + c], 1)
        np.add.at(step, np.minimum(e[at : at + c] + window - 1, n), -1)
        at += c
        yield np.cumsum(step[:n]) > 0
