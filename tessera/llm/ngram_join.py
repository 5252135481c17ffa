"""Jaccard self-join of documents on word shingles, by PartEnum signatures.

Sizes of sets are cut into bands. Two sets with Jaccard similarity of at least p percent lie in one band, or the smaller
at the upper end of the band below; it then signs for both. In a band whose largest size is u, such sets differ in at
most k = 2u (100 - p) / (100 + p) elements (2u/19 for 90). The feature domain is hashed into k // 2 + 1 parts, so in some part they differ in at most one, and
each part into three pieces, so two of the three agree: for each part, each of the three pairs of pieces gives a
signature, and such sets share one.

Sets with the same elements count as one. Signatures are packed by ranges, and each range is sorted in one place: those of
a single set are dropped, and those with the same sets become one group. In the groups that are
left, parity sketches (whose distance never exceeds that of the sets) rule out nearly all false pairs, and a group
passes on a spanning forest of what is left rather than its pairs; large groups are first compared with one of their
members (`split_groups`). The forest's edges are verified exactly. Groups with a
refuted edge whose ends no verified links connect are done again: now each passes on all its possible pairs whose ends
aren't connected, few as they are, and these are verified too. Then every link joins sets that verified links connect.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.llm.common import CHUNK_BYTES, Work, hash_words, mix, multipliers, owners, slices, tasks_for, views
from tessera.llm.components import components

#: Words in a shingle, and the least similarity in percent, unless asked otherwise.
SHINGLE, PERCENT = 3, 90
#: Signatures in a packed part, those that a task packs at a time, those that a bucket should hold, and those that it is
#: sorted with at most.
PACK, PACKED_AT_ONCE, BUCKET_AIM, BUCKET_ROWS = 256, 1 << 20, 300_000, 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Band ratio as a fraction (similar sets lie in one band or in neighbours if it is 100 / PERCENT at least), and the
#: largest size that a band begins with.
RATIO, TOP = (5, 4), 1 << 31
#: Bits of a sketch for each element of a band's largest set.
SKETCH_BITS = 4
#: Larger groups are cut into chunks of this many members (`split_groups`).
CHUNK = 512


@dataclass(frozen=True)
class Likeness:
    """When sets count as similar, and what bands follow from it."""

    percent: int = PERCENT
    lo: np.ndarray = field(init=False, compare=False)  # first and last size of each band
    hi: np.ndarray = field(init=False, compare=False)

    def __post_init__(self):
        if not 100 * RATIO[1] <= self.percent * RATIO[0] or not self.percent < 100:
            raise ValueError(f"percent is {self.percent}, not from {100 * RATIO[1] // RATIO[0]} to 99")
        # band 0 holds sizes at which similar sets are equal: up to 9 for 90
        lo, hi = [1], [(-(-(100 + self.percent) // (100 - self.percent)) - 1) // 2]
        while hi[-1] < TOP:
            lo.append(hi[-1] + 1)
            hi.append(lo[-1] * RATIO[0] // RATIO[1])
        object.__setattr__(self, "lo", np.array(lo))
        object.__setattr__(self, "hi", np.array(hi))

    def similar(self, n_a, n_b, distance):
        """100 |A and B| >= percent |A or B|, by sizes and the size of the symmetric difference."""
        return (100 + self.percent) * distance <= (100 - self.percent) * (n_a + n_b)

    def most_apart(self, bands):
        """In how many elements similar sets of a band differ at most."""
        return 2 * self.hi[bands] * (100 - self.percent) // (100 + self.percent)

    def sketch_words(self, band: int) -> int:
        return int(-(-SKETCH_BITS * self.hi[band] // 64))

    def possible(self, n_a, n_b, a, b):
        """Whether sets of these sizes and sketches may be similar."""
        apart = np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)
        return self.similar(n_a, n_b, np.maximum(apart, np.abs(n_a - n_b)))


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each value in order, and where each value's begin and end."""
    buf, at = views(column)
    h, ends = hash_words(LOWER[buf], at)
    n = len(ends) - 1
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    row = owners(ends)
    m = multipliers(size, 7)
    counts = np.diff(ends)
    whole = np.flatnonzero((counts > 0) & (counts < size))
    made, of = [], []
    if len(h) >= size:
        x = np.zeros(len(h) - size + 1, np.uint64)
        for j in range(size):
            y = h[j : len(h) - size + 1 + j]
            x += (y ^ (y >> np.uint64(31))) * m[j]
        inside = row[: len(x)] == row[size - 1 :]
        made.append(mix(x)[inside])
        of.append(row[: len(x)][inside])
    if whole.size:  # fewer words: all of them as one, told apart by their number
        made.append(np.array([mix(np.array([sum(int(a) * int(b) for a, b in zip(h[ends[i] : ends[i + 1]], m, strict=False)) + int(counts[i]) & (1 << 64) - 1], np.uint64))[0] for i in whole]))
        of.append(whole)
    made, of = np.concatenate(made), np.concatenate(of)
    order = np.lexsort((made, of))
    made, of = made[order], of[order]
    new = np.ones(len(made), bool)
    new[1:] = (made[1:] != made[:-1]) | (of[1:] != of[:-1])
    made, of = made[new], of[new]
    return made, np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))])


def set_ids(sets: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each set."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets + np.uint64(0x51ED270B)))])
    return mix((total[ends[1:]] - total[ends[:-1]]) * np.uint64(0x9E3779B97F4A7C15) + np.diff(ends).astype(np.uint64)).view(np.int64)


def signers(like: Likeness, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and band of every band that a set signs for."""
    own = np.searchsorted(like.hi, sizes)
    rows = np.arange(len(sizes))
    up = np.minimum(own + 1, len(like.lo) - 1)
    both = (100 * sizes >= like.percent * like.lo[up]) & (sizes > 0)
    signs = (own > 0) & (sizes > 0)
    return np.concatenate([rows[signs], rows[both]]), np.concatenate([own[signs], up[both]])


def signatures(like: Likeness, sets: np.ndarray, ends: np.ndarray, rows: np.ndarray, bands: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures, and to which of the given (row, band) each belongs."""
    sizes = np.diff(ends)[rows]
    parts = like.most_apart(bands) // 2 + 1
    cell0 = np.concatenate([[0], np.cumsum(3 * parts)])
    which = np.repeat(np.arange(len(rows)), sizes)
    e = sets[np.repeat(ends[:-1][rows] - np.concatenate([[0], np.cumsum(sizes)])[:-1], sizes) + np.arange(sizes.sum())]
    place = mix(e + np.uint64(0xA5A5))
    part = ((place >> np.uint64(32)) * parts[which].astype(np.uint64)) >> np.uint64(32)
    piece = (place & np.uint64(0xFFFFFFFF)) * np.uint64(3) >> np.uint64(32)
    sums = np.zeros(cell0[-1], np.uint64)
    np.add.at(sums, cell0[which] + (part * np.uint64(3) + piece).astype(np.int64), mix(e + np.uint64(0x5A5A5A)))
    sums = mix(sums).reshape(-1, 3)
    of = np.repeat(np.arange(len(rows)), parts)
    tag = mix((bands[of].astype(np.uint64) << np.uint64(32)) + (np.arange(len(of)) - (cell0[:-1] // 3)[of]).astype(np.uint64))
    out = [mix(sums[:, i] + sums[:, j] * np.uint64(0x9E3779B97F4A7C15) + tag + np.uint64(i + 3 * j)) for i, j in ((0, 1), (0, 2), (1, 2))]
    return np.concatenate(out).view(np.int64), np.tile(of, 3)


def sketches(like: Likeness, sets: np.ndarray, ends: np.ndarray, rows: np.ndarray, bands: np.ndarray) -> list[bytes]:
    """For each (row, band): the parities of the numbers of elements in as many buckets as the band has bits."""
    out = []
    place = mix(sets + np.uint64(0xC3C3))
    for r, b in zip(rows, bands, strict=True):
        bits = like.sketch_words(b) * 64
        at = ((place[ends[r] : ends[r + 1]] >> np.uint64(32)) * np.uint64(bits)) >> np.uint64(32)
        out.append(np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes())
    return out


def spanning(like: Likeness, ids: np.ndarray, sizes: np.ndarray, sketch: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what possible links connect."""
    left = np.ones(len(ids), bool)
    edges: list[tuple[int, int]] = []
    while left.any():
        queue = [int(np.argmax(left))]
        left[queue[0]] = False
        while queue:
            x = queue.pop()
            rest = np.flatnonzero(left)
            near = rest[like.possible(sizes[rest], sizes[x], sketch[rest], sketch[x])]
            edges += [(int(ids[x]), int(ids[y])) for y in near]
            left[near] = False
            queue.extend(near.tolist())
            if not len(rest) - len(near):
                break
    return edges


def crossing(like: Likeness, ids: np.ndarray, sizes: np.ndarray, sketch: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    """All possible links between members of different labels."""
    edges: list[tuple[int, int]] = []
    for x in range(len(ids) - 1):
        rest = np.flatnonzero(label[x + 1 :] != label[x]) + x + 1
        if rest.size:
            near = rest[like.possible(sizes[rest], sizes[x], sketch[rest], sketch[x])]
            edges += [(int(ids[x]), int(ids[y])) for y in near]
    return edges


def set_rows(docs: DataFrame, shingle: int, like: Likeness) -> DataFrame:
    """doc_id, n_shingles, set_id, and bands with their sketches, of every document."""
    kind = docs.schema["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text", CHUNK_BYTES // 4):
                sets, ends = shingle_sets(part.column("text"), shingle)
                rows, bands = signers(like, np.diff(ends))
                order = np.argsort(rows, kind="stable")
                rows, bands = rows[order], bands[order]
                offsets = pa.array(np.searchsorted(rows, np.arange(part.num_rows + 1)).astype(np.int32))
                made = pa.StructArray.from_arrays([pa.array(bands.astype(np.int16)), pa.array(sketches(like, sets, ends, rows, bands), pa.binary())], names=["band", "sketch"])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(ends)), pa.array(set_ids(sets, ends)), pa.ListArray.from_arrays(offsets, made)], names=["doc_id", "n_shingles", "set_id", "sketches"])

    schema = StructType([kind, StructField("n_shingles", LongType()), StructField("set_id", LongType())])
    text = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return text.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", sketches array<struct<band:short,sketch:binary>>")


SIGNED = np.dtype([("sig", "<i8"), ("set_id", "<i8"), ("band", "<i2")])


def signature_parts(docs: DataFrame, shingle: int, like: Likeness, buckets: int) -> DataFrame:
    """bucket, part: signatures with their set and band, packed by ranges of signatures (SIGNED, up to PACK in a part).

    Equal sets that meet in a task sign once; its set ids are few, as a task reads a bounded piece of the table.
    """

    def pack(held: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(held)
        bucket = (((rows["sig"].view(np.uint64) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        rows, bucket = rows[order], bucket[order]
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        pieces = -(-np.diff(np.append(first, len(rows))) // PACK)
        cut = np.repeat(first, pieces) + (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * PACK
        ends = (np.append(cut, len(rows)) * SIGNED.itemsize).astype(np.int32)
        packed = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(ends), pa.py_buffer(rows.tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(bucket[cut]), packed], names=["bucket", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        for b in batches:
            for part in slices(b, "text", CHUNK_BYTES // 4):
                sets, ends = shingle_sets(part.column("text"), shingle)
                ids = set_ids(sets, ends)
                once = np.zeros(len(ids), bool)
                once[[i for i in np.unique(ids, return_index=True)[1] if int(ids[i]) not in seen]] = True
                seen.update(ids[once].tolist())
                rows, bands = signers(like, np.where(once, np.diff(ends), 0))
                if rows.size:
                    sig, of = signatures(like, sets, ends, rows, bands)
                    made = np.empty(len(sig), SIGNED)
                    made["sig"], made["set_id"], made["band"] = sig, ids[rows][of], bands[of]
                    held.append(made)
                if sum(map(len, held)) >= PACKED_AT_ONCE:
                    yield pack(held)
                    held = []
        if held:
            yield pack(held)

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "bucket int, part binary")


def shared_groups(parts: DataFrame, tasks: int) -> DataFrame:
    """sig, set_id, band of signatures that more than one set has. Signatures with the same members form one group, named by
    a hash of the members; the same pair of near copies shares many.

    A bucket is sorted in memory. Where it holds more than BUCKET_ROWS, groups that are known to be shared are given out
    on the way, under their signature, so that a very frequent signature is never gathered.
    """

    def groups(rows: np.ndarray, known: np.ndarray, last: bool) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
        rows = rows[np.lexsort((rows["set_id"], rows["sig"]))]
        rows = rows[np.concatenate([[True], (rows["sig"][1:] != rows["sig"][:-1]) | (rows["set_id"][1:] != rows["set_id"][:-1])])]
        first = np.flatnonzero(np.concatenate([[True], rows["sig"][1:] != rows["sig"][:-1]]))
        n = np.diff(np.append(first, len(rows)))
        sig = rows["sig"][first]
        old = np.isin(sig, known)
        name = sig.copy()
        if last:
            made = mix(np.add.reduceat(mix(rows["set_id"].view(np.uint64) + np.uint64(0x1D)), first) + rows["band"][first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + n.astype(np.uint64))
            name = np.where(old, sig, made.view(np.int64))
        out = old | (n > 1)
        known = np.union1d(known, sig[out & ~old])
        kept = rows[np.repeat(~out, n)]
        if last:  # one of the groups with the same members
            one = np.zeros(len(name), bool)
            one[np.unique(name, return_index=True)[1]] = True
            out &= one | old
        rows, name = rows[np.repeat(out, n)], np.repeat(name[out], n[out])
        return pa.RecordBatch.from_arrays([pa.array(name), pa.array(np.ascontiguousarray(rows["set_id"])), pa.array(np.ascontiguousarray(rows["band"]))], names=["sig", "set_id", "band"]), known, kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, size, most, known = None, [], 0, BUCKET_ROWS, np.zeros(0, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            bucket = b.column("bucket").to_numpy()
            buf, at = views(b.column("part"))
            edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if bucket[i] != current:
                    if held:
                        yield groups(np.concatenate(held), known, True)[0]
                    current, held, size, most, known = bucket[i], [], 0, BUCKET_ROWS, np.zeros(0, np.int64)
                held.append(np.frombuffer(buf[at[i] : at[j]].tobytes(), SIGNED))
                size += len(held[-1])
                if size > most:
                    found, known, kept = groups(np.concatenate(held), known, False)
                    yield found
                    held, size, most = [kept], len(kept), max(BUCKET_ROWS, 2 * len(kept))
        if held:
            yield groups(np.concatenate(held), known, True)[0]

    dealt = parts.repartition(tasks, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "sig long, set_id long, band short").distinct()


def candidate_edges(groups: DataFrame, parts: int, every: bool, like: Likeness) -> DataFrame:
    """a, b from rows (sig, c1, c2, set_id, n, sketch, label), grouped by (sig, c1, c2): a spanning forest of each group,
    or every possible link between labels."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        key = [t.column(c).to_numpy() for c in ("sig", "c1", "c2")]
        ids, n, label = (t.column(c).to_numpy() for c in ("set_id", "n", "label"))
        raw = t.column("sketch").combine_chunks()
        buf, at = views(raw.chunk(0) if isinstance(raw, pa.ChunkedArray) else raw)
        new = np.ones(len(ids), bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in key], axis=0)
        first = np.append(np.flatnonzero(new), len(ids))
        sizes = np.diff(first)
        words = buf.tobytes()
        edges: list[tuple[int, int]] = []
        two = first[:-1][sizes == 2]
        two = two[label[two] != label[two + 1]]
        length, flat = (at[1:] - at[:-1])[two], np.frombuffer(words, np.uint8)
        for w in np.unique(length):
            i = two[length == w]
            a, c = (flat[at[j][:, None] + np.arange(w)].view(np.uint64) for j in (i, i + 1))
            ok = i[like.possible(n[i], n[i + 1], a, c)]
            edges += zip(ids[ok].tolist(), ids[ok + 1].tolist(), strict=True)
        for i, j in zip(first[:-1][sizes > 2], first[1:][sizes > 2], strict=True):
            sk = np.frombuffer(words[at[i] : at[j]], np.uint64).reshape(j - i, -1)
            edges += crossing(like, ids[i:j], n[i:j], sk, label[i:j]) if every else spanning(like, ids[i:j], n[i:j], sk)
        if not edges:
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, names=["a", "b"])
        e = np.unique(np.sort(np.array(edges, np.int64), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            key = [b.column(c).to_numpy() for c in ("sig", "c1", "c2")]
            last = np.all([k == k[-1] for k in key], axis=0)
            cut = int(np.argmax(last))  # where the last group begins
            if cut or not held:
                yield_now, rest = b.slice(0, cut), b.slice(cut)
            elif all(h == k[0] for h, k in zip((held[-1].column(c)[-1].as_py() for c in ("sig", "c1", "c2")), key, strict=True)):
                held.append(b)
                continue
            else:
                yield_now, rest = b.slice(0, 0), b
            ready = [*held, yield_now] if cut or held else []
            if sum(x.num_rows for x in ready):
                yield solve(pa.Table.from_batches(ready).combine_chunks())
            held = [rest]
        if held:
            yield solve(pa.Table.from_batches(held).combine_chunks())

    dealt = groups.select("sig", "c1", "c2", "set_id", "n", "label", "sketch").repartition(parts, "sig", "c1", "c2").sortWithinPartitions("sig", "c1", "c2", "set_id")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def verify(edges: DataFrame, sets: DataFrame, like: Likeness) -> DataFrame:
    """edges with `linked`, from both whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flags = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(s, t, assume_unique=True))
                flags.append(bool(like.similar(len(s), len(t), len(s) + len(t) - 2 * common)))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(flags, pa.bool_())], names=["a", "b", "linked"])

    x = sets.select(F.col("set_id").alias("a"), F.col("elements").alias("x"))
    y = sets.select(F.col("set_id").alias("b"), F.col("elements").alias("y"))
    return edges.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, linked boolean")


def whole_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """set_id, elements (8 bytes each, in order) of one document for each wanted set (doc_id, text_hash, set_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text", CHUNK_BYTES):
                sets, ends = shingle_sets(part.column("text"), shingle)
                raw = sets.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(set_ids(sets, ends)), pa.array([raw[8 * i : 8 * j] for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], names=["set_id", "elements"])

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(wanted, F.expr("doc_id <=> of_doc")).select("text")
    return rows.mapInArrow(run, "set_id long, elements binary").dropDuplicates(["set_id"])


def split_groups(work: Work, big: DataFrame, checked_edges: Callable[[DataFrame, str], DataFrame], chunk: int) -> tuple[DataFrame, DataFrame]:
    """Groups (sig, set_id, band, chunks) with more members than a task should compare, cut up: rows for `candidate_edges`,
    and verified edges (a, b, linked) to each group's pivot, one of its members.

    Members that link to the pivot are connected, and needn't be compared among themselves. Each of the others meets all
    members: they are cut into chunks, the members into chunks, and every two chunks form a group. Where near copies share
    a signature, few are left over, so rows grow with members, not with their square.
    """
    pivot = work.write(big.groupBy("sig").agg(F.min(F.struct(F.xxhash64("set_id").alias("h"), "set_id")).alias("p")).select("sig", F.col("p.set_id").alias("pivot")), "pivot")
    near = big.join(pivot, "sig").filter("set_id <> pivot").select(F.least("set_id", "pivot").alias("a"), F.greatest("set_id", "pivot").alias("b")).distinct()
    near = checked_edges(near, "near")
    both = big.join(pivot, "sig").withColumns({"a": F.least("set_id", "pivot"), "b": F.greatest("set_id", "pivot")}).join(near, ["a", "b"], "left")
    both = work.write(both.select("sig", "set_id", "band", "chunks", "pivot", (F.coalesce("linked", F.lit(False)) | (F.col("set_id") == F.col("pivot"))).alias("inside")), "inside")
    left = work.write(both.filter("not inside").groupBy("sig").agg(F.ceil(F.count("*") / chunk).cast("int").alias("rests")), "rests")
    both = both.join(left, "sig").withColumn("label", F.when(F.col("inside"), F.col("pivot")).otherwise(F.col("set_id")))
    h = F.xxhash64("set_id")
    every = both.withColumns({"c1": F.explode(F.sequence(F.lit(0), F.col("rests") - 1)), "c2": F.pmod(h, "chunks").cast("int")})
    rest = both.filter("not inside").withColumns({"c1": F.pmod(h, "rests").cast("int"), "c2": F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))})
    columns = ["sig", "set_id", "band", "c1", "c2", "label"]
    return every.select(*columns).unionByName(rest.select(*columns)).distinct(), near


def join(docs: DataFrame, chunk: int = CHUNK, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    Documents link if their sets of distinct shingles of `shingle` words (words as in the module `common`, A-Z
    lower-cased; fewer words are one shingle) have a Jaccard similarity of at least `percent` (80 to 99) percent. component_id is the smallest doc_id that links
    reach. Null texts and texts without words have an empty set and link with nothing. Rows that repeat an id count each
    by their own text. A null id is larger than every number as a component_id. An empty table gives no rows. Sets and
    shingles are told apart by 64-bit fingerprints.
    """
    spark = docs.sparkSession
    like = Likeness(percent)
    work = Work(spark, "ngrams")
    parts = tasks_for(spark)
    rows = work.write(set_rows(docs, shingle, like), "sets")
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    # three signatures for every other element that may differ, in two bands at most
    expected = total * 6 * (100 - percent) // (100 + percent)
    signed = signature_parts(docs, shingle, like, max(parts, expected // BUCKET_AIM))
    members = work.write(shared_groups(signed, parts), "members")
    roots = None
    if not members.isEmpty():
        ids = members.select("set_id", "band").distinct()
        by_band = rows.select("set_id", F.col("n_shingles").alias("n"), F.explode("sketches").alias("s")).select("set_id", "n", "s.band", "s.sketch")
        sketched = work.write(by_band.dropDuplicates(["set_id", "band"]).join(ids, ["set_id", "band"], "left_semi"), "sketches")
        of_set = rows.groupBy("set_id").agg(F.min("doc_id").alias("of_doc"))

        def checked_edges(edges: DataFrame, name: str) -> DataFrame:
            """Edges with `linked`; whole sets are made for their ends only, and go again."""
            edges = work.write(edges, f"edges_{name}")
            ends = edges.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
            wanted = work.write(of_set.join(ends, "set_id", "left_semi").select("of_doc").distinct(), f"ends_{name}")
            sets = work.write(whole_sets(docs, wanted, shingle), f"elements_{name}")
            out = work.write(verify(edges, sets, like), f"checked_{name}")
            work.drop(f"edges_{name}", f"ends_{name}", f"elements_{name}")
            return out

        large = members.groupBy("sig").agg(F.count("*").alias("c")).filter(F.col("c") > chunk)
        large = work.write(large.select("sig", F.ceil(F.col("c") / chunk).cast("int").alias("chunks")), "large")
        members, pivots = members.withColumns({"c1": F.lit(0), "c2": F.lit(0), "label": F.col("set_id")}), None
        if not large.isEmpty():
            whole, pivots = split_groups(work, members.select("sig", "set_id", "band").join(large, "sig"), checked_edges, chunk)
            members = work.write(members.join(large.select("sig"), "sig", "left_anti").unionByName(whole), "split")

        def verified(groups: DataFrame, name: str, every: bool) -> DataFrame:
            edges = candidate_edges(groups.join(sketched, ["set_id", "band"]), parts, every, like)
            if every:
                edges = edges.join(checked.select("a", "b"), ["a", "b"], "left_anti")
            return checked_edges(edges, name)

        forest = verified(members, "forest", False)
        checked = forest if pivots is None else forest.unionByName(pivots)
        roots = components(work, checked.filter("linked").select("a", "b"), "stars_forest_")
        label = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        apart = forest.filter("not linked").join(label("a"), "a", "left").join(label("b"), "b", "left")
        apart = work.write(apart.filter(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b"), "apart")
        if not apart.isEmpty():
            mine = lambda c: members.select("sig", "c1", "c2", F.col("set_id").alias(c))
            again = apart.join(mine("a"), "a").join(mine("b"), ["sig", "c1", "c2", "b"]).select("sig", "c1", "c2").distinct()
            groups = members.drop("label").join(again, ["sig", "c1", "c2"], "left_semi").join(label("set_id"), "set_id", "left")
            more = verified(groups.withColumn("label", F.coalesce("set_id_root", "set_id")), "crossing", True)
            if not more.filter("linked").isEmpty():
                links = checked.unionByName(more).filter("linked").select("a", "b")
                roots = components(work, links, "stars_all_")
        work.drop("members", "split", "sketches")
    result = rows.drop("sketches")
    result = result.withColumn("root", F.col("set_id")) if roots is None else result.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    # written before it is joined, so that Spark can split a root with many documents
    first = work.write(result.filter("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("least")), "least")
    return result.join(first, "root", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i : i + 2], ' ')) END) AS x FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
          GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (any_value(na.n) + any_value(nb.n) - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) JOIN least USING (doc_id)
"""
