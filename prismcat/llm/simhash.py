"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint's 64 bits are cut into segments, and the bit counts of the
segments are a point of a grid.  Two fingerprints that differ in d bits have
points at Manhattan distance d or less, so points within ``distance`` are found
first and fingerprints are compared afterwards.  For distances up to 2 every
such pair of points shares a cell among the points themselves and their
neighbours one step away: each distinct fingerprint goes to its own cell and
its 2 * SEGMENTS neighbour cells, and cells are the key of the range join.

Cells are sorted and streamed; a cell's fingerprints are split by runs of equal
bits until few are left to compare, and only the edges that join parts not yet
joined are kept, so a cell of n fingerprints gives n - 1 edges at most, never
all pairs.  Copies share a fingerprint and meet only in partial aggregates.  The
edges' components come from the library's own distributed operator.

Documents that share most of their shingles, but whose fingerprints of 64 bits
differ in more than two, are the business of ``simhash_wide``.

Texts without words (null and empty ones too) have fingerprint zero and are
linked like any other.  A null doc_id never names a component unless the whole
component has none.  Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismcat.llm._arrow import byte_texts, columns, slices
from prismcat.llm._rows import text_key
from prismcat.operators.cluster import connected_components
from prismcat.plans.scratch import Scratch

SEED = 42
#: Words in a shingle, and segments of the 64 bits.
WORDS, SEGMENTS = 3, 16
#: Fingerprints that are compared all with all at once.
AT_ONCE = 256


def _counts(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each run of hashes from ``starts`` on: how often each of the 64 bits is set."""
    n = len(h)
    # byte lanes hold up to 255, so runs are cut into parts of at most 255
    sizes = np.diff(np.append(starts, n))
    parts = -(-sizes // 255)
    first = np.repeat(np.cumsum(parts) - parts, parts)
    at = np.repeat(starts, parts) + 255 * (np.arange(parts.sum()) - first)
    groups = np.cumsum(parts) - parts
    lanes = np.uint64(0x0101010101010101)
    out = np.empty((len(starts), 8, 8), dtype=np.int64)
    for shift in range(8):
        sums = np.add.reduceat((h >> np.uint64(shift)) & lanes, at)
        out[:, :, shift] = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), groups, axis=0)
    return out.reshape(-1, 64)


def shingle_hashes(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of the shingles of all texts, repeats included, one text after the other, and how many each has."""
    import xxhash

    digests, sizes = [], []
    for text in texts:
        w = text.lower().split()
        if len(w) > words:
            shingles = map(b" ".join, zip(*(w[i:] for i in range(words))))
        else:
            shingles = [b" ".join(w)] if w else []
        got = list(map(xxhash.xxh64_digest, shingles, repeat(SEED)))
        sizes.append(len(got))
        digests.append(b"".join(got))
    return np.frombuffer(b"".join(digests), dtype=">u8").astype(np.uint64), np.array(sizes, dtype=np.int64)


def majority(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The 64 bits that are set in over half of each run of hashes; zero for an empty run."""
    out = np.zeros(len(sizes), dtype=np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        bits = 2 * _counts(h, (np.cumsum(sizes) - sizes)[full]) > sizes[full, None]
        out[full] = np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(-1)
    return out


def fingerprints(texts: list[bytes], words: int = WORDS) -> np.ndarray:
    """Unsigned 64-bit fingerprints of whole texts."""
    return majority(*shingle_hashes(texts, words))


def fingerprinted(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Per row of ``docs``: doc_id, text_key, fp (the fingerprint's bits as a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fp = fingerprints(byte_texts(batch, "text"), words).view(np.int64)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "text_key": batch.column("text_key"), "fp": pa.array(fp)})

    rows = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text")
    return rows.mapInArrow(run, "doc_id long, text_key long, fp long")


def embed(fp: np.ndarray) -> np.ndarray:
    """Bits per segment, one row per fingerprint."""
    each = 64 // SEGMENTS
    seg = (fp[:, None] >> (np.arange(SEGMENTS, dtype=np.uint64) * np.uint64(each))) & np.uint64((1 << each) - 1)
    return np.bitwise_count(seg).astype(np.int64)


def cells(points: np.ndarray, each: int = 64 // SEGMENTS) -> tuple[np.ndarray, np.ndarray]:
    """(index, cell) for every point's own cell and those one step away; a cell is a hash-free packed long.

    Points are bit counts of segments of ``each`` bits, a row each.
    """
    bits = np.int64(each.bit_length())  # a count of 0..each needs so many bits
    place = np.int64(1) << (np.arange(points.shape[1], dtype=np.int64) * bits)
    own = points @ place
    idx, cells = [np.arange(len(points))], [own]
    for s in range(points.shape[1]):
        for step in (-1, 1):
            ok = np.flatnonzero((points[:, s] + step >= 0) & (points[:, s] + step <= each))
            idx.append(ok)
            cells.append(own[ok] + step * place[s])
    return np.concatenate(idx), np.concatenate(cells)


class _Parts:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def link(fp: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the graph that joins distinct fingerprints at ``distance`` bits or fewer.

    The free bits are cut into ``distance`` + 1 runs; near fingerprints agree in one run at least, so those that agree
    are looked at again with that run's bits no longer free, until a set is small enough to be compared at once or has
    so few free bits that all of it is near.  Memory is a few numbers per fingerprint.
    """
    parts, edges = _Parts(len(fp)), []

    def join(x: np.ndarray, y: np.ndarray) -> None:
        for i, j in zip(x.tolist(), y.tolist()):
            if parts.join(i, j):
                edges.append((i, j))

    todo = [(np.arange(len(fp)), tuple(range(64)))]
    while todo:
        at, free = todo.pop()
        if len(free) <= distance:
            join(at[:-1], at[1:])
        elif len(at) <= AT_ONCE:
            i, j = np.nonzero(np.triu(np.bitwise_count(fp[at, None] ^ fp[None, at]) <= distance, 1))
            join(at[i], at[j])
        elif len({parts.root(x) for x in at.tolist()}) > 1:
            for run in np.array_split(np.array(free), distance + 1):
                value = fp[at] & np.bitwise_or.reduce(np.uint64(1) << run.astype(np.uint64))
                order = np.argsort(value, kind="stable")
                cuts = np.flatnonzero(np.diff(value[order])) + 1
                rest = tuple(sorted(set(free) - set(run.tolist())))
                todo += [(at[g], rest) for g in np.split(order, cuts) if len(g) > 1]
    return edges


def edges(distinct: DataFrame, distance: int = 2) -> DataFrame:
    """(a, b): edges between distinct fingerprints ``fp``, with the components of all links."""
    if not 0 < distance <= 2:
        raise ValueError("cells one step away cover distances of 1 and 2")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            for at in range(0, len(fp), 16_384):
                part = fp[at : at + 16_384]
                idx, cell = cells(embed(part.view(np.uint64)))
                yield pa.record_batch({"cell": pa.array(cell), "fp": pa.array(part[idx])})

    def settled(cell: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        sizes = np.diff(np.append(cuts, len(cell)))
        # most cells with company have two fingerprints: those at once
        two = cuts[sizes == 2]
        near = two[np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= distance]
        found = [(fp[near], fp[near + 1])]
        for a, n in zip(cuts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            part = fp[a : a + n]
            if joined := link(part.view(np.uint64), distance):
                x, y = np.array(joined).T
                found.append((part[x], part[y]))
        x, y = (np.concatenate(z) for z in zip(*found))
        if len(x):
            yield pa.record_batch({"a": pa.array(x), "b": pa.array(y)})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, fp in runs((b.column("cell").to_numpy(), b.column("fp").to_numpy()) for b in batches):
            yield from settled(cell, fp)

    placed = distinct.select("fp").mapInArrow(spread, "cell long, fp long")
    return placed.repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(compare, "a long, b long")


def runs(parts: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """Column arrays sorted by the first one, cut anew so that no run of equal keys is torn; one open run is held."""
    held: list[tuple[np.ndarray, ...]] = []
    for cols in parts:
        if not len(cols[0]):
            continue
        if held and cols[0][-1] == held[0][0][-1]:
            held.append(cols)
            continue
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        if held or cut:
            yield tuple(np.concatenate(c) for c in zip(*held, tuple(c[:cut] for c in cols)))
        held = [tuple(c[cut:] for c in cols)]
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))


def components(docs: DataFrame, distance: int = 2, words: int = WORDS) -> DataFrame:
    """Per row of ``docs``: doc_id, fp, text_key, component_id."""
    scratch = Scratch(docs.sparkSession, "simhash")
    made = scratch.write(fingerprinted(docs, words), "fingerprints")
    distinct = scratch.write(made.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "distinct")
    joined = scratch.write(edges(distinct, distance), "edges")
    classes = connected_components(joined)
    members = scratch.write(distinct.join(classes, F.col("fp") == F.col("node")).select("fp", "first", "component"), "members")
    least = scratch.write(members.groupBy("component").agg(F.min("first").alias("component_id")), "least")
    # fingerprints of which a document can be in company
    shared = scratch.write(
        members.join(least, "component").select("fp", "component_id")
        .unionByName(distinct.where("n > 1").join(classes, F.col("fp") == F.col("node"), "left_anti").select("fp", F.col("first").alias("component_id"))),
        "shared",
    )
    scratch.drop(joined, members, least)
    return made.join(shared.withColumn("_in", F.lit(True)), "fp", "left").select(
        "doc_id", "fp", "text_key", F.when(F.col("_in"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    """Contract query: fingerprint and component of every row of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
