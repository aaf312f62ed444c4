"""Near-duplicates by shingle similarity, found through wide SimHash fingerprints.

Two texts whose sets of five-word shingles have a Jaccard similarity of 0.8
differ in some 15 of 100 fingerprint bits, so 64 bits within distance 2 miss
nearly all of them.  Here a fingerprint has ``WIDE`` bits over the distinct
shingles of a text:

1. Texts with the same set of shingles become one node (its count, sum and mixed
   sum are its digest), in partial aggregates, so copies never meet.
2. Grids: a node's point in a grid is the bit counts of a random choice of the
   finest segments (a bit each), and it goes to the point's own cell and those
   one step away, as in ``simhash``: points ``STEPS`` steps apart share a cell.
   The number of segments grows with the logarithm of the nodes, so that a cell
   holds about ``LOAD`` of unrelated texts at any size; the number of grids
   follows from it, so that a pair at exactly the threshold shares a cell of one
   grid at least with probability ``FOUND``, and closer pairs more surely.
   Nodes of a cell are linked if the first 128 bits differ in few enough; the
   links' components are the candidates.  A cell that
   very many nodes share is dealt to parts, and whatever does not belong to its
   largest group visits all of them, so it loses no link and no task holds it.
3. Within a candidate component, pairs whose whole fingerprints are near enough
   are verified exactly, nearest first, by the Jaccard similarity of their
   shingles (as 64-bit hashes), unless they are joined already.  A component
   with more shingles than ``BLOCK`` is cut into blocks: blocks are settled each
   for itself, then what stands for their parts, and at last every pair of
   blocks that still has different parts.  So nothing is capped, and no task
   holds more than two blocks.

What the fingerprints can miss is a pair near the threshold: its distance is
binomial, and the limits lie ``SIGMAS`` deviations above the mean.  What is
linked is exact.  Texts without words are alike.  Repeated rows and rows with
null or repeated ids are told apart by their text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismcat.llm._arrow import byte_texts, columns, slices
from prismcat.llm._rows import keep_rows, text_key
from prismcat.llm.simhash import _Parts, cells, majority, runs, shingle_hashes
from prismcat.operators.cluster import connected_components
from prismcat.plans.scratch import Scratch

WORDS, SIMILARITY = 5, 0.8
#: Bits of a fingerprint, and of its part that goes to the cells.
WIDE, SHORT = 512, 128
#: Unrelated nodes in a cell, chance to find a pair at the threshold, deviations above the mean distance.
LOAD, FOUND, SIGMAS = 256, 0.95, 2.5
#: Steps between points that share a cell, their own or one that is a step away, and the place of a grid's number in a cell's.
STEPS, GRID = 2, 48
#: Shingles of the texts that are compared in one task (a text counts EACH more), and fingerprints compared with all others at once.
BLOCK, EACH, FRONT = 400_000, 400, 64
#: Nodes of a part of a cell, about, and of how many nodes one is counted to find the cells that have more.
CELL, SAMPLE = 200_000, 64

_MIX = [np.uint64(((2 * k + 1) * 0x9E3779B97F4A7C15) % (1 << 64) | 1) for k in range(1, WIDE // 64 + 3)]


def bit_rate(similarity: float) -> float:
    """Share of fingerprint bits in which two equally long texts of this Jaccard similarity differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def limit(bits: int, similarity: float) -> int:
    """The distance up to which fingerprints of so many bits are looked at."""
    p = bit_rate(similarity)
    return math.floor(bits * p + SIGMAS * math.sqrt(bits * p * (1 - p)))


def grids(nodes: int, similarity: float, steps: int = 0) -> tuple[int, int]:
    """Segments of a grid, and how many grids, if points up to ``steps`` steps apart share a cell (none: their own cells only)."""
    coords = 4
    while nodes * (1 + coords * (steps > 0)) > LOAD << coords:
        coords += 1
    p = bit_rate(similarity)
    same = sum(math.comb(coords, k) * p**k * (1 - p) ** (coords - k) for k in range(steps + 1))
    return coords, math.ceil(math.log(1 - FOUND) / math.log(1 - same))


def sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, one text after the other, and how many each has."""
    h, sizes = shingle_hashes(texts, words)
    owner = np.repeat(np.arange(len(texts)), sizes)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])[: len(h)]
    return h[new], np.bincount(owner[new], minlength=len(texts))


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    x = (h ^ (h >> np.uint64(32))) * _MIX[lane]
    return (x ^ (x >> np.uint64(29))) * _MIX[-1]


def wide(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprints of WIDE bits, a row of 64-bit lanes each."""
    return np.stack([majority(_mixed(h, k), sizes) for k in range(WIDE // 64)], axis=1)


def _sums(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    upto = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(x, dtype=np.uint64)])
    return np.diff(upto[np.concatenate([[0], np.cumsum(sizes)])])


def fingerprinted(docs: DataFrame, words: int) -> DataFrame:
    """Per row: doc_id, text_key, n (distinct shingles), d0 and d1 (digest of the set), wide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            h, sizes = sets(byte_texts(batch, "text"), words)
            fp = wide(h, sizes).astype("<u8")
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "text_key": batch.column("text_key"),
                    "n": pa.array(sizes.astype(np.int64)),
                    "d0": pa.array(_sums(h, sizes).view(np.int64)),
                    "d1": pa.array(_sums(_mixed(h, -2), sizes).view(np.int64)),
                    "wide": pa.array([r.tobytes() for r in fp], pa.binary()),
                }
            )

    rows = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text")
    return rows.mapInArrow(run, "doc_id long, text_key long, n long, d0 long, d1 long, wide binary")


def _lanes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u8").reshape(len(column), -1)


def near_forest(fp: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Spanning edges among rows of fingerprints that differ in at most ``most`` bits.

    A few rows at a time are compared with all that are left, those of small parts first, until what is left is one part.
    """
    parts, edges = _Parts(len(fp)), []
    left = np.arange(len(fp))
    while len(left) > 1:
        front = left[:FRONT]
        near = sum(np.bitwise_count(fp[front, None, k] ^ fp[None, left, k]).astype(np.int32) for k in range(fp.shape[1])) <= most
        for i, j in zip(*(x.tolist() for x in np.nonzero(near))):
            if j > i and parts.join(int(front[i]), int(left[j])):
                edges.append((int(front[i]), int(left[j])))
        left = left[FRONT:]
        if len(left) > 1 and edges:
            root = np.array([parts.root(x) for x in left.tolist()])
            _, own, size = np.unique(root, return_inverse=True, return_counts=True)
            if len(size) == 1:
                break
            left = left[np.argsort(size[own], kind="stable")]
    return edges


def candidates(nodes: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """(a, b): links between nodes of a cell whose short fingerprints are near."""
    coords, many = grids(nodes.count(), similarity, STEPS)
    picks = np.stack([np.random.default_rng(k).choice(WIDE, coords, replace=False) for k in range(many)])
    most = limit(SHORT, similarity)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                fp = _lanes(part.column("wide"))
                bits = np.unpackbits(fp.view(np.uint8), axis=1, bitorder="little")
                node, f0, f1 = part.column("node").to_numpy(), fp[:, 0].view(np.int64), fp[:, 1].view(np.int64)
                for k, pick in enumerate(picks):
                    own, cell = cells(bits[:, pick].astype(np.int64), 1)
                    yield pa.record_batch({"cell": pa.array(cell + (k << GRID)), "node": pa.array(node[own]), "f0": pa.array(f0[own]), "f1": pa.array(f1[own])})

    def sorted_runs(batches: Iterator[pa.RecordBatch], *columns_: str) -> Iterator[tuple]:
        for cell, node, f0, f1, *more in runs(tuple(b.column(c).to_numpy() for c in ("cell", "node", "f0", "f1", *columns_)) for b in batches):
            fp = np.stack([f0, f1], axis=1).view(np.uint64)
            cuts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(cell)]):
                yield node[a:b], fp[a:b], *(m[a:b] for m in more)

    def linked(pairs: Iterator[tuple[np.ndarray, list]]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        for node, joined in pairs:
            if joined:
                found.append(node[np.array(joined)])
            if len(found) >= 4096:
                yield pa.record_batch(dict(zip("ab", map(pa.array, np.concatenate(found).T.copy()))))
                found = []
        if found:
            yield pa.record_batch(dict(zip("ab", map(pa.array, np.concatenate(found).T.copy()))))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from linked((node, near_forest(fp, most)) for node, fp in sorted_runs(batches))

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from linked((node, meet_guests(fp, label, guest, most)) for node, fp, label, guest in sorted_runs(batches, "label", "guest"))

    def within(rows: DataFrame, run) -> DataFrame:
        return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")

    placed = nodes.select("node", "wide").mapInArrow(spread, "cell long, node long, f0 long, f1 long")
    # cells that many nodes share, by one node in SAMPLE: each is dealt to parts of about CELL rows
    few = nodes.where(F.pmod(F.xxhash64("node", F.lit(5)), F.lit(SAMPLE)) == 0).select("node", "wide").mapInArrow(spread, "cell long, node long, f0 long, f1 long")
    size = F.count(F.lit(1))
    hot = scratch.write(few.groupBy("cell").agg(size.alias("n")).where(F.col("n") >= max(1, CELL // SAMPLE)).select("cell", F.ceil(F.col("n") * SAMPLE / CELL).cast("int").alias("parts")), "hot")
    if hot.isEmpty():
        return within(placed, compare)
    dealt = placed.join(hot, "cell", "left").withColumn("part", F.pmod(F.xxhash64("node", "cell"), F.col("parts")).cast("int"))
    # the parts differ from cell to cell, so a group of copies that is cut in one grid is joined by the others
    first = scratch.write(within(dealt.withColumn("cell", F.when(F.col("parts").isNull(), F.col("cell")).otherwise(F.xxhash64("cell", "part"))).drop("part", "parts"), compare), "near")
    labels = connected_components(first, scratch=scratch).toDF("node", "label")
    rows = dealt.where("parts IS NOT NULL").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rows = scratch.write(rows, "hot_rows")
    # whatever is not of a cell's largest group visits all parts of the cell
    largest = rows.groupBy("cell", "label").agg(size.alias("n")).groupBy("cell").agg(F.max_by("label", F.struct("n", "label")).alias("top"))
    guests = rows.join(largest, "cell").where("label <> top").drop("top", "part").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    both = rows.withColumn("guest", F.lit(0)).unionByName(guests.withColumn("guest", F.lit(1)))
    met = both.select(F.xxhash64("cell", "part").alias("cell"), "node", "f0", "f1", "label", "guest")
    return first.unionByName(scratch.write(within(met, receive), "met"))


def meet_guests(fp: np.ndarray, label: np.ndarray, guest: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Spanning edges between guests and residents of a part that are near and not of one label."""
    parts, edges = _Parts(len(fp)), []
    _, first, own = np.unique(label, return_index=True, return_inverse=True)
    for i, f in enumerate(first[own].tolist()):
        parts.join(f, i)
    visitors, home = np.flatnonzero(guest == 1), np.flatnonzero(guest == 0)
    for at in range(0, len(visitors), FRONT):
        front = visitors[at : at + FRONT]
        near = sum(np.bitwise_count(fp[front, None, k] ^ fp[None, home, k]).astype(np.int32) for k in range(fp.shape[1])) <= most
        for i, j in zip(*(x.tolist() for x in np.nonzero(near & (label[front, None] != label[None, home])))):
            if parts.join(int(front[i]), int(home[j])):
                edges.append((int(front[i]), int(home[j])))
    return edges


def verified(node: np.ndarray, label: np.ndarray, fp: np.ndarray, h: np.ndarray, sizes: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Spanning edges among texts at ``similarity`` or more; those of one label are joined already."""
    if len(node) < 2:
        return []
    most, ends = limit(WIDE, similarity), np.cumsum(sizes)
    parts, edges = _Parts(len(node)), []
    _, first, own = np.unique(label, return_index=True, return_inverse=True)
    for i, f in enumerate(first[own].tolist()):
        parts.join(f, i)

    for at in range(0, len(node), FRONT):
        root = np.array([parts.root(k) for k in range(len(node))])
        if (root == root[0]).all():
            break
        i = np.arange(at, min(at + FRONT, len(node)))
        d = sum(np.bitwise_count(fp[i, None, k] ^ fp[None, :, k]).astype(np.int32) for k in range(fp.shape[1]))
        x, y = np.nonzero((d <= most) & (i[:, None] < np.arange(len(node))) & (root[i][:, None] != root[None]))
        # near enough in length to reach the similarity at all
        fit = np.minimum(sizes[i[x]], sizes[y]) >= similarity * np.maximum(sizes[i[x]], sizes[y])
        d, x, y = d[x, y][fit], i[x][fit], y[fit]
        for k in np.argsort(d, kind="stable").tolist():
            i, j = int(x[k]), int(y[k])
            if parts.root(i) == parts.root(j):
                continue
            both = len(np.intersect1d(h[ends[i] - sizes[i] : ends[i]], h[ends[j] - sizes[j] : ends[j]], assume_unique=True))
            if both >= similarity * (sizes[i] + sizes[j] - both) and parts.join(i, j):
                edges.append((int(node[i]), int(node[j])))
    return edges


def _settle(bodies: DataFrame, keys: list[str], words: int, similarity: float) -> DataFrame:
    """(a, b): verified edges within each group of ``bodies`` (node, label, wide, text)."""

    def run(table: pa.Table) -> pa.Table:
        h, sizes = sets(byte_texts(table, "text"), words)
        node, label = table.column("node").to_numpy(), table.column("label").to_numpy()
        found = verified(node, label, _lanes(table.column("wide")), h, sizes, similarity)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return bodies.select(*keys, "node", "label", "wide", "text").groupBy(*keys).applyInArrow(run, "a long, b long")


def _blocked(bodies: DataFrame) -> DataFrame:
    """``bodies`` with block and blocks: so many that a block has about BLOCK shingles."""
    per = bodies.groupBy("component").agg(F.ceil(F.sum(F.col("n") + EACH) / BLOCK).cast("int").alias("blocks"))
    many = F.greatest(F.col("blocks"), F.lit(1))
    return bodies.join(per, "component").withColumn("blocks", many).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def _relabelled(bodies: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``bodies`` with the smallest label reachable by verified edges (between nodes) and labels."""
    ends = bodies.select("node", "label")
    lines = edges.join(ends.toDF("a", "la"), "a").join(ends.toDF("b", "lb"), "b").select("la", "lb")
    found = connected_components(lines, "la", "lb", scratch).toDF("label", "_to")
    return scratch.write(bodies.join(found, "label", "left").withColumn("label", F.coalesce("_to", "label")).drop("_to"), "labelled")


def classes(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, scratch: Scratch | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, text_key, and class, a number that rows linked by ``similarity`` or more share."""
    scratch = scratch or Scratch(docs.sparkSession, "simhash_wide")
    made = scratch.write(fingerprinted(docs, words), "fingerprints")
    # a node per set of shingles: its row with the smallest key
    nodes = scratch.write(
        made.groupBy("d0", "d1", "n").agg(F.min_by(F.struct("doc_id", "text_key", "wide"), F.struct("text_key", "doc_id")).alias("r"))
        .withColumn("node", F.monotonically_increasing_id()).select("node", "d0", "d1", "n", "r.*"),
        "nodes",
    )
    near = scratch.write(candidates(nodes, similarity, scratch), "candidates")
    loose = connected_components(near, scratch=scratch).toDF("node", "component")
    members = nodes.join(loose, "node").select("node", "component", "n", "wide", F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"))
    texts = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text")
    found = members.join(texts, F.col("_d").eqNullSafe(F.col("doc_id")) & (F.col("_k") == F.col("text_key")))
    bodies = found.groupBy("node", "component", "n", "wide").agg(F.first("text").alias("text"))
    bodies = scratch.write(_blocked(bodies.withColumn("label", F.col("node"))), "bodies")
    edges = scratch.write(_settle(bodies, ["component", "block"], words, similarity), "edges")
    big = bodies.where("blocks > 1")
    if not big.isEmpty():
        big = _relabelled(big, edges, scratch)
        # what stands for the parts of a block, its smallest node
        first = big.groupBy("component", "label").agg(F.min("node").alias("node"))
        stand = scratch.write(_blocked(big.drop("blocks", "block").join(first, ["component", "label", "node"], "left_semi")), "stand")
        more = scratch.write(_settle(stand, ["component", "block"], words, similarity), "edges")
        edges, big = edges.unionByName(more), _relabelled(big, more, scratch)
        # every pair of blocks of a component that is not one part yet
        several = big.groupBy("component").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("component")
        rest = big.join(several, "component", "left_semi")
        others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: k != F.col("block"))
        paired = rest.withColumn("_o", F.explode(others)).withColumn("_x", F.least("block", "_o")).withColumn("_y", F.greatest("block", "_o"))
        edges = edges.unionByName(scratch.write(_settle(paired, ["component", "_x", "_y"], words, similarity), "edges"))
    final = connected_components(edges, scratch=scratch).toDF("node", "class")
    placed = nodes.join(final, "node", "left").select("d0", "d1", "n", F.coalesce("class", "node").alias("class"))
    return made.join(placed, ["d0", "d1", "n"]).select("doc_id", "text_key", "class")


def near_dedup(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each class the smallest doc_id (null last, then by the text's key)."""
    scratch = Scratch(docs.sparkSession, "simhash_wide")
    rows = scratch.write(classes(docs, similarity, words, scratch), "classes")
    scratch.keep_only(rows)
    order = F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("d"), F.col("text_key").alias("k"))
    best = rows.groupBy("class").agg(F.min(order).alias("best"))
    decided = rows.join(best, "class").select("doc_id", "text_key", (F.col("doc_id").eqNullSafe(F.col("best.d")) & (F.col("text_key") == F.col("best.k"))).alias("kept"))
    return keep_rows(docs, scratch.write(decided, "decisions"))
