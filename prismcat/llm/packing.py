"""Best-fit packing of documents into sequences, with matching of large items.

The plan is made on the histogram of piece lengths, which has at most
``capacity`` entries however many documents there are.  Pieces above a third of
the capacity share a sequence with at most one other of their kind: from the
longest down, each takes the longest partner that still fits.  The shorter
pieces then fill the gaps, from the longest down, each into the tightest gap.
The plan is a list of runs, "of length l, the ranks a to b lie at offset o of
the sequences from s on"; a piece finds its run by its rank among the pieces of
its length.  Ranks come from salted windows over a few bytes per piece, so a
length that a third of all pieces have is no hot group; pieces of full length
are sequences of their own (with negative numbers) and get no rank.

Null and empty texts are documents of their end id alone.  Ids may repeat or be
null.  Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismcat.llm import _tokens
from prismcat.llm._arrow import columns, slices
from prismcat.plans.scratch import Scratch

CAPACITY = 2048
#: Windows per length.  The table of their counts (``CAPACITY * SALTS`` rows at most) goes to the driver.
SALTS = 64
END = b"\0\0\0\0"

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt int"


def pieces(docs: DataFrame, capacity: int, path: str, with_ids: bool = False) -> DataFrame:
    """Documents as ids with end id 0, cut into pieces: doc_id, piece, start, length, ids_crc32, salt (and ids).

    Only a document above ``capacity`` is cut; its pieces are full but the first, which holds what is left over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _tokens.encoder(path)
        for batch in slices(batches):
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text").to_pylist())):
                ids += END
                n = len(ids) // 4
                end, at, piece = n % capacity or capacity, 0, 0
                while at < n:
                    part = ids[4 * at : 4 * end]
                    crc = zlib.crc32(part)
                    rows.append((doc, piece, at, end - at, crc, ((crc * 0x9E3779B1) ^ (doc or 0)) % SALTS, part))
                    at, end, piece = end, end + capacity, piece + 1
            cols = list(zip(*rows))
            out = {f: pa.array(c, t) for (f, t), c in zip(_TYPES, cols)}
            if with_ids:
                out["ids"] = pa.array(cols[6], pa.binary())
            yield pa.record_batch(out)
        enc.rest()

    schema = _PIECES + (", ids binary" if with_ids else "")
    return columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, schema)


_TYPES = (("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("salt", pa.int32()))


def plan(counts: dict[int, int], capacity: int) -> dict[int, list[tuple[int, int, int]]]:
    """Runs by length: (first rank, offset, first sequence), ranks ascending.

    ``counts``: pieces by length.  A group of sequences is alike: the same gap
    and the same lengths inside.  Sequences of a group are numbered on, so each
    group keeps a range of numbers.
    """
    runs: dict[int, list[tuple[int, int, int]]] = {n: [] for n in counts}
    used = dict.fromkeys(counts, 0)
    left = {n: c for n, c in counts.items() if c}
    open_: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, how many)
    gaps: list[int] = []
    total = 0

    def put(n: int, offset: int, first: int, many: int) -> None:
        runs[n].append((used[n], offset, first))
        used[n] += many
        left[n] -= many

    def leave(gap: int, first: int, many: int) -> None:
        if many and gap:
            if gap not in open_:
                bisect.insort(gaps, gap)
                open_[gap] = []
            open_[gap].append((first, many))

    # pieces above a third: greedy matching, at most two to a sequence
    large = sorted(n for n in left if 3 * n > capacity)
    alive = list(large)
    while alive:
        n = alive[-1]
        if not left[n]:
            alive.pop()
            continue
        k = bisect.bisect_right(alive, capacity - n) - 1
        while k >= 0 and not left[alive[k]]:
            alive.pop(k)
            k = bisect.bisect_right(alive, capacity - n) - 1
        if k < 0:
            many = left[n]
            put(n, 0, total, many)
            leave(capacity - n, total, many)
        else:
            m = alive[k]
            many = left[n] // 2 if m == n else min(left[n], left[m])
            if not many:  # the last one of a length that would pair with itself
                k2 = k - 1
                while k2 >= 0 and not left[alive[k2]]:
                    k2 -= 1
                if k2 < 0:
                    put(n, 0, total, 1)
                    leave(capacity - n, total, 1)
                    total += 1
                    continue
                m, many = alive[k2], 1
            put(n, 0, total, many)
            put(m, n, total, many)
            leave(capacity - n - m, total, many)
        total += many
    # the others: longest first into the tightest gap
    for n in sorted((n for n in left if 3 * n <= capacity and left[n]), reverse=True):
        while left[n]:
            k = bisect.bisect_left(gaps, n)
            if k == len(gaps):
                each = capacity // n
                many = max(1, left[n] // each)
                gap, first = capacity, total
                total += many
            else:
                gap = gaps[k]
                first, many = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
                    gaps.pop(k)
                each = gap // n
            full = min(many, left[n] // each)
            if full:
                for j in range(each):
                    put(n, capacity - gap + j * n, first, full)
                leave(gap - each * n, first, full)
            else:
                # fewer pieces than one sequence of the group takes
                rest = left[n]
                for j in range(rest):
                    put(n, capacity - gap + j * n, first, 1)
                leave(gap - rest * n, first, 1)
                full = 1
            leave(gap, first + full, many - full)
    return {n: r for n, r in runs.items() if r}


def assign(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``made`` (a written table of pieces) with sequence_id and offset in place of salt."""
    # full pieces are sequences of their own and need no rank
    full = made.where(F.col("length") == capacity).drop("salt").withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    made = made.where(F.col("length") < capacity)
    table = made.groupBy("length", "salt").count().collect()  # capacity * SALTS rows at most
    counts: dict[int, int] = {}
    bases: dict[tuple[int, int], int] = {}
    for n, salt, many in sorted(table):
        bases[n, salt] = counts.get(n, 0)
        counts[n] = bases[n, salt] + many
    runs = {n: tuple(np.array(c, dtype=np.int64) for c in zip(*r)) for n, r in plan(counts, capacity).items()}
    base = np.zeros((capacity + 1, SALTS), dtype=np.int64)
    for (n, salt), b in bases.items():
        base[n, salt] = b
    shared = made.sparkSession.sparkContext.broadcast((runs, base))
    kept = [c for c in made.columns if c != "salt"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, base = shared.value
        for batch in batches:
            length, salt, nth = (batch.column(c).to_numpy() for c in ("length", "salt", "nth"))
            rank = base[length, salt] + nth - 1
            seq, off = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for part in np.split(order, cuts):
                if len(part):
                    first, offset, number = runs[int(length[part[0]])]
                    k = np.searchsorted(first, rank[part], side="right") - 1
                    seq[part] = number[k] + rank[part] - first[k]
                    off[part] = offset[k]
            cols = {c: batch.column(c) for c in kept}
            yield pa.record_batch(cols | {"sequence_id": pa.array(seq), "offset": pa.array(off)})

    ranked = made.withColumn("nth", F.row_number().over(Window.partitionBy("length", "salt").orderBy("ids_crc32", "doc_id", "piece")))
    kinds = ", ".join(f"{c} {made.schema[c].dataType.simpleString()}" for c in kept)
    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long").unionByName(full)


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    scratch = Scratch(docs.sparkSession, "pack")
    return assign(scratch.write(pieces(docs, capacity, path, with_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, from pieces with ids: sequence_id, n_tokens, ids (little-endian unsigned 32-bit)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return (
        packed.groupBy("sequence_id")
        .agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
        .select("sequence_id", "n_tokens", F.expr("aggregate(parts, X'', (a, p) -> concat(a, p.ids))").alias("ids"))
    )


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Contract query: all ``documents`` in sequences of at most 2048 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
