"""Exact top-k search by pivot-table elimination.

The score of two vectors is their inner product, (|q|^2 + |x|^2 - d(q,x)^2) / 2.
The distances of all vectors to many pivots are computed once and written; by
the triangle inequality the largest difference of two rows of that table is a
lower bound of d, so it bounds the score from above.  Each query takes the
candidates in the order of its own bounds and stops as soon as its k-th score
beats every bound that is left.  The bounds only save work; the result is exact.

Queries are a stated part of the rows; they go in blocks of at most about
``QUERY_BLOCK`` rows, each broadcast once against all candidates.

Vectors that are null or hold null or non-finite components take no part, nor
do rows without vec_id.  Shorter vectors count as padded with zeros.  Rows that
share a query's vec_id are the query's own; a repeated query id stands for its
smallest vector.  Equal scores go to the smaller vec_id.  Where components are
so large that doubles can't hold the products, all are evaluated as whole numbers
of any size; ranks are exact, and a score beyond 64 bits is given as the nearest
one of 64 bits.  Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismcat.llm._arrow import columns
from prismcat.plans.scratch import Scratch

K, SCALE, EVERY = 5, 256.0, 50
#: Pivots, and the bounded sample of rows that they are picked from, each farthest from those before.
PIVOTS, PIVOT_SAMPLE = 64, 4096
#: Queries broadcast at once, vectors in a row of the pivot table, candidates that a query takes at once.
QUERY_BLOCK, TABLE_BLOCK, STEP = 4096, 512, 128
#: Queries that go together within a block.
ROWS = 64


def vectors(embeddings: DataFrame, scale: float = SCALE) -> DataFrame:
    """Usable rows as vec_id, dim, most (the largest component by amount) and x (little-endian doubles that are integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for vid, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding")):
                if vid is None or not v.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all():
                    ids.append(vid)
                    out.append(np.floor(scale * x))
            yield pa.record_batch(
                {
                    "vec_id": pa.array(ids, pa.int64()),
                    "dim": pa.array([len(x) for x in out], pa.int32()),
                    "most": pa.array([float(np.abs(x).max(initial=0)) for x in out], pa.float64()),
                    "x": pa.array([x.astype("<f8").tobytes() for x in out], pa.binary()),
                }
            )

    rows = columns(embeddings, "vec_id", "embedding").withColumn("vec_id", F.col("vec_id").cast("long"))
    return rows.mapInArrow(run, "vec_id long, dim int, most double, x binary")


def _matrix(parts: list[bytes], dim: int) -> np.ndarray:
    out = np.zeros((len(parts), dim))
    for row, p in zip(out, parts):
        v = np.frombuffer(p, dtype="<f8")
        row[: len(v)] = v
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exact below 2 ** 53."""
    return (a @ b.T).astype(np.int64)


def _wide_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows of any size, as Python integers."""
    whole = lambda x: np.array([[int(v) for v in r] for r in x], dtype=object).reshape(x.shape)
    return whole(a) @ whole(b).T


#: Bytes of a sortable score: products of doubles stay below 2 ** 2111 for fewer than 2 ** 40 components.
_WIDTH = 272


def _sortable(score: int) -> bytes:
    return (score + (1 << (8 * _WIDTH - 1))).to_bytes(_WIDTH, "big")


def _distances(a: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * (a @ pivots.T)))


def pivot_table(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``rows`` in blocks: ids, vectors and distances to the pivots."""
    dim = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TABLE_BLOCK):
                part = batch.slice(at, TABLE_BLOCK)
                x = _matrix(part.column("x").to_pylist(), dim)
                cells = (part.column("vec_id").to_numpy().astype("<i8"), x.astype("<f8"), _distances(x, pivots).astype("<f8"))
                yield pa.record_batch([pa.array([c.tobytes()], pa.binary()) for c in cells], names=["ids", "x", "far"])

    return rows.mapInArrow(run, "ids binary, x binary, far binary")


def best(scores, limits, ids, k: int):
    """Of (query, score, id) triples: the k best of each query, and each query's k-th score so far."""
    q, s, i = scores, limits, ids
    order = np.lexsort((i, -s, q))
    q, s, i = q[order], s[order], i[order]
    nth = np.arange(len(q)) - np.searchsorted(q, q)
    keep = nth < k
    return q[keep], s[keep], i[keep], nth[keep]


def search_block(qid: np.ndarray, qx: np.ndarray, qfar: np.ndarray, floor: np.ndarray, ids: np.ndarray, x: np.ndarray, far: np.ndarray, held, k: int, seen: list | None = None):
    """Improve ``held`` (query position ascending, score, id) and ``floor`` (k-th score, or less) by a block of candidates.

    ``seen``, if given, gets the numbers of pairs evaluated.  Queries go ``ROWS`` at a time, what a processor's cache holds.
    """
    size, out = (x * x).sum(1), []
    for a in range(0, len(qid), ROWS):
        rows = slice(a, a + ROWS)
        lo, hi = np.searchsorted(held[0], [a, a + ROWS])
        q, s, i = (h[lo:hi] for h in held)
        q, s, i = _search_rows(qid[rows], qx[rows], qfar[rows], floor[rows], ids, x, size, far, (q - a, s, i), k, seen)
        out.append((q + a, s, i))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else held


def _search_rows(qid, qx, qfar, floor, ids, x, size, far, held, k, seen):
    """Each query takes the candidates in the order of its own bounds, ``STEP`` at a time, and stops at the first bound below its floor."""
    bound, gap = np.zeros((len(qid), len(ids))), np.empty((len(qid), len(ids)))
    for p in range(far.shape[1]):
        np.subtract(qfar[:, p, None], far[None, :, p], out=gap)
        np.maximum(bound, np.abs(gap, out=gap), out=bound)
    # half a unit covers the rounding of the distances
    bound = ((qx * qx).sum(1)[:, None] + size[None] - bound * bound) / 2 * (1 + 1e-12) + 0.5
    active = np.flatnonzero(bound.max(axis=1, initial=-np.inf) >= floor)
    order = np.argsort(-bound[active], axis=1)
    for at in range(0, len(ids), STEP):
        open_ = bound[active, order[:, at]] >= floor[active]
        active, order = active[open_], order[open_]
        if not len(active):
            break
        part = order[:, at : at + STEP]
        worth = np.take_along_axis(bound[active], part, axis=1) >= floor[active, None]
        if seen is not None:
            seen.append(int(worth.sum()))
        got = np.einsum("ad,asd->as", qx[active], x[part]).astype(np.int64)
        a, c = np.nonzero(worth & (got >= floor[active, None]) & (ids[part] != qid[active, None]))
        if len(a):
            new = (active[a], got[a, c], ids[part[a, c]])
            q, s, i, nth = best(*(np.concatenate(z) for z in zip(held, new)), k)
            held = (q, s, i)
            last = nth == k - 1
            floor[q[last]] = np.maximum(floor[q[last]], s[last])
    return held


def farthest(x: np.ndarray, n: int) -> np.ndarray:
    """Positions of ``n`` rows, each farthest from those before."""
    picks = [int(np.argmax((x * x).sum(1)))] if len(x) else []
    near = _distances(x, x[picks]).min(axis=1) if picks else None
    while len(picks) < min(n, len(x)):
        picks.append(int(np.argmax(near)))
        near = np.minimum(near, _distances(x, x[picks[-1:]])[:, 0])
    return np.array(picks, dtype=np.int64)


def top_k(embeddings: DataFrame, k: int = K, every: int = EVERY, scale: float = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by ``every``."""
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "topk")
    rows = scratch.write(vectors(embeddings, scale), "vectors")
    dim, most = rows.agg(F.max("dim"), F.max("most")).first()
    dim, exact = dim or 0, (most or 0.0) * (most or 0.0) * (dim or 0) < 2**53
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "x").limit(PIVOT_SAMPLE).collect()
    drawn = _matrix([r.x for r in chosen], dim)
    picks = farthest(drawn, PIVOTS) if exact else np.zeros(0, dtype=np.int64)
    pivots, pivot_ids = drawn[picks], np.array([r.vec_id for r in chosen], dtype=np.int64)[picks]
    table = scratch.write(pivot_table(rows, pivots), "table")
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("x").alias("x"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    kinds = "query_id long, vec_id long, score long" if exact else "query_id long, vec_id long, score binary"
    results = []
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)) == b).collect()
        qid = np.array([r.vec_id for r in block], dtype=np.int64)
        qx = _matrix([r.x for r in block], dim)
        if not exact:
            results.append(_exhaustive(table, qid, qx, k))
            continue
        # pivots are candidates too: their scores are a first limit
        seeds = np.where(pivot_ids[None] != qid[:, None], _products(qx, pivots), np.iinfo(np.int64).min)
        seeds.sort(axis=1)
        least = seeds[:, -k].copy() if seeds.shape[1] >= k else np.full(len(qid), np.iinfo(np.int64).min)
        sent = spark.sparkContext.broadcast((qid, qx, _distances(qx, pivots), least))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            qid, qx, qfar, least = sent.value
            floor = least.copy()
            held = tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
            for batch in batches:
                for ids, x, far in zip(*(batch.column(c).to_pylist() for c in ("ids", "x", "far"))):
                    ids = np.frombuffer(ids, dtype="<i8")
                    x, far = (np.frombuffer(v, dtype="<f8").reshape(len(ids), -1) for v in (x, far))
                    held = search_block(qid, qx, qfar, floor, ids, x, far, held, k)
            yield pa.record_batch({"query_id": pa.array(qid[held[0]]), "vec_id": pa.array(held[2]), "score": pa.array(held[1])})

        found = table.mapInArrow(run, kinds)
        results.append(found if blocks == 1 else scratch.write(found, "found"))
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    out = found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    return out if exact else out.mapInArrow(_clipped, "query_id long, rank int, vec_id long, score long")


def _exhaustive(table: DataFrame, qid: np.ndarray, qx: np.ndarray, k: int) -> DataFrame:
    """The k best of each task by sortable scores, for components so large that bounds and products in doubles are not exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in qid]
        for batch in batches:
            for ids, x in zip(*(batch.column(c).to_pylist() for c in ("ids", "x"))):
                ids = np.frombuffer(ids, dtype="<i8")
                x = np.frombuffer(x, dtype="<f8").reshape(len(ids), -1)
                for q, scores in enumerate(_wide_products(qx, x)):
                    new = [(-s, i) for s, i in zip(scores.tolist(), ids.tolist()) if i != qid[q]]
                    held[q] = sorted(held[q] + new)[:k]
        rows = [(int(qid[q]), i, _sortable(-s)) for q, best_ in enumerate(held) for s, i in best_]
        yield pa.record_batch([pa.array([r[n] for r in rows], t) for n, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["query_id", "vec_id", "score"])

    return table.mapInArrow(run, "query_id long, vec_id long, score binary")


def _clipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        whole = [int.from_bytes(s, "big") - (1 << (8 * _WIDTH - 1)) for s in batch.column("score").to_pylist()]
        yield batch.set_column(3, "score", pa.array([min(max(s, -(2**63)), 2**63 - 1) for s in whole], pa.int64()))


def op6_top_k(spark, sf_dir: str) -> DataFrame:
    """Contract query: the 5 best of all ``embeddings`` for every 50th vec_id."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE))::DOUBLE[] AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
