"""Exact deduplication by content-defined chunk recipes.

Each text, without the deleted white space, is cut into chunks where a rolling
hash of its own bytes says so.  Chunks are deduplicated to identifiers, 64-bit
hashes verified against SHA-256 digests; a document becomes its ordered list of
identifiers, and equal lists mean equal texts.  Texts are read once and never
shuffled: what moves is about 50 bytes per chunk.

Null or empty texts have the empty recipe and form one group.  Ties on length
go to the smallest doc_id (null last), then to any one row.  Extra columns of
the input are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismcat.llm._arrow import byte_texts, columns, slices
from prismcat.llm._rows import keep_rows, text_key
from prismcat.plans.scratch import Scratch

#: Deleted before comparing: space and the ASCII controls tab to carriage return.
WHITE = b" \t\n\x0b\x0c\r"
#: Chunk lengths in bytes: least, most; on average about ``LEAST + 2 ** BITS``.
LEAST, MOST, BITS = 512, 16_384, 11

_RECIPES = "doc_id long, row long, text_key long, n_chars long, text_sha256 string, ids array<long>, digests array<binary>"


def _table() -> np.ndarray:
    """One odd 32-bit number per byte value, by a multiplicative rule."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return ((x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def _candidates(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Ends of possible chunks: where a hash of the last 16 bytes has BITS zero bits at its top."""
    h = table[data]
    for step in (1, 2, 4, 8):
        nxt = h.copy()
        nxt[step:] += h[:-step] << np.uint32(step)
        h = nxt
    return np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + 1


def cut(texts: list[bytes]) -> list[list[int]]:
    """Chunk ends of each text, the last one its length; none for an empty text."""
    if not texts:
        return []
    ends = np.cumsum([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    found = _candidates(data, _table()) if len(data) else np.zeros(0, dtype=np.int64)
    lo = np.searchsorted(found, ends - [len(t) for t in texts], side="right")
    hi = np.searchsorted(found, ends, side="left")
    out = []
    for text, end, a, b in zip(texts, ends.tolist(), lo.tolist(), hi.tolist()):
        size, last, cuts = len(text), 0, []
        for p in [*(found[a:b] - (end - size)).tolist(), size]:
            while p - last > MOST:
                last += MOST
                cuts.append(last)
            if p - last >= LEAST or (p == size and p > last):
                last = p
                cuts.append(p)
        out.append(cuts)
    return out


def recipes(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, row, text_key, n_chars, text_sha256, and its chunks' ids and digests in order."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw = byte_texts(batch, "text")
            texts = [t.translate(None, WHITE) for t in raw]
            ids, digests = [], []
            for text, cuts in zip(texts, cut(texts)):
                chunks = [text[a:b] for a, b in zip([0, *cuts], cuts)]
                ids.append([xxhash.xxh3_64_intdigest(c) - (1 << 63) for c in chunks])
                digests.append([hashlib.sha256(c).digest() for c in chunks])
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "row": batch.column("row"),
                    "text_key": batch.column("text_key"),
                    "n_chars": batch.column("n_chars"),
                    "text_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                    "ids": pa.array(ids, pa.list_(pa.int64())),
                    "digests": pa.array(digests, pa.list_(pa.binary())),
                }
            )

    rows = columns(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        text_key(F.col("text")).alias("text_key"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
        "text",
    )
    return rows.mapInArrow(run, _RECIPES)


def decide(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, text_key."""
    scratch = Scratch(docs.sparkSession, "exact")
    made = scratch.write(recipes(docs), "recipes")
    chunks = made.select(F.explode(F.arrays_zip("ids", "digests")).alias("c")).select("c.ids", "c.digests")
    clashes = chunks.groupBy("ids").agg(F.min("digests").alias("a"), F.max("digests").alias("b")).where("a <> b")
    # a 64-bit identifier that stands for two different chunks: then the digests are the identifiers
    recipe = "ids" if clashes.isEmpty() else "digests"
    rows = made.select("doc_id", "row", "text_key", "n_chars", "text_sha256", F.col(recipe).alias("recipe"))
    rows = rows.withColumn("recipe_key", F.xxhash64("recipe"))
    best = F.max_by(F.struct("doc_id", "row"), F.struct("n_chars", -F.col("doc_id"), -F.col("row")))
    groups = scratch.write(
        rows.groupBy("recipe_key", "recipe")
        .agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))
        .where("group_size > 1")
        .select("recipe_key", "recipe", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row")),
        "groups",
    )
    return rows.join(groups, ["recipe_key", "recipe"], "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.coalesce("keep_row", "row") == F.col("row")).alias("kept"),
        "text_sha256",
        "text_key",
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts, with all their columns."""
    decisions = Scratch(docs.sparkSession, "exact").write(decide(docs).select("doc_id", "text_key", "kept"), "decisions")
    return keep_rows(docs, decisions)


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: a decision for every row of ``documents``."""
    return decide(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_key")


OP5_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), w AS (
  SELECT doc_id, norm, n,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w
"""
