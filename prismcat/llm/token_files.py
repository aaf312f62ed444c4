"""Token ids in files of patched frame-of-reference blocks.

A shard holds some 1,000,000 ids of whole documents.  Its bytes, little-endian:

    header      8 bytes b"PFORids1", u32 documents, u64 ids, u32 blocks
    documents   i64 doc_id each, u8 null flag each, u64 number of ids each
    index       u64 start of each block, counted from the first block
    blocks      u32 minimum, u8 width, u8 exceptions, u16 ids in the block,
                width * 16 bytes of packed differences from the minimum,
                u8 position and u32 difference of each exception

A block has 128 ids (the last one may have fewer).  Its width holds at least 90
of 100 differences; the others keep their low bits in place and their full
value in the exception list.  Shards are records of a Parquet table, so any
store that Spark writes to will do and a lost executor costs only its own part;
beside the bytes stand the part, the shard's place in it, and its counts.

Documents go in ascending order of doc_id (null first, ties by a hash of the
text).  Null and empty texts have the end id alone.  Extra columns are ignored;
an empty table gives no shards and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismcat.llm import _tokens
from prismcat.llm._arrow import columns, slices
from prismcat.llm._rows import text_key
from prismcat.plans.scratch import Scratch
from prismcat.plans.ship import ship

MAGIC = b"PFORids1"
BLOCK = 128
#: Share of a block's differences that its width holds at least.
FIT = 0.9
SHARD_IDS = 1_000_000
END = struct.pack("<I", 1)

_SHARDS = "part int, shard int, first long, n_docs int, n_ids long, bytes binary"


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value."""
    return np.where(values > 0, np.floor(np.log2(np.maximum(values, 1))).astype(np.int64) + 1, 0)


def encode_blocks(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Block starts and bytes of a sequence of unsigned 32-bit ids."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not blocks:
        return np.zeros(0, dtype=np.uint64), b""
    padded = np.concatenate([ids, np.full(blocks * BLOCK - n, ids[-1], dtype=ids.dtype)]).astype(np.uint32).reshape(blocks, BLOCK)
    least = padded.min(axis=1)
    diff = padded - least[:, None]
    width = _widths(diff.max(axis=1))
    at, most = np.arange(blocks), BLOCK - int(np.ceil(FIT * BLOCK))
    for w in range(int(width.max()) - 1, -1, -1):  # narrower while enough differences fit
        at = at[(width[at] <= w) | ((diff[at] >> np.uint32(w) != 0).sum(axis=1) <= most)]
        width[at] = np.minimum(width[at], w)
        if not len(at):
            break
    over = diff > ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)[:, None]
    n_over = over.sum(axis=1)
    size = 8 + 16 * width + 5 * n_over
    start = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(start[-1], dtype=np.uint8)
    start = start[:-1]
    head = np.zeros(blocks, dtype=[("least", "<u4"), ("width", "u1"), ("over", "u1"), ("count", "<u2")])
    head["least"], head["width"], head["over"], head["count"] = least, width, n_over, BLOCK
    head["count"][-1] = n - (blocks - 1) * BLOCK
    out[start[:, None] + np.arange(8)] = head.view(np.uint8).reshape(blocks, 8)
    for w in np.unique(width).tolist():
        if not w:
            continue
        at = np.flatnonzero(width == w)
        low = (diff[at].T & np.uint32((1 << w) - 1)).astype(np.uint64)
        words = np.zeros((2 * w, len(at)), dtype=np.uint64)
        for j in range(BLOCK):
            k, shift = divmod(j * w, 64)
            words[k] |= low[j] << np.uint64(shift)
            if shift + w > 64:
                words[k + 1] |= low[j] >> np.uint64(64 - shift)
        packed = np.ascontiguousarray(words.T).astype("<u8").view(np.uint8)
        out[(start[at] + 8)[:, None] + np.arange(16 * w)] = packed
    if n_over.any():
        row, col = np.nonzero(over)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n_over) - n_over, n_over)
        base = start[row] + 8 + 16 * width[row]
        out[base + nth] = col
        full = diff[row, col].astype("<u4").view(np.uint8).reshape(-1, 4)
        out[(base + n_over[row] + 4 * nth)[:, None] + np.arange(4)] = full
    return start.astype(np.uint64), out.tobytes()


def decode_blocks(start: np.ndarray, data: bytes) -> np.ndarray:
    """The ids of blocks that begin at ``start``; any part of a shard's index will do."""
    blocks = len(start)
    if not blocks:
        return np.zeros(0, dtype=np.uint32)
    raw = np.frombuffer(data, dtype=np.uint8)
    start = start.astype(np.int64)
    head = raw[start[:, None] + np.arange(8)].copy().view([("least", "<u4"), ("width", "u1"), ("over", "u1"), ("count", "<u2")]).reshape(-1)
    width, n_over = head["width"].astype(np.int64), head["over"].astype(np.int64)
    diff = np.zeros((blocks, BLOCK), dtype=np.uint32)
    for w in np.unique(width).tolist():
        if not w:
            continue
        at = np.flatnonzero(width == w)
        words = np.ascontiguousarray(raw[(start[at] + 8)[:, None] + np.arange(16 * w)].view("<u8").T)
        mask = np.uint64((1 << w) - 1)
        low = np.empty((BLOCK, len(at)), dtype=np.uint32)
        for j in range(BLOCK):
            k, shift = divmod(j * w, 64)
            x = words[k] >> np.uint64(shift)
            if shift + w > 64:
                x = x | (words[k + 1] << np.uint64(64 - shift))
            low[j] = x & mask
        diff[at] = low.T
    if n_over.any():
        row = np.repeat(np.arange(blocks), n_over)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n_over) - n_over, n_over)
        base = start[row] + 8 + 16 * width[row]
        full = raw[(base + n_over[row] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4").reshape(-1)
        diff[row, raw[base + nth]] = full
    ids = diff + head["least"][:, None]
    if (head["count"] == BLOCK).all():
        return ids.reshape(-1)
    return ids[np.arange(BLOCK) < head["count"][:, None]]


def make_shard(docs: list[int | None], ids: list[bytes]) -> bytes:
    """A shard of whole documents."""
    start, blocks = encode_blocks(np.frombuffer(b"".join(ids), dtype="<u4"))
    return b"".join(
        (
            MAGIC,
            struct.pack("<IQI", len(docs), sum(map(len, ids)) // 4, len(start)),
            np.array([d or 0 for d in docs], dtype="<i8").tobytes(),
            bytes(d is None for d in docs),
            np.array([len(x) // 4 for x in ids], dtype="<u8").tobytes(),
            start.astype("<u8").tobytes(),
            blocks,
        )
    )


def read_shard(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, numbers of ids, and all ids of a shard."""
    if data[:8] != MAGIC:
        raise ValueError("not a shard of token ids")
    n, n_ids, blocks = struct.unpack_from("<IQI", data, 8)
    at = 24
    docs = np.frombuffer(data, "<i8", n, at).tolist()
    null = data[at + 8 * n : at + 9 * n]
    sizes = np.frombuffer(data, "<u8", n, at + 9 * n).astype(np.int64)
    start = np.frombuffer(data, "<u8", blocks, at + 17 * n)
    ids = decode_blocks(start, data[at + 17 * n + 8 * blocks :])
    if len(ids) != n_ids:
        raise ValueError("a shard's blocks do not hold its ids")
    return [None if z else d for d, z in zip(docs, null)], sizes, ids


def write_tokens(docs: DataFrame, out: str, path: str | None = None) -> None:
    """Encode every text with an end id after it and write the shards to the folder ``out``."""
    ship(docs.sparkSession)
    path = path or public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = _tokens.encoder(path), TaskContext.get().partitionId()
        names, ids, held, shard, first = [], [], 0, 0, 0

        def closed() -> pa.RecordBatch:
            row = (part, shard, first, len(names), held, make_shard(names, ids))
            return pa.record_batch([pa.array([v], t) for v, t in zip(row, _KINDS)], names=_NAMES)

        for batch in slices(batches):
            for doc, got in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text").to_pylist())):
                names.append(doc)
                ids.append(got + END)
                held += len(got) // 4 + 1
                if held >= SHARD_IDS:
                    yield closed()
                    first, shard, held = first + held, shard + 1, 0
                    names, ids = [], []
        if names:
            yield closed()
        enc.rest()

    rows = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("tie"), "text")
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    rows.mapInArrow(run, _SHARDS).write.option("compression", "uncompressed").parquet(out)


_KINDS = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
_NAMES = ["part", "shard", "first", "n_docs", "n_ids", "bytes"]


def read_tokens(spark: SparkSession, out: str, with_ids: bool = True) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (and ids)."""
    ship(spark)
    shards = spark.read.schema(_SHARDS).parquet(out)
    # one row per part, as many as the writing job had tasks
    before, bases = 0, {}
    for part, n in sorted(tuple(r) for r in shards.groupBy("part").agg(F.sum("n_ids")).collect()):
        bases[part], before = before, before + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pydict()
                docs, sizes, ids = read_shard(row["bytes"][0])
                raw = ids.astype("<u4").tobytes()
                ends = np.cumsum(sizes)
                parts = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), sizes.tolist())]
                cols = {
                    "doc_id": pa.array(docs, pa.int64()),
                    "start": pa.array(bases[row["part"][0]] + row["first"][0] + ends - sizes),
                    "n_tokens": pa.array(sizes),
                    "ids_crc32": pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                }
                yield pa.record_batch(cols | ({"ids": pa.array(parts, pa.binary())} if with_ids else {}))

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return shards.select("part", "first", "bytes").mapInArrow(run, schema)


def op9_token_files(spark, sf_dir: str) -> DataFrame:
    """Contract query: all ``documents`` written and read back."""
    scratch = Scratch(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch.base)
    scratch.until_exit()
    return read_tokens(spark, scratch.base, with_ids=False)
