"""Removal of repeated substrings by range-partitioned, sampled suffixes.

A byte goes if it lies in a string of ``WINDOW`` bytes that also starts in a
document with a smaller doc_id.  Suffixes are taken where a window's minimizer,
the leftmost ``GRAM``-byte string of smallest hash, begins: equal windows have
their minimizer at the same place, so nothing is lost, and only one suffix in
some seventeen is handled.

1. Texts are packed into blocks, written as a table bucketed by block, so that
   later steps meet a block without moving its text.
2. Screen: hashes of the suffixes' leading bytes, 32 bits within a bucket, tell
   which may occur in several documents.  False alarms cost work, no result.
3. The suffixes left, as strings of all windows with that minimizer, once per
   distinct string of a block, go to ranges of their leading bytes.  The
   splitters come from a bounded sample of blocks.  A leading string that is
   hot in the sample goes window by window, to ranges by the window's hash, so
   equal windows still meet although no range holds the whole group.
4. Each range sorts its strings by multikey quicksort, eight bytes at a time,
   and finds for every window whether a smaller doc_id has it.  A splitter is a
   whole leading string, so strings on both sides of a boundary differ in their
   leading bytes: a comparison across it could find nothing, and a test holds
   that equal windows never meet a boundary.
5. Blocks get one bit per window back and remove the bytes.

A null doc_id is larger than any other; rows that share a doc_id don't make
each other go.  Null and empty texts have no bytes.  Extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismcat.llm._arrow import byte_texts, columns, slices
from prismcat.plans.scratch import Scratch

WINDOW, GRAM = 50, 16
#: Bytes of text in a block; a longer text is a block of its own.
BLOCK = 2 << 20
#: Bytes that suffixes are taken from at once.
PIECE = 64 << 10
#: Blocks that splitters and hot leading strings are sampled from at most; ranges and buckets per shuffle partition.
SAMPLE_BLOCKS, PER_PARTITION = 48, 4
#: A leading string is hot with this share of a range's fair part, and so many strings in the sample.
HOT_SHARE, HOT_LEAST = 0.25, 16
#: Segments that a plain sort finishes.
SMALL = 4096
#: Suffixes that share the 32-bit keys of a bucket at most, about.
PER_BUCKET = 1 << 28
NO_DOC = np.iinfo(np.int64).max

_POS = np.uint64((1 << 26) - 1)
_ODD = [np.uint64(((k * 2 + 1) * 0x9E3779B97F4A7C15) % (1 << 64) | 1) for k in range(1, 6)]


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the ``gram`` bytes from each position on (a power of two; beyond the end: zeros)."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _ODD[0]
    h ^= h >> np.uint64(31)
    n = 1
    while n < gram:
        ahead = np.zeros_like(h)
        ahead[: max(0, len(h) - n)] = h[n:]
        h = (h * _ODD[1] ^ (h >> np.uint64(29))) + ahead * _ODD[2]
        n *= 2
    h *= _ODD[3]
    return h ^ (h >> np.uint64(32))


def _suffixes(data: np.ndarray, sizes: np.ndarray):
    """Minimizers of all windows inside the texts of ``data``: hash, position, first window, windows, text number."""
    n = len(data)
    if n < WINDOW:
        return _NONE
    h = gram_hashes(data)
    least = (h & ~_POS) | np.arange(n, dtype=np.uint64)
    span, done = WINDOW - GRAM + 1, 1
    while done < span:
        step = min(done, span - done)
        np.minimum(least[: n - step], least[step:], out=least[: n - step])
        done += step
    ends = np.cumsum(sizes)
    # windows that start in the last WINDOW - 1 bytes of a text leave it
    full = sizes > 0
    stops = np.bincount(np.maximum(ends - sizes, ends - WINDOW + 1)[full], minlength=n + 1) - np.bincount(ends[full], minlength=n + 1)
    window = np.flatnonzero(np.cumsum(stops[:n]) == 0)
    if not len(window):
        return _NONE
    at = (least[window] & _POS).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1)]))
    pos, first = at[new], window[new]
    return h[pos], pos, first, np.diff(np.append(new, len(at))), np.searchsorted(ends, first, side="right")


_NONE = (np.zeros(0, dtype=np.uint64), *(np.zeros(0, dtype=np.int64) for _ in range(4)))


def suffixes(data: np.ndarray, sizes: np.ndarray):
    """The same in pieces small enough for a processor's cache: several whole texts, or part of a long one.

    Parts of a long text overlap by a window less one byte, so each window lies in one part and none is lost.
    """
    ends = np.cumsum(sizes)
    found, a = [], 0
    while a < len(sizes):
        byte = int(ends[a] - sizes[a])
        b = max(a + 1, int(np.searchsorted(ends, byte + PIECE, side="right")))
        stop = int(ends[b - 1])
        for at in range(byte, stop, PIECE) if b == a + 1 else [byte]:
            end = min(at + PIECE + WINDOW - 1, stop) if b == a + 1 else stop
            own = np.array([end - at]) if b == a + 1 else sizes[a:b]
            h, pos, first, many, of = _suffixes(data[at:end], own)
            found.append((h, pos + at, first + at, many, of + a))
        a = b
    return tuple(np.concatenate(x) for x in zip(*found)) if found else _NONE


class Block:
    """Texts of a block with their suffixes."""

    def __init__(self, row: dict):
        self.ids = row["docs"]
        self.docs = np.array([NO_DOC if d is None else d for d in self.ids], dtype=np.int64)
        self.sizes = np.frombuffer(row["sizes"], dtype="<u4").astype(np.int64)
        self.text = row["text"]
        self.data = np.frombuffer(self.text, dtype=np.uint8)
        self.hash, self.pos, self.first, self.many, self.of = suffixes(self.data, self.sizes)

    def keys(self) -> np.ndarray:
        """Distinct hashes, twice those that several documents of the block have."""
        order = np.lexsort((self.docs[self.of], self.hash))
        h, d = self.hash[order], self.docs[self.of][order]
        new = np.append(True, h[1:] != h[:-1])[: len(h)]
        several = np.unique(h[1:][~new[1:] & (d[1:] != d[:-1])])
        return np.concatenate([h[new], several])

    def strings(self, shared: np.ndarray, buckets: int, hot: np.ndarray):
        """Distinct strings of the suffixes left, in order of their first place.

        Returns the strings, their leading bytes' hash and place (-1 for a window of a hot one), the smallest doc of
        each, and all places: string number, document, first window.
        """
        at = np.flatnonzero(np.isin(joined(*split(self.hash, buckets)), shared))
        burst = np.isin(self.hash[at], hot)
        text, number = self.text, {}
        setdefault = number.setdefault
        plain = at[~burst]
        ends = (self.first + self.many + WINDOW - 1)[plain]
        n = [setdefault(text[a:b], len(number)) for a, b in zip(self.first[plain].tolist(), ends.tolist())]
        n_plain = len(number)
        many = self.many[at[burst]]
        owner = np.repeat(at[burst], many)
        start = self.first[owner] + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        windows: dict[bytes, int] = {}
        setdefault = windows.setdefault
        n += [n_plain + setdefault(text[a : a + WINDOW], len(windows)) for a in start.tolist()]
        n = np.array(n, dtype=np.int64)
        doc = self.docs[self.of[np.concatenate([plain, owner])]]
        first = np.concatenate([self.first[plain], start])
        lead = np.concatenate([(self.pos - self.first)[plain], np.full(len(start), -1)])
        strings = [*number, *windows]
        own = np.zeros(len(strings), dtype=np.int64)
        own[n[::-1]] = np.arange(len(n))[::-1]
        order = np.argsort(n, kind="stable")
        least = np.minimum.reduceat(doc[order], np.searchsorted(n[order], np.arange(len(strings)))) if len(n) else doc
        return strings, lead[own], least, n, doc, first


def split(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 32-bit key of a hash."""
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), h.astype(np.uint32)


def joined(bucket: np.ndarray | int, key: np.ndarray) -> np.ndarray:
    """Bucket and key as one number."""
    return (np.asarray(bucket).astype(np.uint64) << np.uint64(32)) | key.astype(np.uint64)


def _words(data: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Eight bytes from each place on as a number that sorts like them, only the first ``n`` of them."""
    w = data[at[:, None] + np.arange(8)].view(">u8").reshape(-1).astype(np.uint64)
    return w if n >= 8 else w >> np.uint64(8 * (8 - n)) << np.uint64(8 * (8 - n))


def multikey(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of the strings of ``length`` bytes at ``at``, eight bytes to a character.

    A segment whose strings agree in all characters before is cut in three by a pivot: those below and above it are
    cut again by the same character, those equal to it by the next one.  Segments of up to SMALL strings are ordered by
    one plain sort of the character, all at once.  Returns an order with equal strings together and each one's group
    number in it, the place where the group begins.
    """
    order, group = np.arange(len(at)), np.zeros(len(at), dtype=np.int64)
    todo = [(0, len(at), 0)] if len(at) else []
    small: list[tuple[int, int, int]] = []
    while todo:
        lo, hi, k = todo.pop()
        if k >= length or hi - lo == 1:
            group[lo:hi] = lo
            continue
        if hi - lo <= SMALL:
            small.append((lo, hi, k))
            continue
        part = order[lo:hi]
        w = _words(data, at[part] + k, length - k)
        pivot = np.sort(w[:: max(1, len(w) // 63)])[len(w[:: max(1, len(w) // 63)]) // 2]
        below, above = w < pivot, w > pivot
        n, m = int(below.sum()), int(above.sum())
        order[lo:hi] = np.concatenate([part[below], part[~(below | above)], part[above]])
        todo += [(x, y, z) for x, y, z in ((lo, lo + n, k), (lo + n, hi - m, k + 8), (hi - m, hi, k)) if x < y]
    by: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for k in range(0, length, 8):
        if own := [(lo, hi) for lo, hi, at_ in small if at_ == k]:
            lo, hi = zip(*own)
            by.setdefault(k, []).append((np.array(lo), np.array(hi)))
        if k not in by:
            continue
        begin, end = (np.concatenate(x) for x in zip(*by[k]))
        size = end - begin
        part = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        own = np.repeat(np.arange(len(size)), size)
        w = _words(data, at[order[part]] + k, length - k)
        o = np.lexsort((w, own))
        order[part], w = order[part[o]], w[o]
        cuts = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (w[1:] != w[:-1])]))
        many = np.diff(np.append(cuts, len(part)))
        group[part] = np.repeat(part[cuts], many)
        more = many > 1
        if k + 8 < length and more.any():
            by.setdefault(k + 8, []).append((part[cuts[more]], part[cuts[more]] + many[more]))
    return order, group


def smaller(text: bytes, size: np.ndarray, lead: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For strings of a range, one after the other in ``text``: bit k says that window k occurs with a smaller doc."""
    if not len(size):
        return np.zeros(0, dtype=np.uint64)
    ends = np.cumsum(size)
    number: dict[bytes, int] = {}
    setdefault = number.setdefault
    n = np.array([setdefault(text[a:b], len(number)) for a, b in zip((ends - size).tolist(), ends.tolist())], dtype=np.int64)
    order = np.argsort(n, kind="stable")
    cuts = np.searchsorted(n[order], np.arange(len(number)))
    least = np.minimum.reduceat(docs[order], cuts)
    own = order[cuts]
    # distinct strings; those that share their leading bytes are compared window by window
    start, length = (ends - size)[own], size[own]
    data = np.frombuffer(text + b"\0" * 64, dtype=np.uint8)
    order, group = multikey(data, start + np.maximum(lead[own], 0), GRAM)
    cuts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    count = np.diff(np.append(cuts, len(order)))
    differ = np.minimum.reduceat(least[order], cuts) != np.maximum.reduceat(least[order], cuts)
    part = order[np.repeat((count > 1) & differ, count)]
    bits = np.zeros(len(number), dtype=np.uint64)
    if len(part):
        many = length[part] - WINDOW + 1
        owner = np.repeat(part, many)
        k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        worder, wgroup = multikey(data, start[owner] + k, WINDOW)
        d = least[owner[worder]]
        cuts = np.flatnonzero(np.append(True, wgroup[1:] != wgroup[:-1]))
        low = np.repeat(np.minimum.reduceat(d, cuts), np.diff(np.append(cuts, len(d))))
        hit = worder[d > low]
        np.bitwise_or.at(bits, owner[hit], np.uint64(1) << k[hit].astype(np.uint64))
    full = (np.uint64(1) << (size - WINDOW + 1).astype(np.uint64)) - np.uint64(1)
    return np.where(docs > least[n], full, bits[n])


class Ranges:
    """Which range a string goes to: by its leading bytes, or, window by window, by a hash."""

    def __init__(self, splitters: np.ndarray, hot: np.ndarray):
        self.splitters, self.hot = splitters, hot  # hot: hashes of leading bytes

    def of(self, strings: list[bytes], lead: np.ndarray) -> np.ndarray:
        n = int((lead >= 0).sum())  # windows come last
        first = np.frombuffer(b"".join([s[a : a + 8] for s, a in zip(strings[:n], lead.tolist())]), dtype=">u8").astype(np.uint64)
        hashed = np.array([zlib.crc32(s) for s in strings[n:]], dtype=np.int64) % (len(self.splitters) + 1)
        return np.concatenate([np.searchsorted(self.splitters, first, side="right"), hashed])


def blocks(docs: DataFrame) -> DataFrame:
    """Whole texts in blocks: block, docs, sizes, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial, names, texts, held = TaskContext.get().partitionId(), 0, [], [], 0

        def closed() -> pa.RecordBatch:
            sizes = np.array([len(t) for t in texts], dtype="<u4").tobytes()
            row = ((part << 32) + serial, names, sizes, b"".join(texts), held)
            return pa.record_batch([pa.array([v], t) for v, t in zip(row, _BLOCK_TYPES)], names=["block", "docs", "sizes", "text", "n_bytes"])

        for batch in slices(batches):
            for name, text in zip(batch.column("doc_id").to_pylist(), byte_texts(batch, "text")):
                if names and held + len(text) > BLOCK:
                    yield closed()
                    serial, names, texts, held = serial + 1, [], [], 0
                names.append(name)
                texts.append(text)
                held += len(text)
        if names:
            yield closed()

    rows = columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, "block long, docs array<long>, sizes binary, text binary, n_bytes long")


_BLOCK_TYPES = (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64())


def _bucketed(df: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """``df`` written with rows of a block in one of ``n`` buckets."""
    name = f"blocks_{uuid.uuid4().hex}"
    df.write.bucketBy(n, "block").option("compression", "zstd").option("path", f"{scratch.base}/{name}").saveAsTable(name)
    scratch.until_exit()
    out = df.sparkSession.table(name)
    # the catalog's entry was only needed to read the buckets; its files stay
    df.sparkSession.sql(f"DROP TABLE {name}")
    return out


def screen(made: DataFrame, buckets: int) -> DataFrame:
    """Per block: shared, the 32-bit keys by bucket that another block has too."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                bucket, key = split(Block(row).keys(), buckets)
                order = np.lexsort((key, bucket))
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
                full = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
                blobs = [key[order[cuts[b] : cuts[b + 1]]].astype("<u4").tobytes() for b in full]
                yield pa.record_batch(
                    {"bucket": pa.array(full, pa.int32()), "block": pa.array([row["block"]] * len(full), pa.int64()), "keys": pa.array(blobs, pa.binary())}
                )

    def meet(table: pa.Table) -> pa.Table:
        own = [np.frombuffer(k, dtype="<u4") for k in table.column("keys").to_pylist()]
        # within a block a key is there once, or twice if several of its documents have it; clashes only look like company
        keys_ = np.concatenate(own)
        _, at, n = np.unique(keys_, return_inverse=True, return_counts=True)
        stay = n[at] > 1
        ends = np.cumsum([len(k) for k in own])
        both = [k[stay[e - len(k) : e]].tobytes() for k, e in zip(own, ends.tolist())]
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "keys": pa.array(both, pa.binary())})

    met = made.mapInArrow(keys, "bucket int, block long, keys binary").groupBy("bucket").applyInArrow(meet, "block long, bucket int, keys binary")
    return met.where("length(keys) > 0")


def _shared(row: dict) -> np.ndarray:
    parts = [joined(x["bucket"], np.frombuffer(x["keys"], dtype="<u4")) for x in row["shared"] or []]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)


def sampled(rows: DataFrame, buckets: int, ranges: int) -> Ranges:
    """Splitters and hot leading strings from at most SAMPLE_BLOCKS blocks."""
    few = rows.select("block").orderBy(F.xxhash64("block")).limit(SAMPLE_BLOCKS)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                strings, lead, _, _, _, _ = block.strings(_shared(row), buckets, np.zeros(0, dtype=np.uint64))
                step = max(1, len(strings) // 4096)
                got = [s[a : a + GRAM] for s, a in list(zip(strings, lead.tolist()))[::step]]
                yield pa.record_batch({"lead": pa.array(got, pa.binary())})

    found = rows.join(F.broadcast(few), "block", "left_semi").mapInArrow(look, "lead binary").groupBy("lead").count().collect()
    found = sorted((bytes(k), n) for k, n in found)  # at most SAMPLE_BLOCKS * 8192 rows
    total = sum(n for _, n in found)
    many = {k for k, n in found if n >= HOT_LEAST and n >= HOT_SHARE * total / ranges}
    hot = np.array([gram_hashes(np.frombuffer(k, dtype=np.uint8))[0] for k in sorted(many)], dtype=np.uint64)
    first = np.array([int.from_bytes(k[:8], "big") for k, n in found if k not in many], dtype=np.uint64)
    upto = np.cumsum([n for k, n in found if k not in many])
    if not len(first):
        return Ranges(np.zeros(0, dtype=np.uint64), hot)
    cuts = np.searchsorted(upto, np.arange(1, ranges) * upto[-1] / ranges)
    return Ranges(np.unique(first[np.minimum(cuts, len(first) - 1)]), hot)


def remove(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and spans, kept)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = ranges = PER_PARTITION * parts
    made = _bucketed(blocks(docs), parts, scratch)
    n_bytes = made.select(F.sum("n_bytes")).first()[0] or 0
    buckets = max(buckets, n_bytes // 16 // PER_BUCKET)
    keys = screen(made, buckets).groupBy("block").agg(F.collect_list(F.struct("bucket", "keys")).alias("shared"))
    keys = scratch.write(keys, "shared")
    rows = made.join(keys.hint("shuffle_hash"), "block", "left")
    sent = spark.sparkContext.broadcast(sampled(rows, buckets, ranges))

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                got, lead, least, _, _, _ = Block(row).strings(_shared(row), buckets, sent.value.hot)
                to = sent.value.of(got, lead)
                order = np.argsort(to, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
                    if len(part):
                        own = [got[i] for i in part.tolist()]
                        cells = {
                            "range": pa.array([int(to[part[0]])], pa.int32()),
                            "block": pa.array([row["block"]], pa.int64()),
                            "text": pa.array([b"".join(own)], pa.binary()),
                            "size": pa.array([np.array([len(s) for s in own], dtype=np.uint8).tobytes()], pa.binary()),
                            "lead": pa.array([lead[part].astype(np.int8).tobytes()], pa.binary()),
                            "docs": pa.array([least[part].astype("<i8").tobytes()], pa.binary()),
                        }
                        yield pa.record_batch(cells)

    def settle(table: pa.Table) -> pa.Table:
        size, lead, docs = (np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=t) for c, t in (("size", np.uint8), ("lead", np.int8), ("docs", "<i8")))
        text = b"".join(table.column("text").to_pylist())
        bits = smaller(text, size.astype(np.int64), lead.astype(np.int64), docs.astype(np.int64)).astype("<u8").tobytes()
        ends = np.cumsum([len(x) for x in table.column("size").to_pylist()]).tolist()
        cells = [bits[8 * a : 8 * b] for a, b in zip([0, *ends], ends)]
        return pa.table({"block": table.column("block"), "range": table.column("range"), "bits": pa.array(cells, pa.binary())})

    asked = rows.mapInArrow(strings, "range int, block long, text binary, size binary, lead binary, docs binary")
    answers = asked.groupBy("range").applyInArrow(settle, "block long, range int, bits binary")
    answers = scratch.write(answers.groupBy("block").agg(F.collect_list(F.struct("range", "bits")).alias("bits")), "answers")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _finished(row, buckets, sent.value, with_text)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema += ", spans array<struct<start: long, end: long>>, kept binary" if with_text else ""
    return rows.join(answers.hint("shuffle_hash"), "block", "left").mapInArrow(finish, schema)


def _finished(row: dict, buckets: int, ranges: Ranges, with_text: bool) -> pa.RecordBatch:
    """Remove a block's bytes."""
    block = Block(row)
    strings, lead, least, number, doc, first = block.strings(_shared(row), buckets, ranges.hot)
    bits = np.zeros(len(strings), dtype=np.uint64)
    if strings:
        to = ranges.of(strings, lead)
        order = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[order], np.arange(len(ranges.splitters) + 2))
        for x in row["bits"] or []:
            bits[order[cuts[x["range"]] : cuts[x["range"] + 1]]] = np.frombuffer(x["bits"], dtype="<u8")
    many = np.array([len(s) for s in strings], dtype=np.int64) - WINDOW + 1
    # a later document of the block loses the whole string; the smallest one what another block says
    full = (np.uint64(1) << many.astype(np.uint64)) - np.uint64(1)
    mine = np.where(doc > least[number], full[number], bits[number])
    whole = mine == full[number]
    begin, end = [first[whole]], [first[whole] + many[number[whole]] + WINDOW - 1]
    some = np.flatnonzero(~whole & (mine != 0))
    for k in range(int(many.max()) if len(some) else 0):
        at = first[some[(mine[some] >> np.uint64(k)) & np.uint64(1) == 1]] + k
        begin.append(at)
        end.append(at + WINDOW)
    begin, end = np.concatenate(begin), np.concatenate(end)
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    ends = np.cumsum(block.sizes)
    of = np.searchsorted(ends, begin, side="right")
    # a span begins where nothing before reaches, and in a new text
    new = np.concatenate([[True], (begin[1:] > reach[:-1]) | (of[1:] != of[:-1])])[: len(begin)]
    left, right, owner = begin[new], reach[np.append(new[1:], True)[: len(begin)]], of[new]
    cuts = np.searchsorted(owner, np.arange(len(ends) + 1))
    out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")}
    for k, (size, stop) in enumerate(zip(block.sizes.tolist(), ends.tolist())):
        base = stop - size
        own = list(zip(left[cuts[k] : cuts[k + 1]].tolist(), right[cuts[k] : cuts[k + 1]].tolist()))
        kept = b"".join(block.text[a:b] for a, b in zip([base, *(e for _, e in own)], [*(s for s, _ in own), stop]))
        out["n_bytes"].append(size)
        out["n_removed"].append(size - len(kept))
        out["n_spans"].append(len(own))
        out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        if with_text:
            out["spans"].append([{"start": s - base, "end": e - base} for s, e in own])
            out["kept"].append(kept)
    cols = {"doc_id": pa.array(block.ids, pa.int64())} | {k: pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")}
    cols["kept_sha256"] = pa.array(out["kept_sha256"], pa.string())
    if with_text:
        cols["spans"] = pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        cols["kept"] = pa.array(out["kept"], pa.binary())
    return pa.record_batch(cols)


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: what goes from every row of ``documents``."""
    return remove(spark.read.parquet(f"{sf_dir}/documents.parquet"))
