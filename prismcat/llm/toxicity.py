"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, word pairs and pairs
with one word between, lower-cased.  FTRL-proximal gives every coordinate its
own learning rate, and its L1 term keeps all but a few thousand weights at zero,
so the model is small enough to broadcast: ``2 ** BITS`` floats at most.

Weights are fitted on at most about ``TRAIN_ROWS`` labelled rows, chosen by a
hash of doc_id; all their features, not their texts, meet in one task, which
spills them to a file and reads them back row by row.  Every text is scored
whole.  A null or empty text has the bias alone.  Labels that are
null or repeated with both values for a document are left out.  Rows that share
a doc_id share its label and are all learnt from, in the order of their
features, so the order of arrival changes nothing.  Extra columns are ignored;
without labels every score is one half; an empty table gives no rows.
"""

from __future__ import annotations

import re
import tempfile
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismcat.llm._arrow import by_place, byte_texts, columns, place, slices
from prismcat.plans.ship import ship

BITS = 20
#: Documented bound on the rows that the weights are fitted on.
TRAIN_ROWS = 12_000
#: FTRL-proximal: rate, its smoothing, L1, L2, passes.
ALPHA, BETA, L1, L2, PASSES = 2.0, 1.0, 6.0, 0.0, 8
#: Hashes of words that a worker keeps.
CACHE_WORDS = 150_000

_words: dict[bytes, int] = {}
_LETTERS = re.compile(rb"^[^\w\x80-\xff]+|[^\w\x80-\xff]+$")


def _hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(_LETTERS.sub(b"", word))


def _hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text, without the marks around them."""
    words = text.lower().split()
    got = list(map(_words.get, words))
    if None in got:
        if len(_words) > CACHE_WORDS:
            _words.clear()
        for i, g in enumerate(got):
            if g is None:
                w = words[i]
                got[i] = _hash(w)
                if len(w) < 64:
                    _words[w] = got[i]
    return np.array(got, dtype=np.uint64)


def features(text: bytes) -> np.ndarray:
    """Distinct coordinates of a text, ascending."""
    h = _hashes(text)
    odd = np.uint64(0x9E3779B97F4A7C15)
    both = [h, h[:-1] * odd + h[1:], (h[:-2] * odd + h[2:]) ^ np.uint64(0x5BD1E995)]
    x = np.concatenate(both)
    return np.unique((x * odd) >> np.uint64(64 - BITS)).astype(np.int32)


class Spilled:
    """Feature lists in an open file, read one at a time; ``places`` has each one's offset and size in bytes."""

    def __init__(self, file, places: list[tuple[int, int]]):
        self.file, self.places = file, places

    def __iter__(self) -> Iterator[np.ndarray]:
        for at, size in self.places:
            self.file.seek(at)
            yield np.frombuffer(self.file.read(size), dtype=np.int32)


def fit(rows: Iterable[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Weights (the last is the bias) from feature lists and labels, rows in the given order, once a pass."""
    z = np.zeros((1 << BITS) + 1)
    n = np.zeros((1 << BITS) + 1)
    bias = np.array([1 << BITS])

    def weights(at) -> np.ndarray:
        za, out = z[at], np.sign(z[at]) * L1 - z[at]
        out /= (BETA + np.sqrt(n[at])) / ALPHA + L2
        return np.where(np.abs(za) <= L1, 0.0, out)

    for _ in range(PASSES):
        for row, y in zip(rows, labels):
            x = np.concatenate([row, bias])
            w = weights(x)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            if abs(g) < 1e-3:
                continue
            g2 = g * g
            s = (np.sqrt(n[x] + g2) - np.sqrt(n[x])) / ALPHA
            z[x] += g - s * w
            n[x] += g2
    return weights(np.arange(len(z)))


def crc_of_id(doc_id) -> F.Column:
    """crc32 of a document's id as text."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def train(docs: DataFrame, labels: DataFrame, allowed=None) -> np.ndarray:
    """Weights from the labelled documents for which ``allowed`` holds (all, if None)."""
    ship(docs.sparkSession)
    marks = columns(labels, "doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    if allowed is not None:
        marks = marks.where(allowed)
    marks = marks.groupBy(F.col("doc_id").alias("id")).agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_m")).where("toxic = _m").drop("_m")
    # about TRAIN_ROWS rows at any size: so many parts in a million of the hashes
    share = min(1_000_000, int(1_000_000 * TRAIN_ROWS / max(1, marks.count())))
    chosen = marks.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1_000_000)) < share)
    texts = columns(docs, "doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [features(t).tobytes() for t in byte_texts(batch, "text")]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "x": pa.array(found, pa.binary())})

    rows = texts.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(listed, "doc_id long, toxic int, x binary")

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryFile() as file:
            got = []
            for b in batches:
                for doc, toxic, x in zip(*(b.column(c) for c in ("doc_id", "toxic", "x"))):
                    held = x.as_buffer()
                    got.append((doc.as_py(), toxic.as_py(), file.tell(), file.write(held), zlib.crc32(held)))
            # rows under one id: in the order of their features
            got.sort(key=lambda r: ((r[0] * 0x9E3779B97F4A7C15) % (1 << 64), r[0], r[3], r[4]))
            w = fit(Spilled(file, [r[2:4] for r in got]), np.array([r[1] for r in got], dtype=float))
        at = np.flatnonzero(w)
        yield pa.record_batch({"i": pa.array(at.astype(np.int32)), "w": pa.array(w[at])})

    out = np.zeros((1 << BITS) + 1, dtype=np.float32)
    for i, w in rows.repartition(1).mapInArrow(fitted, "i int, w double").collect():
        out[i] = w
    return out


def scorer(spark, weights: np.ndarray):
    """A column function text -> score in 0 to 1."""
    at = np.flatnonzero(weights)
    sent = spark.sparkContext.broadcast((at, weights[at]))
    held: dict[str, np.ndarray] = {}

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if "w" not in held:
            full = np.zeros((1 << BITS) + 1)
            full[sent.value[0]] = sent.value[1]
            held["w"] = full
        w = held["w"]
        for texts in batches:
            sums = [w[features((t or "").encode())].sum() + w[-1] for t in texts]
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(sums, dtype=float), -35, 35))))

    return score


#: Scores from here on count as toxic.
THRESHOLD = 0.7


def held_out(doc_id) -> F.Column:
    """Rows whose labels the contract query never learns from."""
    return F.coalesce(F.pmod(crc_of_id(doc_id), F.lit(3)) == 1, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted."""
    weights = train(docs, labels, ~held_out(F.col("doc_id")))
    scored = columns(docs, "doc_id", "text").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), scorer(docs.sparkSession, weights)("text").alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all their columns."""
    weights = train(docs, labels, ~held_out(F.col("doc_id")))
    plain, names = by_place(docs)
    scored = plain.withColumn("_score", scorer(docs.sparkSession, weights)(F.col(f"_c{place(names, 'text')}")))
    return scored.where(F.col("_score") < THRESHOLD).drop("_score").toDF(*names)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Contract query: a score for every row of ``documents``."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
