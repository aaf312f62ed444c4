"""A hidden Markov language model over word classes, trained by Baum-Welch.

Tokens are lower-cased words and one end per text.  A token's probability in a
state is that of its class in the state times that of the token in its class:
every token with at least one in ``FREQUENT`` of all training tokens is a class
of its own (so there are ``FREQUENT`` of these at most), the others share
``ENDINGS`` classes by a hash of their last bytes.  Within a class tokens have
smoothed counts with one share for an unknown token, so the model is a proper
distribution over texts.

Texts are packed into blocks with their own vocabularies; word counts are
summed over all blocks and each block gets the counts of its own words back, so
no vocabulary is ever broadcast.  Baum-Welch makes passes over all training
tokens until the likelihood gains less than ``LEAST_GAIN`` a token, ``PASSES`` at
most: expected counts are summed over all partitions, one row per class.  What
it starts from, and nothing else, comes from a bounded sample (``START_TOKENS``):
clusters of stretches of texts, taken from blocks all over the corpus, and states
left without a cluster differ by a hash of the class, so no two states are ever
alike.  Scores come from the scaled forward recursion over whole texts.

Null and empty texts are an end alone.  Rows without doc_id are trained on.
Repeated rows count as often as they occur.  Extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismcat.llm._arrow import byte_texts, columns, slices
from prismcat.plans.scratch import Scratch

STATES, FREQUENT, ENDINGS, SUFFIX = 8, 4096, 2048, 3
#: Full passes of Baum-Welch at most, and the gain in log10 likelihood a token below which they end.
PASSES, LEAST_GAIN = 6, 0.002
#: The sample that the passes start from: tokens, tokens of one stretch at most, blocks that give some, steps on it.
START_TOKENS, STRETCH, START_BLOCKS, START_STEPS = 300_000, 1000, 64, 12
#: Tokens in a block; a text is never split.
BLOCK = 1_500_000
#: Share added to every count of a token, and weight of the overall class frequencies in a state's.
ADD, PRIOR = 0.1, 10.0
FOLDS = 10

_BLOCKS = "block long, docs array<long>, sizes binary, codes binary, words array<binary>, counts array<int>"


class _Codes(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def is_held_out(doc_id: int | None) -> bool:
    """Whether a document is kept from training."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == 0


def blocks(docs: DataFrame) -> DataFrame:
    """Blocks of whole texts: ids, tokens per text, token codes, and the block's words with their training counts.

    The end is the word of no bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial = TaskContext.get().partitionId(), 0
        names, sizes, codes, vocab, counts = [], [], array("I"), _Codes(), []

        def closed() -> pa.RecordBatch:
            row = [
                (pa.int64(), (part << 32) + serial),
                (pa.list_(pa.int64()), names),
                (pa.binary(), np.array(sizes, dtype="<u4").tobytes()),
                (pa.binary(), codes.tobytes()),
                (pa.list_(pa.binary()), list(vocab)),
                (pa.list_(pa.int32()), pa.array(_counts(names, sizes, codes, len(vocab)))),
            ]
            arrays = [pa.array([v], t) if not isinstance(v, pa.Array) else pa.ListArray.from_arrays([0, len(v)], v) for t, v in row]
            return pa.record_batch(arrays, names=["block", "docs", "sizes", "codes", "words", "counts"])

        for batch in slices(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), byte_texts(batch, "text")):
                words = text.lower().split()
                words.append(b"")
                names.append(doc)
                sizes.append(len(words))
                codes.extend(map(vocab.__getitem__, words))
                if len(codes) >= BLOCK:
                    yield closed()
                    serial += 1
                    names, sizes, codes, vocab = [], [], array("I"), _Codes()
        if names:
            yield closed()

    rows = columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, _BLOCKS)


def _counts(names: list, sizes: list[int], codes: array, n: int) -> np.ndarray:
    learn = np.repeat([not is_held_out(d) for d in names], sizes)
    return np.bincount(np.frombuffer(codes, dtype=np.uint32)[learn], minlength=n).astype(np.int32)


class Model:
    """Start, transition and emission probabilities, and the recursions on them."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit  # (K), (K, K), (classes, K)

    @staticmethod
    def layout(sizes: np.ndarray):
        """Texts by falling length: their order, and how many are still running at each step."""
        order = np.argsort(-sizes, kind="stable")
        running = np.searchsorted(-sizes[order], -np.arange(1, (sizes.max() if len(sizes) else 0) + 1), side="right")
        return order, running

    def forward(self, seen: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log10 probability of each text's classes, by the scaled forward recursion."""
        order, running = self.layout(sizes)
        at = (np.cumsum(sizes) - sizes)[order]
        total = np.zeros(len(sizes))
        a = np.tile(self.start, (len(sizes), 1))
        for t, n in enumerate(running.tolist()):
            if t:
                a = a[:n] @ self.move
            a *= self.emit[seen[at[:n] + t]]
            c = a.sum(axis=1)
            a /= c[:, None]
            total[:n] += np.log10(c)
        out = np.empty(len(sizes))
        out[order] = total
        return out

    def expected(self, seen: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected starts, moves and emissions of the texts, by forward and backward recursion, and their log10 likelihood."""
        k = len(self.start)
        order, running = self.layout(sizes)
        at = (np.cumsum(sizes) - sizes)[order]
        first = np.cumsum(running) - running
        alpha = np.empty((int(running.sum()), k), dtype=np.float32)
        scale = np.empty(len(alpha), dtype=np.float32)
        symbol = np.empty(len(alpha), dtype=np.int32)
        a = np.tile(self.start, (len(sizes), 1))
        for t, (n, f) in enumerate(zip(running.tolist(), first.tolist())):
            if t:
                a = a[:n] @ self.move
            o = seen[at[:n] + t]
            a *= self.emit[o]
            c = a.sum(axis=1)
            a /= c[:, None]
            alpha[f : f + n], scale[f : f + n], symbol[f : f + n] = a, c, o
        moves = np.zeros((k, k))
        beta = np.zeros((0, k))
        for t in range(len(running) - 1, -1, -1):
            n, f = int(running[t]), int(first[t])
            now = alpha[f : f + n]
            m = len(beta)
            back = np.ones((n, k))
            if m:
                g = int(first[t + 1])
                ahead = beta * self.emit[symbol[g : g + m]] / scale[g : g + m, None]
                moves += now[:m].T.astype(np.float64) @ ahead
                back[:m] = ahead @ self.move.T
            beta = back
            now *= back  # alpha becomes the states' probabilities
        emits = np.stack([np.bincount(symbol, weights=alpha[:, s], minlength=len(self.emit)) for s in range(k)], axis=1)
        n = int(running[0]) if len(running) else 0
        return alpha[:n].sum(axis=0, dtype=np.float64), moves * self.move, emits, float(np.log10(scale, dtype=np.float64).sum())

    @classmethod
    def from_counts(cls, starts: np.ndarray, moves: np.ndarray, emits: np.ndarray, share: np.ndarray) -> Model:
        """The model of expected counts; ``share``: the classes' overall frequencies, all above zero."""
        emits = emits + PRIOR * share[:, None]
        moves, starts = moves + 0.1, starts + 0.1
        return cls(starts / starts.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=0))


def unlike(classes: int, states: int) -> np.ndarray:
    """A factor between a half and one and a half for each class and state, the same in every run."""
    at = np.arange(classes, dtype=np.uint64)[:, None] * np.uint64(states) + np.arange(states, dtype=np.uint64)
    h = (at + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return 0.5 + (h >> np.uint64(40)).astype(float) / (1 << 24)


def first_model(texts: list[np.ndarray], share: np.ndarray, states: int = STATES, steps: int = START_STEPS) -> Model:
    """A model from a sample of class sequences: clusters of them, then Baum-Welch on the sample; no two states are alike."""
    size = len(share)
    emits = share[:, None] * 50 * unlike(size, states)
    if not texts:
        return Model.from_counts(np.ones(states), np.eye(states) * 9 + 0.1, emits, share)
    bags = np.stack([np.bincount(t, minlength=size) for t in texts]).astype(np.float32)
    unit = np.sqrt(bags)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    # the farthest texts first as centres
    picks = [int(np.argmax(bags.sum(axis=1)))]
    while len(picks) < min(states, len(texts)):
        picks.append(int(np.argmin((unit @ unit[picks].T).max(axis=1))))
    centres = unit[picks]
    for _ in range(8):
        own = np.argmax(unit @ centres.T, axis=1)
        centres = np.stack([unit[own == c].sum(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))])
        centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    for c in range(len(centres)):
        emits[:, c] += bags[own == c].sum(axis=0)
    model = Model.from_counts(np.ones(states), np.eye(states) * 9 + 0.1, emits, share)
    seen, sizes = np.concatenate(texts), np.array([len(t) for t in texts])
    for _ in range(steps):
        model = Model.from_counts(*model.expected(seen, sizes)[:3], share)
    # states that the sample could not tell apart stay apart
    emit = model.emit * (0.9 + 0.1 * unlike(size, states))
    return Model(model.start, model.move, emit / emit.sum(axis=0))


def stretches(seen: np.ndarray, sizes: np.ndarray, tokens: int) -> list[np.ndarray]:
    """About ``tokens`` tokens of a block: of each text, in a mixed order, at most STRETCH tokens from a mixed place on."""
    ends, left, out = np.cumsum(sizes), tokens, []
    for i in np.argsort((np.arange(len(sizes)) * 0x9E3779B1) % (1 << 32)).tolist():
        if left <= 0:
            break
        n = int(min(sizes[i], STRETCH, left))
        at = int(ends[i] - sizes[i]) + (i * 0x85EBCA6B) % int(sizes[i] - n + 1)
        out.append(seen[at : at + n])
        left -= n
    return out


def counted(made: DataFrame, total: int, scratch: Scratch) -> DataFrame:
    """Per word of each block: block, pos, c (its count in all training tokens), ending, word (if frequent), first.

    A word has one row per block at most, so a frequent one is no hot group.
    """
    rows = made.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("pos", "w")).select("block", "pos", "w.words", "w.counts")
    same = Window.partitionBy("words")
    c = F.sum("counts").over(same)
    ending = F.pmod(F.xxhash64(F.expr(f"substring(words, -{SUFFIX}, {SUFFIX})")), F.lit(ENDINGS)).cast("int")
    return scratch.write(
        rows.select("block", "pos", "words", c.alias("c"), ending.alias("ending"), (F.min("block").over(same) == F.col("block")).alias("first")).select(
            "block", "pos", "c", "ending", F.when((F.col("c") * FREQUENT >= total) & (F.col("c") > 0), F.col("words")).alias("word"), "first"
        ),
        "counted",
    )


_CODED = "block long, docs array<long>, sizes binary, seen binary, base array<double>, inner array<double>, known array<long>"


def coded(made: DataFrame, words: DataFrame, parts: int, total: int, distinct: int, n_in: np.ndarray, v_in: np.ndarray) -> DataFrame:
    """Blocks as class sequences, with each text's base score, within-class score and known tokens.

    ``parts``: the number of blocks.  Dealt to so many partitions, a task sorts the words of very few blocks.
    """
    below = total + ADD * (distinct + 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block = left.to_pylist()[0]
        pos, c, cls = (right.column(x).to_numpy() for x in ("pos", "c", "cls"))
        n = int(pos.max()) + 1
        base, inner, known = np.zeros(n), np.zeros(n), np.zeros(n, dtype=np.int64)
        number = np.zeros(n, dtype=np.uint16)
        number[pos] = cls
        base[pos] = np.log10((c + ADD) / below)
        known[pos] = c > 0
        shared = cls < ENDINGS
        inner[pos[shared]] = np.log10((c[shared] + ADD) / (n_in[cls[shared]] + ADD * (v_in[cls[shared]] + 1)))
        codes, sizes = np.frombuffer(block["codes"], dtype="<u4"), np.frombuffer(block["sizes"], dtype="<u4").astype(np.int64)
        start = np.cumsum(sizes) - sizes
        sums = [np.add.reduceat(x[codes], start) for x in (base, inner, known)]
        return pa.table(
            {
                "block": pa.array([block["block"]]),
                "docs": pa.array([block["docs"]], pa.list_(pa.int64())),
                "sizes": pa.array([block["sizes"]], pa.binary()),
                "seen": pa.array([number[codes].tobytes()], pa.binary()),
                "base": pa.array([sums[0].tolist()], pa.list_(pa.float64())),
                "inner": pa.array([sums[1].tolist()], pa.list_(pa.float64())),
                "known": pa.array([sums[2].tolist()], pa.list_(pa.int64())),
            }
        )

    texts = made.select("block", "docs", "sizes", "codes").repartition(parts, "block")
    own = words.select("block", "pos", "c", "cls").repartition(parts, "block")
    return texts.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(run, _CODED)


def _texts(block: dict) -> tuple[list, np.ndarray, np.ndarray]:
    return block["docs"], np.frombuffer(block["sizes"], dtype="<u4").astype(np.int64), np.frombuffer(block["seen"], dtype="<u2")


def _training(block: dict) -> tuple[np.ndarray, np.ndarray]:
    names, sizes, seen = _texts(block)
    learn = np.array([not is_held_out(d) for d in names], dtype=bool)
    return seen[np.repeat(learn, sizes)], sizes[learn]


def trained(rows: DataFrame, share: np.ndarray) -> Model:
    """The model after all passes; what reaches the driver is one row per class."""
    spark = rows.sparkSession
    n_classes, k = len(share), STATES

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                out = [t.astype("<u2").tobytes() for t in stretches(*_training(block), per_block)]
                yield pa.record_batch({"text": pa.array(out, pa.binary())})

    inputs = rows.select("docs", "sizes", "seen")
    n_blocks = rows.count()
    # about START_TOKENS tokens at any size, from so many blocks and so many tokens of each
    used = min(n_blocks, START_BLOCKS)
    per_block = START_TOKENS // max(1, used)
    few = rows.orderBy(F.xxhash64("block")).limit(used).select("block") if n_blocks > used else None
    taken = inputs if few is None else rows.join(F.broadcast(few), "block", "left_semi").select("docs", "sizes", "seen")
    got = sorted(bytes(r.text) for r in taken.mapInArrow(sample, "text binary").collect())
    model = first_model([np.frombuffer(t, dtype="<u2") for t in got], share)
    sums = ", ".join(f"s{s} double" for s in range(k))
    before = None
    for _ in range(PASSES):
        sent = spark.sparkContext.broadcast(model)

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in batch.to_pylist():
                    starts, moves, emits, likelihood = sent.value.expected(*_training(block))
                    used = np.flatnonzero(emits.any(axis=1))
                    at = np.concatenate([used, n_classes + np.arange(k), [n_classes + k, n_classes + k + 1]])
                    last = np.zeros((1, k))
                    last[0, 0] = likelihood
                    values = np.concatenate([emits[used], moves, starts[None], last])
                    cols = {"at": pa.array(at.astype(np.int32))} | {f"s{s}": pa.array(values[:, s]) for s in range(k)}
                    yield pa.record_batch(cols)

        found = inputs.mapInArrow(count, f"at int, {sums}").groupBy("at").agg(*[F.sum(f"s{s}").alias(f"s{s}") for s in range(k)])
        full = np.zeros((n_classes + k + 2, k))
        for r in found.collect():
            full[r[0]] = r[1:]
        model = Model.from_counts(full[-2], full[n_classes : n_classes + k], full[:n_classes], share)
        now = full[-1, 0] / max(1.0, full[:n_classes].sum())
        if before is not None and now - before < LEAST_GAIN:
            break
        before = now
    return model


def score(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "hmm")
    made = scratch.write(blocks(docs), "blocks")
    total, n_blocks = made.select(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)), F.count(F.lit(1))).first()
    total = total or 0
    every = words = counted(made, total, scratch)
    own = words.where("first AND word IS NOT NULL").select("word", "c").collect()  # FREQUENT rows at most
    own = sorted(((-r.c, bytes(r.word)) for r in own))
    table = spark.createDataFrame([(w, ENDINGS + i) for i, (_, w) in enumerate(own)], "f binary, own int")
    words = words.join(F.broadcast(table), F.col("word") == F.col("f"), "left").withColumn("cls", F.coalesce("own", "ending"))
    stats = words.where("first AND c > 0").groupBy("cls").agg(F.sum("c"), F.count(F.lit(1))).collect()
    n_classes = ENDINGS + len(own)
    n_in, v_in = np.zeros(n_classes), np.zeros(n_classes)
    for cls, n, v in stats:
        n_in[cls], v_in[cls] = n, v
    share = (n_in + ADD) / (n_in + ADD).sum()
    rows = scratch.write(coded(made, words, max(1, n_blocks), total, int(v_in.sum()), n_in, v_in), "coded")
    scratch.drop(made, every)
    sent = spark.sparkContext.broadcast(trained(rows, share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                names, sizes, seen = _texts(block)
                yield pa.record_batch(
                    {
                        "doc_id": pa.array(names, pa.int64()),
                        "held_out": pa.array([is_held_out(d) for d in names]),
                        "n_tokens": pa.array(sizes),
                        "n_known": pa.array(block["known"], pa.int64()),
                        "train_tokens": pa.array([total] * len(names), pa.int64()),
                        "base_score": pa.array(block["base"], pa.float64()),
                        "score": pa.array(sent.value.forward(seen, sizes) + np.array(block["inner"])),
                    }
                )

    return rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op7_hmm_language_model(spark, sf_dir: str) -> DataFrame:
    """Contract query: base and model score of every row of ``documents``."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
