"""Similarity joins of signatures.

Signatures are compared once per distinct value; the pairs of ids come from the members of the values at the end, so
equal signatures meet in no join.  Pairs of values are found by multi-index hashing: with m bands, signatures within t
bits agree in one band up to t // m bits, so each side looks up its band values and those a few bits away, and an equi
join finds every pair.  The width of the bands is the one that costs least for the threshold and the number of values.
Where the threshold is so wide that bands tell little apart, any exact method compares nearly all pairs; then blocks of
values are paired, each pair of blocks once, as packed arrays.  What a side grows to when it is spread can't be told from
its file, so these joins are never left to broadcasts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismcat.functions.exprs import hamming
from prismcat.plans.scratch import Scratch

#: Values of a block where the threshold is too wide for bands.
BLOCK_ROWS = 4096
#: Values of a packed block, least and most, into how many blocks a table is cut between, and pairs that are looked at together.
PACKED, CUTS, TILE = (2048, 65_536), 24, 1 << 18
#: Videos of a packed block, and pairs of them that are looked at together.
VIDEOS, VIDEO_TILE = 2048, 1 << 17
#: Band widths in bits that are tried, and what a row that is spread costs against a pair that is compared.
WIDTHS, ROW_COST = (8, 16, 32), 20


def _spread(width: int, reach: int) -> int:
    return sum(comb(width, k) for k in range(min(reach, width) + 1))


def bands_for(bits: int, lanes: int, t: int, values: int, width: int | None = None) -> tuple[int, int] | None:
    """(width, radius) of the bands that cost least for so many values, or None if comparing all pairs costs less.

    Every choice finds the same pairs.  ``width``: these bands, whatever they cost.  A pair meets once for every two
    probes that agree, so the cost of bands has the product of both sides' probes.
    """
    best = (values * values / 2 + 2 * values * -(-values // BLOCK_ROWS) * ROW_COST, None)
    for w in WIDTHS if width is None else (width,):
        if bits % w:
            continue
        m = bits // w * lanes
        radius = t // m
        ours, theirs = _spread(w, radius - radius // 2), _spread(w, radius // 2)
        cost = values * m * (ours + theirs) * ROW_COST + values * values * m * ours * theirs / 2**w
        if cost < best[0] or width is not None:
            best = (cost, (w, radius))
    return best[1]


def _probed(sigs: DataFrame, lanes: list[str], bits: int, width: int, reach: int) -> DataFrame:
    """``sigs`` with key, a band's number and value in one: each band's value and those up to ``reach`` bits away."""
    masks = sorted(sum(1 << b for b in c) for k in range(reach + 1) for c in combinations(range(width), k))
    flips = F.lit(masks).cast("array<long>")

    def keyed(band: int, lane: str, j: int):
        part = F.shiftrightunsigned(F.col(lane), j * width).bitwiseAND(F.lit((1 << width) - 1))
        return F.transform(flips, lambda m: part.bitwiseXOR(m).bitwiseOR(F.lit(band << width)))

    places = [(lane, j) for lane in lanes for j in range(bits // width)]
    keys = [keyed(n, lane, j) for n, (lane, j) in enumerate(places)]
    return sigs.withColumn("key", F.explode(F.concat(*keys)))


def _side(df: DataFrame, name: str, lanes: list[str], *more: str) -> DataFrame:
    return df.select(F.col("value").alias(name), *[F.col(x).alias(f"{name}_{x}") for x in lanes], *more)


def _near_values(left: DataFrame, right: DataFrame | None, lanes: list[str], t: int, bits: int, width: int | None = None) -> DataFrame:
    """(a, b, distance) of values within ``t`` bits: of one table with a < b, or of two tables."""
    same = right is None
    d = hamming([F.col(f"a_{x}") for x in lanes], [F.col(f"b_{x}") for x in lanes])
    count = (left if same else right).count()
    if band := bands_for(bits, len(lanes), t, count, width):
        width, radius = band
        a = _side(_probed(left, lanes, bits, width, radius - radius // 2), "a", lanes, "key")
        b = _side(_probed(left if same else right, lanes, bits, width, radius // 2), "b", lanes, "key")
        pairs = a.join(b.hint("merge"), "key")
        pairs = pairs.where("a < b") if same else pairs
        return pairs.withColumn("distance", d).where(F.col("distance") <= t).select("a", "b", "distance").distinct()
    return _block_pairs(left, right, lanes, t, count, count if same else left.count())


def _packed(values: DataFrame, lanes: list[str], blocks: int) -> DataFrame:
    """A row per block: its number, its values and their lanes as arrays."""

    def pack(table: pa.Table) -> pa.Table:
        ids = table.column("value").to_numpy().astype("<i8").tobytes()
        sig = np.stack([table.column(x).to_numpy().astype("<i8") for x in lanes]).tobytes()
        return pa.table({"block": table.column("block").slice(0, 1), "ids": pa.array([ids], pa.binary()), "sig": pa.array([sig], pa.binary())})

    placed = values.select("value", *lanes, F.pmod(F.xxhash64("value"), F.lit(blocks)).cast("int").alias("block"))
    return placed.groupBy("block").applyInArrow(pack, "block int, ids binary, sig binary")


def near_pairs(a: np.ndarray, b: np.ndarray | None, t: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places (i, j) and distances of rows of ``a`` and ``b`` (a lane a row) within ``t`` bits; without ``b`` those of ``a`` with i < j."""
    other = a if b is None else b
    kind = np.uint8 if 64 * len(a) < 256 else np.uint16
    step = max(1, TILE // max(1, other.shape[1]))
    for at in range(0, a.shape[1], step):
        upto, first = min(at + step, a.shape[1]), at if b is None else 0
        d = np.zeros((upto - at, other.shape[1] - first), dtype=kind)
        for x, y in zip(a, other):
            d += np.bitwise_count(x[at:upto, None] ^ y[None, first:])
        i, j = np.divmod(np.flatnonzero(d <= t), d.shape[1])
        far = d[i, j].astype(np.int32)
        i, j = i + at, j + first
        if b is None:
            i, j, far = i[keep := i < j], j[keep], far[keep]
        if len(i):
            yield i, j, far


def _block_pairs(left: DataFrame, right: DataFrame | None, lanes: list[str], t: int, count: int, others: int) -> DataFrame:
    """(a, b, distance) of values within ``t`` bits by comparing each pair of blocks once."""
    cut = lambda k: max(1, -(-k // PACKED[1]), min(-(-k // PACKED[0]), CUTS))
    scratch, n, m = Scratch(left.sparkSession, "blocks"), cut(count), cut(others)
    if right is None:
        x, y = F.least("block", "other"), F.greatest("block", "other")
        met = scratch.write(_packed(left, lanes, n), "packed").withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        rows, pairs = met.select(x.alias("x"), y.alias("y"), (F.col("block") > F.col("other")).cast("int").alias("side"), "ids", "sig"), n * (n + 1) // 2
    else:
        side = lambda df, k, x, y, s: scratch.write(_packed(df, lanes, k), "packed").select(x.alias("x"), y.alias("y"), F.lit(s).alias("side"), "ids", "sig")
        each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
        rows, pairs = side(left, m, F.col("block"), each(n), 0).unionByName(side(right, n, each(m), F.col("block"), 1)), n * m
    alone, wide = right is None, len(lanes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for k in range(batch.num_rows):
                x, y, s = (batch.column(c)[k].as_py() for c in ("x", "y", "side"))
                ids = np.frombuffer(batch.column("ids")[k].as_py(), dtype="<i8")
                sig = np.frombuffer(batch.column("sig")[k].as_py(), dtype="<u8").reshape(wide, -1)
                if s == 0:
                    held = (x, y, ids, sig)
                    if not (alone and x == y):
                        continue
                if held is None or held[:2] != (x, y):
                    continue
                for i, j, far in near_pairs(held[3], None if s == 0 else sig, t):
                    yield pa.record_batch({"a": pa.array(held[2][i]), "b": pa.array(ids[j]), "distance": pa.array(far)})

    # a task for each pair of blocks, about
    return rows.repartition(pairs, "x", "y").sortWithinPartitions("x", "y", "side").mapInArrow(run, "a long, b long, distance int")


def _values(sigs: DataFrame, lanes: list[str], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Distinct signatures as ``value`` with lanes, and (id, value) of all; null lanes are near nothing."""
    values = scratch.write(sigs.select(*lanes).dropna().distinct().withColumn("value", F.monotonically_increasing_id()), "values")
    return values, sigs.join(values.hint("merge"), lanes).select("id", "value")


def _near_and_members(sigs: DataFrame, lanes: list[str], t: int, bits: int, width: int | None) -> tuple[DataFrame, DataFrame]:
    """(a, b, distance) of near values and (id, value) of all, both written: whatever reads them often costs one search."""
    scratch = Scratch(sigs.sparkSession, "photo_edges")
    values, members = _values(sigs, lanes, scratch)
    return scratch.write(_near_values(values, None, lanes, t, bits, width), "near"), scratch.write(members, "members")


def photo_edges(sigs: DataFrame, lanes: list[str], t: int, bits: int = 64, width: int | None = None) -> DataFrame:
    """(a, b, distance) with a < b for all pairs within ``t`` bits.

    ``sigs``: id and signature lanes of ``bits`` used bits each.  Quality never gates a photo.  ``width``: bands of so many bits.
    """
    near, members = _near_and_members(sigs, lanes, t, bits, width)
    a, b = members.toDF("i", "a"), members.toDF("j", "b")
    across = near.join(a.hint("merge"), "a").join(b.hint("merge"), "b").where("i <> j").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "distance")
    equal = members.toDF("a", "value").join(members.toDF("b", "value").hint("merge"), "value").where("a < b").select("a", "b", F.lit(0).alias("distance"))
    return across.unionByName(equal)


def photo_links(sigs: DataFrame, lanes: list[str], t: int, bits: int = 64, width: int | None = None) -> DataFrame:
    """(a, b) with the components of ``photo_edges``: near signatures by their smallest ids, and every copy with that of its own."""
    near, members = _near_and_members(sigs, lanes, t, bits, width)
    first = members.groupBy("value").agg(F.min("id").alias("first"))
    across = near.join(first.toDF("a", "i").hint("merge"), "a").join(first.toDF("b", "j").hint("merge"), "b").select(F.col("i").alias("a"), F.col("j").alias("b"))
    copies = members.join(first.hint("merge"), "value").select(F.col("first").alias("a"), F.col("id").alias("b"))
    return across.unionByName(copies).where("a <> b")


def cross_edges(targets: DataFrame, pool: DataFrame, lanes: list[str], t: int, bits: int = 64) -> DataFrame:
    """(target, match, distance): every target against every signature of the pool."""
    scratch = Scratch(targets.sparkSession, "cross_edges")
    (ours, own), (theirs, other) = _values(targets, lanes, scratch), _values(pool, lanes, scratch)
    near = _near_values(ours, theirs, lanes, t, bits)
    return near.join(own.toDF("target", "a").hint("merge"), "a").join(other.toDF("match", "b").hint("merge"), "b").where("target <> match").select("target", "match", "distance")


def _duration_band(tol_s: float, tol_pct: float) -> Column:
    """Logarithmic bands of ``duration`` so wide that a partner is at most one band away."""
    import math

    base = math.log(1 + tol_pct / 100) if tol_pct > 0 else 1.0
    shift = tol_s / (tol_pct / 100) if tol_pct > 0 else 0.0
    # on log(duration + shift) the tolerance is at most 2 * base, so bands of that width do
    return F.floor(F.log(F.col("duration") + shift + 1e-9) / (2 * base)).cast("long") if tol_pct > 0 else F.floor(F.col("duration") / max(tol_s, 1e-9)).cast("long")


def duration_pairs(videos: DataFrame, tol_s: float, tol_pct: float) -> DataFrame:
    """(a, b) with a < b whose durations differ by at most max(tol_s, pct of the shorter); null never matches.

    Durations go to logarithmic bands so wide that a partner is at most one band away.
    """
    placed = videos.where("duration IS NOT NULL").select("id", "duration", _duration_band(tol_s, tol_pct).alias("band"))
    a = placed.select(F.col("id").alias("a"), F.col("duration").alias("da"), F.explode(F.array([F.col("band") + k for k in (-1, 0, 1)])).alias("band"))
    b = placed.select(F.col("id").alias("b"), F.col("duration").alias("db"), "band")
    near = F.abs(F.col("da") - F.col("db")) <= F.greatest(F.lit(float(tol_s)), F.lit(tol_pct / 100) * F.least("da", "db"))
    return a.join(b, "band").where((F.col("a") < F.col("b")) & near).select("a", "b", "da", "db")


def vote_edges(frames: DataFrame, pairs: DataFrame, lanes: list[str], t: int, gate: int, least: int, fraction: float) -> DataFrame:
    """(a, b, distance, comparable, matching): pairs of videos whose frames agree by vote.

    Frames are compared index by index where both pass the quality gate (null counts as 0).
    """
    f = frames.where(F.coalesce("quality", F.lit(0)) >= gate)
    fa = f.select(F.col("id").alias("a"), "frame", *[F.col(x).alias(f"a_{x}") for x in lanes])
    fb = f.select(F.col("id").alias("b"), "frame", *[F.col(x).alias(f"b_{x}") for x in lanes])
    d = hamming([F.col(f"a_{x}") for x in lanes], [F.col(f"b_{x}") for x in lanes])
    votes = (
        pairs.select("a", "b").join(fa, "a").join(fb, ["b", "frame"]).withColumn("d", d).groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("comparable"), F.count_if(F.col("d") <= t).alias("matching"), F.bround(F.sum(F.when(F.col("d") <= t, F.col("d"))) / F.count_if(F.col("d") <= t)).cast("int").alias("distance"))
    )
    return votes.where((F.col("comparable") >= least) & (F.col("matching") / F.col("comparable") >= fraction))


def _packed_videos(rows: DataFrame, lanes: list[str]) -> DataFrame:
    """A row per block: ids and durations of its videos in the order of durations, and their frames as arrays.

    A frame: its video's place, its number, how many rows of its video had that number before, whether it has a signature, lanes.
    """

    def pack(table: pa.Table) -> pa.Table:
        # by duration, then by video and frame
        table = table.sort_by([("duration", "ascending"), ("id", "ascending"), ("frame", "ascending")])
        ids, frame = (table.column(c).to_numpy().astype("<i8") for c in ("id", "frame"))
        new = np.r_[True, ids[1:] != ids[:-1]]
        fresh = new | np.r_[True, frame[1:] != frame[:-1]]
        nth = np.arange(len(ids))
        nth -= np.maximum.accumulate(np.where(fresh, nth, 0))
        told = np.logical_and.reduce([table.column(x).is_valid().to_numpy(zero_copy_only=False) for x in lanes])
        sig = [table.column(x).fill_null(0).to_numpy().astype("<i8") for x in lanes]
        frames = np.stack([np.cumsum(new) - 1, frame, nth, told, *sig]).astype("<i8")
        blobs = {"ids": ids[new], "durations": table.column("duration").to_numpy().astype("<f8")[new], "frames": frames}
        return pa.table({"band": table.column("band").slice(0, 1), "cut": table.column("cut").slice(0, 1)} | {k: pa.array([v.tobytes()], pa.binary()) for k, v in blobs.items()})

    return rows.groupBy("band", "cut").applyInArrow(pack, "band long, cut long, ids binary, durations binary, frames binary")


def _by_number(frames: np.ndarray, lo: int, hi: int) -> dict[int, list[np.ndarray]]:
    """Frames of the videos lo to hi by their number: a part for each time a number comes again in a video."""
    own = frames[:, np.searchsorted(frames[0], lo) : np.searchsorted(frames[0], hi)]
    own = own[:, np.lexsort((own[0], own[2], own[1]))]
    cuts = np.flatnonzero((np.diff(own[1]) != 0) | (np.diff(own[2]) != 0)) + 1
    out: dict[int, list[np.ndarray]] = {}
    for part in np.split(own, cuts, axis=1) if own.shape[1] else ():
        out.setdefault(int(part[1, 0]), []).append(part)
    return out


def voted(a: tuple, b: tuple | None, tol_s: float, part: float, t: int, least: int, fraction: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(i, j, sum, comparable, matching) of videos of two packed blocks that agree by vote; without ``b`` those of ``a`` with i < j."""
    other = a if b is None else b
    (_, da, fa), (_, db, fb) = a, other
    step = max(1, VIDEO_TILE // max(1, len(db)))
    for at in range(0, len(da), step):
        upto = min(at + step, len(da))
        mine = da[at:upto]
        reach = np.maximum(tol_s, part * mine) * (1 + 1e-9) + 1e-9
        lo, hi = np.searchsorted(db, (mine - reach).min()), np.searchsorted(db, (mine + reach).max(), "right")
        lo = max(lo, at) if b is None else lo
        if lo >= hi:
            continue
        shape = (upto - at, hi - lo)
        comparable, matching, far = (np.zeros(shape, dtype=np.int32) for _ in range(3))
        theirs = _by_number(fb, lo, hi)
        for number, parts in _by_number(fa, at, upto).items():
            for x in parts:
                for y in theirs.get(number, ()):
                    d = np.zeros((x.shape[1], y.shape[1]), dtype=np.int32)
                    for p, q in zip(x[4:].view(np.uint64), y[4:].view(np.uint64)):
                        d += np.bitwise_count(p[:, None] ^ q[None, :])
                    hit = (d <= t) & ((x[3] == 1)[:, None] & (y[3] == 1)[None, :])
                    cells = np.ix_(x[0] - at, y[0] - lo)
                    comparable[cells] += 1
                    matching[cells] += hit
                    far[cells] += d * hit
        with np.errstate(invalid="ignore", divide="ignore"):
            keep = (comparable >= max(1, least)) & (matching / comparable >= fraction)
        i, j = np.nonzero(keep)
        counts = far[i, j], comparable[i, j], matching[i, j]
        i, j = i + at, j + lo
        near = np.abs(da[i] - db[j]) <= np.maximum(tol_s, part * np.minimum(da[i], db[j]))
        if b is None:
            near &= i < j
        if near.any():
            yield i[near], j[near], *(c[near] for c in counts)


def video_edges(frames: DataFrame, videos: DataFrame, tol_s: float, tol_pct: float, lanes: list[str], t: int, gate: int, least: int, fraction: float) -> DataFrame:
    """(a, b, distance, comparable, matching): ``vote_edges`` of ``duration_pairs``, without a row for each pair and frame.

    ``videos``: (id, duration), an id once.  Videos of a band of durations go to blocks, and each pair of blocks of the same
    band or of neighbours is compared once, as packed arrays; a band that is full has more blocks.
    """
    scratch = Scratch(frames.sparkSession, "video_edges")
    f = frames.where((F.coalesce("quality", F.lit(0)) >= gate) & F.col("frame").isNotNull()).select("id", F.col("frame").cast("long").alias("frame"), *[F.col(x).cast("long").alias(x) for x in lanes])
    usable = f.select("id").distinct()  # rows may repeat a number, so few of them may still make many comparisons
    placed = scratch.write(
        videos.where("duration IS NOT NULL").select("id", F.col("duration").cast("double").alias("duration"), _duration_band(tol_s, tol_pct).alias("band")).where("band IS NOT NULL").join(usable, "id"), "placed"
    )
    sizes = scratch.write(placed.groupBy("band").agg(F.count(F.lit(1)).alias("n")).withColumn("cuts", F.ceil(F.col("n") / VIDEOS)), "sizes")
    block = F.pmod(F.xxhash64("id"), F.col("cuts")).alias("cut")
    blocks = scratch.write(_packed_videos(f.join(placed.join(sizes, "band").select("id", "duration", "band", block), "id"), lanes), "packed")
    after = sizes.select((F.col("band") - 1).alias("band"), F.col("cuts").alias("after"), F.col("n").alias("m"))
    before = sizes.select((F.col("band") + 1).alias("band"), F.col("cuts").alias("before"))
    work = sizes.join(after, "band", "left").agg(F.sum(F.col("n") * (F.col("n") / 2 + F.coalesce("m", F.lit(0))))).first()[0] or 0
    each = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1)).alias("other")
    met = lambda how, k: blocks.join(how, "band").select("*", each(k))
    pair = lambda df, p, x, q, y, s: df.select(p.alias("p"), x.alias("x"), q.alias("q"), y.alias("y"), s.alias("side"), "ids", "durations", "frames")
    band, cut, other = F.col("band"), F.col("cut"), F.col("other")
    rows = pair(met(sizes.select("band", "cuts"), "cuts"), band, F.least(cut, other), band, F.greatest(cut, other), (cut > other).cast("int"))
    rows = rows.unionByName(pair(met(after, "after"), band, cut, band + 1, other, F.lit(0))).unionByName(pair(met(before, "before"), band - 1, other, band, cut, F.lit(1)))
    wide, part = len(lanes), tol_pct / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                key, side = tuple(batch.column(c)[k].as_py() for c in ("p", "x", "q", "y")), batch.column("side")[k].as_py()
                read = lambda c, kind: np.frombuffer(batch.column(c)[k].as_py(), dtype=kind)  # noqa: B023, E731
                own = read("ids", "<i8"), read("durations", "<f8"), read("frames", "<i8").reshape(4 + wide, -1)
                if side == 0:
                    held, first = key, own
                    if key[:2] != key[2:]:
                        continue
                if held != key:
                    continue
                for i, j, *counts in voted(first, None if side == 0 else own, tol_s, part, t, least, fraction):
                    a, b = first[0][i], own[0][j]
                    yield pa.record_batch(dict(zip(("a", "b", "sum", "comparable", "matching"), map(pa.array, (np.minimum(a, b), np.maximum(a, b), *(c.astype(np.int64) for c in counts))))))

    keys = ("p", "x", "q", "y")
    found = rows.repartition(max(1, int(2 * work / VIDEOS**2)), *keys).sortWithinPartitions(*keys, "side").mapInArrow(run, "a long, b long, sum long, comparable long, matching long")
    mean = F.when(F.col("matching") > 0, F.col("sum") / F.when(F.col("matching") > 0, F.col("matching")))
    return found.select("a", "b", F.bround(mean).cast("int").alias("distance"), "comparable", "matching")


def nearest(edges: DataFrame) -> DataFrame:
    """(id, distance, neighbours): the nearest neighbour's distance per member."""
    both = edges.select(F.col("a").alias("id"), "distance").unionByName(edges.select(F.col("b").alias("id"), "distance"))
    return both.groupBy("id").agg(F.min("distance").alias("distance"), F.count(F.lit(1)).alias("neighbours"))


def groups(edges: DataFrame) -> DataFrame:
    """(group_no, member_no, id): components numbered by their smallest member, members by id."""
    from pyspark.sql import Window

    from prismcat.operators.cluster import connected_components
    from prismcat.plans.scratch import numbered

    members = connected_components(edges)
    firsts = numbered(members.where("node = component").select("component"), ["component"], "group_no")
    nth = F.row_number().over(Window.partitionBy("component").orderBy("node"))
    return members.withColumn("member_no", nth).join(firsts, "component").select("group_no", "member_no", F.col("node").alias("id"))
