"""A listing of files against the catalog, and incoming files against memory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE_S = 2.0


def fastpath(existing: DataFrame, listing: DataFrame, tolerance: float = TOLERANCE_S) -> DataFrame:
    """``listing`` rows with hit: same path and size, mtime within the tolerance, fully fingerprinted; null mtime misses."""
    old = existing.select("root_id", "path", F.col("size").alias("_s"), F.col("mtime").alias("_m"), F.col("complete").alias("_c"))
    hit = (F.col("size") == F.col("_s")) & (F.abs(F.col("mtime") - F.col("_m")) <= tolerance) & F.col("_c")
    return listing.join(old, ["root_id", "path"], "left").withColumn("hit", F.coalesce(hit, F.lit(False))).drop("_s", "_m", "_c")


def below(paths: DataFrame, folders: DataFrame) -> DataFrame:
    """The distinct (root_id, path) that are one of ``folders`` (root_id, dir) or lie below one.

    Folders may be any number: a path and each folder above it are looked up by equality, as ``is_within`` would find them.
    """
    known = folders.select("root_id", F.regexp_replace("dir", "/+$", "").alias("_dir")).distinct()
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    keys = paths.select("root_id", "path").where("root_id IS NOT NULL AND path IS NOT NULL").distinct()
    return keys.withColumn("_dir", F.explode(above)).join(known, ["root_id", "_dir"], "left_semi").select("root_id", "path").distinct()


def contained(paths: DataFrame, path: str, folders: DataFrame, folder: str) -> DataFrame:
    """``paths`` with every row of ``folders`` whose folder is the path or lies above it, by an equi join on the folders above.

    Neither side need be small.  A folder's slashes at its end don't count; the root folder is above every path.
    """
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    plain = folders.withColumn("_dir", F.regexp_replace(folder, "/+$", ""))
    return paths.withColumn("_dir", F.explode(F.array_distinct(above))).join(plain, "_dir").drop("_dir")


def moves(existing: DataFrame, listing: DataFrame, tolerance: float = TOLERANCE_S, suppressed: DataFrame | None = None, fold: bool = False) -> DataFrame:
    """(fid, old_path, new_path): files found under another path.

    Name and size must be unique among all the root's instances and among listed paths that the catalog lacks; the
    old path must be gone from the listing and not below a suppressed folder, where its bytes may still be; mtimes must
    agree; the asset must be active and fully fingerprinted.  ``fold``: names and paths in any case are the same.
    """
    case = F.lower if fold else F.col
    bucket = ["root_id", "_name", "size"]
    known = existing.select("root_id", case("path").alias("_path"))
    found = listing.select("root_id", case("path").alias("_path"), case("filename").alias("_name"), "size", "path", "mtime")
    absent = found.join(known, ["root_id", "_path"], "left_anti")
    new = absent.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_n"), F.min("path").alias("new_path"), F.min("mtime").alias("_m")).where("_n = 1").drop("_n")
    rows = existing.select("root_id", case("filename").alias("_name"), "size", F.struct("fid", "path", "mtime", "status", "complete").alias("_o"))
    old = rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_n"), F.min("_o").alias("_o")).where("_n = 1 AND _o.status = 'active' AND _o.complete")
    pairs = old.join(new, bucket).where(F.abs(F.col("_o.mtime") - F.col("_m")) <= tolerance).select("root_id", F.col("_o.fid").alias("fid"), F.col("_o.path").alias("path"), "new_path")
    gone_ = pairs.withColumn("_path", case("path")).join(found.select("root_id", "_path"), ["root_id", "_path"], "left_anti").drop("_path")
    if suppressed is not None:
        gone_ = gone_.join(below(gone_, suppressed), ["root_id", "path"], "left_anti")
    return gone_.select("fid", F.col("path").alias("old_path"), "new_path")


def gone(existing: DataFrame, listing: DataFrame, moved: DataFrame, suppressed: DataFrame) -> DataFrame:
    """Instances neither listed nor moved nor below a suppressed folder."""
    left = existing.join(listing.select("root_id", "path"), ["root_id", "path"], "left_anti").join(moved.select("fid"), "fid", "left_anti")
    return left.join(below(left, suppressed), ["root_id", "path"], "left_anti")


def orphans(assets: DataFrame, instances: DataFrame, removed: DataFrame) -> DataFrame:
    """Active assets that lose their last instance; trashed ones are kept."""
    lost = removed.select("asset_id").distinct()
    alive = instances.join(removed, "fid", "left_anti").select("asset_id")
    return assets.where("status = 'active'").join(lost, "asset_id", "left_semi").join(alive, "asset_id", "left_anti")


def _first(rows: DataFrame, key: str, *order) -> DataFrame:
    """``rows`` with first: whether a row is its key's smallest by ``order``, found by partial aggregates."""
    best = rows.groupBy(key).agg(F.min(F.struct(*order)).alias("_best"))
    return rows.join(best, key, "left").withColumn("first", F.coalesce(F.struct(*order) == F.col("_best"), F.lit(True))).drop("_best")


def classify(incoming: DataFrame, assets: DataFrame, oldest: bool = True) -> DataFrame:
    """Incoming files as new, exact-known, trashed or dup-in-source.

    ``incoming``: hash, rel, mtime; the representative of a hash is the oldest (then the smallest rel), the others are
    dup-in-source.  ``assets``: hash, status.
    """
    order = [*([F.coalesce("mtime", F.lit(0.0))] if oldest else []), F.col("rel")]
    known = assets.select("hash", "status")
    kind = (
        F.when(~F.col("first"), "dup-in-source")
        .when(F.col("status").isNull(), "new")
        .when(F.col("status") == "trashed", "trashed")
        .otherwise("exact-known")
    )
    return _first(incoming, "hash", *order).join(known, "hash", "left").withColumn("class", kind).drop("first", "status")


def absorb(inbox: DataFrame, assets: DataFrame) -> DataFrame:
    """Files of a trash inbox: new_trashed, flipped, or already_trashed (also every later copy)."""
    kind = (
        F.when(~F.col("first") | (F.col("status") == "trashed"), "already_trashed")
        .when(F.col("status").isNull(), "new_trashed")
        .otherwise("flipped")
    )
    return _first(inbox, "hash", F.col("rel")).join(assets.select("hash", "status"), "hash", "left").withColumn("outcome", kind).drop("first", "status")


def untrash(files: DataFrame, assets: DataFrame, counts: DataFrame) -> DataFrame:
    """Files to bring back: untrashed, forgotten (no instance left), already_active or unknown; later copies follow the first."""
    n = F.coalesce("instances", F.lit(0))
    trashed = F.col("status") == "trashed"
    kind = (
        F.when(F.col("status").isNull(), "unknown")
        .when(trashed & (n > 0) & F.col("first"), "untrashed")
        .when(trashed & (n == 0) & F.col("first"), "forgotten")
        .when(trashed & (n == 0), "unknown")
        .otherwise("already_active")
    )
    joined = _first(files, "hash", F.col("rel")).join(assets.select("hash", "status"), "hash", "left").join(counts, "hash", "left")
    return joined.withColumn("outcome", kind).drop("first", "status", "instances")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same keys."""
    return old.join(new, keys, "left_anti").unionByName(new)
