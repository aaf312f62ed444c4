"""What a scan writes: outcomes of files against the catalog, and the tables after it.

``incoming``: root_id, path, hash, size, mtime, readable, decodable.  ``assets``: asset_id, hash, status, size,
undecodable, complete.  ``instances``: root_id, path, asset_id, size, mtime.  Every function gives a new table, which
``Store.commit`` makes the next version; nothing is changed in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismcat.plans.scratch import numbered


def resolve(incoming: DataFrame, assets: DataFrame, full: bool = False) -> DataFrame:
    """``incoming`` with asset_id and status of the known asset, creates, backfills and outcome.

    Of several files with one content the first by path decides; the others are attached to what it made.  A known asset
    is filled in if it lacks its signature, or, in a full scan, if it could not be decoded before.
    """
    known = assets.select("hash", "asset_id", "status", F.col("undecodable").alias("_u"), F.col("complete").alias("_c"))
    best = incoming.where("readable").groupBy("hash").agg(F.min("path").alias("_first"))
    rows = incoming.join(best, "hash", "left").join(known, "hash", "left")
    first = F.coalesce(F.col("path") == F.col("_first"), F.lit(False)) & F.col("readable")
    lacking = (F.col("_u") == 0) & ~F.col("_c")
    if full:
        lacking = lacking | (F.col("_u") == 1)
    rows = rows.withColumn("creates", first & F.col("asset_id").isNull()).withColumn("backfills", F.coalesce(first & lacking, F.lit(False)))
    decides = F.col("creates") | F.col("backfills")
    outcome = (
        F.when(~F.col("readable"), "errors")
        .when(decides & ~F.col("decodable"), "undecodable")
        .when(F.col("creates"), "new")
        .when(F.col("status") == "trashed", "matches_trashed")
        .when(F.col("backfills"), "backfilled")
        .otherwise("exact_dup")
    )
    return rows.withColumn("outcome", outcome).drop("_first", "_u", "_c")


def created(resolved: DataFrame, assets: DataFrame) -> DataFrame:
    """New assets, numbered on from the largest id in the order of their hashes."""
    top = assets.agg(F.coalesce(F.max("asset_id"), F.lit(0))).first()[0]
    fresh = numbered(resolved.where("creates").select("hash", "size", "decodable"), ["hash"], "nth")
    undecodable = (~F.col("decodable")).cast("int")
    return fresh.select((F.col("nth") + top).alias("asset_id"), "hash", F.lit("active").alias("status"), "size", undecodable.alias("undecodable"), F.lit(True).alias("complete"))


def backfilled(assets: DataFrame, resolved: DataFrame) -> DataFrame:
    """``assets`` with size, undecodable and complete of those that were filled in; their status stays."""
    new = resolved.where("backfills").select("asset_id", F.col("size").alias("_s"), (~F.col("decodable")).cast("int").alias("_u"))
    return assets.join(new, "asset_id", "left").withColumns(
        {"size": F.coalesce("_s", "size"), "undecodable": F.coalesce("_u", "undecodable"), "complete": F.col("complete") | F.col("_u").isNotNull()}
    ).select(*assets.columns)


def attached(instances: DataFrame, resolved: DataFrame, assets: DataFrame) -> DataFrame:
    """``instances`` with a row for every readable file, bound to its content's asset; rows of the same path are replaced."""
    ids = assets.select("hash", F.col("asset_id").alias("_id"))
    new = resolved.where("readable").join(ids, "hash").select("root_id", "path", F.col("_id").alias("asset_id"), "size", "mtime")
    return instances.join(new.select("root_id", "path"), ["root_id", "path"], "left_anti").unionByName(new)


def forgotten(assets: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """asset_id of active assets that had an instance and have none any more."""
    lost = before.select("asset_id").distinct().join(after.select("asset_id").distinct(), "asset_id", "left_anti")
    return assets.where("status = 'active'").join(lost, "asset_id", "left_semi").select("asset_id")


def relinked(instances: DataFrame, moves: DataFrame, seen_at: Column) -> DataFrame:
    """``instances`` with path, filename and last_seen of those that moved; sizes and times stay as they were."""
    to = moves.select("fid", "new_path")
    name = F.regexp_extract("new_path", r"([^/]*)$", 1)
    rows = instances.join(to, "fid", "left").withColumn("_moved", F.col("new_path").isNotNull())
    new = {"path": F.coalesce("new_path", "path"), "filename": F.when(F.col("_moved"), name).otherwise(F.col("filename")), "last_seen": F.when(F.col("_moved"), seen_at).otherwise(F.col("last_seen"))}
    return rows.withColumns(new).select(*instances.columns)


def signed(signatures: DataFrame, new: DataFrame, undecodable: DataFrame) -> DataFrame:
    """``signatures`` (asset_id, frame, ...) with the rows of ``new`` in place of all earlier ones of their assets, and none of undecodable ones."""
    fresh = new.join(undecodable.select("asset_id"), "asset_id", "left_anti")
    touched = new.select("asset_id").union(undecodable.select("asset_id")).distinct()
    return signatures.join(touched, "asset_id", "left_anti").unionByName(fresh)


def dirty_roots(resolved: DataFrame) -> DataFrame:
    """root_id of the roots that have new content to look for duplicates of."""
    fresh = F.col("decodable") & (F.col("creates") | (F.col("backfills") & (F.col("status") != "trashed")))
    return resolved.where(fresh).select("root_id").distinct()


OUTCOMES = ("new", "exact_dup", "backfilled", "matches_trashed", "undecodable", "errors")


def report(resolved: DataFrame, assets: DataFrame, instances: DataFrame) -> DataFrame:
    """Per root: candidates and outcomes of this pass, and undecodable files as the catalog has them now."""
    tally = [F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES if o != "undecodable"]
    per = resolved.groupBy("root_id").agg(F.count(F.lit(1)).alias("candidates"), *tally)
    now = problem_files(resolved, assets, instances).where("problem = 'undecodable'").groupBy("root_id").agg(F.count(F.lit(1)).alias("undecodable"))
    return per.join(now, "root_id", "left").withColumn("undecodable", F.coalesce("undecodable", F.lit(0)))


def problem_files(resolved: DataFrame, assets: DataFrame, instances: DataFrame) -> DataFrame:
    """root_id, path, problem: unreadable files of this pass, and undecodable ones from the catalog."""
    bad = assets.where("undecodable = 1").select("asset_id")
    held = instances.join(bad, "asset_id", "left_semi").select("root_id", "path", F.lit("undecodable").alias("problem")).distinct()
    return held.unionByName(resolved.where("outcome = 'errors'").select("root_id", "path", F.lit("read-error").alias("problem")))


def upserted_edges(edges: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """``edges`` (a, b, media_type, distance, algo, created_at) with distance, algo and time of ``new``; a known pair keeps its medium."""
    fresh = new.where("a < b").select("a", "b", F.col("media_type").alias("_m"), F.col("distance").alias("_d"), F.col("algo").alias("_a"))
    both = edges.join(fresh, ["a", "b"], "full")
    hit = F.col("_d").isNotNull()
    return both.select(
        "a", "b", F.coalesce("media_type", "_m").alias("media_type"), F.coalesce("_d", "distance").alias("distance"), F.coalesce("_a", "algo").alias("algo"), F.when(hit, now).otherwise(F.col("created_at")).alias("created_at")
    )


def plan_roots(roots: DataFrame, holders: DataFrame, everything: bool = True) -> DataFrame:
    """root_id, action, reason: which roots a scan walks.  Trash roots and busy ones are skipped; disabled ones are no part of a sweep."""
    rows = roots.where("enabled = 1") if everything else roots
    held = holders.select("root_id", "what").dropDuplicates(["root_id"])
    reason = F.when(F.col("kind") == "trash", "trash root").when(F.col("what").isNotNull(), F.concat(F.lit("busy: "), "what"))
    return rows.join(held, "root_id", "left").select("root_id", F.when(reason.isNull(), "scan").otherwise("skip").alias("action"), reason.alias("reason"))


def summary(tally: DataFrame, key: str, labels: dict[str, str]) -> DataFrame:
    """One line per ``key`` from (key, outcome, n): what happened, in the order of ``labels``; nothing is ``no changes``."""
    counts = tally.groupBy(key).agg(*[F.coalesce(F.sum(F.when(F.col("outcome") == o, F.col("n"))), F.lit(0)).alias(o) for o in labels])
    parts = F.array(*[F.when(F.col(o) > 0, F.concat(F.format_number(o, 0), F.lit(f" {label}"))) for o, label in labels.items()])
    text = F.array_join(F.array_compact(parts), " · ")
    return counts.select(key, F.when(text == "", "no changes").otherwise(text).alias("summary"))
