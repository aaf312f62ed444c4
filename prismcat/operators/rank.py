"""Which copy leads a group, and what decided it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def leads(members: DataFrame, keys: list[str], prefer: str | None = None, path: str = "path") -> DataFrame:
    """``members`` with is_lead: greatest keys, then the preferred side, then the smallest path."""
    order = [F.col(k).desc() for k in keys] + ([F.col(prefer).desc()] if prefer else []) + [F.col(path)]
    return members.withColumn("is_lead", (F.row_number().over(Window.partitionBy("group_no").orderBy(*order)) == 1).cast("int"))


def levels(members: DataFrame, keys: list[str], labels: list[str], prefer: str | None = None) -> DataFrame:
    """The lead of each group with ``level``: the shortest list of keys that singles it out, else preference or path."""
    led = leads(members, keys, prefer)
    for depth in range(1, len(keys) + 1):
        led = led.withColumn(f"_n{depth}", F.count(F.lit(1)).over(Window.partitionBy("group_no", *keys[:depth])))
    if prefer:
        tied = Window.partitionBy("group_no", *keys)
        led = led.withColumn("_split", F.min(prefer).over(tied) != F.max(prefer).over(tied))
    level = F.when(F.lit(False), "")
    for depth in range(1, len(keys) + 1):
        level = level.when(F.col(f"_n{depth}") == 1, " + ".join(labels[:depth]))
    if prefer:
        level = level.when(F.col("_split"), "preference")
    drop = [c for c in led.columns if c.startswith("_n") or c == "_split"]
    return led.where("is_lead = 1").withColumn("level", level.otherwise("path")).drop(*drop)


def keep_suggested(led: DataFrame) -> DataFrame:
    """The members to delete: all but the lead, in groups that have one."""
    has = F.max("is_lead").over(Window.partitionBy("group_no"))
    return led.withColumn("_has", has).where("_has = 1 AND is_lead = 0").drop("_has")


def exact_plan(instances: DataFrame, prefer_internal: bool = False) -> DataFrame:
    """Deletions among instances of the same asset: asset_id, path, is_external, reason, survivor.

    ``instances``: asset_id, path, mtime, is_external.  Normally an external copy (the smallest path) survives and
    all internal ones go; without one the oldest internal stays.  With ``prefer_internal`` the oldest internal copy
    survives and everything else goes, external copies too.  Survivors come from partial aggregates, so a content with
    very many copies meets in no task.
    """
    side = F.col("is_external") if prefer_internal else 1 - F.col("is_external")
    age = F.when(F.col("is_external") == 1, F.lit(0.0)).otherwise(F.coalesce("mtime", F.lit(0.0)))
    per = instances.groupBy("asset_id").agg(
        F.max("is_external").alias("has_ext"), F.max(1 - F.col("is_external")).alias("has_int"), F.count(F.lit(1)).alias("n"), F.min_by("path", F.struct(side, age, F.col("path"))).alias("survivor")
    )
    gone = instances.join(per.where("has_int = 1 AND n > 1"), "asset_id").where(F.col("path") != F.col("survivor"))
    if prefer_internal:
        reason = F.when(F.col("has_ext") == 1, "exact-internal-preferred").otherwise("exact-internal")
    else:
        gone = gone.where("is_external = 0")
        reason = F.when(F.col("has_ext") == 1, "exact-external").otherwise("exact-internal")
    return gone.select("asset_id", "path", "is_external", reason.alias("reason"), "survivor")


def representative(instances: DataFrame, root: int) -> DataFrame:
    """One instance per asset: in the root first, then the smallest path."""
    row = F.struct(*[c for c in instances.columns if c != "asset_id"])
    best = instances.groupBy("asset_id").agg(F.min_by(row, F.struct((F.col("root_id") != root), F.col("path"))).alias("_r"))
    return best.select("asset_id", *[F.col(f"_r.{c}").alias(c) for c in instances.columns if c != "asset_id"]).select(*instances.columns)
