"""Files that people and auditors read: manifests and immutable audit records."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismcat.functions import exprs as X

#: Columns of the stage manifests (fixed values).
EXACT_COLUMNS = ["shortcut", "target_path", "asset_id", "reason", "survivor_path"]
CLEANUP_COLUMNS = ["shortcut_name", "path", "asset_id", "reason", "distance", "matched_trashed_asset_id", "size"]
GROUP_COLUMNS = [
    "shortcut", "target_path", "asset_id", "group_no", "member_no", "suggested_lead", "suggested_reason", "media_type", "width",
    "height", "size", "duration_s", "codec", "bitrate", "is_external", "distance", "quality", "low_confidence",
]


def safe_name(name: Column) -> Column:
    """A name that may stand in a path: letters, digits and a few marks, anything else an underscore."""
    return F.regexp_replace(name, r"(?U)[^\p{Alnum} ._-]", "_")


def exact_manifest(plan: DataFrame) -> DataFrame:
    """The five columns of the exact stage, from shortcut_name, path, asset_id, reason, survivor."""
    names = ["shortcut_name", "path", "asset_id", "reason", "survivor"]
    return plan.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in zip(names, EXACT_COLUMNS)])


def group_manifest(plan: DataFrame) -> DataFrame:
    """The eighteen columns of the group stages; what is unknown is empty."""
    given = {"shortcut": "shortcut_name", "target_path": "path", "suggested_lead": "is_lead", "suggested_reason": "lead_reason"}
    rows = plan.withColumn("bitrate", X.bitrate(F.col("size"), F.col("duration_s")))
    return rows.select(*[F.coalesce(F.col(given.get(n, n)).cast("string"), F.lit("")).alias(n) for n in GROUP_COLUMNS])


def manifest(plan: DataFrame, out: str, columns: list[str]) -> None:
    """A plan as CSV with a header, ranged by its first column, so the files in their order are the sorted plan; null is empty."""
    rows = plan.select(*[F.col(c).cast("string").alias(c) for c in columns])
    rows.repartitionByRange(columns[0]).sortWithinPartitions(columns[0]).write.option("header", True).option("emptyValue", "").option("nullValue", "").csv(out)


def audit(rows: DataFrame, out: str) -> None:
    """Rows as JSON lines in a folder that must not exist yet."""
    rows.write.mode("errorifexists").json(out)


def audit_document(spark: SparkSession, folder: str, name: str, document: dict) -> str:
    """One JSON document that is whole or not there, and never replaced: written beside its place, flushed, then renamed."""
    jvm, text = spark._jvm, json.dumps(document, sort_keys=True, ensure_ascii=False, indent=2)
    path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path):
        raise FileExistsError(path.toString())
    beside = jvm.org.apache.hadoop.fs.Path(path.toString() + ".tmp")
    stream = fs.create(beside, True)
    stream.write(bytearray(text.encode()))
    stream.hsync()
    stream.close()
    if not fs.rename(beside, path):
        raise FileExistsError(path.toString())
    return path.toString()
