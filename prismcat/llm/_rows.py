"""Keeping one row of each group without moving a whole group anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismcat.llm._arrow import by_place, place


def text_key(text) -> F.Column:
    """A 64-bit key of a text (null: empty)."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keep_rows(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows of ``docs`` that stay, with all their columns.

    ``decisions``: (doc_id, text_key, kept), a written table with one row per
    row of ``docs``.  Dropped rows go by an anti join on (doc_id, text key), so
    no group of copies meets in one task.  Rows repeated with the same id and
    text of which one stays are reduced to one.
    """
    keys = ["doc_id", "text_key"]
    per = decisions.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(F.col("kept").cast("int")).alias("k"))
    gone = per.where("k = 0").select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"))
    plain, names = by_place(docs)
    doc = F.col(f"_c{place(names, 'doc_id')}").cast("long")
    marked = plain.withColumn("_key", text_key(F.col(f"_c{place(names, 'text')}"))).withColumn("_doc", doc)
    on = F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k"))
    stay = marked.join(gone, on, "left_anti")
    twice = per.where("k = 1 AND n > 1").select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"))
    if not twice.isEmpty():
        once = stay.join(twice, on, "left_semi").dropDuplicates(["_doc", "_key"])
        stay = stay.join(twice, on, "left_anti").unionByName(once)
    return stay.drop("_key", "_doc").toDF(*names)
