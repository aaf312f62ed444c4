"""Mixing sources to target weights by hash-threshold histograms.

Sizes are summed by source and hash bucket; each source's budget then gives a
bucket at which its running sum crosses the budget, only that bucket is split
again, level by level, and at last every document is taken or not by comparing
its hash with its source's threshold.  Nothing is sorted, thresholds of growing
budgets are nested, and the same rows give the same mix.

DataFrame functions only.  Null sources form a source of their own (last);
null and empty texts have size 0; an empty table gives no rows.  Repeated rows
share a hash and are taken or left together.  There may be any number of
sources: their table is ranged, never ordered in one task, and it is broadcast
only if Spark finds it small; else it meets the documents in a sort-merge join,
whose hot sources adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismcat.llm._arrow import by_place, columns, place
from prismcat.plans.scratch import Scratch

#: Weights of the sources in ascending order of code points, null last, repeating.
WEIGHTS = (3, 1, 2)
#: All targets together, and one target at most, as shares of all and of the source's words.
SHARE, MOST = 1.5, 2.0
#: Buckets of a level as hexadecimal digits of the hash, and levels.
DIGITS, LEVELS = 3, 3


def _hash(doc, text) -> F.Column:
    """DIGITS * LEVELS hexadecimal digits as a long, from the document's id (without one: from its text)."""
    hexes = F.substring(F.md5(F.coalesce(doc.cast("string"), text, F.lit("")).cast("binary")), 1, DIGITS * LEVELS)
    return F.conv(hexes, 16, 10).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) and h of every row."""
    words = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x20\x09-\x0D]+", "a")
    size = F.length(F.translate(words, " \t\n\x0b\x0c\r", ""))
    return columns(docs, "doc_id", "text", "source").select(
        "doc_id", "source", size.cast("long").alias("size"), _hash(F.col("doc_id"), F.col("text")).alias("h")
    )


def running(rows: DataFrame, keys: list, sums: dict[str, str], scratch: Scratch) -> DataFrame:
    """``rows`` with running sums (the row itself left out) in the order of ``keys``, without one task for all rows.

    ``sums``: new column -> column.  Rows are ranged by the keys; what the driver sees is one row per partition.
    """
    placed = scratch.write(rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ranged")
    per = placed.groupBy("_part").agg(*[F.sum(c).cast("double").alias(n) for n, c in sums.items()]).orderBy("_part").collect()
    before, upto = {}, [0.0] * len(sums)
    for r in per:
        before[r[0]] = upto
        upto = [u + v for u, v in zip(upto, r[1:])]
    parts = range(max(before, default=0) + 1)
    within = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    out = placed
    for k, (n, c) in enumerate(sums.items()):
        offset = F.element_at(F.lit([before[p][k] if p in before else 0.0 for p in parts]), F.col("_part") + 1)
        out = out.withColumn(n, offset + F.coalesce(F.sum(c).over(within).cast("double"), F.lit(0.0)))
    return out.drop("_part")


def targets(sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """Per source: source, weight, source_size, target.

    ``sizes``: (source, source_size), any number of sources.  A source whose share by weight exceeds MOST times its
    size stops there and its excess goes to the others by weight; in order of size by weight, those that stop come
    first, so running sums find the level of the others: it falls from the first one that does not stop.
    """
    by_name = [F.col("source").isNull(), F.col("source")]
    numbered = running(sizes.withColumn("one", F.lit(1)), by_name, {"nth": "one"}, scratch)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("nth").cast("long") % len(WEIGHTS) + 1).cast("int"))
    weighed = numbered.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(MOST)).withColumn("ratio", F.col("most") / F.col("weight"))
    weighed = scratch.write(weighed.select("source", "source_size", "weight", "most", "ratio"), "weighed")
    every = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    total, weights = float(every[0] or 0) * SHARE, float(every[1] or 0)
    summed = running(weighed, [F.col("ratio"), *by_name], {"most_before": "most", "weight_before": "weight"}, scratch)
    leveled = scratch.write(
        summed.withColumn("level", (F.lit(total) - F.col("most_before")) / (F.lit(weights) - F.col("weight_before"))).withColumn("stops", F.col("ratio") <= F.col("level")), "leveled"
    )
    final = leveled.agg(F.max(F.when(~F.col("stops"), F.col("level")))).first()[0] or 0.0
    return leveled.select("source", "weight", "source_size", F.when(F.col("stops"), F.col("most")).otherwise(F.col("weight") * F.lit(float(final))).alias("target"))


def thresholds(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Per source: source, source_size, target, base, cutoff.

    Every document of the source is taken ``base`` times, and once more if its
    hash is below ``cutoff``.
    """
    sizes = scratch.write(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")
    goal = scratch.write(
        targets(sizes, scratch)
        .withColumn("base", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("left", F.col("target") - F.col("base") * F.col("source_size"))
        .withColumn("cutoff", F.lit(0).cast("long")),
        "targets",
    )
    base = 16**DIGITS
    for level in range(LEVELS):
        width = base ** (LEVELS - 1 - level)  # hashes in a bucket of this level
        here = rows.join(goal.select(F.col("source").alias("s"), F.col("cutoff")), F.col("source").eqNullSafe(F.col("s")))
        if level:
            here = here.where((F.col("h") >= F.col("cutoff")) & (F.col("h") < F.col("cutoff") + width * base))
        buckets = here.groupBy("source", F.floor(F.col("h") / width).cast("long").alias("bucket")).agg(F.sum("size").alias("n"))
        run = Window.partitionBy("source").orderBy("bucket")
        sums = buckets.withColumn("upto", F.sum("n").over(run)).withColumn("before", F.col("upto") - F.col("n"))
        last = level == LEVELS - 1
        # a bucket lies below the threshold if the budget covers it (at the last level: nearer with it than without)
        covered = F.col("upto") - (F.col("n") / 2 if last else F.lit(0.0)) <= F.col("left")
        step = (
            sums.join(goal.select(F.col("source").alias("s"), "left"), F.col("source").eqNullSafe(F.col("s")))
            .groupBy("source")
            .agg(
                F.min(F.when(~covered, F.col("bucket"))).alias("at"),
                F.max("bucket").alias("top"),
                F.sum(F.when(covered, F.col("n")).otherwise(F.lit(0))).alias("used"),
            )
        )
        # all covered: the threshold lies above the last bucket
        at = F.coalesce(F.col("at"), F.col("top") + 1)
        goal = scratch.write(
            goal.join(step.select(F.col("source").alias("s"), at.alias("at"), "used"), F.col("source").eqNullSafe(F.col("s")), "left").select(
                "source",
                "source_size",
                "target",
                "base",
                (F.col("left") - F.coalesce("used", F.lit(0))).alias("left"),
                F.when(F.col("at").isNotNull(), F.col("at") * width).otherwise(F.col("cutoff")).alias("cutoff"),
            ),
            "level",
        )
    return goal


def _copies(goal: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with source_size, target and ``copies``."""
    per = goal.select(F.col("source").alias("_s"), "source_size", "target", "base", "cutoff")
    return rows.join(per, F.col("source").eqNullSafe(F.col("_s"))).withColumn(
        "copies", F.col("base") + F.when((F.col("h") < F.col("cutoff")) & (F.col("base") < int(MOST)), 1).otherwise(0)
    )


def mix(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken."""
    scratch = Scratch(docs.sparkSession, "mix")
    rows = scratch.write(measured(docs), "sizes")
    return _copies(thresholds(rows, scratch), rows).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: the rows of ``docs`` with all their columns, each as often as it is taken.

    Documents without words cost nothing and stay once if their hash lies below the threshold or their source is taken whole.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    goal = thresholds(scratch.write(measured(docs), "sizes"), scratch)
    plain, names = by_place(docs)
    doc, text, source = (F.col(f"_c{place(names, n)}") for n in ("doc_id", "text", "source"))
    own = _copies(goal, plain.withColumn("h", _hash(doc, text)).withColumn("source", source))
    kept = [F.col(f"_c{i}") for i in range(len(names))]
    return own.select(*kept, F.explode(F.sequence(F.lit(0), F.col("copies"))).alias("_copy")).where("_copy > 0").select(*kept).toDF(*names)


def op8_source_mixing(spark, sf_dir: str) -> DataFrame:
    """Contract query: the mix of all ``documents``."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(doc_id::VARCHAR), 1, 9))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::DOUBLE AS source_size,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM d GROUP BY source
), r AS (
  SELECT *, 2 * source_size AS most, 2 * source_size / w AS ratio FROM s
), l AS (
  SELECT *, ((SELECT 1.5 * sum(source_size) FROM r)
             - coalesce((SELECT sum(b.most) FROM r b WHERE (b.ratio, b.source IS NULL, coalesce(b.source, '')) < (a.ratio, a.source IS NULL, coalesce(a.source, ''))), 0))
            / ((SELECT sum(w) FROM r)
             - coalesce((SELECT sum(b.w) FROM r b WHERE (b.ratio, b.source IS NULL, coalesce(b.source, '')) < (a.ratio, a.source IS NULL, coalesce(a.source, ''))), 0)) AS lev
  FROM r a
), t AS (
  SELECT source, source_size,
         CASE WHEN ratio <= lev THEN most ELSE w * coalesce((SELECT max(lev) FROM l WHERE ratio > lev), 0) END AS target
  FROM l
), u AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS base FROM t
), c AS (
  SELECT d.doc_id, d.size, u.source_size, u.target, u.base,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.h) AS n
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source
)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       (size * (base + CASE WHEN base < 2 AND upto - n / 2 <= target - base * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
