"""Written tables that cut lineage.

Iterative plans need a durable cut: a result that survives the loss of any
executor and that later steps read instead of recomputing.  The cut is a
Parquet table below ``spark.checkpoint.dir``, the folder that driver and
executors share.  Only where that setting is absent (unit tests) a folder next
to the warehouse is taken instead.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismcat.plans.ship import ship


def shared_dir(spark: SparkSession) -> str:
    """The folder for written tables, visible to the driver and all executors."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-scratch"
    return base.rstrip("/")


class Scratch:
    """A set of written tables; what is not dropped before goes when the session's JVM ends."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def write(self, df: DataFrame, label: str = "t") -> DataFrame:
        """Write ``df`` and return it as read back, with the same columns."""
        self._n += 1
        path = f"{self.base}/{self._n:03d}-{label}"
        df.write.option("compression", "zstd").parquet(path)
        self.until_exit()
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def until_exit(self) -> None:
        """Have the folder deleted when the JVM ends."""
        fs, p = self._at(self.base)
        fs.deleteOnExit(p)

    def drop(self, *tables: DataFrame) -> None:
        """Delete written tables that no later step reads."""
        for df in tables:
            path = getattr(df, "_scratch_path", None)
            if path:
                fs, p = self._at(path)
                fs.delete(p, True)


    def keep_only(self, *tables: DataFrame) -> None:
        """Delete all written tables but these."""
        kept = {getattr(df, "_scratch_path", None) for df in tables}
        fs, base = self._at(self.base)
        if fs.exists(base):
            for status in fs.listStatus(base):
                if f"{self.base}/{status.getPath().getName()}" not in kept:
                    fs.delete(status.getPath(), True)


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df`` with ``name``, its rows' numbers from 1 in the order of ``keys``, without gathering them in one task.

    Rows are ranged by the keys; what the driver sees is one count per partition.
    """
    place = F.monotonically_increasing_id()
    rows = Scratch(df.sparkSession, "numbered").write(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.shiftright(place, 33)).withColumn("_row", place.bitwiseAND((1 << 33) - 1))
    )
    before, offsets = 0, []
    for part, n in sorted(tuple(r) for r in rows.groupBy("_part").count().collect()):
        offsets.append((part, before))
        before += n
    table = df.sparkSession.createDataFrame(offsets, "_part long, _before long")
    return rows.join(F.broadcast(table), "_part").withColumn(name, F.col("_before") + F.col("_row") + 1).drop("_part", "_row", "_before")
