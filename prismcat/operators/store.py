"""Versioned snapshots of the catalog's tables.

Parquet tables know no transactions.  A commit writes the tables that change below a new version, then a small manifest
that names the place of every table, and at last moves the pointer ``CURRENT``; readers see the old version or the new
one, never half of it.  Older versions stay as backups until they are dropped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismcat.plans.ship import ship

#: Tables that go with an asset (a fixed value): table -> column of the asset's id.
DEPENDENTS = {"file_instances": "asset_id", "phash": "asset_id", "vphash": "asset_id", "embeddings": "asset_id", "edges_a": "asset_a", "edges_b": "asset_b"}


class Conflict(RuntimeError):
    """Another writer has the version that this one wanted."""


class Store:
    """A catalog below a folder of any store that Spark writes to."""

    def __init__(self, spark: SparkSession, base: str):
        ship(spark)
        self.spark, self.base = spark, base.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._open: dict[str, DataFrame] | None = None

    def _path(self, rel: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{rel}")

    def _read(self, rel: str) -> str | None:
        path = self._path(rel)
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write(self, rel: str, text: str) -> None:
        out = self._fs.create(self._path(rel), True)
        out.write(bytearray(text.encode()))
        out.hsync()
        out.close()

    def version(self) -> int:
        """The current version, 0 before the first commit."""
        return int(self._read("CURRENT") or 0)

    def tables(self, version: int | None = None) -> dict[str, str]:
        """Places of the tables."""
        v = self.version() if version is None else version
        return json.loads(self._read(f"v={v:06d}/MANIFEST.json") or "{}")

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a version."""
        return self.spark.read.parquet(f"{self.base}/{self.tables(version)[name]}")

    def _claim(self, version: int) -> None:
        """Make a version ours: its claim can be created once, so of two writers one fails before it writes anything."""
        path = self._path(f"v={version:06d}/CLAIM")
        try:
            self._fs.create(path, False).close()
        except Exception as e:  # noqa: BLE001  the file system's own error, whatever its kind
            raise Conflict(f"version {version} is being written") from e

    def abandon(self) -> None:
        """Drop what a writer that died left beyond the current version, its claim too."""
        for status in self._fs.listStatus(self._path("")):
            name = status.getPath().getName()
            if name.startswith("v=") and int(name[2:]) > self.version():
                self._fs.delete(status.getPath(), True)

    def backup(self, label: str) -> str:
        """Keep the current version under a name that says why; its tables stay as they are."""
        rel = f"BACKUP-{label}-v{self.version():06d}.json"
        self._write(rel, json.dumps({"version": self.version(), "tables": self.tables()}, sort_keys=True))
        return rel

    def commit(self, changed: dict[str, DataFrame]) -> int:
        """Write the changed tables and make them and all others the new version; ``Conflict`` if another writer is at it."""
        v = self.version() + 1
        self._claim(v)
        places = self.tables()
        for name, df in changed.items():
            places[name] = f"v={v:06d}/{name}"
            df.write.mode("overwrite").parquet(f"{self.base}/{places[name]}")
        self._write(f"v={v:06d}/MANIFEST.json", json.dumps(places, sort_keys=True))
        self._write("CURRENT.next", str(v))
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.spark._jsc.hadoopConfiguration())
        how = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(self._path("CURRENT.next"), self._path("CURRENT"), how)
        return v

    @contextmanager
    def transaction(self) -> Iterator[dict[str, DataFrame]]:
        """Tables put into the given dict are committed together when the outermost block ends well, and not at all otherwise."""
        outermost = self._open is None
        if outermost:
            self._open = {}
        try:
            yield self._open
            if outermost and self._open:
                self.commit(self._open)
        finally:
            if outermost:
                self._open = None

    def init(self, schemas: dict[str, str], stamp: int = 1) -> None:
        """Create the tables that are missing, add the columns that tables lack (null), and stamp the schema's version.

        Done twice it changes nothing.
        """
        have, changed = self.tables(), {}
        for name, schema in schemas.items():
            want = self.spark.createDataFrame([], schema).schema
            if name not in have:
                changed[name] = self.spark.createDataFrame([], want)
            elif lack := [f for f in want.fields if f.name not in self.read(name).columns]:
                changed[name] = self.read(name).withColumns({f.name: F.lit(None).cast(f.dataType) for f in lack})
        meta = self.spark.range(1).select(F.lit("schema_version").alias("key"), F.lit(str(stamp)).alias("value"))
        if "meta" not in have:
            changed["meta"] = meta
        elif self.read("meta").where(F.col("key") == "schema_version").where(F.col("value") == str(stamp)).isEmpty():
            changed["meta"] = self.read("meta").where(F.col("key") != "schema_version").unionByName(meta)
        if changed:
            self.commit(changed)

    def restore(self, version: int) -> int:
        """Make an older version's tables the newest version."""
        return self.commit({n: self.read(n, version) for n in self.tables(version)})

    def clear(self, keep: tuple[str, ...] = ("meta",)) -> dict[str, int]:
        """Empty all tables but ``keep``; the rows that each had."""
        names = [n for n in self.tables() if n not in keep]
        counts = {n: self.read(n).count() for n in names}
        self.commit({n: self.read(n).limit(0) for n in names})
        return counts


def insert_new(assets: DataFrame, incoming: DataFrame, key: str = "content_hash") -> DataFrame:
    """``assets`` with one row for every hash that it lacks (the smallest path names it)."""
    fresh = incoming.join(assets, key, "left_anti")
    cols = [c for c in assets.columns if c != key]
    best = fresh.groupBy(key).agg(F.min_by(F.struct(*cols), F.col("path") if "path" in fresh.columns else F.col(key)).alias("r"))
    return assets.unionByName(best.select(key, *[F.col(f"r.{c}").alias(c) for c in cols]))


def forget(assets: DataFrame, instances: DataFrame, dependents: dict[str, tuple[DataFrame, str]]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Drop active assets without an instance, and what depends on them; trashed ones are kept."""
    alive = instances.select(F.col("asset_id").alias("_a")).distinct()
    kept = assets.join(alive, F.col("asset_id") == F.col("_a"), "left").where("status = 'trashed' OR _a IS NOT NULL").drop("_a")
    ids = kept.select(F.col("asset_id").alias("_k"))
    return kept, {n: df.join(ids, F.col(c) == F.col("_k"), "left_semi") for n, (df, c) in dependents.items()}


def placed_names(incoming: DataFrame, taken: DataFrame) -> DataFrame:
    """Where copies go: ``incoming`` (folder, name, hash) against ``taken`` (folder, name, hash).

    A name that is free is used; one that the same content has is reused; otherwise the first free ``stem (n).ext``
    counts up, each incoming file taking the next one.  Gives placed and reused.  Free numbers come from the gaps between
    used ones, a row per gap, so no folder's names are gathered.
    """
    stem = lambda c: F.regexp_replace(c, r"( \(\d+\))?(\.[^.]*)?$", "")
    tail = lambda c: F.regexp_extract(c, r"(\.[^.]*)$", 1)
    number = F.coalesce(F.regexp_extract("name", r" \((\d+)\)(\.[^.]*)?$", 1).try_cast("int"), F.lit(0))
    keys = ["folder", "stem", "tail"]
    have = taken.select("folder", stem(F.col("name")).alias("stem"), tail(F.col("name")).alias("tail"), number.alias("number"), "hash", "name")
    old = have.groupBy(*keys, "hash").agg(F.min("name").alias("old"))
    rows = incoming.select("folder", "name", "hash", stem(F.col("name")).alias("stem"), tail(F.col("name")).alias("tail")).join(old, [*keys, "hash"], "left")
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("hash", "name"))
    fresh = rows.where("old IS NULL").withColumn("nth", nth)
    # before the k-th used number (from 0) lie number - k free ones: the nth free number is nth - 1 + the used ones before it
    used = have.select(*keys, "number").distinct()
    free_before = F.col("number") - (F.row_number().over(Window.partitionBy(*keys).orderBy("number")) - 1)
    steps = used.withColumn("free", free_before).groupBy(*keys, "free").agg(F.count(F.lit(1)).alias("held"))
    upto = steps.withColumn("taken_by", F.sum("held").over(Window.partitionBy(*keys).orderBy("free"))).select(*keys, "free", "taken_by")
    at = fresh.join(upto, keys, "left").where("free IS NULL OR free < nth").groupBy(*keys, "name", "hash", "nth").agg(F.max("taken_by").alias("taken_by"))
    free = fresh.join(at, [*keys, "name", "hash", "nth"], "left").withColumn("free", F.col("nth") - 1 + F.coalesce("taken_by", F.lit(0)))
    name = F.concat("stem", F.when(F.col("free") > 0, F.concat(F.lit(" ("), F.col("free"), F.lit(")"))).otherwise(""), F.col("tail"))
    given = free.select("folder", "name", "hash", name.alias("placed"), F.lit(False).alias("reused"))
    return given.unionByName(rows.where("old IS NOT NULL").select("folder", "name", "hash", F.col("old").alias("placed"), F.lit(True).alias("reused")))
