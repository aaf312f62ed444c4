"""Queries of files, headers and the store, with their SQL equivalents where there is one."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismcat.operators import reconcile, scan, store
from prismcat.plans.registry import query
from prismcat.plans.scratch import Scratch
from prismcat.sources import catalog as C
from prismcat.sources import decode, files, probe, sinks, walk

IGNORE = ["cache/", "*_skip.jpg"]


def _tree(spark, sf_dir: str) -> str:
    """A small folder tree, a file per nation, in the folder that driver and executors share."""
    scratch = Scratch(spark, "tree")
    root = scratch.base.removeprefix("file://").removeprefix("file:") + "/lib"
    scratch.until_exit()
    for n in C.table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").collect():  # the files of a fixture
        k = n.n_nationkey
        folder = ("cache", "_prismcat_review", "_a/.b", "plain")[k % 4]
        name = ("x{}.jpg", "x{}.txt", "x{}.lnk", "x{}.CR2", "x{}_skip.jpg", ".x{}.PNG", "e{}.png")[k % 7].format(k)
        os.makedirs(f"{root}/r{n.n_regionkey}/{folder}", exist_ok=True)
        with open(f"{root}/r{n.n_regionkey}/{folder}/{name}", "wb") as f:
            f.write(b"" if k % 7 == 6 else str(k).encode() * 3)
    return root


_TREE = """tree AS (SELECT n_nationkey AS k, 'r' || n_regionkey AS region, ['cache', '_prismcat_review', '_a/.b', 'plain'][(n_nationkey % 4 + 1)::INT] AS folder,
  [concat('x', n_nationkey, '.jpg'), concat('x', n_nationkey, '.txt'), concat('x', n_nationkey, '.lnk'), concat('x', n_nationkey, '.CR2'), concat('x', n_nationkey, '_skip.jpg'), concat('.x', n_nationkey, '.PNG'), concat('e', n_nationkey, '.png')][(n_nationkey % 7 + 1)::INT] AS name
  FROM nation), files AS (SELECT *, region || '/' || folder || '/' || name AS rel, CASE WHEN k % 7 = 6 THEN '' ELSE repeat(k::VARCHAR, 3) END AS content FROM tree WHERE folder IN ('_a/.b', 'plain') AND k % 7 IN (0, 5, 6))"""


@query(f"""WITH {_TREE} SELECT CASE WHEN content = '' THEN 'junk' ELSE 'file' END AS kind, rel, length(content) AS size, CASE WHEN content = '' THEN 'zero-byte' END AS reason FROM files
  UNION ALL SELECT DISTINCT 'suppressed', region || '/' || folder, NULL, 'ignored' FROM tree WHERE folder IN ('cache', '_prismcat_review')""")
def folder_walk(spark, sf_dir: str) -> DataFrame:
    """Media files of a folder tree, junk with its reason, and folders that were not entered."""
    return walk.listing(spark, _tree(spark, sf_dir), IGNORE).select("kind", "rel", "size", "reason")


@query(f"WITH {_TREE} SELECT rel, sha256(content) AS content_hash FROM files WHERE content <> ''")
def file_hashes(spark, sf_dir: str) -> DataFrame:
    """Contents of the files that a walk finds, by a digest read in chunks."""
    root = _tree(spark, sf_dir)
    found = walk.listing(spark, root, IGNORE).where("kind = 'file'")
    return walk.hashed(found, chunk=2).select(F.substring("path", len(root) + 2, 1 << 20).alias("rel"), "content_hash")


@query(f"""WITH {_TREE} SELECT rel, CASE k % 3 WHEN 0 THEN 'copied' WHEN 1 THEN 'ValueError' ELSE 'identical' END AS result, CASE WHEN k % 3 = 1 THEN 'missing' ELSE 'done' END AS removed FROM files WHERE content <> ''""")
def file_copies(spark, sf_dir: str) -> DataFrame:
    """Verified copies of the files of a tree: made, refused because the bytes are not the planned ones, or there already; then deleted."""
    root = _tree(spark, sf_dir)
    there = root.removesuffix("/lib") + "/copies"
    found = walk.hashed(walk.listing(spark, root, IGNORE).where("kind = 'file'").select("path"))
    rel = F.substring("path", len(root) + 2, 1 << 20)
    key = F.regexp_extract("path", r"x(\d+)[.]", 1).cast("int") % 3
    plan = found.select(F.col("path").alias("source"), F.concat(F.lit(there + "/"), rel).alias("dest"), F.when(key == 1, "other").otherwise(F.col("content_hash")).alias("hash"), rel.alias("rel"), key.alias("key"))
    scratch = Scratch(spark, "copies")
    plan = scratch.write(plan, "plan")
    scratch.write(files.copies(plan.where("key = 2")), "before")
    made = scratch.write(files.copies(plan), "made")
    gone = scratch.write(files.removals(plan.select(F.col("dest").alias("path"))), "gone").toDF("dest", "removed")
    rows = plan.join(made.toDF("dest", "result"), "dest").join(gone, "dest")
    return rows.select("rel", F.regexp_extract("result", r"^(\w+)", 1).alias("result"), "removed")


@query("SELECT n_nationkey AS id, (n_nationkey % 9 + 1) / 2.0 AS duration_s, 100 + n_nationkey AS width, 50 + n_nationkey AS height, CASE WHEN n_nationkey % 2 = 0 THEN 'h264' ELSE 'hevc' END AS codec, strftime(TIMESTAMP '2020-01-01' + to_days(n_nationkey::INT), '%Y-%m-%d %H:%M:%S') AS captured_at FROM nation")
def video_headers(spark, sf_dir: str) -> DataFrame:
    """What the headers of video files tell: files are made of a table's rows, and read back."""

    def box(kind: bytes, *parts: bytes) -> bytes:
        body = b"".join(parts)
        return struct.pack(">I4s", len(body) + 8, kind) + body

    def made(k: int) -> bytes:
        created = 3_660_681_600 + 86_400 * k  # seconds from 1904 to 2020
        clock = struct.pack(">IIIII", 0, created, 0, 2, k % 9 + 1)
        entry = box(b"avc1" if k % 2 == 0 else b"hev1", b"\0" * 24, struct.pack(">HH", 100 + k, 50 + k))
        media = box(b"mdia", box(b"mdhd", clock), box(b"hdlr", b"\0" * 8 + b"vide"), box(b"minf", box(b"stbl", box(b"stsd", b"\0" * 8, entry))))
        return box(b"ftyp", b"isom") + box(b"moov", box(b"mvhd", clock), box(b"trak", media))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [{"id": k} | probe.mp4_header(made(k)) for k in batch.column("id").to_pylist()]
            yield pa.RecordBatch.from_pylist(heads, schema=pa.schema([("id", pa.int64()), ("duration_s", pa.float64()), ("width", pa.int32()), ("height", pa.int32()), ("codec", pa.string()), ("captured_at", pa.string())]))

    rows = C.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    return rows.mapInArrow(run, "id long, duration_s double, width int, height int, codec string, captured_at string")


@query()
def picture_fingerprints(spark, sf_dir: str) -> DataFrame:
    """PDQ fingerprints of pictures made of vectors (no SQL expresses them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id").to_pylist()
            contents = [decode.sample_ppm(k % 97) if k % 10 else b"no picture" for k in ids]
            yield pa.record_batch({"path": pa.array([f"/v/{k}.ppm" for k in ids]), "content": pa.array(contents, pa.binary())})

    pictures = C.table(spark, sf_dir, "embeddings").select("vec_id").mapInArrow(run, "path string, content binary")
    return decode.fingerprints(pictures).select("path", "content_hash", "width", "height", "l0", "l1", "l2", "l3", "quality", "undecodable")


@query("SELECT n_regionkey AS region, count(*) FILTER (n_nationkey % 2 = 0) AS before_, count(*) FILTER (n_nationkey % 2 = 0 OR n_nationkey % 3 = 0) AS after_, 2 AS version FROM nation GROUP BY n_regionkey")
def store_versions(spark, sf_dir: str) -> DataFrame:
    """A reader of an older version sees it whole, whatever was committed since."""
    library = _library(spark, sf_dir)
    rows = C.table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    with library.transaction() as outer:
        with library.transaction() as inner:
            inner["nation"] = library.read("nation", 1).unionByName(rows.where("n_nationkey % 2 = 1 AND n_nationkey % 3 = 0"))
        outer["other"] = rows
    count = lambda v, name: library.read("nation", v).groupBy(F.col("n_regionkey").alias("region")).agg(F.count(F.lit(1)).alias(name))
    old, new = count(1, "before_"), count(None, "after_")
    return new.join(old, "region", "left").select("region", F.coalesce("before_", F.lit(0)).alias("before_"), "after_", F.lit(library.version()).alias("version"))


def _library(spark, sf_dir: str) -> store.Store:
    scratch = Scratch(spark, "store")
    library = store.Store(spark, f"{scratch.base}/store")
    library.commit({"nation": C.table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").where("n_nationkey % 2 = 0"), "meta": spark.range(2)})
    scratch.until_exit()
    return library


@query("SELECT 'nation' AS name, count(*) FILTER (n_nationkey % 2 = 0) AS rows_before, 0 AS rows_after FROM nation UNION ALL SELECT 'meta', 2, 2")
def store_cleared(spark, sf_dir: str) -> DataFrame:
    """Rows of every table before and after the catalog was emptied; ``meta`` stays."""
    library = _library(spark, sf_dir)
    sizes = {n: library.read(n).count() for n in library.tables()}
    cleared = library.clear()
    assert cleared == {n: c for n, c in sizes.items() if n != "meta"}
    rows = [(n, c, library.read(n).count()) for n, c in sizes.items()]
    return spark.createDataFrame(rows, "name string, rows_before long, rows_after long")


@query("SELECT n_nationkey, n_regionkey, NULL::VARCHAR AS note, 3 AS tables, '2' AS stamp FROM nation WHERE n_nationkey % 2 = 0")
def schema_retrofit(spark, sf_dir: str) -> DataFrame:
    """A table of an older schema after the newer one was laid over it, twice."""
    library = _library(spark, sf_dir)
    library.commit({"meta": spark.createDataFrame([("schema_version", "1")], "key string, value string")})
    schemas = {"nation": "n_nationkey long, n_regionkey long, note string", "runs": "run_id int"}
    for _ in range(2):
        library.init(schemas, 2)
    stamp = library.read("meta").where("key = 'schema_version'").first().value
    assert library.version() == 3
    return library.read("nation").select("n_nationkey", "n_regionkey", "note", F.lit(len(library.tables())).alias("tables"), F.lit(stamp).alias("stamp"))


@query(f"""WITH {C.CONTENTS}, d AS (SELECT DISTINCT source, hash FROM content WHERE source IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY hash) AS nth FROM d)
  SELECT source AS folder, hash, CASE nth WHEN 1 THEN 'p (2).jpg' WHEN 2 THEN 'p (3).jpg' ELSE 'p (' || (nth + 2) || ').jpg' END AS placed FROM n""")
def copy_names(spark, sf_dir: str) -> DataFrame:
    """Names of copies in folders where p, p (1) and p (4) are taken."""
    rows = C.contents(spark, sf_dir).where("source IS NOT NULL").select(F.col("source").alias("folder"), F.lit("p.jpg").alias("name"), "hash").distinct()
    held = rows.select("folder").distinct().withColumn("name", F.explode(F.array(*[F.lit(x) for x in ("p.jpg", "p (1).jpg", "p (4).jpg")]))).withColumn("hash", F.concat(F.lit("held "), "name"))
    return store.placed_names(rows, held).select("folder", "hash", "placed")


@query(f"""WITH {C.ACTIONS} SELECT shortcut_name AS shortcut, path AS target_path, asset_id::VARCHAR AS asset_id, reason, '' AS survivor_path FROM actions WHERE kind = 'exact'""")
def exact_manifest(spark, sf_dir: str) -> DataFrame:
    """The manifest of the exact stage, written and read back."""
    scratch = Scratch(spark, "manifest")
    plan = sinks.exact_manifest(C.actions(spark, sf_dir).where("kind = 'exact'").withColumn("survivor", F.lit(None).cast("string")))
    sinks.manifest(plan, f"{scratch.base}/exact", sinks.EXACT_COLUMNS)
    scratch.until_exit()
    # back slashes are letters here, not escapes
    back = spark.read.option("header", True).option("escape", "\0").schema(", ".join(f"{c} string" for c in sinks.EXACT_COLUMNS)).csv(f"{scratch.base}/exact")
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in sinks.EXACT_COLUMNS])


MERGE_LABELS = {"new": "copied", "exact-known": "already here", "trashed": "in the trash", "dup-in-source": "twice in the source"}


@query(f"""WITH {C.memory_sql("source >= 'src2'")}, cls AS (SELECT i.source, CASE WHEN nth > 1 THEN 'dup-in-source' WHEN status IS NULL THEN 'new' WHEN status = 'trashed' THEN 'trashed' ELSE 'exact-known' END AS outcome
    FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY coalesce(mtime, 0.0), path) AS nth FROM content WHERE source < 'src2') i LEFT JOIN known k ON k.hash = i.hash), t AS (SELECT source, outcome, count(*) AS n FROM cls GROUP BY ALL)
  SELECT source, concat_ws(' · ', {", ".join(f"CASE WHEN sum(n) FILTER (outcome = '{o}') > 0 THEN format('{{:,}}', sum(n) FILTER (outcome = '{o}')::BIGINT) || ' {label}' END" for o, label in MERGE_LABELS.items())}) AS summary FROM t GROUP BY source""")
def merge_summary_lines(spark, sf_dir: str) -> DataFrame:
    """What a merge does with each source, as one line."""
    incoming = C.contents(spark, sf_dir).where("source < 'src2'").select("hash", F.col("path").alias("rel"), "mtime", "source")
    told = reconcile.classify(incoming, C.memory(spark, sf_dir, "source >= 'src2'"))
    return scan.summary(told.groupBy("source", F.col("class").alias("outcome")).agg(F.count(F.lit(1)).alias("n")), "source", MERGE_LABELS)
