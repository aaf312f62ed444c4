"""Catalog tables derived from the test tables, in Spark and in SQL alike.

Assets come from orders, file instances from lineitem, jobs from events, content hashes from documents, trash memory
from labels, photo signatures from embeddings, video frames from conversations.  Each function has a common table
expression of the same name below it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismcat.functions.exprs import complete, group_shortcut, leaf, shortcut
from prismcat.plans.scratch import Scratch

ROOTS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(ts: str) -> Column:
    """Seconds since 1970 of a zoneless timestamp, whatever the session's zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))").cast("double")


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("asset_id"),
        F.when(F.col("o_orderstatus") == "F", "trashed").otherwise("active").alias("status"),
        F.when(F.col("o_orderkey") % 5 == 0, "video").otherwise("photo").alias("media_type"),
        F.floor("o_totalprice").cast("long").alias("asset_size"),
        (F.col("o_orderkey") % 97 == 0).cast("int").alias("undecodable"),
    )


ASSETS = """assets AS (
  SELECT o_orderkey AS asset_id, CASE WHEN o_orderstatus = 'F' THEN 'trashed' ELSE 'active' END AS status,
         CASE WHEN o_orderkey % 5 = 0 THEN 'video' ELSE 'photo' END AS media_type, floor(o_totalprice)::BIGINT AS asset_size,
         (o_orderkey % 97 = 0)::INT AS undecodable
  FROM orders)"""


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = (F.col("l_suppkey") % ROOTS).cast("int")
    name = F.concat_ws(
        "_", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"), F.date_format(F.col("l_shipdate").cast("date"), "yyyyMMdd")
    )
    path = F.concat(F.lit("/r"), root, F.lit("/"), name, F.lit(".jpg"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("asset_id"),
        root.alias("root_id"),
        path.alias("path"),
        leaf(path).alias("filename"),
        F.floor("l_extendedprice").cast("long").alias("size"),
        epoch("l_shipdate").alias("mtime"),
        "l_partkey",
    )


INST = """inst AS (
  SELECT *, regexp_extract(path, '([^/]*)$', 1) AS filename FROM (
    SELECT l_orderkey AS asset_id, (l_suppkey % 8)::INT AS root_id,
           '/r' || (l_suppkey % 8) || '/' || concat_ws('_', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::INT, strftime(l_shipdate, '%Y%m%d')) || '.jpg' AS path,
           floor(l_extendedprice)::BIGINT AS size, epoch(l_shipdate)::DOUBLE AS mtime, l_partkey
    FROM lineitem))"""


def photo_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets that have a photo signature."""
    return table(spark, sf_dir, "orders").where("o_custkey % 11 <> 0").select(F.col("o_orderkey").alias("asset_id"))


def video_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset_id, frame) of the frames that have a signature."""
    return table(spark, sf_dir, "lineitem").where("l_partkey % 3 = 0").select(F.col("l_orderkey").alias("asset_id"), F.col("l_linenumber").alias("frame"))


SIGNED = """phash AS (SELECT o_orderkey AS asset_id FROM orders WHERE o_custkey % 11 <> 0),
  vphash AS (SELECT l_orderkey AS asset_id, l_linenumber AS frame FROM lineitem WHERE l_partkey % 3 = 0)"""


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets with has_phash, has_vphash and complete."""
    flag = lambda df, name: df.select("asset_id").distinct().withColumn(name, F.lit(True))
    rows = assets(spark, sf_dir).join(flag(photo_signatures(spark, sf_dir), "has_phash"), "asset_id", "left").join(flag(video_signatures(spark, sf_dir), "has_vphash"), "asset_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_phash", "has_vphash")})
    return rows.withColumn("complete", complete(F.col("undecodable"), F.col("media_type"), F.col("has_phash"), F.col("has_vphash")))


FLAGGED = f"""{ASSETS}, {SIGNED}, flagged AS (
  SELECT *, undecodable = 1 OR CASE WHEN media_type = 'video' THEN has_vphash ELSE has_phash END AS complete FROM (
    SELECT *, EXISTS (SELECT 1 FROM phash p WHERE p.asset_id = a.asset_id) AS has_phash, EXISTS (SELECT 1 FROM vphash v WHERE v.asset_id = a.asset_id) AS has_vphash FROM assets a))"""


def existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances with their asset's status and whether it is fully fingerprinted; the path is the key (of equal ones the smallest size)."""
    a = flagged(spark, sf_dir).select("asset_id", "status", "complete")
    i = instances(spark, sf_dir)
    # the path tells all but the size
    same = [F.any_value(c).alias(c) for c in ("asset_id", "root_id", "mtime", "l_partkey")]
    rows = i.groupBy("path").agg(*same, F.min("size").alias("size"))
    return named(rows.join(a, "asset_id"))


def named(rows: DataFrame) -> DataFrame:
    """``rows`` with filename and fid, which follow from the path."""
    return rows.withColumn("filename", leaf(F.col("path"))).withColumn("fid", F.col("path"))


def written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``existing`` written once, for queries that read it several times."""
    return named(Scratch(spark, "existing").write(existing(spark, sf_dir).drop("filename", "fid"), "existing"))


EXISTING = f"""{FLAGGED}, {INST}, existing AS MATERIALIZED (
  SELECT i.*, status, path AS fid, complete
  FROM (SELECT asset_id, root_id, path, filename, mtime, l_partkey, min(size) AS size FROM inst GROUP BY ALL) i JOIN flagged a ON a.asset_id = i.asset_id)"""


def listing(existing: DataFrame) -> DataFrame:
    """What a later walk finds: some files gone, moved (their names in other letters), resized or touched."""
    k = F.col("l_partkey") % 50
    name = F.when(k == 1, F.regexp_replace("filename", "[.]jpg$", ".JPG")).otherwise(F.col("filename"))
    return existing.where(k != 0).select(
        "root_id",
        F.when(k == 1, F.concat(F.lit("/r"), F.col("root_id"), F.lit("/moved/"), name)).otherwise(F.col("path")).alias("path"),
        name.alias("filename"),
        F.when(k == 2, F.col("size") + 1).otherwise(F.col("size")).alias("size"),
        (F.col("mtime") + F.when(k == 3, 5.0).when(k == 4, 1.0).otherwise(0.0)).alias("mtime"),
    )


LISTING = f"""{EXISTING}, listing AS MATERIALIZED (
  SELECT root_id, CASE WHEN l_partkey % 50 = 1 THEN '/r' || root_id || '/moved/' || regexp_replace(filename, '[.]jpg$', '.JPG') ELSE path END AS path,
         CASE WHEN l_partkey % 50 = 1 THEN regexp_replace(filename, '[.]jpg$', '.JPG') ELSE filename END AS filename,
         CASE WHEN l_partkey % 50 = 2 THEN size + 1 ELSE size END AS size,
         mtime + CASE l_partkey % 50 WHEN 3 THEN 5.0 WHEN 4 THEN 1.0 ELSE 0.0 END AS mtime
  FROM existing WHERE l_partkey % 50 <> 0)"""


def roots(spark: SparkSession) -> DataFrame:
    k = F.col("root_id")
    return spark.range(ROOTS).select(F.col("id").cast("int").alias("root_id")).select(
        "root_id",
        F.concat(F.lit("Root"), k).alias("name"),
        F.concat(F.lit("/r"), k).alias("root_path"),
        F.when(k == 7, "trash").otherwise("library").alias("kind"),
        F.when(k == 2, 3).otherwise(0).alias("probe_new"),
        F.when(k != 4, F.lit("2024-01-01")).alias("last_scan"),
        (k == 1).cast("int").alias("needs_dedup"),
    )


ROOTS_SQL = """roots AS (
  SELECT k AS root_id, 'Root' || k AS name, '/r' || k AS root_path, CASE WHEN k = 7 THEN 'trash' ELSE 'library' END AS kind,
         CASE WHEN k = 2 THEN 3 ELSE 0 END AS probe_new, CASE WHEN k <> 4 THEN '2024-01-01' END AS last_scan, (k = 1)::INT AS needs_dedup
  FROM (SELECT unnest(range(8))::INT AS k))"""


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 sign bits in two lanes of 32."""
    lane = lambda lo: F.expr(f"aggregate(sequence(0, 31), 0L, (s, i) -> s + IF(embedding[i + {lo}] > 0, shiftleft(1L, i), 0L))")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", lane(0).alias("l0"), lane(32).alias("l1"))


_LANE = "list_sum(list_transform(range(0, 32), lambda i: CASE WHEN embedding[i + {} + 1] > 0 THEN (1::BIGINT << i) ELSE 0 END))::BIGINT"
SIGS = f"sig AS (SELECT vec_id AS id, label, {_LANE.format(0)} AS l0, {_LANE.format(32)} AS l1 FROM embeddings)"
EDGES = f"""{SIGS}, edge AS (
  SELECT a, b, distance FROM (
    SELECT x.id AS a, y.id AS b, (bit_count(xor(x.l0, y.l0)) + bit_count(xor(x.l1, y.l1)))::INT AS distance
    FROM sig x JOIN sig y ON x.id < y.id) WHERE distance <= 19)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of videos: bits from a digest of the text, quality from its length."""
    digest = F.md5(F.col("text").cast("binary"))
    lane = lambda lo: F.conv(F.substring(digest, lo, 8), 16, 10).cast("long")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("id"), F.col("turn").alias("frame"), lane(1).alias("l0"), lane(9).alias("l1"), (F.length("text") % 101).alias("quality"), F.length("text").alias("n")
    )


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).groupBy("id").agg((F.sum("n") / 10.0).alias("duration"))


FRAMES = """frame AS (
  SELECT conv_id AS id, turn AS frame, ('0x' || substr(md5(text), 1, 8))::BIGINT AS l0,
         ('0x' || substr(md5(text), 9, 8))::BIGINT AS l1, length(text) % 101 AS quality, length(text) AS n
  FROM conversations), video AS (SELECT id, sum(n) / 10.0 AS duration FROM frame GROUP BY id)"""


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files with a content hash."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"),
        F.concat(F.lit("/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id")).alias("path"),
        "source",
        F.col("n_chars").cast("double").alias("mtime"),
        (F.length("source") == 5).cast("int").alias("is_external"),
        "n_chars",
    )


CONTENTS = """content AS (
  SELECT doc_id, sha256(coalesce(text, '')) AS hash, '/' || coalesce(source, 'none') || '/' || doc_id AS path, source,
         n_chars::DOUBLE AS mtime, (length(source) = 5)::INT AS is_external, n_chars
  FROM documents)"""


def memory(spark: SparkSession, sf_dir: str, where: str) -> DataFrame:
    """Known hashes among the documents for which ``where`` holds: trashed if any copy is labelled toxic."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    known = contents(spark, sf_dir).where(where).join(labels, "doc_id", "left")
    status = F.when(F.max(F.coalesce("toxic", F.lit(0))) == 1, "trashed").otherwise("active")
    return known.groupBy("hash").agg(status.alias("status"), F.count(F.lit(1)).alias("instances"))


def memory_sql(where: str) -> str:
    return f"""{CONTENTS}, known AS (
  SELECT hash, CASE WHEN max(coalesce(toxic, 0)) = 1 THEN 'trashed' ELSE 'active' END AS status, count(*) AS instances
  FROM content c LEFT JOIN labels l ON l.doc_id = c.doc_id WHERE {where.replace("doc_id", "c.doc_id")} GROUP BY hash)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job queue and its history."""
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("error", "scan", "click", "dedup", "view", "cleanup", "signup", "probe", "purchase", "merge")]), F.col("event_type"))
    state = F.element_at(F.array(*[F.lit(x) for x in STATES]), (F.col("event_id") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        kind.alias("type"),
        (F.col("user_id") % 10).cast("int").alias("root_id"),
        state.alias("status"),
        F.col("ts").alias("enqueued_at"),
        (F.col("event_id") % 3).cast("int").alias("priority"),
        F.col("props").alias("result_json"),
        F.when(F.col("event_id") % 4 == 0, '{"confirm": true}').when(F.col("event_id") % 4 == 1, '{"dry_run": true}').when(F.col("event_id") % 4 == 2, '{"full": true}').alias("params_json"),
    )


STATES = ("queued", "running", "done", "error", "cancelled", "interrupted", "done")
JOBS = """jobs AS (
  SELECT event_id AS id, CASE event_type WHEN 'error' THEN 'scan' WHEN 'click' THEN 'dedup' WHEN 'view' THEN 'cleanup' WHEN 'signup' THEN 'probe' WHEN 'purchase' THEN 'merge' END AS type,
         (user_id % 10)::INT AS root_id,
         ['queued', 'running', 'done', 'error', 'cancelled', 'interrupted', 'done'][(event_id % 7 + 1)::INT] AS status,
         ts AS enqueued_at, (event_id % 3)::INT AS priority, props AS result_json,
         CASE event_id % 4 WHEN 0 THEN '{"confirm": true}' WHEN 1 THEN '{"dry_run": true}' WHEN 2 THEN '{"full": true}' END AS params_json
  FROM events)"""


# What decided a lead, by medium, and the reasons of an exact deletion.
PHOTO_LEVELS = ("resolution", "resolution + format", "resolution + format + size", "path")
REASONS = ("exact-internal", "exact-external", "exact-internal-preferred")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews: one a nation, with the thresholds as texts, some of them missing or unusable."""
    k = F.col("n_nationkey")
    pick = lambda n, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % n + 1).cast("int"))
    return table(spark, sf_dir, "nation").select(
        k.cast("int").alias("run_id"),
        (k % 8).cast("int").alias("root_id"),
        F.when(k % 5 == 4, "cleanup-perceptual").otherwise("dedup").alias("run_type"),
        pick(3, "pending", "completed", "cancelled").alias("status"),
        (F.floor(k / 3) % 3 + 1).cast("int").alias("stage"),
        F.when(k % 7 == 0, "applied").otherwise("staged").alias("phase"),
        pick(4, "7", "abc", None, "12").alias("t_rec"),
        pick(3, "30", None, "33").alias("t_edit"),
        pick(2, "90", None).alias("t_video"),
    )


RUNS = """runs AS (
  SELECT n_nationkey::INT AS run_id, (n_nationkey % 8)::INT AS root_id, CASE WHEN n_nationkey % 5 = 4 THEN 'cleanup-perceptual' ELSE 'dedup' END AS run_type,
         ['pending', 'completed', 'cancelled'][(n_nationkey % 3 + 1)::INT] AS status, (n_nationkey // 3 % 3 + 1)::INT AS stage, CASE WHEN n_nationkey % 7 = 0 THEN 'applied' ELSE 'staged' END AS phase,
         ['7', 'abc', NULL, '12'][(n_nationkey % 4 + 1)::INT] AS t_rec, ['30', NULL, '33'][(n_nationkey % 3 + 1)::INT] AS t_edit, ['90', NULL][(n_nationkey % 2 + 1)::INT] AS t_video
  FROM nation)"""


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned review actions: orders are groups, their lines members; some assets are gone, some files on a network share."""
    k, part = F.col("l_orderkey"), F.col("l_partkey")
    stage = (F.floor(k / 25) % 3 + 1).cast("int")
    exact = stage == 1
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (part % len(xs) + 1).cast("int"))
    name = F.concat_ws("_", k, "l_linenumber", part, "l_suppkey")
    lead = (stage == 2) & (F.col("l_linenumber") == 1)
    external = (part % 2).cast("int")
    return table(spark, sf_dir, "lineitem").select(
        (k % 25).cast("int").alias("run_id"),
        stage.alias("stage"),
        F.when(exact, "exact").otherwise("perceptual").alias("kind"),
        F.when(exact, pick(REASONS)).otherwise("perceptual").alias("reason"),
        F.when(exact, "delete").otherwise("keep").alias("default_action"),
        F.when(part % 13 == 0, -k).otherwise(k).alias("asset_id"),
        F.when(part % 5 == 0, F.concat(F.lit("\\\\nas\\"), name)).otherwise(F.concat(F.lit("/r/"), name)).alias("path"),
        F.when(~exact, k).alias("group_no"),
        F.when(~exact, F.col("l_linenumber")).alias("member_no"),
        external.alias("is_external"),
        lead.cast("int").alias("is_lead"),
        F.when(lead, pick(PHOTO_LEVELS)).alias("lead_reason"),
        F.when(~exact & (F.col("l_suppkey") % 17 != 0), (F.col("l_quantity").cast("int") * 3 + part) % 120).cast("int").alias("distance"),
        F.when(exact, shortcut(k * 10 + F.col("l_linenumber"), 3)).otherwise(group_shortcut(k, F.col("l_linenumber"), lead.cast("int"), external)).alias("shortcut_name"),
    )


ACTIONS = f"""actions AS (
  SELECT (k % 25)::INT AS run_id, stage, CASE WHEN stage = 1 THEN 'exact' ELSE 'perceptual' END AS kind,
         CASE WHEN stage = 1 THEN {list(REASONS)}[(l_partkey % 3 + 1)::INT] ELSE 'perceptual' END AS reason, CASE WHEN stage = 1 THEN 'delete' ELSE 'keep' END AS default_action,
         CASE WHEN l_partkey % 13 = 0 THEN -k ELSE k END AS asset_id,
         CASE WHEN l_partkey % 5 = 0 THEN repeat(chr(92), 2) || 'nas' || chr(92) ELSE '/r/' END || concat_ws('_', k, l_linenumber, l_partkey, l_suppkey) AS path,
         CASE WHEN stage > 1 THEN k END AS group_no, CASE WHEN stage > 1 THEN l_linenumber END AS member_no, (l_partkey % 2)::INT AS is_external, is_lead,
         CASE WHEN is_lead = 1 THEN {list(PHOTO_LEVELS)}[(l_partkey % 4 + 1)::INT] END AS lead_reason,
         CASE WHEN stage > 1 AND l_suppkey % 17 <> 0 THEN (l_quantity::INT * 3 + l_partkey) % 120 END::INT AS distance,
         CASE WHEN stage = 1 THEN printf('%03d.lnk', (k * 10 + l_linenumber)::BIGINT) ELSE printf('group%04d_%04d', k::BIGINT, l_linenumber::BIGINT) || CASE WHEN is_lead = 1 THEN '_suggested' ELSE '' END
           || CASE WHEN l_partkey % 2 = 1 THEN '_external' ELSE '' END || '.lnk' END AS shortcut_name
  FROM (SELECT *, (stage = 2 AND l_linenumber = 1)::INT AS is_lead FROM (SELECT *, l_orderkey AS k, (l_orderkey // 25 % 3 + 1)::INT AS stage FROM lineitem)))"""
