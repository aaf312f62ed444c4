"""Queries of the job queue and of what a status shows, with their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismcat.functions import exprs as X
from prismcat.operators import store
from prismcat.plans import jobs as J
from prismcat.plans.catalog_queries import _SNAP, _snapshot, root_holder
from prismcat.plans.registry import ORACLE_SQL, query
from prismcat.plans.scratch import Scratch
from prismcat.sources import catalog as C


@query(f"""WITH {C.JOBS}, t AS (SELECT max(priority) + 1 AS p, min(id) AS j FROM jobs WHERE status = 'queued')
  SELECT id, (CASE WHEN id = j THEN p ELSE priority END)::INT AS priority FROM jobs, t WHERE status = 'queued'""")
def queue_prioritized(spark, sf_dir: str) -> DataFrame:
    """Waiting jobs after the oldest was put before all others."""
    jobs = C.jobs(spark, sf_dir).where("status = 'queued'")
    oldest = jobs.agg(F.min("id")).first()[0]
    return J.prioritized(jobs, oldest).select("id", F.col("priority").cast("int").alias("priority"))


@query(f"""WITH {C.JOBS}, old AS (SELECT * FROM jobs WHERE id % 2 = 0), new AS (SELECT * FROM jobs WHERE id % 2 = 1),
  ok AS (SELECT id FROM new WHERE type <> 'probe' UNION ALL SELECT min(id) FROM new WHERE type = 'probe' AND root_id NOT IN (SELECT root_id FROM old WHERE type = 'probe' AND status = 'queued') GROUP BY root_id)
  SELECT id FROM old UNION ALL SELECT id FROM ok WHERE id IS NOT NULL""")
def job_submission(spark, sf_dir: str) -> DataFrame:
    """The queue after a submission: a probe of a root that has one waiting or coming is not taken twice."""
    jobs = C.jobs(spark, sf_dir)
    return J.submit(jobs.where("id % 2 = 0"), jobs.where("id % 2 = 1"), {"scan", "dedup", "cleanup", "probe", "merge"}).select("id")


@query(f"WITH {C.JOBS} SELECT id, CASE WHEN status = 'queued' THEN 'cancelled' WHEN status = 'running' THEN 'interrupted' ELSE status END AS status FROM jobs")
def queue_closed(spark, sf_dir: str) -> DataFrame:
    """All jobs after what waits was cancelled and the engine stopped."""
    return J.shut_down(J.cancel_queued(C.jobs(spark, sf_dir))).select("id", "status")


@query(f"""WITH {C.JOBS}, {C.RUNS} SELECT run_id FROM runs WHERE NOT (status = 'pending' AND stage = 1 AND phase <> 'applied' AND root_id IN (
  SELECT root_id FROM jobs WHERE type = 'dedup' AND status = 'running' AND NOT coalesce(json_extract_string(params_json, '$.confirm') = 'true', false) AND NOT coalesce(json_extract_string(params_json, '$.cancel') = 'true', false)
    AND NOT coalesce(json_extract_string(params_json, '$.dry_run') = 'true', false)))""")
def runs_rolled_back(spark, sf_dir: str) -> DataFrame:
    """Reviews that are left after a start: first analyses that were interrupted go."""
    return J.rolled_back(C.runs(spark, sf_dir), C.jobs(spark, sf_dir)).select("run_id")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN 0 ELSE 1 END AS n, CASE event_id % 4 WHEN 0 THEN '*.tmp' WHEN 3 THEN 'x/' END AS first FROM events""")
def json_globs(spark, sf_dir: str) -> DataFrame:
    """Ignore globs kept as JSON; what is no list of texts counts as empty."""
    k = F.col("event_id") % 4
    raw = F.when(k == 0, '["*.tmp", "cache/"]').when(k == 1, "oops").when(k == 3, '["x/"]')
    globs = F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>"))
    return C.table(spark, sf_dir, "events").select("event_id", F.size(globs).alias("n"), F.get(globs, F.lit(0)).alias("first"))


@query(f"""WITH {_SNAP}, h AS ({ORACLE_SQL["root_holder"]}), b AS (SELECT root_id, name, kind, assets, files FROM snap)
  SELECT b.root_id, name, assets, files, CASE WHEN kind = 'trash' THEN '' WHEN b.root_id = 2 THEN 'new' WHEN b.root_id = 4 THEN 'never' WHEN b.root_id = 1 THEN 'dirty' WHEN b.root_id % 3 = 0 THEN 'deduped' ELSE 'scanned' END AS dot, holder, holder IS NOT NULL AS blocked
  FROM b LEFT JOIN h ON h.root_id = b.root_id""")
def status_snapshot(spark, sf_dir: str) -> DataFrame:
    """Every root with its contents, its dot, and what holds it."""
    dot = X.status_dot(F.col("kind"), F.col("probe_new"), F.col("last_scan"), F.col("needs_dedup"), F.col("root_id") % 3 == 0)
    roots = C.roots(spark).select("root_id", dot.alias("dot"))
    held = root_holder(spark, sf_dir).select("root_id", "holder")
    rows = _snapshot(spark, sf_dir).select("root_id", "name", "assets", "files").join(roots, "root_id").join(held, "root_id", "left")
    return rows.withColumn("blocked", F.col("holder").isNotNull())


@query(f"""WITH {C.EXISTING}, after_ AS (SELECT path, CASE WHEN l_partkey % 10 = 0 THEN asset_id + 1 ELSE asset_id END AS asset_id FROM existing),
  kept AS (SELECT asset_id, status FROM assets WHERE status = 'trashed' OR asset_id IN (SELECT asset_id FROM after_)),
  sig AS (SELECT asset_id FROM phash WHERE asset_id IN (SELECT asset_id FROM kept))
  SELECT 'assets ' || status AS what, count(*) AS n FROM kept GROUP BY status UNION ALL SELECT 'instances', count(*) FROM after_ UNION ALL SELECT 'phash', count(*) FROM sig UNION ALL SELECT 'version', 2""")
def snapshot_upsert_cascade(spark, sf_dir: str) -> DataFrame:
    """A store after files were bound to other assets: active assets without a file go, and their signatures with them."""
    scratch = Scratch(spark, "snapshot")
    library = store.Store(spark, f"{scratch.base}/store")
    old = C.existing(spark, sf_dir).select("path", "asset_id", "l_partkey")
    library.commit({"assets": C.assets(spark, sf_dir).select("asset_id", "status"), "instances": old, "phash": C.photo_signatures(spark, sf_dir)})
    scratch.until_exit()
    old = library.read("instances")
    new = old.where("l_partkey % 10 = 0").withColumn("asset_id", F.col("asset_id") + 1)
    after = old.join(new.select("path"), "path", "left_anti").unionByName(new)
    assets, left = store.forget(library.read("assets"), after, {"phash": (library.read("phash"), "asset_id")})
    version = library.commit({"instances": after, "assets": assets, **left})
    count = lambda name, key: library.read(name).groupBy(key.alias("what")).agg(F.count(F.lit(1)).alias("n"))
    rows = count("assets", F.concat(F.lit("assets "), "status")).unionByName(count("instances", F.lit("instances"))).unionByName(count("phash", F.lit("phash")))
    return rows.unionByName(spark.range(1).select(F.lit("version").alias("what"), F.lit(version).cast("long").alias("n")))
