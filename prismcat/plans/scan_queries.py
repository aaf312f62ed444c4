"""Queries of what a scan writes, with their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismcat.operators import match, reconcile, scan
from prismcat.plans.registry import query
from prismcat.plans.scratch import Scratch
from prismcat.sources import catalog as C

# Files of a scan: every third document; some sit where another file was, some can't be read or decoded.  The other
# documents are what the catalog knew.
_BASE = f"""{C.CONTENTS}, toxic AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id),
  ka AS MATERIALIZED (SELECT hash, min(c.doc_id) AS asset_id, CASE WHEN max(coalesce(toxic, 0)) = 1 THEN 'trashed' ELSE 'active' END AS status, min(n_chars)::BIGINT AS size,
           (min(n_chars) % 29 = 0)::INT AS undecodable, min(n_chars) % 29 = 0 OR min(c.doc_id) % 5 <> 0 AS complete
         FROM content c LEFT JOIN toxic t ON t.doc_id = c.doc_id WHERE c.doc_id % 3 <> 0 GROUP BY hash),
  ki AS MATERIALIZED (SELECT (c.doc_id % 4)::INT AS root_id, '/lib/' || c.doc_id AS path, asset_id, n_chars::BIGINT AS size, mtime FROM content c JOIN ka ON ka.hash = c.hash WHERE c.doc_id % 3 <> 0),
  inc AS MATERIALIZED (SELECT doc_id, (d % 4)::INT AS root_id, '/lib/' || d AS path, hash, n_chars::BIGINT AS size, mtime, n_chars % 37 <> 0 AS readable, n_chars % 41 <> 0 AS decodable
          FROM (SELECT *, CASE WHEN doc_id % 7 = 0 THEN doc_id + 1 ELSE doc_id END AS d FROM content WHERE doc_id % 3 = 0)),
  r0 AS (SELECT i.*, k.asset_id, k.status, readable AND row_number() OVER (PARTITION BY i.hash, readable ORDER BY path) = 1 AS first_, k.undecodable, k.complete
         FROM inc i LEFT JOIN ka k ON k.hash = i.hash),
  r1 AS (SELECT *, first_ AND asset_id IS NULL AS creates, coalesce(first_ AND ((undecodable = 0 AND NOT complete) OR undecodable = 1), false) AS backfills FROM r0),
  res AS MATERIALIZED (SELECT *, CASE WHEN NOT readable THEN 'errors' WHEN (creates OR backfills) AND NOT decodable THEN 'undecodable' WHEN creates THEN 'new' WHEN status = 'trashed' THEN 'matches_trashed'
           WHEN backfills THEN 'backfilled' ELSE 'exact_dup' END AS outcome FROM r1),
  made AS MATERIALIZED (SELECT row_number() OVER (ORDER BY hash) + (SELECT max(asset_id) FROM ka) AS asset_id, hash, size, (NOT decodable)::INT AS undecodable FROM res WHERE creates),
  ids AS (SELECT hash, asset_id FROM ka UNION ALL SELECT hash, asset_id FROM made),
  att AS (SELECT root_id, path, ids.asset_id, size FROM res JOIN ids ON ids.hash = res.hash WHERE readable),
  after_ AS MATERIALIZED (SELECT * FROM att UNION ALL SELECT root_id, path, asset_id, size FROM ki WHERE NOT EXISTS (SELECT 1 FROM att a WHERE a.root_id = ki.root_id AND a.path = ki.path)),
  assets_after AS MATERIALIZED (SELECT k.asset_id, k.status, coalesce(b.size, k.size) AS size, coalesce((NOT b.decodable)::INT, k.undecodable) AS undecodable
      FROM ka k LEFT JOIN res b ON b.backfills AND b.asset_id = k.asset_id UNION ALL SELECT asset_id, 'active', size, undecodable FROM made)"""


def _known(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(assets, instances) before the scan."""
    toxic = C.table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = C.contents(spark, sf_dir).where("doc_id % 3 <> 0")
    least, size = F.min("doc_id"), F.min("n_chars")
    assets = rows.join(toxic, "doc_id", "left").groupBy("hash").agg(
        least.alias("asset_id"),
        F.when(F.max(F.coalesce("toxic", F.lit(0))) == 1, "trashed").otherwise("active").alias("status"),
        size.cast("long").alias("size"),
        (size % 29 == 0).cast("int").alias("undecodable"),
        ((size % 29 == 0) | (least % 5 != 0)).alias("complete"),
    )
    assets = Scratch(spark, "known").write(assets.select("asset_id", "hash", "status", "size", "undecodable", "complete"), "assets")
    here = rows.select((F.col("doc_id") % 4).cast("int").alias("root_id"), F.concat(F.lit("/lib/"), "doc_id").alias("path"), "hash", F.col("n_chars").cast("long").alias("size"), "mtime")
    return assets, here.join(assets.select("hash", "asset_id"), "hash").select("root_id", "path", "asset_id", "size", "mtime")


def _incoming(spark, sf_dir: str) -> DataFrame:
    d = F.when(F.col("doc_id") % 7 == 0, F.col("doc_id") + 1).otherwise(F.col("doc_id"))
    n = F.col("n_chars")
    return C.contents(spark, sf_dir).where("doc_id % 3 = 0").select(
        "doc_id", (d % 4).cast("int").alias("root_id"), F.concat(F.lit("/lib/"), d).alias("path"), "hash", n.cast("long").alias("size"), "mtime", (n % 37 != 0).alias("readable"), (n % 41 != 0).alias("decodable")
    )


def _resolved(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(resolved, assets, instances) of a full scan."""
    assets, instances = _known(spark, sf_dir)
    return Scratch(spark, "resolved").write(scan.resolve(_incoming(spark, sf_dir), assets, full=True), "resolved"), assets, instances


def _after(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(resolved, assets after, instances before, instances after)."""
    resolved, assets, instances = _resolved(spark, sf_dir)
    later = Scratch(spark, "after").write(scan.backfilled(assets, resolved).unionByName(scan.created(resolved, assets)), "assets")
    return resolved, later, instances, scan.attached(instances, resolved, later)


@query(f"WITH {_BASE} SELECT doc_id, outcome, creates, backfills FROM res")
def scan_ladder(spark, sf_dir: str) -> DataFrame:
    """The outcome of every file of a full scan."""
    return _resolved(spark, sf_dir)[0].select("doc_id", "outcome", "creates", "backfills")


@query(f"WITH {_BASE} SELECT asset_id, hash, size, undecodable FROM made")
def scan_new_assets(spark, sf_dir: str) -> DataFrame:
    """Assets that a scan inserts."""
    resolved, assets, _ = _resolved(spark, sf_dir)
    return scan.created(resolved, assets).select("asset_id", "hash", "size", "undecodable")


@query(f"WITH {_BASE} SELECT asset_id, status, size, undecodable FROM assets_after")
def scan_assets_after(spark, sf_dir: str) -> DataFrame:
    """The asset table after a scan: filled in, and with the new ones."""
    return _after(spark, sf_dir)[1].select("asset_id", "status", "size", "undecodable")


@query(f"WITH {_BASE} SELECT root_id, path, asset_id, size FROM after_")
def scan_instances_after(spark, sf_dir: str) -> DataFrame:
    """The instance table after a scan: attached, or bound anew where the bytes of a path changed."""
    return _after(spark, sf_dir)[3].select("root_id", "path", "asset_id", "size")


@query(f"WITH {_BASE} SELECT DISTINCT asset_id FROM ki WHERE asset_id NOT IN (SELECT asset_id FROM after_) AND asset_id IN (SELECT asset_id FROM assets_after WHERE status = 'active')")
def scan_forgotten(spark, sf_dir: str) -> DataFrame:
    """Active assets that lost their last file to an edit in place."""
    _, assets, before, after = _after(spark, sf_dir)
    return scan.forgotten(assets, before, after)


@query(f"WITH {_BASE} SELECT DISTINCT root_id FROM res WHERE decodable AND (creates OR (backfills AND status <> 'trashed'))")
def scan_dirty_roots(spark, sf_dir: str) -> DataFrame:
    """Roots with new content to look for duplicates of."""
    return scan.dirty_roots(_resolved(spark, sf_dir)[0])


_PROBLEMS = f"""{_BASE}, prob AS MATERIALIZED (SELECT DISTINCT root_id, path, 'undecodable' AS problem FROM after_ WHERE asset_id IN (SELECT asset_id FROM assets_after WHERE undecodable = 1)
  UNION ALL SELECT root_id, path, 'read-error' FROM res WHERE outcome = 'errors')"""


@query(f"""WITH {_PROBLEMS}, u AS (SELECT root_id, count(*) AS undecodable FROM prob WHERE problem = 'undecodable' GROUP BY root_id)
  SELECT res.root_id, count(*) AS candidates, {", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in scan.OUTCOMES if o != "undecodable")}, coalesce(max(undecodable_), 0) AS undecodable
  FROM res LEFT JOIN (SELECT root_id, undecodable AS undecodable_ FROM u) u ON u.root_id = res.root_id GROUP BY res.root_id""")
def scan_report(spark, sf_dir: str) -> DataFrame:
    """One row per root: this pass, and the undecodable files that the catalog holds now."""
    resolved, assets, _, after = _after(spark, sf_dir)
    return scan.report(resolved, assets, after)


@query(f"WITH {_PROBLEMS} SELECT root_id, path, problem, row_number() OVER (PARTITION BY root_id ORDER BY problem DESC, path) AS place FROM prob")
def problem_files(spark, sf_dir: str) -> DataFrame:
    """Problem files of each root in their order: undecodable first, then by path."""
    from pyspark.sql import Window

    resolved, assets, _, after = _after(spark, sf_dir)
    order = Window.partitionBy("root_id").orderBy(F.col("problem").desc(), "path")
    return scan.problem_files(resolved, assets, after).withColumn("place", F.row_number().over(order))


SCAN_LABELS = {"new": "new", "exact_dup": "exact-dup", "backfilled": "filled-in", "matches_trashed": "identified-trash", "undecodable": "undecodable", "errors": "errors"}
TRASH_LABELS = {"new_trashed": "new trash", "flipped": "flipped", "already_trashed": "already known"}


def _summary_sql(tally: str, key: str, labels: dict[str, str]) -> str:
    parts = ", ".join(f"CASE WHEN sum(n) FILTER (outcome = '{o}') > 0 THEN format('{{:,}}', sum(n) FILTER (outcome = '{o}')::BIGINT) || ' {label}' END" for o, label in labels.items())
    return f"SELECT {key}, coalesce(nullif(concat_ws(' · ', {parts}), ''), 'no changes') AS summary FROM ({tally}) GROUP BY {key}"


@query(f"WITH {_BASE} " + _summary_sql("SELECT root_id, outcome, count(*) AS n FROM res GROUP BY ALL", "root_id", SCAN_LABELS))
def scan_summary_lines(spark, sf_dir: str) -> DataFrame:
    """What happened in each root, as one line."""
    tally = _resolved(spark, sf_dir)[0].groupBy("root_id", "outcome").agg(F.count(F.lit(1)).alias("n"))
    return scan.summary(tally, "root_id", SCAN_LABELS)


@query(f"""WITH {C.memory_sql("doc_id % 7 <> 0")}, box AS (SELECT hash, source, row_number() OVER (PARTITION BY hash ORDER BY path) AS nth FROM content WHERE doc_id % 7 = 0),
  o AS (SELECT source, CASE WHEN nth > 1 OR status = 'trashed' THEN 'already_trashed' WHEN status IS NULL THEN 'new_trashed' ELSE 'flipped' END AS outcome FROM box b LEFT JOIN known k ON k.hash = b.hash)
  """ + _summary_sql("SELECT source, outcome, count(*) AS n FROM o GROUP BY ALL", "source", TRASH_LABELS))
def trash_summary_lines(spark, sf_dir: str) -> DataFrame:
    """What a refresh of the trash folders took in, as one line per source."""
    inbox = C.contents(spark, sf_dir).where("doc_id % 7 = 0").select("hash", F.col("path").alias("rel"), "source")
    found = reconcile.absorb(inbox, C.memory(spark, sf_dir, "doc_id % 7 <> 0"))
    return scan.summary(found.groupBy("source", "outcome").agg(F.count(F.lit(1)).alias("n")), "source", TRASH_LABELS)


_SIGNED = """old AS (SELECT DISTINCT l_orderkey AS asset_id, l_linenumber AS frame, 50 AS quality FROM lineitem),
  bad AS (SELECT DISTINCT l_orderkey AS asset_id FROM lineitem WHERE l_orderkey % 97 = 0),
  new AS (SELECT DISTINCT l_orderkey AS asset_id, (l_linenumber + 100) AS frame, 90 AS quality FROM lineitem WHERE l_partkey % 7 = 0)"""


@query(f"""WITH {_SIGNED} SELECT asset_id, frame, quality FROM old WHERE asset_id NOT IN (SELECT asset_id FROM new) AND asset_id NOT IN (SELECT asset_id FROM bad)
  UNION ALL SELECT asset_id, frame, quality FROM new WHERE asset_id NOT IN (SELECT asset_id FROM bad)""")
def signature_upsert(spark, sf_dir: str) -> DataFrame:
    """Signature rows after new ones took the place of their assets' old ones; undecodable assets have none."""
    line = C.table(spark, sf_dir, "lineitem")
    rows = lambda df, shift, q: df.select(F.col("l_orderkey").alias("asset_id"), (F.col("l_linenumber") + shift).alias("frame"), F.lit(q).alias("quality")).distinct()
    bad = line.where("l_orderkey % 97 = 0").select(F.col("l_orderkey").alias("asset_id")).distinct()
    return scan.signed(rows(line, 0, 50), rows(line.where("l_partkey % 7 = 0"), 100, 90), bad)


@query(f"""WITH {C.EDGES}, old AS (SELECT a, b, 'video' AS media_type, 99 AS distance, 'old' AS algo, '2024-01-01' AS created_at FROM edge WHERE (a + b) % 2 = 0),
  new AS (SELECT a, b, distance FROM edge WHERE a % 3 = 0)
  SELECT coalesce(o.a, n.a) AS a, coalesce(o.b, n.b) AS b, coalesce(media_type, 'photo') AS media_type, coalesce(n.distance, o.distance) AS distance, CASE WHEN n.a IS NULL THEN algo ELSE 'pdq' END AS algo,
    CASE WHEN n.a IS NULL THEN created_at ELSE '2024-06-01' END AS created_at FROM old o FULL JOIN new n ON n.a = o.a AND n.b = o.b""")
def edge_upsert(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate edges after another run: distance, method and time are new, the medium stays."""
    edges = match.photo_edges(C.signatures(spark, sf_dir), ["l0", "l1"], 19, bits=32)
    old = edges.where("(a + b) % 2 = 0").select("a", "b", F.lit("video").alias("media_type"), F.lit(99).alias("distance"), F.lit("old").alias("algo"), F.lit("2024-01-01").alias("created_at"))
    new = edges.where("a % 3 = 0").withColumn("media_type", F.lit("photo")).withColumn("algo", F.lit("pdq"))
    return scan.upserted_edges(old, new, F.lit("2024-06-01"))


@query(f"""WITH {C.LISTING}, absent AS (SELECT * FROM listing l WHERE NOT EXISTS (SELECT 1 FROM existing e WHERE e.root_id = l.root_id AND e.path = l.path)),
  one AS (SELECT root_id, lower(filename) AS name, size, min(path) AS path, min(mtime) AS mtime FROM absent GROUP BY ALL HAVING count(*) = 1),
  e1 AS (SELECT * FROM (SELECT *, lower(filename) AS name, count(*) OVER (PARTITION BY root_id, lower(filename), size) AS n FROM existing) WHERE n = 1),
  m AS MATERIALIZED (SELECT e.fid, a.path AS new_path FROM e1 e JOIN one a ON a.root_id = e.root_id AND a.name = e.name AND a.size = e.size WHERE e.status = 'active' AND e.complete AND abs(e.mtime - a.mtime) <= 2.0
     AND NOT EXISTS (SELECT 1 FROM listing l WHERE l.root_id = e.root_id AND lower(l.path) = lower(e.path)))
  SELECT e.fid, coalesce(new_path, path) AS path, coalesce(regexp_extract(new_path, '([^/]*)$', 1), filename) AS filename, CASE WHEN new_path IS NULL THEN 'before' ELSE 'now' END AS last_seen, size
  FROM existing e LEFT JOIN m ON m.fid = e.fid""")
def scan_relink(spark, sf_dir: str) -> DataFrame:
    """The instance table after its moved files were bound to their new places."""
    known = C.written(spark, sf_dir)
    moved = reconcile.moves(known, C.listing(known), fold=True)
    rows = known.select("fid", "path", "filename", F.lit("before").alias("last_seen"), "size")
    return scan.relinked(rows, moved, F.lit("now"))


_HOLDERS = "holders AS (SELECT root_id, what FROM (SELECT root_id, 'review ' || min(run_id) AS what FROM runs WHERE status = 'pending' GROUP BY root_id))"
_SWEEP = f"{C.ROOTS_SQL}, {C.RUNS}, {_HOLDERS}, sweep AS (SELECT *, (root_id <> 6)::INT AS enabled FROM roots)"


def _sweep(spark) -> DataFrame:
    return C.roots(spark).withColumn("enabled", (F.col("root_id") != 6).cast("int"))


@query(f"""WITH {_SWEEP} SELECT s.root_id, CASE WHEN kind = 'trash' OR what IS NOT NULL THEN 'skip' ELSE 'scan' END AS action, CASE WHEN kind = 'trash' THEN 'trash root' WHEN what IS NOT NULL THEN 'busy: ' || what END AS reason
  FROM sweep s LEFT JOIN holders h ON h.root_id = s.root_id WHERE enabled = 1""")
def scan_plan_roots(spark, sf_dir: str) -> DataFrame:
    """Which roots a scan of everything walks, and why others are left out."""
    held = C.runs(spark, sf_dir).where("status = 'pending'").groupBy("root_id").agg(F.concat(F.lit("review "), F.min("run_id")).alias("what"))
    return scan.plan_roots(_sweep(spark), held)


@query(f"WITH {_SWEEP} SELECT root_id, row_number() OVER (ORDER BY root_id) AS place FROM sweep WHERE enabled = 1 AND kind = 'library'")
def library_roots(spark, sf_dir: str) -> DataFrame:
    """Enabled library roots in their order: what a probe of everything visits."""
    from pyspark.sql import Window

    return _sweep(spark).where("enabled = 1 AND kind = 'library'").select("root_id", F.row_number().over(Window.orderBy("root_id")).alias("place"))


@query(f"WITH {C.FLAGGED} SELECT asset_id, has_phash, has_vphash, complete FROM flagged")
def asset_completeness(spark, sf_dir: str) -> DataFrame:
    """Whether an asset's signatures are there, and whether that is all it can have."""
    return C.flagged(spark, sf_dir).select("asset_id", "has_phash", "has_vphash", "complete")


@query(f"WITH {C.ASSETS}, {C.INST} SELECT asset_id, status FROM assets WHERE asset_id IN (SELECT DISTINCT asset_id FROM inst WHERE root_id = 3)")
def assets_in_root(spark, sf_dir: str) -> DataFrame:
    """Assets with a file in a root."""
    here = C.instances(spark, sf_dir).where("root_id = 3").select("asset_id")
    return C.assets(spark, sf_dir).join(here, "asset_id", "left_semi").select("asset_id", "status")
