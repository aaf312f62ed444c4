"""Queries of names, times and texts, with their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismcat.functions import exprs as X
from prismcat.plans.jobs import anchored_page, pages
from prismcat.plans.registry import query
from prismcat.sources import catalog as C
from prismcat.sources import sinks


@query("SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS stamp FROM events")
def utc_stamp(spark, sf_dir: str) -> DataFrame:
    """Times as ISO 8601 in UTC."""
    return C.table(spark, sf_dir, "events").select("event_id", X.utc_stamp(F.col("ts")).alias("stamp"))


@query("""SELECT event_id, CASE WHEN s IS NULL THEN '' WHEN s < 60 THEN 'ETA ' || s || 's' WHEN s < 3600 THEN 'ETA ' || s // 60 || 'm' ELSE printf('ETA %dh%02dm', s // 3600, s // 60 % 60) END AS eta
  FROM (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN (event_id * 37 % 20000)::BIGINT END AS s FROM events)""")
def eta_text(spark, sf_dir: str) -> DataFrame:
    """Remaining times as short texts."""
    s = F.when(F.col("event_id") % 5 != 0, F.col("event_id") * 37 % 20000)
    return C.table(spark, sf_dir, "events").select("event_id", X.fmt_eta(s).alias("eta"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN n > 0 AND d > 0 THEN printf('%.2f Mb/s', n * 8.0::DOUBLE / d / 1000000.0) ELSE '' END AS bitrate
  FROM (SELECT *, CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE (l_partkey * 4096)::BIGINT END AS n, CASE l_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 0.0 ELSE (l_suppkey % 4 * 16)::DOUBLE END AS d FROM lineitem)""")
def bitrate_text(spark, sf_dir: str) -> DataFrame:
    """Bit rates as texts, empty where size or duration are unknown."""
    size = F.when(F.col("l_partkey") % 9 != 0, F.col("l_partkey") * 4096)
    seconds = F.when(F.col("l_suppkey") % 4 == 0, F.lit(None)).when(F.col("l_suppkey") % 4 == 1, 0.0).otherwise((F.col("l_suppkey") % 4 * 16).cast("double"))
    return C.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", X.bitrate(size, seconds).alias("bitrate"))


@query("""WITH n AS (SELECT l_suppkey AS id, count(*) AS n FROM lineitem GROUP BY l_suppkey)
  SELECT id, greatest(1, (n + 9) // 10) AS pages, least(id // 10, greatest(1, (n + 9) // 10) - 1) AS page FROM n""")
def page_counts(spark, sf_dir: str) -> DataFrame:
    """Pages of ten rows, and the page that shows a place or the last one left."""
    n = C.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("id", pages(F.col("n"), 10).alias("pages"), anchored_page(F.col("id"), 10, F.col("n")).alias("page"))


_NAMES = "names AS (SELECT doc_id, coalesce(substr(text, 1, 40), '') || CASE doc_id % 3 WHEN 0 THEN '照片' WHEN 1 THEN 'ＡＢ' ELSE '' END AS name FROM documents)"


def _names(spark, sf_dir: str) -> DataFrame:
    """The first forty letters of a text are a folder's name here; some have wide characters."""
    k = F.col("doc_id") % 3
    name = F.concat(F.coalesce(F.substring("text", 1, 40), F.lit("")), F.when(k == 0, "照片").when(k == 1, "ＡＢ").otherwise(""))
    return C.table(spark, sf_dir, "documents").select("doc_id", name.alias("name"))


@query(f"WITH {_NAMES} SELECT doc_id, (length(name) + CASE WHEN doc_id % 3 < 2 THEN 2 ELSE 0 END)::INT AS width FROM names")
def cell_widths(spark, sf_dir: str) -> DataFrame:
    """Cells that a name takes on a terminal."""
    return _names(spark, sf_dir).select("doc_id", X.cell_width(F.col("name")).alias("width"))


@query(f"""WITH {_NAMES}, t AS (SELECT *, length(name) + CASE WHEN doc_id % 3 < 2 THEN 2 ELSE 0 END AS w, doc_id % 3 < 2 AS wide FROM names)
  SELECT doc_id, CASE WHEN w <= 24 THEN name ELSE substr(name, 1, 12) || '…' || CASE WHEN wide THEN right(name, 9) ELSE right(name, 11) END END AS middle,
    CASE WHEN w <= 24 THEN name ELSE substr(name, 1, CASE WHEN wide AND length(name) < 25 THEN 22 ELSE 23 END) || '…' END AS cut FROM t""")
def elided_names(spark, sf_dir: str) -> DataFrame:
    """Names in 24 cells, shortened in the middle or at the end."""
    return _names(spark, sf_dir).select("doc_id", X.middle_elide(F.col("name"), 24).alias("middle"), X.end_elide(F.col("name"), 24).alias("cut"))


@query(f"WITH {_NAMES} SELECT doc_id, regexp_replace(regexp_replace(name, 'the', '░░░', 'gi'), '照片', '░░░░', 'g') AS masked FROM names")
def masked_names(spark, sf_dir: str) -> DataFrame:
    """Names with given words covered, as wide as before."""
    return _names(spark, sf_dir).select("doc_id", X.masked(F.col("name"), ["the", "照片"]).alias("masked"))


@query("""SELECT o_orderkey AS id, coalesce(CASE WHEN s > 0 THEN s * 0.5 END, CASE WHEN c > 0 THEN c / 1000.0 END, CASE WHEN d > 0 THEN d END) AS duration
  FROM (SELECT o_orderkey, nullif(o_orderkey % 4, 0)::DOUBLE AS s, nullif(o_custkey % 3, 0)::DOUBLE * 1000 AS c, (o_orderkey % 5 - 1)::DOUBLE AS d FROM orders)""")
def duration_ladder(spark, sf_dir: str) -> DataFrame:
    """A video's duration from its stream, else its container, else its packets; a zero counts as unknown."""
    from prismcat.sources.probe import duration

    k = F.col("o_orderkey")
    d = duration((k % 4).cast("double"), F.lit(0.5), (F.col("o_custkey") % 3).cast("double") * 1000, F.lit(1000.0), (k % 5 - 1).cast("double"))
    return C.table(spark, sf_dir, "orders").select(k.alias("id"), d.alias("duration"))


@query("""SELECT o_orderkey AS id, CASE WHEN length(t) >= 10 THEN substr(t, 1, 19) END AS captured_at FROM (
  SELECT o_orderkey, replace(rtrim(CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T08:30:00.000000Z' WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m') END, 'Z'), 'T', ' ') AS t FROM orders)""")
def container_time(spark, sf_dir: str) -> DataFrame:
    """A container's creation time without zone, null if it is too short to be a date."""
    from prismcat.sources.probe import container_stamp

    day = F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd")
    k = F.col("o_orderkey") % 3
    raw = F.when(k == 0, F.concat(day, F.lit("T08:30:00.000000Z"))).when(k == 1, day).otherwise(F.substring(day, 1, 7))
    return C.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), container_stamp(raw).alias("captured_at"))


@query(f"""WITH {C.FRAMES}, t AS (SELECT id, duration, k, duration * (k + 0.5) / 4 AS target FROM video, (SELECT unnest(range(4))::INT AS k)),
  p AS (SELECT id, frame, (sum(n) OVER (PARTITION BY id ORDER BY frame)) / 10.0 AS pts, n % 7 <> 0 AS ok, frame % 3 = 0 AS key_ FROM frame),
  s AS (SELECT t.id, k, target, max(pts) AS seek FROM t JOIN p ON p.id = t.id AND key_ AND pts <= target GROUP BY ALL),
  h AS (SELECT t.id, t.k, (min(struct_pack(p := pts, f := frame, o := ok))) AS m FROM t LEFT JOIN s ON s.id = t.id AND s.k = t.k JOIN p ON p.id = t.id AND pts >= t.target AND pts >= coalesce(seek, 0) GROUP BY ALL)
  SELECT id, k, m.f AS frame FROM h WHERE m.o""")
def frame_seek(spark, sf_dir: str) -> DataFrame:
    """Frames by seeking: from the last key frame at or before each midpoint to the first frame at or after it; what can't be decoded is left out."""
    from pyspark.sql import Window

    from prismcat.sources.probe import midpoints, seek_frames

    f = C.frames(spark, sf_dir)
    pts = f.select(
        "id", "frame", (F.sum("n").over(Window.partitionBy("id").orderBy("frame")) / 10.0).alias("pts"), (F.col("n") % 7 != 0).alias("ok"), (F.col("frame") % 3 == 0).alias("key")
    )
    return seek_frames(midpoints(C.videos(spark, sf_dir), 4), pts).select("id", "k", "frame")


@query(r"""SELECT page_id, '/' || list_aggregate(list_filter(['r', CASE WHEN page_id % 4 = 0 THEN 'b' END, 'c' || page_id], lambda x: x IS NOT NULL), 'string_agg', '/') AS path,
  page_id % 3 = 0 AS network FROM pages""")
def canonical_paths(spark, sf_dir: str) -> DataFrame:
    """Paths without empty parts and dots, and whether a path is on a network share."""
    k = F.col("page_id")
    raw = F.concat(F.lit("//r/./"), F.when(k % 4 == 0, "b/").otherwise("b/../"), F.lit("c"), k, F.when(k % 2 == 0, "/").otherwise("/."))
    share = F.when(k % 3 == 0, F.when(k % 2 == 0, "\\\\nas\\x").otherwise("\\\\?\\UNC\\nas\\x")).when(k % 3 == 1, "\\\\?\\C:\\x").otherwise("/r/x")
    return C.table(spark, sf_dir, "pages").select("page_id", X.canonical(raw).alias("path"), X.is_network(share).alias("network"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'a_b c.d-' || page_id ELSE 'x_y_' || page_id END AS name FROM pages")
def safe_names(spark, sf_dir: str) -> DataFrame:
    """Names that may stand in a path."""
    k = F.col("page_id")
    return C.table(spark, sf_dir, "pages").select("page_id", sinks.safe_name(F.concat(F.when(k % 2 == 0, "a:b c.d-").otherwise("x/y*"), k)).alias("name"))


@query(f"""WITH {C.ACTIONS}, {C.ASSETS} SELECT shortcut_name AS shortcut, path AS target_path, x.asset_id::VARCHAR AS asset_id, group_no::VARCHAR AS group_no, member_no::VARCHAR AS member_no, is_lead::VARCHAR AS suggested_lead,
    coalesce(lead_reason, '') AS suggested_reason, coalesce(media_type, '') AS media_type, '' AS width, '' AS height, coalesce(asset_size::VARCHAR, '') AS size, '' AS duration_s, '' AS codec, '' AS bitrate,
    is_external::VARCHAR AS is_external, coalesce(distance::VARCHAR, '') AS distance, '' AS quality, '0' AS low_confidence
  FROM actions x LEFT JOIN assets a ON a.asset_id = x.asset_id WHERE stage = 2 AND kind = 'perceptual'""")
def group_manifest(spark, sf_dir: str) -> DataFrame:
    """The manifest of the group stages, all eighteen columns."""
    unknown = {c: F.lit(None).cast("double") for c in ("width", "height", "duration_s", "quality")}
    a = C.assets(spark, sf_dir).select("asset_id", "media_type", F.col("asset_size").alias("size"))
    rows = C.actions(spark, sf_dir).where("stage = 2 AND kind = 'perceptual'").join(a, "asset_id", "left").withColumns(unknown).withColumn("codec", F.lit("").cast("string")).withColumn("low_confidence", F.lit(0))
    return sinks.group_manifest(rows)


@query(f"WITH {C.EDGES} SELECT DISTINCT id FROM (SELECT a AS id FROM edge WHERE distance <= 17 UNION SELECT b FROM edge WHERE distance > 17)")
def touched_ids(spark, sf_dir: str) -> DataFrame:
    """The union of target and matched ids, each once."""
    from prismcat.operators import match

    edges = match.photo_edges(C.signatures(spark, sf_dir), ["l0", "l1"], 19, bits=32)
    return edges.where("distance <= 17").select(F.col("a").alias("id")).union(edges.where("distance > 17").select("b")).distinct()
