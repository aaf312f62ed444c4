"""The catalog queries by name, with their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismcat.functions import exprs as X
from prismcat.operators import match, rank, reconcile, review
from prismcat.operators.cluster import connected_components
from prismcat.plans import jobs as J
from prismcat.plans.registry import ORACLE_SQL, QUERIES, query
from prismcat.plans.scratch import Scratch, numbered
from prismcat.sources import catalog as C
from prismcat.sources.catalog import table

# --- near-duplicate photos -------------------------------------------------------------------------------------------

LANES = ["l0", "l1"]
RECOMPRESS, EDIT = 17, 19
#: Queries of a search that go together.
QUERY_BLOCK = 1024


def _edges(spark, sf_dir: str) -> DataFrame:
    return match.photo_edges(C.signatures(spark, sf_dir), LANES, EDIT, bits=32)


def _links(spark, sf_dir: str) -> DataFrame:
    """Links with the components of the edges; copies are not paired with all their neighbours."""
    return match.photo_links(C.signatures(spark, sf_dir), LANES, EDIT, bits=32)


@query(f"WITH {C.EDGES} SELECT a, b, distance, CASE WHEN distance <= 17 THEN 2 ELSE 3 END AS stage FROM edge")
def near_dup_edges(spark, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).withColumn("stage", F.when(F.col("distance") <= RECOMPRESS, 2).otherwise(3))


_BANDED = C.EDGES.replace("distance <= 19", "distance <= 15")


@query(f"WITH {_BANDED} SELECT a, b, distance FROM edge")
def near_dup_edges_banded(spark, sf_dir: str) -> DataFrame:
    return match.photo_edges(C.signatures(spark, sf_dir), LANES, 15, bits=32, width=16)


@query(f"""WITH {C.EDGES} SELECT id, min(distance) AS distance, count(*) AS neighbours FROM (
  SELECT a AS id, distance FROM edge UNION ALL SELECT b, distance FROM edge) GROUP BY id""")
def near_dup_nearest(spark, sf_dir: str) -> DataFrame:
    return match.nearest(_edges(spark, sf_dir))


_REACH = f"""{C.EDGES}, both_ AS (SELECT a, b FROM edge UNION ALL SELECT b, a FROM edge),
  reach(n, m) AS (SELECT a, b FROM both_ UNION SELECT r.n, x.b FROM reach r JOIN both_ x ON r.m = x.a),
  comp AS (SELECT n AS id, least(n, min(m)) AS component FROM reach GROUP BY n)"""
_GROUPS = f"""{_REACH}, grp AS (
  SELECT dense_rank() OVER (ORDER BY component) AS group_no, row_number() OVER (PARTITION BY component ORDER BY id) AS member_no, id FROM comp)"""


@query(f"WITH RECURSIVE {_REACH} SELECT id, component FROM comp")
def near_dup_components(spark, sf_dir: str) -> DataFrame:
    return connected_components(_links(spark, sf_dir)).select(F.col("node").alias("id"), "component")


FORMATS = ("png", "heic", "jpg", "cr2")


def _members(spark, sf_dir: str) -> DataFrame:
    """Group members with the fields that rank photos: pixels, format rank of the path, size.

    The catalog's tables take part whole and their files tell little of their size, so they are never broadcast.
    """
    sig = C.signatures(spark, sf_dir).select("id", (F.col("label") % 2).alias("is_external"))
    ext = F.element_at(F.array(*[F.lit(x) for x in FORMATS]), (F.col("id") % 4 + 1).cast("int"))
    path = F.concat(F.lit("/p/"), F.lpad(F.col("id").cast("string"), 8, "0"), F.lit("."), ext)
    pixels = F.coalesce(F.col("p_size") % 4, F.lit(0)) * F.when(F.col("p_partkey") % 9 != 0, F.lit(3)).otherwise(0)
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), pixels.cast("long").alias("pixels"), (F.floor("p_retailprice") % 5).cast("long").alias("size"))
    rows = match.groups(_links(spark, sf_dir)).join(sig.hint("merge"), "id").join(part.hint("merge"), "id").withColumn("path", path)
    return rows.withColumn("format", X.format_rank(F.col("path")))


KEYS, LABELS = ["pixels", "format", "size"], ["resolution", "format", "size"]
_MEMBERS = f"""{_GROUPS}, member AS (
  SELECT g.*, label % 2 AS is_external, (p_size % 4 * CASE WHEN p_partkey % 9 <> 0 THEN 3 ELSE 0 END)::BIGINT AS pixels, [2, 1, 0, 2][(g.id % 4 + 1)::INT] AS format,
         (floor(p_retailprice) % 5)::BIGINT AS size, '/p/' || lpad(g.id::VARCHAR, 8, '0') || '.' || ['png', 'heic', 'jpg', 'cr2'][(g.id % 4 + 1)::INT] AS path
  FROM grp g JOIN sig ON sig.id = g.id JOIN part ON p_partkey = g.id),
  led AS (SELECT *, (row_number() OVER (PARTITION BY group_no ORDER BY pixels DESC, format DESC, size DESC, is_external DESC, path) = 1)::INT AS is_lead,
         count(*) OVER (PARTITION BY group_no, pixels) AS n1, count(*) OVER (PARTITION BY group_no, pixels, format) AS n2, count(*) OVER k AS n3,
         min(is_external) OVER k <> max(is_external) OVER k AS split_ FROM member WINDOW k AS (PARTITION BY group_no, pixels, format, size))"""


@query(f"""WITH RECURSIVE {_MEMBERS} SELECT group_no, member_no, id, printf('group%04d_%04d', group_no, member_no) || CASE WHEN is_lead = 1 THEN '_suggested' ELSE '' END
  || CASE WHEN is_external = 1 THEN '_external' ELSE '' END || '.lnk' AS shortcut FROM led""")
def near_dup_groups_numbered(spark, sf_dir: str) -> DataFrame:
    led = rank.leads(_members(spark, sf_dir), KEYS, "is_external")
    name = X.group_shortcut(F.col("group_no"), F.col("member_no"), F.col("is_lead"), F.col("is_external"))
    return led.select("group_no", "member_no", "id", name.alias("shortcut"))


@query(f"WITH RECURSIVE {_MEMBERS} SELECT group_no, id, is_lead FROM led")
def keep_lead_photo(spark, sf_dir: str) -> DataFrame:
    return rank.leads(_members(spark, sf_dir), KEYS, "is_external").select("group_no", "id", "is_lead")


@query(f"""WITH RECURSIVE {_MEMBERS} SELECT group_no, id, CASE WHEN n1 = 1 THEN 'resolution' WHEN n2 = 1 THEN 'resolution + format' WHEN n3 = 1 THEN 'resolution + format + size'
  WHEN split_ THEN 'preference' ELSE 'path' END AS level FROM led WHERE is_lead = 1""")
def keep_lead_level(spark, sf_dir: str) -> DataFrame:
    return rank.levels(_members(spark, sf_dir), KEYS, LABELS, "is_external").select("group_no", "id", "level")


@query(f"WITH RECURSIVE {_MEMBERS} SELECT group_no, id, path FROM led WHERE is_lead = 0")
def keep_suggested_deletes(spark, sf_dir: str) -> DataFrame:
    return rank.keep_suggested(rank.leads(_members(spark, sf_dir), KEYS, "is_external")).select("group_no", "id", "path")


@query(f"""WITH RECURSIVE {_MEMBERS}, g AS (
    SELECT group_no, count(*) AS n, max(is_external) AS ext, max(1 - is_external) AS int_, max(CASE WHEN is_lead = 1 THEN is_external END) AS lead_ext FROM led GROUP BY group_no)
  SELECT count(*) AS n_groups, sum(n)::BIGINT AS n_members, count(*) FILTER (ext = 0) AS internal_only, count(*) FILTER (ext = 1 AND int_ = 1) AS mixed,
         count(*) FILTER (lead_ext = 1) AS external_leads, sum(n - 1)::BIGINT AS suggested FROM g""")
def review_bundle(spark, sf_dir: str) -> DataFrame:
    led = rank.leads(_members(spark, sf_dir), KEYS, "is_external")
    per = led.groupBy("group_no").agg(
        F.count(F.lit(1)).alias("n"), F.max("is_external").alias("ext"), F.max(1 - F.col("is_external")).alias("int"), F.max(F.when(F.col("is_lead") == 1, F.col("is_external"))).alias("lead_ext")
    )
    return per.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.sum("n").alias("n_members"),
        F.count_if(F.col("ext") == 0).alias("internal_only"),
        F.count_if((F.col("ext") == 1) & (F.col("int") == 1)).alias("mixed"),
        F.count_if(F.col("lead_ext") == 1).alias("external_leads"),
        F.sum(F.col("n") - 1).alias("suggested"),
    )


def _histogram(spark, values: DataFrame, bins: list[tuple[int, int]]) -> DataFrame:
    """Count of ``distance`` by bin; empty bins stay, values outside all bins go."""
    table_ = spark.createDataFrame([(i, lo, hi) for i, (lo, hi) in enumerate(bins)], "bin int, lo int, hi int")
    which = F.when(F.lit(False), F.lit(-1))
    for i, (lo, hi) in enumerate(bins):
        which = which.when(F.col("distance").between(lo, hi), i)
    counts = values.groupBy(which.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return table_.join(counts, "bin", "left").select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))


PHOTO_BINS, VIDEO_BINS = [(0, 14), (15, 16), (17, 17), (18, 19)], [(0, 9), (10, 19), (20, 30), (31, 1_000_000)]


def _bins_sql(bins) -> str:
    return "bins AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {lo}, {hi})" for i, (lo, hi) in enumerate(bins)) + ") v(bin, lo, hi))"


@query(f"""WITH {C.EDGES}, near_ AS (SELECT id, min(distance) AS distance FROM (SELECT a AS id, distance FROM edge UNION ALL SELECT b, distance FROM edge) GROUP BY id), {_bins_sql(PHOTO_BINS)}
  SELECT bin, lo, hi, count(id) AS n FROM bins LEFT JOIN near_ ON distance BETWEEN lo AND hi GROUP BY ALL""")
def review_histogram_photo(spark, sf_dir: str) -> DataFrame:
    return _histogram(spark, match.nearest(_edges(spark, sf_dir)), PHOTO_BINS)


@query(f"""WITH {C.SIGS}, t AS (SELECT * FROM sig WHERE label % 2 = 0), p AS (SELECT * FROM sig WHERE label % 2 = 1), e AS (
    SELECT t.id AS target, p.id AS match, (bit_count(xor(t.l0, p.l0)) + bit_count(xor(t.l1, p.l1)))::INT AS distance FROM t JOIN p ON t.id <> p.id)
  SELECT target, (min(struct_pack(d := distance, m := match))).m AS match, min(distance) AS distance FROM e WHERE distance <= 22 GROUP BY target""")
def cleanup_perceptual(spark, sf_dir: str) -> DataFrame:
    sig = C.signatures(spark, sf_dir)
    found = match.cross_edges(sig.where("label % 2 = 0"), sig.where("label % 2 = 1"), LANES, 22, bits=32)
    return found.groupBy("target").agg(F.min_by("match", F.struct("distance", "match")).alias("match"), F.min("distance").alias("distance"))


@query("""WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[])
           / (sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_inner_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[]))) AS cosine
    FROM q JOIN embeddings c ON c.vec_id <> q.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, vec_id) AS rank FROM s)
  SELECT query_id, rank, vec_id, round(cosine, 6) AS cosine FROM r WHERE rank <= 10""")
def embedding_topk(spark, sf_dir: str) -> DataFrame:
    """Nearest ten by cosine of every 50th vector against all, in blocks of queries: each block meets every vector once."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.sqrt(dot("embedding", "embedding")).alias("norm"))
    asked = e.where("vec_id % 50 = 0")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    q = asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("norm").alias("q_norm"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"))
    # a block of queries is built as a hash table; salting by the vector spreads the work of one block
    salts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    q = q.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = e.withColumn("salt", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(salts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    scored = rows.join(q.hint("shuffle_hash"), ["block", "salt"]).where("vec_id <> query_id").withColumn("cosine", dot("q", "embedding") / (F.col("q_norm") * F.col("norm")))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("cosine", 9).desc(), "vec_id"))
    return scored.withColumn("rank", nth).where("rank <= 10").select("query_id", "rank", "vec_id", F.round("cosine", 6).alias("cosine"))


# --- videos ----------------------------------------------------------------------------------------------------------

MATCH, GATE, LEAST, FRACTION, TOL_S, TOL_PCT = 30, 20, 2, 0.6, 1.0, 5.0
_PAIRS = f"""{C.FRAMES}, pair AS (SELECT x.id AS a, y.id AS b, x.duration AS da, y.duration AS db FROM video x JOIN video y ON x.id < y.id
    AND abs(x.duration - y.duration) <= greatest({TOL_S}, {TOL_PCT} / 100 * least(x.duration, y.duration)))"""
_VOTES = f"""{_PAIRS}, d AS (
    SELECT a, b, (bit_count(xor(f.l0, g.l0)) + bit_count(xor(f.l1, g.l1)))::INT AS d FROM pair JOIN frame f ON f.id = a JOIN frame g ON g.id = b AND g.frame = f.frame
    WHERE f.quality >= {GATE} AND g.quality >= {GATE}),
  vote AS (SELECT a, b, count(*) AS comparable, count(*) FILTER (d <= {MATCH}) AS matching,
                  round_even((sum(d) FILTER (d <= {MATCH}))::DOUBLE / count(*) FILTER (d <= {MATCH}), 0)::INT AS distance FROM d GROUP BY a, b),
  vedge AS (SELECT * FROM vote WHERE comparable >= {LEAST} AND matching / comparable >= {FRACTION})"""


def _pairs(spark, sf_dir: str) -> DataFrame:
    return match.duration_pairs(C.videos(spark, sf_dir), TOL_S, TOL_PCT)


def _votes(spark, sf_dir: str) -> DataFrame:
    return match.video_edges(C.frames(spark, sf_dir), C.videos(spark, sf_dir), TOL_S, TOL_PCT, LANES, MATCH, GATE, LEAST, FRACTION)


@query(f"WITH {_PAIRS} SELECT a, b FROM pair")
def video_duration_pairs(spark, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("a", "b")


@query(f"WITH {_VOTES} SELECT a, b, distance, comparable, matching FROM vedge")
def video_vote_edges(spark, sf_dir: str) -> DataFrame:
    return _votes(spark, sf_dir).select("a", "b", "distance", "comparable", "matching")


@query(f"WITH {_VOTES}, {C.EDGES} SELECT a, b, distance, 'video' AS media_type FROM vedge UNION ALL SELECT a, b, distance, 'photo' FROM edge")
def find_matches_union(spark, sf_dir: str) -> DataFrame:
    photos = _edges(spark, sf_dir).withColumn("media_type", F.lit("photo"))
    return _votes(spark, sf_dir).select("a", "b", "distance", F.lit("video").alias("media_type")).unionByName(photos)


@query(f"WITH {_VOTES}, {_bins_sql(VIDEO_BINS)} SELECT bin, lo, hi, count(a) AS n FROM bins LEFT JOIN vedge ON distance BETWEEN lo AND hi GROUP BY ALL")
def review_histogram_video(spark, sf_dir: str) -> DataFrame:
    return _histogram(spark, _votes(spark, sf_dir), VIDEO_BINS)


@query(f"WITH {C.FRAMES} SELECT id, coalesce(min(quality) FILTER (quality >= 50), min(quality)) AS quality FROM frame GROUP BY id")
def quality_min_gated(spark, sf_dir: str) -> DataFrame:
    q = F.col("quality")
    return C.frames(spark, sf_dir).groupBy("id").agg(F.coalesce(F.min(F.when(q >= 50, q)), F.min(q)).alias("quality"))


@query("""WITH m AS (SELECT l_orderkey AS group_no, (l_linenumber % 2) AS pixels, floor(l_extendedprice)::BIGINT AS size, l_quantity AS dur, l_partkey, l_suppkey, l_linenumber,
      concat_ws('_', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::INT, strftime(l_shipdate, '%Y%m%d'), floor(l_extendedprice)::BIGINT) AS path,
      CASE l_partkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 WHEN 2 THEN 1.5 ELSE 1.0 END::DOUBLE AS weight FROM lineitem),
  e AS (SELECT *, size / dur * weight AS eff FROM m), k AS (SELECT *, CASE WHEN eff <= 0 THEN -1 ELSE round_even(ln(eff) / ln(1.1), 0) END::BIGINT AS band FROM e),
  l AS (SELECT *, row_number() OVER (PARTITION BY group_no ORDER BY pixels DESC, band DESC, weight DESC, eff DESC, path) AS nth, count(*) OVER (PARTITION BY group_no, pixels) AS n1,
      count(*) OVER (PARTITION BY group_no, pixels, band) AS n2, count(*) OVER (PARTITION BY group_no, pixels, band, weight) AS n3, count(*) OVER (PARTITION BY group_no, pixels, band, weight, eff) AS n4 FROM k)
  SELECT group_no, path, band, CASE WHEN n1 = 1 THEN 'resolution' WHEN n2 = 1 THEN 'resolution + bitrate' WHEN n3 = 1 THEN 'resolution + bitrate + codec'
      WHEN n4 = 1 THEN 'resolution + bitrate + codec + fine bitrate' ELSE 'path' END AS level FROM l WHERE nth = 1""")
def keep_lead_video(spark, sf_dir: str) -> DataFrame:
    size = F.floor("l_extendedprice").cast("long")
    codec = F.element_at(F.array(*[F.lit(c) for c in ("h264", "hevc", "vp9", "unknown")]), (F.col("l_partkey") % 4 + 1).cast("int"))
    path = F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"), F.date_format(F.col("l_shipdate").cast("date"), "yyyyMMdd"), size)
    m = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("group_no"), (F.col("l_linenumber") % 2).alias("pixels"), size.alias("size"), F.col("l_quantity").alias("dur"), path.alias("path"), X.codec_weight(codec).alias("weight")
    )
    m = m.withColumn("eff", X.effective_rate(F.col("size"), F.col("dur"), F.col("weight"))).withColumn("band", X.log_band(F.col("eff"), 10.0))
    return rank.levels(m, ["pixels", "band", "weight", "eff"], ["resolution", "bitrate", "codec", "fine bitrate"]).select("group_no", "path", "band", "level")


# --- exact duplicates, merge, trash ----------------------------------------------------------------------------------


def _exact(spark, sf_dir: str, prefer: bool) -> DataFrame:
    rows = C.contents(spark, sf_dir).select(F.col("hash").alias("asset_id"), "path", "mtime", "is_external")
    return rank.exact_plan(rows, prefer)


_EXACT = f"""{C.CONTENTS}, f AS (SELECT hash AS asset_id, path, mtime, is_external, max(is_external) OVER p AS has_ext, max(1 - is_external) OVER p AS has_int, count(*) OVER p AS n
    FROM content WINDOW p AS (PARTITION BY hash)),
  d AS (SELECT *, row_number() OVER o AS nth, first_value(path) OVER o AS survivor FROM f WHERE has_int = 1 AND n > 1
    WINDOW o AS (PARTITION BY asset_id ORDER BY 1 - is_external, CASE WHEN is_external = 1 THEN 0.0 ELSE coalesce(mtime, 0.0) END, path)),
  plan AS (SELECT asset_id, path, is_external, CASE WHEN has_ext = 1 THEN 'exact-external' ELSE 'exact-internal' END AS reason, survivor FROM d WHERE nth > 1 AND is_external = 0)"""


@query(f"WITH {_EXACT} SELECT *, printf('%03d.lnk', row_number() OVER (ORDER BY asset_id, path)) AS shortcut FROM plan")
def exact_plan_default(spark, sf_dir: str) -> DataFrame:
    rows = numbered(_exact(spark, sf_dir, False), ["asset_id", "path"], "nth")
    return rows.withColumn("shortcut", X.shortcut(F.col("nth"), 3)).drop("nth")


@query(f"""WITH {_EXACT}, i AS (SELECT *, row_number() OVER o AS nth2, first_value(path) OVER o AS survivor2 FROM f WHERE has_int = 1 AND n > 1
    WINDOW o AS (PARTITION BY asset_id ORDER BY is_external, CASE WHEN is_external = 1 THEN 0.0 ELSE coalesce(mtime, 0.0) END, path))
  SELECT asset_id, path, is_external, CASE WHEN has_ext = 1 THEN 'exact-internal-preferred' ELSE 'exact-internal' END AS reason, survivor2 AS survivor FROM i WHERE nth2 > 1""")
def exact_plan_prefer_internal(spark, sf_dir: str) -> DataFrame:
    return _exact(spark, sf_dir, True)


@query(f"""WITH {_EXACT}, g AS (SELECT asset_id, count(*) AS n, count(*) FILTER (is_external = 0) AS i, bool_or(reason <> 'exact-internal') AS mixed FROM plan GROUP BY asset_id)
  SELECT coalesce(sum(n), 0)::BIGINT AS to_delete, coalesce(sum(i), 0)::BIGINT AS internal, count(*) FILTER (NOT mixed) AS groups_internal_only, count(*) FILTER (mixed) AS groups_mixed FROM g""")
def exact_split(spark, sf_dir: str) -> DataFrame:
    per = _exact(spark, sf_dir, False).groupBy("asset_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_external") == 0).alias("i"), F.bool_or(F.col("reason") != "exact-internal").alias("mixed"))
    zero = F.lit(0).cast("long")
    return per.agg(
        F.coalesce(F.sum("n"), zero).alias("to_delete"), F.coalesce(F.sum("i"), zero).alias("internal"), F.count_if(~F.col("mixed")).alias("groups_internal_only"), F.count_if("mixed").alias("groups_mixed")
    )


@query(f"WITH {C.INST} SELECT asset_id, path FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY (root_id <> 3)::INT, path) AS n FROM inst) WHERE n = 1")
def representative_instance(spark, sf_dir: str) -> DataFrame:
    return rank.representative(C.instances(spark, sf_dir), 3).select("asset_id", "path")


_INCOMING = f"""{C.memory_sql("source >= 'src2'")}, inc AS (SELECT hash, path AS rel, mtime FROM content WHERE source < 'src2'),
  cls AS (SELECT i.hash, i.rel, CASE WHEN nth > 1 THEN 'dup-in-source' WHEN status IS NULL THEN 'new' WHEN status = 'trashed' THEN 'trashed' ELSE 'exact-known' END AS class
    FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY coalesce(mtime, 0.0), rel) AS nth FROM inc) i LEFT JOIN known k ON k.hash = i.hash)"""


def _classified(spark, sf_dir: str) -> DataFrame:
    incoming = C.contents(spark, sf_dir).where("source < 'src2'").select("hash", F.col("path").alias("rel"), "mtime")
    return reconcile.classify(incoming, C.memory(spark, sf_dir, "source >= 'src2'")).select("hash", "rel", "class")


@query(f"WITH {_INCOMING} SELECT hash, rel, class FROM cls")
def merge_classify(spark, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir)


@query(f"WITH {_INCOMING} SELECT hash, rel FROM cls WHERE class = 'dup-in-source'")
def merge_dup_in_source(spark, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).where("class = 'dup-in-source'").select("hash", "rel")


@query(f"WITH {_INCOMING} SELECT class, count(*) AS n FROM cls GROUP BY class")
def merge_dry_counts(spark, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


# a copy goes to the folder of its source; what the destination's rules ignore is copied, but not indexed
_PROGRESS = f"""{_INCOMING}, s AS (SELECT rel, CASE WHEN class <> 'new' THEN 'skipped' WHEN regexp_matches(rel, '(?i)^/(?:.*/)?[^/]*[37]$') THEN 'copied-unindexed' ELSE 'registered' END AS state FROM cls)"""


def _progress(spark, sf_dir: str) -> DataFrame:
    ignored = X.ignored(F.substring("rel", F.lit(2), F.length("rel")), ["*[37]"])
    state = F.when(F.col("class") != "new", "skipped").when(ignored, "copied-unindexed").otherwise("registered")
    return _classified(spark, sf_dir).select("rel", state.alias("state"))


@query(f"WITH {_PROGRESS} SELECT rel, state FROM s")
def merge_register(spark, sf_dir: str) -> DataFrame:
    return _progress(spark, sf_dir)


@query(f"WITH {_PROGRESS} SELECT state, regexp_replace(rel, '/[^/]*$', '') AS folder, count(*) AS n FROM s GROUP BY ALL")
def merge_progress_summary(spark, sf_dir: str) -> DataFrame:
    return _progress(spark, sf_dir).groupBy("state", F.regexp_replace("rel", "/[^/]*$", "").alias("folder")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {C.memory_sql("doc_id % 7 <> 0")}, box AS (SELECT hash, path AS rel, row_number() OVER (PARTITION BY hash ORDER BY path) AS nth FROM content WHERE doc_id % 7 = 0)
  SELECT b.hash, rel, CASE WHEN nth > 1 OR status = 'trashed' THEN 'already_trashed' WHEN status IS NULL THEN 'new_trashed' ELSE 'flipped' END AS outcome FROM box b LEFT JOIN known k ON k.hash = b.hash""")
def trash_absorb(spark, sf_dir: str) -> DataFrame:
    inbox = C.contents(spark, sf_dir).where("doc_id % 7 = 0").select("hash", F.col("path").alias("rel"))
    return reconcile.absorb(inbox, C.memory(spark, sf_dir, "doc_id % 7 <> 0")).select("hash", "rel", "outcome")


@query(f"""WITH {C.memory_sql("doc_id % 7 <> 1")}, box AS (SELECT hash, path AS rel, row_number() OVER (PARTITION BY hash ORDER BY path) AS nth FROM content WHERE doc_id % 3 = 0)
  SELECT b.hash, rel, CASE WHEN status IS NULL THEN 'unknown' WHEN status = 'trashed' AND instances > 1 AND nth = 1 THEN 'untrashed' WHEN status = 'trashed' AND instances <= 1 AND nth = 1 THEN 'forgotten'
    WHEN status = 'trashed' AND instances <= 1 THEN 'unknown' ELSE 'already_active' END AS outcome FROM box b LEFT JOIN known k ON k.hash = b.hash""")
def untrash_outcomes(spark, sf_dir: str) -> DataFrame:
    files = C.contents(spark, sf_dir).where("doc_id % 3 = 0").select("hash", F.col("path").alias("rel"))
    known = C.memory(spark, sf_dir, "doc_id % 7 <> 1")
    counts = known.select("hash", (F.col("instances") - 1).alias("instances"))
    return reconcile.untrash(files, known, counts).select("hash", "rel", "outcome")


_IA = f"{C.ASSETS}, {C.INST}, ia AS (SELECT i.*, status, media_type, asset_size, undecodable FROM inst i JOIN assets a ON a.asset_id = i.asset_id)"


def _with_assets(spark, sf_dir: str) -> DataFrame:
    return C.instances(spark, sf_dir).join(C.assets(spark, sf_dir), "asset_id")


@query(f"WITH {_IA} SELECT asset_id, path FROM ia WHERE status = 'trashed' AND root_id = 3")
def cleanup_exact(spark, sf_dir: str) -> DataFrame:
    return _with_assets(spark, sf_dir).where("status = 'trashed' AND root_id = 3").select("asset_id", "path")


@query(f"WITH {_IA} SELECT asset_id, path FROM ia WHERE status = 'active' AND undecodable = 1")
def cleanup_undecodable(spark, sf_dir: str) -> DataFrame:
    return _with_assets(spark, sf_dir).where("status = 'active' AND undecodable = 1").select("asset_id", "path")


@query(f"WITH {_IA} SELECT root_id, count(*) AS n, count(*) FILTER (root_id = 5) AS on_network FROM ia WHERE status = 'trashed' GROUP BY root_id")
def cleanup_preview(spark, sf_dir: str) -> DataFrame:
    """Files that a cleanup would delete, and how many of them have no recycle bin: here one root is a network share."""
    path = F.when(F.col("root_id") == 5, F.concat(F.lit("\\\\nas"), F.translate("path", "/", "\\"))).otherwise(F.col("path"))
    return _with_assets(spark, sf_dir).where("status = 'trashed'").groupBy("root_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(X.is_network(path)).alias("on_network"))


# --- a listing against the catalog -----------------------------------------------------------------------------------

_FAST = f"""{C.LISTING}, fast AS (SELECT l.*, coalesce(l.size = e.size AND abs(l.mtime - e.mtime) <= 2.0 AND e.complete, false) AS hit
    FROM listing l LEFT JOIN existing e ON e.root_id = l.root_id AND e.path = l.path)"""


def _state(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The catalog's instances, written once, and a later listing of the same roots."""
    known = C.written(spark, sf_dir)
    return known, C.listing(known)


def _fast(spark, sf_dir: str) -> DataFrame:
    return reconcile.fastpath(*_state(spark, sf_dir))


@query(f"WITH {_FAST} SELECT root_id, path, hit FROM fast")
def fastpath_split(spark, sf_dir: str) -> DataFrame:
    return _fast(spark, sf_dir).select("root_id", "path", "hit")


@query(f"WITH {_FAST} SELECT root_id, count(*) FILTER (NOT hit) AS new_or_changed FROM fast GROUP BY root_id")
def probe_new_count(spark, sf_dir: str) -> DataFrame:
    return _fast(spark, sf_dir).groupBy("root_id").agg(F.count_if(~F.col("hit")).alias("new_or_changed"))


_MOVES = f"""{C.LISTING}, absent AS (SELECT * FROM listing l WHERE NOT EXISTS (SELECT 1 FROM existing e WHERE e.root_id = l.root_id AND lower(e.path) = lower(l.path))),
  a1 AS (SELECT root_id, lower(filename) AS name, size, min(path) AS path, min(mtime) AS mtime FROM absent GROUP BY ALL HAVING count(*) = 1),
  e1 AS (SELECT * FROM (SELECT *, lower(filename) AS name, count(*) OVER (PARTITION BY root_id, lower(filename), size) AS n FROM existing) WHERE n = 1),
  moved AS MATERIALIZED (SELECT e.fid, e.path AS old_path, a.path AS new_path FROM e1 e JOIN a1 a ON a.root_id = e.root_id AND a.name = e.name AND a.size = e.size
    WHERE e.status = 'active' AND e.complete AND abs(e.mtime - a.mtime) <= 2.0 AND e.root_id <> 5
      AND NOT EXISTS (SELECT 1 FROM listing l WHERE l.root_id = e.root_id AND lower(l.path) = lower(e.path))),
  removed AS MATERIALIZED (SELECT * FROM existing e WHERE NOT EXISTS (SELECT 1 FROM listing l WHERE l.root_id = e.root_id AND l.path = e.path)
    AND NOT EXISTS (SELECT 1 FROM moved m WHERE m.fid = e.fid) AND NOT (e.root_id = 5))"""


def _suppressed(spark) -> DataFrame:
    return spark.createDataFrame([(5, "/r5/")], "root_id int, dir string")


def _moves(spark, known: DataFrame, found: DataFrame) -> DataFrame:
    return reconcile.moves(known, found, suppressed=_suppressed(spark), fold=True)


def _removed(spark, known: DataFrame, found: DataFrame) -> DataFrame:
    gone = reconcile.gone(known, found, _moves(spark, known, found), _suppressed(spark))
    return Scratch(spark, "removed").write(gone.select("root_id", "path", "fid", "asset_id"), "removed")


@query(f"WITH {_MOVES} SELECT fid, old_path, new_path FROM moved")
def move_plan(spark, sf_dir: str) -> DataFrame:
    return _moves(spark, *_state(spark, sf_dir))


@query(f"WITH {_MOVES} SELECT root_id, path FROM removed")
def deletions(spark, sf_dir: str) -> DataFrame:
    return _removed(spark, *_state(spark, sf_dir)).select("root_id", "path")


@query(f"""WITH {_MOVES} SELECT asset_id FROM assets a WHERE status = 'active' AND asset_id IN (SELECT asset_id FROM removed)
  AND asset_id NOT IN (SELECT asset_id FROM existing e WHERE e.fid NOT IN (SELECT fid FROM removed))""")
def orphans(spark, sf_dir: str) -> DataFrame:
    known, found = _state(spark, sf_dir)
    return reconcile.orphans(C.assets(spark, sf_dir), known, _removed(spark, known, found)).select("asset_id")


_OUT = f"""{C.memory_sql("doc_id % 3 <> 0")}, o AS (SELECT c.doc_id, source, CASE WHEN n_chars % 41 = 0 THEN 'undecodable' WHEN status = 'trashed' THEN 'matches_trashed' WHEN status = 'active' THEN 'exact_dup'
    WHEN row_number() OVER (PARTITION BY c.hash ORDER BY path) > 1 THEN 'exact_dup' ELSE 'new' END AS outcome FROM content c LEFT JOIN known k ON k.hash = c.hash WHERE c.doc_id % 3 = 0)"""


def _outcomes(spark, sf_dir: str) -> DataFrame:
    rows = C.contents(spark, sf_dir).where("doc_id % 3 = 0").join(C.memory(spark, sf_dir, "doc_id % 3 <> 0"), "hash", "left")
    nth = F.row_number().over(Window.partitionBy("hash").orderBy("path"))
    kind = (
        F.when(F.col("n_chars") % 41 == 0, "undecodable").when(F.col("status") == "trashed", "matches_trashed").when(F.col("status") == "active", "exact_dup").when(F.col("nth") > 1, "exact_dup").otherwise("new")
    )
    return rows.withColumn("nth", nth).withColumn("outcome", kind)


@query(f"WITH {_OUT} SELECT doc_id, outcome FROM o")
def scan_outcomes(spark, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir).select("doc_id", "outcome")


@query(f"""WITH {_OUT}, t AS (SELECT source, outcome, count(*) AS n FROM o GROUP BY ALL)
  SELECT source, coalesce(nullif(string_agg(n || ' ' || outcome, ' · ' ORDER BY outcome) FILTER (outcome <> 'exact_dup'), ''), 'no changes') AS summary FROM t GROUP BY source""")
def scan_summary(spark, sf_dir: str) -> DataFrame:
    tally = _outcomes(spark, sf_dir).groupBy("source", "outcome").agg(F.count(F.lit(1)).alias("n"))
    part = F.when(F.col("outcome") != "exact_dup", F.struct("outcome", F.concat_ws(" ", "n", "outcome").alias("text")))
    text = F.array_join(F.array_sort(F.collect_list(part)).getField("text"), " · ")
    return tally.groupBy("source").agg(F.when(text == "", "no changes").otherwise(text).alias("summary"))


# --- statistics ------------------------------------------------------------------------------------------------------


@query(f"""WITH {C.ASSETS} SELECT count(*) FILTER (status = 'active' AND media_type = 'photo') AS photos, count(*) FILTER (status = 'active' AND media_type = 'video') AS videos,
  count(*) FILTER (status = 'trashed') AS trashed, coalesce(sum(asset_size) FILTER (status = 'active'), 0)::BIGINT AS bytes FROM assets""")
def collection_stats(spark, sf_dir: str) -> DataFrame:
    active, photo = F.col("status") == "active", F.col("media_type") == "photo"
    return C.assets(spark, sf_dir).agg(
        F.count_if(active & photo).alias("photos"),
        F.count_if(active & ~photo).alias("videos"),
        F.count_if(~active).alias("trashed"),
        F.coalesce(F.sum(F.when(active, F.col("asset_size"))), F.lit(0)).alias("bytes"),
    )


_SNAP = f"""{_IA}, {C.ROOTS_SQL}, snap AS (SELECT r.root_id, name, kind, count(DISTINCT i.asset_id) AS assets, count(DISTINCT CASE WHEN media_type = 'photo' THEN i.asset_id END) AS photos,
  count(DISTINCT CASE WHEN media_type = 'video' THEN i.asset_id END) AS videos, count(i.path) AS files, coalesce(sum(i.size), 0)::BIGINT AS bytes, max(i.mtime) AS newest
  FROM roots r LEFT JOIN ia i ON i.root_id = r.root_id GROUP BY ALL)"""


def _snapshot(spark, sf_dir: str) -> DataFrame:
    medium = lambda m: F.count_distinct(F.when(F.col("media_type") == m, F.col("asset_id")))
    per = _with_assets(spark, sf_dir).groupBy("root_id").agg(
        F.count_distinct("asset_id").alias("assets"), medium("photo").alias("photos"), medium("video").alias("videos"), F.count("path").alias("files"), F.sum("size").alias("bytes"), F.max("mtime").alias("newest")
    )
    return C.roots(spark).join(per, "root_id", "left").select("root_id", "name", "kind", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("assets", "photos", "videos", "files", "bytes")], "newest")


@query(f"WITH {_SNAP} SELECT * FROM snap")
def roots_snapshot(spark, sf_dir: str) -> DataFrame:
    return _snapshot(spark, sf_dir)


@query(f"""WITH {_IA} SELECT status, media_type, count(DISTINCT asset_id) AS assets, count(*) AS files, sum(size)::BIGINT AS bytes, count(*) FILTER (undecodable = 1) AS undecodable
  FROM ia WHERE root_id = 2 GROUP BY ALL""")
def root_detail(spark, sf_dir: str) -> DataFrame:
    return (
        _with_assets(spark, sf_dir).where("root_id = 2").groupBy("status", "media_type")
        .agg(F.count_distinct("asset_id").alias("assets"), F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.count_if(F.col("undecodable") == 1).alias("undecodable"))
    )


@query(f"WITH {_SNAP} SELECT root_id, row_number() OVER (ORDER BY assets DESC, root_id) AS by_assets, row_number() OVER (ORDER BY photos DESC, root_id) AS by_photos, row_number() OVER (ORDER BY videos DESC, root_id) AS by_videos FROM snap")
def sort_roots_cycle(spark, sf_dir: str) -> DataFrame:
    nth = lambda c: F.row_number().over(Window.orderBy(F.col(c).desc(), "root_id")).alias(f"by_{c}")
    return _snapshot(spark, sf_dir).select("root_id", nth("assets"), nth("photos"), nth("videos"))


@query(f"""WITH {C.ROOTS_SQL} SELECT root_id, CASE WHEN kind = 'trash' THEN '' WHEN probe_new > 0 THEN 'new' WHEN last_scan IS NULL THEN 'never' WHEN needs_dedup = 1 THEN 'dirty'
  WHEN root_id % 3 = 0 THEN 'deduped' ELSE 'scanned' END AS dot FROM roots""")
def status_dot(spark, sf_dir: str) -> DataFrame:
    dot = X.status_dot(F.col("kind"), F.col("probe_new"), F.col("last_scan"), F.col("needs_dedup"), F.col("root_id") % 3 == 0)
    return C.roots(spark).select("root_id", dot.alias("dot"))


@query("SELECT (user_id % 10)::INT AS root_id, event_type, max(ts) AS confirmed_at, (max(struct_pack(t := ts, i := event_id))).i AS id FROM events GROUP BY ALL")
def last_completed_review(spark, sf_dir: str) -> DataFrame:
    newest = F.max(F.struct("ts", "event_id"))
    rows = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).cast("int").alias("root_id"), "event_type").agg(newest.alias("n"))
    return rows.select("root_id", "event_type", F.col("n.ts").alias("confirmed_at"), F.col("n.event_id").alias("id"))


@query(f"WITH {C.JOBS} SELECT sum(json_extract(result_json, '$.k')::BIGINT)::BIGINT AS lifetime, count(*) AS n FROM jobs WHERE type = 'dedup' AND status = 'done'")
def lifetime_json_sum(spark, sf_dir: str) -> DataFrame:
    k = F.get_json_object("result_json", "$.k").cast("long")
    return C.jobs(spark, sf_dir).where("type = 'dedup' AND status = 'done'").agg(F.sum(k).alias("lifetime"), F.count(F.lit(1)).alias("n"))


@query("""SELECT event_type, (user_id % 4)::INT AS bucket, round(sum(value), 2) AS seconds, count(*) AS n, CASE WHEN sum(CASE WHEN event_id % 2 = 0 THEN value END) > 1.5 * sum(CASE WHEN event_id % 2 = 1 THEN value END)
  THEN 'idle' WHEN sum(CASE WHEN event_id % 2 = 1 THEN value END) > 1.5 * sum(CASE WHEN event_id % 2 = 0 THEN value END) THEN 'blocked' ELSE 'balanced' END AS verdict,
  round(sum(event_id) / sum(value), 3) AS throughput, round(sum(value) / (epoch(max(date_trunc('second', ts)))::BIGINT - epoch(min(date_trunc('second', ts)))::BIGINT + 1), 6) AS parallelism FROM events GROUP BY ALL""")
def profile_rollup(spark, sf_dir: str) -> DataFrame:
    even, odd = F.sum(F.when(F.col("event_id") % 2 == 0, F.col("value"))), F.sum(F.when(F.col("event_id") % 2 == 1, F.col("value")))
    verdict = F.when(even > 1.5 * odd, "idle").when(odd > 1.5 * even, "blocked").otherwise("balanced")
    """Seconds by medium and bucket, bytes a second, workers busy at once on the whole, and what waits for what."""
    busy, moved = F.sum("value"), F.sum("event_id")
    span = C.epoch("max(ts)") - C.epoch("min(ts)") + 1
    return table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 4).cast("int").alias("bucket")).agg(
        F.round(busy, 2).alias("seconds"), F.count(F.lit(1)).alias("n"), verdict.alias("verdict"), F.round(moved / busy, 3).alias("throughput"), F.round(busy / span, 6).alias("parallelism")
    )


# --- jobs ------------------------------------------------------------------------------------------------------------


@query(f"WITH {C.JOBS} SELECT id, row_number() OVER (ORDER BY priority DESC, enqueued_at, id) AS place FROM jobs WHERE status = 'queued' ORDER BY place LIMIT 50")
def queue_order(spark, sf_dir: str) -> DataFrame:
    order = [F.col("priority").desc(), F.col("enqueued_at"), F.col("id")]
    top = C.jobs(spark, sf_dir).where("status = 'queued'").orderBy(*order).limit(50)
    return top.select("id", F.row_number().over(Window.orderBy(*order)).alias("place"))


@query(f"WITH {C.JOBS}, {C.RUNS} SELECT id, type, root_id FROM jobs WHERE status = 'queued' AND root_id NOT IN (SELECT root_id FROM runs WHERE status = 'pending') ORDER BY priority DESC, enqueued_at, id LIMIT 1")
def first_runnable(spark, sf_dir: str) -> DataFrame:
    jobs = C.jobs(spark, sf_dir)
    held = C.runs(spark, sf_dir).where("status = 'pending'").select("root_id").distinct()
    return J.runnable(jobs, held).select("id", "type", "root_id")


@query(f"WITH {C.JOBS} SELECT id, type, status FROM jobs WHERE status IN ('done', 'error', 'cancelled', 'interrupted') ORDER BY id DESC LIMIT 20 OFFSET 40")
def history_page(spark, sf_dir: str) -> DataFrame:
    return C.jobs(spark, sf_dir).where(F.col("status").isin("done", "error", "cancelled", "interrupted")).orderBy(F.col("id").desc()).offset(40).limit(20).select("id", "type", "status")


@query(f"WITH {C.JOBS} SELECT id, type FROM jobs WHERE status = 'interrupted' ORDER BY enqueued_at DESC, id DESC LIMIT 20")
def top_interrupted(spark, sf_dir: str) -> DataFrame:
    return C.jobs(spark, sf_dir).where("status = 'interrupted'").orderBy(F.col("enqueued_at").desc(), F.col("id").desc()).limit(20).select("id", "type")


@query(f"WITH {C.JOBS}, {C.ROOTS_SQL} SELECT name, kind, status, count(*) AS n FROM jobs j LEFT JOIN roots r ON r.root_id = j.root_id GROUP BY ALL")
def jobs_left_roots(spark, sf_dir: str) -> DataFrame:
    return C.jobs(spark, sf_dir).join(C.roots(spark), "root_id", "left").groupBy("name", "kind", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {C.JOBS}, {C.ROOTS_SQL}, r AS (SELECT root_id, min(id) AS review FROM jobs WHERE type = 'dedup' AND status = 'running' GROUP BY root_id),
  m AS (SELECT root_id, min(id) AS merge_ FROM jobs WHERE type = 'merge' AND status = 'running' GROUP BY root_id)
  SELECT roots.root_id, CASE WHEN review IS NOT NULL THEN 'review' WHEN merge_ IS NOT NULL THEN 'merge' END AS holder, coalesce(review, merge_) AS id,
    CASE WHEN review IS NOT NULL THEN 'review' END AS holder_of_a_merge FROM roots LEFT JOIN r USING (root_id) LEFT JOIN m USING (root_id)""")
def root_holder(spark, sf_dir: str) -> DataFrame:
    """What holds a root: a review first, then a merge; a job that may run beside its own merge looks at the last column."""
    first = lambda kind, name: C.jobs(spark, sf_dir).where(f"type = '{kind}' AND status = 'running'").groupBy("root_id").agg(F.min("id").alias(name))
    rows = C.roots(spark).join(first("dedup", "review"), "root_id", "left").join(first("merge", "merge"), "root_id", "left")
    return rows.select("root_id", F.when(F.col("review").isNotNull(), "review").when(F.col("merge").isNotNull(), "merge").alias("holder"), F.coalesce("review", "merge").alias("id"), F.when(F.col("review").isNotNull(), "review").alias("holder_of_a_merge"))


@query(f"""WITH {C.JOBS} SELECT type || CASE WHEN json_extract_string(params_json, '$.confirm') = 'true' THEN ' (apply)' WHEN json_extract_string(params_json, '$.dry_run') = 'true' THEN ' (dry run)'
  WHEN json_extract_string(params_json, '$.full') = 'true' THEN ' (full)' ELSE '' END AS label, count(*) AS n FROM jobs GROUP BY ALL""")
def job_labels(spark, sf_dir: str) -> DataFrame:
    return C.jobs(spark, sf_dir).groupBy(X.job_label(F.col("type"), F.col("params_json")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {C.JOBS} SELECT id, CASE WHEN status = 'running' OR (status = 'queued' AND type IN ('dedup', 'cleanup') AND coalesce(json_extract_string(params_json, '$.confirm') = 'true', false)) THEN 'interrupted' ELSE status END AS status FROM jobs""")
def reconcile_startup(spark, sf_dir: str) -> DataFrame:
    return J.restarted(C.jobs(spark, sf_dir)).select("id", "status")


@query(f"""WITH {C.JOBS} SELECT id, CASE WHEN s >= 0 AND s < 90 THEN 'now' WHEN s >= 0 AND s < 3600 THEN (s // 60) || 'm ago' WHEN s >= 0 AND s < 21600 THEN (s // 3600) || 'h ago'
    WHEN s >= 0 AND t::DATE = n::DATE THEN strftime(t, '%H:%M') WHEN year(t) = year(n) THEN strftime(t, '%b %d') ELSE strftime(t, '%Y %b %d') END AS ago
  FROM (SELECT id, enqueued_at AS t, TIMESTAMP '2024-01-02 18:30:00' AS n, (epoch(TIMESTAMP '2024-01-02 18:30:00')::BIGINT - floor(epoch(enqueued_at))::BIGINT) AS s FROM jobs)""")
def reltime(spark, sf_dir: str) -> DataFrame:
    now = F.lit("2024-01-02 18:30:00").cast("timestamp")
    return C.jobs(spark, sf_dir).select("id", X.reltime(F.col("enqueued_at").cast("timestamp"), now).alias("ago"))


@query("""SELECT o_orderkey AS id, CASE WHEN n >= 1073741824 THEN CASE WHEN n / 1073741824 >= 10 THEN printf('%.0f GB', round_even(n / 1073741824, 0)) ELSE printf('%.1f GB', round_even(n / 1073741824 * 10, 0) / 10) END
    WHEN n >= 1048576 THEN CASE WHEN n / 1048576 >= 10 THEN printf('%.0f MB', round_even(n / 1048576, 0)) ELSE printf('%.1f MB', round_even(n / 1048576 * 10, 0) / 10) END
    WHEN n >= 1024 THEN CASE WHEN n / 1024 >= 10 THEN printf('%.0f KB', round_even(n / 1024, 0)) ELSE printf('%.1f KB', round_even(n / 1024 * 10, 0) / 10) END
    ELSE printf('%d B', n::BIGINT) END AS size FROM (SELECT o_orderkey, floor(o_totalprice * (o_orderkey % 13) * (o_orderkey % 7) * (o_orderkey % 101))::DOUBLE AS n FROM orders)""")
def fmt_size(spark, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    n = F.floor(F.col("o_totalprice") * (k % 13) * (k % 7) * (k % 101)).cast("double")
    return table(spark, sf_dir, "orders").select(k.alias("id"), X.fmt_size(n).alias("size"))


@query("""WITH e AS (SELECT event_id, user_id, epoch(ts)::BIGINT AS t, event_id AS done FROM (SELECT * REPLACE (date_trunc('second', ts) AS ts) FROM events)),
  w AS (SELECT *, first_value(t) OVER r AS t0, first_value(done) OVER r AS d0, lag(t) OVER o AS tp, lag(done) OVER o AS dp FROM e
    WINDOW r AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 7200 PRECEDING AND CURRENT ROW), o AS (PARTITION BY user_id ORDER BY t, event_id)),
  s AS (SELECT *, CASE WHEN t0 = t THEN tp ELSE t0 END AS ts0, CASE WHEN t0 = t THEN dp ELSE d0 END AS ds0 FROM w)
  SELECT event_id, CASE WHEN t > ts0 AND done > ds0 THEN round((20000 - done) / ((done - ds0)::DOUBLE / (t - ts0)), 3) END AS eta_s FROM s""")
def eta_rate(spark, sf_dir: str) -> DataFrame:
    """Remaining seconds by the rate over a trailing window; the last two samples at least."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", C.epoch("ts").cast("long").alias("t"), F.col("event_id").alias("done"))
    window = Window.partitionBy("user_id").orderBy("t").rangeBetween(-7200, 0)
    order = Window.partitionBy("user_id").orderBy("t", "event_id")
    first_t, first_d = F.first("t").over(window), F.first("done").over(window)
    s = e.withColumn("t0", F.when(first_t == F.col("t"), F.lag("t").over(order)).otherwise(first_t)).withColumn("d0", F.when(first_t == F.col("t"), F.lag("done").over(order)).otherwise(first_d))
    rate = (F.col("done") - F.col("d0")).cast("double") / (F.col("t") - F.col("t0"))
    return s.select("event_id", F.when((F.col("t") > F.col("t0")) & (F.col("done") > F.col("d0")), F.round((20000 - F.col("done")) / rate, 3)).alias("eta_s"))


# --- names and paths -------------------------------------------------------------------------------------------------

_REL = "regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+/?', ''), '[?#].*$', '')"


def _pages(spark, sf_dir: str) -> DataFrame:
    rel = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]+/?", ""), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", "url", rel.alias("rel"))


_NAMED = f"named AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'IMG_' || page_id || '.JPG' WHEN 1 THEN 'clip.' || page_id || '.mp4' WHEN 2 THEN '.jpg' WHEN 3 THEN 'raw' || page_id || '.CR2' ELSE {_REL} END AS name FROM pages)"


@query(f"""WITH {_NAMED}, e AS (SELECT page_id, name, lower(regexp_extract(name, '[^/\\\\]\\.([^./\\\\]+)$', 1)) AS ext FROM named)
  SELECT page_id, ext, CASE WHEN ext IN ({", ".join(repr(x) for x in X.PHOTO + X.RAW)}) THEN 'photo' WHEN ext IN ({", ".join(repr(x) for x in X.VIDEO)}) THEN 'video' END AS media_type FROM e""")
def ext_media_type(spark, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    name = (
        F.when(k % 5 == 0, F.concat(F.lit("IMG_"), k, F.lit(".JPG"))).when(k % 5 == 1, F.concat(F.lit("clip."), k, F.lit(".mp4"))).when(k % 5 == 2, ".jpg").when(k % 5 == 3, F.concat(F.lit("raw"), k, F.lit(".CR2"))).otherwise(F.col("rel"))
    )
    return _pages(spark, sf_dir).withColumn("name", name).select("page_id", X.ext(F.col("name")).alias("ext"), X.media_type(F.col("name")).alias("media_type"))


@query(f"""SELECT page_id, regexp_matches({_REL}, '(?i)^(?:.*/)?[^/]*\\.html$') OR regexp_matches({_REL}, '(?i)^fr/[^/]*[5-9]$') OR regexp_matches({_REL}, '(?i)^(?:.*/)?es/') OR regexp_matches({_REL}, '(?i)^fr/[^/]*[5-9]/') OR regexp_matches({_REL}, '(?i)^(?:.*/)?[^/]*\\.html/') AS ignored FROM pages""")
def glob_filter(spark, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", X.ignored(F.col("rel"), ["*.html", "/fr/*[5-9]", "es/"]).alias("ignored"))


@query(f"""WITH u AS (SELECT page_id, '/' || {_REL} AS path FROM pages), f AS (SELECT * FROM (VALUES ('/en'), ('/fr/'), ('/e')) v(folder))
  SELECT page_id, folder FROM u JOIN f ON path = rtrim(folder, '/') OR starts_with(path, rtrim(folder, '/') || '/')""")
def path_within(spark, sf_dir: str) -> DataFrame:
    folders = spark.createDataFrame([("/en",), ("/fr/",), ("/e",)], "folder string")
    rows = _pages(spark, sf_dir).select("page_id", F.concat(F.lit("/"), F.col("rel")).alias("path"))
    return reconcile.contained(rows, "path", folders, "folder").select("page_id", "folder")


@query(f"""WITH d AS (SELECT page_id, {_REL} || CASE WHEN page_id % 2 = 0 THEN '/a.jpg' ELSE '/a.txt' END AS rel FROM pages)
  SELECT page_id, page_id % 2 = 1 OR regexp_matches(rel, '(?i)^(?:.*/)?es/') AS ignored FROM d""")
def dest_ignored(spark, sf_dir: str) -> DataFrame:
    rel = F.concat("rel", F.when(F.col("page_id") % 2 == 0, "/a.jpg").otherwise("/a.txt"))
    return _pages(spark, sf_dir).select("page_id", (X.media_type(rel).isNull() | X.ignored(rel, ["es/"])).alias("ignored"))


@query("SELECT doc_id, CASE WHEN doc_id % 8 & 2 <> 0 THEN 'hidden' WHEN doc_id % 8 & 4 <> 0 THEN 'system' WHEN n_chars % 9 = 0 THEN 'zero-byte' END AS reason FROM documents")
def junk_filter(spark, sf_dir: str) -> DataFrame:
    size = F.when(F.col("n_chars") % 9 == 0, 0).otherwise(F.col("n_chars"))
    return table(spark, sf_dir, "documents").select("doc_id", X.junk(size, (F.col("doc_id") % 8).cast("int")).alias("reason"))


@query(f"""WITH {C.ROOTS_SQL}, c AS (SELECT * FROM (VALUES ('/r3/photos'), ('/r'), ('/'), ('/r1')) v(candidate))
  SELECT candidate, root_id FROM c JOIN roots ON candidate = root_path OR starts_with(candidate, root_path || '/') OR starts_with(root_path, rtrim(candidate, '/') || '/')""")
def root_overlap(spark, sf_dir: str) -> DataFrame:
    """Candidate folders against every root, both ways."""
    candidates = spark.createDataFrame([("/r3/photos",), ("/r",), ("/",), ("/r1",)], "candidate string")
    inside = reconcile.contained(candidates, "candidate", C.roots(spark), "root_path").select("candidate", "root_id")
    around = reconcile.contained(C.roots(spark), "root_path", candidates, "candidate").select("candidate", "root_id")
    return inside.union(around).distinct()


@query(f"""WITH {C.ROOTS_SQL}, c AS (SELECT * FROM (VALUES ('/r3'), ('root5'), ('/r6/sub'), ('nothing')) v(asked)),
  h AS (SELECT asked, root_id, CASE WHEN asked = root_path OR starts_with(asked, root_path || '/') THEN 0 ELSE 1 END AS way FROM c JOIN roots ON asked = root_path OR starts_with(asked, root_path || '/') OR lower(asked) = lower(name))
  SELECT asked, (min(struct_pack(w := way, r := root_id))).r AS root_id FROM h GROUP BY asked""")
def root_resolve(spark, sf_dir: str) -> DataFrame:
    """A root by path first, then by name in any case."""
    asked = spark.createDataFrame([("/r3",), ("root5",), ("/r6/sub",), ("nothing",)], "asked string")
    by_path = reconcile.contained(asked, "asked", C.roots(spark), "root_path").select("asked", "root_id", F.lit(0).alias("way"))
    by_name = asked.join(C.roots(spark), F.lower("asked") == F.lower("name")).select("asked", "root_id", F.lit(1).alias("way"))
    hits = by_path.unionByName(by_name)
    return hits.groupBy("asked").agg(F.min_by("root_id", F.struct("way", "root_id")).alias("root_id"))


@query("SELECT event_id, coalesce(TRY_CAST(CASE event_id % 4 WHEN 0 THEN '7' WHEN 1 THEN 'abc' WHEN 2 THEN NULL ELSE '25' END AS INT), 10) AS threshold FROM events")
def threshold_fallback(spark, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 4 == 0, "7").when(F.col("event_id") % 4 == 1, "abc").when(F.col("event_id") % 4 == 3, "25")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(raw.try_cast("int"), F.lit(10)).alias("threshold"))


@query("""SELECT o_orderkey AS id, CASE WHEN starts_with(raw, '0000') THEN NULL ELSE replace(substr(raw, 1, 10), ':', '-') || substr(raw, 11) END AS captured_at
  FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN '0000:00:00 00:00:00' ELSE strftime(o_orderdate, '%Y:%m:%d %H:%M:%S') END AS raw FROM orders)""")
def capture_time(spark, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("o_orderkey") % 6 == 0, "0000:00:00 00:00:00").otherwise(F.date_format(F.col("o_orderdate").cast("date"), "yyyy:MM:dd 00:00:00"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), raw.alias("raw")).select("id", F.when(~F.startswith("raw", F.lit("0000")), F.concat(F.translate(F.substring("raw", 1, 10), ":", "-"), F.expr("substring(raw, 11)"))).alias("captured_at"))


@query(f"""WITH {C.FRAMES}, t AS (SELECT id, duration, k, duration * (k + 0.5) / 4 AS target FROM video, (SELECT unnest(range(4))::INT AS k)),
  p AS (SELECT id, frame, (sum(n) OVER (PARTITION BY id ORDER BY frame)) / 10.0 AS pts FROM frame)
  SELECT t.id, k, (min(struct_pack(p := pts, f := frame))).f AS frame FROM t JOIN p ON p.id = t.id AND pts >= target GROUP BY t.id, k""")
def frame_asof(spark, sf_dir: str) -> DataFrame:
    """Segment midpoints of every video, each taking the first frame at or after it."""
    f = C.frames(spark, sf_dir)
    pts = f.select("id", "frame", (F.sum("n").over(Window.partitionBy("id").orderBy("frame")) / 10.0).alias("pts"))
    grid = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")
    t = C.videos(spark, sf_dir).select("id", "duration", grid).withColumn("target", F.col("duration") * (F.col("k") + 0.5) / 4)
    return t.join(pts, "id").where("pts >= target").groupBy("id", "k").agg(F.min_by("frame", F.struct("pts", "frame")).alias("frame"))


@query(f"""WITH {_EXACT}, here AS (SELECT p.*, right(survivor, 1) IN ('7', '9') AS dead FROM plan p WHERE right(path, 1) NOT IN ('7', '9')), heir AS (SELECT asset_id, min(path) AS heir FROM here WHERE dead GROUP BY asset_id)
  SELECT h.asset_id, path, CASE WHEN dead THEN heir ELSE survivor END AS survivor FROM here h LEFT JOIN heir x ON x.asset_id = h.asset_id WHERE NOT dead OR path <> heir""")
def survivor_promotion(spark, sf_dir: str) -> DataFrame:
    """An exact plan as it can be staged: files that vanished go, and where the survivor has, the first file left takes its place."""
    live = C.contents(spark, sf_dir).where("right(path, 1) NOT IN ('7', '9')").select("path")
    return review.materialized(_exact(spark, sf_dir, False), live).select("asset_id", "path", "survivor")


@query(f"""WITH {C.ASSETS}, {C.INST}, v AS (
    SELECT 'instance path' AS rule, path AS key FROM inst GROUP BY path HAVING count(*) > 1
    UNION ALL SELECT 'asset id', asset_id::VARCHAR FROM assets GROUP BY asset_id HAVING count(*) > 1
    UNION ALL SELECT DISTINCT 'instance asset', asset_id::VARCHAR FROM inst WHERE asset_id NOT IN (SELECT asset_id FROM assets))
  SELECT rule, count(*) AS violations FROM v GROUP BY rule""")
def constraint_violations(spark, sf_dir: str) -> DataFrame:
    """Keys that repeat and references that dangle."""
    a, i = C.assets(spark, sf_dir), C.instances(spark, sf_dir)
    twice = lambda df, key, rule: df.groupBy(F.col(key).cast("string").alias("key")).count().where("count > 1").select(F.lit(rule).alias("rule"), "key")
    dangling = i.join(a, "asset_id", "left_anti").select(F.lit("instance asset").alias("rule"), F.col("asset_id").cast("string").alias("key")).distinct()
    return twice(i, "path", "instance path").unionByName(twice(a, "asset_id", "asset id")).unionByName(dangling).groupBy("rule").agg(F.count(F.lit(1)).alias("violations"))


# --- snapshots and streams -------------------------------------------------------------------------------------------


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def probe_stream(spark, sf_dir: str) -> DataFrame:
    from prismcat.streaming.probe import run_once

    return run_once(spark, f"{sf_dir}/events.parquet")
