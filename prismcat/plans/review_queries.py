"""Queries of duplicate reviews, with their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismcat.functions import exprs as X
from prismcat.operators import match, review
from prismcat.plans.registry import query
from prismcat.sources import catalog as C

_NET = "(starts_with(path, repeat(chr(92), 2)) AND NOT starts_with(path, repeat(chr(92), 2) || '?' || chr(92)))"
_THRESHOLDS = f"""{C.RUNS}, thr AS (SELECT run_id, stage, coalesce(TRY_CAST(t_rec AS INT), 10) AS t_rec, coalesce(TRY_CAST(t_edit AS INT), 32) AS t_edit, coalesce(TRY_CAST(t_video AS INT), 90) AS t_video FROM runs)"""
_HERE = f"""{C.ASSETS}, {C.ACTIONS}, {_THRESHOLDS}, here AS MATERIALIZED (
  SELECT x.*, CASE WHEN a.media_type = 'video' THEN 'video' ELSE 'photo' END AS medium FROM actions x JOIN runs r ON r.run_id = x.run_id AND r.stage = x.stage LEFT JOIN assets a ON a.asset_id = x.asset_id)"""


def _here(spark, sf_dir: str) -> DataFrame:
    return review.current(C.actions(spark, sf_dir), C.runs(spark, sf_dir), C.assets(spark, sf_dir))


@query(f"WITH {_THRESHOLDS} SELECT run_id, t_rec, t_edit, t_video FROM thr")
def review_thresholds(spark, sf_dir: str) -> DataFrame:
    """The thresholds of every run, with defaults for what is missing or unusable."""
    return review.thresholds(C.runs(spark, sf_dir))


@query(f"""WITH {_HERE} SELECT run_id, count(*) FILTER (kind = 'exact') AS to_delete_exact, count(DISTINCT CASE WHEN kind = 'perceptual' THEN group_no END) AS groups,
  count(*) FILTER (kind = 'perceptual') AS members, count(*) FILTER (default_action = 'delete' AND {_NET}) AS network FROM here GROUP BY run_id""")
def review_counts(spark, sf_dir: str) -> DataFrame:
    """What the current stage of every run holds."""
    return review.counts(_here(spark, sf_dir), review.is_network())


@query(f"WITH {_HERE} SELECT run_id, asset_id, path, medium FROM here WHERE kind = 'perceptual'")
def review_media(spark, sf_dir: str) -> DataFrame:
    """Members with their medium; an asset that has gone counts as a photo."""
    return _here(spark, sf_dir).where("kind = 'perceptual'").select("run_id", "asset_id", "path", "medium")


_SPLIT = f"""{_HERE}, per AS (SELECT run_id, asset_id, count(*) AS n, sum(is_external) AS ext, bool_or(reason <> 'exact-internal') AS mixed FROM here WHERE kind = 'exact' GROUP BY ALL),
  split_ AS (SELECT run_id, sum(n)::BIGINT AS to_delete, sum(n - ext)::BIGINT AS internal, sum(ext)::BIGINT AS external, count(*) FILTER (NOT mixed) AS groups_internal_only, count(*) FILTER (mixed) AS groups_mixed FROM per GROUP BY run_id)"""


@query(f"WITH {_SPLIT} SELECT * FROM split_")
def review_exact_split(spark, sf_dir: str) -> DataFrame:
    """The exact stage of every run in numbers."""
    return review.exact_split(_here(spark, sf_dir))


_BUNDLE = f"""{_HERE}, grp AS (SELECT run_id, group_no, count(*) AS n, max(is_external) AS ext, max(1 - is_external) AS int_, max(CASE WHEN is_lead = 1 THEN is_external END) AS lead_ext,
    count(*) FILTER (is_lead = 0) AS rest, count(*) FILTER (is_lead = 0 AND {_NET}) AS rest_network FROM here WHERE kind = 'perceptual' GROUP BY ALL),
  bundle AS (SELECT run_id, count(*) AS groups, sum(n)::BIGINT AS members, count(*) FILTER (ext = 0) AS all_internal, count(*) FILTER (ext = 1 AND int_ = 1) AS mixed,
    count(*) FILTER (ext = 1 AND int_ = 1 AND lead_ext = 1) AS suggest_external, count(*) FILTER (ext = 1 AND int_ = 1 AND lead_ext = 0) AS suggest_internal,
    sum(rest)::BIGINT AS ks_delete, sum(rest_network)::BIGINT AS ks_network FROM grp GROUP BY run_id)"""


@query(f"WITH {_BUNDLE} SELECT * FROM bundle")
def review_group_stats(spark, sf_dir: str) -> DataFrame:
    """The group stage of every run in numbers."""
    return review.perceptual(_here(spark, sf_dir), review.is_network())


@query(f"WITH {_HERE} SELECT run_id, medium, coalesce(lead_reason, '') AS label, count(*) AS n FROM here WHERE kind = 'perceptual' AND is_lead = 1 GROUP BY ALL")
def review_lead_tally(spark, sf_dir: str) -> DataFrame:
    """What decided the leads, by medium."""
    return review.lead_tally(_here(spark, sf_dir))


def _third_sql(lo: str, hi: str, medium: str, where: str) -> str:
    n = f"({hi} - {lo} + 1)"
    cuts = [lo, f"({lo} + {n} // 3)", f"({lo} + 2 * {n} // 3)", f"({hi} + 1)"]
    return " UNION ALL ".join(f"SELECT run_id, '{medium}' AS medium, {k} AS bin, {a} AS lo, {b} - 1 AS hi FROM thr WHERE {where}" for k, (a, b) in enumerate(zip(cuts, cuts[1:])))


_BINS = f"""{_HERE}, bins AS ({_third_sql("0", "t_rec", "photo", "stage = 2")} UNION ALL {_third_sql("(t_rec + 1)", "t_edit", "photo", "stage = 3")}
  UNION ALL {_third_sql("0", "t_video", "video", "stage = 2")} UNION ALL SELECT run_id, 'video', 3, t_video + 1, 1000000000 FROM thr WHERE stage = 2),
  filled AS MATERIALIZED (SELECT b.run_id, b.medium, bin, lo::INT AS lo, hi::INT AS hi, count(h.run_id) AS n FROM bins b LEFT JOIN here h ON h.run_id = b.run_id AND h.medium = b.medium AND h.kind = 'perceptual' AND h.distance BETWEEN lo AND hi GROUP BY ALL)"""


def _filled(spark, sf_dir: str) -> DataFrame:
    return review.histogram(_here(spark, sf_dir), review.bins(C.runs(spark, sf_dir)))


@query(f"WITH {_BINS} SELECT * FROM filled")
def review_histogram(spark, sf_dir: str) -> DataFrame:
    """Members of every run by distance, in thirds of the run's own thresholds."""
    return _filled(spark, sf_dir)


@query(f"""WITH {_BINS}, lab AS (SELECT *, CASE WHEN hi >= 1000000000 THEN lo || '+' WHEN lo = hi THEN lo::VARCHAR ELSE lo || '–' || hi END AS label FROM filled),
  w AS (SELECT *, max(n) OVER p AS peak, max(length(label)) OVER p AS lw FROM lab WINDOW p AS (PARTITION BY run_id, medium))
  SELECT run_id, medium, bin, CASE WHEN peak > 0 THEN rtrim('  ' || rpad(label, lw::INT, ' ') || ' ' || repeat('█', round_even(greatest(4, least(16, 90 - lw - 8)) * n / peak, 0)::INT) || ' ' || n) ELSE '  (none)' END AS line
  FROM w WHERE peak > 0 OR bin = 0""")
def review_bars(spark, sf_dir: str) -> DataFrame:
    """The histograms as lines of text."""
    return review.bar_lines(_filled(spark, sf_dir))


_GROUPS_SQL = _BUNDLE.removeprefix(_HERE)


@query(f"""WITH {_SPLIT}{_GROUPS_SQL}, b AS (SELECT bundle.*, (stage = 2) AS ranked FROM bundle JOIN runs ON runs.run_id = bundle.run_id)
  SELECT run_id, k AS no, '  ' || line AS line FROM (SELECT run_id, unnest(range(len(lines)))::INT AS k, unnest(lines) AS line FROM (
    SELECT run_id, [printf('to delete (exact): %d file(s)  ·  %d internal, %d external', to_delete, internal, external), printf('group make-up:  %d internal-only · %d mixed (internal+external)', groups_internal_only, groups_mixed)] AS lines FROM split_
    UNION ALL SELECT run_id, list_filter([printf('%d near-dup groups / %d members (default-keep)', groups, members), printf('group make-up:  %d all-internal · %d mixed (internal+external)', all_internal, mixed),
      CASE WHEN mixed > 0 AND ranked THEN printf('  of the %d mixed groups →  %d suggest external · %d suggest internal', mixed, suggest_external, suggest_internal) WHEN mixed > 0 THEN printf('  of the %d mixed groups, an external copy is present', mixed) END,
      CASE WHEN ranked AND ks_delete > 0 THEN printf('tip: confirm · keep suggested — deletes %d non-leads', ks_delete) || CASE WHEN ks_network > 0 THEN printf(' (%d on network)', ks_network) ELSE '' END END], lambda x: x IS NOT NULL) FROM b))""")
def review_lines(spark, sf_dir: str) -> DataFrame:
    """The current stage of every run as lines of text."""
    rows, runs = _here(spark, sf_dir), C.runs(spark, sf_dir)
    bundle = review.perceptual(rows, review.is_network()).join(runs.select("run_id", "stage"), "run_id")
    return review.exact_lines(review.exact_split(rows)).unionByName(review.group_lines(bundle, F.col("stage") == 2))


_PRESENT = "present AS (SELECT run_id, stage, shortcut_name, path FROM actions WHERE length(path) % 3 <> 0)"
_INTENDED = f"""{C.ACTIONS}, {_PRESENT}, intended AS MATERIALIZED (
  SELECT * FROM actions a WHERE CASE WHEN stage = 1 THEN EXISTS (SELECT 1 FROM present p WHERE p.run_id = a.run_id AND p.stage = a.stage AND p.shortcut_name = a.shortcut_name)
    ELSE NOT EXISTS (SELECT 1 FROM present p WHERE p.run_id = a.run_id AND p.stage = a.stage AND p.shortcut_name = a.shortcut_name) END)"""


def _intended(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    actions = C.actions(spark, sf_dir)
    return actions, review.intended(actions, actions.where("length(path) % 3 <> 0"))


@query(f"WITH {_INTENDED} SELECT run_id, stage, path, shortcut_name FROM intended")
def review_intended(spark, sf_dir: str) -> DataFrame:
    """What a confirmation would delete, by the shortcuts that are still there."""
    return _intended(spark, sf_dir)[1].select("run_id", "stage", "path", "shortcut_name")


@query(f"WITH {C.ACTIONS} SELECT run_id, group_no, path FROM actions a WHERE is_lead = 0 AND EXISTS (SELECT 1 FROM actions b WHERE b.is_lead = 1 AND b.run_id = a.run_id AND b.stage = a.stage AND b.group_no = a.group_no)")
def review_keep_suggested(spark, sf_dir: str) -> DataFrame:
    """What keeping only the suggested leads would delete."""
    actions = C.actions(spark, sf_dir)
    return review.intended(actions, actions.limit(0), keep_suggested=True).select("run_id", "group_no", "path")


_DONE = f"""{_INTENDED}, done AS MATERIALIZED (SELECT *, CASE WHEN length(path) % 7 = 0 THEN 'already-gone' WHEN length(path) % 7 = 1 THEN 'error: locked' ELSE 'deleted' END AS disposition FROM intended)"""


def _done(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    actions, wanted = _intended(spark, sf_dir)
    n = F.length("path") % 7
    results = actions.where(n != 0).select("path", F.when(n == 1, "locked").otherwise("done").alias("result"))
    return actions, review.dispositions(wanted, results, review.is_network())


@query(f"WITH {_DONE} SELECT run_id, path, disposition, CASE WHEN disposition = 'deleted' THEN CASE WHEN {_NET} THEN 'permanent' ELSE 'recycle-bin' END END AS recycle FROM done")
def review_dispositions(spark, sf_dir: str) -> DataFrame:
    """What became of every file that a confirmation meant to delete."""
    return _done(spark, sf_dir)[1].select("run_id", "path", "disposition", "recycle")


@query(f"""WITH {_DONE} SELECT run_id, count(*) FILTER (disposition = 'deleted' AND kind = 'exact') AS exact_deleted, count(*) FILTER (disposition = 'deleted' AND kind = 'perceptual') AS perceptual_deleted,
  count(*) FILTER (disposition = 'deleted' AND is_external = 1) AS external_deleted, count(*) FILTER (disposition = 'deleted' AND {_NET}) AS network_deleted,
  count(*) FILTER (disposition = 'already-gone') AS already_gone, count(*) FILTER (starts_with(disposition, 'error')) AS errors FROM done GROUP BY run_id""")
def review_outcome(spark, sf_dir: str) -> DataFrame:
    """What a confirmation of every run came to."""
    return review.outcome(_done(spark, sf_dir)[1], review.is_network())


_COUNTS = f"""{_HERE}, cnt AS (SELECT run_id, count(*) FILTER (kind = 'exact') AS exact, count(DISTINCT CASE WHEN kind = 'perceptual' THEN group_no END) AS groups, count(*) FILTER (kind = 'perceptual') AS members FROM here GROUP BY run_id),
  job AS (SELECT *, unnest(['analyze', 'confirm', 'cancel']) AS action FROM runs)"""


@query(f"""WITH {_COUNTS}, t AS (SELECT j.run_id, action, status, stage, CASE WHEN stage = 1 THEN printf('%d exact', coalesce(exact, 0)) ELSE printf('%d grp/%d mbr', coalesce(groups, 0), coalesce(members, 0)) END AS phrase,
    printf('%s: applied stage %d (%d deleted) · ', action, greatest(stage - 1, 1), j.run_id * 3) AS went FROM job j LEFT JOIN cnt ON cnt.run_id = j.run_id)
  SELECT run_id, action, CASE WHEN status = 'pending' AND action = 'confirm' THEN went || printf('advanced to stage %d · ', stage) || phrase WHEN status = 'pending' THEN action || printf(': staged stage %d · ', stage) || phrase
    WHEN status = 'completed' AND action = 'analyze' THEN 'analyze: already clean (nothing to review)' WHEN status = 'completed' AND action = 'confirm' THEN went || 'run completed' ELSE action || ': run ' || status END AS summary FROM t""")
def review_result_lines(spark, sf_dir: str) -> DataFrame:
    """The outcome of every kind of review job as one line."""
    runs = C.runs(spark, sf_dir)
    rows = runs.join(review.counts(_here(spark, sf_dir), review.is_network()), "run_id", "left").withColumn("action", F.explode(F.array(*[F.lit(a) for a in ("analyze", "confirm", "cancel")])))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    phrase = review.count_text(F.col("stage"), zero("to_delete_exact"), zero("groups"), zero("members"))
    text = review.result_text(F.col("action"), F.col("status"), F.col("stage"), F.greatest(F.col("stage") - 1, F.lit(1)), F.col("run_id") * 3, phrase)
    return rows.select("run_id", "action", text.alias("summary"))


@query(f"""WITH {C.ASSETS}, {_DONE}, gone AS (SELECT * FROM done WHERE disposition IN ('deleted', 'already-gone')),
  kept AS (SELECT DISTINCT asset_id FROM actions WHERE path NOT IN (SELECT path FROM gone))
  SELECT asset_id, CASE WHEN bool_or(kind = 'perceptual' AND disposition = 'deleted') THEN 'trashed' ELSE 'forgotten' END AS fate FROM gone
  WHERE asset_id IN (SELECT asset_id FROM assets WHERE status = 'active') AND asset_id NOT IN (SELECT asset_id FROM kept) GROUP BY asset_id""")
def review_applied(spark, sf_dir: str) -> DataFrame:
    """Assets that a confirmation leaves without a file: trashed or forgotten."""
    actions, done = _done(spark, sf_dir)
    return review.applied(done, C.assets(spark, sf_dir), actions.select("asset_id", "path"))


@query(f"""WITH {C.ACTIONS}, {C.RUNS}, n AS (SELECT run_id, stage, count(*) AS n FROM actions GROUP BY ALL)
  SELECT n.run_id, min(n.stage) FILTER (n.stage >= r.stage + 1 AND n > 0) AS next_stage FROM n JOIN runs r ON r.run_id = n.run_id GROUP BY n.run_id""")
def review_next_stage(spark, sf_dir: str) -> DataFrame:
    """The stage to which each run goes on, null if nothing is left."""
    planned = C.actions(spark, sf_dir).groupBy("run_id", "stage").agg(F.count(F.lit(1)).alias("n"))
    at = C.runs(spark, sf_dir).select("run_id", F.col("stage").alias("at"))
    return review.first_stage(planned.join(at, "run_id"), F.col("at") + 1)


_FROZEN = """frozen AS (SELECT event_id AS id, CASE WHEN event_type = 'view' THEN 'cleanup' ELSE 'dedup' END AS type, (user_id % 10)::INT AS root_id, CASE WHEN event_id % 3 <> 0 THEN 'pending' ELSE 'completed' END AS review_status,
  (event_id % 3 + 1)::INT AS stage, CASE WHEN event_id % 4 <> 0 THEN (event_id % 30)::INT END AS run_id FROM events)"""


@query(f"""WITH {C.RUNS}, {_FROZEN}, newest AS (SELECT DISTINCT ON (root_id, run_type) * FROM runs ORDER BY root_id, run_type, run_id DESC),
  j AS (SELECT f.id, f.review_status, f.stage, CASE WHEN r.run_id IS NULL THEN n.status ELSE r.status END AS status, CASE WHEN r.run_id IS NULL THEN n.stage ELSE r.stage END AS live
    FROM frozen f LEFT JOIN runs r ON r.run_id = f.run_id LEFT JOIN newest n ON n.root_id = f.root_id AND n.run_type = CASE WHEN f.type = 'cleanup' THEN 'cleanup-perceptual' ELSE 'dedup' END)
  SELECT id, CASE WHEN review_status <> 'pending' THEN NULL WHEN coalesce(status, '') <> 'pending' THEN 'closed' WHEN live <> stage THEN 'advanced' ELSE 'current' END AS state,
    CASE WHEN review_status = 'pending' AND status = 'pending' THEN live END AS live_stage FROM j""")
def review_cards(spark, sf_dir: str) -> DataFrame:
    """Whether a review that a job left pending is still the one to act on."""
    k = F.col("event_id")
    frozen = C.table(spark, sf_dir, "events").select(
        k.alias("id"), F.when(F.col("event_type") == "view", "cleanup").otherwise("dedup").alias("type"), (F.col("user_id") % 10).cast("int").alias("root_id"),
        F.when(k % 3 != 0, "pending").otherwise("completed").alias("review_status"), (k % 3 + 1).cast("int").alias("stage"), F.when(k % 4 != 0, (k % 30).cast("int")).alias("run_id"),
    )
    return review.cards(frozen, C.runs(spark, sf_dir))


@query(f"""WITH {C.EDGES}, q AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 <> 0 THEN p_size END AS quality FROM part),
  ends AS (SELECT a AS id, b AS other, distance FROM edge UNION ALL SELECT b, a, distance FROM edge)
  SELECT e.id, min(distance) AS distance, max(own.quality) AS quality, coalesce(max(own.quality) < 20, false) OR coalesce(bool_or(q.quality < 20), false) AS low_confidence
  FROM ends e LEFT JOIN q ON q.id = e.other LEFT JOIN q own ON own.id = e.id GROUP BY e.id""")
def near_dup_confidence(spark, sf_dir: str) -> DataFrame:
    """Nearest neighbour, own quality, and whether it or a neighbour is of doubtful quality."""
    edges = match.photo_edges(C.signatures(spark, sf_dir), ["l0", "l1"], 19, bits=32)
    quality = C.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_size")).alias("quality"))
    return review.low_confidence(edges, quality, 20)


@query(f"""WITH {C.SIGS}, t AS (SELECT * FROM sig WHERE label % 2 = 0), p AS (SELECT * FROM sig WHERE label % 2 = 1), e AS (
    SELECT t.id AS target, p.id AS match, (bit_count(xor(t.l0, p.l0)) + bit_count(xor(t.l1, p.l1)))::INT AS distance FROM t JOIN p ON t.id <> p.id),
  best AS (SELECT target, (min(struct_pack(d := distance, m := match))).m AS match, min(distance) AS distance FROM e WHERE distance <= 22 GROUP BY target),
  rows_ AS (SELECT l_orderkey AS asset_id, l_linenumber, match, distance FROM lineitem JOIN best ON target = l_orderkey)
  SELECT asset_id, l_linenumber, match, distance, printf('%04d.lnk', row_number() OVER (ORDER BY asset_id, l_linenumber, l_partkey, l_suppkey)) AS shortcut
  FROM (SELECT l_orderkey AS asset_id, l_linenumber, l_partkey, l_suppkey, match, distance FROM lineitem JOIN best ON target = l_orderkey)""")
def cleanup_perceptual_files(spark, sf_dir: str) -> DataFrame:
    """Every file of an asset that resembles trash, with the closest match and its number in the plan."""
    from prismcat.plans.scratch import numbered

    sig = C.signatures(spark, sf_dir)
    found = match.cross_edges(sig.where("label % 2 = 0"), sig.where("label % 2 = 1"), ["l0", "l1"], 22, bits=32)
    best = found.groupBy(F.col("target").alias("asset_id")).agg(F.min_by("match", F.struct("distance", "match")).alias("match"), F.min("distance").alias("distance"))
    files = C.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("asset_id"), "l_linenumber", "l_partkey", "l_suppkey").join(best, "asset_id")
    return numbered(files, ["asset_id", "l_linenumber", "l_partkey", "l_suppkey"], "nth").select("asset_id", "l_linenumber", "match", "distance", X.shortcut(F.col("nth"), 4).alias("shortcut"))
